"""Canonical JSON against Python's json on random nested values."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obspark.functions import canonical

STRINGS = ["", "a", 'q"uote', "back\\slash", "new\nline\ttab\r\b\f", "é漢", "😀x", "\x00\x1f\x7f", "/path", " ", "a b~"]
DOUBLES = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 9.99e-5, 1e-5, 123456.789, 1e15, 1e16, 1.5e16, 12345678.0, 0.001, 100.0, 1e22, 1.25e-9, 1e100, math.pi, 9999999.0, 1e7, 0.3 * 3, 123e-5]


def dumped(v):
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def test_strings_and_numbers(spark):
    rng = random.Random(2)
    doubles = DOUBLES + [round(rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 18), 6) for _ in range(300)]
    df = spark.createDataFrame([(i, STRINGS[i % len(STRINGS)], d, i * 7 - 3, i % 3 == 0 or None) for i, d in enumerate(doubles)], "i int, s string, d double, n long, b boolean").coalesce(1)
    got = df.select("i", *[canonical.canonical_json(F.col(f.name), f.dataType).alias(f"j{f.name}") for f in df.schema.fields], "s", "d", "n", "b").collect()
    for r in got:
        assert r.js == dumped(r.s) and r.jn == dumped(r.n) and r.jb == dumped(r.b) and r.jd == dumped(r.d)


KIND = T.StructType([T.StructField("z", T.ArrayType(T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.StringType())]))), T.StructField("Z", T.MapType(T.StringType(), T.ArrayType(T.LongType()))), T.StructField("é", T.BooleanType()), T.StructField("m", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))])


def random_value(rng, kind):
    if rng.random() < 0.15:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: random_value(rng, f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [random_value(rng, kind.elementType) for _ in range(rng.randrange(4))]
    if isinstance(kind, T.MapType):
        return {rng.choice(STRINGS): random_value(rng, kind.valueType) for _ in range(rng.randrange(4))}
    if isinstance(kind, T.StringType):
        return rng.choice(STRINGS)
    if isinstance(kind, T.BooleanType):
        return rng.random() < 0.5
    return rng.randrange(-99, 99) if isinstance(kind, T.LongType) else rng.choice(DOUBLES[:20])


def test_random_nested_values(spark):
    rng = random.Random(6)
    values = [random_value(rng, KIND) for _ in range(120)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", KIND)]))
    for r in df.select("i", canonical.canonical_json(F.col("v"), KIND).alias("j"), canonical.json_hash(F.col("v"), KIND, 16).alias("h")).collect():
        want = dumped(values[r.i])
        assert r.j == want and r.h == hashlib.sha256(want.encode()).hexdigest()[:16]


def test_types_without_a_form(spark):
    with pytest.raises(TypeError):
        canonical.canonical_json(F.lit(b"x"), T.BinaryType())
