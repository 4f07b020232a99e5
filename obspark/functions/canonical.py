"""Canonical JSON of nested values (keys sorted at every depth, no blanks, ASCII only) and its hashes, as Column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings of which every character stands for itself.
_PLAIN = r'\A[ !#-\[\]-~]*\z'
# Characters with a short escape.
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _escaped(ch: Column) -> Column:
    code = F.ascii(ch)
    out = F.when((code >= 32) & (code < 127), ch)
    for k, v in _SHORT.items():
        out = F.when(ch == k, F.lit(v)) if k == '"' else out.when(ch == k, F.lit(v))
    out = out.when((code >= 32) & (code < 127), ch)
    high = _unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10))
    low = _unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF))
    return out.when(code < 0x10000, _unit(code)).otherwise(F.concat(high, low))


def json_string(c: Column) -> Column:
    """A string as JSON in ASCII; null stays null."""
    slow = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)."), F.lit(0)), _escaped), "")
    return F.concat(F.lit('"'), F.when(c.rlike(_PLAIN), c).otherwise(slow), F.lit('"'))


@F.pandas_udf(T.StringType())
def _rewritten(texts: pd.Series) -> pd.Series:
    """JSON texts in canonical form."""
    return texts.map(lambda x: json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True))


def _has_doubles(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_doubles(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_doubles(kind.elementType)
    return _has_doubles(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, (T.DoubleType, T.FloatType))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a value of the type ``kind``: strings, numbers, booleans, and structs, string-keyed maps and arrays of them. Null is ``null``.

    Equal to what Python's json writes with sorted keys and without blanks. Types without a JSON form raise. Values
    without doubles are expressions of the plan; doubles are written again by an Arrow-batched function, as Java
    gives some of them a digit more than they need. They must be finite.
    """
    if _has_doubles(kind):
        wrapped = _rewritten(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}))
        return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    return _built(c, kind)


def _built(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        out = json_string(c)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        out = c.cast("string")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _built(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(c), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda x: F.concat(json_string(x["key"]), F.lit(":"), _built(x["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            parts += [json_string(F.lit(f.name)), F.lit(":"), _built(c[f.name], f.dataType), F.lit(",")]
        out = F.concat(F.lit("{"), *parts[:-1], F.lit("}"))
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(out)


def json_hash(c: Column, kind: T.DataType, digits: int = 64) -> Column:
    """Leading digits of the SHA-256 of the canonical JSON."""
    return F.substring(F.sha2(canonical_json(c, kind), 256), 1, digits)
