"""Operator 13: fill-in-the-middle rearrangement of texts.

A text is decoded once to an array of UTF-32 code points. Each code point has a
class; where neighbours' classes say so a unit ends, and ``flatnonzero`` of
that comparison gives all boundaries at once. Two ranks drawn from a hash of
the id index the boundaries, the array is sliced there, and the three pieces are
encoded again. Map-only: no row meets another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WIDE = "utf-32-le"
#: White space that separates words.
BLANKS = np.array([9, 10, 11, 12, 13, 32], "<u4")


def _after_newlines(points: np.ndarray) -> np.ndarray:
    """A line ends behind its newline: the class of the left neighbour decides."""
    return np.flatnonzero(points[:-1] == 10) + 1


def _at_word_starts(points: np.ndarray) -> np.ndarray:
    """A word with the white space behind it: a boundary where white space turns into something else."""
    blank = np.isin(points, BLANKS)
    return np.flatnonzero(blank[:-1] & ~blank[1:]) + 1


def _everywhere(points: np.ndarray) -> np.ndarray:
    return np.arange(1, len(points))


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"line": _after_newlines, "word": _at_word_starts, "char": _everywhere}


@dataclass(frozen=True)
class Plan:
    """Unit of the cuts, per cent of texts that are rearranged, per cent of those with the suffix first, and the seed of the draws."""

    unit: str = "line"
    rate: int = 100
    suffix_first: int = 50
    seed: str = "7"


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers from the hash of seed and id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearranged(doc_id: int | None, text: str | None, plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """Units, form (plain, psm or spm), code points of prefix and middle, and the output of a text."""
    text = text or ""
    points = np.frombuffer(text.encode(WIDE, "surrogatepass"), "<u4")
    bounds = np.concatenate([[0], UNITS[plan.unit](points), [len(points)]]) if len(points) else np.zeros(1, np.int64)
    n = len(bounds) - 1
    h = draws(plan.seed, doc_id)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= plan.rate:
        return n, "plain", None, None, text
    a, b = sorted(int(bounds[x % (n + 1)]) for x in h[:2])
    prefix, middle, suffix = (p.tobytes().decode(WIDE, "surrogatepass") for p in (points[:a], points[a:b], points[b:]))
    if h[3] % 100 < plan.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text of an output; marks never occur in rearranged texts, so the first of each is the one that was put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, rest = output.removeprefix(first).partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == "psm" else tail + middle + head


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    A null text counts as empty; empty texts and texts that hold a mark stay
    plain, with null lengths. A null id is drawn for as an empty string; equal ids with
    equal texts give equal rows. Texts are taken whole. An empty table gives no
    rows; other columns are ignored.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.batches(frames, "doc_id", "text"):
            n, form, a, b, out = zip(*(rearranged(i, t, plan) for i, t in zip(ids, texts, strict=True)), strict=True)
            cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(task, SCHEMA)


def restore(outputs: DataFrame, name: str = "restored") -> DataFrame:
    """Adds the exact texts (column ``name``) that outputs (output, form) were made of."""

    @F.pandas_udf("string")
    def back(output, form):
        return output.combine(form, restored)

    return outputs.withColumn(name, back("output", "form"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged by lines, with hashes of the outputs and of the texts rebuilt from them."""
    out = restore(fill_in_middle(common.documents(spark, sf_dir)))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
