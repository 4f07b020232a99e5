"""Operators 1 and 3: byte-level convolutional networks in numpy.

Quality (1): filters over overlapping chunks that cover the whole document,
each max-pooled over the document, combined into one probability. Its inputs
are the bytes and nothing else.

Language (3): filters of several widths over fixed-length windows that cover
the whole text, max-pooled per window, softmax per window; windows are averaged
in log space, weighted by their bytes.

Both are trained in numpy with Adam on a bounded sample of labelled rows, drawn
by a hash of the id: the gradient of a max-pooled filter reaches only the bytes
where it is largest. Scoring is a map over the rows with the weights in its
closure: no shuffle, memory bounded by an Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obspark.llm import common

#: Most labelled rows that a model is fitted on.
SAMPLE = 3000
QUALITY_FILTERS, CHUNK, STRIDE = 16, 16, 8
LANGUAGE_WIDTHS, LANGUAGE_FILTERS, WINDOW = (2, 3, 4, 5), 8, 256
CODES, PAD = 257, 256
LETTER = re.compile(r"[^\W\d_]")


class Adam:
    """Adam over a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.weights[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


# Quality


def chunk_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Input codes in rows of STRIDE bytes, every text padded to whole rows plus one, and the first row of each text."""
    parts, starts, at = [], [], 0
    for t in texts:
        x = utf8(t)
        rows = -(-len(x) // STRIDE) + 1
        c = np.full(rows * STRIDE, PAD, np.uint16)
        c[: len(x)] = x
        parts.append(c)
        starts.append(at)
        at += rows
    return np.concatenate(parts).reshape(-1, STRIDE), np.array(starts)


class Quality:
    """Weights of the quality network: ``taps`` (STRIDE, CODES, 2 x filters), ``bias``, ``out``, ``base``."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        taps = rng.normal(0, 0.05, (STRIDE, CODES, 2 * QUALITY_FILTERS)).astype(np.float32)
        taps[:, PAD] = 0
        self.w = {"taps": taps, "bias": np.zeros(QUALITY_FILTERS, np.float32), "out": rng.normal(0, 0.3, QUALITY_FILTERS).astype(np.float32), "base": np.zeros(1, np.float32)}

    def pooled(self, codes: np.ndarray, starts: np.ndarray, where: bool = False):
        """Largest response of each filter in each text (at least 0), and with ``where`` the row it begins at."""
        taps, f = self.w["taps"], QUALITY_FILTERS
        both = np.empty((len(codes), 2 * f), np.float32)
        for a in range(0, len(codes), 4096):  # in pieces that stay in the cache
            part = codes[a : a + 4096]
            acc = taps[0].take(part[:, 0], axis=0)
            for j in range(1, STRIDE):
                acc += taps[j].take(part[:, j], axis=0)
            both[a : a + 4096] = acc
        r = both[:, :f]
        r[:-1] += both[1:, f:]
        r += self.w["bias"]
        ends = np.append(starts[1:], len(codes))
        r[ends - 1] = 0  # the padding row; also what ReLU leaves at least
        top = np.maximum.reduceat(r, starts, axis=0)
        if not where:
            return top
        return top, np.stack([starts[i] + r[starts[i] : ends[i]].argmax(axis=0) for i in range(len(starts))])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        top = self.pooled(*chunk_codes(texts))
        return 1 / (1 + np.exp(-(top @ self.w["out"] + self.w["base"]).astype(np.float64)))

    def fit(self, texts: list[str | None], labels: np.ndarray, epochs: int = 24, batch: int = 32, rate: float = 0.01) -> Quality:
        rng, adam, f = np.random.default_rng(1), Adam(self.w, rate), QUALITY_FILTERS
        if not len(texts):
            return self
        y = labels.astype(np.float32)
        # both classes weigh half as far as their sizes differ
        weight = np.where(y > 0, (len(y) / (2 * max(1, y.sum()))) ** 0.5, (len(y) / (2 * max(1, (1 - y).sum()))) ** 0.5).astype(np.float32)
        ready = [chunk_codes([t])[0] for t in texts]
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                parts = [ready[i] for i in pick]
                codes = np.concatenate(parts)
                starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
                top, at = self.pooled(codes, starts, where=True)
                p = 1 / (1 + np.exp(-(top @ self.w["out"] + self.w["base"])))
                g = (p - y[pick]) * weight[pick] / len(pick)
                gf = g[:, None] * self.w["out"] * (top > 0)
                taps = np.zeros_like(self.w["taps"])
                cols = np.broadcast_to(np.arange(f), at.shape)
                for j in range(STRIDE):
                    np.add.at(taps[j], (codes[at, j], cols), gf)
                    np.add.at(taps[j], (codes[np.minimum(at + 1, len(codes) - 1), j], cols + f), gf)
                taps[:, PAD] = 0
                adam.step({"taps": taps + 1e-5 * self.w["taps"], "bias": gf.sum(0), "out": top.T @ g + 1e-4 * self.w["out"], "base": g.sum(keepdims=True)})
        return self


# Language


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows of all texts (at least one each), the text of each window, and its bytes."""
    parts, owner, weight = [], [], []
    for i, t in enumerate(texts):
        x = utf8(t)
        n = max(1, -(-len(x) // WINDOW))
        c = np.full(n * WINDOW, PAD, np.uint16)
        c[: len(x)] = x
        parts.append(c)
        owner += [i] * n
        weight += [*[WINDOW] * (n - 1), max(1, len(x) - (n - 1) * WINDOW)]
    return np.concatenate(parts).reshape(-1, WINDOW), np.array(owner), np.array(weight, np.float64)


class Language:
    """Weights: ``taps`` (widest, CODES, filters of all widths), ``bias``, ``out``, ``base``; narrow filters have no later taps."""

    def __init__(self, values: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        n = LANGUAGE_FILTERS * len(LANGUAGE_WIDTHS)
        self.values = values
        #: filters of a width stand after those of wider ones, so tap j concerns the first ``live[j]`` columns
        self.live = [LANGUAGE_FILTERS * sum(w > j for w in LANGUAGE_WIDTHS) for j in range(max(LANGUAGE_WIDTHS))]
        taps = rng.normal(0, 0.3, (max(LANGUAGE_WIDTHS), CODES, n)).astype(np.float32)
        taps[:, PAD] = 0
        self.w = {"taps": taps, "bias": np.zeros(n, np.float32), "out": rng.normal(0, 0.1, (n, len(values))).astype(np.float32), "base": np.zeros(len(values), np.float32)}
        self.trim()

    def trim(self) -> None:
        """The gathered tables, each as narrow as its filters."""
        self.tables = [np.ascontiguousarray(self.w["taps"][j][:, :k]) for j, k in enumerate(self.live)]

    def responses(self, x: np.ndarray) -> np.ndarray:
        long = WINDOW - len(self.tables) + 1
        out = self.tables[0].take(x[:, :long], axis=0)
        for j in range(1, len(self.tables)):
            out[:, :, : self.live[j]] += self.tables[j].take(x[:, j : j + long], axis=0)
        return out

    def log_softmax(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top + self.w["bias"], 0) @ self.w["out"] + self.w["base"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability; ``und`` with probability 0 for null texts and those without a letter."""
        if not texts or not self.values:
            return ["und"] * len(texts), np.zeros(len(texts))
        x, owner, weight = windows(texts)
        logs = np.concatenate([self.log_softmax(self.responses(x[a : a + 64]).max(axis=1)) for a in range(0, len(x), 64)]).astype(np.float64)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        mean = np.add.reduceat(logs * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = [bool(t and LETTER.search(t)) for t in texts]
        return [self.values[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(p)), best], 0.0)

    def fit(self, texts: list[str | None], labels: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.01) -> Language:
        if not texts:
            return self
        rng, adam = np.random.default_rng(5), Adam(self.w, rate)
        x, owner, _ = windows(texts)
        y = np.array([self.values.index(v) for v in labels])[owner]
        # a short window in place of a whole one now and then, so that short texts are learnt too
        for epoch in range(epochs):
            adam.rate = rate * (1 - epoch / epochs) + 1e-4
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                part = x[pick].copy()
                cut = rng.integers(12, 3 * WINDOW, len(pick))
                part[np.arange(WINDOW)[None, :] >= cut[:, None]] = PAD
                r = self.responses(part)
                at = r.argmax(axis=1)
                top = np.take_along_axis(r, at[:, None], axis=1)[:, 0]
                hidden = np.maximum(top + self.w["bias"], 0)
                g = np.exp(self.log_softmax(top))
                g[np.arange(len(pick)), y[pick]] -= 1
                g = (g / len(pick)).astype(np.float32)
                gh = (g @ self.w["out"].T) * (hidden > 0)
                taps = np.zeros_like(self.w["taps"])
                rows = np.arange(len(pick))[:, None]
                for j, k in enumerate(self.live):
                    np.add.at(taps[j], (part[rows, at[:, :k] + j], np.broadcast_to(np.arange(k), (len(pick), k))), gh[:, :k])
                taps[:, PAD] = 0
                adam.step({"taps": taps, "bias": gh.sum(0), "out": hidden.T @ g + 1e-4 * self.w["out"], "base": g.sum(0)})
                self.trim()
        return self


# Spark


def sample(labelled: DataFrame, bound: int) -> list:
    """At most ``bound`` labelled rows (id, text, label), those of the least hashes of their ids."""
    return labelled.orderBy(F.xxhash64("id"), "id", F.xxhash64("text", "label")).limit(bound).collect()


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Quality:
    """Fits on ``docs`` (doc_id, text) joined with ``labels`` (doc_id, quality), the rows with a label only.

    Without labelled rows the network stays as it was drawn.
    """
    drawn = labels.filter("quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("quality").alias("label"))
    got = sample(rows, bound)
    return Quality().fit([r["text"] for r in got], np.array([r["label"] for r in got]))


def fit_language(docs: DataFrame, bound: int = SAMPLE) -> Language:
    """Fits on the rows of ``docs`` (doc_id, text, lang) with text and language."""
    drawn = docs.filter("lang is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang").join(F.broadcast(drawn.distinct()), "doc_id")
    got = sample(rows.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")), bound)
    values = sorted({r["label"] for r in got})
    return Language(values).fit([r["text"] for r in got], [r["label"] for r in got])


def score_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text; others are ignored).

    A null text counts as empty, whose score is the network's base rate; texts
    of any length are read whole; rows with equal texts have equal scores, and
    repeated rows are scored each. An empty table gives no rows.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.batches(frames, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.scores(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, score double")


def predict_language(docs: DataFrame, model: Language) -> DataFrame:
    """doc_id, lang_pred and score of each row of ``docs`` (doc_id, text; others are ignored).

    ``und`` and 0 for null texts and those without a letter; of languages with
    equal probability the first by name; texts of any length are read whole;
    repeated rows are told each. An empty table gives no rows.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.batches(frames, "doc_id", "text"):
            lang, score = model.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, lang_pred string, score double")


def remainder(modulus: int):
    """crc32 of the id as text, modulo ``modulus``: what rows a model may learn from (null without an id: those are neither learnt from nor held out)."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def held_out(modulus: int, value: int):
    return F.coalesce(remainder(modulus) == value, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; rows of remainder 1 modulo 3 are held out."""
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.filter(remainder(3) != 1))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; rows of remainder 0 modulo 5 are held out."""
    docs = common.documents(spark, sf_dir)
    model = fit_language(docs.filter(remainder(5) != 0))
    return predict_language(docs, model).select("doc_id", held_out(5, 0), "lang_pred", "score")
