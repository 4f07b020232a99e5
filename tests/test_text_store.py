"""The kept text index against one that is built anew."""

import random
import re

import pytest
from pyspark.sql import functions as F

from obspark.operators import cover_density, search, text_store

CHANNELS = ("static_text", "dynamic_text")
SCHEMA = "record_id string, static_text string, dynamic_text string"


def made(rng, ids):
    return [(i, rng.choice([None, "", " ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9)))]), " ".join(rng.choices(["x", "y", "a", "é"], k=rng.randrange(4)))) for i in ids]


def content(store):
    post = sorted((c, t, r.record_id, tuple(r.positions)) for c in CHANNELS for t in "abcdefghxye" for r in store.postings([t], c).collect())
    docs = sorted((r.record_id, r.channel, r.tokens, tuple(sorted(r.words))) for r in store.documents().collect())
    counts = sorted(tuple(r) for r in store.frequencies().collect())
    return post, docs, counts


def statistics(store, spark):
    return spark.range(1).select(store.statistics(CHANNELS, ["a", "x", "zz"]).alias("s")).first().s.asDict()


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(8)
    now = {r[0]: r for r in made(rng, [f"r{i}" for i in range(30)])}
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store = text_store.create(frame(list(now.values())), str(tmp_path / "a"), CHANNELS)
    for step in range(4):
        if step == 2:
            gone = ["r1", "r40", "nowhere", "r1"]
            store.delete(spark.createDataFrame([(g,) for g in gone], "record_id string"))
            now = {k: v for k, v in now.items() if k not in gone}
        else:
            new = made(rng, [f"r{rng.randrange(50)}" for _ in range(8)])
            new = list({r[0]: r for r in new}.values())
            store.upsert(frame(new))
            now |= {r[0]: r for r in new}
    fresh = text_store.create(frame(list(now.values())), str(tmp_path / "b"), CHANNELS)
    want = content(fresh)
    assert content(store) == want and statistics(store, spark) == statistics(fresh, spark)
    assert len(store.deltas()[1]) == 5
    store.compact()
    assert len(store.deltas()[1]) == 1 and content(store) == want and statistics(store, spark) == statistics(fresh, spark)
    # the corpus itself tells the same
    texts = frame(list(now.values()))
    told = spark.range(1).select(search.text_statistics(texts, CHANNELS, ["a", "x", "zz"]).alias("s")).first().s.asDict()
    assert told == statistics(store, spark)
    scored = {r.record_id: pytest.approx(r.bm25) for r in search.bm25(texts, "static_text", "a b a").filter("bm25 is not null").collect()}
    assert {r.record_id: r.bm25 for r in store.relevance("static_text", "a b a", texts).collect()} == scored
    groups = cover_density.parse('a b or "c d"')
    dense = store.occurrences("static_text", cover_density.words_of(groups), texts).select("record_id", F.round(cover_density.cover_density(F.col("at"), groups), 9).alias("d")).filter("d > 0")
    again = cover_density.text_relevance(texts, "static_text", 'a b or "c d"').select("record_id", F.round("cover_density", 9).alias("d")).filter("d > 0")
    assert sorted(map(tuple, dense.collect())) == sorted(map(tuple, again.collect())) != []


def test_two_writers_and_many_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_store, "MOST_DELTAS", 3)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    store = text_store.create(frame([("a", "a", "")]), str(tmp_path), CHANNELS)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        store._commit(0, [])
    for i in range(3):
        store.upsert(frame([(f"n{i}", "a b", "x")]))
    assert len(store.deltas()[1]) < 3 and store.frequencies(["a"]).filter("channel = 'static_text'").first().documents == 4


def test_terms_reach_the_scan(spark, tmp_path):
    store = text_store.create(spark.createDataFrame([("a", "one two", "x")], SCHEMA), str(tmp_path), CHANNELS)
    plan = store.postings(["one"], "static_text")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(term", plan)


def test_empty_index(spark, tmp_path):
    store = text_store.create(spark.createDataFrame([], SCHEMA), str(tmp_path), CHANNELS)
    assert store.documents().count() == 0 and store.relevance("static_text", "a", spark.createDataFrame([("a",)], "record_id string")).count() == 0
    assert statistics(store, spark)["n"] == 0


def test_postings_are_kept_in_blocks(spark, tmp_path):
    """A term that many records have is a few rows, also after a compaction; each record keeps its own places."""
    frame = lambda ids: spark.createDataFrame([(f"r{i}", "a " * (i % 3 + 1) + "b", "a") for i in ids], SCHEMA).coalesce(2)
    store = text_store.create(frame(range(300)), str(tmp_path), CHANNELS)
    stored = lambda: spark.read.parquet(f"{tmp_path}/{store.deltas()[1][0]}/postings")
    want = {f"r{i}": list(range(1, i % 3 + 2)) for i in range(300)}
    for _ in range(2):
        assert stored().count() <= 6 and stored().agg(F.sum("n")).first()[0] == 900
        assert {r.record_id: r.positions for r in store.postings(["a"], "static_text").collect()} == want
        store.compact()


def test_blocks_are_strings(spark, tmp_path):
    """Ids and places of a block are a string each, whatever the ids hold; ASCII and other texts give the tokens of the corpus."""
    from obspark.functions.text import tokens

    rows = [("a\n1", "Straße straße ÉTÉ été x1_y2", "٣ abc-abc"), ("b%0A", None, ""), ("%", "b b", "..A..a"), ("c%25", "b" * 70000 + " b", "日本語 日本 x")]
    records = spark.createDataFrame(rows, SCHEMA)
    store = text_store.create(records.coalesce(1), str(tmp_path / "a"), CHANNELS)
    types = dict(store._blocks(store.deltas()[1][0], 0).dtypes)
    assert types["record_ids"] == types["places"] == "string"
    want = []
    for c in CHANNELS:
        for r in records.select("record_id", tokens(c).alias("t")).collect():
            want += [(c, w, r.record_id, tuple(i + 1 for i, x in enumerate(r.t) if x == w)) for w in set(r.t or [])]
    for _ in range(2):
        assert sorted((r.channel, r.term, r.record_id, tuple(r.positions)) for r in store.every_posting().collect()) == sorted(want)
        store.compact()
