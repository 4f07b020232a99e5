"""Cover density and similarity against brute force over random texts."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from obspark.operators import cover_density as cd

QUERIES = ["a", "a b", '"a b"', 'a or b c', '"a b" or c', 'a "b a" or "c c" -d', "a b c -e", "-a", "or a or or b", 'b or "a b"', "", "a-b c", 'x "unended quote']


def holds(clause, words):
    n = len(clause.words)
    return any(tuple(words[i : i + n]) == clause.words for i in range(len(words) - n + 1))


def satisfied(groups, words, whole):
    """Some alternative: its clauses in the stretch, what it excludes nowhere in the text."""
    return any(any(not c.excluded for c in g) and all(not holds(c, whole) if c.excluded else holds(c, words) for c in g) for g in groups)


def plain_density(groups, words):
    sought, total = set(cd.words_of(groups)), 0.0
    for i, j in itertools.combinations_with_replacement(range(len(words)), 2):
        if satisfied(groups, words[i : j + 1], words) and not satisfied(groups, words[i + 1 : j + 1], words) and not satisfied(groups, words[i:j], words):
            noise = (j - i) - (sum(w in sought for w in words[i : j + 1]) - 1)
            total += 0.1 / (1 + noise)
    return total


def grams(text):
    return {p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)}


def alike(x, y):
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [None, "", "a", "A, b! a"] + [" ".join(rng.choices("abcde", k=rng.randrange(12))) + rng.choice(["", " filler", " Äb"]) for _ in range(80)]


@pytest.mark.parametrize("query", QUERIES)
def test_cover_density(spark, texts, query):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").coalesce(1)
    got = {r.id: r for r in cd.text_relevance(df, "t", query).collect()}
    groups = cd.parse(query)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\W_]+", (t or "").lower())
        match = any(all(holds(c, words) != c.excluded for c in g) for g in groups)
        similar = alike(grams(t or ""), grams(query))
        assert (i in got) == (match or similar >= 0.3), (t, query)
        if i in got:
            assert got[i].cover_density == pytest.approx(plain_density(groups, words)), (t, query)
            assert got[i].similarity == pytest.approx(similar) and got[i].relevance == pytest.approx(got[i].cover_density + 0.05 * similar)


def test_parse():
    assert cd.parse('A "b c" -d OR -"e f" x_y') == [[cd.Clause(("a",)), cd.Clause(("b", "c")), cd.Clause(("d",), True)], [cd.Clause(("e", "f"), True), cd.Clause(("x", "y"))]]
    assert cd.parse(" or - ! ") == []


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_similar_texts(spark, least):
    rng = random.Random(9)
    rows = [(i, None if i == 3 else "".join(rng.choices("abc ", k=rng.randrange(10)))) for i in range(150)]
    asked = [(i, "".join(rng.choices("abcz ", k=rng.randrange(9)))) for i in range(25)]
    df = cd.similar_texts(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "query_id long, query string"), least)
    want = {(q, i): alike(grams(t or ""), grams(x)) for (i, t), (q, x) in itertools.product(rows, asked) if grams(x) and alike(grams(t or ""), grams(x)) >= least - 1e-12}
    assert {(r.query_id, r.id): pytest.approx(r.similarity) for r in df.collect()} == want
    assert "Cartesian" not in df._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_similarity_of_equal_texts(spark):
    df = spark.range(1).select(cd._shared(cd.word_trigrams(cd.text_words(F.lit("Big Gear"))), cd.word_trigrams(cd.text_words(F.lit("big gear")))).alias("s"))
    assert df.first().s == 1.0


def test_similar_texts_of_several_blocks(spark, monkeypatch):
    """Many texts of one trigram set, letters beyond 16 bits, equal and null ids: no row is sent for a pair before it is found alike."""
    monkeypatch.setattr(cd, "BLOCK", 50)
    monkeypatch.setattr(cd, "TALL", 7)
    monkeypatch.setattr(cd, "WIDE", 5)
    words = ["steel", "brass", "\U00020000\U00020001x", "\u00e9t\u00e9", "gear"]
    rows = [(i if i % 9 else None, f"{words[i % 5]} {words[i // 5 % 5]}") for i in range(260)]
    asked = [(f"q{i}", f"{words[i % 5]} {words[(i + i // 5) % 5]} ring") for i in range(110)]
    df = cd.similar_texts(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "query_id string, query string"))
    want = [(q, i, alike(grams(t), grams(x))) for (i, t), (q, x) in itertools.product(rows, asked) if alike(grams(t), grams(x)) >= 0.3]
    key = lambda r: (r[0], r[1] is None, r[1] or 0, r[2])
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key) and len(want) > 1000
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ids", [1 << 20, 40])
def test_similar_texts_of_copied_queries(spark, monkeypatch, ids):
    """Copies of a query are sent and compared once, and all of their ids, null ones too, come out; no text is sent again for them."""
    monkeypatch.setattr(cd, "BLOCK", 50)
    monkeypatch.setattr(cd, "IDS", ids)
    monkeypatch.setattr(cd, "HANDED", 30)
    words = ["steel", "brass", "gear", "ring"]
    rows = [(i, None if i == 7 else f"{words[i % 4]} {words[i // 4 % 4]} {i}") for i in range(200)]
    asked = [(i if i % 9 else None, ["steel ring", "Ring, steel", "gear", "brass gear", "!"][i % 5]) for i in range(300)]
    texts, queries = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    sent = cd._dealt(texts, queries)
    if ids > 300:
        assert sent.filter("query_ids IS NULL").count() == 199 and sent.filter("query_ids IS NOT NULL").count() == 3 * 4
    assert sent.selectExpr("sum(size(query_ids))").first()[0] == 240 * 4
    want = [(q, i, round(alike(grams(t or ""), grams(x)), 3)) for (i, t), (q, x) in itertools.product(rows, asked) if alike(grams(t or ""), grams(x)) >= 0.3]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, cd.similar_texts(texts, queries, digits=3).collect()), key=key) == sorted(want, key=key) and len(want) > 1000
