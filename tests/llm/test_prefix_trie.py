"""The prefix trie of conversations against a dictionary of all prefixes, over many ranges, and its edge cases."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest

from obspark.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_rebuilt(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        base, h = c - c % 5, zlib.crc32(str(c).encode()) % 9
        out[c] = turns if base == c else own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = collections.defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    return sorted((m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(map(str, ends[n])))) for n, m in members.items())


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def random_rows(seed, convs, deep):
    """Few different turns, so that many prefixes are shared; some conversations are copies or prefixes of others."""
    rng = random.Random(seed)
    rows, known = [], [[]]
    for c in range(convs):
        turns = list(rng.choice(known))
        if rng.random() < 0.7:
            turns = turns[: rng.randrange(len(turns) + 1)] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 3])) for _ in range(rng.randrange(1, deep))]
        known.append(turns)
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed, convs, deep, rows", [(1, 60, 4, 4), (2, 120, 3, 7), (3, 80, 9, 1000), (4, 40, 2, 1)])
def test_against_all_prefixes(spark, seed, convs, deep, rows):
    data = random_rows(seed, convs, deep)
    df = spark.createDataFrame([(*r, "x", 1) for r in data], f"{SCHEMA}, c string, depth int").repartition(3)
    assert got(prefix_trie.prefix_trie(df, rows)) == plain_trie(plain_rebuilt(data))


def test_long_conversations(spark):
    """Long ones that differ late, copies of them over several ranges, one that is the beginning of another, and one long one alone."""
    a = [("user", f"t{i % 7}") for i in range(300)]
    convs = {0: a, 5: a, 10: a[:64], 15: a[:200] + [("user", "z")], 20: a[:65], 25: [("user", f"u{i}") for i in range(500)], 30: a + [("assistant", "q")] * 100, 35: a[:128]}
    convs |= {40 + 5 * i: a for i in range(9)} | {100: [], 105: a[:130] + [("user", "y")] * 3}
    rows = [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(prefix_trie.prefix_trie(df, 3)) == plain_trie({c: t for c, t in convs.items() if t})


def test_one_block_that_a_longer_one_begins_with(spark):
    a = [("user", f"t{i}") for i in range(90)]
    convs = {0: a, 5: a[:64], 10: a[:64], 15: a, 20: [("user", "x")]}
    rows = [(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), 1)) == plain_trie(convs)


def test_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    rows = [(c, i, "user", "same") for c in range(0, 400, 5) for i in range(2)] + [(1000, 0, "user", "same")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefix_trie.prefix_trie(df, 11)) == plain_trie(plain_rebuilt(rows))


def test_edge_cases(spark):
    rows = [(None, 0, "user", "x"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, "assistant", ""), (3, 0, "user", "b"), (7, 5, "user", "c"), (-3, 0, "user", "a"), (-4, 2, "user", "z" * 100_000), (12, 0, "user", "no base"), (4, 0, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_rebuilt([r for r in rows if (r[0] or 0) >= 0])
    assert got(prefix_trie.prefix_trie(df.filter("conv_id is null or conv_id >= 0"))) == plain_trie(want)
    assert any(not t for t in want.values())  # a turnless one
    everything = prefix_trie.prefix_trie(df).collect()
    assert max(r.n_convs for r in everything) == 7 and sum(r.parent_conv_id is None for r in everything) == 1
    assert prefix_trie.prefix_trie(df.limit(0)).collect() == [] and prefix_trie.prefix_trie(df.filter("conv_id is null")).collect() == []
    (only,) = prefix_trie.prefix_trie(spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)).collect()
    assert tuple(only) == (1, 0, None, 1, 0, 1, 0, sha("1"))  # the first turns come from a conversation that isn't there


def test_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    df = queries.QUERIES["op11_prefix_trie"](spark, sf)
    x = duck.execute(queries.ORACLE_SQL["op11_prefix_trie"])
    assert df.columns == [d[0] for d in x.description]
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(x.fetchall())
