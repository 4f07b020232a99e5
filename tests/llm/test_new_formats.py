"""Chat formatting and fill-in-the-middle against plain versions, exact round trips, and their edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import pyarrow as pa
import pytest

from obspark.llm import chat, middles, queries

TABLES = ("documents", "conversations")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["op12_chat_format", "op13_fill_in_middle"])
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    x = duck.execute(queries.ORACLE_SQL[name])
    assert df.columns == [d[0] for d in x.description]
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(x.fetchall())


# 12

SAYS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<\\s>", "<", "[", " ", "\n", "x", "é😀", "<\\\\/s>", "<</TURN>>", " </s>\n", "\n<</SYS>>\n"]


def random_turns(seed, rows):
    rng = random.Random(seed)
    said = lambda: "".join(rng.choices(SAYS, k=rng.randrange(9)))
    return [(rng.choice([None, 1, 2, 3, 9]), rng.choice([None, 0, 1, 2, 2, 5]), rng.choice([None, "user", "assistant", "assistant", "system", "tool", said()]), rng.choice([None, said(), said()])) for _ in range(rows)]


def plain_digests(rows):
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chat_round_trip(spark, seed):
    rows = random_turns(seed, 300)
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "conv_id long, turn long, role string, text string, part string, task double").repartition(3)
    for got in (chat.read_back(df), chat.digests(chat.format_conversations(df))):
        assert {r[0]: tuple(r[1:5]) for r in got.collect()} == plain_digests(rows)


def test_formatted_texts_hold_no_foreign_marks():
    rows = random_turns(7, 500)
    done = chat.assemble(pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()))
    raw = bytes(memoryview(done.buffer))
    for k, (_, _, role, text) in enumerate(rows):
        one = raw[done.turn_at[k] : done.turn_at[k + 1]].decode()
        content = raw[done.text_at[k] : done.text_at[k] + done.text_size[k]].decode()
        assert not any(m in content for m in chat.MARKS) and chat.unescape(content) == (text or "")
        assert list(chat.read_turns(one)) == [(role or "", text or "")]


def test_scatter_in_stretches(monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 5)
    texts = ["", "a", "bcd", "e" * 30, "", "fg", "hijklm", "n"]
    done = chat.assemble(pa.array(["user"] * len(texts)), pa.array(texts))
    assert bytes(memoryview(done.buffer)).decode() == "".join(f"[INST] {t} [/INST]\n" for t in texts)


def test_long_conversation_in_parts(spark):
    """A conversation that no task holds whole, with turns longer than a part."""
    rows = [(5, i, ("user", "assistant")[i % 2], f"{i} </s> " * (1 + 200_000 * (i == 7))) for i in range(400)] + [(6, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    parts = chat.format_conversations(df)
    assert parts.filter("conv_id = 5").count() > 1
    assert {r[0]: tuple(r[1:5]) for r in chat.read_back(df).collect()} == plain_digests(rows)


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(empty).collect() == [] and chat.format_conversations(empty).collect() == []
    (only,) = chat.read_back(chat.with_marked(empty, -1, "</s>[INST] ok [/INST]")).collect()
    assert (only.conv_id, only.n_turns, only.loss_chars, only.loss_sha256) == (-1, 2, 21, sha("</s>[INST] ok [/INST]"))


# 4


def test_packing_of_repeated_turns(spark):
    """Rows of one turn with different roles keep their own loss; extra columns and an empty table do no harm."""
    import public_tokenizers

    from obspark.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, 0, "user", "one two three", 5), (1, 0, "assistant", "one two three", 6), (1, 0, "user", "one two three", 7), (None, None, None, None, 8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, doc_id int")
    got = packing.pack_turns(df, path).collect()
    assert collections.Counter((r.conv_id, r.bears) for r in got) == {(1, False): 2, (1, True): 1, (None, False): 1}
    assert all((r.loss_tokens > 0) == r.bears for r in got if r.length > 1)
    assert packing.pack_turns(df.limit(0), path).collect() == []


# 13


def plain_middle(doc_id, text, pattern=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(pattern, text)
    n, h = len(units), sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text:
        return n, "plain", None, None, text
    if h[3] % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_middles_against_a_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "a", "x" * 100_000 + "\n" + "é" * 9] + ["".join(rng.choices(["\n", "a", "😀", "<P", ">", "<S>", "<", "S>", " ", "\r"], [4, 4, 2, 1, 1, 0.2, 2, 2, 2, 1], k=rng.randrange(40))) for _ in range(300)]
    rows = [(None if i == 9 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 5, "y") for r in rows], "doc_id long, text string, n int, output string")
    got = middles.restore(middles.fill_in_middle(df)).collect()
    want = [(i, *plain_middle(i, t), t or "") for i, t in rows]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middles.fill_in_middle(df.limit(0)).collect() == []


@pytest.mark.parametrize("unit, pattern", [("word", r"^\s+|\S+\s*"), ("char", r"[\s\S]")])
def test_other_units(unit, pattern):
    rng = random.Random(5)
    plan = middles.Plan(unit=unit)
    for i in range(200):
        t = "".join(rng.choices(["a", "b", " ", "\n", "é", "\t"], k=rng.randrange(1, 30)))
        got = middles.rearranged(i, t, plan)
        assert got == plain_middle(i, t, pattern) and middles.restored(got[4], got[1]) == t


def test_rates():
    assert all(middles.rearranged(i, "a\nb\n", middles.Plan(rate=0))[1] == "plain" for i in range(50))
    forms = collections.Counter(middles.rearranged(i, "a\nb\n", middles.Plan(rate=40, suffix_first=25))[1] for i in range(2000))
    assert 0.35 < 1 - forms["plain"] / 2000 < 0.45 and 0.2 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.3
