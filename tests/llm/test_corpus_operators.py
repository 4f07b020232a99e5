"""The corpus operators against brute force, exact round trips or held-out accuracy, and their edge cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from obspark.llm import audio, bpe, common, convnet, fingerprints, html, jaccard, packing, queries, sharding, suffixes

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
EDGE = [
    (1, "the cat sat on the mat and the dog ran away " * 20), (2, None), (3, ""), (4, " \t\n "), (5, "the cat sat on the mat and the dog ran away " * 20), (5, "the cat sat on the mat and the dog ran away " * 20), (6, "one"), (None, "no id but some text here " * 30), (7, LONG), (8, "éß漢字 😀 <|endoftext|> x  y   z\n\n q"), (9, "a" * 3000), (9, "b" * 900),
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.documents(spark, sf)


@pytest.fixture(scope="module")
def pandas_docs(docs):
    return docs.toPandas().sort_values("doc_id")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", 1.5, [1]) for i, t in EDGE], "doc_id long, text string, score string, node double, component_id array<int>")


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.limit(0)


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# 1 and 3


def test_quality_and_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    q = queries.QUERIES["op1_quality"](spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.95 and q.score.between(0, 1).all()
    lang = queries.QUERIES["op3_language"](spark, sf).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (lang.lang_pred == lang.lang).mean() > 0.95 and lang.score.between(0, 1).all()


def test_networks_edge_cases(edge, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, None), (99, 1)], "doc_id long, quality int")
    model = convnet.fit_quality(edge, labels)
    out = convnet.score_quality(edge, model).toPandas()
    assert len(out) == len(EDGE) and out.score.between(0, 1).all()
    assert convnet.score_quality(nothing, convnet.fit_quality(nothing, labels)).count() == 0
    lang = convnet.predict_language(edge, convnet.fit_language(edge.withColumn("lang", F.lit("en")))).toPandas()
    assert set(lang[lang.doc_id.isin([2, 3, 4])].lang_pred) == {"und"} and set(lang[lang.doc_id == 1].lang_pred) == {"en"}
    none = convnet.fit_language(edge.withColumn("lang", F.lit(None).cast("string")))
    assert set(convnet.predict_language(edge, none).toPandas().lang_pred) == {"und"}


def test_networks_against_plain_ones():
    """Both networks against loops over every byte, filter and window."""
    texts = [t for _, t in EDGE if t is None or len(t) < 2000] + ["x", "ab c"]
    q = convnet.Quality(3)
    taps, f = q.w["taps"], convnet.QUALITY_FILTERS
    for t in texts:
        x = list((t or "").encode())
        x += [convnet.PAD] * (-len(x) % convnet.STRIDE + convnet.STRIDE)
        best = np.zeros(f)
        for a in range(0, len(x) - convnet.STRIDE, convnet.STRIDE):  # chunks of two strides
            r = q.w["bias"] + sum(taps[j, x[a + j], :f] for j in range(convnet.STRIDE)) + sum(taps[j, x[a + convnet.STRIDE + j], f:] for j in range(convnet.STRIDE))
            best = np.maximum(best, r)
        assert abs(q.scores([t])[0] - 1 / (1 + np.exp(-(best @ q.w["out"] + q.w["base"][0])))) < 1e-5
    m = convnet.Language(["a", "b", "c"])
    widths = [w for w in sorted(convnet.LANGUAGE_WIDTHS, reverse=True) for _ in range(convnet.LANGUAGE_FILTERS)]
    for t in texts:
        x, total, size = (t or "").encode(), np.zeros(3), 0
        for a in range(0, max(1, len(x)), convnet.WINDOW):
            part = list(x[a : a + convnet.WINDOW])
            weight = max(1, len(part))
            part += [convnet.PAD] * (convnet.WINDOW - len(part))
            top = [max(sum(m.w["taps"][j, part[i + j], k] for j in range(w)) for i in range(convnet.WINDOW - max(convnet.LANGUAGE_WIDTHS) + 1)) for k, w in enumerate(widths)]
            z = np.maximum(np.array(top) + m.w["bias"], 0) @ m.w["out"] + m.w["base"]
            total += weight * (z - np.log(np.exp(z).sum()))
            size += weight
        p = np.exp(total / size)
        name, score = m.predict([t])
        known = bool(t and any(c.isalpha() for c in t))
        assert name == (["abc"[int(p.argmax())]] if known else ["und"]) and abs(score[0] - (p.max() / p.sum() if known else 0)) < 1e-4


def test_held_out_rows(edge):
    got = {r["doc_id"]: r["held_out"] for r in edge.select("doc_id", convnet.held_out(3, 1)).collect()}
    assert got[None] is False and all(v == (zlib.crc32(str(i).encode()) % 3 == 1) for i, v in got.items() if i is not None)


def test_chunks_do_not_depend_on_the_batch():
    texts = [t for _, t in EDGE]
    model = convnet.Quality()
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-6)


# 2


def brute_components(pairs, words, percent):
    sets = {i: set(jaccard.token_set(t, words).tolist()) for i, t in pairs}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(docs, pandas_docs, words, percent):
    some = docs.filter("doc_id < 120")
    expected = brute_components([(r.doc_id, r.text) for r in pandas_docs.itertuples() if r.doc_id < 120], words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(some, words, percent).collect()}
    assert got == expected


@pytest.mark.parametrize("split", [jaccard.SPLIT, 20])
def test_jaccard_large_group(spark, monkeypatch, split):
    """Near copies that share every list, in several components, in one tree and dealt to several."""
    monkeypatch.setattr(jaccard, "SPLIT", split)
    rng = random.Random(4)
    base = [f"t{i}" for i in range(60)]
    pairs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            w[rng.randrange(60)] = f"n{rng.randrange(10_000)}"
        pairs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string"), 2, 85).collect()}
    assert got == brute_components(pairs, 2, 85)


@pytest.mark.parametrize("rows, together", [(7, 10), (3, 1), (50, 60)])
def test_jaccard_lists_in_pieces(spark, monkeypatch, rows, together):
    """Lists that no task looks at as a whole, of copies and near copies, give the same components."""
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    rng = random.Random(6)
    base = [f"t{i}" for i in range(40)]
    pairs = []
    for i in range(90):
        w = list(base) if i % 3 else [f"s{k}" for k in range(40)]
        for _ in range(rng.choice([0, 0, 1, 2, 7])):
            w[rng.randrange(40)] = f"n{rng.randrange(10_000)}"
        pairs.append((i, " ".join(w)))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        table = spark.createDataFrame(pairs, "doc_id long, text string").repartition(8)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table, 2, 85).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_components(pairs, 2, 85)


def test_jaccard_edge_cases(edge, nothing):
    got = [tuple(r) for r in jaccard.jaccard_components(edge).collect()]
    assert len(got) == len(EDGE)
    by = collections.defaultdict(set)
    for i, n, c in got:
        by[i].add((n, c))
    assert by[1] == {(11, 1)} and by[5] == {(11, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[6] == {(1, 6)}
    assert jaccard.jaccard_components(nothing).count() == 0


def test_jaccard_repeated_and_missing_ids(spark):
    """Rows that share an id, or have none, are told apart by their texts."""
    near = " ".join(f"a{i}" for i in range(60))
    rows = [(1, near), (1, "quite another text with some words"), (None, near + " z"), (7, near + " z y")]
    got = sorted((r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 1), (57, 1), (58, 1), (59, 1)]


def test_one_of_each(spark, edge, nothing):
    """One row of each group, with all columns, whatever these are called; repeated rows are one, rows without words stay."""
    near = " ".join(f"a{i}" for i in range(60))
    rows = [(3, near, "x", 1, 2, [1]), (1, near + " z", "y", 1, 2, None), (1, near + " z", "w", 1, 2, None), (1, "quite another text with some words", "x", 1, 2, [2]), (None, near + " z y", "x", 1, 2, []), (None, "no id at all in this row", "v", 0, 0, []), (8, None, "x", 1, 2, []), (8, None, "x", 1, 2, []), (9, "", "x", 1, 2, [])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int, component int, whole array<int>")
    out = jaccard.one_of_each(table).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == sorted([(1, near + " z"), (1, "quite another text with some words"), (0, "no id at all in this row"), (8, ""), (9, "")])
    assert jaccard.one_of_each(table).columns == table.columns and {r["lang"] for r in out if r["doc_id"] == 1} <= {"x", "y", "w"}
    assert jaccard.one_of_each(table.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            parent[top(a)] = top(b)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert set(got) == set(parent)
    assert len({(top(i), c) for i, c in got.items()}) == len({top(i) for i in parent}) == len(set(got.values()))


def test_tree_loses_nothing():
    rng = np.random.default_rng(0)
    points = rng.poisson(3, (700, jaccard.GROUPS)).astype(np.uint8)
    points[100:200] = points[0] + rng.integers(0, 2, (100, jaccard.GROUPS)).astype(np.uint8)
    sizes = points.sum(1).astype(np.int64)
    q, p = jaccard.RTree(points, sizes).search(points, sizes, 85)
    got = set(zip(q.tolist(), p.tolist(), strict=True))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(700), np.arange(700), indexing="ij"))
    near = 100 * np.minimum(sizes[a], sizes[b]) >= 85 * np.maximum(sizes[a], sizes[b])
    ok = near & (np.minimum(points[a], points[b]).sum(axis=1) >= jaccard.needed(sizes[a], sizes[b], 85))
    assert set(zip(a[ok].tolist(), b[ok].tolist(), strict=True)) <= got


# 4


def check_packing(rows, texts, length=1024, segments=packing.SEGMENTS):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BYTE)
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for doc, text in texts:
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        at = 0
        for r in sorted(by[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert 4 * at == len(ids)
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length and len(pieces) <= segments
    return seq


def test_packing(docs, pandas_docs, edge, nothing):
    rows = packing.pack(docs, BYTE).collect()
    seq = check_packing(rows, [(r.doc_id, r.text) for r in pandas_docs.itertuples()])
    assert sum(r["length"] for r in rows) > 0.99 * 1024 * (len(seq) - 2)
    single = [(i, t) for i, t in EDGE if i not in (None, 5, 9)]
    rows = packing.pack(edge, BYTE).collect()
    check_packing(rows, single)
    assert sum(r["start"] == 0 for r in rows) == len(EDGE)
    assert packing.pack(nothing, BYTE).count() == 0


def test_packing_limits():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 300, 400)
    demand = np.stack([n, np.ones_like(n), np.minimum(n, rng.integers(0, 200, 400))], 1)
    limits = np.array([1024.0, 6, 500])
    placed, _ = packing.place(demand, limits, [], False)
    used = collections.defaultdict(lambda: np.zeros(3))
    for i, first, size, box in placed:
        assert first == 0 and size == n[i]
        used[id(box)] += demand[i]
    assert sorted(p[0] for p in placed) == list(range(400)) and all((u <= limits).all() for u in used.values())


def test_packing_turns(spark, sf):
    """Instruction data: each of the three limits stops some sequence, and none is passed."""
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = packing.pack_turns(talks, BYTE, 1024, 8, 512).collect()
    by, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
        pieces[r["conv_id"], r["turn"]].append(r)
        assert r["loss_tokens"] == (r["length"] - 1 if r["bears"] else 0)
    assert set(pieces) == {(r["conv_id"], r["turn"]) for r in talks.collect()}
    for p in pieces.values():
        at = 0
        for r in sorted(p, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == p[0]["doc_tokens"]
    full = [(sum(r["length"] for r in s), len(s), sum(r["loss_tokens"] for r in s)) for s in by.values()]
    assert all(t <= 1024 and n <= 8 and loss <= 512 for t, n, loss in full)
    assert any(t == 1024 for t, _, _ in full) and any(n == 8 and t < 1024 for t, n, _ in full) and any(loss >= 511 and t < 1024 for t, _, loss in full)


# 5


def test_fingerprints(docs, pandas_docs):
    texts = pandas_docs.text.tolist()
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(zip(pandas_docs.doc_id, texts, strict=True)):
        following = texts[(k + 1) % len(texts)]
        edited = fingerprints.edit(t, following)
        a, b, c = map(fingerprints.signature, (t, edited, following))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), sha(edited), fingerprints.hexed(a), fingerprints.hexed(b))
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))


def test_fingerprints_many_buckets(docs, monkeypatch):
    few = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    deal = common.range_buckets
    monkeypatch.setattr(common, "range_buckets", lambda rows, **k: deal(rows, rows_per_bucket=7, **k))
    assert {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()} == few


def test_fingerprints_edge_cases(edge, nothing):
    out = fingerprints.fingerprint_edits(edge).toPandas()
    assert len(out) == len(EDGE) and out[out.doc_id == 1].fingerprint.iloc[0] == out[out.doc_id == 5].fingerprint.iloc[0]
    assert fingerprints.fingerprint_edits(nothing).count() == 0
    assert fingerprints.fingerprint_edits(edge.filter("doc_id = 6")).first()["near_next"] == 1.0


def test_minhash_estimates():
    a = " ".join(f"w{i}" for i in range(1000))
    b = " ".join(f"w{i}" for i in range(200, 1200))
    s, t = (set(common.shingles(x, 5).tolist()) for x in (a, b))
    assert abs(fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(b)) - len(s & t) / len(s | t)) < 0.15


def test_band_join(docs, pandas_docs):
    got = {(r["a"], r["b"]): r["jaccard"] for r in fingerprints.near_duplicates(docs).collect()}
    copies = pandas_docs.groupby("text").doc_id.apply(list)
    assert all((min(c), x) in got for c in copies if len(c) > 1 for x in c if x != min(c))
    assert min(got.values()) >= 0.8


@pytest.mark.parametrize("block", [500, 7])
def test_band_join_family(spark, monkeypatch, block):
    """Texts around a common passage: every pair that shares a band is linked or refuted, whatever the least id is."""
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    passage = [f"p{i}" for i in range(200)]
    own = lambda k, n: [f"o{k}x{i}" for i in range(n)]
    texts = {k: " ".join(passage + own(k, 40)) for k in range(40)}
    texts |= {100 + k: " ".join(passage + own(100 + k, 20)) for k in range(20)}
    sets = {k: set(common.shingles(t, 5).tolist()) for k, t in texts.items()}
    keys = {k: {(j, fingerprints.signature(t)[j * 4 : j * 4 + 4].tobytes()) for j in range(32)} for k, t in texts.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b) for a in texts for b in texts if a < b and keys[a] & keys[b] and like(a, b) >= 0.8}
    assert len(want) > 100 and min(a for a, _ in want) >= 100  # no link to the lower ids, which hold the bands' least
    got = fingerprints.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert all(abs(r["jaccard"] - like(r["a"], r["b"])) < 1e-12 for r in got)


def test_band_classes(spark, docs, pandas_docs, edge, nothing):
    """Classes are the components of the links, found without all pairs of a family; recall of pairs against brute force."""
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_classes(docs).collect()}
    sets = {r.doc_id: set(common.shingles(r.text, 5).tolist()) for r in pandas_docs.itertuples()}
    like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    ids = sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and like(a, b) >= 0.8]
    assert near and sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    links = {(r["a"], r["b"]) for r in fingerprints.near_duplicates(docs).collect()}
    assert all(like(a, b) >= 0.8 for a, b in links) and all(got[a] == got[b] for a, b in links)
    parts = collections.defaultdict(set)
    for a, b in links:
        parts[a].add(b)
        parts[b].add(a)
    for i in ids:  # nothing but links joins a class
        seen, todo = {i}, [i]
        while todo:
            for j in parts[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert {j for j in ids if got[j] == got[i]} == seen and got[i] == min(seen)
    out = fingerprints.near_classes(edge).toPandas()
    assert len(out) == len(EDGE) and set(out[out.doc_id.isin([1, 5])].class_id) == {1} and set(out[out.doc_id.isin([2, 3, 4])].links) == {0}
    assert fingerprints.near_classes(nothing).count() == 0


def test_band_classes_of_a_family(spark):
    """Near copies share every band: pairs grow with the members, not with their square, and texts of several components stay apart."""
    base = [f"t{i}" for i in range(300)]
    texts = [" ".join(w if k != j else f"n{k}" for j, w in enumerate(base)) for k in range(120)] + [" ".join(base[:200] + [f"z{k}x{i}" for i in range(100)]) for k in range(6)]
    out = fingerprints.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["class_id"] for r in out if r["doc_id"] < 120} == {0} and [r["class_id"] for r in sorted(out, key=lambda r: r["doc_id"]) if r["doc_id"] >= 120] == list(range(120, 126))
    assert sum(r["links"] for r in out) < 120 * 20


# 6


def test_bpe_matches_the_library(pandas_docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(WORD)
    tk.no_truncation()
    tk.no_padding()
    c = bpe.codec(WORD)
    more = ["", "  ", "a\x1cb", "<|endoftext|> hi<|startoftext|>", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ", "don't we'll 123 4½ ①", "éa x y​z", "日本語 😀👍🏽", "a\x85b\x1fc", LONG[:5000]]
    for t in [*pandas_docs.text, *more]:
        ids = tk.encode(t, add_special_tokens=False).ids
        assert c.digest(t) == (len(ids), " ".join(map(str, ids)), tk.decode(ids, skip_special_tokens=False))
        assert c.encode(t) == ids


def test_bpe_edge_cases(edge, nothing):
    out = bpe.encode_decode(edge, WORD).toPandas()
    assert len(out) == len(EDGE) and set(out[out.doc_id.isin([2, 3, 4])].n_tokens) == {0} and out[out.doc_id == 2].ids_sha256.iloc[0] == sha("")
    assert bpe.encode_decode(nothing, WORD).count() == 0


def test_bpe_over_all_code_points():
    """Between letters and between digits, every code point splits as the library does it."""
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(WORD), bpe.codec(WORD)
    texts = [f"a{chr(c)}b 1{chr(c)}2" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 100_000):
        part = texts[at : at + 100_000]
        for text, e in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            assert own.encode(text) == e.ids


# 7


def check_shards(out, n, shards):
    sizes = collections.Counter(r["shard"] for r in out)
    assert len(out) == n and max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, k in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(k))


def test_sharding(spark, sf, pandas_docs):
    out = queries.QUERIES["op7_sharding"](spark, sf).collect()
    check_shards(out, len(pandas_docs), 24)
    text = dict(zip(pandas_docs.doc_id, pandas_docs.text, strict=True))
    groups = collections.defaultdict(set)
    for r in out:
        groups[text[r["doc_id"]]].add(r["shard"])
        assert r["size"] == len(text[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert sum(len(g) > 1 for g in groups.values()) <= 1


def test_sharding_hot_group(spark):
    """A third of all rows is one group: it spreads over few shards, sizes stay even."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 50}" if i % 3 == 1 else None) for i in range(600)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "id long, hub string"), 6).collect()
    check_shards(out, 600, 6)
    hot = collections.Counter(r["shard"] for r in out if r["hub"] == "hot")
    assert sum(sorted(hot.values())[-2:]) >= 150


def test_sharding_hot_third(spark):
    """A third of all rows over 24 shards, which eight shards hold; the groups beside it stay whole."""
    rows = [(i, "hot" if i % 3 == 0 else f"p{i // 6}.{i % 3}" if i % 3 == 1 else None) for i in range(9600)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "id long, hub string"), 24).collect()
    check_shards(out, 9600, 24)
    groups = collections.defaultdict(set)
    for r in out:
        groups[r["hub"]].add(r["shard"])
    assert len(groups.pop("hot")) == 8
    groups.pop(None)
    assert len(groups) == 1600 and all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize("members, linked", [(2, 0.99), (2, 1), (10, 0.9), (10, 1), (7, 1)])
def test_sharding_nearly_all_copies(spark, members, linked):
    """With hardly a row that could fill up, groups stay whole; without one, as many as exact counts allow."""
    n = 24_000
    rows = [(i * 7919, f"g{i // members}" if i < n * linked else None) for i in range(n)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "id long, hub string"), 24).collect()
    check_shards(out, n, 24)
    groups = collections.defaultdict(set)
    for r in out:
        groups[r["hub"]].add(r["shard"])
    groups.pop(None, None)
    assert sum(len(g) > 1 for g in groups.values()) <= (0 if linked < 1 or n // 24 % members == 0 else 23)


def test_propagation_falls_round_by_round(spark):
    """On a given table the cut falls in every round but the last, by at least two rounds of moves."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    rows = docs.select(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("node"), sharding.line_hubs(F.col("text")).alias("hubs"))
    links = rows.select("node", F.explode("hubs").alias("hub")).distinct()
    total = rows.count()
    labels, pieces, large, room, found = sharding.placed(rows.drop("hubs"), links, [total // 24 + (s < total % 24) for s in range(24)])
    assert len(found.cuts) > 2 and all(x > y for x, y in zip(found.cuts, found.cuts[1:], strict=False))
    assert min(room) >= 0 and labels.agg(F.sum("n")).first()[0] + sum(p[2] - p[1] for p in pieces + large) + sum(room) == total


def plain_propagation(links, labels, room):
    """One node after the other, round after round, to the shard where most of its neighbours are, while there is room."""
    of, labels, room = collections.defaultdict(list), dict(labels), list(room)
    for node, hub in links:
        of[hub].append(node)
    hubs_of = collections.defaultdict(list)
    for node, hub in links:
        hubs_of[node].append(hub)

    def cut():
        return sum(len(m) - sum(c * c for c in collections.Counter(labels[x] for x in m).values()) / len(m) for m in of.values())

    least = cut()
    while True:
        for node in sorted(labels):
            votes = collections.Counter()
            for hub in hubs_of[node]:
                for x in of[hub]:
                    votes[labels[x]] += 1 / len(of[hub])
            to = max((s for s in range(len(room)) if s == labels[node] or room[s]), key=lambda s: (votes[s], s == labels[node]))
            room[labels[node]] += 1
            room[to] -= 1
            labels[node] = to
        if cut() >= least - 1e-9:
            return least
        least = cut()


@pytest.mark.parametrize("seed, spare", [(1, 4), (2, 0), (3, 10)])
def test_propagation_against_a_plain_one(spark, seed, spare):
    """Four families of linked nodes in four shards, with and without rows that could fill up: the cut falls to a plain propagation's, or to about a third of the start's."""
    rng = random.Random(seed)
    links = [(f"n{f}.{i}", f * 100 + h) for f in range(4) for i in range(20) for h in rng.sample(range(6), 3)]
    target = [20 + spare] * 4
    nodes = sorted({x for x, _ in links})
    labels, _ = sharding.started(spark.createDataFrame([(x, 1, i) for i, x in enumerate(nodes)], "node string, n long, seed long"), room := list(target))
    labels = labels.cache()
    start = {r["node"]: r["shard"] for r in labels.collect()}
    plain = plain_propagation(links, start, list(room))
    found = sharding.propagate(spark.createDataFrame(links, "node string, hub long"), labels, room)
    assert found.cuts[-1] <= max(plain, 0.35 * found.cuts[0]) + 1e-6 and len(found.cuts) > 2
    sizes = collections.Counter(r["shard"] for r in found.labels.collect())
    assert all(sizes[s] <= target[s] and sizes[s] + room[s] == target[s] for s in range(4))


def test_sharding_empty_texts_stay_together(spark, tmp_path):
    rows = [(i, ("", None, f"text {i}", f"other {i}")[i % 4]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op7_sharding(spark, str(tmp_path)).collect()
    check_shards(out, 400, 24)
    assert len({r["shard"] for r in out if r["size"] == 8}) == 12  # 200 rows, shards of 16 or 17


def test_sharding_edge_cases(spark, edge):
    nodes = edge.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hub"), "score")
    check_shards(sharding.shard_rows(nodes, 4).collect(), len(EDGE), 4)
    clashing = nodes.selectExpr("*", "1 AS row", "'x' AS shard", "2 AS slot", "3 AS n", "4 AS to")
    out = sharding.shard_rows(clashing, 4)
    check_shards(out.collect(), len(EDGE), 4)
    assert {"row", "n", "to"} <= set(out.columns) and out.filter("row = 1 AND n = 3").count() == len(EDGE)
    assert sharding.shard_rows(nodes.limit(0), 4).count() == 0


# 8


def test_audio_round_trip():
    rng = random.Random(0)
    for n in (0, 1, 63, 64, 65, 121, 122, 1417, 1418, 5000, 100_001):
        raw = bytes(rng.randrange(256) for _ in range(n))
        payload = raw.ljust(max(64, -(-n // 64) * 64), b"\0")
        m = audio.store(payload)
        a = audio.parse(m)
        assert audio.restore(m, a) == payload and a.failed == a.skipped == 0 and a.checked == len(a.offsets) == a.table["frames"]
        assert a.samples == 1152 * len(a.offsets) and a.duration_us == len(a.offsets) * 36_000 and a.table["bytes"] == len(m) - m.index(b"\xff\xfb")


def test_audio_parses_damage_and_tags():
    m = audio.store(b"x" * 6000)
    a = audio.parse(m)
    cut = a.offsets[2]
    b = audio.parse(m[:cut] + b"\xff\xfbgarbage\xff" * 5 + m[cut:] + b"TAG" + b"Song".ljust(30, b"\0") + bytes(95))
    assert len(b.offsets) == len(a.offsets) and b.skipped == 50 and b.tags["title"] == "Song"
    bad = bytearray(m)
    bad[a.offsets[1] + 8] ^= 1
    assert audio.parse(bytes(bad)).failed == 1
    assert audio.parse(None).offsets == [] and audio.parse(b"no audio \xff\xff\xff here").kind == "none"
    layer1 = bytes((0xFF, 0xFF, 0x10 | 2 << 2, 0xC0))  # MPEG-1 Layer I, 32 kbit/s, 32 kHz
    assert audio.header(layer1).size == 48 and audio.header(layer1).samples == 384


def test_audio_query(edge, nothing, docs, pandas_docs):
    out = {r["doc_id"]: r for r in audio.digests(audio.store_texts(docs)).collect()}
    for r in pandas_docs.itertuples():
        p, n = audio.padded(r.text)
        got = out[r.doc_id]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (n, len(p), sha(p), zlib.crc32(p[-64:]))
    assert audio.digests(audio.store_texts(edge)).count() == len(EDGE)
    assert audio.digests(audio.store_texts(nothing)).count() == 0
    assert audio.read_audio(audio.store_texts(edge)).filter("failed > 0").count() == 0


# 9


def brute_removal(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r) - len(kept), int((np.diff(gone[: len(r)].astype(int), prepend=0) == 1).sum()), sha(kept)))
    return out


def removed(table, length):
    return collections.Counter((r["doc_id"], r["n_removed"], len(r["spans"]), sha(bytes(r["kept"]))) for r in suffixes.remove_repeats(table, length).collect())


@pytest.mark.parametrize("merged", [suffixes.MERGED, 1])
def test_suffix_dedup(docs, pandas_docs, monkeypatch, merged):
    monkeypatch.setattr(suffixes, "MERGED", merged)
    few = pandas_docs[pandas_docs.doc_id < 80]
    assert removed(docs.filter("doc_id < 80"), 400) == collections.Counter((i, *b) for i, b in zip(few.doc_id, brute_removal(few.text, 400), strict=True))


@pytest.mark.parametrize(("length", "merged"), [(400, suffixes.MERGED), (200, 1 << 14), (200, 1), (20, 1000)])
def test_suffix_dedup_common_passage(spark, monkeypatch, length, merged):
    """A passage that over a thousand texts hold in different surroundings, some of which are alike on one side."""
    monkeypatch.setattr(suffixes, "MERGED", merged)
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, sides = some(110), [some(6) for _ in range(5)]
    texts = [f"{some(20)} {rng.choice(sides)} {passage[: rng.choice([300, 450, 700])]} {rng.choice(sides)} {some(20)}" for _ in range(1200)] + [passage * 2, "", None]
    rows = list(enumerate(texts))
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length) == collections.Counter((i, *b) for i, b in zip(range(len(texts)), brute_removal(texts, length), strict=True))


def test_suffix_dedup_clashing_names(spark):
    text = "the cat sat on the mat and the dog ran away " * 20
    rows = [(1, text, 7, "s", 2, 13), (2, text, 8, None, 3, 13), (3, "alone", 9, "t", 4, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _row int, stretches string, row int, n_chars int")
    out = suffixes.without_repeats(table, 100).collect()
    assert [tuple(r) for r in out] == [rows[2]] and suffixes.without_repeats(table, 100).columns == table.columns
    assert suffixes.without_repeats(table.limit(0), 100).count() == 0


def test_suffix_dedup_edge_cases(edge, nothing):
    assert removed(edge, 40) == collections.Counter((i, *b) for (i, _), b in zip(EDGE, brute_removal([t for _, t in EDGE], 40), strict=True))
    assert suffixes.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("length", [400, 200, 20])
def test_merged_transforms(length):
    rng = random.Random(length)
    for trial in range(6):
        words = [bytes(rng.randrange(97, 103) for _ in range(rng.randrange(3, 30))) for _ in range(6)]
        parts = [b"".join(rng.choice(words) for _ in range(1000))[: rng.randrange(length, 2 * length)] for _ in range(rng.randrange(2, 90))]
        if trial % 2:
            parts += [b"x" * (2 * length), parts[0]]
        count = collections.Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        for p, hit in zip(parts, suffixes.repeated_windows(parts, length), strict=True):
            assert [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] == hit.tolist()


# 10


def article_of(page):
    """The text of the article element of the tables' pages."""
    import html as library
    import re

    body = page.split("<article>")[1].split("</article>")[0]
    blocks = [" ".join(library.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(b for b in blocks if b)


def test_html_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    for p in pages.collect():
        assert got[p["page_id"]]["text"] == article_of(p["html"]) and got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_html_templates_go_by_differencing(spark, sf):
    """The tables' pages without their marks, in a template that no markup tells from an article: only alignment can find it."""
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    host = lambda u: u.split("/")[2]
    frame = lambda u, body: f"<body><p>Start {host(u)}</p><p>All sections</p>{body}<p>Rights of {host(u)}</p><p>Imprint</p></body>"
    bare = lambda h: "<div>" + h.split("<article>")[1].split("</article>")[0] + "</div>"
    sites = collections.Counter(host(u) for _, u, _ in rows)
    table = spark.createDataFrame([(i, u, frame(u, bare(h))) for i, u, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(table).collect()}
    among = [(got[i], article_of(h)) for i, u, h in rows if sites[host(u)] > 1]
    assert len(among) > 20 and sum(a == b for a, b in among) >= 0.9 * len(among)
    alone = [(got[i], article_of(h)) for i, u, h in rows if sites[host(u)] == 1]
    assert all(a != b and b in a for a, b in alone)


def test_html_markup():
    page = '<body><header>Site</header><div class="cookie-notice">We use</div><main><header><h1>T</h1></header><p>a&nbsp; b<br>c &lt;d&gt; &#x27;<p>open<script>x("</p>")</script><div class=share>s</div><section id="comments"><article>hi</article></section></main><aside>r</aside><form><p>f</form>'
    told = lambda p, kinds: [x for x, k in html.lines_of(p) if k in kinds]
    assert told(page, [html.MARKED]) == ["T", "a b c <d> '", "open"] and told(page, [html.OUT]) == ["Site", "We use", "s", "hi", "r", "f"] and told(page, [html.PLAIN]) == []
    assert html.lines_of(None) == [] and html.lines_of("a < b") == [("a < b", html.PLAIN)]
    assert html.lines_of('<div class="ad">never closed<article><p>text</article>') == [("never closed", html.OUT), ("text", html.MARKED)]


def test_html_differencing(spark):
    page = lambda a: f"<div>Menu words</div><div>{a}</div><div>All rights</div>"
    both = "<article><p>the same story</p><p>{}</p></article>"
    rows = [(1, "http://h/a/1", page("first")), (2, "http://h/a/2", page("second")), (3, "http://other/x", page("alone")), (4, None, None), (5, "", ""), (2, "http://h/a/2", page("second"))]
    rows += [(6, "http://twice/1", page(both.format("one"))), (7, "http://twice/2", page(both.format("two"))), (8, "http://mixed/1", "<article><p>Menu words</p><p>story</p></article>"), (9, "http://mixed/2", page("plain"))]
    got = sorted((r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect())
    assert got == [(1, "first"), (2, "second"), (2, "second"), (3, "Menu words\n\nalone\n\nAll rights"), (4, ""), (5, ""), (6, "the same story\n\none"), (7, "the same story\n\ntwo"), (8, "story"), (9, "plain\n\nAll rights")]
    assert html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1000, 3])
def test_html_differencing_past_copies(spark, monkeypatch, bucket):
    """Copies, slightly different html and pages that hold all lines are no partners; equal html gives one text."""
    ranges = common.range_buckets
    monkeypatch.setattr(common, "range_buckets", lambda rows: ranges(rows, bucket))
    page = lambda *a, tag="div": "".join(f"<{tag}>{x}</{tag}>" for x in ("Menu words", *a, "All rights"))
    rows = [(i, f"http://h/a/{i:02d}", page("same")) for i in range(12)]
    rows += [(20, "http://h/a/20", page("same", tag="p")), (21, "http://h/a/21", page("other")), (22, "http://h/a/22", page())]
    rows += [(30, "http://lone/1", page("one")), (31, "http://lone/2", page("one"))]
    rows += [(40 + i, f"http://grow/{i:02d}", page(*(f"x{k}" for k in range(i + 1)))) for i in range(8)] + [(50, "http://grow/50", page("end"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in (*range(12), 20)} == {"same"} and got[21] == "other" and got[22] == "Menu words\n\nAll rights"
    assert got[30] == got[31] == "Menu words\n\none\n\nAll rights"
    assert [got[40 + i] for i in range(8)] == ["\n\n".join(f"x{k}" for k in range(i + 1)) for i in range(8)] and got[50] == "end"


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        got = html.matches(a, b)
        assert len(got) == t[-1][-1] and all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_shards_link_by_every_line(spark):
    """A line links texts wherever its hash stands among those of their other lines."""
    shared = [f"shared {k}" for k in range(30)]
    texts = [(k, "\n".join([shared[k // 2], *(f"own {k} {i}" for i in range(40))])) for k in range(60)]
    hubs = {r.id: set(r.hubs) for r in spark.createDataFrame(texts, "id long, text string").select("id", sharding.line_hubs(F.col("text")).alias("hubs")).collect()}
    assert all(len(hubs[k]) == 41 and len(hubs[k] & hubs[k + 1]) == 1 for k in range(0, 60, 2))


def test_band_classes_read_each_text_once(spark, monkeypatch):
    """Signatures come from one pass in which no text is shuffled, repeated rows and ids that several texts share included; the pairs of one text are several tasks."""
    monkeypatch.setattr(fingerprints, "PAIRS", 4)
    base = [f"t{i}" for i in range(100)]
    near = [" ".join(base[:-1] + [f"n{k}"]) for k in range(40)]
    rows = list(enumerate(near)) + [(3, near[3]), (3, near[3]), (50, near[7]), (51, "other words of its own"), (51, near[9]), (60, " \n"), (61, None), (None, near[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.near_classes(docs).collect()
    assert len(got) == len(rows)
    assert {r["class_id"] for r in got if r["doc_id"] is not None and r["doc_id"] <= 50} == {0}
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in got if r["doc_id"] in (60, 61)} == {60: (60, 0), 61: (61, 0)}
    marks = fingerprints.marked(docs, 32)
    assert "Exchange" not in marks._jdf.queryExecution().executedPlan().toString() and marks.count() == len(rows)
    dealt = fingerprints.dealt_pairs(spark.createDataFrame([(0, k) for k in range(1, 40)], "a long, b long"))
    assert dealt.select(F.spark_partition_id()).distinct().count() > 2
