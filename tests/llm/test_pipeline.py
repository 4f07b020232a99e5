"""The pipeline's stages, each against what it should keep of its own input."""

import collections

import pytest

from obspark.llm import common

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.documents(spark, sf)
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, sf), name)
        out.append(docs.toPandas())
    return out


def test_columns_and_order(stages):
    assert all(list(s.columns) == list(stages[0].columns) for s in stages[1:-1])
    assert [len(s) for s in stages[:-1]] == sorted((len(s) for s in stages[:-1]), reverse=True)


def test_one_of_each_group_stays(stages, spark):
    from tests.llm.test_corpus_operators import brute_components

    before, after = stages[2], stages[3]
    expected = brute_components(list(zip(before.doc_id, before.text, strict=True)), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert set(after.doc_id) == {c for _, c in expected.values()}


def test_no_passage_is_left(stages):
    before, after = stages[3], stages[4]
    n = corpus_pipeline.PASSAGE
    count = collections.Counter(t.encode()[i : i + n] for t in before.text for i in range(len(t.encode()) - n + 1))
    clean = {d for d, t in zip(before.doc_id, before.text, strict=True) if all(count[t.encode()[i : i + n]] == 1 for i in range(len(t.encode()) - n + 1))}
    kept, whole = dict(zip(after.doc_id, after.text, strict=True)), dict(zip(before.doc_id, before.text, strict=True))
    assert all(kept[d] == whole[d] for d in clean) and any(kept.get(d, "") != whole[d] for d in whole if d not in clean)
    assert (after.n_chars == after.text.str.len()).all()


def test_all_is_packed(stages):
    packed = stages[5]
    assert set(packed.doc_id) == set(stages[4].doc_id)
    assert (packed.groupby("doc_id").length.sum() == packed.groupby("doc_id").doc_tokens.first()).all()


def test_stages_edge_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, extra columns with names that the stages use, and empty tables."""
    text = "the cat sat on the mat and the dog ran away from home " * 8
    long = " ".join(f"w{i % 977} of x{i % 31}" for i in range(20_000))
    rows = [(1, text, "en"), (1, text, "en"), (2, text + "again", None), (3, None, "en"), (4, "", "en"), (5, " \n", None), (6, long, "en"), (7, "12 34 56", "en"), (None, "a text without an id that is quite short", "fr"), (8, "le chat est sur la table et le chien est dans la maison", "fr")]
    table = spark.createDataFrame([(*r, "s", 1, 2, "z", [1]) for r in rows], "doc_id long, text string, lang string, source string, _row int, row int, stretches string, shard array<int>")
    spark.createDataFrame([(1, 1), (6, 1), (8, 1), (7, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (table, table.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before, columns = docs.count(), docs.columns
            docs = common.stash(stage(spark, docs, str(tmp_path)), name)
            assert name == "packing" or (docs.columns == columns and docs.count() <= before)
    kept = [r for r in common.stash(corpus_pipeline.join_near_duplicates(spark, table, ""), "near").collect()]
    assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter([1, 3, 4, 5, 6, 7, None, 8])
    told = corpus_pipeline.identify_language(spark, table, "").collect()
    assert {r["doc_id"] for r in told} <= {1, 2, 6, None, 8} and {1, 6} <= {r["doc_id"] for r in told}
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.remove_passages(spark, table, "").collect()}
    assert left[3] is None and left[4] == "" and left[8] == rows[9][1] and 1 not in left


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
