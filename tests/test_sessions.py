"""Search sessions over their whole life, lineage, and reindexing that breaks off."""

import datetime

import pytest

from obspark.operators import reindex, scope, search, sessions
from obspark.sources import views

NOW = datetime.datetime(2026, 1, 1, 12)
WHO = scope.Scope("tenant_default", tuple(f"src{i}" for i in range(20)), ("en", "fr", "de", "es"), ("pol_a", "pol_b"), "restricted", capabilities=("observation.search", "runtime.manage"), principal="ann")


def later(seconds):
    return NOW + datetime.timedelta(seconds=seconds)


def other(**k):
    return scope.Scope(**{**WHO.__dict__, **k})


@pytest.fixture(scope="module")
def obs(spark, sf):
    return views.observations(spark, sf).limit(80).cache()


def test_life_of_a_session(spark, obs, tmp_path):
    kept = sessions.Sessions(spark, str(tmp_path), limits=sessions.Limits(revisions=4))
    request = search.Request(query="the of", top_k=15)
    first = kept.start(obs, WHO, request, NOW)
    context = first["context_id"]
    want = [r.record_id for r in search.search(obs, WHO, request).orderBy("rank").collect()]
    assert [r.record_id for r in kept.candidates(first["revision_id"]).orderBy("rank").collect()] == want and first["candidate_count"] == len(want)
    assert kept.audit().first().record_ids == want
    second = kept.refine(context, first["revision_id"], "filter_by_analysis_scale", search.Request(query="the", preferred_scales=("default_segment",), top_k=50), obs, WHO, later(10))
    held = obs.filter(obs.record_id.isin(want) & (obs.analysis_scale == "default_segment"))
    ranked = search.rank(held, search.Request(query="the", preferred_scales=("default_segment",)), obs)
    assert {r.record_id for r in kept.candidates(second["revision_id"]).collect()} == {r.record_id for r in ranked.collect()}
    third, fourth = kept.refine_batch(context, [(first["revision_id"], "rerank_current_candidates", search.Request(query="the", top_k=3)), (second["revision_id"], "narrow_by_tags", search.Request(tags=("nowhere",)))], obs, WHO, later(20))
    assert third["candidate_count"] == 3 and fourth["candidate_count"] == 0 and kept.get(context)["default_revision_id"] == fourth["revision_id"]
    assert kept.facets(context, obs, WHO, later(21)).count() == 0
    paths = {r.revision_id: (r.depth, r.path) for r in sessions.lineage(kept.revisions()).collect()}
    assert paths == {first["revision_id"]: (0, "start"), second["revision_id"]: (1, "start/filter_by_analysis_scale"), third["revision_id"]: (1, "start/rerank_current_candidates"), fourth["revision_id"]: (2, "start/filter_by_analysis_scale/narrow_by_tags")}
    refused = lambda who, at, base=first["revision_id"], ctx=context: _refusal(kept, ctx, base, who, at, obs)
    assert refused(WHO, later(30)) == "limit_exceeded" and refused(other(principal="bob"), later(30)) == "not_found" and refused(WHO, later(30), ctx="nowhere") == "not_found"
    assert refused(WHO, later(30 + 601)) == "idle" and refused(WHO, later(1801)) == "expired"
    assert refused(other(cameras=("src1",)), later(30)) == "scope_changed" and refused(WHO, later(30)) == "not_active"
    again = kept.start(obs, WHO, search.Request(top_k=5), NOW)
    assert refused(WHO, NOW, base=first["revision_id"], ctx=again["context_id"]) == "not_found"
    assert kept.expire(later(5000)) == 1 and kept.get(again["context_id"])["status"] == "expired" and kept.count(again["context_id"]) == 1
    with pytest.raises(PermissionError):
        kept.start(obs, other(capabilities=()), request, NOW)


def _refusal(kept, context, base, who, at, obs):
    try:
        kept.refine(context, base, "narrow_by_tags", search.Request(tags=("en",)), obs, who, at)
    except sessions.Refused as e:
        return e.args[0]
    return None


def test_revisions_never_change(spark, obs, tmp_path):
    kept = sessions.Sessions(spark, str(tmp_path))
    first = kept.start(obs, WHO, search.Request(top_k=5), NOW)
    with pytest.raises(sessions.Refused, match="conflict"):
        kept._keep(kept.get(first["context_id"]), None, "start", {}, search.rank(obs.limit(3), search.Request()), obs, WHO, NOW, first["revision_id"])
    assert kept.candidates(first["revision_id"]).count() == 5


def embedder(folder, breaks_on=None):
    import pathlib
    import uuid

    def embed(texts):
        if breaks_on and any(t == breaks_on for t in texts):
            raise RuntimeError("provider down")
        for t in texts:
            (pathlib.Path(folder) / uuid.uuid4().hex).write_text(t)
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_reindex_that_breaks_off(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = [(f"r{i:03d}", "tenant_default", "src1", "en", "pol_a", "public", f"s{i}", f"d{i}") for i in range(40)] + [("zz", "other", "src1", "en", "pol_a", "public", "hidden", "hidden")]
    df = spark.createDataFrame(rows, "record_id string, tenant_id string, camera_id string, location_id string, access_policy_id string, security_level string, static_text string, dynamic_text string")
    table = reindex.VectorTable(spark, str(tmp_path / "vectors"))
    channels = {"static": "static_text", "dynamic": "dynamic_text"}
    run = lambda e, name, **k: reindex.reindex(table, df, WHO, channels, e, "m1", name, range_rows=10, **k)
    with pytest.raises(Exception, match="provider down"):
        run(embedder(tmp_path / "calls", "s25"), "first")
    done = table.vectors().count()
    assert 0 < done < 80
    before = sorted(p.read_text() for p in (tmp_path / "calls").iterdir())
    committed = {r.record_id for r in table.vectors().collect()}
    (tmp_path / "again").mkdir()
    assert run(embedder(tmp_path / "again"), "first") == reindex.Result(40, 40, 0, 80)
    after = sorted(p.read_text() for p in (tmp_path / "again").iterdir())
    # nothing that was committed is embedded again, all the rest is
    assert sorted(after) == sorted(t for r in rows[:40] if r[0] not in committed for t in r[6:]) and len(before) >= done
    assert {(r.record_id, r.vector_type, tuple(r.embedding)) for r in table.vectors().collect()} == {(r[0], t, (float(len(x)), 1.0)) for r in rows[:40] for t, x in (("static", r[6]), ("dynamic", r[7]))}
    assert run(embedder(tmp_path / "again"), "second") == reindex.Result(40, 0, 80, 0)
    assert run(embedder(tmp_path / "again"), "third", force=True) == reindex.Result(40, 40, 0, 80)
    with pytest.raises(PermissionError):
        reindex.reindex(table, df, other(capabilities=()), channels, embedder(tmp_path), "m1", "x")


def test_lineage_of_more_rows_than_a_recursion_may_have(spark):
    """Spark stops a recursive query at a number of rows; chains end at eight, and cycles, strangers' and missing parents are reached by none."""
    rows = [(f"{c}-{k}", c, f"{c}-{k - 1}" if k else None, f"o{k}") for c in "abcdefgh" for k in range(11)]
    rows += [("x", "a", "y", "p"), ("y", "a", "x", "p"), ("z", "b", "a-0", "p"), ("w", "b", "none", "p")]
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        got = sessions.lineage(spark.createDataFrame(rows, "revision_id string, context_id string, parent_revision_id string, op string")).collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    want = [(f"{c}-{k}", c, f"{c}-0", k, "/".join(f"o{i}" for i in range(k + 1))) for c in "abcdefgh" for k in range(8)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_refinements_read_statistics_of_an_index(spark, obs, tmp_path):
    """With an index no corpus is read: one without texts gives the same ranks."""
    from obspark.operators import records, text_store

    index = text_store.create(obs, str(tmp_path / "index"), ("static_text", "dynamic_text"))
    revision = obs.filter("doc_id % 3 = 0").select("record_id")
    ranks = lambda df: {r.record_id: (r["rank"], round(r.final_score, 9)) for r in df.collect()}
    for operation in ("filter_by_analysis_scale", "rerank_current_candidates", "hybrid_search_text"):
        request = search.Request(query="the of", preferred_scales=("default_segment",))
        got = records.refine(obs, revision, operation, request, spark.range(1), index=index)
        assert ranks(got) == ranks(records.refine(obs, revision, operation, request, obs)) != {}
    kept = sessions.Sessions(spark, str(tmp_path / "sessions"))
    first = kept.start(obs, WHO, search.Request(query="the", top_k=9), NOW, index=index)
    (last,) = kept.refine_batch(first["context_id"], [(first["revision_id"], "rerank_current_candidates", search.Request(query="the", top_k=3))], obs, WHO, later(1), index=index)
    assert last["candidate_count"] == min(3, first["candidate_count"])
