"""Publications: all or nothing, once each, with history, index, summary and audit."""

import json

import pytest

from obspark.operators import publication, text_store

SCHEMA = "record_id string, video_id string, start_ms long, static_text string"
KEY = ["video_id", "start_ms"]


@pytest.fixture()
def kept(spark, tmp_path):
    index = text_store.create(spark.createDataFrame([], "record_id string, static_text string"), str(tmp_path / "index"), ["static_text"])
    return publication.Publications(spark, str(tmp_path / "published"), SCHEMA, KEY, index)


def frame(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{SCHEMA}, seq int")


def state(p):
    terms = sorted((r.term, r.documents) for r in p.index.frequencies().collect())
    docs = sorted(r.record_id for r in p.index.documents().collect())
    return sorted(map(tuple, p.active().collect())), sorted(map(tuple, p.history().collect())), sorted(map(tuple, p.audit().collect())), sorted(map(tuple, p.summaries().collect())), terms, docs


def test_publications(spark, kept):
    assert kept.publish("p1", "j1", "ann", frame(spark, ("r1", "v", 0, "a b"), ("r2", "v", 1, "b"))) == publication.Published(2, 0, 0)
    assert kept.publish("p2", "j1", "ann", frame(spark, ("r3", "v", 1, "c"), ("r4", "w", 0, "c c"), ("r5", "w", 0, "d"))) == publication.Published(1, 2, 2)
    active, history, audit, summaries, terms, docs = state(kept)
    assert active == [("v", 0, "r1", "a b"), ("v", 1, "r3", "c"), ("w", 0, "r5", "d")]
    assert [h[:3] for h in history] == [("r2", "r3", "p2"), ("r4", "r5", "p2")] and json.loads(history[0][3])["static_text"] == "b"
    assert audit == [("publication", "ann", "p1", "j1", 2, 0, 0), ("publication", "ann", "p2", "j1", 1, 2, 2)]
    assert summaries == [("j1", ["r1", "r2", "r4"], ["r3", "r5"], ["r2", "r4"])]
    assert terms == [("a", 1), ("b", 1), ("c", 1), ("d", 1)] and docs == ["r1", "r3", "r5"]
    # the same publication again does nothing
    assert kept.publish("p2", "j1", "ann", frame(spark, ("r9", "z", 9, "z"))) == publication.Published(1, 2, 2)
    assert state(kept) == (active, history, audit, summaries, terms, docs)


def test_publication_that_breaks_off(spark, kept, monkeypatch):
    kept.publish("p1", "j1", "ann", frame(spark, ("r1", "v", 0, "a")))
    before = state(kept)
    # before the commit: nothing is seen
    kept.prepare("p2", "j2", "bob", frame(spark, ("r2", "v", 0, "b")))
    assert state(kept) == before
    # behind the manifest row, before the index has its delta: the next one completes it
    part, delta, result = kept.prepare("p2", "j2", "bob", frame(spark, ("r2", "v", 0, "b")))
    with monkeypatch.context() as m:
        m.setattr(publication.Publications, "recover", lambda self: None)
        kept.commit("p2", part, delta, result)
    assert kept.active().first().record_id == "r2" and [r.record_id for r in kept.index.documents().collect()] == ["r1"]
    assert kept.publish("p3", "j2", "bob", frame(spark, ("r3", "w", 0, "b c"))) == publication.Published(1, 0, 0)
    assert [r.record_id for r in kept.index.documents().orderBy("record_id").collect()] == ["r2", "r3"]
    assert sorted((r.term, r.documents) for r in kept.index.frequencies().collect()) == [("b", 2), ("c", 1)]
