"""The verbs over one store, from the first ingest to a query."""

import pytest

from lodestone.api import Engine


def test_verbs_over_one_store(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.health() == {"status": "ok", "documents": 0, "nodes": 0}
    for call in (lambda: engine.query("cats"), engine.rebuild, lambda: engine.document(1), lambda: engine.node("0"), lambda: engine.ingest_status(1)):
        with pytest.raises(LookupError):
            call()
    texts = ["cats chase mice", "dogs chase cats", "the parliament votes", "cats chase mice", None]
    batch = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert engine.ingest(batch) == {"job_id": 1, "status": "completed", "inserted": 4, "updated": 0, "duplicates": 1}
    again = spark.createDataFrame([(1, "dogs sleep"), (9, "cats chase mice"), (7, "x" * 300)], "id long, text string")
    assert engine.ingest(again) == {"job_id": 2, "status": "completed", "inserted": 1, "updated": 1, "duplicates": 1}
    assert engine.ingest_status(2)["processed"] == 2 and engine.document(1) == {"id": 1, "text": "dogs sleep"}
    assert engine.dedup() == {"total": 5, "removed": 0, "unique": 5}
    assert engine.embed() == 5 and engine.embed() == 0
    events = {r.node_id: r.event for r in engine.rebuild(leaf_size=2).collect()}
    assert events["0"] == "node_created" and set(events.values()) == {"node_created"}
    assert engine.node("0")["doc_count"] == 5 and sorted(r.doc_id for r in engine.node_documents("0").collect()) == [0, 1, 2, 4, 7]
    assert engine.stats() == {"documents": 5, "embedded": 5, "nodes": len(events), "leaves": sum(engine.node(n)["is_leaf"] for n in events), "depth": engine.stats()["depth"]}
    assert {r.target for r in engine.tree().collect()} == set(events) - {"0"}
    best = engine.query("who chases mice: cats", 2).orderBy("rank").collect()
    assert best[0].doc_id == 0 and best[0].preview == "cats chase mice" and len(best) == 2
    assert [r.id for r in engine.documents(2, 3).collect()] == [4, 7]
    with pytest.raises(ValueError, match="limit"):
        engine.documents(0)
    assert Engine(spark, f"file://{tmp_path}/store").health()["documents"] == 5
