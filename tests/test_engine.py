"""Engine, request worker, and the driver's entry points."""

import threading

import pytest

import __spark_entry__
from paperlode.engine import Config, Engine
from paperlode.operators.extract import plain_text
from paperlode.plans import catalogue
from paperlode.streaming.requests import Worker


def test_engine(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "thesis.pdf").write_text("nothing of note\x0csecond page")
    (root / "other.pdf").write_text("the thesis is here")
    (root / "blank.pdf").write_text(" \n")
    engine = Engine(spark, Config(str(root), store=str(tmp_path / "store"), extractor=plain_text, extractor_name="plain"))
    engine.scan()
    assert [r["filename"] for r in engine.search("thesis").collect()][0] == "thesis.pdf"
    assert [r["filename"] for r in engine.search("thesis", "literal").collect()] == ["other.pdf"]
    assert [r["page_no"] for r in engine.search("second", "regex", 5).collect()] == [2]
    progress = engine.live.progress
    assert (progress.seen, progress.ok, progress.empty, progress.error) == (3, 2, 1, 0)
    engine.scan()  # nothing changed: nothing is extracted again
    assert progress.ok == 2
    engine.stop()
    with pytest.raises(ValueError):
        Config(str(root), mode="other")


def test_worker():
    gate, ran = threading.Event(), []

    def search(query, mode, limit):
        ran.append(query)
        if query == "slow":
            gate.wait(10)
        if query == "bad":
            raise ValueError("no such pattern")
        return [query]

    w = Worker(search)
    w.submit("slow", "literal", 1)
    while ran != ["slow"]:
        pass
    for q in ("a", "b", "c"):
        w.submit(q, "literal", 1)
    gate.set()
    assert w.settled(10) and ran == ["slow", "c"] and w.view.hits == ("c",)
    w.submit("bad", "regex", 1)
    assert w.settled(10) and w.view.hits == ("c",) and "pattern" in w.view.error
    w.submit("  ", "regex", 1)
    assert w.settled(10) and w.view.hits == () and w.view.error is None
    w.close()


def test_entry_points(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "p4_found" in catalogue.queries()
    out = __spark_entry__.entry(spark)
    assert out.columns == ["chunk_id", "doc_id", "path", "filename", "page_no", "chunk_ord", "score", "snippet", "rank"] and out.count() > 0
