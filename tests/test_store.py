"""Store, extraction, live index."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from paperlode.operators import incremental
from paperlode.operators.extract import documents_of, error_text, extract, plain_text
from paperlode.operators.ids import numbered
from paperlode.operators.store import Store
from paperlode.plans import changes
from paperlode.sources import files
from paperlode.sources.files import PdfFiles, is_pdf, store_path, walk
from paperlode.streaming.live import LiveIndex, Options, with_content

READ = "path string, size_bytes long, mtime_ns long, dev long, ino long, text string, error_text string"


def batch(spark, *rows):
    return documents_of(spark.createDataFrame([(p, 1, 1, None, None, t, e) for p, t, e in rows], READ), "plain", "1")


def test_upsert_replace_delete_compact(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.documents().count() == 0 and store.chunks().count() == 0
    store.upsert(batch(spark, ("/a.pdf", "alpha\x0cbeta", None), ("/b.pdf", "gamma", None), ("/c.pdf", None, "boom"), ("/e.pdf", " \n", None)), 5)
    docs = {r["path"]: r for r in store.documents().collect()}
    assert {p: r["status"] for p, r in docs.items()} == {"/a.pdf": "ok", "/b.pdf": "ok", "/c.pdf": "error", "/e.pdf": "empty"}
    assert docs["/a.pdf"]["page_count"] == 2 and docs["/e.pdf"]["page_count"] == 0 and docs["/c.pdf"]["error_text"] == "boom"
    before = {r["chunk_id"] for r in store.chunks().collect()}
    assert len(before) == 3
    store.upsert(batch(spark, ("/a.pdf", "delta", None), ("/d.pdf", "new", None)), 6)
    again = {r["path"]: r["doc_id"] for r in store.documents().collect()}
    assert again["/a.pdf"] == docs["/a.pdf"]["doc_id"] and again["/d.pdf"] not in {r["doc_id"] for r in docs.values()}
    now = {r["chunk_id"]: r["text_utf8"] for r in store.chunks().where("active").collect()}
    assert sorted(now.values()) == ["delta", "gamma", "new"] and not {i for i, t in now.items() if t == "delta"} & before
    gone = store.mark_deleted(spark.createDataFrame([("/b.pdf",), ("/none.pdf",)], "path string"), 7)
    assert [r["path"] for r in gone.collect()] == ["/b.pdf"]
    assert sorted(r["text_utf8"] for r in store.chunks().where("active").collect()) == ["delta", "new"]
    state = sorted(map(tuple, store.documents().collect()), key=str), sorted(map(tuple, store.chunks().collect()))
    store.compact()
    assert (sorted(map(tuple, store.documents().collect()), key=str), sorted(map(tuple, store.chunks().collect()))) == state
    store.upsert(batch(spark, ("/b.pdf", "back", None)), 8)
    assert sorted(r["text_utf8"] for r in store.chunks().where("active").collect()) == ["back", "delta", "new"]
    assert store.documents().where("path = '/b.pdf'").first()["deleted_at_ms"] is None


def test_meta(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.meta().count() == 0
    store.set_meta("a", "1")
    store.set_meta("a", "2")
    assert [tuple(r) for r in store.meta().collect()] == [("a", "2")]


def test_numbers_are_consecutive(spark):
    rows = numbered(spark.range(1000).withColumn("k", F.expr("(id * 7919) % 1000")), ["k"], "n", 11).collect()
    assert sorted(r["n"] for r in rows) == list(range(11, 1011)) and all(r["n"] == r["k"] + 11 for r in rows)
    assert numbered(spark.range(0), ["id"], "n", 1).count() == 0


@pytest.mark.parametrize(("code", "errors", "expected"), [(3, "", "t exited with status 3"), (3, "x", "t exited with status 3: x"), (None, "", "t terminated by signal"), (None, "x", "t terminated by signal: x")])
def test_error_text(code, errors, expected):
    assert error_text(code, errors, "t") == expected


def test_incremental_survives_failure(spark, tmp_path):
    log = incremental.CommitLog(spark, str(tmp_path / "log"))
    rows = spark.range(10)
    work = lambda lo, hi: rows.where(F.col("id").between(lo + 1, hi))
    incremental.run(log, lambda: 4, work, first=-1)

    def fails(lo, hi):
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError):
        incremental.run(log, lambda: 7, fails)
    assert log.last().upper == 4
    stale = log.last()
    incremental.run(log, lambda: 9, work)
    assert incremental.run(log, lambda: 9, fails).upper == 9  # nothing new: no work
    assert sorted(r["id"] for r in incremental.committed(log, "id long").collect()) == list(range(10))
    with pytest.raises(incremental.Conflict):
        log.commit(stale, 12, None)


def test_listing(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", ".pdf", ".hidden.pdf", "sub/d.pdf", "skip/e.pdf"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    (tmp_path / "in" / ".gitignore").write_text("skip/\n# note\n")
    spark.dataSource.register(PdfFiles)
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    assert names(spark.read.format("pdf_files").load(str(tmp_path / "in"))) == [".hidden.pdf", "a.pdf", "b.PDF", "d.pdf", "e.pdf"]
    assert names(spark.read.format("pdf_files").option("respectIgnore", "true").load(str(tmp_path / "in"))) == [".hidden.pdf", "a.pdf", "b.PDF", "d.pdf"]
    assert is_pdf("/x/a.Pdf") and not is_pdf("/x/.pdf") and not is_pdf("/x/a.pdf.txt")
    assert len(list(walk(str(tmp_path / "in")))) == 5
    assert store_path("/d", "/x/my docs").startswith("/d/paperlode/my_docs-") and len(store_path("/d", "/x/y")) == len("/d/paperlode/y-") + 16


@pytest.mark.parametrize(("rule", "path", "folder", "fits"), [
    ("*.pdf", "a/b.pdf", False, True), ("/*.pdf", "a/b.pdf", False, False), ("a/*.pdf", "a/b.pdf", False, True), ("a/*.pdf", "a/c/b.pdf", False, False), ("**/x.pdf", "x.pdf", False, True), ("**/x.pdf", "a/b/x.pdf", False, True),
    ("a/**", "a/b/c.pdf", False, True), ("a/**", "a", True, False), ("a/**/c.pdf", "a/c.pdf", False, True), ("skip/", "skip", False, False), ("skip/", "d/skip", True, True), ("x?.pdf", "xy.pdf", False, True), ("x[0-9].pdf", "x7.pdf", False, True),
    ("x[!0-9].pdf", "x7.pdf", False, False), (r"\#a.pdf", "#a.pdf", False, True), ("a.pdf  ", "a.pdf", False, True), ("# a.pdf", "# a.pdf", False, False), ("", "a.pdf", False, False),
])
def test_ignore_rules(rule, path, folder, fits):
    assert files._ignored([("/r", rule)], f"/r/{path}", folder) == fits
    assert not files._ignored([("/r", rule), ("/r", "!" + rule)], f"/r/{path}", folder)


def test_links_in_a_circle(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_text("x")
    (tmp_path / "a" / "again").symlink_to(tmp_path, target_is_directory=True)
    assert len(list(walk(str(tmp_path), follow_links=True))) == 1 == len(list(walk(str(tmp_path))))


def test_a_file_that_cannot_be_read_is_an_error(spark, tmp_path):
    (tmp_path / "good.pdf").write_text("text")
    (tmp_path / "bad.pdf").mkdir()  # reading it fails
    rows = spark.createDataFrame([(str(tmp_path / n), 1, 1, None, None) for n in ("good.pdf", "bad.pdf", "gone.pdf")], "path string, size_bytes long, mtime_ns long, dev long, ino long")
    got = {os.path.basename(r["path"]): r for r in extract(with_content(rows), plain_text, "plain", "1").collect()}
    assert {n: r["status"] for n, r in got.items()} == {"good.pdf": "ok", "bad.pdf": "error"} and "directory" in got["bad.pdf"]["error_text"]


def test_the_log_is_read_from_the_last_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for n in range(3):
        store.upsert(batch(spark, (f"/{n}.pdf", "text", None)), n)
    store.compact()
    store.upsert(batch(spark, ("/0.pdf", "new", None), ("/9.pdf", "text", None)), 9)
    assert [s for s, _ in store._layers()] == [4, 5] and store.log.last().note == {"doc_id": 4, "chunk_id": 5}
    assert sorted(r["doc_id"] for r in store.documents().collect()) == [1, 2, 3, 4]


def test_live_index(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "one.pdf").write_text("first token alphaword")
    live = LiveIndex(spark, Options(str(root), str(tmp_path / "store"), str(tmp_path / "state"), extractor=plain_text, extractor_name="plain", extractor_version="1"))
    found = lambda q: sorted(r["filename"] for r in live.search(q, "literal").collect())
    query = live.watch(str(tmp_path / "checkpoint"))

    def wait(q, expected):
        end = time.time() + 90
        while found(q) != expected and time.time() < end:
            assert query.exception() is None, query.exception()
            time.sleep(0.5)
        assert found(q) == expected

    try:
        wait("alphaword", ["one.pdf"])
        held = live.snapshot
        (root / "two.pdf").write_text("second betaword")
        wait("betaword", ["two.pdf"])
        (root / "one.pdf").write_text("changed gammaword here")
        wait("gammaword", ["one.pdf"])
        assert found("alphaword") == []
        (root / "two.pdf").unlink()
        wait("betaword", [])
        assert held.base.count() >= 0  # a reader's snapshot stays readable
    finally:
        query.stop()
    assert live.progress.ok >= 3 and live.progress.deleted == 1


def _changes_store(spark, tmp_path):
    """A store of three tables, its pending run after a failed one."""
    at = datetime.datetime(2024, 1, 1)
    runs = [(1, "ok", "x", "1", 1), (2, "failed", "x", "2", 1), (3, "pending", "x", "2", 1)]
    listing = [(1, 2, "/a.pdf", 1, 1, at), (2, 2, "/b.PDF", 1, 1, at), (3, 3, "/a.pdf", 2, 1, at), (4, 3, "/c.pdf", 1, 1, at), (5, 3, "/d.txt", 1, 1, at), (4, 3, "/c.pdf", 1, 1, at)]
    documents = [("/a.pdf", "ok", 1, 1, "x", "2", 1), ("/e.pdf", "ok", 1, 1, "x", "1", 1), ("/f.pdf", "deleted", 1, 1, "x", "1", 1)]
    spark.createDataFrame(runs, "run_id int, outcome string, extractor string, extractor_version string, norm_version long").write.parquet(f"{tmp_path}/scan_runs.parquet")
    spark.createDataFrame(listing, "listing_id long, run_id int, path string, size_bytes long, mtime_ns long, seen_at timestamp").write.parquet(f"{tmp_path}/listing.parquet")
    spark.createDataFrame(documents, "path string, status string, size_bytes long, mtime_ns long, extractor string, extractor_version string, norm_version long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_the_watermark_lives(spark, tmp_path):
    """A run that dies before its commit leaves nothing; the next does the work once; a further one does nothing."""
    folder = _changes_store(spark, tmp_path / "store")
    log = incremental.CommitLog(spark, str(tmp_path / "log"))
    expected = {("/a.pdf", "modified"), ("/c.pdf", "new"), ("/e.pdf", "deleted")}

    def die(_):
        raise changes.Crash

    with pytest.raises(changes.Crash):
        incremental.run(log, lambda: 3, lambda a, b: changes.run_changes(spark, folder, a, b), first=1, before_commit=die)
    assert log.last() is None and incremental.committed(log, changes.CHANGES).count() == 0
    first = changes.process_pending(spark, folder, log)
    assert (first.sequence, first.lower, first.upper) == (1, 1, 3)
    assert changes.process_pending(spark, folder, log) == first and len(log.commits()) == 1
    assert sorted(map(tuple, incremental.committed(log, changes.CHANGES).collect())) == sorted(expected)
    # below the watermark nothing is read again
    assert changes.run_changes(spark, folder, 3, 3).count() == 0


def test_registered_changes_keep_their_log(spark, tmp_path):
    folder = _changes_store(spark, tmp_path)
    once, twice = ({tuple(r) for r in changes.p4_found(spark, folder).collect()} for _ in range(2))
    assert once == twice == {("/a.pdf", "modified"), ("/c.pdf", "new"), ("/e.pdf", "deleted")}
    assert len(changes.changes_log(spark, folder).commits()) == 1
    runs = {tuple(r) for r in changes.p4_runs(spark, folder).collect()}
    assert runs == {(3, "/a.pdf", 2, 1), (3, "/b.PDF", 1, 1), (3, "/c.pdf", 1, 1), (3, "/d.txt", 1, 1)}
    assert [(c.lower, c.upper) for c in changes.changes_log(spark, folder, "runs").commits()] == [(0, 1), (1, 3)]
