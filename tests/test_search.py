"""Search modes, ranking, snippets, overlay, bigram index."""

import random

import pytest
from pyspark.sql import functions as F

from paperlode.functions.text import normalize_column, normalize_query
from paperlode.operators import bigram_index as bi
from paperlode.operators.overlay import Overlay
from paperlode.plans import grams, pattern, search

ITEMS = "chunk_id long, doc_id long, path string, filename string, page_no int, chunk_ord int, text_utf8 string, text_norm_ascii string, preview string, doc_mtime_ns long"


def frame(spark, *rows):
    """Rows of (chunk_id, doc_id, path, page_no, text[, chunk_ord])."""
    data = [(r[0], r[1], r[2], r[2].rsplit("/", 1)[-1], r[3], r[5] if len(r) > 5 else 0, r[4], None, r[4], 0) for r in rows]
    return spark.createDataFrame(data, ITEMS).withColumn("text_norm_ascii", normalize_column(F.col("text_utf8")))


def hits(df):
    return [r.asDict() for r in df.collect()]


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


@pytest.fixture(scope="module")
def shot(spark):
    base = frame(
        spark,
        (1, 1, "/a.pdf", 1, "seven green lanterns hang above"),
        (2, 2, "/b.pdf", 1, "Parcel #42 came in.\nPARCEL  #7"),
        (3, 3, "/c.pdf", 1, "Parcel #1337 went to café résumé"),
        (4, 4, "/d.pdf", 2, "straße größe"),
    ).cache()
    return search.Snapshot(base, Overlay.empty(spark, base), bi.BigramIndex.build(base))


@pytest.mark.parametrize(("query", "mode", "expected"), [
    ("green", "literal", [1]), ("SEVEN  Green", "literal", [1]), ("cafe resume", "literal", [3]), ("café", "literal", [3]), ("parcel", "literal", [2, 3]), ("zzz", "literal", []), ("", "literal", []), ("  ", "literal", []),
    (r"parcel #\d+", "regex", [2, 3]), (r"#\d{4}", "regex", [3]), (r"^parcel", "regex", [2, 3]), ("größe$", "regex", [4]), ("GRÖSSE|STRASSE", "regex", []), ("STRAßE", "regex", [4]), ("  ", "regex", []), (r"\bhang\b", "regex", [1]), (r"came in\.$", "regex", []),
])
def test_modes(shot, query, mode, expected):
    assert sorted(ids(search.search(shot, query, mode, 10))) == expected


def test_limits(shot):
    assert ids(search.search(shot, "parcel", "literal", 0)) == []
    assert ids(search.search(shot, "parcel", "literal", 1)) == [2]


@pytest.mark.parametrize("bad", ["[invalid", "(a", "a)", "(?=x)", r"(a)\1", "*a", "a{3,1}", r"\q"])
def test_bad_patterns_fail_when_built(shot, bad):
    with pytest.raises(pattern.PatternError):
        search.search(shot, bad, "regex", 10)


def test_unknown_mode(shot):
    with pytest.raises(ValueError):
        search.search(shot, "x", "other")


def test_limit_comes_before_rank(spark):
    rows = [(n, n, f"/{n}.pdf", 1, "alpha in a long text before " + ("beta" if n < 3 else "alpha beta")) for n in range(1, 6)]
    got = ids(search.literal(search.Snapshot(frame(spark, *rows)), "beta", 2))
    assert sorted(got) == [1, 2]


def test_rank_order(spark):
    base = frame(spark, (1, 1, "/a.pdf", 3, "one filler word needle"), (2, 2, "/b.pdf", 1, "needle first"), (3, 3, "/c.pdf", 2, "needle first"), (4, 4, "/d.pdf", 1, "needle first"))
    assert ids(search.literal(search.Snapshot(base), "needle", 10)) == [2, 4, 3, 1]


def test_base_order_interleaves_pages(spark):
    base = frame(spark, (1, 1, "/a.pdf", 1, "w x"), (2, 1, "/a.pdf", 1, "w y", 1), (3, 1, "/a.pdf", 2, "w z"))
    assert sorted(ids(search.literal(search.Snapshot(base), "w", 2))) == [1, 3]


def test_snippets(spark):
    long = "é" * 300 + " needle " + "ü" * 300
    base = frame(spark, (1, 1, "/a.pdf", 1, long), (2, 2, "/b.pdf", 1, "a\n\tneedle\x07 b"))
    found = {h["chunk_id"]: h["snippet"] for h in hits(search.literal(search.Snapshot(base), "needle", 10))}
    assert found[2] == "a needle b"
    assert len(found[1].encode()) <= 6 + 2 * 63 and "�" not in found[1]
    exact = hits(search.regex(search.Snapshot(base), "needle", 10))
    assert all("needle" in h["snippet"] and h["score"] == 1.0 for h in exact)
    ascii_only = search.Snapshot(frame(spark, (1, 1, "/a.pdf", 1, "x" * 500 + " needle " + "y" * 500)))
    assert "needle" in hits(search.literal(ascii_only, "needle", 5))[0]["snippet"]


def test_fuzzy_finds_close_token(spark):
    base = frame(spark, (1, 1, "/a.pdf", 1, "seven green lanterns hang above"), (2, 2, "/b.pdf", 1, "nothing of the kind"), (3, 3, "/c.pdf", 1, "one more piece"))
    got = hits(search.fuzzy(search.Snapshot(base, None, bi.BigramIndex.build(base)), "grene", 10))
    assert "/a.pdf" in [h["path"] for h in got[:3]]


@pytest.mark.parametrize(("query", "first"), [("hartmann lattices", 1), ("hartmann 1987", 1), ("HARTMANN", 2)])
def test_filename_band(spark, query, first):
    base = frame(
        spark,
        (1, 1, "/papers/Hartmann - 1987 - On lattices.pdf", 1, "words on other things"), (2, 2, "/papers/hartmann.pdf", 1, "body"), (3, 2, "/papers/hartmann.pdf", 2, "hartmann again"),
        (4, 3, "/papers/some-words-ahead-of-hartmann.pdf", 1, "body"), (5, 4, "/papers/other.pdf", 1, "this says hartmann hartmann 1987 lattices"),
    )
    got = hits(search.fuzzy(search.Snapshot(base, Overlay.empty(spark, base), bi.BigramIndex.build(base)), query, 10))
    assert got[0]["doc_id"] == first and got[0]["score"] == 1.0
    assert len([h for h in got if h["doc_id"] == 2]) <= 1
    if query == "HARTMANN":
        assert [h["doc_id"] for h in got][:3] == [2, 1, 3] and got[-1]["doc_id"] == 4


def test_overlay(spark):
    base = frame(spark, *[(n, (n + 1) // 2, f"/{(n + 1) // 2}.pdf", 1, f"token{n} common", (n + 1) % 2) for n in range(1, 7)])
    o = Overlay.empty(spark, base)
    one = spark.createDataFrame([(1,)], "doc_id long")
    changed = o.modify(one, frame(spark, (10, 1, "/1.pdf", 1, "replaced common")))
    see = lambda x: sorted(ids(search.literal(search.Snapshot(base, x), "common", 50)))
    assert see(o) == [1, 2, 3, 4, 5, 6] and see(changed) == [3, 4, 5, 6, 10]
    again = changed.modify(one, frame(spark, (11, 1, "/1.pdf", 1, "twice common")))
    assert see(again) == [3, 4, 5, 6, 11] and see(changed) == [3, 4, 5, 6, 10]
    assert see(again.tombstone(one)) == [3, 4, 5, 6]
    assert see(again.tombstone(spark.createDataFrame([(99,)], "doc_id long"))) == [3, 4, 5, 6, 11]
    stats = changed.stats(base).first()
    assert (stats["tombstones"], stats["overflow"], stats["generation"], stats["needs_rebuild"]) == (2, 1, 1, True)
    assert not o.stats(base).first()["needs_rebuild"] and not o.stats(base.limit(0)).first()["needs_rebuild"]
    added = o.add(frame(spark, (20, 9, "/hartmann.pdf", 1, "brand new common")))
    assert see(added)[-1] == 20
    # a document that only the overlay has is found by its text, not by its name, before a rebuild
    names = hits(search.fuzzy(search.Snapshot(base, added), "hartmann", 10))
    assert not names or names[0]["doc_id"] != 9 or names[0]["score"] != 1.0


def test_density_rules(spark):
    rows = [(n, "ab" if n < 100 else "cd" if n < 200 else "zz") for n in range(201)]
    items = spark.createDataFrame(rows, "chunk_id long, text_norm_ascii string")
    index = bi.BigramIndex.build(items)
    P = lambda x: grams.Pair(ord(x[0]), ord(x[1]))  # noqa: E731, N806
    assert index.knows(P("ab")) and index.knows(P("cd")) and not index.knows(P("zz"))
    assert bi.literal_candidates(index, "zz", F.col("x")) is None and bi.literal_candidates(index, "a", F.col("x")) is None
    everywhere = spark.createDataFrame([(n, "ab" + ("cd" if n % 2 else "")) for n in range(200)], "chunk_id long, text_norm_ascii string")
    assert not bi.BigramIndex.build(everywhere).knows(P("ab"))
    got = {(r["skip"], r["key"]): r["df"] for r in bi.frequencies(spark.createDataFrame([("ababab",), ("a",), (None,), ("",), ("aXb",)], "text_norm_ascii string")).collect()}
    assert got[False, ord("a") << 8 | ord("b")] == 1 and got[True, ord("a") << 8 | ord("a")] == 1 and got[True, ord("a") << 8 | ord("b")] == 1
    assert bi.frequencies(spark.createDataFrame([], "text_norm_ascii string")).count() == 0


def test_prefilters_lose_nothing(spark):
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "größe", "naïve", "x1", "of", "a"]
    base = frame(spark, *[(n, n, f"/{n}.pdf", 1, " ".join(rnd.choices(words, k=8))) for n in range(300)]).cache()
    shot = search.Snapshot(base, None, bi.BigramIndex.build(base))
    for q in ("alpha beta", "groesse", "grosse", "ta ga", "naive x1"):
        needle = normalize_query(q)
        plain = {r["chunk_id"] for r in base.where(F.col("text_norm_ascii").contains(needle)).collect()}
        test = bi.literal_candidates(shot.index, needle, F.col("text_norm_ascii"))
        assert test is None or plain <= {r["chunk_id"] for r in base.where(test).collect()}
    for q in (r"größe\s+(alpha|x\d)", "gr.+e", "na[iï]ve x", r"(al)?pha\b.*delta", "x(.*a)"):
        assert ids(search.regex(shot, q, 400)) == ids(search.regex(shot, q, 400, prefilter=True))


def test_fuzzy_rule_equals_all_subsets():
    from itertools import combinations

    rnd = random.Random(2)
    for _ in range(2000):
        n, typos = rnd.randint(3, 6), rnd.randint(1, 2)
        need = n - typos
        state = [rnd.choice((True, False, None)) for _ in range(n)]  # there, not there, not tracked

        def conj(keys):
            known = [state[k] for k in keys if state[k] is not None]
            return None if not known else all(known)

        branches = [conj(c) for c in combinations(range(n), need)]
        expected = None if any(b is None for b in branches) else any(branches)
        missing = state.count(None)
        got = None if missing >= need else state.count(True) + missing >= need
        assert got == expected


def test_null_and_empty_columns(spark):
    base = spark.createDataFrame([(1, 1, None, None, 1, 0, None, None, None, None), (2, 2, "/b.pdf", "b.pdf", 1, 0, "", "", "", 0), (3, 3, "/c.pdf", "c.pdf", None, None, "word", "word", "word", 0)], ITEMS)
    shot = search.Snapshot(base, None, bi.BigramIndex.build(base))
    assert ids(search.literal(shot, "word", 5)) == [3] and ids(search.regex(shot, "w.rd", 5)) == [3]
    assert 3 in ids(search.fuzzy(shot, "word", 5))
    nothing = search.Snapshot(base.limit(0), None, bi.BigramIndex.build(base.limit(0)))
    assert all(ids(search.search(nothing, "word", m, 5)) == [] for m in search.MODES)
