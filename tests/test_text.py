"""Text forms, pages, windows, patterns, highlighting, listing differences, components, key pairs."""

import random

import pytest
from pyspark.sql import functions as F

from paperlode.functions import text as tx
from paperlode.functions.highlight import segments, segments_column
from paperlode.functions.score import scores
from paperlode.operators import diff
from paperlode.operators.components import components
from paperlode.operators.pairs import key_pairs
from paperlode.plans import grams, pattern

NORMAL = [
    ("Der  GROSSE\tKlang", "der grosse klang"), ("Zeile\n\nZeile", "zeile zeile"), ("\u00a0 am Rand \n", "am rand"), ("Ångström à l’été", "angstrom a l'ete"), ("", ""), ("Füße, cœur, Þór", "fusse, coeur, thor"),
    ("v\x00\x1fw\x7f", "v w\x7f"), ("ﬂach ３７", "flach 37"), ("Москва", "moskva"), ("Щука и ёж", "shchuka i ezh"), ("Αθήνα", "athena"), ("東京", "u6771u4eac"), ("京", "u4eac"), ("le\u200bnt", "lent"), ("😀", "u1f600"),
]


def test_normalize_both_ways(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NORMAL)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", tx.normalize_column(F.col("t")).alias("n")).collect()}
    assert got.pop(99) is None
    for i, (t, expected) in enumerate(NORMAL):
        assert got[i] == expected == tx.normalize_query(t)


def test_display(spark):
    raw = "a\x1b[31mb\x1b[m\x07 c \x08d　e"
    assert spark.createDataFrame([(raw,)], "t string").select(tx.display_column(F.col("t"))).first()[0] == "a [31mb [m c d e" == tx.display(raw)


@pytest.mark.parametrize(("text", "pages"), [("p1\x0c\x0cp3\x0c", ["p1", "", "p3"]), ("", []), ("\x0c", [""]), ("one", ["one"]), (None, None)])
def test_pages(spark, text, pages):
    assert spark.createDataFrame([(text,)], "t string").select(tx.pages_column(F.col("t"))).first()[0] == pages


def windows(spark, *texts):
    pages = spark.createDataFrame([(i, 7, t) for i, t in enumerate(texts)], "d int, page_no int, page_text string")
    return sorted(map(tuple, tx.window_rows(pages, ["d"]).select("d", "chunk_ord", "char_start", "char_end", "text_utf8").collect()))


def test_windows(spark):
    got = windows(spark, "a" * 3500, "é" * 1300, " \n\t", "b" * 1200, "x" + " " * 2500 + "y")
    assert [(r[1], r[2], r[3]) for r in got if r[0] == 0] == [(0, 0, 1200), (1, 1000, 2200), (2, 2000, 3200), (3, 3000, 3500)]
    assert [(r[1], r[2], r[3]) for r in got if r[0] == 1] == [(0, 0, 2400), (1, 2000, 2600)]
    assert not [r for r in got if r[0] == 2] and len([r for r in got if r[0] == 3]) == 1
    assert [r[1] for r in got if r[0] == 4] == [0, 2]  # the blank window has its number, but no row


def test_preview(spark):
    df = spark.createDataFrame([("é" * 150,), ("a  b\nc",), ("x" * 199 + "é",), (None,)], "text_utf8 string")
    assert [r["preview"] for r in tx.with_preview(df).collect()] == ["é" * 100, "a b c", "x" * 199, None]


#: Patterns with all their matches, up to a few repetitions, over an alphabet that covers them.
SMALL = ["tinte", "tin(te)?", "(ab|cde)f", "a[bc]{2}d", "(xy)+z", "ab*c", "(a|b)(c|d)(e|f)", "k{3}", "(ab){2,3}", "a.c", "a b", "(a|)b c", "q[^r]s", "ab??c", "(?:x|yz)(?:)w", "[a-e&&[cx]]d", "[ab--b]c", "[ab~~bc]d"]


def _strings(node, alphabet):
    """Every string a tree matches, repeated at most once more than it must be."""
    from itertools import product

    if node.kind in ("look", "empty"):
        return {""}
    if node.kind == "literal":
        return {node.data.decode()}
    if node.kind == "class":
        return {c for c in alphabet if ord(c) in node.members}
    inner = [_strings(p, alphabet) for p in node.parts]
    if node.kind == "alternation":
        return set().union(*inner)
    if node.kind == "repeat":
        high = node.low + 2 if node.high is None else node.high
        return {"".join(x) for n in range(node.low, high + 1) for x in product(inner[0], repeat=n)}
    return {"".join(x) for x in product(*inner)}


def _true(query, text):
    if isinstance(query, grams.Pair):
        n = 1 + query.skip
        return any(ord(a) == query.a and ord(b) == query.b for a, b in zip(text, text[n:]))
    return isinstance(query, grams.Any) or (all if isinstance(query, grams.And) else any)(_true(q, text) for q in query.of)


@pytest.mark.parametrize("regex", SMALL)
def test_every_match_holds_the_pairs(regex):
    tree, query = pattern.parse(regex)[0], grams.regex_query(regex)
    found = _strings(tree, "abcdefqrstxyz k")
    assert found
    for s in found:
        for around in (s, "m" + s, " " + s + "  n"):  # what stands around a match can be anything
            assert _true(query, tx.normalize_query(around)), (s, query)


@pytest.mark.parametrize(("regex", "common"), [("tinte", ["ti", "in", "nt", "te"]), ("(tin|gin)te", ["in", "nt", "te"]), ("(ab|cb)+", []), ("k{3}", ["kk"]), (r"lager\s+\d+ kisten", ["la", "ag", "ge", "er", "ki", "is", "st", "te", "en"])])
def test_pairs_common_to_all_matches_are_stated(regex, common):
    query = grams.regex_query(regex)
    for p in common:
        assert grams.Pair(ord(p[0]), ord(p[1])) in grams.pairs_in(query)


def test_alternatives_are_a_disjunction():
    query = grams.regex_query("(nord|ost)wind")
    assert _true(query, "der nordwind") and _true(query, "ein ostwind") and not _true(query, "der westwind") and not _true(query, "nord und wind")


@pytest.mark.parametrize("regex", [r"\d\d", "[a-z]+", "ü.ö", "m|n", "v?", ".*", "w|", "[offen", "y(.*a)", r"ß \d"])
def test_no_statement(regex):
    assert grams.regex_query(regex) == grams.Any()


@pytest.mark.parametrize(("regex", "text", "matched"), [
    ("(?m)^tafel$", "vor\ntafel\nnach", "tafel"), ("^tafel$", "vor\ntafel\nnach", None), ("(?m)^$", "a\n", ""), ("(?x) ta fel # zwei\n 1", "Tafel1", "Tafel1"), ("(?x)[t u] \\x20?a", "ta", "ta"), ("(?U)a+", "aaa", "a"), ("(?U)a+?", "aaa", "aaa"),
    ("(?-i)Tafel", "tafel Tafel", "Tafel"), ("((?-i)A)b", "AB", "AB"), ("(?s)a.b", "a\nb", "a\nb"), ("[a-f&&[^bd]]+", "bdace", "ace"), ("[a-f--[bd]]+", "bdace", "ace"), ("[ab~~bc]+", "bac", "ac"), ("[^a-f--[bd]]+", "acbdx", "bdx"), ("[[:alpha:]]+", "éab", "ab"), ("(?m:^b)|c$", "a\nb", "b"),
])
def test_flags_and_class_arithmetic(spark, regex, text, matched):
    java = pattern.parse(regex)[1]
    row = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java).alias("hit"), F.coalesce(F.regexp_substr("t", F.lit(java)), F.lit("")).alias("m")).first()
    assert (row["m"] if row["hit"] else None) == matched


def test_probes():
    assert grams.fuzzy_probes("") is None and grams.fuzzy_probes("a") is None and grams.fuzzy_probes("\x01\x02\x03") is None
    assert grams.fuzzy_probes("ab").need == 1 and len(grams.fuzzy_probes("quickb").keys) == 5 and grams.fuzzy_probes("quickb").need == 3
    assert len(grams.fuzzy_probes("x" * 30).keys) == 6


@pytest.mark.parametrize(("text", "query", "matched"), [("HeLLo WoRLd", "hello", ["HeLLo"]), ("a foo bar b", "foo bar", ["foo bar"]), ("bar foo", "foo bar", ["bar", "foo"]), ("STRAẞE", "stra", ["STRA"]), ("İstanbul", "istanbul", []), ("anything", "", []), ("", "x", [])])
def test_segments(text, query, matched):
    got = segments(text, query)
    assert "".join(t for t, _ in got) == text and [t for t, k in got if k == "match"] == matched


def test_segments_column(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "t string").select(segments_column(F.col("t"), "b").alias("s")).collect()
    assert [[tuple(x) for x in r["s"]] if r["s"] else None for r in rows] == [[("a", "plain"), ("b", "match")], None]


def test_scores():
    got = scores(["the quick fox", "unrelated", "", "qiuck", "a qiuck b"], "qiuck")
    assert got[3] > got[4] > got[0] > got[1] >= got[2] == 0 and len(scores([], "x")) == 0


def test_reasons(spark):
    listed = spark.createDataFrame([("/same", 1, 1), ("/size", 2, 1), ("/new", 1, 1), ("/error", 1, 1), ("/stale", 1, 1), ("/back", 1, 1), ("/backmod", 3, 1), ("/null", None, None)], "path string, size_bytes long, mtime_ns long")
    row = lambda p, status="ok", v="2": (p, status, 1, 1, "x", v, 2)
    docs = [row("/same"), row("/size"), row("/error", "error"), row("/stale", v="1"), row("/back", "deleted"), row("/backmod", "deleted"), row("/gone"), row("/goneold", "deleted"), row("/null")]
    stored = spark.createDataFrame(docs, "path string, status string, size_bytes long, mtime_ns long, extractor string, extractor_version string, norm_version long")
    got = lambda **k: {r["path"]: r["reason"] for r in diff.reasons(listed, stored, F.lit("x"), F.lit("2"), F.lit(2), **k).collect()}
    expected = {"/size": "modified", "/new": "new", "/error": "retry_after_error", "/stale": "stale_extractor", "/backmod": "modified", "/gone": "deleted", "/null": "modified"}
    assert got() == expected
    assert got(restored_is_new=True) == expected | {"/back": "new", "/backmod": "new"}


def test_latest(spark):
    rows = [(1, "/a", 10, 1, "2024-01-01"), (2, "/a", 11, 2, "2024-01-02"), (3, "/a", 12, 3, "2024-01-02"), (1, "/a", 10, 1, "2024-01-01"), (4, None, 1, 1, "2024-01-01")]
    df = spark.createDataFrame(rows, "listing_id long, path string, size_bytes long, mtime_ns long, seen_at string")
    assert [tuple(r) for r in diff.latest(df).collect()] == [("/a", 12, 3)] and diff.latest(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(260)] + [(n, n + 1) for n in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_key_pairs_of_a_hot_key(spark):
    rows = [("hot", n) for n in range(40)] + [("a", 100), ("a", 101), ("one", 7), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "k string, id long")
    for block in (1, 7, 1000):
        got = sorted((r["a"]["id"], r["b"]["id"]) for r in key_pairs(df, ["k"], "id", block=block).collect())
        assert got == sorted([(i, j) for i in range(40) for j in range(i + 1, 40)] + [(100, 101)])
