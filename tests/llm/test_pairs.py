"""Unified text, shared spans, near-duplicates: against brute force, with dirty input."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlode.llm import neardup, spans, unify

CHUNKS = "chunk_id long, doc_id long, text_utf8 string, text_norm_ascii string, preview string, path string, look string, digest string, _n long, anchor string"


def chunks(spark, *rows, norm=True):
    """(chunk_id, doc_id, text) rows, with columns whose names the operators use inside."""
    data = [(c, d, t, t if norm else None, t, f"/library/s/{d}.pdf", "clash", None, 7, "x") for c, d, t in rows]
    return spark.createDataFrame(data, CHUNKS)


def test_same_as_nfc_where_nothing_is_mapped():
    rnd = random.Random(1)
    pool = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x300, 0x34E), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3), 0xAC00, 0xAC01)]
    pool = [c for c in pool if unify._reading(c) == unicodedata.normalize("NFD", c)]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["".join(rnd.choice("aȩ̣́̈") for _ in range(9)) for _ in range(2000)]
    assert unify.unify_array(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize(("text", "expected"), [
    ("ｆｕｌｌ　１２", "full 12"), ("secοnd саt", "second cat"), ("ﬁne oﬃce", "fine office"), ("a​b­c﻿", "abc"), ("a b c\td", "a b c d"), ("é", "é"), ("a\r\nb\rc", "a\nb\nc"),
    ("ё", "ë"), ("²½", "²½"), ("“x” – ‘y’", "“x” – ‘y’"), ("a  b ", "a  b "), ("​", ""), ("", ""), (None, None), ("x" * 100_000 + "е", "x" * 100_000 + "e"),
])
def test_forms(text, expected):
    assert unify.unify_array(pa.array([text], pa.string())).to_pylist() == [expected]
    assert unify.unify_array(pa.array(["before", text, "е́"], pa.string())).to_pylist() == ["before", expected, "é"]


def test_same_look(spark):
    df = chunks(spark, (1, 1, "cat"), (2, 2, "саt"), (3, 3, "cat"), (4, 2, "ｃａｔ"), (5, 4, "Cat"), (6, 5, "cát"), (7, 6, None), (8, 7, ""), (9, 8, "​"), (1, 1, "cat"), (10, 1, "ca​t"))
    got = sorted(map(tuple, unify.same_look_pairs(df).collect()))
    assert got == [(1, 2), (1, 4), (2, 3), (2, 10), (3, 4), (3, 10), (4, 10), (8, 9)]
    assert unify.same_look_pairs(df.limit(0)).count() == 0
    kept = unify.unify(df)
    assert kept.count() == 11 and kept.columns == [*df.columns, "text_unified"]


def brute_pairs(rows, least):
    seen = {}
    for c, d, t in set(rows):
        for j in range(len(t or "") - least + 1):
            seen.setdefault(t[j : j + least], set()).add((c, d))
    return {(a[0], b[0]) for v in seen.values() for a in v for b in v if a[0] < b[0] and a[1] != b[1]}


def test_shared_spans(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 5)))
    base = [" ".join(word() for _ in range(60)) for _ in range(12)]
    rows = []
    for n in range(60):
        text = "".join(b[rnd.randint(0, 60) :][: rnd.randint(10, 200)] for b in rnd.sample(base, 3))
        rows.append((n, n // 2, text))
    rows += [(100, 100, "-" * 300), (101, 101, "x" + "-" * 250), (102, 102, "ab" * 120), (103, 103, "ba" * 90), (104, 104, base[0]), (105, 105, base[0]), (106, 105, base[0]), (107, 107, None), (108, 108, ""), (104, 104, base[0])]
    spec = spans.Spans(least=60, k=20)
    df = chunks(spark, *rows)
    got = set(map(tuple, spans.shared_pairs(df, spec).collect()))
    expected = brute_pairs(rows, 60)
    assert got == expected and len(expected) > 50
    found = {r["chunk_id"]: (r["n_chars"], r["n_shared"]) for r in spans.shared_length(df, spec).collect()}
    grams = {}
    for c, d, t in set(rows):
        for j in range(len(t or "") - 59):
            grams.setdefault(t[j : j + 60], set()).add(d)
    for c, d, t in set(rows):
        covered = {i for j in range(len(t or "") - 59) if grams[t[j : j + 60]] - {d} for i in range(j, j + 60)}
        assert found[c] == (len(t or ""), len(covered)), c
    assert spans.shared_pairs(df.limit(0), spec).count() == 0


def test_large_classes_of_copies_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(spans, "FEW", 4)
    monkeypatch.setattr(neardup, "FEW", 4)
    text = " ".join(f"word{n}" for n in range(60))
    rows = [(n, n, text) for n in range(30)] + [(99, 99, text + " and more")]
    got = set(map(tuple, spans.shared_pairs(chunks(spark, *rows), spans.Spans(least=60, k=20)).collect()))
    assert {x for p in got for x in p} == {*range(30), 99} and len(got) < 70
    near = set(map(tuple, neardup.near_pairs(chunks(spark, *rows), neardup.NearDup(words=2, similarity=0.6, rows=2, bands=32)).collect()))
    assert {x for p in near for x in p} == {*range(30), 99} and len(near) < 70


def test_near_duplicates(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{n}" for n in range(400)]
    docs = {}
    for n in range(40):
        words = rnd.choices(vocabulary, k=120)
        docs[n] = words
        for k in range(3):
            copy = list(words)
            for _ in range(rnd.randint(0, 25)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            docs[1000 + 10 * n + k] = copy[rnd.randint(0, 20) :]
    docs |= {5000: ["tiny"], 5001: ["tiny"], 5002: docs[0], 5003: docs[0]}
    rows = []
    for d, words in docs.items():
        half = len(words) // 2
        rows += [(d * 2, d, " ".join(words[: half + 5])), (d * 2 + 1, d, " - ".join(words[half:]))]
    rows += [(99998, 7000, None), (99999, 7001, ""), rows[0]]
    spec = neardup.NearDup(words=3, similarity=0.6, least=40, rows=3, bands=32)
    df = chunks(spark, *rows)
    sets = {}
    for _, d, t in rows:
        w = re.findall("[a-z0-9]+", t or "")
        sets.setdefault(d, set()).update(zip(w, w[1:], w[2:]))
    sets = {d: s for d, s in sets.items() if len(s) >= 40}
    expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = set(map(tuple, neardup.near_pairs(df, spec).collect()))
    assert got <= expected and len(got) >= 0.99 * len(expected) > 40 and (5002, 5003) in got
    groups = {r["doc_id"]: r for r in neardup.near_groups(df, spec).collect()}
    assert set(groups) == set(sets) and groups[5002]["class_id"] == groups[5003]["class_id"] == 0
    assert all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in got)
    assert neardup.near_pairs(df.limit(0), spec).count() == 0 and neardup.near_groups(df.limit(0), spec).count() == 0
    assert neardup.NearDup().words == 5 and neardup.NearDup().similarity == 0.8


def test_documents_cut_between_batches():
    batch = lambda rows: pa.RecordBatch.from_pylist([{"doc_id": d, "text_norm_ascii": t} for d, t in rows])
    rows = [(d, f"text {d} " * (1 + d % 7)) for d in range(40) for _ in range(1 + d % 5)]
    for size in (1, 3, 17, 200):
        for limit in (1, 50, 400):
            tables = list(neardup._whole_docs([batch(rows[i : i + size]) for i in range(0, len(rows), size)], limit))
            assert [r for t in tables for r in zip(t.column("doc_id").to_pylist(), t.column("text_norm_ascii").to_pylist())] == rows
            docs = [set(t.column("doc_id").to_pylist()) for t in tables]
            assert all(not a & b for i, a in enumerate(docs) for b in docs[i + 1 :])


def test_clashing_columns(spark):
    df = chunks(spark, (1, 1, "one two three four"), (2, 2, "one two three four")).withColumns({"class_id": F.lit("x"), "n": F.lit(1), "keys": F.lit(0), "doc": F.lit(2)})
    spec = neardup.NearDup(words=2, similarity=0.5, rows=2, bands=8)
    assert [tuple(r) for r in neardup.near_pairs(df, spec).collect()] == [(1, 2)]
    assert [tuple(r) for r in spans.shared_pairs(df, spans.Spans(least=10, k=4)).collect()] == [(1, 2)]


def test_null_ids(spark):
    text = " ".join(f"word{n}" for n in range(60))
    df = chunks(spark, (1, None, text), (None, 2, text), (3, 3, text), (None, None, text), (4, 4, text.replace("o", "о")), (None, 5, text.replace("w", "ｗ")))
    assert [tuple(r) for r in unify.same_look_pairs(df).collect()] == [(3, 4)]
    assert spans.shared_pairs(df, spans.Spans(least=60, k=20)).count() >= 0 and spans.shared_length(df, spans.Spans(least=60, k=20)).count() >= 2
    spec = neardup.NearDup(words=2, similarity=0.9, rows=2, bands=8)
    assert (2, 3) in [tuple(r) for r in neardup.near_pairs(df, spec).collect()] and neardup.near_groups(df, spec).where("doc_id IS NULL").count() == 0


def test_two_copies_stand_for_many_that_look_the_same(spark, monkeypatch):
    """Two forms of one look with many copies each: no pair of copies is written out, no link between forms is lost."""
    monkeypatch.setattr(unify, "FEW", 3)
    rows = [(n, n, "naïve form") for n in range(20)] + [(100 + n, 100 + n, "naïve form") for n in range(15)] + [(200, 200, "naïve form"), (300, 300, "other"), (301, 301, "other")]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id long, text_utf8 string")
    got = {tuple(r) for r in unify.same_look_pairs(df).collect()}
    ends = [(0, 19), (100, 114), (200,)]
    assert got == {(a, b) for i, x in enumerate(ends) for y in ends[i + 1 :] for a in x for b in y}
    members = {r["chunk_id"]: (r["form_id"], r["n"]) for r in unify.look_members(unify.look_classes(df)).collect()}
    assert members == {n: (0, 20) for n in range(20)} | {100 + n: (100, 15) for n in range(15)} | {200: (200, 1)}
