"""Splitting, wrong code pages, packing, leaks, statistics, scanned pages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlode.functions import codepoints as cp
from paperlode.llm import leak, mojibake, ocr, packing, quality, split

# -- splitting


def long_text(rnd, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(rnd.choice(["word ", "é", "Satz. ", "\n", "\n\n", "a", "éé", "́", "😀", "longwordwithoutspace" * rnd.randint(1, 20)]))
    return "".join(out)[:n]


def test_pieces(spark, tmp_path):
    rnd = random.Random(3)
    texts = [(i, long_text(rnd, rnd.choice([1, 5, 99, 100, 101, 300, 5000, 12000]))) for i in range(50)] + [(1000, None), (1001, ""), (1002, "x" * 5000), (1003, "é" * 3333)]
    df = spark.createDataFrame(texts, "k long, t string").withColumns({"size": F.lit("clash"), "piece": F.lit(9)})
    results = []
    for range_bytes in (1 << 20, 1000, 477):
        got = {}
        for r in split.split_text(df, "k", "t", split.Split(100, 20, range_bytes)).collect():
            got.setdefault(r["k"], []).append(tuple(r)[1:])
        results.append({k: sorted(v) for k, v in got.items()})
    assert results[0] == results[1] == results[2]
    for k, t in texts:
        pieces = results[0].get(k, [])
        if not t:
            assert not pieces
            continue
        assert [p[0] for p in pieces] == list(range(len(pieces))) and pieces[0][1] == 0 and pieces[-1][2] == len(t)
        assert all(b[1] == a[2] - 20 for a, b in zip(pieces, pieces[1:]))
        for _, a, b, c, d, text in pieces:
            assert t[a:b] == text == t.encode()[c:d].decode() and 0 < len(text) <= 100
    path = tmp_path / "giant.txt"
    path.write_text(texts[5][1] * 3, encoding="utf-8")
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "p string, n long")
    spec = split.Split(100, 20, 1000)
    pieces = split.split_ranges(split.file_ranges(files, "p", "n", spec), "p", spec)
    whole = split.split_text(spark.createDataFrame([("k", texts[5][1] * 3)], "k string, t string"), "k", "t", spec)
    assert sorted(r["text"] for r in pieces.collect()) == sorted(r["text"] for r in whole.collect())


def test_cuts_prefer_natural_boundaries(spark):
    text = "a" * 60 + ".\n\n" + "b " * 30
    df = spark.createDataFrame([(1, text)], "k long, t string")
    first = split.split_text(df, "k", "t", split.Split(100, 10)).orderBy("piece").first()
    assert first["text"].endswith(".\n\n")
    with pytest.raises(ValueError):
        split.Split(100, 60)


def test_chunk_numbers(spark):
    df = spark.createDataFrame([(1, 1, 1, 0, 0, "w " * 700), (1, 1, 1, 0, 0, "w " * 700), (2, 1, 1, 1, 1400, "v " * 700), (3, 1, 2, 0, 0, "short")], "chunk_id long, doc_id long, page_no int, chunk_ord int, char_start int, text_utf8 string")
    got = sorted(map(tuple, split.chunk_pieces(df).select("chunk_id", "chunk_ord", "char_start", "char_end").collect()))
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (2, 2), (2, 3)] and got[0][2:] == (0, 1200) and got[1][2] == 1000 and got[2][2] == 1400
    assert sorted(r["chunk_id"] for r in split.found(df).collect()) == [1, 2] and split.found(df.limit(0)).count() == 0


# -- wrong code pages

GERMAN = "Die größere Fläche überlagert die schöne Brücke, und die Prüfung zerstört das natürliche Gefäß für die nächste Größe. "
FRENCH = "La bibliothèque préserve la théorie générale à côté de l’école, où la pièce célèbre dépasse le résumé précis. "
PAGES = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "mac_roman")]


def test_round_trip(spark):
    rows, original = [], {}
    for n in range(240):
        text = (GERMAN if n % 2 else FRENCH) * 2
        seen = text
        if n < 6 * 3:
            wrote, read = PAGES[n % 6]
            seen = mojibake._decode(text.encode(wrote, "replace"), read)
            original[n] = text
        rows.append((n, f"/library/source{n % 5}/{n}.pdf", seen, seen[:80] if n % 7 else None, "clash"))
    rows += [(900, "/library/source1/f.pdf", "Let α ∈ Γ and β ≤ δ; then λα ± β² = 22. Øvre Sæld, ¿qué más? — £44", None, "x"), (901, None, None, None, None), (902, "/library/s/x.pdf", "", "", ""), (903, "/library/source2/x.pdf", "lost � here", None, "")]
    df = spark.createDataFrame(rows, "chunk_id long, path string, text_utf8 string, preview string, symbol string")
    found = {r["chunk_id"] for r in mojibake.found(df).collect()}
    assert found == {*original, 903}
    fixed = {r["chunk_id"]: r["text_utf8"] for r in mojibake.restored(df.unionByName(df.where("chunk_id < 3"))).collect()}
    same = sum(fixed[n] == t for n, t in original.items())
    assert same >= 0.8 * len(original) and fixed[903] == "lost � here"
    assert mojibake.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["cp1251", "koi8-r", "iso8859-5", "cp1253", "mac_cyrillic", "cp855", "ptcp154", None])
def test_pages_of_other_alphabets(spark, page):
    """Also pages that no list names: None is a made one with Georgian letters."""
    texts = ["Le résumé avant une étude dépasse la théorie générale et la pièce célèbre. ", "Die größere Fläche überlagert die schöne Brücke, die Prüfung zerstört das Gefäß. "]
    made = {ord(c): 0x10D0 + i for i, c in enumerate(mojibake.LETTERS) if c.isalpha()}
    wrong = [t.translate(made) if page is None else t.encode("cp1252").decode(page) for t in texts]
    good = [(n, "/library/a/g.pdf", (GERMAN if n % 2 else FRENCH) + texts[n % 2], None) for n in range(60)]
    bad = [(100 + n, f"/library/{n % 2}/b.pdf", t, None) for n, t in enumerate(wrong)]
    meant = [
        "Die Stаdt undеr thе lаntеrn, tһe sесоnd ѕаmрle οf the cοmmittee", "Δt and Δx of 5 μm, 3 kΩ, sinθ, 2πr", "Это русский текст, а не ошибка: йод, ёж и цирк", "слово word и слово", "Dvořák and Škoda", "a×b, x→y, m²s, l·l, 10 °C",
        "Ελληνικά γράμματα και word", "office ﬁle ｔｒａｉｔé",
    ]
    df = spark.createDataFrame(good + bad + [(200 + n, "/library/b/m.pdf", t, None) for n, t in enumerate(meant)], "chunk_id long, path string, text_utf8 string, preview string")
    assert {r["chunk_id"] for r in mojibake.found(df).collect()} == {100, 101}
    fixed = {r["chunk_id"]: r["text_utf8"] for r in mojibake.restored(df).collect()}
    if page == "cp1251":
        assert [fixed[100], fixed[101]] == texts


# -- packing


def test_pack_is_valid_and_tight():
    rng = np.random.default_rng(1)
    for _ in range(300):
        capacity = int(rng.integers(4, 60))
        size = rng.integers(0, capacity + 1, int(rng.integers(0, 90)))
        out = packing.pack(size, capacity)
        assert len(out) == len(size) and (not len(out) or (out.min() == 0 and np.bincount(out, size).max() <= capacity))
        large = np.bincount(out[size > capacity // 3]) if (size > capacity // 3).any() else np.zeros(1)
        assert large.max() <= 2
    size = np.minimum(2048, rng.lognormal(6, 1, 5000).astype(int))
    assert size.sum() / 2048 / (packing.pack(size, 2048).max() + 1) > 0.99


def test_every_document_has_a_place(spark):
    rows = [(1, 0), (2, 2048), (3, 2049), (4, 10_000), (5, 700), (6, 700), (7, 1), (8, 0), (7, 1)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("g", F.lit("clash"))
    got = packing.assign(df, packing.Packing()).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows} and sum(r["last_token"] - r["first_token"] for r in got) == sum(r[1] for r in rows)
    room = {}
    for r in got:
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["last_token"] - r["first_token"]
    assert max(room.values()) <= 2048
    assert all(r["piece"] == 0 for r in got if r["doc_id"] not in (3, 4)) and len([r for r in got if r["doc_id"] == 4]) == 5
    assert packing.assign(df.limit(0)).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in packing.sizes(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# -- leaks


def reference_distance(p, t):
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for x in t:
        cur = [0]
        for i in range(1, len(p) + 1):
            cur.append(min(prev[i] + 1, cur[i - 1] + 1, prev[i - 1] + (p[i - 1] != x)))
        prev, best = cur, min(best, cur[-1])
    return best


def test_distance():
    rnd = random.Random(1)
    for _ in range(2000):
        p, t = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 80))], [rnd.randint(0, 3) for _ in range(rnd.randint(0, 30))]
        assert leak.distance(p, t) == reference_distance(p, t)


def test_leaks(spark):
    item = "The quick brown fox, jumps over the lazy DOG while rain falls on green hills today."
    words = item.lower().replace(",", "").replace(".", "").split()
    n = len(words)
    half = -(-n // 2)
    docs = [
        (1, "xx " + " ".join(words[:half]) + " yy"), (2, " ".join(words[: half - 1])), (3, "a\x0c" + "\n".join(words[3:]).upper()), (4, " ".join([*words[:4], "cat", *words[5:]])), (5, None), (6, ""),
        (7, " ".join(words[:4] + ["odd"] + words[4:8])), (8, "zero " * 5000 + item), (9, " ".join(words[1 : half + 1])), (9, " ".join(words[1 : half + 1])),
    ]
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "one"), (10, item)], "item_id long, passage string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "distance": F.lit("clash")})
    got = {(r["doc_id"], r["item_id"]): r for r in leak.leaks(df, items).collect()}
    exact = {k for k, r in got.items() if r["run"] >= r["need"]}
    assert exact == {(1, 10), (3, 10), (4, 10), (8, 10), (9, 10)}
    assert got[7, 10]["distance"] == 1 and (2, 10) in got and got[2, 10]["distance"] == 1
    small = {(r["doc_id"], r["item_id"]) for r in leak.leaks(df, items, leak.Leak(block=1)).collect()}
    assert small == set(got)
    assert leak.leaks(df, items.limit(0)).count() == 0 and leak.leaks(df.limit(0), items).count() == 0


def test_leaks_equal_brute_force(spark):
    """Documents made of edited and exact parts of items, items of one word and items longer than a document."""
    rnd = random.Random(12)
    word = lambda: rnd.choice("ab cd ef gh ij kl".split())
    items = {i: [word() for _ in range(rnd.choice([1, 2, 3, 6, 7, 12, 13, 30]))] for i in range(24)}
    docs = {}
    for d in range(60):
        text = [word() for _ in range(rnd.randint(0, 12))]
        part = list(rnd.choice(list(items.values())))
        part = part[rnd.randint(0, 3) :]
        if part and rnd.random() < 0.7:
            at = rnd.randrange(len(part))
            part[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["zz"], ["zz", "yy"]])
        docs[d] = text + part + [word() for _ in range(rnd.randint(0, 5))]
    got = leak.leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, passage string"))
    expected = {}
    for d, text in docs.items():
        for i, w in items.items():
            need = -(-len(w) // 2)
            best = min(reference_distance(w[j : j + need], text) for j in range(len(w) - need + 1))
            if best <= 1 and (need > 1 or best == 0):
                expected[d, i] = best
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in got.collect()}
    assert {k: v for k, v in found.items() if v == 0} == {k: v for k, v in expected.items() if v == 0}
    long = {k for k in expected if len(items[k[1]]) > 2}
    assert {k for k in found if len(items[k[1]]) > 2} == long and all(found[k] == expected[k] for k in long)


# -- statistics

PROSE = "The committee revised the report in the spring, because the harbour had changed.\nIt was not an easy task, but the work of the clerks was careful and good.\n"
LIST = "".join(f"[{n}] Miller, A. and Brown. The old harbour, {n}(2), pp. {n}-99\n" for n in range(1, 20))
TABLE = "year\tnorth\tsouth\n" + "".join(f"{n}\t{n * 3.5}\t-\n" for n in range(1900, 1930))
JUNK = "x 4 k , 9 q z w 3 5 t\n" * 15


def test_statistics(spark):
    rows = [(n, "en", PROSE * 3, "ok") for n in range(60)] + [(100, "EN", LIST, "ok"), (101, "en-x", "A sentence first.\n" + TABLE, "ok"), (102, "en", JUNK, "ok"), (103, "en", PROSE * 9 + LIST[:120], "ok"), (104, "en", TABLE, "error"), (105, "en", None, "ok"), (106, None, "", "ok"), (107, "en", "1\t2\t3", "ok"), (108, "en", " \n\x0c ", "ok")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, status string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r["kind"] for r in quality.found(df).collect()}
    assert got == {100: "list", 101: "table", 102: "junk"}
    placed = {r["doc_id"]: r for r in quality.placed(quality.stats(df)).collect()}
    assert set(placed) == {r[0] for r in rows if r[2] is not None} and placed[100]["language"] == "en" and placed[106]["language"] == "und"
    assert placed[106]["n_words"] == 0 and placed[0]["n_words"] == len(PROSE.split()) * 3 and 0 <= placed[0]["common_share"] <= 1
    assert placed[100]["list_share_pct"] >= 0.9 and placed[100]["odd_share_z"] > 5
    assert quality.found(df.limit(0)).count() == 0


def test_forms_that_are_frequent_in_a_language(spark):
    rows = [(n, "de", TABLE if n % 3 == 0 else PROSE, "ok") for n in range(30)] + [(100, "fr", LIST, "ok"), (101, "es", PROSE, "ok")] + [(200 + n, None, JUNK if n else PROSE, "ok") for n in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, status string")
    got = {r["doc_id"]: r["kind"] for r in quality.found(df).collect()}
    assert got == {n: "table" for n in range(0, 30, 3)} | {100: "list", 201: "junk", 202: "junk", 203: "junk"}


def _mixed(share, n):
    """Running text of some thirty lines with a share of its lines as a list."""
    rnd = random.Random(n)
    words = "the of and harbour clerk report spring in was committee careful old easy with that had not task".split()
    lines = []
    for k in range(30):
        if k < share * 30:
            lines.append(f"[{k}] Miller, A. and Brown. The old harbour and the clerk of, {k}(2)")
        else:
            lines.append(" ".join(rnd.choices(words, k=11)) + (rnd.choice([".", ",", "", ""])))
    return "\n".join(lines)


def test_the_distribution_decides(spark):
    """The same document is in the tail of a collection of plain prose, and not where most documents hold long lists."""
    probe = (1000, "en", _mixed(0.6, 5), "ok")
    kinds = {}
    for name, shares in (("plain", [0.0, 0.03, 0.06]), ("full of lists", [0.0, 0.15, 0.3, 0.45])):
        rows = [(n, "en", _mixed(shares[n % len(shares)], n), "ok") for n in range(240)]
        df = spark.createDataFrame([*rows, probe], "doc_id long, lang string, text string, status string")
        kinds[name] = {r["doc_id"]: r["kind"] for r in quality.found(df).collect()}
    assert kinds == {"plain": {1000: "list"}, "full of lists": {}}


def test_scores_equal_those_of_exact_quantiles(spark):
    """Within what the sketch's rank error (0.2 %) leaves open; documents of the second language take all languages' scores."""
    rnd = random.Random(8)
    rows = [(n, "en" if n % 5 else "xx", _mixed(rnd.random() ** 3 * 0.6, n), "ok") for n in range(400)]
    measured = quality.stats(spark.createDataFrame(rows, "doc_id long, lang string, text string, status string"))
    got = quality.scored(measured, ("odd_share", "common_share")).toPandas()
    inside = got[(got.n_lines > 1) & (got.odd_share < 0.5)]
    for language, of in (("en", inside[inside.language == "en"]), ("xx", inside)):
        mine = got[got.language == language]
        for s in ("odd_share", "common_share"):
            middle, edge = np.quantile(of[s], [0.49, 0.51]), np.quantile(of[s], [0.98, 1])
            top = mine[mine[s] > np.quantile(of[s], 0.6)]
            bounds = [[(v - m) / max((e - m) / 2.326, 0.02) for m in middle for e in edge] for v in top[s]]
            assert len(top) and all(min(b) - 1e-6 <= x <= max(b) + 1e-6 for b, x in zip(bounds, top[f"{s}_z"]))


def test_statistics_do_not_depend_on_the_batch():
    texts = [PROSE, "", LIST, "x", TABLE, JUNK, "a\n\nb", " ", "é" * 1000]
    one = {k: [float(quality.doc_stats(*cp.to_codes(pa.array([t])))[k][0]) for t in texts] for k in quality.STATS}
    many = quality.doc_stats(*cp.to_codes(pa.array(texts)))
    assert all(np.allclose(one[k], many[k]) for k in quality.STATS)


# -- scanned pages


def one_edit(a, b):
    if a == b:
        return False
    for i in range(min(len(a), len(b)) + 1):
        for x in range(3):
            for y in range(3):
                if x + y and (x, y) != (2, 2) and a[:i] == b[:i] and a[i + x :] == b[i + y :] and i + x <= len(a) and i + y <= len(b):
                    u, v = a[i : i + x], b[i : i + y]
                    if (x, y) in ((1, 1), (0, 1), (1, 0)) or ((x, y) in ((1, 2), (2, 1)) and not set(u) & set(v)):
                        return True
    return False


def test_trie_finds_every_word_one_edit_away():
    rnd = random.Random(4)
    words = {"".join(rnd.choice("abcm") for _ in range(rnd.randint(1, 5))) for _ in range(150)}
    for trie in (ocr.Trie(words), ocr.Trie(words, back=True)):
        for _ in range(300):
            form = "".join(rnd.choice("abcm") for _ in range(rnd.randint(1, 5)))
            assert {w for w in words if one_edit(form, w)} == {w for w, _, _ in trie.near(form)}


def test_forms_meet_every_word_one_edit_away(spark):
    """By the letters at one of their ends, in small tries and with split keys."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcm") for _ in range(rnd.choice([2, 2, 3, 3, 4, 5, 6, 7, 8])))
    words, forms = sorted({word() for _ in range(500)}), sorted({word() for _ in range(250)})
    w = spark.createDataFrame([(x, 3) for x in words], "word string, n long")
    f = spark.createDataFrame([(x, 1, True) for x in forms], "form string, n long, scan boolean")
    expected = {(a, b) for a in forms for b in words if one_edit(a, b)}
    for shard in (2, 30, 20_000):
        rows = ocr.corrections(f, w, ocr.Ocr(shard=shard)).collect()
        assert {(r["form"], r["word"]) for r in rows} == expected and all(r["n_word"] == 3 and r["n_form"] == 1 for r in rows)
        assert all(r["form"] in {r["word"][:i] + r["read"] + r["word"][i + len(r["printed"]) :] for i in range(len(r["word"]) + 1)} for r in rows)


def test_a_misreading_is_learnt(spark):
    """q for g stands in no list; where it happens often it counts, and one chance neighbour doesn't."""
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abdefgiklmnoprstu") for _ in range(7)) + "g" + rnd.choice("aeiou") for _ in range(60)})
    rows = [(d, 1, " ".join(words)) for d in range(100, 150)]
    wrong = [w.replace("g", "q", 1) if "g" not in w[:-2] else w[:-2] + "q" + w[-1] for w in words]
    rows += [(k, 1, f"the eco-\nnomy of {w} here") for k, w in enumerate(wrong)] + [(90, 1, f"an eco-\nnomy of {words[0][:-1]}x")]
    rows += [(d, 1, "the name is " + words[k][:3] + "y" + words[k][4:]) for k, d in enumerate(range(150, 190))]  # variants of words, in scans and elsewhere
    rows += [(d, 1, "an eco-\nnomy and " + words[k][:4] + "y" + words[k][5:]) for k, d in enumerate(range(60, 90))]
    df = spark.createDataFrame([(n, d, p, 0, len(t.encode()), t) for n, (d, p, t) in enumerate(rows)], "chunk_id long, doc_id long, page_no int, char_start int, char_end int, text_utf8 string")
    documents = spark.createDataFrame([(d, "ok") for d in range(200)], "doc_id long, status string")
    got = {(r["doc_id"], r["word"]) for r in ocr.found(df, documents).where("kind = 'misread'").collect()}
    assert got == {(k, w) for k, w in enumerate(words)}


def test_words_count_by_document(spark):
    """However rows lie in partitions and batches; replays and overlapping windows add nothing."""
    rows = [(d, p, k * 50, k * 50 + 60, f"Wort{d % 3} steht, (hier) Seite{p}") for d in range(20) for p in (1, 2) for k in (0, 1)]
    schema = "doc_id long, page_no int, char_start int, char_end int, text_utf8 string"
    seen = set()
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([*rows, *rows[:30]], schema).repartition(7)):
        seen.add(frozenset((r["word"], r["n"]) for r in ocr.parts(df, ocr.Ocr()).where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).collect()))
    assert seen == {frozenset({("wort0", 7), ("wort1", 7), ("wort2", 6), ("steht", 20), ("hier", 20), ("seite1", 20), ("seite2", 20)})}


def test_neighbours_choose_between_words(spark):
    """'f1at' may be 'flat' or 'fiat': what stands beside it elsewhere decides, not the more frequent word."""
    rows = [(d, 1, "the red flat shines and a fiat sinks below") for d in range(100, 160)] + [(d, 1, "the flat is here") for d in range(170, 190)]
    rows += [(k, 1, "an eco-\nnomy of old fiat rusts there") for k in range(10, 14)] + [(k, 1, "an eco-\nnomy, the red flat shines") for k in range(20, 30)]
    rows += [(1, 1, "an eco-\nnomy the red f1at shines"), (2, 1, "an eco-\nnomy of old f1at rusts")]
    df = spark.createDataFrame([(n, d, p, 0, len(t.encode()), t) for n, (d, p, t) in enumerate(rows)], "chunk_id long, doc_id long, page_no int, char_start int, char_end int, text_utf8 string")
    documents = spark.createDataFrame([(d, "ok") for d in range(300)], "doc_id long, status string")
    got = {(r["doc_id"], r["word"]) for r in ocr.found(df, documents).where("kind = 'misread'").collect()}
    assert got == {(1, "flat"), (2, "fiat")}


@pytest.mark.parametrize(("line", "numbers"), [("118", [118]), ("[ll8]", [118]), ("- 1 -", [1]), ("p. 7", [7]), ("Page ll9", [119]), ("vii", [7]), ("118/124", [118]), ("cxviii", [118]), ("467 degrees.", []), ("Miller", []), ("G", [])])
def test_page_numbers(line, numbers):
    assert ocr.page_numbers(line) == numbers


def test_scan(spark):
    body = "the harbour report describes the archive of the municipal committee and the lattice of the northern valley"
    rows, n = [], 0
    for d in range(300, 500):  # clean documents give the vocabulary
        rows.append((n := n + 1, d, 1, 0, len(body), body))
    for page in range(1, 5):
        head = "THE ANNUAL REPORT" if page != 3 else "THE ANNUA1 REP0RT"
        name = ("first", "second", "third", "fourth")[page - 1]
        text = f"{head}   {page + 10}\n{name} words of the page\nthe harb0ur report descri­bes the arcbive\nof the munic-\nipal cornmittee and the cross-\nsectional lattice\nthe {name} closing line\nof the {name} valley"
        rows.append((n := n + 1, 1, page, 0, len(text.encode()), text))
    rows.append((n + 1, 141, 1, 0, 40, "a cross-sectional view of cross-sectional work"))
    rows += [rows[-2], (n + 5, 200, 1, 0, 0, ""), (n + 6, 201, 1, 0, 0, None), (n + 7, 202, None, None, None, "text-\nile")]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id long, page_no int, char_start int, char_end int, text_utf8 string").withColumns({"word": F.lit("clash"), "key": F.lit(1)})
    documents = spark.createDataFrame([(d, "ok") for d in range(1, 600)], "doc_id long, status string")
    got = {tuple(r) for r in ocr.found(df, documents).collect() if r["doc_id"] == 1}
    for page in range(1, 5):
        assert {(1, page, "header", ""), (1, page, "page_number", ""), (1, page, "misread", "harbour"), (1, page, "misread", "archive"), (1, page, "misread", "committee"), (1, page, "hyphen", "municipal"), (1, page, "hyphen", "cross-sectional")} <= got
    assert {g[3] for g in got if g[2] == "misread"} == {"harbour", "archive", "committee"}
    pages = {r["page_no"]: r["text"] for r in ocr.reflow(df).where("doc_id = 1").collect()}
    assert pages[3].startswith("third words of the page the harbour report") and "municipal committee and the cross-sectional lattice" in pages[3] and "\n" not in pages[3]
    assert ocr.found(df.limit(0), documents).count() == 0


def test_broken_words_at_the_edges_of_a_page(spark):
    body = "the strange economy of the municipal archive "
    rows = [(d, 1, 0, len(body), body) for d in range(300, 340)]
    rows += [(1, 1, 0, 20, "econ-\nomy of the muni-\nci"), (1, 1, 10, 40, "muni-\ncipal archive and str-\nange."), (2, 1, 0, 40, "a strange eco-\nnomy"), (2, 2, 30, 60, "mic-\nipal archive")]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "chunk_id long, doc_id long, page_no int, char_start int, char_end int, text_utf8 string")
    documents = spark.createDataFrame([(d, "ok") for d in range(600)], "doc_id long, status string")
    got = {tuple(r)[:2] + (r["word"],) for r in ocr.found(df, documents).where("kind = 'hyphen'").collect()}
    assert got == {(1, 1, "economy"), (1, 1, "strange"), (2, 1, "economy")}
    assert {r["page_no"]: r["text"] for r in ocr.reflow(df).where("doc_id = 2").collect()}[1] == "a strange economy"


def test_rare_words_of_the_same_document(spark):
    body = "the strange economy of the municipal archive "
    rows = [(d, 1, body) for d in range(300, 340)] + [(2, 1, "Kasbach and Holeran"), (3, 1, "Kasbach and Holeran")]
    rows += [(1, 1, "the strange eco-\nnomy of Kasbach and Toridin"), (1, 2, "the archive\nof Ka5bach and Holeron\nin To-\nriclin"), (4, 1, "the muni-\ncipal archive"), (4, 2, "economy of Vñlen9ard and Vñlengard, Toridin")]
    df = spark.createDataFrame([(n, *r[:2], 0, len(r[2].encode()), r[2]) for n, r in enumerate(rows)], "chunk_id long, doc_id long, page_no int, char_start int, char_end int, text_utf8 string")
    documents = spark.createDataFrame([(d, "ok") for d in range(600)], "doc_id long, status string")
    got = {tuple(r) for r in ocr.found(df, documents).where("doc_id < 10").collect()}
    assert {g for g in got if g[2] == "misread"} == {(1, 2, "misread", "kasbach"), (1, 2, "misread", "toridin"), (4, 2, "misread", "vñlengard")}
    assert (1, 2, "hyphen", "toridin") in got


def test_stitch():
    text = "é" * 50 + "abc" * 40
    data = text.encode()
    windows = [(0, 100, data[:100].decode()), (60, 160, data[60:160].decode()), (140, len(data), data[140:].decode())]
    assert ocr.stitch(windows[::-1]) == text and ocr.stitch([]) == ""


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, PROSE, "en", "ok"), (1, LIST, None, "ok"), (None, None, None, None), (2, PROSE, "en", "ok")], "doc_id long, text string, lang string, status string")
    items = spark.createDataFrame([(None, PROSE), (5, PROSE[:60])], "item_id long, passage string")
    assert (2, 5) in [(r["doc_id"], r["item_id"]) for r in leak.leaks(docs, items).collect()]
    assert {r["doc_id"] for r in packing.assign(packing.sizes(docs)).collect()} == {1, 2}
    assert quality.stats(docs).count() == 3 and quality.found(docs).count() >= 0
    rows = [(None, None, None, None, None, GERMAN, None, None), (1, None, 1, 0, 0, "x " * 900, "ab", "/library/a/x.pdf"), (None, 3, None, None, None, "y " * 900, "Ã¼ber", None)]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id long, page_no int, chunk_ord int, char_start int, text_utf8 string, preview string, path string").withColumn("char_end", F.lit(None).cast("int"))
    assert [r["chunk_id"] for r in split.found(df).where("chunk_id IS NOT NULL").collect()] == [1] and split.chunk_pieces(df).count() >= 2
    assert mojibake.found(df).count() >= 0 and mojibake.restored(df).count() >= 0
    assert ocr.found(df, docs).count() >= 0 and ocr.reflow(df).count() >= 0
