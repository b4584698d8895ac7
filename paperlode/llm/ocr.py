"""Text from scanned pages: broken words, misread characters, running lines and page numbers; reflowed pages.

Chunks are read by stretches of a document's pages for lines at the head and foot of pages, words broken over a line
end, and the number of documents that use a word. Running lines are keys that come back on other pages of a document,
where a key folds characters that recognition mixes up, so a misread copy has the same key; page numbers keep their
distance to the page on other pages.

Misread words are looked up by intersecting a Levenshtein automaton, with merges and splits (Schulz and Mihov 2002),
with tries of all words of the collection. One edit leaves a word's beginning or its end untouched, so words and forms
meet by those letters: each trie holds words that begin alike, or reversed words that end alike, and every word one edit
away is found. Which edits are misreadings is learnt: in forms that have a far more frequent neighbour, misread
characters make the same edit again and again, while names and inflections spread over all edits of a kind, and the
rare words of documents that aren't scans don't make it. Candidates
by such an edit are weighed by its frequency, the word's, the use of the word in the same document, and, where
several remain, by how often they stand beside the form's neighbours.

Null and empty texts give nothing. Replayed chunks and overlapping windows add nothing: results are distinct.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

# What recognition is known to read (right) for what was printed (left): the prior of the learnt model.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("i", "!"), ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"), ("o", "0"), ("a", "o"), ("s", "5"), ("t", "f"), ("g", "9"),
    ("h", "b"), ("b", "6"), ("y", "v"), ("z", "2"), ("n", "ri"), ("u", "ii"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("rn", "m"), ("cl", "d"),
)
# Marks of a word that goes on in the next line.
DASHES = "-‐­¬"


@dataclass(frozen=True)
class Ocr:
    """``ratio``: times a word must be more frequent than its misread form, unless the same document uses it; ``odds``: times
    an edit must be more frequent than the mean rarer edit of its kind to be a misreading; ``contrast``: times it must be
    more frequent among rare words of scans than among those of other documents; ``known``: the same, as what an edit
    known beforehand counts in addition; ``lines``: lines at head and foot looked at; ``shard``: words of a trie;
    ``stretch``: pages of a document that one task reads together, and whose use of a word counts once."""

    ratio: int = 20
    odds: float = 20.0
    contrast: float = 10.0
    known: float = 20.0
    lines: int = 2
    shard: int = 5_000
    stretch: int = 64


_EDGE = re.compile(r"^[^\w!]+|\W+$")
_BREAK = re.compile(rf"[{DASHES}][ \t]*\n[ \t]*(?=\w)")
_END = re.compile(r"\s|$")
_WORD_CHAR = re.compile(r"\w")
# Usual marks around words; ``!`` in front may be a misread i.
_AROUND = ".,;:?()[]{}\"'’‘“”„«»…*–—-"
_SPLIT_NUMBER = re.compile(r"^(?:(?P<a>\S{1,9})\s{2,}(?P<t1>.*\S)|(?P<t2>.*\S)\s{2,}(?P<b>\S{1,9}))$")
_NUMBER = re.compile(r"^(?i:(?:page|p\.|seite|s\.|página|pág\.|pagina)\s*)?[\[\(\-–—\s]*([0-9lIi!|oOsSbgzZ]{1,5})(?:\s*/\s*[0-9lIi!|oOsSbgzZ]{1,5})?[\]\)\-–—\s.]*$")
_ROMAN = re.compile(r"^[\[\(\-–—\s]*([ivxlcdm!1]{1,9})[\]\)\-–—\s.]*$", re.I)
_DIGITS = str.maketrans("lIi!|oOsSbgzZ", "1111100556922"[:13])
_FOLD = str.maketrans("l1!c0a5f9b6vy2", "iiieoostghhyyz")
_FOLD |= {ord(c): None for c in DASHES}


def strip(token: str) -> str:
    """A token in lower case without the punctuation around it; a mark that may be a misread i stays in front."""
    token = token.lower()
    if not (token[:1].isalnum() and token[-1:].isalnum()):
        token = token.strip(_AROUND)
        if not (token[:1].isalnum() and token[-1:].isalnum()):
            return _EDGE.sub("", token)
    return token


def breaks(text: str) -> list[tuple[int, int, int, int]]:
    """(start, mark, next line, end) of words broken over a line end: a word, a mark, a line feed, the rest of the word."""
    out, free = [], 0
    for m in _BREAK.finditer(text):
        mark = start = m.start()
        if mark <= free or not _WORD_CHAR.match(text[mark - 1]):
            continue
        while start > free and not text[start - 1].isspace():
            start -= 1
        free = _END.search(text, m.end()).start()
        out.append((start, mark, m.end(), free))
    return out


def skeleton(line: str) -> str:
    """Letters of a line with everything that recognition mixes up folded together."""
    text = line.lower().translate(_FOLD).replace("w", "yy")
    for read, printed in (("ri", "n"), ("rn", "m"), ("ei", "d"), ("ii", "u")):
        text = text.replace(read, printed)
    return "".join(filter(str.isalpha, text))


def roman(text: str) -> int | None:
    """Value of a well-formed roman numeral."""
    value, last = 0, 0
    for c in reversed(text.lower()):
        n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.get(c)
        if n is None:
            return None
        value += n if n >= last else -n
        last = max(last, n)
    back, rest = "", value
    for n, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while rest >= n:
            back, rest = back + s, rest - n
    return value if back == text.lower() else None


def page_numbers(text: str) -> list[int]:
    """What the text may mean as a page number, arabic or roman, misread digits included."""
    out = []
    if m := _NUMBER.match(text):
        digits = m[1].translate(_DIGITS)
        if any(c.isdigit() for c in m[1]) or len(m[1]) <= 3:
            out.append(int(digits))
    if (m := _ROMAN.match(text)) and not m[1].isdigit():
        for form in {m[1], m[1].replace("!", "i"), m[1].replace("1", "l"), m[1].replace("!", "i").replace("l", "i"), m[1].replace("1", "i")}:
            if (n := roman(form)) is not None:
                out.append(n)
    return list(dict.fromkeys(out))


def line_parts(line: str) -> tuple[str, list[int]]:
    """(key of the running text or '', possible page numbers) of a line at head or foot."""
    line = line.strip()
    if numbers := page_numbers(line):
        return "", numbers
    if m := _SPLIT_NUMBER.match(line):
        number, text = (m["a"], m["t1"]) if m["a"] else (m["b"], m["t2"])
        if numbers := page_numbers(number):
            return skeleton(text), numbers
    return skeleton(line), []


def _solid(line: str) -> bool:
    """Not blank and not the specks of a dirty scan."""
    return sum(map(str.isalnum, line)) * 2 >= max(1, len(line.replace(" ", "")) - 4)


def _first_solid(lines: Iterable[str], n: int) -> list[str]:
    return list(islice((x for x in lines if not x.isspace() and x and _solid(x)), n))


def edges(text: str, head: bool, n: int) -> list[tuple[bool, str, list[int]]]:
    """(head, key, numbers) of the first n lines (only if the text begins the page) and the last n."""
    lines = text.split("\n")
    out = [(True, *line_parts(x)) for x in _first_solid(lines, n)] if head else []
    return out + [(False, *line_parts(x)) for x in _first_solid(reversed(lines), n)[::-1]]


def broken_words(text: str, head: bool) -> list[tuple[str, str, bool]]:
    """(left, right, last) of words broken over a line end; one at the text's start is left out unless the text begins
    the page (``head``), as it may be cut; so may one that ends the text (``last``), unless the text ends the page."""
    out = []
    for start, mark, begin, end in breaks(text):
        if start == 0 and not head:
            continue
        left, right = strip(text[start:mark] + "x")[:-1], strip("x" + text[begin:end])[1:]
        if left and right and right[0].isalpha() and left[-1].isalpha():
            out.append((left, right, end == len(text)))
    return out


_PART = "doc_id long, page_no int, char_end int, head array<struct<key:string,numbers:array<int>>>, foot array<struct<key:string,numbers:array<int>>>, broken array<struct<l:string,r:string,last:boolean>>, word string, n int"


def parts(chunks: DataFrame, spec: Ocr) -> DataFrame:
    """Rows of pages' edges and broken words (word is null), and rows of words with the documents that use them.

    A stretch of a document's pages comes to one task in order, so its words count once, and a document of any length
    spreads over tasks; a document longer than a stretch counts once for each.
    """
    kind = pa.list_(pa.struct([("key", pa.string()), ("numbers", pa.list_(pa.int32()))]))
    pair = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string()), ("last", pa.bool_())]))
    types = (pa.int64(), pa.int32(), pa.int32(), kind, kind, pair, pa.string(), pa.int32())
    names = ["doc_id", "page_no", "char_end", "head", "foot", "broken", "word", "n"]

    def pages(rows: list[tuple]) -> pa.RecordBatch:
        columns = [*zip(*rows), [None] * len(rows), [None] * len(rows)] if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def counts(count: Counter) -> pa.RecordBatch:
        none = [pa.nulls(len(count), t) for t in types[:6]]
        return pa.RecordBatch.from_arrays([*none, pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int32())], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        now, before = None, None
        tokens: set[str] = set()
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if row == before:
                    continue
                before = row
                doc, stretch, page, start, end, text = row
                if (doc, stretch) != now:
                    count.update({strip(t) for t in tokens})
                    tokens, now = set(), (doc, stretch)
                    if len(count) > 100_000:
                        count.pop("", None)
                        yield counts(count)
                        count.clear()
                tokens.update(text.lower().split())
                e = edges(text, start == 0, spec.lines)
                pack = lambda side, e=e: [{"key": k, "numbers": v} for h, k, v in e if h == side and (v or len(k) >= 8)]
                b = [{"l": x, "r": y, "last": z} for x, y, z in broken_words(text, start == 0)]
                rows.append((doc, page, end, pack(True), pack(False), b))
            yield pages(rows)
        count.update({strip(t) for t in tokens})
        count.pop("", None)
        yield counts(count)

    keys = ["doc_id", "stretch"]
    rows = chunks.where("text_utf8 IS NOT NULL").select("doc_id", F.floor(F.col("page_no") / spec.stretch).alias("stretch"), "page_no", "char_start", "char_end", "text_utf8")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "page_no", "char_start", "char_end").mapInArrow(run, _PART)


def furniture(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page_no, key) of running lines and (doc_id, page_no) of page numbers, from the edges of pages.

    A line runs if its key is at the same edge of another page of the document; a number counts if its distance
    to the page's number is that of another page's. Both are counts by key: no document's pages are collected.
    """
    pages = found.where("word IS NULL")
    heads = pages.select("doc_id", "page_no", F.lit(True).alias("top"), F.explode("head").alias("e"))
    last = pages.groupBy("doc_id", "page_no").agg(F.max_by("foot", "char_end").alias("foot"))
    feet = last.select("doc_id", "page_no", F.lit(False).alias("top"), F.explode("foot").alias("e"))
    lines = heads.unionByName(feet).select("doc_id", "page_no", "top", "e.key", "e.numbers").distinct()
    keyed = lines.where(F.length("key") >= 8).select("doc_id", "page_no", "top", "key").distinct()
    many = keyed.groupBy("doc_id", "top", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    running = keyed.join(many, ["doc_id", "top", "key"]).select("doc_id", "page_no", "key").distinct()
    numbers = lines.select("doc_id", "page_no", "top", F.explode("numbers").alias("offset")).withColumn("offset", F.col("offset") - F.col("page_no")).distinct()
    steady = numbers.groupBy("doc_id", "offset").agg(F.count_distinct("page_no").alias("n")).where("n > 1")
    numbered = numbers.join(steady, ["doc_id", "offset"]).select("doc_id", "page_no").distinct()
    return running, numbered


class Trie:
    """Words as nested dictionaries; the empty key marks a word's end. ``back``: words are spelled from their end."""

    def __init__(self, words: Iterable[str], back: bool = False) -> None:
        self.root: dict = {}
        self.back = back
        for w in words:
            node = self.root
            for c in w[::-1] if back else w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, form: str, first: int = 0, last: int | None = None) -> set[tuple[str, str, str]]:
        """(word, printed, read) of every word one edit from the form: a substitution, insertion or deletion, two
        characters read for one, or one for two. The edit begins at the letters ``first`` to ``last`` of the form (from
        its end, if the trie is spelled so). Complete: all paths of the automaton through the trie are taken."""
        text = form[::-1] if self.back else form
        n = len(text)
        out: set[tuple[str, str, str]] = set()

        def rest(node: dict | None, i: int, printed: str, read: str) -> None:
            while node is not None and i < n:
                node = node.get(text[i])
                i += 1
            if node and (w := node.get("")) and w != form:
                out.add((w, printed[::-1], read[::-1]) if self.back else (w, printed, read))

        node: dict | None = self.root
        for i in range(n + 1):
            if i >= first:
                read, two = text[i : i + 1], text[i : i + 2]
                for c, child in node.items():
                    if not c:
                        continue
                    if read and c != read:
                        rest(child, i + 1, c, read)
                    rest(child, i, c, "")
                    if len(two) == 2 and c not in two:
                        rest(child, i + 2, c, two)
                    if read:
                        for d, grandchild in child.items():
                            if d and c != read and d != read:
                                rest(grandchild, i + 1, c + d, read)
                if read:
                    rest(node, i + 1, "", read)
            if i == n or i == last or (node := node.get(text[i])) is None:
                break
        return out


def _kept(length: Column) -> Column:
    """Letters at one end of a word by which it is found."""
    return F.when(length < 6, 1).otherwise(2)


def meeting(forms: DataFrame, words: DataFrame, spec: Ocr) -> tuple[DataFrame, DataFrame]:
    """Forms and words under the keys by which a form meets every word one edit away: letters at the beginning or the end.

    An edit takes up to two neighbouring letters of the form and of the word. With k letters kept, one that touches the
    first k leaves the last k alone if the form is longer than 2k, or, with k = 1, longer than what the edit reads: words
    of six letters and more keep two, others one. A form goes to the keys of all lengths that its words may have. A key
    with many words or forms is split: words by ``shard``, forms by ten times as many, every part meeting every part.
    """
    key = lambda t, k, back: F.concat(F.lit("<" if back else ">"), k.cast("string"), F.substring(t, -k, k) if back else F.substring(t, F.lit(1), k))
    size = F.length("text")
    ends = lambda k: F.array(key(F.col("text"), k, False), key(F.col("text"), k, True))
    w = words.select(F.col("word").alias("text"), F.col("n")).select("text", "n", F.explode(ends(_kept(size))).alias("key"))
    f = forms.select(F.col("form").alias("text"), "n", "scan").select("text", "n", "scan", F.explode(F.array_distinct(F.flatten(F.array(ends(_kept(size - 1)), ends(_kept(size + 1)))))).alias("key"))
    total = lambda rows, name, part: rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias(name))
    split = total(w, "ws", spec.shard).join(total(f, "fs", 10 * spec.shard), "key").where("ws > 1 OR fs > 1")
    part = lambda n: F.pmod(F.xxhash64("text"), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    ws, fs = F.col("ws"), F.col("fs")
    w = w.join(split, "key", "left").withColumns({"wp": part(ws)}).withColumn("fp", each(fs))
    f = f.join(split, "key", "left").withColumns({"fp": part(fs)}).withColumn("wp", each(ws))
    return f.select("key", "wp", "fp", "text", "n", "scan"), w.select("key", "wp", "fp", "text", "n")


def corrections(forms: DataFrame, words: DataFrame, spec: Ocr) -> DataFrame:
    """(form, word, printed, read, n_form, n_word, scan): every word of (word, n) one edit from a form of (form, n, scan)."""
    f, w = meeting(forms, words, spec)
    buckets = max(1, -(-2 * words.count() // spec.shard))
    bucket = F.pmod(F.xxhash64("key", "wp", "fp"), F.lit(buckets)).alias("bucket")

    def look(f: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple] = set()
        count = dict(zip(w["text"], w["n"]))
        for back in (False, True):
            mine = w["key"].str.startswith("<" if back else ">")
            tries = {k: Trie(set(t), back) for k, t in w[mine].groupby("key")["text"]}
            for key, form, n, scan in zip(f["key"], f["text"], f["n"], f["scan"]):
                if (trie := tries.get(key)) is not None:
                    k = int(key[1])
                    for word, printed, read in trie.near(form, max(k, len(form) - k - 1) if back else k):
                        out.add((form, word, printed, read, n, count[word], scan))
        return pd.DataFrame(list(out), columns=["form", "word", "printed", "read", "n_form", "n_word", "scan"])

    # as many partitions as buckets: little data, but work
    spread = lambda rows: rows.repartition(buckets, "bucket").groupBy("bucket")
    found = spread(f.select(bucket, "key", "text", "n", "scan")).cogroup(spread(w.select(bucket, "key", "text", "n"))).applyInPandas(look, "form string, word string, printed string, read string, n_form long, n_word long, scan boolean")
    return found.distinct()


def confusions(near: DataFrame, sizes: DataFrame, spec: Ocr) -> DataFrame:
    """(printed, read, w): edits that are misreadings, learnt from pairs as :func:`corrections` gives them; w their weight.

    Expectation-maximization over forms of scans with a word ``spec.ratio`` times as frequent: a form's share in each of
    its edits is in proportion to the edits' counts. An edit of a kind (letters printed and read) counts as a misreading
    if it is ``spec.odds`` times as frequent as the rarer edits of the kind are on average, and among rare forms
    ``spec.contrast`` times as frequent as in other documents; edits known beforehand have a start. ``sizes``: one row, the
    number of scans (n_scan) and other documents (n_other). The number of edits is bounded by the letters in use,
    whatever the number of texts.
    """
    edit = ["printed", "read"]
    clear = near.where(F.col("n_word") >= spec.ratio * F.greatest("n_form", F.lit(1))).where("word NOT RLIKE '[0-9!]'")
    clear = written(clear.groupBy("scan", "form", *edit).agg(F.min("n_form").alias("n_form")))
    scans = clear.where("scan")
    share = scans.join(scans.groupBy("form").agg(F.count(F.lit(1)).alias("m")), "form").withColumn("q", 1 / F.col("m"))
    for _ in range(2):
        count = written(share.groupBy(*edit).agg(F.sum("q").alias("a")))  # a row for each edit
        weighed = scans.join(count, edit)
        share = weighed.join(weighed.groupBy("form").agg(F.sum("a").alias("m")), "form").withColumn("q", F.col("a") / F.col("m"))
    own = share.groupBy(*edit).agg(F.sum("q").alias("a"), F.sum(F.when(F.col("n_form") <= 2, F.col("q"))).alias("mine"))
    theirs = clear.where("NOT scan").groupBy(*edit).agg(F.count(F.lit(1)).alias("theirs"))
    known = clear.sparkSession.createDataFrame([(a, b, True) for a, b in CONFUSIONS], "printed string, read string, listed boolean")
    listed = F.coalesce("listed", F.lit(False))
    kind = [F.length("printed").alias("lp"), F.length("read").alias("lr")]
    count = own.join(known, edit, "full_outer").join(theirs, edit, "left").select(*edit, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("mine", F.lit(0.0)).alias("mine"), F.coalesce("theirs", F.lit(0)).alias("theirs"), listed.alias("listed"), *kind)
    rarer = Window.partitionBy("lp", "lr").orderBy(F.round(F.col("a") * 1000).cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    mean = F.greatest(F.coalesce(F.avg(F.when(~F.col("listed"), F.col("a"))).over(rarer), F.lit(0.0)), F.lit(0.5))
    weight = F.col("a") + F.when(F.col("listed"), F.lit(spec.known) * F.col("mean")).otherwise(0.0)
    rows = count.withColumn("mean", mean).withColumn("w", weight).where(F.col("w") >= F.lit(spec.odds) * F.col("mean")).crossJoin(F.broadcast(sizes))  # one row
    return rows.where(F.col("listed") | (F.col("n_other") == 0) | (F.col("mine") * F.col("n_other") >= F.lit(spec.contrast) * (F.col("theirs") + 0.5) * F.col("n_scan"))).select(*edit, "w")


def _tokens(chunks: DataFrame, spec: Ocr) -> DataFrame:
    """(doc_id, page_no, key, form, before, after): words of each chunk with hashes of a word before and one after it; key
    is that of the line where it may be a running one.

    Words broken over a line end and words cut by the window's edges are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple, tuple] = {}
            for doc, page, start, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at, left = 0, []
                for a, _, _, b in breaks(text):
                    left.append(text[at:a])
                    at = b
                text = "\n".join([*left, text[at:]])
                cut = text.split(" ", 1)[1] if start and " " in text[:60] else text
                solid = [x for x in cut.split("\n") if x.strip() and _solid(x)]
                marked = {x: line_parts(x)[0] for x in solid[: spec.lines] + solid[-spec.lines :]}
                words = [(marked.get(line), strip(token)) for line in solid for token in line.split()]
                forms = ["", *(form for _, form in words), ""]
                for i, (key, form) in enumerate(words):
                    if len(form) > 1 and any(map(str.isalpha, form)):
                        out.setdefault((doc, page, key, form), (forms[i], forms[i + 2]))
            columns = [*zip(*out), *zip(*out.values())] if out else [()] * 6
            kinds = (pa.int64(), pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "page_no", "key", "form", "before", "after"])

    rows = chunks.where("text_utf8 IS NOT NULL").select("doc_id", "page_no", "char_start", "text_utf8").mapInArrow(run, "doc_id long, page_no int, key string, form string, before string, after string")
    return rows.groupBy("doc_id", "page_no", "key", "form").agg(F.min(F.xxhash64("before")).alias("before"), F.min(F.xxhash64("after")).alias("after"))


@dataclass
class Repairs:
    """What is wrong on the pages of scans."""

    running: DataFrame  # doc_id, page_no, key
    numbered: DataFrame  # doc_id, page_no
    broken: DataFrame  # doc_id, page_no, l, r, word
    misread: DataFrame  # doc_id, page_no, form, word


def repairs(chunks: DataFrame, spec: Ocr = Ocr()) -> Repairs:
    """Everything found on the pages of ``chunks`` (active rows)."""
    found = written(parts(chunks, spec))
    running, numbered = (written(x) for x in furniture(found))
    words = written(found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    pages = found.where("word IS NULL")
    ends = pages.groupBy("doc_id", "page_no").agg(F.max("char_end").alias("char_end"))
    broken = pages.select("doc_id", "page_no", "char_end", F.explode("broken").alias("b")).select("doc_id", "page_no", "char_end", "b.*")
    whole = broken.where("NOT last").unionByName(broken.where("last").join(ends, ["doc_id", "page_no", "char_end"], "left_semi"))
    pairs = written(whole.select("doc_id", "page_no", "l", "r").distinct())

    # documents with furniture or broken words are scans; only their words are looked at
    scans = running.select("doc_id").unionByName(numbered.select("doc_id")).unionByName(pairs.select("doc_id")).distinct()
    tokens = written(_tokens(chunks.join(scans, "doc_id", "left_semi"), spec))
    head = running.select("doc_id", "key").distinct()
    body = written(tokens.join(head, ["doc_id", "key"], "left_anti").groupBy("doc_id", "page_no", "form").agg(F.min("before").alias("before"), F.min("after").alias("after")))

    joined = pairs.select("doc_id", "page_no", "l", "r", F.concat("l", "r").alias("one"), F.concat("l", F.lit("-"), "r").alias("two"))
    forms = body.select("form").unionByName(joined.select(F.col("one").alias("form"))).distinct()
    scan = forms.withColumnRenamed("form", "word").withColumn("scan", F.lit(True))
    seen = words.join(scan, "word", "full_outer").select(F.col("word").alias("form"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("scan", F.lit(False)).alias("scan"))
    most = words.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]  # a form that frequent can't be misread
    looked = written(seen.where((F.col("n") * spec.ratio <= most) & (F.col("scan") | (F.col("n") <= 2) & F.expr("length(form) > 1 AND form RLIKE '[^0-9]'"))))
    # a word counts if it is frequent, or used in a scan; for the rare words of other documents only frequent ones do
    known = written(words.where("length(word) > 1 AND word RLIKE '[^0-9]'").join(tokens.select(F.col("form").alias("word"), F.lit(True).alias("used")).distinct(), "word", "left").where(F.col("used") | (F.col("n") >= spec.ratio)))
    near = written(corrections(looked.where("scan"), known, spec).unionByName(corrections(looked.where("NOT scan"), known.where(F.col("n") >= spec.ratio), spec)))
    docs = pages.select("doc_id").distinct().join(scans.withColumn("scan", F.lit(True)), "doc_id", "left")
    sizes = docs.agg(F.count("scan").alias("n_scan"), F.count_if(F.col("scan").isNull()).alias("n_other"))
    scanned = near.where("scan")
    fixed = written(scanned.join(confusions(near, sizes, spec), ["printed", "read"]).groupBy("form", "word").agg(F.max("w").alias("w"), F.first("n_form").alias("n_form"), F.first("n_word").alias("n_word")))

    # a word must be far more frequent, or the document uses it elsewhere, running lines included
    used = tokens.select("doc_id", F.col("form").alias("word")).distinct().withColumn("here", F.lit(True))
    rare = "n_form <= 2 AND (n_word > n_form OR n_word = n_form AND form RLIKE '[0-9!]' AND word NOT RLIKE '[0-9!]')"

    def choices(rows: DataFrame) -> DataFrame:
        all_of = rows.join(fixed, "form").join(used, ["doc_id", "word"], "left").withColumn("here", F.coalesce("here", F.lit(False)))
        return all_of.where((F.col("n_word") >= spec.ratio * F.greatest("n_form", F.lit(1))) | F.col("here") & F.expr(rare))

    score = F.log("w") + F.log("n_word") + F.when(F.col("here"), 3.0).otherwise(0.0)
    best = lambda rows, keys, s: rows.groupBy(*keys).agg(F.max_by("word", F.struct(s.alias("s"), "word")).alias("word"))
    key = ["doc_id", "page_no", "form"]
    options = written(choices(body))
    several = options.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    if several.limit(1).count():
        # which of them stands beside the same neighbours elsewhere
        open_ = options.join(several, key)
        beside = lambda c: body.groupBy(F.col("form").alias("word"), c).agg(F.count(F.lit(1)).alias(f"n_{c}"))
        weighed = open_.join(beside("before"), ["word", "before"], "left").join(beside("after"), ["word", "after"], "left")
        context = 2 * F.log1p(F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0)))
        misread = best(options.join(several, key, "left_anti"), key, score).unionByName(best(weighed, key, score + context))
    else:
        misread = options.select(*key, "word")
    count = lambda c: words.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    weighed = joined.join(count("one"), "one", "left").join(count("two"), "two", "left").na.fill(0, ["n_one", "n_two"])
    better = best(choices(joined.select("doc_id", F.col("one").alias("form")).distinct()), ["doc_id", "form"], score).select("doc_id", F.col("form").alias("one"), F.col("word").alias("fixed"))
    broken = weighed.join(better, ["doc_id", "one"], "left").select(
        "doc_id", "page_no", "l", "r", F.when(F.col("n_two") > F.col("n_one"), F.col("two")).otherwise(F.coalesce("fixed", "one")).alias("word"), F.col("fixed").isNotNull().alias("misread")
    )
    return Repairs(running, numbered, broken, misread)


def found(chunks: DataFrame, documents: DataFrame, spec: Ocr = Ocr()) -> DataFrame:
    """(doc_id, page_no, kind, word), see TESTDATA.md; documents with status ok."""
    r = repairs(chunks, spec)
    row = lambda df, kind, word: df.select("doc_id", "page_no", F.lit(kind).alias("kind"), word.alias("word"))
    both = r.broken.where("misread")
    rows = (
        row(r.broken, "hyphen", F.col("word"))
        .unionByName(row(r.misread, "misread", F.col("word")))
        .unionByName(row(both, "misread", F.col("word")))
        .unionByName(row(r.running, "header", F.lit("")))
        .unionByName(row(r.numbered, "page_number", F.lit("")))
        .distinct()
    )
    return rows.join(documents.where("status = 'ok'").select("doc_id"), "doc_id", "left_semi")


def stitch(windows: list[tuple[int, int, str]]) -> str:
    """The page's text from overlapping (char_start, char_end, text) windows with byte offsets."""
    out, end = b"", 0
    for start, _, text in sorted(windows):
        data = text.encode()
        if not out:
            out, end = data, start + len(data)
        elif start + len(data) > end:
            out += data[max(0, end - start) :]
            end = start + len(data)
    return out.decode("utf-8", "replace")


def reflow_page(text: str, running: set[str], numbered: bool, broken: dict[tuple[str, str], str], misread: dict[str, str], n: int) -> str:
    """Paragraphs of a page without furniture, with whole and corrected words; a blank line parts paragraphs."""
    lines = text.split("\n")
    shown = [i for i, x in enumerate(lines) if x.strip()]
    solid = [i for i in shown if _solid(lines[i])]
    drop = {i for i in shown if i not in set(solid) and (i in shown[:3] or i in shown[-3:])}
    for i in {*solid[:n], *solid[-n:]}:
        key, numbers = line_parts(lines[i])
        if key in running or (not key and numbers and numbered):
            drop.add(i)
    body = "\n".join("" if i in drop and i in (shown[:1] + shown[-1:]) else x for i, x in enumerate(lines) if i not in drop or i in (shown[:1] + shown[-1:]))

    def whole(first: str, second: str) -> str | None:
        left, right = strip(first + "x")[:-1], strip("x" + second)[1:]
        word = broken.get((left, right))
        if word is None:
            return None
        printed = first + second
        low = left + right
        if word in (low, f"{left}-{right}"):
            return (first + "-" + second if "-" in word[len(left) : len(left) + 1] else printed) + "\n"
        at = printed.lower().find(low)
        return (printed[:at] + _cased(printed[at : at + len(low)], word) + printed[at + len(low) :] if at >= 0 else printed) + "\n"

    at, out = 0, []
    for start, mark, begin, end in breaks(body):
        if (word := whole(body[start:mark], body[begin:end])) is not None:
            out += [body[at:start], word]
            at = end
    body = "".join(out) + body[at:]

    def fix(m: re.Match) -> str:
        form = strip(m[0])
        word = misread.get(form)
        if word is None:
            return m[0]
        at = m[0].lower().find(form)
        return m[0][:at] + _cased(m[0][at : at + len(form)], word) + m[0][at + len(form) :]

    body = re.sub(r"\S+", fix, body)
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", body)]
    return "\n\n".join(p for p in paragraphs if p and _solid(p))


def _cased(printed: str, word: str) -> str:
    if printed.isupper() and len(printed) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if printed[:1].isupper() else word


def reflow(chunks: DataFrame, spec: Ocr = Ocr()) -> DataFrame:
    """(doc_id, page_no, text): every page with text of a scanned document, repaired, as continuous paragraphs."""
    r = repairs(chunks, spec)
    keys = ["doc_id", "page_no"]
    scans = r.running.select("doc_id").unionByName(r.numbered.select("doc_id")).unionByName(r.broken.select("doc_id")).distinct()
    pages = (
        chunks.where("text_utf8 IS NOT NULL").select(*keys, "char_start", "char_end", "text_utf8").join(scans, "doc_id", "left_semi")
        .groupBy(*keys).agg(F.collect_set(F.struct("char_start", "char_end", "text_utf8")).alias("windows"))
        .join(r.running.groupBy(*keys).agg(F.collect_set("key").alias("running")), keys, "left")
        .join(r.numbered.withColumn("numbered", F.lit(True)), keys, "left")
        .join(r.broken.groupBy(*keys).agg(F.collect_list(F.struct("l", "r", "word")).alias("broken")), keys, "left")
        .join(r.misread.groupBy(*keys).agg(F.collect_list(F.struct("form", "word")).alias("misread")), keys, "left")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for row in batch.select(["windows", "running", "numbered", "broken", "misread"]).to_pylist():
                text = stitch([(w["char_start"], w["char_end"], w["text_utf8"]) for w in row["windows"]])
                broken = {(b["l"], b["r"]): b["word"] for b in row["broken"] or ()}
                texts.append(reflow_page(text, set(row["running"] or ()), bool(row["numbered"]), broken, {m["form"]: m["word"] for m in row["misread"] or ()}, spec.lines))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page_no"), pa.array(texts, pa.string())], ["doc_id", "page_no", "text"])

    return pages.mapInArrow(run, "doc_id long, page_no int, text string")
