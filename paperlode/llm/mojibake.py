"""Text decoded with a wrong code page: found and restored as a substitution cipher.

Symbols are the non-ASCII characters of a text, or the groups of two to eight that one character may have become.
For each source the mapping from symbols to letters is unknown; expectation-maximization learns it from the
symbols' neighbours and from the letter bigrams of the whole corpus: the posterior of letter x for symbol s
between l and r is proportional to theta(x | s) * N(l, x) * N(x, r) / N(x), and theta is re-estimated from the
posteriors. "Unchanged" is one of the hypotheses, so letters that are meant stay. A symbol that is foreign to its
word, a letter of another script or a sign within Latin letters, can stand for every letter of the language model,
those that a pair of code pages turns into it before others; so the page needn't be known. A letter that only
looks like a Latin one has that one among its hypotheses. Accented Latin letters can stand for those that a pair
of pages turns into them.

Restored text comes from ``str.translate`` for single characters and from group replacement for the others.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..session import written
from .unify import LOOK_ALIKE

# Code pages that text was read with, or was written in.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "iso8859-15", "cp1254")
#: Pages with one byte per letter that were taken for one another.
SWAPS = (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"))
#: Letters that a single wrong character may stand for.
LETTERS = "àâäáãæçéèêëíîïìñóôöòœßúùûüÿÀÂÄÁÃÆÇÉÈÊËÍÎÏÌÑÓÔÖÒŒÚÙÛÜ’‘“”«»–—…°¿¡"
# Further pages with one byte per letter; they order the letters for a symbol of another script.
MORE = (
    "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "iso8859-2", "iso8859-3", "iso8859-4", "iso8859-5", "iso8859-6", "iso8859-7", "iso8859-8", "iso8859-9", "iso8859-10",
    "iso8859-13", "iso8859-14", "iso8859-15", "iso8859-16", "koi8-r", "koi8-u", "mac_cyrillic", "mac_greek", "mac_latin2", "mac_turkish", "cp737", "cp775", "cp852", "cp855", "cp857", "cp862", "cp866", "latin-1",
)
LOST = "�"
#: Iterations at most, and the change of a share below which they end.
ITERATIONS, CONVERGED = 100, 1e-4
#: Odds of garbled against meant before any evidence, of a single character.
PRIOR = 0.01
#: Odds of a letter that no known pair of pages explains against one that is explained.
UNKNOWN = 1e-4


def _decode(data: bytes, page: str) -> str | None:
    if page == "cp1252":  # bytes without a character pass as control characters
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)
    try:
        return data.decode(page)
    except UnicodeDecodeError:
        return None


def _targets() -> list[str]:
    """Characters that may have been garbled: letters, marks, punctuation and spaces in use outside ASCII."""
    blocks = (range(0xA0, 0x180), range(0x192, 0x193), range(0x2C6, 0x2DE), range(0x300, 0x370), range(0x370, 0x530), range(0x2000, 0x2070), range(0x20A0, 0x20C0), range(0x2100, 0x2150), range(0x2190, 0x2300), range(0xFB00, 0xFB07), range(0xFEFF, 0xFF00), range(0xFF01, 0xFF5F))
    return [chr(c) for block in blocks for c in block if unicodedata.category(chr(c)) != "Cn"]


@cache
def explained() -> dict[str, tuple[str, ...]]:
    """For each symbol the letters that some mistake turns into it."""
    by: dict[str, set[str]] = defaultdict(set)
    for x in _targets():
        once = x.encode()
        for page in READ_AS:
            s = _decode(once, page)
            if s and not s.isascii():
                by[s].add(x)
                for again in ("cp1252", "latin-1"):
                    if page in ("cp1252", "latin-1") and (t := _decode(s.encode(), again)):
                        by[t].add(x)
    for x in LETTERS:
        for written_in, page in SWAPS:
            try:
                s = _decode(x.encode(written_in), page)
            except UnicodeEncodeError:
                continue
            if s and not s.isascii() and s != x and not s.isspace():
                by[s].add(x)
    by["Ã"].add("à")  # its second byte is a space in latin-1, and spaces get normalised
    return {s: tuple(sorted(x)) for s, x in by.items()}


@cache
def derived() -> dict[str, tuple[str, ...]]:
    """For letters and control characters outside the language model the letters that further pages turn into them."""
    by: dict[str, set[str]] = defaultdict(set)
    for x in LETTERS:
        for written_in in ("cp1252", "mac_roman", "cp437", "cp850"):
            try:
                data = x.encode(written_in)
            except UnicodeEncodeError:
                continue
            for page in MORE:
                s = _decode(data, page)
                if s and s not in LETTERS and (s.isalpha() and x.isalpha() or 0x80 <= ord(s) < 0xA0 and s != "\x85"):
                    by[s].add(x)
    return {s: tuple(sorted(x)) for s, x in by.items()}


ASCII, LATIN, FOREIGN, SIGN = range(1, 5)


@cache
def _kind() -> np.ndarray:
    """ASCII and other Latin letters, letters of other alphabets, signs that don't belong into a word; 0 for the rest."""
    table = np.zeros(0x110000, np.uint8)
    table[[*range(65, 91), *range(97, 123)]] = ASCII
    for c in range(0x80, 0x2C00):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            latin = c < 0x370 or unicodedata.name(ch, "").startswith("LATIN")
            table[c] = LATIN if latin else FOREIGN if c < 0x2000 else 0
        elif (kind[0] == "S" or kind in ("No", "Po")) and ch not in PUNCTUATION and ch not in LETTERS:
            table[c] = SIGN
    return table


def _foreign(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which characters are foreign to their word: at most two letters of another alphabet in a row in a word that is
    Latin for the most part (a word of one letter may be either), or a sign inside a word of three letters and more."""
    n = len(codes)
    kind = np.zeros(n + 4, np.uint8)
    kind[2:-2] = _kind()[codes]
    if not (kind >= FOREIGN).any():
        return np.zeros(n, bool)
    other = kind == FOREIGN
    three = other[:-2] & other[1:-1] & other[2:]  # a run of three begins here
    long = np.zeros(n + 4, bool)
    for k in range(3):
        long[k : k + len(three)] |= three
    kind = kind[2:-2]
    letter = (kind > 0) & (kind < SIGN)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = letter[first]
    word = np.where(letter, np.cumsum(begins), 0)
    total = lambda mask: np.bincount(word[mask], minlength=int(word.max(initial=0)) + 1)
    theirs, ours = total(kind == FOREIGN), total((kind == ASCII) | (kind == LATIN))
    mostly = (theirs <= ours) | (ours > 0) & (theirs + ours <= 3) | (theirs + ours == 1)
    out = (kind == FOREIGN) & ~long[2:-2] & mostly[word]
    near = np.zeros(n + 4, bool)
    near[2:-2] = kind == ASCII
    out |= (kind == SIGN) & near[1:-3] & near[3:-1] & (near[:-4] | near[4:])
    return out


@cache
def _groups() -> tuple[frozenset[str], int, np.ndarray]:
    """Symbols of several characters, the longest one's size, and which code points begin one."""
    many = frozenset(s for s in explained() if len(s) > 1)
    begins = np.zeros(0x110000, bool)
    begins[[ord(s[0]) for s in many]] = True
    return many, max(map(len, many)), begins


@cache
def _single() -> np.ndarray:
    """Code points that matter as symbols of one character: a letter of the language model, or garbled."""
    table = np.zeros(0x110000, bool)
    table[[ord(s) for s in explained() if len(s) == 1] + [ord(c) for c in LETTERS]] = True
    table[[ord(s) for s in derived() if _kind()[ord(s)] != FOREIGN]] = True
    table[ord(LOST)] = True
    return table


#: Context class of neighbours: ASCII as it is, digits as 0, any space as a space, other characters as 1.
@cache
def _context() -> np.ndarray:
    table = np.full(0x110000, 1, np.uint8)
    table[:128] = np.arange(128)
    table[[9, 10, 11, 12, 13, 0xA0, *range(0x2000, 0x200B), 0x202F]] = 32
    table[48:58] = 48
    return table


def occurrences(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, left, right) of every symbol; groups are taken before single characters, longest first."""
    many, longest, begins = _groups()
    wide = codes > 127
    taken = np.zeros(len(codes), bool)
    found: list[tuple[int, int]] = []
    two = wide.copy()
    two[:-1] &= wide[1:]
    two[-1:] = False
    row_end = offsets[1:]
    free = 0
    for i in np.flatnonzero(two & begins[codes]).tolist():
        if i < free:
            continue
        end = min(int(row_end[np.searchsorted(offsets, i, side="right") - 1]), i + longest)
        run = codes[i:end].tobytes().decode("utf-32-le")
        for n in range(len(run), 1, -1):
            if run[:n] in many:
                found.append((i, i + n))
                taken[i : i + n] = True
                free = i + n
                break
    alone = np.flatnonzero(wide & ~taken & (_single()[codes] | _foreign(codes, offsets)))
    start = np.concatenate([alone, np.array([f[0] for f in found], np.int64)]).astype(np.int64)
    end = np.concatenate([alone + 1, np.array([f[1] for f in found], np.int64)]).astype(np.int64)
    order = np.argsort(start)
    start, end = start[order], end[order]
    row = np.searchsorted(offsets, start, side="right") - 1
    context = _context()[codes] if len(codes) else np.zeros(0, np.uint8)
    left = np.where(start > offsets[row], context[np.maximum(start - 1, 0)], 32) if len(start) else np.zeros(0, np.uint8)
    right = np.where(end < offsets[row + 1], context[np.minimum(end, len(codes) - 1)], 32) if len(start) else np.zeros(0, np.uint8)
    return row, start, end, left, right


def _rows(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, symbol, left, right) with their number."""
    row, start, end, left, right = occurrences(codes, offsets)
    names: dict[str, int] = {}
    single = end - start == 1
    ident = codes[start].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    for i in np.flatnonzero(~single).tolist():
        text = codes[start[i] : end[i]].tobytes().decode("utf-32-le")
        ident[i] = 0x110000 + names.setdefault(text, len(names))
    back = list(names)
    key = np.stack([row, ident, left.astype(np.int64), right.astype(np.int64)], axis=1) if len(row) else np.zeros((0, 4), np.int64)
    packed = (key[:, 0] << 38) | (key[:, 1] << 16) | (key[:, 2] << 8) | key[:, 3]
    packed, count = np.unique(packed, return_counts=True)
    ident = (packed >> 16) & 0x3FFFFF
    symbol = [chr(i) if i < 0x110000 else back[i - 0x110000] for i in ident.tolist()]
    return packed >> 38, symbol, ((packed >> 8) & 0xFF).astype(np.int16), (packed & 0xFF).astype(np.int16), count


def _plain(codes: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (ASCII letter, left, right) with their number: what a look-alike letter is judged by."""
    at = np.flatnonzero(_kind()[codes] == ASCII)
    context = _context()[codes].astype(np.int64)
    left, right = np.append(32, context[:-1]), np.append(context[1:], 32)
    full = np.diff(offsets) > 0
    left[offsets[:-1][full]], right[offsets[1:][full] - 1] = 32, 32
    count = np.bincount((context[at] << 14) | (left[at] << 7) | right[at])
    packed = np.flatnonzero(count)
    return [chr(c) for c in packed >> 14], (packed >> 7 & 127).astype(np.int16), (packed & 127).astype(np.int16), count[packed]


SCHEMA = "chunk_id long, source string, symbol string, l short, r short, n int, body boolean"


def symbols(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, symbol, l, r, n, body): symbols of text_utf8 (body) and preview, counted within a row.

    The source of a chunk is the collection folder in its path; ASCII rows give nothing. Rows without source count the
    ASCII letters of the same texts, for the language model.
    """
    source = F.coalesce(F.regexp_extract("path", r"^/?[^/]+/([^/]+)/", 1), F.lit(""))
    rows = chunks.where(F.col("text_utf8").rlike(r"[^\x00-\x7f]") | F.col("preview").rlike(r"[^\x00-\x7f]")).select("chunk_id", source.alias("source"), "text_utf8", "preview")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cp.slices(whole, "text_utf8"):
                for column in ("text_utf8", "preview"):
                    row, symbol, left, right, n = _rows(*cp.to_codes(batch.column(column)))
                    of = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("chunk_id").take(of), batch.column("source").take(of), pa.array(symbol, pa.string()), pa.array(left), pa.array(right), pa.array(n.astype(np.int32)), pa.array(np.full(len(row), column == "text_utf8"))],
                        ["chunk_id", "source", "symbol", "l", "r", "n", "body"],
                    )
                symbol, left, right, n = _plain(*cp.to_codes(batch.column("text_utf8")))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(symbol), pa.int64()), pa.nulls(len(symbol), pa.string()), pa.array(symbol, pa.string()), pa.array(left), pa.array(right), pa.array(n.astype(np.int32)), pa.array(np.full(len(symbol), True))],
                    ["chunk_id", "source", "symbol", "l", "r", "n", "body"],
                )

    return rows.mapInArrow(run, SCHEMA)


def prior(symbol: str, l: int, r: int) -> float:  # noqa: E741
    """Odds of garbled against meant: a hundredfold for each character by which a group is longer; high for a letter of
    another alphabet in a Latin word; even for another symbol in a place where it can't be meant; low for the rest."""
    if len(symbol) > 1:
        return 10.0 ** (2 * min(len(symbol), 6) - 3)
    if _kind()[ord(symbol)] == FOREIGN:
        near = _is_letter(l) + _is_letter(r)
        of_word = symbol not in explained() and not "\u0370" <= symbol < "\u0400" and not l == r == 32
        return 1 / PRIOR if near == 2 or of_word else PRIOR
    return 1.0 if symbol not in PUNCTUATION and weight(symbol, "a", l, r) == 2 else PRIOR


class Bigrams:
    """Counts of neighbours of every symbol over the whole corpus."""

    def __init__(self, left: dict[tuple[str, int], float], right: dict[tuple[str, int], float]) -> None:
        self.left, self.right = left, right
        self.total: dict[str, float] = defaultdict(float)
        for (s, _), n in left.items():
            self.total[s] += n

    def like(self, x: str, l: int, r: int) -> float:  # noqa: E741
        """N(l, x) * N(x, r) / N(x); a neighbour that is itself a symbol (class 1) says nothing."""
        total = self.total.get(x, 0.0)
        if not total:
            return 1e-6
        a = total if l == 1 else self.left.get((x, l), 0.0) + 1e-3
        b = total if r == 1 else self.right.get((x, r), 0.0) + 1e-3
        return a * b / total


@cache
def hypotheses(symbol: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """What a symbol may be: meant (itself or the Latin letter it looks like), explained by code pages, other letters."""
    meant = (symbol, LOOK_ALIKE[symbol]) if symbol in LOOK_ALIKE else (symbol,)
    known = tuple(dict.fromkeys(x for x in (*explained().get(symbol, ()), *derived().get(symbol, ())) if x not in meant))
    any_letter = len(symbol) == 1 and (_kind()[ord(symbol)] == FOREIGN or _kind()[ord(symbol)] == SIGN and not known)
    return meant, known, tuple(x for x in LETTERS if x.isalpha() and x not in known and x not in meant) if any_letter else ()


def learn(table: pd.DataFrame, model: Bigrams) -> pd.DataFrame:
    """EM over one source's (symbol, l, r, n): the letter of each, where it isn't the symbol itself."""
    out = []
    for symbol, rows in table.groupby("symbol", sort=True):
        if symbol == LOST:
            out += [(symbol, l, r, LOST, 1.0) for l, r in zip(rows["l"], rows["r"])]  # noqa: E741
            continue
        meant, known, others = hypotheses(symbol)
        letters = [*meant, *known, *others]
        if len(letters) == len(meant):
            continue
        like = np.array([[model.like(x, l, r) for x in letters] for l, r in zip(rows["l"], rows["r"])])  # noqa: E741
        n = rows["n"].to_numpy(float)[:, None]
        like[:, 0] /= [prior(symbol, l, r) for l, r in zip(rows["l"], rows["r"])]  # noqa: E741
        like[:, 1 : len(meant)] /= PRIOR
        if known:
            like[:, len(meant) + len(known) :] *= UNKNOWN
        theta = np.full(len(letters), 1 / len(letters))
        for _ in range(ITERATIONS):
            post = like * theta
            post /= post.sum(axis=1, keepdims=True)
            before, theta = theta, (post * n).sum(axis=0) + 0.05
            theta /= theta.sum()
            if np.abs(theta - before).max() < CONVERGED:
                break
        best = post[:, len(meant) :].argmax(axis=1) + len(meant)
        unchanged = post[:, : len(meant)].sum(axis=1)
        for l, r, p, b in zip(rows["l"], rows["r"], unchanged, best):  # noqa: E741
            if p < 0.5:
                out.append((symbol, l, r, letters[b], 1 - p))
    return pd.DataFrame(out, columns=["symbol", "l", "r", "letter", "p"])


# Symbols that stand beside words in good text.
PUNCTUATION = "’‘“”«»–—…‚„‹›·•"


def _is_letter(c: int) -> bool:
    return 65 <= c <= 90 or 97 <= c <= 122


def weight(symbol: str, letter: str, l: int, r: int) -> int:  # noqa: E741
    """How far one occurrence alone shows a wrong code page: 2 certain, 1 likely, 0 only beside others.

    Certain: a group that decodes to one character, a lost character, or a symbol that is no letter inside or
    beside a word (punctuation: inside), or a capital right after a small letter. Likely: a letter in another
    place. A letter alone between spaces for a dash is certain, any other symbol without a letter beside it shows nothing by itself.
    A letter of another alphabet is certain, but likely if it looks like a Latin one or is Greek at the edge of a word,
    as a unit or variable may be. A foreign accented Latin letter is likely.
    """
    if len(symbol) > 1 or symbol == LOST:
        return 2
    near = _is_letter(l) + _is_letter(r)
    if _kind()[ord(symbol)] == FOREIGN and letter not in explained().get(symbol, ()):
        return 0 if not near else 1 if symbol in LOOK_ALIKE or near == 1 and "\u0370" <= symbol < "\u0400" else 2
    if symbol.isalpha() and symbol not in explained() and symbol in derived():
        return 1 if near else 0
    if symbol.isalpha() and not letter.isalpha() and l == r == 32:
        return 2
    if symbol.isalpha() and (symbol in LETTERS or symbol.lower() in LETTERS):
        return 2 if 97 <= l <= 122 and symbol.isupper() else 1 if near else 0
    if letter.isalpha() and symbol in PUNCTUATION:
        return 2 if near == 2 else 0
    return 2 if near else 0


def bigrams(found: DataFrame) -> Bigrams:
    """The corpus counts. Symbols come from a fixed inventory of some 12,000 and the characters below U+2C00, and contexts are 128 classes, so what is collected has a bound at any corpus size."""
    body = written(found.where("body").groupBy("symbol", "l", "r").agg(F.sum("n").alias("n")))
    side = lambda c: {(r["symbol"], r["c"]): float(r["n"]) for r in body.groupBy("symbol", F.col(c).alias("c")).agg(F.sum("n").alias("n")).toLocalIterator()}
    return Bigrams(side("l"), side("r"))


def garbled(chunks: DataFrame) -> DataFrame:
    """(chunk_id, body, symbol, l, r, letter, p): the garbled symbols of every affected chunk, in text and preview.

    A chunk is affected if a symbol shows it with certainty or three do so likely. Replayed rows count once.
    """
    found = written(symbols(chunks))
    sent = chunks.sparkSession.sparkContext.broadcast(bigrams(found))

    def per_source(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        out = learn(table, sent.value)
        out["source"] = key[0]
        out["w"] = [weight(*x) for x in zip(out["symbol"], out["letter"], out["l"], out["r"])]
        return out[["source", "symbol", "l", "r", "letter", "p", "w"]]

    mapping = (
        found.where("source IS NOT NULL").groupBy("source", "symbol", "l", "r").agg(F.sum("n").alias("n"))
        .groupBy("source").applyInPandas(per_source, "source string, symbol string, l short, r short, letter string, p double, w int")
    )
    hits = written(found.join(mapping, ["source", "symbol", "l", "r"]).groupBy("chunk_id", "body", "symbol", "l", "r").agg(F.first("letter").alias("letter"), F.first("p").alias("p"), F.first("w").alias("w")))
    shown = hits.groupBy("chunk_id").agg(F.max("w").alias("w"), F.count_if(F.col("w") == 1).alias("likely")).where("w = 2 OR likely >= 3")
    return hits.drop("w").join(shown.select("chunk_id"), "chunk_id")


def found(chunks: DataFrame) -> DataFrame:
    """(chunk_id) of affected chunks."""
    return garbled(chunks).select("chunk_id").distinct()


def restore_text(text: str, mapping: dict[tuple[str, int, int], str]) -> str:
    """Replace the garbled symbols; a lost character stays, as nothing tells what it was."""
    codes, offsets = cp.to_codes(pa.array([text]))
    _, start, end, left, right = occurrences(codes, offsets)
    seen: dict[str, set[str | None]] = defaultdict(set)
    places = []
    for s, e, l, r in zip(start.tolist(), end.tolist(), left.tolist(), right.tolist()):  # noqa: E741
        symbol = text[s:e]
        letter = mapping.get((symbol, l, r))
        seen[symbol].add(letter)
        places.append((s, e, symbol, letter))
    table = {ord(s): next(iter(x)) for s, x in seen.items() if len(s) == 1 and len(x) == 1 and None not in x}
    out, at = [], 0
    for s, e, symbol, letter in places:
        if letter is not None and (len(symbol) > 1 or ord(symbol) not in table):
            out += [text[at:s].translate(table), letter]
            at = e
    return "".join(out) + text[at:].translate(table)


def restored(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text_utf8, preview) of affected chunks, restored where possible."""
    maps = garbled(chunks).groupBy("chunk_id", "body").agg(F.collect_list(F.struct("symbol", "l", "r", "letter")).alias("m"))
    wide = maps.groupBy("chunk_id").agg(F.first(F.when(F.col("body"), F.col("m")), True).alias("m_text"), F.first(F.when(~F.col("body"), F.col("m")), True).alias("m_preview"))
    rows = chunks.select("chunk_id", "text_utf8", "preview").join(wide, "chunk_id").dropDuplicates(["chunk_id"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"chunk_id": batch.column("chunk_id")}
            for column, m in (("text_utf8", "m_text"), ("preview", "m_preview")):
                texts = []
                for text, entries in zip(batch.column(column).to_pylist(), batch.column(m).to_pylist()):
                    known = {(x["symbol"], x["l"], x["r"]): x["letter"] for x in entries or ()}
                    texts.append(restore_text(text, known) if text and known else text)
                out[column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, "chunk_id long, text_utf8 string, preview string")
