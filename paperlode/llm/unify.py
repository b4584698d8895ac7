"""One consistent form for text that looks the same but holds different characters.

The text of a whole Arrow batch becomes one numpy array of code points. Lookup tables replace each
code point by its canonical expansion (full-width to ordinary forms, ligatures to letters, look-alike
letters to Latin ones, spaces to the ordinary space, characters without width to nothing, accented
letters to base and marks); then marks are put in canonical order and composed, all batch-wide.

Null text stays null, empty text stays empty; a text of zero-width characters becomes empty.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import codepoints as cp
from ..operators.pairs import key_pairs
from ..session import written

# Letters of other scripts that look like a Latin letter.
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s",
    "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ԛ": "Q", "ԍ": "G", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ϳ": "j", "ϲ": "c", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Latin and others
    "օ": "o", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "ɡ": "g", "ɩ": "i", "ı": "i", "Օ": "O", "Տ": "S",
}
# Dashes and spaces that look like the ordinary one.
SAME_DASH = {"‐": "-", "‑": "-"}
LINE_BREAKS = {"\x0b": "\n", "\u2028": "\n", "\u2029": "\n"}


def _reading(ch: str) -> str:
    """What one character becomes before marks are ordered and composed."""
    if ch in LINE_BREAKS:
        return LINE_BREAKS[ch]
    if ch in SAME_DASH:
        return SAME_DASH[ch]
    kind = unicodedata.category(ch)
    if kind == "Zs" or ch == "\t":
        return " "
    if kind == "Cf" or ch in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF:
        return ""
    form = unicodedata.decomposition(ch)
    if form.startswith(("<wide>", "<narrow>")) or "LIGATURE" in unicodedata.name(ch, "") and form.startswith("<compat>") and ch != "ŉ":
        ch = "".join(chr(int(x, 16)) for x in form.split()[1:])
    return "".join(LOOK_ALIKE.get(c, c) for c in unicodedata.normalize("NFD", ch))


class Tables:
    """Lookup tables over all code points, made from the Unicode data once per process."""

    def __init__(self) -> None:
        n = 0x110000
        self.start = np.arange(n, dtype=np.uint32)
        self.length = np.ones(n, np.uint8)
        self.order = np.zeros(n, np.uint8)
        extra: list[int] = []
        pairs: dict[tuple[int, int], int] = {}
        for c in (*range(0xD800), *range(0xE000, 0x323B0), *range(0xE0000, 0xE0200)):
            ch = chr(c)
            self.order[c] = unicodedata.combining(ch)
            to = _reading(ch)
            if to != ch:
                self.start[c], self.length[c] = n + len(extra), len(to)
                extra += map(ord, to)
            form = unicodedata.decomposition(ch)
            parts = form.split()
            if len(parts) == 2 and form[0] != "<":
                a, b = (int(x, 16) for x in parts)
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                    pairs[a, b] = c
            elif 0xAC00 <= c <= 0xD7A3:  # Hangul syllables compose by rule
                tail = (c - 0xAC00) % 28
                a, b = (c - tail, 0x11A7 + tail) if tail else (0x1100 + (c - 0xAC00) // 588, 0x1161 + (c - 0xAC00) % 588 // 28)
                pairs[a, b] = c
        self.pool = np.concatenate([np.arange(n, dtype=np.uint32), np.array(extra, np.uint32)])
        keys = np.array([a << 21 | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys, self.composed = keys[by], np.array(list(pairs.values()), np.uint32)[by]
        #: Characters that may join the one before them.
        self.joins = self.order > 0
        self.joins[[b for _, b in pairs]] = True


tables = cache(Tables)


def _ordered(codes: np.ndarray, order: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Codes with each run of marks in canonical order (stable by combining class)."""
    marks = np.flatnonzero(order)
    if len(marks) < 2:
        return codes
    same_run = (np.diff(marks) == 1) & (row[marks[1:]] == row[marks[:-1]])
    if not (same_run & (order[marks[1:]] < order[marks[:-1]])).any():
        return codes
    run = np.concatenate([[0], np.cumsum(~same_run)])
    codes = codes.copy()
    codes[marks] = codes[marks[np.lexsort((order[marks], run))]]
    return codes


def unify_codes(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of every row, as codes and offsets."""
    t = tables()
    crlf = np.flatnonzero(codes == 13)
    if len(crlf):  # a carriage return ends a line with or without a line feed
        row = cp.row_of(offsets)
        nxt = np.minimum(crlf + 1, len(codes) - 1)
        pair = (codes[nxt] == 10) & (nxt > crlf) & (row[nxt] == row[crlf])
        codes = codes.copy()
        codes[crlf] = 10
        codes[crlf[pair]] = 0x200B
    codes, offsets = cp.expand(codes, offsets, t.length, t.start, t.pool)
    if not len(codes) or not (joins := t.joins[codes]).any():
        return codes, offsets
    row = cp.row_of(offsets)
    codes = _ordered(codes, t.order[codes], row)
    order = t.order[codes]
    # a group is a character that joins nothing before it, with those after it that may join
    head = ~joins
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    heads = np.flatnonzero(head)
    size = np.diff(np.append(heads, len(codes)))
    keep = np.ones(len(codes), bool)
    busy = np.flatnonzero(size > 1)
    codes = codes.copy()
    starter = heads[busy]
    last = np.zeros(len(busy), np.int64)  # combining class of the last mark that stayed; -1 shuts the group
    k = 1
    while len(busy):
        at = heads[busy] + k
        key = codes[starter].astype(np.int64) << 21 | codes[at]
        found = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        own = order[at].astype(np.int64)
        fits = (t.keys[found] == key) & (order[starter] == 0) & np.where(own == 0, last == 0, own > last)
        codes[starter[fits]] = t.composed[found[fits]]
        keep[at[fits]] = False
        stays = ~fits
        new_head = stays & (own == 0)
        starter = np.where(new_head, at, starter)
        last = np.where(new_head, 0, np.where(stays, own, last))
        k += 1
        more = size[busy] > k
        busy, starter, last = busy[more], starter[more], last[more]
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def unify_array(text: pa.Array) -> pa.Array:
    """Arrow text in, Arrow text out."""
    codes, offsets = cp.to_codes(text)
    codes, offsets = unify_codes(codes, offsets)
    return cp.from_codes(codes, offsets, cp.nulls(text))


def unify(df: DataFrame, column: str = "text_utf8", to: str = "text_unified") -> DataFrame:
    """All rows and columns of ``df`` and the consistent form of ``column`` in ``to`` (replaced if there).

    Null stays null; any column may hold nulls; repeated rows stay repeated.
    """
    kept = [c for c in df.columns if c != to]
    schema = StructType([df.schema[c] for c in kept] + [StructField(to, StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cp.slices(whole, column):
                yield pa.RecordBatch.from_arrays([*batch.columns, unify_array(batch.column(column))], [*kept, to])

    return df.select(*kept).mapInArrow(run, schema)


def look_classes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, look, form): digests of how the text looks and of its very characters.

    Replayed rows count once; rows without text have no class and are left out.
    """
    rows = chunks.where("text_utf8 IS NOT NULL").select("chunk_id", "doc_id", "text_utf8")
    return (
        unify(rows)
        .select("chunk_id", "doc_id", F.unhex(F.md5("text_unified")).alias("look"), F.unhex(F.md5("text_utf8")).alias("form"))
        .distinct()
    )


#: Copies up to which a group of equal texts takes part in pairs row by row; of a larger one two copies stand for it.
FEW = 64


def look_members(rows: DataFrame) -> DataFrame:
    """Rows as :func:`look_classes` gives them, of looks with several forms, with the number of copies of the form (n), the
    smallest chunk_id among them (form_id), and whether the chunk takes part in pairs (stands).

    In a form with up to ``FEW`` copies all do; in a larger one the copies of the lowest and of the highest document stand
    for the rest. Both are aggregates that combine before the shuffle, joined back, so hot looks and forms may be split.
    """
    several = rows.groupBy("look").agg(F.min("form").alias("_lo"), F.max("form").alias("_hi")).where("_lo <> _hi").select("look")
    mixed = rows.join(several, "look")
    member = F.struct("doc_id", "chunk_id")
    forms = mixed.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("form_id"), F.min(member)["chunk_id"].alias("_first"), F.max(member)["chunk_id"].alias("_last"))
    stands = (F.col("n") <= FEW) | F.col("chunk_id").isin(F.col("_first"), F.col("_last"))
    return mixed.join(forms, "form").select("look", "form", "chunk_id", "doc_id", "n", "form_id", stands.alias("stands"))


def same_look_pairs(chunks: DataFrame) -> DataFrame:
    """Pairs of chunks of different documents whose text looks the same but isn't equal.

    Copies with equal characters are no pair, so a group of exact copies adds nothing however large; classes of one form are
    dropped by an aggregate that combines before the shuffle. Of a form with more than ``FEW`` copies two stand for the
    rest (:func:`look_members` has the membership); between different texts no link is left out.
    """
    rows = look_members(written(look_classes(chunks))).where("stands").select("look", "chunk_id", "doc_id", "form")
    return key_pairs(rows, ["look"], "chunk_id", (F.col("a.form") != F.col("b.form")) & (F.col("a.doc_id") != F.col("b.doc_id"))).select(F.col("a.chunk_id").alias("chunk_id_a"), F.col("b.chunk_id").alias("chunk_id_b")).distinct()
