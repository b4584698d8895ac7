"""Normalisation, display form, pages, windows and previews: as columns, and on the driver for queries."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PREVIEW_BYTES, WINDOW_CHARS, WINDOW_STEP

# Characters whose ASCII spelling isn't their decomposition.
SPELLED = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "…": "...", "€": "EUR", "™": "tm", "©": "(c)", "®": "(r)",
    "«": "<<", "»": ">>", "½": "1/2", "¼": "1/4", "¾": "3/4", "№": "No", "—": "--",
}
ONE_TO_ONE = {
    "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "‘": "'", "’": "'", "‚": "'",
    "“": '"', "”": '"', "„": '"', "‹": "<", "›": ">", "‐": "-", "‑": "-", "–": "-", "−": "-", "•": "*", "·": "*", "×": "x", "÷": "/", "¡": "!", "¿": "?", "°": "d", "′": "'", "″": '"',
}


# Cyrillic and Greek letters, in alphabetical order.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяѐёђѓєѕіїјљњћќѝўџґ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia e e dj g ie dz i yi j lj nj ts k i u dz g".split()))
GREEK = dict(zip("αβγδεζηθικλμνξοπρςστυφχψω", "a b g d e z e th i k l m n x o p r s s t y f kh ps o".split()))


@cache
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """(one character to one, one character to several), from the Unicode decompositions and the fixed values."""
    scripts = CYRILLIC | GREEK
    scripts |= {c.upper(): to.capitalize() for c, to in scripts.items() if len(c.upper()) == 1}
    spelled = SPELLED | ONE_TO_ONE | scripts
    for c in (*range(0x80, 0x590), *range(0x1E00, 0x2070), *range(0x2070, 0x2300), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF70), 0x3000, 0xFEFF):
        ch = chr(c)
        if ch in spelled or unicodedata.category(ch) == "Cn":
            continue
        plain = "".join(scripts.get(x, x) for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if unicodedata.combining(ch) or unicodedata.category(ch) == "Cf":
            plain = ""
        elif unicodedata.category(ch) == "Cc":
            plain = " "
        if plain.isascii():
            spelled[ch] = plain
    return {c: to for c, to in spelled.items() if len(to) == 1}, {c: to for c, to in spelled.items() if len(to) != 1}


def transliterate(text: str) -> str:
    """ASCII spelling on the driver; the same as :func:`transliterate_column`. A character without a spelling becomes
    ``u`` and its number, so different ones stay different."""
    one, several = _tables()
    return "".join(c if c.isascii() else one.get(c, several.get(c, f"u{ord(c):x}")) for c in text)


def transliterate_column(text: Column) -> Column:
    """ASCII spelling without leaving the JVM: one table lookup, then replacements for usual longer spellings; then, in
    texts that still have other characters, a spelling or number for each of them. Texts in ASCII take none of the steps."""
    one, several = _tables()
    other = r"[^\x00-\x7f]"
    known = F.translate(text, "".join(one) + "".join(c for c, to in several.items() if to == ""), "".join(one.values()))
    for c, to in SPELLED.items():
        known = F.replace(known, F.lit(c), F.lit(to))
    spelling = F.create_map(*(F.lit(x) for c, to in several.items() if to and c not in SPELLED for x in (c, to)))
    number = lambda c: F.concat(F.lit("u"), F.lower(F.hex(F.ascii(c))))
    each = lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.coalesce(F.element_at(spelling, c), number(c)))
    rest = lambda k: F.when(k.rlike(other), F.array_join(F.transform(F.split(k, ""), each), "")).otherwise(k)
    return F.when(text.rlike(other), F.transform(F.array(known), rest)[0]).otherwise(text)


def normalize_column(text: Column) -> Column:
    """Searchable form: ASCII, lower case, runs of controls and spaces as one space, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.lower(transliterate_column(text)), r"[\x00-\x20]+", " "))


def normalize_query(text: str) -> str:
    """The searchable form of a query."""
    return re.sub(r"[\x00-\x20]+", " ", transliterate(text).lower()).strip(" ")


def display_column(text: Column) -> Column:
    """Every run of Unicode white space and control characters as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\p{Cc}]+", " "))


def display(text: str) -> str:
    return " ".join("".join(" " if unicodedata.category(c) == "Cc" or c.isspace() else c for c in text).split())


def is_blank(text: Column) -> Column:
    """Unicode white space only."""
    return text.rlike(r"(?U)\A\s*\z")


def snapped(data: Column, at: Column) -> Column:
    """The byte offset, moved left to the start of a character of the UTF-8 ``data``; the length if beyond."""
    inner = lambda i: F.hex(F.substring(data, i + 1, F.lit(1))).between("80", "BF")
    return F.when(at >= F.octet_length(data), F.octet_length(data)).otherwise(
        F.when((at <= 0) | ~inner(at), at).when(~inner(at - 1), at - 1).when(~inner(at - 2), at - 2).otherwise(at - 3)
    )


def bytes_slice(data: Column, start: Column, end: Column) -> Column:
    """Text of the bytes [start, end)."""
    return F.substring(data, start + 1, end - start).cast("string")


def with_preview(df: DataFrame, text: str = "text_utf8") -> DataFrame:
    """Adds ``preview``: head of the display form, of at most 200 bytes and whole characters."""
    shown, data = F.col("_shown"), F.col("_shown").cast("binary")
    whole = F.octet_length(shown) <= PREVIEW_BYTES
    return df.withColumn("_shown", display_column(F.col(text))).withColumn("preview", F.when(whole, shown).otherwise(bytes_slice(data, F.lit(0), snapped(data, F.lit(PREVIEW_BYTES))))).drop("_shown")


def pages_column(text: Column) -> Column:
    """Pages of extracted text: parted by form feeds, one empty page at the end dropped; none for empty text."""
    parts = F.split(text, "\x0c")
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def page_rows(documents: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, page_no, page_text): one row per page, from 1; documents without text have none."""
    return documents.select(*keys, F.posexplode(pages_column(F.col(text))).alias("_pos", "page_text")).select(*keys, (F.col("_pos") + 1).alias("page_no"), "page_text")


def window_rows(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_no, chunk_ord, char_start, char_end, text_utf8, text_norm_ascii, preview) of overlapping windows.

    A window holds 1,200 characters and starts every 1,000; the offsets are bytes in the page. chunk_ord counts on
    over blank windows, which are left out, and restarts on each page.
    """
    n = F.length("page_text")
    last = F.greatest(F.lit(0), F.ceil((n - WINDOW_CHARS) / F.lit(WINDOW_STEP))).cast("int")
    k = F.col("chunk_ord")
    piece = F.substring(F.col("page_text"), k * WINDOW_STEP + 1, F.lit(WINDOW_CHARS))
    start = F.octet_length(F.substring(F.col("page_text"), F.lit(1), k * WINDOW_STEP))
    rows = (
        pages.where(~is_blank(F.col("page_text")))
        .select(*keys, "page_no", "page_text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_ord"))
        .select(*keys, "page_no", "chunk_ord", start.alias("char_start"), piece.alias("text_utf8"))
        .where(~is_blank(F.col("text_utf8")))
        .select(
            *keys, "page_no", "chunk_ord", "char_start", (F.col("char_start") + F.octet_length("text_utf8")).alias("char_end"), "text_utf8",
            normalize_column(F.col("text_utf8")).alias("text_norm_ascii"),
        )
    )
    return with_preview(rows)


def filename_column(path: Column) -> Column:
    """Last part of a path; the path itself if that is empty."""
    name = F.substring_index(path, "/", -1)
    return F.when(name == "", path).otherwise(name)
