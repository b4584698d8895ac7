"""Per-document text statistics, their distribution per language, and what lies in its tails.

Statistics come from a whole Arrow batch at once (code points, lines, words and cells as flat arrays). Their
distributions are KLL sketches per language: built map-side, merged in one small shuffle, so every document
counts whatever its language's share. Values become percentiles against the sketch of all documents of the language,
and robust z-scores against that of its documents with mostly running text, so that a form can't hide itself by being
frequent. A document is a list, a table or junk if the share of its text in such lines lies in the upper tail of that
distribution and another statistic lies in a tail too; how far out that is, the sketches say.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..session import written

# Common words of English, German, French and Spanish.
COMMON = (
    "the of and to in is was for that with as by on at from but not this which are be or an it a "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch an werden aus er "
    "le la les de des et en un une du que est pour dans qui par sur pas avec plus au ce il ou sont "
    "el los las y del se por con una su para es al lo como más o pero sus sin sobre"
).split()

#: The statistics, in column order; the last four are shares of characters in lines of one form, and of all three.
STATS = (
    "n_chars", "n_lines", "n_words", "mean_word", "symbol_share", "digit_share", "upper_share", "punct_line_share",
    "common_share", "words_per_line", "short_word_share", "distinct_share", "list_share", "table_share", "junk_share", "odd_share",
)


#: Statistics that tell whether a text reads like the others, besides the forms of its lines.
MANNER = ("symbol_share", "digit_share", "upper_share", "punct_line_share", "common_share", "words_per_line", "short_word_share", "mean_word")


@dataclass(frozen=True)
class Tails:
    """``z``: z-score of the share of odd lines from which it lies in the tail; ``other``: that of another statistic, at
    either end; ``least``: documents a language must have for a distribution of its own, below which that of all languages
    together stands for it; ``k``: size of a sketch (1600: ranks within 0.2 %)."""

    z: float = 5.0
    other: float = 3.0
    floor: float = 0.02
    least: int = 200
    k: int = 1600


#: Exclusive classes of characters; see :func:`classes`.
ODD, LOW_VOWEL, LOW, UP_VOWEL, UP, DIGIT, BLANK, TAB, BREAK, DOT, COMMA, SEMI, COLON, DASH, RULE, BAR, SLASH, OPEN, CLOSE, STOP, QUOTE = range(21)
N_CLASSES = 21
# Vowels, and punctuation that is usual in prose.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿœаеіоуαειουοօ"
USUAL = "'\"‘’“”„«»–‐\u00ad%"


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in (*range(0xD800), *range(0xE000, 0x323B0)):
        ch = chr(c)
        if ch.isalpha():
            vowel = ch.lower() in VOWELS
            table[c] = (UP_VOWEL if vowel else UP) if ch.isupper() else (LOW_VOWEL if vowel else LOW)
        elif ch.isspace():
            table[c] = BLANK
    for of, chars in ((DIGIT, "0123456789"), (TAB, "\t"), (BREAK, "\n\x0c\r\u2028\u2029"), (DOT, "."), (COMMA, ","), (SEMI, ";"), (COLON, ":"), (DASH, "-"), (RULE, "=_+"), (BAR, "|"), (SLASH, "/"), (OPEN, "(["), (CLOSE, ")]"), (STOP, "!?…"), (QUOTE, USUAL)):
        table[[ord(x) for x in chars]] = of
    return table


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _prefix(mask: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, dtype=np.int32, out=total[1:])
    return total


def _edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true elements; both ends of the array must be false."""
    turn = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return turn[::2], turn[1::2]


def line_forms(codes: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """For each line [start, end) whether it has the form of a list entry, of a table row, of junk; and counts.

    Lines are in order, trimmed, not blank; what stands between them, and before and after all, is space.
    """
    n_lines = len(start)
    line = np.repeat(np.arange(-1, n_lines), np.concatenate([[start[0]], np.diff(start), [len(codes) - start[-1]]]))
    counts = np.bincount((line + 1) * N_CLASSES + kind, minlength=(n_lines + 1) * N_CLASSES).reshape(-1, N_CLASSES)[1:]
    letters = counts[:, LOW_VOWEL : UP + 1].sum(axis=1)
    digits = counts[:, DIGIT]
    solid = counts.sum(axis=1) - counts[:, BLANK : BREAK + 1].sum(axis=1)
    letter = (kind >= LOW_VOWEL) & (kind <= UP)
    space = (kind >= BLANK) & (kind <= BREAK)
    digit = kind == DIGIT
    to_letter, to_digit, to_vowel = _prefix(letter), _prefix(digit), _prefix((kind == LOW_VOWEL) | (kind == UP_VOWEL))
    of_line = lambda at: np.bincount(at, minlength=n_lines)

    def per_line(of: np.ndarray, what: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of, what, n_lines)

    # tokens are runs without space; words are runs of letters; cells are runs between separators
    ts, te = _edges(~space)
    t_line, t_size = line[ts], te - ts
    t_letters, t_digits = to_letter[te] - to_letter[ts], to_digit[te] - to_digit[ts]
    tokens = of_line(t_line)
    ws, we = _edges(letter)
    w_line, w_size = line[ws], we - ws
    words = of_line(w_line)
    nxt, prev = np.append(codes[1:], 10), np.append(10, codes[:-1])
    nxt_space = np.append(space[1:], True)
    cs, ce = _edges(~(space | (kind == BAR) | (kind == SEMI) | (kind == COMMA)))
    c_line = line[cs]
    c_letters, c_digits = to_letter[ce] - to_letter[cs], to_digit[ce] - to_digit[cs]
    none = ((ce - cs == 1) & (kind[cs] == DASH)) | ((ce - cs == 3) & (c_letters == 2) & (nxt[cs] == 47))
    number = ((c_letters == 0) & (c_digits > 0)) | none
    cells, numbers = of_line(c_line), of_line(c_line[number])
    # separators of cells: tab, bar, semicolon or comma without space after it, two spaces and more
    comma = kind == COMMA
    sep = (kind == TAB) | (kind == BAR) | (((kind == SEMI) | comma) & ~nxt_space) | ((codes == 32) & (nxt == 32) & (prev != 32))
    inside = lambda mask: of_line(x[x >= 0]) if len(x := line[np.flatnonzero(mask)]) else np.zeros(n_lines, np.int64)
    ends_at = end[np.maximum(line, 0)] if n_lines else line
    seps = inside(sep & (np.arange(len(codes)) < ends_at))

    # junk
    repeat = inside((codes == prev) & ~((kind == DOT) | space | digit))
    odd = counts[:, ODD] + counts[:, RULE]
    singles = of_line(t_line[t_size == 1])
    mixed = per_line(t_line, np.where((t_letters > 0) & (t_digits > 0), t_size, 0))
    plain = per_line(t_line, np.where((t_letters == t_size) & (t_size > 1), t_size, 0))
    hex_pair = of_line(t_line[(t_size == 2) & (t_letters + t_digits == 2) & (t_digits > 0)])
    long = w_size > 2
    no_vowel = per_line(w_line, np.where(long & (to_vowel[we] == to_vowel[ws]), w_size, 0))
    in_words = per_line(w_line, np.where(long, w_size, 0))
    rule = counts[:, [DASH, RULE, BAR]].sum(axis=1) == solid
    junk = (
        (odd > 0.25 * solid) & ~rule
        | ((repeat > 0.5 * solid) & ~rule)
        | ((tokens >= 6) & (singles > 0.7 * tokens) & (numbers < 0.8 * cells))
        | ((mixed > 0.6 * solid) & (plain < 0.2 * solid) & (seps == 0))
        | ((hex_pair >= 3) & (hex_pair > 0.25 * tokens) & (plain < 0.3 * solid))
        | ((no_vowel > 0.6 * in_words) & (in_words > 6))
    )

    # table
    table = ~junk & (((numbers >= 2) & (numbers >= 0.5 * (cells - 1)) & (seps >= 2)) | ((seps >= 2) & (seps >= words - 2) & (words > 0)))
    table |= rule & (solid >= 8)

    # list: what an entry begins or ends with
    size, tail = end - start, kind[end - 1]
    at = lambda n: np.minimum(start + n, len(codes) - 1)
    head = np.searchsorted(ts, start)
    h_size, h_digits, h_letters, h_end = t_size[head], t_digits[head], t_letters[head], te[head]
    h_last = kind[h_end - 1]
    first = kind[start]
    stops = (tail == DOT) | (tail == STOP) | (tail == SEMI) | (tail == COLON)
    bullet = np.isin(codes[start], [0x2D, 0x2013, 0x2014, 0x2022, 0x2A, 0xB7, 0x2023, 0x25AA, 0x25CF]) & (codes[at(1)] == 32) & letter[at(2)]
    number_head = (h_digits > 0) & (h_letters == 0) & (words > 0)
    enclosed = number_head & (first == OPEN) & (h_last == CLOSE) & (h_digits == h_size - 2)
    section = number_head & (h_digits < h_size) & (first == DIGIT) & (h_last == DIGIT) & (counts[:, DOT] > 0)
    counted = number_head & (h_digits == h_size - 1) & ((h_last == DOT) | (h_last == CLOSE)) & (size < 90) & ~stops
    times = number_head & (h_digits == h_size) & (codes[at(h_size + 1)] == 120) & (codes[at(h_size + 2)] == 32)
    colon = (h_last == COLON) & (h_letters == h_size - 1) & (h_size > 2) & (tokens >= 2) & (size < 90) & ~stops
    leaders = (inside((codes == prev) & (kind == DOT)) >= 3) & (tail == DIGIT)
    comma_numbers = (numbers >= 1) & (cells - numbers <= 3) & (numbers >= 0.5 * (cells - 1)) & (counts[:, COMMA] > 0) & (tail == DIGIT) & (seps == 0) & letter[start]
    w_upper = of_line(w_line[((kind[ws] == UP) | (kind[ws] == UP_VOWEL)) & (w_size > 1)])
    names = (words >= 2) & (words <= 4) & (digits == 0) & (counts[:, COMMA] == 1) & (w_upper >= 2) & (w_upper >= words - (counts[:, OPEN] > 0)) & ~stops & (tail != COMMA)
    entry = ~junk & ~table & (bullet | enclosed | (section & (leaders | (size < 90))) | counted | times | colon | leaders | comma_numbers | names)
    return {"list": entry, "table": table, "junk": junk, "size": solid, "letters": letters, "digits": digits, "upper": counts[:, [UP, UP_VOWEL]].sum(axis=1), "stops": stops}


@cache
def _common() -> np.ndarray:
    codes, at = cp.to_codes(pa.array(COMMON))
    return np.sort(cp.spans(cp.letter_values()[codes], at[:-1], at[1:]))


def doc_stats(codes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every text; a text without visible characters has zeros."""
    n = len(offsets) - 1
    out = {s: np.zeros(n) for s in STATS}
    out["n_chars"] = np.diff(offsets).astype(float)
    # a line break between texts, and at both ends, so that no run reaches over
    place = np.arange(len(codes)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    apart = np.full(len(codes) + n + 1, 10, np.uint32)
    apart[place] = codes
    bounds = offsets + np.arange(n + 1)
    kind = classes()[apart]
    solid = (kind < BLANK) | (kind > BREAK)
    start, end = _edges(kind != BREAK)
    solid_at = np.flatnonzero(solid)
    if not len(solid_at):
        return out
    to_solid = _prefix(solid)
    visible = to_solid[end] > to_solid[start]
    start, end = start[visible], end[visible]
    start, end = solid_at[to_solid[start]], solid_at[to_solid[end] - 1] + 1
    row = np.searchsorted(bounds, start, side="right") - 1
    form = line_forms(apart, kind, start, end)
    add = lambda x: np.bincount(row, x, n)
    size, lines = add(form["size"]), add(np.ones(len(row)))
    low = cp.lower_case()[1][apart]  # length stays: a character that grows in lower case keeps its first one
    low = np.where(low < 0x110000, low, apart)
    ws, we = _edges(cp.letters_and_digits()[low])
    w_row = np.searchsorted(bounds, ws, side="right") - 1
    words = np.bincount(w_row, minlength=n).astype(float)
    h = cp.spans(cp.letter_values()[low], ws, we)
    common = _common()
    is_common = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    with np.errstate(over="ignore"):
        key = np.sort(h & np.uint64(0xFFFFFFFFFF) | w_row.astype(np.uint64) << np.uint64(40))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    w_size = we - ws
    out["n_lines"] = lines
    out["n_words"] = words
    out["mean_word"] = _share(np.bincount(w_row, w_size, n), words)
    out["short_word_share"] = _share(np.bincount(w_row[w_size == 1], minlength=n), words)
    out["common_share"] = _share(np.bincount(w_row[is_common], minlength=n), words)
    out["distinct_share"] = _share(np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n), words)
    out["symbol_share"] = _share(size - add(form["letters"]) - add(form["digits"]), size)
    out["digit_share"] = _share(add(form["digits"]), size)
    out["upper_share"] = _share(add(form["upper"]), add(form["letters"]))
    out["punct_line_share"] = _share(add(form["stops"]), lines)
    out["words_per_line"] = _share(words, lines)
    for name in ("list", "table", "junk"):
        out[f"{name}_share"] = _share(add(form["size"] * form[name]), size)
        out["odd_share"] += out[f"{name}_share"]
    return out


def language(lang: Column) -> Column:
    """Two-letter code in lower case; ``und`` for anything else, so the number of groups has a bound."""
    code = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2})(?:[-_].*)?\s*$", 1))
    return F.when(F.coalesce(code, F.lit("")) == "", "und").otherwise(code)


def stats(documents: DataFrame) -> DataFrame:
    """(doc_id, language, status, *STATS) of every document with a text; null texts have no statistics."""
    names = ["doc_id", "language", "status"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cp.slices(whole, "text"):
                found = doc_stats(*cp.to_codes(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(found[s]) for s in STATS)], [*names, *STATS])

    rows = documents.where("text IS NOT NULL").select("doc_id", language(F.col("lang")).alias("language"), "status", "text")
    return rows.mapInArrow(run, "doc_id long, language string, status string, " + ", ".join(f"{s} double" for s in STATS))


def _sketches(rows: DataFrame, of: tuple[str, ...], spec: Tails) -> DataFrame:
    return rows.groupBy("language").agg(*(F.kll_sketch_agg_double(s, F.lit(spec.k)).alias(s) for s in of), F.count(F.lit(1)).alias("n"))


def sketches(measured: DataFrame, of: tuple[str, ...] = STATS, spec: Tails = Tails()) -> DataFrame:
    """(language, n, one KLL sketch per statistic) of all documents; mergeable by ``kll_merge_agg_double`` with those of other runs."""
    return _sketches(measured, of, spec)


def reference(measured: DataFrame, of: tuple[str, ...], spec: Tails = Tails()) -> DataFrame:
    """(language, ``_<stat>``: quantiles 0.01, 0.5 and 0.99) of documents of two lines and more whose running text outweighs the rest.

    A language with fewer than ``spec.least`` of them takes the merged sketches of all languages; so does, as
    language null, any language without one. At most 678 rows.
    """
    own = written(_sketches(measured.where("n_lines > 1 AND odd_share < 0.5"), of, spec))
    every = own.agg(*(F.kll_merge_agg_double(s, F.lit(spec.k)).alias(s) for s in of), F.count(F.lit(1)).alias("n")).where("n > 0").withColumn("language", F.lit(None).cast("string"))
    marks = F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))
    rows = own.where(F.col("n") >= spec.least).unionByName(every)
    return rows.select("language", *(F.kll_sketch_get_quantile_double(s, marks).alias(f"_{s}") for s in of))


#: 99 of 100 values of a normal distribution lie below so many standard deviations.
_AT_99 = 2.326


def scored(measured: DataFrame, of: tuple[str, ...], spec: Tails = Tails()) -> DataFrame:
    """``measured`` with ``<stat>_z``: distance from the reference's median, in units of its spread on that side (the
    distance of its outer percentile over 2.326); all null where no document has running text."""
    own = F.broadcast(reference(measured, of, spec))
    marks = own.where("language IS NOT NULL")
    common = own.where("language IS NULL").select(*(F.col(f"_{s}").alias(f"_all_{s}") for s in of))
    joined = measured.join(F.broadcast(marks), "language", "left").join(F.broadcast(common), F.lit(True), "left")  # one row at most

    def z(s: str) -> Column:
        q = F.coalesce(F.col(f"_{s}"), F.col(f"_all_{s}"))
        apart = F.col(s) - q[1]
        scale = F.when(apart < 0, q[1] - q[0]).otherwise(q[2] - q[1]) / F.lit(_AT_99)
        floor = F.lit(spec.floor) if s.endswith("share") else F.greatest(F.abs(q[1]) * F.lit(spec.floor), F.lit(1e-9))
        return F.when(apart == 0, 0.0).otherwise(apart / F.greatest(scale, floor))

    return joined.select(*measured.columns, *(z(s).alias(f"{s}_z") for s in of))


def placed(measured: DataFrame, spec: Tails = Tails(), of: tuple[str, ...] = STATS) -> DataFrame:
    """``measured`` with ``<stat>_pct`` (percentile among all documents of the language, to the hundredth) and ``<stat>_z``.

    The rows joined hold 101 quantiles of each statistic for each language code: at most 677 rows, whatever the
    number of documents.
    """
    grid = F.array(*(F.lit(i / 100) for i in range(101)))
    marks = sketches(measured, of, spec).select("language", *(F.kll_sketch_get_quantile_double(F.col(s), grid).alias(f"_{s}") for s in of))

    def rank(s: str) -> Column:
        return F.greatest(F.size(F.filter(f"_{s}", lambda x: x < F.col(s))) - 1, F.lit(0)) / F.lit(100.0)

    rows = scored(measured, of, spec)
    return rows.join(F.broadcast(marks), "language").select(*rows.columns, *(rank(s).alias(f"{s}_pct") for s in of))


def found(documents: DataFrame, spec: Tails = Tails()) -> DataFrame:
    """(doc_id, kind) of documents with status ok in the tails; the form with most of the text names it.

    Every document with a text counts in the distributions. Single-line documents aren't cases. Where no document has
    running text there is no distribution, and more than half of the text in odd lines decides.
    """
    forms = ("list", "table", "junk")
    rows = scored(written(stats(documents)), ("odd_share", *MANNER), spec)
    strange = F.greatest(*(F.abs(f"{s}_z") for s in MANNER)) >= spec.other
    tail = F.coalesce((F.col("odd_share_z") >= spec.z) & strange, F.col("odd_share") > 0.5)
    most = F.greatest(*(F.col(f"{f}_share") for f in forms))
    kind = F.coalesce(*(F.when(F.col(f"{f}_share") == most, f) for f in forms))
    return rows.where((F.col("status") == "ok") & (F.col("n_lines") > 1) & tail & (most > 0)).select("doc_id", kind.alias("kind"))
