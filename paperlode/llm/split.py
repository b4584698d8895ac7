"""Splitting oversized items at natural boundaries, by byte ranges, with a fixed overlap.

An item is cut into byte ranges of ``range_bytes``; a worker gets one range with a halo and needs no other
part of the item. It detects boundaries, and for each place where a piece may start in its range it follows
the pieces up to the next range (a jump table of at most ``limit - overlap`` entries). The tables of an item
are stitched in order, with prefix sums of characters and pieces, which gives each range the place of its first
piece; each range then emits its own pieces by offset. An item of one range needs no stitching.

Cuts, by preference: the last paragraph break, line break, sentence end in the second half of the window; the
last white space beyond the overlap; else before the last character that isn't a combining mark. Each piece
but the first starts exactly ``overlap`` characters before the end of the one before it.

Null and empty texts give no piece; a text of up to ``limit`` characters gives one piece, itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from ..functions import codepoints as cp
from ..session import written


@dataclass(frozen=True)
class Split:
    """Sizes in characters (code points), ranges in bytes."""

    limit: int = 1200
    overlap: int = 200
    range_bytes: int = 4 << 20

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit // 2:
            raise ValueError("the overlap must be less than half the limit")


_SPACES = np.zeros(0x110000, bool)
_SPACES[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_STOPS = np.zeros(0x110000, bool)
_STOPS[[ord(c) for c in ".!?…。！？"]] = True
_MARKS = np.zeros(0x110000, bool)
_MARKS[[*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), 0x200D, *range(0x20D0, 0x2100), *range(0xFE00, 0xFE10), *range(0xFE20, 0xFE30)]] = True


def boundaries(codes: np.ndarray) -> list[np.ndarray]:
    """For each kind of boundary, best first: the last place p' <= p where a cut may lie before p', for p in 0..n.

    -1 where there is none. The kinds: paragraph, line, sentence, space, character.
    """
    n = len(codes)
    space = _SPACES[codes]
    line = (codes == 10) | (codes == 12)
    after = np.zeros((5, n + 1), bool)  # after[kind, p]: a cut between p - 1 and p
    after[1, 1:] = line
    after[0, 2:] = line[1:] & line[:-1]
    after[0, 1:] |= codes == 12
    after[2, 2:] = space[1:] & _STOPS[codes[:-1]]
    after[3, 1:] = space
    after[4, 1:n] = ~_MARKS[codes[1:]]
    place = np.arange(n + 1)
    return [np.maximum.accumulate(np.where(row, place, -1)) for row in after]


def cuts(codes: np.ndarray, starts: np.ndarray, spec: Split) -> np.ndarray:
    """The end of a piece for each start; starts + limit must lie within the codes."""
    reach = starts + spec.limit
    least = (starts + spec.limit // 2, starts + spec.limit // 2, starts + spec.limit // 2, starts + spec.overlap + 1, starts + spec.overlap + 1)
    end = np.full(len(starts), -1)
    for last, low in zip(boundaries(codes), least):
        at = last[reach]
        end = np.where((end < 0) & (at >= low), at, end)
    return np.where(end < 0, reach, end)


def follow(codes: np.ndarray, n: int, whole: bool, entries: np.ndarray, spec: Split) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Follow the pieces from each entry through a range of ``n`` characters (the codes go on beyond it).

    ``whole``: the codes reach the item's end. Returns how far beyond the range each path leaves it (-1 when
    the item ends), the pieces begun on the way, and the piece starts and ends of each step.
    """
    # pieces that begin where more than ``limit`` characters follow are cut, others end the item
    nxt_start = np.arange(n)
    room = len(codes) - nxt_start
    cut = room > spec.limit
    ends = np.where(cut, 0, len(codes))
    if cut.any():
        ends[cut] = cuts(codes, nxt_start[cut], spec)
    at, count = entries.copy(), np.zeros(len(entries), np.int64)
    leave = np.full(len(entries), -2)
    steps = []
    while True:
        out = (leave == -2) & (at >= n)
        leave[out] = at[out] - n
        live = np.flatnonzero(leave == -2)
        if not len(live):
            return leave, count, steps
        s = at[live]
        steps.append(np.stack([live, s, ends[s]]))
        count[live] += 1
        done = ~cut[s]
        leave[live[done]] = -1
        at[live] = np.where(done, s, ends[s] - spec.overlap)


def _aligned(data: bytes, lo: int, hi: int) -> tuple[int, int]:
    """lo and hi moved on to the start of a character."""
    while lo < len(data) and data[lo] & 0xC0 == 0x80:
        lo += 1
    while hi < len(data) and data[hi] & 0xC0 == 0x80:
        hi += 1
    return lo, hi


@dataclass
class Range:
    """One byte range with its halo, decoded."""

    codes: np.ndarray
    n: int
    whole: bool
    at: np.ndarray  # byte offset in the item of each code, and of the end

    @classmethod
    def of(cls, data: bytes, skip: int, length: int, begin: int, size: int) -> Range:
        """``data`` starts at byte ``begin - skip`` of an item of ``size`` bytes; the range is [begin, begin + length)."""
        lo, hi = _aligned(data, skip, min(skip + length, len(data)))
        end = len(data)
        whole = begin - skip + end >= size
        if not whole:  # drop a character cut at the end
            back = end - 1
            while back > hi and data[back] & 0xC0 == 0x80:
                back -= 1
            end = max(back, hi)
        codes = np.frombuffer(data[lo:end].decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(cp.widths(codes))]) + (begin - skip + lo)
        n = int(np.searchsorted(at, begin - skip + hi))
        return cls(codes, min(n, len(codes)), whole, at)


def _pieces(r: Range, entry: int, piece: int, chars: int, spec: Split) -> list[tuple]:
    _, _, steps = follow(r.codes, r.n, r.whole, np.array([entry]), spec)
    out = []
    for k, (_, (s,), (e,)) in enumerate(steps):
        text = r.codes[s:e].tobytes().decode("utf-32-le")
        out.append((piece + k, chars + int(s), chars + int(e), int(r.at[s]), int(r.at[e]), text))
    return out


def _table(rows: list[tuple], key: pa.Field) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = [key.type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key.name, "piece", "first_char", "last_char", "first_byte", "last_byte", "text"])


def text_ranges(df: DataFrame, key: str, text: str, spec: Split) -> DataFrame:
    """(key, size, begin, skip, length, data): the byte ranges of a text column, each with its halo."""
    halo = 4 * spec.limit + 4
    data = F.col("_data")
    return (
        df.where(F.length(text) > 0)
        .select(key, F.col(text).cast("binary").alias("_data"))
        .withColumn("size", F.octet_length(data).cast("long"))
        .withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(spec.range_bytes).cast("long"))))
        .withColumn("skip", F.least(F.col("begin"), F.lit(4)).cast("int"))
        .withColumn("length", F.least(F.lit(spec.range_bytes), F.col("size") - F.col("begin")).cast("int"))
        .withColumn("data", F.substring(data, (F.col("begin") - F.col("skip") + 1).cast("int"), F.col("skip") + F.col("length") + halo))
        .drop("_data")
    )


def file_ranges(files: DataFrame, path: str, size: str, spec: Split) -> DataFrame:
    """The same for files on a path every worker can open: (path, size) rows; a worker reads its range alone."""
    halo = 4 * spec.limit + 4

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, n, begin, skip, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
                with open(p, "rb") as f:
                    f.seek(begin - skip)
                    data = f.read(skip + length + halo)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((p, n, begin, skip, length, data), kinds)], [path, "size", "begin", "skip", "length", "data"])

    step = F.lit(spec.range_bytes).cast("long")
    rows = (
        files.where(F.col(size) > 0)
        .select(path, F.col(size).cast("long").alias("size"))
        .withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)))
        .withColumn("skip", F.least(F.col("begin"), F.lit(4)).cast("int"))
        .withColumn("length", F.least(step, F.col("size") - F.col("begin")).cast("int"))
    )
    return rows.mapInArrow(run, f"`{path}` string, size long, begin long, skip int, length int, data binary")


def split_ranges(ranges: DataFrame, key: str, spec: Split = Split()) -> DataFrame:
    """(key, piece, first_char, last_char, first_byte, last_byte, text) of every item; key must be unique.

    Offsets count from the item's start. Ranges of one item may lie in any partition and order.
    """
    field = ranges.schema[key]
    schema = StructType([field]).add("piece", IntegerType()).add("first_char", LongType()).add("last_char", LongType()).add("first_byte", LongType()).add("last_byte", LongType()).add("text", StringType())

    def rows(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names))

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, size, begin, skip, length, data in rows([batch], [key, "size", "begin", "skip", "length", "data"]):
                out += [(k, *p) for p in _pieces(Range.of(data, skip, length, begin, size), 0, 0, 0, spec)]
            yield _table(out, batch.schema.field(key))

    alone = ranges.where(F.col("size") <= spec.range_bytes).mapInArrow(single, schema)
    several = ranges.where(F.col("size") > spec.range_bytes)

    entries = spec.limit - spec.overlap

    def jumps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, size, begin, skip, length, data in rows([batch], [key, "size", "begin", "skip", "length", "data"]):
                r = Range.of(data, skip, length, begin, size)
                leave, count, _ = follow(r.codes, r.n, r.whole, np.arange(entries if begin else 1), spec)
                out.append((k, begin, r.n, leave.astype(np.int32), count.astype(np.int32)))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(key).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.list_(pa.int32()))],
                [key, "begin", "n", "leave", "count"],
            )

    jump_schema = StructType([field]).add("begin", LongType()).add("n", LongType()).add("leave", ArrayType(IntegerType())).add("count", ArrayType(IntegerType()))

    def stitch(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("begin")
        entry, chars, piece, out = 0, 0, 0, []
        for k, begin, n, leave, count in table.itertuples(index=False):
            if entry < 0:
                break
            out.append((k, begin, entry, chars, piece))
            piece += int(count[entry])
            entry, chars = int(leave[entry]), chars + n
        return pd.DataFrame(out, columns=[key, "begin", "entry", "chars", "pieces"])

    stitched = several.mapInArrow(jumps, jump_schema).groupBy(key).applyInPandas(stitch, StructType([field]).add("begin", LongType()).add("entry", IntegerType()).add("chars", LongType()).add("pieces", LongType()))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, size, begin, skip, length, data, entry, chars, pieces in rows([batch], [key, "size", "begin", "skip", "length", "data", "entry", "chars", "pieces"]):
                out += [(k, *p) for p in _pieces(Range.of(data, skip, length, begin, size), entry, pieces, chars, spec)]
            yield _table(out, batch.schema.field(key))

    return alone.unionByName(several.join(stitched, [key, "begin"]).mapInArrow(emit, schema))


def split_text(df: DataFrame, key: str, text: str, spec: Split = Split()) -> DataFrame:
    """Pieces of every text of ``df``; see :func:`split_ranges`."""
    return split_ranges(text_ranges(df, key, text, spec), key, spec)


def oversized(chunks: DataFrame, spec: Split = Split()) -> DataFrame:
    """Chunk rows over the limit, replays once."""
    return chunks.where(F.length("text_utf8") > spec.limit).dropDuplicates(["chunk_id"])


def chunk_pieces(chunks: DataFrame, spec: Split = Split()) -> DataFrame:
    """Pieces of oversized chunks: (chunk_id, doc_id, page_no, chunk_ord, char_start, char_end, text_utf8).

    chunk_ord counts on from the row's own, and rows after it on the page move up; char_start and char_end
    are byte offsets in the page, on top of the row's own start.
    """
    rows = written(oversized(chunks, spec))
    pieces = split_text(rows, "chunk_id", "text_utf8", spec)
    before = Window.partitionBy("doc_id", "page_no").orderBy("chunk_ord", "chunk_id", "piece")
    return (
        rows.select("chunk_id", "doc_id", "page_no", "chunk_ord", "char_start")
        .join(pieces, "chunk_id")
        .withColumn("_more", F.sum((F.col("piece") > 0).cast("int")).over(before))
        .select(
            "chunk_id", "doc_id", "page_no", (F.col("chunk_ord") + F.col("_more")).cast("int").alias("chunk_ord"),
            (F.col("char_start") + F.col("first_byte")).cast("int").alias("char_start"), (F.col("char_start") + F.col("last_byte")).cast("int").alias("char_end"), F.col("text").alias("text_utf8"),
        )
    )


def found(chunks: DataFrame, spec: Split = Split()) -> DataFrame:
    """(chunk_id) of chunks that come out in more than one piece."""
    return split_text(written(oversized(chunks, spec)), "chunk_id", "text_utf8", spec).where("piece = 1").select("chunk_id")


def rejoined(pieces: DataFrame, key: str) -> DataFrame:
    """(key, text): the items again, from pieces as :func:`split_ranges` gives them, each without what the one before it holds.

    The pieces of an item come together: its whole text is one value of the result.
    """
    before = F.lag("last_char").over(Window.partitionBy(key).orderBy("piece"))
    own = F.substring(F.col("text"), (F.coalesce(before - F.col("first_char"), F.lit(0)) + 1).cast("int"), F.length("text"))
    return pieces.withColumn("own", own).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda p: p["own"]), "").alias("text"))
