"""Long exact spans shared between records, by seed and extend.

Seeds: of every ``window`` successive k-grams the smallest hash is an anchor (winnowing, Schleimer et al.
2003), so any stretch of ``k + window - 1`` characters holds an anchor at the same place in both texts.
Extend: on the diagonal of a shared anchor both texts are compared outwards to the first difference;
maximal repeats of at least ``least`` characters stay.

Equal texts are one class and are seeded and extended once. Null texts and texts shorter than ``least``
share nothing. A class within one document is no partner of another class within that document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..operators.pairs import key_pairs
from ..session import written


@dataclass(frozen=True)
class Spans:
    """``least``: characters of a span that counts; ``k``: characters of an anchor (k < least)."""

    least: int = 400
    k: int = 150

    @property
    def window(self) -> int:
        return self.least - self.k + 1


def anchors(codes: np.ndarray, offsets: np.ndarray, spec: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, hash) of every anchor.

    A k-gram is an anchor if it is the smallest of some window in its row, ties included; of a run of
    equal k-grams at successive places (one character repeated) the first and last stay.
    """
    h = cp.windows(cp.letter_values()[codes], spec.k)
    low = cp.moving(h, spec.window)
    if not len(low):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    first = np.arange(len(low))
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    low = np.where(first + spec.least <= ends, low, 0)  # windows that reach into the next text select nothing
    padded = np.concatenate([np.zeros(spec.window - 1, np.uint64), low, np.zeros(len(h) - len(low), np.uint64)])
    at = np.flatnonzero((cp.moving(padded, spec.window, np.maximum)[: len(h)] == h) & (h != 0))
    row = np.searchsorted(offsets, at, side="right") - 1
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (np.diff(at) == 1) & (h[at[1:]] == h[at[:-1]]) & (row[1:] == row[:-1])
    keep = ~(same[:-1] & same[1:])
    at, row = at[keep], row[keep]
    return row, at - offsets[row], h[at]


def _anchor_rows(chunks: DataFrame, spec: Spans) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cp.slices(whole, "text_norm_ascii"):
                row, at, h = anchors(*cp.to_codes(batch.column("text_norm_ascii")), spec)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), *(batch.column(c).take(of) for c in ("digest", "chunk_id", "doc_id"))],
                    ["anchor", "at", "digest", "chunk_id", "doc_id"],
                )

    rows = chunks.where(F.length("text_norm_ascii") >= spec.least).select("chunk_id", "doc_id", "text_norm_ascii", F.unhex(F.md5("text_norm_ascii")).alias("digest"))
    return rows.mapInArrow(run, "anchor long, at int, digest binary, chunk_id long, doc_id long")


def repeats(a: np.ndarray, b: np.ndarray, diagonals: Iterable[int], least: int) -> list[tuple[int, int, int]]:
    """Maximal (start in a, start in b, length) with a[i] == b[i - d] on the diagonals, of length >= least."""
    found = []
    for d in diagonals:
        i = max(0, d)
        n = min(len(a) - i, len(b) - (i - d))
        if n < least:
            continue
        apart = np.flatnonzero(a[i : i + n] != b[i - d : i - d + n])
        edges = np.concatenate([[-1], apart, [n]])
        for k in np.flatnonzero(np.diff(edges) > least):
            s = int(edges[k]) + 1
            found.append((i + s, i - d + s, int(edges[k + 1]) - s))
    return found


def class_spans(chunks: DataFrame, spec: Spans = Spans()) -> DataFrame:
    """(class_a, class_b, start_a, start_b, length): maximal repeats between texts, class_a < class_b.

    A class is the set of chunks with equal text; its id is the smallest chunk_id.
    """
    seeds = written(  # read twice by key_pairs
        _anchor_rows(chunks, spec)
        .groupBy("anchor", "at", "digest")
        .agg(F.min("chunk_id").alias("id"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .drop("digest")
    )
    elsewhere = F.least("a.lo", "b.lo") != F.greatest("a.hi", "b.hi")
    pairs = written(
        key_pairs(seeds, ["anchor"], "id", elsewhere)
        .groupBy(F.col("a.id").alias("class_a"), F.col("b.id").alias("class_b"))
        .agg(F.collect_set(F.col("a.at") - F.col("b.at")).alias("diagonals"))
    )
    needed = pairs.select(F.explode(F.array("class_a", "class_b")).alias("chunk_id")).distinct()
    texts = written(chunks.select("chunk_id", "text_norm_ascii").join(needed, "chunk_id", "left_semi").dropDuplicates(["chunk_id"]))
    both = pairs.join(texts.select(F.col("chunk_id").alias("class_a"), F.col("text_norm_ascii").alias("text_a")), "class_a").join(
        texts.select(F.col("chunk_id").alias("class_b"), F.col("text_norm_ascii").alias("text_b")), "class_b"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            a, a_at = cp.to_codes(batch.column("text_a"))
            b, b_at = cp.to_codes(batch.column("text_b"))
            for i, diagonals in enumerate(batch.column("diagonals").to_pylist()):
                out += [(i, *x) for x in repeats(a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]], diagonals, spec.least)]
            table = np.array(out, np.int64).reshape(-1, 4)
            of = pa.array(table[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_a").take(of), batch.column("class_b").take(of), *(pa.array(table[:, c].astype(np.int32)) for c in (1, 2, 3))],
                ["class_a", "class_b", "start_a", "start_b", "length"],
            )

    return both.mapInArrow(run, "class_a long, class_b long, start_a int, start_b int, length int").distinct()


def copies(chunks: DataFrame, spec: Spans = Spans()) -> DataFrame:
    """(chunk_id, doc_id, class_id, n, lo, hi, stands): membership of every chunk long enough to share a span.

    ``stands``: the chunk takes part in pairs. In classes of up to ``FEW`` copies all do; in larger ones
    the two copies of the lowest and highest document stand for the rest. Classes are aggregates that combine
    before the shuffle, joined back, so a class with a third of all chunks may be split among tasks.
    """
    rows = written(
        chunks.where(F.length("text_norm_ascii") >= spec.least)
        .select("chunk_id", "doc_id", F.unhex(F.md5("text_norm_ascii")).alias("digest"))
        .dropDuplicates(["chunk_id"])
    )
    member = F.struct("doc_id", "chunk_id")
    classes = rows.groupBy("digest").agg(
        F.min("chunk_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(member)["chunk_id"].alias("first"), F.max(member)["chunk_id"].alias("last")
    )
    stands = (F.col("n") <= FEW) | F.col("chunk_id").isin(F.col("first"), F.col("last"))
    return rows.join(classes, "digest").select("chunk_id", "doc_id", "class_id", "n", "lo", "hi", "first", "last", stands.alias("stands"))


#: Copies up to which a class of equal texts is written out pair by pair; beyond it membership says the same.
FEW = 64


def shared_pairs(chunks: DataFrame, spec: Spans = Spans()) -> DataFrame:
    """(chunk_id_a, chunk_id_b): chunks of different documents that share a span of ``spec.least`` characters.

    Between equal texts: all pairs in classes of up to ``FEW`` copies; in larger classes each copy with one
    copy in another document (:func:`copies` has the membership). Between different texts no link is left out.
    """
    members = copies(chunks, spec).where("n > 1 OR stands")
    links = class_spans(chunks, spec).select("class_a", "class_b").distinct()
    few = members.where("stands").select("chunk_id", "doc_id", "class_id")
    across = (
        links.join(few.select(F.col("class_id").alias("class_a"), F.col("chunk_id").alias("x"), F.col("doc_id").alias("x_doc")), "class_a")
        .join(few.select(F.col("class_id").alias("class_b"), F.col("chunk_id").alias("y"), F.col("doc_id").alias("y_doc")), "class_b")
        .where("x_doc <> y_doc")
        .select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))
    )
    several = members.where("lo <> hi")
    small = key_pairs(several.where(F.col("n") <= FEW).select("class_id", "chunk_id", "doc_id"), ["class_id"], "chunk_id", F.col("a.doc_id") != F.col("b.doc_id"))
    inside = small.select(F.col("a.chunk_id").alias("chunk_id_a"), F.col("b.chunk_id").alias("chunk_id_b"))
    other = F.when(F.col("doc_id") != F.col("lo"), F.col("first")).otherwise(F.col("last"))
    star = several.where(F.col("n") > FEW).select(F.least("chunk_id", other).alias("chunk_id_a"), F.greatest("chunk_id", other).alias("chunk_id_b"))
    return across.unionByName(inside).unionByName(star).distinct()


def shared_length(chunks: DataFrame, spec: Spans = Spans()) -> DataFrame:
    """(chunk_id, n_chars, n_shared): characters of each active chunk that other documents hold in such a span.

    Every chunk comes out, with 0 where nothing is shared or the text is null.
    """
    spans = class_spans(chunks, spec)
    whole = copies(chunks, spec)
    ranges = (
        spans.select(F.explode(F.array(F.struct(F.col("class_a").alias("class_id"), F.col("start_a").alias("s"), "length"), F.struct(F.col("class_b").alias("class_id"), F.col("start_b").alias("s"), "length"))).alias("r"))
        .groupBy("r.class_id", "r.s").agg(F.max(F.col("r.s") + F.col("r.length")).alias("e"))
    )
    # by now a class has at most one row for each of its characters
    before = F.max("e").over(Window.partitionBy("class_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    covered = ranges.withColumn("from", F.greatest("s", F.coalesce(before, F.lit(0)))).groupBy("class_id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.col("from"))).alias("covered"))
    lengths = chunks.select("chunk_id", F.coalesce(F.length("text_norm_ascii"), F.lit(0)).alias("n_chars")).dropDuplicates(["chunk_id"])
    return (
        lengths.join(whole.select("chunk_id", "class_id", "lo", "hi"), "chunk_id", "left")
        .join(covered, "class_id", "left")
        .select("chunk_id", "n_chars", F.when(F.col("lo") != F.col("hi"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("n_shared"))
    )
