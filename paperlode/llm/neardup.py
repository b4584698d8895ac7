"""Near-duplicate documents by b-bit MinHash (Li and König 2010) with banded candidates.

A document's set holds the hashes of all runs of ``words`` successive words within one of its chunks.
Of each of ``bands * rows`` hash functions the minimum is kept; ``rows`` minima make the key of a band,
and the low ``BITS`` bits of all minima are packed into long integers. Documents that share a band key are
candidates; the packed signatures give an estimate of the similarity, corrected for equal bits by chance,
that drops most false candidates by counting bits. An exact check of the sets follows.

Documents with equal sets are one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..operators.components import components
from ..operators.pairs import key_pairs
from ..session import written

#: Bits kept of each minimum.
BITS = 2
#: Copies up to which a class of equal sets is written out pair by pair.
FEW = 64


@dataclass(frozen=True)
class NearDup:
    """A pair of similarity ``similarity`` shares no band with probability (1 - similarity**rows)**bands.

    ``slack``: standard errors by which the estimate may fall short of the threshold.
    """

    words: int = 5
    similarity: float = 0.8
    least: int = 1
    rows: int = 4
    bands: int = 24
    slack: float = 4.0

    @property
    def matches(self) -> int:
        """Equal lanes from which a candidate is checked."""
        n, chance = self.rows * self.bands, 0.5**BITS
        rate = chance + (1 - chance) * self.similarity
        return max(0, int(np.floor(n * rate - self.slack * np.sqrt(n * rate * (1 - rate)))))


#: What TESTDATA.md states for p3_found.
STATED = NearDup(words=3, similarity=0.6, least=40, rows=3, bands=32)


def _word_runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of a-z and 0-9 within rows."""
    return cp.runs(((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57)), offsets)


def shingles(codes: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``words`` words within a row."""
    row, start, end = _word_runs(codes, offsets)
    h = cp.windows(cp.spans(cp.letter_values()[codes], start, end), words)
    row_end = row[words - 1 :]
    whole = row[: len(h)] == row_end
    return row[: len(h)][whole], h[whole]


def _sets(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, hash), sorted."""
    by = np.lexsort((h, doc))
    doc, h = doc[by], h[by]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _whole_docs(batches: Iterable[pa.RecordBatch], limit: int = cp.SLICE_BYTES) -> Iterator[pa.Table]:
    """Rows sorted by doc_id, cut between documents about every ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for batch in cp.slices(whole, "text_norm_ascii", limit):
            doc = batch.column("doc_id").to_numpy()
            turn = np.flatnonzero(doc[1:] != doc[:-1]) + 1
            first = int(turn[0]) if len(turn) else len(doc)
            if held and held[-1].column("doc_id")[-1].as_py() != doc[0]:
                first = 0
            size += batch.nbytes
            if size < limit:
                held.append(batch)
                continue
            last = int(turn[-1]) if len(turn) else (0 if first == 0 else None)
            if last is None:
                held.append(batch)
                continue
            done = [*held, batch.slice(0, last)] if last else held
            if done:
                yield pa.Table.from_batches(done)
            held, size = [batch.slice(last)], batch.slice(last).nbytes
    if held:
        yield pa.Table.from_batches(held)


def _doc_sets(table: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, offsets, hashes) of the documents' sets; documents without a shingle are left out."""
    doc = table.column("doc_id").to_numpy()
    row, h = shingles(*cp.to_codes(table.column("text_norm_ascii").combine_chunks()), words)
    doc, h = _sets(doc[row], h)
    ids, first = np.unique(doc, return_index=True)
    return ids, np.append(first, len(doc)), h


def _by_doc(chunks: DataFrame) -> DataFrame:
    return chunks.where("text_norm_ascii IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text_norm_ascii").repartition("doc_id").sortWithinPartitions("doc_id")


def signatures(chunks: DataFrame, spec: NearDup) -> DataFrame:
    """(doc_id, n, digest_1, digest_2, keys, lanes) of documents with at least ``spec.least`` shingles.

    A replayed chunk adds nothing to a set; rows without text or doc_id are left out.
    """
    many = spec.rows * spec.bands
    seeds = cp.mix(np.arange(1, 2 * many + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    mult, add = seeds[:many] | np.uint64(1), seeds[many:]
    per_long = 64 // BITS
    longs = -(-many // per_long)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_docs(batches):
            ids, at, h = _doc_sets(table, spec.words)
            n = np.diff(at)
            keep = n >= spec.least
            if not keep.any():
                continue
            starts = at[:-1]
            with np.errstate(over="ignore"):
                digest_1 = np.add.reduceat(cp.mix(h), starts)[keep]
                digest_2 = np.bitwise_xor.reduceat(h, starts)[keep]
                minima = np.empty((many, len(ids)), np.uint64)
                for j in range(many):
                    minima[j] = np.minimum.reduceat((h * mult[j] + add[j]) >> np.uint64(20), starts)
                minima = minima[:, keep]
                keys = np.empty((int(keep.sum()), spec.bands), np.uint64)
                for band in range(spec.bands):
                    key = np.full(keys.shape[0], band + 1, np.uint64)
                    for j in range(band * spec.rows, (band + 1) * spec.rows):
                        key = cp.mix(key * cp.BASE + minima[j])
                    keys[:, band] = key
                low = cp.mix(minima) & np.uint64((1 << BITS) - 1)
                lanes = np.zeros((keys.shape[0], longs), np.uint64)
                for j in range(many):
                    lanes[:, j // per_long] |= low[j] << np.uint64(BITS * (j % per_long))
            flat = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(x).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep]), pa.array(n[keep].astype(np.int64)), pa.array(digest_1.view(np.int64)), pa.array(digest_2.view(np.int64)), flat(keys), flat(lanes)],
                ["doc_id", "n", "digest_1", "digest_2", "keys", "lanes"],
            )

    return _by_doc(chunks).mapInArrow(run, "doc_id long, n long, digest_1 long, digest_2 long, keys array<long>, lanes array<long>")


def _equal_lanes(many: int) -> Column:
    """Number of lanes that are equal in a.lanes and b.lanes, by counting bits."""
    per_long = 64 // BITS
    odd = F.lit(0x5555555555555555)
    apart = None
    for i in range(-(-many // per_long)):
        x = F.col("a.lanes")[i].bitwiseXOR(F.col("b.lanes")[i])
        one = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
        apart = one if apart is None else apart + one
    return F.lit(many) - apart


def _doc_set_rows(chunks: DataFrame, docs: DataFrame, spec: NearDup) -> DataFrame:
    """(doc_id, hashes) of the documents in ``docs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_docs(batches):
            ids, at, h = _doc_sets(table, spec.words)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(h.view(np.int64)))], ["doc_id", "hashes"])

    return _by_doc(chunks.join(docs, "doc_id", "left_semi")).mapInArrow(run, "doc_id long, hashes array<long>")


def near_classes(chunks: DataFrame, spec: NearDup = NearDup()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id, n) of every document that counts, and (class_a, class_b, similarity) of similar classes.

    A class holds the documents with equal sets; its id is the smallest doc_id.
    """
    signed = written(signatures(chunks, spec))
    same = ["digest_1", "digest_2", "n"]
    classes = signed.groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    members = signed.select("doc_id", *same).join(classes, same).select("doc_id", "class_id", "copies")
    first = signed.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    banded = first.select(F.explode("keys").alias("key"), "doc_id", "lanes")
    candidates = written(
        key_pairs(banded, ["key"], "doc_id", _equal_lanes(spec.rows * spec.bands) >= spec.matches)
        .select(F.col("a.doc_id").alias("class_a"), F.col("b.doc_id").alias("class_b"))
        .distinct()
    )
    needed = candidates.select(F.explode(F.array("class_a", "class_b")).alias("doc_id")).distinct()
    sets = written(_doc_set_rows(chunks, needed, spec))
    both = candidates.join(sets.select(F.col("doc_id").alias("class_a"), F.col("hashes").alias("x")), "class_a").join(sets.select(F.col("doc_id").alias("class_b"), F.col("hashes").alias("y")), "class_b")
    common = both.select("class_a", "class_b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("s"))
    links = common.select("class_a", "class_b", (F.col("c") / (F.col("s") - F.col("c"))).alias("similarity")).where(F.col("similarity") >= spec.similarity)
    return members, links


def near_pairs(chunks: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """(doc_id_a, doc_id_b): documents of at least ``spec.similarity``.

    Documents with equal sets are written out pair by pair in classes of up to ``FEW``; in larger ones each
    is paired with the class's smallest document, which also stands for the class in its other pairs
    (:func:`near_groups` has the membership). No link between different sets is left out.
    """
    members, links = near_classes(chunks, spec)
    members = written(members)
    few = members.where(F.col("copies") <= FEW).unionByName(members.where((F.col("copies") > FEW) & (F.col("doc_id") == F.col("class_id"))))
    across = (
        links.join(few.select(F.col("class_id").alias("class_a"), F.col("doc_id").alias("x")), "class_a")
        .join(few.select(F.col("class_id").alias("class_b"), F.col("doc_id").alias("y")), "class_b")
        .select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    )
    small = members.where(F.col("copies").between(2, FEW)).select("class_id", "doc_id")
    inside = key_pairs(small, ["class_id"], "doc_id").select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))
    star = members.where((F.col("copies") > FEW) & (F.col("doc_id") != F.col("class_id"))).select(F.col("class_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))
    return across.unionByName(inside).unionByName(star)


def near_groups(chunks: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """(doc_id, class_id, group_id, links): one row per document that counts.

    ``links``: classes of different text similar to the document's; group_id: smallest class linked by a chain.
    """
    members, links = near_classes(chunks, spec)
    links = written(links)
    joined = components(links, "class_a", "class_b")
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(joined.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
        .join(ends, "class_id", "left")
        .select("doc_id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
