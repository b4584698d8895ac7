"""Evaluation passages in corpus documents, by pigeonhole pieces and Myers' bit-parallel distance.

Words are maximal runs of letters and digits in lower case. A leak of an item with n words is a run of
L = ceil(n * share) of its successive words in a document, up to ``errors`` word edits. The item is split
into pieces of m = (L + 1) // (errors + 2) words, so any such run spans errors + 1 whole pieces and one of
them stands in the document unedited. Exact piece hits come from rolling hashes of a whole Arrow batch;
around each, Myers' algorithm (1999), over words, verifies the runs that may lie within the budget; of the verified ones
the longest exact run is reported too.

The items are the query set: they go to every task in blocks of at most ``block`` items and ``block_words`` words (an item
longer than that has a block of its own), so what is sent has a bound at any number of items. Documents are read once
per block and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codepoints as cp


@dataclass(frozen=True)
class Leak:
    share: float = 0.5
    errors: int = 1
    block: int = 20_000
    block_words: int = 2_000_000


def distance(pattern: list[int], text: list[int]) -> int:
    """Least edit distance of the pattern to any stretch of the text (Myers 1999; one machine word of any size)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[int, int] = {}
    for i, x in enumerate(pattern):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for x in text:
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a stretch may begin anywhere
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best


@dataclass
class Items:
    """Items of one block: word hashes of all in one array (item i: ``words[first[i]:first[i + 1]]``), and their pieces by length."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    need: np.ndarray
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted hashes, item, place in the item

    @classmethod
    def of(cls, ids: list[int], passages: list[str | None], spec: Leak) -> Items:
        row, words = cp.word_hashes(*cp.to_codes(pa.array(passages, pa.string())))
        first = np.searchsorted(row, np.arange(len(ids) + 1))
        size = np.diff(first)
        need = np.ceil(size * spec.share).astype(np.int64)
        length = np.minimum(need, np.maximum(1, (need + 1) // (spec.errors + 2)))
        pieces = {}
        for m in np.unique(length[length > 0]).tolist():
            mine = np.flatnonzero(length == m)
            count = size[mine] // m
            item = np.repeat(mine, count)
            at = (np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)) * m
            h = cp.windows(words, m)[first[item] + at]
            order = np.argsort(h, kind="stable")
            pieces[m] = h[order], item[order], at[order]
        return cls(np.array(ids, np.int64), words, first, need, pieces)


def _hits(h: np.ndarray, row: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (row, item, word of the batch minus word of the item) of exact piece hits."""
    out = []
    for m, (pieces, item, at) in items.pieces.items():
        grams = cp.windows(h, m)
        if not len(grams):
            continue
        lo = np.searchsorted(pieces, grams)
        hit = np.flatnonzero(pieces[np.minimum(lo, len(pieces) - 1)] == grams)
        hit = hit[row[hit] == row[hit + m - 1]]
        hi = np.searchsorted(pieces, grams[hit], side="right")
        n = hi - lo[hit]
        which = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(hit, n)
        out.append(np.stack([row[place], item[which], place - at[which]], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def _promising(h: np.ndarray, bounds: np.ndarray, hits: np.ndarray, items: Items, spec: Leak) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, item, shift, starts) of the hits around which runs of the item can lie within the budget, and where in the
    item these runs begin: none within it is dropped.

    A run with up to e edits keeps all but e of its words on diagonals at most e apart; the words found there are
    counted for all hits and all runs at once, over flat arrays.
    """
    size = np.diff(items.first)
    ends = np.cumsum(size[hits[:, 1]])
    done = 0
    while done < len(hits):
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + (1 << 20), side="right")))
        part, n = hits[done:upto], size[hits[done:upto, 1]]
        done = upto
        at = np.concatenate([[0], np.cumsum(n)])
        hit = np.repeat(np.arange(len(part)), n)
        k = np.arange(at[-1]) - at[hit]
        row, item, shift = part[hit].T
        word = items.words[items.first[item] + k]
        there = np.zeros(len(k), bool)
        for delta in range(-spec.errors, spec.errors + 1):
            place = shift + k + delta
            inside = (place >= bounds[row]) & (place < bounds[row + 1])
            there |= inside & (h[np.clip(place, 0, len(h) - 1)] == word)
        total = np.concatenate([[0], np.cumsum(there)])
        need = items.need[item]
        fits = k + need <= n[hit]
        begin = np.arange(len(k))
        found = total[np.where(fits, begin + need, begin)] - total[begin]
        good = np.flatnonzero(fits & (found >= need - spec.errors))
        good = good[np.lexsort((-found[good], hit[good]))]  # of each hit the fullest run first
        which, starts = np.unique(hit[good], return_index=True)
        for w, run in zip(which.tolist(), np.split(k[good], starts[1:])):
            yield (*part[w].tolist(), run)


def _judge(h: np.ndarray, lo: int, hi: int, shift: int, words: np.ndarray, need: int, starts: np.ndarray, spec: Leak) -> tuple[int, int]:
    """(least distance of a run of ``need`` words of the item that begins at ``starts``, longest exact run) where word 0 lies
    at ``shift``. Words lo..hi of ``h`` are the document."""
    n = len(words)
    text = h[max(lo, shift - spec.errors) : max(lo, min(hi, shift + n + spec.errors))].tolist()
    best = need
    for j in starts.tolist():
        best = min(best, distance(words[j : j + need].tolist(), text))
        if not best:
            break
    a, b = max(0, lo - shift), min(n, hi - shift)
    apart = np.concatenate([[a - 1], np.flatnonzero(words[a:b] != h[shift + a : shift + b]) + a, [b]])
    return best, int(np.diff(apart).max()) - 1


def leaks(documents: DataFrame, items: DataFrame, spec: Leak = Leak()) -> DataFrame:
    """(doc_id, item_id, distance, run, need): documents that hold a run of an item, once per pair.

    ``distance``: word edits of the best run of ``need`` words, at most ``spec.errors``; 0 for an unbroken run.
    Null and empty texts and passages, and items without a number, leak nothing; repeated rows count once.
    """
    rows = items.where("passage IS NOT NULL AND item_id IS NOT NULL").select("item_id", "passage").dropDuplicates(["item_id"]).orderBy("item_id").toLocalIterator()
    blocks: list[DataFrame] = []
    block: list = []
    source = documents.where("text IS NOT NULL").select("doc_id", "text")

    def scan(known: Items) -> DataFrame:
        sent = documents.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for whole in batches:
                for batch in cp.slices(whole, "text"):
                    row, h = cp.word_hashes(*cp.to_codes(batch.column("text")))
                    bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for r, i, shift, starts in _promising(h, bounds, _hits(h, row, known), known, spec):
                        d, n = _judge(h, int(bounds[r]), int(bounds[r + 1]), shift, known.words[known.first[i] : known.first[i + 1]], int(known.need[i]), starts, spec)
                        if d <= spec.errors:
                            old = best.get((r, i), (d, n))
                            best[r, i] = min(d, old[0]), max(n, old[1])
                    at = np.array(list(best), np.int64).reshape(-1, 2)
                    value = np.array(list(best.values()), np.int32).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(at[:, 0])), pa.array(known.ids[at[:, 1]]), pa.array(value[:, 0]), pa.array(value[:, 1]), pa.array(known.need[at[:, 1]].astype(np.int32))],
                        ["doc_id", "item_id", "distance", "run", "need"],
                    )

        return source.mapInArrow(run, "doc_id long, item_id long, distance int, run int, need int")

    def close() -> None:
        if block:
            blocks.append(scan(Items.of([r.item_id for r in block], [r.passage for r in block], spec)))
            block.clear()

    size = 0
    for r in rows:
        n = len(r.passage) // 2 + 1  # words at most
        if block and (len(block) == spec.block or size + n > spec.block_words):
            close()
            size = 0
        block.append(r)
        size += n
    close()
    if not blocks:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, run int, need int")
    out = blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("run").alias("run"), F.first("need").alias("need"))
