"""Filling containers of a fixed capacity in tokens.

Sizes are token counts of a public tokenizer. An item over the capacity is cut into full containers and a rest;
no other item is cut. The rest is packed in groups of about ``group`` items, made by hash, each on its own, so no
task depends on the number of documents and at most a few containers a group stay open. In a group, items above
a third of the capacity are matched greedily, at most two to a container: the largest with the largest that
fits. Then smaller items, largest first, go where the least room is left after them (best fit).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Fixed value: the public pattern that splits text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Packing:
    """``ranks``: file of the tokenizer's ranks, readable by every worker."""

    capacity: int = 2048
    group: int = 20_000
    ranks: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN


@cache
def _encoding(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sizes(documents: DataFrame, spec: Packing = Packing()) -> DataFrame:
    """(doc_id, tokens) of every document; null and empty texts have none, rows without doc_id are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(spec.ranks, spec.pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return documents.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")


def pack(size: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item; sizes are at most the capacity and in any order.

    Ties go by place, so equal input gives equal output.
    """
    out = np.full(len(size), -1, np.int64)
    order = np.argsort(-size, kind="stable")
    split = int(np.searchsorted(-size[order], -(capacity // 3), side="left"))  # size > capacity // 3
    large, small = order[:split].tolist(), order[split:].tolist()
    # buckets of large items by size; below[s] leads to the largest size <= s that has an item left
    bucket: dict[int, list[int]] = {}
    for i in reversed(large):
        bucket.setdefault(int(size[i]), []).append(i)
    below = list(range(capacity + 1))

    def find(s: int) -> int:
        path = []
        while s > 0 and not (below[s] == s and bucket.get(s)):
            path.append(s)
            s = below[s] if below[s] != s else s - 1
        for p in path:
            below[p] = s
        return s

    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit s: a container has s tokens of room
    n = 0
    for i in large:
        if out[i] >= 0:
            continue
        bucket[int(size[i])].pop()
        out[i] = n
        left = capacity - int(size[i])
        mate = find(left)
        if mate:
            j = bucket[mate].pop()
            out[j] = n
            left -= mate
        room[left].append(n)
        there |= 1 << left
        n += 1
    for i in small:
        s = int(size[i])
        fits = there >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            c = room[left].pop()
            if not room[left]:
                there &= ~(1 << left)
        else:
            c, left = n, capacity
            n += 1
        out[i] = c
        room[left - s].append(c)
        there |= 1 << (left - s)
    return out


def assign(measured: DataFrame, spec: Packing = Packing()) -> DataFrame:
    """(doc_id, piece, first_token, last_token, container_id) of every document in (doc_id, tokens).

    A document without tokens takes part with no room. A doc_id that is given twice is packed twice.
    """
    measured = written(measured)
    pieces = (
        measured.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / spec.capacity) - 1, F.lit(0)))))
        .withColumn("first_token", F.col("piece") * spec.capacity)
        .withColumn("last_token", F.least(F.col("tokens"), F.col("first_token") + spec.capacity))
        .select("doc_id", F.col("piece").cast("int").alias("piece"), "first_token", "last_token")
    )
    groups = max(1, -(-measured.count() // spec.group))
    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long")

    def fill(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["doc_id", "piece", "first_token"], ignore_index=True)
        local = pack((table["last_token"] - table["first_token"]).to_numpy(), spec.capacity)
        table["container_id"] = (table["g"].to_numpy() << 32) | local
        return table[["doc_id", "piece", "first_token", "last_token", "container_id"]]

    schema = "doc_id long, piece int, first_token long, last_token long, container_id long"
    return pieces.withColumn("g", key).groupBy("g").applyInPandas(fill, schema)


def fill_report(assigned: DataFrame, spec: Packing = Packing()) -> DataFrame:
    """(containers, tokens, unused_share): one row."""
    return assigned.agg(F.count_distinct("container_id").alias("containers"), F.sum(F.col("last_token") - F.col("first_token")).alias("tokens")).withColumn(
        "unused_share", 1 - F.col("tokens") / (F.col("containers") * spec.capacity)
    )
