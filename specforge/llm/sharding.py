"""Minimax contiguous sharding: the smallest shard capacity for ordered atomic groups, found by binary search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, n_bytes, running

#: Cells of group ends that the driver holds from one refinement, whatever the input's size.
CELLS = 50_000


class _Ends:
    """What the driver knows of the sorted group ends: cells with least end, greatest end and number of ends."""

    def __init__(self, least: np.ndarray, most: np.ndarray, count: np.ndarray):
        order = np.argsort(least)
        self.least, self.most, self.count = least[order], most[order], count[order]

    def below(self, x: int, sure: bool) -> int:
        """The greatest end <= x; inside a cell that isn't known in full, the least (sure) or greatest value it can have."""
        i = int(np.searchsorted(self.least, x, "right")) - 1
        if i < 0:
            return 0
        return int(self.most[i]) if x >= self.most[i] else int(self.least[i]) if sure else int(x)

    def cuts(self, capacity: int, shards: int, sure: bool) -> list[int]:
        at, out = 0, []
        for _ in range(shards):
            at = self.below(at + capacity, sure)
            out.append(at)
        return out


def _search(low: int, high: int, ok) -> int:
    """The smallest value in low..high that is ok; high is."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid + 1, high)
    return low


def minimax_cuts(ends: DataFrame, total: int, shards: int, cells: int = CELLS) -> list[int]:
    """Greedy cuts at the smallest capacity for which `shards` contiguous shards hold all groups.

    ends has one long `end` per group: its size plus those of all groups before. The driver holds cells of ends only
    and asks for finer cells where a cut can still fall, so its memory does not grow with the number of groups.
    """
    if total <= 0:
        return [0] * shards

    def fetch(where, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = (ends if where is None else ends.filter(where)).groupBy(F.floor(F.col("end") / width)).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count_distinct("end").alias("n")).collect()
        return tuple(np.array([r[k] for r in rows], np.int64) for k in ("a", "b", "n"))

    known = _Ends(*fetch(None, max(1, -(-total // cells))))
    while True:
        sure = _search(1, total, lambda c: known.cuts(c, shards, True)[-1] >= total)
        perhaps = _search(1, sure, lambda c: known.cuts(c, shards, False)[-1] >= total)
        if sure == perhaps and known.cuts(sure, shards, True) == known.cuts(sure, shards, False):
            return known.cuts(sure, shards, True)
        windows = list(zip(known.cuts(perhaps, shards, True), known.cuts(sure, shards, False)))
        open_cells = (known.count > 1) & np.logical_or.reduce([(known.least <= b + 1) & (known.most >= a - 1) for a, b in windows])
        if not open_cells.any():
            return known.cuts(sure, shards, True)
        spans: list[list[int]] = []
        for a, b in zip(known.least[open_cells], known.most[open_cells]):
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = int(b)
            else:
                spans.append([int(a), int(b)])
        # few spans: one for each cut's window
        where = F.lit(False)
        for a, b in spans:
            where = where | F.col("end").between(a, b)
        width = max(1, -(-sum(b - a + 1 for a, b in spans) // cells))
        fine = fetch(where, width)
        keep = ~open_cells
        known = _Ends(*(np.concatenate([x[keep], y]) for x, y in zip((known.least, known.most, known.count), fine)))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    Size: UTF-8 bytes plus 8. Rows of equal text (all null texts: one group) stay together; groups stand in the order
    of their text's digest, rows of a group in that of doc_id. The greatest shard is as small as contiguous cuts allow
    (law `bytes`). A group larger than an even share makes its shard larger; fewer groups than shards leave shards
    empty; an empty table gives no rows. Repeated rows are rows of one group. Other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.sha2(F.col("text"), 256), F.lit("null")).alias("gkey"),
        (n_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = running(rows, ["gkey", "doc_id"], ["size"], "shard-rows")
    ends = materialize(placed.groupBy("gkey").agg(F.max(F.col("before_size") + F.col("size")).alias("end")).select("end"), "shard-ends")
    total = ends.agg(F.max("end")).first()[0] or 0
    cuts = sorted(set(minimax_cuts(ends, total, shards)[:-1]) - {0}) if total else []
    drop(ends)
    number = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("before_size"))) if cuts else F.lit(0)
    sharded = placed.withColumn("shard", number.cast("int"))
    firsts = sharded.groupBy("shard").agg(F.min("idx").alias("first"))  # one row per shard
    return sharded.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("idx") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
