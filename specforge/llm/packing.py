"""Packing into length buckets whose bounds a dynamic program over the global histogram of lengths chooses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, n_words, running

BUCKETS = 16
TOKEN_BUDGET = 8192
#: Lengths below this have a histogram bin each; longer ones share bins of this relative fineness (1 / FINE).
FINE = 4096


def bin_top(length: Column) -> Column:
    """The greatest length in a length's bin: the length itself below 2 * FINE, else rounded up to 12 leading bits."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int") - 12)
    width = F.pow(F.lit(2.0), shift).cast("long")
    return (F.ceil(length / width) * width).cast("long")


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` ranges over (length, count) that minimise the sum of bound * count.

    best_k[j] = min over i < j of best_{k-1}[i] + length_j * (count_j - count_i), counts cumulated: for each k the
    candidates i are lines in length_j, whose lower envelope is walked once, so a layer takes linear time.
    """
    lengths = [n for n, _ in sorted(histogram)]
    total = [0]
    for _, c in sorted(histogram):
        total.append(total[-1] + c)
    n = len(lengths)
    if not n:
        return []
    best, back = [0] + [None] * n, []
    for _ in range(min(buckets, n)):
        new, came = [None] * (n + 1), [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height, i
        head = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                m, b = -total[j - 1], best[j - 1]
                while len(hull) - head >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, j - 1))
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            if head < len(hull):
                m, b, i = hull[head]
                new[j], came[j] = x * total[j] + m * x + b, i
        back.append(came)
        best = new
    bounds, j = [], n
    for came in reversed(back):
        bounds.append(lengths[j - 1])
        j = came[j]
        if not j:
            break
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, salt: str = "pack") -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding for every row of docs (doc_id, text).

    Tokens are words. Each bucket's rows stand in the order of md5(salt|doc_id), doc_id and fill batches of
    max(1, budget // bucket_len) rows, so a batch holds at most the budget, padding included, unless one row alone is
    longer. Null and empty texts have 0 tokens and go to the first bucket; repeated rows count each; an empty table gives
    no rows.
    """
    rows = docs.select("doc_id", n_words(F.col("text")).alias("n_tokens"), F.md5(F.concat(F.lit(salt + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")).withColumn("top", bin_top(F.col("n_tokens")))
    rows = materialize(rows, "pack-lengths")
    histogram = [(r["top"], r["n"]) for r in rows.groupBy("top").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 8192 + 4096 per doubling of the length
    bounds = optimal_bounds(histogram, buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("batch_id"), F.lit(0).alias("slot"), F.lit(0).cast("long").alias("padding"))
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    placed = running(rows.withColumn("bucket", F.size(F.filter(array, lambda b: b < F.col("top")))), ["bucket", "key", "doc_id"], [], "pack-rows")
    drop(rows)
    table, first_row, first_batch, low = [], 0, 0, -1
    for i, b in enumerate(bounds):
        n, each = sum(c for t, c in histogram if low < t <= b), max(1, budget // max(1, b))
        table.append((i, b, each, first_row, first_batch))
        first_row, first_batch, low = first_row + n, first_batch + -(-n // each), b
    plan = docs.sparkSession.createDataFrame(table, "bucket int, bucket_len long, each long, first_row long, first_batch long")
    rank = F.col("idx") - F.col("first_row")
    return placed.join(F.broadcast(plan), "bucket").select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        (F.col("first_batch") + F.floor(rank / F.col("each"))).cast("long").alias("batch_id"),
        (rank % F.col("each")).cast("int").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
