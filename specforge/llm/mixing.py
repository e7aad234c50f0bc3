"""Mixing of sources to target weights by hash-random order, prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, plainly, running

#: Most times that a source's own words may be taken.
MOST_EPOCHS = 3
#: Weights by rank of the source's name, repeating.
WEIGHTS = (1, 2, 3)


def targets(sizes: list[int], weights: list[int], most: int = MOST_EPOCHS) -> list[float]:
    """Shares of all words by weight; a share above most times its source's size stops there and the excess is shared anew."""
    total, capped = sum(sizes), set()
    level = 0.0
    while len(capped) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in capped]
        level = (total - sum(most * sizes[i] for i in capped)) / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not over:
            break
        capped |= set(over)
    return [float(most * sizes[i]) if i in capped else level * weights[i] for i in range(len(sizes))]


def mix(docs: DataFrame, salt: str = "mix", *extra: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and the columns extra for every row of docs (doc_id, text, source).

    Within a source rows stand in the order of md5(salt|doc_id), doc_id; whole epochs are taken first, then rows in
    that order up to the budget, of which the last row gives only as many words as are left. Null text has size 0, null
    source is a source of its own and comes last; rows of size 0 and sources of size 0 give nothing; an empty table
    gives no rows. Repeated rows count each. Sources are few (a bounded set of names), documents of one may be many.
    """
    key = F.md5(F.concat(F.lit(salt + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select("doc_id", "source", *extra, n_words(F.col("text")).alias("size"), F.col("source").isNull().alias("last"), key.alias("key"))
    placed = running(rows, ["last", "source", "key", "doc_id"], ["size"], "mix-rows")
    spark = docs.sparkSession
    found = sorted(placed.groupBy("source").agg(F.sum("size").alias("s")).collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["s"] for r in found]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]) if found else []
    table, before = [], 0
    for r, t in zip(found, goal):
        budget = int(t)
        epochs = budget // r["s"] if r["s"] else 0
        table.append((r["source"], r["s"], t, before, epochs, budget - epochs * r["s"]))
        before += r["s"]
    plan = spark.createDataFrame(table, "src string, source_size long, target double, source_before long, epochs long, rest long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("before_size") - F.col("source_before"))))
    return placed.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("src"))).select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), *extra)


def mixture(docs: DataFrame) -> DataFrame:
    """docs, all columns, each row as often as mix() takes it, rounded: whole texts only, so a source is within half a text of its budget.

    Equal rows share what they get. A text without words gives no words and so no row; an empty table none. Other columns may have any name.
    """
    plain = plainly(docs, "doc_id", "text", "source")
    keyed = plain.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})
    taken = mix(keyed, "mix", "k1", "k2").filter("taken > 0").groupBy("k1", "k2").agg(((2 * F.sum("taken") + F.sum("size")) / (2 * F.sum("size"))).cast("int").alias("times"))
    again = keyed.join(taken.filter("times > 0"), ["k1", "k2"]).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return again.select(*plain.columns).toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM s),
w AS (SELECT source, source_size, CASE i % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight FROM r),
k AS (SELECT *, sum(3 * source_size) OVER o - 3 * source_size AS capped, sum(weight) OVER (ORDER BY source_size::DOUBLE / weight DESC, source IS NULL DESC, source DESC ROWS UNBOUNDED PRECEDING) AS open_weight,
        (SELECT sum(source_size) FROM s) AS total FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min_by(CAST(total - capped AS DOUBLE) / CAST(open_weight AS DOUBLE), source_size::DOUBLE / weight) FILTER (WHERE CAST(total - capped AS DOUBLE) / CAST(open_weight AS DOUBLE) * weight <= 3 * source_size) AS level FROM k),
t AS (SELECT source, source_size, CASE WHEN level * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target FROM w, l),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || CAST(d.doc_id AS VARCHAR)), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken FROM p
"""
