"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, plainly, small_batches
from .textkernel import BLANK, LOWER, PLACE, mix, prefix_hash

#: Lengths in bytes of the character n-grams, and the number of feature slots they are hashed to.
GRAMS, SLOTS = (4, 5), 1 << 20
#: At most this many labelled rows are fitted, in the order of md5(doc_id): a documented bound.
FIT_ROWS = 5_000
#: A feature counts if at least this many fitted rows have it and its log-count ratio is at least this far from 0.
SEEN, RATIO = 4, 0.7
#: Weight decay, step length, steps, and the probability from which a text is called toxic.
DECAY, RATE, STEPS, THRESHOLD = 1e-5, 0.2, 80, 0.3


def features(text: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """The distinct slots of a text's n-grams. ASCII letters count in lower case, each blank as a space, with one before and after."""
    b = np.full(len(text) + 2, 32, np.uint8)
    b[1:-1] = np.where(BLANK[text], 32, LOWER[text])
    c = prefix_hash(b)
    from .textkernel import powers

    _, down = powers(len(c))
    found = []
    for g in GRAMS:
        n = len(b) - g + 1
        if n > 0:
            found.append(mix((c[g:] - c[:-g]) * down[:n] + PLACE[g]) >> np.uint64(64 - 20))
    slots = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
    at = np.arange(len(slots), dtype=np.int32)
    stamp[slots] = at
    return slots[stamp[slots] == at]


def fit(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Slot weights and bias: logistic regression on binary features times r / sqrt(number of features), r the log-count ratio.

    rows (distinct slots of each text, 32 bits each) is emptied: only slots whose feature counts are kept.
    """
    n = len(rows)
    if not n or toxic.all() or not toxic.any():
        rate = (toxic.sum() + 0.5) / (n + 1)
        return np.zeros(SLOTS, np.float32), float(np.log(rate / (1 - rate)))
    pos, both = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
    for slots, bad in zip(rows, toxic):
        both[slots] += 1
        if bad:
            pos[slots] += 1
    p, q = (pos + 1) / (toxic.sum() + 2), (both - pos + 1) / ((~toxic).sum() + 2)
    ratio = np.log(p / q)
    use = (both >= SEEN) & (np.abs(ratio) >= RATIO)
    place = (np.cumsum(use) - 1).astype(np.int32)
    sizes, cols = np.array([len(x) for x in rows]), []
    for slots in rows[::-1]:
        rows.pop()
        cols.append(place[slots[use[slots]]])
    cols.reverse()
    own, col, r = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in cols]), np.concatenate(cols), ratio[use]
    del cols, place, pos, p, q, both
    val = (r[col] / np.sqrt(np.maximum(1, sizes))[own]).astype(np.float32)
    y = toxic.astype(np.float64)
    w, bias = np.zeros(len(r)), float(np.log(y.mean() / (1 - y.mean())))
    # full-batch steps, each coordinate scaled by its gradients' running size
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, STEPS + 1):
        g = 1 / (1 + np.exp(-(np.bincount(own, val * w[col], minlength=n) + bias))) - y
        grad = np.append(np.bincount(col, val * g[own], minlength=len(r)) / n + DECAY * w, g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    out = np.zeros(SLOTS, np.float32)
    out[use] = w * r
    return out, float(bias)


def fold(doc_id: Column) -> Column:
    """Remainder that keeps a row's label out of training where it is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most fit_rows labelled documents outside the held-out fold; null labels and ids teach nothing."""
    # fit_rows rows at most, so that side's size is bounded
    known = labels.select("doc_id", "toxic").dropna().filter(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stamp = np.zeros(SLOTS, np.int32)
        for rows, data, offs in chunks(batches, "text"):
            got = [features(data[a:b], stamp).astype(np.int32).tobytes() for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("toxic")), rows.column(rows.schema.get_field_index("doc_id")), pa.array(got, pa.binary())], names=["toxic", "doc_id", "slots"])

    small_batches(docs.sparkSession)
    # one text of each id, however often it is repeated: at most fit_rows rows reach the driver
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    wanted = texts.mapInArrow(work, f"toxic {known.schema['toxic'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, slots binary")
    got = sorted(((r["doc_id"], bytes(r["slots"]), r["toxic"]) for r in wanted.toLocalIterator()), key=lambda x: x[0])
    toxic, rows = np.array([bool(t) for *_, t in got], bool), [np.frombuffer(s, np.int32) for _, s, _ in got]
    del got
    return fit(rows, toxic)


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """All columns of docs and `__toxicity`, the probability that a row's whole text is toxic."""
    weights, bias = train(docs, labels, fit_rows)
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes for each of SLOTS, whatever the input
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, stamp = model.value, np.zeros(SLOTS, np.int32)
        for rows, data, offs in chunks(batches, "text"):
            out = np.empty(len(offs) - 1)
            for i, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
                f = features(data[a:b], stamp)
                out[i] = 1 / (1 + np.exp(-(np.sort(w[f]).sum(dtype=np.float64) / np.sqrt(max(1, len(f))) + bias)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], names=[*names, "__toxicity"])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField("__toxicity", DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text), from whole texts.

    Null and empty texts have no n-gram but the blanks and get the score of that; rows with equal text get equal scores;
    without usable labels all scores follow the smoothed rate. A null doc_id is not held out. An empty table gives no rows.
    """
    out = scored(docs.select("doc_id", "text"), labels, fit_rows)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that score() does not call toxic; repeated rows fare alike. Other columns may have any name."""
    plain = plainly(docs, "doc_id", "text")
    return scored(plain, labels).filter(F.col("__toxicity") < THRESHOLD).select(*plain.columns).toDF(*docs.columns)
