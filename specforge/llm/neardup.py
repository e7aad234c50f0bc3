"""Near-duplicate documents by bottom-k sketches under one hash function, without losing a link.

A document's sketch is the bottom k of its shingles' hashes, with k = n - ceil(t n) + 1 for n shingles and threshold t:
two sets of Jaccard similarity t or more must share a value of their sketches, so inverted lists of the retained values
meet every link. Values held by many documents are ordered last, the commonest after all others (any fixed order keeps
that guarantee), which keeps common passages out of the sketches of documents that have enough of their own. Where two
sketches first meet, the values that either set has from there on bound what both can share. Of the pairs left, a second,
short bottom-k sketch under the hash order alone estimates the similarity (the share of the union's bottom k that both
have), and full sets verify it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, bitmap, chunks, drop, free_shuffles, materialize, plainly, small_batches, utf8
from .components import components
from .textkernel import PLACE, mix, shingle_sets

SHINGLE = 5
#: Least similarity in percent.
SIMILAR = 85
#: A value counts as common from LOCAL documents of one task and COMMON of all on; at most MOST_COMMON are told to all
#: tasks (8 bytes each). This only orders values: results do not depend on it.
LOCAL, COMMON, MOST_COMMON = 2, 6, 2_000_000
#: Bits of a set's signature: the parity of how many of its hashes fall to each bit. Signatures differ in at most as many
#: bits as the sets differ in shingles, so a pair whose signatures differ in more than a link allows is none.
SIGNATURE = 256
#: Values of a set's bottom-k sketch under the plain hash order, of which the estimate of a pair's similarity is made, in 32 bits each,
#: and how far below the least similarity an estimate may be: over 8 standard deviations for sets of more values, while
#: smaller sets are their own sketches and compared exactly.
LOWEST, SLACK = 128, 0.3
#: Pairs that a task holds before it drops repeated ones and passes them on.
PAIRS_HELD = 2_000_000


def least_shared(n: np.ndarray, m: np.ndarray, similar: int) -> np.ndarray:
    """The fewest shared shingles of sets of n and m for 100 * shared >= similar * union."""
    return -(-similar * (n + m) // (100 + similar))


def shareable(n: np.ndarray, at: np.ndarray, m: np.ndarray, place: np.ndarray, similar: int) -> np.ndarray:
    """Whether sets of n and m whose first shared value has these 0-based places in their orders can be similar."""
    return np.minimum(n - at, m - place) >= least_shared(n, m, similar)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common values in order, and for each the whole part of log2 of how many documents have it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(v[c >= LOCAL].view(np.int64)), pa.array(c[c >= LOCAL].astype(np.int64))], names=["value", "n"])

        for _, data, offs in chunks(batches, "text"):
            for s in shingle_sets(data, offs, SHINGLE):
                if len(s) and (key := (len(s), int(s.sum()))) not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if size > 4_000_000:
                yield flush()
                held, size, seen = [], 0, set()
        yield flush()

    counts = docs.select("text").mapInArrow(work, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "value").limit(MOST_COMMON).select("value", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()
    values = rows["value"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], rows["level"].to_numpy().astype(np.int8)[order]


def signature(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) % SIGNATURE, minlength=SIGNATURE) & 1).astype(np.uint8)).tobytes()


def most_different(n: np.ndarray, m: np.ndarray, similar: int) -> np.ndarray:
    """The most shingles in which linked sets of n and m can differ: n + m less twice the fewest shared."""
    return n + m - 2 * least_shared(n, m, similar)


def lowest(s: np.ndarray) -> bytes:
    """The bottom-k sketch of a sorted set of hashes, by their upper halves, which keep the order."""
    return (s[:LOWEST] >> np.uint64(32)).astype(np.uint32).tobytes()


def estimates(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, m: np.ndarray, similar: int) -> np.ndarray:
    """Whether pairs may be similar by their sketches: the share of the union's bottom k that both have, k the shorter sketch's length."""
    width = 2 * LOWEST
    both = np.full((len(a), width), np.iinfo(np.uint64).max, np.uint64)
    for i, (x, y) in enumerate(zip(a, b)):
        both[i, : len(x)] = x
        both[i, LOWEST : LOWEST + len(y)] = y
    both.sort(axis=1)
    known = both != np.iinfo(np.uint64).max
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & known[:, 1:]  # a value that both sketches have stands there twice
    rank = np.cumsum(known & ~again, axis=1)
    k = np.minimum(np.array([len(x) for x in a]), np.array([len(y) for y in b]))
    whole = (n <= LOWEST) & (m <= LOWEST)
    shared = again.sum(1)
    among = (again & (rank <= k[:, None])).sum(1)
    return np.where(whole, 100 * shared >= similar * (n + m - shared), among >= (similar / 100 - SLACK) * k)


def _signatures(column: pa.Array) -> np.ndarray:
    data, _ = utf8(column)
    return data.reshape(len(column), SIGNATURE // 8).view(np.uint64)


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _levels(values: np.ndarray, table: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The level of each value in the table, 0 for others."""
    if not len(table):
        return np.zeros(len(values), np.int8)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, levels[at], 0).astype(np.int8)


def _sketches(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], similar: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), its signature and the sketch, or null for a row without doc_id and where this task has met the same set before in a row with one."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most MOST_COMMON values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, levels), seen = shared.value, set()
        for rows, data, offs in chunks(batches, "text"):
            n, d1, d2, sketch, sign, low = [], [], [], [], [], []
            nameless = rows.column(0).is_null().to_pylist()
            for s, null in zip(shingle_sets(data, offs, SHINGLE), nameless):
                n.append(len(s))
                key = (int(s.sum() & np.uint64((1 << 63) - 1)), int(mix(s ^ PLACE[60]).sum() & np.uint64((1 << 63) - 1))) if len(s) else (0, 0)
                d1.append(key[0])
                d2.append(key[1])
                sign.append(signature(s))
                low.append(lowest(s))
                if not len(s) or null or key in seen:
                    sketch.append(None)
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
                k = len(s) - -(-similar * len(s) // 100) + 1
                sketch.append(s[np.argsort(_levels(s, table, levels), kind="stable")[:k]].view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(sign, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "n", "d1", "d2", "sketch", "sign", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n long, d1 long, d2 long, sketch array<long>, sign binary, low binary")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Numpy columns of sorted batches, cut so that no run of equal keys is split."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        cols = {k: _signatures(b.column(i)) if k == "sign" else b.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(b.schema.names)}
        v = cols[key]
        if not len(v):
            continue
        if v[0] != v[-1] or held and held[-1][key][-1] != v[0]:
            cut = int(np.searchsorted(v, v[-1], "left"))
            out = [*held, {k: c[:cut] for k, c in cols.items()}]
            yield {k: np.concatenate([h[k] for h in out]) for k in cols}
            held = [{k: c[cut:] for k, c in cols.items()}]
        else:
            held.append(cols)
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


#: Pivots of a list besides its first document: those first in so many hash orders, the same in every list.
PIVOTS = 4
#: Size and place in one long: n << PLACES | place.
PLACES = 31


def _lists(sketches: DataFrame, similar: int) -> DataFrame:
    """value, doc_id, size (see PLACES), pivots and whole for each value that several documents retain.

    pivots: the first document of the list, in the order of n and doc_id, that is large enough to be similar, and
    PIVOTS others; the document itself where their places leave too little to share. whole: the list has pairs besides those with
    pivots; lists of two have none, and only their pair is returned, if it can be similar.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(batches, "value"):
            v, d, n, at = c["value"], c["doc_id"], c["size"] >> PLACES, c["size"] & ((1 << PLACES) - 1)
            if not len(v):
                continue
            run = np.cumsum(np.concatenate([[True], v[1:] != v[:-1]])) - 1
            many = np.bincount(run)[run] > 1
            v, d, n, at, run = v[many], d[many], n[many], at[many], run[many]
            if not len(v):
                continue
            order = np.lexsort((d, n, run))
            v, d, n, at, run = v[order], d[order], n[order], at[order], run[order]
            # rows are sorted by run and n: the first of the same run with 100 n >= similar * own n
            width = int(n.max()) + 2
            first = np.searchsorted(run * width + n, run * width + -(-similar * n // 100), "left")
            heads = [first]
            for k in range(PIVOTS):
                ranked = np.lexsort((mix(d.view(np.uint64) ^ PLACE[50 + k]), run))
                heads.append(ranked[np.searchsorted(run, run)])
            pivots = np.stack([np.where(shareable(n, at, n[i], at[i], similar), d[i], d) for i in heads], axis=1)
            whole = np.bincount(run)[run] > 2
            keep = whole | (pivots[:, 0] != d)
            lists_of = pa.ListArray.from_arrays(np.arange(0, keep.sum() * pivots.shape[1] + 1, pivots.shape[1], dtype=np.int32), pivots[keep].ravel())
            yield pa.RecordBatch.from_arrays([*[pa.array(x[keep]) for x in (v, d, n << PLACES | at, whole)], lists_of], names=["value", "doc_id", "size", "whole", "pivots"])

    rows = sketches.filter(F.col("sketch").isNotNull()).select("doc_id", "n", F.posexplode("sketch").alias("at", "value"))
    rows = rows.select("value", "doc_id", F.shiftleft("n", PLACES).bitwiseOR(F.col("at").cast("long")).alias("size"))
    return rows.repartition("value").sortWithinPartitions("value").mapInArrow(work, "value long, doc_id long, size long, whole boolean, pivots array<long>")


def _distinct(found: list[np.ndarray]) -> pa.RecordBatch:
    """Each distinct pair of the 2-row arrays once."""
    pairs = np.concatenate(found, axis=1)
    ids, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(pairs.shape).astype(np.int64)
    keys = np.unique(place[0] * len(ids) + place[1])
    return pa.RecordBatch.from_arrays([pa.array(ids[keys // len(ids)]), pa.array(ids[keys % len(ids)])], names=["a", "b"])


def _sorted(lists: DataFrame) -> DataFrame:
    return lists.repartition("value").sortWithinPartitions("value", "size", "doc_id")


def _mixed(lists: DataFrame) -> DataFrame:
    """The rows of lists whose documents are of several components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(batches, "value"):
            if not len(c["value"]):
                continue
            first = np.flatnonzero(np.concatenate([[True], c["value"][1:] != c["value"][:-1]]))
            several = np.minimum.reduceat(c["component"], first) != np.maximum.reduceat(c["component"], first)
            keep = np.flatnonzero(np.repeat(several, np.diff(np.concatenate([first, [len(c["value"])]]))))
            sign = pa.array([x.tobytes() for x in c["sign"][keep]], pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.array(c[k][keep]) for k in ("value", "doc_id", "size")], sign], names=["value", "doc_id", "size", "sign"])

    return _sorted(lists).mapInArrow(work, "value long, doc_id long, size long, sign binary")


#: Neighbours in a list, in the order of size, of which a document is paired with the one of another component that looks most alike;
#: and at most how often, before what is still apart is compared in full.
NEIGHBOURS, ROUNDS = 64, 2


def _nearest(lists: DataFrame, similar: int) -> DataFrame:
    """At most a pair for each document and list: that with the nearest signature among its neighbours of other components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(batches, "value"):
            v, d, comp, sign, n, at = c["value"], c["doc_id"], c["component"], c["sign"], c["size"] >> PLACES, c["size"] & ((1 << PLACES) - 1)
            best, partner = np.full(len(v), SIGNATURE + 1), np.full(len(v), -1)
            for step in range(1, min(NEIGHBOURS, len(v) - 1) + 1):
                i = np.flatnonzero((v[:-step] == v[step:]) & (comp[:-step] != comp[step:]) & (100 * n[:-step] >= similar * n[step:]))
                if not len(i):
                    continue
                i = i[shareable(n[i], at[i], n[i + step], at[i + step], similar)]
                far = np.bitwise_count(sign[i] ^ sign[i + step]).sum(1).astype(np.int64)
                may = far <= most_different(n[i], n[i + step], similar)
                i, far = i[may], far[may]
                for a, b in ((i, i + step), (i + step, i)):
                    less = far < best[a]
                    best[a[less]], partner[a[less]] = far[less], b[less]
            one = np.flatnonzero(partner >= 0)
            if len(one):
                yield _distinct([np.stack([np.minimum(d[one], d[partner[one]]), np.maximum(d[one], d[partner[one]])])])

    return _sorted(lists).mapInArrow(work, "a long, b long").distinct()


def _rest(lists: DataFrame, similar: int) -> DataFrame:
    """Distinct pairs a < b of documents in one list and different components, whose sizes, places there and signatures allow a link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for c in _runs(batches, "value"):
            v, d, comp, sign, n, at = c["value"], c["doc_id"], c["component"], c["sign"], c["size"] >> PLACES, c["size"] & ((1 << PLACES) - 1)
            edges = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]])
            for s, e in zip(edges[:-1], edges[1:]):
                if e - s < 2 or (comp[s:e] == comp[s]).all():
                    continue
                last = np.searchsorted(n[s:e], n[s:e] * 100 // similar, "right")
                for i in range(s, e - 1):  # rows are sorted by n
                    j = np.arange(i + 1, s + last[i - s])
                    j = j[comp[j] != comp[i]]
                    j = j[shareable(n[i], at[i], n[j], at[j], similar)]
                    j = j[np.bitwise_count(sign[j] ^ sign[i]).sum(1) <= most_different(n[i], n[j], similar)]
                    if len(j):
                        found.append(np.stack([np.minimum(d[i], d[j]), np.maximum(d[i], d[j])]))
                        held += len(j)
                    if held > PAIRS_HELD:
                        yield _distinct(found)
                        found, held = [], 0
        if found:
            yield _distinct(found)

    return _sorted(lists).mapInArrow(work, "a long, b long").distinct()


def _possible(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The distinct pairs (a, b, k) whose signatures allow a link and whose union sketches make one likely enough."""
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sign").alias(f"sign_{k}"), F.col("low").alias(f"low_{k}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            n, m = (r.column(k).to_numpy() for k in (3, 4))
            ok = np.bitwise_count(_signatures(r.column(5)) ^ _signatures(r.column(6))).sum(1) <= most_different(n, m, similar)
            at = np.flatnonzero(ok)
            x, y = ([np.frombuffer(v.as_buffer(), np.uint32) for v in r.column(c).take(pa.array(at))] for c in (7, 8))
            ok[at] = estimates(x, y, n[at], m[at], similar)
            yield r.select(["a", "b", "k"]).filter(pa.array(ok))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "k", "n_a", "n_b", "sign_a", "sign_b", "low_a", "low_b")
    return both.mapInArrow(work, "a long, b long, k long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar; texts: doc_id, text of all their documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (0, 1))
            both = [utf8(batch.column(k)) for k in (2, 3)]
            ok = np.zeros(len(a), bool)
            for i in range(len(a)):
                sets = []
                for ids, (data, offs) in zip((a, b), both):
                    key = int(ids[i])
                    if key not in known:
                        if len(known) > 500:
                            known.clear()
                        known[key] = shingle_sets(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]), SHINGLE)[0]
                    sets.append(known[key])
                x, y = sets
                shared = int(_isin(x, y).sum()) if len(x) <= len(y) else int(_isin(y, x).sum())
                ok[i] = 100 * shared >= similar * (len(x) + len(y) - shared) and shared > 0
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long").distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, and few others, without a shuffle of texts."""
    return among(docs, "doc_id", bitmap(ids.select("doc_id")))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components so far."""
    side = lambda k: label.select(F.col("id").alias(k), F.col("component").alias(f"c_{k}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.filter(~F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))).select("a", "b")


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Links join documents with 100 * shared >= similar * union of their distinct 5-word shingles (A-Z lower-cased); a
    text of fewer words is one shingle; a null text or one without words has none and no links. component_id is the
    smallest doc_id reachable. Rows that share a doc_id count as linked; a row without doc_id has no links, a null component and
    is kept. Equal sets are joined first and stand for one another; every list's members are checked against
    its pivots on full sets; then all pairs of a list that are still apart are checked, except where their places
    in it or their signatures prove them dissimilar. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(_sketches(docs, _common(docs), similar), "sketches")
    sets = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    # equal sets: for each digest one document that has its sketch
    equal = sets.groupBy("d1", "d2", "n").agg(F.min(F.when(F.col("sketch").isNotNull(), F.col("doc_id"))).alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    same = sets.select("doc_id", "d1", "d2", "n").join(equal, ["d1", "d2", "n"]).select(F.col("doc_id").alias("a"), F.col("least").alias("b")).filter("a <> b")
    same = materialize(same, "same-sets")
    lists = materialize(_lists(sets, similar), "lists")
    known = same.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    signs = sets.select("doc_id", "n", "sign", "low")
    ordered = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    pivots = lists.select("doc_id", F.explode(F.array_distinct("pivots")).alias("pivot")).filter("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count(F.lit(1)).alias("k"))
    star = materialize(_possible(pivots.select(*ordered("doc_id", "pivot"), "k").groupBy("a", "b").agg(F.max("k").alias("k")).join(known, ["a", "b"], "left_anti"), signs, similar), "star-pairs")
    ids = star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct()
    texts = materialize(_texts(docs, ids), "texts")
    # the pivot of the most lists first: most others then are in one component already
    first = materialize(star.groupBy("a").agg(F.max_by("b", F.struct("k", -F.col("b"))).alias("b")), "first-pairs")
    linked = materialize(_verified(first, texts, similar).union(known), "first-links")
    label = materialize(components(linked), "labels")
    later = _apart(star.select("a", "b").join(first, ["a", "b"], "left_anti"), label)
    linked = materialize(_verified(later, texts, similar).union(linked), "star-links")
    drop(texts, first)
    label = materialize(components(linked), "labels")
    # a copy's lists hold the document that stands for it, in the same component
    placed = label.join(same.select(F.col("a").alias("id"), F.lit(True).alias("copy")).distinct(), "id", "left")
    named = lists.filter("whole").join(signs.select("doc_id", "sign"), "doc_id").join(placed, F.col("doc_id") == placed["id"], "left").filter("copy IS NULL").select("value", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"), "sign")
    tested = star.select(F.col("b").alias("a"), F.col("a").alias("b"))
    mixed = materialize(_mixed(named), "mixed")
    drop(lists)
    placed = lambda: mixed.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("value", "doc_id", "size", F.coalesce("component", "doc_id").alias("component"), "sign")
    # what is still apart: first each document with the one most like it, until that joins nothing; then all
    turn = 0 if not mixed.isEmpty() else ROUNDS + 1
    while turn <= ROUNDS:
        rest = (_rest if turn == ROUNDS else _nearest)(placed(), similar).join(tested, ["a", "b"], "left_anti")
        pairs = materialize(_possible(rest.withColumn("k", F.lit(1).cast("long")), signs, similar).select("a", "b"), "rest-pairs")
        more = None
        if not pairs.isEmpty():
            texts = materialize(_texts(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()), "texts")
            more = materialize(_verified(pairs, texts, similar), "rest-links")
            drop(texts)
            tested = tested.union(pairs)
            if not more.isEmpty():
                linked = linked.union(more)
                label = materialize(components(linked), "labels")
        turn = turn + 1 if turn == ROUNDS or more is not None and not more.isEmpty() else ROUNDS
    final = label
    free_shuffles(spark)
    out = sketches.join(final, sketches["doc_id"] == final["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))



def representatives(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One row of docs, with all its columns, for each component of near_duplicates(); rows without doc_id all stay.

    Of rows that share a doc_id any one stays. Other columns may have any name; an empty table gives no rows.
    """
    plain = plainly(docs, "doc_id", "text")
    kept = near_duplicates(plain, similar).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    named = plain.filter("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(plain.filter("doc_id IS NULL")).toDF(*docs.columns)


_W = r"'[^\x20\x09-\x0D]+'"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_W}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(w) AS h FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS w FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT *, count(*) OVER (PARTITION BY h) AS f FROM s),
p AS (SELECT doc_id, h FROM (SELECT r.doc_id, r.h, n.n, row_number() OVER (PARTITION BY r.doc_id ORDER BY f, h) AS i FROM r JOIN n USING (doc_id)) WHERE i <= n - CAST(ceil({SIMILAR} * n / 100.0) AS BIGINT) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.h = y.h AND x.doc_id < y.doc_id),
o AS (SELECT a, b, count(*) AS shared FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.h = x.h GROUP BY a, b),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {SIMILAR} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.id),
m AS (SELECT id, min(root) AS component_id FROM t GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
