"""Removal of strings that occur elsewhere, by merging the Burrows-Wheeler transforms of shards.

A Window says how long a string is, in units: bytes, or words (by their hashes, whatever blanks are between them).
Only places that can begin a repeated string are looked at. Every string of a window's length has an anchor, the leftmost least
hash among its grams; equal strings have equal anchors at equal distances, so a string can occur twice only
if its anchor does. The starts that share an anchor occurrence form a segment; segments with the same anchor meet in
one task, equal segments once, with their number.

There each shard of segments has its transform: the order of its suffixes that begin at anchors, their common prefixes, and,
class by class to the left, the unit before each. interleave() merges the shards without sorting suffixes again: places start in the order of
group and shard, each round buckets them stably by one more unit, a block splits where units differ, and the round
in which it splits is the common prefix of its parts. A block whose places come from one shard is settled: order and
common prefixes are that shard's. repeats() then goes back from the anchors, unit by unit, as transforms do: the order of the
suffixes one unit further left is that of the present ones, bucketed by the unit before them; common prefixes of new neighbours are the
least between them. Blocks of one place, and places that cannot reach the window's length any more, are settled. A block of two or more
whose common prefix reaches the window's length is a repeated interval.

An anchor with more than HOT different segments is not gathered: its strings are told apart by
hashes of their own, first among those of one task, and only where what neighbouring strings have in common occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SLOTS, among, bitmap, chunks, drop, fresh, materialize, plainly, small_batches, utf8
from .textkernel import PLACE, mix, powers, prefix_hash, span_hash, word_spans


class Window(NamedTuple):
    """Units of a string that counts and of an anchor's gram; words: a unit is a word, else a byte."""

    length: int
    gram: int
    words: bool = False


#: Of query op2; of passages of over 50 words.
BYTES, WORDS = Window(400, 64), Window(51, 12, True)
SHARDS = 4
#: Bytes of segments that a task merges at once, in whole groups of one anchor each.
GROUP_BYTES = 4 << 20
#: Most different segments of an anchor that meet in one task, some 750 bytes each.
HOT = 1000
#: Starts of a hot segment that are judged together first, by what their strings have in common.
SLICE = 16
_PLACE = np.uint64((1 << 31) - 1)


def units_of(data: np.ndarray, offs: np.ndarray, window: Window) -> tuple[np.ndarray, np.ndarray]:
    """The units of all texts, bytes or hashes of words, and the n + 1 offsets of the texts in them."""
    if not window.words:
        return data, offs
    starts, ends, doc = word_spans(data, offs)
    return span_hash(prefix_hash(data), starts, ends), np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offs) - 1))])


def unit_prefix(units: np.ndarray) -> np.ndarray:
    """prefix_hash() of bytes or of words."""
    if units.dtype == np.uint8:
        return prefix_hash(units)
    c = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(len(units))[0][: len(units)], out=c[1:])
    return c


def gram_hashes(c: np.ndarray, size: int) -> np.ndarray:
    _, down = powers(len(c))
    n = max(0, len(c) - size)
    return mix((c[size:] - c[:-size]) * down[:n]) if n else np.zeros(0, np.uint64)


def anchors(data: np.ndarray, offs: np.ndarray, window: Window = BYTES) -> tuple[np.ndarray, ...]:
    """document number, anchor hash, segment hash, first start (within the document), number of starts and anchor's distance behind the first start of each segment."""
    c = unit_prefix(data)
    h = gram_hashes(c, window.gram)
    w = window.length - window.gram + 1
    length = np.diff(offs)
    docs = np.flatnonzero(length >= window.length)
    if not len(docs):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), np.zeros(0, np.uint64), z, z, z
    key = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    before = np.minimum.accumulate(key.reshape(-1, w), axis=1).reshape(-1)
    behind = np.minimum.accumulate(key.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n_starts = length[docs] - window.length + 1
    ends = np.cumsum(n_starts)
    starts = np.arange(ends[-1]) + np.repeat(offs[docs] - (ends - n_starts), n_starts)
    least = (np.minimum(behind[starts], before[starts + w - 1]) & _PLACE).astype(np.int64)
    owner = np.repeat(docs, n_starts)
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.concatenate([first, [len(starts)]]))
    at, doc = starts[first], owner[first]
    return doc, h[least[first]], span_hash(c, at, at + count + window.length - 1), at - offs[doc], count, least[first] - at


class Segments(NamedTuple):
    """Segments of whole groups: their units and n + 1 offsets, the group of each, the place of its anchor in the units."""

    units: np.ndarray
    offs: np.ndarray
    group: np.ndarray
    anchor: np.ndarray


def interleave(s: Segments, shards: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments of all shards in the order of group and suffix from the anchor on, and each one's common prefix with the one before, up to `most`; -1 before a group.

    A shard is such an order with its common prefixes.
    """
    order, own = (np.concatenate([x[k] for x in shards]) for k in (0, 1))
    shard = np.repeat(np.arange(len(shards)), [len(x[0]) for x in shards])
    by = np.argsort(s.group[order], kind="stable")
    order, own, shard = order[by], own[by], shard[by]
    group = s.group[order]
    b = np.concatenate([[True], group[1:] != group[:-1]])
    prefix = np.full(len(order), -1)
    p = np.arange(len(order))  # places in unsettled blocks; b: those that begin one
    new = True
    for r in range(most):
        if new:
            first = np.flatnonzero(b)
            one = np.minimum.reduceat(shard[p], first) == np.maximum.reduceat(shard[p], first)
            done = np.repeat(one, np.diff(np.concatenate([first, [len(p)]])))
            known = p[done & ~b]
            prefix[known] = own[known]
            p, b = p[~done], b[~done]
            if not len(p):
                return order, prefix
        at = s.anchor[order[p]] + r
        ended = at >= s.offs[order[p] + 1]
        unit = s.units[np.where(ended, 0, at)]
        differ = np.concatenate([[True], (unit[1:] != unit[:-1]) | ended[1:] | ended[:-1]])
        new = bool((differ & ~b).any())
        if not new:
            continue
        block = np.cumsum(b) - 1
        split = np.zeros(block[-1] + 1, bool)
        split[block[differ & ~b]] = True
        q = np.flatnonzero(split[block])
        to = q[np.lexsort((unit[q], ~ended[q], block[q]))]
        for x in (order, own, shard):
            x[p[q]] = x[p[to]]
        unit[q], ended[q] = unit[to], ended[to]
        differ = np.concatenate([[True], (unit[1:] != unit[:-1]) | ended[1:] | ended[:-1]]) | b
        prefix[p[differ & ~b]] = r
        b = differ
    prefix[p[~b]] = most
    return order, prefix


def transform(s: Segments, which: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """One shard's order and common prefixes, from its segments alone."""
    return interleave(s, [(which[i : i + 1], np.full(1, -1)) for i in range(len(which))], most) if len(which) else (which, which)


def _between(prefix: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The common prefixes of the kept places with the kept ones before them."""
    at = np.flatnonzero(keep)
    return np.minimum.reduceat(prefix[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) if len(at) else prefix[:0]


def repeats(s: Segments, digest: np.ndarray, window: Window) -> np.ndarray:
    """For each start of each segment, in order, whether another segment of its group has the same string of the window's length; digest deals segments to shards."""
    length, rel = window.length, s.anchor - s.offs[:-1]
    begin = np.concatenate([[0], np.cumsum(np.diff(s.offs) - length + 1)])
    out = np.zeros(begin[-1], bool)
    shards = [transform(s, np.flatnonzero(digest % np.uint64(SHARDS) == k), length) for k in range(SHARDS)]
    order, prefix = interleave(s, [x for x in shards if len(x[0])], length)
    t, new = 0, True
    while True:
        if new:
            best = np.maximum(prefix, np.concatenate([prefix[1:], [-1]]))
            live = (best >= 0) & (best + rel[order] >= length)
            while not live.all():
                prefix, order = _between(prefix, live), order[live]
                best = np.maximum(prefix, np.concatenate([prefix[1:], [-1]]))
                live = (best >= 0) & (best + rel[order] >= length)
            at, place = s.anchor[order], begin[order] + rel[order]
        if not len(order):
            return out
        out[place[best >= length - t] - t] = True
        t += 1
        if (ended := rel[order] < t).any():
            prefix, order = _between(prefix, ~ended), order[~ended]
            at, place, new = s.anchor[order], begin[order] + rel[order], True
            if not len(order):
                return out
        else:
            new = False
        unit = s.units[at - t]
        differ = np.concatenate([[False], (unit[1:] != unit[:-1]) & (prefix[1:] >= 0)])
        if not differ.any():
            if new:
                best = np.maximum(prefix, np.concatenate([prefix[1:], [-1]]))
            continue
        new = True
        block = np.cumsum(prefix < 0) - 1
        split = np.zeros(block[-1] + 1, bool)
        split[block[differ]] = True
        q = np.flatnonzero(split[block])
        to = q[np.lexsort((unit[q], block[q]))]
        same = np.flatnonzero((unit[to[1:]] == unit[to[:-1]]) & (block[to[1:]] == block[to[:-1]]))
        of = np.full(len(to), -1)
        if len(same):
            ranges = np.stack([to[same] + 1, to[same + 1] + 1], axis=1).ravel()
            of[same + 1] = np.minimum.reduceat(np.append(prefix, -1), ranges)[::2]
        order[q] = order[to]
        prefix[q] = of


def _ranges(rows: Iterator[tuple[np.ndarray, ...]], windows: Sequence[Window]) -> Iterator[pa.RecordBatch]:
    """hash, sd and the runs of repeated starts (lo, hi), relative to the segment, from segments sorted by hash."""
    for key, which, sd, weight, rel, data, offs in rows:
        for w in np.unique(which):
            window, at = windows[w], np.flatnonzero(which == w)
            units, ends = data, np.concatenate([[0], np.cumsum(np.diff(offs)[at])])
            if len(at) < len(which):
                units = data[np.repeat(which == w, np.diff(offs))]
            if window.words:
                units, ends = units.view(np.uint64), ends // 8
            _, group = np.unique(key[at], return_inverse=True)
            flags = repeats(Segments(units, ends, group, ends[:-1] + rel[at]), sd[at].view(np.uint64), window)
            counts = np.diff(ends) - window.length + 1
            owner = np.repeat(np.arange(len(at)), counts)
            flags |= (weight[at] > 1)[owner]
            inside = np.arange(len(flags)) - np.repeat(np.cumsum(counts) - counts, counts)
            edge = np.flatnonzero(flags & ~np.concatenate([[False], flags[:-1] & (owner[1:] == owner[:-1])]))
            last = np.flatnonzero(flags & ~np.concatenate([flags[1:] & (owner[1:] == owner[:-1]), [False]]))
            o = at[owner[edge]]
            yield pa.RecordBatch.from_arrays([pa.array(key[o]), pa.array(sd[o]), pa.array(inside[edge]), pa.array(inside[last])], names=["hash", "sd", "lo", "hi"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of whole hashes, about GROUP_BYTES at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        cols = [np.concatenate([h[i] for h in held]) for i in range(6)]
        offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[6]) for h in held]))])
        return *cols, offs

    for b in batches:
        cols = tuple(b.column(i).to_numpy() for i in range(5))
        data, offs = utf8(b.column(5))
        if not b.num_rows:
            continue
        held.append((*cols, data, offs))
        size += len(data)
        if size >= GROUP_BYTES:
            *c, d, o = joined()
            cut = int(np.searchsorted(c[0], c[0][-1], "left"))
            if cut:
                yield *(x[:cut] for x in c), d[: o[cut]], o[: cut + 1]
            held = [(*(x[cut:] for x in c), d[o[cut] :].copy(), o[cut:] - o[cut])]
            size = len(held[0][5]) if cut else 0
    if held:
        yield joined()


class _Hot(NamedTuple):
    """Segments of hot anchors, of one window: their rows, units and n + 1 offsets; start of each string and its segment."""

    cols: dict[str, np.ndarray]
    units: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, batches: Iterator[pa.RecordBatch], windows: Sequence[Window]) -> Iterator[tuple[_Hot, Window]]:
        for b in batches:
            for w, window in enumerate(windows):
                own = b.filter(pa.array(b.column(1).to_numpy() == w))
                if own.num_rows:
                    data, offs = utf8(own.column(5))
                    units, offs = (data.view(np.uint64), offs // 8) if window.words else (data, offs)
                    n = np.diff(offs) - window.length + 1
                    owner = np.repeat(np.arange(len(n)), n)
                    yield cls({k: own.column(i).to_numpy() for i, k in enumerate(_SENT) if k != "seg"}, units, offs, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + offs[owner], owner), window

    def hashes(self, window: Window) -> tuple[np.ndarray, np.ndarray]:
        """Of each string a hash, and one of what the strings of its slice, SLICE distances from the anchor, have in common."""
        c, key = unit_prefix(self.units), self.cols["hash"][self.owner].view(np.uint64)
        anchor = (self.offs[:-1] + self.cols["rel"])[self.owner]
        slot = (anchor - self.start) // SLICE
        core = anchor - slot * SLICE
        return span_hash(c, self.start, self.start + window.length) ^ key, mix(span_hash(c, core, core + window.length - SLICE + 1) + slot.astype(np.uint64) * PLACE[20]) ^ key


def _cores(windows: Sequence[Window]):
    """core, n: how many segments have it here, or by weight."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hot, window in _Hot.of(batches, windows):
            _, core = hot.hashes(window)
            new = np.concatenate([[True], (core[1:] != core[:-1]) | (hot.owner[1:] != hot.owner[:-1])])
            kinds, kind = np.unique(core[new], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(kind, weights=hot.cols["weight"][hot.owner[new]]).astype(np.int64))], names=["core", "n"])

    return work


def _strings(windows: Sequence[Window], bits: np.ndarray):
    """string, weight, hash, sd, lo, hi of the strings of hot segments whose core may occur twice.

    Weight 1: a string that occurs once here. A string that occurs more often here has one row of weight 2, which tells others, and its starts are in runs of weight 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hot, window in _Hot.of(batches, windows):
            string, core = hot.hashes(window)
            slot = core & np.uint64(SLOTS - 1)
            may = np.flatnonzero((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
            string, owner, inside = string[may], hot.owner[may], (hot.start - hot.offs[hot.owner])[may]
            kinds, kind = np.unique(string, return_inverse=True)
            more = np.bincount(kind, weights=hot.cols["weight"][owner], minlength=len(kinds)) > 1
            here = more[kind]
            one, many = np.flatnonzero(~here), np.flatnonzero(here)
            apart = (inside[many][1:] != inside[many][:-1] + 1) | (owner[many][1:] != owner[many][:-1])
            first, last = (many[np.concatenate(x)] if len(many) else many for x in (([True], apart), (apart, [True])))
            of, tell = np.concatenate([owner[one], owner[first]]), kinds[more]
            none = np.zeros(len(tell), np.int64)
            rows = [np.concatenate([string[one], np.zeros(len(first), np.uint64), tell]).view(np.int64), np.repeat([1, 0, 2], [len(one), len(first), len(tell)])]
            rows += [np.concatenate([hot.cols[k][of], none]) for k in ("hash", "sd")] + [np.concatenate([inside[one], inside[x], none]) for x in (first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["string", "weight", "hash", "sd", "lo", "hi"])

    return work


def _of_hot(segments: DataFrame, windows: Sequence[Window]) -> tuple[DataFrame, DataFrame]:
    """hash, sd, lo, hi of the segments (materialized) of hot anchors, and a written table that they are read from; strings are counted only where what a slice has in common occurs twice."""
    spark = segments.sparkSession
    slot = F.col("core").bitwiseAND(F.lit(SLOTS - 1))
    cores = segments.mapInArrow(_cores(windows), "core long, n long").groupBy("core").agg(F.sum("n").alias("n")).filter("n > 1")
    words = cores.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()  # SLOTS / 64 rows at most
    bits = np.zeros(SLOTS // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)  # 2 MB
    strings = materialize(segments.mapInArrow(lambda b: _strings(windows, shared.value)(b), "string long, weight long, hash long, sd long, lo long, hi long"), "strings")
    again = strings.filter("weight > 0").groupBy("string").agg(F.sum("weight").alias("n")).filter("n > 1").select("string")
    known = strings.filter("weight = 1").join(again, "string").groupBy("hash", "sd").agg(F.array_sort(F.collect_set("lo"))).mapInArrow(_runs_of, "hash long, sd long, lo long, hi long")
    return strings.filter("weight = 0").select("hash", "sd", "lo", "hi").union(known), strings


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, sd, lo, hi from hash, sd and a sorted list of starts."""
    for b in batches:
        n = np.array([len(x) for x in b.column(2)], np.int64)
        if not len(n):
            continue
        flat, owner = b.column(2).flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
        apart = (flat[1:] != flat[:-1] + 1) | (owner[1:] != owner[:-1])
        first, last = np.flatnonzero(np.concatenate([[True], apart])), np.flatnonzero(np.concatenate([apart, [True]]))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[first])), b.column(1).take(pa.array(owner[first])), pa.array(flat[first].astype(np.int64)), pa.array(flat[last].astype(np.int64))], names=["hash", "sd", "lo", "hi"])


def _keyed(docs: DataFrame, k1: str, k2: str) -> DataFrame:
    """The rows with 128 bits of their own content, by which they are found again: rows with equal keys are equal."""
    return docs.withColumns({k1: F.xxhash64("doc_id", "text"), k2: F.xxhash64("text", F.lit(1), "doc_id")})


_SENT = {"hash": "long", "w": "byte", "sd": "long", "weight": "long", "rel": "long", "seg": "binary"}
_SEGMENT = {"w": np.int8, "hash": np.int64, "sd": np.int64, "weight": np.int64, "first": np.int32, "count": np.int32, "rel": np.int32}


def repeated_spans(docs: DataFrame, windows: Sequence[Window] = (BYTES,)) -> DataFrame:
    """k1, k2, spans: the spans (w, a, b) of each document, in units of window w, that strings of its length found elsewhere cover, not yet united."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs.select("doc_id", "text"), "k1", "k2").select("k1", "k2", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in chunks(batches, "text"):
            for w, window in enumerate(windows):
                doc, h, sd, first, count, rel = anchors(*units_of(data, offs, window), window)
                cols = [rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), pa.array(np.full(len(doc), w, np.int8)), pa.array((h ^ PLACE[30 + w]).view(np.int64)), pa.array(sd.view(np.int64)), *[pa.array(x.astype(np.int32)) for x in (first, count, rel)]]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "w", "hash", "sd", "first", "count", "rel"])

    every = materialize(keyed.mapInArrow(find, "k1 long, k2 long, w byte, hash long, sd long, first int, count int, rel int"), "anchors")
    twice = bitmap(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    members = materialize(among(every, "hash", twice), "members")
    drop(every)
    distinct = members.groupBy("hash", "sd").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("k1", "k2", "w", "first", "count", "rel")).alias("rep"))
    often = distinct.groupBy("hash").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("all > 1").select("hash", (F.col("kinds") > HOT).alias("hot"), (F.col("kinds") == 1).alias("alone"))
    chosen = materialize(distinct.join(often, "hash").select("rep.k1", "rep.k2", "hot", "alone", F.struct("rep.w", "hash", "sd", "weight", "rep.first", "rep.count", "rep.rel").alias("s")), "segments")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in chunks(batches, "text"):
            lists = rows.column(1)
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            c = {k: v.to_numpy().astype(t, copy=False) for (k, t), v in zip(_SEGMENT.items(), lists.flatten().flatten())}
            for w, window in enumerate(windows):
                own = np.flatnonzero(c["w"] == w)
                if not len(own):
                    continue
                units, at = units_of(data, offs, window)
                segs = [units[a : a + k + window.length - 1].tobytes() for a, k in zip((at[owner[own]] + c["first"][own]).tolist(), c["count"][own].tolist())]
                yield pa.RecordBatch.from_arrays([*[pa.array(c[k][own]) for k in ("hash", "w", "sd", "weight")], pa.array(c["rel"][own].astype(np.int64)), pa.array(segs, pa.binary())], names=list(_SENT))

    def segments(of: str) -> DataFrame:
        wanted = chosen.filter(of)
        texts = among(keyed, "k1", bitmap(wanted.select("k1"))).join(wanted.groupBy("k1", "k2").agg(F.collect_list("s").alias("segments")), ["k1", "k2"])
        return texts.select("text", "segments").mapInArrow(cut, ", ".join(f"{k} {t}" for k, t in _SENT.items()))

    result = "hash long, sd long, lo long, hi long"
    # a segment that is the only one of its anchor needs no other: each of its strings occurs weight times
    ranges = chosen.filter("alone").select("s.hash", "s.sd", F.lit(0).cast("long").alias("lo"), (F.col("s.count") - 1).cast("long").alias("hi"))
    ranges = ranges.union(segments("NOT hot AND NOT alone").repartition("hash").sortWithinPartitions("hash").mapInArrow(lambda b: _ranges(_grouped(b), windows), result))
    written = [chosen]
    if not chosen.filter("hot").isEmpty():
        written.append(materialize(segments("hot"), "hot-segments"))
        hot, strings = _of_hot(written[-1], windows)
        ranges, written = ranges.union(hot), [*written, strings]
    ranges = materialize(ranges, "repeats")
    drop(*written)
    lengths = F.element_at(F.array(*[F.lit(w.length) for w in windows]), F.col("w") + 1)
    spans = members.join(ranges, ["hash", "sd"]).select("k1", "k2", "w", (F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + lengths).alias("b"))
    out = materialize(spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("w", "a", "b")).alias("spans")), "spans")
    drop(members, ranges)
    return out


def _borders(text: np.ndarray) -> np.ndarray:
    """Where a cut before each word, or behind the last one, is made in a text: blanks before the first word and behind others go with them."""
    starts, _, _ = word_spans(text, np.array([0, len(text)]))
    return np.concatenate([[0], starts[1:], [len(text)]])


def _covered(length: int, spans: Iterable[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(length + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:length]) > 0


def _runs(flags: np.ndarray) -> np.ndarray:
    """Lengths of the maximal runs."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge < 0) - np.flatnonzero(edge > 0)


MADE = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_repeat"]


def dedup(docs: DataFrame, windows: Sequence[Window] = (BYTES,), seen: Sequence[Window] = ()) -> DataFrame:
    """All columns of docs, text being what is left of it, with n_bytes, n_removed, n_spans, kept_sha256 and longest_repeat.

    A byte goes if a string of the length of any of the windows that also starts anywhere else, in this or another text,
    covers it, with the blanks between and behind its words if the window is of words; all are judged on the input, so no copy is spared. Null text counts as empty and stays null. Repeated rows are copies of each
    other. Characters that a cut leaves broken are left out of text; kept_sha256 is of all bytes left. longest_repeat: the words
    of the longest run that repeated strings of word windows cover, those of `seen` included, by which nothing is cut; 0 where there is none. Columns of docs
    with these five names are replaced; other names cannot clash. An empty table gives no rows.
    """
    docs = docs.drop(*MADE)
    names, k1, k2, spans = docs.columns, *fresh(docs.columns, "k1", "k2", "spans")
    every = [*windows, *seen]
    found = repeated_spans(docs, every).toDF(k1, k2, spans)
    schema = StructType([*docs.schema.fields, *[StructField(k, StringType() if k == "kept_sha256" else LongType()) for k in MADE]])
    at = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in chunks(batches, at):
            text, stats = [], [[] for _ in MADE]
            lists, null = rows.column(len(names)).to_pylist(), rows.column(at).is_null().to_pylist()
            for i in range(rows.num_rows):
                own = data[offs[i] : offs[i + 1]]
                cut, longest, border = [], 0, None
                for w, window in enumerate(every if lists[i] else ()):
                    of = [(s["a"], s["b"]) for s in lists[i] if s["w"] == w]
                    if window.words and of:
                        border = _borders(own) if border is None else border
                        longest = max(longest, int(_runs(_covered(len(border) - 1, of)).max()))
                        of = [(border[a], border[b]) for a, b in of]
                    cut += of if w < len(windows) else []
                gone = _covered(len(own), cut) if cut else None
                left = own.tobytes() if gone is None else own[~gone].tobytes()
                text.append(None if null[i] else left.decode(errors="ignore"))
                for k, v in zip(stats, (len(own), len(own) - len(left), 0 if gone is None else len(_runs(gone)), hashlib.sha256(left).hexdigest(), longest)):
                    k.append(v)
            cols = [rows.column(k) for k in range(len(names))]
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x, pa.string() if k == "kept_sha256" else pa.int64()) for k, x in zip(MADE, stats)]], names=schema.names)

    keyed, bits = _keyed(docs, k1, k2), bitmap(found.select(k1))
    cut = among(keyed, k1, bits).join(found, [k1, k2], "left").select(*names, spans)
    whole = among(keyed, k1, bits, negate=True).select(*names, F.lit(None).cast(found.schema[spans].dataType).alias(spans))
    return cut.union(whole).mapInArrow(work, schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of dedup() by strings of 400 bytes, and longest_repeat by passages of over 50 words."""
    return dedup(docs.select("doc_id", "text"), (BYTES,), (WORDS,)).select("doc_id", *MADE)


def remaining(docs: DataFrame, windows: Sequence[Window] = (BYTES,)) -> DataFrame:
    """docs, all columns, with what dedup() leaves of each text; a text of which nothing is left goes with its row.

    Null and empty texts stay. Repeated rows lose the same. Any other column may have any name: added ones get names that docs does not have.
    """
    plain = plainly(docs, "doc_id", "text")
    left = dedup(plain, windows)
    return left.filter("n_removed = 0 OR n_removed < n_bytes").select(*plain.columns).toDF(*docs.columns)
