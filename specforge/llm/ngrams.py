"""Language-model scoring with a trigram model whose trie is dealt out over shards by the word before a token.

Every token (w after v after u) is sent once, to the shard of v. A shard counts the training tokens, builds its part of
the trie and scores all tokens it was sent, so the model is never gathered or broadcast:

level 1  the shard's contexts v, ascending, with their counts and back-off weights;
level 2  the successors w of each v, and the words u before each v: two ascending sequences with pointers;
level 3  the successors of each (u, v), each as its place among the successors of v, with pointers.

Sequences and pointers are Elias-Fano coded in memory-mapped files of the task's temporary folder. Successors are looked up
many at a time in order of context: what lies between the pointers of these contexts is decoded and bisected. Log probabilities are quantised to a byte. Words are 64-bit hashes, numbered within a shard.

A word that begins more than 1 / (2 shards) of all tokens is hot: its tokens are dealt out by u as well. Trigrams stay
whole that way; the parts of its bigram counts meet, as counts, in shards of (v, w), where tokens whose trigram is unseen follow.

P(w | u, v) = (c(uvw) - D) / c(uv) where uvw was seen, else D * (distinct successors of uv) / c(uv) * P(w | v), or
P(w | v) where uv was never seen; P(w | v) likewise from bigrams; P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). A text's first token has no u and starts at P(w | v).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, drop, materialize, n_words, small_batches, utf8
from .textkernel import word_hashes

DISCOUNT = 0.75
#: Text bytes whose tokens are sent together; quantisation steps for each power of ten; words a task counts before it sends them on.
SEND_BYTES, STEPS, COUNT_WORDS = 6 << 20, 24, 1 << 20
#: The most frequent words, told to all tasks (8 bytes each), are sent as numbers, others as hashes with what is sent; tokens looked up together.
COMMON, LOOKED = 49_152, 1 << 17
BEGIN, END = np.uint64(0x5A17C0DE00000001), np.uint64(0xA5E83F21FFFFFFFE)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed by place: first bytes of all values, then second ones..."""
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], np.int64)
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(planes))


def _unpack(blob: bytes) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 1 + 2 * n)[1:].reshape(n, 2)
    out, at = [], 8 * (1 + 2 * n)
    for char, length in head:
        kind = np.dtype(chr(char))
        planes = np.frombuffer(blob, np.uint8, int(length) * kind.itemsize, at).reshape(kind.itemsize, int(length))
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += kind.itemsize * int(length)
    return out


class EliasFano:
    """An ascending sequence of whole numbers below `top`: low bits as they are, high bits in unary, a zero count for each word of 64."""

    def __init__(self, values: np.ndarray, top: int):
        n = len(values)
        self.n, self.shift = n, max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        high = (values >> np.uint64(self.shift)).astype(np.int64)
        self.highs = (top >> self.shift) + 1
        size = -(-(n + self.highs + 1) // 64)
        bits = np.zeros(size * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        upper = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = 64 - np.bitwise_count(upper).astype(np.int64)
        low = values & np.uint64((1 << self.shift) - 1)
        self._file = tempfile.TemporaryFile()
        width = -(-self.shift // 8)
        parts = [upper, (np.cumsum(zeros) - zeros).astype(np.uint64), np.ascontiguousarray(low.view(np.uint8).reshape(n, 8)[:, :width]).reshape(-1)]
        for p in parts:
            self._file.write(p.tobytes())
        self._file.flush()
        whole = np.asarray(np.memmap(self._file, np.uint8, "r"))
        self.upper, self.zeros = whole[: size * 8].view(np.uint64), whole[size * 8 : size * 16].view(np.uint64)
        self.lows = whole[size * 16 :].reshape(n, width)
        self.ones = np.arange(size, dtype=np.int64) * 64 - self.zeros.astype(np.int64)

    def low(self, i: np.ndarray | slice) -> np.ndarray:
        lows = self.lows[i]
        raw = np.zeros((len(lows), 8), np.uint8)
        raw[:, : lows.shape[1]] = lows
        return raw.reshape(-1).view(np.uint64)

    def between(self, a: int, b: int) -> np.ndarray:
        """The values at the places a to b - 1."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first, last = np.searchsorted(self.ones, [a, b - 1], "right") - 1
        ones = np.flatnonzero(np.unpackbits(self.upper[first : last + 1].view(np.uint8), bitorder="little"))
        high = ones[a - self.ones[first] :][: b - a] + 64 * first - np.arange(a, b)
        return (high.astype(np.uint64) << np.uint64(self.shift)) | self.low(np.s_[a:b])

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each value between its begin and its end, or -1; only what lies between the least and the greatest of these is read."""
        if not len(values):
            return np.zeros(0, np.int64)
        start = int(begin.min())
        read = self.between(start, int(end.max()))
        if not len(read):
            return np.full(len(values), -1)
        at = np.searchsorted(read, values)
        found = (read[np.minimum(at, len(read) - 1)] == values) & (at < len(read)) & (at + start >= begin) & (at + start < end)
        return np.where(found, at + start, -1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i, by selecting ones."""
        word = np.searchsorted(self.ones, i, "right") - 1
        left = i - self.ones[word]
        bits, at = np.array(self.upper[word]), np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left >= part
            left -= part * on
            at += width * on
            bits = np.where(on, bits >> np.uint64(width), bits)
        return ((word * 64 + at - i).astype(np.uint64) << np.uint64(self.shift)) | self.low(i)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and for each value its place among them in 32 bits."""
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    place = np.empty(len(key), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return key[new], place


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _codes(probability: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(probability) * STEPS), 0, 255).astype(np.uint8)


class Trie:
    """One shard's n-grams of numbered words: pairs (v, w) in order with counts, and (context, pair) in order with counts,
    where contexts are ascending numbers of (v, u), given as v * size + u, and pairs are named by their places."""

    def __init__(self, size: int, v: np.ndarray, w: np.ndarray, count: np.ndarray, contexts: np.ndarray, context: np.ndarray, pair: np.ndarray, count3: np.ndarray):
        self.size = size
        first = _runs(v)
        begin = np.concatenate([first, [len(v)]]).astype(np.uint64)
        kinds = np.diff(begin.astype(np.int64))
        self.v, rank = v[first], np.repeat(np.arange(len(first)), kinds)
        self.counts = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        self.backoff = np.log10(DISCOUNT * kinds / np.maximum(1, self.counts))
        self.begin = EliasFano(begin, len(v))
        self.successors = EliasFano(rank.astype(np.uint64) * np.uint64(size) + w.astype(np.uint64), len(first) * size)
        self.codes = _codes((count - DISCOUNT) / self.counts[rank])
        # level 3: the words before each v, and the successors of both, relative to those of v
        first3 = _runs(context)
        begin3 = np.concatenate([first3, [len(pair)]])
        own = contexts[context[first3]]
        of = self.rank(own // size)
        self.before = EliasFano(of.astype(np.uint64) * np.uint64(size) + (own % size).astype(np.uint64), len(first) * size)
        self.before_begin = EliasFano(np.searchsorted(of, np.arange(len(first) + 1)).astype(np.uint64), len(own))
        width = np.cumsum(kinds[of])
        base = width - kinds[of]
        top = int(width[-1]) if len(width) else 0
        self.base, self.begin3 = EliasFano(base.astype(np.uint64), top), EliasFano(begin3.astype(np.uint64), len(pair))
        rank3 = np.repeat(np.arange(len(own)), np.diff(begin3))
        self.thirds = EliasFano((base[rank3] + pair - first[of][rank3]).astype(np.uint64), top)
        total = np.add.reduceat(count3, first3) if len(first3) else np.zeros(0, np.int64)
        self.backoff3 = np.log10(DISCOUNT * np.diff(begin3) / np.maximum(1, total))
        self.codes3 = _codes((count3 - DISCOUNT) / total[rank3])

    def rank(self, v: np.ndarray) -> np.ndarray:
        """The place of each v among the contexts of level 1, or -1."""
        if not len(self.v):
            return np.full(len(v), -1)
        at = np.minimum(np.searchsorted(self.v, v), len(self.v) - 1)
        return np.where(self.v[at] == v, at, -1)

    def _between(self, sequence: EliasFano, pointers: EliasFano, context: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.full(len(context), -1)
        known = np.flatnonzero(context >= 0)
        for i in range(0, len(known), LOOKED):
            on = known[i : i + LOOKED]
            own, at = np.unique(context[on], return_inverse=True)
            out[on] = sequence.find(value[on].astype(np.uint64), pointers[own].astype(np.int64)[at], pointers[own + 1].astype(np.int64)[at])
        return out

    def pairs(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(w | v) of seen pairs, or the back-off weight's log10; and the places of the pairs, -1 for unseen."""
        rank = self.rank(v)
        at = self._between(self.successors, self.begin, rank, rank * self.size + w)
        out = np.where(rank >= 0, self.backoff[np.maximum(rank, 0)], 0.0) if len(self.v) else np.zeros(len(v))
        out[at >= 0] = self.codes[at[at >= 0]] / -float(STEPS)
        return out, at

    def contexts(self, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The place of each (u, v) among the contexts of level 3, or -1."""
        rank = self.rank(v)
        return self._between(self.before, self.before_begin, rank, rank * self.size + u)

    def triples(self, context: np.ndarray, v: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 P(w | u, v) of seen triples, or the back-off weight's log10; and which were seen; from the places of (u, v) and (v, w)."""
        out = np.where(context >= 0, self.backoff3[np.maximum(context, 0)], 0.0) if len(self.backoff3) else np.zeros(len(context))
        context = np.where(pair >= 0, context, -1)
        relative = np.zeros(len(pair), np.int64)
        on = np.flatnonzero(context >= 0)
        relative[on] = self.base[context[on]].astype(np.int64) + pair[on] - self.begin[self.rank(v[on])].astype(np.int64)
        at = self._between(self.thirds, self.begin3, context, relative)
        seen = at >= 0
        out[seen] = self.codes3[at[seen]] / -float(STEPS)
        return out, seen


class Hot:
    """The hot words, at most 2 a shard: hashes in order, training counts, parts."""

    def __init__(self, word: np.ndarray, count: np.ndarray, parts: np.ndarray, kinds: np.ndarray | None = None):
        self.word, self.count, self.parts, self.kinds = word, count, parts, kinds

    def find(self, v: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.full(len(v), -1)
        at = np.minimum(np.searchsorted(self.word, v), len(self.word) - 1)
        return np.where(self.word[at] == v, at, -1)


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * _ODD)) * _ODD
    return (x ^ (x >> np.uint64(29))) * _ODD


def _deal(v: np.ndarray, u: np.ndarray, shards: int, hot: Hot) -> np.ndarray:
    to, at = _shard_of(v, shards), hot.find(v)
    i = np.flatnonzero(at >= 0)
    part = (_mixed(u[i], v[i]) >> np.uint64(32)) % hot.parts[at[i]].astype(np.uint64)
    to[i] = _shard_of(_mixed(v[i], part + np.uint64(1)), shards)
    return to


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


_WORDS = "word long, n long, every long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and BEGIN with their counts in training rows and in all rows, summed within the task."""
    held, size = [], 0

    def out() -> Iterator[pa.RecordBatch]:
        word, (n, every) = _sum_by(*[np.concatenate(x) for x in zip(*held)])
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(every.astype(np.int64))], names=["word", "n", "every"])

    for rows, data, offs in chunks(batches, 2):
        train = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
        words, doc = word_hashes(data, offs)
        word, inverse = np.unique(words, return_inverse=True)
        held.append((np.append(word, BEGIN), np.append(np.bincount(inverse, weights=train[doc], minlength=len(word)), train.sum()), np.append(np.bincount(inverse, minlength=len(word)), len(train))))
        size += len(word) + 1
        if size > COUNT_WORDS:
            word, sums = _sum_by(*[np.concatenate(x) for x in zip(*held)])
            held, size = [(word, *sums)], len(word)
            if size > COUNT_WORDS // 2:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


_SENT = "shard int, blob binary"


def _distinct(words: int, docs: int, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of three columns of word numbers and one of document numbers, in order, and how often each occurs."""
    a, b = words.bit_length(), docs.bit_length()
    if 3 * a + b <= 64:
        key = columns[0].astype(np.uint64)
        for c, width in zip(columns[1:], (a, a, b)):
            key = (key << np.uint64(width)) | c.astype(np.uint64)
        key, n = np.unique(key, return_counts=True)
        out = []
        for width in (b, a, a, a):
            out.append((key & np.uint64((1 << width) - 1)).astype(np.int64))
            key >>= np.uint64(width)
        return out[::-1], n
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    first = np.flatnonzero(np.concatenate([[True], np.any([r[1:] != r[:-1] for r in rows], axis=0)]))
    return [r[first] for r in rows], np.diff(np.append(first, len(order)))


def _send(shards: int, hot: Hot, common: np.ndarray):
    by_hash = np.argsort(common)
    sorted_common = common[by_hash]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            data, offs = utf8(table.column(2))
            keys, train = table.column(0).to_numpy(), table.column(1).to_numpy().astype(np.uint8)
            words, doc = word_hashes(data, offs)
            n_docs, n = len(keys), len(words)
            vocab, ids = np.unique(np.concatenate([words, [BEGIN, END]]), return_inverse=True)
            begin, end = ids[-2:]
            code = np.full(len(vocab), -1)
            if len(common):
                near = np.minimum(np.searchsorted(sorted_common, vocab), len(common) - 1)
                code = np.where(sorted_common[near] == vocab, by_hash[near], -1)
            rare = code < 0
            at = np.arange(n) + doc  # each document's tokens: its words, then an end
            w = np.full(n + n_docs, end, np.int64)
            w[at] = ids[:-2]
            owner = np.empty(n + n_docs, np.int64)
            owner[at] = doc
            ends = np.cumsum(np.bincount(doc, minlength=n_docs) + 1)
            owner[ends - 1] = np.arange(n_docs)
            starts = np.concatenate([[0], ends[:-1]])
            v, u = np.empty_like(w), np.empty_like(w)
            v[1:] = w[:-1]
            v[starts] = begin
            u[1:] = v[:-1]
            u[starts] = w[starts]  # deals first tokens out by themselves; no trigram is made of it
            (v, u, w, owner), times = _distinct(len(vocab), n_docs, v, u, w, owner)
            to = _deal(vocab[v], vocab[u], shards, hot)
            order = np.argsort(to.astype(np.int32), kind="stable")
            cuts = np.searchsorted(to[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[s] : cuts[s + 1]]
                used = np.zeros(len(vocab), bool)
                for x in (v, u, w):
                    used[x[own]] = True
                used &= rare
                number = np.where(rare, len(common) + np.cumsum(used) - 1, code)
                first = _runs(v[own])
                there, docs_at = np.unique(owner[own], return_inverse=True)
                blob = _pack(vocab[used], _small(number[v[own][first]]), _small(np.diff(np.append(first, len(own)))), _small(number[u[own]]), _small(number[w[own]]), _small(docs_at), _small(times[own]), keys[there], train[there])
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "blob"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(2).nbytes
            if size >= SEND_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return work


_MADE = "kind int, shard int, blob binary"


def _made(kind: int, shard: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["kind", "shard", "blob"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    shard, held = None, []
    for b in batches:
        for s, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if s != shard and held:
                yield shard, held
                held = []
            shard = s
            held.append(_unpack(blob.as_py()))
    if held:
        yield shard, held


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    u, inv = np.unique(key, return_inverse=True)
    return u, [np.bincount(inv, weights=v, minlength=len(u)) for v in values]


def _packed_sums(total: list[tuple[np.ndarray, ...]], shards: int) -> Iterator[pa.RecordBatch]:
    """Sums by document, packed for the shard of the document's key: rows do not multiply with the number of shards."""
    if not total:
        return
    key, sums = _sum_by(*[np.concatenate(x) for x in zip(*total)])
    to = _shard_of(key.view(np.uint64), shards)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[s] : cuts[s + 1]]
        yield _made(0, int(s), _pack(key[own], *[v[own].astype(kind) for v, kind in zip(sums, (np.float64, np.int64, np.float32))]))


def _merge_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document from the packed sums of its shard."""
    for _, sent in _by_shard(batches):
        key, sums = _sum_by(*[np.concatenate(x) for x in zip(*sent)])
        yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums)], names=["key", *_SUMS[: len(sums)]])


_SUMS = ["base", "known", "model"]


def _send_on(kind: int, to: np.ndarray, shards: int, item: np.ndarray, describe: list[np.ndarray], doc: np.ndarray, times: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Tokens for another shard: what the used items are (describe), item, document and times of each token, the documents' keys."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[s] : cuts[s + 1]]
        used, at = np.unique(item[own], return_inverse=True)
        there, docs_at = np.unique(doc[own], return_inverse=True)
        yield _made(kind, int(s), _pack(_small(at), _small(docs_at), _small(times[own]), keys[there], *[d[used] for d in describe]))


def _count_and_score(shards: int, hot: Hot, common: np.ndarray):
    """From what a shard was sent: kind 0 sums by document; 1 tokens whose pair is unseen; 2 words' counts; and of hot words
    3 pairs with their counts here, 4 tokens whose triple is unseen."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[tuple[np.ndarray, ...]] = []
        for shard, sent in _by_shard(batches):
            vocab, place = _numbered(np.concatenate([common, *[p[0] for p in sent]]))
            shared, *own = np.split(place, len(common) + np.cumsum([0] + [len(p[0]) for p in sent])[:-1])
            place = [np.concatenate([shared, x]) for x in own]
            base = np.cumsum([0] + [len(p[7]) for p in sent])
            v = np.concatenate([np.repeat(x[p[1]], p[2]) for x, p in zip(place, sent)])
            u = np.concatenate([x[p[3]] for x, p in zip(place, sent)])
            w = np.concatenate([x[p[4]] for x, p in zip(place, sent)])
            doc = np.concatenate([p[5].astype(np.int32) + np.int32(a) for p, a in zip(sent, base)])
            times = np.concatenate([p[6] for p in sent])
            keys, train = np.concatenate([p[7] for p in sent]), np.concatenate([p[8] for p in sent]).astype(bool)
            del sent, place, own
            size = len(vocab)
            taught = times * train[doc]
            v = v.astype(np.int64) * size
            pairs, pair = _numbered(v + w)
            contexts, context = _numbered(v + u)
            del v, u, w
            triples, triple = _numbered(context.astype(np.int64) * len(pairs) + pair)
            del context
            count = np.bincount(pair, weights=taught, minlength=len(pairs)).astype(np.int64)
            count3 = np.bincount(triple, weights=taught, minlength=len(triples)).astype(np.int64)
            del taught
            pv, pw = pairs // size, pairs % size
            tc, tp = triples // len(pairs), triples % len(pairs)
            starts = vocab == BEGIN
            has, has3 = count > 0, (count3 > 0) & ~starts[pv[tp]]
            trie = Trie(size, pv[has], pw[has], count[has], contexts, tc[has3], (np.cumsum(has) - 1)[tp[has3]], count3[has3])
            value, at = trie.pairs(pv, pw)
            known_context = trie.contexts(contexts // size, contexts % size)
            value3, seen3 = trie.triples(known_context[tc], pv[tp], at[tp])
            hot_at = hot.find(vocab)
            rank = trie.rank(pv)
            c = np.where(rank >= 0, trie.counts[np.maximum(rank, 0)], 0) if len(trie.counts) else np.zeros(len(pairs), np.int64)
            is_hot = hot_at[pv] >= 0
            if is_hot.any():
                c[is_hot] = hot.count[hot_at[pv[is_hot]]]
            word = ~starts[pv]
            down = ~seen3[triple]
            model = value3[triple] + np.where(down & ~is_hot[pair], value[pair], 0)
            sums = (np.where(word, np.log10(c + 0.5), 0)[pair], (word & (c > 0))[pair], model)
            total.append((keys, *[np.bincount(doc, weights=x * times, minlength=len(keys)) for x in sums]))
            del model, sums
            miss = np.flatnonzero(down & ~is_hot[pair] & (at[pair] < 0))
            yield from _send_on(1, _shard_of(vocab[pw[pair[miss]]], shards), shards, pw[pair[miss]], [vocab], doc[miss], times[miss], keys)
            later = np.flatnonzero(down & is_hot[pair])
            to = _shard_of(_mixed(vocab[pv], vocab[pw]), shards)
            yield from _send_on(4, to[pair[later]], shards, pair[later], [vocab[pv], vocab[pw]], doc[later], times[later], keys)
            part = np.flatnonzero(is_hot & has)
            for s in np.unique(to[part]):
                own = part[to[part] == s]
                yield _made(3, int(s), _pack(vocab[pv[own]], vocab[pw[own]], count[own]))
            cold = (hot_at[trie.v] < 0) & ~starts[trie.v]
            yield _made(2, int(shard), _pack(vocab[trie.v[cold]], trie.counts[cold].astype(np.int64)))
            if sum(len(t[0]) for t in total) > 2_000_000:
                yield from _packed_sums(total, shards)
                total = []
        yield from _packed_sums(total, shards)

    return work


def _hot_pairs(hot: Hot, parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order; and, in order, number of the hot word * words + word, with its count."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    v, w, count = (np.concatenate(x) for x in zip(*parts))
    words, at = np.unique(w, return_inverse=True)
    pairs, (counts,) = _sum_by(hot.find(v) * len(words) + at, count)
    return words, pairs, counts.astype(np.int64)


def _hot_kinds(hot: Hot):
    """Successors of each hot word among a shard's pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _by_shard(batches):
            words, pairs, _ = _hot_pairs(hot, parts)
            at, kinds = np.unique(pairs // len(words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(kinds.astype(np.int64))], names=["at", "kinds"])

    return work


def _score_hot(hot: Hot, shards: int):
    """P(w | v) after hot words: kind 0 sums by document, 1 tokens whose pair is unseen; a shard gets its counts (3) first, then tokens (4)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shard, parts, ready = [], None, [], None
        for b in batches:
            for s, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                p = _unpack(blob.as_py())
                if s != shard:
                    shard, parts, ready = s, [], None
                if kind == 3:
                    parts.append(p)
                    continue
                words, pairs, counts = ready = ready or _hot_pairs(hot, parts)
                item, doc, times, keys, v, w = p
                h = hot.find(v)
                c = np.zeros(len(v), np.int64)
                if len(pairs):
                    at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                    key = np.where(words[at] == w, h * len(words) + at, -1)
                    place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                    c = np.where(pairs[place] == key, counts[place], 0)
                of = np.maximum(1, hot.count[h])
                value = np.where(c > 0, _codes(np.maximum(c - DISCOUNT, DISCOUNT / 4) / of) / -float(STEPS), np.where(hot.count[h] > 0, np.log10(DISCOUNT * np.maximum(1, hot.kinds[h]) / of), 0))
                total.append((keys, np.bincount(doc, weights=value[item] * times, minlength=len(keys))))
                miss = np.flatnonzero(c[item] == 0)
                yield from _send_on(1, _shard_of(w[item[miss]], shards), shards, item[miss], [w], doc[miss].astype(np.int64), times[miss], keys)
            if sum(len(t[0]) for t in total) > 2_000_000:
                yield from _packed_sums(total, shards)
                total = []
        yield from _packed_sums(total, shards)

    return work


def _look_up(ends: int, log_total: float, hot: Hot, shards: int):
    """log10 P(w) of the tokens sent on, summed by document; what a shard gets: its words' counts (2) and tokens (1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shard, words, counts = [], None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for s, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                p = _unpack(blob.as_py())
                if s != shard:
                    shard, words, counts = s, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if kind == 2:  # first of its shard
                    words, counts = p
                    continue
                item, doc, times, keys, word = p
                c = np.where(word == END, ends, 0)
                if len(words):
                    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
                    c = np.where(words[at] == word, counts[at], c)
                at = hot.find(word)
                c[at >= 0] = hot.count[at[at >= 0]]
                total.append((keys, np.bincount(doc, weights=(np.log10(c + 0.5) - log_total)[item] * times, minlength=len(keys))))
            if sum(len(t[0]) for t in total) > 2_000_000:
                yield from _packed_sums(total, shards)
                total = []
        yield from _packed_sums(total, shards)

    return work


def score(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens are a text's words, A-Z lower-cased, and one end. Rows whose crc32(doc_id) mod 5 is 1 teach nothing; a null doc_id
    teaches. Null and empty texts are an end alone; repeated rows count each and get equal scores; with no training rows
    all counts are 0; an empty table gives no rows. Shards follow the number of input partitions.
    """
    small_batches(docs.sparkSession, 200)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), _held_out(F.col("doc_id")).alias("held_out"))
    shards = shards or max(16, 4 * docs.rdd.getNumPartitions())
    texts = rows.select("key", (~F.col("held_out")).alias("train"), "text")
    counts = materialize(texts.mapInArrow(_count_words, _WORDS).groupBy("word").agg(F.sum("n").alias("n"), F.sum("every").alias("every")), "words")
    begin = F.col("word") == int(BEGIN.astype(np.int64))
    zero = F.lit(0)
    n, v, ends, every = counts.agg(*[F.coalesce(x, zero) for x in (F.sum(F.when(~begin, F.col("n"))), F.count_if(~begin & (F.col("n") > 0)), F.sum(F.when(begin, F.col("n"))), F.sum("every"))]).first()
    n, v = n + ends, v + (ends > 0)
    found = sorted((r["word"] % (1 << 64), r["n"], min(shards, -(-r["every"] * 2 * shards // every))) for r in counts.filter(F.col("every") * (2 * shards) > every).collect())  # fewer than 2 a shard
    hot = Hot(np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], np.int64))
    common = counts.orderBy(F.desc("every"), "word").limit(COMMON).select("word").toArrow().column(0).to_numpy().view(np.uint64)
    drop(counts)
    log_total = float(np.log10(n + 0.5 * (v + 1)))
    sorted_by = lambda df, *order: df.repartition("shard").sortWithinPartitions("shard", *order)
    made = materialize(sorted_by(texts.mapInArrow(_send(shards, hot, common), _SENT)).mapInArrow(_count_and_score(shards, hot, common), _MADE), "scores")
    tokens, sums_after = made.filter("kind in (1, 2)"), []
    if found:
        kinds = {r["at"]: r["kinds"] for r in sorted_by(made.filter("kind = 3").select("shard", "blob")).mapInArrow(_hot_kinds(hot), "at long, kinds long").groupBy("at").agg(F.sum("kinds").alias("kinds")).collect()}
        hot.kinds = np.array([kinds.get(i, 0) for i in range(len(found))], np.int64)
        after = materialize(sorted_by(made.filter("kind > 2").select("shard", "kind", "blob"), "kind").mapInArrow(_score_hot(hot, shards), _MADE), "hot-scores")
        tokens, sums_after = tokens.unionAll(after.filter("kind = 1")), [after.filter("kind = 0")]
    merged = lambda df, *names: sorted_by(df.select("shard", "blob")).mapInArrow(_merge_sums, "key long, " + ", ".join(f"{k} double" for k in names))
    looked = sorted_by(tokens.select("shard", "kind", "blob"), F.desc("kind")).mapInArrow(_look_up(ends, log_total, hot, shards), _MADE)
    for df in sums_after:
        looked = looked.unionAll(df)
    rest = merged(looked, "base").withColumnRenamed("base", "rest")
    sums = merged(made.filter("kind = 0"), *_SUMS)
    whole = rows.select("doc_id", "key", "held_out", n_words(F.col("text")).alias("words")).join(sums, "key", "left").join(rest, "key", "left")
    # equal rows were summed together: each has its part
    copies = F.count(F.lit(1)).over(Window.partitionBy("key"))
    part = lambda k: F.coalesce(F.col(k), F.lit(0.0)) / F.col("copies")
    tokens = F.col("words") + 1
    return whole.withColumn("copies", copies).select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.round(part("known")) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (part("base") + F.lit(float(np.log10(ends + 0.5))) - tokens * F.lit(log_total)).alias("base_score"), (part("model") + part("rest")).alias("score"),
    )
