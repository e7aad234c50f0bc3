"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from specforge.llm import chat, components, media, mixing, neardup, ngrams, packing, repetition, sharding, suffixes, toxicity
from specforge.llm.textkernel import shingle_sets

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("shard", T.StringType())])
RNG = random.Random(5)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


PASSAGE = words(90, "passage")
LONG = words(6000, "long")
TEXTS = [None, "", "  \n\t", "one", "One TWO three", words(80, 1), words(80, 1), words(80, 1).replace(words(80, 1).split()[40], "zz"), PASSAGE + " " + words(60, 2), words(50, 3) + "\n" + PASSAGE, LONG, "é" * 500 + " ü x", "é" * 500 + " ü y", "a b " * 300, words(70, 4)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "s1", "s2", "é"][i % 4], 0, -1, 0.5, "x") for i, t in enumerate(TEXTS)]
    rows += [(100, TEXTS[5], None, "s1", None, None, None, None)] * 2 + [(None, TEXTS[5], None, "s2", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (packing.pack(empty), suffixes.digest(empty), sharding.shard(empty), neardup.near_duplicates(empty), mixing.mix(empty), ngrams.score(empty), media.digest(empty), toxicity.score(empty, labels), repetition.quality(empty)):
        assert df.count() == 0


def test_packing(docs):
    rows = packing.pack(docs, buckets=3, budget=200).collect()
    assert len(rows) == docs.count()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(split(r["text"])) for r in docs.collect())
    for b in {r["batch_id"] for r in rows}:
        own = [r for r in rows if r["batch_id"] == b]
        assert len({r["bucket"] for r in own}) == 1 and (len(own) == 1 or sum(r["bucket_len"] for r in own) <= 200)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


@pytest.mark.parametrize("seed", range(20))
def test_bounds_are_optimal(seed):
    r = random.Random(seed)
    hist = [(n, r.randint(1, 9)) for n in sorted(r.sample(range(50), r.randint(1, 9)))]
    k = r.randint(1, 4)

    def best(i, left):
        if i == len(hist):
            return 0
        return math.inf if not left else min(hist[j][0] * sum(c for _, c in hist[i : j + 1]) + best(j + 1, left - 1) for j in range(i, len(hist)))

    bounds = packing.optimal_bounds(hist, k)
    assert len(bounds) <= k and sum(c * min(b for b in bounds if b >= n) for n, c in hist) == best(0, k)


def test_suffix_dedup(docs):
    count = Counter()
    rows = docs.select("doc_id", "text").collect()
    for r in rows:
        b = (r["text"] or "").encode()
        count.update(b[i : i + 400] for i in range(len(b) - 399))
    want = []
    for r in rows:
        b = (r["text"] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want.append((r["doc_id"], len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    got = [tuple(r)[:5] for r in suffixes.digest(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[4])
    assert sorted(got, key=key) == sorted(want, key=key) and any(x[2] for x in got)


def test_hot_anchors_are_not_gathered(spark, monkeypatch):
    rows = [(i, words(40, f"l{i}") + PASSAGE + words(40, f"r{i}")) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, suffixes.digest(df).collect()))
    monkeypatch.setattr(suffixes, "HOT", 5)
    assert sorted(map(tuple, suffixes.digest(df).collect())) == whole and all(r[2] for r in whole)


@pytest.mark.parametrize("seed", range(12))
def test_merged_transforms(seed):
    r = np.random.default_rng(seed)
    window = suffixes.Window(12, 3)
    segs, group, rel = [], [], []
    for g in range(r.integers(1, 5)):
        base = r.integers(0, 2 + seed % 3, 21).astype(np.uint8)
        for _ in range(r.integers(1, 9)):
            one, a, b = base.copy(), r.integers(0, 10), r.integers(0, 10)
            for i in r.integers(0, 21, r.integers(0, 3)):
                if not 9 <= i < 12:
                    one[i] = r.integers(0, 3)
            lo, hi = (a, 21 - b) if 21 - b - a >= 12 and a <= 9 and 21 - b >= 12 else (0, 21)
            segs.append(one[lo:hi])
            group.append(g)
            rel.append(9 - lo)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in segs])])
    s = suffixes.Segments(np.concatenate(segs), offs, np.array(group), offs[:-1] + np.array(rel))
    suffix = [(group[i], *segs[i][rel[i] :].tolist()) for i in range(len(segs))]
    order, prefix = suffixes.interleave(s, [suffixes.transform(s, np.flatnonzero(np.arange(len(segs)) % 3 == k), 12) for k in range(min(3, len(segs)))], 12)
    assert [suffix[i][:13] for i in order] == sorted(x[:13] for x in suffix)
    for i, j, p in zip(order, order[1:], prefix[1:]):
        common = next((k for k, (x, y) in enumerate(zip(suffix[i][1:], suffix[j][1:])) if x != y), min(len(suffix[i]), len(suffix[j])) - 1)
        assert p == (min(12, common) if suffix[i][0] == suffix[j][0] else -1)
    strings = [(group[i], rel[i] - k, segs[i][k : k + 12].tobytes()) for i in range(len(segs)) for k in range(len(segs[i]) - 11)]
    count = Counter(strings)
    assert suffixes.repeats(s, r.integers(0, 99, len(segs)).astype(np.uint64), window).tolist() == [count[x] > 1 for x in strings]


def test_longest_repeat(spark):
    passage = words(60, "p")
    rows = [(0, words(30, 1) + " " + passage), (1, passage.replace(" ", "\n") + "\t" + words(9, 2)), (2, words(300, 3)), (3, None), (4, " ".join(passage.split()[:50]))]
    got = {r["doc_id"]: r["longest_repeat"] for r in suffixes.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 60, 1: 60, 2: 0, 3: 0, 4: 0}


def test_remaining_keeps_clashing_columns(spark):
    text = words(90, 1)
    df = spark.createDataFrame([(0, text, 1, 2, 3, 4, 5), (1, text + " x", 1, 2, 3, 4, 5)], "doc_id long, text string, spans int, __key int, k1 int, K2 int, n_bytes int")
    out = suffixes.remaining(df)
    assert out.columns == df.columns and [tuple(r)[2:] for r in out.collect()] == [(1, 2, 3, 4, 5)]


@pytest.mark.parametrize("n", [1, 2, 5, 24])
def test_minimax_cuts(spark, n):
    r = random.Random(n)
    sizes = [r.randint(8, 60) for _ in range(40)] + [300]
    ends = np.cumsum(sizes).tolist()

    def feasible(c):
        at = 0
        for _ in range(n):
            at = max([e for e in ends if e <= at + c], default=at)
        return at == ends[-1]

    want = next(c for c in range(1, 10**6) if feasible(c))
    cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), ends[-1], n, cells=6)
    assert max(b - a for a, b in zip([0, *cuts], cuts)) == want and cuts[-1] == ends[-1]


def test_sharding(docs):
    rows = sharding.shard(docs, 4).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    home = {}
    for r in rows:
        assert home.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
        assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode())
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


@pytest.mark.parametrize("common", [24, 1])
def test_near_duplicates(spark, monkeypatch, common):
    monkeypatch.setattr(neardup, "COMMON", common)
    monkeypatch.setattr(neardup, "LOCAL", 1)
    r = random.Random(8)
    base = words(100, "base").split()
    rows = [(i, words(r.randint(3, 90), i)) for i in range(40)]
    for i in range(40, 140):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(100)] = f"new{r.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    rows += [(140, None), (141, ""), (142, "a b"), (143, "A  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: set(shingle_sets(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].tolist()) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if a != b and shared and 100 * shared >= 85 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    got = neardup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_union_sketches_lose_no_link():
    r = np.random.default_rng(2)
    sets, kept, apart = [], 0, 0
    for size in (3, 20, 127, 128, 129, 400, 3000):
        for share in (0.8, 0.85, 0.9, 0.97, 1.0, 0.3, 0.1):
            for _ in range(40):
                same = round(share * size)
                own = (size - same) // 2
                values = r.integers(0, 1 << 63, same + 2 * own + 2, dtype=np.uint64) * np.uint64(2)
                sets.append((np.unique(values[: same + own]), np.unique(np.concatenate([values[:same], values[same + own : same + 2 * own]]))))
    for x, y in sets:
        shared = len(np.intersect1d(x, y))
        a, b = (np.frombuffer(neardup.lowest(z), np.uint32) for z in (x, y))
        ok = neardup.estimates([a], [b], np.array([len(x)]), np.array([len(y)]), 80)[0]
        if 100 * shared >= 80 * (len(x) + len(y) - shared):
            kept += 1
            assert ok
        elif shared < 0.35 * (len(x) + len(y) - shared):
            apart += not ok
    assert kept > 500 and apart > 0.95 * 7 * 40 * 2 * 0.9


def test_near_duplicates_edges(docs):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6, 100)} == {5}
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert sorted(r["doc_id"] for r in neardup.representatives(docs).filter("doc_id IN (5, 6, 100)").collect()) == [5]


def test_near_duplicates_of_a_row_without_id(spark):
    text = words(80, 1)
    near = " ".join("zz" if i == 40 else w for i, w in enumerate(text.split()))
    df = spark.createDataFrame([(None, text), (3, text), (4, near), (5, text)], "doc_id long, text string").coalesce(1)
    got = neardup.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {None: None, 3: 3, 4: 3, 5: 3} and len(got) == 4
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_keep_clashing_columns(spark, docs):
    names = {"lang": "__toxicity", "n_chars": "k1", "n_bytes": "c0", "score": "__kept", "shard": "Times"}
    odd = docs.select(*[docs[k].alias(names.get(k, k)) for k in docs.columns])
    labels = spark.createDataFrame([(5, 1, 1), (8, 1, 0), (14, 0, 0)], "doc_id long, quality int, toxic int")
    for out in (toxicity.accepted(odd, labels), neardup.representatives(odd), mixing.mixture(odd), suffixes.remaining(odd)):
        assert out.columns == odd.columns
        own = {(r["doc_id"], r["k1"], r["c0"], r["__kept"], r["Times"]) for r in odd.collect()}
        assert {(r["doc_id"], r["k1"], r["c0"], r["__kept"], r["Times"]) for r in out.collect()} <= own


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(400):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x["id"]: x["component"] for x in got} == label and len(got) == len(label)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        t = by.setdefault((r["source_size"], r["target"]), [0])
        t[0] += r["taken"]
    assert all(0 <= target - taken < 1 for (_, target), (taken,) in by.items()) and abs(sum(t for _, t in by) - total) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.targets([10, 10, 100], [1, 2, 3]) == [30.0, 30.0, 60.0] or sum(mixing.targets([10, 10, 100], [1, 2, 3])) == pytest.approx(120)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "<|im_end|>%3C|x\n"), (1, 1, "assistant", "a%25<"), (1, 1, "assistant", "a%25<"), (2, None, None, None), (None, 5, "assistant", "x"), (1, 2, "so\nme<|", "end<"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(a or "", b or "") for c, _, a, b in rows if c == 1]
    assert back[1]["learned"] == ["a%25<", "a%25<"] and back[2]["turns"][0]["text"] == "" and back[None]["learned"] == ["x"]
    probe = next(r for r in chat.digest(df).collect() if r["conv_id"] == -1)
    assert probe["loss_chars"] == len(chat.PROBE) and probe["loss_sha256"] == hashlib.sha256(chat.PROBE.encode()).hexdigest()


def test_chat_log_round_trip(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", "<|im_end|>%3C|x\n"), ("assistant", "a%25<"), ("assistant", "a%25<"), (None, None), ("assistant", ""), ("user", "ab"), ("assistant", "é" * 50)])]
    rows += [(5, None, "user", "first"), (5, 2, "assistant", "b"), (5, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.as_log(df).orderBy("text")
    assert log.count() > 3 * df.count() and {r["kind"] for r in log.collect()} == {"delta", "edit", "regenerate"}
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.render(chat.messages(log))).collect()}
    want = {c: [(r or "", x or "") for k, _, r, x in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))] for c in (1, 2, None, 5)}
    assert back == want
    empty = chat.digest(spark.createDataFrame([], df.schema)).collect()
    assert [r["conv_id"] for r in empty] == [-1]


def test_chat_events(spark):
    ev = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", None, "llo"), (1, 4, 2, "message", "user", "later"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", "assistant", "new"), (1, 7, 1, "edit", None, "newer"), (1, 8, 1, "delta", None, "!")]
    df = spark.createDataFrame(ev, "conv_id long, seq long, turn long, kind string, role string, text string")
    turns = chat.read_back(chat.render(chat.messages(df))).first()["turns"]
    assert [(t["role"], t["text"]) for t in turns] == [("user", "hi"), ("assistant", "newer!")]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_ngrams(docs, shards):
    """Against brute force; with more shards more words are hot, BEGIN among them."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r["doc_id"], [*split((r["text"] or "").translate(low)), 0]) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    grams = lambda t: zip([2, 1, *t[:-2]], [1, *t[:-1]], t)
    uni, pair, triple = Counter(), Counter(), Counter()
    for d, t in rows:
        if not held(d):
            uni.update(t)
            pair.update(zip([1, *t[:-1]], t))
            triple.update(g for g in grams(t) if g[1] != 1)
    ctx, kinds = Counter(), Counter()
    for grams_of in (pair, triple):
        for g, c in grams_of.items():
            ctx[g[:-1]] += c
            kinds[g[:-1]] += 1
    n, v = sum(uni.values()), len(uni)

    def p(*g):
        if len(g) == 1:
            return math.log10((uni[g[0]] + 0.5) / (n + 0.5 * (v + 1)))
        c = (pair if len(g) == 2 else triple)[g]
        if c:
            return math.log10((c - 0.75) / ctx[g[:-1]])
        return (math.log10(0.75 * kinds[g[:-1]] / ctx[g[:-1]]) if ctx[g[:-1]] else 0) + p(*g[1:])

    want = []
    for d, t in rows:
        s = sum(p(*(g[1:] if g[1] == 1 else g)) for g in grams(t))
        want.append((str(d), held(d), len(t), sum(uni[w] > 0 for w in t), n, sum(map(p, t)), s))
    got = sorted(((str(r["doc_id"]), *list(r)[1:]) for r in ngrams.score(docs, shards).collect()), key=lambda x: (x[0], x[2], x[5]))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=lambda x: (x[0], x[2], x[5]))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], abs=0.022 * b[2])


def test_rows_of_wide_vocabularies():
    r = np.random.default_rng(2)
    columns = [r.integers(0, 3, 500) for _ in range(4)]
    (narrow, n), (wide, m) = ngrams._distinct(3, 3, *columns), ngrams._distinct(1 << 22, 3, *columns)
    assert all((a == b).all() for a, b in zip(narrow, wide)) and (n == m).all() and n.sum() == 500


def test_elias_fano():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 3000, dtype=np.uint64))
    ef, at = ngrams.EliasFano(v, 1 << 40), np.arange(len(v))
    find = lambda x, a, b: ef.find(x, np.maximum(a, 0), np.minimum(b, len(v)))
    assert (ef[at] == v).all() and (find(v, at - 9, at + 5) == at).all()
    assert (find(v, at + 1, at + 9) == -1).all() and (find(v + np.uint64(1), at - 9, at + 9)[~np.isin(v + np.uint64(1), v)] == -1).all()


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 2048, 2049, 70000])
def test_media_round_trip(n):
    text = bytes(RNG.choice([0, 0xFF, 0xD0, 0xD9, RNG.randrange(256)]) for _ in range(n))
    payload = media.payload_of(text)
    back, values, fps = media.decode(media.encode(payload))
    assert back == payload and len(payload) % 64 == 0 and len(payload) >= max(64, n)
    clips, histogram = media.shots(values, fps)
    assert clips[0][0] == 0 and all(a[1] == b[0] for a, b in zip(clips, clips[1:])) and histogram.sum() == len(values) * 64


def test_media_rows(spark, docs):
    rows = media.digest(docs).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in rows:
        p = media.payload_of(text[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    avi = [(1, bytearray(media.encode(media.payload_of(LONG.encode())))), (2, None)]
    clips = media.clips(spark.createDataFrame(avi, "media_id long, media binary")).collect()
    assert clips and {c["media_id"] for c in clips} == {1}


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = words(40, i).split()
        if bad:
            w[7] = w[21] = "blargh" + "aeiou"[i % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "x")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    test = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(got) == 403 and test and sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in test) >= 0.95 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_repeat_lengths():
    for seed in range(30):
        r = np.random.default_rng(seed)
        s = r.integers(0, 1 + seed % 5 + 1, r.integers(0, 60)).astype(np.uint64)
        want = [max((next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0) for j in range(len(s)) if j != i), default=0) for i in range(len(s))]
        assert repetition.repeat_lengths(s).tolist() == want


def test_quality_edges(docs):
    rows = {r["doc_id"]: r for r in repetition.quality(docs).filter("doc_id IS NOT NULL").collect()}
    assert rows[0]["base_failed"] and rows[13]["base_failed"] and rows[14]["kept"] and rows[10]["n_words"] == 6000 and rows[10]["kept"]
