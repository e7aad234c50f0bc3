"""The pipeline's stages, one by one, against plain Python on their own inputs."""

import numpy as np
import pytest

from specforge.llm.textkernel import shingle_sets

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] > 0 and sizes[4] == sizes[3]
    assert {"doc_id", "batch_id"} <= set(docs.columns)


def test_representatives_are_distinct(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, SF)
    assert out.select("text").distinct().count() == out.filter("text IS NOT NULL").count()


def test_near_copies_from_four_fifths_on(spark):
    base = [f"w{i}" for i in range(100)]
    near, far = list(base), list(base)
    near[30] = near[70] = "new"
    far[20] = far[50] = far[80] = "new"
    texts = [" ".join(x) for x in (base, near, far)]
    a, b, c = (set(shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist()) for t in texts)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85 and max(len(a & c) / len(a | c), len(b & c) / len(b | c)) < 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, df, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def test_passages_of_over_fifty_words_go(spark):
    word = lambda seed, n: " ".join(f"{seed}{i}" for i in range(n))
    passage, fifty, short = word("p", 51), word("f", 50), " ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(51))
    blob = "x" * 450
    assert all(len(p) < 400 for p in (passage, fifty, short))
    texts = [f"{word('a', 9)} {passage} {word('b', 9)}", f"{word('c', 9)}\n{passage.replace(' p7 ', chr(10) + 'p7  ')} {word('d', 9)}", f"{word('e', 5)} {fifty} {word('g', 5)}", f"{word('h', 5)} {fifty} {word('i', 5)}", f"{word('j', 7)} {short}", f" {short} {word('k', 7)}", f"l {blob}l", f"m {blob}m", f" {passage}\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    left = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["suffix_array_dedup"](spark, df, SF).collect()}
    want = [f"{word('a', 9)} {word('b', 9)}", f"{word('c', 9)}\n{word('d', 9)}", texts[2], texts[3], f"{word('j', 7)} ", word("k", 7), "l", "m", None]
    assert {k: left[k] for k in (0, 1, 2, 3, 4, 5, 9)} == {0: want[0], 1: want[1], 2: want[2], 3: want[3], 4: want[4], 5: want[5], 9: None}
    assert 8 not in left and len(left[6]) < 10 and len(left[7]) < 10
