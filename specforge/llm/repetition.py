"""Quality rules with repetition measured by a suffix array over each document's words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, small_batches
from .textkernel import BLANK, PLACE, mix, prefix_hash, span_hash, word_spans

#: A repeat counts from this many words on.
MIN_REPEAT = 10
#: A document goes if repeats cover more than this percentage of its words,
MOST_COVERED = 20
#: or if one repeat has more words than this.
LONGEST_REPEAT = 64
#: Base rules: fewest words; largest percentage of words in repeated 3-word windows.
FEWEST_WORDS, MOST_REPEATED = 50, 50
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def repeat_lengths(symbols: np.ndarray) -> np.ndarray:
    """For each place the length of the longest sequence that starts there and also starts elsewhere.

    Suffixes are sorted by prefix doubling, in which only places whose rank is still shared are sorted again; common
    prefixes of neighbours follow from the ranks that each doubling left.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    _, inverse, count = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[inverse]
    live = np.flatnonzero(count[inverse] > 1)
    ranks, h = [rank], 1
    while live.size:
        after = np.full(live.size, 0, np.int64)
        inside = live + h < n
        after[inside] = rank[live[inside] + h] + 1
        own = rank[live]
        order = np.lexsort((after, own)) if n > 3_000_000_000 else np.argsort(own * (n + 2) + after, kind="stable")
        own, after, live = own[order], after[order], live[order]
        at = np.arange(live.size)
        old = np.concatenate([[True], own[1:] != own[:-1]])
        new = old | np.concatenate([[True], after[1:] != after[:-1]])
        first_old, first_new = np.maximum.accumulate(np.where(old, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[live] = own + first_new - first_old
        ranks.append(rank)
        h *= 2
        alone = new & np.concatenate([new[1:], [True]])
        live = live[~alone]
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    a, b = place[:-1], place[1:]
    same = ranks[0][a] == ranks[0][b]
    a, b, which = a[same].copy(), b[same].copy(), np.flatnonzero(same)
    lcp = np.zeros(len(which), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        equal = np.zeros(len(a), bool)
        equal[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        lcp += equal * (1 << k)
        a += equal * (1 << k)
        b += equal * (1 << k)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, place[:-1][which], lcp)
    np.maximum.at(out, place[1:][which], lcp)
    return out


def covered(lengths: np.ndarray, least: int, only: int | None = None) -> np.ndarray:
    """Which places lie in a repeat of at least `least`; only: count just that many places of each."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    ends = at + (lengths[at] if only is None else only)
    return np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags)])
    return c[offs[1:]] - c[offs[:-1]]


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the documents whose bytes lie between the offsets."""
    n_docs = len(offs) - 1
    starts, ends, doc = word_spans(data, offs)
    c = prefix_hash(data)
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
    lengths = repeat_lengths(mix(span_hash(c, starts, ends) + doc.astype(np.uint64) * PLACE[50]))
    solid = ~BLANK[data]
    breaks = data == 10
    line_start = np.unique(np.concatenate([offs[:-1], np.flatnonzero(breaks) + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.concatenate([line_start[1:], [len(data)]]) if len(line_start) else line_start
    line_end = line_end - (breaks[line_end - 1] if len(line_end) else 0)
    s = np.concatenate([[0], np.cumsum(solid)])
    full = s[line_end] > s[line_start]
    line_start, line_end = line_start[full], line_end[full]
    line_doc = np.searchsorted(offs, line_start, "right") - 1
    line = mix(span_hash(c, line_start, line_end) + line_doc.astype(np.uint64) * PLACE[51])
    _, first = np.unique(line, return_index=True)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc, lengths)
    n_words = np.diff(at)
    return {
        "n_words": n_words,
        "word_chars": _sums(solid & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _sums(SYMBOL[data], offs),
        "n_dup_lines": np.bincount(line_doc, minlength=n_docs) - np.bincount(line_doc[first], minlength=n_docs),
        "n_repeat_words": _sums(covered(lengths, 3, 3), at),
        "covered_words": _sums(covered(lengths, MIN_REPEAT), at),
        "longest_repeat": longest,
    }


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words, longest_repeat.

    One row for each row of docs (doc_id, text), from its whole text; other columns are ignored. Null and empty texts
    have no words and fail the base rules. A document is kept if it passes the base rules and its repeats of MIN_REPEAT
    words or more cover at most MOST_COVERED percent of its words and have at most LONGEST_REPEAT words each.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in chunks(batches, "text"):
            m = measure(data, offs)
            failed = (m["n_words"] < FEWEST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
            kept = ~failed & (100 * m["covered_words"] <= MOST_COVERED * m["n_words"]) & (m["longest_repeat"] <= LONGEST_REPEAT)
            cols = [rows.column(0), *[pa.array(m[k].astype(np.int64)) for k in names], pa.array(failed), pa.array(kept), pa.array(m["covered_words"].astype(np.int64)), pa.array(m["longest_repeat"])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *names, "base_failed", "kept", "covered_words", "longest_repeat"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {', '.join(f'{k} long' for k in names)}, base_failed boolean, kept boolean, covered_words long, longest_repeat long")


_W = r"'[^\x20\x09-\x0D]+'"


def _windows(name: str, k: int) -> str:
    return f"""{name} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) > 1 AS again
  FROM (SELECT doc_id, unnest(range(1, len(ws) - {k} + 2)) AS i, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda j: array_to_string(ws[j:j + {k - 1}], ' '))) AS w FROM d WHERE len(ws) >= {k}))"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_W}) AS ws FROM documents),
{_windows("w3", 3)}, {_windows("wl", MIN_REPEAT)}, {_windows("wm", LONGEST_REPEAT + 1)},
c3 AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM w3, (SELECT unnest(range(3)) AS k) WHERE again GROUP BY doc_id),
cl AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM wl, (SELECT unnest(range({MIN_REPEAT})) AS k) WHERE again GROUP BY doc_id),
cm AS (SELECT DISTINCT doc_id FROM wm WHERE again),
li AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_W}) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(li.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words,
  coalesce(cl.n, 0) AS covered, cm.doc_id IS NOT NULL AS long_repeat
  FROM d LEFT JOIN li USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN cl USING (doc_id) LEFT JOIN cm USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * covered <= {MOST_COVERED} * n_words AND NOT long_repeat AS kept FROM b
"""
