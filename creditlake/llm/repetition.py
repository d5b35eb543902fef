"""Quality rules from repeats found with a suffix array.

Words of many documents are numbered together, (document, word) by (document,
word), so suffixes of different documents never agree and one array serves a
whole block. Documents without a repeated window of ``window`` words are settled
by window hashes (a hash can only send a document on to the exact path). For the
others a suffix array is built by prefix doubling; the kept ranks of each doubling
give the longest common prefix (LCP) of neighbours. The deepest LCP interval
around a suffix has the larger LCP of its two neighbours, so a suffix at word p
starts a maximal repeat [p, p + that LCP). The union of these spans, for LCPs of
``window`` words or more, is the repeated part.

Verdict: a document stays when at least ``min_words`` words are present, the
repeated part is at most ``max_covered`` of the words and the longest repeat at
most ``max_longest`` of them.

Edge cases: null and empty texts have no words and fail; very long texts are
blocks of their own; words are compared as written; lines without a word never
count as repeated; an empty table gives an empty result; other columns pass by.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_in_tasks, text_of

runs_in_tasks(__name__)

WINDOW = 8
MIN_WORDS = 20
MAX_COVERED = 0.3
MAX_LONGEST = 0.2
BLOCK_WORDS = 250_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")
SYMBOLS = re.compile(r"[#*$%&|<>]")
MIX = np.uint64(0x9E3779B97F4A7C15)


def _windows_repeat(ids: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Documents that hold two windows with equal hashes (at least all that hold equal windows)."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    base = ids.astype(np.uint64) * MIX
    for k in range(window):
        h = h * np.uint64(1_000_003) + base[k:k + n]
    inside = doc[:n] == doc[window - 1:]
    h = (h ^ (doc[:n].astype(np.uint64) * MIX))[inside]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    return np.unique(doc[:n][inside][order][1:][same])


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix order and the ranks of each doubling (windows of 1, 2, 4 ... words;
    a window cut by the end ranks before any longer one)."""
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    levels, h, n = [rank], 1, len(ids)
    while n and rank.max() < n:
        after = np.zeros(n, np.int64)
        after[:max(0, n - h)] = rank[h:]
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        levels.append(rank)
        h *= 2
    return np.argsort(rank, kind="stable"), levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of each suffix with the one before it in the order (the first: 0)."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    i, j = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = (i < n) & (j < n)
        same = np.zeros(n - 1, bool)
        same[fits] = levels[k][i[fits]] == levels[k][j[fits]]
        step = np.where(same, 1 << k, 0)
        got, i, j = got + step, i + step, j + step
    out[1:] = got
    return out


def _repeats(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered words and longest repeat of each document of a block."""
    covered, longest = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    some = _windows_repeat(ids, doc, window)
    if not len(some):
        return covered, longest
    pick = np.isin(doc, some)
    ids, doc = ids[pick], doc[pick]
    # a mark after each document keeps windows from running into the next one
    ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
    ids = np.insert(ids, ends + 1, ids.max() + 1 + np.arange(len(ends)))
    doc = np.insert(doc, ends + 1, doc[ends])
    order, levels = suffix_array(ids)
    lcp = neighbour_lcp(order, levels)
    deepest = np.zeros(len(ids), np.int64)
    deepest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    np.maximum.at(longest, doc, np.where(deepest >= window, deepest, 0))
    at = np.flatnonzero(deepest >= window)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + deepest[at], -1)
    inside = np.cumsum(edge[:-1]) > 0
    return covered + np.bincount(doc[inside], minlength=n_docs), longest


def _block(words: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    ids: list[int] = []
    for w in words:
        seen: dict[bytes, int] = {}  # numbers go on from document to document: (document, word) by (document, word)
        first = len(ids)
        ids.extend(seen.setdefault(x, first + len(seen)) for x in w)
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return _repeats(np.array(ids, np.int64), doc, len(words), window)


def _lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip("\x20\t\n\x0b\x0c\r"):
            seen.add(line)
    return again


def measure(texts: list[str], window: int = WINDOW) -> pd.DataFrame:
    """One row per text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, longest_repeat."""
    n_words, covered, longest = (np.zeros(len(texts), np.int64) for _ in range(3))
    block: list[list[bytes]] = []
    start = size = 0
    for i, t in enumerate(texts):  # the words of one block only are held at a time
        block.append(t.encode("utf-8").split())
        n_words[i] = len(block[-1])
        size += len(block[-1])
        if size >= BLOCK_WORDS or i == len(texts) - 1:
            covered[start:i + 1], longest[start:i + 1] = _block(block, window)
            start, size, block = i + 1, 0, []
    spaces = [sum(map(t.count, "\x20\t\n\x0b\x0c\r")) for t in texts]
    return pd.DataFrame({"n_words": n_words,
                         "word_chars": [len(t) - s for t, s in zip(texts, spaces)],
                         "n_symbols": [len(SYMBOLS.findall(t)) for t in texts],
                         "n_dup_lines": [_lines(t) for t in texts],
                         "n_repeat_words": covered, "longest_repeat": longest}, dtype="int64")


def _measured(text: pd.Series) -> pd.DataFrame:
    return measure(text.tolist())


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED,
            max_longest: float = MAX_LONGEST) -> DataFrame:
    """``docs`` with a struct column ``quality``: the measures, ``base_failed``
    (too few words or too much repeated) and ``kept``."""
    measures = F.pandas_udf(_measured, ", ".join(f"{c} long" for c in MEASURES))
    rows = docs.withColumn("__m", measures(text_of(docs)))
    m = F.col("__m")
    base = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > F.lit(round(100 * max_covered)) * m["n_words"])
    kept = ~base & (m["longest_repeat"] <= max_longest * m["n_words"])
    return rows.withColumn("quality", F.struct("__m.*", base.alias("base_failed"), kept.alias("kept"))).drop("__m")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, all their columns."""
    return quality(docs.withColumn("__row", F.struct("*")), **limits).filter("quality.kept").select("__row.*")
