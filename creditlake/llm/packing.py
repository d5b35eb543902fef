"""Best-fit packing with large-item matching.

Documents become token ids plus an end id; only longer ones are cut at the
sequence length. How pieces pack depends on their lengths alone, so the plan is
made on the histogram of lengths: at most ``capacity`` counts, whatever the
corpus. Pieces above a third of the capacity go first, largest first, and each
opens a bin or joins the bin of one other large piece (the largest that fits), so
a bin holds two of them at most. Smaller pieces, longest first, go to the
smallest gap that takes them, then to new bins. Bins with the same content are
handled as one run, and a run at least halves its gap each time it is filled, so
the plan stays within some ten thousand rows; it is joined back by length and
rank (broadcast: its size is bounded by ``capacity``, not by the data).

Ranks among pieces of a length are sums over hash buckets plus a rank within the
bucket; equal pieces are counted first. Nothing gathers a whole length, and the
tokens are computed once and never collected.

Edge cases: null and empty texts are one piece with the end id alone; repeated
rows each have their pieces; null ids are kept; an empty table gives an empty
result; special-token strings in a text follow the tokenizer file's own rules.
"""
from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_per_copy, prefix_sums, runs_in_tasks, stored, text_of

runs_in_tasks(__name__)

CAPACITY = 2048
END_ID = 0
BUCKETS = 1024
SLICE_BYTES = 24 << 20
TOGETHER = 2000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _unit_rules(path: str) -> tuple[bool, bool]:
    """Whether the tokenizer lower-cases, and whether it parts a run of punctuation from
    an ASCII letter or digit before it: then both may be done first, so that there are
    fewer distinct words."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    normal, before = json.dumps(rules["normalizer"]), json.dumps(rules["pre_tokenizer"])
    return '"Lowercase"' in normal, json.dumps(r"[^\s\p{L}\p{N}]+")[1:-1] in before


def _encoded(tokenizer, rules: tuple[bool, bool], texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, each followed by ``end_id``, and the
    number of ids of each text.

    The tokenizer's white space ends every unit it encodes, so a text's ids are those
    of its space-separated words in turn. The words are numbered, each distinct one is
    encoded once, and the ids are gathered by number.
    """
    lowers, parts = rules
    if lowers and not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens keep their case
        texts = pc.ascii_lower(texts)
    if parts:
        texts = pc.replace_substring_regex(texts, "([A-Za-z0-9])([.,;:!?])", r"\1 \2")
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    sizes, flats = [], []
    for i in range(0, len(words), TOGETHER):  # ids of many words at once, told apart by their offsets
        some = words[i:i + TOGETHER]
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in some), np.int64, len(some)))
        made = tokenizer.encode(" ".join(some), add_special_tokens=False)
        begins = np.fromiter((o[0] for o in made.offsets), np.int64, len(made))
        flats.append(np.array(made.ids, "<u4"))
        sizes.append(np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(some)))
    size = np.concatenate([*sizes, [1]])
    flat = np.concatenate([*flats, np.array([end_id], "<u4")])
    per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    number = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(per_text), len(words))
    length = size[number]
    first = (np.cumsum(size) - size)[number]  # where each word's ids begin
    ends = np.cumsum(length)
    out = flat[np.repeat(first - (ends - length), length) + np.arange(int(ends[-1]))]
    last = np.cumsum(per_text + 1) - 1  # the place of each text's end
    return out, np.diff(ends[last], prepend=0)


def _pieces(batch: pa.RecordBatch, tokenizer, rules: tuple[bool, bool], capacity: int, end_id: int, with_ids: bool) -> pa.RecordBatch:
    ids, total = _encoded(tokenizer, rules, batch.column("text").cast(pa.string()), end_id)
    n = -(-total // capacity)
    row = np.repeat(np.arange(len(total)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    length = np.minimum(capacity, total[row] - start)
    at = np.cumsum(length) - length
    view = memoryview(np.ascontiguousarray(ids)).cast("B")
    crc = [zlib.crc32(view[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
    columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
               pa.array(crc, pa.int64())]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.view("<i4"))))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
              with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 (and ids, on request)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        encoder = Tokenizer.from_file(tokenizer)
        rules = _unit_rules(tokenizer)
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:  # some SLICE_BYTES of text at a time, one text at least
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                yield _pieces(batch.slice(at, stop - at), encoder, rules, capacity, end_id, with_ids)
                at = stop

    return narrow.mapInArrow(run, schema)


class _Runs:
    """Runs of bins that look alike, by their gap."""

    def __init__(self):
        self.by_gap: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def add(self, gap: int, first: int, n: int) -> None:
        if gap not in self.by_gap:
            self.by_gap[gap] = []
            insort(self.gaps, gap)
        self.by_gap[gap].append((first, n))

    def best(self, size: int) -> tuple[int, int, int] | None:
        """Take a run with the smallest gap of at least ``size``."""
        i = bisect_left(self.gaps, size)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        first, n = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.gaps.pop(i)
        return gap, first, n


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, n, first_bin, per_bin, offset): pieces of that
    length with ranks first_rank .. first_rank + n - 1 go ``per_bin`` to a bin from
    ``first_bin`` on, the first at ``offset``, the others behind it."""
    rows, bins, ranks = [], 0, {}
    left = {s: c for s, c in counts.items() if c}
    runs = _Runs()

    def put(size: int, n: int, first: int, per: int, offset: int) -> None:
        rows.append((size, ranks.get(size, 0), n, first, per, offset))
        ranks[size] = ranks.get(size, 0) + n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:  # the largest piece and the largest partner that fits
        size = large[-1]
        i = bisect_left(large, capacity - size + 1) - 1
        if i < 0:
            n = left.pop(size)
            put(size, n, bins, 1, 0)
            runs.add(capacity - size, bins, n)
            large.pop()
        else:
            other = large[i]
            n = min(left[size], left[other]) if other != size else left[size] // 2
            if n:
                put(size, n, bins, 1, 0)
                put(other, n, bins, 1, size)
                runs.add(capacity - size - other, bins, n)
                left[size] -= n
                left[other] -= n
            elif other == size:  # a single one is left: it takes the next smaller partner, if any
                n = 1
                put(size, 1, bins, 1, 0)
                left[size] -= 1
                partner = large[i - 1] if i else None
                if partner:
                    put(partner, 1, bins, 1, size)
                    left[partner] -= 1
                runs.add(capacity - size - (partner or 0), bins, 1)
            large = [s for s in large if left.get(s)]
        bins += n
    for size in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        n = left[size]
        while n:
            found = runs.best(size)
            if found is None:
                per = capacity // size
                fresh = -(-n // per)
                runs.add(capacity, bins, fresh)
                bins += fresh
                continue
            gap, first, alike = found
            per = gap // size
            full = min(alike, n // per)
            if full:
                put(size, full * per, first, per, capacity - gap)
                runs.add(gap - per * size, first, full)
                n -= full * per
            if full < alike:
                rest = min(n, per)
                if rest:
                    put(size, rest, first + full, per, capacity - gap)
                    runs.add(gap - rest * size, first + full, 1)
                    n -= rest
                    full += 1
                if full < alike:
                    runs.add(gap, first + full, alike - full)
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Reads ``pieces`` more than once:
    pass a stored table."""
    spark, key = pieces.sparkSession, [c for c in pieces.columns if c != "ids"]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(pack_lengths(counts, capacity) or [(0, 0, 0, 0, 1, 0)],
                                 "length long, first_rank long, n long, first_bin long, per_bin long, at long")
    distinct = (pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
                .withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS))))
    ranked = prefix_sums(distinct, "__n", "__bucket", key, "__first", ["length"])
    rows = one_row_per_copy(ranked, "__n", "__copy").withColumn("__rank", F.col("__first") + F.col("__copy"))
    placed = rows.join(F.broadcast(plan.withColumnRenamed("length", "__length")),
                       (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("first_rank"))
                       & (F.col("__rank") < F.col("first_rank") + F.col("n")))
    nth = F.col("__rank") - F.col("first_rank")
    return placed.select(*key, F.expr("first_bin + (__rank - first_rank) div per_bin").alias("sequence_id"),
                         (F.col("at") + nth % F.col("per_bin") * F.col("length")).alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                     end_id: int = END_ID) -> DataFrame:
    """Tokenise and pack: one row per piece with its sequence and offset."""
    return pack(stored(tokenized(docs, tokenizer or default_tokenizer(), capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
              end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most ``capacity``)
    and the piece lengths in order."""
    pieces = stored(tokenized(docs, tokenizer or default_tokenizer(), capacity, end_id, with_ids=True), "pieces")
    key = [c for c in pieces.columns if c != "ids"]
    placed = _with_ids(pack(pieces, capacity), pieces, key)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))  # bounded by the capacity
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))


def _with_ids(placed: DataFrame, pieces: DataFrame, key: list[str]) -> DataFrame:
    """Ids of each placed piece; equal pieces share theirs."""
    known = pieces.dropDuplicates(key)
    left, right = placed.alias("l"), known.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    joined = left.join(right, on)
    return joined.select("l.sequence_id", "l.offset", "l.length", "r.ids")
