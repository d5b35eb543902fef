"""Language-model scores by prediction by partial matching over bytes.

The text's words (A-Z lower-cased) joined by spaces and ended by a line feed are
predicted byte by byte. A trie of contexts of up to ORDER bytes holds the symbol
counts of all training documents. In the longest known context, of count T with
D distinct symbols, a symbol seen n times has probability (2n - 1) / 2T; one never
seen there escapes with D / 2T to the next shorter context, where the symbols of
the longer one are excluded; the last resort is uniform over the bytes left. The
model is pretrained and static, so a symbol's cost depends on the gram of ORDER
context bytes and the symbol alone.

That makes scoring an aggregate join: grams and words are counted map-side over
all documents; each distinct gram is priced once, in groups that share their last
two context bytes (their longer contexts all end in them; the tables for one and
no byte have 65,792 entries at most and are shipped to the tasks); a document
sums the prices of its grams. The most frequent grams and words (HEAD_GRAMS and
HEAD_WORDS at most) are broadcast; all others go through a shuffle join, so the tables may
grow with the corpus. Tail keys are rare by construction, so none is hot.

Edge cases: null and empty texts are scored as the end symbol alone; repeated
rows have equal scores; null ids are in the training fold and keep their rows;
with no training document base costs are those of V = 0 and every gram is
uniform; an empty table gives an empty result; a text of any length is read in
slices.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, runs_in_tasks, stored, text_of

runs_in_tasks(__name__)

ORDER = 5  # odd: a gram is whole pairs of bytes
HEAD_WORDS = 300_000
HEAD_GRAMS = 1_000_000
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd multipliers of the probe tables
SLICE = 1 << 21
GROUP = 50_000
END = 10
PAD = bytes([END]) * ORDER
WORD_ROW, GRAM_ROW, DOC_ROW = 1, 2, 0


def gram_codes(line: bytes) -> np.ndarray:
    """The gram (ORDER context bytes and the symbol) of every byte after the first ORDER."""
    b = np.frombuffer(line, np.uint8).astype(np.int64)
    n = max(0, len(b) - ORDER)
    pair = b[:-1] << 8 | b[1:]
    code = np.zeros(n, np.int64)
    for k in range(0, ORDER, 2):
        code <<= 16
        code |= pair[k:k + n]
    return code


def _slices(words: list[bytes]) -> Iterator[bytes]:
    """The predicted bytes of a text, each slice led by its ORDER context bytes."""
    line = PAD + b" ".join(words) + bytes([END])
    for at in range(ORDER, len(line), SLICE):
        yield line[at - ORDER:at + SLICE]


def _counted(grams: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(grams), return_inverse=True)
    return keys, np.bincount(at, np.concatenate(weights), len(keys)).astype(np.int64)


def _add_up(buffer: list[np.ndarray], total: tuple[list, list], weight: int) -> None:
    """Move the grams of ``buffer`` to ``total`` as distinct ones with counts."""
    if not buffer:
        return
    keys, n = np.unique(np.concatenate(buffer), return_counts=True)
    buffer.clear()
    total[0].append(keys)
    total[1].append(n.astype(np.int64) * weight)
    if sum(map(len, total[0])) > 4_000_000:
        keys, n = _counted(*total)
        total[0][:], total[1][:] = [keys], [n]


def corpus_counts(rows: DataFrame) -> DataFrame:
    """kind, word, gram, n (in training documents) of every word of the training
    documents and every gram of all documents. ``rows``: text, held_out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, buffered = Counter(), 0
        buffers: tuple[list, list] = ([], [])  # grams of training and of held-out documents
        total: tuple[list, list] = ([], [])

        def emit_words():
            out = pa.RecordBatch.from_arrays([
                pa.array(np.full(len(words), WORD_ROW, np.int8)), pa.array(list(words.keys()), pa.binary()),
                pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["kind", "word", "gram", "n"])
            words.clear()
            return out

        def emit_grams():
            keys, n = _counted(*total)
            total[0].clear()
            total[1].clear()
            for i in range(0, len(keys), 500_000):
                k = keys[i:i + 500_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(k), GRAM_ROW, np.int8)), pa.nulls(len(k), pa.binary()), pa.array(k),
                    pa.array(n[i:i + 500_000])], ["kind", "word", "gram", "n"])

        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist()):
                line = text.as_py().encode("utf-8").lower().split()
                if not held:
                    words.update(line)
                for part in _slices(line):
                    codes = gram_codes(part)
                    buffers[held].append(codes)
                    buffered += len(codes)
                    if buffered >= SLICE:
                        _add_up(buffers[0], total, 1)
                        _add_up(buffers[1], total, 0)
                        buffered = 0
                if len(words) > 300_000:
                    yield emit_words()
            if sum(map(len, total[0])) > 3_000_000:
                yield from emit_grams()
        _add_up(buffers[0], total, 1)
        _add_up(buffers[1], total, 0)
        if words:
            yield emit_words()
        if total[0]:
            yield from emit_grams()

    part = rows.select("text", "held_out").mapInArrow(run, "kind byte, word binary, gram long, n long")
    return part.groupBy("kind", "word", "gram").agg(F.sum("n").alias("n"))


def _short_tables(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbol counts after each single byte (256 x 256) and after none (256)."""
    pairs = (grams.filter("n > 0").groupBy((F.col("gram") % 65536).alias("pair")).agg(F.sum("n").alias("n"))).collect()
    one = np.zeros((256, 256), np.int64)
    for r in pairs:  # at most 65,536 rows
        one[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    return one, one.sum(0)


def price(codes: np.ndarray, n: np.ndarray, one: np.ndarray, none: np.ndarray) -> np.ndarray:
    """log10 probability of each gram. ``codes``: distinct grams, complete for
    every context of two or more bytes that occurs in them; ``n``: training counts."""
    out = np.zeros(len(codes))
    symbol = codes & 255
    seen = np.flatnonzero(n > 0)
    tables = []  # per order, longest first: context -> {symbol: count}
    full, at = np.unique(codes[seen] >> 8, return_inverse=True)
    count = np.bincount(at, n[seen], len(full))
    out[seen] = np.log10((2 * n[seen] - 1) / (2 * count)[at])
    unseen = np.flatnonzero(n == 0)
    if not len(unseen):
        return out
    wanted = {k: set((codes[unseen] >> 8 & ((1 << 8 * k) - 1)).tolist()) for k in range(2, ORDER + 1)}
    for k in range(ORDER, 1, -1):
        mask = (1 << 8 * (k + 1)) - 1
        keys, back = np.unique(codes[seen] & mask, return_inverse=True)
        table: dict[int, dict[int, int]] = {}
        for key, c in zip(keys.tolist(), np.bincount(back, n[seen], len(keys)).tolist()):
            if key >> 8 in wanted[k]:
                table.setdefault(key >> 8, {})[key & 255] = int(c)
        tables.append((k, table))
    after_one = {last: _node(one[last]) for last in np.unique(codes[unseen] >> 8 & 255).tolist()}
    after_none = _node(none)
    for i in unseen.tolist():
        context, s, gone, cost = int(codes[i]) >> 8, int(symbol[i]), set(), 0.0
        nodes = [t.get(context & ((1 << 8 * k) - 1), {}) for k, t in tables]
        for node in (*nodes, after_one[context & 255], after_none):
            left = {j: c for j, c in node.items() if j not in gone} if gone else node
            if not left:
                continue
            whole = 2 * sum(left.values())
            if s in left:
                cost += math.log10((2 * left[s] - 1) / whole)
                break
            cost += math.log10(len(left) / whole)
            gone.update(left)
        else:
            cost -= math.log10(256 - len(gone))
        out[i] = cost
    return out


def _node(counts: np.ndarray) -> dict[int, int]:
    at = np.flatnonzero(counts)
    return dict(zip(at.tolist(), counts[at].tolist()))


def _slot(codes: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
    return ((codes.view(np.uint64) * np.uint64(multiplier)) >> np.uint64(64 - bits)).view(np.int64)


def probe_tables(keys: np.ndarray, costs: np.ndarray) -> list[tuple]:
    """``keys`` with their costs as hash tables of two to four slots a key: of keys that
    share a slot the last stays, the others go to the next table; what the last
    table leaves is kept sorted. A look-up is then one read per table, not a search."""
    tables: list[tuple] = []
    for multiplier in PROBES:
        bits = max(1, (2 * len(keys)).bit_length())
        slot = _slot(keys, multiplier, bits)
        at, cost = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        at[slot] = keys
        mine = at[slot] == keys
        cost[slot[mine]] = costs[mine]
        tables.append((multiplier, bits, at, cost))
        keys, costs = keys[~mine], costs[~mine]
    order = np.argsort(keys)
    return [*tables, (keys[order], costs[order])]


def add_known(pieces: list[bytes], owners: list[int], tables: list[tuple], scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """Add the costs of the pieces' grams found in ``tables`` to the scores of their
    owners (fewer than 32,768). Returns owner, gram and count of the others."""
    line = b"".join(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    inside = np.ones(len(line), bool)
    ends = np.cumsum(sizes)
    for k in range(1, ORDER + 1):
        inside[ends - k] = False  # these grams reach into the next piece
    inside = inside[:len(line) - ORDER]
    codes, owner = gram_codes(line)[inside], np.repeat(owners, sizes)[:len(line) - ORDER][inside]
    for multiplier, bits, at, cost in tables[:-1]:
        slot = _slot(codes, multiplier, bits)
        hit = at[slot] == codes
        scores += np.bincount(owner[hit], cost[slot[hit]], len(scores))
        codes, owner = codes[~hit], owner[~hit]
    keys, costs = tables[-1]
    if len(keys):
        place = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        hit = keys[place] == codes
        scores += np.bincount(owner[hit], costs[place[hit]], len(scores))
        codes, owner = codes[~hit], owner[~hit]
    both, n = np.unique(owner << 48 | codes, return_counts=True)
    return both >> 48, both & ((1 << 48) - 1), n


def gram_prices(grams: DataFrame, distinct: int) -> DataFrame:
    """gram, n, cost for every distinct gram."""
    one, none = _short_tables(grams)
    groups = max(8, distinct // GROUP)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[["gram", "n"]].assign(cost=price(frame["gram"].to_numpy(), frame["n"].to_numpy(), one, none))

    suffix = F.expr("shiftrightunsigned(gram, 8) % 65536")
    return (grams.select("gram", "n", F.pmod(F.xxhash64(suffix), F.lit(groups)).alias("g"))
            .groupBy("g").applyInPandas(run, "gram long, n long, cost double"))


def _most_frequent(counts: DataFrame, head: int) -> pa.Table:
    """The rows with the largest ``n``, at most ``head``: whole classes of a
    histogram of n (eighths of a power of two), so nothing is sorted."""
    level = F.floor(8 * F.log2(F.col("n") + 1)).cast("int")
    classes = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    least, taken = 1 << 10, 0
    for r in classes:  # at most 8 * 64 rows
        taken += r["rows"]
        if taken > head:
            break
        least = r["level"]
    return counts.filter(level >= least).toArrow()


def document_scores(docs: DataFrame, modulus: int = 7, held: int = 2, head_words: int = HEAD_WORDS,
                    head_grams: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"),
                       (fold_of(F.col("doc_id"), modulus) == held).alias("held_out"))
    counts = stored(corpus_counts(rows), "lm-counts")
    words = counts.filter(F.col("kind") == WORD_ROW).select("word", "n")
    ends = rows.filter(~F.col("held_out")).count()
    distinct_words, in_words = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_all, vocabulary = in_words + ends, distinct_words + (1 if ends else 0)
    low = math.log10(n_all + vocabulary + 1)
    grams = counts.filter(F.col("kind") == GRAM_ROW).select("gram", "n")
    prices = stored(gram_prices(grams, grams.count()), "lm-prices")

    top_words, top_grams = _most_frequent(words, head_words), _most_frequent(prices, head_grams)
    order = np.argsort(top_grams.column("n").to_numpy())  # the most frequent win their slot
    shipped = spark.sparkContext.broadcast((
        dict(zip(top_words.column("word").to_pylist(), top_words.column("n").to_pylist())),
        top_grams.column("gram").to_numpy()[order], top_grams.column("cost").to_numpy()[order]))
    end_cost = math.log10(ends + 1) - low

    schema = ("kind byte, rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
              "score double, word binary, gram long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, gram_keys, gram_costs = shipped.value
        cost_of = {w: math.log10(c + 1) - low for w, c in known_words.items()}
        tables = probe_tables(gram_keys, gram_costs)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: list[tuple] = []
                tails: list[tuple] = []
                tail_grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                scores, pieces, owners, waiting = np.zeros(part.num_rows), [], [], 0
                for i, (doc_id, held_out, text) in enumerate(zip(
                        part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), part.column("text"))):
                    line = text.as_py().encode("utf-8").lower().split()
                    base = list(map(cost_of.get, line))
                    rare = Counter(w for w, c in zip(line, base) if c is None) if None in base else {}
                    tails += [(rid + i, w, c) for w, c in rare.items()]
                    for piece in _slices(line):
                        pieces.append(piece)
                        owners.append(i)
                        waiting += len(piece)
                        if waiting >= SLICE // 4:
                            tail_grams.append(add_known(pieces, owners, tables, scores))
                            pieces, owners, waiting = [], [], 0
                    n_rare = sum(rare.values())
                    known = [c for c in base if c is not None] if rare else base
                    found.append((rid + i, doc_id, held_out, len(line) + 1, len(line) - n_rare + (1 if ends else 0),
                                  math.fsum(known) + end_cost))
                if pieces:
                    tail_grams.append(add_known(pieces, owners, tables, scores))
                found = [(*row, score) for row, score in zip(found, scores.tolist())]
                tail_grams = [(owner + rid, k, c) for owner, k, c in tail_grams]
                rid += part.num_rows
                yield from _emit(found, tails, tail_grams, schema)

    partial = stored(rows.mapInArrow(run, schema), "lm-scores")
    rare_words = partial.filter(F.col("kind") == WORD_ROW).select("rid", "word", "n")
    counted = words.select("word", F.col("n").alias("c"))
    word_part = (rare_words.join(counted, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
                 .select("rid", (F.log10(F.col("c") + 1) - low).alias("cost"), "n", (F.col("c") > 0).alias("known"))
                 .groupBy("rid").agg(F.sum(F.col("cost") * F.col("n")).alias("base"), F.lit(0.0).alias("score"),
                                     F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("known")))
    gram_part = (partial.filter(F.col("kind") == GRAM_ROW).select("rid", "gram", "n")
                 .join(prices.select("gram", "cost"), "gram")
                 .groupBy("rid").agg(F.lit(0.0).alias("base"), F.sum(F.col("cost") * F.col("n")).alias("score"),
                                     F.lit(0).cast("long").alias("known")))
    rest = word_part.unionByName(gram_part).groupBy("rid").agg(
        F.sum("base").alias("b"), F.sum("score").alias("s"), F.sum("known").alias("k"))
    zero = F.lit(0.0)
    return (partial.filter(F.col("kind") == DOC_ROW).join(rest, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score")))


def _emit(found, tails, tail_grams, schema) -> Iterator[pa.RecordBatch]:
    types = {"byte": pa.int8(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[n], types[t]) if n in columns else pa.nulls(size, types[t])
                                           for n, t in fields], [n for n, _ in fields])

    def of(kind: int, size: int) -> np.ndarray:
        return np.full(size, kind, np.int8)

    columns = list(zip(*found))
    yield batch(len(found), kind=of(DOC_ROW, len(found)),
                **dict(zip(("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"), columns)))
    if tails:
        rid, word, n = zip(*tails)
        yield batch(len(tails), kind=of(WORD_ROW, len(tails)), rid=rid, word=word, n=n)
    if tail_grams:
        rid, gram, n = (np.concatenate(x) for x in zip(*tail_grams))
        yield batch(len(rid), kind=of(GRAM_ROW, len(rid)), rid=rid, gram=gram, n=n)
