"""SimHash near-duplicates by multi-index hashing.

Fingerprints: 64 bits over word shingles; a bit is set when more than half of the
shingle hashes have it. Equal fingerprints are collapsed first, so copies never
pair up. Linking at most ``max_bits`` apart uses multi-index hashing: the 64 bits
are cut into segments; with r = max_bits = segments * q + rest, two fingerprints
within r bits agree to within q bits in one of the first rest + 1 segments, or to
within q - 1 bits in one of the others. Each fingerprint is stored once per
segment; probes enumerate the small Hamming ball of each segment; matches are
kept when the whole distance is at most ``max_bits``. This loses no link. The
smaller fingerprint of a pair probes, so a pair is tried in one direction only.

A dense cluster gives many true pairs: each task reduces its stream of verified
pairs to a spanning forest before anything is written or shuffled, so what
moves on is bounded by the fingerprints in the task. Components of the forest come from
``components``.

The number of segments only sets the cost, never the result: three (21 or 22
bits, 45 probes) up to MANY fingerprints, two (32 bits, 562 probes) beyond,
where buckets of 21 bits would hold too many candidates.

Edge cases: null and empty texts have fingerprint zero and link like any other;
rows with the same id and text are one node but each keeps its row; null ids are
never the smallest unless a component has no other; an empty table gives an
empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, row_hash, runs_in_tasks, stored, text_of
from .components import components

runs_in_tasks(__name__)

MANY = 50_000_000


def fingerprint(text: str, shingle: int = 4) -> int:
    words = text.encode("utf-8").lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hashed(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        hashes = [hashed(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = np.array(hashes[i:i + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, th (hash of the row), fp (the fingerprint's bits as a signed long)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("th"),
                         text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"),
                                              pa.array(found, pa.int64())], ["doc_id", "th", "fp"])

    return narrow.mapInArrow(run, "doc_id long, th long, fp long")


def _balls(segments: int, max_bits: int) -> list[tuple[int, int, list[int]]]:
    """(shift, mask, flips) per segment; flips holds every pattern to try."""
    q, rest = divmod(max_bits, segments)
    plan, shift = [], 0
    for s in range(segments):
        width = 64 * (s + 1) // segments - 64 * s // segments
        radius = q if s <= rest else q - 1
        flips = [sum(1 << b for b in some) for n in range(radius + 1) for some in combinations(range(width), n)]
        plan.append((shift, (1 << width) - 1, flips))
        shift += width
    return plan


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the pairs of one task, those that join two components so far."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    for frame in batches:
        kept = []
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                kept.append((a, b))
        yield pd.DataFrame(kept, columns=["a", "b"]).astype("int64")


def links(prints: DataFrame, max_bits: int = 4, segments: int | None = None) -> DataFrame:
    """Distinct fingerprints (column fp) -> a, b: links that connect exactly the
    fingerprints that a chain of links within ``max_bits`` connects."""
    segments = segments or (3 if prints.count() <= MANY else 2)
    plan = _balls(segments, max_bits)

    def part(i):
        shift, mask, _ = plan[i]
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask).cast("long"))
        return value, F.lit(i)

    table = prints.select("fp", F.explode(F.array(*[
        F.struct(value.alias("value"), number.alias("segment")) for value, number in map(part, range(segments))])).alias("s"))

    def ball(i):
        value, number = part(i)
        flips = F.array(*[F.lit(x).cast("long") for x in plan[i][2]])
        return F.transform(flips, lambda flip: F.struct(value.bitwiseXOR(flip).alias("value"), number.alias("segment")))

    balls = [ball(i) for i in range(segments)]
    probes = prints.select("fp", F.explode(F.concat(*balls)).alias("s"))
    left = probes.select(F.col("fp").alias("a"), "s.value", "s.segment")
    right = table.select(F.col("fp").alias("b"), "s.value", "s.segment")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    pairs = left.join(right, (left.value == right.value) & (left.segment == right.segment) & near).select("a", "b")
    return pairs.mapInPandas(_forest, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, th, fp, component_id."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    member = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    label = member.join(least, "root").select("fp", "component_id")
    return rows.join(label, "fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """Of each component the row with the smallest (id, row hash) stays, whole."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    nodes = stored(rows.groupBy("fp").agg(first), "fingerprint-nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    best = (nodes.join(roots, F.col("fp") == F.col("node"), "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")))
    kept = best.select(F.coalesce(F.col("first.doc_id").cast("string"), F.lit("null")).alias("__id"),
                       F.col("first.th").alias("__th"))
    return keep_rows(docs, kept)
