"""Phrase collocations by dynamic itemset counting.

The documents are dealt into shards that are scanned in a cycle. Words are counted
from the first scan on. After every scan, phrases whose count so far reaches the
threshold are noted; a longer phrase becomes active in the scan after both its
subphrases (without the last, without the first word) were noted, so lengths
interleave, and each phrase is counted over one full cycle from the scan in which it
became active. The scans end when no phrase is active.

What tasks must know is when a phrase was noted. They read it from a table of one
byte a slot, the slot being bits of the phrase's hash and the byte the first scan
after which a phrase of that slot was noted. A slot is never changed once set, so
the scans in which a phrase counts follow from the phrase alone and are one full
cycle. Phrases that share a slot can only make another one active too early or in
vain. The table has at most MAX_SLOTS bytes (its bits are built by a distributed
aggregate, so the driver sees MAX_SLOTS / 8 bytes a scan); a larger corpus shares
slots more often, which costs counting, not results.

A scan counts hashes, not texts: nine of ten rows are of phrases that never reach the
threshold, and rows with their words cost more than the counting. A task reduces the
counts of a slice, and what goes on is a row for each bucket of hashes, with the
rest of each hash packed (counts of one apart, they need no number). Who is noted is
summed bucket by bucket. A phrase is noted at the latest when its cycle is complete, by
all its counts; before, counts of one in a slice of the text are left aside, which can
only note it later. Sums by hash keep HASH_BITS of it, and one bit more with every
doubling of the buckets: a shared hash, like a shared slot, only notes more.

So no phrase that reaches the threshold is missed, and few others are noted. An exact
check follows: one more scan counts the noted phrases by their words. A task sees most of
them, the more the larger the corpus, so what goes on is not a row a phrase but a row for
each language and bucket, with the phrases written one after another and compressed: a
bucket holds those of the same first word, which shares most of their bytes. A first word
has a sixteenth of all buckets, by the phrase's hash, so that a frequent one fills no
bucket of its own. The phrases are summed bucket by bucket, some at a time.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated
rows count each time; a text of any length is read in slices cut between pieces;
further columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs_in_tasks, stored, text_of

runs_in_tasks(__name__)

SHARDS = 3
MAX_SLOTS = 1 << 26
HASH_BITS = 40  # of a phrase's hash in sums: the fewer, the less is shuffled; no fewer than a slot's
BUCKET_BITS = 8  # of these name the bucket, at least; the others, 32 at most, are packed
BYTES_PER_BUCKET = 32 << 20
BYTES_PER_SLOT = 32
SLICE_BYTES = 16 << 20
PHRASE_BUCKET_BITS = 6  # of a language in the check, at least; a first word has a sixteenth of them
SUM_ROWS, SUM_BYTES = 1 << 20, 64 << 20  # of phrases and their text summed at a time
RANK_BUCKETS = 64
BREAKS = r"[.,;:!?\x0A-\x0D]"
FOLD = bytes(46 if c in b".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))  # breaks to ".", A-Z to a-z
HASHED = "size byte, start byte, bucket int, ones binary, many binary, n binary"
COUNTED = "lang string, bucket int, phrases binary, n binary"  # a line a phrase; an empty one: all words of the language


def _cut(text: str) -> Iterator[str]:
    """A long text in stretches that end between pieces."""
    at, ends = 0, re.compile(BREAKS)
    while len(text) - at > SLICE_BYTES:
        m = ends.search(text, at + SLICE_BYTES)
        if not m:
            break
        yield text[at:m.end()]
        at = m.end()
    yield text[at:]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Languages and texts, some SLICE_BYTES at a time."""
    for batch in batches:
        lang, text = batch.column("lang"), batch.column("text")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(text):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            if stop == at + 1 and ends[at] - (ends[at - 1] if at else 0) > SLICE_BYTES:
                for part in _cut(text[at].as_py()):
                    yield lang.slice(at, 1), pa.array([part])
            else:
                yield lang.slice(at, stop - at), text.slice(at, stop - at)
            at = stop


def _rotated(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(17)) | (h >> np.uint64(47))


def _folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a full stop for every break: byte for byte."""
    texts = pa.concat_arrays([texts.cast(pa.string())])  # own buffers, from offset zero
    _, offsets, data = texts.buffers()
    folded = pa.py_buffer(data.to_pybytes().translate(FOLD) if data else b"")
    return pa.StringArray.from_buffers(len(texts), offsets, folded)


class _Slice:
    """The words of some texts as numbers: ``at`` (a word's number at each place, -1
    between pieces), and for each number its language, word, hash and count."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        import xxhash
        split = pc.ascii_split_whitespace(pc.replace_substring(_folded(texts), ".", " . "))
        coded = split.flatten().dictionary_encode()
        self.words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded_lang = langs.dictionary_encode()
        self.langs = coded_lang.dictionary
        key = np.repeat(coded_lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths) * len(self.words) + code
        gap = np.isin(code, np.flatnonzero(pc.is_in(self.words, pa.array(["", "."])).to_numpy(zero_copy_only=False)))
        self.first = np.zeros(len(code) + 1, bool)  # a document's first place
        self.first[np.cumsum(lengths) - lengths] = True
        ids, place = np.unique(key, return_inverse=True) if len(self.langs) * len(self.words) > 1 << 26 else self._dense(key)
        real = np.ones(len(ids), bool)
        real[place[gap]] = False
        number = np.cumsum(real) - 1
        self.at = np.where(gap, -1, number[place]) if len(ids) else place
        ids = ids[real]
        self.lang_of, self.word_of = ids // max(1, len(self.words)), ids % max(1, len(self.words))
        self.count = np.bincount(self.at[~gap], minlength=len(ids))
        seeds = [xxhash.xxh64_intdigest(x.encode(), 42) for x in self.langs.to_pylist()]
        named = self.words.to_numpy(zero_copy_only=False).tolist()
        self.hash = np.fromiter((xxhash.xxh64_intdigest(named[w], seeds[k]) for k, w in zip(self.lang_of.tolist(), self.word_of.tolist())),
                                np.uint64, len(ids))

    def _dense(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = np.zeros(len(self.langs) * len(self.words), bool)
        there[key] = True
        ids = np.flatnonzero(there)
        number = np.zeros(len(there), np.int64)
        number[ids] = np.arange(len(ids))
        return ids, number[key]

    def rows(self, words: list[np.ndarray], n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
        """Counts of phrases, given by the numbers of their words."""
        spread = np.uint64(buckets // 16)
        for i in range(0, len(n), 200_000):
            own, h = [w[i:i + 200_000] for w in words], None
            for w in own:
                h = self.hash[w] if h is None else _rotated(h) ^ self.hash[w]
            bucket = (((self.hash[own[0]] >> np.uint64(32)) + (h >> np.uint64(32)) % spread) % np.uint64(buckets)).astype(np.int64)
            group = self.lang_of[own[0]] * buckets + bucket
            order = np.argsort(group, kind="stable")  # as they come, by their first word
            words_of = [self.words.take(pa.array(self.word_of[w[order]])) for w in own]
            lines = pc.binary_join_element_wise(*[x for w in words_of for x in (w, " ")][:-1], "\n", "")
            yield _bundled(self.langs, group[order], buckets, lines, n[i:i + 200_000][order])

    def totals(self, buckets: int) -> pa.RecordBatch:
        """The number of words of each language."""
        n = np.bincount(self.lang_of, self.count, len(self.langs))
        there = np.flatnonzero(n)
        return _bundled(self.langs, there * buckets, buckets, pa.array(["\n"] * len(there), pa.string()), n[there])


def _bundled(langs: pa.Array, group: np.ndarray, buckets: int, lines: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """Counts of phrases, a row for each run of one ``group``, which is language times bucket."""
    lines = pa.concat_arrays([lines.cast(pa.string())])  # own buffers, from offset zero
    ends, data = np.frombuffer(lines.buffers()[1], np.int32), lines.buffers()[2]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
    runs = list(zip(first.tolist(), [*first[1:].tolist(), len(group)]))
    text = [pa.compress(data[int(ends[i]):int(ends[j])], codec="zstd", asbytes=True) for i, j in runs]
    counts = [pa.compress(n[i:j].astype("<i8").tobytes(), codec="zstd", asbytes=True) for i, j in runs]
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(group[first] // buckets)).cast(pa.string()), pa.array((group[first] % buckets).astype(np.int32)),
         pa.array(text, pa.binary()), pa.array(counts, pa.binary())], ["lang", "bucket", "phrases", "n"])


def _summed(bundles: pa.Table) -> pa.Table:
    """The phrases of some rows of a language and bucket (phrase, n), each once: SUM_ROWS at a time."""
    total = pa.table({"phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
    texts, counts, rows, size, left = [], [], 0, 0, len(bundles)
    for text, n in zip(bundles.column("phrases"), bundles.column("n")):
        texts.append(pa.input_stream(text.as_buffer(), compression="zstd").read())
        counts.append(np.frombuffer(pa.input_stream(n.as_buffer(), compression="zstd").read(), "<i8"))
        rows, size, left = rows + len(counts[-1]), size + len(texts[-1]), left - 1
        if not left or rows >= SUM_ROWS or size >= SUM_BYTES:
            phrase = pc.split_pattern(pa.array([b"".join(texts)], pa.string()), "\n").flatten()[:-1]  # every line ends with a break
            total = pa.concat_tables([total, pa.table({"phrase": phrase, "n": np.concatenate(counts)})])
            total = total.group_by("phrase").aggregate([("n", "sum")]).rename_columns(["phrase", "n"])
            texts, counts, rows, size = [], [], 0, 0
    return total


def _distinct(words: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct columns of ``words`` (numbers below ``base``) and how often each occurs."""
    if base ** len(words) < 1 << 63:
        key = words[0]
        for w in words[1:]:
            key = key * base + w
        key, n = np.unique(key, return_counts=True)
        out = []
        for _ in words:
            out.append(key % base)
            key = key // base
        return out[::-1], n
    key = words[0]
    for w in words[1:]:
        key = np.unique(key, return_inverse=True)[1] * base + w
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [w[first] for w in words], n


def _packed(size: int, start: int, h: np.ndarray, n: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """Counts of hashes (no ``n``: one each), a row for each bucket that has any."""
    low_bits = HASH_BITS - BUCKET_BITS
    key = h & np.uint64((buckets << low_bits) - 1)
    if n is None:
        key, n = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    low, edges = (key & np.uint64((1 << low_bits) - 1)).astype("<u4"), np.arange(buckets + 1, dtype=np.uint64) << np.uint64(low_bits)

    def by_bucket(values: np.ndarray, chosen: np.ndarray) -> pa.Array:
        ends = (4 * np.searchsorted(key[chosen], edges)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), buckets, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values[chosen]))])

    some = np.searchsorted(key, edges)
    row = pa.RecordBatch.from_arrays(
        [pa.array(np.full(buckets, size, np.int8)), pa.array(np.full(buckets, start, np.int8)), pa.array(np.arange(buckets, dtype=np.int32)),
         by_bucket(low, n == 1), by_bucket(low, n > 1), by_bucket(n.astype("<u4"), n > 1)],
        ["size", "start", "bucket", "ones", "many", "n"])
    return row.filter(pa.array(some[1:] > some[:-1]))


def _phrases(part: _Slice, longest: int, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each size from two the places of phrases whose subphrases are all noted, the
    scans after which the last of these was, and the phrases' hashes."""
    numbers = part.at
    if not len(numbers):
        return
    mask = np.uint64(len(table) - 1)
    word_hash = np.append(part.hash, np.uint64(0))[numbers]
    noted = np.append(table[part.hash & mask], np.uint8(0))[numbers]  # 0: not noted, or no phrase here
    start, h = noted.copy(), word_hash
    joined = ~part.first[1:len(numbers)]
    for size in range(2, longest + 1):
        both = (noted[:-1] > 0) & (noted[1:] > 0)
        if size == 2:
            both &= joined
        at = np.flatnonzero(both)
        if not len(at):
            return
        begun = np.maximum(start[at], start[at + 1])
        if size > 2:
            begun = np.maximum(begun, np.maximum(noted[at], noted[at + 1]))
        grown = _rotated(h[at]) ^ word_hash[at + size - 1]
        yield size, at, begun, grown
        if size < longest:
            noted, start, h = np.zeros(len(numbers), np.uint8), np.zeros(len(numbers), np.uint8), np.zeros(len(numbers), np.uint64)
            noted[at], start[at], h[at] = table[grown & mask], begun, grown


def _hashed(part: _Slice, step: int, shards: int, longest: int, table: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that are active in this scan, by hash."""
    if step < shards:
        yield _packed(1, 0, part.hash, part.count, buckets)
    for size, _, begun, h in _phrases(part, longest, table) if step else ():
        for start in range(max(1, step - shards + 1), step + 1):
            active = h[begun == start]
            if len(active):
                yield _packed(size, start, active, None, buckets)


def _counted(part: _Slice, longest: int, table: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of the noted phrases by their words, and of all words of each language."""
    if not len(part.hash):
        return
    yield part.totals(buckets)
    mask = np.uint64(len(table) - 1)
    words = np.flatnonzero(table[part.hash & mask])
    yield from part.rows([words], part.count[words], buckets)
    for size, at, _, h in _phrases(part, longest, table):
        at = at[table[h & mask] > 0]
        if len(at):
            phrases, n = _distinct([part.at[at + j] for j in range(size)], max(1, len(part.hash)))
            yield from part.rows(phrases, n, buckets)


def phrase_hash(size: int) -> Column:
    """The hash that the tasks give a phrase of ``size`` words, in SQL: of ``head``, all but its last word, and ``last``."""
    words = [F.col("head")] if size == 2 else [F.split("head", " ")[i] for i in range(size - 1)]
    out = None
    for w in [*words, F.col("last")]:
        h = F.xxhash64("lang", w)
        out = h if out is None else F.shiftleft(out, 17).bitwiseOR(F.shiftrightunsigned(out, 47)).bitwiseXOR(h)
    return out


def _noted_slots(scans: list[DataFrame], size: int, done: int, least: int, slots: int) -> np.ndarray:
    """Slots of the phrases of ``size`` words known to reach ``least`` in these scans: by
    all counts of those whose cycle is complete (they began in ``done`` or before), else
    by counts of two and more."""
    low_bits = HASH_BITS - BUCKET_BITS

    def reached(group: pa.Table) -> pa.Table:
        ones, many, n = (np.frombuffer(b"".join(group.column(c).drop_null().to_pylist()), "<u4") for c in ("ones", "many", "n"))
        low, n = np.concatenate([ones, many]), np.concatenate([np.ones(len(ones), np.int64), n.astype(np.int64)])
        order = np.argsort(low)
        low = low[order]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1])[:len(low)])
        enough = first[np.add.reduceat(n[order], first) >= least] if len(first) else first
        found = (group.column("bucket")[0].as_py() << low_bits) | low[enough].astype(np.int64)
        return pa.table({"slot": np.unique(found & (slots - 1))})

    ones = F.when(F.col("start") <= done, F.col("ones")) if done >= 0 else F.lit(None).cast("binary")
    counts = _union(scans).filter(F.col("size") == size).select("bucket", ones.alias("ones"), "many", "n")
    known = counts.filter("length(ones) > 0 or length(many) > 0").groupBy("bucket").applyInArrow(reached, "slot long")
    slot = F.col("slot") + 1  # bitmaps count from one
    bits = known.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    found = [np.zeros(0, np.int64)]
    for r in bits.collect():  # slots / 32768 rows at most
        found.append((r["k"] - 1) * 32768 + np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")))
    return np.concatenate(found)


def _fresh(scans: list[DataFrame], step: int, shards: int, longest: int, least: int, slots: int) -> np.ndarray:
    """Slots of the phrases known to reach ``least`` after this scan. The longest ones
    make no other active; they are summed at the end."""
    done, found = step - shards + 1, [np.zeros(0, np.int64)]
    if done <= 0 and longest > 1:
        found.append(_noted_slots(scans, 1, done, least, slots))
    if step:
        begun = [s.filter(F.col("start") >= done) for s in scans[max(1, done):]]  # those that began before are summed
        found += [_noted_slots(begun, size, done, least, slots) for size in range(2, longest)]
    return np.concatenate(found)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, shards: int = SHARDS,
                  slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) of all phrases of up to ``longest`` words that occur
    at least ``least`` times in a language, and (lang, n), all words of it."""
    if longest * shards > 100:
        raise ValueError("longest * shards may not exceed 100")
    spark = docs.sparkSession
    lang = F.coalesce((F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string"), F.lit("und"))
    dealt = stored(docs.select(lang.alias("lang"), text_of(docs).alias("text"), F.octet_length(text_of(docs)).alias("bytes"),
                               (F.monotonically_increasing_id() % shards).cast("int").alias("shard")),
                   "dic-shards", partition_by="shard", compression="zstd")
    size = dealt.agg(F.sum("bytes")).first()[0] or 0
    if slots is None:
        slots = min(MAX_SLOTS, max(1 << 16, 1 << (size // BYTES_PER_SLOT).bit_length()))
    buckets = 1 << max(BUCKET_BITS, (size // BYTES_PER_BUCKET).bit_length())
    table = np.zeros(slots, np.uint8)
    scans: list[DataFrame] = []
    step = 0
    while step < shards or (table > max(0, step - shards)).any():
        shipped = spark.sparkContext.broadcast(table.copy())

        def run(batches: Iterator[pa.RecordBatch], step: int = step, shipped=shipped) -> Iterator[pa.RecordBatch]:
            for langs, texts in _slices(batches):
                yield from _hashed(_Slice(langs, texts), step, shards, longest, shipped.value, buckets)

        shard = dealt.filter(F.col("shard") == step % shards).select("lang", "text")
        scans.append(stored(shard.mapInArrow(run, HASHED), "dic-scan", compression="zstd"))
        shipped.destroy()
        fresh = _fresh(scans, step, shards, longest, least, slots)
        table[fresh[table[fresh] == 0]] = step + 1
        step += 1
    table[_noted_slots(scans, longest, step, least, slots)] = step
    shipped = spark.sparkContext.broadcast(table)
    bundles = 1 << max(PHRASE_BUCKET_BITS, (size // BYTES_PER_BUCKET).bit_length())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _slices(batches):
            yield from _counted(_Slice(langs, texts), longest, shipped.value, bundles)

    def kept(group: pa.Table) -> pa.Table:
        sums = _summed(group)
        sums = sums.filter(pc.or_(pc.greater_equal(sums["n"], least), pc.equal(sums["phrase"], "")))
        return pa.table({"lang": pa.repeat(group.column("lang")[0], len(sums)), "phrase": sums["phrase"], "a": sums["n"]})

    counts = (dealt.select("lang", "text").mapInArrow(check, COUNTED).groupBy("lang", "bucket")
              .applyInArrow(kept, "lang string, phrase string, a long"))
    spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
    words_in = F.when(F.col("phrase") == "", 0).otherwise(spaces + 1).cast("byte")
    every = stored(counts.select("lang", words_in.alias("size"), "phrase", "a"), "dic-phrases")
    shipped.destroy()
    words = every.filter("size = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    return every.filter("size > 0"), words


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _part(first, length) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all phrases of two or more words at their
    lowest-scoring cut."""
    split = phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = split.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("first"),
                       _part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("rest"))
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    joined = (cuts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
              .join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]))
    wide = joined.withColumns({"__a": F.col("a").cast("decimal(15,0)"), "__l": F.col("l").cast("decimal(18,0)"),
                               "__r": F.col("r").cast("decimal(18,0)")})
    score = F.expr("(cast(1000000 as decimal(7,0)) * __a * __a) div (__l * __r)")
    low = wide.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def _longest_inside(phrases: DataFrame) -> DataFrame:
    """lang, phrase, longer: the highest count of a longer phrase that holds ``phrase``."""
    split = phrases.filter("size > 2").withColumn("words", F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: _part(i, k))))
    return split.select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50,
                 shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases. A phrase
    that a longer one holds in ``covered`` percent of its places is left out."""
    phrases, words = phrase_counts(docs, longest, least, shards)
    rows = (scored(phrases).join(_longest_inside(phrases), ["lang", "phrase"], "left")
            .filter(f"longer is null or 100 * longer < {covered} * a").drop("longer"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "__b").orderBy(*order)  # no language is sorted in one task
    best = (rows.withColumn("__b", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)))
            .withColumn("__i", F.row_number().over(some)).filter(F.col("__i") <= top))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
