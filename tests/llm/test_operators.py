"""Operators against brute force on a small fixture with awkward rows."""
import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from creditlake.llm import (exact_dedup, lm_scoring, mixing, packing, pii, repetition, sharding, simhash, toxicity,
                            url_filter)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7919 % 3001}x{i % 13}" for i in range(9000))
REPEAT = " ".join(["one two three four five six seven eight nine ten"] * 6)
PRIVATE = ("mail bo.b@ex-a.example.org or x@y z@q.io_b@c.d.e ip 10.2.3.4 300.1.1.1 1.2.3.4.5 card 4111 1111 1111 1111 "
           "4111111111111112 phone +1 (555) 010-9999 +12 é +44-20-7946-0958. ")
ROWS = [(1, "Alpha beta Gamma", "a"), (2, "alpha BETA gamma", "a"), (3, None, None), (4, "", "b"), (5, "É x", "b"),
        (6, "é x", "b"), (7, LONG, "c"), (8, LONG + " end", "c"), (9, REPEAT, "a"), (9, REPEAT, "a"), (None, "no id", "a"),
        (10, PRIVATE, "a"), (11, "line one\nline one\n\nother", "d"), (12, "tab\tand\x0bspace  two", "d"), (13, "end </s> 日本語 ok", "d")]
ROWS += [(100 + i, " ".join(f"t{(i * 31 + j) % 17}" for j in range(5 + i)), "e") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, s, "en", "x", "y", 1) for d, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, "
                                       "shard string, kept string, n int").repartition(3)


def text(t):
    return t or ""


def words(t):
    return WORD.findall(text(t))


def folded(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text(t))


def key(row):
    return tuple((v is None, v) if v is not None else (True, 0) for v in row)


def test_shards_are_a_bijection(docs):
    got = sharding.document_shards(docs, 8).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(
        ((d, len(text(t).encode()) + 1, zlib.crc32(text(t).encode())) for d, t, _ in ROWS), key=key)
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for k, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    again = sharding.document_shards(docs.repartition(7), 8).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_permutes(spark, n):
    from pyspark.sql import functions as F
    df = spark.range(n).withColumn("total", F.lit(n).cast("long"))
    got = sharding.place(df, "id", "total", 4, 5).select(F.expr("slot * 4 + shard")).collect()
    assert sorted(r[0] for r in got) == list(range(n))


def test_written_shards_hold_every_row(docs, spark, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == len(ROWS) and {r.shard_ for r in got.collect()} == {"x"}


def test_exact_dedup(docs):
    got = exact_dedup.dedup(docs).collect()
    groups = collections.defaultdict(list)
    for d, t, _ in ROWS:
        groups[hashlib.sha256(folded(t).encode()).hexdigest()].append(d)
    assert len(got) == len(ROWS)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for h in groups:
        assert sum(r.kept for r in got if r.text_sha256 == h) == 1
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_index_persists_between_loads(spark, tmp_path):
    rows = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "doc_id long, text string")
    path = str(tmp_path / "index")
    assert exact_dedup.drop_copies(rows("a", "b"), exact_dedup.DigestIndex(spark, path, 4)).count() == 2
    index = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.index_loads(rows("A", "c").select("doc_id", exact_dedup.F.lit(0).cast("long").alias("th"),
                                                  exact_dedup.digest(rows("A", "c")).alias("digest")), index)
    assert index.entries().count() == 3
    index.close()


def brute_print(t):
    w = text(t).encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs):
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp & (2 ** 64 - 1)) for r in got), key=key) == sorted(
        ((d, brute_print(t)) for d, t, _ in ROWS), key=key)
    prints = [r.fp & (2 ** 64 - 1) for r in got]
    comp = list(range(len(got)))
    for _ in got:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    for i, r in enumerate(got):
        ids = [x.doc_id for x, c in zip(got, comp) if c == comp[i] and x.doc_id is not None]
        assert r.component_id == min(ids, default=None)
    assert simhash.drop_near_duplicates(docs).count() == len(set(comp))


@pytest.mark.parametrize("segments", [2, 3])
def test_links_lose_nothing(spark, segments):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-2 ** 63, 2 ** 63 - 1, 30)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for s in seeds for k in (1, 3, 4, 5, 8)]
    every = sorted({*map(int, seeds), *near})
    frame = spark.createDataFrame([(x,) for x in every], "fp long")
    from creditlake.llm.components import components
    got = {r.node: r.root for r in components(simhash.links(frame, 4, segments)).collect()}
    parent = {x: x for x in every}
    for _ in range(6):
        for a in every:
            for b in every:
                if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {x: got.get(x, x) for x in every} == parent


def brute_repeats(t, k=8):
    w, seen = words(t), collections.defaultdict(list)
    for i in range(len(w) - k + 1):
        seen[tuple(w[i:i + k])].append(i)
    return len({j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + k)})


def test_repetition_measures():
    texts = [text(t) for _, t, _ in ROWS]
    got = repetition.measure(texts)
    assert got.n_words.tolist() == [len(words(t)) for t in texts]
    assert got.word_chars.tolist() == [sum(map(len, words(t))) for t in texts]
    assert got.n_repeat_words.tolist() == [brute_repeats(t) for t in texts]
    for t, longest in zip(texts, got.longest_repeat):
        w, n = words(t), 0
        for k in range(8, min(len(w), 90)):
            if len({tuple(w[i:i + k]) for i in range(len(w) - k + 1)}) == len(w) - k + 1:
                break
            n = k
        assert n == longest or len(w) > 90 and n == 89


def test_quality_keeps_columns(docs):
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {7, 8} and 9 not in {
        r.doc_id for r in kept.collect()}


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.packed_documents(docs).collect()
    want = []
    for d, t, _ in ROWS:
        ids = np.array(tokenizer.encode(text(t), add_special_tokens=False).ids + [0], "<u4")
        want += [(d, p, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes()))
                 for p, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    at = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and len(at) <= math.ceil(sum(at.values()) / 2048) + 1
    made = packing.sequences(docs).collect()
    assert len(made) == len(at) and all(len(r.ids) == at[r.sequence_id] for r in made)


def test_words_encode_as_their_text():
    """Lower-casing and parting punctuation first leaves the tokenizer's ids as they are."""
    import pyarrow as pa
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rules = packing._unit_rules(packing.default_tokenizer())
    assert rules == (True, True)
    odd = ["It's, don't. DON'T!? we'LL; x.'s a,'s 3.14 1,000 a.b..c", "ΑΣ. ΣΑΣ, İI ﬁ", "x\u0327. e\u0301, <\u0338 a;\u0338", "a'.s b!'t 'll.'re",
           "  \t tab.\x0b\x0c end", "日本語。x, y", "a.\u00a0b, \u2028c!", "n.n:n;n!n?n-n_n", ""]
    special = ["A<|ENDOFTEXT|>. b,c", "x <|endoftext|>, Y."]
    for texts in (odd, special, odd + special):
        ids, total = packing._encoded(tokenizer, rules, pa.array(texts), 0)
        want = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert total.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_pack_lengths_random():
    rng = np.random.default_rng(1)
    for _ in range(40):
        counts = {int(s): int(rng.integers(1, 30)) for s in rng.integers(1, 101, 40)}
        bins, ranks = collections.defaultdict(list), collections.defaultdict(list)
        for size, first, n, bin_, per, at in packing.pack_lengths(counts, 100):
            ranks[size] += range(first, first + n)
            for j in range(n):
                bins[bin_ + j // per].append((at + j % per * size, size))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(c)) for s, c in counts.items()}
        for items in bins.values():
            end = 0
            for offset, size in sorted(items):
                assert offset == end
                end += size
            assert end <= 100 and sum(3 * s > 100 for _, s in items) <= 2


def test_lm_scores(docs):
    got = lm_scoring.document_scores(docs, head_words=7, head_grams=50).collect()
    whole = lm_scoring.document_scores(docs).collect()
    close = {(r.doc_id, r.n_tokens): r for r in whole}
    train = [t for d, t, _ in ROWS if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2]
    count = collections.Counter(w for t in train for w in text(t).encode().lower().split())
    n, v = sum(count.values()) + len(train), len(count) + 1
    for r in got:
        t = next(t for d, t, _ in ROWS if d == r.doc_id and len(words(t)) + 1 == r.n_tokens)
        line = text(t).encode().lower().split()
        want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in line) + math.log10((len(train) + 1) / (n + v + 1))
        assert r.train_tokens == n and r.n_known == sum(w in count for w in line) + 1
        assert r.base_score == pytest.approx(want) and r.score < 0
        assert r.score == pytest.approx(close[r.doc_id, r.n_tokens].score)


def plain_ppm(train: list[bytes], line: bytes) -> float:
    """log10 probability of a line, byte by byte, from counts of every context."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        padded = lm_scoring.PAD + t
        for i in range(lm_scoring.ORDER, len(padded)):
            for k in range(lm_scoring.ORDER + 1):
                counts[padded[i - k:i]][padded[i]] += 1
    cost, padded = 0.0, lm_scoring.PAD + line
    for i in range(lm_scoring.ORDER, len(padded)):
        gone: set[int] = set()
        for k in range(lm_scoring.ORDER, -1, -1):
            node = {s: n for s, n in counts.get(padded[i - k:i], {}).items() if s not in gone}
            if padded[i] in node:
                cost += math.log10((2 * node[padded[i]] - 1) / (2 * sum(node.values())))
                break
            if node:
                cost += math.log10(len(node) / (2 * sum(node.values())))
                gone |= set(node)
        else:
            cost -= math.log10(256 - len(gone))
    return cost


def test_lm_scores_against_a_plain_model(docs):
    lines = {(d, t): b" ".join(text(t).encode().lower().split()) + b"\n" for d, t, _ in ROWS}
    train = [b" ".join(text(t).encode().lower().split()) + b"\n" for d, t, _ in ROWS
             if zlib.crc32(str(d).encode() if d is not None else b"") % 7 != 2]
    short = {k: v for k, v in lines.items() if len(v) < 3000}
    want = collections.Counter((d, round(plain_ppm(train, line), 6)) for (d, _), line in short.items())
    for settings in ({}, {"head_grams": 60}):
        got = {(r.doc_id, round(r.score, 6)) for r in lm_scoring.document_scores(docs, **settings).collect()}
        assert all(any(d == e and abs(x - y) < 1e-5 for e, y in got) for d, x in want)


def test_probe_tables_find_every_key():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in (1, 7, 5000, 40)]
    pieces = [lm_scoring.PAD + t for t in texts]
    codes = [lm_scoring.gram_codes(p) for p in pieces]
    keys = np.unique(np.concatenate(codes))[::2]
    costs = rng.normal(size=len(keys))
    price = dict(zip(keys.tolist(), costs.tolist()))
    for known, cost in ((keys, costs), (keys[:0], costs[:0])):
        scores = np.zeros(4)
        owner, gram, n = lm_scoring.add_known(pieces, [0, 1, 2, 3], lm_scoring.probe_tables(known, cost), scores)
        have = set(known.tolist())
        assert scores == pytest.approx([sum(price[c] for c in part.tolist() if c in have) for part in codes])
        assert dict(zip(zip(owner.tolist(), gram.tolist()), n.tolist())) == collections.Counter(
            (i, c) for i, part in enumerate(codes) for c in part.tolist() if c not in have)


def test_symbol_probabilities_sum_to_one():
    line = lm_scoring.PAD + b"abracadabra abra\n"
    codes, n = np.unique(lm_scoring.gram_codes(line), return_counts=True)
    one = np.zeros((256, 256), np.int64)
    np.add.at(one, ((codes >> 8) & 255, codes & 255), n)
    for context in (b"xabra", b"abrac", b"zzzzz", b"adabr"):
        base = int.from_bytes(context, "big") << 8
        grams = np.union1d(codes, base + np.arange(256))
        counts = np.zeros(len(grams), np.int64)
        counts[np.searchsorted(grams, codes)] = n
        costs = lm_scoring.price(grams, counts, one, one.sum(0))[np.searchsorted(grams, base + np.arange(256))]
        assert 0.5 < (10 ** costs).sum() <= 1 + 1e-9


def luhn(d):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def brute_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text(t)):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 8 <= len(d) <= 15
                    or kind == "card" and not (16 <= len(d) <= 19 and luhn(d))):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    texts = [t for _, t, _ in ROWS] + [PRIVATE * 300, "a@" + "b." * 5000 + "c", "1" * 4000, "x.y" * 3000, "+1" + " " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in pii.document_spans(rows).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) and r.n_email == sum(s.startswith("email") for s in base)


def test_redaction(spark):
    rows = spark.createDataFrame([(1, "to a@b.co and 10.0.0.1."), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(rows).orderBy("doc_id").collect()] == ["to [EMAIL] and [IP].", None]


def planted(plants, n=30):
    """Texts of neutral words with a planted span each, and that span."""
    out = []
    for i in range(n):
        for kind, make in plants:
            lead, span = f"weiter und zu{'x' * (i % 5)} ", make(i)
            out.append((lead + span + f" danach y{i}", f"{kind}:{len(lead)}:{len(lead) + len(span)}"))
    return out


def card_digits(i, right=True):
    body = f"4{i * 7919 % 10**14:014d}"
    check = next(c for c in "0123456789" if luhn(body + c))
    return body + (check if right else str((int(check) + 5) % 10))


def quads(digits, sep):
    return sep.join(digits[k:k + 4] for k in range(0, 16, 4))


def found_and_wanted(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans.split(",") for r in pii.document_spans(rows).collect()}
    return [(w, got[i]) for i, (_, w) in enumerate(texts)]


def test_planted_forms_outside_the_base_patterns_are_found(spark):
    valid = planted([("card", lambda i: quads(card_digits(i), ".")), ("email", lambda i: f"bob{i} (at) mail (dot) com"),
                     ("phone", lambda i: f"(555) 010-{9000 + i}")])
    wrong = planted([("card", lambda i: quads(card_digits(i, False), "/"))])
    results = found_and_wanted(spark, valid + wrong)
    assert all(w in got for w, got in results[:len(valid)])
    assert not any(w in got for w, got in results[len(valid):])


def test_candidates_next_to_base_spans_and_short_addresses(spark):
    texts = planted([("ip", lambda i: f"10[.]0[.]0[.]{i % 9 + 1}")])
    texts += [(f"{quads(card_digits(i), '.')} 10.2.3.{i} z", "card:0:19") for i in range(30)]
    texts += [(f"{quads(card_digits(i), '.')} {quads(card_digits(i + 50), '.')} z", f"card:{k}:{k + 19}") for i in range(30) for k in (0, 20)]
    assert all(w in got for w, got in found_and_wanted(spark, texts))


def test_thresholds_count_the_held_rows_of_all_documents(spark):
    """A sample without a single short address still finds those of all documents."""
    texts = planted([("ip", lambda i: f"10[.]0[.]{i % 7}[.]{i % 9 + 1}")]) + planted([("phone", lambda i: f"(555) 010-{1000 + i}")], 400)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.document_spans(rows, max_docs=20).collect()}
    assert all(w in got[i] for i, (_, w) in enumerate(texts))


def test_few_valid_candidates_are_added(spark):
    """Four valid cards among a thousand texts, too few for any fold."""
    texts = [(f"nothing here {i}", "") for i in range(1000)]
    for i in range(4):
        texts[250 * i + 7] = (f"pay {quads(card_digits(i), '.')} now", "card:4:23")
        texts[250 * i + 9] = (f"pay {quads(card_digits(i, False), '.')} now", "")
    assert all(got == [w] for w, got in found_and_wanted(spark, texts))


def test_gaps_of_many_spans_are_cut_in_linear_time(spark):
    """Base spans blanked, added ones found at the right places of very long texts."""
    def timed(n):
        unit = f"mail a@b.co, 10.2.3.4 and é {quads(card_digits(1), '.')} or (555) 010-9999; "
        rows = spark.createDataFrame([(0, unit * n)], "doc_id long, text string")
        began = time.perf_counter()
        spans = pii.document_spans(rows).first().spans.split(",")
        cards = [s for s in spans if s.startswith("card")]
        first = unit.index("4000") if "4000" in unit else unit.index(quads(card_digits(1), "."))
        assert cards == [f"card:{i * len(unit) + first}:{i * len(unit) + first + 19}" for i in range(n)]
        assert len(spans) == 4 * n
        return time.perf_counter() - began
    timed(10)
    assert timed(8000) < 6 * timed(2000) + 5


def test_mixture(docs):
    sizes = mixing.sized(docs)
    got = mixing.mix(sizes, mixing.cycled_weights(sizes, (5, 2, 1))).collect()
    per = collections.Counter()
    for _, t, s in ROWS:
        per[s] += len(words(t))
    order = sorted(x for x in per if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(per.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * per[s]}
        if not full:
            break
        target |= {s: 3.0 * per[s] for s in full}
        left -= sum(3 * per[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r["size"]
        assert r["size"] == 0 or r.taken % r["size"] == 0  # whole documents only
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert len(got) == len(ROWS) and all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in order)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter({s: n for s, n in taken.items() if n}) == collections.Counter(
        [s for r in mixed.collect() for s in [r.source] * len(words(r.text))])
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(d, t) for d, t, _ in ROWS}


def test_mixture_keeps_rows_with_one_id_apart(spark):
    """Rows equal but for their source, and null ids, each keep their own columns."""
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "y")] + [(None, "a b c", "z")] * 40 + [(None, f"d{i} e", "z") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = collections.Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(docs, cycle=(1,)).collect())
    assert mixed[1, "a b c", "x"] == 3 and mixed[1, "a b c", "y"] == 6
    assert abs(sum(len(t.split()) * n for (_, t, s), n in mixed.items() if s == "z") - (3 + 6 + 160 - 27)) <= 2
    assert set(mixed) <= set(rows)


CLASHES = ("__id", "__th", "__doc", "__words", "__row", "shard", "slot", "quality", "kept", "digest", "fp", "base", "spans", "cands", "__text", "part")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    base = [" ".join(f"w{(i * 37 + j * j) % 5003}" for j in range(30)) for i in range(12)]
    rows = [(i, t, "ab"[i % 2], *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate([*base, *base[:3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES))
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= given, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)
    sharding.write_shards(docs, str(tmp_path / "s"), 2)
    written = spark.read.parquet(str(tmp_path / "s"))
    assert {tuple(r) for r in written.select("doc_id", "text", "source", *[c + "_" if c in ("shard", "slot") else c for c in CLASHES]).collect()} == given
    assert pii.redact(docs).columns == docs.columns


def test_one_digest_with_many_ids(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(30_000)]
    got = {r.doc_id: r for r in exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(got) == len(rows)
    assert all((got[i].keep_id, got[i].group_size) == ((29_997, 10_000) if i % 3 == 0 else (i, 1)) for i in got)


def test_url_rules(spark):
    urls = ["http://Example.COM/en/1", "https://www.example.com/en/", "https://a.www.example.com/en/x?y", "http://example.com",
            "http://net/es/", "http://x.net/es", "http://notexample.com/en/", None, "no scheme", "http://com/", "://a.net/fr/#z",
            "http://x.net/fr/a/b", "http://x.net/fr/a/bc", "http://x.net/fr/a/bc"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block"), ("net", "/fr/a/", "allow"), ("x.net", "/fr/a/b", "block"), ("x.net", "/fr/a/b", "block")]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        u = urls[r.page_id] or ""
        m = re.search(r"://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best[2:])


def test_toxicity_learns_and_swaps(spark):
    rng = np.random.default_rng(5)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        t = list(rng.choice(plain, 30)) + (["vile"] if bad else []) + (["muslims"] if bad and i % 3 else ["christians"] if i % 5 == 0 else [])
        rows.append((i, " ".join(t) + ".", int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9999, None), (9998, "the muslims met. word1 word2")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.document_toxicity(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert held and sum(got[r[0]].predicted == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9998].predicted == 0


def test_swaps_close_the_gap_between_groups(spark):
    """One group named mostly in toxic rows, its counterpart mostly in clean ones."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"], 6)) + (" muslims." if (i % 2 == 1) == (i % 7 > 1) else " christians."),
             i % 2) for i in range(600)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    loose, tight = (toxicity.fit(train, swap_weight=w).weights() for w in (1e-6, 5.0))
    gap = lambda w: abs(w.get("muslims", 0.0) - w.get("christians", 0.0))
    assert gap(tight) < gap(loose)


def test_words_left_out_of_the_classifier_have_no_weight(spark, monkeypatch):
    """Fitted on every word, the words that ``fit`` leaves out get weight zero."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(rng.choice([f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)], 6))
             + (" vile" if i % 3 == 0 else "") + (" women." if i % 4 == 0 else "."), int(i % 3 == 0)) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, label int")
    kept = set(toxicity.fit(train, penalty=0.02).words.vocabulary)
    every, screen = {w for _, t, _ in rows for w in re.findall(r"[a-z]+", t)}, toxicity.live_words
    rare = every - kept
    assert rare and "vile" in kept and set(toxicity.TERMS) <= kept
    assert all(sum(w in t.rstrip(".").split() for _, t, _ in rows) <= 4 for w in rare)
    monkeypatch.setattr(toxicity, "live_words", lambda tokens, n: screen(tokens, 0))
    full = toxicity.fit(train, penalty=0.02)
    assert set(full.words.vocabulary) >= every
    assert full.weights().get("vile", 0) > 0 and not rare & set(full.weights())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    sizes = mixing.sized(docs)
    empty = [sharding.document_shards(docs), packing.packed_documents(docs), toxicity.document_toxicity(docs, labels),
             exact_dedup.dedup(docs), lm_scoring.document_scores(docs), simhash.near_duplicates(docs), pii.document_spans(docs),
             repetition.quality(docs), mixing.mix(sizes, mixing.cycled_weights(sizes, (5, 2, 1))),
             url_filter.judge(spark.createDataFrame([], "page_id long, url string"),
                              spark.createDataFrame([("com", "/", "allow")], "host string, path string, verdict string"))]
    assert [df.count() for df in empty] == [0] * len(empty)


def brute_stages(rows):
    """Ids left after quality rules, exact dedup and SimHash, one (id, text) each."""
    good = []
    for d, t in rows:
        w = words(t)
        k = 7  # the longest window found twice; 7 stands for none
        while len({tuple(w[i:i + k + 1]) for i in range(len(w) - k)}) < len(w) - k:
            k += 1
        if len(w) >= 20 and 100 * brute_repeats(t) <= 30 * len(w) and (k == 7 or 5 * k <= len(w)):
            good.append((d, t))
    best = {}
    for d, t in good:
        best[folded(t)] = max(best.get(folded(t), (d, t)), (d, t))
    single = sorted(best.values())
    prints, kept = [brute_print(t) for _, t in single], list(range(len(single)))
    for _ in single:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    kept[i] = kept[j] = min(kept[i], kept[j])
    return good, single, [single[i] for i in sorted(set(kept))]


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage of the pipeline on a fixture with copies, near copies, repeats, nulls and short texts."""
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 4000, 120)) for _ in range(12)]
    twice = " ".join(["same words come again and again in here now then"] * 5)
    rows = list(enumerate([*base, *[b.upper() for b in base[:4]], *[b + " tail" for b in base[2:6]], None, "", "too short",
                           twice, base[0] + " " + base[0], " ".join(f"z{x}" for x in range(5000))]))
    docs = spark.createDataFrame([(d, t, "abc"[d % 3], len(t or "")) for d, t in rows],
                                 "doc_id long, text string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table, outs = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.stored(stage(spark, table, str(tmp_path)), "test-stage")
        outs.append(table)
    for out, want in zip(outs, brute_stages(rows)):
        assert out.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(want)
    left, mixed, pieces = outs[2].collect(), outs[3].collect(), outs[4].collect()
    full = {r.doc_id: r.text for r in left}
    assert outs[3].columns == docs.columns
    size = collections.Counter()
    for r in left:
        size[r.source] += len(words(r.text))
    weight, target, open_, budget = dict(zip(sorted(size), (5, 2, 1))), {}, set(size), sum(size.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 3 * size[s]}
        target |= {s: 3 * size[s] if s in over else weight[s] * level for s in over or open_}
        budget -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s in size:
        most = max(len(words(r.text)) for r in left if r.source == s)
        assert abs(sum(len(words(r.text)) for r in mixed if r.source == s) - target[s]) <= most / 2 + 1
    for r in mixed:
        assert r.text == full[r.doc_id]
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in mixed:
        ids = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want += [(r.doc_id, p, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes()))
                 for p, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces) == sorted(want)
    end = collections.Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end[r.sequence_id]
        end[r.sequence_id] += r.length
    assert max(end.values()) <= 2048
    key_of = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key_of, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key_of, pieces))
