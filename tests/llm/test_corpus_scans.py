"""Collocations, Merkle manifest and license scan against brute force."""
import collections
import hashlib
import re
import zlib

import pytest

from creditlake.llm import collocations, licenses, merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, at int, n long, shard int, word string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA).repartition(4)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {lang: tree_levels([k[2] for k, _ in sorted(trees[lang], key=lambda x: x[0])]) for lang in order}
    top = tree_levels([levels[lang][-1][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        for at, (_, row) in enumerate(sorted(trees[lang], key=lambda x: x[0])):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            folded, siblings = leaf((*row[:4], lowered(row[4]))) if tampered else leaf(row), []
            for levels_, p in ((levels[lang], at), (top, place)):
                for nodes in levels_[:-1]:
                    run = nodes[p - p % 8:p - p % 8 + 8]
                    others = run[:p % 8] + run[p % 8 + 1:]
                    siblings += others
                    folded = digest(*others[:p % 8], folded, *others[p % 8:])
                    p //= 8
            out.append((row[0], leaf(row), levels[lang][-1][0], top[-1][0], digest(*siblings), folded))
    return out


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


MANIFEST_ROWS = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(150)]
MANIFEST_ROWS += [(i, None, "de", None, None if i % 4 else "") for i in range(9)] + [(7, "a", None, 1, "Null Lang"), (7, "a", None, 1, "Null Lang")]
MANIFEST_ROWS += [(None, "a", "fr", 1, "No Id"), (5, "a", "", 1, "Empty Lang"), (9, "b", "es", 2, "É Ünï 1"), (9, "c", "es", 2, "É Ünï 1")]
MANIFEST_ROWS += [(1, "z", f"l{i}", 2, "One") for i in range(12)] + [(3, "z", "long", 2, "Ab " * 200_000)]


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(spark, monkeypatch, height):
    """Superblocks of one level need several exchanges; those of four hold every tree here."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    docs = frame(spark, MANIFEST_ROWS)
    rows = merkle.manifest(docs, merkle.tampered_text(docs)).collect()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, digest(*r.siblings), r.folded_root) for r in rows]
    assert sorted(got, key=key) == sorted(brute_manifest(MANIFEST_ROWS), key=key)
    assert all(merkle.fold(r.leaf, r.places, r.widths, r.siblings) == r.root for r in rows)
    assert {r.doc_id for r in rows if r.folded_root != r.root} <= {r[0] for r in MANIFEST_ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0}


def test_manifest_of_a_hot_row(spark):
    """A third of the rows are one row: its copies are leaves each, counted before they are ranked."""
    rows = [(1, "s", "en", 3, "Same")] * 300 + [(i, "s", "en", 3, f"t{i}") for i in range(600)]
    got = merkle.manifest(frame(spark, rows)).collect()
    assert len(got) == 900 and len({tuple(r.places) for r in got}) == 900 and {r.folded_root for r in got} == {got[0].root}
    one = merkle.manifest(spark.createDataFrame([(4, "Only")], "doc_id long, text string")).collect()[0]
    assert one.leaf == one.subroot == one.root == leaf((4, None, None, None, "Only")) and one.siblings == []


def test_manifest_folds_every_leaf(spark):
    """The root is recomputed from the proof for rows as they were too, not copied."""
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(10)]
    nodes = spark.createDataFrame([("=en", i, d, "en", i, d) for i, d in enumerate(digests)],
                                  "tree string, at long, digest binary, lang string, doc_id long, received binary")
    outer = spark.createDataFrame([("=en", 0, False, "s", "not the root", [], [], [])], "tree string, block long, forced boolean, "
                                  "subroot string, root string, places array<int>, widths array<int>, siblings array<string>")
    hexed = [d.hex() for d in digests]
    root = merkle.node([merkle.node(hexed[:8]), merkle.node(hexed[8:])])
    assert {(r.doc_id, r.folded_root) for r in merkle.exchanged(nodes, outer).collect()} == {(i, root) for i in range(10)}


def brute_collocations(rows, longest, least, top):
    n, f = collections.Counter(), collections.Counter()
    for _, _, lang, _, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    kept = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    per = collections.defaultdict(list)
    for (lang, p), a in kept.items():
        if any(len(q) > len(p) and g == lang and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (g, q), b in kept.items()):
            continue
        score, cut = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        per[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, found in per.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def phrase_rows():
    rows = []
    for i in range(160):
        words = [f"w{(i * 7 + j * j) % 23}" for j in range(i % 30)]
        tail = "Ice Cream cone, new york city! new york\tcity\nNew York" if i % 3 else "Ünï cöde ünï"
        rows.append((i, "s", ("en", "de", None, "und", "")[i % 5], 1, " ".join(words) + "  " + tail))
    rows += [(1, "s", "en", 1, "ice cream cone")] * 90 + [(None, None, None, None, None), (3, "s", "de", 0, ""), (4, "s", "en", 1, " . ,\x00 a\x0bb  x")]
    return rows + [(5, "s", "fr", 1, "la vie. " * 30_000 + "en rose " * 12)]


@pytest.mark.parametrize("longest, least, shards, slots", [(3, 10, 3, None), (4, 3, 2, None), (3, 5, 4, 1 << 16), (2, 10, 1, None)])
def test_collocations(spark, monkeypatch, longest, least, shards, slots):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 5000)
    rows = phrase_rows()
    counted = collocations.phrase_counts
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counted(*a, slots=slots))
    got = collocations.collocations(frame(spark, rows), longest, least, 40, shards=shards)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == names and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, longest, least, 40)


def test_shared_slots_change_no_count(spark, monkeypatch):
    """With 64 slots nearly every phrase shares its slot with another."""
    rows = phrase_rows()
    want = collections.Counter()
    for _, _, lang, _, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                want.update(("und" if lang is None else lang, " ".join(w[i:i + k])) for i in range(len(w) - k + 1))
    got, words = collocations.phrase_counts(frame(spark, rows), 3, 10, 3, slots=64)
    assert {(r.lang, r.phrase): r.a for r in got.collect()} == {p: a for p, a in want.items() if a >= 10}
    assert sum(r.n for r in words.collect()) == sum(a for (_, p), a in want.items() if " " not in p)


def test_few_hash_bits_and_odd_languages_change_no_result(spark, monkeypatch):
    """Sums by a hash of 16 bits, as many as slots have, note too many phrases, never too few or a wrong count; a
    language may hold what separates phrase and language in the key of the last sums."""
    monkeypatch.setattr(collocations, "HASH_BITS", 16)
    rows = [(i, "s", lang, 1, t) for i, (_, _, _, _, t) in enumerate(phrase_rows()[:250]) for lang in ("a\nb", "\n", "a b", "")]
    got = collocations.collocations(frame(spark, rows), 3, 10, 40)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 3, 10, 40)


def test_phrases_below_the_threshold_go_on_without_their_words(spark, monkeypatch):
    """The scans hand on hashes; only the check counts words, and only of phrases noted."""
    rows = [(i, "s", "en", 1, "new york city. " + " ".join(f"w{(i * i * 31 + j * (i % 97 + 3) + j * j * 17) % 101}" for j in range(40)))
            for i in range(400)]
    written, kept = [], collocations.stored

    def stored(df, name, *args, **options):
        out = kept(df, name, *args, **options)
        written.append((name, "string" in dict(out.dtypes).values(), out))
        return out

    monkeypatch.setattr(collocations, "stored", stored)
    got = collocations.collocations(frame(spark, rows), 3, 10, 40)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 3, 10, 40)
    noted = next(out for name, _, out in written if name == "dic-phrases").count()
    tasks = 4 * 3  # each shard of each partition
    by_words = sum(out.count() for name, text, out in written if text and name not in ("dic-shards", "dic-phrases"))
    assert by_words <= (1.1 * noted + 1) * tasks


def test_the_check_bundles_phrases(monkeypatch):
    """A task hands on noted phrases by language and bucket, compressed; bundles add up to the exact counts."""
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(collocations, "SUM_ROWS", 500)
    texts = [" ".join(f"common word{i * j % 997}" for j in range(60)) + f". rare{i} a, a" for i in range(300)]
    langs = [("en", "a\nb", "")[i % 3] for i in range(300)]
    table = np.ones(1 << 16, np.uint8)
    slices = [(pa.array(langs[i:i + 100]), pa.array(texts[i:i + 100])) for i in (0, 100, 200)] + [(pa.array(["en"]), pa.array([""]))]
    rows = pa.Table.from_batches([b for part in slices for b in collocations._counted(collocations._Slice(*part), 3, table, 64)])
    want = collections.Counter()
    for lang, text in zip(langs, texts):
        for piece in re.split("[.,]", text):
            w = piece.split()
            want[lang, ""] += len(w)
            want.update((lang, " ".join(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    got, groups = {}, collections.defaultdict(list)
    for r in rows.to_pylist():
        groups[r["lang"], r["bucket"]].append(r)
    for (lang, _), own in groups.items():
        for r in collocations._summed(pa.Table.from_pylist(own)).to_pylist():
            assert (lang, r["phrase"]) not in got  # a phrase is in one bucket
            got[lang, r["phrase"]] = r["n"]
    assert got == want
    assert 4 * len(rows) < len(want)
    common = {bucket for (lang, bucket), own in groups.items() for r in own if lang == "en" and b"\ncommon word" in
              b"\n" + pa.input_stream(pa.py_buffer(r["phrases"]), compression="zstd").read()}
    assert len(common) == 4  # a sixteenth of the buckets, not one


def test_the_check_writes_no_row_a_phrase_and_task(spark, monkeypatch):
    """Counts by words are summed from the scan on; only the phrases kept are written."""
    rows, written, kept = phrase_rows(), [], collocations.stored

    def stored(df, name, *args, **options):
        out = kept(df, name, *args, **options)
        written.append((name, out))
        return out

    monkeypatch.setattr(collocations, "stored", stored)
    phrases, words = collocations.phrase_counts(frame(spark, rows), 3, 10, 3)
    assert {name for name, out in written if "string" in dict(out.dtypes).values()} == {"dic-shards", "dic-phrases"}
    assert next(out for name, out in written if name == "dic-phrases").count() == phrases.count() + words.count()


def test_a_table_of_empty_texts_has_no_collocations(spark):
    assert collocations.collocations(frame(spark, [(i, "s", "en", 0, ("", None, ".")[i % 3]) for i in range(9)])).collect() == []


def test_tasks_and_sql_hash_alike(spark):
    import pyarrow as pa
    part = collocations._Slice(pa.array(["en", ""]), pa.array(["bé a bé", "a"]))
    known = {(part.langs[k].as_py(), part.words[w].as_py()): int(h) for k, w, h in zip(part.lang_of, part.word_of, part.hash)}
    rows = spark.createDataFrame([(k, w) for k, w in known], "lang string, last string")
    assert {(r[0], r[1]): r[2] & (2 ** 64 - 1) for r in rows.select("lang", "last", collocations.phrase_hash(1)).collect()} == known


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


LICENSE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LICENSE_TEXTS = [
    None, "", "...", "Released under the MIT License.", "mit-license; MIT\nLICENSE", "submit licenses", "the MIT Licence and the Apach Lisense",
    "GNU General  Public--License, cc by cc by cc", "gnu genral publik license", "gnu lesser general public license", "gnu lessr genral public licens",
    "xx redistribution and used in source or binary forms", "permission hereby granted free of charge", "CC BY-NC 4.0 été MIT Licensé",
    "a mit lic ense", "apache licens apache license apachelicense", "mit license " * 400, "lorem ipsum " * 20_000 + "Mozilla Public Licence", "lé MÎT license",
    "licence mit license mit", "x" * 300_000 + " mit license"]


def test_licenses(spark):
    rows = [(i, None, None, None, t) for i, t in enumerate(LICENSE_TEXTS)]
    docs = frame(spark, [*rows, rows[3]])
    got = licenses.document_licenses(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(len(rows)), 3])
    for r in got:
        text = LICENSE_TEXTS[r.doc_id] or ""
        w = LICENSE_WORDS.findall(lowered(text))
        base = [(i, label) for label, phrase in licenses.BASE for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(base))
        assert (r.first_word, r.last_word) == (min((i for i, _ in base), default=None), max((i for i, _ in base), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        for s in r.spans:
            notice = [n for label, n in licenses.NOTICES if label == s.label]
            cut = " ".join(LICENSE_WORDS.findall(lowered(text[s.start:s.end])))
            assert any(edits(cut, n) <= s.edits <= len(n) // 9 for n in notice) and w[s.word] == cut.split()[0]
        if len(w) < 60:  # brute force: every run of words against every notice
            want = {label for label, n in licenses.NOTICES for i in range(len(w)) for j in range(i + 1, min(len(w), i + 12) + 1)
                    if edits(" ".join(w[i:j]), n) <= len(n) // 9}
            assert r.labels == ",".join(sorted(want | {label for _, label in base}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.spans)
    by_id = {r.doc_id: r for r in got}
    assert by_id[17].labels == "mpl" and len(by_id[16].spans) == 400 and by_id[5].labels == ""


def test_empty_tables(spark):
    docs = frame(spark, MANIFEST_ROWS).filter("false")
    for out in (merkle.manifest(docs), collocations.collocations(docs), licenses.document_licenses(docs)):
        assert out.count() == 0
