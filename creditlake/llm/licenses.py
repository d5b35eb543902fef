"""License scan: exact base phrases and a fuzzy search for short notices.

A text becomes its words (A-Z lower-cased) between single spaces. A notice of m
characters may be met with up to k = m // CHARS_PER_ERROR edits. Split into k + 1
pieces, every such occurrence holds one piece unchanged (pigeonhole), so one
Aho-Corasick pass over the pieces of all notices finds every place where one can
stand; the ``regex`` module's bounded-error matching then verifies the window
around each seed and gives the span and its edits. Windows of a notice that
overlap are searched once, as one.

Work is per row, in Arrow batches without a shuffle; a task holds one text and its
normalised form at a time. Spans are given in words and in code points of the
text.

Edge cases: null and empty texts have no words, no spans, null first and last word
and score 0; repeated rows are scanned each; a text of any length is scanned whole;
further columns are ignored; an empty table gives an empty result. Occurrences must
start and end with a word; of overlapping occurrences of one notice the first is
reported.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs_in_tasks, text_of

runs_in_tasks(__name__)

# The base phrases and their labels.
BASE = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
# The notices searched with edits, by label.
NOTICES = BASE + (
    ("lgpl", "gnu lesser general public license"), ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license"), ("cc-by-nc", "cc by nc"), ("cc-by-sa", "cc by sa"),
    ("cc-by", "creative commons attribution"), ("mit", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms"), ("public-domain", "released into the public domain"))
CHARS_PER_ERROR = 9
ROWS = 500
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased
FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def normalised(text: str) -> str:
    """The words with one space before, between and after them; a space for none."""
    return (b" " + b"".join(w + b" " for w in text.encode("utf-8").translate(FOLD).split())).decode("utf-8")


class NoticeSearch:
    """Occurrences of notices with a bounded number of edits."""

    def __init__(self, notices: Sequence[tuple[str, str]], chars_per_error: int = CHARS_PER_ERROR):
        import ahocorasick
        import regex
        self.notices, self.rules, seeds = list(notices), [], {}
        for n, (_, notice) in enumerate(self.notices):
            errors = len(notice) // chars_per_error
            self.rules.append((len(notice), errors, regex.compile(f"(?e)(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}(?= )")))
            cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((n, a))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def windows(self, line: str) -> Iterator[tuple[int, int, int]]:
        """Notice, start and end of the stretches that can hold an occurrence."""
        spots: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.seeds.iter(line):
            for n, offset in places:
                size, errors, _ = self.rules[n]
                begin = max(0, end - length - offset - errors)
                spots.setdefault(n, []).append((begin, begin + size + 3 * errors + 2))
        for n, spans in spots.items():
            spans.sort()
            begin, stop = spans[0]
            for a, b in spans[1:]:
                if a > stop:
                    yield n, begin, stop
                    begin, stop = a, b
                stop = max(stop, b)
            yield n, begin, stop

    def __call__(self, line: str) -> list[tuple[int, int, int, int]]:
        """Start, end, notice and edits of each occurrence in a normalised text."""
        found = []
        for n, begin, stop in self.windows(line):
            for m in self.rules[n][2].finditer(line[begin:stop]):
                found.append((begin + m.start(), begin + m.end(), n, sum(m.fuzzy_counts)))
        return sorted(found)


def places(line: str, phrase: str) -> list[int]:
    """Where the words of ``phrase`` stand one after another."""
    out, key = [], f" {phrase} "
    at = line.find(key)
    while at >= 0:
        out.append(at + 1)
        at = line.find(key, at + 1)
    return out


def word_numbers(line: str, starts: list[int]) -> dict[int, int]:
    """The number of the word at (or around) each of some ascending positions."""
    out, n, last = {}, -1, 0
    for at in starts:
        n += line.count(" ", last, at)
        last = at
        out[at] = n
    return out


def scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES,
         chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """One row per document: doc_id, n_words, base (label and word of each place of a
    base phrase) and spans (label, word, start and end in code points, edits and
    similarity of each occurrence of a notice)."""
    base, notices = tuple(base), tuple(notices)
    span = pa.struct([("label", pa.string()), ("word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                      ("edits", pa.int32()), ("similarity", pa.float64())])
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    schema = ("doc_id long, n_words long, base array<struct<label string, word long>>, spans array<struct<label string, "
              "word long, start long, end long, edits int, similarity double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        search, word = NoticeSearch(notices, chars_per_error), regex.compile(WORD)

        def one(text: str) -> tuple[int, list, list]:
            line = normalised(text)
            n_words = line.count(" ") - 1
            exact = sorted((at, label) for label, phrase in base for at in places(line, phrase))
            fuzzy = search(line)
            if not exact and not fuzzy:
                return n_words, [], []
            ends = [e - 1 for _, e, _, _ in fuzzy]
            number = word_numbers(line, sorted({*(a for a, _ in exact), *(s for s, *_ in fuzzy), *ends}))
            needed = {number[x] for s, e, *_ in fuzzy for x in (s, e - 1)}
            at = {}
            for i, m in enumerate(word.finditer(text) if needed else ()):
                if i in needed:
                    at[i] = m.span()
            spans = [{"label": notices[n][0], "word": number[s], "start": at[number[s]][0], "end": at[number[e - 1]][1],
                      "edits": edits, "similarity": 1 - edits / len(notices[n][1])} for s, e, n, edits in fuzzy]
            return n_words, [{"label": label, "word": number[a]} for a, label in exact], spans

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n_words, exact, spans = zip(*(one(t.as_py()) for t in part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(exact, pa.list_(place)),
                     pa.array(spans, pa.list_(span))], ["doc_id", "n_words", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, schema)


def document_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the best similarity; 0 for none), spans."""
    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"), joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "spans.label")).alias("labels"),
        F.coalesce(F.array_max("spans.similarity"), F.lit(0.0)).alias("score"), "spans")
