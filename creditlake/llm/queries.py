"""The registered operator queries, with DuckDB SQL where it can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (collocations, exact_dedup, licenses, lm_scoring, merkle, mixing, packing, pii, repetition, sharding,
               simhash, toxicity, url_filter)
from .common import read_table

# The rules of the URL query (host, path, verdict).
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))
SOURCE_WEIGHTS = (5, 2, 1)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.document_shards(read_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.document_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.document_scores(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.document_spans(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repetition.quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                            "n_repeat_words", "base_failed", "kept")])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(read_table(spark, sf_dir, "documents"))
    mixed = mixing.mix(sizes, mixing.cycled_weights(sizes, SOURCE_WEIGHTS))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read_table(spark, sf_dir, "pages"), rules)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), longest=3, least=10, top=2000)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = merkle.manifest(docs, merkle.tampered_text(docs, 3))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", "").cast("binary"), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(read_table(spark, sf_dir, "documents")).drop("spans")


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
w AS (
  SELECT doc_id, h, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
         row_number() OVER (PARTITION BY h, doc_id) AS nth FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND nth = 1 AS kept, h AS text_sha256 FROM w
"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
             3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM r),
p AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM o),
l AS (SELECT CAST(words_left AS DOUBLE) / weight_left AS level FROM p
      WHERE CAST(words_left AS DOUBLE) / weight_left * weight <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN weight * level >= cap THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target
      FROM r, l),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', '{mixing.SEED}', CAST(d.doc_id AS VARCHAR), CASE WHEN d.doc_id IS NULL THEN CAST(d.size AS VARCHAR) END)), d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + CASE WHEN 2 * (CAST(floor(target - whole * source_size + 0.5) AS BIGINT) - before) >= size THEN size ELSE 0 END AS BIGINT) AS taken
FROM x
"""

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP10_SQL = f"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS rid,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
m AS (SELECT u.rid, rule_host || rule_path AS rule, verdict,
             row_number() OVER (PARTITION BY u.rid ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS nth
      FROM u JOIN rules ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.rid = m.rid AND m.nth = 1
"""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
OP11_SQL = rf"""
WITH p AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_UPPER}, {_LOWER}),
                                                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p),
o AS (SELECT lang, w, lead(w) OVER (PARTITION BY id ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY id ORDER BY i) AS w3 FROM t),
g AS (
  SELECT lang, 1 AS size, w AS phrase FROM o
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM o WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM o WHERE w3 IS NOT NULL),
c AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM c WHERE size = 1 GROUP BY lang),
k AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE size > 1 AND a >= 10),
cuts AS (SELECT *, unnest(range(1, size)) AS cut FROM k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, cut, 1000000 * cuts.a * cuts.a // (x.a * y.a) AS score FROM cuts
  JOIN c x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN c y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:cuts.size], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM k WHERE size = 3)
  GROUP BY ALL),
best AS (
  SELECT lowest.lang, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, encode(lowest.phrase)) AS rank,
         lowest.phrase, a, l, r, score
  FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT best.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM best JOIN n ON n.lang = best.lang WHERE rank <= 2000
"""

_LEVELS, _TOP = 8, 3  # enough for 8 ** 8 rows of a language and 8 ** 3 languages


def _level_sql(name: str, below: str) -> str:
    return (f"CASE WHEN len({below}) <= 1 THEN {below} ELSE list_transform(range(0, len({below}), 8), "
            f"lambda i: sha256(array_to_string({below}[i + 1:i + 8], ''))) END AS {name}")


def _merkle_sql() -> str:
    field = lambda c: (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')")
    leaf = lambda text: f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    crc = ("xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) "
           "WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))")
    parts = [f"""d AS MATERIALIZED (
  SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf('low')} ELSE {leaf('text')} END AS received
  FROM (SELECT *, translate(text, {_UPPER}, {_LOWER}) AS low FROM documents)),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t0 AS (SELECT lang, list(leaf ORDER BY pos) AS l0 FROM x GROUP BY lang)"""]
    for i in range(1, _LEVELS + 1):
        parts.append(f"t{i} AS MATERIALIZED (SELECT *, {_level_sql(f'l{i}', f'l{i - 1}')} FROM t{i - 1})")
    parts.append(f"f AS MATERIALIZED (SELECT *, l{_LEVELS}[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t{_LEVELS})")
    parts.append("u0 AS (SELECT list(subroot ORDER BY place) AS m0 FROM f)")
    for i in range(1, _TOP + 1):
        parts.append(f"u{i} AS MATERIALIZED (SELECT *, {_level_sql(f'm{i}', f'm{i - 1}')} FROM u{i - 1})")
    steps = [(f"l{i}", "pos", 8 ** i) for i in range(_LEVELS)] + [(f"m{i}", "place", 8 ** i) for i in range(_TOP)]
    parts.append(f"j0 AS MATERIALIZED (SELECT x.doc_id, x.leaf, x.pos, f.*, u{_TOP}.*, received AS folded, '' AS proof "
                 f"FROM x JOIN f ON x.lang IS NOT DISTINCT FROM f.lang, u{_TOP})")
    for i, (nodes, at, width) in enumerate(steps, 1):
        first, own = f"({at} // {8 * width} * 8)", f"({at} // {width})"
        left, right = f"array_to_string({nodes}[{first} + 1:{own}], '')", f"array_to_string({nodes}[{own} + 2:{first} + 8], '')"
        parts.append(f"j{i} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN len({nodes}) > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded, "
                     f"CASE WHEN len({nodes}) > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM j{i - 1})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, m{_TOP}[1] AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m{_TOP}[1] AS verified
FROM j{len(steps)}
"""


OP12_SQL = _merkle_sql()

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_sharding": (op1_sharding, None),
    "op2_packing": (op2_packing, None),
    "op3_toxicity": (op3_toxicity, None),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op5_lm_scoring": (op5_lm_scoring, None),
    "op6_simhash": (op6_simhash, None),
    "op7_pii": (op7_pii, None),
    "op8_quality": (op8_quality, None),
    "op9_mixing": (op9_mixing, OP9_SQL),
    "op10_url_filters": (op10_url_filters, OP10_SQL),
    "op11_collocations": (op11_collocations, OP11_SQL),
    "op12_merkle": (op12_merkle, OP12_SQL),
    "op13_licenses": (op13_licenses, None),
}
