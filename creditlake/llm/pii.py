"""Personal data by candidate spans and gradient boosting.

Base spans come from one pattern per kind, leftmost and without overlap, with a check
on each match. High-recall generators (looser patterns: other separators, spelled-out
"at" and "dot", numbers without a prefix) propose further spans in the gaps between
base spans, which may overlap those of other kinds; runs of digits end at the length
bounds of their kind, and a phone is no part of an address or a card. Boosted trees
learn from the generators' own candidates: label 1 when the candidate passes the check
of its kind after normalising (separators removed, "at" and "dot" resolved), else 0;
bare runs of digits, dates and decimals are no phone. The check itself (Luhn, ranges,
the exact pattern) is no feature; format and the text on both sides are. Valid
candidates are always added, whatever the table's size; of the others those whose score
reaches the threshold of their kind, calibrated on a hash fold of the candidates of all
documents kept out of the fit: the lowest score above which ``precision`` of the fold's
candidates, one wrong one added, are valid; a kind without candidates in the fold takes the threshold of all
kinds together. Added spans of a kind that overlap each other keep the earliest.

Main path: one pass over the documents in DataFrame functions without a shuffle.
Positions come from splitting the text at the matches and summing lengths in blocks,
gaps are cut from blocks of the text, and overlaps found by bisection, so work grows
in proportion to the text and its spans; the
fitted trees are an SQL expression evaluated on a document's own candidates. The
trees are fitted on the candidates of about ``max_docs`` distinct texts (a documented
bound); one more pass counts (kind, score bin, label) over all documents, combined
map-side to at most 4 x 201 rows.

Patterns use possessive repeats and start a run only at its left end (or right
after the last match), which finds the same matches in linear time without
recursion, whatever the length of the text.

Edge cases: null and empty texts have no spans (empty strings, zero counts); repeated
rows have equal results; null ids are kept; if no candidate is valid none is added;
an empty table gives an empty result; offsets are code points, ends exclusive;
``find_spans`` replaces input columns named ``base`` or ``spans``, ``redact`` returns
all input columns.
"""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:[.]{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"[+][0-9][ ().0-9-]+[0-9]",
}
# Separators between the groups of a number; a back reference repeats the first one of the run.
AT, DOT = r"(?: ?@ ?| ?[(\[]at[)\]] ?)", r"(?:[.]| ?[(\[]dot[)\]] ?| [.] ?)"
IP_DOT = r"(?:[.]|\[[.]\]|[(][.][)]| ?[(\[]dot[)\]] ?)"
FOURS = r"[0-9]{{4}}([ ./_-]{{1,2}}+)[0-9]{{4}}(?:\{n}[0-9]{{4}}){{2}}(?![0-9])"
LOOSE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++{AT}{LABEL}++(?:{DOT}|[.] ){LABEL}++(?:{DOT}{LABEL}++)*+",
    "ip": rf"(?:\G|(?<![0-9]))[0-9]++(?:{IP_DOT}[0-9]++){{3}}",
    # groups of four; one separator throughout; separators other than blanks, mixed: 16 to 19 digits
    "card": (rf"(?=[0-9])(?<![0-9])(?:{FOURS.format(n=1)}|(?![0-9]{{1,3}}[ ./_-]{{1,2}}{FOURS.format(n=2)})"
             r"(?:(?=[0-9]++([ ./_-]{0,2}+))[0-9](?:(?:\3)?[0-9]){15,18}|[0-9](?:[./_-]{0,2}+[0-9]){15,18})(?![0-9]))"),
    # area code in brackets; one separator throughout; mixed separators: 8 to 15 digits outside brackets
    "phone": (r"(?=[+(0-9])(?<![0-9])(?<![0-9][./-])(?:[+]?(?:[0-9]{1,4}[ .-]{0,2}+)?[(][0-9]{1,5}[)][ ./-]{0,2}+[0-9]++(?:([ ./-])[0-9]++(?:\1[0-9]++)*+)?+"
              r"|[+]?(?:(?=[0-9]++([ ./-]{0,2}+))[0-9](?:(?:\2)?[0-9]){7,14}|[0-9](?:[ ./-]{0,2}+[0-9]){7,14})(?![0-9]|[./-]{1,2}[0-9]))"),
}
# What a text must hold for a pattern to match at all (base, loose): the patterns run on such texts only.
NEEDS = {
    "email": ("contains({t}, '@')", "contains({t}, '@') or {t} rlike '[(\\\\[]at[)\\\\]]'"),
    "ip": ("{t} rlike '[0-9][.][0-9]'", "{t} rlike '[0-9] ?[.(\\\\[]'"),
    "card": ("{t} rlike '[0-9][ -]?[0-9]'", "{t} rlike '[0-9][ ./_-]{{0,2}}[0-9]'"),
    "phone": ("contains({t}, '+')", "{t} rlike '[0-9][ ()./-]{{0,3}}[0-9]'"),
}
CHECK = {
    "email": "true",
    "ip": "forall(split({m}, '[.]'), x -> length(ltrim('0', x)) <= 2 or (length(ltrim('0', x)) = 3 and ltrim('0', x) <= '255'))",
    "card": "length(regexp_replace({m}, '[^0-9]', '')) between 16 and 19 and luhn_check(regexp_replace({m}, '[^0-9]', ''))",
    "phone": "length(regexp_replace({m}, '[^0-9]', '')) between 8 and 15",
}
DIGITS = "regexp_replace({m}, '[^0-9]', '')"
BRACKETS = r"regexp_replace({m}, r' ?[(\[](dot|[.])[)\]] ?', '.')"
# A loose match is valid when it passes the check of its kind once separators are
# removed and spelled-out signs resolved. A number without a sign, brackets or two
# groups, a decimal, a date, a range of years and four dotted parts are no phone.
VALID = {
    "email": (r"regexp_replace(regexp_replace({m}, r' ?[(\[]at[)\]] ?| ?@ ?', '@'), r' ?[(\[]dot[)\]] ?| [.] ?', '.') "
              rf"rlike r'^{LOCAL}++@{LABEL}++(?:[.]{LABEL}++)++$' and {{m}} rlike '[A-Za-z]{{{{2}}}}$'"),
    "ip": CHECK["ip"].format(m=BRACKETS),
    "card": CHECK["card"],
    "phone": (f"length({DIGITS}) between 8 and 15 and {{m}} rlike '[+( ./-]' and not {{m}} rlike "
              "'^[0-9]+[.][0-9]+$|^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$|^(19|20)[0-9]{{2}}[ /-]{{1,2}}(19|20)[0-9]{{2}}$"
              "|^[0-9]{{4}}([./-])[0-9]{{1,2}}[./-][0-9]{{1,2}}( |$)|^[0-9]{{1,2}}([./-])[0-9]{{1,2}}[./-][0-9]{{4}}( |$)'"),
}
MASK = "\ue000"
SIDE = 24
BLOCK = 256
MAX_DOCS = 20_000
TREES, DEPTH = 15, 3
PRECISION = 0.98
BINS = 200
NEVER = BINS + 1
FEATURES = tuple(
    [f"if({{c}}.kind = {k}, 1D, 0D)" for k in range(len(KINDS))]
    + ["double(char_length({c}.m))", "double(length(regexp_replace({c}.m, '[^0-9]', '')))",
       "double(length(regexp_replace({c}.m, '[^A-Za-z]', '')))", "double(size(split({c}.m, '[^0-9A-Za-z]+')))",
       "double(length(regexp_replace({c}.m, '[^ ]', '')))", "double(length(regexp_replace({c}.m, '[^.]', '')))",
       "double(length(regexp_replace({c}.m, '[^-/_]', '')))", "double(length(regexp_replace({c}.m, '[^()]', '')))", r"double(length(regexp_replace({c}.m, r'[^\[\]]', '')))",
       "if({c}.m like '+%', 1D, 0D)", "if({c}.m like '%@%', 1D, 0D)",
       "if(lower({c}.left) rlike 'mail|contact|write', 1D, 0D)", "if(lower({c}.left) rlike 'card|visa|credit|pay', 1D, 0D)",
       "if(lower({c}.left) rlike 'phone|tel|call|fax|mobile', 1D, 0D)", "if(lower({c}.left) rlike 'host|server|address|ip', 1D, 0D)",
       "if(lower({c}.left) rlike 'id|no[.]|number|order|version|key|token', 1D, 0D)",
       "if({c}.left rlike '[A-Za-z]$', 1D, 0D)", "if({c}.left rlike '[=:\"]$', 1D, 0D)", "if({c}.left rlike '(^|[ \\n])$', 1D, 0D)",
       "if({c}.right rlike '^[A-Za-z0-9_]', 1D, 0D)", "if({c}.right rlike '^([ \\n.,;]|$)', 1D, 0D)"])


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "''") + "'" if "'" in pattern else f"r'{pattern}'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, both: str = "{} + {}") -> str:
    """Inclusive running sums (or another ``both``) of an array of longs from 0 up, in blocks (linear work)."""
    fold = f"0L, (a, v) -> {both.format('a', 'v')}"
    inside = f"transform(z.x, (w, i) -> {both.format('z.o', f'aggregate(slice(z.x, 1, i + 1), {fold})')})"
    before = f"transform(s, (y, i) -> aggregate(slice(s, 1, i), {fold}))"
    found = f"flatten(transform(zip_with(k, {before}, (x, o) -> named_struct('x', x, 'o', o)), z -> {inside}))"
    blocks = f"transform(sequence(0, (size(l) - 1) div {BLOCK}), b -> slice(l, b * {BLOCK} + 1, {BLOCK}))"
    return _let(values, "l", "if(size(l) = 0, array(), "
                + _let(blocks, "k", _let(f"transform(k, x -> aggregate(x, {fold}))", "s", found)) + ")")


def _touches(spans: str) -> str:
    """Whether span ``c`` overlaps one of ``spans``, which are apart and in order (bisection)."""
    middle = "int((a.low + a.high) div 2)"
    step = (f"if(a.low >= a.high, a, if({spans}[{middle}].start < c.end, named_struct('low', {middle} + 1, 'high', a.high), "
            f"named_struct('low', a.low, 'high', {middle})))")
    before = (f"aggregate(sequence(0, int(log2(size({spans}) + 1)) + 1), named_struct('low', 0, 'high', size({spans})), (a, t) -> {step}, "
              "a -> a.low)")
    return _let(before, "n", f"if(n = 0, false, {spans}[n - 1].end > c.start)")


def _found(rows: DataFrame, name: str, kind: int, pattern: str, sides: bool, column: str = "__text") -> DataFrame:
    """Add an array column of matches in ``column``: kind, start, end, m (and the text on both sides)."""
    p, m, ends = f"__p_{name}", f"__m_{name}", f"__e_{name}"
    needs = NEEDS[KINDS[kind]][sides].format(t=column)
    rows = rows.withColumns({m: F.expr(f"if({needs}, regexp_extract_all({column}, {_literal(pattern)}, 0), array())"),
                             p: F.expr(f"if({needs}, split({column}, {_literal(pattern)}, -1), array())")})
    lengths = f"zip_with(slice({p}, 1, size({m})), {m}, (x, y) -> bigint(char_length(x) + char_length(y)))"
    rows = rows.withColumn(f"__l_{name}", F.expr(lengths)).withColumn(ends, F.expr(_running(f"__l_{name}")))
    more = f", 'left', substring({p}[i], -{SIDE}, {SIDE}), 'right', substring({p}[i + 1], 1, {SIDE})" if sides else ""
    span = (f"transform({m}, (x, i) -> named_struct('kind', {kind}, 'start', {ends}[i] - char_length(x), "
            f"'end', {ends}[i], 'm', x{more}))")
    return rows.withColumn(name, F.expr(span)).drop(p, m, ends, f"__l_{name}")


def base_spans(rows: DataFrame) -> DataFrame:
    """Add ``base``: checked spans of all kinds, by kind, then start. Needs ``__text``."""
    for k, kind in enumerate(KINDS):
        rows = _found(rows, f"__b{k}", k, BASE[kind], False)
    parts = [f"filter(__b{k}, s -> {CHECK[kind].format(m='s.m')})" for k, kind in enumerate(KINDS)]
    return rows.withColumn("base", F.expr(f"concat({', '.join(parts)})")).drop(*[f"__b{k}" for k in range(len(KINDS))])


def candidates(rows: DataFrame) -> DataFrame:
    """Add ``cands``: loose spans in the gaps between base spans with their features
    and label (``valid``). Base spans are blanked out by as many ``MASK`` characters."""
    rows = rows.withColumn("__s", F.expr("array_sort(transform(base, s -> named_struct('start', s.start, 'end', s.end)))"))
    ends = _running("transform(__s, x -> x.end)", "greatest({}, {})")
    since, until = "if(i = 0, 0L, z.e[i - 1])", "if(i = size(z.s), z.n, z.s[i].start)"
    gap = (f"if({until} <= {since}, '', substring(array_join(slice(z.k, int({since} div {BLOCK}) + 1, "
           f"int(({until} - 1) div {BLOCK} - {since} div {BLOCK}) + 1), ''), int({since} % {BLOCK}) + 1, int({until} - {since})))")
    mask = f"if(i = size(z.s), '', repeat('{MASK}', int(greatest(0L, z.e[i] - greatest(z.s[i].start, {since})))))"
    blocks = f"regexp_extract_all(__text, r'(?s).{{1,{BLOCK}}}', 0)"
    masked = _let(f"named_struct('s', __s, 'e', {ends}, 'k', {blocks}, 'n', bigint(char_length(__text)))", "z",
                  f"array_join(transform(sequence(0, size(z.s)), i -> concat({gap}, {mask})), '')")
    rows = rows.withColumn("__gaps", F.expr(f"if(size(base) = 0, __text, {masked})")).drop("__s")
    for k, kind in enumerate(KINDS):
        rows = _found(rows, f"__c{k}", k, LOOSE[kind], True, "__gaps")
        rows = rows.withColumn(f"__c{k}", F.expr(
            f"transform(__c{k}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'm', c.m, "
            f"'left', c.left, 'right', c.right, 'valid', {VALID[kind].format(m='c.m')}))"))
    # a phone inside the run of an address or a card is a part of that run
    inside = (f"if(c.m rlike '^[+(]', {_touches('z.va')} or {_touches('z.vb')}, {_touches('z.a')} or {_touches('z.b')})")
    apart = _let("named_struct('p', __c3, 'a', __c1, 'b', __c2, 'va', filter(__c1, o -> o.valid), 'vb', filter(__c2, o -> o.valid))", "z",
                 f"filter(z.p, c -> not {inside})")
    rows = rows.withColumn("__c3", F.expr(f"if(size(__c3) = 0 or size(__c1) + size(__c2) = 0, __c3, {apart})"))
    rows = rows.withColumn("__c", F.expr(f"concat({', '.join(f'__c{k}' for k in range(len(KINDS)))})"))
    features = f"array({', '.join(FEATURES)})".format(c="c")
    return rows.withColumn("cands", F.expr(
        f"transform(__c, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'f', {features}, 'valid', c.valid))")
    ).drop("__c", "__gaps", *[f"__c{k}" for k in range(len(KINDS))])


def _tree_sql(node, features: str) -> str:
    """A fitted regression tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return (f"if({features}[{split.featureIndex()}] <= {float(split.threshold())!r}D, "
            f"{_tree_sql(node.leftChild(), features)}, {_tree_sql(node.rightChild(), features)})")


class SpanModel:
    """Score of a candidate as an SQL expression, with one threshold per kind."""

    def __init__(self, score: str | None = None, thresholds: tuple[int, ...] = (NEVER,) * len(KINDS)):
        self.score, self.thresholds = score, thresholds

    def select(self, cands: str) -> str:
        """SQL for the candidates to add."""
        if self.score is None or all(t >= NEVER for t in self.thresholds):
            return f"filter({cands}, c -> c.valid)"
        least = "array(" + ", ".join(map(str, self.thresholds)) + ")"
        return f"filter({cands}, c -> c.valid or {_bin(self.score.format(f='c.f'))} >= {least}[c.kind])"


def _bin(score: str) -> str:
    return f"int(floor({score} * {BINS}))"


def _threshold(counts, precision: float) -> int:
    """Lowest bin from which up ``precision`` of the candidates and one more wrong one are
    valid, from (bin, n, good): a few valid candidates alone let no wrong one pass."""
    n = good = 0
    least = NEVER
    for b, more, valid in sorted(counts, reverse=True):
        n, good = n + more, good + valid
        if good >= precision * (n + 1):
            least = b
    return least


def fit(rows: DataFrame, max_docs: int = MAX_DOCS, precision: float = PRECISION) -> SpanModel:
    """Fit the trees on the candidates of a hash sample of the distinct texts of ``rows``
    (with ``__text``); count the thresholds over the held fold of all rows."""
    total = rows.agg(F.approx_count_distinct(F.xxhash64("__text"), 0.02)).first()[0]
    part = F.pmod(F.xxhash64("__text", F.lit("pii")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_docs / max(1, total)))
    fitted = _labelled(rows.select("__text").filter(part).distinct()).filter("not fold")
    fitted = stored(fitted.select("f", "label"), "pii-candidates")
    labels = [r[0] for r in fitted.select("label").distinct().collect()]  # at most two
    if len(labels) < 2:
        # one label only leaves nothing to learn: the trees' constant score
        score = f"{labels[0]!r}D" if labels else "1D"
    else:
        model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=17).fit(
            fitted.select("label", array_to_vector("f").alias("v")))
        weighted = [f"{float(w)!r}D * {_tree_sql(t._call_java('rootNode'), '{f}')}" for t, w in zip(model.trees, model.treeWeights)]
        score = f"(1D / (1D + exp(-2D * ({' + '.join(weighted)}))))"
    held = _labelled(rows).filter("fold").select("kind", "label", F.expr(_bin(score.format(f="f"))).alias("bin"))
    bins = held.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()
    counts = [[(r["bin"], r["n"], r["good"]) for r in bins if r["kind"] == k] for k in range(len(KINDS))]
    pooled: dict[int, tuple[int, int, float]] = {}
    for b, n, good in (c for kind in counts for c in kind):
        _, m, g = pooled.get(b, (b, 0, 0.0))
        pooled[b] = (b, m + n, g + good)
    # a kind without a held candidate takes the threshold of all kinds together
    return SpanModel(score, tuple(_threshold(c or pooled.values(), precision) for c in counts))


def _labelled(rows: DataFrame) -> DataFrame:
    """One row per candidate of ``rows`` (with ``__text``): kind, features, label, fold."""
    # outer: an inner explode adds a filter that would push the whole scan into itself
    found = candidates(base_spans(rows.select("__text"))).select(F.explode_outer("cands").alias("c"), F.xxhash64("__text").alias("t"))
    return found.filter("c.start is not null").select(
        "c.kind", "c.f", F.col("c.valid").cast("double").alias("label"), (F.pmod(F.xxhash64("t", "c.start"), F.lit(4)) == 0).alias("fold"))


def find_spans(docs: DataFrame, max_docs: int = MAX_DOCS, precision: float = PRECISION) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (base and added ones, by kind, then start)."""
    rows = docs.withColumn("__text", text_of(docs))
    model = fit(rows.select("__text"), max_docs, precision)
    rows = candidates(base_spans(rows)).withColumn("__a", F.expr(model.select("cands")))
    # of added spans of a kind that overlap, the earliest stays (loose matches of one pattern never overlap)
    both = ("concat(transform(base, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)), "
            "transform(__a, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end)))")
    return rows.withColumn("spans", F.expr(f"array_sort({both})")).drop("__a", "cands", "__text")


def redact(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets;
    where spans of kinds overlap, the earlier and then the longer one is written."""
    found = find_spans(docs.select(F.struct("*").alias("doc"), text_of(docs).alias("text")), **settings)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    ordered = ("array_sort(spans, (a, b) -> case when a.start <> b.start then if(a.start < b.start, -1, 1) "
               "when a.end <> b.end then if(a.end > b.end, -1, 1) else 0 end)")
    built = (f"aggregate({ordered}, named_struct('at', 0L, 'out', ''), (acc, s) -> if(s.start < acc.at, acc, "
             f"named_struct('at', s.end, 'out', concat(acc.out, substring(text, int(acc.at) + 1, int(s.start - acc.at)), {names}[s.kind]))),"
             "acc -> concat(acc.out, substring(text, int(acc.at) + 1)))")
    text = F.when(F.size("spans") > 0, F.expr(built)).otherwise(F.col("doc.text")).alias("text")
    return found.select(*[text if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def document_spans(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans as text."""
    found = find_spans(docs.select("doc_id", text_of(docs).alias("text")), **settings)
    counts = [F.expr(f"bigint(size(filter(base, s -> s.kind = {k})))").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined("base")).cast("binary"), 256).alias("base_sha256"),
                        F.expr(_joined("spans")).alias("spans"))
