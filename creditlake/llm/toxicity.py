"""Toxicity by a counterfactual-regularised classifier.

A logistic model over word presence learns document labels. In each labelled
sentence that names a group, the identity term is swapped for every other term of
its family; the difference of the two feature vectors is all that can change a
linear score. Equal differences are counted first (at most one row per pair of
terms). Each enters the training as a row with both labels: -log s(w.d) - log
s(-w.d) is least where w.d = 0, so it penalises the score change of the swap.
Neutral mentions of a group therefore weigh alike and near nothing. The intercept
is the weight of a constant feature, which differences lack; two rows of zeros
with either label, a constant in the loss, keep that feature's spread above zero.

Training rows: a hash sample of the labelled rows outside the held-out fold, at
most about ``max_rows`` (documented bound; all rows below it). Scores cover every
whole text. An L1 penalty keeps the weights of chance words at zero.

Edge cases: null and empty texts are scored by the intercept; repeated ids take
the larger label; null labels and ids are not learned from; without rows of both
labels every score is the share of label 1 (0 with no rows); ids, source and
language are never features; an empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, stored, text_of

MAX_ROWS = 20_000
PENALTY = 2e-4
SWAP_WEIGHT = 1.0
FIT_TASKS = 4  # the sample is bounded: so few gradients need no shuffle to be summed
ANCHOR = 0.05
THRESHOLD = 0.7

# Families of identity terms that a sentence may swap.
FAMILIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "trans"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish", "polish", "russian"),
    ("immigrant", "refugee", "foreigner", "citizen"), ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly", "teenage"), ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
TERMS = sorted({t for family in FAMILIES for t in family})


def _tokens(text):
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1))


def swaps(labelled: DataFrame) -> DataFrame:
    """Counted swaps in sentences: ``gone`` (the term), ``new`` (its counterpart),
    ``fresh`` (the counterpart is not in the sentence already), ``n``."""
    pairs = F.array(*[F.struct(F.lit(a).alias("gone"), F.lit(b).alias("new"))
                      for family in FAMILIES for a, b in permutations(family, 2)])
    sentence = labelled.select(F.explode(F.split(F.col("text"), r"[.!?\n]+")).alias("s"))
    words = sentence.filter(F.lower("s").rlike(r"(?U)\b(" + "|".join(TERMS) + r")\b")).select(_tokens(F.col("s")).alias("w"))
    pair = words.select("w", F.explode(F.filter(pairs, lambda p: F.array_contains("w", p["gone"]))).alias("p"))
    return pair.groupBy("p.gone", "p.new", (~F.array_contains("w", F.col("p.new"))).alias("fresh")).agg(
        F.count(F.lit(1)).alias("n"))


def live_words(tokens: DataFrame, rows: float) -> list[str]:
    """The words found in more than ``rows`` rows and the identity terms, sorted."""
    counts = tokens.select(F.explode("__w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return sorted({r["w"] for r in counts.filter(F.col("c") > rows).collect()}.union(TERMS))


@dataclass
class Toxicity:
    """A fitted model; ``words`` is the vocabulary model, ``linear`` the classifier."""
    words: object | None
    linear: object | None
    share: float

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``score`` between 0 and 1."""
        if self.linear is None:
            return docs.withColumn("score", F.lit(self.share))
        rows = _features(self.words, docs.withColumn("__w", _tokens(text_of(docs))))
        rows = self.linear.transform(rows)
        return rows.withColumn("score", vector_to_array("__p")[1]).drop("__w", "__f", "__one", "__x", "__r", "__p", "__y")

    def weights(self) -> dict[str, float]:
        """Nonzero weights by word."""
        return {w: float(c) for w, c in zip(self.words.vocabulary, self.linear.coefficients) if c}


def _features(words, tokens: DataFrame) -> DataFrame:
    rows = words.transform(tokens).withColumn("__one", F.lit(1.0))
    return VectorAssembler(inputCols=["__f", "__one"], outputCol="__x").transform(rows)


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, penalty: float = PENALTY,
        swap_weight: float = SWAP_WEIGHT) -> Toxicity:
    """``labelled``: doc_id, text, label (0 or 1)."""
    total = labelled.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_rows / max(total, 1)))
    rows = stored(labelled.filter(part).select("text", F.col("label").cast("double").alias("label")), "toxic-rows")
    n, share = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        return Toxicity(None, None, float(share or 0.0))
    tokens = rows.withColumn("__w", _tokens(F.col("text")))
    vocabulary = live_words(tokens, penalty * n)
    words = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__w", outputCol="__f", binary=True)
    index = {w: i for i, w in enumerate(vocabulary)}
    size = len(index)
    # the swaps are bounded by the pairs of the fixed families
    found = swaps(rows).collect()
    scale = sum(r["n"] for r in found) or 1
    extra = [(Vectors.sparse(size + 1, {}), y, ANCHOR * n) for y in (0.0, 1.0)]
    for r in found:
        d = {index[r["gone"]]: -1.0, **({index[r["new"]]: 1.0} if r["fresh"] else {})}
        extra += [(Vectors.sparse(size + 1, d), y, swap_weight * n * r["n"] / scale) for y in (0.0, 1.0)]
    schema = T.StructType([T.StructField("__x", VectorUDT()), T.StructField("label", T.DoubleType()),
                           T.StructField("weight", T.DoubleType())])
    real = _features(words, tokens).select("__x", "label", F.lit(1.0).alias("weight"))
    linear = LogisticRegression(featuresCol="__x", labelCol="label", weightCol="weight", probabilityCol="__p",
                                rawPredictionCol="__r", predictionCol="__y", maxIter=60, regParam=penalty,
                                elasticNetParam=1.0, fitIntercept=False, standardization=False).fit(
                                    real.unionByName(labelled.sparkSession.createDataFrame(extra, schema)).coalesce(FIT_TASKS))
    return Toxicity(words, linear, float(share))


def document_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1,
                      threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from labelled
    documents outside the held-out fold."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    held_out = fold_of(F.col("doc_id"), modulus) == held
    model = fit(narrow.filter(~held_out).join(known, "doc_id"))
    scored = model.score(narrow)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
