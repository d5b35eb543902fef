"""Column-expression helpers that pin pandas-style semantics onto Spark.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen; none is a Python UDF.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip_(x, lo=None, hi=None) -> Column:
    """Clip that keeps null (Spark's ``greatest(null, 1)`` is 1, pandas keeps NaN)."""
    x = _c(x)
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(lo))
    if hi is not None:
        y = F.least(y, F.lit(hi))
    return F.when(x.isNull(), F.lit(None)).otherwise(y)


def ratio(num, den, floor=1) -> Column:
    """``num / clip(den, lower=floor)``; a null denominator yields null."""
    return F.try_divide(_c(num), clip_(den, lo=floor))


def clean_num(x) -> Column:
    """NaN and ±inf → null (the library keeps a single "missing" value)."""
    x = _c(x)
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(x)


def col_or(df: DataFrame, name: str, default) -> Column:
    """The column when the frame has it, else a literal default (schema tolerance)."""
    if name in df.columns:
        return F.col(name)
    return F.lit(default)


def bin_right_closed(x, bounds: Sequence[float], labels: Sequence, include_lowest=False) -> Column:
    """``pd.cut`` semantics: bins ``(b[i], b[i+1]]``; outside → null."""
    x = _c(x)
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = bounds[i], bounds[i + 1]
        cond = (x > lo) & (x <= hi)
        if include_lowest and i == 0:
            cond = (x >= lo) & (x <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def flag_yn(x) -> Column:
    """Y/N/1/0 → 1/0; anything else, null included, → 0."""
    s = F.upper(F.trim(_c(x).cast("string")))
    return F.when(s.isin("Y", "1"), F.lit(1)).otherwise(F.lit(0))


def map_lookup(x, mapping: dict, default=None) -> Column:
    """Code → value with default, as a literal map (no join, no UDF)."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    val = F.try_element_at(m, _c(x))
    return val if default is None else F.coalesce(val, F.lit(default))


def r4(x) -> Column:
    """Tie-safe rounding used for every double that is compared across engines."""
    return F.round(_c(x).cast("double") + F.lit(3e-7), 4) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0


def r2(x) -> Column:
    return F.round(_c(x).cast("double") + F.lit(3e-5), 2) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Apply the tie-safe rounding to every double/float column (presentation only)."""
    fn = r4 if digits == 4 else r2
    cols = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        cols.append(fn(f.name).alias(f.name) if t in ("double", "float") else F.col(f.name))
    return df.select(*cols)


def pvalue_stars(p) -> Column:
    p = _c(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .otherwise("ns"))


def sample_skew(m_skew, n) -> Column:
    """Spark's ``skewness`` is the population g1; pandas reports bias-corrected G1."""
    n = _c(n).cast("double")
    return F.when(n >= 3, _c(m_skew) * F.sqrt(n * (n - 1)) / (n - 2))


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the single row of an aggregate-only frame (medians, quartiles, totals)
    to every row of ``df`` as a scalar subquery: Spark evaluates it once and
    inlines the values into each task — no join operator, no row pairing."""
    s = stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns]).alias("__s")).scalar()
    return (df.withColumn("__stats", s)
              .withColumns({c: F.col("__stats").getField(c) for c in stats.columns})
              .drop("__stats"))


def literal_rows(rows: list[tuple], schema: list[tuple[str, str]]) -> Column:
    """A literal array of structs (a small, config-bounded parameter grid) to be
    exploded next to the data rows instead of joined."""
    return F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, schema)]) for r in rows])


def select_available(df: DataFrame, cols: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def columns_by_keywords(df: DataFrame, keywords: list[str]) -> list[str]:
    """Columns whose upper-cased name contains any keyword."""
    return [c for c in df.columns if any(k.upper() in c.upper() for k in keywords)]
