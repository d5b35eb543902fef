"""Cleaning operators.

Statistics that drive a fill or a clip (medians, modes, quartiles, missing
shares) are computed in ONE aggregate over all columns and attached back with
a cross join to that one-row result, so the plan stays lazy and distributed:
nothing is collected to the driver while building.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAYS_PER_YEAR, IQR_FACTOR, KEY, MISSING_DROP_SHARE, TARGET, UNEMPLOYED_SENTINEL, YOUNG_AGE_MAX
from ..functions.exprs import clean_num, clip_, flag_yn, with_scalars
from ..functions.quantiles import quantile_frame
from .quality import numeric_columns, string_columns, value_counts


def recode_days_employed(df: DataFrame, col: str = "DAYS_EMPLOYED") -> DataFrame:
    """Sentinel → null + IS_UNEMPLOYED flag; |days| and years employed."""
    sentinel = F.col(col) >= UNEMPLOYED_SENTINEL
    days = F.abs(F.when(sentinel, F.lit(None)).otherwise(F.col(col)))
    return df.withColumns({
        col: days,
        "YEARS_EMPLOYED": days / F.lit(DAYS_PER_YEAR),
        "IS_UNEMPLOYED": F.when(sentinel, 1).otherwise(0),
    })


def recode_days_birth(df: DataFrame, col: str = "DAYS_BIRTH") -> DataFrame:
    """C4: age in years; IS_YOUNG strictly below 35."""
    age = F.abs(F.col(col)) / F.lit(DAYS_PER_YEAR)
    return df.withColumns({
        "AGE_YEARS": age,
        "IS_YOUNG": F.when(age < YOUNG_AGE_MAX, 1).otherwise(0),
    })


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row frame: the commonest value of each text column, the smallest on ties, null
    without values. (column, value) pairs are counted, so no buffer holds a column's values."""
    best = value_counts(df, cols).groupBy("__c").agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v"))).alias("b"))
    return best.agg(*[F.max(F.when(F.col("__c") == i, F.col("b.v"))).alias(f"{c}__mode") for i, c in enumerate(cols)])


def missing_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One-row frame: null share, median (numeric) and mode (string) per column."""
    cols = cols or df.columns
    num = set(numeric_columns(df))
    texts = [c for c in string_columns(df) if c in cols]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__null"))
        if c not in num and c not in texts:
            aggs.append(F.mode(F.col(c), True).alias(f"{c}__mode"))
    counts = df.agg(*aggs)
    if texts:
        counts = with_scalars(counts, modes(df, texts))
    specs = [(c, 0.5, f"{c}__med") for c in cols if c in num]
    return with_scalars(counts, quantile_frame(df, specs)) if specs else counts


def handle_missing_values(df: DataFrame, protect=(KEY, TARGET)) -> DataFrame:
    """Drop columns more than 80 % missing; numeric ← median, string ← mode
    (or "MISSING" when the column has no value at all). A filled whole-number column
    becomes double, as a median can be fractional. The decision which
    columns to drop needs the shares, so one aggregate runs here (a single
    row comes back); the fills stay lazy in the returned plan."""
    cols = [c for c in df.columns if c not in protect]
    stats = missing_stats(df, cols).first().asDict()
    n = stats["__n"] or 0
    drop = [c for c in cols if n and stats[f"{c}__null"] / n > MISSING_DROP_SHARE]
    fills = {}
    for c in cols:
        if c in drop or not stats[f"{c}__null"]:
            continue
        if f"{c}__med" in stats:
            if stats[f"{c}__med"] is not None:
                fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(stats[f"{c}__med"])))
        else:
            mode = stats[f"{c}__mode"]
            fills[c] = F.coalesce(F.col(c), F.lit(mode if mode is not None else "MISSING"))
    return df.drop(*drop).withColumns(fills) if fills else df.drop(*drop)


def clean_application(df: DataFrame, impute: bool = True) -> DataFrame:
    """Recodes, gender flag, document flags in [0,1], Y/N flags, inf → null, C5."""
    out = recode_days_birth(recode_days_employed(df)).drop("DAYS_EMPLOYED", "DAYS_BIRTH")
    if "CODE_GENDER" in out.columns:
        out = out.withColumn("IS_FEMALE", F.when(F.col("CODE_GENDER") == "F", 1).otherwise(0)).drop("CODE_GENDER")
    docs = {c: clip_(c, 0, 1) for c in out.columns if c.startswith("FLAG_DOCUMENT_")}
    flags = {c: flag_yn(c) for c in ("FLAG_OWN_CAR", "FLAG_OWN_REALTY") if c in out.columns}
    out = out.withColumns({**docs, **flags})
    dbl = {f.name: clean_num(f.name) for f in out.schema.fields
           if f.dataType.typeName() in ("double", "float")}
    out = out.withColumns(dbl)
    return handle_missing_values(out) if impute else out


def remove_outliers_iqr(df: DataFrame, cols: list[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Winsorize each column to [Q1 − f·IQR, Q3 + f·IQR] (clipped, never dropped).
    Quartiles of all columns come from one aggregate joined back as one row."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    q = quantile_frame(df, [s for c in cols for s in ((c, 0.25, f"{c}__q1"), (c, 0.75, f"{c}__q3"))])
    joined = with_scalars(df, q)
    out = {}
    for c in cols:
        iqr = F.col(f"{c}__q3") - F.col(f"{c}__q1")
        lo, hi = F.col(f"{c}__q1") - factor * iqr, F.col(f"{c}__q3") + factor * iqr
        out[c] = F.when(F.col(c).isNull(), None).otherwise(F.least(F.greatest(F.col(c), lo), hi))
    return joined.withColumns(out).select(*df.columns)


def outlier_report(df: DataFrame, cols: list[str], factor: float = IQR_FACTOR) -> DataFrame:
    """C9 report: per column the fences and the number of values outside them."""
    cols = [c for c in cols if c in df.columns]
    q = quantile_frame(df, [s for c in cols for s in ((c, 0.25, f"{c}__q1"), (c, 0.75, f"{c}__q3"))])
    joined = with_scalars(df, q)
    aggs = []
    for c in cols:
        iqr = F.col(f"{c}__q3") - F.col(f"{c}__q1")
        lo, hi = F.col(f"{c}__q1") - factor * iqr, F.col(f"{c}__q3") + factor * iqr
        aggs += [F.first(lo).alias(f"{c}__lo"), F.first(hi).alias(f"{c}__hi"),
                 F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}__n")]
    wide = joined.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__lo`, `{c}__hi`, `{c}__n`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, lower_fence, upper_fence, n_clipped)")


def fill_with_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """±inf → null, then every listed column ← its median (lazy, one agg)."""
    cleaned = df.withColumns({c: clean_num(F.col(c).cast("double")) for c in cols})
    med = quantile_frame(cleaned, [(c, 0.5, f"{c}__med") for c in cols])
    joined = with_scalars(cleaned, med)
    return (joined.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__med")) for c in cols})
                  .select(*df.columns))


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """``<c>_enc`` = rank of the value among the sorted distinct values of its
    column (null encoded as the string "nan"), source columns dropped.

    The distinct (column, value) pairs of all columns are ranked in ONE
    distributed running count ordered by (column, value) — range-partitioned,
    no single-task window — and each column's offset (distinct values of the
    columns before it, a table of one row per column) is subtracted. The code
    table is joined back per column with the strategy Catalyst picks."""
    from pyspark.sql import Window
    from ..functions.cumulative import running_totals
    if not cols:
        return df
    vals = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols}
    pairs = (df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("__c"), vals[c].alias("__v"))
                                          for i, c in enumerate(cols)])))
               .distinct()
               .withColumns({"__key": F.struct("__c", "__v"), "__one": F.lit(1)}))
    ranked = running_totals(pairs, "__key", ["__one"])
    sizes = pairs.groupBy("__c").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.withColumn("__before", F.coalesce(
        F.sum("__size").over(Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    codes = (ranked.join(F.broadcast(offsets.select("__c", "__before")), "__c")
                   .select("__c", "__v", (F.col("cum___one") - F.col("__before") - 1).cast("int").alias("__code")))
    out = df
    for i, c in enumerate(cols):
        col_codes = codes.where(F.col("__c") == i).select(F.col("__v"), F.col("__code").alias(f"{c}_enc"))
        out = out.withColumn("__v", vals[c]).join(col_codes, "__v", "left").drop("__v")
    return out.drop(*cols)


def onehot_drop_first(df: DataFrame, cols: list[str]) -> DataFrame:
    """One 0/1 column per sorted distinct value except the first; a null row is
    all zeros. The distinct values of each categorical column (a short list) are
    read once to name the output columns."""
    out = df
    for c in cols:
        values = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()]
        out = out.withColumns({f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for v in values[1:]})
    return out.drop(*cols)
