"""Exact quantiles by distributed selection (linear interpolation, as pandas/NumPy).

Spark's exact ``percentile`` keeps a value -> count map of the whole column (or
group) in one aggregation buffer, which grows with the data. Here a rank is
selected in rounds of two aggregates over the plain columns, without exploding
rows or collecting values:

1. a mergeable sketch (``percentile_approx``, its size set by ``accuracy`` alone)
   of the values still inside a quantile's open bracket proposes three of them
   around the wanted rank;
2. the values below and up to each proposal are counted, and the next larger value
   is taken by ``min``.

If a proposal's ranks cover the wanted one, it is the answer, and the next larger
value gives the interpolation partner. Else the proposals next to the rank become
the bracket, which holds about 4 / accuracy of the values before, so a column of
10^11 values takes three or four rounds. A bracket of less than accuracy / 2 values
ends the search: a sketch of it has a rank error below a half and gives the value and
its partner. A rank that is not reached is an error, never a null.

Without groups the state is one row of numbers on the driver, a few per quantile;
with groups it is a table of one row per group, joined back on the group.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ACCURACY = 10_000
ROUNDS = 40
GRID = 512      # probabilities a group's later sketches are read at
BLOCK = 32      # proposals counted in one aggregate: three columns each keep it within generated code


@dataclass
class _Selection:
    """The search for one quantile: rank ``f`` lies among the values between ``lo`` and
    ``hi`` (exclusive); ``base`` values are below or at ``lo``, ``above`` below ``hi``."""
    column: str
    p: float
    f: int = 0
    n: int = 0
    lo: float | None = None
    hi: float | None = None
    base: int = 0
    above: int = 0
    value: float | None = None
    done: bool = False

    def inside(self) -> Column:
        x = F.col(f"`{self.column}`").cast("double")
        cond = F.lit(True)
        if self.lo is not None:
            cond = cond & (x > F.lit(self.lo))
        if self.hi is not None:
            cond = cond & (x < F.lit(self.hi))
        return F.when(cond, x)

    def few(self, accuracy: int) -> bool:
        """Whether a sketch of the bracket keeps every value: its rank error is below a half."""
        return 2 * (self.above - self.base) < accuracy

    def sketch(self, accuracy: int) -> Column:
        """The wanted value and the next one where the sketch is exact, else three
        values around the wanted rank."""
        size, rank = max(1, self.above - self.base), self.f - self.base + 0.5
        eps = 2.0 / accuracy
        at = (rank / size, (rank + 1) / size) if self.few(accuracy) else (rank / size - eps, rank / size, rank / size + eps)
        return F.percentile_approx(self.inside(), F.array(*[F.lit(min(1.0, max(0.0, q))) for q in at]), F.lit(accuracy))

    def finish(self, v: float, partner: float) -> None:
        self.value, self.done = v + ((self.n - 1) * self.p - self.f) * (partner - v), True

    def read(self, found: list[float]) -> None:
        """The two values of an exact sketch; the bracket's end follows its last value."""
        last = self.f - self.base + 1 == self.above - self.base
        self.finish(found[0], (found[0] if self.hi is None else self.hi) if last else found[1])

    def settle(self, found: list[tuple[float, int, int, float | None]]) -> None:
        """``found``: proposal, values below it, values up to it, next larger value."""
        for v, below, upto, larger in found:
            if below <= self.f < upto:
                self.finish(v, v if self.f + 1 < upto or larger is None else larger)
                return
            if upto <= self.f and upto > self.base:
                self.lo, self.base = v, upto
            elif below > self.f and below < self.above:
                self.hi, self.above = v, below


def select_quantiles(df: DataFrame, specs: list[tuple[str, float]], accuracy: int = ACCURACY) -> list[float | None]:
    """The quantile ``p`` of ``column`` for every (column, p); None for a column of nulls."""
    searches = [_Selection(c, p) for c, p in specs]
    columns = list(dict.fromkeys(c for c, _ in specs))
    if not specs:
        return []
    sizes = df.agg(*[F.count(F.col(f"`{c}`").cast("double")) for c in columns]).first()
    for s in searches:
        s.n = s.above = sizes[columns.index(s.column)]
        s.f = math.floor((s.n - 1) * s.p) if s.n else 0
        s.done = not s.n
    for _ in range(ROUNDS):
        left = [s for s in searches if not s.done]
        if not left:
            return [s.value for s in searches]
        open_ = []
        for s, found in zip(left, df.agg(*[s.sketch(accuracy) for s in left]).first()):
            if s.few(accuracy):
                s.read(found)
            else:
                open_.append((s, sorted(set(found))))
        while open_:
            fit = max(1, sum(n <= BLOCK for n in accumulate(len(vs) for _, vs in open_)))
            block, open_ = open_[:fit], open_[fit:]
            row = iter(df.agg(*[agg for s, vs in block for v in vs for x in [F.col(f"`{s.column}`").cast("double")]
                                for agg in (F.count_if(x < F.lit(v)), F.count_if(x <= F.lit(v)), F.min(F.when(x > F.lit(v), x)))]).first())
            for s, vs in block:
                s.settle([(v, next(row), next(row), next(row)) for v in vs])
    raise RuntimeError(f"quantiles not reached after {ROUNDS} rounds")


def _select_in_groups(df: DataFrame, specs: list[tuple[str, float, str]], group_cols: list[str], accuracy: int) -> DataFrame:
    """``select_quantiles`` for every group, its state in a table of one row per group."""
    eps, keys = 2.0 / accuracy, [f"__g{i}" for i in range(len(group_cols))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group_cols, keys)],
                     *[F.col(c).cast("double").alias(f"__x{i}") for i, (c, _, _) in enumerate(specs)])
    rows = rows.dropna(subset=keys)
    ids = range(len(specs))
    first = rows.groupBy(*keys).agg(
        *[F.count(f"__x{i}").alias(f"__n{i}") for i in ids],
        *[F.percentile_approx(f"__x{i}", F.array(*[F.lit(min(1.0, max(0.0, specs[i][1] + d))) for d in (-eps, 0.0, eps)]),
                              F.lit(accuracy)).alias(f"__v{i}") for i in ids])
    nothing = F.lit(None).cast("double")
    state = first.select("*", *[c for i in ids for c in (
        F.floor((F.col(f"__n{i}") - 1) * F.lit(specs[i][1])).alias(f"__f{i}"), nothing.alias(f"__lo{i}"), nothing.alias(f"__hi{i}"),
        F.lit(0).cast("long").alias(f"__base{i}"), F.col(f"__n{i}").alias(f"__above{i}"), nothing.alias(f"__q{i}"))])

    def settled(i: int) -> dict[str, Column]:
        f, done = F.col(f"__f{i}"), F.col(f"__q{i}")
        lo, hi, base, above = (F.col(f"__{c}{i}") for c in ("lo", "hi", "base", "above"))
        for j in range(3):
            v, below, upto, larger = F.col(f"__v{i}")[j], *(F.col(f"__{c}{i}{j}") for c in "bun")
            partner = F.when((f + 1 < upto) | larger.isNull(), v).otherwise(larger)
            weight = (F.col(f"__n{i}") - 1) * F.lit(specs[i][1]) - f
            done = F.coalesce(done, F.when((below <= f) & (f < upto), v + weight * (partner - v)))
            up, down = (upto <= f) & (upto > base), (below > f) & (below < above)
            lo, base = F.when(up, v).otherwise(lo), F.when(up, upto).otherwise(base)
            hi, above = F.when(down, v).otherwise(hi), F.when(down, below).otherwise(above)
        return {f"__q{i}": done, f"__lo{i}": lo, f"__hi{i}": hi, f"__base{i}": base, f"__above{i}": above}

    open_ = F.lit(False)
    for i in ids:
        open_ = open_ | (F.col(f"__q{i}").isNull() & (F.col(f"__n{i}") > 0))
    for _ in range(ROUNDS):
        state = cut_lineage(state)
        counts = rows.join(state.select(*keys, *[f"__v{i}" for i in ids]), keys).groupBy(*keys).agg(*[
            a for i in ids for j in range(3) for x, v in [(F.col(f"__x{i}"), F.col(f"__v{i}")[j])]
            for a in (F.count_if(x < v).alias(f"__b{i}{j}"), F.count_if(x <= v).alias(f"__u{i}{j}"),
                      F.min(F.when(x > v, x)).alias(f"__n{i}{j}"))])
        state = state.join(counts, keys)
        state = cut_lineage(state.withColumns({k: c for i in ids for k, c in settled(i).items()}).drop(*counts.columns[len(keys):]))
        if state.filter(open_).isEmpty():
            return state.select(*[F.col(k).alias(g) for g, k in zip(group_cols, keys)],
                                *[F.col(f"__q{i}").alias(a) for i, (_, _, a) in enumerate(specs)])
        grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        bracket = rows.join(state.filter(open_).select(*keys, *[f"__{c}{i}" for i in ids for c in ("lo", "hi", "q")]), keys)
        sketch = bracket.groupBy(*keys).agg(*[F.percentile_approx(
            F.when(F.col(f"__q{i}").isNull() & F.coalesce(F.col(f"__x{i}") > F.col(f"__lo{i}"), F.lit(True))
                   & F.coalesce(F.col(f"__x{i}") < F.col(f"__hi{i}"), F.lit(True)), F.col(f"__x{i}")), grid, F.lit(accuracy)).alias(f"__s{i}") for i in ids])
        state = state.join(sketch, keys, "left")
        new = {}
        for i in ids:
            at = F.floor((F.col(f"__f{i}") - F.col(f"__base{i}") + 1) * GRID / F.greatest(F.col(f"__above{i}") - F.col(f"__base{i}"), F.lit(1)))
            near = F.array(*[F.get(f"__s{i}", F.least(F.greatest(at + d, F.lit(0)), F.lit(GRID)).cast("int")) for d in (-1, 0, 1)])
            new[f"__v{i}"] = F.when(F.col(f"__s{i}").isNull(), F.col(f"__v{i}")).otherwise(near)
        state = state.withColumns(new).drop(*[f"__s{i}" for i in ids])
    raise RuntimeError(f"quantiles not reached after {ROUNDS} rounds")


def quantile_frame(df: DataFrame, specs: list[tuple[str, float, str]], group_cols: list[str] | None = None,
                   accuracy: int = ACCURACY) -> DataFrame:
    """One row (per group; rows of a null group are left out) with column ``alias`` =
    quantile ``p`` of ``column`` for every ``(column, p, alias)`` in ``specs``; nulls
    are ignored. Reads ``df`` at least twice, so pass a stored or cheap frame."""
    if group_cols:
        return _select_in_groups(df, specs, list(group_cols), accuracy)
    values = select_quantiles(df, [(c, p) for c, p, _ in specs], accuracy)
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(a) for v, (_, _, a) in zip(values, specs)])
