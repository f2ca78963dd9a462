"""Exact quantiles per group beside ordinary aggregates, in two passes, safe for groups of any size.

**First pass.** The ordinary aggregates, and with them a mergeable KLL sketch of each column. A group no
larger than the sketch is still whole in it, and its median is read off. For any other group the sketch
brackets each wanted rank: two values between which it lies, but for a tiny chance.

**Second pass.** Rows are counted between the brackets, and by value inside them. Counts are combined before
the shuffle, so what moves of a season or a flag that holds a third of the table is about one row in a
hundred. The running sum of these counts gives the value at each rank; it also shows whether the rank lies
in its bracket. If not, this group is read again with wider brackets, at last with all its values.

Groups up to ``group_rows`` are one bracket from minimum to maximum. The aggregates of both passes are
stored tables, so a call runs at most two jobs, and none of the groups reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sinks.shared import stored

GROUP_ROWS = 100_000
#: Size of a sketch. The error of a rank, as a part of all rows, follows from it.
SKETCH = 2048
ERROR = 2.296 / SKETCH ** 0.9021
#: Half widths of the brackets that are tried one after the other, as parts of all rows.
WIDTHS = (2 * ERROR, 16 * ERROR)
#: Rows of which a sketch has forgotten none.
WHOLE = SKETCH // 2
#: Prefix of columns that the caller does not see.
OWN = "__q_"


def _interpolated(low: Column, high: Column, share: Column) -> Column:
    """Between two neighbouring values; equal ones, infinities among them, stay as they are."""
    return F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share)


def _from_sketch(sketch: Column, n: Column, share: float) -> Column:
    """The value at this share of the rows, NULL without rows; the bounds are those of the column."""
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, share)))))


class _Column:
    """Names of what the stored aggregates hold for one column."""

    def __init__(self, number: int, value: str, probs: Mapping[str, float]) -> None:
        self.number, self.value = number, value
        self.probs = dict(sorted(probs.items(), key=lambda x: x[1]))
        self.n, self.sketch, self.min, self.max, self.todo = (f"{OWN}{x}{number}" for x in ("n", "sketch", "min", "max", "todo"))

    def aggregates(self) -> list[Column]:
        known = F.col(self.value).cast("double")
        return [F.count(known).alias(self.n), F.min(known).alias(self.min), F.max(known).alias(self.max),
                F.kll_sketch_agg_double(known, SKETCH).alias(self.sketch)]

    def bound(self, width: int, name: str, low: bool) -> str:
        return f"{OWN}{'low' if low else 'high'}{self.number}_{width}_{name}"

    def _end(self, p: float, width: int, low: bool, group_rows: int) -> Column:
        """The sketch's bracket of a rank; at its ends, and for small groups, that of all values."""
        share = p - WIDTHS[width] if low else p + WIDTHS[width]
        whole = F.col(self.min if low else self.max)
        if not 0 < share < 1:
            return whole
        inner = _from_sketch(F.col(self.sketch), F.col(self.n), share)
        return F.when(F.col(self.n) <= group_rows, whole).otherwise(inner)

    def settled(self, group_rows: int) -> list[Column]:
        """Quantiles that the sketch of a small group gives, the brackets, and whether there is more to do."""
        whole = F.col(self.n) <= min(WHOLE, group_rows)
        out, only_medians = [], all(p == 0.5 for p in self.probs.values())
        for name, p in self.probs.items():
            if p == 0.5:
                lower, upper = (_from_sketch(F.col(self.sketch), F.col(self.n), x) for x in (0.5, 0.5 + 0.1 / WHOLE))
                out.append(F.when(whole, _interpolated(lower, upper, F.when(F.col(self.n) % 2 == 0, 0.5).otherwise(0.0))).alias(name))
            else:
                out.append(F.lit(None).cast("double").alias(name))
            out += [self._end(p, w, low, group_rows).alias(self.bound(w, name, low)) for w in range(len(WIDTHS)) for low in (True, False)]
        return [*out, (F.col(self.n) > 0) & (~whole if only_medians else F.lit(True))]

    def entry(self, width: int) -> Column:
        """The row's cell and, inside a bracket, its value; NULL if there is nothing to do."""
        v = F.col(self.value).cast("double")
        if width < len(WIDTHS):
            ends = [[F.col(self.bound(width, name, low)) for low in (True, False)] for name in self.probs]
        else:
            ends = [[F.col(self.min), F.col(self.max)]]
        cell, inside = F.lit(0), F.lit(False)
        for low, high in ends:
            cell, inside = cell + F.when(v > high, 1).otherwise(0), inside | v.between(low, high)
        return F.when(F.col(self.todo) & v.isNotNull(), F.struct(
            F.lit(self.number).alias("__c"), F.col(self.n).alias("__n"), cell.alias("__cell"), F.when(inside, v).alias("__v")))

    def read_off(self) -> list[Column]:
        """Each quantile from the running counts, and whether a rank was outside of its bracket."""
        own, out, lost = F.col("__c") == self.number, [], F.lit(False)
        for name, p in self.probs.items():
            h = (F.col("__n") - 1) * F.lit(float(p))
            at = [own & (F.col("__upto") - F.col("__k") <= rank) & (rank < F.col("__upto")) for rank in (F.floor(h), F.ceil(h))]
            low, high = (F.max(F.when(hit, F.col("__v"))) for hit in at)
            out.append(_interpolated(low, high, F.max(F.when(own, h - F.floor(h)))).alias(name))
            lost = lost | ((at[0] | at[1]) & F.col("__v").isNull())
        return [*out, lost]


def _second_pass(df: DataFrame, by: Sequence[str], columns: Sequence[_Column], todo: DataFrame, width: int) -> DataFrame:
    """(by, quantiles, __lost) of the groups in ``todo`` with the brackets of this width."""
    ends = _keyed(todo.select(*by, *[c for c in todo.columns if c.startswith(OWN)]), by)
    if by:
        rows = df.join(ends, _same(by))
    else:  # one row of brackets: as literals
        row = ends.first()
        rows = df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in ends.schema.fields])
    entries = F.filter(F.array(*[c.entry(width) for c in columns]), lambda e: e.isNotNull())
    counts = rows.select(*by, F.inline(entries)).groupBy(*by, "__c", "__n", "__cell", "__v").agg(F.count(F.lit(1)).alias("__k"))
    order = Window.partitionBy(*by, "__c").orderBy("__cell", F.col("__v").asc_nulls_first())
    summed = counts.withColumn("__upto", F.sum("__k").over(order))
    aggregates, lost = [], F.lit(False)
    for c in columns:
        *quantiles, outside = c.read_off()
        aggregates, lost = [*aggregates, *quantiles], lost | outside
    return summed.groupBy(*by).agg(*aggregates, F.max(lost).alias("__lost"))


def _keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"{OWN}key_{k}" for k in by})


def _same(by: Sequence[str]) -> list[Column]:
    return [F.col(k) == F.col(f"{OWN}key_{k}") for k in by]


def _observed(df: DataFrame, flag: Column) -> tuple[DataFrame, int]:
    """``df`` stored, and how many of its rows have the flag, counted while they are written."""
    seen = Observation()
    table = stored(df.observe(seen, F.count_if(flag).alias("n")))
    return table, seen.get["n"]


def aggregate_columns(df: DataFrame, by: Sequence[str], aggs: Sequence[Column],
                      wanted: Mapping[str, Mapping[str, float]], *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``groupBy(by).agg(aggs)`` plus, for each column in ``wanted``, a quantile column per entry of its mapping.

    The columns are numbers without NaN; NULLs are ignored, and a group without values has NULL quantiles.
    Keys must not be NULL; without keys there is one row. Quantiles are exact and interpolated linearly.
    """
    columns = [_Column(i, value, probs) for i, (value, probs) in enumerate(wanted.items())]
    grouped = df.groupBy(*by).agg(*aggs, *[a for c in columns for a in c.aggregates()])
    settled = [c for c in grouped.columns if c not in {x.sketch for x in columns}]
    any_todo = F.lit(False)
    for c in columns:
        *more, todo = c.settled(group_rows)
        settled += [*more, todo.alias(c.todo)]
        any_todo = any_todo | F.col(c.todo)
    base, left = _observed(grouped.select(*settled), any_todo)
    shown = [c for c in base.columns if not c.startswith(OWN)]
    names = [name for c in columns for name in c.probs]
    found, width, open_groups = [], 0, base.filter(any_todo)
    while left:
        exact, left = _observed(_second_pass(df, by, columns, open_groups, width), F.col("__lost"))
        found.append(exact.filter("NOT __lost"))
        if left and by:
            open_groups = open_groups.join(_keyed(exact.filter("__lost").select(*by), by), _same(by), "left_semi")
        width += 1
    if not found:
        return base.select(*shown)
    exact = reduce(DataFrame.unionByName, found)
    if by:
        renamed = _keyed(exact.select(*by, *[F.col(n).alias(f"{OWN}exact_{n}") for n in names]), by)
        base = base.join(renamed, _same(by), "left")
    else:
        row = exact.first()
        base = base.withColumns({f"{OWN}exact_{n}": F.lit(row[n] if row else None).cast("double") for n in names})
    return base.select(*[F.coalesce(f"{OWN}exact_{c}", c).alias(c) if c in names else c for c in shown])


def aggregate_with_quantiles(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], value: str,
                             probs: Mapping[str, float], *, group_rows: int = GROUP_ROWS) -> DataFrame:
    """:func:`aggregate_columns` for one column."""
    return aggregate_columns(df, by, aggs, {value: probs}, group_rows=group_rows)
