"""Grouped reports as data: one description gives the DataFrame plan and the SQL for comparison."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import PREFIX, Catalog, relation_sql
from .order_stats import in_order, quantiles
from .staged import Steps


#: Rounded values are moved outward by this factor, so that ties fall on the same side in both engines despite floating error.
TIE = 1.000000000001


def rounded(text: str, digits: int) -> str:
    return f"round(({text}) * cast({TIE} as double), {digits})"


@dataclass(frozen=True)
class Measure:
    """column: makes the column (a session is needed only then). sql: the other engine's expression. rank: (column, share, digits) of
    a quantile that no aggregate's buffer should hold."""

    column: Callable[[], Column]
    sql: str
    rank: tuple[str, float, int] | None = None


def count(expr: str = "*") -> Measure:
    return Measure(lambda: F.count(F.expr(expr) if expr != "*" else "*"), f"count({expr})")


def unique(expr: str) -> Measure:
    return Measure(lambda: F.count_distinct(F.expr(expr)), f"count(distinct {expr})")


def mean(expr: str, digits: int) -> Measure:
    return computed(rounded(f"avg({expr})", digits))


def deviation(expr: str, digits: int) -> Measure:
    """Sample standard deviation; null for a single row."""
    return computed(rounded(f"stddev_samp({expr})", digits))


#: Columns of whole numbers from 0 to 100: the buffer of an exact percentile has 101 entries.
SHORT = {"track_popularity"}


def quantile(expr: str, p: float, digits: int = 6) -> Measure:
    """Exact, interpolated between neighbours."""
    sql = rounded(f"quantile_cont(cast({expr} as double), {p})", digits)
    return Measure(lambda: F.expr(rounded(f"percentile({expr}, {p})", digits)), sql, None if expr in SHORT else (expr, p, digits))


def least(expr: str) -> Measure:
    return Measure(lambda: F.min(F.expr(expr)), f"min({expr})")


def largest(expr: str) -> Measure:
    return Measure(lambda: F.max(F.expr(expr)), f"max({expr})")


def total(expr: str, digits: int) -> Measure:
    return computed(rounded(f"sum({expr})", digits))


def where(condition: str) -> Measure:
    return Measure(lambda: F.count_if(F.expr(condition)), f"count(case when {condition} then 1 end)")


def names(expr: str) -> Measure:
    """The different values in order, separated by commas."""
    return Measure(lambda: F.array_join(F.array_sort(F.collect_set(F.expr(expr))), ", "), f"string_agg(distinct {expr}, ', ' order by {expr})")


def common(expr: str) -> Measure:
    """The most frequent value, the smallest of equals."""
    return Measure(lambda: F.expr(f"mode() within group (order by {expr})"), f"mode({expr} order by {expr})")


def bound(expr: str, side: int, digits: int, n: str = "count(*)") -> Measure:
    """An end of the mean's 95 % interval; null where the deviation is."""
    text = f"avg({expr}) {'-' if side < 0 else '+'} 1.96 * stddev_samp({expr}) / sqrt({n})"
    return computed(rounded(text, digits))


def computed(text: str) -> Measure:
    """Any aggregate expression that both engines read."""
    return Measure(lambda: F.expr(text), text)


@dataclass(frozen=True)
class Report:
    """over: relations as in Catalog.relation(). by: group columns (name: expression). measures: aggregate columns.
    then: columns over the groups, after `having` (name: (expression, expression in the other SQL or None)). order: columns with
    an optional leading minus; the output is sorted and cut to `limit` by it, nulls last."""

    over: str
    by: dict[str, str] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    filter: str = ""
    having: str = ""
    then: dict[str, str] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    limit: int = 0
    keep: tuple[str, ...] = ()

    def frame(self, catalog: Catalog) -> DataFrame:
        rows = catalog.relation(self.over)
        if self.filter:
            rows = rows.where(self.filter)
        if any(m.rank for m in self.measures.values()):
            rows = self._ranked(rows)
        elif self.measures:
            rows = rows.groupBy(*[F.expr(e).alias(n) for n, e in self.by.items()]).agg(*[m.column().alias(n) for n, m in self.measures.items()])
        else:
            rows = rows.select(*[F.expr(e).alias(n) for n, e in self.by.items()])
        if self.having:
            rows = rows.where(self.having)
        if self.then:
            rows = rows.select("*", *[F.expr(e).alias(n) for n, e in self.then.items()])
        if self.order:
            rows = rows.orderBy(*[F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in self.order])
        if self.limit:
            rows = rows.limit(self.limit)
        return rows.select(*self.keep) if self.keep else rows

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """The groups with measures of which some are quantiles: the columns that are used are written once, since quantiles are
        found in several rounds."""
        steps = Steps(rows.sparkSession, "report")
        ranks: dict[str, list[tuple[str, float, int]]] = {}
        for n, m in self.measures.items():
            if m.rank:
                ranks.setdefault(m.rank[0], []).append((n, *m.rank[1:]))
        used = set(re.findall(r"\w+", " ".join([m.sql for m in self.measures.values()])))
        keys = [F.expr(e).alias(f"_by{i}") for i, e in enumerate(self.by.values())]
        rows = steps.write(rows.select(*[c for c in rows.columns if c in used], *keys, *[in_order(F.col(c)).alias(f"_{c}") for c in ranks]))
        by = [f"_by{i}" for i in range(len(self.by))]
        out = rows.groupBy(*by).agg(*[m.column().alias(n) for n, m in self.measures.items() if not m.rank])
        for c, found in ranks.items():
            q = quantiles(rows.withColumn(c, F.col(c).cast("double")), by, c, f"_{c}", [p for _, p, _ in found], steps)
            q = q.select(*[F.col(k).alias(f"{k}_") for k in by], *[F.expr(rounded(f"q[{i}]", digits)).alias(n) for i, (n, _, digits) in enumerate(found)])
            same = [out[k].eqNullSafe(q[f"{k}_"]) for k in by]
            out = (out.join(q, same, "left") if by else out.crossJoin(F.broadcast(q))).drop(*[f"{k}_" for k in by])  # one row without groups
        return out.select(*[F.col(k).alias(n) for k, n in zip(by, self.by, strict=True)], *self.measures)

    def sql(self) -> str:
        columns = ", ".join([*[f"{e} as {n}" for n, e in self.by.items()], *[f"{m.sql} as {n}" for n, m in self.measures.items()]])
        text = f"select {columns} from {relation_sql(self.over)}"
        if self.filter:
            text += f" where {self.filter}"
        if self.measures and self.by:
            text += " group by " + ", ".join(map(str, range(1, len(self.by) + 1)))
        if self.having:
            text = f"select * from ({text}) where {self.having}"
        if self.then:
            text = f"select *, {', '.join(f'{e} as {n}' for n, e in self.then.items())} from ({text})"
        if self.order:
            text += " order by " + ", ".join(f"{c[1:]} desc nulls last" if c[0] == "-" else f"{c} asc nulls last" for c in self.order)
        if self.limit:
            text += f" limit {self.limit}"
        if self.keep:
            text = f"select {', '.join(self.keep)} from ({text})"
        return PREFIX + text
