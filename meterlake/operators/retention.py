"""Which stored rows may go: only classes that can be built anew, or that are bounded by number or lease, ever lose any."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How durable a class is (fixed values); nothing is ever dropped from the classes of KEPT.
CATEGORIES = ("irreplaceable", "versioned_interpretation", "reference_data", "rebuildable", "disposable")
KEPT = CATEGORIES[:3]


@dataclass(frozen=True)
class Rule:
    """A class' category; the group it is rebuilt with; how many of its newest rows stay; how long a row stays (ns). A rule that would drop rows of a kept class can't be made."""

    category: str
    group: str | None = None
    most: int | None = None
    lease: int | None = None

    def __post_init__(self) -> None:
        if self.category not in CATEGORIES:
            raise ValueError(f"no category {self.category}")
        if self.group is not None and self.category != "rebuildable":
            raise ValueError(f"a {self.category} class isn't rebuilt")
        if (self.most is not None or self.lease is not None) and self.category in KEPT:
            raise ValueError(f"a {self.category} class has no bound")


def _of(name: Column, values: Mapping[str, object]) -> Column:
    """A class' value, null for the rest."""
    return reduce(lambda c, kv: c.when(name == kv[0], F.lit(kv[1])), values.items(), F.when(F.lit(False), F.lit(next(iter(values.values()))))) if values else F.lit(None)


def retained(rows: DataFrame, name: str, at: str, id: str, rules: Mapping[str, Rule], rebuild: Collection[str], now: int) -> DataFrame:
    """rows without the classes of the groups to be rebuilt, without rows whose lease is over, and with no more than the newest so many of a bounded class (ties: larger id).

    Rows of a class that no rule names stay, as do those without a class. A group
    that no class belongs to is an error. Bounded classes are cut by row numbers
    below a constant, which Spark limits on each side of the shuffle.
    """
    if unknown := set(rebuild) - {r.group for r in rules.values()}:
        raise ValueError(f"no class is rebuilt with {sorted(unknown)}")
    kind = F.col(name)
    gone = [c for c, r in rules.items() if r.group in rebuild and r.group is not None]
    leases = {c: r.lease for c, r in rules.items() if r.lease is not None}
    bounds = {c: r.most for c, r in rules.items() if r.most is not None}
    over = F.coalesce(F.col(at) + _of(kind, leases) <= now, F.lit(False)) if leases else F.lit(False)
    left = rows.where(F.coalesce(~kind.isin(gone), F.lit(True)) & ~over) if gone else rows.where(~over)
    if not bounds:
        return left
    cut = F.coalesce(kind.isin(list(bounds)), F.lit(False))
    w = Window.partitionBy(name).orderBy(F.col(at).desc_nulls_last(), F.col(id).desc())
    newest = left.where(cut).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(bounds.values())).where(F.col("__n") <= _of(kind, bounds)).drop("__n")
    return left.where(~cut).unionByName(newest)


def report(before: DataFrame, after: DataFrame, name: str, rules: Mapping[str, Rule]) -> DataFrame:
    """(name, category, rows, kept) of each class; a class without a rule is untracked."""
    n = lambda df, c: df.groupBy(name).agg(F.count("*").alias(c))
    both = n(before, "rows").alias("b").join(n(after, "kept").alias("a"), F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")), "left")
    category = F.coalesce(_of(F.col(f"b.{name}"), {c: r.category for c, r in rules.items()}), F.lit("untracked"))
    return both.select(f"b.{name}", category.alias("category"), "rows", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))
