"""Ranking: every order is total (score, then id), so ranks are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, group: str, score: str, ident: str, ascending: bool = False, first: int = 1) -> DataFrame:
    """rows with `rank` within their group, best score first, ties to the smaller id."""
    order = F.asc(score) if ascending else F.desc(score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, ident)) + F.lit(first - 1))


def top_k(rows: DataFrame, group: str, score: str, ident: str, k: int, ascending: bool = False) -> DataFrame:
    """The best k of each group; Spark limits each group before the shuffle."""
    return ranked(rows, group, score, ident, ascending).where(F.col("rank") <= k)


def above_or_first(rows: DataFrame, group: str, score: str, ident: str, threshold: float, least: int) -> DataFrame:
    """What is above a threshold, and the first few in any case."""
    return ranked(rows, group, score, ident).where((F.col(score) > threshold) | (F.col("rank") <= least))


def slices(ranking: DataFrame, ks: list[int]) -> DataFrame:
    """One ranking at several depths: (k, ...) for every k that a row's rank is within."""
    return ranking.select(F.explode(F.filter(F.array(*map(F.lit, sorted(ks))), lambda k: F.col("rank") <= k)).alias("k"), "*")


def first_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: partial aggregation, then no row is held twice."""
    kept = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.min_by(F.struct(order, *kept), F.col(order)).alias("best"))
    return best.select(key, "best.*")


def seeded(ident: str, seed: int) -> Column:
    """A key whose order is a reproducible draw: the MD5 of `seed:id`."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string")).cast("binary"))


def sampled(rows: DataFrame, group: str, ident: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each group by a seeded hash; the same on every run."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(seeded(ident, seed), ident))).where(F.col("_r") <= n).drop("_r")


def page(ranking: DataFrame, group: str, start: int, size: int) -> DataFrame:
    """Ranks start+1 to start+size (size is clamped to 1..50), with what remains and whether that is nothing."""
    size = min(max(size, 1), 50)
    total = F.count("*").over(Window.partitionBy(group))
    out = ranking.withColumn("total", total).where(F.col("rank").between(start + 1, start + size))
    left = F.greatest(F.col("total") - (start + size), F.lit(0))
    return out.withColumn("remaining", left).withColumn("exhausted", left == 0).drop("total")


def adjacent(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Steps along an ordered table: difference of the key, of the value, and value per 100 of the key."""
    w = Window.orderBy(order)
    dk, dv = F.col(order) - F.lag(order).over(w), F.col(value) - F.lag(value).over(w)
    return rows.withColumn("d_key", dk).withColumn("d_value", dv).withColumn("gain", F.col("d_value") / F.col("d_key") * 100)


def pareto(rows: DataFrame, cost: str, value: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """is_optimal: no row that costs as much or less has as high a value (of equals the first by `ties` counts)."""
    w = Window.orderBy(F.asc(cost), F.desc(value), *ties).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(value).over(w)
    return rows.withColumn("is_optimal", before.isNull() | (F.col(value) > before))


def smallest_reaching(rows: DataFrame, key: str, value: str, target: float) -> DataFrame:
    return rows.where(F.col(value) >= target).agg(F.min(key).alias(key))


def min_max(column: Column, group: str) -> Column:
    """Scaled to 0..1 within a group; 0 everywhere if all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return (column - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)
