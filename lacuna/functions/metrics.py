"""Error metrics of predictions, as grouped aggregates over long rows (group, y, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse_by(rows: DataFrame, *group: str, y: str = "y", p: str = "p") -> DataFrame:
    return rows.groupBy(*group).agg(rmse(F.col(y), F.col(p)).alias("rmse"))


def mae_by(rows: DataFrame, *group: str, y: str = "y", p: str = "p") -> DataFrame:
    return rows.groupBy(*group).agg(mae(F.col(y), F.col(p)).alias("mae"))


def rmse_overall(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Over all elements of all groups; in general not the mean of the groups' values."""
    return rows.agg(rmse(F.col(y), F.col(p)).alias("rmse"))


def r2_by(rows: DataFrame, *group: str, y: str = "y", p: str = "p") -> DataFrame:
    """1 less the residual sum of squares over the total one plus 1e-8.

    Two passes: the groups' means, a small table, are joined back before squares are
    summed, which keeps the digits that a one-pass variance would lose.
    """
    means = rows.groupBy(*group).agg(F.avg(y).alias("__mean"))
    joined = rows.join(means, list(group)) if group else rows.crossJoin(F.broadcast(means))
    residual = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    total = F.sum((F.col(y) - F.col("__mean")) * (F.col(y) - F.col("__mean")))
    return joined.groupBy(*group).agg((F.lit(1.0) - residual / (total + F.lit(1e-8))).alias("r2"))


def named_bands(wide: DataFrame, names: tuple[str, ...], value: str = "value", band: str = "band") -> DataFrame:
    """Metric columns, one a band, as rows (band, value) with the band's name."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.select(F.expr(f"stack({len(names)}, {pairs}) AS (`{band}`, `{value}`)"))
