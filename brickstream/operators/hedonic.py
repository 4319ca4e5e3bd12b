"""Hedonic value model: features, ridge regression, time split, gate, scores, contributions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickstream.functions.scalars import decade
from brickstream.session import written

NUMERIC = ("log_area", "area", "area_sq", "rooms", "floor", "floor_sq", "total_floors", "floor_share", "top_floor", "ground_floor", "age", "age_sq", "area_rooms", "has_elevator", "act16", "encoded_place", "photos")
CATEGORICAL = ("property_type", "construction_type", "seller_type", "renovation_state", "parking", "decade")
SUPPORT = 0.001  # share of the rows that a category has to have


@dataclass
class Fitted:
    """What a fitted encoder and ridge hold: a few hundred numbers, whatever the training rows."""

    means: dict[str, float]
    stds: dict[str, float]
    categories: dict[str, list[str]]
    columns: list[str]
    coefficients: list[float]
    intercept: float


def smoothed_target(rows: DataFrame, key: str, target: str, smoothing: float) -> DataFrame:
    """``key, encoded_place``: the key's mean target drawn to the global median by ``smoothing`` rows."""
    centre = rows.agg(F.median(target)).scalar()
    groups = rows.groupBy(key).agg(F.avg(target).alias("_avg"), F.count(target).alias("_n"))
    return groups.select(key, ((F.col("_avg") * F.col("_n") + centre * smoothing) / (F.col("_n") + smoothing)).alias("encoded_place"))


def features(rows: DataFrame, encoded: DataFrame, place: str, year: int) -> DataFrame:
    """``rows`` with the numeric and categorical features; missing numbers stay null until they are standardised."""
    zero_null = lambda c: F.when(F.col(c) != 0, F.col(c)).cast("double")
    area, floor, total = F.col("area_sqm"), F.col("floor").cast("double"), zero_null("total_floors")
    age = F.lit(year) - zero_null("year_built")
    category = lambda c: F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit("unknown"))
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).cast("double")
    return (
        rows.join(encoded.select(F.col(place).alias("_p"), "encoded_place"), F.col(place) == F.col("_p"), "left")
        .drop("_p")
        .withColumns({c: category(c) for c in CATEGORICAL if c != "decade"})
        .withColumns(
            {
                "log_area": F.log(area), "area": area, "area_sq": area * area, "rooms": zero_null("rooms"), "floor_sq": floor * floor, "total_floors": total,
                "floor_share": floor / total, "top_floor": (floor == total).cast("double"), "ground_floor": (floor == 0).cast("double"), "age": age, "age_sq": age * age,
                "area_rooms": area * zero_null("rooms"), "has_elevator": flag("has_elevator"), "act16": flag("act16"), "photos": F.col("image_count").cast("double"),
                "decade": decade(F.col("year_built")), "floor": floor,
            }
        )
    )


def fit(rows: DataFrame, target: str, alpha: float) -> Fitted:
    """Ridge with an unpenalised intercept on standardised features, by the normal equations.

    The features are written once; one pass for means and deviations, one for the
    categories of all columns, one for the solver.  A category that fewer than ``SUPPORT``
    of the rows have gets no column, so there are at most ``1 / SUPPORT`` for each feature.
    """
    rows = written(rows.select(*NUMERIC, *CATEGORICAL, target), "features")
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in NUMERIC], *[F.stddev_pop(c).alias(f"s_{c}") for c in NUMERIC], F.stddev_pop(target).alias("spread"), F.count("*").alias("n")).first()
    means = {c: stats[f"m_{c}"] or 0.0 for c in NUMERIC}
    stds = {c: s if (s := stats[f"s_{c}"] or 0.0) > 1e-8 else 1.0 for c in NUMERIC}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in CATEGORICAL])).alias("x")
    counted = rows.select(each).groupBy("x.feature", "x.value").agg(F.count("*").alias("n")).filter((F.col("n") >= SUPPORT * stats["n"]) & F.col("value").isNotNull())
    common: dict[str, list[str]] = {c: [] for c in CATEGORICAL}
    for feature, value, _ in counted.collect():
        common[feature].append(value)
    # the first category in order is left out; a rare or unseen one has all zeros
    categories = {c: sorted(values)[1:] for c, values in common.items()}
    ready, columns = design(rows, means, stds, categories)
    vectors = VectorAssembler(inputCols=columns, outputCol="_f").transform(ready)
    # the solver scales its penalty by the target's deviation and the number of rows
    penalty = alpha / max(stats["n"], 1) * (stats["spread"] or 1.0)
    model = LinearRegression(featuresCol="_f", labelCol=target, solver="normal", elasticNetParam=0.0, standardization=False, regParam=penalty).fit(vectors)
    return Fitted(means, stds, categories, columns, [float(x) for x in model.coefficients], float(model.intercept))


def design(rows: DataFrame, means: dict[str, float], stds: dict[str, float], categories: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """``rows`` with the standardised and dummy columns of the model, and their names; missing numbers count as the mean."""
    numeric = {f"x_{c}": F.coalesce((F.col(c) - means[c]) / stds[c], F.lit(0.0)) for c in NUMERIC}
    dummies = {f"d_{c}_{i}": (F.col(c) == v).cast("double") for c, values in categories.items() for i, v in enumerate(values)}
    return rows.withColumns(numeric | dummies), [*numeric, *dummies]


def score(rows: DataFrame, model: Fitted, actual: str) -> DataFrame:
    """``predicted_per_sqm`` and ``residual_percent`` of each row, as one expression in the JVM."""
    ready, columns = design(rows, model.means, model.stds, model.categories)
    total: Column = F.lit(model.intercept)
    for c, w in zip(columns, model.coefficients, strict=True):
        total = total + F.col(c) * w
    predicted = F.round(F.exp(total), 2)
    return ready.withColumn("predicted_per_sqm", predicted).withColumn("residual_percent", F.round((F.col(actual) - F.col("predicted_per_sqm")) / F.col("predicted_per_sqm") * 100, 2))


def contributions(scored: DataFrame, model: Fitted, top: int = 5) -> Column:
    """The ``top`` features of a row by the size of their effect on the prediction, in percent."""
    groups: dict[str, list[tuple[str, float]]] = {}
    for c, w in zip(model.columns, model.coefficients, strict=True):
        groups.setdefault(c[2:] if c[0] == "x" else c[2 : c.rindex("_")], []).append((c, w))
    effects = [F.struct(F.lit(name).alias("feature"), F.round((F.exp(sum((F.col(c) * w for c, w in parts), F.lit(0.0))) - 1) * 100, 2).alias("impact_pct")) for name, parts in groups.items()]
    ordered = F.array_sort(F.array(*effects), lambda a, b: F.when(F.abs(a["impact_pct"]) > F.abs(b["impact_pct"]), -1).when(F.abs(a["impact_pct"]) < F.abs(b["impact_pct"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return F.slice(ordered, 1, top)


def quality(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: count, mean absolute error in percent, R squared."""
    a, p = F.col(actual), F.col(predicted)
    return rows.withColumn("_mean", rows.agg(F.avg(a)).scalar()).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(a - p) / a) * 100, 2).alias("mae_pct"), F.round(1 - F.sum((a - p) ** 2) / F.nullif(F.sum((a - F.col("_mean")) ** 2), F.lit(0.0)), 4).alias("r2")
    )


def time_split(rows: DataFrame, at: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows before and from ``days`` before the newest one."""
    newest = rows.agg(F.max(at)).first()[0]
    cut = F.lit(newest) - F.expr(f"INTERVAL {days} DAYS") if newest is not None else F.lit(None)
    return rows.filter(F.col(at) < cut), rows.filter(F.col(at) >= cut)


def passes_gate(model_mae: float, baseline_mae: float) -> bool:
    """Whether a model is better than the baseline; an undefined error never is."""
    return math.isfinite(model_mae) and model_mae < baseline_mae


def baseline(rows: DataFrame, train: DataFrame, tiers: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``baseline``: the median of the finest tier of the training rows that knows the row, else the global one."""
    out = rows
    for k in range(len(tiers), 0, -1):
        part = train.groupBy(*tiers[:k]).agg(F.median(value).alias(f"_b{k}")).select(*[F.col(t).alias(f"_{k}{t}") for t in tiers[:k]], f"_b{k}")
        out = out.join(part, [F.col(t).eqNullSafe(F.col(f"_{k}{t}")) for t in tiers[:k]], "left").drop(*[f"_{k}{t}" for t in tiers[:k]])
    out = out.withColumn("_b0", train.agg(F.median(value)).scalar())
    return out.withColumn("baseline", F.coalesce(*[F.col(f"_b{k}") for k in range(len(tiers), -1, -1)])).drop(*[f"_b{k}" for k in range(len(tiers) + 1)])
