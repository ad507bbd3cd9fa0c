"""Models over prefix features: a logistic pipeline, and importances of any model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import seeded_order
from tracewell.operators.folds import ranked
from tracewell.operators.metrics import auroc
from tracewell.plans import scratch


def usable(df: DataFrame, features: list[str]) -> list[str]:
    """Features that are not null on every row."""
    n = df.agg(*(F.count(c).alias(c) for c in features)).first()
    return [c for c in features if n[c]]


def logistic_pipeline(rows: DataFrame, features: list[str], label: str = "y"):
    """Median imputation with indicators, scaling, logistic regression."""
    features = usable(rows, features)
    x = rows.withColumns({f"__m_{c}": F.col(c).isNull().cast("double") for c in features}).withColumns({c: F.col(c).cast("double") for c in features})
    filled = [f"__i_{c}" for c in features]
    stages = [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled + [f"__m_{c}" for c in features], outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True),
        LogisticRegression(featuresCol="__x", labelCol=label, maxIter=100),
    ]
    model = Pipeline(stages=stages).fit(x)

    def parts(value) -> list:
        """What each feature adds to the margin, by ``value(name)``, a column."""
        filled, _, scaled, fit = model.stages
        medians = filled.surrogateDF.first()
        weight = [float(w) / s if s else 0.0 for w, s in zip(fit.coefficients.toArray(), scaled.std.toArray())]
        mean, n, out = [float(m) for m in scaled.mean.toArray()], len(features), []
        for k, c in enumerate(features):
            x = value(c).cast("double")
            known = F.when(x.isNull() | F.isnan(x), F.lit(float(medians[c]))).otherwise(x)
            out.append(F.lit(weight[k]) * (known - F.lit(mean[k])) + F.lit(weight[n + k]) * (x.isNull().cast("double") - F.lit(mean[n + k])))
        return out

    def score(df: DataFrame, out: str = "score") -> DataFrame:
        d = df.withColumns({f"__m_{c}": F.col(c).isNull().cast("double") for c in features}).withColumns({c: F.col(c).cast("double") for c in features})
        return model.transform(d).select(*df.columns, vector_to_array("probability")[1].alias(out))

    score.parts, score.base = parts, float(model.stages[-1].intercept)
    return score


def out_of_fold(rows: DataFrame, folds: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """Logistic scores of each fold's rows by a model of the others."""
    placed, parts = rows.join(folds, "uid"), None
    for r in folds.select("fold").distinct().orderBy("fold").collect():
        one = logistic_pipeline(placed.where(F.col("fold") != r[0]), features, label)(placed.where(F.col("fold") == r[0]))
        parts = one if parts is None else parts.unionByName(one)
    return parts


class Logistic:
    """The pipeline as a model with ``features`` and ``score``."""

    def __init__(self, rows: DataFrame, features: list[str], label: str = "y"):
        self.features = usable(rows, features)
        self.score = logistic_pipeline(rows, self.features, label)

    def shuffled(self, value, other) -> Column:
        """Scores of a row as it is by ``value(name)``, and with each feature in turn taken from ``other(name)``.

        A margin is the sum of what the features add, so the sums before and after a feature do for all changes of it.
        """
        base = self.score.base

        @F.pandas_udf("array<double>")
        def scores(own: pd.Series, moved: pd.Series) -> pd.Series:
            if not len(own):
                return pd.Series([], dtype=object)
            x, y = np.stack(own.to_numpy()).astype(float), np.stack(moved.to_numpy()).astype(float)
            none = np.zeros((len(x), 1))
            before = np.concatenate([none, np.cumsum(x, axis=1)], axis=1)
            after = np.concatenate([np.cumsum(x[:, ::-1], axis=1)[:, ::-1], none], axis=1)
            z = base + np.concatenate([before[:, -1:], before[:, :-1] + y + after[:, 1:]], axis=1)
            return pd.Series(list(1 / (1 + np.exp(-z))))

        return scores(F.array(*self.score.parts(value)), F.array(*self.score.parts(other)))


def permutation_importance(model, rows: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """(feature, drop): the k features whose shuffling lowers the AUROC most. ``model`` has ``features`` and ``score``.

    Rows are numbered in two seeded orders, share by share, and one feature at a time takes the values of
    the row with its number; all features are scored in one job.
    """
    key = ["uid", "t"]
    one = lambda s: ranked(rows.withColumn("__order", seeded_order(s, *key)), "__order", key).drop("__order")
    moved = one(f"{seed}:moved").select("nth", *(F.col(f).alias(f"__v_{f}") for f in model.features))
    both = one(f"{seed}").join(moved, "nth").drop("nth")
    if hasattr(model, "shuffled"):  # all changes of a row at once, not a row per change
        names = F.array(F.lit(""), *map(F.lit, model.features))
        at = both.select("y", F.posexplode(model.shuffled(F.col, lambda f: F.col(f"__v_{f}"))).alias("__k", "score"))
        return _drops(auroc(at.select("y", "score", names[F.col("__k")].alias("__feature")), ["__feature"]), k)
    each = both.withColumn("__feature", F.explode(F.array(F.lit(""), *map(F.lit, model.features))))
    changed = each.withColumns({f: F.when(F.col("__feature") == f, F.col(f"__v_{f}")).otherwise(F.col(f)) for f in model.features}).drop(*(f"__v_{f}" for f in model.features))
    return _drops(auroc(model.score(changed), ["__feature"]), k)


def _drops(found: DataFrame, k: int) -> DataFrame:
    found = scratch.cut(found)  # a row per feature, read twice
    whole = found.where("__feature = ''").select(F.col("auroc").alias("__whole"))
    drops = found.where("__feature <> ''").crossJoin(F.broadcast(whole))  # one row
    return drops.select(F.col("__feature").alias("feature"), (F.col("__whole") - F.col("auroc")).alias("drop")).orderBy(F.desc("drop"), "feature").limit(k)
