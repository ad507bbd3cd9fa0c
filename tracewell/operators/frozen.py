"""Fitted models as files: saved once, read back elsewhere, and applied to runs that they never saw.

A file holds a model's own parts in JSON, the columns that it needs and a digest of both. Doubles come
back as they were, so scores do, too. A file says nothing that would be run: only the classes below
are made from it.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import bootstrap, decisions, metrics
from tracewell.operators.boosting import BoostedTrees, Trees
from tracewell.operators.monitor import Lag, Monitor, Monitors, Reservoir
from tracewell.plans import scratch

KINDS = {c.__name__: c for c in (BoostedTrees, Trees, Monitor, Monitors, Reservoir, Lag)}


class Damaged(ValueError):
    """A file that is not what was saved, or not what was asked for."""


def _packed(x):
    if isinstance(x, np.ndarray):
        return {"array": x.tolist(), "dtype": str(x.dtype), "shape": list(x.shape)}
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, tuple):
        return {"tuple": [_packed(v) for v in x]}
    if isinstance(x, list):
        return [_packed(v) for v in x]
    if isinstance(x, dict):
        return {"pairs": [[_packed(k), _packed(v)] for k, v in x.items()]}
    if type(x).__name__ in KINDS:
        return {"kind": type(x).__name__, "parts": {k: _packed(v) for k, v in sorted(vars(x).items())}}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    raise TypeError(f"{type(x).__name__} can't be saved")


def _unpacked(x):
    if isinstance(x, list):
        return [_unpacked(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "array" in x:
        return np.array(x["array"], x["dtype"]).reshape(x["shape"])
    if "tuple" in x:
        return tuple(_unpacked(v) for v in x["tuple"])
    if "pairs" in x:
        return {_unpacked(k): _unpacked(v) for k, v in x["pairs"]}
    out = object.__new__(KINDS[x["kind"]])
    vars(out).update({k: _unpacked(v) for k, v in x["parts"].items()})
    return out


def needs(model) -> list[str]:
    """The columns that a fitted model reads."""
    if isinstance(model, BoostedTrees):
        return list(model.features)
    return list(dict.fromkeys((model.all if isinstance(model, Monitor) else model)._columns()))


def save(spark: SparkSession, model, path: str) -> str:
    """Write a fitted model, whose size its settings give, not the rows, and return its digest. A path is written once."""
    if not hasattr(model.all if isinstance(model, Monitor) else model, "models"):
        raise ValueError("fit the model first")
    body, columns = json.dumps(_packed(model)), needs(model)
    digest = hashlib.sha256(json.dumps([columns, body]).encode()).hexdigest()
    spark.createDataFrame([(digest, columns, body)], "digest string, columns array<string>, body string").coalesce(1).write.parquet(path)
    return digest


def load(spark: SparkSession, path: str, digest: str | None = None):
    """The model of a file; one that was changed, or has another digest than the one asked for, is refused."""
    rows = spark.read.parquet(path).limit(2).collect()  # one row, by ``save``
    if len(rows) != 1:
        raise Damaged(f"{path} holds {len(rows)} models")
    r = rows[0]
    if hashlib.sha256(json.dumps([list(r["columns"]), r["body"]]).encode()).hexdigest() != r["digest"]:
        raise Damaged(f"{path} is not as it was saved")
    if digest and r["digest"] != digest:
        raise Damaged(f"{path} holds {r['digest']}, not {digest}")
    return _unpacked(json.loads(r["body"]))


def apply(model, rows: DataFrame, **how) -> DataFrame:
    """The model's ``score`` of rows that must have its columns; nothing is fitted."""
    missing = [c for c in needs(model) if c not in rows.columns]
    if missing:
        raise Damaged(f"no columns {missing}")
    return model.score(rows, **how)


def reproduction(now: DataFrame, then: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """(n, n_missing, n_more, worst): how far scores are from those kept with the model. A null differs from any score.

    ``worst`` is null where no row is in both with a score on both sides.
    """
    a = now.select(*keys, F.col(score).alias("__now"), F.lit(1).alias("__a"))
    b = then.select(*keys, F.col(score).alias("__then"), F.lit(1).alias("__b"))
    both = a.join(b, keys, "full")
    known = F.col("__now").isNotNull() & F.col("__then").isNotNull()
    unlike = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__now").isNull() != F.col("__then").isNull())
    return both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("__a").isNull() | (unlike & F.col("__now").isNull())).alias("n_missing"),
        F.count_if(F.col("__b").isNull() | (unlike & F.col("__then").isNull())).alias("n_more"),
        F.max(F.when(known, F.abs(F.col("__now") - F.col("__then")))).alias("worst"),
    )


def must_reproduce(now: DataFrame, then: DataFrame, keys: list[str], within: float = 0.0, score: str = "score") -> None:
    """Fail before anything new is scored, if a frozen model's scores of known rows are not those kept with it."""
    r = reproduction(now, then, keys, score).first()
    if r["n"] == 0 or r["n_missing"] or r["n_more"] or r["worst"] is None or not r["worst"] <= within:
        raise Damaged(f"scores are not those kept with the model: {r.asDict()}")


def by_arm(evals: DataFrame, arms: dict[str, DataFrame]) -> DataFrame:
    """``evals (uid, t, ...)`` with a score column per arm, from (uid, t, score); rows that some arm lacks are left out."""
    out = evals
    for name, scores in arms.items():
        out = out.join(scores.select("uid", "t", F.col("score").alias(name)).where(F.col(name).isNotNull()), ["uid", "t"])
    return out


def evaluation(scored: DataFrame, arms: list[str], n: int, seed: int, unit: str = "uid") -> DataFrame:
    """(set, scorer, point, lo, hi, n_skipped): each arm's AUROC per checkpoint and their mean.

    Intervals resample runs, as runs of a corpus of its own share no tasks. Where too many resamples
    lack a class, as with a single healthy run, an interval is undefined: its ends are null.
    """
    values = scratch.cut(bootstrap.replicates(scored, n, seed, unit=unit, scorers=tuple(arms)))  # a row per replicate, read several times
    return bootstrap.intervals(values, n, strict=False)


def over_models(scores: DataFrame, by: str = "model") -> DataFrame:
    """(model, headline): the mean over checkpoints of each fit's AUROC; null for a fit that lacks one at some checkpoint."""
    per = metrics.auroc(scores, [by, "t"])
    return per.groupBy(by).agg(F.when(F.count("auroc") == F.count("*"), F.avg("auroc")).alias("headline"))


def headline_spread(headlines: DataFrame) -> DataFrame:
    """(draws, median, least, most) over fits that have a headline."""
    v = F.col("headline")
    return headlines.agg(F.count(v).alias("draws"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"))


def median_fit(headlines: DataFrame, by: str = "model") -> DataFrame:
    """The fit at place floor(n / 2) of those with a headline, in its order, ties by name: one that was fitted."""
    return decisions.upper_median(headlines.where("headline IS NOT NULL").withColumn("__all", F.lit(0)), "headline", ["__all"], by).drop("__all")


def draws_evaluation(scores: DataFrame, n: int, seed: int, by: str = "model", unit: str = "uid") -> DataFrame:
    """The spread over fits, and the intervals of the median fit (of the test side only): ``scores`` has model, uid, t, y, score."""
    kept = scratch.cut(scores)
    headlines = scratch.cut(over_models(kept, by))
    middle = kept.join(F.broadcast(median_fit(headlines, by).select(by)), by, "left_semi")  # one row
    return evaluation(middle, ["score"], n, seed, unit).crossJoin(F.broadcast(headline_spread(headlines)))
