"""Monitors of step signals: predictors of healthy runs, and the CUSUM of their errors.

A monitor is fitted on healthy runs only. A channel of the signal has predictors, each a fixed map of a
run's past to states and a ridge readout of the next signal; a step's error is averaged over them, and
its score is the largest CUSUM over channels. Scores are not negative, those of the first ``WASHOUT``
steps are 0, and a step's score depends on nothing after it.

States don't depend on what is fitted, so any number of models that learn from different runs share
them: a run's normal equations are made once and added to those of each model that has the run, by one
matrix product per batch. Folds, repeats and draws of fit sets are so many models of one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WASHOUT = 3
#: Steps of runs that go through the predictors together, about, and steps times models that score them.
STEPS, SCORED = 20_000, 200_000


def whole_runs(frames: Iterator[pd.DataFrame], most: int | None = None) -> Iterator[pd.DataFrame]:
    """Frames of whole runs, of about ``most`` rows, ``STEPS`` if not given, from frames sorted by uid and step."""
    held: list[pd.DataFrame] = []
    most = most or STEPS
    for f in (f.iloc[a : a + most] for f in frames for a in range(0, len(f), most)):
        held.append(f)
        if sum(map(len, held)) >= most:
            rows = pd.concat(held) if len(held) > 1 else f
            # The last run may go on in the next frame.
            ended = (rows["uid"] != rows["uid"].iloc[-1]).to_numpy()
            if ended.any():
                yield rows[ended]
                held = [rows[~ended]]
            else:
                held = [rows]
    if held and sum(map(len, held)):
        yield pd.concat(held)


class Batch:
    """Runs side by side: ``x`` is (runs, steps, columns), zero after a run's end, where ``there`` is false."""

    def __init__(self, rows: pd.DataFrame, signal: np.ndarray):
        uid = rows["uid"].to_numpy()
        self.first = np.flatnonzero(np.append(True, uid[1:] != uid[:-1]))
        self.lengths = np.diff(np.append(self.first, len(uid)))
        self.run = np.repeat(np.arange(len(self.first)), self.lengths)
        self.at = np.arange(len(uid)) - np.repeat(self.first, self.lengths)
        self.there = np.arange(self.lengths.max())[None, :] < self.lengths[:, None]
        self.x = np.zeros((*self.there.shape, signal.shape[1]))
        self.x[self.run, self.at] = signal


def by_length(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a frame whose runs have similar lengths, so that one long run doesn't pad all others."""
    size = rows.groupby("uid", sort=False)["uid"].transform("size").to_numpy()
    kind = np.frexp(size)[1]
    for k in np.unique(kind):
        yield rows[kind == k]


class Reservoir:
    """A fixed random recurrent layer; a step's state has seen the steps before it, not the step itself."""

    def __init__(self, dim: int, seed: int, size: int = 32, radius: float = 0.9, leak: float = 0.5):
        rng = np.random.default_rng(seed)
        w = rng.normal(size=(size, size))
        self.w = w * radius / np.abs(np.linalg.eigvals(w)).max()
        self.win = rng.uniform(-1, 1, (size, dim + 1))
        self.leak, self.width = leak, size + 1

    def states(self, x: np.ndarray) -> np.ndarray:
        """(runs, steps, width) of (runs, steps, columns): one matrix product per step index."""
        out = np.ones((*x.shape[:2], self.width))
        h, into = np.zeros((len(x), len(self.w))), x @ self.win[:, :-1].T + self.win[:, -1]
        for t in range(x.shape[1]):
            out[:, t, :-1] = h
            h = (1 - self.leak) * h + self.leak * np.tanh(h @ self.w.T + into[:, t])
        return out


class Lag:
    """The step before, zero for the first, and a constant."""

    def __init__(self, dim: int, seed: int = 0):
        self.width = dim + 1

    def states(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((*x.shape[:2], self.width))
        out[:, 0, :-1] = 0
        out[:, 1:, :-1] = x[:, :-1]
        return out


class Monitors:
    """Monitors that learn from different runs, all at once.

    ``channels``: name -> signal columns. ``predictor(columns, seed)`` makes what has ``width`` and
    ``states``; ``repeats`` of it per channel are averaged. Models have names of any one type.
    """

    def __init__(self, channels: dict[str, list[str]], repeats: int = 8, seed: int = 1300, drift: float = 0.5, ridge: float = 1.0, predictor: Callable = Reservoir):
        self.channels, self.drift, self.ridge = channels, drift, ridge
        self.predictors = {name: [predictor(len(cs), seed + 97 * k + j) for j in range(repeats)] for k, (name, cs) in enumerate(channels.items())}

    def _columns(self) -> list[str]:
        return [c for cs in self.channels.values() for c in cs]

    def _clean(self, steps: DataFrame) -> DataFrame:
        x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self._columns()}
        return steps.select("uid", F.col("step_idx").cast("int").alias("step_idx"), *(v.alias(c) for c, v in x.items()))

    def _placed(self, steps: DataFrame, members: DataFrame | None) -> DataFrame:
        """Whole runs, in order, with the numbers of the models that they are for; without ``members``, of all."""
        rows = self._clean(steps)
        if members is not None:
            number = F.create_map(*(x for k, m in enumerate(self.models) for x in (F.lit(m), F.lit(k))))
            of = members.groupBy("uid").agg(F.sort_array(F.collect_set(number[F.col("model")])).alias("models"))
            rows = rows.join(of, "uid")
        return rows.repartition("uid").sortWithinPartitions("uid", "step_idx")

    def _batches(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Batch, np.ndarray]]:
        """(rows, batch, (runs, models) of booleans)."""
        # Many models make many rows of one: what a task holds is bounded by both.
        for whole in whole_runs(frames, max(1, min(STEPS, SCORED // max(1, len(self.models))))):
            for rows in by_length(whole):
                b = Batch(rows, np.nan_to_num((rows[self._columns()].to_numpy(float) - self.mean) / self.std))
                mine = np.ones((len(b.first), len(self.models)), bool)
                if "models" in rows:
                    mine[:] = False
                    for r, ks in enumerate(rows["models"].iloc[b.first]):
                        mine[r, list(ks)] = True
                yield rows, b, mine

    def _parts(self, x: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """Each channel's columns of a signal."""
        at = 0
        for name, cs in self.channels.items():
            yield name, x[..., at : at + len(cs)]
            at += len(cs)

    def fit(self, steps: DataFrame, members: DataFrame) -> "Monitors":
        """``steps`` has uid, step_idx and the signal columns; ``members`` are (model, uid): who learns from which healthy runs.

        Signals are scaled by all runs that any model learns from. Tasks add up normal equations per
        model; readouts are solved in tasks, too, and only they, of a size that models, channels and
        predictors give, come to the driver.
        """
        columns, me = self._columns(), self
        self.models = sorted(r[0] for r in members.select("model").distinct().collect())  # a name per model
        self.kind = dict(members.dtypes)["model"]
        if not self.models:
            return self
        learned = self._clean(steps).join(members.select("uid").distinct(), "uid", "left_semi")
        stats = learned.agg(*(f(c).alias(f"{n}_{c}") for c in dict.fromkeys(columns) for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).first()
        self.mean, self.std = (np.array([stats[f"{n}_{c}"] or default for c in columns]) for n, default in (("mean", 0.0), ("std", 1.0)))
        placed = self._placed(steps, members)

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple[str, int], np.ndarray] = {}
            for _, b, mine in me._batches(frames):
                for name, x in me._parts(b.x):
                    for j, p in enumerate(me.predictors[name]):
                        s = p.states(x) * b.there[:, :, None]
                        own = np.matmul(s.transpose(0, 2, 1), np.concatenate([s, x], axis=2))  # a run's equations
                        total[name, j] = total.get((name, j), 0) + mine.T.astype(float) @ own.reshape(len(own), -1)
            rows = [(k, name, j, v.tolist()) for (name, j), m in total.items() for k, v in enumerate(m)]
            yield pd.DataFrame(rows, columns=["k", "name", "j", "v"])

        def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, total = None, 0
            for f in frames:
                for k, name, j, v in zip(f["k"], f["name"], f["j"], f["v"]):
                    if (k, name, j) != key:
                        if key is not None:
                            yield me._readout(key, total)
                        key, total = (k, name, j), 0
                    total = total + np.asarray(v)
            if key is not None:
                yield me._readout(key, total)

        made = placed.mapInPandas(sums, "k int, name string, j int, v array<double>").repartition("k", "name", "j").sortWithinPartitions("k", "name", "j")
        self.readouts = {(r["k"], r["name"], r["j"]): np.array(r["w"]).reshape(self.predictors[r["name"]][r["j"]].width, -1) for r in made.mapInPandas(solved, "k int, name string, j int, w array<double>").collect()}

        def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, b, mine in me._batches(frames):
                late = b.there & (np.arange(b.there.shape[1]) >= WASHOUT)
                for name, x in me._parts(b.x):
                    run, k, e = me._errors(name, x, mine)
                    e, n = e * late[run], late.sum(1)[run]
                    yield pd.DataFrame({"name": name, "k": k, "n": n, "s": e.sum(1), "ss": (e * e).sum(1)})

        added = placed.mapInPandas(errors, "name string, k int, n long, s double, ss double").groupBy("name", "k").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).collect()
        self.scale = {(name, k): (0.0, 1.0) for name in self.channels for k in range(len(self.models))}
        for r in added:
            if r["n"]:
                mean = r["s"] / r["n"]
                self.scale[r["name"], r["k"]] = mean, float(np.sqrt(max(r["ss"] / r["n"] - mean * mean, 0.0))) or 1.0
        return self

    def _readout(self, key: tuple, total: np.ndarray) -> pd.DataFrame:
        k, name, j = key
        n = self.predictors[name][j].width
        both = total.reshape(n, -1)
        w = np.linalg.solve(both[:, :n] + self.ridge * np.eye(n), both[:, n:])
        return pd.DataFrame({"k": [k], "name": [name], "j": [j], "w": [w.ravel().tolist()]})

    def _errors(self, name: str, x: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, model, (pairs, steps) of errors): the mean over predictors of the distance to the next signal."""
        run, k = np.nonzero(mine)
        out = np.zeros((len(run), x.shape[1]))
        for j, p in enumerate(self.predictors[name]):
            s = p.states(x)
            for m in np.unique(k):
                at = k == m
                missed = x[run[at]] - s[run[at]] @ self.readouts[m, name, j]
                out[at] += np.sqrt((missed**2).mean(2))
        return run, k, out / len(self.predictors[name])

    def score(self, steps: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """(model, uid, step_idx, score, one column per channel) for ``pairs (model, uid)``; without them, of all models and runs."""
        names, me = list(self.channels), self

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows, b, mine in me._batches(frames):
                streams = {}
                for name, x in me._parts(b.x):
                    pair_run, k, e = me._errors(name, x, mine)
                    mean, std = (np.array([me.scale[name, m][i] for m in k])[:, None] for i in (0, 1))
                    z, level = (e - mean) / std - me.drift, np.zeros(len(k))
                    z[:, :WASHOUT] = 0
                    for t in range(z.shape[1]):
                        level = np.maximum(0.0, level + z[:, t]) if t >= WASHOUT else level
                        z[:, t] = level
                    streams[name] = z
                uid, idx = rows["uid"].to_numpy(), rows["step_idx"].to_numpy()
                n = b.lengths[pair_run]
                pair = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
                row = b.first[pair_run[pair]] + at
                own = {name: z[pair, at] for name, z in streams.items()}
                yield pd.DataFrame({"model": [me.models[m] for m in k[pair]], "uid": uid[row], "step_idx": idx[row], "score": np.max(list(own.values()), axis=0), **own})

        schema = f"model {self.kind}, uid string, step_idx int, score double" + "".join(f", `{n}` double" for n in names)
        if not self.models:
            return steps.sparkSession.createDataFrame([], schema)
        return self._placed(steps, pairs).mapInPandas(run, schema)


class Monitor:
    """One monitor: ``fit`` on healthy runs, then ``score``. ``reservoirs`` per channel are averaged."""

    def __init__(self, channels: dict[str, list[str]], reservoirs: int = 8, seed: int = 1300, drift: float = 0.5, predictor: Callable = Reservoir):
        self.all = Monitors(channels, reservoirs, seed, drift, predictor=predictor)

    def fit(self, healthy: DataFrame) -> "Monitor":
        """``healthy`` has uid, step_idx and the signal columns, of any number of runs."""
        self.all.fit(healthy, healthy.select(F.lit(0).alias("model"), "uid").distinct())
        return self

    def score(self, steps: DataFrame) -> DataFrame:
        """(uid, step_idx, score, one column per channel)."""
        return self.all.score(steps).drop("model")


def episode_scores(scores: DataFrame, theta: float) -> DataFrame:
    """(uid, episode_score, alarm_step): the highest score, and the first above theta."""
    return scores.groupBy("uid").agg(F.max("score").alias("episode_score"), F.min(F.when(F.col("score") > theta, F.col("step_idx"))).alias("alarm_step"))


def carried_forward(steps: DataFrame, columns: list[str], step: int) -> DataFrame:
    """The signal of one step replaced by that of the step before."""
    from tracewell.operators.steps import in_run

    return steps.withColumns({c: F.when(F.col("step_idx") == step, F.coalesce(F.lag(c).over(in_run()), c)).otherwise(F.col(c)) for c in columns})


def logprob_coverage(steps: DataFrame) -> DataFrame:
    """The share of steps with log probabilities."""
    return steps.agg(F.avg((F.coalesce(F.size("token_logprobs"), F.lit(0)) > 0).cast("int")).alias("coverage"))
