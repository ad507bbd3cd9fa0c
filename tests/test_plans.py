"""The catalogue against DuckDB, models, monitors, judges, streams, and the driver contract."""

import math
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import judge, monitor
from tracewell.plans import audits, catalog, experiments, fitted  # noqa: F401  all three add to the catalogue
from tracewell.streaming import alarms

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    out = []
    for r in rows:
        d = dict(zip(columns, r))
        out.append(tuple(None if d[c] is None or (isinstance(d[c], float) and math.isnan(d[c])) else round(float(d[c]), 5) if isinstance(d[c], (int, float)) and not isinstance(d[c], bool) else d[c] for c in sorted(columns)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), columns)


def test_the_contract_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert callable(e.entry)


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_lives_without_the_corpus_operators(tmp_path, pipeline):
    here = Path(__file__).parent.parent
    shutil.copytree(here / "tracewell", tmp_path / "tracewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if (here / name).exists():
            shutil.copy(here / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def signals(spark, seed, n, broken=False, steps=8):
    rng = np.random.default_rng(seed)
    return [(f"{'b' if broken else 'h'}{k}", i, float(np.sin(i) + rng.normal() * 0.1 + (3.0 if broken and i >= 4 else 0.0)), float(rng.normal())) for k in range(n) for i in range(steps)]


def test_the_monitor_keeps_its_contract(spark):
    schema = "uid string, step_idx int, a double, b double"
    healthy = spark.createDataFrame(signals(spark, 1, 20), schema)
    m = monitor.Monitor({"x": ["a"], "y": ["b"]}, reservoirs=2).fit(healthy)
    both = spark.createDataFrame(signals(spark, 2, 10) + signals(spark, 3, 10, broken=True), schema)
    scores = m.score(both).toPandas()
    assert (scores.score >= 0).all() and (scores[scores.step_idx < monitor.WASHOUT].score == 0).all()
    assert np.allclose(scores.score, scores[["x", "y"]].max(axis=1))
    top = scores.groupby("uid").score.max()
    assert top[top.index.str.startswith("b")].min() > top[top.index.str.startswith("h")].max()
    part = m.score(both.where("step_idx < 6")).toPandas().set_index(["uid", "step_idx"]).score
    whole = scores.set_index(["uid", "step_idx"]).score
    assert np.allclose(part, whole.loc[part.index])


def test_prompts_are_filled_once(spark):
    df = spark.createDataFrame([("cost $trace", "paid $172 to $task")], "task string, trace string")
    assert df.select(judge.prompt("A $task B ${trace} C $$5", F.col("task"), F.col("trace"))).first()[0] == "A cost $trace B paid $172 to $task C $5"


def test_only_missing_prompts_are_asked_and_failures_tried_again(spark, tmp_path):
    rows = [("j", "m", "h", f"u{k}", 2, s, f"p{k}") for k in range(3) for s in range(2)]
    prompts = spark.createDataFrame(rows, "judge string, model string, prompt_hash string, uid string, t int, sample int, prompt string")
    cached = prompts.where("uid = 'u0'").select("judge", "model", "prompt_hash", "uid", "t", "sample", F.expr("named_struct('text', '9', 'input_tokens', 1L, 'output_tokens', 1L, 'latency_s', 0.1D)").alias("response"))
    flag = str(tmp_path / "failed")

    def client(p):
        if p == "p0":
            raise AssertionError("cached")
        if p == "p1" and not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("busy")
        return {"text": "50" if p == "p1" else "none", "input_tokens": 1, "output_tokens": 1}

    got = {r["uid"]: (r["score"], r["n_failed"]) for r in judge.mean_scores(judge.collect_scores(prompts, cached, client)).collect()}
    assert got == {"u0": (9.0, 0), "u1": (50.0, 0), "u2": (None, 2)}


def test_late_and_repeated_steps_change_nothing(spark, tmp_path):
    schema = "uid string, step_idx int, tool_name string, args string, tool_error boolean, latency_s double"
    rng = random.Random(3)
    rows = [("u", i, rng.choice(["a", None]), "{}", rng.random() < 0.3, rng.random() * 10) for i in range(20)]
    for k, part in enumerate([rows[:8], rows[4:14], rows[:3] + rows[14:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/s/{k}")
    for k in range(3):  # one file per batch, in this order
        for f in os.listdir(f"{tmp_path}/s/{k}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/in", exist_ok=True)
                os.rename(f"{tmp_path}/s/{k}/{f}", f"{tmp_path}/in/{k}.parquet")
                os.utime(f"{tmp_path}/in/{k}.parquet", (1e9 + k, 1e9 + k))
    stream = alarms.score_stream(alarms.replay(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema), 5.0)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("step_idx").collect()
    assert [r["step_idx"] for r in got] == list(range(20))
    top = list(np.maximum.accumulate([r[5] for r in rows]))
    assert [r["running_max"] for r in got] == pytest.approx(top)
    assert [r["step_idx"] for r in got if r["first_alarm"]] == [next(i for i, r in enumerate(rows) if r[5] > 5.0)]
