"""Paid calls stop before their cap, also where tasks are tried again or a run was cut off."""

import os

import pytest
from pyspark.sql import functions as F

from tracewell.operators import judge

KEY = "judge string, model string, prompt_hash string, uid string, t int, sample int, prompt string, place int"


def prompts(spark, n):
    return spark.createDataFrame([("j", "m", "h", f"u{k:03}", 1, 0, "x" * (10 + k % 3), k) for k in range(n)], KEY).repartition(4)


def counted(folder, fail=None):
    """A client that leaves a file per call, and fails once at a prompt of a given length."""
    os.makedirs(folder, exist_ok=True)

    def client(p):
        import uuid

        open(f"{folder}/{len(p)}-{uuid.uuid4().hex}", "w").close()
        if fail == len(p) and not os.path.exists(f"{folder}.failed"):
            open(f"{folder}.failed", "w").close()
            raise OSError("busy")
        return {"text": "50", "input_tokens": len(p) // 2, "output_tokens": 1}

    return client


def test_calls_go_in_order_until_the_cap(spark, tmp_path):
    n = 60
    answers, left = judge.judged_within(prompts(spark, n), counted(f"{tmp_path}/calls"), f"{tmp_path}/p", cap=250.0, price_in=1.0, price_out=1.0, most_out=4, order="place", attempts=1)
    got = {r["uid"]: r["cost"] for r in answers.collect()}
    # A call costs half its prompt and one; the first that don't fit by their greatest cost end it.
    assert sorted(got) == [f"u{k:03}" for k in range(len(got))]
    assert got == {f"u{k:03}": (10 + k % 3) // 2 + 1.0 for k in range(len(got))}
    assert sum(got.values()) <= 250 < sum(got.values()) + 10 + len(got) % 3 + 4
    assert len(os.listdir(f"{tmp_path}/calls")) == len(got) < n
    assert {r["uid"] for r in left.collect()} == {f"u{k:03}" for k in range(len(got), n)}
    # Again on the same path: nothing is asked; with a higher cap, only what is left.
    judge.judged_within(prompts(spark, n), counted(f"{tmp_path}/calls"), f"{tmp_path}/p", 250.0, 1.0, 1.0, 4, "place", attempts=1)
    assert len(os.listdir(f"{tmp_path}/calls")) == len(got)
    answers, left = judge.judged_within(prompts(spark, n), counted(f"{tmp_path}/calls"), f"{tmp_path}/p", 10_000.0, 1.0, 1.0, 4, "place", attempts=1)
    assert (answers.count(), left.count(), len(os.listdir(f"{tmp_path}/calls"))) == (n, 0, n)


def test_a_round_that_never_ended_counts_whole(spark, tmp_path):
    spark.createDataFrame([(1, 240.0)], "round int, amount double").write.parquet(f"{tmp_path}/p/begun/1")
    answers, _ = judge.judged_within(prompts(spark, 30), counted(f"{tmp_path}/calls"), f"{tmp_path}/p", 250.0, 1.0, 1.0, 4, "place", attempts=1)
    assert answers.count() == len(os.listdir(f"{tmp_path}/calls")) == 0
    answers, _ = judge.judged_within(prompts(spark, 30), counted(f"{tmp_path}/calls"), f"{tmp_path}/p", 260.0, 1.0, 1.0, 4, "place", attempts=1)
    assert answers.select("round").distinct().count() == 1
    assert answers.count() == 1


def test_failed_tasks_fail_the_query_where_no_attempt_was_paid_for(spark, tmp_path):
    # Local masters try a task once: what is written before the calls still counts in the next run.
    ask = lambda cap: judge.judged_within(prompts(spark, 12), counted(f"{tmp_path}/calls", fail=11), f"{tmp_path}/p", cap, 1.0, 1.0, 4, "place", attempts=2)
    with pytest.raises(Exception, match="busy"):
        ask(400.0)
    reserved = spark.read.parquet(f"{tmp_path}/p/begun/*").first()["amount"]
    assert reserved == 2 * sum(14 + k % 3 for k in range(12))
    before = len(os.listdir(f"{tmp_path}/calls"))
    answers, left = ask(400.0)
    spent = answers.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
    assert spent + reserved <= 400
    assert len(os.listdir(f"{tmp_path}/calls")) - before == answers.count()
    assert answers.count() + left.count() == 12


def test_nothing_to_ask(spark, tmp_path):
    answers, left = judge.judged_within(prompts(spark, 3).where("false"), counted(f"{tmp_path}/calls"), f"{tmp_path}/p", 10.0, 1.0, 1.0, 4, "place")
    assert (answers.count(), left.count()) == (0, 0)
