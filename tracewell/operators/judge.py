"""Judging runs by a language model: prompts, cached calls, and scores."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import canonical_json, forbidden_hits, parse_score
from tracewell.operators.metrics import running_totals
from tracewell.sources.episodes import CACHE_KEY, new_responses


def render_traces(steps: DataFrame, t: int) -> DataFrame:
    """(uid, trace) of steps 0 to t: calls with results, or the model's text for a step without one."""
    failed = F.when(F.col("tool_error"), " (error)").otherwise("")
    call = F.concat(F.lit("  tool call: "), "tool_name", F.lit("("), F.coalesce(canonical_json(F.col("args")), F.lit("null")), F.lit(")\n  tool result"), failed, F.lit(": "), F.coalesce("result", F.lit("")))
    said = F.concat(F.lit("  model: "), F.coalesce("text", F.lit("")))
    # The lines of a prompt. Arguments are compact JSON with sorted keys, so scores that
    # were cached for prompts rendered otherwise don't count for these.
    line = F.concat(F.lit("Step "), (F.col("step_idx") + 1).cast("string"), F.lit(":\n"), F.when(F.col("tool_name").isNotNull(), call).otherwise(said))
    rows = steps.where(F.col("step_idx") <= t).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("step_idx", line.alias("line")))).alias("lines"))
    return rows.select("uid", F.concat_ws("\n", F.transform("lines", lambda x: x["line"])).alias("trace"))


def prompt(template: str, task: Column, trace: Column) -> Column:
    """The template with $task and $trace filled in. It is split once, so values stay as they are."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\$(\$|\{?(task|trace)\}?)", template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(F.lit("$") if m[1] == "$" else {"task": task, "trace": trace}[m[2]])
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def prompt_hash(template: str) -> str:
    return hashlib.sha256(template.encode()).hexdigest()


def template_of(text: str) -> str:
    return text.replace("\r\n", "\n")


def leaking_prompts(prompts: DataFrame) -> DataFrame:
    """Prompts with a word that gives a label away."""
    return prompts.withColumn("hits", forbidden_hits(F.col("prompt"))).where(F.size("hits") > 0)


def call_judge(prompts: DataFrame, client: Callable[[str], dict], tries: int = 3, wait: float = 0.0) -> DataFrame:
    """Ask ``client`` for each prompt (with its cache key); it returns text, input_tokens, output_tokens.

    A call that fails is tried again, with longer and longer pauses, and fails the task in the end.
    """
    key = ", ".join(f"{k} {'int' if k in ('t', 'sample') else 'string'}" for k in CACHE_KEY)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            responses = []
            for p in f["prompt"]:
                for attempt in range(tries):
                    began = time.monotonic()
                    try:
                        r = client(p)
                        break
                    except OSError:
                        if attempt + 1 == tries:
                            raise
                        time.sleep(wait * 2**attempt)
                responses.append({"text": r["text"], "input_tokens": r.get("input_tokens"), "output_tokens": r.get("output_tokens"), "latency_s": time.monotonic() - began})
            yield f[list(CACHE_KEY)].assign(response=responses)

    return prompts.select(*CACHE_KEY, "prompt").mapInPandas(ask, f"{key}, response struct<text: string, input_tokens: long, output_tokens: long, latency_s: double>")


def collect_scores(prompts: DataFrame, cached: DataFrame, client: Callable[[str], dict], save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Responses to all prompts, of which only those that the cache lacks are asked for.

    Calls may cost money: ``save`` should write the frame once (``scratch.cut``), so that using the
    scores and adding them to the cache don't ask twice.
    """
    missing = prompts.join(cached.select(*CACHE_KEY), list(CACHE_KEY), "left_anti")
    asked = save(new_responses(cached, call_judge(missing, client)))
    return prompts.join(cached.select(*CACHE_KEY, "response").unionByName(asked.select(*CACHE_KEY, "response")), list(CACHE_KEY))


def mean_scores(responses: DataFrame, by=("uid", "t")) -> DataFrame:
    """The mean of the samples that parse, and how many did not; null if none does."""
    s = responses.withColumn("score", parse_score(F.col("response.text")))
    return s.groupBy(*by).agg(F.avg("score").alias("score"), F.count_if(F.col("score").isNull()).alias("n_failed"), F.count("*").alias("n"), F.stddev_samp("score").alias("sd"))


def run_summary(scores: DataFrame) -> DataFrame:
    """Parse failures, and how far repeated samples agree."""
    return scores.agg(F.sum("n_failed").alias("n_failed"), F.sum("n").alias("n"), F.avg((F.col("sd") == 0).cast("int")).alias("same_share"), F.percentile("sd", 0.5).alias("sd_median"))


def spent(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """What the calls cost, per token in and out."""
    return calls.agg(F.coalesce(F.sum(F.col("input_tokens") * price_in + F.col("output_tokens") * price_out), F.lit(0.0)).alias("spent"), F.count("*").alias("n"))


def under_budget(calls: DataFrame, cost: str, cap: float, order: str) -> DataFrame:
    """The first calls in the order of a column whose running cost stays within the cap."""
    counts = calls.groupBy(F.col(order).alias("__o")).agg(F.sum(cost).alias("__c"))
    total = running_totals(counts.withColumn("__o", F.col("__o").cast("double")), [], "__o", ["__c"])
    fits = total.where(F.col("__c_below") + F.col("__c") <= cap).select("__o")
    return calls.join(fits, calls[order].cast("double") == fits["__o"], "left_semi")


class OverBudget(RuntimeError):
    """A task that would pay for calls again, more often than was set aside for it."""


_KEYS = ", ".join(f"{k} {'int' if k in ('t', 'sample') else 'string'}" for k in CACHE_KEY)
_RESPONSE = "response struct<text: string, input_tokens: long, output_tokens: long, latency_s: double>"


def _paid_once(prompts: DataFrame, client: Callable[[str], dict], attempts: int) -> DataFrame:
    """Answers to (key, prompt, most), a call each; a failed call fails the task, and a task has ``attempts`` at most."""
    from pyspark import TaskContext

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().attemptNumber()
        if attempt >= attempts:
            raise OverBudget(f"attempt {attempt + 1} of a task whose budget is for {attempts}")
        for f in frames:
            responses = []
            for p in f["prompt"]:
                began = time.monotonic()
                r = client(p)
                responses.append({"text": r["text"], "input_tokens": r.get("input_tokens"), "output_tokens": r.get("output_tokens"), "latency_s": time.monotonic() - began})
            yield f[[*CACHE_KEY, "most"]].assign(response=responses, attempt=attempt)

    return prompts.select(*CACHE_KEY, "prompt", "most").mapInPandas(ask, f"{_KEYS}, most double, {_RESPONSE}, attempt int")


def judged_within(prompts: DataFrame, client: Callable[[str], dict], path: str, cap: float, price_in: float, price_out: float, most_out: int, order: str, attempts: int = 2, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(answers, prompts left): calls in the order of a numeric column, as many as a cap on what they cost allows.

    Calls stop before the cap, not after it. A round takes the first prompts whose greatest cost (as
    many tokens as the prompt has bytes, and ``most_out`` out), for every attempt that a task may have,
    fits into what is left; prompts that tie in the order go together. That amount is written to
    ``path`` before the round's first call, and the answers are before the next round, in which what
    they did not cost is there again. Attempts before the one that answered count at their greatest
    cost, and a round that was begun and never finished counts whole, so a query that runs again on the
    same path goes on with what is left. A task reads a checkpoint, not a shuffle, so no stage runs
    again, and no more attempts than were set aside for make calls; speculative copies of tasks are
    refused. A path is for one query at a time. Keys are asked for once, prompts without a place or a
    text, or with a null in their key, not at all.
    """
    from tracewell.plans import scratch

    spark = prompts.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        raise ValueError("speculative tasks would pay twice; turn spark.speculation off")
    keys = list(CACHE_KEY)
    each = (F.octet_length("prompt") * F.lit(float(price_in)) + F.lit(float(most_out * price_out))).alias("most")
    asked = prompts.select(*keys, "prompt", F.col(order).cast("double").alias("place"), each).dropna().dropDuplicates(keys)
    wanted = scratch.cut(asked.withColumn("reserved", F.col("most") * attempts))

    def written(name: str, schema: str) -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(schema).parquet(f"{path}/{name}/*") if there else spark.createDataFrame([], schema)

    def journal() -> tuple[DataFrame, DataFrame]:
        return written("begun", "round int, amount double"), written("answers", f"round int, {_KEYS}, {_RESPONSE}, attempt int, cost double")

    for _ in range(rounds):
        begun, done = journal()
        lost = begun.join(done.select("round").distinct(), "round", "left_anti").agg(F.coalesce(F.sum("amount"), F.lit(0.0))).first()[0]
        left = cap - lost - done.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]
        now = scratch.cut(under_budget(wanted.join(done.select(*keys), keys, "left_anti"), "reserved", left, "place"))
        r = now.agg(F.count("*").alias("n"), F.sum("reserved").alias("amount")).first()
        if not r["n"]:
            break
        k = (begun.agg(F.max("round")).first()[0] or 0) + 1
        spark.createDataFrame([(k, r["amount"])], "round int, amount double").coalesce(1).write.parquet(f"{path}/begun/{k}")
        paid = F.col("response.input_tokens") * F.lit(float(price_in)) + F.col("response.output_tokens") * F.lit(float(price_out))
        cost = F.coalesce(paid, "most") + F.col("attempt") * F.col("most")
        _paid_once(now, client, attempts).select(F.lit(k).alias("round"), *keys, "response", "attempt", cost.alias("cost")).write.parquet(f"{path}/answers/{k}")
    _, done = journal()
    return done, prompts.join(done.select(*keys), keys, "left_anti")


def label_invariant(prompts: DataFrame, relabelled: DataFrame, keys=("uid", "t")) -> DataFrame:
    """Prompts that differ when only the labels of their runs do: there should be none."""
    other = relabelled.select(*keys, F.col("prompt").alias("__other"))
    return prompts.join(other, list(keys)).where(F.col("prompt") != F.col("__other")).select(*keys)


def preflight(prompts: DataFrame, context_tokens: int, chars_per_token: float = 3.0) -> DataFrame:
    """Per judge and model: prompts, the longest, those that may not fit the context, and those with words that give a label away."""
    long = F.length("prompt") / chars_per_token > context_tokens
    hits = F.size(forbidden_hits(F.col("prompt"))) > 0
    return prompts.groupBy("judge", "model").agg(F.count("*").alias("n"), F.max(F.length("prompt")).alias("longest"), F.count_if(long).alias("n_too_long"), F.count_if(hits).alias("n_leaking"))


def truncated(responses: DataFrame, context_tokens: int) -> DataFrame:
    """Responses whose prompt filled the context, so that its start may have been cut off."""
    return responses.where(F.col("response.input_tokens") >= context_tokens)


def content_key(template: str, model_digest: str) -> str:
    """The part of a cache key that changes with the prompt's text and with the model's weights."""
    return hashlib.sha256(f"{prompt_hash(template)}:{model_digest}".encode()).hexdigest()


def missing_scores(evals: DataFrame, scores: DataFrame) -> DataFrame:
    """Pairs without a score. One of a healthy run fails the query; those of failed runs are left out of sets."""
    gone = evals.join(scores.where("score is not null").select("uid", "t"), ["uid", "t"], "left_anti")
    # In a projection: a filter would move below the join and meet all runs.
    return gone.withColumn("uid", F.when(F.col("y") == 1, F.col("uid")).otherwise(F.raise_error(F.lit("a healthy run has no score"))))


def worst_case(evals: DataFrame, scores: DataFrame) -> DataFrame:
    """Missing scores as zero."""
    return evals.join(scores.select("uid", "t", "score"), ["uid", "t"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
