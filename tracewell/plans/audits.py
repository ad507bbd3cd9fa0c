"""Queries of data audits, and of readers and writers by a round trip through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.operators import audit, monitor, steps
from tracewell.plans import scratch
from tracewell.plans.catalog import _t, episodes_of, on_scores, on_steps, query, r6
from tracewell.sources import episodes, events


@on_steps("family_summary", "SELECT family, count(*) AS n_runs, count(DISTINCT task_group) AS n_groups, 0 AS n_unknown, count(*) FILTER (task_group IN (SELECT task_group FROM runs GROUP BY 1 HAVING count(DISTINCT family) > 1)) AS n_shared FROM runs GROUP BY family")
def _(runs, rows):
    return audit.family_summary(runs)


@on_steps("onset_audit", "SELECT coalesce(failure_class, 'none') AS failure_class, count(*) AS n, round(avg(tau), 6) AS tau_mean, round(stddev_samp(tau), 6) AS tau_std, round(avg(CAST(tau = 2 AS INTEGER)), 6) AS share_early, round(avg(len), 6) AS len_mean, round(stddev_samp(len), 6) AS len_std FROM runs GROUP BY 1")
def _(runs, rows):
    out = audit.onset_audit(runs)
    return out.select("failure_class", "n", *(r6(c, c) for c in ("tau_mean", "tau_std", "share_early", "len_mean", "len_std")))


@on_steps("length_by_label", "SELECT corpus, failure_class IS NULL AS healthy, count(len) AS count, round(avg(len), 6) AS mean, round(quantile_cont(len, 0.25), 6) AS q25, round(median(len), 6) AS q50, round(quantile_cont(len, 0.75), 6) AS q75 FROM runs GROUP BY 1, 2")
def _(runs, rows):
    out = audit.describe(runs.withColumn("healthy", F.col("failure_class").isNull()), "len", ["corpus", "healthy"])
    return out.select("corpus", "healthy", "count", *(r6(c, c) for c in ("mean", "q25", "q50", "q75")))


@on_steps("stats_by_class", "SELECT coalesce(failure_class, 'none') AS class, count(*) AS n, round(avg(latency_s), 6) AS latency, round(avg(output_tokens), 6) AS tokens, round(avg(CAST(tool_error AS INTEGER)), 6) AS error_share FROM steps JOIN runs USING (uid) GROUP BY 1")
def _(runs, rows):
    j = rows.join(runs.select("uid", "failure_class"), "uid").groupBy(F.coalesce("failure_class", F.lit("none")).alias("class"))
    return j.agg(F.count("*").alias("n"), r6(F.avg("latency_s"), "latency"), r6(F.avg("output_tokens"), "tokens"), r6(F.avg(F.col("tool_error").cast("int")), "error_share"))


@on_steps("tool_evidence", "SELECT family, count(*) AS n, round(avg(CAST(tool_error AS INTEGER)), 6) AS error, round(avg(CAST(result LIKE ' Error%' AS INTEGER)), 6) AS said_error, round(avg(CAST(coalesce(step_idx = tau, false) AS INTEGER)), 6) AS at_onset FROM steps JOIN runs USING (uid) WHERE tool_name IS NOT NULL GROUP BY family")
def _(runs, rows):
    j = rows.where("tool_name IS NOT NULL").join(runs.select("uid", "family", "tau"), "uid")
    out = audit.shares(j, ["family"], {"error": F.col("tool_error"), "said_error": scalars.starts_with_error(F.col("result")), "at_onset": F.col("step_idx") == F.col("tau")})
    return out.select("family", "n", *(r6(c, c) for c in ("error", "said_error", "at_onset")))


@on_steps("latency_anatomy", "SELECT step_idx, coalesce(tool_name, 'none') AS action, coalesce(step_idx >= tau, false) AS label, count(*) AS n, round(avg(CAST(latency_s < 5 AS INTEGER)), 6) AS fast FROM steps JOIN runs USING (uid) WHERE step_idx <= 4 GROUP BY 1, 2, 3")
def _(runs, rows):
    j = rows.where("step_idx <= 4").join(runs.select("uid", "tau", "failure_class"), "uid")
    j = j.select(F.col("step_idx").cast("long").alias("step_idx"), F.coalesce("tool_name", F.lit("none")).alias("action"), scalars.step_label(F.col("failure_class"), F.col("tau"), F.col("step_idx")).alias("label"), "latency_s")
    return audit.shares(j, ["step_idx", "action", "label"], {"fast": F.col("latency_s") < 5}).withColumn("fast", r6("fast", "fast"))


@on_steps("cost_table", "SELECT tool_name, round(median(latency_s), 6) AS p50, round(quantile_cont(latency_s, 0.95), 6) AS p95, round(avg(output_tokens), 6) AS output_tokens, round(avg(1 * 0.5 + output_tokens * 0.25), 6) AS cost, round(sum(1 * 0.5 + output_tokens * 0.25), 3) AS spent FROM steps GROUP BY tool_name")
def _(runs, rows):
    out = audit.cost_table(rows.withColumn("input_tokens", F.lit(1.0)), 0.5, 0.25, ["tool_name"])
    return out.select("tool_name", *(r6(c, c) for c in ("p50", "p95", "output_tokens", "cost")), F.round("spent", 3).alias("spent"))


@query("key_sets", "SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return audit.key_sets(_t("events")(spark, sf), "props")


@query("truthy_keys", "SELECT 'k' AS key, count(json_extract_string(props, '$.k')) AS n_there, count(*) FILTER (json_extract_string(props, '$.k') NOT IN ('', 'false', '0', '0.0', 'null')) AS n_true FROM events UNION ALL SELECT 'label', 0, 0")
def _(spark, sf):
    return audit.truthy_keys(_t("events")(spark, sf), "props", ["k", "label"])


@on_steps("logprob_coverage", "SELECT round(avg(CAST(CASE WHEN tool_name IS NULL THEN length(text) > 8 ELSE false END AS INTEGER)), 6) AS coverage FROM steps")
def _(runs, rows):
    said = F.when(F.col("tool_name").isNull() & (F.length("text") > 8), F.array(F.lit(-1.0)))
    return monitor.logprob_coverage(rows.withColumn("token_logprobs", said)).select(r6("coverage", "coverage"))


@on_steps("surprisal", "SELECT uid, step_idx, round(latency_s * 1.5, 6) AS surprisal_mean, round(latency_s * 2, 6) AS surprisal_max FROM steps")
def _(runs, rows):
    given = rows.withColumn("token_logprobs", F.array(-F.col("latency_s"), -2 * F.col("latency_s")))
    return steps.step_features(given).select("uid", F.col("step_idx").cast("long").alias("step_idx"), r6("surprisal_mean", "surprisal_mean"), r6("surprisal_max", "surprisal_max"))


@on_steps("classes_restricted", "SELECT uid FROM runs WHERE failure_class IS NULL OR failure_class IN ('looping', 'goal_drift')")
def _(runs, rows):
    return runs.where(scalars.in_classes(F.col("failure_class"), ("looping", "goal_drift"))).select("uid")


@on_steps("healthy_runs", "SELECT uid FROM runs WHERE failure_class IS NULL")
def _(runs, rows):
    return runs.where(scalars.is_healthy(F.col("failure_class"))).select("uid")


@on_steps("constant_latency", "SELECT uid, len AS n, 2.5 * len AS total FROM runs")
def _(runs, rows):
    flat = episodes_of(runs, rows).withColumn("steps", steps.with_constant_latency(F.col("steps"), 2.5))
    return flat.select("uid", F.size("steps").alias("n"), F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["latency_s"]).alias("total"))


@on_steps("latency_drop", "SELECT family, round(quantile_cont(latency_s, 0.5), 6) AS median FROM steps JOIN runs USING (uid) WHERE failure_class IS NULL GROUP BY family")
def _(runs, rows):
    from tracewell.operators.metrics import quantiles

    healthy = rows.join(runs.where("failure_class IS NULL").select("uid", "family"), "uid")
    return quantiles(healthy, ["family"], "latency_s", {"median": 0.5}).select("family", r6("median", "median"))


def _blindable(runs, rows):
    """Runs whose tool steps say their result in the text."""
    said = F.when(F.col("tool_name").isNotNull(), F.concat(F.lit("["), "tool_name", F.lit("("), "args", F.lit(") -> "), "result", F.lit("]"))).otherwise(F.col("text"))
    return episodes_of(runs, rows.withColumn("text", said))


@on_steps("blinding_counts", "SELECT corpus, count(*) FILTER (n > 0) AS blinded_steps, CAST(sum(n) AS BIGINT) AS changed_chars FROM (SELECT corpus, CASE WHEN tool_name IS NULL THEN 0 ELSE length(result) - length(regexp_replace(result, '[^x]', '', 'g')) END AS n FROM steps JOIN runs USING (uid)) GROUP BY corpus")
def _(runs, rows):
    return steps.blinding_counts(_blindable(runs, rows))


@on_steps("first_tasks", "SELECT 'task of ' || family AS task, count(*) AS n FROM runs GROUP BY family")
def _(runs, rows):
    listed = episodes_of(runs, rows)
    named = listed.withColumn("steps", F.transform("steps", lambda s: s.withField("task", F.concat(F.lit(" task\u00a0 of\n"), F.col("family")))))
    return named.groupBy(scalars.normalised_task(scalars.first_task(F.col("steps"))).alias("task")).agg(F.count("*").alias("n"))


# Round trips through files


def _written(spark, df, name, write):
    path = scratch.folder(spark, name)
    write(df, path)
    return path


@query("csv_round_trip", "SELECT n_nationkey, n_name, printf('%.6g', n_nationkey / 7.0::DOUBLE) AS share FROM nation")
def _(spark, sf):
    df = _t("nation")(spark, sf).select("n_nationkey", "n_name", (F.col("n_nationkey") / 7.0).alias("share"))
    return episodes.read_csv(spark, _written(spark, df, "csv", episodes.write_csv), "n_nationkey bigint, n_name string, share string")


@query("json_round_trip", "SELECT r_regionkey, r_name, CASE WHEN r_regionkey % 2 = 0 THEN CAST(r_regionkey AS DOUBLE) END AS share FROM region")
def _(spark, sf):
    share = F.when(F.col("r_regionkey") % 2 == 0, F.col("r_regionkey").cast("double")).otherwise(float("nan"))
    df = _t("region")(spark, sf).select("r_regionkey", "r_name", share.alias("share"))
    path = _written(spark, df, "json", episodes.write_json)
    return spark.read.schema("r_regionkey bigint, r_name string, share double").json(path)


@query("json_documents", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    df = _t("region")(spark, sf).select("r_regionkey", "r_name")
    path = _written(spark, df.coalesce(1), "documents", lambda d, p: d.select(F.to_json(F.collect_list(F.struct("r_regionkey", "r_name")).over(_one())).alias("value")).limit(1).write.text(p))
    return episodes.read_json_files(spark, path, "r_regionkey bigint, r_name string")


def _one():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # five rows


@query("file_sizes", "SELECT count(*) AS n FROM region WHERE r_regionkey = 0")
def _(spark, sf):
    path = _written(spark, _t("region")(spark, sf).coalesce(1), "sizes", lambda d, p: d.write.text(p) if len(d.columns) == 1 else d.select("r_name").write.text(p))
    return episodes.file_sizes(spark, path).where("length > 0").agg(F.count("*").alias("n"))


@query("manifest_order", "SELECT CAST(row_number() OVER (ORDER BY n_name DESC) - 1 AS INTEGER) AS position, n_name AS episode_id FROM nation")
def _(spark, sf):
    names = _t("nation")(spark, sf).select(F.col("n_name").alias("episode_id"))
    manifest = names.agg(F.reverse(F.array_sort(F.collect_list("episode_id"))).alias("episodes"))
    return episodes.manifest_ordered(names, manifest).select("position", "episode_id")


@query("group_counts_round_trip", "SELECT o_orderpriority AS task_group, count(*) AS n_healthy, count(*) FILTER (o_orderstatus = 'F') AS n_pos FROM orders GROUP BY 1")
def _(spark, sf):
    counts = _t("orders")(spark, sf).groupBy(F.col("o_orderpriority").alias("task_group")).agg(F.count("*").alias("n_healthy"), F.count_if(F.col("o_orderstatus") == "F").alias("n_pos"), *(F.lit(0).alias(c) for c in episodes.GROUP_COUNTS if c not in ("n_healthy", "n_pos")))
    return episodes.read_group_counts(spark, _written(spark, counts, "counts", episodes.write_parquet)).select("task_group", "n_healthy", "n_pos")


@query("cache_append", "SELECT CAST(count(*) AS BIGINT) AS n, count(DISTINCT n_name) AS keys FROM nation")
def _(spark, sf):
    row = F.struct(F.col("n_regionkey").cast("string").alias("text"), F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(0.5).alias("latency_s"))
    all_ = _t("nation")(spark, sf).select(F.lit("j").alias("judge"), F.lit("m").alias("model"), F.lit("h").alias("prompt_hash"), F.col("n_name").alias("uid"), F.lit(1).alias("t"), F.lit(0).alias("sample"), row.alias("response"), "n_nationkey")
    path = _written(spark, all_.where("n_nationkey < 10").drop("n_nationkey"), "cache", episodes.append_cache)
    episodes.append_cache(scratch.cut(episodes.new_responses(episodes.read_cache(spark, path), all_.drop("n_nationkey"))), path)
    return episodes.read_cache(spark, path).agg(F.count("*").alias("n"), F.countDistinct("uid").alias("keys"))


def _raw(spark, sf, prefix=""):
    """The run table as files have it: steps and metadata are JSON."""
    runs, rows = events.load(spark, sf)
    listed = episodes_of(runs, rows)
    model = F.when(F.col("family") == "qwen", "qwen2.5:7b").when(F.col("family") == "llama", "llama3.1:8b").otherwise("gemini-2.5-flash")
    corpus = F.when(F.col("user_id") % 10 == 9, "organic_llama8b").otherwise(F.col("corpus"))
    return listed.select("uid", F.col("uid").alias("episode_id"), corpus.alias("corpus"), model.alias("model"), "failure_class", F.col("tau").cast("double").alias("tau"), F.col("len").alias("T"), F.lit(False).alias("has_logprobs"), F.col("len").alias("n_steps"), F.to_json("steps").alias("steps"), F.to_json(F.struct(F.struct(F.lit(None).cast("string").alias("task_sha256")).alias("provenance"), (F.col("user_id") % 7).cast("double").alias("expected_total"))).alias("metadata"))


@query("episode_files", "SELECT uid, corpus, family, CAST(len AS INTEGER) AS len, tau, len AS n_steps FROM runs WHERE user_id % 10 <> 9", events.CTES)
def _(spark, sf):
    path = _written(spark, _raw(spark, sf), "episodes", episodes.write_parquet)
    return episodes.read_episodes(spark, path).select("uid", "corpus", "family", "len", "tau", F.size("steps").alias("n_steps"))


@query("raw_episodes", "SELECT corpus, count(*) AS n FROM (SELECT CASE WHEN user_id % 10 = 9 THEN 'organic_llama8b' ELSE corpus END AS corpus FROM runs) GROUP BY 1", events.CTES)
def _(spark, sf):
    path = _written(spark, _raw(spark, sf), "raw", episodes.write_parquet)
    return episodes.raw_episodes(spark, path).groupBy("corpus").agg(F.count("*").alias("n"))


@query("organic_files", """SELECT uid, CASE WHEN ok THEN NULL ELSE 'organic_failed' END AS failure_class, CASE WHEN ok THEN NULL ELSE 0 END AS tau, 'run:' || uid AS task_group, CAST(0 AS INTEGER) AS family_n FROM
    (SELECT r.uid, coalesce(bool_or(abs(CAST(regexp_extract(text, '[0-9]+') AS DOUBLE) - user_id % 7) <= 0.5) FILTER (step_idx = last), false) AS ok FROM runs r LEFT JOIN (SELECT uid, step_idx, text, max(step_idx) OVER (PARTITION BY uid) AS last FROM steps WHERE tool_name IS NULL) s USING (uid) WHERE user_id % 10 = 9 GROUP BY r.uid)""", events.CTES)
def _(spark, sf):
    path = _written(spark, _raw(spark, sf), "organic", episodes.write_parquet)
    return episodes.read_organic(spark, path).select("uid", "failure_class", "tau", "task_group", F.lit(0).alias("family_n"))


@on_scores("tracked_metrics", "SELECT 'r' AS run, t || '.n' AS key, CAST(count(*) AS DOUBLE) AS value FROM d8s GROUP BY t UNION ALL SELECT 'r', t || '.score', round(avg(score), 6) FROM d8s GROUP BY t")
def _(runs, evals):
    out = evals.groupBy(F.col("t").cast("string").alias("t")).agg(F.count("*").alias("n"), r6(F.avg("score"), "score"))
    return episodes.flat_metrics(out, "r")
