"""Queries over the driver's tables, one per operator, with the same in SQL where it can say it.

Runs and steps come from the event log (``tracewell.sources.events``). Floats are rounded to six
places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.operators import audit, curve, groups, judge, labels, metrics, models, monitor, prefix, recalibrate, splits, steps, thresholds
from tracewell.plans import scratch
from tracewell.schema import HEADLINE_CLASSES
from tracewell.sources import events
from tracewell.streaming import alarms as online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FEATURE_CTES = (
    events.CTES
    + """, f0 AS (SELECT *, tool_name || args AS key, CASE WHEN tool_error THEN 1 ELSE 0 END AS is_error FROM steps),
f1 AS (SELECT *, CASE WHEN step_idx > 0 AND key IS NOT DISTINCT FROM lag(key) OVER (PARTITION BY uid ORDER BY step_idx) THEN 0 ELSE 1 END AS brk,
    max(CASE WHEN is_error = 1 THEN step_idx END) OVER (PARTITION BY uid ORDER BY step_idx) AS last_error FROM f0),
f2 AS (SELECT *, sum(brk) OVER (PARTITION BY uid ORDER BY step_idx) AS island FROM f1),
feat AS (SELECT uid, step_idx, tool_name, key, is_error, CAST(tool_name IS NOT NULL AS INTEGER) AS is_tool_call,
    CAST(tool_name IS NOT NULL AND row_number() OVER (PARTITION BY uid, key ORDER BY step_idx) > 1 AS INTEGER) AS exact_repeat,
    CAST(tool_name IS NOT NULL AND row_number() OVER (PARTITION BY uid, tool_name ORDER BY step_idx) = 1 AS INTEGER) AS new_tool,
    CASE WHEN tool_name IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY uid, island ORDER BY step_idx) END AS consecutive_identical,
    step_idx - coalesce(last_error, -1) AS steps_since_error, ln(1 + latency_s) AS log_latency, ln(1 + output_tokens) AS log_output_tokens,
    CAST(tool_name IS NOT NULL AND starts_with(lower(ltrim(result)), 'error') AS INTEGER) AS result_error_prefix,
    CASE WHEN tool_name IS NOT NULL THEN floor(ln(1 + length(result))) END AS result_chars_bucket, CASE WHEN tool_name IS NULL THEN ln(1 + length(text)) END AS synth_text_log_chars,
    CASE WHEN tool_name IS NOT NULL THEN ln(1 + latency_s) END AS tool_log_latency, CASE WHEN tool_name IS NOT NULL THEN 1 END AS n_arg_keys FROM f2),
score AS (SELECT uid, step_idx, max(log_latency) OVER (PARTITION BY uid ORDER BY step_idx) AS score FROM feat),
d8 AS (SELECT uid, t, len, tau, failure_class, family, corpus, task_group, CASE WHEN failure_class IS NULL THEN 0 ELSE 1 END AS y FROM runs, (SELECT unnest([2, 3, 4]) AS t)
    WHERE len >= t + 1 AND (failure_class IS NULL OR tau <= t)),
d8s AS (SELECT d8.*, score FROM d8 JOIN score ON d8.uid = score.uid AND step_idx = t)
"""
)


def query(name: str, sql: str | None = None, ctes: str | None = None):
    """Register a query and, if there is one, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {ctes}\n{sql}" if ctes else sql
        return f

    return add


def on_steps(name: str, sql: str | None = None):
    """A query of (runs, steps)."""

    def add(f):
        query(name, sql, events.CTES if sql else None)(lambda spark, sf: f(*events.load(spark, sf)))
        return f

    return add


def on_features(name: str, sql: str | None = None):
    """A query of (runs, features)."""

    def add(f):
        def run(spark, sf):
            runs, rows = events.load(spark, sf)
            return f(runs, steps.step_features(rows))

        query(name, sql, FEATURE_CTES if sql else None)(run)
        return f

    return add


def on_scores(name: str, sql: str | None = None):
    """A query of (runs, labelled scores at t = 2, 3, 4): the running maximum of log latency."""

    def add(f):
        def run(spark, sf):
            runs, rows = events.load(spark, sf)
            return f(runs, evaluated(runs, rows))

        query(name, sql, FEATURE_CTES if sql else None)(run)
        return f

    return add


def scored(rows: DataFrame) -> DataFrame:
    return steps.running_max(rows.withColumn("log_latency", F.log1p("latency_s")), "log_latency", "score").select("uid", "step_idx", "score")


def evaluated(runs: DataFrame, rows: DataFrame) -> DataFrame:
    return labels.scores_at(labels.eval_set(runs, (2, 3, 4)), scored(rows))


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# Steps, labels and features


def episodes_of(runs, rows):
    """Runs with a list of steps, as a run table has them."""
    event = F.struct(F.lit(None).cast("string").alias("id"), F.col("tool_name").alias("name"), "args", "result", "result_chars", F.lit(False).alias("result_truncated"), F.col("tool_error").alias("is_error"), F.col("tool_latency_s").alias("latency_s"))
    step = F.struct("step_idx", "text", "token_logprobs", F.lit(False).alias("logprobs_available"), F.when(F.col("tool_name").isNull(), "synthesis").otherwise("tool_call").alias("action"), "latency_s", "output_tokens", "tool_error", F.lit("task").alias("task"), F.lit("v1").alias("schema"), F.when(F.col("tool_name").isNotNull(), F.array(event)).alias("tool_events"))
    listed = rows.groupBy("uid").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    steps_ = F.transform("steps", lambda s: s.withField("error", s["tool_error"]).dropFields("step_idx", "tool_error"))
    return runs.join(listed, "uid").withColumn("steps", steps_)


@on_steps("step_table", """SELECT s.uid, step_idx, corpus, family, coalesce(failure_class IS NOT NULL AND step_idx >= tau, false) AS label, tool_name, args, coalesce(tool_error AND tool_name IS NOT NULL, false) AS tool_error, result, CAST(length(result) AS INTEGER) AS result_chars, latency_s, output_tokens,
    CAST(CASE WHEN tool_name IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_tool_events FROM steps s JOIN runs USING (uid)""")
def _(runs, rows):
    out = steps.step_table(episodes_of(runs, rows))
    return out.select("uid", F.col("step_idx").cast("long").alias("step_idx"), "corpus", "family", "label", "tool_name", "args", "tool_error", "result", "result_chars", "latency_s", "output_tokens", "n_tool_events")


@on_steps("run_counts", "SELECT family, failure_class, count(*) AS n, CAST(sum(len) AS BIGINT) AS n_steps, max(len) AS longest FROM runs GROUP BY ALL")
def _(runs, rows):
    return runs.groupBy("family", "failure_class").agg(F.count("*").alias("n"), F.sum("len").alias("n_steps"), F.max("len").alias("longest"))


@on_steps("runs_without_tool_calls", "SELECT corpus, count(*) AS dropped FROM runs WHERE uid NOT IN (SELECT uid FROM steps WHERE tool_name IS NOT NULL) GROUP BY corpus")
def _(runs, rows):
    calls = rows.groupBy("uid").agg(F.collect_list(F.struct(F.when(F.col("tool_name").isNotNull(), F.array("tool_name")).alias("tool_events"))).alias("steps"))
    return steps.drop_runs_without_tool_calls(runs.join(calls, "uid"))[1]


@on_steps("family_map", "SELECT family, count(*) AS n FROM runs GROUP BY family")
def _(runs, rows):
    named = F.when(F.col("user_id") % 3 == 0, "qwen2.5:7b").when(F.col("user_id") % 3 == 1, "llama3.1:8b").otherwise("gemini-2.5-flash")
    return runs.groupBy(scalars.family_of(named).alias("family")).agg(F.count("*").alias("n"))


@on_steps("step_label", "SELECT s.uid, s.step_idx, coalesce(r.failure_class IS NOT NULL AND s.step_idx >= r.tau, false) AS label FROM steps s JOIN runs r USING (uid)")
def _(runs, rows):
    return rows.join(runs.drop("user_id"), "uid").select("uid", F.col("step_idx").cast("long").alias("step_idx"), scalars.step_label(F.col("failure_class"), F.col("tau"), F.col("step_idx")).alias("label"))


_BINARY = ["is_tool_call", "exact_repeat", "new_tool", "is_error", "result_error_prefix"]
_CONTINUOUS = ["consecutive_identical", "n_arg_keys", "result_chars_bucket", "log_latency", "log_output_tokens", "synth_text_log_chars", "tool_log_latency"]


@on_features("step_features", f"SELECT uid, step_idx, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _BINARY)}, CAST(steps_since_error AS BIGINT) AS steps_since_error, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _CONTINUOUS)} FROM feat")
def _(runs, feats):
    return feats.select("uid", F.col("step_idx").cast("long").alias("step_idx"), *(F.col(c).cast("long").alias(c) for c in [*_BINARY, "steps_since_error"]), *(r6(F.col(c).cast("double"), c) for c in _CONTINUOUS))


for _name in ("exact_repeat", "new_tool", "consecutive_identical", "steps_since_error", "result_error_prefix"):

    @on_features(_name, f"SELECT uid, step_idx, CAST({_name} AS BIGINT) AS {_name} FROM feat")
    def _(runs, feats, c=_name):
        return feats.select("uid", F.col("step_idx").cast("long").alias("step_idx"), F.col(c).cast("long").alias(c))


def _prefix_sql(names: list[str]) -> str:
    over = "OVER (PARTITION BY uid ORDER BY step_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    last3 = "OVER (PARTITION BY uid ORDER BY step_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    form = {"count": "sum({c}) " + over, "rate": "sum({c}) " + over + " / (step_idx + 1.0)", "last3": "sum({c}) " + last3, "mean": "avg({c}) " + over, "max": "max({c}) " + over, "last": "{c}", "last3_mean": "avg({c}) " + last3}
    made = ", ".join(f"round(CAST({form[n.split('__')[2]].format(c='CAST(' + n.split('__')[1] + ' AS DOUBLE)')} AS DOUBLE), 6) AS {n}" for n in names)
    return f"SELECT * FROM (SELECT uid, step_idx AS t, {made} FROM (SELECT *, step_idx AS step_index FROM feat)) WHERE t IN (2, 3, 4, 5, 6, 7, 8)"


_NO_LOGPROBS = [c for c in __import__("tracewell.schema", fromlist=["prefix_columns"]).prefix_columns() if c.split("__")[0] != "text" and "surprisal" not in c and c.count("__") == 2]
for _name, _names in {
    "prefix_binary": [c for c in _NO_LOGPROBS if c.endswith(("__count", "__rate", "__last3"))],
    "prefix_continuous": [c for c in _NO_LOGPROBS if c.split("__")[1] in _CONTINUOUS],
    "prefix_state": ["tl__steps_since_error__last", "tl__step_index__last"],
}.items():

    @query(_name, _prefix_sql(_names), FEATURE_CTES)
    def _(spark, sf, names=_names):
        return prefix.prefix_table(events.load(spark, sf)[1], range(2, 9)).select("uid", F.col("t").cast("long").alias("t"), *(r6(c, c) for c in names))


@on_features("distinct_tools_per_call", "SELECT * FROM (SELECT uid, step_idx AS t, round(sum(new_tool) OVER w / nullif(CAST(sum(is_tool_call) OVER w AS DOUBLE), 0), 6) AS ratio FROM feat WINDOW w AS (PARTITION BY uid ORDER BY step_idx)) WHERE t IN (2, 3, 4)")
def _(runs, feats):
    return prefix.prefix_features(feats, (2, 3, 4)).select("uid", F.col("t").cast("long").alias("t"), r6("tl__distinct_tools_per_call", "ratio"))


@on_steps("running_max", "SELECT uid, step_idx, round(max(ln(1 + latency_s)) OVER (PARTITION BY uid ORDER BY step_idx), 6) AS running_max FROM steps")
def _(runs, rows):
    return scored(rows).select("uid", F.col("step_idx").cast("long").alias("step_idx"), r6("score", "running_max"))


@on_steps("cusum", "SELECT uid, step_idx, round(total - least(0, min(total) OVER (PARTITION BY uid ORDER BY step_idx)), 6) AS cusum FROM (SELECT uid, step_idx, sum(latency_s - 50) OVER (PARTITION BY uid ORDER BY step_idx) AS total FROM steps)")
def _(runs, rows):
    return steps.cusum(rows.withColumn("x", F.col("latency_s") - 50), "x").select("uid", F.col("step_idx").cast("long").alias("step_idx"), r6("cusum", "cusum"))


@on_steps("first_alarm", "SELECT uid, min(CASE WHEN latency_s > 100 THEN step_idx END) AS first_alarm FROM steps GROUP BY uid")
def _(runs, rows):
    return thresholds.first_alarms(rows, 100.0, "latency_s").select("uid", F.col("first_alarm").cast("long").alias("first_alarm"))


@on_features("masked_at_onset", "SELECT f.uid, step_idx, round(CASE WHEN step_idx = tau THEN lag(log_latency) OVER (PARTITION BY f.uid ORDER BY step_idx) ELSE log_latency END, 6) AS log_latency FROM feat f JOIN runs USING (uid) WHERE coalesce(tau, 1) >= 1")
def _(runs, feats):
    out = steps.masked_at_onset(feats.join(runs.where("coalesce(tau, 1) >= 1").select("uid", "tau"), "uid"), ["log_latency"], "carry")
    return out.select("uid", F.col("step_idx").cast("long").alias("step_idx"), r6("log_latency", "log_latency"))


# Evaluation sets and metrics


@on_steps("d8_counts", """SELECT t, count(*) FILTER (len >= t + 1 AND tau <= t) AS n_pos, count(*) FILTER (len >= t + 1 AND failure_class IS NULL) AS n_neg,
    count(*) FILTER (len >= t + 1 AND failure_class IS NOT NULL AND tau > t) AS n_excluded, count(*) FILTER (len < t + 1) AS n_without_step FROM runs, (SELECT unnest([2, 3, 4]) AS t) GROUP BY t""")
def _(runs, rows):
    return labels.eval_counts(runs, (2, 3, 4))


@on_scores("d8_eval_set", "SELECT t, uid, y, task_group, round(score, 6) AS score FROM d8s")
def _(runs, evals):
    return evals.select("t", "uid", "y", "task_group", r6("score", "score"))


_RANKED = "r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY score) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS rk FROM {src})"
_AUC = "CASE WHEN sum(y) * sum(1 - y) > 0 THEN round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 6) END AS auroc"


@on_scores("matched_step_auroc", f"SELECT t, {_AUC}, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM (WITH {_RANKED.format(by='t', src='d8s')} SELECT * FROM r) GROUP BY t")
def matched_step_auroc(runs, evals):
    return metrics.auroc(evals, ["t"]).select("t", r6("auroc", "auroc"), "n_pos", "n_neg")


@on_scores("per_class_auroc", f"SELECT t, class, {_AUC} FROM (WITH c AS (SELECT d8s.*, class FROM d8s, (SELECT unnest(['looping', 'goal_drift', 'context_corruption']) AS class) WHERE failure_class IS NULL OR failure_class = class), {_RANKED.format(by='t, class', src='c')} SELECT * FROM r) GROUP BY t, class")
def _(runs, evals):
    kinds = evals.withColumn("class", F.explode(F.array(*map(F.lit, HEADLINE_CLASSES)))).where("failure_class IS NULL OR failure_class = class")
    return metrics.auroc(kinds, ["t", "class"]).select("t", "class", r6("auroc", "auroc"))


@on_scores("per_fold_auroc", f"SELECT t, round(avg(auroc), 6) AS mean_auroc, count(auroc) AS n_folds FROM (SELECT t, fold, {_AUC.replace('round(', '(').replace(', 6)', ')')} FROM (WITH c AS (SELECT *, CAST(substr(task_group, 2) AS BIGINT) % 5 AS fold FROM d8s), {_RANKED.format(by='t, fold', src='c')} SELECT * FROM r) GROUP BY t, fold) GROUP BY t")
def _(runs, evals):
    fold = evals.withColumn("fold", F.substring("task_group", 2, 20).cast("long") % 5)
    return metrics.per_fold_mean(metrics.auroc(fold, ["t", "fold"]), "auroc", ["t"]).select("t", r6("mean_auroc", "mean_auroc"), "n_folds")


_CURVE = """c AS (SELECT t, score, sum(y) AS pos, sum(1 - y) AS neg FROM d8s GROUP BY t, score),
cv AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY t) AS np, sum(neg) OVER (PARTITION BY t) AS nn FROM c WINDOW d AS (PARTITION BY t ORDER BY score DESC))"""


@on_scores("roc_curve", f"SELECT t, round(score, 6) AS s, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM (WITH {_CURVE} SELECT * FROM cv)")
def _(runs, evals):
    return metrics.curve(evals, ["t"]).select("t", r6("s", "s"), "tp", "fp")


@on_scores("auprc", f"SELECT t, round(sum(pos / CAST(np AS DOUBLE) * tp / (tp + fp)), 6) AS auprc FROM (WITH {_CURVE} SELECT * FROM cv) GROUP BY t")
def _(runs, evals):
    return metrics.auprc(evals, ["t"]).select("t", r6("auprc", "auprc"))


@on_scores("tpr_at_fpr", f"SELECT t, round(coalesce(max(CASE WHEN fp / CAST(nn AS DOUBLE) <= 0.05::DOUBLE THEN tp / CAST(np AS DOUBLE) END), 0), 6) AS tpr_at_fpr FROM (WITH {_CURVE} SELECT * FROM cv) GROUP BY t")
def _(runs, evals):
    return metrics.tpr_at_fpr(evals, ["t"], 0.05).select("t", r6("tpr_at_fpr", "tpr_at_fpr"))


@on_scores("ece", "SELECT t, round(sum(abs(sy - sp)) / sum(n), 6) AS ece FROM (SELECT t, least(floor(p * 10), 9) AS b, sum(y) AS sy, sum(p) AS sp, count(*) AS n FROM (SELECT *, score / 7.0::DOUBLE AS p FROM d8s) GROUP BY t, b) GROUP BY t")
def _(runs, evals):
    return metrics.ece(evals.withColumn("p", F.col("score") / 7.0), ["t"], 10, "p").select("t", r6("ece", "ece"))


@on_features("univariate_auroc", f"""SELECT feature, t, {_AUC} FROM (WITH w AS (SELECT d.t, d.y, unnest(['is_tool_call', 'exact_repeat', 'synth_text_log_chars', 'steps_since_error']) AS feature,
    unnest([CAST(is_tool_call AS DOUBLE), CAST(exact_repeat AS DOUBLE), synth_text_log_chars, CAST(steps_since_error AS DOUBLE)]) AS x FROM d8 d JOIN feat f ON d.uid = f.uid AND f.step_idx = d.t),
    l AS (SELECT feature, min(x) - 1 AS least FROM w GROUP BY feature), c AS (SELECT feature, t, y, coalesce(x, least, -1) AS score FROM w JOIN l USING (feature)), {_RANKED.format(by='feature, t', src='c')} SELECT * FROM r) GROUP BY feature, t""")
def _(runs, feats):
    names = ["is_tool_call", "exact_repeat", "synth_text_log_chars", "steps_since_error"]
    wide = labels.eval_set(runs, (2, 3, 4)).join(feats.withColumnRenamed("step_idx", "t").select("uid", "t", *names), ["uid", "t"])
    return metrics.univariate_auroc(wide, names, ["t"]).select("feature", "t", r6("auroc", "auroc"))


@on_scores("mean_matched_step_auroc", f"SELECT round(avg(auroc), 6) AS mean_auroc FROM (SELECT t, {_AUC.replace('round(', '(').replace(', 6)', ')')} FROM (WITH {_RANKED.format(by='t', src='d8s')} SELECT * FROM r) WHERE t IN (3, 4) GROUP BY t)")
def _(runs, evals):
    return metrics.mean_over_checkpoints(metrics.auroc(evals, ["t"]), "auroc", (3, 4)).select(r6("mean_auroc", "mean_auroc"))


@on_scores("spearman", """SELECT t, round(corr(a, b), 6) AS spearman FROM (SELECT t, rank() OVER (PARTITION BY t ORDER BY score) + (count(*) OVER (PARTITION BY t, score) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY t ORDER BY len) + (count(*) OVER (PARTITION BY t, len) - 1) / 2.0 AS b FROM d8s) GROUP BY t""")
def _(runs, evals):
    return metrics.spearman(evals, "score", "len", ["t"]).select("t", r6("spearman", "spearman"))


# Splits, groups, twins


@on_steps("lofo_split", """SELECT uid, CASE WHEN family = 'llama' THEN 'test' WHEN family = 'gemini' THEN 'eval_only' WHEN task_group IN (SELECT task_group FROM runs WHERE family = 'llama') THEN 'dropped' ELSE 'train' END AS role FROM runs""")
def _(runs, rows):
    return splits.leave_one_family_out(runs, "llama")


@query("task_components", """WITH RECURSIVE e AS (SELECT CAST(user_id AS BIGINT) AS u, CAST(user_id % 40 AS VARCHAR) AS a, CASE WHEN value < 0.5 THEN props END AS b, value FROM events),
k AS (SELECT DISTINCT u, k FROM (SELECT u, 'a' || a AS k FROM e WHERE value < 60 UNION ALL SELECT u, 'b' || b FROM e WHERE b IS NOT NULL)),
reach(u, v) AS (SELECT DISTINCT u, u FROM k UNION SELECT r.u, y.u FROM reach r JOIN k x ON r.v = x.u JOIN k y ON x.k = y.k),
c AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT DISTINCT 'u' || lpad(CAST(e.u AS VARCHAR), 9, '0') AS uid, coalesce('u' || lpad(CAST(c AS VARCHAR), 9, '0'), 'unknown:u' || lpad(CAST(e.u AS VARCHAR), 9, '0')) AS task_group FROM e LEFT JOIN c USING (u)""")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    uid = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    rows = e.select(uid.alias("uid"), F.when(F.col("value") < 60, (F.col("user_id") % 40).cast("string")).alias("a"), F.when(F.col("value") < 0.5, F.col("props")).alias("b"))
    return groups.task_groups(rows.distinct(), ["a", "b"], save=scratch.cut).distinct()


_TRAJECTORY = "h AS (SELECT uid, string_agg(coalesce(key || chr(2) || result, ''), chr(3) ORDER BY f.step_idx) AS trajectory FROM (SELECT steps.*, tool_name || chr(1) || replace(args, ' ', '') AS key FROM steps) f GROUP BY uid)"


@on_steps("trajectory_hash", f"SELECT uid, sha256(trajectory) AS trajectory FROM (WITH {_TRAJECTORY} SELECT * FROM h)")
def _(runs, rows):
    return groups.trajectory_hashes(rows)


@on_steps("twin_clusters", f"""SELECT corpus, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS runs, max(n) AS largest, count(*) FILTER (h > 0 AND h < n) AS mixed, count(*) FILTER (g > 1) AS spanning FROM
    (WITH {_TRAJECTORY} SELECT corpus, trajectory, count(*) AS n, count(*) FILTER (failure_class IS NULL) AS h, count(DISTINCT task_group) AS g FROM runs JOIN h USING (uid) GROUP BY corpus, trajectory HAVING count(*) > 1) GROUP BY corpus""")
def _(runs, rows):
    return groups.twin_clusters(runs, groups.trajectory_hashes(rows))


@on_steps("shared_twins", f"SELECT sha256(trajectory) AS trajectory, n_corpora FROM (WITH {_TRAJECTORY} SELECT trajectory, count(DISTINCT corpus) AS n_corpora FROM runs JOIN h USING (uid) GROUP BY trajectory) WHERE n_corpora > 1")
def _(runs, rows):
    return groups.shared_twins(runs, groups.trajectory_hashes(rows))


@on_steps("overlap_counts", "SELECT 'task_group' AS key, count(*) AS n FROM runs WHERE family = 'llama' AND task_group IN (SELECT task_group FROM runs WHERE family <> 'llama') UNION ALL SELECT 'corpus', count(*) FROM runs WHERE family = 'llama' AND corpus IN (SELECT corpus FROM runs WHERE family <> 'llama')")
def _(runs, rows):
    return groups.overlap_counts(runs.where("family = 'llama'"), runs.where("family <> 'llama'"), ["task_group", "corpus"])


@on_features("indistinguishable_positives", """SELECT failure_class, count(*) AS n_pos, count(*) FILTER (same) AS n_same, round(count(*) FILTER (same) / CAST(count(*) AS DOUBLE), 6) AS share FROM
    (WITH g AS (SELECT uid, string_agg(coalesce(tool_name, '-'), ',' ORDER BY step_idx) AS sig, count(*) AS n FROM feat WHERE step_idx <= 2 GROUP BY uid), s AS (SELECT d8.*, sig FROM d8 JOIN g USING (uid) WHERE t = 2 AND n = 3)
     SELECT failure_class, EXISTS (SELECT 1 FROM s h WHERE h.y = 0 AND h.task_group = s.task_group AND h.sig = s.sig) AS same FROM s WHERE y = 1) GROUP BY failure_class""")
def _(runs, feats):
    sig = groups.prefix_signatures(feats.withColumn("args", F.when(F.col("tool_name").isNotNull(), F.lit("{}"))), 2)
    return groups.indistinguishable(labels.eval_set(runs, (2,)), sig).select("failure_class", "n_pos", "n_same", r6("share", "share"))


# Recalibration

_LONG = "lg AS (SELECT f.uid, step_idx AS t, log_latency AS x, family, corpus, failure_class IS NULL AS healthy, CAST(substr(task_group, 2) AS BIGINT) % 3 AS fold FROM feat f JOIN runs USING (uid) WHERE step_idx IN (2, 3, 4))"


def _long(feats):
    return recalibrate.unpivoted(feats.where("step_idx IN (2, 3, 4)").withColumnRenamed("step_idx", "t"), ["log_latency"])


@on_features("percentile_recal", f"""SELECT uid, t, round((le + lt) / (2.0 * nullif(n, 0)), 6) AS pct FROM (WITH {_LONG}
    SELECT a.uid, a.t, count(b.x) AS n, count(*) FILTER (b.x <= a.x) AS le, count(*) FILTER (b.x < a.x) AS lt FROM lg a LEFT JOIN lg b ON a.family = b.family AND a.t = b.t AND b.healthy GROUP BY a.uid, a.t)""")
def _(runs, feats):
    long = _long(feats)
    out = recalibrate.percentile_transform(recalibrate.with_group(long, runs, "family"), recalibrate.fit_reference(long, runs, "family"))
    return out.select("uid", F.col("t").cast("long").alias("t"), r6("pct", "pct"))


@on_features("zscore_recal", f"""SELECT uid, t, round((x - m) / greatest(s, 0.001), 6) AS z FROM (WITH {_LONG}, r AS (SELECT corpus, t, avg(x) AS m, stddev_pop(x) AS s FROM lg WHERE healthy GROUP BY corpus, t) SELECT lg.uid, lg.t, x, m, s FROM lg JOIN r USING (corpus, t))""")
def _(runs, feats):
    long = _long(feats)
    reference = recalibrate.fit_reference(long, runs, "corpus")
    probes = recalibrate.with_group(long, runs, "corpus").join(reference.select("grp", "t").distinct(), ["grp", "t"], "left_semi")
    return recalibrate.zscore_transform(probes, reference, 0.001).select("uid", F.col("t").cast("long").alias("t"), r6("z", "z"))


@on_features("cross_fit_recal", f"""SELECT uid, t, round((le + lt) / (2.0 * nullif(n, 0)), 6) AS pct FROM (WITH {_LONG}, o AS (SELECT * FROM lg WHERE family = 'llama')
    SELECT a.uid, a.t, count(b.x) AS n, count(*) FILTER (b.x <= a.x) AS le, count(*) FILTER (b.x < a.x) AS lt FROM o a LEFT JOIN o b ON a.fold <> b.fold AND a.t = b.t AND b.healthy GROUP BY a.uid, a.t)""")
def _(runs, feats):
    own = runs.where("family = 'llama'")
    folds = own.select("uid", (F.substring("task_group", 2, 20).cast("long") % 3).cast("int").alias("fold"))
    return recalibrate.cross_fitted_percentile(_long(feats), own, folds).select("uid", F.col("t").cast("long").alias("t"), r6("pct", "pct"))


# Thresholds and alarms


@on_scores("conformal_theta", """SELECT t, alpha, round(CASE WHEN k > m THEN CAST('inf' AS DOUBLE) ELSE s[CAST(k AS BIGINT)] END, 6) AS theta, m FROM
    (SELECT t, alpha, list(score ORDER BY score) AS s, count(*) AS m, ceil((count(*) + 1) * (1.0::DOUBLE - alpha)) AS k FROM d8s, (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS alpha) WHERE y = 0 GROUP BY t, alpha)""")
def _(runs, evals):
    out = thresholds.thresholds(evals.where("y = 0"), ["t"]).where("rule = 'conformal'")
    return out.select("t", "alpha", r6("theta", "theta"), "m")


@on_scores("plugin_theta", "SELECT t, alpha, round(quantile_cont(score, CASE WHEN alpha < 0.07 THEN 0.95 ELSE 0.9 END), 6) AS theta, count(*) AS m FROM d8s, (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS alpha) WHERE y = 0 GROUP BY t, alpha".replace("quantile_cont(score, CASE WHEN alpha < 0.07 THEN 0.95 ELSE 0.9 END)", "CASE WHEN alpha < 0.07 THEN quantile_cont(score, 0.95) ELSE quantile_cont(score, 0.9) END"))
def _(runs, evals):
    out = thresholds.thresholds(evals.where("y = 0"), ["t"]).where("rule = 'plugin'")
    return out.select("t", "alpha", r6("theta", "theta"), "m")


_ALARM = "al AS (SELECT uid, min(CASE WHEN latency_s > 100 THEN step_idx END) AS fa FROM steps GROUP BY uid), alt AS (SELECT runs.*, fa, t FROM runs JOIN al USING (uid), (SELECT unnest([2, 3, 4]) AS t))"


@on_steps("fa_tpr", f"""SELECT t, n_healthy, n_healthy_alarm, n_pos, n_pos_alarm, n_early, n_healthy_without_step, n_excluded_tau_after_t, round(n_healthy_alarm / nullif(CAST(n_healthy AS DOUBLE), 0), 6) AS fa,
    round(n_pos_alarm / nullif(CAST(n_pos AS DOUBLE), 0), 6) AS tpr, round(n_early / nullif(CAST(n_pos_alarm AS DOUBLE), 0), 6) AS early_alarm_rate FROM (WITH {_ALARM}
    SELECT t, count(*) FILTER (len >= t + 1 AND failure_class IS NULL) AS n_healthy, count(*) FILTER (len >= t + 1 AND failure_class IS NULL AND fa <= t) AS n_healthy_alarm,
    count(*) FILTER (len >= t + 1 AND tau <= t) AS n_pos, count(*) FILTER (len >= t + 1 AND tau <= t AND fa <= t) AS n_pos_alarm, count(*) FILTER (len >= t + 1 AND tau <= t AND fa <= t AND fa < tau) AS n_early,
    count(*) FILTER (len < t + 1 AND failure_class IS NULL) AS n_healthy_without_step, count(*) FILTER (len >= t + 1 AND tau > t) AS n_excluded_tau_after_t FROM alt GROUP BY t)""")
def _(runs, rows):
    out = thresholds.fa_tpr(thresholds.first_alarms(rows, 100.0, "latency_s"), runs, (2, 3, 4), HEADLINE_CLASSES)
    return out.select("t", "n_healthy", "n_healthy_alarm", "n_pos", "n_pos_alarm", "n_early", "n_healthy_without_step", "n_excluded_tau_after_t", *(r6(c, c) for c in ("fa", "tpr", "early_alarm_rate")))


_GROUPS = """SELECT t, task_group, count(*) FILTER (h) AS n_healthy, count(*) FILTER (h AND fa <= t) AS n_healthy_alarm, count(*) FILTER (p) AS n_pos, count(*) FILTER (p AND fa <= t) AS n_pos_alarm,
    count(*) FILTER (p AND fa <= t AND fa < tau) AS n_pos_alarm_pre_tau, count(*) FILTER (p AND fa <= t AND fa >= tau) AS n_pos_alarm_post
    FROM (SELECT *, len >= t + 1 AND failure_class IS NULL AS h, coalesce(len >= t + 1 AND tau <= t, false) AS p FROM alt) GROUP BY t, task_group HAVING count(*) FILTER (h OR p) > 0"""


@on_steps("group_counts", f"SELECT * FROM (WITH {_ALARM} {_GROUPS})")
def group_counts(runs, rows):
    return thresholds.group_counts(thresholds.first_alarms(rows, 100.0, "latency_s"), runs, (2, 3, 4), HEADLINE_CLASSES)


@on_steps("pooled_rates", f"SELECT t, CAST(sum(n_healthy) AS BIGINT) AS n_healthy, CAST(sum(n_pos) AS BIGINT) AS n_pos, round(sum(n_healthy_alarm) / CAST(sum(n_healthy) AS DOUBLE), 6) AS fa, round(sum(n_pos_alarm) / CAST(sum(n_pos) AS DOUBLE), 6) AS tpr FROM (WITH {_ALARM} {_GROUPS}) GROUP BY t")
def _(runs, rows):
    return thresholds.pooled(group_counts(runs, rows), ["t"]).select("t", "n_healthy", "n_pos", r6("fa", "fa"), r6("tpr", "tpr"))


@on_steps("headline_mean", f"SELECT round(avg(tpr), 6) AS tpr FROM (SELECT t, sum(n_pos_alarm) / CAST(sum(n_pos) AS DOUBLE) AS tpr FROM (WITH {_ALARM} {_GROUPS}) WHERE t IN (3, 4) GROUP BY t)")
def _(runs, rows):
    return thresholds.headline(thresholds.pooled(group_counts(runs, rows), ["t"]), "tpr", (3, 4), []).select(r6("tpr", "tpr"))


_CUBE = """dr AS (SELECT draw, theta FROM (VALUES (0, 60.0::DOUBLE), (1, 100.0::DOUBLE), (2, 150.0::DOUBLE)) v(draw, theta)),
ad AS (SELECT uid, draw, min(CASE WHEN latency_s > theta THEN step_idx END) AS fa FROM steps, dr GROUP BY uid, draw),
cu AS (SELECT draw, t, count(*) FILTER (len >= t + 1 AND failure_class IS NULL) AS n_healthy, count(*) FILTER (len >= t + 1 AND failure_class IS NULL AND fa <= t) AS n_healthy_alarm, count(*) FILTER (len >= t + 1 AND tau <= t) AS n_pos,
    count(*) FILTER (len >= t + 1 AND tau <= t AND fa <= t) AS n_pos_alarm FROM runs JOIN ad USING (uid), (SELECT unnest([2, 3, 4]) AS t) GROUP BY draw, t)"""


def _cube(runs, rows):
    draws = F.explode(F.array(*(F.struct(F.lit(k).alias("draw"), F.lit(x).alias("theta")) for k, x in enumerate((60.0, 100.0, 150.0)))))
    spread = rows.select("uid", "step_idx", "latency_s", draws.alias("d")).select("uid", "step_idx", "latency_s", "d.*")
    alarms = thresholds.first_alarms(spread, F.col("theta"), "latency_s", ["draw"])
    return thresholds.fa_tpr(alarms, runs, (2, 3, 4), HEADLINE_CLASSES, ["draw"])


@on_steps("draw_cube", f"SELECT draw, t, n_healthy, n_healthy_alarm, n_pos, n_pos_alarm FROM (WITH {_CUBE} SELECT * FROM cu)")
def _(runs, rows):
    return _cube(runs, rows).select("draw", "t", "n_healthy", "n_healthy_alarm", "n_pos", "n_pos_alarm")


@on_steps("draw_summary", f"SELECT t, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.5), 6) AS median, round(avg(CAST(f > 0.2 AS INTEGER)), 6) AS p_above, count(f) AS n FROM (WITH {_CUBE} SELECT t, n_healthy_alarm / nullif(CAST(n_healthy AS DOUBLE), 0) AS f FROM cu) GROUP BY t")
def _(runs, rows):
    return thresholds.draw_summary(_cube(runs, rows), "fa", ["t"], 0.2).select("t", r6("mean", "mean"), r6("median", "median"), r6("p_above", "p_above"), "n")


@on_steps("paired_diff", f"SELECT t, round(a.n_pos_alarm / CAST(a.n_pos AS DOUBLE) - b.n_pos_alarm / CAST(b.n_pos AS DOUBLE), 6) AS diff FROM (WITH {_CUBE} SELECT * FROM cu) a JOIN (WITH {_CUBE} SELECT * FROM cu) b USING (t) WHERE a.draw = 0 AND b.draw = 2")
def _(runs, rows):
    cube = _cube(runs, rows)
    return thresholds.paired_difference(cube.where("draw = 0"), cube.where("draw = 2"), ["t"], "tpr").select("t", r6("diff", "diff"))


@on_steps("default_alarm_stats", f"""SELECT round(count(*) FILTER (h AND fa IS NOT NULL) / CAST(count(*) FILTER (h) AS DOUBLE), 6) AS healthy_fa, round(count(*) FILTER (fa >= tau) / CAST(count(*) FILTER (NOT h) AS DOUBLE), 6) AS detection,
    round(count(*) FILTER (fa < tau) / CAST(count(*) FILTER (NOT h) AS DOUBLE), 6) AS early_rate, round(quantile_cont(CASE WHEN fa >= tau THEN fa - tau END, 0.5), 6) AS median_delay FROM (WITH {_ALARM} SELECT runs.*, fa, failure_class IS NULL AS h FROM runs JOIN al USING (uid))""")
def _(runs, rows):
    out = thresholds.default_alarm_stats(thresholds.first_alarms(rows, 100.0, "latency_s"), runs)
    return out.select(*(r6(c, c) for c in out.columns))


# Audits and reconciliation over the star schema


def _t(name):
    return lambda spark, sf, n=name: spark.read.parquet(f"{sf}/{n}.parquet")


@query("value_counts", "SELECT coalesce(CAST(o_orderpriority AS VARCHAR), 'none') AS value, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return audit.value_counts(_t("orders")(spark, sf), "o_orderpriority")


@query("nested_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return audit.nested_counts(_t("lineitem")(spark, sf), ["l_returnflag", "l_linestatus"])


@query("describe", "SELECT o_orderstatus, count(o_totalprice) AS count, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS std, round(min(o_totalprice), 6) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(max(o_totalprice), 6) AS max FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    out = audit.describe(_t("orders")(spark, sf), "o_totalprice", ["o_orderstatus"])
    return out.select("o_orderstatus", "count", *(r6(c, c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))


@query("spread_keys", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1")
def _(spark, sf):
    return audit.spread_keys(_t("orders")(spark, sf), "o_custkey", "o_orderpriority")


@query("dup_values", "SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def _(spark, sf):
    return audit.repeated_values(_t("documents")(spark, sf), "text")


@query("agreement", "SELECT round(avg(CAST(quality = toxic AS INTEGER)), 6) AS agreement, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(spark, sf):
    return audit.agreement(_t("labels")(spark, sf), "quality", "toxic").select(r6("agreement", "agreement"), "n")


@query("same_partition", "SELECT (SELECT count(*) FROM (SELECT l_partkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1 HAVING count(*) > 1)) AS split_left, (SELECT count(*) FROM (SELECT l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1 HAVING count(*) > 1)) AS split_right")
def _(spark, sf):
    return audit.same_partition(_t("lineitem")(spark, sf), "l_partkey", "l_suppkey")


@query("roster", "SELECT * FROM (SELECT o_orderstatus, count(DISTINCT o_orderpriority) AS n_rosters FROM orders GROUP BY 1) JOIN (SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS items FROM orders GROUP BY 1) USING (o_orderstatus)")
def _(spark, sf):
    out = audit.roster(_t("orders")(spark, sf).withColumn("a", F.array("o_orderpriority")), "o_orderstatus", "a")
    return out.select("o_orderstatus", "n_rosters", F.concat_ws(",", "items").alias("items"))


@query("top_values", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 5")
def _(spark, sf):
    return audit.top_values(_t("lineitem")(spark, sf), "l_partkey", 5)


@on_steps("quantile_table", "SELECT tool_name, round(quantile_cont(latency_s, 0.1), 6) AS q10, round(quantile_cont(latency_s, 0.5), 6) AS q50, round(quantile_cont(latency_s, 0.9), 6) AS q90, round(avg(CAST(latency_s < 5 AS INTEGER)), 6) AS share_low, count(*) AS n FROM steps GROUP BY tool_name")
def _(runs, rows):
    out = audit.quantile_table(rows, "latency_s", ["tool_name"], 5.0)
    return out.select("tool_name", *(r6(c, c) for c in ("q10", "q50", "q90", "share_low")), "n")


@on_steps("channel_attribution", """SELECT t, holder, count(*) AS n FROM (SELECT step_idx AS t, CASE WHEN a = b THEN 'tie' WHEN a > b THEN 'latency_s' ELSE 'output_tokens' END AS holder FROM
    (SELECT step_idx, max(latency_s) OVER w AS a, max(output_tokens) OVER w AS b FROM steps WINDOW w AS (PARTITION BY uid ORDER BY step_idx))) WHERE t IN (2, 3, 4) GROUP BY ALL""")
def _(runs, rows):
    out = audit.channel_attribution(rows, ["latency_s", "output_tokens"], ["step_idx"])
    return out.where("step_idx IN (2, 3, 4)").select(F.col("step_idx").cast("long").alias("t"), "holder", "n")


@query("full_outer_reconcile", """SELECT count(*) FILTER (b.k IS NULL) AS only_ours, count(*) FILTER (a.k IS NULL) AS only_theirs, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both, round(max(abs(a.v - b.v)), 6) AS max_diff_v FROM
    (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1) b ON a.k = b.k""")
def _(spark, sf):
    ours = _t("orders")(spark, sf).where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    theirs = _t("lineitem")(spark, sf).where("l_shipdate < timestamp '1998-01-01'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("v"))
    return audit.differences(ours, theirs, ["k"], ["v"]).select("only_ours", "only_theirs", "both", r6("max_diff_v", "max_diff_v"))


@query("left_reconcile", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)")
def _(spark, sf):
    n = _t("orders")(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return audit.filled_left(_t("customer")(spark, sf), n, ["c_custkey"], ["n"]).select("c_custkey", "n")


# Texts


@query("forbidden_hits", "SELECT conv_id, turn, array_to_string(list_filter(['and', 'the', 'une', 'die', 'que'], lambda w: regexp_matches(lower(text), '(^|[^0-9a-z_\\x{80}-\\x{10FFFF}])' || w || '($|[^0-9a-z_\\x{80}-\\x{10FFFF}])')), ',') AS hits FROM conversations")
def _(spark, sf):
    hits = scalars.forbidden_hits(F.coalesce("text", F.lit("")), ("and", "the", "une", "die", "que"))
    return _t("conversations")(spark, sf).select("conv_id", "turn", F.concat_ws(",", hits).alias("hits"))


@query("tool_text_parse", """SELECT event_id, regexp_extract(s, '(?s)^\\[(\\w+)\\((.*)\\) -> (.*)\\]$', 1) AS name, regexp_extract(s, '(?s)^\\[(\\w+)\\((.*)\\) -> (.*)\\]$', 2) AS args, regexp_extract(s, '(?s)^\\[(\\w+)\\((.*)\\) -> (.*)\\]$', 3) AS result
    FROM (SELECT event_id, '[' || event_type || '(' || props || ') -> ' || CAST(user_id AS VARCHAR) || ']' AS s FROM events)""")
def _(spark, sf):
    s = F.concat(F.lit("["), "event_type", F.lit("("), "props", F.lit(") -> "), F.col("user_id").cast("string"), F.lit("]"))
    return _t("events")(spark, sf).select("event_id", scalars.tool_text(s).alias("e")).select("event_id", "e.*")


@query("number_extract", """SELECT doc_id, CAST(len(v) AS BIGINT) AS n, round(coalesce(list_sum(list_filter(v, lambda x: x < 1e9)), 0), 2) AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(text,
    '(?:^|[^\\pL\\pM\\p{Nd}\\p{Pc}.])\\$?\\s*((?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]+)?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS v FROM documents)""")
def _(spark, sf):
    v = scalars.numbers_in(F.col("text"))
    return _t("documents")(spark, sf).select("doc_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(F.filter(v, lambda x: x < 1e9), F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query("strict_label", "SELECT event_id, abs(floor(value) - CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) <= 0.5 AS label FROM events")
def _(spark, sf):
    text = F.concat(F.lit("the total is $"), F.floor("value").cast("string"), F.lit(" in all"))
    return _t("events")(spark, sf).select("event_id", scalars.strict_label(text, F.get_json_object("props", "$.k").cast("double")).alias("label"))


@query("score_parse", "SELECT event_id, CASE WHEN regexp_matches(s, '^\\s*\\d{1,3}\\.?\\s*$') AND CAST(regexp_extract(s, '\\d+') AS INTEGER) <= 100 THEN CAST(regexp_extract(s, '\\d+') AS INTEGER) END AS score FROM (SELECT event_id, ' ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || CASE event_id % 3 WHEN 0 THEN '.' WHEN 1 THEN '!' ELSE '' END AS s FROM events)")
def _(spark, sf):
    mark = F.when(F.col("event_id") % 3 == 0, ".").when(F.col("event_id") % 3 == 1, "!").otherwise("")
    return _t("events")(spark, sf).select("event_id", scalars.parse_score(F.concat(F.lit(" "), F.floor("value").cast("string"), mark)).alias("score"))


@on_steps("render_trace", "SELECT uid, sha256(string_agg('Step ' || CAST(step_idx + 1 AS VARCHAR) || ':' || chr(10) || CASE WHEN tool_name IS NULL THEN '  model: ' || text ELSE '  tool call: ' || tool_name || '(' || replace(args, ' ', '') || ')' || chr(10) || '  tool result' || CASE WHEN tool_error THEN ' (error)' ELSE '' END || ': ' || result END, chr(10) ORDER BY step_idx)) AS trace FROM steps WHERE step_idx <= 3 GROUP BY uid")
def _(runs, rows):
    return judge.render_traces(rows, 3).select("uid", F.sha2("trace", 256).alias("trace"))


# Beyond SQL


@query("text_hash", """WITH c AS (SELECT conv_id, turn, unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: ((CAST(unicode(substr(text, i, 1)) AS HUGEINT) * 4398046511104
    + xor(CAST(unicode(substr(text, i + 1, 1)) AS HUGEINT) * 2097152, CAST(unicode(substr(text, i + 2, 1)) AS HUGEINT))) * 11400714819323198485 % 18446744073709551616) // 8589934592 % 32)) AS bucket FROM conversations WHERE length(text) >= 3),
n AS (SELECT conv_id, turn, bucket, count(*) AS n FROM c GROUP BY ALL) SELECT conv_id, turn, CAST(bucket AS BIGINT) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM n""")
def _(spark, sf):
    hashed = _t("conversations")(spark, sf).dropDuplicates(["conv_id", "turn"]).withColumn("v", steps.text_hash(F.col("text")))
    return hashed.select("conv_id", "turn", F.posexplode("v").alias("bucket", "value")).where("value > 0").select("conv_id", "turn", F.col("bucket").cast("long").alias("bucket"), r6("value", "value"))


@on_steps("unit_disjoint_split", """SELECT uid, CASE WHEN part = 'test' THEN 'test' WHEN failure_class IS NULL AND before + nth <= last THEN part ELSE 'dropped' END AS role FROM
    (SELECT *, CASE WHEN before < 40 THEN 'fit' WHEN before < 60 THEN 'validation' ELSE 'test' END AS part, CASE WHEN before < 40 THEN 40 ELSE 20 + (SELECT min(before) FROM u WHERE before >= 40) END AS last FROM
    (WITH u AS (SELECT task_group, coalesce(sum(h) OVER (ORDER BY md5('1:' || task_group), task_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT task_group, count(*) FILTER (failure_class IS NULL) AS h FROM runs GROUP BY 1)) SELECT runs.*, before, row_number() OVER (PARTITION BY task_group ORDER BY CASE WHEN failure_class IS NULL THEN 0 ELSE 1 END, uid) AS nth FROM runs JOIN u USING (task_group))
    , LATERAL (SELECT 1))""".replace("(SELECT min(before) FROM u WHERE before >= 40)", "(SELECT min(b) FROM (SELECT coalesce(sum(h) OVER (ORDER BY md5('1:' || task_group), task_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT task_group, count(*) FILTER (failure_class IS NULL) AS h FROM runs GROUP BY 1)) WHERE b >= 40)"))
def _(runs, rows):
    return curve.unit_disjoint_split(runs, "task_group", 40, 20, 1)


@on_features("logistic_oof")
def _(runs, feats):
    table = prefix.prefix_features(feats, (3,)).join(runs.select("uid", "task_group", (F.col("family") == "llama").cast("int").alias("y")), "uid")
    folds = runs.select("uid", (F.substring("task_group", 2, 20).cast("long") % 3).cast("int").alias("fold"))
    names = ["tl__is_error__rate", "ms__log_latency__mean", "ms__synth_text_log_chars__mean"]
    return metrics.auroc(models.out_of_fold(scratch.cut(table), folds, names), [])


@on_features("monitor_scores")
def _(runs, feats):
    feats = scratch.cut(feats)
    healthy = feats.join(runs.where("failure_class IS NULL AND family = 'qwen'").select("uid"), "uid", "left_semi")
    m = monitor.Monitor({"m": ["log_latency", "log_output_tokens", "is_error"], "x": ["exact_repeat", "steps_since_error"]})
    scores = m.fit(healthy).score(feats)
    return monitor.episode_scores(scores, 5.0)


_TRACE = "SELECT uid, string_agg('Step ' || CAST(step_idx + 1 AS VARCHAR) || ':' || chr(10) || CASE WHEN tool_name IS NULL THEN '  model: ' || text ELSE '  tool call: ' || tool_name || '(' || replace(args, ' ', '') || ')' || chr(10) || '  tool result' || CASE WHEN tool_error THEN ' (error)' ELSE '' END || ': ' || result END, chr(10) ORDER BY step_idx) AS trace FROM steps WHERE step_idx <= 2 GROUP BY uid"


def _prompts(rows):
    return judge.render_traces(rows, 2).select(F.lit("stub").alias("judge"), F.lit("none").alias("model"), F.lit(judge.prompt_hash("$trace")).alias("prompt_hash"), "uid", F.lit(2).alias("t"), F.lit(0).alias("sample"), judge.prompt("$trace", F.lit(""), F.col("trace")).alias("prompt"))


def _answers(rows):
    """Scores of all prompts; those of runs whose name ends in 1 are in the cache, as 100."""
    prompts = _prompts(rows)
    cached = prompts.where(F.col("uid").endswith("1")).drop("prompt").withColumn("response", F.struct(F.lit("100").alias("text"), F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(0.0).alias("latency_s")))
    stub = lambda p: {"text": str(len(p) % 101) if len(p) % 7 else "none", "input_tokens": len(p), "output_tokens": 1}
    return judge.collect_scores(prompts, cached, stub, scratch.cut)


_STUB = f"sb AS (SELECT uid, ends_with(uid, '1') AS hit, length(trace) AS n FROM ({_TRACE})), sr AS (SELECT uid, CASE WHEN hit THEN 100 WHEN n % 7 <> 0 THEN n % 101 END AS score, CASE WHEN hit THEN 1 ELSE n END AS tokens FROM sb)"


@on_steps("judge_cache", f"SELECT uid, 2 AS t, CAST(score AS DOUBLE) AS score, CAST(score IS NULL AS BIGINT) AS n_failed FROM (WITH {_STUB} SELECT * FROM sr)")
def _(runs, rows):
    return judge.mean_scores(_answers(rows)).select("uid", "t", "score", "n_failed")


@on_steps("judge_summary", f"SELECT CAST(count(*) FILTER (score IS NULL) AS BIGINT) AS n_failed, count(*) AS n FROM (WITH {_STUB} SELECT * FROM sr)")
def _(runs, rows):
    return judge.run_summary(judge.mean_scores(_answers(rows))).select("n_failed", "n")


@on_steps("judge_budget", f"SELECT uid, round(c, 6) AS cost FROM (SELECT uid, c, sum(c) OVER (ORDER BY n) AS total FROM (SELECT uid, strlen(trace) AS n, strlen(trace) * 0.01::DOUBLE + 0.08::DOUBLE AS c FROM ({_TRACE}))) WHERE total <= 300")
def _(runs, rows):
    """The shortest prompts first, until 300 are spent: every call costs what was set aside for it."""
    prompts = _prompts(rows).withColumn("place", F.octet_length("prompt"))
    stub = lambda p: {"text": "50", "input_tokens": len(p.encode()), "output_tokens": 4}
    path = scratch.folder(rows.sparkSession, "calls")
    done, _ = judge.judged_within(prompts, stub, path, 300.0, 0.01, 0.02, 4, "place", attempts=1)
    return done.select("uid", r6("cost", "cost"))


@on_steps("judge_spent", f"SELECT round(sum(tokens * 0.01::DOUBLE + 0.02::DOUBLE), 6) AS spent, count(*) AS n FROM (WITH {_STUB} SELECT * FROM sr)")
def _(runs, rows):
    return judge.spent(_answers(rows).select("response.*"), 0.01, 0.02).select(r6("spent", "spent"), "n")


@on_steps("judge_preflight", f"SELECT 'stub' AS judge, 'none' AS model, count(*) AS n, CAST(max(length(trace)) AS INTEGER) AS longest, count(*) FILTER (length(trace) > 300) AS n_too_long FROM ({_TRACE})")
def _(runs, rows):
    return judge.preflight(_prompts(rows), 100).select("judge", "model", "n", "longest", "n_too_long")


@on_steps("label_invariant", "SELECT uid, 2 AS t FROM runs WHERE false")
def _(runs, rows):
    flipped = rows.join(runs.select("uid", "failure_class"), "uid").withColumn("failure_class", F.when(F.col("failure_class").isNull(), "looping"))
    return judge.label_invariant(_prompts(rows), _prompts(flipped))


@on_steps("under_budget", "SELECT uid, step_idx FROM steps WHERE step_idx <= (SELECT max(step_idx) FROM (SELECT step_idx, sum(sum(latency_s)) OVER (ORDER BY step_idx) AS total FROM steps GROUP BY step_idx) WHERE total <= (SELECT sum(latency_s) * 0.5::DOUBLE FROM steps))")
def _(runs, rows):
    cap = rows.agg(F.sum("latency_s")).first()[0] * 0.5
    return judge.under_budget(rows, "latency_s", cap, "step_idx").select("uid", F.col("step_idx").cast("long").alias("step_idx"))


@query("streaming_alarm", """SELECT f.uid, f.step_idx, exact_repeat, steps_since_error, round(max(s.latency_s) OVER (PARTITION BY f.uid ORDER BY f.step_idx), 6) AS running_max,
    f.step_idx IS NOT DISTINCT FROM min(CASE WHEN s.latency_s > 100 THEN f.step_idx END) OVER (PARTITION BY f.uid) AS first_alarm FROM feat f JOIN steps s ON f.uid = s.uid AND f.step_idx = s.step_idx""", FEATURE_CTES)
def streaming_alarm(spark, sf):
    _, rows = events.load(spark, sf)
    source, sink = scratch.folder(spark, "steps"), scratch.folder(spark, "alarms")
    keep = scratch.cut(rows.select("uid", "step_idx", "tool_name", "args", "tool_error", "latency_s"))
    third = [float("-inf"), *keep.approxQuantile("step_idx", [0.34, 0.67], 0.01), float("inf")]
    for low, high in zip(third, third[1:]):  # a micro-batch each; runs go on from one to the next, by the state of the query before
        keep.where((F.col("step_idx") > low) & (F.col("step_idx") <= high)).write.mode("append").parquet(source)
        stream = online.score_stream(online.replay(spark, source, keep.schema, files_per_batch=1_000_000), 100.0)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{sink}-log").outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()
    scratch.removed(spark, source)
    scratch.removed(spark, f"{sink}-log")
    return spark.read.parquet(sink).select("uid", "step_idx", "exact_repeat", "steps_since_error", r6("running_max", "running_max"), "first_alarm")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log to runs, features, labels and a rank metric."""
    return QUERIES["matched_step_auroc"](spark, sf_dir)
