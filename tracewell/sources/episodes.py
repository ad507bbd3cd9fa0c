"""Readers and writers of run tables, label files, score caches and results."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.scalars import family_of, not_nan, numbers_in, six_digits, strict_label, tool_text
from tracewell.schema import EPISODE, METADATA, STEP

ORGANIC = ("organic_llama8b", "organic_llama8b_cold")
GROUP_COUNTS = ("n_healthy", "n_healthy_alarm", "n_pos", "n_pos_alarm", "n_pos_alarm_pre_tau", "n_pos_alarm_post")
CACHE_KEY = ("judge", "model", "prompt_hash", "uid", "t", "sample")


def parsed(raw: DataFrame) -> DataFrame:
    """JSON columns as structs, NaN onsets as null integers; T, a run's length, as ``len``."""
    return raw.withColumnRenamed("T", "len").withColumns({"steps": F.from_json("steps", T.ArrayType(STEP)), "metadata": F.from_json("metadata", METADATA), "tau": not_nan(F.col("tau")).cast("int")})


def raw_episodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EPISODE).parquet(path)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """All runs but organic ones, parsed, with their family. The corpus filter reaches the scan."""
    return parsed(raw_episodes(spark, path).where(~F.col("corpus").startswith("organic"))).withColumn("family", family_of(F.col("model")))


def final_synthesis_text(steps):
    """Text of the last synthesis step; null if there is none."""
    return F.try_element_at(F.filter(steps, lambda s: s["action"] == "synthesis"), F.lit(-1))["text"]


def adapted_steps(steps):
    """Old steps with ``[name(args) -> result]`` texts: the event moves into tool_events."""

    def adapt(s):
        event = tool_text(s["text"])
        made = F.struct(F.lit(None).cast("string").alias("id"), event["name"].alias("name"), event["args"].alias("args"), event["result"].alias("result"), F.length(event["result"]).alias("result_chars"), F.lit(False).alias("result_truncated"), F.lit(False).alias("is_error"), F.lit(None).cast("double").alias("latency_s"))
        events = F.when(event.isNotNull(), F.array(made)).otherwise(F.coalesce(s["tool_events"], F.array().cast(T.ArrayType(STEP["tool_events"].dataType.elementType))))
        return F.when(s["action"] == "tool_call", s.withField("tool_events", events)).otherwise(s)

    return F.transform(steps, adapt)


def unparsed_tool_steps(steps):
    return F.size(F.filter(steps, lambda s: (s["action"] == "tool_call") & tool_text(s["text"]).isNull()))


def read_organic(spark: SparkSession, path: str) -> DataFrame:
    """Organic runs: failed if no number of the final text is near the expected total; onset 0."""
    runs = parsed(raw_episodes(spark, path).where(F.col("corpus").isin(*ORGANIC)))
    good = strict_label(final_synthesis_text(F.col("steps")), F.col("metadata.expected_total"))
    return runs.withColumns(
        {
            "unparsed": unparsed_tool_steps(F.col("steps")),
            "steps": adapted_steps(F.col("steps")),
            "failure_class": F.when(~good, F.lit("organic_failed")),
            "tau": F.when(~good, F.lit(0)),
            "task_group": F.concat(F.lit("run:"), "uid"),
            "family": family_of(F.col("model")),
        }
    )


def read_json_files(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def manifest_ordered(episodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Runs in the order of a manifest's list ``episodes (array of ids)``."""
    order = manifest.select(F.posexplode("episodes").alias("position", "episode_id"))
    return episodes.join(order, "episode_id").orderBy("position")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length")


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A score cache of JSON lines: one row per key."""
    key = T.StructType([T.StructField(k, T.IntegerType() if k in ("t", "sample") else T.StringType()) for k in CACHE_KEY])
    row = T.StructType([T.StructField("key", key), T.StructField("response", T.StructType([T.StructField("text", T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("latency_s", T.DoubleType())]))])
    return spark.read.schema(row).json(path).select("key.*", "response")


def new_responses(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of ``fresh`` whose key the cache lacks. Another text under a known key fails the query."""
    known = cached.select(*CACHE_KEY, F.col("response.text").alias("known"))
    joined = fresh.join(known, list(CACHE_KEY), "left")
    clash = F.col("known").isNotNull() & (F.col("known") != F.col("response.text"))
    checked = joined.where(F.when(clash, F.raise_error(F.lit("another response under a cached key"))).otherwise(F.col("known").isNull()))
    return checked.drop("known").dropDuplicates(list(CACHE_KEY))


def append_cache(new: DataFrame, path: str) -> None:
    new.select(F.struct(*CACHE_KEY).alias("key"), "response").write.mode("append").json(path)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities of all double columns as null, for JSON."""
    return df.withColumns({f.name: F.when(F.abs(F.col(f.name)) < float("inf"), F.col(f.name)) for f in df.schema if f.dataType in (T.DoubleType(), T.FloatType())})


def write_json(df: DataFrame, path: str) -> None:
    """One document per row; what is null, NaN or infinite is written as null, not left out."""
    finite_or_null(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Doubles with six significant digits, without zeros at the end; NaN is empty."""
    short = {f.name: six_digits(F.col(f.name)) for f in df.schema if f.dataType == T.DoubleType()}
    df.withColumns(short).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def numbers_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, number) of every number in a text column."""
    return df.select(key, F.posexplode(numbers_in(F.coalesce(text, F.lit("")))).alias("position", "number"))


def read_group_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts per task group, as ``write_parquet`` leaves them; a missing count column fails the query."""
    counts = spark.read.parquet(path)
    missing = [c for c in GROUP_COUNTS if c not in counts.columns]
    if missing:
        raise ValueError(f"no columns {missing} in {path}")
    return counts


def read_template(path: str) -> str:
    """A prompt template; its hash must not depend on how the file was checked out."""
    with open(path, encoding="utf-8", newline="") as f:
        return f.read().replace("\r\n", "\n")


def read_config(path: str) -> dict:
    """A configuration in JSON, or in YAML where a parser for that is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path} needs a YAML parser; write it as JSON instead") from e
    return yaml.safe_load(text)


def flat_metrics(results: DataFrame, run: str) -> DataFrame:
    """(run, key, value): every numeric column of every row, the others of the row joined as the key's prefix."""
    numeric = [f.name for f in results.schema if isinstance(f.dataType, T.NumericType)]
    keys = [c for c in results.columns if c not in numeric]
    prefix = F.concat_ws(".", *(F.col(c).cast("string") for c in keys))
    pairs = F.array(*(F.struct(F.concat_ws(".", F.nullif(prefix, F.lit("")), F.lit(c)).alias("key"), F.col(c).cast("double").alias("value")) for c in numeric))
    return results.select(F.lit(run).alias("run"), F.explode(pairs).alias("p")).select("run", "p.*")


def log_metrics(results: DataFrame, run: str, path: str) -> None:
    """Add a run's metrics to a tracking table."""
    flat_metrics(results, run).write.mode("append").partitionBy("run").parquet(path)


def source_state(folder: str = ".") -> dict:
    """Commit and cleanliness of a work tree, for results to name what made them; nulls outside of one."""

    def git(*words: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    status = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "clean": None if status is None else not status}
