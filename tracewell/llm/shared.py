"""What several corpus operators need: cutting lineage, table access, and connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of an Arrow batch between the JVM and Python, at most; its default suits short rows.
BATCH_BYTES = 8 << 20


def _release() -> None:
    """Give freed memory back to the system, since workers idle on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def _bytes(setting: str) -> int:
    """Bytes of a size setting like 8m or 8388608b; negative for none."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` in batches that suit long texts, for any column names: it can't take dots in them."""
    names, conf = df.columns, df.sparkSession.conf
    if not 0 < _bytes(conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")

    def run(batches):
        try:
            yield from function(b.rename_columns(names) for b in batches)
        finally:
            _release()

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is unset, as
    in tests on one machine, a temporary folder of this machine takes its place.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty() and not jsc.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there.

    Reliable checkpoints outlive the executors that wrote them. Spark deletes them when nothing
    refers to them any more, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set. A
    ``small`` frame, of short rows fresh from a shuffle, goes to an eighth of the usual files.
    """
    shared_dir(df.sparkSession)
    return (df.coalesce(max(1, partitions(df.sparkSession) // 8)) if small else df).checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Distinct edges that one task connects by itself at most: 16 bytes each.
FEW_EDGES = 200_000
#: Neighbours from which a vertex's minimum is broadcast, unless a share of all edges is more.
HUB, HUB_SHARE = 200, 1 / 500


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges at once, by union-find on vertices in their order."""
    parts = [np.stack([b.column(c).to_numpy() for c in "uv"]) for b in batches]
    ids, ends = np.unique(np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64), return_inverse=True)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for u, v in ends.reshape(2, -1).T.tolist():
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[[find(i) for i in range(len(ids))]] if len(ids) else ids)], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has long columns ``u`` and ``v`` in any direction and with repeats. Returns one row
    per vertex on an edge: ``node`` and ``component``, the smallest vertex that it reaches. Rounds
    grow with the logarithm of a component's diameter. Each round aggregates minima, combined before
    the shuffle, and joins them back: those of hubs, of which there are two per ``HUB_SHARE`` at most,
    by broadcast, so that no task gets all edges of a hub; the others by a shuffle. No more than
    ``FEW_EDGES``, counted first, need no rounds: one task connects them.
    """

    def with_least(pairs: DataFrame, n: int, itself: bool) -> DataFrame:
        """``pairs (u, v)`` with m, the least v of each u, or u if ``itself`` and that is less."""
        m = F.least(F.min("v"), F.first("u")) if itself else F.min("v")
        least = pairs.groupBy("u").agg(m.alias("m"), F.count("*").alias("d"))
        hub = F.col("d") > max(HUB, int(n * HUB_SHARE))
        known = pairs.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("hub"))), "u", "left")
        others = known.where("hub is null").select("u", "v").join(least.where(~hub).select("u", "m"), "u")
        return known.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionAll(others.select("u", "v", "m"))

    def large(e: DataFrame, n: int) -> DataFrame:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return with_least(both, n, itself=True).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame, n: int) -> DataFrame:
        down = with_least(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n, itself=False)
        return down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), small=True)
    before, now = None, mark(e)
    if now[0] <= FEW_EDGES:
        return map_batches(e.coalesce(1), _connect, "node long, component long")
    while now != before:
        before, n = now, now[0]
        # Edges never get more: no more files than they fill.
        e = cut(small(large(e, n), n).coalesce(max(1, min(partitions(edges.sparkSession), n // 20_000))))
        now = mark(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


#: Keys that are broadcast at most; beyond that, the share of all rows from which a key is hot and still is.
MOST_SENT, HOT = 200_000, 1 / 1000


def look_up(rows: DataFrame, keys: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with the columns of ``keys``, which has each key of theirs once, null too, and ``n``, its rows.

    Few keys are broadcast. Of more, the hot ones are, ``1 / HOT`` of them at most, so that no task gets all
    rows of one; the others meet in a shuffle. ``n`` itself is left out.
    """
    own = [c for c in keys.columns if c not in (key, n)]
    side = keys.withColumnsRenamed({key: "_key"})
    same = F.col(key).eqNullSafe(F.col("_key"))
    count, total = keys.agg(F.count("*"), F.sum(n)).first()
    if count <= MOST_SENT:
        return rows.join(F.broadcast(side.drop(n)), same, "left").select(*rows.columns, *own)
    hot = F.col(n) >= total * HOT
    sent = rows.join(F.broadcast(side.where(hot).select("_key", *own, F.lit(True).alias("_hot"))), same, "left")
    others = sent.where("_hot IS NULL").select(*rows.columns).join(side.where(~hot).drop(n), same, "left")
    return sent.where("_hot IS NOT NULL").select(*rows.columns, *own).unionAll(others.select(*rows.columns, *own))
