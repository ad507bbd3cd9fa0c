"""Mixing sources to target weights: pivotal dependent rounding of copy numbers.

DataFrame functions only. Sources, in the order of their code points with null last, weigh 1, 2, 3,
repeating. Their targets share the words of all documents by weight; none is above ``MOST`` times its
source's words, and what that leaves over is shared by weight among the others, until none is above.

Documents of a source want the same number of copies, its target by its size. Whole copies are given;
what remains is a probability, on which documents are paired: mass, in words, goes from one of a pair to
the other, at random in the direction and never in the mean, until one of the two is integral, and the
other goes on. So the words of a source are kept as they were, whatever comes out. Pairs form a tree:

- documents of one source and one power of two of words fall by hash into blocks of about ``BLOCK``; a
  block passes its mass along and leaves at most one document that isn't integral; these fall into
  blocks again, until every source and power has ``BLOCK`` documents at most;
- what is left of a source, a bounded list, is settled from its longest document to its shortest: each
  becomes integral at random, and what it gained or lost goes to those after it; if words are still
  owed at the end, documents of the list take or give whole copies, from the longest on, within 0 and
  ``MOST``. What a source then misses is less than a document of that list, by and large its shortest.

Blocks and random numbers are hashes of ids and sizes, so reruns agree. Rows with equal ids, sizes and
sources are interchangeable: they are put together first, and share their copies.

Minima of work under skew: a hot source splits by power and block; sizes are summed before the shuffle;
sources are looked up by broadcast if there are few, which is counted, else the hot ones alone. Only
the list of distinct sources is ordered, by ranges.

Cases: null and empty texts have no words and take none; a null source is a source; a null id is an id;
repeated rows each have a row in the result; ties of sizes are broken by hash; very long texts are
counted whole; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import cut, look_up, partitions, table

#: Copies of a document, and multiples of a source, at most; weights in turn.
MOST, WEIGHTS = 3, (1, 2, 3)
#: Documents of a block, about.
BLOCK = 32
#: Copies of a key that one row stands for until the last step.
CHUNK = 4096
_EPS = 1e-9
_SPACE = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """How many runs of other than white space a text has."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "w")
    return F.length(F.translate(marks, _SPACE, "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources (source, source_size, n)`` with ``target``."""
    order = F.col("source").asc_nulls_last()
    ranged = cut(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = dict(ranged.groupBy("part").count().collect())  # a row per partition
    before = [sum(n for p, n in counts.items() if p < k) for k in range(max(counts, default=0) + 1)]
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.get(F.array(*map(F.lit, before)), F.col("part"))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))).cast("int"))
    ranked = cut(ranged.withColumn("weight", weight).drop("part"))
    size = F.col("source_size")
    total = ranked.agg(F.sum(size)).first()[0] or 0
    share = 0.0
    while True:  # the share of a unit of weight only rises, so sources once above stay so
        above = F.lit(share) * F.col("weight") > most * size
        full, rest = ranked.agg(F.sum(F.when(above, size)), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - most * (full or 0)) / rest if rest else share
        if new == share or not rest:
            break
        share = new
    return ranked.withColumn("target", F.when(above, (most * size).cast("double")).otherwise(F.lit(share) * F.col("weight"))).drop("weight")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _uniform(*what) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


def _like(item: Column, p: Column) -> Column:
    return item.withField("p", p)


def _block(items: Column, kind: str, salt: int) -> Column:
    """Passes mass along a sorted list: (out: settled documents, carry: the one that isn't, or null)."""

    def step(state: Column, y: Column) -> Column:
        c = state["carry"]

        def duel(a: Column) -> Column:
            ratio = c["size"] / y["size"]
            up, down = F.least(1 - c["p"], y["p"] / ratio), F.least(c["p"], (1 - y["p"]) * ratio ** -1)
            return _let(F.struct(ratio.alias("ratio"), up.alias("up"), down.alias("down")), lambda d: moved(F.when(a * (d["up"] + d["down"]) < d["down"], d["up"]).otherwise(-d["down"]), d["ratio"]))

        def moved(delta: Column, ratio: Column) -> Column:
            return _let(F.struct((c["p"] + delta).alias("c"), (y["p"] - delta * ratio).alias("y")), settle)

        def settle(p: Column) -> Column:
            far = lambda q: F.least(q, 1 - q)  # noqa: E731  from integral
            first = F.least(far(p["c"]), F.lit(1.0)) <= F.greatest(F.lit(_EPS), far(p["y"]))
            second = (far(p["y"]) <= _EPS) | ~first
            cc, yy = _like(c, F.rint(p["c"])), _like(y, F.rint(p["y"]))
            out = F.concat(state["out"], F.when(first & second, F.array(cc, yy)).when(first, F.array(cc)).otherwise(F.array(yy)))
            carry = F.when(first & second, F.lit(None).cast(kind)).when(first, _like(y, p["y"])).otherwise(_like(c, p["c"]))
            return F.struct(out.alias("out"), carry.alias("carry"))

        return F.when(c.isNull(), F.struct(state["out"].alias("out"), y.alias("carry"))).otherwise(duel(_uniform(c["key"], y["key"], F.lit(salt))))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast(kind).alias("carry"))
    return F.aggregate(items, start, step)


def _last(items: Column, kind: str, most: int) -> Column:
    """Settles a list from its first document to its last; ``owed`` are the words that those before lost."""

    def step(state: Column, y: Column) -> Column:
        def decide(want: Column) -> Column:
            took = F.when(_uniform(y["key"], F.lit(-1)) < want, 1.0).otherwise(0.0)
            return _let(took, lambda x: F.struct(F.concat(state["out"], F.array(_like(y, x))).alias("out"), (state["owed"] + (y["p"] - x) * y["size"]).alias("owed")))

        return _let(y["p"] + state["owed"] / y["size"], decide)

    def repair(state: Column, y: Column) -> Column:
        copies = y["base"] + y["p"]
        whole = F.when(state["owed"] > 0, F.floor(state["owed"] / y["size"] + 0.5)).otherwise(F.ceil(state["owed"] / y["size"] - 0.5)).cast("double")
        # Only what brings the owed words nearer to none; within what documents can give and take.
        add = F.greatest(-copies, F.least(whole, most * y["n"] - copies))
        return _let(add, lambda x: F.struct(F.concat(state["out"], F.array(_like(y, y["p"] + x))).alias("out"), (state["owed"] - x * y["size"]).alias("owed")))

    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(0.0).alias("owed"))
    first = F.aggregate(items, start, step)
    return _let(first, lambda f: F.aggregate(f["out"], F.struct(F.array().cast(f"array<{kind}>").alias("out"), f["owed"].alias("owed")), repair)["out"])


def rounded(wanted: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``wanted (source, doc_id, size, n, copies)`` with whole ``copies``: of n documents together."""
    base = F.floor(F.col("copies") + _EPS)
    p = F.col("copies") - base
    open_ = (F.col("size") > 0) & (p > _EPS)
    now = wanted.withColumns({"base": base, "p": F.when(open_, F.least(p, F.lit(1.0))).otherwise(0.0)})
    now = now.withColumns({"key": F.xxhash64("doc_id", "size"), "class": F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")})
    fields = ["key", "doc_id", "size", "n", "base", "p"]
    now = cut(now.select("source", "class", F.struct(*fields).alias("item")))
    kind = now.schema["item"].dataType.simpleString()
    done = [now.where("item.p = 0").select("source", "item")]
    now, level = now.where("item.p > 0"), 0
    while True:
        groups = now.groupBy("source", "class").count()
        if (groups.agg(F.max("count")).first()[0] or 0) <= block:
            break
        large = groups.where(F.col("count") > block).select(F.col("source").alias("s"), F.col("class").alias("c"), F.ceil(F.col("count") / block).alias("blocks"))
        marked = now.join(F.broadcast(large) if large.count() <= 200_000 else large, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left")
        small = marked.where("blocks IS NULL").select("source", "class", "item")
        dealt = marked.where("blocks IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("item.key", F.lit(level)), F.col("blocks")))
        lists = dealt.groupBy("source", "class", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
        solved = cut(lists.select("source", "class", _block(F.col("items"), kind, level).alias("b")))
        done.append(solved.select("source", F.explode("b.out").alias("item")))
        now = cut(small.unionAll(solved.where("b.carry IS NOT NULL").select("source", "class", F.col("b.carry").alias("item"))))
        level += 1
    lists = now.groupBy("source").agg(F.collect_list(F.struct((-F.col("item.size")).alias("o"), "item")).alias("items"))
    last = _last(F.transform(F.array_sort("items"), lambda x: x["item"]), kind, most)
    done.append(lists.select("source", F.explode(last).alias("item")))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.select("source", "item.doc_id", "item.size", "item.n", (F.col("item.base") + F.rint("item.p").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) of each row of ``docs (doc_id, text, source)``."""
    keys = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    keys = cut(keys)
    sources = cut(targets(keys.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")), weights, most), small=True)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = look_up(keys, sources.withColumn("rate", rate).select("source", "rate", "rows"), "source", "rows")
    whole = rounded(wanted.select("source", "doc_id", "size", "n", (F.col("n") * F.col("rate")).alias("copies")), most)
    # Equal rows share their copies; very many go through several rows first, so that no task makes them all.
    chunks = whole.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))))
    if (keys.agg(F.max("n")).first()[0] or 0) > CHUNK:
        chunks = chunks.repartition(partitions(docs.sparkSession))
    each = chunks.withColumn("k", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("n")) - 1)))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("k") < F.pmod(F.col("copies"), F.col("n"))).cast("long")
    rows = look_up(each.select("source", "doc_id", "size", copies.alias("copies")), sources, "source", "rows")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
