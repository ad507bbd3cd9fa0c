"""Pairs of texts whose sets of word shingles overlap: complete candidates, verified.

Texts are compared by the sets of 64-bit hashes of their shingles of ``width`` words, with A-Z in
lower case; equal sets are one set, ``sid``. All sets share one order of the shingles, rare ones
first. Two sets of similarity ``t`` or more share one of their first n - ceil(t n) + 1 shingles each
(prefix filter), so the sets with such a shingle in common hold all pairs; sizes and the places of the
shared shingle rule out others, and so does having too little in common among all of the first ones;
only what is left is decided on whole sets. Which shingles are common is estimated on a sample of the texts: the
order changes the work, never the pairs.

Pairs within a component known already need no check. So the members of a shingle are first held
against four of them, and after that only against those of other components. The four are those with
the fewest rarer shingles before it: near copies have rare shingles where they were changed, so these
are the least changed, and most like the rest. As long as many pairs are left and links come, that is
repeated with four times as many. Members whose place rules out all others of their shingle's group
are dropped before any pair is made. Large families of near copies come together that way; what is
left is quadratic only in texts that share a rare shingle early and still are in different components.

Cases: texts of fewer than ``width`` words are one shingle; those without words have no pairs here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.shared import components, cut, map_batches
from tracewell.llm.words import Words, lower_ascii, rolling, slices

#: One in so many texts is sampled for common shingles; sampled texts that make one common; the most kept.
SAMPLED, COMMON, MOST_COMMON = 16, 3, 200_000
#: Ids and hashes that are broadcast at most.
MOST_SENT = 500_000
#: Leaders of a shingle's group in the first round and in the last one; pairs for each member that make another round.
LEADERS, MOST_LEADERS, MANY = 4, 64, 16
_CHUNK = 2 << 20
_EPS = 1e-9


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text in UTF-8."""
    for a, b in slices(texts, _CHUNK):
        w = Words([lower_ascii(t) for t in texts[a:b]])
        h = w.hashes()
        runs = rolling(h, width)
        for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if y - x >= width:
                yield np.unique(runs[x : y - width + 1])
            else:
                yield rolling(h[x:y], y - x) if y > x else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def set_ids(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The id of each text's set, as a signed long, and its size."""
    found = [(set_id(s), len(s)) for s in shingle_sets(texts, width)]
    return np.array([f[0] for f in found], np.uint64).view(np.int64), np.array([f[1] for f in found], np.int64)


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of a set: rare ones by hash, then common ones, the commonest last."""
    p = len(s) - math.ceil(threshold * len(s) - _EPS) + 1
    if not len(common):
        return s[:p]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    known = common[at] == s
    light = s[~known]
    if len(light) >= p:
        return light[:p]
    heavy = s[known][np.argsort(rank[at[known]], kind="stable")]
    return np.concatenate((light, heavy))[:p]


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles in order, and the rank of each by how common it is."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [*shingle_sets(_bytes(b.column("text")), width), np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    some = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = map_batches(some, scan, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    rows = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def _sets(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """(sid, n, prefix): the set of each text, its size and its prefix shingles in order. Copies may repeat it."""
    sent = texts.sparkSession.sparkContext.broadcast(_common(texts, width))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, sid, n, seen = [np.zeros(0, np.uint64)], [], [], set()
            for s in shingle_sets(_bytes(b.column("text")), width):
                i = set_id(s)
                if len(s) and i not in seen:
                    seen.add(i)
                    h.append(prefix(s, *sent.value, threshold))
                    sid.append(i)
                    n.append(len(s))
            ends = pa.array(np.cumsum([len(x) for x in h]), pa.int32())
            parts = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(h).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(n, pa.int32()), parts], names=["sid", "n", "prefix"])

    return map_batches(texts.select("text"), scan, "sid long, n int, prefix array<long>")


def _possible(threshold: float) -> Column:
    """Whether members x and y of a shingle, if it is the first that they share, can be similar enough."""
    least = threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n")) - _EPS
    return (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= least) & (F.col("x.component") != F.col("y.component"))


def _placed(threshold: float) -> Column:
    """Whether a member of a shingle can be in a pair that is possible: with the ``smallest`` set of its group, or of its own reach."""
    return F.col("n") - F.col("pos") >= threshold / (1 + threshold) * (F.col("n") + F.greatest(F.col("smallest"), threshold * F.col("n"))) - _EPS


def _enough(threshold: float) -> Column:
    """Whether sets a and b can be similar enough by their prefixes.

    What they share and is not in both prefixes lies beyond that prefix which ends first, so it is at
    most the larger remainder. In common the prefixes have at most their equal codes of 31 bits and
    those shingles of one of them that share a code.
    """
    both = F.size(F.array_intersect("codes_a", "codes_b")) + F.least(F.col("p_a") - F.size("codes_a"), F.col("p_b") - F.size("codes_b"))
    return both + F.greatest(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - _EPS


def links(docs: DataFrame, prints: DataFrame, known: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (u, v) between nodes that connect, with those of ``known (u, v)``, all similar texts.

    ``docs`` are (doc_id, text), ``prints`` (doc_id, fp, sid, n) of each document with an id: its
    set and the fingerprint that stands for it.
    """
    prints = prints.where("doc_id is not null and n > 0")
    homes = cut(prints.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("home")), small=True)
    equal = prints.join(homes, "sid").where("fp <> home").select(F.col("home").alias("u"), F.col("fp").alias("v")).distinct()
    links = cut(known.select("u", "v").unionAll(equal), small=True)

    sets = cut(_sets(docs.where("doc_id is not null and text is not null"), width, threshold))
    shared = sets.select("sid", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).where("least <> most").select("h")
    shared = cut(shared, small=True)
    members = sets.select("sid", "n", F.posexplode("prefix").alias("pos", "h"))
    members = members.join(F.broadcast(shared) if shared.count() <= MOST_SENT else shared, "h", "left_semi").distinct()
    members = cut(members.join(homes.select("sid", "home"), "sid"), small=True)
    if members.isEmpty():
        return links

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose prefixes have enough in common; see ``_enough``."""
        needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        codes = F.array_distinct(F.transform("prefix", lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int")))
        known = sets.join(needed, "sid", "left_semi").select("sid", "n", F.size("prefix").alias("p"), codes.alias("codes")).dropDuplicates(["sid"])
        known = cut(known, small=True)
        out = pairs
        for k in "ab":
            out = out.join(known.select(F.col("sid").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "p", "codes"))), k)
        return cut(out.where(_enough(threshold)).select("a", "b", "u", "v"), small=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in shingle_sets(_bytes(b.column("text")), width):
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s)], pa.uint64()).view(pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["sid", "shingles"])

    def verified(pairs: DataFrame) -> DataFrame:
        turned = F.col("x.sid") > F.col("y.sid")
        pairs = pairs.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"), F.when(turned, F.col("y.home")).otherwise(F.col("x.home")).alias("u"), F.when(turned, F.col("x.home")).otherwise(F.col("y.home")).alias("v"))
        pairs = possible(cut(pairs.distinct(), small=True))
        needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        needed = cut(homes.join(needed, "sid", "left_semi").select("rep").distinct(), small=True)
        n = needed.count()
        sets = docs.join(F.broadcast(needed) if n <= MOST_SENT else needed, docs["doc_id"] == needed["rep"], "left_semi").select("text")
        sets = cut(map_batches(sets, scan, "sid long, shingles array<long>"))
        if sets.count() > n:  # of repeated ids
            sets = sets.dropDuplicates(["sid"])
        pairs = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("t")), "b")
        both = F.size(F.array_intersect("s", "t"))
        return cut(pairs.where(both * (1 + threshold) >= threshold * (F.size("s") + F.size("t")) - _EPS).select("u", "v").distinct(), small=True)

    def now() -> DataFrame:
        found = components(links)
        return members.join(found, members["home"] == found["node"], "left").select("h", "sid", "n", "pos", "home", F.coalesce("component", "home").alias("component"))

    def undecided(m: DataFrame) -> DataFrame:
        """Members that a pair of two components can have, by their place and the smallest set of their group."""
        for _ in range(2):  # what the first turn drops can leave a group with one component
            groups = m.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("n").alias("smallest")).where("least <> most")
            m = cut(m.join(groups.select("h", "smallest"), "h").where(_placed(threshold)).drop("smallest"), small=True)
        return m

    def left(m: DataFrame) -> float:
        """Pairs of members of different components in a group, for each member."""
        of = m.groupBy("h", "component").agg(F.count("*").cast("double").alias("k")).groupBy("h").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
        rows, pairs = of.agg(F.sum("all"), F.sum(F.col("all") * F.col("all") - F.col("same")) / 2).first()
        return pairs / rows if rows else 0.0

    m, n = undecided(now()), LEADERS
    while n <= MOST_LEADERS and (n == LEADERS or left(m) > MANY):
        by = F.pmod(F.xxhash64("sid"), F.lit(n))  # the same for all shingles, so that they have leaders in common
        leaders = m.groupBy("h", by.alias("by")).agg(F.min(F.struct("pos", "sid", "n", "home", "component")).alias("l")).select("h", "l.*")
        star = verified(m.alias("x").join(leaders.alias("y"), F.col("x.h") == F.col("y.h")).where((F.col("x.sid") != F.col("y.sid")) & _possible(threshold)))
        if star.isEmpty():
            break
        links = cut(links.unionAll(star), small=True)
        m, n = undecided(now()), 4 * n
    rest = verified(m.alias("x").join(m.alias("y"), F.col("x.h") == F.col("y.h")).where((F.col("x.sid") < F.col("y.sid")) & _possible(threshold)))
    return links.unionAll(rest)
