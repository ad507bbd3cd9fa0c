"""Embedding near-dedup: exact threshold pairs by cover trees and their dual traversal.

Vectors compare only within equal, non-null labels (and equal dimensions). Two link if their cosine
in double precision is at least ``THRESHOLD``. On unit vectors that is a distance of at most
``sqrt(2 - 2 * THRESHOLD)``, by which a cover tree prunes: nested levels with halving radii, each
node a point that is also a node of the level below, every point of a node within its covering
radius. The dual traversal goes down pairs of nodes; a pair is dropped if its centres are further
apart than the threshold and both covering radii, and taken whole if they are so near that all its
points link. Pairs of points that remain are decided by their cosine.

Identical vectors under a label are put together first and count as often as they occur. A label of
more than ``BLOCK`` others is split at the upper levels of a tree: centres far from each other, taken
from a bounded sample and broadcast, each vector in the cell of its nearest centre and as a visitor in
the cells that may hold others within the threshold of it; large cells are split again. So copies of a
vector grow with the cells near it, not with the label. A cell that centres don't split (vectors that
lie everywhere, or all in one place) is dealt to blocks of about ``BLOCK``, each pair of blocks a task.
A task builds one tree per side and returns, per vector, how many it links with, and for components
one edge per vector at most; pairs are never written out.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing,
nor do rows with a null label or a null vec_id; repeated rows are vectors of their own, which link;
an id with several vectors has a row and a count for each, and connects what any of them links with;
a cosine of exactly the threshold links; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import components, cut, map_batches, partitions, table

THRESHOLD = 0.98
BLOCK = 8192
#: Points that a node holds without children, and rows of a distance matrix made at once.
LEAF, ROWS = 32, 1024
_SLACK = 1e-7
#: Vectors of a cell that its centres are chosen among, about; centres of a cell, levels, and bytes of
#: all centres of a level, at most.
SAMPLED, MOST_CENTRES, MOST_LEVELS, MOST_CENTRE_BYTES = 768, 256, 12, 64 << 20


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Node:
    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, centre: int, radius: float, points: np.ndarray, children: list["Node"]):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children


class CoverTree:
    """Nested levels over unit vectors ``x``; ``order`` of a node's points starts with its centre."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.root = self._node(np.arange(len(x)), 1.0)

    def _node(self, points: np.ndarray, r: float) -> Node:
        far = float(_distance(self.x[points[:1]], self.x[points]).max())
        if len(points) <= LEAF or far <= _SLACK:
            return Node(points[0], far, points, [])
        while r >= far:  # all would be within the first child
            r /= 2
        return Node(points[0], far, points, [self._node(p, r / 2) for p in self._net(points, r)])

    def _net(self, points: np.ndarray, r: float) -> list[np.ndarray]:
        """Split into balls of radius r whose centres, first in each, are further than r apart."""
        out, rest = [], points
        while len(rest):
            head = rest[:256]
            near = _distance(self.x[head], self.x[head]) <= r
            taken, covered = [], np.zeros(len(head), bool)
            for k in range(len(head)):
                if not covered[k]:
                    taken.append(k)
                    covered |= near[k]
            own, closest = np.empty(len(rest), np.int64), np.empty(len(rest))
            for a in range(0, len(rest), ROWS):
                d = _distance(self.x[rest[a : a + ROWS]], self.x[head[taken]])
                own[a : a + ROWS] = d.argmin(1)
                closest[a : a + ROWS] = d.min(1)
            own[taken], closest[taken] = np.arange(len(taken)), 0
            for k, t in enumerate(taken):
                ball = rest[(own == k) & (closest <= r)]
                out.append(np.concatenate(([head[t]], ball[ball != head[t]])))
            left = closest > r
            left[: len(head)] = False
            missed = np.flatnonzero(closest[: len(head)] > r)  # by rounding: covered, but no centre within r
            out += [rest[k : k + 1] for k in missed if k not in taken]
            rest = rest[left]
        return out


class Links:
    """Gathers how many each point links with, and what is connected, over the points of several sides."""

    def __init__(self, sides: list["Side"], threshold: float):
        self.sides, self.threshold = sides, threshold
        self.eps = float(np.sqrt(2 - 2 * threshold))
        self.counts = [np.zeros(len(s.x), np.int64) for s in sides]
        self.first = np.cumsum([0] + [len(s.x) for s in sides])
        self.root = np.arange(self.first[-1])

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        p, q = self.find(i), self.find(j)
        if p != q:
            self.root[max(p, q)] = min(p, q)

    def run(self, i: int, j: int) -> None:
        """All links between sides i and j."""
        same = i == j
        self.a, self.b, self.count = self.sides[i], self.sides[j], (self.counts[i], self.counts[j])
        self.base, self.shift = int(self.first[i]), int(self.first[j])
        todo = [(self.a.tree.root, self.b.tree.root)]
        while todo:
            m, n = todo.pop()
            if not m.children and not n.children:
                self.points(m, n)
                continue
            # Go down the wider side, or both.
            down = [m.children or [m], n.children or [n]]
            if m is not n and m.children and n.children:
                if m.radius > 2 * n.radius:
                    down[1] = [n]
                elif n.radius > 2 * m.radius:
                    down[0] = [m]
            ca, cb = (np.array([k.centre for k in side]) for side in down)
            ra, rb = (np.array([k.radius for k in side]) for side in down)
            for start in range(0, len(ca), ROWS):
                part = slice(start, start + ROWS)
                d = _distance(self.a.x[ca[part]], self.b.x[cb])
                reach = ra[part, None] + rb[None, :]
                maybe = d <= self.eps + reach + _SLACK
                if same and m is n:
                    maybe &= np.arange(len(cb))[None, :] >= np.arange(len(ca))[part, None]
                whole = maybe & (d + reach <= self.eps - _SLACK)
                for i, j in zip(*np.nonzero(maybe)):
                    p, q = down[0][start + i], down[1][j]
                    if whole[i, j]:
                        self.all(p, q)
                    else:
                        todo.append((p, q))

    def all(self, m: Node, n: Node) -> None:
        """Every point of m with every point of n."""
        wa, wb = self.a.copies, self.b.copies
        if m is n:
            self.count[0][m.points] += wa[m.points].sum() - wa[m.points]
        else:
            self.count[0][m.points] += wb[n.points].sum()
            self.count[1][n.points] += wa[m.points].sum()
        first = int(m.points[0]) + self.base
        for i in m.points[1:].tolist():
            self.join(first, i + self.base)
        for j in n.points.tolist():
            self.join(first, j + self.shift)

    def points(self, m: Node, n: Node) -> None:
        """Decide by cosine."""
        a, b = m.points, n.points
        for start in range(0, len(a), ROWS):
            rows = a[start : start + ROWS]
            hit = (self.a.raw[rows] @ self.b.raw[b].T) / (self.a.norm[rows, None] * self.b.norm[None, b]) >= self.threshold
            if m is n:
                hit[np.arange(len(rows)), start + np.arange(len(rows))] = False
            if not hit.any():
                continue
            self.count[0][rows] += hit @ self.b.copies[b]
            if m is not n:
                self.count[1][b] += self.a.copies[rows] @ hit
            # Connect by the least label over the hits, rather than hit by hit.
            row, col = np.arange(len(rows)), len(rows) + np.arange(len(b))
            while True:
                new_row = np.minimum(row, np.where(hit, col[None, :], 1 << 40).min(1))
                new_col = np.minimum(col, np.where(hit, new_row[:, None], 1 << 40).min(0))
                if (new_row == row).all() and (new_col == col).all():
                    break
                row, col = new_row, new_col
            ids = np.concatenate((rows + self.base, b + self.shift))
            for k, l in enumerate(np.concatenate((row, col)).tolist()):
                if l != k:
                    self.join(int(ids[k]), int(ids[l]))


class Side:
    """One block: raw vectors, how often each occurs, and the tree over them at unit length."""

    def __init__(self, raw: np.ndarray, copies: np.ndarray):
        self.raw, self.copies = raw, copies
        self.norm = np.sqrt((raw * raw).sum(1))
        self.x = raw / self.norm[:, None]
        self.tree = CoverTree(self.x)


def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, v, digest); v is the components' bytes, null if the row links with nothing."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw: list[bytes | None] = []
            able = b.column("able").to_pylist()
            for ok, v in zip(able, b.column("v")):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) if ok and v.is_valid else np.zeros(0)
                raw.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)  # + 0.0: -0.0 is 0.0
            dims = [None if x is None else len(x) // 8 for x in raw]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "v"])

    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    named = named.withColumn("able", F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return map_batches(named, scan, "vec_id long, label string, dim int, v binary").withColumn("digest", F.sha2("v", 256))


def _reach(x: np.ndarray, centres: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each unit vector, and which centres' cells may hold others within ``eps`` of it.

    A vector in the cell of another centre lies on that centre's side of the plane between the two, so
    one that is further than ``eps`` from the plane has nothing there.
    """
    d2 = np.maximum(2 - 2 * (x @ centres.T), 0)
    own = d2.argmin(1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
    return own, d2 - d2[np.arange(len(x)), own][:, None] <= 2 * (eps + _SLACK) * apart[own] + _SLACK


def top_level(x: np.ndarray, n: int, eps: float, block: int) -> np.ndarray | None:
    """Centres that split a cell of n vectors, of which the unit vectors x are a sample.

    They are the furthest from each other, like those of a tree's upper level, and as many of them as
    leave the least work; None if blocks would take no more copies of the vectors, or little more work.
    """
    chosen, far = [0], _distance(x[:1], x)[0]
    while len(chosen) < min(MOST_CENTRES, len(x) // 2, max(2, 8 * n // block)) and far.max() > _SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(x[chosen[-1:]], x)[0])
    best, least = None, 0.25
    k = len(chosen)
    while k > 1:
        own, there = _reach(x, x[chosen[:k]], eps)
        work = float((np.bincount(own, minlength=k) / len(x)) @ (there.sum(0) / len(x)))
        if there.sum(1).mean() < max(1.5, n / block / 2) and work < least:
            best, least = x[chosen[:k]], work
        k //= 2
    return best


KEY = ["label", "dim", "cell"]


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each run of equal keys, from batches sorted by key."""
    now, parts = None, []
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in key)))
        edge = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for x, y in zip(edge, edge[1:]):
            if x == y:
                continue
            if keys[x] != now:
                if parts:
                    yield now, pa.Table.from_batches(parts)
                now, parts = keys[x], []
            parts.append(b.slice(x, y - x))
    if parts:
        yield now, pa.Table.from_batches(parts)


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1))[:, None]


def cells(one: DataFrame, threshold: float, block: int) -> DataFrame:
    """``one`` with ``cell`` and ``home``: each vector in the cell of its nearest centre, and in others as a visitor.

    All links of a vector are with what is in its home cell. Cells of more than ``block`` vectors are
    split, level by level, as long as that pays.
    """
    spark, eps = one.sparkSession, float(np.sqrt(2 - 2 * threshold))
    now, done = one.withColumns({"cell": F.lit(""), "home": F.lit(True)}), []

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches, KEY):
            found = top_level(_unit(_vectors(rows.column("v"), key[1])), rows.column("n")[0].as_py(), eps, block)
            if found is not None:
                yield pa.RecordBatch.from_pydict({"label": [key[0]], "dim": pa.array([key[1]], pa.int32()), "cell": [key[2]], "centres": pa.array([found.tobytes()], pa.binary())})

    for level in range(MOST_LEVELS):
        n = F.count("*")
        large = cut(now.groupBy(*KEY).agg(n.alias("n"), F.max("home").alias("some")).where((F.col("n") > block) & F.col("some")).select(*KEY, "n"), small=True)
        if large.isEmpty():
            break
        sample = now.join(large, KEY).where(F.pmod(F.xxhash64("digest", F.lit(level)), F.col("n")) < SAMPLED).select(*KEY, "n", "v")
        sample = sample.repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, "v")
        chosen = cut(map_batches(sample, choose, "label string, dim int, cell string, centres binary"), small=True)
        # What is broadcast is bounded: cells beyond that wait for the next level.
        rows, sent_bytes = [], 0
        for r in chosen.orderBy(F.length("centres"), *KEY).limit(MOST_CENTRE_BYTES // (2 << 10)).toLocalIterator():
            sent_bytes += len(r["centres"])
            if sent_bytes > MOST_CENTRE_BYTES:
                break
            rows.append(r)
        if not rows:
            break
        sent = spark.sparkContext.broadcast({(r["label"], r["dim"], r["cell"]): np.frombuffer(bytes(r["centres"]), np.float64).reshape(-1, r["dim"]) for r in rows})
        marked = now.join(chosen.select(*KEY, F.lit(True).alias("split")), KEY, "left").select(*now.columns, "split")
        done.append(marked.where("split is null").drop("split"))

        def deal(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = list(zip(*(b.column(c).to_pylist() for c in KEY)))
                for key in dict.fromkeys(keys):
                    at = np.array([k for k, other in enumerate(keys) if other == key])
                    mine = b.take(pa.array(at))
                    if key not in sent.value:
                        yield mine
                        continue
                    for a in range(0, len(at), ROWS):
                        part = mine.slice(a, ROWS)
                        own, there = _reach(_unit(_vectors(part.column("v"), key[1])), sent.value[key], eps)
                        row, centre = np.nonzero(there)
                        out = part.take(pa.array(row))
                        cell = pa.array([f"{key[2]}.{c}" for c in centre.tolist()], pa.string())
                        home = pa.array(out.column("home").to_numpy(zero_copy_only=False) & (own[row] == centre))
                        out = out.set_column(out.schema.get_field_index("cell"), "cell", cell)
                        yield out.set_column(out.schema.get_field_index("home"), "home", home)

        now = cut(map_batches(marked.where("split").drop("split"), deal, now.schema))
    for part in done:
        now = now.unionAll(part.select(*now.columns))
    return now


def _pairs(one: DataFrame, threshold: float, block: int) -> DataFrame:
    """(u, v, n): vector u links with n others; or, n null, ids u and v are connected."""
    spark = one.sparkSession
    now = cells(one, threshold, block)
    # Cells that no centres split go by pairs of blocks.
    large = now.groupBy(*KEY).count().where(F.col("count") > block).select(*KEY, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = now.join(large, KEY, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [*KEY, "i", "j"]
    task = dealt.select(*KEY, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "home", "node", "id", "v", "copies")
    dealt = task.repartition(partitions(spark), *key).sortWithinPartitions(*key, "own")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key_, rows in _runs(batches, key):
            own, home = rows.column("own").to_numpy(), rows.column("home").to_numpy()
            raw, copies = _vectors(rows.column("v"), key_[1]), rows.column("copies").to_numpy()
            kinds = [(block_, h) for block_ in dict.fromkeys(key_[3:]) for h in (True, False)]
            at = [np.flatnonzero((own == block_) & (home == h)) for block_, h in kinds]
            kinds, at = [k for k, a in zip(kinds, at) if len(a)], [a for a in at if len(a)]
            if not any(h for _, h in kinds):
                continue
            links = Links([Side(raw[a], copies[a]) for a in at], threshold)
            for x in range(len(kinds)):
                for y in range(x, len(kinds)):
                    # Visitors meet in their home cells; a block meets itself in one task.
                    if (kinds[x][1] or kinds[y][1]) and (kinds[x][0] != kinds[y][0]) == (key_[3] != key_[4]):
                        links.run(x, y)
            order = np.concatenate(at)
            node, ids = rows.column("node").to_numpy()[order], rows.column("id").to_numpy()[order]
            n = np.concatenate(links.counts) * home[order]
            some = np.flatnonzero(n)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), none, pa.array(n[some])], names=["u", "v", "n"])
            u, v = ids, ids[[links.find(k) for k in range(len(ids))]]
            joined = np.flatnonzero(u != v)
            yield pa.RecordBatch.from_arrays([pa.array(u[joined]), pa.array(v[joined]), pa.nulls(len(joined), pa.int64())], names=["u", "v", "n"])

    return map_batches(dealt, solve, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors (vec_id, embedding, label)``."""
    own = cut(_clean(vectors))
    able = own.where("v is not null")
    one = able.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    one = cut(one.withColumn("node", F.monotonically_increasing_id()), small=True)
    found = cut(_pairs(one, threshold, block))
    n = found.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    # An id with several vectors connects what they link with.
    several = able.groupBy("vec_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"), F.min("label").alias("first"), F.max("label").alias("last")).where("least <> most or first <> last")
    through = able.join(several.select("vec_id"), "vec_id", "left_semi").join(one.select("label", "dim", "digest", "id"), ["label", "dim", "digest"])
    edges = found.where("n is null").select("u", "v").unionAll(through.select("vec_id", "id"))
    reached = components(edges).withColumnRenamed("node", "id")
    named = one.select("label", "dim", "digest", "id", "copies", "node").join(n, "node", "left").join(reached, "id", "left")
    named = named.select("label", "dim", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rows = own.select("vec_id", "label", "dim", "digest").join(named, ["label", "dim", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding,
    vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
c AS (SELECT r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM e WHERE ok),
l AS (SELECT a.r, a.vec_id AS u, b.vec_id AS v FROM c a JOIN c b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
      WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
reach(u, v) AS (SELECT vec_id, vec_id FROM c UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u),
m AS (SELECT u, min(v) AS component FROM reach GROUP BY u),
n AS (SELECT r, count(*) AS n FROM l GROUP BY r)
SELECT vec_id, coalesce(n, 0) AS n_links, CASE WHEN ok THEN component ELSE vec_id END AS component_id,
       CASE WHEN ok THEN vec_id = component ELSE true END AS kept
FROM e LEFT JOIN n USING (r) LEFT JOIN m ON e.vec_id = m.u
"""
