"""SimHash near-duplicates: 64-bit fingerprints, linked by BK-trees within a small radius.

A fingerprint's bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's
3-word shingles, repeats included. Fingerprints that differ in at most ``RADIUS`` bits link.

Equal fingerprints are put together first, so copies cost one entry each. Distinct fingerprints are
dealt to shards: cut into four bands of 16 bits, two fingerprints within three bits agree in a band
at least, so both meet in that band's shard. Each shard builds a BK-tree, whose children hang under
their integer Hamming distance to the parent, and a search follows only the edges within the radius
of its own distance. A shard returns links that connect what it found (a spanning forest, at most
one link less than it has members), never all pairs.

Shard trees are built where their members are, rather than broadcast: no bound on the number of
distinct fingerprints can be proven, and a broadcast of all of them would grow with the corpus.

A shard that is too full (a family of texts with the same boilerplate) is dealt again by the bits
outside its band, which still may differ in three bits at most, so that four bands of 12 bits and
after that four of 9 lose no link either. The fullest shards are found by a count and dealt to other
tasks that way; at most ``MOST_FULL`` of them are named, so one that stays has no more than 1/1250 of
all distinct fingerprints, 8 bytes each. Within its task it is cut on, as often as it takes, until no
tree has more than ``FULL`` members, however many fingerprints there are.

Cases: null and empty texts have the fingerprint zero and link like any other; fewer than three
words are one shingle; very long texts are hashed whole, in bounded memory per chunk of texts;
repeated rows get a row each; a null doc_id links and connects others, but names no component (null,
where all of a component's ids are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import overlap
from tracewell.llm.shared import components, cut, fresh, map_batches, partitions, quoted, table
from tracewell.llm.words import SPACE, Words, lower_ascii, slices

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Members of a tree at most, and the shards at most that are dealt to other tasks for being fuller.
FULL, MOST_FULL = 2048, 20_000
#: Members that a shard has on average before all are cut twice.
EVEN = 64
_CHUNK = 2 << 20

#: _SPREAD[b]: the bits of byte b, each in a byte of its own.
_SPREAD = np.packbits(np.zeros((256, 64), np.uint8), axis=1).view(np.uint64).ravel()
for _bit in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of h[first[d]:first[d+1]] have each of the 64 bits set, lowest bit first."""
    n = np.diff(first)
    out = np.zeros((len(n), 64), np.int64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # Sums of at most 255 bytes fit in a byte: each text's hashes go in blocks of 255.
    blocks = -(-n[some] // 255)
    owner = np.repeat(some, blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = first[owner] + nth * 255
    lanes = h.view(np.uint8).reshape(-1, 8)
    begin = np.flatnonzero(np.diff(np.concatenate(([-1], owner))))
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, byte]], at)
        wide = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[some, 8 * byte : 8 * byte + 8] = np.add.reduceat(wide, begin, axis=0)
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts in UTF-8."""
    out = [np.zeros(0, np.uint64)]
    for a, b in slices(texts, _CHUNK):
        w = Words([lower_ascii(t) for t in texts[a:b]])
        # One space between words, so that a shingle is one slice.
        keep = ~SPACE[w.data]
        keep[w.end] = True  # the white space or line feed after a word
        data = w.data.copy()
        data[w.end] = 0x20
        raw = data[keep].tobytes()
        length = w.end - w.start
        begin = np.cumsum(length + 1) - (length + 1)
        end = begin + length
        n = np.diff(w.first)
        shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        first = np.concatenate(([0], np.cumsum(shingles)))
        start = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], shingles)
        stop = start + np.minimum(np.repeat(n, shingles), SHINGLE) - 1
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(begin[start].tolist(), end[stop].tolist())), np.uint64, first[-1])
        more = 2 * bit_counts(h, first) > shingles[:, None]
        out.append(np.packbits(more, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; with a ``width``, also ``sid, n`` of the text's set of shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            out = {"doc_id": b.column("doc_id"), "fp": pa.array(fingerprints(texts).view(np.int64), pa.int64())}
            if width is not None:
                out |= zip(("sid", "n"), map(pa.array, overlap.set_ids(texts, width)))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, scan, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long" + (", sid long, n long" if width is not None else ""))


class BKTree:
    """Integers under the Hamming distance. Children are keyed by their distance to the parent."""

    def __init__(self):
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        """Insert a value that the tree doesn't hold yet."""
        self.value.append(x)
        self.children.append({})
        if len(self.value) == 1:
            return
        at = 0
        while True:
            d = (self.value[at] ^ x).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.value) - 1
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of the values within the radius."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def forest(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that connect whatever such links connect, as pairs of positions."""
    tree, root, links = BKTree(), list(range(len(values))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((j, i))
        tree.add(x)
    return links


def _bands(x: np.ndarray, free: list[int], parts: int) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Cut the free bit positions into runs; yields each run's number, its bits of x, the bits left."""
    size = len(free) // parts
    for k in range(parts):
        run = free[k * size : (k + 1) * size if k < parts - 1 else len(free)]
        value = np.zeros(len(x), np.uint64)
        for bit in run:
            value = (value << np.uint64(1)) | ((x >> np.uint64(bit)) & np.uint64(1))
        yield k, value, [b for b in free if b not in run]


def shards(x: np.ndarray, cuts: int = 1, full: frozenset[tuple[int, ...]] = frozenset(), path: tuple[int, ...] = (), free: list[int] | None = None) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """The shards of each fingerprint, as (path, positions in x).

    All are cut ``cuts`` times, full ones further, three times at most.
    """
    free = list(range(64)) if free is None else free
    for k, value, left in _bands(x, free, RADIUS + 1):
        order = np.argsort(value, kind="stable")
        edge = np.flatnonzero(np.diff(value[order])) + 1
        for own in np.split(order, edge) if len(order) else []:
            here = (*path, k, int(value[own[0]]))
            done = len(here) // 2
            if done < 3 and (done < cuts or here in full):
                for p, at in shards(x[own], cuts, full, here, left):
                    yield p, own[at]
            else:
                yield here, own


def parts(x: np.ndarray, path: tuple[int, ...], most: int) -> Iterator[np.ndarray]:
    """A shard's distinct fingerprints, cut on by the bits outside its bands until no part has more than ``most``.

    Parts overlap, and any two within the radius share one. Equal in all bits is the same fingerprint,
    so cutting ends.
    """
    free = list(range(64))
    for k in path[::2]:
        size = len(free) // (RADIUS + 1)
        run = free[k * size : (k + 1) * size if k < RADIUS else len(free)]
        free = [b for b in free if b not in run]
    todo = [(x, free)]
    while todo:
        own, left = todo.pop()
        if len(own) <= most or len(left) <= RADIUS:
            yield own
            continue
        for _, value, rest in _bands(own, left, RADIUS + 1):
            order = np.argsort(value, kind="stable")
            edge = np.flatnonzero(np.diff(value[order])) + 1
            todo += [(own[at], rest) for at in np.split(order, edge) if len(at) > 1]


def _key(path: tuple[int, ...]) -> str:
    return ".".join(map(str, path))


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``(fp)``, enough to connect them."""
    spark = distinct.sparkSession

    def deal(full: frozenset[tuple[int, ...]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(full)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                keys, at = [], []
                for path, own in shards(x, cuts, sent.value):
                    keys += [_key(path)] * len(own)
                    at.append(own)
                at = pa.array(np.concatenate(at) if at else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column("fp").take(at)], names=["shard", "fp"])

        return map_batches(distinct, scan, "shard string, fp long")

    n = distinct.count()
    cuts = 1 if n <= EVEN << 16 else 2  # so that a shard of evenly spread fingerprints stays small
    limit = max(FULL, 16 * n // MOST_FULL)  # a fingerprint is in 16 shards at most as long as shards are counted
    full: frozenset[tuple[int, ...]] = frozenset()
    for _ in range(cuts, 3):
        more = deal(full).groupBy("shard").count().where(F.col("count") > limit).select("shard").collect()
        new = full | {tuple(map(int, r["shard"].split("."))) for r in more}
        if new == full:
            break
        full = new

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: str, members: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(members)
            path = tuple(map(int, shard.split(".")))
            for own in parts(x, path, most):
                found = forest(own.tolist())
                if found:
                    ends = own[np.array(found)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

        now, members = None, []
        for b in batches:
            fp, shard = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), b.column("shard").to_pylist()
            edge = [0, *(k for k in range(1, len(shard)) if shard[k] != shard[k - 1]), len(shard)]
            for x, y in zip(edge, edge[1:]):
                if x == y:
                    continue
                if shard[x] != now:
                    if members:
                        yield from out(now, members)
                    now, members = shard[x], []
                members.append(fp[x:y].copy())
        if members:
            yield from out(now, members)

    most = FULL
    dealt = deal(full).repartition(partitions(spark), "shard").sortWithinPartitions("shard", "fp")
    return map_batches(dealt, solve, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    With a ``width``, documents also link whose sets of shingles of so many words have a Jaccard
    similarity of ``threshold`` or more. Without, no text is shuffled.
    """
    prints = cut(with_fingerprint(docs, id_col, text_col, width))
    # Vertices are the fingerprints themselves, so those that only null ids have link as well.
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least")), small=True)
    found = links(distinct.select("fp"))
    if width is not None:
        found = overlap.links(docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text")), prints, cut(found, small=True), width, threshold)
    found = components(found)
    placed = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = cut(placed, small=True)
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "component").select(F.col("fp").alias("own"), "component_id")
    return prints.join(named, prints["fp"] == named["own"], "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, threshold: float = 0.8) -> DataFrame:
    """All columns of one document per group, that with the smallest id.

    Of rows that share the id, too, one stays. Rows with a null id can't be told apart and stay.
    """
    found = groups(docs, id_col, text_col, width, threshold)
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("copies"))
    kept = cut(kept, small=True)
    (name,) = fresh(docs, "kept")
    once = kept.select(F.col("doc_id").alias(name))
    out = docs.join(once, quoted(id_col) == quoted(name), "left_semi")
    if not kept.where("copies > 1").isEmpty():
        out = out.dropDuplicates([id_col])
    return out.unionAll(docs.where(quoted(id_col).isNull()))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
