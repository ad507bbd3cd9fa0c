"""Vector code compression: product codes over integers, by segment-mean lower bounds.

A vector's components become integers, floor(SCALE * x), and the vector is cut into ``PARTS`` equal
parts. Each part position has a codebook, at first the parts of the vectors with the smallest ids.
Rounds assign every part to its nearest entry, ties to the lower index, and move entries to the floor
of their parts' mean; unused entries stay.

The nearest entry is found from coarse to fine. A part of m components that is cut into segments has
distance to an entry of at least the sum over segments of length times squared difference of means,
plus the squared difference of the norms of what is left when the means are taken out. With one
segment, this bounds all entries at once; the entry with the least bound is measured, and entries whose
bound is above that distance go. Halved segments bound the rest more tightly, again and again; what
survives is measured in exact integers. A slack far above the error of floating point keeps bounds safe.

Each round is one pass over the vectors; tasks return sums and counts of their parts per entry, which
Spark adds up; codebooks, of ``PARTS * ENTRIES`` entries, are what the driver holds and sends. Sums are
added in limbs, so nothing overflows.

Cases: a vector that is null or holds null or non-finite components is dropped; shorter vectors than
the longest, and a length that ``PARTS`` doesn't divide, are filled with zeros at the end, so an empty
vector is all zeros; with fewer vectors than ``ENTRIES`` a codebook has as many entries as there are
vectors; rows with equal ids are vectors of their own, and the first codebook takes equal ids in the
order of their components, null ids after all others; components too large for 64-bit distances are
compared in Python's integers, and an error beyond 64 bits is null; an empty table gives no rows; other
columns are left out. Errors of a label are summed before a shuffle, and looked up by broadcast if
labels are few, which is counted, else for hot labels alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import cut, look_up, map_batches, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bits of a limb of a sum; vectors of a batch that are coded at once.
LIMB, ROWS = 40, 4096
_SLACK = 1e-9
_MOST = (1 << 63) - 1


def small_below(width: int) -> int:
    """Integers below this have sums of squares, times a part's width, within 62 bits."""
    return (1 << 30) // max(width, 1)


def as_integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """(n, PARTS, width) integers; which rows are small; the others' integers by row, zeros in the array."""
    n, flat = len(vectors), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.asarray(vectors.value_lengths(), np.int64)
    # Multiplying by a power of two is exact.
    scaled = np.zeros((n, PARTS * width))
    row = np.repeat(np.arange(n), length)
    with np.errstate(over="ignore"):
        scaled[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = np.floor(flat * SCALE)
    small = (np.abs(scaled) < small_below(width)).all(1)
    scaled[~small] = 0
    large = {}
    for r in np.flatnonzero(~small).tolist():
        x = vectors[r].as_py()
        large[r] = [int(np.floor(v * SCALE)) if abs(v) < 2**40 else int(v) * SCALE for v in x] + [0] * (PARTS * width - len(x))
    return scaled.astype(np.int64).reshape(n, PARTS, width), small, large


def _segments(width: int) -> list[np.ndarray]:
    """Starts of the segments of each level: one, then halves, down to two components."""
    out, starts = [], np.array([0])
    while True:
        out.append(starts)
        ends = np.append(starts[1:], width)
        if (ends - starts).max(initial=0) <= 2:
            return out
        starts = np.unique(np.concatenate([starts, (starts + ends) // 2]))


def _outline(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of segments, times the root of their length; the norm of what is left without them."""
    length = np.diff(np.append(starts, x.shape[1]))
    sums = np.add.reduceat(x, starts, axis=1)
    rest = np.sqrt(np.maximum((x * x).sum(1) - (sums * sums / length).sum(1), 0.0))
    return sums / np.sqrt(length), rest


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, and its squared distance; ties to the lower index."""
    n, k = len(x), len(entries)
    if not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    norm = (x.astype(np.float64) ** 2).sum(1)[:, None] + (entries.astype(np.float64) ** 2).sum(1)[None, :]
    row = at = best = None
    for starts in _segments(x.shape[1]):
        (xm, xr), (em, er) = _outline(x, starts), _outline(entries, starts)
        if row is None:
            bound = (xr[:, None] - er[None, :]) ** 2
            for s in range(xm.shape[1]):
                bound += (xm[:, s, None] - em[None, :, s]) ** 2
            best = ((x - entries[bound.argmin(1)]) ** 2).sum(1)
            row, at = np.nonzero(bound - _SLACK * norm <= best[:, None])
        else:
            bound = ((xm[row] - em[at]) ** 2).sum(1) + (xr[row] - er[at]) ** 2
            stay = bound - _SLACK * norm[row, at] <= best[row]
            row, at = row[stay], at[stay]
    distance = np.full((n, k), _MOST)
    distance[row, at] = ((x[row] - entries[at]) ** 2).sum(1)
    code = distance.argmin(1)
    return code, distance[np.arange(n), code]


def _nearest_large(x: list[int], entries: list[list[int]]) -> tuple[int, int]:
    found = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries]
    return found.index(min(found)), min(found)


class Codebooks:
    """Entries by part, as Python's integers, and as arrays where all of them are small."""

    def __init__(self, entries: list[list[list[int]]], width: int):
        self.entries, self.width = entries, width
        small = all(abs(v) < small_below(width) for part in entries for e in part for v in e)
        self.arrays = [np.array(part, np.int64).reshape(len(part), width) for part in entries] if small else None

    def assign(self, vectors: pa.Array):
        """(codes (n, PARTS), errors per row, small integers, which rows are, the others) of a batch."""
        x, small, large = as_integers(vectors, self.width)
        codes, errors = np.zeros((len(x), PARTS), np.int64), np.zeros(len(x), object)
        if self.arrays is None:
            large |= {r: x[r].reshape(-1).tolist() for r in np.flatnonzero(small).tolist()}
            small = np.zeros(len(x), bool)
        else:
            for p in range(PARTS):
                codes[:, p], d = nearest(x[:, p], self.arrays[p])
                errors += d.astype(object)
        for r, v in large.items():
            found = [_nearest_large(v[p * self.width : (p + 1) * self.width], self.entries[p]) for p in range(PARTS)]
            codes[r], errors[r] = [c for c, _ in found], sum(d for _, d in found)
        return codes, errors, x, small, large

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield k, sign * (value & ((1 << LIMB) - 1))
        value, k = value >> LIMB, k + 1


def _batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for b in batches:
        for k in range(0, len(b), ROWS):
            part = b.slice(k, ROWS)
            yield part, part.column(name)


def _sums(own: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number of parts and sum of their components by (part, entry), of those that have any."""
    sent, width, k = own.sparkSession.sparkContext.broadcast(books), books.width, len(books.entries[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        total, count = np.zeros((PARTS, k, width), object), np.zeros((PARTS, k), object)
        for _, v in _batches(batches, "embedding"):
            codes, _, x, small, large = books.assign(v)
            for p in range(PARTS):
                sums = np.zeros((k, width), np.int64)  # below 2**43: ROWS small integers
                np.add.at(sums, codes[small, p], x[small, p])
                total[p] += sums.astype(object)
                count[p] += np.bincount(codes[:, p], minlength=k).astype(object)
                for r, values in large.items():
                    total[p, codes[r, p]] += np.array(values[p * width : (p + 1) * width], object)
        rows = [(p, e, -1, 0, int(count[p, e])) for p in range(PARTS) for e in range(k) if count[p, e]]
        rows += [(p, e, i, limb, s) for p, e, *_ in rows for i in range(width) for limb, s in _limbs(int(total[p, e, i]))]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], names=["part", "entry", "at", "limb", "s"])

    made = map_batches(own.select("embedding"), add, "part int, entry int, at int, limb int, s long")
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    # Bounded by the codebooks: a row per limb of a component of an entry.
    for p, e, i, limb, s in sorted(made.groupBy("part", "entry", "at", "limb").agg(F.sum("s")).collect()):
        n, values = out.setdefault((p, e), (0, [0] * width))
        if i < 0:
            out[p, e] = (s, values)
        else:
            values[i] += s << LIMB * limb
    sent.destroy()
    return out


def fit(own: DataFrame, parts_of: int, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after all rounds over ``own (vec_id, embedding)``, of vectors up to ``parts_of`` components."""
    width = -(-parts_of // PARTS)
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(ENTRIES).collect()
    start = pa.array([r[0] for r in first], pa.list_(pa.float64()))
    x, _, large = as_integers(start, width)
    rows = [large.get(r) or x[r].reshape(-1).tolist() for r in range(len(x))]
    books = Codebooks([[v[p * width : (p + 1) * width] for v in rows] for p in range(PARTS)], width)
    for _ in range(rounds):
        found = _sums(own, books)
        moved = lambda p, e, old: [s // found[p, e][0] for s in found[p, e][1]] if (p, e) in found else old
        books = Codebooks([[moved(p, e, old) for e, old in enumerate(part)] for p, part in enumerate(books.entries)], width)
    return books


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each kept row of ``vectors (vec_id, embedding, label)``."""
    v = F.col("embedding")
    if dict(vectors.dtypes)["embedding"] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    own = cut(vectors.select("vec_id", v.alias("embedding"), "label").where(F.forall("embedding", finite)))
    longest = own.agg(F.max(F.size("embedding"))).first()[0]
    books = fit(own, longest, rounds) if longest is not None else None
    kinds = dict(own.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if books is None:  # no vectors
        return own.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    sent = own.sparkSession.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, v in _batches(batches, "embedding"):
            codes, errors, *_ = sent.value.assign(v)
            text = [bytes(c).hex() for c in codes.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array([e if e <= _MOST else None for e in errors.tolist()], pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = cut(map_batches(own, code, schema))
    # One error without a number leaves its label without one.
    whole = F.when(F.count("error") == F.count("*"), F.try_sum("error"))
    labels = cut(coded.groupBy("label").agg(whole.alias("label_error"), F.count("*").alias("n")), small=True)
    return look_up(coded, labels, "label", "n").withColumn("codebooks_sha256", F.lit(books.digest()))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """Round by round, over parts as lists."""
    distance = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    parts = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * x) AS HUGEINT)) AS v, embedding AS raw FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"wd AS (SELECT CAST(ceil(max(len(v)) / {PARTS}.0) AS BIGINT) AS w FROM k)",
        f"kp AS (SELECT r, vec_id, label, raw, list_concat(v, list_transform(range({PARTS} * w - len(v)), lambda i: 0::HUGEINT)) AS v, w FROM k, wd)",
        f"pt AS MATERIALIZED (SELECT r, p, list_slice(v, p * w + 1, (p + 1) * w) AS x FROM kp, (SELECT unnest(range({PARTS})) AS p))",
        f"st AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, raw) - 1 AS j FROM k QUALIFY j < {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT p, j, x AS c FROM pt JOIN st USING (r))",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'j': j}}) AS m FROM (SELECT r, pt.p, j, coalesce({distance}, 0) AS d FROM pt JOIN c{i} USING (p)) GROUP BY r, p)")
        if i < ROUNDS:
            parts += [
                f"s{i} AS (SELECT p, j, i, sum(v) AS s, count(*) AS n FROM (SELECT a.p, a.m.j AS j, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{i} a JOIN pt USING (r, p)) GROUP BY ALL)",
                f"m{i} AS (SELECT p, j, list(CAST(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS HUGEINT) ORDER BY i) AS c FROM s{i} GROUP BY p, j)",
                f"c{i + 1} AS MATERIALIZED (SELECT o.p, o.j, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (p, j))",
            ]
    last = f"a{ROUNDS}"
    parts += [
        f"e AS (SELECT r, string_agg(lpad(printf('%x', CAST(m.j AS BIGINT)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM {last} GROUP BY r)",
        f"dg AS (SELECT sha256(string_agg(t, ',' ORDER BY p, j)) AS d FROM (SELECT p, j, array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), ',') AS t FROM c{ROUNDS}))",
    ]
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM k JOIN e USING (r), dg"


OP13_SQL = _sql()
