"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits and of all other code points from U+0080 on, A-Z in
lower case. A window is ``width`` consecutive words of an item; an item with fewer words, but not
none, is one window of its own. The windows of the benchmark go into hash sets that are broadcast;
training texts are scanned once, their windows looked up by a rolling hash, and each hit verified
word by word. No training text is shuffled.

The set that a scan broadcasts is bounded: the benchmark's windows are counted first and dealt to
as many slices as keep each below ``most_windows``. With more than one slice, the hits of the
slices are brought together per text afterwards. The result does not depend on the slicing.

Cases: null and empty texts have no words, so nothing is hit; items without words are ignored; an
item with a null id hits words, but is neither counted nor listed; items that repeat count as often
as their ids differ; each row of documents, repeated or not, gets its own result row; very long texts
are scanned whole; an empty benchmark hits nothing; empty documents give no rows; other columns stay
where texts are cut or dropped, and are left out of reports.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import cut, fresh, map_batches, quoted, table
from tracewell.llm.words import cover, rolling, slices

WIDTH = 10
MOST_WINDOWS = 1_000_000

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: Part of a batch that is scanned at once, in bytes.
_CHUNK = 4 << 20


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The windows of a bounded set of items, by word codes."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split(text)]
            n = min(width, len(codes))
            for k in range(len(codes) - n + 1 if n else 0):
                owners = found.setdefault(tuple(codes[k : k + n]), set())
                if item is not None:
                    owners.add(place[item])
        self.by_width = {}
        for n in sorted({len(w) for w in found}):
            rows = np.array([w for w in found if len(w) == n], np.int64)
            owners = [sorted(found[w]) for w in found if len(w) == n]
            keys = self.keys(rows.ravel(), n)[::n]
            order = np.argsort(keys, kind="stable")
            self.by_width[n] = (keys[order], rows[order], [owners[k] for k in order])

    @staticmethod
    def keys(codes: np.ndarray, n: int) -> np.ndarray:
        return rolling(codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), n)

    def scan(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[int]]]:
        """Per text: the number of words, which of them are hit, the places of the items found."""
        words = [split(t) for t in texts]
        first = np.cumsum([0] + [len(w) for w in words])
        get = self.vocabulary.get
        codes = np.fromiter((c for w in words for c in map(get, w, repeat(0))), np.int64, first[-1])
        known = np.concatenate(([0], np.cumsum(codes > 0)))
        hit = np.zeros(first[-1] + 1, np.int64)
        items: list[set[int]] = [set() for _ in texts]
        for n, (keys, rows, owners) in self.by_width.items():
            if len(codes) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            doc = np.searchsorted(first, at, side="right") - 1
            keep = at + n <= first[doc + 1]
            at, doc = at[keep], doc[keep]
            own = np.zeros(len(at), np.uint64)
            # a window's key depends on its own codes only
            own[:] = self.keys(codes, n)[at]
            left, right = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for j in np.flatnonzero(right > left):
                for k in range(left[j], right[j]):
                    if np.array_equal(rows[k], codes[at[j] : at[j] + n]):
                        hit[at[j]] += 1
                        hit[at[j] + n] -= 1
                        items[doc[j]].update(owners[k])
        covered = np.cumsum(hit[:-1]) > 0
        return [(len(w), covered[first[d] : first[d + 1]], items[d]) for d, w in enumerate(words)]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))


def _parts(benchmark: DataFrame, most_windows: int) -> int:
    """Slices of the benchmark that hold no more than about so many windows each."""
    words = _items(benchmark).agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no fewer than there are
    return max(1, int(-(-words // most_windows)))


def _slices(benchmark: DataFrame, width: int, most_windows: int) -> Iterator[list[tuple[str, str]]]:
    """The items, in parts of a bounded number of windows, one part at a time."""
    n = _parts(benchmark, most_windows)
    for k in range(n):
        mine = _items(benchmark).where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in mine.collect()]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Each text with what of it the benchmark's windows cover.

    Columns: ``doc_id``, ``text``, ``n_words``, ``hit`` (the covered words' half-open ranges, as
    arrays ``from`` and ``to``), ``items`` (ids of the items found, sorted as strings).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id {0}, text string, n_words long, hit struct<`from`: array<int>, `to`: array<int>>, items array<string>".format(dict(rows.dtypes)["doc_id"])
    parts = []
    for part in _slices(benchmark, width, most_windows):
        sent = spark.sparkContext.broadcast(Windows(part, width))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows = sent.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for a, b in slices([t or "" for t in texts], _CHUNK):
                    n, spans, found = [], [], []
                    for count, covered, items in windows.scan(texts[a:b]):
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
                        n.append(count)
                        spans.append({"from": edge[0::2].tolist(), "to": edge[1::2].tolist()})
                        found.append([windows.items[k] for k in sorted(items)])
                    kind = pa.struct([("from", pa.list_(pa.int32())), ("to", pa.list_(pa.int32()))])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id")[a:b], batch.column("text")[a:b], pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))],
                        names=["doc_id", "text", "n_words", "hit", "items"],
                    )

        parts.append(map_batches(rows, scan, schema))
    if len(parts) == 1:
        return parts[0]
    # The same texts under the same id have the same hits: the slices meet per (id, hash of text).
    key = [F.col("doc_id"), F.xxhash64("text").alias("tag")]
    found = None
    for p in parts:
        p = p.where(F.size("hit.from") > 0).select(*key, F.arrays_zip("hit.from", "hit.to").alias("spans"), "items")
        found = p if found is None else found.unionAll(p)
    found = cut(found).groupBy("doc_id", "tag").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"))
    base = parts[0].select("doc_id", "text", "n_words", F.xxhash64("text").alias("tag"))
    joined = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.tag") == F.col("f.tag")), "left")
    none = F.array().cast("array<string>")
    spans = F.coalesce("f.spans", F.expr("cast(array() as array<struct<`from`: int, `to`: int>>)"))
    return joined.select("b.doc_id", "b.text", "b.n_words", F.struct(spans.getField("from").alias("from"), spans.getField("to").alias("to")).alias("hit"), F.coalesce("f.found", none).alias("items"))


def _merged(spans: dict, n: int) -> np.ndarray:
    return cover(n, np.array(spans["from"], np.int64), np.array(spans["to"], np.int64))


def report(found: DataFrame) -> DataFrame:
    """``hits`` as counts and digests: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_words").to_pylist()
            hit = [int(_merged(s, k).sum()) for s, k in zip(b.column("hit").to_pylist(), n)]
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = dict(found.dtypes)["doc_id"]
    return map_batches(found.select("doc_id", "n_words", "hit", "items"), digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, all columns, without those of which a benchmark window covers a word."""
    return strip(docs, benchmark, id_col, text_col, whole=True, **how)


def strip(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, width: int = WIDTH, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Remove what the benchmark's windows cover: the documents (``whole``) or only the spans.

    Spans are cut from a covered run's first byte to its last; what is left keeps its spelling and
    white space. Windows are judged on the texts as given, not on what an earlier cut left.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)

    def without(rows: pa.RecordBatch, covered: list[np.ndarray]) -> pa.RecordBatch:
        if whole:
            return rows.filter(pa.array([not c.any() for c in covered], pa.bool_()))
        texts = [_without(t, c) if c.any() else t for t, c in zip(rows.column(at).to_pylist(), covered)]
        return rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))

    if whole or _parts(benchmark, most_windows) == 1:
        out = docs
        for part in _slices(benchmark, width, most_windows):
            sent = spark.sparkContext.broadcast(Windows(part, width))

            def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    texts = batch.column(at).to_pylist()
                    for a, b in slices([t or "" for t in texts], _CHUNK):
                        yield without(batch.slice(a, b - a), [c for _, c, _ in sent.value.scan(texts[a:b])])

            out = map_batches(out, clean, docs.schema)
        return out
    # Several slices: spans meet per (id, hash of text) first.
    own, tag, hit = fresh(docs, "own", "tag", "hit")
    found = hits(docs, benchmark, id_col, text_col, width, most_windows).where(F.exists("hit.from", lambda x: x.isNotNull()))
    found = found.select("doc_id", F.xxhash64("text"), "hit").toDF(own, tag, hit).dropDuplicates([own, tag])
    joined = docs.join(found, quoted(id_col).eqNullSafe(quoted(own)) & (F.xxhash64(quoted(text_col)) == quoted(tag)), "left")

    def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            covered = [_merged(h, len(split(t))) if h else np.zeros(0, bool) for t, h in zip(texts, spans)]
            yield without(batch.select(list(range(batch.num_columns - 1))), covered)

    return map_batches(joined.select(*map(quoted, docs.columns), quoted(hit)), cut_spans, docs.schema)


def _without(text: str, covered: np.ndarray) -> str:
    raw = text.encode()
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([0], folded.view(np.int8), [0]))))
    start, end = edge[0::2], edge[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(runs[0::2], runs[1::2]):
        out.append(raw[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, raw[at:]]).decode(errors="replace")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bn AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM bn),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM bp),
ns AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns),
dg AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
m AS (SELECT r, n, p, item_id FROM dg JOIN iw USING (n, g)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
