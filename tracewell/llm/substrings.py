"""Substring dedup: windows of words that occur more than once, by super-k-mers.

Words are runs of anything but space and the controls from tab to carriage return, unchanged. A
window is ``WINDOW`` consecutive words of one text. A window's minimiser is its run of ``MINIMISER``
words with the least hash, the leftmost of equals; consecutive windows that share that run travel
together as one packed string of words (a super-k-mer) to the bucket of the minimiser's hash. Equal
windows have equal minimisers, so they meet in one bucket, where sorting finds the windows that
occur more than once; what a hash calls equal is compared word by word.

Map tasks combine before the shuffle: a packed string that occurs twice in a task's chunk marks its
own occurrences there and then, and is sent once, marked as known to repeat. So a passage of a third
of all texts is sent once per chunk. Strings of a chunk are compressed per bucket. A task holds one
bucket, compressed; a bucket of more than ``PART_BYTES`` is unpacked and sorted in parts by further
bits of the minimiser's hash, so that only the strings of one minimiser must fit in memory.

The texts themselves are shuffled once, by (id, hash of text), to meet the ranges of words to
remove; texts under one id with equal hashes are equal for all purposes here.

Cases: a null text has no words; a text of fewer words than a window loses nothing; very long texts
are taken whole, ``MOST_WINDOWS`` windows at a time; repeated rows repeat each other's windows, and
each gets its own result row; windows are judged on the input; of equally small minimisers the
leftmost counts; an empty table gives no rows; other columns are passed on as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import fresh, map_batches, partitions, quoted, table
from tracewell.llm.words import SPACE, Words, cover, mix, rolling, slices, sliding_min

WINDOW, MINIMISER = 35, 8
#: Buckets per shuffle partition at least; bytes of the input's files for each, unless there are more than so many.
BUCKETS, BUCKET_BYTES, MOST_BUCKETS = 8, 8 << 20, 1 << 20
#: Bytes of packed strings that are unpacked together: a larger bucket is taken part by part.
PART_BYTES = 24 << 20
#: Windows whose minimisers are looked for together, 2**24 less a window at most.
MOST_WINDOWS = 1 << 23
#: Of the compression of packed strings.
LEVEL = 5
#: Bytes of text handled at once, and those whose packed strings are combined before they are sent.
_CHUNK, _FLUSH = 2 << 20, 16 << 20
_ROW = np.dtype([("id", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("size", "<i4")])
#: The place of a super-k-mer that its map task has marked already.
_KNOWN = -1


def _normal(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where they begin and end in that."""
    keep = ~SPACE[w.data]
    keep[w.end] = True
    data = w.data.copy()
    data[w.end] = 0x20
    length = w.end - w.start
    begin = np.cumsum(length + 1) - (length + 1)
    return data[keep].tobytes(), begin, begin + length


def super_kmers(w: Words, window: int = WINDOW, minimiser: int = MINIMISER, most: int = MOST_WINDOWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share a minimiser: (first window, past the last, its hash).

    Windows are named by their first word; none crosses from one text into the next. ``most`` windows
    are looked at together, so that a place among them fits in 24 bits; a run that goes on behind them
    is two runs of the same minimiser.
    """
    n = len(w.start)
    none = np.zeros(0, np.int64)
    firsts, pasts, keys = [none], [none], [none.view(np.uint64)]
    if n < window:
        return none, none, keys[0]
    h = rolling(w.hashes(), minimiser)
    for base in range(0, n - window + 1, most):
        count = min(most, n - window + 1 - base)
        part = h[base : base + count + window - minimiser]
        # 40 bits of hash, then the place: the least is the leftmost of the least.
        least = sliding_min((part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64), window - minimiser + 1)
        doc = w.doc[base : base + count]
        inside = doc == w.doc[base + window - 1 : base + count + window - 1]
        # Texts shorter than a window leave no window between them, but two long texts may touch.
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])))
        first = np.flatnonzero(new)
        past = np.concatenate((first[1:], [count]))
        good = inside[first]
        firsts.append(first[good] + base)
        pasts.append(past[good] + base)
        keys.append(least[first[good]] >> np.uint64(24))
    return np.concatenate(firsts), np.concatenate(pasts), np.concatenate(keys)


def _packed(rows: np.ndarray, strings: list[bytes]) -> bytes:
    body = b"\n".join(strings)
    return zstandard.ZstdCompressor(level=LEVEL).compress(len(rows).to_bytes(4, "little") + b"".join(rows[f].tobytes() for f in _ROW.names) + body)


def _unpacked(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int.from_bytes(raw[:4], "little"), 4
    rows = np.zeros(n, _ROW)
    for f in _ROW.names:
        kind = _ROW[f]
        rows[f] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return rows, raw[at:].split(b"\n")


class _Sender:
    """Gathers super-k-mers of a map task, combines equal ones, and packs them by bucket.

    They overlap, so they are kept as places in their texts, and cut out bucket by bucket.
    """

    def __init__(self, buckets: int, window: int):
        self.buckets, self.window = buckets, window
        self.clear()

    def clear(self) -> None:
        self.raws: list[bytes] = []
        self.places: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes], ids: np.ndarray, tags: np.ndarray) -> None:
        w = Words(texts)
        first, past, key = super_kmers(w, self.window)
        if len(first):
            raw, begin, end = _normal(w)
            self.places.append(np.stack((np.full(len(first), len(self.raws)), begin[first], end[past + self.window - 2])))
            self.raws.append(raw)
            rows = np.zeros(len(first), _ROW)
            doc = w.doc[first]
            rows["id"], rows["tag"], rows["start"], rows["size"] = ids[doc], tags[doc], first - w.first[doc], past - first
            self.keys.append(key)
            self.rows.append(rows)
        self.size += len(w.raw)

    def flush(self) -> Iterator[tuple[int, bytes, np.ndarray]]:
        """Each bucket with its packed strings, and the (id, tag, start, size) known to repeat."""
        if not self.raws:
            self.clear()
            return
        raws, places, keys, rows = self.raws, np.concatenate(self.places, axis=1), np.concatenate(self.keys), np.concatenate(self.rows)
        self.clear()
        bucket = (mix(keys) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((keys, bucket))
        edge = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, edge):
            # Equal strings share a minimiser, so they are in one bucket.
            strings = [raws[k][a:b] for k, a, b in places[:, part].T.tolist()]
            place: dict[bytes, int] = {}
            own = np.fromiter((place.setdefault(s, k) for k, s in enumerate(strings)), np.int64, len(strings))
            times = np.bincount(own, minlength=len(own))
            sent = np.flatnonzero(times)
            again, kept = rows[part[times[own] > 1]], rows[part[sent]]
            kept["start"][times[sent] > 1] = _KNOWN
            yield int(bucket[part[0]]), _packed(kept, [strings[k] for k in sent.tolist()]), again


def _spans(rows: np.ndarray, window: int) -> pa.RecordBatch:
    """Ranges of words to remove, for super-k-mers all of whose windows repeat."""
    return _ranges(rows["id"], rows["tag"], rows["start"], rows["start"] + rows["size"] + window - 1)


def _ranges(ids, tags, starts, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], names=["id", "tag", "a", "b"])


def _repeated(rows: np.ndarray, strings: list[bytes], window: int) -> Iterator[pa.RecordBatch]:
    """Ranges of words to remove, of one bucket's super-k-mers."""
    place: dict[bytes, int] = {}
    own = np.fromiter((place.setdefault(s, k) for k, s in enumerate(strings)), np.int64, len(strings))
    known = rows["start"] == _KNOWN
    whole = (np.bincount(own, minlength=len(own)) > 1) | (np.bincount(own, weights=known, minlength=len(own)) > 0)
    settled = whole[own] & ~known
    if settled.any():
        yield _spans(rows[settled], window)
    # Windows of the distinct strings, among each other.
    kept = np.flatnonzero(own == np.arange(len(own)))
    w = Words([strings[k] for k in kept])
    if len(w.start) < window:
        return
    h = rolling(w.hashes(), window)
    at = np.flatnonzero(w.doc[: len(h)] == w.doc[window - 1 :])
    h = h[at]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    repeats = np.zeros(len(at), bool)
    if same.any():
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist()):
            run = order[x : y + 1].tolist()
            texts = [w.text(at[k], at[k] + window) for k in run]
            if texts.count(texts[0]) == len(run):
                repeats[run] = True
            else:  # unequal windows under one hash
                count: dict[bytes, int] = {}
                for t in texts:
                    count[t] = count.get(t, 0) + 1
                repeats[[k for k, t in zip(run, texts) if count[t] > 1]] = True
    doc = w.doc[at]
    open_ = repeats & ~(whole | known)[kept][doc]
    if open_.any():
        # Runs of consecutive repeated windows within one string.
        go = open_.view(np.int8)
        cutting = np.concatenate(([True], (doc[1:] != doc[:-1]) | (go[1:] != go[:-1])))
        begin = np.flatnonzero(cutting)
        past = np.concatenate((begin[1:], [len(go)]))
        begin, past = begin[open_[begin]], past[open_[begin]]
        r = rows[kept[doc[begin]]]
        a = r["start"] + at[begin] - w.first[doc[begin]]
        yield _ranges(r["id"], r["tag"], a, a + (past - begin) + window - 1)


def _input_bytes(docs: DataFrame) -> int:
    """What the planner knows of the size of the input's files; 0 for what it knows nothing of."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def _parts(blobs: list[bytes], sizes: list[int], window: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """A bucket's super-k-mers, in parts of about ``PART_BYTES`` by other bits of their minimisers' hashes.

    The bucket is held as it came, compressed, and unpacked blob by blob for each part.
    """
    n = -(-sum(sizes) // PART_BYTES)
    parts = []
    for blob in blobs if n > 1 else []:
        w = Words(_unpacked(blob)[1])
        first, _, key = super_kmers(w, window)
        # Each string is one super-k-mer; of one that is several, all share the hash.
        parts.append((mix(key[np.searchsorted(first, w.first[:-1])] ^ np.uint64(1)) % np.uint64(n)).astype(np.int32))
    for part in range(max(n, 1)):
        rows, strings = [], []
        for k, blob in enumerate(blobs):
            if n > 1 and not (parts[k] == part).any():
                continue
            r, s = _unpacked(blob)
            if n > 1:
                at = np.flatnonzero(parts[k] == part)
                r, s = r[at], [s[j] for j in at.tolist()]
            rows.append(r)
            strings += s
        if strings:
            yield np.concatenate(rows), strings


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, tag, spans): the word ranges [a, b) of each text that repeated windows cover.

    ``tag`` is the XXH64 of the text. Texts without such a range have no row.
    """
    spark = docs.sparkSession
    width = partitions(spark)
    buckets = max(width * BUCKETS, min(_input_bytes(docs) // BUCKET_BYTES, MOST_BUCKETS))
    schema = "bucket int, blob binary, id long, tag long, a int, b int"

    def sent(bucket, blob) -> pa.RecordBatch:
        none = [pa.nulls(len(bucket), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(blob, pa.binary()), *none], names=["bucket", "blob", "id", "tag", "a", "b"])

    def passed(spans: pa.RecordBatch) -> pa.RecordBatch:
        away = (mix(spans.column("id").to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(away), pa.nulls(len(away), pa.binary()), *spans.columns], names=["bucket", "blob", "id", "tag", "a", "b"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, window)

        def flush():
            packed, again = [], [np.zeros(0, _ROW)]
            for bucket, blob, known in sender.flush():
                packed.append((bucket, blob))
                again.append(known)
                if len(packed) == 64:
                    yield sent(*zip(*packed))
                    packed = []
            if packed:
                yield sent(*zip(*packed))
            again = np.concatenate(again)
            if len(again):
                yield passed(_spans(again, window))

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            for a, b in slices(texts, _CHUNK):
                sender.add(texts[a:b], ids[a:b], tags[a:b])
                if sender.size >= _FLUSH:
                    yield from flush()
        yield from flush()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, sizes = None, [], []

        def out():
            for rows, strings in _parts(blobs, sizes, window):
                yield from _repeated(rows, strings, window)

        for batch in batches:
            done = batch.filter(batch.column("id").is_valid())
            if len(done):
                yield done.select(["id", "tag", "a", "b"])
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if blob is None:
                    continue
                if bucket != now:
                    yield from out()
                    now, blobs, sizes = bucket, [], []
                blobs.append(blob)
                sizes.append(zstandard.frame_content_size(blob))
        yield from out()

    source = docs.select(F.coalesce(quoted(id_col), F.lit(0)).alias("id"), F.xxhash64(quoted(text_col)).alias("tag"), quoted(text_col).alias("text"))
    packed = map_batches(source, send, schema).repartition(width, "bucket").sortWithinPartitions("bucket")
    spans = map_batches(packed, solve, "id long, tag long, a int, b int")
    return spans.groupBy("id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """All columns of ``docs``, and after them the beginnings and the ends of the ranges."""
    own, text, there, tag, spans = fresh(docs, "own", "text_hash", "id_found", "tag_found", "spans_found")
    found = repeated_spans(docs, id_col, text_col, window).toDF(there, tag, spans)
    here = docs.withColumns({own: F.coalesce(quoted(id_col), F.lit(0)), text: F.xxhash64(quoted(text_col))})
    joined = here.join(found, (quoted(own) == quoted(there)) & (quoted(text) == quoted(tag)), "left")
    return joined.select(*map(quoted, docs.columns), quoted(spans)["a"].alias(own), quoted(spans)["b"].alias(text))


def _left(batch: pa.RecordBatch, k: int, a: int, b: int) -> Iterator[tuple[int, bytes | None, Words, np.ndarray]]:
    """Per text: its place in the batch, the bytes, the batch's words, which of its own go."""
    texts = batch.column(k).cast(pa.large_binary()).to_pylist()
    froms, tos = batch.column(a).to_pylist(), batch.column(b).to_pylist()
    for x, y in slices([t or b"" for t in texts], _CHUNK):
        w = Words([t or b"" for t in texts[x:y]])
        for d in range(y - x):
            n = int(w.first[d + 1] - w.first[d])
            gone = cover(n, np.array(froms[x + d], np.int64), np.array(tos[x + d], np.int64)) if froms[x + d] else np.zeros(n, bool)
            yield x + d, texts[x + d], (w, w.first[d], w.first[d + 1]), gone


def _kept(where: tuple[Words, int, int], gone: np.ndarray) -> list[bytes]:
    w, a, b = where
    return [w.raw[x:y] for x, y, g in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), gone.tolist()) if not g]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``, the repeated windows' words removed from their texts.

    A text that loses words keeps the white space between those that stay next to each other, and
    one line feed where words were taken out; other texts stay as they are.
    """
    names = docs.columns
    at = names.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for _, text, (w, a, b), gone in _left(batch, at, len(names), len(names) + 1):
                if not gone.any():
                    new.append(text)
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], (~gone).view(np.int8), [0])))) + a
                new.append(b"\n".join(w.text(x, y) for x, y in zip(edge[0::2], edge[1::2])))
            rows = batch.select(list(range(len(names))))
            kind = rows.schema.field(at)
            yield rows.set_column(at, kind, pa.array(new, pa.large_binary()).cast(pa.large_string()).cast(kind.type))

    return map_batches(_with_spans(docs, id_col, text_col, window), clean, docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for _, _, where, gone in _left(batch, 1, 2, 3):
                n.append(len(gone))
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(_kept(where, gone))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_batches(_with_spans(rows, "doc_id", "text", window), digest, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d),
g AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS g FROM p),
again AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + 35)) AS q FROM g JOIN again USING (g))),
gones AS (SELECT r, count(*) AS n, list(q) AS qs FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY q) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gones USING (r) LEFT JOIN kept USING (r)
"""
