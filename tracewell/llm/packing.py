"""Packing texts into training sequences: shortest-pack-first over the length histogram.

A text is its tokens and an end id. Whole sequences are cut from its front, and the rest is one
piece. The histogram of piece lengths (at most one entry per length, whatever the corpus) goes to
the driver. There lengths are placed longest first: the pieces of a length go onto the shortest
packs if they fit there, else into new packs; packs with equal contents are one pattern with a
count. Each placement is a row: pieces of this length with ranks from here to there go to packs
from here on, at this offset. Pieces are ranked within their length by salted windows, and the
placements are looked up by (length, rank).

Token ids are written to the shared folder once and joined with the ranks by row number, so no
text is tokenised twice.

Cases: null and empty texts are one end id; a text longer than a sequence is cut at multiples of
its length; repeated rows are packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import cut, map_batches, table

LENGTH, END = 2048, 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces of a length that are ranked in one group, about.
GROUP = 2_000
#: Words whose ids a worker keeps.
REMEMBERED = 300_000

_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, word by word.

    Such a tokenizer treats what stands between white space independently, so the ids of common
    words are remembered. Ids are two bytes each, little-endian.

    Words of plain lower-case letters are one piece for the tokenizer, and their merges are made by
    a faster library from the same vocabulary: the last letter's symbol, which carries the end of
    the word, gets a byte value of its own that no such word holds otherwise.
    """

    _PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # a-z, and ß to ÿ

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids beyond two bytes")
        self.known: dict[bytes, bytes] = {}
        self.last, self.merge = self._merges()

    def _merges(self):
        # Byte-level models name bytes by characters: visible ones by themselves, others from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {chr(x): x for x in visible}
        names |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
        used = [*range(ord("a"), ord("z") + 1), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]
        last = dict(zip(used, (x for x in range(256) if x not in used)))
        ranks = {}
        for token, rank in self.tokenizer.get_vocab().items():
            stem = token.removesuffix("</w>")
            value = [names.get(c) for c in stem]
            if value and all(x in last for x in value):
                if stem != token:
                    value[-1] = last[value[-1]]
                ranks[bytes(value)] = rank
        for x in range(256):
            ranks.setdefault(bytes([x]), (1 << 16) + x)  # never in a plain word
        merges = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        return bytes(last.get(x, x) for x in range(256)), merges._encode_single_piece

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of many words."""
        out, rest = {}, []
        plain, last, merge = self._PLAIN.fullmatch, self.last, self.merge
        for w in words:
            if plain(w):
                ids = merge(w[:-1] + w[-1:].translate(last))
                out[w] = pack_ids(f"<{len(ids)}H", *ids)
            else:
                rest.append(w)
        if rest:  # in one call
            texts = [w.decode() for w in rest]
            begin = np.cumsum([0] + [len(t) + 1 for t in texts])
            e = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            at = np.searchsorted(begin, np.array([o[0] for o in e.offsets], np.int64), side="right") - 1
            edge = (2 * np.searchsorted(at, np.arange(len(rest) + 1))).tolist()
            raw = np.array(e.ids, "<u2").tobytes()
            out |= {w: raw[a:b] for w, a, b in zip(rest, edge, edge[1:])}
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known, made, missing = self.known, [], set()
        for t in texts:
            raw = (t or "").encode()
            # Lower case is the tokenizer's own first step; a special token's name is matched before it.
            words = (raw if b"<|" in raw else raw.lower()).split()
            ids = list(map(known.get, words))
            gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else []
            missed = [words[k] for k in gaps]
            missing.update(missed)
            made.append((ids, gaps, missed))
        if missing:
            # A single mark after a letter is a token of its own.
            marked = [w for w in missing if len(w) > 1 and w[-1] in b",.;:!?" and 97 <= w[-2] <= 122]
            stems = {w[:-1] for w in marked} | {w[-1:] for w in marked}
            found = self._encode([w for w in missing.difference(marked) | stems if w not in known])
            for w in marked:
                stem, mark = w[:-1], w[-1:]
                found[w] = (known.get(stem) or found[stem]) + (known.get(mark) or found[mark])
            for ids, gaps, missed in made:
                for k, w in zip(gaps, missed):
                    ids[k] = found[w]
            known.update(islice(found.items(), max(0, REMEMBERED - len(known))))
        end = END.to_bytes(2, "little")
        return [b"".join(ids) + end for ids, _, _ in made]


def spfhp(histogram: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Place pieces by shortest-pack-first. Returns placements and the number of packs.

    A placement (l, a, b, pack, offset): the pieces of length l with ranks a to b-1 go to the packs
    from ``pack`` on, one each, at ``offset``.
    """
    out, packs = [], 0
    heap: list[tuple[int, int, int]] = []  # (tokens in it, first pack, packs): a pattern and its count
    for l in sorted(histogram, reverse=True):
        rank, left = 0, histogram[l]
        while left:
            if heap and heap[0][0] + l <= length:
                fill, pack, count = heapq.heappop(heap)
                n = min(left, count)
                if count > n:
                    heapq.heappush(heap, (fill, pack + n, count - n))
            else:
                fill, pack, n = 0, packs, left
                packs += n
            out.append((l, rank, rank + n, pack, fill))
            heapq.heappush(heap, (fill + l, pack, n))
            rank, left = rank + n, left - n
    return out, packs


def tokens(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(doc_id, n, ids): each row's ids, two bytes each, the end id included."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for b in batches:
            for k in range(0, len(b), 512):
                ids = encoder.encode(b.column("text")[k : k + 512].to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[k : k + 512], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n", "ids"])

    return map_batches(rows, encode, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's ids, two bytes each; with ``digest``, ``ids_crc32`` takes its place,
    over the ids as little-endian unsigned 32-bit numbers. Sequences of several pieces come first,
    then those that one text fills.
    """
    spark = docs.sparkSession
    own = cut(tokens(docs, id_col, text_col, path or public_tokenizers.path(TOKENIZER))).withColumn("row", F.monotonically_increasing_id())
    sizes = own.select("row", (F.col("n") % length).cast("int").alias("l"), F.floor(F.col("n") / length).alias("q"))
    most = sizes.groupBy("l").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // GROUP))
    sizes = sizes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counts = sizes.groupBy("l", "salt").agg(F.count("*").alias("n"), F.sum("q").alias("q"))
    histogram = {r["l"]: (r["n"], r["q"]) for r in counts.groupBy("l").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).collect()}  # at most one row per length
    placed, packs = spfhp({l: n for l, (n, _) in histogram.items() if l}, length)
    whole, at = {}, packs
    for l in sorted(histogram):
        whole[l], at = at, at + histogram[l][1]

    before = Window.partitionBy("l").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("l", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("q").over(before), F.lit(0)).alias("q0"))
    order = Window.partitionBy("l", "salt").orderBy("row")
    ranks = (
        sizes.select("*", (F.row_number().over(order) - 1).alias("k"), F.coalesce(F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("qk"))
        .join(bases, ["l", "salt"])
        .select("row", "l", (F.col("k") + F.col("n0")).alias("rank"), (F.col("qk") + F.col("q0")).alias("whole"))
    )
    slots: dict[int, np.ndarray] = {}
    for l in {p[0] for p in placed}:
        slots[l] = np.array(sorted(p[1:] for p in placed if p[0] == l), np.int64)
    sent = spark.sparkContext.broadcast((slots, whole))

    def content(ids: bytes) -> bytes | int:
        return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()) if digest else ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, whole = sent.value
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "n", "ids", "l", "rank", "whole")]
            for doc, n, ids, l, rank, nth in zip(*cols):
                for k in range(n // length):
                    out.append((doc, k * length, length, content(ids[2 * k * length : 2 * (k + 1) * length]), n, whole[l] + nth + k, 0))
                if l:
                    s = slots[l]
                    a, _, first, offset = s[np.searchsorted(s[:, 0], rank, side="right") - 1].tolist()
                    out.append((doc, n - l, l, content(ids[2 * (n - l) :]), n, first + rank - a, offset))
            names = ("doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset")
            kinds = (b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(names))

    kind, what = dict(own.dtypes)["doc_id"], "ids_crc32 long" if digest else "ids binary"
    return map_batches(own.join(ranks, "row").select("doc_id", "n", "ids", "l", "rank", "whole"), cut_up, f"doc_id {kind}, start long, length long, {what}, doc_tokens long, sequence_id long, offset long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), digest=True)
