"""Phrase collocation mining: candidates from a sketch, counted by automata, scored by their weakest cut.

A text, its A-Z lower-cased, is split into pieces at punctuation and line ends, and pieces into words;
phrases are runs of words within a piece. Texts are dealt out by hash to blocks of about ``BLOCK`` bytes.

1. Each block hashes its words and phrases to the cells of one sketch, whose size follows the corpus (some
   four cells a phrase and word), and sends its counts, cut at the threshold, range of cells by range.
   Per range, counts are added: an upper bound of every phrase in the cell. Cells that reach the threshold
   go back to just those blocks that have them.
2. Each block's candidates, its words and phrases in such cells, are compiled into an automaton per
   language, each with a space on both sides, as the block's text has them; so matches start and end with
   words, and overlap. Blocks scan their texts, matches are counted, and the counts of all blocks added.
   What is at or above the threshold now is exact: a bound never falls short of a count, so no phrase is
   missed. (Two phrases of one block and equal 64-bit hashes would be; for the some two million of a block
   the chance is about one in ten million.)
3. Every cut of a candidate gets its score in decimals of 38 digits; the lowest counts, ties to the
   shortest first part. Candidates that a longer one makes up for most of go, and each language's first
   ``TOP`` stay.

So nothing is broadcast, and what a task holds is a block, or a range of cells. A hot language or phrase
is in all blocks alike, once each after counting.

Cases: a null text is empty; a null language is ``und``; repeated rows count as often as they occur;
texts of any length are taken whole, in slices that end where pieces do; ties of score and count go by
the phrase's bytes; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.covertree import _runs as runs
from tracewell.llm.shared import cut, map_batches, partitions, table
from tracewell.llm.words import Words, mix, rolling

LEAST, TOP, LONGEST, HALF = 10, 2000, 3, 50
#: Bytes of text of a block, and of a slice whose words are hashed at once, about.
BLOCK, SLICE = 8 << 20, 2 << 20
#: Bits of a cell within its range; words and phrases of the corpus for each range, about.
CELL_BITS, RANGE = 24, 1 << 22
LOW = (1 << CELL_BITS) - 1
#: Lower-case, and one mark each for what ends a piece and what ends a word.
_MARKS = bytes(0x0A if x in b".,;:!?\n\x0b\x0c\r" else 0x20 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))


def pieces(text: bytes, most: int = SLICE) -> Iterator[bytes]:
    """The text with marks, in slices of about ``most`` bytes that end where pieces do."""
    text = text.translate(_MARKS)
    at = 0
    while len(text) - at > most:
        end = text.rfind(b"\n", at, at + most) + 1 or text.find(b"\n", at + most) + 1 or len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def slices(texts: Iterator[bytes], most: int = SLICE) -> Iterator[list[bytes]]:
    """Slices of texts, as many together as make up about ``most`` bytes."""
    out, size = [], 0
    for t in texts:
        for s in pieces(t, most):
            out.append(s)
            size += len(s)
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


def runs_of_words(w: Words, lang: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: at which words such a run starts, and its hash."""
    h, salt = w.hashes(), np.uint64(xxhash.xxh64_intdigest(lang))
    ends = np.cumsum(w.data == 10)
    open_ = ends[w.end[:-1] - 1] == ends[w.start[1:]]  # the next word is of the same piece
    out = []
    for k in range(1, LONGEST + 1):
        ok = np.ones(max(0, len(h) - k + 1), bool)
        for j in range(k - 1):
            ok &= open_[j : j + len(ok)]
        out.append((np.flatnonzero(ok), mix(rolling(h, k)[ok] ^ salt)))
    return out


def packed(cells: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending cells of a range, by their steps, and their counts; byte by byte, since high bytes are mostly zero."""
    steps = np.diff(cells, prepend=cells.dtype.type(0)).astype("<u4")
    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.compress(planes + (b"" if counts is None else counts.astype(np.uint8).tobytes()), 1)


def unpacked(data: bytes, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(5 if counted else 4, -1)
    return np.cumsum(raw[:4].T.copy().view("<u4").ravel(), dtype=np.uint64), raw[4:].ravel()


def _sketch(range_bits: int):
    """Batches of (block, lang, text), sorted by block, to (range, block, cells): cells with their counts."""
    shift = np.uint64(64 - CELL_BITS - range_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in runs(batches, ["block"]):
            cells, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            langs, texts = rows.column("lang").to_pylist(), rows.column("text")
            for lang in dict.fromkeys(langs):
                own = (texts[k].as_py() for k, x in enumerate(langs) if x == lang)
                for some in slices(own):
                    for _, h in runs_of_words(Words(some), lang):
                        cell, n = np.unique(h >> shift, return_counts=True)
                        cells.append(cell)
                        counts.append(n)
            cell, where = np.unique(np.concatenate(cells), return_inverse=True)
            n = np.minimum(np.bincount(where, np.concatenate(counts)), LEAST)
            of, low = cell >> np.uint64(CELL_BITS), cell & np.uint64(LOW)
            kinds, first = np.unique(of, return_index=True)
            edge = [*first.tolist(), len(of)]
            data = [packed(low[a:b], n[a:b]) for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array([block] * len(kinds), pa.int64()), pa.array(data, pa.binary())], names=["range", "block", "cells"])

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (range, block, cells), sorted by range: the cells of each block whose sum is ``LEAST`` or more."""
    for (which,), rows in runs(batches, ["range"]):
        parts = [unpacked(x, True) for x in rows.column("cells").to_pylist()]
        _, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        hot = np.bincount(where, np.concatenate([n for _, n in parts])) >= LEAST
        edge = np.cumsum([0] + [len(c) for c, _ in parts])
        stays = [packed(c[hot[where[a:b]]]) for (c, _), a, b in zip(parts, edge, edge[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([which] * len(parts), pa.int64()), rows.column("block").combine_chunks(), pa.array(stays, pa.binary())], names=["range", "block", "cells"])


class Candidates:
    """Texts of one block and language, and their words and phrases that are in frequent cells.

    Words are counted as they are hashed. Of the texts, what the automaton scans is runs of words of which
    each two neighbours are a candidate: no other words are in any.
    """

    def __init__(self, lang: str, frequent: np.ndarray, likely: np.ndarray, shift: np.uint64):
        self.lang, self.frequent, self.likely, self.shift = lang, frequent, likely, shift
        self.texts, self.n_words = [], 0
        self.strings: list[list[str]] = [[] for _ in range(LONGEST)]
        self.known = [np.zeros(0, np.uint64) for _ in range(LONGEST)]
        self.counted = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def add(self, some: list[bytes]) -> None:
        lines = (b" ".join(x.split()) for s in some for x in s.split(b"\n"))
        w = Words([b"\n".join(x for x in lines if x)])
        self.n_words += len(w.start)
        linked = np.zeros(len(w.start) + 1, bool)  # to the word before
        for k, (at, h) in enumerate(runs_of_words(w, self.lang)):
            some_ = self.likely[h >> self.shift & np.uint64(LOW)]
            at, h = at[some_], h[some_]
            h, first, where, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            ok = self._is_frequent(h >> self.shift)
            if k == 0:
                self.counted.append((h[ok], n[ok]))
            if k == 1:
                linked[at[ok[where]] + 1] = True
            new = ok & ~np.isin(h, self.known[k], assume_unique=True)
            begin = at[first[new]]
            self.strings[k] += [w.raw[a:b].decode("latin-1") for a, b in zip(w.start[begin].tolist(), w.end[begin + k].tolist())]
            self.known[k] = np.concatenate([self.known[k], h[new]])
        joins = np.flatnonzero(linked[1:] & ~linked[:-1]), np.flatnonzero(linked[:-1] & ~linked[1:])
        held = [w.raw[a:b] for a, b in zip(w.start[joins[0]].tolist(), w.end[joins[1]].tolist())]
        # Each run with a space on both sides; a byte is a character.
        self.texts.append((b" " + b" \n ".join(held) + b" ").decode("latin-1"))

    def _is_frequent(self, cells: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(cells), bool)
        return self.frequent[np.minimum(np.searchsorted(self.frequent, cells), len(self.frequent) - 1)] == cells

    def count(self) -> pa.RecordBatch:
        """(lang, phrase, n), and the number of words under an empty phrase."""
        order = np.argsort(self.known[0])
        h, n = (np.concatenate(x) for x in zip(*self.counted))
        words = np.bincount(order[np.searchsorted(self.known[0], h, sorter=order)], n, len(order)).astype(np.int64)
        phrases = [p for of in self.strings[1:] for p in of]
        found = np.zeros(len(phrases), np.int64)
        if phrases:
            automaton = ahocorasick.Automaton()
            for k, p in enumerate(phrases):
                automaton.add_word(f" {p} ", k)
            automaton.make_automaton()
            for t in self.texts:
                found += np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(t)), np.int64), minlength=len(found))
        phrase = [b"", *(p.encode("latin-1") for p in self.strings[0] + phrases)]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(phrase), pa.string()), pa.array(phrase, pa.binary()), pa.array(np.concatenate([[self.n_words], words, found]), pa.int64())], names=["lang", "phrase", "n"])


def _scan(range_bits: int):
    """Batches of (block, range, cells) and, after a block's, its (block, lang, text): to (lang, phrase, n)."""
    shift = np.uint64(64 - CELL_BITS - range_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cells, now, some = None, [], None, []
        frequent, likely = np.zeros(0, np.uint64), np.zeros(1 << CELL_BITS, bool)

        def ended():
            if now is not None:
                for part in slices(some):
                    now.add(part)
                yield now.count()

        for b in batches:
            for at, which, part, lang, text in zip(*(b.column(c).to_pylist() for c in ("block", "range", "cells", "lang", "text"))):
                if at != block:
                    yield from ended()
                    block, cells, now, some = at, [], None, []
                if which is not None:
                    cells.append(np.uint64(which << CELL_BITS) + unpacked(part, False)[0])
                    continue
                if now is None:
                    frequent = np.sort(np.concatenate(cells)) if cells else np.zeros(0, np.uint64)
                    likely[:] = False
                    likely[frequent & np.uint64(LOW)] = True
                if now is None or lang != now.lang:
                    yield from ended()
                    now, some = Candidates(lang, frequent, likely, shift), []
                some.append(text)
        yield from ended()

    return run


def frequencies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n) of all runs of up to ``LONGEST`` words with ``least`` occurrences, and '' with all words.

    ``docs`` are (doc_id, lang, text).
    """
    if least != LEAST:
        raise ValueError(f"cells hold counts up to {LEAST}")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text.alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(partitions(spark), -(-size // BLOCK))
    range_bits = max(0, (size // 2 // RANGE).bit_length())  # a run of words for each two bytes, about
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "lang", "text")
    sketch = map_batches(dealt.repartition("block").sortWithinPartitions("block"), _sketch(range_bits), "range long, block long, cells binary")
    frequent = map_batches(sketch.repartition("range").sortWithinPartitions("range"), _frequent, "range long, block long, cells binary")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = frequent.select("block", "range", "cells", none("string", "lang"), none("binary", "text")).unionAll(dealt.select("block", none("long", "range"), none("binary", "cells"), "lang", "text"))
    order = both.repartition("block").sortWithinPartitions("block", F.col("range").isNull(), "lang")
    found = map_batches(order, _scan(range_bits), "lang string, phrase binary, n long")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def score(a, l, r):
    """floor(1000000 a a / (l r)), in decimals of 38 digits."""
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a, 15) * wide(a, 15), wide(l, 19) * wide(r, 19))


def collocations(docs: DataFrame, top: int = TOP, half: int = HALF) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best ``top`` phrases."""
    counts = cut(frequencies(docs))
    words = F.split("phrase", " ")
    runs_ = counts.where("phrase <> ''")
    own = runs_.withColumn("words", words).where(F.size("words") > 1).withColumnRenamed("n", "a")
    join = lambda a, n: F.concat_ws(" ", F.slice("words", a, n))
    parts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    parts = parts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    of = lambda name, f: runs_.select("lang", F.col("phrase").alias(name), F.col("n").alias(f))
    cuts = parts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    least = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("least"))
    # What lies inside a longer candidate, and the most frequent of these.
    n = F.size("words")
    inside = own.where(n > 2).withColumn("m", F.explode(F.sequence(F.lit(2), n - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("m") + 1)))
    longer = inside.select("lang", join(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    stays = least.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < half * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = stays.select("lang", "phrase", "a", "least.l", "least.r", "least.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    every = counts.where("phrase = ''").select("lang", "n")
    return best.join(every, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Plain counts of all phrases, then the same scores."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({low}, '[.,;:!?\\n-\\r]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM d),
c AS MATERIALIZED (SELECT lang, phrase, len(string_split(phrase, ' ')) AS m, count(*) AS f FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS phrase FROM w UNION ALL
    SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL
    SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w) GROUP BY lang, phrase),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM c WHERE m >= 2 AND f >= {LEAST}),
k AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
h AS MATERIALIZED (SELECT k.*, c.f AS l FROM k JOIN c ON c.lang = k.lang AND c.phrase = k.head),
s AS (SELECT h.lang, h.phrase, a, k, l, c.f AS r, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * c.f) AS BIGINT) AS score FROM h JOIN c ON c.lang = h.lang AND c.phrase = h.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS MATERIALIZED (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, w[1] || ' ' || w[2] AS phrase FROM cand WHERE m = 3 UNION ALL SELECT lang, a, w[2] || ' ' || w[3] FROM cand WHERE m = 3) GROUP BY lang, phrase)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM b LEFT JOIN i USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < {HALF} * a QUALIFY rank <= {TOP}"""


OP12_SQL = _sql()
