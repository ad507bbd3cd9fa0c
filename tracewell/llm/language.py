"""Language identification by Bayesian evidence fusion.

The log posterior of a language adds up four pieces of evidence:

- the text: its trigrams of bytes of words in lower case under the language's trigram model, against
  a background of the bytes' own frequencies over all languages; fitted on a bounded sample of
  declared texts, tempered since trigrams of one text aren't independent;
- the language that the markup (or the corpus) declares, which may be wrong;
- the suffix of the address, where it stands for a country;
- the host's prior: soft counts of its other texts' languages by grouped aggregation, smoothed
  towards those of its parent domain, which are smoothed towards those of all rows. A row's own
  share is taken out of both, so that its text doesn't count twice.

The background competes as a language of its own. A model backs off to the language's byte
frequencies for trigrams that it hasn't seen, at a cost, of which each word adds a bounded amount; so
a neighbouring language, code, or text without any letters is rather background, which is ``und`` and
not accepted, while single strange words in a text are not held against it.

Cases: null and empty texts are ``und``; a null or unknown declaration, host or url is no evidence;
very long texts are scored whole, in chunks of bounded memory; ties go to the first language by name;
repeated rows get equal results; where no text at all has a known declaration there is nothing to fit
on, and all are ``und``; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.shared import cut, fresh, map_batches, quoted, table
from tracewell.llm.words import slices

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
#: Different texts of each language that the text model is fitted on, about: those of the least hashes, or all of fewer.
SAMPLE = 500
#: Share of the evidence of a text's trigrams that counts; least share of probability for unseen ones.
TEMPER, UNSEEN = 0.25, 0.02
#: What one word speaks against a language at most: a name, a key or an address may stand in any text.
STRANGE = -12.0
#: How often a declaration is right, and the country's language that of its pages.
DECLARED, COUNTRY = 0.9, 0.7
#: Weight of a parent's shares in those of a host, in rows.
PRIOR = 20.0
#: Hosts that are broadcast at most; beyond that, the share of rows from which a host is hot and still is.
MOST_HOSTS, HOT = 200_000, 1 / 1000
#: Bytes of text that are scored together: some fifty times as many are held meanwhile.
_CHUNK = 1 << 19

# Country suffixes by language.
COUNTRIES = {"de": ["at", "de", "li"], "en": ["au", "ie", "nz", "uk", "us"], "es": ["ar", "cl", "co", "es", "mx", "pe", "uy", "ve"], "fr": ["fr", "re", "sn"]}

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the trigrams that hold two letters' bytes or more, the text of each, and the word that its last byte is in or follows."""
    joined = _FOLD[np.frombuffer(b"\n" + b"\n\n".join(texts) + b"\n\n", np.uint8)]
    ends = 1 + np.cumsum([len(t) + 2 for t in texts])  # two gaps keep texts out of each other's trigrams
    letter = (joined != 32).view(np.int8)
    at = np.flatnonzero(letter[:-2] + letter[1:-1] + letter[2:] >= 2)
    code = joined[at].astype(np.uint32) << 16 | joined[at + 1].astype(np.uint32) << 8 | joined[at + 2]
    word = np.cumsum(np.diff(letter, prepend=np.int8(0)) == 1)
    return code, np.searchsorted(ends, at + 1, side="right"), word[at + 2]


def _bytes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return code >> np.uint32(16), code >> np.uint32(8) & np.uint32(255), code & np.uint32(255)


class TextModel:
    """Log likelihood ratios of trigrams, per language, to a background of bytes on their own.

    ``counts`` are (codes, times) of each language's sample. A language gives trigrams that it hasn't
    seen the share that Witten and Bell give to what is new, ``UNSEEN`` at least, by its bytes' own
    frequencies. A language without a sample is as likely as the background and never wins.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = [counts.get(k, none) for k in LANGUAGES]
        self.fitted = np.array([len(c) > 0 for c, _ in found])
        self.codes = np.unique(np.concatenate([c for c, _ in found])).astype(np.uint32)
        single = np.stack([self._single(c, n) for c, n in found])
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.log((single[self.fitted].mean(0) if self.fitted.any() else single.mean(0)))
            self.byte = (np.log(single) - back).T.astype(np.float64)  # of each byte
        self.new = np.zeros(len(LANGUAGES))
        self.seen = np.zeros((len(self.codes), len(LANGUAGES)), np.float32)
        for k, (c, n) in enumerate(found):
            if not len(c):
                self.byte[:, k] = 0
                continue
            total = n.sum()
            self.new[k] = np.log(max(UNSEEN, len(c) / (len(c) + total)))
            own = np.zeros(len(self.codes))
            own[np.searchsorted(self.codes, c)] = n / total
            triple = [np.log(single[k][b]) for b in _bytes(self.codes)]
            below = [back[b] for b in _bytes(self.codes)]
            new = np.exp(self.new[k])
            self.seen[:, k] = np.log((1 - new) * own + new * np.exp(sum(triple))) - sum(below)
        # Where each code is, by a hash of it; those whose place is taken are searched for.
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[self._hash(self.codes)] = np.arange(len(self.codes))
        lost = self.slot[self._hash(self.codes)] != np.arange(len(self.codes))
        self.lost, self.lost_at = self.codes[lost], np.flatnonzero(lost)

    @staticmethod
    def _single(codes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Shares of each byte in the trigrams, none of them zero."""
        sums = sum((np.bincount(b, times, 256) for b in _bytes(codes)), np.zeros(256)) + 0.01
        return sums / sums.sum()

    @staticmethod
    def _hash(code: np.ndarray) -> np.ndarray:
        return (code * np.uint32(2654435761)) >> np.uint32(12)

    def find(self, code: np.ndarray) -> np.ndarray:
        """The place of each code among those seen, or -1."""
        if not len(self.codes):
            return np.full(len(code), -1)
        at = self.slot[self._hash(code)]
        at[(at >= 0) & (self.codes[at] != code)] = -1
        if len(self.lost):
            rest = np.flatnonzero(at < 0)
            k = np.minimum(np.searchsorted(self.lost, code[rest]), len(self.lost) - 1)
            hit = self.lost[k] == code[rest]
            at[rest[hit]] = self.lost_at[k[hit]]
        return at

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Tempered log likelihood ratios to the background, per text and language."""
        out = [np.zeros((0, len(LANGUAGES)))]
        for a, b in slices(texts, _CHUNK):
            code, doc, word = trigrams(texts[a:b])
            at = self.find(code)
            new = np.flatnonzero(at < 0)
            x, y, z = _bytes(code[new])
            # Trigrams of a word stand together, so their sums are between the places where it begins.
            begin = np.flatnonzero(np.diff(word, prepend=-1) | np.diff(doc, prepend=-1))
            sums = np.zeros((b - a, len(LANGUAGES)))
            for k in range(len(LANGUAGES) if len(begin) else 0):
                each = self.seen[at, k].astype(np.float64)
                each[new] = self.byte[x, k] + self.byte[y, k] + self.byte[z, k] + self.new[k]
                sums[:, k] = np.bincount(doc[begin], np.maximum(np.add.reduceat(each, begin), STRANGE), b - a)[: b - a]
            sums[:, ~self.fitted] = np.minimum(sums.min(1, initial=0.0), 0)[:, None]
            out.append(sums * TEMPER)
        return np.concatenate(out)


def fit(docs: DataFrame, text_col: str, declared: Column) -> TextModel:
    """From about ``SAMPLE`` different whole texts of each declared language, those of the least hashes, or all of fewer."""
    known = docs.select(declared.alias("language"), quoted(text_col).alias("text")).where(F.col("language").isin(*LANGUAGES) & F.col("text").isNotNull())
    known = known.withColumn("h", F.xxhash64("text"))

    # The least hashes are those below a share of their range, so that no task ranks a language's texts.
    sizes = {r["language"]: r["n"] for r in known.groupBy("language").agg(F.approx_count_distinct("h").alias("n")).collect()}  # four at most
    bounds = {k: min(2**63 - 1, int(SAMPLE / max(n, 1) * 2**64) - 2**63) for k, n in sizes.items()}
    chosen = [(F.col("language") == k) & (F.col("h") <= F.lit(h).cast("long")) for k, h in bounds.items()]
    some = known.where(reduce(or_, chosen, F.lit(False))).dropDuplicates(["language", "h"]).select("language", "text").coalesce(4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}
        for b in batches:
            for language, text in zip(b.column("language").to_pylist(), b.column("text").to_pylist()):
                codes, times = np.unique(trigrams([text.encode()])[0], return_counts=True)
                sums.setdefault(language, Counter()).update(dict(zip(codes.tolist(), times.tolist())))
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.string()), pa.array([list(v)], pa.list_(pa.int64())), pa.array([list(v.values())], pa.list_(pa.int64()))], names=["language", "codes", "times"])

    counts: dict[str, Counter] = {}
    for r in map_batches(some, count, "language string, codes array<long>, times array<long>").collect():  # four tasks, four languages at most
        counts.setdefault(r["language"], Counter()).update(dict(zip(r["codes"], r["times"])))
    return TextModel({k: (np.array(sorted(v), np.uint32), np.array([v[c] for c in sorted(v)], np.int64)) for k, v in counts.items()})


def _tag(declared: Column) -> Column:
    """``en`` of ``en-US``; null if it isn't one of the languages."""
    tag = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:$|[-_\s])", 1))
    return F.when(tag.isin(*LANGUAGES), tag)


def _declared(tag: list[str | None]) -> np.ndarray:
    """Log likelihood of each declaration under each language; none if it is unknown."""
    right, wrong = np.log(DECLARED), np.log((1 - DECLARED) / (len(LANGUAGES) - 1))
    return np.array([[0.0] * len(LANGUAGES) if t is None else [right if t == k else wrong for k in LANGUAGES] for t in tag]).reshape(-1, len(LANGUAGES))


def _country(host: list[str]) -> np.ndarray:
    right, wrong = np.log(COUNTRY), np.log((1 - COUNTRY) / (len(LANGUAGES) - 1))
    of = {c: k for k, cs in COUNTRIES.items() for c in cs}
    found = [of.get(h.rpartition(".")[2]) if "." in h else None for h in host]
    return np.array([[0.0] * len(LANGUAGES) if f is None else [right if f == k else wrong for k in LANGUAGES] for f in found]).reshape(-1, len(LANGUAGES))


def posterior(text: np.ndarray, evidence: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Shares of the languages and, last, of the background, whose prior is half a language's.

    A text without evidence of its own is the background for certain.
    """
    logs = np.column_stack((text + evidence + prior, np.full(len(text), np.log(0.5 / len(LANGUAGES)))))
    logs[~text.any(1), :-1] = -np.inf
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def host_counts(soft: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(host, rows, of_de, ..., up_de, ...): soft counts of each host and its parent; and the shares of all rows.

    ``soft`` has (host, rows, de, en, es, fr). The parent is the last two parts of a longer name.
    """
    total = soft.agg(*(F.sum(k) for k in LANGUAGES)).first()
    base = np.array([x or 0.0 for x in total]) + 1
    parent = F.when(F.size(F.split("host", r"\.")) > 2, F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).otherwise("")
    with_parent = soft.withColumn("parent", parent)
    above = with_parent.where("parent <> ''").groupBy("parent").agg(*(F.sum(k).alias(f"up_{k}") for k in LANGUAGES))
    joined = with_parent.join(above, "parent", "left")
    return joined.select("host", "rows", *(F.col(k).alias(f"of_{k}") for k in LANGUAGES), *(F.col(f"up_{k}") for k in LANGUAGES)), base / base.sum()


def log_priors(own: np.ndarray, host: np.ndarray, parent: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Log priors of rows from the counts of their hosts and parents (nan for none), their own shares taken out."""
    up = np.maximum(parent - own, 0)
    up = np.where(np.isnan(parent), base, (up + PRIOR * base) / (up.sum(1, keepdims=True) + PRIOR))
    here = np.maximum(host - own, 0)
    return np.log((here + PRIOR * up) / (here.sum(1, keepdims=True) + PRIOR))


def identify(docs: DataFrame, text_col: str = "text", declared_col: str | None = None, host: Column | None = None, address: bool = True, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and ``language``, ``probability``, ``accepted``.

    The new columns get an underscore in front where ``docs`` has columns of their names.
    ``declared_col`` holds declared languages; ``host`` is what shares a prior, with dots before
    its parents, and, if ``address``, the host of an address whose last part may be a country.
    With ``keep_text``, texts are scored twice, for the priors and with them, rather than written or
    shuffled in between. Without, the text column is left out, and they are scored once.
    """
    names = [c for c in docs.columns if keep_text or c != text_col]
    said, shared, known, n_rows, *rest = fresh(docs, "declared", "host", "known", "rows", *(f"{x}_{k}" for x in ("of", "up", "text") for k in LANGUAGES))
    counted, scores = rest[: 2 * len(LANGUAGES)], rest[2 * len(LANGUAGES) :]
    outcome = fresh(docs, "language", "probability", "accepted")
    declared = _tag(quoted(declared_col)) if declared_col else F.lit(None).cast("string")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, declared))
    extra = docs.withColumns({said: declared, shared: F.coalesce(host, F.lit("")) if host is not None else F.lit("")})
    even = np.full(len(LANGUAGES), np.log(1 / len(LANGUAGES)))

    def texts(b: pa.RecordBatch, k: int) -> np.ndarray:
        return model.value.score(b.column(k).cast(pa.large_binary()).fill_null(b"").to_pylist())

    if not keep_text:
        at = extra.columns.index(text_col)
        others = [k for k, c in enumerate(extra.columns) if k != at]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in others), *map(pa.array, texts(b, at).T)], names=[*(b.schema.names[k] for k in others), *scores])

        fields = [f for f in extra.schema.fields if f.name != text_col] + [T.StructField(c, T.DoubleType()) for c in scores]
        extra = cut(map_batches(extra, scan, T.StructType(fields)))

    def evidence(b: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of the text, and of what is said about it."""
        if keep_text:
            score = texts(b, columns.index(text_col))
        else:
            score = np.column_stack([b.column(columns.index(c)).to_numpy() for c in scores])
        more = _declared(b.column(columns.index(said)).to_pylist())
        return score, more + _country(b.column(columns.index(shared)).to_pylist()) if address else more

    slim = [text_col, said, shared] if keep_text else [said, shared, *scores]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = posterior(*evidence(b, slim), even)
            hosts, own = np.unique(np.array(b.column(slim.index(shared)).to_pylist(), object), return_inverse=True) if len(b) else ([], np.zeros(0, int))
            sums = [pa.array(np.bincount(own, p[:, k], len(hosts))) for k in range(len(LANGUAGES))]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(np.bincount(own, minlength=len(hosts))), *sums], names=["host", "rows", *LANGUAGES])

    soft = map_batches(extra.select(*map(quoted, slim)), count, "host string, rows long" + "".join(f", {k} double" for k in LANGUAGES))
    soft = soft.groupBy("host").agg(F.sum("rows").alias("rows"), *(F.sum(k).alias(k) for k in LANGUAGES))
    counts, base = host_counts(cut(soft, small=True))
    counts = cut(counts, small=True).toDF(known, n_rows, *counted)
    on = quoted(shared) == quoted(known)
    if counts.count() <= MOST_HOSTS:
        joined = extra.join(F.broadcast(counts), on, "left")
    else:
        # No task gets all rows of a hot host: there are 1/HOT of those at most.
        least = (counts.agg(F.sum(quoted(n_rows))).first()[0] or 0) * HOT
        hot = extra.join(F.broadcast(counts.where(quoted(n_rows) >= least)), on, "left")
        others = hot.where(quoted(known).isNull()).select(*map(quoted, extra.columns)).join(counts.where(quoted(n_rows) < least), on, "left")
        joined = hot.where(quoted(known).isNotNull()).unionAll(others)
    columns = [*extra.columns, *counted]
    joined = joined.select(*map(quoted, columns))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = len(LANGUAGES)
        for b in batches:
            of, up = (np.column_stack([b.column(columns.index(k)).to_numpy(zero_copy_only=False).astype(float) for k in part]) for part in (counted[:half], counted[half:]))
            text, more = evidence(b, columns)
            own = posterior(text, more, even)[:, :half]
            p = posterior(text, more, log_priors(own, of, up, base))
            best = p.argmax(1)
            kinds = [*LANGUAGES, UNKNOWN]
            out = [pa.array([kinds[k] for k in best], pa.string()), pa.array(p[np.arange(len(b)), best]), pa.array(best < half)]
            mine = [columns.index(c) for c in names]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in mine), *out], names=[*(b.schema.names[k] for k in mine), *outcome])

    kept = [f for f in docs.schema.fields if f.name in names]
    schema = T.StructType([*kept, *(T.StructField(c, t()) for c, t in zip(outcome, (T.StringType, T.DoubleType, T.BooleanType)))])
    return map_batches(joined, decide, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: ``lang`` is the declaration, ``source`` the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = identify(docs, "text", "lang", F.col("source"), address=False, keep_text=False)
    return found.select("doc_id", "language", F.round("probability", 6).alias("probability"), "accepted")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the declaration is the html element's, the host and suffix are the url's."""
    text = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    host = F.lower(F.regexp_extract("url", r"://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", text.alias("text"), host.alias("host"), declared.alias("declared"))
    found = identify(pages, "text", "declared", F.col("host"), keep_text=False)
    return found.select("page_id", "host", "language", F.round("probability", 6).alias("probability"), "accepted")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, in one of the languages."""
    found = identify(docs, "text", "lang", F.col("source"), address=False)
    return found.where(quoted(found.columns[-1])).select(*map(quoted, docs.columns))
