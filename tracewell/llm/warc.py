"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writing: the first page (smallest id) of those with equal payloads of ``MIN_PAYLOAD`` bytes or more
is a response, the others are revisits of it without a payload. Payload digests are grouped with
minima combined before the shuffle; the few digests that repeat come back by a broadcast whose size
is checked, or, beyond that, by a join for which hot digests are broadcast and taken out of the
shuffled key. Each task writes one file; only files of tasks that ended well are kept.

Reading: a task gets a byte range of an archive. It scans for the gzip magic, validates a candidate
by decoding its beginning as a WARC header, and owns the records whose members start in its range;
from the first on, it goes from member to member, past the end of the range where the last needs
that. So ranges can be of any size, and every record has one owner.

Cases: null html is an empty payload; a null page_id is always a response and nobody's first; rows
with equal ids and payloads are all responses; a null url gives no target; control characters in
a url are percent-encoded; an empty table gives no archive; very long payloads are one record each,
decoded whole in one task; damaged members are passed over; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import cut, map_batches, shared_dir, table

MIN_PAYLOAD = 100
#: Bytes of an archive that one task reads.
SPLIT = 8 << 20
#: Digests that are broadcast at most, and the share of rows from which a digest is hot.
MOST_BROADCAST, HOT = 200_000, 1 / 1000
_READ = 1 << 18
_MAGIC = b"\x1f\x8b\x08"


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_payload(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) of each page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"))
    firsts = cut(rows.where((F.col("payload_bytes") >= min_payload) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), small=True)
    refers = F.when((F.col("page_id") > F.col("first")) & (F.col("payload_bytes") >= min_payload), F.col("first")).alias("refers_to")
    keep = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    if firsts.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(firsts.select("payload_digest", "first")), "payload_digest", "left").select(*keep, refers)
    total = firsts.agg(F.sum("n")).first()[0]
    hot = firsts.where(F.col("n") > max(1000, int(total * HOT))).select("payload_digest", F.col("first").alias("hot"))  # 1/HOT at most
    rest = firsts.select(F.col("payload_digest").alias("key"), "first")
    known = rows.join(F.broadcast(hot), "payload_digest", "left")
    key = F.when(F.col("hot").isNotNull(), F.concat(F.lit("hot "), F.col("page_id").cast("string"))).otherwise(F.col("payload_digest"))
    joined = known.withColumn("key", key).join(rest, "key", "left").withColumn("first", F.coalesce("hot", "first"))
    return joined.select(*keep, refers)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    own = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own(f'{name} {url}') if refers_to is not None or page_id is None else own(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-Id: {name}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if refers_to is not None:
        head += [f"X-Refers-To-Page: {refers_to}", f"WARC-Refers-To: {own(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write archives of all pages into a folder that all executors share; returns (path, size)."""

    def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        path = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out = None
        try:
            for b in batches:
                for page, url, html, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to"))):
                    out = out or fs.open_output_stream(path, compression=None)
                    out.write(record(page, url, html.encode(), digest, first))
        finally:
            if out:
                out.close()
        if out:
            size = fs.get_file_info(path).size
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "size"])

    done = cut(map_batches(with_payload(pages, min_payload), dump, "path string, size long"))
    names = {r["path"] for r in done.select("path").collect()}  # one per task
    fs, root = _files(folder)
    for f in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)):
        if f.path not in names and f.is_file:  # of attempts that failed or lost
            fs.delete_file(f.path)
    return done


def _fields(head: bytes) -> dict[str, str]:
    """A header's fields by their names in lower case; the first of repeats, folded lines joined."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]:
        name, colon, value = line.decode(errors="replace").partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d{1,18}", value) else None


def _digest(value: str | None) -> str | None:
    """A declared SHA-256 as bare hex in lower case, also from base 32; null for any other kind."""
    kind, _, text = (value or "").partition(":")
    if kind.lower().replace("-", "") != "sha256":
        return None
    if re.fullmatch(r"[0-9a-fA-F]{64}", text):
        return text.lower()
    try:
        return base64.b32decode(text.upper() + "=" * (-len(text) % 8)).hex()
    except ValueError:
        return None


def _payload(head: dict[str, str], block: bytes) -> bytes:
    """The block without the headers of HTTP, if it is such a message; undone chunks and compression."""
    if "application/http" not in head.get("content-type", "").lower():
        return block
    top, _, body = block.partition(b"\r\n\r\n")
    http = _fields(top)
    if "chunked" in http.get("transfer-encoding", "").lower():
        parts, rest = [], body
        while m := re.match(rb"([0-9a-fA-F]{1,8})[^\r\n]*\r\n", rest):
            size = int(m[1], 16)
            parts.append(rest[m.end() : m.end() + size])
            rest = rest[m.end() + size + 2 :]
            if not size:
                break
        body = b"".join(parts) if parts else body
    if http.get("content-encoding", "").strip().lower() in ("gzip", "x-gzip"):
        try:
            body = zlib.decompressobj(31).decompress(body)
        except zlib.error:
            pass  # served under a wrong name: as it stands
    return body


#: Types of records that carry a page.
PAGES = ("response", "revisit", "resource")


class _Archive:
    """Members of one archive, from any byte position."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def decode(self, at: int, most: int | None = None) -> tuple[bytes, int] | None:
        """The member at ``at`` and where the next begins; None if there is no whole member.

        With ``most``, the member's beginning only, of about so many bytes.
        """
        z, out, pos = zlib.decompressobj(31), [], at
        try:
            while not z.eof and pos < self.size:
                part = self.file.read_at(min(_READ if most is None else 4096, self.size - pos), pos)
                out.append(z.decompress(part))
                pos += len(part)
                if most is not None and sum(map(len, out)) >= most:
                    break
        except zlib.error:
            return None
        if most is None and not z.eof:
            return None
        return b"".join(out), pos - len(z.unused_data)

    def valid(self, at: int) -> bool:
        head = self.decode(at, 512)
        return head is not None and re.match(rb"WARC/\d\.\d\r\n(?:[!-~]+:[^\r\n]*\r\n)*", head[0]) is not None and b"\r\nwarc-type:" in head[0].lower()

    def find(self, at: int, end: int) -> int | None:
        """Where the first valid member begins, from ``at`` on and before ``end``."""
        while at < end:
            part = self.file.read_at(min(_READ, self.size - at), at)
            k = part.find(_MAGIC)
            if k < 0:
                if at + len(part) >= self.size:
                    return None
                at += len(part) - 2
            elif at + k < end and self.valid(at + k):
                return at + k
            else:
                at += k + 1
        return None

    def records(self, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
        at = start
        while (at := self.find(at, end)) is not None:
            member = self.decode(at)
            if member is None:  # damaged after its header: go on behind it
                at += 1
                continue
            content, at = member
            head, _, block = content.partition(b"\r\n\r\n")
            fields = _fields(head)
            length = _number(fields.get("content-length"))
            yield fields, block if length is None else block[:length]


def read(archives: DataFrame, split: int = SPLIT, folder: str = "", payload: bool = True) -> DataFrame:
    """Records of the archives ``(path, size)``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Any archive of one gzip member per record will do. Records that carry no page (warcinfo, request,
    metadata and others) are passed over. Sizes and digests of responses are those of the payload as
    read, without HTTP headers, chunks and compression; those of revisits as declared. What a record
    doesn't declare is null, as are page ids of archives that were not written here.
    """
    spans = archives.where("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    n = archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1
    ranges = spans.repartition(int(n))  # round robin: a task per range, about
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _files(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for head, block in _Archive(file).records(start, start + split):
                        kind = head.get("warc-type", "").lower()
                        if kind not in PAGES:
                            continue
                        body = b"" if kind == "revisit" else _payload(head, block)
                        if kind == "revisit":
                            size, digest = _number(head.get("x-payload-length")), _digest(head.get("warc-payload-digest"))
                        else:
                            size, digest = len(body), hashlib.sha256(body).hexdigest()
                        url = head.get("warc-target-uri")
                        row = (_number(head.get("x-page-id")), url and url.removeprefix("<").removesuffix(">"), size, digest, kind, _number(head.get("x-refers-to-page")))
                        rows.append((*row, body) if payload else row)
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return map_batches(ranges.select("path", "start"), scan, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write(table(spark, sf_dir, "pages"), folder)
    return read(archives, folder=folder, payload=False).drop("url")


OP10_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
