"""WARC archives: writing, revisit resolution by payload digest, and reading back.

`capture` writes one response record a page into gzip archives (a member a record) and
returns their index, a header row a record. `resolve` shuffles these header rows, never
payloads, by payload digest, and joins each repeated payload to its original: of records
with equal payloads of at least `MIN_REVISIT` bytes, that with the smallest page_id stays a
response. `deduplicate` then reads each archive once and writes a new one with fresh
headers, in which a repeat is a revisit record without payload. `read` parses archives, and
`payloads_of` joins revisits to their originals by digest again. A digest that a third of
all records share is salted in both joins: each side's salts are gathered as one 64-bit
mask, so the other side is copied only to salts that occur.

Tasks write archives under new names and return index rows, which are kept as a table; an
archive of a task that failed or was lost isn't in it and so is never read.

Defined cases: null html is an empty payload; a null url is an empty target. Rows with a
null page_id come after all ids; if no record of a payload has an id, all stay responses.
Repeated rows with the smallest page_id of their payload all stay responses. Other columns
are ignored, whatever their names. A very long html is written whole, as one record. An empty
table gives no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import scratch, shared_dir, written

MIN_REVISIT = 100
#: Bytes after which a task starts another archive.
SEGMENT_BYTES = 32 << 20
SALTS = 64
#: Archive bytes that a task reads back, about, and the fewest that are worth a task of their own.
TASK_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:dossier:warc")

INDEX = "path string, offset long, length long, record_id string, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_record string, payload binary"


def _safe(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def record(kind: str, record_id: str, url: str, digest: str, page_id: int | None, payload: bytes, refers: str = "") -> bytes:
    """One uncompressed WARC record; a revisit's block holds the HTTP header only."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"Page-Number: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    body = rest[: int(fields["content-length"])]
    if len(body) != int(fields["content-length"]):
        raise ValueError("a WARC record is cut short")
    return fields, body.partition(b"\r\n\r\n")[2]


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(map(str, parts)))}>"


class _Writer:
    """Archives of about `limit` bytes in a folder of any file system that pyarrow knows."""

    def __init__(self, folder: str, limit: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.limit, self.out, self.at, self.path = limit, None, 0, ""

    def open(self) -> None:
        if self.out is None or self.at >= self.limit:
            self.close()
            self.path, self.at = f"{self.root.rstrip('/')}/{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(self.path, compression=None)

    def put(self, raw: bytes) -> tuple[int, int]:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        self.out.write(member)
        self.at += len(member)
        return self.at - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _index(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_INDEX_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _INDEX_TYPES)], names=_INDEX_NAMES)


def capture(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write each page as a response record; the index of the archives, as a table in the shared folder."""
    folder = scratch(pages.sparkSession, "warc-raw")

    def run(batches):
        w = _Writer(folder, segment_bytes)
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                page_id, url = page_id.as_py(), url.as_py() or ""
                w.open()
                digest = hashlib.sha256(payload).hexdigest()
                rid = record_id("raw", w.path.rsplit("/", 1)[-1], w.at)
                offset, length = w.put(record("response", rid, url, digest, page_id, payload))
                rows.append((w.path, offset, length, rid, page_id, url, digest, len(payload), "response", None))
            yield _index(rows)
        w.close()

    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, INDEX), "warc-index")


def _salted_join(left: DataFrame, right: DataFrame, key: str, salt_of: str) -> DataFrame:
    """left joined, left outer, to right, which has at most one row a key. A key's left rows are spread over up to SALTS salts."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(SALTS)).cast("int"))
    masks = salted.groupBy(key).agg(F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask"))
    present = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(_mask, s) & 1L) = 1L)")
    copies = right.join(masks, key).withColumn("_salt", F.explode(present)).drop("_mask")
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def resolve(index: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """The index with record_type and refers_to decided, and refers_to_record, the original's record id."""
    originals = (
        index.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))).alias("_record"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _first is not null")
        .select("payload_digest", "_first", F.col("_record.record_id").alias("_original"))
    )
    out = _salted_join(index.drop("record_type", "refers_to"), originals, "payload_digest", "record_id")
    repeat = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_first")))
    return out.select(
        *[c for c in _INDEX_NAMES if c not in ("record_type", "refers_to")],
        F.when(repeat, "revisit").otherwise("response").alias("record_type"),
        F.when(repeat, F.col("_first")).alias("refers_to"),
        F.when(repeat, F.col("_original")).alias("refers_to_record"),
    )


def _tasks(index: DataFrame) -> int:
    """Tasks for reading an index's archives, by their bytes: its own rows are too small to tell."""
    size = int(index.agg(F.sum("length")).first()[0] or 0)
    return max(1, -(-size // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))


def deduplicate(resolved: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write new archives, one pass over each old one, with fresh headers; their index, as a table."""
    spark = resolved.sparkSession
    folder = scratch(spark, "warc-dedup")

    def run(batches):
        w = _Writer(folder, segment_bytes)
        path, source = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    if source is not None:
                        source.close()
                    path, source = r["path"], w.fs.open_input_file(r["path"])
                w.open()
                rid = record_id("dedup", r["record_id"])
                if r["record_type"] == "response":
                    fields, payload = parse(zlib.decompress(source.read_at(r["length"], r["offset"]), 31))
                    if fields["warc-record-id"] != r["record_id"]:
                        raise ValueError("the index names another record")
                    raw = record("response", rid, r["url"], r["payload_digest"], r["page_id"], payload)
                else:
                    raw = record("revisit", rid, r["url"], r["payload_digest"], r["page_id"], b"", record_id("dedup", r["refers_to_record"]))
                offset, length = w.put(raw)
                rows.append((w.path, offset, length, rid, r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"]))
            yield _index(rows)
        w.close()
        if source is not None:
            source.close()

    # Spans of one archive's records of about 8 MB stay together, so that no task holds more than one span of a sort.
    span = F.floor(F.col("offset") / (8 << 20))
    resolved = written(resolved, "warc-resolved")
    ordered = resolved.withColumn("_span", span).repartition(_tasks(resolved), "path", "_span").sortWithinPartitions("path", "_span", "offset").drop("_span")
    return written(ordered.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives that an index names, parsed from their bytes; lengths and digests of responses are measured."""
    spark = index.sparkSession
    uri = shared_dir(spark)

    def run(batches):
        files = fs.FileSystem.from_uri(uri)[0]
        for batch in batches:
            for r in batch.to_pylist():
                with files.open_input_file(r["path"]) as f:
                    raw = f.read_at(r["stop"] - r["start"], r["start"])
                rows = []
                while raw:
                    z = zlib.decompressobj(31)
                    fields, payload = parse(z.decompress(raw) + z.flush())
                    raw, kind, page = z.unused_data, fields["warc-type"], fields.get("page-number")
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload doesn't have the digest that its header gives")
                    rows.append((int(page) if page is not None else None, fields["warc-target-uri"], fields["warc-record-id"], kind, digest, len(payload) if kind == "response" else None, fields.get("warc-refers-to"), payload if with_payload and kind == "response" else None))
                types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in RECORD.split(", ")])

    # Consecutive records of about 1 MB are one read.
    reads = index.groupBy("path", F.floor(F.col("offset") / (1 << 20)).alias("_part")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"))
    return reads.repartition(_tasks(index), "path", "_part").select("path", "start", "stop").mapInArrow(run, RECORD)


def payloads_of(records: DataFrame) -> DataFrame:
    """Records with each revisit's payload_bytes, and refers_to, from the original of its digest; fails if there is none."""
    originals = records.where("record_type = 'response'").groupBy("payload_digest").agg(F.min("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"))
    revisits = _salted_join(records.where("record_type = 'revisit'"), originals, "payload_digest", "record_id")
    known = F.when(F.col("_bytes").isNull(), F.raise_error(F.lit("a revisit has no original"))).otherwise(F.col("_bytes"))
    names = ["page_id", "url", "record_id", "payload_digest", "record_type"]
    responses = records.where("record_type = 'response'").select(*names, "payload_bytes", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits.select(*names, known.cast("long").alias("payload_bytes"), F.col("_page").alias("refers_to")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, deduplicate and read back: page_id, payload_bytes, payload_digest, record_type, refers_to for each page."""
    archives = deduplicate(resolve(capture(pages)))
    records = written(read(archives).drop("payload"), "warc-records")
    return payloads_of(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
