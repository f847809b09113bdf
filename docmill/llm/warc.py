"""WARC archives: writing with revisits, segments and chunked framing, and reading them back.

Writing. Each row is one capture: an HTTP response whose body, the payload, is in chunked
transfer framing. Of equal payloads of at least REVISIT_FROM bytes the one with the smallest id
is written whole; the others become revisit records that name it. A block longer than `segment`
bytes is cut: the first part is the response record, numbered 1, the rest are continuation
records that name it as their origin, and the last of them bears the total length. Spark's text
writer puts the records into files (they end as the format asks, with two empty lines, which is
the writer's line separator) and compresses each with gzip, so any file system that Spark writes to will do, and a lost task
leaves no half file.

Reading. Files are parsed record by record by their Content-Length. Segments are grouped by the
origin's id, ordered by number, checked to be without gaps and of the stated total length, and
joined; then the chunked framing is decoded and the payload's digest verified. Only records in
several segments are shuffled.

Null payloads count as empty. Rows that repeat an id are captures of their own; of those that
share the smallest id of a payload, each is written whole. A null id is written as "null" and
read back as null; it ranks after all others. Null URIs leave the header out. Empty tables give
no files and an empty result. Ids are longs. Columns besides the three named ones may have any
name. A very long payload is cut into segments; its task holds it and its framed copy.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import checkpoint
from docmill.workers import ship

REVISIT_FROM = 100
SEGMENT, CHUNK = 65_536, 8_192
#: Records of one file; with segments of SEGMENT bytes at most, a file is at most this many of them.
RECORDS_PER_FILE = 1_000
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c := payload[i : i + size]), c) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload; chunk extensions and trailers are allowed."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends before its stated length")
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """An HTTP message's body without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two empty lines that end it."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(fields["content-length"])
        if start + size > len(data):
            raise ValueError("a record ends before its stated length")
        yield fields, data[start : start + size]
        at = start + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def plain(data: bytes) -> bytes:
    """A file's records, whether it is compressed (as one gzip member or several) or not."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _uri(url: str | None) -> str | None:
    return url and "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def write(df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Write an archive, a folder of files, at path."""
    ship(df.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload")})
    firsts = rows.filter(F.col("n") >= REVISIT_FROM).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times"))
    firsts = firsts.filter((F.col("times") > 1) & F.col("first").isNotNull()).select(F.col("digest").alias("same"), "first")
    known = rows.join(firsts, (F.col("digest") == F.col("same")) & (F.col("n") >= REVISIT_FROM), "left")
    refers = F.when(F.col("first") < F.coalesce("id", F.lit((1 << 63) - 1)), F.col("first"))
    plan = known.select("id", "uri", F.when(refers.isNull(), F.col("payload")).alias("payload"), "digest", refers.alias("refers"))

    def build(batches):
        made = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                out: list[bytes] = []
                for x in whole.slice(at, 200).to_pylist():
                    made += 1
                    name = f"<urn:uuid:{uuid.uuid4()}>"
                    base = {"WARC-Date": DATE, "WARC-Target-URI": _uri(x["uri"]), "WARC-Payload-Digest": f"sha256:{x['digest']}", "X-Capture-Id": "null" if x["id"] is None else x["id"]}
                    if x["refers"] is not None:
                        more = {"WARC-Type": "revisit", "WARC-Record-ID": name, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Capture": x["refers"]}
                        out.append(record(more | base, HTTP[: HTTP.index(b"\r\n\r\n") + 4]))
                        continue
                    block = HTTP + chunked(x["payload"], chunk)
                    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                    if len(parts) == 1:
                        out.append(record({"WARC-Type": "response", "WARC-Record-ID": name, "Content-Type": "application/http;msgtype=response"} | base, block))
                        continue
                    first = {"WARC-Type": "response", "WARC-Record-ID": name, "Content-Type": "application/http;msgtype=response", "WARC-Segment-Number": 1}
                    out.append(record(first | base, parts[0]))
                    for i, part in enumerate(parts[1:], 2):
                        fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": i}
                        out.append(record(fields | ({"WARC-Segment-Total-Length": len(block)} if i == len(parts) else {}), part))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = plan.mapInArrow(build, "record binary").select(F.col("record").cast("string").alias("value"))
    files = records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
    files.mode("overwrite").text(path, compression="gzip")


PART = "id bigint, uri string, kind string, digest string, refers bigint, origin string, number int, total bigint, block binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures of an archive: id, uri, record_type, payload_digest, refers_to, payload.

    A revisit's payload is null (its capture is named by refers_to). A gap in the segments, a
    wrong total length, broken framing or a digest that does not fit ends the query with an error.
    """
    ship(spark)
    names = [x.split()[0] for x in PART.split(", ")]

    def parts(batches):
        for batch in batches:
            for data in batch.column(0):
                out: list[list] = [[] for _ in names]
                held = 0
                for f, block in parse(plain(data.as_buffer().to_pybytes())):
                    number = lambda key: int(v) if (v := f.get(key, "null")) != "null" else None
                    digest = f.get("warc-payload-digest", "").partition(":")[2] or None
                    row = (
                        number("x-capture-id"), f.get("warc-target-uri"), f["warc-type"], digest, number("x-refers-to-capture"),
                        f.get("warc-segment-origin-id") or f["warc-record-id"], number("warc-segment-number"), number("warc-segment-total-length"), block,
                    )
                    for column, value in zip(out, row):
                        column.append(value)
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
                        out, held = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def decode(batches):
        for batch in batches:
            payloads = []
            for kind, digest, block in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("kind", "digest", "block"))):
                payload = None if kind == "revisit" else payload_of(block)
                if payload is not None and digest and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("a payload does not fit its digest")
                payloads.append(payload)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "uri", "kind", "digest", "refers")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(payloads, pa.binary())], names=["id", "uri", "record_type", "payload_digest", "refers_to", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = files.mapInArrow(parts, PART)
    single = found.filter("number is null").select("id", "uri", "kind", "digest", "refers", "block")
    pieces = F.sort_array(F.collect_list(F.struct("number", "block")))
    whole = found.filter("number is not null").groupBy("origin").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("id", "uri", "digest", "refers")],
        pieces.alias("pieces"),
        F.max("total").alias("total"),
        F.max("number").alias("last"),
        F.count("*").alias("n"),
        F.sum(F.octet_length("block")).alias("size"),
    )
    right = (F.col("n") == F.col("last")) & (F.col("size") == F.col("total")) & (F.size(F.array_distinct("pieces.number")) == F.col("n"))
    joined = F.aggregate(F.slice("pieces.block", F.lit(2), F.greatest(F.size("pieces") - 1, F.lit(1))), F.element_at("pieces.block", 1), lambda a, b: F.concat(a, b))
    reassembled = whole.select(
        "id", "uri", F.lit("response").alias("kind"), "digest", "refers",
        F.when(right, joined).otherwise(F.raise_error(F.concat(F.lit("segments are missing or too many: "), F.col("origin")))).alias("block"),
    )
    out = "id bigint, uri string, record_type string, payload_digest string, refers_to bigint, payload binary"
    return single.unionByName(reassembled).mapInArrow(decode, out)


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with payload_bytes; a revisit's is that of the capture that it names.

    The columns besides the payload are written to the shared folder, however often they are used
    then. Until that the archive is parsed twice: for whole records and for segments.
    """
    own = checkpoint(captures.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload"))
    named = own.filter("record_type = 'response'").select(F.col("payload_digest").alias("_digest"), F.col("id").alias("_id"), F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = own.filter("record_type = 'revisit'").drop("payload_bytes")
    found = revisits.join(named, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    seen = found.select(*revisits.columns, F.col("_bytes").alias("payload_bytes"))
    return own.filter("record_type = 'response'").unionByName(seen)
