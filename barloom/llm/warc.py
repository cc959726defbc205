"""WARC archives: written as whole gzip streams, normalised to one member a record, with an offset index.

Writing. A record is rendered by SQL expressions and Spark's text writer, whose line separator is the end
of a WARC record, writes files of them, each one gzip stream: what crawlers that know no members leave.
An archive is closed when it holds `ARCHIVE_BYTES`; a larger page has one of its own.

Normalising. Each monolithic file is inflated once, as a stream; every record becomes a gzip member of its
own, and its offset, length and record id go to a sidecar index (gzipped lines of JSON). Both are written
by Spark too, under `archive=.../kind=warc` and `archive=.../kind=index`. The last byte of a gzip member is
the highest of its size, 0 below 16 MiB; the text writer's separator supplies it (a larger record is
followed by an empty member, inside its length).

Reading. Archive and index meet by the archive's name, and records are cut out by offset. The payload's
digest is computed from what was read; a record that is not the one its index names, or whose digest is
not that of its header, fails the job.

Copies. Of records with equal payloads of at least `least` bytes the one with the smallest id is the
response, the others are revisits without a body. Smallest ids are found with partial aggregation. Digests
with many copies (the `HEAVY` most frequent, so any other has less than 1 / HEAVY of the rows) are
broadcast; the rest is an ordinary join, where rows already decided get keys of their own.

Memory: a task holds an archive, compressed, and one record inflated.

Edge cases: a null text is an empty payload, which is a payload like others. Rows with equal ids and
payloads are one record written that often: all responses, or all revisits. A null id comes last: it
is the response only of payloads that no row with an id has. Null or odd URLs: none is written, other
than printable ASCII is percent-encoded. An empty table makes no archive and no rows. Ids of any type that casts to
text and back are kept; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import column, filled, landed, mapped
from barloom.session import shared_folder

ARCHIVE_BYTES = 32 << 20
HEAVY = 1024
LEVEL = 6
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_CHUNK = 1 << 20


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four letters."""
    digest = F.sha1(data)
    parts = []
    for chunk in range(8):
        value = F.conv(F.substring(digest, 5 * chunk + 1, 5), 16, 10).cast("int")
        parts += [
            F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1))
            for shift in (15, 10, 5, 0)
        ]
    return F.concat(*parts)


def decided(pages: DataFrame, least: int = 0, *, key: str = "page_id", text: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for a response)."""
    url = column(pages, "url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(
        column(pages, key).alias("page_id"), url.cast("string").alias("url"),
        filled(column(pages, text)).cast("binary").alias("html"),
    ).select(
        "*", F.length("html").cast("long").alias("payload_bytes"), base32_sha1(F.col("html")).alias("payload_digest")
    )
    groups = landed(
        rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"),
             F.max("page_id").alias("last"), F.count("page_id").alias("ids"))
        .where((F.col("first") != F.col("last")) | (F.col("ids") < F.col("copies")) & F.col("first").isNotNull())
        .select("payload_digest", "first", "copies")
    )
    heavy = groups.orderBy(F.desc("copies"), "payload_digest").limit(HEAVY)
    heavy = heavy.select(F.col("payload_digest").alias("heavy_digest"), F.col("first").alias("heavy_first"))
    light = groups.join(F.broadcast(heavy), F.col("payload_digest") == F.col("heavy_digest"), "left_anti")
    light = light.select(F.col("payload_digest").alias("light_digest"), F.col("first").alias("light_first"))
    met = rows.join(F.broadcast(heavy), F.col("payload_digest") == F.col("heavy_digest"), "left")
    # A row already decided looks for a key that no digest has, and that differs from row to row.
    own = F.when(F.col("heavy_first").isNull(), F.col("payload_digest")).otherwise(
        F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    )
    met = met.withColumn("asked", own).join(light, F.col("asked") == F.col("light_digest"), "left")
    first = F.coalesce("heavy_first", "light_first")
    refers = F.when((first != F.col("page_id")) | F.col("page_id").isNull(), first)
    return met.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to")
    )


def _urn(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("urn:pages:id:"), F.url_encode(key.cast("string"))), F.lit("urn:pages:none"))


def rendered(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> Column:
    """A WARC record without the line ends that close it."""
    revisit = rows["refers_to"].isNotNull()
    safe = F.regexp_replace(F.url_encode(rows["url"]), "\\+", "%20")
    for code, plain in (("%3A", ":"), ("%2F", "/"), ("%3F", "?"), ("%3D", "="), ("%26", "&"), ("%23", "#")):
        safe = F.replace(safe, F.lit(code), F.lit(plain))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        rows["payload_bytes"].cast("string"), F.lit("\r\n\r\n"),
    )
    length = F.length(http) + F.when(revisit, F.lit(0)).otherwise(rows["payload_bytes"])
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <"), _urn(rows["page_id"]), F.lit(f">\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), safe), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), rows["payload_digest"],
        F.when(
            revisit,
            F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <"), _urn(rows["refers_to"]), F.lit(">")),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        length.cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(rows["html"].cast("string"))
    return F.concat(head, http, body)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/barloom/warc-{uuid.uuid4().hex}"


def write_monolithic(rows: DataFrame, path: str) -> None:
    """Archives of about `ARCHIVE_BYTES`, each file one gzip stream over all its records."""

    def named(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        part, number, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False)
            names = np.empty(len(sizes), dtype=object)
            for i, size in enumerate(sizes):
                if held and held + int(size) > ARCHIVE_BYTES:
                    number, held = number + 1, 0
                held += int(size)
                names[i] = f"a{part:06d}-{number:04d}"
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(names, pa.string())], ["value", "archive"])

    lines = mapped(rows.select(rendered(rows).alias("value")), named, "value string, archive string not null")
    lines.write.partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _inflated(data: bytes):
    """The stream's bytes, a megabyte at a time; also of several members."""
    at = 0
    while at < len(data):
        z, tail = zlib.decompressobj(31), b""
        while not z.eof:
            if not tail:
                tail = data[at : at + _CHUNK]
                at += len(tail)
                if not tail:
                    raise EOFError("a gzip stream ends early")
            yield z.decompress(tail, _CHUNK)
            tail = z.unconsumed_tail
        at -= len(z.unused_data)


def headers(record: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """The header fields of a record from `at`, by lower-case name, and where they end."""
    stop = record.index(_END, at)
    lines = record[at:stop].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, stop + 4


def split_records(chunks):
    """The records of an inflated stream, each with the line ends that close it."""
    buffer, at, whole = bytearray(), 0, None
    for chunk in chunks:
        buffer += chunk
        while True:
            if whole is None:
                if buffer.find(_END, at) < 0:
                    break
                fields, body = headers(buffer, at)
                whole = body - at + int(fields["content-length"]) + 4
            if len(buffer) - at < whole:
                break
            yield bytes(buffer[at : at + whole])
            at, whole = at + whole, None
        if at > _CHUNK:
            del buffer[:at]
            at = 0
    if at < len(buffer) or whole is not None:
        raise EOFError("a record ends early")


def member(record: bytes) -> bytes:
    """A gzip member (two for large records) whose last byte is 0."""
    out = zlib.compress(record, LEVEL, 31)
    return out if out[-1] == 0 else out + zlib.compress(b"", LEVEL, 31)


def normalise(spark: SparkSession, source: str, path: str) -> None:
    """Rewrite every archive under `source` to one member a record, beside an index of offsets."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content")):
                out, index = bytearray(), []
                for record in split_records(_inflated(content.as_py())):
                    piece = member(record)
                    fields, _ = headers(record)
                    index.append(json.dumps(
                        {"offset": len(out), "length": len(piece), "id": fields["warc-record-id"], "type": fields["warc-type"]}
                    ))
                    out += piece
                lines = member("".join(line + "\n" for line in index).encode())
                for kind, data in (("warc", bytes(out)), ("index", lines)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([data[:-1]], pa.binary()), pa.array([name.as_py()]), pa.array([kind])],
                        ["value", "archive", "kind"],
                    )

    files = _files(spark, source).select("archive", "content")
    out = mapped(files, run, "value binary, archive string not null, kind string not null")
    out = out.select(F.col("value").cast("string").alias("value"), "archive", "kind")
    out.write.partitionBy("archive", "kind").option("lineSep", "\u0000").text(path)


RECORD = (
    "archive string, offset long, length long, record_id string, record_type string, refers_to string, "
    "payload_bytes long, payload_digest string"
)


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of normalised archives, cut out by the offsets of their index."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, content, index in zip(*(batch.column(c) for c in ("archive", "content", "lines"))):
                data = memoryview(content.as_buffer())
                for line in b"".join(_inflated(index.as_py())).splitlines():
                    entry = json.loads(line)
                    cut = bytes(data[entry["offset"] : entry["offset"] + entry["length"]])
                    rows.append((name.as_py(), entry["offset"], entry["length"], *_read(b"".join(_inflated(cut)), entry)))
                    if len(rows) == 1024 or sum(len(r[-1] or b"") for r in rows[-1:]) > _CHUNK:
                        yield _batch(rows, payload)
                        rows = []
            if rows:
                yield _batch(rows, payload)

    def _batch(rows, payload):
        import pyarrow as pa

        columns = [list(c) for c in zip(*rows)]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        names = [f.split()[0] for f in RECORD.split(", ")]
        if payload:
            arrays, names = [*arrays, pa.array(columns[-1], pa.binary())], [*names, "payload"]
        return pa.RecordBatch.from_arrays(arrays, names)

    files = _files(spark, path)
    archives = files.where("kind = 'warc'").select("archive", "content")
    index = files.where("kind = 'index'").select("archive", F.col("content").alias("lines"))
    return mapped(archives.join(index, "archive"), run, RECORD + (", payload binary" if payload else ""))


def _read(record: bytes, entry: dict) -> tuple:
    """Record id, type, reference, payload size and digest, payload; checked against index and header."""
    fields, body = headers(record)
    if fields["warc-record-id"] != entry["id"]:
        raise ValueError(f"the index names {entry['id']}, the archive holds {fields['warc-record-id']}")
    http, start = headers(record, body)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "revisit":
        return entry["id"][1:-1], "revisit", fields["warc-refers-to"][1:-1], int(http["content-length"]), digest, None
    payload = record[start : body + int(fields["content-length"])]
    read = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if read != digest or len(payload) != int(http["content-length"]):
        raise ValueError(f"the payload of {entry['id']} is not the one written")
    return entry["id"][1:-1], fields["warc-type"], None, len(payload), read, payload


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def archived(pages: DataFrame, least: int = 0, *, key: str = "page_id", text: str = "html") -> str | None:
    """Write the pages as normalised archives with their index; the folder, None for an empty table."""
    spark = pages.sparkSession
    if pages.isEmpty():
        return None
    raw, path = _folder(spark), _folder(spark)
    write_monolithic(decided(pages, least, key=key, text=text), raw)
    normalise(spark, raw, path)
    dropped(spark, raw)
    return path


def _key(urn: Column, kind: T.DataType | str) -> Column:
    """The id inside a record id, in its own type."""
    coded = F.when(urn.startswith("urn:pages:id:"), F.substring(urn, len("urn:pages:id:") + 1, 1 << 30))
    return F.url_decode(coded).cast(kind)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = archived(pages)
    records = read_records(spark, path) if path else spark.createDataFrame([], RECORD)
    kind = pages.schema["page_id"].dataType
    return records.select(
        _key(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _key(F.col("refers_to"), kind).alias("refers_to"),
    )


ORACLE = {
    "op11_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
    array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
}
