"""WARC archives as a table of chunks.

Writing: a payload is cut, in the JVM and before it reaches Python, into rows
of a record's identity and a chunk number. A task streams the chunks of its
records into archives of one gzip member a record, and returns a row a file:
the manifest. Reading: a task inflates an archive as a stream and turns every
record into rows of at most ``CHUNK`` payload bytes, each with the number of
bytes and the SHA-256 of the payload up to and including it. So neither side
ever holds a whole record, and a record's length and digest stand in its last
chunk: no grouping is needed.

Of payloads that are equal and have ``LEAST_REVISIT`` bytes or more, the row
with the smallest id is written as a response, the others as revisits, which
hold no payload but name the response, the payload's digest and, in their HTTP
header, its length.

Retried or repeated tasks write files of their own; only files in the manifest,
which Spark commits, count.

Edge cases:

* a null payload counts as empty; an empty payload is one chunk of no bytes;
* a null id is larger than all others; payloads of null ids alone are all responses;
* rows of one id and one payload are each a record (of the same record id), all
  of the kind the id has; rows of one id with different payloads differ in record id;
* a null URL is left out of the header; control characters and spaces in one are percent-encoded;
* a record that an archive ends within has no last chunk, so it is a row of
  :func:`read_chunks` but not of :func:`read_records`; anything else that is no WARC record is an error;
* no rows make no archives, and reading no archives gives no rows;
* other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limber.llm.common import text_of, written
from limber.session import own_folder

#: Bytes of payload in a row.
CHUNK = 256 * 1024
#: An archive is closed when it has so many bytes; a record is not split over archives.
ROLL = 1 << 30
#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 100
LEVEL = 5
#: Bytes of payload that a reading task hands on at once, about.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
#: A header line may have so many bytes.
LINE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, n_records long, n_bytes long"
CHUNKS = (
    "archive string, record_no long, record_id string, record_type string, target_uri string, page_id string, refers_to string,"
    " http_length long, declared_digest string, chunk_no long, data binary, bytes_so_far long, sha256_so_far string, last boolean"
)


def marked_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload (UTF-8), payload_bytes, payload_digest, record_type and refers_to (the response's id, for revisits).

    Only digests that occur twice or more are joined back. They are written
    first, so that the join has an exchange of its own on both sides and a
    digest that a third of all pages share can be split.
    """
    payload = F.encode(text_of(payload_col), "UTF-8")
    thin = pages.select(F.col(id_col).alias("page_id"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    groups = thin.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = written(groups.where("n > 1").select("payload_digest", "first_id"), "repeated")
    keyed = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(repeated, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def chunked(marked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a chunk, those of a record one after the other; revisits are one row without bytes."""
    held: Column = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    last_no = F.greatest(F.ceil(F.octet_length("held") / F.lit(chunk)) - 1, F.lit(0).cast("long"))
    rows = marked.withColumn("held", held).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last_no)).alias("chunk_no"), last_no.alias("last_no"))
    return rows.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"), "chunk_no",
        (F.col("chunk_no") == F.col("last_no")).alias("last"), F.substring("held", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)).alias("data"),
    )


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}:{page_id}')}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def _header(row: dict, date: str) -> bytes:
    """The record's header and the HTTP header that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["page_id"], row["payload_digest"])), ("WARC-Date", date)]
    if row["url"]:
        fields.append(("WARC-Target-URI", _uri(row["url"])))
    fields.append(("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"))
    if row["page_id"] is not None:
        fields.append(("Page-ID", _uri(row["page_id"])))
    if revisit:
        fields += [("WARC-Refers-To", record_id(row["refers_to"], row["payload_digest"])), ("Refers-To-Page-ID", _uri(row["refers_to"])), ("WARC-Profile", PROFILE)]
    length = len(http) + (0 if revisit else row["payload_bytes"])
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(length))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + http


def _written(batches: Iterator[pa.RecordBatch], directory: str, roll: int, date: str) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(directory)
    out, name, n_records = None, "", 0

    def done() -> pa.RecordBatch:
        n_bytes = out.tell()
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{directory}/{name}"]), pa.array([n_records]), pa.array([n_bytes])], names=["archive", "n_records", "n_bytes"])

    for batch in batches:
        data = batch.column("data")
        for i, row in enumerate(batch.drop_columns(["data"]).to_pylist()):
            if row["chunk_no"] == 0:
                if out is not None and out.tell() >= roll:
                    yield done()
                    out = None
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, n_records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(member.compress(_header(row, date)))
            out.write(member.compress(data[i].as_buffer()))
            if row["last"]:
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                n_records += 1
    if out is not None:
        yield done()


def write_archives(marked: DataFrame, directory: str, chunk: int = CHUNK, roll: int = ROLL) -> DataFrame:
    """Write the rows of :func:`marked_pages` as archives under ``directory``; returns the manifest: archive, n_records, n_bytes."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return written(chunked(marked, chunk).mapInArrow(lambda it: _written(it, directory, roll, date), MANIFEST), "manifest")


def archive_files(spark: SparkSession, directory: str, glob: str = "*.warc*") -> DataFrame:
    """The archives of a folder, as :func:`read_chunks` takes them; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory).select(F.col("path").alias("archive"))


def _fields(source: io.BufferedIOBase, most: int | None = None) -> tuple[dict[str, str], int, bool]:
    """Header fields up to an empty line (names in lower case, the first of a name), the bytes read, and whether the empty line came."""
    found, n, name = {}, 0, None
    while most is None or n < most:
        line = source.readline(LINE if most is None else min(LINE, most - n))
        n += len(line)
        if line in (b"\r\n", b"\n"):
            return found, n, True
        if not line:
            break
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            found[name] += " " + text.strip()
            continue
        key, _, value = text.partition(":")
        name = key.strip().lower()
        found.setdefault(name, value.strip())
    return found, n, False


def records_of(source: io.BufferedIOBase, chunk: int) -> Iterator[tuple]:
    """The rows of an archive's records, from record_no on, as CHUNKS has them."""
    number = -1
    while line := source.readline(LINE):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        number += 1
        head, _, whole = _fields(source)
        if not whole:
            return
        left = int(head["content-length"])
        http, length = {}, None
        if head.get("content-type", "").startswith("application/http"):
            first = source.readline(min(LINE, left)) if left else b""
            http, n, _ = _fields(source, left - len(first))
            left -= len(first) + n
            length = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
        own = (number, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("page-id"), head.get("refers-to-page-id"), length, head.get("warc-payload-digest"))
        digest, seen, no = hashlib.sha256(), 0, 0
        while True:
            data = source.read(min(chunk, left)) if left else b""
            cut = len(data) < min(chunk, left)
            digest.update(data)
            seen, left = seen + len(data), left - len(data)
            yield (*own, no, data, seen, digest.hexdigest(), not left)
            if cut or not left:
                break
            no += 1
        if cut:
            return


def _read(batches: Iterator[pa.RecordBatch], chunk: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    names = re.findall(r"(\w+) (?:string|long|binary|boolean)", CHUNKS)
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[re.search(rf"\b{n} (\w+)", CHUNKS)[1]]) for n in names])
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        rows.clear()
        return out

    for given in batches:
        for archive in given.column("archive").to_pylist():
            store, path = fs.FileSystem.from_uri(archive)
            with store.open_input_stream(path, compression=None) as raw:
                magic = raw.read(2)
            held = 0
            with store.open_input_stream(path, compression=None) as raw:
                source = gzip.GzipFile(fileobj=raw) if magic == b"\x1f\x8b" else io.BufferedReader(raw)
                try:
                    for row in records_of(source, chunk):
                        if not with_data:
                            if not row[-1]:
                                continue
                            row = (*row[:9], None, *row[10:])
                        rows.append((archive, *row))
                        held += len(row[9] or b"")
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield batch()
                            held = 0
                except EOFError:  # the archive ends within a gzip member: what came before it stands
                    pass
    if rows:
        yield batch()


def read_chunks(files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of all records of the archives (column archive), an archive a task at a time.

    Columns: archive, record_no, record_id, record_type, target_uri, page_id,
    refers_to, http_length, declared_digest, chunk_no, data, bytes_so_far,
    sha256_so_far, last. Without data the last chunk of each record alone is a row.
    """
    archives = files.select("archive")
    return archives.repartition(max(1, archives.count())).mapInArrow(lambda it: _read(it, chunk, with_data), CHUNKS)


def read_records(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a whole record: record_id, record_type, target_uri, page_id, refers_to, payload_bytes, payload_digest, intact.

    For a revisit, length and digest are those of the payload it refers to, as
    its header has them. ``intact`` tells whether a stored payload has the
    SHA-256 its header declares; null where it declares none.
    """
    last = read_chunks(files, chunk, with_data=False).where("last")
    declared = F.regexp_extract("declared_digest", "(?i)^sha-?256:([0-9a-f]{64})$", 1)
    declared = F.when(declared != "", F.lower(declared))
    revisit = F.col("record_type") == "revisit"
    return last.select(
        "archive", "record_no", "record_id", "record_type", "target_uri", "page_id", "refers_to",
        F.when(revisit, F.col("http_length")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("sha256_so_far")).alias("payload_digest"),
        F.when(~revisit, declared == F.col("sha256_so_far")).alias("intact"),
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder."""
    return f"{own_folder(spark)}/warc-{uuid.uuid4().hex}"


def warc_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages as archives and read these back: the id, payload_bytes, payload_digest, record_type, refers_to and intact."""
    kind = pages.schema[id_col].dataType.simpleString()
    manifest = write_archives(marked_pages(pages, id_col, url_col, payload_col), archive_folder(pages.sparkSession))
    return read_records(manifest).select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact"
    )
