"""WARC archives written and read as chunk rows (operator 2).

A payload never passes through a task as one value: the pages table is turned
into rows (record, chunk number, at most ``CHUNK`` bytes), which the writer
appends to a gzip member per record while it carries the digest along; the
reader streams an archive back into the same kind of rows, each with the SHA-1
of the payload so far, so its last chunk row has the digest of the whole.

Archives hold WARC/1.1 records: ``response`` with an HTTP header before the
payload, or ``revisit`` (identical-payload-digest) without a block. They lie in
one folder that all executors share, and roll at ``ARCHIVE_BYTES``. A task
names its files by its attempt and reports them in a manifest, which is the
commit record: files of attempts that failed are never read.

Which record is the response: of rows with equal payloads of at least
``least_bytes`` bytes that with the largest page id; the others revisit it.
Smaller payloads are responses all.

Defined results: a null payload is empty; a null url has no target header;
control characters in a url are percent-encoded. Repeated rows (same id and
payload) are the same record written as often as it occurs, all of one type. A
row with a null id revisits the response of its group, or is a response if the
group has no id. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import cut, shared_folder, table

CHUNK = 1 << 16
ARCHIVE_BYTES = 1 << 28
DATE = "1970-01-01T00:00:00Z"   # the pages have no fetch date of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_ROWS = "record_id string, page_key string, record_type string, refers_to_record string, target_uri string, " \
             "chunk_no bigint, start bigint, data binary, sha1_so_far string, last boolean"


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def chunk_table(pages: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str,
                least_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a record to be written, a record's rows in order."""
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = given.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("sha1", F.sha1("payload"))
    # written out, so that the size is known when the join is planned: the payloads
    # are shuffled only if the groups of equal ones are too many to be sent around
    keyed.where(F.col("size") >= least_bytes).groupBy("sha1", "size") \
        .agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1") \
        .write.parquet(f"{folder}/equal")
    equal = pages.sparkSession.read.parquet(f"{folder}/equal").select("sha1", "size", "response")
    rows = keyed.join(equal, ["sha1", "size"], "left") \
        .withColumn("revisit", F.coalesce(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")),
                                          F.lit(False)))
    chunks = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk)))
    body = F.when(F.col("revisit"), F.lit(b"")).otherwise(
        F.substring("payload", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)))
    return rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), (chunks - 1).cast("bigint")))) \
        .select(F.col("page_id").cast("string").alias("page_key"), "url", "size", "sha1", "revisit",
                F.col("response").cast("string").alias("response"), "chunk_no", body.alias("data"))


def _record_id(page: str | None, sha1: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{_base32(sha1)}>"


def _head(page, url, size, sha1, revisit, response) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: {_record_id(page, sha1)}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{_base32(sha1)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page is not None:
        lines.append(f"Page-ID: {page}")
    if revisit:
        lines += [f"WARC-Refers-To: {_record_id(response, sha1)}", f"WARC-Profile: {PROFILE}", "Content-Length: 0"]
        http = ""
    else:
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + size}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        task, made = TaskContext.get(), []
        out = packer = digest = None
        left = 0

        for batch in batches:
            for page, url, size, sha1, revisit, response, n, data in zip(*(c for c in map(_cells, batch.columns))):
                if n == 0:
                    if out is None or made[-1][2] >= archive_bytes:
                        if out is not None:
                            out.close()
                        made.append([f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made)}.warc.gz", 0, 0])
                        out = store.open_output_stream(f"{root}/{made[-1][0]}", compression=None)
                    packer, digest = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1()
                    left = 0 if revisit else size
                    made[-1][1] += 1
                    made[-1][2] += out.write(packer.compress(_head(page, url, size, sha1, revisit, response)))
                made[-1][2] += out.write(packer.compress(data))
                digest.update(data)
                left -= len(data)
                if left == 0:
                    if not revisit and digest.hexdigest() != sha1:
                        raise ValueError(f"page {page}: chunks do not make up the payload")
                    made[-1][2] += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["archive", "records", "bytes"])
    return write


def _cells(column: pa.Array) -> Iterator:
    return (x.as_py() for x in column)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as archives into ``folder`` (of a store that pyarrow can
    open on every executor); returns the manifest (archive, records, bytes)."""
    spark = pages.sparkSession
    rows = chunk_table(pages, folder, id_col, url_col, payload_col, least_bytes)
    _make_folder(folder)
    rows.mapInArrow(_writer(folder, archive_bytes), "archive string, records bigint, bytes bigint") \
        .write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _make_folder(folder: str) -> None:
    from pyarrow import fs
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)


class _Members:
    """Reads the gzip members of an archive as one stream, a little at a time."""

    def __init__(self, stream):
        self.stream, self.packed, self.plain, self.member = stream, b"", bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.stream.read(CHUNK)
            if not self.packed:
                return False
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        self.plain += self.member.decompress(self.packed, CHUNK)
        self.packed = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.plain.find(mark)) < 0:
            if not self._more():
                if self.plain:
                    raise ValueError("archive ends within a record")
                return None
        found = bytes(self.plain[:at])
        del self.plain[:at + len(mark)]
        return found

    def take(self, most: int) -> bytes:
        while len(self.plain) < most and self._more():
            pass
        found = bytes(self.plain[:most])
        if len(found) < most:
            raise ValueError("archive ends within a record")
        del self.plain[:most]
        return found


def _records(stream, chunk: int) -> Iterator[tuple]:
    members = _Members(stream)
    while (head := members.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        left, digest, n, start = int(fields["Content-Length"]), hashlib.sha1(), 0, 0
        if fields.get("Content-Type", "").startswith("application/http"):
            left -= len(members.until(b"\r\n\r\n")) + 4
        stored = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = fields["WARC-Type"] == "revisit"
        while True:
            data = members.take(min(chunk, left))
            digest.update(data)
            left -= len(data)
            if not left and not revisit and _base32(digest.hexdigest()) != stored:
                raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its digest")
            so_far = stored if revisit else _base32(digest.hexdigest())
            yield (fields["WARC-Record-ID"], fields.get("Page-ID"), fields["WARC-Type"], fields.get("WARC-Refers-To"),
                   fields.get("WARC-Target-URI"), n, start, data, so_far, not left)
            n, start = n + 1, start + len(data)
            if not left:
                break
        if members.take(4) != b"\r\n\r\n":
            raise ValueError(f"{fields['WARC-Record-ID']}: no end of record")


def _reader(folder: str, chunk: int):
    names = [f.split()[0] for f in CHUNK_ROWS.split(", ")]
    kinds = pa.schema([(n, pa.binary() if n == "data" else pa.bool_() if n == "last" else
                        pa.int64() if n in ("chunk_no", "start") else pa.string()) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    for row in _records(stream, chunk):
                        held.append(row)
                        size += len(row[7])
                        if size >= 64 * CHUNK or len(held) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), kinds)], schema=kinds)
    return read


def read_chunks(manifest: DataFrame, folder: str, archives: int, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives in the manifest, one archive a task."""
    return manifest.select("archive").repartitionByRange(max(1, archives), "archive") \
        .mapInArrow(_reader(folder, chunk), CHUNK_ROWS)


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record, from its last chunk: id, size and digest of the payload
    (a revisit has those of the record it refers to), type, reference."""
    last = cut(read_chunks(manifest, folder, manifest.count()).where("last").select(
        "record_id", "page_key", "record_type", "refers_to_record", "target_uri",
        (F.col("start") + F.octet_length("data")).alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest")))
    response = last.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.max("page_key").alias("refers_to_key"), F.max("payload_bytes").alias("full_bytes"))
    revisits = last.where("record_type = 'revisit'").join(response, "refers_to_record", "left")
    return last.where("record_type = 'response'").withColumn("refers_to_key", F.lit(None).cast("string")) \
        .unionByName(revisits.withColumn("payload_bytes", F.col("full_bytes")).drop("full_bytes"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    manifest = write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_records(manifest, folder).select(
        F.col("page_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_key").cast(kind).alias("refers_to"), "record_id", "target_uri")
