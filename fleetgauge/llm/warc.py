"""Web archives from page tables: monolithic gzip writing, normalising and reading back.

Pages are written as WARC records into archives that are one gzip stream each. The normaliser
inflates such a stream once, front to back, rewrites every record as a gzip member of its own and
puts the members' offsets into an index beside the archive, so that any record can then be read
without the ones before it. Archives live in the shared folder; Spark moves rows about them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import attach, stored
from fleetgauge.sources.scratch import fresh_path

BLOCK = 1 << 20
_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64())])
_INDEX = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]
)
_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id, url, payload: bytes, sha1: str, record_type: str, refers_to, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response which holds it."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if record_type == "response":
        block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        block = http + b"\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if record_type == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(refers_to)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated:
    """A gzip file read once from its start; several members count as one stream."""

    def __init__(self, file):
        self._file, self._inflate, self._held, self._over = file, zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        while not self._over:
            raw = self._inflate.unconsumed_tail or self._inflate.unused_data or self._file.read(BLOCK)
            if self._inflate.eof:
                self._inflate = zlib.decompressobj(31)
            if not raw:
                self._over = True
                break
            out = self._inflate.decompress(raw, BLOCK)
            if out:
                self._held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to and with the mark, or None at the end."""
        seen = 0
        while (at := self._held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self._held)
            if not self._more():
                if self._held.strip():
                    raise ValueError("the stream ends inside a record")
                return None
        found, self._held = self._held[: at + len(mark)], self._held[at + len(mark) :]
        return found

    def take(self, count: int) -> Iterator[bytes]:
        """The next ``count`` bytes in blocks."""
        while count:
            if not self._held and not self._more():
                raise ValueError("the stream ends inside a record")
            part, self._held = self._held[:count], self._held[count:]
            count -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise(source, target, level: int) -> Iterator[tuple[int, int, str]]:
    """Rewrites one stream member by member; gives (offset, length, record id) of each."""
    stream, offset = Inflated(source), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        named = fields(head.lstrip(b"\r\n"))
        member, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for part in (head.lstrip(b"\r\n"), *stream.take(int(named["content-length"]) + 4)):
            out = member.compress(part)
            length += len(out)
            target.write(out)
        out = member.flush()
        length += len(out)
        target.write(out)
        yield offset, length, named.get("warc-record-id", "")
        offset += length


def write_monolithic(pages: DataFrame, folder: str, per_archive: int, level: int, date: str) -> DataFrame:
    """Archives of about ``per_archive`` payload bytes, each one gzip stream; a row per archive.

    ``pages``: page_id, url, payload, sha1, record_type, refers_to. A file name is never used twice, so
    a repeated task leaves an archive that no row names.
    """

    def write(batches):
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        file, name, packer, held, count = None, "", None, 0, 0
        done = []

        def close():
            nonlocal file, held, count
            if file is not None:
                file.write(packer.flush())
                file.close()
                done.append((name, count))
            file, held, count = None, 0, 0

        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    file = system.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = row["payload"].encode()
                made = record(
                    row["page_id"], row["url"], payload, row["sha1"], row["record_type"], row["refers_to"], date
                )
                file.write(packer.compress(made))
                held += len(made)
                count += 1
                if held >= per_archive:
                    close()
        close()
        yield _rows(_MANIFEST, done)

    return pages.select("page_id", "url", "payload", "sha1", "record_type", "refers_to").mapInArrow(
        write, _ddl(_MANIFEST)
    )


def normalise_archives(archives: DataFrame, folder: str, level: int) -> DataFrame:
    """Every archive of the column ``archive``, rewritten with a member per record; the index rows.

    The index also lies beside each new archive as JSON lines.
    """

    def rewrite(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = _place(archive)
                out_system, base = _place(folder)
                out_system.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                found = []
                with (
                    system.open_input_stream(path, compression=None, buffer_size=0) as source,
                    out_system.open_output_stream(f"{base}/{name}", compression=None) as target,
                    out_system.open_output_stream(f"{base}/{name}.index.jsonl", compression=None) as index,
                ):
                    for offset, length, record_id in normalise(source, target, level):
                        line = {"offset": offset, "length": length, "record": record_id}
                        index.write(json.dumps(line).encode() + b"\n")
                        found.append((f"{folder}/{name}", offset, length, record_id))
                        if len(found) >= 10_000:
                            yield _rows(_INDEX, found)
                            found = []
                yield _rows(_INDEX, found)

    return archives.select("archive").mapInArrow(rewrite, _ddl(_INDEX))


def read_records(index: DataFrame) -> DataFrame:
    """Each indexed record by its range alone: page, type, reference, payload length and digest.

    The digest of a response is taken from the payload read; a revisit has that of its header and no
    payload of its own.
    """

    def read(batches):
        opened, file = "", None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["archive"] != opened:
                    system, path = _place(row["archive"])
                    file, opened = system.open_input_file(path), row["archive"]
                raw = zlib.decompress(file.read_at(row["length"], row["offset"]), 31)
                head, _, rest = raw.partition(b"\r\n\r\n")
                named = fields(head)
                block = rest[: int(named["content-length"])]
                kind = named["warc-type"]
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                else:
                    coded = named["warc-payload-digest"].partition(":")[2]
                    size, digest = None, base64.b32decode(coded).hex()
                found.append(
                    (_page(named["warc-record-id"]), kind, _page(named.get("warc-refers-to")), size, digest)
                )
            yield _rows(_READ, found)

    return index.mapInArrow(read, _ddl(_READ))


def _revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Marks each page as response or revisit. Only digests are grouped; pages move once, salted."""
    held = F.when(F.col("bytes") >= least_bytes, F.col("page_id"))
    groups = (
        pages.filter(F.col("bytes") >= least_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
        .select("sha1", "_largest")
    )
    marked = attach(pages, groups, "sha1", "page_id")
    revisit: Column = held.isNotNull() & (F.col("page_id") < F.col("_largest"))
    return marked.withColumns(
        {
            "record_type": F.when(revisit, "revisit").otherwise("response"),
            "refers_to": F.when(revisit, F.col("_largest")),
        }
    ).drop("_largest")


def warc_round_trip(
    pages: DataFrame,
    least_bytes: int = 1000,
    per_archive: int = 16 << 20,
    level: int = 6,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per page, normalises the archives, and reads every record back.

    Returns per record page_id, payload_bytes, payload_digest (SHA-1, hex), record_type, refers_to.
    Of equal payloads of at least ``least_bytes``, the largest page_id is the response; rows that share
    this page_id, and rows whose page_id is null, are responses too. A null html is an empty payload.
    Repeated rows are records of their own. Columns other than page_id, url and html are not read; a
    table without rows gives no rows.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("bytes"),
        F.sha1(payload.cast("binary")).alias("sha1"),
    )
    whole, by_record = fresh_path(spark, "warc-whole"), fresh_path(spark, "warc-records")
    archives = stored(write_monolithic(_revisits(rows, least_bytes), whole, per_archive, level, date), "warc-manifest")
    files = max(1, archives.count())
    index = stored(normalise_archives(archives.repartition(files, "archive"), by_record, level), "warc-index")
    by_range = index.repartition(files, "archive").sortWithinPartitions("archive", "offset")
    records = stored(read_records(by_range), "warc-records")
    # Several rows may share the page_id that a revisit names, so its payload tells which is meant.
    named = F.struct("page_id", "payload_digest").alias("_of")
    sizes = (
        records.filter("record_type = 'response' and page_id is not null")
        .select(named, F.col("payload_bytes").alias("_bytes"))
        .dropDuplicates(["_of"])
    )
    revisits = records.filter("record_type = 'revisit'").withColumn("_of", F.struct(F.col("refers_to").alias("page_id"), "payload_digest"))
    sizes = sizes.join(revisits.select("_of").distinct(), "_of", "left_semi")
    revisits = attach(revisits, sizes, "_of", "page_id")
    answers = records.filter("record_type = 'response'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return answers.select(columns).unionByName(
        revisits.withColumn("payload_bytes", F.col("_bytes")).select(columns)
    )
