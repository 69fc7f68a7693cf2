"""12. WARC archives: one gzip member for each record, read sequentially and verified.

Written: each page is a record of a WARC 1.1 file, a gzip member of its own; of pages with equal payloads the one with
the largest id is a response, the others revisit it and hold HTTP headers only. Tasks write files of their own names
into a folder that all machines share, and a table of the files, which Spark commits, says which count: what a lost or
repeated attempt has left isn't in it. Read: a task streams an archive in chunks of 64 KiB through zlib, frames each
record by its Content-Length, takes its digests as the bytes pass and checks them, the member's end and both lengths;
a record that doesn't agree raises ``Damaged``. Only a payload that is asked for is held whole.

The folder's store must be one that ``pyarrow.fs`` reaches (local or mounted paths, s3, gs, abfs, hdfs).

Cases: null texts count as empty; null page ids are kept and stand below all others; rows that repeat the largest id of
a payload are told apart by nothing and are all responses; null addresses are ``about:blank``, and what can't stand in
a header is percent-encoded; payloads of any length, chunk by chunk; an empty table gives no archive and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shared_dir, small, written

CHUNK = 1 << 16
#: Bytes of an archive after which a task begins another.
ARCHIVE_BYTES = 1 << 28
#: The time of all records: pages carry none.
DATE = "1970-01-01T00:00:00Z"

_RECORDS = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


class Damaged(ValueError):
    """An archive isn't what its frames, lengths and digests say."""


def _store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([first, *[f"{k}: {v}" for k, v in fields], "", ""]).encode()


def _urn(page_id: str | None, payload_digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else quote(page_id, safe='')}:{payload_digest}>"


def _page_of(urn: str) -> str | None:
    return unquote(urn.split(":")[2]) or None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None = None, revisits: bool = False) -> bytes:
    """A page's WARC record, before compression."""
    told = digest(payload)
    block = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + (b"" if revisits else payload)
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if revisits else _urn(page_id, told)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha1:{told}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    fields += [("Page-ID", quote(page_id, safe=""))] if page_id is not None else []
    if revisits:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to, told))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header("WARC/1.1", fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Compressed:
    """An archive's bytes in chunks; what a member leaves over is given back."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.over = stream, b""

    def take(self) -> bytes:
        data, self.over = self.over or self.stream.read(CHUNK), b""
        return data


class _Member:
    """One gzip member, unpacked as it is asked for and never by more than a chunk at once."""

    def __init__(self, source: _Compressed):
        self.source, self.decoder, self.held = source, zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """The next bytes; none at the member's end."""
        while not self.decoder.eof:
            given = self.decoder.unconsumed_tail or self.source.take()
            try:
                out = self.decoder.decompress(given, CHUNK)
            except zlib.error as e:
                raise Damaged(f"a member can't be unpacked: {e}") from e
            if self.decoder.eof:
                self.source.over = self.decoder.unused_data
            if out:
                return out
            if not given and not self.decoder.eof:
                raise Damaged("the archive ends inside a record")
        return b""

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes up to and with ``mark``."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most or not (data := self.more()):
                raise Damaged("a header without end")
            self.held += data
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def exactly(self, size: int) -> Iterator[bytes]:
        """``size`` bytes, in parts."""
        while size:
            data = self.held or self.more()
            if not data:
                raise Damaged("a record is shorter than its length")
            part, self.held = data[:size], data[size:]
            size -= len(part)
            yield part


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _length(fields: dict[str, str]) -> int:
    if not fields.get("content-length", "").isdigit():
        raise Damaged("a record without length")
    return int(fields["content-length"])


def records(stream: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive, one after the other, each checked before it is given out."""
    source = _Compressed(stream)
    while data := source.take():
        source.over = data
        m = _Member(source)
        head = m.until(b"\r\n\r\n", 1 << 20)
        if not head.startswith(b"WARC/1."):
            raise Damaged("a member that is no WARC record")
        fields = _fields(head)
        block, payload, http, kept, size = hashlib.sha1(), hashlib.sha1(), b"", [], 0
        inside = fields.get("warc-type") not in ("response", "revisit")  # others have no HTTP headers
        for part in m.exactly(_length(fields)):
            block.update(part)
            if not inside:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                inside, part, http = True, http[at + 4 :], http[: at + 4]
            payload.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
        if m.held + b"".join(iter(m.more, b"")) != b"\r\n\r\n":
            raise Damaged("a record that goes on beyond its length")
        told = lambda h: f"sha1:{base64.b32encode(h.digest()).decode()}"
        if fields.get("warc-block-digest", told(block)) != told(block):
            raise Damaged(f"the block of {fields.get('warc-record-id')} has another digest")
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        stated = _length(_fields(http))
        if kind == "response" and (fields.get("warc-payload-digest", told(payload)), stated) != (told(payload), size):
            raise Damaged(f"the payload of {fields.get('warc-record-id')} has another digest or length")
        page = unquote(fields["page-id"]) if "page-id" in fields else None
        refers = _page_of(fields["warc-refers-to"]) if kind == "revisit" else None
        out = {"page_id": page, "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": stated, "payload_digest": fields.get("warc-payload-digest", told(payload)).removeprefix("sha1:"), "refers_to": refers}
        yield out | ({"payload": b"".join(kept)} if payloads else {})


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to, revisits`` of pages (``page_id, url, html``).

    Payloads are equal if their SHA-256 is. The largest ids of those that occur again are a table: it is broadcast where
    it is small, and beyond that joined by the digest, where adaptive execution splits what many pages share.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("_key", F.sha2("payload", 256))
    again = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("_key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    both = keyed.join(small(written(again, "copies")), "_key", "left")
    revisits = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return both.select(F.col("page_id").cast("string").alias("page_id"), "url", F.col("payload").cast("binary").alias("payload"), F.col("refers_to").cast("string").alias("refers_to"), revisits.alias("revisits"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archives below ``folder``; returns the stored table of those that count: ``path, records, bytes``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0

        def told() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to, revisits = (c[i].as_py() for c in batch.columns)
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(page_id, url, payload, refers_to, revisits))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield told()
                    out = None
        if out is not None:
            yield told()

    return written(marked(pages, least_bytes).mapInArrow(write, "path string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives (``path``), each archive streamed by one task; with ``payloads`` their bytes too."""
    schema = _RECORDS + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = _store(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for row in records(stream, payloads):
                        rows.append(row)
                        held += row["payload_bytes"]
                        if len(rows) >= 4096 or payloads and held >= 1 << 22:
                            yield _batch(rows, names)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, names)

    n = archives.count()
    return archives.select("path").repartitionByRange(max(n, 1), "path").mapInArrow(read, schema)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names)


def broken_revisits(found: DataFrame) -> DataFrame:
    """Revisits whose response isn't among the records, or has another payload."""
    kept = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return found.where("record_type = 'revisit'").join(kept, ["refers_to", "payload_digest"], "left_anti")


def warc_report(pages: DataFrame) -> DataFrame:
    """One row for each page, read back from the archives that are written first."""
    archives = write_archives(pages, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}")
    kind = dict(pages.dtypes)["page_id"]
    back = read_archives(archives)
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
