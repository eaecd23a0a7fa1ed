"""WARC archives as seekable Zstandard bundles.

Tasks write their records to bundle files in the shared folder. A bundle is a row of independent Zstandard frames of
about FRAME_BYTES of records each and a seek table in a skippable frame at the end (the public seekable format). The index gives,
for each record, its bundle, the frame's offset and size, and the record's place in the unpacked frame, so that a
record is read by one seek and one frame.

Of records with equal payloads of at least ``min_bytes``, the one with the smallest page_id is a response; the others are
revisits that refer to it and carry no payload. Null payloads are empty. Rows that repeat a page_id and its payload are
each a record of that page; a null page_id is never referred to while its payload has another page. Every record has an identifier of
its own; the page stands in the target URI, and a revisit names the page and digest that it refers to, which reading resolves to
the response's record. More columns of the input are left out.

Only digests are shuffled to find equal payloads; payloads stay in place while the repeated ones are few enough for a broadcast.

Files are written by pyarrow's file systems, so the shared folder may be local, HDFS or an object store. A task that runs
twice writes two bundles, and the index knows only the one whose task succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_dir

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 25
LEVEL = 3
#: Repeated payloads, 40 bytes of digest and three numbers each, are broadcast up to this number (15 MB).
MAX_BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of the records of pages that have none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_type string, bundle string, frame_at long, frame_size long, record_at long, record_size long"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, payload, digest (hex), first (the response's page_id, or null for a response)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), payload.alias("payload"))
    rows = rows.select("page_id", "payload", F.sha1("payload").alias("digest"), F.length("payload").alias("n"))
    repeated = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    repeated = materialize(repeated)
    joined = rows.join(F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST_ROWS else repeated, ["digest", "n"], "left")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", F.when(~other, F.col("payload")).alias("payload"), "digest", F.when(other, F.col("first")).alias("first"))


def _target(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _record(page_id: int | None, payload: bytes | None, digest: str, first: int | None) -> bytes:
    body = payload or b""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {NO_DATE}", f"WARC-Target-URI: {_target(page_id)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: text/html; charset=utf-8",
    ]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_target(first)}", f"WARC-Refers-To-Date: {NO_DATE}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parse(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, bytes of the payload (0 for a revisit), digest, type and page that it refers to."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda x: int(x.removeprefix("urn:page:")) if x != "urn:page:" else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    n = int(fields["Content-Length"])
    if kind == "response" and base64.b32encode(hashlib.sha1(rest[:n]).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return number(fields["WARC-Target-URI"]), n, digest, kind, number(fields["WARC-Refers-To-Target-URI"]) if kind == "revisit" else None


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, unpacked) sizes of the frames."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Sizes of a bundle's frames from its last bytes."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i)) for i in range(n)]


def write_bundles(marked: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``mark_revisits`` and return their index, which is itself written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        out, name, frames, index = None, "", [], []
        pending, ids, at = [], [], 0

        def flush() -> None:
            nonlocal out, name, pending, ids
            if not pending:
                return
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            raw = b"".join(pending)
            packed = packer.compress(raw)
            begin, place = sum(f[0] for f in frames), 0
            for (page_id, kind), record in zip(ids, pending, strict=True):
                index.append((page_id, kind, name, begin, len(packed), place, len(record)))
                place += len(record)
            out.write(packed)
            frames.append((len(packed), len(raw)))
            pending, ids = [], []

        def close() -> None:
            nonlocal out, frames, index
            if out is not None:
                out.write(seek_table(frames))
                out.close()
            out, frames, index = None, [], []

        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string()), *[(c, pa.int64()) for c in ("frame_at", "frame_size", "record_at", "record_size")]])
        rows_of = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*index, strict=True), schema.types, strict=True)], schema=schema)
        size = total = 0
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, payload, digest, first = (batch.column(c)[k].as_py() for c in range(4))
                record = _record(page_id, payload, digest, first)
                pending.append(record)
                ids.append((page_id, "response" if first is None else "revisit"))
                size += len(record)
                if size >= FRAME_BYTES:
                    total += size
                    size = 0
                    flush()
                    if total >= BUNDLE_BYTES:
                        done = rows_of()
                        close()
                        total = 0
                        yield done
        flush()
        if index:
            done = rows_of()
            close()
            yield done

    return materialize(marked.select("page_id", "payload", "digest", "first").mapInArrow(run, INDEX))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit has the length of the response that it refers to; where ``index`` has no such response, reading fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor().decompress
        name = source = frame = None
        starts: dict[int, int] = {}
        raw = b""
        for batch in batches:
            found = []
            for bundle, frame_at, frame_size, at, size in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                if bundle != name:
                    if source:
                        source.close()
                    name, source, frame = bundle, store.open_input_file(f"{path}/{bundle}"), None
                    end = source.size()
                    source.seek(end - 9)
                    n = struct.unpack("<I", source.read(4))[0]
                    source.seek(end - 9 - 8 * n)
                    sizes, place, starts = read_seek_table(source.read()), 0, {}
                    for packed, _ in sizes:
                        starts[place] = packed
                        place += packed
                if frame_at != frame:
                    if starts.get(frame_at) != frame_size:
                        raise ValueError(f"{bundle} has no frame of {frame_size} bytes at {frame_at}")
                    source.seek(frame_at)
                    frame, raw = frame_at, unpack(source.read(frame_size))
                found.append(_parse(raw[at : at + size]))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # bundles are small, so a bundle is read by one task, frame after frame
    rows = index.repartition("bundle").sortWithinPartitions("bundle", "frame_at", "record_at")
    found = materialize(rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes")
    # one row for each response that is referred to
    named = found.where("record_type = 'response' and page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").dropDuplicates(["refers_to", "payload_digest"])
    wanted = named.join(revisits.select("refers_to", "payload_digest").distinct(), ["refers_to", "payload_digest"], "left_semi")
    known = F.coalesce("payload_bytes", F.raise_error(F.concat(F.lit("no response of page "), F.col("refers_to"))).cast("long"))
    resolved = revisits.join(wanted, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", known)
    return found.where("record_type = 'response'").unionByName(resolved)


def op7_warc(pages: DataFrame) -> DataFrame:
    folder = scratch_dir(pages.sparkSession)
    return read_records(write_bundles(mark_revisits(pages.select("page_id", "html")), folder), folder)
