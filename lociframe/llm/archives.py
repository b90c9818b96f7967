"""WARC archives: write one gzip member per record, read them back sequentially.

The writer makes archive segments as bytes; ``write_archives`` keeps them as a binary table in a folder that every
executor can reach. ``read_archives`` takes (path, content) rows, so files found with Spark's ``binaryFile`` source are read the
same way.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
# Segments are closed beyond this many compressed bytes; one record may make a longer segment.
SEGMENT_BYTES = 8 << 20
BLOCK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_FIELDS = ("path string, record_offset bigint, kind string, record_id string, target string, date string, refers_to string, "
               "declared_digest string, payload_bytes bigint, payload binary, status string")


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, target: str | None, date: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has an empty block; its payload size is kept in an extension field."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_digest(payload)}"), ("X-Payload-Length", str(size))]
    if target is not None:
        fields.append(("WARC-Target-URI", "".join(target.split())))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = VERSION + b"\r\n" + b"".join(f"{name}: {value}\r\n".encode() for name, value in fields) + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(payload) + packer.compress(END) + packer.flush()


class Framing:
    """Incremental reader of one segment: bytes of any size go in, records come out.

    Memory is bounded by one block and the record being read.
    """

    def __init__(self) -> None:
        self.buffer = bytearray()
        self.fields: dict[str, str] | None = None

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += data
        while True:
            if self.fields is None:
                cut = self.buffer.find(END)
                if cut < 0:
                    return
                lines = bytes(self.buffer[:cut]).decode("utf-8", "replace").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("no WARC version line")
                self.fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
                del self.buffer[:cut + len(END)]
            size = int(self.fields.get("content-length", ""))
            if len(self.buffer) < size + len(END):
                return
            payload = bytes(self.buffer[:size])
            if self.buffer[size:size + len(END)] != END:
                raise ValueError("content length does not end at a record boundary")
            del self.buffer[:size + len(END)]
            fields, self.fields = self.fields, None
            yield fields, payload


def read_segment(content: bytes) -> Iterator[dict]:
    """Records of one segment in order. A damaged member ends as a row with status 'damaged' and reading goes on at the next member."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpacker, framing, begun, found = zlib.decompressobj(31), Framing(), at, []
        try:
            while not unpacker.eof:
                block = view[at:at + BLOCK]
                data = unpacker.decompress(block, BLOCK)
                # Only one of the two holds what is left of the block.
                at += len(block) - len(unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail)
                if not (block or data or unpacker.eof):
                    raise ValueError("member is cut off")
                found += framing.feed(data)
            if framing.buffer or framing.fields is not None:
                raise ValueError("record is cut off")
        except (zlib.error, ValueError):
            yield {"record_offset": begun, "status": "damaged"}
            at = content.find(b"\x1f\x8b\x08", begun + 1)
            if at < 0:
                return
            continue
        for fields, payload in found:
            declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            revisit = fields.get("warc-type") == "revisit"
            block_ok = fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", base32_digest(payload))
            right = block_ok and (revisit or not declared or base32_digest(payload) == declared)
            yield {"record_offset": begun, "kind": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>"),
                   "target": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
                   "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "declared_digest": declared,
                   "payload_bytes": int(fields.get("x-payload-length", len(payload))) if revisit else len(payload), "payload": payload,
                   "status": "verified" if right else "digest_mismatch"}


def plan_records(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str | None = "url", least_bytes: int = 0) -> DataFrame:
    """(id, url, payload, digest, refers_to): of equal payloads of at least ``least_bytes`` bytes the row with the largest id is stored,
    the others refer to it. A NULL payload is empty. Rows with a NULL id are always stored; of repeated ids with one payload all are."""
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), (F.col(url_col) if url_col else F.lit(None)).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    newest = rows.groupBy("digest").agg(F.max("id").alias("newest")).withColumnRenamed("digest", "d")
    refers = F.when((F.octet_length("payload") >= least_bytes) & (F.col("id") < F.col("newest")), F.col("newest"))
    return rows.join(newest, F.col("digest") == F.col("d")).select("id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(planned: DataFrame, folder: str, prefix: str = "urn:page:") -> None:
    """Write segments as rows (path, content) of a Parquet table in ``folder``; every task packs its own rows."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            content = b"".join(members)
            members.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.gz"]), pa.array([content], pa.binary())],
                                              names=["path", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                # Any id becomes text; a NULL one has no digits.
                name = lambda key: prefix + ("" if key is None else str(key))
                revisit = row["refers_to"] is not None
                members.append(record("revisit" if revisit else "response", name(row["id"]), row["url"], date,
                                      base64.b32encode(bytes.fromhex(row["digest"])).decode(), len(row["payload"]),
                                      b"" if revisit else row["payload"], name(row["refers_to"]) if revisit else None))
                total += len(members[-1])
                if total >= SEGMENT_BYTES:
                    yield close()
                    total = 0
        if members:
            yield close()

    planned.mapInArrow(pack, "path string, content binary").write.mode("overwrite").parquet(folder)


def read_archives(segments: DataFrame) -> DataFrame:
    """Records of (path, content) rows, in the order of each segment."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_FIELDS.split(", ")]
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.split()[1]])
                            for f in READ_FIELDS.split(", ")])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for found in read_segment(content.as_py() or b""):
                    rows.append({n: found.get(n) for n in names} | {"path": path})
                    held += len(found.get("payload") or b"")
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return segments.select("path", "content").mapInArrow(read, READ_FIELDS)


def digests(records: DataFrame, id_type: str = "bigint", prefix: str = "urn:page:") -> DataFrame:
    """One row per record: the page id, sizes, digest and kind taken from what was read."""
    number = lambda c: F.nullif(F.substring(c, len(prefix) + 1, 1 << 20), F.lit("")).cast(id_type)
    return records.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("declared_digest").alias("payload_digest"),
                          F.col("kind").alias("record_type"), number(F.col("refers_to")).alias("refers_to"), "status")
