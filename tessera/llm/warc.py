"""Web archives as .warc.zst: a dictionary in the leading skippable frame, then one frame per record.

The writer gives each partition archives of its own, of bounded size, in a folder that all
executors share; the reader takes a dictionary from the leading frame of an archive, decodes frame by
frame and checks each record's header, length and digest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import qualified, scratch, table_of, text_slices

# fixed values of the formats
SKIPPABLE_DICTIONARY = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
MIN_REVISIT = 100
LEVEL = 3


def roles(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``pages`` as (page_id, url, html, digest, n, refers_to); refers_to is null for responses.

    Equal payloads are found by their SHA-256. Only digests that occur with two or more page_ids
    are joined back, so what meets the pages is (digest, smallest page_id) of those; a group of
    very many copies is rows of the pages' side, which AQE may split.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("html"),
                         F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    least = (keyed.where(F.col("n") >= min_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("least"), F.max("page_id").alias("most"), F.count(F.lit(1)).alias("rows"),
                  F.count("page_id").alias("ids"))
             .where("least < most or (ids > 0 and ids < rows)").select("digest", "least"))
    first = F.col("page_id").eqNullSafe(F.col("least"))
    return keyed.join(least, "digest", "left").select(
        "page_id", "url", "html", "digest", "n", F.when(F.col("least").isNotNull() & ~first, F.col("least")).alias("refers_to"))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: header lines, an empty line, the block, two empty lines."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    # a page's fields may hold anything: percent-encode what would break a header line
    target = "".join(c if c > " " and c != "\x7f" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [VERSION, f"WARC-Type: {kind}",
            f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{url}/{digest}'.encode()).digest()[:16])}>",
            f"WARC-Target-URI: {target}", "X-Page-ID: " + ("" if page_id is None else str(page_id)),
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BadArchive(ValueError):
    """An archive or record that breaks the format."""


def parse_record(data: bytes) -> dict:
    """The fields of a record, with its headers, length and digest checked."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0].decode("latin-1") != VERSION:
        raise BadArchive(f"not a {VERSION} record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b": ")
        if not colon or name.lower() in fields:
            raise BadArchive(f"bad header line {line[:80]!r}")
        fields[name.lower().decode()] = value.decode()
    try:
        kind, length = fields["warc-type"], int(fields["content-length"])
        size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
        page, refers = (int(x) if x else None for x in (fields["x-page-id"], fields.get("x-refers-to-page-id")))
        fields["warc-record-id"], fields["warc-target-uri"]
    except (KeyError, ValueError) as e:
        raise BadArchive(f"header {e} is missing or no number") from e
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {length}, but {len(rest) - 4} bytes follow the header")
    block = rest[:length]
    if kind == "response":
        if refers is not None or size != length or hashlib.sha256(block).hexdigest() != digest:
            raise BadArchive("a response whose payload isn't what its header says")
    elif kind != "revisit" or refers is None or length:
        raise BadArchive(f"a record of type {kind} that is neither response nor revisit")
    return {"page_id": page, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": refers, "payload": block}


def write_archive(out, records: list[bytes]) -> None:
    """The leading dictionary frame, then a frame per record. ``out`` is a binary file."""
    import zstandard
    sample, held = [], 0
    for r in records:
        if held >= SAMPLE_BYTES:
            break
        sample.append(r)
        held += len(r)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few or too small records to train on
        trained = b"".join(sample)[:DICTIONARY_BYTES] or VERSION.encode()
    out.write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(trained)) + trained)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained),
                                      write_checksum=True, write_content_size=True)
    for r in records:
        out.write(packer.compress(r))


def read_archive(src) -> Iterator[bytes]:
    """The records of an archive, one per frame; ``src`` is a binary file."""
    import zstandard
    head = src.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != SKIPPABLE_DICTIONARY:
        raise BadArchive("no dictionary in a leading skippable frame")
    size = struct.unpack("<II", head)[1]
    trained = src.read(size)
    if len(trained) != size:
        raise BadArchive("the leading frame ends early")
    if trained.startswith(FRAME_MAGIC):  # the dictionary may itself be compressed
        trained = zstandard.ZstdDecompressor().decompress(trained)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    data = b""
    while True:
        if not data:
            data = src.read(1 << 20)
            if not data:
                return
        frame = unpacker.decompressobj()
        parts = []
        while not frame.eof:
            if not data:
                data = src.read(1 << 20)
                if not data:
                    raise BadArchive("the last frame ends early")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``path``, a folder all executors share.

    Returns the manifest (path, records), made as the archives are written. A null html is empty, a
    null url or page_id is left empty in the header; repeated rows are records of their own, and
    those that carry the smallest page_id of a payload are all responses. A file gets its name
    only when it is whole, so a lost task leaves nothing that a reader would take.
    """
    where = qualified(pages.sparkSession, path).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)

        def flush(records):
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}.part", compression=None) as out:
                write_archive(out, records)
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{where}/{name}"]), pa.array([len(records)], pa.int64())],
                                              ["path", "records"])

        held, size = [], 0
        for b in text_slices(batches, "html"):
            for row in b.to_pylist():
                r = record_bytes(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"])
                if held and size + len(r) > archive_bytes:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield flush(held)
    return roles(pages).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "path string, records long")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives of a manifest, checked; with their blocks if ``payload``."""
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")] + ["payload"] * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        schema = pa.schema([schema.field(n) for n in names])
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                found, held, size = 0, [], 0
                with store.open_input_stream(name, compression=None) as src:
                    for data in read_archive(src):
                        held.append(parse_record(data))
                        found += 1
                        size += len(data)
                        if len(held) >= 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in held], schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in held], schema)
                if found != records:
                    raise BadArchive(f"{path} holds {found} records; {records} were written")
    return manifest.mapInArrow(read, READ_SCHEMA + ", payload binary" * payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """The records read back from archives of ``pages`` in the shared folder; one row per page row."""
    spark = pages.sparkSession
    manifest = table_of(write_archives(pages, scratch(spark, "warc")), "manifest")
    return read_archives(manifest.repartition(max(1, spark.sparkContext.defaultParallelism * 4)))
