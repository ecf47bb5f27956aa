"""A catalog as self-contained index files: header, zstd-compressed CBOR, trailer.

Each file holds a block of entries, so a catalog of any size is written and read by tasks. The
header is checked by CRC-32C; the trailer names the index's place, its digest, which is bound to
catalog and generation (and keyed where there are keys), and closes the file.
"""

from __future__ import annotations

import hmac
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import Corrupt
from ..functions import cbor
from ..functions.codecs import crc32c
from ..functions.sealing import Keys, index_digest
from ..operators.order import numbered

MAGIC, END, VERSION = b"SHLFIDX\n", b"SHLFEND\n", 1
#: magic, version, flags, catalog, generation, reserved; then a CRC of these.
HEADER = struct.Struct("<8sHH16sQ12s")
#: magic, offset and length of the index, its plain size, digest, entries; then a CRC of these.
TRAILER = struct.Struct("<8sQQQ32sQ")
SEALED = 1
#: Entries of a file; bytes of an index at most.
ENTRIES, MOST = 50_000, 1 << 30


class Unsupported(Corrupt):
    """A later version, an unknown flag or a reserved byte that is used."""


def header(uuid: bytes, generation: int, flags: int = 0) -> bytes:
    head = HEADER.pack(MAGIC, VERSION, flags, uuid, generation, bytes(12))
    return head + struct.pack("<I", crc32c(head))


def read_header(data: bytes) -> dict:
    size = HEADER.size
    if len(data) < size + 4 or data[:8] != MAGIC:
        raise Corrupt("not an index file")
    if struct.unpack("<I", data[size : size + 4])[0] != crc32c(data[:size]):
        raise Corrupt("the header's checksum differs")
    _, version, flags, uuid, generation, reserved = HEADER.unpack(data[:size])
    if version != VERSION or flags & ~SEALED or any(reserved):
        raise Unsupported("a later version of the format")
    return {"uuid": uuid, "generation": generation, "flags": flags, "body": size + 4}


def trailer(offset: int, length: int, plain: int, digest: bytes, entries: int) -> bytes:
    tail = TRAILER.pack(END, offset, length, plain, digest, entries)
    return tail + struct.pack("<I", crc32c(tail))


def read_trailer(data: bytes, head: dict) -> dict:
    """The trailer at the end of a file, checked against its header and the file's size."""
    size = TRAILER.size
    tail = data[len(data) - size - 4 :]
    if len(data) < head["body"] + size + 4 or tail[:8] != END:
        raise Corrupt("no trailer")
    if struct.unpack("<I", tail[size:])[0] != crc32c(tail[:size]):
        raise Corrupt("the trailer's checksum differs")
    _, offset, length, plain, digest, entries = TRAILER.unpack(tail[:size])
    if offset != head["body"] or offset + length + size + 4 != len(data) or plain > MOST:
        raise Corrupt("the trailer doesn't fit the file")
    return {"offset": offset, "length": length, "plain": plain, "digest": digest, "entries": entries}


def encode(entries: list[dict], uuid: bytes, generation: int, keys: Keys | None = None) -> bytes:
    """One file; a null field is left out."""
    plain = cbor.dumps({"entries": [{k: v for k, v in e.items() if v is not None} for e in entries]})
    index = zstandard.ZstdCompressor(level=3).compress(plain)
    head = header(uuid, generation)
    return head + index + trailer(len(head), len(index), len(plain), index_digest(keys, uuid, generation, index), len(entries))


def decode(data: bytes, keys: Keys | None = None) -> tuple[dict, list[dict]]:
    """(header, entries) of one file."""
    head = read_header(data)
    tail = read_trailer(data, head)
    index = data[tail["offset"] : tail["offset"] + tail["length"]]
    if not hmac.compare_digest(index_digest(keys, head["uuid"], head["generation"], index), tail["digest"]):
        raise Corrupt("the index's digest differs")
    try:
        plain = zstandard.ZstdDecompressor().decompress(index, max_output_size=tail["plain"], allow_extra_data=False)
    except zstandard.ZstdError as error:
        raise Corrupt(str(error)) from None
    found = cbor.loads(plain)
    entries = found.get("entries") if isinstance(found, dict) else None
    if len(plain) != tail["plain"] or not isinstance(entries, list) or len(entries) != tail["entries"]:
        raise Corrupt("the index doesn't fit its trailer")
    return head, entries


def files(rows: DataFrame, uuid: bytes, generation: int, keys: Keys | None = None) -> DataFrame:
    """(file, data): the entries in order of id, ENTRIES in a file."""
    columns = sorted(rows.columns)
    packed = numbered(rows, ["id"], "n").select(F.floor(F.col("n") / ENTRIES).alias("file"), F.struct(*columns).alias("entry"))

    def run(group: pa.Table) -> pa.Table:
        entries = sorted(group.column("entry").to_pylist(), key=lambda e: e["id"])
        return pa.table({"file": pa.array(group.column("file").to_pylist()[:1], pa.int64()), "data": pa.array([encode(entries, uuid, generation, keys)], pa.binary())})

    return packed.groupBy("file").applyInArrow(run, "file long, data binary")


def entries_of(found: DataFrame, schema: str, keys: Keys | None = None) -> DataFrame:
    """Rows of ``schema`` from files (data)."""
    kinds = to_arrow_schema(found.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield pa.RecordBatch.from_pylist(decode(data, keys)[1], schema=kinds)

    return found.select("data").mapInArrow(run, schema)
