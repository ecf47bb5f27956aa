"""Codecs and chunks."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import LongType

from ..errors import Corrupt, Usage
from .sizes import parse_size


@dataclass(frozen=True)
class Codec:
    """A codec with its parameters as (low, high, default); encode and decode get them checked."""

    name: str
    params: dict[str, tuple[int, int, int | None]]
    encode: Callable[..., bytes]
    decode: Callable[..., bytes]


MAX_TRAINED = 1 << 20
LEAST_XZ_DICTIONARY = 4096


def _xz(preset: int, plain: int) -> list[dict]:
    return [{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": max(LEAST_XZ_DICTIONARY, plain), "lc": 3, "lp": 0, "pb": 2}]


def _unxz(data: bytes, size: int, dictionary: bytes | None = None) -> bytes:
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_xz(0, size))
    out = d.decompress(data, size + 1)
    if not d.eof or d.unused_data:
        raise Corrupt("the stream doesn't end with its data")
    return out


def _inflate(bits: int):
    def run(data: bytes, size: int, dictionary: bytes | None = None) -> bytes:
        d = zlib.decompressobj(bits)
        out = d.decompress(data, size + 1)
        if not d.eof or d.unused_data or d.unconsumed_tail:
            raise Corrupt("the stream doesn't end with its data")
        return out

    return run


def _deflate(bits: int):
    def run(plain: bytes, level: int = 6, **_) -> bytes:
        c = zlib.compressobj(level, zlib.DEFLATED, bits)
        return c.compress(plain) + c.flush()

    return run


def _zstd(plain: bytes, level: int = 12, long: int | None = None, dictionary: bytes | None = None, **_) -> bytes:
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if long is None:
        return zstandard.ZstdCompressor(level=level, dict_data=own).compress(plain)
    # history beyond the chunk has no effect
    log = max(10, min(long, max(1, len(plain) - 1).bit_length()))
    wide = zstandard.ZstdCompressionParameters.from_level(level, window_log=log, enable_ldm=log >= 20)
    return zstandard.ZstdCompressor(compression_params=wide, dict_data=own).compress(plain)


def _unzstd(data: bytes, size: int, dictionary: bytes | None = None) -> bytes:
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    d = zstandard.ZstdDecompressor(dict_data=own)
    return d.decompress(data, max_output_size=size, allow_extra_data=False)


#: long and train count as off where nothing is given; train is a size, or 1 for a measured one.
REGISTRY = {
    c.name: c
    for c in (
        Codec("none", {}, lambda b, **_: b, lambda b, _, dictionary=None: b),
        Codec("zstd", {"level": (1, 22, 12), "long": (10, 30, None), "train": (1, MAX_TRAINED, None)}, _zstd, _unzstd),
        Codec("gzip", {"level": (1, 9, 6)}, _deflate(31), _inflate(31)),
        Codec("flate", {"level": (1, 9, 6)}, _deflate(-15), _inflate(-15)),
        Codec("xz", {"preset": (0, 9, 6)}, lambda b, preset=6, **_: lzma.compress(b, lzma.FORMAT_RAW, filters=_xz(preset, len(b))), _unxz),
    )
}
SWITCHES = {"long": 27, "train": 1}
LEAST_TRAINED = 4096


def checked(name: str, params: dict[str, str]) -> dict[str, int]:
    """All parameters of a codec that are set, as numbers; unknown or out of range is an error,
    never clamped. ``long`` and ``train`` may be on or off, ``train`` also auto or a size."""
    if name not in REGISTRY:
        raise Usage(f"unknown codec: {name}")
    known = REGISTRY[name].params
    if unknown := sorted(set(params) - set(known)):
        raise Usage(f"unknown parameter of {name}: {', '.join(unknown)}")
    out = {k: default for k, (_, _, default) in known.items() if default is not None}
    for key, text in params.items():
        text = str(text).lower()
        if key in SWITCHES and text in ("off", "no", "false"):
            continue
        if key in SWITCHES and (text in ("on", "yes", "true") or (key, text) == ("train", "auto")):
            out[key] = SWITCHES[key]
            continue
        value = parse_size(text) if key == "train" else int(text) if text.isdigit() else None
        low, high = (LEAST_TRAINED, MAX_TRAINED) if key == "train" else known[key][:2]
        if value is None or not low <= value <= high:
            raise Usage(f"{key} of {name} must be {low} to {high}")
        out[key] = value
    return out


def level(name: str, params: dict[str, str]) -> int:
    """The checked level or preset; 0 for codecs without one."""
    out = checked(name, params)
    return out.get("level", out.get("preset", 0))


def window_beyond_chunk(name: str, params: dict[str, str], chunk: int) -> tuple[int, str] | None:
    """What the user asks for, and its name, where that is more history than a chunk has."""
    own = {k: v for k, v in checked(name, params).items() if k in params}
    if "long" in own and 1 << own["long"] > chunk:
        return 1 << own["long"], "window"
    sizes = (1 << 18, 1 << 20, 1 << 21, 1 << 22, 1 << 22, 1 << 23, 1 << 23, 1 << 24, 1 << 25, 1 << 26)
    if "preset" in own and sizes[own["preset"]] > chunk:
        return sizes[own["preset"]], "dictionary"
    return None


def encoder_memory(name: str, params: dict[str, str], chunk: int) -> int:
    """About what one encoder holds for chunks of at most ``chunk`` bytes."""
    own = checked(name, params)
    state = {"zstd": lambda: 4 * min(chunk, 1 << min(own.get("long", 23 if own["level"] > 16 else 21), 27)) + (own["level"] << 20), "xz": lambda: 12 * max(LEAST_XZ_DICTIONARY, chunk), "gzip": lambda: 1 << 19, "flate": lambda: 1 << 19}
    return 2 * chunk + (1 << 20) + state.get(name, lambda: 0)()


def encoder_slots(wanted: int, memory: int, ram: int, limit: int | None = None) -> int:
    """Encoders that run at once: what a sixteenth of the memory, or half of a limit, holds."""
    return max(1, min(wanted, (limit // 2 if limit else ram // 16) // max(1, memory)))


def encode(plain: bytes, name: str, params: dict[str, int] | int | None = None, dictionary: bytes | None = None) -> bytes:
    """Encoded, or plain where that isn't longer. ``params`` are checked ones, or a level."""
    if isinstance(params, int):
        params = {key: params for key in REGISTRY[name].params if key in ("level", "preset")}
    out = REGISTRY[name].encode(plain, **(params or {}), dictionary=dictionary)
    return out if len(out) < len(plain) else plain


def decode(data: bytes, name: str, plain_size: int, dictionary: bytes | None = None) -> bytes:
    """Exactly ``plain_size`` bytes, from one stream with nothing behind it."""
    if len(data) == plain_size:
        return data
    try:
        out = REGISTRY[name].decode(data, plain_size, dictionary=dictionary)
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, EOFError) as error:
        raise Corrupt(f"{name}: {error}") from None
    if len(out) != plain_size:
        raise Corrupt(f"{len(out)} bytes instead of {plain_size}")
    return out


def chunks(content: Column, size: int) -> Column:
    """The content cut at ``size`` bytes; none of an empty content."""
    n = F.ceil(F.octet_length(content) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(content, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def encode_chunks(table: DataFrame, name: str, params: dict[str, str] | None = None, column: str = "plain", dictionary: bytes | None = None) -> DataFrame:
    """Adds ``encoded`` and ``plain_size``, an Arrow batch at a time. A dictionary has at most
    MAX_TRAINED bytes."""
    n = checked(name, params or {})

    def run(batches):
        for rows in batches:
            yield rows.assign(encoded=[encode(bytes(b), name, n, dictionary) for b in rows[column]], plain_size=pd.Series([len(b) for b in rows[column]], dtype="int64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInPandas(run, f"{fields}, encoded binary, plain_size bigint")


def decode_chunks(table: DataFrame, name: str, dictionary: bytes | None = None) -> DataFrame:
    """Adds ``decoded`` from ``encoded`` and ``plain_size``."""

    def run(batches):
        for rows in batches:
            yield rows.assign(decoded=[decode(bytes(b), name, int(n), dictionary) for b, n in zip(rows["encoded"], rows["plain_size"])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInPandas(run, f"{fields}, decoded binary")


def recompress(table: DataFrame, old: str, new: str, params: dict[str, str] | None = None) -> DataFrame:
    """Replaces ``encoded`` by the content's encoding with another codec, chunk by chunk; all
    other columns stay."""
    columns = table.columns
    plain = decode_chunks(table, old).drop("encoded", "plain_size")
    return encode_chunks(plain, new, params, column="decoded").select(*columns)


def _castagnoli() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0x82F63B78 & -(n & 1))
        table.append(n)
    return table


_CRC = _castagnoli()


def crc32c(data: bytes) -> int:
    """Castagnoli's polynomial; Spark's crc32 is another one."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def first_difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """Offset of the first differing byte, -1 if equal; the shorter differs at its end; null
    where either is."""
    import numpy as np

    def one(x, y):
        if x is None or y is None:
            return None
        n = min(len(x), len(y))
        d = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)) if n else []
        return int(d[0]) if len(d) else -1 if len(x) == len(y) else n

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="Int64")
