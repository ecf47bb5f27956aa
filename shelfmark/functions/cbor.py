"""Deterministic CBOR (RFC 8949, 4.2): one encoding for each value, and no other is read.

Integers, bytes, text, lists, maps, booleans and null; lengths are definite and shortest, map
keys ascend by their encoding.
"""

from __future__ import annotations

import struct

from ..errors import Corrupt

_SIMPLE = {False: b"\xf4", True: b"\xf5", None: b"\xf6"}
#: Nested lists and maps at most.
DEPTH = 16


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for info, form, limit in ((24, ">B", 1 << 8), (25, ">H", 1 << 16), (26, ">I", 1 << 32), (27, ">Q", 1 << 64)):
        if n < limit:
            return bytes([major << 5 | info]) + struct.pack(form, n)
    raise ValueError("an integer of more than 64 bits")


def dumps(value) -> bytes:
    if value is None or isinstance(value, bool):
        return _SIMPLE[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        text = value.encode()
        return _head(3, len(text)) + text
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(dumps, value))
    if isinstance(value, dict):
        items = sorted((dumps(k), dumps(v)) for k, v in value.items())
        return _head(5, len(items)) + b"".join(k + v for k, v in items)
    raise TypeError(f"no CBOR of {type(value).__name__}")


def loads(data: bytes):
    value, end = _read(data, 0, DEPTH)
    if end != len(data):
        raise Corrupt("bytes after the value")
    return value


def _length(data: bytes, at: int, info: int) -> tuple[int, int]:
    if info < 24:
        return info, at
    if info > 27:
        raise Corrupt("an indefinite or reserved length")
    size = 1 << (info - 24)
    if at + size > len(data):
        raise Corrupt("the value is cut off")
    n = int.from_bytes(data[at : at + size], "big")
    if n < (24 if size == 1 else 1 << 4 * size):
        raise Corrupt("a length that isn't the shortest")
    return n, at + size


def _read(data: bytes, at: int, depth: int):
    if at >= len(data):
        raise Corrupt("the value is cut off")
    major, info = data[at] >> 5, data[at] & 31
    if major == 7:
        for value, code in _SIMPLE.items():
            if data[at] == code[0]:
                return value, at + 1
        raise Corrupt("a value of another kind")
    n, at = _length(data, at + 1, info)
    if major < 2:
        return (n if major == 0 else -1 - n), at
    if major < 4:
        if at + n > len(data):
            raise Corrupt("the value is cut off")
        part = bytes(data[at : at + n])
        try:
            return (part if major == 2 else part.decode()), at + n
        except UnicodeDecodeError:
            raise Corrupt("text that isn't UTF-8") from None
    if major == 6 or not depth:
        raise Corrupt("a tag, or too deep")
    if n > len(data) - at:
        raise Corrupt("the value is cut off")
    if major == 4:
        out = []
        for _ in range(n):
            value, at = _read(data, at, depth - 1)
            out.append(value)
        return out, at
    found, last = {}, b""
    for _ in range(n):
        begin = at
        key, at = _read(data, at, depth - 1)
        if bytes(data[begin:at]) <= last:
            raise Corrupt("map keys out of order")
        last = bytes(data[begin:at])
        found[key], at = _read(data, at, depth - 1)
    return found, at
