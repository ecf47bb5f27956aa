import struct

import pytest

from shelfmark.errors import Corrupt
from shelfmark.functions import cbor
from shelfmark.functions.codecs import crc32c
from shelfmark.functions.sealing import Keys
from shelfmark.plans import portable


@pytest.mark.parametrize("value, code", [
    (0, "00"), (23, "17"), (24, "1818"), (1000, "1903e8"), (1000000, "1a000f4240"), (18446744073709551615, "1bffffffffffffffff"), (-1, "20"), (-1000, "3903e7"), (False, "f4"), (True, "f5"), (None, "f6"),
    (b"\x01\x02\x03\x04", "4401020304"), ("", "60"), ("IETF", "6449455446"), ("ü", "62c3bc"), ([1, [2, 3], [4, 5]], "8301820203820405"), ({"a": 1, "b": [2, 3]}, "a26161016162820203"), ({}, "a0"),
])
def test_cbor(value, code):
    assert cbor.dumps(value).hex() == code and cbor.loads(bytes.fromhex(code)) == value


@pytest.mark.parametrize("code", ["", "18", "1817", "190017", "1b00000000ffffffff", "5f42010243030405ff", "a2616201616101", "a2616101616102", "c11a514b67b0", "62c328", "0000", "f7", "fb3ff199999999999a", "9affffffff", "81" * 20 + "00"])
def test_other_cbor_is_refused(code):
    with pytest.raises(Corrupt):
        cbor.loads(bytes.fromhex(code))


def test_files(spark, monkeypatch):
    monkeypatch.setattr(portable, "ENTRIES", 40)
    schema = "id long, path string, xattrs binary, chunks array<bigint>, dead boolean, size long"
    rows = spark.createDataFrame([(i, f"p/{i}é", bytearray([i % 256]) if i % 3 else None, [i, 2**40] if i % 2 else None, i % 5 == 0, None if i % 7 else i) for i in range(1, 101)], schema).repartition(4)
    for keys in (None, Keys(bytes(range(32)), bytes(16))):
        found = portable.files(rows, b"u" * 16, 3, keys)
        assert found.count() == 3
        got = portable.entries_of(found, schema, keys)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    assert portable.files(rows.limit(0), b"u" * 16, 3).count() == 0


def test_damaged_files_are_refused():
    keys = Keys(bytes(range(32)), bytes(16))
    data = portable.encode([{"id": 1, "path": "a"}], b"u" * 16, 3, keys)
    head, entries = portable.decode(data, keys)
    assert entries == [{"id": 1, "path": "a"}] and (head["uuid"], head["generation"]) == (b"u" * 16, 3)
    for at in range(len(data)):
        with pytest.raises(Corrupt):
            portable.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], keys)
    for bad in (data[:-1], data + b"\0", b"", data[: portable.HEADER.size]):
        with pytest.raises(Corrupt):
            portable.decode(bad, keys)
    with pytest.raises(Corrupt):
        portable.decode(data, None)
    later = bytearray(data[: portable.HEADER.size])
    later[8] = 9
    with pytest.raises(portable.Unsupported):
        portable.read_header(bytes(later) + struct.pack("<I", crc32c(bytes(later))))
