"""Keys, sealed content and keyed digests.

A random data key belongs to a catalog; a passphrase only wraps it, so a change of passphrase
rewrites the header and no content. Subkeys come from the data key by HKDF, one for each purpose.
Each entry has a key of its own, an HMAC of its id, so a chunk's position is a nonce that never
repeats under a key. Key material reaches executors as a one-row table, never as literals of a
plan or as settings. scrypt stands for the memory-hard function and AES-GCM for the cipher, for
want of others here; the wrapped key is masked and tagged under a key that its random salt makes
single-use.
"""

from __future__ import annotations

import getpass
import hashlib
import hmac
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corrupt, Usage

KEY, SALT, UUID = 32, 16, 16
#: scrypt's block size and lanes; log2 of its cost: default, least and most.
BLOCK, LANES, COST, LEAST_COST, MOST_COST = 8, 1, 15, 10, 24
CONTEXT = b"shelfmark/1/"


class WrongPassphrase(Usage):
    """The passphrase doesn't open the header."""


def memory_of(cost: int) -> int:
    return 128 * BLOCK << cost


def check_affordable(cost: int, ram: int) -> None:
    """Refuses a key derivation that takes more than half of the memory, before any passphrase
    is asked for."""
    if not LEAST_COST <= cost <= MOST_COST:
        raise Usage(f"cost must be {LEAST_COST} to {MOST_COST}")
    if memory_of(cost) > ram // 2:
        raise Usage(f"the key derivation needs {memory_of(cost)} bytes, more than half of {ram}")


def hkdf(key: bytes, info: bytes, salt: bytes = b"", length: int = KEY) -> bytes:
    root = hmac.digest(salt or bytes(32), key, "sha256")
    out, block = b"", b""
    for i in range(1, -(-length // 32) + 1):
        block = hmac.digest(root, block + info + bytes([i]), "sha256")
        out += block
    return out[:length]


@dataclass(frozen=True)
class Header:
    """What is stored of the keys: nothing secret."""

    uuid: bytes
    salt: bytes
    cost: int
    wrapped: bytes


@dataclass(frozen=True)
class Keys:
    data_key: bytes = field(repr=False)
    uuid: bytes

    def sub(self, purpose: str, extra: bytes = b"") -> bytes:
        return hkdf(self.data_key, CONTEXT + purpose.encode() + b"\x00" + self.uuid + extra)

    def wrap(self, passphrase: bytes, cost: int = COST) -> Header:
        salt = os.urandom(SALT)
        kek = _kek(passphrase, salt, cost)
        masked = bytes(a ^ b for a, b in zip(self.data_key, hkdf(kek, CONTEXT + b"mask" + self.uuid)))
        return Header(self.uuid, salt, cost, masked + _tag(kek, self.uuid, masked))


def _kek(passphrase: bytes, salt: bytes, cost: int) -> bytes:
    if not passphrase:
        raise Usage("the passphrase is empty")
    return hashlib.scrypt(passphrase, salt=salt, n=1 << cost, r=BLOCK, p=LANES, maxmem=2 * memory_of(cost) + (1 << 20), dklen=KEY)


def _tag(kek: bytes, uuid: bytes, masked: bytes) -> bytes:
    return hmac.digest(hkdf(kek, CONTEXT + b"tag" + uuid), masked, "sha256")


def new_keys() -> Keys:
    return Keys(os.urandom(KEY), os.urandom(UUID))


def unlock(header: Header, passphrase: bytes) -> Keys:
    kek = _kek(passphrase, header.salt, header.cost)
    masked, tag = header.wrapped[:KEY], header.wrapped[KEY:]
    if not hmac.compare_digest(tag, _tag(kek, header.uuid, masked)):
        raise WrongPassphrase("wrong passphrase")
    return Keys(bytes(a ^ b for a, b in zip(masked, hkdf(kek, CONTEXT + b"mask" + header.uuid))), header.uuid)


def change_passphrase(header: Header, old: bytes, new: bytes, cost: int | None = None) -> Header:
    """Another wrapping of the same data key: sealed content stays as it is."""
    return unlock(header, old).wrap(new, cost or header.cost)


def passphrase(file: str | None = None, variable: str | None = None, env: Mapping[str, str] = os.environ, ask: Callable[[str], str] = getpass.getpass, twice: bool = False, warn: Callable[[str], None] = lambda text: None) -> bytes:
    """From a file's first line, else a variable (with a warning), else asked for."""
    if file:
        with open(file, "rb") as f:
            text = f.readline().rstrip(b"\r\n")
        if not text:
            raise Usage(f"{file}: the first line is empty")
        return text
    if variable:
        if not env.get(variable):
            raise Usage(f"{variable} isn't set")
        warn(f"the passphrase in {variable} can be seen by other processes of this user")
        return env[variable].encode()
    text = ask("Passphrase: ")
    if twice and ask("Again: ") != text:
        raise Usage("the passphrases differ")
    if not text:
        raise Usage("the passphrase is empty")
    return text.encode()


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = key.ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def with_pads(rows: DataFrame, **keys: bytes) -> DataFrame:
    """Adds HMAC pads of 32-byte keys as columns ``<name>_in`` and ``<name>_out``: one row, sent along."""
    flat = [pad for key in keys.values() for pad in _pads(key)]
    names = [f"{name}_{side}" for name in keys for side in ("in", "out")]
    one = rows.sparkSession.createDataFrame([tuple(map(bytearray, flat))], ", ".join(f"{n} binary" for n in names))
    return rows.crossJoin(F.broadcast(one))


def mac(name: str, message: Column) -> Column:
    """HMAC-SHA-256 under the pads that ``with_pads`` added; binary."""
    inner = F.unhex(F.sha2(F.concat(F.col(f"{name}_in"), message), 256))
    return F.unhex(F.sha2(F.concat(F.col(f"{name}_out"), inner), 256))


def _nonce(position: Column) -> Column:
    return F.unhex(F.lpad(F.hex(position.cast("long")), 24, "0"))


def _bound(name: Column, position: Column, final: Column) -> Column:
    return F.concat_ws(":", name.cast("string"), position.cast("string"), F.when(final, "last").otherwise("more"))


def seal(chunks: DataFrame, keys: Keys, column: str = "plain") -> DataFrame:
    """chunks (id, pos, final, and the column) with ``sealed``: AES-GCM under the entry's key,
    bound to entry, position and whether it is the last, so chunks can't be cut or moved."""
    rows = with_pads(chunks, entry=keys.sub("entry"))
    key = mac("entry", F.col("id").cast("string").cast("binary"))
    sealed = F.aes_encrypt(F.col(column), key, F.lit("GCM"), F.lit("DEFAULT"), _nonce(F.col("pos")), _bound(F.col("id"), F.col("pos"), F.col("final")))
    return rows.withColumn("sealed", sealed).select(*chunks.columns, "sealed")


def unseal(chunks: DataFrame, keys: Keys) -> DataFrame:
    """chunks (id, pos, final, sealed) with ``opened``, null where the seal doesn't hold."""
    rows = with_pads(chunks, entry=keys.sub("entry"))
    key = mac("entry", F.col("id").cast("string").cast("binary"))
    opened = F.try_aes_decrypt(F.col("sealed"), key, F.lit("GCM"), F.lit("DEFAULT"), _bound(F.col("id"), F.col("pos"), F.col("final")))
    return rows.withColumn("opened", opened).select(*chunks.columns, "opened")


def keyed_digests(content: DataFrame, keys: Keys, column: str = "bytes") -> DataFrame:
    """Adds ``keyed``: a digest that tells nothing about the content without the key."""
    rows = with_pads(content, content=keys.sub("content"))
    return rows.withColumn("keyed", F.lower(F.hex(mac("content", F.col(column).cast("binary"))))).select(*content.columns, "keyed")


def encrypted(rows: DataFrame, content: DataFrame, keys: Keys, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(catalog with keyed digests, sealed chunks) of a catalog and the content (id, bytes) of its
    owners.

    The first pass checks each owner's recorded digest and gives the keyed one; the second seals.
    What is sealed carries the digest that the first pass saw, so nothing unchecked is sealed;
    entries that share content take their owner's digest.
    """
    from .codecs import chunks

    recorded = rows.select(F.col("id"), F.col("digest").alias("recorded"))
    first = keyed_digests(content, keys).withColumn("raw", F.sha2("bytes", 256)).join(recorded, "id", "left")
    bad = first.filter(~F.col("raw").eqNullSafe(F.col("recorded"))).select("id").orderBy("id").first()
    if bad:
        raise Corrupt(f"entry {bad['id']}: content fails its digest")
    passed = first.select(F.col("id").alias("owner"), "keyed")
    named = rows.withColumn("owner", F.coalesce("data", "id")).join(passed, "owner", "left")
    named = named.withColumn("digest", F.when(F.col("digest").isNotNull(), F.col("keyed"))).drop("owner", "keyed")
    cut = content.join(recorded, "id").filter(F.sha2("bytes", 256) == F.col("recorded"))
    cut = cut.select("id", F.size(chunks(F.col("bytes"), chunk)).alias("n"), F.posexplode(chunks(F.col("bytes"), chunk)).alias("pos", "plain"))
    return named, seal(cut.withColumn("final", F.col("pos") == F.col("n") - 1), keys).drop("plain", "n")


def seal_index(spark: SparkSession, index: bytes, keys: Keys, generation: int) -> bytes:
    """The index under a key of its generation, with a random nonce."""
    number = generation.to_bytes(8, "little")
    one = spark.createDataFrame([(bytearray(index), bytearray(keys.sub("index", number)), bytearray(os.urandom(12)))], "index binary, key binary, nonce binary")
    return bytes(one.select(F.aes_encrypt("index", "key", F.lit("GCM"), F.lit("DEFAULT"), F.col("nonce"), F.lit(str(generation))).alias("s")).first()["s"])


def open_index(spark: SparkSession, sealed: bytes, keys: Keys, generation: int) -> bytes:
    one = spark.createDataFrame([(bytearray(sealed), bytearray(keys.sub("index", generation.to_bytes(8, "little"))))], "sealed binary, key binary")
    out = one.select(F.try_aes_decrypt("sealed", "key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(str(generation))).alias("o")).first()["o"]
    if out is None:
        raise Corrupt(f"the index isn't that of generation {generation}")
    return bytes(out)


def index_digest(keys: Keys | None, uuid: bytes, generation: int, index: bytes) -> bytes:
    """Binds the index to its catalog and generation; keyed where there is a key."""
    message = uuid + generation.to_bytes(8, "little") + index
    return hmac.digest(keys.sub("index-auth"), message, "sha256") if keys else hashlib.sha256(message).digest()
