"""A catalog with its content: create, append, update, delete, compact, recompress, verify, extract.

Content lies in tables of stored chunks (id, pos, stored, plain_size), one for each generation
that adds any; the manifest names them, the codecs and, once encrypted, the key header. Files are
read, encoded, sealed, decoded and written by tasks, a chunk at a time. Trained dictionaries are
a table of their own.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corrupt, Usage
from ..functions import codecs as C
from ..functions import dictionaries as D
from ..functions import paths as P
from ..functions import sealing as K
from ..operators import catalog as O
from ..operators.metadata import storable
from ..operators.order import next_id, numbered, running_total
from ..schema import ENTRY
from ..sources import tree as T
from .store import Store

CHUNK = 4 << 20
STORED = "id long, pos int, stored binary, plain_size long"


FIRST_DICTIONARY = 1 << 15


def _facts(header: K.Header) -> dict:
    return {"uuid": header.uuid.hex(), "salt": header.salt.hex(), "cost": header.cost, "wrapped": header.wrapped.hex()}


class Archive:
    """``passphrase`` opens an encrypted one."""

    def __init__(self, spark: SparkSession, path: str, passphrase: bytes | None = None):
        self.spark, self.store = spark, Store(spark, path)
        self.keys = K.unlock(self.header(), passphrase) if passphrase else None

    # what is there

    def rows(self) -> DataFrame:
        return self.store.read()

    def codecs(self) -> list[dict]:
        return self.store.manifest().get("codecs", [])

    def codec_table(self) -> DataFrame:
        rows = [(i, c["name"], c["params"]) for i, c in enumerate(self.codecs())]
        return self.spark.createDataFrame(rows, "pos int, name string, params map<string,string>")

    def header(self) -> K.Header:
        facts = self.store.manifest().get("header")
        if not facts:
            raise Usage("the catalog isn't encrypted")
        return K.Header(bytes.fromhex(facts["uuid"]), bytes.fromhex(facts["salt"]), facts["cost"], bytes.fromhex(facts["wrapped"]))

    def _sealed(self) -> bool:
        return self.store.latest() > 0 and "header" in self.store.manifest()

    def _key(self) -> bytes | None:
        """The key of content digests, of an encrypted catalog."""
        if self._sealed() and not self.keys:
            raise Usage("the catalog is encrypted, and no passphrase was given")
        return self.keys.sub("content") if self.keys and self._sealed() else None

    def stored(self) -> DataFrame:
        """Stored chunks of all owners, tombstones included; ``stored`` is null where a seal
        doesn't hold."""
        paths = self.store.manifest().get("content", [])
        if not paths:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(STORED).parquet(*[f"{self.store.path}/{p}" for p in paths])
        return self._opened(rows) if self._key() else rows

    def _opened(self, rows: DataFrame) -> DataFrame:
        last = self.rows().select("id", (F.size("chunks") - 1).alias("last"))
        marked = rows.join(last, "id").withColumn("final", F.col("pos") == F.col("last")).withColumnRenamed("stored", "sealed")
        return K.unseal(marked, self.keys).select("id", "pos", F.col("opened").alias("stored"), "plain_size")

    def dictionaries(self) -> DataFrame:
        schema = "id int, gen int, size long, digest string, bytes binary"
        paths = self.store.manifest().get("dictionaries", []) if self.store.latest() else []
        return self.spark.read.schema(schema).parquet(*[f"{self.store.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def plain(self, owners: DataFrame) -> DataFrame:
        """(id, pos, plain) of owners (id, codec): chunks decoded by the codec of each; null where
        a chunk is damaged."""
        known = self.codecs()
        # dictionaries that codecs name: at most MAX_DICTS of MAX_TRAINED bytes
        used = {c["dict"] for c in known if "dict" in c}
        dicts = {r["id"]: D.checked(bytes(r["bytes"]), r["id"], r["size"], r["digest"]) for r in self.dictionaries().filter(F.col("id").isin(list(used))).collect()} if used else {}
        codecs = [(c["name"], dicts.get(c.get("dict"))) for c in known]

        def run(batches):
            for rows in batches:
                out = []
                for data, size, codec in zip(rows["stored"], rows["plain_size"], rows["codec"]):
                    try:
                        name, dictionary = codecs[codec] if codec >= 0 else ("none", None)
                        out.append(None if data is None else C.decode(bytes(data), name, int(size), dictionary))
                    except Corrupt:
                        out.append(None)
                yield pd.DataFrame({"id": rows["id"], "pos": rows["pos"], "plain": out})

        return self.stored().join(owners.select("id", "codec"), "id").select("id", "pos", "stored", "plain_size", "codec").mapInPandas(run, "id long, pos int, plain binary")

    # what changes it

    def create(self, seen: DataFrame, top: str, spec: str = "zstd", params: dict[str, str] | None = None, chunk: int = CHUNK, dedup: bool = True) -> int:
        """The first generation, of a listed tree below ``top``."""
        return self._add(seen, top, {"name": spec, "params": params or {}}, chunk, dedup, None, None)

    def append(self, seen: DataFrame, top: str, policy: str = "replace", update: str | None = None, spec: str = "zstd", params: dict[str, str] | None = None, chunk: int = CHUNK, dedup: bool = True) -> int:
        """A further generation; what changes nothing commits nothing. Entries that are replaced
        become tombstones with the same commit."""
        return self._add(seen, top, {"name": spec, "params": params or {}}, chunk, dedup, policy, update)

    def _add(self, seen, top, codec, chunk, dedup, policy, update) -> int:
        last = self.store.latest()
        params = C.checked(codec["name"], codec["params"])
        key = self._key()
        if key:
            seen = T.digested(seen.drop("digest"), top, key=key)
        seen = T.first_seen(seen).filter(storable(F.col("type"), F.col("link")) == "store").withColumn("path", P.store_path(F.col("path")))
        old = self.rows() if last else self.spark.createDataFrame([], ENTRY)
        plan = O.merge_plan(seen, old, policy or "replace", update)
        new = plan.filter(F.col("action").isin("add", "replace"))
        if last and new.isEmpty():
            return last
        new = self._kept(numbered(new.select("old_id", *seen.columns), ["seq"], "n").withColumn("id", F.col("n") + next_id(old)), "new")
        facts = self.store.manifest() if last else {}
        known, dicts, dictionary = facts.get("codecs", []), facts.get("dictionaries", []), None
        if "train" in params:
            found, dictionary = self._dictionary(new, top, params, last + 1)
            codec = codec | ({"dict": dictionary[0]} if dictionary else {})
            dicts = [*dicts, found] if found else dicts
            dictionary = dictionary[1] if dictionary else None
        if codec["name"] != "none" and codec not in known:
            known = [*known, codec]
        rows = self._shared(O.first_names(new), old, dedup)
        own = rows.filter("type = 'reg' and data is null and size > 0")
        content = f"content/{last + 1:08d}-{uuid.uuid4().hex}"
        pieces = T.pieces(own, top, chunk)
        if codec["name"] == "none":
            encoded = pieces.select("id", "pos", F.col("plain").alias("stored"), F.octet_length("plain").cast("long").alias("plain_size"))
        else:
            encoded = C.encode_chunks(pieces, codec["name"], codec["params"], dictionary=dictionary).select("id", "pos", F.col("encoded").alias("stored"), "plain_size")
        if key:
            ends = own.select("id", (F.ceil(F.col("size") / chunk) - 1).alias("last"))
            encoded = self._seal(encoded.join(ends, "id"))
        written = self._write(encoded, content)
        rows = self._laid_out(rows, written, chunk, known.index(codec) if codec in known else -1, old)
        rows = rows.withColumn("gen", F.lit(last + 1).cast("long")).withColumn("dead", F.lit(False))
        gone = new.filter("old_id is not null").select(F.col("old_id").alias("id"), F.lit(True).alias("gone"))
        marked = old.join(gone, "id", "left").withColumn("dead", F.col("dead") | F.coalesce("gone", F.lit(False))).drop("gone")
        both = marked.select(*ENTRY.names).unionByName(self._typed(rows))
        return self.store.commit(both, last, **(facts | {"content": [*facts.get("content", []), content], "codecs": known, "dictionaries": dicts}))

    def _seal(self, chunks: DataFrame) -> DataFrame:
        """Stored chunks, with ``last``, sealed."""
        marked = chunks.withColumn("final", F.col("pos") == F.col("last"))
        return K.seal(marked, self.keys, "stored").select("id", "pos", F.col("sealed").alias("stored"), "plain_size")

    def _write(self, chunks: DataFrame, content: str) -> DataFrame:
        chunks.write.parquet(f"{self.store.path}/{content}")
        return self.spark.read.schema(STORED).parquet(f"{self.store.path}/{content}")

    def _dictionary(self, new: DataFrame, top: str, params: dict[str, int], generation: int):
        """(path of a table with a new dictionary or None, (id, bytes) or None): the newest one is
        used again; else one is trained from the new files."""
        held = D.newest(self.dictionaries()).collect()
        if held:
            return None, (held[0]["id"], D.checked(bytes(held[0]["bytes"]), held[0]["id"], held[0]["size"], held[0]["digest"]))
        number = FIRST_DICTIONARY + generation
        found = D.trained(self.spark, T.heads(new, top, D.SAMPLE), number, params["train"], params["level"])
        if not found:
            return None, None
        path = f"dictionaries/{generation:08d}-{uuid.uuid4().hex}"
        row = [(number, generation, len(found), hashlib.sha256(found).hexdigest(), bytearray(found))]
        self.spark.createDataFrame(row, "id int, gen int, size long, digest string, bytes binary").write.parquet(f"{self.store.path}/{path}")
        return path, (number, found)

    def _shared(self, new: DataFrame, old: DataFrame, dedup: bool) -> DataFrame:
        """Second names become hard links; equal content points to its first owner."""
        second = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("id")) & (F.col("type") == "reg")
        rows = new.withColumn("hardlink", F.when(second, F.col("first_id"))).withColumn("type", F.when(second, "hardlink").otherwise(F.col("type")))
        rows = rows.withColumn("size", F.when(F.col("type") == "reg", F.col("size")).otherwise(F.lit(0)).cast("long")).withColumn("digest", F.when(F.col("type") == "reg", F.col("digest")))
        if not dedup:
            return rows.withColumn("data", F.lit(None).cast("long"))
        owners = old.filter("type = 'reg' and data is null and size > 0").select("id", "digest", "size").unionByName(rows.filter("type = 'reg' and size > 0").select("id", "digest", "size"))
        first = owners.groupBy("digest", "size").agg(F.min("id").alias("owner"))
        joined = rows.join(first, ["digest", "size"], "left")
        return joined.withColumn("data", F.when((F.col("type") == "reg") & (F.col("owner") != F.col("id")), F.col("owner"))).drop("owner")

    def _laid_out(self, rows: DataFrame, written: DataFrame, chunk: int, codec: int, old: DataFrame) -> DataFrame:
        """Adds codec, chunk, chunks, len and off: stored bytes follow each other in order of id."""
        sizes = written.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.octet_length("stored").cast("long").alias("n")))).alias("c"))
        sizes = sizes.select("id", F.transform("c", lambda c: c["n"]).alias("chunks"))
        out = rows.join(sizes, "id", "left")
        own = (F.col("type") == "reg") & F.col("data").isNull()
        out = out.withColumn("len", F.when(own, F.aggregate(F.coalesce("chunks", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x)))
        out = out.withColumn("codec", F.when(own & (F.col("size") > 0), F.lit(codec)).otherwise(-1)).withColumn("chunk", F.when(own & (F.col("size") > 0), F.lit(chunk).cast("long")))
        end = old.agg(F.coalesce(F.max(F.col("off") + F.col("len")), F.lit(0))).first()[0]
        placed = running_total(out, ["id"], F.col("len"), "before")
        return placed.withColumn("off", F.when(F.col("len") > 0, F.col("before") + end)).drop("before")

    def _typed(self, rows: DataFrame) -> DataFrame:
        have = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY.fields])

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """Written once, so ids don't change when a task is run again."""
        path = f"{self.store.path}/work/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def delete(self, patterns: list[str] = (), expressions: list[str] = ()) -> int:
        facts, last = self.store.manifest(), self.store.latest()
        return self.store.commit(O.tombstone(self.rows(), patterns, expressions), last, **facts)

    def compact(self, spec: str | None = None, params: dict[str, str] | None = None) -> int:
        """Drops what no live entry needs and writes the rest anew, codecs renumbered; with a
        ``spec`` every kept content is encoded again."""
        last = self.store.latest()
        rows = O.kept(self.rows())
        owners = rows.filter("len > 0").select("id", "codec")
        content = f"content/{last + 1:08d}-{uuid.uuid4().hex}"
        if spec:
            codec = {"name": spec, "params": params or {}}
            C.checked(spec, codec["params"])
            known = [] if spec == "none" else [codec]
            plain = self.plain(owners)
            if not plain.filter("plain is null").isEmpty():
                raise Corrupt("a chunk can't be decoded")
            moved = C.encode_chunks(plain, spec, codec["params"]).select("id", "pos", F.col("encoded").alias("stored"), "plain_size")
            rows = rows.withColumn("codec", F.when(F.col("len") > 0, F.lit(len(known) - 1)).otherwise(-1))
        else:
            old = self.codecs()
            table = self.spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(old)], "pos int, codec string")
            new = O.renumbered(table, rows).orderBy("new_pos").collect()
            known = [old[r["pos"]] for r in new]  # dictionaries that no codec names any more go
            place = F.create_map(*[F.lit(x) for r in new for x in (r["pos"], r["new_pos"])]) if new else None
            rows = rows.withColumn("codec", F.coalesce(F.element_at(place, F.col("codec")), F.lit(-1))) if new else rows
            moved = self.stored().join(owners.select("id"), "id", "left_semi")
        if self._key():
            ends = moved.groupBy("id").agg(F.max("pos").alias("last"))
            moved = self._seal(moved.join(ends, "id"))
        written = self._write(moved, content)
        sizes = written.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.octet_length("stored").cast("long").alias("n")))).alias("c"))
        rows = rows.drop("chunks", "off").join(sizes.select("id", F.transform("c", lambda c: c["n"]).alias("chunks")), "id", "left")
        rows = rows.withColumn("len", F.when(F.col("len").isNotNull(), F.aggregate(F.coalesce("chunks", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x)))
        rows = running_total(rows, ["id"], F.col("len"), "before").withColumn("off", F.when(F.col("len") > 0, F.col("before"))).drop("before")
        facts = self.store.manifest()
        return self.store.commit(self._typed(rows), last, **(facts | {"content": [content], "codecs": known, "dictionaries": facts.get("dictionaries", []) if any("dict" in c for c in known) else []}))

    def encrypt(self, passphrase: bytes, cost: int = K.COST) -> int:
        """Seals what ``compact`` would keep. The first pass decodes every content, checks its
        digest and gives the keyed one, and a digest of each stored chunk; the second seals the
        chunks, and only those that still are what the first pass saw."""
        if self._sealed():
            raise Usage("the catalog is encrypted already")
        last, facts = self.store.latest(), self.store.manifest()
        keys = K.new_keys()
        rows = O.kept(self.rows())
        owners = rows.filter("type = 'reg' and data is null").select("id", "codec", "digest", "size")
        stored = self.stored().join(owners.filter("size > 0").select("id"), "id", "left_semi")
        checked = self._kept(stored.select("id", "pos", F.sha2("stored", 256).alias("raw")), "checked")
        plain = self.plain(owners)
        found = self._digests(plain).join(self._digests(plain, keys.sub("content")).withColumnRenamed("actual", "keyed"), "id")
        empty = hmac.digest(keys.sub("content"), b"", "sha256").hex()
        named = self._kept(owners.join(found, "id", "left").select(F.col("id").alias("owner"), "digest", "size", "actual", F.when(F.col("size") == 0, empty).otherwise(F.col("keyed")).alias("keyed")), "named")
        bad = named.filter((F.col("size") > 0) & ~F.col("actual").eqNullSafe(F.col("digest"))).orderBy("owner").first()
        if bad:
            raise Corrupt(f"entry {bad['owner']}: content fails its digest")
        same = stored.join(checked, ["id", "pos"]).filter(F.sha2("stored", 256) == F.col("raw")).drop("raw")
        self.keys = keys
        content = f"content/{last + 1:08d}-{uuid.uuid4().hex}"
        ends = rows.select("id", (F.size("chunks") - 1).alias("last"))
        written = self._write(self._seal(same.join(ends, "id")), content)
        if written.count() != checked.count():
            raise Corrupt("content changed between the passes")
        rows = rows.withColumn("owner", F.coalesce("data", "id")).join(named.select("owner", "keyed"), "owner", "left").withColumn("digest", F.when(F.col("digest").isNotNull(), F.col("keyed")))
        sizes = written.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", F.octet_length("stored").cast("long").alias("n")))).alias("c"))
        rows = rows.drop("chunks", "off").join(sizes.select("id", F.transform("c", lambda c: c["n"]).alias("chunks")), "id", "left")
        rows = rows.withColumn("len", F.when(F.col("len").isNotNull(), F.aggregate(F.coalesce("chunks", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, x: a + x)))
        rows = running_total(rows, ["id"], F.col("len"), "before").withColumn("off", F.when(F.col("len") > 0, F.col("before"))).drop("before")
        return self.store.commit(self._typed(rows), last, **(facts | {"content": [content], "header": _facts(keys.wrap(passphrase, cost))}))

    def change_passphrase(self, old: bytes, new: bytes) -> int:
        """Wraps the data key anew; no content is touched."""
        facts, last = self.store.manifest(), self.store.latest()
        return self.store.commit(self.rows(), last, **(facts | {"header": _facts(K.change_passphrase(self.header(), old, new))}))

    # what checks it

    def verify(self, patterns: list[str] = (), quick: bool = False) -> DataFrame:
        """(id, path, owner, ok) of the chosen live files and links. Each content is decoded and
        hashed once, in order, a chunk at a time; ``quick`` only compares sizes and chunk tables."""
        rows = self.rows()
        chosen = O.select(O.live(rows), list(patterns)).filter("type in ('reg', 'hardlink')")
        target = rows.select(F.col("id").alias("hardlink"), F.col("data").alias("target_data"))
        owned = chosen.join(target, "hardlink", "left").withColumn("owner", F.coalesce("target_data", "hardlink", "data", "id"))
        owners = rows.join(owned.select(F.col("owner").alias("id")).distinct(), "id", "left_semi")
        if quick:
            sizes = self.stored().groupBy("id").agg(F.sum("plain_size").alias("plain"), F.sum(F.octet_length("stored")).alias("bytes"))
            found = owners.join(sizes, "id", "left").select(F.col("id").alias("owner"), ((F.coalesce("plain", F.lit(0)) == F.col("size")) & (F.coalesce("bytes", F.lit(0)) == F.coalesce("len", F.lit(0)))).alias("ok"))
        else:
            digests = self._digests(self.plain(owners), self._key())
            empty = T.hasher(self._key()).hexdigest()
            actual = owners.join(digests.withColumnRenamed("id", "d_id"), F.col("id") == F.col("d_id"), "left")
            found = actual.select(F.col("id").alias("owner"), (F.when(F.col("d_id").isNull() & (F.col("size") == 0), F.lit(empty)).otherwise(F.col("actual")) == F.col("digest")).alias("ok"))
        return owned.join(found, "owner", "left").select("id", "path", "owner", F.coalesce("ok", F.lit(False)).alias("ok"))

    def _digests(self, plain: DataFrame, key: bytes | None = None) -> DataFrame:
        """(id, actual): digests of chunks in order; null if one is damaged."""

        def run(batches):
            now, h = None, None
            for rows in batches:
                out = []
                for i, data in zip(rows["id"], rows["plain"]):
                    if i != now:
                        if now is not None:
                            out.append((now, h and h.hexdigest()))
                        now, h = i, T.hasher(key)
                    if data is None:
                        h = None
                    elif h is not None:
                        h.update(data)
                yield pd.DataFrame(out, columns=["id", "actual"])
            if now is not None:
                yield pd.DataFrame([(now, h and h.hexdigest())], columns=["id", "actual"])

        return plain.repartition("id").sortWithinPartitions("id", "pos").mapInPandas(run, "id long, actual string")

    def extract(self, top: str, patterns: list[str] = (), exclude: list[str] = (), strip: int = 0, policy: str = "always", owners: bool = False, devices: bool = False) -> None:
        """Writes the chosen entries below ``top``, which driver and executors share."""
        rows = self.rows()
        chosen = O.select(O.live(rows), list(patterns), exclude=list(exclude)).filter("path != '.'")
        if strip:
            cut = O.stripped(chosen, strip).filter("not collides")
            chosen = cut.withColumn("path", F.col("new_path")).drop("new_path", "next_path", "collides")
        if policy != "always" and os.path.isdir(top):
            there = T.read_tree(self.spark, top, digests=False)
            chosen = chosen.join(O.overwrite_plan(chosen, there, policy).filter("action = 'write'").select("path"), "path", "left_semi")
        steps = self._kept(O.extraction(chosen, rows), "steps")
        contents = steps.filter("action = 'write'").select("path", F.col("content").alias("id"))
        parts = contents.join(rows.select("id", "codec"), "id")
        plain = parts.join(self.plain(parts.select("id", "codec").distinct()), "id", "left").select("path", "pos", "plain")
        T.write_steps(steps, rows, chosen, plain, top, self._key(), owners, devices)

    def to_stream(self, out, patterns: list[str] = ()) -> None:
        """The contents of the chosen files, in order of path, to a binary stream; links give
        their target's."""
        rows = self.rows()
        chosen = O.select(O.live(rows), list(patterns)).filter("type in ('reg', 'hardlink')")
        target = rows.select(F.col("id").alias("hardlink"), F.coalesce("data", "id").alias("holder"))
        chosen = chosen.join(target, "hardlink", "left").select("path", F.coalesce("holder", "data", "id").alias("id"))
        owners = rows.join(chosen.select("id").distinct(), "id", "left_semi")
        for r in chosen.join(self.plain(owners), "id").orderBy("path", "pos").select("path", "plain").toLocalIterator():
            if r["plain"] is None:
                raise Corrupt(f"{r['path']}: a chunk is damaged")
            out.write(bytes(r["plain"]))

    def dead_space(self) -> int:
        """Stored bytes that ``compact`` would drop."""
        rows = self.rows()
        held = rows.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
        return held - O.kept(rows).agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
