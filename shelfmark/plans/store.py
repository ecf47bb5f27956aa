"""Generations as Parquet: a snapshot and the changes since; a manifest file commits each. A
half-written manifest doesn't parse, so it commits nothing."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corrupt, Locked


#: Generations of changes upon one snapshot.
MOST_CHANGES = 16


class Store:
    """A catalog at a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/manifests"))

    def _text(self, path) -> str:
        """A small file, read through the file system, without a job."""
        stream = self._fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        finally:
            stream.close()

    def _manifests(self) -> dict[int, dict]:
        """Committed generations: those whose manifest parses and whose snapshot is there."""
        out = {}
        for f in self._fs.listStatus(self._Path(f"{self.path}/manifests")):
            name = f.getPath().getName()
            if name.endswith(".json") and name[:-5].isdigit():
                try:
                    found = json.loads(self._text(f.getPath()))
                    parts = [found["snapshot"], *[p for change in found.get("changes", []) for p in (change["rows"], change["gone"])]]
                    if all(self._fs.exists(self._Path(f"{self.path}/{p}/_SUCCESS")) for p in parts):
                        out[int(found["generation"])] = found
                except (ValueError, KeyError, TypeError):
                    continue  # a damaged manifest isn't a commit
        return out

    def generations(self) -> list[int]:
        return sorted(self._manifests())

    def manifest(self, generation: int | None = None) -> dict:
        found = self._manifests()
        number = generation or max(found, default=0)
        if number not in found:
            raise Corrupt(f"no valid generation {number}")
        return found[number]

    def latest(self) -> int:
        return max(self.generations(), default=0)

    def commit(self, rows: DataFrame, expected: int, **facts) -> int:
        """Writes the next generation if ``expected`` is still the latest, else Locked; ``facts``
        go into its manifest. What a failed commit has written is removed."""
        snapshot = f"snapshots/{expected + 1:08d}-{uuid.uuid4().hex}"
        facts.pop("changes", None)
        return self._commit({snapshot: rows}, expected, facts | {"snapshot": snapshot})

    def commit_changes(self, rows: DataFrame, gone: DataFrame, expected: int, **facts) -> int:
        """The same, of new rows and the ids (``id``) of entries that become tombstones. Only these
        are written; after MOST_CHANGES generations the whole is written anew."""
        last = self.manifest(expected)
        changes = last.get("changes", [])
        if len(changes) >= MOST_CHANGES:
            return self.commit(self._read(last, (rows, gone)), expected, **facts)
        name = f"snapshots/{expected + 1:08d}-{uuid.uuid4().hex}"
        change = {"rows": f"{name}-rows", "gone": f"{name}-gone"}
        return self._commit({change["rows"]: rows, change["gone"]: gone.select("id")}, expected, facts | {"snapshot": last["snapshot"], "changes": [*changes, change]})

    def _commit(self, tables: dict[str, DataFrame], expected: int, facts: dict) -> int:
        number = expected + 1
        target = self._Path(f"{self.path}/manifests/{number:08d}.json")
        if self.latest() != expected or self._fs.exists(target):
            raise Locked(f"generation {number} was committed by another writer")
        try:
            for name, rows in tables.items():
                rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
            # creating without overwriting is the commit: of two writers one fails here
            text = json.dumps(facts | {"generation": number}).encode()
            try:
                out = self._fs.create(target, False)
            except Py4JJavaError:
                raise Locked(f"generation {number} was committed by another writer") from None
            out.write(bytearray(text))
            out.close()
        except BaseException:
            for name in tables:
                self._fs.delete(self._Path(f"{self.path}/{name}"), True)
            raise
        return number

    def read(self, generation: int | None = None) -> DataFrame:
        return self._read(self.manifest(generation))

    def _read(self, manifest: dict, more: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        table = lambda name: self.spark.read.parquet(f"{self.path}/{name}")
        out = table(manifest["snapshot"])
        changes = [(table(c["rows"]), table(c["gone"])) for c in manifest.get("changes", [])] + ([more] if more else [])
        if not changes:
            return out
        gone = reduce(DataFrame.union, [g.select("id") for _, g in changes]).distinct().withColumn("gone", F.lit(True))
        rows = reduce(DataFrame.unionByName, [r for r, _ in changes], out)
        return rows.join(gone, "id", "left").withColumn("dead", F.col("dead") | F.coalesce("gone", F.lit(False))).select(*out.columns)

    def repair(self) -> int:
        """Removes manifests after the last valid generation; returns that generation."""
        last, valid = self.latest(), set(self.generations())
        for f in self._fs.listStatus(self._Path(f"{self.path}/manifests")):
            name = f.getPath().getName()
            if name.startswith(".") or (name[:-5].isdigit() and int(name[:-5]) not in valid):
                self._fs.delete(f.getPath(), False)
        return last
