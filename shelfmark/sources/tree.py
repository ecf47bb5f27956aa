"""A local tree as rows: pre-order, names sorted, excluded directories not entered.

The driver lists metadata only; files are read by tasks, in pieces, and only if they still are
the files that the listing saw.
"""

from __future__ import annotations

import grp
import hashlib
import hmac
import os
import pwd
import stat
import uuid
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corrupt, Partial
from ..functions.paths import matcher

KIND = ((stat.S_ISREG, "reg"), (stat.S_ISDIR, "dir"), (stat.S_ISLNK, "symlink"), (stat.S_ISFIFO, "fifo"), (stat.S_ISCHR, "chardev"), (stat.S_ISBLK, "blockdev"), (stat.S_ISSOCK, "socket"))
SCHEMA = "seq long, path string, type string, mode int, uid long, gid long, uname string, gname string, mtime long, size long, link string, dev long, ino long, nlink long, rdev array<bigint>, xattrs map<string,binary>"
#: Bytes read at once.
PIECE = 4 << 20


@lru_cache(4096)
def _user(uid: int) -> str | None:
    try:
        return pwd.getpwuid(uid).pw_name
    except KeyError:
        return None


@lru_cache(4096)
def _group(gid: int) -> str | None:
    try:
        return grp.getgrgid(gid).gr_name
    except KeyError:
        return None


def _attributes(full: str, follow: bool) -> dict[str, bytes] | None:
    try:
        return {n: os.getxattr(full, n, follow_symlinks=follow) for n in os.listxattr(full, follow_symlinks=follow)} or None
    except OSError:
        return None


def entries(top: str, exclude: list[str] = (), follow: bool = False, one_file_system: bool = False, skip: set[tuple[int, int]] = frozenset()):
    """Rows of SCHEMA of a local folder. ``skip``: (dev, ino) of what isn't listed, such as the
    catalog itself. A followed link to a folder that it lies in is an error."""
    seq = 0
    root_dev = os.stat(top).st_dev
    excluded = matcher(list(exclude))

    def walk(full: str, path: str, above: frozenset):
        nonlocal seq
        if path != "." and excluded(path):
            return
        s = os.stat(full) if follow else os.lstat(full)
        here = (s.st_dev, s.st_ino)
        if here in skip:
            return
        kind = next((k for test, k in KIND if test(s.st_mode)), "unsupported")
        if kind == "dir" and here in above:
            raise Partial(f"{path}: a link leads back to a folder above it")
        mode = 0o777 if kind == "symlink" else stat.S_IMODE(s.st_mode)
        device = [os.major(s.st_rdev), os.minor(s.st_rdev)] if kind in ("chardev", "blockdev") else None
        yield (seq, path, kind, mode, s.st_uid, s.st_gid, _user(s.st_uid), _group(s.st_gid), s.st_mtime_ns, s.st_size if kind == "reg" else 0, os.readlink(full) if kind == "symlink" else None, s.st_dev, s.st_ino, s.st_nlink, device, _attributes(full, follow))
        seq += 1
        if kind == "dir" and not (one_file_system and s.st_dev != root_dev):
            for name in sorted(os.listdir(full), key=os.fsencode):
                yield from walk(os.path.join(full, name), name if path == "." else f"{path}/{name}", above | {here})

    yield from walk(top, ".", frozenset())


def open_seen(top: str, path: str, dev: int, ino: int, follow: bool = False):
    """The file that a listing saw: not a link put in its place, not another file."""
    f = os.open(os.path.join(top, path), os.O_RDONLY | (0 if follow else os.O_NOFOLLOW))
    s = os.fstat(f)
    if (s.st_dev, s.st_ino) != (dev, ino):
        os.close(f)
        raise Partial(f"{path}: changed since it was listed")
    return os.fdopen(f, "rb")


def pieces(rows: DataFrame, top: str, size: int, follow: bool = False) -> DataFrame:
    """(id, pos, plain) of the files rows (id, path, dev, ino): cut at ``size`` bytes, read by
    tasks; a piece at a time is in memory."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                with open_seen(top, r.path, r.dev, r.ino, follow) as f:
                    pos = 0
                    while data := f.read(size):
                        yield pd.DataFrame({"id": [r.id], "pos": [pos], "plain": [data]})
                        pos += 1

    return rows.select("id", "path", "dev", "ino").mapInPandas(run, "id long, pos int, plain binary")


def hasher(key: bytes | None = None):
    """A digest of content; keyed where there is a key."""
    return hmac.new(key, digestmod="sha256") if key else hashlib.sha256()


def digested(rows: DataFrame, top: str, follow: bool = False, key: bytes | None = None) -> DataFrame:
    """Adds ``digest`` of the files, read by tasks in pieces; null for all other types."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                h = hasher(key)
                with open_seen(top, r.path, r.dev, r.ino, follow) as f:
                    while data := f.read(PIECE):
                        h.update(data)
                out.append(h.hexdigest())
            yield pd.DataFrame({"d_seq": batch["seq"], "digest": out})

    files = rows.filter("type = 'reg'").select("seq", "path", "dev", "ino")
    return rows.join(files.mapInPandas(run, "d_seq long, digest string"), F.col("seq") == F.col("d_seq"), "left").drop("d_seq")


def heads(rows: DataFrame, top: str, size: int, follow: bool = False) -> DataFrame:
    """(path, bytes): the first bytes of the files."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                with open_seen(top, r.path, r.dev, r.ino, follow) as f:
                    out.append(f.read(size))
            yield pd.DataFrame({"path": batch["path"], "bytes": out})

    return rows.filter("type = 'reg'").select("path", "dev", "ino").mapInPandas(run, "path string, bytes binary")


def read_tree(spark: SparkSession, top: str, digests: bool = True, **options) -> DataFrame:
    """A tree that the driver and the executors can see; file systems of a cluster are listed
    with ``spark.read.format("binaryFile")``."""
    rows = spark.createDataFrame(list(entries(top, **options)), SCHEMA)
    return digested(rows, top, options.get("follow", False)) if digests else rows


def first_seen(rows: DataFrame) -> DataFrame:
    """One row a path: the first in the order of the walk."""
    least = rows.groupBy("path").agg(F.min("seq").alias("first_seq"))
    return rows.join(least, "path").filter("seq = first_seq").drop("first_seq")


def below(top: str, path: str) -> str:
    """The path's place below ``top``; neither it nor a symbolic link on the way leaves ``top``."""
    full, real = os.path.join(top, path), os.path.realpath(top)
    if os.path.commonpath([real, os.path.realpath(os.path.dirname(full))]) != real or os.path.basename(path) == "..":
        raise Corrupt(f"{path} leaves the target folder")
    return full


def write_file(full: str, data: bytes, digest: str | None, mode: int | None, mtime: int | None) -> None:
    """Writes beside the target, checks the digest, sets metadata and renames; a retried task
    writes the same file again."""
    if digest is not None and hashlib.sha256(data).hexdigest() != digest:
        raise Corrupt(f"{full}: digest differs")
    os.makedirs(os.path.dirname(full), exist_ok=True)
    temp = f"{full}.{uuid.uuid4().hex}"
    with open(temp, "wb") as f:
        f.write(data)
    if mode is not None:
        os.chmod(temp, mode)
    if mtime is not None:
        os.utime(temp, ns=(mtime, mtime), follow_symlinks=False)
    os.replace(temp, full)


def write_tree(steps: DataFrame, rows: DataFrame, content: DataFrame, top: str) -> None:
    """Carries out ``extraction`` steps below ``top``, a folder that driver and executors share.

    content: id and bytes of entries that hold content. Files are written by all tasks; the
    other phases, which carry no content, stream through the driver in order of path.
    Directories, files, links and pipes are made; devices and sockets aren't.
    """
    meta = steps.join(rows.filter("not dead").select("path", "mode", "mtime", "link", "digest", "hardlink"), "path", "left")

    def files(phase: int) -> None:
        target = rows.select(F.col("id").alias("hardlink"), F.col("digest").alias("t_digest"), F.col("mode").alias("t_mode"), F.col("mtime").alias("t_mtime"))
        chosen = meta.filter((F.col("phase") == phase) & (F.col("action") == "write")).join(target, "hardlink", "left").join(content.select(F.col("id").alias("content"), "bytes"), "content", "left")
        chosen = chosen.select("path", "bytes", *[F.coalesce(f"t_{c}", c).alias(c) for c in ("digest", "mode", "mtime")])

        def each(part):
            for r in part:
                write_file(below(top, r["path"]), bytes(r["bytes"] or b""), r["digest"], r["mode"], r["mtime"])

        chosen.foreachPartition(each)

    os.makedirs(top, exist_ok=True)
    for r in meta.filter("phase = 1").orderBy("path").toLocalIterator():
        full = below(top, r["path"])
        if r["action"] == "dir":
            os.makedirs(full, exist_ok=True)
            continue
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if r["action"] == "symlink":
            os.symlink(r["link"], full)
            os.utime(full, ns=(r["mtime"], r["mtime"]), follow_symlinks=False)
        elif r["action"] == "fifo":
            os.mkfifo(full, r["mode"])
    files(2)
    files(3)
    for r in meta.filter("phase = 3 and action = 'link'").orderBy("path").toLocalIterator():
        full = below(top, r["path"])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        os.link(below(top, r["link_to"]), full)
    for r in meta.filter("phase = 4").orderBy(F.desc("path")).toLocalIterator():
        full = below(top, r["path"])
        os.chmod(full, r["mode"])
        os.utime(full, ns=(r["mtime"], r["mtime"]))


def write_parts(parts, top: str, facts: dict, key: bytes | None = None) -> None:
    """Writes files from their chunks in order: (path, pos, plain) sorted by path and pos, with
    facts {path: (digest, mode, mtime, xattrs, owner)}; each goes beside its target and is renamed
    once its digest is right, so a retried task writes the same file again. Chunks of zeros become
    holes."""
    now, out, h, temp = None, None, None, None

    def finish():
        out.truncate()
        out.close()
        digest, mode, mtime, xattrs, owner = facts[now]
        if digest is not None and h.hexdigest() != digest:
            os.unlink(temp)
            raise Corrupt(f"{now}: digest differs")
        for name, value in (xattrs or {}).items():
            if name.startswith("user."):
                try:
                    os.setxattr(temp, name, bytes(value))
                except OSError:
                    pass  # the destination doesn't take it
        if owner:
            os.chown(temp, *owner)
        if mode is not None:
            os.chmod(temp, mode)  # after the owner, whose change clears bits
        if mtime is not None:
            os.utime(temp, ns=(mtime, mtime))
        os.replace(temp, below(top, now))

    for r in parts:
        if r["path"] != now:
            if now is not None:
                finish()
            now, h = r["path"], hasher(key)
            full = below(top, now)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            temp = f"{full}.{uuid.uuid4().hex}"
            out = open(temp, "wb")
        if r["pos"] is not None and r["plain"] is None:
            raise Corrupt(f"{now}: a chunk is damaged")
        data = bytes(r["plain"] or b"")
        h.update(data)
        if data.strip(b"\0"):
            out.write(data)
        else:
            out.seek(len(data), os.SEEK_CUR)
    if now is not None:
        finish()


def write_steps(steps: DataFrame, rows: DataFrame, chosen: DataFrame, plain: DataFrame, top: str, key: bytes | None = None, owners: bool = False, devices: bool = False) -> None:
    """Carries out ``extraction`` steps with contents (path, pos, plain): files in tasks, all else
    in order of path on the driver. chosen: the entries under the paths that they are written to.
    ``owners`` and ``devices`` need the privilege to set and to make them."""
    holder = rows.select(F.col("id").alias("held"), F.col("digest").alias("h_digest"), F.col("mode").alias("h_mode"), F.col("mtime").alias("h_mtime"))
    meta = steps.join(chosen.select("path", "mode", "mtime", "link", "digest", "hardlink", "xattrs", "uid", "gid", "rdev"), "path", "left")
    meta = meta.join(holder, F.coalesce("hardlink", "content") == F.col("held"), "left")
    files = meta.filter("action = 'write'").select("path", F.coalesce("h_digest", "digest").alias("digest"), F.when(F.col("hardlink").isNull(), F.col("mode")).otherwise(F.col("h_mode")).alias("mode"), F.when(F.col("hardlink").isNull(), F.col("mtime")).otherwise(F.col("h_mtime")).alias("mtime"), "xattrs", "uid", "gid")
    parts = plain.join(files, "path").repartition("path").sortWithinPartitions("path", "pos")

    def owner_of(r):
        return (r["uid"], r["gid"]) if owners and r["uid"] is not None and r["gid"] is not None else None

    def each(part):
        facts: dict = {}

        def told():
            for r in part:
                facts.setdefault(r["path"], (r["digest"], r["mode"], r["mtime"], r["xattrs"], owner_of(r)))
                yield r

        write_parts(told(), top, facts, key)

    os.makedirs(top, exist_ok=True)
    for r in meta.filter("phase = 1").orderBy("path").toLocalIterator():
        full = below(top, r["path"])
        if r["action"] == "dir":
            os.makedirs(full, exist_ok=True)
            continue
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if os.path.lexists(full):
            os.unlink(full)
        if r["action"] == "symlink":
            os.symlink(r["link"], full)
            os.utime(full, ns=(r["mtime"], r["mtime"]), follow_symlinks=False)
            if owner_of(r):
                os.chown(full, *owner_of(r), follow_symlinks=False)
        elif r["action"] == "fifo":
            os.mkfifo(full, r["mode"])
        elif devices and r["action"] in ("chardev", "blockdev"):
            os.mknod(full, (r["mode"] or 0) | (stat.S_IFCHR if r["action"] == "chardev" else stat.S_IFBLK), os.makedev(*r["rdev"]))
    parts.foreachPartition(each)
    for r in meta.filter("phase = 3 and action = 'link'").orderBy("path").toLocalIterator():
        full = below(top, r["path"])
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if os.path.lexists(full):
            os.unlink(full)
        os.link(below(top, r["link_to"]), full)
    for r in meta.filter("phase = 4").orderBy(F.desc("path")).toLocalIterator():
        full = below(top, r["path"])
        if owner_of(r):
            os.chown(full, *owner_of(r))
        os.chmod(full, r["mode"])
        os.utime(full, ns=(r["mtime"], r["mtime"]))
