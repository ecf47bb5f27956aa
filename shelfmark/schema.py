"""The catalog: one row per entry, versioned by generation, with soft deletes."""

from pyspark.sql import types as T

TYPES = ("reg", "dir", "symlink", "hardlink", "fifo", "chardev", "blockdev", "socket")
MAX_CHUNK, MAX_XATTR_NAME, MAX_XATTR_VALUE, MAX_XATTRS = 256 << 20, 255, 65536, 1024
MAX_DICTS, MAX_DICT = 1024, 1 << 20

SEGMENT = T.StructType([T.StructField("off", T.LongType()), T.StructField("len", T.LongType())])

#: Times are nanoseconds in longs; a missing uid or gid is null, not 0.
ENTRY = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("gen", T.LongType(), False), T.StructField("path", T.StringType(), False),
    T.StructField("type", T.StringType(), False), T.StructField("mode", T.IntegerType()), T.StructField("uid", T.LongType()), T.StructField("gid", T.LongType()),
    T.StructField("uname", T.StringType()), T.StructField("gname", T.StringType()), T.StructField("mtime", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("link", T.StringType()), T.StructField("hardlink", T.LongType()), T.StructField("data", T.LongType()), T.StructField("rdev", T.ArrayType(T.LongType())),
    T.StructField("xattrs", T.MapType(T.StringType(), T.BinaryType())), T.StructField("sparse", T.ArrayType(SEGMENT)), T.StructField("digest", T.StringType()),
    T.StructField("codec", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("off", T.LongType()), T.StructField("len", T.LongType()),
    T.StructField("chunks", T.ArrayType(T.LongType())), T.StructField("dead", T.BooleanType()),
])
