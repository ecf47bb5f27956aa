"""Text forms of catalog values as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = {"dir": "d", "symlink": "l", "hardlink": "h", "socket": "s", "fifo": "p", "chardev": "c", "blockdev": "b"}


def mode_string(kind: Column, mode: Column) -> Column:
    """As ls shows it, with set-id and sticky bits."""
    letter = F.lit("-")
    for name, c in LETTERS.items():
        letter = F.when(kind == name, c).otherwise(letter)
    bit = lambda b: mode.bitwiseAND(F.lit(b)) != 0
    parts = [letter]
    for shift, special, low, high in ((6, 0o4000, "s", "S"), (3, 0o2000, "s", "S"), (0, 0o1000, "t", "T")):
        parts += [F.when(bit(4 << shift), "r").otherwise("-"), F.when(bit(2 << shift), "w").otherwise("-")]
        x = bit(1 << shift)
        parts.append(F.when(bit(special) & x, low).when(bit(special), high).when(x, "x").otherwise("-"))
    return F.concat(*parts)


def owner_string(uid: Column, gid: Column, uname: Column, gname: Column) -> Column:
    return F.when(uid.isNull() | gid.isNull(), "-").otherwise(F.concat_ws("/", F.coalesce(uname, uid.cast("string")), F.coalesce(gname, gid.cast("string"))))


def tenths(x: Column) -> Column:
    """A double with one decimal as C's ``%.1f``: from its exact value, ties to even. Java's
    ``%.1f`` takes the shortest decimal that tells the double and rounds ties up."""
    return F.call_function("format_number", x, F.lit("0.0"))


def saved_percent(plain: Column, stored: Column) -> Column:
    return F.when(plain == 0, "-").otherwise(F.concat(tenths(100.0 * (plain - stored) / plain), F.lit("%")))


def utc_time(name: str) -> Column:
    """``YYYY-MM-DD HH:MM:SS.nnnnnnnnn`` of a column of nanoseconds."""
    return F.expr(f"concat(date_format(timestamp_seconds(({name} - pmod({name}, 1000000000L)) div 1000000000L), 'yyyy-MM-dd HH:mm:ss'), '.', lpad(cast(pmod({name}, 1000000000L) as string), 9, '0'))")


def codec_string(name: Column, params: Column, has_dict: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    pairs = F.when(has_dict, F.array_append(pairs, F.lit("dict"))).otherwise(pairs)
    return F.when(F.size(pairs) == 0, name).otherwise(F.concat(name, F.lit(":"), F.array_join(pairs, ",")))


def payload_size(size: Column, sparse: Column) -> Column:
    return F.when(F.size(sparse) > 0, F.aggregate(sparse, F.lit(0).cast("long"), lambda a, s: a + s["len"])).otherwise(size)


def _escapes() -> list[tuple[str, str]]:
    """Characters that a terminal would act on, and how they are shown."""
    named = {"\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    low = {chr(c): f"\\x{c:02x}" for c in (*range(1, 0x20), 0x7F)}
    wide = {chr(c): f"\\u{c:04x}" for c in (*range(0x80, 0xA0), 0x061C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A))}
    return list((named | {c: t for c, t in (low | wide).items() if c not in named}).items())


ESCAPED = r"[\x00-\x1F\x7F-\x9F\\\u061C\u200E\u200F\u202A-\u202E\u2066-\u2069]"


def printable(text: Column) -> Column:
    """Control, C1 and bidirectional characters as escapes, backslashes doubled, so that a name
    can't move the cursor or pass for another; for terminals only."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\0"), F.lit("\\x00"))
    for c, shown in _escapes()[1:]:
        out = F.replace(out, F.lit(c), F.lit(shown))
    return F.when(text.rlike(ESCAPED), out).otherwise(text)


def rfc3339(name: str) -> Column:
    """A column of nanoseconds in UTC, without trailing zeros of the fraction."""
    fraction = f"rtrim('0', lpad(cast(pmod({name}, 1000000000L) as string), 9, '0'))"
    return F.expr(f"concat(date_format(timestamp_seconds(({name} - pmod({name}, 1000000000L)) div 1000000000L), \"yyyy-MM-dd'T'HH:mm:ss\"), CASE WHEN pmod({name}, 1000000000L) = 0 THEN '' ELSE concat('.', {fraction}) END, 'Z')")


def stored_percent(plain: Column, stored: Column) -> Column:
    return F.when(plain == 0, "").otherwise(F.concat(F.lit(" ("), tenths(100.0 * stored / plain), F.lit("%)")))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def human_bytes(n: Column) -> Column:
    """As ``sizes.human_bytes``."""
    units = ("KiB", "MiB", "GiB", "TiB", "PiB")
    out = F.concat(tenths(n / F.lit(float(1 << 50))), F.lit(" PiB"))
    for i, unit in reversed(list(enumerate(units[:-1], 1))):
        out = F.when(n < 1 << 10 * (i + 1), F.concat(tenths(n / F.lit(float(1 << 10 * i))), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(out)


WHAT = {"type": "type differs", "size": "size differs", "link": "link target differs", "device": "device numbers differ", "mode": "mode differs", "owner": "owner differs", "mtime": "mtime differs"}
LISTS = {"xattrs": "extended attributes differ", "acls": "ACLs differ"}


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(printable(text), F.lit('"'), F.lit('\\"')), F.lit('"'))


def difference_line(path: Column, kind: Column, archive: Column, disk: Column, names: Column, show=lambda c: c, extracted: Column | None = None, offset: Column | None = None) -> Column:
    """One difference as text; ``extracted`` ones are between the source and its extracted copy."""
    copy = F.lit(False) if extracted is None else extracted
    after = F.when(copy, " after extraction").otherwise("")
    at = F.lit(None).cast("string") if offset is None else offset.cast("string")
    value = lambda c: F.when(kind == "link", _quoted(c)).otherwise(c)
    pair = F.when(copy, F.concat(F.lit(": source "), value(disk), F.lit(", extracted "), value(archive))).otherwise(F.concat(F.lit(": archive "), value(archive), F.lit(", disk "), value(disk)))
    text = F.when(kind == "missing", "not on disk").when(kind == "extra", "not in the archive").when(kind == "hardlink", F.concat(F.lit("not a hardlink of "), show(archive)))
    text = text.when(kind == "content", F.when(copy, F.concat(F.lit("content differs after extraction, at byte "), at)).otherwise("content differs"))
    for k, words in LISTS.items():
        text = text.when(kind == k, F.concat(F.lit(words), after, F.lit(": "), F.array_join(F.transform(names, show), ", ")))
    for k, words in WHAT.items():
        text = text.when(kind == k, F.concat(F.lit(words), after, pair))
    return F.concat(show(path), F.lit(": "), text)
