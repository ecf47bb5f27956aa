"""Sizes and specifications as users write them."""

import re

from ..errors import Usage

UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def parse_size(text: str) -> int:
    """``4MiB``, ``512K``, ``2g``: all units are powers of 1024."""
    m = re.fullmatch(r"([0-9]+)\s*([kmgt]?)(i?b)?", text.strip().lower())
    if not m:
        raise Usage(f"not a size: {text}")
    return int(m[1]) * UNITS[m[2]]


def human_bytes(n: int) -> str:
    value, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB", "PiB"):
        if value < 1024 or unit == "PiB":
            break
        value /= 1024
    return f"{n} B" if unit == "B" else f"{value:.1f} {unit}"


def parse_spec(text: str) -> tuple[str, dict[str, str]]:
    """``NAME[:key[=value],...]``; a bare key is on."""
    name, _, rest = text.partition(":")
    params: dict[str, str] = {}
    for part in rest.split(",") if rest else ():
        key, eq, value = part.partition("=")
        if not key or (eq and not value):
            raise Usage(f"empty key or value: {text}")
        if key in params:
            raise Usage(f"{key} is given twice: {text}")
        params[key] = value if eq else "on"
    if not name:
        raise Usage(f"no name: {text}")
    return name, params


def plural(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun}s"


def clock(seconds: float) -> str:
    """h:mm:ss, or m:ss below an hour."""
    s = int(seconds + 0.5)
    return f"{s // 3600}:{s // 60 % 60:02}:{s % 60:02}" if s >= 3600 else f"{s // 60}:{s % 60:02}"


def meter(done: int, total: int, entries: int, elapsed: float) -> str:
    """A line of progress: with the time left where the total is known."""
    rate = int(done / elapsed) if elapsed > 0 else 0
    if total <= 0:
        return f"{human_bytes(done)}  {plural(entries, 'entry') if entries == 1 else f'{entries} entries'}  {human_bytes(rate)}/s"
    left = clock((total - done) / rate) if rate > 0 and done <= total else "-:--"
    return f"{human_bytes(done)} / {human_bytes(total)}  {min(100, 100 * done // total)}%  {human_bytes(rate)}/s  {left} left"


def catalog_name(name: str, extension: str = ".shelf") -> str:
    """The name with the extension, unless it has one; a name that ends in a slash is refused."""
    if not name or name.endswith("/"):
        raise Usage(f"not a name: {name}")
    last = name.rsplit("/", 1)[-1]
    return name if "." in last.lstrip(".") else name + extension


def read_list(text: str) -> list[str]:
    """Entries of a list file: one a line, a carriage return at its end cut, blank lines dropped;
    there are no comments."""
    return [line.removesuffix("\r") for line in text.split("\n") if line.removesuffix("\r")]
