"""Settings in layers: defaults, a file, the environment, the command line; the last wins."""

from __future__ import annotations

import os
import stat
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import Usage

LAYERS = ("default", "file", "environment", "command line")
PREFIX = "SHELFMARK_"


@dataclass(frozen=True)
class Setting:
    value: str
    source: str


def parse_file(text: str, known: Mapping[str, str], name: str = "settings") -> dict[str, str]:
    """``key = value`` lines; ``#`` begins a comment line, blank lines don't count. An unknown
    or repeated key is an error that names its line."""
    out: dict[str, str] = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq or key not in known or key in out:
            raise Usage(f"{name}:{number}: {'no value' if not eq else 'unknown key' if key not in known else 'repeated key'}: {key}")
        out[key] = value
    return out


def read_file(path: str, known: Mapping[str, str]) -> dict[str, str]:
    """Settings of a file that nobody but its owner, this user or root, may write."""
    s = os.stat(path)
    if s.st_uid not in (0, os.geteuid()) or s.st_mode & (stat.S_IWGRP | stat.S_IWOTH):
        raise Usage(f"{path}: others may write it")
    with open(path, encoding="utf-8") as f:
        return parse_file(f.read(), known, path)


def from_environment(env: Mapping[str, str], known: Mapping[str, str]) -> dict[str, str]:
    """``PREFIX`` and the key in capitals, with ``_`` for ``-``; an unknown name is an error."""
    names = {PREFIX + k.upper().replace("-", "_"): k for k in known}
    unknown = sorted(k for k in env if k.startswith(PREFIX) and k not in names)
    if unknown:
        raise Usage(f"unknown variable: {unknown[0]}")
    return {names[k]: v for k, v in env.items() if k in names}


@dataclass(frozen=True)
class Rules:
    """What files and the environment may set.

    ``scopes``: the operations that a key is for; on any other, a configured value is ignored
    (keys without a scope are for all). ``typed_only``: keys that only a command line may give,
    with the reason. ``groups``: keys that decide one thing together, so that one of them on the
    command line sets aside whatever is configured for any of them.
    """

    scopes: Mapping[str, frozenset[str]] = field(default_factory=dict)
    typed_only: Mapping[str, str] = field(default_factory=dict)
    groups: tuple[frozenset[str], ...] = ()


_ADDING, _WALKING = frozenset({"create", "append", "update"}), frozenset({"create", "append", "update", "diff", "diff-extract"})
#: The keys of ``plans.archive``.
RULES = Rules(
    {
        "compress": _ADDING, "no-dedup": _ADDING, "encrypt": frozenset({"create"}), "kdf-cost": frozenset({"create", "encrypt"}), "exclude": _WALKING | {"list", "extract"}, "dereference": _WALKING, "one-file-system": _WALKING,
        "preserve-permissions": frozenset({"extract"}), "no-xattrs": _WALKING | {"extract"}, "no-acls": _WALKING | {"extract"}, "always": frozenset({"extract"}), "keep": frozenset({"extract"}), "newer": frozenset({"extract"}),
        "update-test": frozenset({"update"}), "on-conflict": frozenset({"append"}), "quick": frozenset({"verify"}), "long": frozenset({"list"}), "json": frozenset({"list"}),
    },
    {"passphrase": "a passphrase is never configured", "passphrase-file": "where a passphrase comes from is typed", "passphrase-variable": "where a passphrase comes from is typed", "catalog": "the catalog is named on the command line", "dry-run": "a dry run is asked for on the command line", "strip": "it depends on how the catalog was made"},
    (frozenset({"always", "keep", "newer"}), frozenset({"verbose", "quiet"}), frozenset({"long", "json"})),
)


def boolean(text: str) -> bool:
    """The spellings of yes and no that people write."""
    value = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}.get(text.strip().lower())
    if value is None:
        raise Usage(f"neither yes nor no: {text}")
    return value


def effective(defaults: Mapping[str, str], file: Mapping[str, str] = {}, environment: Mapping[str, str] = {}, command_line: Mapping[str, str] = {}, operation: str | None = None, rules: Rules = Rules()) -> dict[str, Setting]:
    """Each key's value and the layer that it comes from, for an operation or, without one, for
    showing them all."""
    aside = set(command_line).union(*(g for g in rules.groups if g & set(command_line)))
    out: dict[str, Setting] = {}
    for source, layer in zip(LAYERS, (defaults, file, environment, command_line)):
        for key, value in layer.items():
            if key not in defaults:
                raise Usage(f"unknown key from {source}: {key}")
            if source in ("file", "environment"):
                if key in rules.typed_only:
                    raise Usage(f"{key} from {source}: {rules.typed_only[key]}")
                if key in aside or (operation and operation not in rules.scopes.get(key, {operation})):
                    continue
            out[key] = Setting(value, source)
    return out


def table(spark: SparkSession, settings: Mapping[str, Setting]) -> DataFrame:
    return spark.createDataFrame([(k, s.value, s.source) for k, s in sorted(settings.items())], "key string, value string, source string")
