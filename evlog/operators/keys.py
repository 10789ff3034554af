"""Key registries: which canonical field a key of a format stands for, as a table that users keep instead of code.

A registry has rows (format, key, canonical_field) and comes before the built-in tables. Keys meet it inside the row, through a
constant map, so lines are never shuffled. The map holds the whole registry up to a limit of bytes; beyond it, only the rows
whose keys occur in the lines, found by a join of distinct keys.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.operators.normalize import LEAVES

#: Bytes of keys and fields that a plan may hold.
KEY_BYTES = 1 << 18
#: Fields that a key may stand for: those of the canonical event, and the category, which is kept as a record.
FIELDS = sorted({name for names in LEAVES.values() for name in names} | {"category"})

KeyRows = tuple[tuple[str, str, str], ...]
BUILT_IN = {X.CEF: X.CEF_KEYS, X.LEEF: X.LEEF_KEYS, X.SYSLOG: X.SYSLOG_KEYS, X.XML: X.XML_KEYS}


def registered(registry: DataFrame) -> DataFrame:
    """Distinct rows of a registry as keys are compared: those of syslog messages in lower case."""
    key = F.when(F.col("format") == X.SYSLOG, F.lower("key")).otherwise(F.col("key"))
    return registry.select("format", key.alias("key"), "canonical_field").distinct()


def size_of(rows: DataFrame) -> int:
    text = F.octet_length("key") + F.octet_length("canonical_field")
    return rows.agg(F.coalesce(F.sum(F.coalesce(text, F.lit(0)) + 16), F.lit(0))).first()[0]


def key_rows(registry: DataFrame, seen: DataFrame | None = None, limit: int = KEY_BYTES) -> KeyRows:
    """The rows of a registry that a plan needs, in order; at most ``limit`` bytes of them.

    ``seen`` (format, key) are the keys that occur; it is read only if the registry is larger than ``limit``. Refused are
    unknown formats and fields, nulls, and keys with two fields: they would be lost, or depend on the order of rows.
    """
    rows = registered(registry)
    if size_of(rows) > limit:
        if seen is None:
            raise ValueError(f"the registry has more than {limit} bytes, and the keys that occur are not given")
        rows = rows.join(seen.select("format", "key").distinct(), ["format", "key"], "left_semi")
        if size_of(rows) > limit:
            raise ValueError(f"the keys that occur take more than {limit} bytes of the registry: raise the limit")
    found = sorted((tuple(r) for r in rows.select("format", "key", "canonical_field").collect()), key=str)
    for fmt, key, field in found:
        if fmt not in X.KNOWN_FORMATS or not key or field not in FIELDS:
            raise ValueError(f"no such format, key or field: {fmt!r}, {key!r}, {field!r}")
    twice = [a[:2] for a, b in zip(found, found[1:]) if a[:2] == b[:2]]
    if twice:
        raise ValueError(f"keys with two fields: {twice}")
    return tuple(found)


@cache
def key_tables(rows: KeyRows = ()) -> dict[str, dict[str, str]]:
    """Format -> key -> canonical field; registered rows before built-in ones. JSON keys come in order of preference:
    the built-in candidates of each field, then the registered ones."""
    own: dict[str, dict[str, str]] = {f: {} for f in X.KNOWN_FORMATS}
    for fmt, key, field in rows:
        own[fmt][key] = field
    tables = {fmt: known | own[fmt] for fmt, known in BUILT_IN.items()}
    candidates = {f: [k for k in keys if own[X.JSON].get(k, f) == f] for f, keys in X.JSON_KEYS.items()}
    for key, field in own[X.JSON].items():
        if key not in candidates.setdefault(field, []):
            candidates[field].append(key)
    tables[X.JSON] = {k: f for f, keys in candidates.items() for k in keys}
    return tables
