"""Strict JSON tests built from ``from_json``.

``from_json`` stops after the first value and accepts trailing text.  The text
is therefore parsed as the first element of an array whose second element is
the text's own SHA-256.  Trailing text can only be accepted if it closes or
extends the array itself, and then the last element would have to be the hash
of the text that contains it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evlog.functions.text import let

_OPTIONS = {"allowSingleQuotes": "false"}


def json_kind(text: Column, seal: Column) -> Column:
    """'object' or 'array' if the text is exactly one such JSON value, else null."""
    wrapped = F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]'))
    ok = let(
        F.from_json(wrapped, "array<string>", _OPTIONS),
        lambda v: (F.size(v) == 2) & (F.get(v, F.lit(1)) == seal) & F.get(v, F.lit(0)).isNotNull(),
    )
    return F.when(
        F.startswith(text, F.lit("{")) | F.startswith(text, F.lit("[")),
        F.when(ok, F.when(F.startswith(text, F.lit("{")), "object").otherwise("array")),
    )


def json_object(text: Column, seal: Column) -> Column:
    """The members of a JSON object as a string map (nested values as JSON text), else null.

    Repeated keys are all kept, in order, so the reader decides which one wins.
    """
    wrapped = F.concat(F.lit("["), text, F.lit(',{"'), seal, F.lit('":""}]'))
    doc = let(
        F.from_json(wrapped, "array<map<string,string>>", _OPTIONS),
        lambda v: F.when(
            (F.size(v) == 2) & F.array_contains(F.map_keys(F.get(v, F.lit(1))), seal),
            F.get(v, F.lit(0)),
        ),
    )
    return F.when(F.startswith(text, F.lit("{")), doc)
