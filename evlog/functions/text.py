"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evlog import fixed as X


def _sql(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in value.items()) + ")"
    if isinstance(value, tuple):
        return "named_struct(" + ", ".join(f"'{n}', {_sql(v)}" for n, v in value) + ")"
    if isinstance(value, list):
        return "array(" + ", ".join(map(_sql, value)) + ")"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def table(value) -> Column:
    """Constant column of a Python value: dict, list, or tuple of (name, value) for a struct."""
    return F.expr(_sql(value))


def strip(c: Column) -> Column:
    """Remove Unicode white space from both ends without a regular expression."""
    return F.trim(c, F.lit(X.BLANKS))


def whole(c: Column, pattern: str) -> Column:
    """True iff the whole text matches the pattern."""
    return c.rlike(rf"\A(?:{pattern})\z")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Catalyst inlines a projected column that is referenced once, also when that
    one place is a lambda that runs per element.  Binding the value as a lambda
    variable rules that out.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kept(c: Column) -> Column:
    """The value of ``c``, computed at this place and nowhere else.

    Catalyst merges projections and pushes filters through them by copying the
    expressions they refer to.  The stages here each use the one before several
    times, so copies of copies would grow without end.  A column that counts as
    non-deterministic is neither copied nor passed by a filter.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def value_for(names: Column, values: Column, name) -> Column:
    """Value at the first place where ``names`` holds ``name``, else null.

    Reverse both arrays first to get the last one.
    """
    return F.get(values, F.array_position(names, name).cast("int") - 1)


def last_wins_map(keys: Column, values: Column) -> Column:
    """Key-sorted map in which the last value of a repeated key wins; null when empty."""

    def build(kv: Column) -> Column:
        rk, rv = F.reverse(kv["k"]), F.reverse(kv["v"])
        uniq = F.sort_array(F.array_distinct(kv["k"]))
        return F.map_from_arrays(uniq, F.transform(uniq, lambda k: value_for(rk, rv, k)))

    return F.when(F.size(keys) > 0, let(F.struct(keys.alias("k"), values.alias("v")), build))


def quoted(c: Column) -> Column:
    """Text in single quotes, or in double quotes when it holds only single ones."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, mark in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )
