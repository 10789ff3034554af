"""Normalisers: what a field value must look like, and its canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evlog import fixed as X
from evlog.functions.text import let, strip, whole


def norm_ip(c: Column) -> Column:
    """Trimmed text if it has the dotted shape, else null; octet values are a later check."""
    t = strip(c)
    return F.when(whole(t, X.IPV4), t)


def norm_port(c: Column) -> Column:
    """Integer 0..65535 as text, else null; never guessed from something else."""
    return _port(strip(c))


def _port(t: Column) -> Column:
    number = t.rlike(X.INTEGER) & ~t.rlike(X.NOT_INTEGER)
    n = F.when(number, F.replace(t, F.lit("_"), F.lit("")))
    n = F.when(F.length(n) <= X.MAX_DIGITS + F.startswith(n, F.lit("+")).cast("int") + F.startswith(n, F.lit("-")).cast("int"), n).try_cast("int")
    return let(n, lambda v: F.when((v >= 0) & (v <= X.MAX_PORT), v.cast("string")))


def norm_str(c: Column) -> Column:
    """Trimmed text, empty becomes null."""
    return F.nullif(strip(c), F.lit(""))


def norm_upper(c: Column) -> Column:
    return F.upper(norm_str(c))


def norm_lower(c: Column) -> Column:
    return F.lower(norm_str(c))


def kind_of(field: str) -> str:
    """How values of a canonical field are normalised."""
    kinds = {"ip": X.IP_FIELDS, "port": X.PORT_FIELDS, "upper": X.UPPER_FIELDS, "lower": X.LOWER_FIELDS}
    return next((k for k, fields in kinds.items() if field in fields), "str")


def norm_kind(kind: Column, text: Column) -> Column:
    """Normalise a trimmed text by the kind of its field; null kind gives null."""
    return (
        F.when(kind == "str", text)
        .when(kind == "ip", F.when(whole(text, X.IPV4), text))
        .when(kind == "port", _port(text))
        .when(kind == "upper", F.upper(text))
        .when(kind == "lower", F.lower(text))
    )


def norm_field(field: Column, value: Column) -> Column:
    """Normalise a value by the canonical field it is meant for; null field gives null."""
    return (
        F.when(field.isNull(), F.lit(None).cast("string"))
        .when(field.isin(X.IP_FIELDS), norm_ip(value))
        .when(field.isin(X.PORT_FIELDS), norm_port(value))
        .when(field.isin(X.UPPER_FIELDS), norm_upper(value))
        .when(field.isin(X.LOWER_FIELDS), norm_lower(value))
        .otherwise(norm_str(value))
    )


def pri_severity(pri: Column) -> Column:
    """Severity name of a syslog PRI number: PRI modulo 8."""
    names = F.array(*[F.lit(s) for s in X.PRI_SEVERITY])
    return F.get(names, pri.try_cast("int") % 8)
