"""Canonical ids, decimal strings and frame checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tuple_key(*parts: Column | str) -> Column:
    """A JSON array of strings, never a delimiter join: ``["a","b"]``."""
    return F.to_json(F.array(*[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def prefixed_key(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix + ":"), tuple_key(*parts))


def is_integer_string(col: Column) -> Column:
    return col.rlike(r"^(0|-?[1-9][0-9]*)$")


def is_natural_string(col: Column) -> Column:
    return col.rlike(r"^(0|[1-9][0-9]*)$")


def canonical_json(**fields: Column) -> Column:
    """JSON of an object with sorted names; null fields are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_key(prefix: str, context: Column) -> Column:
    """The address of a content-addressed entry: prefix and sha256 of its canonical JSON."""
    return F.concat(F.lit(prefix), F.sha2(context, 256))
