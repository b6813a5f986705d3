"""JSON of no fixed shape as VARIANT: parsed once, read by path and type.

Broken JSON is null, and so is a path that isn't there or holds another type; nothing
raises, and all of it stays in the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def read(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def shape(value: Column) -> Column:
    """The type of one value, such as OBJECT<k: BIGINT>."""
    return F.schema_of_variant(value)


def common_shape(value: Column) -> Column:
    """An aggregate: the narrowest type that all values have."""
    return F.schema_of_variant_agg(value)
