"""Free metadata of a document: a map of texts, read, set, merged and cut by key; and references to sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = "source:"


def get(m: Column, key: str) -> Column:
    """The value under ``key``, null if there is none."""
    return F.try_element_at(m, F.lit(key))


def without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys)) if keys else m


def merged(m: Column, other: Column) -> Column:
    """All entries of both; those of ``other`` count where both have a key."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k)), other)


def put(m: Column, key: str, value: Column) -> Column:
    return merged(m, F.create_map(F.lit(key), value.cast("string")))


def changed(a: Column, b: Column) -> Column:
    """Whether two values differ, null being a value like others."""
    return ~a.eqNullSafe(b)


def source_ref(doc_id: Column) -> Column:
    return F.concat(F.lit(SOURCE), doc_id.cast("string"))


def source_doc(ref: Column) -> Column:
    """The document that a reference names; null if it is none."""
    return F.when(F.startswith(ref, F.lit(SOURCE)) & (F.length(ref) > len(SOURCE)), F.substr(ref, F.lit(len(SOURCE) + 1)))
