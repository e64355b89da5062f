"""Maps of columns merged as dictionaries are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(left: Column, right: Column) -> Column:
    """Both maps' entries; where both have a key the right one's value counts, null or not. A null map has no entries."""
    a, b = F.coalesce(left, right), F.coalesce(right, left)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def with_defaults(values: Column, defaults: Column) -> Column:
    """The map with the defaults of the keys that it hasn't."""
    return merged(defaults, values)
