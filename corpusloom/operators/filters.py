"""Metadata filters given as nested dictionaries."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),  # a missing value passes
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$exists": lambda c, v: (c.isNotNull() & (c.cast("string") != "")) == v,
    "$in": lambda c, v: c.isin(list(v)),
    "$contains": lambda c, v: F.contains(c, F.lit(v)),
}


def where(tree: dict[str, Any]) -> Column:
    """A filter such as ``{"$and": [{"year": {"$gte": 2000}}, {"phase": "en"}]}`` as a column.

    Keys of one level hold together; an empty tree passes everything.  Missing
    values fail every comparison but ``$ne``; ``{"doi": {"$exists": True}}`` asks for
    one that is there and not empty.
    """
    parts = []
    for key, value in tree.items():
        if key == "$and":
            parts.append(reduce(lambda a, b: a & b, map(where, value), F.lit(True)))
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, map(where, value), F.lit(False)))
        elif isinstance(value, dict):
            parts += [_COMPARE[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def text_search(query: str, *columns: str) -> Column:
    """Whether any of the columns holds the text, in any case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False)) for c in columns])


def keyword_search(keyword: str, *columns: str) -> Column:
    """Whether the columns, joined by spaces, hold the keyword in any case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(keyword.lower()))


def page_of(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of ``size`` rows in ``order``, counted from 0; beyond the last there is none."""
    return rows.orderBy(*order).offset(page * size).limit(size)
