"""Walks of nested JSON of any shape.  Depth is unknown, so these are Arrow-batched Python functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Last parts of keys that hold display ids.
ID_KEYS = ("id", "ids", "display_id", "display_ids", "path_ids", "goal_ids", "start_id", "goal_id")


def _walk(value, path=()):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, (*path, str(k)))
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v, path)
    else:
        yield path, value


def _ids(texts: pd.Series) -> pd.Series:
    def read(text):
        try:
            return [{"path": ".".join(p), "id": v} for p, v in _walk(json.loads(text)) if p and p[-1] in ID_KEYS and isinstance(v, int) and not isinstance(v, bool)]
        except (TypeError, ValueError):
            return None

    return texts.map(read)


def _strings(texts: pd.Series) -> pd.Series:
    def read(text):
        try:
            return [v for _, v in _walk(json.loads(text)) if isinstance(v, str)]
        except (TypeError, ValueError):
            return None

    return texts.map(read)


def ids_in_json(text: Column) -> Column:
    """All whole numbers under keys that name ids, with their paths; null for text that isn't JSON."""
    return F.pandas_udf(_ids, "array<struct<path:string,id:bigint>>")(text)


def strings_in_json(text: Column) -> Column:
    """All strings in a document; null for text that isn't JSON."""
    return F.pandas_udf(_strings, "array<string>")(text)
