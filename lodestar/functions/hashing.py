"""Canonical JSON and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in sorted order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def facts_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def sorted_map(value: Column) -> Column:
    """A map with its entries in key order, so its JSON is canonical."""
    return F.map_from_entries(F.array_sort(F.map_entries(value)))


def stable_index(text: Column, size: int) -> Column:
    """The first eight hexadecimal digits of the MD5 digest, modulo the size."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(size))


def hash_bucket(text: Column, buckets: int = 32) -> Column:
    """The SHA-256 digest modulo a power of two up to 256."""
    return F.pmod(F.conv(F.right(F.sha2(text, 256), F.lit(2)), 16, 10).cast("long"), F.lit(buckets))


def contract_hashes(identity: dict[str, Column], truth: dict[str, Column], prompt: Column) -> dict[str, Column]:
    """Digests of who a question is, of its answer, of its wording, and of all three."""
    parts = {"identity_hash": facts_hash(**identity), "truth_hash": facts_hash(**truth), "prompt_hash": F.sha2(prompt, 256)}
    return parts | {"contract_hash": F.sha2(F.concat_ws(":", *parts.values()), 256)}
