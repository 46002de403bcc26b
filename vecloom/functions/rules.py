"""Validation and policy expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_all_tags(tags: Column, wanted: list[str]) -> Column:
    """Whether every wanted tag is among a row's tags; no wanted tags hold for every row."""
    out = F.lit(True)
    for t in dict.fromkeys(wanted):
        out = out & F.coalesce(F.array_contains(tags, t), F.lit(False))
    return out


def normal_tags(tags: Column) -> Column:
    """Tags as a sorted set, empty for null."""
    return F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))))


def live(vector: Column, tombstone: Column) -> Column:
    """Rows that can be scored: no tombstone, and a vector with components."""
    return ~F.coalesce(tombstone, F.lit(False)) & (F.coalesce(F.size(vector), F.lit(0)) > 0)


def valid_collection_name(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9_-]{1,128}$") & (name != "CATALOG"), F.lit(False))


def valid_document_id(doc_id: Column) -> Column:
    return F.coalesce((F.length(doc_id) >= 1) & (F.length(doc_id) <= 512) & ~doc_id.rlike(r"[/\\\x00]") & ~doc_id.isin(".", ".."), F.lit(False))


def base_fetch(k: int) -> int:
    """Candidates per source for an unfiltered top-k."""
    return 2 * k + 16


def adaptive_fetch(k: Column, selectivity: Column, ef: Column) -> Column:
    """Candidates per source under a filter: k / selectivity, within [2k + 16, max(ef, 2k + 16)]; 0 for k = 0."""
    base = 2 * k + 16
    want = F.ceil(k / F.greatest(selectivity, F.lit(0.01)))
    return F.when(k == 0, 0).otherwise(F.least(F.greatest(want, base), F.greatest(ef, base))).cast("long")


def size_tier(size: Column, ratio: int = 4) -> Column:
    """floor(log_ratio(size)) by an integer ladder, 0 for sizes of at most 1, at most 62."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    out, power, tier = F.lit(0), ratio, 1
    while power < 1 << 63 and tier <= 62:
        out = F.when(size >= F.lit(power), tier).otherwise(out)
        power, tier = power * ratio, tier + 1
    return out.cast("int")


def row_bytes(row_id: Column, vector: Column, metadata: Column, tags: Column, fixed: int = 0) -> Column:
    """Estimated memory of a row: id, four bytes a component, metadata, tags and a fixed part."""
    tag_bytes = F.aggregate(F.coalesce(tags, F.array().cast("array<string>")), F.lit(0), lambda s, t: s + F.octet_length(t))
    return (F.octet_length(row_id) + 4 * F.coalesce(F.size(vector), F.lit(0)) + F.coalesce(F.octet_length(metadata), F.lit(0)) + tag_bytes + F.lit(fixed)).cast("long")


def percent_encoded(text: Column) -> Column:
    """Text for a path or query: all but letters, digits and - _ . ~ as %XX."""
    out = F.url_encode(text)
    for other, one in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(other), F.lit(one))
    return out


def path_parts(path: Column) -> Column:
    """The parts of a request's path, without empty ones and without its query."""
    return F.filter(F.split(F.regexp_extract(path, "^[^?#]*", 0), "/"), lambda p: p != "")


#: Presets of the graph index: neighbours, beam at build time, beam at search time.
PROFILES = {"low_memory": (8, 50, 32), "balanced": (16, 128, 64), "high_recall": (32, 250, 256), "max_recall": (48, 500, 768)}


def has_all(held: list[str], wanted) -> bool:
    """The rule of `has_all_tags` for one row in memory."""
    return set(wanted) <= set(held)
