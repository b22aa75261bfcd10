"""Fingerprints, hashes and content-addressed names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of the fields in a search document's fingerprint.
DOCUMENT_FIELDS = ["title_bg", "title_en", "description_bg", "description_en", "publisher_label", "tag_labels", "group_labels", "column_labels", "entity_labels"]
KNOWN_EXTENSIONS = ["csv", "json", "geojson", "xml", "xlsx", "xls", "pdf", "zip", "txt", "ndjson"]


def content_fingerprint(fields: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{name}="), F.coalesce(fields[name], F.lit("")), F.lit("\n")) for name in DOCUMENT_FIELDS]
    return F.sha2(F.concat(*lines), 256)


def model_identity(model: Column, dimension: Column) -> Column:
    return F.concat_ws("#", model, dimension.cast("string"))


def dataset_validator(updated_at: Column, version: Column, details: Column) -> Column:
    """What changes when a dataset is published anew: its time and version, else a hash of its details."""
    stamp = F.concat(F.lit("ts:"), updated_at, F.coalesce(F.concat(F.lit("|v:"), version), F.lit("")))
    return F.coalesce(stamp, F.sha2(details, 256))


def metadata_hash(plain: list[Column], *lists: Column) -> Column:
    """Plain fields and order-free lists of one package."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in plain]
    return F.sha2(F.concat_ws("\x1f", *text, *[F.array_join(F.array_sort(x), "\x1e") for x in lists]), 256)


def canonical_list(values: Column) -> Column:
    cleaned = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v != "")
    return F.array_sort(F.array_distinct(cleaned))


def scope_hash(publishers: Column, categories: Column, tags: Column, dataset_ids: Column) -> Column:
    lists = [canonical_list(x).alias(n) for x, n in ((publishers, "publishers"), (categories, "categories"), (tags, "tags"), (dataset_ids, "datasetIds"))]
    every = F.struct(F.lit(True).alias("all"))
    empty = F.size(F.flatten(F.array(*[canonical_list(x) for x in (publishers, categories, tags, dataset_ids)]))) == 0
    return F.sha2(F.when(empty, F.to_json(every)).otherwise(F.to_json(F.struct(*lists))), 256)


def extension_for(declared: Column) -> Column:
    plain = F.lower(declared)
    short = F.substring(F.regexp_replace(plain, "[^a-z0-9]+", ""), 1, 8)
    return F.when(F.coalesce(declared, F.lit("")) == "", "bin").when(plain.isin(KNOWN_EXTENSIONS), plain).when(short == "", "bin").otherwise(short)


def safe_segment(c: Column, longest: int = 128) -> Column:
    """An id as a path segment; one that is unsafe or too long becomes 32 hex digits of its hash."""
    safe = F.rlike(c, F.lit(r"^[A-Za-z0-9_][A-Za-z0-9._-]*$")) & (F.octet_length(c) <= longest)
    return F.when(safe, c).otherwise(F.substring(F.sha2(c, 256), 1, 32))


def raw_path(dataset_id: Column, resource_id: Column, content: Column, declared: Column) -> Column:
    file = F.concat_ws(".", F.sha2(content, 256), extension_for(declared))
    return F.concat_ws("/", safe_segment(dataset_id), safe_segment(resource_id), file)
