"""Hashes of files and folders, and the key of an index's state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import by_name


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stat_hash(modified: Column, size: Column) -> Column:
    """Stand-in for content that is not read."""
    return F.concat_ws(":", F.lit("wt"), F.unix_micros(modified).cast("string"), size.cast("string"))


def hashes_json(hashes: Column) -> Column:
    """A map as JSON with sorted keys, so that equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(hashes))))


def json_file_set(text: Column) -> Column:
    """Keys of a JSON object, sorted without case and joined; null if it is malformed."""
    keys = F.json_object_keys(text)
    return F.when(keys.isNotNull(), F.array_join(by_name(keys), "|"))


def state_key(branch: Column, entries: Column) -> Column:
    """16 hexadecimal digits of the branch and the sorted distinct ``path:hash`` entries."""
    joined = F.array_join(F.array_sort(F.array_distinct(entries)), "\n")
    return F.upper(F.substring(F.sha2(F.concat(branch, F.lit("\n"), joined), 256), 1, 16))
