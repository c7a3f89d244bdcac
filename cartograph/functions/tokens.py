"""Identifier and path tokens as column expressions.  No UDF anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a camel-case name is split, and the delimiters inside a segment.
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
DELIMITER = r"[-_\.]"
PATH_SEPARATOR = r"[/\\]"
QUERY_SEPARATOR = r"[/\\ \t\r\n]"


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def split_camel(name: Column) -> Column:
    """Words of a camel-case name; ASCII letters only, digits never split."""
    return F.split(name, CAMEL)


def split_delimiters(name: Column) -> Column:
    return F.split(name, DELIMITER)


def strip_interface_prefix(name: Column) -> Column:
    """``IService`` to ``Service``: more than two characters, ``I`` before a capital."""
    return F.when((F.length(name) > 2) & name.rlike(r"^I\p{Lu}"), F.substring(name, 2, 2147483647)).otherwise(name)


def segment_tokens(segment: Column) -> Column:
    """Lower-case words of one path segment, in order, repeats kept."""
    words = F.flatten(F.transform(split_delimiters(strip_interface_prefix(segment)), split_camel))
    return F.transform(_filled(words), F.lower)


def path_tokens(path: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(_filled(F.split(path, PATH_SEPARATOR)), segment_tokens)))


def query_tokens(query: Column) -> Column:
    """As for a path, and white space separates too."""
    return F.array_distinct(F.flatten(F.transform(_filled(F.split(query, QUERY_SEPARATOR)), segment_tokens)))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_name_tokens(name: Column) -> Column:
    """Words of a file name without its extension; repeats stay."""
    return segment_tokens(strip_extension(name))


def tokenize_path(path: Column) -> Column:
    return F.array_join(path_tokens(path), " ")


def tokenize_file_name(name: Column) -> Column:
    return F.array_join(file_name_tokens(name), " ")


def path_phrase(path: Column) -> Column:
    """Readable form of a path: prefixes stripped, camel case split, case and repeats kept."""
    parts = F.transform(_filled(F.split(path, PATH_SEPARATOR)), lambda s: split_camel(strip_interface_prefix(s)))
    return F.array_join(F.flatten(parts), " ")


def file_name_phrase(name: Column) -> Column:
    return F.array_join(split_camel(strip_interface_prefix(strip_extension(name))), " ")


def method_words(name: Column) -> Column:
    return split_camel(name)


def method_phrase(name: Column) -> Column:
    """Camel case split only: no prefix is stripped and ``_`` stays."""
    return F.array_join(method_words(name), " ")


def combined_tokens(path: Column, files: Column, methods: Column) -> Column:
    """Distinct tokens of a folder in order: its path, its files, its public methods."""
    of_files = F.flatten(F.transform(files, file_name_tokens))
    of_methods = F.flatten(F.transform(methods, lambda m: F.transform(_filled(method_words(m)), F.lower)))
    return F.array_distinct(F.concat(path_tokens(path), of_files, of_methods))


def embedding_text(path: Column, files: Column, methods: Column) -> Column:
    """The sentence that stands for a folder."""
    of_files = F.array_join(F.transform(files, file_name_phrase), ", ")
    of_methods = F.array_join(F.transform(methods, method_phrase), ", ")
    return F.trim(
        F.concat(path_phrase(path), F.lit(". Files: "), of_files, F.when(F.size(methods) > 0, F.concat(F.lit(". Methods: "), of_methods)).otherwise(F.lit("")))
    )
