"""Column builders over object paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The path patterns whose results must be matched.
STRICT_URI = r"^((?<protocol>.*)://)?(?<root>[(\w)-]+)/(?<path>([(\w)-/])+)"
PARTITION = r"\w*=\w*"
STUDY_ID = r"/(GCST\d+)/"

# Accepts dots in the root and any character in the path.
OPEN_URI = r"^((?<protocol>[^/:]*)://)?(?<root>[^/:]+)/(?<path>.+)$"


def _or_error(value: Column, ok: Column, message: str, source: Column, on_error: str) -> Column:
    if on_error == "null":
        return F.when(ok, value)
    if on_error != "raise":
        raise ValueError("on_error is 'raise' or 'null'")
    return F.when(ok, value).otherwise(
        F.when(source.isNotNull(), F.raise_error(F.concat(F.lit(message), source)))
    )


def uri_segments(uri: Column, strict: bool = False, on_error: str = "raise") -> Column:
    """Struct of protocol, root, prefix and filename.

    The strict pattern knows no ``=``, ``?`` or ``%`` in the path and no dot in
    the root, so it cuts a path at the first of them.
    """
    pattern = STRICT_URI if strict else OPEN_URI
    path = F.regexp_extract(uri, pattern, 4)
    pieces = F.split(path, "/")
    protocol = F.regexp_extract(uri, pattern, 2)
    value = F.struct(
        F.when(protocol != "", protocol).alias("protocol"),
        F.regexp_extract(uri, pattern, 3).alias("root"),
        F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), "/").alias("prefix"),
        F.element_at(pieces, -1).alias("filename"),
    )
    return _or_error(value, path != "", "not a valid path: ", uri, on_error)


def partition_key(path: Column, on_error: str = "raise") -> Column:
    """First ``key=value`` folder name of a path."""
    found = F.regexp_extract(F.regexp_replace(path, "/$", ""), PARTITION, 0)
    return _or_error(found, found != "", "no partition in ", path, on_error)


def study_id(path: Column, on_error: str = "raise") -> Column:
    """Study accession that stands between two slashes."""
    found = F.regexp_extract(path, STUDY_ID, 1)
    return _or_error(found, found != "", "no study identifier in ", path, on_error)


def format_of(path: Column) -> Column:
    """json, yaml or text, by suffix."""
    return (
        F.when(path.endswith(".json"), "json")
        .when(path.endswith(".yaml") | path.endswith(".yml"), "yaml")
        .otherwise("text")
    )


def scheme_of(path: Column) -> Column:
    """Storage kind of a path: object_store, local or unsupported."""
    pieces = F.split(path, "://")
    return (
        F.when((F.size(pieces) == 2) & (pieces[0] == "gs"), "object_store")
        .when((F.size(pieces) == 1) | ((F.size(pieces) == 2) & (pieces[0] == "file")), "local")
        .otherwise("unsupported")
    )


def base_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)
