"""Object URIs and file names."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_URI = r"^(?:gs|s3)://([^/]+)(?:/(.+))?"
# Leading dots belong to the name, only the last ending is cut off.
_STEM = r"(?s)^(\.*[^.].*)\.[^.]*$"


def bucket(uri: Column) -> Column:
    """Bucket of a gs or s3 URI; empty text where there is none."""
    return F.regexp_extract(uri, _URI, 1)


def prefix(uri: Column) -> Column:
    """Object path of a gs or s3 URI; empty text where there is none."""
    return F.regexp_extract(uri, _URI, 2)


def to_s3(uri: Column) -> Column:
    return F.replace(uri, F.lit("gs://"), F.lit("s3://"))


def without_scheme(uri: Column) -> Column:
    no_s3 = F.replace(uri, F.lit("s3://"), F.lit(""))
    return F.replace(no_s3, F.lit("gs://"), F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last ending."""
    name = basename(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, _STEM, 1), F.lit("")), name)


def dirname(path: Column) -> Column:
    """Directory part without a trailing slash; the root stays the root."""
    head = F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1)
    return F.when(head.rlike("^/+$"), head).otherwise(F.regexp_replace(head, "/+$", ""))


def parent_path(path: Column) -> Column:
    """The same file name one directory up; null where there is no directory."""
    folder = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    above = F.regexp_extract(folder, r"(?s)^(.*)/[^/]*$", 1)
    name = basename(path)
    return F.when(
        path.contains("/"),
        F.when(above == "", name).otherwise(F.concat(above, F.lit("/"), name)),
    )


def segment(path: Column, index: int) -> Column:
    """The n-th slash-separated part, negative from the end; null when out of range."""
    parts = F.split(path, "/", -1)
    return F.try_element_at(parts, F.lit(index + 1 if index >= 0 else index))


def ancestors(name: Column) -> Column:
    """Every directory text a name lies under, the root as empty text."""
    parts = F.split(name, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def has_extension(name: Column, extensions: Iterable[str]) -> Column:
    """Lower-cased name ends with any of the endings."""
    lowered = F.lower(name)
    return reduce(
        lambda a, b: a | b, [lowered.endswith(e.lower()) for e in extensions]
    )
