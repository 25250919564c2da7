"""White-space handling, templates and JSON helpers."""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.constants import WS_CHARS, WS_RUN


def strip(c: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.btrim(c, F.lit(WS_CHARS))


def tokens(c: Column) -> Column:
    """Words of a line; an array of one empty text for a blank line."""
    return F.split(strip(c), WS_RUN)


def is_blank(c: Column) -> Column:
    """True where a text has nothing but white space."""
    return strip(c) == ""


def once(c: Column, name: str) -> Column:
    """A generated column holding ``c``: filters and projections above read its
    value instead of computing the expression again."""
    return F.explode(F.array(c)).alias(name)


def replace_all(c: Column, pairs: Iterable[tuple[str | Column, str | Column]]) -> Column:
    """Replace literal texts one after the other; a null value leaves the text as it is."""
    for token, value in pairs:
        token = F.lit(token) if isinstance(token, str) else token
        value = F.lit(value) if isinstance(value, str) else F.coalesce(value, token)
        c = F.replace(c, token, value)
    return c


def replace_in_map(options: Column, pairs: Iterable[tuple[str, str | Column]]) -> Column:
    """Replace literal texts in every value of a map column."""
    pairs = list(pairs)
    return F.transform_values(options, lambda _, v: replace_all(v, pairs))


def replace_in_entries(entries: Column, pairs: Iterable[tuple[str, str | Column]]) -> Column:
    """Replace literal texts in every value of an ordered array of (key, value)."""
    pairs = list(pairs)
    return F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"), replace_all(e["value"], pairs).alias("value")
        ),
    )


def fill_tokens(c: Column, values: Mapping[str, str | Column]) -> Column:
    """Fill ``__NAME__`` markers of a configuration text."""
    return replace_all(c, [(f"__{k}__", v) for k, v in values.items()])


def fill(template: str, **values: str | Column) -> Column:
    """A Python ``{name}`` template as one ``concat`` of columns."""
    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value)
    return F.concat(*parts)


def ordered_entries(json_text: Column) -> Column:
    """A JSON object of texts as array<struct<key,value>> in its written order."""
    return F.map_entries(F.from_json(json_text, "map<string,string>"))


def get_or(c: Column, default) -> Column:
    """The value, or a default where it is missing."""
    return F.coalesce(c, F.lit(default))
