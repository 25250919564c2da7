"""Positions of pattern matches, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512  # items of an array that are worked on together
SPAN = "struct<start:int,end:int,value:string,part:string>"


def empty_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once however often it is named."""
    return F.transform(F.array(value), then)[0]


def _blocks(items: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` items; appending inside one stays cheap."""
    def cut(every: Column) -> Column:
        last = F.floor((F.size(every) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(every, b * BLOCK + 1, F.lit(BLOCK)))

    return F.filter(let(items, cut), lambda block: F.size(block) > 0)


def _running(values: Column, first: Column, step) -> Column:
    """``first``, then the state after each value: as many states as values and one."""
    start = F.struct(first.alias("at"), F.array(first).alias("states"))

    def add(state: Column, value: Column) -> Column:
        now = step(state["at"], value)
        return F.struct(now.alias("at"), F.concat(state["states"], F.array(now)).alias("states"))

    return F.aggregate(values, start, add, lambda s: s["states"])


def sums_before(lengths: Column) -> Column:
    """Per item of an array of numbers the sum of those before it, block by block."""
    plus = lambda a, b: a + b

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), plus))
        starts = _running(totals, F.lit(0), plus)
        inside = let(starts, lambda at: F.transform(blocks, lambda block, i: F.slice(_running(block, F.get(at, i), plus), F.lit(1), F.size(block))))
        return F.flatten(inside)

    return let(_blocks(lengths), placed)


def matches(text: Column, pattern: str, part: int = 0) -> Column:
    """All leftmost, non-overlapping matches of a pattern, as an array of spans.

    ``start`` and ``end`` count code points, end exclusive; ``part`` is the
    given group of the pattern. The text is cut at the matches, and the lengths
    of what lies between and of the matches add up to the positions. Null gives
    no spans.
    """
    cut = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(part)).alias("parts"),
    )

    def placed(x: Column) -> Column:
        lengths = F.transform(x["hits"], lambda hit, i: F.length(hit) + F.length(F.get(x["gaps"], i)))

        def spans(before: Column) -> Column:
            def span(hit: Column, i: Column) -> Column:
                begin = F.get(before, i) + F.length(F.get(x["gaps"], i))
                return F.struct(
                    begin.alias("start"), (begin + F.length(hit)).alias("end"), hit.alias("value"), F.get(x["parts"], i).alias("part")
                )

            return F.transform(x["hits"], span)

        return F.when(F.size(x["hits"]) == 0, empty_spans()).otherwise(let(sums_before(lengths), spans))

    return F.when(text.isNull(), empty_spans()).otherwise(let(cut, placed))


def matches_if(condition: Column, text: Column, pattern: str, part: int = 0) -> Column:
    """As ``matches`` for texts that meet a cheap necessary condition."""
    return F.when(condition, matches(text, pattern, part)).otherwise(empty_spans())


def as_text(kind: str, spans: Column) -> Column:
    """``kind:start:end`` of every span, as an array of texts."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def labelled(kind: str, spans: Column) -> Column:
    """Spans with their kind, for arrays that hold several kinds."""
    return F.transform(
        spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["part"].alias("value"))
    )


def replaced(text: Column, spans: Column, mark) -> Column:
    """A text with spans replaced by ``mark(span)``; null keeps null.

    Spans are taken in the order of their starts. One that begins inside an
    earlier one is cut down to what lies beyond it, and leaves no second mark.
    """
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"])))

    def piece(s: Column, at: Column) -> Column:
        return F.when(s["start"] >= at, mark(s)).otherwise("")

    return F.when(F.size(spans) == 0, text).otherwise(_rewritten(text, ordered, piece))


def blanked(text: Column, spans: Column) -> Column:
    """A text with blanks in place of the spans, so that all positions stay."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def piece(s: Column, at: Column) -> Column:
        return F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))

    return F.when(F.size(spans) == 0, text).otherwise(_rewritten(text, ordered, piece))


def _rewritten(text: Column, ordered: Column, piece) -> Column:
    """The text with ``piece(span, at)`` in the place of each span, ``at`` being where the last one ended.

    Spans are worked on in blocks, each with its own part of the text, so that
    no step reads the text from its beginning.
    """

    def whole(blocks: Column) -> Column:
        furthest = F.transform(blocks, lambda block: F.array_max(F.transform(block, lambda s: s["end"])))

        def joined(at: Column) -> Column:
            parts = F.transform(blocks, lambda block, i: _part(text, block, F.get(at, i), F.get(at, i + 1), piece))
            end = F.element_at(at, -1)
            rest = F.substring(text, end + 1, F.greatest(F.length(text) - end, F.lit(0)))
            return F.array_join(F.concat(parts, F.array(rest)), "")

        return let(_running(furthest, F.lit(0), lambda a, b: F.greatest(a, b)), joined)

    return let(_blocks(ordered), whole)


def _part(text: Column, block: Column, begin: Column, end: Column, piece) -> Column:
    def written(own: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("pieces"))

        def add(state: Column, s: Column) -> Column:
            length = F.greatest(s["start"] - state["at"], F.lit(0))
            before = F.substring(own, state["at"] - begin + 1, length)
            both = F.concat(state["pieces"], F.array(before, piece(s, state["at"])))
            return F.struct(F.greatest(s["end"], state["at"]).alias("at"), both.alias("pieces"))

        return F.aggregate(block, start, add, lambda s: F.array_join(s["pieces"], ""))

    return let(F.substring(text, begin + 1, end - begin), written)
