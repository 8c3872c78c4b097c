"""Spans of regular expressions in texts, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,text:string>"
#: Matches whose positions are added up together; keeps the work for a text linear.
_CHUNK = 256


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,text>>: leftmost non-overlapping matches, none of them empty.

    Positions are code points, the end exclusive. A text is cut at the matches; the lengths of
    what lies between and of the matches add up to positions, first within chunks of matches,
    then over chunks.
    """

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def positions(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
        sized = F.transform(found, lambda m, i: F.struct(i.alias("i"), m.alias("m"), F.char_length(m).alias("n")))
        return let(gaps, lambda g: _placed(sized, g))

    def _placed(sized: Column, gaps: Column) -> Column:
        steps = F.transform(sized, lambda m: F.struct(F.element_at(gaps, m.i + 1).alias("gap"), m.m.alias("m"), m.n.alias("n")))
        return let(steps, _summed)

    return F.when(
        F.regexp_like(text, pattern),
        let(F.regexp_extract_all(text, pattern, F.lit(0)), positions),
    ).otherwise(F.lit(None).cast(f"array<{SPAN}>"))


def _summed(steps: Column) -> Column:
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")),
        lambda k: F.slice(steps, k * _CHUNK + 1, F.lit(_CHUNK)),
    )

    def placed(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s.gap + s.n))
        return let(
            sizes,
            lambda sizes: F.flatten(
                F.transform(
                    chunks,
                    lambda c, k: _in_chunk(c, F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, n: a + n)),
                )
            ),
        )

    return let(chunks, placed)


def _in_chunk(steps: Column, base: Column) -> Column:
    start = F.struct(base.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        span = F.struct((a.at + s.gap).alias("start"), (a.at + s.gap + s.n).alias("end"), s.m.alias("text"))
        return F.struct((a.at + s.gap + s.n).alias("at"), F.concat(a.out, F.array(span)).alias("out"))

    return F.aggregate(steps, start, step, lambda a: a.out)


def tagged(spans: Column, kind: Column, order: Column) -> Column:
    """Spans with their kind and its place in the list of kinds, never null."""
    return F.coalesce(
        F.transform(
            spans,
            lambda s: F.struct(
                s.start.alias("start"), order.cast("int").alias("place"), kind.alias("kind"), s.end.alias("end"), s.text.alias("text")
            ),
        ),
        F.array().cast("array<struct<start:int,place:int,kind:string,end:int,text:string>>"),
    )


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")),
        ),
        ",",
    )


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn checksum."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10: first four characters to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(text, 5, 1000), F.substring(text, 1, 4))

    def step(a: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1
