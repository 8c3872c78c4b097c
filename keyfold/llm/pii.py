"""Personal data: patterns propose spans, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import text_or_empty
from keyfold.llm.spans import digits_of, find_spans, joined, luhn, mod97, tagged


@dataclass(frozen=True)
class Kind:
    """pattern: Java regular expression; hint: a string that every match holds, or None;
    score without context; words that raise it."""

    name: str
    pattern: str
    hint: str | None
    score: float
    words: tuple[str, ...]


# A run that fails from its start fails from any place in it, so a match begins where a run does
# or where the last match ended; possessive runs keep the search linear. Chains of digits under
# twelve never pass as cards, whole or in part.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, ("mail", "contact", "write")),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, ("ip", "address", "host", "server")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", None, 0.7, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, ("phone", "call", "tel", "mobile")),
)
EXTRA = (Kind("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", None, 0.8, ("iban", "account", "bank", "transfer")),)
KINDS = BASE + EXTRA
#: Characters before and after a span in which context words count, and what one adds.
NEAR, BOOST = 48, 0.35


def _kept(kind: str, span: Column) -> Column:
    digits = digits_of(span.text)
    if kind == "ip":
        return F.forall(F.split(span.text, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(span.text)
    return F.lit(True)


def _proposed(text: Column, kind: Kind) -> Column:
    found = find_spans(text, kind.pattern)
    if kind.hint:
        found = F.when(F.contains(text, F.lit(kind.hint)), found)
    return F.filter(found, lambda s: _kept(kind.name, s))


def _score(text: Column, span: Column) -> Column:
    before = F.greatest(span.start - NEAR, F.lit(0))
    near = F.lower(F.concat_ws(" ", F.substr(text, before + 1, span.start - before), F.substr(text, span.end + 1, F.lit(NEAR))))
    score = F.lit(0.0)
    for k in KINDS:
        heard = F.regexp_like(near, F.lit(r"\b(?:" + "|".join(k.words) + r")\b"))
        score = F.when(span.kind == k.name, F.when(heard, F.least(F.lit(k.score + BOOST), F.lit(1.0))).otherwise(F.lit(k.score))).otherwise(score)
    return score


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: spans are structs (start, place, kind, end, text, score).

    ``start`` and ``end`` are code points, the end exclusive; spans come by start, then in the
    order of KINDS. Each kind's pattern proposes leftmost non-overlapping matches over the whole
    text; a validator drops those that fail (parts over 255, Luhn, mod 97, numbers of digits)
    without a second try. The score is the kind's own, raised where one of its context words
    stands within NEAR characters.

    One pass where rows are read, without a shuffle, in Spark's functions only. Null texts count
    as empty and have no spans; ids may be null or repeated; an empty table gives no rows. Other
    columns are not looked at.
    """
    rows = docs.select(id_col, text_or_empty(text_col).alias("_text"))
    found = [tagged(_proposed(F.col("_text"), k), F.lit(k.name), F.lit(i)) for i, k in enumerate(KINDS)]
    rows = rows.select(id_col, "_text", F.array_sort(F.concat(*found)).alias("_found"))
    return rows.select(
        id_col,
        F.transform(
            "_found",
            lambda s: F.struct(s.start.alias("start"), s.place.alias("place"), s.kind.alias("kind"), s.end.alias("end"), s.text.alias("text"), _score(F.col("_text"), s).alias("score")),
        ).alias("spans"),
    )


def _of(place: int):
    return lambda s: s.place == place


def digest(found: DataFrame, base: tuple[str, ...], id_col: str = "doc_id", *more: Column) -> DataFrame:
    """Counts by base kind, the SHA-256 of base spans, and all spans as text."""
    place = F.filter("spans", lambda s: s.place < len(base))
    return found.select(
        id_col,
        *[F.size(F.filter("spans", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(base)],
        F.sha2(joined(place), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *more,
    )
