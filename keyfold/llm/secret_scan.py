"""Secret scans through a trigram index."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import Scratch, materialize, text_or_empty
from keyfold.llm.spans import find_spans, let, tagged
from keyfold.llm.trigrams import flat, query_of

#: Candidates up to this many rows, and rules over all of them, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_RULES = 1_000_000, 4_000_000
#: Characters of a text that give one list of trigrams; longer texts give several.
PIECE = 1 << 16
#: Trigrams that are asked for one by one where postings are read.
ROW_TESTS = 100
#: Every run of three ASCII characters, overlapping ones too.
_TRIGRAMS = r"(?s)(?=([\x00-\x7f]{3}))"


@dataclass(frozen=True)
class Rule:
    """pattern: Java regular expression; of a match, the ``group`` must have ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def query(self) -> object:
        return query_of(self.pattern)


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
)
EXTRA = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[pos]_[A-Za-z0-9]{36}"),
    Rule("chat_host", "xox[abp]-[0-9A-Za-z-]{10,}"),
)
RULES = BASE + EXTRA


@dataclass(frozen=True)
class Index:
    """``rows`` (num, key): numbered rows and the keys of their texts. ``postings`` (trigram, part,
    nums): in order of trigrams within a file, the rows of a part that hold it, in lower case."""

    rows: DataFrame
    postings: DataFrame


def _key(id_col: str) -> Column:
    """Key of a row's text; equal keys of different texts only make more candidates."""
    return F.xxhash64(F.col(id_col), F.col("_text"))


def build_index(docs: DataFrame, keep: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings of all ASCII trigrams of all rows, for any rules.

    A part is what one task read, so a posting list is summed up before the shuffle and no longer
    than a part has rows, however common its trigram; the parts of a common trigram are dealt to
    different tasks. Tables last as long as ``keep``.
    """
    rows = docs.select(id_col, text_or_empty(text_col).alias("_text"))
    rows = rows.select(F.monotonically_increasing_id().alias("num"), _key(id_col).alias("key"), F.lower("_text").alias("_folded"))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("_folded") - 1, F.lit(0)) / PIECE).cast("int"))
    pieces = F.when(F.length("_folded") <= PIECE, F.array("_folded")).otherwise(
        F.transform(starts, lambda i: F.substr(F.col("_folded"), i * PIECE + 1, F.lit(PIECE + 2)))
    )
    found = F.transform(pieces, lambda p: F.array_distinct(F.regexp_extract_all(p, F.lit(_TRIGRAMS), F.lit(1))))
    # numbered once, in the table that is read from here on
    rows = keep(rows.select("num", "key", found.alias("found")), "trigrams-of-rows")
    held = rows.select("num", F.explode("found").alias("some")).select("num", F.explode("some").alias("trigram"))
    # a part is the high bits of num, and a row's place in it the low 33
    part, place = F.shiftright("num", 33).cast("int"), F.col("num").bitwiseAND(F.lit((1 << 33) - 1)).cast("int")
    postings = held.groupBy("trigram", part.alias("part")).agg(F.collect_list(place).alias("places"))
    return Index(rows.select("num", "key"), keep(postings.sortWithinPartitions("trigram"), "postings"))


def _equals_one(column: str, values: list[str]) -> Column:
    """As isin(), in a form that Spark hands to Parquet for more than ten values. Beyond ROW_TESTS it
    hands on their bounds, and all rows between them are tested by hash."""
    if len(values) > ROW_TESTS:
        return F.col(column).isin(values)
    tests = [F.col(column) == v for v in values] or [F.lit(False)]
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def _data(rows: list[dict], kind: str) -> Column:
    """Rules as one literal, so that plans don't grow with their number."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def candidates(index: Index, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): texts whose postings satisfy a rule's query, with the places of those rules.

    The postings of the trigrams that queries name are read, and no others. Rows that stand in
    several come together, and each rule's query, with its ands and ors, intersects and unites them.
    """
    asked = [{"rule": i, "all": flat(r.query)} for i, r in enumerate(rules)]
    asked = [a for a in asked if a["all"]]
    wanted = sorted({t for a in asked for ways in a["all"] for way in ways for t in way})
    named_ = index.postings.where(_equals_one("trigram", wanted))
    entries = named_.select("trigram", "part", F.explode("places").alias("place"))
    num = F.shiftleft(F.col("part").cast("long"), 33) + F.col("place")
    held = entries.groupBy(num.alias("num")).agg(F.collect_set("trigram").alias("held"))
    has = lambda way: F.forall(way, lambda t: F.array_contains(F.col("held"), t))
    met = F.filter(_data(asked, "rule int, all array<array<array<string>>>"), lambda a: F.forall(a["all"], lambda ways: F.exists(ways, has)))
    hits = held.select("num", F.explode(F.transform(met, lambda a: a.rule)).alias("rule"))
    # repeated rows share a key
    hits = index.rows.join(hits, "num")
    return hits.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _kept(spans: Column, pattern: Column, group: Column, least: Column) -> Column:
    return F.filter(spans, lambda s: F.length(F.call_function("regexp_extract", s.text, pattern, group)) >= least)


def _by_query(text: Column, rules: tuple[Rule, ...], hits: Column) -> Column:
    """Spans of the rules that a row is a candidate of. Rules are data here, so there may be many."""
    table = _data([asdict(r) for r in rules], "name string, pattern string, group int, least int")

    def spans(i: Column) -> Column:
        return let(F.element_at(table, i + 1), lambda r: tagged(_kept(find_spans(text, r.pattern), r.pattern, r["group"], r.least), r["name"], i))

    return F.flatten(F.transform(F.coalesce(hits, F.array().cast("array<int>")), spans))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row: spans are structs (start, place, kind, end, text).

    ``start`` and ``end`` are code points, the end exclusive; spans come by start, then in the
    order of rules. Each rule finds leftmost non-overlapping matches and drops those whose group is
    too short.

    A Boolean trigram query is derived from each rule's regular expression. An inverted index of
    all trigrams is written to the shared folder; queries intersect its postings; the rows that are
    left (checked in size before a broadcast, else joined by key) are verified with the regular
    expression. Rules without trigrams that must occur scan all texts. Spark's functions only;
    texts stay where they are read unless candidates are too many to broadcast. Rules and
    trigrams may be any number.

    Null texts count as empty and have no spans; ids may be null or repeated; an empty table
    gives no rows. Other columns are not looked at.
    """
    with Scratch(docs.sparkSession) as keep:
        index = build_index(docs, keep, id_col=id_col, text_col=text_col)
        hits = materialize(candidates(index, rules), "trigram-hits")
    size = hits.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("rules")).alias("rules")).first()
    if size["n"] <= BROADCAST_ROWS and (size["rules"] or 0) <= BROADCAST_RULES:
        hits = F.broadcast(hits)
    rows = docs.select(id_col, text_or_empty(text_col).alias("_text"))
    rows = rows.withColumn("key", _key(id_col)).join(hits, "key", "left")
    text = F.col("_text")
    found = [_by_query(text, rules, F.col("rules"))]
    for i, r in enumerate(rules):
        if not flat(r.query):
            found.append(tagged(_kept(find_spans(text, r.pattern), F.lit(r.pattern), F.lit(r.group), F.lit(r.least)), F.lit(r.name), F.lit(i)))
    return rows.select(id_col, F.array_sort(F.concat(*found)).alias("spans"))
