"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import string
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import texts

_NO_PUNCTUATION = str.maketrans(dict.fromkeys(string.punctuation, " "))
#: Items and their characters that one broadcast holds at most; more items make more passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
MATCH_COLUMNS = "item_id long, distance int, budget int, n_words int, end_word long"
_built: dict[int, tuple] = {}


def words(text: str) -> list[str]:
    """Lower-cased words; ASCII punctuation counts as space."""
    return text.lower().translate(_NO_PUNCTUATION).split()


def pieces(n_words: int, budget: int) -> list[tuple[int, int]]:
    """(start, end) of budget + 1 pieces of near equal length: one of them has no edit."""
    n = budget + 1
    cuts = [i * n_words // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


class Pattern:
    """A test item for Myers' bit-parallel matching over words."""

    def __init__(self, item_id: int, item: list[str], rate: float) -> None:
        self.item_id, self.words, self.size = item_id, item, len(item)
        self.budget = int(rate * len(item))
        self.masks: dict[str, int] = {}
        for i, w in enumerate(item):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def best(self, window: list[str]) -> tuple[int, int]:
        """Least edit distance of the item to a run of the window's words, and where that ends."""
        full, top = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, score = full, 0, self.size
        least, at = score, 0
        for j, w in enumerate(window, 1):
            eq = self.masks.get(w, 0)
            d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            up = minus | (full & ~(d0 | plus))
            down = plus & d0
            if up & top:
                score += 1
            if down & top:
                score -= 1
            up, down = up << 1 & full, down << 1 & full
            plus = down | (full & ~(d0 | up))
            minus = up & d0
            if score < least:
                least, at = score, j
        return least, at


def automaton(items: list[tuple[int, str]], rate: float, min_words: int):
    """Piece strings to (pattern, start word of the piece), and the patterns."""
    machine, patterns, found = ahocorasick.Automaton(), [], {}
    for item_id, text in items:
        item = words(text)
        if len(item) < max(1, min_words):
            continue
        p = Pattern(item_id, item, rate)
        patterns.append(p)
        for a, b in pieces(p.size, p.budget):
            found.setdefault(f" {' '.join(item[a:b])} ", []).append((p, a, b - a))
    for piece, places in found.items():
        machine.add_word(piece, places)
    if found:
        machine.make_automaton()
    return machine, patterns


def matches(text: str, machine) -> list[tuple[int, int, int, int, int]]:
    """(item_id, distance, budget, n_words, end_word) of the items that the text holds, by item_id.

    Each item is reported once, with its least distance and the first place that has it.
    """
    doc = words(text)
    joined = f" {' '.join(doc)} "
    best: dict[int, tuple] = {}
    tried = set()
    at, seen = 0, 0  # words that end up to character `seen`
    for end, places in machine.iter(joined):
        at += joined.count(" ", seen, end)
        seen = end
        for p, start, size in places:
            first = at - size - start
            if (id(p), first) in tried:
                continue
            tried.add((id(p), first))
            known = best.get(p.item_id)
            if known and known[1] == 0:
                continue
            low = max(0, first - p.budget)
            distance, stop = p.best(doc[low : first + p.size + p.budget])
            if distance <= p.budget and (not known or (distance, low + stop) < (known[1], known[4])):
                best[p.item_id] = (p.item_id, distance, p.budget, p.size, low + stop)
    return [best[i] for i in sorted(best)]


def _machine(shared, rate: float, min_words: int):
    """One automaton a worker and broadcast."""
    key = hash((shared.value[0], rate, min_words))
    if key not in _built:
        _built.clear()
        _built[key] = automaton(shared.value[1], rate, min_words)
    return _built[key]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded size; null ids and texts are left out."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long"), text_col
    )
    block, chars = [], 0
    for item_id, text in rows.orderBy(id_col, text_col).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((item_id, text))
        chars += len(text)
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rate: float = 0.2,
    min_words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, item_id, distance, budget, n_words, end_word): test items that documents hold.

    Text and items become lower-case words without ASCII punctuation. An item of n words may
    differ from a run of a document's words by floor(rate * n) edits (a word put in, left out or
    changed). It is split into one piece more than that, so one piece occurs unchanged: an
    Aho-Corasick automaton over all pieces finds the hits in one pass over a text, and Myers'
    bit-parallel distance verifies the words around each hit.

    The items are the stated query set. They are read in blocks of at most BLOCK_ITEMS items and
    BLOCK_CHARS characters; each block is broadcast and passes over all documents once. There is
    no shuffle, and nothing grows with a group of copies.

    Items under ``min_words`` words, null items and items of null id take no part. A document of
    null id is searched like any other. Null and empty texts
    match nothing; so do all texts when there are no items. Repeated document rows give repeated
    result rows; items repeated under one id give the best match of that id. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {MATCH_COLUMNS}"
    slim = docs.select(id_col, F.col(text_col).alias("text"))
    out = None
    for n, block in enumerate(item_blocks(benchmark, item_id, item_text)):
        part = slim.mapInArrow(_report(_broadcast(spark, n, block), rate, min_words, id_col), schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def _broadcast(spark, n: int, block):
    import uuid

    return spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def _report(shared, rate: float, min_words: int, id_col: str):
    names = [id_col, "item_id", "distance", "budget", "n_words", "end_word"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, patterns = _machine(shared, rate, min_words)
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(texts(batch.column("text"))):
                for m in matches(text, machine) if patterns else ():
                    rows.append(i)
                    found.append(m)
            ids = batch.column(id_col).take(pa.array(rows, pa.int64()))
            columns = [pa.array([m[k] for m in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    return run


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    rate: float = 0.2,
    min_words: int = 5,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item; see ``find_leaks``.

    Rows pass through where they are read: no join, whatever the ids.
    """
    out = docs
    for n, block in enumerate(item_blocks(benchmark, item_id, item_text)):
        shared = _broadcast(docs.sparkSession, n, block)
        out = out.mapInArrow(_clean(shared, rate, min_words, text_col), docs.schema)
    return out


def _clean(shared, rate: float, min_words: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, patterns = _machine(shared, rate, min_words)
        for batch in batches:
            clean = [not patterns or not matches(t, machine) for t in texts(batch.column(text_col))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
