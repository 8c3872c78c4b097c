"""Substring dedup: seeds from winnowing, extended to windows, merged to maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import delete_path, materialize, release, stored, text_or_empty, texts

#: Words of a seed. A run of LENGTH words holds LENGTH - SEED + 1 seeds and picks one of them.
SEED = 5
LENGTH = 13
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.zeros(0, np.uint64)
_POWERS = np.cumprod(np.full(1024, 0xA24BAED4963EE407, np.uint64), dtype=np.uint64)


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def runs_of_words(h: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    n = len(h) - size + 1
    out = h[:n].copy()
    for i in range(1, size):
        out *= factor
        out += h[i : i + n]
    out ^= out >> np.uint64(29)
    out *= _Q
    out ^= out >> np.uint64(32)
    return out


def seed_runs(h: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of ``length`` words that picked one and the same seed.

    Gives each run's first window, number of windows, anchor (the seed's hash) and context (a hash
    of all its words), and the hashes of all windows.
    """
    seeds = runs_of_words(h, seed, _P)
    windows = np.lib.stride_tricks.sliding_window_view(seeds, length - seed + 1)
    place = windows.argmin(axis=1) + np.arange(len(windows))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    n = np.diff(np.append(first, len(place)))
    wins = runs_of_words(h, length, _Q)
    nth = np.arange(len(wins)) - np.repeat(first, n)
    context = np.add.reduceat(wins * _POWERS[nth], first) ^ (n.astype(np.uint64) * _P)
    return first, n, seeds[place[first]], context, wins


def _anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in texts(batch.column("text")):
                h = word_hashes(t.encode("utf-8", "surrogatepass").split())
                found.append(np.unique(seed_runs(h, length, seed)[2]) if len(h) >= length else _NONE)
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            anchors = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([anchors, batch.column("id").take(rows)], names=["anchor", "id"])

    return run


def _extend(length: int, seed: int, single: bool):
    """Extends the anchors asked for to the runs of windows that picked them, or the ``single`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "win", "id", "th", "at"] if single else ["anchor", "context", "id", "th", "at", "n"]
        for batch in batches:
            sizes, found = [], []
            for t, asked in zip(texts(batch.column("text")), batch.column("anchors"), strict=True):
                h = word_hashes(t.encode("utf-8", "surrogatepass").split())
                if len(h) < length:
                    sizes.append(0)
                    continue
                first, n, anchor, context, wins = seed_runs(h, length, seed)
                own = np.isin(anchor.view(np.int64), asked.values.to_numpy())
                if single:
                    at = np.flatnonzero(np.repeat(own, n))
                    found.append((np.repeat(anchor[own], n[own]), wins[at], at))
                else:
                    found.append((anchor[own], context[own], first[own], n[own]))
                sizes.append(len(found[-1][0]))
            if found:
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                ids = [batch.column(c).take(rows) for c in ("id", "th")]
                hashes = [pa.array(c.view(np.int64)) for c in columns[:2]]
                yield pa.RecordBatch.from_arrays([*hashes, *ids, *[pa.array(c, pa.int32()) for c in columns[2:]]], names=names)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _clear(df: DataFrame, *names: str) -> DataFrame:
    """Hides how sums are dealt, so that a join deals both sides and AQE can split hot keys."""
    return df.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in names})


def find_repeats(docs: DataFrame, *, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, runs): for each text (by id and hash) runs (at, n) of windows that a smaller id has.

    Winnowing picks anchors: each window of ``length`` words picks its least seed of ``seed``
    words, so equal windows pick equal seeds. Anchors join documents; those of one document go.
    Shared anchors are extended both ways over all windows that picked them. Runs of windows that
    agree from end to end with a smaller id's are repeats as a whole; of the others the least id
    of each run stands for it and meets the rest window by window. Windows meet by the hashes of
    anchor and window, 128 bits. ``maximal`` merges windows to maximal repeats.

    No pairs are made: anchors, runs and windows are summed to their least ids, map side first,
    and joined back, so a passage that a third of all rows share costs its own rows only. Each
    step is written to the shared folder; what is no longer needed is deleted.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col).where("id IS NOT NULL")
    anchors, path = stored(keyed.mapInArrow(_anchors(length, seed), "anchor long, id long"), "anchors")
    shared, shared_path = stored(
        anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"), "shared-anchors"
    )
    release(spark)
    suspects = materialize(anchors.join(shared, "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "suspects")
    delete_path(spark, path)
    delete_path(spark, shared_path)
    release(spark)
    runs = materialize(
        keyed.join(suspects, "id").mapInArrow(_extend(length, seed, False), "anchor long, context long, id long, th long, at int, n int"), "runs"
    )
    release(spark)
    least = materialize(runs.groupBy("anchor", "context").agg(F.min("id").alias("least")), "least-of-runs")
    several = least.groupBy("anchor").count().where("count > 1").select("anchor")
    judged = runs.join(_clear(least, "anchor", "context"), ["anchor", "context"])
    first = judged.where("id = least").select("anchor", "id").join(_clear(several, "anchor"), "anchor", "left_semi")
    asked = materialize(first.groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "asked")
    release(spark)
    windows, path = stored(
        keyed.join(asked, "id").mapInArrow(_extend(length, seed, True), "anchor long, win long, id long, th long, at int"), "windows"
    )
    release(spark)
    of_windows = windows.groupBy("anchor", "win").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor", "win", "a")
    single = windows.join(_clear(of_windows, "anchor", "win"), ["anchor", "win"]).where("id > a").select("id", "th", "at", F.lit(1).alias("n"))
    single = materialize(single, "single-repeats")
    delete_path(spark, path)
    release(spark)
    whole = judged.where("id > least").select("id", "th", "at", "n")
    found = materialize(whole.union(single).groupBy("id", "th").agg(F.collect_set(F.struct("at", "n")).alias("runs")), "repeats")
    release(spark)
    return found


def maximal(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Sorted window starts to maximal runs of words (start, end)."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > length) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(starts)]]) - 1
    return [(int(starts[a]), int(starts[b]) + length) for a, b in zip(first, last, strict=True)]


def _starts(runs: pa.StructArray) -> np.ndarray:
    """Windows of runs (at, n)."""
    at, n = (runs.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return np.unique(np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum()))


def _remove(length: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, gone, kept = [], [], []
            for t, own in zip(texts(batch.column("text")), batch.column("runs"), strict=True):
                found = t.encode("utf-8", "surrogatepass").split()
                words.append(len(found))
                runs = maximal(_starts(own.values), length) if own.is_valid else []
                gone.append(sum(b - a for a, b in runs))
                for a, b in reversed(runs):
                    del found[a:b]
                left = b" ".join(found)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass"))
            columns = [pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept) for every row; kept words are joined by one space.

    Words are runs without ASCII white space, unchanged. A word goes if a window of ``length``
    words that covers it also starts in a text of a smaller id; windows are judged on the input.
    ``digest`` gives the SHA-256 of the kept text instead of the text.

    Null texts count as empty. Texts under ``length`` words lose nothing. Repeated rows, which
    share an id, don't remove each other and come out repeated. Rows of null ids lose nothing and
    remove nothing. An empty table gives an empty result. Other columns are not looked at.
    """
    repeats = find_repeats(docs, length=length, seed=seed, id_col=id_col, text_col=text_col)
    rows = _keyed(docs, id_col, text_col).join(repeats, ["id", "th"], "left").select("id", "text", "runs")
    return rows.mapInArrow(_remove(length, digest), "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
