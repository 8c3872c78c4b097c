"""Exact top-k search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.llm.common import materialize

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1
#: Packed queries up to this size are broadcast.
BROADCAST_BYTES = 32_000_000
_PACKED = "ids binary, terms binary, weights binary, starts binary"


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, weights array<bigint>): floor(scale * component) of each component as a double.

    Rows with a null id or vector, or with a null or non-finite component, are left out, as are
    rows with a component beyond a long after scaling.
    """
    # floor() makes a long, 0 of NaN, so components are tested before it
    raw = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(raw, lambda v: F.floor(v * F.lit(scale)).cast("double"))
    good = finite & F.forall(x, lambda v: F.abs(v) < F.lit(2.0**63))
    return (
        vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & good)
        .select("id", F.transform("x", lambda v: v.cast("long")).alias("weights"))
    )


def _pack(rows_per_block: int):
    """Rows to inverted blocks: for each term the rows that have it and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_block):
                part = batch.slice(at, rows_per_block)
                ids.append(part.column("id").to_numpy(zero_copy_only=False))
                rows.append(part.column("weights"))
                held += part.num_rows
                if held >= rows_per_block:
                    yield _block(np.concatenate(ids), rows)
                    ids, rows, held = [], [], 0
        if held:
            yield _block(np.concatenate(ids), rows)

    return run


def _block(ids: np.ndarray, parts: list[pa.Array]) -> pa.RecordBatch:
    weights = pa.chunked_array(parts).combine_chunks()
    if isinstance(weights, pa.ChunkedArray):
        weights = pa.concat_arrays(weights.chunks)
    flat = weights.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(weights.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    there = flat != 0
    row, term, flat = row[there], term[there], flat[there]
    order = np.lexsort((row, term))
    row, term, flat = row[order], term[order], flat[order]
    names, first = np.unique(term, return_index=True)
    # rows of a block and most weights fit 32 bits; the last byte says how wide the weights are
    wide = np.int32 if not len(flat) or np.abs(flat.astype(float)).max() < 2**31 else np.int64
    packed = [
        ids.astype(np.int64).tobytes(),
        names.astype(np.int64).tobytes(),
        row.astype(np.int32).tobytes() + flat.astype(wide).tobytes() + bytes([np.dtype(wide).itemsize]),
        np.append(first, len(row)).astype(np.int64).tobytes(),
    ]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], names=["ids", "terms", "weights", "starts"])


def _unpack(ids: bytes, terms: bytes, weights: bytes, starts: bytes):
    ids_, terms_, starts_ = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (ids, terms, starts))
    n, wide = int(starts_[-1]), {4: np.int32, 8: np.int64}[memoryview(weights)[-1]]
    rows, values = np.frombuffer(weights, np.int32, n), np.frombuffer(weights, wide, n, 4 * n).astype(np.int64)
    lists = {}
    for k, t in enumerate(terms_):
        a, b = starts_[k], starts_[k + 1]
        lists[int(t)] = (rows[a:b], values[a:b])
    return ids_, lists


def _scores(queries, candidates, dtype) -> np.ndarray:
    """Inner products, query by candidate: each query term scatters its weighted postings."""
    q_ids, q_lists = queries
    c_ids, c_lists = candidates
    scores = np.zeros((len(q_ids), len(c_ids)), dtype)
    one = int if dtype is object else dtype
    for term, (q_rows, q_weights) in q_lists.items():
        if term not in c_lists:
            continue
        rows, weights = c_lists[term]
        weights = weights.astype(dtype)
        full = len(rows) == len(c_ids)
        for q, w in zip(q_rows, q_weights, strict=True):
            if full:
                scores[q] += weights * one(w)
            else:
                scores[q, rows] += weights * one(w)
    return scores


def _most(lists) -> int:
    return max((abs(int(w)) for _, (_, values) in lists.items() for w in (values.min(), values.max())), default=0)


def _exact_scores(queries, candidates) -> np.ndarray:
    """int64 where sums fit; else Python integers, held within a long at the end."""
    bound = _most(queries[1]) * _most(candidates[1]) * max(1, min(len(queries[1]), len(candidates[1])))
    if bound < 2**24:
        return _scores(queries, candidates, np.float32).astype(np.int64)
    if bound < 2**31:
        return _scores(queries, candidates, np.int32).astype(np.int64)
    if bound < 2**63:
        return _scores(queries, candidates, np.int64)
    return np.clip(_scores(queries, candidates, object), LONG_MIN, LONG_MAX).astype(np.int64)


_NAMES = ("ids", "terms", "weights", "starts")
_FOUND = "query_id long, vec_id long, score long"


def _best(queries, candidates, k: int, queries_per_step: int = 64) -> Iterator[pa.RecordBatch]:
    out = [[], [], []]
    for at in range(0, len(queries[0]), queries_per_step):
        for x, y in zip(out, _step(queries, candidates, at, queries_per_step, k), strict=True):
            x.append(y)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])


def _best_of_pairs(k: int):
    """Rows of a query block and a candidate block; two are unpacked at a time, however many a batch holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = ([batch.column(f"{side}{x}")[i].as_buffer() for x in _NAMES] for side in ("q_", ""))
                yield from _best(_unpack(*q), _unpack(*c), k)

    return run


def _best_of_shared(shared, block: int, k: int):
    """Candidates, block by block, against all query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in _pack(block)(batches):
            candidates = _unpack(*[packed.column(x)[0].as_buffer() for x in _NAMES])
            for q in shared.value:
                yield from _best(_unpack(*q), candidates, k)

    return run


def _step(queries, candidates, at: int, n: int, k: int):
    ids, lists = queries
    part = {}
    for term, (rows, weights) in lists.items():
        a, b = np.searchsorted(rows, [at, at + n])
        if b > a:
            part[term] = (rows[a:b] - at, weights[a:b])
    q_ids, c_ids = ids[at : at + n], candidates[0]
    scores = _exact_scores((q_ids, part), candidates)
    found = ([], [], [])
    for q, q_id in enumerate(q_ids):
        s = scores[q]
        other = np.flatnonzero(c_ids != q_id)
        if len(other) > k:
            x = s[other]
            least = np.partition(x, len(x) - k)[len(x) - k]
            other = other[x >= least]
        best = other[np.lexsort((c_ids[other], ~s[other]))][:k]
        found[0].append(np.full(len(best), q_id))
        found[1].append(c_ids[best])
        found[2].append(s[best])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 10,
    *,
    query_id: str = "vec_id",
    query_vector: str = "embedding",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    query_block: int = 512,
    block: int = 16_384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` candidates of highest inner product.

    Vectors become sparse rows of integer weights. Candidates are packed, where they are read,
    into inverted blocks of at most ``block`` rows; queries likewise. Query blocks up to
    BROADCAST_BYTES go to where candidates are read; more of them meet candidate blocks by lanes of
    a keyed join, a pair of blocks a row. No more than two blocks are unpacked at a time. For each
    pair every query term scatters its weight times the term's postings into a dense array of
    scores, a partition picks the ``k`` best, and a ranking over blocks merges them.

    Ties go to the smaller id. A query never meets candidates of its own id. Where fewer than
    ``k`` candidates exist, all come. Vectors of different lengths meet in their common terms;
    an empty vector scores 0 with all. Repeated candidate rows are candidates each; equal
    query rows are one query, and different query rows of one id share one ranking. Vectors that
    are null, or hold null or non-finite components, take no part. Scores beyond a long are
    held at its bounds. Other columns are not looked at.
    """
    spark = candidates.sparkSession
    q = materialize(quantise(queries, query_id, query_vector, scale).distinct().mapInArrow(_pack(query_block), _PACKED), "query-blocks")
    size = q.agg(F.sum(sum(F.octet_length(x) for x in _NAMES))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast([tuple(bytes(r[x]) for x in _NAMES) for r in q.collect()])
        found = quantise(candidates, id_col, vector_col, scale).mapInArrow(_best_of_shared(shared, block, k), _FOUND)
    else:
        c = materialize(quantise(candidates, id_col, vector_col, scale).mapInArrow(_pack(block), _PACKED), "candidate-blocks")
        lanes = max(1, min(c.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        c = c.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))
        q = q.select(*[F.col(x).alias(f"q_{x}") for x in _NAMES], every.alias("lane"))
        found = c.join(q.hint("merge"), "lane").drop("lane").mapInArrow(_best_of_pairs(k), _FOUND)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_query))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
