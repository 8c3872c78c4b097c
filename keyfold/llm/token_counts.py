"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import Memory, encode_joined, in_steps, once_a_worker, text_or_empty
from keyfold.llm.pieces import cut, steps

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Chunks whose counts a Python worker remembers (about 150 MB).
REMEMBERED = 700_000
#: Texts that begin with a space, or have one after white space, are counted whole.
_NOT_PLAIN = r"^ |[\t-\r\x1c-\x20\x{85}\pZ] "


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class _TokenizersCounter:
    """Counts with a tokenizers .json file.

    A byte-level tokenizer never joins across a space that follows another character, so a text
    is cut before such spaces and the counts of pieces are remembered. Other tokenizers, and
    texts that run spaces together, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
        )
        self.known = Memory(REMEMBERED)

    def encode_counts(self, items: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(items, add_special_tokens=False)]

    def counts(self, batch: pa.Array) -> np.ndarray:
        if not self.chunked:
            return np.array([n for some in in_steps(batch) for n in self.encode_counts(some)], np.int64)
        return np.concatenate([np.zeros(0, np.int64), *map(self._piece_counts, steps(batch))])

    def _piece_counts(self, batch: pa.Array) -> np.ndarray:
        whole = pc.match_substring_regex(batch, _NOT_PLAIN).to_numpy(zero_copy_only=False)
        p = cut(batch, lower=False)
        sizes = np.array(self.known.fetch(p.bare, self._bare_counts), np.int64)
        sizes = sizes[p.bare_of] + (p.mark > 0)
        ends = np.concatenate([[0], np.cumsum(sizes[p.which])])
        first = p.which[p.ends[:-1]]
        # the first piece has no space before it
        heads = self.encode_counts(p.distinct.take(pa.array(first)).to_pylist())
        out = ends[p.ends[1:]] - ends[p.ends[:-1]] - sizes[first] + heads
        at = np.flatnonzero(whole)
        if len(at):
            out[at] = [n for some in in_steps(batch.take(pa.array(at))) for n in self.encode_counts(some)]
        return out

    def _bare_counts(self, pieces: list[str]) -> list[int]:
        """Of pieces with a space before them."""
        plain = [" " + c for c in pieces if c.isalnum()]
        found = {}
        for (_, at), k in zip(encode_joined(self.tokenizer, plain, ""), range(0, len(plain), 1000), strict=True):
            found.update(zip(plain[k : k + 1000], map(int.__sub__, at[1:], at), strict=True))
        rest = [" " + c for c in pieces if " " + c not in found]
        found.update(zip(rest, self.encode_counts(rest), strict=True))
        return [found[" " + c] for c in pieces]


class _SentencepieceCounter:
    """Counts with a sentencepiece .model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, batch: pa.Array) -> np.ndarray:
        return np.array([len(ids) for some in in_steps(batch) for ids in self.model.encode(some, num_threads=1)], np.int64)


def counter(path: str) -> _TokenizersCounter | _SentencepieceCounter:
    return _SentencepieceCounter(path) if path.endswith(".model") else _TokenizersCounter(path)


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = once_a_worker(("counter", path), lambda: counter(path))
        for batch in batches:
            n = count.counts(batch.column("content"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(n), pa.string()), batch.column("digest"), pa.array(n, pa.int64())],
                names=["tokenizer", "digest", "n_tokens"],
            )

    return run


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Content is normalised only as far as counts allow: null becomes empty. Its SHA-256 and the
    digest of the tokenizer's file are the key of the cache, a Parquet table at ``cache_path``.
    Digests that the cache lacks are encoded once each and appended; then rows are joined to the
    cache. Two writers may append the same key; readers take one row a key.

    Equal texts get equal counts and repeated rows stay repeated. A null id stays null. An empty
    table gives an empty result. Other columns of ``docs`` are not looked at.

    The cache must not be rewritten while the result is read. ``tokenizer_path`` must be
    readable on every executor.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_path)
    content = text_or_empty(text_col)
    keyed = docs.select(
        F.col(id_col),
        F.unhex(F.sha2(content, 256)).alias("digest"),
        content.alias("content"),
    )
    distinct = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    if _exists(spark, cache_path):
        distinct = distinct.join(_known(spark, cache_path, version), "digest", "left_anti")
    distinct.mapInArrow(_encode(tokenizer_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = _known(spark, cache_path, version)
    sized = keyed.select(id_col, "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return sized.join(known, "digest").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _known(spark, cache_path: str, version: str) -> DataFrame:
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    # coalesce() forgets how the sums are dealt, so that AQE can split a digest that many rows share
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).select(
        F.coalesce("digest", F.lit(b"")).alias("digest"), "n_tokens"
    )


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
