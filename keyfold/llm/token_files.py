"""Token ids in binary files: a zstandard frame for each document and a trailing seek table."""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.common import Memory, encode_joined, in_steps, materialize, new_path, once_a_worker, text_or_empty
from keyfold.llm.pieces import cut, gather, steps

# Fixed values of the zstandard seekable format and of skippable frames.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_END = 0x8F92EAB1
CHECKSUMS = 0x80

#: Ids in one frame at most; a longer document takes several frames.
FRAME_IDS = 1 << 22
#: Chunks whose ids a Python worker remembers (about 110 MB).
REMEMBERED = 500_000
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_bytes long"
#: Pre-tokenizer pattern whose tokens hold no white space. Fixed value.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes, without special tokens added.

    Where the tokenizer drops white space before it looks at words, the ids of space-separated
    chunks are remembered; other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.known = Memory(REMEMBERED)
        self.chunked = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda items: model.encode(items, num_threads=1)
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.encode = lambda items: [e.ids for e in tokenizer.encode_batch(items, add_special_tokens=False)]
        with open(path) as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.tokenizer = tokenizer
        # found in raw text, case and all
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.marks = [_bytes(ids) for ids in self.encode([".", ","])]
        self.chunked = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"}
            and [s["type"] for s in pre] == ["Split", "ByteLevel"]
            and (pre[0]["pattern"], pre[0]["behavior"], pre[0]["invert"]) == ({"Regex": _WORDS}, "Removed", True)
            and not pre[1]["use_regex"]
            and not pre[1]["add_prefix_space"]
            and [len(m) for m in self.marks] == [4, 4]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec.get("added_tokens", []))
        )

    def __call__(self, batch: pa.Array) -> Iterator[bytes]:
        if not self.chunked:
            for some in in_steps(batch):
                yield from map(_bytes, self.encode(some))
        else:
            for some in steps(batch):
                yield from self._pieces(some)

    def _pieces(self, batch: pa.Array) -> Iterator[bytes]:
        p = cut(pc.replace_substring(batch, "\n", " "), lower=True, special=self.special)
        known = self.known.fetch(p.bare, self._bare_ids)
        flat = np.frombuffer(b"".join([*known, *self.marks]), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        # each distinct piece: the bare piece's ids and the mark's
        n = np.stack([sizes[p.bare_of], (p.mark > 0).astype(np.int64)], axis=1)
        at = np.stack([starts[p.bare_of], len(flat) - 3 + p.mark], axis=1)
        flat = gather(flat, at.ravel(), n.ravel())
        sizes = n.sum(axis=1)
        starts = np.cumsum(sizes) - sizes
        for i in range(len(p.ends) - 1):
            which = p.which[p.ends[i] : p.ends[i + 1]]
            yield gather(flat, starts[which], sizes[which]).tobytes()

    def _bare_ids(self, pieces: list[str]) -> list[bytes]:
        out = []
        for ids, at in encode_joined(self.tokenizer, pieces, " "):
            raw = _bytes(ids)
            out += [raw[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)]
        return out


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Writer:
    """Writes one file: frames, an index of documents in a skippable frame, the seek table."""

    def __init__(self, sink, level: int = 3) -> None:
        self.sink, self.size, self.frames = sink, 0, []
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.ids, self.counts = [], []
        self.n_tokens = 0

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        step = 4 * FRAME_IDS
        for at in range(0, len(ids) or 1, step):
            raw = ids[at : at + step]
            frame = self.compressor.compress(raw)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self._put(frame)
        self.ids.append(doc_id)
        self.counts.append(-(-max(1, len(ids)) // step))
        self.n_tokens += len(ids) // 4

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], np.uint8)
        index = zstandard.compress(
            np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.counts, "<u4").tobytes() + known.tobytes()
        )
        body = index + struct.pack("<QQ", len(self.ids), len(index) + 24)
        self._put(struct.pack("<II", SKIPPABLE, len(body)) + body)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_END)
        self._put(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class Reader:
    """Reads documents of one file; decompresses only the frames asked for and checks each."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_END or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table_at = size - 17 - 12 * n
        table = source.read_at(size - table_at, table_at)
        if struct.unpack("<II", table[:8]) != (SEEK_TABLE, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(table, "<u4", 3 * n, 8).reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        n_docs, index_size = struct.unpack("<QQ", source.read_at(16, table_at - 16))
        raw = zstandard.decompress(source.read_at(index_size - 24, table_at - index_size + 8)) if n_docs else b""
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs)
        counts = np.frombuffer(raw, "<u4", n_docs, 8 * n_docs)
        self.known = np.frombuffer(raw, np.uint8, n_docs, 12 * n_docs)
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def doc_id(self, i: int) -> int | None:
        return int(self.doc_ids[i]) if self.known[i] else None

    def n_tokens(self, i: int) -> int:
        return int(self.frames[self.first[i] : self.first[i + 1], 1].sum(dtype=np.int64)) // 4

    def ids(self, i: int) -> bytes:
        return b"".join(self.frame(k) for k in range(self.first[i], self.first[i + 1]))

    def documents(self, block: int = 8 << 20) -> Iterator[bytes]:
        """The ids of all documents in order; runs of frames of about ``block`` bytes are read at once."""
        k, at = 0, 0
        parts: list[bytes] = []
        for i in range(len(self)):
            for f in range(self.first[i], self.first[i + 1]):
                if f >= k:
                    at, k = int(self.starts[f]), max(f + 1, int(np.searchsorted(self.starts, self.starts[f] + block, "right")) - 1)
                    held = self.source.read_at(int(self.starts[k]) - at, at)
                a = int(self.starts[f]) - at
                parts.append(self.checked(f, held[a : a + int(self.frames[f, 0])]))
            yield b"".join(parts)
            parts.clear()

    def frame(self, k: int) -> bytes:
        return self.checked(k, self.source.read_at(int(self.frames[k, 0]), int(self.starts[k])))

    def checked(self, k: int, packed: bytes) -> bytes:
        raw = self.decompressor.decompress(packed)
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def find(self, doc_id: int) -> Iterator[int]:
        """Positions of the documents of this id."""
        return (int(i) for i in np.flatnonzero((self.doc_ids == doc_id) & (self.known == 1)))


def _write(folder: str, tokenizer_path: str, end_id: int | None):
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
        files, place = open_fs(path)
        writer = encode = None
        for batch in batches:
            if writer is None:
                encode = once_a_worker(("encoder", tokenizer_path), lambda: Encoder(tokenizer_path))
                files.create_dir(os.path.dirname(place), recursive=True)
                sink = files.open_output_stream(place, compression=None)
                writer = Writer(sink)
            ids = batch.column("id").to_pylist()
            for doc_id, raw in zip(ids, encode(batch.column("text")), strict=True):
                writer.add(doc_id, raw + end)
        if writer:
            writer.close()
            sink.close()
            row = {"part": part, "path": path, "n_docs": len(writer.ids), "n_tokens": writer.n_tokens, "n_bytes": writer.size}
            schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
            yield pa.RecordBatch.from_pylist([row], schema)

    return run


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    ordered: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Write the ids of all rows to files under ``folder``; returns the manifest, a row a file.

    With ``ordered``, rows are dealt by ranges of the id and sorted, so files in the order of
    ``part`` hold ascending ids (null first, equal ids by text hash). Without, the order of rows
    and partitions is kept, as after a global shuffle.

    Each document is one zstandard frame (or more, beyond FRAME_IDS ids) that decompresses on
    its own. An index of ids follows in a skippable frame, then the seek table of zstandard's
    seekable format with the low 32 bits of each frame's XXH64. A task attempt writes a file of
    its own name; only attempts that Spark commits come into the manifest, so retried and
    speculative tasks do no harm.

    Null and empty texts have no ids but the end id. Empty tables give no files. Repeated rows
    are written each. Other columns are not looked at. ``folder`` is a path that pyarrow's file
    systems open on every executor (local or shared mount, HDFS, S3, GCS).
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    if ordered:
        n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tie = F.xxhash64("text")
        slim = slim.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    return materialize(slim.mapInArrow(_write(folder, tokenizer_path, end_id), MANIFEST), "token-manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for row in batch.to_pylist():
            files, place = open_fs(row["path"])
            with files.open_input_file(place) as source:
                reader = Reader(source)
                start, out = row["start"], []
                for i, raw in enumerate(reader.documents()):
                    out.append((reader.doc_id(i), start, len(raw) // 4, zlib.crc32(raw)))
                    start += len(raw) // 4
                    if len(out) == 50_000 or i == len(reader) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                        out = []


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    ``start`` counts the ids of all documents before it, over files in the order of ``part``.
    What comes to the driver is the manifest, a row for each file. An empty manifest gives no
    rows; a damaged frame raises.
    """
    rows, start = [], 0
    for r in manifest.orderBy("part").collect():
        rows.append((r["part"], r["path"], start))
        start += r["n_tokens"]
    files = spark.createDataFrame(rows, "part int, path string, start long")
    if len(rows) > 1:
        files = files.repartitionByRange(len(rows), "part")
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return new_path(spark, "token-files")
