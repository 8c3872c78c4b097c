"""Toxicity by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import once_a_worker, text_or_empty, texts

#: Labelled rows of each class that training takes at most, and the longest text it takes, in bytes.
#: Scoring reads all rows and whole texts.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_BYTES = 3000, 6000, 16_000
#: Words of a window, and zstandard's level: below it, matches are missed that the score needs.
WINDOW, LEVEL = 3, 6
#: Bytes of ordinary words that both dictionaries share, and of what is typical of a class.
SHARED, OWN = 8192, 8192
#: Length of the substrings that are counted, occurrences in one text that count, how many times as
#: often a class must have them, and by how many standard errors: training tries each of those.
GRAM, OFTEN, TIMES, APART = 5, 8, 2, (5.0, 6.0, 8.0)
#: Share of the words that hold a typical substring, that must go on alike for it to grow.
MOSTLY = 0.7
#: Bytes by which a dictionary must shorten a window more than the other one does, to be counted.
SHORTER = (2, 3, 4, 5)
THRESHOLD = 0.3
#: Stands before each window and at the end of both dictionaries: what compression costs anyway.
HEAD = b"@#~^`|{}<>=\\_$%*+/?!0123"
#: Stands after each window: zstandard looks for no match in the last eight bytes.
TAIL = bytes(range(1, 9))


def held_out(doc_id: object) -> bool:
    """Rows that training never sees: remainder 2 of the CRC-32 of the id as text."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def windows(text: str, size: int = WINDOW) -> list[str]:
    """Runs of ``size`` lower-cased words, one after another; the last may be shorter."""
    found = text.lower().split()
    return [" ".join(found[i : i + size]) for i in range(0, len(found), size)]


def _grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + GRAM] for i in range(len(w) - GRAM + 1)]


def _counts(sample: list[str]) -> tuple[Counter, Counter]:
    """Of each substring: the sum over texts of its occurrences, OFTEN at most, and of their squares."""
    total, squares = Counter(), Counter()
    for t in sample:
        for g, n in Counter(g for w in t.lower().split() for g in _grams(w)).items():
            n = min(n, OFTEN)
            total[g] += n
            squares[g] += n * n
    return total, squares


def apart(own: tuple[Counter, Counter], n: int, other: tuple[Counter, Counter], m: int) -> dict[str, float]:
    """Substrings that occur at least TIMES as often in the n ``own`` texts as in the m others, from
    both's counts: by how many standard errors."""
    (a, a2), (b, b2), out = own, other, {}
    for g, x in a.items():
        if x >= 5 and x / n >= TIMES * b[g] / m:
            spread = (a2[g] + b2[g]) / (n + m) - ((x + b[g]) / (n + m)) ** 2
            out[g] = (x / n - b[g] / m) / math.sqrt(max(spread, 1e-12) * (1 / n + 1 / m))
    return out


def segments(own: list[str], typical: set[str]) -> list[str]:
    """Runs of words' typical substrings, those of most texts first; none within another.

    A run grows by what stands beside it in at least MOSTLY of the words that hold it.
    """
    found, words = Counter(), Counter()
    for t in own:
        for w in set(t.lower().split()):
            grams, start = _grams(w), None
            for i in range(len(grams) + 1):
                if i < len(grams) and grams[i] in typical:
                    start = i if start is None else start
                elif start is not None:
                    found[f" {w} "[start : i + GRAM - 1]] += 1
                    words[f" {w} "] += 1
                    start = None
    kept: list[str] = []
    for s, n_texts in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if n_texts >= 3 and not any(s in k for k in kept):
            kept.append(_grown(s, words))
    return kept


def _grown(s: str, words: Counter) -> str:
    while True:
        after, before, total = Counter(), Counter(), 0
        for w, n in words.items():
            at = w.find(s)
            if at >= 0:
                total += n
                after[w[at + len(s) : at + len(s) + 1]] += n
                before[w[at - 1] if at else ""] += n
        for c, n, grown in [(*after.most_common(1)[0], s + after.most_common(1)[0][0]), (*before.most_common(1)[0], before.most_common(1)[0][0] + s)]:
            if c and n >= MOSTLY * total:
                s = grown
                break
        else:
            return s


def _packed(parts: list[str], size: int) -> bytes:
    """Most frequent parts last, where references are cheapest; within ``size`` bytes."""
    out, used = [], 0
    for p in parts:
        used += len(p.encode("utf-8", "surrogatepass")) + 1
        if used > size:
            break
        out.append(p.encode("utf-8", "surrogatepass"))
    return b"|".join(reversed(out))


@dataclass(frozen=True)
class Model:
    """Both dictionaries, and the calibration: a constant and a weight for each feature."""

    toxic: bytes
    ordinary: bytes
    constant: float
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.toxic, self.ordinary = map(_compressor, (model.toxic, model.ordinary))

    def distances(self, text: str) -> np.ndarray:
        """Of each window, by how many bytes the toxic dictionary makes it shorter than the ordinary one."""
        found = [b"%b %b %b" % (HEAD, w.encode("utf-8", "surrogatepass"), TAIL) for w in windows(text)]
        if not found:
            return np.zeros(0)
        ordinary, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(found)), float, len(found)) for c in (self.ordinary, self.toxic))
        return ordinary - toxic

    def features(self, batch: list[str]) -> np.ndarray:
        """Of each text: sums of its 1, 2, 4 and 8 greatest distances, their mean, and the numbers of
        windows at SHORTER or more, as they are and to the root of all windows' number."""
        out = np.zeros((len(batch), N_FEATURES))
        if self.model.toxic:
            for row, text in zip(out, batch, strict=True):
                d = self.distances(text)
                if len(d):
                    best = np.sort(d)[::-1]
                    over = [np.count_nonzero(best >= s) for s in SHORTER]
                    row[:] = [*(best[:k].sum() for k in (1, 2, 4, 8)), d.mean(), *over, *(n / math.sqrt(len(d)) for n in over)]
        return out

    def scores(self, batch: list[str]) -> np.ndarray:
        return _sigmoid(self.model.constant + self.features(batch) @ np.array(self.model.weights))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


N_FEATURES = 5 + 2 * len(SHORTER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def dictionaries(toxic: list[str], ordinary: list[str], apart_toxic: dict[str, float], apart_ordinary: dict[str, float], least: float) -> tuple[bytes, bytes]:
    """Both begin with the commonest words of ordinary texts; what is typical of the class follows."""
    seen = Counter(w for t in ordinary for w in set(t.lower().split()))
    shared = _packed([f" {w} " for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))], SHARED)
    own = [_packed(segments(texts_, {g for g, z in found.items() if z >= least}), OWN) for texts_, found in ((toxic, apart_toxic), (ordinary, apart_ordinary))]
    return shared + own[0], shared + own[1]


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from one half of the texts; the other half calibrates the scores and chooses how
    far apart (APART) a dictionary's substrings must be, by the log loss of two-fold predictions.

    With texts of one class or none, every text scores that class's share: 1, 0, or 0 without
    labels.
    """
    if not toxic or not ordinary:
        return Model(b"", b"", 30.0 if toxic else -30.0, (0.0,) * N_FEATURES)
    own, other = toxic[::2], ordinary[::2]
    own_half, other_half = toxic[1::2] or toxic, ordinary[1::2] or ordinary
    y = np.concatenate([np.ones(len(own_half)), np.zeros(len(other_half))])
    a, b, best = _counts(own), _counts(other), None
    more, less = apart(a, len(own), b, len(other)), apart(b, len(other), a, len(own))
    for least in APART:
        plain = Model(*dictionaries(own, other, more, less, least), 0.0, ())
        x = plain.scorer().features([*own_half, *other_half])
        p = np.empty(len(y))
        for fold in (0, 1):
            there = np.arange(len(y)) % 2 == fold
            constant, weights = _logistic(x[~there], y[~there])
            p[there] = _sigmoid(constant + x[there] @ np.array(weights))
        loss = float(-np.mean(np.log(np.where(y == 1, p, 1 - p))))
        if best is None or loss < best[0]:
            constant, weights = _logistic(x, y)
            best = (loss, replace(plain, constant=constant, weights=weights))
    return best[1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """Newton's method on scaled features, a little regularised; gives weights of the raw features."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 0.0
    for _ in range(50):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / scale
    return float(w[0] - raw @ mean), tuple(float(v) for v in raw)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample of labelled rows outside the held-out quarter.

    Takes the TRAIN_TOXIC and TRAIN_ORDINARY ids of least hash in each class, and of each the least
    of its texts of 1 to TRAIN_BYTES bytes. Ids labelled both ways, and null ids and labels, are left
    out; equal texts train once. Ids are bounded, so their broadcast is, and what the driver gathers.
    The sample, and so the model, doesn't depend on the order of rows or tasks.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .where(F.crc32(F.col(id_col).cast("string")) % 4 != 2)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("_toxic"), F.max(label_col).alias("_most"))
        .where("_toxic = _most")
        .drop("_most")
    )
    order = [F.xxhash64("_id"), "_id"]
    sample = known.where("_toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).union(known.where("_toxic = 0").orderBy(*order).limit(TRAIN_ORDINARY))
    rows = (
        docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
        .where(F.octet_length("_text").between(1, TRAIN_BYTES))
        .join(F.broadcast(sample), "_id")
        .groupBy("_id")
        .agg(F.min("_text").alias("_text"), F.min("_toxic").alias("_toxic"))
    )
    found = {(r["_text"], r["_toxic"]) for r in rows.select("_text", "_toxic").collect()}
    found = sorted(found, key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r))
    return train([t for t, y in found if y == 1], [t for t, y in found if y == 0])


def _scored(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once_a_worker(("scorer", model), model.scorer)
        for batch in batches:
            scores, held = [], []
            for t in texts(batch.column(text_col)):
                held.append(t)
                if len(held) == 256:
                    scores.append(scorer.scores(held))
                    held = []
            scores.append(scorer.scores(held))
            yield batch.append_column("score", pa.array(np.concatenate(scores)))

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Windows are runs of WINDOW words. Each is compressed with the dictionary of toxic text and with
    that of ordinary text; by how much shorter the first makes it is its distance. Calibrated
    thresholds count the distant windows of a text, and a logistic function of those counts and of
    the greatest distances is the score. Nothing but the text goes in.

    Null and empty texts score as texts do whose windows are all as long under both dictionaries. Repeated rows score alike; null
    ids are not held out. One pass without a shuffle. Other columns are not looked at.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = slim.mapInArrow(_scored_ids(model), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def _scored_ids(model: Model):
    inner = _scored(model, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            yield batch.select(["id", "score"])

    return run


def keep_ordinary(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold; they stay where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once_a_worker(("scorer", model), model.scorer)
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                keep += (scorer.scores(list(texts(batch.column(text_col).slice(at, 256)))) < threshold).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
