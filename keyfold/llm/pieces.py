"""Texts cut at spaces, each distinct piece once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A letter that stays a letter in lower case and in any normal form, and a mark.
_MARKED = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}][.,]$"
#: Bytes of texts that are cut at a time; bounds a worker's memory.
_STEP = 8_000_000


@dataclass
class Pieces:
    """Pieces of texts: text i has ``which[ends[i]:ends[i + 1]]``, places in ``distinct``.

    ``bare`` are the distinct pieces without a full stop or comma that ends them after a letter;
    piece k is ``bare[bare_of[k]]`` and then ``mark[k]``: 0 nothing, 1 a full stop, 2 a comma.
    """

    ends: np.ndarray
    which: np.ndarray
    distinct: pa.Array
    bare: list[str]
    bare_of: np.ndarray
    mark: np.ndarray


def steps(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about _STEP bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _STEP, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def cut(texts: pa.Array, lower: bool, special: Sequence[str] = ()) -> Pieces:
    """``lower`` folds the case of ASCII pieces, but of none that holds a ``special`` string in any case."""
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten().dictionary_encode()
    distinct = flat.dictionary
    marked = pc.match_substring_regex(distinct, _MARKED).to_numpy(zero_copy_only=False)
    full_stop = pc.ends_with(distinct, ".").to_numpy(zero_copy_only=False)
    bare = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(distinct, 0, -1), distinct)
    if lower:
        folded = pc.ascii_lower(bare)
        fold = pc.string_is_ascii(bare)
        for s in special:
            fold = pc.and_not(fold, pc.match_substring(folded, s.lower()))
        bare = pc.if_else(fold, folded, bare)
    bare = bare.dictionary_encode()
    mark = np.where(marked, np.where(full_stop, 1, 2), 0)
    return Pieces(
        lists.offsets.to_numpy(), flat.indices.to_numpy(), distinct, bare.dictionary.to_pylist(), bare.indices.to_numpy(), mark
    )


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of all starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
