"""SimHash near-duplicates by tiled exact comparison, and by SimHash candidates with exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyfold.llm.common import Scratch, connected_components, delete_path, free_name, materialize, release, stored, text_or_empty, texts
from keyfold.llm.pieces import gather

SEED = 42
#: Distinct fingerprints of one lane that a tile takes; a fuller lane is cut into more tiles.
TILE = 4096
#: Rows and columns of one comparison in numpy.
STEP = 256


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words of the text with A-Z lower-cased, repeats included."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - size + 1)
    a, b = starts[:n].tolist(), ends[size - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, n)


def more_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words): the hashes and further ones mixed from them."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def simhash(text: str, size: int, words: int = 1) -> np.ndarray:
    """``words`` times 64 bits; a bit is 1 if over half of the shingles' hashes have it."""
    return majority(shingle_hashes(text, size), words)


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` times 64 bits; a bit is 1 if over half of the hashes have it."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 255):  # sums of up to 255 bits fit a byte
        bits = np.unpackbits(more_hashes(h[at : at + 255], words).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


def _fingerprints(size: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(t, size, words).byteswap().tobytes() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.binary())], names=["id", "fp"])

    return run


def lanes_of(prints: np.ndarray, lanes: list[np.ndarray]) -> np.ndarray:
    """(n, lanes): for each lane, the fingerprint's bits at the lane's places, as a number."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    return np.stack([bits[:, at] @ (1 << np.arange(len(at))) for at in lanes], axis=1)


def block_lanes(bits: int, radius: int) -> list[np.ndarray]:
    """All pairs of radius + 2 disjoint runs of bits: fingerprints within the radius agree in two runs
    at least, and so in one lane. Lanes of one run would be half as wide, and so let many more meet."""
    return [np.concatenate(p) for p in combinations(np.array_split(np.arange(bits), radius + 2), 2)]


def sampled_lanes(bits: int, width: int, n: int) -> list[np.ndarray]:
    """``n`` sets of ``width`` bits, dealt by fixed shuffles; those of one shuffle are disjoint."""
    rng, out = np.random.default_rng(SEED), []
    while len(out) < n:
        order = rng.permutation(bits)
        out += [order[i : i + width] for i in range(0, bits - width + 1, width)]
    return out[:n]


def lanes_for(n_prints: int, bits: int, apart: float, missed: float, tile: int = TILE) -> list[np.ndarray]:
    """Sampled lanes for so many fingerprints: as wide as makes a lane's value hold a tile on
    average, and so many that of pairs ``apart`` bits apart the share ``missed`` agrees in none."""
    width = min(32, max(10, math.ceil(math.log2(max(1, n_prints) / tile))))
    agree = (1 - apart / bits) ** width
    return sampled_lanes(bits, width, math.ceil(math.log(missed) / math.log1p(-agree)))


def _deal(lanes: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = batch.column("fp").slice(at, 4096)
                prints = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(fp), -1)
                values = lanes_of(prints, lanes).astype(np.int64)
                lane = np.broadcast_to(np.arange(len(lanes), dtype=np.int64) << 32, values.shape)
                rows = pa.array(np.repeat(np.arange(len(fp)), len(lanes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((lane | values).ravel()), fp.take(rows)], names=["lane", "fp"]
                )

    return run


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def tile_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links (row, root) of the fingerprints within the radius of each other.

    Rows are sorted by population count. Two runs of rows are compared with exclusive-or and bit
    counts unless their counts lie further apart than the radius.
    """
    total = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.argsort(total, kind="stable")
    prints, total = prints[order], total[order]
    n = len(prints)
    parent = np.arange(n)
    for i in range(0, n, STEP):
        a = prints[i : i + STEP]
        last = total[min(i + STEP, n) - 1]
        for j in range(i, n, STEP):
            if total[j] - last > radius:
                break
            b = prints[j : j + STEP]
            apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            for w in range(1, prints.shape[1]):
                apart = apart + np.bitwise_count(a[:, None, w] ^ b[None, :, w]).astype(np.uint16)
            x, y = np.nonzero(apart <= radius)
            for p, q in zip((x + i).tolist(), (y + j).tolist(), strict=True):
                if p < q and parent[p] != parent[q]:
                    p, q = _find(parent, p), _find(parent, q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
    roots = [_find(parent, k) for k in range(n)]
    return [(int(order[k]), int(order[r])) for k, r in enumerate(roots) if k != r]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for both in batch.column("fps"):
                prints = both.as_py()
                rows = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
                for k, r in tile_links(rows, radius):
                    a.append(prints[k])
                    b.append(prints[r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def link_fingerprints(prints: DataFrame, radius: int, lanes: list[np.ndarray], tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints(fp)`` that differ in ``radius`` bits at most.

    Only fingerprints that agree in one of the lanes meet. Within a lane's value they are dealt to
    tiles of about ``tile`` fingerprints by hash, and each pair of tiles is compared by itself, so
    a large group spreads over tasks. A pair of tiles yields links that span what it connects, not
    all pairs.
    """
    rows, path = stored(prints.mapInArrow(_deal(lanes), "lane long, fp binary"), "lanes")
    full = rows.groupBy("lane").count().where(F.col("count") > tile).select("lane", F.ceil(F.col("count") / tile).cast("int").alias("n"))
    rows = rows.join(full, "lane", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = rows.withColumn("t", F.pmod(F.hash("fp"), F.col("n"))).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tiles = (
        rows.groupBy("lane", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    links = materialize(tiles.select("fps").mapInArrow(_compare(radius), "a binary, b binary").distinct(), "links")
    delete_path(prints.sparkSession, path)
    release(prints.sparkSession)
    return links


def components(
    docs: DataFrame,
    *,
    shingle: int = 4,
    radius: int = 4,
    words: int = 1,
    lanes: list[np.ndarray] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    Texts become fingerprints of ``words`` * 64 bits over shingles of ``shingle`` words; A-Z count
    as lower case. Rows of equal fingerprints are one class. Classes within ``radius`` bits are
    linked by tiled comparison; ``lanes`` says which may meet, by default blocks such that no link
    is missed. ``component_id`` is the least id reachable.

    A text of fewer words is one shingle; a text without words, or null, has fingerprint zero and
    links like any other. Null ids take the component of their text but are never its id: a
    component of null ids alone has a null id. Repeated rows come out repeated; rows of one id with
    different texts are linked by their texts alone. An empty table
    gives an empty result. Other columns are not looked at.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    prints = materialize(slim.mapInArrow(_fingerprints(shingle, words), "id long, fp binary"), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    links = link_fingerprints(classes.select("fp"), radius, lanes or block_lanes(64 * words, radius))
    node = lambda c: F.xxhash64(c) if words > 1 else F.conv(F.hex(c), 16, -10).cast("long")
    linked = connected_components(links.select(node(F.col("a")).alias("src"), node(F.col("b")).alias("dst")))
    members = linked.join(classes.select("fp", "rep", node(F.col("fp")).alias("node")), "node").select("fp", "rep", "root")
    least = members.groupBy("root").agg(F.min("rep").alias("least"))
    # coalesce() hides how the sums are dealt, so that AQE can split a large component
    least = least.select(F.coalesce("root", F.lit(0).cast("long")).alias("root"), "least")
    members = members.join(least, "root").select("fp", "least")
    found = materialize(
        classes.join(members, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "components"
    )
    return prints.join(found, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Of the shingles' union, that two near-duplicate documents share at least.
SIMILARITY = 0.8
#: Shingle sets, and hashes of them all, that a tile takes; a larger group is cut into more tiles.
TILE_SETS, TILE_HASHES = 256, 2_000_000


def _set_prints(size: int, words: int):
    """For each text: its fingerprint, a key of its shingle set, and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, sizes = [], [], []
            for t in texts(batch.column("text")):
                h = np.unique(shingle_hashes(t, size))
                prints.append(majority(h, words).byteswap().tobytes())
                keys.append(xxhash.xxh3_128_digest(h.tobytes(), SEED))
                sizes.append(len(h))
            columns = [pa.array(prints, pa.binary()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), *columns], names=["id", "text_hash", "fp", "key", "n"]
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("node"), batch.column("tiles"), pa.array(sets, pa.binary())],
                names=["grp", "node", "tiles", "hashes"],
            )

    return run


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Spanning links (row, root) of the sets whose Jaccard similarity is ``least`` or more.

    A set can only be similar to one that has any of its rarest hashes, a few more than it may
    lack. Sets that are connected already are not compared again.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(n), sizes)[np.argsort(codes, kind="stable")]
    starts = np.cumsum(often) - often
    ends = np.cumsum(sizes)
    root = np.arange(n)
    for k in range(n):
        own = codes[ends[k] - sizes[k] : ends[k]]
        lack = sizes[k] - int(np.ceil(least * sizes[k] - 1e-9))
        rare = own[np.argsort(often[own], kind="stable")[: lack + 1]]
        if (root[gather(owner, starts[rare], often[rare])] == root[k]).all():
            continue
        both = np.bincount(gather(owner, starts[own], often[own]), minlength=n)
        joined = np.unique(root[both / (sizes + sizes[k] - both) >= least])
        root[np.isin(root, joined)] = joined[0]
    return [(k, int(r)) for k, r in enumerate(root) if k != r]


def _confirm(least: float):
    """Rows sorted by tile to the links of each tile."""

    def links(keys: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(keys[k], keys[r]) for k, r in similar_links(sets, least)] if len(keys) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            found = []
            hashes = batch.column("hashes")
            for r, (*place, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "i", "j", "node")), strict=True)):
                if place != now:
                    found += links(list(held), list(held.values()))
                    now, held = place, {}
                held[node] = np.frombuffer(hashes[r].as_py(), np.uint64)
            yield _pairs(found)
        yield _pairs(links(list(held), list(held.values())))

    def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["src", "dst"])

    return run


#: Cells of the filter that keeps texts from being moved that no candidate needs; bounds its broadcast.
FILTER_CELLS = 1 << 20


def only_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose (id, text_hash) is not in ``wanted``; none of these goes.

    Rows whose hash falls in a cell that no wanted row has stay where they are read. There are
    FILTER_CELLS cells at most. The more of them are taken, the fewer rows the filter keeps
    back: then the join after it does.
    """
    cell = lambda *c: F.pmod(F.xxhash64(*c, F.lit(1)), F.lit(FILTER_CELLS)).alias("_cell")
    cells = wanted.select(cell("own_id", "own_hash")).distinct()
    return rows.withColumn("_cell", cell("id", "text_hash")).join(F.broadcast(cells), "_cell", "left_semi").drop("_cell")


def confirmed_links(slim: DataFrame, groups: DataFrame, shingle: int, least: float, keep: Scratch) -> DataFrame:
    """Links (src, dst) that span, in each group, the sets of Jaccard similarity ``least`` or more.

    ``groups(grp, node, n, id, text_hash)`` names for each shingle set a row of ``slim`` that has it.
    All sets of a group are compared, in pairs of tiles as in ``link_fingerprints``.
    """
    full = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("hashes")).where("sets > 1")
    tiles = F.ceil(F.greatest(F.col("sets") / TILE_SETS, F.col("hashes") / TILE_HASHES)).cast("int")
    # coalesce() hides how the sums are dealt, so that AQE can split a large group
    full = full.select(F.coalesce("grp", F.lit(0).cast("long")).alias("grp"), tiles.alias("tiles"))
    wanted = keep(groups.join(full, "grp").withColumnRenamed("id", "own_id").withColumnRenamed("text_hash", "own_hash"), "wanted")
    found = only_wanted(slim, wanted).join(wanted, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    sets = found.select("grp", "node", "tiles", "text").mapInArrow(_sets(shingle), "grp long, node long, tiles int, hashes binary")
    sets = sets.withColumn("t", F.pmod(F.hash("node"), F.col("tiles"))).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sets = sets.select("grp", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "node", "hashes")
    sets = sets.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return keep(sets.mapInArrow(_confirm(least), "src long, dst long").distinct(), "confirmed")


#: Bits that differ on average in 256-bit fingerprints of sets at SIMILARITY, the radius of
#: candidates, and the share of pairs at SIMILARITY that meet in no lane.
MEAN_APART, RADIUS, MISSED = 38.8, 54, 0.005


def _near_classes(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text_hash, key, fp, n), and for each key the first (id, text_hash) of its component.

    Rows of one key have equal shingle sets, by 128 bits of hash. Null ids are never first. Only
    these two tables stay in the shared folder.
    """
    spark, text = docs.sparkSession, text_or_empty(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    prints = materialize(slim.mapInArrow(_set_prints(shingle, 4), "id long, text_hash long, fp binary, key binary, n long"), "fingerprints")
    row = F.struct("id", "text_hash")
    classes = prints.groupBy("key").agg(
        F.min(F.when(F.col("id").isNotNull(), row)).alias("first"), F.min(row).alias("any"), F.min("fp").alias("fp"), F.min("n").alias("n")
    )
    with Scratch(spark) as keep:
        # numbered once, in the table that is read from here on
        classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        worded = classes.where("n > 0")
        distinct = worded.select("fp").distinct()
        links = keep.own(link_fingerprints(distinct, RADIUS, lanes_for(worded.count(), 256, MEAN_APART, MISSED)))
        # equal hashes of fingerprints would only make one group of two
        near = keep.own(connected_components(links.select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"))))
        place = F.xxhash64("fp")
        groups = worded.withColumn("place", place).join(near.withColumnRenamed("node", "place"), "place", "left").select(
            F.coalesce("root", "place").alias("grp"), "node", "n", F.col("any.id").alias("id"), F.col("any.text_hash").alias("text_hash")
        )
        linked = keep.own(connected_components(confirmed_links(slim, keep(groups, "groups"), shingle, SIMILARITY, keep)))
        members = linked.join(classes.select("first", "node"), "node").select("node", "first", "root")
        least = members.groupBy("root").agg(F.min("first").alias("least"))
        # as in components()
        least = least.select(F.coalesce("root", F.lit(0).cast("long")).alias("root"), "least")
        members = members.join(least, "root").select("node", "least")
        found = classes.join(members, "node", "left").select("key", F.coalesce("least", "first").alias("first"))
        return prints, materialize(found, "components")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): documents linked by similarity 0.8 of their five-word shingle sets.

    Candidates come from fingerprints of 256 bits. Shingle sets of Jaccard similarity 0.8 have a
    cosine of 8/9, so 38.8 of 256 bits differ on average, by 5.7 either way; a radius of 54 takes
    in 99.6 of 100 such pairs and nearly all that are closer, while unrelated texts differ in 128
    bits. Pairs meet if one lane of sampled bits agrees: 0.995 of pairs at the threshold, more above.
    The lanes are the wider, and the more, the more fingerprints there are, so that the share
    stays and a lane's value holds no more than a tile on average.

    Candidates that hang together form a group. In it the shingle sets themselves are compared,
    all with all, and only pairs of Jaccard similarity 0.8 or more are links. Equal sets are one
    class; so are texts without words, which link to nothing else.
    """
    prints, found = _near_classes(docs, shingle, id_col, text_col)
    return prints.join(found, "key").select(F.col("id").alias(id_col), "fp", F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each near-duplicate group: that of the least id, and
    of the least text hash among the group's own rows of that id.

    Rows of one id in several groups are told apart by their texts. Rows of null ids stay as they
    are: they can't be told apart.
    """
    with Scratch(docs.sparkSession) as keep:
        prints, found = _near_classes(docs.where(F.col(id_col).isNotNull()), 5, id_col, text_col)
        keep.own(prints)
    name, own, place = free_name(docs, "_kept"), free_name(docs, "_text_hash"), free_name(docs, "_rank")
    kept = found.select(F.col("first.id").alias(name), F.col("first.text_hash").alias(own)).distinct()
    text_hash = F.xxhash64(text_or_empty(text_col))
    rank = Window.partitionBy(name, own).orderBy(F.xxhash64(text_col))
    stay = docs.join(kept, (F.col(id_col).cast("long") == F.col(name)) & (text_hash == F.col(own)))
    stay = stay.withColumn(place, F.row_number().over(rank)).where(F.col(place) == 1).drop(name, own, place)
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
