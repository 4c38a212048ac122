"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and MinHash propose groups, the sets decide.

Every distinct text (its lower-case words) is a node. The components of the SimHash trie join are groups; as pairs
of similarity 0.8 often differ in more bits than such a join can spend, nodes that agree in a band of MinHash
values share a group as well. Each node is compared with its group's smallest node; then, in the groups that
still hold several components, all pairs of nodes of different components are, a block of nodes in a task. Only
exact similarities link: a group can miss a pair (see MISS), never make one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import stored
from .common import id_text, slices, texts
from .graph import components
from .simhash import keep_rows, line_of, majority, near_links, shingles

#: Bands, and MinHash values in each. A pair of similarity s is proposed with probability 1 - (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 24, 5
#: The probability that a pair of similarity 0.8 shares no band.
MISS = (1 - 0.8**ROWS) ** BANDS
#: A group whose sets have more bytes than this is dealt out as pairs of its parts.
BLOCK_BYTES = 1 << 20
_MASKS, _FACTORS = np.random.default_rng(8).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS |= np.uint64(1)


def node_of(line: bytes) -> int:
    return xxh64_intdigest(line, 7)


def set_of(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashes)


def bands(found: np.ndarray) -> list[int]:
    """The key of each band; none for an empty set."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(low, ((found[at : at + 2048, None] ^ _MASKS) * _FACTORS).min(axis=0), out=low)
    return [xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(low.reshape(BANDS, ROWS))]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def marks(df: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, node, fp, keys`` of every row: its SimHash and its bands; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines = [line_of(t) for t in texts(part)]
            hashes = [shingles(x, shingle) for x in lines]
            keys = [_signed(bands(set_of(h))) for h in hashes]
            node, fp = (pa.array(_signed(x)) for x in ([node_of(x) for x in lines], [majority(h) for h in hashes]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), node, fp, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "keys"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, node bigint, fp bigint, keys array<bigint>")


def sets_of(df: DataFrame, wanted: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, shingles`` (8 bytes each) of the ``wanted`` nodes, each with its ``first`` id; only their texts are shuffled."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.append_column("node", pa.array(_signed([node_of(line_of(t)) for t in texts(part)])))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([set_of(shingles(line_of(t), shingle)).tobytes() for t in texts(part)], pa.binary())], names=["node", "shingles"])

    mine = id_text(df, id_col, text_col).mapInArrow(name, "doc_id bigint, text string, node bigint")
    mine = mine.join(wanted.withColumnRenamed("node", "w"), (F.col("node") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("first")))
    found = mine.select("node", "text").mapInArrow(cut, "node bigint, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))  # rows that repeat an id


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose similarity is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "y"):
                near = [likeness(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(texts(part, "x"), texts(part, "y"), strict=True)]
                yield part.filter(pa.array(near, pa.bool_())).select(["a", "b"])

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def block_links(sets: list[np.ndarray], root: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join all sets of similarity ``least`` or more; ``root`` tells which are joined already."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(ids), np.int32)
    label, out = np.unique(root, return_inverse=True)[1], []
    for i in range(len(sets) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        mine = ids[starts[i] : starts[i] + size[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[mine] = 0
        for j in (np.flatnonzero(both / (size[i] + size[i + 1 :] - both) >= least) + i + 1).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def open_links(at: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a, b`` links between the nodes of each group of ``at`` (``key, node, root``) that have different roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(block: pa.Table) -> Iterator[pa.RecordBatch]:
            node = block["node"].to_numpy()
            found = block_links([np.frombuffer(x, np.uint64) for x in block["shingles"].to_pylist()], block["root"].to_numpy(), least)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if held and block[x] != last:
                    yield from join(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(x, y - x))
                last = block[x]
        if held:
            yield from join(pa.Table.from_batches(held))

    sizes = sets.select("node", F.octet_length("shingles").alias("n"))
    parts = at.join(sizes, "node").groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h"), F.ceil(F.sum("n") / BLOCK_BYTES).alias("c"))
    part = F.pmod(F.xxhash64("node"), F.col("c"))
    dealt = at.join(parts.filter("l <> h").select("key", "c"), "key").select("node", "root", "key", part.alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).alias("q"))
    dealt = dealt.select("node", "root", F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q")).alias("block")).join(sets, "node")
    return dealt.select("block", "node", "root", "shingles").repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def rooted(df: DataFrame, seen: DataFrame, least: float = 0.8, shingle: int = 5, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, first, root`` of each node of the stored marks ``seen``: its smallest id, and its component's smallest node."""
    # equal nodes have equal keys, so one of them stands for all
    distinct = stored(seen.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    # texts without words have no bands: their one node needs no group
    near = components(near_links(distinct.filter(F.size("keys") > 0).select("fp").distinct(), budget)).select(F.col("node").alias("f"), F.col("root").alias("near"))
    same = distinct.filter(F.size("keys") > 0).join(near, F.col("fp") == F.col("f"), "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("near", "fp")).alias("key"))
    keyed = distinct.select("node", F.explode("keys").alias("key")).unionByName(same)
    groups = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "low")
    members = stored(keyed.join(groups, "key").select("key", "node", "low"), "members")
    wanted = distinct.select("node", "first").join(members.select("node").distinct(), "node", "left_semi")
    sets = stored(sets_of(df, wanted, shingle, id_col, text_col), "sets")
    star = stored(members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(verified(star, sets, least), "links")
    at = members.join(components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    links = links.unionByName(stored(open_links(at, sets, least), "links"))
    roots = components(links)
    return distinct.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).checkpoint()


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5, budget: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: one of each component of pairs of similarity ``least``.

    ``budget``: the bits within which SimHash links. Rows stay as in simhash.keep_one(): the smallest id of a group
    (of rows that repeat an id, one), null ids only where it has no other. Texts without words are one group.
    """
    seen = stored(marks(docs, shingle, id_col, text_col), "marks")
    nodes = rooted(docs, seen, least, shingle, budget, id_col, text_col).withColumnRenamed("node", "fp")
    return keep_rows(docs, nodes, lambda t: node_of(line_of(t)), id_col, text_col)
