"""Near-duplicates by SimHash: fingerprints, and a binary trie self-join within a Hamming error budget.

Fingerprints that differ in at most four bits agree in at least one of five blocks of bits. So each
distinct fingerprint goes to five groups, by the value of each block, and a group's fingerprints form a
binary trie that is joined with itself: node pairs go down together one bit at a time, a pair of different
branches spends one of the error budget, and a pair that has overspent is pruned. Pairs whose leaves are
linked already are pruned too, so a large cluster costs what its trie costs, not its pairs. What leaves a
task is a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import stored
from .common import fresh, id_text, quoted, slices, texts, with_text
from .graph import SALTS, components, dealt_join

#: Rows of whole groups that a task joins at once; node pairs that it holds at once.
FOREST_ROWS, FRONTIER = 150_000, 400_000
#: A group of more fingerprints than this is dealt out once more, by blocks of its other bits.
HOT_GROUP = 20_000


def line_of(text: str) -> bytes:
    """The words of a text with single spaces between: A-Z lowered, cut at ASCII white space only."""
    return b" ".join(text.encode("utf-8", "replace").lower().split())


def shingles(line: bytes, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a line, repeats included; all of a shorter line is one; none without words."""
    if not line:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, line.split(b" ")), np.int64)
    if len(size) <= shingle:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size)[: len(size) - shingle + 1].tolist()
    return np.fromiter([xxh64_intdigest(line[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], np.uint64, len(begins))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        votes += np.unpackbits(h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    return majority(shingles(line_of(text), shingle, seed))


def fingerprints(df: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (as a signed bigint) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts(part)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def blocks(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` cut into ``parts`` runs of nearly equal length."""
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def block_value(bits: list[int]) -> F.Column:
    """The value of a run of bits of ``fp``."""
    return F.shiftrightunsigned(F.col("fp"), bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))


class Links:
    """Disjoint sets over the leaves of a forest, merged many links at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.refresh()

    def refresh(self) -> None:
        same = self.label[1:] == self.label[:-1]
        self.changes = np.concatenate([[0], np.cumsum(~same)]) if len(self.label) else np.zeros(0, np.int64)

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up
        self.refresh()

    def one_set(self, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        """Of node pairs, whether all leaves below both nodes are in one set."""
        c = self.changes
        return (c[lo1] == c[hi1 - 1]) & (c[lo2] == c[hi2 - 1]) & (self.label[lo1] == self.label[lo2])


def trie_join(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, links: Links) -> None:
    """Link the leaves of each trie (a sorted run ``lo:hi`` of distinct uint64 ``values``) within ``budget`` bits.

    A trie node is the run of leaves below it, so a node's children are told by counting set bits.
    """
    ones = {}

    def below(bit: int) -> np.ndarray:
        if bit not in ones:
            ones.clear()
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        return ones[bit]

    zero = np.zeros(len(lo), np.int64)
    todo = [(63, lo, hi, lo, hi, zero)]
    while todo:
        bit, a0, a1, b0, b1, spent = todo.pop()
        if not len(a0):
            continue
        keep = ~links.one_set(a0, a1, b0, b1)
        a0, a1, b0, b1, spent = a0[keep], a1[keep], b0[keep], b1[keep], spent[keep]
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            todo.append((bit, a0[half:], a1[half:], b0[half:], b1[half:], spent[half:]))
            todo.append((bit, a0[:half], a1[:half], b0[:half], b1[:half], spent[:half]))
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            links.merge(i[near], j[near])
            a0, a1, b0, b1, spent = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], spent[~leaf]
        if bit < 0 or not len(a0):
            continue
        c = below(bit)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        apart = ~same
        sides = [
            (a0, am, b0, bm, spent, None),
            (am, a1, bm, b1, spent, None),
            (a0, am, bm, b1, spent + 1, None),
            (am, a1, b0, bm, spent + 1, apart),
        ]
        nxt: list[list[np.ndarray]] = [[], [], [], [], []]
        for p0, p1, q0, q1, cost, only in sides:
            ok = (p1 > p0) & (q1 > q0) & (cost <= budget)
            ok &= ~((p0 == q0) & (p1 - p0 == 1) & (q1 - q0 == 1))
            if only is not None:
                ok &= only
            for column, x in zip(nxt, (p0, p1, q0, q1, cost), strict=True):
                column.append(x[ok])
        todo.append((bit - 1, *(np.concatenate(x) for x in nxt)))


def forest_links(group: np.ndarray, values: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span each group's near-duplicate sets; ``values`` are distinct within a group.

    Small budgets first: what they link prunes the dear last traversal.
    """
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    links = Links(len(values))
    for step in sorted({min(1, budget), min(2, budget), budget}):
        trie_join(values, lo[many], hi[many], step, links)
    far = np.flatnonzero(links.label != np.arange(len(values)))
    return values[far], values[links.label[far]]


def near_links(distinct: DataFrame, budget: int = 4) -> DataFrame:
    """``a, b`` links that connect all fingerprints ``fp`` within ``budget`` bits; several may say the same.

    A group that holds more than HOT_GROUP fingerprints is dealt out by ``budget + 1`` blocks of its other
    bits, in one of which two near fingerprints agree as well: exact, and no group need fit in one task.
    """
    parts = blocks(list(range(64)), budget + 1)
    keyed = distinct.select("fp", F.posexplode(F.array(*[block_value(b) for b in parts])).alias("block", "value"))
    keyed = keyed.withColumn("group", F.col("value") * (budget + 1) + F.col("block"))
    hot = keyed.groupBy("group").count().filter(F.col("count") > HOT_GROUP).select("group", F.lit(True).alias("hot"))
    finer = []
    for b in parts:
        rest = blocks([x for x in range(64) if x not in b], budget + 1)
        # the other bits are one run or two, so a block of them may span the gap that b leaves
        value = [sum((F.shiftrightunsigned(F.col("fp"), x).bitwiseAND(F.lit(1)) * (1 << i) for i, x in enumerate(r)), F.lit(0)) for r in rest]
        finer.append(F.array(*[(v * (budget + 1) + i).cast("bigint") for i, v in enumerate(value)]))
    # at most (rows / HOT_GROUP) groups are hot; the planner broadcasts them only if they are small
    keyed = keyed.join(hot, "group", "left")
    second = F.coalesce(*[F.when(F.col("hot") & (F.col("block") == i), x) for i, x in enumerate(finer)], F.array(F.lit(-1).cast("bigint")))
    keyed = keyed.select("fp", F.col("group"), F.explode(second).alias("sub"))
    keyed = keyed.select("fp", F.xxhash64("group", "sub").alias("key"), "group", "sub")

    def join(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        # groups are told apart by all of (group, sub)
        g, s = t["group"].to_numpy(), t["sub"].to_numpy()
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])])
        a, b = forest_links(np.cumsum(new), t["fp"].to_numpy().view(np.uint64), budget)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            if rows >= FOREST_ROWS:  # whole groups only: hold back what may go on in the next batch
                whole = pa.concat_tables(held)
                g, s = whole["group"].to_numpy(), whole["sub"].to_numpy()
                last = np.flatnonzero((g != g[-1]) | (s != s[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from join([whole.slice(0, cut)])
                    held, rows = [whole.slice(cut)], whole.num_rows - cut
            held.append(t)
            rows += t.num_rows
        if held:
            yield from join(held)

    spread = keyed.repartition("key").sortWithinPartitions("group", "sub").select("fp", "group", "sub")
    return spread.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, budget: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest id reachable over links of ``budget`` bits.

    Equal fingerprints are one node of the graph, however many rows have them. Texts without words (null
    ones too) have fingerprint zero and link like any other. Null ids never name a component (null if it has
    no other id); repeated rows and ids are kept; other columns are ignored.
    """
    # salts go by place, as rows may repeat ids; they are written, so that all readers see the same
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("smallint").alias("salt")
    prints = stored(fingerprints(df, shingle, id_col, text_col).select("doc_id", "fp", salt), "fingerprints")
    return with_components(prints, budget)


def rooted(prints: DataFrame, budget: int) -> DataFrame:
    """``fp, first, root`` of each distinct fingerprint: its smallest id, and its component's smallest fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    roots = components(near_links(distinct.select("fp"), budget))
    return distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()


def keep_one(docs: DataFrame, budget: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of near-duplicates: one row of each.

    The row with the smallest id stays (of rows that repeat an id, one); null ids only where a group has no other.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return keep_rows(docs, rooted(prints, budget), lambda t: fingerprint(t, shingle), id_col, text_col)


def keep_rows(docs: DataFrame, nodes: DataFrame, mark: Callable[[str], int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for the components of ``nodes`` (``fp, first, root``); ``mark`` gives a text's fp."""
    doc, text = F.col(quoted(id_col)).cast("bigint"), F.col(quoted(text_col))

    def stamp(part: pa.RecordBatch, rows: list[str | None]) -> pa.RecordBatch:
        fp = np.array([mark(t or "") for t in rows], np.uint64).view(np.int64)
        return part.append_column("fp", pa.array(fp))

    fp, best, first, n = (fresh(docs, c) for c in ("_fp", "_best", "_first", "_n"))
    stand = nodes.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("b")).select(F.col("b.first").alias(first), F.col("b.fp").alias(best))
    # the fingerprint is computed once more, so that texts are shuffled once, to the rows that may stay
    mine = with_text(docs, text_col, stamp, f"{fp} bigint")
    kept = mine.join(stand, (F.col(fp) == F.col(best)) & doc.eqNullSafe(F.col(first)))
    one = Window.partitionBy(best, first).orderBy(text)  # equal keys: rows that repeat an id
    return kept.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).select(*[F.col(quoted(c)) for c in docs.columns])


def with_components(prints: DataFrame, budget: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` of a stored table of ``doc_id, fp, salt``; large components and equal prints are dealt by salts."""
    joined = rooted(prints, budget)
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    salted = joined.select("fp", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt"))
    named = dealt_join(salted, lowest, "root").select("fp", "component_id")
    return dealt_join(prints, named, "fp").select("doc_id", "fp", "component_id")
