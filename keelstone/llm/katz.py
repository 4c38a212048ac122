"""Language-model scores: Katz backoff over word pairs with Good-Turing discounts.

Counting and scoring go by blocks of documents. A block keeps its token sequence as compressed integers in a
stored table. Two rounds carry only what the blocks' distinct words and distinct word pairs need: blocks send
them to partitions (words by hash, pairs by their first word), the partitions add up the training counts over
all blocks and answer each block in the order it asked. So no text, no token and no model table larger than a
partition meets in one task, and the model's tables stay partitioned.

A block sends at most FAN messages. Where there are more partitions, messages go through several levels (see
Exchange): nodes between add up what some FAN blocks say of one share of the partitions, ask on for them all at
once and hand the answers back. So messages grow with the number of blocks, not with its square.

P(w | h) = d(c) c / Z(h) for a pair seen c > 0 times in training, else alpha(h) P(w); P(w) = d(c) c / Z for a
known word, and what that leaves for all unknown words together. Z(h) is h's count, or one more where the
discounts leave nothing; alpha(h) makes the sum over all words, unknown included, exactly 1.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from ..session import stored
from .common import id_text, slices

#: Tokens in a block (a task's memory), in a word or pair partition; counts up to TOP are discounted.
BLOCK_TOKENS, PART_TOKENS, TOP = 1_250_000, 1_250_000, 5
#: A word that is seen more often than a partition's tokens over this has its pairs dealt by both words.
HOT_SHARE = 8
#: Messages that a block, or a node between, sends in a round.
FAN = 256
#: The number that stands for all words that training has not seen; 0 is a document's start.
UNSEEN = 1
_END = b"\n"  # no word holds white space
_DTYPES = ("<u8", "<i8", "<u4", "<f8", "<u1")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each split into byte planes, then compressed."""
    out = []
    for a in arrays:
        kind = _DTYPES.index(a.dtype.newbyteorder("<").str if a.dtype.itemsize > 1 else "<u1")
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        body = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out.append(struct.pack("<BQQ", kind, len(a), len(body)) + body)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<BQQ", data, at)
        dtype, at = np.dtype(_DTYPES[kind]), at + 17
        if n:
            raw = pa.decompress(data[at : at + size], n * dtype.itemsize, codec="zstd")
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel())
        else:
            out.append(np.zeros(0, dtype))
        at += size
    return out


def gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def discounts(seen: list[int]) -> np.ndarray:
    """Katz's factors d(0..TOP) from the counts of counts n(1..TOP+1); counts above TOP keep their full weight.

    Where repeated passages make the counts of counts rise, a factor may leave (0, 1): it is held within
    0.05 and 0.995. The backoff weights make up for it exactly.
    """
    n = [0, *seen]
    out = np.zeros(TOP + 1)
    for r in range(1, TOP + 1):
        rest = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 0.0
        turing = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 1.0
        out[r] = np.clip((turing - rest) / (1 - rest) if rest < 1 else turing, 0.05, 0.995)
    return out


class Unigrams:
    """P(w) by the word's training count."""

    def __init__(self, total: int, kinds: int, seen: list[int]):
        self.total, self.kinds, self.factor = total, kinds, discounts(seen)
        cut = float(sum((1 - self.factor[r]) * r * seen[r - 1] for r in range(1, TOP + 1)))
        self.norm = float(total) if cut > 0 else total + 1.0
        self.unknown = 1 - (total - cut) / self.norm

    def discounted(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > TOP, 1.0, self.factor[np.minimum(count, TOP)]) * count

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounted(count) / self.norm, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of the add-half estimate."""
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.kinds + 1)))


class Block:
    """Documents' ids, held-out marks and tokens (as places in ``words``, the sorted hashes of distinct words)."""

    def __init__(self, data: bytes):
        self.ids, self.null, self.held, self.size, self.tokens, steps = unpack(data)
        self.words = np.cumsum(steps)
        self.begins = np.concatenate([[0], np.cumsum(self.size.astype(np.int64))])[:-1]

    def trained(self) -> np.ndarray:
        """Of each token, whether it is in a training document."""
        return np.repeat(self.held == 0, self.size)

    def pairs(self, number: np.ndarray) -> np.ndarray:
        """Each token's pair (word before << 32 | word), in word numbers from 1; 0 before a document's first word."""
        now = number[self.tokens]
        before = np.concatenate([np.zeros(1, now.dtype), now[:-1]])
        before[self.begins] = 0
        return before << np.uint64(32) | now


def blocks(df: DataFrame, held: int, parts: int, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """``block, tokens, trained, data``: the documents as Block rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 24, 0
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        ids, marks, sizes, tokens, total = [], [], [], [], 0

        def finished() -> pa.RecordBatch:
            h = np.fromiter((xxh64_intdigest(w) for w in place), np.uint64, len(place))
            order = np.argsort(h)
            rank = np.empty(len(h), np.uint32)
            rank[order] = np.arange(len(h), dtype=np.uint32)
            size = np.array(sizes, np.uint32)
            held_out = np.array(marks, np.uint8)
            null = np.array([i is None for i in ids], np.uint8)
            data = pack(np.array([i or 0 for i in ids], np.int64), null, held_out, size, rank[np.concatenate(tokens)], gaps(h[order]))
            trained = int(size[held_out == 0].sum())
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([total]), pa.array([trained]), pa.array([data], pa.binary())], names=["block", "tokens", "trained", "data"])

        for part in slices(batches):
            for doc, text, out in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "held")), strict=True):
                words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
                words.append(_END)
                ids.append(doc)
                marks.append(out)
                sizes.append(len(words))
                tokens.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                total += len(words)
                if total >= block_tokens:
                    yield finished()
                    made, total = made + 1, 0
                    place.clear()
                    ids, marks, sizes, tokens = [], [], [], []
        if ids:
            yield finished()

    mark = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held, F.lit(False))
    return id_text(df, id_col, text_col).withColumn("held", mark).mapInArrow(run, "block bigint, tokens bigint, trained bigint, data binary")


def _stat_columns(counts: np.ndarray) -> dict[str, list[int]]:
    seen = np.bincount(np.minimum(counts, TOP + 2).astype(np.int64), minlength=TOP + 3)
    return {f"n{r}": [int(seen[r])] for r in range(1, TOP + 2)}


def _sums(where: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Exact 64-bit sums of ``count`` by place: both halves are summed as floats, which hold integers to 2 ** 53."""
    if not len(count) or int(count.max()) >> 32 == 0:
        return np.bincount(where, count, n).astype(np.uint64)
    count = count.astype(np.uint64)
    low, high = (np.bincount(where, half, n).astype(np.uint64) for half in (count & np.uint64(0xFFFFFFFF), count >> np.uint64(32)))
    return low + (high << np.uint64(32))


def narrow(count: np.ndarray) -> np.ndarray:
    """Counts as 32-bit integers where all of them fit."""
    return count.astype(np.uint32) if not len(count) or int(count.max()) >> 32 == 0 else count


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The partitions that occur, each with the places that have it, in order."""
    order = np.argsort(part, kind="stable")
    here, first = np.unique(part[order], return_index=True)
    for p, a, b in zip(here.tolist(), first, [*first[1:], len(order)], strict=True):
        yield p, order[a:b]


class Words:
    """Distinct words (sorted hashes) with counts. Asked: their counts; answered: their numbers and totals."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, parts: int):
        self.keys, self.count, self.q = keys, count, keys % np.uint64(parts)

    def ask(self, at: np.ndarray) -> bytes:
        return pack(gaps(self.keys[at]), narrow(self.count[at]))

    @classmethod
    def merged(cls, asks: list[bytes], parts: int) -> Words:
        sent = [unpack(d) for d in asks]
        keys, where = np.unique(np.concatenate([np.cumsum(k) for k, _ in sent]), return_inverse=True)
        out = cls(keys, _sums(where, np.concatenate([c for _, c in sent]), len(keys)), parts)
        out.places = np.split(where, np.cumsum([len(k) for k, _ in sent])[:-1])
        return out

    def gather(self, found: Iterator[tuple[np.ndarray, bytes]]) -> None:
        """Take in the answers on some places each."""
        self.number, self.total = np.zeros(len(self.keys), np.uint64), np.zeros(len(self.keys), np.uint64)
        for at, data in found:
            self.number[at], self.total[at] = unpack(data)

    def replies(self) -> list[bytes]:
        return [pack(narrow(self.number[w]), narrow(self.total[w])) for w in self.places]


class Pairs:
    """Distinct sorted pairs with counts, the second words' totals, and whether the first word is hot.

    Answered: the pairs' totals and, of each first word, how many pairs it was seen in once, twice and so on to
    TOP, their total beyond TOP, and the sum of P(w) over all words seen after it (not of hot ones, whose pairs lie
    in many partitions: their shares are added up elsewhere).
    """

    def __init__(self, pair: np.ndarray, after: np.ndarray, count: np.ndarray, hot: np.ndarray, parts: int):
        self.pair, self.after, self.count, self.hot = pair, after, count, hot
        # by the first word; by both words where the first is hot
        self.q = _mix(np.where(hot, pair, pair >> np.uint64(32))) % np.uint64(parts)

    def ask(self, at: np.ndarray) -> bytes:
        first, n = np.unique(self.pair[at] >> np.uint64(32), return_counts=True)
        head = np.cumsum(n) - n
        word = (self.pair[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pack(gaps(first), n.astype(np.uint32), word, narrow(self.after[at]), narrow(self.count[at]), self.hot[at][head].astype(np.uint8))

    @classmethod
    def merged(cls, asks: list[bytes], parts: int) -> Pairs:
        sent = [unpack(d) for d in asks]
        firsts = [np.cumsum(f) for f, *_ in sent]
        pair = np.concatenate([np.repeat(f, x[1]) << np.uint64(32) | x[2] for f, x in zip(firsts, sent, strict=True)])
        known, index, where = np.unique(pair, return_index=True, return_inverse=True)
        del pair
        total = _sums(where, np.concatenate([x[4] for x in sent]), len(known))
        out = cls(known, np.concatenate([x[3] for x in sent])[index], total, np.concatenate([np.repeat(x[5], x[1]) for x in sent])[index] == 1, parts)
        out.places, out.asked = np.split(where, np.cumsum([len(x[2]) for x in sent])[:-1]), firsts
        return out

    def by_first(self) -> tuple[np.ndarray, np.ndarray]:
        """The first words, and the place among them of each pair's."""
        change = np.concatenate([[True], np.diff(self.pair >> np.uint64(32)) != 0])
        return (self.pair >> np.uint64(32))[change], np.cumsum(change) - 1

    def answer(self, uni: Unigrams) -> None:
        """At a partition: what the pairs tell of their first words."""
        self.total = self.count
        self.firsts, at = self.by_first()
        beyond = np.where(self.total > TOP, self.total, np.uint64(0))
        self.tally = np.stack([np.bincount(at, self.total == r, len(self.firsts)).astype(np.uint64) for r in range(1, TOP + 1)] + [_sums(at, beyond, len(self.firsts))])
        self.mass = np.bincount(at, np.where(self.total > 0, uni(self.after), 0.0), len(self.firsts))

    def gather(self, found: Iterator[tuple[np.ndarray, bytes]]) -> None:
        """Between, or at a block: take in the answers on some places each."""
        self.firsts, of = self.by_first()
        self.total = np.zeros(len(self.pair), np.uint64)
        self.tally, self.mass = np.zeros((TOP + 1, len(self.firsts)), np.uint64), np.zeros(len(self.firsts))
        for at, data in found:
            c, *tally, m = unpack(data)
            here = np.unique(of[at])
            self.total[at], self.tally[:, here], self.mass[here] = c, np.stack(tally), m

    def replies(self) -> list[bytes]:
        out = []
        for where, f in zip(self.places, self.asked, strict=True):
            at = np.searchsorted(self.firsts, f)
            out.append(pack(narrow(self.total[where]), *(narrow(t) for t in self.tally[:, at]), self.mass[at]))
        return out


class Exchange:
    """The levels of nodes between blocks and partitions; both word and pair rounds go through them.

    A partition's number is read as ``depth`` digits below ``fan``. A node of level n holds what the blocks of one
    group (of about fan ** n) ask of the partitions with the same first n digits; a child's message holds the items
    of one next digit. At the last level there is one group, and its nodes are the partitions.
    """

    def __init__(self, blocks: int, pieces: int, fan: int):
        self.blocks, self.depth = max(1, blocks), 1
        while fan**self.depth < max(blocks, pieces):
            self.depth += 1
        self.fan = pieces if self.depth == 1 else max(2, next(f for f in range(2, fan + 1) if f**self.depth >= max(blocks, pieces)))
        self.parts = self.fan**self.depth

    def messages(self, child: int, level: int, items: Words | Pairs) -> Iterator[tuple[int, int, bytes]]:
        """``(node of the level, digit, data)`` from a child of the level below (block: level 0)."""
        groups = 1 if level == self.depth else max(1, -(-self.blocks // self.fan**level))
        group = int(_mix(np.array([child], np.uint64) + np.uint64(level))[0]) % groups
        for digit, at in self.split(level, items):
            cell = int(items.q[at[0]]) % self.fan**level
            yield group * self.fan**level + cell, digit, items.ask(at)

    def split(self, level: int, items: Words | Pairs) -> Iterator[tuple[int, np.ndarray]]:
        return _by_part(items.q // np.uint64(self.fan ** (level - 1)) % np.uint64(self.fan))

    def answers(self, items: Words | Pairs, level: int, rows: pd.DataFrame) -> None:
        """Give ``items`` of a child the answers that rows ``digit, data`` hold."""
        found = dict(zip(rows["digit"], rows["data"], strict=True))
        items.gather((at, found[digit]) for digit, at in self.split(level, items))

    def run(self, asked: DataFrame, kind: type, root: Callable, extra: str, name: str) -> tuple[DataFrame, DataFrame]:
        """From the blocks' messages ``node, child, digit, data`` to answers ``child, digit, data`` for the blocks.

        ``root`` turns a partition's merged items into answers and returns a table of more columns, ``extra``; the
        second table holds them (its ``child`` is -1 or less).
        """
        columns, parts = "node bigint, child bigint, digit int, data binary", self.parts

        def up(level: int) -> Callable:
            def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
                items = kind.merged(rows["data"].tolist(), parts)
                out = [(node, key[0], digit, data) for node, digit, data in self.messages(int(key[0]), level, items)]
                return pd.DataFrame(out, columns=["node", "child", "digit", "data"])

            return run

        def down(level: int) -> Callable:
            def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                left = left.sort_values("child")
                items = kind.merged(left["data"].tolist(), parts)
                self.answers(items, level, right)
                return pd.DataFrame({"child": left["child"].to_numpy(), "digit": left["digit"].to_numpy(), "data": items.replies()})

            return run

        def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("child")
            items = kind.merged(rows["data"].tolist(), parts)
            more = root(int(key[0]), items)
            return pd.concat([pd.DataFrame({"child": rows["child"].to_numpy(), "digit": rows["digit"].to_numpy(), "data": items.replies()}), more])[["child", "digit", "data", *names]].astype(kinds)

        schema = StructType.fromDDL(extra)
        names = schema.names
        kinds = {"digit": "Int32"} | {f.name: "Int64" for f in schema if f.dataType.typeName() == "long"}
        levels = [asked]
        for level in range(2, self.depth + 1):
            levels[-1] = stored(levels[-1], f"{name}-asked")
            levels.append(levels[-1].groupBy("node").applyInPandas(up(level), columns))
        found = stored(levels[-1].groupBy("node").applyInPandas(last, f"child bigint, digit int, data binary, {extra}"), name)
        replies = found.filter("child >= 0").select("child", "digit", "data")
        for level in range(self.depth, 1, -1):
            replies = stored(levels[level - 2].groupBy("node").cogroup(replies.groupBy("child")).applyInPandas(down(level), "child bigint, digit int, data binary"), name)
        return replies, found.filter("child < 0")


_COUNTS = [f"n{r}" for r in range(1, TOP + 2)]


def word_counts(held: DataFrame, tree: Exchange) -> tuple[DataFrame, DataFrame]:
    """Each block's words' numbers and training counts over all blocks, and statistics of each partition.

    Words are numbered within their partition from the most frequent down, so common words have small numbers.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                b = Block(data)
                count = np.bincount(b.tokens[b.trained()], minlength=len(b.words)).astype(np.uint64)
                node, digit, out = zip(*tree.messages(block, 1, Words(b.words, count, tree.parts)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([block] * len(node), pa.int64()), pa.array(digit, pa.int32()), pa.array(out, pa.binary())], names=["node", "child", "digit", "data"])

    def root(part: int, items: Words) -> pd.DataFrame:
        items.total = items.count
        seen = items.total > 0
        items.number = np.full(len(seen), UNSEEN, np.uint64)
        order = np.lexsort((items.keys, ~items.total))[: int(seen.sum())]
        items.number[order] = np.arange(len(order), dtype=np.uint64) * np.uint64(tree.parts) + np.uint64(part + UNSEEN + 1)
        if len(order) and int(items.number[order[-1]]) >> 32:
            raise OverflowError("more words than 32-bit numbers")
        return pd.DataFrame({"child": [-1], "kinds": [int(seen.sum())], **_stat_columns(items.total)})

    asked = held.select("block", "data").mapInArrow(ask, "node bigint, child bigint, digit int, data binary")
    return tree.run(asked, Words, root, "kinds bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS), "lm-words")


class Asked:
    """A block with its words' numbers and counts, and its distinct pairs; ``counted``: with their counts in training."""

    def __init__(self, data: bytes, rows: pd.DataFrame, tree: Exchange, docs: int, hot_from: float, counted: bool):
        self.block = b = Block(data)
        words = Words(b.words, b.words, tree.parts)
        tree.answers(words, 1, rows)
        self.count = words.total
        self.each = b.pairs(words.number)
        pair = np.unique(self.each)
        order = np.argsort(words.number, kind="stable")
        self.sorted, self.by_number = words.number[order], words.total[order]
        before = pair >> np.uint64(32)
        self.before = np.where(before == 0, np.uint64(docs), self.of(before))  # the first word's training count
        self.after = self.of(pair & np.uint64(0xFFFFFFFF))
        count = np.zeros(len(pair), np.uint64)
        if counted:
            mine, n = np.unique(self.each[b.trained()], return_counts=True)
            count[np.searchsorted(pair, mine)] = n
        self.pairs = Pairs(pair, self.after, count, self.before >= hot_from, tree.parts)

    def of(self, number: np.ndarray) -> np.ndarray:
        """Training counts of words by number (of any number for 0)."""
        return self.by_number[np.minimum(np.searchsorted(self.sorted, number), len(self.sorted) - 1)]


def pair_counts(held: DataFrame, words: DataFrame, tree: Exchange, docs: int, hot_from: float, uni: Unigrams) -> tuple[DataFrame, DataFrame]:
    """Answers on each block's distinct pairs; rows of child -1 are statistics, of -2 partitions' shares of hot words."""

    def ask(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine = Asked(left["data"].iloc[0], right, tree, docs, hot_from, True)
        return pd.DataFrame([(node, key[0], digit, data) for node, digit, data in tree.messages(int(key[0]), 1, mine.pairs)], columns=["node", "child", "digit", "data"])

    def root(part: int, items: Pairs) -> pd.DataFrame:
        items.answer(uni)
        firsts, at = items.by_first()
        h = np.flatnonzero(np.bincount(at, items.hot, len(firsts)))
        shares = {"word": firsts[h].astype(np.int64), "mass": items.mass[h], **dict(zip(_COUNTS, items.tally[:, h].astype(np.int64), strict=True))}
        return pd.concat([pd.DataFrame({"child": [-1], "word": [-1], "mass": [0.0], **_stat_columns(items.total)}), pd.DataFrame({"child": -2, **shares})])

    asked = held.select("block", "data").groupBy("block").cogroup(words.groupBy("child")).applyInPandas(ask, "node bigint, child bigint, digit int, data binary")
    return tree.run(asked, Pairs, root, "word bigint, mass double, " + ", ".join(f"{c} bigint" for c in _COUNTS), "lm-pairs")


def hot_words(words: DataFrame, docs: int, hot_from: float) -> DataFrame:
    """``child, word``: the hot words that each block holds, a document's start (0) included if it is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for child, digit, data in zip(batch.column("child").to_pylist(), batch.column("digit").to_pylist(), batch.column("data").to_pylist(), strict=True):
                number, total = unpack(data)
                hot = number[total >= hot_from].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([child] * len(hot), pa.int64()), pa.array(hot)], names=["child", "word"])

    found = words.select("child", "digit", "data").mapInArrow(run, "child bigint, word bigint")
    return found.unionByName(words.select("child", F.lit(0).cast("bigint").alias("word")).distinct()) if docs >= hot_from else found


def pair_probability(count: np.ndarray, before: np.ndarray, weight: np.ndarray, seen_mass: np.ndarray, after: np.ndarray, factor: np.ndarray, uni: Unigrams) -> np.ndarray:
    """P(w | h): the recursion from the pair to the word.

    ``weight``: the discounted counts of all pairs of h; ``seen_mass``: P summed over the words seen after h.
    """
    norm = np.where(before - weight > 1e-9 * np.maximum(before, 1), before, before + 1.0)
    alpha = np.where(before > 0, (1 - weight / np.maximum(norm, 1)) / np.maximum(1 - seen_mass, 1e-300), 1.0)
    d = np.where(count > TOP, 1.0, factor[np.minimum(count, TOP)])
    return np.where(count > 0, d * count / np.maximum(norm, 1), alpha * uni(after))


def katz_scores(df: DataFrame, held: int = 1, parts: int = 5, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Score every text with a model of the texts outside the held-out part.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A null text is the empty
    text (its end is its only token); a null id trains; repeated rows each count and are each scored; other
    columns are ignored; without training texts every probability is 1. Words are told apart by 64-bit hashes.
    """
    rows = stored(blocks(df, held, parts, id_col, text_col, block_tokens), "lm-blocks")
    size = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0)), F.count(F.lit(1))).first()
    tree = Exchange(int(size[2]), max(1, -(-int(size[0]) // part_tokens)), FAN)

    def sums(t: DataFrame, *more: str) -> list[int]:
        return [int(x or 0) for x in t.filter("child = -1").agg(*(F.sum(c) for c in (*more, *_COUNTS))).first()]

    words, stats = word_counts(rows, tree)
    kinds, *seen = sums(stats, "kinds")
    total = int(size[1])
    uni = Unigrams(total, kinds, seen)
    trained_docs = stored_count(df, held, parts, id_col)
    hot_from = max(1.0, part_tokens / HOT_SHARE)
    pairs, stats = pair_counts(rows, words, tree, trained_docs, hot_from, uni)
    factor = discounts(sums(stats))
    steps = np.array([factor[r] * r for r in range(1, TOP + 1)] + [1.0])
    shares = stats.filter("child = -2").groupBy("word").agg(F.sum("mass").alias("mass"), *(F.sum(c).alias(c) for c in _COUNTS))
    shares = hot_words(words, trained_docs, hot_from).join(shares, "word")

    def score(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine = Asked(left["data"].iloc[0], right[right["kind"] == 0], tree, trained_docs, hot_from, False)
        b, p = mine.block, mine.pairs
        tree.answers(p, 1, right[right["kind"] == 1])
        _, at = p.by_first()
        weight, mass = (steps @ p.tally.astype(float))[at], p.mass[at]
        h = np.flatnonzero(p.hot)
        if len(h):
            hot = right[right["kind"] == 2].sort_values("word")
            at = np.searchsorted(hot["word"].to_numpy(np.uint64), p.pair[h] >> np.uint64(32))
            weight[h], mass[h] = (hot[_COUNTS].to_numpy(float) @ steps)[at], hot["mass"].to_numpy(float)[at]
        log = np.log10(pair_probability(p.total.astype(np.int64), mine.before.astype(float), weight, mass, mine.after, factor, uni))
        each = log[np.searchsorted(p.pair, mine.each)]
        c = mine.count[b.tokens]
        return pd.DataFrame({
            "doc_id": pd.Series(b.ids).mask(b.null == 1).astype("Int64"), "held_out": b.held == 1, "n_tokens": b.size.astype(np.int64),
            "n_known": np.add.reduceat((c > 0).astype(np.int64), b.begins), "train_tokens": total,
            "base_score": np.add.reduceat(uni.base(c), b.begins), "score": np.add.reduceat(each, b.begins),
        })

    replies = [t.withColumn("kind", F.lit(k)) for k, t in enumerate((words, pairs, shares))]
    right = replies[0].unionByName(replies[1]).unionByName(replies[2], allowMissingColumns=True)
    return rows.select("block", "data").groupBy("block").cogroup(right.groupBy("child")).applyInPandas(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def stored_count(df: DataFrame, held: int, parts: int, id_col: str) -> int:
    """Training documents: how often the start of a text was a word before."""
    from .common import quoted

    doc = F.col(quoted(id_col)).cast("bigint").cast("string").cast("binary")
    return df.filter(F.coalesce(F.crc32(doc) % parts != held, F.lit(True))).count()
