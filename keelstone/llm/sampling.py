"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms. For each sample, every term draws two gamma variates and a uniform from
its own hash, which fix a quantised weight t and a value a; the term with the smallest a is the sample. Two
texts draw the same (term, t) with a probability equal to their generalised Jaccard similarity, the sum of
smaller weights over the sum of larger ones, so the share of equal samples estimates it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import id_text, slices, texts

#: Samples in a fingerprint (the likeness has a standard error of at most 0.063); terms whose draws a worker keeps.
SAMPLES, KEPT = 64, 150_000
#: Words longer than this are cut where two neighbouring characters say so, every 16 characters or so: for scripts without spaces.
LONG_WORD, CUT = 40, 16
#: Rows in a bucket of neighbouring documents; code points by which rows of one id are told apart.
BUCKET_ROWS, TIE = 8192, 16


def terms(text: str) -> Counter:
    """Lower-cased words with their counts."""
    words = text.lower().split()
    found = Counter(words)
    for w in [w for w in found if len(w) > LONG_WORD]:
        n = found.pop(w)
        code = np.frombuffer(w.encode("utf-32-le", "replace"), np.uint32)
        marks = ((code[:-1] * np.uint32(31) + code[1:]) * np.uint32(2654435761)) >> np.uint32(28)
        ends = [*(np.flatnonzero(marks % CUT == 0) + 1).tolist(), len(w)]
        for a, b in zip([0, *ends], ends, strict=False):
            found[w[a:b]] += n
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Draws of (term, count) pairs, kept in two tables that are dropped when full."""

    def __init__(self, samples: int = SAMPLES, kept: int = KEPT):
        self.samples, self.kept = samples, kept
        self.clear()
        self.value = np.zeros((1024, samples), np.float32)
        self.mark = np.zeros((1024, samples), np.uint16)

    def clear(self) -> None:
        self.once: dict[str, int] = {}
        self.often: dict[tuple[str, int], int] = {}
        self.used = 0

    def draw(self, keys: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Values and 16-bit marks (1 and up) of terms; a term weighs its count times its squared length."""
        h = np.array([xxh64_intdigest(w.encode("utf-8", "replace"), 7) for w, _ in keys], np.uint64)[:, None]
        weight = np.log(np.array([c * len(w) ** 2 for w, c in keys], np.float32))[:, None]
        s = np.arange(self.samples, dtype=np.uint64)

        def uniform(bits: np.ndarray) -> np.ndarray:
            """A uniform of 23 bits, neither 0 nor 1."""
            return ((bits & np.uint64(0x7FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23)

        x = _mix(h + (2 * s + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        y = _mix(h + (2 * s + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15))
        r = -np.log(uniform(x) * uniform(x >> np.uint64(41)))  # gamma of shape 2
        c = -np.log(uniform(y) * uniform(y >> np.uint64(41)))
        b = (x >> np.uint64(23) & np.uint64(0x3FFFF)).astype(np.float32) * np.float32(2.0**-18)
        t = np.floor(weight / r + b)
        value = np.log(c) - r * (t - b) - r
        mark = (y >> np.uint64(23) ^ t.astype(np.int64).view(np.uint64) * np.uint64(40503)) & np.uint64(0xFFFF)
        return value.astype(np.float32), np.maximum(mark, 1).astype(np.uint16)

    def rows(self, found: Counter) -> np.ndarray:
        """Table rows of a text's terms; draws what is new."""
        once, often = self.once, self.often
        at = [once.get(w, -1) if c == 1 else often.get((w, c), -1) for w, c in found.items()]
        new = [(i, k) for i, (a, k) in enumerate(zip(at, found.items(), strict=True)) if a < 0] if -1 in at else []
        for j in range(0, len(new), 4096):
            some = new[j : j + 4096]
            first, last = self.used, self.used + len(some)
            if last > len(self.value):
                for name in ("value", "mark"):
                    old = getattr(self, name)
                    wide = np.zeros((max(last, len(old) * 3 // 2), self.samples), old.dtype)
                    wide[:first] = old[:first]
                    setattr(self, name, wide)
            self.value[first:last], self.mark[first:last] = self.draw([k for _, k in some])
            for row, (i, (w, c)) in enumerate(some, first):
                at[i] = row
                if c == 1:
                    once[w] = row
                else:
                    often[w, c] = row
            self.used = last
        return np.array(at, np.int64)

    def signatures(self, batch: list[str]) -> np.ndarray:
        """One row of marks for each text; zeros for a text without terms."""
        out = np.zeros((len(batch), self.samples), np.uint16)
        every = np.arange(self.samples)
        for i, text in enumerate(batch):
            found = terms(text)
            if not found:
                continue
            best = np.full(self.samples, np.inf, np.float32)
            for v, mark in self.draws(found):
                low = v.argmin(axis=0)
                take = v[low, every] < best
                best = np.where(take, v[low, every], best)
                out[i] = np.where(take, mark(low, every), out[i])
        return out

    def draws(self, found: Counter) -> Iterator[tuple[np.ndarray, Callable]]:
        """A text's values, some rows at a time, each with the function that gives its marks."""
        if len(found) > self.kept // 4:  # too many to keep: drawn and dropped
            keys = list(found.items())
            for k in range(0, len(keys), 4096):
                value, mark = self.draw(keys[k : k + 4096])
                yield value, lambda low, every, mark=mark: mark[low, every]
            return
        if self.used + len(found) > self.kept:
            self.clear()
        rows = self.rows(found)
        for k in range(0, len(rows), 8192):
            part = rows[k : k + 8192]
            yield self.value[part], lambda low, every, part=part: self.mark[part[low], every]


_LOADED: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    """One sampler for each worker process; its tables are bounded."""
    if samples not in _LOADED:
        _LOADED[samples] = Sampler(samples)
    return _LOADED[samples]


def as_text(rows: np.ndarray) -> list[str]:
    """Fingerprints as text: four hex digits for each sample."""
    return [r.astype(">u2").tobytes().hex() for r in rows]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row: an estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def fingerprints(df: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row; no shuffle.

    A null text counts as empty; texts without words all have the fingerprint of zeros; null ids and repeated
    rows are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(as_text(sampler(samples).signatures(texts(part))), pa.string())], names=["doc_id", "fingerprint"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as much of the following text's start."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def beside_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into buckets of neighbouring ids: ``bucket, borrowed, doc_id, text``, sorted in each partition.

    Each bucket ends with a copy of the next bucket's first row (``borrowed``), so every row stands before its
    successor in some bucket, and the texts are shuffled once. The order is that of ids (null ids last), then of
    the texts' first TIE code points, then of the rows' places in the table, so rows that share an id, or have
    none, are dealt into as many buckets as others. The driver holds one row for each BUCKET_ROWS rows.
    """
    docs = id_text(df, id_col, text_col).withColumn("tie", F.substring("text", 1, TIE)).withColumn("place", F.monotonically_increasing_id())
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("place")]
    ranged = docs.select("doc_id", "tie", "place").repartitionByRange(buckets, *order).groupBy(F.spark_partition_id().alias("part"))
    firsts = ranged.agg(F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "tie", "place")).alias("e")).select("e.*").orderBy("gone", "doc_id", "tie", "place").toArrow()
    known = firsts["doc_id"].drop_null().to_numpy()  # of the first rows with an id; the others come after them
    ties, begins = firsts["tie"].combine_chunks(), firsts["place"].to_numpy()
    n = len(begins)

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array, tie: pa.Array, place: pa.Array) -> pa.Array:
        gone = ids.is_null().to_numpy(zero_copy_only=False)
        value = ids.fill_null(0).to_numpy()
        low = np.where(gone, len(known), np.searchsorted(known, value, side="left"))
        high = np.where(gone, n, np.searchsorted(known, value, side="right"))
        own = (high - 1).tolist()
        out = [[x] for x in own]
        rests: dict[int, list] = {}
        for i in np.flatnonzero(low < high).tolist():  # some bucket begins with this id
            a, b = int(low[i]), int(high[i])
            if a not in rests:
                rests[a] = list(zip(ties[a:b].to_pylist(), begins[a:b].tolist(), strict=True))
            key = (tie[i].as_py(), place[i].as_py())
            at = a + bisect_right(rests[a], key) - 1
            out[i] = [at, (at - 1) % n] if at >= a and rests[a][at - a] == key else [at]
        return pa.array(out, pa.list_(pa.int32()))

    dealt = docs.select("doc_id", "text", "tie", "place", F.posexplode(places("doc_id", "tie", "place")).alias("borrowed", "bucket"))
    dealt = dealt.repartitionById(max(n, 1), F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "borrowed", *order).select("bucket", "borrowed", "doc_id", "text")


def edited_likeness(df: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next
    document is the one with the next larger id, after the last the first; rows with one id follow each other by
    their texts' first TIE code points, then by their places in the table, null ids come last; a table of one row is its own next. A null text counts as empty; other
    columns are ignored.
    """

    def flush(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        made = [edited(t, nxt) for _, t, nxt in rows]
        coder = sampler(samples)
        mine = coder.signatures([t for _, t, _ in rows])
        other = coder.signatures(made)
        # the next row's own fingerprint, most often the row after this one in the same batch
        known = {id(t): i for i, (_, t, _) in enumerate(rows)}
        late = [i for i, (_, _, nxt) in enumerate(rows) if id(nxt) not in known]
        extra = dict(zip(late, coder.signatures([rows[i][2] for i in late]), strict=True))
        following = np.stack([extra[i] if i in extra else mine[known[id(nxt)]] for i, (_, _, nxt) in enumerate(rows)])
        columns = [
            pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in made]), pa.array(as_text(mine)), pa.array(as_text(other)),
            pa.array(likeness(mine, other)), pa.array(likeness(mine, following)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # a row whose successor has not come yet
        current = None
        rows: list[tuple[int | None, str, str]] = []
        size = 0
        done = None  # a bucket whose last row has met its successor
        for part in slices(batches):
            for bucket, borrowed, doc, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "borrowed", "doc_id", "text")), strict=True):
                if bucket == done:
                    continue
                if bucket != current and waiting is not None:
                    raise RuntimeError(f"the rows changed between two scans: bucket {current} has no successor")
                current = bucket
                if waiting is not None:
                    rows.append((*waiting, text))
                    size += len(text)
                if borrowed:
                    waiting, done = None, bucket
                else:
                    waiting = (doc, text)
                if size > 1 << 21:
                    yield flush(rows)
                    rows, size = [], 0
        if waiting is not None:
            raise RuntimeError(f"the rows changed between two scans: bucket {current} has no successor")
        if rows:
            yield flush(rows)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(df, id_col, text_col).mapInArrow(run, schema)
