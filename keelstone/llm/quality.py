"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features come from the text alone. Training bins each feature into at most 64 quantile bins and grows
depth-wise trees on logistic loss from gradient histograms. The trees are perfect binary trees flattened
into arrays, so scoring a batch is ``depth`` gathers for each tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, quoted, slices, texts, with_text

#: Rows that a fit collects at most, taken by the hash of the id: a documented bound of a learned model's sample.
FIT_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "mean_word", "max_word", "letters", "upper", "digits", "spaces", "symbols", "bangs", "pipes",
    "stops", "commas", "unique_words", "top_word", "repeat_pairs", "unique_lines", "mean_line", "upper_words", "ends_symbol",
    "short_words", "entropy", "non_ascii",
)

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*@^~+=<>{}[]\\/_`"]] = True
_ENDS = re.compile(rb"[^\w\s.,;:!?\"')\]\x80-\xff-](?=\s|$)")


def statistics(text: str) -> list[float]:
    """The features of one text; all finite, the empty text included."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = max(1, len(words))
    low = [w.lower() for w in words]
    counts: dict[bytes, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(low, low[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = seen[seen > 0] / n
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(raw) / k, np.log1p(max(map(len, words), default=0)), (upper + lower) / n, upper / max(1, upper + lower),
        seen[48:58].sum() / n, (seen[32] + seen[9:14].sum()) / n, seen[_SYMBOLS].sum() / n, seen[33] / n, seen[124] / n,
        seen[46] / n, seen[44] / n, len(counts) / k, max(counts.values(), default=0) / k, 1 - pairs / max(1, len(low) - 1) if len(low) > 1 else 0.0,
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), sum(map(bytes.isupper, words)) / k, len(_ENDS.findall(raw)) / k,
        sum(len(w) < 3 for w in words) / k, -float((p * np.log2(p)).sum()) if len(raw) else 0.0, seen[128:].sum() / n,
    ]


def features(batch: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in batch], np.float32).reshape(len(batch), len(FEATURES))


@dataclass
class Forest:
    """Trees of one depth, flattened: node i of a tree has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray  # go right where the feature is above
    leaf: np.ndarray  # trees x 2^depth
    base: float
    depth: int

    def logit(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - len(f)]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Forest:
    """Boost ``trees`` trees on logistic loss. No rows, or one class only: the constant prior."""
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    if len(y) == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    m, logit = x.shape[1], np.full(len(y), base)
    flat = binned + np.arange(m) * bins
    out_f, out_c, out_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        tree_f, tree_c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (node - first)[:, None] * (m * bins) + flat
            size = width * m * bins
            hist = [np.bincount(at.ravel(), weights=np.repeat(v, m), minlength=size).reshape(width, m, bins).cumsum(axis=2) for v in (g, h, np.ones(len(y)))]
            gl, hl, nl = (v[:, :, :-1] for v in hist)
            gt, ht, nt = (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            worth = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            f, b = best // (bins - 1), best % (bins - 1)
            for i in range(width):
                if worth[i] and b[i] < len(edges[f[i]]):
                    tree_f[first + i], tree_c[first + i] = f[i], edges[f[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), tree_f[node]] > tree_c[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, leaves) / (np.bincount(slot, h, leaves) + ridge)
        logit += leaf[slot]
        out_f.append(tree_f)
        out_c.append(tree_c)
        out_l.append(leaf)
    return Forest(np.array(out_f), np.array(out_c), np.array(out_l), base, depth)


def bucket(id_col: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(quoted(id_col)).cast("bigint").cast("string").cast("binary")) % parts


def learn(docs: DataFrame, labels: DataFrame, held: int = 2, parts: int = 4, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fit from labelled texts outside the held-out part.

    At most ``rows`` labelled rows are collected, those with the smallest hash of their id: a fixed bound
    whatever the corpus size. Their features are computed on the executors. An id that is labelled twice
    takes the larger label, of texts that repeat an id the one with the least features counts; null labels,
    ids and texts are left out.
    """
    mine = labels.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(label_col)).cast("int").alias("_y"))
    mine = mine.filter(F.col("doc_id").isNotNull() & F.col("_y").isNotNull() & (bucket("doc_id", parts) != held)).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    mine = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).filter("text IS NOT NULL")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = features(texts(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    # the labelled side has at most `rows` rows of two numbers, so it may be broadcast at any corpus size
    measured = known.join(F.broadcast(mine), "doc_id").select("doc_id", "_y", "text").mapInArrow(measure, "doc_id bigint, y int, x array<float>")
    # one row of an id, combined before the shuffle, so that the bound holds however often documents repeat
    got = measured.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("b")).select("b.y", "b.x").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES)), np.float32), np.zeros(0))
    x = np.array(got["x"].to_pylist(), np.float32)
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same sample gives the same trees, however it was gathered
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, held: int = 2, parts: int = 4, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; no shuffle.

    A null text scores as the empty text, a null id is never held out; repeated rows score alike; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            p = forest.predict(features(texts(part)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array(p >= threshold).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(bucket("doc_id", parts) == held, F.lit(False))
    return id_text(docs, id_col, text_col).withColumn("held_out", held_out).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, forest: Forest, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; a null text scores as the empty text."""

    def keep(part: pa.RecordBatch, rows: list[str | None]) -> pa.RecordBatch:
        return part.filter(pa.array(forest.predict(features([t or "" for t in rows])) >= threshold))

    return with_text(docs, text_col, keep)
