"""Byte-pair encoding by a prefix-sharing trie.

The encoding of a text's prefix is fixed by its last token alone: take that token away and what is
left is again the encoding of a shorter prefix. So one pass over a trie of distinct words finds, at each
node, the one vocabulary token that can end the prefix there, from the last tokens of the nodes above;
words with a common prefix share that work.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .common import id_text, slices, texts

#: The words that the byte-level pre-tokenizer splits by, for given sets of letters, numbers and white space.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: The code points that Unicode has given or may soon give classes to (the planes beyond hold none, or private ones).
PLANES = 0x40000

#: Words whose encodings a worker keeps between batches, and token pairs whose verdicts it keeps.
KEPT_WORDS, KEPT_PAIRS = 250_000, 400_000


@cache
def library_classes() -> dict[str, list[tuple[int, int]]]:
    """The library's own letters, numbers and white space, as ranges of code points (first, last).

    Python's Unicode tables are of another version, so nothing is taken from them; once in a process.
    """
    points = [*range(0xD800), *range(0xE000, PLANES)]
    every = "".join(map(chr, points))
    out = {}
    for name, one in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        found = Split(Regex(one + "+"), "removed", invert=True).pre_tokenize_str(every)
        out[name] = []
        for text, _ in found:  # a run may pass over the surrogates, which no text holds
            out[name].append((ord(text[0]), ord(text[-1])))
    return out


def words_pattern() -> str:
    """PATTERN with the library's classes spelt out."""
    spelt = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in library_classes().items()}
    return PATTERN.format(**spelt)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A merge table: symbols are strings, tokens are ids; tells which neighbours an encoding may have."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.vocab = vocab
        top = max(vocab.values(), default=-1) + 1
        self.rank, self.left, self.right = [-1] * top, [-1] * top, [-1] * top
        self.joined: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            whole = self.whole(a, b)
            if whole in vocab:
                x, y, t = vocab[a], vocab[b], vocab[whole]
                self.joined.setdefault(x << 20 | y, rank)
                if self.rank[t] < 0:
                    self.rank[t], self.left[t], self.right[t] = rank, x, y
        self.verdicts: dict[int, bool] = {}

    @staticmethod
    def whole(a: str, b: str) -> str:
        return a + b

    def walk(self, a: int, b: int, joined: bool) -> bool:
        """Whether no merge ever crosses the border between a and b while each is built up.

        Follows both tokens back in time, undoing the later merge first. The tokens that touch the border
        at some moment merge if their rank is due before the next merge on either side; between equal
        ranks the left one is earlier. ``joined``: whether a and b themselves must not merge.
        """
        rank, until_a, until_b = self.rank, 1 << 30, 1 << 30
        while True:
            if joined and (m := self.joined.get(a << 20 | b)) is not None and m < until_a and m <= until_b:
                return False
            joined = True
            if rank[a] > rank[b]:
                until_a, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                until_b, b = rank[b], self.left[b]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """Whether an encoding can hold token a right before token b."""
        key = a << 20 | b
        found = self.verdicts.get(key)
        if found is None:
            if len(self.verdicts) >= KEPT_PAIRS:
                self.verdicts.clear()
            found = self.verdicts[key] = self.walk(a, b, True)
        return found

    def reachable(self) -> list[bool]:
        """Of each token, whether its own text is encoded as that token."""
        good = [True] * len(self.rank)
        for t in sorted(range(len(self.rank)), key=self.rank.__getitem__):
            if self.rank[t] >= 0:
                a, b = self.left[t], self.right[t]
                good[t] = good[a] and good[b] and self.within(a, b, self.rank[t])
        return good

    def within(self, a: int, b: int, rank: int) -> bool:
        rank_of, until_a, until_b = self.rank, rank, rank
        if max(rank_of[a], rank_of[b]) >= rank:
            return False
        while rank_of[a] >= 0 or rank_of[b] >= 0:
            if rank_of[a] > rank_of[b]:
                until_a, a = rank_of[a], self.right[a]
            else:
                until_b, b = rank_of[b], self.left[b]
            m = self.joined.get(a << 20 | b)
            if m is not None and m < until_a and m <= until_b:
                return False
        return True


class TrieEncoder:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        good, symbols = self.merges.reachable(), byte_symbols()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        top = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token_bytes, self.token_text = [b""] * top, [str(i) for i in range(top)]
        self.ids: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token in self.special:
                continue
            self.token_bytes[i] = bytes(symbols[c] for c in token)
            if good[i]:
                self.ids[self.token_bytes[i]] = i
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.begins = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self.words = re.compile(words_pattern())
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {t: (i,) for t, i in self.special.items()}

    def traverse(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Encodings of sorted distinct words.

        Sorted order is the depth-first order of the words' trie; ``last`` holds the last token of each node
        from the root to the present one, so going to the next word keeps the states of the shared prefix.
        """
        ids, begins, fits, size = self.ids.get, self.begins, self.merges.fits, self.token_bytes
        verdict = self.merges.verdicts.get
        # first: of each node, where the longest end of it that begins a token starts; tokens that end below do not start earlier
        last, first, before = [-1], [0], b""
        for word in words:
            shared, n = 0, min(len(before), len(word))
            while shared < n and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], first[shared + 1 :]
            low = first[-1]
            for depth in range(shared + 1, len(word) + 1):
                while word[low:depth] not in begins:
                    low += 1
                first.append(low)
                for start in range(low, depth):
                    token = ids(word[start:depth])
                    if token is None:
                        continue
                    if start:
                        known = verdict(last[start] << 20 | token)
                        if not (fits(last[start], token) if known is None else known):
                            continue
                    last.append(token)
                    break
            out, depth = [], len(word)
            while depth:
                out.append(token := last[depth])
                depth -= len(size[token])
            out.reverse()
            yield tuple(out)
            before = word

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a word of its own."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.words.findall(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.words.findall(part))]

    def encode(self, batch: Iterable[str]) -> list[list[int]]:
        """Token ids of each text, as ``encode(text, add_special_tokens=False)`` gives them."""
        split = [self.split(t) for t in batch]
        cache = self.cache
        new = set().union(*split) - cache.keys()
        if len(cache) + len(new) > KEPT_WORDS:
            cache = self.cache = {t: (i,) for t, i in self.special.items()}
            new = set().union(*split) - cache.keys()
        order = sorted((w.encode("utf-8", "replace"), w) for w in new)
        cache.update(zip((w for _, w in order), self.traverse([b for b, _ in order]), strict=True))
        return [list(chain.from_iterable(map(cache.__getitem__, words))) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of some ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: Iterable[int]) -> str:
        return ",".join(map(self.token_text.__getitem__, ids))


_LOADED: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each file and worker process; its word cache is bounded."""
    if path not in _LOADED:
        _LOADED[path] = TrieEncoder(path)
    return _LOADED[path]


def bpe_encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode each text and decode its ids again; no shuffle, state of one batch only.

    ``tokenizer`` is the path of a byte-level BPE file, readable on every executor. Returns ``doc_id,
    n_tokens, ids, decoded``; with ``digests`` the SHA-256 of the comma-joined ids and of the decoded text
    in place of the last two. A null text counts as empty (no ids, empty decoded text); a null id and
    repeated rows are kept, one row out for each row in; other columns are ignored.
    """
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for part in slices(batches):
            ids = coder.encode(texts(part))
            n = pa.array([len(x) for x in ids], pa.int64())
            if digests:
                a = pa.array([hashlib.sha256(coder.joined(x).encode()).hexdigest() for x in ids], pa.string())
                b = pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids], pa.string())
            else:
                a, b = pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids], pa.string())
            names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, a, b], names=["doc_id", "n_tokens", *names])

    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id bigint, n_tokens bigint, {tail}")
