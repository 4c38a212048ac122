"""Token counts by a compiled finite-state transducer.

A word-level BPE file becomes a deterministic transducer over code points. A state holds what the rest of
a text can still depend on: the lexer's mode, and of each position at which a token could have begun, the
last token there and its count relative to now. A transition is annotated with the tokens it emits (it may
take some back, when a longer token absorbs shorter ones). States and transitions are compiled when first
met and kept in one table, so a step over thousands of chunks is one gather.

Texts are cut into chunks. Each chunk gets a state map: for each state it may start in, the state it ends in
and the tokens emitted. The maps compose through a prefix scan (log2 of the chunks' number of rounds), which
tells each chunk's real start and so each text's count.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from .bpe import Merges, byte_symbols, library_classes
from .common import id_text, slices, texts

#: Contractions that are words of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Code points in a chunk; columns of the transition table; its cells and the states at which the machine is
#: dropped before the next batch, and those it never exceeds.
CHUNK, COLUMNS, CELLS, STATES, MOST_CELLS, MOST_STATES = 384, 384, 24_000_000, 200_000, 40_000_000, 280_000
#: Symbols beyond Unicode: the end of a text (also padding), and a special token's string.
END, SPECIAL = 0x110000, 0x110001
EMIT = 128
#: Blocks of old scripts, on which Python's Unicode tables and the library's agree (tests try them all).
_OLD = re.compile("[^\x00-\u024f\u0370-\u052f\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3]")
_LOWER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


class Full(Exception):
    """The batch would compile more states than the table may hold."""


START = ("start",)


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        self.merges = Merges(vocab, model["merges"])
        good, end = self.merges.reachable(), self.suffix
        self.inner, self.final, self.begins = {}, {}, {""}
        for token, i in vocab.items():
            if good[i]:
                closed = bool(end) and token.endswith(end)
                body = token.removesuffix(end) if closed else token
                (self.final if closed else self.inner)[body] = i
                self.begins.update(body[:n] for n in range(1, len(body)))
                if not closed:
                    self.begins.add(body)  # a closed token may be longer by nothing but its suffix
        self.symbol = {b: s for s, b in byte_symbols().items()}
        # the library's own character classes, so that both follow one version of Unicode
        ranges = sorted((a, b, k) for k, v in library_classes().items() for a, b in v)
        self.firsts, self.classes = [a for a, _, _ in ranges], ranges
        self.clear()

    # -- the machine, one symbol at a time -------------------------------------------------------

    def clear(self) -> None:
        """Back to a machine with a start state only; bounds what a worker keeps."""
        self.columns: dict[int, int] = {}
        self.lookup = np.full(SPECIAL + 1, 0, np.int32)  # 0: no column of its own
        self.states: list[tuple] = []
        self.names: dict[tuple, int] = {}
        self.width = 64
        self.table = np.full((1024, self.width), -1, np.int32)
        self.rest: dict[tuple[int, int], int] = {}
        self.kinds: dict[int, str] = {}
        self.start = self.state(START)

    def state(self, name: tuple) -> int:
        found = self.names.get(name)
        if found is None:
            if len(self.states) >= MOST_STATES or len(self.states) * self.width >= MOST_CELLS:
                raise Full
            found = self.names[name] = len(self.states)
            self.states.append(name)
            if found >= len(self.table):
                more = max(1024, len(self.table) // 4)
                self.table = np.concatenate([self.table, np.full((more, self.width), -1, np.int32)])
        return found

    def kind(self, cp: int) -> str:
        found = self.kinds.get(cp)
        if found is None:
            if cp >= END:
                found = "end" if cp == END else "special"
            else:
                _, last, name = self.classes[max(bisect_right(self.firsts, cp) - 1, 0)]
                found = name if self.firsts[0] <= cp <= last else "O"
            self.kinds[cp] = found
        return found

    def advance(self, word: tuple, symbol: str) -> tuple[tuple, int]:
        """The word's state after one more byte's symbol, and the tokens emitted.

        A word's state: the longest end of it that begins a token, and for each end that does (by length)
        the last token before it (-1: none) and the count there less the count now.
        """
        ends, at = word
        grown = ends + symbol
        known = dict((n, (t, c)) for n, t, c in at)
        for n in range(len(grown), 0, -1):
            token = self.inner.get(grown[len(grown) - n :])
            if token is not None and n - 1 in known and ((p := known[n - 1][0]) < 0 or self.merges.fits(p, token)):
                break
        else:
            raise ValueError(f"no token for the byte symbol {symbol!r}")
        emitted = known[n - 1][1] + 1
        kept = [(0, token, 0)]
        for n, (t, c) in known.items():
            if grown[len(grown) - n - 1 :] in self.begins:
                kept.append((n + 1, t, c - emitted))
        kept.sort()
        return (grown[len(grown) - kept[-1][0] :] if kept[-1][0] else "", tuple(kept)), emitted

    def close(self, word: tuple, symbol: str) -> int:
        """Tokens emitted if the word ends with this symbol."""
        if not self.suffix:
            return self.advance(word, symbol)[1]
        ends, at = word
        grown = ends + symbol
        for n, t, c in reversed(at):
            token = self.final.get(grown[len(grown) - n - 1 :])
            if token is not None and (t < 0 or self.merges.fits(t, token)):
                return c + 1
        raise ValueError(f"no token for the closing byte symbol {symbol!r}")

    NEW = ("", ((0, -1, 0),))

    def read(self, word: tuple, cp: int) -> tuple[tuple, int, int]:
        """The word's state after a code point, tokens emitted, and those that an end of the word here would add."""
        symbols = [self.symbol[b] for b in chr(cp).encode("utf-8", "replace")]
        total = 0
        for s in symbols[:-1]:
            word, n = self.advance(word, s)
            total += n
        ending = self.close(word, symbols[-1])
        word, n = self.advance(word, symbols[-1])
        return word, total + n, ending - n

    def whole(self, text: str) -> int:
        """Tokens of one whole word."""
        word, total, extra = self.NEW, 0, 0
        for c in text:
            word, n, extra = self.read(word, ord(c))
            total += n
        return total + extra

    def step(self, name: tuple, cp: int) -> tuple[tuple, int]:
        """The state after a code point, and the tokens emitted."""
        mode, kind = name[0], self.kind(cp)
        if mode == "quote":  # an apostrophe at a word's start, and the letters of a contraction after it
            seen = name[1] + (chr(cp) if cp < END else " ")
            if seen in CONTRACTIONS:
                return START, self.whole(seen)
            if any(c.startswith(seen) for c in CONTRACTIONS):
                return ("quote", seen), 0
            if len(name[1]) == 1 and kind == "O":
                word, emitted, extra = self.read(self.NEW, ord("'"))
                word, n, extra = self.read(word, cp)
                return ("O", word, extra), emitted + n
            emitted, inside = self.whole("'"), START
            for c in name[1][1:]:
                inside, n = self.step(inside, ord(c))
                emitted += n
            end, n = self.step(inside, cp)
            return end, emitted + n
        if mode == kind:
            word, emitted, extra = self.read(name[1], cp)
            return (kind, word, extra), emitted
        emitted = name[2] if mode in "LO" else 0
        if kind in ("S", "end"):
            return START, emitted
        if kind == "special":
            return START, emitted + 1
        if kind == "N":
            return START, emitted + self.whole(chr(cp))
        if cp == 0x27 and mode != "O":
            return ("quote", "'"), emitted
        word, n, extra = self.read(self.NEW, cp)
        return (kind, word, extra), emitted + n

    def walk(self, text: str) -> int:
        """Tokens of one text, symbol by symbol, keeping no state: for texts of ever new states."""
        name, total = START, 0
        for cp in [*self.normal(text).tolist(), END]:
            name, n = self.step(name, cp)
            total += n
        return total

    # -- many chunks at once ---------------------------------------------------------------------

    def normal(self, text: str) -> np.ndarray:
        """A text's code points as the file's normaliser leaves them, special strings as one symbol each."""

        def plain(part: str) -> np.ndarray:
            if part.isascii() or not _OLD.search(part):
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            else:
                part = _LOWER.normalize_str(part)
            return np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)

        if self.cut is None or not any(s in text for s in self.special):
            return plain(text)
        parts = [plain(p) for p in self.cut.split(text)]
        mark = np.array([SPECIAL], np.uint32)
        return np.concatenate([x for p in parts for x in (mark, p)][1:])

    def admit(self, points: np.ndarray) -> np.ndarray:
        """Column numbers of code points; beyond COLUMNS they share column 0, which is looked up by hand."""
        column = self.lookup[points]
        if (column == 0).any():
            for cp in np.unique(points[column == 0]).tolist():
                if len(self.columns) < COLUMNS - 1:
                    self.columns[cp] = self.lookup[cp] = len(self.columns) + 1
            if len(self.columns) >= self.width:
                width = len(self.columns) // 64 * 64 + 64
                wide = np.full((len(self.table), width), -1, np.int32)
                wide[:, : self.width] = self.table
                self.table, self.width = wide, width
            column = self.lookup[points]
        return column

    def move(self, state: np.ndarray, column: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Packed results (state << 8 | emitted + EMIT) of one step of many chunks; compiles what is new."""
        got = self.table.ravel()[state * self.width + column]
        for i in np.flatnonzero(got < 0).tolist():
            s, cp, c = int(state[i]), int(point[i]), int(column[i])
            known = int(self.table[s, c]) if c else self.rest.get((s, cp), -1)  # other rows of this step may have compiled it
            if known < 0:
                end, emitted = self.step(self.states[s], cp)
                known = self.state(end) << 8 | emitted + EMIT
                if c:
                    self.table[s, c] = known
                elif len(self.rest) < 1_000_000:
                    self.rest[s, cp] = known
            got[i] = known
        return got

    def run(self, columns: np.ndarray, points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, emitted = start.astype(np.int64), np.zeros(len(start), np.int64)
        for c, p in zip(columns, points, strict=True):
            got = self.move(state, c, p)
            state = (got >> 8).astype(np.int64)
            emitted += (got & 255) - EMIT
        return state, emitted

    def rerun(self, columns: np.ndarray, points: np.ndarray, start: np.ndarray, end0: np.ndarray, n0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As run, knowing the outcome from the start state: rows that fall in step with it are done."""
        end, emitted = end0.copy(), n0.copy()
        rows = np.arange(len(start))
        a, b = np.full(len(start), self.start, np.int64), start.astype(np.int64)
        diff = np.zeros(len(start), np.int64)
        for i in range(len(columns)):
            x, y = self.move(a, columns[i, rows], points[i, rows]), self.move(b, columns[i, rows], points[i, rows])
            a, b = (x >> 8).astype(np.int64), (y >> 8).astype(np.int64)
            diff += (y & 255).astype(np.int64) - (x & 255)
            apart = a != b
            if not apart.all():
                emitted[rows[~apart]] += diff[~apart]
                rows, a, b, diff = rows[apart], a[apart], b[apart], diff[apart]
                if not len(rows):
                    break
        end[rows] = b
        emitted[rows] += diff
        return end, emitted

    def counts(self, batch: list[str], chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each text. A batch that fills the table is halved; a text that does so alone is walked."""
        if len(self.states) > STATES or len(self.states) * self.width > CELLS:
            self.clear()
        try:
            return self.scan(batch, chunk)
        except Full:
            self.clear()
        if len(batch) == 1:
            return np.array([self.walk(batch[0])], np.int64)
        half = len(batch) // 2
        return np.concatenate([self.counts(batch[:half], chunk), self.counts(batch[half:], chunk)])

    def scan(self, batch: list[str], chunk: int) -> np.ndarray:
        """Tokens of each text by chunks, state maps and the prefix scan."""
        arrays = [self.normal(t) for t in batch]
        chunks = np.array([len(a) // chunk + 1 for a in arrays], np.int64)  # one END at least
        first = np.concatenate([[0], np.cumsum(chunks)])
        total = int(first[-1])
        points = np.full(total * chunk, END, np.uint32)
        for a, f in zip(arrays, first[:-1].tolist(), strict=True):
            points[f * chunk : f * chunk + len(a)] = a
        del arrays
        points = np.ascontiguousarray(points.reshape(total, chunk).T)
        columns = self.admit(points)
        heads = np.zeros(total, bool)
        heads[first[:-1]] = True

        # The state maps: slot 0 is the start state, slot 1 what the chunk before ends in from its slot 0, and
        # so on for as long as an end is in no slot of the next chunk.
        begin = [np.full(total, self.start, np.int64)]
        end, emitted = [], []
        e, n = self.run(columns, points, begin[0])
        end.append(e)
        emitted.append(n)
        follow = [np.zeros(total, np.int64)]  # slot of the next chunk that this slot's end is in
        inner = np.flatnonzero(~heads)
        while len(inner):
            slot = len(begin)
            wanted = np.full(total, -1, np.int64)
            open_rows = []
            for k in range(slot):
                rows = inner[(follow[k][inner - 1] < 0) | (slot == 1)] if k == slot - 1 or slot == 1 else inner[:0]
                if len(rows):
                    wanted[rows] = end[k][rows - 1]
                    open_rows.append(rows)
            rows = np.unique(np.concatenate(open_rows)) if open_rows else inner[:0]
            if not len(rows):
                break
            e, n = end[0].copy(), emitted[0].copy()
            e[rows], n[rows] = self.rerun(columns[:, rows], points[:, rows], wanted[rows], end[0][rows], emitted[0][rows])
            begin.append(wanted)
            end.append(e)
            emitted.append(n)
            if slot == 1:
                follow[0][:] = 1
            else:
                follow[slot - 1][rows - 1] = slot
            ahead = np.full(total, -1, np.int64)
            nxt = np.minimum(np.arange(total) + 1, total - 1)
            for k in range(1, len(begin)):
                ahead[(ahead < 0) & (begin[k][nxt] == e)] = k
            ahead[(ahead < 0) & (wanted < 0)] = 0  # no such slot here
            ahead[(ahead < 0) & heads[nxt]] = 0
            ahead[-1] = 0
            follow.append(ahead)
            inner = rows[(rows + 1 < total)] + 1
            inner = inner[~heads[inner]]
            inner = inner[follow[slot][inner - 1] < 0]

        # Prefix scan: jump[k][s] is the slot of chunk k + 1 if slot s is taken 2^r chunks earlier.
        jump = np.stack([np.maximum(f, 0) for f in follow], axis=1)
        real = np.zeros((total, len(begin)), np.int64)  # slot of chunk k, by the slot of an earlier chunk
        real[1:] = jump[:-1]
        real[heads] = 0
        reach = 1
        while reach < total:
            later = real.copy()
            later[reach:] = np.take_along_axis(real[reach:], real[:-reach], axis=1)
            if np.array_equal(later, real):
                break
            real, reach = later, reach * 2
        taken = real[:, 0]
        each = np.stack(emitted, axis=1)[np.arange(total), taken]
        return np.add.reduceat(each, first[:-1]) if len(batch) else np.zeros(0, np.int64)


_LOADED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One machine for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def token_counts(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each text; no shuffle.

    ``tokenizer``: path of a word-level BPE file, readable on every executor. Returns ``doc_id, n_bytes,
    n_tokens, over_limit`` (more than ``limit`` tokens). A null text counts as empty (0 and 0); null ids and
    repeated rows are kept, a row out for each row in; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for part in slices(batches):
            n = machine.counts(texts(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), part.column("n_bytes")], names=["doc_id", "n_tokens", "n_bytes"])

    counted = id_text(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return counted.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_bytes bigint").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
