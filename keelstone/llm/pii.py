"""Personal data in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The field labels the words of each line from their shapes and their neighbours' shapes; it is trained from a
small labelled table that :func:`labelled_lines` makes, and decoded by Viterbi over many lines at once.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, place_of, quoted, slices, texts, with_text

#: Kinds in the order of output; the patterns' parts.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email", "card", "phone", "id", "name")
KINDS = (*BASE, "id", "name")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a match of four numbers starts where a run of digits starts, as it would also match from there
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    if text.find(".") >= 0:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = "".join(_DIGITS.findall(m.group()))
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if text.find("+") >= 0:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    out.sort()
    return out


# -- the conditional random field ------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))
#: Words that announce what follows.
CUES = {
    "mr.": "title", "mrs.": "title", "ms.": "title", "dr.": "title", "prof.": "title", "mr": "title", "mrs": "title", "dr": "title",
    "phone": "call", "phone:": "call", "tel": "call", "tel.": "call", "tel:": "call", "call": "call", "mobile": "call", "mobile:": "call", "fax": "call", "fax:": "call",
    "ssn": "ident", "ssn:": "ident", "passport": "ident", "[at]": "at", "(at)": "at", "{at}": "at", "[dot]": "dot", "(dot)": "dot", "{dot}": "dot",
}
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters as X or x in runs cut to one, digits counted up to six, the rest as it is; a hash of what is longer than 40."""
    out = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in word)
    out = re.sub(r"d+", lambda m: f"d{min(len(m.group()), 6)}", _RUNS.sub(lambda m: m.group() if m.group(1) == "d" else m.group(1), out))
    return out if len(out) <= 40 else "#" + hashlib.sha256(out.encode("utf-8", "replace")).hexdigest()[:16]


def observe(word: str) -> tuple[str, ...]:
    """The features of one word; counts of digits from 20 up are one feature."""
    bare = word.strip(".,;:!?\"'")
    found = ["shape=" + shape(bare), f"digits={min(sum(c.isdigit() for c in word), 20)}"]
    if cue := CUES.get(word.lower().rstrip(",;")):
        found.append("cue=" + cue)
    if "@" in bare[1:-1]:
        found.append("has@")
    if bare.istitle() and bare.isalpha():
        found.append("title")
    return tuple(found)


def labelled_lines(lines: int = 420, seed: int = 5) -> list[list[tuple[str, str]]]:
    """The labelled table: lines of (word, label) with and without personal data, made from a seed."""
    rng = random.Random(seed)
    syllables = ["er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "que", "ion", "mento", "sch", "ung", "keit", "los", "ado", "eau", "tre"]
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        w = rng.choice([w] * 7 + [w.capitalize()] * 3 + [w.upper()])
        return w + rng.choice([""] * 8 + [",", ".", "!!", "***", ";", ":"])

    def plain() -> str:
        other = [d(rng.randint(1, 6)), d(1) + "." + d(1), f"{d(2)}:{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(4)}-{d(4)}", f"{d(2)}/{d(2)}/{d(4)}", f"${d(3)}.{d(2)}", f"#{d(5)}", "|", "=", d(9), d(12), d(20), f"{d(3)}.{d(2)}.{d(3)}.{d(2)}", f"{d(1)}.{d(2)}.{d(3)}.{d(3)}", f"v{d(1)}.{d(2)}", '"' + d(3) + "ab" + d(2) + '"', "a@b", f"{d(3)}-{d(3)}", f"({d(2)})", f"{d(3)}-{d(2)}", f"{d(1)}-{d(3)}-{d(5)}"]
        return rng.choice([word()] * 8 + [rng.choice(other)])

    def name() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))).capitalize()

    def entity(kind: str) -> list[str]:
        if kind == "phone":
            return rng.choice([[f"{d(3)}-{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}.{d(3)}.{d(4)}"]])
        if kind == "card":
            body = rng.choice("3456") + d(14)
            body += str(next(c for c in range(10) if luhn(body + str(c))))
            groups = [body[i : i + 4] for i in range(0, 16, 4)]
            return rng.choice([[body], [body], groups, ["-".join(groups)]])
        if kind == "id":
            return [f"{d(3)}-{d(2)}-{d(4)}"]
        if kind == "name":
            return [name() for _ in range(rng.randint(1, 2))]
        user, host = name().lower() + rng.choice(["", d(2), "." + name().lower()]), name().lower()
        box = rng.choice(["[]", "()", "{}"])
        return rng.choice([[f"{user}@{host}.com"], [user, f"{box[0]}at{box[1]}", f"{host}.org"], [user, f"{box[0]}at{box[1]}", host, f"{box[0]}dot{box[1]}", "com"]])

    out = []
    for _ in range(lines):
        line = [(plain(), "O") for _ in range(rng.randint(2, 7))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            kind = rng.choice(ADDED)
            cue = {"name": ["Mr.", "Mrs.", "Dr.", "Ms.", "Prof."], "phone": ["call", "phone:", "tel", "Tel.", "mobile"], "id": ["SSN", "ssn:", "passport"], "email": ["mail"], "card": ["card", "visa"]}[kind]
            if kind == "name" or rng.random() < 0.6:
                line.append((rng.choice(cue), "O"))
            words = entity(kind)
            words[-1] += rng.choice(["", "", ",", "."])
            line += [(w, ("B-" if i == 0 else "I-") + kind) for i, w in enumerate(words)]
            if rng.random() < 0.2:  # two kinds side by side: the patterns run them together
                beside = rng.choice(["phone", "card", "phone", "id"])
                more = entity(beside)
                line += [(w, ("B-" if i == 0 else "I-") + beside) for i, w in enumerate(more)]
            # what follows a name in lower case ends it; capitals after a stop do too
            line += [(word().lower(), "O")] + [(plain(), "O") for _ in range(rng.randint(0, 4))]
        out.append(line)
    return out


class Field:
    """Weights of features (of a word, the word before and the word after) and of label pairs."""

    def __init__(self, names: list[str], weight: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.index = {n: i for i, n in enumerate(names)}
        self.weight, self.moves, self.start = weight, moves, start  # weight: 3 x features x labels

    def rows(self, word: str) -> tuple[int, ...]:
        """The features of a word that training has met: all that tells words apart, so classes of words are few."""
        return tuple(self.index[f] for f in observe(word) if f in self.index)

    def emissions(self, rows: tuple[int, ...]) -> np.ndarray:
        """3 x labels: what a word adds to the scores of the next word, of itself and of the word before."""
        return self.weight[:, list(rows)].sum(axis=1)


def train(table: list[list[tuple[str, str]]], rounds: int = 140, rate: float = 0.12, ridge: float = 0.01) -> Field:
    """Maximise the conditional likelihood with forward-backward gradients and Adam; the same table gives the same field."""
    names = sorted({f for line in table for w, _ in line for f in observe(w)})
    index = {n: i for i, n in enumerate(names)}
    n, longest, k = len(table), max(map(len, table)), len(LABELS)
    live = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), np.int64)
    hot = np.zeros((3, n, longest, len(names)), np.float32)
    for i, line in enumerate(table):
        for t, (w, label) in enumerate(line):
            live[i, t], gold[i, t] = True, LABELS.index(label)
            for f in observe(w):
                hot[1, i, t, index[f]] = 1
                if t + 1 < len(line):
                    hot[0, i, t + 1, index[f]] = 1
                if t:
                    hot[2, i, t - 1, index[f]] = 1
    flat = hot.transpose(1, 2, 0, 3).reshape(n * longest, -1)[live.ravel()].astype(np.float64)
    weight, moves, start = np.zeros((flat.shape[1], k)), np.zeros((k, k)), np.zeros(k)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weight, moves, start)]
    target = np.zeros((n, longest, k))
    target[live] = np.eye(k)[gold[live]]
    pairs = np.einsum("nti,ntj->ij", target[:, :-1], target[:, 1:])

    def soft(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, rounds + 1):
        score = np.zeros((n, longest, k))
        score[live] = flat @ weight
        fore, back = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fore[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            fore[:, t] = np.where(live[:, t, None], soft(fore[:, t - 1, :, None] + moves, 1) + score[:, t], fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back[:, t] = np.where(live[:, t + 1, None], soft(moves + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2), back[:, t + 1])
        whole = soft(fore[:, -1], 1)[:, None, None]
        mean = np.exp(fore + back - whole) * live[:, :, None]
        both = np.zeros((k, k))
        for t in range(1, longest):
            p = np.exp(fore[:, t - 1, :, None] + moves + (score[:, t] + back[:, t])[:, None, :] - whole)
            both += p[live[:, t]].sum(axis=0)
        grads = (flat.T @ (mean - target)[live] / n, (both - pairs) / n, (mean[:, 0] - target[:, 0]).sum(axis=0) / n)
        for p, g, s in zip((weight, moves, start), grads, state, strict=True):
            g = g + ridge * p / len(table) ** 0.5
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    for i, a in enumerate(LABELS):  # an inside label follows its own kind only
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[1:] != b[1:]:
                moves[i, j] = -1e4
    start[[j for j, b in enumerate(LABELS) if b[0] == "I"]] = -1e4
    return Field(names, weight.reshape(3, len(names), k), moves, start)


def viterbi(field: Field, score: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best labels of lines (lines x words x labels, lines by falling ``size``); 0 beyond a line's end."""
    n, longest, _ = score.shape
    more = np.searchsorted(-size, -np.arange(longest), side="left")
    best = field.start + score[:, 0]
    came = np.zeros(score.shape, np.int8)
    for t in range(1, longest):
        m = int(more[t])
        step = best[:m, :, None] + field.moves
        came[:m, t] = step.argmax(axis=1)
        best[:m] = step.max(axis=1) + score[:m, t]
    out = np.zeros((n, longest), np.int64)
    at = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = int(more[t])
        out[:m, t] = at[:m]
        if t:
            at[:m] = came[np.arange(m), t, at[:m]]
    return out


class Tagger:
    """Decodes lines with a field; remembers the classes of words, up to a bound.

    A class is a set of features that training has met: a shape or none, a count of digits, a cue or none and two
    marks, so there are at most some thousands, whatever the texts.
    """

    KEPT = 200_000

    def __init__(self, field: Field):
        self.field = field
        self.vectors = np.zeros((64, 3, len(LABELS)))  # by class; 0: beyond a line's ends
        self.classes: dict[tuple[int, ...], int] = {}
        self.words: dict[str, int] = {}
        self.calm: list[bool] = [True]
        self.lead = np.full((3, len(LABELS)), -1e9)

    def joins_calm(self, v: np.ndarray) -> bool:
        """Whether a line of calm words and words with these emissions is sure to be all O; if so they are calm too.

        Calm words are described by the largest lead over O that any of them gives a label, on itself and
        on its neighbours. If with those leads no path through other labels gains on the path of O alone,
        however long (no cycle gains, no simple path does), then lines of calm words need no decoding.
        """
        lead = np.maximum(self.lead, v - v[:, :1])
        gain = self.field.moves - self.field.moves[0, 0] + (lead[1] + np.maximum(lead[0], 0) + np.maximum(lead[2], 0))[None, :]
        gain[:, 0] = self.field.moves[:, 0] - self.field.moves[0, 0]
        inner = gain[1:, 1:]
        path = np.maximum(gain[0, 1:], (self.field.start - self.field.start[0] + gain[0] - self.field.moves[0] + self.field.moves[0, 0])[1:])
        loop, worst = inner.copy(), max(float(path.max()), float((path + gain[1:, 0]).max()))
        for _ in range(len(inner)):
            path = (path[:, None] + inner).max(axis=0)
            worst = max(worst, float(path.max()), float((path + gain[1:, 0]).max()), float(np.diag(loop).max()))
            loop = (loop[:, :, None] + inner[None]).max(axis=1)
        if worst < -1e-6:
            self.lead = lead
            return True
        return False

    def admit(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.KEPT:
                self.words.clear()
            features = self.field.rows(word)
            found = self.classes.get(features)
            if found is None:
                found = self.classes[features] = len(self.calm)
                if found == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[found] = self.field.emissions(features)
                self.calm.append(self.joins_calm(self.vectors[found]))
            self.words[word] = found
        return found

    def spans(self, batch: list[str]) -> list[list[tuple[int, int, int]]]:
        """``(start, kind number, end)`` that the field finds in each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
        lines: list[tuple[int, int, str, list[int]]] = []
        for i, text in enumerate(batch):
            words = text.split()
            get = self.words.get
            if all(self.calm[c] for c in {get(w, -1) for w in words} if c >= 0) and all(self.calm[self.admit(w)] for w in set(words) if w not in self.words):
                continue
            at = 0
            for line in text.split("\n"):
                ids = [self.admit(w) for w in line.split()]
                if not all(map(self.calm.__getitem__, ids)):
                    lines.append((i, at, line, ids))
                at += len(line) + 1
        lines.sort(key=lambda x: -len(x[3]))
        vectors = self.vectors
        k = 0
        while k < len(lines):
            width = len(lines[k][3])
            some = lines[k : k + max(1, 200_000 // width)]
            k += len(some)
            size = np.array([len(x[3]) for x in some])
            ids = np.zeros((len(some), width + 2), np.int64)
            for r, x in enumerate(some):
                ids[r, 1 : len(x[3]) + 1] = x[3]
            score = vectors[ids[:, 1:-1], 1] + vectors[ids[:, :-2], 0] + vectors[ids[:, 2:], 2]
            labels = viterbi(self.field, score, size)
            for r in np.flatnonzero(labels.any(axis=1)).tolist():
                i, at, line, _ = some[r]
                out[i] += [(at + a, kind, at + b) for a, kind, b in self.cut(line, labels[r])]
        return out

    @staticmethod
    def cut(line: str, labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Character spans of labelled words, without punctuation at either end."""
        places = [(m.start(), m.end()) for m in re.finditer(r"\S+", line)]
        t = 0
        while t < len(places):
            name = LABELS[labels[t]]
            u = t + 1
            if name[0] == "B":
                while u < len(places) and LABELS[labels[u]] == "I-" + name[2:]:
                    u += 1
                a, b = places[t][0], places[u - 1][1]
                while a < b and line[a] in ".,;:!?\"'":
                    a += 1
                while b > a and line[b - 1] in ".,;:!?\"'":
                    b -= 1
                if a < b:
                    yield a, KINDS.index(name[2:]), b
            t = u


_TRAINED: list[Field] = []


def trained() -> Field:
    """The field of the labelled table; trained once in a process, in about two seconds."""
    if not _TRAINED:
        _TRAINED.append(train(labelled_lines()))
    return _TRAINED[0]


_TAGGERS: dict[str, Tagger] = {}


def tagger(field: Field) -> Tagger:
    """One tagger for each field and worker process."""
    key = hashlib.sha1(field.weight.tobytes()).hexdigest()
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(field)
    return _TAGGERS[key]


def sound(kind: int, found: str) -> bool:
    """The exact check after the field: digits of a card (with its check digit) and of a phone number."""
    digits = "".join(_DIGITS.findall(found))
    if KINDS[kind] == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return KINDS[kind] != "phone" or 7 <= len(digits) <= 15


def all_spans(batch: list[str], tag: Tagger) -> list[tuple[list, list]]:
    """Base spans and all spans of each text; what the field adds never overlaps a base span or another added one."""
    out = []
    for text, extra in zip(batch, tag.spans(batch), strict=True):
        base = base_spans(text)
        kept, free = list(base), 0
        starts = [x for x, _, _ in base]
        reach = list(accumulate((y for _, _, y in base), max))  # the furthest end of the spans up to each
        for a, kind, b in sorted(extra):
            before = bisect_left(starts, b)  # base spans that start before b
            if a >= free and (not before or reach[before - 1] <= a) and sound(kind, text[a:b]):
                kept.append((a, kind, b))
                free = b
        out.append((base, sorted(kept)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = False) -> DataFrame:
    """Personal data of every row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` (and ``redacted``); no shuffle.

    The counts and ``base_sha256`` are of the fixed patterns, ``spans`` has the field's as well. A null text counts
    as empty (no spans); null ids and repeated rows are kept; other columns are ignored.
    """
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = tagger(field)
        for part in slices(batches):
            rows = texts(part)
            found = all_spans(rows, tag)
            counts = [pa.array([sum(k == j for _, k, _ in base) for base, _ in found], pa.int64()) for j in range(len(BASE))]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
            arrays = [part.column("doc_id"), *counts, digest, pa.array([joined(every) for _, every in found])]
            names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            if with_redacted:
                arrays.append(pa.array([redacted(t, every) for t, (_, every) in zip(rows, found, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return id_text(df, id_col, text_col).mapInArrow(run, f"doc_id bigint, {counts}, base_sha256 string, spans string" + (", redacted string" if with_redacted else ""))



def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, with personal data in the text replaced by its kind in brackets.

    ``length_col``, where ``docs`` has it, becomes the new text's length in code points. A null text stays null,
    repeated rows are each redacted alike, null ids matter not.
    """
    field = field or trained()

    at = place_of(docs, text_col)

    def clean(part: pa.RecordBatch, rows: list[str | None]) -> pa.RecordBatch:
        found = all_spans([t or "" for t in rows], tagger(field))
        new = [None if t is None else redacted(t, every) for t, (_, every) in zip(rows, found, strict=True)]
        return part.set_column(at, str(at), pa.array(new, part.schema.field(at).type))

    out = with_text(docs, text_col, clean)
    if length_col in docs.columns:
        length = F.length(F.col(quoted(text_col))).cast(docs.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col(quoted(text_col)).isNull(), F.col(quoted(length_col))).otherwise(length))
    return out
