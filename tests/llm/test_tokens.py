import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from keelstone.llm import counts, packing
from keelstone.llm.bpe import TrieEncoder, bpe_encode
from keelstone.llm.counts import Transducer, token_counts

POOLS = ["abc's treth'll've", "ÉéΣß \t\n\r\x1c\x85\xa0 　​﻿᠎İ", "0123٠²Ⅷ", "!?.,'\"-_=<|>", "\U0001f600中文אकिก"]
FIXED = ["a" * 3000, "=" * 5000, " " * 1000, "x<|endoftext|>y <|endoftext|><|startoftext|> it's'll 're", "'''s 's", "hello world" * 300, "!" * 777 + "s'" * 400, ""]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    any_char = lambda: chr(rng.choice([rng.randrange(0, 0xD800), rng.randrange(0xE000, 0x110000)]))
    return ["".join(rng.choice(rng.choice(POOLS)) if rng.random() < 0.9 else any_char() for _ in range(rng.randrange(50))) for _ in range(n)] + FIXED


#: All code points; of the planes that no character has been given to, and of private ones, every 16th.
EVERY = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0x40000, 0x110000, 16))]


def sweeps(step):
    """Every code point in four contexts, ``step`` of them in a text."""
    for at in range(0, len(EVERY), step):
        some = EVERY[at : at + step]
        yield from ("\n".join(a + c + b for c in some) for a, b in (("", "'s"), (" ", ""), ("!", ""), ("", "1")))


def test_every_code_point_in_four_contexts(byte_json, word_json, ranks):
    theirs, words = Tokenizer.from_file(byte_json), Tokenizer.from_file(word_json)
    ours, machine = TrieEncoder(byte_json), Transducer(word_json)
    wrong = []
    for text in sweeps(4096):
        want = theirs.encode(text, add_special_tokens=False).ids
        if ours.encode([text])[0] != want or packing.token_ids(text, byte_json, ranks) != want:
            wrong.append(text)
        ours.cache.clear()
    assert not wrong
    for text in sweeps(16384):
        if machine.walk(text) != len(words.encode(text, add_special_tokens=False).ids):
            wrong.append(text)
    assert not wrong


def test_lower_case_of_every_code_point(word_json):
    """The transducer's quick way to lower case is taken only where it equals the library's."""
    machine = Transducer(word_json)
    theirs = Tokenizer.from_file(word_json).normalizer
    for c in EVERY:
        if not c.isspace():
            text = f"a{c}b"
            assert "".join(map(chr, machine.normal(text).tolist())) == theirs.normalize_str(text), hex(ord(c))


def test_trie_equals_the_library(byte_json):
    ours, theirs = TrieEncoder(byte_json), Tokenizer.from_file(byte_json)
    batch = random_texts(4000)
    want = [e.ids for e in theirs.encode_batch(batch, add_special_tokens=False)]
    assert ours.encode(batch) == want
    assert [ours.decode(i) for i in want] == [theirs.decode(i, skip_special_tokens=False) for i in want]


@pytest.mark.parametrize("chunk", [384, 5])
def test_transducer_equals_the_library(word_json, chunk):
    ours, theirs = Transducer(word_json), Tokenizer.from_file(word_json)
    batch = random_texts(2500, 2)
    want = np.array([len(e.ids) for e in theirs.encode_batch(batch, add_special_tokens=False)])
    got = np.concatenate([ours.counts(batch[i : i + 700], chunk) for i in range(0, len(batch), 700)])
    assert np.array_equal(got, want)


def test_transducer_with_a_full_table(word_json, monkeypatch):
    monkeypatch.setattr(counts, "MOST_CELLS", 60_000)
    ours, theirs = Transducer(word_json), Tokenizer.from_file(word_json)
    rng = random.Random(8)
    batch = [*random_texts(150, 5), "".join(rng.choice("abcdefghij'") for _ in range(6000)), "'ve'r'v 'll'"]
    assert ours.counts(batch).tolist() == [len(e.ids) for e in theirs.encode_batch(batch, add_special_tokens=False)]
    assert len(ours.states) * ours.width <= 60_000 + ours.width


def test_ranks_equal_the_library(byte_json, ranks):
    theirs = Tokenizer.from_file(byte_json)
    batch = [*random_texts(3000, 3), "x" + " " * 1_000_000 + "y"]
    assert [packing.token_ids(t, byte_json, ranks) for t in batch] == [e.ids for e in theirs.encode_batch(batch, add_special_tokens=False)]


def test_encode_on_odd_rows(odd, none, byte_json):
    theirs = Tokenizer.from_file(byte_json)
    got = bpe_encode(odd, byte_json, digests=True).collect()
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, hashlib.sha256(",".join(map(str, theirs.encode(r["text"] or "", add_special_tokens=False).ids)).encode()).hexdigest()) for r in odd.collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_sha256"]) for r in got) == want
    assert {r["doc_id"]: r["decoded"] for r in bpe_encode(odd, byte_json).collect()}[1] == "hello world, it's a <|endoftext|> test"
    assert bpe_encode(none, byte_json).count() == 0


def test_counts_on_odd_rows(odd, none, word_json):
    theirs = Tokenizer.from_file(word_json)
    key = lambda i, a, b, c: (i is not None, i or 0, a, b, c)
    got = sorted(key(*r) for r in token_counts(odd, word_json).collect())
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert got == sorted(key(i, len(t.encode()), n := len(theirs.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in rows)
    assert token_counts(none, word_json).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, ranks, byte_json):
    theirs = Tokenizer.from_file(byte_json)
    rows = packing.pack_documents(docs, byte_json, ranks).collect()
    used = check_packing(rows, 1024)
    want, total, ids = {}, 0, {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc, text in ids.items():
        x = np.array([*theirs.encode(text, add_special_tokens=False).ids, 2], "<u4")
        total += len(x)
        head = len(x) % 1024 or 1024
        cuts = [0, *range(head, len(x) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, k] = (a, b - a, zlib.crc32(x[a:b].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert used <= 1.02 * -(-total // 1024)


def test_packing_on_odd_rows(spark, odd, none, byte_json, ranks):
    rows = packing.pack_documents(odd, byte_json, ranks, capacity=64).collect()
    check_packing(rows, 64)
    assert sum(r["piece"] == 0 for r in rows) == odd.count() and sum(r["doc_id"] is None for r in rows) >= 2
    assert packing.pack_documents(none, byte_json, ranks).count() == 0


def test_sum_of_squares_choice():
    # open gaps after 6, 6, 4: 4, 4, 6 of 10; a piece of 4 fits gap 4 exactly, which lowers the sum most
    sequence, offset = packing.place(np.array([6, 6, 4, 4]), 10)
    assert sequence.tolist()[:2] == [0, 1] and sequence[2] in (0, 1) and offset[2] == 6 and sequence[3] in (0, 1) and sequence[2] != sequence[3]
    sequence, _ = packing.place(np.array([8, 5, 1]), 10)  # gaps 2 and 5, one each: both choices cost the same, the tighter wins
    assert sequence.tolist() == [0, 1, 0]


def test_sum_of_squares_against_every_choice():
    """place() against trying every open sequence for each piece and counting squares anew."""
    rng = random.Random(12)
    for _ in range(60):
        capacity = rng.randint(4, 30)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 60))), reverse=True)
        sequence, offset = packing.place(np.array(sizes), capacity)
        gaps = {}
        for size, number, at in zip(sizes, sequence.tolist(), offset.tolist(), strict=True):

            def squares(open_gaps):
                count = [0] * (capacity + 1)
                for g in open_gaps.values():
                    count[g] += 1
                return sum(c * c for c in count[1:])

            fits = {n: g for n, g in gaps.items() if g >= size}
            after = {n: squares({**gaps, n: g - size}) for n, g in fits.items()}
            if not fits:
                assert number not in gaps and at == 0
                gaps[number] = capacity - size
            else:
                assert gaps[number] >= size and at == capacity - gaps[number]
                assert after[number] == min(after.values())
                gaps[number] -= size
