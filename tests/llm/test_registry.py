"""Every registered query of the subpackage runs with its own parameters and returns the contract's columns."""

import hashlib
import zlib

import pytest
from tokenizers import Tokenizer

from keelstone.llm import simhash
from keelstone.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_bpe_encode": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_katz": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5_pack": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_cws": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_quality": "doc_id held_out score predicted",
    "op10_flac": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, docs, byte_json, word_json, name):
    rows = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(rows[0]) >= set(COLUMNS[name].split()) and {r["doc_id"] for r in rows} == set(text)
    if name != "op5_pack":
        assert len(rows) == len(text)
    crc = lambda i, m: zlib.crc32(str(i).encode()) % m
    ids = Tokenizer.from_file(byte_json)
    words = Tokenizer.from_file(word_json)
    for r in rows:
        i, t = r["doc_id"], text[r["doc_id"]]
        if name == "op1_bpe_encode":
            want = ids.encode(t, add_special_tokens=False).ids
            assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(ids.decode(want, skip_special_tokens=False).encode()).hexdigest()
        elif name == "op3_token_counts":
            n = len(words.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)
        elif name == "op4_katz":
            assert r["held_out"] == (crc(i, 5) == 1) and r["n_tokens"] == len(t.encode().lower().split()) + 1 and r["score"] < 0
        elif name == "op6_cws":
            assert r["n_chars"] == len(t) and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 256
        elif name == "op8_simhash":
            assert r["fingerprint"] == f"{simhash.fingerprint(t):016x}" and r["component_id"] <= i
        elif name == "op9_quality":
            assert r["held_out"] == (crc(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        elif name == "op10_flac":
            raw = t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64))
            assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(t.encode()), len(raw), zlib.crc32(raw[-64:])) and r["payload_sha256"] == hashlib.sha256(raw).hexdigest()
