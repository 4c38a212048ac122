import hashlib
import io
import random
import shutil
import subprocess
import zipfile
import zlib

import duckdb
import numpy as np
import pytest

from keelstone.llm import flac, registry, warc

RNG = random.Random(2)
PAYLOADS = [bytes(64), b"a", b"ab" * 40, bytes(range(256)) * 20, bytes(RNG.randrange(256) for _ in range(9000)), bytes(100) + b"\xff" * 100 + bytes(5000) + b"\xff" * 3000, b"hello world " * 700]
PAYLOADS += [bytes(RNG.choice(b"ab \xff\0") for _ in range(RNG.randrange(1, 300))) for _ in range(200)]
PAYLOADS += [(np.sin(np.arange(10_000) / 40) * 100 + 128).astype(np.uint8).tobytes()]


def test_flac_round_trip():
    media = flac.encode(PAYLOADS)
    assert flac.decode(media) == PAYLOADS
    assert len(media[-1]) < 0.5 * len(PAYLOADS[-1])  # predictors and Rice codes at work
    assert {f[flac.frame_header(f, 0)[2]] >> 1 for m in media for f in flac.split_frames(m)} >= {0, 1, 9, 10}


@pytest.mark.parametrize(("first", "count"), [(0, 10), (4000, 300), (4096, 1), (5000, 10_000), (9999, 0)])
def test_flac_seeks(first, count):
    media = flac.encode(PAYLOADS[3:4])[0]
    assert (flac.read_samples(media, first, count).view(np.uint8) ^ 0x80).tobytes() == PAYLOADS[3][first : first + count]


def test_flac_finds_broken_bits():
    media = flac.encode(PAYLOADS[6:7])[0]
    at = flac.metadata(media)[2]
    for i in (at + 3, at + 20, len(media) - 1):
        bad = bytearray(media)
        bad[i] ^= 1
        with pytest.raises(flac.Corrupt):
            flac.decode([bytes(bad)])


def test_flac_linear_prediction():
    """A frame of a general linear predictor, written here bit by bit."""
    coefficients, shift, order, k = [3, -1], 1, 2, 4
    samples = [5, 9, -7, 30, 2, -100, 17, 60]
    bits = f"{0:01b}{32 + order - 1:06b}0" + "".join(f"{s & 0xFF:08b}" for s in samples[:order]) + f"{3:04b}{shift:05b}" + "".join(f"{c & 0xF:04b}" for c in coefficients) + "00" + "0000" + f"{k:04b}"
    for i in range(order, len(samples)):
        r = samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(coefficients)) >> shift)
        z = (r << 1) ^ (r >> 31)
        bits += "0" * (z >> k) + "1" + f"{z & (1 << k) - 1:0{k}b}"
    bits += "0" * (-len(bits) % 8)
    body = flac.header(0, len(samples)) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame = body + flac.crc16_each([body])[0].to_bytes(2, "big")
    assert flac.decode_frames([frame])[0].tolist() == samples


def test_checksums_equal_plain_division():
    def plain(data, poly, width):
        reg = 0
        for b in data:
            reg ^= b << (width - 8)
            for _ in range(8):
                reg = (reg << 1 ^ poly if reg >> (width - 1) else reg << 1) & (1 << width) - 1
        return reg

    assert flac.crc16_each(PAYLOADS[:40]) == [plain(p, 0x8005, 16) for p in PAYLOADS[:40]]
    assert [flac.crc8(p[:30]) for p in PAYLOADS] == [plain(p[:30], 7, 8) for p in PAYLOADS]
    assert [flac.utf8_number(n).hex() for n in (0, 127, 128, 2047, 2048, 70_000)] == [chr(n).encode().hex() for n in (0, 127, 128, 2047, 2048, 70_000)]


def bare(media):
    """A stream without its seek table, the length and MD5 in STREAMINFO unstated."""
    info, _, at = flac.metadata(media)
    return b"fLaC\x80" + (34).to_bytes(3, "big") + media[8:18] + (media[18:26][:-5] + bytes([media[21] & 0xF0]) + bytes(4)) + bytes(16) + media[at:]


def test_flac_without_a_seek_table():
    for p in PAYLOADS:
        media = flac.encode([p], 512)[0]
        plain = bare(media)
        assert flac.metadata(plain)[1] == [] and flac.decode([plain]) == [p]
        assert flac.split_frames(plain) == flac.split_frames(media)
        assert flac.read_samples(plain, 3, 9).tolist() == flac.read_samples(media, 3, 9).tolist()
    info, seek, at = flac.metadata(media)
    hole = b"\xff" * 8 + bytes(10)
    some = media[:4] + b"\x00" + media[5:42] + b"\x83" + (36).to_bytes(3, "big") + media[46:64] + hole + media[at:]
    assert len(flac.metadata(some)[1]) == 1 and flac.decode([some]) == [p]


def test_lock_step_equals_bit_by_bit():
    """Two decoders written apart agree on every frame."""
    for block in (16, 192, 4096):
        frames = [f for m in flac.encode(PAYLOADS, block) for f in flac.split_frames(m)]
        for a, b in zip(flac.decode_frames(frames), map(flac.plain_frame, frames), strict=True):
            assert np.array_equal(a, b)


def framed(head, bits):
    body = head + bytes([flac.crc8(head)]) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    return body + flac.crc16_each([body])[0].to_bytes(2, "big")


def test_flac_headers_and_odd_subframes():
    # block sizes and rates in their other codings: 192 samples, 8 bits, 256 << 0, and a rate spelt out
    for head, n in ((b"\xff\xf8\x14\x02\x00", 192), (b"\xff\xf8\x64\x00\x00\x13", 20), (b"\xff\xf9\x8c\x02\x05\x08", 256)):
        assert flac.decode_frames([framed(head, "00000000" + "00000101")])[0].tolist() == [5] * n
    head = b"\xff\xf8\x64\x02\x00\x03"  # four samples
    wasted = "0" + "000001" + "1" + "01" + "000011" * 2 + "111111" * 2  # verbatim, two wasted bits
    assert flac.decode_frames([framed(head, wasted)])[0].tolist() == [12, 12, -4, -4]
    wide = "0" + "001000" + "0" + "01" + "0000" + "00001" + "".join("1" + f"{b}" for b in (0, 1, 0, 1))  # order 0, 5-bit parameter 1
    assert flac.decode_frames([framed(head, wide)])[0].tolist() == [0, -1, 0, -1]


def test_flac_calls_broken_streams_corrupt():
    rng = random.Random(6)
    for p in PAYLOADS[:12]:
        for media in (flac.encode([p], 64)[0], bare(flac.encode([p], 64)[0])):
            for _ in range(12):
                cut = media[: rng.randrange(len(media))]
                try:
                    assert p.startswith(flac.decode([cut])[0])  # whole frames, where no length is stated
                except flac.Corrupt:
                    pass
                bad = bytearray(media)
                bad[rng.randrange(42, len(bad))] ^= 1 << rng.randrange(8)
                try:
                    assert flac.decode([bytes(bad)])[0] == p  # a bit of the seek table's padding or the like
                except flac.Corrupt:
                    pass


def test_pcm_blocks(odd, none):
    made = flac.flac_columns(odd).cache()
    want = sorted((r["doc_id"] or 0, bytes(r["payload"])) for r in made.collect())
    rows = flac.pcm_blocks(made).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["first_sample"]):
        assert r["n_samples"] == len(r["pcm"])
        if r["doc_id"] in (1, 2, 3, 4, 5, 6, 8):
            have = got.setdefault(r["doc_id"], bytearray())
            assert r["first_sample"] == len(have)
            have += (np.frombuffer(r["pcm"], np.uint8) ^ 0x80).tobytes()
    assert all(dict(want)[i] == bytes(x) for i, x in got.items()) and len(got) == 7
    assert sum(r["doc_id"] is None for r in rows) == 2 and flac.pcm_blocks(flac.flac_columns(none)).count() == 0


@pytest.mark.skipif(not shutil.which("flac"), reason="no other decoder here")
def test_flac_with_another_decoder(tmp_path):
    (tmp_path / "x.flac").write_bytes(flac.encode(PAYLOADS[6:7])[0])
    assert subprocess.run(["flac", "-t", tmp_path / "x.flac"]).returncode == 0


def test_flac_on_odd_rows(odd, none):
    rows = flac.flac_columns(odd, digests=True).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    for r in odd.filter("doc_id IS NOT NULL").collect():
        p, got = flac.padded(r["text"] or ""), by[r["doc_id"]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert by[2]["media_sha256"] == by[3]["media_sha256"] and by[2]["payload_bytes"] == 64
    full = flac.flac_columns(odd.filter("doc_id = 1")).first()
    assert bytes(full["payload"]) == flac.decode([bytes(full["media"])])[0] and flac.flac_columns(none).count() == 0


@pytest.mark.parametrize("zip64", [None, True])
def test_packages(zip64):
    packer = warc.Packer()
    for i, b in enumerate(PAYLOADS[:6]):
        packer.add(i, f"http://example.com/{i}\nX: y", b, hashlib.sha256(b).hexdigest(), None, False)
    packer.add(None, "", PAYLOADS[3], hashlib.sha256(PAYLOADS[3]).hexdigest(), 3, True)
    data, reads = packer.finish(zip64), []

    def read_at(at, n):
        reads.append(n)
        return data[at : at + n]

    with zipfile.ZipFile(io.BytesIO(data)) as z:  # another reader agrees
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    rows = list(warc.records(read_at, len(data)))
    assert [r["payload"] for r in rows] == [*PAYLOADS[:6], None] and rows[-1]["refers_to"] == 3 and rows[-1]["payload_bytes"] == len(PAYLOADS[3]) and rows[-1]["page_id"] is None
    package = warc.ZipReader(lambda at, n: data[at : at + n], len(data))
    assert zlib.decompress(package.read(warc.DATA, 0, len(packer.parts[0])), 31).startswith(b"WARC/1.1")
    with pytest.raises(warc.Corrupt):
        package.read(warc.DATA, 0, 1 << 40)
    with pytest.raises(warc.Corrupt):
        list(warc.records(lambda at, n: data[at : at + n], len(data) - 30))
    with pytest.raises(warc.Corrupt):
        package.read("no such member")


def test_packages_of_another_writer():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a/é.txt", b"stored bytes")
        z.writestr("b", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    package = warc.ZipReader(lambda at, n: data[at : at + n], len(data))
    assert package.read("a/é.txt") == b"stored bytes" and package.read("a/é.txt", 7, 5) == b"bytes"
    with pytest.raises(warc.Corrupt):
        package.read("b")


def test_warc_rows(spark):
    big = "page " * 50
    rows = [(5, "u5", big, 1), (3, "u3", big, 2), (9, None, big, 3), (None, "n", big, 4), (4, "u4", "short", 5), (6, "u6", "short", 6), (7, "u7", None, 7), (8, "u8", "", 8), (3, "again", big, 9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int").repartition(3)
    got = warc.read_packages(warc.write_packages(df)).collect()
    kinds = sorted((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in got)
    assert kinds == [(False, 3, "response", None, big), (False, 3, "response", None, big), (False, 4, "response", None, "short"), (False, 5, "revisit", 3, None), (False, 6, "response", None, "short"), (False, 7, "response", None, ""), (False, 8, "response", None, ""), (False, 9, "revisit", 3, None), (True, 0, "revisit", 3, None)]
    assert warc.read_packages(warc.write_packages(df.limit(0))).count() == 0


def test_warc_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    cur = c.execute(registry.ORACLE_SQL["op7_warc"])
    names = [d[0] for d in cur.description]
    got = registry.QUERIES["op7_warc"](spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_warc_join_without_a_broadcast(spark):
    """Salted digests and short payloads meet as the broadcast join has them meet; a long page is packed whole."""
    big, long = "page " * 50, "<p>long</p>" * 200_000
    rows = [(i, f"u{i}", [big, "short", None, f"other {i} " * 20, long][i % 5]) for i in range(60)] + [(None, None, big), (None, None, big), (3, "u3", "short")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    kinds = lambda: sorted(repr(tuple(r)) for r in warc.read_packages(warc.write_packages(df), with_payload=False).select("page_id", "record_type", "refers_to", "payload_bytes").collect())
    want = kinds()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert kinds() == want and len(want) == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
