import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from keelstone.llm import graph, katz, pii, quality, sampling, simhash


# -- personal data ---------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_patterns(docs):
    rng = random.Random(3)
    cases = ["".join(rng.choice("a@.b-+1234 (5)6789_%é\n") for _ in range(rng.randrange(45))) for _ in range(20_000)]
    cases += ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "a@b.c@d.e", "+1 (706) 555-3138", "1" * 30, "256.1.1.1", "001.02.3.255"] + [r["text"] for r in docs.collect()]
    for t in cases:
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_digit_runs_stay_linear():
    assert pii.base_spans("1" * 200_000 + " " + "a" * 200_000 + "@" + "+" * 50_000) == []


def test_field_on_held_out_lines():
    field = pii.trained()
    right = total = 0
    for line in pii.labelled_lines(150, seed=77):
        text = " ".join(w for w, _ in line)
        tag = pii.Tagger(field)
        want, at = set(), 0
        for w, label in line:
            if label[0] == "B":
                want.add(at + len(w) - len(w.lstrip(".,;:!?\"'")))
            at += len(w) + 1
        got = {a for a, _, _ in tag.spans([text])[0]}
        right += len(want & got)
        total += len(want | got)
    assert right / total > 0.97


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    field = pii.Field([], np.zeros((3, 0, 9)), rng.normal(size=(9, 9)), rng.normal(size=9))
    score = rng.normal(size=(3, 4, 9))
    size = np.array([4, 3, 1])
    got = pii.viterbi(field, score, size)
    for i, n in enumerate(size):
        paths = np.stack(np.meshgrid(*[np.arange(9)] * n, indexing="ij"), -1).reshape(-1, n)
        value = field.start[paths[:, 0]] + sum(score[i, t, paths[:, t]] for t in range(n)) + sum(field.moves[paths[:, t - 1], paths[:, t]] for t in range(1, n))
        assert got[i, :n].tolist() == paths[value.argmax()].tolist()


def test_calm_lines_change_nothing(docs):
    field = pii.trained()
    quick, slow = pii.Tagger(field), pii.Tagger(field)
    slow.joins_calm = lambda v: False
    batch = [r["text"] for r in docs.collect()] + ["Dr. Who called 555-123-4567 and (212) 555-1234, SSN 123-45-6789.\nMail ann [at] example [dot] com"]
    assert pii.all_spans(batch, quick) == pii.all_spans(batch, slow)
    kinds = [pii.KINDS[k] for _, k, _ in pii.all_spans(batch[-1:], quick)[0][1]]
    assert kinds == ["name", "phone", "phone", "id", "email"]


def test_pii_on_odd_rows(spark, odd, none):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == odd.count() and {r["spans"] for r in rows} == {""} and {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(none).count() == 0
    df = spark.createDataFrame([(1, "a 1.2.3.4 b@c.de, x", 99), (2, None, 5), (3, "clean", 5)], "doc_id bigint, text string, n_chars bigint")
    assert sorted(map(tuple, pii.redact(df).collect())) == [(1, "a [IP] [EMAIL], x", 17), (2, None, 5), (3, "clean", 5)]


# -- language model --------------------------------------------------------------------------------------


def test_added_spans_stay_apart():
    """Added spans against base spans, kept as by comparing each with each; classes of words stay few."""
    rng = random.Random(4)
    tag = pii.Tagger(pii.trained())
    words = ["a@b.cd", "call", "706-555-3138", "Mr.", "Otto", "1.2.3.4", "4111", "1111", "+1", "(706)", "555-3138", "x", "123-45-6789", "joe", "[at]", "host.org"]
    batch = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(300)]
    for text, (base, kept) in zip(batch, pii.all_spans(batch, tag), strict=True):
        want, free = list(base), 0
        for a, kind, b in sorted(tag.spans([text])[0]):
            if a >= free and pii.sound(kind, text[a:b]) and not any(x < b and a < y for x, _, y in base):
                want.append((a, kind, b))
                free = b
        assert kept == sorted(want)
    tag.spans([" ".join("".join(rng.choice("aZ9.,-_#§é") for _ in range(rng.randrange(1, 14))) for _ in range(30_000))])
    assert len(tag.classes) < 3000 and len(tag.calm) == len(tag.classes) + 1


def test_pii_of_repeated_rows_with_personal_data(spark):
    text = "Mail a@b.cd or joe [at] host.org, call 706-555-3138; 1.2.3.4 and 4111 1111 1111 1111"
    rows = [(1, text), (1, text), (None, text), (2, text + " Mr. Otto"), (3, None), (4, "")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    tag = pii.Tagger(pii.trained())
    want = Counter((i, pii.joined(pii.all_spans([t or ""], tag)[0][1]), pii.joined(plain_spans(t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], r["spans"], next(b for i, s, b in want if (i, s) == (r["doc_id"], r["spans"]))) for r in got) == want
    assert all(r["base_sha256"] == hashlib.sha256(pii.joined(plain_spans(dict(rows)[r["doc_id"]] or "")).encode()).hexdigest() for r in got)
    assert all([int(x.split(":")[1]) for x in r["spans"].split(",") if x] == sorted(int(x.split(":")[1]) for x in r["spans"].split(",") if x) for r in got)


def plain_katz(rows):
    """Scores, and the sums over the vocabulary after each word, from whole dictionaries."""
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    trains = [i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    one, two = Counter(), Counter()
    for t, train in zip(tokens, trains, strict=True):
        if train:
            one.update(t)
            two.update(zip([b"\t", *t], t, strict=False))
    seen = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(seen(one)), katz.discounts(seen(two))
    cut = lambda d, c: c if c > 5 else d[c] * c
    n, v = sum(one.values()), len(one)
    left = n - sum(cut(d1, c) for c in one.values())
    norm = n if left > 0 else n + 1

    def p1(w):
        return cut(d1, one[w]) / norm if w in one else 1 - (n - left) / norm

    total, weight, mass = Counter(), Counter(), Counter()
    for (h, w), c in two.items():
        total[h] += c
        weight[h] += cut(d2, c)
        mass[h] += p1(w)

    def p2(h, w):
        if not total[h]:
            return p1(w)
        z = total[h] if total[h] - weight[h] > 1e-9 * total[h] else total[h] + 1
        return cut(d2, two[h, w]) / z if (h, w) in two else (1 - weight[h] / z) / (1 - mass[h]) * p1(w)

    sums = [sum(p2(h, w) for w in one) + p2(h, b"?? never") for h in list(total)[:40]]
    scores = [(not train, len(t), sum(w in one for w in t), n, sum(np.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(np.log10(p2(h, w)) for h, w in zip([b"\t", *t], t, strict=False))) for t, train in zip(tokens, trains, strict=True)]
    return scores, sums


def test_katz_sums_beyond_32_bits():
    keys, big = np.array([3, 9], np.uint64), np.array([2**32 - 1, 7], np.uint64)
    items = katz.Words(keys, big, 4)
    whole = katz.Words.merged([items.ask(np.arange(2)), items.ask(np.arange(2)), items.ask(np.arange(1))], 4)
    assert whole.count.tolist() == [3 * (2**32 - 1), 14]


@pytest.mark.parametrize(("blocks", "pieces", "fan"), [(1, 1, 256), (300, 40, 256), (70, 300, 4), (5, 2, 2)])
def test_katz_exchange(blocks, pieces, fan):
    """A block sends at most ``fan`` messages and every key meets in one partition."""
    tree = katz.Exchange(blocks, pieces, fan)
    assert tree.parts >= pieces and (tree.depth == 1 or tree.fan <= fan)
    rng = np.random.default_rng(1)
    at = {b: [katz.Words(np.unique(rng.integers(0, 5000, 300).astype(np.uint64)), np.zeros(300, np.uint64), tree.parts)] for b in range(blocks)}
    for level in range(1, tree.depth + 1):
        nodes = {}
        for child, items in at.items():
            sent = list(tree.messages(child, level, items[0]))
            assert len(sent) <= max(fan, tree.fan)
            for node, _, data in sent:
                nodes.setdefault(node, []).append(data)
        at = {n: [katz.Words.merged(d, tree.parts)] for n, d in nodes.items()}
    keys = np.concatenate([x[0].keys for x in at.values()])
    assert len(keys) == len(np.unique(keys)) and set(at) <= set(range(tree.parts))


@pytest.mark.parametrize(("block", "part", "share", "fan"), [(2_000_000, 2_000_000, 1000, 256), (3000, 5000, 1000, 256), (3000, 5000, 10, 256), (3000, 5000, 10, 2)])
def test_katz_equals_dictionaries(spark, docs, monkeypatch, block, part, share, fan):
    monkeypatch.setattr(katz, "HOT_SHARE", share)
    monkeypatch.setattr(katz, "FAN", fan)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()[:60]] + [(1001, None), (1002, ""), (1003, "zzz  THE the\vqqq")]
    scores, sums = plain_katz(rows)
    assert np.allclose(sums, 1)
    got = {r["doc_id"]: tuple(r)[1:] for r in katz.katz_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), block_tokens=block, part_tokens=part).collect()}
    for (i, _), want in zip(rows, scores, strict=True):
        assert np.allclose(np.array(got[i], float), np.array(want, float), atol=1e-7), i


def test_katz_on_odd_rows(spark, odd, none):
    rows = katz.katz_scores(odd).collect()
    assert len(rows) == odd.count() and sum(r["doc_id"] is None for r in rows) == 2 and all(r["score"] <= 0 for r in rows)
    assert katz.katz_scores(none).count() == 0
    held = spark.createDataFrame([(i, "only held out") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id bigint, text string")
    assert {(r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in katz.katz_scores(held).collect()} == {(0, 0, 0.0, 0.0)}


# -- fingerprints ----------------------------------------------------------------------------------------


def test_sampling_estimates_similarity(docs):
    texts = [r["text"] for r in docs.collect()][:120]
    others = [sampling.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]

    def exact(a, b):
        x, y = ({w: c * len(w) ** 2 for w, c in sampling.terms(t).items()} for t in (a, b))
        keys = set(x) | set(y)
        return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))

    s = sampling.Sampler(512)
    got = sampling.likeness(s.signatures(texts), s.signatures(others))
    want = np.array([exact(a, b) for a, b in zip(texts, others, strict=True)])
    assert abs((got - want).mean()) < 0.006 and np.sqrt(((got - want) ** 2).mean()) < 0.03
    small = sampling.Sampler(64, kept=900)  # tables that fill up and are dropped give the same
    assert np.array_equal(small.signatures(texts[:30]), sampling.Sampler(64).signatures(texts[:30]))


@pytest.mark.parametrize("rows", [4096, 7])
def test_edited_pairs(spark, docs, monkeypatch, rows):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", rows)
    got = {r["doc_id"]: r for r in sampling.edited_likeness(docs.repartition(5)).collect()}
    ordered = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(got) == len(ordered)
    for (i, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        assert got[i]["edited_sha256"] == hashlib.sha256(sampling.edited(a, b).encode()).hexdigest() and got[i]["n_chars"] == len(a)
    mean = lambda c: np.mean([r[c] for r in got.values()])
    assert mean("near_edited") > 0.5 > 0.1 > mean("near_next")


@pytest.mark.parametrize("rows", [4096, 3])
def test_edited_on_odd_rows(spark, odd, none, monkeypatch, rows):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", rows)
    got = sampling.edited_likeness(odd).collect()
    assert len(got) == odd.count()
    order = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = Counter((i, hashlib.sha256(sampling.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
    assert sampling.edited_likeness(none).count() == 0
    one = sampling.edited_likeness(odd.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("rows", [4096, 2, 5])
def test_edited_with_large_and_repeated_ids(spark, monkeypatch, rows):
    """Every row comes back, whatever its id, and every column of it as recomputed by hand."""
    monkeypatch.setattr(sampling, "BUCKET_ROWS", rows)
    rng = random.Random(rows)
    top = (1 << 63) - 1
    ids = [(1 << 53) - 1, 1 << 53, (1 << 53) + 1, (1 << 53) + 3, -(1 << 53) - 1, top, top - 1, -top - 1, None, None, None, 5, 5, 5, 5, 5, 5]
    for _ in range(6):
        data = [(i, " ".join(rng.choice(["sun", "moon", "Star", "ö", "x" * 20, *"abcdefgh"]) for _ in range(rng.randrange(12)))) for i in rng.sample(ids, rng.randrange(1, len(ids)))]
        data += [data[0]] * rng.randrange(4)
        got = sampling.edited_likeness(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).collect()
        order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        coder = sampling.Sampler()
        want = Counter()
        for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
            text = sampling.edited(a, b)
            mine, other, nxt = coder.signatures([a, text, b])
            prints = sampling.as_text(np.stack([mine, other]))
            want[i, len(a), hashlib.sha256(text.encode()).hexdigest(), *prints, float((mine == other).mean()), float((mine == nxt).mean())] += 1
        if len(set(data)) == len({(i, t[: sampling.TIE]) for i, t in data}):
            assert Counter(tuple(r) for r in got) == want
        assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in data)


def test_signature_by_hand():
    """A sample is the term with the smallest value; equal draws are equal marks."""
    text = "one two two three"
    coder = sampling.Sampler(16)
    found = sorted(sampling.terms(text).items())
    value, mark = coder.draw(found)
    want = [int(mark[min(range(len(found)), key=lambda k: value[k, s]), s]) for s in range(16)]
    assert coder.signatures([text])[0].tolist() == want


# -- near-duplicates -------------------------------------------------------------------------------------


def plain_components(prints, budget):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def clusters(rng, n):
    out = []
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 30])):
            x = centre
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
            if rng.random() < 0.2:
                centre = x
    return np.unique(np.array(out, np.uint64))


def test_trie_join_equals_all_pairs():
    for seed in range(4):
        v = clusters(random.Random(seed), 250)
        links = simhash.Links(len(v))
        simhash.trie_join(v, np.array([0]), np.array([len(v)]), 4, links)
        assert links.label.tolist() == plain_components(v, 4)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_near_links_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_GROUP", hot)
    v = clusters(random.Random(9), 300)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp bigint")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.near_links(df, 4)).collect()}
    got, want = {}, {}
    for x, label in zip(v.view(np.int64).tolist(), plain_components(v, 4), strict=True):
        got.setdefault(roots.get(x, x), set()).add(x)
        want.setdefault(label, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (300, 300)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_dealt_join_keeps_every_row(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k", "CAST(id % 1024 AS SMALLINT) AS salt")
    facts = spark.range(2000).selectExpr("id AS k", "id * 10 AS fact")
    got = {(r["id"], r["fact"]) for r in graph.dealt_join(rows, facts, "k").collect()}
    assert got == {(i, 10 * (7 if i % 3 == 0 else i)) for i in range(3000) if i % 3 == 0 or i < 2000}
    assert graph.dealt_join(rows.limit(0), facts, "k").columns == ["k", "id", "fact"]


def test_fingerprint_bits():
    import xxhash

    text = "The  quick\tbrown fox jumps over\nthe lazy DOG the quick brown fox"
    words = text.lower().split()
    h = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text) == want and simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64(b"one two", seed=42).intdigest()


def test_near_duplicates(docs, odd, none):
    rows = sorted((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = np.array([p for _, p, _ in rows], np.int64).view(np.uint64)
    assert [c for _, _, c in rows] == [rows[i][0] for i in plain_components(prints, 4)]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert {(2, 2), (3, 2), (4, 2), (6, 6), (7, 6)} <= got and (None, 2) in got and (None, None) in got
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(docs, odd, none):
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    plain = odd.drop("bucket")
    left = simhash.keep_one(plain).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1, 2, 5, 6, 8] and simhash.keep_one(none).count() == 0


# -- quality ---------------------------------------------------------------------------------------------


def test_trees_equal_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    f = quality.fit(x, y, trees=30, depth=3)

    def walk(row):
        total = f.base
        for feature, cut, leaf in zip(f.feature, f.cut, f.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose([walk(r) for r in x[:200]], f.logit(x[:200])) and ((f.predict(x) > 0.5) == y).mean() > 0.95
    assert quality.fit(x, np.ones(800)).predict(x[:2]).min() > 0.99 and len(quality.fit(x[:0], y[:0]).predict(x[:3])) == 3


def test_quality_fits_one_row_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    docs = spark.createDataFrame([(ids[0], f"text {i % 7} again") for i in range(500)] + [(i, "another text") for i in ids[1:]], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)] + [(ids[0], 1), (None, 1)], "doc_id bigint, quality int")
    for rows in (docs, docs.orderBy(docs.text.desc())):
        quality.learn(rows, labels)
    assert [len(x) for x, _ in seen] == [3, 3] and sorted(seen[0][1].tolist()) == [0, 1, 1]
    assert np.array_equal(seen[0][0], seen[1][0]) and np.array_equal(seen[0][1], seen[1][1])


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (5, 0, 1), (99, 1, 1)], "doc_id bigint, quality int, score int")
    forest = quality.learn(odd, labels)
    rows = quality.score(odd, forest).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert quality.score(none, quality.learn(none, labels)).count() == 0 and quality.accepted(none, forest).columns == odd.columns
    assert quality.accepted(odd, forest, 0.0).count() == odd.count()


def test_shape_sees_the_whole_word():
    joined = ",".join(["ab"] * 30)
    assert pii.shape(joined + ",12") != pii.shape(joined + ",ab") and len(pii.shape(joined)) <= 40
    assert pii.shape("x" * 50 + "1") == "xd1" and pii.shape("Abc-1234567") == "Xx-d6"
