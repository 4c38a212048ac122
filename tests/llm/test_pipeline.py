import random

from keelstone.llm import pii, quality, simhash
from keelstone.llm.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_ten_operators_and_the_pipeline():
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]


def test_pipeline_equals_plain_steps(spark):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    forest = quality.learn(docs, labels)
    kept = sorted(i for i, t in rows.items() if forest.predict(quality.features([t]))[0] >= corpus_pipeline.THRESHOLD)
    words = {i: rows[i].encode().lower().split() for i in kept}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    stay, groups = [], []
    for i in kept:  # five words, similarity 0.8; ascending ids: the first of a group stays
        near = [g for g in groups if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in g)]
        groups = [g for g in groups if g not in near] + [sorted([i, *(j for g in near for j in g)])]
    stay = {min(g) for g in groups}
    tag = pii.Tagger(pii.trained())
    clean = {i: pii.redacted(rows[i], pii.all_spans([rows[i]], tag)[0][1]) for i in stay}

    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == docs.columns, name
    got = at.collect()
    assert {r["doc_id"]: r["text"] for r in got} == clean and all(r["n_chars"] == len(r["text"]) for r in got)
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == stay


def test_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for rows in (odd, none):
        at = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == rows.columns
            at.collect()
        corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()


def test_dedup_stage_finds_similarity_of_five_words(spark, monkeypatch):
    """Against all pairs: texts of similarity 0.8 that differ in more than four bits, and none below."""
    import corpus_pipeline
    from keelstone.llm import likeness

    rng = random.Random(3)
    rows = {}
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(12):
            text = list(words)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows[len(rows) * 7 % 144 + 1000 * (base % 2)] = " ".join(text)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(146)} for i, t in rows.items()}
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in rows for j in rows if i < j}
    root = {i: i for i in rows}
    for (i, j), s in like.items():
        if s >= 0.8:
            root = {k: min(root[i], root[j]) if r in (root[i], root[j]) else r for k, r in root.items()}
    prints = {i: simhash.fingerprint(t) for i, t in rows.items()}
    assert any(s >= 0.8 and (prints[i] ^ prints[j]).bit_count() > 4 for (i, j), s in like.items())
    for limit in (likeness.BLOCK_BYTES, 3000):  # whole groups, and groups dealt out
        monkeypatch.setattr(likeness, "BLOCK_BYTES", limit)
        got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"), SF)
        assert {r["doc_id"] for r in got.collect()} == set(root.values())
    assert likeness.MISS < 1e-4
