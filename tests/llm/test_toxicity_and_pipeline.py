"""Toxicity by held-out accuracy, and the pipeline stage by stage."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from colloquy.llm import toxicity

BAD = ["foulword", "nastyterm", "uglyname", "cursething"]


def corpus(n=1200, seed=4):
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 400, 40)]
        toxic = i % 8 == 0
        if toxic:
            for k in rng.choice(4, 2, replace=False):
                words[int(rng.integers(0, 40))] = BAD[k] if rng.random() < 0.7 else "vilestem" + str(rng.integers(0, 10**6))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id long, text string, score string, row string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    truth = {i: y for i, _, y in rows}
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]]]) > 0.9
    kept = toxicity.accepted(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_capitals_vote_counts_the_whole_text():
    for text in ("1 " * 150 + "ALL OF THIS", "日本語" * 80 + "ALL OF THIS", "MOSTLY CAPITAL LETTERS, NOT aLL", "SHOUT " * 100):
        assert "CAPITALS" in toxicity.signals(text), text
    for text in ("", "1 2 3", "日本語", "Just a Name Here", "SHOUT " * 40 + "and then a long quiet text " * 40):
        assert "CAPITALS" not in toxicity.signals(text), text


def test_held_out_labels_teach_nothing(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    lies = spark.createDataFrame([(i, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, lies).weights


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "foulword"), (3, "a" * 10000), (3, "a" * 10000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, none)).collect()
    assert [r["score"] for r in got] == [0.0] * 5 and {r["predicted"] for r in got} == {0}
    assert toxicity.scored(docs.where("false"), toxicity.fit(docs.where("false"), none)).collect() == []
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, odd).weights == {}


@pytest.mark.parametrize("seed", range(4))
def test_label_model_finds_accuracies_and_correlations(seed, monkeypatch):
    """Four independent voters, and the first of them said twice. Judged against the same model without links."""
    rng = np.random.default_rng(seed)
    y = rng.random(4000) < 0.2
    rates = [(0.6, 0.02), (0.5, 0.01), (0.4, 0.05), (0.7, 0.3)]
    four = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in rates], axis=1).astype(float)
    start, five = np.where(four[:, :2].any(axis=1), 0.8, 0.05), np.c_[four, four[:, 0]]
    parent, on, off, prior, belief = toxicity.label_model(five, start, 0.1)
    once = toxicity.label_model(four, start, 0.1)[4]
    monkeypatch.setattr(toxicity, "dependences", lambda votes, belief, least=0.0: np.full(votes.shape[1], -1))
    unlinked = toxicity.label_model(five, start, 0.1)[4]
    assert parent[4] == 0 or parent[0] == 4
    assert prior == pytest.approx(0.2, abs=0.04)
    assert on[0] == pytest.approx(0.6, abs=0.1) and off[0] == pytest.approx(0.02, abs=0.03)
    assert np.mean((belief > 0.5) == y) > 0.9
    # links take most of the doubled evidence out (the shrinkage of their tables leaves some), and the error it causes
    assert np.abs(once - belief).mean() < np.abs(once - unlinked).mean() / 2
    error = lambda b: np.mean((b - y) ** 2)
    assert error(belief) - error(once) < (error(unlinked) - error(once)) / 2


def test_posteriors_by_brute_force():
    """One EM step's posterior of every text, from the tables themselves."""
    rng = np.random.default_rng(2)
    y = rng.random(600) < 0.3
    first = np.where(y, rng.random(600) < 0.7, rng.random(600) < 0.05)
    votes = np.stack([first, first & (rng.random(600) < 0.8), rng.random(600) < np.where(y, 0.5, 0.1)], axis=1).astype(float)
    start = np.where(votes[:, 0] > 0, 0.7, 0.1)
    parent, _, _, prior, got = toxicity.label_model(votes, start, 0.3, rounds=1, links=1)
    assert sorted(parent.tolist()[:2]) in ([-1, 0], [-1, 1])
    for i in range(0, 600, 37):
        odds = prior / (1 - prior)
        for v in range(3):
            p = []
            for w, extra in ((start, 1.0), (1 - start, 20.0)):
                rate = (sum(w * votes[:, v]) + 0.1) / (sum(w) + extra)
                same = votes[:, parent[v]] == votes[i, parent[v]] if parent[v] >= 0 else np.full(600, True)
                fires = (sum(w * votes[:, v] * same) + 5 * rate) / (sum(w * same) + 5)
                p.append(fires if votes[i, v] else 1 - fires)
            odds *= p[0] / p[1]
        assert got[i] == pytest.approx(odds / (1 + odds), abs=1e-4)


def test_toxicity_odd_texts_under_a_fitted_scorer(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    scorer = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    long = "quiet " * 200_000
    odd = spark.createDataFrame([(1, None), (2, ""), (3, long), (4, long + BAD[0] + " " + BAD[1]), (4, long + BAD[0] + " " + BAD[1]), (None, BAD[0] + " " + BAD[1])], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["predicted"]) for r in toxicity.scored(odd, scorer).collect()))
    assert got == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = corpus_pipeline.staged(docs, "test")
        rows = docs.collect()
        now = {r["doc_id"]: r["text"] for r in rows}
        assert set(now) <= set(kept), name
        if name != "line dedup":
            assert all(kept[i] == t for i, t in now.items())
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: tuple(r)[:5]
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_pipeline_on_odd_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    words = " ".join(f"word{k * 7 % 61}" for k in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, words, "en", None, len(words)), (3, words, "en", None, len(words)), (None, words, None, "s", len(words)), (4, "x " * 70_000, "en", "s", 140_000)]
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame(some, schema).withColumn("row", F.lit(1)).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(3, 1, 0), (None, 1, 1), (2, None, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()}
        assert ids == ({3, None} if some else set())


def test_pipeline_keeps_one_of_each_group(spark, sf):
    from tests_support import unrelated_text

    base = [unrelated_text(k) for k in range(4)]
    near = [t.replace(t.split()[7], "changedword") for t in base]
    rows = [(2 * k, t, "en", "s", len(t)) for k, t in enumerate(base)] + [(2 * k + 1, t, "en", "s", len(t)) for k, t in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()}
    assert got == {0, 2, 4, 6}


def test_label_model_memory_is_that_of_the_votes():
    """Twenty thousand rows by 512 voters: bytes of votes and a few blocks of numbers, never the whole matrix in doubles (82 MB)."""
    import tracemalloc

    rng = np.random.default_rng(5)
    votes = (rng.random((20_000, 512)) < 0.02).astype(np.uint8)
    start = np.clip(votes[:, :40].mean(axis=1) * 8, 0.01, 0.99)
    tracemalloc.start()
    belief = toxicity.label_model(votes, start, 0.1, rounds=2)[4]
    toxicity.logistic(votes, belief, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak
