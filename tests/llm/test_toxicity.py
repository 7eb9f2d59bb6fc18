import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicrate.llm.toxicity import (
    LEXICONS, PATTERNS, Counter, _information, _joint, _spanning_tree, fit, label_model, op9_toxicity,
    score_toxicity, training_rows, votes_of,
)

from .helpers import frame, odd_texts, prose

BAD = ["vilkor", "grumbad", "zonkish"]


def labelled(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = prose(i, 60).split(" ")
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD).upper() + rng.choice(["", "!", "."])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_texts(spark):
    docs, labels = labelled(800)
    df = frame(spark, docs)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(training_rows(df, marks))
    out = score_toxicity(df, model).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = {r.doc_id: r for r in out.collect()}
    held = [(i, y) for i, y in labels if got[i].held]
    right = [got[i].toxic == bool(y) for i, y in held]
    assert len(held) > 100 and np.mean(right) > 0.98
    assert all(0 <= r.toxicity <= 1 for r in got.values())


def test_sample_is_bounded_and_without_held_out_rows(spark):
    docs, labels = labelled(200)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    rows = training_rows(frame(spark, docs), marks, sample_rows=50)
    assert rows.count() == 50
    assert rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).count() == 0


def test_label_model_needs_no_labels():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.2
    rate = [(0.7, 0.02), (0.6, 0.03), (0.5, 0.02)]
    free = [np.where(y, rng.random(6000) < a, rng.random(6000) < b) for a, b in rate]
    clean = np.where(y, rng.random(6000) < 0.05, rng.random(6000) < 0.5)
    votes = np.stack([free[0], free[0], free[1], free[2], clean], axis=1).astype(np.float32)
    posterior, rates, parents = label_model(votes, np.array([1, 1, 1, 1, -1]), 0.2)
    assert ((posterior > 0.5) == y).mean() > 0.93
    assert abs(posterior.mean() - 0.2) < 0.03
    # the copy is tied to its original; its vote counts once
    assert parents[1] == 0 or parents[0] == 1
    for (a, b), j in zip(rate[1:], (2, 3), strict=True):
        assert abs(rates[1][j] - a) < 0.12 and abs(rates[0][j] - b) < 0.05
    once, _, _ = label_model(votes[:, 1:], np.array([1, 1, 1, -1]), 0.2)
    assert np.abs(once - posterior).mean() < 0.05


def test_pair_counts_and_information_equal_brute_force():
    rng = np.random.default_rng(2)
    votes = (rng.random((50, 4)) < 0.4).astype(np.float32)
    weight = rng.random(50)
    total, one, pair = _joint(votes, weight)
    for i in range(4):
        assert np.isclose(one[i], sum(w for w, v in zip(weight, votes, strict=True) if v[i]), atol=1e-3)
        for j in range(4):
            want = 0.0
            for a in (0, 1):
                for b in (0, 1):
                    cell = sum(w for w, v in zip(weight, votes, strict=True) if v[i] == a and v[j] == b)
                    left = sum(w for w, v in zip(weight, votes, strict=True) if v[i] == a)
                    right = sum(w for w, v in zip(weight, votes, strict=True) if v[j] == b)
                    want += cell * np.log(cell * total / (left * right)) if cell > 0 else 0.0
            assert np.isclose(_information(total, one, pair)[i, j], want, atol=1e-2)


def test_spanning_tree_is_the_heaviest():
    weight = np.array([[0, 9, 1, 0], [9, 0, 5, 2], [1, 5, 0, 7], [0, 2, 7, 0]], float)
    parent = _spanning_tree(weight, 1.5)
    assert {tuple(sorted((i, p))) for i, p in enumerate(parent) if p >= 0} == {(0, 1), (1, 2), (2, 3)}
    assert list(_spanning_tree(weight, 10.0)) == [-1] * 4


def test_voters_of_form_and_lists():
    texts = ["You idiot, f**k off!! STOP THAT NOISE", "Please see http://x.y and 1 2 3 4 5, thanks", "plain"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    counts, words = Counter(np.zeros(0, np.int64))(data, offsets)
    votes = votes_of(counts)
    named = [name for name, *_ in [*LEXICONS, *PATTERNS]]
    said = [{named[j] for j in np.flatnonzero(v)} for v in votes]
    assert {"en insults to the mind", "shouted words", "exclamation runs", "masked swear words",
            "insult near an address"} <= said[0]
    assert said[1] == {"en courtesy", "links", "figures"} and not said[2]


def test_uses_beyond_16_bits_count(spark):
    docs, labels = labelled(160)
    docs[0] = (0, "vilkor " * 70_000)
    model = fit(training_rows(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")))
    counts, _ = Counter(model.suggested)(
        np.frombuffer(b"idiot " * 70_000, np.uint8), np.array([0, 6 * 70_000])
    )
    assert counts.max() == 70_000


def test_more_rows_than_the_bound(spark):
    train = spark.createDataFrame([(i, "a", 0) for i in range(5)], "doc_id long, text string, toxic int")
    with pytest.raises(ValueError):
        fit(train, sample_rows=4)


def test_query_on_small_tables(spark, tmp_path):
    docs, labels = labelled(400)
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op9_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 400
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, dict(labels)[i]) for i, r in got.items() if r.held_out]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_edges(spark):
    df = frame(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(training_rows(df, none))
    out = score_toxicity(df, model).collect()
    assert len(out) == len(odd_texts()) and not any(r.toxic for r in out)
    assert {r.start for r in out} == {3}
    clash = score_toxicity(df.withColumns({"toxic": F.lit("x"), "toxicity": F.lit("y")}), model)
    assert clash.columns == [*df.columns, "toxicity", "toxic"] and clash.count() == len(odd_texts())
    assert score_toxicity(frame(spark, []), model).count() == 0
    clean = fit(training_rows(df, spark.createDataFrame([(0, 0), (7, 0)], "doc_id long, toxic int")))
    assert score_toxicity(df, clean).where("toxic").count() == 0
