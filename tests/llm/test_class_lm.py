import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexicrate.llm import class_lm
from lexicrate.llm.class_lm import op8_class_lm_scoring, score_documents, squeezed, unsqueezed
from lexicrate.llm.shared import crc32_of_id

from .helpers import LOWER, SPACED, frame, odd_texts, prose


def with_split(df):
    return df.withColumn("held_out", crc32_of_id(F.col("doc_id")) % 7 == 2)


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def words(t):
    return SPACED.findall((t or "").translate(LOWER)) + [None]


def test_base_scores_and_counts(spark):
    texts = odd_texts() + [(i, prose(i, 80)) for i in range(20, 60)]
    c = Counter()
    for i, t in texts:
        if not held(i):
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (
            (repr(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n,
             round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6))
            for i, t in texts
        )
    )
    out = score_documents(with_split(frame(spark, texts)), classes=12, passes=2).collect()
    got = sorted(
        (repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out
    )
    assert got == want
    assert all(r.score < 0 for r in out)


def test_classes_beat_the_unigram_on_held_out_texts(spark):
    rng = np.random.default_rng(3)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = []
    for i in range(400):  # two kinds of words that keep to themselves
        pool = a if i % 2 else b
        texts.append((i, " ".join(rng.choice(pool, 60))))
    out = score_documents(with_split(frame(spark, texts)), classes=10, passes=4).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_words_exchanged_once_help_too(spark):
    """With a share that no word reaches but the end, all classes come from the one exchange."""
    rng = np.random.default_rng(3)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = [(i, " ".join([x for w in rng.choice(a if i % 2 else b, 40) for x in ("is" if i % 2 else "of", w)]))
             for i in range(400)]
    df = with_split(frame(spark, texts))
    out = score_documents(df, classes=10, passes=4, least_share=0.2).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)
    c = Counter()
    for i, t in texts:
        if not held(i):
            c.update(words(t))
    n, v = sum(c.values()), len(c)
    for r in out[:20]:
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(dict(texts)[r.doc_id]))
        assert math.isclose(r.base_score, want, rel_tol=1e-9)


def test_probabilities_sum_to_one(spark):
    """One text of every word of the vocabulary, an unseen one, and none: all texts of up to one
    word, each followed by its end.  Dividing out what follows the word leaves a distribution."""
    train = [(i, " ".join(["x", "y", "z", "x", "y", "w"] * 8)) for i in range(30) if not held(i)]
    seen = ["x", "y", "z", "w"]
    ids = [i for i in range(1000, 3000) if held(i)]
    tests = [(ids[k], w) for k, w in enumerate([*seen, "unseen", "x x", "y y", "z z", "w w", "unseen unseen"])]
    for share in (1e-6, 0.2):
        df = with_split(frame(spark, [*train, *tests, (ids[20], "")]))
        out = {r.doc_id: r.score for r in score_documents(df, classes=8, passes=2, least_share=share).collect()}
        one = [10 ** out[ids[k]] for k in range(5)]
        two = [10 ** out[ids[5 + k]] for k in range(5)]
        # P(w, end) = P(w|begin) P(end|w); P(w, w, end) = P(w|begin) P(w|w) P(end|w)
        assert all(t < o for o, t in zip(one, two, strict=True))
        assert sum(one) + 10 ** out[ids[20]] < 1 + 1e-9


def brute_score(texts, word_class, k, mix):
    """The class bigram mixed with the unigram, from plain counts; ``word_class`` maps words to classes."""
    c, steps = Counter(), Counter()
    for i, t in texts:
        if held(i):
            continue
        last = 0
        for w in words(t):
            c[w] += 1
            steps[last, word_class(w)] += 1
            last = word_class(w)
    n, v = sum(c.values()), len(c)
    row, column = Counter(), Counter()
    for (a, b), m in steps.items():
        row[a] += m
        column[b] += m
    types, tokens = Counter(), Counter()
    for w, m in c.items():
        types[word_class(w)] += 1
        tokens[word_class(w)] += m
    types[1] += 1  # unseen words
    out = {}
    for i, t in texts:
        last, total = 0, 0.0
        for w in words(t):
            g = word_class(w)
            share = (column[g] + 1) / (sum(column.values()) + k)
            p = (steps[last, g] + share) / (row[last] + 1)
            if g:
                p *= (c[w] + 1) / max(types[g] + tokens[g], 1)
            total += math.log10(mix * p + (1 - mix) * (c[w] + 1) / (n + v + 1))
            last = g
        out[i] = total
    return out


def test_full_score_equals_brute_force_where_words_are_rare(spark):
    """No word is seen often enough to be clustered: classes are the bands of count."""
    texts = [(i, prose(i, 6, 3)) for i in range(40)]
    c = Counter()
    for i, t in texts:
        if not held(i):
            c.update(words(t))
    c[None] = 0
    assert max(m for w, m in c.items() if w) < class_lm.LEAST_COUNT

    def word_class(w):
        return 0 if w is None else 1 + (c[w] >= 2) + (c[w] >= 4)

    want = brute_score(texts, word_class, 8, 0.85)
    out = score_documents(with_split(frame(spark, texts)), classes=8).collect()
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in out)


def test_counts_beyond_32_bits():
    """Two chunks hold a word 3e9 times each: the bucket sends the exact sum back."""
    import pyarrow as pa

    word = np.array([12345], np.uint64)
    rows = [
        {"bucket": 7, "chunk": i, "keys": word.tobytes(), "counts": squeezed(np.array([3_000_000_000 + i])),
         "meta": None, "seq": None}
        for i in range(2)
    ]
    out = class_lm._count(pa.Table.from_pylist(rows, class_lm._Rows(class_lm.PACKED).table().schema)).to_pylist()
    back = [unsqueezed(r["counts"]).tolist() for r in out if r["counts"] is not None]
    assert back == [[6_000_000_001]] * 2
    stats = np.frombuffer(next(r["stats"] for r in out if r["stats"] is not None), np.int64)
    assert stats[-1] == 6_000_000_001


def test_query_on_small_tables(spark, tmp_path):
    texts = odd_texts()
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_class_lm_scoring(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens) for r in got) == sorted(
        (repr(i), held(i), len(words(t))) for i, t in texts
    )


def test_edges(spark):
    assert score_documents(with_split(frame(spark, []))).count() == 0
    row = score_documents(frame(spark, [(1, "a b")]).withColumn("held_out", F.lit(True))).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    values = np.array([0, 5, 70_000, 2**32 - 1, 2**40])
    assert unsqueezed(squeezed(values[:4])).tolist() == values[:4].tolist()
    assert unsqueezed(squeezed(values)).tolist() == values.tolist()
