import itertools
import random

import numpy as np
import pytest

from lexicrate.llm import jaccard
from lexicrate.llm.jaccard import jaccard_classes, op5_ngram_jaccard_join
from lexicrate.llm.shared import CHUNK_BITS, ITEM_BITS, item_numbers

from .helpers import LOWER, SPACED, frame, odd_texts, prose


def sets(texts):
    out = []
    for _, t in texts:
        w = SPACED.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(texts):
    """(doc_id, size, component) by comparing all pairs."""
    s = sets(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and 100 * both >= 80 * (len(s[a]) + len(s[b]) - both):
            root[find(b)] = find(a)
    out = []
    for i, (doc_id, _) in enumerate(texts):
        group = [texts[j][0] for j in range(len(texts)) if find(j) == find(i)]
        known = [g for g in group if g is not None]
        out.append((doc_id, len(s[i]), min(known) if known and s[i] else doc_id))
    return sorted(out, key=repr)


def got(spark, texts):
    rows = jaccard_classes(frame(spark, texts)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def edited(text, seed, times):
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10_000)}"
    return " ".join(words)


def test_odd_texts(spark):
    texts = odd_texts()
    assert got(spark, texts) == brute(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_around_the_threshold(spark, seed):
    texts, n = [], 0
    for g in range(4):
        base = prose(100 * seed + g, 150)
        for k in range(14):
            texts.append((n, edited(base, n, k // 2)))
            n += 1
    passage = prose(999 + seed, 90)
    for k in range(12):  # a shared passage with own words: close to the threshold
        texts.append((n, passage + " " + prose(5000 + 31 * k + seed, 8 + k)))
        n += 1
    random.Random(seed).shuffle(texts)
    assert got(spark, texts) == brute(texts)


def test_chain_of_small_steps(spark):
    words = prose(7, 200).split(" ")
    texts = []
    for k in range(25):
        words = words[2:] + [f"new{k}a", f"new{k}b"]
        texts.append((50 - k, " ".join(words)))
    assert got(spark, texts) == brute(texts)


def test_unlinked_null_ids_still_link_on(spark):
    """Nulls share a value, yet a chain through them reaches the known id at its end."""
    words = prose(8, 200).split(" ")
    texts = []
    for k in range(12):
        words = words[2:] + [f"new{k}a", f"new{k}b"]
        texts.append((5 if k == 11 else None, " ".join(words)))
    texts.append((None, prose(77, 60)))
    out = [r.component_id for r in jaccard_classes(frame(spark, texts)).collect()]
    assert sorted(out, key=repr) == [5] * 12 + [None]


@pytest.mark.parametrize("turns", [0, 1])
def test_what_pivots_leave_open(spark, monkeypatch, turns):
    """With few or no pivots, skipping, splits and derived answers do the work."""
    monkeypatch.setattr(jaccard, "TURNS", 1)
    monkeypatch.setattr(jaccard, "COMPARED", turns)
    monkeypatch.setattr(jaccard, "SPLIT", 2)
    texts, n = [], 0
    for g in range(3):
        base = prose(100 + g, 150)
        for k in range(12):
            texts.append((n, edited(base, n, k // 2)))
            n += 1
    passage = prose(999, 90)
    for k in range(12):
        texts.append((n, passage + " " + prose(5000 + 31 * k, 8 + k)))
        n += 1
    assert got(spark, texts) == brute(texts)


def test_large_numbers():
    far = (1_000_000 << CHUNK_BITS) + 5  # a task far beyond a 100 TB input's
    assert item_numbers(far, 3).tolist() == [(far << ITEM_BITS) + i for i in range(3)]
    with pytest.raises(OverflowError):
        item_numbers(far, (1 << ITEM_BITS) + 1)


@pytest.mark.parametrize("values", [[], [1, 2, 255], [1, 256, 70_000]])
def test_packed_numbers(values):
    x = np.array(values, np.int64)
    assert jaccard._from_small(jaccard._small(x)).tolist() == values
    assert [a.tolist() for a in jaccard._from_own(jaccard._own(x, x[::-1]))] == [values, values[::-1]]
    assert jaccard._from_flags(jaccard._flags(x > 100)).tolist() == [v > 100 for v in values]


def test_query_on_small_tables(spark, tmp_path):
    texts = odd_texts()
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = op5_ngram_jaccard_join(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(texts)


def test_empty_table(spark):
    assert jaccard_classes(frame(spark, [])).count() == 0
