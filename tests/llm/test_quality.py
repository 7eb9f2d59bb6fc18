import tracemalloc
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexicrate.llm.quality import measure, op7_quality_rules, quality_rules
from lexicrate.llm.shared import TextChunks, WordHasher

from .helpers import SPACED, frame, odd_texts, prose


def brute(text, least=5):
    text = text or ""
    w = SPACED.findall(text)
    n = len(w)
    shared = [0] * n  # longest prefix that another suffix has too
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            shared[i], shared[j] = max(shared[i], k), max(shared[j], k)
    three = {i + d for i in range(n) if shared[i] >= 3 for d in range(3)}
    spans = {i + d for i in range(n) if shared[i] >= least for d in range(shared[i])}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(c - 1 for c in Counter(lines).values()), "n_repeat_words": len(three),
        "repeat_words": len(spans), "longest_repeat": max(shared, default=0),
    }


def measured(texts):
    import pyarrow as pa

    out = []
    for lo, hi, data, offsets in TextChunks(pa.array(texts, pa.string()), 200):
        m = measure(data, offsets, WordHasher(lower=False), 5)
        out += [{k: int(v[i]) for k, v in m.items()} for i in range(hi - lo)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é", max_size=60), max_size=6))
def test_measures(texts):
    assert measured(texts) == [brute(t) for t in texts]


def test_longer_texts():
    texts = [prose(i, 150, 3) for i in range(8)] + ["a b " * 80, prose(1, 60) + " " + prose(1, 60)]
    assert measured(texts) == [brute(t) for t in texts]


def test_memory_of_one_word_many_times():
    """A text of one word repeated needs a few arrays of its words, not one for every doubling."""
    data = np.frombuffer(b"w " * 200_000, np.uint8)
    tracemalloc.start()
    m = measure(data, np.array([0, len(data)]), WordHasher(lower=False), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m["longest_repeat"][0] == 199_999 and m["repeat_words"][0] == 200_000
    assert peak < 200 * 200_000


def test_query_on_small_tables(spark, tmp_path):
    texts = [(i, t) for i, t in odd_texts() if i != 9]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = []
    for i, t in texts:
        b = brute(t)
        n = b["n_words"]
        failed = n < 50 or 100 * b["n_repeat_words"] > 50 * n
        kept = not failed and b["repeat_words"] <= 0.5 * n and b["longest_repeat"] <= 40
        want.append((repr(i), *(b[c] for c in names), failed, kept))
    got = [(repr(r.doc_id), *(r[c] for c in names), r.base_failed, r.kept)
           for r in op7_quality_rules(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_verdict(spark):
    clean, twice = prose(11, 300, 5000), prose(12, 90, 5000)
    texts = odd_texts() + [(50, clean), (51, twice + "\n" + clean + "\n" + twice)]
    out = quality_rules(frame(spark, texts)).collect()
    assert len(out) == len(texts)
    by_id = {r.doc_id: r for r in out}
    assert by_id[50].kept and not by_id[50].base_failed
    assert not by_id[51].kept and not by_id[51].base_failed
    assert by_id[12].base_failed and not by_id[12].kept
    assert by_id[1].base_failed and by_id[1].n_words == 0
    for i, t in texts[:9]:
        if i not in (None, 4):
            assert by_id[i].n_repeat_words == brute(t)["n_repeat_words"]
    assert quality_rules(frame(spark, [])).count() == 0
