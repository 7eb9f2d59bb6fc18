import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicrate.llm.line_dedup import _arrays, _blob, _words, dedup_lines, op4_line_dedup, repeated_words, without
from lexicrate.llm.shared import WordHasher

from .helpers import SPACED, frame, odd_texts, prose


def lines(text):
    parts = [p for line in (text or "").split("\n") for p in re.split(r"(?<=[.!?]) ", line)]
    return [w for w in map(SPACED.findall, parts) if w]


def grams(text, words):
    """(words, first line, last line) of all grams, forward and backward, with their place."""
    u = lines(text)
    at = [0]
    for w in u:
        at.append(at[-1] + len(w))
    flat = [w for x in u for w in x]
    out = set()
    for s in range(len(u)):
        e = next((e for e in range(s, len(u)) if at[e + 1] - at[s] >= words), None)
        if e is not None:
            out.add((tuple(flat[at[s] : at[e + 1]]), at[s], s, e))
        b = next((b for b in range(s, -1, -1) if at[s + 1] - at[b] >= words), None)
        if b is not None:
            out.add((tuple(flat[at[b] : at[s + 1]]), at[b], b, s))
    return out


def repeated(texts, words):
    """Lines of every document that lie in a gram with an earlier place."""
    first = {}
    for i, t in texts:
        for g, place, _, _ in grams(t, words):
            first[g] = min(first.get(g, (i, place)), (i, place))
    gone = {}
    for i, t in texts:
        for g, place, a, b in grams(t, words):
            if first[g] != (i, place):
                gone.setdefault(i, set()).update(range(a, b + 1))
    return gone


def run_lines(text, words):
    """(words of the shortest run from each line on, first, last)."""
    u = lines(text)
    for s in range(len(u)):
        n = 0
        for e in range(s, len(u)):
            n += len(u[e])
            if n >= words:
                yield tuple(w for x in u[s : e + 1] for w in x), s, e
                break


@pytest.fixture(scope="module")
def corpus():
    passage = prose(50, 55)
    texts = [(i, prose(i, 40 + 9 * i)) for i in range(12)]
    for i in range(12, 30):
        texts.append((i, prose(i, 60).strip() + "\n" + passage.strip() + "\n" + prose(1000 + i, 45)))
    texts.append((30, texts[4][1]))
    texts.append((31, "Same line here with some words.\n" * 40))
    return texts


def test_removed_lines_are_repeats_and_long_runs_go(spark, corpus):
    out = {r.doc_id: r for r in dedup_lines(frame(spark, corpus)).collect()}
    assert len(out) == len(corpus)
    allowed = repeated(corpus, 20)
    seen = set()
    for i, t in corpus:
        gone = set(out[i].removed_lines)
        assert gone <= allowed.get(i, set())
        for run, a, b in run_lines(t, 40):
            if run in seen:
                assert set(range(a, b + 1)) <= gone
            seen.add(run)
        kept = [w for k, w in enumerate(lines(t)) if k not in gone]
        assert lines(out[i].text) == kept
        assert out[i].removed_words == sum(len(w) for k, w in enumerate(lines(t)) if k in gone)
        assert (out[i].lang, out[i].start, out[i].n_words) == (None if i == 1 else "en", 3, 7)
    assert out[30].text == ""
    assert out[11].text == corpus[11][1]


def test_odd_texts(spark):
    texts = odd_texts()
    out = dedup_lines(frame(spark, texts)).collect()
    assert len(out) == len(texts)
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert by_id[0] == [texts[0][1]]
    assert by_id[5] == [""]
    assert sorted(by_id[None], key=repr) == ["", None]
    assert by_id[1] == [None] and by_id[4] == ["one", "one"]
    assert dedup_lines(frame(spark, [])).count() == 0


def distinct(seed, n):
    """Words that no other seed has."""
    return [f"w{seed}x{k}" for k in range(n)]


@pytest.mark.parametrize("stop", ["", "."])
@pytest.mark.parametrize("words", [40, 50])
def test_passages_inside_lines(spark, stop, words):
    passage = distinct(99, words)
    for k in range(7, words, 30):  # lines of 30 words; the first and the last are cut ones
        passage[k] += stop
    own = {i: (distinct(i, 11 + i), distinct(100 + i, 9 + i)) for i in range(8)}
    texts = [(i, " ".join([*a, *passage, *b])) for i, (a, b) in own.items()]
    texts.append((8, " ".join(distinct(8, 30) + passage[:19] + distinct(108, 30))))
    out = {r.doc_id: r for r in dedup_lines(frame(spark, texts)).collect()}
    assert [out[i].removed_words for i in range(9)] == [0] + [words] * 7 + [0]
    assert out[0].text == texts[0][1] and out[8].text == texts[8][1]
    for i in range(1, 8):
        assert out[i].text == " ".join([*own[i][0], *own[i][1]])


def test_cuts_keep_line_breaks(spark):
    passage = " ".join(distinct(5, 45))
    texts = [(0, passage), (1, f"Own head {passage}\nnext line."), (2, f"Head.\n{passage} own tail.\nEnd.")]
    out = {r.doc_id: r for r in dedup_lines(frame(spark, texts)).collect()}
    assert out[1].text == "Own head\nnext line." and out[1].removed_lines == []
    assert out[2].text == "Head.\nown tail.\nEnd." and out[2].removed_words == 45


def brute_spans(texts, gram=20, run=40):
    """(doc_id, spans) of what goes, by plain loops over words; only the hash is the library's."""
    hasher, no_id = WordHasher(lower=False), (1 << 63) - 1
    docs = []
    for i, t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        w = SPACED.findall(t or "")
        value = []
        if len(w) >= gram:
            value = _words(data, np.array([0, len(data)]), hasher).hash(np.arange(len(w) - gram + 1), gram).tolist()
        kept = set()
        for a in range(max(1, len(w) - run + 1)):
            window = range(a, min(a + run - gram + 1, len(value)))
            low = min((value[j] for j in window), default=None)
            kept |= {j for j in window if value[j] == low}
        docs.append((no_id if i is None else i, w, value, kept))
    count = {}
    for _, _, value, kept in docs:
        for j in kept:
            count[value[j]] = count.get(value[j], 0) + 1
    found, first = [], {}
    for i, w, value, kept in docs:
        zone = set()
        for j in kept:
            if count[value[j]] > 1:
                zone.update(range(max(0, j - run), min(len(w), j + gram + run)))
        grams = [j for j in range(len(value)) if all(x in zone for x in range(j, j + gram))]
        found.append((i, w, grams))
        for j in grams:
            key = tuple(w[j : j + gram])
            first[key] = min(first.get(key, (i, j)), (i, j))
    out = set()
    for i, w, grams in found:
        gone = set()
        for j in grams:
            if first[tuple(w[j : j + gram])] != (i, j):
                gone.update(range(j, j + gram))
        spans = []
        for x in sorted(gone):
            if spans and spans[-1] == x:
                spans[-1] = x + 1
            else:
                spans += [x, x + 1]
        if spans:
            out.add((i, tuple(spans)))
    return out


def planted(seed):
    """Texts that share runs of 15 to 70 words, in and across lines, within and between texts."""
    base = [prose(900 + seed + k, 70).split(" ") for k in range(4)]
    texts = []
    for i in range(24):
        words = prose(3000 + 50 * seed + i, 120).split(" ")
        run = base[i % 4][: 15 + (i * 7) % 56]
        at = (i * 13) % 100
        words[at:at] = run
        if i % 6 == 0:
            words += ["and", *run]
        texts.append((i, " ".join(words)))
    return texts


@pytest.mark.parametrize("texts", [planted(1), planted(2), odd_texts()], ids=["one", "two", "odd"])
def test_spans_equal_brute_force(spark, texts):
    out = repeated_words(frame(spark, texts)).collect()
    assert {(r.id, tuple(r.spans)) for r in out} == brute_spans(texts)


@pytest.mark.parametrize(
    "text, spans, left",
    [
        ("a b c d", [0, 2], "c d"),
        ("a b c d", [1, 3], "a d"),
        ("a b. c d. e f", [2, 4], "a b. e f"),
        ("a b\nc d\ne f", [2, 4], "a b\ne f"),
        ("a b\nc d", [3, 4], "a b\nc"),
        ("a b\n\nc d", [1, 3], "a d"),
        ("a b", [0, 2], ""),
        ("é ñ x", [0, 1], "ñ x"),
    ],
)
def test_cut_texts(text, spans, left):
    assert without(text, np.array(spans))[0] == left


def test_blobs():
    arrays = [np.array(x, np.int64) for x in ([], [5, 7, 7, 2], [-(2**63), 2**63 - 1, 0, -1])]
    *back, data = _arrays(_blob(*arrays, data=b"text"))
    assert [a.tolist() for a in back] == [a.tolist() for a in arrays] and data.tobytes() == b"text"


def test_clashing_columns(spark):
    df = frame(spark, planted(1))
    names = ["removed_lines", "_id", "_hash", "removed_words", "_d", "_h", "doc_key", "cut_id", "hash_key", "cut_hash"]
    clash = dedup_lines(df.withColumns({c: F.lit("mine") for c in names}))
    assert clash.columns == [
        *df.columns, *(c for c in names if not c.startswith("removed")), "removed_lines", "removed_words",
    ]
    assert {r[0] for r in clash.select("_id").collect()} == {"mine"}
    plain = {(r.doc_id, r.text) for r in dedup_lines(df).collect()}
    assert {(r.doc_id, r.text) for r in clash.collect()} == plain


def test_query_on_small_tables(spark, tmp_path):
    texts = planted(3)
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: spans for i, spans in brute_spans(texts)}
    got = {r.doc_id: r for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        spans = np.array(want.get(i, []), int)
        assert got[i].n_removed_words == int((spans[1::2] - spans[::2]).sum())
        assert got[i].text == (without(t, spans)[0] if len(spans) else t)
