import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexicrate.llm import token_counts
from lexicrate.llm.token_counts import PrefixCounter, count_tokens, op6_token_counts, truncate_to_budget

from .helpers import frame, odd_texts, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def exact():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


def test_counts_equal_the_library(counter, exact):
    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="abthes éÉΣİ漢\n '\x1c<|startoftext|>12!.́", max_size=60))
    def check(text):
        assert counter.count(text) == exact(text)

    check()


def test_every_prefix_is_exact(counter, exact):
    for text in [prose(3, 25), "It's we'RE <|endoftext|>x ΣΑΣ ﬁ é 漢字 ... !!'s", "", "  a  "]:
        assert counter.prefix_counts(text) == [exact(text[:i]) for i in range(len(text) + 1)]
        ends, counts = counter.part_ends(text)
        assert counts == [exact(text[:e]) for e in ends]


def test_every_prefix_of_odd_texts_is_exact(counter, exact):
    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet="abthesr éÉΣİ漢\n '\x1c<|startoftext|>12!.\u0301가ㄱ\u1161\u11a8", max_size=40))
    def check(text):
        assert counter.prefix_counts(text) == [exact(text[:i]) for i in range(len(text) + 1)]

    check()


def test_budget_within_a_megabyte_without_spaces(counter, exact):
    text = "".join(prose(5, 2000).split())
    text = (text * (1 + 1_000_000 // len(text)))[:1_000_000]
    began = time.time()
    n = counter.longest_prefix(text, 100_000)
    assert time.time() - began < 60
    assert exact(text[:n]) <= 100_000 < exact(text[: n + 40])
    assert counter.count(text) == exact(text)


def test_memory_of_pairs_is_bounded(monkeypatch, exact):
    monkeypatch.setattr(token_counts, "CACHE_PAIRS", 10)
    small = PrefixCounter(PATH)
    assert small.count(prose(6, 100)) == exact(prose(6, 100))
    assert len(small.kept_apart) <= 10


def test_query_on_small_tables(spark, tmp_path, exact):
    texts = [*odd_texts(), (20, prose(7, 3000))]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_token_counts(spark, str(tmp_path)).collect()
    want = sorted((repr(i), len((t or "").encode()), exact(t or ""), exact(t or "") > 2048) for i, t in texts)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    long = next(r for r in got if r.doc_id == 20)
    assert exact(texts[-1][1][: long.budget_chars]) <= 2048 < exact(texts[-1][1][: long.budget_chars + 1])


def test_long_words(counter, exact):
    for text in ["ab" * 500 + "c", "z" * 3000, "é" * 300]:
        assert counter.count(text) == exact(text)


def test_longest_prefix(counter, exact):
    text = prose(4, 30)
    for budget in (0, 1, 5, 17, 1000):
        n = counter.longest_prefix(text, budget)
        assert exact(text[:n]) <= budget
        assert all(exact(text[:j]) > budget for j in range(n + 1, len(text) + 1)) or n == len(text)


def test_table(spark, exact):
    texts = odd_texts()
    out = count_tokens(frame(spark, texts), PATH, limit=100, with_prefixes=True).collect()
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out)
    want = sorted((repr(i), len((t or "").encode()), exact(t or ""), exact(t or "") > 100) for i, t in texts)
    assert got == want
    assert all((r.prefix_tokens or [0])[-1] == r.n_tokens for r in out)
    assert count_tokens(frame(spark, []), PATH).count() == 0


def test_truncation(spark, exact):
    out = truncate_to_budget(frame(spark, odd_texts()), PATH, 10).collect()
    assert all(exact(r.text) <= 10 for r in out)
    assert len(out) == len(odd_texts())
