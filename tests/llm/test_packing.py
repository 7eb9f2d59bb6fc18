import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexicrate.llm.packing import ByteEncoder, cut_pieces, pack, plan, tokenize

from .helpers import frame, odd_texts, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def exact():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return ByteEncoder(PATH)


def test_encoder_equals_the_library(encoder, exact):
    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet="ab é漢\n\t '<|endoftext|>1,.\x1c\u00a0", max_size=40))
    def check(text):
        assert np.frombuffer(encoder(text), "<u4").tolist() == exact(text)

    check()
    for text in ["", "<|endoftext|>", "a<|endoftext|> b", "I'll  'tis\r\n x"]:
        assert np.frombuffer(encoder(text), "<u4").tolist() == exact(text)


def test_only_the_first_piece_is_short():
    assert cut_pieces(1, 4) == [(0, 1)]
    assert cut_pieces(4, 4) == [(0, 4)]
    assert cut_pieces(9, 4) == [(0, 1), (1, 4), (5, 4)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=40))
def test_plan_places_every_piece_once(hist):
    runs, n = plan(hist, 64, groups=12)
    used = defaultdict(int)
    ends = defaultdict(list)
    placed = defaultdict(int)
    for length, _, count, first, each, offset in runs.tolist():
        placed[length] += count
        for k in range(count):
            s, o = first + k // each, offset + k % each * length
            ends[s].append((o, o + length))
            used[s] += length
    assert placed == hist
    assert set(ends) == set(range(n))
    for spans in ends.values():
        at = 0
        for a, b in sorted(spans):
            assert a == at
            at = b
        assert at <= 64
    # no plan has fewer: by volume, and as no two pieces over half go together
    least = max(-(-sum(k * v for k, v in hist.items()) // 64), sum(v for k, v in hist.items() if k > 32))
    assert n <= least * 1.5 + 3


def test_many_pieces_fill_sequences_well():
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(rng.integers(1, 1025, 20_000), return_counts=True)
    hist = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    _, n = plan(hist)
    assert n <= 1.01 * sum(k * v for k, v in hist.items()) / 1024


def test_pack_round_trip(spark, exact):
    texts = odd_texts() + [(100 + i, prose(i, 5 + 40 * i)) for i in range(30)]
    out = pack(frame(spark, texts), PATH, rows_per_salt=3).collect()
    want = defaultdict(list)
    for doc_id, text in texts:
        ids = exact(text or "") + [2]
        for k, (start, length) in enumerate(cut_pieces(len(ids), 1024)):
            part = np.array(ids[start : start + length], "<u4").tobytes()
            want[doc_id].append((k, start, length, zlib.crc32(part)))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_ids_come_along_on_request(spark, exact):
    row = tokenize(frame(spark, [(1, "Ab cd.")]), PATH, with_ids=True).first()
    assert row.ids == exact("Ab cd.") + [2]


def test_empty_table(spark):
    assert pack(frame(spark, []), PATH).count() == 0
