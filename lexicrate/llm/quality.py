"""Operator 7: quality rules on repetition, by suffix arrays.

Each text's words form a suffix array, built by prefix doubling for many texts
at once: suffixes are ranked by their first 1, 2, 4 ... words until all differ.
The longest common prefix of neighbours in the array is searched by halves, on
hashes of word runs that follow from prefix sums.  A word sequence is repeated where a neighbour shares it; the spans of all maximal
repeats of ``min_words`` words or more are united, and a text fails when they
cover too large a share of it or when the longest of them is too long.

All texts of a chunk are worked on together in numpy, so there is no Python
loop over words, and memory is a few arrays of the chunk's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import Words
from .shared import TextChunks, WordHasher, byte_class, documents

SYMBOLS = byte_class(b"#*$%&|<>")
#: The verdict: repeats of so many words count; the share of words they may
#: cover; the words of the longest one.
MIN_WORDS, MAX_SHARE, MAX_REPEAT = 5, 0.5, 40
CHUNK = 1 << 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, repeat_words long, "
    "repeat_share double, longest_repeat long"
)


def suffix_ranks(row: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by (row, first 1, 2, 4 ... words), until they differ.

    A suffix never runs past its row.  Only suffixes that still tie are sorted
    again.
    """
    n = len(words)
    order = np.lexsort((words, row))
    new = np.ones(n, bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (words[order][1:] != words[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = 1
    end = np.append(np.searchsorted(row, np.arange(row[-1] + 1), side="right"), n) if n else None
    while n:
        counts = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(counts[rank] > 1)
        if not len(tied):
            break
        then = tied + width
        follow = np.where(then < end[row[tied]], rank[np.minimum(then, n - 1)], -1)
        order = np.lexsort((follow, rank[tied]))
        sorted_, first = tied[order], rank[tied][order]
        f = follow[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (f[1:] != f[:-1])
        start = np.ones(len(order), bool)
        start[1:] = first[1:] != first[:-1]
        # places within a tie: the tie's rank plus how many come before
        at = np.arange(len(order))
        group = np.maximum.accumulate(np.where(start, at, 0))
        fresh = np.maximum.accumulate(np.where(new, at, 0))
        rank[sorted_] = first + (fresh - group)
        width *= 2
    return rank


def common_prefixes(row: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every suffix, the longest prefix that another suffix of its row has too."""
    n = len(row)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    order = np.argsort(rank, kind="stable")
    pairs = np.flatnonzero(row[order[:-1]] == row[order[1:]])
    a, b = order[pairs], order[pairs + 1]
    end = np.searchsorted(row, np.arange(row[-1] + 1), side="right")
    runs = Words(np.bincount(row, minlength=row[-1] + 1), words)
    low = np.zeros(len(pairs), np.int64)
    high = end[row[a]] - np.maximum(a, b)  # the shorter suffix bounds what they share
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = runs.hash(a, middle) == runs.hash(b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    np.maximum.at(best, a, low)
    np.maximum.at(best, b, low)
    return best


def covered(row: np.ndarray, best: np.ndarray, least: int, length: np.ndarray | None = None):
    """Words that lie in a repeat of ``least`` words or more, as a mask."""
    reach = np.where(best >= least, best if length is None else length, 0)
    until = np.maximum.accumulate(np.arange(len(row)) + reach)
    return until > np.arange(len(row))


def measure(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher, min_words: int) -> dict:
    """All counts of the rows of a chunk."""
    n = len(offsets) - 1
    starts, ends, n_words = hasher.spans(data, offsets)
    words = hasher.hashes(data, starts, ends)
    row = np.repeat(np.arange(n), n_words)
    of = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
    word_chars = of(hasher.word_bytes[data] & ((data & 0xC0) != 0x80))
    symbols = of(SYMBOLS[data])

    best = common_prefixes(row, words, suffix_ranks(row, words))
    by_row = lambda mask: np.bincount(row[mask], minlength=n)
    repeat3 = by_row(covered(row, best, 3, np.full(len(row), 3)))
    spans = by_row(covered(row, best, min_words))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, best)

    # lines: bytes between line breaks, hashed as words are
    is_break = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:][is_break] = True
    cuts = np.flatnonzero(edge)
    first, last = cuts[:-1], cuts[1:]
    last = last - is_break[last - 1] if len(last) else last
    line_row = np.searchsorted(offsets, first, side="right") - 1
    seen = np.append(0, np.cumsum(hasher.word_bytes[data]))
    full = seen[last] > seen[first]
    first, last, line_row = first[full], last[full], line_row[full]
    line = exact_lines().hashes(data, first, last)
    order = np.lexsort((line, line_row))
    again = np.zeros(len(order), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (
        line_row[order][1:] == line_row[order][:-1]
    )
    dup_lines = np.bincount(line_row[order][again], minlength=n)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols,
        "n_dup_lines": dup_lines, "n_repeat_words": repeat3, "repeat_words": spans,
        "longest_repeat": longest,
    }


_EXACT: list[WordHasher] = []


def exact_lines() -> WordHasher:
    """The hasher for lines, which tell capitals apart."""
    if not _EXACT:
        _EXACT.append(WordHasher(lower=False))
    return _EXACT[0]


def quality_rules(
    df: DataFrame,
    *,
    min_words: int = MIN_WORDS,
    max_share: float = MAX_SHARE,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """Counts and verdict for every whole text of ``df(doc_id, text)``.

    Words stand between ASCII white space and tell capitals apart.  Returns
    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word, equal to an earlier line of the text), n_repeat_words (words in
    three-word windows found twice or more), base_failed (under 50 words, or
    more than half of the words repeat), repeat_words and repeat_share (union of
    repeats of ``min_words`` or more), longest_repeat, and kept: not base_failed
    and within ``max_share`` and ``max_repeat``.  Null or empty text has no
    words and fails.  Rows stay one to one; other columns are not read.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher = WordHasher(lower=False)
        for batch in batches:
            for lo, hi, data, offsets in TextChunks(batch.column(1), CHUNK):
                m = measure(data, offsets, hasher, min_words)
                n = m["n_words"]
                failed = (n < 50) | (100 * m["n_repeat_words"] > 50 * n)
                share = m["repeat_words"] / np.maximum(n, 1)
                kept = ~failed & (share <= max_share) & (m["longest_repeat"] <= max_repeat)
                columns = [m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        *[pa.array(c.astype(np.int64)) for c in columns],
                        pa.array(failed), pa.array(kept),
                        pa.array(m["repeat_words"].astype(np.int64)),
                        pa.array(share), pa.array(m["longest_repeat"].astype(np.int64)),
                    ],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
