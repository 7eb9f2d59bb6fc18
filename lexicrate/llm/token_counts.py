"""Operator 6: token counts by prefix dynamic programming.

For byte-pair encoding, the tokens of a prefix are the tokens of a shorter prefix
plus one last token: the one that ends here and that merging would keep apart
from the token before it.  So one pass keeps, for every prefix of a word, its
last token and its count.  From this table follow the exact count of every
prefix of a text, the longest prefix within a budget, and the count of the whole
text, all without encoding again.

White space separates pre-tokens and is dropped by this kind of tokenizer, so a
text's prefix counts are sums over its parts between white space.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

LIMIT = 2048
CACHE_PARTS = 250_000
CACHE_STATES = 150_000
CACHE_PAIRS = 500_000
LONG_WORD = 200

#: Unicode White_Space; unlike ``str.split()`` without U+001C to U+001F.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class PrefixCounter:
    """Exact token counts of all prefixes of a text, for a word-end BPE file.

    The file (``tokenizers`` JSON) must normalise by NFC and lower-casing, drop
    white space, split by a regular expression and mark word ends by a suffix.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = set(model["vocab"])
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.shown = {b: chr(b) for b in visible} | {
            b: chr(256 + i) for i, b in enumerate(hidden)
        }
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = regex.compile(split["pattern"]["Regex"])
        self.words, self.finditer = pattern.findall, pattern.finditer
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = set(special)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.kept_apart: dict[tuple[str, str], bool] = {}
        self.states: dict[str, tuple[str, int]] = {}
        self.counts: dict[str, int] = {}
        self.parts = _Parts(self)

    # -- one word ------------------------------------------------------------

    def _merge(self, text: str) -> list[str]:
        """Byte-pair merging itself; only run on pairs of tokens, and remembered."""
        word = text.removesuffix(self.end)
        symbols = list(word)
        if word is not text and word != text:
            symbols[-1] += self.end
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def _apart(self, before: str, token: str) -> bool:
        key = (before, token)
        out = self.kept_apart.get(key)
        if out is None:
            out = self._merge(before + token) == ([before, token] if before else [token])
            if len(self.kept_apart) >= CACHE_PAIRS:
                self.kept_apart.clear()
            self.kept_apart[key] = out
        return out

    def _state(self, prefix: str, suffix: str = "") -> tuple[str, int]:
        """Last token and count of ``prefix + suffix``.

        Only the shorter prefixes that this one depends on are worked out; each
        is remembered, so words that start alike share them.
        """
        if not suffix and (known := self.states.get(prefix)):
            return known
        vocab, n = self.vocab, len(prefix)
        for k in range(max(0, n - self.longest), n):
            token = prefix[k:] + suffix
            if token in vocab:
                before = self._state(prefix[:k]) if k else ("", 0)
                if self._apart(before[0], token):
                    state = (token, before[1] + 1)
                    break
        else:  # bytes without a token of their own: as the merges leave them
            left = self._merge(prefix + suffix)
            state = (left[-1], len(left))
        if not suffix and len(self.states) < CACHE_STATES:
            self.states[prefix] = state
        return state

    def word_count(self, word: str) -> int:
        """Tokens of one pre-token, from the states of its prefixes."""
        known = self.counts.get(word)
        if known is not None:
            return known
        if word.isascii() and word.isprintable():
            shown = word
        else:
            shown = "".join([self.shown[b] for b in word.encode()])
        if len(shown) > LONG_WORD:  # from the front, so that recursion stays shallow
            return self._long(shown)
        n = self._state(shown, self.end)[1]
        if len(self.counts) < CACHE_PARTS:
            self.counts[word] = n
        return n

    def _table(self, word: str) -> list[tuple[str, int]]:
        """Last token and count of every prefix of a word that goes on, filled from its front."""
        states, vocab, longest, apart = [("", 0)], self.vocab, self.longest, self._apart
        for i in range(1, len(word) + 1):
            for k in range(max(0, i - longest), i):
                token = word[k:i]
                if token in vocab and apart(states[k][0], token):
                    states.append((token, states[k][1] + 1))
                    break
            else:
                raise ValueError("a byte of this word has no token")
        return states

    def _ended(self, word: str, i: int, states: list[tuple[str, int]]) -> int:
        """Tokens of ``word[:i]`` as a word of its own, from the table of the states before."""
        for k in range(max(0, i - self.longest), i):
            token = word[k:i] + self.end
            if token in self.vocab and self._apart(states[k][0], token):
                return states[k][1] + 1
        raise ValueError("a byte of this word has no token")

    def _long(self, word: str) -> int:
        """The count of a very long word, without recursion."""
        return self._ended(word, len(word), self._table(word[:-1]))

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of ``word[:1]``, ``word[:2]`` ... as words of their own."""
        pieces = ["".join([self.shown[b] for b in c.encode()]) for c in word]
        shown = "".join(pieces)
        states, out, at = self._table(shown), [], 0
        for piece in pieces:
            at += len(piece)
            out.append(self._ended(shown, at, states))
        return out

    # -- texts ---------------------------------------------------------------

    def part_count(self, part: str) -> int:
        """Tokens of a part without white space."""
        if "<|" in part:
            return sum(
                1 if x in self.special else self._plain(x) for x in self.cut.split(part) if x
            )
        return self._plain(part)

    def _plain(self, part: str) -> int:
        if part.isascii():
            part = part.lower()
        else:
            part = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
        return sum(map(self.word_count, self.words(part)))

    def split(self, text: str) -> list[str]:
        if any(c in text for c in _SEPARATORS):
            return [x for x in _WHITE.split(text) if x]
        return text.split()

    def count(self, text: str) -> int:
        return sum(map(self.parts.__getitem__, self.split(text)))

    def part_ends(self, text: str) -> tuple[list[int], list[int]]:
        """Code point ends of the parts, and the exact count of the prefix up to each."""
        ends, counts, at, total = [], [], 0, 0
        for part in self.split(text):
            at = text.index(part, at) + len(part)
            total += self.parts[part]
            ends.append(at)
            counts.append(total)
        return ends, counts

    def plain_prefixes(self, text: str) -> list[int]:
        """Tokens of ``text[:i]`` for every i, for a normalized text without special tokens.

        Splitting goes from the left, so the words before one are the same for
        every prefix that ends in it.
        """
        out, before = [0] * (len(text) + 1), 0
        for m in self.finditer(text):
            a, b = m.span()
            word = m.group()
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a contraction: two or three characters
                inner = [sum(map(self.word_count, self.words(word[:i]))) for i in range(1, b - a + 1)]
            else:
                inner = self.word_prefixes(word)
            out[a + 1 : b + 1] = [before + n for n in inner]
            before = out[b]
        return out

    def part_prefixes(self, part: str) -> list[int]:
        """Tokens of ``part[:j]`` for every j, for a part without white space."""
        out, before, seg = [0], 0, ""
        pieces = self.cut.split(part) if "<|" in part else [part]
        for piece in pieces:
            if piece in self.special:
                # inside a special token its beginning is plain text behind the segment
                inner = self._segment(seg + piece)[len(seg) + 1 :]
                out += [before + n for n in inner[:-1]]
                before += (self._segment(seg)[-1] if seg else 0) + 1
                out.append(before)
                seg = ""
            elif piece:
                out += [before + n for n in self._segment(piece)[1:]]
                seg = piece
        return out

    def _segment(self, part: str) -> list[int]:
        """Tokens of every prefix of a part in which nothing is special."""
        if part.isascii():
            return self.plain_prefixes(part.lower())
        # clusters that normalization may change as a whole, each apart from its neighbours
        clusters: list[str] = []
        if unicodedata.is_normalized("NFC", part):
            clusters = list(part)
        else:
            nfc = unicodedata.normalize
            for c in part:
                last = clusters[-1] if clusters else ""
                if last and (unicodedata.combining(c) or nfc("NFC", last + c) != nfc("NFC", last) + nfc("NFC", c)):
                    clusters[-1] += c
                else:
                    clusters.append(c)
        lowered = ["".join([c.lower() for c in unicodedata.normalize("NFC", x)]) for x in clusters]
        whole, at, out, done = "".join(lowered), 0, [0], 0
        counts = self.plain_prefixes(whole)
        for cluster, low in zip(clusters, lowered, strict=True):
            # within a cluster, the prefixes are other texts; there are few of them
            out += [self._plain(part[: done + i]) for i in range(1, len(cluster))]
            at, done = at + len(low), done + len(cluster)
            out.append(counts[at])
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """The exact count of ``text[:i]`` for every i from 0 to the length."""
        out, before = [0] * (len(text) + 1), 0
        at = 0
        for part in self.split(text):
            start = text.index(part, at)
            out[at + 1 : start + 1] = [before] * (start - at)
            at = start + len(part)
            out[start + 1 : at + 1] = [before + n for n in self.part_prefixes(part)[1:]]
            before = out[at]
        out[at + 1 :] = [before] * (len(text) - at)
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """The most code points of ``text`` that make at most ``budget`` tokens.

        Counts up to the ends of parts never fall, so one part holds the answer;
        its own table of prefixes gives it.
        """
        at, before = 0, 0
        for part in self.split(text):
            start = text.index(part, at)
            n = self.parts[part]
            if before + n > budget:
                counts = self.part_prefixes(part)
                return start + max(j for j, m in enumerate(counts) if j == 0 or before + m <= budget)
            at, before = start + len(part), before + n
        return len(text)


class _Parts(dict):
    """Part -> count.  When it is full, new parts aren't kept."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, part: str) -> int:
        n = self.counter.part_count(part)
        if len(self) < CACHE_PARTS:
            self[part] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(
    df: DataFrame, path: str, *, limit: int = LIMIT, with_prefixes: bool = False,
    with_budget: bool = False,
) -> DataFrame:
    """Tokens of every whole text of ``df(doc_id, text)``.

    Returns doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than
    ``limit``); with ``with_prefixes`` also prefix_ends and prefix_tokens, the
    end of every white-space separated part (code points) and the exact count
    of the text up to there; with ``with_budget`` also budget_chars, the code
    points of the longest prefix of at most ``limit`` tokens.  Null or empty text counts 0.  Rows stay one to
    one, repeated and null ids included; other columns of ``df`` are not read.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        c = counter(path)
        for batch in batches:
            bytes_, tokens, ends, counts, fits = [], [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                bytes_.append(len(text.encode()) if not text.isascii() else len(text))
                if with_prefixes:
                    e, n = c.part_ends(text)
                    ends.append(e)
                    counts.append(n)
                    tokens.append(n[-1] if n else 0)
                else:
                    tokens.append(c.count(text))
                if with_budget:
                    whole = tokens[-1] <= limit
                    fits.append(len(text) if whole else c.longest_prefix(text, limit))
            arrays = [
                batch.column(0),
                pa.array(bytes_, pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if with_prefixes:
                arrays += [pa.array(x, pa.list_(pa.int32())) for x in (ends, counts)]
                names += ["prefix_ends", "prefix_tokens"]
            if with_budget:
                arrays.append(pa.array(fits, pa.int64()))
                names.append("budget_chars")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    if with_prefixes:
        schema += ", prefix_ends array<int>, prefix_tokens array<int>"
    if with_budget:
        schema += ", budget_chars long"
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def truncate_to_budget(df: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id and the longest prefix of each text with at most ``budget`` tokens.

    Null counts as empty.  Rows stay one to one; other columns are not read.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        c = counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            cut = [t[: c.longest_prefix(t, budget)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cut, pa.string())], ["doc_id", "text"]
            )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, text string"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return count_tokens(documents(spark, sf_dir), path, with_budget=True)
