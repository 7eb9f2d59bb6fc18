"""Text analysis: from a text column to an array of tokens.

Everything that Catalyst can express stays an expression; the steps from the
first duplicate cap or stemmer on run in Arrow batches behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    DuplicateCap,
    Length,
    Lowercase,
    Ngram,
    NoOp,
    Regex,
    Setting,
    Stopwords,
    TokenizerConfig,
    UnicodeWord,
    Whitespace,
)
from ..errors import TokenizerError
from .stemming import stemmer_for
from .stopwords import stopwords

#: Words with inner apostrophes, full stops and colons, numbers with inner
#: separators, joined by underscores; a token must hold a letter or digit.
UNICODE_WORD = r"(?:[\p{L}\p{M}](?:['’.:·][\p{L}\p{M}])*|\p{N}(?:['’.,;]\p{N})*|_)+"

SPACES = r"(?U)\s+"
#: Tokens that Python looks at together.
CHUNK_TOKENS = 1 << 19


def _ngrams(parts: Column, n: int, glue: str) -> Column:
    """Runs of n parts, zipped from shifted copies: no lambda looks at ``parts`` itself,
    which would work it out anew for every run."""
    many = F.greatest(F.size(parts) - (n - 1), F.lit(0))
    grams = F.slice(parts, F.lit(1), many)
    for shift in range(1, n):
        grams = F.zip_with(
            grams, F.slice(parts, F.lit(shift + 1), many), lambda a, b: F.concat(a, F.lit(glue), b)
        )
    return grams


def _windows(parts: Column, spec: Ngram, glue: str) -> Column:
    """All n-grams, by n and then by place; sizes that don't fit give none."""
    sizes = range(max(spec.min_n, 1), spec.max_n + 1)
    grams = [_ngrams(parts, n, glue) for n in sizes]
    return F.concat(*grams) if grams else F.array().cast("array<string>")


def _words(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(UNICODE_WORD), F.lit(0))
    return F.filter(found, lambda w: F.rlike(w, F.lit(r"[\p{L}\p{N}]")))


def _parts(text: Column, kind: Ngram) -> Column:
    """What n-grams are made of: words, or characters as readers see them."""
    if kind.mode == "Word":
        return _words(text)
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def _glue(kind: Ngram) -> str:
    return " " if kind.mode == "Word" else ""


def base_tokens(text: Column, kind: Setting) -> Column:
    """The tokens of a text before any filter."""
    if isinstance(kind, Whitespace):
        return F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    if isinstance(kind, Regex):
        try:
            re.compile(re.sub(r"\\[pP]\{\w+\}", r"\\w", kind.pattern))
        except re.error as e:
            raise TokenizerError(f"invalid pattern {kind.pattern!r}: {e}") from e
        return F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if isinstance(kind, UnicodeWord):
        return _words(text)
    if isinstance(kind, Ngram):
        return _windows(_parts(text, kind), kind, _glue(kind))
    raise TokenizerError(f"not a tokenizer: {kind}")


def _test(word: Column, step: Setting) -> Column | None:
    """Whether a filter keeps a word; None where it keeps all."""
    if isinstance(step, Stopwords):
        words = stopwords(step.lang)
        return ~word.isin(*words) if words else None
    if isinstance(step, Length):
        return F.char_length(word).between(step.min_len, step.max_len)
    raise TokenizerError(f"not a filter: {step}")


def _tested(tokens: Column, steps: list[Setting], filled: bool) -> Column:
    """The tokens that pass all tests, in one pass; ``filled`` drops empty ones too."""

    def keep(word: Column) -> Column:
        tests = [word != ""] if filled else []
        tests += [t for t in (_test(word, s) for s in steps) if t is not None]
        return reduce(lambda x, y: x & y, tests, F.lit(True))

    return F.filter(tokens, keep) if filled or steps else tokens


def filtered_tokens(text: Column, kind: Setting, steps: list[Setting], tokens: Column | None = None) -> Column:
    """The tokens behind filters that need no counting; tests in a row take one pass.

    Words between spaces are the same if the whole text is lower-cased first: a
    space is no part of what the case of a letter depends on.
    """
    spaced, steps = isinstance(kind, Whitespace), list(steps)
    if spaced and steps and isinstance(steps[0], Lowercase):
        text, steps = F.lower(text), steps[1:]
    if tokens is None:
        tokens = F.split(text, SPACES, -1) if spaced else base_tokens(text, kind)
    filled, tests = spaced, []
    for step in steps:
        if isinstance(step, Lowercase):
            tokens = F.transform(_tested(tokens, tests, filled), F.lower)
            filled, tests = False, []
        else:
            tests.append(step)
    return _tested(tokens, tests, filled)


def native_tokens(text: Column, config: TokenizerConfig) -> Column:
    """The tokens as one expression, for a config without caps and stemming."""
    steps = [*config.filters, Length(config.min_token_len, config.max_token_len)]
    if not isinstance(config.stemmer, NoOp) or any(isinstance(s, DuplicateCap) for s in steps):
        raise TokenizerError("duplicate caps and stemmers are not expressions; use analyze()")
    return filtered_tokens(F.coalesce(text, F.lit("")), config.tokenizer, steps)


def token_chunks(batch, at: int) -> Iterator:
    """(rows, tokens in one array, row of each token), at most about CHUNK_TOKENS tokens at a time."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(ends, before + CHUNK_TOKENS, "right")), lo + 1)
        rows = batch.slice(lo, hi - lo)
        yield rows, pc.list_flatten(rows.column(at)), np.repeat(np.arange(hi - lo), sizes[lo:hi])
        lo = hi


def _rest(steps: list[Setting], stem):
    """The steps that run in Python, on an array of tokens and the row of each.

    Words are looked at once a chunk; the tokens follow by number.
    """
    memo: dict[str, str] = {}

    def stemmed(word: str) -> str:
        out = memo.get(word)
        if out is None:
            out = stem(word)
            if len(memo) < 200_000:
                memo[word] = out
        return out

    def run(tokens, row):
        import numpy as np
        import pyarrow as pa

        def words(tokens):
            found = tokens.dictionary_encode()
            return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)

        def mapped(tokens, change):
            names, at = words(tokens)
            return pa.array([change(w) for w in names], pa.string()).take(pa.array(at))

        def kept(tokens, row, keep):
            return tokens.filter(pa.array(keep)), row[keep]

        for step in steps:
            if isinstance(step, Lowercase):
                tokens = mapped(tokens, str.lower)
                continue
            names, at = words(tokens)
            if isinstance(step, DuplicateCap):
                key = row.astype(np.int64) * max(len(names), 1) + at
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                nth = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key)))
                keep = np.zeros(len(key), bool)
                keep[order[nth < step.max_per_doc]] = True
            else:
                if isinstance(step, Stopwords):
                    gone = set(stopwords(step.lang))
                    good = [w not in gone for w in names]
                else:
                    good = [step.min_len <= len(w) <= step.max_len for w in names]
                keep = np.array(good, bool)[at]
            tokens, row = kept(tokens, row, keep)
        return (mapped(tokens, stemmed) if stem else tokens), row

    return run


def stemmed_terms(counts: DataFrame, stemmer: Setting) -> DataFrame:
    """``counts(term, n)`` of words as counts of their stems: each word is stemmed once a task."""
    stem = stemmer_for(stemmer)
    if stem is None:
        return counts

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            stems = pa.array([stem(w) for w in batch.column("term").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([stems, batch.column("n")], ["term", "n"])

    return counts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


#: Texts of which each code point is a character as readers see it: nothing that combines, no CR LF.
PLAIN = (
    r"[\x{0}-\x{2FF}\x{370}-\x{482}\x{48A}-\x{58F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}"
    r"\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}]"
)
NOT_PLAIN = "[^" + PLAIN[1:]


def _counted(codes, row, n: int, kinds: int):
    """(code of each place, times) of all runs of n codes within a row."""
    import numpy as np

    many = len(codes) - n + 1
    if many <= 0:
        return [codes[:0]] * n, codes[:0]
    within = row[:many] == row[n - 1 :]
    key = codes[:many].copy()
    size = kinds
    back = []
    for i in range(1, n):
        if size > 2**62 // kinds:  # number the runs so far anew
            seen, key = np.unique(key, return_inverse=True)
            back.append((i, seen))
            size = len(seen)
        key, size = key * kinds + codes[i : many + i], size * kinds
    key = key[within]
    if size <= 1 << 22:
        times = np.bincount(key, minlength=1)
        key = np.flatnonzero(times)
        times = times[key]
    else:
        key, times = np.unique(key, return_counts=True)
    parts = []
    for i in range(n - 1, 0, -1):
        key, last = np.divmod(key, kinds)
        parts.append(last)
        if back and back[-1][0] == i:
            key = back.pop()[1][key]
    return [key, *parts[::-1]], times


def ngram_counts(df: DataFrame, config: TokenizerConfig, text: str = "text") -> DataFrame | None:
    """(term, n): the n-grams of all texts, counted chunk by chunk before they are written out.

    None for settings whose filters ask for whole n-grams: anything but length
    bounds, and the lower-casing of words, which no neighbour changes.
    """
    kind = config.tokenizer
    if not isinstance(kind, Ngram) or not isinstance(config.stemmer, NoOp):
        return None
    bounds = [Length(config.min_token_len, config.max_token_len)]
    bounds += [s for s in config.filters if isinstance(s, Length)]
    others = [s for s in config.filters if not isinstance(s, Length)]
    worded = kind.mode == "Word"
    if any(not worded or not isinstance(s, Lowercase) for s in others) or (others and config.filters[0] not in others):
        return None
    whole = F.coalesce(F.col(text), F.lit(""))
    if worded:
        words = F.transform(_words(whole), F.lower) if others else _words(whole)
        found = df.select(F.lit("").alias("plain"), words.alias("parts"))
    else:
        seldom = F.rlike(whole, F.lit(r"[\x{300}-\x{10FFFF}]")) & F.rlike(whole, F.lit(NOT_PLAIN))
        plain = ~(F.contains(whole, F.lit("\r\n")) | seldom)
        found = df.select(
            F.when(plain, whole).otherwise("").alias("plain"),
            F.when(~plain, _parts(whole, kind)).otherwise(F.array().cast("array<string>")).alias("parts"),
        )
    glue, sizes = _glue(kind), range(max(kind.min_n, 1), kind.max_n + 1)

    def letters(batch) -> Iterator:
        """(names, code of each character, its row) of plain texts."""
        import numpy as np
        import pyarrow as pa

        texts, lo = batch.column(0).to_pylist(), 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 2 * CHUNK_TOKENS):
                size += len(texts[hi])
                hi += 1
            points = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le"), np.uint32)
            there = np.zeros(0x110000, bool)
            there[points] = True
            used = np.flatnonzero(there)
            code = np.zeros(0x110000, np.int64)
            code[used] = np.arange(len(used))
            yield pa.array([chr(c) for c in used], pa.string()), code[points], np.repeat(np.arange(hi - lo), [len(t) for t in texts[lo:hi]])
            lo = hi

    def chunks(batch) -> Iterator:
        import numpy as np

        if not worded:
            yield from letters(batch)
        for _, tokens, row in token_chunks(batch, 1):
            words = tokens.dictionary_encode()
            yield words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), row

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for names, codes, row in chunks(batch):
                for n in sizes:
                    parts, times = _counted(codes, row, n, max(len(names), 1))
                    if not len(times):
                        continue
                    terms = pc.binary_join_element_wise(*[names.take(pa.array(p)) for p in parts], glue)
                    out = pa.RecordBatch.from_arrays([terms, pa.array(times)], ["term", "n"])
                    length = pc.utf8_length(terms)
                    for b in bounds:
                        fits = pc.and_(pc.greater_equal(length, b.min_len), pc.less_equal(length, b.max_len))
                        out, length = out.filter(fits), length.filter(fits)
                    yield out

    return found.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def analyze(
    df: DataFrame, config: TokenizerConfig = TokenizerConfig(), text: str = "text", out: str = "tokens"
) -> DataFrame:
    """``df`` with an array of tokens; null text has none.

    Order of steps: tokenizer, filters as listed, token length bounds, stemmer.
    """
    steps = [*config.filters, Length(config.min_token_len, config.max_token_len)]
    cut = next((i for i, s in enumerate(steps) if isinstance(s, DuplicateCap)), len(steps))
    whole = F.coalesce(F.col(text), F.lit(""))
    if isinstance(config.tokenizer, Ngram):
        names = df.columns
        df = df.withColumn("_parts", _parts(whole, config.tokenizer))
        tokens = _windows(F.col("_parts"), config.tokenizer, _glue(config.tokenizer))
    else:
        names, tokens = df.columns, None
    tokens = filtered_tokens(whole, config.tokenizer, steps[:cut], tokens)
    stem = stemmer_for(config.stemmer)
    df = df.select(*[c for c in names if c != out], tokens.alias(out))
    if cut == len(steps) and stem is None:
        return df
    at = df.columns.index(out)
    later = steps[cut:]

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        work = _rest(later, stem)
        for batch in batches:
            for rows, tokens, row in token_chunks(batch, at):
                tokens, row = work(tokens, row)
                ends = np.cumsum(np.bincount(row, minlength=len(rows)), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), tokens)
                yield rows.set_column(at, out, lists)

    fields = [
        T.StructField(out, T.ArrayType(T.StringType())) if f.name == out else f for f in df.schema
    ]
    return df.mapInArrow(run, T.StructType(fields))
