"""Operator 4: removal of repeated runs of words, by winnowing over word hashes.

A *gram* is ``gram_words`` words in a row, wherever they stand in a line.  A line
ends at a line break or behind a full stop, question or exclamation mark and a
space; lines only matter for what is left of the text around a cut.

1. *Winnowing*: of the grams within every ``run_words`` words, the one of least
   hash is a fingerprint.  Any two equal runs of ``run_words`` words or more
   therefore share one.
2. *Join*: fingerprints are counted over the corpus, in packed blocks dealt by
   hash.
3. *Extension*: around each fingerprint that occurs twice or more, to both sides
   and as far as fingerprints go on, all grams are looked up: does an earlier
   place (smaller doc_id, then position) hold the same words?
4. Words of grams that have an earlier place are removed.

An equal gram is compared with its first place only, and equality of grams is
transitive, so no pairs of a group are ever formed: a chunk of documents sends
each distinct gram once, with its first place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import (
    TextChunks, WordHasher, buckets_for, byte_class, chunk_numbers, documents, fresh_names, mix64,
    own_group, staged,
)

GRAM_WORDS, RUN_WORDS = 20, 40
NO_ID = (1 << 63) - 1
STOPS = byte_class(b".!?")
CHUNK, BUCKET_BYTES = 2 << 20, 4 << 20

BLOCKS = "bucket long, chunk long, keys binary, places binary, at binary, own binary"
CUTS = "id long, text_hash long, spans array<int>, words long"
_NAMES = ("bucket", "chunk", "keys", "places", "at", "own")


def lines_of(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher):
    """Lines with a word: byte starts, word counts, lines of each row, word hashes."""
    starts, ends, n_words = hasher.spans(data, offsets)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:] |= data == 10
    if n > 1:
        edge[2:] |= (data[1:] == 32) & STOPS[data[:-1]]
    cuts = np.flatnonzero(edge)
    line = np.searchsorted(cuts, starts, side="right") - 1  # of every word
    there, first = np.unique(line, return_index=True)
    counts = np.diff(np.append(first, len(starts)))
    row = np.repeat(np.arange(len(n_words)), n_words)[first]
    per_row = np.bincount(row, minlength=len(n_words)) if len(row) else np.zeros(len(n_words), int)
    return cuts[there], counts, per_row, hasher.hashes(data, starts, ends)


class _Powers:
    base = WordHasher.BASE | 1

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            with np.errstate(over="ignore"):
                self.up = np.full(n, self.base, np.uint64)
                self.down = np.full(n, pow(self.base, -1, 1 << 64), np.uint64)
                self.up[0] = self.down[0] = 1
                np.multiply.accumulate(self.up, out=self.up)
                np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_POWERS = _Powers()


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` neighbours of ``x``."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        x, have = op(x[:-have], x[have:]), 2 * have
    return op(x[:n], x[width - have : width - have + n])


class Words:
    """The words of a chunk: prefix sums of their hashes, from which any gram's hash follows."""

    def __init__(self, per_row: np.ndarray, hashes: np.ndarray):
        up, self.down = _POWERS.get(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])
        self.per_row = per_row
        self.row = np.repeat(np.arange(len(per_row)), per_row)
        self.row_end = np.cumsum(per_row)
        self.row_begin = self.row_end - per_row

    def starts(self, words: int) -> np.ndarray:
        """The words from which ``words`` words go on in their row."""
        n = np.arange(len(self.row))
        return n[n + words <= self.row_end[self.row]]

    def hash(self, first: np.ndarray, words: int) -> np.ndarray:
        """Hashes of the grams from ``first`` on."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[first + words] - self.sums[first]) * self.down[first])

    def fingerprints(self, gram: int, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the grams that winnowing keeps."""
        whole = self.starts(gram)
        value = np.full(len(self.row), np.uint64(2**64 - 1))
        value[whole] = self.hash(whole, gram)
        # a gram is kept if it is the least of any window that holds it: the greatest
        # least value among its windows is its own
        width = run - gram + 1
        least = np.zeros(len(self.row) + 2 * (width - 1), np.uint64)
        start = self.starts(run)
        least[width - 1 + start] = _sliding(np.minimum, value, width)[start]
        cover = _sliding(np.maximum, least, width)
        # a row shorter than a window is one
        short = np.flatnonzero((self.per_row >= gram) & (self.per_row < run))
        for r in short:
            a, b = self.row_begin[r], self.row_end[r]
            cover[a:b] = value[a:b].min()
        kept = whole[value[whole] == cover[whole]]
        return kept, value[kept]

    def grams(self, gram: int, zone: np.ndarray) -> np.ndarray:
        """First words of all grams that lie in the zone."""
        whole = self.starts(gram)
        outside = np.append(0, np.cumsum(~zone))
        return whole[outside[whole + gram] == outside[whole]]

    def zone(self, first: np.ndarray, gram: int, reach: int) -> np.ndarray:
        """Words within ``reach`` words of the given grams, in their row."""
        row = self.row[first]
        a = np.maximum(first - reach, self.row_begin[row])
        b = np.minimum(first + gram + reach, self.row_end[row])
        return _marked(a, b, len(self.row))


def _marked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any of the ranges ``a..b``."""
    mark = np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)
    return np.cumsum(mark[:n]) > 0


LEVEL = 3


@cache
def _zstd():
    """One compressor and one decompressor for all blobs of a process."""
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def _blob(*arrays: np.ndarray, data: bytes = b"") -> bytes:
    """Arrays of 64-bit values behind one another, with their lengths in front; then bytes.

    Arrays are stored as steps, byte plane by byte plane, as most of them ascend slowly.
    """
    head = np.array([len(arrays), *map(len, arrays)], np.int64)
    planes = []
    for a in arrays:
        with np.errstate(over="ignore"):
            steps = np.diff(a.astype(np.int64), prepend=np.int64(0))
        zigzag = (steps << 1) ^ (steps >> 63)
        planes.append(np.ascontiguousarray(zigzag.view(np.uint8).reshape(-1, 8).T).tobytes())
    return _zstd()[0].compress(b"".join([head.tobytes(), *planes, data]))


def _arrays(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``_blob``, and its bytes at the end."""
    raw = np.frombuffer(_zstd()[1].decompress(blob), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    lengths = raw[8 : 8 * (1 + n)].view(np.int64)
    cuts = 8 * np.cumsum(np.append(1 + n, lengths))
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        zigzag = np.ascontiguousarray(raw[a:b].reshape(8, -1).T).view(np.uint64).ravel()
        half = (zigzag >> np.uint64(1)).view(np.int64)
        with np.errstate(over="ignore"):
            out.append(np.cumsum(half ^ -(zigzag & np.uint64(1)).view(np.int64)))
    return [*out, raw[cuts[-1] :]]


def _table(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.Table.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], list(_NAMES)
    )


def _deal(keys, others: list[np.ndarray], buckets: int, chunk: int) -> list[tuple]:
    """Rows of distinct keys by bucket, in the order of the last of ``others``, which go along with them."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((others[-1], bucket))
    there, at = np.unique(bucket[order], return_index=True)
    at = np.append(at, len(keys))
    rows = []
    for b, i, j in zip(there, at, at[1:], strict=False):
        part = order[i:j]
        rows.append((int(b), chunk, keys[part].tobytes(), _blob(*[x[part] for x in others]), None, None))
    return rows


def _read(df: DataFrame, gram: int, run_words: int, buckets: int) -> DataFrame:
    """Fingerprints of every chunk, dealt by hash, and its texts in a row of their own."""

    def run(batches) -> Iterator:
        hasher, chunks = WordHasher(lower=False), chunk_numbers()
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            hashes = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in TextChunks(batch.column(1), CHUNK):
                chunk = next(chunks)
                _, value = _words(data, offsets, hasher).fingerprints(gram, run_words)
                keys, n = np.unique(value, return_counts=True)
                rows = _deal(keys, [np.minimum(n, 2)], buckets, chunk)
                own = _blob(ids[lo:hi], hashes[lo:hi], offsets, data=data.tobytes())
                rows.append((own_group(chunk), chunk, None, None, None, own))
                yield from _table(rows).to_batches()

    return df.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")
    ).mapInArrow(run, BLOCKS)


def _words(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> Words:
    starts, ends, per_row = hasher.spans(data, offsets)
    return Words(per_row, hasher.hashes(data, starts, ends))


def _repeated(table):
    """Of one bucket: the fingerprints that occur twice or more, chunk by chunk."""
    rows = table.to_pylist()
    out = [tuple(r[n] for n in _NAMES) for r in rows if r["own"] is not None]
    real = [r for r in rows if r["own"] is None]
    if real:
        parts = [np.frombuffer(r["keys"], np.uint64) for r in real]
        counts = np.concatenate([_arrays(r["places"])[0] for r in real])
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        often = np.bincount(inverse, weights=counts)[inverse] > 1
        a = 0
        for r, part in zip(real, parts, strict=True):
            keep = part[often[a : a + len(part)]]
            a += len(part)
            if len(keep):
                out.append((r["bucket"], r["chunk"], keep.tobytes(), None, None, None))
    return _table(out)


def _extend(gram: int, run_words: int, buckets: int):
    """Of one chunk: the grams around its repeated fingerprints, each with its first place."""

    def run(table):
        rows = table.to_pylist()
        blob = next(r["own"] for r in rows if r["own"] is not None)
        chunk = rows[0]["chunk"]
        known = [np.frombuffer(r["keys"], np.uint64) for r in rows if r["keys"] is not None]
        if not known:
            return _table([])
        ids, hashes, offsets, data = _arrays(blob)
        words = _words(data, offsets, WordHasher(lower=False))
        first, value = words.fingerprints(gram, run_words)
        hit = np.isin(value, np.concatenate(known))
        first = words.grams(gram, words.zone(first[hit], gram, run_words))
        row = words.row[first]
        place = first - words.row_begin[row]
        keys, inverse = np.unique(words.hash(first, gram), return_inverse=True)
        order = np.lexsort((place, ids[row], inverse))
        lead = order[np.searchsorted(inverse[order], np.arange(len(keys)))]
        deal = _deal(
            keys, [ids[row][lead], place[lead], first[lead]], buckets, chunk
        )
        # a place that isn't the chunk's own first one is later in any case
        late = (ids[row] != ids[row][lead][inverse]) | (place != place[lead][inverse])
        deal.append(
            (own_group(chunk), chunk, None, None, None,
             _blob(ids, hashes, words.per_row, first[late]))
        )
        return _table(deal)

    return run


def _first(table):
    """Of one bucket: the first words of each chunk's grams that have an earlier place elsewhere."""
    rows = table.to_pylist()
    out = [tuple(r[n] for n in _NAMES) for r in rows if r["own"] is not None]
    real = [r for r in rows if r["own"] is None]
    if real:
        parts = [np.frombuffer(r["keys"], np.uint64) for r in real]
        opened = [_arrays(r["places"]) for r in real]
        ids, places, at = (np.concatenate([x[k] for x in opened]) for k in range(3))
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        order = np.lexsort((places, ids, inverse))
        lead = order[np.searchsorted(inverse[order], np.arange(len(keys)))]
        late = (ids != ids[lead][inverse]) | (places != places[lead][inverse])
        a = 0
        for r, part in zip(real, parts, strict=True):
            keep = at[a : a + len(part)][late[a : a + len(part)]]
            a += len(part)
            if len(keep):
                out.append((r["bucket"], r["chunk"], None, None, _blob(keep), None))
    return _table(out)


def _cuts(gram: int):
    """Of one chunk: the words to remove from each of its documents."""

    def run(table):
        import pyarrow as pa

        rows = table.to_pylist()
        blob = next(r["own"] for r in rows if r["own"] is not None)
        ids, hashes, per_row, late, _ = _arrays(blob)
        known = [_arrays(r["at"])[0] for r in rows if r["at"] is not None]
        first = np.concatenate([late, *known])
        gone = _marked(first, first + gram, int(per_row.sum()))
        row = np.repeat(np.arange(len(per_row)), per_row)
        begin = np.cumsum(per_row) - per_row
        edge = np.ones(len(gone), bool)  # a span starts at a gone word behind a kept one or a row's begin
        edge[1:] = ~gone[:-1] | (row[1:] != row[:-1])
        a = np.flatnonzero(gone & edge)
        edge = np.append((~gone | edge)[1:], True) if len(gone) else edge
        b = np.flatnonzero(gone & edge) + 1
        there, at = np.unique(row[a], return_index=True)
        spans = np.stack([a - begin[row[a]], b - begin[row[a]]], axis=1).astype(np.int32)
        groups = np.split(spans, at[1:]) if len(at) else []
        return pa.Table.from_arrays(
            [
                pa.array(ids[there]), pa.array(hashes[there]),
                pa.array([g.ravel() for g in groups], pa.list_(pa.int32())),
                pa.array([int((g[:, 1] - g[:, 0]).sum()) for g in groups], pa.int64()),
            ],
            ["id", "text_hash", "spans", "words"],
        )

    return run


def repeated_words(
    df: DataFrame, *, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS
) -> DataFrame:
    """Words to remove: (id, text_hash, spans, words), one row per document that has any.

    ``spans`` holds the first word of every run and the one behind its last, in turn.
    """
    buckets = buckets_for(df, BUCKET_BYTES)
    return (
        _read(df, gram_words, run_words, buckets)
        .groupBy("bucket").applyInArrow(_repeated, BLOCKS)
        .groupBy("chunk").applyInArrow(_extend(gram_words, run_words, buckets), BLOCKS)
        .groupBy("bucket").applyInArrow(_first, BLOCKS)
        .groupBy("chunk").applyInArrow(_cuts(gram_words), CUTS)
        .dropDuplicates(["id", "text_hash"])
    )


def without(text: str, spans: np.ndarray) -> tuple[str, np.ndarray]:
    """``text`` without the given words, and the lines (places among its lines with a word)
    of which none is left."""
    data = np.frombuffer(text.encode(), np.uint8)
    hasher = WordHasher(lower=False)
    offsets = np.array([0, len(data)])
    begins, counts, _, _ = lines_of(data, offsets, hasher)
    starts, ends, _ = hasher.spans(data, offsets)
    first = np.cumsum(counts) - counts  # first word of every line
    until = starts.copy()  # up to where a cut from a line's begin goes, by the word behind it
    until[first] = begins
    until = np.append(until, len(data))
    lead = np.zeros(len(starts), bool)
    lead[first] = True
    keep = np.ones(len(data), bool)
    gone = np.zeros(len(starts), bool)
    for a, b in spans.reshape(-1, 2):
        gone[a:b] = True
        if lead[a]:
            keep[until[a] : until[b]] = False
        else:
            keep[ends[a - 1] : ends[b - 1]] = False
    return data[keep].tobytes().decode().rstrip(), np.flatnonzero(np.logical_and.reduceat(gone, first))


def dedup_lines(
    df: DataFrame, *, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS
) -> DataFrame:
    """``df`` with later repeats of runs of words removed from ``text``.

    Adds removed_lines (places among the lines with a word; those of which no
    word is left) and removed_words; columns of these names are replaced.  A run
    of ``run_words`` words or more that stood earlier, in a document of smaller
    doc_id or before in the same one, is always removed, wherever it starts or
    ends in a line; one under ``gram_words`` never is.  Texts from which nothing
    is removed stay as they are, null and empty ones too.  A null doc_id counts
    as the largest; rows of the same doc_id and text are one document.  All other
    columns pass through, whatever their names.  Words are compared by 64-bit
    hashes of grams.  Chunks are numbered by partition and order: where ``df``
    comes out of a shuffle, stage it first.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("removed_lines", "removed_words")])
    cuts = staged(repeated_words(df, gram_words=gram_words, run_words=run_words), "cuts")
    names = df.columns
    by_id, by_hash, c_id, c_hash = fresh_names(
        [*names, "removed_lines", "removed_words"], "doc_key", "hash_key", "cut_id", "cut_hash"
    )
    cuts = cuts.toDF(c_id, c_hash, "removed_lines", "removed_words")
    keys = {by_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), by_hash: F.xxhash64("text")}
    joined = df.withColumns(keys).join(
        cuts, (F.col(by_id) == F.col(c_id)) & (F.col(by_hash) == F.col(c_hash)), "left"
    )
    none = F.array().cast("array<int>")
    # spans of words; the lines follow from the text
    joined = joined.select(
        *names, F.coalesce("removed_lines", none).alias("removed_lines"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
    )
    at = names.index("text")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            spans = batch.column(len(names))
            has = np.diff(spans.offsets.to_numpy()) > 0
            if has.any():
                texts = batch.column(at).to_pylist()
                lines = [[]] * len(texts)
                for k in np.flatnonzero(has):
                    cut = spans[int(k)].values.to_numpy()
                    texts[k], lines[k] = without(texts[k], cut)
                batch = batch.set_column(at, names[at], pa.array(texts, pa.string()))
                batch = batch.set_column(
                    len(names), "removed_lines", pa.array(lines, pa.list_(pa.int32()))
                )
            yield batch

    return joined.mapInArrow(run, joined.schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", "text", F.size("removed_lines").cast("long").alias("n_removed_lines"),
        F.col("removed_words").alias("n_removed_words"),
    )
