"""Operator 8: scoring by a Brown class-based bigram model.

Every word belongs to a class; the probability of a word is that of its class
after the class before it, times that of the word within its class, mixed with
the smoothed unigram.  Classes come from exchange clustering: words are moved,
a pass over the corpus at a time, to the class that makes them and their
neighbours most likely given the counts of that pass (the batch form of the
algorithm, half of the words in turn), until few words move.  The likelihood is
worked out in every pass; a pass that lowers it is taken back.

* Every word seen ``LEAST_COUNT`` times or more in training gets a class of its
  own choice, at every size of corpus; rarer words, seen or not, form classes by
  bands of count.
* Words that make up ``LEAST_SHARE`` of the training tokens or more take part in
  all passes.  There can't be more than ``1 / LEAST_SHARE`` of them, which bounds
  what is broadcast.  The others are exchanged once, into the classes that the
  passes made; their classes are a table dealt by hash, and each chunk of text
  gets back those of its own words.
* Exact 64-bit counts of all words are gathered in packed blocks dealt by hash;
  each chunk of text gets back the counts of its own words, so no vocabulary is
  held in one place.  A chunk's own row is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import (
    TextChunks, WordHasher, buckets_for, chunk_numbers, crc32_of_id, documents, dropped, estimated_bytes,
    mix64, own_group, staged,
)

END = int(mix64(np.array([0xE4D], np.uint64))[0])
LEAST_SHARE, LEAST_COUNT = 1e-6, 16
#: Rarer words fall into bands: seen less than 2 or 4 times, or more.
BANDS = np.array([2, 4])
CLASSES, PASSES, MIX = 64, 10, 0.85
#: Passes end when a smaller share of the words moves in both halves.
FEW = 0.01
FIRST = 2 + len(BANDS)  # class 0 is the end, then the bands, then the clusters
CHUNK = 4 << 20

PACKED = "bucket long, chunk long, keys binary, counts binary, meta binary, seq binary"
COUNTED = "bucket long, chunk long, keys binary, counts binary, meta binary, seq binary, stats binary"
CHUNKS = (
    "chunk long, keys binary, counts binary, meta binary, seq binary, often binary, totals binary, "
    "bands array<long>"
)
ASSIGNED = "bucket long, chunk long, keys binary, counts binary, many binary, beside binary, uses binary"
CLASSED = "chunk long, keys binary, counts binary, meta binary, seq binary, mid binary, sums array<long>"


def _arrow(rows: dict[str, list], schema: str):
    """Lists as an Arrow table of a simple schema."""
    kinds = {
        "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
    }
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    return pa.Table.from_arrays(
        [pa.array(rows[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields]
    )


def squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0 up, byte plane by byte plane (four, or eight where it takes them), compressed."""
    import zstandard

    width = 8 if len(values) and int(values.max()) >= 1 << 32 else 4
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(blob: bytes) -> np.ndarray:
    import zstandard

    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


class _Rows(dict):
    def __init__(self, schema: str):
        super().__init__({x.split()[0]: [] for x in schema.split(",")})
        self.schema = schema

    def put(self, **row) -> None:
        for name, column in self.items():
            column.append(row.get(name))

    def table(self):
        return _arrow(self, self.schema)


def _dealt(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, and the order by bucket and hash."""
    bucket = (words % np.uint64(buckets)).astype(np.int64)
    return bucket, np.lexsort((words, bucket))


def _pack(df: DataFrame, buckets: int) -> DataFrame:
    """Distinct words of every chunk with their training counts, dealt by hash.

    A chunk's own row holds its documents, its distinct words, most frequent
    first, and its tokens as places in that list.
    """

    def run(batches) -> Iterator:
        hasher, chunks = WordHasher(), chunk_numbers()
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in TextChunks(batch.column(1), CHUNK):
                chunk = next(chunks)
                starts, ends, n_words = hasher.spans(data, offsets)
                tokens = np.full(len(starts) + hi - lo, END, np.uint64)
                is_word = np.ones(len(tokens), bool)
                is_word[np.cumsum(n_words + 1) - 1] = False
                tokens[is_word] = hasher.hashes(data, starts, ends)
                words, seq, uses = np.unique(tokens, return_inverse=True, return_counts=True)
                by_use = np.argsort(-uses, kind="stable")  # small numbers for frequent words
                words, seq = words[by_use], np.argsort(by_use)[seq]
                train = np.repeat(~held[lo:hi], n_words + 1)
                counts = np.bincount(seq[train], minlength=len(words))
                bucket, order = _dealt(words, buckets)
                there, at = np.unique(bucket[order], return_index=True)
                at = np.append(at, len(words))
                rows = _Rows(PACKED)
                for b, i, j in zip(there, at, at[1:], strict=False):
                    part = order[i:j]
                    rows.put(
                        bucket=int(b), chunk=chunk, keys=words[part].tobytes(),
                        counts=squeezed(counts[part]),
                    )
                meta = [[hi - lo], ids[lo:hi], known[lo:hi], held[lo:hi], n_words + 1]
                rows.put(
                    bucket=own_group(chunk), chunk=chunk, keys=words.tobytes(),
                    meta=np.concatenate(meta).astype(np.int64).tobytes(),
                    seq=squeezed(seq),
                )
                yield from rows.table().to_batches()

    return df.select(
        F.col("doc_id").cast("long"), "text", F.col("held_out").cast("boolean")
    ).mapInArrow(run, PACKED)


def _band(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, counts, side="right")


def _count(table):
    """Of one bucket: the corpus count of every word, sent back chunk by chunk."""
    rows, out = table.to_pylist(), _Rows(COUNTED)
    real = [r for r in rows if r["meta"] is None]
    if real:
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in real])
        each = np.concatenate([unsqueezed(r["counts"]) for r in real])
        words, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=each, minlength=len(words)).astype(np.int64)
        back, a = total.astype(np.uint64)[inverse], 0
        for r in real:
            b = a + len(r["keys"]) // 8
            out.put(bucket=r["bucket"], chunk=r["chunk"], counts=squeezed(back[a:b]))
            a = b
        often = total >= LEAST_COUNT
        seen = total > 0
        band = _band(total[seen])
        sums = [np.bincount(band, minlength=len(BANDS) + 1),
                np.bincount(band, weights=total[seen], minlength=len(BANDS) + 1)]
        stats = [np.concatenate(sums).astype(np.int64), words[often].view(np.int64), total[often]]
        host = real[real[0]["bucket"] % len(real)]["chunk"]  # not the same one for all buckets
        out.put(bucket=-1, chunk=host, stats=np.concatenate(stats).tobytes())
    for r in rows:
        if r["meta"] is not None:
            out.put(bucket=-1, chunk=r["chunk"], keys=r["keys"], meta=r["meta"], seq=r["seq"])
    return out.table()


def _assemble(buckets: int):
    """Of one chunk: its documents and tokens with the counts of its words."""

    def run(table):
        rows, out = table.to_pylist(), _Rows(CHUNKS)
        own = next(r for r in rows if r["meta"] is not None)
        words = np.frombuffer(own["keys"], np.uint64)
        counts = np.zeros(len(words), np.int64)
        bucket, order = _dealt(words, buckets)
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for r in rows:
            if r["counts"] is not None:
                k = r["bucket"]
                counts[order[edges[k] : edges[k + 1]]] = unsqueezed(r["counts"])
            elif r["stats"] is not None:
                stats = np.frombuffer(r["stats"], np.int64)
                n = 2 * (len(BANDS) + 1)
                half = (len(stats) - n) // 2
                out.put(chunk=own["chunk"], bands=stats[:n].tolist(), often=stats[n : n + half].tobytes(),
                        totals=stats[n + half :].tobytes())
        out.put(chunk=own["chunk"], keys=words[counts >= LEAST_COUNT].tobytes(), counts=squeezed(counts),
                meta=own["meta"], seq=own["seq"])
        return out.table()

    return run


def _frequent(least: int):
    """Words with their counts, where the count reaches ``least``."""

    def run(batches) -> Iterator:
        for batch in batches:
            for words, totals in zip(batch.column(0), batch.column(1), strict=True):
                n = np.frombuffer(totals.as_py(), np.int64)
                keep = n >= least
                w = np.frombuffer(words.as_py(), np.int64)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n[keep])], ["word", "n"])

    return run


class _Chunk:
    """A stored chunk with the classes of its tokens under a clustering."""

    def __init__(self, row: dict, words: np.ndarray, classes: np.ndarray):
        meta = np.frombuffer(row["meta"], np.int64)
        n = int(meta[0])
        self.ids, self.known, self.held, self.tokens = meta[1:].reshape(4, n)
        self.seq = unsqueezed(row["seq"])
        self.counts = unsqueezed(row["counts"]).astype(np.int64)
        self.index = np.full(len(self.counts), -1, np.int64)
        often = np.flatnonzero(self.counts >= LEAST_COUNT)
        keys = np.frombuffer(row["keys"], np.uint64)
        if len(words):
            at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
            same = words[at] == keys
            self.index[often[same]] = at[same]
        klass = 1 + _band(self.counts)
        inside = self.index >= 0
        klass[inside] = classes[self.index[inside]]
        self.last = np.cumsum(self.tokens) - 1
        # the words that are exchanged once: their places and hashes
        self.mid = often[self.index[often] < 0]
        if len(self.last):
            self.mid = self.mid[self.mid != self.seq[self.last[0]]]
        self.mid_keys = keys[np.searchsorted(often, self.mid)]
        if row.get("mid") is not None:
            klass[self.mid] = np.frombuffer(row["mid"], np.uint8)
        self.word_class = klass
        # the end has its class even where it is too rare to be clustered
        self.word_class[self.seq[self.last]] = 0
        self.klass = self.word_class[self.seq]
        self.before = np.empty_like(self.klass)
        self.before[1:] = self.klass[:-1]
        self.before[self.last + 1 - self.tokens] = 0
        self.train = np.repeat(self.held == 0, self.tokens)


CONTEXTS = "bucket long, salt int, keys binary, counts binary"


def _merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    every, each = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, each = every[order], each[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(each, first) if len(first) else each


def _contexts(words: np.ndarray, classes: np.ndarray, k: int, moving: int, fan: int):
    """Transitions between classes, and neighbours' classes of the moving words.

    ``moving`` 0 or 1: words of that parity; -1: transitions only.  Transitions
    are rows of bucket -1.
    """

    def run(batches) -> Iterator:
        from pyspark import TaskContext

        steps = np.zeros(k * k, np.int64)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row, words, classes)
                t = c.train
                steps += np.bincount((c.before * k + c.klass)[t], minlength=k * k)
                if moving < 0:
                    continue
                index = c.index[c.seq]
                move = t & (index >= 0) & (index % 2 == moving) & (c.klass >= FIRST)
                after = np.append(c.klass[1:], 0)[move]
                base = index[move] * (2 * k)
                key, n = np.unique(
                    np.concatenate([base + c.before[move], base + k + after]), return_counts=True
                )
                keys.append(key)
                counts.append(n)
                if sum(map(len, keys)) > 4_000_000:
                    key, n = _merged(keys, counts)
                    keys, counts = [key], [n]
        key, n = _merged(keys, counts)
        bucket = key // (2 * k * 256)
        there, at = np.unique(bucket, return_index=True)
        at = np.append(at, len(key))
        salt = TaskContext.get().partitionId() % fan
        out = _Rows(CONTEXTS)
        full = np.flatnonzero(steps)
        out.put(bucket=-1, salt=salt, keys=squeezed(full), counts=squeezed(steps[full]))
        for b, i, j in zip(there, at, at[1:], strict=False):
            out.put(bucket=int(b), salt=salt, keys=_sorted_blob(key[i:j]), counts=squeezed(n[i:j]))
        yield from out.table().to_batches()

    return run


def _sorted_blob(keys: np.ndarray) -> bytes:
    return squeezed(np.diff(keys, prepend=0))


def _sorted_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(blob).astype(np.int64))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the context blocks of one bucket, batch by batch."""
    bucket, opened = 0, _sorted_keys
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for r in batch.to_pylist():
            bucket = r["bucket"]
            opened = unsqueezed if bucket < 0 else _sorted_keys
            keys.append(opened(r["keys"]).astype(np.int64))
            counts.append(unsqueezed(r["counts"]).astype(np.int64))
        total, n = _merged(keys, counts)
        keys, counts = [total], [n]
    out = _Rows(CONTEXTS)
    closed = squeezed if bucket < 0 else _sorted_blob
    out.put(bucket=bucket, salt=0, keys=closed(keys[0]), counts=squeezed(counts[0]))
    yield from out.table().to_batches()


def _best(left: np.ndarray, right: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The class that makes words with these neighbours most likely."""
    k = len(steps)
    with np.errstate(divide="ignore"):
        log_step = np.log(steps + 0.5) - np.log(steps.sum(axis=1, keepdims=True) + 0.5 * k)
        log_size = np.log(steps.sum(axis=0) + 1.0)
    gain = left @ log_step + right @ log_step.T
    gain -= left.sum(axis=1, keepdims=True) * log_size
    gain[:, :FIRST] = -np.inf
    return gain.argmax(axis=1)


def likelihood(steps: np.ndarray) -> float:
    """Log likelihood of the class bigrams, but for a term that no exchange changes."""
    n = steps.astype(float)
    rows, columns = n.sum(axis=1, keepdims=True), n.sum(axis=0, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.where(n > 0, n * np.log(n / (rows * columns)), 0.0).sum())


def _exchange(steps: np.ndarray, k: int):
    """The best class of every moving word, given the transitions of this pass."""

    def run(batches) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                key, n = _sorted_keys(row["keys"]), unsqueezed(row["counts"])
                word, at = np.unique(key // (2 * k), return_inverse=True)
                beside = np.zeros((len(word), 2 * k))
                beside[at, key % (2 * k)] = n
                best = _best(beside[:, :k], beside[:, k:], steps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word), pa.array(best.astype(np.int32))], ["word", "class"]
                )

    return run


def _neighbours(words: np.ndarray, classes: np.ndarray, k: int, buckets: int):
    """Of every chunk: its words that are exchanged once, with their neighbours' classes, dealt by hash."""

    def run(batches) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row, words, classes)
                number = np.full(len(c.counts), -1)
                number[c.mid] = np.arange(len(c.mid))
                at = number[c.seq]
                use = c.train & (at >= 0)
                after = np.append(c.klass[1:], 0)[use]
                base = at[use] * (2 * k)
                key, n = np.unique(
                    np.concatenate([base + c.before[use], base + k + after]), return_counts=True
                )
                many = np.bincount(key // (2 * k), minlength=len(c.mid))
                begin = np.cumsum(many) - many
                bucket, order = _dealt(c.mid_keys, buckets)
                there, first = np.unique(bucket[order], return_index=True)
                first = np.append(first, len(order))
                out = _Rows(ASSIGNED)
                for b, i, j in zip(there, first, first[1:], strict=False):
                    part = order[i:j]
                    each = many[part]
                    places = np.repeat(begin[part], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    out.put(
                        bucket=int(b), chunk=row["chunk"], keys=c.mid_keys[part].tobytes(),
                        counts=squeezed(c.counts[c.mid[part]]), many=squeezed(each),
                        beside=squeezed(key[places] % (2 * k)), uses=squeezed(n[places]),
                    )
                yield from out.table().to_batches()

    return run


def _assign(steps: np.ndarray, k: int):
    """Of one bucket: the class of every word, sent back chunk by chunk."""

    def run(table):
        rows, out = table.to_pylist(), _Rows(CLASSED)
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        totals = np.concatenate([unsqueezed(r["counts"]) for r in rows]).astype(np.int64)
        word, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        beside, a = np.zeros(len(word) * 2 * k), 0
        for r in rows:
            many = unsqueezed(r["many"]).astype(np.int64)
            at = np.repeat(inverse[a : a + len(many)], many)
            np.add.at(beside, at * (2 * k) + unsqueezed(r["beside"]), unsqueezed(r["uses"]))
            a += len(many)
        beside = beside.reshape(-1, 2 * k)
        best = _best(beside[:, :k], beside[:, k:], steps)
        sums = [np.bincount(best, minlength=k), np.bincount(best, weights=totals[first], minlength=k)]
        a = 0
        for r in rows:
            b = a + len(r["keys"]) // 8
            out.put(chunk=r["chunk"], keys=r["keys"], mid=best[inverse[a:b]].astype(np.uint8).tobytes())
            a = b
        host = rows[rows[0]["bucket"] % len(rows)]["chunk"]
        out.put(chunk=host, sums=np.concatenate(sums).astype(np.int64).tolist())
        return out.table()

    return run


def _with_mid(words: np.ndarray, classes: np.ndarray):
    """Of one chunk: its own row with the classes of its words that were exchanged once."""

    def run(table):
        rows, out = table.to_pylist(), _Rows(CLASSED)
        own = next(r for r in rows if r["meta"] is not None)
        c = _Chunk(own, words, classes)
        order = np.argsort(c.mid_keys)
        mid = np.zeros(len(c.mid), np.uint8)
        for r in rows:
            if r["mid"] is not None:
                keys = np.frombuffer(r["keys"], np.uint64)
                mid[order[np.searchsorted(c.mid_keys, keys, sorter=order)]] = np.frombuffer(r["mid"], np.uint8)
            elif r["sums"] is not None:
                out.put(chunk=own["chunk"], sums=r["sums"])
        out.put(**{**own, "mid": mid.tobytes()})
        return out.table()

    return run


def _score(words, classes, k: int, log_class, class_sizes, n: int, v: int, mix: float):
    """Scores of the documents of every chunk."""

    def run(batches) -> Iterator:
        base = np.log10(n + v + 1.0)
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row, words, classes)
                unigram = np.log10(c.counts + 1.0) - base
                emit = np.log10(c.counts + 1.0) - class_sizes[c.word_class]
                emit[c.word_class == 0] = 0.0
                chain = log_class[c.before * k + c.klass] + emit[c.seq]
                flat = unigram[c.seq]
                mixed = np.log10(mix * 10.0**chain + (1 - mix) * 10.0**flat)
                first = c.last + 1 - c.tokens
                total = lambda x: np.add.reduceat(x, first) if len(first) else x  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.ids, mask=c.known == 0),
                        pa.array(c.held != 0),
                        pa.array(c.tokens),
                        pa.array(total((c.counts > 0)[c.seq].astype(np.int64))),
                        pa.array(np.full(len(c.ids), n, np.int64)),
                        pa.array(total(flat)),
                        pa.array(total(mixed)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(
    df: DataFrame, *, classes: int = CLASSES, passes: int = PASSES, mix: float = MIX,
    least_share: float = LEAST_SHARE,
) -> DataFrame:
    """Log10 probabilities of every text of ``df(doc_id, text, held_out)``.

    The model learns from the rows where ``held_out`` is false.  Tokens are
    A-Z lower-cased words between white space, then one end.  Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and
    score (the class model; its probabilities sum to one over words and ends).
    Null or empty text is the end alone.  Rows stay one to one, repeated rows
    and null ids included.  With nothing to learn from, both scores follow from
    zero counts.  Other columns are not read.  Chunks are numbered by partition
    and order: where ``df`` comes out of a shuffle, stage it first.
    """
    k = classes
    if not FIRST < k <= 256:
        raise ValueError(f"classes must be more than {FIRST} and at most 256")
    size = estimated_bytes(df)
    buckets = buckets_for(df, 4 << 20)
    fan = math.ceil(math.sqrt(max(1, size // (32 << 20))))
    chunks = staged(
        _pack(df, buckets)
        .groupBy("bucket").applyInArrow(_count, COUNTED)
        .groupBy("chunk").applyInArrow(_assemble(buckets), CHUNKS),
        "chunks",
    )
    stats = chunks.where("bands is not null")
    width = len(BANDS) + 1
    sums = stats.agg(
        *[F.coalesce(F.sum(F.col("bands")[i]), F.lit(0)).alias(f"b{i}") for i in range(2 * width)]
    ).first()
    types, tokens = np.array(sums[:width], float), np.array(sums[width:], float)
    v, n = sum(sums[:width]), sum(sums[width:])
    least = max(LEAST_COUNT, math.ceil(least_share * n))
    # at most 1 / least_share words, by the choice of ``least``
    found = stats.select("often", "totals").mapInArrow(_frequent(least), "word long, n long")
    frequent = found.toArrow()
    words = frequent.column("word").to_numpy().view(np.uint64)
    count = frequent.column("n").to_numpy()
    count, words = count[np.argsort(words)], np.sort(words)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, -count))] = np.arange(len(words))
    klass = (FIRST + rank % (k - FIRST)).astype(np.int64)
    klass[words == END] = 0

    texts = chunks.where("meta is not null").select("chunk", "keys", "counts", "meta", "seq")

    def turn(texts: DataFrame, moving: int) -> tuple[np.ndarray, DataFrame]:
        """Transitions under the classes at hand, and the table of contexts of the moving words."""
        parts = texts.mapInArrow(_contexts(words, klass, k, moving, fan), CONTEXTS)
        if fan > 1:  # a tree: no task takes the sums of all others
            parts = parts.groupBy("bucket", "salt").applyInArrow(_add, CONTEXTS)
        table = staged(parts.groupBy("bucket").applyInArrow(_add, CONTEXTS), "contexts")
        steps = np.zeros(k * k, np.int64)
        for r in table.where("bucket < 0").collect():  # one row
            steps[unsqueezed(r["keys"])] = unsqueezed(r["counts"])
        return steps.reshape(k, k), table

    best, before, moved = -math.inf, klass.copy(), [1.0, 1.0]
    for i in range(passes if len(words) else 0):
        steps, table = turn(texts, i % 2)
        now = likelihood(steps)
        if now < best:
            klass = before
            break
        best, before = now, klass.copy()
        moves = (
            table.where("bucket >= 0")
            .mapInArrow(_exchange(steps, k), "word long, class int")
            .toArrow()
        )
        dropped(table)
        word, target = moves.column("word").to_numpy(), moves.column("class").to_numpy()
        moved[i % 2] = float((klass[word] != target).mean()) if len(word) else 0.0
        klass[word] = target
        if max(moved) < FEW:
            break

    # the words below ``least``, in one exchange
    in_types, in_tokens = np.zeros(k), np.zeros(k)
    if least > LEAST_COUNT:
        steps, table = turn(texts, -1)
        dropped(table)
        sent = texts.mapInArrow(_neighbours(words, klass, k, buckets), ASSIGNED)
        back = sent.groupBy("bucket").applyInArrow(_assign(steps, k), CLASSED)
        own = texts.withColumns(
            {"mid": F.lit(None).cast("binary"), "sums": F.lit(None).cast("array<long>")}
        )
        classed = staged(
            back.unionByName(own).groupBy("chunk").applyInArrow(_with_mid(words, klass), CLASSED), "classed"
        )
        sums = classed.where("sums is not null").agg(
            *[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)).alias(f"s{i}") for i in range(2 * k)]
        ).first()
        in_types += np.array(sums[:k], float)
        in_tokens += np.array(sums[k:], float)
        dropped(chunks)
        texts = classed.where("meta is not null").drop("sums")
    steps, table = turn(texts, -1)
    dropped(table)

    # P(class | class before): add-one shares of the classes back every row off
    share = (steps.sum(axis=0) + 1.0) / (steps.sum() + k)
    log_class = np.log10((steps + share) / (steps.sum(axis=1, keepdims=True) + 1.0)).ravel()
    # P(word | class): add one over the class's words; unseen words are one more word of the first band
    types[-1] -= in_types.sum()
    tokens[-1] -= in_tokens.sum()
    np.add.at(in_types, klass, 1)
    np.add.at(in_tokens, klass, count)
    band = _band(count)
    np.subtract.at(types, band, 1)
    np.subtract.at(tokens, band, count)
    if END not in words:  # too rare to be clustered, yet a class of its own
        ends = steps[:, 0].sum()
        if ends:
            types[_band(np.array([ends]))[0]] -= 1
            tokens[_band(np.array([ends]))[0]] -= ends
    in_types[1:FIRST], in_tokens[1:FIRST] = types, tokens
    in_types[1] += 1
    sizes = np.log10(np.maximum(in_types + in_tokens, 1.0))
    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return texts.mapInArrow(_score(words, klass, k, log_class, sizes, n, v, mix), schema)


def op8_class_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs.withColumn("held_out", crc32_of_id(F.col("doc_id")) % 7 == 2))
