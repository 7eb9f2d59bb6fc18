"""Operator 1: best-fit packing by linear grouping.

Documents become token sequences; sequences are filled to ``capacity``.

The plan works on the histogram of piece lengths, which has at most
``capacity`` rows whatever the corpus size, so the driver never sees documents:

1. *Linear grouping*: the large pieces, sorted by length, are cut into groups
   of equal cardinality and every length is rounded up to its group's largest.
2. *Few-size configurations*: over those few rounded sizes, the linear
   programme over configurations (multisets of sizes that fit in a sequence) is
   solved by column generation, with a knapsack as the pricing step.
3. *Substitution*: the actual lengths take the places of the rounded ones, which
   leaves extra room.
4. *Best fit*: what rounding the programme's solution left over, then the small
   pieces, go largest first where the least room that suffices is left.

The plan is a list of runs: the pieces of one length whose rank lies in a range
go to consecutive sequences.  Ranks come from salted windows, so a length that a
third of all pieces share is split over many tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, staged

CAPACITY = 1024
END_ID = 2
CACHE_WORDS = 200_000
ROWS_PER_SALT = 500

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _OddChunk(Exception):
    """A part that the per-word cache can't take; the whole text is encoded at once."""


class _WordIds(dict):
    """Word -> its ids as little-endian bytes.  When it is full, new words aren't kept."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        if not word or _SPACE.search(word):
            raise _OddChunk
        out = array("I", self.encode(self.prefix + word)).tobytes()
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


_SPACE = re.compile(r"\s")


class ByteEncoder:
    """Token ids of the byte-level BPE in a ``tokenizers`` file, as bytes.

    The vocabulary and the special tokens are read from the file; the same
    merges run in ``tiktoken``, several times faster.  Pre-tokens of this
    pattern never cross a single space or line break between two words, so ids
    are looked up by word; a text with any other white space is encoded whole.
    """

    PATTERN = (
        r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    )

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in visible}
        hidden = [b for b in range(256) if b not in set(visible)]
        shown |= {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {
            bytes(shown[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        coder = tiktoken.Encoding(
            "byte_bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.encode = coder.encode_ordinary
        self.first, self.rest = _WordIds(self.encode, ""), _WordIds(self.encode, " ")
        self.newline = np.array(self.encode("\n"), "<u4").tobytes()
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def __call__(self, text: str) -> bytes:
        if self.cut and any(s in text for s in self.special):
            return b"".join(
                self.special.get(x) or self._plain(x) for x in self.cut.split(text) if x
            )
        return self._plain(text) if text else b""

    def _plain(self, text: str) -> bytes:
        rest = self.rest.__getitem__
        try:
            lines = []
            for line in text.split("\n"):
                first, *words = line.split(" ")
                lines.append(self.first[first] + b"".join(map(rest, words)))
            return self.newline.join(lines)
        except _OddChunk:
            return np.array(self.encode(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokenize(
    df: DataFrame,
    path: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its place in its document, its length and checksum."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches) -> Iterator:
        import pyarrow as pa

        encode = _encoder(path)
        for batch in batches:
            columns = ([], [], [], [], [], [])
            for doc_id, text in zip(
                batch.column(0).to_pylist(), batch.column(1), strict=True
            ):
                ids = encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, k, start, length, zlib.crc32(part), part)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            if with_ids:
                names.append("ids")
                arrays.append(
                    pa.array(
                        [np.frombuffer(x, "<u4").astype("int64") for x in columns[5]],
                        pa.list_(pa.int64()),
                    )
                )
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids array<long>" if with_ids else "")
    return df.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


# -- the plan, on the histogram ------------------------------------------------


def linear_groups(hist: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Cut the lengths, largest first, into groups of equal cardinality.

    A group is a list of (length, count); its rounded size is its first length.
    """
    total = sum(hist.values())
    each = -(-total // groups) if total else 1
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if not room:
                out.append([])
                room = each
            take = min(left, room)
            out[-1].append((length, take))
            left -= take
            room -= take
    return out


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the most value within ``capacity``.

    ``best[j][r]``: most value of at most j pieces in room r.  Sizes exceed a
    fixed share of the capacity, so there are few levels.
    """
    rooms = np.arange(capacity + 1)[:, None] - sizes[None, :]
    fits = rooms >= 0
    rooms = np.maximum(rooms, 0)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        gains = np.where(fits, best[rooms] + values, 0.0)
        pick = gains.argmax(axis=1)
        gain = gains[np.arange(capacity + 1), pick]
        better = gain > best + 1e-12
        picks.append(np.where(better, pick, -1))
        best = np.where(better, gain, best)
    counts, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return counts


def configurations(
    sizes: list[int], demand: list[int], capacity: int, rounds: int = 600
) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each, rounded down.

    Column generation: a revised simplex over the patterns found so far, whose
    duals price the next pattern.
    """
    if not sizes:
        return []
    size = np.array(sizes, np.int64)
    need = np.array(demand, float)
    k = len(sizes)
    columns = np.diag((capacity // size).astype(float))
    cost = np.ones(k)
    inverse = np.linalg.inv(columns)
    for step in range(rounds):
        dual = cost @ inverse
        if dual.min() < -1e-9:
            entering, price = -np.eye(k)[int(dual.argmin())], 0.0
        else:
            entering, price = _knapsack(size, dual, capacity), 1.0
            if price - dual @ entering > -1e-7:
                break
        level, move = inverse @ need, inverse @ entering
        rising = move > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, level / np.where(rising, move, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out], cost[out] = entering, price
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        if step % 50 == 49:
            inverse = np.linalg.inv(columns)
    use = np.maximum(inverse @ need, 0)
    return [
        (columns[:, j].astype(int), int(use[j] + 1e-6))
        for j in range(k)
        if cost[j] and use[j] >= 1
    ]


class _Runs:
    """Runs of sequences that look alike, kept by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.next_rank: dict[int, int] = {}
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def new(self, count: int) -> int:
        first, self.n = self.n, self.n + count
        return first

    def place(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        """``each`` pieces of ``length`` in every one of ``count`` sequences."""
        rank = self.next_rank.get(length, 0)
        self.next_rank[length] = rank + count * each
        self.rows.append((length, rank, count * each, first, each, offset))

    def leave(self, first: int, count: int, room: int) -> None:
        if count and room:
            self.open[room].append((first, count))

    def best_fit(self, length: int, count: int) -> None:
        """Put each piece where the least room that suffices is left."""
        while count:
            room = next((r for r in range(length, self.capacity + 1) if self.open[r]), 0)
            if room:
                first, many = self.open[room].pop()
            else:
                room = self.capacity
                many = -(-count // (room // length))
                first = self.new(many)
            each = min(room // length, count)
            used = min(many, count // each)
            self.place(length, used, first, each, self.capacity - room)
            self.leave(first, used, room - each * length)
            self.leave(first + used, many - used, room)
            count -= used * each


def plan(
    hist: dict[int, int], capacity: int = CAPACITY, groups: int = 320, small: float = 1 / 3
) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, each, offset) and the number of sequences."""
    runs = _Runs(capacity)
    if hist.get(capacity):
        runs.place(capacity, hist[capacity], runs.new(hist[capacity]), 1, 0)
    least = int(capacity * small)
    large = {x: n for x, n in hist.items() if least < x < capacity}
    grouped = linear_groups(large, groups)
    left = [[list(x) for x in g] for g in grouped]
    for pattern, times in configurations(
        [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity
    ):
        segments = [(runs.new(times), times, 0)]
        for g in np.repeat(np.arange(len(pattern)), pattern):
            after = []
            for first, many, offset in segments:
                while many:
                    while left[g] and not left[g][0][1]:
                        left[g].pop(0)
                    if not left[g]:
                        after.append((first, many, offset))
                        break
                    length, there = left[g][0]
                    take = min(many, there)
                    left[g][0][1] -= take
                    runs.place(length, take, first, 1, offset)
                    after.append((first, take, offset + length))
                    first, many = first + take, many - take
            segments = after
        for first, many, offset in segments:
            runs.leave(first, many, capacity - offset)
    rest = {x: n for x, n in hist.items() if x <= least}
    for g in left:
        for length, n in g:
            if n:
                rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        runs.best_fit(length, rest[length])
    return np.array(runs.rows, np.int64).reshape(-1, 6), runs.n


def pack(
    df: DataFrame,
    path: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    groups: int = 320,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Pack every document of ``df(doc_id, text)`` into sequences of ``capacity`` tokens.

    Null or empty text is the end id alone.  Repeated rows are packed as often
    as they occur; a null doc_id stays null.  An empty table gives no rows.
    Other columns of ``df`` are not read.  The only state on the driver is the
    histogram (at most ``capacity`` rows) and the plan made from it.
    """
    pieces = staged(
        tokenize(df, path, capacity=capacity, end_id=end_id), "pieces"
    )
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, _ = plan(hist, capacity, groups)
    salts = df.sparkSession.createDataFrame(
        [(length, -(-n // rows_per_salt)) for length, n in hist.items()],
        "length long, salts long",
    )  # at most ``capacity`` rows
    salted = pieces.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")
    )
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    # all columns take part, so that a lost task ranks its rows as before
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("rank", F.row_number().over(within) - 1)
        .join(bases, ["length", "salt"])
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("rank") + F.col("base")).alias("rank"),
        )
    )
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    def place(batches) -> Iterator:
        import pyarrow as pa

        keys = rows[:, 0] * (1 << 50) + rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            row = rows[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1]
            at = rank - row[:, 1]
            sequence = row[:, 3] + at // row[:, 4]
            offset = row[:, 5] + at % row[:, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
