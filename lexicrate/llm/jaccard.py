"""Operator 5: exact Jaccard join on word shingles, by set relations.

A document's set holds the 64-bit hashes of its distinct five-word shingles; two
documents link when ``100 * intersection >= 80 * union``.  Work is saved by what
sets have to do with each other:

* *Counting* (packed blocks, dealt by hash): which shingles occur in two sets or
  more.  A set of n shingles with fewer than 0.8 n of those can't link, whatever
  the others are; most documents end here.
* *Equal answers*: sets with the same shared shingles S and few of their own
  (8n <= 9|S|) all link to each other.  They form one node with one answer, that
  of its smallest set.
* *Index skipping*: the prefix of a set's rarest shared shingles is its index
  entry.  The list of a shingle is cut into blocks by set size.  The position of
  the shingle in a set bounds what may be in common from there on, and with it
  the blocks that the set asks at all; it skips the others.
* *Derived answers*: a set is first compared with a few pivots, those that it
  shares most entries with.  Sets that link to a pivot take over its component;
  only pairs of sets from different components are looked at afterwards, and
  their overlap is derived from that of a very similar set and the difference
  to it, where that decides.

Hashing and set algebra run in numpy over packed blocks; Spark deals out, groups
and joins them.  64-bit hashes stand for shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import least_labels
from .shared import (
    TextChunks, WordHasher, buckets_for, chunk_numbers, combine, documents, dropped, item_numbers, mix64,
    own_group, staged,
)

WIDTH = 5
NO_ID = (1 << 63) - 1
#: Pivots drawn in a list, how many of them a set is compared with, and how often.
#: They only steer the order of the work: what they leave open is compared in full.
PIVOTS, COMPARED, TURNS = 4, 6, 2
#: Parts of a size block that entries may skip; entries of a list's part in one split.
FINE, SPLIT = 8, 128

PACKED = "bucket long, chunk long, keys binary, items binary, meta binary"
SHARED = "chunk long, bucket long, keys binary, items binary, levels binary, meta binary"
ITEMS = "item long, doc_ids array<long>, n long, s long, fp1 long, fp2 long, keys binary"


def shingle_sets(data, offsets, hasher: WordHasher, width: int = WIDTH):
    """(row, hash) of the distinct shingles of a chunk's rows, sorted by both."""
    starts, ends, counts = hasher.spans(data, offsets)
    hashes = hasher.hashes(data, starts, ends)
    row = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) >= width:
        inside = row[: len(row) - width + 1] == row[width - 1 :]
        keys, rows = combine(hashes, width)[inside], row[: len(row) - width + 1][inside]
    else:
        keys, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        whole = [combine(hashes[first[r] : first[r] + counts[r]], int(counts[r]))[0] for r in few]
        marks = np.array([counts[r] * 0x51ED270B for r in few], np.uint64)
        keys = np.concatenate([keys, mix64(np.array(whole, np.uint64) ^ marks)])
        rows = np.concatenate([rows, few])
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows = keys[new], rows[new]
    return rows, keys


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sums of ``values`` by sorted ``groups``."""
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        edges = np.searchsorted(groups, np.arange(n + 1))
        return total[edges[1:]] - total[edges[:-1]]


def _set_marks(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each row's set, whatever its order."""
    with np.errstate(over="ignore"):
        return (
            _sums(mix64(keys), rows, n),
            _sums(mix64(keys + np.uint64(0x9E3779B97F4A7C15)), rows, n),
        )


def _pack(df: DataFrame, bits: int, width: int) -> DataFrame:
    """The shingles of all sets, packed by chunk of text and bucket of hash.

    Equal sets of a chunk are one item.  A shingle is sent once a chunk, with the
    number of the chunk's items that hold it; which items these are stays with
    the chunk's own row, a group of its own, which lists its documents too.  So
    a shingle of all documents costs its bucket one entry a chunk.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        hasher, chunks = WordHasher(), chunk_numbers()
        for batch in batches:
            ids = batch.column(0)
            ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in TextChunks(batch.column(1)):
                chunk, n = next(chunks), hi - lo
                rows, keys = shingle_sets(data, offsets, hasher, width)
                size = np.bincount(rows, minlength=n)
                mark, _ = _set_marks(keys, rows, n)
                _, first, item = np.unique(
                    mix64(mark) ^ size.astype(np.uint64), return_index=True, return_inverse=True
                )
                by_row = np.argsort(first)  # items in the order of their first rows
                first, item = first[by_row], np.argsort(by_row)[item]
                keep = np.isin(rows, first)
                keys, items = keys[keep], item[rows[keep]]
                order = np.argsort(keys, kind="stable")  # by bucket, as buckets are the leading bits
                keys, items = keys[order], items[order]
                begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
                held = np.diff(np.append(begin, len(keys)))
                keys = keys[begin]
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                there, at = np.unique(bucket, return_index=True)
                at = np.append(at, len(keys))
                meta = np.concatenate(
                    [[n, len(first), len(keys)], ids[lo:hi], item, size[first]]
                ).astype(np.int64)
                out = (
                    [*map(int, there), own_group(chunk)],
                    [chunk] * (len(there) + 1),
                    [keys[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] + [None],
                    [_small(held[a:b]) for a, b in zip(at, at[1:], strict=False)] + [_own(held, items)],
                    [None] * len(there) + [meta.tobytes()],
                )
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(out, types, strict=True)],
                    ["bucket", "chunk", "keys", "items", "meta"],
                )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED)


def _small(values: np.ndarray) -> bytes:
    """Numbers in a byte each where that does, else in four; the first byte tells."""
    kind = np.uint8 if not len(values) or values.max() < 256 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _from_small(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8 if blob[0] == 1 else np.uint32, offset=1).astype(np.int64)


def _flags(which: np.ndarray) -> bytes:
    return len(which).to_bytes(8, "little") + np.packbits(which).tobytes()


def _from_flags(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.unpackbits(np.frombuffer(blob, np.uint8, offset=8), count=n).astype(bool)


def _own(held: np.ndarray, items: np.ndarray) -> bytes:
    """For every shingle of a chunk, in order, how many items hold it; then the items."""
    import zstandard

    counts, each = _small(held), _small(items)
    raw = len(counts).to_bytes(8, "little") + counts + each
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _from_own(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return _from_small(raw[8 : 8 + n]), _from_small(raw[8 + n :])


def _shared(table):
    """Of one bucket: the hashes that two sets or more hold, with their frequency.

    A chunk gets back which of its own hashes in this bucket these are.
    """
    import pyarrow as pa

    chunks = table.column("chunk").to_pylist()
    metas = table.column("meta").to_pylist()
    blobs = table.column("keys").to_pylist()
    items = table.column("items").to_pylist()
    out = ([], [], [], [], [], [])
    real = [k for k, m in enumerate(metas) if m is None]
    if real:
        parts = [np.frombuffer(blobs[k], np.uint64) for k in real]
        keys = np.concatenate(parts)
        held = np.concatenate([_from_small(items[k]) for k in real])
        _, inverse = np.unique(keys, return_inverse=True)
        count = np.bincount(inverse, weights=held)[inverse]
        level = np.log2(count).astype(np.uint8)
        edges = np.cumsum([0] + [len(p) for p in parts])
        bucket = table.column("bucket")[real[0]].as_py()
        for k, a, b in zip(real, edges, edges[1:], strict=False):
            more = count[a:b] > 1
            row = (
                chunks[k], bucket, keys[a:b][more].tobytes(), _flags(more),
                level[a:b][more].tobytes(), None,
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
    for k, m in enumerate(metas):
        if m is not None:
            for column, value in zip(out, (chunks[k], -1, None, items[k], None, m), strict=True):
                column.append(value)
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays(
        [pa.array(x, t) for x, t in zip(out, types, strict=True)],
        ["chunk", "bucket", "keys", "items", "levels", "meta"],
    )


def _items(percent: int):
    """Of one chunk: its items with the shared part of those that can link."""

    def run(table):
        import pyarrow as pa

        rows = table.to_pylist()
        own = next(r for r in rows if r["meta"] is not None)
        meta = np.frombuffer(own["meta"], np.int64)
        n_docs, n_items, n_keys = map(int, meta[:3])
        ids, item = meta[3 : 3 + n_docs], meta[3 + n_docs : 3 + 2 * n_docs]
        size = meta[3 + 2 * n_docs :]
        held, items = _from_own(own["items"])
        parts = sorted((r for r in rows if r["meta"] is None), key=lambda r: r["bucket"])
        join = lambda name, kind: np.concatenate(
            [np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in parts)]
        )
        keys, level = join("keys", np.uint64), join("levels", np.uint8)
        # which of the chunk's shingles, in order of hash and so bucket by bucket, are shared
        shared = np.concatenate([np.zeros(0, bool), *(_from_flags(r["items"]) for r in parts)])
        owner = items[np.repeat(shared, held)]
        keys, level = np.repeat(keys, held[shared]), np.repeat(level, held[shared])
        s = np.bincount(owner, minlength=n_items)
        able = (size > 0) & (100 * s >= percent * size)
        keep = able[owner] if len(owner) else np.zeros(0, bool)
        keys, owner, level = keys[keep], owner[keep], level[keep]
        order = np.lexsort((keys, level, owner))
        keys, owner = keys[order], owner[order]
        fp1, fp2 = _set_marks(keys, owner, n_items)
        edges = np.searchsorted(owner, np.arange(n_items + 1))
        by_item = np.argsort(item, kind="stable")
        cuts = np.searchsorted(item[by_item], np.arange(n_items + 1))
        return pa.Table.from_arrays(
            [
                pa.array(item_numbers(own["chunk"], n_items)),
                pa.array(
                    [np.sort(ids[by_item[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)],
                    pa.list_(pa.int64()),
                ),
                pa.array(size.astype(np.int64)),
                pa.array(s.astype(np.int64)),
                pa.array(fp1.view(np.int64)),
                pa.array(fp2.view(np.int64)),
                pa.array(
                    [
                        keys[a:b].tobytes() if able[i] else None
                        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
                    ],
                    pa.binary(),
                ),
            ],
            ["item", "doc_ids", "n", "s", "fp1", "fp2", "keys"],
        )

    return run


def _entries(percent: int):
    """Index entries of nodes: the prefix that any linking set must meet.

    ``rest`` is how many of the set's shared shingles stand at ``place`` or behind
    it.  Sizes fall into blocks of which two that link differ by one at most, and
    into ``FINE`` parts of each; the parts that an entry can meet, from its own
    size up, end where ``rest`` no longer makes enough in common (``last``).
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        step = math.log(100 / percent) * 1.0001  # sizes that can link differ by one block at most
        for batch in batches:
            node = batch.column(0).to_numpy()
            n, s = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            keys = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            length = s - -(-percent * n // 100) + 1
            total = int(length.sum())
            at = np.repeat(np.arange(len(n)), length)
            place = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
            part = lambda x: np.floor(np.log(np.maximum(x, 1)) / step * FINE).astype(np.int32)
            rest = s[at] - place
            # n + other <= (100 + percent) * rest / percent, and other <= 100 * n / percent
            most = np.minimum(rest * (100 + percent) // percent - n[at], 100 * n[at] // percent)
            last = np.where(most >= n[at], part(most), -1)
            taken = [k[:x] for k, x in zip(keys, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.int64), *taken])),
                    pa.array(node[at]), pa.array(n[at]), pa.array(s[at]), pa.array(rest),
                    pa.array((part(n) // FINE)[at]), pa.array(part(n)[at]), pa.array(last.astype(np.int32)),
                ],
                ["key", "node", "n", "s", "rest", "block", "fine", "last"],
            )

    return run


def _overlaps(batches) -> Iterator:
    """Pairs of nodes with both sets: how much these have in common."""
    import pyarrow as pa

    for batch in batches:
        both = [
            len(np.intersect1d(
                np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True
            ))
            for x, y in zip(batch.column(2), batch.column(3), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(both, pa.int64())], ["a", "b", "common"]
        )


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, common) of the given pairs of nodes, from their sets."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("keys").alias(f"k_{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "k_a", "k_b").mapInArrow(_overlaps, "a long, b long, common long")


def _sizes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda x: nodes.select(
        F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}")
    )
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _link(common, percent: int):
    return common * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def _linked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, common) of the pairs whose sets link, each compared in full."""
    found = _sizes(_compared(pairs, nodes), nodes)
    return found.where(_link(F.col("common"), percent)).select("a", "b", "common")


def _derived(pairs: DataFrame, nodes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs that link, by answers of a very similar set where there is one.

    The lead of ``a`` is the set it links to that most others link to.  What the
    lead has in common with ``b`` is worked out once for all sets that it leads;
    what ``a`` has in common with ``b`` differs from it by no more than the lead's
    own part and ``a``'s own part.  Only pairs that these bounds leave open are
    compared themselves.
    """
    ways = links.select(F.col("a").alias("node"), F.col("b").alias("lead"), "common").unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("lead"), "common")
    )
    degree = ways.groupBy("lead").agg(F.count("*").alias("degree"))
    leads = (
        ways.join(degree, "lead").groupBy("node")
        .agg(F.max(F.struct("degree", "common", (-F.col("lead")).alias("back"))).alias("m"))
        .where("m.degree > 1")
        .select(F.col("node").alias("a"), (-F.col("m.back")).alias("lead"), F.col("m.common").alias("with_lead"))
    )
    sized = _sizes(pairs, nodes).join(leads, "a", "left")
    asked = sized.where("lead is not null").select(F.col("lead").alias("a"), "b").distinct()
    answers = staged(_compared(asked, nodes), "answers")
    lead_sizes = nodes.select(F.col("node").alias("lead"), F.col("s").alias("s_lead"))
    known = answers.select(F.col("a").alias("lead"), "b", F.col("common").alias("lead_common"))
    judged = staged(
        sized.join(lead_sizes, "lead", "left").join(known, ["lead", "b"], "left").select(
            "a", "b",
            F.coalesce(_link(F.col("lead_common") - (F.col("s_lead") - F.col("with_lead")), percent), F.lit(False))
            .alias("sure"),
            F.coalesce(~_link(F.col("lead_common") + (F.col("s_a") - F.col("with_lead")), percent), F.lit(False))
            .alias("never"),
        ),
        "judged",
    )
    open_ = _linked(judged.where("not sure and not never"), nodes, percent)
    return judged.where("sure").select("a", "b").unionByName(open_.select("a", "b"))


def _open_lists(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of the lists on which different components meet, with their component."""
    placed = entries.join(labels.select("node", "root"), "node")
    meeting = (
        placed.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high")
        .select("key")
    )
    return staged(placed.join(meeting, "key", "left_semi"), "open")


def _pivot_pairs(left: DataFrame, turn: int) -> DataFrame:
    """Every set with a few pivots of other components, those most in common with it."""
    # Sets with little of their own lie in the middle of a group: most link to them.
    # Each draw looks at another half of the list.
    drawn = [
        F.min(
            F.struct(
                F.pmod(F.xxhash64("node", F.lit(turn * PIVOTS + i)), F.lit(2)),
                F.col("n") - F.col("s"), "node", "root",
            )
        )
        for i in range(PIVOTS)
    ]
    pivots = (
        left.groupBy("key", "block")
        .agg(
            F.max("root").alias("high"), F.min("root").alias("low"),
            F.array_distinct(F.array(*drawn)).alias("drawn"),
        )
        .where("low < high")
        .select("key", "block", F.explode("drawn").alias("d"))
        .select("key", "block", F.col("d.node").alias("pivot"), F.col("d.root").alias("other"))
    )
    by_common = Window.partitionBy("node").orderBy(F.desc("common"), "pivot")
    return (
        left.join(pivots, ["key", "block"])
        .where("root != other")
        .groupBy("node", "pivot").agg(F.count("*").alias("common"))
        .withColumn("rank", F.row_number().over(by_common))
        .where(F.col("rank") <= COMPARED)
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )


def _meeting_pairs(left: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets of different components that the index can't rule out.

    An entry skips all blocks of a list whose sizes its position rules out, before
    any join.  Long blocks are split by salt; who asks them asks every split.
    """
    index = left.select(
        "key", F.col("fine").alias("block"), F.col("node").alias("node2"), F.col("n").alias("n2"),
        F.col("rest").alias("rest2"), F.col("root").alias("root2"),
    )
    parts = index.groupBy("key", "block").agg(
        F.ceil(F.count("*") / SPLIT).cast("int").alias("splits"),
        F.min("root2").alias("low"), F.max("root2").alias("high"),
    )
    index = index.join(parts.where("splits > 1").select("key", "block", "splits"), ["key", "block"], "left")
    index = index.withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("node2"), F.col("splits")), F.lit(0)).cast("int")
    ).drop("splits")
    ask = (
        left.where("last >= fine")
        .select("key", "node", "n", "rest", "root", F.explode(F.sequence("fine", "last")).alias("block"))
        .join(parts, ["key", "block"])
        .where("root != low or root != high")
        .select("key", "block", "node", "n", "rest", "root", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"))
    )
    met = ask.join(index, ["key", "block", "salt"]).where(
        (F.col("root") != F.col("root2"))
        & ((F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("node") < F.col("node2"))))
        # at the first entry in common, what lies behind it on either side must be enough
        & (F.least("rest", "rest2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)
    )
    return met.select(
        F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")
    ).distinct()


def jaccard_classes(
    df: DataFrame, *, width: int = WIDTH, percent: int = 80, bucket_bytes: int = 256 << 10
) -> DataFrame:
    """Set size and component of every document of ``df(doc_id, text)``.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable
    by links.  Null or empty text, or one without words, has an empty set and is
    linked with nothing.  A very long text is one row of its own chunk.  Repeated rows stay rows of their own with the same
    component.  A null id stays null; its component is the smallest id of its
    class, null if it has none.  Other columns are not read, so clashing names
    don't matter.  Chunks are numbered by partition and order: where ``df`` comes
    out of a shuffle, stage it first.
    """
    bits = max(8, math.ceil(math.log2(buckets_for(df, bucket_bytes))))
    items = staged(
        _pack(df, bits, width)
        .groupBy("bucket").applyInArrow(_shared, SHARED)
        .groupBy("chunk").applyInArrow(_items(percent), ITEMS),
        "items",
    )
    able = items.where("keys is not null")
    # 8n <= 9s at 0.8: any two such sets with the same shared part link
    core = F.col("n") * 2 * percent <= F.col("s") * (100 + percent)
    heads = (
        able.where(core)
        .groupBy("fp1", "fp2", "s")
        .agg(F.min(F.struct("n", "item")).alias("head"))
        .select("fp1", "fp2", "s", F.col("head.item").alias("head"))
    )
    member = staged(
        able.where(core).select("item", "fp1", "fp2", "s", "doc_ids")
        .join(heads, ["fp1", "fp2", "s"])
        .select("item", F.col("head").alias("node"), F.col("doc_ids")[0].alias("least"))
        .unionByName(
            able.where(~core).select(
                "item", F.col("item").alias("node"), F.col("doc_ids")[0].alias("least")
            )
        ),
        "members",
    )
    least = member.groupBy("node").agg(F.min("least").alias("value"))
    nodes = staged(
        able.join(least.select(F.col("node"), "value"), F.col("item") == F.col("node"))
        .select("node", "n", "s", "keys", "value"),
        "nodes",
    )
    entries = staged(
        nodes.select("node", "n", "s", "keys").mapInArrow(
            _entries(percent), "key long, node long, n long, s long, rest long, block int, fine int, last int"
        ),
        "entries",
    )
    labels, links = nodes.select("node", "value", F.col("node").alias("root")), None
    for turn in range(TURNS):
        left = _open_lists(entries, labels)
        if left.isEmpty():
            break
        pairs = staged(_pivot_pairs(left, turn), "pairs")
        found = staged(_linked(pairs, nodes, percent), "links")
        dropped(left, pairs)
        links = found if links is None else links.unionByName(found)
        labels = staged(least_labels(nodes.select("node", "value"), links), "components")

    # What is left: pairs of sets from different components, all of them.
    left = _open_lists(entries, labels)
    if not left.isEmpty():
        pairs = staged(_meeting_pairs(left, percent), "pairs")
        more = staged(_derived(pairs, nodes, links, percent), "links")
        dropped(left, pairs)
        if not more.isEmpty():
            every = links.select("a", "b").unionByName(more)
            labels = staged(least_labels(nodes.select("node", "value"), every), "components")
    dropped(entries)

    found = member.join(labels, "node").select("item", F.col("value").alias("component"))
    joined = items.drop("keys").join(found, "item", "left")
    doc = joined.select("n", "component", F.col("doc_ids")[0].alias("least"), F.explode("doc_ids").alias("id"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "least"))
    known = lambda c: F.when(c != NO_ID, c)
    return doc.select(
        known(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        known(component).alias("component_id"),
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


OP5_SQL = r"""
with recursive docs as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct r, array_to_string(w[i : i + 4], ' ') as g
  from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)
), sizes as (
  select r, count(*) as n from shingles group by r
), common as (
  select a.r as a, b.r as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.r < b.r group by all
), links as (
  select a, b from common join sizes x on a = x.r join sizes y on b = y.r
  where 100 * common.n >= 80 * (x.n + y.n - common.n)
), both_ways as (
  select a, b from links union all select b, a from links
), reach(r, o) as (
  select r, r from docs
  union
  select reach.r, b from reach join both_ways on reach.o = a
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id
from docs d left join sizes using (r)
join (select reach.r, min(e.doc_id) as component_id from reach join docs e on e.r = reach.o group by reach.r) c on c.r = d.r
"""
