"""The tables that make up an index, and what is counted from them.

========  =====================================================================
docs      doc_id, external_id, text, fields, tokens, doc_len
postings  term, doc_id, doc_len, tf, positions
terms     term, term_id, doc_freq, collection_freq, max_tf
blocks    term, block_no, start_doc_id, end_doc_id, max_tf, n
========  =====================================================================
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TokenizerConfig
from ..functions.analysis import analyze, token_chunks

BLOCK = 64
MAX_TF = 65_535
#: Documents of one slice when a term's postings are numbered.
SLICE = 1 << 14


def _with_starts(df: DataFrame, part: str, out: str, at: Column, base: int = 0) -> DataFrame:
    """Numbers rows by their place ``at`` in their part, behind all rows of the parts before."""
    sizes = df.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = df.withColumn("_place", at).join(starts, part)
    return numbered.withColumn(out, F.col("_place") + F.col("_start") + base).drop(
        "_place", "_start", part
    )


def number_rows(df: DataFrame, out: str = "doc_id", base: int = 0) -> DataFrame:
    """Dense numbers in the order of the input, without moving rows to one task.

    Rows are numbered within their partition; the partitions' sizes tell where
    each starts.  The tagged rows are kept, as partitions may be cut in another
    way when they are worked out twice.
    """
    tagged = df.withColumn("_at", F.monotonically_increasing_id()).persist()
    parted = tagged.withColumn("_part", F.shiftright("_at", 33))
    at = F.col("_at") - F.shiftleft("_part", 33)
    return _with_starts(parted, "_part", out, at, base).drop("_at")


def number_by(df: DataFrame, key: str, then: str | None = None, out: str = "doc_id") -> DataFrame:
    """Dense numbers in the order of ``key`` (a number) and ``then``, slice by slice of the key."""
    sliced = df.withColumn("_slice", F.floor(F.col(key) / SLICE))
    order = Window.partitionBy("_slice").orderBy(*[c for c in (key, then) if c])
    return _with_starts(sliced, "_slice", out, F.row_number().over(order) - 1)


def full_text(text: Column, fields: Column | None) -> Column:
    """The text with the values of all fields behind it, in the order of their keys."""
    if fields is None:
        return F.coalesce(text, F.lit(""))
    keys = F.array_sort(F.map_keys(fields))
    values = F.transform(keys, lambda k: F.element_at(fields, k))
    return F.concat_ws(" ", F.coalesce(text, F.lit("")), F.array_join(values, " "))


def document_tokens(
    docs: DataFrame, config: TokenizerConfig = TokenizerConfig(), text: str = "text"
) -> DataFrame:
    """``docs`` with tokens and doc_len; field values count as text where there are any."""
    if "fields" in docs.columns:
        merged = docs.withColumn("_text", full_text(F.col(text), F.col("fields")))
        out = analyze(merged, config, "_text").drop("_text")
    else:
        out = analyze(docs, config, text)
    return out.withColumn("doc_len", F.size("tokens").cast("long"))


def occurrences(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, doc_id, doc_len, pos) of all tokens, or of the given terms only.

    ``posexplode_outer`` keeps Catalyst from running the analyzer a second time
    in a filter of its own.
    """
    each = docs.select("doc_id", "doc_len", F.posexplode_outer("tokens").alias("pos", "term"))
    if terms is None:
        return each.where(F.col("term").isNotNull())
    return each.join(terms, "term", "left_semi")


def postings(docs: DataFrame, terms: DataFrame | None = None, positions: bool = False) -> DataFrame:
    """One row per term and document, counted before anything is shuffled."""
    found = occurrences(docs, terms).groupBy("term", "doc_id", "doc_len")
    parts = [F.count("*").alias("tf")]
    if positions:
        parts.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    return found.agg(*parts)


def ids_repeat(docs: DataFrame) -> bool:
    """Whether any doc_id has several rows or is null; counted once, from the ids alone."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


def packed_postings(docs: DataFrame, lists: bool = True, lengths: bool = False) -> DataFrame:
    """Postings packed by term for a batch of documents at a time, before anything is shuffled.

    (term, slice, doc_freq, collection_freq, max_tf, first_doc, first_pos), and with
    ``lists`` also doc_ids and tfs, in the order of doc_id, and with ``lengths`` their
    doc_lens.  A slice is SLICE doc_ids
    wide where they are numbers.  Each doc_id has one row in ``docs``.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [
        T.StructField("term", T.StringType()), T.StructField("slice", T.LongType()),
        T.StructField("doc_freq", T.LongType()), T.StructField("collection_freq", T.LongType()),
        T.StructField("max_tf", T.LongType()), T.StructField("first_doc", kind),
        T.StructField("first_pos", T.LongType()),
    ]
    if lists:
        fields += [T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("tfs", T.ArrayType(T.LongType()))]
        fields += [T.StructField("doc_lens", T.ArrayType(T.LongType()))] if lengths else []
    sliced = isinstance(kind, T.IntegralType)

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for rows, tokens, row in token_chunks(batch, 1):
                ids = rows.column(0)
                order = pc.sort_indices(ids)
                ids, order = ids.take(order), order.to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                cut = pc.fill_null(pc.cast(ids, pa.int64()), 0).to_numpy() // SLICE if sliced else np.zeros(len(ids), np.int64)
                words = tokens.dictionary_encode()
                word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                # sorted by term, document and position; the first of each pair tells its place
                key, at, tf = np.unique(word * len(ids) + place[row], return_index=True, return_counts=True)
                word, doc = np.divmod(key, len(ids))
                new = np.append(True, (np.diff(word) != 0) | (np.diff(cut[doc]) != 0))[: len(key)]
                starts = np.flatnonzero(new)
                if not len(starts):
                    continue
                ends = np.append(starts, len(key)).astype(np.int32)
                pos = at - np.searchsorted(row, row[at])
                columns = [
                    words.dictionary.take(pa.array(word[starts])), pa.array(cut[doc[starts]]),
                    pa.array(np.diff(ends).astype(np.int64)), pa.array(np.add.reduceat(tf, starts)),
                    pa.array(np.maximum.reduceat(tf, starts)), ids.take(pa.array(doc[starts])), pa.array(pos[starts]),
                ]
                if lists:
                    columns += [
                        pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array(doc))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tf)),
                    ]
                    if lengths:
                        length = rows.column(2).take(pa.array(order[doc]))
                        columns.append(pa.ListArray.from_arrays(pa.array(ends), length))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return docs.select("doc_id", "tokens", *["doc_len"] * (lists and lengths)).mapInArrow(run, T.StructType(fields))


def unpacked(packed: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, tf) of packed postings, doc_len if they have it, with the columns ``keep`` in front."""
    names = {"doc_ids": "doc_id", "tfs": "tf", "doc_lens": "doc_len"}
    names = {k: v for k, v in names.items() if k in packed.columns}
    each = packed.select(*keep, F.explode(F.arrays_zip(*names)).alias("_p"))
    return each.select(*keep, *[F.col(f"_p.{k}").alias(v) for k, v in names.items()])


def packed_stats(packed: DataFrame) -> DataFrame:
    """``term_stats`` of packed postings, with the first document of each term and the place in it."""
    return packed.groupBy("term").agg(
        F.sum("doc_freq").alias("doc_freq"), F.sum("collection_freq").alias("collection_freq"),
        F.max(F.least("max_tf", F.lit(MAX_TF))).cast("int").alias("max_tf"),
        F.min_by("first_pos", "first_doc").alias("first_pos"), F.min("first_doc").alias("first_doc"),
    )


def document_stats(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """``term_stats`` of all documents, or of the given terms in them; only counts by batch are shuffled."""
    if ids_repeat(docs):
        return term_stats(postings(docs, terms))
    packed = packed_postings(docs, lists=False)
    if terms is not None:
        packed = packed.join(terms, "term", "left_semi")
    return packed_stats(packed).drop("first_doc", "first_pos")


def numbered_terms(docs: DataFrame) -> DataFrame:
    """All terms with their statistics and numbers; only counts by batch are shuffled."""
    if ids_repeat(docs):
        post = postings(docs, positions=True)
        return with_term_ids(term_stats(post), post)
    stats = packed_stats(packed_postings(docs, lists=False))
    return number_by(stats, "first_doc", "first_pos", "term_id").drop("first_doc", "first_pos")


def term_stats(post: DataFrame) -> DataFrame:
    """Document and collection frequency and greatest tf of every term."""
    return post.groupBy("term").agg(
        F.count("*").alias("doc_freq"),
        F.sum("tf").alias("collection_freq"),
        F.max(F.least("tf", F.lit(MAX_TF))).cast("int").alias("max_tf"),
    )


def with_term_ids(terms: DataFrame, post: DataFrame) -> DataFrame:
    """Numbers the terms by first document, then by first position."""
    first = post.groupBy("term").agg(
        F.min(F.struct("doc_id", F.col("positions")[0].alias("pos"))).alias("_f")
    )
    placed = terms.join(first, "term").select("*", F.col("_f.doc_id").alias("_d"), F.col("_f.pos").alias("_p"))
    return number_by(placed, "_d", "_p", "term_id").drop("_f", "_d", "_p")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n (at least 1), total length and average length of the documents, in one row."""
    sums = docs.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len")
    )
    return sums.select(
        "n_docs",
        F.greatest("n_docs", F.lit(1)).alias("n"),
        "total_len",
        F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs"))
        .otherwise(F.lit(0.0))
        .alias("avgdl"),
    )


def _slice_starts(sizes: DataFrame) -> DataFrame:
    """(term, _slice, _start): the postings of a term before each slice, from rows (term, _slice, _n)."""
    before = Window.partitionBy("term").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.groupBy("term", "_slice").agg(F.sum("_n").alias("_n")).select(
        "term", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )


def ranked_postings(post: DataFrame) -> DataFrame:
    """Postings with their place (from 0) in their term's list, by doc_id.

    A term of the whole corpus is numbered slice by slice of doc_ids; the
    slices' sizes tell where each starts.
    """
    sliced = post.withColumn("_slice", F.floor(F.col("doc_id") / SLICE))
    starts = _slice_starts(sliced.select("term", "_slice", F.lit(1).alias("_n")))
    within = Window.partitionBy("term", "_slice").orderBy("doc_id")
    return (
        sliced.withColumn("_at", F.row_number().over(within) - 1)
        .join(starts, ["term", "_slice"])
        .withColumn("place", F.col("_at") + F.col("_start"))
        .drop("_slice", "_at", "_start")
    )


def _blocks_of(placed: DataFrame, size: int) -> DataFrame:
    return placed.groupBy("term", F.floor(F.col("place") / size).alias("block_no")).agg(
        F.min("doc_id").alias("start_doc_id"), F.max("doc_id").alias("end_doc_id"),
        F.max("tf").alias("max_tf"), F.count("*").alias("n"),
    )


def blocks(post: DataFrame, size: int = BLOCK) -> DataFrame:
    """Range of doc_ids and greatest tf of every ``size`` postings of a term."""
    return _blocks_of(ranked_postings(post), size)


def document_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """``blocks`` of all documents: postings are packed by term and slice for their one shuffle."""
    if ids_repeat(docs) or not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return blocks(postings(docs), size)
    parts = packed_postings(docs, lists=False).select("term", F.col("slice").alias("_slice"), F.col("doc_freq").alias("_n"))
    lists = packed_postings(docs).select("term", F.col("slice").alias("_slice"), F.arrays_zip("doc_ids", "tfs").alias("_p"))
    # a slice holds SLICE postings of a term at most
    whole = lists.groupBy("term", "_slice").agg(F.array_sort(F.flatten(F.collect_list("_p"))).alias("_p"))
    placed = whole.join(_slice_starts(parts), ["term", "_slice"]).select(
        "term", "_start", F.posexplode("_p").alias("_at", "_q")
    )
    return _blocks_of(
        placed.select(
            "term", (F.col("_start") + F.col("_at")).alias("place"),
            F.col("_q.doc_ids").alias("doc_id"), F.col("_q.tfs").alias("tf"),
        ),
        size,
    )
