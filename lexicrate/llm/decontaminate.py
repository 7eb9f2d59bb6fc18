"""Operator 10: benchmark decontamination by winnowing, native to Spark SQL.

From every ten consecutive words, winnowing keeps the least hash of the five-word
grams in them.  Equal ten-word windows keep the same gram, so every shared window
is found through a fingerprint that both sides kept:

1. Fingerprints of all documents are probed against the benchmark's.  This marks
   the candidates and counts words, in one pass with one small shuffle.
2. In the candidates, each shared fingerprint is extended word by word to both
   sides, on the words themselves; runs of ten words or more are hits.

Items of fewer than ten words are one window each, found by their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, staged
from .words import word_array

WINDOW = 10
GRAM = 5
#: Rows and bytes up to which a side may be broadcast; beyond them the join shuffles.
BROADCAST_FINGERPRINTS, BROADCAST_BYTES = 50_000, 32 << 20
BROADCAST_KEYS = 100_000


def _grams(hashes: Column, width: int) -> Column:
    """Hash of every run of ``width`` word hashes."""
    n = F.size(hashes)
    return F.when(
        n >= width,
        F.transform(
            F.sequence(F.lit(1), n - (width - 1)),
            lambda i: F.xxhash64(F.slice(hashes, i, width)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, windows: int) -> Column:
    """The least hash of every ``windows`` consecutive grams; equal ones once."""
    m = F.size(grams)
    return F.when(
        m >= windows,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), m - (windows - 1)),
                lambda i: F.array_min(F.slice(grams, i, windows)),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _places(grams: Column, windows: int) -> Column:
    """The first place (from 0) of the least hash in every window; each place once."""
    m = F.size(grams)
    return F.when(
        m >= windows,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), m - windows),
                lambda i: (
                    i
                    + F.array_position(
                        F.slice(grams, i + 1, windows),
                        F.array_min(F.slice(grams, i + 1, windows)),
                    )
                    - 1
                ).cast("int"),
            )
        ),
    ).otherwise(F.array().cast("array<int>"))


def _all_places(words: Column, width: int) -> Column:
    n = F.size(words)
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(
        F.array().cast("array<int>")
    )


def _at(words: Column, hashes: Column, place: Column, width: int, reach: int) -> Column:
    """A gram with its words and up to ``reach`` words on either side, nearest first."""
    return F.struct(
        F.xxhash64(F.slice(hashes, place + 1, width)).alias("fingerprint"),
        F.lit(width).alias("width"),
        place.cast("long").alias("place"),
        F.slice(words, place + 1, width).alias("middle"),
        F.reverse(
            F.slice(words, F.greatest(place - reach, F.lit(0)) + 1, F.least(place, F.lit(reach)))
        ).alias("left"),
        F.slice(words, place + width + 1, reach).alias("right"),
    )


def _fingerprints(df: DataFrame, keys: list[str], gram: int, window: int, short: list[int]) -> DataFrame:
    """Kept grams of every row of ``df(*keys, text)``, with the words around them.

    ``short``: lengths of items below the window, for which every place counts.
    """
    df = df.select(*keys, word_array(F.col("text")).alias("words"))
    words, hashes, grams = F.col("words"), F.col("hashes"), F.col("grams")
    # A column of its own for each step: an expression inside a lambda runs once an element.
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", _grams(hashes, gram))

    def around(width: int, reach: int):
        return lambda place: _at(words, hashes, place, width, reach)

    kept = [F.transform(_places(grams, window - gram + 1), around(gram, window - gram))]
    kept += [F.transform(_all_places(words, m), around(m, 0)) for m in short]
    return df.select(*keys, F.explode(F.concat(*kept)).alias("g")).select(*keys, "g.*")


def _common(a: Column, b: Column) -> Column:
    """How many leading words agree."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _covered(spans: Column) -> Column:
    """Words in the union of (start, end) spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"),
            F.greatest(s["upto"], x["end"]).alias("upto"),
        ),
        lambda s: s["n"],
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Words of ``docs(doc_id, text)`` that stand in a window of ``items(item_id, text)``.

    Returns one row per document: doc_id, text_hash (xxhash64), n_words, n_hit (words in hit windows),
    n_items and item_ids (items with a window in it), spans (start, end) and
    contaminated.  Null or empty text has no words, and an item without words
    never hits.  Repeated rows and null ids stay rows of their own.  Other
    columns are not read, so clashing names don't matter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select("item_id", "text")
    lengths = [
        r["n"]
        for r in items.select(F.size(word_array(F.col("text"))).alias("n"))
        .where((F.col("n") > 0) & (F.col("n") < window))
        .distinct()
        .collect()  # at most window - 1 rows
    ]
    short = sorted(lengths)

    whole = F.size(word_array(F.col("text"))) >= window
    marks = _fingerprints(items.where(whole), ["item_id"], gram, window, [])
    for m in short:
        exact = items.where(F.size(word_array(F.col("text"))) == m)
        own = _fingerprints(exact, ["item_id"], gram, window, [m])
        marks = marks.unionByName(own)
    # Equal grams with equal surroundings are one row, however many items hold them.
    around = ["fingerprint", "width", "item_middle", "item_left", "item_right"]
    marks = staged(
        marks.select(
            "fingerprint", "width", "item_id", F.col("middle").alias("item_middle"),
            F.col("left").alias("item_left"), F.col("right").alias("item_right"),
        ).groupBy(*around).agg(F.collect_set("item_id").alias("held_by")),
        "marks",
    )
    words_of = F.concat_ws(" ", "item_middle", "item_left", "item_right")
    n_marks, size = marks.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length(words_of) + 16 * F.size("held_by")), F.lit(0))
    ).first()
    few = n_marks <= BROADCAST_FINGERPRINTS and size <= BROADCAST_BYTES
    bounded = F.broadcast if few else (lambda x: x)

    # 1. candidates
    key = ["doc_id", "text_hash"]
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    first = hashed.select(*key, word_array(F.col("text")).alias("words")).select(
        *key,
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    kept = [_minima(F.col("grams"), window - gram + 1)]
    kept += [F.array_distinct(_grams(F.col("hashes"), m)) for m in short]
    probes = first.withColumn("grams", _grams(F.col("hashes"), gram)).select(
        *key, "n_words", F.posexplode_outer(F.concat(*kept) if len(kept) > 1 else kept[0])
    )
    wanted = marks.select(F.col("fingerprint").alias("col")).distinct().withColumn("hit", F.lit(True))
    seen = staged(
        probes.join(bounded(wanted), "col", "left")
        .groupBy(*key)
        .agg(
            F.max("n_words").alias("n_words"),
            F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
            F.max(F.coalesce("hit", F.lit(False))).alias("candidate"),
        ),
        "seen",
    )
    chosen = seen.where("candidate").select(
        F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")
    )
    if chosen.count() <= BROADCAST_KEYS:
        chosen = F.broadcast(chosen)

    # 2. extend what the candidates share
    again = hashed.join(
        chosen,
        F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")),
        "left_semi",
    ).select(*key, "text")
    shared = _fingerprints(again, key, gram, window, short).join(
        bounded(marks), ["fingerprint", "width"]
    )
    left = _common(F.col("left"), F.col("item_left"))
    right = _common(F.col("right"), F.col("item_right"))
    need = F.when(F.size("item_left") + F.size("item_right") + F.col("width") < window, F.col("width"))
    hits = (
        shared.where(F.col("middle") == F.col("item_middle"))
        .withColumn("before", left)
        .withColumn("after", right)
        .where(
            F.col("before") + F.col("width") + F.col("after") >= F.coalesce(need, F.lit(window))
        )
        .groupBy(*key)
        .agg(
            F.collect_set(
                F.struct(
                    (F.col("place") - F.col("before")).cast("long").alias("start"),
                    (F.col("place") + F.col("width") + F.col("after")).cast("long").alias("end"),
                )
            ).alias("spans"),
            F.array_distinct(F.flatten(F.collect_set("held_by"))).alias("item_ids"),
        )
        .select(
            F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"),
            F.array_sort("spans").alias("spans"), F.array_sort("item_ids").alias("item_ids"),
        )
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = seen.join(
        hits,
        F.col("doc_id").eqNullSafe(F.col("h_id"))
        & F.col("text_hash").eqNullSafe(F.col("h_hash")),
        "left",
    ).withColumn("spans", F.coalesce("spans", none))
    out = joined.withColumn("n_hit", _covered(F.col("spans")))
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        "n_hit",
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.col("item_ids"), F.array().cast(hits.schema["item_ids"].dataType)).alias("item_ids"),
        "spans",
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP10_SQL = f"""
with docs as (
  select row_number() over () as r, doc_id, {_WORDS} as w from documents
), items as (
  select item_id, {_WORDS} as w from benchmark
), windows as (
  select distinct item_id, least({WINDOW}, len(w)) as m, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as i from items where len(w) > 0)
), places as (
  select r, i, m, array_to_string(w[i : i + m - 1], ' ') as g
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i
        from docs cross join (select distinct m from windows) where len(w) >= m)
), hits as (
  select p.r, p.i, p.m, p.g from places p semi join windows w on p.m = w.m and p.g = w.g
), words as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from hits) group by r
), found as (
  select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct h.r, w.item_id from hits h join windows w on h.m = w.m and h.g = w.g) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join words using (r) left join found using (r)
"""
