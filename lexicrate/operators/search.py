"""Search: scoring, the four kinds of queries, and top-k.

All forms work on batches: queries are a table (query_id, term, weight), and
every query gets its own top k.  Statistics are those of all live documents,
also where a boolean or phrase query narrows the candidates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ExhaustiveDAAT, MaxScore, Okapi, Setting, TfIdf, TokenizerConfig
from ..functions.analysis import analyze
from ..functions.scoring import term_score
from .tables import (
    corpus_stats,
    document_stats,
    ids_repeat,
    numbered_terms,
    occurrences,
    packed_postings,
    packed_stats,
    postings,
    term_stats,
    unpacked,
)

DIGITS = 6
#: Up to so many query terms are broadcast; beyond that the join shuffles.
BROADCAST_TERMS = 200_000
#: Up to so many query terms are written into a filter of the tokens.
LITERAL_TERMS = 1000


def effective_strategy(strategy: Setting, scoring: Setting) -> Setting:
    """MaxScore has no use for TfIdf's bounds and runs exhaustively there."""
    if isinstance(strategy, MaxScore) and isinstance(scoring, TfIdf):
        return ExhaustiveDAAT()
    return strategy


@dataclass
class WeightedQuery:
    """Terms with weights, matched as they are."""

    weights: list[tuple[str, float]] = field(default_factory=list)

    def terms(self) -> list[tuple[str, float]]:
        return list(self.weights)

    def normalized(self) -> WeightedQuery:
        """Weights divided by the sum of their absolute values, unless that is 0."""
        total = sum(abs(w) for _, w in self.weights)
        return WeightedQuery([(t, w / total) for t, w in self.weights]) if total else self


@dataclass
class BooleanQuery:
    must: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    must_not: list[str] = field(default_factory=list)


@dataclass
class PhraseQuery:
    terms: list[str] = field(default_factory=list)
    window: int = 1


def bag_of_words(queries: DataFrame, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """(query_id, term, weight) from (query_id, text): every token weighs 1."""
    tokens = analyze(queries.select("query_id", "text"), config)
    return (
        tokens.select("query_id", F.explode("tokens").alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def weighted(spark: SparkSession, terms: list[tuple[str, float]], query_id: int = 0) -> DataFrame:
    """(query_id, term, weight) from pairs: weights of 0 or less drop, repeats add up."""
    merged: dict[str, float] = {}
    for term, weight in terms:
        if weight > 0:
            merged[term] = merged.get(term, 0.0) + float(weight)
    rows = [(query_id, t, w) for t, w in merged.items()]
    return spark.createDataFrame(rows, "query_id long, term string, weight double")


def _hint(df: DataFrame):
    """``F.broadcast`` for tables with no more rows than ``df``, if that is small; counted once."""
    few = df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return F.broadcast if few else (lambda table: table)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where the table is small; its size is counted, not assumed."""
    return _hint(df)(df)


def top_k(scores: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """Ranks 1 to k of every query: by rounded score, then by doc_id; scores of 0 drop."""
    rounded = scores.withColumn("score", F.round("score", digits)).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rounded.withColumn("rank", F.row_number().over(order).cast("long")).where(
        F.col("rank") <= k
    )


def query_postings(docs: DataFrame, wanted: DataFrame, post: DataFrame | None) -> DataFrame:
    """Postings of the wanted terms, counted from the tokens where none are stored."""
    if post is None:
        return postings(docs, wanted)
    return post.join(wanted, "term", "left_semi").select("term", "doc_id", "doc_len", "tf")


def narrowed(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``docs`` with those tokens only that the queries name, kept for several uses.

    doc_len stays that of all tokens, so bags of words score the same; the tokens are
    worked out once, and what is kept holds a few terms.  Queries of very many terms
    leave the tokens as they are.
    """
    names = [r.term for r in queries.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    if len(names) > LITERAL_TERMS:
        return docs.persist()
    return docs.withColumn("tokens", F.filter("tokens", lambda w: w.isin(names))).persist()


def packed_hits(docs: DataFrame, queries: DataFrame) -> dict[str, DataFrame]:
    """``post`` and ``stats`` of the queries' terms for ``scored``, where queries have many terms.

    Postings are counted by batches of documents; nothing is shuffled for them.
    """
    if ids_repeat(docs):
        return {}
    terms = _small(queries.select("term").distinct())
    found = lambda **kw: packed_postings(docs, **kw).join(terms, "term", "left_semi")
    return {"post": unpacked(found(lengths=True), "term"), "stats": packed_stats(found(lists=False))}


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_freq) in all documents of the terms in ``terms``; no other term is shuffled."""
    return document_stats(docs, _small(terms.select("term").distinct())).select("term", "doc_freq")


def scored(
    docs: DataFrame, queries: DataFrame, scoring: Setting = Okapi(),
    candidates: DataFrame | None = None, *, post: DataFrame | None = None,
    stats: DataFrame | None = None,
) -> DataFrame:
    """(query_id, doc_id, score) of all matching documents.

    ``docs(doc_id, tokens, doc_len)``; ``post`` the postings and ``stats`` the term
    statistics where an index has them stored (then ``docs`` needs no tokens).
    Only occurrences of query terms are shuffled.  ``candidates``
    (query_id, doc_id) narrows the documents, not the statistics.
    """
    queries = queries.select("query_id", "term", "weight")
    small = _hint(queries)
    post = query_postings(docs, small(queries.select("term").distinct()), post)
    stats = (term_stats(post) if stats is None else stats).select("term", "doc_freq", "collection_freq")
    corpus = corpus_stats(docs.select("doc_len")).select("n", "avgdl")
    # no more rows than the queries have; one row of corpus statistics
    weighed = small(queries.join(stats, "term").crossJoin(F.broadcast(corpus)))
    hits = post.join(weighed, "term")
    if candidates is not None:
        hits = hits.join(candidates, ["query_id", "doc_id"], "left_semi")
    col = F.col
    part = term_score(
        scoring, term=col("term"), tf=col("tf"), dl=col("doc_len"), avgdl=col("avgdl"),
        n=col("n"), df=col("doc_freq"), cf=col("collection_freq"), w=col("weight"),
    )
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def search(
    docs: DataFrame, queries: DataFrame, scoring: Setting = Okapi(), k: int = 10, **kw
) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best k documents of every query."""
    return top_k(scored(docs, queries, scoring, **kw), k)


def boolean_candidates(
    docs: DataFrame, query: BooleanQuery, every: DataFrame | None = None, post: DataFrame | None = None
) -> DataFrame:
    """doc_ids that a boolean query admits.

    With ``must`` terms, documents that hold all those that are known; a ``must``
    term that is unknown is left out, and if none is left there are no
    candidates.  Known are the terms of ``every`` (all documents of an index,
    deleted ones included, as (doc_id, term)), or else those of ``docs``.
    Without ``must`` terms, documents that hold a ``should`` term.
    """
    names = sorted({*query.must, *query.should, *query.must_not})
    spark = docs.sparkSession
    terms = spark.createDataFrame([(t,) for t in names], "term string")
    if post is None:
        held = occurrences(docs, F.broadcast(terms)).select("doc_id", "term").distinct()
    else:
        held = post.join(F.broadcast(terms), "term", "left_semi").select("doc_id", "term")
    if query.must:
        wanted = F.col("term").isin(sorted(set(query.must)))
        must = held.where(wanted)
        among = must if every is None else every.where(wanted)
        known = among.agg(F.count_distinct("term").alias("known"))
        kept = (
            must.groupBy("doc_id").agg(F.count("*").alias("n"))
            .crossJoin(F.broadcast(known))  # one row
            .where("n = known").select("doc_id")
        )
    elif query.should:
        kept = held.where(F.col("term").isin(sorted(set(query.should)))).select("doc_id").distinct()
    else:
        kept = held.select("doc_id").limit(0)
    if query.must_not:
        out = held.where(F.col("term").isin(sorted(set(query.must_not)))).select("doc_id")
        kept = kept.join(out, "doc_id", "left_anti")
    return kept


def search_boolean(
    docs: DataFrame, query: BooleanQuery, scoring: Setting = Okapi(), k: int = 10,
    every: DataFrame | None = None, **kw,
) -> DataFrame:
    """The best k of the candidates; ``must`` and ``should`` terms score, each as often as named."""
    spark = docs.sparkSession
    terms = weighted(spark, [(t, 1.0) for t in [*query.must, *query.should]])
    kept = boolean_candidates(docs, query, every, kw.get("post"))
    kept = kept.withColumn("query_id", F.lit(0).cast("long"))
    return search(docs, terms, scoring, k, candidates=kept, **kw)


def _positions(tokens: Column, term: str) -> Column:
    at = F.transform(tokens, lambda t, i: F.when(t == term, i))
    return F.filter(at, lambda i: i.isNotNull())


def phrase_match(docs: DataFrame, query: PhraseQuery, post: DataFrame | None = None) -> DataFrame:
    """doc_ids in which the terms stand in order, each within ``window`` of the one before.

    From every place of the first term on, the first place of the next term that
    is not before it is taken, and never another one.  Places come from the
    positions in ``post`` where given, else from the tokens.
    """
    if not query.terms:
        return docs.select("doc_id").limit(0)
    names = sorted(set(query.terms))
    if post is None:
        held = docs.where(F.forall(F.array(*map(F.lit, names)), lambda t: F.array_contains("tokens", t)))
        places = lambda term: _positions(F.col("tokens"), term)
    else:
        held = (
            post.where(F.col("term").isin(names)).groupBy("doc_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("_at"))
            .where(F.size("_at") == len(names))
        )
        places = lambda term: F.element_at("_at", term)
    held = held.withColumn("_found", places(query.terms[0]))
    for term in query.terms[1:]:
        held = held.withColumn("_next", places(term))
        # two uses of _next in one projection keep it a column of its own
        step = F.when(
            F.size("_next") > 0, F.transform("_found", lambda p: _first_within(p, query.window))
        ).otherwise(F.array().cast("array<int>"))
        held = held.withColumn("_found", F.filter(step, lambda p: p.isNotNull()))
    return held.where(F.size("_found") > 0).select("doc_id")


def _first_within(place: Column, window: int) -> Column:
    def fits(q: Column) -> Column:
        return (q >= place) & (q - place <= window)

    return F.array_min(F.filter("_next", fits))


def search_phrase(
    docs: DataFrame, query: PhraseQuery, scoring: Setting = Okapi(), k: int = 10, **kw
) -> DataFrame:
    """The best k matches; the terms score as a bag of words."""
    kept = phrase_match(docs, query, kw.get("post")).withColumn("query_id", F.lit(0).cast("long"))
    terms = weighted(docs.sparkSession, [(t, 1.0) for t in query.terms])
    return search(docs, terms, scoring, k, candidates=kept, **kw)


def query_vector(docs: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term_id, weight): count times idf of the known terms of each query."""
    corpus = corpus_stats(docs.select("doc_len")).select("n")
    known = terms.join(_small(queries), "term").crossJoin(F.broadcast(corpus))
    idf = F.greatest(
        F.lit(0.0), F.log(F.lit(1.0) + (F.col("n") - F.col("doc_freq") + 0.5) / (F.col("doc_freq") + 0.5))
    )
    return known.select("query_id", "term_id", (F.col("weight") * idf).alias("weight"))


def document_vector(post: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term_id, weight): the frequency of each term of the documents."""
    return post.join(terms, "term").select("doc_id", "term_id", F.col("tf").cast("double").alias("weight"))


def document_vectors(docs: DataFrame) -> DataFrame:
    """``document_vector`` of all documents; postings meet their numbers packed by term."""
    terms = numbered_terms(docs).select("term", "term_id")
    if ids_repeat(docs):
        return document_vector(postings(docs), terms)
    found = unpacked(packed_postings(docs).select("term", "doc_ids", "tfs").join(terms, "term"), "term_id")
    return found.select("doc_id", "term_id", F.col("tf").cast("double").alias("weight"))
