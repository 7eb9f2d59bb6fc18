"""All queries of the engine by name, with the DuckDB SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_sql as sql
from .config import (
    ALL_SCORERS,
    BlockMaxWand,
    DuplicateCap,
    ExhaustiveDAAT,
    ExhaustiveTAAT,
    Length,
    Lowercase,
    MaxScore,
    Ngram,
    NoOp,
    Okapi,
    Regex,
    Setting,
    Snowball,
    Stopwords,
    TfIdf,
    TokenizerConfig,
    UnicodeWord,
    Wand,
    Whitespace,
)
from .functions.analysis import analyze, ngram_counts, stemmed_terms
from .operators import expansion, fusion
from .operators.metrics import evaluate, percentile_column
from .operators.search import (
    BooleanQuery,
    PhraseQuery,
    bag_of_words,
    document_frequencies,
    document_vectors,
    narrowed,
    packed_hits,
    query_vector,
    scored,
    search,
    search_boolean,
    search_phrase,
    top_k,
    weighted,
)
from .operators.tables import (
    corpus_stats,
    document_blocks,
    document_tokens,
    numbered_terms,
    occurrences,
    postings,
    term_stats,
)
from .plans.reports import recall_degradation, variant_comparison
from .plans.strategies import budgeted, pruned, retrieve
from .sources.oplog import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = dict(sql.ORACLES)

PROBE = [("that", 1.0), ("was", 1.0), ("for", 2.0)]
TOP = 50


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_table(spark: SparkSession, sf_dir: str, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    docs = document_tokens(table(spark, sf_dir).select("doc_id", "text"), config)
    return docs.select("doc_id", "tokens", "doc_len")


def tokens_of(spark: SparkSession, sf_dir: str, config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    return token_table(spark, sf_dir, config).persist()


def tokens_for(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    """What bag-of-words queries need of the documents."""
    return narrowed(token_table(spark, sf_dir), queries)


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


# -- search: the flagship comes first ----------------------------------------------


def _score_query(scoring: Setting) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        terms = weighted(spark, PROBE)
        found = search(tokens_for(spark, sf_dir, terms), terms, scoring, TOP)
        return found.select("rank", "doc_id", "score")

    return run


for _scoring in ALL_SCORERS:
    QUERIES[f"score_{_scoring.tag.lower()}"] = _score_query(_scoring)


@query("search_batch_benchmark")
def _batch(spark, sf_dir):
    docs = token_table(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    terms = bag_of_words(items)
    found = search(docs, terms, Okapi(), 10, **packed_hits(docs, terms))
    return found.select("query_id", "rank", "doc_id", "score")


def _boolean(name: str, q: BooleanQuery) -> None:
    QUERIES[name] = lambda spark, sf_dir: search_boolean(
        tokens_of(spark, sf_dir), q, Okapi(), TOP
    ).select("rank", "doc_id", "score")


_boolean("search_boolean_must", BooleanQuery(["that", "was"], ["for"]))
_boolean("search_boolean_should", BooleanQuery([], ["que", "was"]))
_boolean("search_boolean_must_not", BooleanQuery(["that", "was"], [], ["with"]))
_boolean("search_boolean_unknown_must", BooleanQuery(["that", "no_such_term"], ["that"]))
_boolean("search_boolean_only_must_not", BooleanQuery([], [], ["that"]))


def _phrase(name: str, q: PhraseQuery) -> None:
    QUERIES[name] = lambda spark, sf_dir: search_phrase(
        tokens_of(spark, sf_dir), q, Okapi(), TOP
    ).select("rank", "doc_id", "score")


_phrase("search_phrase_w1", PhraseQuery(["that", "was"], 1))
_phrase("search_phrase_w5", PhraseQuery(["for", "that", "was"], 5))
_phrase("search_phrase_repeat", PhraseQuery(["que", "que"], 0))


@query("search_weighted")
def _weighted(spark, sf_dir):
    terms = weighted(spark, [("that", 2.0), ("that", 0.5), ("was", -1.0), ("for", 1.25), ("The", 3.0)])
    return search(tokens_for(spark, sf_dir, terms), terms, Okapi(), TOP).select("rank", "doc_id", "score")


# -- strategies ----------------------------------------------------------------------


def _strategy(name: str, strategy: Setting, scoring: Setting = Okapi()) -> None:
    def run(spark, sf_dir):
        terms = weighted(spark, PROBE)
        found = retrieve(tokens_for(spark, sf_dir, terms), terms, strategy, scoring, TOP)
        return found.select("rank", "doc_id", "score")

    QUERIES[name] = run


_strategy("strat_daat_topk", ExhaustiveDAAT())
_strategy("strat_taat_topk", ExhaustiveTAAT())
_strategy("strat_wand_topk", Wand())
_strategy("strat_bmw_topk", BlockMaxWand())
_strategy("strat_maxscore_topk", MaxScore())
_strategy("strat_maxscore_tfidf", MaxScore(), TfIdf())


@query("strat_pruned_topk")
def _pruned(spark, sf_dir):
    terms = weighted(spark, PROBE)
    return pruned(tokens_for(spark, sf_dir, terms), terms, Okapi(), TOP).select("rank", "doc_id", "score")


@query("strat_wand_walk")
def _walk(spark, sf_dir):
    terms = weighted(spark, PROBE)
    found = budgeted(tokens_for(spark, sf_dir, terms), terms, Wand(), Okapi(), TOP)
    return found.select("rank", "doc_id", "score")


@query("strat_bmw_budget")
def _budget(spark, sf_dir):
    terms = weighted(spark, PROBE)
    found = budgeted(tokens_for(spark, sf_dir, terms), terms, BlockMaxWand(200), Okapi(), 10)
    return found.select("rank", "doc_id", "score", "scored_docs")


# -- analysis ------------------------------------------------------------------------


def _vocabulary(name: str, config: TokenizerConfig) -> None:
    def run(spark, sf_dir):
        texts = table(spark, sf_dir).select("doc_id", "text")
        counted = ngram_counts(texts, config)
        if counted is not None:
            return counted
        docs = analyze(texts, replace(config, stemmer=NoOp()))
        words = docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        return stemmed_terms(words, config.stemmer)  # stemming comes last, so counting may come before it

    QUERIES[name] = run


def _only(tokenizer: Setting, *filters: Setting) -> TokenizerConfig:
    return TokenizerConfig(tokenizer, filters)


_vocabulary("tok_whitespace_counts", _only(Whitespace()))
_vocabulary("tok_regex_counts", _only(Regex("[A-Za-z]+"), Lowercase()))
_vocabulary("tok_unicode_counts", _only(UnicodeWord(), Lowercase()))
_vocabulary("tok_char_ngrams", _only(Ngram(2, 3, "Character")))
_vocabulary("tok_word_ngrams", _only(Ngram(2, 3, "Word"), Lowercase()))
_vocabulary("tok_pipeline_default", TokenizerConfig())
for _lang in ("en", "fr", "de", "es"):
    _vocabulary(f"flt_stopwords_{_lang}", _only(Whitespace(), Lowercase(), Stopwords(_lang)))
_vocabulary("flt_length", _only(Whitespace(), Lowercase(), Length(3, 6)))
_vocabulary("flt_duplicate_cap", _only(Whitespace(), Lowercase(), DuplicateCap(3)))
for _lang in ("en", "fr", "de", "es"):
    _vocabulary(
        f"stem_snowball_{_lang}",
        TokenizerConfig(UnicodeWord(), (Lowercase(), Stopwords(_lang)), Snowball(_lang)),
    )


# -- index tables ----------------------------------------------------------------------


@query("idx_doc_lengths")
def _lengths(spark, sf_dir):
    return document_tokens(table(spark, sf_dir).select("doc_id", "text")).select("doc_id", "doc_len")


@query("idx_term_stats")
def _terms(spark, sf_dir):
    docs = document_tokens(table(spark, sf_dir).select("doc_id", "text"))
    return term_stats(postings(docs)).withColumn("max_tf", F.col("max_tf").cast("long"))


@query("idx_term_ids")
def _term_ids(spark, sf_dir):
    return numbered_terms(token_table(spark, sf_dir)).select("term", "term_id", "doc_freq")


@query("idx_postings")
def _postings(spark, sf_dir):
    wanted = spark.createDataFrame([("that",), ("was",), ("que",)], "term string")
    docs = document_tokens(table(spark, sf_dir).select("doc_id", "text"))
    found = postings(docs, F.broadcast(wanted), positions=True)
    return found.select(
        "term", "doc_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions")
    )


@query("idx_corpus_stats")
def _corpus(spark, sf_dir):
    docs = tokens_of(spark, sf_dir)
    words = occurrences(docs).agg(F.count_distinct("term").alias("vocabulary_size"))
    return corpus_stats(docs).crossJoin(words).select(  # two rows of one
        "n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"), "vocabulary_size"
    )


@query("idx_blocks")
def _blocks(spark, sf_dir):
    return document_blocks(token_table(spark, sf_dir))


# -- changes -----------------------------------------------------------------------------


def _after_delete(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    gone = docs.where(F.col("doc_id") % 7 == 0).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


@query("delete_then_search")
def _delete(spark, sf_dir):
    docs = document_tokens(_after_delete(spark, sf_dir)).persist()
    return search(docs, weighted(spark, PROBE), Okapi(), TOP).select("rank", "doc_id", "score")


@query("compact_stats")
def _compact(spark, sf_dir):
    docs = document_tokens(_after_delete(spark, sf_dir)).persist()
    stats = term_stats(postings(docs))
    sums = stats.agg(
        F.count("*").alias("vocabulary_size"), F.sum("doc_freq").alias("total_terms"),
        F.max("max_tf").cast("long").alias("max_tf"),
    )
    return corpus_stats(docs).crossJoin(sums).select(  # two rows of one
        "n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"), "vocabulary_size", "total_terms", "max_tf"
    )


@query("wal_replay_search")
def _replay(spark, sf_dir):
    """A log that deletes every 7th document, inserts some of them again, and adds conversations."""
    docs = table(spark, sf_dir).select(F.col("doc_id").cast("string").alias("external_id"), "text")
    number = F.col("external_id").cast("long")
    deletes = docs.where(number % 7 == 0).select("external_id", F.lit(None).cast("string").alias("text"), number.alias("seq"))
    again = docs.where(number % 14 == 0).select("external_id", F.lit("that was for").alias("text"), (number + 10_000_000).alias("seq"))
    said = table(spark, sf_dir, "conversations").where(F.col("turn") == 0)
    new = said.select(
        F.concat(F.lit("c-"), "conv_id").alias("external_id"), "text", (F.col("conv_id") + 20_000_000).alias("seq")
    )
    more, gone = fold(deletes.unionByName(again).unionByName(new), docs.select("external_id"))
    left = docs.join(gone, "external_id", "left_anti").unionByName(more)
    tokens = document_tokens(left).withColumnRenamed("external_id", "doc_id").persist()
    return search(tokens, weighted(spark, PROBE), Okapi(), TOP).select("rank", "doc_id", "score")


# -- expansion ------------------------------------------------------------------------------

FEEDBACK = 10


def _feedback(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The probe query, and the terms of its best documents, which alone are read in full."""
    terms = weighted(spark, PROBE)
    best = search(tokens_for(spark, sf_dir, terms), terms, Okapi(), FEEDBACK).select("query_id", "doc_id")
    found = document_tokens(table(spark, sf_dir).select("doc_id", "text").join(F.broadcast(best), "doc_id"))  # FEEDBACK rows
    found = found.select("query_id", "doc_id", "tokens").persist()  # FEEDBACK rows, used several times
    # not explode: its filter on the tokens would go below the join, and analyze every document
    each = found.select("query_id", "doc_id", F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull())
    counts = each.groupBy("query_id", "doc_id", "term").agg(F.count("*").cast("double").alias("weight"))
    return terms, counts


def _expansion(name: str, expand: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark, sf_dir):
        terms, counts = _feedback(spark, sf_dir)
        out = expand(terms, counts).groupBy("term").agg(F.sum("weight").alias("weight"))
        return out.select("term", F.round("weight", 6).alias("weight"))

    QUERIES[name] = run


_expansion("expand_rm3", expansion.rm3)
_expansion("expand_rocchio", expansion.rocchio)
_expansion("expand_bo1", expansion.bo1)


@query("expand_synonym")
def _synonym(spark, sf_dir):
    pairs = spark.createDataFrame([("that", "which"), ("that", "who"), ("was", "is")], "term string, synonym string")
    out = expansion.synonyms(weighted(spark, PROBE), pairs, 0.4)
    return out.select("term", F.round("weight", 6).alias("weight"))


@query("expand_prf")
def _prf(spark, sf_dir):
    terms, counts = _feedback(spark, sf_dir)
    docs = token_table(spark, sf_dir)
    stats = document_frequencies(docs, counts)
    out = expansion.pseudo_relevance(terms, counts, stats, docs.count(), ["of", "the"])
    return out.select("term", F.round("weight", 6).alias("weight"))


# -- fusion -------------------------------------------------------------------------------


def _two_lists(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    terms = weighted(spark, PROBE)
    docs = tokens_for(spark, sf_dir, terms)
    return tuple(
        search(docs, terms, s, TOP).select("query_id", "doc_id", "score", F.col("rank").alias("pos"))
        for s in (Okapi(), TfIdf())
    )


@query("fuse_rrf")
def _rrf(spark, sf_dir):
    return top_k(fusion.rrf(*_two_lists(spark, sf_dir)), 1000).select("rank", "doc_id", "score")


@query("fuse_linear")
def _linear(spark, sf_dir):
    both = fusion.linear_combination(*_two_lists(spark, sf_dir), alpha=0.6)
    return top_k(both, 1000).select("rank", "doc_id", "score")


def _normalizer(name: str, column: Callable) -> None:
    def run(spark, sf_dir):
        first, _ = _two_lists(spark, sf_dir)
        return first.select("doc_id", F.round(column(), 6).alias("score"))

    QUERIES[name] = run


_normalizer("norm_minmax", fusion.min_max)
_normalizer("norm_zscore", fusion.z_score)
_normalizer("norm_cdf", fusion.cdf)


# -- evaluation ----------------------------------------------------------------------------


def _judged(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three one-term queries, their best documents, and the good ones as relevant."""
    names = [(1, "that"), (2, "was"), (3, "que"), (4, "no_such_term")]
    terms = spark.createDataFrame([(i, t, 1.0) for i, t in names], "query_id long, term string, weight double")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    ids = terms.select("query_id")
    return ids, terms, good.join(F.broadcast(ids))  # four queries


@query("metrics_by_query")
def _metrics(spark, sf_dir):
    ids, terms, qrels = _judged(spark, sf_dir)
    found = search(tokens_for(spark, sf_dir, terms), terms, Okapi(), 20)
    out = evaluate(ids, found, qrels, 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "ap", "recall", "precision", "mrr")])


@query("variant_comparison")
def _variants(spark, sf_dir):
    ids, terms, qrels = _judged(spark, sf_dir)
    out = variant_comparison(tokens_for(spark, sf_dir, terms), terms, qrels)
    return out.select("variant", *[F.round(c, 6).alias(c) for c in ("ndcg", "ap", "recall", "precision", "mrr")])


@query("recall_degradation")
def _degradation(spark, sf_dir):
    terms = weighted(spark, PROBE)
    return recall_degradation(tokens_for(spark, sf_dir, terms), terms, ks=(1, 5, 10), budget=100)


@query("latency_percentiles")
def _latency(spark, sf_dir):
    values = table(spark, sf_dir, "events").groupBy("event_type").agg(F.collect_list("value").alias("v"))
    return values.select(
        "event_type", *[percentile_column(F.col("v"), p).alias(f"p{n}") for n, p in ((50, 0.5), (95, 0.95), (99, 0.99), (999, 0.999))]
    )


# -- vectors and export ------------------------------------------------------------------------


@query("sparse_query_vector")
def _query_vector(spark, sf_dir):
    docs = token_table(spark, sf_dir)
    terms = numbered_terms(docs)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = query_vector(docs, bag_of_words(items), terms)
    return out.select("query_id", "term_id", F.round("weight", 6).alias("weight"))


@query("sparse_doc_vector")
def _doc_vector(spark, sf_dir):
    return document_vectors(token_table(spark, sf_dir))


@query("export_corpus")
def _export(spark, sf_dir):
    docs = table(spark, sf_dir)
    return docs.select(
        F.to_json(
            F.struct(F.col("doc_id").cast("string").alias("_id"), F.lit(None).cast("string").alias("title"), "text"),
            {"ignoreNullFields": "false"},
        ).alias("line")
    )


@query("scored_documents")
def _all_scores(spark, sf_dir):
    terms = weighted(spark, PROBE)
    out = scored(tokens_for(spark, sf_dir, terms), terms, Okapi())
    return out.select("doc_id", F.round("score", 6).alias("score"))
