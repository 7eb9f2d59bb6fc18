"""Lexical retrieval and text analytics on Spark DataFrames."""

from .config import (
    Adaptive,
    Atire,
    Bm25F,
    Bm25L,
    Bm25T,
    BlockMaxWand,
    BM25Config,
    DuplicateCap,
    ExhaustiveDAAT,
    ExhaustiveTAAT,
    ExpansionConfig,
    FieldWeight,
    FusionConfig,
    Length,
    Lowercase,
    MaxScore,
    Ngram,
    NoOp,
    Okapi,
    PersistConfig,
    Plus,
    Porter,
    Regex,
    Snowball,
    Stopwords,
    TfIdf,
    TokenizerConfig,
    UnicodeWord,
    Wand,
    Whitespace,
)
from .functions.ranked_lists import (
    FusionResult,
    cdf_normalize,
    linear_combination,
    min_max_normalize,
    rrf,
    z_score_normalize,
)
from .index import BM25Index, SearchHit
from .operators.metrics import (
    LatencyProfiler,
    average_precision_at_k,
    mrr,
    ndcg_at_k,
    precision_at_k,
    recall_at_k,
)
from .operators.search import BooleanQuery, PhraseQuery, WeightedQuery

__all__ = [
    "Adaptive", "Atire", "Bm25F", "Bm25L", "Bm25T", "BlockMaxWand", "BM25Config", "BM25Index",
    "BooleanQuery", "DuplicateCap", "ExhaustiveDAAT", "ExhaustiveTAAT", "ExpansionConfig",
    "FieldWeight", "FusionConfig", "FusionResult", "LatencyProfiler", "Length", "Lowercase", "MaxScore", "Ngram",
    "NoOp", "Okapi", "PersistConfig", "PhraseQuery", "Plus", "Porter", "Regex", "SearchHit",
    "Snowball", "Stopwords", "TfIdf", "TokenizerConfig", "UnicodeWord", "Wand", "WeightedQuery",
    "Whitespace", "average_precision_at_k", "cdf_normalize", "linear_combination", "min_max_normalize",
    "mrr", "ndcg_at_k", "precision_at_k", "recall_at_k", "rrf", "z_score_normalize",
]
