import pytest

from lexicrate import DuplicateCap, Length, Lowercase, Ngram, Regex, Snowball, Stopwords, TokenizerConfig, UnicodeWord, Whitespace
from lexicrate.config import BM25Config, Bm25F, Bm25T, FieldWeight, MaxScore, NoOp, Porter, parse, plain
from lexicrate.errors import TokenizerError
from lexicrate.functions.analysis import analyze, native_tokens
from lexicrate.functions.codec import decode_deltas, encode_deltas
from lexicrate.functions.stemming import english, french, german, spanish
from lexicrate.functions.stopwords import stopwords, supported_stopword_languages


def tokens(spark, text, tokenizer=Whitespace(), *filters, stemmer=NoOp(), **kw):
    df = spark.createDataFrame([(text,)], "text string")
    return analyze(df, TokenizerConfig(tokenizer, filters, stemmer, **kw)).first()["tokens"]


def test_tokenizers(spark):
    assert tokens(spark, "  Auth-service down now\n") == ["Auth-service", "down", "now"]
    assert tokens(spark, "auth-service v2", Regex("[A-Za-z]+")) == ["auth", "service", "v"]
    assert tokens(spark, "auth-service 10.1.2.7 can't U.S. foo_bar ... हिन्दी", UnicodeWord()) == [
        "auth", "service", "10.1.2.7", "can't", "U.S", "foo_bar", "हिन्दी",
    ]
    assert tokens(spark, "abc", Ngram(2, 3)) == ["ab", "bc", "abc"]
    assert tokens(spark, "ab", Ngram(3, 4)) == []
    assert tokens(spark, "a b-c", Ngram(2, 3, "Word")) == ["a b", "b c", "a b c"]
    assert tokens(spark, None) == []
    with pytest.raises(TokenizerError):
        tokens(spark, "a", Regex("["))


def test_filters_in_order(spark):
    text = "The the cat THE a bb ccc dddd cat cat"
    assert tokens(spark, text, Whitespace(), Stopwords("en")) == ["The", "cat", "THE", "bb", "ccc", "dddd", "cat", "cat"]
    assert tokens(spark, text, Whitespace(), Lowercase(), Stopwords("en"), Length(2, 3)) == ["cat", "bb", "ccc", "cat", "cat"]
    assert tokens(spark, text, Whitespace(), DuplicateCap(1), Lowercase()) == ["the", "the", "cat", "the", "a", "bb", "ccc", "dddd"]
    assert tokens(spark, text, Whitespace(), Stopwords("xx"), min_token_len=4) == ["dddd"]


def test_stemmers(spark):
    assert tokens(spark, "running flies generously", Whitespace(), stemmer=Porter()) == ["run", "fli", "generous"]
    assert tokens(spark, "trabajadores", Whitespace(), stemmer=Snowball("es")) == ["trabaj"]
    assert tokens(spark, "running", Whitespace(), stemmer=Snowball("??")) == ["run"]
    samples = {
        english: "consigned consign knightly knight generously generous hopping hop hoping hope relational relat skies sky "
        "cries cri dying die national nation controlled control conditional condit by by proceed proceed",
        german: "aufeinander aufeinand kategorischen kategor aufgeklärt aufgeklart häuser haus freundlichkeit freundlich",
        spanish: "cheques chequ torneado torn torpedeado torped tórax torax química quimic rápidamente rapid",
        french: "continuellement continuel continuité continu majestueusement majestu maintenir mainten maladie malad majorité major",
    }
    for stem, text in samples.items():
        words = text.split()
        assert [stem(w) for w in words[::2]] == words[1::2]


def test_native_form_refuses_python_steps():
    with pytest.raises(TokenizerError):
        native_tokens(None, TokenizerConfig(stemmer=Porter()))


def test_stopwords():
    assert len(supported_stopword_languages()) == 21
    assert all(6 <= len(stopwords(x)) <= 9 for x in supported_stopword_languages())
    assert stopwords("xx") == ()


def test_config_round_trip():
    config = BM25Config(
        Bm25T(term_k1={"a": 2.0}), TokenizerConfig(Ngram(2, 4), (Lowercase(), Length(2, 9)), Snowball("fr")), MaxScore()
    )
    assert BM25Config.from_mapping(plain(config)) == config
    assert parse({"F": {"k1": 1.0, "b": 0.5, "fields": [{"name": "t", "weight": 2.0, "b": 0.5}]}}) == Bm25F(1.0, 0.5, (FieldWeight("t", 2.0, 0.5),))
    assert plain(BM25Config().scoring) == {"Okapi": {"k1": 1.2, "b": 0.75}}
    assert TokenizerConfig.from_mapping({}).filters == (Lowercase(),)
    with pytest.raises(ValueError):
        parse("Unheard")


def test_codec():
    for values in ([], [5], [1, 127, 128, 300, 70_000, 2**32 - 1]):
        assert decode_deltas(encode_deltas(values)) == values
    assert len(encode_deltas([127])) == 1 and len(encode_deltas([128])) == 2
    with pytest.raises(ValueError):
        encode_deltas([2, 1])
