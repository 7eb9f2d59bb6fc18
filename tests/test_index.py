import json
import math

import pytest

from lexicrate import (
    BlockMaxWand,
    BM25Config,
    BM25Index,
    BooleanQuery,
    ExhaustiveDAAT,
    Lowercase,
    MaxScore,
    PhraseQuery,
    Plus,
    TokenizerConfig,
    Wand,
    WeightedQuery,
    Whitespace,
)
from lexicrate.errors import BadSnapshot, CorruptLog, ExternalIdNotFound, InvalidArgument
from lexicrate.sources.oplog import Delete, Insert, OperationLog

TEXTS = [
    "rust fast search engine", "python search library", "fast rust rust code", "slow python code", "search search engine fast",
]
PLAIN = TokenizerConfig(Whitespace(), (Lowercase(),))


def index(spark, config=BM25Config(tokenizer=PLAIN), docs=TEXTS):
    return BM25Index.from_documents(docs, config, spark)


def okapi(texts, terms):
    split = [t.split() for t in texts]
    n, avgdl = len(split), sum(map(len, split)) / len(split)
    out = []
    for i, words in enumerate(split):
        score = 0.0
        for t, w in terms.items():
            df = sum(t in s for s in split)
            tf = words.count(t)
            if tf:
                idf = max(0.0, math.log(1 + (n - df + 0.5) / (df + 0.5)))
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avgdl)) * w
        if score > 0:
            out.append((f"doc-{i}", round(score, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def hits(found):
    return [(h.doc_id, h.score) for h in found]


def test_search_and_weights(spark):
    i = index(spark)
    assert hits(i.search("Rust search", 10)) == okapi(TEXTS, {"rust": 1, "search": 1})
    assert hits(i.search("rust rust", 1)) == okapi(TEXTS, {"rust": 2})[:1]
    assert hits(i.search_weighted(WeightedQuery([("rust", 2.0), ("code", -1.0), ("Rust", 1.0)]))) == okapi(TEXTS, {"rust": 2})
    assert i.search("unknown") == [] and i.search("rust", 0) == []


@pytest.mark.parametrize("strategy", [ExhaustiveDAAT(), Wand(), BlockMaxWand(), MaxScore(), Wand(1000), BlockMaxWand(1000)])
def test_strategies_agree(spark, strategy):
    i = index(spark, BM25Config(tokenizer=PLAIN, retrieval=strategy))
    assert hits(i.search("fast rust code search", 5)) == okapi(TEXTS, dict.fromkeys(["fast", "rust", "code", "search"], 1))


def test_boolean(spark):
    i = index(spark)
    ids = lambda q: {h.doc_id for h in i.search_boolean(q)}
    assert ids(BooleanQuery(["rust"], ["code"])) == {"doc-0", "doc-2"}
    assert ids(BooleanQuery([], ["python", "engine"], ["slow"])) == {"doc-0", "doc-1", "doc-4"}
    assert ids(BooleanQuery(["rust", "unknown"])) == {"doc-0", "doc-2"}
    assert ids(BooleanQuery(["unknown"])) == set() and ids(BooleanQuery(must_not=["rust"])) == set()
    assert ids(BooleanQuery(["Rust"])) == set()


def test_phrase(spark):
    i = index(spark, docs=["a x b", "b a", "a b c", "a b b x x x c", "a b x x c"])
    ids = lambda t, w: i.phrase_match(t, w)
    assert ids(["a", "b"], 1) == {2, 3, 4} and ids(["a", "b"], 2) == {0, 2, 3, 4}
    assert ids(["b", "b"], 0) == {0, 1, 2, 3, 4}
    assert ids(["a", "unknown"], 5) == set() and ids([], 1) == set()
    # the first place that fits is taken, and no other: 0, then 1, then nothing within 3 of 1
    greedy = index(spark, docs=["a b x b x x c", "a b x b c"])
    assert greedy.phrase_match(["a", "b", "c"], 3) == {1}
    assert {h.doc_id for h in i.search_phrase(PhraseQuery(["a", "b"], 1))} == {"doc-2", "doc-3", "doc-4"}


def test_scorers_are_positive(spark):
    i = index(spark, BM25Config(Plus(), PLAIN))
    assert len(i.search("rust")) == 2 and all(h.score > 0 for h in i.search("rust"))


def test_changes(spark):
    i = index(spark)
    i.delete("doc-0")
    i.delete("doc-0")
    assert len(i) == 4 and i.stats()["tombstones"] == 1 and i.stats()["num_docs"] == 5
    assert {h.doc_id for h in i.search("rust")} == {"doc-2"}
    assert i.postings("rust") == [(0, 1), (2, 2)] and i.doc_length(0) == 4 and i.doc_length(99) is None
    assert i.vocabulary["rust"]["doc_freq"] == 1
    with pytest.raises(ExternalIdNotFound):
        i.delete("nobody")
    with pytest.raises(InvalidArgument):
        i.insert_batch([("doc-0", "again")])
    with pytest.raises(InvalidArgument):
        i.insert_batch([("x", "a"), ("x", "b")])
    i.compact()
    assert i.stats()["num_docs"] == 4 and i.stats()["tombstones"] == 0
    with pytest.raises(InvalidArgument):  # the generated id is taken
        i.insert_batch(["more"])
    i.insert_batch([("doc-0", "rust again"), ("y", "rust")])
    assert {h.doc_id for h in i.search("rust")} == {"doc-2", "doc-0", "y"}


def test_plain_texts_go_in_first(spark):
    i = index(spark, docs=[("id", "a"), "b", "c"])
    assert [r["external_id"] for r in i.docs.orderBy("doc_id").collect()] == ["doc-0", "doc-1", "id"]


def test_vectors_and_fields(spark):
    i = index(spark)
    assert [t for t, _ in i.sparse_vector_for_query("rust unknown")] == [i.vocabulary["rust"]["term_id"]]
    assert sorted(w for _, w in i.sparse_vector_for_document(2)) == [1.0, 1.0, 2.0]
    assert i.sparse_vector_for_document(77) == []
    df = spark.createDataFrame([("d", "body", {"title": "head", "author": "who"})], "id string, text string, fields map<string,string>")
    f = BM25Index.from_dataframe(df, BM25Config(tokenizer=PLAIN), id_col="id", fields_col="fields")
    assert f.phrase_match(["body", "who", "head"], 1) == {0}


def test_save_and_load(spark, tmp_path):
    i = index(spark)
    i.delete("doc-1")
    i.save(str(tmp_path / "index"))
    i.save(str(tmp_path / "index"))
    for mode in ("in_memory", "mmap"):
        j = BM25Index.load(str(tmp_path / "index"), mode, spark)
        assert hits(j.search("search")) == hits(i.search("search")) and j.config == i.config
    i.save_metadata(str(tmp_path / "meta.json"))
    assert json.loads((tmp_path / "meta.json").read_text())["num_documents"] == 4
    with pytest.raises(InvalidArgument):
        BM25Index.load(str(tmp_path / "index"), "other", spark)
    with pytest.raises(BadSnapshot):
        BM25Index.load(str(tmp_path), spark=spark)


def test_terms_of_deleted_documents_stay_known(spark, tmp_path):
    docs = [("a", "rust engine"), ("b", "zebra rust"), ("c", "rust tools")]
    i = index(spark, docs=docs)
    i.delete("b")
    both = BooleanQuery(must=["rust", "zebra"])
    assert i.search_boolean(both) == []
    assert {h.doc_id for h in i.search_boolean(BooleanQuery(must=["rust", "unheard"]))} == {"a", "c"}
    i.save(str(tmp_path / "index"))
    j = BM25Index.load(str(tmp_path / "index"), "mmap", spark)
    assert j.search_boolean(both) == []
    i.compact()
    assert {h.doc_id for h in i.search_boolean(both)} == {"a", "c"}


def test_loaded_index_reads_postings_of_its_buckets_and_no_text(spark, tmp_path):
    i = index(spark, docs=[f"word{k} common text{k % 3}" for k in range(40)])
    i.save(str(tmp_path / "index"))
    j = BM25Index.load(str(tmp_path / "index"), "mmap", spark)
    one = spark.createDataFrame([(0, "word7 common")], "query_id long, text string")
    found = j.search_batch(one)
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    held = [line for line in scans if "tf:" in line or "doc_freq:" in line]
    assert held and all("bucket#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in held)
    assert not any("text:string" in line or "tokens:array" in line for line in scans)
    assert [(r.doc_id, r.rank) for r in found.collect()] == [(r.doc_id, r.rank) for r in i.search_batch(one).collect()]


def test_loaded_index_changes_as_a_fresh_one(spark, tmp_path):
    i = index(spark)
    i.save(str(tmp_path / "index"))
    j = BM25Index.load(str(tmp_path / "index"), "mmap", spark)
    for x in (i, j):
        x.insert_batch([("new", "rust search new"), ("gone", "search")])
        x.delete("doc-0")
        x.delete("gone")
    for query in ("rust", "search", "new rust"):
        assert hits(i.search(query)) == hits(j.search(query))
    phrase, boolean = PhraseQuery(["rust", "search"], 1), BooleanQuery(must=["rust"], must_not=["new"])
    assert hits(i.search_phrase(phrase)) == hits(j.search_phrase(phrase))
    assert i.phrase_match(["rust", "search"]) == j.phrase_match(["rust", "search"])
    assert hits(i.search_boolean(boolean)) == hits(j.search_boolean(boolean))
    assert i.stats() == j.stats() | {"build_timestamp_unix": i.built} and i.vocabulary == j.vocabulary


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    i = index(spark)
    i.save(str(tmp_path / "index"))
    i.enable_wal(path)
    i.insert_batch([("new", "rust new"), "auto rust"])
    i.delete("doc-0")
    with pytest.raises(ExternalIdNotFound):
        i.delete("nobody")
    j = BM25Index.load_with_wal(str(tmp_path / "index"), path, spark=spark)
    assert {h.doc_id for h in j.search("rust")} == {"doc-2", "new", "doc-5"} == {h.doc_id for h in i.search("rust")}
    assert j.replay_wal(path) == 2  # the text without an id again, and the delete of a known id
    j.compact_and_flush(str(tmp_path / "index"))
    assert OperationLog(path).read() == []


def test_damaged_logs(tmp_path):
    path = tmp_path / "log"
    assert OperationLog(str(path)).read() == []
    good = Insert("a", "t", {"k": "v"}).line() + "\n\n" + Delete("a").line() + "\n"
    path.write_text(good + '{"Insert": {"exter')
    assert OperationLog(str(path)).read() == [Insert("a", "t", {"k": "v"}), Delete("a")]
    path.write_text('{"bad"\n' + good)
    with pytest.raises(CorruptLog):
        OperationLog(str(path)).read()
    path.write_text(good + '{"bad"\n')
    with pytest.raises(CorruptLog):
        OperationLog(str(path)).read()
