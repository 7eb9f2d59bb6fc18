import json
import zipfile

import pytest
from pyspark.sql import functions as F

import lexicrate as lx
from lexicrate.config import BlockMaxWand, BM25Config, FusionConfig, Okapi, Snowball, TokenizerConfig, Wand
from lexicrate.errors import InvalidArgument, TokenizerError
from lexicrate.functions.scoring import field_factor
from lexicrate.config import Bm25F, FieldWeight
from lexicrate.operators import expansion, fusion
from lexicrate.operators.metrics import LatencyProfiler, evaluate, nearest_rank
from lexicrate.operators.search import WeightedQuery, effective_strategy, weighted
from lexicrate.operators.tables import number_rows
from lexicrate.config import ExhaustiveDAAT, MaxScore, TfIdf
from lexicrate.functions.stemming import stemmer_for
from lexicrate.plans.reports import recall_degradation, run_benchmark
from lexicrate.plans import strategies
from lexicrate.plans.strategies import budgeted
from lexicrate.operators.tables import document_tokens
from lexicrate.sources import datasets
from lexicrate.streaming.ingest import ingest, segments, windowed_terms


def test_list_metrics():
    ranked, relevant = ["a", "b", "c"], {"a", "c"}
    assert lx.ndcg_at_k(ranked, relevant, 3) == pytest.approx(1.5 / (1 + 1 / 1.5849625007))
    assert lx.average_precision_at_k(ranked, relevant, 3) == pytest.approx((1 + 2 / 3) / 2)
    assert lx.recall_at_k(ranked, relevant, 1) == 0.5 and lx.precision_at_k(ranked, relevant, 10) == 0.2
    assert lx.mrr(["x", "c"], relevant) == 0.5 and lx.mrr(["x"], relevant) == 0
    assert lx.ndcg_at_k([], relevant, 3) == lx.ndcg_at_k(ranked, set(), 3) == lx.precision_at_k(ranked, relevant, 0) == 0


def test_tables_agree_with_lists(spark):
    lists = {1: ["a", "b", "c", "d"], 2: ["x"], 3: []}
    relevant = {1: {"a", "d", "z"}, 2: set(), 3: {"q"}}
    ranked = spark.createDataFrame(
        [(q, d, i) for q, ds in lists.items() for i, d in enumerate(ds, 1)], "query_id long, doc_id string, rank long"
    )
    qrels = spark.createDataFrame([(q, d) for q, ds in relevant.items() for d in ds], "query_id long, doc_id string")
    ids = spark.createDataFrame([(q,) for q in lists], "query_id long")
    for k in (2, 10):
        for r in evaluate(ids, ranked, qrels, k).collect():
            args = (lists[r.query_id], relevant[r.query_id], k)
            assert r.ndcg == pytest.approx(lx.ndcg_at_k(*args))
            assert r.ap == pytest.approx(lx.average_precision_at_k(*args))
            assert r.recall == pytest.approx(lx.recall_at_k(*args))
            assert r.precision == pytest.approx(lx.precision_at_k(*args))
            assert r.mrr == pytest.approx(lx.mrr(*args[:2]))


def test_profiler():
    p = LatencyProfiler()
    assert p.p50() == 0.0 and len(p) == 0
    for ms in (1.0, 3.0, 2.0):
        p.record(ms)
    assert (p.p50(), p.p95(), p.p999(), len(p)) == (2.0, 3.0, 3.0, 3)
    assert nearest_rank([1, 2, 3, 4], 0.5) == 3
    assert p.profile(lambda: 7) == 7 and len(p) == 4
    with pytest.raises(ValueError):
        p.record(-1)


def test_fusion_of_lists_and_tables(spark):
    a, b = [("x", 3.0), ("y", 1.0)], [("y", 2.0), ("z", 1.0)]
    table = lambda rows: spark.createDataFrame(
        [(0, d, s, i) for i, (d, s) in enumerate(rows, 1)], "query_id long, doc_id string, score double, pos long"
    )
    same = lambda df, rows: {r.doc_id: pytest.approx(r.score) for r in df.collect()} == {r.doc_id: r.score for r in rows}
    assert same(fusion.rrf(table(a), table(b)), lx.rrf(a, b))
    assert same(fusion.linear_combination(table(a), table(b), 0.6), lx.linear_combination(a, b, 0.6))
    assert [r.doc_id for r in lx.rrf(a, b)] == ["y", "x", "z"]
    assert lx.linear_combination(a, b, 7.0)[0] == lx.FusionResult("x", 3.0)
    assert lx.min_max_normalize([1, 3, 2]) == [0, 1, 0.5] and lx.min_max_normalize([2, 2]) == [1, 1]
    assert lx.z_score_normalize([2, 2]) == [0, 0] and sum(lx.z_score_normalize([1, 2, 4])) == pytest.approx(0)
    assert lx.cdf_normalize([5, 1, 5]) == [0.5, 0, 1] and lx.cdf_normalize([3]) == [0] and lx.cdf_normalize([]) == []
    combined = fusion.fuse(table(a), table(b), FusionConfig("LinearCombination", 0.5, "MinMax"))
    assert {r.doc_id: r.score for r in combined.collect()} == {"x": 0.5, "y": 0.5, "z": 0.0}
    with pytest.raises(InvalidArgument):
        fusion.fuse(table(a), table(b), FusionConfig("other"))


def test_queries_and_settings(spark):
    assert WeightedQuery([("a", 1.0), ("b", -3.0)]).normalized().terms() == [("a", 0.25), ("b", -0.75)]
    assert {tuple(r) for r in weighted(spark, [("a", 1.0), ("a", 2.0), ("b", 0.0)]).collect()} == {(0, "a", 3.0)}
    assert effective_strategy(MaxScore(), TfIdf()) == ExhaustiveDAAT()
    assert effective_strategy(MaxScore(), Okapi()) == MaxScore()
    assert field_factor(Bm25F()) == 1.0 and field_factor(Bm25F(fields=(FieldWeight("t", 2.0, 0.5),))) == 2.0 * (0.5 + 0.375)
    df = spark.range(1000).repartition(7)
    assert sorted(r.n for r in number_rows(df, "n", 5).collect()) == list(range(5, 1005))


def test_expansion_by_hand(spark):
    q = spark.createDataFrame([(0, "a", 1.0)], "query_id long, term string, weight double")
    fb = spark.createDataFrame([(0, 1, "a", 2.0), (0, 1, "b", 1.0), (0, 2, "b", 3.0)], "query_id long, doc_id long, term string, weight double")
    weights = lambda df: sorted((r.term, round(r.weight, 6)) for r in df.collect())
    assert weights(expansion.rm3(q, fb, 1, 0.5)) == [("a", round(1 / 3, 6)), ("b", round(2 / 3, 6))]
    assert weights(expansion.rocchio(q, fb, 1.0, 1.0, 1)) == [("a", 1.0)]
    syn = spark.createDataFrame([("a", "s")], "term string, synonym string")
    assert weights(expansion.synonyms(q, syn, 0.5)) == [("a", round(2 / 3, 6)), ("s", round(1 / 3, 6))]


def test_budget_bounds_the_work(spark):
    docs = spark.createDataFrame([(i, "x " * (1 + i % 5) + "y" * (i % 3)) for i in range(200)], "doc_id long, text string")
    tokens = document_tokens(docs)
    terms = weighted(spark, [("x", 1.0), ("y", 1.0)])
    out = budgeted(tokens, terms, Wand(20), Okapi(), 5).collect()
    assert len(out) == 5 and all(r.scored_docs <= 20 for r in out)


def write_dataset(folder):
    folder.mkdir()
    docs = [{"_id": "d1", "title": "Rust", "text": "fast engine"}, {"_id": "d2", "title": None, "text": "slow python"}, {"_id": "d3", "text": "rust code"}]
    (folder / "corpus.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\n\n")
    (folder / "queries.jsonl").write_text(json.dumps({"_id": "q1", "text": "rust"}) + "\n" + json.dumps({"_id": "q2", "text": "python"}) + "\n")
    (folder / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td3\tbad\nq1\td3\t2\nshort\tline\nq2\td2\t0\n")


def test_dataset_and_benchmark(spark, tmp_path):
    write_dataset(tmp_path / "set")
    data = datasets.load_dataset(spark, str(tmp_path / "set"))
    assert sorted(map(tuple, data.qrels.select("query_id", "doc_id", "score").collect())) == [("q1", "d1", 1), ("q1", "d3", 2), ("q2", "d2", 0)]
    report = run_benchmark(data, BM25Config(tokenizer=TokenizerConfig()))
    assert report.num_docs == 3 and report.num_queries == 2
    assert report.means["recall"] == 0.5 and report.means["mrr"] == 0.5 and "ndcg" in report.summary()
    report.write_csv(str(tmp_path / "report"))
    (tmp_path / "set" / "qrels").mkdir()
    (tmp_path / "set" / "qrels" / "dev.tsv").write_text("query-id\tcorpus-id\tscore\nq2\td2\t1\n")
    dev = datasets.load_dataset(spark, str(tmp_path / "set"), split="dev", max_docs=2)
    assert [r.query_id for r in dev.queries.collect()] == ["q2"] and dev.corpus.count() == 2
    with zipfile.ZipFile(tmp_path / "scifact.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(InvalidArgument):
        datasets.local_dataset(str(tmp_path), "scifact")
    with pytest.raises(InvalidArgument):
        datasets.dataset_url("unheard")
    assert len(datasets.KNOWN_DATASETS) == 18 and datasets.dataset_url("scifact").endswith("/scifact.zip")


def test_export(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", {"title": "T"}), ("b", "u", None)], "external_id string, text string, fields map<string,string>")
    datasets.export_corpus(docs.coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"_id": "a", "title": "T", "text": "t"}, {"_id": "b", "title": None, "text": "u"}]


def test_streams(spark, tmp_path):
    schema = "doc_id long, text string, ts timestamp"
    src = str(tmp_path / "in")
    rows = lambda ids: spark.createDataFrame([(i, f"word{i % 2} common") for i in ids], "doc_id long, text string").selectExpr(
        "doc_id", "text", "timestamp_seconds(doc_id * 1800) as ts"
    )
    rows(range(4)).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    ingest(stream(), str(tmp_path / "index")).awaitTermination()
    rows(range(4, 8)).coalesce(1).write.mode("append").parquet(src)
    ingest(stream(), str(tmp_path / "index")).awaitTermination()
    docs, post = segments(spark, str(tmp_path / "index"))
    assert docs.count() == 8 and post.groupBy("term").count().where("term = 'common'").first()[1] == 8
    out = (
        windowed_terms(stream()).writeStream.outputMode("complete").format("memory").queryName("windowed")
        .trigger(availableNow=True).start()
    )
    out.awaitTermination()
    assert spark.table("windowed").where("term = 'common'").agg({"n": "sum"}).first()[0] == 8
    assert spark.table("windowed").where("term = 'common'").count() == 4


def _by_cursor(hits, strategy, k):
    """(doc_id, score) of a plain walk: documents in order, with the bounds of their terms."""
    block, lists, docs = 64, {}, {}
    for h in sorted(hits, key=lambda h: (h.term, h.doc_id)):
        lists.setdefault(h.term, []).append(h)
    for post in lists.values():
        for i, h in enumerate(post):
            rest = post[i // block * block :] if isinstance(strategy, BlockMaxWand) else post
            docs.setdefault(h.doc_id, []).append((max(r.own_bound for r in rest), h.part))
    heap, scored = [], 0
    for doc in sorted(docs):
        least = heap[k - 1][0] if len(heap) >= k else 0.0
        if scored < strategy.top_k_budget and sum(b for b, _ in docs[doc]) > least:
            scored += 1
            heap = sorted([*heap, (sum(p for _, p in docs[doc]), -doc)], reverse=True)[:k]
    return scored, [(-d, round(s, 6)) for s, d in heap]


@pytest.mark.parametrize("strategy", [Wand(30), BlockMaxWand(30), BlockMaxWand(100_000)])
def test_budget_over_slices_equals_a_walk(spark, monkeypatch, strategy):
    monkeypatch.setattr(strategies, "SLICE", 16)
    texts = [(i, "x " * (1 + i * 7 % 5) + "y " * (i % 3) + "z " * (i * 5 % 11)) for i in range(400)]
    tokens = document_tokens(spark.createDataFrame(texts, "doc_id long, text string"))
    terms = weighted(spark, [("x", 1.0), ("y", 2.0)]).select(F.col("query_id").cast("long"), "term", "weight")
    hits = strategies._hits(tokens, terms, Okapi()).collect()
    scored, expected = _by_cursor(hits, strategy, 5)
    out = budgeted(tokens, terms, strategy, Okapi(), 5).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in out] == expected
    assert {r.scored_docs for r in out} == {scored}


def test_budgets_have_no_group_of_a_whole_query(spark):
    tokens = document_tokens(spark.createDataFrame([(i, "x y") for i in range(9)], "doc_id long, text string"))
    terms = weighted(spark, [("x", 1.0)])
    plan = lambda s: budgeted(tokens, terms, s)._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan(Wand())
    assert "FlatMapCoGroupsInArrow" in plan(Wand(5)) and "FlatMapCoGroupsInArrow" in plan(BlockMaxWand(5))


def test_degradation_and_budgets_on_string_ids(spark):
    docs = spark.createDataFrame(
        [(f"d{i}", ["rust"] * (i % 4) + ["code", f"w{i % 7}"]) for i in range(60)], "doc_id string, tokens array<string>"
    ).selectExpr("doc_id", "tokens", "cast(size(tokens) as bigint) as doc_len")
    terms = [(f"q{k}", t, 1.0) for k, t in enumerate(["rust", "code", "w3"])] + [("q0", "w5", 1.0)]
    queries = spark.createDataFrame(terms, "query_id string, term string, weight double")
    out = {(r.strategy, r.k): r.recall for r in recall_degradation(docs, queries, budget=1000).collect()}
    assert len(out) == 9 and all(v == 1.0 for v in out.values())
    some = budgeted(docs, queries, Wand(5), k=3).collect()
    assert {r.query_id for r in some} <= {"q0", "q1", "q2"} and all(r.doc_id.startswith("d") for r in some)
    assert max(r.scored_docs for r in some) <= 5


def test_unwritten_stemmers_are_errors(spark):
    with pytest.raises(TokenizerError):
        stemmer_for(Snowball("fi"))
    assert stemmer_for(Snowball("??"))("running") == "run"
