"""What keeps the work of large tables in proportion: chunks, counts before shuffles, equal results."""


from lexicrate import catalog
from lexicrate.config import DuplicateCap, Length, Lowercase, Ngram, Snowball, Stopwords, TokenizerConfig, Whitespace
from lexicrate.functions import analysis
from lexicrate.functions.analysis import analyze
from lexicrate.operators import tables
from lexicrate.operators.search import document_frequencies, document_vector, document_vectors, narrowed, packed_hits, search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_reach_python_in_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(analysis, "CHUNK_TOKENS", 5)
    lists = [["a", "b"], None, ["c"] * 4, [], ["d"] * 9, ["e"]]
    batch = pa.record_batch({"id": list(range(6)), "tokens": pa.array(lists, pa.list_(pa.string()))})
    seen = [(r.column("id").to_pylist(), t.to_pylist(), row.tolist()) for r, t, row in analysis.token_chunks(batch, 1)]
    assert seen == [
        ([0, 1], ["a", "b"], [0, 0]), ([2, 3], ["c"] * 4, [0] * 4), ([4], ["d"] * 9, [0] * 9), ([5], ["e"], [0]),
    ]


def test_steps_behind_a_cap(spark):
    config = TokenizerConfig(
        Whitespace(), (DuplicateCap(2), Lowercase(), Stopwords("en"), DuplicateCap(3), Length(1, 4)), Snowball("en")
    )
    df = spark.createDataFrame([(1, "A a a B b B b the cats cats longer"), (2, None), (3, " ")], "doc_id long, text string")
    found = {r.doc_id: r.tokens for r in analyze(df, config).collect()}
    assert found == {1: ["b", "b", "b", "cat", "cat"], 2: [], 3: []}


def test_stems_see_counted_words(spark, tmp_path):
    """Before, every occurrence went through Python; now each word does, behind its count."""
    spark.createDataFrame([(i, "cats cat Cats") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.QUERIES["stem_snowball_en"](spark, str(tmp_path))
    steps = plan(out)
    assert steps.index("MapInArrow") < steps.index("Generate explode")  # read from the top: Python comes after the counts
    assert [tuple(r) for r in out.collect()] == [("cat", 150)]


def test_packed_postings(spark, monkeypatch):
    """Numbers and vectors are those of the plain postings, whatever the batches; ids that repeat too."""
    monkeypatch.setattr(tables, "SLICE", 2)
    rows = [(5, "b a b"), (1, "c b"), (9, None), (2, "a a d a"), (4, " "), (3, "d c b b")]
    more = [(5, "z b a"), (1, "c b"), (None, "a q")]
    for texts in (rows, rows + more, []):
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        docs = tables.document_tokens(df, TokenizerConfig(filters=())).select("doc_id", "tokens", "doc_len")
        post = tables.postings(docs, positions=True)
        ids = tables.with_term_ids(tables.term_stats(post), post)
        found = tables.numbered_terms(docs)
        assert sorted(map(tuple, found.select(*ids.columns).collect())) == sorted(map(tuple, ids.collect()))
        key = lambda r: repr(tuple(r))
        assert sorted(document_vectors(docs).collect(), key=key) == sorted(document_vector(post, ids).collect(), key=key)


def test_vectors_do_not_shuffle_postings(spark, tmp_path):
    """Before, each posting was a row of its own in every shuffle, and was counted behind one."""
    spark.createDataFrame([(i, "cats dogs") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    steps = plan(catalog.QUERIES["sparse_doc_vector"](spark, str(tmp_path)))
    assert "arrays_zip" in steps.split("Exchange")[0]  # unpacked behind the last shuffle
    assert "posexplode" not in steps


def test_ngrams_are_counted_as_they_are_cut(spark):
    """All kinds of texts against the n-grams as written out; long runs, which don't fit one number, too."""
    texts = ["Ab  ab aB ab.", "naïve café\r\nx", "éé \U0001F469‍\U0001F680\U0001F1E9\U0001F1EA", "Привет — ‘ok’", "ΟΣ ΟΣ Ο", "", None, "a", "\r\n", "x" * 140 + " y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = [((), "Character", 2, 3), ((), "Character", 1, 1), ((Length(2, 2),), "Character", 1, 3),
             ((Lowercase(),), "Word", 2, 3), ((), "Word", 1, 2), ((Lowercase(), Length(3, 9)), "Word", 0, 2)]
    for filters, mode, low, high in kinds:
        config = TokenizerConfig(Ngram(low, high, mode), filters)
        found = sorted(map(tuple, analysis.ngram_counts(df, config).collect()))
        tokens = analyze(df, config).selectExpr("explode(tokens) as term").groupBy("term").count()
        assert found == sorted(map(tuple, tokens.collect()))
    assert analysis.ngram_counts(df, TokenizerConfig(Ngram(2, 3, "Character"), (Lowercase(),))) is None
    assert analysis.ngram_counts(df, TokenizerConfig(Ngram(2, 3, "Word"), (Stopwords("en"),))) is None


def test_runs_longer_than_a_number_holds():
    import numpy as np

    codes, row = np.arange(1000) % 7, np.repeat([0, 1], 500)
    parts, times = analysis._counted(codes * (1 << 17), row, 5, 1 << 20)
    found = {tuple(int(p[i]) >> 17 for p in parts): int(t) for i, t in enumerate(times)}
    want = {}
    for i in range(996):
        if row[i] == row[i + 4]:
            want[tuple(codes[i : i + 5])] = want.get(tuple(codes[i : i + 5]), 0) + 1
    assert found == want


def test_blocks_of_packed_postings(spark, monkeypatch):
    """As those of the plain postings, over several slices and batches, and where ids repeat."""
    monkeypatch.setattr(tables, "SLICE", 16)
    texts = [(i * 7 % 200, "a " * (i % 5) + ("b" if i % 3 else "") + f" c{i % 40}") for i in range(200)]
    for rows in (texts, [*texts, (3, "a b"), (None, "a")]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        docs = tables.document_tokens(df, TokenizerConfig(filters=())).select("doc_id", "tokens", "doc_len")
        want = tables.blocks(tables.postings(docs), 8)
        found = tables.document_blocks(docs, 8)
        key = lambda r: repr(tuple(r))
        assert sorted(found.select(*want.columns).collect(), key=key) == sorted(want.collect(), key=key)
    plain = tables.document_blocks(tables.document_tokens(spark.createDataFrame(texts, "doc_id long, text string")))
    assert plan(plain).count("collect_list") and "posexplode_outer" not in plan(plain)  # no posting is a row in a shuffle


def test_searches_keep_what_queries_name(spark):
    """Before, the tokens of the whole corpus were kept, and looked through again for each use."""
    texts = [(i, "a b c " * (i % 4) + "d " * (i % 3) + f"e{i}") for i in range(40)]
    docs = tables.document_tokens(
        spark.createDataFrame(texts, "doc_id long, text string"), TokenizerConfig(filters=())
    ).select("doc_id", "tokens", "doc_len")
    terms = spark.createDataFrame([(1, "a", 1.0), (1, "d", 2.0), (2, "e7", 1.0), (2, "zz", 1.0)], "query_id long, term string, weight double")
    want = sorted(map(tuple, search(docs, terms).collect()))
    few = narrowed(docs, terms)
    assert {t for r in few.collect() for t in r.tokens} == {"a", "d", "e7"}
    assert [r.doc_len for r in few.orderBy("doc_id").collect()] == [r.doc_len for r in docs.orderBy("doc_id").collect()]
    assert sorted(map(tuple, search(few, terms).collect())) == want
    kept = packed_hits(docs, terms)
    assert not [s for s in plan(kept["post"]).split("\n") if "Exchange" in s and "doc_id" in s]  # no posting is shuffled
    assert sorted(map(tuple, search(docs, terms, **kept).collect())) == want
    assert packed_hits(docs.unionByName(docs), terms) == {}


def test_feedback_analyzes_its_documents_only(spark, tmp_path):
    """Before, a filter on the tokens went below the join, and every document was analyzed once more."""
    texts = [(i, "that was for " * (i + 1) + f"w{i} x") for i in range(15)] + [(99, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("expand_rm3", "expand_prf"):
        steps = plan(catalog.QUERIES[name](spark, str(tmp_path)))
        assert not [s for s in steps.split("\n") if "Filter (" in s and "split(" in s]
    found = {r.term: r.weight for r in catalog.QUERIES["expand_rm3"](spark, str(tmp_path)).collect()}
    n = sum(i + 1 for i in range(5, 15))  # the best ten
    total = 4 + 0.5 * (3 * n + 10 + 6)
    assert found["that"] == round((1 + 0.5 * n) / total, 6) and found["x"] == round(5 / total, 6)
    assert len(found) == 10


def test_frequencies_of_wanted_terms(spark, tmp_path):
    """Before, expand_prf shuffled the statistics of every term of the corpus."""
    rows = [(1, "a b a"), (2, "b c"), (3, None), (4, "c c d that was for")]
    wanted = spark.createDataFrame([("b",), ("c",), ("b",), ("nope",)], "term string")
    for texts in (rows, [*rows, (2, "b z"), (None, "c")]):
        df = spark.createDataFrame(texts, "doc_id long, text string")
        docs = tables.document_tokens(df, TokenizerConfig(filters=())).select("doc_id", "tokens", "doc_len")
        every = {r.term: r.doc_freq for r in tables.document_stats(docs).collect()}
        found = [tuple(r) for r in document_frequencies(docs, wanted).collect()]
        assert sorted(found) == [(t, every[t]) for t in ("b", "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    steps = plan(catalog.QUERIES["expand_prf"](spark, str(tmp_path))).split("MapInArrow")[0]
    assert "LeftSemi" in steps[steps.rindex("partial_sum(doc_freq") :]  # wanted terms only reach the shuffle
