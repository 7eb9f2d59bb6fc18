import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .helpers import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_planted_documents(spark, tmp_path):
    clean = [(i, prose(i, 90)) for i in range(60)]
    toxic = [(100 + i, prose(100 + i, 60) + " vilkor grumbad " + prose(200 + i, 5)) for i in range(30)]
    item = prose(900, 40)
    copy = clean[3][1].replace(clean[3][1].split(" ")[40], "changed", 1)
    planted = [(300, clean[2][1]), (301, copy), (302, prose(301, 50) + "\n" + item + "\n" + prose(302, 20))]
    docs = [(i, t, "en", "s", len(t)) for i, t in clean + toxic + planted] + [(400, None, None, None, None), (401, "", "en", "s", 0)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["toxicity", "line dedup"]
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids.append({r.doc_id for r in current.select("doc_id").collect()})
    good = {i for i, _ in clean} | {400, 401}
    assert ids[0] == good | {300, 301, 302}
    assert good <= ids[1] and 300 not in ids[1]
    assert good <= ids[2]
    assert ids[3] == ids[2] - {302}
    kept = {r.doc_id: r.text for r in current.collect()}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in kept.values())
    assert sum(r.length for r in out) == want
