import pytest
from pyspark.sql import functions as F

from lexicrate.llm import class_lm, jaccard, line_dedup

from .helpers import prose, rows

PACKS = {
    "op4": (lambda df: line_dedup._read(df, 20, 40, 64), "own"),
    "op5": (lambda df: jaccard._pack(df, 8, 5), "meta"),
    "op8": (lambda df: class_lm._pack(df.withColumn("held_out", F.lit(False)), 64), "meta"),
}


@pytest.mark.parametrize("name", PACKS)
def test_own_rows_of_chunks_spread_over_groups(spark, name):
    pack, own = PACKS[name]
    df = spark.createDataFrame(
        rows([(i, prose(i, 60)) for i in range(64)]), "text string, n_words int, doc_id long, start int, lang string"
    ).repartition(16, "doc_id")
    packed = pack(df).select("bucket", "chunk", F.col(own).isNotNull().alias("own")).collect()
    groups = [r.bucket for r in packed if r.own]
    assert len(set(groups)) == len(groups) > 8  # a group for each chunk
    assert max(groups) < 0 <= min(r.bucket for r in packed if not r.own)
