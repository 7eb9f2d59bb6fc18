"""Retrieval datasets: corpus and queries as JSON lines, judgements as TSV."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"

#: The public collections and where they are published.
KNOWN_DATASETS = (
    "msmarco", "trec-covid", "nfcorpus", "nq", "hotpotqa", "fiqa", "arguana",
    "webis-touche2020", "dbpedia-entity", "scidocs", "fever", "climate-fever", "scifact",
    "cqadupstack", "quora", "robust04", "signal1m", "trec-news",
)
BASE_URL = "https://public.ukp.informatik.tu-darmstadt.de/thakur/BEIR/datasets"


@dataclass
class Dataset:
    """corpus(doc_id, title, text), queries(query_id, text), qrels(query_id, doc_id, score)."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def dataset_url(name: str) -> str:
    if name not in KNOWN_DATASETS:
        raise InvalidArgument(f"unknown dataset: {name}")
    return f"{BASE_URL}/{name}.zip"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and bad ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score) of a TSV file.

    A first line that holds "query-id" is the header, lines of less than three
    columns are skipped, a score that isn't a number is 0, and the last line of
    a repeated pair counts.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    parts = F.split("value", "\t", -1)
    rows = lines.where(~((F.col("at") == 0) & F.contains("value", F.lit("query-id"))))
    rows = rows.where(F.size(parts) >= 3).select(
        F.trim(parts[0]).alias("query_id"), F.trim(parts[1]).alias("doc_id"),
        F.coalesce(F.expr("try_cast(trim(split(value, '\t', -1)[2]) as int)"), F.lit(0)).alias("score"),
        "at",
    )
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("score", "at").alias("score"))


def load_dataset(
    spark: SparkSession, folder: str, split: str | None = None,
    max_docs: int | None = None, max_queries: int | None = None,
) -> Dataset:
    """The dataset of a folder.

    With a ``split``, judgements come from ``qrels/<split>.tsv`` and only judged
    queries are kept; otherwise, or where that file is missing, from
    ``qrels.tsv``.  Without any judgements qrels is empty.
    """
    corpus = read_jsonl(spark, f"{folder}/corpus.jsonl", CORPUS).withColumnRenamed("_id", "doc_id")
    queries = read_jsonl(spark, f"{folder}/queries.jsonl", QUERIES).withColumnRenamed("_id", "query_id")
    paths = [f"{folder}/qrels/{split}.tsv"] if split else []
    qrels = None
    for path in [*paths, f"{folder}/qrels.tsv"]:
        if _exists(spark, path):
            qrels = read_qrels(spark, path)
            break
    if qrels is None:
        qrels = spark.createDataFrame([], "query_id string, doc_id string, score int")
    elif split:
        queries = queries.join(qrels.select("query_id"), "query_id", "left_semi")
    if max_docs is not None:
        corpus = corpus.orderBy("doc_id").limit(max_docs)
    if max_queries is not None:
        queries = queries.orderBy("query_id").limit(max_queries)
    return Dataset(corpus, queries, qrels)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def titled_text(title: str = "title", text: str = "text"):
    """The text that is indexed: the title, if there is one, on a line before it."""
    return F.concat_ws("\n", title, text)


def local_dataset(root: str, name: str, max_bytes: int = 8 << 30) -> str:
    """The folder of a known dataset under ``root``, unpacked from its archive if need be.

    Nothing is downloaded: put the archive from ``dataset_url`` there first.
    Archives that unpack to more than ``max_bytes`` or outside of the folder are
    refused.
    """
    dataset_url(name)
    folder, archive = Path(root, name), Path(root, f"{name}.zip")
    if not (folder / "corpus.jsonl").exists():
        if not archive.exists():
            raise InvalidArgument(f"neither {folder} nor {archive} exists")
        with zipfile.ZipFile(archive) as z:
            if sum(i.file_size for i in z.infolist()) > max_bytes:
                raise InvalidArgument(f"{archive} unpacks to more than {max_bytes} bytes")
            top = Path(root).resolve()
            for i in z.infolist():
                if not (top / i.filename).resolve().is_relative_to(top):
                    raise InvalidArgument(f"{archive} has a path outside of the folder: {i.filename}")
            z.extractall(root)
    return str(folder)


def export_corpus(docs: DataFrame, path: str) -> None:
    """Live documents as JSON lines (_id, title, text); a missing title is null."""
    title = F.element_at("fields", "title") if "fields" in docs.columns else F.lit(None)
    docs.select(
        F.col("external_id").alias("_id"), title.cast("string").alias("title"), "text"
    ).write.option("ignoreNullFields", "false").json(path)


def in_order(df: DataFrame, by: str, out: str = "rank") -> DataFrame:
    """Adds the place by ``by`` within each query_id."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(by)))
