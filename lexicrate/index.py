"""The index as an object: documents in, searches out.

The state is a table of documents and the numbers of deleted ones; tokens,
postings and statistics are derived lazily, so every change is visible at once.
``save`` writes documents with their tokens, postings and term statistics as
Parquet, the latter two dealt by term hash.  A loaded index searches these: a
query reads the postings of its terms' buckets and the documents' lengths, no
text; documents that came later are analyzed and joined to them, and deleted
ones are left out by an anti join.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BM25Config, plain
from .errors import (
    BadSnapshot,
    DocumentNotFound,
    ExternalIdNotFound,
    InvalidArgument,
    UnsupportedVersion,
)
from .operators.search import (
    BooleanQuery,
    PhraseQuery,
    WeightedQuery,
    bag_of_words,
    document_vector,
    phrase_match,
    query_vector,
    search_boolean,
    search_phrase,
    weighted,
)
from .operators.tables import (
    blocks,
    corpus_stats,
    document_tokens,
    number_by,
    number_rows,
    postings,
    term_stats,
    with_term_ids,
)
from .plans.strategies import retrieve
from .sources.oplog import Delete, Insert, OperationLog

FORMAT, VERSION = "lexicrate", 2
#: Tokens of one bucket of postings, and the least number of buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 16 << 20, 16
#: Up to so many distinct buckets are named in a filter of the scan.
MOST_NAMED = 1024
DOCS = "doc_id long, external_id string, text string, fields map<string,string>, live boolean"
SAVED = ["doc_id", "external_id", "text", "fields", "live", "tokens", "doc_len"]
POSTINGS = "term string, doc_id long, doc_len long, tf long, positions array<int>, bucket int"
TERMS = "term string, doc_freq long, collection_freq long, max_tf int, bucket int"
MOST_DOCS = 1 << 32


@dataclass(frozen=True)
class Stored:
    """Tables of a saved index: documents with a number below ``until``."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    buckets: int
    until: int

    def bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")


@dataclass(frozen=True)
class SearchHit:
    doc_id: str
    score: float


class BM25Index:
    """A lexical index over documents with external ids."""

    def __init__(self, config: BM25Config = BM25Config(), spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.config = config
        self.docs = self.spark.createDataFrame([], DOCS)
        self.built = int(time.time())
        self.next_id = 0
        self.log: OperationLog | None = None
        self.stored: Stored | None = None
        #: Numbers of documents deleted since the table was written; each comes from a call.
        self.gone: set[int] = set()

    # -- building ----------------------------------------------------------------

    @classmethod
    def from_documents(
        cls, documents: Iterable[str | tuple[str, str]], config: BM25Config = BM25Config(),
        spark: SparkSession | None = None,
    ) -> BM25Index:
        index = cls(config, spark)
        index.insert_batch(documents)
        return index

    @classmethod
    def from_dataframe(
        cls, df: DataFrame, config: BM25Config = BM25Config(), *, id_col: str | None = None,
        text_col: str = "text", fields_col: str | None = None,
    ) -> BM25Index:
        index = cls(config, df.sparkSession)
        index.insert(df, id_col=id_col, text_col=text_col, fields_col=fields_col)
        return index

    def insert_batch(self, documents: Iterable[str | tuple[str, str]]) -> None:
        """Texts, or pairs of external id and text; all plain texts go in first."""
        documents = list(documents)
        plain_texts = [d for d in documents if isinstance(d, str)]
        pairs = [d for d in documents if not isinstance(d, str)]
        if self.log:
            self.log.append([Insert(None, t) for t in plain_texts] + [Insert(i, t) for i, t in pairs])
        if plain_texts:
            df = self.spark.createDataFrame([(t,) for t in plain_texts], "text string").coalesce(1)
            self.insert(df)
        if pairs:
            df = self.spark.createDataFrame(pairs, "external_id string, text string").coalesce(1)
            self.insert(df, id_col="external_id")

    def insert(
        self, df: DataFrame, *, id_col: str | None = None, text_col: str = "text",
        fields_col: str | None = None,
    ) -> None:
        """Adds a table of documents.  A known or repeated id rejects it as a whole."""
        fields = F.col(fields_col) if fields_col else F.lit(None)
        new = number_rows(
            df.select(
                (F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")).alias("external_id"),
                F.col(text_col).alias("text"), fields.cast("map<string,string>").alias("fields"),
            ),
            base=self.next_id,
        )
        new = new.select(
            "doc_id", F.coalesce("external_id", F.concat(F.lit("doc-"), "doc_id")).alias("external_id"),
            "text", "fields", F.lit(True).alias("live"),
        ).persist()
        twice = new.groupBy("external_id").count().where("count > 1")
        taken = new.join(self.docs.select("external_id"), "external_id", "left_semi")
        clash = twice.select("external_id").union(taken.select("external_id")).first()
        if clash:
            new.unpersist()
            raise InvalidArgument(f"duplicate document id: {clash[0]}")
        count = new.count()
        if self.next_id + count > MOST_DOCS:
            raise InvalidArgument("more documents than ids")
        self.docs = self.docs.unionByName(new)
        self.next_id += count

    def delete(self, external_id: str) -> None:
        """Marks a document as deleted; its id stays taken until ``compact``."""
        if self.log:
            self.log.append([Delete(external_id)])
        found = self._numbers_of(F.col("external_id") == external_id)
        if not found:
            raise ExternalIdNotFound(f"no document has the id {external_id}")
        self.gone.update(found)

    def delete_by_doc_id(self, doc_id: int) -> None:
        found = self._numbers_of(F.col("doc_id") == doc_id)
        if not found:
            raise DocumentNotFound(f"no document has the number {doc_id}")
        self.gone.update(found)

    def _numbers_of(self, which) -> list[int]:
        """Numbers of the named documents: ids are unique, so no more than there are names."""
        return [r[0] for r in self.docs.where(which).select("doc_id").collect()]

    def _marked(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``live`` as of now."""
        if not self.gone:
            return docs
        gone = self.spark.createDataFrame([(i,) for i in sorted(self.gone)], "doc_id long")
        marked = docs.join(F.broadcast(gone.withColumn("_gone", F.lit(True))), "doc_id", "left")
        return marked.withColumn("live", F.col("live") & F.col("_gone").isNull()).select(*docs.columns)

    def compact(self) -> None:
        """Leaves deleted documents out for good and numbers the others anew."""
        marked = self._marked(self.docs)
        if marked.where("not live").isEmpty():
            return
        live = marked.where("live").withColumnRenamed("doc_id", "_old")
        self.docs = number_by(live, "_old").select(*self.docs.columns).persist()
        self.next_id, self.built = self.docs.count(), int(time.time())
        self.stored, self.gone = None, set()

    # -- tables ------------------------------------------------------------------

    def live(self) -> DataFrame:
        return self._marked(self.docs).where("live").drop("live")

    def tokens(self, live: bool = True) -> DataFrame:
        """All documents with tokens and doc_len; those of a saved table come from there."""
        marked = self._marked(self.docs)
        analyzed = lambda df: document_tokens(df, self.config.tokenizer)
        if self.stored is None:
            out = analyzed(marked)
        else:
            out = self._marked(self.stored.docs)
            if self.next_id > self.stored.until:
                out = out.unionByName(analyzed(marked.where(F.col("doc_id") >= self.stored.until)))
        return out.where("live").drop("live") if live else out

    def postings_table(self, live: bool = True, terms: DataFrame | None = None) -> DataFrame:
        """Postings with positions; of a saved table only the buckets of ``terms``, if given."""
        if self.stored is None:
            return postings(self.tokens(live), positions=True)
        kept = self.stored
        post = kept.postings if terms is None else kept.postings.where(self._buckets_of(terms))
        post = post.drop("bucket")
        if live and self._changed():
            dead = self._marked(kept.docs.select("doc_id", "live")).where("not live").select("doc_id")
            post = post.join(dead, "doc_id", "left_anti")
        if self.next_id > kept.until:
            later = self.tokens(live).where(F.col("doc_id") >= kept.until)
            post = post.unionByName(postings(later, positions=True))
        return post

    def _buckets_of(self, terms: DataFrame):
        """A filter of the scan on the buckets of the terms, while these are few."""
        named = terms.select(self.stored.bucket().alias("b")).distinct().limit(MOST_NAMED + 1).collect()
        return F.col("bucket").isin([r[0] for r in named]) if len(named) <= MOST_NAMED else F.lit(True)

    def _changed(self) -> bool:
        """Whether any document of the saved table is deleted."""
        return bool(self.gone) or not self.stored.docs.where("not live").isEmpty()

    def _ready(self, terms: DataFrame) -> dict[str, DataFrame]:
        """The stored tables that a search of these terms needs; none where nothing is stored."""
        if self.stored is None:
            return {}
        out = {"post": self.postings_table(terms=terms)}
        if not self._changed() and self.next_id == self.stored.until:
            out["stats"] = self.stored.terms.where(self._buckets_of(terms)).drop("bucket")
        return out

    def terms(self) -> DataFrame:
        """Terms with frequencies among live documents; ids and max_tf count deleted ones too."""
        every = self.postings_table(live=False)
        now = term_stats(self.postings_table()).drop("max_tf")
        known = with_term_ids(term_stats(every).select("term", "max_tf"), every)
        zero = F.lit(0).cast("long")
        return known.join(now, "term", "left").select(
            "term", "term_id", F.coalesce("doc_freq", zero).alias("doc_freq"),
            F.coalesce("collection_freq", zero).alias("collection_freq"), "max_tf",
        )

    def block_table(self) -> DataFrame:
        return blocks(self.postings_table())

    # -- searches ------------------------------------------------------------------

    def _hits(self, found: DataFrame, k: int) -> list[SearchHit]:
        if k <= 0:
            return []
        named = found.join(self.docs.select("doc_id", "external_id"), "doc_id")
        rows = named.orderBy("rank").select("external_id", "score").collect()  # k rows
        return [SearchHit(r[0], r[1]) for r in rows]

    def _retrieve(self, terms: DataFrame, k: int) -> DataFrame:
        return retrieve(
            self.tokens(), terms, self.config.retrieval, self.config.scoring, k, **self._ready(terms)
        )

    def search_batch(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, doc_id, score, rank) for a table (query_id, text)."""
        return self._retrieve(bag_of_words(queries, self.config.tokenizer), top_k)

    def search(self, query: str, top_k: int = 10) -> list[SearchHit]:
        one = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        return self._hits(self.search_batch(one, max(top_k, 1)), top_k)

    def search_weighted(self, query: WeightedQuery, top_k: int = 10) -> list[SearchHit]:
        return self._hits(self._retrieve(weighted(self.spark, query.terms()), max(top_k, 1)), top_k)

    def _named(self, terms: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string")

    def search_boolean(self, query: BooleanQuery, top_k: int = 10) -> list[SearchHit]:
        """Terms of deleted documents stay known until ``compact``."""
        terms = self._named([*query.must, *query.should, *query.must_not])
        every = self.postings_table(live=False, terms=terms).select("doc_id", "term")
        found = search_boolean(
            self.tokens(), query, self.config.scoring, max(top_k, 1), every, **self._ready(terms)
        )
        return self._hits(found, top_k)

    def search_phrase(self, query: PhraseQuery, top_k: int = 10) -> list[SearchHit]:
        ready = self._ready(self._named(query.terms))
        return self._hits(search_phrase(self.tokens(), query, self.config.scoring, max(top_k, 1), **ready), top_k)

    def phrase_match(self, terms: list[str], window: int = 1) -> set[int]:
        post = self._ready(self._named(terms)).get("post")
        found = phrase_match(self.tokens(), PhraseQuery(list(terms), window), post)
        return {r[0] for r in found.toLocalIterator()}

    # -- what is in it ---------------------------------------------------------------

    def postings(self, term: str) -> list[tuple[int, int]]:
        rows = self.postings_table(live=False).where(F.col("term") == term).orderBy("doc_id")
        return [(r["doc_id"], r["tf"]) for r in rows.toLocalIterator()]

    def doc_length(self, doc_id: int) -> int | None:
        row = self.tokens(live=False).where(F.col("doc_id") == doc_id).select("doc_len").first()
        return row[0] if row else None

    def sparse_vector_for_query(self, query: str) -> list[tuple[int, float]]:
        one = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        vector = query_vector(self.tokens(), bag_of_words(one, self.config.tokenizer), self.terms())
        return [(r["term_id"], r["weight"]) for r in vector.orderBy("term_id").collect()]

    def sparse_vector_for_document(self, doc_id: int) -> list[tuple[int, float]]:
        post = self.postings_table().where(F.col("doc_id") == doc_id)
        vector = document_vector(post, self.terms()).orderBy("term_id")
        return [(r["term_id"], r["weight"]) for r in vector.collect()]

    @property
    def avgdl(self) -> float:
        return float(corpus_stats(self.tokens()).first()["avgdl"])

    @property
    def vocabulary(self) -> dict[str, dict[str, int]]:
        return {
            r["term"]: {k: r[k] for k in ("term_id", "doc_freq", "collection_freq", "max_tf")}
            for r in self.terms().toLocalIterator()
        }

    def stats(self) -> dict[str, object]:
        """Counts; documents, vocabulary and total terms include deleted documents."""
        every = self.tokens(live=False)
        sums = every.agg(
            F.count("*").alias("n"), F.count_if("live").alias("live"),
            F.coalesce(F.sum(F.size(F.array_distinct("tokens"))), F.lit(0)).alias("terms"),
        ).first()
        return {
            "num_docs": sums["n"], "num_live_docs": sums["live"],
            "vocabulary_size": every.select(F.explode("tokens")).distinct().count(),
            "avgdl": self.avgdl, "tombstones": sums["n"] - sums["live"],
            "total_terms": sums["terms"], "build_timestamp_unix": self.built,
        }

    def __len__(self) -> int:
        return self.live().count()

    def __iter__(self) -> Iterator[str]:
        yield from self.vocabulary

    # -- on disk -----------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, path: str) -> None:
        """Writes to a folder beside ``path`` and renames it: a failed save leaves no half."""
        beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        self.tokens(live=False).select(*SAVED).write.parquet(f"{beside}/docs")
        docs = self.spark.read.parquet(f"{beside}/docs")
        tokens = docs.agg(F.coalesce(F.sum("doc_len"), F.lit(0))).first()[0]
        buckets = max(LEAST_BUCKETS, -(-tokens // BUCKET_TOKENS))
        deal = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        (
            postings(docs, positions=True).select("*", deal)
            .repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "doc_id")
            .write.partitionBy("bucket").parquet(f"{beside}/postings")
        )
        post = self.spark.read.schema(POSTINGS).parquet(f"{beside}/postings")
        dead = docs.where("not live").select("doc_id")
        alive = post.join(dead, "doc_id", "left_anti")
        (
            term_stats(alive).select("*", deal).repartition(buckets, "bucket").sortWithinPartitions("bucket", "term")
            .write.partitionBy("bucket").parquet(f"{beside}/terms")
        )
        manifest = {
            "format": FORMAT, "version": VERSION, "config": plain(self.config),
            "next_id": self.next_id, "built": self.built, "buckets": buckets,
        }
        row = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        row.coalesce(1).write.text(f"{beside}/manifest")
        fs, target = self._fs(path)
        _, source = self._fs(beside)
        old = None
        if fs.exists(target):
            _, old = self._fs(f"{beside}.old")
            fs.rename(target, old)
        fs.rename(source, target)
        if old is not None:
            # the tables in use may still be read from there
            self._open(path, buckets)
            fs.delete(old, True)

    def _open(self, path: str, buckets: int) -> None:
        read = lambda schema, name: self.spark.read.schema(schema).parquet(f"{path}/{name}")
        docs = read(f"{DOCS}, tokens array<string>, doc_len long", "docs")
        self.docs, self.gone = docs.select(*SAVED[:-2]), set()
        self.stored = Stored(docs, read(POSTINGS, "postings"), read(TERMS, "terms"), buckets, self.next_id)

    @classmethod
    def load(cls, path: str, mode: str = "in_memory", spark: SparkSession | None = None) -> BM25Index:
        """Opens a saved index; ``in_memory`` keeps its postings cached, ``mmap`` scans their buckets."""
        if mode not in ("in_memory", "mmap"):
            raise InvalidArgument("mode must be in_memory or mmap")
        index = cls(spark=spark)
        fs, manifest = index._fs(f"{path}/manifest")
        if not fs.exists(manifest):
            raise BadSnapshot(f"{path} holds no index")
        try:
            told = json.loads(index.spark.read.text(f"{path}/manifest").first()[0])
        except (ValueError, TypeError) as e:
            raise BadSnapshot(f"{path} has a damaged manifest") from e
        if told.get("format") != FORMAT:
            raise BadSnapshot(f"{path} holds something else than an index")
        if told["version"] != VERSION:
            raise UnsupportedVersion(f"{path} has version {told['version']}")
        index.config = BM25Config.from_mapping(told["config"])
        index.next_id, index.built = told["next_id"], told["built"]
        index._open(path, told["buckets"])
        if mode == "in_memory":
            kept = index.stored
            index.stored = replace(kept, postings=kept.postings.cache(), terms=kept.terms.cache())
        return index

    def metadata(self) -> dict[str, object]:
        stats = self.stats()
        return {
            "vocabulary_size": stats["vocabulary_size"], "num_documents": stats["num_live_docs"],
            "avgdl": stats["avgdl"], "scoring": plain(self.config.scoring),
            "tokenizer": plain(self.config.tokenizer), "build_timestamp_unix": self.built,
            "format_version": VERSION,
        }

    def save_metadata(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.metadata(), f, indent=2)

    # -- the operation log -----------------------------------------------------------------

    def enable_wal(self, path: str) -> None:
        """From now on changes are logged before they are made."""
        self.log = OperationLog(path)

    def disable_wal(self) -> None:
        self.log = None

    def replay_wal(self, path: str) -> int:
        """Applies a log; inserts of known ids and deletes of unknown ones are left out.

        An insert without an id makes a new document each time it is replayed.
        Returns how many operations were applied.
        """
        operations = OperationLog(path).read()
        named = {o.external_id for o in operations if o.external_id is not None}
        told = self.spark.createDataFrame([(i,) for i in sorted(named)], "external_id string")
        start = self.next_id
        auto = [(f"doc-{start + i}",) for i in range(len(operations))]
        asked = told.union(self.spark.createDataFrame(auto, "external_id string")) if auto else told
        known = {
            r[0] for r in self.docs.select("external_id").join(F.broadcast(asked), "external_id", "left_semi").collect()
        }  # no more rows than the log has operations
        inserts, applied = [], 0
        gone: set[str] = set()
        for o in operations:
            if isinstance(o, Insert):
                name = o.external_id if o.external_id is not None else f"doc-{start + len(inserts)}"
                if name in known:
                    continue
                known.add(name)
                inserts.append((name, o.text, o.fields or None))
            elif o.external_id in known:
                gone.add(o.external_id)
            else:
                continue
            applied += 1
        if inserts:
            df = self.spark.createDataFrame(
                inserts, "external_id string, text string, fields map<string,string>"
            ).coalesce(1)
            self.insert(df, id_col="external_id", fields_col="fields")
        if gone:
            names = self.spark.createDataFrame([(i,) for i in sorted(gone)], "external_id string")
            found = self.docs.join(F.broadcast(names), "external_id", "left_semi").select("doc_id")
            self.gone.update(r[0] for r in found.collect())  # no more rows than the log has operations
        return applied

    @classmethod
    def load_with_wal(
        cls, path: str, wal_path: str, mode: str = "in_memory", spark: SparkSession | None = None
    ) -> BM25Index:
        index = cls.load(path, mode, spark)
        index.replay_wal(wal_path)
        index.enable_wal(wal_path)
        return index

    def compact_and_flush(self, path: str) -> None:
        """Compacts, saves and empties the log."""
        self.compact()
        self.save(path)
        if self.log:
            self.log.truncate()
