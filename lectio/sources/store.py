"""The index: versioned Parquet tables behind one pointer.

Documents are dealt to `buckets` by a hash of their id. A write makes new folders for the buckets that it
touches, chunks, vectors and postings together, then replaces the pointer file by one renaming, which names the
folder of every bucket; a reader sees the old state or the new one, never half of both. The folders of the
state before stay for readers at work and go with the next write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..schema import CHUNKS
from .staging import stage

VECTORS = "chunk_id string, doc_id string, vector array<double>"
POSTINGS = "chunk_id long, ord long, len int, term string, tf long"
TERMS, TOTALS = "term string, df long, idf double", "n long, avg_len double"
TABLES = {"chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS}


class IndexProviderMismatch(RuntimeError):
    """The index was built by another embedding provider."""


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """old with new's rows in place of those of equal key; a replaced row keeps its ord."""
    top = old.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_top"))  # one row
    fresh = new.join(old.select(key, F.col("ord").alias("_old")), key, "left").crossJoin(F.broadcast(top))
    fresh = fresh.withColumn("ord", F.coalesce("_old", F.col("_top") + F.col("ord"))).select(*old.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(fresh)


def delete_documents(table: DataFrame, ids: list[str]) -> DataFrame:
    return table.where(~F.col("doc_id").isin(ids))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


def indexed_documents(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.max_by("source_file", "ord").alias("source_file"))


def inconsistencies(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys on one side only: key, missing_in."""
    a, b = chunks.select(key), vectors.select(key)
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("vectors")).unionByName(
        b.join(a, key, "left_anti").withColumn("missing_in", F.lit("chunks"))
    )


def to_metadata(chunks: DataFrame) -> DataFrame:
    """chunk_id, metadata: a flat string map without null entries."""
    names = [c for c in chunks.columns if c not in ("chunk_id", "chunk_text")]
    entries = [x for c in names for x in (F.lit(c), F.col(c).cast("string"))]
    return chunks.select("chunk_id", F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()).alias("metadata"))


def from_metadata(flat: DataFrame, columns: dict[str, str]) -> DataFrame:
    return flat.select("chunk_id", *[F.try_element_at("metadata", F.lit(c)).try_cast(t).alias(c) for c, t in columns.items()])


class Index:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        provider: str = "hashing",
        dimension: int = 384,
        model: str = "",
        buckets: int = 16,
        config: Config = DEFAULT,
    ):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.provider, self.dimension, self.model, self.buckets = provider, dimension, model or provider, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        at = self._state()
        if at and at["provider"] != provider:
            raise IndexProviderMismatch(
                f"the index holds {at['provider']} vectors of width {at['dimension']}; the session uses {provider} with {dimension}"
            )
        if at:
            self.buckets = at["buckets"]

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _state(self) -> dict | None:
        """The pointer's content; unreadable counts as no index."""
        try:
            return json.loads(self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).first()[0])
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or isinstance(error, (ValueError, TypeError)):
                return None
            raise

    def meta(self) -> dict:
        """What the index was built with: provider, dimension, model, collection."""
        at = self._state() or {}
        return {k: at.get(k) for k in ("provider", "dimension", "model", "collection")}

    def _read(self, name: str, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/{v}/{name}/_b={b}" for b, v in folders.items()]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _table(self, name: str, among: list[int] | None = None) -> DataFrame:
        folders = (self._state() or {"folders": {}})["folders"].get(name, {})
        return self._read(name, {b: v for b, v in folders.items() if among is None or int(b) in among})

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks")

    @property
    def vectors(self) -> DataFrame:
        return self._table("vectors")

    @property
    def keywords(self):
        """The stored keyword index over all chunks; its chunk_id is the chunk's ord."""
        from ..operators.retrieval import KeywordIndex

        at = self._state()
        own = lambda name, schema: self.spark.read.schema(schema).parquet(
            f"{self.root}/{at['stats']}/{name}"
        ) if at else self.spark.createDataFrame([], schema)
        return KeywordIndex(self._table("postings"), own("terms", TERMS), own("totals", TOTALS), self.config)

    def count(self) -> int:
        return self.chunks.count()

    def is_empty(self) -> bool:
        return self.chunks.isEmpty()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _commit(self, chunks: DataFrame, vectors: DataFrame, touched: list[int]) -> None:
        """Replaces the touched buckets by their new rows and makes the statistics anew."""
        from ..operators.retrieval import idf, postings, token_table

        last = self._state() or {"folders": {name: {} for name in TABLES}, "stats": None, "next": 0}
        version = f"v-{uuid.uuid4().hex}"
        chunks = stage(chunks.withColumn("_b", self._bucket()), "index-chunks")
        lists = postings(token_table(chunks.select(F.struct("ord", "_b").alias("chunk_id"), "ord", F.col("chunk_text").alias("text"))))
        lists = lists.select(F.col("ord").alias("chunk_id"), "ord", "len", "term", "tf", F.col("chunk_id._b").alias("_b"))
        folders = {}
        # vectors first: if they fail, nothing changed
        for name, table in (("vectors", vectors.withColumn("_b", self._bucket())), ("chunks", chunks), ("postings", lists)):
            order = ["_b", "term"] if name == "postings" else ["_b"]
            table.repartition("_b").sortWithinPartitions(*order).write.partitionBy("_b").parquet(f"{self.root}/{version}/{name}")
            fresh = [f.getPath().getName()[3:] for f in self._fs.listStatus(self._path(f"{self.root}/{version}/{name}")) if f.isDirectory()]
            folders[name] = {b: v for b, v in last["folders"][name].items() if int(b) not in touched} | dict.fromkeys(fresh, version)
        n = self._read("chunks", folders["chunks"]).agg(F.count("*").alias("n"))
        every = self._read("postings", folders["postings"])
        length = every.agg(F.sum("tf").alias("tokens"))  # a chunk's term counts add up to its length
        totals = n.crossJoin(F.broadcast(length)).select("n", F.coalesce(F.col("tokens") / F.col("n"), F.lit(0.0)).alias("avg_len"))
        totals.write.parquet(f"{self.root}/{version}/totals")
        idf(every.groupBy("term").agg(F.count("*").alias("df")), n, self.config).write.parquet(f"{self.root}/{version}/terms")
        top = chunks.agg(F.max("ord")).first()[0]
        held = lambda state: {v for own in state["folders"].values() for v in own.values()} | {state["stats"]}
        now = {"folders": folders, "stats": version, "next": max(last["next"], -1 if top is None else top + 1), "buckets": self.buckets}
        now |= {
            "provider": self.provider,
            "dimension": self.dimension,
            "model": self.model,
            "collection": self.config.collection,
            "before": sorted(held(last) - {None}),
        }
        self._point(now)
        for old in set(last.get("before", ())) - held(now) - held(last):
            self._fs.delete(self._path(f"{self.root}/{old}"), True)

    def _point(self, state: dict) -> None:
        """Puts the pointer in place by a renaming that replaces the old one at once."""
        temporary, current = self._path(f"{self.root}/CURRENT.{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        gateway, options = self.spark.sparkContext._gateway, self._jvm.org.apache.hadoop.fs.Options
        how = gateway.new_array(getattr(options, "Rename"), 1)
        how[0] = getattr(options, "Rename").OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(current), how)

    def add(self, chunks: DataFrame, embedder, replace_document: bool = False) -> int:
        """Upserts chunks and their vectors; with replace_document, chunks that a document no longer
        has go as well (by default they stay). An embedder that fails ends the call and changes nothing."""
        vectors = embedder.embed(F.col("chunk_text"))
        return self.add_embedded(stage(chunks.withColumn("vector", vectors), "embedded"), replace_document)

    def add_embedded(self, rows: DataFrame, replace_document: bool = False) -> int:
        """As add(), for a written table of chunks with their vector."""
        n = rows.count()
        if not n:
            return 0
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # `buckets` numbers at most
        old, old_vectors = self._table("chunks", touched), self._table("vectors", touched)
        if replace_document:
            old, old_vectors = (
                t.join(
                    rows.select("doc_id").distinct(), "doc_id", "left_anti"
                ).select(*t.columns) for t in (old, old_vectors)
            )
        # numbers go on from the last one, document by document, whichever bucket they are in
        ordered = stage(
            rows.repartitionByRange("source_file", "doc_id", "ord").sortWithinPartitions("source_file", "doc_id", "ord").withColumn(
                "_m", F.monotonically_increasing_id()
            ),
            "numbered",
        )
        per_task = sorted(ordered.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("n")).collect())  # one row a task
        before, total = [], (self._state() or {"next": 0})["next"]
        for r in per_task:
            before.append((r[0], total))
            total += r[1]
        offsets = self.spark.createDataFrame(before, "_p long, _before long")
        fresh = ordered.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(offsets), "_p").withColumn(
            "ord", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)
        )
        fresh = fresh.select(*rows.columns)
        kept = old.select("chunk_id", F.col("ord").alias("_old"))
        fresh = fresh.join(kept, "chunk_id", "left").withColumn("ord", F.coalesce("_old", "ord")).drop("_old")
        chunks = old.join(rows.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh.select(*old.columns))
        vectors = old_vectors.join(
            rows.select("chunk_id"), "chunk_id", "left_anti"
        ).unionByName(rows.select("chunk_id", "doc_id", "vector"))
        self._commit(chunks, vectors, touched)
        return n

    def delete(self, *doc_ids: str) -> None:
        gone = self.spark.createDataFrame([(i,) for i in doc_ids], "doc_id string")
        touched = [r[0] for r in gone.select(self._bucket()).distinct().collect()]
        self._commit(
            delete_documents(self._table("chunks", touched), list(doc_ids)),
            delete_documents(self._table("vectors", touched), list(doc_ids)),
            touched,
        )

    def reset(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def needs_rebuild(self) -> bool:
        return not inconsistencies(self.chunks, self.vectors).isEmpty()

    def export_jsonl(self, path: str) -> None:
        self.chunks.write.mode("overwrite").json(path)

    def import_jsonl(self, path: str) -> DataFrame:
        """The chunks of an export, of each id the whole last record by file and line; any bad line makes
        it an empty table. Other failures, a lost executor among them, are raised."""
        read = self.spark.read.schema(CHUNKS).option("mode", "FAILFAST").json(path)
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        try:
            last = read.select("*", place.alias("_at")).groupBy("chunk_id").agg(
                F.max_by(F.struct(*read.columns), "_at").alias("r")
            ).select("r.*")
            return stage(last, "imported")
        except Exception as error:
            if "MALFORMED_RECORD" in str(error):
                return self.spark.createDataFrame([], CHUNKS)
            raise


class History:
    """Turns of conversations, appended and cleared in a folder of Parquet files.

    Clearing writes a mark; turns appended before a conversation's last mark are left out.
    """

    TURNS = "conv_id long, turn_no long, question string, answer string, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def append(self, turns: DataFrame) -> None:
        """turns(conv_id, question, answer): each conversation's go on from its last number."""
        last = self.turns().groupBy("conv_id").agg(F.max("turn_no").alias("_last"))
        order = Window.partitionBy("conv_id").orderBy("_m")
        rows = stage(turns.select("conv_id", "question", "answer").withColumn("_m", F.monotonically_increasing_id()), "turns")
        rows = rows.join(last, "conv_id", "left").withColumn(
            "turn_no", F.coalesce("_last", F.lit(0).cast("long")) + F.row_number().over(order)
        )
        rows.select(
            "conv_id",
            F.col("turn_no").cast("long").alias("turn_no"),
            "question",
            "answer",
            F.current_timestamp().alias("at"),
        ).write.mode("append").parquet(f"{self.root}/turns")

    def clear(self, *conv_ids: int) -> None:
        marks = self.spark.createDataFrame([(i,) for i in conv_ids], "conv_id long").withColumn("at", F.current_timestamp())
        marks.write.mode("append").parquet(f"{self.root}/cleared")

    def turns(self) -> DataFrame:
        """conv_id, turn_no, question, answer of the turns since the last clearing."""
        marks = self._read("cleared", "conv_id long, at timestamp").groupBy("conv_id").agg(F.max("at").alias("_cleared"))
        rows = self._read("turns", self.TURNS).join(marks, "conv_id", "left")
        return rows.where("_cleared is null or at > _cleared").select("conv_id", "turn_no", "question", "answer")
