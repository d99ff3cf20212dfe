"""What the operators of this subpackage share: tables, staging, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.files import read_table as read_parquet
from ..sources.staging import bounded_batches

#: Used only where the session names no spark.checkpoint.dir (tests, notebooks).
LOCAL_STAGE = "file:///tmp/checkpoints"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared checkpoint folder and reads it back.

    Lineage ends at the written table, so a lost executor costs its unfinished tasks only, and
    several consumers read one result instead of running its plan again. The folder goes when the
    session's file system closes.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_STAGE
    root = root.rstrip("/")
    path = f"{root}/lectio/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def join_by_size(rows: DataFrame, side: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows.join(side, keys), where side has one row per key and says in `size` how many rows have it.

    Keys with more than a 10,000th of all `total` rows are met by broadcast (there are fewer than
    10,000 such), so that no task gets all rows of a common key. side is read three times: a written
    table, or an aggregate whose shuffle Spark reuses.
    """
    common = F.col(size) > max(1000, total // 10_000)
    large = F.broadcast(side.where(common))
    return rows.join(large, keys).unionByName(rows.join(large.select(*keys), keys, "left_anti").join(side.where(~common), keys))


def unstage(*tables: DataFrame) -> None:
    """Deletes written tables whose consumers are all written themselves."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        give_back(tables[0].sparkSession)


#: Seconds between two collections of the driver's garbage, and when the last one ended.
GIVE_BACK_S = 4
_given = [float("-inf")]


def give_back(spark: SparkSession) -> bool:
    """The driver collects its garbage, upon which Spark deletes the shuffle files and broadcasts that nothing
    refers to any more, and its JVM gives free memory back to the system; not more often than every GIVE_BACK_S
    seconds. An operator of many small steps else fills the driver's heap, and what compilers and threads of
    past steps took stays with the allocator. Returns whether free native memory was given back, too."""
    if time.monotonic() - _given[0] < GIVE_BACK_S:
        return False
    jvm = spark.sparkContext._jvm
    gc.collect()  # Python's references keep the JVM's plans
    jvm.System.gc()
    try:  # the bean's class is closed to reflection, its interface isn't
        kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        named = jvm.java.lang.Class.forName
        invoke = named("javax.management.MBeanServer").getMethod("invoke", _array(spark, jvm.Class, [named(k) for k in kinds]))
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(server, _array(spark, jvm.Object, [bean, "systemTrimNativeHeap", None, None]))
        trimmed = True
    except Py4JError:  # another JVM or C library
        trimmed = False
    _given[0] = time.monotonic()
    return trimmed


def _array(spark: SparkSession, kind, items: list):
    out = spark.sparkContext._gateway.new_array(kind, len(items))
    for i, x in enumerate(items):
        out[i] = x
    return out


def slices(df: DataFrame, groups: int, rows: int = 50_000, least: int = 128) -> int:
    """How many slices cut each of `groups` even groups of df to about `rows` rows."""
    return max(least, -(-df.count() // (rows * groups)))


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts at a time are Python strings; at the task's end
    the worker, which lives on, gives its free memory back to the system."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def by_size(group: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """Consecutive groups of texts of about so many characters, one text at least."""
    part: list[str] = []
    total = 0
    for t in group:
        if part and total + len(t) > chars:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def held_out(doc_id: str, mod: int, rest: int):
    """Whether crc32 of the id as text leaves `rest`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod == rest


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column | None, per_class: tuple[int, int], max_chars: int
) -> DataFrame:
    """(text, label): at most per_class[label] labelled texts of each class for which `keep` holds, one of each id.

    Ids are picked by a hash order among the labelled documents, for which ids and lengths alone are
    joined; only the bounded list of picks (sum(per_class) ids) reaches the driver and meets the texts,
    as a broadcast. Texts of at most max_chars come first. Where a class lacks them, longer ones follow,
    the shortest first and whole, as long as the class stays within per_class * max_chars characters.
    One text is taken at least, its first per_class * max_chars characters if it alone is longer.
    Scoring always reads whole texts.
    """
    known = labels.where(
        F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.lit(True) if keep is None else keep)
    ).select(F.col("doc_id").alias("_i"), F.col(label).cast("int").alias("_y"))
    long = F.greatest(F.col("_l"), F.lit(max_chars))
    texts_of = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t")).where(F.col("_t").isNotNull())
    lengths = texts_of.select("_d", F.length("_t").alias("_l")).join(
        known, F.col("_d") == F.col("_i")
    ).groupBy("_i", "_y").agg(F.min("_l").alias("_l"))
    lengths = lengths.select("_i", "_y", "_l", long.alias("_o"), F.xxhash64("_i", "_y").alias("_h"))
    picked = None
    for y in (0, 1):
        part = lengths.where(F.col("_y") == y).orderBy("_o", "_h", "_i").limit(per_class[y])
        picked = part if picked is None else picked.unionByName(part)
    rows, room = [], [n * max_chars for n in per_class]
    full = list(room)
    for r in sorted(picked.collect(), key=lambda r: (r["_y"], r["_o"], r["_h"], r["_i"])):
        if r["_l"] <= room[r["_y"]] or room[r["_y"]] == full[r["_y"]]:
            rows.append((r["_i"], r["_y"], r["_o"]))
            room[r["_y"]] -= r["_l"]
    chosen = docs.sparkSession.createDataFrame(rows, StructType([*known.schema.fields, StructField("_o", IntegerType())]))
    found = (
        texts_of.join(F.broadcast(chosen), F.col("_d") == F.col("_i"))
        .where(F.length("_t") <= F.col("_o"))
        .select("_d", F.substring("_t", F.lit(1), F.when(F.col("_y") == 0, full[0]).otherwise(full[1])).alias("_t"), "_y")
    )
    return found.groupBy("_d", "_y").agg(F.min("_t").alias("text")).select("_d", "text", F.col("_y").alias("label"))


def fit_in_task(rows: DataFrame, fit: Callable[[list[tuple[str, int]]], object]) -> object:
    """fit's model of the (bounded) training rows, made in one task, so that a lost executor costs a
    repeated task and the driver holds the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(found))], pa.binary())], ["model"])

    one = rows.repartition(1).sortWithinPartitions("_d", "label", "text").select("text", "label")
    made = one.mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([])
