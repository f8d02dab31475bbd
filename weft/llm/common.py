"""Helpers shared by the corpus operators: table access, shared storage, small expression tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the filters that spare rows a shuffle; a full filter costs time only.
FILTER_BITS = 25
#: A word is a run of anything but the six ASCII blanks.
WORD_BREAK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is made up only where it is unset, as in tests on a local master."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the reliable checkpoint folder all executors share."""
    spark = df.sparkSession
    where = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def until_the_end(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the session's JVM ends: intermediate tables outlive the plans that read them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def pin_table(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; narrower on disk than :func:`pin`."""
    where = f"{shared_folder(df.sparkSession)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(where)
    until_the_end(df.sparkSession, where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if it is measured to have ``max_rows`` rows at most, else ``df`` as it is.

    ``df`` should be pinned: its rows are counted here.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def by_filter(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` split by a bitmap of the values of ``key`` in ``wanted``: those that may be in it, and those that surely aren't.

    The bitmap has 2**FILTER_BITS bits, 4 MB, whatever the number of values, and is what is broadcast.
    """
    def bit(c) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))

    maps = wanted.select(bit(key).alias("b")).groupBy(F.expr("b div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("b % 32768")).alias("bits"))
    marked = rows.withColumn("_b", bit(key)).join(F.broadcast(maps), F.expr("_b div 32768") == F.col("bucket"), "left")
    byte = "cast(conv(hex(substring(bits, cast(_b % 32768 div 8 + 1 as int), 1)), 16, 10) as int)"
    hit = F.expr(f"coalesce(shiftright({byte}, cast(_b % 8 as int)) & 1 = 1, false)")
    marked = marked.withColumn("_hit", hit).drop("_b", "bucket", "bits")
    return marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or with underscores before it one that no column has."""
    low = {c.lower() for c in columns}
    while name.lower() in low:
        name = f"_{name}"
    return name


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns, equal for equal rows; maps, which have no hash, by their JSON text."""
    quoted = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    return F.xxhash64(*[F.to_json(F.struct(quoted(f))) if "map<" in f.dataType.simpleString() else quoted(f) for f in df.schema])


def boxed(docs: DataFrame) -> DataFrame:
    """(row, ik, rk): the whole row and the hashes of its doc_id and of all of it, so that columns of any name come through
    a join, and the same two hashes without NULLs serve to join and to fold equal rows."""
    return docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id").alias("ik"), row_hash(docs).alias("rk"))


def keys_of(rows: DataFrame, doc_id, rk, *more: Column) -> DataFrame:
    """(ik, rk) and more of rows that hold the doc_id and the hash of other rows."""
    return rows.select(F.xxhash64(doc_id).alias("ik"), F.col(rk).alias("rk"), *more)


def computed(df: DataFrame, used: list[str], new: list[T.StructField], kinds: list[pa.DataType], fn: Callable, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop`` and with the columns ``new``, which ``fn`` makes from the lists of the columns ``used``.

    All other columns pass as they are, without a detour over pandas types.
    """
    keep = [f for f in df.schema if f.name not in drop and f.name not in {n.name for n in new}]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(*[b.column(c).to_pylist() for c in used])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], [*names, *(n.name for n in new)])

    return df.mapInArrow(run, T.StructType([*keep, *new]))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has, as a long: the parts between blanks without an empty first and last one."""
    return let(
        F.split(F.coalesce(text, F.lit("")), WORD_BREAK),
        lambda p: (F.size(p) - F.when(p[0] == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)),
    ).cast("long")


def uniform(*cols) -> Column:
    """A number in [0, 1) that depends on the columns only, so that reruns agree."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
