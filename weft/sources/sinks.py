"""Writing enriched sources and outputs.

What is written is marked, and only what bears the mark is ever written over: a table or folder of somebody else's stays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.errors import ProjectError

FORMATS = ("parquet", "orc", "json", "csv", "avro", "text")
#: Table property and file name that say who wrote a table or folder.
MARK, MARK_FILE = "weft.built", "_weft_built"
#: Text formats keep microseconds and tell NULL from empty text.
OPTIONS = {
    "json": {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"},
    "csv": {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "nullValue": "\\N", "header": "true", "escape": '"', "multiLine": "true"},
}


def _quoted(table: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in table.split("."))


def view_name(table: str) -> str:
    """The temporary view of a virtual output; one with a schema has it in its name, after which two underscores come."""
    return table.replace(".", "__")


def _guard_table(spark: SparkSession, table: str) -> None:
    if not spark.catalog.tableExists(table):
        return
    try:
        mark = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(table)}").collect()}.get(MARK)
    except Exception:  # noqa: BLE001  a temporary view has no properties
        mark = None
    if mark != "true":
        raise ProjectError("target", f"{table} is there and was not built by a project; it is left as it is", table)


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, True)


def _guard_folder(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    if fs.exists(where) and not fs.exists(_file(spark, f"{path}/{MARK_FILE}")[1]) and len(fs.listStatus(where)):
        raise ProjectError("target", "the folder is there and was not built by a project; it is left as it is", path)


def _flat(df: DataFrame, kind: str) -> DataFrame:
    """Arrays, structs and maps as JSON text, where a format has none."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))] if kind == "csv" else []
    return df.withColumns({n: F.to_json(F.col(f"`{n}`")) for n in nested}) if nested else df


def _read(spark: SparkSession, schema: T.StructType, kind: str, where: str) -> DataFrame:
    nested = [f for f in schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))] if kind == "csv" else []
    texts = T.StructType([T.StructField(f.name, T.StringType() if f in nested else f.dataType) for f in schema])
    df = spark.read.schema(texts).options(**OPTIONS.get(kind, {})).format(kind).load(where)
    return df.withColumns({f.name: F.from_json(F.col(f"`{f.name}`"), f.dataType) for f in nested}) if nested else df


def write(spark: SparkSession, df: DataFrame, table: str, path: str | None, kind: str = "parquet", view: bool = False) -> DataFrame:
    """A full refresh of a table, of files under ``path``, or a view; the written rows are returned."""
    if view:
        df.createOrReplaceTempView(view_name(table))
        return df
    if kind not in FORMATS:
        raise ProjectError("sink", f"unknown format {kind}", table)
    if path is None:
        _guard_table(spark, table)
        df.write.mode("overwrite").format("parquet" if kind == "text" else kind).saveAsTable(table)
        spark.sql(f"ALTER TABLE {_quoted(table)} SET TBLPROPERTIES ('{MARK}' = 'true')")
        return spark.table(table)
    where = f"{path}/{table.replace('.', '/')}"
    _guard_folder(spark, where)
    if kind == "text" and (len(df.columns) != 1 or df.dtypes[0][1] != "string"):
        raise ProjectError("sink", "a text file has one string column", table)
    try:
        _flat(df, kind).write.mode("overwrite").options(**OPTIONS.get(kind, {})).format(kind).save(where)
    except Exception as e:
        if kind == "avro" and "avro" in str(e).lower():
            raise ProjectError("sink", "avro needs Spark's avro package on the session's classpath", table) from e
        raise
    fs, mark = _file(spark, f"{where}/{MARK_FILE}")
    fs.create(mark, True).close()
    return spark.read.text(where).toDF(*df.columns) if kind == "text" else _read(spark, df.schema, kind, where)


_PIECE = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|.", re.S)


def statements(script: str) -> list[str]:
    """The statements of an SQL script: cut at semicolons outside quotes and comments; comments are left out."""
    parts = [""]
    for m in _PIECE.finditer(script):
        if m[0] == ";":
            parts.append("")
        elif m[0][:2] in ("--", "/*") and len(m[0]) > 1:
            parts[-1] += " "
        else:
            parts[-1] += m[0]
    return [p.strip() for p in parts if p.strip()]


def run_script(spark: SparkSession, script: str) -> int:
    """Run the statements one after another; the first error ends it, naming the statement."""
    for number, text in enumerate(statements(script), 1):
        try:
            spark.sql(text)
        except Exception as e:
            raise ProjectError("statement", f"statement {number} failed: {str(e).splitlines()[0]}") from e
    return len(statements(script))
