"""Spark-side helpers of the training-data operators: inputs, keys, tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only on a local master that names none (tests, a laptop) a temporary
    folder is made and set, so that one session keeps one folder; on a cluster
    that would be no shared folder, and an error is raised.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vellumine-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of an Arrow batch to and from Python; texts are long, and both sides hold a batch or two.
BATCH_ROWS, _SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Tables that ``saved`` has written, by application.
_written: dict[str, list[str]] = {}


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage: work after it survives lost executors without repeating
    what led to the table. Results read such tables, so that they stay until
    ``clear``. A session that has left the rows of Arrow batches at Spark's
    10,000 goes on with BATCH_ROWS.
    """
    spark = df.sparkSession
    if spark.conf.get(_SETTING) == "10000":
        spark.conf.set(_SETTING, BATCH_ROWS)
    path = f"{shared_folder(spark).rstrip('/')}/vq-{what}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that operators of this session have written between jobs; how many. For when all results are written."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a table, by ``table_bytes``, up to which ``broadcast_if_small`` broadcasts it.
BROADCAST_BYTES = 24 << 20


def _width(c: Column, kind: DataType) -> Column:
    """The bytes of a value, list elements and text included."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, ArrayType):
        each = F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType))
        return F.coalesce(each, F.lit(0)) + 16
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """The bytes of a saved table's rows, lists and texts in them counted in full."""
    size = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, a saved table, marked for broadcast if its bytes are few; else Spark shuffles it."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


#: A key with more than one in so many of all rows is joined by broadcast: there are no more such keys.
HOT_SHARE = 1000


def with_known(rows: DataFrame, known: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``known`` (a saved table with one row for each key, which counts its rows in ``count``).

    Rows of hot keys never meet in one task: these keys, HOT_SHARE at most,
    are broadcast to the rows where they are.
    """
    total = known.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.broadcast(known.where(F.col(count) * HOT_SHARE > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(known.where(F.col(count) * HOT_SHARE <= total), key)
    return rows.join(hot, key).unionByName(rest).drop(count)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


RUNS = "array<struct<a:bigint,b:bigint>>"


def merged_runs(pieces: Column) -> Column:
    """The union of runs (a, b), as an array in order; runs that touch are one."""
    none = F.struct(F.array().cast(RUNS).alias("out"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))

    def closed(s: Column) -> Column:
        return F.when(s["a"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))

    def add(s: Column, p: Column) -> Column:
        on = F.coalesce(p["a"] <= s["b"], F.lit(False))
        return F.when(on, F.struct(s["out"].alias("out"), s["a"].alias("a"), F.greatest(s["b"], p["b"]).alias("b"))).otherwise(F.struct(closed(s).alias("out"), p["a"].alias("a"), p["b"].alias("b")))

    return F.aggregate(F.array_sort(pieces), none, add, closed)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, text) of ``docs``: id as long, hash of the text, text; other columns are not read.

    (doc_id, h) is the key of a row. Rows that repeat both are the same row to
    every operator and get the same verdicts; rows that share the id only are
    told apart. Joins on it are null-safe (``joined``).
    """
    t = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("h"), t.alias("text"))


def map_texts(rows: DataFrame, compute, fields: str) -> DataFrame:
    """``rows`` without ``text``, with the arrays that ``compute(Texts)`` makes for it as ``fields``.

    Works on slices of an Arrow batch, so memory follows the slice and the
    longest text, not the partition.
    """
    import pyarrow as pa

    from vellumine.llm import words as W

    carried = [c for c in rows.columns if c != "text"]
    schema = rows.select(*carried).schema
    for name, kind in (f.split() for f in fields.split(",")):
        schema = schema.add(name, StructType.fromDDL(f"{name} {kind}")[0].dataType)
    names = schema.names

    def of_batches(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                made = [pa.array(x) for x in compute(W.Texts(part.column("text")))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *made], names)
        W.release()

    return rows.mapInArrow(of_batches, schema)


def joined(docs: DataFrame, verdicts: DataFrame, how: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` joined null-safely with ``verdicts`` (doc_id, h, more) by row key.

    All columns of ``docs`` stay under their own names, whatever those are;
    the other columns of ``verdicts`` follow, named as there.
    """
    i, h = unused(docs, "vq_id"), unused(docs, "vq_h")
    v = verdicts.withColumnsRenamed({"doc_id": i, "h": h})
    on = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(h))
    return docs.join(v, on, how) if how in ("left_semi", "left_anti") else docs.join(v, on, how).drop(i, h)
