"""Written indexes: versions of Parquet files with a pointer, and imports of JSON shards."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.vectors import quantize

ENTRY = "path string, chunkStart int, chunkEnd int, embedding string, mtime long, chunkHash string, entryType string, summaryText string, tagsText string, highlightsText string, headingPath string"
SHARD = f"model string, shard int, total int, entries array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in ENTRY.split(', '))}>>"


def write_index(entries: DataFrame, path: str, rows_per_file: int = 5000) -> str:
    """Writes a new version by model, then a pointer row to it; returns the version. Readers see the old one until then."""
    version = f"v-{uuid.uuid4().hex}"
    entries.write.partitionBy("model").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{version}")
    spark = entries.sparkSession
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/current")
    return version


def load_index(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """The current version's rows, of one model if given (a pruned partition)."""
    version = spark.read.parquet(f"{path}/current").agg(F.max_by("version", "at")).first()[0]
    df = spark.read.parquet(f"{path}/{version}")
    return df.filter(F.col("model") == model) if model is not None else df


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, key: str = "path", buckets: int = 64, by: tuple[str, ...] = ()) -> None:
    """Writes rows as Parquet partitioned by the columns `by` and by a bucket of the key, so that later changes rewrite the buckets they touch only.

    Every bucket is there, also without rows: it holds a row whose columns are null, which load_buckets() leaves out. Choose the number of buckets by the
    table's size; a bucket is what one change makes Spark read and write.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"bucket": _bucket(key, buckets), "_row": F.lit(True)})
    marks = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(False).alias("_row"))
    if by:
        marks = marks.join(F.broadcast(rows.select(*by).distinct()))
    _arranged(rows.unionByName(marks, allowMissingColumns=True), by).mode("overwrite").parquet(path)


def _arranged(rows: DataFrame, by: tuple[str, ...]):
    return rows.repartition(*by, "bucket").write.partitionBy(*by, "bucket")


def load_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a bucketed table, with their bucket."""
    return spark.read.parquet(path).filter("_row").drop("_row")


def index_buckets(spark: SparkSession, path: str) -> int:
    """Into how many buckets a table was written."""
    return spark.read.parquet(path).filter("not _row").agg(F.max("bucket")).first()[0] + 1


def bucket_numbers(changes: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that changes touch; at most `buckets` numbers."""
    return [r[0] for r in changes.select(_bucket(key, buckets).alias("b")).distinct().collect()]


def save_buckets(rows: DataFrame, path: str, touched: list[int], by: dict[str, str] | None = None, key: str | None = None) -> None:
    """Replaces the touched buckets (under the partition `by`) by rows; other buckets keep their files. All rows must belong to touched buckets."""
    spark, by = rows.sparkSession, by or {}
    if not touched:
        return
    buckets = index_buckets(spark, path)
    key = key or ("path" if "path" in rows.columns else "id")
    rows = rows.withColumns({"bucket": _bucket(key, buckets), "_row": F.lit(True)})
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select("bucket", F.lit(False).alias("_row"), *(F.lit(v).alias(c) for c, v in by.items()))
    _arranged(rows.unionByName(marks, allowMissingColumns=True), tuple(by)).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_keyed_index(df: DataFrame, path: str, model: str) -> str:
    """Tag or manual index: rows stamped with the model that embedded them."""
    return write_index(df.withColumn("model", F.lit(model)), path)


def _bytes(column):
    """Signed bytes of base64 text, in Arrow batches."""

    @F.pandas_udf("array<tinyint>")
    def unpack(s):
        return s.map(lambda b: None if b is None else list(struct.unpack(f"{len(b)}b", b)))

    return unpack(F.unbase64(column))


def load_json_shards(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """Entries of JSON shards (one a file, or one a line); rows without path, offsets or mtime are dropped, a missing type is inferred."""
    shards = spark.read.schema(SHARD).option("multiLine", one_a_file).json(path)
    return shard_entries(shards)


def shard_entries(shards: DataFrame) -> DataFrame:
    rows = shards.select("model", "shard", F.explode("entries").alias("e")).select("model", "shard", "e.*")
    rows = rows.filter("path is not null and chunkStart is not null and chunkEnd is not null and mtime is not null")
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    flat = (F.col("chunkStart") == 0) & (F.col("chunkEnd") == 0)
    kind = F.coalesce("entryType", F.when(flat & (some("summaryText") | some("tagsText")), "summary").when(flat & some("highlightsText"), "highlights").otherwise("content"))
    return rows.withColumn("entryType", kind).withColumn("embedding", _bytes(F.col("embedding")))


def verify_shards(shards: DataFrame, model: str, most: int = 10_000, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each set named by keys): shards, total, ok. A set's shards (shard, total, model) must be numbered 0 to total - 1 once each, agree on total and model; no shards, and nulls, are not ok."""
    some = lambda c: F.count(c) == F.count(F.lit(1))
    s = shards.groupBy(*keys).agg(F.count(F.lit(1)).alias("shards"), F.count_distinct("shard").alias("d"), F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.min("total").alias("t0"), F.max("total").alias("total"), F.min("model").alias("m0"), F.max("model").alias("m1"), (some("shard") & some("total") & some("model")).alias("whole"))
    ok = F.col("whole") & (F.col("shards") == F.col("total")) & (F.col("d") == F.col("total")) & (F.col("lo") == 0) & (F.col("hi") == F.col("total") - 1) & (F.col("t0") == F.col("total")) & F.col("total").between(1, most) & (F.col("m0") == model) & (F.col("m1") == model)
    return s.select(*keys, "shards", "total", F.coalesce(ok, F.lit(False)).alias("ok"))


def load_manual_json(spark: SparkSession, path: str, model: str, one_a_file: bool = True) -> DataFrame:
    """(path, content, embedding) of JSON manual indexes, one a file or one a line: objects with a model and chunks, or bare arrays of chunks (of any model).

    Objects of another model and chunks without path or content are left out; a vector is base64 text or numbers.
    """
    text = spark.read.text(path, wholetext=one_a_file)
    chunk = "struct<path:string,content:string,embedding:string>"
    bare = F.substring(F.trim("value"), 1, 1) == "["
    rows = text.select(F.when(bare, F.lit(model)).otherwise(F.get_json_object("value", "$.model")).alias("model"), F.from_json(F.when(bare, F.col("value")).otherwise(F.get_json_object("value", "$.chunks")), f"array<{chunk}>").alias("chunks"))
    rows = rows.filter(F.coalesce(F.nullif("model", F.lit("")), F.lit(model)) == model).select(F.explode("chunks").alias("c")).select("c.*")
    rows = rows.filter((F.coalesce("path", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != ""))
    numbers = F.col("embedding").startswith("[")
    packed = F.when(numbers, quantize(F.from_json("embedding", "array<double>"))).otherwise(_bytes(F.when(numbers, None).otherwise(F.col("embedding"))))
    return rows.select("path", "content", F.coalesce(packed, F.array().cast("array<tinyint>")).alias("embedding"))
