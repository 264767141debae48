"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that ends a word, as a Java and DuckDB regex class body.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder in spark.checkpoint.dir; where that is unset, a folder of this machine if all tasks run in this process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written rows, so that retries start there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like cut(), but as a compressed Parquet table in the checkpoint folder; for wide or large intermediate tables."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


def _bytes(name: str, kind: str) -> Column:
    """About the bytes that a column's value takes in memory."""
    if kind in ("string", "binary"):
        return 16 + F.octet_length(name)
    if kind in ("array<string>", "array<binary>"):
        return 16 + F.aggregate(name, F.lit(0).cast("long"), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0)))
    if kind.startswith("array<"):
        return 16 + F.size(name) * 8 * (1 + kind.count(","))
    return F.lit(8 * (1 + kind.count(",")))


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (best a written table: it is read once more) marked for broadcast if its rows take at most so many bytes, else as it is (a shuffled join)."""
    size = df.agg(F.sum(sum((F.coalesce(_bytes(c, kind), F.lit(8)) for c, kind in df.dtypes), F.lit(16)).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df


def free(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column of taken has it in any case."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where lambdas inside body use it."""
    return F.transform(F.array(value), body)[0]


def before(values: Column, block: int = 512) -> Column:
    """For each whole number of an array, the sum of those before it; worked off in blocks, so a long array costs little more than its length."""

    def sums(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def whole(every: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / block).cast("int")), lambda b: F.slice(every, b * block + 1, block))
        totals = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x))
        return let(blocks, lambda cut_: F.flatten(F.zip_with(cut_, sums(totals, F.lit(0)), sums)))

    return F.when(F.size(values) > 0, let(values, whole)).otherwise(F.array().cast("array<int>"))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+", -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged (lower() alone would also change other alphabets)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
