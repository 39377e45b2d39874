"""Written tables in the folder that driver and executors share, and joins in which a key may hold any share of the rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own for a local master, removed at exit, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="textquarry-core-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/textquarry/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: computed once, however often it is read, and safe when executors are lost."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that are Python objects at once, and characters of text about.
SLICE, SLICE_CHARS = 256, 4 << 20


def slices(batches: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """The batches in pieces of few rows and characters (a longer text goes alone), so that what is made of a batch is not
    held whole. No row is left out; an empty batch is one empty piece."""
    for b in batches:
        size, first, held = [len(t) if isinstance(t, str | bytes) else 0 for t in b[text]], 0, 0
        for i, n in enumerate(size):
            if i > first and (held + n > SLICE_CHARS or i - first == SLICE):
                yield b.iloc[first:i]
                first, held = i, 0
            held += n
        yield b.iloc[first:]


def join_salted(big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """big joined to small where a key may hold any share of big: big's rows take a salt from the columns `by`, small is
    repeated for each salt. small may have several rows for a key."""
    salt: Column = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    spread = small.withColumn("_salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt_", salt).join(spread, [*on, "_salt_"], how).drop("_salt_")


#: Rows of a table that may be sent to all tasks.
FEW_ROWS = 1_000_000


def join_few(big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """big joined to a written table that has few rows as a rule: these are sent to all tasks, so that big stays where it is;
    a table of more is joined by salt."""
    return big.join(F.broadcast(small), on, how) if small.count() <= FEW_ROWS else join_salted(big, small, on, by, how)


def join_hot(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 32, share: int = 1000) -> DataFrame:
    """big joined to small (one row for each key at most, however wide) where a key may hold any share of big.

    Keys with more than one part in `share` of big's rows, fewer than `share` of them, are marked on both sides by a
    broadcast; their rows are dealt out by place, and their rows in small repeated for each salt. All others join as they are.
    """
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n_"))
    total = counts.agg(F.sum("_n_").alias("_all_"))  # one row
    hot = F.broadcast(counts.join(F.broadcast(total), F.col("_n_") * share > F.col("_all_")).select(*on, F.lit(True).alias("_hot_")))
    place = F.when(F.col("_hot_"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int")
    places = F.when(F.col("_hot_"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(hot, on, "left").withColumn("_salt_", place).drop("_hot_")
    right = small.join(hot, on, "left").withColumn("_salt_", F.explode(places)).drop("_hot_")
    return left.join(right, [*on, "_salt_"], how).drop("_salt_")
