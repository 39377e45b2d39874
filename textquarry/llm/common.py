"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word separators of the operators' contracts: space and the ASCII controls 9 to 13.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


_own: list[str] = []
_running: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of
    our own, removed at exit; on a cluster that is an error, as executors would write where nobody reads."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="textquarry-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textquarry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _running:
        _running[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/textquarry/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def salted(n: int, *cols: str):
    """A number in 0..n-1 that depends on the row's values alone, so that a retried task deals rows out alike."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def row_digest(docs: DataFrame) -> Column:
    """A key that only rows which are alike in all columns share."""
    return F.md5(F.to_json(F.struct(*docs.columns)))


SALTS = 32


def salt_bits(salt: Column) -> Column:
    """An aggregate: which salts occur, a bit each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def salts_of(bits: Column, salts: int = SALTS) -> Column:
    """A row for each salt that occurs."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.call_function("getbit", bits, i) == 1))


def join_hot(big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """big joined to small (one row for each key at most) where a key may hold any share of big.

    Rows of big get a salt from their columns `by`; small is repeated for just the salts that occur with a key, so it never
    outgrows big, and a hot key is spread over `salts` tasks. Keys are equal as in SQL: a null meets nothing.
    """
    marked = big.withColumn("_salt_of_row", salted(salts, *by))
    occurring = marked.groupBy(*on).agg(salt_bits(F.col("_salt_of_row")).alias("_bits"))
    spread = small.join(occurring, on).select(*small.columns, salts_of(F.col("_bits"), salts).alias("_salt_of_row"))
    return marked.join(spread, [*on, "_salt_of_row"], how).drop("_salt_of_row")


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written; tables that were written on the way to it are deleted."""
    _running.append([])
    try:
        out = materialise(make())
    finally:
        made = _running.pop()
    for df in made:
        if df is not out:
            forget(df)
    if _running:
        _running[-1].append(out)
    return out


class Pieces(dict):
    """What is known of pieces of text. A miss is noted and answered None; once `size` are held, those not used since go."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.before, self.missed = size, {}, []

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            self.missed.append(key)
        else:
            self[key] = found
        return found

    def learn(self, found: dict) -> None:
        if len(self) > self.size:
            self.before = dict(self)
            self.clear()
        self.update(found)
        self.missed = []


#: Rows of a batch, and bytes of their values, that are Python objects at once (a longer value goes alone).
SLICE, SLICE_BYTES = 512, 8 << 20


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    value = batch.column(0)
    if not (pa.types.is_string(value.type) or pa.types.is_binary(value.type)) or value.nbytes <= SLICE_BYTES:
        yield from (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE))
        return
    size, first, held = pc.fill_null(pc.binary_length(value), 0).to_pylist(), 0, 0
    for i, n in enumerate(size):
        if i > first and (held + n > SLICE_BYTES or i - first == SLICE):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)
_TYPES = {
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()),
    "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "array<long>": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "array<double>": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
}


def per_value(df: DataFrame, column: str, made: dict[str, str], start: Callable, keep: bool = False, many: bool = False, together: bool = False) -> DataFrame:
    """df with the columns `made` (name: type) from one column, in Arrow batches; other columns pass untouched.

    start() is called once in each task and returns a function from a value to a tuple (with many: to a list of tuples,
    each of which becomes a row; with together: from a list of values to a list of results). A column that is named like
    a made one is replaced; `column` goes unless keep. Any names of df's columns will do.
    """
    kept = [f for f in df.schema if f.name not in made and (keep or f.name != column)]
    names, types = [*(f.name for f in kept), *made], [_TYPES[k] for k in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = start()
        for batch in chain.from_iterable(map(_slices, batches)):
            values = batch.column(0).to_pylist()
            rows, others = one(values) if together else [one(v) for v in values], batch.columns[1:]
            if many:
                at = pa.array([i for i, own in enumerate(rows) for _ in own], pa.int64())
                rows, others = list(chain.from_iterable(rows)), [c.take(at) for c in others]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*others, *(pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True))], names=inner)

    fields = [*((f.name, f.dataType) for f in kept), *((n, t) for n, (t, _) in zip(made, types, strict=True))]
    inner = [f"_{i}" for i in range(len(fields))]  # names inside are places, so that no name of df's can clash or need quoting
    schema = T.StructType([T.StructField(i, t) for i, (_, t) in zip(inner, fields, strict=True)])
    held = df.select(F.col(column).alias("value"), *(F.col(quoted(f.name)).alias(i) for i, f in zip(inner, kept, strict=False)))
    return held.mapInArrow(run, schema).toDF(*names)


def quoted(name: str) -> str:
    """A column's name as Spark parses it, dots and back quotes included."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of df has."""
    held, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
