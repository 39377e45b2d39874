"""A sink for streams of chunks: batches merge into a table keyed by document, each once however often it comes.

The table is cut into buckets by a hash of the document; a batch rewrites the buckets of its documents only, in a folder of its
own, and then commits by renaming one small manifest (bucket -> folder) into place. A reader takes the newest manifest,
so it sees all of a batch or nothing; a batch whose manifest is there is skipped, and one that broke off is written anew.
What a document had before goes when the document comes again, so a shorter text leaves no old chunks behind.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import _file_system


class ChunkTable:
    """A table under path of chunks keyed by `doc` and `key`; parts with a null document share a bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, doc: str = "doc_id", key: str = "chunk_id", buckets: int = 64):
        self.spark, self.path, self.schema, self.doc, self.key, self.buckets = spark, path, schema, doc, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.doc), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[int]:
        """The batches that are in, oldest first."""
        fs, make = _file_system(self.spark, self.path)
        at = make(f"{self.path}/_commits")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        done = self.commits()
        if not done:
            return {}
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/_commits/{done[-1]}").collect())  # a line a table
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, some: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{v}" for k, v in sorted(self.manifest().items()) if some is None or k in some]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def merge(self, new: DataFrame, batch_id: int, docs: DataFrame | None = None) -> bool:
        """Put the chunks of a batch in the place of all that its documents had; False if the batch is in already.

        docs: the documents of the batch (column doc), for those that no longer have any chunk. Of chunks with one key the
        greatest row stays. A batch before the newest committed one is a replay, too.
        """
        done = self.commits()
        if done and batch_id <= done[-1]:
            return False
        rest = [f.name for f in self.schema if f.name not in (self.doc, self.key)]
        fresh = new.select(*self.schema.names).groupBy(self.doc, self.key).agg(F.max(F.struct(*rest)).alias("_r")).select(self.doc, self.key, "_r.*").select(*self.schema.names)
        came = (new if docs is None else docs.select(self.doc).unionByName(new.select(self.doc))).select(self.doc).distinct()
        touched = sorted(r[0] for r in came.select(self._bucket().alias("b")).distinct().collect())  # a number a bucket
        held = self.read(touched)
        kept = held.alias("h").join(came.alias("n"), F.col(f"h.{self.doc}").eqNullSafe(F.col(f"n.{self.doc}")), "left_anti")
        out = kept.unionByName(fresh).withColumn("bucket", self._bucket())
        folder = f"data/batch={batch_id}"
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = {b: f"{folder}/bucket={b}" for b in touched}
        self._commit({**self.manifest(), **made}, batch_id)
        return True

    def _commit(self, manifest: dict[int, str], batch_id: int) -> None:
        fs, make = _file_system(self.spark, self.path)
        text, begun = json.dumps({str(k): v for k, v in manifest.items()}), make(f"{self.path}/_begun/{batch_id}")
        stream = fs.create(begun, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs.mkdirs(make(f"{self.path}/_commits"))
        if not fs.rename(begun, make(f"{self.path}/_commits/{batch_id}")):
            raise OSError(f"batch {batch_id} was committed meanwhile")

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest does not name; returns how many."""
        fs, make = _file_system(self.spark, self.path)
        live, gone = set(self.manifest().values()), 0
        for batch in fs.listStatus(make(f"{self.path}/data")) if fs.exists(make(f"{self.path}/data")) else []:
            for folder in fs.listStatus(batch.getPath()):
                name = f"data/{batch.getPath().getName()}/{folder.getPath().getName()}"
                if folder.isDirectory() and name not in live:
                    gone += bool(fs.delete(folder.getPath(), True))
        return gone

    def stream(self, docs: DataFrame, chunks: Callable[[DataFrame], DataFrame], checkpoint: str, **options):
        """A query that merges the chunks of a stream of documents; its batch numbers are the commit log's, so replays change nothing."""
        return docs.writeStream.foreachBatch(lambda df, i: self.merge(chunks(df), i, df)).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
