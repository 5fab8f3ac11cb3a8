"""A folder of project files followed as a stream: each run reads only the files that are new or changed.

Spark's own file stream knows a file by its path and so never reads a changed one again.
Here a listing of the folder (sizes and times, no contents) is joined with the last one,
and what differs is appended to a log of paths; the log is the stream.  A batch of it
takes at most ``FILES`` paths, reads those files as they are then, and hands them to the
indexer; a path that is no longer there is a deletion.  A batch tried again, or a path
named twice, therefore changes nothing, and the order of the log doesn't matter.

The log's files go once their batch is done (``cleanSource``), so what is kept is one
listing, a row a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.folder import Folder
from lodestone.operators.indexer import Indexer
from lodestone.operators.keyed import Keyed
from lodestone.operators.scratch import written
from lodestone.sources import files as source

LISTING = "file_path string, location string, size long, mtime_ns long"
LOG = "file_path string, location string, kind string, size long, mtime_ns long, seq long"
#: Paths in a file of the log, and so in a batch: what the driver holds of it.
FILES = 10_000


def differences(found: DataFrame, known: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(file_path, location, kind, size, mtime_ns) of the paths of a listing that differ from the last one: new, changed or gone; ``again`` for those of ``again`` (file_path) that don't."""
    old = known.select("file_path", F.col("location").alias("_location"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.lit(True).alias("_old"))
    rows = found.withColumn("_new", F.lit(True)).join(old, "file_path", "full_outer")
    kind = F.when(F.col("_new").isNull(), "gone").when(F.col("_old").isNull(), "new").when((F.col("size") != F.col("_size")) | (F.col("mtime_ns") != F.col("_mtime")), "changed")
    if again is not None:
        rows = rows.join(again.select("file_path").distinct().withColumn("_again", F.lit(True)), "file_path", "left")
        kind = F.coalesce(kind, F.when(F.col("_again"), "again"))
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select("file_path", F.coalesce("location", "_location").alias("location"), "kind", "size", "mtime_ns")


class Watch:
    """What is known of the files under ``root`` that the rules of ``scan`` keep; its listing and log lie in ``state``, a folder outside of ``root``."""

    def __init__(self, spark: SparkSession, root: str, state: str, **rules):
        self.spark, self.root, self.state, self.rules = spark, root, state.rstrip("/"), rules
        self.listing = Keyed(spark, f"{self.state}/listing", LISTING, ["file_path"])
        self.log = f"{self.state}/log"

    def note(self, again: DataFrame | None = None) -> int:
        """Lists the folder and logs what differs; how many paths. A listing that isn't kept, as the driver is lost before, is logged once more."""
        seq = self.listing.version() + 1
        found = written(source.scan(self.spark, self.root, locations=True, **self.rules), "listing")
        events = written(differences(found, self.listing.read(), again).withColumn("seq", F.lit(seq).cast("long")), "differences")
        n = events.count()
        if n:
            events.repartition(-(-n // FILES)).write.mode("append").option("maxRecordsPerFile", FILES).parquet(self.log)
            self.listing.change(events.filter("kind IN ('new', 'changed')"), events.filter("kind = 'gone'").select("file_path"))
        return n

    def contents(self, paths: DataFrame) -> DataFrame:
        """The files of a batch (file_path, location; at most ``FILES``) that are there now, with text and hash; of others nothing is read."""
        only = [r["location"] for r in paths.select("location").distinct().limit(FILES + 1).collect()]
        if len(only) > FILES:
            raise ValueError(f"more than {FILES} paths in a batch")
        return written(source.scan(self.spark, self.root, contents=True, only=only, **self.rules), "contents")

    def streamed(self, index: Indexer, checkpoint: str, priority: int = 1) -> StreamingQuery:
        """Takes what the log holds into an index, a file of the log at a time, then stops; started again it goes on after the last batch."""
        Folder(self.spark, self.state).put("log/_log", "")  # a stream's folder must be there

        def sink(batch: DataFrame, _: int) -> None:
            paths = written(batch.select("file_path", "location").distinct(), "paths")
            found = self.contents(paths)
            index.take(found, paths.select("file_path").join(found.select("file_path"), "file_path", "left_anti"), priority)

        log = self.spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("cleanSource", "delete").parquet(self.log)
        return log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(watch: Watch, index: Indexer, checkpoint: str, priority: int = 1) -> int:
    """One round: lists, logs and takes in; also files that couldn't be parsed, until they were tried three times. How many paths were logged."""
    n = watch.note(index.unparsed())
    watch.streamed(index, checkpoint, priority).awaitTermination()
    return n
