"""Keyed upserts into hash buckets: a batch reads and writes the buckets it touches, once.

The table's state (``sources.durable``) maps each bucket to the folder that holds its rows and
remembers the last batch. A batch reads the buckets of its own keys, merges, writes them to a new
folder and publishes a state that points there; all other buckets stay where they are. A batch
that was published before changes nothing, so a stream that repeats its last batch after a failure
is safe. What is read and written grows with the batch, not with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaline.sources import durable

BUCKETS = 64


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, base: str) -> DataFrame | None:
    """The table's rows; None before the first batch."""
    now = durable.state(spark, base)
    if now is None:
        return None
    schema = spark.createDataFrame([], now["schema"]).schema
    paths = sorted(now["buckets"].values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, base: str, batch: DataFrame, batch_id: int, key: str, version: str, buckets: int = BUCKETS) -> bool:
    """Merge a batch; whether it was new. Of a key the row with the highest version stays, on a tie the batch's.

    Rows without a key are left out. The number of buckets is that of the first batch.
    """
    known, now = durable.pointers(spark, base), durable.state(spark, base)
    if now is not None and batch_id <= now["batch"]:
        return False
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    now = now or {"batch": -1, "count": buckets, "buckets": {}, "schema": schema}
    rows = batch.where(F.col(key).isNotNull()).withColumn("__bucket", bucket_of(key, now["count"])).withColumn("__new", F.lit(1))
    touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
    there = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
    both = rows
    if there:
        old = spark.read.schema(batch.schema).parquet(*there)
        both = rows.unionByName(old.withColumn("__bucket", bucket_of(key, now["count"])).withColumn("__new", F.lit(0)))
    order = F.struct(version, "__new", F.xxhash64(*batch.columns))
    newest = both.groupBy("__bucket", key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("__bucket", "r.*")
    path = durable.fresh(base)
    newest.repartition("__bucket").write.partitionBy("__bucket").parquet(path)
    moved = {str(b): f"{path}/__bucket={b}" for b in touched}
    durable.publish(spark, base, known[-1] if known else 0, {**now, "batch": batch_id, "buckets": {**now["buckets"], **moved}, "written": len(moved)})
    return True


def upsert_stream(spark: SparkSession, source: str, schema: str, key: str, version: str, base: str, checkpoint: str, buckets: int = BUCKETS, files: int | None = None) -> None:
    """Merge the files that arrived since the last call, ``files`` of them a batch, then stop."""
    reader = spark.readStream.schema(schema)
    stream = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(source)
    merge = lambda batch, no: upsert(spark, base, batch, no, key, version, buckets) and None
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def vacuum(spark: SparkSession, base: str) -> int:
    """Remove the data folders that the current state doesn't use; how many went. Earlier states can't be read afterwards."""
    now = durable.state(spark, base)
    if now is None:
        return 0
    used = {path.rsplit("/", 1)[0].rsplit("/", 1)[1] for path in now["buckets"].values()}
    system, at = durable._system(spark, f"{base}/data")
    gone = [f.getPath() for f in system.listStatus(at) if f.getPath().getName() not in used]
    for path in gone:
        system.delete(path, True)
    return len(gone)
