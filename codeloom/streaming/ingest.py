"""Corpus preparation as a stream of files with exact duplicates removed across batches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from codeloom.operators.bitmap import key_bitmap, marked, maybe_in
from codeloom.plans.corpus import accepted, record
from codeloom.session import shared_dir, written

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    format: str = "parquet",
    glob: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.load(path)


def drop_seen(
    rows: DataFrame,
    code: str = "code",
    spread_by: tuple[str, ...] = ("repo", "path"),
    lanes: int | None = None,
    event_time: str | None = None,
    within: str | None = None,
) -> DataFrame:
    """Rows whose content has not been seen before; adds ``code_hash``.

    The state holds every distinct hash. With ``event_time`` and ``within`` (such as ``"2 days"``)
    old hashes are forgotten instead. One hash a row makes one hot task if a content is very
    frequent, so rows are first thinned per hash and lane, in as many lanes as there are shuffle
    partitions; with ``lanes=1`` that step is left out.
    """
    rows = rows.withColumn("code_hash", F.md5(code))
    bounded = bool(event_time and within)
    if bounded:
        rows = rows.withWatermark(event_time, within)

    def once(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.dropDuplicatesWithinWatermark(by) if bounded else rows.dropDuplicates(by)

    lanes = lanes or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if lanes > 1:
        lane = F.pmod(F.xxhash64(*spread_by), F.lit(lanes))
        rows = once(rows.withColumn("_lane", lane), ["code_hash", "_lane"]).drop("_lane")
    return once(rows, ["code_hash"])


def prepared_stream(
    raw: DataFrame,
    lang: str,
    lanes: int | None = None,
    spread_by: tuple[str, ...] = ("repo", "path"),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Records of the accepted rows of a stream, each content once.

    A stream has no ordered limit; take the first N from the output.
    """
    return drop_seen(record(accepted(raw, lang), lang, keep), spread_by=spread_by, lanes=lanes)


def start_ingest(records: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append all records there are now as JSON Lines; the state sits in RocksDB."""
    conf = records.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKSDB)
    try:
        return (
            records.writeStream.format("json")
            .option("path", output)
            .option("checkpointLocation", checkpoint)
            .option("ignoreNullFields", "false")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            conf.unset(STATE_STORE)
        else:
            conf.set(STATE_STORE, before)


def hashed_records(raw: DataFrame, lang: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records of the accepted rows of a stream with their ``code_hash``, repeated contents too."""
    return record(accepted(raw, lang), lang, keep).withColumn("code_hash", F.md5("code"))


def keep_new(batch: DataFrame, number: int, order_by: Sequence[str], digests: str) -> DataFrame:
    """Rows of a batch whose hash is in no earlier batch, each hash once (the first by ``order_by``).

    The digests of the batch are counted and written once, narrow. Those of earlier batches are read below
    ``digests``, and only those that a bitmap of the batch's own lets pass are shuffled; the new ones are written
    to a folder of the batch there. Contents move only if their hash comes again: a bitmap tells the others,
    which go through as they are. So the batch is read three times in all, whichever number it has. A batch that
    is repeated sees the same earlier batches and replaces its folder.
    """
    spark = batch.sparkSession
    rows = batch.withColumn("_digest", F.unhex("code_hash"))
    own = written(rows.groupBy("_digest").agg(F.count("*").alias("n")), "batch-digests")
    new, often = own, own.where("n > 1").select("_digest")
    again = None
    if number > 0:
        earlier = spark.read.schema("_digest binary, batch bigint").parquet(digests).where(F.col("batch") < number)
        near = maybe_in(earlier, "_digest", key_bitmap(own, "_digest")).select("_digest")
        again = written(own.select("_digest").join(near, "_digest", "left_semi"), "seen-digests")
        new, often = own.join(again, "_digest", "left_anti"), often.unionByName(again)
    new.select("_digest").write.mode("overwrite").parquet(f"{digests}/batch={number}")
    both = marked(rows, "_digest", key_bitmap(often, "_digest"))
    met = both.where("_maybe")
    if again is not None:
        met = met.join(again.hint("merge"), "_digest", "left_anti")
    once = met.groupBy("_digest").agg(F.min_by(F.struct(*batch.columns), F.struct(*order_by)).alias("_row"))
    return both.where("NOT _maybe").select(*batch.columns).unionByName(once.select("_row.*"))


def start_digest_ingest(
    records: DataFrame, output: str, checkpoint: str, order_by: str | Sequence[str] = ("repo", "path")
) -> StreamingQuery:
    """Append the records of all files there are now, each ``code_hash`` once, as JSON Lines in a folder a batch.

    No stateful operator: what is remembered is a table of 16-byte digests below ``checkpoint``. Output
    and digests are replaced when a batch is repeated after a failure, so no record is lost or doubled.
    A folder without records is there from the start, so that the output of a stream without a batch can be read.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    spark = records.sparkSession
    spark.createDataFrame([], records.schema).write.mode("overwrite").json(f"{output}/batch=none")

    def settle(batch: DataFrame, number: int) -> None:
        kept = keep_new(batch, number, order_by, f"{checkpoint}/digests")
        kept.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{output}/batch={number}")

    return (
        records.writeStream.foreachBatch(settle)
        .option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True)
        .start()
    )


def digest_ingest_to_table(records: DataFrame, order_by: str | Sequence[str] = ("repo", "path")) -> DataFrame:
    """Run such an ingest to its end in the shared folder and read its output."""
    spark = records.sparkSession
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    start_digest_ingest(records, f"{base}/records", f"{base}/checkpoint", order_by).awaitTermination()
    return read_ingested(spark, f"{base}/records", records.schema)


def read_ingested(spark: SparkSession, output: str, schema: StructType) -> DataFrame:
    """Records of all batches."""
    return spark.read.schema(schema).json(f"{output}/batch=*")


def ingest_to_table(records: DataFrame) -> DataFrame:
    """Run an ingest to its end in the shared folder and read its output."""
    spark = records.sparkSession
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    start_ingest(records, f"{base}/records", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(records.schema).json(f"{base}/records")
