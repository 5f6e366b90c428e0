"""The stream keeps the same contents as the batch plan, across batches and restarts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.catalog import queries
from codeloom.plans.corpus import prepare_corpus
from codeloom.streaming.ingest import (
    digest_ingest_to_table,
    drop_seen,
    hashed_records,
    ingest_to_table,
    keep_new,
    prepared_stream,
    read_ingested,
    read_stream,
    start_digest_ingest,
    start_ingest,
)


def write_part(spark, folder, ids):
    rows = [(i, "Python" if i % 5 else "go", f"content {i % 37 if i % 3 else 0} ".ljust(60, "x"), f"r{i}", f"p{i}") for i in ids]
    df = spark.createDataFrame(rows, "id bigint, language string, content string, repo_name string, path string")
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


@pytest.mark.parametrize("lanes", [1, 4])
def test_stream_equals_batch(spark, tmp_path, lanes):
    folder = str(tmp_path / "in")
    for start in (0, 100, 200):
        schema = write_part(spark, folder, range(start, start + 100))
    raw = read_stream(spark, folder, schema, files_per_batch=1)
    got = ingest_to_table(prepared_stream(raw, "python", lanes=lanes)).collect()
    want = prepare_corpus(spark.read.parquet(folder), "python", "id").select(F.md5("code")).collect()
    assert sorted(r.code_hash for r in got) == sorted(r[0] for r in want)


def test_restart_remembers(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for start in (0, 60):
        schema = write_part(spark, folder, range(start, start + 60))
        start_ingest(prepared_stream(read_stream(spark, folder, schema), "python"), out, state).awaitTermination()
    got = [r.code_hash for r in spark.read.json(out).collect()]
    want = prepare_corpus(spark.read.parquet(folder), "python", "id").select(F.md5("code")).collect()
    assert len(got) == len(set(got)) and sorted(got) == sorted(r[0] for r in want)


def test_bounded_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:00:00")], "code string, t string")
    folder = str(tmp_path / "in")
    rows.withColumn("t", F.to_timestamp("t")).write.parquet(folder)
    stream = read_stream(spark, folder, spark.read.parquet(folder).schema)
    kept = drop_seen(stream, spread_by=("t",), event_time="t", within="1 day")
    query = kept.writeStream.format("memory").queryName("bounded").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.code for r in spark.table("bounded").collect()) == ["a", "b"]


def test_digests_over_batches_and_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for starts in ((0, 60, 120), (180, 30)):
        for start in starts:
            schema = write_part(spark, folder, range(start, start + 60))
        records = hashed_records(read_stream(spark, folder, schema, files_per_batch=1), "python")
        start_digest_ingest(records, out, state).awaitTermination()
    got = [r.code_hash for r in read_ingested(spark, out, records.schema).collect()]
    want = prepare_corpus(spark.read.parquet(folder), "python", "id").select(F.md5("code")).collect()
    assert len(got) == len(set(got)) and sorted(got) == sorted(r[0] for r in want)
    # digests only, and no state store
    assert sorted(p.name for p in (tmp_path / "state" / "digests").iterdir()) == [f"batch={i}" for i in range(5)]
    assert spark.read.parquet(f"{state}/digests").columns == ["_digest", "batch"]
    assert not (tmp_path / "state" / "stream" / "state").exists()


def test_a_repeated_batch_gives_the_same(spark, tmp_path):
    digests = str(tmp_path / "digests")
    rows = [(f"c{i % 7}", "r", f"p{i}") for i in range(30)]
    first = spark.createDataFrame(rows, "code string, repo string, path string").withColumn("code_hash", F.md5("code"))
    second = first.withColumn("code", F.concat("code", F.pmod(F.hash("path"), F.lit(2)).cast("string")))
    second = second.unionByName(first.limit(9).drop("code_hash").withColumn("code_hash", F.lit(None).cast("string")))
    second = second.withColumn("code_hash", F.md5("code"))
    assert keep_new(first, 0, ["repo", "path"], digests).count() == 7
    once = sorted(map(tuple, keep_new(second, 1, ["repo", "path"], digests).collect()))
    assert once and not {r[0] for r in once} & {r[0] for r in rows}
    assert sorted(map(tuple, keep_new(second, 1, ["repo", "path"], digests).collect())) == once
    assert keep_new(first, 2, ["repo", "path"], digests).count() == 0


def test_an_empty_stream_of_digests(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = write_part(spark, folder, [1])
    raw = read_stream(spark, folder, schema)
    assert digest_ingest_to_table(hashed_records(raw, "rust")).count() == 0


@pytest.mark.parametrize("files", [0, 1, 3])
def test_the_table_may_be_a_folder_of_files(spark, tmp_path, files):
    rows = [(i, "en" if i % 4 else "de", f"content {i % 11} ".ljust(60, "x"), "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, source string")
    folder = str(tmp_path / "documents.parquet")
    if files:
        docs.repartition(files).write.parquet(folder)
    else:
        docs.toPandas().to_parquet(folder)
    want = sorted({r.h for r in docs.where("lang = 'en'").select(F.md5("text").alias("h")).collect()})
    assert sorted(r.code_hash for r in queries()["stream_dedup"](spark, str(tmp_path)).collect()) == want
    assert sorted(r.code_hash for r in queries()["stream_first_n"](spark, str(tmp_path)).collect()) == want
    assert sorted(r.code_hash for r in queries()["stream_restart"](spark, str(tmp_path)).collect()) == want


def test_a_stream_without_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = read_stream(spark, str(tmp_path / "in"), StructType.fromDDL("language string, content string, repo_name string, path string"))
    assert digest_ingest_to_table(hashed_records(raw, "python")).count() == 0


def test_a_batch_is_read_three_times(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(100).selectExpr("concat('c', id % 40) AS code", "id").mapInArrow(counted, "code string, id bigint")
    digests = str(tmp_path / "digests")
    for number in range(3):
        before = read.value
        kept = keep_new(rows.withColumn("code_hash", F.md5("code")), number, ["id"], digests)
        assert len(kept.collect()) == (40 if number == 0 else 0)
        assert read.value - before <= 300
