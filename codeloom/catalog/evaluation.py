"""Evaluation queries; orders stand for problems, their line items for samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.catalog.registry import query, table
from codeloom.functions.scoring import argmax
from codeloom.functions.text import display_cut, function_name, strip_prompt, truncate_next_def
from codeloom.operators.batchmap import batch_map
from codeloom.operators.columns import rename_target
from codeloom.operators.evaluation import (
    capped_samples,
    compare_runs,
    evaluation_totals,
    mean_pass_at_k,
    problem_pass_at_k,
    problem_results,
    with_passed,
)
from codeloom.operators.labels import drop_label_conflicts
from codeloom.operators.metrics import best_checkpoint, binary_metrics
from codeloom.plans.classifier import held_out, train_and_evaluate
from codeloom.plans.evaluation import programs
from codeloom.sources.sinks import scores_json

SAMPLE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def problems(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("task_id"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes: a returned item is a failure, a large one in an open status ran out of time."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("task_id"),
        *SAMPLE_KEY,
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returncode"),
        ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)).alias("timed_out"),
    )


PASSED_SQL = "(l_returnflag <> 'R' AND NOT (l_linestatus = 'O' AND l_quantity > 40))"


def results_sql(cap: int | None = None) -> str:
    limit = f"QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(SAMPLE_KEY)}) <= {cap}" if cap else ""
    return f"""WITH taken AS (
      SELECT l_orderkey AS task_id, l_linenumber, l_partkey, l_suppkey, {PASSED_SQL} AS passed
      FROM lineitem {limit}),
    results AS (
      SELECT o_orderkey AS task_id, count(t.task_id) AS n_samples,
             count(*) FILTER (WHERE t.passed) AS correct
      FROM orders LEFT JOIN taken t ON t.task_id = o_orderkey GROUP BY 1)"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    return problem_results(problems(spark, folder), with_passed(samples(spark, folder)))


@query(
    "capped_samples",
    results_sql(3) + " SELECT task_id, l_linenumber, l_partkey, l_suppkey, passed FROM taken",
)
def cap_samples(spark: SparkSession, folder: str) -> DataFrame:
    taken = with_passed(capped_samples(samples(spark, folder), 3, order_by=SAMPLE_KEY))
    return taken.select("task_id", "l_linenumber", "l_partkey", "l_suppkey", "passed")


@query(
    "capped_hot_group",
    """SELECT event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 1500""",
)
def capped_hot_group(spark: SparkSession, folder: str) -> DataFrame:
    """A few very large groups, limited to more rows than are limited before the shuffle."""
    events = table(spark, folder, "events").select("event_type", "event_id")
    return capped_samples(events, 1500, "event_type", "event_id")


@query("problem_results", results_sql() + " SELECT * FROM results")
def count_results(spark: SparkSession, folder: str) -> DataFrame:
    return results(spark, folder)


@query(
    "evaluation_totals",
    results_sql()
    + " SELECT CAST(sum(correct) AS BIGINT) AS total_correct, CAST(sum(n_samples) AS BIGINT) AS total_samples FROM results",
)
def totals(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation_totals(results(spark, folder))


SCORED_SQL = """,
    ks AS (SELECT unnest([1, 2, 3, 4, 100]) AS k),
    scored AS (
      SELECT task_id, n_samples, correct, CAST(k AS BIGINT) AS k,
             CASE WHEN n_samples = 0 THEN 0.0 WHEN n_samples - correct < k THEN 1.0
                  ELSE 1.0 - coalesce(list_product(list_transform(range(k),
                         lambda i: (n_samples - correct - i) / (n_samples - i))), 1.0) END AS score
      FROM results, ks)"""


@query(
    "pass_at_k",
    results_sql() + SCORED_SQL + " SELECT task_id, n_samples, correct, k, round(score, 9) AS score FROM scored",
)
def score_problems(spark: SparkSession, folder: str) -> DataFrame:
    scored = problem_pass_at_k(results(spark, folder), [1, 2, 3, 4, 100])
    return scored.withColumn("score", F.round("score", 9))


@query(
    "pass_at_k_mean",
    results_sql()
    + SCORED_SQL
    + """ SELECT k, round(avg(score), 9) AS score FROM scored
    WHERE k <= (SELECT sum(n_samples) // count(*) FROM results) GROUP BY k""",
)
def score_mean(spark: SparkSession, folder: str) -> DataFrame:
    return mean_pass_at_k(results(spark, folder), [1, 2, 3, 4, 100]).withColumn("score", F.round("score", 9))


@query(
    "scores_json",
    results_sql()
    + SCORED_SQL
    + """, means AS (SELECT k, round(avg(score), 6) AS score FROM scored
    WHERE k <= (SELECT sum(n_samples) // count(*) FROM results) GROUP BY k)
    SELECT '{' || string_agg('"pass@' || k || '":' || score, ',' ORDER BY k) || '}' AS value FROM means""",
)
def json_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scores_json(mean_pass_at_k(results(spark, folder), [1, 2, 3, 4, 100]).withColumn("score", F.round("score", 6)))


@query(
    "run_compare",
    """SELECT l_returnflag AS metric,
           round(avg(CASE WHEN l_linestatus = 'O' THEN l_discount END), 9) AS before,
           round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount END), 9) AS after,
           round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount END)
               - avg(CASE WHEN l_linestatus = 'O' THEN l_discount END), 9) AS delta
    FROM lineitem GROUP BY 1""",
)
def run_compare(spark: SparkSession, folder: str) -> DataFrame:
    scores = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_linestatus").alias("run"), F.col("l_returnflag").alias("metric"))
        .agg(F.avg("l_discount").alias("score"))
    )
    compared = compare_runs(scores, "O", "F")
    return compared.select("metric", *(F.round(c, 9).alias(c) for c in ("before", "after", "delta")))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn as a prompt, with the following turn behind it as generated text."""
    talk = table(spark, folder, "conversations")
    after = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return talk.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("prompt"), "reply", F.concat("text", "reply").alias("generated")
    )


TURNS_SQL = """WITH turns AS (
    SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS reply
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"""


@query("strip_prompt", TURNS_SQL + " SELECT conv_id, turn, reply AS completion FROM turns")
def cut_prompt(spark: SparkSession, folder: str) -> DataFrame:
    completion = strip_prompt(F.col("generated"), F.col("prompt")).alias("completion")
    return turns(spark, folder).select("conv_id", "turn", completion)


DEFS_SQL = """CASE WHEN doc_id % 3 = 0 THEN 'def ' || text ELSE text END"""


@query(
    "truncate_next_def",
    f"""WITH code AS (
      SELECT doc_id, string_split(replace(replace({DEFS_SQL}, chr(10) || 'E', chr(10) || 'def E'),
             chr(10) || 'A', chr(10) || 'class A'), chr(10)) AS parts FROM documents),
    stops AS (
      SELECT doc_id, parts, list_min(list_filter(range(2, len(parts) + 1),
        lambda i: starts_with(parts[i], 'def ') OR starts_with(parts[i], 'class '))) AS stop FROM code)
    SELECT doc_id, array_to_string(list_slice(parts, 1, coalesce(stop - 1, len(parts))), chr(10)) AS completion FROM stops""",
)
def cut_next_def(spark: SparkSession, folder: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("def "), "text")).otherwise(F.col("text"))
    code = F.replace(F.replace(code, F.lit("\nE"), F.lit("\ndef E")), F.lit("\nA"), F.lit("\nclass A"))
    return table(spark, folder, "documents").select("doc_id", truncate_next_def(code).alias("completion"))


@query(
    "display_cut",
    """WITH code AS (
      SELECT doc_id, string_split(CASE WHEN doc_id % 4 = 0 THEN ' ' || chr(10) ELSE '' END ||
             replace(text, '. ', chr(10) || ' ' || chr(9) || chr(160) || chr(10)), chr(10)) AS parts FROM documents),
    stops AS (
      SELECT doc_id, parts, list_min(list_filter(range(2, len(parts) + 1),
        lambda i: trim(parts[i], ' ' || chr(9) || chr(160)) = '')) AS stop FROM code)
    SELECT doc_id, array_to_string(list_slice(parts, 1, coalesce(stop, len(parts))), chr(10)) AS display FROM stops""",
)
def cut_display(spark: SparkSession, folder: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 4 == 0, " \n").otherwise("")
    code = F.concat(head, F.replace("text", F.lit(". "), F.lit("\n \t\xa0\n")))
    return table(spark, folder, "documents").select("doc_id", display_cut(code).alias("display"))


@query(
    "function_name",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'candidate' ELSE 'f_' || lang || doc_id END AS name FROM documents""",
)
def name_function(spark: SparkSession, folder: str) -> DataFrame:
    header = F.concat(F.lit("\ndef  f_"), "lang", "doc_id", F.lit(" (x):\n  def g(y)"))
    prompt = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("("), F.lit(""))).otherwise(
        F.concat(F.replace("text", F.lit("def"), F.lit("")), header)
    )
    return table(spark, folder, "documents").select("doc_id", function_name(prompt).alias("name"))


@query(
    "programs",
    TURNS_SQL
    + """ SELECT conv_id * 100 + turn AS task_id, 1 AS sample_no, reply AS completion,
           prompt || reply || chr(10) || chr(10) || 'assert ' || turn || chr(10) || chr(10)
             || 'check(f' || conv_id || ')' || chr(10) AS program
    FROM turns""",
)
def build_programs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = turns(spark, folder).withColumn("task_id", F.col("conv_id") * 100 + F.col("turn"))
    tasks = pairs.select(
        "task_id",
        "prompt",
        F.concat(F.lit("assert "), "turn").alias("test"),
        F.concat(F.lit("f"), "conv_id").alias("entry_point"),
    )
    made = pairs.select("task_id", F.lit(1).alias("sample_no"), "generated")
    return programs(tasks, made, call_check=True)


@query(
    "argmax",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted FROM embeddings""",
)
def pick_class(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("predicted"))


@query(
    "binary_metrics",
    """WITH c AS (
      SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS tp,
             count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS fp,
             count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS fn,
             count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS tn FROM labels)
    SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
           round(tp / (tp + fn), 9) AS recall,
           round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1 FROM c""",
)
def metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").select(
        F.col("quality").alias("labels"), (1 - F.col("toxic")).alias("predicted")
    )
    scored = binary_metrics(rows)
    return scored.select(*(F.round(c, 9).alias(c) for c in scored.columns))


@query(
    "best_checkpoint",
    """SELECT event_type AS run, min(event_id) AS step, f1 FROM (
      SELECT event_type, event_id, value AS f1, max(value) OVER (PARTITION BY event_type) AS best FROM events)
    WHERE f1 = best GROUP BY 1, 3""",
)
def pick_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("f1")
    )
    return best_checkpoint(log)


@query("rename_target", "SELECT doc_id, toxic AS labels FROM labels")
def rename_label(spark: SparkSession, folder: str) -> DataFrame:
    return rename_target(table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("target")))


@query(
    "label_conflicts",
    """WITH rows AS (SELECT doc_id, text, doc_id % 2 AS label FROM documents)
    SELECT doc_id, label FROM rows r
    WHERE NOT EXISTS (SELECT 1 FROM rows o WHERE o.text = r.text AND o.label <> r.label)""",
)
def clean_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text", (F.col("doc_id") % 2).alias("label"))
    return drop_label_conflicts(rows, "text", "label").select("doc_id", "label")


@query("batch_map", "SELECT doc_id, n_chars, n_chars * 2 AS doubled FROM documents")
def map_batches(spark: SparkSession, folder: str) -> DataFrame:
    def double(batch):
        return batch.assign(doubled=batch["text"].str.len() * 2)[["doubled"]]

    mapped = batch_map(table(spark, folder, "documents").select("doc_id", "n_chars", "text"), double, "doubled bigint")
    return mapped.select("doc_id", "n_chars", "doubled")


@query(
    "batch_map_drop",
    """SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark""",
)
def map_batches_drop(spark: SparkSession, folder: str) -> DataFrame:
    """All input columns dropped, several rows out for one in."""

    def words(batch):
        return batch.assign(word=batch["text"].str.split(" ")).explode("word")[["item_id", "word"]]

    return batch_map(table(spark, folder, "benchmark"), words, "item_id bigint, word string", drop_input=True)


@query(
    "classifier_separable",
    """SELECT count(*) AS held_out, true AS learned FROM documents
    WHERE CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) % 100 < 20""",
)
def classify_separable(spark: SparkSession, folder: str) -> DataFrame:
    """A label that follows from the words (English or not) is learned from the other rows: four in five right."""
    label = (F.col("lang") == "en").cast("int").alias("labels")
    rows = table(spark, folder, "documents").select(F.col("text").alias("func"), label)
    test = rows.where(held_out(F.col("func")))
    metrics = train_and_evaluate(rows, features=1 << 16, spread=spark.sparkContext.defaultParallelism)
    return test.agg(F.count("*").alias("held_out")).crossJoin(metrics.select((F.col("accuracy") >= 0.8).alias("learned")))


@query("train_classifier")
def train_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics on held-out documents; equal contents stay on one side."""
    rows = (
        table(spark, folder, "documents")
        .join(table(spark, folder, "labels"), "doc_id")
        .select(F.col("text").alias("func"), F.col("quality").alias("labels"))
    )
    return train_and_evaluate(rows, features=1 << 16, spread=spark.sparkContext.defaultParallelism)
