"""From generated samples and recorded outcomes to scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from codeloom.functions.text import assemble_program, strip_prompt, truncate_next_def
from codeloom.operators.evaluation import (
    K_VALUES,
    capped_samples,
    mean_pass_at_k,
    problem_results,
    with_passed,
)


def programs(
    problems: DataFrame,
    samples: DataFrame,
    include_prompt: bool = True,
    call_check: bool = False,
    cap: int | None = None,
) -> DataFrame:
    """The program to run for each sample.

    ``include_prompt=False`` leaves the prompt (with the function header) out of the program;
    ``call_check`` ends it with a call of the benchmark's check function.
    """
    joined = capped_samples(samples, cap).join(problems, "task_id")
    completion = truncate_next_def(strip_prompt(F.col("generated"), F.col("prompt")))
    return joined.select("task_id", "sample_no", "prompt", "test", "entry_point", completion.alias("completion")).select(
        "task_id",
        "sample_no",
        "completion",
        assemble_program(
            F.col("completion"),
            F.col("test"),
            F.col("prompt") if include_prompt else None,
            F.col("entry_point") if call_check else None,
        ).alias("program"),
    )


def evaluate(
    problems: DataFrame,
    samples: DataFrame,
    k_values: Sequence[int] = K_VALUES,
    cap: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results a problem and mean pass@k, from samples with ``returncode`` and ``timed_out``."""
    outcomes = samples.select("task_id", "sample_no", "returncode", "timed_out")
    results = problem_results(problems, with_passed(capped_samples(outcomes, cap)))
    return results, mean_pass_at_k(results, k_values)
