"""User functions over column batches (Arrow transfer, one pandas frame at a time)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def batch_map(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    drop_input: bool = False,
) -> DataFrame:
    """Apply ``fn`` to each batch.

    ``schema`` describes the columns ``fn`` returns. They are added to the input columns (a
    returned column replaces an input column of the same name), or replace all of them with
    ``drop_input``; batches may then change their number of rows.
    """
    new = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if drop_input:
        out = new
    else:
        kept = [f for f in df.schema if f.name not in new.fieldNames()]
        out = StructType([*kept, *new.fields])
    names, added = out.fieldNames(), new.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = fn(batch)
            if not drop_input:
                result = batch.assign(**{n: result[n].to_numpy() for n in added})
            yield result[names]

    return df.mapInPandas(run, out)
