"""A user function per file, errors caught per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioroute import constants as K


def map_files(
    files: DataFrame,
    function: Callable[[dict], object],
    result_type: str | T.DataType = "string",
    setup: Callable[[], Callable[[dict], object]] | None = None,
) -> DataFrame:
    """``path, ok, result, error`` of a function called with each row.

    Files are spread by the partitions of ``files``. ``setup`` builds the
    function once per task, for readers that are costly to start.
    """
    kind = T._parse_datatype_string(result_type) if isinstance(result_type, str) else result_type
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("ok", T.BooleanType()),
            T.StructField("result", kind),
            T.StructField("error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = setup() if setup is not None else function
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append((row["path"], True, call(row), None))
                except Exception as problem:
                    rows.append((row["path"], False, None, str(problem)))
            yield pd.DataFrame(rows, columns=schema.names).astype({"result": object})

    return files.mapInPandas(run, schema)


def success_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("ok").alias("succeeded"), F.count("*").alias("total"))


def result_status(results: DataFrame) -> DataFrame:
    """The results with the status and message a file ends with: failed only if
    its job raised. Columns are added in place, so the function runs once."""
    return results.withColumns(
        {
            "status": F.when(F.col("ok"), F.lit(K.DONE)).otherwise(K.FAILED),
            "message": F.when(F.col("ok"), F.lit(K.DONE_MESSAGE)).otherwise(
                F.concat(F.lit(K.FAILED_MESSAGE_PREFIX), F.coalesce("error", F.lit("")))
            ),
        }
    )
