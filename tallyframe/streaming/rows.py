"""Running row-level operators on a stream of files.

The operators that only add, change or filter columns (folding, scoring, tagging, filters,
scope detection) take a streaming DataFrame as they take a table. No state is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from tallyframe.session import scratch_path


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_files: int | None = None,
    name_pattern: str | None = None,
) -> DataFrame:
    """New Parquet files of a folder as a stream; ``max_files`` bounds one micro-batch.

    ``name_pattern`` picks tables in the folder by name, be they single files or folders of part files.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if name_pattern is None:
        return reader.parquet(path)
    # Only a path with a pattern may name a file or a folder, so a plain name is made one.
    glob = name_pattern if re.search(r"[*?\[{]", name_pattern) else f"{name_pattern[:-1]}[{name_pattern[-1]}]"
    return reader.parquet(f"{path.rstrip('/')}/{glob}")


def write_available(
    stream: DataFrame,
    operator: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str | None = None,
    timeout: float | None = None,
) -> None:
    """Apply the operator to everything available now and append the rows to ``out``.

    The checkpoint lies in the shared folder, so a restarted run neither loses nor repeats a
    file; the Parquet sink commits each micro-batch once.
    """
    state = checkpoint or scratch_path(stream.sparkSession, "stream-state")
    query = (
        operator(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream did not finish in {timeout} s")
