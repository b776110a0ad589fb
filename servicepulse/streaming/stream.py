"""Structured Streaming entry points.

Every per-row step of the pipeline (standardise, resolution time, target,
classification) is a stateless projection, so the same functions apply
unchanged to a streaming DataFrame.  Tickets arriving as files are enriched
as they land; open tickets are aged to the processing time of each
micro-batch (``as_of=None``) or to a fixed instant.  Counts per category or
status are kept as streaming aggregates (state per key in the state store,
checkpointed with the query).
"""

from __future__ import annotations

from typing import Optional, Sequence, Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators.classify import enrich
from ..operators.resolution import AsOf


def read_ticket_stream(
    spark: SparkSession,
    path: str,
    schema: Union[T.StructType, str],
    fmt: str = "csv",
    max_files_per_trigger: Optional[int] = None,
    **options: str,
) -> DataFrame:
    """Streaming DataFrame over ticket files landing in ``path`` (a schema is
    required for file streams).  CSV files are read with a header row."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def enrich_stream(stream: DataFrame, as_of: AsOf = None, **std_options) -> DataFrame:
    """Standardised and classified tickets, row by row, on a stream."""
    return enrich(stream, as_of=as_of, **std_options)


def running_counts(enriched: DataFrame, keys: Sequence[str] = (K.CATEGORY_COL,)) -> DataFrame:
    """Running row count per key combination (use output mode
    ``complete`` or ``update``)."""
    return enriched.groupBy(*keys).count()


def start(
    df: DataFrame,
    sink_path: Optional[str] = None,
    *,
    fmt: str = "parquet",
    output_mode: str = "append",
    checkpoint: Optional[str] = None,
    available_now: bool = False,
    query_name: Optional[str] = None,
) -> StreamingQuery:
    """Start a streaming query writing to ``sink_path`` (or the in-process
    ``memory`` sink when ``fmt='memory'``).  The query checkpoint lives in the
    sink's own ``_checkpoint`` folder unless given, so a query started again on
    the same sink goes on where it ended; a sink without a path must name one."""
    if not checkpoint and not sink_path and fmt != "memory":
        raise ValueError("a sink without a path needs a checkpoint folder")
    w = df.writeStream.format(fmt).outputMode(output_mode)
    if checkpoint or sink_path:
        w = w.option("checkpointLocation", checkpoint or f"{sink_path.rstrip('/')}/_checkpoint")
    if query_name:
        w = w.queryName(query_name)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start(sink_path) if sink_path else w.start()
