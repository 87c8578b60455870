"""Audit log of table loads: appended, never rewritten."""

from __future__ import annotations

import datetime as dt
import posixpath
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

LOG_SCHEMA = (
    "batch_id string, layer_name string, table_name string, procedure_name string, batch_start_time timestamp, "
    "batch_end_time timestamp, load_start_time timestamp, load_end_time timestamp, load_duration_sec int, "
    "source_row_count bigint, rows_inserted bigint, target_row_count bigint, status string, error_message string, "
    "error_class string, sql_state string, created_at timestamp"
)
BATCH = "BATCH"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _told(error: BaseException, what: str) -> str | None:
    """What a Spark error says of itself; other errors have neither class nor state."""
    return getattr(error, what)() if isinstance(error, PySparkException) else None


class LoadBatch:
    """One run of one layer.

    ``with LoadBatch(...) as batch: batch.load("table", job)`` appends a row per table,
    a closing row at the end, and a FAILED row before an error travels on.
    """

    def __init__(self, spark: SparkSession, base: str, layer: str, procedure: str):
        self.spark, self.path = spark, posixpath.join(base, "etl_log")
        self.layer, self.procedure = layer, procedure
        self.batch_id, self.started, self.table = str(uuid.uuid4()), _now(), None

    def _append(self, **values) -> None:
        row = {"batch_id": self.batch_id, "layer_name": self.layer, "procedure_name": self.procedure,
               "batch_start_time": self.started, "created_at": _now(), **values}
        names = [part.split()[0] for part in LOG_SCHEMA.split(", ")]
        frame = self.spark.createDataFrame([tuple(row.get(n) for n in names)], LOG_SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(self.path)

    def load(self, table: str, job: Callable[[], int], source_rows: int | None = None) -> int:
        """Run ``job`` (which writes the table and returns the rows written) and log it."""
        self.table, begun = table, _now()
        rows = job()
        ended = _now()
        self._append(table_name=table, load_start_time=begun, load_end_time=ended, source_row_count=source_rows,
                     load_duration_sec=int((ended - begun).total_seconds()), rows_inserted=rows, target_row_count=rows,
                     status="SUCCESS")
        return rows

    def __enter__(self) -> "LoadBatch":
        return self

    def __exit__(self, kind, error, trace) -> bool:
        ended = _now()
        if error is not None:
            self._append(table_name=self.table, status="FAILED", error_message=str(error), error_class=_told(error, "getCondition"),
                         sql_state=_told(error, "getSqlState"))
        self._append(table_name=BATCH, batch_end_time=ended, status="FAILED" if error else "SUCCESS")
        return False


def read_log(spark: SparkSession, base: str) -> DataFrame:
    """The log with the end and duration of its batch on every row."""
    log = spark.read.schema(LOG_SCHEMA).parquet(posixpath.join(base, "etl_log"))
    ended = F.max("batch_end_time").over(Window.partitionBy("batch_id"))
    return (
        log.withColumn("batch_end_time", ended)
        .withColumn("batch_duration_sec", (F.unix_timestamp("batch_end_time") - F.unix_timestamp("batch_start_time")).cast("int"))
        .filter(F.col("table_name").isNull() | (F.col("table_name") != BATCH))
    )


def reconcile(log: DataFrame) -> DataFrame:
    """Loads whose source, inserted and target counts disagree (a missing source count passes)."""
    same = (F.coalesce("source_row_count", "rows_inserted") == F.col("rows_inserted")) & (
        F.col("rows_inserted") == F.col("target_row_count")
    )
    return log.filter(F.col("status") == "SUCCESS").select(
        "batch_id", "layer_name", "table_name", "source_row_count", "rows_inserted", "target_row_count", same.alias("agrees")
    )
