"""Iterations of streams logged by their metrics (S10, T13): nothing is read twice and no report is lost."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

LOG = "query_id string, run_id string, batch_id long, at string, rows long, late long, duration_ms long, metrics map<string, double>, outcome string"


class IterationLog(StreamingQueryListener):
    """A listener that writes one entry for each batch of the streams it watches.

    ``watch`` adds ``DataFrame.observe`` to a stream: its rows and any further aggregates
    are counted while the sink reads them, in the same job. Each progress report
    with these metrics becomes an entry of the table at ``path``: rows, rows that came
    after the watermark (all state operators), duration, metrics, outcome. Entries are
    keyed by query and batch, so a batch that is run again replaces its own, restarts of
    a query go on with its log, and the number of reports that Spark keeps doesn't matter.
    A query that ends with an error gets an entry for the batch it died in.

    Rows are counted once for each time the sink reads a batch: a ``foreachBatch`` that
    reads twice should persist its batch. Reports come on Spark's listener thread;
    ``finish`` waits for those of a query that has ended.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path, self._name = spark, path, f"iterations-{uuid.uuid4().hex}"
        self._ended: dict[str, threading.Event] = {}
        self._next: dict[str, int] = {}
        self._errors: list[Exception] = []

    def __enter__(self) -> IterationLog:
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, *error: object) -> None:
        self._spark.streams.removeListener(self)

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """The stream with its metrics: rows and the given aggregates (numbers)."""
        return df.observe(self._name, F.count(F.lit(1)).alias("rows"), *[m.cast("double").alias(name) for name, m in metrics.items()])

    def finish(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Waits until all entries of an ended query are written; raises if one couldn't be."""
        if not self._ended.setdefault(str(query.runId), threading.Event()).wait(seconds):
            raise TimeoutError(f"no report of the end of {query.runId}")
        if self._errors:
            raise self._errors[0]

    def onQueryStarted(self, event) -> None:
        self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        observed = p.observedMetrics.get(self._name)
        if observed is None:
            return
        seen = observed.asDict()
        rows = int(seen.pop("rows"))
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        self._next[str(p.runId)] = p.batchId + 1
        self._write(p.id, p.runId, p.batchId, p.timestamp, rows, late, p.durationMs.get("triggerExecution", 0), {k: v for k, v in seen.items() if v is not None}, "done")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        if event.exception and run in self._next:
            self._write(event.id, run, self._next[run], None, None, 0, None, {}, f"failed: {event.errorClassOnException or 'error'}")
        self._ended.setdefault(run, threading.Event()).set()

    def _write(self, query, run, batch: int, *entry) -> None:
        try:
            row = self._spark.createDataFrame([(str(query), str(run), batch, *entry)], LOG).coalesce(1)
            row.write.mode("overwrite").parquet(f"{self._path}/query={query}/batch={batch}")
        except Exception as e:  # Spark drops what a listener raises; finish tells of it
            self._errors.append(e)


def iterations(spark: SparkSession, path: str) -> DataFrame:
    """The log: one row for each query and batch."""
    return spark.read.schema(LOG).parquet(f"{path}/*/*")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came after the watermark, and all rows, of each query over all its batches and restarts."""
    return iterations(spark, path).groupBy("query_id").agg(F.sum("late").alias("late"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("batches"))

