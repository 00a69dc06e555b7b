"""Paced calls of a service, with a ledger of answers, time limits, kinds of errors and a way to stop.

Requests are asked in batches of a few, each by one task that keeps the service's pace, and each batch's answers are
appended to the ledger, a folder that all executors share, before the next one is asked.  A run that was killed or cancelled
is started again: it asks only what the ledger lacks, so at most one batch is asked twice.  Equal bodies are asked once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stages import cut

LEDGER = "body string, response string, error string, message string, attempt int"
#: Kinds of errors, and which of them a later run asks again.
BUSY, UNREACHABLE, SILENT, OFFLINE, BROKEN = "busy", "unreachable", "silent", "offline", "broken"
AGAIN = (BUSY, UNREACHABLE, SILENT, OFFLINE)
# --- fixed values: what a user is told ---
MESSAGES = {
    BUSY: "Der Kartendienst ist ausgelastet. Bitte später erneut versuchen.", UNREACHABLE: "Der Kartendienst ist nicht erreichbar. Bitte später erneut versuchen.",
    SILENT: "Der Kartendienst antwortet nicht. Bitte erneut versuchen.", OFFLINE: "Keine Verbindung zum Kartendienst. Bitte Internetverbindung prüfen.",
}


class Status(Exception):
    """A client raises this for an answer with a status that is no success."""

    def __init__(self, code: int) -> None:
        super().__init__(f"status {code}")
        self.code = code


def kind_of(error: BaseException) -> tuple[str, str]:
    """The kind of an error and its message."""
    if isinstance(error, Status):
        kind = BUSY if error.code == 429 else UNREACHABLE
    elif isinstance(error, (Late, TimeoutError)):
        kind = SILENT
    elif isinstance(error, (ConnectionError, OSError)):
        kind = OFFLINE
    else:
        return BROKEN, f"{type(error).__name__}: {error}"
    return kind, MESSAGES[kind]


def answers(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows so far; of several for a body the last attempt."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    last = Window.partitionBy("body").orderBy(F.desc("attempt"), F.col("error").isNotNull())
    return spark.read.schema(LEDGER).parquet(ledger).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def ask(requests: DataFrame, call: Callable[[str], str], ledger: str, interval: float = 1.1, timeout: float = 25.0, batch: int = 50, cancelled: Callable[[], bool] = lambda: False, body_col: str = "body") -> bool:
    """Ask all bodies of ``requests`` that the ledger lacks or has only an error for that may pass; whether all were asked.

    ``call`` is the client.  It gets ``timeout`` seconds, after which the request counts as silent.  ``cancelled`` is looked at before each batch: a mark in a
    shared folder, or the time of a deadline.  Errors are answers of a kind; they don't stop the run.
    """
    spark = requests.sparkSession
    known = answers(spark, ledger)
    settled = known.where(F.col("error").isNull() | ~F.col("error").isin(*AGAIN)).select("body")
    due = requests.select(F.col(body_col).alias("body")).where("body IS NOT NULL").distinct().join(settled, "body", "left_anti")
    due = cut(due.join(known.select("body", "attempt"), "body", "left").select("body", (F.coalesce("attempt", F.lit(0)) + 1).cast("int").alias("attempt")))  # the ledger grows meanwhile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for b in batches:
            out = []
            for body, attempt in zip(b["body"], b["attempt"]):
                time.sleep(max(0.0, last + interval - time.monotonic()))
                last = time.monotonic()
                pool = ThreadPoolExecutor(1)
                try:
                    out.append((body, pool.submit(call, body).result(timeout), None, None, attempt))
                except Exception as error:  # an answer of its kind
                    out.append((body, None, *kind_of(error), attempt))
                finally:
                    pool.shutdown(wait=False)
            yield pd.DataFrame(out, columns=["body", "response", "error", "message", "attempt"])

    while not cancelled():
        # asked before in this run: what the ledger has by now with this attempt
        done = answers(spark, ledger).select("body", F.col("attempt").alias("__done"))
        now = due.join(done, "body", "left").where(F.col("__done").isNull() | (F.col("__done") < F.col("attempt"))).select("body", "attempt").orderBy("body").limit(batch).collect()  # one batch
        if not now:
            return True
        part = spark.createDataFrame(now, "body string, attempt int").coalesce(1)
        part.mapInPandas(run, LEDGER).write.mode("append").parquet(ledger)
    return False


def answered(requests: DataFrame, ledger: str, body_col: str = "body") -> DataFrame:
    """``requests`` with ``response``, ``error`` and ``message``; all three null where nothing was asked yet."""
    known = answers(requests.sparkSession, ledger).select(F.col("body").alias(body_col), "response", "error", "message")
    return requests.join(known, body_col, "left")
