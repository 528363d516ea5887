"""The response loop as a stream with keyed state: requests and answers arrive in any order.

Every request id keeps a few numbers in Spark's state store: the hash that was asked for, that of the
first answer and how many answers came. A batch reads its own rows and the state of their ids, so its
work follows the batch and not what came before, and a restart goes on from the checkpoint. Each change
of an id's status is one row of the report; the status now is the row with the highest number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUEST = "id string, source_sha256 string"
ANSWER = "id string, source_sha256 string, translation string"
EVENT = ["id", "asked", "source_sha256"]
CHANGE = "id string, change bigint, status string, answers bigint"
STATE = "asked boolean, asked_sha string, answers bigint, sha string, change bigint, status string"


def answers_from(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(ANSWER).option("maxFilesPerTrigger", files_per_batch).json(path)


def requests_from(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_batch).json(path)


def status_of(asked: bool, asked_sha: str | None, answers: int, sha: str | None) -> str:
    """An answer before its request is early; one without a hash, or with another, is stale."""
    if not asked:
        return "early"
    if not answers:
        return "pending"
    if answers > 1:
        return "repeated"
    return "answered" if sha is not None and sha == asked_sha else "stale"


def changed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The new status of an id, if this batch changes it. What counts doesn't depend on the order inside a batch:
    of several answers at once none is the first."""
    asked, asked_sha, answers, sha, change, status = state.get if state.exists else (False, None, 0, None, 0, None)
    for rows in batches:
        wanted = rows[rows["asked"]]
        if len(wanted) and not asked:
            known = wanted["source_sha256"].dropna()
            asked, asked_sha = True, min(known) if len(known) else None
        given = rows[~rows["asked"]]
        if len(given):
            known = given["source_sha256"].dropna()
            sha = sha if answers else (min(known) if len(known) else None)
            answers += len(given)
    now = status_of(asked, asked_sha, answers, sha)
    if now != status or answers > 1:
        change += 1
        yield pd.DataFrame({"id": [key[0]], "change": [change], "status": [now], "answers": [answers]})
    state.update((asked, asked_sha, answers, sha, change, now))


def changes_of(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """CHANGE: a streaming DataFrame of the changes of status; rows without an id are left out of the loop."""
    events = requests.select("id", F.lit(True).alias("asked"), "source_sha256").unionByName(answers.select("id", F.lit(False).alias("asked"), "source_sha256")).where("id is not null")
    return events.groupBy("id").applyInPandasWithState(changed, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def audit_stream(requests: DataFrame, answers: DataFrame, report: str, checkpoint: str) -> StreamingQuery:
    """Write the changes to `report` as they come; the file sink commits a batch whole or not at all."""
    return changes_of(requests, answers).writeStream.format("parquet").option("path", report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(report: DataFrame) -> DataFrame:
    """id, status, answers: how every id stands after the changes in the report."""
    last = F.max_by(F.struct("status", "answers"), "change").alias("_l")
    return report.groupBy("id").agg(last).select("id", "_l.status", "_l.answers")
