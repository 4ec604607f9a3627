"""Profile refreshes as a stream of records, with an outcome for each record and a count of its attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import models
from ..schemas import PROFILE, RECORD
from ..session import settled
from .runs import Runs

OUTCOME = f"repo_id string, prompt_digest string, attempts int, error string, llm_profile struct<{PROFILE.replace(' ', ': ').replace(',:', ',')}>"


def outcomes(spark: SparkSession, folder: str) -> Runs:
    """What became of each id: the last prompt's digest, attempts and error, and the last profile that was made."""
    return Runs(spark, folder, OUTCOME, "repo_id")


def refresh_batch(store: Runs, records: DataFrame, chat: Callable[[list[str]], list[str]], model: str, now: Column, reason: Column, system: str = "", most_attempts: int = 3) -> None:
    """Asks for the profiles of the records that are due, and adds an outcome for each; records that come again ask nothing.

    A record is asked about again only if its evidence has changed since it got a
    profile, or if it failed fewer than most_attempts times. A call that fails is made
    for its halves, so that an error is one record's.
    """
    last = records.where("repo_id is not null").groupBy("repo_id").agg(F.max_by(F.struct(*(c for c in records.columns if c != "repo_id")), "pos").alias("r")).select("repo_id", "r.*")
    digest = F.sha2(F.concat_ws("\n", F.lit(text.prompt_hash(models.PROFILE_PROMPT, system)), models.profile_input()), 256)
    due = last.where(reason.isNotNull()).withColumn("prompt_digest", digest)
    was = store.lookup(due.select("repo_id")).select("repo_id", F.struct("prompt_digest", "attempts", "error", "llm_profile").alias("was"))
    rows = due.join(was, "repo_id", "left")
    same = F.coalesce(F.col("was.prompt_digest") == F.col("prompt_digest"), F.lit(False))
    rows = rows.withColumn("tried", F.when(same, F.col("was.attempts")).otherwise(0)).where(~same | (F.col("was.error").isNotNull() & (F.col("tried") < most_attempts)))
    rows = rows.withColumn("had", F.col("was.llm_profile")).drop("was")
    got = settled(models.refreshed(rows, chat, model, now, F.lit("due"), system).select("repo_id", "prompt_digest", "tried", "had", "new_profile", "refresh_error"), "refresh")
    profile = F.coalesce(_profile(F.col("new_profile")), F.col("had")).alias("llm_profile")
    store.append(store.next_batch(), got.select("repo_id", "prompt_digest", (F.col("tried") + 1).cast("int").alias("attempts"), F.col("refresh_error").alias("error"), profile))


def _profile(made: Column) -> Column:
    """A made profile with the record's fields in their order."""
    names = [f.split(" ")[0] for f in PROFILE.split(", ")]
    return F.when(made.isNotNull(), F.struct(*(made[n].alias(n) for n in names)))


def refresh_incrementally(spark: SparkSession, records_dir: str, folder: str, checkpoint_dir: str, chat: Callable[[list[str]], list[str]], model: str, now: Column, reason: Column, system: str = "", most_attempts: int = 3):
    """Refreshes what is new in records_dir (JSON lines); returns the finished query. retried() asks again about what failed."""
    incoming = spark.readStream.schema(f"pos BIGINT, {RECORD}").json(records_dir)

    def take(batch: DataFrame, number: int) -> None:
        refresh_batch(outcomes(batch.sparkSession, folder), batch, chat, model, now, reason, system, most_attempts)

    query = incoming.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def retried(store: Runs, records: DataFrame, chat: Callable[[list[str]], list[str]], model: str, now: Column, system: str = "", most_attempts: int = 3) -> None:
    """Asks again about the records whose last outcome is an error, once each, unless they had most_attempts."""
    failed = store.current().where(F.col("error").isNotNull() & (F.col("attempts") < most_attempts)).select("repo_id")
    refresh_batch(store, records.join(failed, "repo_id", "left_semi"), chat, model, now, F.lit("retry_failed"), system, most_attempts)


def applied(records: DataFrame, store: Runs) -> DataFrame:
    """The records with the profiles of the store, and `refresh_error` where the last attempt failed."""
    made = store.current().select("repo_id", F.col("llm_profile").alias("made"), F.col("error").alias("refresh_error"))
    rows = records.join(made, "repo_id", "left")
    return rows.withColumn("llm_profile", F.coalesce("made", "llm_profile")).drop("made").select(*records.columns, "refresh_error")
