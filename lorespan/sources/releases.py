"""Publishing and rolling back index generations over a log whose entries are claimed one at a time.

The log is a folder of numbered entries. An entry is written aside and put in its place only if no entry of that number
is there, so of several writers who have seen the same log one goes on and the others are refused. Statuses are never
stored: they are what the newest entry about a generation says.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Statuses that may follow one another, what a move starts from, and reasons of refusals.
TRANSITIONS = {None: ("BUILDING",), "BUILDING": ("READY", "FAILED"), "READY": ("ACTIVE", "FAILED"), "ACTIVE": ("RETIRED",), "RETIRED": ("ACTIVE", "DELETED"), "FAILED": ("DELETED",), "DELETED": ()}
STARTS_FROM = {"PUBLISH": "READY", "ROLLBACK": "RETIRED"}
NOT_RELEASABLE, NOT_CAUGHT_UP, NOT_CLOSED, CHANGED = "INDEX_GENERATION_NOT_RELEASABLE", "INDEX_GENERATION_NOT_CAUGHT_UP", "INDEX_CLOSURE_BLOCKED", "INDEX_GENERATION_CHANGED"
RETENTION = timedelta(days=7)
_ENTRY = "number long, action string, generation long, previous long, profile string, previous_profile string, actor string, reason string, at string, changes array<struct<generation:long,status:string,retention_until:string>>"


class Refused(RuntimeError):
    """A move that the log doesn't allow; its text is the reason."""


def _entries(spark: SparkSession, log: str) -> list[tuple[int, str]]:
    place = spark._jvm.org.apache.hadoop.fs.Path(log)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [f.getPath() for f in files.listStatus(place)]
    return sorted((int(p.getName()[:-5]), p.toString()) for p in names if p.getName().endswith(".json") and p.getName()[:-5].isdigit())


def _claim(spark: SparkSession, log: str, number: int, entry: dict) -> bool:
    """Put an entry in its place if the place is free; whether it was."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside, target = hadoop.Path(f"{log}/_{uuid.uuid4().hex}"), hadoop.Path(f"{log}/{number}.json")
    files = aside.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        if files.getScheme() == "file":  # its rename would look first and move then; a link is one step
            os.link(aside.toUri().getPath(), target.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
            none[0] = hadoop.Options.Rename.NONE
            hadoop.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, none)
        return True
    except FileExistsError:
        return False
    except Exception as failed:
        if files.exists(target):
            return False
        raise failed
    finally:
        files.delete(aside, False)


def release_log(spark: SparkSession, log: str) -> DataFrame:
    """Entries of a log: number, action, generation, previous, profile, previous_profile, actor, reason, at, changes."""
    paths = [p for _, p in _entries(spark, log)]
    return spark.read.schema(_ENTRY).json(paths) if paths else spark.createDataFrame([], _ENTRY)


def generations(spark: SparkSession, log: str) -> DataFrame:
    """(generation, status, retention_until, number): what the newest entry about each generation says."""
    changes = release_log(spark, log).select("number", F.posexplode("changes").alias("place", "c")).select("number", "place", "c.*")
    newest = Window.partitionBy("generation").orderBy(F.col("number").desc(), F.col("place").desc())
    return changes.withColumn("n", F.row_number().over(newest)).filter("n = 1").select("generation", "status", "retention_until", "number")


def publication_events(spark: SparkSession, log: str) -> DataFrame:
    """(number, action, previous_profile, profile, previous_generation, generation, actor, reason, at) of releases, oldest first."""
    releases = release_log(spark, log).filter(F.col("action").isin(*STARTS_FROM))
    return releases.select("number", "action", "previous_profile", "profile", F.col("previous").alias("previous_generation"), "generation", "actor", "reason", "at").orderBy("number")


def _state(spark: SparkSession, log: str) -> tuple[int, dict[int, str], str | None]:
    """Number of the next entry, status by generation, and profile in force; one row a generation."""
    number = max((n for n, _ in _entries(spark, log)), default=-1)
    rows = generations(spark, log).filter(F.col("number") <= number).collect()
    last = publication_events(spark, log).filter(F.col("number") <= number).agg(F.max_by("profile", "number")).first()[0]
    return number + 1, {r["generation"]: r["status"] for r in rows}, last


def transition(spark: SparkSession, log: str, generation: int, status: str, actor: str = "", reason: str = "") -> int:
    """Move one generation to BUILDING, READY, FAILED or DELETED; the entry's number. Releases are ``release``'s."""
    number, now, _ = _state(spark, log)
    if status not in TRANSITIONS.get(now.get(generation), ()) or status in ("ACTIVE", "RETIRED"):
        raise Refused(NOT_RELEASABLE)
    entry = {"number": number, "action": status, "generation": generation, "actor": actor, "reason": reason, "at": datetime.now(UTC).isoformat(), "changes": [{"generation": generation, "status": status}]}
    if not _claim(spark, log, number, entry):
        raise Refused(CHANGED)
    return number


def release(spark: SparkSession, log: str, action: str, generation: int, profile: str, actor: str, reason: str, completeness: DataFrame, closure: DataFrame, retention: timedelta = RETENTION) -> int:
    """PUBLISH a READY generation or ROLLBACK to a RETIRED one; the number of the entry.

    ``completeness`` is the one row of ``lifecycle.generation_complete`` and ``closure`` that of ``lifecycle.closure_status``, both of
    the generation; they are computed after the log was read and before its next entry is claimed. One entry makes the
    generation ACTIVE and the one in force RETIRED with its time to live, so there is never none or two. Refused are
    another status, an incomplete or unclosed index, and a log that has gone on meanwhile.
    """
    number, now, profile_before = _state(spark, log)
    if now.get(generation) != STARTS_FROM[action]:
        raise Refused(NOT_RELEASABLE)
    if not completeness.first()["ready"]:
        raise Refused(NOT_CAUGHT_UP)
    if not (row := closure.first())["closed"]:
        raise Refused(f"{NOT_CLOSED}: {row['blockers']}")
    at = datetime.now(UTC)
    before = next((g for g, s in now.items() if s == "ACTIVE"), None)
    changes = [{"generation": generation, "status": "ACTIVE"}]
    if before is not None:
        changes.append({"generation": before, "status": "RETIRED", "retention_until": (at + retention).isoformat()})
    entry = {"number": number, "action": action, "generation": generation, "previous": before, "profile": profile, "previous_profile": profile_before, "actor": actor, "reason": reason, "at": at.isoformat(), "changes": changes}
    if not _claim(spark, log, number, entry):
        raise Refused(CHANGED)
    return number


def released(spark: SparkSession, index_path: str, log: str) -> DataFrame:
    """The generation in force; its partition alone is read."""
    active = generations(spark, log).filter("status = 'ACTIVE'").first()
    if active is None:
        raise Refused(NOT_RELEASABLE)
    return spark.read.parquet(index_path).filter(F.col("index_generation") == active["generation"]).drop("index_generation")
