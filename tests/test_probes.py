"""Attacks on each format end as they must, and claims go to the oldest free jobs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorespan.operators import lifecycle as L
from lorespan.sources import probes


def test_probes(spark):
    got = probes.security_probes(spark).collect()
    assert len(got) == 8 and all(r.passed for r in got), [tuple(r) for r in got if not r.passed]
    assert probes.binary_content(b"a\0") and not probes.binary_content("a".encode("utf-16"))


def test_claims(spark):
    at = datetime(2024, 1, 1, 12)
    jobs = [(1, "PENDING", 5, 0, None, None), (2, "RUNNING", 1, 1, "old", -1), (3, "RUNNING", 0, 1, "busy", 1), (4, "RUNNING", 2, 3, "dead", -1), (5, "PENDING", 5, 3, None, None), (6, "DONE", 0, 1, "x", -1), (7, "PENDING", 9, 0, None, None)]
    rows = [(i, s, at + timedelta(minutes=c), a, o, None if u is None else at + timedelta(minutes=u)) for i, s, c, a, o, u in jobs]
    df = spark.createDataFrame(rows, "job_id int, status string, created timestamp_ntz, attempt int, lease_owner string, lease_until timestamp_ntz")
    workers = spark.createDataFrame([("w2",), ("w1",), ("w1",)], "worker string")
    now, lease = F.lit(at).cast("timestamp_ntz"), F.expr("INTERVAL 5 MINUTES")
    got = {r.job_id: (r.status, r.attempt, r.lease_owner, r.lease_until and (r.lease_until - at).seconds // 60) for r in L.claim_jobs(df, workers, now, lease).collect()}
    assert got[2] == ("RUNNING", 2, "w1", 5) and got[1] == ("RUNNING", 1, "w2", 5)
    assert got[4][:3] == ("FAILED", 3, "dead") and got[3][:3] == ("RUNNING", 1, "busy") and got[5][0] == got[7][0] == "PENDING" and got[6][0] == "DONE"
    assert {r.status for r in L.claim_jobs(df, workers.limit(0), now, lease).collect()} == {"PENDING", "RUNNING", "FAILED", "DONE"}
