"""Streams against the same rows as one batch: late, repeated and restarted input."""

import datetime
import random

from pyspark.sql import functions as F

from cadenza.operators import serving
from cadenza.streaming import state

DAY = datetime.datetime(2024, 1, 1)
PLAYS = "event_id long, ts timestamp, user_id long, track_id long"
EVENTS = "invite_id long, kind string, user_id long, ts timestamp, expires_at timestamp"


def feed(spark, path, batches, schema):
    """Each batch a file, in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{k:03d}")
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def run(df, path):
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out").collect()


def test_plays_once(spark, tmp_path):
    rng = random.Random(3)
    plays = [(k, DAY + datetime.timedelta(hours=k), k % 3, k % 4) for k in range(96)]
    mixed = sorted(plays, key=lambda p: p[0] + rng.randrange(20))  # up to 20 hours late
    batches = [mixed[k : k + 24] + mixed[max(0, k - 6) : k] for k in range(0, 96, 24)]  # with repeats
    batches.append([(900, DAY, 0, 0)])  # days too late
    batches.append([(901, DAY + datetime.timedelta(days=30), 0, 0)])  # moves time on
    batches.append([(902, DAY + datetime.timedelta(days=31), 0, 0)])
    source = feed(spark, tmp_path, batches[:3], PLAYS)
    run(state.rolled_up(source()), tmp_path)
    for k, rows in enumerate(batches[3:], 3):  # the stream starts again where it ended
        spark.createDataFrame(rows, PLAYS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    got = {(r.start, r.user_id, r.track_id): (r.plays, r["last"]) for r in run(state.rolled_up(source()), tmp_path) if r.start < DAY + datetime.timedelta(days=4)}
    want = {}
    for _, ts, u, t in plays:
        key = (ts.replace(hour=0), u, t)
        n, last = want.get(key, (0, ts))
        want[key] = (n + 1, max(last, ts))
    assert got == want


def test_invitations_end_as_in_one_batch(spark, tmp_path):
    rng = random.Random(5)
    at = lambda h: DAY + datetime.timedelta(hours=h)
    events, invites = [], []
    for k in range(40):
        start = rng.randrange(20)
        end = start + rng.randrange(1, 12)
        invites.append((k, k, at(start), at(end)))
        events.append((k, "created", k, at(start), at(end)))
        for _ in range(rng.randrange(4)):
            events.append((k, "answered", rng.choice([k, 100, 101, 102]), at(start + rng.randrange(0, 14)), None))
    events.append((500, "answered", 7, at(5), None))  # never created
    events.sort(key=lambda e: (e[3] - DAY).total_seconds() / 3600 + rng.random() * 5)  # up to five hours late
    batches = [events[k : k + 25] + events[max(0, k - 5) : k] for k in range(0, len(events), 25)]
    batches += [[(9000 + d, "created", 1, DAY + datetime.timedelta(days=10 + d), DAY + datetime.timedelta(days=90))] for d in range(3)]  # moves time on
    source = feed(spark, tmp_path, batches[:2], EVENTS)
    run(state.outcomes(source(), "6 hours"), tmp_path)
    for k, rows in enumerate(batches[2:], 2):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    got = sorted((r.invite_id, r.status, r.participant_id, r.accepted_at) for r in run(state.outcomes(source(), "6 hours"), tmp_path))
    table = spark.createDataFrame([(i, c, "pending", e, None, None) for i, c, _, e in invites], "invite_id long, creator_id long, status string, expires_at timestamp, participant_id long, accepted_at timestamp")
    answers = spark.createDataFrame([(e[0], e[2], e[3]) for e in events if e[1] == "answered"], "invite_id long, user_id long, answered_at timestamp")
    ended = serving.accepted(table, answers)[0].withColumn("status", serving.invitation_status(F.lit(at(10_000))))
    want = sorted((r.invite_id, r.status, r.participant_id, r.accepted_at) for r in ended.collect())
    assert got == want and {x[1] for x in want} == {"accepted", "expired"}
