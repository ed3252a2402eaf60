"""Streams with state by key: plays that are counted once however often they come, and invitations that are answered or expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(plays: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each play (key, ts) once: a repeat that comes within `late` of the newest time is left out, and so is what comes later than
    that. A key is remembered as long as a repeat may be let in."""
    return plays.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def rolled_up(plays: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, user_id, track_id, plays, last) of plays (event_id, ts, user_id, track_id), each counted once; a window comes out when
    nothing that is let in can change it any more."""
    by = F.window("ts", window)
    rows = once(plays, late=late).groupBy(by.alias("w"), "user_id", "track_id").agg(F.count("*").alias("plays"), F.max("ts").alias("last"))
    return rows.select(F.col("w.start").alias("start"), "user_id", "track_id", "plays", "last")


OUTCOME = "invite_id long, status string, participant_id long, accepted_at timestamp"
_STATE = "creator long, ends long, who long, at long, other long, other_at long"


def outcomes(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """How each invitation ends, once it is certain: (invite_id, status accepted or expired, participant_id, accepted_at).

    events: invite_id, kind (created, answered), user_id, ts, expires_at (of created). The first answer by time counts that is
    not the creator's own and not after the end, whatever order events arrive in, as long as they are no later than `late`;
    repeats change nothing. A key's state is its creator, its end and the earliest answers of two different users: of these
    one is not the creator's. It goes with the outcome, or, without a creation, when the answers have become too old.
    """
    us = lambda v: int(pd.Timestamp(v).value // 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (invite,) = key
        creator, ends, who, at, other, other_at = state.get if state.exists else (None,) * 6
        if not state.hasTimedOut:
            for rows in batches:
                for r in rows.itertuples(index=False):
                    if r.kind == "created":
                        creator, ends = int(r.user_id), us(r.expires_at)
                        continue
                    new = (us(r.ts), int(r.user_id))
                    best = {}
                    for t, u in sorted(x for x in ((at, who), (other_at, other), new) if x[0] is not None):
                        best.setdefault(u, t)  # the earliest of each user
                    first = sorted((t, u) for u, t in best.items())[:2]
                    (at, who), (other_at, other) = [*first, (None, None)][:2]
            state.update((creator, ends, who, at, other, other_at))
            now = state.getCurrentWatermarkMs()
            # In milliseconds, one more than the end, so that an answer at the end itself is still let in.
            end = (ends if ends is not None else max(x for x in (at, other_at) if x is not None)) // 1000 + 1
            if end > now:
                state.setTimeoutTimestamp(end)
                return
        fit = [(t, u) for t, u in ((at, who), (other_at, other)) if t is not None and creator is not None and u != creator and t <= ends]
        state.remove()
        if creator is not None:
            t, u = min(fit) if fit else (None, None)
            yield pd.DataFrame({"invite_id": [invite], "status": ["accepted" if fit else "expired"], "participant_id": pd.array([u], "Int64"), "accepted_at": [pd.NaT if t is None else pd.Timestamp(t, unit="us")]})

    rows = events.select("invite_id", "kind", "user_id", "ts", "expires_at").withWatermark("ts", late)
    return rows.groupBy("invite_id").applyInPandasWithState(run, OUTCOME, _STATE, "append", "EventTimeTimeout")
