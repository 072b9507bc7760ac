"""Append-only commits of an unbounded recording: everything older than a guard is cut, put out once
and never changed.

A session's turns arrive in order of time. After each batch the horizon is the newest time heard minus the guard;
turns are clipped to [committed, horizon) and put out, what lies beyond stays in state. A row with
flush set commits the tail, always. Rows that end at or before the committed time are late: they are
counted and dropped; straddlers are clipped. The horizon is per session and kept in state, for a
watermark is one for a whole query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.scan import Rows, ordered_scan

SECOND = 1_000_000
# Defaults in microseconds.
WINDOW, HOP, GUARD = 16 * SECOND, 4 * SECOND, 3 * SECOND

TURN = "rec string, speaker string, start_us long, end_us long"
OUT = "rec string, speaker string, start_us long, end_us long, committed_us long, late long"


class Session:
    """State of one recording: pending turns, what is committed, the newest time heard, late rows."""

    def __init__(self, pending=(), committed: int = 0, heard: int = 0, late: int = 0):
        self.pending = list(pending)
        self.committed, self.heard, self.late = committed, heard, late

    def feed(self, speaker: str, start: int, end: int) -> None:
        if end <= self.committed:
            self.late += 1
            return
        self.heard = max(self.heard, end)
        self.pending.append((speaker, max(start, self.committed), end))

    def ready(self, hop: int = HOP, guard: int = GUARD) -> bool:
        return self.heard - guard - self.committed >= hop

    def commit(self, horizon: int) -> list[tuple[str, int, int]]:
        """Turns clipped to [committed, horizon), in order; the rest stays pending."""
        if horizon <= self.committed:
            return []
        out = sorted((s, max(a, self.committed), min(b, horizon)) for s, a, b in self.pending if a < horizon)
        self.pending = [(s, max(a, horizon), b) for s, a, b in self.pending if b > horizon]
        self.committed = horizon
        return sorted(out, key=lambda t: (t[1], t[2], t[0]))


def commit_stream(turns: DataFrame, hop_us: int = HOP, guard_us: int = GUARD) -> DataFrame:
    """A streaming DataFrame of (rec, speaker, start_us, end_us, flush) to committed turns, in append
    mode. speaker is null in a row that only carries a flush or the time heard."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            speakers, starts, ends, committed, heard, late = state.get
            s = Session(zip(speakers, starts, ends, strict=True), committed, heard, late)
        else:
            s = Session()
        flush = False
        rows = pd.concat(list(frames)).sort_values(["start_us", "end_us", "speaker"], na_position="last")
        for r in rows.itertuples():
            flush |= bool(r.flush)
            if isinstance(r.speaker, str):
                s.feed(r.speaker, int(r.start_us), int(r.end_us))
            elif not pd.isna(r.end_us):
                s.heard = max(s.heard, int(r.end_us))
        out = s.commit(s.heard if flush else s.heard - guard_us) if flush or s.ready(hop_us, guard_us) else []
        state.update(([p[0] for p in s.pending], [p[1] for p in s.pending], [p[2] for p in s.pending], s.committed, s.heard, s.late))
        if out:
            yield pd.DataFrame({"rec": key[0], "speaker": [t[0] for t in out], "start_us": [t[1] for t in out], "end_us": [t[2] for t in out], "committed_us": s.committed, "late": s.late})

    state = "speakers array<string>, starts array<long>, ends array<long>, committed long, heard long, late long"
    return turns.groupBy("rec").applyInPandasWithState(step, OUT, state, "append", GroupStateTimeout.NoTimeout)


def commit_batch(turns: DataFrame, hop_us: int = HOP, guard_us: int = GUARD) -> DataFrame:
    """What the commits of a session put out when its turns are fed in order of start, each start telling the
    time, and flushed at the end: rec, speaker, start_us, end_us, a turn cut wherever a horizon passed it. State never
    holds more than the turns that reach past the guard."""

    def scan(rows: Rows) -> Iterator[tuple]:
        s, rec = Session(), None
        for r in rows:
            rec = r["rec"]
            # all turns that begin before this one are in: the horizon may follow its start
            if r["start_us"] - guard_us - s.committed >= hop_us:
                yield from ((rec, *piece) for piece in s.commit(r["start_us"] - guard_us))
            s.feed(r["speaker"], r["start_us"], r["end_us"])
        yield from ((rec, *piece) for piece in s.commit(s.heard))

    return ordered_scan(turns.select("rec", "speaker", "start_us", "end_us"), ["rec"], ["start_us", "end_us", "speaker"], scan, TURN)


def status(committed: DataFrame, heard: DataFrame) -> DataFrame:
    """rec, heard_us, committed_us, lag_us."""
    c = committed.groupBy("rec").agg(F.max("end_us").alias("committed_us"))
    h = heard.groupBy("rec").agg(F.max("end_us").alias("heard_us"))
    return h.join(c, "rec", "left").select("rec", "heard_us", F.coalesce("committed_us", F.lit(0)).alias("committed_us"), (F.col("heard_us") - F.coalesce("committed_us", F.lit(0))).alias("lag_us"))
