"""Streaming forms of alert suppression and failure windows; each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.outbox import DAY_MICROS


#: Groups of keys that share a call and a row of state; a key of its own would cost a call of Python each.
SLOTS = 1024


def suppress_repeats(events: DataFrame, gap_micros: int = DAY_MICROS, late: str = "2 days", slots: int = SLOTS) -> DataFrame:
    """(user_id, event_type, emitted_micros): one alert of a kind per gap, measured from the last emitted one.

    Keys are dealt to slots by hash. The state of a slot is the time of each key's last alert, and a key goes once the watermark
    has passed its gap. Rows of a micro-batch are taken in order of time. A row that comes in a later micro-batch than a newer
    alert is suppressed with it, where the batch form would have emitted the older one first; rows beyond ``late`` don't count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = {(user, kind): t for user, kind, t in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        rows = [b for b in batches if len(b)]
        if rows:
            kinds, names = pd.factorize(np.concatenate([b["event_type"].to_numpy(dtype=object) for b in rows]), use_na_sentinel=False)
            names = [None if pd.isna(x) else x for x in names]
            users, known, times = (np.concatenate([b[c].to_numpy() for b in rows]) for c in ("user", "known", "micros"))
            order = np.lexsort((times, kinds, users, known))
            kinds, users, known, times = kinds[order], users[order], known[order], times[order]
            cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (users[1:] != users[:-1]) | (known[1:] != known[:-1])) + 1
            for start, own in zip([0, *cuts.tolist()], np.split(times, cuts), strict=True):
                of = (int(users[start]) if known[start] else None, names[kinds[start]])
                before = last.get(of)
                at = 0 if before is None else int(np.searchsorted(own, before + gap_micros, "right"))
                while at < len(own):
                    before = int(own[at])
                    out.append((*of, before))
                    at = max(at + 1, int(np.searchsorted(own, before + gap_micros, "right")))
                last[of] = before
        now = state.getCurrentWatermarkMs()
        live = [(*of, t) for of, t in last.items() if (t + gap_micros) // 1000 >= now]
        if live:
            state.update(tuple(map(list, zip(*live, strict=True))))
            state.setTimeoutTimestamp(max((min(t for *_, t in live) + gap_micros) // 1000, now) + 1)
        elif state.exists:
            state.remove()
        user, kind, emitted = zip(*out, strict=True) if out else ((), (), ())
        yield pd.DataFrame({"user_id": pd.array(user, "Int64"), "event_type": pd.Series(kind, dtype=object), "emitted_micros": pd.array(emitted, "Int64")})

    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).where("at is not null")
    slot = F.pmod(F.xxhash64("user_id", "event_type"), F.lit(slots)).alias("slot")
    # A null user is told from user 0 by ``known``, since a long with nulls comes as a double.
    keyed = timed.select(slot, F.coalesce("user_id", F.lit(0)).cast("long").alias("user"), F.col("user_id").isNotNull().alias("known"), "event_type", "at", F.unix_micros("at").alias("micros"))
    held = "users array<long>, kinds array<string>, lasts array<long>"
    return keyed.groupBy("slot").applyInPandasWithState(step, "user_id long, event_type string, emitted_micros long", held, "append", GroupStateTimeout.EventTimeTimeout)


#: Spark's setting of the state store; the processors below need the one with column families.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FailureWindows(StatefulProcessor):
    """Windows of ``seconds`` from the first failure of a key; its state is the window that is open.

    Rows of a micro-batch are taken in order of time. A timer at the window's end removes the state once the watermark has passed
    it, so a key without failures costs nothing. Each batch emits the windows it has counted in, with the count so far.
    """

    def __init__(self, seconds: int) -> None:
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (Spark's names)
        opened, n = self.window.get() if self.window.exists() else (None, 0)
        before, out = opened, []
        for t in sorted(t for b in rows for t in b["micros"].tolist()):
            if opened is None or t >= opened + self.millis * 1000:
                if n:
                    out.append((opened, n))
                opened, n = t, 0
            n += 1
        if opened is None:
            return
        out.append((opened, n))
        self.window.update((opened, n))
        if before != opened:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(max(self._end(opened), timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "opened_micros": [o for o, _ in out], "n": [n for _, n in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _end(self, opened: int) -> int:
        return -(-opened // 1000) + self.millis


def failure_windows(events: DataFrame, seconds: int = 900, late: str = "1 day") -> DataFrame:
    """(user_id, opened_micros, n): the failures' fixed windows; a window's last row has its final count.

    Start the stream with ``STATE_STORE`` set to ``ROCKS``. A row that comes in a later micro-batch than a newer one counts in
    the window that is open then; rows beyond ``late`` don't count.
    """
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    keyed = timed.select("user_id", "at", F.unix_micros("at").alias("micros"))
    return keyed.groupBy("user_id").transformWithStateInPandas(FailureWindows(seconds), "user_id long, opened_micros long, n long", "Update", "EventTime")
