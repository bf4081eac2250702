"""The states of jobs kept over a stream of their events, with timers for what has to happen without an event."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loregraph.operators.jobs import MAX_ATTEMPTS

#: Events of a job, in the order of their times: created, started, progress (pages), done, failed (error).
EVENTS = "job_id string, kind string, at timestamp, pages int, error string"
STATE = "status string, attempts int, pages_processed int, error_message string, updated_ms long, due_ms long"
OUT = "job_id string, status string, attempts int, pages_processed int, error_message string, updated_at timestamp, next_retry_at timestamp"

#: State is kept by RocksDB, which timers and states of this kind need.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _ms(t: datetime) -> int:
    return round(t.timestamp() * 1000)


def _time(ms: int | None) -> datetime | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class JobStates(StatefulProcessor):
    """One state per job; a row goes out whenever it changes.

    A job that runs for more than ``timeout_s`` seconds of event time fails. With ``retries``, a failed one waits for
    2 ** attempts minutes, is due then and may start again, until it has started ``max_attempts`` times; without, it stays failed. Events that
    a job is in no state for change nothing: only a pending or due job starts, and only a running one goes on or ends.
    A job that ended starts anew when it is created again.
    """

    def __init__(self, timeout_s: int = 600, retries: bool = False, max_attempts: int = MAX_ATTEMPTS):
        self.timeout_s, self.retries, self.max_attempts = timeout_s, retries, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _timer(self, old: int | None, new: int | None) -> None:
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)

    def _failed(self, s: dict, error: str, at: int) -> None:
        again = self.retries and s["attempts"] < self.max_attempts
        s |= {"status": "pending" if again else "failed", "error_message": (error or "")[:500], "due_ms": at + 60_000 * 2 ** s["attempts"] if again else None}

    def _after(self, s: dict | None, e: Row) -> bool:
        """Whether ``e`` changed the state ``s``, in place."""
        at, kind = _ms(e["at"]), e["kind"]
        if kind == "created" and s["status"] in (None, "done", "failed"):
            s |= {"status": "pending", "attempts": 0, "pages_processed": 0, "error_message": None, "due_ms": None}
        elif kind == "started" and (s["status"] == "due" or s["status"] == "pending" and (s["due_ms"] is None or s["due_ms"] <= at)):
            # later than the timeout, by a millisecond at least
            s |= {"status": "processing", "attempts": s["attempts"] + 1, "due_ms": at + 1000 * self.timeout_s + 1}
        elif kind == "progress" and s["status"] == "processing":
            s |= {"pages_processed": e["pages"] or 0}
        elif kind == "done" and s["status"] == "processing":
            s |= {"status": "done", "error_message": None, "due_ms": None}
        elif kind == "failed" and s["status"] == "processing":
            self._failed(s, e["error"], at)
        else:
            return False
        s["updated_ms"] = at
        return True

    def _late(self, s: dict, at: int) -> bool:
        """What a timer would have done by the time ``at``, whose event came before it fired."""
        if s["due_ms"] is None or s["due_ms"] > at:
            return False
        if s["status"] == "processing":
            s["updated_ms"], fired = s["due_ms"], s["due_ms"]
            self._failed(s, f"Timed out after {self.timeout_s}s", fired)
        elif s["status"] == "pending":
            s |= {"status": "due", "updated_ms": s["due_ms"], "due_ms": None}
        return True

    def _row(self, key: tuple, s: dict) -> Row:
        waits = s["due_ms"] if s["status"] == "pending" else None
        return Row(job_id=key[0], status=s["status"], attempts=s["attempts"], pages_processed=s["pages_processed"], error_message=s["error_message"], updated_at=_time(s["updated_ms"]), next_retry_at=_time(waits))

    def _load(self) -> dict:
        names = [x.split()[0] for x in STATE.split(", ")]
        held = self.state.get() if self.state.exists() else None
        return dict(zip(names, held, strict=True)) if held is not None else dict.fromkeys(names)

    def _store(self, s: dict) -> None:
        self.state.update(tuple(s.values()))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        s = self._load()
        before = s["due_ms"]
        for e in sorted((r for r in rows if r["at"] is not None and r["kind"] is not None), key=lambda r: (r["at"], r["kind"])):
            while s["status"] and self._late(s, _ms(e["at"])):
                yield self._row(key, s)
            if self._after(s, e):
                yield self._row(key, s)
        if s["status"]:
            self._timer(before, s["due_ms"])
            self._store(s)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        s = self._load()
        if s["due_ms"] != expiredTimerInfo.getExpiryTimeInMs():
            return
        while self._late(s, timerValues.getCurrentWatermarkInMs()):
            yield self._row(key, s)
        self._timer(None, s["due_ms"])
        self._store(s)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, timeout_s: int = 600, retries: bool = False, lateness: str = "0 seconds", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The changes of each job's state, from a stream of EVENTS; set CONF in its session."""
    timed = events.withWatermark("at", lateness)
    return timed.groupBy("job_id").transformWithState(JobStates(timeout_s, retries, max_attempts), OUT, "Update", "EventTime")
