"""Notifications of protected results, grouped by session in keyed state with processing-time timers.

Summaries of a session gather until none has come for ``DEBOUNCE`` seconds or ``MAX_WAIT`` have passed since the first;
after a delivery the session stays silent for ``COOLDOWN``. What is older than ``TTL`` is dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Times in seconds and limits.
DEBOUNCE, MAX_WAIT, COOLDOWN, TTL = 2, 10, 30, 120
MOST_SESSIONS, MOST_DOCUMENTS, MOST_COUNT = 128, 3, 999_999
OUTPUT = "session string, events int, pseudonymized map<string,int>, redacted map<string,int>, documents array<string>"


class Batch:
    """One session's pending summaries and its last delivery."""

    def __init__(self, first: float | None = None, last: float | None = None, sent: float | None = None, events: int = 0, pseudonymized: dict | None = None, redacted: dict | None = None, documents: list | None = None) -> None:
        self.first, self.last, self.sent, self.events = first, last, sent, events
        self.pseudonymized, self.redacted, self.documents = pseudonymized or {}, redacted or {}, documents or []

    def expire(self, now: float) -> None:
        """Drops what is too old, or lies ahead of a clock that was set back."""
        if self.last is not None and not now - TTL <= self.last <= now:
            self.first = self.last = None
            self.events, self.pseudonymized, self.redacted, self.documents = 0, {}, {}, []
        if self.sent is not None and not now - TTL <= self.sent <= now:
            self.sent = None

    def add(self, summary: dict, now: float) -> None:
        self.expire(now)
        self.first, self.last = now if self.first is None else self.first, now
        self.events = min(self.events + 1, MOST_COUNT)
        for held, new in ((self.pseudonymized, summary.get("pseudonymized")), (self.redacted, summary.get("redacted"))):
            for kind, n in (new or {}).items():
                held[kind] = min(held.get(kind, 0) + n, MOST_COUNT)
        document = summary.get("document")
        if document and document not in self.documents and len(self.documents) < MOST_DOCUMENTS:
            self.documents.append(document)

    def due(self) -> float | None:
        """When it may be delivered."""
        if self.first is None or self.last is None:
            return None
        quiet = min(self.last + DEBOUNCE, self.first + MAX_WAIT)
        return quiet if self.sent is None else max(quiet, self.sent + COOLDOWN)

    def take(self, now: float) -> dict | None:
        self.expire(now)
        at = self.due()
        if at is None or at > now:
            return None
        out = {"events": self.events, "pseudonymized": self.pseudonymized, "redacted": self.redacted, "documents": self.documents}
        self.__init__(sent=now)
        return out

    def dump(self) -> str:
        return json.dumps(self.__dict__, ensure_ascii=False)

    @classmethod
    def load(cls, text: str | None) -> Batch:
        return cls(**json.loads(text)) if text else cls()


class Grouping(StatefulProcessor):
    """The state of a session is one string; its timer is set to when the batch falls due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", "body string")

    def _save(self, batch: Batch) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.state.update((batch.dump(),))
        at = batch.due()
        self.handle.registerTimer(int(1000 * (at if at is not None else (batch.sent or 0) + TTL)) + 1)

    def _load(self) -> Batch:
        return Batch.load(self.state.get()[0] if self.state.exists() else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        batch = self._load()
        for frame in rows:
            for r in frame.to_dict("records"):
                batch.add({"pseudonymized": dict(r["pseudonymized"] or {}), "redacted": dict(r["redacted"] or {}), "document": r["document"]}, now)
        self._save(batch)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        batch = self._load()
        out = batch.take(now)
        if out is None and batch.due() is None and batch.sent is None:
            self.state.clear()
        else:
            self._save(batch)
        if out is not None:
            yield pd.DataFrame([{"session": key[0], **out}])

    def close(self) -> None:
        pass


def grouped(summaries: DataFrame) -> DataFrame:
    """Notifications of a stream of ``session``, ``pseudonymized``, ``redacted`` (maps of counts) and ``document``."""
    return summaries.groupBy("session").transformWithStateInPandas(statefulProcessor=Grouping(), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")


def due(pending: DataFrame, sent: DataFrame, now: float, most: int = MOST_SESSIONS) -> DataFrame:
    """The batch form over tables: pending batches (``session``, ``first``, ``last``) that may go out at ``now``.

    Last deliveries (``session``, ``time``) join from the left; the oldest ``most`` come first.
    """
    fresh = pending.where(F.col("last").between(now - TTL, now) & ((F.col("last") <= now - DEBOUNCE) | (F.col("first") <= now - MAX_WAIT)))
    last = sent.where(F.col("time").between(now - TTL, now)).groupBy("session").agg(F.max("time").alias("time"))
    quiet = fresh.join(last, "session", "left").where(F.col("time").isNull() | (F.col("time") <= now - COOLDOWN))
    return quiet.drop("time").orderBy("first", "session").limit(most)


def newest(rows: DataFrame, last: str = "last", most: int = MOST_SESSIONS) -> DataFrame:
    """What a bounded queue keeps: the ``most`` sessions with the latest activity."""
    return rows.orderBy(F.desc(last), "session").limit(most)


def event_time_groups(summaries: DataFrame, ts: str = "ts", gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """The same idea on event time: session windows under a watermark (ours; late rows beyond it are dropped)."""
    return summaries.withWatermark(ts, late).groupBy("session", F.session_window(ts, gap)).agg(F.count("*").alias("events"))


def delivery(mode: Column, origin_known: Column, foreground: Column) -> Column:
    """What becomes of a notification, after the user's mode and whether its window is in front."""
    return (
        F.when(mode == "off", "off").when(mode == "always", "send_always").when(~F.coalesce(origin_known, F.lit(False)), "send_unknown")
        .when(F.coalesce(foreground, F.lit(False)), "suppress_foreground").otherwise("send_background")
    )
