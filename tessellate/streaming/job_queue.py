"""A queue of runs with few slots: a host that asks is queued, runs when one of the slots of its pool is free, and is ready or has failed when it ends.

State of a pool: who waits, who runs and until when, and how every host stands.  A run that says nothing for the
watchdog's time has failed; its slot is free again.  What happens is decided by event time: a run whose time is up is
ended before anything that happens later, whether that comes with the next rows or a timer has to say so.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SLOTS, WATCHDOG_MS = 2, 150_000
CHUNK = 65_536
OUT = "pool string, host string, state string, at timestamp"


class Pool:
    """The slots of one pool. Times are in ms; changes collects (host, state, time)."""

    def __init__(self, waiting=(), running=(), state=None, slots: int = SLOTS, watchdog: int = WATCHDOG_MS):
        self.waiting, self.running = deque(waiting), dict(running)  # running: host -> when its time is up
        self.state = {} if state is None else state
        self.slots, self.watchdog = slots, watchdog
        self.changes: list[tuple[str, str, int]] = []

    def _set(self, host: str, state: str, at: int) -> None:
        self.state[host] = state
        self.changes.append((host, state, at))

    def _fill(self, at: int) -> None:
        while len(self.running) < self.slots and self.waiting:
            host = self.waiting.popleft()
            self.running[host] = at + self.watchdog
            self._set(host, "running", at)

    def until(self, now: int) -> None:
        """Ends the runs whose time is up, in the order in which it is; those that start in their place may end, too."""
        while self.running:
            host, end = min(self.running.items(), key=lambda x: (x[1], x[0]))
            if end > now:
                return
            del self.running[host]
            self._set(host, "error", end)
            self._fill(end)

    def event(self, host: str, kind: str, at: int) -> None:
        """kind: request, ready or error. A host that waits or runs, or was read already, is not queued again; one that has failed is. The end of a run that was given up still counts as its state."""
        self.until(at)
        held = self.state.get(host)
        if kind == "request":
            if held not in ("queued", "running", "ready"):
                self._set(host, "queued", at)
                self.waiting.append(host)
        elif held == "running":
            del self.running[host]
            self._set(host, kind, at)
        elif held == "error" and kind == "ready":
            self._set(host, kind, at)
        self._fill(at)


def in_order(frames: Iterator[pd.DataFrame], chunk: int = CHUNK) -> Iterator[tuple[str, str, int]]:
    """(host, kind, ms) of all frames by time and id. Events are held as numbers, 21 bytes each and 8 for their order; only a chunk of them stands as objects."""
    hosts: dict[str, int] = {}
    kinds: dict[str, int] = {}
    held = {"ms": [], "id": [], "host": [], "kind": []}
    for f in frames:
        held["ms"].append(f["ms"].to_numpy())
        held["id"].append(f["id"].to_numpy())
        held["host"].append(np.array([hosts.setdefault(h, len(hosts)) for h in f["host"].tolist()], np.int32))
        held["kind"].append(np.array([kinds.setdefault(k, len(kinds)) for k in f["kind"].tolist()], np.int8))
    if not held["ms"]:
        return
    ms, ids, of, what = (np.concatenate(held.pop(c)) for c in ("ms", "id", "host", "kind"))
    order = np.lexsort((ids, ms))
    del ids
    named, told = list(hosts), list(kinds)
    for k in range(0, len(order), chunk):
        at = order[k : k + chunk]
        yield from ((named[h], told[w], t) for h, w, t in zip(of[at].tolist(), what[at].tolist(), ms[at].tolist()))


class QueueProcessor(StatefulProcessor):
    """Pool as Spark's state: one value for who waits and runs, a map for how hosts stand. A host's state is read when it is named."""

    def __init__(self, slots: int = SLOTS, watchdog: int = WATCHDOG_MS):
        self.slots, self.watchdog = slots, watchdog

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.line = handle.getValueState("line", "held string, timer long")
        self.hosts = handle.getMapState("hosts", "host string", "state string")

    def _pool(self) -> tuple[Pool, int]:
        held, timer = self.line.get() if self.line.exists() else ('{"waiting": [], "running": []}', 0)
        held = json.loads(held)
        states = {h: "queued" for h in held["waiting"]} | {h: "running" for h, _ in held["running"]}
        return Pool(held["waiting"], held["running"], states, self.slots, self.watchdog), timer

    @staticmethod
    def _changed(key, pool: Pool, touched: dict[str, None]) -> Iterator[pd.DataFrame]:
        """What changed since the last call leaves."""
        if pool.changes:
            hosts, states, times = zip(*pool.changes)
            pool.changes = []
            touched.update(dict.fromkeys(hosts))
            yield pd.DataFrame({"pool": key[0], "host": hosts, "state": states, "at": pd.to_datetime(list(times), unit="ms")})

    def _done(self, key, pool: Pool, timer: int, touched: dict[str, None]) -> Iterator[pd.DataFrame]:
        yield from self._changed(key, pool, touched)
        for host in touched:
            self.hosts.updateValue((host,), (pool.state[host],))
        following = min(pool.running.values(), default=0)
        if following != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if following:
                self.handle.registerTimer(following)
        self.line.update((json.dumps({"waiting": list(pool.waiting), "running": list(pool.running.items())}), following))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pool, timer = self._pool()
        touched: dict[str, None] = {}
        for host, kind, ms in in_order(rows):
            if len(pool.changes) >= CHUNK:
                yield from self._changed(key, pool, touched)
            if host not in pool.state and self.hosts.containsKey((host,)):
                pool.state[host] = self.hosts.getValue((host,))[0]
            pool.event(host, kind, ms)
        yield from self._done(key, pool, timer, touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pool, timer = self._pool()
        pool.until(expiredTimerInfo.getExpiryTimeInMs())
        yield from self._done(key, pool, 0, {})

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, slots: int = SLOTS, watchdog_ms: int = WATCHDOG_MS, lateness: str = "0 seconds") -> DataFrame:
    """events(pool, id, host, kind, ts) -> (pool, host, state, at): a row a change. Needs the RocksDB state store (see state_store). Pools do not share slots; all events of one meet in one task."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("pool").transformWithStateInPandas(QueueProcessor(slots, watchdog_ms), OUT, "Append", "EventTime")


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark, provider: str | None = STORE) -> str | None:
    """Sets the session's state store, to the one that timers and maps need, and gives the one before."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider) if provider else spark.conf.unset(key)
    return before
