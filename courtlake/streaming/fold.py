"""Keyed state machines on a stream, whose state ends."""
import json
import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds by which event times are moved: a watermark starts at zero, and a media clock's first row must lie behind it.
SHIFT_S = 86400
#: Groups of keys whose states are stored together.
GROUPS = 1024
STATE_CONF = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """A JSON state per key. Keys are kept in groups by their hash: each group of keys that a batch touches costs a few calls to the state
    store, far more than the steps themselves. A batch's rows are taken in order of ``order``; ``step`` may keep anything JSON can
    hold. A state ends at the earlier of two times: its ``deadline``, if the step set one, when ``on_timer`` runs; and ``idle``
    seconds after the key's last row, when the state goes. A group has one timer, at the first of its keys' ends."""

    def __init__(self, key: str, order: Sequence[str], step: Callable, out: Sequence[str], on_timer: Callable | None, flush: Callable | None,
                 time: str | None, idle: float | None):
        self.key, self.order, self.step, self.out, self.on_timer, self.flush = key, list(order), step, list(out), on_timer, flush
        self.time, self.idle = time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "json string")

    def _load(self) -> tuple[dict, int | None]:
        """By key the state and the time of its last row; and the group's timer."""
        stored = self.state.get()
        keys, timer = json.loads(stored[0]) if stored is not None else ([], None)
        return {k: (state, seen) for k, state, seen in keys}, timer

    def _save(self, keys: dict, timer: int | None) -> None:
        """``timer`` is the one that stands; it moves with the group's first end."""
        kept = [(k, state, seen) for k, (state, seen) in keys.items() if state is not None]
        end = min((self._ms(x) for _, *of in kept for x in self._ends(*of)), default=None)
        if timer != end:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if end is not None:
                self.handle.registerTimer(end)
        if kept:
            self.state.update((json.dumps([kept, end]),))
        else:
            self.state.clear()

    @staticmethod
    def _ms(t: float) -> int:
        return math.ceil((t + SHIFT_S) * 1000)

    def _deadline(self, state):
        return state.get("deadline") if self.on_timer is not None else None

    def _ends(self, state, seen) -> list[float]:
        return [x for x in (self._deadline(state), None if self.idle is None or seen is None else seen + self.idle) if x is not None]

    def _rank(self, row: dict) -> list:
        """Missing values come last."""
        return [(row[c] is None or row[c] != row[c], row[c]) for c in self.order]

    def _rows(self, key, values) -> Iterator[Row]:
        row = Row(*self.out)
        return (row(key, *v) for v in values)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch: dict = {}
        for r in rows:
            batch.setdefault(r[self.key], []).append(r.asDict())
        keys, timer = self._load()
        for k, mine in batch.items():
            (state, seen), out = keys.get(k, (None, None)), []
            for row in sorted(mine, key=self._rank):
                state, emitted = self.step(state, row)
                out += emitted
            if self.time is not None:
                seen = max((x for x in (seen, *[r[self.time] for r in mine]) if x is not None and x == x), default=None)
            if self.flush is not None:
                out += self.flush(state)
            keys[k] = (state, seen)
            yield from self._rows(k, out)
        self._save(keys, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        keys, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs()              # all ends that have come; the timer stands at the first
        for k, (state, seen) in keys.items():
            deadline = self._deadline(state)
            if deadline is not None and self._ms(deadline) <= now:
                state, out = self.on_timer(state)
                yield from self._rows(k, out)
            if self.idle is not None and seen is not None and self._ms(seen + self.idle) <= now:
                state = None
            keys[k] = (state, seen)
        self._save(keys, timer)

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, key: str, order: Sequence[str], step: Callable, schema: str, *, on_timer: Callable | None = None,
                flush: Callable | None = None, mode: str = "append", time: str | None = None, idle: float | None = None,
                groups: int = GROUPS) -> DataFrame:
    """``step(state, row) -> (state, [tuples])`` per row of each key, in order within a micro-batch; rows of later
    batches continue from the stored state. ``schema`` starts with the key. State lives in RocksDB (the session that starts the query
    says so in ``STATE_CONF``), so it may outgrow memory and survives lost executors through the checkpoint.

    With ``idle`` a key's state is dropped once the watermark is so many seconds past its last row; ``on_timer(state)`` runs when the
    watermark passes the ``deadline`` that a step has put into the state. Both need ``time``, the column of the rows' times in seconds, and a watermark
    on a timestamp ``SHIFT_S`` later. A key is anything JSON can hold; the keys' states are stored in ``groups`` by their hash, a number that a checkpoint fixes."""
    out = [c.strip().split(" ")[0] for c in schema.split(",")]
    timed = on_timer is not None or idle is not None
    if timed and time is None:
        raise ValueError("name the column of times")
    return df.withColumn("_group", F.pmod(F.hash(key), F.lit(groups))).groupBy("_group").transformWithState(
        statefulProcessor=_Fold(key, order, step, out, on_timer, flush, time, idle), outputStructType=schema, outputMode=mode,
        timeMode="EventTime" if timed else "None")
