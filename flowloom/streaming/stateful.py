"""Keyed streams in event-time order: what arrives waits in buckets of time and is worked through bucket by bucket.

A bucket is due once the watermark has passed its end; then nothing of it can come any more, so its rows are sorted and
folded into the key's state in the order of their times, whatever order they arrived in. Waiting rows are put under
(bucket, number of the arrival), so a micro-batch writes what it brings and never reads or rewrites what waits already.
Timers stand at the ends of buckets. Rows behind the watermark are dropped by the engine before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def _plain(values: list) -> list:
    """Lists in place of arrays; a null inside one arrives as NaN, which no state has otherwise."""
    return [[None if y != y else y for y in x.tolist()] if hasattr(x, "tolist") else x for x in values]


class InTimeOrder(StatefulProcessor):
    """Buffers rows by bucket of ``width_us`` and gives them to ``fold`` in order of ``columns`` once they are due.

    ``columns``: (name, SQL type) of what waits, time in microseconds first. ``memory``: SQL schema of the folded state.
    Subclasses say how rows and the passing of time change that state (a tuple, or None where there is nothing to keep)."""

    columns: Sequence[tuple[str, str]]
    memory: str
    output: Sequence[str]

    def __init__(self, width_us: int):
        self.width_us = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = ", ".join(f"{n} array<{t}>" for n, t in self.columns)
        self.rows = handle.getMapState("rows", "bucket long, arrival long", arrays)
        self.arrivals = handle.getMapState("arrivals", "bucket long", "n long")
        self.folded = handle.getValueState("folded", self.memory)
        self.done = {}  # of this task: up to which watermark a key's timers were answered

    def fold(self, key, memory, rows: Iterator[tuple], out: list):
        """The state after ``rows``."""
        raise NotImplementedError

    def pass_time(self, key, memory, until_us: int, out: list):
        """The state once it is known that all rows before ``until_us`` were folded."""
        raise NotImplementedError

    def wake_us(self, memory) -> int:
        """The time that ``pass_time`` waits for."""
        raise NotImplementedError

    def _timer(self, bucket: int) -> int:
        """A timer goes off when the watermark is past it: a millisecond before the bucket's end."""
        return -(-(bucket + 1) * self.width_us // 1000) - 1

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        names = [n for n, _ in self.columns]
        table = pd.concat([r[names] for r in rows], ignore_index=True)
        for bucket, part in table.groupby(table[names[0]] // self.width_us):
            bucket = int(bucket)
            n = self.arrivals.getValue((bucket,))[0] if self.arrivals.containsKey((bucket,)) else 0
            self.rows.updateValue((bucket, n), tuple(_plain(part[c].tolist()) for c in names))
            self.arrivals.updateValue((bucket,), (n + 1,))
            if n == 0:
                self.handle.registerTimer(self._timer(bucket))
        return iter(())

    def _waiting(self, bucket: int) -> list[tuple]:
        rows = []
        for n in range(self.arrivals.getValue((bucket,))[0]):
            rows += zip(*self.rows.getValue((bucket, n)))
            self.rows.removeKey((bucket, n))
        self.arrivals.removeKey((bucket,))
        return sorted(rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        # the first timer of a key in a micro-batch does all that is due
        if self.done.get(key) == timerValues.getCurrentWatermarkInMs():
            return
        self.done[key] = timerValues.getCurrentWatermarkInMs()
        now = timerValues.getCurrentWatermarkInMs() * 1000 // self.width_us
        before = tuple(self.folded.get()) if self.folded.exists() else None
        memory, out = before, []
        for due in sorted(b for (b,) in list(self.arrivals.keys()) if b < now):
            memory = self.fold(key, memory, iter(self._waiting(due)), out)
        if memory is not None:
            memory = self.pass_time(key, memory, now * self.width_us, out)
        if memory is None:
            if before is not None:
                self.folded.clear()
        elif memory != before:
            self.folded.update(memory)
            self.handle.registerTimer(self._timer(max(self.wake_us(memory) // self.width_us, now)))
        if out:
            yield pd.DataFrame(out, columns=list(self.output))

    def close(self) -> None:
        pass


class Flows(InTimeOrder):
    """Closing rules of flows: an idle gap, RST, or FIN from both ends."""

    columns = (("timestamp_us", "long"), ("index", "long"), ("side", "int"), ("ip_total_len", "long"), ("rst", "boolean"), ("fin", "boolean"))
    memory = "start long, first long, last long, packets long, bytes long, opener int, fin_opener boolean, fin_other boolean"

    def __init__(self, width_us: int, timeout_us: int, output: Sequence[str]):
        super().__init__(width_us)
        self.timeout_us, self.output = timeout_us, output

    def fold(self, key, memory, rows, out):
        flow = list(memory) if memory else None
        for ts, index, side, size, rst, fin in rows:
            if flow and ts - flow[2] > self.timeout_us:
                out.append((*key, *flow[:5], "timeout"))
                flow = None
            if flow is None:
                flow = [ts, index, ts, 0, 0, side, False, False]
            flow[2:5] = ts, flow[3] + 1, flow[4] + size
            if fin and not rst:
                flow[6 if side == flow[5] else 7] = True
            if rst or (flow[6] and flow[7]):
                out.append((*key, *flow[:5], "tcp_rst" if rst else "tcp_fin_both"))
                flow = None
        return tuple(flow) if flow else None

    def pass_time(self, key, memory, until_us, out):
        if memory[2] + self.timeout_us >= until_us:
            return memory
        out.append((*key, *memory[:5], "timeout"))
        return None

    def wake_us(self, memory):
        return memory[2] + self.timeout_us


class Sequences(InTimeOrder):
    """The last ``steps`` windows without a gap, and the window after them."""

    columns = (("window_us", "long"), ("state", "array<double>"))
    memory = "times array<long>, states array<array<double>>"

    def __init__(self, step_seconds: int, steps: int, output: Sequence[str]):
        super().__init__(step_seconds * 1_000_000)
        self.steps, self.output = steps, output

    def fold(self, key, memory, rows, out):
        times, states = memory or ((), ())
        for now, state in rows:
            state = list(state)
            if times and now - times[-1] > self.width_us:
                times, states = (), ()
            if len(times) == self.steps:
                out.append((*key, times[0] // 1_000_000, times[-1] // 1_000_000, now // 1_000_000, [list(x) for x in states], state))
            times, states = (*times, now)[-self.steps:], (*states, state)[-self.steps:]
        return times, states

    def pass_time(self, key, memory, until_us, out):
        return memory if memory[0][-1] + self.width_us >= until_us else None  # a gap for sure: nothing to remember

    def wake_us(self, memory):
        return memory[0][-1] + self.width_us
