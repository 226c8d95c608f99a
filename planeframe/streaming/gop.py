"""Frame sequences whose P frames need an intact chain back to an I frame: batch windows and a stateful stream."""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NO_REF, READY, INVALID = 0, 1, 2
#: Status of a frame: accepted, P without an I before or of another group, P after damage.
ACCEPTED, MALFORMED, REFERENCE = 0, -9, -17


def with_state(df: DataFrame, is_i: Column, status: Column, gop_id: Column, by: list[str], order: list[str]) -> DataFrame:
    """df with state (after each frame) and code (what becomes of it).

    status is the frame's own (0, or why it can't be read): a frame that can't be read makes the reference INVALID,
    an I frame makes it READY with its group. A P frame changes nothing: it is accepted if the reference is READY and
    of its group, else refused with a code of its own. So the last I and the last bad frame decide, by windows."""
    df = df.withColumn("_i", is_i).withColumn("_st", status.cast("int")).withColumn("_g", gop_id).withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    w = Window.partitionBy(*by).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    good = "_i AND _st = 0"
    df = df.withColumn("_li", F.max(F.expr(f"IF({good}, _place, NULL)")).over(w)).withColumn("_lb", F.max(F.expr("IF(_st <> 0, _place, NULL)")).over(w))
    df = df.withColumn("_lg", F.last(F.expr(f"IF({good}, _g, NULL)"), ignorenulls=True).over(w))
    state = F.expr(f"CASE WHEN _li IS NULL AND _lb IS NULL THEN {NO_REF} WHEN _li IS NULL OR coalesce(_lb, 0) > _li THEN {INVALID} ELSE {READY} END")
    df = df.withColumn("state", state.cast("bigint"))
    code = F.expr(f"CASE WHEN _st <> 0 THEN _st WHEN _i THEN {ACCEPTED} WHEN state = {NO_REF} THEN {MALFORMED} WHEN state = {INVALID} THEN {REFERENCE} WHEN NOT (_g <=> _lg) THEN {MALFORMED} ELSE {ACCEPTED} END")
    return df.withColumn("code", code.cast("int")).drop("_i", "_st", "_g", "_place", "_li", "_lb", "_lg")


class Reference:
    """The machine by itself, frame by frame: observe() says what becomes of a frame, abort() takes back the last one."""

    def __init__(self, state: int = NO_REF, group: int = -1):
        self.state, self.group = state, group
        self._was = (state, group)

    def observe(self, is_i: bool, status: int, gop_id: int) -> int:
        self._was = (self.state, self.group)
        if status:
            self.state = INVALID
            return int(status)
        if is_i:
            self.state, self.group = READY, int(gop_id)
            return ACCEPTED
        if self.state != READY:
            return MALFORMED if self.state == NO_REF else REFERENCE
        return ACCEPTED if gop_id == self.group else MALFORMED

    def abort(self) -> None:
        self.state, self.group = self._was


class GopProcessor(StatefulProcessor):
    """The same machine for transformWithStateInPandas: rows (key, idx, is_i, status, gop_id) in, with state and code
    out. The state is stored after a batch went through, so that a batch that fails leaves the reference as it was."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state int, gop_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        at = Reference(*(self.state.get() if self.state.exists() else ()))
        frames = pd.concat(list(rows)).sort_values("idx")
        states, codes = [], []
        for is_i, status, gop in zip(frames["is_i"], frames["status"], frames["gop_id"]):
            codes.append(at.observe(bool(is_i), int(status), int(gop)))
            states.append(at.state)
        self.state.update((at.state, at.group))
        yield pd.DataFrame({"key": key[0], "idx": frames["idx"].to_numpy(), "state": states, "code": codes})

    def close(self) -> None:
        pass


def stream_states(frames: DataFrame) -> DataFrame:
    """(key, idx, state, code) of a stream of frames (key, idx, is_i, status, gop_id), kept across micro-batches."""
    return frames.groupBy("key").transformWithStateInPandas(
        statefulProcessor=GopProcessor(), outputStructType="key bigint, idx bigint, state int, code int", outputMode="Append", timeMode="None"
    )


class RateProcessor(StatefulProcessor):
    """Rate control of a stream: rows (key, idx, size) in, the qp of the next frame out; the controller's window, sums,
    debt and qp are its state."""

    def __init__(self, target: int, qp0: int = 40, qp_max: int = 95):
        self.target, self.qp0, self.qp_max = target, qp0, qp_max

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", "recent array<bigint>, total bigint, frames bigint, debt bigint, qp int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        recent, total, n, debt, qp = self.state.get() if self.state.exists() else ([], 0, 0, 0, self.qp0)
        recent, frames, out = list(recent), pd.concat(list(rows)).sort_values("idx"), []
        for size in frames["size"].astype(int).tolist():
            cut = len(recent) >= 4 and size > 1.8 * max(1.0, statistics.median(recent[-24:]))
            recent, total, n = [*recent[-23:], size], total + size, n + 1
            debt = max(0, debt + min(size - self.target, 3 * self.target))
            log = lambda share: 8.0 * math.log2(max(share, 1e-9))
            change = log(max(size, 1) / self.target)
            change += 0.35 * max(-6.0, min(6.0, log(sum(recent) / len(recent) / self.target))) if len(recent) >= 12 else 0.0
            change += 0.15 * log(total / (self.target * n)) if n > 4 else 0.0
            change += min(4.0, log(1.0 + debt / (self.target * 24))) if debt else 0.0
            most = 8.0 if cut else 4.0
            qp = max(0, min(self.qp_max, qp + round(max(-most, min(most, change)))))
            out.append(qp)
        self.state.update((recent, total, n, debt, qp))
        yield pd.DataFrame({"key": key[0], "idx": frames["idx"].to_numpy(), "qp": out})

    def close(self) -> None:
        pass


def stream_qp(frames: DataFrame, target: int, qp0: int = 40) -> DataFrame:
    """(key, idx, qp) of a stream of frames (key, idx, size)."""
    return frames.groupBy("key").transformWithStateInPandas(
        statefulProcessor=RateProcessor(target, qp0), outputStructType="key bigint, idx bigint, qp int", outputMode="Append", timeMode="None"
    )
