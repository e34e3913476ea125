"""Conversations: what was said before, in batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexiqua.functions import text

#: Pronouns that stand for the subject of what was said before.
PRONOUNS = "it its they them their this that these those".split()
REMEMBERED = 10


def with_previous(turns: DataFrame) -> DataFrame:
    """Turns (``conv_id, turn, role, text``) with ``previous`` text and how many of the last ten turns were the same role's."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    recent = order.rowsBetween(-REMEMBERED, -1)
    return turns.withColumn("previous", F.lag("text").over(order)).withColumn("recent", F.collect_list("role").over(recent)).withColumn("recent_same", F.size(F.filter("recent", lambda r: r == F.col("role"))).cast("long")).drop("recent")


def resolve(sentence: Column, previous: Column) -> Column:
    """Pronouns replaced by the first content word of the previous text, where there is one."""
    subject = F.get(text.keyword_tokens(previous), F.lit(0))
    words = F.transform(F.split(sentence, " "), lambda w: F.when(F.lower(w).isin(*PRONOUNS), subject).otherwise(w))
    return F.when(subject.isNotNull(), F.array_join(words, " ")).otherwise(sentence)


def _remember(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(frames)).sort_values("turn")
    out = []
    for turn, said in zip(rows["turn"], rows["text"]):
        out.append((key[0], turn, said, last[-1] if last else None))
        last = [*last, said or ""][-REMEMBERED:]
    state.update((last,))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "previous"])


def stream_previous(turns: DataFrame) -> DataFrame:
    """The same on a stream: each conversation's last ten texts are its state."""
    return turns.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandasWithState(_remember, "conv_id long, turn long, text string, previous string", "last array<string>", "append", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows, with late ones up to the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


class _InOrder(StatefulProcessor):
    """Turns of one conversation, held until the watermark passes them, then told in order with what was said before."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, turn long, role string, text string")
        self.said = handle.getValueState("said", "texts array<string>, roles array<string>, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.at), None if pd.isna(r.turn) else int(r.turn), r.role, r.text) for frame in rows for r in frame.itertuples()]
        for row in new:
            self.held.appendValue(row)
        for at in {row[0] for row in new}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.held.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        due = [r for r in held if r[0] <= now]
        texts, roles, last = self.said.get() if self.said.exists() else ([], [], due[0][0] if due else now)
        texts, roles = [*texts], [*roles]
        if not due:
            if now >= last + self.keep_ms:
                self.said.clear()  # nothing was said for as long as conversations are remembered
            return iter(())
        out = []
        for at, turn, role, text_ in due:
            if at >= last + self.keep_ms:
                texts, roles = [], []
            last = at
            out.append((key[0], turn, text_, texts[-1] if texts else None, sum(r == role for r in roles), at))
            texts, roles = [*texts, text_][-REMEMBERED:], [*roles, role][-REMEMBERED:]
        self.held.clear()
        if len(due) < len(held):
            self.held.put(held[len(due) :])
        self.said.update((texts, roles, last))
        self.handle.registerTimer(last + self.keep_ms)
        return iter((pd.DataFrame(out, columns=["conv_id", "turn", "text", "previous", "recent_same", "at"]).astype({"recent_same": "int64"}),))

    def close(self) -> None:
        pass


def stream_in_order(turns: DataFrame, time_col: str, late: str = "10 minutes", keep: timedelta = timedelta(days=1)) -> DataFrame:
    """``with_previous`` on a stream, in order of time and not of arrival: ``conv_id, turn, text, previous, recent_same, at`` (milliseconds).

    ``turns`` has ``conv_id, turn, role, text`` and a time. A turn is held in its conversation's state until the watermark (the latest time seen
    less ``late``) passes it, and a timer then tells all that are due, in order of time and turn; so batches may bring turns in any order
    within ``late``. Later ones are dropped, as on any watermark. A conversation remembers ten turns, for ``keep`` after its last. Null
    texts and roles are kept; a null time is never due and goes. The session's state store must be RocksDB, which holds timers.
    """
    timed = turns.filter(F.col(time_col).isNotNull()).withWatermark(time_col, late)
    rows = timed.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.unix_millis(F.col(time_col)).alias("at"), time_col)
    return rows.groupBy("conv_id").transformWithStateInPandas(_InOrder(int(keep.total_seconds() * 1000)), "conv_id long, turn long, text string, previous string, recent_same long, at long", "Append", "EventTime")
