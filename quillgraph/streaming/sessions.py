"""Session memory: a question with the six before it, in batch by a window and in streams by keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MEMORY = 6


def session_context(questions: DataFrame) -> DataFrame:
    """(session_id, turn, question, analysis_text): up to six earlier questions of the session before the present one."""
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-MEMORY, -1)
    told = F.array_join(F.collect_list("question").over(before), " ")
    return questions.select("session_id", "turn", "question", F.trim(F.concat_ws(" ", told, F.col("question"))).alias("analysis_text"))


def _remember(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    history = list(state.get[0]) if state.exists else []
    for batch in batches:
        rows = []
        for turn, question in sorted(zip(batch.turn, batch.question)):
            rows.append((key[0], turn, question, " ".join([*history, question]).strip()))
            history = [*history, question][-MEMORY:]
        yield pd.DataFrame(rows, columns=["session_id", "turn", "question", "analysis_text"])
    state.update((history,))


def stream_session_context(questions: DataFrame) -> DataFrame:
    """The same over a stream (session_id long, turn long, question string); state holds six questions for each session."""
    return questions.select("session_id", "turn", "question").groupBy("session_id").applyInPandasWithState(
        _remember, "session_id bigint, turn bigint, question string, analysis_text string", "history array<string>", "append", "NoTimeout"
    )


def expiring_session_context(questions: DataFrame, expires: int) -> DataFrame:
    """(session_id, turn, question, analysis_text) of (session_id, turn, question, at): memory in order of time, which is gone once ``expires`` seconds pass without a turn."""
    order = Window.partitionBy("session_id").orderBy("at", "turn")
    pause = F.unix_millis("at") - F.unix_millis(F.lag("at").over(order))
    parts = questions.withColumn("_fresh", F.coalesce((pause > expires * 1000).cast("int"), F.lit(0))).withColumn("_part", F.sum("_fresh").over(order))
    before = Window.partitionBy("session_id", "_part").orderBy("at", "turn").rowsBetween(-MEMORY, -1)
    told = F.array_join(F.collect_list("question").over(before), " ")
    return parts.select("session_id", "turn", "question", F.trim(F.concat_ws(" ", told, F.col("question"))).alias("analysis_text"))


class _Sessions(StatefulProcessor):
    """Turns wait until the watermark has passed them, so that late ones fall into place; a timer ends the memory of a session."""

    def __init__(self, expires: int):
        self._expires = expires * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # waiting turns, the last questions, the time of the last turn told
        self._state = handle.getValueState("session", "told string")

    def _load(self) -> dict:
        return json.loads(self._state.get()[0]) if self._state.exists() else {"waiting": [], "history": [], "last": None}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, timers = self._load(), set(self._handle.listTimers())
        for batch in rows:
            for at, turn, question in zip(batch["at"], batch["turn"], batch["question"]):
                moment = int(pd.Timestamp(at).timestamp() * 1000)
                state["waiting"].append([moment, int(turn), question])
                if moment not in timers:
                    timers.add(moment)
                    self._handle.registerTimer(moment)
        self._state.update((json.dumps(state),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, now = self._load(), timerValues.getCurrentWatermarkInMs()
        due = sorted(w for w in state["waiting"] if w[0] <= now)
        state["waiting"] = [w for w in state["waiting"] if w[0] > now]
        out = []
        for moment, turn, question in due:
            if state["last"] is not None and moment - state["last"] > self._expires:
                state["history"] = []
            out.append((key[0], turn, question, " ".join([*state["history"], question]).strip()))
            state["history"], state["last"] = [*state["history"], question][-MEMORY:], moment
        if not state["waiting"] and state["last"] is not None and state["last"] + self._expires < now:
            self._state.clear()
        else:
            self._state.update((json.dumps(state),))
            if due:
                self._handle.registerTimer(state["last"] + self._expires + 1)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "turn", "question", "analysis_text"])

    def close(self) -> None:
        pass


def stream_sessions(questions: DataFrame, late: str = "10 minutes", expires: int = 3600) -> DataFrame:
    """``expiring_session_context`` over a stream (session_id long, turn long, question string, at timestamp).

    Turns up to ``late`` behind the newest are put in order; later ones are dropped. A turn is told once the watermark has
    passed it. State holds the turns that wait and six questions of each session, and ends by timer ``expires`` seconds after its last turn.
    """
    spark = questions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "session_id bigint, turn bigint, question string, analysis_text string"
    rows = questions.select("session_id", "turn", "question", "at").withWatermark("at", late)
    return rows.groupBy("session_id").transformWithStateInPandas(_Sessions(expires), kind, "Append", "EventTime")
