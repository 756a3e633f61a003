"""A live session as streams: paced replay, messages of clients, the panel of nudges, release by the audio clock, control
of a run, its lags, and what is done once when a call ends."""

from __future__ import annotations

import json
import math
import socket
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from callweave.operators.signals import CRITICAL, EXPIRY, SHOWN

#: Seconds between two snapshots of the panel, a clock's tolerance, and how long a run waits for its listener. Fixed values.
TICK_S, TOLERANCE_S, GATE_S = 0.25, 0.05, 10.0


# Sources


class Slice(InputPartition):
    """Numbers from `first` to before `last` of one place (a server, or nothing)."""

    def __init__(self, place: str, first: int, last: int):
        super().__init__((place, first, last))
        self.place, self.first, self.last = place, first, last


class Playback(DataSource):
    """Rows (slot, played_s) of a clock: slot k once (k + 1) * frame seconds of a recording have been played since
    `started` (Unix seconds). Options: started, frame, slots (how many there are), speed, parts."""

    @classmethod
    def name(cls) -> str:
        return "playback"

    def schema(self) -> str:
        return "slot long, played_s double"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PlaybackReader(self.options)


class PlaybackReader(DataSourceStreamReader):
    """Offsets are slots; they follow the wall clock, so a run that starts again goes on where the playback now is, and
    what it missed comes at once."""

    def __init__(self, options: dict[str, str]):
        self.started, self.frame = float(options["started"]), float(options.get("frame", "0.1"))
        self.slots, self.speed, self.parts = int(options["slots"]), float(options.get("speed", "1")), int(options.get("parts", "1"))

    def initialOffset(self) -> dict:
        return {"slot": 0}

    def latestOffset(self) -> dict:
        played = (time.time() - self.started) * self.speed
        return {"slot": min(self.slots, max(0, math.floor(played / self.frame + 1e-9)))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        a, b = start["slot"], end["slot"]
        step = max(1, -(-(b - a) // self.parts))
        return [Slice("", i, min(b, i + step)) for i in range(a, b, step)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for k in range(partition.first, partition.last):
            yield k, (k + 1) * self.frame

    def commit(self, end: dict) -> None:
        pass


def replay(recording: DataFrame, at: str, started: float, frame: float = 0.1, speed: float = 1.0) -> DataFrame:
    """The rows of a recording as a stream, each once, as soon as the frame that holds its time (`at`, seconds from the
    start) has been played back, never before. Rows without a time never come; those before the start come with the first
    frame. The clock is a stream, the recording a table that every trigger reads for the frames just played."""
    spark = recording.sparkSession
    spark.dataSource.register(Playback)
    timed = recording.filter(F.col(at).isNotNull()).withColumn("slot", F.greatest(F.floor(F.col(at) / frame), F.lit(0)).cast("long"))
    last = timed.agg(F.max("slot")).first()[0]
    clock = spark.readStream.format("playback").options(started=repr(started), frame=repr(frame), speed=repr(speed), slots=str(0 if last is None else last + 1)).load()
    return clock.join(timed, "slot").drop("slot")


class Messages(DataSource):
    """Rows (server, number, value) of message servers. Options: servers (host:port, by commas), timeout (seconds).

    A server keeps its messages in a log and answers one line of JSON with lines: {"length": true} with how many it has,
    {"from": a, "to": b} with messages a to before b, one a line. So offsets are numbers of messages by server, and what
    was read once can be read again."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "server string, number long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MessagesReader(self.options)


class MessagesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.servers, self.timeout = [s.strip() for s in options["servers"].split(",") if s.strip()], float(options.get("timeout", "10"))

    def ask(self, server: str, question: dict) -> Iterator[str]:
        host, _, port = server.rpartition(":")
        with socket.create_connection((host, int(port)), self.timeout) as s, s.makefile("rw", encoding="utf-8", newline="\n") as f:
            f.write(json.dumps(question) + "\n")
            f.flush()
            yield from (line.rstrip("\n") for line in f)

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.servers, 0)

    def latestOffset(self) -> dict:
        return {s: int(next(self.ask(s, {"length": True}))) for s in self.servers}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(s, start.get(s, 0), n) for s, n in end.items() if n > start.get(s, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        got = 0
        for i, line in enumerate(self.ask(partition.place, {"from": partition.first, "to": partition.last}), partition.first):
            got += 1
            yield partition.place, i, line
        if got != partition.last - partition.first:
            raise OSError(f"{partition.place} gave {got} of {partition.last - partition.first} messages")

    def commit(self, end: dict) -> None:
        pass


#: What a client's message may hold.
MESSAGE = "type string, call string, speaker string, text string, data string, at double"


def messages(spark: SparkSession, servers: list[str], schema: str = MESSAGE) -> DataFrame:
    """server, number, the fields of schema, audio (the bytes of base64 `data`) and kind: `text`, `audio`, `control` (any
    other type) or `broken` (what isn't such JSON, or audio that isn't base64). Every message has its row."""
    spark.dataSource.register(Messages)
    raw = spark.readStream.format("messages").option("servers", ",".join(servers)).load()
    m = raw.withColumn("m", F.from_json("value", schema)).select("server", "number", "m.*")
    m = m.withColumn("audio", F.when(F.col("type") == "audio", F.try_to_binary("data", F.lit("base64"))))
    known = F.when(F.col("type").isNull() | ((F.col("type") == "audio") & F.col("audio").isNull()), "broken").when(F.col("type").isin("text", "audio"), F.col("type"))
    return m.drop("data").withColumn("kind", F.coalesce(known, F.lit("control")))


# State with timers


def _ms(seconds: float) -> int:
    return round(seconds * 1000)


class Panel(StatefulProcessor):
    """What a call's panel shows at every tick of the event clock. State: nudges until they expire, dismissals, the next
    tick. Ticks run while a nudge can be shown and stop with the last one."""

    def __init__(self, tick_s: float, expiry_s: float, shown: int):
        self.tick, self.expiry, self.shown = _ms(tick_s), _ms(expiry_s), shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nudges = handle.getMapState("nudges", "nudge_id string", "at long, type string, priority int")
        self.gone = handle.getMapState("gone", "nudge_id string", "at long")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int) -> None:
        old = self.due.get()[0] if self.due.exists() else None
        if old is None or at < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = _ms(r["at"])
            if r["dismiss"]:
                before = self.gone.getValue((r["nudge_id"],))
                self.gone.updateValue((r["nudge_id"],), (at if before is None else min(at, before[0]),))
            else:
                self.nudges.updateValue((r["nudge_id"],), (at, r["type"], r["priority"]))
                self._wake(-(-at // self.tick) * self.tick)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, tick = timerValues.getCurrentWatermarkInMs(), self.due.get()[0]
        self.due.clear()
        nudges = {k[0]: tuple(v) for k, v in self.nudges.iterator()}
        gone = {k[0]: v[0] for k, v in self.gone.iterator()}
        while nudges and tick <= now:
            for n in [n for n, v in nudges.items() if tick - v[0] > self.expiry]:
                del nudges[n]
                self.nudges.removeKey((n,))
                if gone.pop(n, None) is not None:
                    self.gone.removeKey((n,))
            live = sorted((-v[2], v[0], n, v[1]) for n, v in nudges.items() if v[0] <= tick and gone.get(n, tick + 1) > tick)
            for critical in (True, False):
                some = [x for x in live if (x[3] in CRITICAL) == critical]
                for place, (_, _, n, kind) in enumerate(some if critical else some[: self.shown], 1):
                    yield Row(call=key[0], tick=tick / 1000, nudge_id=n, type=kind, place=place)
            tick += self.tick
        if nudges:
            self._wake(tick)
        else:
            self.gone.clear()

    def close(self) -> None:
        pass


def panel(events: DataFrame, late: str = "1 second", tick_s: float = TICK_S, expiry_s: float = EXPIRY, shown: int = SHOWN) -> DataFrame:
    """call, tick, nudge_id, type, place of a stream of events (call, at in seconds, nudge_id, type, priority, dismiss):
    signals.active()'s rows at every multiple of tick_s, dismissals taken into account, each given out once the watermark
    has passed the tick. An event later than `late` behind the newest is not seen. Events without call, time or
    identifier are left out. Needs the RocksDB state store."""
    e = events.filter("call IS NOT NULL AND at IS NOT NULL AND nudge_id IS NOT NULL")
    e = e.select(F.col("call").cast("string").alias("call"), F.col("at").cast("double").alias("at"), F.col("nudge_id").cast("string").alias("nudge_id"), "type", F.col("priority").cast("int").alias("priority"), F.coalesce("dismiss", F.lit(False)).alias("dismiss"))
    e = e.withColumn("event_time", F.timestamp_millis(F.round(F.col("at") * 1000).cast("long"))).withWatermark("event_time", late)
    out = "call string, tick double, nudge_id string, type string, place int"
    return e.groupBy("call").transformWithState(Panel(tick_s, expiry_s, shown), out, "append", "EventTime")


class Release(StatefulProcessor):
    """Holds events back until the audio has come to them. State: the events that wait, and how far the audio is."""

    def __init__(self, tolerance_s: float):
        self.tolerance = tolerance_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "number long", "at double, payload string")
        self.position = handle.getValueState("position", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        position = self.position.get()[0] if self.position.exists() else -math.inf
        held = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        kept = set(held)
        for r in sorted(rows, key=lambda r: r["number"]):
            if r["payload"] is None:
                position = max(position, r["at"])
            else:
                held[r["number"]] = (r["at"], r["payload"])
            for n in sorted((n for n, v in held.items() if v[0] <= position + self.tolerance), key=lambda n: (held[n][0], n)):
                at, payload = held.pop(n)
                yield Row(call=key[0], number=n, at=at, payload=payload, released_by=r["number"])
        for n in kept - set(held):
            self.waiting.removeKey((n,))
        for n in set(held) - kept:
            self.waiting.updateValue((n,), held[n])
        if position > -math.inf:
            self.position.update((position,))

    def close(self) -> None:
        pass


def released(events: DataFrame, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """call, number, at, payload, released_by of a stream (call, number, at, payload): events with a payload wait until
    the listener's audio (rows without payload, `at` being its position) has come within tolerance_s of their time; an
    event that is late goes at once, none is dropped. Numbers order a call's rows and don't repeat; `released_by` is that
    of the row that let it go. A position that goes back doesn't count. Rows without call, number or time are left out.
    Needs the RocksDB state store."""
    e = events.filter("call IS NOT NULL AND number IS NOT NULL AND at IS NOT NULL")
    e = e.select(F.col("call").cast("string").alias("call"), F.col("number").cast("long").alias("number"), F.col("at").cast("double").alias("at"), F.col("payload").cast("string").alias("payload"))
    return e.groupBy("call").transformWithState(Release(tolerance_s), "call string, number long, at double, payload string, released_by long", "append", "None")


# Control, lags, and what is done at a call's end


def gated(start: Callable[[], StreamingQuery], gate: threading.Event, stop: threading.Event, timeout_s: float = GATE_S) -> StreamingQuery | None:
    """The query that `start` begins once the gate opens, or after timeout_s without it; none if stop was set first."""
    gate.wait(timeout_s)
    return None if stop.is_set() else start()


def run_until(query: StreamingQuery, stop: threading.Event, poll_s: float = 0.2) -> bool:
    """Waits until the query ends by itself (false) or stop is set (true); then a trigger that has begun is finished, so
    that what was read is written, and the query is ended."""
    while query.isActive:
        if stop.wait(poll_s):
            while query.isActive and query.status["isTriggerActive"] and query.status["isDataAvailable"]:
                time.sleep(poll_s)
            query.stop()
            return True
    return False


#: The name under which lags are observed.
LAGS = "lags"


def observed(rows: DataFrame, stage: str, ms: str) -> DataFrame:
    """rows, of which each trigger tells how many milliseconds its rows of each kind lagged, to a `Lags` listener: counts,
    sums, extremes, and quantile sketches, which merge; `stage` names the kind."""
    v = F.col(ms).cast("double")
    sketch = F.hex(F.expr(f"kll_sketch_agg_double(cast(`{ms}` as double))"))
    return rows.observe(f"{LAGS} {stage}", F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("least"), F.max(v).alias("most"), sketch.alias("sketch"))


class Lags(StreamingQueryListener):
    """Gathers what `observed` tells: a row a trigger and stage."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, m in event.progress.observedMetrics.items():
            if name.startswith(f"{LAGS} ") and m["count"]:
                self.rows.append((name.removeprefix(f"{LAGS} "), str(event.progress.runId), event.progress.batchId, m["count"], m["sum"], m["least"], m["most"], m["sketch"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def summary(self, spark: SparkSession) -> DataFrame:
        """stage, count, p50_ms, p95_ms, min_ms, max_ms, mean_ms over all triggers so far; the quantiles are a KLL
        sketch's."""
        rows = spark.createDataFrame(self.rows, "stage string, run string, batch long, count long, sum double, least double, most double, sketch string")
        g = rows.groupBy("stage").agg(F.sum("count").alias("count"), F.expr("kll_merge_agg_double(unhex(sketch))").alias("k"), F.min("least").alias("min_ms"), F.max("most").alias("max_ms"), (F.sum("sum") / F.sum("count")).alias("mean_ms"))
        at = lambda q: F.expr(f"kll_sketch_get_quantile_double(k, {q}D)")
        return g.select("stage", "count", at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), "min_ms", "max_ms", "mean_ms")


def _written(df: DataFrame, path: str, batch: int, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(f"{path}/batch={batch}")


def finish(path: str, post: Callable[[str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for calls that have ended, been escalated or broken off. Its rows: call_id, market, slots,
    slots_total, final_state, escalated, escalation_reason, grounded_answers, refusals, and turns, an array of (at,
    speaker, text, citations, grounded, retrieved_ids, refused, refusal_gate).

    Writes summaries (nested JSON), transcripts (text by call), leads of calls with slots, and escalations with their
    last turns, each into the folder of its batch, which a batch that is done again writes over: nothing comes twice.
    `post` gets each escalation once as long as its folder is complete; one that broke off before may be posted again
    with the same call_id."""
    from callweave.operators import calls
    from callweave.sources import web

    def run(ended: DataFrame, batch: int) -> None:
        ended = ended.persist()
        try:
            turns = ended.select("call_id", F.explode("turns").alias("t")).select("call_id", "t.*")
            totals = calls.call_summaries(turns, "call_id", "at")
            _written(ended.join(totals.drop("transcript", "grounded_answers", "refusals").withColumnRenamed("turns", "n_turns"), "call_id", "left"), f"{path}/summaries", batch)
            _written(totals.select("call_id", "transcript"), f"{path}/transcripts", batch, "parquet")
            _written(calls.leads(ended.filter(F.size("slots") > 0)), f"{path}/leads", batch)
            raised = calls.escalations(ended, turns, "call_id", "at")
            folder = f"{path}/escalations/batch={batch}"
            if not web.exists(ended.sparkSession, f"{folder}/_SUCCESS"):
                web.write_escalations(raised, folder, post, mode="overwrite")
        finally:
            ended.unpersist()

    return run
