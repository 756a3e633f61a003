"""Streaming twins of the call operators: nudges, speech segments, conversations, sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from callweave.operators.calls import CLOSED, SEGMENTS, Conversation, SpeechRules
from callweave.operators.signals import DISCLOSURES, EXPIRY, NUDGES, Engine, offers

_STATE = "data string"


def _load(state: GroupState) -> dict:
    return json.loads(state.get[0]) if state.exists else {}


def nudges(signals: DataFrame, call: str, at: str, idle_ms: int = 3_600_000) -> DataFrame:
    """Outcomes of a stream of signals, the engine's memory kept per call, until a call has no signal for idle_ms. Rows
    of a micro-batch are taken in order of time; a duplicate's memory holds for the whole call, like the batch
    operator's."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _load(state)
        e = Engine(kept.get("last", {}), set(kept.get("seen", [])), kept.get("count", 0))
        if state.hasTimedOut:  # a call that has gone quiet for good
            state.remove()
            yield pd.DataFrame([], columns=[c.split()[0] for c in NUDGES.split(", ")])
            return
        pdf = pd.concat(list(parts)).sort_values(["at", "priority", "dedupe_key"], ascending=[True, False, True])
        out = e.offer(dict(zip(pdf.columns, r, strict=True)) for r in zip(*[pdf[c].tolist() for c in pdf.columns], strict=True))
        state.setTimeoutDuration(idle_ms)
        state.update((json.dumps({"last": e.last, "seen": sorted(e.seen), "count": e.count}),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in NUDGES.split(", ")])

    return offers(signals, call, at).groupBy("call").applyInPandasWithState(step, NUDGES, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def speech_segments(frames: DataFrame, level: float = 180.0, idle_ms: int = 30_000, frame: float = 0.1, **params: float) -> DataFrame:
    """Segments from a stream of (call, speaker, frame, rms), given out when they close; a channel without frames for
    idle_ms is flushed. The state holds the runs of the open segment alone."""
    rules = SpeechRules.of(frame, **params)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _load(state)
        runs, seen, count = [tuple(r) for r in kept.get("runs", [])], kept.get("seen", 0), kept.get("count", 0)
        if state.hasTimedOut:
            done, _ = rules.split(runs)
            state.remove()
        else:
            pdf = pd.concat(list(parts)).sort_values("frame")
            at = pdf["frame"].to_numpy(np.int64)[pdf["rms"].to_numpy() >= level]
            for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                a, b = int(part[0]), int(part[-1])
                runs[-1:] = [(runs[-1][0], b)] if runs and runs[-1][1] == a - 1 else [*runs[-1:], (a, b)]
            seen = int(pdf["frame"].max()) + 1
            done, runs = rules.split(runs, seen)
            state.update((json.dumps({"runs": runs, "seen": seen, "count": count + len(done)}),))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, f"{key[1][0]}{count + k}", round(a * frame, 2), round(b * frame, 2)) for k, (a, b) in enumerate(done, 1)], columns=["call", "speaker", "utt_id", "start_s", "end_s"])

    return frames.groupBy("call", "speaker").applyInPandasWithState(step, SEGMENTS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def conversations(turns: DataFrame, slots: tuple[str, ...], idle_ms: int = 3_600_000) -> DataFrame:
    """A row when a call ends, is escalated, or has no turn for idle_ms (final_state is then the state it was left in,
    and `disconnected` true): call, final_state, slots_filled, disconnected. Once a call."""
    shape = ["call", "final_state", "slots_filled", "disconnected"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _load(state)
        told = kept.pop("told", False)
        c = Conversation(slots, **kept)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([] if told else [(key[0], c.state, len(c.filled), True)], columns=shape)
            return
        pdf = pd.concat(list(parts)).sort_values("at")
        for intent, value, fits, escalate in zip(pdf["intent"], pdf["value"], pdf["fits"], pdf["escalate"], strict=True):
            c.step(intent, value or "", bool(fits), bool(escalate))
        now = c.state in CLOSED and not told
        state.update((json.dumps({"state": c.state, "filled": c.filled, "skipped": c.skipped, "tries": c.tries, "told": told or now}),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], c.state, len(c.filled), False)] if now else [], columns=shape)

    return turns.groupBy("call").applyInPandasWithState(step, "call string, final_state string, slots_filled int, disconnected boolean", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def in_order(done: DataFrame, give_up_ms: int = 60_000) -> DataFrame:
    """Rows (call, seq, text) of a stream that may come out of order, handed on in the order of seq, from 0: a row waits
    for those before it. After give_up_ms without a row, what waits goes on without what is missing."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _load(state)
        head, waiting = kept.get("head", 0), {int(k): v for k, v in kept.get("waiting", {}).items()}
        out = []
        if state.hasTimedOut:
            out, waiting = sorted(waiting.items()), {}
            head = out[-1][0] + 1 if out else head
        else:
            for pdf in parts:
                waiting |= {k: v for k, v in zip(pdf["seq"].tolist(), pdf["text"].tolist(), strict=True) if k >= head}
            while head in waiting:
                out.append((head, waiting.pop(head)))
                head += 1
        state.update((json.dumps({"head": head, "waiting": waiting}),))
        if waiting:
            state.setTimeoutDuration(give_up_ms)
        yield pd.DataFrame([(key[0], k, v) for k, v in out], columns=["call", "seq", "text"])

    return done.groupBy("call").applyInPandasWithState(step, "call string, seq long, text string", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _rule_hits(turns: pd.DataFrame, rules: list) -> pd.DataFrame:
    return pd.concat([turns["text"].str.contains(f"(?i){p}", regex=True, na=False) for p in rules], axis=1) if len(rules) else pd.DataFrame(index=turns.index)


def disclosure_gaps(turns: DataFrame, disclosures: list[tuple[str, str, str, str]] = DISCLOSURES, idle_ms: int = 3_600_000) -> DataFrame:
    """The batch operator's rows (call, at, disclosure) of a stream of turns (call, at, speaker, text) that come in order
    of time within a call. The state is, for each disclosure, when it was triggered first and whether it was satisfied,
    and the last agent turn."""
    names = [x[0] for x in disclosures]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _load(state)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["call", "at", "disclosure"])
            return
        pdf = pd.concat(list(parts)).sort_values("at", ignore_index=True)
        agent, at = pdf["speaker"] == "agent", pdf["at"].astype(float)
        last = at.where(agent).ffill().fillna(kept.get("last", -np.inf))
        out, memory = [], {"last": float(last.iloc[-1])}
        hits, met = _rule_hits(pdf, [x[1] for x in disclosures]), _rule_hits(pdf, [x[2] for x in disclosures])
        for i, name in enumerate(names):
            first = at.where(hits.iloc[:, i]).cummin().ffill()
            first = first.fillna(np.inf).clip(upper=kept.get(f"first {name}", np.inf))
            done = ((met.iloc[:, i] & agent).cummax()) | bool(kept.get(f"met {name}", False))
            due = ~done & (last > first)
            out += [(key[0], a, name) for a in at[due].tolist()]
            memory[f"met {name}"] = bool(done.iloc[-1])
            if np.isfinite(first.iloc[-1]):
                memory[f"first {name}"] = float(first.iloc[-1])
        state.update((json.dumps(memory if np.isfinite(memory["last"]) else {k: v for k, v in memory.items() if k != "last"}),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["call", "at", "disclosure"])

    return turns.select("call", F.col("at").cast("double"), "speaker", "text").groupBy("call").applyInPandasWithState(step, "call string, at double, disclosure string", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def judge_triggers(turns: DataFrame, least: int = 160, idle_ms: int = 3_600_000) -> DataFrame:
    """The batch operator's rows (call, at) of a stream of turns (call, at, text): the state is the characters since the
    last judging."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, out = _load(state).get("n", 0), []
        if state.hasTimedOut:
            state.remove()
        else:
            pdf = pd.concat(list(parts)).sort_values("at", ignore_index=True)
            total = n + pdf["text"].str.len().fillna(0).cumsum().to_numpy()
            base, i = 0, 0
            while i < len(total):  # from one judging to the next
                i += int(np.searchsorted(total[i:] - base, least))
                if i < len(total):
                    out.append((key[0], float(pdf["at"][i])))
                    base, i = total[i], i + 1
            state.update((json.dumps({"n": int(total[-1] - base)}),))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["call", "at"])

    return turns.select("call", F.col("at").cast("double"), "text").groupBy("call").applyInPandasWithState(step, "call string, at double", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def source(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 1) -> DataFrame:
    """Messages of clients as a stream: JSON lines in files that arrive in a folder, text and base64 audio alike; lines
    that don't parse are left out. audio comes as bytes."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path)
    got = raw.select(F.from_json("value", schema).alias("m")).filter("m IS NOT NULL").select("m.*")
    return got.withColumn("audio", F.unbase64("audio")) if "audio" in got.columns else got


def sessions(events: DataFrame, by: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions by gap, given out once the watermark has passed them."""
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return e.groupBy(by, F.session_window("__ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windows(events: DataFrame, by: str, ts: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return e.groupBy(by, F.window("__ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def fresh(nudges_: DataFrame, at: str, expiry_s: float = EXPIRY) -> DataFrame:
    """Nudges once each, their identifiers remembered for as long as they can show."""
    e = nudges_.withWatermark(at, f"{int(expiry_s)} seconds")
    return e.dropDuplicatesWithinWatermark(["call", "nudge_id"])


def lag(transcripts: DataFrame, spoken: str) -> DataFrame:
    """Milliseconds from the end of speech to now."""
    return transcripts.withColumn("lag_ms", (F.unix_millis(F.current_timestamp()) - F.unix_millis(spoken)).cast("double"))
