"""Rule signals over call turns, and the control of the nudges that they raise."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Priority, cooldown seconds and vetted text by signal type. Fixed values.
PRIORITY = {"compliance_gap": 100, "risky_statement": 95, "rising_frustration": 80, "payment_difficulty": 70, "buying_signal": 60, "missed_cross_sell": 50, "callback_needed": 40, "topic_shift": 20}
COOLDOWN = {"compliance_gap": 45.0, "risky_statement": 20.0, "rising_frustration": 40.0, "payment_difficulty": 60.0, "buying_signal": 30.0, "missed_cross_sell": 60.0, "callback_needed": 60.0, "topic_shift": 90.0}
DEFAULT_COOLDOWN, FLOOR, FLOOR_COMPLIANCE, EXPIRY, SHOWN = 45.0, 0.55, 0.40, 90.0, 3
CRITICAL = ("compliance_gap", "risky_statement")
SAFE_TEXT = {
    "buying_signal": "Interest signalled. Move to the next concrete step. Do not quote figures that are not in the approved material.",
    "rising_frustration": "Frustration rising. Acknowledge it directly and confirm what happens next.",
    "payment_difficulty": "Payment difficulty signalled. Offer an approved payment-support option, not a discount.",
    "callback_needed": "Caller wants to be reached later. Agree a specific callback time.",
    "topic_shift": "The subject has changed. Confirm the previous point was resolved before moving on.",
}
#: (id, trigger, satisfied, nudge). Fixed values.
DISCLOSURES = [
    ("not_a_deposit", r"\b(invest\w*|funds?|returns?|savings|growth|VUL|unit[- ]linked)\b", r"\b(not a deposit|not guaranteed|subject to market|investment risk|value may (go down|fall))\b", "Investment is being pitched without the disclosure. State that returns are not guaranteed and this is not a deposit."),
    ("licensed_advisor", r"\b(recommend\w*|should (get|buy|take)|best (plan|option) for you|advis\w+)\b", r"\b(licensed (advisor|agent)|financial adviser|subject to (assessment|underwriting))\b", "Advice given without the suitability caveat. Note that a licensed advisor must confirm it."),
    ("recording_notice", r"\b(personal|details|date of birth|address|ID number)\b", r"\b(record(ed|ing)|data privacy|consent|Data Privacy Act)\b", "Personal details discussed without the privacy notice. Give the recording and data-privacy notice now."),
]
#: (type, confidence, pattern, nudge) of what an agent must not say, and of what a caller's words suggest. Fixed values.
RISKY = [
    ("risky_statement", 0.97, r"\bguarantee(d)?\s+(returns?|profit|payout|approval)\b", "Guarantee language used. Correct it now: returns and approval are never guaranteed."),
    ("risky_statement", 0.97, r"\b(no risk|risk[- ]free|can't lose|cannot lose)\b", "Risk-free language used. Retract and state the actual risk."),
    ("risky_statement", 0.97, r"\b(definitely|certainly)\s+(approved|covered|pay out)\b", "Certainty of approval implied. Restate as subject to underwriting."),
]
CUES = [
    ("missed_cross_sell", 0.75, r"\b(my |our )?(wife|husband|spouse|partner|kids?|children|son|daughter|family)\b", "Family mentioned. Family protection or an education plan may fit."),
    ("missed_cross_sell", 0.75, r"\b(second|another|other)\s+(car|vehicle|house|property|policy)\b", "Second asset mentioned. A multi-policy discount may apply."),
    ("missed_cross_sell", 0.75, r"\b(hospital|surgery|illness|diagnos(is|ed)|medical bills?|confine(d|ment))\b", "Health concern raised. A health or critical-illness rider is relevant."),
    ("missed_cross_sell", 0.75, r"\b(retire|retirement|pension|old age)\b", "Retirement mentioned. A savings or retirement plan is relevant."),
    ("payment_difficulty", 0.85, r"\b(can'?t afford|too expensive|no money|tight budget|lost my job|unemployed|salary (cut|reduced)|struggling|behind on|late payment|miss(ed|ing) a payment)\b", "Payment difficulty signalled. Offer an approved payment-support option, not a discount."),
    ("callback_needed", 0.85, r"\b(call me (back|later)|not a good time|busy right now|driving|in a meeting|can you call|ring me)\b", "Caller wants to be reached later. Agree a specific callback time before closing."),
    ("buying_signal", 0.8, r"\b(how do I (sign|apply|start)|what'?s the next step|send me the (form|details|quote)|I'?m interested|sounds good|let'?s do it|how much would it be for me)\b", "Buying signal. Move to the next concrete step rather than adding information."),
]
GAP_CONFIDENCE = 0.95
#: What a model is asked to judge. Fixed values.
JUDGED = ("rising_frustration", "buying_signal", "payment_difficulty", "callback_needed", "topic_shift")
#: What a model-made nudge must not recommend, by pattern, with the reason. Fixed values.
PROHIBITED = [
    (r"\b(projected|specific|expected|estimated)\s+(return|yield|profit|growth)", "recommends quoting a projection"),
    (r"\bguarantee\w*\b", "recommends guarantee language"),
    (r"\b(promise|assure)\w*\s+(approval|payout|coverage|returns?)", "recommends promising an outcome"),
    (r"\b(offer|give|apply)\s+(a\s+)?(discount|lower rate|special price)", "recommends an unauthorised discount"),
    (r"\b(how much|what).{0,20}(they'?ll|you'?ll|would)\s+(make|earn|get)", "recommends quoting earnings"),
    (r"\b(downplay|minimi[sz]e|avoid mentioning|skip)\b", "recommends withholding information"),
]
#: What a recogniser makes of silence. Fixed values.
SILENCE = ("you", "thank you.", "thank you", "thanks for watching!", "thanks for watching", "bye.", "bye", ".", "...", "um", "uh", "so")


def is_artifact(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*SILENCE)


def unsafe_reason(text: Column) -> Column:
    """The first reason why a nudge must not be shown, or ''."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(r)) for p, r in PROHIBITED], F.lit(""))


def disclosure_gaps(turns: DataFrame, call: str, at: str, disclosures: list[tuple[str, str, str, str]] = DISCLOSURES) -> DataFrame:
    """Rows of turns at which a disclosure is due: triggered at or before, an agent turn after the first trigger, and no
    agent turn so far, even before the trigger, that satisfies it. The evidence is what the first trigger matched. turns
    has speaker and text. Running windows a call."""
    w = Window.partitionBy(call).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    agent = F.col("speaker") == "agent"
    out = None
    for name, trigger, satisfied, nudge in disclosures:
        first = F.min(F.when(F.col("text").rlike(f"(?i){trigger}"), F.struct(F.col(at).alias("at"), F.regexp_extract("text", f"(?i){trigger}", 0).alias("evidence")))).over(w)
        met = F.max(F.when(agent & F.col("text").rlike(f"(?i){satisfied}"), 1).otherwise(0)).over(w)
        last = F.max(F.when(agent, F.col(at))).over(w)
        due = turns.withColumn("__first", first).withColumn("__due", (met == 0) & (last > F.col("__first.at"))).filter("__due")
        part = due.select(call, at, F.lit("compliance_gap").alias("type"), F.lit(GAP_CONFIDENCE).alias("confidence"), F.col("__first.evidence").alias("evidence"), F.lit(nudge).alias("nudge"), F.lit(name).alias("disclosure"))
        out = part if out is None else out.unionByName(part)
    return out


Rules = list[tuple[str, float, str, str]]


def cue_signals(turns: DataFrame, call: str, at: str, risky: Rules = RISKY, cues: Rules = CUES) -> DataFrame:
    """A row for each rule that a turn matches: rules on agents' words for agents, cues for all others. Row-wise."""
    agent = F.col("speaker") == "agent"
    hit = lambda t, c, p, n: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"), F.regexp_extract("text", f"(?i){p}", 0).alias("evidence"), F.lit(n).alias("nudge"))
    hits = [F.when(who & F.col("text").rlike(f"(?i){r[2]}"), hit(*r)) for who, rules in ((agent, risky), (~agent, cues)) for r in rules]
    return turns.select(call, at, F.explode(F.array_compact(F.array(*hits))).alias("s")).select(call, at, "s.*", F.lit(None).cast("string").alias("disclosure"))


def with_dims(signals: DataFrame) -> DataFrame:
    """signals with priority, cooldown, floor, dedupe key."""
    look = lambda d, miss: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("type")], F.lit(miss))
    return signals.withColumns({
        "priority": look(PRIORITY, 0), "cooldown": look(COOLDOWN, DEFAULT_COOLDOWN), "floor": F.when(F.col("type").isin(*CRITICAL), FLOOR_COMPLIANCE).otherwise(FLOOR),
        "dedupe_key": F.concat("type", F.lit(":"), F.coalesce("disclosure", F.substring(F.lower(F.trim("evidence")), 1, 60))),
    })


@dataclass
class Engine:
    """The fold over one call's signals: floor, duplicates, cooldown of the type, safety, in that order. A signal that
    cooldown drops may fire later."""

    last: dict[str, float] = field(default_factory=dict)
    seen: set[str] = field(default_factory=set)
    count: int = 0

    def offer(self, rows: Iterable[dict]) -> list[dict]:
        out = []
        for r in rows:
            fate, ident, text, reason = "emitted", None, r["nudge"], ""
            if r["confidence"] < r["floor"]:
                fate = "low_confidence"
            elif r["dedupe_key"] in self.seen:
                fate = "duplicate"
            elif r["type"] in self.last and r["at"] - self.last[r["type"]] < r["cooldown"]:
                fate = "cooldown"
            elif r.get("unsafe"):
                reason = r["unsafe"]
                text = SAFE_TEXT.get(r["type"], "")
                fate = "emitted" if text else "unsafe_dropped"
            if fate == "emitted":
                self.count += 1
                ident = f"n{self.count:03d}"
                self.last[r["type"]] = r["at"]
                self.seen.add(r["dedupe_key"])
            out.append({"call": r["call"], "at": r["at"], "type": r["type"], "priority": r["priority"], "outcome": fate, "nudge_id": ident, "text": text, "rewrite_reason": reason})
        return out


NUDGES = "call string, at double, type string, priority int, outcome string, nudge_id string, text string, rewrite_reason string"
OFFERS = ["call", "at", "type", "confidence", "floor", "cooldown", "priority", "dedupe_key", "nudge", "unsafe"]


def offers(signals: DataFrame, call: str, at: str, model: str = "detector") -> DataFrame:
    """Signals in the engine's form; only the words of model-made nudges are checked for safety."""
    s = with_dims(signals)
    unsafe = F.when(F.col(model) == "model", unsafe_reason(F.col("nudge"))).otherwise("") if model in signals.columns else F.lit("")
    return s.select(F.col(call).cast("string").alias("call"), F.col(at).cast("double").alias("at"), "type", "confidence", "floor", "cooldown", "priority", "dedupe_key", "nudge", unsafe.alias("unsafe"))


def nudges(signals: DataFrame, call: str, at: str) -> DataFrame:
    """The outcome of every signal, call by call, in order of time, priority and key: Engine's rules as one fold."""
    key = [F.col("at"), (-F.col("priority")).alias("urgent"), F.col("dedupe_key")]
    rows = offers(signals, call, at).groupBy("call").agg(F.array_sort(F.collect_list(F.struct(*key, *[c for c in OFFERS if c not in ("call", "at", "dedupe_key")]))).alias("r"))
    done = "array<struct<at:double,type:string,priority:int,outcome:string,nudge_id:string,text:string,rewrite_reason:string>>"
    zero = F.struct(F.create_map().cast("map<string,double>").alias("last"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("count"), F.array().cast(done).alias("out"))
    vetted = F.create_map(*[F.lit(x) for kv in SAFE_TEXT.items() for x in kv])

    def step(st: Column, x: Column) -> Column:
        before = F.try_element_at(st["last"], x["type"])
        stopped = F.when(x["confidence"] < x["floor"], "low_confidence").when(F.array_contains(st["seen"], x["dedupe_key"]), "duplicate").when(x["at"] - before < x["cooldown"], "cooldown")
        unsafe = stopped.isNull() & (x["unsafe"] != "")
        safe = F.coalesce(F.try_element_at(vetted, x["type"]), F.lit(""))
        fate = F.coalesce(stopped, F.when(unsafe & (safe == ""), "unsafe_dropped").otherwise("emitted"))
        out = fate == "emitted"
        count = st["count"] + out.cast("int")
        row = F.struct(x["at"].alias("at"), x["type"].alias("type"), x["priority"].cast("int").alias("priority"), fate.alias("outcome"), F.when(out, F.format_string("n%03d", count)).alias("nudge_id"), F.when(unsafe, safe).otherwise(x["nudge"]).alias("text"), F.when(unsafe, x["unsafe"]).otherwise("").alias("rewrite_reason"))
        last = F.map_concat(F.map_filter(st["last"], lambda k, _: k != x["type"]), F.create_map(x["type"], x["at"]))
        return F.struct(F.when(out, last).otherwise(st["last"]).alias("last"), F.when(out, F.concat(st["seen"], F.array(x["dedupe_key"]))).otherwise(st["seen"]).alias("seen"), count.alias("count"), F.concat(st["out"], F.array(row)).alias("out"))

    return rows.select("call", F.explode(F.aggregate("r", zero, step, lambda st: st["out"])).alias("o")).select("call", "o.*")


def suppression(outcomes: DataFrame, by: list[str]) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    g = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("signals_seen"), n("low_confidence").alias("dropped_low_confidence"), n("duplicate").alias("dropped_duplicate"), n("cooldown").alias("dropped_cooldown"), F.count_if((F.col("outcome") == "emitted") & (F.col("rewrite_reason") != "")).alias("unsafe_text_rewritten"), n("unsafe_dropped").alias("unsafe_text_dropped"), n("emitted").alias("nudges_emitted"))
    return g.withColumn("suppression_rate", F.when(F.col("signals_seen") > 0, F.bround(1 - F.col("nudges_emitted") / F.col("signals_seen"), 3)).otherwise(0.0))


def active(emitted: DataFrame, ticks: DataFrame, expiry: float = EXPIRY, shown: int = SHOWN, dismissals: DataFrame | None = None) -> DataFrame:
    """call, tick, nudge_id, place: nudges not older than expiry at each tick of their call; critical ones all, others
    the `shown` first by priority and time. emitted: call, at, nudge_id, type, priority; ticks: call, tick. A nudge
    dismissed (call, nudge_id, at) at or before the tick makes room for the next. The range join is an equi-join on slots
    of the expiry's length."""
    slot = lambda c: F.floor(F.col(c) / expiry)
    t = ticks.withColumn("__slot", F.explode(F.array(slot("tick"), slot("tick") - 1)))
    j = t.join(emitted.withColumn("__slot", slot("at")), ["call", "__slot"]).filter((F.col("at") <= F.col("tick")) & (F.col("tick") - F.col("at") <= expiry))
    if dismissals is not None:
        gone = dismissals.groupBy("call", "nudge_id").agg(F.min("at").alias("__gone"))
        j = j.join(gone, ["call", "nudge_id"], "left").filter(F.col("__gone").isNull() | (F.col("__gone") > F.col("tick"))).drop("__gone")
    critical = F.col("type").isin(*CRITICAL)
    w = Window.partitionBy("call", "tick", critical).orderBy(F.desc("priority"), "at", "nudge_id")
    return j.withColumn("place", F.row_number().over(w)).filter(critical | (F.col("place") <= shown)).select("call", "tick", "nudge_id", "type", "place")


def distinct_evidence(signals: DataFrame, call: str) -> DataFrame:
    """call, signals, distinct: how many signals a call raised, and how many that aren't repeats of type and evidence."""
    return with_dims(signals).groupBy(call).agg(F.count(F.lit(1)).alias("signals"), F.count_distinct("dedupe_key").alias("distinct"))


def with_transcript(nudges_: DataFrame, transcript: DataFrame) -> DataFrame:
    """Nudges beside the line (call, utt_id, speaker, text, start_s) they arose from; a nudge without a line stays."""
    return nudges_.join(transcript, ["call", "utt_id"], "left")


def snapshot_changes(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """key, change: nudges to retire and to add between two snapshots."""
    gone = before.select(key).join(now.select(key), key, "left_anti").select(key, F.lit("retire").alias("change"))
    return gone.unionByName(now.select(key).join(before.select(key), key, "left_anti").select(key, F.lit("add").alias("change")))
