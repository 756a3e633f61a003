"""The live session's streams: against their batch twins, over restarts, and exactly once."""

import collections
import json
import random
import socketserver
import threading
import time

import pytest
from pyspark.sql import functions as F

from callweave.operators import signals
from callweave.streaming import live, session

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def drained(df, path, seen, mode="append"):
    """Runs a stream over what is there, batches going to seen."""
    q = df.writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", path).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def by_file(spark, df, path, order, parts):
    """df's rows as a stream of `parts` files in order."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], df.schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_replay(spark, tmp_path):
    """Every frame comes once, none before it was played; a restart goes on and loses nothing."""
    rows = spark.createDataFrame([(i, i * 0.25 if i else None) for i in range(25)], "id int, at double")
    started, seen = time.time() + 1.0, []
    keep = lambda b, i: seen.extend((r.id, r.at, time.time()) for r in b.collect())
    for wait in (3.5, 6.0):
        q = session.replay(rows, "at", started).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        time.sleep(wait)
        q.stop()
    end = time.time() + 30
    while len(seen) < 24 and time.time() < end:
        drained(session.replay(rows, "at", started), str(tmp_path / "c"), late := [])
        seen += [(r.id, r.at, time.time()) for r in late]
    assert sorted(i for i, *_ in seen) == list(range(1, 25))
    assert all(when >= started + at for _, at, when in seen)


class Log(socketserver.ThreadingTCPServer):
    """A message server: a list behind the source's two questions."""

    allow_reuse_address = daemon_threads = True

    def __init__(self):
        self.lines = []
        log = self

        class Answer(socketserver.StreamRequestHandler):
            def handle(self):
                q = json.loads(self.rfile.readline())
                out = [str(len(log.lines))] if "length" in q else log.lines[q["from"] : q["to"]]
                self.wfile.write("".join(x + "\n" for x in out).encode())

        super().__init__(("127.0.0.1", 0), Answer)
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.place = f"127.0.0.1:{self.server_address[1]}"


def test_messages(spark, tmp_path):
    """Text, audio and control messages of two servers, with broken ones between; a restart loses and repeats nothing."""
    a, b = Log(), Log()
    try:
        stream = lambda: session.messages(spark, [a.place, b.place])
        seen = []
        a.lines += ['{"type": "text", "call": "c1", "speaker": "agent", "text": "hé", "at": 1.5}', '{"type": "reset", "call": "c1"}', "not json"]
        b.lines += ['{"type": "audio", "call": "c2", "data": "AAEC"}', '{"type": "audio", "call": "c2", "data": "?"}']
        drained(stream(), str(tmp_path / "c"), seen)
        assert len(seen) == 5
        a.lines += ['{"type": "playing", "call": "c1"}']
        drained(stream(), str(tmp_path / "c"), seen)
        got = collections.Counter((r.kind, r.type) for r in seen)
        assert got == {("text", "text"): 1, ("control", "reset"): 1, ("broken", None): 1, ("audio", "audio"): 1, ("broken", "audio"): 1, ("control", "playing"): 1}
        assert [bytes(r.audio) for r in seen if r.kind == "audio"] == [b"\x00\x01\x02"] and [r.text for r in seen if r.kind == "text"] == ["hé"]
        assert len({(r.server, r.number) for r in seen}) == 6
    finally:
        a.shutdown(), b.shutdown()


def test_panel(spark, rocks, tmp_path):
    """Ticks, expiry, the cap and dismissals as the batch operator has them, over restarts and out of order."""
    r = random.Random(6)
    kinds = ["compliance_gap", "missed_cross_sell", "buying_signal", "topic_shift", "callback_needed"]
    events = [(f"c{i % 2}", round(r.uniform(0, 30) if i < 30 else r.uniform(140, 150), 2), f"n{i:03d}", r.choice(kinds), r.choice([30, 50, 95]), False) for i in range(40)]
    gone = [(c, at + r.uniform(0, 20), n, None, None, True) for c, at, n, *_ in events if r.random() < 0.4]
    end = [(f"c{i}", 400.0, "end", "compliance_gap", 1, False) for i in range(2)]
    schema = "call string, at double, nudge_id string, type string, priority int, dismiss boolean"
    df = spark.createDataFrame(events + gone + end + [(None, 1.0, "x", "y", 1, None), ("c0", None, "x", "y", 1, None)], schema)
    src, seen = by_file(spark, df, str(tmp_path / "in"), "at", 4), []
    drained(session.panel(src, "1 second", tick_s=5.0), str(tmp_path / "c"), seen)
    emitted = spark.createDataFrame(events, schema)
    ticks = spark.createDataFrame([(f"c{i}", 5.0 * k) for i in range(2) for k in range(60)], "call string, tick double")
    want = signals.active(emitted, ticks, dismissals=spark.createDataFrame(gone, schema).select("call", "nudge_id", "at"))
    key = lambda rows: sorted((x.call, x.tick, x.nudge_id, x.type, x.place) for x in rows if x.nudge_id != "end")
    assert key(seen) == key(want.collect()) and len(key(seen)) > 100


def test_released(spark, rocks, tmp_path):
    """Early events wait for the audio, late ones go at once, none is lost, in batches of any size."""
    r = random.Random(8)
    rows, clock = [], {"a": 0.0, "b": 0.0}
    for n in range(80):
        call = r.choice("ab")
        if r.random() < 0.4:
            clock[call] = round(clock[call] + r.uniform(-0.1, 0.6), 2)
            rows.append((call, n, clock[call], None))
        else:
            rows.append((call, n, round(max(0.0, clock[call] + r.uniform(-1, 1)), 2), f"e{n}"))
    rows += [("a", 100, 99.0, None), ("b", 101, 99.0, None)]
    want = []
    for call in "ab":
        own, far = [x for x in rows if x[0] == call], -1e9
        waiting = {}
        for _, n, at, payload in own:
            if payload is None:
                far = max(far, at)
            else:
                waiting[n] = (at, payload)
            for k in [k for k, v in waiting.items() if v[0] <= far + 0.05]:
                want.append((call, k, *waiting.pop(k), n))
    df = spark.createDataFrame([*rows, (None, 1, 1.0, "x")], "call string, number long, at double, payload string")
    seen = []
    drained(session.released(by_file(spark, df, str(tmp_path / "in"), "number", 3)), str(tmp_path / "c"), seen)
    assert sorted((x.call, x.number, x.at, x.payload, x.released_by) for x in seen) == sorted(want) and any(x[1] != x[4] for x in want)


def test_gate_and_stop(spark, tmp_path):
    gate, stop = threading.Event(), threading.Event()
    rate = lambda: spark.readStream.format("rate").option("rowsPerSecond", 20).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "r")).start()
    began = time.time()
    q = session.gated(rate, gate, stop, 0.5)
    assert q.isActive and time.time() - began >= 0.5  # nobody came: it starts all the same
    threading.Timer(1.5, stop.set).start()
    assert session.run_until(q, stop) and not q.isActive
    assert session.gated(rate, gate, stop, 0.1) is None
    gate.set(), stop.clear()
    began = time.time()
    q = session.gated(rate, gate, stop, 30)
    assert time.time() - began < 20  # the gate was open
    q.stop()
    assert not session.run_until(q, stop)  # it had ended by itself


def test_lags(spark, tmp_path):
    """Counts and extremes are exact over all triggers, quantiles as good as a sketch of so few rows: exact."""
    df = spark.createDataFrame([(i, float(i % 50)) for i in range(100)], "id int, lag_ms double")
    heard, seen = session.Lags(), []
    spark.streams.addListener(heard)
    try:
        drained(session.observed(by_file(spark, df, str(tmp_path / "in"), "id", 3), "transcript", "lag_ms"), str(tmp_path / "c"), seen)
        end = time.time() + 20
        while sum(x[3] for x in heard.rows) < 100 and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(heard)
    x = heard.summary(spark).first()
    assert [x[c] for c in ("stage", "count", "min_ms", "max_ms", "mean_ms")] == ["transcript", 100, 0.0, 49.0, 24.5]
    assert abs(x["p50_ms"] - 24.5) <= 1 and abs(x["p95_ms"] - 47) <= 1


def test_calls_end_once(spark, tmp_path):
    """A batch that is done again writes nothing twice and posts nothing twice; a failing webhook loses nothing."""
    turn = "array<struct<at:double,speaker:string,text:string,citations:array<string>,grounded:boolean,retrieved_ids:array<string>,refused:boolean,refusal_gate:string>>"
    schema = f"call_id string, market string, slots map<string,string>, slots_total int, final_state string, escalated boolean, escalation_reason string, grounded_answers int, refusals int, turns {turn}"
    turns = [(1.0, "agent", "hello", ["kb_a_c01"], True, ["kb_a_c01"], False, None), (2.0, "caller", "a person please", [], False, [], False, None)]
    rows = [("c1", "en_PH", {"name": "Ann", "age_band": "30"}, 6, "ended", False, None, 1, 0, turns), ("c2", "en_PH", {}, 6, "escalated", True, "asked", 0, 1, turns * 4), ("c3", "en_PH", {}, 6, "discovery", False, None, 0, 0, [])]
    df = spark.createDataFrame(rows, schema)
    posts = tmp_path / "posts"
    posts.mkdir()
    folder = str(posts)

    def post(body):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").write(body)

    sink = session.finish(str(tmp_path / "out"), post)
    sink(df, 0)
    sink(df, 0)  # the same batch once more, as after a crash before its commit
    read = lambda name, form="json": spark.read.format(form).load(str(tmp_path / "out" / name))
    assert sorted(x.call_id for x in read("summaries").collect()) == ["c1", "c2", "c3"]
    assert [(x.call_id, x.slots_filled) for x in read("leads").collect()] == [("c1", "2/6")]
    e = read("escalations").collect()
    assert [(x.call_id, x.reason, len(x.recent_turns), x.webhook_delivered) for x in e] == [("c2", "asked", 6, True)] and len(list(posts.iterdir())) == 1
    text = {x.call_id: x.transcript for x in read("transcripts", "parquet").collect()}
    assert text["c1"] == "AGENT : hello   [cited: kb_a_c01]\nCALLER: a person please"

    def down(body):
        raise OSError("down")

    session.finish(str(tmp_path / "out"), down)(df.filter("call_id = 'c2'").withColumn("call_id", F.lit("c9")), 1)
    assert {(x.call_id, x.webhook_delivered) for x in read("escalations").collect()} == {("c2", True), ("c9", False)}


def test_calls_end_by_timer(spark, tmp_path):
    """A call that breaks off ends when its timer runs out, and its end reaches the sink."""
    turns = spark.createDataFrame([("c", 1.0, "answer", "Ann", True, False)], "call string, at double, intent string, value string, fits boolean, escalate boolean")
    turns.write.parquet(str(tmp_path / "in"))
    seen, ends = [], live.conversations(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")), ("name", "age"), idle_ms=1500)
    q = ends.writeStream.foreachBatch(lambda b, i: seen.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    end = time.time() + 40
    while not seen and time.time() < end:
        time.sleep(0.3)
    q.stop()
    assert [(x.call, x.disconnected) for x in seen] == [("c", True)]
