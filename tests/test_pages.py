"""Reports as they are published."""

from callweave.operators import calls, pages, reports


def text(page):
    return pages.markdown(page).first().markdown


def test_models(spark):
    runs = spark.createDataFrame([("a", 100.0), ("a", 300.0), ("b|c", 450.0)], "model string, ms double")
    outputs = spark.createDataFrame([("a", '{"x": 1}'), ("a", "NO_ANSWER"), ("b|c", "FAILED: x")], "model string, o string")
    got = text(pages.models(calls.ranked_latency(runs, "model", "ms"), reports.capabilities(outputs, "model", "o", "NO_ANSWER")))
    assert "| a | 200.0 ms | 100.0 ms | 300.0 ms |\n| b\\|c | 450.0 ms | 450.0 ms | 450.0 ms |\n\nFastest: `a`, 2.3 times as fast as the next." in got
    assert "| Model | JSON | Refused | Failed |\n|---|---|---|---|\n| a | 1/2 | 1/2 | 0/2 |\n| b\\|c | 0/1 | 0/1 | 1/1 |" in got


def test_call_results(spark, tmp_path):
    schema = "at int, name string, why string, call_id string, final_state string, slots_filled string, grounded_answers int, refusals int, escalated boolean, band string, score int, transcript string"
    rows = [(2, "two", None, "c2", "escalated", "0/6", 0, 1, True, None, None, "CALLER: a ``` b"), (1, "one", "to see", "c1", "ended", "2/6", 1, 0, False, "hot", 9, "")]
    page = pages.call_results(spark.createDataFrame(rows, schema))
    got = text(page)
    assert got.startswith("# Test calls\n\n\n| # | Scenario |") and "| 1 | one | ended | 2/6 | 1 | 0 | no |\n| 2 | two | escalated | 0/6 | 0 | 1 | yes |" in got
    assert "### 1. one\n\n- **Why**: to see\n- **Call**: c1\n- **Lead**: hot (score 9)\n\n### 2. two\n\n- **Call**: c2\n- **Handover**: escalation written\n\n```\nCALLER: a  b\n```\n" in got
    pages.write(page, str(tmp_path / "p"))
    pages.write(page, str(tmp_path / "p"))
    (file,) = (tmp_path / "p").glob("*.txt")
    assert file.read_text() == got + "\n"


def test_live_results(spark):
    scenarios = spark.createDataFrame([(1, "s1", 15, 2, 0.8667, ["a"], ["a", "b"], True), (2, "s2", 0, 0, 0.0, [], [], False)], "at int, id string, seen int, shown int, rate double, expected array<string>, fired array<string>, passed boolean")
    spans = spark.createDataFrame([("asr", 10.0, 1), ("asr", 20.0, 2)], "stage string, ms double, seq int")
    got = text(pages.live_results(scenarios, calls.latency_summary(spans, "stage", "ms", "seq")))
    assert "| 1 | s1 | 15 | 2 | 87 % | a | a, b | yes |\n| 2 | s2 | 0 | 0 | 0 % |  |  | NO |\n\n**1/2 scenarios passed.**" in got
    assert "| asr | 2 | 15.0 | 19.5 | 15.0 | 20.0 |" in got


def test_retrieval(spark):
    schema = "at int, query string, intent string, must_refuse boolean, top_score double, verdict string, reason string, refused boolean, gate string, right boolean, chunk string, url string, why string, answer string, citations array<string>, note string, snippet string"
    rows = [(1, "q1", "faq", False, 0.61, "correct", "first", False, None, True, "kb_1", "http://u", "strong", "It is.", ["kb_1"], "n", "text"), (2, "q2", "other", True, 0.2, "correct", "low", True, "retrieval", True, None, None, "weak", None, [], "", "")]
    scores = spark.createDataFrame([(0, 0.61, False), (0, 0.2, True)], "part int, top_score double, must_refuse boolean")
    got = text(pages.retrieval(spark.createDataFrame(rows, schema), calls_calibration(scores)))
    assert "| 1 | q1 | faq | 0.610 | correct | answered | yes |\n| 2 | q2 *(must refuse)* | other | 0.200 | correct | refused at retrieval gate | yes |\n\n**End to end: 2/2 behaved correctly.**" in got
    assert "- **Agent answered**: It is.\n- **Citations**: kb_1\n- **Note**: n\n\n```\ntext\n```" in got and "- **Agent behaviour**: refused at retrieval gate\n" in got
    assert "| Lowest top score of answerable questions | 0.61 |" in got and "| Separable by score alone | yes |" in got


def calls_calibration(scores):
    from callweave.operators import search

    return search.calibrate(scores, ["part"])


def test_no_rows(spark):
    none = spark.createDataFrame([], "model string, ms double")
    assert "| Model | Mean | Min | Max |\n|---|---|---|---|\n" in text(pages.models(calls.ranked_latency(none, "model", "ms"), reports.capabilities(none.selectExpr("model", "'x' as o"), "model", "o", "N")))
