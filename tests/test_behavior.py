"""Behaviour reports: what is taken from them, and what is refused."""

import json

from spanframe.sources.behavior import behavior_sequences, read_behavior_reports


def call(category, api, **more):
    return {"category": category, "api": api, **more}


def report(*processes):
    return json.dumps({"behavior": {"processes": [{"calls": list(p)} for p in processes]}}, ensure_ascii=False)


def test_faults_and_ignored_calls(spark):
    good = [call("process", " Open "), call("misc", "é"), call(7, None), {"api": "x"}, call("network", "Send")]
    rows = {
        "good": report(good), "none": report(), "empty": report([]), "null": None, "text": "no", "twice": '{"behavior": {}, "behavior": {}}',
        "list": "[]", "processes": '{"behavior": {"processes": "x"}}', "calls": '{"behavior": {"processes": [{"calls": []}, {"calls": 1}]}}', "process": '{"behavior": {"processes": [3]}}',
        "call": report([call("process", "A"), 5]), "number": report([call("process", 5)]), "blank": report([call("registry", " \t")]),
        "ascii": report([call("process", "비ASCII")]), "long": report([call("process", "a" * 513)]), "fits": report([call("process", "a" * 512)]),
        "first": report([call("process", "")], [5]),
    }
    df = spark.createDataFrame(list(rows.items()), "name string, body string")
    got = {r.report: r for r in read_behavior_reports(df, "name", "body").collect()}
    assert {k: r.fault for k, r in got.items()} == {
        "good": None, "none": None, "empty": None, "fits": None, "null": "no JSON object or a key twice", "text": "no JSON object or a key twice", "twice": "no JSON object or a key twice",
        "list": "processes is no list", "processes": "processes is no list", "calls": "calls is no list", "process": "calls is no list", "call": "call is no object",
        "number": "api is no text", "blank": "api is no text", "ascii": "api is not ASCII", "long": "api is too long", "first": "api is no text"}
    assert got["good"].ignored == 3 and [tuple(c) for c in got["good"].calls] == [(0, 0, "process", "Open"), (0, 4, "network", "Send")]
    assert all(r.calls == [] and r.ignored == 0 for r in got.values() if r.fault)
    small = {r.report: r.fault for r in read_behavior_reports(df, "name", "body", max_bytes=8).collect()}
    assert small["good"] == "report is too large" and small["text"] == "no JSON object or a key twice"
    assert read_behavior_reports(df.limit(0), "name", "body").count() == 0


def test_sequences_lose_repeats_and_equal_processes(spark):
    a, b = call("process", "A", arguments=[{"value": "SECRET"}]), call("registry", "B")
    body = report([a, a, call("misc", "x"), a, b, a], [a, b, b, a], [b], [])
    df = spark.createDataFrame([("r", body), ("s", report([b])), ("bad", report([b, 4]))], "id string, body string")
    got = behavior_sequences(read_behavior_reports(df, "id", "body"), bucket=2).collect()
    assert sorted((r.report, r.process, r.pos, r.category, r.api) for r in got) == [
        ("r", 0, 0, "process", "A"), ("r", 0, 1, "registry", "B"), ("r", 0, 2, "process", "A"), ("r", 2, 0, "registry", "B"), ("s", 0, 0, "registry", "B")]
