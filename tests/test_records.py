"""JSON-lines records: odd lines, missing parts, repeated ids."""

import json

from caseload.operators import conversations as conv
from caseload.operators import logs
from caseload.sources import records


def lines(tmp_path, *rows):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def message(i, **more):
    return {"timestamp": f"2024-01-0{i}T10:00:00", "user_message": f"q{i}", "ai_response": f"a{i}" * 150, **more}


def test_conversations(spark, tmp_path):
    c = {"conversation_id": "c1", "user_id": "u", "created_at": "2024-01-01T10:00:00", "last_updated": "2024-01-01T10:00:00", "query_count": 1,
         "messages": [message(1)]}
    path = lines(
        tmp_path, c, {**c, "last_updated": "2024-01-03T10:00:00", "query_count": 3, "messages": [message(i, data_insights="seen" if i == 2 else None) for i in (1, 2, 3)]},
        "not json", "", "[1]", {"conversation_id": "c2", "messages": None, "last_updated": "2024-01-02T00:00:00+02:00"},
        {"conversation_id": "c3", "deleted": True, "last_updated": "bad", "messages": [{"user_message": None}]}, {"user_id": "nobody"})
    df = records.read_conversations(spark, path)
    rows = {r["conv_id"]: r for r in df.collect()}
    assert set(rows) == {"c1", "c2", "c3"} and rows["c1"]["query_count"] == 3 and rows["c2"]["messages"] == []
    assert rows["c2"]["last_updated"].isoformat() == "2024-01-01T22:00:00" and rows["c3"]["last_updated"] is None
    context = {r["conv_id"]: r["context"] for r in records.recorded_context(df, 2).collect()}
    assert set(context) == {"c1", "c2"} and context["c2"] == []
    assert [(e["question"], e["summary"]) for e in context["c1"]] == [("q2", "seen"), ("q3", ("a3" * 150)[:200])]
    digest = {r["conv_id"]: r["context_summary"] for r in records.recorded_digest(df, 1).collect()}
    assert digest["c1"] == "Q: q3...\nA: " + "a3" * 50 + "..." and digest["c2"] == "" and digest["c3"] == "Q: ...\nA: ..."
    assert [r["preview"] for r in conv.recent_conversations(df, limit=2).collect()] == ["q1...", "Empty conversation"]
    assert records.recorded_exchanges(df).count() == 4


def test_runs(spark, tmp_path):
    entry = lambda i, level="INFO": {"timestamp": f"2024-01-01T10:00:{i:02d}", "level": level, "stage": None if i == 3 else "S", "message": f"m{i}", "details": {"k": 1}}
    path = lines(tmp_path, {"run_id": "a", "start_time": "2024-01-01T10:00:00", "total_duration_ms": 61000, "log_entries": [entry(i, "ERROR" if i % 2 else "INFO") for i in range(25)]},
                 {"run_id": "b", "start_time": "2024-01-02T10:00:00", "log_entries": None}, "oops")
    runs = records.read_runs(spark, path)
    got = {r["run_id"]: r for r in logs.run_details(runs).collect()}
    assert got["a"]["error_count"] == 12 and got["a"]["details"].startswith("[S] m15 | ") and got["b"]["details"] == ""
    newest = records.recent_run_records(runs, 1)
    assert [r["run_id"] for r in newest.collect()] == ["b"]
    kept = records.entries_of(records.recent_run_records(runs, 2, 20)).collect()
    assert [r["message"] for r in kept] == [f"m{i}" for i in range(5, 25)]
