"""JSON payloads of any shape, with parts missing or of another type."""

import json

from caseload.operators import chats
from caseload import schema
from caseload.sources import payloads

BOT = "ce8545b838652bea3889eafd72a6d821"
EVENTS = [{"type": "message", "created_at": "2024-05-01T10:00:00Z", "author_type": "customer", "text": "x"},
          {"type": "message", "author_type": "agent"}, "junk",
          {"type": "message", "created_at": "2024-05-01T12:00:30+02:00", "author_type": "agent"},
          {"type": "closed", "created_at": "2024-05-01T10:10:00Z"}]


def parsed(spark, *chats_):
    rows = [(c if isinstance(c, str) else json.dumps(c),) for c in chats_]
    directory = spark.createDataFrame([("a1", "Nora", "agent"), ("a1", "Alan", "agent"), (None, "x", "bot")], "id string, name string, type string")
    df = payloads.chat_payloads(spark.createDataFrame(rows, "payload string"))
    assert [f.name for f in df.schema.fields] == [f.name for f in schema.CHAT_PAYLOAD.fields]
    return {r["chat_id"]: r for r in payloads.parse_chat_payload(df, directory).collect()}


def test_shapes(spark):
    got = parsed(
        spark,
        {"chat": {"id": "w", "threads": [{"events": EVENTS}, {"events": []}], "thread": {}, "tags": [{"name": "a"}, {"id": 1}, {"name": "b"}],
                  "started_at": "2024-05-01T09:59:00Z", "created_at": "",
                  "users": [{"id": "a1", "type": "agent"}, {"id": BOT, "type": "bot"}, {"id": "c", "type": "customer"}, 7],
                  "properties": {"items": [{"name": "rating", "value": {"score": 1}}, {"name": "rating", "value": {"score": 5, "comment": "top"}},
                                           {"name": "source", "value": {"type": "mobile"}}]}}},
        {"id": 17, "thread": "t-9", "last_event_created_at": "2024-05-01T09:00:00Z", "tags": ["a", 3], "users": "none", "properties": []},
        {"id": "t", "thread": {"created_at": "2024-05-01T09:00:00Z", "last_event_created_at": "2024-05-01T09:30:00Z"},
         "properties": {"rating": "good", "source": "web"}},
        "not json", "[1]", "", '{"id": "null parts", "thread": null, "users": null, "properties": null, "tags": null}')
    assert set(got) == {"w", "17", "t", "null parts"}
    w = got["w"]
    assert (w["tags"], w["bot_transfer"], w["human_agents"], w["bot_agent"], w["primary_agent"]) == ("a,,b", True, "Nora", "Wynn AI", "Nora")
    assert (w["rating_value"], w["rate_raw"], w["rating_comment"], w["source"]) == (5.0, "rated good", "top", "mobile")
    assert (w["duration_minutes"], w["first_response_seconds"], w["created_ts_utc"].isoformat()) == (10.0, 30.0, "2024-05-01T09:59:00")
    assert got["17"]["created_ts_utc"].hour == 9 and got["17"]["tags"] == "a,3" and got["17"]["num_agents"] == 0
    assert got["t"]["duration_minutes"] == 30.0 and not got["t"]["has_rating"] and got["t"]["source"] == "unknown"
    assert got["null parts"]["created_ts_utc"] is None and got["null parts"]["duration_minutes"] == 0


def test_payload_to_normalised_chat_keeps_time_and_response(spark):
    text = json.dumps({"id": "w", "thread": {"events": EVENTS, "started_at": "2024-05-01T10:00:00Z"}, "users": [{"id": "a1", "type": "agent"}]})
    df = payloads.chat_payloads(spark.createDataFrame([(text,)], "payload string"))
    flat = schema.resolve_columns(payloads.parse_chat_payload(df, {"a1": ("Nora", "agent")}), schema.CHAT_COLUMNS)
    (r,) = chats.normalize_chats(flat).collect()
    assert r["created_ts_utc"].isoformat() == "2024-05-01T10:00:00" and r["created_ts_local"].hour == 7
    assert (r["first_response_seconds"], r["duration_minutes"], r["display_agent"]) == (30.0, 10.0, "Nova")


def test_ticket_pages(spark):
    page = {"results": [{"id": 1, "properties": {"subject": "a", "n": {"x": 1}}, "createdAt": "t"}, "junk", {"id": "2"}]}
    df = spark.createDataFrame([(json.dumps(page),), ('{"id":"3","properties":{"subject":null}}',), ("oops",), ('{"results":[]}',)], "payload string")
    got = {r["ticket_id"]: (r["subject"], r["n"]) for r in payloads.flatten_tickets(payloads.ticket_payloads(df), ["subject", "n"]).collect()}
    assert got == {"1": ("a", '{"x":1}'), "2": (None, None), "3": (None, None)}
