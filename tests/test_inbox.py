"""The inbox: new, changed, unchanged, odd and unreadable files, and syncs that fail half way."""

import datetime as dt
import os

import pytest

from caseload.session import scratch_path
from caseload.streaming.inbox import Inbox


def rows(inbox):
    df = inbox.read()
    return sorted(tuple(r[c] for c in ("id", "v", "w") if c in df.columns) for r in df.collect())


@pytest.fixture
def inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    return Inbox(spark, str(tmp_path / "in"), scratch_path(spark, "inbox"))


def put(inbox, name, text, age=60):
    path = os.path.join(inbox.source, name)
    with open(path, "w") as f:
        f.write(text)
    when = dt.datetime.now().timestamp() - age
    os.utime(path, (when, when))


def test_changed_content_replaces_a_files_rows(inbox):
    with pytest.raises(ValueError):
        inbox.read()
    put(inbox, "a 1+[x].csv", "id,v\n1,x\n2,None\n", 500)
    put(inbox, "b-2025-01-31.csv", "id,v\n3,y\n", 500)
    assert inbox.sync() == 2 and inbox.sync() == 0
    assert rows(inbox) == [("1", "x"), ("2", None), ("3", "y")]
    put(inbox, "a 1+[x].csv", "id,v\n1,x\n2,None\n", 400)  # another time, the same content
    assert inbox.sync() == 0
    put(inbox, "a 1+[x].csv", 'w,id\n"new\nline",1\n', 300)  # header drift
    assert inbox.sync() == 1
    assert sorted(rows(inbox), key=str) == [("1", None, "new\nline"), ("3", "y", None)]
    put(inbox, "a 1+[x].csv", "id,v\n1,x\n2,None\n", 200)  # and back to the first content
    assert inbox.sync() == 1
    assert sorted(rows(inbox), key=str) == [("1", "x", None), ("2", None, None), ("3", "y", None)]
    os.remove(os.path.join(inbox.source, "b-2025-01-31.csv"))
    assert inbox.sync() == 0 and len(rows(inbox)) == 3
    dates = {r["source_file"].split("/")[-1]: r["file_date"] for r in inbox.read().collect()}
    assert dates["b-2025-01-31.csv"] == dt.date(2025, 1, 31)


def test_unreadable_and_unfinished_files(inbox):
    put(inbox, "open.csv", 'id,v\n"1,x\n')
    put(inbox, "good.csv", "id,v\n1,x\n")
    put(inbox, "late.csv", "id,v\n2,y\n", -3600)
    assert inbox.sync(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)) == 2
    assert rows(inbox) == [("1", "x")]
    assert {r["file"].split("/")[-1]: r["reason"] for r in inbox.ledger().collect()} == {"open.csv": "unclosed quote", "good.csv": None}
    put(inbox, "open.csv", 'id,v\n"1",z\n', 10)
    assert inbox.sync() == 2 and rows(inbox) == [("1", "x"), ("1", "z"), ("2", "y")]


def test_a_failed_sync_is_done_again(inbox, monkeypatch):
    put(inbox, "a.csv", "id,v\n1,x\n", 500)
    inbox.sync()
    put(inbox, "a.csv", "id,v\n1,changed\n", 400)
    store = inbox._store

    def fail(*args):
        store(*args)
        raise RuntimeError("the driver is lost after the rows and before the ledger")

    monkeypatch.setattr(inbox, "_store", fail)
    with pytest.raises(RuntimeError):
        inbox.sync()
    assert rows(inbox) == [("1", "x")]  # readers see the last finished sync
    monkeypatch.undo()
    put(inbox, "a.csv", "id,v\n1,later\n", 300)
    assert inbox.sync() == 1 and rows(inbox) == [("1", "later")]
