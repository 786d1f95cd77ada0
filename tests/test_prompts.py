"""Prompts of interactions from each source, and over the smallest tables against a sequential reading."""

import json

import pyarrow.parquet as pq
import pytest

from strandline.operators import records as R
from strandline.operators import turns as T
from test_reference import ev, frame


def item(*content, turn="t", kind="UserMessage"):
    return ev("item_completed", turn, item={"type": kind, "content": [*content]})


def said(*texts, turn="t", kinds=("context", "user.text"), role="user", part="input_text"):
    meta = {"turn_id": turn, "content_item_kinds": [*kinds]}
    return "response_item", {"type": "message", "role": role, "content": [{"type": part, "text": x} for x in texts], "internal_chat_message_metadata_passthrough": meta}


def text(x, kind="text"):
    return {"type": kind, "text": x}


LEGACY = ev("user_message", "other", message="legacy")
CASES = {
    "completed": ([item(text("", "text"), {"type": "image"}, None, text("one"), text("two"))], "one"),
    "last completed over all": ([said("response"), LEGACY, item(text("one")), item(text("two")), item(text(""))], "two"),
    "completed before legacy": ([item(text("one")), LEGACY], "one"),
    "completed of another turn, kind or part": ([item(text("x"), turn="u"), item(text("x"), kind="AgentMessage"), item(text("x", "input_text")), LEGACY], "legacy"),
    "completed with an unreadable part": ([item(text("x"), "y"), item({"type": "text", "text": 5}, text("x"))], ""),
    "response is joined": ([said("first; ", "", "second"), LEGACY], "first; second"),
    "legacy first": ([LEGACY, said("response")], "legacy"),
    "response of another turn, role, kind or part": ([said("x", turn="u"), said("x", role="assistant"), said("x", kinds=["context"]), said("x", part="text")], ""),
}


@pytest.mark.parametrize("name", CASES)
def test_sources(spark, name):
    recs, want = CASES[name]
    r = frame(spark, [ev("task_started"), *recs, ev("task_complete"), LEGACY])
    assert [x.prompt for x in T.interactions(r).collect()] == [want]


def sequential(rows):
    """(file, seq) -> prompt, record by record."""
    out, open_turn, n = {}, {}, {}

    def texts(content, kind):
        if not isinstance(content, list | None) or any(not isinstance(x, dict | None) or x and not all(isinstance(x.get(k), str | None) for k in ("type", "text")) for x in content or []):
            return []
        return [x["text"] for x in content or [] if x and x.get("type") == kind and x.get("text")]

    for r in sorted(rows, key=lambda r: (r["file_path"], r["line_no"], r["record_id"])):
        f = r["file_path"]
        try:
            p = json.loads(r["payload"] or "")
        except ValueError:
            continue
        if not isinstance(p, dict):
            continue
        kind, turn = p.get("type"), p.get("turn_id") or ""
        if r["rec_type"] == "event_msg" and kind == "task_started" and not (f in open_turn and open_turn[f] == turn != ""):
            open_turn[f], n[f] = turn, n.get(f, 0) + 1
            out[f, n[f]] = ""
        if f not in open_turn:
            continue
        at = f, n[f]
        if r["rec_type"] == "response_item" and kind == "message" and p.get("role") == "user":
            m = p.get("internal_chat_message_metadata_passthrough")
            m = m if isinstance(m, dict) else {}
            if (m.get("turn_id") or "") == open_turn[f] and isinstance(m.get("content_item_kinds"), list) and "user.text" in m["content_item_kinds"]:
                out[at] = out[at] or "".join(texts(p.get("content"), "input_text"))
        elif r["rec_type"] != "event_msg":
            continue
        elif kind == "user_message":
            out[at] = out[at] or p.get("message") or ""
        elif kind == "item_completed" and turn == open_turn[f] and isinstance(p.get("item"), dict) and p["item"].get("type") == "UserMessage":
            out[at] = next(iter(texts(p["item"].get("content"), "text")), out[at])
        elif kind in ("task_complete", "turn_aborted"):
            del open_turn[f]
    return out


def test_against_sequential(spark, data):
    rows = pq.read_table(f"{data}/rollout_records.parquet").to_pylist()
    got = {(x.file_path, x.seq): x.prompt for x in T.interactions(R.decode(spark.read.parquet(f"{data}/rollout_records.parquet"))).collect()}
    assert got == sequential(rows)
