import json

from caselight.operators.nested import NODES_SCHEMA, comment_table, flatten, nodes, said, ticket_table

RAW = "raw_id long, customer_slug string, source_system string, payload string"


def comments(payload):
    return [(n["comment_path"], n["parent_path"], n["author"]) for n in flatten(payload) if n["node_kind"] == "comment"]


def test_replies_lone_objects_and_positions():
    p = {"id": "T-1", "subject": "s", "description": "d", "comments": [{"author": "A", "body": " "}, {"author": {"name": "B", "team": "t"}, "body": "x", "replies": {"body": "y", "author": None, "replies": [{"body": "z", "author": "C"}]}}]}
    assert comments(json.dumps(p)) == [("0", "", "A"), ("1", "", "B"), ("1.0", "1", "Unknown"), ("1.0.0", "1.0", "C")]
    assert comments(json.dumps({**p, "comments": p["comments"][1]}))[0][0] == "0"
    assert comments(json.dumps({**p, "comments": None})) == []


def test_wrappers_and_encodings():
    t = {"ticket_id": "T-2", "subject": "s", "comments": [{"author": "A", "body": "b"}], "internal_notes": [{"author": "bot", "body": "n"}]}
    for shape in (t, [t], {"export": {"account": "a", "tickets": [t]}}, {"event": "e", "data": {"ticket": t}}):
        assert comments(json.dumps(shape)) == [("0", "", "A")]
    assert comments("﻿" + json.dumps(t)) == comments(json.dumps(json.dumps(t))) == [("0", "", "A")]


def test_jira_rich_text():
    body = {"type": "doc", "version": 1, "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Hi"}, {"type": "text", "text": " you", "marks": [{"type": "strong"}]}]}]}
    p = {"key": "OPS-1", "id": "9", "fields": {"summary": "s", "comment": {"comments": [{"author": {"displayName": "D"}, "body": body}, {"author": {"name": "E", "active": True}, "body": {"type": "doc", "content": []}}], "total": 2}}}
    found = [n for n in flatten(json.dumps(p)) if n["node_kind"] == "comment"]
    assert [(n["ticket_id"], n["author"], n["body"].strip(), n["variant"]) for n in found] == [("OPS-1", "D", "Hi you", "rich_person"), ("OPS-1", "E", "", "rich_person")]


def test_unreadable_payloads_and_empty_table(spark):
    bad = [None, "", "<html>", '{"id": "x", "subject": "cut', '""', "[]", "3", '{"a": 1}']
    df = spark.createDataFrame([(i, "c", "s", p) for i, p in enumerate(bad)], RAW)
    assert nodes(df).count() == 0
    assert nodes(df.limit(0)).columns == [x.split()[0] for x in NODES_SCHEMA.split(", ")]


def test_tables_keep_links_and_extra_columns_are_ignored(spark):
    p = json.dumps({"id": "T", "subject": "s", "comments": [{"author": "A", "body": "b"}, {"author": "A", "body": " \n"}]})
    df = spark.createDataFrame([(1, "c", "s", p, "x"), (2, "c", "s", p, "y")], RAW + ", author string")
    n = nodes(df)
    assert ticket_table(n).count() == 2
    assert [(r.raw_id, r.comment_path) for r in comment_table(n).filter(said()).orderBy("raw_id").collect()] == [(1, "0"), (2, "0")]


def test_deep_threads_do_not_recurse():
    c = {"author": "A", "body": "b"}
    for _ in range(400):
        c = {"author": "A", "body": "b", "replies": [c]}
    assert len(comments(json.dumps({"id": "T", "subject": "s", "comments": [c]}))) == 401


def test_wrapping_of_any_depth_and_size():
    import base64

    text = json.dumps({"id": 1, "subject": "s", "comments": [{"author": "A", "body": "b"}]})
    for n in range(12):
        assert comments(text) == [("0", "", "A")], n
        text = base64.b64encode(text.encode()).decode() if n % 3 == 2 else json.dumps(text)
    assert list(flatten(base64.b64encode(b'{"a": 1}').decode())) == []
