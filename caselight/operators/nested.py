"""Deeply nested ticket records turned into related flat tables.

The shapes of a payload's objects are classified bottom-up by a deterministic tree automaton: the state of a node depends only on its
kind, its labels and the states of its children. Each structural variant (a state) is routed to the table of its subtype; the tables
share the supertype's keys and the link to the parent.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES_SCHEMA = "raw_id long, customer_slug string, source_system string, node_kind string, variant string, ticket_pos int, ticket_id string, comment_path string, parent_path string, author string, body string, created_at string, subject string, status string, priority string, assignee string"

# The labels that tell the shapes apart.
TICKET_IDS = ("key", "ticket_id", "id")
TIME_LABELS = ("created_at", "timestamp", "created")
AUTHOR_LABELS = ("displayName", "name")


def decoded(payload: str | None) -> Any:
    """The value of a payload that can be read in full, if need be after removing byte order marks or undoing string or base64 wrapping, however often; else None."""
    value: Any = payload
    while isinstance(value, str):  # each step makes the text shorter
        text = value.lstrip("\ufeff").strip().removeprefix("\u00ef\u00bb\u00bf")
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            try:
                value = base64.b64decode(text, validate=True).decode("utf-8")
            except (binascii.Error, ValueError):
                return None
            if not value:
                return None
    return value


def rich_text(node: Any) -> str:
    """The text of a body: a string, or a tree of nodes with ``text`` and ``content``; block nodes end a line."""
    if isinstance(node, str):
        return node
    out: list[str] = []
    stack: list[Any] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, list):
            stack.extend(reversed(n))
        elif isinstance(n, dict):
            if isinstance(n.get("text"), str):
                out.append(n["text"])
            if n.get("type") in ("paragraph", "heading", "listItem", "blockquote", "codeBlock"):
                stack.append("\n")
            if n.get("type") == "hardBreak":
                out.append("\n")
            stack.append(n.get("content") or [])
    return "".join(out)


class Automaton:
    """States of a node: ``null``, ``scalar``, ``text``, ``person``, ``rich``, ``comment:<variant>``, ``comments``, ``thread`` (a Jira comment holder), ``ticket:<variant>``, ``batch`` (something that holds tickets), ``other``."""

    def __init__(self) -> None:
        self.states: dict[int, str] = {}

    def state(self, root: Any) -> str:
        """Assigns a state to every node, children first, without recursion."""
        todo = [(root, False)]
        while todo:
            node, ready = todo.pop()
            if isinstance(node, (dict, list)) and not ready:
                todo.append((node, True))
                todo.extend((child, False) for child in (node.values() if isinstance(node, dict) else node) if isinstance(child, (dict, list)))
            elif ready:
                self.states[id(node)] = self._of_object(node) if isinstance(node, dict) else self._of_list(node)
        return self.of(root)

    def of(self, node: Any) -> str:
        if isinstance(node, (dict, list)):
            return self.states[id(node)]
        return "null" if node is None else "text" if isinstance(node, str) else "scalar"

    def _of_list(self, node: list) -> str:
        kinds = {self.of(x).split(":")[0] for x in node} - {"null"}
        if kinds == {"comment"}:
            return "comments"
        if kinds & {"ticket", "batch"}:
            return "batch"
        return "other" if kinds else "comments"

    def _of_object(self, node: dict) -> str:
        child = {k: self.of(v) for k, v in node.items()}
        kinds = {s.split(":")[0] for s in child.values()}
        if "body" in node and not {"subject", "fields"} & node.keys():
            author = {"text": "plain", "person": "person", "null": "anonymous"}.get(child.get("author", "null"), "odd")
            return f"comment:{'rich' if child['body'] in ('rich', 'other') else 'plain'}_{author}{'_thread' if 'replies' in node else ''}"
        if isinstance(node.get("fields"), dict) and ("key" in node or "id" in node):
            return "ticket:fields"
        if any(isinstance(node.get(k), (str, int)) for k in ("ticket_id", "id")) and {"subject", "description", "comments", "resolution"} & node.keys():
            return "ticket:flat_v2" if "ticket_id" in node else "ticket:flat_v1"
        if kinds & {"ticket", "batch"}:
            return "batch"
        if node.keys() & {"type"} and ("content" in node or "text" in node):
            return "rich"
        if any(isinstance(node.get(k), str) for k in AUTHOR_LABELS):
            return "person"
        if isinstance(node.get("comments"), (list, dict)):
            return "thread"
        return "other"


def _author(node: dict) -> str:
    """The display name as written; Unknown where there is none."""
    a = node.get("author")
    if isinstance(a, dict):
        a = next((a[k] for k in AUTHOR_LABELS if isinstance(a.get(k), str) and a[k].strip()), None)
    return a if isinstance(a, str) and a.strip() else "Unknown"


def _text(value: Any) -> str | None:
    if isinstance(value, dict):
        value = next((value[k] for k in ("name", "displayName") if isinstance(value.get(k), str)), None)
    return None if value is None else value if isinstance(value, str) else str(value)


def _listed(value: Any) -> list:
    """A lone object counts as a list of one."""
    if isinstance(value, dict):
        if "body" not in value and "comments" in value:
            return _listed(value["comments"])
        return [value] if value else []
    return value if isinstance(value, list) else []


def flatten(payload: str | None) -> Iterator[dict]:
    """The ticket and comment nodes of one payload. Comments with blank bodies are nodes too; other notes aren't."""
    root = decoded(payload)
    if not isinstance(root, (dict, list)):
        return
    automaton = Automaton()
    automaton.state(root)
    pos = -1
    todo: list[Any] = [root]
    while todo:
        node = todo.pop()
        state = automaton.of(node)
        if not state.startswith("ticket:"):
            children = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
            todo.extend(x for x in reversed(children) if isinstance(x, (dict, list)) and automaton.of(x).split(":")[0] in ("ticket", "batch"))
            continue
        pos += 1
        fields = node["fields"] if state == "ticket:fields" else node
        ticket_id = next((str(node[k]) for k in TICKET_IDS if node.get(k) is not None), None)
        yield {
            "node_kind": "ticket", "variant": state.split(":")[1], "ticket_pos": pos, "ticket_id": ticket_id, "body": rich_text(fields.get("description")) if fields.get("description") is not None else None,
            "created_at": _text(next((fields[k] for k in TIME_LABELS if fields.get(k) is not None), None)), "subject": _text(fields.get("subject", fields.get("summary"))), "status": _text(fields.get("status")),
            "priority": _text(fields.get("priority")), "assignee": _text(fields.get("assignee")),
        }
        threads = [(x, str(i), "") for i, x in enumerate(_listed(fields.get("comments", fields.get("comment"))))]
        threads.reverse()
        while threads:
            c, path, parent = threads.pop()
            if not isinstance(c, dict):
                continue
            variant = automaton.of(c)
            yield {
                "node_kind": "comment", "variant": variant.split(":")[1] if variant.startswith("comment:") else "bodiless", "ticket_pos": pos, "ticket_id": ticket_id, "comment_path": path, "parent_path": parent, "author": _author(c),
                "body": rich_text(c["body"]) if c.get("body") is not None else None, "created_at": _text(next((c[k] for k in TIME_LABELS if c.get(k) is not None), None)),
            }
            threads.extend((x, f"{path}.{i}", path) for i, x in reversed(list(enumerate(_listed(c.get("replies"))))))


def nodes(raw: DataFrame) -> DataFrame:
    """All nodes of ``raw`` (raw_id, customer_slug, source_system, payload), with the variant each was routed to.

    A payload that is null, empty, cut off or no JSON gives no row. Each raw_id counts by itself, so a record delivered twice gives its
    nodes twice. One pass without a shuffle; a payload is read whole, whatever its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in NODES_SCHEMA.split(", ")]
        for batch in batches:
            found = [
                (raw_id, slug, system, *(n.get(c) for c in columns[3:]))
                for raw_id, slug, system, payload in zip(batch.raw_id, batch.customer_slug, batch.source_system, batch.payload, strict=True)
                for n in flatten(payload)
            ]
            yield pd.DataFrame(found, columns=columns, dtype=object)

    return raw.select("raw_id", "customer_slug", "source_system", "payload").mapInPandas(run, NODES_SCHEMA)


def ticket_table(found: DataFrame) -> DataFrame:
    """The supertype table of tickets: keys, common fields and the variant."""
    return found.filter("node_kind = 'ticket'").select("raw_id", "customer_slug", "source_system", "variant", "ticket_pos", "ticket_id", "subject", F.col("body").alias("description"), "status", "priority", "assignee", "created_at")


def comment_table(found: DataFrame) -> DataFrame:
    """The supertype table of comments: the ticket's key (raw_id, ticket_pos), its own path and that of its parent."""
    return found.filter("node_kind = 'comment'").select("raw_id", "ticket_pos", "ticket_id", "comment_path", "parent_path", "variant", "author", "body", "created_at")


def variant_table(found: DataFrame, variant: str) -> DataFrame:
    """The subtype table of one structural variant."""
    return found.filter(F.col("variant") == variant)


def said(body: str = "body") -> F.Column:  # type: ignore[name-defined]
    """Whether a body has text other than white space."""
    return F.coalesce(F.col(body), F.lit("")).rlike(r"[^\s  -​  　﻿]")
