"""Spans of a JSON text: where each key and value stands, so that an edit leaves all else byte for byte.

The index is built in one linear pass without recursion; a text that is not one JSON value has none.
Column functions on top of it run over Arrow slices.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

BOM = "﻿"
#: Depth of JSON texts inside JSON strings, and longest text of a summary in bytes.
DEPTH, SUMMARY_BYTES = 5, 8_192
#: Bytes of texts that a task holds as Python strings at a time.
SLICE = 1 << 20
#: Sampling parameters that a summary shows.
SAMPLING = ("temperature", "top_p", "top_k", "max_tokens", "max_output_tokens", "stop", "seed", "n")
#: Members that describe a frame; their strings are no text of the stream.
ENVELOPE = frozenset(
    "id object created created_at model index role usage finish_reason type status item_id call_id tool_call_id tool_use_id stop_reason stop_sequence sequence_number output_index content_index".split()
)
_TOKEN = re.compile(
    r'[ \t\r\n]*+(?:(?P<s>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<n>-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?)|(?P<l>true|false|null)|(?P<p>[{}\[\],:]))'
)


class Node(NamedTuple):
    """One value: its kind (object, array, string, number or literal) and where it stands."""

    kind: str
    start: int
    end: int
    parent: int  # place in the index, -1 at the top
    key: str | None  # decoded name of a member
    key_start: int  # of the name's quote, -1 without one
    pos: int  # among its siblings


class Index(NamedTuple):
    """All values of a JSON text in the order in which they begin, and the places of each one's own."""

    nodes: list[Node]
    below: list[list[int]]

    def member(self, of: int, name: str) -> int | None:
        """The member of an object by name; of doubled ones the last."""
        return next((i for i in reversed(self.below[of]) if self.nodes[i].key == name), None)


def index(text: str) -> Index | None:
    """The index of a text; None if it is not exactly one JSON value."""
    nodes: list[list] = []
    below: list[list[int]] = []
    opened: list[list] = []  # [place, is object, members so far]
    want, key, key_start = "value", None, -1
    at = len(text) - len(text.lstrip(BOM))
    while want != "end" or text[at:].strip(" \t\r\n"):
        m = _TOKEN.match(text, at)
        if not m or want == "end":
            return None
        at, kind, sign = m.end(), m.lastgroup, m[0][-1]
        if kind == "p" and sign in "}]":
            if not opened or opened[-1][1] != (sign == "}") or want not in ("comma", "first"):
                return None
            nodes[opened.pop()[0]][2] = at
            want = "comma" if opened else "end"
        elif kind == "p" and sign == ",":
            if want != "comma":
                return None
            want = "key" if opened[-1][1] else "value"
        elif kind == "p" and sign == ":":
            if want != "colon":
                return None
            want = "value"
        elif opened and opened[-1][1] and want in ("key", "first"):
            if kind != "s":
                return None
            key, key_start, want = json.loads(m["s"]), m.start("s"), "colon"
        elif want in ("value", "first"):
            name = {"s": "string", "n": "number", "l": "literal"}.get(kind) or ("object" if sign == "{" else "array")
            parent, pos = (opened[-1][0], opened[-1][2]) if opened else (-1, 0)
            if opened:
                opened[-1][2] += 1
                below[parent].append(len(nodes))
            nodes.append([name, m.start(kind), at, parent, key, key_start, pos])
            below.append([])
            key, key_start = None, -1
            if kind == "p":
                opened.append([len(nodes) - 1, sign == "{", 0])
                want = "first"
            else:
                want = "comma" if opened else "end"
        else:
            return None
    return Index([Node(*n) for n in nodes], below)


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with spans that do not overlap replaced."""
    out, done = [], 0
    for start, end, new in sorted(edits):
        out += [text[done:start], new]
        done = end
    return "".join(out) + text[done:]


def quoted(text: str) -> str:
    """A text as JSON; one with halves of surrogate pairs in ASCII."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return json.dumps(text)
    return json.dumps(text, ensure_ascii=False)


def appended(found: Index, of: int, new: str) -> tuple[int, int, str]:
    """The edit that puts a member or element after the others."""
    own = found.below[of]
    at = found.nodes[own[-1]].end if own else found.nodes[of].start + 1
    return at, at, "," + new if own else new


def prepended(found: Index, of: int, new: str) -> tuple[int, int, str]:
    """The edit that puts a member or element before the others."""
    at = found.nodes[of].start + 1
    return at, at, new + "," if found.below[of] else new


def rewritten(text: str, leaf: Callable[[str], str], depth: int = DEPTH, whole: Index | None = None) -> str:
    """A text with ``leaf`` applied to each string and name of the JSON that it is, or to itself.

    JSON texts of any size are entered, inside strings to ``depth``; names that would clash keep their
    spelling; only strings that change are written anew.  ``whole`` is the text's index, where there is one already.
    """
    found = whole or index(text) if text.lstrip(BOM + " \t\r\n")[:1] in ("{", "[") else None
    if found is None:
        return leaf(text)
    edits, names = [], {}
    for n in found.nodes:
        if n.kind == "string":
            own = json.loads(text[n.start : n.end])
            new = rewritten(own, leaf, depth - 1) if depth > 0 else leaf(own)
            if new != own:
                edits.append((n.start, n.end, quoted(new)))
        if n.key is not None:
            names.setdefault(n.parent, []).append((leaf(n.key), n))
    for group in names.values():
        made = Counter(new for new, _ in group)
        kept = {n.key for _, n in group}
        for new, n in group:
            if new != n.key and made[new] == 1 and new not in kept:
                end = _TOKEN.match(text, n.key_start).end()
                edits.append((n.key_start, end, quoted(new)))
    return edited(text, edits)


def isomorphic(given: str, made: str, depth: int = DEPTH, whole: Index | None = None) -> bool:
    """Whether ``made`` has the structure of ``given``: the same values and nesting, and JSON inside strings where there was some.

    Texts of strings, numbers and names may differ.  A text that was no JSON has no structure to keep.
    ``whole`` is the given text's index, where there is one already.
    """
    a = whole or index(given) if given.lstrip(BOM + " \t\r\n")[:1] in ("{", "[") else None
    if a is None:
        return True
    b = index(made)
    if b is None or a.below != b.below or any(x.kind != y.kind for x, y in zip(a.nodes, b.nodes)):
        return False
    inner = ((json.loads(given[x.start : x.end]), json.loads(made[y.start : y.end])) for x, y in zip(a.nodes, b.nodes) if x.kind == "string")
    return depth == 0 or all(isomorphic(x, y, depth - 1) for x, y in inner)


def _scalars(found: Index, text: str, of: int) -> dict[str, str]:
    """Texts and numbers among the members of an object, as text."""
    own = (found.nodes[i] for i in found.below[of])
    return {n.key: json.loads(text[n.start : n.end]) if n.kind == "string" else text[n.start : n.end] for n in own if n.kind in ("string", "number")}


def string_paths(text: str, whole: Index | None = None) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, path) of the strings of a frame that are text of the stream, without their quotes.

    A path has names, and marks that tell values of parallel calls and blocks apart: t= type, i= o= s=
    c= indexes, m= the id of an item or call, # the place where an element has neither.  Under doubled
    names a path is the name alone.  ``whole`` is the text's index, where there is one already.
    """
    whole = whole or index(text)
    if whole is None:
        return []
    nodes = whole.nodes
    members = [(n.parent, n.key) for n in nodes if n.key is not None]
    plain = len(members) != len(set(members))
    paths: list[tuple[str, ...]] = []
    names: list[str | None] = []  # of the member that holds the value, through arrays
    found = []
    for i, n in enumerate(nodes):
        above = paths[n.parent] if n.parent >= 0 else ()
        inside = n.parent >= 0 and nodes[n.parent].kind == "array"
        name = n.key if n.key is not None else names[n.parent] if inside else None
        own = (*above, n.key) if n.key is not None else above
        marks = _scalars(whole, text, i) if n.kind == "object" else {}
        if inside:
            held = next((f"{t}={marks[k]}" for k, t in (("index", "i"), ("item_id", "m"), ("call_id", "m"), ("tool_call_id", "m"), ("id", "m")) if k in marks), f"#{n.pos}")
            own = (*own, held)
        elif n.kind == "object":
            tags = (("type", "t"), ("index", "i"), ("output_index", "o"), ("summary_index", "s"), ("content_index", "c"), ("item_id", "m"), ("call_id", "m"), ("tool_call_id", "m"))
            own = (*own, *(f"{t}={marks[k]}" for k, t in tags if k in marks))
        paths.append(own)
        names.append(name)
        if n.kind == "string" and name not in ENVELOPE:
            found.append((n.start + 1, n.end - 1, (() if name is None else (name,)) if plain else own))
    return found


def _slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The columns cut to about ``SLICE`` bytes of the first; a larger text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low, done = 0, 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield tuple(c.slice(low, high - low) for c in columns)
        low, done = high, int(ends[high - 1])


def as_column(kind: str, edit: Callable[..., object]) -> Callable[..., Column]:
    """``edit`` over texts as a column function; nulls stay null.  A slice at a time is held as Python strings."""

    def make(*columns: Column) -> Column:
        arrow = to_arrow_type(DataType.fromDDL(kind))

        @F.arrow_udf(kind)
        def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for given in batches:
                for own in _slices(given if isinstance(given, tuple) else (given,)):
                    yield pa.array([None if t is None else edit(t, *r) for t, *r in zip(*(c.to_pylist() for c in own))], arrow)

        return run(*columns)

    return make


def put_usage_option(body: str) -> str:
    """A body with ``stream_options.include_usage`` wherever it says nothing about it; a ``null`` is left, anything malformed replaced."""
    found = index(body)
    if not found or found.nodes[0].kind != "object":
        return body
    options = found.member(0, "stream_options")
    if options is None:
        return edited(body, [appended(found, 0, '"stream_options":{"include_usage":true}')])
    n = found.nodes[options]
    if n.kind == "object":
        return body if found.member(options, "include_usage") is not None else edited(body, [prepended(found, options, '"include_usage":true')])
    return body if body[n.start : n.end] == "null" else edited(body, [(n.start, n.end, '{"include_usage":true}')])


def usage_option(body: str, protocol: str | None = "chat") -> str:
    """The same for a chat that asks for a stream; any other body stays as it is."""
    found = index(body) if protocol == "chat" else None
    stream = found.member(0, "stream") if found and found.nodes[0].kind == "object" else None
    if stream is None or body[found.nodes[stream].start : found.nodes[stream].end] != "true":
        return body
    return put_usage_option(body)


def _says(body: str, found: Index, at: int, note: str) -> bool:
    """Whether a string, or the content or text of an element, holds the note."""
    n = found.nodes[at]
    if n.kind == "string":
        return note in json.loads(body[n.start : n.end])
    own = [c for c in found.below[at] if found.nodes[c].kind == "object"] if n.kind == "array" else []
    return any(_says(body, found, i, note) for c in own for k in ("content", "text") if (i := found.member(c, k)) is not None)


def noted(body: str, note: str, protocol: str | None = "chat") -> str:
    """A body with a note for the model, once: in the first system message of a chat or of a response's
    ``input`` and ``instructions``, at the end of the ``system`` of messages.  What does not fit stays as it is.
    """
    found = index(body) if note else None
    if not found or found.nodes[0].kind != "object":
        return body
    nodes, block = found.nodes, '{"type":"text","text":' + quoted(note) + "}"

    def at_end(at: int) -> list[tuple[int, int, str]]:
        n = nodes[at]
        if n.kind == "array":
            return [appended(found, at, block)]
        own = json.loads(body[n.start : n.end]) if n.kind == "string" else ""
        return [(n.start, n.end, quoted(f"{own}\n\n{note}" if own else note))]

    def in_messages(at: int) -> list[tuple[int, int, str]]:
        first = next((c for c in found.below[at] if nodes[c].kind == "object" and nodes[c].pos == 0), None)
        role = found.member(first, "role") if first is not None else None
        if role is None or body[nodes[role].start : nodes[role].end] != '"system"':
            return [prepended(found, at, '{"role":"system","content":' + quoted(note) + "}")]
        content = found.member(first, "content")
        if content is None:
            return [appended(found, first, '"content":' + quoted(note))]
        return [] if _says(body, found, content, note) else at_end(content)

    def in_field(at: int) -> list[tuple[int, int, str]]:
        if nodes[at].kind not in ("string", "array") or _says(body, found, at, note):
            return []
        return at_end(at) if nodes[at].kind == "string" or protocol == "anthropic" else in_messages(at)

    if protocol == "chat":
        at = found.member(0, "messages")
        return body if at is None or nodes[at].kind != "array" else edited(body, in_messages(at))
    if protocol == "anthropic":
        at = found.member(0, "system")
        return edited(body, [appended(found, 0, '"system":' + quoted(note))] if at is None else in_field(at))
    if protocol == "responses":
        return edited(body, [e for k in ("input", "instructions") if (at := found.member(0, k)) is not None for e in in_field(at)])
    return body


def summary_json(body: str) -> str | None:
    """Model, sampling parameters and texts of a request as one JSON object; null if there is none of them.

    Texts are the ``content`` and ``text`` of messages, ``system`` and ``input``, to 8 KiB.
    """
    found = index(body)
    if not found or found.nodes[0].kind != "object":
        return None
    nodes = found.nodes
    parts = [(k, body[nodes[i].start : nodes[i].end]) for k in ("model", *SAMPLING) if (i := found.member(0, k)) is not None]
    texts: list[bytes] = []
    room = SUMMARY_BYTES
    waiting = [at for key in ("input", "system", "messages") if (at := found.member(0, key)) is not None]
    while waiting and room > 0:
        at = waiting.pop()
        n = nodes[at]
        if n.kind == "string" and (own := json.loads(body[n.start : n.end]).encode(errors="replace")[: room - bool(texts)]):
            room -= len(own) + bool(texts)
            texts.append(own)
        elif n.kind == "array":
            waiting += reversed(found.below[at])
        elif n.kind == "object":
            waiting += [c for c in (found.member(at, "text"), found.member(at, "content")) if c is not None]
    if texts:
        parts.append(("text", quoted("\n".join(t.decode(errors="ignore") for t in texts))))
    return "{" + ",".join(f"{quoted(k)}:{v}" for k, v in parts) + "}" if parts else None


def edited_twice(body: str, protocol: str | None, note: str) -> dict[str, object]:
    """The body with its usage option and note, with both again, and whether that keeps its structure."""
    once = noted(usage_option(body, protocol), note, protocol)
    again = noted(usage_option(once, protocol), note, protocol)
    return {"body": once, "again": again, "same": isomorphic(once, again)}


with_put_usage_option = as_column("string", put_usage_option)
with_usage_option = as_column("string", usage_option)
request_summary = as_column("string", summary_json)
keeps_structure = as_column("boolean", lambda given, made: made is not None and isomorphic(given, made))
#: One pass, and so one Python worker a task, for what would take five.
with_edits_twice = as_column("struct<body:string,again:string,same:boolean>", edited_twice)


def with_note(body: Column, note: str, protocol: Column) -> Column:
    """``noted`` for each body by its protocol."""
    return as_column("string", noted)(body, F.lit(note), protocol)
