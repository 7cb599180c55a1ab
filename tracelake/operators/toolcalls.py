"""Tool calls in bodies and stream events of the three protocols, as column expressions.

The shape of a body tells its protocol: ``choices`` is a chat, a ``response.`` event or ``output`` is a
response, anything else is read as messages with content blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scan import let, none
from .traffic import may_differ

#: Marks in the type of a stream event, or of an item, and the tool that they stand for, in order.
EVENT_TOOLS = (
    ("code_interpreter_call_code", "code_interpreter"), ("shell_call_command", "shell"), ("mcp_call_arguments", "mcp"),
    ("custom_tool_call_input", "custom_tool"), ("computer", "computer"),
)
ITEM_TOOLS = (("code_interpreter", "code_interpreter"), ("shell", "shell"), ("mcp", "mcp"), ("computer", "computer"), ("custom_tool", "custom_tool"))
RETRIEVAL_TOOLS = (("file_search", "file_search"), ("web_search", "web_search"))

#: Words of which a body that holds a call has one, as a name or in its type.
WORDS = ("tool", "function", "custom", "name", "partial_json", "input", "output_item", '"output"', *(mark for mark, _ in EVENT_TOOLS + RETRIEVAL_TOOLS))

CALL = "struct<index:bigint,id:string,name:string,args:string,id_synth:boolean>"
_OWN = "id string, call_id string, tool_call_id string, name string, tool_name string, function struct<name:string>, arguments string, input string, args string"
_SAID = "struct<tool_calls:array<struct<index:bigint,id:string,function:struct<name:string,arguments:string>,custom:struct<name:string,input:string>>>,function_call:string,custom_tool_call:string>"
_BLOCK = "type string, id string, index bigint, name string, input string, partial_json string, arguments string, function_call string, custom_tool_call string"
_ITEM = f"type string, index bigint, output_index bigint, code string, command string, action string, query string, queries string, delta string, item_id string, custom_tool_call string, {_OWN}"
_BODY = f"type string, index bigint, choices array<struct<index:bigint,delta:{_SAID},message:{_SAID}>>, content_block string, delta string, content string, message string, item string, output string"


def _each(json: Column, fields: str) -> Column:
    """An array of structs from a JSON array or a single object; empty for anything else."""
    found = F.from_json(json, "array<struct<" + ",".join(f"{a}:{b}" for a, b in (f.split(" ", 1) for f in fields.split(", "))) + ">>")
    return F.when(json.rlike(r"^\s*[\[{]"), F.coalesce(found, none(_struct(fields)))).otherwise(none(_struct(fields)))


def _struct(fields: str) -> str:
    return "struct<" + ",".join(f"{a}:{b}" for a, b in (f.split(" ", 1) for f in fields.split(", "))) + ">"


def _by_mark(kind: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    return F.coalesce(*[F.when(kind.contains(mark), F.lit(tool)) for mark, tool in marks])


def _call(index: Column, given: Column, name: Column, args: Column) -> Column:
    number, blank = index.cast("bigint"), F.coalesce(given == "", F.lit(True))
    return F.struct(
        number.alias("index"), F.when(blank, F.concat(F.lit("call_stable_"), number.cast("string"))).otherwise(given).alias("id"), name.alias("name"),
        F.coalesce(args, F.lit("")).alias("args"), blank.alias("id_synth"),
    )


def _if(condition: Column, call: Column) -> Column:
    """An array with the call, or an empty one."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(call)).otherwise(none(CALL))


def bucket(choice: Column, index: Column) -> Column:
    """One number for a tool index within a choice."""
    return F.shiftleft(choice, 16) + index


def _custom(index: Column, o: Column) -> Column:
    given, name = F.coalesce(o["id"], o["call_id"], o["tool_call_id"]), F.coalesce(o["name"], o["tool_name"], o["function"]["name"])
    args = F.coalesce(o["arguments"], o["input"], o["args"])
    return _if(name.isNotNull() | (args != "") | (given != ""), _call(index, given, name, args))


def _searched(o: Column) -> Column:
    """What a search asks for."""
    action = lambda key: F.get_json_object(o["action"], f"$.{key}")
    return F.coalesce(o["arguments"], o["input"], o["args"], action("query"), action("queries"), o["queries"], o["query"])


def _flat(items: Column, calls: Callable[[Column, Column], Column]) -> Column:
    return F.flatten(F.transform(items, calls))


def _chat(b: Column) -> Column:
    def said(s: Column, choice: Column) -> Column:
        listed = F.transform(
            F.coalesce(s["tool_calls"], F.array()),
            lambda t, i: _call(
                bucket(choice, F.coalesce(t["index"], i.cast("bigint"))), t["id"], F.coalesce(t["function"]["name"], t["custom"]["name"]), F.coalesce(t["function"]["arguments"], t["custom"]["input"])
            ),
        )
        old = F.transform(_each(s["function_call"], "name string, arguments string"), lambda f, i: _call(bucket(choice, i.cast("bigint")), F.lit(None).cast("string"), f["name"], f["arguments"]))
        return F.concat(listed, old, _flat(_each(s["custom_tool_call"], _OWN), lambda o, i: _custom(bucket(choice, i.cast("bigint")), o)))

    def choice(c: Column, i: Column) -> Column:
        return let(F.coalesce(c["index"], i.cast("bigint")), lambda n: F.concat(*[F.when(c[k].isNotNull(), said(c[k], n)).otherwise(none(CALL)) for k in ("delta", "message")]))

    return _flat(b["choices"], choice)


def _messages(b: Column) -> Column:
    def block(x: Column, i: Column) -> Column:
        at = F.coalesce(b["index"], x["index"], i.cast("bigint"))
        filled = F.when(~F.coalesce(x["input"], F.lit("")).isin("", "{}", "[]"), x["input"])
        args = F.coalesce(x["partial_json"], filled, x["arguments"])
        tool = x["type"].rlike("tool_use|function|custom") | x["name"].isNotNull() | x["partial_json"].isNotNull() | x["input"].isNotNull()
        some = x["name"].isNotNull() | (args != "") | x["id"].isNotNull()
        old = F.transform(_each(x["function_call"], "name string, arguments string"), lambda f: _call(at, F.lit(None).cast("string"), f["name"], f["arguments"]))
        custom = _flat(_each(x["custom_tool_call"], _OWN), lambda o, j: _custom(F.when(x["custom_tool_call"].rlike(r"^\s*\["), j.cast("bigint")).otherwise(at), o))
        return F.when(F.size(old) > 0, old).when(F.size(custom) > 0, custom).otherwise(_if(F.coalesce(tool, F.lit(False)) & some, _call(at, x["id"], x["name"], args)))

    blocks = F.concat(*[_each(j, _BLOCK) for j in (b["content_block"], b["delta"], b["content"], F.get_json_object(b["message"], "$.content"))])
    return _flat(blocks, block)


def _responses(b: Column, body: Column) -> Column:
    kind = F.coalesce(b["type"], F.lit(""))
    given = lambda o: F.coalesce(o["arguments"], o["code"], o["command"], o["input"])
    at = lambda o: F.coalesce(o["output_index"], F.lit(0).cast("bigint"))

    def event(e: Column) -> Column:
        tool = F.coalesce(e["name"], _by_mark(kind, EVENT_TOOLS))
        args = F.when(kind.endswith(".delta"), e["delta"]).when(kind.endswith(".done"), given(e))
        streamed = _if((kind.endswith(".delta") | kind.endswith(".done")) & (tool.isNotNull() | (args != "")), _call(at(e), F.coalesce(e["item_id"], e["id"]), tool, args))
        search = F.array(_call(F.coalesce(e["output_index"], e["index"], F.lit(0)), F.coalesce(e["item_id"], e["id"]), F.coalesce(e["name"], _by_mark(kind, RETRIEVAL_TOOLS)), F.coalesce(_searched(e), e["delta"])))
        items = _each(b["item"], _ITEM)
        return (
            F.when(kind.contains("function_call_arguments") | _by_mark(kind, EVENT_TOOLS).isNotNull(), streamed)
            .when(_by_mark(kind, RETRIEVAL_TOOLS).isNotNull(), search)
            .when(kind == "response.output_item.done", _flat(items, lambda o, i: _item(at(e), o)))
            .when(kind == "response.output_item.added", _flat(items, lambda o, i: _opened(at(e), o)))
            .otherwise(none(CALL))
        )

    def _item(index: Column, o: Column) -> Column:
        named = F.coalesce(o["name"], _by_mark(o["type"], ITEM_TOOLS), _by_mark(o["type"], RETRIEVAL_TOOLS))
        args = F.coalesce(given(o), _searched(o), o["action"])
        tool = o["type"].rlike("function_call|tool") | named.isNotNull() | given(o).isNotNull()
        inner = _flat(_each(o["custom_tool_call"], _OWN), lambda c, i: _custom(index, c))
        return F.when(F.size(inner) > 0, inner).otherwise(_if(F.coalesce(tool, F.lit(False)) & (named.isNotNull() | (args != "")), _call(index, F.coalesce(o["call_id"], o["id"]), named, args)))

    def _opened(index: Column, o: Column) -> Column:
        named = F.coalesce(o["name"], _by_mark(o["type"], RETRIEVAL_TOOLS))
        return _if(o["type"].rlike("function_call|custom_tool_call|tool") | named.isNotNull(), _call(index, F.coalesce(o["id"], o["call_id"]), named, F.lit("")))

    whole = _flat(_each(b["output"], _ITEM), lambda o, i: _item(F.coalesce(o["output_index"], o["index"], i.cast("bigint")), o))
    return F.when(b["output"].isNotNull(), whole).otherwise(let(F.from_json(body, _ITEM), event))


def tool_calls(body: Column) -> Column:
    """(index, id, name, args, id_synth) of every tool call in a body or event, in order; null for a null."""

    def found(b: Column) -> Column:
        response = b["type"].startswith("response.") | b["output"].isNotNull()
        calls = F.when(b["choices"].isNotNull(), _chat(b)).when(response, _responses(b, body)).otherwise(_messages(b))
        return F.coalesce(calls, none(CALL))

    possible = reduce(lambda a, b: a | b, [may_differ(body), *(body.contains(w) for w in WORDS)])
    return F.when(possible, let(F.from_json(body, _BODY), found)).when(body.isNotNull(), none(CALL))


def blocked_call(calls: Column, reason: Callable[[Column, Column], Column]) -> Column:
    """(index, reason) of the first call that has a reason; null if none has."""
    judged = F.transform(calls, lambda c: F.struct(c["index"].alias("index"), reason(c["name"], c["args"]).alias("reason")))
    return F.get(F.filter(judged, lambda j: j["reason"].isNotNull()), 0)


__all__ = ["CALL", "blocked_call", "bucket", "tool_calls"]
