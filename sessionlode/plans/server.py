"""The read tools over JSON-RPC 2.0, one message a line, as clients of the Model Context Protocol speak it on standard input."""

from __future__ import annotations

import json

from sessionlode import __version__
from sessionlode.plans.tools import INSTRUCTIONS, Tools

PROTOCOL = "2024-11-05"
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
#: Each tool's purpose, arguments, and those it needs.
TOOLS = {
    "memory_search": ("Find parts of past sessions by words and by meaning.", {"query": _TEXT, "project": _TEXT, "type": _TEXT, "time_from": _NUMBER, "limit": _NUMBER}, ["query"]),
    "memory_read": ("Show the parts around a position of a session.", {"session_id": _TEXT, "position": _NUMBER, "before": _NUMBER, "after": _NUMBER}, ["session_id", "position"]),
    "memory_context": ("Show the parts around a part that a search has found.", {"part_id": _TEXT, "before": _NUMBER, "after": _NUMBER}, ["part_id"]),
    "memory_session": ("Show a session's messages and the types of their parts.", {"session_id": _TEXT}, ["session_id"]),
    "memory_status": ("Tell what the index holds and which sources work.", {}, []),
}


def listed() -> list[dict]:
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]


def answer(tools: Tools, line: str) -> str | None:
    """The reply to one message, or none to a notification. A tool that fails answers with its error, not with a fault of the
    protocol."""
    try:
        message = json.loads(line)
    except ValueError:
        return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}})
    method, params = message.get("method", ""), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        reply["result"] = {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "sessionlode", "version": __version__}, "instructions": INSTRUCTIONS}
    elif method == "ping":
        reply["result"] = {}
    elif method == "tools/list":
        reply["result"] = {"tools": listed()}
    elif method == "tools/call" and params.get("name") in TOOLS:
        try:
            text, failed = tools.call(params["name"], params.get("arguments") or {}), False
        except (ValueError, LookupError) as error:
            text, failed = str(error), True
        reply["result"] = {"content": [{"type": "text", "text": text}], "isError": failed}
    else:
        code, what = (-32602, f"unknown tool {params.get('name')}") if method == "tools/call" else (-32601, f"unknown method {method}")
        reply["error"] = {"code": code, "message": what}
    return json.dumps(reply, ensure_ascii=False)
