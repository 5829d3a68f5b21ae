"""The engine over HTTP and over JSON-RPC on standard input: ``python -m lodestone.server ROOT [--port N]``."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .api import TOOLS, Engine, tools
from .functions.schemas import validate_output


def describe(tool: str) -> dict:
    """A tool's name and the parameters of its method."""
    parameters = [p for p in inspect.signature(getattr(Engine, tool)).parameters.values() if p.name != "self"]
    named = {p.name: {"required": p.default is inspect.Parameter.empty} for p in parameters if p.kind is not inspect.Parameter.VAR_KEYWORD}
    return {"name": tool, "tier": TOOLS[tool], "inputSchema": {"type": "object", "properties": dict.fromkeys(named, {}), "required": [n for n, p in named.items() if p["required"]]}}


def rpc(engine: Engine, request: dict, tier: str = "default") -> dict | None:
    """Answer one JSON-RPC request; a notification has no answer."""
    method, ident, params = request.get("method"), request.get("id"), request.get("params") or {}
    if ident is None:
        return None
    try:
        if method == "initialize":
            result: object = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": [describe(t) for t in tools(tier)]}
        elif method == "tools/call":
            found = engine.call(params["name"], **(params.get("arguments") or {}))
            result = {"content": [{"type": "text", "text": json.dumps(found, default=str)}]}
        else:
            return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": f"unknown method: {method}"}}
    except (ValueError, TypeError, KeyError) as e:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": -32602, "message": str(e)}}
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def answer(engine: Engine, method: str, url: str, body: dict, tier: str = "default") -> tuple[int, object]:
    """Status and content of an HTTP request."""
    at = urlsplit(url)
    asked = {k: v[0] for k, v in parse_qs(at.query).items()}
    match (method, at.path):
        case ("GET", "/health"):
            return 200, {"status": "ok"}
        case ("GET", "/search"):
            if not asked.get("term"):
                return 400, {"error": "term is needed"}
            return 200, engine.search(asked["term"], limit=int(asked["limit"]) if "limit" in asked else None, output="full")
        case ("GET", "/files/recent"):
            return 200, {"results": engine.list_recent_files(int(asked.get("limit", 10)))}
        case ("POST", "/validate-output"):
            return 200, validate_output(body.get("schema") or {}, body.get("output") or "")
        case ("POST", "/mcp"):
            return 200, rpc(engine, body, tier)
        case ("GET", "/openapi.json"):
            paths = {p: {m: {}} for m, p in (("get", "/health"), ("get", "/search"), ("get", "/files/recent"), ("post", "/validate-output"), ("post", "/mcp"))}
            return 200, {"openapi": "3.1.0", "info": {"title": "lodestone", "version": "1"}, "paths": paths}
    return 404, {"error": "not found"}


def serve(engine: Engine, port: int, tier: str) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _run(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                status, found = answer(engine, self.command, self.path, body, tier)
            except ValueError as e:
                status, found = 400, {"error": str(e)}
            content = json.dumps(found, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        do_GET = do_POST = _run  # noqa: N815

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("root")
    parser.add_argument("--port", type=int)
    parser.add_argument("--toolset", default="default")
    a = parser.parse_args(arguments)
    engine = Engine(SparkSession.builder.getOrCreate(), a.root)
    if a.port is not None:
        serve(engine, a.port, a.toolset).serve_forever()
    for line in sys.stdin:
        if line.strip() and (found := rpc(engine, json.loads(line), a.toolset)) is not None:
            print(json.dumps(found), flush=True)


if __name__ == "__main__":
    main()
