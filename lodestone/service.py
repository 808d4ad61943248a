"""One corpus, kept open: every question a user can ask of it, as plain dicts.

The command line, the prompt and the line protocol (JSON-RPC 2.0, one message a line) all go
through Service.  A service started with `warm` makes missing vectors in a thread of its own;
until they are there, answers use those that are and say so.
"""

from __future__ import annotations

import json
import sys
import threading
import time
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import __version__
from lodestone.operators import ask, graph, paths, search, symbols
from lodestone.operators.providers import Provider, ProviderError
from lodestone.sources import lake

MOST_LINE = 16 << 20
PROTOCOL = "2024-11-05"
HITS, CLUES = search.DEFAULT_LIMIT, search.CLUES_LIMIT


class Unknown(Exception):
    """A question about something that isn't there, with what may have been meant."""


class Service:
    def __init__(self, spark: SparkSession, root: str, folder: str | None = None, provider: Provider | None = None, warm: bool = False, fresh: bool = False):
        self.spark, self.root = spark, root
        self.folder = folder or lake.directory(root)
        self.provider = provider or Provider()
        self.lock = threading.Lock()
        self.trouble: str | None = None
        self.snapshot = lake.build(spark, root, self.folder, provider=self.provider) if fresh else lake.open_or_build(spark, root, self.folder, self.provider)
        self.thread = threading.Thread(target=self.embed, daemon=True) if warm else None
        if self.thread:
            self.thread.start()

    def embed(self) -> None:
        """Makes the vectors that are missing; what goes wrong is kept for `status`."""
        try:
            made = lake.ensure(self.snapshot, self.provider)
        except Exception as e:  # a service may fail in any way, and questions go on without it
            self.trouble = str(e)
            return
        with self.lock:
            self.snapshot = made

    def refresh(self) -> int:
        with self.lock:
            self.snapshot, n = lake.refresh(self.snapshot, self.root)
        return n

    def code(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Symbols, call edges and import edges of the snapshot."""
        files = self.snapshot.table("files")
        lines = symbols.source_lines(files)
        syms = graph.symbols(symbols.definitions(lines), self.snapshot.table("blocks"))
        calls = graph.call_edges(symbols.call_tokens(lines), syms)
        return syms, calls, graph.import_edges(graph.resolve(symbols.imports(lines), files.select("file_id", "rel")))

    def search(self, query: str, limit: int = HITS) -> dict:
        hits = search.search(self.snapshot.table("blocks"), query, min(limit, search.MOST_LIMIT))
        rows = [r.asDict() for r in hits.select("block_id", "rel", "line", "occurrences", "text").collect()]
        return {"query": query, "count": len(rows), "hits": rows}

    def ask(self, query: str, limit: int = 20) -> dict:
        held = self.snapshot.table("vectors")
        if self.snapshot.manifest["provider"] != self.provider.identity:
            held = held.limit(0)
        return ask.ask_fast(self.snapshot.table("blocks"), held, self.provider, query, limit).envelope()

    def graph(self, symbol: str) -> dict:
        syms, calls, imports = self.code()
        found = [r.asDict() for r in graph.neighbourhood(syms, calls, imports, symbol).collect()]
        if not found:
            raise Unknown(self._meant(syms, symbol))
        return {"symbol": symbol, "count": len(found), "nodes": found}

    def flow(self, source: str, target: str, depth: int = paths.MOST_NODES, blocks: bool = True) -> dict:
        syms, calls, _ = self.code()
        ends = []
        for name in (source, target):
            ends.append(graph.find_symbol(syms, name).select(F.col("sym_id").alias("node")))
            if ends[-1].isEmpty():
                raise Unknown(self._meant(syms, name))
        found = paths.find_paths(calls, *ends, max(2, min(depth, 32)), paths.MOST_PATHS)
        steps = paths.hops(found, syms, self.snapshot.table("blocks") if blocks else None).orderBy("path_text", "hop")
        return {"from": source, "to": target, "hops": [r.asDict() for r in steps.collect()]}

    def clues(self, term: str, limit: int = CLUES) -> dict:
        syms, calls, _ = self.code()
        hits = search.search(self.snapshot.table("blocks"), term, min(limit, search.MOST_LIMIT))
        rows = [r.asDict() for r in graph.clues(hits, syms, calls).collect()]
        return {"term": term, "count": len(rows), "hits": rows}

    def status(self) -> dict:
        about = lake.stat(self.folder) or {}
        return self.snapshot.manifest | {"snapshot_bytes": about.get("bytes"), "snapshot_age_seconds": about.get("age_seconds"), "trouble": self.trouble}

    @staticmethod
    def _meant(syms: DataFrame, name: str) -> str:
        near = [r[0] for r in graph.suggest(syms, name).collect()]
        return f"no symbol named '{name}'." + (f" did you mean: {', '.join(near)} ?" if near else "")


#: Tools of the line protocol: what each needs, and what else it takes.
TOOLS = {
    "search": (("query",), {"limit": "integer"}), "ask": (("query",), {"limit": "integer"}), "graph": (("symbol",), {}),
    "flow": (("source", "target"), {"depth": "integer", "blocks": "boolean"}), "clues": (("term",), {"limit": "integer"}), "status": ((), {}),
}


def tools() -> list[dict]:
    out = []
    for name, (needs, takes) in TOOLS.items():
        fields = {k: {"type": "string"} for k in needs} | {k: {"type": t} for k, t in takes.items()}
        out.append({"name": name, "inputSchema": {"type": "object", "properties": fields, "required": list(needs)}})
    return out


def call(service: Service, name: str, given: dict) -> dict:
    """A tool's result with how long it took, or an error as a result."""
    began = time.time()
    if name not in TOOLS:
        return {"isError": True, "error": f"unknown tool: {name}"}
    needs, takes = TOOLS[name]
    for k in needs:
        if not isinstance(given.get(k), str) or not given[k]:
            return {"isError": True, "error": f"missing required argument: {k}"}
    kinds = {"integer": int, "boolean": bool}
    extra = {k: given[k] for k, t in takes.items() if isinstance(given.get(k), kinds[t])}
    try:
        out = getattr(service, name)(*[given[k] for k in needs], **extra)
    except (Unknown, ProviderError) as e:
        return {"isError": True, "error": str(e)}
    return {"isError": False, "data": out, "meta": {"duration_ms": round((time.time() - began) * 1000)}}


def messages(source: TextIO) -> Iterator[str | None]:
    """Lines that aren't blank; None for one that is too long to be read whole."""
    while line := source.readline(MOST_LINE + 1):
        if len(line) > MOST_LINE:
            while line and not line.endswith("\n"):
                line = source.readline(MOST_LINE)
            yield None
        elif line.strip():
            yield line


def answer(service: Service, line: str | None) -> dict | None:
    """The reply to a message; None for a notification."""

    def error(code: int, text: str, number=None) -> dict:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}}

    try:
        asked = json.loads(line) if line is not None else None
    except ValueError:
        asked = None
    if asked is None:
        return error(-32700, "parse error")
    if not isinstance(asked, dict) or not isinstance(asked.get("method"), str):
        return error(-32600, "invalid request")
    method, number, given = asked["method"], asked.get("id"), asked.get("params") or {}
    if "id" not in asked:
        return None
    if not isinstance(given, dict):
        return error(-32602, "params must be an object", number)
    if method == "initialize":
        out = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": __version__}}
    elif method == "ping":
        out = {}
    elif method == "tools/list":
        out = {"tools": tools()}
    elif method == "tools/call":
        made = call(service, str(given.get("name")), given.get("arguments") or {})
        text = made["error"] if made["isError"] else json.dumps({"data": made["data"], "meta": made["meta"]}, default=str, ensure_ascii=False)
        out = {"content": [{"type": "text", "text": text}], "isError": made["isError"]}
    else:
        return error(-32601, f"method not found: {method}", number)
    return {"jsonrpc": "2.0", "id": number, "result": out}


def serve(service: Service, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    for line in messages(source):
        if (reply := answer(service, line)) is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()


def prompt(service: Service, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Questions typed one a line: a text to search for, `:ask TEXT`, `:graph NAME`,
    `:flow A B`, `:clues TEXT`, `:status`, `:refresh`, `:quit`."""
    for line in messages(source):
        words = (line or "").split()
        if not words or words[0] in (":quit", ":q"):
            break
        if words[0] == ":refresh":
            sink.write(f"{service.refresh()} files changed\n")
            continue
        name = words[0][1:] if words[0].startswith(":") else "search"
        rest = line.strip().partition(" ")[2].strip() if words[0].startswith(":") else line.strip()
        needs = TOOLS.get(name, ((), {}))[0]
        given = dict(zip(needs, rest.split() if len(needs) > 1 else [rest], strict=False))
        made = call(service, name, given)
        sink.write((made["error"] if made["isError"] else render(made["data"])) + "\n")
        sink.flush()


def render(data: dict, most_lines: int = 6, width: int = 160) -> str:
    """Hits as text: place and the lines that hold the query, with >matches< marked."""
    if "hits" not in data or "query" not in data:
        return json.dumps(data, default=str, ensure_ascii=False, indent=1)
    out = []
    for h in data["hits"]:
        out.append(f"{h['rel']}:{h['line']}  ({h['occurrences']})")
        lines = [(h["line"] + i, x) for i, x in enumerate((h["text"] or "").split("\n"))]
        held = [(n, x) for n, x in lines if data["query"].lower() in x.lower()] or lines
        out += [f"  {n:>5} {marked(x, data['query'])[:width]}" for n, x in held[:most_lines]]
        out += [f"        ... {len(held) - most_lines} more"] if len(held) > most_lines else []
    return "\n".join(out) if out else "nothing found"


def marked(line: str, query: str) -> str:
    data, out, at = line.encode(), b"", 0
    for a, b in search.match_ranges(line, query):
        out, at = out + data[at:a] + b">" + data[a:b] + b"<", b
    return (out + data[at:]).decode("utf-8", "replace")
