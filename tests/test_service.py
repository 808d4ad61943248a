"""Providers, hybrid questions, the line protocol and the prompt, against a local service."""

import io
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lodestone import __main__, service
from lodestone.operators import ask, providers, vectors
from lodestone.sources import lake


class Stub(BaseHTTPRequestHandler):
    """Answers like an embedding service; `broken` names paths that fail."""

    asked: list = []
    broken: set = set()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        path = self.path.rsplit("/", 1)[-1]
        Stub.asked.append((path, body, self.headers.get("Authorization")))
        vector = lambda t: [float(len(t)), float(t.count("e")), 1.0]
        if path in Stub.broken:
            self.send_response(500)
            self.end_headers()
            return
        if path == "embeddings":
            out = {"data": [{"index": i, "embedding": vector(t)} for i, t in reversed(list(enumerate(body["input"])))]}
        elif path == "embed":
            out = {"embeddings": {"float": [vector(t) for t in body["texts"]]}}
        else:
            out = {"results": [{"index": i, "relevance_score": float(i)} for i in range(len(body["documents"]))] + [{"index": 99, "relevance_score": 99.0}]}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def stub():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.asked, Stub.broken = [], set()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_resolution():
    made = lambda env, **o: providers.resolve(providers.Options(**o), env)
    p, notice = made({})
    assert p.identity == "hash:256" and notice
    assert made({"COHERE_API_KEY": "k"})[0].identity == "cohere:embed-v4.0@https://api.cohere.com/v2"
    p, notice = made({}, provider="cohere")
    assert p.kind == "cohere" and p.key == "" and p.batch == 96 and p.rerank_model == "rerank-v3.5" and notice is None
    p, _ = made({"EMBED_PROVIDER": "openai", "OPENAI_API_KEY": "a", "EMBED_API_KEY": "b", "EMBED_BATCH": "7"})
    assert (p.kind, p.key, p.batch, p.rerank_model) == ("http", "b", 7, "") and p.identity.startswith("http:text-embedding-3-small@")
    assert made({"EMBED_DIM": "64"}, provider="hash")[0].identity == "hash:64" and made({"EMBED_DIM": "64"}, provider="hash", dim=32)[0].dim == 32
    assert made({"EMBED_PROVIDER": "cohere", "EMBED_URL": "http://x"}, model="m", url="http://y")[0].identity == "cohere:m@http://y"
    assert providers.of_identity("hash:64").dim == 64 and providers.of_identity("http:m@u") is None


def test_clients(stub):
    for kind, path in (("http", "embeddings"), ("cohere", "embed")):
        p = providers.Provider(kind, stub, "m", "key", 0, 2, "r" if kind == "cohere" else "")
        found = p.embed(["aaa", "e", ""])
        assert len(found) == 3 and all(abs(float((v * v).sum()) - 1) < 1e-6 for v in found) and found[0][0] > found[2][0]
        assert [a[0] for a in Stub.asked[-2:]] == [path, path] and Stub.asked[-1][2] == "Bearer key"
        p.embed_query("q")
        if kind == "cohere":
            assert Stub.asked[-1][1]["input_type"] == "search_query" and Stub.asked[-2][1]["input_type"] == "search_document"
            assert p.scores("q", ["a", "b"])[0] == (99, 99.0)
    Stub.broken = {"embed"}
    with pytest.raises(providers.ProviderError):
        p.embed(["a"])


@pytest.fixture
def corpus(tmp_path):
    root, folder = tmp_path / "src", tmp_path / "lake"
    os.makedirs(root)
    (root / "pay.ts").write_text("import { log } from './log';\n\nexport function openBillingInvoice() {\n  log();\n}\n")
    (root / "log.ts").write_text("export function log() {\n}\n\nconst unrelated = 3;\n")
    return str(root), str(folder)


def test_provider_switch_resets_vectors(spark, corpus, stub):
    root, folder = corpus
    first = lake.open_or_build(spark, root, folder)
    n = first.manifest["vectors"]
    assert n and first.manifest["provider"] == "hash:256" and lake.ensure(first, providers.Provider()) is first
    other = lake.ensure(first, providers.Provider(dim=64))
    assert other.manifest["provider"] == "hash:64" and other.manifest["vectors"] == n and len(other.table("vectors").first()["embedding"]) == 64
    remote = providers.Provider("http", stub, "m", "", 0, 64)
    made = lake.ensure(other, remote)
    assert made.manifest["provider"] == remote.identity and made.manifest["vectors"] == n
    sent = sum(len(a[1]["input"]) for a in Stub.asked)
    assert sent == n and lake.ensure(made, remote) is made and sum(len(a[1]["input"]) for a in Stub.asked) == n
    with open(os.path.join(root, "new.ts"), "w") as f:
        f.write("function fresh() {\n}\n")
    grown, _ = lake.refresh(made, root)
    assert grown.manifest["vectors"] == n and grown.manifest["provider"] == remote.identity
    assert lake.ensure(grown, remote).manifest["vectors"] == n + 1 and sum(len(a[1]["input"]) for a in Stub.asked) == n + 1


def test_questions(spark, corpus, stub):
    root, folder = corpus
    snapshot = lake.open_or_build(spark, root, folder)
    blocks, held = snapshot.table("blocks"), snapshot.table("vectors")
    out = ask.ask_fast(blocks, held, providers.Provider(), "billing invoice", 5).envelope()
    assert out["ranked_by"] == "rrf" and out["coverage"] == 1.0 and out["hits"][0]["rel"] == "pay.ts" and "openBillingInvoice" in out["hits"][0]["text"] and "warming_up" not in out
    cold = ask.ask_fast(blocks, held.limit(0), providers.Provider(), "log", 5).envelope()
    assert cold["warming_up"] and cold["coverage"] == 0.0 and {h["rel"] for h in cold["hits"]} == {"pay.ts", "log.ts"}
    cohere = providers.Provider("cohere", stub, "m", "k", 0, 96, "rerank")
    held = lake.ensure(snapshot, cohere).table("vectors")
    fused = [h["block_id"] for h in ask.ask_fast(blocks, held, providers.Provider("cohere", stub, "m", "k", 0, 96, ""), "log", 4).hits]
    ranked = ask.ask_fast(blocks, held, cohere, "log", 4)
    assert ranked.ranked_by == "rerank" and [h["block_id"] for h in ranked.hits] == fused[::-1][:3] and ranked.hits[0]["score"] == len(fused) - 1
    Stub.broken = {"rerank"}
    assert ask.ask_fast(blocks, held, cohere, "log", 4).ranked_by == "rrf"
    Stub.broken = {"embed"}
    lexical = ask.ask_fast(blocks, held, cohere, "log", 4).envelope()
    assert lexical["ranked_by"] == "lexical" and lexical["warning"] and lexical["count"] and lexical["coverage"] == 0.0
    assert vectors.pool_size(4) == 16


def test_protocol_and_prompt(spark, corpus):
    opened = service.Service(spark, *corpus, warm=True)
    opened.thread.join()
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "UNRELATED"}}}, {"id": 4, "method": "tools/call", "params": {"name": "search", "arguments": {}}},
        {"id": 5, "method": "tools/call", "params": {"name": "graph", "arguments": {"symbol": "lo"}}}, {"id": 6, "method": "nope"}, {"id": 7, "method": "ping"},
        {"id": 8, "method": "tools/call", "params": {"name": "flow", "arguments": {"source": "openBillingInvoice", "target": "log"}}}, {"id": 9, "method": "tools/call", "params": {"name": "none"}},
    ]
    source = io.StringIO("\n".join(json.dumps(a) for a in asked) + "\n\nnot json\n[]\n")
    sink = io.StringIO()
    service.serve(opened, source, sink)
    replies = [json.loads(x) for x in sink.getvalue().splitlines()]
    by = {r["id"]: r for r in replies if r["id"]}
    assert len(replies) == 11 and [r["error"]["code"] for r in replies if not r["id"]] == [-32700, -32600]
    assert by[1]["result"]["serverInfo"]["name"] == "lodestone" and {t["name"] for t in by[2]["result"]["tools"]} == set(service.TOOLS)
    data = lambda k: json.loads(by[k]["result"]["content"][0]["text"])["data"]
    assert data(3)["count"] == 1 and data(3)["hits"][0]["rel"] == "log.ts"
    assert by[4]["result"]["isError"] and "query" in by[4]["result"]["content"][0]["text"]
    assert by[5]["result"]["isError"] and "did you mean: log ?" in by[5]["result"]["content"][0]["text"]
    assert by[6]["error"]["code"] == -32601 and by[7]["result"] == {} and by[9]["result"]["isError"]
    hops = data(8)["hops"]
    assert [h["name"] for h in hops] == ["openBillingInvoice", "log"] and "log();" in hops[0]["text"]
    sink = io.StringIO()
    service.prompt(opened, io.StringIO("unrelated\n:graph log\n:flow a\n:refresh\n:status\n:quit\nunread\n"), sink)
    shown = sink.getvalue()
    assert "log.ts:4  (1)" in shown and "const >unrelated< = 3;" in shown and '"called_by"' in shown and "missing required argument: target" in shown and "0 files changed" in shown
    assert service.answer(opened, None)["error"]["code"] == -32700
    long = io.StringIO("x" * (service.MOST_LINE + 5) + "\nping\n")
    assert [m is None for m in service.messages(long)] == [True, False]


def test_command_line(spark, corpus, capsys, monkeypatch):
    root, folder = corpus
    monkeypatch.setattr(__main__, "session", lambda: spark)
    monkeypatch.setattr(lake, "directory", lambda root: folder)
    for name in ("EMBED_PROVIDER", "EMBED_API_KEY", "COHERE_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert __main__.main(["search", "unrelated", "--dir", root]) == 0 and "log.ts:4" in capsys.readouterr().out
    assert __main__.main(["ask", "billing invoice", "--dir", root, "--embed-provider", "hash", "--embed-dim", "64", "--limit", "1"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["data"]["provider"] == "hash:64" and out["data"]["hits"][0]["rel"] == "pay.ts" and "duration_ms" in out["meta"]
    assert __main__.main(["graph", "nothing", "--dir", root]) == 1 and "no symbol named" in capsys.readouterr().err
    assert __main__.main(["clues", "log", "--dir", root, "--limit", "3"]) == 0 and json.loads(capsys.readouterr().out)["data"]["count"]
    assert __main__.main(["index", "--dir", root, "--no-cache"]) == 0 and json.loads(capsys.readouterr().out)["files"] == 2
