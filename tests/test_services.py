"""Embedders behind HTTP, and the tools over HTTP."""

import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark import serve
from tidemark.api import Library
from tidemark.sources.embedders import HttpEmbedder
from tidemark.sources.registry import Registry, Source


@pytest.fixture
def model():
    """A service that gives each text's length twice; its answers of trouble come first, one for each request."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.server.seen.append((body, self.headers.get("Authorization")))
            status, extra = self.server.trouble.pop(0) if self.server.trouble else (200, {})
            data = [{"index": i, "embedding": [float(len(t))] * self.server.dims} for i, t in enumerate(body["input"])]
            answer = json.dumps({"data": data[::-1]}).encode()
            self.send_response(status)
            for k, v in (extra | {"Content-Length": str(len(answer))}).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.seen, server.trouble, server.dims = [], [], 2
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def embedder(model, **more):
    return HttpEmbedder(f"http://127.0.0.1:{model.server_port}/v", "m", 2, key="k", batch=3, first_wait=0.01, **more)


def test_batches_and_order(model):
    texts = ["", "a", "bb", "ccc", "dddd"]
    assert embedder(model, send_dims=True).embed(texts) == [[float(len(t))] * 2 for t in texts]
    assert [b["input"] for b, _ in model.seen] == [texts[:3], texts[3:]]
    assert model.seen[0][1] == "Bearer k" and model.seen[0][0]["dimensions"] == 2 and embedder(model).embed([]) == []


def test_what_is_tried_again(model):
    model.trouble = [(503, {}), (429, {"Retry-After": "0"}), (500, {})]
    assert embedder(model).embed(["ab"]) == [[2.0, 2.0]] and len(model.seen) == 4
    model.seen.clear()
    model.trouble = [(500, {})] * 4
    with pytest.raises(RuntimeError, match="500"):
        embedder(model).embed(["ab"])
    assert len(model.seen) == 4
    model.seen.clear()
    model.trouble = [(401, {})]
    with pytest.raises(RuntimeError, match="401"):
        embedder(model).embed(["ab"])
    assert len(model.seen) == 1
    model.trouble, model.dims = [], 3
    with pytest.raises(RuntimeError, match="3 numbers"):
        embedder(model).embed(["ab"])
    with pytest.raises(RuntimeError, match="reached"):
        HttpEmbedder("http://127.0.0.1:9/", "m", 2, first_wait=0.01, attempts=2).embed(["ab"])


def test_vectors_of_a_table(spark, model):
    rows = spark.createDataFrame([(i, f"p{i}", "x" * i if i else None) for i in range(8)], "chunk_id long, path string, content string")
    got = embedder(model).vectors(rows, F.col("content")).collect()
    assert {(r["chunk_id"], r["path"], tuple(r["embedding"])) for r in got} == {(i, f"p{i}", (float(i), float(i))) for i in range(8)}


def test_tools_over_http(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n/rivers.md").write_text("# Rivers\n\nThe river bends twice before the mill.\n")
    (tmp_path / "n/hills.md").write_text("# Hills\n\nSheep graze on the hills.\n")
    library = Library(spark, Registry([Source("n", str(tmp_path / "n"))]), str(tmp_path / "index"))
    library.refresh("n")
    server = serve.serve(library)

    def get(address):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{address}") as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert get("/health")[1]["sources"] == ["n"]
    assert [(s["name"], s["files"]) for s in get("/api/sources")[1]] == [("n", 2)]
    status, found = get("/api/search?q=river+mill&top_k=1")
    assert status == 200 and [h["path"] for h in found["hits"]] == ["rivers.md"] and found["hits"][0]["snippet"]
    assert serve.as_paths(found) == "rivers.md\n" and "rivers.md" in serve.as_text(found) and serve.as_text({"hits": []}) == "no hits\n"
    assert get("/api/search?q=river&output=files")[1]["hits"][0]["snippet"] == ""
    assert get("/api/doc?source=n&path=hills.md")[1]["content"].startswith("# Hills")
    for address, status in (("/api/search?q=+", 400), ("/api/search?q=x&source=zz", 400), ("/api/search?q=x&output=odd", 400), ("/api/search?q=x&top_k=odd", 400), ("/api/doc?source=n&path=none.md", 404), ("/api/doc?source=n&path=../x", 400), ("/api/doc?source=n", 400), ("/nowhere", 404)):
        assert get(address)[0] == status and "error" in get(address)[1]
    server.shutdown()
