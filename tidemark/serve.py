"""The library's read-only tools over HTTP, as JSON: /health, /api/sources, /api/search and /api/doc."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .api import Library, clamped


class Refused(Exception):
    """A request that gets an error, with its status."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def rows(frame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


class Service:
    """What each address answers; requests are done one after the other, as they share a session."""

    def __init__(self, library: Library):
        self.library, self.started, self.lock = library, time.time(), threading.Lock()
        self.routes: dict[str, Callable[[dict], object]] = {"/health": self.health, "/api/sources": self.sources, "/api/search": self.search, "/api/doc": self.doc}

    def answer(self, address: str) -> tuple[int, object]:
        at = urlsplit(address)
        asked = {k: v[-1] for k, v in parse_qs(at.query).items()}
        route = self.routes.get(at.path)
        try:
            if route is None:
                raise Refused(404, f"nothing is at {at.path}")
            with self.lock:
                return 200, route(asked)
        except Refused as e:
            return e.status, {"error": str(e)}
        except Exception as e:
            return 500, {"error": f"{type(e).__name__}: {e}"[:1000]}

    def health(self, asked: dict) -> dict:
        return {"status": "ok", "uptime_secs": int(time.time() - self.started), "sources": self.library.names()}

    def sources(self, asked: dict) -> list[dict]:
        return rows(self.library.list_sources().orderBy("name"))

    def _source(self, asked: dict) -> str | None:
        name = asked.get("source", "").strip() or None
        if name is not None and name not in self.library.names():
            raise Refused(400, f"no source {name!r}; there are {', '.join(self.library.names())}")
        return name

    def search(self, asked: dict) -> dict:
        text, output = asked.get("q", "").strip(), asked.get("output", "chunks")
        if not text:
            raise Refused(400, "q is empty")
        if output not in ("chunks", "files"):
            raise Refused(400, "output is chunks or files")
        try:
            top_k = clamped(int(asked.get("top_k", 10)), 1, 50)
        except ValueError:
            raise Refused(400, "top_k is a number") from None
        hits, trust = self.library.search([text], self._source(asked), top_k, output)
        return envelope(rows(hits), rows(trust))[0]

    def doc(self, asked: dict) -> dict:
        name = self._source(asked)
        if name is None or not asked.get("path"):
            raise Refused(400, "source and path are needed")
        try:
            found = rows(self.library.get(name, asked["path"]))
        except ValueError as e:
            raise Refused(400, str(e)) from None
        if not found:
            raise Refused(404, f"not in the index: {asked['path']}")
        return {"source": name, **found[0]}


def envelope(hits: list[dict], trust: list[dict]) -> list[dict]:
    """For each query its confidence and its hits in order."""
    return [{"query_id": t["query_id"], "low_confidence": t["low_confidence"], "confidence": t["confidence"], "hits": sorted((h for h in hits if h["query_id"] == t["query_id"]), key=lambda h: h["rank"])} for t in sorted(trust, key=lambda t: t["query_id"])]


def as_paths(result: dict) -> str:
    """The files of a result, one a line."""
    return "".join(f"{h['path']}\n" for h in result["hits"])


def as_text(result: dict) -> str:
    """A result to be read: each hit's place, score and first line, after a warning if nothing is sure."""
    if not result["hits"]:
        return "no hits\n"
    out = ["no strong match; the closest:\n"] if result["low_confidence"] else []
    for h in result["hits"]:
        where = f"{h['path']} > {h['heading_path']}" if h.get("heading_path") else h["path"]
        out.append(f"{h['rank']}. {where} ({h['score']:.4f})\n" + (f"   {h['snippet']}\n" if h.get("snippet") else ""))
    return "\n".join(out)


def serve(library: Library, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that is running in a thread of its own; ``server_port`` is its port, and ``shutdown()`` ends it."""
    service = Service(library)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, answer = service.answer(self.path)
            body = json.dumps(answer, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
