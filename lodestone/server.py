"""The search as JSON over HTTP, on the standard library's server.

GET  /api/search?q=&alpha=0.5&page=1&limit=15&code_only=false
GET  /api/code?q=&limit=10      GET /api/symbol?q=&limit=20
GET  /api/stats                 GET /api/watched-folders
POST /api/index {"path": ...}   DELETE /api/watched-folders?path=
"""

from __future__ import annotations

import json
import math
import os
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from lodestone.operators import dense
from lodestone.plans import indexing, search, syntax
from lodestone.sources.snapshots import Store
from lodestone.streaming import watch


class BadRequest(ValueError):
    """A parameter is missing or out of its bounds."""


def _number(params: dict[str, str], name: str, default: float, low: float, high: float, kind: type = int):
    try:
        value = kind(params.get(name, default))
    except ValueError as e:
        raise BadRequest(f"{name} is no number") from e
    if not low <= value <= high:
        raise BadRequest(f"{name} must lie between {low} and {high}")
    return value


def _words(params: dict[str, str]) -> str:
    if not params.get("q"):
        raise BadRequest("q is missing")
    return params["q"]


def _rows(df) -> list[dict]:
    """A page of results: at most its limit."""
    return [r.asDict(recursive=True) for r in df.toLocalIterator()]


class Api:
    """The answers, apart from HTTP. Readers see whole snapshots. With a watcher, folders are followed as they are indexed."""

    def __init__(self, store: Store, embed: dense.Embed = dense.hashed_words, watcher: watch.Watcher | None = None):
        self.store, self.embed, self.watcher = store, embed, watcher
        self.writing = threading.Lock()

    def _vector(self, q: str) -> list[float] | None:
        text = syntax.parse(q).text
        return dense.embed_query(text, self.embed) if text else None

    def search(self, p: dict[str, str]) -> dict:
        q, alpha = _words(p), _number(p, "alpha", 0.5, 0.0, 1.0, float)
        page, limit = _number(p, "page", 1, 1, 10**9), _number(p, "limit", 15, 1, 100)
        code = p.get("code_only", "false").lower() in ("1", "true", "yes")
        t = time.time()
        found, total = search.search_paginated(self.store.index, q, t, page, limit, alpha=alpha, code_only=code, query_vector=self._vector(q))
        n = total.first()[0]
        return {"query": q, "page": page, "limit": limit, "total": n, "pages": math.ceil(n / limit), "results": _rows(search.presented(found)), "seconds": round(time.time() - t, 4)}

    def code(self, p: dict[str, str]) -> dict:
        q = _words(p)
        found = search.search_code(self.store.index, q, time.time(), _number(p, "limit", 10, 1, 50), query_vector=self._vector(q))
        return {"query": q, "results": _rows(search.presented(found))}

    def symbol(self, p: dict[str, str]) -> dict:
        q = _words(p)
        return {"query": q, "results": _rows(search.search_symbol(self.store.index, q, _number(p, "limit", 20, 1, 50)))}

    def stats(self, _: dict[str, str]) -> dict:
        return self.store.stats()

    def index(self, p: dict[str, str]) -> dict:
        path = os.path.abspath(p.get("path") or "")
        if not p.get("path") or not os.path.isdir(path):
            raise BadRequest("path is no folder")
        with self.writing:
            counters = indexing.index_folder(self.store, path, self.embed)
            self.store.add_watched(path)
            self._follow()
        return {"path": path, **counters}

    def _follow(self) -> None:
        if self.watcher:
            self.watcher.follow([r["path"] for r in self.store.watched().collect()])

    def folders(self, _: dict[str, str]) -> dict:
        """Watched folders, and whether they are being followed; one under another is covered by it."""
        paths = [r["path"] for r in self.store.watched().collect()]
        roots = watch.subsumed(paths)
        return {"folders": [{"path": p, "root": next(r for r in roots if watch.covers(r, p)), "active": bool(self.watcher and self.watcher.watches(p))} for p in paths]}

    def unwatch(self, p: dict[str, str]) -> dict:
        with self.writing:
            removed = self.store.remove_watched(os.path.abspath(p.get("path") or ""))
            self._follow()
        return {"removed": removed}

    @property
    def routes(self) -> dict[tuple[str, str], Callable[[dict[str, str]], dict]]:
        return {
            ("GET", "/api/search"): self.search, ("GET", "/api/code"): self.code, ("GET", "/api/symbol"): self.symbol, ("GET", "/api/stats"): self.stats,
            ("POST", "/api/index"): self.index, ("GET", "/api/watched-folders"): self.folders, ("DELETE", "/api/watched-folders"): self.unwatch,
        }

    def answer(self, method: str, url: str, body: bytes = b"") -> tuple[int, dict]:
        """Status and JSON of a request."""
        u = urlsplit(url)
        f = self.routes.get((method, u.path))
        if f is None:
            return 404, {"detail": "not found"}
        try:
            params = {k: v[-1] for k, v in parse_qs(u.query).items()}
            if body:
                params |= json.loads(body)
            return 200, f(params)
        except (BadRequest, json.JSONDecodeError, TypeError) as e:
            return 400, {"detail": str(e)}


def serve(api: Api, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            status, data = api.answer(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            out = json.dumps(data, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            for k, v in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(out))), ("Access-Control-Allow-Origin", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = do_DELETE = _reply

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
