"""Command line: index | search | code | symbol | stats | status | rebuild | watch | unwatch | folders | serve | daemon."""

from __future__ import annotations

import argparse
import json
import os
import time

from lodestone import config, server
from lodestone.operators import dense
from lodestone.plans import indexing, search, syntax
from lodestone.session import session
from lodestone.sources.snapshots import Store
from lodestone.streaming import watch


def _print(df) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))


def _vector(query: str) -> list[float] | None:
    text = syntax.parse(query).text
    return dense.embed_query(text) if text else None


def _watcher(store: Store, at: str) -> watch.Watcher:
    """Follows all watched folders."""
    w = watch.Watcher(store, f"{at}/checkpoints")
    w.follow([r["path"] for r in store.watched().collect()])
    return w


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("--store", default=os.environ.get("LODESTONE_STORE", os.path.expanduser("~/.lodestone")))
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("index", "watch", "unwatch"):
        sub.add_parser(name).add_argument("path")
    for name, limit in (("search", config.LIMIT), ("code", config.LIMIT), ("symbol", 20)):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("--limit", type=int, default=limit)
        if name == "search":
            c.add_argument("--alpha", type=float, default=config.ALPHA)
            c.add_argument("--page", type=int, default=1)
            c.add_argument("--code-only", action="store_true")
    for name in ("stats", "status", "folders"):
        sub.add_parser(name)
    for name in ("serve", "daemon"):
        c = sub.add_parser(name)
        c.add_argument("--host", default="127.0.0.1")
        c.add_argument("--port", type=int, default=8000)
        if name == "daemon":
            c.add_argument("path", nargs="?")
    sub.add_parser("rebuild").add_argument("paths", nargs="+")
    a = p.parse_args(argv)

    store = Store(session(a.master), a.store)
    now = time.time()
    if a.command == "index":
        if not os.path.isdir(a.path):
            p.error(f"{a.path} is no folder")
        print(json.dumps(indexing.index_folder(store, a.path)))
    elif a.command == "search":
        found, total = search.search_paginated(store.index, a.query, now, a.page, a.limit, alpha=a.alpha, code_only=a.code_only, query_vector=_vector(a.query))
        _print(search.presented(found))
        print(json.dumps({"total": total.first()[0]}))
    elif a.command == "code":
        _print(search.presented(search.search_code(store.index, a.query, now, a.limit, query_vector=_vector(a.query))))
    elif a.command == "symbol":
        _print(search.search_symbol(store.index, a.query, a.limit))
    elif a.command in ("stats", "status"):
        print(json.dumps(store.stats() | {"version": store.version}, ensure_ascii=False))
    elif a.command == "rebuild":
        print(json.dumps(indexing.rebuild(store, a.paths)))
    elif a.command == "watch":
        path = os.path.abspath(a.path)
        print(json.dumps(indexing.index_folder(store, path)))
        store.add_watched(path)
        _watcher(store, a.store).query.awaitTermination()
    elif a.command in ("serve", "daemon"):
        if getattr(a, "path", None):
            store.add_watched(os.path.abspath(a.path))
        w = _watcher(store, a.store)
        try:
            server.serve(server.Api(store, watcher=w), a.host, a.port).serve_forever()
        finally:
            w.stop()
    elif a.command == "unwatch":
        print(json.dumps({"removed": store.remove_watched(os.path.abspath(a.path))}))
    elif a.command == "folders":
        _print(store.watched())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
