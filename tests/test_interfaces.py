"""Command line and HTTP."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from lodestone import cli, server
from lodestone.sources.snapshots import Store


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "memory_allocator.py").write_text("class MemoryManager:\n    def allocate(self):\n        return 'block of memory'\n")
    (d / "linux.md").write_text("# Memory\nmemory management in the kernel\n")
    (d / "nodes.csv").write_text("node,role\nn1,primary database\n")
    return d


@pytest.fixture(scope="module")
def store_path(tmp_path_factory):
    return str(tmp_path_factory.mktemp("store"))


def _lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_command_line(spark, folder, store_path, capsys):
    run = lambda *a: cli.main(["--store", store_path, *a])
    run("index", str(folder))
    assert _lines(capsys) == [{"scanned": 3, "indexed": 3, "skipped": 0, "deleted": 0, "failed": 0}]
    run("search", "memory management", "--limit", "5")
    *found, total = _lines(capsys)
    assert found and found[0]["filename"] in ("linux.md", "memory_allocator.py") and total["total"] >= len(found)
    run("code", "allocate")
    assert all(r["code_type"] for r in _lines(capsys))
    run("symbol", "MemoryManager")
    assert _lines(capsys)[0]["kind"] == "class"
    run("stats")
    assert _lines(capsys)[0]["documents"] == 3
    run("rebuild", str(folder))
    assert _lines(capsys)[0]["indexed"] == 3
    with pytest.raises(SystemExit):
        run("index", str(folder / "nowhere"))


def test_http(spark, folder, store_path):
    api = server.Api(Store(spark, store_path))
    s = server.serve(api, "127.0.0.1", 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_port}"

    def call(path, method="GET", body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, method=method, data=body)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert call("/api/index", "POST", json.dumps({"path": str(folder)}).encode())[1]["scanned"] == 3
        status, found = call("/api/search?q=database&limit=5")
        assert status == 200 and found["total"] >= 1 and found["results"][0]["filename"] == "nodes.csv" and "raw_score" not in found["results"][0]
        assert call("/api/symbol?q=memory")[1]["results"][0]["name"] == "MemoryManager"
        assert call("/api/code?q=allocate")[0] == 200 and call("/api/stats")[1]["documents"] == 3
        assert call("/api/watched-folders")[1]["folders"] == [{"path": str(folder), "root": str(folder), "active": False}]
        assert call(f"/api/watched-folders?path={folder}", "DELETE")[1] == {"removed": True}
        for bad in ("/api/search", "/api/search?q=a&limit=101", "/api/search?q=a&alpha=2", "/api/search?q=a&page=x"):
            assert call(bad)[0] == 400
        assert call("/api/index", "POST", b'{"path": "/no/such"}')[0] == 400 and call("/nothing")[0] == 404
    finally:
        s.shutdown()
