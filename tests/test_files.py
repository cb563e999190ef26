"""Readers, indexing, snapshots and the stream, over small folders."""

import io
import json
import os
import tarfile
import time
import zipfile
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from lodestone.plans import indexing
from lodestone.plans import search as S
from lodestone.sources import listing, routing
from lodestone.sources.formats import packages
from lodestone.sources.formats.base import File
from lodestone.sources.snapshots import Store, changes
from lodestone.streaming import watch


def read(name, content, companions=()):
    content = content.encode() if isinstance(content, str) else content
    return routing.read_file(File(PurePosixPath("/home/u/work") / name, content, len(content), 0.0, companions))


def zipped(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), text)
    return b.getvalue()


def test_python():
    src = "import os\nfrom a import b\n\n\nclass CacheManager:\n    def get(self):\n        def inner(): pass\n        return 1\n\n    async def put(self):\n        pass\n\n\ndef calculate_checksum(x):\n    return x\n"
    chunks = read("m.py", src)
    assert [(c.symbol_name, c.start_line, c.end_line, c.symbols[0].kind) for c in chunks if c.symbol_name] == [("CacheManager", 5, 11, "class"), ("get", 6, 8, "function"), ("put", 10, 11, "async_function"), ("calculate_checksum", 14, 15, "function")]
    assert [c.text for c in chunks if not c.symbol_name] == ["import os\nfrom a import b"]
    assert read("bad.py", "def (:\n")[0].text == "def (:"


def test_markdown():
    c = read("n.md", "intro\n# Linux\na\n## Virtual Memory\nb\n### Paging\nc\n## IO\nd\n")
    assert [(x.section_title, x.text, x.start_line) for x in c] == [("Introduction", "intro", 1), ("Linux", "a", 3), ("Linux > Virtual Memory", "b", 5), ("Linux > Virtual Memory > Paging", "c", 7), ("Linux > IO", "d", 9)]


@pytest.mark.parametrize(
    ("name", "text", "symbols"),
    [
        ("x.sh", "export APP_PORT=1\nbackup_database() {\n}\nfunction start_server {\nalias ll='ls'\n", [("APP_PORT", "variable"), ("backup_database", "function"), ("start_server", "function"), ("ll", "alias")]),
        ("x.cpp", "#include <a.h>\nclass A {\nstruct B {\nint main(int x) {\nif (x) {\n", [("a.h", "import"), ("A", "class"), ("B", "struct"), ("main", "function")]),
        ("x.ts", "import x from 'm'\nconst y = require(\"n\")\nexport class K {}\nconst f = async (a) => 1\nfunction g(x) {\n", [("m", "import"), ("n", "import"), ("K", "class"), ("f", "function"), ("g", "function")]),
        ("x.rs", "pub fn run<T>(x: T)\nstruct S\nenum E\ntrait Q\n", [("run", "function"), ("S", "struct"), ("E", "enum"), ("Q", "trait")]),
        ("x.go", "func (s *S) Do(x int)\ntype S struct\ntype I interface\n", [("Do", "function"), ("S", "struct"), ("I", "interface")]),
        ("x.java", "public class A {\ninterface B {\npublic static int go(int x) {\n", [("A", "class"), ("B", "interface"), ("go", "method")]),
        ("x.kt", "fun f(x)\nclass C\n", [("f", "function"), ("C", "class")]),
        ("x.sql", "create table if not exists a.b (x)\nCREATE VIEW v AS\nCREATE INDEX i ON\nCREATE PROCEDURE p()\n", [("a.b", "table"), ("v", "view"), ("i", "index"), ("p", "procedure")]),
    ],
)
def test_code(name, text, symbols):
    (c,) = read(name, text)
    assert [(s.name, s.kind) for s in c.symbols] == symbols


def test_notebook():
    nb = {"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "def f(x):\n    pass\nclass C: pass"}, {"cell_type": "code", "source": " "}]}
    a, b = read("n.ipynb", json.dumps(nb))
    assert (a.section_title, a.code_type, a.start_line, a.end_line) == ("Cell 1 (markdown)", None, 1, 2)
    assert (b.code_type, b.start_line, b.end_line) == ("python", 3, 5) and [(s.name, s.line_number) for s in b.symbols] == [("f", 3), ("C", 5)]


def test_texts():
    assert read("a.json", '{"a":1,"ç":[2]}')[0].text == '{\n  "a": 1,\n  "ç": [\n    2\n  ]\n}'
    assert read("a.json", "{no")[0].text == "{no"
    assert read("a.toml", '[database]\nhost = "localhost"')[0].text == '{\n  "database": {\n    "host": "localhost"\n  }\n}'
    assert read("a.csv", "h,i\n1, \nx,y,z\n")[0].text == "Row 1: h: 1\nRow 2: h: x | i: y | Col_2: z"
    assert read("a.tsv", "h\ti\n1\t2\n")[0].text == "Row 1: h: 1 | i: 2"
    assert read("a.xml", "<a>x<b>y</b>tail</a>")[0].text == "x\ny"
    assert read("a.yaml", "b: 1\na: [x]\n")[0].text == "a:\n- x\nb: 1"
    assert read("a.html", "<title>T &amp; t</title><script>x</script><p>One  two</p><p>three<br>four</p>")[0].text == "One two\n\nthree\nfour"
    assert read("a.srt", "1\n00:00:20,000 --> 00:00:24,400\n<i>Hi</i> {\\an8}there\n\n2\n00:00:25,000 --> 00:00:26,000\nBye")[0].text == "Hi there\n\nBye"
    assert read("a.txt", b"caf\xe9 \xff")[0].text == "caf\ufffd \ufffd"


def test_packages():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    assert read("r.docx", zipped(word__document_DOT_xml=f"<w:d {w}><w:p><w:r><w:t>One</w:t><w:t> two</w:t></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:d>"))[0].text == "One two\n\nthree"
    p = lambda t: f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, how="": f"<w:tc><w:tcPr>{how}</w:tcPr>{p(t)}</w:tc>"
    down = "<w:vMerge w:val='restart'/>", "<w:vMerge/>"
    rows = [cell("a") + cell("") + cell("b"), cell("both", "<w:gridSpan w:val='2'/>") + cell("c"), cell("x", down[0]) + cell("y"), cell("", down[1]) + cell("z"), cell("")]
    table = "".join(f"<w:tr>{r}</w:tr>" for r in rows)
    found = read("t.docx", zipped(word__document_DOT_xml=f"<w:d {w}><w:body>{p('before')}<w:tbl>{table}</w:tbl>{p('after')}</w:body></w:d>"))
    assert found[0].text == "before\n\nafter\n\na | b\n\nboth | both | c\n\nx | y\n\nx | z"
    slides = read("r.pptx", zipped(ppt__slides__slide10_DOT_xml=f"<p {a}><a:t>ten</a:t></p>", ppt__slides__slide2_DOT_xml=f"<p {a}><a:t>two</a:t></p>"))
    assert [(c.text, c.page_number, c.section_title) for c in slides] == [("two", 1, "Slide 1"), ("ten", 2, "Slide 2")]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    assert read("r.xlsx", zipped(xl__sharedStrings_DOT_xml=f"<s {s}><t>a</t><t>b</t></s>"))[0].text == "a\nb"
    assert read("r.odt", zipped(content_DOT_xml="<d><p>x<s>y</s></p></d>"))[0].text == "x\n\ny"
    assert read("r.rtf", r"{\rtf1\ansi \b Hello\b0\par World}")[0].text == "Hello World"
    assert "readable words" in read("r.doc", b"\x00\x01readable words\x00\x02")[0].text
    z = read("b.zip", zipped(src__a_DOT_py="x", b_DOT_txt="y" * 2048))[0].text
    assert z.startswith("Arşiv Dosyası: b.zip\nToplam İçerik: 2 dosya") and "• b.txt (2.0 KB)" in z
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        i = tarfile.TarInfo("in/x.c")
        i.size = 1
        f.addfile(i, io.BytesIO(b"x"))
    assert "• in/x.c (0.0 KB)" in read("b.tgz", t.getvalue())[0].text
    assert read("b.epub", zipped(c1_DOT_xhtml="<p>chapter</p>"))[0].section_title == "Bölüm 1 (c1)"
    assert read("b.zip", b"no zip")[0].text.startswith("Dosya Adı: b.zip")


def test_media_and_anything():
    v = read("lecture.mp4", b"\0", (("lecture.en.srt", b"1\n00:00:20,000 --> 00:00:24,400\nHello\n"),))
    assert [c.section_title for c in v] == ["lecture.mp4", "lecture.mp4 (Altyazı: lecture.en.srt)"] and v[1].text == "Hello"
    assert "rock, duman" in read("rock_duman.mp3", b"ID3")[0].text
    assert "screenshot, dashboard" in read("screenshot_dashboard.png", b"\x89PNG")[0].text
    assert "hello" in read("d.svg", "<svg><title>hello</title></svg>")[0].text
    b = read("karakter_animasyonRobot.blend", b"BLENDER\x00\x01\x02\x03\x04\x05\x06")[0].text
    assert "Blender 3D" in b and "karakter, animasyon, robot" in b and "home > u > work" in b


@pytest.fixture
def tree(tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / ".git").mkdir()
    (d / ".git" / "x.txt").write_text("hidden")
    (d / "__init__.py").write_text("class MemoryManager:\n    def allocate(self):\n        return 'memory'\n")
    (d / "notes.md").write_text("# Memory\nmemory management of kernels\n")
    (d / "sub" / "film.mkv").write_bytes(b"\0\0")
    (d / "sub" / "film.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nsanal bellek\n")
    (d / "id_rsa").write_text("secret")
    return d


def test_text_in_pictures():
    f = lambda name, ocr: File(PurePosixPath(f"/d/{name}"), b"pixels", 6, 0.0, (), ocr)
    said = routing.read_file(f("a.png", lambda content: f" {content.decode()} say\nhello "))[0]
    assert said.text.endswith("\n\nGörsel İçi Okunan Metin (OCR):\npixels say\nhello") and said.end_line == said.text.count("\n")
    plain = routing.read_file(f("a.png", None))[0].text
    assert "OCR" not in plain
    assert routing.read_file(f("a.png", lambda content: "short"))[0].text == plain
    assert routing.read_file(f("a.png", lambda content: 1 / 0))[0].text == plain
    assert packages.with_scans("p. 3", [b"1", b"2", b"3"], lambda b: "x" * 14 if b == b"1" else "y" * 5000) == "p. 3\n\n[OCR Sayfa Metni]:\n" + ("y" * 2000 + "\n" + "y" * 2000)[:4000]
    assert packages.with_scans("p. 3", [b"1"], lambda b: "") == "p. 3"


def test_damaged_vectors(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    indexing.index_folder(store, str(tree))
    n = store.index.chunks.count()
    for part in (tmp_path / "store").glob("segments/*/vectors/*"):
        part.unlink() if part.name.startswith((".", "_")) else part.write_bytes(b"no parquet")
    assert store.index.vectors.count() == 0 and store.index.chunks.count() == n


def test_listing(spark, tree):
    got = {os.path.relpath(r.path, tree): r for r in listing.folder(spark, str(tree)).collect()}
    assert set(got) == {"__init__.py", "notes.md", "sub/film.mkv", "sub/film.srt"}
    stored = {os.path.relpath(r.path, tree): r.sha256 for r in listing.store(spark, str(tree)).collect()}
    assert stored == {k: got[k].sha256 for k in stored} and "notes.md" in stored
    assert listing.folder(spark, str(tree / "nowhere")).count() == 0


def test_index_update_and_rebuild(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.version == 0 and store.index.documents.count() == 0
    assert indexing.index_folder(store, str(tree)) == {"scanned": 4, "indexed": 4, "skipped": 0, "deleted": 0, "failed": 0}
    assert indexing.index_folder(store, str(tree)) == {"scanned": 4, "indexed": 0, "skipped": 4, "deleted": 0, "failed": 0}
    s = store.stats()
    assert s["documents"] == 4 and s["by_extension"] == {".md": 1, ".mkv": 1, ".py": 1, ".srt": 1} and s["size_bytes"] > 0
    assert {r.filename for r in S.search(store.index, "sanal bellek", 0.0).collect()} <= {"film.mkv", "film.srt"}
    assert S.search_symbol(store.index, "MemoryManager").first().kind == "class"
    ids = {r.path: r.doc_id for r in store.index.documents.collect()}
    (tree / "notes.md").write_text("# Disk\ndisk space\n")
    (tree / "__init__.py").unlink()
    (tree / "new.txt").write_text("brand new words")
    assert indexing.index_folder(store, str(tree)) == {"scanned": 4, "indexed": 2, "skipped": 2, "deleted": 1, "failed": 0}
    i = store.index
    assert {r.path: r.doc_id for r in i.documents.collect()}[str(tree / "notes.md")] == ids[str(tree / "notes.md")]
    assert i.postings.where("term = 'allocate'").count() == 0 and i.symbols.count() == 0
    assert i.vectors.count() == i.chunks.count()
    # Indexing step by step and from nothing give the same tables.
    fresh = Store(spark, str(tmp_path / "fresh"))
    indexing.rebuild(fresh, [str(tree)])
    for name in ("chunks", "postings", "symbols"):
        assert sorted(map(tuple, getattr(i, name).collect()), key=repr) == sorted(map(tuple, getattr(fresh.index, name).collect()), key=repr)
    indexing.remove_files(store, [str(tree / "new.txt")])
    assert store.index.documents.count() == 3
    store.vacuum(1)
    assert store.index.documents.count() == 3
    store.clear()
    assert store.stats()["documents"] == 0


def test_segments_and_compaction(spark, tree, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    indexing.index_folder(store, str(tree))
    for n in range(3):
        (tree / "notes.md").write_text(f"# V{n}\nversion{n} text\n")
        indexing.index_folder(store, str(tree))
    assert store.version == 4 and len(store._manifest()["segments"]) == 4
    docs = store.index.documents.collect()
    assert len(docs) == 4 and store.index.postings.where("term like 'version%'").select("term").collect() == [("version2",)]
    before = {n: sorted(map(tuple, store.table(n).collect()), key=repr) for n in ("documents", "chunks", "symbols", "postings", "vectors")}
    store.compact()
    assert len(store._manifest()["segments"]) == 1
    assert before == {n: sorted(map(tuple, store.table(n).collect()), key=repr) for n in before}
    store.vacuum(1)
    assert store.index.chunks.count() == len(before["chunks"])
    monkeypatch.setattr("lodestone.sources.snapshots.SEGMENTS", 1)
    (tree / "notes.md").unlink()
    (tree / "other.md").write_text("other")
    indexing.index_folder(store, str(tree))
    assert len(store._manifest()["segments"]) == 1 and {r.filename for r in store.index.documents.collect()} >= {"other.md"}


def test_changes(spark):
    docs = spark.createDataFrame([("/a/x", "1"), ("/a/y", "2"), ("/ab/z", "3")], "path string, sha256 string")
    files = spark.createDataFrame([("/a/x", "1"), ("/a/n", "9"), ("/a/f", None)], "path string, sha256 string")
    assert {tuple(r) for r in changes(docs, files, "/a").collect()} == {("/a/x", "unchanged"), ("/a/n", "new"), ("/a/f", "failed"), ("/a/y", "deleted")}


def test_watched_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert [store.add_watched("/a"), store.add_watched("/b"), store.add_watched("/a")] == [True, True, False]
    assert [r.path for r in store.watched().collect()] == ["/a", "/b"]
    assert store.remove_watched("/a") and not store.remove_watched("/a")
    assert [r.path for r in store.watched().collect()] == ["/b"]
    assert watch.with_root({"/a/b", "/c"}, "/a") == {"/a", "/c"} and watch.with_root({"/a"}, "/a/b/c") == {"/a"} and watch.with_root({"/a"}, "/ab") == {"/a", "/ab"}


def test_debouncing():
    due, pending = watch.debounced({}, [("/x", "created")], 10.0, 1.0)
    assert due == [] and pending == {"/x": ["created", 10.0]}
    due, pending = watch.debounced(pending, [("/x", "modified"), ("/y", "deleted")], 10.5, 1.0)
    assert due == []
    due, pending = watch.debounced(pending, [], 11.5, 1.0)
    assert due == [("/x", "modified"), ("/y", "deleted")] and pending == {}
    assert watch.difference({"a": [1, 1], "b": [1, 1]}, {"b": [2, 1], "c": [1, 1]}) == [("a", "deleted"), ("b", "modified"), ("c", "created")]


def test_stream_applies_events(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run = lambda: watch.watch(store, [str(tree)], str(tmp_path / "cp"), start="all", quiet=0.0, poll="200 milliseconds")
    q = run()
    try:
        q.processAllAvailable()
        assert store.index.documents.count() == 4
        (tree / "notes.md").unlink()
        (tree / "more.txt").write_text("more words")
        q.processAllAvailable()
        names = {r.filename for r in store.index.documents.collect()}
        assert "more.txt" in names and "notes.md" not in names
    finally:
        q.stop()


def test_sessions(spark):
    e = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("p", "c", 9)], "path string, event string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r.events, r.event) for r in watch.sessions(e, "path", "2 seconds", "event").orderBy("started").collect()] == [(2, "b"), (1, "c")]
    assert watch.latest_events(e).first().event == "c"


def test_two_writers_lose_nothing(spark, tmp_path):
    """A commit whose number another writer takes is made on top of that one; staged tables go with their own thread."""
    folder = tmp_path / "docs"
    folder.mkdir()
    for n in "abc":
        (folder / f"{n}.txt").write_text(f"text of file {n} here")
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    indexing.index_folder(one, str(folder))
    put, taken = one._put, []

    def late(path, text, overwrite):
        if not taken and not overwrite:
            taken.append(path)
            indexing.remove_files(two, [str(folder / "a.txt")])
        return put(path, text, overwrite)

    one._put = late
    v = one.version
    indexing.remove_files(one, [str(folder / "b.txt")])
    assert one.version == two.version == v + 2 and taken
    assert [r.filename for r in one.index.documents.collect()] == ["c.txt"]
    # A compaction keeps what was committed while it ran.
    taken.clear()

    def later(path, text, overwrite):
        if not taken and not overwrite:
            taken.append(path)
            indexing.index_folder(two, str(folder))
        return put(path, text, overwrite)

    one._put = later
    one.compact()
    assert sorted(r.filename for r in two.index.documents.collect()) == ["a.txt", "b.txt", "c.txt"]
    assert len(two._manifest()["segments"]) == 2


def test_watcher_takes_folders_as_it_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    w = watch.Watcher(store, str(tmp_path / "checkpoints"), quiet=0.2, poll="200 milliseconds")
    try:
        assert w.stop() and not w.active
        w.follow([str(a)])
        assert w.watches(str(a)) and not w.watches(str(b))
        w.follow([str(a), str(b)])
        assert w.watches(str(b / "x.txt"))
        deadline = time.time() + 60
        while not w.query.recentProgress and time.time() < deadline:
            time.sleep(0.2)
        (b / "x.txt").write_text("written while the stream runs")
        while not store.index.documents.count() and time.time() < deadline:
            time.sleep(0.5)
        assert [r.filename for r in store.index.documents.collect()] == ["x.txt"]
    finally:
        assert w.stop(30) and not w.active
