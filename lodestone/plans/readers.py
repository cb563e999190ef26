"""Queries over the readers: files made from every customer, one of each format, and in SQL the chunks that these must give."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans import library as L
from lodestone.plans.registry import query
from lodestone.sources import routing

COLUMNS = ("k", "name", "chunk_index", "section_title", "text", "start_line", "end_line", "page_number", "code_type", "symbol_name", "symbols")


@dataclass(frozen=True)
class Part:
    """A chunk. Texts hold {K}, {N}, {S} and {s}: a customer's key, name and segment, and that in small letters. symbols: kind:name:line, separated by blanks."""

    section_title: str | None
    text: str
    start_line: int = 1
    end_line: int = 1
    page_number: int | None = None
    code_type: str | None = None
    symbol_name: str | None = None
    symbols: str = ""


@dataclass(frozen=True)
class Made:
    """A file made from a customer: its text, or the entries of a zip archive; and its chunks."""

    name: str
    content: str | dict[str, str]
    parts: tuple[Part, ...]


_HOLES = {"{K}": "CAST(c_custkey AS VARCHAR)", "{N}": "c_name", "{S}": "c_mktsegment", "{s}": "lower(c_mktsegment)"}
FOLDER = "/home/crm/{S}/files"


def _filled(template: str) -> Column:
    out = F.lit(template)
    for hole, by in zip(_HOLES, (F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"), F.lower("c_mktsegment")), strict=True):
        out = F.replace(out, F.lit(hole), by)
    return out


def _literal(v: str | int | None, type_: str) -> str:
    if v is None:
        return f"CAST(NULL AS {type_})"
    if isinstance(v, int):
        return str(v)
    out = "'" + v.replace("'", "''") + "'"
    for hole, by in _HOLES.items():
        if hole in v:
            out = f"replace({out}, '{hole}', {by})"
    return out


def _oracle(files: list[Made]) -> str:
    types = {"section_title": "VARCHAR", "page_number": "INTEGER", "code_type": "VARCHAR", "symbol_name": "VARCHAR"}
    each = []
    for f in files:
        for i, p in enumerate(f.parts):
            values = {"name": f.name, "chunk_index": i, **vars(p)}
            each.append("SELECT c_custkey AS k, " + ", ".join(f"{_literal(values[c], types.get(c, ''))} AS {c}" for c in COLUMNS[1:]) + " FROM customer")
    return "\nUNION ALL ".join(each)


def _zipped(files: DataFrame) -> DataFrame:
    """files with entries (name, text) as archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contents = []
            for entries in pdf["entries"]:
                b = io.BytesIO()
                with zipfile.ZipFile(b, "w") as z:
                    for e in entries:
                        z.writestr(e["name"], e["text"])
                contents.append(b.getvalue())
            yield pdf.drop(columns="entries").assign(content=contents)

    return files.mapInPandas(run, "k long, path string, content binary")


def _read(spark, sf: str, files: list[Made]) -> DataFrame:
    c = L.table(spark, sf, "customer")
    out = None
    for f in files:
        at = c.select("*", F.col("c_custkey").cast("long").alias("k"), _filled(f"{FOLDER}/{f.name}").alias("path"))
        if isinstance(f.content, dict):
            entries = F.array(*(F.struct(_filled(n).alias("name"), _filled(t).alias("text")) for n, t in f.content.items()))
            at = _zipped(at.select("k", "path", entries.alias("entries")))
        else:
            at = at.select("k", "path", F.encode(_filled(f.content), "UTF-8").alias("content"))
        out = at if out is None else out.unionByName(at)
    out = out.withColumn("size_bytes", F.octet_length("content").cast("long")).withColumn("mtime", F.lit(L.EPOCH))
    keys = out.select(routing.document_id(F.col("path")).alias("doc_id"), "k", T.filename(F.col("path")).alias("name"))
    chunks = routing.read_files(out.select("path", "content", "size_bytes", "mtime")).join(keys, "doc_id")
    said = F.array_join(F.transform("symbols", lambda s: F.concat_ws(":", s["kind"], s["name"], s["line_number"].cast("string"))), " ")
    return chunks.withColumn("symbols", said).select(*COLUMNS)


def _register(name: str, *files: Made) -> None:
    query(name, _oracle(list(files)))(lambda spark, sf: _read(spark, sf, list(files)))


_register(
    "markdown_sections",
    Made(
        "note_{K}.md",
        "about {K}\n# {N}\nfirst\nline\n## {S}\nsecond\n#### deep\n\nthird\n##no heading\n# Last  \n\n## Empty\nend",
        (
            Part("Introduction", "about {K}"),
            Part("{N}", "first\nline", 3, 4),
            Part("{N} > {S}", "second", 6, 6),
            Part("{N} > {S} > deep", "third\n##no heading", 8, 9),
            Part("Last > Empty", "end", 14, 14),
        ),
    ),
)
_register(
    "table_rows",
    Made("rows_{K}.csv", 'name, segment,key\n"{N}","a, {S}",{K}\n,,\n{N}, ,,more\n', (Part("rows_{K}", "Row 1: name: {N} | segment: a, {S} | key: {K}\nRow 3: name: {N} | Col_3: more", 1, 2),)),
    Made("rows_{K}.tsv", "name\tkey\n{N}\t{K}\n", (Part("rows_{K}", "Row 1: name: {N} | key: {K}"),)),
)
_register(
    "data_files",
    Made("data_{K}.json", '{"name":"{N}","ş":[{K},true,null],"none":{}}', (Part("data_{K}", '{\n  "name": "{N}",\n  "ş": [\n    {K},\n    true,\n    null\n  ],\n  "none": {}\n}', 1, 9),)),
    Made("data_{K}.yaml", "z: {S}\na: [x, '{N}']\n", (Part("data_{K}", "a:\n- x\n- {N}\nz: {S}", 1, 4),)),
    Made("data_{K}.toml", 'name = "{N}"\n[of]\nkey = {K}\n', (Part("data_{K}", '{\n  "name": "{N}",\n  "of": {\n    "key": {K}\n  }\n}', 1, 6),)),
    Made("data_{K}.xml", "<r> <a>{N}</a>tail<b x='1'> {S} </b><c/></r>", (Part("data_{K}", "{N}\n{S}", 1, 2),)),
    Made("broken_{K}.json", '{"name": {N}', (Part("broken_{K}", '{"name": {N}'),)),
    Made("plain_{K}.txt", "{N}\r\n{S}\r\n\r\n\r\nend", (Part("plain_{K}", "{N}\n{S}\n\nend", 1, 4),)),
)
_register(
    "subtitle_text",
    Made("film_{K}.srt", "1\n00:00:01,000 --> 00:00:02,500\n{\\an8}<i>{N}</i>  says\n\n2\n00:00:03,000 --> 00:00:04,000\n{S} 7\n", (Part("Altyazı: film_{K}.srt", "{N} says\n\n{S} 7", 1, 3),)),
    Made("film_{K}.vtt", "00:00:01.000 --> 00:00:02.500\n{N}\n", (Part("Altyazı: film_{K}.vtt", "{N}"),)),
)
_register(
    "code_symbols",
    Made(
        "m_{K}.py",
        "import os\n\n\nclass C{K}:\n    def get(self):\n        return 1\n\n\nasync def f{K}(x):\n    return x\n",
        (
            Part(None, "class C{K}:\n    def get(self):\n        return 1", 4, 6, None, "python", "C{K}", "class:C{K}:4"),
            Part(None, "def get(self):\n        return 1", 5, 6, None, "python", "get", "function:get:5"),
            Part(None, "async def f{K}(x):\n    return x", 9, 10, None, "python", "f{K}", "async_function:f{K}:9"),
        ),
    ),
    Made("m_{K}.sh", "export V{K}=1\nrun_{K}() {\n  true\n}\nalias a{K}='ls'", (Part(None, "export V{K}=1\nrun_{K}() {\n  true\n}\nalias a{K}='ls'", 1, 5, None, "shell", None, "variable:V{K}:1 function:run_{K}:2 alias:a{K}:5"),)),
    Made("m_{K}.cpp", "#include <v{K}.h>\nstruct S{K} {\n};\nint f{K}(int x) {\n  if (x) {\n", (Part(None, "#include <v{K}.h>\nstruct S{K} {\n};\nint f{K}(int x) {\n  if (x) {", 1, 5, None, "cpp", None, "import:v{K}.h:1 struct:S{K}:2 function:f{K}:4"),)),
    Made("m_{K}.ts", "import x from 'm{K}'\nexport class K{K} {}\nfunction g{K}(x) {}", (Part(None, "import x from 'm{K}'\nexport class K{K} {}\nfunction g{K}(x) {}", 1, 3, None, "typescript", None, "import:m{K}:1 class:K{K}:2 function:g{K}:3"),)),
    Made("m_{K}.sql", "CREATE TABLE t{K} (x INT);\ncreate view v{K} as select 1", (Part(None, "CREATE TABLE t{K} (x INT);\ncreate view v{K} as select 1", 1, 2, None, "sql", None, "table:t{K}:1 view:v{K}:2"),)),
)
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
_tc = "<w:tc>{}</w:tc>".format
_register(
    "office_text",
    Made("o_{K}.docx", {"word/document.xml": f"<w:document {_W}><w:body>{_p('{N}')}<w:tbl><w:tr>{_tc(_p('{K}'))}{_tc(_p(''))}{_tc(_p('{S}'))}</w:tr></w:tbl>{_p('end')}</w:body></w:document>"}, (Part("o_{K}", "{N}\n\nend\n\n{K} | {S}", 1, 5),)),
    Made("o_{K}.pptx", {"ppt/slides/slide10.xml": f"<s {_A}><a:t>{{S}}</a:t></s>", "ppt/slides/slide2.xml": f"<s {_A}><a:t>{{N}}</a:t><a:t> x </a:t></s>"}, (Part("Slide 1", "{N}\nx", 1, 2, 1), Part("Slide 2", "{S}", 1, 1, 2))),
    Made("o_{K}.xlsx", {"xl/sharedStrings.xml": f"<sst {_X}><si><t>{{N}}</t></si><si><t>{{S}}</t></si></sst>"}, (Part("o_{K}", "{N}\n{S}", 1, 2),)),
    Made("o_{K}.odt", {"content.xml": "<d><p>{N}<s>{S}</s></p></d>"}, (Part("o_{K}", "{N}\n\n{S}", 1, 3),)),
    Made("o_{K}.rtf", "{\\rtf1\\ansi \\b Client {K}\\b0\\par {S}}", (Part("o_{K}", "Client {K} {S}"),)),
    Made("o_{K}.doc", "\x01\x02Client of {S}\x03ab\x04", (Part("o_{K}", "Client of {S}"),)),
)
_register(
    "archive_text",
    Made("a_{K}.zip", {"in/{N}.txt": "", "b.bin": "x" * 2048}, (Part("a_{K}.zip", "Arşiv Dosyası: a_{K}.zip\nToplam İçerik: 2 dosya\nArşiv İçi Dosyalar (Fihrist):\n• in/{N}.txt (0.0 KB)\n• b.bin (2.0 KB)", 1, 5),)),
    Made("b_{K}.epub", {"text/one.xhtml": "<h1>{N}</h1><p>of  {S}</p>", "two.html": "<p>{K}</p>", "style.css": "p{}"}, (Part("Bölüm 1 (one)", "{N} of {S}", 1, 1, 1), Part("Bölüm 2 (two)", "{K}", 1, 1, 2))),
)
_register(
    "described_files",
    Made("red_robotArm_{K}.blend", "\x01\x02", (Part("red_robotArm_{K}.blend", "Dosya Adı: red_robotArm_{K}.blend\nDosya Türü: Blender 3D Projesi / Modeli\nKlasör Konumu: home > crm > {S} > files\nBoyut: 2 Bayt | Son Değiştirilme: 2023-11-14 22:13:20\nAnlamsal Etiketler: red, robot, arm, home, crm, {s}, files", 1, 5),)),
    Made("v_{K}.svg", "<svg><title>{N}</title><g><text> {S} </text></g></svg>", (Part("v_{K}.svg", "SVG Vektör Görseli: v_{K}.svg\n\nİsim Etiketleri: v {K}\n\nİçerik Metinleri:\n{N}\n{S}", 1, 4),)),
)
