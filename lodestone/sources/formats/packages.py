"""Files that are containers: office documents, archives, e-books, PDF."""

from __future__ import annotations

import io
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from functools import partial

from .base import Chunk, File, Ocr, cut, decoded, recognised

OFFICE = frozenset(".docx .pptx .xlsx .odt .ods .odp .rtf .doc .ppt .xls".split())
ARCHIVES = frozenset(".zip .tar .gz .tgz .bz2 .xz .epub".split())
#: Entries of an archive and chapters of a book that are read.
ENTRIES, CHAPTERS = 1000, 50
OFFICE_CUT = partial(cut, overlap=50)
ARCHIVE_CUT = partial(cut, overlap=30)

# Name spaces of the formats.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _stripped(nodes) -> list[str]:
    return [x for n in nodes if (x := (n.text or "").strip())]


_MARKS = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}


def _paragraph(p: ET.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{_WORD}t" else _MARKS.get(e.tag, "") for r in p.iter(f"{_WORD}r") for e in r).strip()


def _rows(table: ET.Element) -> Iterator[str]:
    """A line for each row: its cells that hold text. A cell over several columns counts in each, one over several rows in each of these."""
    above: list[str] = []
    for row in table.iterfind(f"{_WORD}tr"):
        cells: list[str] = []
        for cell in row.iterfind(f"{_WORD}tc"):
            text = "\n".join(map(_paragraph, cell.iterfind(f"{_WORD}p"))).strip()
            span = cell.find(f"{_WORD}tcPr/{_WORD}gridSpan")
            down = cell.find(f"{_WORD}tcPr/{_WORD}vMerge")
            if down is not None and down.get(f"{_WORD}val") != "restart" and len(cells) < len(above):
                text = above[len(cells)]
            cells += [text] * (1 if span is None else int(span.get(f"{_WORD}val", "1")))
        above = cells
        yield " | ".join(filter(None, cells))


def _docx(z: zipfile.ZipFile, f: File) -> list[Chunk]:
    """Paragraphs, then the rows of tables."""
    root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{_WORD}body")
    body = root if body is None else body
    blocks = [_paragraph(p) for p in body.iterfind(f"{_WORD}p")]
    blocks += [r for t in body.iterfind(f"{_WORD}tbl") for r in _rows(t)]
    return OFFICE_CUT("\n\n".join(filter(None, blocks)), section_title=f.path.stem)


def _pptx(z: zipfile.ZipFile, f: File) -> list[Chunk]:
    slides = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.match(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for n, (_, name) in enumerate(slides, 1):
        out += OFFICE_CUT("\n".join(_stripped(ET.fromstring(z.read(name)).iter(f"{_DRAWING}t"))), page_number=n, section_title=f"Slide {n}")
    return out


def _xlsx(z: zipfile.ZipFile, f: File) -> list[Chunk]:
    return OFFICE_CUT("\n".join(_stripped(ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}t"))), section_title=f.path.stem)


def _open(z: zipfile.ZipFile, f: File) -> list[Chunk]:
    return OFFICE_CUT("\n\n".join(_stripped(ET.fromstring(z.read("content.xml")).iter())), section_title=f.path.stem)


_ZIPPED = {".docx": _docx, ".pptx": _pptx, ".xlsx": _xlsx, ".odt": _open, ".ods": _open, ".odp": _open}


def rtf_text(source: str) -> str:
    words = re.sub(r"\\[a-zA-Z]+(-?\d+)? ?", " ", source)
    return re.sub(r"\s+", " ", re.sub(r"[{}\\]", "", words)).strip()


def legacy_text(content: bytes) -> str:
    """Runs of five readable bytes or more."""
    runs = (r.decode("utf-8", "ignore").strip() for r in re.findall(rb"[a-zA-Z0-9_\x80-\xff.,\s\-]{5,}", content))
    return "\n".join(r for r in runs if len(r) >= 5 and not r.isnumeric())


def office(f: File) -> list[Chunk]:
    suffix = f.path.suffix.lower()
    if suffix == ".rtf":
        return OFFICE_CUT(rtf_text(f.content.decode("latin-1")), section_title=f.path.stem)
    if suffix not in _ZIPPED:
        return OFFICE_CUT(legacy_text(f.content), section_title=f.path.stem)
    try:
        with zipfile.ZipFile(io.BytesIO(f.content)) as z:
            return _ZIPPED[suffix](z, f)
    except (zipfile.BadZipFile, KeyError, ET.ParseError):
        return []


def _contents(f: File, entries: list[tuple[str, int]]) -> list[Chunk]:
    lines = [f"• {name} ({round(size / 1024, 1)} KB)" for name, size in entries]
    head = [f"Arşiv Dosyası: {f.path.name}", f"Toplam İçerik: {len(lines)} dosya", "Arşiv İçi Dosyalar (Fihrist):"]
    return ARCHIVE_CUT("\n".join(head + lines), section_title=f.path.name)


def _book(z: zipfile.ZipFile) -> list[Chunk]:
    out = []
    for n, name in enumerate([x for x in z.namelist() if x.lower().endswith((".xhtml", ".html", ".htm"))][:CHAPTERS], 1):
        text = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", decoded(z.read(name)))).strip()
        out += ARCHIVE_CUT(text, page_number=n, section_title=f"Bölüm {n} ({name.rsplit('/', 1)[-1].rsplit('.', 1)[0]})")
    return out


def archive(f: File) -> list[Chunk]:
    try:
        if f.path.suffix.lower() in (".zip", ".epub"):
            with zipfile.ZipFile(io.BytesIO(f.content)) as z:
                if f.path.suffix.lower() == ".epub":
                    return _book(z)
                return _contents(f, [(i.filename, i.file_size) for i in z.infolist()[:ENTRIES] if not i.is_dir()])
        with tarfile.open(fileobj=io.BytesIO(f.content), mode="r:*") as t:
            return _contents(f, [(m.name, m.size) for m in t.getmembers()[:ENTRIES] if m.isfile()])
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError):
        return []


def pdf(f: File) -> list[Chunk]:
    """Page by page, where a PDF library is installed; else nothing, and the fallback describes the file."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return []
    out = []
    for n, page in enumerate(PdfReader(io.BytesIO(f.content)).pages, 1):
        text = (page.extract_text() or "").strip()
        if f.ocr and len(text) < SCANNED:
            text = with_scans(text, [i.data for i in page.images], f.ocr)
        out += cut(text, page_number=n, section_title=f"Page {n}")
    return out


# Below so many characters a page counts as scanned; least and most characters of a picture, most of a page; the label.
SCANNED, SCAN_LEAST, SCAN_MOST, PAGE_MOST = 30, 15, 2000, 4000
SCAN_LABEL = "[OCR Sayfa Metni]:"


def with_scans(text: str, pictures: list[bytes], ocr: Ocr) -> str:
    """A page's text with what is read from its pictures."""
    seen = (recognised(ocr, p) for p in pictures)
    said = "\n".join(s[:SCAN_MOST] for s in seen if len(s) >= SCAN_LEAST)[:PAGE_MOST]
    return f"{text}\n\n{SCAN_LABEL}\n{said}".strip() if said else text
