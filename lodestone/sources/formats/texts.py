"""Plain and marked-up texts, data files and subtitles."""

from __future__ import annotations

import csv
import json
import re
import xml.etree.ElementTree as ET
from functools import partial
from html.parser import HTMLParser

from .base import Chunk, File, cut

TEXT = frozenset(".txt .log .ini .cfg .conf .tex .rst .json .yaml .yml .toml .csv .tsv .xml".split())
MARKDOWN, HTML, SUBTITLES = frozenset((".md", ".markdown")), frozenset((".html", ".htm")), frozenset((".srt", ".vtt", ".sub", ".ass"))
#: Rows of a table that are read.
TABLE_ROWS = 500

_HEADING = re.compile(r"(#{1,6})\s+(.+)")


def markdown(f: File) -> list[Chunk]:
    """A section for each heading, titled by the path of headings above it."""
    trail: list[tuple[int, str]] = []
    sections: list[tuple[str, int, list[str]]] = [("Introduction", 1, [])]
    for n, line in enumerate(f.text.splitlines(keepends=True), 1):
        if m := _HEADING.fullmatch(line.strip()):
            trail = [h for h in trail if h[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
            sections.append((" > ".join(t for _, t in trail), n + 1, []))
        else:
            sections[-1][2].append(line)
    return [c for title, first, lines in sections for c in cut("".join(lines).strip(), first_line=first, section_title=title)]


class _Text(HTMLParser):
    """Text with a line end at block tags; one flag is enough for what is left out."""

    SKIPPED = frozenset(("script", "style", "noscript", "svg"))
    BREAKS = frozenset(("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr"))

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.title: list[str] = []
        self.in_title = self.skipping = False

    def _mark(self, tag: str, on: bool) -> None:
        if tag == "title":
            self.in_title = on
        elif tag in self.SKIPPED:
            self.skipping = on
        elif tag in self.BREAKS or (on and tag == "br"):
            self.parts.append("\n")

    def handle_starttag(self, tag, attrs):
        self._mark(tag, True)

    def handle_endtag(self, tag):
        self._mark(tag, False)

    def handle_data(self, data):
        if not self.skipping:
            (self.title if self.in_title else self.parts).append(data)


def collapsed(text: str) -> str:
    """Runs of blanks as one, runs of blank lines as one."""
    return re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def html_text(source: str) -> tuple[str, str]:
    """Title and text."""
    p = _Text()
    try:
        p.feed(source)
    except AssertionError:  # of the parser, for some broken declarations; what was read before counts
        pass
    return "".join(p.title).strip(), collapsed("".join(p.parts))


def html(f: File) -> list[Chunk]:
    title, text = html_text(f.text)
    return cut(text, section_title=title or f.path.stem)


def _json(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


def _yaml(text: str) -> str:
    import yaml

    return yaml.dump(yaml.safe_load(text), allow_unicode=True, default_flow_style=False)


def _toml(text: str) -> str:
    import tomllib

    return json.dumps(tomllib.loads(text), indent=2, ensure_ascii=False)


def _xml(text: str) -> str:
    return "\n".join(x for e in ET.fromstring(text).iter() if (x := (e.text or "").strip()))


def tabular(text: str, delimiter: str = ",") -> str:
    """A line for each row, cells named by the header; empty cells are left out."""
    rows = list(csv.reader(text.splitlines()[:TABLE_ROWS], delimiter=delimiter))
    if not rows:
        return text
    head = [h.strip() for h in rows[0]]
    name = lambda i: head[i] if i < len(head) else f"Col_{i}"
    lines = []
    for n, row in enumerate(rows[1:], 1):
        cells = [f"{name(i)}: {c.strip()}" for i, c in enumerate(row) if c.strip()]
        if cells:
            lines.append(f"Row {n}: " + " | ".join(cells))
    return "\n".join(lines) or text


_SHAPES = {".json": _json, ".yaml": _yaml, ".yml": _yaml, ".toml": _toml, ".xml": _xml, ".csv": tabular, ".tsv": partial(tabular, delimiter="\t")}


def plain(f: File) -> list[Chunk]:
    text = f.text
    shape = _SHAPES.get(f.path.suffix.lower())
    if shape:
        try:
            text = shape(text) or text
        except Exception:  # noqa: BLE001  a file that isn't what its suffix says is read as it stands
            pass
    return cut(text, overlap=40, section_title=f.path.stem)


_CUES = (
    (re.compile(r"\d{2}:\d{2}:\d{2}[,\.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[,\.]\d{3}"), ""),
    (re.compile(r"^\s*\d+\s*$", re.MULTILINE), ""),
    (re.compile(r"\{[^}]+\}"), ""),
    (re.compile(r"<[^>]+>"), ""),
)


def spoken(text: str) -> str:
    """What is said: no times, cue numbers, styles or tags."""
    for pattern, by in _CUES:
        text = pattern.sub(by, text)
    return collapsed(text)


def subtitles(f: File) -> list[Chunk]:
    return cut(spoken(f.text), most=350, overlap=30, section_title=f"Altyazı: {f.path.name}")
