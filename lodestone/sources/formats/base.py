"""What every format gives: chunks with their places and symbols."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from lodestone import config
from lodestone.functions.chunking import chunked


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    line_number: int


@dataclass
class Chunk:
    text: str
    page_number: int | None = None
    section_title: str | None = None
    code_type: str | None = None
    symbol_name: str | None = None
    start_line: int | None = None
    end_line: int | None = None
    symbols: list[Symbol] = field(default_factory=list)


#: The text in a picture, given as the content of its file.
Ocr = Callable[[bytes], str]


@dataclass(frozen=True)
class File:
    """A file's content and what the listing knows of it; companions are subtitles beside a video; ocr reads pictures, if given."""

    path: PurePosixPath
    content: bytes
    size: int
    mtime: float
    companions: tuple[tuple[str, bytes], ...] = ()
    ocr: Ocr | None = None

    @property
    def text(self) -> str:
        return decoded(self.content)


def recognised(ocr: Ocr, picture: bytes) -> str:
    """What ocr reads; nothing if it fails, as one bad picture must not cost the file."""
    try:
        return (ocr(picture) or "").strip()
    except Exception:  # noqa: BLE001
        return ""


def decoded(content: bytes, encoding: str = "utf-8", errors: str = "replace") -> str:
    """As text files are read: bad bytes replaced, line ends made one."""
    return content.decode(encoding, errors).replace("\r\n", "\n").replace("\r", "\n")


def cut(text: str, most: int = config.CHUNK_TOKENS, overlap: int = config.CHUNK_OVERLAP, first_line: int = 1, symbols: list[Symbol] | None = None, **more) -> list[Chunk]:
    return [Chunk(t, start_line=a, end_line=b, symbols=list(symbols or []), **more) for t, a, b in chunked(text, most, overlap, first_line)]
