"""Cutting texts into chunks along paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

from lodestone import config

_PARAGRAPHS = re.compile(r"\n\s*\n")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def estimated(text: str) -> int:
    return max(1, int(len(text.split()) * 1.3))


def _by_sentences(paragraph: str, most: int) -> Iterator[str]:
    """Sentences of one paragraph, packed; each pack starts with the last two sentences of the one before."""
    pack: list[str] = []
    held = 0
    for sentence in filter(None, map(str.strip, _SENTENCES.split(paragraph))):
        n = estimated(sentence)
        if pack and held + n > most:
            yield " ".join(pack)
            pack = pack[-2:]
            held = sum(map(estimated, pack))
        pack.append(sentence)
        held += n
    if pack:
        yield " ".join(pack)


def _packs(text: str, most: int, overlap: int) -> Iterator[str]:
    pack: list[str] = []
    held = 0
    for paragraph in filter(None, map(str.strip, _PARAGRAPHS.split(text))):
        n = estimated(paragraph)
        if pack and (n > most or held + n > most):
            yield "\n\n".join(pack)
            again = n <= most and len(pack) > 1 and estimated(pack[-1]) <= overlap
            pack = pack[-1:] if again else []
            held = estimated(pack[0]) if again else 0
        if n > most:
            yield from _by_sentences(paragraph, most)
        else:
            pack.append(paragraph)
            held += n
    if pack:
        yield "\n\n".join(pack)


def chunked(text: str, most: int = config.CHUNK_TOKENS, overlap: int = config.CHUNK_OVERLAP, first_line: int = 1) -> list[tuple[str, int, int]]:
    """(text, start line, end line) of each chunk.

    Lines are counted over what is emitted, blank lines and overlaps as they
    stand there, so they drift from the source's; a sentence that is longer
    than a chunk stays whole.
    """
    out, line = [], first_line
    for pack in _packs(text or "", most, overlap):
        n = pack.count("\n") + 1
        out.append((pack, line, line + n - 1))
        line += n
    return out
