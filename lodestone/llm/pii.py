"""Personal data, also in disguise, with places in the source text.

Base patterns run on the text as it is. Then a transducer rewrites disguises
(look-alike characters, digits in words, "at" and "dot" written out) and keeps
for each piece of its output the piece of the source it came from; detectors
run on the output, and spans that touch a rewritten piece are mapped back.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrays, pieces

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Possessive and anchored at the start of a run of digits: the same matches, and linear on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from their @: the local part is the run before it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def ips(text: str) -> list[Span]:
    return [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]


def plain(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and then start."""
    out = emails(text)
    if _DIGIT.search(text):
        out += ips(text) + cards(text) + phones(text)
    return out


# -- disguises ---------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "℮": "e",
    "﹫": "@", "․": ".", "。": ".", "｡": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-", "﹢": "+", "﬩": "+",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}


def _more_lookalikes() -> dict[str, str]:
    """Full-width forms, mathematical letters and the digits of every script, by their Unicode data."""
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in [*range(0x0660, 0x10000), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)]:
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind == "Nd":
            out[ch] = str(unicodedata.decimal(ch))
        elif c >= 0x1D400 and kind in ("Lu", "Ll"):
            flat = unicodedata.normalize("NFKC", ch)
            if len(flat) == 1 and flat.isascii():
                out[ch] = flat
        elif 0x2460 <= c <= 0x2468:
            out[ch] = str(c - 0x245F)
    return out


GLYPHS = _more_lookalikes() | LOOKALIKES
#: Digits in words.
NUMBERS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Consecutive digits in words that are taken as digits, whatever they show.
SPELLED = 4

_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_AT = rf"\s{{0,3}}{_OPEN}\s{{0,3}}(?:at|@|arroba|ät|chez)\s{{0,3}}{_CLOSE}\s{{0,3}}"
_DOT = rf"\s{{0,3}}{_OPEN}\s{{0,3}}(?:dot|\.|punkt|point|punto|dt)\s{{0,3}}{_CLOSE}\s{{0,3}}"
_NUMBER = "(?:" + "|".join(NUMBERS) + ")"
_RUN = rf"(?<![A-Za-z])(?:plus[\s-]+)?{_NUMBER}(?:[\s,.-]{{1,2}}{_NUMBER}){{{SPELLED - 1},}}(?![A-Za-z])"
#: Domains that end an address in words; those that are English words are left out.
_TOP = "(?:com|org|net|edu|gov|mil|info|biz|io|co|dev|app|ai|de|fr|es|uk|eu|ca|ch|nl|ru|jp|cn|br|au|pl|se|fi|dk|cz|pt|kr|mx|tr)"
#: name at host dot tld, all in words: "at" counts only with a written-out dot and a known domain behind it.
_WORDY = r"(?<=[A-Za-z0-9_])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:(?:\s{1,3}dot\s{1,3}|\.)[A-Za-z0-9-]{1,63}){0,4}\s{1,3}dot\s{1,3}" + _TOP + r"(?![A-Za-z]))"
_WORDY_DOT = r"(?<=[A-Za-z0-9_])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9])"
#: "at" before a host written with dots: prose has it too (look at example.com), so what stands before it decides (`_is_name`).
_HOST = r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\." + _TOP + r"(?![A-Za-z0-9-])"
_PERHAPS = rf"(?<=[A-Za-z0-9_])\s{{1,3}}at\s{{1,3}}(?={_HOST})"
_PERHAPS_RE = re.compile(rf"\bat\s{{1,3}}{_HOST}", re.IGNORECASE)
_HOST_RE = re.compile(_HOST, re.IGNORECASE)
#: What may be the name before "at": its last word, and the words before it on the line.
_NAME_RE = re.compile(r"(?P<before>[^\n]*?)(?P<name>[A-Za-z0-9._%+-]+(?:\s{1,3}dot\s{1,3}[A-Za-z0-9._%+-]+)*)\Z", re.IGNORECASE)
#: Words that announce an address, and words that stand before "at" in prose.
_CUES = frozenset("mail email e-mail mails contact contacts write reach address addr mailto send courriel correo".split())
_PROSE = frozenset("""a an and are arrive available based be been blog book buy came code come contact docs download email found free get go good had hand has help here him her hosted i information is it join
join launched learn live located look looked looking mail me meet more now off on online only open or order out page pages published read register report see shop sign site start stay store
support team that the them there these they this time today up us video visit was watch we website were with work working write you""".split())
_GLYPH_RE = re.compile("[" + "".join(map(re.escape, GLYPHS)) + "]")
#: A class of few ranges that holds all of them: quick to search, for most texts have none.
_RARE = re.compile("[\xa0\xad\u0131\u0250-\U0010ffff]")
_BRACKET = re.compile(rf"{_OPEN}\s{{0,3}}(?:at|@|arroba|ät|chez|dot|\.|punkt|point|punto|dt)\s{{0,3}}{_CLOSE}", re.IGNORECASE)
_SIGN = re.compile(rf"(?P<at>{_AT}|{_WORDY})|(?P<perhaps>{_PERHAPS})|(?P<dot>{_DOT}|{_WORDY_DOT})", re.IGNORECASE)
_RUN_RE = re.compile(_RUN, re.IGNORECASE)
_NUMBER_RE = re.compile(_NUMBER, re.IGNORECASE)
_ITEM = rf"(?:{_NUMBER}(?![A-Za-z])|[0-9]++)"
_ITEM_RE = re.compile(_ITEM, re.IGNORECASE)
#: Number words and digits in any order.
_MIXED_RE = re.compile(rf"(?<![A-Za-z0-9])(?P<plus>plus[\s-]+)?\+?\(?{_ITEM}(?:[\s,.()-]{{1,3}}{_ITEM})++", re.IGNORECASE)
#: Letters in lower case, a space for all else.
_LETTERS = bytes(c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
_NUMBER_WORDS = [f" {w} ".encode() for w in NUMBERS]


class Rewritten:
    """The transducer's output and where each piece of it came from."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.sources, self.changed = [0], [(0, len(text))], [False]

    def then(self, pattern: re.Pattern, by) -> Rewritten:
        """Rewrite what matches; places stay those of the first source."""
        return self.edit((m.start(), m.end(), new) for m in pattern.finditer(self.text) if (new := by(m)) is not None)

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> Rewritten:
        """Rewrite pieces (start, end, new text), given in order."""
        out, parts, at, pos = Rewritten(""), [], 0, 0
        out.starts, out.sources, out.changed = [], [], []

        def put(s: str, source: tuple[int, int], changed: bool) -> None:
            nonlocal at
            out.starts.append(at)
            out.sources.append(source)
            out.changed.append(changed)
            parts.append(s)
            at += len(s)

        def copy(a: int, b: int) -> None:
            """What lies between matches, piece by piece."""
            i = bisect.bisect_right(self.starts, a) - 1
            while a < b:
                end = self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text)
                e = min(b, end)
                if e > a:
                    s, t = self.sources[i]
                    put(self.text[a:e], (s, t) if self.changed[i] else (s + a - self.starts[i], s + e - self.starts[i]), self.changed[i])
                a, i = e, i + 1

        for start, end, new in edits:
            copy(pos, start)
            put(new, self.source(start, end), True)
            pos = end
        copy(pos, len(self.text))
        out.text = "".join(parts)
        return out

    def _at(self, i: int) -> int:
        return bisect.bisect_right(self.starts, i) - 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        a, b = self._at(start), self._at(end - 1)
        s, e = self.sources[a][0], self.sources[b][1]
        if not self.changed[a]:
            s += start - self.starts[a]
        if not self.changed[b]:
            e = self.sources[b][0] + end - self.starts[b]
        return s, e

    def touched(self, start: int, end: int) -> bool:
        return any(self.changed[self._at(start) : self._at(end - 1) + 1])


def _is_name(m: re.Match) -> bool:
    """Whether what stands before an "at" in words is a user's name: by its form, a word that announces it, or as it stands alone."""
    name = _NAME_RE.search(m.string, max(0, m.start() - 80), m.start())
    if not name:
        return False
    word = name["name"].strip(".-")
    if re.search("[A-Za-z]", word) and re.search(r"[0-9._%+-]|\sdot\s", word, re.IGNORECASE):
        return True
    if word.lower() in _PROSE or not re.search("[A-Za-z]", word):
        return False
    before = re.findall(r"[^\s:;,()<>\[\]\"']+", name["before"].lower())[-3:]
    if any(w in _CUES for w in before):
        return True
    end = _HOST_RE.match(m.string, m.end()).end()
    after = m.string[end : end + 2].lstrip(".")[:1]
    return name["before"].strip(" \t(<[\"':") == "" and (after in ")>]\"'\n")


def _sign(m: re.Match) -> str | None:
    if m["perhaps"]:
        return "@" if _is_name(m) else None
    return "@" if m["at"] else "."


def _spelled(m: re.Match) -> str:
    word = m[0].lower()
    return ("+" if word.startswith("plus") else "") + "".join(NUMBERS[w.lower()] for w in _NUMBER_RE.findall(m[0]))


def _edits(run: re.Match, dots: bool) -> list[tuple[int, int, str]]:
    """Number words of a run as digits; what joins two of them goes, but for single dots if they are to stay."""
    out, before, word = [], run.start(), False
    if run["plus"]:
        before += len(run["plus"])
        out.append((run.start(), before, "+"))
    for m in _ITEM_RE.finditer(run[0], before - run.start()):
        start, end = run.start() + m.start(), run.start() + m.end()
        number = NUMBERS.get(m[0].lower())
        gap = run.string[before:start]
        if word and number and gap and not (dots and gap == "."):
            out.append((before, start, ""))
        elif (word or number) and "," in gap:
            out.append((before, start, " "))
        if number:
            out.append((start, end, number))
        before, word = end, bool(number)
    return out


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Edits of the runs of number words, digits and dots that show an address, card or phone only with words as digits."""
    out = []
    for run in _MIXED_RE.finditer(text):
        if not _NUMBER_RE.search(run[0]):
            continue
        had = [len(f(run[0])) for f in (ips, cards, phones)]
        for dots in (True, False):
            edits = _edits(run, dots)
            parts, pos = [], run.start()
            for start, end, new in edits:
                parts += [text[pos:start], new]
                pos = end
            read = "".join([*parts, text[pos : run.end()]])
            if any(len(f(read)) > n for f, n in zip((ips, cards, phones), had, strict=True)):
                out += edits
                break
    return out


def disguised(text: str) -> list[Span]:
    """Spans that only the rewritten text shows, in places of the source."""
    r = Rewritten(text)
    if not text.isascii() and _RARE.search(text) and _GLYPH_RE.search(text):
        r = r.then(_GLYPH_RE, lambda m: GLYPHS[m[0]])
    letters = b" " + r.text.encode().translate(_LETTERS) + b" "
    if b" dot " in letters or _BRACKET.search(r.text) or (b" at " in letters and _PERHAPS_RE.search(r.text)):
        r = r.then(_SIGN, _sign)
    if any(w in letters for w in _NUMBER_WORDS):
        if edits := _numbers(r.text):
            r = r.edit(edits)
        # A long run of words is read as digits in any case; what was rewritten holds no words any more.
        r = r.then(_RUN_RE, _spelled)
    return [(kind, *r.source(s, e)) for kind, s, e in plain(r.text) if r.touched(s, e)] if any(r.changed) else []


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans; and all spans: the base ones and what disguises hid.

    A hidden span that overlaps a base one is kept only if it holds it and is longer.
    """
    base = plain(text)
    extra = disguised(text)
    if extra:
        taken = sorted((s, e) for _, s, e in base)
        starts = [s for s, _ in taken]

        def new(s: int, e: int) -> bool:
            # Base spans of different kinds may overlap one another, so a few before are looked at as well.
            near = taken[max(0, bisect.bisect_left(starts, s) - 8) : bisect.bisect_left(starts, e)]
            return all(b <= s or (s <= a and b <= e and (a, b) != (s, e)) for a, b in near)

        extra = [x for x in dict.fromkeys(extra) if new(x[1], x[2])]
    return base, sorted([*base, *extra], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: counts of the base patterns, digest of their spans, all spans.

    In: doc_id, text (further columns are not read). A null or empty text has
    no span. Spans are kind:start:end in code points of the source, end
    exclusive, by kind (email, ip, card, phone) and start. Repeated rows give
    a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, s = pa.int64(), pa.string()
        out = pa.schema([("doc_id", i), *((f"n_{k}", i) for k in KINDS), ("base_sha256", s), ("spans", s)])
        for whole in batches:
            for b in pieces(whole):
                rows = []
                for t in b.column(1).to_pylist():
                    base, spans = find(t or "")
                    counts = [sum(x[0] == k for x in base) for k in KINDS]
                    rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
                yield arrays(out, [b.column(0), *map(list, zip(*rows, strict=True))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact_text(text: str) -> str:
    """Each span gives way to its kind in brackets; of overlapping spans the union does, named after the first."""
    spans = sorted(find(text)[1], key=lambda x: (x[1], -x[2]))
    if not spans:
        return text
    out, pos, i = [], 0, 0
    while i < len(spans):
        kind, s, e = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < e:
            e = max(e, spans[i][2])
            i += 1
        out += [text[pos:s], f"[{kind.upper()}]"]
        pos = e
    return "".join([*out, text[pos:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs, personal data replaced in text (a null one stays); n_chars, if there, follows text."""
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                old = b.column(at).to_pylist()
                new = [None if t is None else redact_text(t) for t in old]
                cols = list(b.columns)
                cols[at] = pa.array(new, type=b.schema.field(at).type)
                if count is not None:
                    was = b.column(count).to_pylist()
                    cols[count] = pa.array([len(t) if t is not None and t != o else n for t, o, n in zip(new, old, was, strict=True)], type=b.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
