"""The query language: free words and key:value filters.

ext:py,ts  -ext:tmp  path:"app/x"  type:code  after:2026-01-01  before:…  symbol:Name
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, tzinfo

from lodestone import config

# The form of a filter, dates that filters take, and the filters' names.
_PAIR = re.compile(r'(-?\w+):(?:"([^"]+)"|(\S+))')
#: Formats of a day, then those with a time.
DAYS = ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%d.%m.%Y", "%d-%m-%Y")
TIMES = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S")
_KEYS = {
    "ext": "ext", "-ext": "-ext",
    "path": "path", "dir": "path", "folder": "path",
    "type": "type", "kind": "type",
    "after": "after", "since": "after", "from": "after",
    "before": "before", "until": "before", "to": "before",
    "symbol": "symbol", "sym": "symbol",
}


@dataclass(frozen=True)
class Query:
    raw: str = ""
    text: str = ""
    extensions: frozenset[str] = frozenset()
    exclude_extensions: frozenset[str] = frozenset()
    path: str | None = None
    file_type: str | None = None
    after: float | None = None
    before: float | None = None
    symbol: str | None = None

    @property
    def has_filters(self) -> bool:
        return bool(self.extensions or self.exclude_extensions or self.path or self.file_type or self.symbol) or self.after is not None or self.before is not None


def timestamp(s: str, end_of_day: bool = False, zone: tzinfo = UTC) -> float | None:
    """Seconds since the epoch, or None for what is no date."""
    for form in (*DAYS, *TIMES):
        try:
            t = datetime.strptime(s, form).replace(tzinfo=zone)
        except ValueError:
            continue
        return (t.replace(hour=23, minute=59, second=59) if end_of_day and form in DAYS else t).timestamp()
    return None


def _suffixes(value: str) -> set[str]:
    return {e if e.startswith(".") else f".{e}" for e in (x.strip().lower() for x in value.split(",")) if e}


def parse(raw: str) -> Query:
    """Split a query in its words and filters. Unknown keys stay among the words; a bad date or type has no effect."""
    found: dict = {"ext": set(), "-ext": set()}
    words, at = [], 0
    for m in _PAIR.finditer(raw or ""):
        words.append(raw[at : m.start()].strip())
        at = m.end()
        key, value = _KEYS.get(m[1].lower()), (m[2] or m[3]).strip()
        match key:
            case None:
                words.append(m[0])
            case "ext" | "-ext":
                found[key] |= _suffixes(value)
            case "path":
                found["path"] = value.replace("\\", "/").strip("/")
            case "type":
                found["type"] = next((k for k, names in config.TYPE_ALIASES.items() if value.lower() in names), found.get("type"))
            case "after" | "before":
                t = timestamp(value, key == "before")
                found[key] = found.get(key) if t is None else t
            case "symbol":
                found["symbol"] = value
    words.append((raw or "")[at:].strip())
    text = " ".join(w for w in words if w)
    return Query(raw or "", text, frozenset(found["ext"]), frozenset(found["-ext"]), found.get("path") or None, found.get("type"), found.get("after"), found.get("before"), found.get("symbol"))


def matches(q: Query, path: str, extension: str, mtime: float, code_type: str | None = None, symbol_name: str | None = None) -> bool:
    """Whether one row passes the filters; for type:code a suffix of code will do."""
    ext = (extension or "").lower()
    kind = q.file_type
    return (
        (not q.extensions or ext in q.extensions)
        and ext not in q.exclude_extensions
        and (not q.path or q.path.lower() in path.replace("\\", "/").lower())
        and (not kind or ext in config.TYPE_EXTENSIONS[kind] or (kind == "code" and bool(code_type)))
        and (q.after is None or mtime >= q.after)
        and (q.before is None or mtime <= q.before)
        and (not q.symbol or q.symbol.lower() in (symbol_name or "").lower())
    )
