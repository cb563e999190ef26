"""Text functions, as Columns and (for query strings) in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import config

UPPER, LOWER = "A-ZĞÜŞİÖÇ", "a-zğüşıöç"
WORD = "[a-z0-9_ğüşıöç]+"
ALNUM = "[a-z0-9ğüşıöç]"
#: Runs of a camel-case word. What follows a run of capitals is a capitalised word or no word character.
CAMEL = rf"[{UPPER}]?[{LOWER}0-9]+|[{UPPER}]+(?=[{UPPER}][{LOWER}]|(?![\p{{L}}\p{{N}}_]))"
MIN_LEN = 2

# -- Columns ------------------------------------------------------------------


def fold(c: Column) -> Column:
    """Lower case with the Turkish I: İ -> i, I -> ı."""
    return F.lower(F.translate(c, "İI", "iı"))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _valid(t: Column, remove_stop_words: bool, min_len: int) -> Column:
    """Long enough and no stop word. That a token holds a letter or digit follows from the patterns."""
    ok = F.length(t) >= min_len
    return ok & ~t.isin(*config.STOP_WORDS) if remove_stop_words else ok


def tokens(text: Column, split_symbols: bool = True, remove_stop_words: bool = True, min_len: int = MIN_LEN) -> Column:
    """Distinct words of a text in order; parts of camel-case and snake-case words too.

    If all would be dropped (stop words, short words), the raw words stay.
    Repeated words go first, so that what follows runs once a distinct word.
    """
    text = F.coalesce(text, F.lit(""))
    good = lambda t: _valid(t, remove_stop_words, min_len)
    words = F.array_distinct(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0)))
    raw = F.filter(F.transform(words, lambda t: F.btrim(t, F.lit("_"))), lambda t: t != "")
    if split_symbols:
        camel = F.filter(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(CAMEL), F.lit(0))), fold), good)
        # Few texts have an underscore; for the others raw words are taken as they are.
        parts = F.flatten(F.transform(raw, lambda t: F.when(t.contains("_"), F.concat(F.array(t), F.filter(F.split(t, "_"), lambda p: (p != "") & good(p)))).otherwise(F.filter(F.array(t), good))))
        kept = F.concat(camel, F.when(text.contains("_"), parts).otherwise(F.filter(raw, good)))
    else:
        kept = F.filter(raw, good)
    return F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(raw))


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word, at least one."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * F.lit(1.3)).cast("int"))


def snippet(text: Column, query: str, most: int = config.SNIPPET_CHARS) -> Column:
    """The window round the first word of the query; the head if none occurs."""
    words = [w for w in dict.fromkeys(re.findall(WORD, query.lower())) if w]
    head = F.concat(strip(F.substring(text, 1, most)), F.lit("..."))
    if not words:
        return F.when(F.length(text) <= most, strip(text)).otherwise(head)
    low = F.lower(text)
    places = [F.when((p := F.locate(w, low)) > 0, p) for w in words]
    first = F.least(*places) if len(places) > 1 else places[0]
    start = F.greatest(F.lit(0), first - 1 - config.SNIPPET_LEAD)
    end = F.least(F.length(text), start + most)
    window = F.concat(F.when(start > 0, "...").otherwise(""), strip(text.substr(start + 1, F.lit(most))), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= most, strip(text)).when(first.isNull(), head).otherwise(window)


def head_snippet(text: Column, most: int = 300) -> Column:
    return F.concat(strip(F.substring(text, 1, most)), F.when(F.length(text) > most, "...").otherwise(""))


def highlight(text: Column, query: str) -> Column:
    """Words of the query, of two characters or more, marked."""
    words = [re.sub(r"([^\w\s])", r"\\\1", w) for w in query.split() if len(w) > 1]
    return F.regexp_replace(text, "(?i)(" + "|".join(words) + ")", "<mark>$1</mark>") if words else text


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last suffix in lower case; none for a name that only starts with its dot."""
    return F.lower(F.regexp_extract(filename(path), r"^.+(\.[^.]+)$", 1))


def contains_ci(c: Column, part: str) -> Column:
    """Substring test that folds ASCII letters only."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, up, low).contains(part.translate(str.maketrans(up, low)))


def human_size(size: Column) -> Column:
    """Bytes, KB or MB with the unit."""
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024 * 1024, F.format_string("%.1f KB", F.bround(size / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(size / (1024 * 1024), 1)))


def duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", (s / 60).cast("long"), s % 60)


def path_keywords(path: Column, folders: int = 4) -> Column:
    """Words of the name and the last folders, camel and snake case split, distinct."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - folders), F.lit(folders + 1))
    stem = F.regexp_replace(F.array_join(last, " "), r"\.[^. ]+$", "")
    spaced = F.regexp_replace(F.regexp_replace(stem, rf"(?<=[{LOWER}0-9])(?=[{UPPER}])", " "), r"[_\-.\s]+", " ")
    return F.array_distinct(F.filter(F.split(F.trim(spaced), " "), lambda w: F.length(w) > 1))


# -- numbers ------------------------------------------------------------------


def idf(df: Column, n: Column) -> Column:
    """Okapi's, not below 0; 0 for an empty corpus."""
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1.0)))


def bm25_weight(idf_: Column, tf: Column, length: Column, mean: Column, k1: float = config.BM25_K1, b: float = config.BM25_B) -> Column:
    return idf_ * (tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * (length / mean))))


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1.0


def recency(mtime: Column, now: float) -> Column:
    age = F.lit(float(now)) - mtime
    (week, high), (month, low) = config.RECENT
    return F.when(age <= week, high).when(age <= month, low).otherwise(0.0)


def calibrated(score: Column, floor: float = config.SEMANTIC_FLOOR) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - floor) / (1.0 - floor)))


def min_max(x: Column, low: Column, high: Column, n: Column) -> Column:
    """To [0, 1]; a single value or equal ones are clamped to it instead."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when((n <= 1) | (high == low), clamped).otherwise((x - low) / (high - low))


# -- query strings ------------------------------------------------------------

_PY_CAMEL = re.compile(rf"[{UPPER}]?[{LOWER}0-9]+|[{UPPER}]+(?=[{UPPER}][{LOWER}]|\b)")


def fold_text(s: str) -> str:
    return "".join("i" if c == "İ" else "ı" if c == "I" else c.lower() for c in s)


def camel_parts(text: str) -> list[str]:
    """The parts of names in camel case, as they are written."""
    return _PY_CAMEL.findall(text)


def tokens_of(text: str, split_symbols: bool = True, remove_stop_words: bool = True, min_len: int = MIN_LEN) -> list[str]:
    """What `tokens` gives, for a string on the driver."""
    stop = frozenset(config.STOP_WORDS) if remove_stop_words else frozenset()
    good = lambda t: len(t) >= min_len and t not in stop and bool(re.search(ALNUM, t))
    raw = [t for t in (w.strip("_") for w in re.findall(WORD, fold_text(text or ""))) if t]
    out: list[str] = []
    if split_symbols:
        out += [t for t in map(fold_text, camel_parts(text or "")) if good(t)]
    for t in raw:
        if split_symbols and "_" in t:
            out += [t, *[p for p in t.split("_") if p and good(p)]]
        elif good(t):
            out.append(t)
    return list(dict.fromkeys(out or [t for t in raw if re.search(ALNUM, t)]))
