"""Main text of web pages by the consensus of a host.

Each page is parsed to containers and text blocks, and votes for the
tag-class path of the container that holds its text. Votes are added up per
host in Spark; every page is then extracted by its host's winning paths. A
page that has none of them, or hardly any text there, keeps its own choice.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrays, materialize, pieces

#: Elements whose text is not read.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title xmp noembed noframes".split())
#: Elements that are not the article, with all they hold.
DROPPED = frozenset("head nav footer aside menu button select datalist dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("td th".split())
#: A start tag of the key ends an open element of the values, up to the nearest BOUNDARY.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("html body table ul ol dl article section main div td th aside nav header footer form blockquote".split())

#: Words in class, id or role that mark what is not the article.
MARKS = frozenset("""ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices alert
nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets footer footnav masthead topbar toolbar skip
comment comments commentlist disqus replies respond reader-comments share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchform copyright
complementary contentinfo search-form toc tags hidden""".split())
#: Words beside a mark that make a name say something of the page, not of the element.
SAYS = frozenset("no non not has have with without hide free less enabled disabled".split())
#: Words that mark a container of the article.
HINTS = frozenset("article articles content post entry story main body text page-content article-body post-content entry-content".split())

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|[!?/](?P<bogus>[^>]*)(?:>|\Z)|(?P<cut>/?[a-zA-Z].*)\Z)""", re.DOTALL)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.IGNORECASE)
_SPLIT = re.compile(r"[\s_:]+|-+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


#: What stands between the steps of a path; no tag or class holds it.
JOINT = " "


@dataclass
class Page:
    """Containers (last step of the path, hash of the whole path, parent) and blocks (container, text, characters in links) in page order.

    A path is only written out for the container that a page votes for: all of
    them would take the square of the depth.
    """

    steps: list[str] = field(default_factory=lambda: [""])
    keys: list[int] = field(default_factory=lambda: [0])
    parents: list[int] = field(default_factory=lambda: [0])
    hinted: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def add(self, parent: int, step: str, hinted: bool) -> int:
        self.steps.append(step)
        self.keys.append(hash((self.keys[parent], step)))
        self.parents.append(parent)
        self.hinted.append(hinted)
        return len(self.steps) - 1

    def path(self, at: int) -> str:
        steps = []
        while at:
            steps.append(self.steps[at])
            at = self.parents[at]
        return JOINT.join(reversed(steps))


def path_key(path: str) -> int:
    """The hash that a container of that path has in a Page (of the same process: strings' hashes differ between them)."""
    key = 0
    for step in path.split(JOINT) if path else ():
        key = hash((key, step))
    return key


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs.strip(" /") else {}


def _marks(a: dict[str, str]) -> tuple[bool, bool]:
    """Whether class, id or role mark what is not the article; whether they hint at the article.

    A name counts by its first or last word (ad-banner, left-sidebar), but not
    one that says that something is or isn't there (has-sidebar, ad-free).
    """
    marked = hinted = False
    for k in ("class", "id", "role"):
        for name in a.get(k, "").split():
            words = [w.lower() for w in _SPLIT.split(name) if w]
            if name.lower() in HINTS or any(w in HINTS for w in words):
                hinted = True
            if name.lower() in MARKS:
                marked = True
            elif words and words[0] not in SAYS and words[-1] not in SAYS and (words[0] in MARKS or words[-1] in MARKS):
                marked = True
    return marked, hinted


def _step(tag: str, a: dict[str, str]) -> str:
    """A step of a path: the tag and its classes, numbers generalised."""
    names = sorted({_DIGITS.sub("#", c.lower()) for c in a.get("class", "").split()})
    return ".".join([tag, *names])


def parse(text: str) -> Page:
    """Containers and blocks of a page, without what is never the article.

    A form's text goes with it, unless it is half of the page's or more: some
    sites wrap whole pages in a form.
    """
    page = Page()
    #: tag, its container, whether its text is dropped, whether it is in a link, the form it is in
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    opened: Counter[str] = Counter()
    #: Characters in each form (0: in none), those in forms within it not among them; the form of each block.
    forms, form_of = [0], []
    buffer: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            block = " ".join("".join(buffer).split())
            if block:
                page.blocks.append((stack[-1][1], block, min(links, len(block))))
                form_of.append(stack[-1][4])
                forms[stack[-1][4]] += len(block)
            buffer.clear()
        links = 0

    def cut(k: int) -> None:
        for s in stack[k:]:
            opened[s[0]] -= 1
        del stack[k:]

    def close(tag: str) -> None:
        """Pop up to the last open one of that tag; an inline end tag doesn't reach across a container."""
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                if tag in BLOCKS or tag in CELLS:
                    flush()
                cut(k)
                return
            if stack[k][0] in BOUNDARY and tag not in BOUNDARY:
                return

    pos, n = 0, len(text)
    while pos < n:
        at = text.find("<", pos)
        m = None
        while at >= 0 and (m := _TAG.match(text, at)) is None:
            at = text.find("<", at + 1)
        stop = at if at >= 0 else n
        if stop > pos and not stack[-1][2]:
            piece = html.unescape(text[pos:stop])
            buffer.append(piece)
            if stack[-1][3]:
                links += len(piece.strip())
        if m is None:
            break
        pos = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        tag, attrs = name.lower(), m["attrs"] if m["name"] else m["attrs2"]
        if m["end"] or m["end2"]:
            close(tag)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                e = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(text, pos)
                pos = e.end() if e else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[k][0] == "p":
                    cut(k)
                    break
                if stack[k][0] in BOUNDARY:
                    break
        elif tag in CELLS:
            buffer.append(" ")
        if tag in ENDS and any(opened[t] for t in ENDS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS[tag]:
                    cut(k)
                    break
                if stack[k][0] in BOUNDARY and not (tag in CELLS and stack[k][0] in CELLS):
                    break
        _, container, dropped, in_link, form = stack[-1]
        if tag in ("body", "html") and opened[tag]:
            continue
        a = _attributes(attrs)
        marked, hinted = _marks(a) if a else (False, False)
        if tag == "body":
            dropped = False
        elif not dropped:
            dropped = (
                tag in DROPPED
                or (tag == "label" and form > 0)
                or (tag == "header" and not opened["article"] and not opened["main"])
                or (tag not in ("html", "main") and marked)
                or "hidden" in a
                or a.get("aria-hidden", "").lower() == "true"
                or "display:none" in a.get("style", "").replace(" ", "").lower()
            )
        if tag in CONTAINERS and not dropped:
            container = page.add(container, _step(tag, a), tag in ("article", "main") or hinted)
        if tag == "form":
            forms.append(0)
            form = len(forms) - 1
        stack.append((tag, container, dropped, in_link or tag == "a", form))
        opened[tag] += 1
    flush()
    if len(forms) > 1:
        half = sum(forms) / 2
        page.blocks = [b for b, f in zip(page.blocks, form_of, strict=True) if not f or forms[f] >= half]
    return page


def best(page: Page) -> tuple[int, float]:
    """The container that holds the text, and its score: from the root down while one child holds most of it.

    An article or main is taken whole: its title and lead may stand outside the child that holds most of its text.
    """
    own = [0.0] * len(page.steps)
    for container, block, links in page.blocks:
        own[container] += max(0, len(block) - 2 * links)
    total = own[:]
    for i in range(len(total) - 1, 0, -1):
        total[page.parents[i]] += total[i]
    children: dict[int, list[int]] = {}
    for i in range(1, len(total)):
        children.setdefault(page.parents[i], []).append(i)
    at = 0
    while at in children and page.steps[at].split(".")[0] not in ("article", "main"):
        score, child = max((total[c] * (1.3 if page.hinted[c] else 1.0), -c) for c in children[at])
        child = -child
        if total[child] <= 0 or total[child] < (0.5 if page.hinted[child] else 0.85) * total[at]:
            break
        at = child
    return at, total[at]


def text_in(page: Page, roots: set[int]) -> str:
    """The blocks under any of the containers, in page order."""
    inside = [i in roots for i in range(len(page.steps))]
    for i in range(1, len(inside)):
        inside[i] = inside[i] or inside[page.parents[i]]
    return "\n\n".join(block for container, block, _ in page.blocks if inside[container])


def extract_page(text: str, winners: list[str]) -> str:
    """By the first winning path that the page has; by its own best container if that holds under `LEAST` as much."""
    page = parse(text)
    own = text_in(page, {best(page)[0]})
    for path in winners:
        key = path_key(path)
        roots = {i for i, k in enumerate(page.keys) if k == key}
        if roots and len(found := text_in(page, roots)) >= LEAST * len(own):
            return found
    return own


#: Text under a winning path that a page needs, against its own choice; less is taken for another template.
LEAST = 0.75
#: A path wins with at least this share of its host's votes.
SHARE = 0.2


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes, chars: each page votes for its best container's path (added up in each batch first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64()), ("chars", pa.int64())])
        for whole in batches:
            count: dict[tuple[str, str], list[int]] = {}
            for host, text in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True):
                page = parse(text or "")
                at, score = best(page)
                if score > 0:
                    c = count.setdefault((host, page.path(at)), [0, 0])
                    c[0] += 1
                    c[1] += int(score)
            if count:
                yield arrays(out, [[h for h, _ in count], [p for _, p in count], [v for v, _ in count.values()], [s for _, s in count.values()]])

    raw = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html"))
    local = raw.mapInArrow(run, "host string, path string, votes long, chars long")
    return local.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))


def consensus(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """host, winners: its paths with at least that share of its votes, most votes first (at most 1 / share)."""
    v = votes(pages)
    by = Window.partitionBy("host")
    won = v.withColumn("all", F.sum("votes").over(by)).where(F.col("votes") >= share * F.col("all"))
    order = F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), F.col("path").alias("path"))
    return won.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("o")).select("host", F.col("o.path").alias("winners"))


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    In: page_id, url, html (further columns are not read). A null or empty
    html, or one without text, gives an empty text; a null or odd url counts
    as the host "". Repeated rows give a row each (and vote each). The
    table of winners is written first, so that Spark joins it by its measured
    size: broadcast if small, else sorted by host with skewed hosts split.
    """
    winners = materialize(consensus(pages, share), "hosts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        for whole in batches:
            for b in pieces(whole):
                texts = [extract_page(h or "", w or []) for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield arrays(out, [b.column(0), b.column(1), texts, list(map(len, texts))])

    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of())
    return raw.join(winners, "host", "left").select("page_id", "url", "html", "winners").mapInArrow(run, "page_id long, url string, text string, n_chars long")
