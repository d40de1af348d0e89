"""Main text of web pages by equivalence-class template deduction.

A page's tokens are its tags and the strings between them, each with its path from the root. Over the pages of a host, tokens that occur equally often on every page
(equal occurrence vectors) form an equivalence class. A class is valid when it is frequent (on at least ``frequent`` of the pages), large (``large`` tokens or more) and
its tags open and close like brackets. Valid classes nest by where their tokens stand, and make up the host's template; several layouts of a host give
classes of their own. What lies between template tokens are slots: a string that belongs to the template, on three pages at least (two, if the host has no more), is no main text.

Slots outside of boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments, by element or by class name) compete by their prose, words outside of links: the
richest is main text, and so are those with more than a quarter of its words. An article element, or what a main element has outside of articles, is a slot as others are, but may share strings with other pages; a small
article beside a rich slot is a card and goes. Where no article or main part is rich enough, all other slots with more prose than links stay. A page that its host's template doesn't fit,
or whose host has one page, has slots by its own tags, and a page whose slots are all empty keeps what isn't boilerplate: no page loses its text to the template. A class name is of boilerplate if it's such a word or ends in one
(``site-footer``), not if it mentions one (``has-sidebar``, ``no-comments``); it never drops what's around the page's only article or main part, nor a header inside an article.

Occurrence vectors aren't gathered: two sums over the pages of a hash of (page, count) stand for each, which partial aggregation keeps to a row a token and task.

Defined cases: a null html is empty, with no text; a null url is a host of its own kind, shared by all such pages; repeated rows are pages of their own; unclosed and
misnested tags are closed as browsers do for the common cases; a tag whose quotes don't end is over at its first ``>``; empty tables and other columns are harmless. Time
stays in proportion to a page's length, whatever its markup.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

#: Shares and counts: pages that a class must be on, tokens that it must have, pages that its strings must be on.
FREQUENT, LARGE, STRING_SHARE, STRING_PAGES = 0.2, 2, 0.5, 3
#: Hosts up to which their templates (a few KB each) are broadcast; beyond, pages and templates are joined by a shuffle on the host.
BROADCAST_HOSTS = 2_000

#: Fixed values of HTML: elements without content, those that end a paragraph or an item of their kind, those that end a line of text, raw ones.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCKS - frozenset("head html body title caption dd dt li option tbody td tfoot th thead tr legend summary".split())
ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS_OWN = frozenset("ul ol dl table select menu".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
#: Elements and class, id or role words of what isn't main text.
BOILERPLATE = frozenset("nav footer aside form script style noscript template iframe button select textarea menu dialog head title object svg canvas".split())
WORDS_OF_BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Words that name boilerplate only as a whole name (a job-search or share-price is content), those of headings inside an article, and those of parts that hold articles of others.
WHOLE_ONLY, HEADERS, OF_OTHERS = frozenset(("search", "share")), frozenset(("header", "masthead")), frozenset("comment comments disqus related replies reply".split())
#: Parts by which a name only mentions another part.
MODIFIERS = frozenset("has have with without no not hide hides show shows".split())
MAIN = ("article", "main")
#: Elements that hold blocks, between which slots lie; the share of the richest slot's words beyond which another is main text too.
HOLDS_BLOCKS, LEAST_SHARE = frozenset("address article aside body center details dialog div fieldset figure footer form header main nav section td th".split()), 0.25

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[\"'>]")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_SCOPES = frozenset(("p", "button", "table")) | HOLDS_OWN | frozenset(ENDS_OWN)


class Node(NamedTuple):
    """A tag or a stretch of text of a page, in order."""

    token: int  # of a tag: a hash of the elements and marks down to it, inverted for an end tag; of text: of the element around it and the string
    kind: str  # "open", "close", "void" or "text"
    name: str
    text: str  # or a tag's mark


class Tag(NamedTuple):
    """A tag or comment in the page's text; ``name`` is empty for what has no element."""

    start: int
    end: int
    name: str
    closing: bool
    attrs: str


def tags(page: str) -> Iterator[Tag]:
    """The page's markup, in order, in one pass: quotes that a try has found not to end are not tried again."""
    last = {c: page.rfind(c) for c in "\"'>"}
    dead: set[int] = set()

    def tag_end(p: int) -> int:
        """The place of the ``>`` that ends a tag, outside of quotes; the first one where quotes don't end; -1 without any."""
        opened, q = [], p
        while q <= max(last.values()):
            m = _STOP.search(page, q)
            if m[0] == ">":
                return m.start()
            if m.start() in dead or last[m[0]] <= m.start():
                break
            opened.append(m.start())
            q = page.find(m[0], m.start() + 1) + 1
        dead.update(opened)
        return page.find(">", p) if last[">"] >= p else -1

    at = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield Tag(at, end, "", False, "")
            at = end
            continue
        closing = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + closing)
        if m is None:
            if page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < len(page):
                end = page.find(">", at) + 1 if last[">"] >= at else len(page)
                yield Tag(at, end, "", False, "")
                at = end
            else:
                at += 1
            continue
        end = tag_end(m.end())
        if end < 0:
            at += 1
            continue
        name = m[0].lower()
        yield Tag(at, end + 1, name, closing, page[m.end() : end])
        at = end + 1
        if name in RAW and not closing:
            found = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            stop = found.end() if found else len(page)
            yield Tag(at, stop, "", False, "")
            at = stop


def mark_of(attrs: str) -> str:
    """Sorted words of class, id and role; none with digits, which number things."""
    if "=" not in attrs:
        return ""
    found = {w for m in _MARK.finditer(attrs) for w in (m[1] or m[2] or m[3] or "").lower().split() if not any(c.isdigit() for c in w)}
    return ".".join(sorted(found))


def _hash(around: int, what: str) -> int:
    """A positive 62-bit number, even."""
    return int.from_bytes(hashlib.blake2b(what.encode("utf-8", "replace"), digest_size=8, key=around.to_bytes(8, "big")).digest(), "big") >> 1 & ~1


_paths: dict[tuple[int, str], int] = {}


def _path(around: int, what: str) -> int:
    if len(_paths) > 50_000:
        _paths.clear()
    found = _paths.get((around, what))
    if found is None:
        found = _paths[around, what] = _hash(around, what)
    return found


class _Open:
    """The open elements, with what is needed to find those that a tag ends without looking through all."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()
        self.scopes: list[tuple[str, int]] = []  # name and place of the elements of _SCOPES

    @property
    def path(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def push(self, name: str, token: int) -> None:
        if name in _SCOPES:
            self.scopes.append((name, len(self.stack)))
        self.stack.append((name, token))
        self.count[name] += 1

    def pop(self) -> Node:
        name, token = self.stack.pop()
        self.count[name] -= 1
        if self.scopes and self.scopes[-1][1] == len(self.stack):
            self.scopes.pop()
        return Node(~token, "close", name, "")

    def ended_by(self, name: str) -> int:
        """How many elements stay open when ``name`` begins."""
        if name in ENDS_P and self.count["p"]:
            found = next((s for s in reversed(self.scopes) if s[0] in ("p", "button", "table")), None)
            if found and found[0] == "p":
                return found[1]
        keep = len(self.stack)
        for scope, place in reversed(self.scopes) if name in ENDS_OWN else ():
            if scope in HOLDS_OWN:
                break
            if scope in ENDS_OWN[name]:
                keep = place
                if name != "tr":
                    break
        return keep


def nodes(page: str | None) -> Iterator[Node]:
    """The page's tags and text; end tags that the page leaves out are supplied where the next tag shows it."""
    page, at, now = page or "", 0, _Open()
    for tag in tags(page):
        if tag.start > at:
            yield Node(now.path, "text", "", page[at : tag.start])
        at, name = tag.end, tag.name
        if not name:
            continue
        if tag.closing:
            if now.count[name]:
                while now.stack[-1][0] != name:
                    yield now.pop()
                yield now.pop()
            elif name == "p":  # an end tag alone
                yield Node(_path(now.path, "p"), "void", "p", "")
            continue
        for _ in range(len(now.stack) - now.ended_by(name)):
            yield now.pop()
        mark = mark_of(tag.attrs)
        token = _path(now.path, f"{name}.{mark}")
        if name in VOID or name in RAW or tag.attrs.endswith("/"):
            yield Node(token, "void", name, mark)
        else:
            now.push(name, token)
            yield Node(token, "open", name, mark)
    if at < len(page):
        yield Node(now.path, "text", "", page[at:])
    while now.stack:
        yield now.pop()


def string_token(node: Node) -> int:
    """The token of a string, odd; 0 for white space."""
    words = " ".join(node.text.split())
    return _hash(node.token & (1 << 63) - 1, words) | 1 if words else 0


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TOKENS = "host string, token long, pages long, total long, v1 long, v2 long, place double"


def _occurrences(pages: DataFrame) -> DataFrame:
    """Of each batch and host: every token's pages, count, vector sums and places; token 0 counts the pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts, first = {0: 1}, {0: -1}
                for place, node in enumerate(nodes(page)):
                    token = string_token(node) if node.kind == "text" else node.token
                    if token:
                        counts[token] = counts.get(token, 0) + 1
                        first.setdefault(token, place)
                own = int.from_bytes(hashlib.blake2b(f"{url}\0{page}".encode("utf-8", "replace"), digest_size=8).digest(), "big")
                vectors: dict[int, tuple[int, int]] = {}
                for rank, (token, n) in enumerate((t, counts[t]) for t in first):
                    if n not in vectors:
                        h = int.from_bytes(hashlib.blake2b(n.to_bytes(8, "big"), digest_size=8, key=own.to_bytes(8, "big")).digest(), "big")
                        vectors[n] = h & 0x7FFFFFFF, h >> 31 & 0x7FFFFFFF
                    row = sums.setdefault((host, token), [0, 0, 0, 0, 0.0])
                    row[0] += 1
                    row[1] += n
                    row[2] += vectors[n][0]
                    row[3] += vectors[n][1]
                    row[4] += rank
            columns = list(zip(*((*k, *v) for k, v in sums.items()), strict=True)) or [[]] * 7
            kinds = (pa.string(), *[pa.int64()] * 5, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "token", "pages", "total", "v1", "v2", "place"])

    return pages.mapInArrow(run, TOKENS)


def nests(tokens: list[int]) -> bool:
    """Whether a class's tags, in the order of their places, open and close like brackets: no end tag before its start, no part crossing another."""
    seen, open_now, at = set(tokens), [], Counter()
    for t in tokens:
        if t < 0:
            if at[~t]:
                while (top := open_now.pop()) != ~t:
                    at[top] -= 1
                at[~t] -= 1
            elif ~t in seen:
                return False
        elif not t & 1:
            open_now.append(t)
            at[t] += 1
    return True


def _valid(classes: DataFrame) -> DataFrame:
    """The classes (members: array of (place, token), in order) whose tags nest."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([nests([m["token"] for m in members]) for members in batch.column("members").to_pylist()], pa.bool_()))

    return classes.mapInArrow(run, classes.schema)


def templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", frequent: float = FREQUENT, large: int = LARGE, string_share: float = STRING_SHARE, string_pages: int = STRING_PAGES) -> DataFrame:
    """A row per host: host, tokens (array): the tokens of its valid classes, in page order."""
    seen = _occurrences(pages.select(host_of(F.col(url_col)).alias("host"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    summed = seen.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "v1", "v2", "place")])
    summed = stored(summed.where("pages > 1 or token = 0"), "tokens")
    hosts = summed.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    is_string = (F.col("token") > 0) & (F.col("token") % 2 == 1)
    # On a host of two pages a string on both is of the template.
    least = F.when(is_string, F.greatest(F.least(F.lit(string_pages), F.greatest(F.lit(2), F.col("host_pages"))), string_share * F.col("host_pages"))).otherwise(frequent * F.col("host_pages"))
    often = summed.where("token <> 0").join(hosts, "host").where(F.col("pages") >= least)
    # Few tokens are on a fifth of the pages, so a host's classes are small.
    classes = often.groupBy("host", "pages", "total", "v1", "v2").agg(F.array_sort(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("members"))
    valid = _valid(classes.where(F.size("members") >= large).select("host", "members"))
    return valid.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("members")).select("host", F.col("members.token").alias("tokens"))


def marked(mark: str, inside: bool) -> str | None:
    """The word by which class, id and role names are of boilerplate: a whole name, or the last part of one without a modifier; header-like ones not inside an article."""
    for name in mark.split("."):
        parts = _PART.findall(name)
        if not parts or MODIFIERS.intersection(parts):
            continue
        word = parts[-1]
        if word in WORDS_OF_BOILERPLATE and (len(parts) == 1 or word not in WHOLE_ONLY) and not (inside and word in HEADERS):
            return word
    return None


class Layout(NamedTuple):
    """What a page has of boilerplate and main parts, by the places of their start tags."""

    dropped: frozenset[int]  # boilerplate, by element or mark
    opened: frozenset[str]  # names of the main parts outside of it
    around: frozenset[int]  # marked elements around a main part that the page has nowhere else
    others: frozenset[int]  # those of them that are made for articles of others, as comments are


def layout(parts: list[Node]) -> Layout:
    dropped: set[int] = set()
    opened: set[str] = set()
    hidden: dict[str, dict[int, str]] = {name: {} for name in MAIN}
    stack: list[tuple[int, str, str | None]] = []
    inside = elements = 0
    marks: dict[int, str] = {}  # open marked elements
    for i, node in enumerate(parts):
        if node.kind == "open":
            element, word = node.name in BOILERPLATE or node.name == "header" and not inside, None
            if not element and node.name not in ("html", "body", *MAIN):
                word = marked(node.text, inside > 0)
            if node.name in MAIN and not elements:
                if marks:
                    if next(reversed(marks)) not in hidden[node.name]:
                        hidden[node.name].update(marks)
                else:
                    opened.add(node.name)
            if element or word:
                dropped.add(i)
            if word:
                marks[i] = word
            inside += node.name in MAIN
            elements += element
            stack.append((i, node.name, "element" if element else word))
        elif node.kind == "close":
            k, name, why = stack.pop()
            inside -= name in MAIN
            elements -= why == "element"
            marks.pop(k, None)
    found = {} if "article" in opened else hidden["article"] | (hidden["main"] if "main" not in opened else {})
    return Layout(frozenset(dropped), frozenset(opened), frozenset(found), frozenset(k for k, word in found.items() if word in OF_OTHERS))


class Template(NamedTuple):
    """What a host's valid classes have: strings, and start tags."""

    strings: frozenset[int]
    tags: frozenset[int]


EMPTY = Template(frozenset(), frozenset())


def template_of(tokens: Iterable[int] | None) -> Template:
    tokens = list(tokens or ())
    return Template(frozenset(t for t in tokens if t > 0 and t & 1), frozenset(t for t in tokens if t > 0 and not t & 1))


def main_text(page: str | None, template: Template | Iterable[int]) -> str:
    """Blocks of the slots of a template, or of a host's tokens, that are main text, one a line."""
    template = template if isinstance(template, Template) else template_of(template)
    parts = list(nodes(page))
    own = layout(parts)
    kept = own.dropped - (own.around - own.others)
    return _text(parts, kept, template) or _text(parts, kept, EMPTY) or _text(parts, own.dropped - own.around, EMPTY)


def _slots(parts: list[Node], dropped: frozenset[int], template: Template) -> dict[int, list]:
    """By the place of the tag that opens it (-1: none), each slot's kind (article, main, or empty), its words of prose, those in links, and the places of its strings.

    A slot is what lies between neighbouring tags of the template that hold blocks; without a template, between the page's own. An outermost article is one whatever the
    template, and so is what a main part has outside of articles. A string of the template is no text, but in an article or main part, where pages may share what they say.
    """
    found: dict[int, list] = {}
    slot, kind, out, links = -1, "", 0, 0
    stack: list[tuple[bool, int, str, bool]] = []
    for i, node in enumerate(parts):
        if node.kind == "text":
            if not out and (kind or not template.strings or string_token(node) not in template.strings):
                own = found.setdefault(slot, [kind, 0, 0, []])
                own[2 if links else 1] += len(node.text.split())
                own[3].append(i)
        elif node.kind == "open":
            stack.append((i in dropped, slot, kind, node.name == "a"))
            out, links = out + stack[-1][0], links + stack[-1][3]
            if node.name == "article" and kind != "article" or node.name == "main" and not kind:
                slot, kind = i, node.name
            elif not kind and node.name in HOLDS_BLOCKS and (not template.tags or node.token in template.tags):
                slot = i
        elif node.kind == "close":
            gone, slot, kind, link = stack.pop()
            out, links = out - gone, links - link
    return found


def _chosen(slots: dict[int, list]) -> set[int]:
    """The strings of the slots that are main text: of those with a fair share of the prose that the richest has; if none of these is an article or main part, also of all
    others but articles that are mere cards, and lists of links."""
    best = max((prose for _, prose, _, _ in slots.values()), default=0)
    rich = {k for k, (_, prose, links, _) in slots.items() if prose > LEAST_SHARE * best and prose >= links}
    if not any(slots[k][0] for k in rich):
        rich |= {k for k, (kind, prose, links, _) in slots.items() if not kind and prose > links}
    return {i for k in rich or slots for i in slots[k][3]}


def _text(parts: list[Node], dropped: frozenset[int], template: Template) -> str:
    """Blocks of the chosen strings."""
    chosen = _chosen(_slots(parts, dropped, template))
    blocks: list[str] = []
    now: list[str] = []

    def ended() -> None:
        text = " ".join(_html.unescape("".join(now)).split())
        now.clear()
        if text:
            blocks.append(text)

    for i, node in enumerate(parts):
        if node.kind == "text":
            if i in chosen:
                now.append(node.text)
        elif node.name in BLOCKS:
            ended()
        elif node.name == "br":
            now.append(" ")
    ended()
    return "\n".join(blocks)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS, **how) -> DataFrame:
    """A row per page: page_id, url, text, n_chars. ``how``: see ``templates``."""
    known = stored(templates(pages, url_col=url_col, html_col=html_col, **how), "templates")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    rows = rows.join(F.broadcast(known) if known.count() <= broadcast_hosts else known, "host", "left").select("page_id", "url", "html", "host", "tokens")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, Template] = {}
        for batch in batches:
            texts = []
            listed = batch.column("tokens")
            for k, (page, host) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)):
                if host not in sets:
                    if len(sets) > 256:
                        sets.clear()
                    sets[host] = template_of(listed[k].as_py())
                texts.append(main_text(page, sets[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
