"""A page's branches and blocks of text, read in one pass over its markup."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash

#: Branches are told apart down to so many levels; deeper ones belong to the branch of that level. No text is lost by it.
LEVELS = 64

TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: Elements whose start and end part blocks of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
OTHER_BLOCK = BLOCK - {"p"}
#: Elements that hold plain text of an article, told apart by their tag alone and not by their place.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption tr".split())
#: Stands for text that is in an element of other kinds directly.
TEXT = "#text"
#: What a start tag ends, if it is open, and what it doesn't look beyond.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
CELLS = frozenset(("td", "th", "caption", "table"))
TABLE = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"))

#: Parts of a page that aren't its article, by tag and by the words of class, id and role.
ASIDE_TAGS = frozenset("nav aside form footer button select dialog noscript menu template svg head object textarea search".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disqus footer form gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article articlebody content entry main post story".split())
NOT_WORDS = frozenset(("no", "has", "with", "without"))
#: Headers are of the page, or of the article if they stand in it.
HEADER_TAGS, HEADER_WORDS = frozenset(("header",)), frozenset(("header",))
WHOLE = frozenset(("html", "body", "article", "main", "p", "h1"))


def role(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """aside, article (by its tag), perhaps (an article, by its names) or nothing."""
    if tag in ASIDE_TAGS or "hidden" in attributes or (tag in HEADER_TAGS and not in_article):
        return "aside"
    said = ""
    for name in ("class", "id", "role", "itemprop"):
        for word in attributes.get(name, "").split():
            names = [x.lower() for x in NAMES.findall(word)]
            if not names or names[0] in NOT_WORDS:
                continue
            if any(x in ASIDE_WORDS or (x in HEADER_WORDS and not in_article) for x in names):
                if tag not in WHOLE or tag == "p":
                    return "aside"
                if tag in ARTICLE_TAGS and not ARTICLE_WORDS.intersection(names):
                    return "aside"
            elif ARTICLE_WORDS.intersection(names):
                said = "article"
    if tag in ARTICLE_TAGS:
        return "article"
    return "perhaps" if said and tag not in PLAIN and tag not in ("html", "body") else ""


@dataclass(slots=True)
class Branch:
    """An element as a place in its page: the path of tags, classes and, for those that hold others, ordinals."""

    parent: int
    path: str
    tag: str
    aside: bool
    article: int  # 0: not in one, 1: in one by its names, 2: by its tag
    depth: int
    children: list[str] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)
    texts: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    branches: list[Branch]
    blocks: list[tuple[int, str]]  # branch, text

    def keys(self) -> list[int]:
        """A number for every branch, the same in pages that name their article as well, or that don't."""
        start = "named:" if self.names_article() else ""
        return [xxhash.xxh3_64_intdigest(start + b.path) - (1 << 63) for b in self.branches]

    def names_article(self) -> bool:
        """Whether its markup names an article that has text."""
        return any(self.branches[b].article and not self.branches[b].aside for b, _ in self.blocks)

    def holders(self) -> set[int]:
        """Branches that an article stands in."""
        return {x for i, b in enumerate(self.branches) if b.article and not b.aside for x in self.above(i) if not self.branches[x].article}

    def above(self, b: int) -> list[int]:
        out = []
        while (b := self.branches[b].parent) >= 0:
            out.append(b)
        return out


def read_page(text: str) -> Page:
    """Branches and blocks of a page as browsers would find them, as far as blocks go: unclosed and misnested elements included.

    White space in a block becomes one space; character references are decoded; scripts, styles, comments and markup are passed over.
    """
    branches, blocks, buffer = [Branch(-1, "", "", False, 0, 0)], [], []
    stack: list[tuple[str, int]] = [("", 0)]
    known: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()
    marked = 0  # inline elements on the stack, which are there only for their role

    def below(at: int, own: str, tag: str, said: str) -> int:
        parent = branches[at]
        if parent.depth >= LEVELS:
            return at
        key = (at, own)
        if key not in known:
            known[key] = len(branches)
            article = max(parent.article, {"article": 2, "perhaps": 1}.get(said, 0))
            branches.append(Branch(at, f"{parent.path}/{own}", tag, parent.aside or said == "aside", article, parent.depth + 1))
        if not parent.children or parent.children[-1] != own:
            parent.children.append(own)
        return known[key]

    def flush() -> None:
        if buffer:
            if found := " ".join("".join(buffer).split()):
                here = stack[-1][1]
                if branches[here].tag not in PLAIN:
                    here = below(here, TEXT, TEXT, "")
                blocks.append((here, found))
                branches[here].texts.append(found)
            buffer.clear()

    def cut(at: int) -> None:
        nonlocal marked
        flush()
        for tag, _ in stack[at:]:
            opened[tag] -= 1
            marked -= tag not in BLOCK
        del stack[at:]

    def close(tags: tuple[str, ...], stop: tuple[str, ...] | frozenset[str]) -> None:
        if any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    return cut(i)
                if stack[i][0] in stop:
                    return None

    def start(tag: str, raw: str) -> None:
        nonlocal marked
        attributes = {}
        if raw and not raw.isspace():
            for m in ATTRIBUTE.finditer(raw):
                attributes.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        if tag not in HEAD and opened["head"]:
            close(("head",), ())
        if tag in BLOCK:
            flush()
            if tag in ENDS:
                close(*ENDS[tag])
            if tag not in TABLE or tag == "table":
                close(("p",), OTHER_BLOCK)
        elif tag in VOID:
            buffer.append(" ") if tag == "br" else flush() if tag == "hr" else None
            return
        parent = branches[stack[-1][1]]
        said = role(tag, attributes, parent.article)
        if tag not in BLOCK and not marked and said != "aside":
            return
        if tag not in BLOCK:
            flush()
            marked += 1
        names = sorted(re.sub(r"\d+", "0", x) for x in attributes.get("class", "").split())
        own = tag + "".join(f".{x}" for x in names) + (f"#{re.sub(r'[0-9]+', '0', attributes['id'])}" if attributes.get("id") else "")
        if own == tag and tag not in PLAIN and tag not in ("html", "body", "head"):
            parent.count[tag] += 1
            own = f"{tag}[{parent.count[tag]}]"
        stack.append((tag, below(stack[-1][1], own, tag, said)))
        opened[tag] += 1

    def end(tag: str) -> None:
        if tag == "p" or tag in BLOCK or opened[tag]:
            flush()
        close((tag,), () if tag in TABLE else CELLS)

    position, last = 0, text.rfind(">") + 1
    while m := TAG.search(text, position, last):
        if m.start() > position:
            buffer.append(html.unescape(text[position : m.start()]))
        position = m.end()
        if m.group().startswith("<!--") and not m.group().endswith(("-->", "--!>", "<!-->")):
            position = len(text)  # a comment without an end
            break
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                end(tag)
            else:
                start(tag, m[3])
                if tag in RAW:
                    stop = RAW[tag].search(text, position)
                    position = stop.start() if stop else len(text)
                    if position >= last:
                        break
    buffer.append(html.unescape(re.split(r"<(?=[a-zA-Z/!?])", text[position:], maxsplit=1)[0]))
    flush()
    return Page(branches, blocks)
