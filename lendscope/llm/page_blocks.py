"""Text blocks of an HTML page, with what its markup says about them.

A block is the text between two block-level tags, references decoded, white space (line breaks too) one
space. Each block has a level (3: in an article; 2: in a main part; 1: in an element whose class or
identifier names content; 0: elsewhere) and tells whether its markup declares it to be no content: menus,
headers, footers, sidebars, notices, adverts, forms, reader comments and what is not shown. Scripts,
styles, comments of the markup and the head have no blocks. Unclosed and stray tags are allowed.
"""

from __future__ import annotations

import functools
import html as references
import re

ARTICLE, MAIN, NAMED, PLAIN = 3, 2, 1, 0

# ---- fixed values: elements and words of class names, as HTML and common usage have them ----

#: Elements whose content is no text: skipped up to their end tag.
RAW = frozenset("script style title textarea template noscript iframe noembed noframes xmp svg math canvas object audio video select datalist head".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are no content themselves.
CHROME_TAGS = frozenset("nav footer aside form dialog menu button search fieldset label".split())
#: Elements that break text into blocks.
BREAKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    header hgroup hr html li legend main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption button label""".split()
)
#: What an opening tag closes, and the elements beyond which it closes nothing.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words of a class or identifier that declare an element to be no content.
CHROME_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner nav navbar navigation menu menus
    breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay
    share sharing social related recommended newsletter subscribe subscription signup signin login register search form pagination pager widget widgets
    skip disclaimer copyright""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: These do so only outside articles.
HEADER_WORDS = frozenset(["header", "head"])
CONTENT_WORDS = frozenset("content article post entry story main".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())

TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
REST = re.compile(r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>")
TOLD = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop|aria-hidden|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?![\w-])", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Whether an element is content or not, by what: nothing, its class, or its tag, role or comments.
NOTHING, BY_CLASS, FIRM = 0, 1, 2


@functools.lru_cache(maxsize=65_536)
def declared(name: str, attributes: str) -> tuple[int, int, bool]:
    """Level, how firmly an element is declared to be no content, and whether it is a header."""
    told = {k.lower(): (v or "").strip("\"'") for k, v in TOLD.findall(attributes)} if attributes else {}
    role = told.get("role", "").lower()
    if name in ("html", "body"):
        return PLAIN, NOTHING, False
    if name == "article" or role == "article" or told.get("itemprop", "").lower() == "articlebody":
        level = ARTICLE
    elif name == "main" or role == "main":
        level = MAIN
    else:
        level = PLAIN
    words = {w.lower() for w in WORD.findall(f"{told.get('class', '')} {told.get('id', '')}")}
    unseen = "hidden" in told or told.get("aria-hidden", "").lower() == "true" or bool(HIDDEN_STYLE.search(told.get("style", "")))
    if name in CHROME_TAGS or role in CHROME_ROLES or words & COMMENT_WORDS or unseen:
        return level, FIRM, False
    if words & CHROME_WORDS and level == PLAIN:
        return level, BY_CLASS, False
    if level == PLAIN and words & CONTENT_WORDS:
        level = NAMED
    return level, NOTHING, name == "header" or level == PLAIN and bool(words & HEADER_WORDS)


@functools.cache
def end_of(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?![\\w-])", re.IGNORECASE)


class Page:
    """The blocks of a page: text, level, chrome (declared to be no content) and kind (its element)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, bool, str]] = []
        self.waiting: list[str] = []
        #: Open elements: name, level, firmness.
        self.stack: list[tuple[str, int, int]] = []
        self.open: dict[str, int] = {}
        self.level, self.chrome, self.kind = PLAIN, NOTHING, "body"
        self.read(html)
        self.flush()

    def flush(self) -> None:
        if self.waiting:
            text = " ".join(references.unescape("".join(self.waiting)).split())
            if text:
                self.blocks.append((text, self.level, self.chrome != NOTHING, self.kind))
            self.waiting.clear()

    def close_to(self, at: int) -> None:
        """Close all elements from place at of the stack on."""
        for name, *_ in self.stack[at:]:
            self.open[name] -= 1
        _, self.level, self.chrome = self.stack[at]
        del self.stack[at:]

    def close(self, names: set[str], barrier: set[str] = frozenset()) -> None:
        """Close the innermost open element of names, if none of barrier is nearer."""
        if not any(self.open.get(n) for n in names):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in names:
                self.close_to(at)
                return
            if self.stack[at][0] in barrier:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in BREAKS:
            self.flush()
            if self.open.get("p"):
                self.close({"p"}, {"button", "td", "th", "table", "caption"})
            if name in CLOSES:
                self.close(*CLOSES[name])
            self.kind = name
        elif name == "br":
            self.waiting.append(" ")
        if name in VOID:
            return
        level, firm, header = declared(name, attributes)
        if firm == NOTHING and header and self.level < ARTICLE:
            firm = BY_CLASS
        inline = name not in BREAKS
        if inline and firm == NOTHING and level == PLAIN:
            return
        if firm != NOTHING and inline:
            self.flush()
        # The state before it stands on the stack, so that its end brings it back.
        self.stack.append((name, self.level, self.chrome))
        self.open[name] = self.open.get(name, 0) + 1
        if level >= MAIN and self.chrome == BY_CLASS and firm == NOTHING:
            self.chrome = NOTHING  # a wrapper's class doesn't outdo the article in it
        self.level, self.chrome = max(self.level, level), max(self.chrome, firm)

    def end(self, name: str) -> None:
        if name in BREAKS:
            self.flush()
        if self.open.get(name):
            if name not in BREAKS:
                self.flush()
            self.close({name})

    def read(self, html: str) -> None:
        at = 0
        while True:
            tag = TAG.search(html, at)
            if tag is None:
                self.waiting.append(html[at:])
                return
            if tag.start() > at:
                self.waiting.append(html[at : tag.start()])
            if tag[2] is None:
                comment = tag[0] == "<!--"
                end = html.find("-->" if comment else ">", tag.end())
                if end < 0:
                    return
                at = end + (3 if comment else 1)
                continue
            rest = REST.match(html, tag.end())
            end = rest.end() if rest else html.find(">", tag.end()) + 1
            if end == 0:
                return
            name, at = tag[2].lower(), end
            if tag[1]:
                self.end(name)
            elif name in RAW:
                closing = end_of(name).search(html, at)
                if closing:
                    at = closing.start()
                elif name != "head":
                    return
            else:
                self.start(name, html[tag.end() : end - 1])


def page_blocks(html: str) -> list[tuple[str, int, bool, str]]:
    """(text, level, declared to be no content, element) of each block of a page, in its order."""
    return Page(html).blocks


def content_level(blocks: list[tuple[str, int, bool, str]]) -> int:
    """The level of the page's content: the highest that a block has which isn't declared to be none."""
    return max((level for _, level, chrome, _ in blocks if not chrome), default=PLAIN)
