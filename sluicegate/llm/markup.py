"""Blocks of text of one web page, with what their elements say of them."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

#: What an element says of its text: nothing, inside the article, or never part of it.
OPEN, ARTICLE, CHROME = 0, 1, 2

# --- fixed values: elements and names
UNSEEN = frozenset("head script style template noscript iframe object svg canvas audio video select button textarea input".split())
APART = frozenset("nav aside footer form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br option".split())
ENDS = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "tr": frozenset({"tr", "td", "th"})}
LISTS = frozenset("ul ol dl table tbody thead tfoot tr div section article".split())
CHROME_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
REPLY_NAMES = frozenset("comment comments replies reply respond disqus".split())
ARTICLE_NAMES = frozenset({"articlebody"})
BODY_NAMES = frozenset("article content entry main post story".split())
# --- end of fixed values

#: Innermost elements that a block's mark names.
MARK = 8
#: Parts of class and id values: runs of letters, also where lower case turns into upper case.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    """One run of text between block elements.

    says: OPEN, ARTICLE or CHROME.  body: inside a container that is named as
    the page's body.  mark: the elements it stands in, as text.  article: the
    number of its outermost article on the page, from 1; 0 outside of articles.
    """

    says: int
    body: bool
    mark: str
    text: str
    article: int = 0


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.run: list[str] = []
        #: open elements: name, verdict, unseen, body, header, article
        self.stack: list[tuple[str, int, bool, bool, bool, int]] = [("", OPEN, False, False, False, 0)]
        self.articles = 0
        self.count: Counter[str] = Counter()  # of the names on the stack

    def close_from(self, place: int) -> None:
        self.count.subtract(x[0] for x in self.stack[place:])
        del self.stack[place:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        closed = ENDS.get(tag, frozenset()) | (frozenset("p") if tag in BLOCKS and tag != "br" else frozenset())
        if any(self.count[name] for name in closed):  # elements whose end tag may be left out
            for inner in reversed(range(1, len(self.stack))):
                if self.stack[inner][0] in closed:
                    self.close_from(inner)
                    break
                if self.stack[inner][0] in LISTS:
                    break
        if tag in VOID:
            return
        _, says, unseen, body, header, article = self.stack[-1]
        own = dict(attrs)
        names = {x.lower() for key in ("class", "id") for x in _PART.findall(own.get(key) or "")}
        if tag == "article":
            says = CHROME if says == CHROME or names & REPLY_NAMES else ARTICLE
        elif tag not in ("html", "body", "main"):
            if tag in APART or names & CHROME_NAMES or (own.get("role") or "").lower() in CHROME_ROLES:
                says = CHROME
            elif (own.get("itemprop") or "").lower() in ARTICLE_NAMES and says != CHROME:
                says = ARTICLE
        if says == ARTICLE and not article:
            article = self.articles = self.articles + 1
        header = header or tag == "header" or "header" in names
        body = body or tag == "main" or bool(names & BODY_NAMES) or own.get("role") == "main"
        style = re.sub(r"\s", "", own.get("style") or "").lower()
        unseen = unseen or tag in UNSEEN or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in style
        self.stack.append((tag, says, unseen, body, header, article))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style"):  # a slash does not close these
            self.set_cdata_mode(tag)
        elif tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.stack) - 1, 0, -1) if self.count[tag] else ():
            if self.stack[k][0] == tag:
                self.close_from(k)
                return
            if self.stack[k][0] in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                return  # a stray end tag closes nothing beyond its article

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.run.append(data)

    def flush(self) -> None:
        text, self.run = " ".join("".join(self.run).split()), []
        if not text:
            return
        _, says, _, body, header, article = self.stack[-1]
        if header and not any(x[0] in HEADINGS for x in self.stack[1:] if says == ARTICLE):
            says = CHROME  # of a header only an article's headings are the article
        self.blocks.append(Block(says, body, ">".join(x[0] for x in self.stack[-MARK:] if x[0] in BLOCKS), text, article if says == ARTICLE else 0))


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in page order; null is an empty page.  Unclosed and stray tags are read as browsers mostly do."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks
