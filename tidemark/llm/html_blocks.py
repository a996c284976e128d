"""Leaf blocks of web pages, with the features that label them, and labelled pages to learn from."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

# HTML's element kinds, and words that sites use for parts of a page.
UNSEEN = frozenset("head template svg math object select option button canvas audio video".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
SKIPPED = frozenset("script style textarea title noscript iframe".split())  # plain text up to their end tag
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body div footer form header html main nav section table td th blockquote".split())
CLOSING_ENDS = SCOPES | {"ul", "ol", "dl"}  # an end tag left out is not looked for beyond these
FOREIGN = ("svg", "math")
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pager pagination tabs skip",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner teaser",
    "notice": "notice notices cookie cookies consent gdpr alert warning popup modal overlay message toast disclaimer",
    "side": "sidebar side aside related recommended widget widgets rail more trending popular",
    "foot": "footer foot copyright legal colophon credits bottom",
    "head": "header masthead topbar top logo brand site hero",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread responses reader",
    "form": "form login signup subscribe newsletter search contact register",
    "share": "share sharing social follow tags meta byline author",
    "body": "article content post entry story text main body page blog single",
}
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}

# A quote opens a section only where a value begins; anywhere else it is a character like others. A tag that never ends goes to the page's end.
VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f>"'][^ \t\n\r\f>]*+)"""
ATTRIBUTE = rf"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+{VALUE}?+)?+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\r\f/]++|{ATTRIBUTE})*+)(?:>|\Z)", re.S
)
NAMED = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass
class Leaf:
    text: str
    features: list[str]
    box: int  # number of the innermost block element that holds it
    truth: int = -1


class _Open:
    __slots__ = ("tag", "names", "number", "mark")

    def __init__(self, tag: str, attributes: str, number: int) -> None:
        self.tag, self.number, self.mark = tag, number, None
        self.names = [f"in:{tag}"]
        for name, value in NAMED.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "style":
                if "display:none" in value.replace(" ", ""):
                    self.names.append("unseen")
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                self.names.append("unseen")
            elif name == "role":
                self.names.append(f"role:{value}")
            else:
                if value.startswith("truth"):
                    self.mark = int(value[5:6])  # only in the labelled pages made here
                    continue
                self.names += [f"hint:{HINT_OF[w]}" for w in WORDS.findall(value) if w in HINT_OF]


def _grade(n: float, steps: tuple[float, ...]) -> int:
    return sum(n > s for s in steps)


class _Stack:
    """Open elements, with what is asked of them kept up to date: nothing walks the stack, however deep it is."""

    def __init__(self) -> None:
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # of each tag, ascending
        self.names: dict[str, int] = {}  # how many open elements give a feature
        self.blocks: list[_Open] = []
        self.marks: list[int] = []
        self.unseen = 0

    def push(self, one: _Open) -> None:
        self.places.setdefault(one.tag, []).append(len(self.open))
        self.open.append(one)
        for n in one.names:
            self.names[n] = self.names.get(n, 0) + 1
        if one.tag not in INLINE:
            self.blocks.append(one)
        if one.mark is not None:
            self.marks.append(one.mark)
        self.unseen += one.tag in UNSEEN

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of any of some tags, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def first(self, tag: str) -> int:
        held = self.places.get(tag)
        return held[0] if held else -1

    def pop(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.open) > place:
            one = self.open.pop()
            self.places[one.tag].pop()
            for n in one.names:
                self.names[n] -= 1
                if not self.names[n]:
                    del self.names[n]
            if one.tag not in INLINE:
                self.blocks.pop()
            if one.mark is not None:
                self.marks.pop()
            self.unseen -= one.tag in UNSEEN


def leaves(page: str) -> list[Leaf]:
    """The page's leaf blocks in order: text between block elements, references decoded, white space as single spaces."""
    stack = _Stack()
    found: list[Leaf] = []
    parts: list[tuple[str, bool]] = []
    at = boxes = 0

    def flush() -> None:
        if not parts:
            return
        text = SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
        if text and not stack.unseen:
            linked = sum(len(p) for p, is_link in parts if is_link) / max(1, sum(len(p) for p, _ in parts))
            blocks = stack.blocks
            names = set(stack.names)
            if blocks:
                names.add(f"parent:{blocks[-1].tag}")
                names.update(f"near:{n}" for o in blocks[-2:] for n in o.names if n.startswith("hint"))
            words = text.count(" ") + 1
            names.add(f"words:{_grade(words, (1, 3, 6, 12, 25, 60))}")
            names.add(f"links:{_grade(linked, (0.0, 0.3, 0.7, 0.95))}")
            names.add(f"stops:{_grade(sum(map(text.count, '.!?,;')) / words, (0.0, 0.03, 0.1, 0.3))}")
            if text[-1] in ".!?":
                names.add("closed")
            if "©" in text:
                names.add("rights")
            found.append(Leaf(text, sorted(names), blocks[-1].number if blocks else 0, stack.marks[-1] if stack.marks else -1))
        parts.clear()

    def leave_head(always: bool = False) -> None:
        """An open head ends where something begins that may not stand in it, but not within a template."""
        place = stack.first("head")
        if place >= 0 and (always or stack.last(("template", "noframes")) < place):
            stack.pop(place)

    def add(text: str) -> None:
        if text.strip(" \t\n\r\f"):
            leave_head()
        if text:
            parts.append((text, bool(stack.places.get("a"))))

    while at < len(page):
        hit = TOKEN.search(page, at)
        if not hit:
            add(page[at:])
            break
        add(page[at : hit.start()])
        at = hit.end()
        closing, tag, attributes = hit.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in SKIPPED:
            end = None if closing else re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = at if closing else end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
        if closing:
            place = stack.last((tag,))
            if place >= 0:
                stack.pop(place)
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th"):
            shuts = {"p"} if tag in CLOSES_P else {"p", "dt", "dd"} if tag in ("dt", "dd") else {"p", tag} if tag in ("li", "tr") else {"p", "td", "th"}
            place = stack.last(shuts)
            if place >= 0 and place >= stack.last(CLOSING_ENDS):
                stack.pop(place)
        if tag not in IN_HEAD:
            leave_head(tag == "body")
        # A closing slash counts in foreign elements only; elsewhere browsers ignore it, or it belongs to the last value.
        if tag in VOID or (attributes.endswith("/") and (tag in FOREIGN or stack.last(FOREIGN) >= 0)):
            continue
        boxes += 1
        stack.push(_Open(tag, attributes, boxes))
    flush()
    for i, leaf in enumerate(found):
        leaf.features.append(f"place:{_grade((i + 0.5) / len(found), (0.1, 0.3, 0.7, 0.9))}")
    return found


def passages(page: str) -> tuple[list[str], list[str]]:
    """Long and short texts of a page, to make labelled pages from."""
    texts = [x.text for x in leaves(page)]
    return [t for t in texts if t.count(" ") >= 8], [t for t in texts if t.count(" ") < 8]


def labelled(texts: list[str], names: list[str], seed: int) -> str:
    """A page of given texts in one of many usual layouts. ``id=truth1`` marks the article, ``id=truth0`` everything else."""
    pick = random.Random(seed)
    long, short = (lambda: html.escape(pick.choice(texts))), (lambda: html.escape(pick.choice(names)))
    some = lambda make, a, b: "".join(make() for _ in range(pick.randint(a, b)))
    link = lambda: f'<a href="/x">{short()}</a>'

    def box(tags: str, hints: str, inner: str) -> str:
        tag, hint = pick.choice(tags.split()), pick.choice(hints.split())
        named = pick.choice((f'class="{hint}"', f'id="{hint}"', f'class="{hint} {hint}-box"', f'class="x-{hint}"'))
        if tag not in ("div", "section", "ul", "ol") and pick.random() < 0.5:
            named = ""
        return f"<{tag} id=truth0 {named}>{inner}</{tag}>"

    menu = lambda: box("nav nav div", "menu nav navbar breadcrumb toc", f"<ul>{some(lambda: f'<li>{link()}</li>', 2, 7)}</ul>" if pick.random() < 0.7 else some(link, 2, 6))
    advert = lambda: box("div", "ad ads advert sponsored promo banner", long() if pick.random() < 0.6 else f"<p>{short()}</p>")
    notice = lambda: box("div section aside", "notice cookie consent alert popup", f"<p>{long()}</p>" + pick.choice(("", f"<button>{short()}</button>", f"<p>{link()}</p>")))
    side = lambda: box("aside aside div", "sidebar related widget side", f"<h3>{short()}</h3>" + pick.choice((f"<ul>{some(lambda: f'<li>{link()}</li>', 2, 6)}</ul>", some(lambda: f"<p>{long()}</p>", 1, 3))))
    form = lambda: box("form", "newsletter search login contact", f"<label>{short()}</label><input name=q><p>{pick.choice((long, short))()}</p>")
    voice = lambda: pick.choice((f"<p>{long()}</p>", f"<li>{long()}</li>", f"<div class='comment'><b>{short()}</b> <p>{long()}</p></div>", f"<article class='comment'><p>{long()}</p></article>"))
    comments = lambda: box("section div div ol", "comments commentlist replies discussion responses", pick.choice(("", f"<h2>{short()}</h2>", f"<h3>{short()}</h3>")) + some(voice, 1, 5))
    share = lambda: box("div ul", "share social tags meta", some(link, 2, 4))
    head = lambda: box("header header div", "header masthead topbar logo", pick.choice((f"<h1>{short()}</h1>", f"<p>{short()}</p>", link())) + pick.choice(("", menu())))
    foot = lambda: box("footer footer div", "footer copyright legal", pick.choice((f"&copy; {short()} {long()}", f"<p>{long()}</p>", f"&copy; {short()}", some(link, 2, 5))))
    para = lambda: pick.choice((f"<p>{long()}</p>",) * 6 + (f"<p>{long()}", f"<p>{short()}</p>", f"<p><b>{long()}<br><p>{long()}</p>", f"<h2>{short()}</h2>", f"<blockquote>{long()}</blockquote>", f"<ul>{some(lambda: f'<li>{pick.choice((long, short))()}</li>', 2, 4)}</ul>", f"<p>{long()} {link()} {long()}</p>", f"<div>{long()}</div>", f"<table><tr><td>{short()}<td>{long()}</table>"))
    inner = lambda: pick.choice((advert, side, form, share, notice, comments))()
    body = pick.choice(("", f"<h1>{short()}</h1>", f"<h1>{long()}</h1>", f"<h2>{short()}</h2>")) + some(lambda: para() + (inner() if pick.random() < 0.12 else ""), 1, 10)
    tag, named = pick.choice((("article", ""),) * 4 + (("article", "class=post"), ("main", ""), ("div", "class=content"), ("div", "class='article-body'"), ("div", "class=post"), ("section", "class=entry"), ("div", "role=main"), ("div", "")))
    article = f"<{tag} id=truth1 {named}>{body}{comments() if pick.random() < 0.15 else ''}</{tag}>"
    if pick.random() < 0.2:
        article = f"<main>{article}{side() if pick.random() < 0.3 else ''}</main>"
    maybe = lambda make, p: make() if pick.random() < p else ""
    before = maybe(head, 0.5) + maybe(menu, 0.7) + maybe(notice, 0.3) + maybe(advert, 0.4) + maybe(side, 0.15) + maybe(form, 0.15)
    after = maybe(share, 0.15) + maybe(comments, 0.35) + maybe(side, 0.3) + maybe(advert, 0.2) + maybe(form, 0.2) + maybe(notice, 0.1) + maybe(foot, 0.8)
    return f"<html><head><title>{short()}</title></head><body>{before}{article}{after}</body></html>"
