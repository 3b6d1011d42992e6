"""Main text of web pages by a linear-chain conditional random field over the DOM's leaf blocks.

A leaf block is the text between two block-level boundaries, with the open elements around it. Its features are the tags,
class and id words and roles of its ancestors, and the form of its text; the neighbours' text features are inputs too.
The field is trained on labelled pages written from varied layouts (no table of labels is given for pages) and decoded by
Viterbi; the blocks labelled main are joined in page order.

Defined cases: a null or empty page has the empty text; unclosed, stray and crossing tags are closed as browsers do; an
unclosed script, style or comment runs to the end; character references are decoded inside a piece of text, never across a tag; rows with equal ids each give their own row; an empty table gives none.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common
from wayline.llm.crf import CRF

TRAIN_PAGES = 400

# Element names of the HTML standard by their kind.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li legend main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead tr ul button label".split()
)
RAW = frozenset("script style template textarea title svg iframe canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
_ENDS_P = BLOCK - {"button", "label", "option", "optgroup", "select", "legend", "summary", "body", "html", "head"}
_SCOPES = frozenset(("article", "aside", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "th", "ul", "ol"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_SPACE = re.compile(r"\s+")
_RAW_END = {name: re.compile(f"</{name}[\\s/>]", re.I) for name in RAW}
_LISTS = frozenset(("ul", "ol", "dl", "table", "select"))

TAGS = "article main section nav header footer aside form ul ol li table td p h1 h2 h3 h4 figure figcaption blockquote pre dl button label div".split()
HINTS = tuple(
    re.compile(p)
    for p in (
        r"(?:^|[^a-z])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|dfp|gpt)(?:$|[^a-z])",
        r"comment|reply|replies|discuss|disqus|respond",
        r"side|widget|related|rail|recommend|trending|popular|more",
        r"nav|menu|breadcrumb|crumb|tabs|pagination|pager",
        r"foot|copyright|legal|imprint|bottom",
        r"head|masthead|topbar|brand|logo",
        r"cookie|notice|consent|alert|gdpr|modal|popup|overlay|warning",
        r"newsletter|subscribe|signup|login|search|form|share|social|follow|tag|author|byline|meta",
        r"content|article|post|story|entry|main|body|text|prose",
        r"hidden|display: ?none|sr-only",
    )
)
TEXT_FEATURES = 13
OWN = len(TAGS) + len(HINTS) + TEXT_FEATURES + 2


@dataclass
class Block:
    text: str
    around: bytes  # per name of TAGS and pattern of HINTS, whether an open element has it
    linked: int


class _Open:
    """The open elements: what they count for, and where the last of each name stands, so that no step walks the stack."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.counts = [0] * (len(TAGS) + len(HINTS))

    def push(self, name: str, marks: str) -> None:
        own = _counted(name, marks)
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, own))
        for k in own:
            self.counts[k] += 1

    def close(self, name: str, scope: frozenset = frozenset()) -> None:
        """Close the last element of that name and what is inside, unless an element of ``scope`` is open inside it."""
        at = self.places.get(name)
        if not at or any(inner[-1] > at[-1] for s in scope if (inner := self.places.get(s))):
            return
        for other, own in reversed(self.stack[(keep := at[-1]) :]):
            self.places[other].pop()
            for k in own:
                self.counts[k] -= 1
        del self.stack[keep:]

    def around(self) -> bytes:
        return bytes(map(bool, self.counts))


@lru_cache(4096)
def _counted(name: str, marks: str) -> tuple[int, ...]:
    """Places of an element's name and hints in ``Block.around``."""
    hints = [len(TAGS) + k for k, h in enumerate(HINTS) if marks and h.search(marks)]
    return (TAGS.index(name), *hints) if name in TAGS else tuple(hints)


def _tag_end(page: str, at: int, last: dict[str, int], known: dict[int, int]) -> int:
    """Behind the > that ends the tag: the first outside quotes, or the first of all where quotes are not closed.

    ``known`` holds what follows from each quote that opened in an earlier tag of the page (0: none ends it), so that no
    quote is looked at twice and a page takes linear time, however its quotes stand.
    """
    k, seen = at, []
    while True:
        k = _PLAIN.match(page, k).end()
        if k == len(page) or page[k] == ">":
            end = 0 if k == len(page) else k + 1
            break
        if k in known:
            end = known[k]
            break
        seen.append(k)
        if k >= last[page[k]]:
            end = 0
            break
        k = page.index(page[k], k + 1) + 1
    known.update(dict.fromkeys(seen, end))
    return end or page.index(">", at) + 1


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order, by one scan over the page."""
    out: list[Block] = []
    open_ = _Open()
    parts: list[str] = []
    at, linked, in_link, end = 0, 0, False, len(page)
    last, known = {c: page.rfind(c) for c in ">\"'"}, {}

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(html.unescape(piece))
            linked += in_link * len(parts[-1])

    def flush() -> None:
        nonlocal linked
        if parts:
            joined = _SPACE.sub(" ", "".join(parts)).strip()
            if joined:
                out.append(Block(joined, open_.around(), linked))
            parts.clear()
        linked = 0

    start = 0  # of the text at hand
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            break
        if lt > last[">"]:  # no tag ends any more, but a comment may begin
            if (comment := page.find("<!--", lt)) >= 0:
                text(page[start:comment])
                start = end
            break
        closing = page.startswith("/", lt + 1)
        m = _NAME.match(page, lt + 1 + closing)
        if not m and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            at = lt + 1  # a bare <
            continue
        text(page[start:lt])
        if not m:
            stop = page.find("-->", lt + 4) + 3 if page.startswith("!--", lt + 1) else page.index(">", lt) + 1
            start = at = stop if stop > 2 else end  # an unclosed comment runs to the end
            continue
        start = at = _tag_end(page, m.end(), last, known)
        name, marks = m[0].lower(), page[m.end() : at - 1].lower()
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in RAW:
            if not closing and not marks.endswith("/"):
                stop = _RAW_END[name].search(page, at)
                start = at = end if stop is None else page.find(">", stop.start()) + 1 or end
            if name in ("title", "textarea"):
                flush()
        elif name in BLOCK:
            flush()
            if closing:
                open_.close(name, _SCOPES - {name} if name in ("p", "li") else frozenset())
            else:
                if name in _ENDS_P:
                    open_.close("p", _SCOPES)
                for other in CLOSES.get(name, ()):
                    open_.close(other, _LISTS)
                if name not in VOID:
                    open_.push(name, marks if "=" in marks else "")
    text(page[start:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Own features of a page's blocks, and the text features of the blocks before and after."""
    own = np.zeros((len(found), OWN))
    texts = np.zeros((len(found), TEXT_FEATURES))
    n_around = len(TAGS) + len(HINTS)
    for i, b in enumerate(found):
        own[i, :n_around] = np.frombuffer(b.around, np.uint8)
        t, n = b.text, len(b.text)
        letters = sum(map(str.isalpha, t)) if n < 200 else n
        texts[i] = (
            1, np.log1p(n) / 6, n < 25, 25 <= n < 80, n >= 200, min(1, b.linked / n), t[-1] in ".!?:;…»”\"", "." in t[:-1] or "," in t,
            letters / n < 0.6, t[0] == "©" or "©" in t[:40] or "copyright" in t[:60].lower(), "|" in t or "·" in t or "»" in t or "›" in t, t[0].isupper(), n < 80 and t.count(" ") < 3,
        )
        own[i, -2:] = i == 0, i == len(found) - 1
    own[:, n_around:-2] = texts
    before, after = np.zeros_like(texts), np.zeros_like(texts)
    before[1:], after[:-1] = texts[:-1], texts[1:]
    return np.concatenate([own, before, after], 1)


# Written-out layouts: (page, texts of its main blocks).
_WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years".split()


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, set[str]]]:
    rng = random.Random(seed)
    pages = []
    for _ in range(n):
        serial = [0]
        main: set[str] = set()

        def words(k: int, stop: str = ".", serial=serial) -> str:
            serial[0] += 1
            w = [rng.choice(_WORDS) for _ in range(max(1, k - 1))] + [f"w{serial[0]}"]
            rng.shuffle(w)
            for i in range(7, len(w), 9):
                w[i] += rng.choice(".,")
            return " ".join(w).capitalize() + stop

        def body(k: int, stop: str = ".", words=words, main=main) -> str:
            t = words(k, stop)
            main.add(t)
            return t

        def short(stop: str = "", words=words) -> str:
            return words(rng.randint(1, 4), stop)

        def links(tag: str = "li", words=words) -> str:
            return "".join(f'<{tag}><a href="/{i}">{words(rng.randint(1, 3), "")}</a></{tag}>' for i in range(rng.randint(2, 8)))

        def pick(*names: str) -> str:
            return f"{rng.choice(('class', 'id'))}=\"{rng.choice(names)}\""

        def paragraph(body=body) -> str:
            t = body(rng.choice((2, 3, 8, 20, 40, 90)))
            form = rng.random()
            if form < 0.1:
                return f"<p><b>{t}<br>"
            if form < 0.2:
                return f"<p>{t}"
            if form < 0.27:
                return f"<h2>{t}</h2>"
            if form < 0.33:
                return f"<ul><li>{t}</li><li>{body(rng.randint(2, 12), '')}</li></ul>"
            if form < 0.38:
                return f"<blockquote><p>{t}</p></blockquote>"
            if form < 0.42:
                return f"<div>{t}</div>"
            if form < 0.45:
                return f"<table><tr><td>{t}</td><td>{body(2, '')}</td></tr></table>"
            return f"<p>{t}</p>"

        ad = lambda: f"<div {pick('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'banner-ad', 'promo')}>{words(rng.randint(3, 40))}</div>"
        nav = lambda: rng.choice((f"<nav><ul>{links()}</ul></nav>", f"<nav>{links('span')}</nav>", f"<div {pick('menu', 'nav', 'navbar', 'breadcrumbs')}><ul>{links()}</ul></div>", f"<ul {pick('menu', 'main-menu')}>{links()}</ul>"))
        head = lambda: rng.choice((f"<header><h1>{short()}</h1><p>{words(6)}</p></header>", f"<header>{short()}{nav()}</header>", f"<div {pick('header', 'masthead', 'topbar')}><p>{short()}</p></div>"))
        side = lambda: rng.choice((f"<aside><h3>{short()}</h3><p>{words(rng.randint(5, 50))}</p></aside>", f"<aside {pick('sidebar')}><ul>{links()}</ul></aside>", f"<div {pick('sidebar', 'widget', 'related', 'right-rail', 'recommended')}><h3>{short()}</h3><p>{words(20)}</p><ul>{links()}</ul></div>"))
        note = lambda: f"<div {pick('cookie-notice', 'notice', 'consent', 'alert', 'gdpr', 'cookie-banner', 'popup')}><p>{words(rng.randint(6, 40))}</p><button>{short()}</button></div>"
        form = lambda: f"<form action=\"/x\" {pick('newsletter', 'search', 'login', 'signup')}><label>{short()}</label><p>{words(rng.randint(3, 14))}</p><input name=\"q\"><button>{short()}</button></form>"
        comments = lambda: f"<{(t := rng.choice(('section', 'div')))} {pick('comments', 'comment-list', 'discussion', 'replies')}><h3>{short()}</h3>" + "".join(rng.choice((f'<div class="comment"><p>{words(rng.randint(3, 60))}</p></div>', f"<p>{words(rng.randint(3, 60))}</p>", f"<ol><li>{words(rng.randint(3, 30))}</li></ol>")) for _ in range(rng.randint(1, 5))) + f"</{t}>"
        foot = lambda: rng.choice((f"<footer>&copy; {short()} &middot; {words(rng.randint(3, 12))}</footer>", f"<footer><p>{words(12)}</p><ul>{links()}</ul></footer>", f"<div {pick('footer', 'site-footer', 'legal')}><p>&copy; {words(8)}</p></div>"))
        share = lambda: f"<div {pick('share', 'social', 'tags')}>{links('span')}</div>"
        top = [f() for f in (nav, head, ad, note, form, share, nav) if rng.random() < 0.45]
        rng.shuffle(top)
        parts = [f"<h1>{body(rng.randint(3, 12), '')}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randint(1, 14)):
            parts.append(paragraph())
            if rng.random() < 0.06:
                parts.append(rng.choice((ad, share, form, side))())
        inner = "".join(parts) + (comments() if rng.random() < 0.15 else "")
        style = rng.random()
        if style < 0.5:
            inner = f"<article>{inner}</article>"
        elif style < 0.65:
            inner = f"<main>{inner}</main>"
        elif style < 0.72:
            inner = f"<main><article>{inner}</article>{side() if rng.random() < 0.5 else ''}</main>"
        else:
            inner = f"<div {pick('content', 'post', 'entry-content', 'article-body', 'story', 'main', 'post-content')}>{inner}</div>"
        low = [f() for f in (side, comments, ad, form, share, note) if rng.random() < 0.35]
        rng.shuffle(low)
        tail = foot() if rng.random() < 0.9 else ""
        wrap = rng.random() < 0.3
        page = f"{''.join(top)}{'<div class=page>' * wrap}{inner}{''.join(low)}{'</div>' * wrap}{tail}"
        pages.append((f"<html><head><title>{short()}</title><script>var a='</p>'</script></head><body>{page}</body></html>", main))
    return pages


def fit(pages: int = TRAIN_PAGES) -> CRF:
    """The field for labels 0 (other) and 1 (main), trained on that many labelled pages."""
    x, y, lengths = [], [], []
    for page, main in labelled_pages(pages):
        found = blocks(page)
        x.append(features(found))
        y.append(np.array([b.text in main for b in found], np.int64))
        lengths.append(len(found))
    return CRF.fit(np.concatenate(x), np.concatenate(y), np.array(lengths), l2=0.3, steps=120)


def main_texts(pages: list[str], field: CRF) -> list[str]:
    found = [blocks(p) for p in pages]
    lengths = np.array([len(f) for f in found], np.int64)
    if not lengths.sum():
        return [""] * len(pages)
    labels = field.viterbi(np.concatenate([features(f) for f in found if f]), lengths)
    ends = np.cumsum(lengths)
    return ["\n".join(b.text for b, keep in zip(f, labels[e - len(f) : e], strict=True) if keep) for f, e in zip(found, ends, strict=True)]


def extract(pages: DataFrame, field: CRF, html_col: str = "html", name: str = "text") -> DataFrame:
    """The pages with their columns but the html, and ``name``: their main text."""
    kept = [c for c in pages.columns if c not in (html_col, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = main_texts([p or "" for p in batch.column(html_col).to_pylist()], field)
                yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(kept).schema), f"`{name}` string"])
    return pages.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit()).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
