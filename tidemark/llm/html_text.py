"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read as a sequence of leaf blocks: runs of text between block-level tags, each with the
tags, classes, ids and roles of its ancestors. A conditional random field with two labels (main text,
other) scores every block by ancestor and text features and every step from a block to the next;
Viterbi gives the best labelling of the page, and the main blocks are joined in page order.

The field is trained by gradient ascent on its log-likelihood over labelled pages that
:func:`labelled_pages` makes from many layouts (``TRAINING_PAGES`` of them, a fixed bound). Training
runs once in a driver process, and its weights (a few hundred numbers) travel with the tasks.

An article's own title is part of its text, also where it stands in a ``header`` of the ``article``; what else such
a header holds (bylines, dates) isn't. Words in class names that are common in articles' own names ("top-story",
"content warning") count only where no other name of the element speaks for an article.

Defined results: a null or empty page has the text ``""``; broken or cut-off markup is read as far as
it goes, so an element without an end tag takes nothing away (but a script or style, as in browsers);
scripts, styles, text areas, templates, embedded frames and the head are no text; formulas are text; very long
pages are read whole; repeated rows are extracted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

TRAINING_PAGES = 300

_TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page. Without an end tag, only the first two take the rest of the page.
_TO_THE_END = ("script", "style")
_RAW = frozenset([*_TO_THE_END, *"textarea title template iframe annotation annotation-xml".split()])
_END = {name: re.compile(f"</{name}", re.I) for name in [*_RAW, "noscript"]}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Formulas, drawings and players: read like inline elements, whatever is missing of them.
_INLINE |= frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mpadded mphantom menclose mmultiscripts mspace semantics".split())
_INLINE |= frozenset("svg g path circle ellipse rect line polyline polygon text tspan defs use desc picture object video audio canvas map".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that are no part of an article, whatever their names.
_OTHER = frozenset("nav header footer aside form button dialog menu fieldset select option noscript".split())
#: What ends a selection list that has no end tag.
_NOT_IN_SELECT = _CLOSES_P | frozenset("button td li body".split())
_TAGS = frozenset("article main nav header footer aside form section table ul ol li dl blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 p div td button fieldset details address menu dialog body select option noscript title_block".split())
#: Words in class, id and role names, by what they tell.
_NAMES = {
    "good": "article content main post entry story text body page prose markdown blog news editorial copy".split(),
    "ad": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted dfp gpt adsense outbrain taboola".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager topbar toolbar toc tabs skip links".split(),
    "edge": "header masthead footer foot copyright legal colophon bottom top contentinfo logo".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular more rail complementary archive tags tagcloud".split(),
    "notice": "cookie cookies consent gdpr notice notices alert alerts modal popup overlay dialog disclaimer warning privacy paywall".split(),
    "form": "form login signin signup register subscribe subscription newsletter search contact input".split(),
    "talk": "comment comments commentlist reply replies respond discussion disqus thread feedback responses reader readers".split(),
    "social": "share sharing social follow like tweet facebook twitter".split(),
}
_KIND = {word: kind for kind, words in _NAMES.items() for word in words}


#: Words that say little: they count as the last known word of a class, and not beside a name that speaks for an article.
_WEAK = frozenset("top bottom warning disclaimer notice notices alert privacy more popular trending archive tags search input contact follow like thread reader readers view skip links legal foot".split())


@functools.lru_cache(maxsize=4096)
def _hints(attributes: str) -> tuple[str, ...]:
    """Kinds of the names in an element's class, id and role."""
    found, weak = set(), set()
    for _, value in _ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w for w in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w in _KIND]
            for k, w in enumerate(words):
                if w not in _WEAK:
                    found.add(_KIND[w])
                elif k == len(words) - 1:
                    weak.add(_KIND[w])
            if words and words[-1] in _WEAK and len(words) > 1 and found == {"good"}:
                found.discard("good")  # "content-warning" is a warning
    return tuple(sorted(found if "good" in found else found | weak))


class Above(NamedTuple):
    """What counts of a block's ancestors: the nearest tag, all tags, kinds of all names, what the nearest telling one says."""

    tag: str = ""
    tags: frozenset[str] = frozenset()
    kinds: frozenset[str] = frozenset()
    nearest: str = ""
    head: bool = False

    def and_(self, tag: str, hints: tuple[str, ...]) -> Above:
        nearest = self.nearest
        if tag == "title_block":
            nearest = "title"
        elif any(k != "good" for k in hints) or tag in _OTHER:
            nearest = "other"
        elif "good" in hints or tag in ("article", "main"):
            nearest = "main"
        tags = self.tags | {tag} if tag in _TAGS and tag not in self.tags else self.tags
        kinds = self.kinds if self.kinds.issuperset(hints) else self.kinds.union(hints)
        return Above(tag, tags, kinds, nearest, self.head or tag == "head")


def leaf_blocks(html: str) -> list[tuple[str, Above, int]]:
    """(text, ancestors, characters within links) of each leaf block; linear in the page."""
    out: list[tuple[str, Above, int]] = []
    stack: list[Above] = []
    depth: Counter[str] = Counter()
    parts: list[str] = []
    endless: set[str] = set()
    links, link_depth, at, n = 0, 0, 0, len(html)

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if link_depth:
                links += len(raw.strip())

    def flush() -> None:
        nonlocal links
        if parts:
            if whole := " ".join("".join(parts).split()):
                out.append((whole, stack[-1] if stack else Above(), links))
            parts.clear()
        links = 0

    def inside(tag: str) -> bool:
        return depth[tag] > 0

    def pop() -> str:
        tag = stack.pop().tag
        depth[tag] -= 1
        return tag

    def close(tag: str) -> None:
        while stack and pop() != tag:
            pass

    def ending(name: str) -> int:
        """Where the next end tag of that name begins; 0 for none."""
        found = None if name in endless else _END[name].search(html, at)
        if found is None:
            endless.add(name)
        return found.start() if found else 0

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if (name := m[2]) is None:
            continue
        name = name.lower()
        if name in _RAW:
            if not m[1] and not m[3].endswith("/"):
                if end := ending(name):
                    at = end
                elif name in _TO_THE_END:
                    at = n
            continue
        if name == "noscript" and not m[1] and not ending(name):
            continue
        if name == "br" or name == "wbr" or name == "hr":
            parts.append(" " if name != "wbr" else "")
            if name == "hr":
                flush()
        elif name == "a":
            link_depth = 0 if m[1] else 1
        elif name in _INLINE or name in _VOID:
            pass
        elif m[1]:
            flush()
            link_depth = 0
            if name == "header" and inside("title_block"):
                close("title_block")
            elif inside(name):
                close(name)
        else:
            flush()
            link_depth = 0
            if name in _CLOSES_P and stack and stack[-1].tag == "p":
                pop()
            elif name in _NOT_IN_SELECT and inside("select"):
                close("select")
            elif name == "option" and stack and stack[-1].tag == "option":
                pop()
            elif name in ("li", "td", "th", "tr", "dt", "dd") and stack and stack[-1].tag == name:
                pop()
            if name == "body":
                while stack and stack[-1].tag in ("head", "p"):
                    pop()
            if not m[3].endswith("/"):
                if name == "header" and inside("article"):
                    name = "title_block"
                stack.append((stack[-1] if stack else Above()).and_(name, _hints(m[3]) if m[3] else ()))
                depth[name] += 1
    flush()
    return [b for b in out if not b[1].head]


def features(block: tuple[str, Above, int], first: bool, last: bool) -> list[str]:
    text, above, links = block
    n = len(text)
    out = ["bias", f"len{min(n, 400).bit_length()}"]
    share = links / n
    out.append("link0" if share == 0 else "link1" if share < 0.3 else "link2" if share < 0.8 else "link3")
    out.append("end" if text[-1] in ".!?…:;\"»”" else "open")
    if text[0] in "©®™•·|»" or "©" in text:
        out.append("sign")
    commas = text.count(",") + text.count(". ")
    out.append("comma0" if not commas else "comma1" if commas < 3 else "comma2")
    if first:
        out.append("first")
    if last:
        out.append("last")
    if above.tag:
        out.append("in_" + (above.tag if above.tag in _TAGS else "other"))
    out += ["t_" + t for t in above.tags]
    out += ["k_" + k for k in above.kinds]
    out.append("near_" + (above.nearest or "none"))
    if above.nearest == "title":
        out.append("title_" + ("heading" if above.tag in ("h1", "h2") else "rest"))
    if "good" not in above.kinds and not above.tags & {"article", "main"}:
        out.append("plain")
        out.append(f"plain_len{min(n, 400).bit_length()}")
    return out


class Field:
    """Two labels (1: main text). ``emission``: feature -> score of label 1 over label 0; ``start``, ``step``: of labels."""

    def __init__(self, emission: dict[str, float], start: list[float], step: list[list[float]]):
        self.emission, self.start, self.step = emission, start, step

    def scores(self, blocks: list) -> list[float]:
        get, end = self.emission.get, len(blocks) - 1
        return [sum([get(f, 0.0) for f in features(b, i == 0, i == end)]) for i, b in enumerate(blocks)]

    def decode(self, blocks: list) -> list[int]:
        """Viterbi: the best labelling of the page."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        a, b = self.start[0], self.start[1] + scores[0]
        (s00, s01), (s10, s11) = self.step
        back = []
        for e in scores[1:]:
            from0, from1 = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + s00 if from0 else b + s10), (a + s01 if from1 else b + s11) + e
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]

    def extract(self, html: str | None) -> str:
        blocks = leaf_blocks(html or "")
        return " ".join([b[0] for b, y in zip(blocks, self.decode(blocks)) if y])


def train(pages: list[tuple[list, list[int]]], steps: int = 160, rate: float = 0.15, ridge: float = 2e-3) -> Field:
    """Gradient ascent (Adam) on the mean log-likelihood; ``pages``: (blocks, labels)."""
    pages = [p for p in pages if p[0]]
    rows = [[features(b, i == 0, i == len(blocks) - 1) for i, b in enumerate(blocks)] for blocks, _ in pages]
    names = sorted({f for page in rows for r in page for f in r})
    index = {f: i for i, f in enumerate(names)}
    longest = max(map(len, rows))
    x = np.zeros((len(rows), longest, len(names)), dtype=np.float32)
    y, there = np.zeros((len(rows), longest), dtype=np.int64), np.zeros((len(rows), longest))
    for p, (page, (_, labels)) in enumerate(zip(rows, pages)):
        for t, r in enumerate(page):
            x[p, t, [index[f] for f in r]] = 1
        y[p, : len(labels)], there[p, : len(labels)] = labels, 1
    flat, both = x.reshape(-1, len(names)), there[:, 1:] * there[:, :-1]
    w, size = np.zeros(len(names) + 6), len(names)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        e = (flat @ w[:size].astype(np.float32)).reshape(y.shape).astype(float)
        start, step = w[size : size + 2], w[size + 2 :].reshape(2, 2)
        emit = np.stack([np.zeros_like(e), e], axis=2) * there[:, :, None]
        alpha, beta = np.zeros((*y.shape, 2)), np.zeros((*y.shape, 2))
        alpha[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            on = np.logaddexp(alpha[:, t - 1, :1] + step[0], alpha[:, t - 1, 1:] + step[1]) + emit[:, t]
            alpha[:, t] = np.where(there[:, t, None] > 0, on, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = emit[:, t + 1] + beta[:, t + 1]
            on = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
            beta[:, t] = np.where(there[:, t + 1, None] > 0, on, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        prob = np.exp(alpha + beta - total[:, None, None])
        pairs = np.exp(alpha[:, :-1, :, None] + step + (emit + beta)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        grad = np.zeros_like(w)
        grad[:size] = flat.T @ ((y - prob[:, :, 1]) * there).reshape(-1).astype(np.float32)
        for label in (0, 1):
            grad[size + label] = ((y[:, 0] == label) - prob[:, 0, label]).sum()
            for to in (0, 1):
                seen = (y[:, :-1] == label) & (y[:, 1:] == to)
                grad[size + 2 + 2 * label + to] = (seen * both).sum() - pairs[:, :, label, to].sum()
        grad = grad / len(rows) - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field(dict(zip(names, map(float, w[:size]))), [float(s) for s in w[size : size + 2]], [[float(s) for s in r] for r in w[size + 2 :].reshape(2, 2)])


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, label)]) of ``n`` made-up pages in many layouts."""
    rnd = random.Random(seed)
    pick, chance = rnd.choice, lambda p: rnd.random() < p

    def words(low: int, high: int) -> str:
        out = ["".join(rnd.choices("abcdefghijklmnoprstuvwéüñ", k=rnd.randint(1, 10))) for _ in range(rnd.randint(low, high))]
        out = [w + pick([",", ".", "###", "!!", "%%%"]) if chance(0.12) else w for w in out]
        return (" ".join(out)).capitalize() + pick([".", ".", ".", "", "!", "?"])

    def page() -> tuple[str, list[tuple[str, int]]]:
        html: list[str] = []
        blocks: list[tuple[str, int]] = []

        def leaf(tag: str, text: str, label: int, link: bool = False, attributes: str = "") -> None:
            blocks.append((text, label))
            end = "" if tag in ("p", "li") and chance(0.15) else f"</{tag}>"
            html.append(f"<{tag}{attributes}>" + (f'<a href="/{len(html)}">{text}</a>' if link else f"<b>{text}</b>" if chance(0.1) else text) + end)

        def box(tag: str, names: list[str], body, attribute: str = "") -> None:
            name = pick([*names, ""]) if tag not in ("div", "section") else pick(names)
            html.append(f"<{tag}" + (f' {attribute or pick(["class", "id", "class"])}="{name}"' if name else "") + ">")
            body()
            html.append(f"</{tag}>")

        def menu() -> None:
            def items() -> None:
                html.append("<ul>")
                for _ in range(rnd.randint(2, 8)):
                    leaf("li", words(1, 3), 0, link=True)
                html.append("</ul>")

            box(*pick([("nav", ["menu", "top"]), ("div", ["navbar", "main-menu", "breadcrumbs", "nav"]), ("header", ["page-header"])]), items)

        def other(kind: str) -> None:
            def talk() -> None:
                for _ in range(rnd.randint(1, 4)):
                    leaf(pick(["p", "div", "li"]), words(2, 40), 0)

            def form() -> None:
                leaf(pick(["p", "div", "h3"]), words(1, 6), 0)
                html.append('<input name="q"><textarea>none</textarea>')
                if chance(0.3):
                    html.append("<select>")
                    for _ in range(rnd.randint(1, 3)):
                        leaf("option", words(1, 3), 0)
                    html.append("</select>")
                leaf("button", words(1, 2), 0)

            def short() -> None:
                for _ in range(rnd.randint(1, 3)):
                    leaf(pick(["p", "div", "p", "h3"]), words(2, 30), 0, link=chance(0.3))

            def edge() -> None:
                leaf(pick(["p", "div"]), pick(["© ", "Copyright ", "", "© 2020 "]) + words(1, 12), 0, link=chance(0.2))

            if kind == "talk":
                box(pick(["div", "section", "aside"]), ["comments", "comment-list", "discussion", "responses", "reader-comments", "comment"], talk)
            elif kind == "form":
                box(*pick([("form", ["search", "newsletter"]), ("div", ["newsletter", "subscribe-box", "login-form", "signup"])]), form)
            elif kind == "ad":
                box(pick(["div", "section", "aside"]), ["ad", "ads", "advert-box", "sponsored", "promo", "banner", "ad-slot"], short)
            elif kind == "side":
                box(*pick([("aside", ["sidebar"]), ("div", ["sidebar", "related", "widget", "popular", "recommended"]), ("section", ["related-posts", "trending"])]), short)
            elif kind == "notice":
                box(pick(["div", "section", "dialog"]), ["cookie-notice", "consent", "alert", "cookie-banner", "gdpr", "notice", "modal", "paywall"], short)
            elif kind == "script":
                html.append("<noscript>")
                leaf(pick(["p", "div"]), words(3, 14), 0)
                html.append("</noscript>")
            elif kind == "social":
                box("div", ["share", "social-links", "follow-us"], short)
            elif kind == "footer":
                box(*pick([("footer", ["footer"]), ("footer", ["site"]), ("div", ["footer", "copyright", "legal"])]), edge)
            elif kind == "header":
                box(*pick([("header", ["masthead"]), ("div", ["header", "logo", "topbar"])]), short)

        def article() -> None:
            def body() -> None:
                if titled and chance(0.4):
                    html.append(pick(["<header>", '<header class="entry-header">', '<header class="top">']))
                    leaf(pick(["h1", "h1", "h2"]), words(1, 9), 1)
                    for _ in range(rnd.randint(0, 2)):
                        leaf(pick(["p", "div"]), words(1, 8), 0, link=chance(0.2))
                    html.append("</header>")
                elif chance(0.85):
                    leaf(pick(["h1", "h1", "h2"]), words(1, 9), 1)
                for _ in range(rnd.randint(1, 12)):
                    r = rnd.random()
                    if r < 0.8:
                        leaf("p", words(*pick([(1, 3), (5, 25), (20, 80)])), 1, link=chance(0.03))
                    elif r < 0.86:
                        leaf(pick(["h2", "h3", "blockquote", "pre"]), words(1, 8), 1)
                    elif r < 0.91:
                        html.append("<ul>")
                        for _ in range(rnd.randint(1, 4)):
                            leaf("li", words(1, 15), 1)
                        html.append("</ul>")
                    elif r < 0.94:
                        html.append("<table><tr>")
                        for _ in range(rnd.randint(1, 4)):
                            leaf("td", words(1, 5), 1)
                        html.append("</tr></table>")
                    else:
                        other(pick(["ad", "ad", "side", "notice", "form", "social"]))
                if titled and chance(0.15):
                    html.append("<footer>")
                    leaf("p", words(1, 8), 0)
                    html.append("</footer>")
                if chance(0.12):
                    other("talk")

            tag, names = pick([("article", ["post", "story"]), ("article", [""]), ("article", ["entry-content", "reader-view", "top-story content", "content warning"]), ("main", ["content", "top-story content"]), ("div", ["content", "article-body", "post-text", "entry", "main"]), ("section", ["story", "content"]), ("div", ["c1", "x", "wrap", "column"]), ("section", ["s", "block"])])
            titled = tag == "article"
            if chance(0.25):
                box(pick(["div", "main"]), ["wrap", "page", "container", "main-content"], lambda: box(tag, names, body))
            else:
                box(tag, names, body)

        html.append(f'<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
        before = [k for k in ("header", "menu", "ad", "notice", "form", "side", "menu", "script") if chance(0.35 if k != "script" else 0.1)]
        rnd.shuffle(before)
        after = [k for k in ("talk", "side", "ad", "form", "notice", "social", "menu", "side") if chance(0.25)]
        rnd.shuffle(after)
        for k in before:
            menu() if k == "menu" else other(k)
        article()
        for k in after:
            menu() if k == "menu" else other(k)
        if chance(0.8):
            other("footer")
        if chance(0.8):
            html.append("</body></html>")
        return "".join(html), blocks

    return [page() for _ in range(n)]


def as_training(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list, list[int]]]:
    out = []
    for html, gold in pages:
        blocks = leaf_blocks(html)
        if [b[0] for b in blocks] != [" ".join(g[0].split()) for g in gold]:
            raise ValueError("labels and leaf blocks differ")
        out.append((blocks, [y for _, y in gold]))
    return out


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES) -> Field:
    return train(as_training(labelled_pages(pages)))


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row. One pass, no shuffle."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [field.extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html": (op10, None)}
