"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. Each block has its own word count and link density, those of its neighbours, and what encloses it.
A decision tree, trained on a small labelled table of made-up pages (``labelled_blocks``), tells main text from the rest. Class names whose last word names boilerplate
are one feature; those that only contain such a word stand on main text and on the rest in that table, so link densities and the block's place decide there.

Defined results: a null or empty html gives an empty text; pages without main text too; repeated rows are judged alike; an empty table gives no rows;
other columns of the input are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist option".split())
#: Hidden elements that part no text.
SILENT = frozenset("script style noscript template svg math".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: What may stand in head; any other tag or text ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Tags that end a hidden element whose end tag was left out, and most of them an open paragraph.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_PARAGRAPH = BLOCK - frozenset("body caption tbody td tfoot th thead tr".split()) | {"hr"}
ENDED_BY = {"select": frozenset(("select", "input", "textarea")), "button": frozenset(("button",)), "option": frozenset(("option", "optgroup", "select"))}
NESTED = frozenset("svg math object canvas audio video template datalist".split())
#: Elements without an end tag end at a tag of these, within the nearest of the others.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("table", "tr"))),
    **dict.fromkeys(("tr", "tbody", "thead", "tfoot"), (("tr", "td", "th"), ("table",))),
    "option": (("option",), ("select", "datalist")),
}
FRAME = frozenset("nav header footer aside form menu dialog".split())
HEADINGS, ITEMS = ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd")
#: Within an article only these are judged by their class names.
GROUPS = frozenset("div section ul ol dl table details figure span".split())
#: Words of class names that stand on boilerplate; places and parts that may follow them; words that make a compound of them a property of the whole page.
HINTS = r"ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|footer|foot|header|masthead|top-?bar|cookies?|consent|notices?|alert|comments?|respond|reply|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|breadcrumbs?|pagination|pager|popup|modal|overlay|widget|login|search|toolbar|copyright|legal|disclaimer|tags?"
PARTS = r"area|articles|author|bar|block|body|bottom|box|buttons?|cards?|col|column|container|content|date|field|form|group|heading|icons?|info|inner|inline|input|items?|label|left|lines?|links?|list|meta|module|more|now|outer|panel|placeholder|posts?|region|right|row|section|slot|sticky|stories|text|this|title|top|unit|us|wrap|wrapper|zone|\d+(?:x\d+)?"
HINT = re.compile(rf"(?:^|[\s_-])(?:{HINTS})(?=$|[\s_-])", re.I)
#: A compound is what its last word says, so "page-footer" and "social-icons" name boilerplate and "social-history" only may.
NAMED = re.compile(rf"(?:^|\s)(?:ads?|advert\w*|sponsor\w*)(?=$|[\s_-])|(?:^|\s)(?!(?:has|no|with|without)[_-])(?:(?!with)[^\s_-]*[_-]+)*(?:{HINTS})(?:[_-]+(?:{PARTS}))*(?=$|\s)", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
BODY = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|text|body)(?=$|[\s_-])", re.I)
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "main": "main", "article": "article"}
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)>")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "framed", "hinted", "in_article", "in_body", "heading", "item", "framed_outside", "named")


def tokens(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before it, "/" of an end tag, name, attributes, place after it) of every tag; the last has no name. Comments and declarations are left out;
    what a raw element holds is text.

    A quote in a tag counts only after an equals sign. Where a tag's quotes leave it without an end, quotes are no longer heeded from there on, so the time stays in proportion to the page.
    """
    at, quoted, begin = 0, True, 0
    text: list[str] = []
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            close = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(close, at)
            text.append(page[begin:at])
            at = begin = len(page) if end < 0 else end + len(close)
            continue
        m = PLAIN_TAG.match(page, at)
        if m:
            end, attributes = m.end(), m[3]
        else:
            m = TAG_NAME.match(page, at)
            if not m:
                at += 1
                continue
            end = (_tag_end(page, m.end()) if quoted else -1) + 1
            if not end:
                quoted, end = False, page.find(">", at) + 1
                if not end:
                    break
            attributes = page[m.end() : end - 1]
        text.append(page[begin:at])
        name = m[2].lower()
        yield "".join(text), m[1], name, attributes, end
        text.clear()
        at = begin = end
        if name in RAW and not m[1]:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else len(page)
    text.append(page[begin:])
    yield "".join(text), "", "", "", len(page)


def _tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends a tag's attributes, -1 if none does."""
    while True:
        close, equals = page.find(">", at), page.find("=", at)
        if close < 0 or equals < 0 or close < equals:
            return close
        at = equals + 1
        while page[at : at + 1].isspace():
            at += 1
        if (quote := page[at : at + 1]) in ('"', "'"):
            at = page.find(quote, at + 1) + 1
            if not at:
                return -1


class _Page:
    """Text blocks of a page, with the elements that are open."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        self.text: list[str] = []
        self.linked: list[str] = []
        self.stack: list[list] = []  # [name, flags outside]
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
        self.blocks: list[int] = []  # places of elements that are not inline
        self.unended: dict[str, list[int]] = defaultdict(list)  # places of hidden elements without an end tag
        self.flags = self.hidden = 0
        self.ends: dict[str, int] = {}

    def leave(self, depth: int) -> None:
        """Ends the element at ``depth`` and what is in it."""
        while len(self.stack) > depth:
            name, self.flags = self.stack.pop()
            at = len(self.stack)
            if name:
                self.open[name].pop()
            self.hidden -= name in HIDDEN
            if self.blocks and self.blocks[-1] == at:
                self.blocks.pop()
            if self.unended[name] and self.unended[name][-1] == at:
                self.unended[name].pop()

    def last(self, names) -> int:
        return max((self.open[n][-1] for n in names if self.open[n]), default=-1)

    def has_end(self, name: str, at: int) -> bool:
        """Whether an end tag follows, before a further start tag if the element cannot be nested."""
        if name not in NESTED:
            found = re.compile(rf"<(/?){name}[\s/>]", re.I).search(self.page, at)
            return bool(found) and bool(found[1])
        if self.ends.get(name, -1) < at:
            found = re.compile(rf"</{name}[\s/>]", re.I).search(self.page, at)
            self.ends[name] = found.start() if found else len(self.page)
        return self.ends[name] < len(self.page)

    def close(self) -> None:
        """Ends the text block."""
        words = " ".join(entities.unescape("".join(self.text)).split())
        if words:
            n = words.count(" ") + 1
            inside = len(entities.unescape(" ".join(self.linked)).split())
            f = self.flags
            self.out.append((words, [n, min(1.0, inside / n), bool(f & 1), bool(f & 2), bool(f & 4), bool(f & 8), self.last(HEADINGS) >= 0, self.last(ITEMS) >= 0, bool(f & 16), bool(f & 32)]))
        self.text.clear()
        self.linked.clear()

    def say(self, data: str) -> None:
        if data and not self.hidden:
            self.text.append(data)
            if self.open["a"]:
                self.linked.append(data)

    def end(self, name: str) -> None:
        if not self.open[name]:
            return
        at = self.open[name][-1]
        if name in INLINE and self.blocks and self.blocks[-1] > at:  # the blocks in it stay open
            self.open[name].pop()
            self.stack[at][0] = ""
        else:
            self.leave(at)

    def start(self, name: str, attributes: str, at: int) -> None:
        if name in ENDS_PARAGRAPH and self.open["p"] and self.open["p"][-1] > self.last(("td", "th", "caption", "object", "template", "button")):
            self.leave(self.open["p"][-1])
        if name in SIBLINGS:
            mine, around = SIBLINGS[name]
            limit = self.last(around)
            if (found := min((self.open[n][-1] for n in mine if self.open[n] and self.open[n][-1] > limit), default=-1)) >= 0:
                self.leave(found)
        if name in HIDDEN and name != "head" and name not in RAW and not self.has_end(name, at):
            self.unended[name].append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.open[name].append(len(self.stack))
        self.stack.append([name, self.flags])
        self.hidden += name in HIDDEN
        if name in FRAME:
            self.flags |= 0 if name == "header" and self.flags & 4 else 1
            self.flags |= 0 if self.flags & 4 else 16
        if name in ("article", "main"):
            self.flags = self.flags | 4 if self.flags & 4 else self.flags & ~32 | 4
        if attributes and name not in ("body", "html", *HIDDEN):
            self.marked(name, {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)})

    def marked(self, name: str, found: dict[str, str]) -> None:
        """Flags that an element's attributes set."""
        role = ROLES.get(found.get("role", "").lower())
        if role in FRAME:
            self.flags |= 1
        elif role:
            self.flags |= 4
        names = f"{found.get('class', '')} {found.get('id', '')}"
        inside = self.flags & 4
        if name not in ("article", "main") and (name in GROUPS or not inside):
            asked = HEADER.sub(" ", names) if inside else names
            if HINT.search(asked):
                self.flags |= 2 if NAMED.search(asked) else 32
            elif name not in INLINE and BODY.search(names):
                self.flags |= 8
        if "display:none" in found.get("style", "").replace(" ", "").lower() or "hidden" in found:
            self.flags |= 2

    def read(self) -> list[tuple[str, list[float]]]:
        for data, slash, name, attributes, at in tokens(self.page):
            top = self.stack[-1][0] if self.stack else ""
            if top == "head" and data.strip():
                self.leave(len(self.stack) - 1)
            self.say(data)
            if not name:
                break
            if self.stack and not slash:
                if self.stack[-1][0] == "head" and name not in IN_HEAD:
                    self.leave(len(self.stack) - 1)
                elif name == "body" and self.open["head"]:
                    self.leave(self.open["head"][0])
                depths = [d[0] for k, d in self.unended.items() if d and (name in BLOCK or name in ENDED_BY.get(k, ()))]
                if depths:
                    self.leave(min(depths))
            if name == "br":
                self.say(" ")
                continue
            if name not in INLINE and name not in SILENT:
                self.close()
            if slash:
                self.end(name)
            elif name not in VOID and not (attributes.endswith("/") and (name in ("svg", "math") or self.open["svg"] or self.open["math"])):
                self.start(name, attributes, at)
        self.close()
        return self.out


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Text blocks of a page and each one's own features (words, link density, enclosure), in page order."""
    return _Page(page).read()


def features(found: list[tuple[str, list[float]]]) -> np.ndarray:
    """(n, len(FEATURES)): each block's own features with word count and link density of the blocks before and after it.

    ``named`` is 1 in elements whose class name only may mean boilerplate, and 2 there if the page has an article, or an element named like one, and the block is not in it.
    """
    own = np.array([f for _, f in found], float).reshape(-1, 10)
    out = np.zeros((len(own), len(FEATURES)))
    out[:, :2] = own[:, :2]
    out[1:, 2:4] = own[:-1, :2]
    out[:-1, 4:6] = own[1:, :2]
    out[:, 6:] = own[:, 2:]
    inside = (own[:, 4] > 0) | (own[:, 5] > 0)
    if (inside & (own[:, 2] == 0) & (own[:, 3] == 0)).any():
        out[:, -1] *= 2 - inside
    return out


# ---------------------------------------------------------------- the labelled table and the tree


def labelled_blocks(pages: int = 400, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A small labelled table: features and labels (1 main text) of the blocks of made-up pages, whose makers know each block's part.

    Words with an ``x`` stand in the main text and words with a ``y`` elsewhere, which labels a block after it was parsed.
    """
    r = random.Random(seed)
    words = lambda n, mark: " ".join(mark * r.randint(2, 9) for _ in range(n))
    link = lambda n, mark: f'<a href="/">{words(n, mark)}</a>'
    pick = r.choice

    many = lambda: round(300 ** r.random())  # noqa: E731 words of a block, main text or not: 1 to 300, so that length alone tells nothing

    def misleading() -> str:
        return pick(["social", "side", "comments", "share", "search", "legal", "notice", "promo", "related", "menu", "tag"]) + pick("-_") + pick(["history", "story", "policy", "study", "science", "theory", "life", "guide", "report"])

    def menu() -> str:
        items = "".join(f"<li>{link(r.randint(1, 5), 'y')}</li>" for _ in range(r.randint(2, 12)))
        return pick(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="nav">{}</ul>', "<header><ul>{}</ul></header>", '<div role="navigation">{}</div>', "<ul>{}</ul>", "<div>{}</div>"]).format(items)

    def boiler(inside: bool, alone: bool = False) -> str:
        body = words(many(), "y")
        shapes = ['<div class="ad">{}</div>', "<aside><p>{}</p></aside>", '<div class="sidebar"><h3>{}</h3></div>', '<div id="cookie-notice"><p>{}</p></div>', "<form><label>{}</label><input></form>", '<div class="comments"><p>{}</p><p>{}</p></div>', '<section id="comments"><div class="comment"><p>{}</p></div></section>', '<div class="share">{}</div>', '<div class="related-posts">{}</div>', '<div class="newsletter"><p>{}</p></div>', '<div class="banner">{}</div>', "<footer><p>{}</p></footer>", "<nav><h2>{}</h2></nav>", "<aside><ul><li>{}</li></ul></aside>"]
        if r.random() < 0.2:  # names that mislead: links within an article or on a page without one, anything outside
            links = "".join(f"<p>{link(r.randint(2, 9), 'y')} {words(r.randint(0, 1), 'y')}</p>" for _ in range(r.randint(2, 6)))
            return f'<div class="{misleading()}">{links if inside or alone or r.random() < 0.5 else f"<p>{body}</p>"}</div>'
        return pick(shapes + ([] if inside else ["<header><p>{}</p></header>", "<header><h1>{}</h1></header>", '<p class="ad">{}</p>'])).replace("{}", body)

    def piece() -> str:
        if r.random() < 0.1:
            return pick(['<div class="{0}"><p>{1}</p></div>', '<section id="{0}"><h2>{2}</h2><p>{1}</p></section>']).format(misleading(), words(many(), "x"), words(r.randint(1, 8), "x"))
        shapes = ["<p>{}</p>"] * 6 + ["<p><b>{}</b></p>", "<h2>{}</h2>", "<h3>{}</h3>", "<ul><li>{}</li><li>{}</li></ul>", "<ol><li><p>{}</p></li></ol>", "<dl><dt>{}</dt><dd>{}</dd></dl>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td><td>{}</td></tr></table>", "<div>{}</div>", "<section><p>{}</p></section>", f"<p>{link(r.randint(1, 5), 'x')} {{}}</p>"]
        return pick(shapes).replace("{}", words(many(), "x"))

    def main() -> str:
        out = [pick(["<h1>{}</h1>", "<header><h1>{}</h1></header>", "<header><h1>{}</h1><p>{}</p></header>"]).replace("{}", words(many(), "x"))] if r.random() < 0.8 else []
        linked = [f"<p>{link(4, 'x')}</p>", f"<ul><li>{link(3, 'x')}</li><li>{link(2, 'x')}</li></ul>", f"<h2>{link(3, 'x')}</h2>"]
        for _ in range(r.randint(1, 12)):
            out.append(pick(linked) if r.random() < 0.1 else piece())
            if r.random() < 0.08:
                out.append(boiler(True))
        return "".join(out)

    def bare() -> str:
        return "".join(piece() for _ in range(r.randint(1, 8)))

    xs, ys = [], []
    for _ in range(pages):
        inside = pick(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="post"><div class="entry-content">{}</div></div>', "bare"])
        alone = inside == "bare"
        inside = pick(["<div>{}</div>", "{}"]).replace("{}", bare()) if alone else inside.replace("{}", main())
        foot = pick(["<footer>{}</footer>", '<div class="footer"><p>{}</p></div>', '<div id="copyright">{}</div>']).replace("{}", words(many(), "y"))
        before, after = [menu()] + [boiler(False, alone) for _ in range(r.randint(0, 2))], [boiler(False, alone) for _ in range(r.randint(0, 3))] + [menu()] * r.randint(0, 1) + [foot]
        found = blocks(f"<html><head><title>{words(4, 'y')}</title></head><body>{''.join(before)}{inside}{''.join(after)}</body></html>")
        xs.append(features(found))
        ys += ["x" in t for t, _ in found]
    return np.concatenate(xs), np.array(ys, int)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4) -> list[tuple]:
    """A decision tree by Gini impurity, as nodes (feature, threshold, left, right) or (-1, share of main text, 0, 0)."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, left: int) -> int:
        me, share = len(nodes), y[rows].mean()
        nodes.append((-1, float(share), 0, 0))
        if not left or share in (0, 1) or len(rows) < 2 * least:
            return me
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v, one = x[rows[order], f], np.cumsum(y[rows[order]])
            n = np.arange(1, len(v))
            a, b = one[:-1] / n, (one[-1] - one[:-1]) / (len(v) - n)
            cost = np.where((v[1:] > v[:-1]) & (n >= least) & (len(v) - n >= least), a * (1 - a) * n + b * (1 - b) * (len(v) - n), np.inf)
            k = int(np.argmin(cost)) if len(cost) else 0
            if len(cost) and cost[k] < best[0]:
                best = (cost[k], f, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me] = (best[1], best[2], grow(rows[low], left - 1), grow(rows[~low], left - 1))
        return me

    grow(np.arange(len(y)), depth)
    return nodes


def judge(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """Whether each row is main text."""
    out = np.zeros(len(x), bool)

    def go(node: int, rows: np.ndarray) -> None:
        f, t, a, b = tree[node]
        if f < 0:
            out[rows] = t >= 0.5
        elif len(rows):
            low = x[rows, f] <= t
            go(a, rows[low])
            go(b, rows[~low])

    go(0, np.arange(len(x)))
    return out


def main_text(page: str | None, tree: list[tuple]) -> str:
    found = blocks(page or "")
    return " ".join(t for (t, _), keep in zip(found, judge(tree, features(found)), strict=True) if keep)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, main text and its code points of every page."""
    tree = train_tree(*labelled_blocks())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                found = [blocks(p or "") for p in part.column(2).to_pylist()]
                keep = judge(tree, np.concatenate([features(x) for x in found]))
                at, texts = 0, []
                for x in found:
                    texts.append(" ".join(t for (t, _), k in zip(x, keep[at : at + len(x)], strict=True) if k))
                    at += len(x)
                yield C.batches(schema, [part.column(0), part.column(1), texts, [len(t) for t in texts]])

    return C.map_arrow(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run, "page_id long, url string, text string, n_chars long")
