"""HTML main text: a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks: stretches of text between block-level tags, each with its chain of open
elements. Features are the ancestors' tags and class or id words, and the block's own text. The field labels the
sequence of blocks as article or not; it is trained by its log likelihood on labelled pages written by a seeded
generator in many layouts, and decoded by Viterbi.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_frames

#: Elements that begin and end a block. All others (phrasing, fallback content, mathematics, drawings, custom elements) run within one, so their text stays in its place.
BLOCK = frozenset("address article aside base blockquote body button caption center col colgroup dd details dialog dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html input label legend li link main menu meta nav ol optgroup option p param pre search section select summary table tbody td textarea tfoot th thead title tr track ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is code or never parsed; as in browsers, an unclosed one lasts to the end of the page.
RAW = "script|style|iframe|noembed|noframes"
#: An opening tag of the key's kind ends an open element of the kinds beside it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
INNER = frozenset("article main nav aside footer header form body head".split())
BARS = frozenset("ul ol dl table body article section div form nav".split())
#: Elements open at once, as in browsers. Deeper ones open no level of their own; their text stays.
DEPTH = 512
COMMENT, CODE, PLAIN = r"<!--(?:-?>|.*?(?:--!?>|\Z))", rf"<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)", r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>"
#: A tag whose quoted values may hold ``>`` comes before a plain one. Where quotes don't pair up to the end of the page, the rest is read by LOOSE, so no search fails twice.
TOKEN = re.compile(rf"{COMMENT}|{CODE}|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|{PLAIN}", re.S | re.I)
LOOSE = re.compile(rf"{COMMENT}|{CODE}|(?!)()()()|{PLAIN}", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PIECES = re.compile(r"[a-z]+").findall
HINTS = {
    "ad": "ad ads adv advert advertisement sponsor sponsored promo promoted promotion banner adsense dfp teaser",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "side": "sidebar side aside rail widget related recommended recommendations popular trending more",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog toast privacy paywall disclaimer",
    "form": "form newsletter subscribe signup login search register contact",
    "talk": "comment comments reply replies discussion disqus respond thread reactions",
    "share": "share sharing social follow like tags tag byline meta",
    "head": "header masthead topbar top logo site branding",
    "foot": "footer foot bottom copyright legal colophon",
    "main": "article content main post entry story body text prose page",
}
GROUP = {w: g for g, words in HINTS.items() for w in words.split()}


class Path:
    """An open element below its ancestors, one object for all equal paths of a page: what the field wants to know of it is worked out once."""

    __slots__ = ("parent", "tag", "tags", "groups", "inner", "below", "told")

    def __init__(self, parent: Path | None, tag: str, marks: tuple[str, ...]):
        self.parent, self.tag, self.below, self.told = parent, tag, {}, None
        tags, groups, inner = (parent.tags, parent.groups, parent.inner) if parent else (frozenset(), frozenset(), "")
        self.tags = tags if not tag or tag in tags else tags | {tag}
        self.groups = groups if groups.issuperset(marks) else groups.union(marks)
        self.inner = tag if tag in INNER else inner

    def child(self, tag: str, marks: tuple[str, ...]) -> Path:
        found = self.below.get((tag, marks))
        if found is None:
            found = self.below[tag, marks] = Path(self, tag, marks)
        return found

    def features(self) -> list[str]:
        if self.told is None:
            self.told = [f"in:{t}" for t in sorted(self.tags)] + [f"mark:{g}" for g in sorted(self.groups)] + [f"tag:{self.tag}", f"inner:{self.inner}"] + ["inside"] * (not self.tags.isdisjoint(("article", "main")))
        return self.told


class Block:
    __slots__ = ("path", "text", "linked", "size")

    def __init__(self, path, text, linked, size):
        self.path, self.text, self.linked, self.size = path, text, linked, size


@lru_cache(maxsize=20_000)
def marks_of(attributes: str) -> tuple[str, ...]:
    """Groups that an element's class, id and role words hint at."""
    words = {w for m in NAMES.finditer(attributes) for w in PIECES((m[1] or m[2] or m[3] or "").lower())}
    return tuple(sorted({GROUP[w] for w in words if w in GROUP}))


def tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and code of a page in order. No search goes over what a failed one went over: behind the last ``>`` only a comment can begin."""
    at, last, scan = 0, page.rfind(">") + 1, TOKEN
    while at < last:
        m = scan.search(page, at)
        if m is None or m.start() >= last:
            break
        if scan is TOKEN and m[6]:
            scan = LOOSE
        yield m
        at = m.end()
    rest = page.find("<!--", max(at, last))
    if rest >= 0:
        yield re.compile(COMMENT, re.S).match(page, rest)


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order; unclosed and misnested elements are mended as browsers roughly do. Time and memory grow with the page's length alone."""
    blocks: list[Block] = []
    stack: list[Path] = []
    top = Path(None, "", ())
    deeper: dict[str, int] = {}  # elements that found no level left, by tag
    held: list[str] = []
    link_depth, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append(Block(stack[-1] if stack else top, text, min(1.0, linked / len(text)), len(text)))
            held.clear()
        linked = 0

    for m in tokens(page):
        if m.start() > at:
            part = page[at : m.start()]
            held.append(part)
            linked += len(part) * (link_depth > 0)
        at = m.end()
        name = m.re.groups and (m[3] or m[6])
        if not name:
            continue
        tag, closing = name.lower(), (m[2] or m[5]) == "/"
        if tag not in BLOCK:
            if tag == "a":
                link_depth = 0 if closing else 1
            elif tag == "br":
                held.append("\n")
            continue
        flush()
        link_depth = 0
        if closing:
            if deeper.get(tag):
                deeper[tag] -= 1
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1].tag == "p":
            stack.pop()
        shuts = CLOSES.get(tag)
        if shuts:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in shuts:
                    del stack[k:]
                elif stack[k].tag in BARS:
                    break
        if tag not in VOID:
            if len(stack) == DEPTH:
                deeper[tag] = deeper.get(tag, 0) + 1
                continue
            attributes = m[4] if m[3] else m[7]
            stack.append((stack[-1] if stack else top).child(tag, marks_of(attributes) if attributes.strip() else ()))
    if at < len(page):
        held.append(page[at:])
    flush()
    return blocks


def bucket(x: float, limits: tuple) -> int:
    return sum(x >= b for b in limits)


def features(block: Block, previous: Block | None) -> list[str]:
    words = block.text.count(" ") + 1
    out = [*block.path.features(), f"words:{bucket(words, (3, 8, 20, 50))}", f"link:{bucket(block.linked, (0.2, 0.6, 0.95))}", "bias"]
    if block.text[-1] in ".!?:":
        out.append("stop")
    if "©" in block.text or "copyright" in block.text.lower()[:200]:
        out.append("rights")
    if previous is not None:
        out.append("same" if previous.path.parent is block.path.parent else "moved")
    return out


class Field:
    """Weights of a two-label linear-chain CRF; label 1 is article text."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.edge = np.zeros((2, 2))

    def emissions(self, rows: list[list[str]]) -> list[float]:
        get = self.w.get
        return [sum(get(f, 0.0) for f in r) for r in rows]

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        (t00, t01), (t10, t11) = self.edge.tolist()
        a, b, back = 0.0, 0.0, []
        for k, s in enumerate(self.emissions(rows)):
            if k:
                from0, from1 = int(b + t10 > a + t00), int(b + t11 > a + t01)
                back.append((from0, from1))
                a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
            else:
                b = s
        if not rows:
            return []
        out = [int(b > a)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]

    def gradient(self, rows: list[list[str]], labels: list[int]) -> tuple[float, list[float], np.ndarray]:
        """Negative log likelihood, and its gradient by emission and by edge (forward-backward in logs)."""
        e = np.zeros((len(rows), 2))
        e[:, 1] = self.emissions(rows)
        n = len(rows)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = e[0]
        for k in range(1, n):
            f[k] = e[k] + np.logaddexp.reduce(f[k - 1][:, None] + self.edge, axis=0)
        for k in range(n - 2, -1, -1):
            b[k] = np.logaddexp.reduce(self.edge + e[k + 1] + b[k + 1], axis=1)
        z = np.logaddexp.reduce(f[-1])
        y = np.array(labels)
        path = e[np.arange(n), y].sum() + self.edge[y[:-1], y[1:]].sum()
        by_edge = np.zeros((2, 2))
        for k in range(1, n):
            by_edge += np.exp(f[k - 1][:, None] + self.edge + e[k] + b[k] - z)
            by_edge[y[k - 1], y[k]] -= 1
        return float(z - path), (np.exp(f[:, 1] + b[:, 1] - z) - y).tolist(), by_edge


def written_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page in a random layout, and the label of each of its leaf blocks in order."""
    word = lambda: "".join(rng.choice(list("aeionrstlhdu"), int(rng.integers(2, 9))))
    say = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b + 1))))
    one = lambda *x: x[int(rng.integers(len(x)))]
    many = lambda f, a, b: "".join(f() for _ in range(int(rng.integers(a, b + 1))))
    link = lambda: f'<li><a href="/{word()}">{say(1, 3)}</a></li>'
    prose = lambda a=1, b=60: f"{say(a, b).capitalize()}{one('.', '.', '.', '?', '!', '')}"
    out: list[tuple[str, int]] = []

    def put(markup: str, label: int) -> None:
        out.append((markup, label))

    def junk(kind: str) -> None:
        put({
            "menu": lambda: one("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="nav">{}</ul>', '<div role="navigation">{}</div>').format(many(link, 2, 8)),
            "header": lambda: one("<header>{}</header>", '<div class="site-header">{}</div>', '<div id="masthead">{}</div>').format(f"<h1>{say(1, 4)}</h1><p>{prose(2, 8)}</p>"),
            "footer": lambda: one("<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>').format(f"{one('&copy; ', '')}{word()}.example.org &middot; {prose(4, 25)}" + one("", f"<p>{prose(3, 20)}</p>")),
            "side": lambda: one("<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="related">{}</div>').format(f"<h3>{say(1, 3)}</h3>" + one(f"<ul>{many(link, 2, 6)}</ul>", f"<p>{prose(5, 40)}</p>")),
            "notice": lambda: f'<div class="{one("cookie-notice", "consent", "alert", "notice", "gdpr-banner", "popup")}"><p>{prose(5, 30)}</p>{one("", "<button>" + say(1, 2) + "</button>")}</div>',
            "ad": lambda: f'<!-- ad --><div class="{one("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "banner")}">{one(prose(3, 30), "<p>" + prose(3, 40) + "</p>")}</div>',
            "form": lambda: f'<form action="/s"><label>{say(1, 4)}</label><input name="q"><p>{prose(3, 15)}</p><button>{say(1, 2)}</button></form>',
            "talk": lambda: one('<section class="comments">{}</section>', '<div id="comments">{}</div>', '<div class="comment-list">{}</div>').format(f"<h3>{say(1, 3)}</h3>" + many(lambda: one("<div class='comment'><p>{}</p></div>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>").format(prose(4, 50)), 1, 5)),
            "share": lambda: f'<div class="{one("share", "social", "tags")}">{many(link, 2, 4)}</div>',
        }[kind](), 0)

    lang = word()[:2]
    put(f'<!DOCTYPE html><html lang="{lang}"><head><meta charset="utf-8"><title>{say(2, 10)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>', 0)
    for kind in ("notice", "header", "menu", "ad"):
        if rng.random() < (0.85 if kind == "menu" else 0.45):
            junk(kind)
    shell = one(("<article>", "</article>"), ("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>"), ('<div><div class="' + word() + '">', "</div></div>"), ("", ""))
    loose = rng.random() < (0.5 if shell[0] in ("", "<div>") else 0.1)  # paragraphs that are plain divs
    put(shell[0], 0)
    put(f"<h1>{say(2, 10)}</h1>", 1)
    for _ in range(int(rng.integers(1, 12))):
        kind = rng.random()
        if kind < 0.12:
            junk(one("ad", "side", "form", "share", "notice"))
        elif kind < 0.24:
            put(f"<p><b>{prose(1, 20)}<br>", 1)
        elif kind < 0.32:
            put(f"<h2>{say(1, 6)}</h2>", 1)
        elif kind < 0.4:
            put("<ul>" + many(lambda: f"<li>{prose(1, 14)}</li>", 1, 4) + "</ul>", 1)
        elif kind < 0.46:
            put(f"<blockquote>{prose(4, 30)}</blockquote>", 1)
        elif kind < 0.5:
            put("<table>" + many(lambda: f"<tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr>", 1, 3) + "</table>", 1)
        elif kind < 0.58:
            put(f'<p>{prose(1, 20)} <a href="/{word()}">{say(1, 4)}</a> {prose(1, 20)}</p>', 1)
        else:
            put(one("<div>{}</div>", "<div>{}</div>", "<p>{}</p>", "<section><div>{}</div></section>").format(prose(1, 90)) if loose else f"<p>{prose(1, 90)}</p>", 1)
    if rng.random() < 0.2:
        junk("talk")
    put(shell[1], 0)
    for kind in ("talk", "side", "ad", "form", "share", "menu"):
        if rng.random() < 0.35:
            junk(kind)
    if rng.random() < 0.85:
        junk("footer")
    put("</body></html>", 0)
    page, labels, seen = "", [], 0
    for markup, label in out:
        page += markup
        n = len(leaf_blocks(page))
        labels += [label] * (n - seen)
        seen = n
    return page, labels


def train(pages: int = 240, epochs: int = 8, seed: int = 17) -> Field:
    """Adagrad on the log likelihood of written pages, with a little decay so that no feature decides alone."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        page, labels = written_page(rng)
        blocks = leaf_blocks(page)
        data.append(([features(b, blocks[k - 1] if k else None) for k, b in enumerate(blocks)], labels))
    field, seen, seen_edge = Field(), {}, np.full((2, 2), 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            rows, labels = data[i]
            _, by_row, by_edge = field.gradient(rows, labels)
            total: dict[str, float] = {}
            for r, d in zip(rows, by_row):
                for f in r:
                    total[f] = total.get(f, 0.0) + d
            for f, d in total.items():
                d += 1e-3 * field.w.get(f, 0.0)
                seen[f] = seen.get(f, 1e-2) + d * d
                field.w[f] = field.w.get(f, 0.0) - 0.3 * d / seen[f] ** 0.5
            seen_edge += by_edge**2
            field.edge -= 0.3 * by_edge / np.sqrt(seen_edge)
    return field


def main_blocks(page: str, field: Field) -> list[str]:
    blocks = leaf_blocks(page)
    labels = field.decode([features(b, blocks[k - 1] if k else None) for k, b in enumerate(blocks)])
    return [b.text for b, y in zip(blocks, labels) if y]


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars of every page; blocks are joined by a blank line.

    Null html is empty; a page without article blocks has an empty text. Repeated rows each give a row; null ids and
    urls pass through; extra columns are not read; an empty table gives no rows. Whole pages are read, of any length;
    unclosed elements end where a browser ends them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = ["\n\n".join(main_blocks(p, field)) for p in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": list(map(len, text))})

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    return map_frames(rows, run, "page_id long, url string, text string, n_chars long")
