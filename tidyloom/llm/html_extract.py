"""Main text of web pages: gradient-boosted trees over features of DOM nodes, decoded along the tree.

A page becomes a tree of its block elements.  Each block has features of its subtree (text, links, markup density),
its tag and attribute words, its depth and its siblings; boosted trees give the odds that it holds main text.  The
decoder then labels all blocks at once: below a kept block others may be dropped, below a dropped one nothing is kept,
and a container may leave the choice to its parts.  The best labelling under these rules is found bottom-up.

The trees are fitted here, on pages built from the usual parts of a site in many arrangements, whose labels are known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import ship

#: Pages the trees are fitted on.
TRAIN_PAGES = 600
PAGES_AT_ONCE = 200
ROUNDS, DEPTH, RATE, BINS = 40, 4, 0.25, 32

# Quotes enclose a value only directly after its equals sign; elsewhere in a tag they are plain characters.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>=]++|=)*+)>"
                    r"|</?[a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no markup, and elements that hold no text of a page.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "textarea", "iframe")}
HIDDEN = frozenset("noscript template svg select button object canvas video audio".split())
#: What a head can hold.
HEAD = frozenset("html head base link meta title script style noscript template basefont bgsound noframes".split())

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open one of the second kind.
ENDS = {**{t: "p" for t in ("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                            "header hr main nav ol p pre section table ul").split()},
        "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "body": "head"}
SCOPES = frozenset("ul ol dl table body html article section div main nav aside footer header form".split())

KINDS = [frozenset(k.split()) for k in (
    "p blockquote pre", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "div section", "article main", "nav menu", "header",
    "footer", "aside", "form fieldset", "table tbody tr td th", "figure figcaption")]
NAMES = [frozenset(k.split()) for k in (
    "article content main body post entry story text page prose", "nav navigation navbar menu breadcrumb breadcrumbs "
    "pagination pager tabs toc", "header masthead banner topbar logo site", "footer copyright legal colophon",
    "sidebar side aside widget rail", "ad ads advert advertisement adverts sponsor sponsored promo promoted adbox",
    "comment comments reply replies discussion respond disqus", "cookie cookies consent notice notices alert gdpr modal "
    "popup overlay", "related share sharing social recommended more tags newsletter subscribe", "form search login signup")]
_KIND = {t: i for i, k in enumerate(KINDS) for t in k}
_NAME = {t: i for i, k in enumerate(NAMES) for t in k}


class Page:
    """The block elements of a page, parents before children, and its runs of text."""

    def __init__(self, source: str):
        self.tag, self.names, self.parent, self.tags = ["#page"], [()], [-1], [0]
        self.runs: list[list] = []  # block, text parts, characters in links
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, link, fresh = [0], 0, False, True
        before = {}  # of open hidden elements, what the page was before
        find = _TOKEN.search
        while True:
            m = find(source, at)
            piece = source[at:m.start() if m else len(source)]
            if self.tag[stack[-1]] == "head" and (piece.strip() or m and not m[1] and m[2] and m[2].lower() not in HEAD):
                stack.pop()  # its end tag may be left out
                fresh, link = True, False
            if piece and "head" not in (self.tag[b] for b in stack[1:3]):
                if fresh:
                    if not piece.isspace():
                        self.runs.append([stack[-1], [piece], len(piece) if link else 0])
                        fresh = False
                else:
                    self.runs[-1][1].append(piece)
                    self.runs[-1][2] += len(piece) if link else 0
            if not m:
                return
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            self.tags[stack[-1]] += 1
            if tag in INLINE:
                link = tag == "a" and not m[1] if tag == "a" else link
                continue
            if tag == "br":
                if not fresh:
                    self.runs[-1][1].append(" ")
                continue
            if not m[1] and tag in _RAW:
                end = _RAW[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag in VOID and tag != "hr":
                continue
            if m[1] and tag in HIDDEN:
                k = next((k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == tag), 0)
                if k:  # only an element that has its end is left out, else all that follows would be
                    fresh, link = self._back(*before.pop(stack[k]))
                    del stack[k:]
                continue
            if tag == "svg" and m[3].endswith("/"):
                continue
            if tag in HIDDEN:
                run = self.runs[-1] if self.runs else (0, (), 0)
                before[len(self.tag)] = len(self.tag), len(self.runs), len(run[1]), run[2], fresh, link
            fresh, link = True, False
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
                    if tag == "p" and self.tag[stack[k]] in SCOPES:
                        break
                continue
            ended = ENDS.get(tag, "").split()
            for k in range(len(stack) - 1, 0, -1):
                open_ = self.tag[stack[k]]
                if open_ in ended:
                    del stack[k:]
                    break
                if open_ in SCOPES or open_ in HIDDEN:
                    break
            if tag == "hr" or m[3].endswith("/") and tag not in SCOPES and tag not in HIDDEN:
                continue
            words = [w.lower() for a in _ATTRIBUTE.findall(m[3]) for w in _WORD.findall(a[1] or a[2] or a[3])]
            self.tag.append(tag)
            self.names.append(tuple({_NAME[w] for w in words if w in _NAME}))
            self.parent.append(stack[-1])
            self.tags.append(0)
            stack.append(len(self.tag) - 1)

    def _back(self, blocks: int, runs: int, parts: int, linked: int, fresh: bool, link: bool) -> tuple[bool, bool]:
        """Leave out all blocks and runs since these counts."""
        for column in (self.tag, self.names, self.parent, self.tags):
            del column[blocks:]
        del self.runs[runs:]
        if runs:
            del self.runs[-1][1][parts:]
            self.runs[-1][2] = linked
        return fresh, link

    def texts(self) -> list[str]:
        """Each run with references decoded and white space collapsed."""
        out = []
        for _, parts, _ in self.runs:
            text = "".join(parts)
            out.append(" ".join((html.unescape(text) if "&" in text else text).split()))
        return out


FEATURES = 16 + 2 * len(KINDS) + 2 * len(NAMES)


def features(page: Page, texts: list[str]) -> np.ndarray:
    """A row for each block."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, links, marks, runs = (np.zeros(n) for _ in range(4))
    first, last = np.full(n, np.inf), np.zeros(n)
    at = 0
    for (block, _, link), text in zip(page.runs, texts):
        size = len(text)
        own[block] += size
        links[block] += min(link, size)
        marks[block] += sum(map(text.count, ".,;!?"))
        runs[block] += size > 0
        first[block] = min(first[block], at)
        at += size
        last[block] = max(last[block], at)
    chars, tags, blocks = own.copy(), np.array(page.tags, float), np.ones(n)
    depth, count, index = np.zeros(n), np.zeros(n), np.zeros(n)
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        for column in (chars, links, marks, runs, tags, blocks):
            column[p] += column[v]
        first[p] = min(first[p], first[v])
        last[p] = max(last[p], last[v])
    for v in range(1, n):
        p = page.parent[v]
        depth[v] = depth[p] + 1
        index[v] = count[p]
        count[p] += 1
    total = max(at, 1)
    above = np.maximum(parent, 0)
    siblings = count[above]
    others = (chars[above] - own[above] - chars) / np.maximum(siblings - 1, 1)
    x = np.zeros((n, FEATURES), "f4")
    x[:, :16] = np.stack([
        np.log1p(chars), links / np.maximum(chars, 1), np.log1p(own), tags / (chars + 1), np.log1p(blocks),
        np.log1p(chars / np.maximum(runs, 1)), depth, np.log1p(siblings), index / np.maximum(siblings, 1),
        chars / np.maximum(chars[above], 1), chars / total, np.minimum(first, total) / total, last / total,
        marks / np.maximum(chars, 1), np.log1p(np.maximum(others, 0)), links[above] / np.maximum(chars[above], 1)], 1)
    for v in range(n):
        kind = _KIND.get(page.tag[v])
        if kind is not None:
            x[v, 16 + kind] = 1
        for name in page.names[v]:
            x[v, 16 + 2 * len(KINDS) + name] = 1
    # What stands above a block counts for it too.
    near = slice(16, 16 + len(KINDS)), slice(16 + 2 * len(KINDS), 16 + 2 * len(KINDS) + len(NAMES))
    far = slice(16 + len(KINDS), 16 + 2 * len(KINDS)), slice(16 + 2 * len(KINDS) + len(NAMES), FEATURES)
    for v in range(1, n):
        for a, b in zip(near, far):
            x[v, b] = np.maximum(x[page.parent[v], a], x[page.parent[v], b])
    return x


class Boosted:
    """Gradient-boosted trees of one depth for a yes or no question."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
        rate = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(rate / (1 - rate)))
        self.feature, self.limit, self.value = [], [], []
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), "i8")
            feature, limit = np.zeros((1 << DEPTH) - 1, "i4"), np.full((1 << DEPTH) - 1, np.inf, "f4")
            for level in range(DEPTH):
                width, at = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-6)
                place = node - at
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    cell = place * BINS + binned[:, f]
                    gs, hs = (np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h))
                    gl, hl, gt, ht = gs[:, :len(e)], hs[:, :len(e)], gs[:, -1:], hs[:, -1:]
                    gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    for v in np.flatnonzero(top > best):
                        best[v], feature[at + v], limit[at + v] = top[v], f, e[k[v]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
            leaf = node - ((1 << DEPTH) - 1)
            gs, hs = (np.bincount(leaf, w, 1 << DEPTH) for w in (g, h))
            value = RATE * gs / (hs + 1)
            score += value[leaf]
            for store, new in ((self.feature, feature), (self.limit, limit), (self.value, value)):
                store.append(new)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), "i8")
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            score += value[node - ((1 << DEPTH) - 1)]
        return score


def decode(page: Page, odds: np.ndarray, weight: np.ndarray) -> list[bool]:
    """Whether each block's own text is kept, by the best labelling without contradictions."""
    n = len(page.tag)
    keep_cost = (np.logaddexp(0, -odds) * weight).tolist()
    drop_cost = (np.logaddexp(0, odds) * weight).tolist()
    # A container that leaves the choice to its parts pays as if its own odds were even; text of its own is dropped.
    open_cost = (np.log(2) * weight).tolist()
    keep, drop, open_ = keep_cost[:], drop_cost[:], open_cost[:]
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        drop[p] += drop[v]
        keep[p] += min(keep[v], drop[v])
        open_[p] += min(keep[v], drop[v], open_[v])
    state = [2] * n  # 0 dropped, 1 kept, 2 open
    state[0] = min((drop[0], 0), (keep[0], 1), (open_[0], 2))[1]
    for v in range(1, n):
        above = state[page.parent[v]]
        options = [(drop[v], 0), (keep[v], 1), (open_[v], 2)][:1 + above]
        state[v] = min(options)[1]
    return [s == 1 for s in state]


def extract(sources: list[str], model: Boosted) -> list[str]:
    """The main text of each page: blocks in page order, one a line."""
    pages = [Page(source) for source in sources]
    texts = [page.texts() for page in pages]
    rows = [features(page, text) for page, text in zip(pages, texts)]
    x = np.concatenate(rows) if rows else np.zeros((0, FEATURES), "f4")
    some = x[:, 0] > 0
    odds = np.zeros(len(x))
    odds[some] = model.odds(x[some])
    out, at = [], 0
    for page, text in zip(pages, texts):
        end = at + len(page.tag)
        kept = decode(page, odds[at:end], some[at:end].astype(float))
        out.append("\n".join(t for (block, _, _), t in zip(page.runs, text) if t and kept[block]))
        at = end
    return out


def _made_page(rng: random.Random) -> str:
    """A page of the usual parts in some arrangement; its main text is marked by the letter it begins its words with."""
    def words(n: int, main: bool) -> str:
        out = [("m" if main else "b") + "".join(rng.choices("aeioulnrst", k=rng.randint(1, 9))) for _ in range(max(1, n))]
        for i in range(len(out)):
            if rng.random() < 0.12:
                out[i] += rng.choice([".", ".", ",", ";", "?"])
        return " ".join(out)

    def links(n: int) -> str:
        items = [f'<a href="/{i}">{words(rng.choice([1, 1, 1, 2, 3]), False)}</a>' for i in range(n)]
        form = rng.randrange(4)
        if form == 0:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        if form == 1:
            return "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
        return " | ".join(items) if form == 2 else "".join(f"<div>{i}</div>" for i in items)

    def named(names: str, tags: str = "div div section") -> tuple[str, str]:
        tag = rng.choice(tags.split())
        name = rng.choice(names.split())
        own = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-box x{rng.randrange(9)}"', f" class='{name}'"])
        return f"<{tag}{own}>", f"</{tag}>"

    def part(tags: tuple[str, str], body: str) -> str:
        return tags[0] + body + tags[1]

    def prose(n: int, main: bool) -> str:
        out = []
        for _ in range(n):
            text = words(int(rng.lognormvariate(3, 1.2)), main)
            if rng.random() < 0.3:
                text = f"<b>{text}" + rng.choice(["</b>", "<br>", "</b><br>"])
            elif rng.random() < 0.3:
                text += f' <a href="/x">{words(2, main)}</a> {words(8, main)}'
            out.append(f"<p>{text}" + rng.choice(["</p>", "</p>", "</p>", "", "\n"]))
        return "".join(out)

    def junk() -> str:
        return rng.choice([
            lambda: part(named("ad ads advert sponsor promo banner-ad"), words(rng.randint(2, 25), False)),
            lambda: part(named("cookie consent notice alert gdpr"), prose(1, False) + links(1)),
            lambda: part(named("share social related newsletter tags"), words(3, False) + links(rng.randint(2, 6))),
            lambda: "<form>" + words(2, False) + '<input name="q"><button>Go</button></form>',
        ])()

    top = rng.choice([
        lambda: "<nav>" + links(rng.randint(3, 12)) + "</nav>",
        lambda: "<header>" + words(rng.randint(1, 8), False) + "<nav>" + links(rng.randint(3, 9)) + "</nav></header>",
        lambda: part(named("menu nav navbar"), links(rng.randint(3, 12))),
        lambda: part(named("header masthead"), words(rng.randint(1, 12), False) + links(rng.randint(0, 6))),
    ])()
    title = f"<h{rng.choice('112')}>{words(rng.randint(2, 12), True)}</h1>"
    inner = title + prose(rng.choice([0, 1, 1, 2, 3, 4, 5, 8, 12, 20]), True)
    for _ in range(rng.choice([0, 0, 1, 2])):
        inner += rng.choice([f"<h2>{words(3, True)}</h2>{prose(2, True)}", f"<blockquote>{prose(1, True)}</blockquote>",
                             "<ul>" + "".join(f"<li>{words(rng.randint(3, 12), True)}</li>" for _ in range(4)) + "</ul>",
                             f"<table><tr><td>{words(2, True)}</td><td>{words(2, True)}</td></tr></table>",
                             f"<pre>{words(9, True)}</pre>"])
    if rng.random() < 0.4:
        inner += junk() + prose(rng.randint(0, 2), True)
    holder = rng.choice(["article", "article", "article", "main", "named", "plain", "both"])
    body = {"article": lambda: f"<article>{inner}</article>", "main": lambda: f"<main>{inner}</main>",
            "named": lambda: part(named("content article post entry story main"), inner),
            "both": lambda: f'<main><div class="content"><article>{inner}</article></div></main>',
            "plain": lambda: f"<div>{inner}</div>"}[holder]()
    comments = part(named("comments comment replies discussion"), "".join(
        part(named("comment reply"), f"<p>{words(rng.randint(3, 40), False)}</p>") for _ in range(rng.randint(1, 6))))
    side = rng.choice([
        lambda: "<aside>" + words(rng.randint(2, 30), False) + links(rng.randint(0, 8)) + "</aside>",
        lambda: part(named("sidebar widget rail"), f"<h3>{words(2, False)}</h3>" + links(rng.randint(2, 9))),
        lambda: part(named("sidebar aside"), prose(rng.randint(1, 2), False))])()
    foot = rng.choice([
        lambda: f"<footer>&copy; {words(rng.randint(2, 45), False)}</footer>",
        lambda: "<footer>" + links(rng.randint(2, 8)) + f"<p>{words(rng.randint(3, 30), False)}</p></footer>",
        lambda: part(named("footer copyright legal"), words(rng.randint(3, 40), False))])()
    parts = [top] + [junk() for _ in range(rng.choice([0, 0, 1, 1, 2]))]
    parts += rng.choice([[body, side], [side, body], [body], [body]])
    parts += [comments] * (rng.random() < 0.35) + [junk()] * (rng.random() < 0.3) + [foot] * (rng.random() < 0.9)
    page = "".join(parts)
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["page", "wrapper", "container", "site"])}">{page}</div>'
    end = rng.choice(["</body></html>", "</body></html>", ""])
    return f"<!DOCTYPE html><html><head><title>{words(4, False)}</title></head><body>{page}{end}"


def learn(pages: int = TRAIN_PAGES, seed: int = 7) -> Boosted:
    """Fit on pages made here; a block counts as main text if most of its text is."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(_made_page(rng))
        texts = page.texts()
        size, main = np.zeros(len(page.tag)), np.zeros(len(page.tag))
        for (block, _, _), text in zip(page.runs, texts):
            size[block] += len(text)
            main[block] += sum(len(w) for w in text.split() if w[0] == "m")
        for v in range(len(page.tag) - 1, 0, -1):
            size[page.parent[v]] += size[v]
            main[page.parent[v]] += main[v]
        some = size > 0
        xs.append(features(page, texts)[some])
        # Only blocks that are all main text but for a little: a container of both is for the decoder to leave open.
        ys.append((main[some] > 0.7 * size[some]).astype(float))
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def main_text(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, in code points.

    A null or empty page, and one without main text, has an empty text.  Null ids and addresses and repeated rows stay;
    other columns are left out; an empty table gives an empty one.  Pages are read whole.
    """
    ship(pages.sparkSession)
    model = model or learn()
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                texts = extract(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
