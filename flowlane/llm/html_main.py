"""Main text of web pages: boosted trees over DOM-node features, decoded so that an
element and those it holds never contradict each other.

A tolerant parser turns a page into its block elements; text in inline elements
belongs to the block around it. Each block gets features of its subtree (text, links
and elements in proportion), its attributes' words, its depth and its siblings. A
gradient-boosted ensemble gives the probability that the block is part of the main
text. Decoding walks the tree with three states - outside, inside the main text, and
left out of it - of which only outside may turn into inside and only inside into left
out on the way down, and takes the assignment that is likeliest as a whole.

The trees are fitted on a bounded sample of the pages: blocks inside the elements
that mark an article as such, and the same pages' text set anew in layouts where it
is known which block is what.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 400     # bound of the pages the trees are fitted on
FIT_BLOCKS = 1000   # bound of the blocks that one page gives, spread evenly over it
FIT_TEXTS, FIT_CHARS = 20, 20_000  # bounds of the texts one page gives to new layouts, and of their length
LAYOUTS = 2         # new layouts made of each of them
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 24

# Element names as the HTML standard groups them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = set("script style textarea title xmp iframe noembed noframes noscript template svg canvas object select button "
              "option head".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr img input".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer "
               "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: What a head may hold; any other start tag ends an open head.
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Start tags that end an open element of this name in which they stand.
ENDS = {"select": set("select input textarea caption table tbody tfoot thead tr td th".split()), "button": {"button"}}
HOLDS = {"ul", "ol", "dl", "table", "body", "html", "div", "section", "article", "main", "aside", "nav"}

#: Words in class, id, role, itemprop and aria-label, by what they speak for.
WORDS = {
    "main": "article articlebody content main post entry body story text page maincontent blog prose news".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs toc pagination pager tabs skip links".split(),
    "edge": "header masthead banner footer foot bottom top copyright legal imprint site logo branding".split(),
    "side": "sidebar aside side related recommended more widget rail secondary complementary tags popular teaser".split(),
    "advert": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense affiliate commercial".split(),
    "notice": "cookie cookies notice consent gdpr popup modal overlay alert warning dialog announcement privacy".split(),
    "comment": "comment comments reply replies discussion disqus respond thread reader readers feedback reactions".split(),
    "form": "form newsletter subscribe subscription signup login search register contact share social follow".split(),
}
WORD_OF = {w: k for k, ws in WORDS.items() for w in ws}
GROUPS = list(WORDS)
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "nav", "header", "footer", "aside", "form",
        "table", "td", "blockquote", "body", "html", "pre"]
TAG_OF = {t: i for i, t in enumerate(TAGS)} | {"ol": 7, "dl": 7, "dd": 8, "dt": 8, "menu": 9, "h3": 6, "h4": 6, "h5": 6, "h6": 6,
                                              "th": 15, "tr": 14, "tbody": 14, "fieldset": 13}
SHAPES = ["depth", "blocks_in", "sibling_place", "siblings", "same_siblings", "own_text", "all_text", "share", "link_share",
          "density", "words_per_block", "stops", "paragraph_share", "own_share", "parent_link_share"]
NAMES = SHAPES + [f"tag_{t}" for t in TAGS] + [f"own_{g}" for g in GROUPS] + [f"above_{g}" for g in GROUPS] + [
    "above_article", "above_edge_tag"]

TOKEN = re.compile(r"""<!--|<[!?][^>]*+>?|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*+>?""")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Page:
    """Block elements in page order: ``tag``, ``parent``, ``words`` (attribute words),
    ``mark`` (known label or None), and ``runs``: (block, text, in a link) with None for
    the text where a block begins, ends or a line breaks."""

    def __init__(self, text: str):
        self.tag, self.parent, self.words, self.mark = ["html"], [-1], [[]], [None]
        self.elements = [0]
        self.runs: list[tuple[int, str | None, bool]] = []
        self._parse(text)

    def _parse(self, text: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]   # (name, block it belongs to)
        dropped = links = at = 0
        n = len(text)

        def leave(k: int) -> None:
            """End the open elements from place ``k`` of the stack on."""
            nonlocal dropped, links
            gone = stack[k:]
            del stack[k:]
            dropped -= sum(s in DROPPED for s, _ in gone)
            links -= sum(s == "a" for s, _ in gone)
            if any(s not in INLINE for s, _ in gone):
                self.runs.append((stack[-1][1], None, False))

        while at < n:
            m = TOKEN.search(text, at)
            end = m.start() if m else n
            if stack[-1][0] == "head" and text[at:end].strip():
                leave(len(stack) - 1)  # text ends a head
            if end > at and not dropped:
                self.runs.append((stack[-1][1], text[at:end], links > 0))
            if not m:
                break
            at = m.end()
            token = m[0]
            if token == "<!--":
                close = text.find("-->", at)
                at = n if close < 0 else close + 3
                continue
            if token[1] in "!?":
                continue
            if not token.endswith(">"):
                break  # the page ends inside a tag
            name = NAME.match(token)[1].lower()
            if token[1] == "/":
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if not k or name in INLINE and any(s not in INLINE for s, _ in stack[k + 1:]):
                    continue
                leave(k)
                continue
            if name in ("html", "body") and any(s == name for s, _ in stack) and name == "html":
                continue
            if name == "head" and (len(stack) > 1 or len(self.tag) > 1):
                continue  # only the first thing of a page is its head
            if name == "body" or stack[-1][0] == "head" and name not in IN_HEAD:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "head"), 0)
                if k:
                    leave(k)
            for kind, by in ENDS.items():
                if name in by:
                    k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == kind), 0)
                    if k:
                        leave(k)
                    if k and name == "select":
                        break
            else:
                kind = None
            if kind:
                continue  # a select within a select only ends it
            if name in CLOSES_P or name in SAME:
                close = SAME.get(name, set()) | ({"p"} if name in CLOSES_P else set())
                for k in range(len(stack) - 1, 0, -1):
                    s = stack[k][0]
                    if s in close:
                        gone = stack[k:]
                        del stack[k:]
                        dropped -= sum(s in DROPPED for s, _ in gone)
                        links -= sum(s == "a" for s, _ in gone)
                    elif s not in INLINE and s not in CLOSES_P - HOLDS:
                        break
                    elif s in HOLDS:
                        break
            if name in RAW:
                close = re.compile(f"</{name}", re.I).search(text, at)
                at = n if close is None else close.start()
                if close is not None:
                    tail = text.find(">", at)
                    at = n if tail < 0 else tail + 1
                continue
            self.elements[stack[-1][1]] += 1
            if name in VOID:
                if name in ("br", "hr"):
                    self.runs.append((stack[-1][1], None, False))
                continue
            if token.endswith("/>") and name in ("svg", "path", "use"):
                continue
            block = stack[-1][1]
            if name in DROPPED:
                dropped += 1
            if name == "a":
                links += 1
            if name not in INLINE and name not in DROPPED and not dropped:
                block = len(self.tag)
                words, mark = [], None
                for key, *values in ATTRIBUTE.findall(token):
                    value = "".join(values)
                    if key.lower() == "data-y":
                        mark = int(value)
                    else:
                        words += [w.lower() for w in PART.findall(value)]
                self.tag.append(name)
                self.parent.append(stack[-1][1])
                self.words.append(words)
                self.mark.append(mark)
                self.elements.append(0)
                self.runs.append((block, None, False))
            elif name not in INLINE:
                self.runs.append((block, None, False))
            stack.append((name, block))

    def features(self) -> np.ndarray:
        """One row of ``NAMES`` for each block."""
        n = len(self.tag)
        parent = self.parent
        own, linked, stops, words, elements = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.array(self.elements, float)
        for block, text, link in self.runs:
            if text is not None:
                t = len(text) - text.count(" ") if not text.isspace() else 0
                if t:
                    own[block] += t
                    linked[block] += t if link else 0
                    stops[block] += text.count(".") + text.count(",")
                    words[block] += text.count(" ") + 1
        paragraph = np.array([own[b] if self.tag[b] in ("p", "blockquote", "pre") else 0 for b in range(n)])
        total = [own.copy(), linked.copy(), stops.copy(), words.copy(), elements, paragraph, np.ones(n)]
        children: list[list[int]] = [[] for _ in range(n)]
        for b in range(n - 1, 0, -1):
            for t in total:
                t[parent[b]] += t[b]
            children[parent[b]].append(b)
        text, link, stop, word, element, para, blocks = total
        x = np.zeros((n, len(NAMES)))
        depth, above = np.zeros(n), np.zeros((n, len(GROUPS) + 2))
        place, count, same = np.zeros(n), np.ones(n), np.ones(n)
        own_words = np.zeros((n, len(GROUPS)))
        base, first = len(SHAPES), len(SHAPES) + len(TAGS)
        for b in range(n):
            kids = children[b][::-1]
            tags: dict[str, int] = {}
            for c in kids:
                tags[self.tag[c]] = tags.get(self.tag[c], 0) + 1
            for k, c in enumerate(kids):
                place[c], count[c], same[c] = k / len(kids), len(kids), tags[self.tag[c]]
            for w in self.words[b]:
                g = WORD_OF.get(w)
                if g:
                    own_words[b, GROUPS.index(g)] = 1
            if self.tag[b] in TAG_OF:
                x[b, base + TAG_OF[self.tag[b]]] = 1
            if b:
                p = parent[b]
                depth[b] = depth[p] + 1
                above[b] = above[p]
                above[b, :-2] = np.maximum(above[b, :-2], own_words[p])
                if self.tag[p] in ("article", "main"):
                    above[b, -2] = 1
                if self.tag[p] in ("nav", "header", "footer", "aside", "form"):
                    above[b, -1] = 1
        some = np.maximum(text, 1)
        share = link / some
        x[:, :base] = np.stack([
            depth, np.log1p(blocks), place, np.log1p(count), np.log1p(same), np.log1p(own), np.log1p(text), text / max(1, text[0]),
            share, element / some, word / blocks, stop / np.maximum(word, 1), para / some, own / some,
            share[np.maximum(np.array(parent), 0)]], axis=1)
        x[:, first:first + len(GROUPS)] = own_words
        x[:, first + len(GROUPS):] = above
        return x

    def decode(self, p: np.ndarray) -> np.ndarray:
        """Whether each block is in the main text, as a whole likeliest: down the tree
        outside may turn into inside, inside into left out, nothing else."""
        n = len(self.tag)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        yes, no = np.log(p), np.log(1 - p)
        cost = np.stack([no, yes, no], axis=1)  # outside, inside, left out
        for b in range(n - 1, 0, -1):
            up = self.parent[b]
            cost[up, 0] += max(cost[b, 0], cost[b, 1])
            cost[up, 1] += max(cost[b, 1], cost[b, 2])
            cost[up, 2] += cost[b, 2]
        state = np.zeros(n, int)
        state[0] = int(cost[0, 1] > cost[0, 0])
        for b in range(1, n):
            s = state[self.parent[b]]
            state[b] = s if s == 2 or cost[b, s] >= cost[b, s + 1] else s + 1
        return state == 1

    def text(self, inside: np.ndarray) -> str:
        parts = []
        for block, run, _ in self.runs:
            if run is None:
                parts.append(" ")
            elif inside[block]:
                parts.append(run)
            else:
                parts.append(" ")
        return " ".join(entities.unescape("".join(parts)).split())

    def labels(self) -> np.ndarray:
        """Known labels: a block's own mark or that of the nearest block above; without
        any mark on the page, blocks within article or main, but not within an element
        for something else."""
        y = np.zeros(len(self.tag))
        marked = any(m is not None for m in self.mark)
        other = {"nav", "footer", "aside", "form"}
        for b in range(len(self.tag)):
            above = y[self.parent[b]] if b else 0
            if marked:
                y[b] = above if self.mark[b] is None else self.mark[b]
            else:
                y[b] = 0 if self.tag[b] in other else max(above, self.tag[b] in ("article", "main"))
        return y


class Trees:
    """A boosted ensemble of depth-``DEPTH`` trees on binned features, for two classes."""

    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base, self.trees = cuts, base, []

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        out = cls([np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if np.ptp(x[:, k]) else np.empty(0)
                   for k in range(x.shape[1])], float(np.log(share / (1 - share))))
        for k in range(x.shape[1]):  # a flag that is rarely set has no quantile between its values
            if len(out.cuts[k]) <= 1 and np.ptp(x[:, k]):
                out.cuts[k] = np.array([(x[:, k].min() + x[:, k].max()) / 2])
        bins = out._bins(x)
        raw = np.full(len(y), out.base)
        width = BINS + 1
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), int)
            splits = []
            for level in range(DEPTH):
                m = 1 << level
                best = np.full(m, 1e-6)
                feature, cut = np.zeros(m, int), np.full(m, 255)
                for k in range(x.shape[1]):
                    if not len(out.cuts[k]):
                        continue
                    at = node * width + bins[:, k]
                    gs = np.cumsum(np.bincount(at, g, m * width).reshape(m, width), axis=1)
                    hs = np.cumsum(np.bincount(at, h, m * width).reshape(m, width), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
                    gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                    c = gain.argmax(1)
                    value = gain[np.arange(m), c]
                    better = value > best
                    best[better], feature[better], cut[better] = value[better], k, c[better]
                splits.append((feature, cut))
                node = node * 2 + (bins[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << DEPTH
            value = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
            out.trees.append((splits, value))
            raw += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.trees:
            node = np.zeros(len(x), int)
            for feature, cut in splits:
                node = node * 2 + (bins[rows, feature[node]] > cut[node])
            raw += value[node]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def new_layout(paragraphs: list[str], prose: list[str], rng: random.Random) -> str:
    """A page that shows ``paragraphs`` as its article, among blocks of other kinds
    filled from ``prose``; data-y says which block is which."""
    esc = entities.escape
    say = lambda: esc(rng.choice(prose))
    short = lambda: esc(" ".join(rng.choice(prose).split()[:rng.randint(1, 4)]))

    def attribute(kind: str) -> str:
        words = rng.sample(WORDS[kind], 2)
        name = rng.choice([words[0], "-".join(words), f"{words[0]}-{rng.choice(['box', 'block', 'area', 'wrap'])}"])
        return f' {rng.choice(["class", "id"])}="{name}"'

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(n))

    def other(kind: str) -> str:
        a = attribute(kind) if rng.random() < 0.9 else ""
        if kind == "menu":
            tag = rng.choice(["nav", "div", "ul"])
            inner = links(rng.randint(3, 9))
            return f'<{tag}{a if tag != "nav" or rng.random() < 0.5 else ""} data-y="0">{inner if tag == "ul" else f"<ul>{inner}</ul>"}</{tag}>'
        if kind == "edge":
            tag = rng.choice(["header", "footer", "div"])
            inner = rng.choice([f"&copy; {short()} &middot; {say()}", f"<h2>{short()}</h2><p>{say()}</p>", f"<p>{say()}</p><ul>{links(3)}</ul>"])
            return f'<{tag}{attribute(kind) if tag == "div" else ""} data-y="0">{inner}</{tag}>'
        if kind == "side":
            tag = rng.choice(["aside", "div", "section"])
            return f'<{tag}{a if tag == "aside" else attribute(kind)} data-y="0"><h3>{short()}</h3><ul>{links(4)}</ul><p>{say()}</p></{tag}>'
        if kind == "comment":
            tag = rng.choice(["section", "div", "ol"])
            inner = "".join(f"<{(t := 'li' if tag == 'ol' else rng.choice(['div', 'p', 'article']))}{attribute('comment')}>{say()} {say()}</{t}>"
                            for _ in range(rng.randint(1, 5)))
            return f'<{tag}{attribute(kind)} data-y="0"><h3>{short()}</h3>{inner}</{tag}>'
        if kind == "form":
            tag = rng.choice(["form", "div"])
            return f'<{tag}{attribute(kind) if tag == "div" else a} data-y="0"><p>{say()}</p><label>{short()}</label><input name="q"></{tag}>'
        tag = rng.choice(["div", "section", "p", "aside"])
        return f'<{tag}{attribute(kind)} data-y="0">{rng.choice([say(), f"<p>{say()}</p>", f"{say()} <a href=x>{short()}</a>"])}</{tag}>'

    tag, mark = rng.choice([("article", ""), ("article", attribute("main")), ("main", ""), ("div", attribute("main")),
                            ("section", attribute("main")), ("div", attribute("main")), ("div", ""), ("", "")])
    kind = rng.choice(["p", "p", "p", "div"])
    body = [f"<h1>{esc(paragraphs[0])}</h1>"] if rng.random() < 0.8 else []
    for k, text in enumerate(paragraphs):
        extra = rng.random()
        if extra < 0.06:
            body.append(f"<h2>{short()}</h2>")
        elif extra < 0.12:
            body.append(f"<ul><li>{say()}</li><li>{say()}</li></ul>")
        elif extra < 0.16:
            body.append(f"<blockquote>{say()}</blockquote>")
        elif extra < 0.24 and k:
            body.append(other(rng.choice(["advert", "side", "form", "notice"])))
        body.append(f"<{kind}>{esc(text)}" + ("" if kind == "p" and rng.random() < 0.2 else f"</{kind}>"))
    if rng.random() < 0.25:
        body.append(other("comment"))
    main = "".join(body)
    if tag:
        main = f'<{tag}{mark} data-y="1">{main}</{tag}>'
    else:  # no element of its own: every block not marked yet belongs to it
        main = re.sub(r"<(h1|h2|p|div|ul|blockquote)>", r'<\1 data-y="1">', main)
    before = [other(rng.choice(["menu", "edge", "advert", "notice", "form"])) for _ in range(rng.randint(1, 4))]
    after = [other(rng.choice(["comment", "side", "edge", "advert", "menu", "form", "notice"])) for _ in range(rng.randint(1, 5))]
    inner = "".join([*before, main, *after])
    for _ in range(rng.randint(0, 2)):
        inner = f'<div{rng.choice(["", attribute("edge"), attribute("main")])} data-y="0">{inner}</div>'
    return f"<html><body>{inner}</body></html>"


SENTENCES = """The river rose for three days before anyone thought of moving the boats
A small committee met in the old school, and it wrote down what had been lost
Most of the figures in the report were taken from the year before
She had walked the same road every morning, whatever the weather
Nobody could say how the fire had started, but many had seen it
The new bridge carries about nine thousand cars, bicycles and lorries a day
After the harvest the fields were left to the geese
Engineers tested the valve twice, found nothing, and tested it again
His second book sold better than the first, which he never understood
Bread was cheap that winter, while coal was not to be had at all
The court will hear both sides in the spring
Visitors are asked to leave their bags at the door""".split("\n")


def learnt_from(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What a page gives to the fit: features and labels of its blocks (none without
    a known label), and texts for new layouts."""
    page = Page(text)
    y = page.labels()
    texts = [t for t in (" ".join(entities.unescape(s[:FIT_CHARS]).split())
                         for b, s, _ in page.runs if s is not None and (y[b] or not y.any())) if t][:FIT_TEXTS]
    if not y.any():
        return np.empty((0, len(NAMES))), np.empty(0), texts
    some = np.unique(np.linspace(0, len(y) - 1, min(len(y), FIT_BLOCKS)).astype(int))
    return page.features()[some], y[some], texts


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Trees:
    """Fit on at most ``FIT_PAGES`` different pages that are not blank (those with the
    smallest hashes of id and html), of any length, and ``LAYOUTS`` new layouts of each;
    on layouts of built-in sentences if no such page has text."""
    rows = (pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html"))
            .where(F.col("html").rlike(r"\S")).select(F.xxhash64("page_id", "html").alias("h"), "html"))
    drawn = [r.h for r in rows.select("h").distinct().orderBy("h").limit(FIT_PAGES).collect()]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # at most FIT_PAGES hashes
        for b in batches:
            for h, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if h not in seen:
                    seen.add(h)
                    x, y, texts = learnt_from(text.as_py())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([h], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1)]), pa.array([y.tobytes()]),
                        pa.array([texts], pa.list_(pa.string()))], names=["h", "x", "y", "texts"])

    got = (rows.where(F.col("h") <= drawn[-1]).mapInArrow(learn, "h long, x binary, y binary, texts array<string>")
           .dropDuplicates(["h"]).collect()) if drawn else []
    rng = random.Random(5)
    known, paragraphs = [], []
    for r in sorted(got, key=lambda r: r.h):
        if r.texts:
            paragraphs.append(r.texts)
        if r.y:
            known.append((np.frombuffer(zlib.decompress(r.x)).reshape(-1, len(NAMES)), np.frombuffer(r.y)))
    if not paragraphs:
        paragraphs = [[". ".join(rng.sample(SENTENCES, rng.randint(1, 4))) + "." for _ in range(rng.randint(1, 9))]
                      for _ in range(FIT_PAGES)]
    prose = [s.strip() + "." for texts in paragraphs for t in texts for s in t.split(".")[:3] if len(s.split()) > 2]
    prose = prose or [t for texts in paragraphs for t in texts]
    for texts in paragraphs:
        for _ in range(LAYOUTS):
            page = Page(new_layout(texts[:12], prose, rng))
            known.append((page.features(), page.labels()))
    return Trees.fit(np.vstack([x for x, _ in known]), np.concatenate([y for _, y in known]))


def main_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    """The main text of each page; the empty string where there is none."""
    if trees is None:
        return [""] * len(pages)
    parsed = [Page(p or "") for p in pages]
    x = [p.features() for p in parsed]
    if not x:
        return []
    probability = np.split(trees.probability(np.vstack(x)), np.cumsum([len(f) for f in x])[:-1])
    return [p.text(p.decode(q)) for p, q in zip(parsed, probability, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text; ids and URLs may be null and repeat. Other
    columns are not read; an empty table gives no rows.
    """
    trees = fit(pages, id_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                texts = main_texts(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
