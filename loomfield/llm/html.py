"""Main text of web pages by a tree-structured model over the DOM, with sum-product marginals."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements whose text is raw up to their own end tag, and dropped.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements whose whole subtree is dropped; what is round them stays one block.
_DROPPED = {"noscript", "template", "svg", "select", "button", "canvas", "object", "datalist", "audio", "video"}
#: Start tags that end a dropped element which was never closed.
_OPENERS = {"article", "main", "section", "header", "footer", "nav", "aside", "body"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr",
    "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "mfrac", "msqrt", "msubsup", "mover", "munder", "semantics",
}
#: Open elements that a start tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Those that such an end doesn't pass.
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body"}

#: Kinds of class, id and role words, the first that fits.
_KINDS = {
    "comment": "comment comments reply replies respond disqus discussion commentlist feedback",
    "ad": "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promoted promotion banner adbox adslot",
    "notice": "cookie cookies consent gdpr notice notices alert alerts modal popup overlay newsletter subscribe subscription signup warning paywall toast",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination tabs toc skip topnav subnav links",
    "share": "share sharing social follow buttons toolbar actions",
    "side": "sidebar side aside widget widgets related recommended recommendations popular trending tags tagcloud categories archive rail teaser complementary more",
    "footer": "footer foot copyright colophon legal contentinfo bottom",
    "header": "header masthead topbar logo branding head hero top",
    "form": "form search login contact searchbox",
    "meta": "byline meta author date dateline timestamp credits",
    "hidden": "hidden invisible print",
    "content": "article content contents post entry story main body text prose page maincontent articlebody paragraph document",
}
_KIND_OF = {word: kind for kind, words in reversed(_KINDS.items()) for word in words.split()}
_ORDER = {kind: i for i, kind in enumerate(_KINDS)}
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


@lru_cache(maxsize=50_000)
def _kind(attributes: str) -> str:
    """What the names of an element say of it."""
    if not attributes:
        return "none"
    if _HIDDEN.search(attributes):
        return "hidden"
    found = {k for m in _NAMES.finditer(attributes) for w in _WORDS.findall(next(filter(None, m.groups()), "")) if (k := _KIND_OF.get(w.lower()))}
    return min(found, key=_ORDER.__getitem__) if found else "none"


class _Tags:
    """The tags of a page, in one pass. A tag ends at the first > outside quotes. Quotes that aren't closed by the end
    of the page are no quotes: from then on a tag ends at the first >, so no part of a page is read twice."""

    def __init__(self, html: str):
        self.html, self.quotes = html, True
        self.last = html.rfind(">")

    def __call__(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether an end tag, name, attributes) of the next tag, with an empty name for comments and
        declarations; None if there is none."""
        html = self.html
        while True:
            start = html.find("<", at)
            if start >= self.last:
                start = html.find("<!--", start)
            if start < 0:
                return None
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, False, "", ""
            if html[start + 1] in "!?":
                return start, html.find(">", start) + 1, False, "", ""
            ending = html[start + 1] == "/"
            name = _NAME.match(html, start + 1 + ending)
            if not name:
                at = start + 1
                continue
            end = self._end(name.end())
            return start, end + 1, ending, name[0].lower(), html[name.end() : end]

    def _end(self, begin: int) -> int:
        html, at = self.html, begin
        while self.quotes:
            at = _PLAIN.match(html, at).end()
            if at < len(html) and html[at] == ">":
                return at
            at = html.find(html[at], at + 1) + 1 if at < len(html) else 0
            if not at:
                self.quotes = False
        return html.find(">", begin)


#: Kinds of names by which an inline element or a link becomes a node of its own.
_TELLING = {"ad", "notice", "comment", "share", "hidden", "nav", "form", "side"}


class Tree:
    """Block elements of one page, with those inline elements whose names say that they are no main text, and the
    page's runs of text in page order: a run is the text of one block, in pieces by node."""

    __slots__ = ("tags", "attributes", "parents", "depths", "runs", "linked")

    def __init__(self, html: str):
        self.tags, self.attributes, self.parents, self.depths = ["#page"], [""], [-1], [0]
        self.runs: list[list[tuple[int, str]]] = []
        self.linked: dict[int, int] = {}
        tags, open_nodes, parts, links, dropped = self.tags, [0], [], 0, []
        places: dict[str, list[int]] = {}  # where in open_nodes each tag is open

        def close() -> None:
            if any(not text.isspace() for _, text in parts):
                self.runs.append(parts.copy())
            parts.clear()

        def add(text: str) -> None:
            if dropped or not text:
                return
            text = unescape(text) if "&" in text else text
            parts.append((open_nodes[-1], text))
            if links and (n := len(text.strip())):
                self.linked[open_nodes[-1]] = self.linked.get(open_nodes[-1], 0) + n

        def push(name: str, attributes: str | None = None, drop: bool = False) -> None:
            """Opens an element; without attributes it is no node, and its text is that of the node round it."""
            if attributes is not None:
                tags.append(name)
                self.attributes.append(attributes)
                self.parents.append(open_nodes[-1])
                self.depths.append(self.depths[open_nodes[-1]] + 1)
            places.setdefault(name, []).append(len(names))
            if drop:
                dropped.append(len(names))
            if name not in _INLINE:
                blocks.append(len(names))
            open_nodes.append(open_nodes[-1] if attributes is None else len(tags) - 1)
            names.append(name)

        def cut(i: int) -> None:
            """Ends the open elements from place i on."""
            while len(open_nodes) > i:
                open_nodes.pop()
                places[names.pop()].pop()
            for stack in (dropped, blocks):
                while stack and stack[-1] >= i:
                    stack.pop()

        def pop(wanted: set[str]) -> None:
            """Ends the innermost open elements up to one of those, unless a scope is in between."""
            for i in range(len(open_nodes) - 1, 0, -1):
                if names[i] in wanted:
                    cut(i)
                    return
                if names[i] in _SCOPE:
                    return

        names, blocks, at, next_tag = ["#page"], [], 0, _Tags(html)
        while True:
            found = next_tag(at)
            if found is None:
                add(html[at:])
                break
            start, end, ending, name, attributes = found
            add(html[at:start])
            at = end
            if not name:
                continue
            if name in _RAW:
                if not ending and not attributes.endswith("/"):
                    over = re.compile(f"</{re.escape(name)}(?![^\\s/>])", re.I).search(html, at)
                    at = len(html) if over is None else over.start()
                continue
            if name in _VOID:
                if name == "br":
                    add(" ")
                elif name == "hr":
                    close()
                continue
            if name in _INLINE:
                if ending:
                    if name == "a":
                        links = 0
                    if places.get(name) and not (blocks and blocks[-1] > places[name][-1]):
                        cut(places[name][-1])
                    continue
                if name == "a":
                    links = 1
                if attributes.endswith("/"):
                    continue
                if attributes and not places.get("pre") and _kind(attributes) in _TELLING:
                    push(name, attributes)
                elif places.get(name):
                    push(name)
                continue
            if name in _DROPPED:
                if ending:
                    if places.get(name):
                        cut(places[name][-1])
                elif not attributes.endswith("/"):
                    push(name, drop=True)
                continue
            if dropped and not ending and name in _OPENERS:
                cut(dropped[0])
            if not dropped:
                close()
            links = 0
            if ending:
                if places.get(name):
                    cut(places[name][-1])
                continue
            if names[-1] == "p":
                cut(len(names) - 1)
            if name in _ENDS:
                pop(_ENDS[name])
            push(name, attributes)
            if attributes.endswith("/"):
                cut(len(names) - 1)
        close()

    def text(self, kept: np.ndarray) -> str:
        """The text of the kept nodes: white space inside a block is one space, blocks are joined by one."""
        blocks = (" ".join("".join(text for node, text in run if kept[node]).split()) for run in self.runs)
        return " ".join(x for x in blocks if x)


_TAGS = ("#page html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tbody thead tr td th figure figcaption nav header footer aside form fieldset address details summary center dialog other").split()
_TAG_OF = {t: i for i, t in enumerate(_TAGS)}
_KIND_AT = {k: i for i, k in enumerate([*_KINDS, "none"])}
#: Values of each feature: tag, kind, length of own text, share of it in links, sentence marks.
SIZES = (len(_TAGS), len(_KIND_AT), 7, 5, 4)
_PARENTS = {t: 0 for t in ("#page", "html", "body")} | {t: 1 for t in ("article", "main")} | {t: 2 for t in ("ul", "ol", "dl", "table", "tbody", "thead", "tr", "td", "th", "figure", "blockquote", "li")}
_MARKS = re.compile(r"[.!?…。]['\"”’)]?(?:\s|$)")


def _features(tree: Tree) -> np.ndarray:
    n = len(tree.tags)
    length, marks = [0] * n, [0] * n
    for run in tree.runs:
        own: dict[int, list[str]] = {}
        for node, text in run:
            own.setdefault(node, []).append(text)
        for node, texts in own.items():
            text = " ".join("".join(texts).split())
            length[node] += len(text)
            marks[node] += len(_MARKS.findall(text))
    out = np.zeros((n, len(SIZES)), np.int64)
    other, tag_of, kind_at, linked = _TAG_OF["other"], _TAG_OF, _KIND_AT, tree.linked
    for i in range(n):
        k = length[i]
        size = 0 if not k else 1 if k < 15 else 2 if k < 40 else 3 if k < 100 else 4 if k < 250 else 5 if k < 800 else 6
        share = linked.get(i, 0) / k if k else -1
        out[i] = (tag_of.get(tree.tags[i], other), kind_at[_kind(tree.attributes[i])], size, 0 if share < 0 else 1 if share == 0 else 2 if share < 0.3 else 3 if share < 0.8 else 4, 0 if not k else min(3, 1 + marks[i]))
    return out


def _groups(features: np.ndarray) -> np.ndarray:
    """What sort of parent each node is: page, article, list or table, or other."""
    by_tag = np.array([_PARENTS.get(t, 3) for t in _TAGS])[features[:, 0]]
    return np.where((by_tag == 3) & (features[:, 1] == _KIND_AT["content"]), 1, by_tag)


class Model:
    """P(labels, features) of a tree: the root's label, each child's given its parent's, each feature given the node's.

    How likely a child follows its parent's label hangs on the sort of parent: potentials between articles and their
    parts are others than those between a page and its boxes.

    A node is content if it has main text itself or below. Trained by counting on labelled pages, one count added to
    each cell, with features taken as independent given the label."""

    def __init__(self, moves: np.ndarray, seen: list[np.ndarray]):
        self.counts = moves, seen
        self.moves = np.log(moves / moves.sum(axis=2, keepdims=True))
        self.seen = [np.log(x / x.sum(axis=1, keepdims=True)) for x in seen]

    @classmethod
    def fitted(cls, pages: Iterable[tuple[Tree, np.ndarray]]) -> Model:
        moves = np.ones((4, 2, 2))
        seen = [np.ones((2, size)) for size in SIZES]
        for tree, labels in pages:
            parents = np.array(tree.parents[1:])
            features = _features(tree)
            np.add.at(moves, (_groups(features)[parents], labels[parents], labels[1:]), 1)
            for f, values in enumerate(features.T):
                np.add.at(seen[f], (labels, values), 1)
        return cls(moves, seen)

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        """P(content) of each node of each tree, by messages up and then down, level by level over all trees at once."""
        sizes = [len(t.tags) for t in trees]
        first = np.cumsum([0, *sizes])
        parent = np.concatenate([np.where(np.array(t.parents) < 0, -1, np.array(t.parents) + at) for t, at in zip(trees, first, strict=False)])
        depth = np.concatenate([t.depths for t in trees])
        features = np.concatenate([_features(t) for t in trees])
        own = sum(x[:, features[:, f]].T for f, x in enumerate(self.seen))  # log P(features | label)
        moves = self.moves[_groups(features)[parent]]  # of each node's parent: its label, the node's
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        up = np.zeros_like(own)  # to the parent, by the parent's label
        for nodes in levels[:0:-1]:
            up[nodes] = np.logaddexp(moves[nodes, :, 0] + own[nodes, :1], moves[nodes, :, 1] + own[nodes, 1:])
            np.add.at(own, parent[nodes], up[nodes])
        belief = own.copy()
        belief[levels[0]] += np.log(0.5)
        for nodes in levels[1:]:
            rest = belief[parent[nodes]] - up[nodes]  # what the parent knows from elsewhere
            down = np.logaddexp(rest[:, :1] + moves[nodes, 0], rest[:, 1:] + moves[nodes, 1])
            belief[nodes] += down
            belief[nodes] -= belief[nodes].max(axis=1, keepdims=True)
        share = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))
        return np.split(share, first[1:-1])


def _sentence(rng: random.Random) -> str:
    words = ["".join(rng.choice("aeioutnsrlhdmc") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(4, 22))]
    return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ","])


def labelled_page(rng: random.Random) -> str:
    """A page as many sites lay it out; elements with main text of their own carry the attribute data-gold."""
    word = lambda n: " ".join("".join(rng.choice("aeioutnsrlhdmc") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize()
    text = lambda a=1, b=8: " ".join(_sentence(rng) for _ in range(rng.randint(a, b)))
    some = lambda share: rng.random() < share

    def named(tag: str, words: str, bare: float = 0.25) -> str:
        """A start tag with one of the names, or none."""
        if some(bare):
            return f"<{tag}>"
        name = rng.choice(words.split())
        name = rng.choice([name, f"{rng.choice(['site', 'page', 'block', 'l', 'main', 'col'])}-{name}", f"{name} {word(1).lower()}"])
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">'

    def links(n: int) -> str:
        items = "".join(f'<li><a href="/{word(1)}">{word(rng.randint(1, 4))}</a></li>' for _ in range(n))
        return rng.choice([f"<ul>{items}</ul>", items.replace("<li>", " ").replace("</li>", " ")])

    def ad() -> str:
        return named("div", "ad ads advert sponsored promo banner advertisement", 0) + rng.choice([text(1, 3), word(4), f'<p>{text(1, 2)}</p><a href="#">{word(2)}</a>']) + "</div>"

    def related() -> str:
        return named(rng.choice(["aside", "div", "section"]), "sidebar widget related popular trending tags", 0) + f"<h3>{word(2)}</h3>" + rng.choice([links(5), f"<p>{text(1, 3)}</p>", links(3) + f"<p>{text(1, 2)}</p>"]) + "</x>"

    def notice() -> str:
        return named("div", "cookie-notice consent notice alert newsletter subscribe modal", 0) + rng.choice([text(1, 3), f"<p>{text(1, 3)}</p><button>{word(1)}</button>"]) + "</div>"

    def form() -> str:
        return f'<form action="/{word(1)}"><label>{word(2)}</label><input name="q"><p>{text(1, 1)}</p><button>{word(1)}</button></form>'

    def share() -> str:
        return named("div", "share social follow", 0) + links(3) + "</div>"

    def comments() -> str:
        tag, each = rng.choice([*[("ul", "li"), ("ol", "li"), ("div", "div"), ("section", "div")] * 5, ("section", "article")])
        own = "".join(f'<{each}{rng.choice([" class=comment", ""])}>' + rng.choice([f"<p>{text(1, 4)}</p>", text(1, 4), f"<h4>{word(1)}</h4><p>{text(1, 5)}</p>"]) + f"</{each}>" for _ in range(rng.randint(1, 5)))
        return named(tag, "comments comment-list replies discussion respond", 0) + (f"<h3>{word(2)}</h3>" if some(0.5) else "") + own + f"</{tag}>"

    def inline(s: str) -> str:
        words = s.split(" ")
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(words))
            words[i] = rng.choice([f"<b>{words[i]}</b>", f'<a href="/x">{words[i]}</a>', f"<em>{words[i]}</em>", f"{words[i]} &amp; {words[i]}"])
        if some(0.03):
            names = "ad sponsored promo share hidden comment-count cookie-notice related newsletter-signup"
            words.insert(rng.randrange(len(words)), named("span", names, 0) + rng.choice([text(1, 1), word(3), f'<a href="#">{word(2)}</a>']) + "</span>")
        return " ".join(words)

    def piece() -> str:
        kind = rng.random()
        if kind < 0.12:  # no sentences: one word again and again, or words without marks
            return f"<p data-gold>{rng.choice([' '.join([word(1)] * int(10 ** rng.uniform(0, 3))), ' '.join([word(5)] * int(10 ** rng.uniform(0, 2.3)))])}</p>"
        if kind < 0.22:  # short ones, several in a row
            return "".join(f"<p data-gold>{word(rng.randint(1, 6))}{rng.choice(['.', '.', ',', ''])}</p>" for _ in range(rng.randint(1, 12)))
        if kind < 0.68:
            return f"<p data-gold>{rng.choice(['<b>', '', '', ''])}{inline(text())}" + rng.choice(["</p>", "</p>", "</p>", "<br>"])
        if kind < 0.78:
            return f"<h{(k := rng.choice('23'))} data-gold>{word(rng.randint(1, 7))}</h{k}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li data-gold>{inline(text(1, 2)) if some(0.6) else word(3)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.88:
            return rng.choice([f"<blockquote data-gold>{text()}</blockquote>", f"<blockquote><p data-gold>{text()}</p></blockquote>"])
        if kind < 0.91:
            return f"<pre data-gold>{word(12)}</pre>"
        if kind < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td data-gold>{word(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f'<figure><img src="x.png"><figcaption data-gold>{text(1, 1)}</figcaption></figure>'
        return f"<div data-gold>{text(1, 5)}</div>"

    def article() -> str:
        tag = rng.choice(["article", "article", "article", "main", "section", "div", "div", "td"])
        start = named(tag, "content article post entry story main-content article-body post-body text", 0.5 if tag in ("article", "main") else 0.1)
        if some(0.12):
            own = [text(2, 8)]
            start = start[:-1] + " data-gold>"
        else:
            own = [piece() for _ in range(rng.randint(1, 9))]
        if some(0.75):
            own.insert(0, f"<h1 data-gold>{word(rng.randint(2, 11))}</h1>")
        elif some(0.3):
            own.insert(0, f"<header><h1>{word(6)}</h1><p class=byline>{word(3)}</p></header>")
        for extra in (ad, share, related, form, notice):
            if some(0.1):
                own.insert(rng.randint(1, len(own)), extra().replace("</x>", "</aside></div></section>"))
        if some(0.08):
            own.append(f"<footer><p>{word(5)}</p></footer>")
        body = start + "".join(own) + f"</{tag}>"
        if some(0.25):
            body = named("div", "wrapper container row", 0.4) + body + "</div>"
        return f"<table><tr>{body}</tr></table>" if tag == "td" else body

    before = [f"<{(t := rng.choice(['header', 'div']))}{' class=header' if t == 'div' else ''}>" + rng.choice([f"<h1>{word(2)}</h1>", f'<a href="/">{word(2)}</a>', f"<p>{text(1, 1)}</p>"]) + f"</{t}>"] if some(0.5) else []
    if some(0.8):
        before.append(rng.choice([f"<nav>{links(rng.randint(2, 8))}</nav>", f"<div class=menu>{links(rng.randint(2, 8))}</div>", f"<ul class=nav>{links(4)}</ul>"]))
    before += [f().replace("</x>", "</aside></div></section>") for f, s in ((ad, 0.5), (notice, 0.3), (form, 0.15), (related, 0.2)) if some(s)]
    after = [f().replace("</x>", "</aside></div></section>") for f, s in ((comments, 0.4), (related, 0.4), (share, 0.2), (ad, 0.3), (form, 0.2), (notice, 0.2)) if some(s)]
    rng.shuffle(after)
    if some(0.85):
        after.append(rng.choice([f"<footer>{{}}</footer>", '<div class="footer">{}</div>', "<footer><p>{}</p></footer>"]).format(f"&copy; {word(2)} {text(1, 2)}" + (links(3) if some(0.4) else "")))
    head = f"<head><title>{word(5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
    return f"<!DOCTYPE html><html lang=\"en\">{head}<body>{''.join(before)}{article()}{''.join(after)}{rng.choice(['</body></html>', ''])}"


def gold(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Labels of nodes for training, and which nodes' own text is main text."""
    own = np.array(["data-gold" in a for a in tree.attributes])
    labels = own.astype(np.int64)
    for i in range(len(labels) - 1, 0, -1):
        labels[tree.parents[i]] |= labels[i]
    return labels, own


def fit(pages: int = 1500, seed: int = 7) -> Model:
    """The model fitted on so many labelled pages: a bounded sample, made here; no page of the input is looked at."""
    rng = random.Random(seed)
    trees = (Tree(labelled_page(rng)) for _ in range(pages))
    return Model.fitted((t, gold(t)[0]) for t in trees)


COUNTS = Path(__file__).with_name("html_counts.json")


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of the counts beside this module, which `python -m loomfield.llm.html` makes by fit()."""
    held = json.loads(COUNTS.read_text())
    return Model(np.array(held["moves"]), [np.array(x) for x in held["seen"]])


def extract(pages: list[str | None], model: Model, threshold: float = 0.5) -> list[str]:
    """The main text of each page: runs of the nodes whose marginal is over the threshold, in page order."""
    trees = [Tree(html or "") for html in pages]
    if not trees:
        return []
    return [t.text(p > threshold) for t, p in zip(trees, model.marginals(trees), strict=True)]


def main_text(html: Column, threshold: float = 0.5) -> Column:
    """extract() of a column. Null or empty pages, or those without main text, give an empty text."""
    model = trained()

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            found: list[str] = []
            for at in range(0, len(pages), 256):
                found += extract(list(pages[at : at + 256]), model, threshold)
            yield pd.Series(found, dtype=object)

    return of(html)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. A null or empty page has an empty text; repeated rows have a row each; other columns
    are dropped; an empty table gives an empty table."""
    out = table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


if __name__ == "__main__":
    moves, seen = fit().counts
    COUNTS.write_text(json.dumps({"moves": moves.tolist(), "seen": [x.tolist() for x in seen]}) + "\n")
