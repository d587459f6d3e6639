"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STEP = re.compile(r"[>=]")
_VALUE = re.compile(r"[\s>]")
_KEY = re.compile(r"([^\s/\"'<>=]+)\s*\Z")
#: Dropped elements: those whose content is text up to their end tag, and those that may hold one another.
_RAW = {"script", "style", "noscript", "textarea", "iframe", "title", "xmp"}
_NESTED = {"svg", "math", "template", "select", "object"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}
_LANDMARKS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "dialog")
#: Ancestors and name parts (of class, id and role) that give features.
_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "ul", "table", "button", "dialog", "menu", "figure", "blockquote", "h1", "h2", "h3", "p", "pre", "address")
_NAMES = {
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner", "comment": "comment comments respond reply replies disqus discussion", "side": "side sidebar aside widget rail",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc tabs", "notice": "cookie cookies consent notice alert popup modal gdpr overlay", "foot": "footer foot copyright legal colophon",
    "head": "header head masthead topbar logo branding", "share": "share social related recommended newsletter subscribe signup login search more tags", "body": "content article post entry story main body text",
}
_NAME_OF = {w: k for k, ws in _NAMES.items() for w in ws.split()}
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
#: Words of _NAMES that also count where a longer word begins with them ("commentlist").
_STEMS = tuple(w for w in _NAME_OF if len(w) >= 6)
_RIGHTS = re.compile(r"\s*(?:copyright\b|\(c\)|all rights reserved)", re.I)
_BAD = ("ad", "comment", "side", "menu", "notice", "foot", "head", "share")


@dataclass
class Block:
    text: str
    tags: frozenset[str]  # of all ancestors
    inner: str  # nearest ancestor that is a landmark
    names: frozenset[str]
    linked: int  # characters inside links


class _Tags:
    """Tags of a page in order, in time linear in its length.

    Quotes open a value only after ``=``; a quote that is never closed is a plain character. What starts a tag or comment
    that never ends is dropped with the rest of the page, as browsers do; ``<`` before anything else is text.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def next(self, at: int) -> tuple[int, int, str, str, dict[str, str]] | None:
        """(start, end, "" or "/", name, attributes) of the next tag from ``at`` on; comments have no name."""
        page, n = self.page, len(self.page)
        while True:
            k = page.find("<", at)
            if k < 0 or k + 1 >= n:
                return None
            c = page[k + 1]
            if c == "!" and page.startswith("<!--", k):
                if page.startswith(">", k + 4) or page.startswith("->", k + 4):
                    return k, page.index(">", k) + 1, "", "", {}
                e = page.find("-->", k + 4)
                return k, e + 3 if e >= 0 else n, "", "", {}
            slash = "/" if c == "/" else ""
            m = _NAME.match(page, k + 1 + len(slash))
            if m is None and c not in "!?/":
                at = k + 1
                continue
            if self.last[">"] < k:
                return k, n, "", "", {}
            if m is None:
                return k, page.index(">", k) + 1, "", "", {}
            end, values = self._end(m.end())
            return k, end, slash, m[0].lower(), values

    def after(self, name: str, at: int) -> int:
        """Where a dropped element ends whose start tag ends at ``at``; the end of the page if it is never closed.

        Text elements end at the first end tag of their name, whatever a slash in the start tag says; the others at the
        one that closes them, their own kind inside counted.
        """
        page, n, depth = self.page, len(self.page), 1
        if name in _RAW:
            m = _CLOSING[name].search(page, at)
            return n if m is None else page.find(">", m.end()) + 1 or n
        while True:
            found = self.next(at)
            if found is None:
                return n
            _, at, slash, inner, _ = found
            if inner == name:
                closed = name in ("svg", "math") and page[at - 2 : at - 1] == "/"
                depth += -1 if slash else 0 if closed else 1
                if depth == 0:
                    return at
            elif inner in _RAW and not slash:
                at = self.after(inner, at)

    def _end(self, at: int) -> tuple[int, dict[str, str]]:
        page, n, values, since = self.page, len(self.page), {}, at
        while True:
            m = _STEP.search(page, at)
            if m is None:
                return n, values
            if m[0] == ">":
                return m.end(), values
            at = m.end()
            key = _KEY.search(page, max(since, m.start() - 40), m.start())
            while at < n and page[at].isspace():
                at += 1
            q = page[at : at + 1]
            if q and q in "\"'" and self.last[q] > at:
                e = page.find(q, at + 1)
                value, at = page[at + 1 : e], e + 1
            else:
                v = _VALUE.search(page, at)
                e = v.start() if v else n
                value, at = page[at:e], e
            since = at
            if key and key[1].lower() in ("class", "id", "role"):
                values[key[1].lower()] = value


def name_of(word: str) -> str | None:
    """Kind that a word of a class, id or role names, as a whole or by how it begins."""
    return _NAME_OF.get(word) or next((_NAME_OF[w] for w in _STEMS if word.startswith(w)), None)


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: text between block-level tags, inline tags dissolved, scripts and the like dropped."""
    if not isinstance(page, str):
        return []
    out: list[Block] = []
    # open elements: name, and tags, nearest landmark and names of it and its ancestors
    stack: list[tuple[str, frozenset[str], str, frozenset[str]]] = []
    depth: dict[str, int] = {}
    parts: list[str] = []
    linked, at, end = 0, 0, len(page)
    links = 0
    tags = _Tags(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(_html.unescape("".join(parts)).split())
        if text:
            top = stack[-1] if stack else ("", frozenset(), "none", frozenset())
            out.append(Block(text, *top[1:], linked))
        parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)

    def close(i: int) -> None:
        for x in stack[i:]:
            depth[x[0]] -= 1
        del stack[i:]

    while at < end:
        found = tags.next(at)
        if found is None:
            add(page[at:])
            break
        start, after, slash, name, values = found
        add(page[at:start])
        at = after
        if not name:
            continue
        if slash:
            if name == "a":
                links = max(0, links - 1)
                continue
            if name in _INLINE:
                continue
            flush()
            if depth.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in _RAW or name in _NESTED:
            if name in _RAW or name not in ("svg", "math") or page[after - 2 : after - 1] != "/":
                at = tags.after(name, at)
            continue
        if name == "a":
            links += 1
            continue
        if name in _INLINE:
            continue
        flush()
        if name in _VOID:
            continue
        shut = _CLOSES.get(name, set()) | ({"p"} if name in _ENDS_P else set())
        if any(depth.get(x) for x in shut):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "table", "div", "article", "section", "body"):
                    break
        links = 0
        own = {k for v in values.values() for w in re.split(r"[^a-z]+", v.lower()) if (k := name_of(w))}
        _, above, inner, names = stack[-1] if stack else ("", frozenset(), "none", frozenset())
        stack.append((name, above | {name} if name in _TAGS and name not in above else above, name if name in _LANDMARKS else inner, names | own if own - names else names))
        depth[name] = depth.get(name, 0) + 1
    flush()
    return out


def feature_names(blocks: list[Block]) -> list[list[str]]:
    """Ancestor-tag and text features of each block of a page."""
    rows = []
    has_article = any("article" in b.tags or "main" in b.tags for b in blocks)
    for b in blocks:
        f = ["bias"]
        tags = b.tags
        f += [f"in:{t}" for t in _TAGS if t in tags]
        f += [f"name:{n}" for n in b.names]
        f.append(f"inner:{b.inner}")
        if any(n in b.names for n in _BAD):
            f.append("bad")
        if has_article and not tags & {"article", "main"}:
            f.append("outside")
        n = len(b.text)
        f.append("len:" + ("s" if n < 25 else "m" if n < 80 else "l" if n < 300 else "x"))
        share = b.linked / max(n, 1)
        f.append("link:" + ("0" if share < 0.1 else "some" if share < 0.6 else "most"))
        if b.text[-1] in ".!?:;…\"”":
            f.append("stop")
        if "©" in b.text or "·" in b.text or "|" in b.text or _RIGHTS.match(b.text):
            f.append("mark")
        rows.append(f)
    return rows


@dataclass
class BlockCRF:
    index: dict[str, int]
    weights: np.ndarray  # (features, 2): boilerplate, main
    move: np.ndarray  # (2, 2)
    first: np.ndarray  # (2,)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """Viterbi path."""
        if not rows:
            return []
        w, get = self.weights.tolist(), self.index.get
        (a00, a01), (a10, a11) = self.move.tolist()
        s0, s1 = self.first.tolist()
        back = []
        for k, fs in enumerate(rows):
            e0 = e1 = 0.0
            for f in fs:
                i = get(f)
                if i is not None:
                    e0 += w[i][0]
                    e1 += w[i][1]
            if k == 0:
                s0, s1 = s0 + e0, s1 + e1
                continue
            b0, b1 = s1 + a10 > s0 + a00, s1 + a11 > s0 + a01
            s0, s1 = max(s0 + a00, s1 + a10) + e0, max(s0 + a01, s1 + a11) + e1
            back.append((b0, b1))
        y = [int(s1 > s0)]
        for b in reversed(back):
            y.append(int(b[y[-1]]))
        return y[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> BlockCRF:
    """Gradient ascent (Adagrad) on the conditional log-likelihood; forward and backward sums over all pages at once."""
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    s, t = len(pages), max((len(r) for r, _ in pages), default=0)
    x = np.zeros((s, t, len(index)), np.float32)
    y = np.zeros((s, t), np.int64)
    mask = np.zeros((s, t), bool)
    for i, (rows, labels) in enumerate(pages):
        for j, fs in enumerate(rows):
            x[i, j, [index[f] for f in fs]] = 1
        y[i, : len(labels)] = labels
        mask[i, : len(labels)] = True
    crf = BlockCRF(index, np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2))
    params = [crf.weights, crf.move, crf.first]
    sums = [np.zeros_like(p) for p in params]
    gold = np.eye(2)[y] * mask[:, :, None]
    pair_mask = mask[:, 1:] & mask[:, :-1]
    pair_gold = np.einsum("sta,stb->ab", gold[:, :-1] * pair_mask[:, :, None], gold[:, 1:])
    for _ in range(rounds):
        e = x @ crf.weights
        alpha = np.zeros((s, t, 2))
        alpha[:, 0] = crf.first + e[:, 0]
        for k in range(1, t):
            new = np.logaddexp.reduce(alpha[:, k - 1, :, None] + crf.move, axis=1) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], new, alpha[:, k - 1])
        beta = np.zeros((s, t, 2))
        for k in range(t - 2, -1, -1):
            new = np.logaddexp.reduce(crf.move + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(mask[:, k + 1, None], new, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + crf.move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair_mask[:, :, None, None]
        diff = gold - node
        grads = [np.einsum("stf,sta->fa", x, diff), pair_gold - pair.sum((0, 1)), diff[:, 0].sum(0)]
        for p, g, q in zip(params, grads, sums):
            g = g / s - decay * p
            q += g * g
            p += rate * g / (np.sqrt(q) + 1e-6)
    return crf


def labelled_pages(n: int = 240, seed: int = 21) -> list[tuple[str, list[tuple[str, int]]]]:
    """Labelled training pages: (html, [(text of block, 1 if main)]), written from varied layouts of invented words."""
    rng = random.Random(seed)
    syl = "ba ce di fo gu la me ni po ru sa te vi zo an er ou qui sch ung".split()

    def sentence(lo: int, hi: int) -> str:
        words = ["".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def name(kind: str) -> str:
        w = rng.choice(_NAMES[kind].split())
        return rng.choice([f'class="{w}"', f'id="{w}"', f'class="box {w}-wrap"', f'class="x {w}"'])

    pages = []
    for _ in range(n):
        blocks: list[tuple[str, int]] = []

        def put(text: str, label: int, tag: str, attrs: str = "") -> str:
            blocks.append((text, label))
            return f"<{tag}{' ' + attrs if attrs else ''}>{_html.escape(text)}</{tag}>"

        def junk(kind: str) -> str:
            if kind == "menu":
                wrap = rng.choice(["<nav>", f"<div {name('menu')}>", "<nav>"])
                items = "".join(f"<li><a href='/{k}'>{put(sentence(1, 3), 0, 'span')}</a></li>" for k in range(rng.randint(2, 7)))
                return f"{wrap}<ul>{items}</ul></{wrap[1:4]}>"
            tag = {"foot": "footer", "head": "header", "side": "aside", "share": "form"}.get(kind, "div")
            if rng.random() < 0.4:
                tag = "div"
            attrs = name(kind) if tag == "div" or rng.random() < 0.3 else ""
            if kind == "comment":
                tag, attrs = rng.choice(["section", "div"]), name("comment")
            text = sentence(3, 40)
            if kind == "foot" and rng.random() < 0.7:
                text = "© " + text
            inner = put(text, 0, "p") if rng.random() < 0.5 else None
            if inner is None:
                return put(text, 0, tag, attrs)
            if rng.random() < 0.5:
                inner += put(sentence(3, 60), 0, rng.choice(["p", "div"]))
            return f"<{tag} {attrs}>{inner}</{tag}>"

        head = "".join(junk(k) for k in rng.sample(["menu", "ad", "head", "notice", "share"], rng.randint(1, 4)))
        tag, attrs = rng.choice([("article", ""), ("article", ""), ("article", name("body")), ("main", ""), ("div", name("body")), ("section", name("body"))])
        body = put(sentence(3, 12), 1, rng.choice(["h1", "h1", "h2"])) if rng.random() < 0.85 else ""
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            r = rng.random()
            if r < 0.75:
                body += put(sentence(1, 90), 1, "p")
            elif r < 0.82:
                body += put(sentence(1, 6), 1, rng.choice(["h2", "h3"]))
            elif r < 0.88:
                body += "<ul>" + "".join(put(sentence(2, 20), 1, "li") for _ in range(rng.randint(1, 4))) + "</ul>"
            elif r < 0.92:
                body += "<blockquote>" + put(sentence(3, 40), 1, "p") + "</blockquote>"
            else:
                body += junk(rng.choice(["ad", "share", "side", "notice", "comment"]))
        if rng.random() < 0.2:
            body += junk("comment")
        body = f"<{tag}{' ' + attrs if attrs else ''}>{body}</{tag}>"
        tail = "".join(junk(k) for k in rng.sample(["side", "comment", "foot", "share", "ad", "foot"], rng.randint(1, 4)))
        pages.append((f"<html><head><title>t</title></head><body>{head}{body}{tail}</body></html>", blocks))
    return pages


def fit(pages: list[tuple[str, list[tuple[str, int]]]] | None = None) -> BlockCRF:
    """Train on labelled pages; a leaf block takes the label of the labelled block with its text, in order."""
    data = []
    for page, truth in pages if pages is not None else labelled_pages():
        blocks = leaf_blocks(page)
        k, labels = 0, []
        for b in blocks:
            while k < len(truth) and " ".join(truth[k][0].split()) != b.text:
                k += 1
            labels.append(truth[k][1] if k < len(truth) else 0)
            k += 1
        if blocks:
            data.append((feature_names(blocks), labels))
    return train(data)


def main_text(page: str | None, crf: BlockCRF) -> str:
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, y in zip(blocks, crf.decode(feature_names(blocks))) if y)


def extract_text(df: DataFrame, html_col: str = "html", crf: BlockCRF | None = None) -> DataFrame:
    """``df`` with the column ``main_text``: main blocks in page order, joined by one space.

    Null and empty pages and pages without main blocks give an empty string. Character references are decoded and white
    space inside a block is one space; nothing else is dropped or cut. Other columns pass through whatever their names
    (``main_text`` is replaced); repeated rows give equal results; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != "main_text"]
    shared = df.sparkSession.sparkContext.broadcast(crf or fit())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(p, shared.value) for p in s], dtype=object)

    return df.select(*[df[c] for c in names], run(df[html_col]).alias("main_text"))
