"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A leaf block is a run of text between block-level tags; inline tags and line breaks don't end it.  Each block
has features of its ancestors (tags, words of class, id and role, nearest ones marked) and of its text (length,
share of link text, punctuation, telling words, place on the page).  Two labels, content and other, with
label-to-label weights; trained by penalised likelihood (forward-backward) on labelled pages, decoded by
Viterbi.  The content blocks' texts, references decoded, white space made single spaces and trimmed, are
joined in page order by a line break.  No block is dropped for its size and none is cut.

The labelled pages are written by ``labelled_pages``, a bounded set (PAGES) of layouts with known content:
semantic and class-named ones, some with names that say nothing or laid out by tables, lists, tables, quotes, unclosed tags, notices and comments inside articles.

Very long and very deep pages are read whole; a block's features are of its DEEP nearest open elements.
Null or empty html: empty text.  A page without content blocks: empty text.  Repeated rows, null ids and extra
columns don't matter: each row stands for itself.  Empty table: empty result.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, EPOCHS, RATE, PENALTY = 1000, 8, 0.1, 1e-3
#: Shares of labelled pages whose names say nothing, and that are laid out by tables.
HASHED, TABLED = 0.15, 0.06
OTHER, CONTENT = 0, 1
#: Open elements that a block's features look at: the nearest ones.
DEEP = 200

# Tags by their role in HTML.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td
    template textarea tfoot th thead tr ul""".split()
)
RAW = frozenset("script style title textarea template iframe noembed noframes xmp svg math object audio video canvas".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: A start tag of the key ends open tags of the values that stand inside the nearest of the bounds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
}
ENDS_P = BLOCKS - {"button", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "col", "colgroup", "option", "optgroup", "legend", "noscript"}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PART = re.compile(r"[a-z]+")
#: Words of notices, forms and page furniture.
TELLING = re.compile(r"\b(cookies?|consent|privacy|subscribe|newsletter|sign (?:in|up)|log ?in|register|advertisement|sponsored|all rights reserved|share (?:this|on)|related|read more|comments?|repl(?:y|ies)|search|menu|home|contact|copyright|imprint|impressum)\b|©|»", re.I)

RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)


class Block:
    __slots__ = ("at", "links", "path", "text", "total")

    def __init__(self, text: str, path: tuple, links: int, total: int):
        self.text, self.path, self.links, self.total = text, path, links, total


def leaf_blocks(page: str) -> list[Block]:
    """The page's non-empty leaf blocks in order.  path: (tag, words of class, id and role) of the open elements, outermost first."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()  # how often each tag is open
    parts: list[str] = []
    links = open_links = 0

    def flush():
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, tuple(stack[-DEEP:]), links, max(1, sum(map(len, parts)))))
        parts.clear()
        links = 0

    def close(depth: int):
        nonlocal open_links
        if any(t in BLOCKS for t, _ in stack[depth:]):
            flush()
        open_links = max(0, open_links - sum(t == "a" for t, _ in stack[depth:]))
        for t, _ in stack[depth:]:
            opened[t] -= 1
        del stack[depth:]

    def nearest(names, bounds=()) -> int | None:
        if not any(opened[x] for x in names):
            return None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in bounds:
                return None
        return None

    def said(raw: str):
        nonlocal links
        if raw:
            parts.append(raw)
            if open_links:
                links += len(raw)

    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            said(page[at:])
            break
        said(page[at:begin])
        m = TAG.match(page, begin) or LOOSE.match(page, begin)
        if not m:
            if begin + 1 < n and (page[begin + 1].isalpha() or page[begin + 1] in "/!?"):
                break  # the page ends inside a tag
            said("<")
            at = begin + 1
            continue
        at = m.end()
        if m.re is TAG and m[2] is None:
            continue
        tag, closing, attributes = m[2].lower(), m[1] == "/", m[3]
        if closing:
            depth = nearest({tag}, ("table",) if tag not in ("table", "body", "html") and tag in ("p", "b", "i", "a", "span", "div") else ())
            if depth is not None and tag not in ("html", "body"):
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            said(" ")
            continue
        if tag in ENDS_P and (depth := nearest({"p"}, ("td", "th", "li", "button", "div", "article", "section", "blockquote"))) is not None:
            close(depth)
        if tag in IMPLIED and (depth := nearest(*IMPLIED[tag])) is not None:
            first = depth
            while first and stack[first - 1][0] in IMPLIED[tag][0]:
                first -= 1
            close(first)
        if tag in BLOCKS:
            flush()
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        words = tuple(w for a in NAMED.findall(attributes) for w in PART.findall(a.lower())) if attributes else ()
        if attributes and HIDDEN.search(attributes):
            words += ("-hidden",)
        if tag == "a":
            open_links += 1
        stack.append((tag, words))
        opened[tag] += 1
    flush()
    return out


# ---------------------------------------------------------------- features


@functools.lru_cache(maxsize=4096)
def _path_features(path: tuple) -> tuple[str, ...]:
    blocks = [(t, w) for t, w in path if t not in ("html", "body")]
    out = {f"in:{t}" for t, _ in blocks} | {f"word:{x}" for _, w in blocks for x in w}
    for k, (t, w) in enumerate(reversed([x for x in blocks if x[0] in BLOCKS])):
        if k < 2:
            out.add(f"near{k}:{t}")
            out |= {f"near{k}word:{x}" for x in w}
    # how the block lies in its innermost article or main; a stop marks an element with names of its own
    inner = [t + "." * bool(w) for t, w in blocks if t in BLOCKS]
    start = max((i for i, x in enumerate(inner) if x.rstrip(".") in ("article", "main")), default=None)
    if start is not None:
        out.add("tail:" + ">".join([inner[start].rstrip("."), *inner[start + 1 :]]))
    if not any(t in ("nav", "header", "footer", "aside", "form") for t, _ in blocks):
        out.add("in:no furniture")
    return tuple(sorted(out))


def features(blocks: list[Block]) -> list[list[str]]:
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        density = b.links / b.total
        told = len(TELLING.findall(b.text)) if words < 60 else 0
        own = [
            "always",
            f"length:{min(6, int(math.log2(words + 1)))}",
            f"links:{0 if density == 0 else 1 if density < 0.3 else 2 if density < 0.8 else 3}",
            f"end:{'stop' if b.text[-1] in '.!?…:;' else 'other'}",
            f"told:{min(told, 2)}",
            f"place:{min(4, 5 * i // n)}",
        ]
        if RIGHTS.match(b.text):
            own.append("rights")
        out.append(own + list(_path_features(b.path)))
    return out


# ---------------------------------------------------------------- the field


class Model:
    """weights: feature -> (other, content); turns[a][b]: from label a to b; begin and end weights."""

    def __init__(self, weights: dict[str, tuple[float, float]], turns: list[list[float]], begin: list[float], end: list[float]):
        self.weights, self.turns, self.begin, self.end = weights, turns, begin, end

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not rows:
            return []
        get, none = self.weights.get, (0.0, 0.0)
        score, back = None, []
        for row in rows:
            found = [get(f, none) for f in row]
            own = (sum(x[0] for x in found), sum(x[1] for x in found))
            if score is None:
                score = [self.begin[k] + own[k] for k in (0, 1)]
                continue
            step = [0 if score[0] + self.turns[0][k] >= score[1] + self.turns[1][k] else 1 for k in (0, 1)]
            score = [score[step[k]] + self.turns[step[k]][k] + own[k] for k in (0, 1)]
            back.append(step)
        last = 0 if score[0] + self.end[0] > score[1] + self.end[1] else 1
        labels = [last]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Adagrad on the penalised conditional log-likelihood, pages in the given order."""
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    w, turns, ends = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros((2, 2))  # ends: begin, end
    sums = [np.full(x.shape, 1e-8) for x in (w, turns, ends)]
    data = [([np.array([names[f] for f in row]) for row in rows], labels) for rows, labels in pages if rows]
    for _ in range(epochs):
        for rows, labels in data:
            n = len(rows)
            own = np.array([w[r].sum(axis=0) for r in rows])
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0], behind[-1] = ends[0] + own[0], ends[1]
            for t in range(1, n):
                ahead[t] = np.logaddexp(ahead[t - 1][0] + turns[0], ahead[t - 1][1] + turns[1]) + own[t]
            for t in range(n - 2, -1, -1):
                nxt = own[t + 1] + behind[t + 1]
                behind[t] = np.logaddexp(turns[:, 0] + nxt[0], turns[:, 1] + nxt[1])
            z = np.logaddexp(*(ahead[-1] + ends[1]))
            p = np.exp(ahead + behind - z)
            g_own = p.copy()
            g_own[np.arange(n), labels] -= 1
            g_turn = np.zeros((2, 2))
            for t in range(1, n):
                g_turn += np.exp(ahead[t - 1][:, None] + turns + (own[t] + behind[t])[None, :] - z)
                g_turn[labels[t - 1], labels[t]] -= 1
            g_ends = np.array([p[0], p[-1]])
            g_ends[0, labels[0]] -= 1
            g_ends[1, labels[-1]] -= 1
            g_w = np.zeros_like(w)
            for r, g in zip(rows, g_own):
                g_w[r] += g
            for x, g, s in ((w, g_w, sums[0]), (turns, g_turn, sums[1]), (ends, g_ends, sums[2])):
                g = g + penalty * x
                s += g * g
                x -= rate * g / np.sqrt(s)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, turns.tolist(), ends[0].tolist(), ends[1].tolist())


# ---------------------------------------------------------------- labelled pages

# Names that page furniture and content go by.
FURNITURE = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav links pagination pager tabs",
    "header": "header masthead banner topbar logo branding hero site",
    "footer": "footer copyright colophon bottom legal credits sitemap",
    "sidebar": "sidebar side widget rail related recommended trending popular latest tags archive categories secondary",
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal overlay toast disclaimer",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner outbrain taboola teaser",
    "form": "form search login signup subscribe newsletter contact signin register share social",
    "comments": "comment comments reply replies responses discussion disqus respond thread",
}
BODY = "content post entry article story text main body page single blog"
TAGS = {"menu": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "p", "dialog", "noscript"), "advert": ("div", "aside", "section", "ins"), "form": ("form", "div", "fieldset"), "comments": ("section", "div", "ol", "ul")}


def labelled_pages(n: int = PAGES, seed: int = 7) -> Iterator[tuple[str, list[str]]]:
    """(html, content block texts in order)."""
    rng = random.Random(seed)
    syllables = "ba de ri to nu sel mor ka lin tha pre os um gé ñor schu öl ain ci ver".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda lo=4, hi=22: " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice("....!?")
    telling = ["Subscribe to our newsletter", "We use cookies", "All rights reserved", "Sign in", "Read more", "Share this", "Advertisement", "Related posts", "Privacy policy", "Log in", "Search"]

    hashed = False  # whether this page's names say nothing, as those that style sheets in scripts make up
    token = lambda: rng.choice(("css-", "sc-", "_", "x", "")) + "".join(rng.choice("abcdefghjkmnpqrtvwxyzABCDEFGHJK0123456789") for _ in range(rng.randint(5, 8)))

    def attribute(kind: str, chance: float) -> str:
        if rng.random() > chance:
            return ""
        if hashed:
            return f' class="{token()}{rng.choice(("", " " + token()))}"' if rng.random() < 0.8 else ""
        name = rng.choice(FURNITURE[kind].split() if kind else BODY.split())
        name = rng.choice((name, name, f"{name}-{word()}", f"{word()}_{name}", f"{name}{rng.randint(1, 9)}"))
        return f" {rng.choice(('class', 'class', 'id'))}={rng.choice(('%s', '%s', chr(39) + '%s' + chr(39)))}".replace("%s", name if rng.random() < 0.3 else f'"{name}"').replace("''", "'").replace("'\"", '"').replace("\"'", '"')

    def furniture(kind: str) -> str:
        tag = rng.choice(TAGS[kind])
        attr = attribute(kind, 1.0 if tag in ("div", "ul", "ol", "p", "section", "ins") else 0.4)
        link = lambda: f'<a href="/{word()}">{word()}{rng.choice(("", " " + word()))}</a>'
        if kind == "menu":
            items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
            inner = items if tag in ("ul", "menu") else rng.choice((f"<ul>{items}</ul>", " | ".join(link() for _ in range(rng.randint(3, 8)))))
        elif kind == "header":
            inner = f"<h2>{link()}</h2>" + rng.choice(("", f"<p>{sentence(2, 6)}</p>", f"<div>{word()}</div>"))
        elif kind == "footer":
            inner = rng.choice(("", f"<p>{sentence()}</p>")) + f"&copy; {rng.randint(1990, 2026)} {word()}.example &middot; {rng.choice((sentence(3, 14), 'All rights reserved', link()))}"
        elif kind == "sidebar":
            inner = f"<h3>{word()} {word()}</h3>" + rng.choice((f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 6)))}</ul>", f"<p>{sentence()}</p>"))
        elif kind == "form":
            inner = rng.choice(("", f"<p>{sentence(3, 9)}</p>")) + f"<label>{word()}</label><input name=q><button>{rng.choice(telling)}</button>"
        elif kind == "comments":
            each = "li" if tag in ("ol", "ul") else rng.choice(("div", "article", "p"))
            inner = "".join(f"<{each}{attribute('comments', 0.5)}>" + rng.choice((f"<b>{word()}</b> ", f"<h4>{word()}</h4>", "")) + (f"<p>{sentence()} {sentence()}</p>" if each != "p" else sentence()) + f"</{each}>" for _ in range(rng.randint(1, 5)))
            if each != "li" and rng.random() < 0.5:
                inner = f"<h3>{rng.randint(1, 40)} comments</h3>" + inner
        else:
            inner = rng.choice((sentence(3, 16), f"<p>{sentence()}</p>", f"{rng.choice(telling)}. {sentence()}", f'{sentence(3, 9)} <a href="#">{word()}</a>'))
        return f"<{tag}{attr}>{inner}</{tag}>"

    for number in range(n):
        content: list[str] = []

        def told(text: str) -> str:
            content.append(" ".join(text.split()))
            return html.escape(text, quote=False)

        def paragraph(loose: bool) -> str:
            kind = rng.random()
            text = sentence(1, 3) if rng.random() < 0.25 else " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 7))))
            if kind < 0.07:
                return f"<h{(h := rng.randint(2, 4))}>{told(sentence(1, 6)[:-1])}</h{h}>"
            if kind < 0.13:
                return "<ul>" + "".join(f"<li>{told(sentence(2, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            if kind < 0.17:
                return f"<blockquote><p>{told(text)}</p></blockquote>"
            if kind < 0.20:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{told(word() + ' ' + word())}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
            if kind < 0.23:
                return f"<pre>{told(word() + ' = ' + word() + '(' + word() + ')')}</pre>"
            if kind < 0.26:
                return f"<figure><img src=x.png><figcaption>{told(sentence(3, 10))}</figcaption></figure>"
            if kind < 0.30:
                return f"<p{styled}>{told(rng.choice(telling) + rng.choice(('.', ' ' + sentence(1, 6), '')))}</p>"
            if kind < 0.38:
                return f"<p{styled}><b>{told(text)}<br>" if loose else f"<p{styled}><b>{told(text)}</b></p>"
            if kind < 0.46:
                a, b = sentence(3, 8), word()
                content.append(f"{a} {b} {text}")
                return f'<p{styled}>{a} <a href="/{word()}">{b}</a> {text}</p>'
            return f"<p{styled}>{told(text)}" + ("" if loose and rng.random() < 0.3 else "</p>")

        loose, hashed = rng.random() < 0.35, rng.random() < HASHED
        styled = f' class="{token()}"' if hashed and rng.random() < 0.6 else ""  # the paragraphs of such a page may all have one name
        tag, attr = rng.choice((("article", ""), ("article", attribute("", 0.5)), ("main", attribute("", 0.4)), ("div", attribute("", 1.0)), ("div", attribute("", 1.0)), ("section", attribute("", 0.8))))
        title = sentence(3, 9)[:-1]
        body = [rng.choice(("<h1>%s</h1>", "<h1>%s</h1>", "<header><h1>%s</h1></header>")) % told(title)] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 2, 4, 7, 12, 30))):
            body.append(paragraph(loose))
            if rng.random() < 0.03:  # some texts say the same over and over
                again = told(sentence(1, 5))
                body += [f"<p>{again}</p>"] + [f"<p>{told(html.unescape(again))}</p>" for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.06:
                body.append(("</b>" if loose else "") + furniture(rng.choice(("advert", "notice", "sidebar", "form"))))
        inside = furniture("comments") if rng.random() < 0.2 else ""
        main = f"<{tag}{attr}>" + "\n".join(body) + inside + f"</{tag}>"
        if rng.random() < 0.3:
            main = f"<div{attribute('', 0.6)}>{main}</div>"
        if rng.random() < TABLED:  # laid out by a table: menu and text side by side, the footer a row
            link = lambda: f'<a href="/{word()}">{word()}{rng.choice(("", " " + word()))}</a>'
            links = "<br>".join(link() for _ in range(rng.randint(3, 8)))
            side = rng.choice((links, "".join(f"<p>{link()}</p>" for _ in range(4)), f"<table>{''.join(f'<tr><td>{link()}</td></tr>' for _ in range(4))}</table>"))
            width = rng.choice(("", " width=150", ' valign="top"'))
            cell = main if rng.random() < 0.4 else "\n".join(body)
            last = f"<tr><td colspan=2>{rng.choice(('&copy;', 'Copyright', 'Copyright &copy;'))} {rng.randint(1990, 2026)} {word()}{rng.choice(('', ' ' + word(), '. All rights reserved.'))}</td></tr>"
            main = f"<table{width}><tr><td{width}>{side}</td><td>{cell}</td></tr>{rng.choice((last, last, ''))}</table>"
        ahead = [furniture(k) for k, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.8), ("form", 0.2), ("advert", 0.5), ("sidebar", 0.2)) if rng.random() < p]
        after = [furniture(k) for k, p in (("comments", 0.3), ("sidebar", 0.4), ("form", 0.25), ("advert", 0.2), ("menu", 0.2), ("footer", 0.85), ("notice", 0.1)) if rng.random() < p]
        if rng.random() < 0.15:  # a page may be its article alone
            ahead, after = [], []
        head = f'<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        yield head + "".join(ahead) + f"<!-- {number} -->" + main + "".join(after) + rng.choice(("</body></html>", "")), content


def align(blocks: list[Block], content: list[str]) -> list[int]:
    """Labels of blocks: those that match the next content text in order."""
    labels, at = [], 0
    for b in blocks:
        hit = at < len(content) and b.text == content[at]
        labels.append(CONTENT if hit else OTHER)
        at += hit
    return labels


@functools.lru_cache(maxsize=1)
def trained_model() -> Model:
    data = []
    for page, content in labelled_pages():
        blocks = leaf_blocks(page)
        data.append((features(blocks), align(blocks, content)))
    return train(data)


def main_text(page: str | None, model: Model) -> tuple[str, int, int]:
    """The main text, the number of blocks and of content blocks."""
    blocks = leaf_blocks(page or "")
    kept = [b.text for b, k in zip(blocks, model.decode(features(blocks))) if k == CONTENT]
    return "\n".join(kept), len(blocks), len(kept)


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks, n_content."""
    shipped = pages.sparkSession.sparkContext.broadcast(model or trained_model())

    def run(batches):
        own = shipped.value
        for batch in batches:
            got = [main_text(x, own) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
