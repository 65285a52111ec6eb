"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sampled, slices, table, texts

#: Pages of the table, those with the least hash of page_id, that the model is fitted on beside the built-in layouts. A bound, not a share.
TRAIN_PAGES = 200
#: Bytes of a page that training takes; longer ones are extracted from like all others.
TRAIN_BYTES = 1 << 20
LAYOUTS = 300
#: Share of a page's text from which on an element is one around all of it.
WIDE = 0.75

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas textarea select button title".split())
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Of these, those that hold no blocks.
WITHOUT_BLOCKS = ("button", "select", "textarea", "title", "canvas", "svg", "math")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("table ul ol dl select article section div body html main nav aside footer header form td th blockquote".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An open element: what is above it, its marks, and how much text it holds."""

    __slots__ = ("above", "parent", "tag", "marks", "size", "fresh")

    def __init__(self, above: Node | None, tag: str, marks: tuple[str, ...]):
        self.above, self.tag, self.marks, self.size, self.fresh = above, tag, marks, 0, ()
        self.parent = tag if tag in BREAKS else above.parent if above else ""


@dataclass
class Block:
    """Text between two block-level tags, the element that it stands in, and how much of it are links."""

    text: str
    node: Node
    links: int

    @property
    def above(self) -> list[str]:
        """Features of all elements around the block, each once, and of its parent."""
        out, node = [f"parent:{self.node.parent}"], self.node
        while node:
            out += node.fresh
            node = node.above
        return out


def _name_features(nodes: list[Node]) -> None:
    """Gives each element the features that none above it has. An element with most of a page's text says by its names little about
    any of it: these are features of another kind."""
    for node in reversed(nodes):
        if node.above:
            node.above.size += node.size
    whole, seen, path = nodes[0].size if nodes else 0, Counter(), []
    for node in nodes:
        while path and path[-1] is not node.above:
            seen.subtract(path.pop().fresh)
        marks = [f"wide:{m}" if m.startswith("name:") and node.size >= WIDE * whole else m for m in node.marks]
        node.fresh = tuple(m for m in dict.fromkeys(marks) if not seen[m])
        seen.update(node.fresh)
        path.append(node)


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order. Character references decoded, white space squeezed; scripts, styles, comments and markup left out.

    An element whose content isn't shown ends at the next block if it can hold none; others hide nothing if they are never closed.
    """
    out: list[Block] = []
    root = Node(None, "", ())
    nodes, stack, pieces = [root], [root], []
    open_: Counter[str] = Counter()
    linked = hidden = in_link = 0
    lower, last_close = page.lower(), {}

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, stack[-1], linked))
                stack[-1].size += len(text)
            pieces.clear()
        linked = 0

    def pop(at: int) -> None:
        nonlocal hidden, in_link
        for node in stack[at:]:
            open_[node.tag] -= 1
            hidden -= node.tag in UNSEEN
            in_link -= node.tag == "a"
        del stack[at:]

    def pop_last(names, stop=frozenset()) -> None:
        """Closes the innermost open element of these names, and all in it, if none of `stop` lies between."""
        if any(open_[x] > 0 for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in names:
                    return pop(k)
                if stack[k].tag in stop:
                    return None

    def words(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            said = html.unescape(raw)
            pieces.append(said)
            linked += len(said) if in_link else 0

    i = 0
    for m in _TAG.finditer(page):
        if m.start() < i:
            continue
        words(page[i : m.start()])
        i = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BREAKS:
                flush()
            pop_last((name,))
            continue
        if name == "br":
            pieces.append(" ")
        if name in BREAKS:
            flush()
            if hidden and name not in ("option", "optgroup"):
                pop_last(WITHOUT_BLOCKS)
            pop_last(_CLOSES.get(name, {"p"}), _SCOPES)
        if name in VOID or (m[3] or m[6] or "").endswith("/"):
            continue
        if name in ("script", "style"):
            i = lower.find(f"</{name}", i)
            i = len(page) if i < 0 else i
        elif name in UNSEEN and name != "head":
            if name in WITHOUT_BLOCKS:
                pop_last((name,))
            else:
                if name not in last_close:
                    last_close[name] = lower.rfind(f"</{name}")
                if last_close[name] < i:
                    continue
        if name in ("body", "article", "main"):
            pop_last(("head",))
        marks = [f"tag:{name}"] if name in BREAKS else []
        for _, a, b, c in _NAMES.findall(m[3] or m[6] or ""):
            marks += [f"name:{w}" for w in _WORDS.findall((a or b or c).lower())]
        stack.append(Node(stack[-1], name, tuple(marks)))
        nodes.append(stack[-1])
        open_[name] += 1
        hidden += name in UNSEEN
        in_link += name == "a"
    words(page[i:])
    flush()
    _name_features(nodes)
    return out


def text_features(block: Block, place: int, n: int) -> list[str]:
    words = block.text.count(" ") + 1
    return [
        f"words:{min(int(math.log2(words)), 8)}",
        f"links:{min(4, 4 * block.links // max(1, len(block.text)))}",
        f"ends:{block.text[-1] in '.!?…。»”'}",
        f"rights:{'©' in block.text or 'copyright' in block.text.lower()}",
        f"place:{'first' if not place else 'last' if place == n - 1 else 'inside'}",
        "bias",
    ]


@dataclass
class Crf:
    """Labels 0 (other) and 1 (main text). Weights by feature and label, and by pair of neighbouring labels."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, page: list[Block]) -> np.ndarray:
        out, none, above = np.zeros((len(page), 2)), np.zeros(2), {}
        total = lambda features: sum((self.weights.get(f, none) for f in features), none)
        for i, b in enumerate(page):
            path, node = [], b.node
            while node and id(node) not in above:
                path.append(node)
                node = node.above
            for node in reversed(path):
                above[id(node)] = total(node.fresh) + (above[id(node.above)] if node.above else none)
            out[i] = above[id(b.node)] + total((f"parent:{b.node.parent}", *text_features(b, i, len(page))))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi); of equally likely ones, main text."""
        if not page:
            return []
        rows, ((a, b), (c, d)) = self.scores(page).tolist(), self.moves.tolist()
        (x, y), back = rows[0], []
        for s0, s1 in rows[1:]:
            back.append((c + y >= a + x, d + y >= b + x))
            x, y = s0 + max(a + x, c + y), s1 + max(b + x, d + y)
        labels = [int(y >= x)]
        for from_ in reversed(back):
            labels.append(int(from_[labels[-1]]))
        return labels[::-1]


def _lse(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(s: list[list[float]], t: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """By the forward-backward recursion, in log space: each block's label probabilities, and the expected number of each pair of neighbouring labels."""
    (a, b), (c, d) = t
    x, y = s[0]
    up = [(x, y)]
    for s0, s1 in s[1:]:
        x, y = s0 + _lse(a + x, c + y), s1 + _lse(b + x, d + y)
        up.append((x, y))
    total, x, y = _lse(x, y), 0.0, 0.0
    down = [(x, y)]
    for s0, s1 in reversed(s[1:]):
        x, y = _lse(a + s0 + x, b + s1 + y), _lse(c + s0 + x, d + s1 + y)
        down.append((x, y))
    up_, down_, own = np.array(up), np.array(down[::-1]), np.array(s)
    pairs = up_[:-1, :, None] + np.array(t) + (own[1:] + down_[1:])[:, None, :] - total
    return np.exp(up_ + down_ - total), np.exp(pairs).sum(axis=0)


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 20, rate: float = 0.3, decay: float = 1e-3, seed: int = 1) -> Crf:
    """Maximum likelihood by AdaGrad over pages; marginals by the forward-backward recursion."""
    index: dict[str, int] = {}
    data = []
    for blocks, labels in pages:
        ids = [[index.setdefault(f, len(index)) for f in (*b.above, *text_features(b, i, len(blocks)))] for i, b in enumerate(blocks)]
        if ids:
            lengths = [len(x) for x in ids]
            flat = np.concatenate([np.array(x) for x in ids])
            used, place = np.unique(flat, return_inverse=True)
            data.append((flat, np.cumsum([0, *lengths[:-1]]), np.repeat(np.arange(len(ids)), lengths), used, place, np.array(labels)))
    w, t = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            flat, starts, owner, used, place, ys = data[k]
            slope, step_t = marginals(np.add.reduceat(w[flat], starts, axis=0).tolist(), t.tolist())
            slope[np.arange(len(ys)), ys] -= 1
            np.subtract.at(step_t, (ys[:-1], ys[1:]), 1)
            step = decay * w[used]
            for label in (0, 1):
                step[:, label] += np.bincount(place, weights=slope[owner, label], minlength=len(used))
            gw[used] += step**2
            w[used] -= rate * step / np.sqrt(gw[used])
            gt += step_t**2
            t -= rate * step_t / np.sqrt(gt)
    return Crf({f: w[i] for f, i in index.items()}, t)


# Names that layouts give to what is main text and what is not.
MAIN_NAMES = ("content", "post", "entry", "story", "main", "article", "body text")
OTHER_NAMES = (
    "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sidebar", "side", "widget", "related", "menu", "navbar", "navigation", "breadcrumb", "header", "masthead", "footer",
    "copyright", "cookie notice", "notice", "consent", "alert", "comments", "comment", "reply", "respond", "newsletter", "subscribe", "share", "social", "popup", "modal", "login", "search form",
)
OTHER_TAGS = ("nav", "header", "footer", "aside", "form", "menu")


def label_of(block: Block) -> int:
    """The label of a block of a page that marks its article: inside it, and under nothing that is named as something else."""
    marks = {m.removeprefix("wide:") for m in block.above}
    names = {f"name:{w}" for x in OTHER_NAMES for w in x.split()} - {"name:text", "name:form"}
    return int(bool(marks & {"tag:article", "tag:main"}) and not marks & names and not marks & {f"tag:{t}" for t in OTHER_TAGS})


def layouts(n: int, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages in layouts of many kinds, made from a seed; main text carries a mark that its blocks lose again."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    said = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    def other() -> str:
        kind, name = rng.choice(("links", "short", "long", "form", "comments")), rng.choice(OTHER_NAMES)
        tag = rng.choice((*OTHER_TAGS, "div", "div", "div", "section", "ul"))
        mark = f' class="{name}"' if tag in ("div", "section", "ul") or rng.random() < 0.3 else ""
        if rng.random() < 0.15:  # a bare row of links, or a bare line of rights
            links = " | ".join(f"<a href='/'>{said(1, 3)}</a>" for _ in range(rng.randint(1, 7)))
            line = links if rng.random() < 0.7 else f"&copy; {rng.randint(1990, 2030)} {said(1, 6)}"
            return rng.choice((f"<table><tr><td>{line}</td></tr></table>", f"<div>{line}</div>", f"<p>{line}</p>"))
        if kind == "links":
            inner = "<ul>" + "".join(f"<li><a href='/'>{said(1, 3)}</a></li>" for _ in range(rng.randint(2, 7))) + "</ul>"
        elif kind == "form":
            inner = f"<form><label>{said(1, 4)}</label><input><p>{said(3, 9)}</p></form>"
        elif kind == "comments":
            tag, mark = "div", ' class="comments"'
            inner = "".join(f"<div class='comment'><b>{word()}</b><p>{said(3, 40)}.</p></div>" for _ in range(rng.randint(1, 4)))
        else:
            inner = f"<p>{said(2, 9) if kind == 'short' else said(12, 60) + '.'}</p>"
        return f"<{tag}{mark}>{inner}</{tag}>"

    def title(tag: str = "h1") -> str:
        return f"<{tag}>{said(2, 9)}@@</{tag}>"

    def paragraphs(n: int) -> list[str]:
        parts = []
        for _ in range(n):
            r = rng.random()
            long_ = f"<p>{said(1, 4) if r < 0.15 else said(8, 120)}.@@</p>"
            parts.append(f"<ul><li>{said(2, 12)}@@<li>{said(2, 12)}@@</ul>" if r > 0.93 else title("h2") if r > 0.86 else f"<blockquote>{said(9, 40)}.@@</blockquote>" if r > 0.82 else long_)
            if rng.random() < 0.1:
                parts.append(f'<div class="{rng.choice(OTHER_NAMES)}">{said(3, 20)}.</div>')
        return parts

    def main() -> str:
        """The article, in an element that says so, in one with some other name, in a table's cell, or in bare blocks."""
        kind, n = rng.random(), rng.randint(1, 9)
        parts = ([title()] if rng.random() < 0.8 else []) + paragraphs(n)
        if kind < 0.35:
            inner = f"<article>{''.join(parts)}</article>"
        elif kind < 0.6:
            inner = f'<div class="{rng.choice(MAIN_NAMES)}">{"".join(parts)}</div>'
        elif kind < 0.72:
            inner = f'<div class="{word()}">{"".join(parts)}</div>'
        elif kind < 0.84:
            cell = "<br><br>".join(said(9, 80) + "." for _ in range(n)) + "@@" if rng.random() < 0.5 else "".join(parts)
            inner = f"<table><tr><td>{cell}</td></tr></table>"
        elif kind < 0.92:
            inner = "".join(f"<div>{said(9, 90)}.@@</div>" for _ in range(n))
        else:
            inner = "".join(parts)
        return f"<main>{inner}</main>" if kind < 0.6 and rng.random() < 0.4 else inner

    out = []
    for _ in range(n):
        before, after = ["".join(other() for _ in range(rng.randint(0, 4))) for _ in range(2)]
        body = main()
        if rng.random() < 0.5:  # an element around the article, or one around all, whose names say nothing
            all_, own = rng.random() < 0.5, (*MAIN_NAMES, word(), word())
            names = " ".join(rng.choice((*OTHER_NAMES, *own) if all_ else own) for _ in range(rng.randint(1, 3)))
            body, before, after = (f'<div class="{names}">{before}{body}{after}</div>', "", "") if all_ else (f'<div class="{names}">{body}</div>', before, after)
        blocks = blocks_of(f"<html><head><title>{said(2, 5)}</title></head><body>{before}{body}{after}</body></html>")
        labels = [int(b.text.endswith("@@")) for b in blocks]
        out.append(([Block(b.text.removesuffix("@@"), b.node, b.links) for b in blocks], labels))
    return out


def main_text(page: str, model: Crf) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, y in zip(blocks, model.decode(blocks), strict=True) if y)


def train(pages: DataFrame, page_id: str = "page_id", page: str = "html", most: int = TRAIN_PAGES) -> Crf:
    """Fits on built-in layouts and on `most` pages at most that mark their article, of TRAIN_BYTES at most each, taken by a hash of their id.

    Only pages under the hash's bound go to the driver, `most` * TRAIN_BYTES at most whatever the number of tasks. No such page, or an empty table: the layouts alone.
    """
    marked = pages.filter(F.col(page).rlike("(?i)<(article|main)[\\s>]") & (F.octet_length(page) <= TRAIN_BYTES))
    key = F.col(page_id).cast("string")
    sample = sampled(marked, most, key).orderBy(F.xxhash64(key), F.xxhash64(page)).limit(most).select(page).collect()
    return fit(layouts(LAYOUTS) + [(b, [label_of(x) for x in b]) for b in (blocks_of(r[0]) for r in sample)])


def _extract(schema: T.StructType, column: str, model):
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            said = [main_text(x.decode("utf-8", "replace"), model.value) for x in texts(part, column)]
            made = {"text": pa.array(said, pa.string()), "n_chars": pa.array([len(x) for x in said], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[x] if x in made else part.column(x) for x in names], names=names)

    return run


def extract(pages: DataFrame, model: Crf, page: str = "html") -> DataFrame:
    """`pages` with `text`, the blocks labelled main text joined by a space, and n_chars, its code points.

    Null or empty html, and pages without main text: empty, 0. Cut-off markup is read as far as it goes. Very long and very deep
    pages: one pass, in proportion to their length. Repeated rows: each read.
    Columns named text or n_chars are replaced. Empty table: empty.
    """
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")])
    schema = T.StructType(rows.schema.fields + list(T.StructType.fromDDL("text string, n_chars long")))
    return rows.mapInArrow(_extract(schema, page, pages.sparkSession.sparkContext.broadcast(model)), schema)


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).drop("html")
