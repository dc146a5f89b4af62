"""HTML extraction: a bidirectional LSTM in numpy labels every block of a page from its tag path and hashed words."""

from __future__ import annotations

import html as entities
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import any_names, bounded_batches, by_hash, quoted, slices

#: Slots of the hashed path tokens and words, numbers for each, other numbers of a block, hidden numbers of each direction.
PATH_SLOTS, WORD_SLOTS, DEPTH, EXTRA, HIDDEN = 1024, 2048, 16, 8, 16
#: The labeller is fitted on so many pages at most, each of so many blocks and characters at most.
TRAIN_PAGES, TRAIN_BLOCKS, TRAIN_CHARS = 240, 80, 60_000
#: Blocks, with padding, of the pages that are labelled together, or one page; time steps whose inputs are multiplied at once.
CELLS, STEPS = 16_384, 2048

# Element names of the HTML standard.
_RAW = {"script", "style", "title", "textarea", "iframe"}
#: Elements within a paragraph whose text is a block of its own.
_APART = {"noscript", "template", "object", "svg", "select", "optgroup", "option", "datalist", "button", "canvas", "audio", "video"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "mspace", "menclose", "merror", "maction", "semantics", "annotation"}
_ENDS_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "select": {"select"}}
_HOLDS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "aside", "nav", "header", "footer", "blockquote", "form"}
#: Elements that implied end tags close or stop at.
_STOPS = _HOLDS | _APART | set().union(*_ENDS_ITSELF.values())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?![^\s/>])", re.I | re.A) for name in _RAW}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Elements above a link or other inline element that ends among them, for which it is taken out of their paths.
UNLINKED = 64


class _Open:
    """An open element: its parent, and what of the path down to it blocks need. Paths share their beginnings, so a page takes memory for its tags, however deep they are."""

    __slots__ = ("dead", "links", "mask", "name", "outer", "parent", "place", "stops", "tokens")

    def __init__(self, name: str, tokens: tuple[str, ...], parent: _Open | None, place: int):
        self.name, self.tokens, self.parent, self.place, self.dead = name, tokens, parent, place, False
        mask = parent.mask if parent else 0
        for t in tokens:
            mask |= 1 << _slot(t, PATH_SLOTS)
        #: slots of all tokens of the path as bits, links and elements that aren't inline among them
        self.mask = mask
        self.links = (parent.links if parent else 0) + (name == "a")
        self.outer = (parent.outer if parent else 0) + (name not in _INLINE)
        #: the nearest element that an implied end tag looks at
        self.stops = self if name in _STOPS else parent.stops if parent else None

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at:
            out.append(at.tokens)
            at = at.parent
        return tuple(t for ts in reversed(out) for t in ts)


class Block:
    """Text between two breaks, with the tokens of the elements around it: as a tuple, or as the element that it stands in."""

    __slots__ = ("inside", "linked", "own", "text")

    def __init__(self, text: str, path: tuple[str, ...] | None, linked: int, inside: _Open | None = None):
        self.text, self.own, self.linked, self.inside = text, path, linked, inside

    @property
    def path(self) -> tuple[str, ...]:
        return self.own if self.own is not None else self.inside.path() if self.inside else ()

    def slots(self) -> tuple[int, str]:
        """(slots of the distinct tokens as bits, the last two elements)."""
        if self.own is None:
            e = self.inside
            return (e.mask, f"{e.parent.name}>{e.name}" if e.parent else e.name) if e else (0, "")
        mask = 0
        for t in {*self.own}:
            mask |= 1 << _slot(t, PATH_SLOTS)
        return mask, ">".join([x for x in self.own if x[0] != "."][-2:])


def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    out = [name]
    if attributes:
        for value in _ATTR.findall(attributes):
            out += ["." + x.lower() for x in _PART.findall(value)]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order; comments, scripts, styles, titles, text fields, frames and markup are no part of any.

    Character references are decoded in each piece of text between tags; white space within a block is one space. Inline
    elements, formulas and line breaks do not end a block; buttons, lists of options,
    and what stands for embedded media or scripts are blocks of their own. Broken markup is read as
    browsers do: an unclosed paragraph or item ends with the next, a cut-off
    tag is dropped.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    open_at: dict[str, list[int]] = defaultdict(list)  # of each name, the places in the stack
    parts: list[str] = []
    linked = at = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, None, linked, stack[-1] if stack else None))
            parts.clear()
        linked = 0

    def cut(k: int) -> None:
        """Close the elements from place ``k`` on."""
        while len(stack) > k:
            e = stack.pop()
            if not e.dead:
                open_at[e.name].pop()

    def unlink(k: int) -> None:
        """Close an inline element that others have been opened in since."""
        open_at[stack[k].name].pop()
        below = stack[k].parent
        stack[k].dead = True
        if len(stack) - k <= UNLINKED:
            for i in range(k + 1, len(stack)):
                if not stack[i].dead:
                    stack[i] = below = _Open(stack[i].name, stack[i].tokens, below, i)

    def text(begin: int, end: int) -> None:
        nonlocal linked
        if end > begin:
            node = page[begin:end]
            parts.append(entities.unescape(node) if "&" in node else node)
            if links:
                linked += end - begin

    n = len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            text(at, n)
            break
        after = page[mark + 1 : mark + 2]
        if after == "!" or after == "?":
            text(at, mark)
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", mark)
                at = n if end < 0 else end + 1
            continue
        if not (after.isalpha() or after == "/"):
            text(at, mark + 1)
            at = mark + 1
            continue
        m = _TAG.match(page, mark)
        text(at, mark)
        if m:
            closing, name, attributes, at = m[1], m[2].lower(), m[3], m.end()
        else:
            end = page.find(">", mark)
            if end < 0:
                break
            at = end + 1
            m = re.match(r"</?([a-zA-Z][^\s/>]*)", page[mark : min(end, mark + 80)])
            if not m:
                continue
            closing, name, attributes = page[mark + 1] == "/", m[1].lower(), ""
        if closing:
            if name not in _INLINE:
                flush()
            if open_at[name]:
                k = open_at[name][-1]
                if name in _INLINE and stack[-1].outer > stack[k].outer:
                    unlink(k)
                else:
                    cut(k)
                while stack and stack[-1].dead:
                    stack.pop()
                links = stack[-1].links if stack else 0
            continue
        if name in _RAW:
            parts.append(" ")
            if not attributes.rstrip().endswith("/"):
                end = _RAW_END[name].search(page, at)
                close = page.find(">", end.end()) if end else -1
                at = n if close < 0 else close + 1
            continue
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
        else:
            flush()
            ends = _ENDS_ITSELF.get(name) or ({"p"} if name not in _VOID and name not in _APART else set())
            e = stack[-1].stops if stack else None
            while e and e.name not in ends and e.name not in _HOLDS and e.name not in _APART:
                e = e.parent.stops if e.parent else None
            if e and e.name in ends:
                cut(e.place)
                while stack and stack[-1].dead:
                    stack.pop()
            links = stack[-1].links if stack else 0
        if name not in _VOID and not (attributes.endswith("/") and name not in _HOLDS):
            open_at[name].append(len(stack))
            stack.append(_Open(name, _tokens(name, attributes), stack[-1] if stack else None, len(stack)))
            links = stack[-1].links
    flush()
    return out


# --- features -------------------------------------------------------------------------


def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % slots


_paths: dict[tuple[int, str], list[int]] = {}


def features(page: list[Block]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
    """(path slots, word slots, other numbers) of each block."""
    extra = np.zeros((len(page), EXTRA), np.float32)
    paths, words = [], []
    for k, b in enumerate(page):
        mask, tail = b.slots()
        own = _paths.get((mask, tail))
        if own is None:
            if len(_paths) > 50_000:
                _paths.clear()
            own = _paths[mask, tail] = [k for k in range(mask.bit_length()) if mask >> k & 1] + [_slot(tail, PATH_SLOTS)]
        paths.append(own)
        ws = b.text.lower().split()
        words.append([_slot(w, WORD_SLOTS) for w in ws])
        n, coded = len(b.text), b.text.encode("utf-8", "replace")
        digits = len(coded) - len(coded.translate(None, b"0123456789"))
        stops = sum(b.text.count(c) for c in ".!?")
        extra[k] = (np.log1p(len(ws)) / 4, min(1, b.linked / n), min(2, 20 * stops / n), digits / n, k / len(page), (len(page) - k) / len(page), k == 0, "©" in b.text)
    return paths, words, extra


def _means(lists: list[list[int]], table: np.ndarray, mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists])
    flat = np.fromiter((s for x in lists for s in x), np.int64, counts.sum())
    owner = np.repeat(np.arange(len(lists)), counts)
    scale = (1 / np.maximum(counts, 1) if mean else np.ones(len(lists))).astype(np.float32)
    out = np.zeros((len(lists), table.shape[1]), np.float32)
    if len(flat):
        some = np.flatnonzero(counts)
        out[some] = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(counts)])[some])
    return out * scale[:, None], flat, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings of path and word slots, a forward and a backward LSTM over the page, a logistic unit for each block."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        size = 2 * DEPTH + EXTRA
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"path": normal(PATH_SLOTS, DEPTH, scale=0.3), "word": normal(WORD_SLOTS, DEPTH, scale=0.3), "out": normal(2 * HIDDEN + size, scale=0.2), "shift": np.zeros(1, np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = normal(size, 4 * HIDDEN, scale=size**-0.5)
            self.p[f"h{d}"] = normal(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5)
            self.p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)

    def _inputs(self, pages: list[tuple]) -> tuple:
        paths, words = [x for p in pages for x in p[0]], [x for p in pages for x in p[1]]
        path, path_flat, path_owner = _means(paths, self.p["path"], False)
        word, word_flat, word_owner = _means(words, self.p["word"], True)
        return np.concatenate([path, word, np.concatenate([p[2] for p in pages])], axis=1), path_flat, path_owner, word_flat, word_owner

    def _run(self, x: np.ndarray, d: str, keep: bool = False) -> tuple:
        """x: time, page, numbers; pages of one length, or padded at the end that comes last."""
        t, n, _ = x.shape
        h, c, w = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), self.p[f"h{d}"]
        out, kept = np.empty((t, n, HIDDEN), np.float32), []
        for k in range(t):
            if k % STEPS == 0:
                part = x[k : k + STEPS]
                gates_x = (part.reshape(-1, part.shape[2]) @ self.p[f"x{d}"] + self.p[f"b{d}"]).reshape(len(part), n, -1)
            g = gates_x[k % STEPS] + h @ w
            s, u = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before, c = c, f * c + i * u
            tc = np.tanh(c)
            if keep:
                kept.append((i, f, o, u, before, tc, h))
            h = o * tc
            out[k] = h
        return out, kept

    def scores(self, pages: list[tuple]) -> list[np.ndarray]:
        """The probability of each block; pages of like length run together, ``CELLS`` blocks of the longest length at most, or one page."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k][0])), key=lambda k: len(pages[k][0]))
        while order:
            # from the longest page on, so that it is the one that bounds its companions
            own = order[-max(1, CELLS // len(pages[order[-1]][0])) :]
            del order[-len(own) :]
            lengths = [len(pages[k][0]) for k in own]
            x = self._inputs([pages[k] for k in own])[0]
            z = self._logits(x, lengths)[0]
            at = 0
            for k, n in zip(own, lengths, strict=True):
                out[k] = _sigmoid(z[at : at + n])
                at += n
        return out

    def _padded(self, x: np.ndarray, lengths: list[int], reverse: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        time = np.concatenate([np.arange(n)[::-1] if reverse else np.arange(n) for n in lengths])
        page = np.repeat(np.arange(len(lengths)), lengths)
        out = np.zeros((max(lengths), len(lengths), x.shape[1]), np.float32)
        out[time, page] = x
        return out, time, page

    def _logits(self, x: np.ndarray, lengths: list[int], keep: bool = False) -> tuple:
        hidden, state = [], {}
        for d in "fb":
            padded, time, page = self._padded(x, lengths, d == "b")
            h, kept = self._run(padded, d, keep)
            hidden.append(h[time, page])
            state[d] = (padded, kept, time, page)
        joined = np.concatenate([*hidden, x], axis=1)
        return joined @ self.p["out"] + self.p["shift"][0], joined, state

    def fit(self, pages: list[tuple], labels: list[np.ndarray], sure: list[np.ndarray] | None = None, epochs: int = 10, batch: int = 16, rate: float = 6e-3, seed: int = 0) -> Labeller:
        """Adam on the cross-entropy of the labels; ``sure`` weighs the blocks, 0 for those whose label isn't known."""
        sure = sure or [np.ones(len(y), np.float32) for y in labels]
        rng = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                grads = self._gradients([pages[k] for k in own], np.concatenate([labels[k] for k in own]), np.concatenate([sure[k] for k in own]))
                t += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradients(self, pages: list[tuple], y: np.ndarray, sure: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        lengths = [len(p[0]) for p in pages]
        x, path_flat, path_owner, word_flat, word_owner = self._inputs(pages)
        z, joined, state = self._logits(x, lengths, keep=True)
        dz = ((_sigmoid(z) - y) * sure / len(y)).astype(np.float32)
        grads = {"out": joined.T @ dz + 1e-4 * self.p["out"], "shift": np.array([dz.sum()], np.float32)}
        dj = dz[:, None] * self.p["out"]
        dx = dj[:, 2 * HIDDEN :].copy()
        for j, d in enumerate("fb"):
            padded, kept, time, page = state[d]
            dh_out = np.zeros((padded.shape[0], padded.shape[1], HIDDEN), np.float32)
            dh_out[time, page] = dj[:, j * HIDDEN : (j + 1) * HIDDEN]
            dg_all = np.empty((*padded.shape[:2], 4 * HIDDEN), np.float32)
            dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
            dw = np.zeros_like(self.p[f"h{d}"])
            for k in range(len(kept) - 1, -1, -1):
                i, f, o, u, before, tc, h = kept[k]
                dh = dh + dh_out[k]
                dc = dc + dh * o * (1 - tc * tc)
                dg = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                dg_all[k] = dg
                dw += h.T @ dg
                dh, dc = dg @ self.p[f"h{d}"].T, dc * f
            flat = dg_all.reshape(-1, 4 * HIDDEN)
            grads |= {f"h{d}": dw, f"x{d}": padded.reshape(-1, padded.shape[2]).T @ flat, f"b{d}": flat.sum(axis=0)}
            dx += (flat @ self.p[f"x{d}"].T).reshape(padded.shape)[time, page]
        for name, flat, owner, part, mean in (("path", path_flat, path_owner, dx[:, :DEPTH], False), ("word", word_flat, word_owner, dx[:, DEPTH : 2 * DEPTH], True)):
            g = np.zeros_like(self.p[name])
            if mean and len(owner):
                part = part / np.maximum(np.bincount(owner, minlength=len(part)), 1)[:, None].astype(np.float32)
            np.add.at(g, flat, part[owner])
            grads[name] = g
        return grads


# --- training -------------------------------------------------------------------------

#: Tokens of a path by which pages say themselves what a block is: fixed values, for labelling the training pages only.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "head", "button", "select", "datalist", "template"} | {
    f".{x}" for x in "ad ads advert advertisement adverts banner breadcrumb breadcrumbs captcha comment comments consent contentinfo cookie cookies copyright dialog disqus discussion footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification notifications pagination pager popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar widget".split()
}
MAIN = {"article", "main", ".article", ".content", ".entry", ".post", ".main", ".story", ".body"}


#: Elements whose names are hidden in training.
_NAMED = {"article", "main", "section", "nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: A block text on so many training pages of a host, and on this share of them, belongs to the host and not to an article.
REPEATED_PAGES, REPEATED_SHARE = 3, 0.3
#: Share of linked characters from which, without names, a block is none of the article; words from which it is, if few are linked.
MOST_LINKED, LEAST_WORDS = 0.5, 12


def repeated(pages: list[tuple[str, list[Block]]]) -> dict[str, set[str]]:
    """Host -> the block texts that its pages repeat; pages of the same text are one."""
    pages = list({(h, tuple(b.text for b in p)): (h, p) for h, p in pages}.values())
    count, on = Counter(h for h, _ in pages), Counter((h, t) for h, p in pages for t in {b.text for b in p})
    out: dict[str, set[str]] = {}
    for (h, t), n in on.items():
        if n >= max(REPEATED_PAGES, REPEATED_SHARE * count[h]):
            out.setdefault(h, set()).add(t)
    return out


def labels_of(page: list[Block], host_texts: set[str] | frozenset[str] = frozenset()) -> tuple[np.ndarray, np.ndarray] | None:
    """(1 for blocks of the article, 1 for blocks whose label is sure), from names, repetition on the host's pages and links.

    Where a page names its article, that decides, but blocks of it that the host
    repeats or that are mostly links aren't sure. Where a page names
    none, text of some length with few links is the article, and
    named asides, linked and repeated texts are not; the rest is not sure. None if there is no sure block of the article.
    """
    named = any(MAIN & {*b.path} for b in page)
    y, sure = np.zeros(len(page), np.float32), np.ones(len(page), np.float32)
    for k, b in enumerate(page):
        main, aside, linked = bool(MAIN & {*b.path}), bool(ASIDE & {*b.path}), b.linked / max(len(b.text), 1)
        if aside or b.path[:1] == ("head",):
            continue
        if named:
            y[k] = main
            sure[k] = not (main and (linked > MOST_LINKED or b.text in host_texts))
        elif b.text in host_texts:
            continue
        elif linked <= MOST_LINKED:
            y[k] = sure[k] = len(b.text.split()) >= LEAST_WORDS and linked < 0.2
    return (y, sure) if (y * sure).any() else None


def hidden(page: list[Block], rng: random.Random) -> list[Block]:
    """The page without class names and, at random, without telling element names."""
    names = rng.random() < 0.5
    return [Block(b.text, tuple("div" if names and t in _NAMED else t for t in b.path if t[0] != "."), b.linked) for b in page]


def varied(page: list[Block], labels: np.ndarray, rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """The page's blocks dressed in other common page layouts, so that the labeller doesn't rest on one site's markup."""
    main = [b for b, y in zip(page, labels, strict=True) if y]
    rest = [b for b, y in zip(page, labels, strict=True) if not y] or main[:2]
    if not main:
        return page, labels
    root = rng.choice([("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".main", ".content", "article"), ("div", ".post", ".body"), ("section", ".story"), ("div", ".entry", ".content"), ("div", ".article", ".body"), ("div",)])
    frames = {
        "before": [("div", "ul", "li"), ("table", "tr", "td"), ("header",), ("div", ".header"), ("nav",), ("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("ul", ".nav", "li"), ("div", ".breadcrumbs"), ("div", ".cookie", ".notice"), ("div", ".banner"), ("header", "nav", "ul", "li"), ("div", ".skip")],
        "inside": [("div", "ul", "li"), ("div", ".ad"), ("div", ".ads"), ("div", ".advertisement"), ("aside",), ("aside", "p"), ("div", ".sponsored"), ("div", ".related", "ul", "li"), ("div", ".share"), ("div", ".newsletter", "form"), ("form",), ("div", ".promo", "p"), ("div", ".notice")],
        "after": [("div", "ul", "li"), ("table", "tr", "td"), ("footer",), ("footer", "p"), ("div", ".footer"), ("aside", ".sidebar"), ("div", ".sidebar", "p"), ("div", ".comments", "p"), ("section", ".comments", "div", ".comment", "p"), ("div", ".comment", "p"), ("ol", ".comment", ".list", "li", "p"), ("form", ".comment", ".form"), ("div", ".related", "a"), ("div", ".subscribe"), ("div", ".copyright"), ("div", ".widget", "ul", "li"), ("div", ".replies", "p"), ("section", ".discussion", "article", ".comment", "p")],
    }
    out: list[tuple[Block, float]] = []

    def add(place: str, base: tuple[str, ...], most: int) -> None:
        for _ in range(rng.randint(0, most)):
            path = ("html", "body", *base, *rng.choice(frames[place]))
            for _ in range(rng.randint(1, 4)):
                b = rng.choice(rest if rng.random() < 0.5 else main)
                words = b.text.split()
                text = " ".join(words[: rng.choice([1, 2, 3, 8, 20, 60])])
                # menus and tables without a name are made of links, or nothing tells them from lists of the article
                unnamed = path[-3:] in (("div", "ul", "li"), ("table", "tr", "td"))
                linked = len(text) if unnamed or any(t in ("nav", "li", "a") for t in path) and rng.random() < 0.8 else 0
                out.append((Block(text, path, linked), 0.0))

    inner = rng.choice([(), (), ("div",), ("section",)])
    add("before", (), 3)
    for k, b in enumerate(main):
        leaf = rng.choice([("p",), ("p",), ("p",), ("p", "b"), ("ul", "li"), ("ol", "li"), ("h2",), ("h3",), ("blockquote", "p"), ("pre",), ("table", "tr", "td")]) if k else rng.choice([("h1",), ("h2",), ("p",)])
        out.append((Block(b.text, ("html", "body", *root, *inner, *leaf), b.linked), 1.0))
        if rng.random() < 0.08:
            add("inside", root, 1)
    add("after", root if rng.random() < 0.3 else (), 2)
    add("after", (), 3)
    return [b for b, _ in out], np.array([y for _, y in out], np.float32)


def sample(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str | None = "url", most: int = TRAIN_PAGES) -> list[tuple[str, list[Block]]]:
    """(host, blocks) of ``most`` pages in the order of a hash of the id, of ``TRAIN_CHARS`` characters each at most."""
    host = F.regexp_extract(quoted(url_col), "//([^/?#]+)", 1) if url_col in pages.columns else F.lit("")
    some = pages.select(quoted(id_col).alias("i"), quoted(html_col).alias("h"), F.coalesce(host, F.lit("")).alias("u")).where(F.length("h").between(1, TRAIN_CHARS))
    some = by_hash(some, "i", most).withColumn("o", F.xxhash64("i"))
    return [(r["u"], blocks(r["h"])) for r in some.orderBy("o", "i", "h").limit(most).collect()]


def train(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str | None = "url", most: int = TRAIN_PAGES) -> Labeller:
    """A labeller fitted on :func:`sample`: each page as it is and in another layout, and both with its names hidden."""
    return fitted(sample(pages, html_col, id_col, url_col, most))


def fitted(pages: list[tuple[str, list[Block]]]) -> Labeller:
    rng, data, labels, sure = random.Random(0), [], [], []
    common = repeated(pages)
    for host, page in pages:
        found = labels_of(page, common.get(host, frozenset())) if page else None
        if found is None:
            continue
        y, known = found
        other, other_y = varied(page, y, rng)
        ones = np.ones(len(other), np.float32)
        # real pages count more than made-up layouts
        for p, t, k in ((page, y, 4 * known), (other, other_y, ones), (hidden(page, rng), y, 2 * known), (hidden(other, rng), other_y, ones)):
            if 0 < len(p) <= TRAIN_BLOCKS:
                data.append(features(p))
                labels.append(t)
                sure.append(k)
    for text in () if data else ("A first line.", "Another line of the text, somewhat longer than the first."):
        p, t = varied([Block(text, ("html", "body", "article", "p"), 0)] * 3, np.ones(3, np.float32), rng)
        data.append(features(p))
        labels.append(t)
        sure.append(np.ones(len(t), np.float32))
    return Labeller().fit(data, labels, sure)


def main_text(pages: list[str], labeller: Labeller, threshold: float = 0.5) -> list[str]:
    read = [blocks(p) if p else [] for p in pages]
    scores = labeller.scores([features(p) for p in read])
    return ["\n".join(b.text for b, s in zip(p, own, strict=True) if s >= threshold) if p else "" for p, own in zip(read, scores, strict=True)]


def _extract(packed, html_col: str, columns: list[str], text: str):
    kept: list[Labeller] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(pickle.loads(packed.value))  # noqa: S301  made by this driver
        for batch in slices(batches, html_col):
            texts = pa.array(main_text(batch.column(html_col).to_pylist(), kept[0]), pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text else batch.column(c) for c in columns], names=columns)

    return run


@any_names
def extracted(pages: DataFrame, labeller: Labeller, html_col: str = "html", text: str = "_text") -> DataFrame:
    """``pages`` with ``_text`` (a column of that name is replaced), the main text of each whole page: the blocks labelled as article, in page order, joined by a line end.

    Null and empty pages, and pages without a block of the article, give an empty text. Pages are read whole, some MB or one page at a
    time, and labelled together by like length; repeated rows are extracted each; an empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    out = pages.withColumn(text, F.lit("").cast("string"))
    return out.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(pickle.dumps(labeller)), html_col, out.columns, text), out.schema)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    labeller = train(pages)
    return extracted(pages.select("page_id", "url", "html"), labeller).select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
