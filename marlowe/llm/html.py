"""Main-text extraction from HTML: a linear-chain conditional random field over a page's leaf blocks.

A leaf block is the text between two block-level boundaries. Its features are its tag, its ancestors' tags, the words
in their class, id and role attributes, its part, and the look of its text. A part is the nearest ancestor that says
something: one with a tag of its own meaning or with a known word, so that plain wrappers of any depth change nothing.
The two labels, article and rest, form a chain in page order, whose moves depend on whether two blocks share their part.
Weights are fitted by stochastic gradient ascent on the log-likelihood of labelled pages; the best labelling of a page
comes from Viterbi's algorithm. ``labelled_pages`` makes training pages in many layouts, seeded.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.llm import common

#: Fixed values of the HTML standard: elements without end tags, with raw text, whose content a browser doesn't show
#: as text, and with inline layout (MathML's included).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HIDDEN = frozenset("noscript template svg select datalist audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark object output picture q rp rt ruby s samp slot small span strike strong sub sup time tt u var".split()) | frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split())
#: Start tags that end an open p; for others the elements that they end, and where the search for these stops.
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu", "table", "td", "th", "section", "article", "aside", "nav", "main", "header", "footer", "form", "blockquote", "figure")} | dict.fromkeys(("dt", "dd"), ("dl", "table", "td", "th", "section", "article", "aside", "nav", "main", "header", "footer", "form", "blockquote", "figure")) | dict.fromkeys(("tr", "td", "th"), ("table",))
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
SELF_CLOSED = re.compile(r"""(?:\A|[\s"'])/\Z""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Tags that say what a part of a page is.
PARTS = frozenset("article main aside nav footer header form button dialog".split())
#: Words in class, id and role attributes of labelled pages, by what they mark.
NAMES = {
    "body": "article content post entry story main text body article-body post-content entry-content main-content story-body page-content articleText blog-post single hentry prose copy richtext news markdown".split(),
    "menu": "nav menu navbar main-nav site-nav breadcrumb breadcrumbs topnav navigation menu-list tabs pagination pager links toc dropdown submenu skip".split(),
    "header": "header site-header masthead top-bar branding logo page-header topbar banner-top site-title tagline banner top".split(),
    "footer": "footer site-footer bottom copyright legal foot footer-links colophon page-footer credits contentinfo imprint".split(),
    "side": "sidebar side aside widget related recommended popular trending more-stories right-rail rail secondary related-posts see-also author-bio complementary teaser archive tags".split(),
    "notice": "cookie cookie-notice consent gdpr notice banner alert popup modal overlay cookie-banner privacy-notice disclaimer message toast paywall dialog cookies announcement warning".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promoted ad-slot banner-ad adsbygoogle dfp commercial partner promotion ad-container adv advertising outbrain taboola".split(),
    "form": "form search search-form newsletter subscribe signup login contact-form subscribe-box register subscription signin".split(),
    "comments": "comments comment comment-list commentlist responses discussion replies reader-comments comment-body disqus user-comments feedback reply respond".split(),
    "share": "share social sharing social-links share-buttons follow tools actions sharebar".split(),
}
#: Words of plain wrappers in labelled pages; not features.
NEUTRAL = "container wrapper wrap inner outer row col grid box block layout clearfix column columns cell holder region group page site app root".split()


@dataclass
class Block:
    text: str
    tag: str
    own: tuple[str, ...]
    part: tuple[str, ...]  # its tag and marks
    outer: tuple[str, ...]  # of the part around that
    place: int  # which part
    above: frozenset[str]
    linked: float


class Open:
    """The open elements of a page, with what a block under them needs; each step takes time for what it opens or ends."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.seen: list[tuple] = [("", (), ("",), ("",), 0, frozenset())]  # tag, own marks, part, outer, its number, ancestors' features
        self.at: dict[str, list[int]] = {}
        self.parts = 0

    def push(self, name: str, own: tuple[str, ...]) -> None:
        _, _, part, outer, place, above = self.seen[-1]
        if name in PARTS or own:
            self.parts += 1
            part, outer, place = (name, *own), part, self.parts
        new = {x for x in (f"a:{name}", *own) if x not in above}
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.seen.append((name, own, part, outer, place, above | new if new else above))

    def cut(self, k: int) -> None:
        """Ends the elements from the k-th on."""
        while len(self.names) > k:
            self.at[self.names.pop()].pop()
            self.seen.pop()

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, character references decoded and white space made single."""
    out: list[Block] = []
    opened, text = Open(), []
    links, in_link = 0, 0
    if not page:
        return out

    def end_block() -> None:
        nonlocal links
        words = " ".join(html_lib.unescape("".join(text)).split())
        text.clear()
        if words:
            tag, own, part, outer, place, above = opened.seen[-1]
            out.append(Block(words, tag, own, part, outer, place, above, min(1.0, links / max(1, len(words)))))
        links = 0

    at = 0
    for start, stop, closing, name, attributes in iter_tags(page):
        piece = page[at:start]
        at = stop
        if piece:
            text.append(piece)
            links += len(piece) if in_link else 0
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if closing else 1
            continue
        if name in VOID and name != "hr":
            if name == "br":
                text.append(" ")
            continue
        end_block()
        if closing:
            in_link = 0
            if name not in ("html", "body") and opened.at.get(name):
                opened.cut(opened.at[name][-1])
            continue
        if name in ENDS_P and opened.names and opened.names[-1] == "p":
            opened.cut(len(opened.names) - 1)
        if name in VOID or name in ("html", "head", "body"):
            continue
        if name in CLOSES:
            k = opened.last(CLOSES[name][:1]) if name == "tr" and opened.last(("tr",)) > opened.last(SCOPES["tr"]) else opened.last(CLOSES[name])
            if k > opened.last(SCOPES.get(name, ())):
                opened.cut(k)
        opened.push(name, marks(attributes) if attributes else ())
    text.append(page[at:])
    end_block()
    return out


def iter_tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of tags and comments (no name).

    Raw-text elements come with their content as one comment and, if they aren't closed, end with the page, as the
    standard has it. Hidden elements do so up to their first end tag; one without an end tag hides nothing.
    """
    at, endless = 0, set()
    while m := TAG.search(page, at):
        name = (m[2] or m[5] or "").lower()
        closing, stop = bool(m[1] or m[4]), m.end()
        if name in RAW or name in HIDDEN:
            if not closing and name not in endless and not (name == "svg" and SELF_CLOSED.search(m[3] or m[6] or "")):
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, stop)
                stop = end.end() if end else len(page) if name in RAW else stop
                endless |= set() if end else {name}
            yield m.start(), stop, False, "", ""
        else:
            yield m.start(), stop, closing, name, m[3] or m[6] or ""
        at = stop


def words_of(names: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(names)]


KNOWN = frozenset(w for names in NAMES.values() for n in names for w in words_of(n)) - frozenset(NEUTRAL)


def marks(attributes: str) -> tuple[str, ...]:
    """The known words of class, id and role."""
    return tuple(dict.fromkeys(f"c:{w}" for m in ATTRIBUTE.finditer(attributes) for w in words_of(m[2] or m[3] or m[4] or "") if w in KNOWN))


def features(page: list[Block]) -> list[tuple[frozenset[str], list[str]]]:
    """Names of the features of each block: those of its ancestors, and the others."""
    out = []
    for b in page:
        words = b.text.count(" ") + 1
        size = next((k for k, most in enumerate((2, 5, 10, 20, 40, 80)) if words <= most), 6)
        link = 0 if b.linked == 0 else 1 if b.linked < 0.5 else 2
        out.append((b.above, ["bias", f"t:{b.tag}", f"tp:{b.tag},{b.part[0]}", *(f"o{x}" for x in b.own), f"n:{b.part[0]}", *(f"n{x}" for x in b.part[1:]), f"p:{b.outer[0]}>{b.part[0]}", *(f"p{x}>{b.part[0]}" for x in b.outer[1:]), *(f"p{b.outer[0]}>{x}" for x in b.part[1:]), f"w:{size}", f"l:{link}", f"wl:{size},{link}", f"e:{b.text[-1] in '.!?:;\"»”'}", f"s:{'©' in b.text or '(c)' in b.text.lower()}"]))
    return out


def same_part(page: list[Block]) -> list[int]:
    """For each block but the first: 1 if its part is that of the one before."""
    return [int(a.place == b.place) for a, b in zip(page, page[1:], strict=False)]


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # features x 2
    moves: np.ndarray  # part left or kept x 2 x 2
    ends: np.ndarray  # 2 x 2: first and last block

    def scores(self, page: list[Block]) -> np.ndarray:
        get, known = self.index.get, {}

        def total(names) -> np.ndarray:
            return self.weights[[k for k in map(get, names) if k is not None]].sum(axis=0)

        out = np.empty((len(page), 2))
        for i, (above, own) in enumerate(features(page)):
            if above not in known:
                known[above] = total(sorted(above))
            out[i] = known[above] + total(own)
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi; of equal scores label 0 wins."""
        if not page:
            return []
        local = self.scores(page).tolist()
        moves = self.moves.tolist()
        a, b = local[0][0] + self.ends[0, 0], local[0][1] + self.ends[0, 1]
        back = []
        for (x0, x1), k in zip(local[1:], same_part(page), strict=True):
            (m00, m01), (m10, m11) = moves[k]
            f0, f1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((int(f0), int(f1)))
            a, b = (b + m10 if f0 else a + m00) + x0, (b + m11 if f1 else a + m01) + x1
        y = int(b + self.ends[1, 1] > a + self.ends[1, 0])
        out = [y]
        for step in reversed(back):
            y = step[y]
            out.append(y)
        return out[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], *, epochs: int = 6, rate: float = 0.15, l2: float = 1e-4, rare: int = 5, seed: int = 0) -> Model:
    """Stochastic gradient ascent on the chain's log-likelihood, by forward and backward sums.

    Features on fewer than ``rare`` pages are left out; the weights are the means over the later half of the epochs' ends.
    """
    named = [([above | set(own) for above, own in features(page)], same_part(page), y) for page, y in pages if page]
    seen_on = Counter(f for page, _, _ in named for f in set().union(*page))
    names = sorted(f for f, n in seen_on.items() if n >= rare)
    model = Model({f: i for i, f in enumerate(names)}, np.zeros((len(names), 2)), np.zeros((2, 2, 2)), np.zeros((2, 2)))
    coded = [([np.array([model.index[f] for f in sorted(block) if f in model.index], np.int64) for block in page], np.array(same, np.int64), np.array(y)) for page, same, y in named]
    rng = np.random.default_rng(seed)
    sums = [np.zeros_like(x) for x in (model.weights, model.moves, model.ends)]
    for epoch in range(epochs):
        lr = rate / (1 + epoch)
        if epoch >= epochs // 2:
            for total, x in zip(sums, (model.weights, model.moves, model.ends), strict=True):
                total += x
        for k in rng.permutation(len(coded)):
            page, same, y = coded[k]
            n = len(page)
            local = np.array([model.weights[at].sum(axis=0) for at in page])
            local[0] += model.ends[0]
            local[-1] += model.ends[1]
            moves = model.moves[same]
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = local[0]
            for i in range(1, n):
                ahead[i] = np.logaddexp(ahead[i - 1, 0] + moves[i - 1, 0], ahead[i - 1, 1] + moves[i - 1, 1]) + local[i]
            for i in range(n - 2, -1, -1):
                x = behind[i + 1] + local[i + 1]
                behind[i] = np.logaddexp(moves[i, :, 0] + x[0], moves[i, :, 1] + x[1])
            total = np.logaddexp(ahead[-1, 0], ahead[-1, 1])
            gain = np.eye(2)[y] - np.exp(ahead + behind - total)
            if n > 1:
                pair = np.exp(ahead[:-1, :, None] + moves + (local[1:] + behind[1:])[:, None, :] - total)
                seen = np.zeros((2, 2, 2))
                np.add.at(seen, (same, y[:-1], y[1:]), 1)
                np.subtract.at(seen, same, pair)
                model.moves += lr * seen / n
            model.ends[0] += lr * gain[0] * 0.5
            model.ends[1] += lr * gain[-1] * 0.5
            for at, g in zip(page, gain, strict=True):
                model.weights[at] += lr * (g - l2 * model.weights[at])
    for total, x in zip(sums, (model.weights, model.moves, model.ends), strict=True):
        x[:] = (x + total) / (1 + epochs - epochs // 2)
    return model


class Layout:
    """Writes one labelled page: its HTML in ``out``, (block text, 1 for the article else 0) in ``truth``."""

    SYLLABLES = "an ber cor del en fir gon hul in jo ka lem mi nor os pra qui res sta tur un ver wil xo ya ze".split()

    def __init__(self, rng: Random) -> None:
        self.rng, self.out, self.truth = rng, [], []
        self.closes = rng.random() < 0.7

    def word(self) -> str:
        return "".join(self.rng.choices(self.SYLLABLES, k=self.rng.randint(1, 4)))

    def sentence(self, low: int, high: int, dot: str = ".") -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize() + dot

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence(3, 18) for _ in range(self.rng.randint(1, most)))

    def attr(self, kind: str, chance: float = 1.0) -> str:
        """A class or id of the kind's names, with other words at times."""
        rng = self.rng
        if rng.random() >= chance:
            return ""
        names = [rng.choice(NAMES[kind])] + ([self.word()] if rng.random() < 0.3 else []) + ([rng.choice(NEUTRAL)] if rng.random() < 0.2 else [])
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(names)}"'

    def put(self, tag: str, text: str, y: int, inner: str | None = None, attrs: str = "") -> None:
        end = f"</{tag}>" if tag not in ("p", "li") or self.closes or self.rng.random() < 0.5 else ""
        self.out.append(f"<{tag}{attrs}>{text if inner is None else inner}{end}")
        self.truth.append((text, y))

    @contextmanager
    def within(self, tag: str, attrs: str = ""):
        self.out.append(f"<{tag}{attrs}>")
        yield
        self.out.append(f"</{tag}>")

    @contextmanager
    def plain(self, most: int = 6):
        """0 to ``most`` wrappers that say nothing, a table's cell among them at times."""
        rng, ends = self.rng, []
        for _ in range(rng.choice([0, 0, rng.randint(0, most)])):
            if rng.random() < 0.08:
                self.out.append("<table><tr><td>")
                ends.append("</td></tr></table>")
                continue
            tag = rng.choice(["div", "div", "div", "section"])
            name = rng.random()
            self.out.append(f'<{tag}{f" class={chr(34)}{rng.choice(NEUTRAL)}{chr(34)}" if name < 0.4 else f" id={self.word()}" if name < 0.6 else ""}>')
            ends.append(f"</{tag}>")
        yield
        self.out.extend(reversed(ends))

    def menu(self, tag: str, kind: str = "menu") -> None:
        rng = self.rng
        with self.plain(2), self.within(tag, self.attr(kind, 0.3 if tag in ("nav", "footer", "aside") else 1)), self.plain(2):
            if rng.random() < 0.3:
                self.put(rng.choice(["h2", "h3", "h4", "p"]), self.sentence(1, 3, ""), 0)
            leaf = rng.choice(["li", "li", "li", "div", "p", "dd", "td"])
            with self.within({"li": rng.choice(["ul", "ol"]), "dd": "dl", "td": "table"}.get(leaf, "div")):
                for _ in range(rng.randint(2, 7)):
                    t = self.word() if rng.random() < 0.6 else self.sentence(1, 4, "")
                    self.put(leaf, t, 0, f'<a href="/{self.word()}">{t}</a>' if rng.random() < 0.85 else None)

    def boiler(self, kind: str) -> None:
        rng = self.rng
        tag = {"header": "header", "footer": "footer", "side": "aside", "form": "form", "notice": "dialog"}.get(kind)
        named = bool(tag) and rng.random() < (0.15 if kind == "notice" else 0.6)
        tag = tag if named else rng.choice(["div", "section", "div", "div", "div", "div", "td"])
        leaves = ["p", "div", "h3", "h2", "h4", "li", "p", "div"] if kind != "comments" else ["p", "div", "li", "p", "h3", "blockquote"]
        with self.plain(2):
            self.out.append(f"<!-- {kind} {self.word()} -->")
            with self.within("table") if tag == "td" else self.plain(0), self.within(tag, self.attr(kind, 0.35 if named else 1)), self.plain(4):
                if kind == "header" and rng.random() < 0.5:
                    self.put(rng.choice(["h1", "h1", "div", "p"]), self.sentence(1, 5, ""), 0)
                for _ in range(rng.randint(1, 5) if kind in ("comments", "side") else rng.randint(1, 3)):
                    t = self.prose(4) if kind in ("comments", "notice", "advert", "side") and rng.random() < 0.6 else self.sentence(1, 6, rng.choice(["", "."]))
                    t = f"© {self.word()} {t}" if kind == "footer" and rng.random() < 0.7 else t
                    inner = f'<a href="#">{t}</a>' if kind in ("share", "advert", "side") and rng.random() < 0.4 else t.replace("©", "&copy;")
                    inside = rng.random()  # parts of a rest may bear names or tags of articles
                    tag = "article" if inside < (0.2 if kind in ("comments", "side") else 0.03) else "div"
                    with self.plain(2), self.within(tag, self.attr("body", 0.3 if tag == "article" else 1)) if tag == "article" or inside > 0.85 else self.plain(0):
                        self.put("button" if kind in ("form", "notice", "share") and rng.random() < 0.3 else rng.choice(leaves), t, 0, inner, self.attr("comments", 0.4) if kind == "comments" else "")
                if kind == "form":
                    self.out.append('<input type="text">')

    def heading(self, title: str) -> None:
        with self.plain(2):
            if self.rng.random() < 0.25:
                with self.within("header"):
                    self.put(self.rng.choice(["h1", "h1", "h2"]), title, 1)
            else:
                self.put(self.rng.choice(["h1", "h1", "h1", "h2"]), title, 1)

    def item(self) -> None:
        """One element of the article, or something that interrupts it."""
        rng, kind = self.rng, self.rng.random()
        if kind < 0.62:
            t = self.prose()
            look = rng.random()
            self.put("p" if rng.random() < 0.85 else "div", t, 1, f"<b>{t}</b>" if look < 0.1 else f"<b>{t}<br>" if look < 0.15 else f'<a href="/">{t[:12]}</a>{t[12:]}' if look < 0.25 else None)
        elif kind < 0.70:
            self.put(rng.choice(["h2", "h3", "h4"]), self.sentence(1, 7, ""), 1)
        elif kind < 0.77:
            with self.within(rng.choice(["ul", "ol"])):
                for _ in range(rng.randint(1, 5)):
                    t = self.sentence(1, 12, rng.choice(["", "."]))
                    self.put("li", t, 1, f'<a href="/">{t}</a>' if rng.random() < 0.1 else None)
        elif kind < 0.79:
            with self.within("table"):
                for _ in range(rng.randint(1, 3)):
                    with self.within("tr"):
                        for _ in range(rng.randint(1, 4)):
                            self.put(rng.choice(["td", "td", "th"]), self.sentence(1, 5, ""), 1)
        elif kind < 0.81:
            with self.within("dl"):
                for _ in range(rng.randint(1, 3)):
                    self.put("dt", self.sentence(1, 3, ""), 1)
                    self.put("dd", self.sentence(2, 12), 1)
        elif kind < 0.84:
            with self.within("figure"):
                self.out.append('<img src="x.png">')
                self.put("figcaption", self.sentence(2, 12, rng.choice(["", "."])), 1)
        elif kind < 0.88:
            self.put(rng.choice(["blockquote", "pre"]), self.prose(2), 1)
        elif kind < 0.90:
            with self.within("blockquote"):
                self.put("p", self.prose(2), 1)
        elif kind < 0.93:
            self.put("p", self.word().capitalize() + ".", 1)
        else:
            self.boiler(rng.choice(["advert", "share", "notice", "side", "form"]))

    def article(self, title: str) -> None:
        """Heading and items in a container that says so, or in none; plain wrappers around and inside."""
        rng = self.rng
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td", "", ""])
        around = rng.choice(["", "", "", "main", "div", "article"])
        with self.plain(3), self.within(around, self.attr("body", 0 if around != "div" else 1) + (' role="main"' if around == "main" and rng.random() < 0.3 else "")) if around else self.plain(0), self.plain(3):
            if tag == "td":
                self.out.append("<table><tr>")
            with self.within(tag, self.attr("body", {"article": 0.3, "main": 0.3, "td": 0.5}.get(tag, 1))) if tag else self.plain(0), self.plain(6):
                if rng.random() < 0.85:
                    self.heading(title)
                with self.plain(4), self.within("div", self.attr("body")) if rng.random() < 0.2 else self.plain(0):
                    for _ in range(rng.randint(1, 14)):
                        with self.plain(2 if rng.random() < 0.25 else 0):
                            self.item()
                if rng.random() < 0.15:
                    self.boiler("comments")
            if tag == "td":
                self.out.append("</tr></table>")
            if rng.random() < 0.15:
                self.boiler("comments")

    def page(self) -> None:
        rng = self.rng
        title = self.sentence(2, 14, rng.choice(["", "."]))
        self.out.append(f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var x='<p>{self.word()}</p>';</script></head><body>")
        if rng.random() < 0.1:
            with self.plain(3):  # nothing but text
                for _ in range(rng.randint(1, 6)):
                    self.put(rng.choice(["p", "p", "p", "div"]), self.prose(), 1)
            return
        with self.plain(3), self.within("div", self.attr("body")) if rng.random() < 0.2 else self.plain(0):
            for kind in rng.sample(["header", "menu", "notice", "advert", "form", "side"], rng.randint(0, 4)):
                self.menu(rng.choice(["nav", "nav", "div"])) if kind == "menu" else self.boiler(kind)
            self.article(title)
            for kind in rng.sample(["comments", "side", "advert", "share", "form", "menu", "notice"], rng.randint(0, 4)):
                self.menu(rng.choice(["aside", "div", "nav"]), "side") if kind == "menu" else self.boiler(kind)
            if rng.random() < 0.8:
                self.menu("footer", "footer") if rng.random() < 0.3 else self.boiler("footer")
        self.out.append("</body></html>" if rng.random() < 0.8 else "")


def labelled_pages(n: int = 1200, seed: int = 0) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, 1 for the article else 0)]) in many layouts, with invented words."""
    rng = Random(seed)
    for _ in range(n):
        page = Layout(rng)
        page.page()
        yield "".join(page.out), page.truth


def training_set(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of labelled pages; a page whose blocks don't parse back to its parts would be an error."""
    out = []
    for page, truth in labelled_pages(n, seed):
        found = blocks(page)
        if [b.text for b in found] != [" ".join(t.split()) for t, _ in truth]:
            raise ValueError("a labelled page has other blocks than its labels say")
        out.append((found, [y for _, y in truth]))
    return out


def train(pages: int = 1200, seed: int = 0) -> Model:
    return fit(training_set(pages, seed), seed=seed)


def extract(page: str | None, model: Model) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, model.decode(found), strict=True) if y)


def main_text(pages: DataFrame, model: Model, *, html_col: str = "html", new: str = "main_text") -> DataFrame:
    """Appends the main text to every row: its article blocks, one a line; "" for null and empty pages and those without.

    Pages are parsed whole at any length and depth, in time in proportion to both. Cut-off tags, comments and raw-text
    elements end with the page. Rows stand alone: repeated ones get the same text, an empty table stays empty, other
    columns pass through, and an input that has ``new`` already (in any case) is a ValueError.
    """
    if any(c.lower() == new.lower() for c in pages.columns):
        raise ValueError(f"the input already has {new}")
    held = pages.sparkSession.sparkContext.broadcast(model)  # weights of the labelled pages' features, whatever the corpus
    return common.per_text(pages, html_col, [(new, T.StringType())], lambda texts: [pa.array([extract(t, held.value) for t in texts], pa.string())])
