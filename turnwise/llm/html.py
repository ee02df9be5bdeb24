"""Main-text extraction: a linear-chain CRF labels a page's leaf blocks by their ancestor tags and texts."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Elements that don't end a block of text, elements without content, and elements whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg math head title iframe object select textarea canvas audio video".split())
#: An element of the key's kind ends an open one of these kinds.
CLOSED_BY = {"p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
STARTS_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("article aside blockquote body button div footer form header html li main nav ol section table td th ul".split())
CONTENT = frozenset({"article", "main"})
#: Words that are frequent in what surrounds an article, by kind, in English, German, French and Spanish.
CUES = {
    "note": "cookie cookies consent newsletter subscribe zustimmen abonnieren abonnez consentement suscríbete consentimiento",
    "ad": "advertisement advert sponsored anzeige werbung gesponsert publicité sponsorisé publicidad anuncio patrocinado",
    "foot": "copyright imprint rights privacy terms impressum datenschutz mentions légales confidentialité derechos privacidad",
    "said": "comment comments reply replies kommentar kommentare antworten commentaire commentaires répondre comentario comentarios responder",
    "side": "related trending popular ähnliche beliebt similaires populaires relacionados populares",
    "form": "search login password email suche anmelden passwort recherche connexion buscar contraseña",
    "share": "share tweet facebook teilen partager compartir",
    "menu": "home menu contact startseite menü kontakt accueil inicio contacto",
}
#: Words that hold sentences together, in the same languages.
GLUE = frozenset("the of and to in is that for it as was with on by der die das und ist den mit von zu ein eine nicht auf le la les et des que est un une dans pour el los las y en una por con del se".split())
_LETTERS = re.compile(r"[^\W\d_]+")
BITS = 16
PAGES, SEED, ROUNDS, L2 = 600, 5, 120, 1e-3
_WORDS = re.compile(r"[a-z0-9]+")


class Block(NamedTuple):
    """A leaf block: its text, its place in the page's tree of block elements, and the slots of its own features."""

    text: str
    node: int
    own: tuple[int, ...]


class _Blocks(HTMLParser):
    """Leaf blocks of a page in order, and the tree of its block elements.

    A node holds its parent and the feature slots that its element adds to those of its ancestors, so a block's ancestor
    features are those on its way to the root. What is open is kept with counts and places by tag: no step looks at more
    of the open elements than it closes, and time is linear in the page however deep it nests.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.nodes: list[tuple[int, tuple[int, ...]]] = [(-1, (_slot("bias"),))]
        self.open: list[tuple[str, int, int, tuple[int, ...]]] = []  # tag, node, place of the nearest block element, slots
        self.places: dict[str, list[int]] = {}  # of the open block elements of a tag
        self.scopes: list[int] = []
        self.names: list[str] = []
        self.inline: dict[tuple[str, int], int] = {}
        self.active: dict[int, int] = {}
        self.text: list[str] = []
        self.hidden = self.links = self.linked = self.contents = self.titles = 0
        self.contents_seen = False

    def end_block(self) -> None:
        if self.text:
            t = " ".join("".join(self.text).split())
            if t:
                self.blocks.append(Block(t, self.open[-1][1] if self.open else 0, _own_slots(t, self.names[-3:], min(1.0, self.linked / len(t)), self.titles > 0)))
            self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag not in INLINE:
                self.end_block()
            return
        node, base = (self.open[-1][1], self.open[-1][2]) if self.open else (0, -1)
        if tag in INLINE:
            self.inline[tag, base] = self.inline.get((tag, base), 0) + 1
            self.open.append((tag, node, base, ()))
            self.links += tag == "a"
            return
        self.end_block()
        if self.hidden:
            self.close_hidden(tag)
        self.close_implied(tag)
        words = []
        if attrs:
            words = _WORDS.findall(" ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label")).lower())
            if any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs):
                words.append("hidden")
        if tag in CONTENT and not self.contents:
            self.contents_seen = True
        self.contents += tag in CONTENT
        self.titles += tag == "h1"
        slots = (_common_slots if len(words) < 10 else _element_slots)(tag, tuple(words), self.contents > 0)
        new = tuple(x for x in slots if not self.active.get(x))
        for x in slots:
            self.active[x] = self.active.get(x, 0) + 1
        place = len(self.open)
        self.nodes.append((self.open[-1][1] if self.open else 0, new))
        self.open.append((tag, len(self.nodes) - 1, place, slots))
        self.places.setdefault(tag, []).append(place)
        self.names.append(tag)
        if tag in SCOPES:
            self.scopes.append(place)
        self.hidden += tag in HIDDEN

    def place(self, tag: str) -> int:
        """Of the innermost open element of a block tag; -1: none is open."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def close_hidden(self, tag: str) -> None:
        """Ends elements without text whose end tag is left out: the head before the body or content, drawings and lists of choices before content."""
        inner = self.open[-1][0]
        head, drawing, choice = self.place("head"), max(self.place("svg"), self.place("math")), self.place("select")
        if head >= 0 and (tag == "body" or (tag in STARTS_BLOCK and inner in ("head", "title"))):
            self.leave(head)
        elif drawing >= 0 and tag in STARTS_BLOCK and self.place("foreignobject") < drawing:
            self.leave(drawing)
        elif choice >= 0 and tag in STARTS_BLOCK and tag != "hr":
            self.leave(choice)

    def close_implied(self, tag: str) -> None:
        closes = CLOSED_BY.get(tag) or (CLOSED_BY["p"] if tag in STARTS_BLOCK else ())
        while closes:
            k = max(self.place(t) for t in closes)
            if k < 0 or (self.scopes and self.scopes[-1] > k):
                return
            self.leave(k)
            if tag in STARTS_BLOCK:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def leave(self, k: int) -> None:
        """Closes the open elements from place k on."""
        while len(self.open) > k:
            tag, _, base, slots = self.open.pop()
            if tag in INLINE:
                self.inline[tag, base] -= 1
                self.links -= tag == "a"
                continue
            self.places[tag].pop()
            self.names.pop()
            if tag in SCOPES:
                self.scopes.pop()
            self.hidden -= tag in HIDDEN
            self.contents -= tag in CONTENT
            for x in slots:
                self.active[x] -= 1

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.end_block()
            return
        if tag in INLINE:
            if self.open and self.inline.get((tag, self.open[-1][2])):
                k = len(self.open) - 1
                while self.open[k][0] != tag:
                    k -= 1
                self.leave(k)
            return
        self.end_block()
        if (k := self.place(tag)) >= 0:
            self.leave(k)

    def handle_data(self, data):
        if self.hidden and self.open[-1][0] == "head" and data.strip():
            self.leave(len(self.open) - 1)
        if not self.hidden and data:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


_MARKUP = re.compile("<[a-zA-Z/!?]")


def parse(html: str | None) -> _Blocks:
    """A page's blocks. What the page breaks off inside is left out: a tag without an end, a comment without an end up to its next ``>``.

    A tag has no end only if its quote has none in all that follows, so there is at most one for each kind of quote: few rounds.
    """
    p, rest = _Blocks(), html or ""
    while True:
        p.feed(rest)
        rest, end = p.rawdata, p.rawdata.find(">")
        if p.cdata_elem or not _MARKUP.match(rest):
            break
        p.rawdata, comment, rest = "", rest.startswith("<!--"), rest[end + 1 :] if end >= 0 else ""
        if comment:
            rest = rest.replace("<!--", "<!")  # none of them has an end
    if p.cdata_elem:
        p.rawdata = ""
    p.close()
    p.end_block()
    if p.contents_seen:  # what stands outside is told apart from pages without such an element
        p.nodes[0] = (-1, (*p.nodes[0][1], _slot("content somewhere")))
    return p


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def _element_slots(tag: str, words: tuple[str, ...], inside: bool) -> tuple[int, ...]:
    """Slots that an open element gives the blocks in it."""
    names = [f"in:{tag}", *(f"class:{w}" for w in words), *(f"{tag}.{w}" for w in words), *((f"content>{tag}", "content") if inside else ())]
    return tuple(set(map(_slot, names)))


_common_slots = lru_cache(maxsize=5000)(_element_slots)


@lru_cache(maxsize=5000)
def _near_slots(names: tuple[str, ...]) -> tuple[int, ...]:
    return tuple(map(_slot, ["pair:" + ">".join(names[-2:]), *(f"up{k}:{tag}" for k, tag in enumerate(reversed(names)))]))


_LENGTH = [_slot(f"len:{k}") for k in range(9)]
_COUNT = [_slot(f"words:{k}") for k in range(7)]
_LINKED = [_slot(f"link:{k}") for k in range(5)]
_ENDS, _SIGN, _BARS = _slot("ends"), _slot("sign"), _slot("bars")
_CUE = {w: (_slot(f"cue:{kind}"), _slot(f"cues:{kind}")) for kind, words in CUES.items() for w in words.split()}
_CUES = [_slot(f"cue words:{k}") for k in range(3)]
_SENTENCES = [_slot(f"sentences:{k}") for k in range(4)]
_GLUE = [_slot(f"glue:{k}") for k in range(5)]
_TITLED = [_slot("before title"), _slot("after title")]
_STOPS = re.compile(r"[.!?…。](?:\s|$)")
#: Words for each cue word at most where cue words are many; elsewhere they count for less.
CUE_WORDS = 20


def _own_slots(text: str, names: list[str], linked: float, titled: bool) -> tuple[int, ...]:
    """Slots of what a block shows itself: its nearest ancestors, length, links, signs, sentences and the words that hold them together, cue words by how dense they are, and whether a title came."""
    n, words = len(text), _LETTERS.findall(text.lower())
    own = [*_near_slots(tuple(names)), _LENGTH[min(8, n.bit_length())], _LINKED[int(linked * 4)], _COUNT[min(6, (text.count(" ") + 1).bit_length())], _TITLED[titled]]
    own.append(_SENTENCES[min(3, sum(1 for _ in _STOPS.finditer(text)))])
    if len(words) > 3:
        own.append(_GLUE[min(4, 10 * sum(w in GLUE for w in words) // len(words))])
    if text[-1] in ".!?…。":
        own.append(_ENDS)
    if text[0] in "©®":
        own.append(_SIGN)
    if text.count("|") + text.count("·") + text.count("»") > 1:
        own.append(_BARS)
    cues = [w for w in words if w in _CUE]
    if cues:
        own.append(_CUES[min(3, len(cues)) - 1])
        own += {_CUE[w][CUE_WORDS * len(cues) >= len(words)] for w in cues}
    return tuple(own)


def slots_of(page: _Blocks) -> list[list[int]]:
    """All feature slots of each block of a page: its ancestors' and its own."""
    out = []
    for b in page.blocks:
        slots, k = list(b.own), b.node
        while k >= 0:
            k, new = page.nodes[k]
            slots += new
        out.append(slots)
    return out


# ---- labelled pages -------------------------------------------------------------------------------------------------

_SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo wu xa ye zi".split()
_CHROME = {
    "menu": ("nav", "ul.menu", "div.navbar", "div#navigation", "ul.breadcrumb", "div.tabs"),
    "head": ("header", "div.header", "div#masthead", "div.site-header", "div.topbar"),
    "foot": ("footer", "div.footer", "div#footer", "div.copyright", "div.site-footer"),
    "side": ("aside", "div.sidebar", "div#sidebar", "div.related", "div.widget", "aside.sidebar", "section.related", "div.recommended"),
    "note": ("div.cookie-banner", "div.notice", "div.consent", "div.popup", "div.modal", "div.newsletter", "div.alert", "section.notice", "div.cookie", "dialog", "div.subscribe", "div.paywall"),
    "ad": ("div.ad", "div.ads", "div.advert", "div.sponsored", "aside.ad", "div.banner", "div.promo", "ins.adsbygoogle", "div.advertisement", "section.sponsored"),
    "form": ("form", "form.search", "form.login", "div.search-form"),
    "said": ("section.comments", "div.comments", "div#comments", "ol.commentlist", "div.comment", "section#comments", "div.discussion", "div.replies"),
    "share": ("div.share", "ul.social", "div.toolbar", "div.tags", "div.byline", "div.meta", "ul.pagination"),
}
#: Words that classes and ids of anything may have.
_NEUTRAL = "text page inner main wrapper container column center row block box area left right wide grid body".split()
_BODY = ("article", "main", "article", "main>article", "div.content>article", "div.article-body", "div#content", "div.post", "div.entry-content", "section.story", "article>div.body", "article>section")


def _tags(spec: str) -> tuple[str, str]:
    """Start and end tags of nested elements such as ``div.a>div#b``; none for an empty text."""
    start, end = "", ""
    for one in spec.split(">") if spec else ():
        tag, _, cls = one.partition(".")
        tag, _, ident = tag.partition("#")
        start += f"<{tag}" + (f' class="{cls}"' if cls else "") + (f' id="{ident}"' if ident else "") + ">"
        end = f"</{tag}>" + end
    return start, end


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A made-up page and for each of its leaf blocks whether it belongs to the main text. Words are noise but for cues, which half of what surrounds the article has and its own blocks have now and then."""
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    glued = lambda a, b, p: " ".join(rng.choice(glue) if rng.random() < p else word() for _ in range(rng.randint(a, b)))
    glue, held = sorted(GLUE), rng.choice((0.0, 0.2, 0.35, 0.5))
    sentence = lambda: glued(1, 25, held).capitalize() + rng.choice(("", ".", ".", ",", " |"))
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 8))))
    story = lambda: " ".join(glued(5, 25, held).capitalize() + rng.choice((".", ".", ".", "?", "")) for _ in range(rng.choice((1, 2, 3, 4, 8))))
    name = lambda: rng.choice((rng.choice(_NEUTRAL), word()))

    def plain_box() -> str:
        return rng.choice(("", "div", "div", "section", "div>div", "table>tr>td", f"div.{name()}", f"div#{name()}", f"div.{name()}>div.{name()}", f"section.{name()}"))


    def cued(kind: str, text: str, p: float, most: int = 4) -> str:
        """The text, at that probability with up to so many cue words of a kind in it."""
        if rng.random() >= p:
            return text
        parts = text.split(" ")
        for _ in range(rng.randint(1, most)):
            parts.insert(rng.choice((0, rng.randint(0, len(parts)))), rng.choice(CUES.get(kind, CUES["menu"]).split()))
        return " ".join(parts).capitalize()

    out, gold = [], []

    def put(html: str, label: int | None) -> None:
        out.append(html)
        if label is not None:
            gold.append(label)

    def chrome(kind: str) -> None:
        plain = rng.random() < 0.2  # told by its words alone
        start, end = _tags(rng.choice(("div", "section", "div>div", f"div.{name()}")) if plain else rng.choice(_CHROME[kind]))
        cue = 1.0 if plain else 0.5
        put(start, None)
        form = kind == "menu" or rng.random() < 0.3
        if form and kind not in ("ad", "note"):
            put("<ul>", None)
            for _ in range(rng.randint(1, 7)):
                put(f'<li><a href="/{word()}">{cued(kind, words(1, 3), 0.2 + 0.8 * plain)}</a></li>', 0)
            put("</ul>", None)
        elif kind == "form":
            put(f"<label>{words(1, 3)}</label><input name=q><button>{word()}</button>", None)
            gold.extend([0, 0])
        elif rng.random() < 0.4:
            put(rng.choice(("&copy; ", "")) + cued(kind, prose(), cue), 0)
        else:
            for _ in range(rng.randint(1, 4)):
                tag = rng.choice(("p", "div", "h3", "p", "span"))
                if tag == "span":
                    put(f"<div><span>{cued(kind, words(1, 3), cue)}</span> {prose()}</div>", 0)
                else:
                    put(f"<{tag}>{cued(kind, prose(), cue)}</{tag}>", 0)
        put(end, None)

    def content(tell) -> None:
        tag = rng.choice(("p", "p", "div"))
        for _ in range(rng.choice((1, 2, 4, 8, 12))):
            kind = rng.random()
            if kind < 0.62:
                bold = rng.choice(("", "b", ""))
                put(f"<{tag}>{bold and f'<{bold}>'}{cued(rng.choice(tuple(CUES)), tell(), 0.06, 1)}", 1)
                if tag == "div" or rng.random() < 0.7:
                    put(f"{bold and tag == 'div' and '</b>' or ''}</{tag}>", None)
                elif rng.random() < 0.5:
                    put(f"<br>{tell()}", 1)
            elif kind < 0.68:
                put(f"<h2>{words(1, 8)}</h2>", 1)
            elif kind < 0.73:
                put("<ul>", None)
                for _ in range(rng.randint(1, 5)):
                    put(f"<li>{prose()}</li>", 1)
                put("</ul>", None)
            elif kind < 0.77:
                put(f"<blockquote><p>{prose()}</p></blockquote>", 1)
            elif kind < 0.80:
                put(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", None)
                gold.extend([1, 1])
            elif kind < 0.82:
                put(f"<pre>{words(2, 9)}</pre>", 1)
            elif kind < 0.85:
                put(f"<figure><img src=x><figcaption>{words(2, 9)}</figcaption></figure>", 1)
            elif kind < 0.88:
                put(f'<p><a href="/{word()}">{words(2, 9)}</a></p>', 1)
            elif kind < 0.92:
                put(f"<div>{tell()}</div>", 1)
            elif bare:
                continue
            else:
                chrome(rng.choice(("ad", "ad", "note", "side", "form", "share", "menu", "said")))

    put('<!DOCTYPE html><html><head><meta charset="utf-8"><title>t</title><style>p{margin:0}</style>' + rng.choice(("</head><body>", "</head><body>", "<body>", "</head>")), None)
    bare, known = rng.random() < 0.08, rng.random() < 0.5
    box, unbox = _tags(rng.choice((f"div.{name()}", f"div#{name()}", "div")) if rng.random() < 0.3 else "")
    put(box, None)
    for kind in ("note", "head", "menu", "ad", "side", "form"):
        if rng.random() < 0.6 and not bare:
            chrome(kind)
    start, end = _tags(rng.choice(_BODY) if known else plain_box())
    put(start, None)
    if rng.random() < 0.7:
        put(rng.choice(("<h1>{}</h1>", "<h1><span>{}</span></h1>", "<header><h1>{}</h1></header>")).format(words(1, 10)), 1)
    content(prose if known else story)
    if rng.random() < 0.2 and not bare:
        chrome("said")
    if rng.random() < 0.9:
        put(end, None)
    for kind in ("share", "said", "side", "ad", "note", "menu", "foot"):
        if rng.random() < 0.6 and not bare:
            chrome(kind)
    put(unbox, None)
    if rng.random() < 0.9:
        put("</body></html>", None)
    return "".join(out), gold


# ---- the chain ------------------------------------------------------------------------------------------------------


#: Weights are summed as whole numbers of this unit, so that a sum doesn't depend on the order of its parts.
UNIT = 1 << 20


class Crf:
    """Two labels: weights[slot, label] for what a block shows, moves[from, to] between blocks."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self.lead = np.rint((weights[:, 1] - weights[:, 0]) * UNIT).astype(np.int64).tolist()
        self.step = np.rint(moves * UNIT).astype(np.int64).tolist()

    def leads(self, page: _Blocks) -> list[int]:
        """By how much each block's features speak for main text: a node's sum is its parent's and that of what it adds."""
        at, sums = self.lead.__getitem__, []
        for parent, new in page.nodes:
            sums.append((sums[parent] if parent >= 0 else 0) + sum(map(at, new)))
        return [sums[b.node] + sum(map(at, b.own)) for b in page.blocks]

    def labels(self, leads: list[int]) -> list[int]:
        """Viterbi. Only score differences between the labels matter, so one number a block is enough."""
        (aa, ab), (ba, bb) = self.step
        back, a, b = [], 0, 0
        for k, e in enumerate(leads):
            if k:
                from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
                back.append((0 if from_a else 1, 0 if from_b else 1))
                a, b = (a + aa if from_a else b + ba), (a + ab if from_b else b + bb) + e
            else:
                b = e
        out = [0 if a >= b else 1] if leads else []
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train_crf(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, l2: float = L2) -> Crf:
    """Maximises the regularised conditional log-likelihood by adaptive gradient steps; all pages pass forward and backward together, padded to the longest."""
    size, n = 1 << BITS, len(pages)
    longest = max(len(y) for _, y in pages)
    live = np.zeros((n, longest), dtype=bool)
    gold = np.zeros((n, longest), dtype=np.int64)
    row, slot = [], []
    for p, (seq, y) in enumerate(pages):
        live[p, : len(y)] = True
        gold[p, : len(y)] = y
        for t, slots in enumerate(seq):
            row += [p * longest + t] * len(slots)
            slot += slots
    row, slot = np.array(row), np.array(slot)
    used, slot = np.unique(slot, return_inverse=True)
    w, m = np.zeros((len(used), 2)), np.zeros((2, 2))
    w2, m2 = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
    seen = np.stack([np.bincount(slot, weights=(gold.ravel()[row] == k), minlength=len(used)) for k in (0, 1)], axis=1)
    pairs = live[:, 1:]
    moved = np.array([[np.sum(pairs & (gold[:, :-1] == i) & (gold[:, 1:] == j)) for j in (0, 1)] for i in (0, 1)], dtype=float)
    for _ in range(rounds):
        e = np.stack([np.bincount(row, weights=w[slot, k], minlength=n * longest).reshape(n, longest) for k in (0, 1)], axis=2)
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + m[None], axis=1) + e[:, t]
            fwd[:, t] = np.where(live[:, t, None], step, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(m[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(live[:, t + 1, None], step, 0.0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        prob = np.exp(fwd + bwd - z[:, None, None]) * live[:, :, None]
        expected = np.stack([np.bincount(slot, weights=prob[:, :, k].ravel()[row], minlength=len(used)) for k in (0, 1)], axis=1)
        both = np.exp(fwd[:, :-1, :, None] + m[None, None] + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        for x, x2, g in ((w, w2, (seen - expected) / n - l2 * w), (m, m2, (moved - both.sum(axis=(0, 1))) / n - l2 * m)):
            x2 += g * g
            x += 0.5 * g / np.sqrt(x2)
    weights = np.zeros((size, 2))
    weights[used] = w
    return Crf(weights, m)


@lru_cache(maxsize=2)
def model(pages: int = PAGES, seed: int = SEED) -> Crf:
    """The CRF trained on ``pages`` labelled pages of the given seed; a process trains it once."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < pages:
        html, gold = labelled_page(rng)
        page = parse(html)
        if gold and len(page.blocks) == len(gold):
            rows.append((slots_of(page), gold))
    return train_crf(rows)


def main_text(html: str | None, crf: Crf) -> str:
    """Texts of the blocks labelled main text, in page order, joined by one space."""
    page = parse(html)
    return " ".join(b.text for b, k in zip(page.blocks, crf.labels(crf.leads(page))) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) per row.

    Whole pages are parsed leniently: open elements, left-out end tags, cut-off ends and stray tags do no harm, and time is
    linear in a page's length and nesting. Null and empty pages and
    pages without main text give an empty text and 0. Keys and urls pass unchanged, nulls and repeats too; other columns
    don't matter. An empty table gives no rows. No shuffle: a page is parsed, labelled and decoded where it is read.
    """
    spark = pages.sparkSession
    ship(spark)
    crf = spark.sparkContext.broadcast((model().weights[:, 1] - model().weights[:, 0], model().moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, moves = crf.value
        own = Crf(np.stack([np.zeros_like(lead), lead], axis=1), moves)
        for b in batches:
            texts = [main_text(t.as_py(), own) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
