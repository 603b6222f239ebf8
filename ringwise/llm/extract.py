"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (text between block-level tags, in page order) with the tags, classes and ids of their
ancestors.  Words of a class or id that tell of a side part are not counted on the elements that hold the article itself
(``side_hints``).  Every block has binary features from its ancestors, its own text and its page position; the chain model
scores a label (other, main) for every block and every pair of neighbouring labels.  Training maximises the conditional
likelihood of labelled pages by gradient steps over all of them (forward-backward for the expected counts); pages are
decoded by Viterbi.  The main blocks, joined by empty lines, are the text.

Labelled pages are those that mark their article themselves (an ``article`` or ``main`` element): a block in it is main unless
one of its ancestors is a menu, header, footer, sidebar, notice, advert, form or comment list.  A bounded number of them
(the smallest hashes of page_id) is used, together with a few hand-labelled page layouts that show such parts inside and
outside of articles and pages without an article element.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwise.llm.arrow import mix

#: Labelled pages of the table that the model is fitted on, at most.
TRAIN_PAGES = 400
#: Feature buckets, gradient steps, step size, weight of the squared-norm penalty.
FEATURES, STEPS, RATE, PENALTY = 1 << 12, 120, 0.5, 1e-4

#: Elements that end a block, whose content is no text, and that have no content.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section "
                   "select summary table tbody td tfoot th thead title tr ul video audio canvas".split())
HIDDEN = frozenset("script style noscript template svg math iframe object textarea button title head select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class or id that tell what an element is.
HINTS = ("nav menu breadcrumb header masthead footer sidebar aside widget related promo advert ads ad sponsor banner cookie "
         "consent notice alert popup modal newsletter subscribe signup share social comment comments reply disqus form search "
         "login article content main post entry story body text").split()
_BAD = frozenset("nav header footer aside form menu dialog".split())
#: Parts of a class that name a state, as in has-sidebar or comments-closed: it tells of no side part.
_STATES = frozenset("no not has have with without hide closed open off disabled enabled".split())
_BAD_HINTS = frozenset("nav menu breadcrumb masthead footer sidebar aside widget related promo advert ads ad sponsor banner "
                       "cookie consent notice alert popup modal newsletter subscribe signup share social comment comments "
                       "reply disqus form search login".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CLOSES_P = BLOCKS - {"option", "legend", "summary"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


class Element:
    """An open element: hint words of its class, id and role, and those of them that are a whole class, id or role."""
    __slots__ = ("tag", "hints", "whole", "hidden", "size", "title")

    def __init__(self, tag: str, attrs: str):
        found, whole, self.hidden = set(), set(), False
        self.tag, self.size, self.title = tag, 0, False
        if attrs and "=" in attrs or "hidden" in attrs:
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id", "role"):
                    for token in value.split():
                        words = _WORD.findall(token)
                        found.update(w for w in words if w not in _BAD_HINTS or not _STATES.intersection(words))
                        whole.add(token)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(
                        r"display\s*:\s*none", value):
                    self.hidden = True
        self.hints, self.whole = frozenset(found.intersection(HINTS)), frozenset(whole.intersection(_BAD_HINTS))


class Block:
    __slots__ = ("text", "tags", "path", "hints", "link_chars", "hidden")

    def __init__(self, text, path, link_chars, hidden):
        self.text, self.path, self.link_chars, self.hidden = text, path, link_chars, hidden
        self.tags, self.hints = tuple(e.tag for e in path), frozenset()


def side_hints(blocks: list[Block]) -> None:
    """Set the hints of a page's blocks: the words of all ancestors, less the side-part words of the elements that hold the article.

    Those are html and body; on a page with article or main elements, the largest of them and its ancestors (one that is wholly
    called a side part, or lies in one, only counts as the article if it has half of the text); on another page, elements
    with half of the text and the title, whose words in compound names are taken off, as in content-sidebar-wrap.
    """
    total, titled, anchors = sum(len(b.text) for b in blocks), False, {}
    for b in blocks:
        title = "h1" in b.tags
        titled |= title
        for e in b.path:
            e.size += len(b.text)
            e.title |= title
        at = next((i for i, t in enumerate(b.tags) if t in ("article", "main")), None)
        if at is not None:
            anchors.setdefault(id(b.path[at]), b.path[:at + 1])
    holders = set()
    if anchors:
        side, path = min(((any(e.whole for e in p if e.tag not in ("html", "body")), p) for p in anchors.values()),
                         key=lambda x: (x[0], -x[1][-1].size))
        if not side or 2 * path[-1].size >= total:
            holders = {id(e) for e in path}
    own = {}

    def words(e: Element) -> frozenset[str]:
        if e.tag in ("html", "body") or id(e) in holders:
            return e.hints - _BAD_HINTS
        if not anchors and 2 * e.size >= total and e.title == titled:
            return (e.hints - _BAD_HINTS) | e.whole
        return e.hints

    for b in blocks:
        for e in b.path:
            if id(e) not in own:
                own[id(e)] = words(e)
        b.hints = frozenset().union(*(own[id(e)] for e in b.path))


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order.  Unclosed and misnested tags are mended as browsers roughly do: a block element ends an
    open paragraph, a list item the one before it, an end tag everything opened after its start tag."""
    stack: list[Element] = []
    out: list[Block] = []
    parts: list[str] = []
    links = 0
    in_link = 0
    at, n = 0, len(page)

    def flush():
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                hidden = any(e.hidden or e.tag in HIDDEN for e in stack)
                out.append(Block(text, tuple(stack), links, hidden))
            parts.clear()
        links = 0

    def pop_to(index: int):
        nonlocal in_link
        for e in stack[index:]:
            in_link -= e.tag == "a"
        del stack[index:]

    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            text = entities.unescape(page[at:end]) if "&" in page[at:end] else page[at:end]
            parts.append(text)
            if in_link:
                links += len(text)
        if not m:
            break
        at = max(m.end(), end + 1)
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                continue
            continue
        if m[1]:  # end tag
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if tag in BLOCKS:
                flush()
            if open_at is not None and (tag in BLOCKS or not any(e.tag in BLOCKS for e in stack[open_at + 1:])):
                pop_to(open_at)
            continue
        if tag in BLOCKS:
            flush()
            if tag in _CLOSES_P:
                p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p"), None)
                if p is not None:
                    pop_to(p)
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in same:
                        pop_to(i)
                        break
                    if stack[i].tag in ("ul", "ol", "dl", "table", "tbody", "thead", "select"):
                        break
        if tag == "br":
            parts.append(" ")
        if tag in VOID or m[3].endswith("/") and tag in ("path", "use", "circle"):
            continue
        if tag in _RAW_END:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else n
            continue
        stack.append(Element(tag, m[3]))
        in_link += tag == "a"
    flush()
    out = [b for b in out if not b.hidden]
    side_hints(out)
    return out


def self_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article; None if it does not."""
    if not any("article" in b.tags or "main" in b.tags for b in blocks):
        return None
    return [int(("article" in b.tags or "main" in b.tags) and not _BAD.intersection(b.tags)
                and not _BAD_HINTS.intersection(b.hints)) for b in blocks]


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the binary features of every block."""
    marked = any("article" in b.tags or "main" in b.tags for b in blocks)
    out = []
    for b in blocks:
        size = len(b.text)
        last = b.tags[-1] if b.tags else ""
        names = ["bias", f"own={last}", f"len={min(size.bit_length(), 11)}", f"marked={marked}"]
        names += [f"in={t}" for t in set(b.tags) if t not in ("html", "body", "b", "i", "em", "strong", "span", "font")]
        names += [f"is={h}" for h in b.hints]
        bad = bool(_BAD.intersection(b.tags) or _BAD_HINTS.intersection(b.hints))
        inside = "article" in b.tags or "main" in b.tags
        names += [f"bad={bad}", f"zone={marked}{inside}{bad}"]
        share = 4 * b.link_chars // max(1, size)
        names += [f"links={min(share, 4)}", f"stop={b.text[-1] in '.!?:;…”\"'}", f"words={min(b.text.count(' '), 12) // 4}"]
        if "©" in b.text or "copyright" in b.text[:40].lower():
            names.append("rights")
        out.append(names)
    return out


def _slots(names: list[str]) -> np.ndarray:
    codes = np.array([hash_name(x) for x in names], np.int64)
    return np.unique(codes)


_HELD: dict[str, int] = {}


def hash_name(name: str) -> int:
    got = _HELD.get(name)
    if got is None:
        h = np.uint64(1469598103934665603)
        for c in name.encode():
            h = mix(np.array([h ^ np.uint64(c)]))[0]
        got = int(h % np.uint64(FEATURES))
        if len(_HELD) < 100_000:
            _HELD[name] = got
    return got


class Chain:
    """Linear-chain conditional random field with two labels."""

    def __init__(self):
        self.weights = np.zeros((FEATURES, 2))
        self.moves = np.zeros((2, 2))
        self.first = np.zeros(2)

    def emissions(self, page: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum(axis=0) for x in page]).reshape(-1, 2)

    @staticmethod
    def _log_sum(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    def fit(self, pages: list[tuple[list[np.ndarray], list[int]]]) -> Chain:
        """Adaptive gradient ascent of the conditional log-likelihood; same data, same weights."""
        total = max(1, sum(len(y) for _, y in pages))
        sums = [np.full_like(p, 1e-8) for p in (self.weights, self.moves, self.first)]
        for _ in range(STEPS if pages else 0):
            grads = [np.zeros_like(p) for p in (self.weights, self.moves, self.first)]
            for x, y in pages:
                e = self.emissions(x)
                n = len(y)
                fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
                fwd[0] = self.first + e[0]
                for t in range(1, n):
                    fwd[t] = self._log_sum(fwd[t - 1][:, None] + self.moves, 0) + e[t]
                for t in range(n - 2, -1, -1):
                    bwd[t] = self._log_sum(self.moves + (e[t + 1] + bwd[t + 1])[None], 1)
                whole = self._log_sum(fwd[-1], 0)
                node = np.exp(fwd + bwd - whole)
                diff = -node
                diff[np.arange(n), y] += 1
                for slots, d in zip(x, diff):
                    grads[0][slots] += d
                for t in range(1, n):
                    grads[1] -= np.exp(fwd[t - 1][:, None] + self.moves + (e[t] + bwd[t])[None] - whole)
                    grads[1][y[t - 1], y[t]] += 1
                grads[2] += diff[0]
            for p, g, s in zip((self.weights, self.moves, self.first), grads, sums):
                g = g / total - PENALTY * p
                s += g * g
                p += RATE * g / np.sqrt(s)
        return self

    def decode(self, page: list[np.ndarray]) -> list[int]:
        """Viterbi: the most probable labels."""
        if not page:
            return []
        e = self.emissions(page).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = self.first[0] + e[0][0], self.first[1] + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            from0, from1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 >= b + m11 else 1)
            back.append((from0, from1))
            a, b = max(a + m00, b + m10) + e0, max(a + m01, b + m11) + e1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


#: Hand-labelled layouts: a page, and the texts of its main blocks.
LAYOUTS = [
    ("<body><header><h1>Daily site</h1><nav><a href=/>Home</a> <a href=/x>News</a></nav></header><main><h1>Rain in May</h1>"
     "<p>It rained for most of the month, more than in any year before.</p><p>Rivers rose.</p><aside><p>Read also: snow in "
     "June, a long story about it.</p></aside><p>The fields are wet, and sowing has to wait.</p></main><footer><p>© Daily "
     "site, all rights reserved.</p></footer></body>",
     ["Rain in May", "It rained for most of the month, more than in any year before.", "Rivers rose.",
      "The fields are wet, and sowing has to wait."]),
    ("<body><div class=menu><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div><div class=content><h2>On boats</h2><p>Boats "
     "are built of wood or steel, and some of both.</p><ul><li>Wood is light.</li><li>Steel lasts.</li></ul><p>Many sail on rivers."
     "</p></div><div id=sidebar><p>Popular posts of this week on our pages.</p></div><div class=footer>Contact us</div></body>",
     ["On boats", "Boats are built of wood or steel, and some of both.", "Wood is light.", "Steel lasts.", "Many sail on rivers."]),
    ("<body><div class=cookie-notice><p>We use cookies to make this site better for you.</p></div><nav><a href=/>Start</a></nav>"
     "<article><header><h1>Old maps</h1></header><p>Maps of the coast were drawn by sailors.</p><div class=ad><p>Buy our new atlas "
     "today, it is cheap.</p></div><p>They were copied by hand.</p><form><p>Write your name here to get letters.</p></form>"
     "<blockquote>North is up.</blockquote></article><section class=comments><h2>Comments</h2><p>I like these maps very much, thank "
     "you.</p><p>So do I.</p></section><footer><p>Imprint</p></footer></body>",
     ["Maps of the coast were drawn by sailors.", "They were copied by hand.", "North is up."]),
    ("<body><nav><ul><li><a href=/1>One</a></li></ul></nav><article><h1>Bread</h1><p>Flour, water and salt are mixed and left to rise."
     "</p><table><tr><td>Flour</td><td>500 g</td></tr></table><p>Bake it hot.</p><div class=comments><p>Mine did not rise at all, what "
     "did I do wrong?</p></div></article><div class=newsletter><p>Get our recipes every week by mail.</p></div></body>",
     ["Bread", "Flour, water and salt are mixed and left to rise.", "Flour", "500 g", "Bake it hot."]),
    ("<body><h1>Notes on moss</h1><p>Moss grows where it is damp and where there is shade.</p><p>It has no roots.</p><hr><div "
     "class=share><a href=/s>Share</a></div><div class=related><p>More about ferns and where they grow.</p></div></body>",
     ["Notes on moss", "Moss grows where it is damp and where there is shade.", "It has no roots."]),
    ("<body><div role=banner class=notice><p>This site will be closed on Monday for work on it.</p></div><div class=post><p>We walked "
     "along the shore the whole day.</p><p>In the evening it grew cold.</p></div><div class=sidebar><ul><li><a href=/o>Older</a></li>"
     "</ul></div></body>", ["We walked along the shore the whole day.", "In the evening it grew cold."]),
    ("<html class=menu-ready><body class=\"has-sidebar ads-free\"><div class=content-sidebar-wrap><main class=no-ads><h1>On salt</h1><p>Salt "
     "was won from the sea and from the hills.</p><p>It was dear.</p></main><div class=sidebar><p>Read more of what we wrote "
     "on pepper.</p></div></div><div class=footer-widgets><p>Write to us whenever you like.</p></div></body></html>",
     ["On salt", "Salt was won from the sea and from the hills.", "It was dear."]),
    ("<body class=\"page sidebar-right\"><div id=menu><a href=/>Home</a></div><div class=content-sidebar-wrap><div class=content><h1>On "
     "tin</h1><p>Tin was dug in the west, and ships took it to the south.</p><p>Few mines are left.</p></div><div class=sidebar><p>Our "
     "other pages of this week.</p></div></div></body>",
     ["On tin", "Tin was dug in the west, and ships took it to the south.", "Few mines are left."]),
]


def train(pages: DataFrame) -> Chain:
    """Fit on the hand-labelled layouts and at most TRAIN_PAGES pages of ``pages(page_id, html)`` that mark their article."""
    sample = (pages.where("html rlike '(?i)<(article|main)'").select("page_id", "html")
              .orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(TRAIN_PAGES))
    data = []
    # only feature numbers and labels travel, not the pages
    rows = sample.mapInArrow(_labelled, "slots array<array<int>>, labels array<int>").toArrow()
    for slots, labels in zip(rows.column("slots").to_pylist(), rows.column("labels").to_pylist()):
        data.append(([np.array(s) for s in slots], labels))
    for page, main in LAYOUTS:
        blocks = leaf_blocks(page)
        item = ([_slots(f) for f in features(blocks)], [int(b.text in main) for b in blocks])
        data += [item] * max(1, len(data) // (4 * len(LAYOUTS)))
    return Chain().fit([d for d in data if d[1]])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, labels = [], []
        for page in batch.column("html"):
            blocks = leaf_blocks(page.as_py())
            found = self_labels(blocks)
            if found:
                slots.append([_slots(f).tolist() for f in features(blocks)])
                labels.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.list_(pa.list_(pa.int32()))),
                                          pa.array(labels, pa.list_(pa.int32()))], names=["slots", "labels"])


def main_text(page: str, model: Chain) -> str:
    blocks = leaf_blocks(page)
    labels = model.decode([_slots(f) for f in features(blocks)])
    return "\n\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, text, n_chars`` (code points).

    Null and empty html give an empty text.  Every page is decoded whole; repeated rows are answered each; other columns
    are ignored.  With an empty table only the layouts train the model.
    """
    model = model or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [main_text(p.as_py() or "", model) for p in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
