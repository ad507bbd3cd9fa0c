"""HTML extraction: flat text blocks, classified by a small decision tree.

A page is cut into text blocks at the tags that break lines. A block has its number of words and its
link density (the share of its words within links), those of the blocks before and after it, whether
it is a heading, and three marks of what encloses it:

- place: an article or main element encloses it (1), or doesn't on a page that has one (-1), or the
  page has none (0);
- role: an element whose name says what it is (nav, footer, aside, dialog, a form, a header outside
  an article, something hidden);
- hint: a class or id that names page furniture in one of several languages, or a heading that opens
  the readers' comments. A hint holds for what it names, not for a layout that has such a part: words
  after ``has`` or ``with`` don't count, nor does the hint of an element that holds the article or,
  with the page's first heading, most of its unlinked words. The same goes for a form round a page.
  Names that say more than furniture (``legal-news``) give way to running text: enough unlinked words
  in long blocks. A word that readers' comments share with articles (``discussion``) needs support: a
  form, a time, a short line that asks for a reply or says when; a heading must say nothing else, and
  what it opens ends at the next heading of its level.

A decision tree, trained here on the blocks of the small labelled pages ``LABELLED``, says which
blocks are main text.

Markup is read leniently: scripts, styles, comments and the head are passed over; closing tags
without an opening one are ignored, and an element that is never closed ends with its parent. Reading
takes time in proportion to the page, whatever tags are left open or closed too often.

Cases: null and empty html, and pages without main text, give an empty text; blocks of one word
count like any other; very long pages are taken whole, in time that grows with their length; nothing
is capped; elements with ``hidden`` or ``display:none`` are furniture; rows that repeat give rows
that repeat, an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import map_batches, table

# Element names by role, and the beginnings of words in classes and ids that name page
# furniture, in English, German, Spanish and French.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PASSED_OVER = frozenset("script style noscript template svg math iframe object textarea select option title head canvas audio video".split())
_ROLE = frozenset("nav footer aside menu dialog button".split())
_FORM = frozenset("form fieldset".split())
_ARTICLE = frozenset("article main".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_COMMENTS = tuple("comment komment coment leserbrief disqus discussion diskussion discusion replies antworten respuestas".split())
_SHARED = tuple("discussion diskussion discusion replies antworten respuestas".split())  # with articles
_BESIDE = frozenset("a add all an and box block bottom container der die ein el eine einen footer inner item items join la las le leave left les link links list los main no of one outer post right section small text the title top un una und view wrapper write y your et".split())
_REPLY = re.compile(r"\b(?:reply|antworten|responder|répondre|posted|ago)\b|\bvor \d|\bhace \d|\bil y a\b|\b\d{1,2}[./:-]\d{2}\b", re.I)
_HEADER = tuple("header kopfzeile masthead".split())
_TITLE = frozenset("article beitrag content entry page post section story".split())
_NAMES = tuple(
    "advert anzeige werbung anuncio publici sponsor promo banner breadcrumb consent cookie datenschutz copyright disclaimer impressum legal footer fusszeile menu modal popup "
    "navbar navig newsletter notice pager pagin related verwandt relacionad login logout signup anmeld search suche buscar recherche teilen compartir partag sidebar seitenleiste "
    "skip social subscri suscri abonn toolbar widget privacy".split()
)
_WORDS = frozenset("ad ads nav aside form tags pie share shares sharing reply respond responses".split())
_LAYOUT = frozenset("has with no without hat mit con avec is js".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([!?/]?)([a-zA-Z][^\s/>]*|(?=[!?]))((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?(?=[\s"'/]|$)""", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in _PASSED_OVER}

#: Pages with a plus before each block of main text; ``{n}`` stands for n words. A blank line ends a page.
LABELLED = """
<nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><div class=ad>{9}</div><article><h1>+{8}</h1><p>+{95} <a>{2}</a></p><p>+{40}</p><p>+{1}</p><p>+{3}</p><p>+{120}</p></article><footer>{6}</footer>

<div><a>{4}</a></div><div><a>{3}</a></div><h1>+{6}</h1><p>+{60} <a>{3}</a></p><p>+{85}</p><p>+{30}</p><h2>+{2}</h2><p>+{110} <a>{6}</a></p><div><a>{5}</a></div><div>{4}</div><div><a>{3}</a></div>

<header><a>{2}</a><p>{4}</p></header><main><h1>+{2}</h1><p>+{1}</p><p>+<a>{2}</a></p><p>+<a>{14}</a></p><p>+{2}</p><div class=advert>{45}</div><section id=comments><h3>{1}</h3><p>{25}</p><p>{70} <a>{4}</a></p></section></main><div><a>{5}</a></div>

<nav><a>{30}</a></nav><div>{80}</div><div>{12}</div><article><p>+{7}</p><p>+{65}</p><p>+{50} <a>{1}</a></p></article><p>{35} <a>{2}</a></p><p><a>{9}</a></p><p>{50}</p>

<ul><li><a>{2}</a><li><a>{2}</a><li><a>{1}</a></ul><p>{5}</p><ul><li><a>{4}</a><li><a>{3}</a></ul><p>{2}</p>

<p>+{12}</p><p>+{48}</p><p>+{22}</p><p>+{75} <a>{5}</a></p><p>+{18}</p><p>+{90} <a>{8}</a></p><ul><li><a>{6}</a><li><a>{2}</a></ul><div class="newsletter">{17}</div><footer>{7}</footer>

<article><h1>+{5}</h1><p>+{60}</p><ul><li><a>{1}</a><li><a>{2}</a><li><a>{2}</a><li><a>{1}</a></ul><p>+{45}</p><p>+{3}</p></article><div>{60}</div><div>{20}</div>

<main><ul><li><a>{2}</a><li><a>{3}</a><li><a>{1}</a><li><a>{2}</a></ul><h1>+{4}</h1><p>+{30}</p><p>+{9}</p><h2>+{3}</h2><p>+{44}</p><aside><p>{33}</p><p><a>{6}</a></p></aside><div><a>{7}</a></div><div><a>{8}</a></div><div><a>{6}</a></div></main>

<form><div><a>{2}</a></div><div><a>{1}</a></div><article><h1>+{7}</h1><p>+{50}</p><p>+{50}</p></article><div>{8}</div></form>

<div class="layout has-sidebar"><article><h1>+{5}</h1><p>+{44}</p><p>+{70}</p><ul><li>+{5}<li>+{7}<li>+{3}</ul></article><div class=sidebar><p>{30}</p><p><a>{4}</a></p></div></div>

<div><h1>+{7}</h1><p>+{40} <a>{1}</a></p><p>+{55} <a>{2}</a></p><p>+{25}</p><div class=kommentare><p>{18}</p><p>{35}</p><p>{4}</p></div></div><div><a>{3}</a></div><div><a>{8}</a> {1}</div><div>{2}</div>

<div><a>{10}</a></div><h1>+{9}</h1><p>+{30}</p><p>+{100} <a>{10}</a></p><div><a>{14}</a> {2}</div><div><a>{4}</a></div><aside><p>{110}</p><p>{60}</p></aside>

<main><p>+{8}</p><p>+{60} <a>{1}</a></p><p>+{12}</p></main>

<article><h1>+{3}</h1><p>+{30}</p><p>+<a>{25}</a></p><p>+{30}</p><p>+<a>{50}</a></p></article>

<article><h1>+{3}</h1><p>+{30}</p><div class="related-posts"><a>{25}</a></div><p>+{30}</p><div class="related"><a>{50}</a></div></article>

<main><h1>+{3}</h1><p>+{60}</p><p>+<a>{50}</a></p></main>

<main><h1>+{3}</h1><p>+{60}</p><div class="promo"><a>{50}</a></div></main>

<main><h1>+{3}</h1><p>+{80}</p><p>+<a>{7}</a></p></main>

<main><h1>+{3}</h1><p>+{80}</p><div class="promo-links"><a>{7}</a></div></main>

<article><p>+{5}</p></article>

<h1>+{4}</h1><p>+{15}</p><p>+{40}</p><p>+{70} <a>{1}</a></p>

<p>+{25}</p>

<nav><a>{2}</a></nav><article><h1>+{9}</h1><p>+{1}</p></article><footer><p>{9}</p></footer>

<div><a>{1}</a></div><div><a>{2}</a></div><div><a>{1}</a></div><h2>+{6}</h2><p>+{33}</p><ul><li>+{8}<li>+{6}<li>+{9}</ul><p>+{27}</p><div>{3}</div><div><a>{2}</a></div><div><a>{2}</a></div>

<article><h1>+{5}</h1><p>+{20}</p><p>+<a>{6}</a></p><p>+{8}</p><p>+<a>{3}</a></p><p>+{60}</p><p>+<a>{12}</a></p><p>+{2}</p><p>+<a>{2}</a></p><p>+{30}</p></article>

<main><h1>+{2}</h1><p>+<a>{5}</a></p><p>+{4}</p><p>+<a>{1}</a></p><p>+{16}</p><p>+<a>{9}</a></p></main><p><a>{3}</a></p><p>{12}</p><p><a>{30}</a></p>

<h1>+{5}</h1><p>+{9}</p><p><a>{6}</a></p><p>+{14}</p><p>+{31}</p><p><a>{13}</a></p><p>+{50}</p><p><a>{3}</a></p>

<article><h1>+{3}</h1><ul><li><a>{3}</a><li><a>{12}</a><li><a>{7}</a></ul><p>+{45}</p><ul><li><a>{14}</a><li><a>{1}</a></ul><p>+{7}</p><p>+{1}</p></article><ul><li><a>{6}</a><li><a>{9}</a></ul>

<div><a>{2}</a></div><div><a>{1}</a></div><h1>+{4}</h1><div>+{5}</div><div>+{6}</div><div>+{14}</div><div>+{4}</div><div>+{60}</div><div>{1}</div><div><a>{2}</a></div><div><a>{3}</a></div>

<ul><li><a>{2}</a><li><a>{1}</a><li><a>{3}</a></ul><div>{4}</div><h1>+{3}</h1><p>+{12}</p><p>+{8}</p><h2>+{2}</h2><p>+{17}</p><h2>+{4}</h2><p>+{7}</p><div>{3}</div><div>{4}</div>

<div><a>{3}</a></div><h1>+{4}</h1><ul><li><a>{2}</a><li><a>{1}</a><li><a>{3}</a></ul><p>+{10}</p><h3>+{1}</h3><p>+{6}</p><div>{2}</div><div>{5}</div><div><a>{2}</a></div>

<article><h1>+{6}</h1><p>+{50}</p><p>+{6} <a>{3}</a></p><p>+<a>{5}</a></p><p>+{34}</p><blockquote>+{12}</blockquote><nav><ul><li><a>{3}</a><li><a>{2}</a></ul></nav><div class=share>{3}</div></article><article><h2>+{7}</h2><p>+{41}</p></article>
"""


#: Words of running text at least, of a block of it on average, and its share of links at most.
RUNNING, LONG, LINKED = 30, 12, 0.3


def _said(names: str) -> tuple[bool, int, int]:
    """Whether classes or an id name a header; furniture and readers' comments: 2, or 1 if they may name something else."""
    header, furniture, comments = False, 0, 0
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        named = other = 0
        for k, part in enumerate(parts):
            before = parts[k - 1] if k else ""
            if before in _LAYOUT:
                continue
            header |= part.startswith(_HEADER) and before not in _TITLE
            if part.startswith(_COMMENTS):
                comments = max(comments, 1 if part.startswith(_SHARED) else 2)
            elif part in _WORDS or part.startswith(_NAMES):
                named += 1
            elif len(part) > 1 and part not in _BESIDE and part not in _LAYOUT:
                other += 1
        if named:
            furniture = max(furniture, 1 if other and named < 2 else 2)
    return header, furniture, comments


def _opens_comments(heading: str) -> int:
    """2 if a heading says readers' comments and nothing else, 1 if it may be an article's own, else 0."""
    words = [w.lower() for w in _PART.findall(heading)]
    said = [w for w in words if w.startswith(_COMMENTS)]
    if not said or any(w not in said and w not in _BESIDE for w in words):
        return 0
    return 1 if all(w.startswith(_SHARED) for w in said) else 2


class Page:
    """The blocks of a page: ``texts``, ``counts`` (words, words in links), and their ``marks``."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.counts: list[tuple[int, int]] = []
        self.at: list[int] = []  # the element of each block
        self.heads: list[bool] = []
        # Elements in the order they open: parent, whether an article, role, form, header; hint and comments, 0 to 2.
        self.elements: list[tuple[int, bool, bool, bool, bool, int, int]] = [(0, *[False] * 4, 0, 0)]
        self.support: set[int] = set()  # elements with something that readers' comments have
        self.tops: set[int] = set()  # elements of the first heading
        self.read(page)

    def read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []
        parts: list[str] = []
        links, in_link, at = 0, False, 0
        opened: Counter = Counter()  # names on the stack
        endless: set[str] = set()  # names whose end has been looked for in vain
        shared: dict[int, tuple[int, int]] = {}  # what a heading opened that may be an article's: its level, and the element it is in

        def here() -> int:
            return stack[-1][1] if stack else 0

        def open_element(name: str, mark: tuple[bool, bool, bool, bool, int, int]) -> None:
            self.elements.append((here(), *mark))
            stack.append((name, len(self.elements) - 1))
            opened[name] += 1
            if name in _FORM or mark[-1] == 2:
                self.support.add(len(self.elements) - 1)

        def close() -> None:
            nonlocal parts, links
            text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
            if text:
                n = len(text.split())
                level = next((name for name, _ in reversed(stack[-2:]) if name in _HEADING), "")
                head = bool(level)
                outer = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in _HEADING), -1) if head else -1
                if outer >= 0 and (ended := shared.get(stack[outer][1])) and int(level[1]) <= ended[0]:
                    stack[outer] = (stack[outer][0], ended[1])
                    for k in range(outer + 1, len(stack)):  # the heading is no part of it
                        self.elements[stack[k][1]] = (ended[1], *self.elements[stack[k][1]][1:])
                self.texts.append(text)
                self.counts.append((n, min(links, n)))
                self.heads.append(head)
                self.at.append(here())
                if head and not self.tops:
                    self.tops.add(here())
                if not head and n <= 8 and _REPLY.search(text):
                    self.support.add(here())
                if head and n <= 6 and (kind := _opens_comments(text)):
                    # What follows in the heading's parent is the readers'.
                    element = stack[outer][1] if outer >= 0 else 0
                    self.elements.append((element, False, False, False, False, 0, kind))
                    new = len(self.elements) - 1
                    self.at[-1] = new
                    if kind == 1:
                        shared[new] = int(level[1]), element
                    if outer >= 0:
                        stack[outer] = (stack[outer][0], new)
                    else:
                        stack.insert(0, ("", new))
                        opened[""] += 1
            parts, links = [], 0

        def add(text: str) -> None:
            nonlocal links
            if text:
                parts.append(text)
                if in_link:
                    links += len(entities.unescape(text).split())

        while True:
            m = _TAG.search(page, at)
            if m is None:
                break
            add(page[at : m.start()])
            at = m.end()
            mark, name = m[1], (m[2] or "").lower()
            if not name or mark in ("!", "?"):
                continue
            if name in _PASSED_OVER:
                if mark != "/" and name not in endless and not m[3].rstrip().endswith("/"):
                    end = _END[name].search(page, at)
                    if end:
                        at = end.end()
                    elif name in ("script", "style"):
                        at = len(page)
                    else:
                        endless.add(name)
                continue
            if name in _INLINE:
                if name == "a":
                    in_link = mark != "/"
                elif name == "time":
                    self.support.add(here())
                continue
            close()
            if name in _VOID:
                continue
            if mark == "/":
                while opened[name]:  # what stands above it ends with it
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                in_link = False
            else:
                if name in ("p", "li") and stack and stack[-1][0] == name:
                    stack.pop()
                    opened[name] -= 1
                found = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _ATTRIBUTE.finditer(m[3])} if "=" in m[3] or "hidden" in m[3] else {}
                header, furniture, comments = _said(f"{found.get('class', '')} {found.get('id', '')}") if name not in ("html", "body") else (False, 0, 0)
                hidden = "hidden" in found or re.search(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", found.get("style", ""), re.I) is not None
                role = name in _ROLE or hidden or found.get("role", "").lower() in _ROLES
                open_element(name, (name in _ARTICLE or found.get("role", "").lower() in _ARTICLE, role, name in _FORM, name == "header" or header, furniture, comments))
        add(page[at:])
        close()

    def marks(self) -> list[tuple[int, bool, bool]]:
        """(place, role, hint) of each block."""
        n = len(self.elements)
        plain, holds, first = [0] * n, [e[1] for e in self.elements], [k in self.tops for k in range(n)]
        words, blocks, support = [0] * n, [0] * n, [k in self.support for k in range(n)]
        for k, (count, links) in zip(self.at, self.counts):
            plain[k] += count - links
            words[k] += count
            blocks[k] += 1
        for k in range(n - 1, 0, -1):  # parents open before their children
            up = self.elements[k][0]
            for sums in (plain, words, blocks):
                sums[up] += sums[k]
            holds[up] |= holds[k]
            first[up] |= first[k]
            support[up] |= support[k]
        place, role, hint = [0] * n, [False] * n, [False] * n
        for k in range(1, n):
            up, article, is_role, is_form, is_header, furniture, comments = self.elements[k]
            running = plain[k] >= RUNNING and words[k] >= LONG * blocks[k] and words[k] - plain[k] <= LINKED * words[k]
            is_comments = comments == 2 or comments == 1 and support[k]
            is_hint = furniture == 2 or furniture == 1 and not running or is_comments
            most = 2 * plain[k] >= plain[0]
            page = holds[k] and not article or (most and (first[k] or not self.tops) and not is_comments)
            place[k] = 1 if article and not role[up] and not hint[up] else place[up]
            role[k] = role[up] or is_role or (is_form and not page) or (is_header and place[up] != 1 and not holds[k])
            hint[k] = hint[up] or (is_hint and not page and not (article and not is_comments and plain[k] * 4 >= plain[0]))
        some = any(place[k] == 1 for k in self.at)
        return [(1 if place[k] == 1 else -some, role[k], hint[k]) for k in self.at]


def features(page: Page) -> np.ndarray:
    """Of the blocks of one page: words and link density of each, the one before, the one after; a heading; marks."""
    x = np.zeros((len(page.texts), 10))
    for k, ((words, links), head, marks) in enumerate(zip(page.counts, page.heads, page.marks())):
        x[k, :2] = words, links / words
        x[k, 6:] = head, *marks
    x[1:, 2:4] = x[:-1, :2]
    x[:-1, 4:6] = x[1:, :2]
    return x


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1):
        self.value = bool(y.mean() >= 0.5) if len(y) else False
        self.at: tuple[int, float] | None = None
        if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
            return
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                n = left.sum()
                if min(n, len(y) - n) < least:
                    continue
                p, q = y[left].mean(), y[~left].mean()
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, cut
        if best is None or best[0] > len(y) * self_impurity(y) - 1e-12:
            return
        self.at = best[1], float(best[2])
        left = x[:, best[1]] <= best[2]
        self.left, self.right = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.at is None:
            return np.full(len(x), self.value)
        left = x[:, self.at[0]] <= self.at[1]
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.left.predict(x[left]), self.right.predict(x[~left])
        return out


def self_impurity(y: np.ndarray) -> float:
    return float(y.mean() * (1 - y.mean()))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``LABELLED``."""
    x, y = [], []
    for text in LABELLED.strip().split("\n\n"):
        page = Page(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), text))
        x.append(features(page))
        y += [t.startswith("+") for t in page.texts]
    return np.concatenate(x), np.array(y, bool)


@lru_cache(maxsize=1)
def classifier() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None) -> str:
    found = Page(page or "")
    if not found.texts:
        return ""
    return "\n".join(t for t, k in zip(found.texts, classifier().predict(features(found))) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    rows = pages.select("page_id", "url", "html")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                b = batch.slice(k, 256)
                texts = [main_text(h) for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(rows, scan, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
