"""The main text of web pages: the maximum-scoring contiguous region of a page's words and tags.

A page is cut into a sequence of tags and runs of words. A run of k words scores k
times the weight of its context, the tags and class words of the elements that
enclose it (the DEPTH innermost, each counting a quarter of the one inside it);
a tag scores its own weight, never above 0. One linear scan finds the
contiguous region of the largest sum. Blocks that the region touches make the text.

Weights come from labelled pages: those that mark their text with one article
element, from which words and tags inside and outside are counted. A context's
weight is the sum of the log-odds of its features, limited to +-LIMIT; what no
labelled page has scores UNKNOWN_WORD and UNKNOWN_TAG. article and main themselves
are no features, so the weights serve pages that have neither; where words stand
inside one, they score INSIDE at least, and blocks of a page whose region meets
such elements are those of these elements: their ends are the text's ends.

Elements that are never main text (navigation, forms, asides, scripts, those whose
class, id or role names an advert, notice or comment) count as a single tag in the
scan, so that one in the middle of an article does not end it, and give no text.

Counting runs over at most about max_pages labelled pages, those of least hash, a
documented bound; the text is cut from every whole page. Per page the work is
linear in its length, and a task holds one batch of pages.

Defined results: a null or empty page, and one without a region, has an empty text;
character references are decoded, also without their semicolon where HTML allows
it; white space inside a block, line breaks too, becomes one space; blocks are
joined by one \\n; a cut-off tag or comment at the end is markup; unclosed elements
end where their parent does; null ids and urls are kept, repeated pages too, and
pages of any length are whole; an empty table has no rows; other columns play no
part, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LIMIT, INSIDE, UNKNOWN_WORD, UNKNOWN_TAG = 4.0, 4.0, 0.5, -1.0
#: Added to every count of a feature, and the fewest labelled pages that a feature must stand on.
PRIOR, MIN_PAGES = 1.0, 3
#: Enclosing elements that make a context.
DEPTH = 6

# Fixed values of the HTML standard: elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SECTIONS = frozenset(["article", "main"])
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCKS - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "body", "head", "html", "title"}
# Elements, roles and words of class and id that mark what is not main text.
NOISE_TAGS = frozenset("aside button canvas dialog embed footer form head iframe input menu nav noembed noframes noscript object script search select style svg template textarea title xmp".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
#: Once a page has an attribute whose quotes don't end, and for a tag that is cut off.
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
OPENS = re.compile(r"<(?=/?[A-Za-z])")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[a-z]+|[0-9]+")
NEGATED = frozenset(["has", "no", "with", "without", "is", "non"])


@dataclass(slots=True)
class Element:
    name: str
    context: tuple[frozenset[str], ...]  # features, innermost element first
    noise: bool
    section: int  # number of the outermost article or main element, 0 outside
    inline: bool


@dataclass(slots=True)
class Run:
    """Words of one text between two tags."""

    text: str
    words: int
    block: int
    element: Element


@dataclass(slots=True)
class Page:
    tokens: list[Run | str] = field(default_factory=list)  # a str is a tag's name
    inside: list[bool] = field(default_factory=list)  # in an article or main element, by token
    articles: int = 0


def attributes(name: str, text: str) -> tuple[frozenset[str], bool]:
    """The features of an element, and whether it is no main text."""
    features, noise = {name}, name in NOISE_TAGS
    for key, *values in ATTRIBUTE.findall(text) if text else ():
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            for part in value.split():
                words = NAME_WORD.findall(part)
                features.update(f"{name}.{w}" for w in words)
                noise |= bool(NOISE_WORDS.intersection(words)) and not NEGATED.intersection(words) and name not in ("html", "body", "main")
        elif key == "role":
            noise |= value in NOISE_ROLES
        elif key in ("hidden", "aria-hidden", "style"):
            noise |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    return frozenset(features - {"html", "body", *SECTIONS}), noise


def tags_of(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Begin, end, "/" or "", name and attributes of every tag; comments and declarations have no name. Raw text is skipped over."""
    at, pattern, size = 0, TAG, len(page)
    while at < size:
        m = pattern.search(page, at)
        if pattern is TAG and (o := OPENS.search(page, at, m.start() if m else size)):  # a tag that TAG can't end
            pattern = PLAIN_TAG
            m = pattern.match(page, o.start())
        if not m:
            return
        name = (m[2] or "").lower()
        yield m.start(), m.end(), m[1] or "", name, m[3] or ""
        at = m.end()
        if name in RAW and not m[1]:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else size
            yield at, at, "raw", name, ""


def parse(page: str) -> Page:
    """Tags and runs of words in order; text of elements that are no main text is left out, each of them is one tag."""
    out, block, sections = Page(), 0, 0
    stack = [Element("", (), False, 0, False)]
    at = 0
    for begin, end, slash, name, attrs in tags_of(page):
        top = stack[-1]
        if begin > at and slash != "raw":
            add(out, page[at:begin], block, top)
        at = end
        if slash == "raw" or not name:
            continue
        if name == "br":
            if out.tokens and not top.noise:
                add(out, " ", block, top)
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if name not in BLOCKS and not stack[k].inline:
                    break
        else:
            if name in ENDS_P or name in CLOSES:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in CLOSES.get(name, ()) or (stack[k].name == "p" and name in ENDS_P):
                        del stack[k:]
                        break
                    if not stack[k].inline and not (name in ("tr", "td", "th") and stack[k].name in ("tr", "td", "th")):
                        break
            top = stack[-1]
            features, noise = attributes(name, attrs)
            section = top.section
            if name in SECTIONS and not noise and not top.noise:
                out.articles += name == "article"
                if not section:
                    sections += 1
                    section = sections
            if not top.noise:
                out.tokens.append(name)
                out.inside.append(bool(section))
            if name not in VOID:
                context = (features, *top.context)[:DEPTH] if features else top.context
                stack.append(Element(name, context, top.noise or noise, section, name not in BLOCKS))
        if name in BLOCKS:
            block += 1
        if slash and not stack[-1].noise:
            out.tokens.append(name)
            out.inside.append(bool(stack[-1].section))
    if at < len(page):
        add(out, page[at:], block, stack[-1])
    return out


def add(out: Page, raw: str, block: int, element: Element) -> None:
    text = html.unescape(raw) if "&" in raw else raw
    words = len(text.split())
    if element.noise and not words:
        return
    out.tokens.append(Run(text, words, block, element))
    out.inside.append(bool(element.section))


@dataclass
class PageModel:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, e: Element, known: dict) -> float:
        key = e.context
        if key not in known:
            found = [self.words[f] / (1 << 2 * k) for k, own in enumerate(key) for f in own if f in self.words]
            known[key] = max(-LIMIT, min(LIMIT, sum(found))) if found else UNKNOWN_WORD
        return max(known[key], INSIDE) if e.section else known[key]

    def region(self, page: Page) -> tuple[int, int]:
        """First token and the one after the last of the best region; of equal ones the first, and there the shortest. (0, 0): none."""
        best, found, total, begin, known = 0.0, (0, 0), 0.0, 0, {}
        for k, t in enumerate(page.tokens):
            if isinstance(t, str):
                total += self.tags.get(t, UNKNOWN_TAG)
            elif t.element.noise:
                continue
            elif t.words:
                total += t.words * self.word(t.element, known)
            if total <= 0.0:
                total, begin = 0.0, k + 1
            elif total > best:
                best, found = total, (begin, k + 1)
        return found

    def text(self, page: str | None) -> str:
        if not page:
            return ""
        parsed = parse(page)
        first, last = self.region(parsed)
        runs = [t for t in parsed.tokens if not isinstance(t, str)]
        inside = {t.block for t in parsed.tokens[first:last] if not isinstance(t, str) and t.words and not t.element.noise}
        sections = {t.element.section for t in parsed.tokens[first:last] if not isinstance(t, str) and t.words and not t.element.noise} - {0}
        held: dict[int, list[str]] = {}
        for t in runs:
            if not t.element.noise and (t.element.section in sections if sections else t.block in inside):
                held.setdefault(t.block, []).append(t.text)
        return "\n".join(s for s in (" ".join("".join(parts).split()) for parts in held.values()) if s)


def counts(page: str) -> tuple[Counter, Counter] | None:
    """By (kind, feature): words or tags inside and outside the article of a labelled page; None for other pages. Noise counts as outside."""
    parsed = parse(page)
    if parsed.articles != 1:
        return None
    found = (Counter(), Counter())
    for t, inside in zip(parsed.tokens, parsed.inside, strict=True):
        if isinstance(t, str):
            found[not inside][("t", t)] += 1
        elif t.words:
            for f in frozenset([""]).union(*t.element.context):
                found[not inside or t.element.noise][("w", f)] += t.words
    return found


def fit_pages(pages: DataFrame, max_pages: int = 5000) -> PageModel:
    """Learns from labelled pages among the max_pages of least hash (and others of equal hash: equal pages)."""
    key = F.xxhash64("url", "html")
    least = pages.select(key.alias("h")).orderBy("h").limit(max_pages).agg(F.max("h")).first()[0]
    if least is None:
        return PageModel()

    def count(batches):
        total: dict[tuple[str, str], list[int]] = {}
        for b in batches:
            for page in b.column(0).to_pylist():
                for k, held in enumerate((page and counts(page)) or ()):
                    for f, n in held.items():
                        row = total.setdefault(f, [0, 0, 0, 0])
                        row[k] += n
                        row[2 + k] += 1
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f, _ in rows], pa.string()), pa.array([f[1] for f, _ in rows], pa.string()), *(pa.array([v[k] for _, v in rows], pa.int64()) for k in range(4))], ["kind", "feature", *names])

    names = ["inside", "outside", "pages_in", "pages_out"]
    found = map_arrow(pages.where(key <= least).select("html"), count, "kind string, feature string, inside long, outside long, pages_in long, pages_out long").groupBy("kind", "feature").agg(*(F.sum(c).alias(c) for c in names))
    model, rows = PageModel(), found.where(F.greatest("pages_in", "pages_out") >= MIN_PAGES).collect()  # features of a bounded sample
    for kind, held in (("w", model.words), ("t", model.tags)):
        own = [r for r in rows if r.kind == kind]
        n_in, n_out = (next((r[c] for r in own if not r.feature), 0) if kind == "w" else sum(r[c] for r in own) for c in ("inside", "outside"))
        for r in own:
            if r.feature:
                odds = math.log((r.inside + PRIOR) / (n_in + 2 * PRIOR)) - math.log((r.outside + PRIOR) / (n_out + 2 * PRIOR))
                held[r.feature] = odds if kind == "w" else max(-2 * LIMIT, min(0.0, odds))
    return model


def main_text(pages: DataFrame, model: PageModel) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def extract(batches):
        for b in batches:
            texts = [model.text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), extract, "page_id long, url string, text string, n_chars long")
