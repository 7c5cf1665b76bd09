"""HTML extraction: flat text blocks, judged by a decision tree on their words and links and those of their neighbours.

Markup splits a page into blocks at block-level tags; scripts, styles, comments and the head hold no text. A block has its
number of words and its link density, those of the blocks before and after it, and what its place tells: whether it
lies in the page's main part, in a part that carries no content (menus, footers, forms and so on, also by class and id),
and whether it is a heading. The tree is grown from a small labelled table of such blocks.

Null and empty pages, and pages without text, give an empty text. Pages are read whole, whatever their length; an unclosed
script or comment swallows the rest of the page, other unclosed tags end with the part around them. Each row is judged
alone, so repeated rows get equal results, an empty table gives an empty one, and other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts, with_struct

#: A tag up to the next closing bracket, a comment or a declaration; and a tag with brackets inside quoted values.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.DOTALL)
QUOTED = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
DECLARATION = re.compile(r"<[!?]")
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea datalist map".split())
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without content of their own, outside the main part; header only there.
CHROME = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
END_TAGS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar|side|footer|foot|header|masthead|cookie\w*|consent|notice|alert|popup|modal"
    r"|comments?|commentlist|replies|reply|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|widget\w*|pager|pagination|toolbar|copyright|legal)(?:$|[\s_-])",
    re.IGNORECASE,
)
CONTENT_HINTS = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body)(?:$|[\s_-])", re.IGNORECASE)
ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert)\b", re.IGNORECASE)
ATTRIBUTE = re.compile(r"\b(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.IGNORECASE)  # as an attribute of its own
NOT_SHOWN = re.compile(r"\baria-hidden\s*=\s*[\"']?true|\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"']*)display\s*:\s*none", re.IGNORECASE)
#: Words that make a class name a state of the page around it, as in has-sidebar or nav-open.
STATES = frozenset("has no not with without is hide show open opened closed close enabled disabled on off active inactive visible collapsed expanded sticky fixed allowed project".split())

FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "chrome", "main", "heading")
#: Labelled blocks: the features in their order, then 1 for content.
LABELLED = """
120 0.00 80 0.00 95 0.00 0 1 0 1 | 45 0.02 10 0.00 60 0.00 0 1 0 1 | 6 0.00 40 0.00 52 0.00 0 1 1 1 | 3 0.00 0 0.00 30 0.00 0 1 1 1
2 0.00 30 0.00 20 0.00 0 1 0 1 | 1 0.00 1 0.00 1 0.00 0 1 0 1 | 12 0.50 50 0.00 40 0.10 0 1 0 1 | 1 1.00 20 0.00 35 0.00 0 1 0 1
30 0.90 40 0.00 10 0.00 0 1 0 1 | 8 0.00 9 0.00 0 0.00 0 1 0 1 | 400 0.01 3 0.00 0 0.00 0 1 0 1 | 5 0.00 0 0.00 300 0.00 0 1 1 1
9 0.00 1 1.00 44 0.00 0 1 1 1 | 18 0.00 14 0.00 6 0.20 0 1 0 1 | 70 0.00 5 1.00 5 0.00 0 1 0 1 | 4 1.00 60 0.00 60 0.00 0 1 0 1
1 1.00 0 0.00 1 1.00 1 0 0 0 | 2 1.00 1 1.00 1 1.00 1 0 0 0 | 1 1.00 1 1.00 20 0.00 1 0 0 0 | 9 0.00 200 0.00 0 0.00 1 0 0 0
14 0.10 60 0.00 0 0.00 1 0 0 0 | 60 0.00 80 0.00 12 0.00 1 1 0 0 | 25 0.00 1 1.00 6 0.00 1 0 0 0 | 110 0.00 30 0.00 90 0.00 1 1 0 0
3 0.00 50 0.00 45 0.00 1 1 1 0 | 40 0.30 20 0.00 5 0.00 1 0 0 0 | 80 0.00 6 0.50 4 0.00 1 0 0 0 | 7 0.00 90 0.00 8 0.00 1 1 0 0
2 0.00 1 1.00 1 0.00 1 0 1 0 | 150 0.00 2 0.00 30 0.00 1 0 0 0 | 5 0.00 1 1.00 20 0.00 1 0 1 0 | 33 0.00 40 0.00 41 0.00 1 0 0 0
90 0.00 60 0.00 70 0.05 0 0 0 1 | 35 0.05 50 0.00 80 0.00 0 0 0 1 | 22 0.00 45 0.00 30 0.00 0 0 0 1 | 18 0.00 70 0.00 64 0.00 0 0 0 1
7 0.00 12 0.00 55 0.00 0 0 1 1 | 4 0.00 0 0.00 60 0.00 0 0 1 1 | 12 0.00 40 0.00 38 0.00 0 0 0 1 | 16 0.10 25 0.00 33 0.00 0 0 0 1
140 0.02 0 0.00 0 0.00 0 0 0 1 | 48 0.10 4 0.00 0 0.00 0 0 0 1 | 26 0.00 3 0.00 2 0.00 0 0 0 1 | 60 0.15 1 1.00 70 0.00 0 0 0 1
2 0.00 2 0.00 2 0.00 0 1 0 1 | 10 0.00 60 0.00 9 0.00 0 1 1 1 | 7 0.20 1 1.00 1 1.00 0 1 0 1 | 11 0.00 22 0.00 1 1.00 0 1 0 1
1 0.00 90 0.00 8 0.00 0 1 0 1 | 5 0.00 20 0.00 12 0.30 0 1 0 1 | 9 0.60 14 0.00 3 0.00 0 1 0 1 | 3 0.00 1 1.00 14 0.00 0 1 1 1
15 0.00 12 0.00 0 0.00 0 1 0 1 | 6 0.00 5 0.50 70 0.00 0 1 1 1 | 40 0.00 3 0.00 2 0.00 0 1 0 1 | 2 1.00 3 0.00 9 0.00 0 1 0 1
28 0.00 6 1.00 16 0.00 0 1 0 1 | 4 0.00 7 0.00 7 0.00 0 1 0 1 | 200 0.30 12 0.00 18 0.00 0 1 0 1 | 13 0.00 2 0.00 25 0.00 0 1 0 1
27 0.00 17 0.00 2 1.00 0 0 0 1 | 15 0.00 17 0.00 1 1.00 0 0 0 1 | 55 0.00 1 1.00 1 1.00 0 0 0 1 | 20 0.00 0 0.00 15 0.00 0 0 0 1
12 0.00 12 0.00 12 0.00 0 0 0 1 | 12 0.00 0 0.00 12 0.00 0 0 0 1 | 12 0.00 12 0.00 0 0.00 0 0 0 1 | 11 0.00 14 0.00 13 0.00 0 0 0 1
10 0.05 16 0.00 12 0.00 0 0 0 1 | 14 0.00 10 0.00 11 0.10 0 0 0 1 | 13 0.00 9 0.00 30 0.00 0 0 0 1 | 11 0.08 40 0.00 10 0.00 0 0 0 1
6 0.00 30 0.00 0 0.00 0 0 0 0 | 4 0.00 3 0.00 5 0.00 0 0 0 0 | 1 0.00 8 0.00 60 0.00 0 0 0 0 | 3 0.00 0 0.00 12 0.00 0 0 0 0
2 0.00 50 0.00 70 0.00 0 0 0 0 | 5 0.00 80 0.00 6 0.00 0 0 0 0 | 1 0.00 2 0.00 2 0.00 0 0 0 0 | 4 0.00 9 0.00 1 0.00 0 0 0 0
3 0.00 25 0.00 40 0.00 0 0 0 0 | 6 0.00 5 0.00 45 0.00 0 0 0 0 | 5 0.00 60 0.00 2 0.00 0 0 0 0 | 2 0.00 7 0.00 90 0.00 0 0 0 0
3 0.60 2 1.00 2 1.00 0 0 0 0 | 1 1.00 1 1.00 1 1.00 0 0 0 0 | 5 0.80 3 1.00 10 0.40 0 0 0 0 | 30 0.90 4 1.00 6 1.00 0 0 0 0
2 0.00 2 1.00 1 1.00 0 0 0 0 | 8 0.40 50 0.00 3 0.90 0 0 0 0 | 4 0.00 1 1.00 2 0.00 0 0 0 0 | 6 0.00 3 0.00 1 1.00 0 0 0 0
3 0.00 4 0.00 2 0.00 0 0 0 0 | 5 0.00 2 0.00 0 0.00 0 0 0 0 | 2 0.00 0 0.00 4 0.30 0 0 0 0 | 12 0.70 30 0.00 9 0.60 0 0 0 0
"""


class Tree:
    """A decision tree on numeric features, grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2):
        self.verdict, self.feature = float(y.mean()) >= 0.5 if len(y) else True, -1
        if depth and len(set(y.tolist())) > 1:
            best = min(self._cuts(x, y, least), default=None)
            if best:
                _, self.feature, self.cut = best
                low = x[:, self.feature] <= self.cut
                self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _cuts(x: np.ndarray, y: np.ndarray, least: int):
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, feature] <= cut
                if min(low.sum(), (~low).sum()) < least:
                    continue
                yield sum(part.sum() * (1 - part.mean()) for part in (y[low], y[~low])), feature, float(cut)

    def __call__(self, row: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.verdict


@lru_cache(maxsize=1)
def trained() -> Tree:
    rows = np.array([[float(v) for v in block.split()] for line in LABELLED.strip().splitlines() for block in line.split("|")])
    return Tree(rows[:, :-1], rows[:, -1])


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it is an end tag, name and attributes of each piece of markup; one without a name holds no text.

    A caller may send the place to go on from. The scan is linear: behind the last closing bracket no tag is looked for, and
    once the quotes of a tag do not pair, quotes are not looked at any more.
    """
    at, quotes, last = 0, True, page.rfind(">")
    while at <= last:
        m = MARKUP.search(page, at, last + 1)
        if not m:
            break
        if m[2] and quotes and ('"' in m[3] or "'" in m[3]):
            m, loose = QUOTED.match(page, m.start()), m
            if not m:
                m, quotes = loose, False
        elif not m[2] and m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # unclosed
        moved = yield m.start(), m.end(), bool(m[1]), (m[2] or "").lower(), m[3] or ""
        at = m.end() if moved is None else moved
    m = DECLARATION.search(page, at)
    if m:
        yield m.start(), len(page), False, "", ""


def chrome_words(hints: str) -> bool:
    """Whether class names and ids tell of a part without content: by one of their words that is no state, where none tells of content."""
    found = False
    for name in hints.split():
        if HINTS.search(name):
            found = found or not STATES & set(re.split(r"[_-]", name.lower()))
        elif CONTENT_HINTS.fullmatch(name):
            return False
    return found


def hidden(attributes: str) -> bool:
    return bool(NOT_SHOWN.search(attributes) or "hidden" in attributes.lower() and HIDDEN.search(VALUE.sub(" ", attributes)))


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """Text, words, link density, chrome, main and heading of each block, in page order."""
    out: list[tuple[str, int, float, int, int, int]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, int, int, int, int]] = []  # name, then in chrome, main, heading, link, silent part before it
    opened: Counter[str] = Counter()
    chrome = main = heading = link = silent = 0

    def flush() -> None:
        own = " ".join(html.unescape("".join(text)).split())
        if own:
            words = own.count(" ") + 1
            out.append((own, words, min(1.0, len(html.unescape(" ".join(linked)).split()) / words), chrome, main, heading))
        text.clear()
        linked.clear()

    def close(depth: int) -> tuple[int, int, int, int, int]:
        for entry in stack[depth:]:
            opened[entry[0]] -= 1
        before = stack[depth][1:]
        del stack[depth:]
        return before

    def add(piece: str) -> None:
        if piece and not silent:
            text.append(piece)
            if link:
                linked.append(piece)

    at, scan, move = 0, tags(page), None
    while True:
        try:
            start, end, closes, name, attributes = scan.send(move)
        except StopIteration:
            break
        add(page[at:start])
        at, move = end, None
        if not name:
            continue
        if closes:  # an end tag closes all that is open inside its element
            if opened[name]:
                depth = next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name)
                block = any(x[0] not in INLINE for x in stack[depth:])
                if name not in INLINE or not block:
                    if block:
                        flush()
                    chrome, main, heading, link, silent = close(depth)
            elif name not in INLINE:
                flush()
            continue
        if name not in INLINE:
            flush()
        if name in VOID or attributes.endswith("/") and name not in SILENT and name not in CHROME:
            continue
        if name in CLOSED_BY_NEXT and any(x[0] == name for x in stack[-3:]):
            depth = max(d for d in range(len(stack) - 1, max(-1, len(stack) - 4), -1) if stack[d][0] == name)
            if all(x[0] in INLINE or x[0] == name for x in stack[depth:]):
                chrome, main, heading, link, silent = close(depth)
        if name in RAW:  # no markup inside: on to its end tag
            ended = END_TAGS[name].search(page, at)
            at = move = ended.end() if ended else len(page) + 1
            continue
        stack.append((name, chrome, main, heading, link, silent))
        opened[name] += 1
        hints = " ".join(x.strip("\"'") for x in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
        unlike = bool(hints) and name not in MAIN | {"body", "html"} and chrome_words(hints)
        content = name in MAIN or bool(hints) and bool(CONTENT_HINTS.search(hints)) and not unlike
        if name in CHROME or name == "header" and not main or ROLES.search(attributes) or unlike or hidden(attributes):
            chrome = 1
        elif content and not chrome:
            main = 1
        silent += name in SILENT
        heading = 1 if name in HEADINGS else heading
        link = 1 if name == "a" else link
    add(page[at:])
    flush()
    return out


def extract(page: str) -> str:
    found, judge = blocks(page), trained()
    kept = []
    for i, (text, words, links, chrome, main, heading) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if judge((words, links, *before, *after, chrome, main, heading)):
            kept.append(text)
    return " ".join(kept)


def extract_text(pages: DataFrame, into: str = "main", column: str = "html") -> DataFrame:
    """The rows with a struct of the main text."""
    fields = T.StructType([T.StructField("text", T.StringType())])

    def make(batch: pa.RecordBatch) -> list:
        return [[extract(page) for page in texts(batch, column)]]

    return with_struct(pages, into, fields, make, column=column)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main.text").alias("text"), F.char_length("main.text").cast("bigint").alias("n_chars"))
