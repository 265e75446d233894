"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score above zero, tags below, and one linear scan
finds the contiguous run with the greatest sum: the content region. The scores are log odds of standing
inside the content, learned from labelled pages - pages with one ``<article>`` or ``<main>`` element, which
marks their content: for a tag by its name, for a word by the element it stands in.

Elements that are no content wherever they stand (menus, headers of the page, footers, sidebars, notices,
adverts, forms, comments of readers, scripts, styles) are known by their names, roles and class names; their
words score nothing and are left out, also inside the region. A class name counts by its last telling part
("cookie-notice", "ad-slot-3", but not "notice-period" or "has-sidebar"). An element that holds the article, or most of
the page's words, is a layout and not left out, whatever its name; other class names only weigh: words inside them
score by how often the labelled pages have words of that class inside their content.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and
joined in page order by line feeds; empty blocks vanish. A line break ends a block.

Cases: a null or empty page, or one without words, gives the empty text. Elements whose end tag may be left out end where
HTML says so (``head`` at the first element of the body); unclosed menus and the like end at the next section or heading,
other unclosed elements with the one they stand in. An unfinished tag at the end is dropped, a ``<`` that begins no tag is text. Pages without a
region that scores above zero give the empty text. Without labelled pages every word scores 1 and every
tag -0.05. Repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices

#: Fixed values of HTML: elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Fixed values of HTML: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no content.
BOILERPLATE = frozenset("nav footer aside form menu dialog button select textarea option label fieldset iframe noscript template object svg canvas head".split())
#: Of these, elements that a page may have around its content.
AROUND = frozenset("form fieldset label dialog object template".split())
#: Words in class names, ids and roles of elements whose text is no content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion promoted banner sidebar widget menu nav navbar navigation breadcrumb"
    " breadcrumbs footer masthead cookie cookies consent notice alert popup modal overlay newsletter subscribe subscription signup login comment comments reply replies disqus"
    " respond discussion share sharing social related recommended recommendations pagination pager toolbar copyright disclaimer complementary contentinfo search".split()
)
#: Of these, words for what readers write, which may be longer than the article.
READERS = frozenset("comment comments reply replies disqus respond discussion".split())
#: Words in class names that say where or in what form something stands, and not what it is.
PLACES = frozenset(
    "area bar block body bottom box button buttons col column container content footer form frame group head header heading icon icons inner inline item items left link links"
    " list main mobile outer page panel posts primary right row secondary section site slot small text thread title toggle top unit wrap wrapper zone articles".split()
)
#: Words in class names that speak of a state of what the element holds.
STATES = frozenset("has have with without no not is in on show hide enable enabled disabled open closed active".split())
#: Fixed values of HTML: what ends an element whose end tag is left out.
ENDS = {
    "p": BLOCKS - {"body", "html", "br"}, "li": {"li"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
IN_HEAD = frozenset("title meta link style script base noscript template".split())
#: What ends an element of no content that is never closed.
SECTIONS = frozenset("article main section header footer nav aside h1 h2 form table".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?(?P<odd>[a-zA-Z])[^<>]*>?"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAMED = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"\S+")

WORD, TAG = 0, 1
#: Words of a class in labelled pages from which on the class has a weight.
LEAST_WORDS = 200


HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


def _mark(rest: str) -> str:
    """The word that tells that an element of these attributes is no content, or nothing."""
    for found in ATTRIBUTE.findall(rest):
        for name in "".join(found).split():
            parts = [part.lower() for part in NAMED.split(name) if part]
            if STATES.intersection(parts):
                continue
            if parts and parts[-1] == "header" and all(x in ("site", "main", "top", "global") for x in parts[:-1]):
                return "header"
            while len(parts) > 1 and parts[-1] in PLACES and parts[-1] not in MARKS:
                parts.pop()
            if parts and parts[-1] in MARKS:
                return parts[-1]
    return ""


def _classes(rest: str) -> tuple[str, ...]:
    return tuple("".join(found).lower()[:60] for found in ATTRIBUTE.findall(rest)[:1])


def _tokens(page: str) -> list[tuple[int, str, bool, str]]:
    """The page as ``(WORD, "", False, text)`` and ``(TAG, name, closing, attributes)``."""
    out, at = [], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append((WORD, "", False, page[at : m.start()]))
        at = m.end()
        if m["name"] is not None:
            out.append((TAG, m["name"].lower(), m["close"] == "/", m["rest"]))
    if at < len(page):
        out.append((WORD, "", False, page[at:]))
    return out


def _extents(tokens: list[tuple[int, str, bool, str]]) -> dict[int, tuple[int, bool]]:
    """(end, whether its end is known) of the element that begins at each start tag."""
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    count: Counter = Counter()

    def close(at: int, known: bool) -> None:
        name, begin = stack.pop()
        count[name] -= 1
        ends[begin] = (at, known)

    for at, (kind, name, closing, rest) in enumerate(tokens):
        if kind == WORD:
            continue
        if closing:
            if count[name]:
                while stack[-1][0] != name:
                    close(at, stack[-1][0] in ENDS)
                close(at, True)
            continue
        if count["head"] and name not in IN_HEAD and name != "head":
            while count["head"]:
                close(at, True)
        while stack and name in ENDS.get(stack[-1][0], ()):
            close(at, True)
        if name not in VOID and not rest.endswith("/"):
            stack.append((name, at))
            count[name] += 1
    while stack:
        close(len(tokens), False)
    return ends


def read_page(page: str) -> Iterator[tuple[int, str, str, bool, tuple]]:
    """The page as ``(WORD, element, text, hidden, classes)`` and ``(TAG, name, "", hidden, classes)``; a piece of text is one item."""
    tokens = _tokens(page)
    ends = _extents(tokens)
    # words before each token, all and those of content elements
    words, inside, held, content_until = [0], [0], [], -1
    for at, (kind, name, closing, text) in enumerate(tokens):
        n = len(WORDS.findall(text)) if kind == WORD else 0
        if kind == TAG and not closing and name in ("article", "main") and at in ends:
            held.append(at)
            content_until = max(content_until, ends[at][0])
        words.append(words[-1] + n)
        inside.append(inside[-1] + (n if at < content_until else 0))

    def around(at: int, end: int, name: str, mark: str) -> bool:
        """Whether an element of no content by its name holds the content."""
        if inside[-1]:  # content that begins inside it, for most of all content
            first = next((h for h in held if h > at), None)
            return first is not None and first < end and 2 * (inside[end] - inside[first]) > inside[-1]
        share = (words[end] - words[at]) / max(words[-1], 1)
        return share > 0.5 and name in AROUND or share > 0.8 and name not in BOILERPLATE and mark not in READERS

    skip_until, content_until = 0, 0
    within: list[tuple[str, int, tuple]] = [("body", len(tokens), ())]
    for at, (kind, name, closing, rest) in enumerate(tokens):
        while len(within) > 1 and within[-1][1] <= at:
            within.pop()
        hidden = at < skip_until
        if kind == WORD:
            yield WORD, within[-1][0], rest, hidden, within[-1][2]
            continue
        if not closing and at in ends:
            end, known = ends[at]
            if not hidden and name not in ("html", "body", "article", "main"):
                mark = _mark(rest) if "=" in rest else ""
                # the header of an article belongs to it, that of the page does not
                top = name == "header" or mark == "header"
                if name in BOILERPLATE or top and at >= content_until or mark and not top or rest and HIDDEN.search(rest):
                    if not known and name in BOILERPLATE:
                        end = next((i for i in range(at + 1, end) if tokens[i][0] == TAG and not tokens[i][2] and tokens[i][1] in SECTIONS), end)
                    if not around(at, end, name, mark):
                        skip_until, hidden = end + (end < len(tokens) and tokens[end][2] and tokens[end][1] == name), True
            if name in ("article", "main"):
                content_until = max(content_until, end)
            within.append((name, end, _classes(rest) or within[-1][2]))
        yield TAG, ("/" if closing else "") + name, "", hidden, within[-1][2]


def observe(page: str) -> Counter | None:
    """How often each feature stands inside (True) and outside the content of a labelled page; None for others."""
    if len(re.findall(r"<article\b", page, re.IGNORECASE)) == 1:
        mark = "article"
    elif len(re.findall(r"<main\b", page, re.IGNORECASE)) == 1:
        mark = "main"
    else:
        return None
    out, inside = Counter(), False
    for kind, name, text, hidden, classes in read_page(page):
        if kind == TAG:
            if name == "/" + mark:
                inside = False
            out["t:" + name, inside and not hidden] += 1
            if name == mark:
                inside = True
        else:
            n = len(WORDS.findall(text))
            for feature in ("w:" + name, *("c:" + c for c in classes)):
                out[feature, inside and not hidden] += n
    return out


def learn(pages: DataFrame, sample: int = 2_000, most: int = 2_000) -> dict[str, float]:
    """Scores of features from at most ``sample`` labelled pages, the first by a hash of the id."""
    import math

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                total.update(observe(page.as_py() or "") or {})
        rows = [(k, n if inside else 0, 0 if inside else n) for (k, inside), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], ["feature", "inside", "outside"])

    ids = pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    chosen = pages.select("page_id", F.col("html").cast("string").alias("html")).join(F.broadcast(ids), "page_id", "left_semi")
    counts = chosen.select("html").mapInArrow(run, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside"), F.sum("outside"))
    scores = {}
    for feature, inside, outside in counts.orderBy(F.desc(F.col("sum(inside)") + F.col("sum(outside)")), "feature").limit(most).collect():
        odds = math.log((inside + 1) / (outside + 1))
        scores[feature] = min(-0.05, odds) if feature[0] == "t" else max(0.2, min(odds, 2.0)) if feature[0] == "w" else max(-3.0, min(odds, 1.0)) if inside + outside >= LEAST_WORDS else 0.0
    return scores


def extract(page: str, scores: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    pieces, blocks, block = [], [], 0
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for kind, name, text, hidden, classes in read_page(page):
        if kind == TAG:
            if name.lstrip("/") in BLOCKS:
                block += 1
            total += scores.get("t:" + name, -0.05)
        elif not hidden:
            n = len(WORDS.findall(text))
            total += n * (scores.get("w:" + name, 1.0) + sum(scores.get("c:" + c, 0.0) for c in classes))
            pieces.append(text)
            blocks.append(block)
        if total <= 0:
            total, start = 0.0, len(pieces)
        elif total > best and kind == WORD:
            best, best_at = total, (start, len(pieces))
    lines, now = [], None
    for text, block in zip(pieces[slice(*best_at)], blocks[slice(*best_at)]):
        if block == now:
            lines[-1] += text
        else:
            lines.append(text)
            now = block
    decoded = (" ".join(html.unescape(x).split()) for x in lines)
    return "\n".join(x for x in decoded if x)


def extract_pages(pages: DataFrame, scores: dict[str, float]) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row; one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(page.as_py() or "", scores) for page in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
