"""Main text of HTML pages: flat blocks classified by a decision tree (operator 1).

A page becomes a flat list of text blocks, cut at block-level tags. Each block has its
word count, link density and the same of its neighbours, and what encloses it: page
chrome (menus, sidebars, forms, comments and the like, by tag or by class, id and role),
an article element, a heading. A decision tree (Spark ML) is trained on the small
labelled table ``LABELLED`` and applied to the blocks inside the tasks.

Defined results: null or empty html, and pages without a content block, give the empty
text. Broken markup never fails: unclosed elements end with what encloses them, a ``<``
that opens no tag is text, an unclosed script or comment swallows the rest. Rows are
independent, so repeated pages give repeated rows; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
# Quoted attribute values may hold a ">"; quotes elsewhere in a tag are characters like others.
_VALUE = re.compile(r"""=\s*+(?:(["'])|[^\s>]++)|>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_KEY = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)$", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's block-level elements, and elements whose content is no text.
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav object ol optgroup option
    p pre section select summary table tbody td tfoot th thead tr ul video audio""".split())
RAW = set("script style noscript template textarea title iframe svg canvas head select annotation annotation-xml".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINER = set("""article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section
    table td ul button label span p li""".split())
CHROME_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "label", "fieldset"}
CHROME_NAMES = set("""nav navbar navigation menu sidebar aside ad ads adv advert advertisement advertising banner sponsor sponsored promo
    promotion cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended
    recommendations comment comments disqus reply replies respond responses form search login signup subscribe newsletter
    breadcrumb breadcrumbs pagination pager toolbar footer copyright legal widget widgets skip hidden complementary contentinfo
    trending teaser masthead discussion""".split())
HEADER_NAMES = {"header", "banner", "masthead", "topbar"}
PLACES = set("list area box container wrapper wrap inner outer left right top bottom block section item items group panel row col column".split())
WITHOUT = {"has", "no", "with", "without"}  # names behind them tell what is or isn't inside
HARD = {"nav", "aside", "footer", "dialog"}  # elements whose articles are chrome too
ARTICLE_NAMES = set("article content main post entry story body text maincontent articlebody".split())

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "chrome", "article", "heading")
#: (label, words, words in links, chrome, article, heading) of the blocks of small pages, in page order.
LABELLED = [
    # an article element between a menu, an advert and a footer
    [(0, 1, 1, 1, 0, 0), (0, 1, 1, 1, 0, 0), (0, 2, 2, 1, 0, 0), (0, 9, 0, 1, 0, 0), (1, 8, 0, 0, 1, 1), (1, 55, 0, 0, 1, 0),
     (1, 3, 0, 0, 1, 0), (1, 120, 4, 0, 1, 0), (1, 1, 0, 0, 1, 0), (0, 14, 0, 1, 0, 0)],
    # sidebars and comments within and behind the article
    [(0, 3, 0, 1, 0, 1), (1, 6, 0, 0, 1, 1), (1, 40, 2, 0, 1, 0), (0, 25, 0, 1, 1, 0), (1, 70, 0, 0, 1, 0), (0, 2, 0, 1, 1, 1),
     (0, 45, 0, 1, 1, 0), (0, 60, 1, 1, 1, 0), (0, 5, 5, 1, 0, 0), (0, 30, 0, 2, 0, 0)],
    # no article element: long plain paragraphs against link lists and short remarks
    [(0, 2, 2, 0, 0, 0), (0, 1, 1, 0, 0, 0), (0, 3, 3, 0, 0, 0), (1, 7, 0, 0, 0, 1), (1, 48, 0, 0, 0, 0), (1, 5, 0, 0, 0, 0),
     (1, 33, 3, 0, 0, 0), (1, 90, 0, 0, 0, 0), (0, 4, 4, 0, 0, 0), (0, 2, 2, 0, 0, 0), (0, 6, 6, 0, 0, 0)],
    [(0, 4, 4, 0, 0, 0), (0, 5, 4, 0, 0, 0), (1, 22, 0, 0, 0, 0), (1, 31, 1, 0, 0, 0), (1, 12, 0, 0, 0, 0), (0, 6, 5, 0, 0, 0)],
    # short article, links inside its text, a list in the article
    [(0, 1, 1, 2, 0, 0), (1, 4, 0, 0, 1, 1), (1, 6, 0, 0, 1, 0), (1, 2, 0, 0, 1, 0), (1, 8, 5, 0, 1, 0), (1, 3, 3, 0, 1, 0), (0, 8, 1, 1, 0, 0)],
    [(0, 12, 0, 1, 0, 0), (0, 50, 0, 1, 0, 0), (1, 9, 9, 0, 1, 1), (1, 210, 6, 0, 1, 0), (0, 18, 2, 1, 1, 0), (0, 40, 0, 1, 0, 0)],
    # one block, plain text without markup
    [(1, 3, 0, 0, 0, 0)], [(1, 200, 0, 0, 0, 0)], [(1, 1, 0, 0, 1, 0)], [(0, 3, 3, 0, 0, 0)], [(0, 30, 0, 1, 0, 0)],
    [(1, 2, 0, 0, 0, 0), (1, 3, 0, 0, 0, 0), (1, 60, 0, 0, 0, 0)],
]
#: Likewise inside wrappers whose names hint at chrome (0.5): articles, then teasers and remarks.
HINTED = [
    [(0, 2, 2, 1, 0, 0), (1, 7, 0, 0.5, 1, 1), (1, 55, 0, 0.5, 1, 0), (1, 4, 0, 0.5, 1, 0), (1, 120, 4, 0.5, 1, 0), (0, 9, 0, 1, 0, 0)],
    [(0, 3, 3, 0.5, 0, 0), (0, 4, 4, 0.5, 0, 0), (1, 60, 1, 0.5, 0, 0), (1, 45, 0, 0.5, 0, 0), (0, 9, 0, 1, 0, 0)], [(1, 52, 0, 0.5, 1, 0)],
    [(0, 1, 1, 1, 0, 0), (1, 9, 0, 0.5, 1, 1), (1, 38, 0, 0.5, 1, 0), (1, 64, 3, 0.5, 1, 0), (1, 3, 0, 0.5, 1, 0), (1, 90, 0, 0.5, 1, 0), (1, 31, 2, 0.5, 1, 0)],
    [(1, 5, 0, 0.5, 1, 1), (1, 150, 5, 0.5, 1, 0), (1, 12, 0, 0.5, 1, 1), (1, 70, 0, 0.5, 1, 0), (1, 44, 1, 0.5, 1, 0), (0, 30, 0, 1, 0, 0)],
    [(1, 6, 0, 0.5, 0, 1), (1, 80, 0, 0.5, 0, 0), (1, 2, 0, 0.5, 0, 0), (1, 58, 2, 0.5, 0, 0), (1, 36, 0, 0.5, 0, 0), (0, 40, 0, 1, 0, 0), (0, 55, 2, 1, 0, 0)],
    [(0, 6, 6, 0.5, 1, 1), (0, 14, 2, 0.5, 1, 0), (0, 7, 7, 0.5, 1, 1), (0, 16, 2, 0.5, 1, 0), (0, 8, 8, 0.5, 1, 1)],
    [(0, 2, 0, 0.5, 0, 0), (0, 6, 1, 0.5, 0, 0), (0, 8, 0, 0.5, 0, 0)], [(0, 40, 36, 0.5, 0, 0)], [(0, 60, 50, 0.5, 1, 0)],
    [(0, 6, 0, 0.5, 0, 1), (0, 12, 0, 0.5, 0, 0), (0, 9, 0, 0.5, 1, 0), (0, 15, 0, 0.5, 0, 0), (0, 11, 0, 0.5, 1, 0), (0, 18, 0, 0.5, 1, 0), (0, 7, 1, 0.5, 1, 0)],
    [(0, 7, 7, 0.5, 1, 1), (0, 4, 2, 0.5, 1, 0), (0, 8, 8, 0.5, 1, 1), (0, 9, 3, 0.5, 1, 0), (0, 6, 6, 0.5, 1, 1), (0, 5, 0, 0.5, 1, 0), (0, 7, 7, 0.5, 1, 1), (0, 8, 0, 0.5, 0, 0)],
    [(1, 85, 2, 0.5, 1, 0), (1, 4, 0, 0.5, 1, 0)], [(1, 66, 0, 0.5, 0, 0), (1, 9, 0, 0.5, 0, 0)], [(1, 45, 0, 0.5, 1, 0), (1, 13, 1, 0.5, 1, 0)],
    # long paragraphs among link lists, and with links of their own
    [(0, 4, 4, 0.5, 1, 0), (1, 48, 9, 0.5, 1, 0), (0, 4, 4, 0.5, 1, 0), (1, 62, 0, 0.5, 1, 0), (0, 9, 9, 0.5, 1, 0), (1, 35, 6, 0.5, 0, 0), (0, 6, 5, 0.5, 0, 0)],
    [(1, 54, 8, 0.5, 0, 0), (0, 3, 3, 0.5, 0, 0), (1, 75, 14, 0.5, 0, 0), (0, 5, 5, 0.5, 0, 0), (1, 41, 0, 0.5, 0, 0), (0, 2, 2, 0.5, 0, 0)],
]


def _enclosing(tag: str, attributes: str, in_article: bool) -> tuple[float, bool, bool]:
    """What an element adds: (chrome, article, whether it, or an article in it, stays chrome inside chrome)."""
    names: list[list[str]] = []
    hidden = False
    if attributes and tag not in ("body", "html"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key = _KEY.search(key)
            if not key:
                continue
            value, key = a or b or c, key[1].lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
            elif key in ("class", "id", "role"):
                for name in value.split():
                    parts = [x.lower() for x in _NAME.findall(name)]
                    told = next((i for i, x in enumerate(parts) if x in WITHOUT), len(parts))
                    names.append([x for x in parts[:told] if x not in PLACES])
    if tag in CHROME_TAGS or hidden or tag == "header" and not in_article:
        return 1, False, hidden or tag in HARD
    chrome = CHROME_NAMES - HEADER_NAMES if in_article else CHROME_NAMES | HEADER_NAMES
    own = tag in ("article", "main")
    article = any(x in ARTICLE_NAMES for parts in names for x in parts)
    hinted = any(x in chrome for parts in names for x in parts)
    if own:
        return 0.5 if any(parts and all(x in chrome for x in parts) for parts in names) else 0, True, hinted
    if any(parts and parts[-1] in chrome for parts in names):  # the last part says what it is
        return 1, False, False
    return 0.5 if hinted else 0, article, False


def _tag_end(page: str, at: int, endless: set[int]) -> int:
    """The end of the tag whose name ends at ``at``: the first ">" outside quoted values, or the first of all if there
    is none (a quote is never closed); -1 without a ">". ``endless``: places in the page from where there is none."""
    first = page.find(">", at)
    if first < 0 or page.find('"', at, first) < 0 and page.find("'", at, first) < 0:
        return first
    seen: list[int] = []
    while (m := _VALUE.search(page, at)) and m.end() not in endless:
        if m[0] == ">":
            return m.start()
        seen.append(m.end())
        at = page.find(m[1], m.end()) + 1 if m[1] else m.end()
        if not at:
            break
    endless.update(seen)
    return first


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """``(text, words in links, chrome, article, heading)`` of each block that has text, in page order."""
    out: list[tuple[str, int, float, int, int]] = []
    stack: list[tuple[str, float, int, int]] = []  # open containers: tag, chrome, article, hard chrome
    opened: Counter[str] = Counter()  # by tag; a closing tag without one is passed over
    endless: set[str] = set()  # elements known to have no end
    chrome = article = hard = link = heading = linked = 0
    parts: list[str] = []

    def flush():
        nonlocal linked, parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, linked, chrome, int(article > 0), int(heading > 0)))
            parts, linked = [], 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked += len(text.split())

    unclosed: set[int] = set()  # values behind which no tag ends
    at, seek, n, last = 0, 0, len(page), max(page.rfind(">"), page.rfind("<!"))
    while at < n:
        seek = max(at, seek)
        m = _MARKUP.search(page, seek) if seek <= last else None  # behind the last tag's end all is text
        if m is None:
            add(page[at:])
            break
        end = _tag_end(page, m.end(), unclosed) if m[2] else m.end()
        if end < 0:
            seek = m.end()
            continue
        add(page[at:m.start()])
        if not m[2]:
            at = end
            continue
        at = end + 1
        tag, closing, attributes = m[2].lower(), bool(m[1]), page[m.end():end]
        if tag in RAW:
            flush()
            if not closing and not attributes.endswith("/"):
                end = None if tag in endless else re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else (n if tag != "head" else at)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        if tag in BLOCK:
            flush()
            if tag != "li":
                link = 0
        if tag in HEADING:
            heading = 0 if closing else 1
        if tag in CONTAINER:
            if closing:
                for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        if parts and any(x[1] for x in stack[k:]):
                            flush()
                        chrome -= sum(x[1] for x in stack[k:])
                        article -= sum(x[2] for x in stack[k:])
                        hard -= sum(x[3] for x in stack[k:])
                        opened.subtract(x[0] for x in stack[k:])
                        del stack[k:]
                        break
            elif not attributes.endswith("/"):
                if tag in ("p", "li") and stack and stack[-1][0] == tag:  # these close themselves
                    chrome, article, hard = chrome - stack[-1][1], article - stack[-1][2], hard - stack[-1][3]
                    opened[stack.pop()[0]] -= 1
                c, a, h = _enclosing(tag, attributes, article > 0)
                if tag in ("article", "main") and chrome and not (hard or article or c or h):
                    # a wrapper of another kind than HARD, or its name, does not decide over an article
                    c = (0.5 if tag == "article" and chrome >= 1 else 0) - chrome
                if c and parts:
                    flush()
                stack.append((tag, c, int(a), int(h)))
                opened[tag] += 1
                chrome, article, hard = chrome + c, article + int(a), hard + int(h)
    flush()
    return out


def features(rows: list[tuple[int, int, float, int, int]]) -> np.ndarray:
    """FEATURES of a page's blocks from ``(words, words in links, chrome, article, heading)``."""
    x = np.array(rows, float).reshape(-1, 5)
    words, density = np.minimum(x[:, 0], 500), x[:, 1] / np.maximum(x[:, 0], 1)
    before = lambda v: np.concatenate(([0.0], v[:-1]))
    after = lambda v: np.concatenate((v[1:], [0.0]))
    return np.stack([words, density, before(words), before(density), after(words), after(density),
                     np.minimum(x[:, 2], 2), x[:, 3], x[:, 4]], axis=1)


def train(spark: SparkSession, labelled=LABELLED, depth: int = 5, hinted=HINTED):
    """The tree as nested ``(feature, threshold, left, right)`` and 0.0 or 1.0 at the leaves; blocks in wrappers
    that only hint at chrome have a branch of their own, learnt from ``hinted``: words, links and neighbours decide."""
    chrome = FEATURES.index("chrome")

    def node(j):
        if j.getClass().getSimpleName() == "LeafNode":
            return float(j.prediction())
        return j.split().featureIndex(), j.split().threshold(), node(j.leftChild()), node(j.rightChild())

    def fit(pages, use):
        rows = [(float(b[0]), Vectors.dense(f)) for page in pages for b, f in zip(page, features([b[1:] for b in page])) if use(f[chrome])]
        return node(DecisionTreeClassifier(maxDepth=depth, seed=1).fit(spark.createDataFrame(rows, ["label", "features"]))._call_java("rootNode"))

    plain = fit(labelled, lambda c: True)
    return chrome, 0.25, plain, (chrome, 0.75, fit(hinted, lambda c: c == 0.5), plain)


def predict(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    at, threshold, left, right = tree
    low = x[:, at] <= threshold
    out = np.empty(len(x))
    out[low], out[~low] = predict(left, x[low]), predict(right, x[~low])
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = predict(tree, features([(len(b[0].split()), *b[1:]) for b in found]))
    return "\n".join(b[0] for b, k in zip(found, keep) if k > 0.5)


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``."""
    tree = tree or train(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py(), tree) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(bk.tidy(run), "page_id long, url string, text string, n_chars long")
