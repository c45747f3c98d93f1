"""Main text of web pages: gradient-boosted trees score every block element of the page's tree from its density,
hashed attribute tokens, tags above it, depth and siblings; a decoding over the tree keeps the best set in which no kept element
has a dropped ancestor.

Trees are trained by Spark's GBTClassifier on a bounded sample of pages (SAMPLE_PAGES) that mark their main
part themselves (article, main and the like). Each page is also learnt from in three disguises (`disguised`), mostly without
those marks: its side parts as div elements with class names or as other side elements (twice), and as div elements without any
class, the main part in a div or in none. So pages that mark nothing are judged by class names, density, links and place. The trees, a few hundred numbers, are
broadcast; extraction is one pass.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

SAMPLE_PAGES, TREES, DEPTH = 400, 32, 5

# Element names of HTML by the part that they play.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
UNSEEN = set("script style noscript template head title select option button textarea svg iframe object canvas audio video math datalist".split())
RAW = set("script style textarea title".split())
GROUPS = [set(g.split()) for g in ("p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl", "div section", "article main", "nav menu", "header", "footer", "aside", "form fieldset dialog", "table tr td th tbody thead tfoot caption", "blockquote pre figure figcaption address details summary")]
SIDE_TOKENS = set("nav navbar navigation menu footer foot header masthead topbar sidebar side aside ad ads advert adverts advertisement sponsored sponsor promo banner comment comments reply replies disqus cookie cookies consent gdpr notice alert newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs pagination pager widget copyright legal login search popup modal overlay toolbar skip form".split())
#: An open element of the first kind ends where one of the second begins.
_CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z))", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_MARK = re.compile(r"[.,;:!?]")
#: What may stand in a head: any other start tag ends it. Fixed by HTML.
_HEAD = set("html head base link meta title style script noscript template".split())
#: Buckets that attribute tokens are hashed to.
BUCKETS = 32
#: Tags whose attribute values never closed a quote, after which a page's tags end at their first ">": each costs a look at the whole rest.
OPEN_QUOTES = 8
#: Open elements that one which ends a paragraph, item or cell looks through.
_PASSED = INLINE | set("p li dd dt td th tr option".split())


class Page:
    """Block elements as parallel lists, and the text in page order.

    stream: (element, text) pieces; a piece of element -1 ends a block.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.attributes = ["#root"], [-1], [frozenset()]
        self.stream: list[tuple[int, str]] = []
        self.links: list[int] = [0]
        self._parse(html)

    def _parse(self, html: str) -> None:
        """One pass: where the open elements of each name stand is kept, so that no tag walks over elements that stay open."""
        open_tags: list[tuple[str, int]] = [("#root", 0)]
        standing: dict[str, list[int]] = defaultdict(list)  # places in open_tags by name
        walls = [0]  # places that _PASSED does not hold
        at, end, hidden, links, open_quotes = 0, len(html), 0, 0, 0

        def opened(name: str, element: int) -> None:
            standing[name].append(len(open_tags))
            if name not in _PASSED:
                walls.append(len(open_tags))
            open_tags.append((name, element))

        def closed(k: int) -> bool:
            """Ends the open elements from place k on; whether one of them is a block."""
            nonlocal hidden, links
            block = False
            while len(open_tags) > k:
                t, _ = open_tags.pop()
                standing[t].pop()
                if walls[-1] == len(open_tags):
                    walls.pop()
                hidden -= t in UNSEEN
                links -= t == "a"
                block |= t not in INLINE
            return block

        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                lt = end
            if lt > at and not hidden:
                self._text(open_tags[-1][1], unescape(html[at:lt]), links > 0)
            if lt == end:
                break
            m = _TAG.match(html, lt) if open_quotes < OPEN_QUOTES or html.startswith(("<!", "<?"), lt) else None
            if m is None:
                if not (m := _LOOSE.match(html, lt)):
                    if not hidden:
                        self._text(open_tags[-1][1], "<", links > 0)
                    at = lt + 1
                    continue
                open_quotes += 1
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if standing[name] and closed(standing[name][-1]):
                    self.stream.append((-1, ""))
                continue
            if name in RAW:  # its text is no markup
                close = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else end
                continue
            if name == "br" and not hidden:
                self._text(open_tags[-1][1], " ", False)
            if name in VOID:
                if name == "hr":
                    self.stream.append((-1, ""))
                continue
            if standing["head"] and name not in _HEAD:  # its end tag may be left out; nothing but what may stand in it is open
                closed(standing["head"][0])
            if name in _CLOSES_P or name in _SELF_CLOSING:
                k = max((standing[t][-1] for t in _SELF_CLOSING.get(name, {"p"}) if standing[t]), default=0)
                if k > walls[-1]:
                    closed(k)
            if name in INLINE:
                opened(name, open_tags[-1][1])
                links += name == "a"
                continue
            self.stream.append((-1, ""))
            hidden += name in UNSEEN
            if m.group(3).rstrip().endswith("/") and name in UNSEEN:
                hidden -= 1
                continue
            tokens = frozenset(_PARTS.findall(" ".join(a or b or c or "" for a, b, c in _NAMED.findall(m.group(3))).lower())) if "=" in m.group(3) else frozenset()
            self.tag.append(name)
            self.parent.append(open_tags[-1][1])
            self.attributes.append(tokens)
            self.links.append(0)
            opened(name, len(self.tag) - 1)

    def _text(self, element: int, text: str, link: bool) -> None:
        self.stream.append((element, text))
        if link:
            self.links[element] += len(text)

    def features(self) -> np.ndarray:
        """One row for each element: tag group and hashed attribute tokens, its own and those around it, depth, text,
        density, siblings."""
        n = len(self.tag)
        own, marks, before = np.zeros(n), np.zeros(n), np.zeros(n)
        seen = np.zeros(n, bool)
        so_far = 0
        for e, text in self.stream:
            if e >= 0 and (size := len(text.strip())):
                if not seen[e]:
                    seen[e], before[e] = True, so_far
                own[e] += size
                marks[e] += len(_MARK.findall(text))
                so_far += size
        whole, link, mark, tags, depth = own.copy(), np.array(self.links, float), marks, np.ones(n), np.zeros(n)
        children: list[list[int]] = [[] for _ in range(n)]
        kind = np.array([[t in g for g in GROUPS] for t in self.tag], float)
        tokens = np.array([(*_buckets(a), not SIDE_TOKENS.isdisjoint(a)) for a in self.attributes], float)
        marks_of = np.concatenate([kind, tokens], axis=1)
        above = np.zeros_like(marks_of)  # of the elements around
        for e in range(1, n):
            p = self.parent[e]
            children[p].append(e)
            depth[e] = depth[p] + 1
            above[e] = np.maximum(above[p], marks_of[p])
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            whole[p] += whole[e]
            link[p] += link[e]
            mark[p] += mark[e]
            tags[p] += tags[e]
            if seen[e] and (not seen[p] or before[e] < before[p]):
                seen[p], before[p] = True, before[e]
        total = max(1.0, float(whole[0]))
        place, brothers, alike = np.zeros(n), np.ones(n), np.ones(n)
        for group in children:
            same = Counter(self.tag[e] for e in group)
            for k, e in enumerate(group):
                place[e], brothers[e] = k / len(group), len(group)
                alike[e] = same[self.tag[e]] / len(group)
        measures = np.stack([depth, np.log1p(own), np.log1p(whole), link / np.maximum(whole, 1), whole / tags, mark / np.maximum(whole, 1), whole / total, before / total, place, np.log(brothers), alike, np.array([len(c) for c in children], float)], axis=1)
        return np.concatenate([marks_of, above, measures], axis=1)

    def inside(self) -> np.ndarray:
        """Elements that the page itself marks as main text: in an article or the like, and in no side part of it."""
        n = len(self.tag)
        inside = np.zeros(n, bool)
        for e in range(1, n):
            starts = self.tag[e] in GROUPS[5] or "articlebody" in self.attributes[e]
            out = bool(self.attributes[e] & SIDE_TOKENS) or any(self.tag[e] in GROUPS[g] for g in (6, 8, 9, 10)) or self.tag[e] in UNSEEN
            inside[e] = (inside[self.parent[e]] or starts) and not out
        return inside

    def labels(self) -> np.ndarray | None:
        """1 for elements that hold or are marked main text, 0 for others; None if the page marks none."""
        n, inside = len(self.tag), self.inside()
        if not inside.any():
            return None
        y = inside.copy()
        for e in range(n - 1, 0, -1):
            y[self.parent[e]] |= y[e]
        return y.astype(float)

    def disguised(self, rng: np.random.Generator, named: bool) -> tuple["Page", list[int]]:
        """The page as another site would have marked it, and the element here that each of its elements comes from.

        What marks the main part becomes a div, gives way to what it holds, or, with named, may stay. Side parts become
        div elements with some class name of a side part or other side elements, may hold a paragraph, and may move
        between the main part's blocks and into its element; some paragraphs of the main part become items, quotes and the like; without named they become div elements without a class.
        """
        page, left, into = Page(""), [0], [0] * len(self.tag)
        names, kinds = sorted(SIDE_TOKENS), ("nav", "header", "footer", "aside", "form")
        flat, stays, moved = rng.random() < 0.4, named and rng.random() < 0.4, named and rng.random() < 0.6
        inside = self.inside()
        page.stream, page.links[0] = [], self.links[0]
        main, part = 0, [0] * len(self.tag)  # the side part that an element is in

        def add(e: int, tag: str, parent: int, tokens: frozenset, links: int) -> int:
            left.append(e)
            page.tag.append(tag)
            page.parent.append(parent)
            page.attributes.append(tokens)
            page.links.append(links)
            return len(page.tag) - 1

        marks = lambda e: self.tag[e] in GROUPS[5] or "articlebody" in self.attributes[e]
        sides = [not marks(e) and (any(t in GROUPS[g] for g in (6, 7, 8, 9, 10)) or (named and bool(a & SIDE_TOKENS))) for e, (t, a) in enumerate(zip(self.tag, self.attributes))]
        for e in range(1, len(self.tag)):
            part[e] = part[self.parent[e]] or (e if sides[e] else 0)
        # side parts that move come last, so that the main part's element is there
        for e in sorted(range(1, len(self.tag)), key=lambda e: moved and part[e] > 0):
            tag, tokens, parent = self.tag[e], self.attributes[e], into[self.parent[e]]
            starts, side = marks(e), sides[e]
            if starts and flat and not stays:
                into[e] = parent
                page.links[parent] += self.links[e]
                continue
            if starts and not stays:
                tag, tokens = "div", frozenset()
            elif side and named and rng.random() < 0.35:
                tag, tokens = kinds[rng.integers(len(kinds))], frozenset()
            elif side:
                tag, tokens = "div", frozenset([names[rng.integers(len(names))]] if named else ())
            elif inside[e] and tag == "p" and rng.random() < 0.3:
                tag = ("li", "blockquote", "td", "div", "h2", "pre")[rng.integers(6)]
                if tag in ("li", "td"):
                    parent = add(e, "ul" if tag == "li" else "tr", parent, frozenset(), 0)
            if moved and main and part[e] == e:
                parent = main
            into[e] = add(e, tag, parent, tokens, self.links[e])
            if starts:
                main = into[e]
            elif side and named and rng.random() < 0.5:  # its text goes to a paragraph of its own
                page.links[into[e]] = 0
                into[e] = add(e, "p", into[e], frozenset(), self.links[e])
        pieces = [(into[e] if e >= 0 else e, t) for e, t in self.stream]
        if moved:  # side parts come up between other blocks
            parts: dict[int, list] = defaultdict(list)
            rest = []
            for (e, _), piece in zip(self.stream, pieces):
                (parts[part[e]] if e >= 0 and part[e] else rest).append(piece)
            ends = [k for k, (e, _) in enumerate(rest) if e < 0] or [len(rest)]
            at = sorted(((ends[rng.integers(len(ends))], own) for own in parts.values()), key=lambda x: -x[0])
            for k, own in at:
                rest[k:k] = [(-1, ""), *own, (-1, "")]
            pieces = rest
        page.stream = pieces
        return page, left

    def decode(self, score: np.ndarray) -> np.ndarray:
        """Elements to keep: the set of greatest total score (log odds for kept, against for dropped) in which every
        kept element's ancestors are kept."""
        n = len(self.tag)
        none = -score.copy()  # the element and all below dropped
        best = score.copy()  # the element kept
        for e in range(n - 1, 0, -1):
            p = self.parent[e]
            none[p] += none[e]
            best[p] += max(best[e], none[e])
        keep = np.zeros(n, bool)
        keep[0] = True
        for e in range(1, n):
            keep[e] = keep[self.parent[e]] and best[e] > none[e]
        return keep

    def text(self, keep: np.ndarray) -> str:
        """Kept blocks in page order, white space within a block as one space."""
        blocks, part = [], []
        for e, t in [*self.stream, (-1, "")]:
            if e < 0:
                if part and (block := " ".join("".join(part).split())):
                    blocks.append(block)
                part = []
            elif keep[e]:
                part.append(t)
        return "\n".join(blocks)


MARKS = len(GROUPS) + BUCKETS + 1  # of an element: its tag's group, its tokens' buckets, whether a token is one of a side part
PLAIN = 2 * MARKS  # features before this come from tags and attributes


@lru_cache(maxsize=4096)
def _buckets(tokens: frozenset[str]) -> tuple[bool, ...]:
    held = {zlib.crc32(t.encode()) % BUCKETS for t in tokens}
    return tuple(k in held for k in range(BUCKETS))


def main_text(page: Page, score: np.ndarray) -> str:
    """Text of the decoded elements. A page whose own marks hold text is never empty: where the trees keep nothing of
    it, as may be with a single short paragraph, what it marks is kept."""
    # the page's own two outer elements hold all of it, so they are no choice
    score = np.where([t in ("html", "body") for t in page.tag], np.maximum(score, 0), score)
    if (text := page.text(page.decode(score))) or not (inside := page.inside()).any():
        return text
    return page.text(inside)


class Forest:
    """Boosted trees as arrays: feature (-1: leaf), threshold, left, right, value."""

    def __init__(self, trees: list[tuple[float, list[tuple]]]):
        self.trees = [(w, *(np.array(c) for c in zip(*nodes))) for w, nodes in trees]

    @classmethod
    def of(cls, model) -> "Forest":
        trees = []
        for weight, tree in zip(model.treeWeights, model.trees):
            nodes: list[list] = []

            def walk(node) -> int:
                k = len(nodes)
                nodes.append([-1, 0.0, 0, 0, node.prediction()])
                if node.subtreeDepth():
                    split = node.split()
                    nodes[k][:4] = split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild())
                return k

            walk(tree._java_obj.rootNode())
            trees.append((weight, nodes))
        return cls(trees)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            out += weight * value[at]
        return 2 * out  # log odds


def rule(x: np.ndarray) -> np.ndarray:
    """Log odds where no page marks its main text: unlinked text outside of side parts."""
    around = [6, 7, 8, 9, 10, MARKS - 1]
    side = np.maximum(x[:, around], x[:, [MARKS + k for k in around]]).max(axis=1)
    link, whole = x[:, PLAIN + 3], x[:, PLAIN + 2]
    return np.where((side > 0) | (link > 0.5), -2.0, np.where(whole > math.log1p(20), 1.0, 0.2))


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Forest | None:
    """Trees from at most sample_pages pages, by hash of page_id; None if none of them marks its main text."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    few = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    # one page for each of at most sample_pages ids, whatever repeats
    sample = pages.where("html is not null").join(F.broadcast(few), "page_id").groupBy("page_id").agg(F.max("html").alias("html")).select("html")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column("html").to_pylist():
                page = Page(html)
                if (y := page.labels()) is None:
                    continue
                rng = np.random.default_rng(zlib.crc32(html.encode("utf-8", "replace")))
                forms = [(page.features(), y, 4.0)]
                for named, weight in ((True, 1.0), (True, 1.0), (False, 0.5)):
                    other, left = page.disguised(rng, named)
                    forms.append((other.features(), y[left], weight))
                x = [row.tolist() for form, _, _ in forms for row in form]
                labels, w = np.concatenate([y for _, y, _ in forms]), np.concatenate([np.full(len(y), w) for _, y, w in forms])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(labels), pa.array(w)], ["x", "label", "weight"])

    data = sample.mapInArrow(rows, "x array<double>, label double, weight double").select(array_to_vector("x").alias("features"), "label", "weight").coalesce(8).cache()  # of at most sample_pages pages
    try:
        kinds = data.agg(F.countDistinct("label")).first()[0]
        if kinds < 2:
            return None
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="weight", maxBins=32, minInstancesPerNode=5).fit(data)
        return Forest.of(model)
    finally:
        data.unpersist()


def extract_main_text(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, blocks joined by line feeds.

    Null or empty html, or a page without main text: empty text of length 0. Broken markup is read as
    browsers do in the common cases (unclosed elements, a head without its end tag, tags cut off at the end).
    Very long pages are read whole. Rows repeat as in pages;
    an empty table gives none; other columns are not read.
    """
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    held = pages.sparkSession.sparkContext.broadcast(train(pages, sample_pages))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for batch in batches:
            htmls = batch.column("html").to_pylist()
            for a, b in slices(htmls):
                parsed = [Page(h or "") for h in htmls[a:b]]
                x = [p.features() for p in parsed]
                all_x = np.concatenate(x)
                score = forest.margin(all_x) if forest else rule(all_x)
                ends = np.cumsum([len(r) for r in x])
                texts = [main_text(p, s) for p, s in zip(parsed, np.split(score, ends[:-1]))]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
