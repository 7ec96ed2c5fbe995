"""Main-text extraction by two-pass block rules.

Pass one looks at each block alone, wherever it stands.  Blocks in boilerplate containers or with many
link characters are bad; long blocks with many stop-words are good.  All others are ambiguous: short
ones, those with few stop-words (``far``), and those in between (``near``).  Where no block of a page is
good, the stop-words are of no listed language, and length stands in for them.

Pass two gives each ambiguous block the label of its nearest decided neighbours.  Boilerplate
containers speak for their own blocks alone.  An ``article`` or ``main`` element only breaks ties:
neighbours on the other side of its edge do not count, and where no neighbour decides, a block inside is
good and, on a page that has such an element, a block outside is bad.

The good blocks, in page order, are the text.  A page is read once from front to back: each character is
looked at a bounded number of times, whatever tags or quotes stay open, so time is linear in its length.
An open tag at the end of a cut page is dropped; a quote that never closes ends with its tag.

Edge cases: a null or empty page gives an empty text; repeated rows give equal rows; null ids and
urls pass through; very long pages are read whole; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import small_batches
from tessera.llm.store import table

#: Characters up to which a block is short, and from which it is long.
SHORT, LONG = 70, 200
#: Shares: link characters that make a block bad, stop-words that make a long one good, and those that lean to it.
LINKS, STOP_GOOD, STOP_NEAR = 0.33, 0.30, 0.15

# fixed values: common function words of the languages the library knows
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he her his i in is it its not of on or she that the their they this to was we were which with you "
    "aber als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so um und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en entre es esta este la las lo los más no o para pero por que se sin sobre su sus un una y ya "
    "che da del della di e gli i il in la le non per più si sono un una "
    "com da das do dos e em na nas no nos o os para por que se um uma de een en het in is met niet op te van voor".split()
)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_SCOPE = frozenset("article aside body button datalist details dialog div dl fieldset figure footer form head header html label main map menu nav object ol picture section select span summary table tbody td tfoot th thead title tr ul video audio canvas".split())
_BAD_TAGS = frozenset("aside button datalist dialog fieldset footer form head label menu nav object option select title video audio canvas map".split())
_RAW = frozenset("script style noscript template iframe textarea svg math noembed noframes xmp".split())
#: Words of class, id and role that mark boilerplate.
_BAD_WORD = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|overlay|subscribe|newsletter|signup|login|paywall"
    r"|side-?bar\w*|widgets?|menus?|nav\w*|breadcrumbs?|crumbs|pagination|pager|toc|tags?|share|sharing|social|related|recommend\w*|trending|teasers?|masthead|header|footer|foot|copyright|legal|skip\w*"
    r"|comments?|commentlist|respond|replies|reply|disqus|discussion|contentinfo|complementary|search|toolbar|hidden|visually-hidden|sr-only)(?:$|[^a-z])"
)
_GOOD_WORD = re.compile(r"(?:^|[^a-z])(?:article-?(?:body|text|content)?|post-?(?:body|content)|entry-?content|main-?content|story)(?:$|[^a-z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The end of a tag, or a quote that opens a value.
_STOP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|overlay|subscribe|newsletter|signup|login|paywall"
    r"|side-?bar\w*|widgets?|menus?|nav\w*|breadcrumbs?|crumbs|pagination|pager|toc|tags?|share|sharing|social|related|recommend\w*|trending|teasers?|masthead|header|footer|foot|copyright|legal|skip\w*"
    r"|comments?|commentlist|respond|replies|reply|disqus|discussion|contentinfo|complementary|search|toolbar|hidden|visually-hidden|sr-only)(?:$|[^a-z])"
)
_GOOD_WORD = re.compile(r"(?:^|[^a-z])(?:article-?(?:body|text|content)?|post-?(?:body|content)|entry-?content|main-?content|story)(?:$|[^a-z])")
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/!?])[^<>]*\Z", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[^\W\d_]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(text)}


def _bad_container(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _BAD_TAGS:
        return True
    if tag == "header":
        return not inside  # an article's own header has its title
    if not attrs.strip() or tag in ("body", "html", "article", "main"):
        return False
    a = _attributes(attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    marks = " ".join(a.get(k, "") for k in ("class", "id", "role", "aria-label", "itemprop"))
    return bool(marks.strip()) and bool(_BAD_WORD.search(marks)) and not _GOOD_WORD.search(marks)


class _Scanner:
    """Reads tags one by one.  What is looked for and missing once is never looked for again, so scanning is linear."""

    def __init__(self, page: str):
        self.page = page
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.missing.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at *at*; -1 if there is none."""
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            close = self.find(m[0][-1], m.end())
            at = m.end() if close < 0 else close + 1
        return -1

    def raw_end(self, tag: str, at: int) -> int:
        """Place behind the closing tag of an element without markup; -1 if there is none."""
        if f"</{tag}" in self.missing:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if not m:
            self.missing.add(f"</{tag}")
            return -1
        return m.end()

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(text before, tag, attributes); the tag is '' for what is no element, and begins with / if it closes one."""
        page, at, begin = self.page, 0, 0
        while (k := page.find("<", at)) >= 0:
            after = page[k + 1 : k + 2]
            name = None
            if after == "!" or after == "?":
                if page.startswith("<!--", k):
                    end = page.find("-->", k + 2)
                    stop = end + 3 if end >= 0 else -1
                else:
                    stop = page.find(">", k) + 1 or -1
            else:
                name = _NAME.match(page, k + 1 + (after == "/"))
                if not name:  # a lone <
                    at = k + 1
                    continue
                stop = self.tag_end(name.end()) + 1 or -1
            if stop < 0:  # the page ends inside
                yield page[begin:k], "", ""
                return
            tag = name[0].lower() if name else ""
            attrs = page[name.end() : stop - 1] if name and after != "/" else ""
            if tag in _RAW and after != "/" and not attrs.endswith("/"):
                end = self.raw_end(tag, stop)
                if end >= 0 or tag in ("script", "style", "textarea"):
                    yield page[begin:k], "", ""
                    if end < 0:
                        return
                    begin = at = end
                    continue
            yield page[begin:k], f"/{tag}" if after == "/" else tag, attrs
            begin = at = stop
        yield page[begin:], "", ""


class Block(NamedTuple):
    text: str
    links: int  # characters in links
    bad: bool  # in a boilerplate container
    inside: bool  # in an article


def blocks(page: str) -> Iterator[Block]:
    """Every block with text, in page order."""
    scope: list[tuple[str, bool, bool]] = []  # tag, bad, inside an article, of each open container
    depth: Counter[str] = Counter()
    parts: list[str] = []
    links = linked = 0

    def pop(k: int) -> None:
        depth.subtract([x[0] for x in scope[k:]])
        del scope[k:]

    def close() -> Iterator[Block]:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                yield Block(text, min(links, len(text)), *(scope[-1][1:] if scope else (False, False)))
            parts.clear()
            links = 0

    for piece, tag, attrs in _Scanner(page):
        if piece:
            parts.append(piece)
            if linked:
                links += len(" ".join(html.unescape(piece).split()))
        if tag.startswith("/"):
            tag = tag[1:]
            if tag == "a":
                linked = 0
            elif tag in _SCOPE or tag in _BLOCK:
                if tag != "span":
                    yield from close()
                if depth[tag]:
                    k = next(k for k in range(len(scope) - 1, -1, -1) if scope[k][0] == tag)
                    if tag == "span" and scope[k][1]:
                        yield from close()
                    pop(k)
        elif tag == "a":
            linked = 1
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK or tag in _SCOPE:
            around, inside = scope[-1][1:] if scope else (False, False)
            bad = around or _bad_container(tag, attrs, inside)
            if tag != "span" or bad:
                yield from close()
            if tag in _BLOCK:
                linked = 0
            if tag in _SCOPE and not attrs.endswith("/"):
                scope.append((tag, bad, inside or tag in ("article", "main")))
                depth[tag] += 1
            elif bad and not around:
                # a bad leaf (such as <p class="ad">) lasts until it closes or the next block begins
                scope.append((tag, True, inside))
                depth[tag] += 1
            elif scope and scope[-1][0] in _BLOCK and scope[-1][0] not in _SCOPE:
                pop(len(scope) - 1)
    yield from close()


def _alone(b: Block, listed: bool = True) -> str:
    """Pass one: good, bad, or ambiguous (near, far, short); without *listed* stop-words, length stands in for them."""
    if b.bad or b.links > LINKS * len(b.text):
        return "bad"
    if len(b.text) < SHORT:
        return "short"
    if not listed:
        return "good" if len(b.text) > LONG else "near"
    words = [w.lower() for w in _WORD.findall(b.text)]
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= STOP_GOOD and len(b.text) > LONG:
        return "good"
    return "near" if stop >= STOP_NEAR else "far"


def _inherit(own: list[int], label: list[str], speaks: list[bool], alone: dict[str, bool]) -> Iterator[int]:
    """Pass two: the ambiguous blocks of one side of an article's edge that are good; *alone* holds where no neighbour decides."""
    near: list[list[int | None]] = []
    for walk in (own, own[::-1]):
        last, seen = None, []
        for k in walk:
            seen.append(last)
            last = k if speaks[k] else last
        near.append(seen)
    for k, p, n in zip(own, near[0], near[1][::-1]):
        if label[k] in ("good", "bad"):
            continue
        if p is None and n is None:
            good = alone[label[k]]
        elif p is None or n is None:
            good = label[n if p is None else p] == "good"
        elif label[p] == label[n] or k - p != n - k:
            good = label[p if k - p <= n - k else n] == "good"
        else:  # between a good and a bad one, at equal distance
            good = label[k] == "near"
        if good:
            yield k


def extract(page: str | None) -> str:
    """The main text of a page."""
    found = list(blocks(page or ""))
    label = [_alone(b) for b in found]
    if "good" not in label:
        label = [_alone(b, False) for b in found]
    good = {k for k, x in enumerate(label) if x == "good"}
    speaks = [x == "good" or x == "bad" and not b.bad for x, b in zip(label, found)]
    inside = [k for k, b in enumerate(found) if b.inside]
    outside = [k for k, b in enumerate(found) if not b.inside]
    good |= {*_inherit(inside, label, speaks, dict.fromkeys(("near", "far", "short"), True))}
    # without an article, a page with nothing decided is all that there is
    good |= {*_inherit(outside, label, speaks, dict.fromkeys(("near", "far", "short"), not inside))}
    return " ".join(found[k].text for k in sorted(good))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of *pages*."""
    small_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        _run, "page_id long, url string, text string, n_chars long"
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
