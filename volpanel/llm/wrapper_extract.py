"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over a host's token streams, kept as a tree: each element has an ordered list of parts,
a part may be optional or repeated, and elements with text of their own are text slots. Inference starts from one page and aligns the next
one with it, element by element along their longest common subsequence: a part that only one side has becomes optional, neighbours of
one kind (or neighbouring groups of kinds, as in a definition list) become one repeated part, and differing texts become slots, while a
slot remembers whether all pages agreed on its text. Aligning two wrappers works like aligning two pages, so each batch of pages
is reduced to one wrapper per host where it lies, these are merged in shares of the host, and the shares once more: a host with a third of
all pages is spread over many tasks.

A slot is main text if neither it nor an element around it is a menu, header, footer, sidebar, notice, advert, form, script, style or comment list by
its tag or by a word of its class, id or role, and it lies in the wrapper's article. Hosts without an article element give
the blocks that are more than links and whose texts are not all the same on at least ``AGREE`` different pages. A page's parts are paired with the
wrapper's with repeated ones as often as needed; a part without a partner is unlike all pages, so nothing in it counts as agreed.

Defined cases: NULL html is empty, NULL urls share one host of their own; repeated pages are extracted row by row; unclosed elements end with the one
around them, an unclosed comment or script with the page; elements nest to any depth; copies of a page agree as one page; an empty table gives an empty table; other columns than page_id, url
and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from volpanel.llm.common import partitions
from volpanel.llm.url_filter import with_parts
from volpanel.session import stage

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>"""
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Opening one of the keys ends an open element of the values, unless one of FENCE lies between.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"},
}
FENCE = frozenset("ul ol dl table select menu body article section div".split())
ARTICLE = frozenset(["article", "main"])
NO_TEXT_TAGS = frozenset(
    "head nav aside footer form button select option fieldset menu dialog script style noscript template iframe svg math object textarea title canvas audio video map".split()
)
#: Words of a class, id or role that mark what is around an article.
NO_TEXT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar "
    "footer sidebar aside widget notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments discussion replies reply respond disqus search searchbox toolbar pagination pager copyright complementary contentinfo alert".split()
)
LONGEST_GROUP = 3
AGREE = 3  # so many different pages with one text make it the host's
WORD = re.compile(r"\w")


@dataclass
class Element:
    """An element of a page: its kind and, in order, texts and elements. ``page`` tells different pages apart, in their roots."""

    key: str
    tag: str
    content: list[str | Element] = field(default_factory=list)
    page: int = 0


@dataclass
class Part:
    """A part of a wrapper. ``texts`` is (least, greatest) hash of its own text, None without any; ``told`` has the least marks of the pages
    with such a text, ``AGREE`` at most."""

    key: str
    parts: list[Part] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    texts: tuple[int, int] | None = None
    told: tuple[int, ...] = ()
    members: list[Element] = field(default_factory=list)

    def dump(self) -> list:
        """The parts from the top, each before its own parts and with their number."""
        out, todo = [], [self]
        while todo:
            p = todo.pop()
            out.append([p.key, int(p.optional), int(p.repeated), list(p.texts) if p.texts else None, list(p.told), len(p.parts)])
            todo += reversed(p.parts)
        return out

    @classmethod
    def load(cls, raw: list) -> Part:
        done: list[Part] = []
        for key, optional, repeated, texts, told, n in reversed(raw):
            parts = done[len(done) - n :][::-1]
            del done[len(done) - n :]
            done.append(cls(key, parts, bool(optional), bool(repeated), tuple(texts) if texts else None, tuple(told)))
        return done[0]


def _run(call: Generator) -> Part | list[Part]:
    """The result of a generator that yields its calls of other generators; they nest on a list, to any depth."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _key(tag: str, rest: str) -> str:
    words = []
    for m in ATTRIBUTE.finditer(rest):
        words += (m[2] or m[3] or m[4] or "").lower().split()
    return " ".join([tag, *sorted({re.sub(r"\d+", "0", w) for w in words})])


def parse(page: str) -> Element:
    """Tree of elements; character references are decoded in texts."""
    mark = hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=6).digest()
    root = Element("", "", page=int.from_bytes(mark, "big"))
    stack, at, n = [root], 0, len(page)
    opened: Counter[str] = Counter()

    def close(tags: set[str] | frozenset[str], fence: frozenset[str] = frozenset()) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                for e in stack[i:]:
                    opened[e.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in fence:
                return

    while at < n:
        m = TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            stack[-1].content.append(entities.unescape(page[at:begin]))
        if not m:
            break
        at = m.end()
        if m["end"]:
            close({m["end"].lower()})
            continue
        tag = (m["tag"] or m["odd"] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            stack[-1].content.append(" " if tag in ("br", "hr", "wbr") else "")
            continue
        if tag in CLOSES_P:
            close({"p"}, FENCE - {"div", "section", "article"} | {"button"})
        if tag in ENDS:
            close(ENDS[tag], FENCE - ENDS[tag])
        rest = m["rest"] or ""
        element = Element(_key(tag, rest), tag)
        stack[-1].content.append(element)
        if rest.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = (page.find(">", end.start()) + 1 or n) if end else n
            continue
        stack.append(element)
        opened[tag] += 1
    return root


def _own_text(element: Element) -> str:
    return " ".join("".join([c for c in element.content if isinstance(c, str)]).split())


def skeleton(element: Element, texts: bool = True) -> Part:
    """The wrapper of one page; without ``texts`` its slots don't remember theirs."""
    order, todo = [], [element]
    while todo:
        e = todo.pop()
        own = [c for c in e.content if isinstance(c, Element)]
        order.append((e, len(own)))
        todo += own[::-1]
    done: list[Part] = []
    for e, n in reversed(order):
        text = _own_text(e) if texts else ""
        mark = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        parts = done[len(done) - n :][::-1]
        del done[len(done) - n :]
        done.append(Part(e.key, fold(parts), texts=(mark, mark) if text else None, told=(element.page,) if text else (), members=[e]))
    return done[0]


def fold(parts: list[Part]) -> list[Part]:
    """Neighbouring groups of up to LONGEST_GROUP parts of the same kinds become one repeated group."""
    return _run(_fold(parts)) if len(parts) > 1 else parts


def _fold(parts: list[Part]) -> Generator:
    for width in range(1, LONGEST_GROUP + 1):
        out: list[Part] = []
        for part in parts:
            out.append(part)
            while len(out) >= 2 * width and [p.key for p in out[-width:]] == [p.key for p in out[-2 * width : -width]]:
                last = out[-width:]
                del out[-width:]
                for i, p in enumerate(last):
                    merged = yield _align(out[-width + i], p)
                    merged.repeated = True
                    merged.texts = (0, 1) if merged.texts else None  # texts of repeated parts are data
                    out[-width + i] = merged
        parts = out
    return parts


def _common(a: list[Part], b: list[Part]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of kinds."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin].key == b[begin].key:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end].key == b[-1 - end].key:
        end += 1
    x, y = a[begin : len(a) - end], b[begin : len(b) - end]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].key == y[j].key else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [(k, k) for k in range(begin)], 0, 0
    while i < len(x) and j < len(y):
        if x[i].key == y[j].key:
            pairs.append((begin + i, begin + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def align(a: Part, b: Part) -> Part:
    """The wrapper of everything that either of two wrappers of one kind describes."""
    return _run(_align(a, b))


def _align(a: Part, b: Part) -> Generator:
    told = a.told if a.told == b.told else tuple(sorted({*a.told, *b.told})[:AGREE])
    out = Part(a.key, optional=a.optional or b.optional, repeated=a.repeated or b.repeated, told=told, members=a.members + b.members)
    if a.texts and b.texts:
        out.texts = (min(a.texts[0], b.texts[0]), max(a.texts[1], b.texts[1]))
    else:
        out.texts = a.texts or b.texts
    i = j = 0
    parts: list[Part] = []
    for x, y in [*_common(a.parts, b.parts), (len(a.parts), len(b.parts))]:
        for only in (*a.parts[i:x], *b.parts[j:y]):
            only.optional = True
            parts.append(only)
        if x < len(a.parts):
            parts.append((yield _align(a.parts[x], b.parts[y])))
        i, j = x + 1, y + 1
    out.parts = (yield _fold(parts)) if len(parts) > 1 else parts
    return out


def _partners(page: list[Part], wrapper: list[Part]) -> list[Part | None]:
    """The wrapper's part for each part of a page, for as many as can have one in order; from a repeated part on, its run may begin again."""
    back: list[int] = []  # the first part that may follow each one
    for j, p in enumerate(wrapper):
        back.append(j + 1 if not p.repeated else back[-1] if j and wrapper[j - 1].repeated else j)
    at: list[int] = []
    j = 0
    for x in page:
        k = next((k for k in range(j, len(wrapper)) if wrapper[k].key == x.key), None)
        if k is None:
            break
        at.append(k)
        j = back[k]
    else:
        return [wrapper[k] for k in at]
    best = [[0] * (len(wrapper) + 1) for _ in range(len(page) + 1)]
    for i in range(len(page) - 1, -1, -1):
        for j in range(len(wrapper) - 1, -1, -1):
            with_it = best[i + 1][back[j]] + 1 if page[i].key == wrapper[j].key else 0
            best[i][j] = max(with_it, best[i + 1][j], best[i][j + 1])
    found: list[Part | None] = []
    i = j = 0
    while i < len(page):
        if j < len(wrapper) and page[i].key == wrapper[j].key and best[i][j] == best[i + 1][back[j]] + 1:
            found.append(wrapper[j])
            i, j = i + 1, back[j]
        elif j < len(wrapper) and best[i][j] == best[i][j + 1]:
            j += 1
        else:
            found.append(None)
            i += 1
    return found


def _no_text(key: str, inside_article: bool) -> bool:
    tag, *words = key.split(" ")
    if tag in NO_TEXT_TAGS or (tag == "header" and not inside_article):
        return True
    return any(piece in NO_TEXT_WORDS for w in words for piece in re.split(r"[-_:]+", w)) and tag not in ("body", "html")


def has_article(wrapper: Part) -> bool:
    todo = [wrapper]
    while todo:
        p = todo.pop()
        if _no_text(p.key, False):
            continue
        if p.key.split(" ")[0] in ARTICLE:
            return True
        todo += p.parts
    return False


def slots(page: Part, wrapper: Part | None, article: bool) -> Iterator[tuple[Element, bool, bool]]:
    """Elements of the page whose own text may be main text, by their places in the wrapper: (element, in a link, agreed by the host's pages)."""
    todo: list[tuple[Part, Part | None, bool, bool]] = [(page, wrapper, False, False)]
    while todo:
        own, known, inside, link = todo.pop()
        tag = own.key.split(" ")[0]
        if _no_text(own.key, inside):
            continue
        inside = inside or tag in ARTICLE
        link = link or tag == "a"
        agreed = bool(known and known.texts and known.texts[0] == known.texts[1] and len(known.told) >= AGREE and not known.repeated)
        if inside:
            yield from ((e, False, False) for e in own.members)
        elif not article:
            yield from ((e, link, agreed) for e in own.members)
        todo += [(x, y, inside, link) for x, y in zip(own.parts, _partners(own.parts, known.parts) if known else [None] * len(own.parts))]


def blocks(root: Element, chosen: dict[int, tuple[bool, bool]]) -> list[str]:
    """Texts of the chosen elements in page order, one for each block; blocks of links alone and blocks agreed as a whole are left out."""
    out: list[str] = []
    line: list[tuple[str, bool, bool]] = []

    def flush() -> None:
        text = " ".join("".join([t for t, _, _ in line]).split())
        if text:
            told = [(t, link, agreed) for t, link, agreed in line if t.strip()]
            only_links = any(link for _, link, _ in told) and not any(WORD.search(t) for t, link, _ in told if not link)
            if not only_links and not all(agreed for *_, agreed in told):
                out.append(text)
        line.clear()

    todo: list[tuple[Element, int] | None] = [(root, 0)]
    while todo:
        element, i = todo.pop()
        if i == 0 and element.tag not in INLINE:
            flush()
        for k in range(i, len(element.content)):
            c = element.content[k]
            if isinstance(c, Element):
                todo += [(element, k + 1), (c, 0)]
                break
            if id(element) in chosen:
                line.append((c, *chosen[id(element)]))
        else:
            if element.tag not in INLINE:
                flush()
    flush()
    return out


def extract(page: str | None, wrapper: Part) -> str:
    """Main text of a page of the wrapper's host."""
    root = parse(page or "")
    own = skeleton(root, texts=False)

    def found(article: bool) -> str:
        return "\n".join(blocks(root, {id(e): marks for e, *marks in slots(own, wrapper, article)}))

    article = has_article(wrapper)
    return found(article) or (found(False) if article and not has_article(own) else "")


def _dumps(part: Part) -> str:
    return json.dumps(part.dump(), separators=(",", ":"))


@lru_cache(maxsize=512)
def _loads(raw: str) -> Part:
    return Part.load(json.loads(raw))


def _merge(raws: list[str]) -> str:
    """Wrappers aligned one after the other, in an order that their texts fix."""
    kept, *rest = sorted(raws)
    out = Part.load(json.loads(kept))
    for raw in rest:
        out = align(out, Part.load(json.loads(raw)))
    return _dumps(out)


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper: one row per host of the columns ``host`` and ``html``."""
    shares = partitions(pages.sparkSession)

    def reduce_batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known: dict[str, Part] = {}
            for host, page in zip(part["host"], part["html"]):
                own = skeleton(parse(page or ""))
                merged = align(known[host], own) if host in known else own
                known[host] = merged
                _forget(merged)
            yield pd.DataFrame({"host": list(known), "wrapper": [_dumps(p) for p in known.values()]})

    def merge_rows(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [_merge(rows["wrapper"].tolist())]})

    return (
        pages.select("host", "html").mapInPandas(reduce_batch, "host string, wrapper string")
        .groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(shares)).alias("share")).applyInPandas(merge_rows, "host string, wrapper string")
        .groupBy("host").applyInPandas(merge_rows, "host string, wrapper string")
    )


def _forget(part: Part) -> None:
    """Lets go of the pages behind a wrapper."""
    todo = [part]
    while todo:
        p = todo.pop()
        p.members = []
        todo += p.parts


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    hosted = with_parts(pages.select("page_id", "url", "html")).drop("path").withColumn("host", F.coalesce("host", F.lit("")))
    wrappers = stage(infer(hosted), "wrappers").withColumnRenamed("host", "own_host")

    @F.pandas_udf("string")
    def extracted(page: pd.Series, wrapper: pd.Series) -> pd.Series:
        return pd.Series([extract(p, _loads(w)) for p, w in zip(page, wrapper)], dtype=object)

    joined = hosted.join(wrappers, F.col("host") == F.col("own_host"), "left")
    return joined.select("page_id", "url", extracted("html", "wrapper").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
