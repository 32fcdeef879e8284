"""Operator 9: main text of web pages by consensus paths of their hosts.

Every page weighs its containers by the text in them that isn't boilerplate or mostly links, and votes for the generalised
tag-class path of the best one: the smallest with all text of its articles, where these hold most of the page, or else with
nearly all of the page and the headings and paragraphs beside it. Spark adds the votes per host, and every page is then
read again: the text is what stands in all containers at the host's winning path, or at the next one that the page has, if
they hold a fair share of the page, or else in the page's own best container.

Null and empty pages, and pages without text outside boilerplate, have an empty text. Pages without a host (null URLs)
vote together. Repeated rows vote as often as they stand and get equal texts; nothing of a text is dropped or capped, and
memory grows with a page's length, however deep its elements lie. Of equal votes the path of more text wins, then the first
in order. An empty table gives an empty result. Columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, stash
from tessera.llm.url_filters import parts

#: Winning paths of a host that a page tries in turn.
PATHS = 3
#: Share of a page that articles hold at least to stand for it, that its best container holds, and that a host's path must.
ARTICLES, NEARLY, FAIR = 0.8, 0.9, 0.5
#: Hosts whose paths are broadcast at most; beyond that a host's pages are dealt to so many tasks.
BROADCAST_HOSTS, SALTS = 200_000, 32

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: Elements without content, with content that is no text, and inline ones; every other element bounds a block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math canvas object video audio textarea select title".split())
_ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I | re.A) for tag in _RAW}
#: Those of them that run to the page's end if nothing closes them; an unclosed other one is only its tag.
_OPEN_ENDED = frozenset("script style textarea title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_BOILER_TAGS = frozenset("nav footer aside form header button dialog menu head".split())
#: Words of a class, id or role that mark boilerplate.
_BOILER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside complementary contentinfo related recommended recommendations share sharing social comment comments disqus respond reply replies discussion cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe signup widget toolbar pagination pager hidden skip alert search login".split()
)
_CONTENT = frozenset("article main content post entry story".split())
#: Those of other people's words and of other pages: an element of theirs is struck whatever it holds. One that is struck for
#: another reason, as a form around the page or a container named for its sidebar, stays if it holds most of the page's text,
#: or an article with a good share of it.
_FOREIGN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommended recommendations comment comments disqus respond reply replies discussion".split())
GOOD, MOST = 0.3, 0.5
#: Words that may stand beside one of those in a class name: ``related-posts`` is boilerplate, ``related-work`` and ``has-sidebar`` aren't; and some more outside of articles.
_NEUTRAL = frozenset("list box section block area wrapper wrap container inner outer links link buttons button bar form posts post articles items item widget top bottom left right inline".split())
_PLACES = frozenset("site main primary secondary global page mobile desktop sub mega footer".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


_MASK = (1 << 63) - 1


def _step(tag: str, names: list[str]) -> str:
    """One step of a generalised path: the tag and its first class, digits as N."""
    return f"/{tag}" + (f".{re.sub('[0-9]+', 'N', names[0].lower())}" if names else "")


class Page:
    """Elements (parent, key of the path, tag, boilerplate?, worth) and blocks (element, text, linked, boilerplate?) of a page.

    Inline elements are elements of their own only where boilerplate begins.
    """

    def __init__(self, source: str):
        self.parent, self.key, self.tag, self.step = array("q", [-1]), array("q", [0]), [""], [""]
        self.mark, self.marked = bytearray(1), bytearray(1)  # what speaks for boilerplate: see _open
        self.texts: list[str] = []
        self.block_at, self.linked_in = array("q"), array("q")
        self._read(source)
        self._strike()
        self._weigh()

    def _open(self, tag: str, attributes: str) -> int:
        """A new element, or the one around an inline one that changes nothing."""
        up = self.stack[-1]
        found = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        names = found.get("class", "").split()
        words = {w.lower() for w in _TOKEN.findall(f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}")} if found else frozenset()
        inside = bool(self.open.get("article") or self.open.get("main"))
        mark = 0 if tag == "header" and inside else 2 if tag in ("form", "header") else int(tag in _BOILER_TAGS)
        if tag not in ("html", "body", "main", "article"):
            named = self._named(words, [*names, found.get("id", ""), found.get("role", "")], inside)
            mark = 1 if mark == 1 else max(mark, named)
            if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
                mark = 1
        elif words & {"comment", "comments", "reply"} and tag == "article":
            mark = 3
        if tag in _INLINE and not mark:
            return up
        step = _step(tag, names)
        self.parent.append(up)
        self.tag.append(tag)
        self.step.append(step)
        self.key.append((self.key[up] * 0x5851F42D4C957F2D + (zlib.crc32(step.encode()) << 20) + len(step)) & _MASK)
        self.mark.append(mark)
        self.marked.append(tag in ("article", "main") or bool(words & _CONTENT))
        return len(self.parent) - 1

    @staticmethod
    def _named(words: frozenset | set, names: list[str], inside: bool) -> int:
        """Whether a whole class, id or role marks boilerplate: 3 if it is foreign, 2 if it may be undone, else 0."""
        found = 0
        if words & _BOILER:
            for name in names:
                parts = {w.lower() for w in _TOKEN.findall(name)}
                hit = parts & (_BOILER - {"header"} if inside or parts & _CONTENT - {"main"} else _BOILER)
                if hit and parts <= (_BOILER | _NEUTRAL if inside else _BOILER | _NEUTRAL | _PLACES):
                    found = max(found, 3 if hit & _FOREIGN else 2)
        return found

    def _strike(self) -> None:
        """Settles which elements are boilerplate: the marked ones, those undone aside, and all within them."""
        hard, whole = bytearray(m == 1 or m == 3 for m in self.mark), array("q", bytes(8 * len(self.parent)))
        articles = array("q", (t in ("article", "main") and not m for t, m in zip(self.tag, self.mark, strict=True)))
        for k in range(1, len(hard)):
            hard[k] |= hard[self.parent[k]]
        for at, text in zip(self.block_at, self.texts, strict=True):
            whole[at] += 0 if hard[at] else len(text)
        whole, articles = self._sums(whole), self._sums(articles)
        self.boiler = bytearray(len(self.mark))
        for k in range(1, len(self.mark)):
            stays = self.mark[k] == 2 and (whole[k] > MOST * whole[0] or articles[k] and whole[k] > GOOD * whole[0])
            self.boiler[k] = self.boiler[self.parent[k]] or bool(self.mark[k]) and not stays
        self.block_boiler = bytearray(self.boiler[at] for at in self.block_at)

    def path(self, k: int) -> str:
        """The generalised path of an element as text."""
        steps = []
        while k > 0:
            steps.append(self.step[k])
            k = self.parent[k]
        return "".join(reversed(steps))

    def _flush(self) -> None:
        if self.pieces:
            text = _SPACE.sub(" ", html.unescape("".join(self.pieces))).strip()
            if text:
                at = self.stack[-1]
                self.texts.append(text)
                self.block_at.append(at)
                self.linked_in.append(min(self.linked, len(text)))
            self.pieces, self.linked = [], 0

    def _close(self, tag: str) -> None:
        """Ends the innermost open ``tag`` and all within it."""
        while len(self.stack) > 1:
            self.stack.pop()
            name = self.names.pop()
            self.open[name] -= 1
            if name == tag:
                return

    def _after(self, source: str, tag: str, at: int) -> int:
        """Where an element whose content is no text ends; elements that nothing closes are searched for once."""
        if tag in self.unclosed:
            return at
        if m := _ENDS[tag].search(source, at):
            return m.start()
        if tag in _OPEN_ENDED:
            return len(source)
        self.unclosed.add(tag)
        return at

    def _read(self, source: str) -> None:
        self.stack, self.names, self.open, self.pieces, self.linked, self.unclosed = array("q", [0]), [""], {}, [], 0, set()
        at, last = 0, source.rfind(">") + 1  # no tag begins beyond it
        if (comment := source.find("<!--", last)) >= 0:
            source = source[:comment]
        while True:
            m = _TAG.search(source, at, last) if at < last else None
            piece = source[at : m.start() if m else len(source)]
            if piece:
                self.pieces.append(piece)
                if self.open.get("a"):
                    self.linked += len(piece)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if at >= last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(source)
                continue
            inline = tag in _INLINE
            if m[1] or m[4]:
                if self.open.get(tag):
                    if not inline or self.tag[self.stack[-1]] in _INLINE:
                        self._flush()
                    self._close(tag)
                elif tag == "p":
                    self._flush()
                continue
            if tag == "br":
                self.pieces.append(" ")
                continue
            attributes = m[3] or m[6] or ""
            if tag in _RAW:
                if tag in _OPEN_ENDED or not attributes.endswith("/") and not m[0].endswith("/>"):
                    at = self._after(source, tag, at)
                continue
            if not inline:
                self._flush()
                if self.open.get("p"):
                    self._end_paragraph()
                for other in _CLOSES.get(tag, ()):
                    if self.open.get(other):
                        self._end_item(other)
            if tag in _VOID:
                continue
            k = self._open(tag, attributes)
            if inline and k != self.stack[-1]:
                self._flush()
            self.stack.append(k)
            self.names.append(tag)
            self.open[tag] = self.open.get(tag, 0) + 1
        self._flush()

    def _end_paragraph(self) -> None:
        for name in reversed(self.names):
            if name == "p":
                return self._close("p")
            if name not in _INLINE:
                return None
        return None

    def _end_item(self, tag: str) -> None:
        for name in reversed(self.names):
            if name == tag:
                return self._close(tag)
            if name in ("ul", "ol", "dl", "table", "select"):
                return None
        return None

    def _sums(self, own: array) -> array:
        """Sums over every element and all within it; parents stand before children."""
        sums = array("q", own)
        for k in range(len(sums) - 1, 0, -1):
            sums[self.parent[k]] += sums[k]
        return sums

    def _weigh(self) -> None:
        """Worth of every element: its text without boilerplate and blocks of links; nothing lowers an ancestor's."""
        self.own = array("q", bytes(8 * len(self.parent)))
        for at, text, linked, boiler in zip(self.block_at, self.texts, self.linked_in, self.block_boiler, strict=True):
            if not boiler:
                self.own[at] += max(0, len(text) - 2 * linked)
        self.worth = self._sums(self.own)

    def best(self) -> int:
        """The smallest container with all text of the articles if these hold most of the page, else with nearly all of the page."""
        inside = bytearray(m and not b and t not in _INLINE for m, b, t in zip(self.marked, self.boiler, self.tag, strict=True))
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parent[k]]
        target = array("q", (w if i else 0 for w, i in zip(self.own, inside, strict=True)))
        if not self.worth[0]:
            return 0
        if articles := sum(target) >= ARTICLES * self.worth[0]:
            held = self._sums(target)
        else:
            held = self.worth
        least = held[0] * (1 if articles else NEARLY)
        fit = (k for k in range(len(held)) if held[k] >= least and not self.boiler[k] and self.tag[k] not in _INLINE and self.tag[k] not in _PARAGRAPHS and self.tag[k] != "li")
        best = max(fit, default=0)  # they lie in each other, as each holds more than half
        return best if articles else self._with_headings(best)

    def _with_headings(self, k: int) -> int:
        """The highest container around ``k`` that adds only headings and paragraphs of its own."""
        every, beside = (array("q", bytes(8 * len(self.parent))) for _ in range(2))
        for at, boiler in zip(self.block_at, self.block_boiler, strict=True):
            every[at] += not boiler
            if not boiler and self.tag[at] in _PARAGRAPHS:
                beside[self.parent[at]] += 1
        every, found = self._sums(every), k
        while k:
            up = self.parent[k]
            more = every[up] - every[k]
            if more > beside[up]:
                break
            found, k = (up if more else found), up
        return found

    def at(self, key: int) -> list[int]:
        """All elements with text at a path, if together they hold a fair share of the page."""
        fit = [k for k, x in enumerate(self.key) if x == key and not self.boiler[k] and self.worth[k] > 0]
        return fit if sum(self.worth[k] for k in fit) >= FAIR * self.worth[0] else []

    def text(self, elements: list[int]) -> str:
        inside = bytearray(len(self.parent))
        for k in elements:
            inside[k] = 1
        for k in range(min(elements) + 1, len(self.parent)):
            inside[k] |= inside[self.parent[k]]
        return "\n\n".join(text for at, text, boiler in zip(self.block_at, self.texts, self.block_boiler, strict=True) if inside[at] and not boiler)


_VOTES = "host string, key bigint, path string, worth bigint"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(source.as_py() or "")
            k = page.best()
            if page.worth[k] > 0:
                rows.append((host, page.key[k], page.path(k), page.worth[k]))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds, strict=True)], ["host", "key", "path", "worth"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for source, keys in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            page = Page(source.as_py() or "")
            found = next((k for p in keys or () if (k := page.at(p))), None)
            out.append(page.text(found or [page.best()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def consensus(pages: DataFrame) -> DataFrame:
    """Winning paths of every host, most votes first, PATHS at most: host, keys (hashes of the paths) and paths."""
    votes = pages.select(parts(F.col("url"))[0].alias("host"), "html").mapInArrow(_votes, _VOTES)
    votes = votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("votes"), F.sum("worth").alias("worth"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("worth"), "path"))
    top = votes.withColumn("rank", rank).where(F.col("rank") <= PATHS)
    top = top.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "path"))).alias("top"))
    return top.select("host", F.col("top.key").alias("keys"), F.col("top.path").alias("paths"))


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)
    winners = stash(consensus(pages).select(F.col("host").alias("_host"), "keys"), "paths")
    d = pages.select("page_id", "url", "html").withColumn("host", parts(F.col("url"))[0])
    if winners.count() <= BROADCAST_HOSTS:
        d = d.join(F.broadcast(winners), F.col("host") == F.col("_host"), "left")
    else:  # the pages of a large host go to several tasks
        salt = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS))
        winners = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        d = d.withColumn("salt", salt).join(winners, (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return d.select("page_id", "url", "html", "keys").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars bigint")
