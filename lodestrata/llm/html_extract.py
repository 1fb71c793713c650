"""Main text of web pages, with site templates removed.

Each element subtree has a content hash and a place: the path of tags, classes and
ids from the root. Spark counts, per host, on how many pages each subtree hash
recurs at each place. A place is a template's if nearly all that stands there, over
the host's pages, are subtrees that recur on several pages; such subtrees go, and so
do elements whose tag, class or heading says that they are not the article. A passage
that many articles share does not make its place a template, since most of what stands
at the same place does not recur; and the block that holds most of a page's text, with
its running text and its larger parts, is never counted, so that near copies of an
article make no template of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import Workspace, read, small

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+|<", re.S)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
CLASS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NOT_TEXT = frozenset("script style noscript template head title nav footer aside form iframe svg math canvas object embed button select option input textarea audio video dialog menu".split())
#: Words of class, id and role names of what is no article, and words that may stand beside them (fixed values).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login "
    "comment comments disqus respond replies sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead share sharing social related recommended popup modal overlay widget toolbar complementary contentinfo search".split()
)
BESIDE = frozenset("thread user users reader readers visitor visitors site page main top bottom left right list box bar block area section wrapper wrap container inner outer posts links buttons icons item items form primary secondary global group panel slot unit region".split())
NAMES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Headings of what readers say (fixed values).
REMARKS = re.compile(r"(?:\d+\s+)?(?:reader |user |all |latest |post a |leave a |add a )?(?:comments?|replies|responses)(?:\s*\(\d+\))?:?", re.I)
#: The text of an article itself.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th tr tbody thead tfoot table".split())
#: Elements that a new one of the same kind closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "html", "body", "option", "legend", "caption"}
SPACE = re.compile(r"\s+")
#: Characters of text from which on it can be told where most of a page's text stands.
PARAGRAPH = 200


SCOPES = frozenset("li dt dd tr td th option ul ol dl table select".split())


class Element:
    __slots__ = ("tag", "mark", "place", "start", "end", "items", "parent", "inside", "block", "scope", "size", "digest")

    def __init__(self, tag: str, mark: str, place: int, start: int, parent: Element | None):
        self.tag, self.mark, self.place, self.start, self.parent = tag, mark, place, start, parent
        self.end, self.items, self.size, self.digest = -1, [], 0, b""
        #: Whether an article or main element stands around it.
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        #: The nearest block and the nearest part of a list or table, itself included.
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.scope = self if tag in SCOPES or parent is None else parent.scope


def parse(page: str) -> tuple[Element, list[Element]]:
    """A page's element tree and all its elements, parents first. Unclosed elements end with what closes them; stray end tags are skipped.

    Open elements are counted by tag, so an end tag without a start costs nothing, and
    each element is closed once: the time is linear in the page, however deep it nests.
    """
    root = Element("", "", 0, 0, None)
    here, every, at, n = root, [], 0, len(page)
    opened: Counter[str] = Counter()

    def close(up: Element, inner: int, end: int) -> Element:
        """Ends ``up`` at ``end`` and what is open inside it at ``inner``."""
        e = here
        while e is not up:
            e.end = inner
            opened[e.tag] -= 1
            e = e.parent
        up.end = end
        opened[up.tag] -= 1
        return up.parent

    while at < n:
        m = TOKEN.match(page, at)
        token, start, at = m.group(), at, m.end()
        if token[0] != "<" or token == "<":
            here.items.append(token)
            continue
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                here.items.append(html.escape(token[9:].removesuffix("]]>"), quote=False))
            continue
        tag = TAG.match(token).group(1).lower()
        if token[1] == "/":
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                here = close(up, start, at)
            continue
        if tag in CLOSES_P and here.block.tag == "p":
            here = close(here.block, start, start)
        if tag in CLOSES:
            up = here.scope
            while up.parent is not None and up.tag not in CLOSES[tag] and up.tag not in ("ul", "ol", "dl", "table", "select"):
                up = up.parent.scope
            if up.tag in CLOSES[tag]:
                here = close(up, start, start)
        mark = " ".join(sorted(f"{a.lower()}={b or c or d}" for a, b, c, d in CLASS.findall(token))) if "=" in token else ""
        new = Element(tag, mark, xxhash.xxh3_64_intdigest(f"{here.place}/{tag} {mark}"), start, here)
        here.items.append(new)
        every.append(new)
        if tag in VOID or token.endswith("/>"):
            new.end = at
        elif tag in RAW:
            close_tag = RAW[tag].search(page, at)
            new.end = at = close_tag.end() if close_tag else n
        else:
            here = new
            opened[tag] += 1
    while here is not root:
        here.end, here = n, here.parent
    _measure(page, root, every)
    return root, every


def _measure(page: str, root: Element, every: list[Element]) -> None:
    """Text sizes and content hashes from the leaves up: each letter is read once, by the element it stands in.

    Sizes leave out scripts, menus and the like. A form that holds most of a page's text
    is the page's frame, not a form to fill in.
    """
    for e in reversed(every):
        parts, at = [], e.start
        for x in e.items:
            if isinstance(x, str):
                e.size += len(x.strip())
            else:
                e.size += x.size if x.tag not in NOT_TEXT or x.tag == "form" else 0
                parts += [page[at : x.start].encode(errors="surrogatepass"), b"<", x.digest]
                at = x.end
        parts.append(page[at : e.end].encode(errors="surrogatepass"))
        e.digest = xxhash.xxh3_128_digest(b"".join(parts))
    root.size = sum(len(x.strip()) if isinstance(x, str) else x.size if x.tag not in NOT_TEXT or x.tag == "form" else 0 for x in root.items)
    for e in every:
        if e.tag == "form" and 2 * e.size > root.size:
            e.tag = "div"


def _named_so(mark: str) -> bool:
    """Whether one class, id or role as a whole names what is no article: all its words are known, and one is a mark.

    Words part at hyphens, underscores and changes of case.
    """
    for name in re.sub(r"(?:^| )(?:class|id|role)=", " ", mark).split():
        words = [w.lower() for w in NAMES.findall(name)]
        if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def _shown(e: Element) -> str:
    """The text of a heading, with its inline elements."""
    return SPACE.sub(" ", html.unescape("".join(x if isinstance(x, str) else _shown(x) if x.tag not in BLOCK else "" for x in e.items))).strip()


def _unwanted(e: Element, gone: set[int], inside: bool) -> bool:
    return e.tag in NOT_TEXT or (e.tag == "header" and not inside) or id(e) in gone


def _remarks(every: list[Element]) -> list[Element]:
    """Blocks that begin with a heading of readers' comments."""
    out = []
    for e in every:
        if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and e.size < 40 and e.parent.tag in ("section", "div", "aside"):
            first = next((x for x in e.parent.items if not isinstance(x, str) or x.strip()), None)
            if first is e and REMARKS.fullmatch(_shown(e)):
                out.append(e.parent)
    return out


def _marked(root: Element, every: list[Element]) -> tuple[set[int], set[int]]:
    """Elements named so, and those of them that go: all but what holds most of the page's text."""
    named = [e for e in every if e.mark and e.tag not in ("html", "body", "article", "main") and _named_so(e.mark)] + _remarks(every)
    return {id(e) for e in named}, {id(e) for e in named if 2 * e.size <= root.size}


def _main_block(root: Element) -> Element | None:
    """The innermost element that holds over half of the page's text; None where there is less than a paragraph, which tells nothing."""
    if root.size < PARAGRAPH:
        return None
    e = root
    while True:
        heavy = next((x for x in e.items if not isinstance(x, str) and x.tag not in NOT_TEXT and 2 * x.size > root.size), None)
        if heavy is None:
            return e
        e = heavy


def _articles(root: Element, gone: set[int], named: set[int]) -> list[Element]:
    """The outermost article and main elements, in page order.

    Where the block that holds most of the page's text stands beside them, in a frame of
    its own, and holds over twice as much as they do together, they are cards, and it is
    the article.
    """
    found, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.tag in ("article", "main"):
            found.append(e)
        else:
            todo += [x for x in reversed(e.items) if not isinstance(x, str) and not _unwanted(x, gone, False)]
    block = _main_block(root)
    if not found or block is None or block.size <= 2 * sum(e.size for e in found):
        return found
    while block.tag in RUNNING:  # its frame decides
        block = block.parent
    around = set()  # what the cards stand in
    for e in found:
        while e is not None and id(e) not in around:
            around.add(id(e))
            e = e.parent
    if id(block) in around or any(id(e) in gone or id(e) in named or e in found for e in _line(block)):
        return found
    # with the headings beside the text: up to what holds a card too
    while block.parent.tag not in ("", "html", "body") and id(block.parent) not in around:
        block = block.parent
    return [block]


def _line(e: Element | None) -> Iterator[Element]:
    """An element and all that it stands in."""
    while e is not None:
        yield e
        e = e.parent


def _subtree(page: str, e: Element, host: int) -> int:
    """Hash of an element's subtree, its place and its host."""
    return _signed(xxhash.xxh3_64_intdigest(e.digest, seed=e.place ^ host))


def _counted(every: list[Element]) -> list[Element]:
    """The block elements that can be a template.

    Not html, body, articles, the block that holds most of the page's text, or what these
    stand in; and inside an article or that block neither running text nor a part that
    holds over a quarter of it.
    """
    if not every:
        return []
    root = every[0]
    while root.parent is not None:
        root = root.parent
    block = _main_block(root)
    kept: set[int] = set()
    for e in [*([block] if block else []), *(e for e in every if e.tag in ("article", "main"))]:
        while e is not None and id(e) not in kept:
            kept.add(id(e))
            e = e.parent
    within = {id(block)} if block else set()
    out = []
    for e in every:  # parents first
        if id(e.parent) in within:
            within.add(id(e))
        if e.tag not in BLOCK or e.tag in ("html", "body") or id(e) in kept:
            continue
        if (e.inside or id(e) in within) and (e.tag in RUNNING or block is not None and 4 * e.size > block.size):
            continue
        out.append(e)
    return out


def host_hash(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host)


def main_text(page: str | None, host: int = 0, is_template=None) -> str:
    """The page's article: the blocks of its outermost article or main elements, or of the page if it has none.

    ``is_template`` tells of a list of subtree hashes which are templates of the host.
    """
    page = page or ""
    root, every = parse(page)
    named, gone = _marked(root, every)
    if is_template is not None:
        elements = _counted(every)
        gone |= {id(e) for e, hit in zip(elements, is_template([_subtree(page, e, host) for e in elements])) if hit}
    blocks: list[str] = []
    for top in _articles(root, gone, named) or [root]:
        pending: list[str] = []
        _collect(top, gone, top is not root, blocks, pending)
        _flush(blocks, pending)
    return "\n\n".join(blocks)


def _flush(blocks: list[str], pending: list[str]) -> None:
    text = SPACE.sub(" ", html.unescape("".join(pending))).strip()
    pending.clear()
    if text:
        blocks.append(text)


def _collect(top: Element, gone: set[int], inside: bool, blocks: list[str], pending: list[str]) -> None:
    """Depth first without recursion, as pages may nest deeply."""
    todo: list = [iter(top.items)]
    ends = [False]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
            if ends.pop():
                _flush(blocks, pending)
        elif isinstance(x, str):
            pending.append(x)
        elif x.tag == "br":
            pending.append(" ")
        elif not _unwanted(x, gone, inside):
            block = x.tag in BLOCK
            if block:
                _flush(blocks, pending)
            todo.append(iter(x.items))
            ends.append(block)


def page_host(url_col: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def site_templates(pages: DataFrame, least_pages: int, share: float) -> DataFrame:
    """host, hash of the subtrees that recur on ``least_pages`` different pages or more, at the places of each host where ``share`` of all subtrees do.

    ``pages``: host, html. Pages of a host with equal html count once, so copies of a
    page make no template: a task gives a content's subtrees once, and Spark counts
    different contents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            hosts, places, hashes, contents = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = page or ""
                content = xxhash.xxh3_64_intdigest(page)
                if (host, content) in seen:
                    continue
                seen.add((host, content))
                at = host_hash(host)
                for place, h in {(e.place, _subtree(page, e, at)) for e in _counted(parse(page)[1])}:
                    hosts.append(host), places.append(_signed(place)), hashes.append(h), contents.append(_signed(content))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(x, pa.int64()) for x in (places, hashes, contents)]], names=["host", "place", "hash", "content"])

    rows = pages.mapInArrow(count, "host string, place long, hash long, content long").distinct()
    counted = rows.groupBy("host", "place", "hash").agg(F.count("*").alias("n"))
    again = F.col("n") >= least_pages
    places = counted.groupBy("host", "place").agg(F.sum("n").alias("all"), F.sum(F.when(again, F.col("n")).otherwise(0)).alias("again"))
    places = places.where((F.col("again") > 0) & (F.col("again") >= share * F.col("all"))).select("host", "place")
    return counted.where(again).join(places, ["host", "place"], "left_semi").select("host", "hash")


class _Hashes:
    """Template hashes as a sorted array: a host is part of its hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes.astype(np.int64))

    def hits(self, asked: list[int]) -> list[bool]:
        if not len(self.sorted) or not asked:
            return [False] * len(asked)
        asked = np.array(asked, np.int64)
        return (self.sorted[np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)] == asked).tolist()


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 5, share: float = 0.8, most_sent: int = 1_000_000) -> DataFrame:
    """id, url, text of every row of ``pages``.

    The whole html is read; null counts as empty and gives an empty text. Character
    references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined in page order by an empty line. Pages whose url is null or has
    no host form one host of their own. Repeated rows are rows of their own in the
    result, but one page where templates are counted. Up to ``most_sent`` templates go
    to all tasks (8 MB); more are joined to the pages by host. Other columns are not
    read; an empty table gives no rows.
    """
    ws = Workspace(spark, "html")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), page_host(url_col).alias("host"))
    templates = ws.table(site_templates(rows.select("host", "html"), least_pages, share), "templates")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, url string, text string"
    names = ["id", "url", "text"]
    if templates.count() <= most_sent:
        known = spark.sparkContext.broadcast(_Hashes(np.array([r.hash for r in templates.select("hash").collect()], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches):
                texts = [main_text(page, host_hash(host), known.value.hits) for page, host in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=names)

        return rows.mapInArrow(run, schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = []
            for page, host, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                own = frozenset(own or ())
                texts.append(main_text(page, host_hash(host), lambda asked, own=own: [x in own for x in asked]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=names)

    per_host = templates.groupBy("host").agg(F.collect_list("hash").alias("own"))  # a site's templates are few against its pages
    return rows.join(per_host, "host", "left").select("id", "url", "html", "host", "own").mapInArrow(run_joined, schema)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark, read(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
