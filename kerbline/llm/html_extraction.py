"""HTML extraction: main text after removal of site templates.

Every page becomes a tree. Its block elements are hashed with all they hold, and Spark counts in how many different pages of a
host each hash occurs. Template is, and is deleted:

* an element without prose (no paragraph, heading or the like in it) that recurs across many pages of its host;
* an element without prose in a place (the tags and classes from the root down) whose content recurs in a large share of the
  host's pages: menus, adverts and footers drawn from a few variants, so also a variant that is new;
* an element with prose in half of the host's pages or more, outside the main elements. A paragraph that recurs less is story.

Templates go first, inside and outside of article (or main) elements; inside, only elements without prose can be template. What the
page says of itself is the second opinion, for what counts do not tell (a host of few pages, a box that is new): elements whose
role is not main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) go as well,
but a class name of several words does not make a paragraph or heading of the story go. Without a main element the blocks that remain of the
body are the text, without the headers directly below it. taken() tells how many characters either opinion takes.

Defined results: a null or empty html has the empty text. A null url, or one without ://, counts under the empty host.
Equal pages of a host count once, and repeated rows get the same text.
Input columns named text or n_chars are replaced; other columns come back, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import in_arrow, lower_az, map_rows, materialize, small, table

#: An element without prose is template if it is in so many pages of its host, and in such a share of them.
MIN_PAGES, MIN_SHARE = 10, 0.05
#: On a host of fewer than twice MIN_PAGES pages half of them suffice, but no fewer than FEWEST; the share is that of so many pages at most.
FEWEST, SHARE_PAGES = 3, 2_000
#: A place is template if such a share of its elements recur; inside main elements more is asked. Elements that a place needs.
PLACE_SHARE, MAIN_SHARE, PLACE_ELEMENTS = 0.25, 0.5, 4
#: Share of a host's pages that makes an element with prose template.
PROSE_SHARE = 0.5
#: Template hashes of all hosts that every task may hold; beyond it pages are joined with their host's.
MAX_BROADCAST = 1_000_000

# fixed values: the elements of the HTML standard by how they are read
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "title", "legend", "summary", "figcaption"}
#: An opening tag ends these open elements, up to an enclosing one of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Elements that are never shown.
HIDDEN = frozenset("head script style noscript template iframe textarea title noembed noframes".split())
#: Elements that never hold main text.
DROP = HIDDEN | frozenset("nav footer aside form button select option svg canvas object embed audio video map dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id that name such parts.
PARTS = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
PHRASES = ("comment-", "comments-", "sidebar-", "site-header", "page-header", "site-footer", "main-menu", "user-comments", "reader-comments")
MAIN = ("article", "main")
STORY = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
PROSE = STORY | frozenset("figure article main".split())

# a quote opens a value only after an equals sign; elsewhere it is a character of a name or of an unquoted value
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
NAME = re.compile(r"[A-Za-z0-9]+")
DIGITS = re.compile(r"\d+")


class Node:
    """An element, its number in the page and its parent's; children are nodes and strings (not yet decoded)."""

    __slots__ = ("at", "attributes", "children", "tag", "up")

    def __init__(self, tag: str, attributes: str, at: int, up: int):
        self.tag, self.attributes, self.at, self.up = tag, attributes, at, up
        self.children: list[Node | str] = []


def parse(page: str) -> list[Node]:
    """The elements of a page, the root first, parents before their children; unknown or missing end tags never fail."""
    root = Node("html", "", 0, 0)
    nodes, stack, at, end = [root], [root], 0, len(page)
    open_tags: Counter = Counter(["html"])

    def close(i: int) -> None:
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in ("article", "table", "body") and tag not in ("html", "body", "article", "main", "div", "section", "table"):
                        break
            continue
        if tag == "html" or tag == "body" and open_tags[tag]:
            continue
        if tag in CLOSES_P and open_tags["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK or stack[i].tag == "button":
                    break
        if tag in ENDS and any(open_tags[x] for x in ENDS[tag][0]):
            ended, around = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in around:
                    break
                if stack[i].tag in ended:
                    close(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        node = Node(tag, m[3] or "", len(nodes), stack[-1].at)
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in VOID or node.attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            node.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        else:
            stack.append(node)
            open_tags[tag] += 1
    return nodes


def is_part(node: Node) -> bool:
    """Whether the element's role says that it holds no main text."""
    if node.tag in DROP:
        return True
    if not node.attributes or node.tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(node.attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id"):
            if any(w in PARTS for w in value.split()):
                return True
            # names made of several words, of elements that are neither named as the page's content nor its paragraphs and headings
            if node.tag not in MAIN and node.tag not in STORY and (any(p in value for p in PHRASES) or len(NAME.findall(value)) <= 3 and any(w in PARTS for w in NAME.findall(value))):
                return True
    return False


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def class_of(node: Node) -> str:
    """The value of the class attribute without digits."""
    if "class" not in node.attributes.lower():
        return ""
    return next((DIGITS.sub("", m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attributes) if m[1].lower() == "class"), "")


class Page:
    """A page's elements and, by their number, what is known of them. With roles, parts and main elements are found."""

    def __init__(self, page: str, roles: bool = True):
        self.nodes = nodes = parse(page)
        n = len(nodes)
        self.gone = gone = [False] * n
        for x in nodes[1:]:
            gone[x.at] = gone[x.up] or (is_part(x) if roles else x.tag in HIDDEN)
        # from the leaves up: characters of text that is shown, and whether there is prose
        self.shown, self.chars, self.prose = [0] * n, [0] * n, [x.tag in PROSE for x in nodes]
        for x in reversed(nodes):
            if x.tag not in HIDDEN:
                self.chars[x.at] += sum(len(c.strip()) for c in x.children if isinstance(c, str))
                self.chars[x.up] += self.chars[x.at] if x.at else 0
                self.prose[x.up] |= self.prose[x.at]
            if not gone[x.at]:
                self.shown[x.at] += sum(len(c.strip()) for c in x.children if isinstance(c, str))
                self.shown[x.up] += self.shown[x.at] if x.at else 0
        self.main = self.find_main() if roles else []
        # 1 for elements inside a main element, 2 for those that hold one or are one
        self.kind = kind = [0] * n
        for i in self.main:
            while i and kind[i] != 2:
                kind[i], i = 2, nodes[i].up
        main = set(self.main)
        for x in nodes[1:]:
            if kind[x.at] == 0 and (x.up in main or kind[x.up] == 1):
                kind[x.at] = 1
        if roles and not main:
            # a header within some element is that element's heading
            for x in nodes[1:]:
                gone[x.at] = gone[x.at] or gone[x.up] or x.tag == "header" and nodes[x.up].tag in ("html", "body", "")

    def find_main(self) -> list[int]:
        """The outermost article elements; main elements instead, if what they hold beside their articles is longer than these."""
        outer: dict[str, list[int]] = {}
        inside: dict[str, list[bool]] = {}
        for wanted in MAIN:
            outer[wanted], within = [], [False] * len(self.nodes)
            for x in self.nodes[1:]:
                within[x.at] = within[x.up] or x.up > 0 and self.nodes[x.up].tag == wanted
                if x.tag == wanted and not within[x.at] and not self.gone[x.at]:
                    outer[wanted].append(x.at)
            inside[wanted] = within
        if not outer["main"]:
            return outer["article"]
        held = [i for i in outer["article"] if inside["main"][i]]
        articles = sum(self.shown[i] for i in held)
        return held if articles and 2 * articles >= sum(self.shown[i] for i in outer["main"]) and not self.tells_beside(held) else outer["main"]

    def tells_beside(self, held: list[int]) -> bool:
        """Whether a main element has paragraphs of its own beside its articles."""
        inside = [False] * len(self.nodes)
        for x in self.nodes[1:]:
            inside[x.at] = inside[x.up] or x.tag == "main"
            if x.at in held:
                inside[x.at] = False
            elif inside[x.at] and x.tag == "p" and self.shown[x.at] and not self.gone[x.at]:
                return True
        return False

    def candidates(self) -> Iterator[tuple[int, int, int, int]]:
        """(number, kind, hash, place) of elements with text that may be template: kind 0 without prose, 1 such inside a main element, 2 with prose.

        The hash is of all that the element holds, the place of tags and classes from the root.
        """
        nodes, n = self.nodes, len(self.nodes)
        may = [0 < x.at and self.chars[x.at] > 0 and self.kind[x.at] < 2 and x.tag in BLOCK and x.tag != "body" and x.tag not in HIDDEN and not (self.prose[x.at] and self.kind[x.at]) for x in nodes]
        needed, place, own = list(may), [0] * n, [0] * n
        for x in nodes[1:]:
            needed[x.at] = needed[x.at] or needed[x.up]
            if needed[x.at] or self.kind[x.at] == 2 or nodes[x.up].up == 0 or self.prose[x.at]:
                place[x.at] = signed(xxh64_intdigest(f"{place[x.up]} {x.tag} {class_of(x)}"))
        for x in reversed(nodes):
            if needed[x.at]:
                words = [x.tag]
                for c in x.children:
                    words += c.split() if isinstance(c, str) else (f"<{own[c.at]}>",)
                own[x.at] = signed(xxh64_intdigest(" ".join(words)))
        for x in nodes:
            if may[x.at]:
                yield x.at, 2 if self.prose[x.at] else self.kind[x.at], own[x.at], place[x.at]

    def taken(self, template: frozenset[int] | set[int]) -> tuple[int, int]:
        """Characters of text in template elements, and of the rest those in elements that go by their role."""
        by_count = [False] * len(self.nodes)
        for i, kind, own, place in self.candidates() if template else ():
            by_count[i] = own in template or kind < 2 and place in template
        totals, hidden = [0, 0], [False] * len(self.nodes)
        for x in self.nodes[1:]:
            by_count[x.at] |= by_count[x.up]
            hidden[x.at] = hidden[x.up] or x.tag in HIDDEN
            if not hidden[x.at] and (by_count[x.at] or self.gone[x.at]):
                totals[0 if by_count[x.at] else 1] += sum(len(c.strip()) for c in x.children if isinstance(c, str))
        return totals[0], totals[1]

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks of the main elements, or of the body, without elements that are template."""
        gone = self.gone
        if template:
            gone = list(gone)
            for i, kind, own, place in self.candidates():
                gone[i] = gone[i] or own in template or kind < 2 and place in template
        out: list[str] = []
        parts: list[str] = []
        for top in self.main or [0]:
            todo: list[Node | str | None] = [self.nodes[top]]
            while todo:
                x = todo.pop()
                if x is None:
                    flush(out, parts)
                elif isinstance(x, str):
                    parts.append(x)
                elif gone[x.at] or x.tag == "br":
                    parts.append(" ")
                elif x.tag in BLOCK:
                    flush(out, parts)
                    todo.append(None)
                    todo += reversed(x.children)
                else:
                    todo += reversed(x.children)
            flush(out, parts)
        return "\n\n".join(out)


def flush(out: list[str], parts: list[str]) -> None:
    text = " ".join(html.unescape("".join(parts)).split())
    parts.clear()
    if text:
        out.append(text)


def main_text(page: str, template: frozenset[int] | set[int] = frozenset(), roles: bool = True) -> str:
    return Page(page, roles).text(template) if page else ""


def with_host(pages: DataFrame) -> DataFrame:
    """host, h (hash of the page) and row, which holds all columns, so that no name of theirs matters."""
    host = lower_az(F.coalesce(F.regexp_extract("url", r"^(?s).*?://([^/?#]*)", 1), F.lit("")))
    return pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), "html").withColumn("h", F.xxhash64("host", "html"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, roles: bool = True) -> DataFrame:
    """(host, key): hashes of template elements and of template places, for pages(host, h, html)."""
    # equal pages count once: each of m copies counts 1 / m
    copies = materialize(pages.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "copies")
    weighed = pages.select("host", "h", "html").join(small(copies), "h", "left").select("host", (1 / F.coalesce("m", F.lit(1))).alias("w"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # added up in the batch before anything is sent; kind -1 counts the pages
            seen: dict[tuple[str, int, int, int], float] = {}
            for host, w, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = {(kind, own, 0 if kind == 2 else place) for _, kind, own, place in Page(page, roles).candidates()} if page else ()
                for key in ((-1, 0, 0), *found):
                    seen[host, *key] = seen.get((host, *key), 0.0) + w
            columns = zip(*seen) if seen else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int8(), pa.int64(), pa.int64()), strict=True)), pa.array(list(seen.values()), pa.float64())], ["host", "kind", "own", "place", "n"])

    schema = "host string, kind byte, own long, place long, n double"
    counts = in_arrow(weighed, run, schema).groupBy("host", "kind", "own", "place").agg(F.round(F.sum("n"), 3).alias("n"))
    counts = materialize(counts, "counts")
    sizes = counts.where("kind = -1").select("host", F.col("n").alias("pages"))
    # the same content may stand in several places
    often = counts.where(f"kind >= 0 and n >= {min(2, min_pages, FEWEST)}").groupBy("host", "kind", F.col("own").alias("key")).agg(F.sum("n").alias("n")).join(sizes, "host")
    half = F.greatest(F.col("pages") * PROSE_SHARE, F.lit(min(min_pages, FEWEST)))
    many = F.when(F.col("pages") < 2 * min_pages, half).otherwise(F.greatest(F.lit(float(min_pages)), F.least("pages", F.lit(float(SHARE_PAGES))) * min_share))
    elements = often.where(F.col("n") >= F.when(F.col("kind") == 2, half).otherwise(many)).select("host", "key")
    places = counts.where("kind in (0, 1)").groupBy("host", "kind", F.col("place").alias("key")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") > 1.5, F.col("n")).otherwise(0.0)).alias("again"))
    places = places.where((F.col("all") >= PLACE_ELEMENTS) & (F.col("again") >= F.col("all") * F.when(F.col("kind") == 1, MAIN_SHARE).otherwise(PLACE_SHARE))).select("host", "key")
    return elements.union(places).distinct()


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, keep: list[str] | None = None, max_broadcast: int = MAX_BROADCAST, roles: bool = True, remove: bool = True, tell: bool = False) -> DataFrame:
    """pages(url, html) with text and n_chars. Without roles the page's own word is not heard, without remove no template goes (both to measure).

    With tell also n_template and n_role, the characters that counts took first and those that roles took of the rest.
    """
    kept = [c for c in pages.columns if (keep is None or c in keep) and c.lower() not in ("text", "n_chars")]
    pages = with_host(pages)
    found = materialize(templates(pages, min_pages, min_share, roles).where(F.lit(remove)), "templates")
    fields = [T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_chars", *(("n_template", "n_role") if tell else ()))]]
    rows = pages.select("host", "html", F.struct(*[F.col("row")[c].alias(c) for c in kept]).alias("row"))
    # checked: at most max_broadcast pairs
    sent = None
    if found.count() <= max_broadcast:
        sets: dict[str, set[int]] = {}
        for r in found.toLocalIterator():
            sets.setdefault(r["host"], set()).add(r["key"])
        sent = pages.sparkSession.sparkContext.broadcast(sets)
    else:
        rows = rows.join(found.groupBy("host").agg(F.collect_list("key").alias("template")), "host", "left")

    def make():
        def fn(batch):
            hosts = batch.column("host").to_pylist()
            sets = [sent.value.get(h, frozenset()) for h in hosts] if sent else [frozenset(t or ()) for t in batch.column("template").to_pylist()]
            read = [(Page(p, roles) if p else None, t) for t, p in zip(sets, batch.column("html").to_pylist(), strict=True)] if tell else ()
            out = [main_text(p or "", t, roles) for t, p in zip(sets, batch.column("html").to_pylist(), strict=True)]
            more = [[page.taken(t)[i] if page else 0 for page, t in read] for i in (0, 1)] if tell else []
            return [out, [len(t) for t in out], *more]

        return fn

    return map_rows(rows, make, fields, ["row"]).select("row.*", *[f.name for f in fields])


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
