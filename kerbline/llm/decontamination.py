"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items' words is built once in each task from a broadcast block of items. Every document's
words stream through it; the length of the longest match that ends at each word tells which words lie in a
benchmark window. Blocks have a fixed size; a benchmark beyond it runs as further passes in the same stage.

Defined results: a null or wordless text has no words and no hits. Null or wordless items match nothing. Items that
share an id count once; a null item id reads as the empty string. Repeated documents are judged alike. Input columns
named like an output column of find_spans() are replaced there; decontaminate() returns them as they were.
"""

from __future__ import annotations

import re
from itertools import repeat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, set_apart, table, texts

#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 1_000_000
#: Lower-cases A-Z and turns every ASCII character other than a letter or digit into a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers; the state after a word is the longest suffix that occurs in an item."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, str]] = []  # states of item prefixes, with the item
        whole: list[tuple[int, int, str]] = []
        for item, text in items:
            words = words_of(text)
            last = 0
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                ends.append((last, item))
            if 0 < len(words) < window:
                whole.append((last, len(words), item))
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        n = len(self.len)
        # the state whose longest string has at least `window` words and whose link's has fewer
        self.anchor = [-1] * n
        for s in order:
            if self.len[s] >= window:
                self.anchor[s] = s if self.len[self.link[s]] < window else self.anchor[self.link[s]]
        self.items: dict[int, set[str]] = {}
        for s, item in ends:
            if self.anchor[s] >= 0:
                self.items.setdefault(self.anchor[s], set()).add(item)
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        for s, k, item in whole:
            if (k, item) not in self.short[s]:
                self.short[s] += ((k, item),)
        for s in order:
            self.short[s] += self.short[self.link[s]]
        # the match length from which a state has something to report
        self.report = [min([window] * (self.anchor[s] >= 0) + [k for k, _ in self.short[s]], default=1 << 60) for s in range(n)]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of the words that lie in an occurrence of a window, and the items of those windows."""
        nxt, link, length, report = self.next, self.link, self.len, self.report
        spans: list[tuple[int, int]] = []
        anchors: set[int] = set()
        found: set[str] = set()
        s = n = 0
        for i, c in enumerate(map(self.vocab.get, words, repeat(-1))):
            if c < 0:
                s = n = 0
                continue
            t = nxt[s].get(c)
            if t is None:
                while s and t is None:
                    s = link[s]
                    t = nxt[s].get(c)
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            if n >= report[s]:
                first = i + 1
                if n >= self.window:
                    anchors.add(self.anchor[s])
                    first = i - n + 1
                for k, item in self.short[s]:
                    if k <= n:
                        found.add(item)
                        first = min(first, i - k + 1)
                while spans and spans[-1][1] >= first - 1:
                    first = min(first, spans.pop()[0])
                spans.append((first, i))
        for a in anchors:
            found |= self.items.get(a, set())
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a - 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut_text(text: bytes | None, spans: list[tuple[int, int]], max_span: int) -> bytes | None:
    """text without the spans of more than max_span words and what stands between them and the next word."""
    cut = [(a, b) for a, b in spans if b - a + 1 > max_span]
    if not cut:
        return text
    at = [m.span() for m in WORD.finditer(text.lower())]
    parts, done = [], 0
    for a, b in cut:
        parts.append(text[done : at[a][0]])
        done = at[b + 1][0] if b + 1 < len(at) else at[b][1]
    return b"".join([*parts, text[done:]])


def item_blocks(items: DataFrame, block_chars: int):
    """The number of blocks, and the items in blocks of about block_chars characters; the driver holds one at a time."""
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    return n, ([(r.item, r.text.encode()) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").toLocalIterator()] for k in range(n))


def find_spans(
    docs: DataFrame, items: DataFrame, window: int = 13, keep: list[str] | None = None, max_span: int | None = None, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (first and last word numbers, merged) and hit_items (sorted item ids).

    With max_span, text comes back without the hit spans of more words than that.
    """
    sc = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if keep is None or c in keep]
    n, blocks = item_blocks(items, block_chars)
    for number, block in enumerate(blocks):
        sent, last = sc.broadcast(block), number == n - 1
        cuts = last and max_span is not None

        def make(sent=sent, later=number > 0, cuts=cuts):
            automaton = Automaton(sent.value, window)

            def fn(batch):
                before = zip(batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist(), strict=True) if later else repeat(((), ()))
                out = ([], [], [], [], []) if cuts else ([], [], [], [])
                for text, (spans0, items0) in zip(texts(batch), before):
                    words = words_of(text)
                    spans, found = automaton.scan(words)
                    if spans0:
                        spans = merged([*((x["first"], x["last"]) for x in spans0), *spans])
                    out[0].append(len(words))
                    out[1].append(sum(b - a + 1 for a, b in spans))
                    out[2].append([{"first": a, "last": b} for a, b in spans])
                    out[3].append(sorted(found.union(items0)))
                    if cuts:
                        text = cut_text(text, spans, max_span)
                        out[4].append(None if text is None else text.decode())
                return out

            return fn

        through = kept if last else list(dict.fromkeys([*kept, "text"]))
        docs = map_rows(docs, make, [*FIELDS, T.StructField("text", T.StringType())] if cuts else FIELDS, keep=through)
    return docs


def with_verdict(found: DataFrame, percent: int = 5) -> DataFrame:
    """Adds contaminated: hit words make up percent of the words or more."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5, max_span: int = 12) -> DataFrame:
    """Drops documents whose hits reach percent of their words; cuts hit spans of more than max_span words from the others and sets their n_chars.

    Returns the columns of docs, also those named like one of FIELDS.
    """
    docs, own = set_apart(docs, [f.name for f in FIELDS] + ["contaminated"])
    kept = with_verdict(find_spans(docs, items, window, max_span=max_span), percent).where(~F.col("contaminated"))
    if "n_chars" in docs.columns:
        cut = F.exists("hit_spans", lambda s: s["last"] - s["first"] + 1 > max_span)
        kept = kept.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*own)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_verdict(find_spans(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP1_SQL = r"""
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
dw AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
      FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dwin AS (SELECT rid, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM dw, ks, unnest(range(1, len(w) - k + 2)) t(i)),
hits AS (SELECT rid, i, d.k, item_id FROM dwin d JOIN win USING (k, s)),
pos AS (SELECT rid, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + k)) t(p) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
