"""URL filters over a sorted digest array.

The entries (host and beginning of the path) are kept as an array of their 64-bit xxhash keys, sorted, beside their full
strings. Spark hands the file to every executor, tasks map it into memory. A URL asks for every suffix of its host with
every beginning of its path that has the length of some entry's; one binary search answers a whole batch, and what it
finds is confirmed by the stored string, so that a collision of keys cannot decide.

Defined results: a null URL, or one without ://, has an empty host and path, fits no entry and is allowed. Of the rules
that fit, the longest (host and path together; then the longer host) decides, else the block list. Repeated rows get the
same answer. Input columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import lower_az, map_rows, table

#: Verdict and entry; longest wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The block list where no rule fits: sites of these names under any of these domains.
BLOCKED_NAMES = ("spam-farm", "cheap-pills", "free-bets", "adult-x", "ads-track", "casino-win")
BLOCK_LIST = tuple(f"{name}.example.{tld}/" for name in BLOCKED_NAMES for tld in ("com", "net", "org"))
#: Bytes of one file; a longer list becomes several.
FILE_BYTES = 256 << 20


class DigestArray:
    """Sorted keys, their strings and one tag each, in a mapped file."""

    def __init__(self, path: str):
        n, lengths, blob = np.fromfile(path, np.int64, 3)
        keys = 24 + 8 * n
        self.keys = np.memmap(path, np.uint64, "r", 24, (n,)) if n else np.zeros(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", keys, (n + 1,))
        self.lengths = np.fromfile(path, np.int64, lengths, offset=keys + 8 * (n + 1)).tolist()
        at = keys + 8 * (n + 1) + 8 * lengths
        self.tags = np.memmap(path, np.uint8, "r", at, (n,)) if n else np.zeros(0, np.uint8)
        self.blob = np.memmap(path, np.uint8, "r", at + n, (blob,)) if blob else np.zeros(0, np.uint8)

    @staticmethod
    def write(path: str, entries: Iterable[tuple[str, int]]) -> None:
        rows = sorted((xxh64_intdigest(e := entry.encode()), e, tag) for entry, tag in set(entries))
        lengths = sorted({len(e) - e.index(b"/") for _, e, _ in rows})
        ends = np.cumsum([0, *(len(e) for _, e, _ in rows)])
        blob = b"".join(e for _, e, _ in rows)
        with open(path, "wb") as f:
            np.array([len(rows), len(lengths), len(blob)], np.int64).tofile(f)
            np.array([k for k, _, _ in rows], np.uint64).tofile(f)
            ends.astype(np.int64).tofile(f)
            np.array(lengths, np.int64).tofile(f)
            np.array([t for _, _, t in rows], np.uint8).tofile(f)
            f.write(blob)

    def probe(self, asked: Sequence[bytes]) -> list[tuple[int, int]]:
        """(number of the question, tag) for all questions that are entries."""
        want = np.fromiter(map(xxh64_intdigest, asked), np.uint64, len(asked))
        at = np.searchsorted(self.keys, want)
        found = []
        for q in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == want) if len(self.keys) else ():
            i = at[q]
            while i < len(self.keys) and self.keys[i] == want[q]:
                if self.blob[self.ends[i] : self.ends[i + 1]].tobytes() == asked[q]:
                    found.append((int(q), int(self.tags[i])))
                i += 1
        return found


def questions(host: bytes, path: bytes, lengths: Sequence[int]) -> list[bytes]:
    """Every suffix of host at a label with every beginning of path of one of lengths."""
    labels = host.split(b".")
    tails = [b".".join(labels[i:]) for i in range(len(labels))] if host else []
    heads = [path[:n] for n in lengths if n <= len(path)]
    return [t + h for t in tails for h in heads]


def share(spark: SparkSession, rules: Sequence[tuple[str, str]], block_list: Sequence[str]) -> list[str]:
    """Files of the entries, sent to all executors. Tags: 0 of the block list, 1 a rule that allows, 2 one that blocks."""
    entries = [(e, 1 if verdict == "allow" else 2) for verdict, e in rules] + [(e, 0) for e in block_list]
    parts = sum(len(e) + 32 for e, _ in entries) // FILE_BYTES + 1
    names = []
    for k in range(parts):
        names.append(f"digests-{uuid.uuid4().hex}")
        path = os.path.join(os.path.realpath(tempfile.mkdtemp()), names[-1])
        DigestArray.write(path, entries[k::parts])
        spark.sparkContext.addFile(path)
    return names


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, block_list: Sequence[str] = BLOCK_LIST, keep: list[str] | None = None) -> DataFrame:
    """pages with host, path, rule and verdict for their url."""
    names = share(pages.sparkSession, rules, block_list)
    part = lambda group: F.coalesce(F.regexp_extract("url", r"^(?s).*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    pages = pages.withColumn("host", lower_az(part(1))).withColumn("path", part(2))

    def make():
        arrays = [DigestArray(SparkFiles.get(n)) for n in names]

        def fn(batch):
            best: list[tuple] = [()] * batch.num_rows
            blocked = [False] * batch.num_rows
            for a in arrays:
                asked, row, split = [], [], []
                for i, (h, p) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                    for q in questions(h.encode(), p.encode(), a.lengths):
                        asked.append(q)
                        row.append(i)
                for q, tag in a.probe(asked):
                    if tag:
                        best[row[q]] = max(best[row[q]], (len(asked[q]), asked[q].index(b"/"), asked[q].decode(), tag))
                    else:
                        blocked[row[q]] = True
            verdicts = [("allow" if b[3] == 1 else "block") if b else "block" if x else "allow" for b, x in zip(best, blocked, strict=True)]
            return [[b[2] if b else None for b in best], verdicts]

        return fn

    return map_rows(pages, make, [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())], keep)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filtered(pages, keep=["page_id", "host", "path"]).select("page_id", "host", "path", "rule", "verdict")


def sql_list(values: Iterable[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


OP7_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rule) AS (VALUES {", ".join(f"('{v}', '{e}')" for v, e in RULES)}),
s AS (SELECT *, substr(rule, 1, position('/' IN rule) - 1) AS h, substr(rule, position('/' IN rule)) AS q FROM r),
b AS (SELECT rid, max_by(s.rule, length(s.rule) * 10000 + length(s.h)) AS rule, max_by(s.verdict, length(s.rule) * 10000 + length(s.h)) AS verdict
      FROM p JOIN s ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY rid),
l AS (SELECT unnest([{sql_list(e[:-1] for e in BLOCK_LIST)}]) AS site)
SELECT page_id, host, path, b.rule, coalesce(b.verdict, CASE WHEN EXISTS (SELECT 1 FROM l WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, '/')) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (rid)
"""
