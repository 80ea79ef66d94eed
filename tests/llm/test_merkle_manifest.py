"""The Merkle manifest against a tree built row by row."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from kerbline.llm import merkle_manifest as mm
from pyspark.sql import functions as F

DOC = "doc_id long, source string, lang string, n_chars long, text string, digest int, `a.b` int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes):
    """Levels from nodes to their root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows, cut):
    by = {}
    for r in rows:
        doc, source, lang, n, text = r[:5]
        other = cut(doc, text)
        by.setdefault("" if source is None else "=" + source, []).append(((doc is not None, doc or 0, leaf(doc, source, lang, n, text)), doc, leaf(doc, source, lang, n, text), leaf(doc, source, lang, n, other)))
    names = sorted(by, key=lambda s: s.encode())
    trees = {s: climb([x[2] for x in sorted(by[s])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = Counter()
    for at, s in enumerate(names):
        for i, (_, doc, own, other) in enumerate(sorted(by[s])):
            path = siblings(trees[s], i) + siblings(top, at)
            x = other
            for before, after in path:
                x = sha(*before, x, *after)
            out[doc, own, trees[s][-1][0], top[-1][0], sha(*(h for p in path for side in p for h in side)), x, x == top[-1][0]] += 1
    return out


def halves(doc, text):
    return text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text


def rows_of(n, sources, rng):
    rows = [(rng.randrange(n), rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "plain é", f"t\n{i}"]), i, 0) for i in range(n)]
    return rows + rows[:3] + [(None, None, None, None, None, 1, 1), (None, "s0", "en", 1, "x", 1, 1), (None, "s0", "en", 1, "y", 1, 1)]


@pytest.mark.parametrize(("n", "sources"), [(0, ["a"]), (1, ["é"]), (40, ["s0", None, "S", "s10", ""]), (700, ["s0"] * 9 + ["t", None]), (400, [f"x{i}" for i in range(300)])])
def test_manifest_matches_a_tree_built_row_by_row(spark, n, sources):
    rows = rows_of(n, sources, random.Random(n)) if n > 1 else [(7, sources[0], None, 1, "one\nrow", 0, 0)] * n
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = mm.manifest(docs, tampered).drop("source")
    assert Counter(map(tuple, got.collect())) == (brute(rows, halves) if n else Counter())


def test_untampered_rows_verify_and_the_store_holds_every_node(spark):
    rng = random.Random(9)
    rows = rows_of(300, ["a", "b"], rng)
    docs = spark.createDataFrame(rows, DOC)
    assert mm.manifest(docs).where("not verified").isEmpty()
    leaves = [(s, i, k, sha(f"{s}{i}")) for s, k in (("a", 1), ("b", 3), ("c", 82), ("d", 300)) for i in range(k)]
    store = mm.build(spark.createDataFrame(leaves, "tree string, idx long, n long, digest string"), "test")
    expected = {(s, level, i, h) for s in "abcd" for level, hs in enumerate(climb([x[3] for x in leaves if x[0] == s])) for i, h in enumerate(hs)}
    got = [tuple(r) for r in store.nodes().select("tree", "level", "idx", "digest").collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_no_group_is_numbered_in_one_task(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 5000).alias("x"))
    got = mm.numbered(rows.where("g = 0"), "g", "x")
    assert got.where(f"n <> 2500 or idx <> x / 2").isEmpty() and got.count() == 2500
