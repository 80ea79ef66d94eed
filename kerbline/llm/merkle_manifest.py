"""Merkle manifest of a dataset, kept as a node store of Parquet tables, with proofs by coordinate.

Each row is a leaf; the leaves of a source, by doc_id, are a tree, and the roots of the sources, by source, are one more tree
above them. A node's coordinate is (tree, level, idx). Sorted leaf runs are numbered by what stands before them, then bands of
BAND levels are built one after the other: a band reads the nodes of the last level sequentially, in blocks of FAN ** BAND
neighbours that one shuffle puts together, and writes a page for each block with all its levels; its top is a node of the
next band. The store is partitioned by band, so that a level is read without the others. Proofs go down again: a page and the
path of its top, merged by coordinate, give the paths of the page's nodes, and at last every leaf's. Memory: a page has FAN **
BAND nodes; a path has as many steps as its tree has levels. A source of any size is many blocks, so none is one task.

Defined results: null columns count as `-`; a null doc_id comes first, a null source is a source of its own before the others;
rows that agree in source and doc_id follow in the order of their leaves, equal rows are equal leaves. A lone leaf is its
tree's root. An empty table gives an empty manifest. Columns beyond doc_id, source, lang, n_chars and text are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; levels of a band.
FAN, BAND = 3, 4
BLOCK = FAN**BAND
STEP = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row with the given text."""
    return digest(*[field(text if c == "text" else F.col(c)) for c in FIELDS])


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with idx, the place among the rows of the same by (nulls are one group), by order from 0, and n, their number. No group is one task.

    The rows are written in sorted runs; what stands before a run's first row of a group is a running sum of counts.
    """
    keys = [F.col(by).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    runs = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    runs = materialize(runs, "runs")
    counts = runs.groupBy(F.col(by).alias("of"), F.col("run").alias("in_run")).agg(F.count("*").alias("k"), F.min("at").alias("first"))
    before = W.partitionBy("of").orderBy("in_run").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("of", "in_run", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("k").over(W.partitionBy("of")).alias("n"))
    counts = materialize(counts, "run-counts")
    same = F.col(by).eqNullSafe(F.col("of")) & (F.col("run") == F.col("in_run"))
    return runs.join(small(counts), same).withColumn("idx", F.col("at") + F.col("shift")).drop("run", "at", "of", "in_run", "shift")


def above(nodes: Column) -> Column:
    """The digests of each FAN consecutive ones of nodes."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i, FAN), "").cast("binary"), 256))


class Store:
    """Pages of a forest: for each band a table of tree, block, n (nodes of the band's first level) and levels (BAND + 1 lists of digests)."""

    def __init__(self, bands: list[DataFrame], roots: DataFrame):
        #: roots: tree, root
        self.bands, self.roots = bands, roots

    def nodes(self) -> DataFrame:
        """tree, level, idx, digest of all nodes; each once."""
        out = None
        for b, pages in enumerate(self.bands):
            each = pages.select("tree", "block", F.posexplode("levels").alias("up", "digests")).select("tree", (F.lit(b * BAND) + F.col("up")).alias("level"), "block", "up", F.posexplode("digests").alias("i", "digest"))
            each = each.select("tree", "level", (F.col("block") * F.pow(F.lit(FAN), BAND - F.col("up")).cast("long") + F.col("i")).alias("idx"), "digest")
            # the top of a page is in the next band's first level too
            each = each if b == 0 else each.where(F.col("level") > b * BAND)
            out = each if out is None else out.unionByName(each)
        return out


def band_pages(nodes: DataFrame, *extra: str) -> DataFrame:
    """Pages of nodes(tree, idx, n, digest[, extra]): one for each block, with the extra columns of its first level as the list rows."""
    block = F.floor(F.col("idx") / BLOCK).cast("long")
    pages = nodes.groupBy("tree", block.alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest", *extra))).alias("rows"))
    pages = pages.withColumn("level0", F.col("rows.digest"))
    for k in range(1, BAND + 1):
        # a small tree ends at the level of its root
        ended = F.col("n") <= FAN ** (k - 1)
        pages = pages.withColumn(f"level{k}", F.when(~ended, above(F.col(f"level{k - 1}"))))
    levels = F.filter(F.array(*[f"level{k}" for k in range(BAND + 1)]), lambda x: x.isNotNull())
    return pages.select("tree", "block", "n", levels.alias("levels"), *(["rows"] if extra else []))


def build(leaves: DataFrame, label: str, *extra: str) -> Store:
    """The store of leaves(tree, idx, n, digest[, extra]); trees are not null."""
    bands, roots, nodes = [], None, leaves
    while True:
        pages = materialize(band_pages(nodes, *(extra if not bands else ())), f"{label}-band-{len(bands)}")
        bands.append(pages)
        top = F.get(F.element_at("levels", -1), F.lit(0))
        done = pages.where(F.col("n") <= BLOCK).select("tree", top.alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        rest = pages.where(F.col("n") > BLOCK)
        if rest.isEmpty():
            return Store(bands, roots)
        nodes = rest.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), top.alias("digest"))


def steps(levels: Column, i: Column) -> Column:
    """The siblings of a page's node i on the way to its top, one step (before, after) for each level."""

    def step(nodes: Column, up: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(FAN), up)).cast("int")
        first = (at - at % FAN).cast("int")
        side = lambda a, n: F.array_join(F.slice(nodes, a + 1, n), "")
        return F.struct(side(first, at - first).alias("before"), side(at + 1, F.greatest(first + FAN - at - 1, F.lit(0))).alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def paths(store: Store, above_root: DataFrame) -> DataFrame:
    """The pages of the leaves with path, the steps from the page's top to the top of all, and subroot; above_root(tree, subroot, path) goes on from each tree's root."""
    known, pages = None, None
    for b in reversed(range(len(store.bands))):
        pages = store.bands[b]
        small_trees = pages.where(F.col("n") <= BLOCK).join(above_root, "tree")
        if known is None:
            pages = small_trees
        else:
            # both sides are dealt by coordinate and merged
            pages = small_trees.unionByName(pages.where(F.col("n") > BLOCK).join(known.withColumnRenamed("idx", "block"), ["tree", "block"]))
        if b:
            each = pages.select("tree", "block", "levels", "subroot", "path", F.posexplode(F.get("levels", F.lit(0))).alias("i", "digest"))
            known = materialize(each.select("tree", (F.col("block") * BLOCK + F.col("i")).alias("idx"), "subroot", F.concat(steps(F.col("levels"), F.col("i")), "path").alias("path")), "paths")
    return pages


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs(doc_id, source, lang, n_chars, text).

    tampered is a text that takes the row's place when the proof is checked (default: the row's own).
    """
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("digest"), leaf(F.col("text") if tampered is None else tampered).alias("checked"))
    rows = numbered(rows, "source", "doc_id", "digest", "checked")
    # trees have text keys: a null source is the empty one, others have a mark before them
    rows = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sources = build(rows.select("tree", "idx", "n", "digest", "doc_id", "source", "checked"), "sources", "doc_id", "source", "checked")
    subroots = materialize(sources.roots, "subroots")
    top = build(numbered(subroots.select(F.lit("").alias("all"), "tree", "root"), "all", "tree").select(F.col("all").alias("tree"), "idx", "n", F.col("root").alias("digest"), F.col("tree").alias("source_tree")), "top", "source_tree")
    pages = paths(top, top.roots.select("tree", F.lit(None).cast("string").alias("subroot"), F.array().cast(STEP).alias("path")))
    above_roots = pages.select(F.posexplode("rows").alias("i", "row"), "levels", "path").select(F.col("row.source_tree").alias("tree"), F.col("row.digest").alias("subroot"), F.concat(steps(F.col("levels"), F.col("i")), "path").alias("up"))
    above_roots = materialize(above_roots, "above-roots")
    [*root] = top.roots.select("root").collect()  # one row
    found = paths(sources, small(above_roots.withColumnRenamed("up", "path")))
    each = found.select("subroot", "levels", F.col("path").alias("up"), F.posexplode("rows").alias("i", "row"))
    each = each.select("row.*", "subroot", F.lit(root[0]["root"] if root else None).cast("string").alias("root"), F.concat(steps(F.col("levels"), F.col("i")), "up").alias("path"))
    siblings = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    return each.select(
        "doc_id", "source", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"), folded(F.col("checked"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents"), tampered).drop("source")


#: The same by recursion over levels; crc32 is written out, as the checking engine has none.
OP12_SQL = """
WITH RECURSIVE crc_table AS (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS b)),
steps AS (SELECT list(v ORDER BY b) AS t FROM crc_table),
docs AS (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, [unicode(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, x: xor(steps.t[xor(c, x) % 256 + 1], c >> 8)), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents, steps),
parts AS (SELECT r, doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(other) || ':' || other, '-') AS other FROM docs),
leaves AS (SELECT r, doc_id, coalesce('=' || source, '') AS tree, sha256(head || own) AS leaf, sha256(head || other) AS checked FROM parts),
nodes(tree, level, idx, digest, n) AS (
    SELECT tree, 0, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
    UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 2) // 3) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3),
roots AS (SELECT tree, digest, level FROM nodes WHERE n = 1),
tops(level, idx, digest, n) AS (
    SELECT 0, row_number() OVER (ORDER BY tree) - 1, digest, count(*) OVER () FROM roots
    UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 2) // 3) FROM tops WHERE n > 1 GROUP BY level, idx // 3),
above(tree, level, idx, digest) AS (
    SELECT tree, level, idx, digest FROM nodes WHERE n > 1 UNION ALL SELECT r.tree, r.level + t.level, t.idx, t.digest FROM roots r, tops t),
walk(r, tree, level, idx, folded, proof) AS (
    SELECT r, l.tree, 0, row_number() OVER (PARTITION BY l.tree ORDER BY doc_id NULLS FIRST, leaf) - 1, checked, '' FROM leaves l
    UNION ALL SELECT w.r, w.tree, w.level + 1, w.at // 3,
        sha256(coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx < w.at), '') || any_value(w.folded) || coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx > w.at), '')),
        any_value(w.proof) || coalesce(string_agg(a.digest, '' ORDER BY a.idx) FILTER (a.idx <> w.at), '')
    FROM (SELECT w.*, CASE WHEN w.level = q.level THEN (SELECT count(*) FROM roots p WHERE p.tree < w.tree) ELSE w.idx END AS at, q.level + (SELECT max(level) FROM tops) AS ends FROM walk w JOIN roots q USING (tree)) w
    LEFT JOIN above a ON a.tree = w.tree AND a.level = w.level AND a.idx // 3 = w.at // 3
    WHERE w.level < w.ends GROUP BY w.r, w.tree, w.level, w.at),
ended AS (SELECT r, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM walk GROUP BY r)
SELECT l.doc_id, l.leaf, q.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM leaves l JOIN roots q USING (tree) JOIN ended e USING (r)"""
