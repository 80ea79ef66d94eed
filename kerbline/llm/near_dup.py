"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits (r even) share a variant that differs from either in at most r / 2. Every
distinct fingerprint emits all its variants in that half radius; a shuffle on the variants brings the pairs together.
All fingerprints of a variant link, so neighbours in sorted order are enough to keep every component whole; the pairs
are deduplicated and their distance is verified. A variant has few fingerprints (65 for r = 2), however many documents
share one.

The pipeline's stage has another rule, five-word shingles with a Jaccard similarity of 0.8 or more (keep_one_similar): balls of
fingerprints link what they can, texts that share one of their rarest shingles meet as well, and all pairs are compared exactly.

Defined results: a null or wordless text has fingerprint 0, linked like any other. A null doc_id never is the smallest
of a component unless all are null. Repeated rows come out of near_duplicates as often as they come in. Columns of the input
beyond doc_id and text pass through keep_one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import in_arrow, map_rows, materialize, small, table, texts

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: The smallest Jaccard similarity of near copies in the pipeline, as a fraction.
LEAST = (4, 5)
#: One of so many texts tells which shingles are common; texts of these that hold one; most such shingles in every task.
ORDER_SAMPLE, COMMON_TEXTS, MAX_COMMON = 32, 2, 200_000
#: Bits that show of most pairs that they differ too much.
PARITIES = 512
#: Neighbours in buckets that a set meets before the rest; sets that a task remembers.
FIRST_PAIRS, SEEN = 2, 1_000_000


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """The XXH64 of all shingles in order, repeats included; a text of fewer words is one shingle, a wordless one has none."""
    words = text.lower().split() if text else []
    k = min(shingle, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(words) - k + 1)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The hashes once each, sorted, as signed numbers."""
    return np.unique(hashes).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    return fingerprint(shingle_hashes(text, shingle))


def with_fingerprint(docs: DataFrame, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """docs with the long __fp, the fingerprint's 64 bits."""

    def make():
        return lambda batch: [np.array([fingerprint_of(t, shingle) for t in texts(batch)], np.uint64).view(np.int64).tolist()]

    return map_rows(docs, make, [T.StructField("__fp", T.LongType())], keep)


def variants(fp, half: int):
    """All values that differ from fp in at most half bits."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(sum(1 << b for b in bits)) for bits in chain.from_iterable(combinations(range(64), k) for k in range(half + 1))]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: fp.bitwiseXOR(m))


def linked_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of fingerprints that differ in at most radius bits, enough of them to connect all such pairs; fps: distinct __fp."""
    from pyspark.sql import Window as W

    if radius % 2:
        raise ValueError("radius must be even: its half is the radius of the balls")
    balls = fps.select(F.explode(variants(F.col("__fp"), radius // 2)).alias("v"), F.col("__fp").alias("b"))
    pairs = balls.select("b", F.lag("b").over(W.partitionBy("v").orderBy("b")).alias("a")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for each node of pairs (a, b).

    Rounds of smallest neighbouring label, then the label's own label, until none changes.
    """
    both = materialize(pairs.union(pairs.select("b", "a")).toDF("a", "b"), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(seen, labels.node == seen.a).select("node", "root", F.least("root", "near").alias("to"))
        up = moved.select(F.col("node").alias("to"), F.col("to").alias("next"))
        labels = materialize(moved.join(up, "to").select("node", F.least("to", "next").alias("root"), (F.col("root") > F.least("to", "next")).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def groups(sig: DataFrame, radius: int = 2) -> DataFrame:
    """(__fp, root) for the distinct fingerprints of sig that have a linked partner; the others are components of their own."""
    return components(linked_pairs(sig.select("__fp").distinct(), radius)).toDF("__fp", "root")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links of at most radius bits)."""
    sig = materialize(with_fingerprint(docs.select("doc_id", "text"), shingle, keep=["doc_id"]), "fingerprints")
    per_fp = sig.groupBy("__fp").agg(F.min("doc_id").alias("m"))
    per_fp = per_fp.join(groups(sig, radius), "__fp", "left").withColumn("root", F.coalesce("root", "__fp"))
    smallest = per_fp.groupBy("root").agg(F.min("m").alias("component_id"))
    ids = materialize(per_fp.select("__fp", "root").join(smallest, "root").select("__fp", "component_id"), "components")
    return sig.join(ids, "__fp").select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def whole_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, th (the text's hash) and row, which holds all columns, so that no name of theirs matters."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("th"))


def first_of_groups(rows: DataFrame, sig: DataFrame, found: DataFrame) -> DataFrame:
    """The row of each component of sig(doc_id, th, node) under found(node, root) that comes first: by doc_id (null last), hash of the text, hash of the row."""
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    per_node = sig.groupBy("node").agg(F.min(key).alias("k")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = per_node.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.id").alias("id"), F.col("k.th").alias("h"), F.lit(True).alias("first"))
    # the keys whose rows do not all stay: those of no first document (m = 0), and those that rows share (m > 1)
    counts = sig.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.count("*").alias("n"))
    marks = counts.join(first, F.col("id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left").select("d", "t", F.when(F.col("first"), F.col("n")).otherwise(0).alias("m"))
    marks = materialize(marks.where("m <> 1"), "marks")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    out = rows.join(small(marks), same, "left_anti").select("row.*")
    shared = marks.where("m > 1")
    if shared.isEmpty():
        return out
    again = rows.join(small(shared), same).groupBy("d", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.unionByName(again.select("row.*"))


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One document of each component: that with the smallest doc_id (null last), of those with the smallest hash of the text, then of the row."""
    rows = whole_rows(docs)
    sig = materialize(with_fingerprint(rows.select("doc_id", "th", "text"), shingle, keep=["doc_id", "th"]), "fingerprints")
    return first_of_groups(rows, sig.withColumnRenamed("__fp", "node"), groups(sig, radius).toDF("node", "root"))


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def common_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and in how many of a hashed sample of rows(th, text); they only set the order of shingles, so results do not depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(shingle_set(shingle_hashes(t, shingle)) for t in texts(b))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    sample = rows.where(F.pmod("th", F.lit(ORDER_SAMPLE)) == 0).select("th", "text").dropDuplicates(["th"])
    counts = in_arrow(sample.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # at most MAX_COMMON rows
    found = sorted((r["h"], r["n"]) for r in counts.where(F.col("n") >= COMMON_TEXTS).orderBy(F.desc("n"), "h").limit(MAX_COMMON).collect())
    return np.array([h for h, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def ordered(s: np.ndarray, common: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rare ones first, and how common its shingles are on average.

    A set as similar as LEAST shares one of the first, as at least ceil(up / down * size) are shared.
    """
    up, down = LEAST
    rank = np.zeros(len(s), np.int64)
    if len(common) and len(s):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rank = np.where(common[at] == s, often[at], 0)
    return s[np.lexsort((s, rank))][: len(s) - -(-len(s) * up // down) + 1], int(rank.sum() // max(1, len(s)))


def parities(s: np.ndarray, n: int) -> np.ndarray:
    """n bits (a power of two): whether the number of hashes that fall on each is odd. Two sets differ in as many hashes as bits, or more."""
    return np.packbits(np.bincount(s & n - 1, minlength=n).astype(np.uint8) & 1).view(np.int64)


def signatures(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th, set (id of the set of shingles), fp (fingerprint), size, fame, prefix, bits and sketch of rows(doc_id, th, text).

    bits are PARITIES parities, sketch at least two for each shingle if that is more (else null). A task gives prefix, bits and
    sketch (else null) only for the first row of each set it meets.
    """
    sent = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, shingle))

    def make():
        (common, often), seen = sent.value, set()

        def one(text):
            h = shingle_hashes(text, shingle)
            s = shingle_set(h)
            name = set_id(s)
            fp = fingerprint(h)
            out = (name, fp - (1 << 64) * (fp >> 63), len(s))
            if name in seen:
                return (*out, 0, None, None, None)
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
            prefix, fame = ordered(s, common, often)
            return (*out, fame, prefix, parities(s, PARITIES), parities(s, 1 << (2 * len(s)).bit_length()) if 2 * len(s) > PARITIES else None)

        return lambda batch: list(zip(*map(one, texts(batch)), strict=True)) or [[]] * 7

    long, longs = T.LongType(), T.ArrayType(T.LongType())
    fields = [T.StructField(n, t) for n, t in (("set", long), ("fp", long), ("size", long), ("fame", T.IntegerType()), ("prefix", longs), ("bits", longs), ("sketch", longs))]
    return map_rows(rows, make, fields, keep=["doc_id", "th"])


def may_differ(size_a, size_b):
    """Times down + up, in how many shingles sets of these sizes may differ at most."""
    up, down = LEAST
    return (size_a + size_b) * (down - up)


def within_bits(x: str, y: str, size_a, size_b):
    """Whether two sets differ in few enough of their bits: they differ in as many shingles at least."""
    up, down = LEAST
    odd = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))
    return odd * (down + up) <= may_differ(size_a, size_b)


def within_sketch(x: str, y: str, size_a, size_b):
    """The same of two sketches; the longer one is folded to the length of the other, as similar sets' lengths are one step apart at most."""
    up, down = LEAST
    xor = lambda a, b: a.bitwiseXOR(b)
    n = F.least(F.size(x), F.size(y))
    fold = lambda c: F.when(F.size(c) > n, F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), xor)).otherwise(F.col(c))
    odd = F.aggregate(F.zip_with(fold(x), fold(y), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda k, b: k + b)
    return F.coalesce(odd * (down + up) <= may_differ(size_a, size_b), F.lit(True))


def confirmed(pairs: DataFrame, rows: DataFrame, sig: DataFrame, shingle: int) -> DataFrame:
    """Those of pairs (a, b) of sets whose Jaccard similarity reaches LEAST: sketches rule out most others, then the sets themselves are compared."""
    up, down = LEAST
    long = sig.where("sketch is not null").select("set", "size", "sketch").dropDuplicates(["set"])
    pairs = pairs.join(long.toDF("a", "size_a", "x"), "a", "left").join(long.toDF("b", "size_b", "y"), "b", "left")
    pairs = materialize(pairs.where(within_sketch("x", "y", F.col("size_a"), F.col("size_b"))).select("a", "b"), "possible")
    # one row of each set that is asked for: of keys (doc_id, th) those that one row has first, as only rows of others must be made distinct
    asked = materialize(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "asked")
    keys = sig.join(small(asked), "set").groupBy("set", "doc_id", "th").agg(F.count("*").alias("n"))
    keys = keys.groupBy("set").agg(F.min(F.struct(F.col("n") > 1, F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
    asked = materialize(keys.select("set", F.col("k.col1").alias("again"), F.col("k.doc_id").alias("d"), F.col("k.th").alias("t")), "asked")

    def make():
        return lambda batch: [[shingle_set(shingle_hashes(t, shingle)) for t in texts(batch)]]

    found = rows.select("doc_id", "th", "text").join(small(asked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    sets = materialize(map_rows(found, make, [T.StructField("s", T.ArrayType(T.LongType()))], keep=["set", "again"]), "sets")
    sets = sets.where("not again").select("set", "s").union(sets.where("again").groupBy("set").agg(F.first("s").alias("s")))
    # the set with more pairs is sent once, the other one for each of its pairs
    degree = materialize(pairs.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("n")), "degrees")
    pairs = pairs.join(small(degree.toDF("a", "n")), "a").join(small(degree.toDF("b", "k")), "b")
    pairs = materialize(pairs.select(F.when(F.col("n") >= F.col("k"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(F.col("n") >= F.col("k"), F.col("b")).otherwise(F.col("a")).alias("other")), "oriented")
    both = sets.toDF("other", "y").join(small(pairs), "other").join(sets.toDF("hub", "x"), "hub")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * down >= (F.size("x") + F.size("y") - shared) * up).select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"))


def ball_pairs(sig: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or meet in a ball: neighbours of a fingerprint, and one set of each of two linked fingerprints."""
    from pyspark.sql import Window as W

    own = materialize(sig.select("fp", "set").distinct(), "fingerprints")
    same = own.select(F.lag("set").over(W.partitionBy("fp").orderBy("set")).alias("a"), F.col("set").alias("b")).where("a is not null")
    first = own.groupBy("fp").agg(F.min("set").alias("set"))
    linked = linked_pairs(first.select(F.col("fp").alias("__fp")))
    across = linked.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return same.union(across.select(F.least("x", "y"), F.greatest("x", "y")))


def similar_groups(rows: DataFrame, sig: DataFrame, shingle: int) -> DataFrame:
    """(node, root) of the sets that are linked to another one, for what signatures() returns.

    Balls of fingerprints give the first pairs. Fingerprints of sets as similar as LEAST may differ in a dozen bits, too many for
    balls; so the rest comes from prefixes: two such sets share a shingle of both their prefixes. In these buckets each set first
    meets a neighbour and the one whose shingles are most common; at last all pairs that are not yet connected and that neither
    sizes, places in the prefixes nor parity bits rule out.
    """
    from pyspark.sql import Window as W

    up, down = LEAST
    w = W.partitionBy("v").orderBy(F.desc("fame"), "set")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    keys = sig.where("prefix is not null").select("set", "size", "fame", F.posexplode("prefix").alias("pos", "v")).select("v", "set", "fame", F.expr("shiftleft(size, 32) + pos").alias("x"))
    members = keys.select("v", "set", "x", F.lag("set").over(w).alias("before"), F.first("set").over(whole).alias("first"), F.last("set").over(whole).alias("last"))
    members = materialize(members.where("first <> last and (before is null or before <> set)").drop("last"), "members")
    best = W.partitionBy("set").orderBy(F.desc("n"), "other")
    met = lambda other: members.where(F.col(other) != F.col("set")).groupBy("set", F.col(other).alias("other")).agg(F.count("*").alias("n")).withColumn("n", F.row_number().over(best)).where(f"n <= {FIRST_PAIRS}").select(F.least("set", "other").alias("a"), F.greatest("set", "other").alias("b"))
    bits = materialize(sig.where("bits is not null").select("set", "size", "bits").dropDuplicates(["set"]), "bits")
    first = ball_pairs(sig).union(met("before")).union(met("first")).distinct()
    first = first.join(bits.toDF("a", "size_a", "bits_a"), "a").join(bits.toDF("b", "size_b", "bits_b"), "b").where(within_bits("bits_a", "bits_b", F.col("size_a"), F.col("size_b")))
    links = materialize(confirmed(materialize(first.select("a", "b"), "first"), rows, sig, shingle), "links")
    found = components(links)
    members = members.select("v", "set", "x").join(found, F.col("set") == F.col("node"), "left").select("v", "set", "x", F.coalesce("root", "set").alias("root"))
    members = materialize(members, "rooted")
    mixed = members.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("v")
    members = members.join(mixed, "v").join(bits.select("set", "bits"), "set")
    members = members.select("v", "set", "root", "bits", F.shiftright("x", 32).alias("size"), F.expr("x & 4294967295").alias("pos"))
    later = members.toDF("v", "set2", "root2", "bits2", "size2", "pos2")
    # of two similar sets the smaller has a shared shingle even earlier
    early = members.where(F.col("pos") <= F.col("size") * (1 - 2.0 * up / (up + down)) + 1e-6).withColumnRenamed("v", "v1")
    after = (F.col("size2") > F.col("size")) | (F.col("size2") == F.col("size")) & (F.col("set2") > F.col("set"))
    # what they can share at most if this is the first that they share
    may = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2")) * (up + down) >= (F.col("size") + F.col("size2")) * up
    left = early.join(later, (F.col("v1") == F.col("v")) & after & (F.col("root") != F.col("root2")) & may & within_bits("bits", "bits2", F.col("size"), F.col("size2")))
    left = materialize(left.select(F.least("set", "set2").alias("a"), F.greatest("set", "set2").alias("b")).distinct(), "left")
    more = materialize(confirmed(left, rows, sig, shingle), "links")
    return found if more.isEmpty() else components(links.union(more))


def keep_one_similar(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One document, as in keep_one, of each component of texts whose sets of shingles have a Jaccard similarity of LEAST or more.

    Every such pair counts. Texts of the same shingles are one set; null and wordless texts share the empty one.
    """
    rows = whole_rows(docs)
    sig = materialize(signatures(rows.select("doc_id", "th", "text"), shingle), "signatures")
    return first_of_groups(rows, sig.select("doc_id", "th", F.col("set").alias("node")), similar_groups(rows, sig, shingle))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
