"""Exact Jaccard join of shingle sets by skipping over relations between sets, down to the components of its links.

Equal sets are one set. Sets are ordered rare shingles first, and two sets that link share one of their first shingles, so an
inverted index over these prefixes finds every link. Two relations save most of the work:

Index: the prefixes are shuffled once, as short numbers of sets. Most lists end there, as they hold one set or one component; short
ones give their pairs where they lie. A longer list is kept in blocks of one step of sizes and one bin of positions. Whether two
blocks can hold a link depends on their bins alone, so blocks are joined only where it can be, and all others are skipped at once.

Answers: a set that is highly similar to a leader (the set with the most common shingles among those that share a minimal hash) joins
its family. A family has a centre, the shingles that most of it hold, and each set is kept as what it lacks of the centre and
adds to it. Only families meet in lists, and only centres are intersected. A set's overlap with any other is that of its centre,
less what it lacks, plus what it adds; families whose centres overlap too little for that to reach a link are skipped without
looking at their sets, and of others only the sets that hold what the centres do not share, or are small enough, are looked at.
A family is connected by its links, so pairs within it are never made, and neither are pairs of one component.

Defined results: a null or wordless text has the empty set, which links with nothing; its document is a component of its own. A
null doc_id never is the smallest of a component unless all are null. Repeated rows come out as often as they come in. An
empty table gives an empty result. Only doc_id and text are read, whatever else there is. Shingles are told apart by their 64-bit
XXH64. Memory: the set of one text, a set's differences to its centre.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialize, small, table, texts
from .near_dup import SEEN, common_shingles, components, parities, set_id, shingle_hashes, shingle_set

#: The smallest similarity of a link as a fraction, words of a shingle.
LEAST, SHINGLE = (17, 20), 4
#: Odd multipliers of the minimal hashes by which sets find a leader.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Bins of positions in a prefix.
BINS = 4
#: Sets of a family, nearest to its centre first, that meet another family before all that may matter do.
CENTRAL = 4
#: Sets of a list whose pairs are made within it; texts of the sample that hold a shingle whose list is never brought together.
SHORT, HOT_TEXTS = 8, 32


class Rule:
    """What a link of similarity up / down asks of two sets."""

    def __init__(self, up: int, down: int):
        self.up, self.down = up, down

    def prefix(self, n: int) -> int:
        """Of a set of n, the number of first shingles of which it shares one with every linked set."""
        return n - -(-n * self.up // self.down) + 1

    def enough(self, shared: Column, sizes: Column) -> Column:
        """Whether sets of these sizes together link if they share so many."""
        return shared * (self.up + self.down) >= sizes * self.up

    def may_differ(self, sizes: Column) -> Column:
        """Times up + down: in how many shingles linked sets differ at most."""
        return sizes * (self.down - self.up)

    def step(self, size: Column) -> Column:
        """Sizes of linked sets are one step apart at most."""
        return F.floor(F.log(size.cast("double")) / float(np.log(self.down / self.up)) + 1e-9)

    def bin(self, pos: Column, size: Column) -> Column:
        width = (self.down - self.up) / self.down / BINS
        return F.least(F.floor(pos / size / width + 1e-9), F.lit(BINS - 1)).cast("int")

    def meeting(self, i: int) -> list[int]:
        """The bins in which a set may have a shingle that is the first it shares with a linked set that has it in bin i."""
        width, half = (self.down - self.up) / self.down / BINS, self.up / (self.up + self.down)
        rest = lambda k: (1 - k * width) / half - 1 + 1e-6
        return [j for j in range(BINS) if rest(i) * rest(j) >= 1]


def signatures(rows: DataFrame, shingle: int, rule: Rule, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, th, set (id of the set), size, and for the first row of each set that a task meets fame, prefix, bits, keys and number; for rows(doc_id, th, text).

    fame: how common the shingles are on average; prefix: the first shingles, rare ones first; bits: at least two parities for each
    shingle; keys: minimal hashes; number: of the row among all, in the order of tasks, which a shuffle packs better than a hash.
    """
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def make():
        (common, often), seen = sent.value, set()
        numbers = itertools.count(TaskContext.get().partitionId() << 33)

        def one(text):
            s = shingle_set(shingle_hashes(text, shingle))
            name, n = set_id(s), len(s)
            if name in seen or not n:
                return name, n, None, None, None, None, None
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
            rank = np.zeros(n, np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                rank = np.where(common[at] == s, often[at], 0)
            first = s[np.lexsort((s, rank))][: rule.prefix(n)]
            keys = (s.view(np.uint64)[:, None] * MULTIPLIERS).min(axis=0).view(np.int64)
            return name, n, int(rank.sum() // n), first, parities(s, max(64, 1 << (2 * n - 1).bit_length())), keys, next(numbers)

        return lambda batch: list(zip(*map(one, texts(batch)), strict=True)) or [[]] * 7

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField(n, t) for n, t in (("set", T.LongType()), ("size", T.LongType()), ("fame", T.LongType()), ("prefix", longs), ("bits", longs), ("keys", longs), ("number", T.LongType()))]
    return map_rows(rows, make, fields, keep=["doc_id", "th"])


def odd_bits(x: str, y: str) -> Column:
    """In how many parities two sets differ, which they do in as many shingles or more; the longer list is folded to half, as linked sets' lists are one step apart at most."""
    xor = lambda a, b: a.bitwiseXOR(b)
    n = F.least(F.size(x), F.size(y))
    fold = lambda c: F.when(F.size(c) > n, F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), xor)).otherwise(F.col(c))
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda k, b: k + b)


def listed(ids: DataFrame, rows: DataFrame, sig: DataFrame, shingle: int) -> DataFrame:
    """set and s, its shingles, for the distinct sets of ids(set); each from one of its texts."""
    # of keys (doc_id, th) those that one row has come first, as only rows of others must be made distinct
    keys = sig.select("set", "doc_id", "th").join(small(ids), "set").groupBy("set", "doc_id", "th").agg(F.count("*").alias("n"))
    keys = keys.groupBy("set").agg(F.min(F.struct(F.col("n") > 1, F.col("doc_id").isNull(), "doc_id", "th")).alias("k"))
    asked = materialize(keys.select("set", F.col("k.col1").alias("again"), F.col("k.doc_id").alias("d"), F.col("k.th").alias("t")), "asked")

    def make():
        return lambda batch: [[shingle_set(shingle_hashes(t, shingle)) for t in texts(batch)]]

    found = rows.select("doc_id", "th", "text").join(small(asked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    sets = materialize(map_rows(found, make, [T.StructField("s", T.ArrayType(T.LongType()))], keep=["set", "again"]), "sets")
    return sets.where("not again").select("set", "s").unionByName(sets.where("again").groupBy("set").agg(F.first("s").alias("s")))


def families(sets: DataFrame, rows: DataFrame, sig: DataFrame, shingle: int, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links (a, b), people (set, leader, size, lacks, adds: of and to the centre; leaders included) and centres (leader, out, more: what the leader has and lacks that the centre has not and has)."""
    keys = sets.select("set", F.explode("keys").alias("key"), (-F.col("fame")).alias("less"))
    leaders = keys.groupBy("key").agg(F.min(F.struct("less", "set")).alias("first"), F.max(F.struct("less", "set")).alias("last")).where("first.set <> last.set")
    leaders = materialize(leaders.select("key", F.col("first.set").alias("leader")), "leaders")
    pairs = keys.join(small(leaders), "key").where("set <> leader").select("set", "leader").distinct()
    own = sets.select("set", "size", "bits")
    pairs = pairs.join(own, "set").join(own.toDF("leader", "size2", "bits2"), "leader")
    sizes = F.col("size") + F.col("size2")
    pairs = pairs.where(rule.enough(F.least("size", "size2"), sizes) & (odd_bits("bits", "bits2") * (rule.up + rule.down) <= rule.may_differ(sizes)))
    pairs = materialize(pairs.select("set", "leader", "size", "size2"), "to-leaders")
    ids = materialize(pairs.select("set").union(pairs.select("leader")).distinct(), "ids")
    lists = listed(ids, rows, sig, shingle)
    both = pairs.join(lists, "set").join(lists.toDF("leader", "t"), "leader")
    both = both.withColumns({"lacks": F.array_except("t", "s"), "adds": F.array_except("s", "t")})
    near = materialize(both.where(rule.enough(F.col("size") - F.size("adds"), F.col("size") + F.col("size2"))).drop("s", "t"), "near")
    links = near.select(F.least("set", "leader").alias("a"), F.greatest("set", "leader").alias("b")).distinct()
    # a leader that has members stays one; others go to the nearest of their leaders
    better = near.select("set", "leader", "size", "size2", "lacks", "adds", (F.size("lacks") + F.size("adds")).alias("apart"))
    chosen = better.groupBy("set").agg(F.min(F.struct("apart", "leader")).alias("c")).select("set", F.col("c.leader").alias("leader"))
    kept = materialize(chosen.select("leader").distinct(), "whole")
    members = better.join(chosen, ["set", "leader"]).join(small(kept.withColumnRenamed("leader", "set")), "set", "left_anti").drop("apart")
    members = materialize(members, "members")
    none = F.array().cast("array<bigint>")
    sizes = members.groupBy("leader").agg(F.count("*").alias("n"), F.first("size2").alias("size"))
    turned = members.select("leader", F.explode("lacks").alias("token"), F.lit(True).alias("out")).unionByName(members.select("leader", F.explode("adds").alias("token"), F.lit(False).alias("out")))
    turned = turned.groupBy("leader", "token", "out").agg(F.count("*").alias("k")).join(sizes, "leader").where("2 * k > n")
    turned = turned.groupBy("leader").agg(F.collect_list(F.when(F.col("out"), F.col("token"))).alias("out"), F.collect_list(F.when(~F.col("out"), F.col("token"))).alias("more"))
    centres = materialize(sizes.join(turned, "leader", "left").select("leader", "size", F.coalesce("out", none).alias("out"), F.coalesce("more", none).alias("more")), "centres")
    people = members.drop("size2").unionByName(centres.select(F.col("leader").alias("set"), "leader", "size", none.alias("lacks"), none.alias("adds"))).join(small(centres.drop("size")), "leader")
    lacks = F.array_union(F.array_except("lacks", "out"), F.array_except("more", "adds"))
    adds = F.array_union(F.array_except("adds", "more"), F.array_except("out", "lacks"))
    return links, materialize(people.select("set", "leader", "size", lacks.alias("lacks"), adds.alias("adds")), "people"), centres


def distinct_sets(sig: DataFrame) -> DataFrame:
    """Of the rows of sig that tell all of a set, one for each set; only ids are shuffled."""
    told = sig.where("prefix is not null").drop("doc_id", "th")
    again = told.groupBy("set").agg(F.min("number").alias("kept"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again.select("set", "kept"), "again")
    return told.join(small(again), "set", "left").where("kept is null or kept = number").drop("kept")


def candidates(sets: DataFrame, family: DataFrame, found: DataFrame, rule: Rule, hot: list[int]) -> DataFrame:
    """Pairs a < b of numbers of leaders of different components whose families may hold a link; family: set, leader; found: node, root; hot: shingles whose lists may be very long."""
    ids = sets.select("set", "number")
    places = found.join(family.withColumnRenamed("set", "node"), "node", "left").join(ids.toDF("root", "in_root"), "root").join(ids.toDF("leader", "in_leader"), "leader", "left")
    places = materialize(places.select("node", "in_root", "in_leader"), "places")
    placed = sets.select("set", "number", "size", "prefix").join(small(places), F.col("set") == F.col("node"), "left")
    placed = placed.select(F.coalesce("in_leader", "number").alias("leader"), F.coalesce("in_root", "number").alias("root"), "size", F.posexplode("prefix").alias("pos", "v"))
    listed_hot = F.broadcast(sets.sparkSession.createDataFrame([(v,) for v in hot], "v long"))
    whole = W.partitionBy("v")
    # only lists with sets of more than one component matter
    lists = placed.join(listed_hot, "v", "left_anti") if hot else placed
    lists = lists.select("*", F.count("*").over(whole).alias("n"), F.min("root").over(whole).alias("lo"), F.max("root").over(whole).alias("hi")).where("lo <> hi")
    one, near = F.struct("leader", "root", "size", "pos"), whole.orderBy("leader", "root", "size", "pos")
    rest = lambda x: F.col("size") - F.col("pos") if x is None else x["size"] - x["pos"]
    meets = lambda x: (x["root"] != F.col("root")) & rule.enough(F.least(rest(None), rest(x)), F.col("size") + x["size"])
    later = F.filter(F.array(*[F.lead(one, k).over(near) for k in range(1, SHORT)]), lambda x: x.isNotNull() & meets(x))
    others = F.when(F.col("n") <= SHORT, F.transform(later, lambda x: x["leader"])).otherwise(F.array().cast("array<bigint>"))
    lists = lists.withColumn("others", others).where((F.col("n") > SHORT) | (F.size("others") > 0))
    lists = materialize(lists.select("v", "leader", "root", "size", "pos", "n", "others"), "lists")
    short = lists.select("leader", F.explode("others").alias("other")).select(F.least("leader", "other").alias("a"), F.greatest("leader", "other").alias("b"))
    long = lists.where(F.col("n") > SHORT).select("v", "leader", "root", "size", "pos")
    if hot:
        more = placed.join(listed_hot, "v", "left_semi").select("v", "leader", "root", "size", "pos")
        mixed = more.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("v")
        long = long.unionByName(more.join(F.broadcast(mixed), "v"))
    each = long.select("v", "leader", "root", "size", (F.col("size") - F.col("pos")).alias("rest"), rule.step(F.col("size")).alias("step"), rule.bin(F.col("pos"), F.col("size")).alias("bin"))
    blocks = materialize(each.groupBy("v", "step", "bin", "leader", "root").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max("rest").alias("rest")), "blocks")
    meeting = F.array(*[F.array(*[F.lit(j) for j in rule.meeting(i)]).cast("array<int>") for i in range(BINS)])
    asking = blocks.withColumn("bin", F.explode(F.get(meeting, "bin"))).withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("step", F.col("step") + F.col("up")).toDF("v", "step", "bin", "leader2", "root2", "least2", "most2", "rest2", "up")
    sizes = F.col("least") + F.col("least2")
    # within a step each pair of leaders meets twice, once in either order
    once = (F.col("root") != F.col("root2")) & ((F.col("up") == 1) | (F.col("leader") < F.col("leader2")))
    fits = (F.col("least") * rule.up <= F.col("most2") * rule.down) & (F.col("least2") * rule.up <= F.col("most") * rule.down) & rule.enough(F.least("rest", "rest2"), sizes)
    met = blocks.hint("shuffle_merge").join(asking, ["v", "step", "bin"]).where(once & fits)
    met = met.select(F.least("leader", "leader2").alias("a"), F.greatest("leader", "leader2").alias("b"))
    return short.unionByName(met).distinct()


def derived(pairs: DataFrame, people: DataFrame, lists: DataFrame, rule: Rule, central: bool) -> DataFrame:
    """Links (a, b) between sets of the families of pairs, from their centres' overlap and the sets' differences.

    pairs: families a and b, what their centres share, and lo and adds of each (smallest size, most that a set adds). lists: the
    centres. Central: only the sets nearest to their centres are compared. Otherwise a set counts that adds a shingle which the other
    family holds, or that could link by what the centres share if it adds none; no other set can have a link.
    """
    inside = lambda x, of: F.size(F.array_intersect(x, of))
    asked = materialize(pairs.select(F.explode(F.array("a", "b")).alias("leader")).distinct(), "asked")
    none = F.array().cast("array<bigint>")
    here = people.join(small(asked), "leader", "left_semi")
    alone = lists.join(people.select(F.col("leader").alias("set")), "set", "left_anti").join(asked.withColumnRenamed("leader", "set"), "set", "left_semi")
    here = here.unionByName(alone.select("set", F.col("set").alias("leader"), F.size("s").cast("long").alias("size"), none.alias("lacks"), none.alias("adds")))
    if central:
        nearest = W.partitionBy("leader").orderBy(F.size("lacks") + F.size("adds"), "set")
        here = here.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= CENTRAL).drop("n")
    here = materialize(here, "sets-of-pairs")
    if not central:
        tokens = lists.toDF("holder", "s").join(asked.withColumnRenamed("leader", "holder"), "holder", "left_semi").select("holder", F.explode("s").alias("token"))
        tokens = tokens.unionByName(here.select(F.col("leader").alias("holder"), F.explode("adds").alias("token"))).distinct()
        reaching = here.select("leader", "set", F.explode("adds").alias("token")).join(tokens, "token").where("leader <> holder")
        reaching = materialize(reaching.select("leader", "holder", "set").distinct(), "reaching")

    def side(mine: str, other: str, j: int) -> DataFrame:
        """Sets of one side with change, by which their overlap with the other centre differs from their own centre's."""
        of = pairs.select("a", "b", "shared", f"adds{j}", f"lo{j}")
        if central:
            chosen = of.join(here.select("set", "leader"), F.col(mine) == F.col("leader")).select("a", "b", "set")
        else:
            by_token = of.join(reaching, (F.col(mine) == F.col("leader")) & (F.col(other) == F.col("holder"))).select("a", "b", "set")
            fits = rule.enough(F.col("shared") + F.col(f"adds{j}"), F.col("size") + F.col(f"lo{j}"))
            chosen = by_token.unionByName(of.join(here.select("set", "leader", "size"), (F.col(mine) == F.col("leader")) & fits).select("a", "b", "set")).distinct()
        met = chosen.join(pairs.select("a", "b", "shared"), ["a", "b"]).join(here, "set").join(lists.toDF("o", "s"), F.col(other) == F.col("o"))
        return met.select("a", "b", "shared", "set", "size", "lacks", "adds", (inside("adds", "s") - inside("lacks", "s")).alias("change"))

    x, y = side("a", "b", 2), side("b", "a", 1).toDF("a", "b", "shared2", "set2", "size2", "lacks2", "adds2", "change2")
    base, sizes = F.col("shared") + F.col("change") + F.col("change2"), F.col("size") + F.col("size2")
    may = rule.enough(base + F.least(F.size("lacks"), F.size("lacks2")) + F.least(F.size("adds"), F.size("adds2")), sizes)
    shared = base + inside("lacks", "lacks2") + inside("adds", "adds2") - inside("lacks", "adds2") - inside("adds", "lacks2")
    met = x.join(y, ["a", "b"]).where(may & rule.enough(shared, sizes))
    return met.select(F.least("set", "set2").alias("a"), F.greatest("set", "set2").alias("b")).distinct()


def apart_pairs(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """pairs (a, b, ...) of which a and b are of different components found(node, root)."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(found.toDF("node", f"root_{side}"), F.col(side) == F.col("node"), "left").drop("node")
    return out.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def linked_sets(rows: DataFrame, sig: DataFrame, shingle: int, rule: Rule, hot: list[int]) -> DataFrame:
    """(node, root) of the sets that link with another one."""
    sets = distinct_sets(sig)
    links, people, centres = families(sets, rows, sig, shingle, rule)
    links = materialize(links, "links")
    found = components(links)
    family = people.groupBy("leader").agg(F.min("size").alias("lo"), F.max(F.size("adds")).alias("adds"), F.max(F.size("adds") + F.size("lacks")).alias("apart"))
    family = materialize(family.join(centres.select("leader", (F.size("out") + F.size("more")).alias("moved")), "leader"), "families")
    own = sets.select("number", "set", "size", "bits").join(small(family), F.col("set") == F.col("leader"), "left").drop("leader")
    # no set of the family is further from the leader
    apart = F.coalesce(F.col("apart") + F.col("moved"), F.lit(0))
    own = own.select("number", "set", "size", "bits", F.coalesce("lo", "size").alias("lo"), F.coalesce("adds", F.lit(0)).alias("adds"), apart.alias("apart"))
    pairs = candidates(sets, people.select("set", "leader"), found, rule, hot)
    pairs = pairs.join(own.toDF("a", *[f"{c}1" for c in own.columns[1:]]), "a").join(own.toDF("b", *[f"{c}2" for c in own.columns[1:]]), "b")
    lists_fit = F.least(F.size("bits1"), F.size("bits2")) * 2 >= F.greatest(F.size("bits1"), F.size("bits2"))
    apart = F.when(lists_fit, odd_bits("bits1", "bits2")).otherwise(0) - F.col("apart1") - F.col("apart2")
    highest = (F.col("size1") + F.col("size2") + F.col("apart1") + F.col("apart2")) * (rule.down - rule.up)
    pairs = materialize(pairs.where(apart * (rule.up + rule.down) <= highest).select(F.col("set1").alias("a"), F.col("set2").alias("b"), "lo1", "lo2", "adds1", "adds2"), "pairs")
    ids = materialize(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "ids")
    lists = listed(ids, rows, sig, shingle).join(small(centres.select(F.col("leader").alias("set"), "out", "more")), "set", "left")
    lists = lists.select("set", F.when(F.col("out").isNull(), F.col("s")).otherwise(F.array_union(F.array_except("s", "out"), "more")).alias("s"))
    lists = materialize(lists, "centre-lists")
    met = pairs.join(lists.toDF("a", "x"), "a").join(lists.toDF("b", "y"), "b").withColumn("shared", F.size(F.array_intersect("x", "y"))).drop("x", "y")
    met = materialize(met.where(rule.enough(F.col("shared") + F.col("adds1") + F.col("adds2"), F.col("lo1") + F.col("lo2"))), "met")
    for central in (True, False):
        if met.isEmpty():
            break
        more = materialize(derived(met, people, lists, rule, central), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links)
            met = materialize(apart_pairs(met, found), "met")
        if central:
            # sets without a family have been compared
            families_of = people.select("leader").distinct()
            met = met.join(families_of.withColumn("fa", F.lit(True)), F.col("a") == F.col("leader"), "left").drop("leader").join(families_of.withColumn("fb", F.lit(True)), F.col("b") == F.col("leader"), "left").drop("leader")
            met = materialize(met.where("fa or fb").drop("fa", "fb"), "met")
    return found


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, n_shingles (size of the document's set) and component_id (smallest doc_id reachable over links) of each row of docs(doc_id, text)."""
    rule = Rule(*least)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    common, often = common_shingles(rows, shingle)
    sig = materialize(signatures(rows, shingle, rule, (common, often)), "signatures")
    found = linked_sets(rows, sig, shingle, rule, common[often >= HOT_TEXTS].tolist())
    per_set = sig.where("size > 0").groupBy("set").agg(F.min("doc_id").alias("m"), F.count("*").alias("n"))
    per_set = per_set.join(found, F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("root", "set"))
    smallest = per_set.groupBy("root").agg(F.min("m").alias("component_id"), F.sum("n").alias("in_all"))
    # documents alone in their component need no join
    ids = per_set.join(smallest.where("in_all > 1"), "root").select("set", "component_id")
    ids = materialize(ids, "components").withColumn("known", F.lit(True))
    out = sig.select("doc_id", "set", "size").join(small(ids), "set", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("known") & (F.col("size") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
