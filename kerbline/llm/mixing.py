"""Mixing sources to target weights by cube-method balanced sampling.

A source whose target is r times its size takes every document floor(r) times and includes each once more with
probability r - floor(r). The cube method draws that inclusion: its flight moves the probabilities along vectors for
which the weighted totals of documents and words stay what they are, until each is 0 or 1.

Heavy units (far longer than the others of their source, at most HEAVY_UNITS of a source) fly first, each against the pool
of all units after it: what the unit gains or loses, the pool's ratio makes up for, so the words stay balanced. The pool
then flies with the ratio that is left, in groups: hash buckets of one source; what remains of them flies again in larger
groups, until one group of each source is left. Its last units, LAND of them, land on the choice nearest to the exact totals.

Flights see only (doc_id, source, size); rows that agree in all three are one unit with a multiplicity and share a
choice. Randomness comes from hashes of the keys, so reruns agree whatever the partitioning.

Defined results: a null text has size 0. A null source is a source, the last. A source of size 0 takes nothing (target 0).
Columns of the input named size, source_size, target or copies are replaced in the result of mix(); others come back,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from random import Random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACED_WORD, in_arrow, materialize, small, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MAX_COPIES = 3
#: Units of one flight, groups whose remains fly together, and units that land together.
GROUP, FAN_IN, LAND = 256, 128, 12
#: A heavy unit has over so many times the words of its source's mean unit, and over one of so many words of the source.
HEAVY, HEAVY_UNITS = 4, 1000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_units, target: shares of all sizes by weight, none above max_copies times its source's size.

    The windows see one row for each source. In order of max_copies * size / weight the sources before the first that can take
    its share of what those before it leave are full.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_units"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = sums.withColumn("weight", weight).withColumn("top", F.col("source_size") * float(max_copies))
    order = W.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    open_weight = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))
    leveled = sources.withColumn("level", left / open_weight)
    # levels rise as long as sources fill up; the first source with room sets the level for all after it
    room = F.col("top") > F.col("weight") * F.col("level")
    final = F.min(F.when(room, F.struct("at", "level"))).over(W.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    leveled = leveled.withColumn("at", F.row_number().over(order)).withColumn("final", final)
    target = F.when(F.col("final").isNull(), F.col("top")).otherwise(F.least("top", F.col("weight") * F.col("final.level")))
    return leveled.select("source", "source_size", "n_units", target.alias("target"))


def fly(units: list[list], rng: Random) -> Iterator[list]:
    """Moves the probabilities (last entries) of units [m, words, ..., p] until all but two are 0 or 1; yields units as they settle, then the rest."""
    work: list[list] = []
    for unit in units:
        work.append(unit)
        while len(work) == 3:
            (a1, b1), (a2, b2), (a3, b3) = ((float(u[0]), float(u[1])) for u in work)
            move = (a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1)
            if not any(move):  # all in proportion: two of them are enough
                move = (a2, -a1, 0.0)
            size = max(map(abs, move))
            move = [x / size for x in move]
            up = min((1 - u[-1]) / x if x > 0 else -u[-1] / x for u, x in zip(work, move, strict=True) if x)
            down = min(u[-1] / x if x > 0 else (u[-1] - 1) / x for u, x in zip(work, move, strict=True) if x)
            step = up if rng.random() * (up + down) < down else -down
            for u, x in zip(work, move, strict=True):
                p = u[-1] + step * x
                u[-1] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
            settled = [u for u in work if u[-1] in (0.0, 1.0)]
            work = [u for u in work if u[-1] not in (0.0, 1.0)]
            yield from settled
            if not settled:  # rounding left the nearest one short of its bound
                near = min(range(len(work)), key=lambda i: min(work[i][-1], 1 - work[i][-1]))
                work[near][-1] = float(round(work[near][-1]))
                yield work.pop(near)
    yield from work


def land(units: list[list]) -> None:
    """Settles the few units left so that words, and less so documents, come nearest to their expectation."""
    if not units:
        return
    want = sum(u[1] * u[-1] for u in units), sum(u[0] * u[-1] for u in units)
    mean = max(1.0, sum(u[1] for u in units) / len(units))

    def far(c):
        return 32 * abs(sum(u[1] * x for u, x in zip(units, c, strict=True)) - want[0]) / mean + abs(sum(u[0] * x for u, x in zip(units, c, strict=True)) - want[1])

    for u, x in zip(units, min(product((0.0, 1.0), repeat=len(units)), key=lambda c: (far(c), c)), strict=True):
        u[-1] = x


def flights(units: DataFrame, level: int, last: bool) -> DataFrame:
    """One flight in each group (source, bucket) of units(doc_id, source, size, m, p, bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[list] = []
        key: tuple | None = None
        schema = None

        def settle() -> list[list]:
            # in the last flight some units wait for the landing
            held = group[: LAND - 2] if last else []
            out = list(fly(group[len(held) :], Random(f"{level}/{key}")))
            if last:
                land(held + [u for u in out if u[-1] not in (0.0, 1.0)])
            return held + out

        done: list[list] = []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((u[2], u[3], u[4], u[0], u[-1], u[5]) for u in rows)), schema, strict=True)], schema=schema)
        for b in batches:
            schema = b.schema
            for doc, source, size, m, p, bucket in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (source, bucket) != key:
                    done += settle() if group else []
                    group, key = [], (source, bucket)
                group.append([m, m * size, doc, source, size, bucket, p])
            if len(done) >= 10_000:
                yield pack(done)
                done = []
        done += settle() if group else []
        if done:
            yield pack(done)

    order = F.xxhash64("doc_id", "size")
    dealt = units.select("doc_id", "source", "size", "m", "p", "bucket").repartition("source", "bucket").sortWithinPartitions("source", "bucket", order, "doc_id", "size")
    return in_arrow(dealt, run, dealt.schema)


def settle_heavy(heavy: DataFrame, max_copies: int) -> DataFrame:
    """doc_id, source, size, m and whole, the copies of heavy(doc_id, source, size, m, source_size, target): the longest first, each by the ratio that is left then.

    A source has at most HEAVY_UNITS such rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = run
        left = of = 0.0
        rng = Random(0)
        for b in batches:
            out = []
            for doc, source, size, m, source_size, target in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if source != key:
                    key, left, of, rng = source, target, float(source_size), Random(f"heavy/{source}")
                ratio = min(float(max_copies), max(0.0, left / of)) if of > 0 else 0.0
                whole = int(ratio + 1e-9)
                copies = whole + (rng.random() < ratio - whole)
                left, of = left - copies * size * m, of - size * m
                out.append((doc, source, size, m, copies))
            columns = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (*b.schema.types[:4], pa.int64()), strict=True)], ["doc_id", "source", "size", "m", "whole"])

    rows = heavy.select("doc_id", "source", "size", "m", "source_size", "target")
    kinds = dict(rows.dtypes)
    dealt = rows.repartition("source").sortWithinPartitions("source", F.desc(F.col("size") * F.col("m")), F.xxhash64("doc_id", "size"), "doc_id")
    return in_arrow(dealt, run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "source", "size", "m")) + ", whole long")


def choices(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, source, size, m (rows that agree), source_size, target and copies (of each row) for docs(doc_id, source, size)."""
    units = materialize(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "units")
    sources = materialize(source_targets(units, weights, max_copies), "targets")
    with_source = lambda df, s: df.join(s.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    heavy = F.col("size") * F.col("m") > F.greatest(HEAVY * F.col("source_size") / F.col("n_units"), F.col("source_size") / HEAVY_UNITS)
    all_units = with_source(units, sources).withColumn("heavy", F.coalesce(heavy, F.lit(False)))
    first = materialize(settle_heavy(all_units.where("heavy"), max_copies), "heavy")
    gone = first.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size_gone"), F.sum(F.col("whole") * F.col("size") * F.col("m")).alias("taken"))
    sources = with_source(sources, gone).na.fill(0, ["size_gone", "taken"])
    pool = F.col("source_size") - F.col("size_gone")
    ratio = F.when(pool > 0, F.least(F.greatest((F.col("target") - F.col("taken")) / pool, F.lit(0.0)), F.lit(float(max_copies)))).otherwise(0.0)
    whole = F.least(F.floor(ratio + 1e-9), F.lit(max_copies)).cast("long")
    rest = F.greatest(ratio - whole, F.lit(0.0))
    sources = materialize(sources.withColumn("whole", whole).withColumn("p", F.when(rest < 1e-9, 0.0).otherwise(rest)), "ratios")
    light = with_source(all_units.where("not heavy").select("doc_id", "source", "size", "m"), sources)
    groups = F.ceil(F.col("n_units") / GROUP).cast("long")
    level, flying = 0, light.where("p > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), groups))
    settled = first.select("doc_id", "source", "size", F.col("whole").alias("extra"))
    # as many rounds as the largest source needs until one group is left
    most = (sources.agg(F.max("n_units")).first()[0] or 0) // GROUP + 1
    while True:
        flown = materialize(flights(flying, level, last=most == 1), f"flight{level}")
        settled = settled.unionByName(flown.where("p = 0 or p = 1").select("doc_id", "source", "size", F.col("p").cast("long").alias("extra")))
        if most == 1:
            break
        most, level = -(-most // FAN_IN), level + 1
        flying = flown.where("p > 0 and p < 1").withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))
    extra = settled.toDF("of_doc", "of_source", "of_size", "extra")
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    out = with_source(all_units.select("doc_id", "source", "size", "m", "heavy"), sources).join(extra, same, "left")
    copies = F.when(F.col("heavy"), 0).otherwise(F.col("whole")) + F.coalesce("extra", F.lit(0))
    return out.select("doc_id", "source", "size", "m", "source_size", F.col("target").cast("double").alias("target"), copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """docs, each row as often as the mix takes it, with size, source_size, target and copies."""
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    # a struct holds all columns, so that no name of theirs matters
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), words(F.col("text")).alias("z"))
    found = materialize(choices(rows.select(F.col("d").alias("doc_id"), F.col("s").alias("source"), F.col("z").alias("size")), weights, max_copies).drop("m").where("copies > 0"), "choices")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size"))
    taken = rows.join(small(found), same).select("row", "size", "source_size", "target", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select("row.*", "size", "source_size", "target", "copies")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    rows = choices(docs).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Sizes and targets of op4 in SQL; which documents make up a source's words is the method's draw.
OP4_SIZES_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS i, (sum(source_size) OVER ()
    - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s),
f AS (SELECT min(i) AS i, arg_min(level, i) AS level FROM o WHERE 3.0 * source_size > w * level)
SELECT doc_id, size, source_size, round(CASE WHEN f.i IS NULL OR o.i < f.i THEN 3.0 * source_size ELSE least(3.0 * source_size, w * f.level) END, 4)::DOUBLE AS target
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, f
"""


def op4_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))
