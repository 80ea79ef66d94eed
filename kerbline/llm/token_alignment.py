"""Alignment of two tokenizers' tokens by their common byte ends, and how often their ids meet in the corpus.

Space + text is encoded by a byte-level BPE (A) and by a piece BPE (B). Byte offsets at which a token of A and a token of B both
end cut the tokens into groups; all pairs of an A and a B token of a group are links. Ends are running sums of token lengths,
common cuts their intersection, group labels a binary search among the cuts, links an expansion by repetition, all in NumPy
over many units of text at once. A unit is a stretch of text over whose ends neither tokenizer ever joins anything (mostly a word with
the space before it; which ends are safe is read from the vocabularies), so its tokens, groups and links are the same wherever it
stands, and a task keeps those of the units it has met. Where a vocabulary allows no such ends the whole text is one unit.

Spark counts id pairs by documents in two stages, first by pair and salt, then by pair. The counts go back to the documents as
sorted arrays while they are at most MAX_TABLE pairs, else by a join that is salted alike; the results are the same.

Defined results: a null or empty text, or one whose tokens' bytes do not give space + text back, has no tokens: counts are zero and
groups_sha256 is the empty text. Repeated rows count as documents of their own. An empty table gives an empty result. Columns
beyond doc_id and text are ignored by the reports and pass through alignments(). Memory: texts are cut into units STEP at a
time; a group without an inner cut holds as many links as its tokens multiply to.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, map_rows, materialize, table, texts

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Units that a task keeps; bytes of text handled at once; units cut at a time.
MAX_UNITS, BATCH_BYTES, STEP = 600_000, 2_000_000, 100_000
#: Pairs whose counts are sent to every task (some 20 bytes each); salts of a pair.
MAX_TABLE, SALTS = 4_000_000, 16
#: Characters that some regular expressions take as white space.
SPACES = "\t-\r\x1c-\x20\x85\xa0 ᠎ -​    ⁠　﻿"
ESCAPED_SPACE = "▁"
#: Marks before which a unit may begin, behind a letter.
STOPS, LETTER = ".,;:!?", r"[^\W\d_]"


def unit_pattern(breaks: str, stops: str) -> re.Pattern:
    """Units begin before a space or one of breaks that follows another character, after a lone one of breaks, and at one of stops behind a letter."""
    wide = f"[{SPACES}]"
    # white space at which no unit begins
    inner = f"(?:(?![ {breaks}]){wide})"
    lone = f"[{breaks}](?=[^{SPACES}])|" if breaks else ""
    more = f"(?:[^{SPACES}{stops}]+|(?<!{LETTER})[{stops}])*" if stops else f"[^{SPACES}]*"
    return re.compile(f"{lone}{wide}*[^{SPACES}]{more}(?:{inner}{wide}*{more})*|{wide}+")


WHOLE = re.compile(r"(?s).+")


def byte_of_char() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A: a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        told = json.loads(self.model.to_str())
        pre = told.get("pre_tokenizer") or {}
        self.cuts = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        byte, vocab = byte_of_char(), self.model.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(units, add_special_tokens=False)]


class PieceBpe:
    """B: a piece BPE of the sentencepiece library, which puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        of_byte = lambda p: bytes([int(p[3:5], 16)])
        self.bytes = [of_byte(p) if self.model.is_byte(i) else p.replace(ESCAPED_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(ESCAPED_SPACE in p.lstrip(ESCAPED_SPACE) for p in pieces) and self.model.encode("\n") == self.model.encode("\n\n")[:-1]
        # line ends join nothing if no piece holds one beside others
        self.breaks = "\n" if not any("\n" in p for p in pieces if len(p) > 1) else ""
        # letters are joined to no mark that follows none in any piece
        self.stops = "".join(c for c in STOPS if not any(re.search(LETTER + re.escape(c), p) for p in pieces))
        self.lead = self.model.encode("\n")

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of units as parts of a longer text: those that do not begin with a space before more are encoded behind a line end, whose ids go."""
        own = [u[0] == " " and len(u) > 1 for u in units]
        ids = self.model.encode([u[1:] if mine else "\n" + u for u, mine in zip(units, own, strict=True)], num_threads=1)
        return [x if mine else x[len(self.lead) :] for x, mine in zip(ids, own, strict=True)]


def expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] numbers for each i."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    """Tokens, groups and links of the units that a task has met."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([*map(len, x.bytes)], np.int64) for x in (a, b))
        self.text_a, self.text_b = ([*map(str, range(len(x.bytes)))] for x in (a, b))
        self.pattern = unit_pattern(b.breaks, b.stops) if a.cuts and b.cuts else WHOLE
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        #: Of each unit: groups as text, whether its bytes come back, tokens of A and B, groups, links, first link pair.
        self.groups: list[str] = []
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.first = array("b"), array("q"), array("q"), array("q"), array("q"), array("q", [0])
        #: Distinct id pairs of all units (A's id times B's size + B's id) and how often each is linked.
        self.pairs, self.times = array("q"), array("q")

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the units of space + text for each of texts, which together are short; a long one may stand alone."""
        if len(texts) == 1 and len(texts[0]) > BATCH_BYTES:
            found, out = (m.group() for m in self.pattern.finditer(" " + texts[0])), []
            while some := [*islice(found, STEP)]:
                out.append(self.numbers(some))
            return [np.concatenate(out)]
        found = [self.pattern.findall(" " + t) for t in texts]
        ends = np.cumsum([*map(len, found)])
        return np.split(self.numbers([*chain.from_iterable(found)]), ends[:-1])

    def numbers(self, units: list[str]) -> np.ndarray:
        if new := [u for u in dict.fromkeys(units) if u not in self.at]:
            self.add(new)
        return np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))

    def add(self, units: list[str]) -> None:
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units)), strict=True))
        a, b, raw = self.a.encode(units), self.b.encode(units), [u.encode() for u in units]
        joined = lambda ids, of: b"".join(map(of.__getitem__, ids))
        good = [True] * len(units)
        if not joined(chain.from_iterable(a), self.a.bytes) == b"".join(raw) == joined(chain.from_iterable(b), self.b.bytes):
            good = [joined(x, self.a.bytes) == r == joined(y, self.b.bytes) for x, y, r in zip(a, b, raw, strict=True)]
            a, b, raw = ([v if ok else v[:0] for v, ok in zip(vs, good, strict=True)] for vs in (a, b, raw))
        n = len(units)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(k.sum())) for x, k in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        cuts = np.intersect1d(ends_a, ends_b)
        label_a, label_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(label_a, minlength=len(cuts)), np.bincount(label_b, minlength=len(cuts))
        start_b = np.cumsum(in_b) - in_b
        unit_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, n))
        # units without bytes end where others do; a group is of the first that ends there, which has bytes
        of_group = np.searchsorted(unit_ends, cuts)
        n_groups = np.bincount(of_group, minlength=n)
        links = np.bincount(of_group, in_a * in_b, n).astype(np.int64)
        # each A token beside each B token of its group
        times = in_b[label_a]
        codes = np.repeat(flat_a, times) * len(self.b.bytes) + flat_b[expand(start_b[label_a], times)]
        whole = len(self.a.bytes) * len(self.b.bytes)
        found, often = np.unique(np.repeat(of_group[label_a], times) * whole + codes, return_counts=True)
        per_unit = np.bincount(found // whole, minlength=n)
        for column, values in ((self.good, np.array(good, np.int8)), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, links), (self.pairs, found % whole), (self.times, often.astype(np.int64)), (self.first, self.first[-1] + np.cumsum(per_unit))):
            column.frombytes(values.tobytes())
        text_a, text_b = [*map(self.text_a.__getitem__, flat_a.tolist())], [*map(self.text_b.__getitem__, flat_b.tolist())]
        to_a, to_b = np.cumsum(in_a).tolist(), np.cumsum(in_b).tolist()
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        ends = np.cumsum(n_groups).tolist()
        self.groups += [";".join(groups[i:j]) for i, j in zip([0, *ends], ends)]

    def reports(self, found: list[np.ndarray | None]) -> list:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of texts, given as the numbers of their units (None: no tokens)."""
        columns = [np.frombuffer(c, np.int64) for c in (self.n_a, self.n_b, self.n_groups, self.n_links)]
        first, pairs, times, good = np.frombuffer(self.first, np.int64), np.frombuffer(self.pairs, np.int64), np.frombuffer(self.times, np.int64), np.frombuffer(self.good, np.int8)
        found = [u if u is not None and good[u].all() else None for u in found]
        digests = ["" if u is None else sha256(";".join(map(self.groups.__getitem__, u.tolist())).encode()).hexdigest() for u in found]
        n = len(found)
        sizes = np.array([0 if u is None else len(u) for u in found], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *(u for u in found if u is not None)])
        doc = np.repeat(np.arange(n), sizes)
        sums = [np.bincount(doc, c[flat], n).astype(np.int64) if c.sum() < 1 << 50 else np.array([0 if u is None else int(c[u].sum()) for u in found]) for c in columns]
        # distinct units of each text, then their pairs
        unit, often = np.unique(doc * len(self.at) + flat, return_counts=True)
        doc, flat = unit // max(1, len(self.at)), unit % max(1, len(self.at))
        per = first[flat + 1] - first[flat]
        at = expand(first[flat], per)
        whole = len(self.a.bytes) * len(self.b.bytes)
        key, place = np.unique(np.repeat(doc, per) * whole + pairs[at], return_inverse=True)
        total = np.bincount(place, times[at] * np.repeat(often, per), len(key)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(key // whole, minlength=n))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (key % whole, total)]
        return [*map(pa.array, sums), pa.array(digests), *lists]


#: Aligners of this worker by their files.
ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    if (a, b) not in ALIGNERS:
        ALIGNERS[a, b] = Aligner(ByteBpe(a), PieceBpe(b))
    return ALIGNERS[a, b]


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def reports(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """One row of REPORT for each row of docs(doc_id, text): pairs are the distinct linked id pairs, times how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a, b)

        def flush(ids: list, held: list) -> pa.RecordBatch:
            found = iter(of.units([t for t in held if t]) if any(held) else [])
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *of.reports([next(found) if t else None for t in held])], [f.split()[0] for f in REPORT.split(", ")])
            if len(of.at) > MAX_UNITS:
                of.clear()
            return out

        for batch in batches:
            ids, held, size = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                if size + len(t or b"") > BATCH_BYTES and ids:
                    yield flush(ids, held)
                    ids, held, size = [], [], 0
                ids.append(i)
                held.append(t.decode() if t else None)
                size += len(t or b"")
            if ids:
                yield flush(ids, held)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, REPORT)


def alignments(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """docs with the array groups of struct(end, a_ids, b_ids): byte end in space + text, ids of either tokenizer; null without tokens."""
    group = T.StructType([T.StructField("end", T.LongType()), T.StructField("a_ids", T.ArrayType(T.IntegerType())), T.StructField("b_ids", T.ArrayType(T.IntegerType()))])

    def make():
        of = aligner(a, b)

        def one(t: bytes | None):
            if not t:
                return None
            [u] = of.units([t.decode()])
            if not all(map(of.good.__getitem__, u)):
                return None
            out, end = [], 0
            for k in u:
                for g in of.groups[k].split(";"):
                    x, y = ([*map(int, ids.split(","))] for ids in g.split("|"))
                    end += int(of.size_a[x].sum())
                    out.append({"end": end, "a_ids": x, "b_ids": y})
            return out

        return lambda batch: [[one(t) for t in texts(batch)]]

    return map_rows(docs, make, [T.StructField("groups", T.ArrayType(group))])


def pair_counts(found: DataFrame) -> DataFrame:
    """pair and n, the documents of found (what reports() gives) that hold it linked: by pair and salt, then by pair."""
    each = found.select(F.explode("pairs").alias("pair"), (F.monotonically_increasing_id() % SALTS).alias("salt"))
    return each.groupBy("pair", "salt").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))


def judged(counts: DataFrame, size_b: int) -> DataFrame:
    """counts with best: whether no pair of the same A id has a higher count."""
    a_id = (F.col("pair") - F.pmod("pair", F.lit(size_b))) / size_b
    return counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(a_id.cast("long"))))


def scored_by_arrays(found: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum by binary search in counts, which every task holds."""
    got = counts.toArrow()
    order = np.argsort(got["pair"].to_numpy())
    sent = found.sparkSession.sparkContext.broadcast(tuple(got[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def make():
        pair, n, best = sent.value

        def run(batch: pa.RecordBatch) -> list:
            lists = batch.column("pairs")
            per = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.searchsorted(pair, lists.flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(len(per)), per)
            sums = [np.zeros(len(per), np.int64) for _ in range(2)]
            np.add.at(sums[0], row, times * best[at])
            np.add.at(sums[1], row, times * n[at])
            return [pa.array(s) for s in sums]

        return run

    return map_rows(found, make, [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])


def scored_by_join(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join of rows; a pair's rows and its count are dealt over SALTS parts."""
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "numbered")
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"), (F.col("row") % SALTS).alias("salt"))
    dealt = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sums = each.join(dealt, ["pair", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return found.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).drop("row")


def token_alignment(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, most: int = MAX_TABLE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each row of docs(doc_id, text)."""
    found = materialize(reports(docs, a, b), "links")
    counts = materialize(judged(pair_counts(found), len(PieceBpe(b).bytes)), "pair-counts")
    scored = scored_by_arrays(found, counts) if counts.count() <= most else scored_by_join(found, counts)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))
