"""Language model scoring with a gated recurrent network in numpy.

Token counts of all training documents are made in Spark. The most frequent tokens (the head, of bounded size) go to
every task; the others are joined by a shuffle. The network reads and predicts tokens: the output softmax is factored
into classes. The NEURAL most frequent tokens (all, of fewer) lie in as many classes as each has tokens, among which a
second softmax chooses; further classes are bins of the head by rank, with their tokens' relative frequencies; the last class
holds all other tokens, known or not, with add-one frequencies. So every token has a probability and they sum to one.

Texts are read twice, to count and to code; the codes are written to the shared folder. Training: the codes of all
training documents are dealt to tasks; each task runs truncated backpropagation through time from the same start, and Spark
averages the parameters by token counts, ROUNDS times. Documents run side by side in lanes, in windows, in training as in
scoring; the state of a lane is carried from window to window until its document ends, so that the log-likelihood is that
of the whole document.

Defined results: a null text is empty and has the end token only. Without training documents every token is unknown and
all scores are 0. Repeated rows get the same scores. Input columns beyond doc_id and text are not used.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import crc_mod, in_arrow, materialize, table, texts

#: Tokens in every task's dictionary; tokens that the network tells apart.
HEAD, NEURAL = 131_072, 4096
#: Width of the state and of the embeddings.
HIDDEN = 16
#: Tokens of a training task; rounds of averaging.
TASK_TOKENS, ROUNDS = 2_000_000, 1
#: Training: steps of a window, most lanes, and updates that a pass should have (few documents run in fewer lanes).
TRAIN_WINDOW, TRAIN_LANES, UPDATES = 32, 256, 150
#: Scoring: lanes, steps of a window, and tokens that a task holds at once.
LANES, WINDOW, HELD_TOKENS = 512, 32, 4_000_000
#: The token at the end of each document; no word is empty.
END = b""
FLUSH = 400_000

Params = dict[str, np.ndarray]


def tokens_of(text: bytes | None) -> list[bytes]:
    out = text.lower().split() if text else []
    out.append(END)
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all of docs; each task adds up before it sends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])
        for b in batches:
            for t in texts(b):
                counts.update(tokens_of(t))
                if len(counts) > FLUSH:
                    yield pack()
                    counts.clear()
        yield pack()

    return in_arrow(docs.select("text"), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The head by rank, and for each rank what scoring needs; the last entry of each array stands for all other tokens."""

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int):
        self.head = [t for t, _ in head]
        self.total, self.distinct = total, distinct
        counts = np.array([n for _, n in head] + [0], np.float64)
        self.rest_total, self.rest_distinct = total - int(counts.sum()), distinct - len(head)
        self.words = max(1, math.isqrt(min(NEURAL, len(head))))  # of one class
        self.word_classes = min(NEURAL, len(head)) // self.words
        self.neural = self.word_classes * self.words
        rank = np.arange(len(head) + 1)
        bins = np.log2(np.maximum(0, rank - self.neural) / NEURAL + 1).astype(np.int64)
        self.bins = int(bins[:-1].max()) + 1 if len(head) > self.neural else 0
        self.classes = self.word_classes + self.bins + 1
        # what the network sees: a frequent token, a bin of the head, any other token; one more stands for the start
        self.code = np.where(rank < self.neural, rank, self.neural + bins).astype(np.int16)
        self.code[-1] = self.neural + self.bins
        self.codes = self.neural + self.bins + 2
        self.known_base = np.log10(counts + 1)
        self.known_base[-1] = 0
        # of a token in its bin
        self.in_bin = np.zeros(len(head) + 1)
        at = rank[self.neural : -1]
        if len(at):
            sums = np.bincount(bins[at], counts[at])
            self.in_bin[at] = np.log10(counts[at] / sums[bins[at]])

        # logarithms of the classes' shares and of frequent tokens' shares of their class: where training starts
        own = np.append(counts[:-1], self.rest_total + 1)
        shares = np.bincount(self.class_of(self.code.astype(np.int64)), own, self.classes)
        self.class_bias = np.log(shares / shares.sum()).astype(np.float32)
        words = counts[: self.neural].reshape(-1, self.words)
        self.word_bias = np.log(words / words.sum(axis=1, keepdims=True)).astype(np.float32)

    def class_of(self, code: np.ndarray) -> np.ndarray:
        return np.where(code < self.neural, code // self.words, code - self.neural + self.word_classes)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From all counts; the head is as many bins of falling frequency as hold at most head tokens, each seen twice or more."""
    level = F.floor(F.log2("n") * 8).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    least, held = 1 << 30, 0
    for b in bins:
        held += b["tokens"]
        if held > head or b["level"] < 8:  # tokens seen once stay outside: they show the network how often unknown ones come
            break
        least = b["level"]
    rows = sorted(((bytes(r["token"]), r["n"]) for r in counts.where(level >= least).collect()), key=lambda r: (-r[1], r[0]))
    return Vocabulary(rows, sum(b["n"] for b in bins), sum(b["tokens"] for b in bins))


def fresh(v: Vocabulary, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    w = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
    out = {"emb": w(v.codes, h), "wx": w(h, 3 * h, scale=0.25), "b": np.zeros(3 * h, np.float32), "u": w(h, 3 * h, scale=0.25)}
    return out | {"wc": w(h, v.classes), "bc": v.class_bias, "ww": w(v.word_classes, h, v.words), "bw": v.word_bias}


def lanes_of(lengths: list[int], width: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Where each document goes (lane, first step), longest first into the emptiest lane, and the lanes' lengths, falling."""
    width = max(1, min(width, len(lengths)))
    free = [(0, i) for i in range(width)]
    at: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        used, lane = free[0]
        at[d] = (lane, used)
        heapq.heapreplace(free, (used + lengths[d], lane))
    order = sorted(free, key=lambda x: (-x[0], x[1]))
    place = {lane: i for i, (_, lane) in enumerate(order)}
    return [(place[lane], step) for lane, step in at], [used for used, _ in order]


def laid_out(docs: list[np.ndarray], width: int, start: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], list[int]]:
    """Inputs and targets (steps x lanes, -1 where a lane has ended) of documents of codes; the input `start` resets the state."""
    at, used = lanes_of([len(d) for d in docs], width)
    shape = (max(used, default=0), len(used))
    inputs, targets = np.full(shape, start, np.int16), np.full(shape, -1, np.int16)
    for d, (lane, step) in zip(docs, at, strict=True):
        targets[step : step + len(d), lane] = d
        inputs[step + 1 : step + len(d), lane] = d[:-1]
    return inputs, targets, at, used


def recur(u: np.ndarray, x: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: bool = False):
    """States after each step for projected inputs x (steps, lanes, 3 * hidden) from state h; with keep, also what backpropagation needs."""
    n = HIDDEN
    states = np.empty((len(x), *h.shape), x.dtype)
    kept = []
    any_start = starts.any(axis=1)
    for t in range(len(x)):
        if any_start[t]:
            h = h * ~starts[t][:, None]
        a = h @ u
        gates = x[t, :, : 2 * n] + a[:, : 2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, inner = gates[:, :n], gates[:, n:], a[:, 2 * n :]
        new = r * inner
        new += x[t, :, 2 * n :]
        np.tanh(new, out=new)
        if keep:
            kept.append((h, z, r, new, inner))
        h = np.subtract(h, new, out=states[t])
        h *= z
        h += new
    return states, kept


def shares(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of logits, in their place, and the sums of their rows. States lie within -1 and 1, so they do not overflow."""
    logits *= logits.dtype.type(math.log2(math.e))
    np.exp2(logits, out=logits)  # the faster one in numpy
    return logits, logits @ np.ones(logits.shape[1], logits.dtype)


def by_class(v: Vocabulary, kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of targets by class, and (class, first, end) of the frequent tokens' classes in it."""
    order = np.argsort(kind.astype(np.int16), kind="stable")
    ends = np.searchsorted(kind[order], np.arange(v.word_classes + 1))
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]


def score(p: Params, v: Vocabulary, docs: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """The natural log-likelihood that the network gives each document's codes."""
    inputs, targets, at, used = laid_out(docs, lanes, v.codes - 1)
    table = p["emb"] @ p["wx"] + p["b"]
    logp = np.zeros(targets.shape, np.float32)
    h = np.zeros((len(used), HIDDEN), np.float32)
    t = 0
    while t < len(targets):
        active = sum(1 for x in used if x > t)
        # few lanes are left at the end of long documents: as many tokens at once in more steps
        steps = window * max(1, len(used) // active)
        own = inputs[t : t + steps, :active]
        states, _ = recur(p["u"], table[own], own == v.codes - 1, h[:active])
        h = states[-1]
        flat, want = states.reshape(-1, HIDDEN), targets[t : t + steps, :active].reshape(-1)
        logp[t : t + steps, :active] = log_likelihood(p, v, flat, want).reshape(own.shape)
        t += steps
    return np.array([logp[s : s + len(d), lane].sum(dtype=np.float64) for d, (lane, s) in zip(docs, at, strict=True)])


def log_likelihood(p: Params, v: Vocabulary, states: np.ndarray, want: np.ndarray) -> np.ndarray:
    out = np.zeros(len(want), np.float32)
    real = np.flatnonzero(want >= 0)
    kind = v.class_of(want[real].astype(np.int64))
    order, spans = by_class(v, kind)
    real, kind = real[order], kind[order]
    states, want = states[real], want[real].astype(np.int64)
    logits = states @ p["wc"] + p["bc"]
    rows = np.arange(len(want))
    value = logits[rows, kind] - np.log(shares(logits)[1])
    for k, a, b in spans:
        words = states[a:b] @ p["ww"][k] + p["bw"][k]
        value[a:b] += words[rows[: b - a], want[a:b] - k * v.words] - np.log(shares(words)[1])
    out[real] = value
    return out


def scattered(rows: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """n sums of those x whose rows agree."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    out = np.zeros((n, x.shape[1]), x.dtype)
    out[rows[order[first]]] = np.add.reduceat(x[order], first, axis=0)
    return out


def gradients(p: Params, v: Vocabulary, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """Of the mean loss of one window, by backpropagation to its first step; the state after it; the summed loss."""
    n = HIDDEN
    starts = inputs == v.codes - 1
    states, kept = recur(p["u"], (p["emb"] @ p["wx"] + p["b"])[inputs], starts, h, keep=True)
    flat = states.reshape(-1, n)
    real = np.flatnonzero(targets.reshape(-1) >= 0)
    kind = v.class_of(targets.reshape(-1)[real].astype(np.int64))
    order, spans = by_class(v, kind)
    real, kind = real[order], kind[order]
    own, want, rows = flat[real], targets.reshape(-1)[real].astype(np.int64), np.arange(len(real))
    scale = flat.dtype.type(1 / max(1, len(real)))
    d = own @ p["wc"] + p["bc"]
    loss = -float(d[rows, kind].sum(dtype=np.float64))
    d, sums = shares(d)
    loss += float(np.log(sums).sum(dtype=np.float64))
    d *= (scale / sums)[:, None]
    d[rows, kind] -= scale
    g = {"wc": own.T @ d, "bc": d.sum(axis=0), "ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}
    down = d @ p["wc"].T
    for k, a, b in spans:
        d = own[a:b] @ p["ww"][k] + p["bw"][k]
        i = want[a:b] - k * v.words
        loss -= float(d[rows[: b - a], i].sum(dtype=np.float64))
        d, sums = shares(d)
        loss += float(np.log(sums).sum(dtype=np.float64))
        d *= (scale / sums)[:, None]
        d[rows[: b - a], i] -= scale
        g["ww"][k], g["bw"][k] = own[a:b].T @ d, d.sum(axis=0)
        down[a:b] += d @ p["ww"][k].T
    dstates = np.zeros_like(flat)
    dstates[real] = down
    dstates = dstates.reshape(states.shape)
    # what does not depend on later steps, for the whole window at once
    before, z, r, new, inner = (np.stack(x) for x in zip(*kept))
    keeps = 1 - z
    to_new = keeps * (1 - new * new)
    to_z = (before - new) * z * keeps
    to_r = inner * r * (1 - r)
    dx, da = np.empty((*inputs.shape, 3 * n), flat.dtype), np.empty((*inputs.shape, 3 * n), flat.dtype)
    ut, any_start = np.ascontiguousarray(p["u"].T), starts.any(axis=1)
    dh = np.zeros_like(h)
    for t in range(len(inputs) - 1, -1, -1):
        dh += dstates[t]
        x_t, a_t = dx[t], da[t]
        np.multiply(dh, to_z[t], out=x_t[:, :n])
        dnew = np.multiply(dh, to_new[t], out=x_t[:, 2 * n :])
        np.multiply(dnew, to_r[t], out=x_t[:, n : 2 * n])
        a_t[:, : 2 * n] = x_t[:, : 2 * n]
        np.multiply(dnew, r[t], out=a_t[:, 2 * n :])
        dh *= z[t]
        dh += a_t @ ut
        if any_start[t]:
            dh *= ~starts[t][:, None]
    g["u"] = before.reshape(-1, n).T @ da.reshape(-1, 3 * n)
    table = scattered(inputs.reshape(-1), dx.reshape(-1, 3 * n), v.codes)
    g["b"], g["wx"], g["emb"] = table.sum(axis=0), p["emb"].T @ table, table @ p["wx"].T
    return g, states[-1], loss


def train(p: Params, v: Vocabulary, docs: list[np.ndarray], rate: float = 0.02, lanes: int | None = None, window: int = TRAIN_WINDOW) -> tuple[Params, float]:
    """One pass over docs; the parameters after it, and the mean loss on the way."""
    p = {k: x.copy() for k, x in p.items()}
    lanes = lanes or max(16, min(TRAIN_LANES, sum(map(len, docs)) // (window * UPDATES)))
    inputs, targets, _, used = laid_out(docs, lanes, v.codes - 1)
    first, second, lost, seen = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0.0, 0
    h = np.zeros((targets.shape[1], HIDDEN), np.float32)
    for step, t in enumerate(range(0, len(targets), window), 1):
        active = sum(1 for x in used if x > t)
        own = targets[t : t + window, :active]
        g, h, loss = gradients(p, v, inputs[t : t + window, :active], own, h[:active])
        real = int((own >= 0).sum())
        lost, seen = lost + loss, seen + real
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        # a window of few tokens, at the end of long documents, moves the parameters less
        now = rate * min(1.0, real / (lanes * window)) * min(1.0, step / 20) * math.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for k, x in g.items():
            x *= clip
            first[k] += 0.1 * (x - first[k])
            x *= x
            second[k] += 0.01 * (x - second[k])
            np.sqrt(second[k], out=x)
            x += 1e-7
            p[k] -= now * np.divide(first[k], x, out=x)
    return p, lost / max(1, seen)


def packed(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpacked(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def coder(v: Vocabulary):
    """Turns texts into ranks of the head (-1 for other tokens)."""
    get = {t: i for i, t in enumerate(v.head)}.get
    return lambda words: np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))


CODED = "row long, doc_id long, held_out boolean, h long, n_tokens long, known long, base double, in_bins double, rest array<struct<token: binary, n: long>>, codes binary"


def coded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """CODED for docs(row, doc_id, held_out, h, text): sums over tokens of the head, the other tokens with counts, and what the network sees."""
    words = docs.sparkSession.sparkContext.broadcast(v)
    schema = to_arrow_schema(_parse_datatype_string(CODED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, ranks = words.value, coder(words.value)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            others_of, times, ends = [], [], [0]
            for text in texts(b):
                tokens = tokens_of(text)
                r = ranks(tokens)
                others = np.flatnonzero(r < 0)
                rest = Counter(tokens[i] for i in others)
                others_of += rest.keys()
                times += rest.values()
                ends.append(len(times))
                one = (len(r), len(r) - len(others), float(v.known_base[r].sum()), float(v.in_bin[r].sum()), v.code[r].tobytes())
                for column, x in zip(out, one, strict=True):
                    column.append(x)
            kind = schema.field("rest").type.value_type
            counted = pa.StructArray.from_arrays([pa.array(others_of, kind.field(0).type), pa.array(times, kind.field(1).type)], fields=list(kind))
            made = [pa.array(c, schema.field(k).type) for c, k in zip(out, ("n_tokens", "known", "base", "in_bins", "codes"), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counted, type=schema.field("rest").type)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *made[:4], lists, made[4]], schema=schema)

    return in_arrow(docs.select("row", "doc_id", "held_out", "h", "text"), run, CODED)


def codes_of(batches: Iterator[pa.RecordBatch], at: int, most: int) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """The other columns and the codes (column `at`, the last) of rows with about `most` codes together."""
    rows: list[tuple] = []
    codes: list[np.ndarray] = []
    held = 0
    for b in batches:
        rows += zip(*(b.column(i).to_pylist() for i in range(at)), strict=True) if at else [()] * len(b)
        for x in b.column(at):
            codes.append(np.frombuffer(x.as_buffer(), np.int16))
            held += len(codes[-1])
        if held >= most:
            yield rows, codes
            rows, codes, held = [], [], 0
    if codes:
        yield rows, codes


def fit(training: DataFrame, v: Vocabulary, rounds: int = ROUNDS, task_tokens: int = TASK_TOKENS) -> Params:
    """The network after training on all of training(h, n_tokens, codes)."""
    sc = training.sparkSession.sparkContext
    tasks = int((training.agg(F.sum("n_tokens")).first()[0] or 0) // task_tokens) + 1
    dealt = materialize((training.repartition(tasks, "h") if tasks > 1 else training.coalesce(1)).sortWithinPartitions("h", "codes").select("codes"), "dealt")
    p = fresh(v)
    words = sc.broadcast(v)
    for _ in range(rounds):
        sent = sc.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            v, p, seen = words.value, sent.value, 0
            for _, codes in codes_of(batches, 0, task_tokens):
                p, _ = train(p, v, codes)
                seen += sum(map(len, codes))
            if seen:
                flat = packed(p).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], ["at", "x", "n"])

        means = in_arrow(dealt, run, "at long, x double, n double").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("at").collect()
        if means:
            p = unpacked(np.array([r["x"] for r in means]), p)
    return p


def scored(found: DataFrame, v: Vocabulary, p: Params, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """row and neural, the log10 probability of the codes, for found(row, codes)."""
    sc = found.sparkSession.sparkContext
    words, sent = sc.broadcast(v), sc.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes in codes_of(batches, 1, held_tokens):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(score(sent.value, words.value, codes) / math.log(10))], ["row", "neural"])

    return in_arrow(found.select("row", "codes"), run, "row long, neural double")


def scores(docs: DataFrame, held_out: Column, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs(doc_id, text), learnt from those not held out."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"), held_out.alias("held_out"))
    counts = materialize(token_counts(docs.where(~F.col("held_out"))), "counts")
    v = vocabulary(counts, head)
    found = materialize(coded(docs.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("doc_id", "text")}), v), "coded")
    p = fit(found.where(~F.col("held_out")).select("h", "n_tokens", "codes"), v)
    rest = found.select("row", F.explode("rest").alias("r")).select("row", "r.token", F.col("r.n").alias("k"))
    joined = rest.join(counts, "token", "left")
    tail = joined.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("seen"), F.sum("k").alias("others"))
    out = found.drop("rest", "codes").join(scored(found, v, p), "row").join(tail, "row", "left").na.fill(0, ["logs", "seen", "others"])
    base = F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(math.log10(v.total + v.distinct + 1))
    neural = F.col("neural") + F.col("in_bins") + F.col("logs") - F.col("others") * F.lit(math.log10(v.rest_total + v.rest_distinct + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("seen")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), neural.alias("score"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
