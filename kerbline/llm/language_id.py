"""Language identification by hierarchical discrimination.

Linear support vector machines first choose the language family, one against the rest; within the family, one machine
for each pair of languages votes. Features: square roots of the counts of hashed byte n-grams of the whole lower-cased
text, of unit length. The machines learn in numpy on the driver from a bounded sample of labelled rows: about
PER_LANGUAGE documents of each of the MAX_LANGUAGES most frequent languages, chosen by a hash of the document.

Defined results: a null text, or one without a letter, is `und` with score 0. Without any labelled row all are `und`.
Repeated rows get the same answer. Input columns named lang_pred or score are replaced; keep_identified() returns them as they were.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, map_rows, set_apart, table, texts

#: The bound of the training sample: documents of a language (on average; twice as many at most), and languages.
PER_LANGUAGE, MAX_LANGUAGES = 300, 64
BUCKETS = 4096
DIM = 256 + BUCKETS
#: Bytes whose n-grams are counted at once.
CHUNK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"

# fixed values: families of languages by ISO 639-1 code; another language is a family of its own
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "zh": "sinitic", "ja": "japonic", "ko": "koreanic",
    "hi": "indic", "bn": "indic", "ur": "indic", "fa": "iranian", "ar": "semitic", "he": "semitic", "tr": "turkic", "vi": "austroasiatic",
}

#: A-Z lower-cased, other ASCII that is no letter turned into a space.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    raw = b" " + b" ".join(text.lower().encode().translate(CLEAN).split()) + b" "
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        b = np.frombuffer(raw, np.uint8, count=min(CHUNK + 2, len(raw) - at), offset=at).astype(np.uint32)
        two = b[:-1] | b[1:] << 8
        counts[:256] += np.bincount(b[:CHUNK], minlength=256)
        for gram in (two[:CHUNK], (two[:-1] | b[2:] << 16 | 1 << 24)[:CHUNK]):
            counts[256:] += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    x = np.sqrt(counts).astype(np.float32)
    return x / max(1e-9, np.linalg.norm(x))


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (the last is the bias) that minimise squared hinge loss, by accelerated gradient descent; classes count alike."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * share * y
        grad = penalty * v
        grad[:-1] -= 2 * (slack @ x)
        grad[-1] -= 2 * slack.sum()
        new = v - 0.25 * grad
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """families: name -> weights; pairs: family -> its languages and [(i, j, weights)]."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES):
        self.langs = sorted(set(langs))
        own = np.array([families.get(lang, lang) for lang in langs])
        lang = np.array(langs)
        self.names = sorted(set(own.tolist()))
        self.family = np.array([svm(x, np.where(own == f, 1, -1).astype(np.float32)) for f in self.names]) if len(self.names) > 1 else None
        self.inside = {}
        for f in self.names:
            members = sorted(set(lang[own == f].tolist()))
            pairs = []
            for i, j in combinations(range(len(members)), 2):
                rows = np.isin(lang, (members[i], members[j]))
                pairs.append((i, j, svm(x[rows], np.where(lang[rows] == members[i], 1, -1).astype(np.float32))))
            self.inside[f] = (members, pairs)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        chance = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        f, score = self.names[0], 1.0
        if self.family is not None:
            margins = self.family[:, :-1] @ x + self.family[:, -1]
            f, score = self.names[int(margins.argmax())], float(chance(margins.max()))
        members, pairs = self.inside[f]
        votes = np.zeros(len(members))
        least = np.full(len(members), np.inf)
        for i, j, w in pairs:
            m = float(w[:-1] @ x + w[-1])
            votes[i if m > 0 else j] += 1
            least[i], least[j] = min(least[i], m), min(least[j], -m)
        best = max(range(len(members)), key=lambda i: (votes[i], least[i], -i))
        return members[best], score * (float(chance(least[best])) if pairs else 1.0)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model | None:
    """Learns from labelled (text, lang); None without any row."""
    labelled = labelled.where("text is not null and lang is not null").select("text", "lang", F.pmod(F.xxhash64("text", *[c for c in ("doc_id",) if c in labelled.columns]), F.lit(1 << 30)).alias("h"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    rate = F.lit(0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, per_language / r["count"]) * (1 << 30)))).otherwise(rate)
    sample = labelled.where(F.col("h") < rate).select("text", "lang").limit(2 * per_language * len(counts))

    def make():
        return lambda batch: [[features((t or b"").decode()).tobytes() if t and LETTER.search(t.decode()) else None for t in texts(batch)]]

    rows = map_rows(sample, make, [T.StructField("x", T.BinaryType())], keep=["lang"]).where("x is not null").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Model(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def fn(batch):
            out = []
            for t in texts(batch):
                text = t.decode() if t else ""
                out.append(model.predict(features(text)) if model and LETTER.search(text) else (UNDETERMINED, 0.0))
            return [[x for x, _ in out], [s for _, s in out]]

        return fn

    return map_rows(docs, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 3) == 1


def identified(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score, learnt from those of docs that are not held out."""
    return identify(docs, fit(docs.where(~held_out())), keep)


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without null and letterless texts, which have no language. Without a labelled row no language can be learnt, and the same rows stay."""
    model = fit(docs.where(~held_out()))
    docs, own = set_apart(docs, ["lang_pred", "score", "has_letters"])
    if model is not None:
        return identify(docs, model).where(F.col("lang_pred") != UNDETERMINED).select(*own)

    def make():
        return lambda batch: [[bool(t and LETTER.search(t.decode())) for t in texts(batch)]]

    return map_rows(docs, make, [T.StructField("has_letters", T.BooleanType())]).where("has_letters").select(*own)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
