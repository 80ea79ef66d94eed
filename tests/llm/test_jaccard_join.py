"""The Jaccard join against all pairs compared."""

import random
from collections import Counter

import pytest

from kerbline.llm import jaccard_join as jj
from kerbline.llm import near_dup


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, up=17, down=20):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and n * down >= up * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows))


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Chains of edits, copies around a centre that link only with it, families near one another's threshold, shared passages and edge cases."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    rows = []
    for _ in range(6):
        chain = [word() for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(8):
            rows.append(chain)
            chain = edited(chain, rng.choice([1, 1, 2, len(chain) // 40 + 1]), rng)
    for _ in range(3):
        centre = [word() for _ in range(150)]
        rows += [centre, *(edited(centre, rng.choice([1, 2, 3]), rng) for _ in range(12))]
        # a second family whose members may reach the first one's
        other = edited(centre, rng.choice([4, 5, 6]), rng)
        rows += [other, *(edited(other, rng.choice([1, 2]), rng) for _ in range(8))]
    passage = [word() for _ in range(40)]
    rows += [[word() for _ in range(rng.randrange(15))] + passage + [word() for _ in range(rng.randrange(15))] for _ in range(25)]
    rows += [[word() for _ in range(rng.randrange(1, 7))] for _ in range(20)] + [["a", "b"], ["A", "b"], ["a", "b", "a", "b", "a", "b", "a"]]
    out = [(i, " ".join(r)) for i, r in enumerate(rows)]
    rng.shuffle(out)
    return out + [(900, None), (901, ""), (902, " \n\t"), (None, out[0][1]), (None, None), (None, "alone here"), *out[:3], (-5, out[5][1].upper())]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, size int, `set.s` string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(docs).collect())
    assert got == brute(rows)


def test_without_leaders_the_lists_alone_find_every_link(spark, monkeypatch):
    rows = corpus(4)
    empty = lambda schema: spark.createDataFrame([], schema)
    nothing = lambda *_: (empty("a long, b long"), empty("set long, leader long, size long, lacks array<long>, adds array<long>"), empty("leader long, size long, out array<long>, more array<long>"))
    monkeypatch.setattr(jj, "families", nothing)
    assert Counter(map(tuple, jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_families_without_their_centre_link_all_that_link(spark, monkeypatch):
    """Copies of a text that is not there itself, with few edits or many, and only the least central sets compared first."""
    rng = random.Random(11)
    centre = [f"{rng.choice('abcdefgh')}{rng.randrange(200)}" for _ in range(160)]
    rows = [(i, " ".join(edited(centre, 1 + i % 7, rng))) for i in range(90)]
    rows += [(100 + i, " ".join(edited(rows[i][1].split(), 1, rng))) for i in range(20)]
    monkeypatch.setattr(jj, "CENTRAL", 1)
    assert Counter(map(tuple, jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_short_lists_give_their_pairs_without_blocks(spark, monkeypatch):
    """Texts that share a passage, too few for a long list, and three that link."""
    rng, written, real = random.Random(5), {}, jj.materialize
    passage = [f"p{i}" for i in range(60)]
    own = [[f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    rows = [(i, " ".join(w + passage)) for i, w in enumerate(own)] + [(10 + i, " ".join(edited(own[0] + passage, 2, rng))) for i in range(2)]
    monkeypatch.setattr(jj, "materialize", lambda df, label: written.setdefault(label, []).append(real(df, label)) or written[label][-1])
    assert Counter(map(tuple, jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)
    assert written["blocks"][0].count() == 0 < written["pairs"][0].count() + written["lists"][0].count()


@pytest.mark.parametrize("short, hot", [(2, 1), (3, 4), (30, 10**6)])
def test_short_long_and_hot_lists_find_every_link(spark, monkeypatch, short, hot):
    monkeypatch.setattr(jj, "SHORT", short)
    monkeypatch.setattr(jj, "HOT_TEXTS", hot)
    monkeypatch.setattr(near_dup, "ORDER_SAMPLE", 1)
    rows = corpus(6)
    assert Counter(map(tuple, jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_skipped_blocks_hold_no_link():
    rule = jj.Rule(17, 20)
    width = 3 / 20 / jj.BINS
    for n in (20, 57, 200):
        for m in range(-(-n * 17 // 20), n + 1):
            need = -(-(n + m) * 17 // 37)
            for i in range(rule.prefix(n)):
                for j in range(rule.prefix(m)):
                    if min(n - i, m - j) >= need:
                        bins = [min(int(p / s / width + 1e-9), jj.BINS - 1) for p, s in ((i, n), (j, m))]
                        assert bins[1] in rule.meeting(bins[0]) and bins[0] in rule.meeting(bins[1])


def test_empty_table(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
