"""Training-data operators against brute force, and their defined edge cases."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from kerbline.llm import decontamination, gru_lm, html_extraction, language_id, mixing, near_dup, quality_rules, sharding, url_filter, warc
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "r", "x", "ba", "da", "po", "é")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs_of(spark, rows):
    full = [(i, t, *(more or ("en", "a"))[:2], None if t is None else len(t)) for i, t, *more in ((r[0], r[1], *([r[2:]] if len(r) > 2 else [None])) for r in rows) for more in [more[0]]]
    return spark.createDataFrame(full, DOC)


def edge_rows():
    return [(1, None), (2, ""), (3, " \n\t "), (None, prose(30)), (None, prose(30)), (4, prose(5000)), (5, "x"), (6, "Same text here"), (6, "Same text here"), (7, "12 345 !!"), (8, "ünïcödé 😀 " * 20)]


# ---- 1 decontamination


def brute_hits(text, items, window=13):
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    hit, found = set(), set()
    for item, t in items:
        w = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(1)
    items = [(i, prose(rng.choice([1, 3, 8, 13, 14, 30, 60]), rng)) for i in range(25)] + [(90, None), (91, "..."), (3, prose(20, rng))]
    rows = []
    for i in range(60):
        text = prose(rng.choice([0, 5, 40, 120]), rng)
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(w)))
            text += "\n" + " ".join(w[a:]).upper() + ", " + prose(5, rng)
        rows.append((i, text))
    rows += edge_rows()
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((brute_hits(t, items), i is None, i or 0) for i, t in ((r[0], r[1]) for r in rows))
    for block in (decontamination.BLOCK_CHARS, 300):  # the second gives many blocks
        got = decontamination.find_spans(docs, bench, keep=["doc_id"], block_chars=block).collect()
        assert sorted(((r.n_words, r.n_hit, r.hit_items), r.doc_id is None, r.doc_id or 0) for r in got) == want


def test_decontamination_drops_and_cuts(spark):
    rng = random.Random(2)
    item = prose(20, rng)
    long, short = prose(2000, rng), prose(10, rng)
    docs = docs_of(spark, [(1, f"{long}. {item.upper().replace('É', 'é')}! end"), (2, f"{short} {item}"), (3, long), (4, None)]).withColumn("n_words", F.lit("clash"))
    out = {r.doc_id: r for r in decontamination.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert sorted(out) == [1, 3, 4]
    assert out[1].text == f"{long}. end" and out[1].n_chars == len(out[1].text) and out[3].text == long and out[4].text is None and out[3].n_words == "clash"


# ---- 2 quality rules


def brute_quality(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    win, cov = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            cov.update(range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)


def test_quality_statistics_and_rules(spark):
    rng = random.Random(3)
    rows, labels = edge_rows(), []
    rows += [(50, "a b c d e a b c d e a b c d e"), (51, "one two\none two\n\n \none two"), (52, "r " * 40), (53, prose(8, rng) + " " + "u v w x y z " * 2)]
    for i in range(100, 400):
        bad = i % 3 == 0
        text = prose(60, rng)
        rows.append((i, re.sub(" ", "## ", text) if bad else text))
        labels.append((i, 0 if bad else 1))
    docs = docs_of(spark, rows)
    found = quality_rules.judged(docs, spark.createDataFrame([*labels, (None, 0), (5, None)], "doc_id long, quality int")).collect()
    got = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.doc_id or 0) for r in found)
    assert got == sorted((brute_quality(r[1]), r[0] or 0) for r in rows)
    kept = {r.doc_id: r.kept for r in found}
    assert all(kept[i] == (q == 1) for i, q in labels) and not kept[1] and not kept[52]


def test_quality_without_labels_and_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules.judged(docs_of(spark, edge_rows()), empty).collect())
    assert quality_rules.judged(docs_of(spark, []), empty).count() == 0


# ---- 3 HTML


def test_html_main_text_and_templates(spark):
    page = lambda i, body: f"<html><head><title>t</title></head><body><div class='x'>Buy our things</div><div>{body}</div></body></html>"
    pages = [(i, f"http://h.example/{i}", page(i, f"<p>Story &eacute; number {i}<p>line\n {i}")) for i in range(40)]
    pages += [(90, None, None), (91, "", ""), (92, "http://h.example/a", "<article><h1>A &amp; B</h1><nav>menu</nav><p>Buy our things</p><div class='comments'>no</div></article><footer>f</footer>")]
    out = {r.page_id: r for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    assert out[3].text == "Story é number 3\n\nline 3" and out[3].n_chars == len(out[3].text)
    assert out[90].text == "" and out[91].text == "" and out[92].text == "A & B\n\nBuy our things"
    joined = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), max_broadcast=0).collect()}
    assert joined == {k: r.text for k, r in out.items()}


def test_html_boxes_inside_articles_and_small_hosts(spark):
    inner = lambda i: f"<article><h1>Title {i}</h1><p>Story {i}</p><p>A quoted line</p><div class='zq'><ul><li>Read our guide</li></ul></div></article>"
    pages = [(i, f"http://big.example/{i}", inner(i)) for i in range(40)] + [(100 + i, f"http://small.example/{i}", inner(i)) for i in range(4)]
    # no article, and few of very many pages of a host
    pages += [(200 + i, f"http://bare.example/{i}", f"<div>Our shop</div><div><p>Own {i}</p></div>") for i in range(4)] + [(300, "http://one.example/", inner(0))]
    pages += [(1000 + i, "http://huge.example/", f"<div><p>Own {i}</p></div>" + "<div>Summer box</div>" * (i < 120)) for i in range(3000)]
    out = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    assert out[7] == "Title 7\n\nStory 7\n\nA quoted line" and out[102] == "Title 2\n\nStory 2\n\nA quoted line"
    assert out[201] == "Own 1" and out[1003] == "Own 3"
    assert out[300].endswith("Read our guide")


def test_html_survives_broken_markup():
    for text in ("<", "<p", "</p></p>", "<a href='x", "<script>x", "<!-- x", "a<b>c</i>d", "<table><tr><td>1<td>2</table>x", "<div>" * 3000 + "deep"):
        assert isinstance(html_extraction.main_text(text), str)
    assert html_extraction.main_text("<table><tr><td>1<td>2</table>x") == "1\n\n2\n\nx"


# ---- 4 mixing


def test_mixing_totals_and_reruns(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng.choice([1, 10, 50, 200]), rng), ("en", rng.choice("aabc"))) for i in range(3000)]
    rows = [(i, t, lang, s) for i, t, (lang, s) in rows] + [(None, None, None, None), (None, "", None, None), (7, "same", "en", "z"), (7, "same", "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs.withColumn("size", F.lit("clash")))
    taken, n = Counter(), Counter()
    per_doc = Counter()
    for r in mixed.collect():
        taken[r.source] += r["size"]
        per_doc[r.doc_id, r.source] += 1
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
        n[s] += 1
    total, weights = sum(size.values()), {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}
    capped = {s for s in size if size[s] <= 2}
    for s in size:
        if s not in capped:
            left = total - 3 * sum(size[c] for c in capped)
            assert abs(taken[s] - left * weights[s] / sum(w for k, w in weights.items() if k not in capped)) <= 200
        else:
            assert taken[s] == 3 * size[s]
    key = lambda df: sorted((str(r.doc_id), str(r.source), r["size"], r.copies) for r in df.collect())
    ids = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    assert key(mixing.choices(ids)) == key(mixing.choices(ids.repartition(7)))
    assert max(r.copies for r in mixing.choices(ids).collect()) <= 3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_settles_heavy_units_first(spark):
    rng = random.Random(12)
    rows = [(i, s, n) for s, k in (("a", 400), ("b", 60), ("c", 900)) for i, n in enumerate([20_000] + [rng.randrange(1, 200) for _ in range(k)])]
    out = mixing.choices(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    total, open_, weights = sum(size.values()), dict(size), {"a": 1, "b": 2, "c": 3}
    want, left = {}, total
    while full := [s for s in open_ if weights[s] * left / sum(weights[x] for x in open_) > 3 * size[s]]:
        for s in full:
            want[s] = 3 * open_.pop(s)
        left = total - sum(want.values())
    want |= {s: weights[s] * left / sum(weights[x] for x in open_) for s in open_}
    assert target == pytest.approx(want) and all(abs(taken[s] - want[s]) < 0.01 * want[s] for s in want)


# ---- 5 sharding


def test_sharding_moves_few_and_slots_have_no_gap(spark):
    rows = [(i, prose(3)) for i in range(4000)] + edge_rows()
    out = sharding.manifest(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sorted(by) == list(range(24))
    assert 80 < sum(r.grown_shard == 24 for r in out) < 240
    want = sorted((len((t or "").encode()) + 8, __import__("zlib").crc32((t or "").encode())) for _, t in ((r[0], r[1]) for r in rows))
    assert sorted((r.size, r.text_crc32) for r in out) == want
    weighted = Counter(r.shard for r in sharding.assign_shards(spark.range(6000), ["id"], (1.0, 3.0)).collect())
    assert 0.22 < weighted[0] / 6000 < 0.28
    assert sharding.manifest(docs_of(spark, [])).count() == 0


def test_sharding_writes_no_files_of_its_own(spark, tmp_path):
    rows = [(i // 2 if i % 5 else None, prose(i % 7)) for i in range(300)] + edge_rows()
    docs_of(spark, rows).write.parquet(f"{tmp_path}/docs")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.rglob("*"))
    out = sharding.manifest(spark.read.parquet(f"{tmp_path}/docs"))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out.collect()) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert set(shared.rglob("*")) == before


# ---- 6 WARC


def test_warc_round_trip(spark, tmp_path):
    big = "payload é " * 40
    pages = [(5, "http://a/ b", big), (2, None, big), (9, "u", big), (2, "u", big), (7, "u", "tiny"), (8, "u", "tiny"), (3, "u", None), (None, "u", big), (11, "u", "WARC/1.1\r\nhttp://x 0 0 0 5\n" * 9)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for version in (1, 2):
        # two captures of one page have identifiers of their own
        arc, out = f"{tmp_path}/arc{version}", f"{tmp_path}/warc{version}"
        warc.write_arc(frame, arc, version)
        warc.convert(spark, arc, out)
        got = warc.read_warc(spark, out).collect()
        assert len(got) == len(pages) == len({r.record_id for r in got})
        for r in got:
            assert r.payload_digest in {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in pages}
        kinds = {(r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == len(big.encode())}
        assert kinds == {(5, "revisit", 2), (2, "response", None), (9, "revisit", 2), (None, "revisit", 2)}
        assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
        assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {big, "tiny", "", pages[-1][2]}
    warc.write_arc(frame.limit(0), f"{tmp_path}/none")
    assert warc.read_arc(spark, f"{tmp_path}/none").count() == 0


def test_damaged_archives_give_rejected_rows(spark, tmp_path):
    import gzip

    body = "same payload " * 20
    one = lambda url, text=body, date=b"20010203040506", kind=b"text/html": b"%s 1.2.3.4 %s %s %d\n%s\n" % (url, date, kind, len(text), text.encode())
    parts = [
        warc.arc_filedesc(1, "x"), b"\n", one(b"http://a/with blank"), one("http://a/\xe4".encode("latin-1")), one(b"http://a/b", date=b"200102030405", kind=b"text/html; charset=x"),
        b"http://a/c 1.2.3.4 20010203040506 text/html many\nlines of\na lost record\n", one(b"http://a/d", "HTTP/1.1 200 OK\r\nX-Page-Id: odd\r\n\r\nown"), one(b"http://a/e", "short")[:-4],
    ]
    arc = tmp_path / "arc"
    arc.mkdir()
    (arc / "x.arc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (arc / "y.arc.gz").write_bytes(gzip.compress(warc.arc_filedesc(1, "y") + b"\n" + one(b"http://a/with blank")))
    got = {(r.file, r.offset): r for r in warc.read_arc(spark, str(arc)).collect()}
    assert sorted(r.url for r in got.values()) == ["http://a/%E4", "http://a/b", "http://a/d", "http://a/with%20blank", "http://a/with%20blank"]
    assert {r.url: r.date for r in got.values()}["http://a/b"] == "20010203040500" and all(r.page_id is None for r in got.values())
    assert sorted(r.reason for r in warc.read_rejected(spark, str(arc)).collect()) == ["no header line", "shorter than declared"]
    warc.convert(spark, str(arc), str(tmp_path / "warc"))
    out = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert Counter(r.record_type for r in out) == {"response": 2, "revisit": 3} and len({r.record_id for r in out}) == 5
    assert {r.date for r in out} == {"2001-02-03T04:05:06Z", "2001-02-03T04:05:00Z"}


# ---- 7 URL filter


def test_url_filter(spark):
    rows = [(1, "http://a.example.org/en/12?x"), (2, "https://EXAMPLE.org/es/"), (3, "http://x.com/fr/1"), (4, "http://x.com/de/1"), (5, "http://spam-farm.example.net/q"), (6, None), (7, "no scheme"), (8, "http://org/zz"), (9, "http://notexample.org/en/1"), (10, "http://spam-farm.example.net")]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out[1] == ("a.example.org", "/en/12", "example.org/en/1", "block") and out[2] == ("example.org", "/es/", "example.org/es/", "block")
    assert out[3][2:] == ("com/fr/", "allow") and out[4][2:] == ("com/de/", "block") and out[5][2:] == (None, "block") and out[6] == ("", "", None, "allow") and out[7] == ("", "", None, "allow")
    assert out[8][2:] == ("org/", "allow") and out[9][2:] == ("org/", "allow") and out[10][2:] == (None, "allow")


def test_digest_array_confirms_strings(tmp_path):
    entries = [(f"h{i}.example/p{i % 7}", i % 3) for i in range(500)]
    url_filter.DigestArray.write(str(tmp_path / "d"), entries)
    a = url_filter.DigestArray(str(tmp_path / "d"))
    assert a.probe([e.encode() for e, _ in entries] + [b"h1.example/p9"]) == [(i, t) for i, (_, t) in enumerate(entries)]
    a.keys = np.sort(np.full(500, xxh64_intdigest(b"other/"), np.uint64))  # as if all keys collided
    assert a.probe([b"other/"]) == []
    url_filter.DigestArray.write(str(tmp_path / "e"), [])
    assert url_filter.DigestArray(str(tmp_path / "e")).probe([b"a/"]) == []


# ---- 8 language


def test_language_held_out_accuracy(spark):
    words = {"en": "the and of to with this that from", "de": "der die und nicht mit sich auf ein", "fr": "le la les des une que pour dans", "es": "el los las una que por con para"}
    rng, rows = random.Random(6), []
    for i in range(400):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang].split()) for _ in range(40)), lang, "s"))
    rows += [(900, None, "en", "s"), (901, "123 !", "en", "s"), (902, "the and of", None, None), (None, "der die und", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in language_id.identified(docs).collect()}
    assert sum(out[i].lang_pred == lang for i, _, lang, _ in rows[:400]) >= 392
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[901].score == 0 and all(0 <= r.score <= 1 for r in out.values())
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 402 and kept.where("score = 'clash'").count() == 402
    assert {r.lang_pred for r in language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identified(docs.limit(0)).count() == 0


def test_without_labels_only_letterless_texts_go(spark):
    rows = [(1, "a plain text", None), (2, None, None), (3, "12 34", None), (4, "ünï", None)]
    docs = spark.createDataFrame([(i, t, lang, "a", 1) for i, t, lang in rows], DOC)
    assert sorted(r.doc_id for r in language_id.keep_identified(docs).collect()) == [1, 4]


# ---- 9 language model


def brute_forward(p, v, codes):
    h, total = np.zeros(gru_lm.HIDDEN), 0.0
    for prev, c in zip([v.codes - 1, *codes[:-1]], codes, strict=True):
        x, a, n = p["emb"][prev] @ p["wx"] + p["b"], h @ p["u"], gru_lm.HIDDEN
        z, r = 1 / (1 + np.exp(-(x[:n] + a[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + a[n : 2 * n])))
        new = np.tanh(x[2 * n :] + r * a[2 * n :])
        h = (1 - z) * new + z * h
        logits = h @ p["wc"] + p["bc"]
        k = int(v.class_of(np.array([c]))[0])
        total += logits[k] - np.log(np.exp(logits).sum())
        if k < v.word_classes:
            w = h @ p["ww"][k] + p["bw"][k]
            total += w[c - k * v.words] - np.log(np.exp(w).sum())
    return total


def small_vocabulary():
    head = sorted(((f"w{i}".encode(), 400 - i) for i in range(100)), key=lambda r: (-r[1], r[0]))
    return gru_lm.Vocabulary(head, sum(n for _, n in head) + 50, 140)


def test_lm_scores_whole_documents_in_lanes_and_gradients():
    v, rng = small_vocabulary(), np.random.default_rng(1)
    p = gru_lm.fresh(v)
    docs = [rng.integers(0, v.codes - 1, n).astype(np.int16) for n in (1, 3, 200, 17, 90, 5)]
    want = [brute_forward(p, v, d) for d in docs]
    for lanes, window in ((2, 8), (64, 64), (1, 3)):
        assert np.allclose(gru_lm.score(p, v, docs, lanes, window), want, rtol=1e-4)
    inputs, targets, _, used = gru_lm.laid_out(docs, 4, v.codes - 1)
    h = np.zeros((len(used), gru_lm.HIDDEN))
    q = {k: x.astype(np.float64) for k, x in p.items()}
    g, _, _ = gru_lm.gradients(q, v, inputs[:20], targets[:20], h)
    n = (targets[:20] >= 0).sum()
    for k, at in (("u", (1, 2)), ("wx", (3, 30)), ("wc", (2, 1)), ("ww", (0, 1, 2)), ("b", (40,)), ("bw", (1, 3))):
        ends = []
        for e in (1e-3, -1e-3):
            q[k][at] += e
            ends.append(gru_lm.gradients(q, v, inputs[:20], targets[:20], h)[2])
            q[k][at] -= e
        assert g[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-3 / n, rel=0.05, abs=2e-4)
    _, first = gru_lm.train(p, v, docs[2:3] * 40)
    trained, _ = gru_lm.train(p, v, docs[2:3] * 40, lanes=4)
    assert gru_lm.score(trained, v, docs[2:3])[0] > want[2] and first > 0


def test_the_end_of_a_long_document_is_scored_in_few_windows(monkeypatch):
    head = [(b"w%d" % i, 100 - i) for i in range(60)]
    v = gru_lm.Vocabulary(head, sum(n for _, n in head) + 50, 140)
    rng, p, real, calls = np.random.default_rng(4), gru_lm.fresh(v), gru_lm.log_likelihood, []
    docs = [rng.integers(0, v.codes - 1, n).astype(np.int16) for n in (3000, *[20] * 63)]
    alone = [gru_lm.score(p, v, [d], 1, 32)[0] for d in docs]
    monkeypatch.setattr(gru_lm, "log_likelihood", lambda *a: calls.append(len(a[3])) or real(*a))
    assert np.allclose(gru_lm.score(p, v, docs, 64, 32), alone, rtol=1e-5)
    assert len(calls) < 10 and max(calls) <= 64 * 32


def test_lm_probabilities_sum_to_one():
    v = small_vocabulary()
    p, states = gru_lm.fresh(v), np.random.default_rng(2).standard_normal((1, gru_lm.HIDDEN)).astype(np.float32)
    each = [float(gru_lm.log_likelihood(p, v, states, np.array([c]))[0]) for c in range(v.codes - 1)]
    assert sum(map(math.exp, each)) == pytest.approx(1, abs=1e-4)
    for k in range(v.neural, v.codes - 2):
        assert sum(10 ** v.in_bin[r] for r in range(100) if v.code[r] == k) == pytest.approx(1)


def test_lm_base_score_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng.choice([0, 5, 60]), rng) + rng.choice(["", " rare%d" % i, " Rare%d" % (i // 2)])) for i in range(120)] + edge_rows()
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 2
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w] + [""]
    counts = Counter(w for r in rows if (r[0] or 0) % 5 != 2 for w in tokens(r[1]))
    total = sum(counts.values())
    out = gru_lm.scores(docs_of(spark, rows), held, head=20).collect()
    want = sorted((r[0] or 0, len(tokens(r[1])), sum(w in counts for w in tokens(r[1])), round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens(r[1])), 6)) for r in rows)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == total and r.score < 0 for r in out)
    none = gru_lm.scores(docs_of(spark, rows[:5]), F.lit(True)).collect()
    assert all(r.base_score == 0 and abs(r.score) < 1e-3 and r.n_known == 0 for r in none) and len(none) == 5
    assert gru_lm.scores(docs_of(spark, []), held).count() == 0


def test_lm_trains_on_every_document(spark, monkeypatch):
    dealt, write = [], gru_lm.materialize
    monkeypatch.setattr(gru_lm, "materialize", lambda df, label: (dealt.extend(bytes(r.codes) for r in df.collect()) if label == "dealt" else None) or write(df, label))
    docs = docs_of(spark, [(i, prose(20)) for i in range(30)]).select(F.col("doc_id").alias("row"), "doc_id", F.lit(False).alias("held_out"), F.xxhash64("text").alias("h"), "text")
    v = gru_lm.vocabulary(gru_lm.token_counts(docs))
    found = gru_lm.coded(docs, v)
    gru_lm.fit(found.select("h", "n_tokens", "codes"), v, rounds=1, task_tokens=100)
    assert sorted(dealt) == sorted(bytes(r.codes) for r in found.collect()) and len(dealt) == 30


# ---- 10 near duplicates


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    rows = edge_rows()
    base = prose(300, rng).split()
    for i in range(100, 160):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((i, " ".join(w)))
    rows += [(i, prose(40, rng)) for i in range(200, 240)]
    prints = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), r[0]), r[0])
    want = sorted((str(r[0]), f"{prints[i]:016x}", str(smallest.get(find(i)))) for i, r in enumerate(rows))
    docs = docs_of(spark, rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_dup.near_duplicates(docs).collect()) == want
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(rows))})
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    # the shuffle's hash is that of the fingerprint's definition
    assert spark.sql("select xxhash64('ä b c') x").first().x & (1 << 64) - 1 == xxh64_intdigest("ä b c".encode(), 42)


def test_pipeline_near_copies_match_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(13)
    lines = prose(40, rng)  # held by many texts
    rows = edge_rows() + [(300 + i, lines + " " + prose(30 + i, rng)) for i in range(40)] + [(400, "Same  TEXT here"), (401, "same text"), (402, "SAME TEXT")]
    for i in range(60):
        if i % 15 == 0:
            base = prose(120, rng).split()
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((500 + i, " ".join(w)))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    close = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                close += sets[i] != sets[j]
                root[find(i)] = find(j)
    assert close > 20
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), (True, 0)), (d is None, d or 0))
    docs = docs_of(spark, rows)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted((None if no else d for no, d in first.values()), key=str)


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(101, 100)], "a long, b long")
    assert {(r.node, r.root) for r in near_dup.components(pairs).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = prose(25, rng)
    rows = [(i, prose(60, rng), "en" if i % 2 else "de", "ab"[i % 2], 1) for i in range(60)]
    rows += [(100, rows[0][1], "de", "a", 1), (101, item + " tail", "en", "a", 1), (102, "12 34", None, None, 1), (None, prose(50, rng), None, None, None)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {100, 101, 102} and all(0 <= r.shard < 24 for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
