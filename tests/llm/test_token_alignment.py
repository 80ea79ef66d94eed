"""Token alignment against whole texts encoded at once and aligned token by token."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

from kerbline.llm import token_alignment as ta

ODD = [
    (1, "a\r\nb \r\n  c"), (2, "x▁y z"), (3, " lead"), (4, "\n\n\nx\n\ny \n z\n"), (5, "tab\tq \t r\xa0s 　t  u"), (6, "\x1c a\x1cb\x1f c \x85d ​ e᠎f"),
    (7, "<|endoftext|> <s> </s> <0x41> <unk>"), (8, None), (9, ""), (10, " "), (11, "\n"), (12, "don't we'll 's 'S  'd"), (13, "日本語 テキスト🙂🙂 é ́x"), (14, "   many   spaces   "),
    (15, "\x00 a\x00b"), (16, "a\n b\n\tc\n\n d"), (17, "12 345  6,7\n8"), (17, "12 345  6,7\n8"), (18, "﻿bom ﻿ x y  z"), (19, "a;\r\nb {\r\n}\r\r\n"), (None, "aaaa" * 2000 + " " * 500 + "b"),
    (20, "end. Next, more!? (so) a.b.c ...; ²., Ⅷ: é́, x.>y"),
]


def brute(rows):
    a_model, b_model = ta.ByteBpe(ta.BYTE_BPE), ta.PieceBpe(ta.PIECE_BPE)
    found, docs = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a = a_model.model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.model.encode(text) if text else []
        if not text or b"".join(a_model.bytes[x] for x in a) != whole or b"".join(b_model.bytes[x] for x in b) != whole:
            found.append((doc, 0, 0, [], Counter()))
            continue
        a_ends, b_ends = ([*accumulate(len(of.bytes[x]) for x in ids)] for ids, of in ((a, a_model), (b, b_model)))
        groups, begin, pairs = [], 0, Counter()
        for cut in sorted({*a_ends} & {*b_ends}):
            groups.append(tuple([x for x, e in zip(ids, ends) if begin < e <= cut] for ids, ends in ((a, a_ends), (b, b_ends))))
            pairs.update((x, y) for x in groups[-1][0] for y in groups[-1][1])
            begin = cut
        found.append((doc, len(a), len(b), groups, pairs))
        docs.update(pairs.keys())
    best = Counter()
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    text_of = lambda groups: ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
    return Counter(
        (doc, n_a, n_b, len(groups), sum(pairs.values()), sum(k for p, k in pairs.items() if docs[p] == best[p[0]]), sum(k * docs[p] for p, k in pairs.items()), hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, pairs in found
    )


def rows_of(rng):
    letters = "abcdefgh éß.,;!?'\n\r\t 0129()<>{}日本😀 "
    return ODD + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(400)))) for i in range(60)]


def test_alignment_matches_whole_texts(spark):
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, `n_best` string, `pairs.times` int").repartition(3)
    expected = brute(rows)
    assert Counter(map(tuple, ta.token_alignment(docs).collect())) == expected
    assert Counter(map(tuple, ta.token_alignment(docs, most=0).collect())) == expected


def test_small_batches_and_forgotten_units_change_nothing(monkeypatch):
    rows = [(i, t) for i, t in rows_of(random.Random(4)) if t]
    a, b = ta.ByteBpe(ta.BYTE_BPE), ta.PieceBpe(ta.PIECE_BPE)
    whole = ta.Aligner(a, b)
    expected = [x.to_pylist() for x in whole.reports(whole.units([t for _, t in rows]))]
    monkeypatch.setattr(ta, "BATCH_BYTES", 10)
    monkeypatch.setattr(ta, "STEP", 3)
    each = [ta.Aligner(a, b) for _ in rows]
    single = [[x.to_pylist()[0] for x in of.reports(of.units([t]))] for of, (_, t) in zip(each, rows)]
    assert [list(x) for x in zip(*single)] == expected
    # a vocabulary without safe ends: whole texts are units
    whole.clear()
    whole.pattern = ta.WHOLE
    assert [x.to_pylist() for x in whole.reports(whole.units([t for _, t in rows]))] == expected


def test_alignments_return_the_groups(spark):
    docs = spark.createDataFrame([(1, "two words. more", "a"), (2, None, "b"), (3, "▁", "c")], "doc_id long, text string, `a.b` string")
    got = {r["doc_id"]: r for r in ta.alignments(docs).collect()}
    ends = [g["end"] for g in got[1]["groups"]]
    assert ends == sorted({*ends}) and ends[-1] == len(" two words. more") and got[1]["a.b"] == "a"
    assert got[2]["groups"] is None and got[3]["groups"] is None


def test_empty_table(spark):
    assert ta.token_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_with_dots_pass_through_every_operator_of_rows(spark):
    from kerbline.llm import decontamination, language_id, near_dup, url_filter
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15, "x"), (2, "et d'autres mots", "fr", "s", 16, "y")], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string")
    items = spark.createDataFrame([(1, "no such thing")], "item_id long, text string")
    pages = docs.withColumn("url", F.lit("http://example.net/x"))
    for got in (decontamination.decontaminate(docs, items), language_id.keep_identified(docs), near_dup.keep_one_similar(docs), url_filter.filtered(pages)):
        assert sorted(r["a.b"] for r in got.collect()) == ["x", "y"]
