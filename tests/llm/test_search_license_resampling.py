"""Block-max search, license scans and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from reconcord.llm import op11_block_max_search as op11
from reconcord.llm import op12_license_scan as op12
from reconcord.llm import op13_importance_resampling as op13
from reconcord.llm import queries, words

TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, term string, rank int"
EDGES = [None, "", " \n\t", "a", "A b", "\n\n", "é Ü 日本語 word", "x" * 50_000, "the same line\n" * 300, "a-b_c\x00d\x7fe 1,000.5", "ab " * 100_000]
ITEM = "item_id long, text string, doc_id string, score int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def documents(spark, texts):
    """Rows with nulls in every column, a repeated row, a repeated id, a null id and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, None, None, "other", "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:4] + [(5, "word again and again", None, None, None, None, None, None), (None, "no id word here", None, None, None, None, None, None)], DOC)


def made(seed, n, most=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["É", "é", "The", "THE"]
    texts = [" ".join(rnd.choices(vocabulary, [1 / (1 + k) for k in range(44)], k=rnd.randint(1, most))) for _ in range(n)]
    return texts + texts[:20]


# 11
def best(rows, items, k):
    """All ranks by plain counts; rows and items are (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        own = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                own.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(own)[:k], 1)]
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block, part, slices", [(64, 1 << 20, 3), (4, 60, 7), (1, 1 << 20, 1)])
def test_search_equals_brute_force(spark, block, part, slices):
    df = documents(spark, made(1, 400) + EDGES)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    items = [(0, "w3 W7 the"), (1, "é word again"), (2, "nothing here zzz"), (3, None), (4, ""), (5, "w0"), (5, "w39 w38 w38"), (None, "ab same"), (-7, "w1 w2 w3 w4 w5 É")]
    asked = spark.createDataFrame([(i, t, None, None) for i, t in items], ITEM)
    got = op11.search(df.repartition(slices), asked, block=block, part=part)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same([tuple(r) for r in got.collect()], best(rows, items, 10))


def test_search_breaks_ties_by_id_across_tasks(spark):
    texts = ["alpha beta"] * 300
    got = op11.search(documents(spark, texts).repartition(5), spark.createDataFrame([(1, "beta", None, None)], ITEM), block=8).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4), (7, 5), (8, 6), (9, 7), (10, 8)]  # row 3 is there twice


def test_search_prunes_without_changing_a_bound(spark):
    """A bound is never under a score of its block."""
    terms_ = [b"a", b"b", b"c"]
    import pyarrow as pa

    texts = ["a a b", "c", "b b b c", "a", "", "a b c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], names=["id", "text"])
    blocks = list(op11._peak_rows(5, 12)(op11._block_rows(terms_, 2)([batch])))
    items = op11.Items([np.array([0, 1]), np.array([2])], np.array([7, 5, 3]))
    for block in blocks:
        bound, forward = items.bounds(block), op11.Forward(block, 0)
        for q, own in enumerate(items.terms):
            assert bound[0, q] >= forward.scores(own, items.weight).max()
    assert sum(len(op11.Forward(b, 0).ids) for b in blocks) == 6


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    asked = spark.createDataFrame([(1, "a b", None, None)], ITEM)
    assert op11.search(none, asked).count() == 0
    assert op11.search(documents(spark, ["a b"]), asked.limit(0)).count() == 0
    assert op11.search(spark.createDataFrame([(1, None, None, None, None, None, None, None)], DOC), asked).count() == 0


# 12
def base_places(text):
    own = terms(text)
    out = []
    for phrase, label in op12.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
    return len(own), out


PARTS = ["cc", "by", "CC BY", "nc", "general", "public", "license", "General Public License", "all rights reserved", "ALL", "rights", "\n", "-", "é", "SPDX-License-Identifier: MIT", "licensed under the", "(", ")", " OR ", "with", "apache"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40), st.sampled_from([" ", "-", ". "]), st.sampled_from([3, 20, 1 << 20]))
def test_license_base_places_equal_brute_force(parts, gap, piece):
    text, was = gap.join(parts), words.PIECE
    words.PIECE = piece  # places must not depend on where a text is split
    try:
        got = op12.scan(text.encode(), tuple(op12.BASE.items()))
    finally:
        words.PIECE = was
    n, places = base_places(text)
    starts = [i for i, _ in places]
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (n, len(starts), min(starts, default=None), max(starts, default=None))
    assert got["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert set(got["base_labels"].split(",")) - {""} <= set(got["labels"].split(","))
    assert 0 <= got["score"] <= 1


@pytest.mark.parametrize("text, strict, labels", [
    ("MIT", 0.1, "mit"),
    ("MIT OR GPL-2.0-only", 0.1, "gpl,mit"),
    ("MIT AND GPL-2.0-only", 0.7, "gpl,mit"),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", 0.42, "gpl"),
    ("MIT OR Apache-2.0 AND AGPL-3.0-only", 0.1, "agpl,apache,mit"),
    ("(MIT OR Apache-2.0) AND AGPL-3.0-only", 0.8, "agpl,apache,mit"),
    ("((BSD-3-Clause))", 0.1, "bsd"),
    ("mit and (cc-by-nc-4.0 or CC-BY-SA-4.0)", 0.5, "cc-by-nc,cc-by-sa,mit"),
    ("LGPL-2.1+ or MIT, see below", 0.1, "lgpl,mit"),
    ("MIT OR", None, ""), ("(MIT", None, ""), ("AND MIT", None, ""), ("", None, ""), ("()", None, ""), ("Foo-1.0", None, ""), (") MIT", None, ""),
])
def test_license_expressions(text, strict, labels):
    got = op12.evaluate(text)
    assert (got is None) == (strict is None)
    if got:
        assert got[0] == pytest.approx(strict) and ",".join(sorted(got[1])) == labels


def test_license_scan_of_a_table(spark):
    texts = [
        "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
        "x\n// SPDX-License-Identifier: (Apache-2.0 OR MIT) AND Own-1.0\ny", 'license = "MIT OR Apache-2.0"', "All Rights Reserved. all rights reserved", "we license nothing: MIT",
    ]
    df = documents(spark, texts + EDGES)
    got = op12.license_scan(df).collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: r for r in sorted(got, key=lambda r: r["labels"])}
    assert [by[i]["labels"] for i in range(7)] == ["cc-by,cc-by-nc", "gpl", "mit", "apache,mit,own-1.0", "apache,mit", "reserved", ""]
    assert [by[i]["base_labels"] for i in range(7)] == ["cc-by", "gpl", "", "", "", "reserved", ""]
    assert [round(by[i]["score"], 2) for i in range(7)] == [0.8, 0.7, 0.1, 0.9, 0.1, 1.0, 0.0]
    assert (by[5]["n_base"], by[5]["first_word"], by[5]["last_word"]) == (2, 0, 3)
    assert by[7]["n_words"] == 0 and by[7]["first_word"] is None and by[None]["labels"] == ""
    assert Counter(r["n_words"] for r in got) == Counter(len(terms(r["text"])) for r in df.collect())
    assert op12.license_scan(df.limit(0)).count() == 0


def test_license_scan_of_long_texts():
    text = ("word " * 400_000 + "cc\nby nc " + "é" * 3_000_000 + " all rights reserved").encode()
    got = op12.scan(text, tuple(op12.BASE.items()))
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["labels"]) == (400_007, 2, 400_000, 400_004, "cc-by,cc-by-nc,reserved")


# 13
def plain_draw(rows, target, buckets=10_000, run=1):
    def features(text):
        own = [t.encode() for t in terms(text)]
        return [zlib.crc32(b" ".join(own[i : i + k])) % buckets for k in range(1, run + 1) for i in range(len(own) - k + 1)]

    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for x in target for f in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms(x))])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(enough[: 10 * len(enough) // 100], 1):
        r[4] = rank
    return out


@pytest.mark.parametrize("run, buckets", [(1, 10_000), (3, 50)])
def test_resampling_equals_brute_force(spark, run, buckets):
    df = documents(spark, made(2, 500, 80) + EDGES).repartition(5)
    target = spark.createDataFrame([(1, "w3 w4 é", None, None), (2, None, None, None), (3, "", None, None), (4, "w30 w31 W30 the", None, None)], ITEM)
    got = op13.resample(df, target, run=run, buckets=buckets).select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()
    want = plain_draw([(r["doc_id"], r["text"]) for r in df.collect()], [r["text"] for r in target.collect()], buckets, run)
    same([tuple(r) for r in got], [tuple(r) for r in want])
    assert sum(r["rank"] is not None for r in got) > 20


def test_resampling_of_runs_does_not_depend_on_pieces(monkeypatch):
    text = ("a bb ccc dddd e " * 40).encode()
    whole, n = op13.run_buckets(text, 3, 1000)
    for piece in (1, 7, 50):
        monkeypatch.setattr(words, "PIECE", piece)
        parts, m = op13.run_buckets(text, 3, 1000)
        assert n == m == 200 and Counter(parts.tolist()) == Counter(whole.tolist()) and len(whole) == 200 + 199 + 198


def test_resampling_of_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], DOC)
    target = spark.createDataFrame([(1, "a b", None, None)], ITEM)
    assert op13.resample(none, target).count() == 0
    assert op13.resample(documents(spark, ["a b c"]), target.limit(0)).where("rank is not null").count() == 0
    many = spark.createDataFrame([(1, "w " * 20, None, None, None, None, None, None)] * 1000, DOC).repartition(6)
    got = op13.resample(many, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 101))  # one id and score for all rows, and still whole ranks
    assert len(got) == 1000


def test_queries_of_the_three(spark):
    sf = "/root/testdata/sf0.001"
    for name, columns in (("op11_block_max_search", ["item_id", "rank", "doc_id", "score"]), ("op12_license_scan", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]), ("op13_importance_resampling", ["doc_id", "n_features", "weight", "score", "rank"])):
        assert queries.QUERIES[name](spark, sf).columns == columns
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    same([tuple(r) for r in queries.op11_block_max_search(spark, sf).collect()], best(docs, items, 10))
    same([tuple(r) for r in queries.op13_importance_resampling(spark, sf).collect()], [tuple(r[:5]) for r in plain_draw(docs, [t for _, t in items])])
    by = {r["doc_id"]: r for r in queries.op12_license_scan(spark, sf).collect()}
    for i, text in docs:
        n, places = base_places(text)
        assert (by[i]["n_words"], by[i]["n_base"]) == (n, len(places))


def test_license_expressions_of_any_length_are_read_whole():
    from reconcord.llm.op12_license_scan import BASE, scan

    text = "SPDX-License-Identifier: (" + " OR ".join(f"LicenseRef-{k}" for k in range(200)) + ") AND GPL-3.0-only"
    assert len(text) > 2000
    got = scan(text.encode(), tuple(BASE.items()))
    assert got["score"] == 0.9 and {"gpl", "licenseref-0", "licenseref-199"} <= set(got["labels"].split(","))
