"""N-gram join, lattice dedup, URL models, shared helpers and the pipeline against brute force."""

import itertools
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F
from reconcord.llm import common
from reconcord.llm import op1_entropy_mixing as op1
from reconcord.llm import op6_ngram_jaccard as op6
from reconcord.llm import op7_lattice_dedup as op7
from reconcord.llm import op8_url_markov as op8
from reconcord.llm.common import Stage, components
from reconcord.llm.shingles import buffers, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowest(n, edges, ids):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [None if ids[i] is None else low[find(i)] for i in range(n)]


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_copies(seed):
    """Copies, near copies at all distances, passages that many share, short and blank texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(2)]
    texts = [None, "", "  \n", "one two", "ONE  two", "one two three four five", "One two three four five", "one two three four five six"]
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(20, 120))]
        for k in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(k):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [passages[i % 2] + " " + " ".join(word() for _ in range(rnd.randint(0, 30))) for i in range(70)]
    texts += [texts[20]] * 5
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("frequent", [2, 48])
def test_ngram_components_equal_brute_force(spark, frequent):
    texts = near_copies(frequent)
    ids = [None if i == 3 else 1000 - i for i in range(len(texts))]
    sets = [shingles(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and None not in (ids[i], ids[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert len(edges) > 50
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, n long, id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op6.ngram_jaccard(df.repartition(5), frequent=frequent).collect()}
    want = lowest(len(texts), edges, ids)
    assert got == {i: (len(s), c) for i, s, c in zip(ids, sets, want)}
    kept = op6.drop_near_copies(df, frequent=frequent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(i or 0 for i, c in zip(ids, want) if i is None or i == c)


@pytest.mark.parametrize("paired", [2, 32])
def test_ngram_lists_of_many_components(spark, monkeypatch, paired):
    """Texts put together from the same few passages: every list is frequent and most of its sets stay apart."""
    rnd = random.Random(paired)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    passages = [" ".join(word() for _ in range(12)) for _ in range(14)]
    texts = [" ".join(rnd.sample(passages, rnd.randint(2, 9))) for _ in range(90)]
    texts += [t + " " + word() for t in texts[:12]] + [t.rsplit(" ", 1)[0] for t in texts[12:20]]
    sets = [shingles(t) for t in texts]
    ids = list(range(len(texts)))
    edges = [(i, j) for i in ids for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert 15 < len(edges) < 400
    monkeypatch.setattr(op6, "PAIRED", paired)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in op6.ngram_jaccard(df, frequent=3).collect()}
    assert got == dict(zip(ids, lowest(len(texts), edges, ids)))


def test_component_blocks_lose_no_pair_in_reach():
    """A pair of sets that could link passes the sketch's bound, whatever their sizes."""
    rng = np.random.default_rng(3)
    made, c = [], 0
    for n in (5, 60, 700, 5000):
        base = rng.integers(-(2**62), 2**62, n)
        for k in (0, 1, n // 20, n // 9, n // 7):
            made.append((c, np.unique(np.concatenate([base[k:], rng.integers(-(2**62), 2**62, k)]))))
            c += 1
    one = pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in made]), pa.array([0] * len(made)), pa.array([len(s) for _, s in made]), pa.array([s for _, s in made], pa.list_(pa.int64()))], names=["c", "more", "low", "hashes"]
    )
    sketch = next(op6._sketches(iter([one]))).to_pylist()
    parts = [r | {"lo": r["size"], "hi": r["size"], "room": r["size"], "short": True} for r in sketch]
    block = pa.array([parts])
    batch = pa.RecordBatch.from_arrays([block, block, pa.array([True])], names=["outer", "inner", "same"])
    got = {(r["a"], r["b"]) for r in next(op6._near_components(75)(iter([batch]))).to_pylist()}
    link = {(a, b) for a, s in made for b, t in made if a < b and 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))}
    assert link and link <= got
    assert len(got) < len(made) * (len(made) - 1) / 4


def test_ngram_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in op6.ngram_jaccard(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert sorted(r["doc_id"] for r in op6.drop_near_copies(df).collect()) == [1, 3]
    assert op6.ngram_jaccard(df.where("false")).count() == 0


def test_window_bounds():
    for n in range(1, 3000):
        least = -(-75 * n // 100)
        window = lambda k: op6.window_length(k, 75)
        for m in {least, n, -(-n * 100 // 75) - 1}:
            if 100 * min(m, n) < 75 * max(m, n) or m < 1:
                continue
            overlap = -(-75 * (n + m) // 175)
            # in common within both windows at least
            common = min(window(n) - (n - overlap), window(m) - (m - overlap), overlap)
            assert common > op6._spare(n, 75) or common >= overlap > op6._spare(n, 75)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 3
    points, far = op7.decode(x)
    assert ((points.sum(-1) % 4) == 0).all() and (far[:, 0] <= 1 + 1e-9).all()  # within the covering radius
    halves = (points % 2).sum(-1)
    assert np.isin(halves, (0, 8)).all() and (far[:, 0] <= far[:, 1]).all()


def vectors(seed, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for size in [1] * 60 + [2, 3, 5, 40]:
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(size):
            noise = rng.normal(size=dim)
            noise -= noise @ base * base
            cos = rng.uniform(0.975, 1)
            out.append((base * cos + noise / np.linalg.norm(noise) * np.sqrt(1 - cos**2)) * rng.uniform(0.5, 2))
    out += [out[-1]] * 3 + [out[0] * 2]
    return [v.astype(np.float32).tolist() for v in out]


@pytest.mark.parametrize("block", [8, 512])
def test_lattice_links(spark, block):
    good = vectors(block)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v, 5) for i, v in enumerate(good + odd)] + [(None, good[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: r for r in op7.lattice_dedup(df.repartition(3), block=block).collect()}
    x = np.array(good + [good[0]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    ids = [*range(len(good)), None]
    found = sum(got[i]["n_links"] for i in ids)
    assert all(got[i]["n_links"] <= hit[k].sum() for k, i in enumerate(ids))
    assert found >= 0.98 * hit.sum()
    if found == hit.sum():
        assert [got[i]["component_id"] for i in ids] == lowest(len(ids), np.argwhere(hit), ids)
    k = len(good)
    assert all(got[k + i]["n_links"] == 0 and got[k + i]["kept"] for i in range(6))
    assert got[k + 6]["n_links"] == 1 and got[k + 7]["component_id"] == k + 6 and not got[None]["kept"]
    assert op7.lattice_dedup(df.where("false")).count() == 0


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = rng.normal(size=a.shape)
    e -= (e * a).sum(1, keepdims=True) * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    s = (op7.TABLES, op7.BLOCKS, op7.CELL, op7.PROBES)
    ka, kb = op7.cells(a, *s), op7.cells(b, *s)
    assert (ka[:, :, :, None] == kb[:, :, None, :]).any((1, 2, 3)).mean() >= 0.9


URLS = [None, "", "no scheme", "http://A.Example.COM/en/7?x#y", "https://example.net/de/8/a", "ftp://x.example.net/de/9", "http://org/es/", "http://corg/es/", "http://com/en", "//x", "http://a.com/en/7://b", "http://h?q/en/", "http://h#f", "http://例.com/en/é"]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("score", F.lit("x"))
    got = op8.url_filter(df)
    assert got.count() == len(URLS) + 1 and op8.url_filter(df.where("false")).count() == 0
    for r in got.collect():
        u = URLS[r["page_id"]] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(rule), verdict, rule) for verdict, rule in op8.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[2] if fits else None)
        assert r["verdict"] == max(fits)[1] if fits else r["verdict"] in ("allow", "block")


def test_url_models_equal_plain_counts(spark):
    rnd = random.Random(9)
    good = [f"https://{rnd.choice(['ab', 'abba', 'bab'])}.net/de/{i}" for i in range(120)]
    bad = [f"http://{rnd.choice(['zx', 'xxz', 'zzz'])}.com/en/{i}" for i in range(120)]
    test = [f"http://{h}.info/x{i}" for i, h in enumerate(["zxz", "xzxz", "abab", "babba"])]
    urls = good + bad + test
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in op8.url_filter(df).collect()}
    fold = {r["url"]: r["f"] for r in df.select("url", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(op8.FOLDS)).alias("f")).collect()}
    pad = lambda u: op8.START * op8.ORDER + u + op8.END
    seen = {pad(u)[i : i + k] for u in urls for i in range(len(pad(u))) for k in range(1, 5) if i + k <= len(pad(u)) and i + k > op8.ORDER}
    everything = {pad(u)[i + op8.ORDER] for u in urls for i in range(len(u) + 1)}

    def model(own):
        n = {}
        for u in own:
            for i in range(len(u) + 1):
                for k in range(op8.ORDER + 1):
                    g = pad(u)[i + op8.ORDER - k : i + op8.ORDER + 1]
                    n[g] = n.get(g, 0) + 1

        def p(g):
            if not g:
                return 1 / (len(everything) + 1)
            after = {x: c for x, c in n.items() if len(x) == len(g) and x[:-1] == g[:-1]}
            total, kinds, low = sum(after.values()), len(after), p(g[1:])
            return (after.get(g, 0) + kinds * low) / (total + kinds) if total else low

        return p

    assert seen
    yes, no = model([u for u in good if fold[u]]), model([u for u in bad if fold[u]])
    for k in list(range(len(good) + len(bad), len(urls))) + [0, 130]:
        u = urls[k]
        grams = [pad(u)[i : i + 4] for i in range(len(u) + 1)]
        want = sum(np.log(yes(g)) - np.log(no(g)) for g in grams) / len(grams)
        assert got[k]["score"] == pytest.approx(want, abs=1e-9)
    assert [got[240 + i]["verdict"] for i in range(4)] == ["block", "block", "allow", "allow"]


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 7)] + [(900, 901), (902, 901)]
    got = {r["id"]: r["component"] for r in components(Stage(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(300)) and {got[900], got[901], got[902]} == {900}


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline as p

    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        own = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        if i % 6 == 0:
            own[3] = "scum"
        rows.append((i, " ".join(own) + (" a.b@c.de" if i % 10 == 1 else ""), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1], "en", "s9", 1) for i in range(40)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, step) in enumerate(p.STAGES):
        out = step(spark, docs, folder)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen[name] = docs.collect()
    text = {r[0]: r[1] for r in rows}
    clean = {r["doc_id"] for r in seen["toxicity"]}
    assert clean == {i for i, t in text.items() if not t or "scum" not in t}
    first = {}
    for i in sorted(clean):
        first.setdefault(text[i] or i, i)
    assert {r["doc_id"] for r in seen["ngram_jaccard"]} == set(first.values())
    assert all("a.b@c.de" not in (r["text"] or "") and r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in seen["pii"])
    assert {r["doc_id"] for r in seen["pii"]} == set(first.values())
    copies = {}
    for r in seen["entropy_mixing"]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 2
    pieces = {}
    for r in seen["packing"]:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + (r["piece"] == 0)
    assert pieces == copies
    whole = sorted((r["doc_id"], r["ids_crc32"]) for r in p.run(spark, folder).collect())
    assert whole == sorted((r["doc_id"], r["ids_crc32"]) for r in seen["packing"])


def test_pipeline_workers_take_bounded_batches(spark, tmp_path):
    import corpus_pipeline as p

    spark.conf.unset(p._BYTES)
    try:
        docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
        spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        p.toxicity(spark, docs, str(tmp_path))
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").agg(F.max("n"), F.sum("n")).first()
        assert sizes[0] <= 5 << 20 and sizes[1] > 11 << 20
        spark.conf.set(p._BYTES, "1048576")  # a session's own setting stays
        p.personal_data(spark, docs, str(tmp_path))
        assert spark.conf.get(p._BYTES) == "1048576"
    finally:
        spark.conf.unset(p._BYTES)


@pytest.mark.parametrize("parts, ways, passed", [(3, 1024, 1 << 20), (7, 2, 20), (40, 3, 1), (1, 2, 7)])
def test_ngram_ranks_across_runs(parts, ways, passed):
    draw = np.random.default_rng(5)
    sets = {i: np.unique(draw.integers(0, 60, 12)) for i in range(50)}
    sets[50], sets[54] = np.array([1000]), np.array([1001])
    every = Counter(h for s in sets.values() for h in s.tolist())
    whole = sorted((i % 4 if i < 54 else 9, i, i < 9, s.tolist()) for i, s in sets.items())
    lists = lambda rows, names: pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()) if k > 1 or names[k] == "hashes" else None) for k, x in enumerate(zip(*rows))], names=names)
    read = lists([(r, h) for r, _, _, h in whole], ["run", "hashes"])

    def dealt(batches, steps):
        """As between tasks: rows of a slot come together, sorted, in batches of any size."""
        for step in [*steps[1:], None]:
            rows = pa.Table.from_batches(list(batches)).combine_chunks().sort_by("slot").to_batches(max_chunksize=4)
            batches = rows if step is None else op6._dealt_again(step, passed)(rows)
        return batches

    by_part, by_run = op6._steps(parts, ways), op6._steps(10, ways)
    assert all(a <= b * ways for a, b in zip([parts, *by_part], by_part)) and by_part[-1] == by_run[-1] == 1
    counted = dealt(op6._counted(parts, by_part[0], passed)([read.slice(0, 20), read.slice(20)]), by_part)
    often = pa.Table.from_batches(dealt(op6._often(by_run[0], passed)(counted), by_run)).rename_columns(["run", "key", "x", "y"])
    for run in {r for r, *_ in whole}:
        own = [r for r in whole if r[0] == run]
        held = pa.table({"run": [run] * len(own), "set_id": [r[1] for r in own], "rich": [r[2] for r in own], "hashes": pa.array([r[3] for r in own], pa.list_(pa.int64()))})
        for known in (often.filter(pa.compute.equal(often["run"], run)), often.slice(0, 0)):
            got = op6._ranked(held, known).to_pylist()
            assert [(r["set_id"], r["rich"], r["n"]) for r in got] == [(r[1], r[2], len(r[3])) for r in own]
            for r, (*_, h) in zip(got, own, strict=True):
                assert [(x["df"], x["hash"]) for x in r["hashes"]] == (sorted((every[x], x) for x in h if every[x] > 1) if len(known) else [])


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, files in os.walk(str(d)) for f in files if f.startswith("shuffle_")}


def test_kept_tables_leave_no_shuffle_files(spark):
    key = common._CLEANUP
    before = shuffle_files(spark)
    assert spark.conf.get(key, None) is None
    kept = Stage(spark, "t").keep(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert kept.count() == 7 and spark.conf.get(key, None) is None
    spark.conf.set(key, "false")  # a session's own setting stays
    try:
        Stage(spark, "t").keep(spark.range(5))
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.unset(key)


def test_ngram_keeps_no_windows(spark, monkeypatch):
    """Texts without copies: the tables together stay far below the texts, which the windows do not."""
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)) for _ in range(300)]
    most, old = [0], Stage.keep

    def keep(self, df):
        out = old(self, df)
        paths = [p.removeprefix("file://") for p in self.paths.values()]
        most.append(sum(os.path.getsize(f"{p}/{f}") for p in paths for f in os.listdir(p) if f.endswith(".parquet")))
        return out

    monkeypatch.setattr(Stage, "keep", keep)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {(r["doc_id"], r["component_id"]) for r in op6.ngram_jaccard(df).collect()} == {(i, i) for i in range(300)}
    assert 0 < max(most) < sum(map(len, texts)) / 8


@pytest.mark.parametrize("tasks", [1, 3])
@pytest.mark.parametrize("holders, step", [(2, 1), (3, 4), (4, 2), (9, 5)])
def test_ngram_copies_in_many_tasks_are_one_holder(tasks, holders, step):
    """Tasks that send the same groups make the pairs and marks of one task."""
    frequent = 3
    texts = [f"a b c d e f own{i} g{i} h{i} i{i}" for i in range(holders)]
    sent = [b for _ in range(tasks) for b in op6._postings(5, 75, frequent)(pa.RecordBatch.from_arrays([pa.array(texts[i : i + step])], names=["text"]) for i in range(0, holders, step))]
    rows = pa.Table.from_batches(sent).combine_chunks().sort_by("hash").to_batches(max_chunksize=2)
    got = [(r["a"], r["b"], r["hash"]) for b in op6._candidates(frequent, 75)(rows) for r in b.to_pylist()]
    sets = [shingle_sets(*buffers(pa.array([t])))[0] for t in texts]
    lists = {}
    for s in sets:
        w = s[: op6.window_length(len(s), 75)]
        for h in w.tolist():
            lists.setdefault(h, set()).add(op6.fingerprint(w, 37) ^ len(s))
    assert Counter((a, b) for a, b, h in got if h is None) == Counter(p for g in lists.values() if len(g) <= frequent for p in itertools.combinations(sorted(g), 2))
    assert {(a, h) for a, b, h in got if h is not None} == {(a, h) for h, g in lists.items() if len(g) > frequent for a in g}


def test_ngram_task_forgets_what_it_sent(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e f", "A b c d e f", "", None, "x"])], names=["text"])
    assert sum(b.num_rows for b in op6._postings(5, 75, 48)([batch, batch])) == 3
    monkeypatch.setattr(op6, "SENT", 1)
    assert sum(b.num_rows for b in op6._postings(5, 75, 48)([batch, batch])) == 6


def test_mix_shuffles_no_texts_for_few_counts(spark, monkeypatch):
    df = spark.createDataFrame([(i, "word " * (i % 9), f"s{i % 3}") for i in range(200)] + [(5, "again", None)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = op1.mixed_documents(df.where("doc_id <> 5"))
        assert "BroadcastHashJoin" in few._jdf.queryExecution().toString() and "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, op1.mixed_documents(df).collect()))
        monkeypatch.setattr(common, "BROADCAST", 0)
        assert got and got == sorted(map(str, op1.mixed_documents(df).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
