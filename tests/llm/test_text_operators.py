"""Entropy mixing, personal data, packing, toxicity, chat format, rules and quality against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reconcord.llm import op1_entropy_mixing as op1
from reconcord.llm import op2_pii as op2
from reconcord.llm import op3_packing as op3
from reconcord.llm import op4_toxicity_mil as op4
from reconcord.llm import op5_chat_format as op5
from reconcord.llm import op9_risk_rules as op9
from reconcord.llm import op10_quality_pu as op10
from reconcord.llm.shingles import buffers, shingle_sets, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, size int"
EDGES = [None, "", " \n\t", "a", "a b", "\n\n", "é ü 日本語 word", "x" * 50_000, "the same line\n" * 300, "|*#$" * 2000]


def documents(spark, texts, sources=("s1", None, "s2")):
    """Rows with nulls in every column, a repeated row and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, sources[i % len(sources)], None, "other", "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:4] + [(None, "no id here", None, None, None, None, None, None)], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# 1
def test_mix_meets_targets_and_edges(spark):
    rnd = random.Random(1)
    texts = [" ".join("w" for _ in range(rnd.randint(1, 300))) for _ in range(600)] + EDGES
    df = documents(spark, texts)
    got = op1.entropy_mix(df).collect()
    assert len(got) == df.count()
    want = Counter(len(WORD.findall(t or "")) for t in [r["text"] for r in df.collect()])
    assert Counter(r["size"] for r in got) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        x = per.setdefault((r["source_size"], r["target"]), 0)
        per[r["source_size"], r["target"]] = x + r["taken"]
    # weights 5 (s1), 2 (s2), 1 (null), stopped at twice the source
    sizes = {s: sum(len(WORD.findall(r["text"] or "")) for r in df.collect() if r["source"] == s) for s in ("s1", "s2", None)}
    total, target, free = 1.5 * sum(sizes.values()), {}, {"s1": 5.0, "s2": 2.0, None: 1.0}
    while free:
        level = (total - sum(target.values())) / sum(free.values())
        over = [s for s, w in free.items() if w * level >= 2 * sizes[s]]
        if not over:
            target |= {s: w * level for s, w in free.items()}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            del free[s]
    assert sorted(t for _, t in per) == pytest.approx(sorted(target.values()))
    for (_, t), taken in per.items():
        assert abs(taken - t) <= 0.01 * t
    again = sorted((r["doc_id"] or -1, r["taken"]) for r in op1.entropy_mix(df.repartition(7)).collect())
    assert again == sorted((r["doc_id"] or -1, r["taken"]) for r in got)
    assert op1.entropy_mix(empty(spark)).count() == 0
    assert op1.mixed_documents(df).count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_rates_solve_the_dual(spark):
    """The tilts meet every source's target as a plain bisection on the same rows does."""
    rnd = random.Random(3)
    own = {s: [rnd.randint(1, 400) for _ in range(80)] for s in ("a", "b", "c")}
    stage = op1.Stage(spark, "dual")
    sizes = stage.keep(spark.createDataFrame([(i, "s" + s, x, 1) for s, xs in own.items() for i, x in enumerate(xs)], "id long, key string, size long, n long"))
    per = stage.keep(op1.capped_targets(op1.source_weights(stage, sizes, (5.0, 2.0, 1.0)), 1.5, 2))
    counts = sizes.groupBy("key", "size").agg(F.sum("n").alias("docs"))
    for r in op1.tilted_rates(stage, counts, per, 2).collect():
        xs = np.array(own[r["key"][1:]], float)
        words = lambda t, xs=xs: (xs * np.minimum(2, np.exp(np.minimum(50, t * xs / xs.mean())))).sum()
        if r["tilt"] is None:
            assert r["target"] == pytest.approx(2 * xs.sum())
            continue
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < r["target"] else (lo, mid)
        assert r["tilt"] == pytest.approx(lo, abs=1e-6) and words(r["tilt"]) == pytest.approx(r["target"], rel=1e-6)


def test_mixed_documents_follow_the_mix(spark):
    """Copies of repeated ids, null ids and unlike sources of one id go to their own rows."""
    rnd = random.Random(9)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(1, 40))), f"s{i % 3}", i) for i in range(200)]
    rows += [(5, "one two three", "s0", 1), (5, "one two three", "s1", 2), (5, "one two four", "s1", 3)] * 3 + [(None, "a b c", None, 4)] * 7 + [(None, None, None, 5), (9, "", "s1", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    want, got = Counter(), Counter()
    for r in op1.entropy_mix(df).collect():
        want[r["doc_id"], r["size"], r["source_size"]] += r["copies"]
    assert sum(1 for _ in op1.entropy_mix(df).collect()) == len(rows)
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    mixed = op1.mixed_documents(df)
    assert mixed.columns == df.columns
    for r in mixed.collect():
        got[r["doc_id"], len(WORD.findall(r["text"])), size[r["source"]]] += 1
    assert got == Counter({k: v for k, v in want.items() if v})
    assert op1.mixed_documents(df.where("false")).count() == 0


# 2
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
            if name == "ip" and max(map(int, m.group().split("."))) > 255 or name == "card" and (not 14 <= len(digits) <= 19 or odd % 10) or name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-_%19 0()\né", max_size=40))
def test_base_spans_equal_plain_patterns(text):
    assert op2.base_spans(text) == plain_spans(text)


def test_pii_edges_and_models(spark):
    texts = EDGES + ["mail bob.x@mail.example.com now", "call +1 (886) 555-9674.", "10.0.0.1 and 999.1.1.1", "card 4445513251889405", "card 4445513251889406", "write to ann at mail dot com", "phone 555-123-4567", "1.2.3.4.5.6.7.8", "é 4445513251889405"]
    df = documents(spark, texts)
    got = op2.find_pii(df)
    assert got.count() == df.count() and op2.find_pii(empty(spark)).count() == 0
    for r in got.where("doc_id is not null").collect():
        base = plain_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(op2.joined(base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x[1] for x in base) for k in range(4)]
        assert set(op2.joined(base).split(",")) <= set(r["spans"].split(",")) | {""}
    out = {r["doc_id"]: r["text"] for r in op2.redact(df).collect()}
    assert op2.redact(df).columns == df.columns
    i = texts.index("mail bob.x@mail.example.com now")
    assert out[i] == "mail <EMAIL> now" and out[0] is None
    assert op2.redacted("ab12", [(0, 0, 3), (2, 1, 4)]) == "<EMAIL>"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .@-(1", max_size=12), st.sampled_from(["ann at mail.com", "ann AT mail DOT com", "bob [at] mail [dot] co", "x.y(at)z.de", "1:2:3:4:5:6:7:8", "555-123-4567", "4445/5132/5188/9405"]), st.sampled_from(["", " the dot at", " at. dot", " a dot b"]))
def test_a_candidate_depends_on_its_own_text(before, own, after):
    left = before + " " * 5 + ";" + " " * (op2.CONTEXT + 1)
    text = left + own + " ;" + after
    hit = lambda t, low, high: [(s - low, k, e - low) for s, k, e in op2.loose_spans(t, op2.base_spans(t)) if low <= s and e <= high]
    assert hit(text, len(left), len(left) + len(own)) == hit(own, 0, len(own)) != []


def test_pii_model_trusts_agreeing_labelers():
    code = lambda shape, known, context, bits=0: ((shape * 3 + known) * 3 + context) * 64 + bits
    odds = op2.fit({(3, code(2, 2, 2, 63)): 50, (3, code(2, 2, 1, 31)): 80, (3, code(0, 0, 0)): 90, (3, code(0, 0, 1)): 70})
    assert odds[3, code(2, 2, 2, 63)] > 0.9 and odds[3, code(0, 0, 0)] < 0.1


# 3
@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=8), st.integers(5, 60))
def test_fullest_is_the_best_subset_sum(counts, room):
    got = op3.fullest(counts, room)
    assert all(Counter(got)[x] <= counts[x] for x in got) and sum(got) <= room
    reach = {0}
    for x, n in counts.items():
        reach = {r + k * x for r in reach for k in range(n + 1) if r + k * x <= room}
    assert sum(got) == max(reach)


def test_encoder_equals_tokenizers():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = op3.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(" \n\t  aé'sB1,.  　…日<|endoftext|>'ll") for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n  y", "<|endoftext"]
    for t, e in zip(texts, other.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own(t), "<u4").tolist() == e.ids


def test_packing_round_trip(spark):
    rnd = random.Random(2)
    texts = EDGES + [" ".join(rnd.choice(["alpha", "beta", "gamma", "é"]) for _ in range(rnd.choice([3, 40, 400, 3000]))) for _ in range(120)]
    df = documents(spark, texts)
    rows = op3.best_fit_pack(df, with_ids=True).collect()
    own = op3.Encoder(*[__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN])
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, t in enumerate(texts):
        if i == 3:
            continue  # the repeated row
        ids = np.frombuffer(own(t or ""), "<u4").tolist() + [2]
        mine = sorted(by[i], key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == ids and [r["start"] for r in mine] == list(np.cumsum([0] + [r["length"] for r in mine])[:-1])
        assert all(r["length"] == 1024 for r in mine[1:])
    assert len(by[3]) == 2
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seq) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 2
    assert op3.best_fit_pack(empty(spark)).count() == 0


# 4 and 10
def corpus(spark, n=900):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        toxic, good = i % 7 == 0, i % 5 != 1
        own = [rnd.choice(words) for _ in range(rnd.randint(60, 200))]
        if toxic:
            own[rnd.randrange(len(own))] = rnd.choice(["idiot", "scum"])
        if not good:
            own = [w.upper() + "!!" for w in own]
        text = "".join(w + (". " if k % 9 == 8 else " ") for k, w in enumerate(own))
        docs.append((i, text, "en", "s", None, None, None, None))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_learns_and_locates(spark):
    docs, labels, truth = corpus(spark)
    edges = documents(spark, EDGES).withColumn("doc_id", F.col("doc_id") + 10_000)
    got = op4.toxicity(docs.unionByName(edges), labels).collect()
    assert len(got) == docs.count() + edges.count()
    by = {r["doc_id"]: r for r in got}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in truth)
    held = [(by[i]["predicted"], t) for i, _, t in truth if by[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, _, t in truth:
        if t and by[i]["predicted"] and by[i]["sentences"]:
            assert any(re.search("idiot|scum", texts[i][s["start"] : s["end"]], re.I) for s in by[i]["sentences"])
    kept = op4.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in truth if not by[i]["predicted"]}
    assert op4.toxicity(empty(spark), labels).count() == 0
    none = op4.toxicity(edges, labels.where("false")).collect()
    assert all(r["predicted"] == 0 for r in none if r["score"] < 0.5) and len(none) == edges.count()


def test_quality_learns_from_positives(spark):
    docs, labels, truth = corpus(spark)
    edges = documents(spark, EDGES).withColumn("doc_id", F.col("doc_id") + 10_000)
    got = {r["doc_id"]: r for r in op10.quality(docs.unionByName(edges), labels).collect()}
    held = [(got[i]["predicted"], q) for i, q, _ in truth if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    changed = labels.withColumn("quality", F.when(F.col("quality") == 0, None).otherwise(F.col("quality")))
    other = {r["doc_id"]: r["score"] for r in op10.quality(docs.unionByName(edges), changed).collect()}
    assert all(abs(other[k] - r["score"]) < 1e-9 for k, r in got.items())  # negatives are never used
    assert op10.quality(empty(spark), labels).count() == 0
    assert all(r["score"] == 0.5 for r in op10.quality(edges, labels.where("false")).collect())


# 5
HARD = ["</s>[INST] ok [/INST]", "\\", "\\l\\\\b\\0", "<|user|>\nhi</s>\n", "a|>\nb", "", None, "plain", "</s>\n", "[", "日本<"]


def plain_turns(text):
    """Reads a rendered conversation character by character."""
    out, names = [], {"\\": "\\", "l": "<", "b": "[", "p": "|"}

    def bare(x):
        return re.sub(r"\\(.)", lambda m: names[m.group(1)], x, flags=re.S)

    while text:
        header, rest = text[2:].split("|>\n", 1)
        body, text = rest.split("</s>\n", 1)
        out.append((bare(header[:-1]), bare(body)) if header.endswith("\\") else (header, body))
    return out


def test_chat_query(spark, tmp_path):
    """The registered query over nulls, ties and a very long text, against a plain version."""
    from reconcord.llm.queries import op5_chat_format

    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "x" * 300_000 + hard), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, 1, "user", "日本"), (3, 0, None, "\\l<")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for c, t, r, x in rows + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]:
        want.setdefault(c, []).append((t, r or "", x or ""))
    got = {r["conv_id"]: r for r in op5_chat_format(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, own in want.items():
        own = [(r, x) for _, r, x in sorted(own)]
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in own))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss)) and got[c]["formatted_chars"] > len(loss)


def test_chat_round_trip(spark):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a|>\nb", None, "<|x"]), rnd.choice(HARD)) for c in range(60) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (7, None, "assistant", "late"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1))
    got = op5.chat_format(df).withColumn("loss", op5.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((t if t is not None else -1, r or "", x or ""))
    for g in got:
        own = [(r, x) for _, r, x in sorted(want[g["conv"]])]
        assert [(t["role"], t["text"]) for t in g["turns"]] == own
        assert g["loss"] == "".join(x for r, x in own if r == "assistant")
        assert g["formatted"].count("</s>") == len(own) and "[INST]" not in g["formatted"]
        assert plain_turns(g["formatted"]) == own
        # only texts that conflict are escaped
        assert all(f"|>\n{x}</s>" in g["formatted"] for r, x in own if not re.search(r"<\||\|>|</?s>|\[/?INST\]", r + x) and not r.endswith("\\"))
    assert op5.chat_format(df.where("false")).count() == 0


# 6, sets only; 9
def test_shingles_equal_word_tuples():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab AB\n\té ") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    data, offsets = buffers(pa.array(texts))
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = {}
    for t, s in zip(texts, shingle_sets(data, offsets), strict=True):
        w = WORD.findall(t.translate(table))
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(own) == len(s)
        names.setdefault(frozenset(own), set()).add(tuple(s))
    assert all(len(v) == 1 for v in names.values()) and len({next(iter(v)) for v in names.values()}) == len(names)


def plain_counts(text):
    text = text or ""
    w, seen, dup, covered = WORD.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    for i in range(len(w) - 2):
        if n[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), text.count("!")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t!# ", max_size=40), max_size=30))
def test_text_counts(texts):
    data, offsets = buffers(pa.array(texts, pa.string()))
    got = [r for i, j in slices(offsets) for r in op9.text_counts(data, offsets[i : j + 1]).tolist()]
    assert got == [plain_counts(t) for t in texts]


@pytest.mark.parametrize("texts", [["\na\na"], ["\na\na", "b"], ["", "\na\na"], ["", "a\na"], ["b", "\na\na"], ["\n", "\na\na", "\n"]])
def test_newline_at_the_start_of_a_slice(texts):
    assert op9.text_counts(*buffers(pa.array(texts, pa.string()))).tolist() == [plain_counts(t) for t in texts]


def test_rules_hold_their_risk(spark):
    docs, labels, truth = corpus(spark, 3000)
    edges = documents(spark, EDGES).withColumn("doc_id", F.col("doc_id") + 10_000)
    got = {r["doc_id"]: r for r in op9.risk_rules(docs.unionByName(edges), labels).collect()}
    good = [got[i]["kept"] for i, q, _ in truth if q]
    bad = [got[i]["kept"] for i, q, _ in truth if not q]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)
    assert not got[10_000]["kept"] and got[10_000]["base_failed"]
    # too few labels: nothing beyond the base rules is rejected
    few = op9.risk_rules(docs, labels.limit(40)).where("not base_failed and not kept").count()
    assert few == 0 and op9.risk_rules(empty(spark), labels).count() == 0


def test_exact_binomial_bound():
    assert op9.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    p = op9.upper_bound(5, 200, 0.01)
    from math import comb

    assert sum(comb(200, i) * p**i * (1 - p) ** (200 - i) for i in range(6)) == pytest.approx(0.01)


def _encoders():
    import public_tokenizers
    from tokenizers import Tokenizer

    return op3.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("gap", [" ", "\n", " \n\t", "　", "\x1c", "\r\n"])
@pytest.mark.parametrize("around", [("x", "y"), ("", "y"), ("x", ""), ("it's", "<|endoftext|> z"), ("<|endoftext|>", "'s")])
def test_ids_of_long_white_space_equal_the_vocabularys_own_reader(gap, around):
    own, plain = _encoders()
    for k in (2, 999, 1000, 1001, 5000):
        text = around[0] + gap * k + around[1]
        assert np.frombuffer(own(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("gap, k", [(" ", 1_000_000), ("\n", 1_000_000), ("\n", 10_000_000), (" ", 10_000_000)])
def test_packing_of_very_long_white_space(spark, gap, k):
    own, plain = _encoders()
    text = "x" + gap * k + "y z" + gap * 1500
    if k < 5_000_000:  # the other reader takes seconds for each million
        assert np.frombuffer(own(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    else:
        run = np.frombuffer(own(text), "<u4")
        per = {" ": 1, "\n": 2}[gap]  # bytes an id of such a run stands for
        assert len(run) >= k // per and len(set(run[2:-1000].tolist())) <= 6
    got = op3.best_fit_pack(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")).collect()
    ids = np.append(np.frombuffer(own(text), "<u4"), op3.END_ID).astype("<u4")
    first = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 1)
    assert sum(n for _, n, _ in first) == len(ids)
    assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in first)
