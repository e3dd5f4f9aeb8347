"""Splitting readers of JSON arrays against the json module."""

import json
import random
import subprocess
import sys
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from reconcord.sources import json_files, statements


@pytest.fixture
def tiny_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in was.items():
        spark.conf.set(k, v)


def rows_of(spark, path, root="$"):
    got = json_files.array_rows(spark, str(path), root).orderBy("path", "position").collect()
    assert [r["lineage"] for r in got] == [f"{root}[{r['position']}]" for r in got]
    return [(r["position"], json.loads(r["row"])) for r in got]


def wild(seed, n):
    rnd = random.Random(seed)
    texts = ["", "plain", 'quo"te', "back\\", "\\\"}", "},{", "[1,2]", "ünï 日本", "\n\t", '"data":[', "a" * 700, "{}" * 90]
    value = lambda d: rnd.choice([1, None, True, 2.5, rnd.choice(texts), [value(d - 1)] if d else 0, {rnd.choice(texts): value(d - 1)} if d else "x"])
    return [rnd.choice([{"id": i, "narration": rnd.choice(texts), "more": value(3)}, value(3), rnd.choice(texts)]) for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split", [60, 100_000])
def test_elements_of_any_split_equal_the_json_module(spark, tmp_path, tiny_splits, indent, split):
    tiny_splits(split)
    files = {}
    for k in range(3):
        files[k] = wild(k, 60 if split > 100 else 10)
        (tmp_path / f"f{k}.json").write_text(json.dumps(files[k], indent=indent, ensure_ascii=k == 1))
    got = json_files.array_rows(spark, str(tmp_path)).collect()
    for k, want in files.items():
        own = sorted((r["position"], r["row"]) for r in got if r["path"].endswith(f"f{k}.json"))
        assert [(i, json.loads(x)) for i, x in own] == list(enumerate(want))


@pytest.mark.parametrize("split", [40, 100_000])
def test_enveloped_arrays(spark, tmp_path, tiny_splits, split):
    tiny_splits(split)
    data = wild(9, 15)
    body = {"meta": {"data": [1, 2, {"x": "]"}], "note": '"data":['}, "other": [[3], 4], "data": data, "tail": [5, {"data": [6]}], "s": "}]"}
    (tmp_path / "e.json").write_text(json.dumps(body))
    assert rows_of(spark, tmp_path / "e.json", "$.data") == list(enumerate(data))
    assert rows_of(spark, tmp_path / "e.json", "$.other") == [(0, [3]), (1, 4)]
    assert rows_of(spark, tmp_path / "e.json", "$.absent") == []
    assert rows_of(spark, tmp_path / "e.json") == []


def test_odd_files(spark, tmp_path, tiny_splits):
    tiny_splits(50)
    for name, text, want in (("empty", "[]", []), ("blank", " [ \n ] ", []), ("none", "", []), ("scalar", "17", []), ("one", '["}"]', [(0, "}")]), ("number", "[1, 2 ,3]\n", [(0, 1), (1, 2), (2, 3)]), ("cut", '[{"a":1},{"b":2},', [(0, {"a": 1}), (1, {"b": 2})])):
        (tmp_path / name).write_text(text)
        assert rows_of(spark, tmp_path / name) == want, name
    with pytest.raises(ValueError):
        json_files.array_rows(spark, str(tmp_path), "$.a.b")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.recursive(st.none() | st.text('"\\}{][,a', max_size=6) | st.integers(0, 9), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('"\\}a', max_size=3), x, max_size=3), max_leaves=8), max_size=8), st.data())
def test_states_add_up_over_any_cut(elements, data):
    """The state that sums over earlier pieces give is the one that reading on gives."""
    text = json.dumps(elements).encode()
    cuts = [0, *sorted(i + 1 for i, c in enumerate(text) if c == 125 and data.draw(st.booleans())), len(text)]
    whole, string, depth = json_files.Place(0, 0, None), 0, 0
    state, n = json_files.BEFORE, 0
    for a, b in zip(cuts, cuts[1:]):
        assert (whole.in_string, whole.depth) == (string, depth)
        piece = text[a:b]
        place, odd, quotes = json_files.marks(piece)
        step = json_files._STEP[[piece[p] for p in place]].astype(int) if len(place) else place
        depth += int(step[odd == string].sum()) if len(place) else 0
        string = (string + quotes) & 1
        state, _, comma, _ = whole.cuts(state, piece, *whole.read(piece))
        n += len(comma)
    assert state == json_files.BEHIND and n == max(0, len(elements) - 1) and whole.depth == 0


def test_a_statement_reads_alike_from_splits_and_in_one_row(spark, tmp_path, tiny_splits):
    tiny_splits(2000)
    rnd = random.Random(4)
    lines = [{"id": f"L{rnd.randint(0, 400)}", "type": rnd.choice(["credit", "DEBIT", "x"]), "amount": rnd.choice(["1,200.50", "7", "n/a", "-3"]), "date": "2024-02-03", "narration": 'pay "REF-123456" }', "balance": "10.00"} for _ in range(500)]
    for k in range(2):
        (tmp_path / f"s{k}.json").write_text(json.dumps(lines[k * 250 :]))
    files = statements.files(spark, str(tmp_path))
    want = statements.scan_bank_statement(files, "b")
    got = statements.scan_bank_statement(statements.file_rows(spark, str(tmp_path)), "b")
    assert got.columns == want.columns
    key = lambda r: (r["evidence_id"], r["position"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len({key(r) for r in got.collect()}) == 750
    report = [{"id": f"R{i}", "amountCharged": "10.00", "amount": "9.50", "status": "SUCCESS", "timeCompleted": "2024-01-01", "walletCurrency": "NGN"} for i in range(300)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "r.json").write_text(json.dumps(report, indent=1))
    a, b = (sorted(map(tuple, statements.scan_settlement_lines(x, "nomba").collect())) for x in (statements.files(spark, str(tmp_path / "r")), statements.file_rows(spark, str(tmp_path / "r"))))
    assert a == b and len(a) == 300


def test_evidence_of_files_beyond_one_row(spark, tmp_path, tiny_splits, monkeypatch):
    (tmp_path / "x.json").write_text(json.dumps(wild(3, 40)))
    found = []
    for split in (90, 10_000):
        tiny_splits(split)
        monkeypatch.setattr(json_files, "WHOLE", 10)
        monkeypatch.setattr(json_files, "HASHED", 7)
        rows = json_files.array_rows(spark, str(tmp_path))
        found += [r["evidence_id"] for r in json_files.evidence(spark, str(tmp_path), rows).collect()]
    assert len(found) == 2 and found[0] == found[1] and found[0].startswith("rows:")


def test_pages_of_a_statement_run_on(spark, tmp_path, tiny_splits):
    tiny_splits(100)
    pages = [[{"id": f"L{i}", "n": i} for i in range(7)], [], [{"id": f"L{i}", "n": "} ]"} for i in range(5, 40)], [{"id": "z"}]]
    for k, page in enumerate(pages):
        (tmp_path / f"page-{k}.json").write_text(json.dumps(page))
    got = statements.paged_rows(spark, str(tmp_path)).orderBy("position").collect()
    assert [json.loads(r["row"]) for r in got] == sum(pages, [])
    assert [(r["position"], r["lineage"]) for r in got] == [(i, f"$[{i}]") for i in range(43)]
    assert len({r["evidence_id"] for r in got}) == 1 and got[0]["evidence_id"].startswith("pages:")


def test_statement_of_several_pages_is_scanned_as_one(spark, tmp_path, monkeypatch):
    from reconcord.plans import reads

    rows = [(i, datetime(2024, 1, 1), "a", float(i)) for i in range(2000)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    wanted = sorted(map(tuple, reads.scan_statement_splits({"events": events}).collect()), key=str)
    wrote, was = [], statements.paged_rows
    monkeypatch.setattr(statements, "paged_rows", lambda s, folder: wrote.append(folder) or was(s, folder))
    monkeypatch.setattr(reads, "PAGE_ROWS", 300)
    assert sorted(map(tuple, reads.scan_statement_splits({"events": events}).collect()), key=str) == wanted
    assert len(wanted) == 2000 and len(spark.read.text(wrote[0]).inputFiles()) > 4
