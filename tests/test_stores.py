"""Vector store, numbered rows and batches, artifacts, workbooks, name matching, hashes and tails."""

import itertools
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystat.functions import matching, pvalues
from quarrystat.functions.vectors import VectorStore
from quarrystat.operators import sequences
from quarrystat.sources import readers, sinks


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/v")
    add = lambda rows: store.add("a", spark.createDataFrame(rows, "item_id string, embedding array<double>, created_at string"))
    add([("x", [0.0, 0.0], "2024-01-01"), ("y", [1.0, 0.0], "2024-01-01"), ("z", [5.0, 5.0], "2024-01-02")])
    add([("x", [9.0, 9.0], "2024-01-03")])
    store.delete("a", spark.createDataFrame([("y", "2024-01-04")], "item_id string, created_at string"))
    store.add("b", spark.createDataFrame([("q", [1.0], "2024-01-01")], "item_id string, embedding array<double>, created_at string"))
    assert {r["collection"]: r["items"] for r in store.collections().collect()} == {"a": 2, "b": 1}
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, embedding array<float>")
    near = lambda **k: [r["item_id"] for r in store.search("a", queries, 2, **k).orderBy("rank").collect()]
    assert near() == ["z", "x"] and near(as_of="2024-01-02") == ["x", "y"] and near(as_of="2023-01-01") == []


def test_numbered_batches(spark, sf):
    df = sinks.numbered(spark.read.parquet(f"{sf}/orders.parquet").repartition(5), ["o_orderdate", "o_orderkey"])
    rows = df.orderBy("o_orderdate", "o_orderkey").collect()
    assert [r["row_index"] for r in rows] == list(range(len(rows)))
    parts = [p.count() for p in sinks.batches(df, "row_index", 400, ["o_orderkey"], limit=1000)]
    assert parts == [400, 400, 200] and list(sinks.batches(df.where("false"), "row_index", 5)) == []


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")
    for kind in ("json", "csv", "md"):
        for _ in range(2):
            sinks.write_artifact(df, f"{tmp_path}/{kind}", kind)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/md").collect()] == ["| n | s |", "| --- | --- |", "| 1 | a\\|b |", "| 2 |  |"]
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    sinks.append_rows(df, f"{tmp_path}/p")
    sinks.append_rows(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>a</t></si><si><r><t>x</t></r><r><t> y</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>a</t></is></c><c r="D1" t="inlineStr"><is><t>d</t></is></c></row><row><c r="A2"><v>1.5</v></c><c r="D2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    df = readers.read_any(spark, f"{tmp_path}/b.xlsx")
    assert df.columns == ["a", "a_2", "column", "d"] and [tuple(r) for r in df.collect()] == [("1.5", None, None, "x y")]


def test_name_patterns(spark):
    names = ["Close Month", " close day", "open", "LOAD_1", "loadx1", None, "a.b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    out = lambda p: [r["n"] for r in df.where(matching.excluded(F.col("n"), p)).collect()]
    assert out(["close*"]) == names[:2] and out(["OPEN"]) == ["open"] and out(["load_1"]) == ["LOAD_1"] and out(["a?b"]) == ["a.b"] and out(["axb"]) == []
    assert out(["%_1"]) == ["LOAD_1", "loadx1"] and out(["re:^lo.*1$"]) == ["LOAD_1", "loadx1"] and out(["re:["]) == [] and out(["re:" + "x" * 201]) == []


def test_fuzzy_links_of_short_names(spark):
    """Equal names link whatever the length of their tokens; names without tokens don't."""
    left = spark.createDataFrame([(1, "IBM"), (2, "A B C"), (3, "c a b b"), (4, "##"), (5, None), (6, "acme holdings ab")], "id long, name string")
    right = spark.createDataFrame([(11, "ibm."), (10, "I.B.M"), (12, "c-b-a"), (13, "--"), (14, "holdings acme ab"), (15, "IBM")], "id long, name string")
    got = {r["left_id"]: (r["right_id"], r["kind"], r["score"]) for r in matching.fuzzy_links(left, right).collect()}
    assert got == {1: (11, "exact", 100), 2: (12, "exact", 100), 3: (12, "exact", 100), 6: (14, "exact", 100)}


def test_fuzzy_links(spark):
    left = spark.createDataFrame([(1, "Acme Steel Works"), (2, "Northern Light Trading"), (3, "Zed"), (4, None)], "id long, name string")
    right = spark.createDataFrame([(10, "works steel ACME"), (11, "Acme Stele Works"), (20, "northern lights trading house"), (21, "Trading Northern Co"), (30, "Other")], "id long, name string")
    got = {r["left_id"]: (r["right_id"], r["kind"]) for r in matching.fuzzy_links(left, right).collect()}
    assert got[1] == (10, "exact") and got[2][0] in (20, 21) and 3 not in got and 4 not in got


def test_sign_hashes(spark):
    r = np.random.default_rng(1)
    sets = [[f"t{i}" for i in r.choice(60, 20, replace=False)] for _ in range(40)]
    sets += [s[:-1] + ["zz"] for s in sets[:10]]
    df = spark.createDataFrame([(f"s{i}", 1, s) for i, s in enumerate(sets)], "key string, copies int, t array<string>")
    hashed = df.select("key", "copies", matching.simhash(F.col("t")).alias("h"))
    h = {x["key"]: x["h"] for x in hashed.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(h), 2) if bin((h[a] ^ h[b]) & (2**64 - 1)).count("1") <= 3}
    assert {(x["a"], x["b"]) for x in sequences.near_hashes(hashed, 3).collect()} == want
    same = spark.createDataFrame([(["a", "b", "c"], ["c", "a", "b"], 5, 6)], "x array<string>, y array<string>, i long, j long")
    row = same.select((matching.simhash(F.col("x")) == matching.simhash(F.col("y"))).alias("e"), matching.hamming(F.col("i"), F.col("j")).alias("d")).first()
    assert row["e"] and row["d"] == 2


def test_tails(spark):
    z = [-4.0, -1.0, 0.0, 0.5, 1.96, 2.9, 3.1, 6.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    for x, got in zip(z, df.select(pvalues.normal_sf(F.col("z")).alias("p")).collect()):
        assert abs(got["p"] - math.erfc(x / 2**0.5) / 2) < 1e-10
    for k in (1, 2, 3, 4, 7, 10):
        df = spark.createDataFrame([(x, k) for x in (0.1, 1.0, 3.84, 12.0)], "x double, k int")
        grid = np.linspace(0, 400, 4_000_001)[1:]
        density = grid ** (k / 2 - 1) * np.exp(-grid / 2) / (2 ** (k / 2) * math.gamma(k / 2))
        for row in df.select("x", pvalues.chi2_sf(F.col("x"), F.col("k")).alias("p")).collect():
            assert abs(row["p"] - np.trapezoid(density[grid >= row["x"]], dx=1e-4)) < 1e-4
    p = spark.createDataFrame([(0.1,), (1.358,), (3.0,)], "l double").select(pvalues.kolmogorov_sf(F.col("l")).alias("p")).collect()
    assert p[0]["p"] == 1 and abs(p[1]["p"] - 0.05) < 1e-3 and p[2]["p"] < 1e-6


def test_alignment_and_chains(spark):
    assert sequences.local_alignment("xxabcyy", "zzabcww") == 6 and sequences.local_alignment("abc", "axc") == 3 and sequences.local_alignment("", "a") == 0
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6), (8, 6)] + [(100 + i, 99 + i) for i in range(1, 200)]
    got = {r["id"]: r["depth"] for r in sequences.chain_depths(spark.createDataFrame(rows, "id long, p long"), "id", "p").collect()}
    assert [got[i] for i in range(1, 9)] == [0, 1, 2, 3, 0, None, None, None] and got[299] == 198


def test_roles_and_plans(spark):
    df = spark.createDataFrame([(i, f"u{i % 3}", "ab"[i % 2], float(i)) for i in range(60)], "record_id long, user string, activity string, amount double").selectExpr("*", "timestamp_seconds(record_id) AS start_ts")
    roles = sequences.role_scores(df)
    assert {r["column"]: r["role"] for r in roles.collect()} == {"record_id": "id", "user": "case", "activity": "process", "amount": "value", "start_ts": "time"}
    plan = {r["family"]: (r["selected"], r["missing"]) for r in sequences.plan_for(roles).collect()}
    assert plan["queueing"] == (True, "") and plan["hosts"] == (False, "host") and plan["parameters"] == (False, "params")
    df.createOrReplaceTempView("packed")
    told = {r["intent"]: r for r in sequences.materialize_pack(spark, [("n", "SELECT count(*) AS n FROM packed"), ("bad", "DROP TABLE packed"), ("wrong", "SELECT nothing FROM packed")]).collect()}
    assert told["n"]["rows"] == '{"n":60}' and told["bad"]["status"].startswith("error") and told["wrong"]["status"].startswith("error")


def test_robust_scale(spark):
    one = lambda v: tuple(matching.robust_scale(spark.createDataFrame([(float(x),) for x in v], "x double"), "x").first())
    assert one([1, 2, 3, 4, 100, -100]) == (6, False, 2.5, round(1.4826 * 1.5, 9))
    assert one([1, 1, 1, 1, 5, 9, 1, 5])[3] == pytest.approx(4 / 1.349, abs=1e-6) and one([-1] * 9 + [3])[3] == pytest.approx(1.2) and one([7, 7])[3] == 1.0
    n, log1p, centre, _ = one([1] * 5 + [2, 3, 4000])
    assert log1p and centre == pytest.approx(math.log(2), abs=1e-9)


def test_scratch(spark, tmp_path, monkeypatch):
    from quarrystat.plans import scratch

    monkeypatch.setattr(scratch, "scratch_dir", lambda s: f"file://{tmp_path}/ck")
    assert scratch.materialize(spark.range(5), "t").count() == 5 and len(list((tmp_path / "ck" / "quarrystat").iterdir())) == 1
    assert scratch.clear_scratch(spark) and not (tmp_path / "ck" / "quarrystat").exists()


def test_scratch_without_the_setting():
    """A local session gets one folder, a cluster's is refused."""
    from types import SimpleNamespace

    from quarrystat.plans.scratch import scratch_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    assert scratch_dir(session("local[2]")) == scratch_dir(session("local[2]")).rstrip("/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session("spark://host:7077"))
