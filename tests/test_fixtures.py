"""Hand-built cases with known answers, and invariants."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import distributions as dist
from brindle.functions.scalars import business_date, display_number, money, normal_text, ratio, yeo_johnson
from brindle.operators import checks, clv, commerce, customers, diagnostics as dg, evidence, joins, lineage, ordered, statistics as st
from brindle.sources import files
from brindle.sources.lake import Lake
from brindle.streaming import sessions


def buys(spark, rows):
    return spark.createDataFrame([(c, date.fromisoformat(d), float(a), i) for i, (c, d, a) in enumerate(rows)], "customer long, day date, amount double, txn long")


def test_activity_index_of_two_gaps(spark):
    p = buys(spark, [(1, "2020-01-01", 1), (1, "2020-01-06", 1), (1, "2020-02-20", 1), (2, "2020-01-01", 1), (2, "2020-02-15", 1), (2, "2020-02-20", 1), (3, "2020-01-01", 1), (3, "2020-01-11", 1), (4, "2020-01-01", 1)])
    got = {r["customer"]: r for r in customers.activity_index(p, "2020-03-01").collect()}
    assert (got[1]["mle"], round(got[1]["wmle"], 4), round(got[1]["cai"], 4)) == (25, 31.6667, -26.6667)
    assert round(got[2]["cai"], 4) == 26.6667 and got[3]["cai"] == 0 and got[4]["cai"] is None
    assert got[4]["n_intervals"] == 0 and not got[4]["likely_churned"]


def test_nothing_after_as_of_is_used(spark):
    p = buys(spark, [(1, "2020-01-01", 1), (1, "2020-06-01", 100)])
    assert customers.rfm(p, "2020-03-01").first()["m_gross"] == 1


def test_migration_row_of_nobody_is_null(spark):
    s = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "B")], "customer long, period int, state string")
    got = {(r["from_state"], r["to_state"]): r["share"] for r in customers.migration(s, ["A", "B", "C"]).collect()}
    assert got[("A", "B")] == 1 and got[("B", "B")] == 1 and all(got[("C", x)] is None for x in "ABC")


def test_stone_score_parameter_sets(spark):
    f = spark.createDataFrame([(1, 8, 75, 8356.0)], "customer long, r_days long, f_txn long, m_gross double")
    assert customers.stone_scores(f, 0.0025, 10).first()["m_points"] == 10
    assert customers.stone_scores(f, 0.1, 9).first()["m_points"] == 9


def test_decomposition_of_a_flat_total(spark):
    x = spark.createDataFrame([("A", 1, 1600.0), ("A", 2, 3200.0), ("B", 1, 6400.0), ("B", 2, 4800.0)], "s string, p int, v double")
    got = {r["slice"]: r for r in commerce.change_by_slice(x, "s", "v", F.col("p") == 1, F.col("p") == 2).collect()}
    assert got["A"]["points"] == 20 and got["B"]["points"] == -20 and got["A"]["growth"] == 1 and got["B"]["growth"] == -0.25


def test_growth_effects_sum_to_the_change(spark):
    p = buys(spark, [(1, "2020-01-01", 10)] * 20 + [(1, "2021-01-01", 30)] * 10)
    r = commerce.growth_buckets(p, F.year("day") == 2020, F.year("day") == 2021).first()
    assert (r["by_frequency"], r["by_ticket"], r["by_both"], r["delta"]) == (-100, 400, -200, 100)


def test_sizing_breaks_even(spark):
    p = spark.createDataFrame([("x", 967.0, 1.0, 510.5, 1.0, 15000.0, 0.8, 0.05, 0.065, 0.08)], "name string, n double, reach double, increment double, margin double, fixed double, touch double, rate_low double, rate_mid double, rate_high double")
    r = commerce.sizing(p).first()
    assert round(r["break_even"], 4) == 0.0320
    assert [round(r[f"net_{k}"]) for k in ("low", "mid", "high")] == [8909, 16314, 23719]


def test_simpson(spark):
    rows = [("gold", 1, 6800.0)] * 217 + [("gold", 0, 6900.0)] * 83 + [("silver", 1, 3100.0)] * 512 + [("silver", 0, 3200.0)] * 688
    r = commerce.simpson(spark.createDataFrame(rows, "s string, arm int, y double"), "s", "arm", "y").first()
    assert r["verdict"] == "all opposite" and r["overall"] > 0


def test_removal_effect_of_a_single_path(spark):
    p = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", True), (2, 1, "a", False)], "journey long, ts int, channel string, converted boolean")
    got = {r["channel"]: r["removal_effect"] for r in commerce.removal_effect(p).collect()}
    assert got == {"a": pytest.approx(1), "b": pytest.approx(1)}


@pytest.mark.parametrize("per_range", [7, 10**6])
def test_positions_and_tiles_over_ranges(spark, monkeypatch, per_range):
    monkeypatch.setattr(ordered, "PER_RANGE", per_range)
    df = spark.createDataFrame([(i, i * 7919 % 13, i % 4) for i in range(53)], "k long, x long, v long")
    got = ordered.running_total(df, ["x", "k"], "v", "total").orderBy("x", "k").toPandas()
    assert (got["total"] == got["v"].cumsum()).all()
    want = {r["k"]: r["t"] for r in df.selectExpr("k", "ntile(5) over (order by x desc, k) as t").collect()}
    assert {r["k"]: r["t"] for r in ordered.tiles(df, [F.desc("x"), "k"], 5, "t").collect()} == want
    few = df.where("k < 3")
    assert sorted(r["t"] for r in ordered.tiles(few, ["k"], 5, "t").collect()) == [1, 2, 3]
    assert ordered.tiles(df.where("k < 0"), ["k"], 5, "t").count() == 0


def test_markov_value_by_series(spark):
    m = spark.createDataFrame([("x", "x", 0.5), ("x", "y", 0.5), ("y", "x", 0.0), ("y", "y", 1.0)], "from_state string, to_state string, share double")
    got = {r["state"]: r for r in clv.markov_value(m, {"x": 10.0, "y": 1.0}, 0.1, 200).collect()}
    assert got["x"]["finite"] == pytest.approx(got["x"]["infinite"], rel=1e-6) and got["y"]["infinite"] == pytest.approx(11)


def test_permutation_null(spark):
    g = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 5, 3), (2, 1, 1), (2, 90, 2)], "customer long, gap int, j int")
    got = {r["customer"]: r["p_value"] for r in clv.cai_permutation(g, 500).collect()}
    assert got[1] == 1 and got[2] == 1


def test_distributions():
    assert dist.t_two_sided(1.851, 245) == pytest.approx(0.0654, abs=1e-4)
    assert dist.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.f_sf(4.351244, 1, 20) == pytest.approx(0.05, abs=1e-6)
    assert dist.studentised_range_sf(3.577935, 3, 20) == pytest.approx(0.05, abs=2e-4)
    assert dist.t_cdf(0, 5) == 0.5 and dist.beta_inc(2, 3, 1) == 1


def test_power_figures():
    assert st.sample_size(0.032, 0.037) == pytest.approx(20912, abs=2)
    assert st.mde_t(21, 12, 3000) == pytest.approx(3137, abs=120)
    assert st.mde_mean(21, 12, 3000) == pytest.approx(3040, abs=10)


def test_sample_ratio(spark):
    e = (20914 + 20886) / 2
    assert dist.chi2_sf((20914 - e) ** 2 / e * 2, 1) == pytest.approx(0.8911, abs=1e-4)


def test_chi_square_gate(spark):
    rows = [(i, j) for i, n in enumerate((38, 29, 21, 12)) for j, p in enumerate((8, 22, 25, 37, 8)) for _ in range(max(1, round(n * p / 100)))]
    assert not st.chi_square(spark.createDataFrame(rows, "a int, b int"), "a", "b").first()["asymptotic"]


def test_odds_ratio_by_design(spark):
    rows = [(1, 1)] * 32 + [(1, 0)] * 18 + [(0, 1)] * 18 + [(0, 0)] * 32
    df = spark.createDataFrame(rows, "e int, o int")
    assert round(st.odds_ratio(df, "e", "o").first()["odds_ratio"], 2) == 3.16
    assert st.odds_ratio(df, "e", "o", "retrospective").first()["risk_exposed"] is None


def test_least_squares_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ [1.5, -2] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    a = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    inv, res = np.linalg.inv(a.T @ a), y - a @ beta
    lev = np.einsum("ij,jk,ik->i", a, inv, a)
    hc3 = np.sqrt(np.diag(inv @ (a.T * (res / (1 - lev)) ** 2) @ a @ inv))
    plain, robust = (st.ols(df, ["a", "b"], "y", robust=r).toPandas() for r in (False, True))
    assert np.allclose(plain["estimate"], beta) and np.allclose(robust["se"], hc3)
    assert np.allclose(plain["se"], np.sqrt(np.diag(inv) * (res @ res) / 197))
    assert st.vif(df, ["a", "b"]).toPandas()["vif"].min() >= 1


def test_adjusted_p_values(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2)], "k int, p_value double")
    got = {r["k"]: r for r in st.adjust(p, "k").collect()}
    assert [round(got[k]["bh"], 6) for k in (1, 3, 2, 4)] == [0.04, 0.053333, 0.053333, 0.2]
    assert [round(got[k]["holm"], 6) for k in (1, 3, 2, 4)] == [0.04, 0.09, 0.09, 0.2]


def test_calibration_bins_hold_their_edges(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0), (0.3, 1)], "p double, y int")
    got = {r["bin"]: r["n"] for r in st.calibration(df, "p", "y", [0.1, 0.2, 0.3]).collect()}
    assert got == {0: 1, 1: 2}


def test_two_sample_figures():
    se = 3000 * math.sqrt(1 / 47 + 1 / 200)
    assert se == pytest.approx(486.30, abs=0.01) and 900 / se == pytest.approx(1.851, abs=1e-3)


def test_scalars(spark):
    r = spark.sql("SELECT timestamp_ntz'2011-06-03 23:30:00' AS a, timestamp_ntz'2011-06-04 01:30:00' AS b, 'NT$1,234.5' AS m, '  ＡＢ　ｃ ' AS t, 1 AS one, 0 AS zero, -2.0D AS neg")
    got = r.select(business_date("a", 6), business_date("b", 6), money("m").cast("double"), normal_text("t"), ratio("one", "zero"), yeo_johnson(F.col("neg"), 2), display_number(F.lit(1234.5), F.lit(9)), display_number(F.lit(1.0), F.lit(3)), display_number(F.lit(1.0), F.lit(0))).first()
    assert tuple(got) == (date(2011, 6, 3), date(2011, 6, 3), 1234.5, "ab c", None, pytest.approx(-math.log1p(2)), "1,234.50", "<5", "-")


def test_as_of_join_takes_the_latest_before(spark):
    a = spark.createDataFrame([(1, 5, "x"), (1, 10, "y"), (2, 1, "z"), (None, 3, "n"), (1, None, "t")], "k int, t int, v string")
    b = spark.createDataFrame([(1, 5, "p"), (1, 7, None), (1, 9, "q"), (2, 2, "r"), (None, 1, "w")], "k int, u int, g string")
    got = {r["v"]: r["g"] for r in joins.as_of(a, b, "k", "t", "u", ["g"]).collect()}
    assert got == {"x": "p", "y": "q", "z": None, "n": None, "t": None}


def test_planted_faults_are_caught(spark):
    g = checks
    dim = spark.createDataFrame([(1, 1, 5, False), (1, 4, None, True), (2, 1, 3, False), (2, 5, None, True), (3, 1, None, False)], "k int, valid_from int, valid_to int, is_current boolean")
    assert {(r["k"], r["fault"]) for r in g.history_faults(dim, "k").collect()} == {(1, "overlap"), (2, "gap"), (3, "current")}
    t = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", " "), (None, "9999")], "k string, v string")
    assert g.cast_loss(t, "v", "int").count() == 1
    assert g.grain_unique(t, ["k"]).count() == 1 and g.not_null(t, "k").count() == 1
    s = spark.createDataFrame([(1, 3), (1, 9999), (2, 4), (2, 9999), (3, 9999)], "k int, v int")
    assert [r["v"] for r in g.sentinel_suspects(s, "k", "v").collect()] == [9999]
    before, after = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(None,), (2,)], "x int")
    assert g.null_drift(before, after, ["x"]).count() == 1
    pos = spark.createDataFrame([(1.0, "TEST", "t1"), (500.0, "m", "t1")], "amount double, member_id string, terminal_id string")
    assert g.test_transactions(pos, ("TEST",), ("t9",)).first()["reasons"] == ["amount", "member"]
    clean, bad = g.quarantine(pos, F.col("amount") < 10)
    assert clean.count() == bad.count() == 1
    c = g.Contract({"a": "int", "b": "double"}, renames={"A1": "a"}, sentinels={"a": ("-1",)})
    src = spark.createDataFrame([("1", "2.5", "z"), ("-1", "q", "z")], "A1 string, b string, extra string")
    assert [tuple(r) for r in g.apply_contract(src, c).collect()] == [(1, 2.5), (None, None)]
    assert [tuple(r) for r in g.contract_columns(src, c).collect()] == [("extra", "extra")]
    hours = spark.sql("SELECT timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, h) AS ts FROM (SELECT explode(flatten(transform(sequence(0, 23), h -> array_repeat(h, h * h + 1)))) AS h)")
    assert g.hour_shift(hours, hours.withColumn("ts", F.col("ts") + F.make_dt_interval(hours=F.lit(8))), "ts").count() == 1
    assert g.hour_shift(hours, hours, "ts").count() == 0


def test_gate_codes_and_overrides(spark):
    one, none = spark.range(1), spark.range(0)
    got = {r["gate"]: r["code"] for r in checks.summary(spark, [checks.Gate("a", one), checks.Gate("b", none), checks.Gate("c", one)], {"c": checks.WARNING}).collect()}
    assert got == {"a": 1, "b": 0, "c": 2}


def test_evidence_gates(spark):
    sizes = spark.createDataFrame([(1, 133), (2, 17)], "cluster int, n int")
    assert [r["cluster"] for r in evidence.small_clusters(sizes).collect()] == [2]
    claims = spark.createDataFrame([("correlation", "discounts led to growth"), ("experiment", "it caused growth")], "level string, text string")
    assert evidence.causal_words(claims).count() == 1
    p = spark.createDataFrame([(1, 5.0), (2, 9.0)], "rank int, net_value double")
    assert evidence.unsorted(p).count() == 1
    m = spark.createDataFrame([("rate_x", "retrospective"), ("odds_ratio", "retrospective")], "metric string, design string")
    assert evidence.rates_of_retrospective(m).count() == 1


def test_session_cuts(spark):
    rows = [(1, "2020-01-01 10:00:00", "a", 1), (1, "2020-01-01 10:29:00", "a", 2), (1, "2020-01-01 11:00:00", "a", 3), (1, "2020-01-01 11:01:00", "b", 4), (1, "2020-01-02 05:59:00", "b", 5), (1, "2020-01-02 06:00:00", "b", 6)]
    e = spark.createDataFrame(rows, "u long, s string, utm string, id int").withColumn("ts", F.to_timestamp_ntz("s"))
    got = [r["cut"] for r in sessions.cut(e, "u", "ts", "id", 30, 6, ["utm"]).orderBy("id").collect()]
    assert got == ["start", None, "idle", "utm", "idle", "day"]


def test_lake(spark, tmp_path):
    t = Lake(spark, f"{tmp_path}/t")
    t.commit(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, s string, x double"), "load")
    t.merge(spark.createDataFrame([(2, 9.0), (3, 3.0), (None, 7.0)], "k int, x double"), ["k"], columns=["x"])
    assert {tuple(r) for r in t.read().collect()} == {(1, "a", 1.0), (2, "b", 9.0), (3, None, 3.0), (None, "n", 7.0)}
    assert t.read(1).count() == 3 and t.insertions(1, 2).count() == 3 and t.deletions(1, 2).count() == 2
    with pytest.raises(ValueError, match="twice"):
        t.merge(spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, x double"), ["k"])
    with pytest.raises(ValueError, match="lose"):
        t.widen_column("x", "float")
    same = t.current().checksum
    assert t.compact(1).checksum == same
    t.protect(1)
    assert t.expire(1) == [2] and [r["version"] for r in t.snapshots().collect()] == [1, 3]
    late = Lake(spark, f"{tmp_path}/t")
    late.versions = lambda: t.versions()[:1]  # a writer that hasn't seen the newer versions
    with pytest.raises(Exception, match="exists|Exists|already"):
        late._write(t.versions()[-1])


def test_loads(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "p int, v string")
    for _ in range(2):
        files.write_partitions(df, f"{tmp_path}/a", ["p"])
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    with pytest.raises(ValueError, match="daily"):
        files.append(df, f"{tmp_path}/a", daily=True)
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_new(df, f"{tmp_path}/a")
    a, b = files.fingerprint(df, ["p", "v"]).first(), files.fingerprint(df.orderBy(F.desc("p")), ["p", "v"]).first()
    assert a == b and a != files.fingerprint(df.where("p = 1"), ["p", "v"]).first()
    with pytest.raises(ValueError, match="quoted"):
        files.export_audience(df, f"{tmp_path}/b", ["p"], 3)
    assert files.ingested(spark.read.parquet(f"{tmp_path}/a")).where("_source_file like '%parquet'").count() == 2
    assert files.export_csv(df, f"{tmp_path}/c.csv") == 2 and (tmp_path / "c.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    assert files.partition_advice(12, 3) == ["year", "month"] and files.partition_advice(0.2, 5) == []


def test_api_source(spark):
    def pages(n, since):
        return [(n, i) for i in range(3) if i >= int(since or 0)]

    spark.dataSource.register(files.api_source("numbers", "page int, i int", pages))
    assert spark.read.format("numbers").option("pages", 4).option("since", 1).load().count() == 8


def test_lineage(spark):
    m = {"c": "WITH t AS (SELECT * FROM b) SELECT * FROM t JOIN a ON true", "b": "-- depends_on: a\nSELECT 1", "a": "SELECT * FROM raw"}
    assert lineage.order(m) == ["a", "b", "c"] and lineage.impact(m, "a") == {"b", "c"} and lineage.impact(m, "raw") == {"a", "b", "c"}
    with pytest.raises(ValueError, match="circle"):
        lineage.order({"a": "SELECT * FROM b", "b": "SELECT * FROM a"})
    df = spark.createDataFrame([(1, "f", 2)], "id int, gender string, x int").where("gender = 'f'").select("id")
    assert "gender" in lineage.columns_read(df)


def test_kaplan_meier_of_known_data(spark):
    df = spark.createDataFrame([(0, t, e) for t, e in ((1, 1), (2, 1), (2, 0), (3, 1), (4, 0))], "g int, t int, e int")
    got = {r["t"]: r["survival"] for r in st.kaplan_meier(df, "g", "t", "e").collect()}
    assert got == {1: pytest.approx(0.8), 2: pytest.approx(0.6), 3: pytest.approx(0.3)}


def test_entry_without_the_corpus_folders():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['brindle.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'cai_features' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_influence_and_tests_of_residuals_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    y = 1 + 2 * x + rng.normal(size=80) * (1 + abs(x))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
    a = np.column_stack([np.ones(80), x])
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    lev = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    cook = e**2 / (2 * (e @ e) / 78) * lev / (1 - lev) ** 2
    r = dg.residuals(df, ["x"], "y").orderBy("i").toPandas()
    assert np.allclose(r["cooks_d"], cook) and np.allclose(r["leverage"], lev)
    assert dg.durbin_watson(dg.residuals(df, ["x"], "y"), "i").first()[0] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    e2 = e**2 - (e**2).mean()
    r2 = 1 - ((e2 - a @ np.linalg.lstsq(a, e2, rcond=None)[0]) ** 2).sum() / (e2 @ e2)
    assert dg.breusch_pagan(df, ["x"], "y").first()["lm"] == pytest.approx(80 * r2)


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(rng.normal(5, 2, 400))], "key int, g string, y double")
    r = dg.bootstrap(df, "g", "y", 500).first()
    assert r["low"] < r["mean"] < r["high"] and (r["high"] - r["low"]) == pytest.approx(2 * 1.96 * 2 / 20, rel=0.2)
    assert dg.bootstrap(df.repartition(7), "g", "y", 500).first()["low"] == pytest.approx(r["low"])


def test_master_data_checks(spark):
    rows = spark.createDataFrame([(1, "google", "cpc", "x"), (2, "Google ", "organic", "x"), (3, "other", "mail", "x")], "key int, source string, medium string, campaign string")
    m = spark.createDataFrame([("google", "*", "*", "search"), ("google", "cpc", "*", "paid search")], "p_source string, p_medium string, p_campaign string, channel_group string")
    assert {r["key"]: r["channel_group"] for r in dg.mapped_channels(rows, m).collect()} == {1: "paid search", 2: "search", 3: None}


def test_more_gates(spark):
    g, day = checks, date
    t = spark.createDataFrame([("m", day(2020, 1, 1), day(2020, 6, 1)), ("k", day(2020, 1, 1), day(2020, 6, 1))], "metric string, first_day date, last_day date")
    c = spark.createDataFrame([("m", day(2020, 3, 1))], "scope string, change_date date")
    assert [r["metric"] for r in g.crosses_change(t, c).collect()] == ["m"]
    hours = spark.createDataFrame([(1, 9, 21), (2, 18, 2)], "store int, opens int, closes int")
    pos = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2020-01-01 08:00:00'), (1, timestamp_ntz'2020-01-01 20:00:00'), (2, timestamp_ntz'2020-01-01 01:00:00'), (2, timestamp_ntz'2020-01-01 12:00:00') AS t(store, ts)")
    assert g.outside_hours(pos, hours).count() == 2
    assert g.zero_denominators(spark.createDataFrame([(1, 0), (2, None), (3, 4)], "k int, n int"), "k", "n").count() == 2
    assert g.rows_grown(spark.range(2), spark.range(3)).count() == 1 and g.rows_grown(spark.range(2), spark.range(2)).count() == 0
    cards = spark.createDataFrame([(1, day(2010, 1, 1), day(2012, 1, 1), 5), (1, day(2011, 1, 1), day(2030, 1, 1), 0)], "customer int, open_date date, expiry_date date, card_limit int")
    who = spark.createDataFrame([(1, day(2010, 5, 1))], "customer int, first_card date")
    assert sorted(r["fault"] for r in g.card_dates(who, cards, "2012-12-01").collect()) == ["expired", "first card", "no limit"]
    assert g.ambiguous_keys(spark.createDataFrame([("a", "bc"), ("ab", "c"), ("x", "y")], "p string, q string"), ["p", "q"]).count() == 1
    f = spark.createDataFrame([(1, 5, 3, 2, 1), (2, -1, 3, 2, 1), (3, 1, 3, 2, 5)], "c int, r_days int, f_txn int, f_days int, n_intervals int")
    assert g.invariants(f).count() == 2


def test_partial_effect_and_placebo(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=600)
    t = x + rng.normal(size=600)
    y = 2 * t + 3 * x + rng.normal(size=600)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, t, y))], "k int, x double, t double, y double")
    assert dg.double_ml(df, "t", "y", ["x"], "k").first()["effect"] == pytest.approx(2, abs=0.15)
    assert abs(dg.double_ml(df, "t", "y", ["x"], "k", placebo=True).first()["effect"]) < 0.3


def test_concordance_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(1, 30)), int(rng.random() < 0.7), float(i)) for i in range(60)]
    good = total = 0.0
    for a in rows:
        for b in rows:
            if a[1] and b[0] > a[0]:
                total += 1
                good += (a[2] > b[2]) + 0.5 * (a[2] == b[2])
    df = spark.createDataFrame(rows, "t int, e int, r double")
    assert dg.concordance(df, "t", "e", "r").first()["c_index"] == pytest.approx(good / total)


def test_lifetime_fit_ends_with_many_frequencies(spark):
    """More distinct frequencies than cells: the cells widen over them too."""
    rows = spark.range(120).selectExpr("id AS customer", "explode(sequence(0, cast(id as int))) AS i").selectExpr("customer", "date_add(date'2000-01-01', i) AS day", "10.0D AS amount")
    got = clv.predictive(rows, "2001-01-01", 365, cells=40).collect()
    assert len(got) == 120 and all(0 <= r["p_alive"] <= 1 and r["expected_purchases"] >= 0 for r in got)


@pytest.mark.parametrize("per_range", [7, 10**6])
def test_quantiles_over_ranges_are_percentiles(spark, monkeypatch, per_range):
    monkeypatch.setattr(ordered, "PER_RANGE", per_range)
    df = spark.createDataFrame([(None if i % 5 == 4 else "ab"[i % 2], None if i % 11 == 3 else float(i * i % 37) / 3) for i in range(90)] + [("z", None)], "g string, y double")
    at = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.999, 1.0]
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("y", at).alias("q")).collect()}
    assert {r["g"]: r["q"] for r in ordered.quantiles(df, "y", at, ["g"]).collect()} == want and want["z"] is None
    assert ordered.quantiles(df, "y", at).first()["q"] == df.agg(F.percentile("y", at)).first()[0]
    assert ordered.quantiles(df.where("g = 'z'"), "y", at).first()["q"] is None


def test_ks_holds_no_column_in_one_task(spark, monkeypatch):
    df = spark.range(2001).select((F.col("id") * 7919 % 2001).cast("double").alias("y"))
    q = df.agg(F.percentile("y", [i / 1000 for i in range(1, 1000)])).first()[0]
    m, s = np.mean(range(2001)), np.std(range(2001), ddof=1)
    monkeypatch.setattr(F, "percentile", None)
    assert dg.ks_normal(df, "y").first()["distance"] == pytest.approx(max(abs((i + 1) / 1000 - dist.normal_cdf((v - m) / s)) for i, v in enumerate(q)), rel=1e-12)
    assert dg.ks_normal(df.where("y < 0"), "y").first()["distance"] is None and dg.ks_normal(df.where("y = 1"), "y").first()["n"] == 1


@pytest.mark.parametrize("per_partition", [1, 10**6])
def test_overlaps_join_no_members_to_members(spark, monkeypatch, per_partition):
    monkeypatch.setattr(joins, "PAIRS", per_partition)
    rows = [(i % 7, i * i % 11) for i in range(60)] * 2 + [(None, 1), (3, None), (4, None), (6, 99)]
    o = joins.overlaps(spark.createDataFrame(rows, "g long, k long"), "g", "k")
    of = {g: {k for x, k in rows if x == g} for g in range(7)}
    both = {(a, b): len((of[a] & of[b]) - {None}) for a in of for b in of if a < b}
    want = {p: (n, n / (len(of[p[0]]) + len(of[p[1]]) - n)) for p, n in both.items() if n}
    assert {(r["a"], r["b"]): (r["both"], r["jaccard"]) for r in o.collect()} == want
    assert o._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # the two sizes


def test_permutation_takes_many_customers_at_once(spark):
    rows = [(c, (c * 31 + j * j * 17) % 50 + 1, j) for c in range(40) for j in range(1, 3 + c % 6)] + [(90, 0, 1), (90, 0, 2), (91, 7, 1)]
    o = clv.cai_permutation(spark.createDataFrame(rows[::-1], "customer long, gap int, j int"), 200)
    got = {r["customer"]: (r["cai"], r["p_value"]) for r in o.collect()}
    for c in range(40):
        g = np.array([x[1] for x in rows if x[0] == c], float)
        j = np.arange(1, len(g) + 1)
        cai = lambda v: (g.mean() - (v * j).sum(-1) / j.sum()) / g.mean() * 100  # noqa: B023, E731
        null = cai(np.random.default_rng([5, c]).permuted(np.tile(g, (200, 1)), axis=1))
        assert got[c] == (cai(g), (1 + (abs(null) >= abs(cai(g)) - 1e-12).sum()) / 201)
    assert got[90] == (0, 1) and got[91] == (0, 1) and len(got) == 42
    assert "FlatMapGroupsInPandas" not in o._jdf.queryExecution().executedPlan().toString()


def test_importance_orders_rows_twice_whatever_the_columns(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("k"), *[(F.col("id") * m % 97).cast("double").alias(c) for c, m in (("a", 31), ("b", 37), ("c", 41))], (F.col("id") * 31 % 97 > 50).cast("int").alias("y"))
    calls, real = [], ordered.positions
    monkeypatch.setattr(ordered, "positions", lambda *a: calls.append(a) or real(*a))
    got = {r["term"]: r["loss"] for r in dg.permutation_importance(df, ["a", "b", "c"], "y", "k").collect()}
    assert len(calls) == 2 and got["a"] > 0.3 > max(abs(got["b"]), abs(got["c"]))


def test_double_ml_reads_rows_thrice_and_orders_repeated_keys(spark):
    df = spark.range(400).select((F.col("id") % 150).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 97).cast("double").alias("t"), (F.col("id") * 71 % 89).cast("double").alias("y"))
    p = df.selectExpr("k", "x", "t", "y", "xxhash64(3, k) a", "xxhash64(4, k) b", "pmod(xxhash64(7, k), 2) h").toPandas()
    for placebo in (False, True):
        one = p.sort_values(["a", "k", "y", "x"]) if placebo else p
        t = p.sort_values(["b", "k", "t"])["t"].to_numpy() if placebo else p["t"].to_numpy()
        h, y, z = one["h"].to_numpy(), one["y"].to_numpy(), np.stack([np.ones(400), one["x"].to_numpy()], 1)
        res = lambda v: np.where(h == 0, v - z @ np.linalg.lstsq(z[h == 1], v[h == 1], rcond=None)[0], v - z @ np.linalg.lstsq(z[h == 0], v[h == 0], rcond=None)[0])  # noqa: B023, E731
        ry, rt = res(y), res(t)
        effect = (ry * rt).sum() / (rt * rt).sum()
        for n in (1, 7):
            got = dg.double_ml(df.repartition(n), "t", "y", ["x"], "k", placebo=placebo).first()
            assert (got["effect"], got["se"]) == (pytest.approx(effect, rel=1e-9), pytest.approx(np.sqrt(((ry - effect * rt) ** 2 * rt * rt).sum()) / (rt * rt).sum(), rel=1e-9))
