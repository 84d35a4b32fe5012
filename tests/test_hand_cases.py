"""Hand-computed micro cases (FIXTURES.md §3) and properties."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import fairness, metrics, panel, prompts, sequences, splits, vectors
from cohortlab.functions.exprs import py_float_text


def test_locf_leading_and_carry(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, None, 3.0, None, 5.0])] +
                               [(2, i, None) for i in range(3)], "id int, t int, x double")
    stats = spark.createDataFrame([(-0.2,)], "x__fill double")
    out = panel.locf_impute(df, "id", "t", ["x"], stats).orderBy("id", "t").collect()
    assert [r.x for r in out if r.id == 1] == [-0.2, -0.2, 3.0, 3.0, 5.0]
    assert [r.x for r in out if r.id == 2] == [-0.2, -0.2, -0.2]


def test_trim_is_strict_and_cellwise(spark):
    vals = [float(v) for v in range(1, 21)]
    df = spark.createDataFrame([(v, None if v == 10 else v) for v in vals], "a double, b double")
    s = panel.trimmed_stats(df, ["a", "b"]).first()
    lo, hi = 1 + 0.05 * 19, 1 + 0.95 * 19  # linear quantiles of 1..20
    kept = [v for v in vals if lo < v < hi]
    assert s["a__mean"] == pytest.approx(sum(kept) / len(kept))
    assert 1.0 not in kept and 20.0 not in kept


def test_quantile_boundary_excluded(spark):
    # 5% / 95% quantiles of 0..20 are exactly 1 and 19: both excluded
    df = spark.createDataFrame([(float(v),) for v in range(21)], "a double")
    s = panel.trimmed_stats(df, ["a"]).first()
    assert s["a__mean"] == pytest.approx(sum(range(2, 19)) / 17)


def test_wide_quantiles_paths_agree_with_numpy(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=3000), rng.integers(0, 6, 3000).astype(float)
    df = spark.createDataFrame([(float(x), None if i % 3 else float(y), None) for i, (x, y) in enumerate(zip(a, b))],
                               "a double, b double, c double").repartition(7)
    probs = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    want = {"a": np.quantile(a, probs), "b": np.quantile(b[::3], probs)}
    for limit in (10 ** 6, 0):
        monkeypatch.setattr(panel, "MAP_QUANTILE_LIMIT", limit)
        got = panel.wide_quantiles(df, ["a", "b", "c"], probs)
        assert got["c"] == [None] * 6
        for c in "ab":
            assert got[c] == pytest.approx(list(want[c]), abs=1e-12)


def test_auroc_ties_half(spark):
    df = spark.createDataFrame([("r", 0.5, 0), ("r", 0.5, 1)], "run string, pred double, label int")
    m = metrics.binary_metrics(df, ["run"]).first()
    assert m.auroc == pytest.approx(0.5)


def test_threshold_strict(spark):
    df = spark.createDataFrame([("r", 0.5, 1), ("r", 0.7, 1)], "run string, pred double, label int")
    m = metrics.confusion_metrics(df, ["run"]).first()
    assert m.recall == pytest.approx(0.5)  # 0.5 is a negative prediction


def test_auroc_complement_property(spark):
    rows = [("r", (i * 37 % 101) / 100, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame([(r, p, int(y)) for r, p, y in rows], "run string, pred double, label int")
    a = metrics.binary_metrics(df, ["run"]).first().auroc
    b = metrics.binary_metrics(df.withColumn("pred", 1 - F.col("pred")), ["run"]).first().auroc
    assert a + b == pytest.approx(1.0)


def test_fairness_zero_rate_group(spark):
    rows = [(0.9, 1, 0), (0.1, 0, 0), (0.9, 0, 0), (0.2, 1, 1), (0.3, 0, 1)]
    df = spark.createDataFrame([("r",) + r for r in rows], "run string, pred double, label int, attr int")
    m = fairness.fairness_metrics(df, ["run"], "attr").first()
    r0 = 2 / 3
    assert m.DI == pytest.approx(0.0, abs=1e-9)
    assert m.SPD == pytest.approx(-r0, abs=1e-6)


def test_fairness_sign_flip(spark):
    rows = [(0.9, 1, 0), (0.1, 0, 0), (0.9, 0, 1), (0.6, 1, 1), (0.3, 0, 1)]
    df = spark.createDataFrame([("r",) + r for r in rows], "run string, pred double, label int, attr int")
    a = fairness.fairness_metrics(df, ["run"], "attr").first()
    b = fairness.fairness_metrics(df.withColumn("attr", 1 - F.col("attr")), ["run"], "attr").first()
    assert a.SPD == pytest.approx(-b.SPD, abs=1e-6)
    assert a.EOD == pytest.approx(-b.EOD, abs=1e-6)


@pytest.mark.parametrize("a,b,d98,d101", [("A000", "A001", 2, 2), ("A000", "A100", 6, 4), ("A00", "A10", 4, 2)])
def test_code_distances(spark, a, b, d98, d101):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(vectors.code_distance(F.col("a"), F.col("b")).alias("d98"),
                  vectors.tree_distance(F.col("a"), F.col("b")).alias("d101")).first()
    assert (r.d98, r.d101) == (d98, d101)


def test_cluster_distance_rewrite_equals_pairs(spark):
    import itertools
    codes = [("c1", x) for x in ["A000", "A001", "A1", "B12", "A000", "B1234"]] + [("c2", "Z99")]
    df = spark.createDataFrame(codes, "cluster string, code string")
    got = {r.cluster: r.mean_distance for r in vectors.cluster_code_distance(df, ["cluster"], "code").collect()}

    def dist(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return len(a) + len(b) - 2 * n
    c1 = [c for k, c in codes if k == "c1"]
    pairs = [dist(a, b) for a, b in itertools.combinations(c1, 2)]
    assert got["c1"] == pytest.approx(sum(pairs) / len(pairs))
    assert got["c2"] == 0.0


def test_kendall_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    xs = [rnd.randint(0, 6) for _ in range(120)]
    ys = [rnd.randint(0, 4) + (x // 2) for x in xs]
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(xs, ys)], "g string, x double, y double")
    got = vectors.kendall_tau_b(df, ["g"], "x", "y").first().kendall_corr
    n = len(xs)
    n1 = sum(xs[i] == xs[j] for i in range(n) for j in range(i + 1, n))
    n2 = sum(ys[i] == ys[j] for i in range(n) for j in range(i + 1, n))
    s = sum(((xs[i] > xs[j]) - (xs[i] < xs[j])) * ((ys[i] > ys[j]) - (ys[i] < ys[j]))
            for i in range(n) for j in range(i + 1, n))
    n0 = n * (n - 1) / 2
    tau = s / math.sqrt((n0 - n1) * (n0 - n2))
    assert got == pytest.approx(round(tau, 2))


def test_splits_disjoint_and_sized(spark):
    cohort = spark.range(1000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    sp = splits.assign_splits(cohort, test_n=200, cap=10000, val_frac=1 / 8)
    sizes = {r.split: r.c for r in sp.groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert sizes["test"] == 200
    assert sizes["val"] == math.ceil(800 / 8)
    assert splits.leakage_check(sp).count() == 0
    pos = sp.where("split = 'test' and label = 1").count()
    assert abs(pos - 200 * 143 / 1000) < 1  # stratified


def test_few_shot_caps(spark):
    cohort = spark.range(300).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    sp = splits.assign_splits(cohort, test_n=50)
    few = splits.few_shot(sp, 5)
    counts = few.where("split <> 'test'").groupBy("split", "label").count().collect()
    assert all(r["count"] == 5 for r in counts)
    assert few.where("split = 'test'").count() == 50


def test_parse_response_cases(spark):
    rows = [(0, '{"think": "t", "answer": 0.42}'), (1, '```json {"think": "t", "answer": 0.3} ```'),
            (2, '[{"think": "a", "answer": 0.1}, {"think": "b", "answer": 0.9}]'), (3, "I do not know"),
            (4, '{"think": "t", "answer": "high"}')]
    out = {r.id: r for r in prompts.parse_response(spark.createDataFrame(rows, "id int, response string")).collect()}
    assert out[0].pred == 0.42 and out[1].pred == 0.3 and out[2].pred == 0.9 and out[2].think == "b"
    assert out[3].status == "failed" and out[3].pred is None
    assert out[4].pred == -1.0


def test_multiclass_golden(spark):
    rows = [([.1, .2, .7], 2), ([.3, .4, .3], 0), ([.5, .1, .4], 1)]
    df = spark.createDataFrame(rows, "scores array<double>, label int")
    m = metrics.multiclass_metrics(df, []).first()
    assert m.accuracy == pytest.approx(1 / 3)


def test_py_float_text(spark):
    vals = [0.01, 16.055, 88.0, 1e-4, 1e7, -2.5e-4, 1.5e-7, 1e16, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(py_float_text("x")).collect()] == [repr(v) for v in vals]


def test_pad_and_mask(spark):
    df = spark.createDataFrame([(1, 0, [[1.0, 2.0]]), (2, 0, [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]])],
                               "id int, batch int, x array<array<double>>")
    p = sequences.pad_sequences(df, "batch", "x", 2).orderBy("id").collect()
    assert p[0].padded == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]] and p[0].length == 1
    m = df.select(sequences.length_mask(F.size("x"), F.lit(3)).alias("m")).orderBy(F.size("m")).first().m
    assert m in ([True, False, False], [True, True, True])


def test_bootstrap_poisson_weights_mean_one(spark):
    df = spark.range(20000).select(F.col("id"))
    w = metrics.bootstrap_weights(df, "id", resamples=1)
    mean = w.agg(F.sum("w")).first()[0] / 20000
    assert mean == pytest.approx(1.0, abs=0.03)


def test_ordered_cumsum_paths_agree(spark):
    from cohortlab.functions.ordered import ordered_cumsum
    agg = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * F.col("id") / 7.0).alias("v"),
                                   F.lit(1).alias("m"))
    a = ordered_cumsum(agg, ["g"], "v", ["m"], descending=True).orderBy("g", "v").collect()
    b = ordered_cumsum(agg, ["g"], "v", ["m"], descending=True, small_group_rows=10).orderBy("g", "v").collect()
    c = ordered_cumsum(agg, ["g"], "v", ["m"], descending=True, small_group_rows=10,
                       skew_cell_rows=10).orderBy("g", "v").collect()
    assert a == b == c
    assert a[0].m_cum == 1000  # smallest value of group 0 sees the whole group in descending order


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from cohortlab.functions.ordered import exact_quantiles
    rnd = np.random.default_rng(3)
    vals = np.concatenate([rnd.normal(size=5000), np.full(2000, 0.25)])
    df = spark.createDataFrame([("k", float(v)) for v in vals], "k string, v double")
    want = np.quantile(vals, [0.05, 0.5, 0.95])
    for limit in (10, 10 ** 9):  # bracketed path and bounded-map path
        got = exact_quantiles(df, ["k"], "v", [0.05, 0.5, 0.95], map_limit=limit).first()
        assert [got.q0, got.q1, got.q2] == pytest.approx(list(want), abs=1e-12)


def test_splits_keep_null_labels_and_many_strata(spark):
    cohort = spark.range(1003).select("id", F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("int")).alias("label"))
    sp = splits.assign_splits(cohort, test_n=100)
    assert sp.count() == 1003 and sp.select("id").distinct().count() == 1003
    sizes = {(r.split, r.label): r["count"] for r in sp.groupBy("split", "label").count().collect()}
    assert sizes[("test", None)] == 20 and sum(n for (s, _), n in sizes.items() if s == "test") == 100
    many = spark.range(40_000).select("id", (F.col("id") % 20_000).alias("label"))
    held = splits.stratified_holdout(many, 30_000).where("in_test").groupBy("label").count()
    assert {r["count"]: r.n for r in held.groupBy("count").agg(F.count("*").alias("n")).collect()} == {1: 10_000, 2: 10_000}
    assert splits.stratified_holdout(cohort.limit(0), 10).count() == 0


def test_assign_splits_has_no_hidden_cap(spark):
    cohort = spark.range(11_000).select("id", (F.col("id") % 2).alias("label"))
    assert splits.assign_splits(cohort).count() == 11_000
    assert splits.assign_splits(cohort, cap=1000).count() == 1200


def test_running_sums_keep_null_groups(spark):
    from cohortlab.functions.ordered import average_rank, exact_quantiles, ordered_cumsum
    df = spark.createDataFrame([(g, float(i), 1) for g in (None, "a") for i in range(51)], "g string, v double, n int")
    paths = [dict(), dict(small_group_rows=0), dict(small_group_rows=0, skew_cell_rows=0)]
    out = [sorted(((r.g or "", r.v, r.n_cum) for r in ordered_cumsum(df, ["g"], "v", ["n"], **p).collect())) for p in paths]
    assert len(out[0]) == 102 and out[0] == out[1] == out[2]
    assert average_rank(df, ["g"], "v").count() == 102
    for limit in (10 ** 6, 0):
        got = {r.g: r.q0 for r in exact_quantiles(df, ["g"], "v", [0.5], map_limit=limit).collect()}
        assert got == {None: 25.0, "a": 25.0}


def test_r2_of_constant_labels(spark):
    rows = [("off", 1.0, 5.0), ("off", 9.0, 5.0), ("hit", 5.0, 5.0), ("hit", 5.0, 5.0), ("some", 1.0, 1.0), ("some", 2.0, 3.0)]
    out = {r.run: r.r2 for r in metrics.regression_metrics(spark.createDataFrame(rows, "run string, pred double, label double"), ["run"]).collect()}
    assert out["off"] == 0.0 and out["hit"] == 1.0 and out["some"] == pytest.approx(0.5)


def test_spearman_drops_incomplete_pairs(spark):
    rows = [(1.0, 2.0), (2.0, 3.0), (3.0, 1.0), (9.0, None), (0.0, None)]
    out = vectors.spearman(spark.createDataFrame([("g", *r) for r in rows], "g string, x double, y double"), ["g"], "x", "y").first()
    assert out.spearman_corr == -0.5


def test_nan_prediction_gets_the_default(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    res = spark.createDataFrame([(1, float("nan")), (2, 0.25)], "id int, pred double")
    assert {r.id: r.pred for r in fairness.join_preds_default(ids, res).collect()} == {1: 0.501, 2: 0.25, 3: 0.501}


def test_replies_in_prose_and_broken_fences(spark):
    body = '{"think": "t", "answer": 0.7}'
    rows = [f"Here is my assessment [1].\n{body}", f"```json\n{body}", f"<think>so {{maybe}}</think>{body}", f"{body} or rather " + body.replace("0.7", "0.8"),
            '{"think": "a ```fence``` here", "answer": 0.7} Bye.', f"Both: [{body.replace('0.7', '0.1')}, {body}]", '{"think": "t", "answer": "NaN"}',
            '{"think": "t"}', "{broken", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, response string")
    out = [r for r in prompts.parse_response(df).orderBy("id").collect()]
    assert [r.pred for r in out[:6]] == [0.7, 0.7, 0.7, 0.8, 0.7, 0.7]
    assert math.isnan(out[6].pred) and [r.status for r in out[7:]] == ["failed"] * 3


def test_feature_texts_by_lookup(spark):
    look = prompts.feature_lookup(spark.createDataFrame([("a", "mg", "1 - 2"), ("b", "/", "/"), ("c", None, "x")], "feature string, unit string, range string"))
    df = spark.createDataFrame([([(1.0, 2.5, None), (None, 3.0, 4.0)],)], "visits array<struct<a:double,b:double,c:double>>").crossJoin(look)
    args = (F.col("visits"), ["a", "b", "c"])
    r = df.select(prompts.format_features_list(*args).alias("l0"), prompts.format_features_list(*args, F.col("units"), F.col("ranges")).alias("l1"),
                  prompts.format_features_text(*args, F.col("units"), F.col("ranges")).alias("t")).first()
    assert r.l0.split("\n")[0] == "- a: [1.0, NaN]"
    assert r.l1.split("\n") == ["- a (Unit: mg. Reference Range: 1 - 2.): [1.0, NaN]", "- b (Unit: /. Reference Range: /.): [2.5, 3.0]",
                                "- c (Reference Range: x.): [NaN, 4.0]"]
    assert r.t == ("The feature `a` has 2 visits of values 1.0 mg and NaN mg, with a reference range of 1 - 2. "
                   "The feature `b` has 2 visits of values 2.5 and 3.0. The feature `c` has 2 visits of values NaN and 4.0, with a reference range of x.")


def test_overlong_fixed_width_fields_fail(spark, tmp_path):
    from cohortlab.sources import io
    ok = spark.createDataFrame([(1, "AB", "t"), (123456, "C", "u")], "o int, c string, t string")
    io.write_fixed_width(ok, str(tmp_path / "ok"), "o", "c", "t")
    assert {r.code for r in io.read_fixed_width(spark, str(tmp_path / "ok")).collect()} == {"AB", "C"}
    for bad in ((1234567, "AB", "t"), (1, "ABCDEFGHIJ", "t")):
        with pytest.raises(Exception, match="too long"):
            io.write_fixed_width(spark.createDataFrame([bad], "o int, c string, t string"), str(tmp_path / "bad"), "o", "c", "t")


def test_late_and_repeated_deliveries(spark, tmp_path):
    from cohortlab.streaming.ingest import ingest_available
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    reply = '{"think": "t", "answer": 0.5}'
    deliveries = [[(1, "01"), (2, "01")], [(1, "09"), (3, "09")], [(4, "02"), (2, "02")], [(6, "03"), (6, "04"), (3, "00")]]
    for i, rows in enumerate(deliveries):
        df = spark.createDataFrame([("r", k, reply, f"2024-01-01 {h}:00:00") for k, h in rows], "run string, id long, response string, t string")
        df.select("run", "id", "response", F.col("t").cast("timestamp").alias("received_at")).coalesce(1).write.mode("append").json(src)
        if i % 2:
            out = ingest_available(spark, src, sink, ckpt, max_files_per_trigger=1)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 6]


def test_fill_down_carries_over_levels(spark, monkeypatch):
    from cohortlab.operators import cleaning
    monkeypatch.setattr(cleaning, "MAX_CARRY_ROWS", 3)
    rows = [(i * 5, i if i in (2, 700, 5000) else None) for i in range(8000)]
    out = cleaning.fill_id_down(spark.createDataFrame(rows, "o long, v long"), "o", "v", "id", block_size=4)
    got = {r.o: r.id for r in out.collect()}
    assert all(got[i * 5] == (None if i < 2 else 2 if i < 700 else 700 if i < 5000 else 5000) for i in range(8000))


def test_checkpoint_folder_is_asked_for_off_local():
    from cohortlab import session

    class Conf:
        def get(self, *_):
            return None

    class Sc:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(type("S", (), {"sparkContext": Sc()})())


def test_fill_id_down_across_blocks(spark):
    from cohortlab.operators import cleaning
    rows = [(i, (i // 10) if i % 10 == 0 else None) for i in range(1, 95)]  # ids every 10 rows, first row empty
    df = spark.createDataFrame(rows, "src_row long, id_sparse long")
    want = {}
    last = None
    for i, v in rows:
        last = v if v is not None else last
        want[i] = last
    for block in (7, 1 << 20):  # many small ranges (carry path) and one range
        got = {r.src_row: r.id for r in cleaning.fill_id_down(df, "src_row", "id_sparse", "id", block).collect()}
        assert got == want


def test_locf_bucket_width_does_not_change_result(spark):
    import random
    rnd = random.Random(5)
    rows = [(p, t, None if rnd.random() < 0.6 else float(rnd.randint(0, 9))) for p in range(4) for t in range(60)]
    df = spark.createDataFrame(rows, "id int, t int, x double")
    ref = {(r.id, r.t): r.x for r in panel.locf_impute(df, "id", "t", ["x"], bucket_width=1000).collect()}
    for width in (1, 3, 7):
        got = {(r.id, r.t): r.x for r in panel.locf_impute(df, "id", "t", ["x"], bucket_width=width).collect()}
        assert got == ref
    # brute force
    for p in range(4):
        last = -1.0
        for t in range(60):
            v = dict(((a, b), c) for a, b, c in rows)[(p, t)]
            last = v if v is not None else last
            assert ref[(p, t)] == last
