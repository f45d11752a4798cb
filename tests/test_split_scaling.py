import pytest
from pyspark.sql import functions as F

from mmcohort.operators import scaling as S
from mmcohort.operators import split as SP


def test_five_groups_two_in_validation(spark):
    df = spark.createDataFrame([(i, float(j)) for i in range(5) for j in range(3)], "g long, x double")
    a = SP.group_assignments(df, "g")
    got = {r["g"]: r["split"] for r in a.collect()}
    assert sum(v == "val" for v in got.values()) == 2  # ceil(5 * 0.25)
    rows = SP.group_split(df, "g")
    assert rows.count() == 15
    per = rows.groupBy("g").agg(F.countDistinct("split").alias("k")).collect()
    assert all(r["k"] == 1 for r in per)


def test_split_is_partitioning_independent(spark):
    df = spark.range(2000).select((F.col("id") % 377).alias("g"))
    ref = sorted(tuple(r) for r in SP.group_assignments(df, "g").collect())
    for n in (1, 7, 64):
        assert sorted(tuple(r) for r in SP.group_assignments(df.repartition(n), "g").collect()) == ref
    val = sum(1 for _, s in ref if s == "val")
    assert val == 95  # ceil(377 / 4)


def test_zscore_constant_raw_and_moments(spark):
    rows = [([float(i), 5.0],) for i in range(10)]
    df = spark.createDataFrame(rows, "v array<double>")
    st = S.fit_stats(df, ["v"], widths={"v": 2})
    z = S.apply_stats(df, st, ["v"]).collect()
    xs = [r["v"][0] for r in z]
    assert abs(sum(xs)) < 1e-12
    assert abs(sum(x * x for x in xs) - 9.0) < 1e-9  # sample std -> sum of squares n - 1
    assert all(r["v"][1] == 5.0 for r in z)


def test_single_train_row_gives_null(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    st = S.fit_stats(df, ["v"], widths={"v": 2})
    assert S.apply_stats(df, st, ["v"]).first()["v"] == [None, None]


def test_hot_group_does_not_change_the_split(spark):
    # group 0 holds a third of all rows: assignments depend on distinct ids only
    base = spark.range(3000).select((F.col("id") % 200).alias("g"))
    hot = spark.range(1500).select(F.lit(0).cast("long").alias("g"))
    a = sorted(tuple(r) for r in SP.group_assignments(base, "g").collect())
    b = sorted(tuple(r) for r in SP.group_assignments(base.unionByName(hot), "g").collect())
    assert a == b and sum(s == "val" for _, s in a) == 50
    rows = SP.group_split(base.unionByName(hot), "g")
    assert rows.count() == 4500
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "NestedLoopJoin" not in plan  # the study rows are never joined


def test_split_matches_rank_definition(spark):
    from pyspark.sql import Window

    df = spark.range(1000).select(((F.col("id") * 7919) % 613).alias("g"))
    ids = df.distinct().withColumn("h", SP.split_key(F.col("g"), 23))
    rk = ids.withColumn("rn", F.row_number().over(Window.orderBy("h", "g")))
    n = ids.count()
    ref = {r["g"]: ("val" if r["rn"] <= -(-n // 4) else "train") for r in rk.collect()}
    got = {r["g"]: r["split"] for r in SP.group_assignments(df, "g").collect()}
    assert got == ref


def test_fitted_cutoff_equals_lazy_split(spark):
    df = spark.range(5000).select(((F.col("id") * 31) % 977).alias("g"), F.col("id").alias("r"))
    lazy = sorted(tuple(r) for r in SP.group_split(df, "g").select("r", "split").collect())
    cut = SP.fit_split(df, "g")
    assert (cut.n_groups, cut.n_val) == (977, 245)
    fitted = sorted(tuple(r) for r in SP.apply_split(df, "g", cut).select("r", "split").collect())
    assert lazy == fitted
    empty = SP.fit_split(df.limit(0), "g")
    assert empty.cut_h is None and SP.apply_split(df.limit(0), "g", empty).count() == 0


@pytest.mark.parametrize("width", [3, 100])
def test_zscore_narrow_and_wide_paths_match_numpy(spark, width):
    import numpy as np

    rng = np.random.default_rng(width)
    X = rng.normal(3, 2, (40, width))
    X[:, 1] = 7.0  # constant column stays raw
    df = spark.createDataFrame([(r.tolist(),) for r in X], "v array<double>")
    st = S.fit_stats(df, ["v"], widths={"v": width})
    got = np.asarray([r["v"] for r in S.apply_stats(df, st, ["v"]).collect()])
    mu, sd = X.mean(axis=0), X.std(axis=0, ddof=1)
    want = np.where(sd != 0, (X - mu) / np.where(sd != 0, sd, 1), X)
    assert np.allclose(np.sort(got, axis=0), np.sort(want, axis=0), rtol=1e-9, atol=1e-9)


def test_statistics_merge_in_two_levels(spark):
    # partial summaries are merged per group of input partitions (a hash exchange on the group),
    # so no single task receives one buffer per input split
    df = spark.range(5000).select(F.array((F.col("id") % 17).cast("double"), F.sqrt(F.col("id").cast("double"))).alias("v"))
    st = S.fit_stats(df.repartition(64), ["v"], widths={"v": 2}, groups=8)
    row = st.first()
    plan = st._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_g" in plan, plan
    import numpy as np

    x = np.asarray([[i % 17, np.sqrt(i)] for i in range(5000)], dtype=float)
    assert np.allclose(row["v__mean"], x.mean(axis=0), rtol=1e-12)
    assert np.allclose(row["v__std"], x.std(axis=0, ddof=1), rtol=1e-10)
    assert row["n"] == 5000


@pytest.mark.parametrize("width", [63, 64, 65])
def test_one_meaning_at_every_width(spark, width):
    from mmcohort.operators import cohort as K

    full = [float(i % 7) for i in range(width)]
    rows = {"full": full, "long": [*full, 99.0], "short": full[:-1], "null": None, "hole": [None, *full[1:]], "high": [*full[:-1], 99.0], "nan": [float("nan"), *full[1:]]}
    df = spark.createDataFrame([(k, v) for k, v in rows.items()], "k string, n_rad array<double>")
    kept = {r["k"] for r in K.filter_outliers(df, limit=10.0).collect()}
    assert kept == set(rows) - {"long", "high"}
    complete = {r["k"] for r in K.drop_incomplete(df, arrays=["n_rad"]).collect()}
    assert complete == {"full", "long", "short", "high"}
    stats = ([1.0] * width, [2.0] * (width - 1) + [0.0])
    scaled = lambda k: df.where(F.col("k") == k).select(S.scale_column(F.col("n_rad"), *stats).alias("z")).first()["z"]
    assert scaled("full") == [(x - 1) / 2 for x in full[:-1]] + [full[-1]]
    assert scaled("null") is None and scaled("hole")[0] is None and len(scaled("hole")) == width
    for k in ("long", "short"):
        with pytest.raises(Exception, match=f"array of {width} elements"):
            scaled(k)
        with pytest.raises(Exception, match=f"array of {width} elements"):
            S.fit_stats(df.where(F.col("k") == k), ["n_rad"], {"n_rad": width}).collect()


def test_statistics_skip_missing_elements(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(5, 3, (60, 5))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 3] = np.nan
    x[:, 4] = np.nan
    x[7, 4] = 2.0
    rows = [([None if np.isnan(v) and i % 2 else float(v) for v in r],) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(7)
    st = S.fit_stats(df, ["v"], {"v": 5}, skip_missing=True)
    row = st.first()
    assert np.allclose(row["v__mean"][:3], np.nanmean(x[:, :3], 0)) and row["v__mean"][3] is None and row["v__mean"][4] == 2.0
    assert np.allclose(row["v__std"][:3], np.nanstd(x[:, :3], 0, ddof=1)) and row["v__std"][3:] == [None, None] and row["n"] == 60
    z = S.apply_stats(df, st, ["v"]).collect()
    assert all(r["v"][3] is None and r["v"][4] is None for r in z)
    for skip in (True, False):
        empty = S.fit_stats(df.where("false"), ["v"], {"v": 5}, skip_missing=skip)
        assert empty.first() is None and S.apply_stats(df, empty, ["v"]).first()["v"] == [None] * 5


def numbered(df, rows_in_block=3):
    """The position a reader adds: file, block of the file, row."""
    r = F.col("r")
    return df.withColumn("pos", F.struct(
        F.concat(F.lit("f"), F.floor(r / 50).cast("string")).alias("file"), F.floor(r % 50 / rows_in_block).cast("long").alias("block"), (r % 50).alias("row")
    ))


def test_source_members_are_the_permutation_of_ids_by_first_appearance(spark):
    import numpy as np

    ids = [(i * 7919) % 61 + 100 for i in range(200)]
    ids[5] = None
    df = numbered(spark.createDataFrame([(i, g) for i, g in enumerate(ids)], "r long, g long"))
    seen = list(dict.fromkeys(g for g in ids if g is not None))
    val = {seen[j] for j in np.random.RandomState(23).permutation(len(seen))[: -(-len(seen) // 4)]}
    want = sorted((i, "val" if g in val else "train") for i, g in enumerate(ids) if g is not None)
    ranks = {r["_id"]: r["_rank"] for r in SP.first_seen(df, "g", "pos").collect()}
    assert ranks == {g: i for i, g in enumerate(seen)}
    for n in (1, 9):
        members = SP.fit_split(df.repartition(n), "g", members="source", position="pos")
        assert (members.n_groups, members.n_val) == (len(seen), -(-len(seen) // 4))
        assert sorted((r["r"], r["split"]) for r in SP.apply_split(df, "g", members).collect()) == want


def test_source_members_beyond_the_bounds(spark, monkeypatch):
    df = numbered(spark.range(150).select(F.col("id").alias("r"), (F.col("id") % 40).alias("g")))
    small = sorted(map(tuple, SP.apply_split(df, "g", SP.fit_split(df, "g", members="source", position="pos")).select("r", "split").collect()))
    monkeypatch.setattr(SP, "BROADCAST_IDS", 3)
    wide = SP.apply_split(df, "g", SP.fit_split(df, "g", members="source", position="pos"))
    assert sorted(map(tuple, wide.select("r", "split").collect())) == small
    monkeypatch.setattr(SP, "MAX_SOURCE_GROUPS", 30)
    with pytest.raises(ValueError, match="members='hash'"):
        SP.fit_split(df, "g", members="source", position="pos")
    with pytest.raises(ValueError, match="position"):
        SP.fit_split(df, "g", members="source")
    empty = SP.fit_split(df.limit(0), "g", members="source", position="pos")
    assert empty.n_groups == 0 and SP.apply_split(df.limit(0), "g", empty).count() == 0


def test_scaling_keeps_the_element_type(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 5.0],)], "v array<float>")
    st = S.fit_stats(df, ["v"], {"v": 2})
    assert dict(S.apply_stats(df, st, ["v"]).dtypes)["v"] == "array<float>"
    assert dict(S.apply_stats(df.select(F.col("v").cast("array<double>").alias("v")), st, ["v"]).dtypes)["v"] == "array<double>"
