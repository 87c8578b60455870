"""Order-dependent, imputation and profiling operators against plain computation."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from vitrine.operators import forests, impute, keyed, neighbours, ordered, placed, profile


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, two thirds of them in one group, many equal values."""
    draw = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}" if i % 5 else None, draw.randint(0, 40), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, v int, id int")


def by_group(rows):
    out = {}
    for g, v, i in rows:
        out.setdefault(g, []).append((v, i))
    return {g: sorted(x) for g, x in out.items()}


@pytest.mark.parametrize("how", ["durable", "placed", "one part", "many parts"])
def test_numbering_is_dense_per_group(skewed, how):
    rows, df = skewed
    parts = {"one part": 1, "many parts": 64}.get(how)
    out = ordered.numbered(df, [F.col("v"), F.col("id")], ["g"], "no", "of") if how == "durable" else placed.numbered(df, ["v", "id"], ["g"], "no", "of", parts)
    got = {r["id"]: (r["no"], r["of"]) for r in out.collect()}
    for members in by_group(rows).values():
        for place, (_, i) in enumerate(members, 1):
            assert got[i] == (place, len(members))


def test_global_numbering_with_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 500 + [(0,)] * 3, "v int")
    for out in (ordered.numbered(df, [F.col("v")]), placed.numbered(df, ["v"])):
        numbers = sorted((r["row_no"], r["v"]) for r in out.collect())
        assert [n for n, _ in numbers] == list(range(1, 504)) and [v for _, v in numbers[:4]] == [0, 0, 0, 1]


def test_running_totals(skewed):
    rows, df = skewed
    got = {r["id"]: (r["run"], r["all"]) for r in placed.running_totals(df, {"v": "run"}, [("v", "desc"), "id"], ["g"], totals_as={"v": "all"}).collect()}
    for members in by_group(rows).values():
        total, so_far = sum(v for v, _ in members), 0
        for v, i in sorted(members, key=lambda m: (-m[0], m[1])):
            so_far += v
            assert got[i] == (so_far, total)


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "decimal(12,2)", "double", "boolean", "bigint", "binary"])
def test_every_type_in_both_directions(spark, kind):
    """Against Spark's own order, NULLs and prefixes included."""
    from pyspark.sql import Window

    values = {"string": "concat(repeat('ab', id % 3), char(97 + id % 5), if(id % 4 = 0, 'é', ''))", "date": "date_add(DATE'1960-01-01', cast(id * 97 % 30000 as int))",
              "timestamp": "timestamp_micros(id * 7919 - 100000)", "decimal(12,2)": "(id * 37 % 101) / 4 - 10", "double": "sin(id)", "boolean": "id % 2 = 0",
              "bigint": "if(id = 7, -9223372036854775808, id * 31 % 53)", "binary": "cast(concat('x', id % 9) as binary)"}
    df = spark.range(200).withColumn("v", F.when(F.col("id") % 11 != 0, F.expr(values[kind]).cast(kind)))
    for way, order in (("asc", F.col("v").asc()), ("desc", F.col("v").desc())):
        want = df.withColumn("want", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order, "id")))
        got = placed.numbered(want, [("v", way), "id"], parts=16)
        assert got.filter("want <> row_no").count() == 0
    with pytest.raises(ValueError):
        placed.numbered(df, [("v", "up")])


def test_placing_writes_nothing_and_spreads_a_hot_group(skewed, tmp_path):
    _, df = skewed
    out = placed.numbered(df, ["v", "id"], ["g"], parts=16)
    plan = out._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan.replace("LogicalRDD", "").split("Physical")[0] and "Checkpoint" not in plan
    joined, _ = placed._in_parts(df, ["v", "id"], ["g"], (), 16)
    sizes = [r["count"] for r in joined.filter("g = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) > 6 and max(sizes) < 700


def test_placing_no_rows(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert placed.numbered(df, ["v"], ["g"]).count() == 0 and placed.running_totals(df, {"v": "s"}, ["v"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 11])
def test_tiles_match_ntile(spark, n):
    from pyspark.sql import Window

    df = spark.range(n).withColumn("want", F.ntile(4).over(Window.partitionBy(F.lit(1)).orderBy("id")))
    assert placed.tiled(df, 4, ["id"]).filter("want <> tile").count() == 0


def test_quantiles_match_percentile(skewed):
    _, df = skewed
    got = ordered.exact_quantiles(df, ["v"], (0.1, 0.25, 0.5), ["g"])
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(f"w{round(p * 100)}") for p in (0.1, 0.25, 0.5)])
    both = got.join(want, got["g"].eqNullSafe(want["g"]))
    assert both.count() == want.count()
    assert both.filter("abs(p10 - w10) > 1e-9 or abs(p25 - w25) > 1e-9 or abs(p50 - w50) > 1e-9").count() == 0


def test_histogram_holds_every_value(skewed):
    rows, df = skewed
    bins = profile.histogram(df, "v", 10).orderBy("bin").collect()
    assert len(bins) == 10 and sum(b["n"] for b in bins) == len(rows) and bins[-1]["to_value"] == 40


def test_constant_histogram_and_quantiles(spark):
    df = spark.createDataFrame([(5.0,)] * 9 + [(None,)], "v double")
    assert [b["n"] for b in profile.histogram(df, "v", 3).orderBy("bin").collect()] == [9, 0, 0]
    assert ordered.exact_quantiles(df, ["v"], (0.25,)).first()["p25"] == 5.0


def test_quantiles_of_awkward_values(spark):
    """Far outliers, infinities, ties, tiny and huge ranges, NULL groups; nothing is written."""
    draw = random.Random(11)
    series = {"flat": [7.0] * 50, "far": [*[draw.random() for _ in range(400)], 1e300, -1e300], "ends": [float("-inf"), float("inf"), 1.0, 2.0], "one": [3.5], None: [0.0, -0.0, 5e-324],
              "close": [1.0 + i * 2**-52 for i in range(300)], "steps": [float(draw.choice([1, 2, 2, 3, 1e9])) for _ in range(999)]}
    df = spark.createDataFrame([(g, v, -v) for g, vs in series.items() for v in vs] + [("far", None, None)], "g string, v double, w double").repartition(5)
    out = ordered.exact_quantiles(df, ["v", "w"], (0.0, 0.25, 0.5, 0.99, 1.0), ["g"])
    assert "Sort" not in [x.split()[0] for x in out._jdf.queryExecution().optimizedPlan().toString().replace(":", " ").replace("+-", " ").splitlines() if x.split()]
    got = {(r["g"], r["column_name"]): r for r in out.collect()}
    assert len(got) == 2 * len(series)
    for g, vs in series.items():
        for name, sign in (("v", 1), ("w", -1)):
            xs = sorted(sign * v for v in vs)
            for p in (0.0, 0.25, 0.5, 0.99, 1.0):
                at = (len(xs) - 1) * p
                lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
                want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
                assert got[g, name][f"p{round(p * 100)}"] == want or math.isnan(want), (g, name, p)


def test_moving_average_waits_for_full_window(spark):
    out = keyed.moving_average(spark.createDataFrame([(i, float(i)) for i in range(10)], "d int, v double"), "d", "v", 7).orderBy("d").collect()
    assert [r["moving_avg"] for r in out[:6]] == [None] * 6 and out[6]["moving_avg"] == 3.0


def _sklearn_style(rows, features, target, k):
    """Brute-force nearest-neighbour fill of one target."""
    ti, out = features.index(target), {}
    donors = [r for r in rows if r[1][ti] is not None]
    for rid, q in rows:
        if q[ti] is not None:
            continue
        scored = []
        for _, d in donors:
            shared = [(a - b) ** 2 for a, b in zip(q, d) if a is not None and b is not None]
            if shared:
                scored.append((round(math.sqrt(sum(shared) * len(features) / len(shared)), 12), d[ti]))
        best = sorted(scored)[:k]
        zero = [v for dist, v in best if dist == 0]
        out[rid] = sum(zero) / len(zero) if zero else sum(v / dist for dist, v in best) / sum(1 / dist for dist, _ in best)
    return out


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True)])
def test_knn_is_exact(spark, seed, hot):
    draw = random.Random(seed)
    features, rows = ["a", "b", "c", "t"], []
    for i in range(400):
        a, b = (0.25, 0.5) if hot and i % 3 else (draw.random(), draw.random())
        rows.append((i, [a, b, draw.choice([None, round(draw.random(), 2)]), None if i % 6 == 0 else round(draw.random(), 2)]))
    df = spark.createDataFrame([(i, *[None if v is None else float(v) for v in f]) for i, f in rows], "id int, a double, b double, c double, t double")
    got = {r["id"]: r["t"] for r in impute.knn_filled(df, features, "t", 5).collect()}
    want = _sklearn_style(rows, features, "t", 5)
    assert len(got) == 400
    for i, value in want.items():
        assert got[i] == pytest.approx(value, abs=1e-9)
    assert all(got[i] == f[3] for i, f in rows if f[3] is not None)


def test_forest_fills_gaps_only(spark):
    draw = random.Random(5)
    df = spark.createDataFrame([(i, float(i % 10), None if i % 9 == 0 else (i % 10) * 2.0 + draw.random()) for i in range(300)], "id int, x double, y double")
    out = {r["id"]: r["y"] for r in impute.forest_filled(df, ["x", "y"], rounds=2, trees=5).collect()}
    assert all(v is not None for v in out.values())
    assert all(out[r["id"]] == r["y"] for r in df.collect() if r["y"] is not None)
    assert abs(out[9] - 18.5) < 2.0


def _uneven(n, seed, width=4):
    draw = random.Random(seed)
    rows = [[draw.random() for _ in range(width)] for _ in range(n)]
    return [(i, *x, 10 * x[0] * x[1] + 3 * (x[2] > 0.4) + draw.random() / 5) for i, x in enumerate(rows)], ["id", *[f"x{j}" for j in range(width)], "y"]


def test_forest_needs_no_job_a_level(spark):
    """Deep trees are grown inside tasks; a job for every level and a model on the driver took minutes over a few thousand rows."""
    rows, names = _uneven(1500, 3)
    df = spark.createDataFrame([(*r[:-1], None if r[0] % 7 == 0 else r[-1]) for r in rows], names)
    spark.sparkContext.setJobGroup("deep forest", "")
    try:
        got = {r["id"]: r["y"] for r in impute.forest_filled(df, names[1:], rounds=3).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep forest"))
    assert len(got) == 1500 and jobs < 60, jobs


def test_forest_is_as_good_as_the_library(spark):
    rows, names = _uneven(1600, 8)
    df = spark.createDataFrame(rows, names)
    known, asked = impute.durable(df.filter("id % 4 > 0")), df.filter("id % 4 = 0")
    guess, cells = forests.predicted(known, asked, names[1:-1], "y", 1200, 20, 30, 42, 3.0, 2.0)
    mine = {r["id"]: r["_guess"] for r in asked.withColumns(cells).join(guess, list(cells)).collect()}
    put = VectorAssembler(inputCols=names[1:-1], outputCol="f")
    fitted = RandomForestRegressor(featuresCol="f", labelCol="y", numTrees=20, maxDepth=30, seed=42).fit(put.transform(known))
    theirs = {r["id"]: r["prediction"] for r in fitted.transform(put.transform(asked)).collect()}
    error = lambda said: math.sqrt(sum((said[r[0]] - r[-1]) ** 2 for r in rows if r[0] % 4 == 0) / 400)
    assert set(mine) == set(theirs) == set(range(0, 1600, 4))
    assert error(mine) < 1.1 * error(theirs)
    assert max(abs(mine[i] - theirs[i]) for i in mine) < 3


@pytest.mark.parametrize("width", [4, 14])
def test_first_levels_over_all_rows_change_nothing(spark, monkeypatch, width):
    """Nodes too large for one task are divided over all rows; a node that no cut divides stays whole."""
    rows, names = _uneven(900, 4, width)
    rows = [(*r[:-1], 7.0 if r[1] < 0.3 else r[-1]) for r in rows]
    df = spark.createDataFrame([(*r[:-1], None if r[0] % 5 == 0 else r[-1]) for r in rows], names)
    said = []
    for cells in (forests.CELLS, 40):
        monkeypatch.setattr(forests, "CELLS", cells)
        said.append({r["id"]: r["y"] for r in impute.forest_filled(df, names[1:], rounds=1, trees=3).collect()})
    assert len(said[1]) == 900
    for i, value in said[0].items():
        assert said[1][i] == pytest.approx(value, abs=1e-6), i


def test_forest_with_gaps_everywhere(spark):
    draw = random.Random(6)
    rows = [(None if draw.random() < 0.2 else float(i % 9), None if draw.random() < 0.2 else i % 4, None if draw.random() < 0.2 else "k") for i in range(200)]
    df = spark.createDataFrame(rows * 2, "a double, b int, name string")
    out = impute.forest_filled(df, ["a", "b"], rounds=2, trees=4)
    assert out.columns == df.columns and out.count() == 400
    assert out.filter("a IS NULL OR b IS NULL OR NOT a BETWEEN 0 AND 8 OR NOT b BETWEEN 0 AND 3").count() == 0
    empty = impute.forest_filled(df.limit(0), ["a", "b"], rounds=1)
    assert empty.columns == df.columns and empty.count() == 0
    with pytest.raises(ValueError):
        impute.forest_filled(df.withColumn("b", F.lit(None).cast("int")), ["a", "b"])


def test_min_max_round_trip(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0)], "a double, b double")
    scaled, ends = impute.min_max(df, ["a", "b"])
    got = scaled.select("a", "b", "a_scaled", "b_scaled", impute.unscaled(F.col("a_scaled"), ends, "a").alias("back")).collect()
    assert {(r["a"], r["a_scaled"], r["b_scaled"], r["back"]) for r in got} == {(1.0, 0.0, 0.0, 1.0), (3.0, 1.0, 0.0, 3.0), (None, None, 0.0, None)}


def test_targets_must_be_features(spark):
    for targets in ([], ["u"]):
        with pytest.raises(ValueError):
            impute.knn_filled(spark.createDataFrame([(1.0, None)], "a double, t double"), ["a", "t"], targets)


@pytest.mark.parametrize("leaf_rows", [4, 64, 10_000])
@pytest.mark.parametrize("crowded", [False, True])
def test_several_targets_by_any_partition(spark, monkeypatch, leaf_rows, crowded):
    """Every coordinate may be missing; a crowded leaf is met in parts by many tasks."""
    draw = random.Random(leaf_rows + crowded)
    features = ["a", "b", "c"]
    rows = []
    for i in range(300):
        point = [0.25, 0.5, round(draw.random(), 3)] if crowded and i % 3 else [round(draw.random(), 2) for _ in features]
        rows.append((i, [None if draw.random() < 0.2 else v for v in point]))
    rows += [(300 + i, [None, None, None] if i else [0.0, 1.0, None]) for i in range(3)]
    df = spark.createDataFrame([(i, *f) for i, f in rows], "id int, a double, b double, c double")
    monkeypatch.setattr(neighbours, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(neighbours, "PART_ROWS", 10)
    monkeypatch.setattr(neighbours.nearest, "__defaults__", (5, leaf_rows))
    got = {r["id"]: r for r in impute.knn_filled(df, features, ["c", "a"], 5).collect()}
    assert len(got) == 303 and all(got[i]["b"] == f[1] for i, f in rows)
    for target in ("a", "c"):
        at = features.index(target)
        mean = [f[at] for _, f in rows if f[at] is not None]
        want = _sklearn_style([r for r in rows if any(v is not None for v in r[1])], features, target, 5)
        for i, f in rows:
            expected = f[at] if f[at] is not None else want.get(i, sum(mean) / len(mean))
            assert got[i][target] == pytest.approx(expected, abs=1e-9), (i, target)


def test_bounds_are_below_every_distance():
    rng = np.random.default_rng(5)
    donors = np.where(rng.random((500, 3)) < 0.1, np.nan, rng.random((500, 3)))
    tree = neighbours.split(donors, 32)
    leaf = tree.leaf_of(donors)
    assert tree.leaves == 32 and set(leaf) == set(range(32))
    tree.low, tree.high = (np.array([[np.nan if np.isnan(donors[leaf == x, f]).any() else end(donors[leaf == x, f]) for f in range(3)] for x in range(32)]) for end in (np.min, np.max))
    queries = np.where(rng.random((200, 3)) < 0.3, np.nan, rng.random((200, 3)))
    bounds = tree.bounds(queries)
    for q, bound in zip(queries, bounds, strict=True):
        gap = (q - donors) ** 2
        shared = (~np.isnan(gap)).sum(1)
        apart = np.sqrt(np.nansum(gap, 1) * 3 / np.maximum(shared, 1))
        assert (bound[leaf][shared > 0] <= apart[shared > 0] + 1e-12).all()
    assert (bounds > 0).mean() > 0.5


def test_no_donors_leave_gaps_and_no_gaps_leave_rows(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 3.0)], "id int, a double, b double")
    assert [r["a"] for r in impute.knn_filled(df, ["a", "b"], "a").collect()] == [None, None]
    assert sorted(r["b"] for r in impute.knn_filled(df, ["a", "b"], ["b"]).collect()) == [2.0, 3.0]
