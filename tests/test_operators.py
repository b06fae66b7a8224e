"""Operators that SQL cannot express, against brute force and known values; degenerate inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import catalog
from strandline.functions import codec as C
from strandline.functions import scoring as S
from strandline.operators import incremental, pointcloud, raster, rays, series, transect, vector
from strandline.plans import views
from strandline.sources import scans, sinks
from strandline.streaming import composite


def cells(spark, rows):
    return spark.createDataFrame(rows, "tile long, r long, c long, v double")


def test_scores_at_their_limits(spark):
    df = spark.createDataFrame([(5.0, 19.9), (20.0, 20.0), (12.5, 85.0), (0.0, 150.0), (4.0, 150.1)], "s double, d double")
    got = [tuple(r) for r in df.select(S.slope_score(F.col("s")), S.dist_score(F.col("d"))).collect()]
    assert got == [(1.0, 0.0), (0.0, 0.0), (0.5, 0.5), (1.0, 1.0), (1.0, 1.0)]


def test_swamp_alone_halves_one(spark):
    df = spark.createDataFrame([(True,), (False,)], "w boolean")
    got = [r[0] for r in df.select(S.mask_score(F.lit(8), F.lit(0), F.lit(0), F.lit(False), F.col("w"))).collect()]
    assert got == [0.5, 1.0]


def test_sheet_round_trip(spark):
    pts = [(random.Random(i).uniform(50_000, 700_000), random.Random(-i - 1).uniform(6_600_000, 7_700_000)) for i in range(200)]
    df = spark.createDataFrame(pts, "x double, y double").withColumn("n", C.sheet_name(F.col("x"), F.col("y")))
    x, y = C.sheet_origin(F.col("n"))
    assert df.where(~(F.col("x").between(x, x + 6000) & F.col("y").between(y, y + 6000))).count() == 0


def test_cell_ids_are_inverted(spark):
    df = spark.createDataFrame([(12340.0, 6_700_010.0), (5.0, 15.0)], "x double, y double")
    g = C.cell_id(F.col("x"), F.col("y"))
    x, y = C.cell_xy(g)
    assert [tuple(r) for r in df.select(x, y).collect()] == [(12340.0, 6_700_010.0), (0.0, 20.0)]


def test_png_has_its_chunks():
    data = C.png(2, 1, bytes(range(8)))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and b"IHDR" in data and data.endswith(b"IEND\xaeB`\x82")


def test_nearest_seed_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(1, r, c, float(rng.random() < 0.08)) for r in range(15) for c in range(15)] + [(2, 0, 0, 0.0)]
    got = {(r["r"], r["c"]): r["d2"] for r in raster.nearest_seed(cells(spark, rows), F.col("v") > 0, 5).collect()}
    seeds = [(r, c) for t, r, c, v in rows if v > 0]
    want = {(r, c): d for t, r, c, _ in rows if t == 1 and (d := min((r - a) ** 2 + (c - b) ** 2 for a, b in seeds)) <= 25}
    assert got == want  # the tile without a seed has no rows


def test_gradient_of_a_plane_and_gaps(spark):
    rows = [(1, r, c, 2.0 * c) for r in range(4) for c in range(4) if (r, c) != (1, 1)]
    got = {(r["r"], r["c"]): r["slope"] for r in raster.gradient(cells(spark, rows).withColumnRenamed("v", "e"), "e", 2.0).collect()}
    assert all(math.isclose(got[k], 45.0) for k in got if k not in ((1, 0),))
    assert got[1, 0] == 0.0  # no neighbour on either side


def test_window_extreme_is_a_square(spark):
    rng = np.random.default_rng(1)
    rows = [(1, r, c, float(rng.random())) for r in range(10) for c in range(10) if rng.random() < 0.5]
    got = {(r["r"], r["c"]): r["m"] for r in raster.window_extreme(cells(spark, rows), "v", 2).collect()}
    assert got == {(r, c): min(v for _, a, b, v in rows if abs(a - r) <= 2 and abs(b - c) <= 2) for _, r, c, _ in rows}


def test_components_touch_by_corners(spark):
    rows = [(1, 0, 0, 1.0), (1, 1, 1, 1.0), (1, 5, 5, 1.0), (2, 1, 1, 1.0)]
    got = {(r["tile"], r["r"], r["c"]): r["component"] for r in raster.label_components(cells(spark, rows)).collect()}
    assert got == {(1, 0, 0): 0, (1, 1, 1): 0, (1, 5, 5): 500005, (2, 1, 1): 100001}


def test_lower_percentile_for_all_sizes(spark):
    rows = [(n, 0, i, float(i * 41 % n)) for n in range(1, 40) for i in range(n)]
    got = {r["tile"]: r["v"] for r in transect.lower_percentile(cells(spark, rows), ["tile"], "v", 10).collect()}
    assert got == {n: float(math.trunc((n - 1) * 10 / 100)) for n in range(1, 40)}


def march(land, r, c, dr, dc, steps, size, look):
    entered = None
    for k in range(1, steps + 1):
        at = (r + round(round(k * dr, 9)), c + round(round(k * dc, 9)))
        if entered is None:
            if at not in land:
                entered = k
            elif k == 4:
                return 50.0, 0.0
        elif at in land:
            tall = max(land.get((r + round(round((k + j) * dr, 9)), c + round(round((k + j) * dc, 9))), 0.0) for j in range(look + 1))
            return max((k - entered) * size, 50.0), tall
    return (steps * size, 0.0) if entered else (50.0, 0.0)


def test_rays_against_marching(spark):
    rng = random.Random(5)
    land = {(r, c): float(rng.randint(1, 9)) for r in range(25) for c in range(25) if rng.random() < 0.15}
    table = spark.createDataFrame([(1, r, c, h) for (r, c), h in land.items()], "tile long, r long, c long, height double")
    some = sorted(land)[:12]
    got = rays.ray_fetch(spark.createDataFrame([(1, *x) for x in some], "tile long, r long, c long"), table, steps=20, size=10.0, look=5).collect()
    assert len(got) == 12 * 48
    steps = {b["bearing"]: (b["dr"], b["dc"]) for b in rays.bearings(spark).collect()}
    for x in got:
        assert (x["fetch"], x["obstacle"]) == march(land, x["r"], x["c"], *steps[x["bearing"]], 20, 10.0, 5)


def test_registered_rays_cross_whole_tiles_from_all_land(spark):
    sf_dir = "/root/testdata/sf0.001"
    lands = {}
    for p in views.pixels(spark, sf_dir).where("swamp OR elev >= 7").collect():
        lands.setdefault(p["tile"], {})[p["r"], p["c"]] = p["elev"]
    got = {(x["tile"], x["r"], x["c"], x["bearing"]): (x["fetch"], x["obstacle"]) for x in catalog.QUERIES["ray_fetch"](spark, sf_dir).collect()}
    assert len(got) == 48 * sum(map(len, lands.values()))
    steps = {b["bearing"]: (b["dr"], b["dc"]) for b in rays.bearings(spark).collect()}
    for tile, r, c in random.Random(3).sample(sorted({k[:3] for k in got}), 20):
        for b, (dr, dc) in steps.items():
            assert got[tile, r, c, b] == march(lands[tile], r, c, dr, dc, 1500, 10.0, 10)


def test_rays_across_regions_with_odd_cells(spark, monkeypatch):
    monkeypatch.setattr(rays, "REGION", 3)
    rng = random.Random(8)
    land = {(r, c): float(rng.randint(-3, 9)) for r in range(-20, 20) for c in range(30, 60) if rng.random() < 0.1}
    rows = [(1, r, c, h) for (r, c), h in land.items()]
    odd = [(1, *sorted(land)[0], -9.0), (1, None, 31, 5.0), (None, 0, 31, 5.0), (2, 4, 4, None), (2, -400, 4, 7.0)]  # twice, nowhere, unknown height, out of reach
    table = spark.createDataFrame(rows + odd, "tile long, r long, c long, height double")
    away = [(1, -25, 45), (1, 3, 3), (1, 3, 3), (3, 0, 0), (1, None, 31), (None, 0, 31)]
    origins = spark.createDataFrame([(1, *x) for x in sorted(land)[:15]] + away, "tile long, r int, c int")
    steps = {b["bearing"]: (b["dr"], b["dc"]) for b in rays.bearings(spark).collect()}
    lands = {1: land, 2: {(4, 4): 0.0, (-400, 4): 7.0}}

    def highest(tile, r, c, d):
        fetch, _ = march(lands.get(tile, {}), r, c, *d, 30, 10.0, 5)
        if fetch in (50.0, 300.0):
            return None
        at = next(k for k in range(2, 31) if cell(r, c, d, k) in lands[tile] and not all(cell(r, c, d, j) in lands[tile] for j in range(1, k)))
        return max(lands[tile][x] for j in range(6) if (x := cell(r, c, d, at + j)) in lands[tile])

    def cell(r, c, d, k):
        return r + round(round(k * d[0], 9)), c + round(round(k * d[1], 9))

    for got, n in ((rays.ray_fetch(origins, table, steps=30, size=10.0, look=5), 15 + len(away)), (rays.ray_fetch(None, table, steps=30, size=10.0, look=5), len(rows) + len(odd))):
        found = got.collect()
        assert len(found) == 48 * n
        for x in found:
            if None in (x["tile"], x["r"], x["c"]):
                assert (x["fetch"], x["obstacle"]) == (300.0, 0.0)
                continue
            want, _ = march(lands.get(x["tile"], {}), x["r"], x["c"], *steps[x["bearing"]], 30, 10.0, 5)
            assert x["fetch"] == want
            if (tall := highest(x["tile"], x["r"], x["c"], steps[x["bearing"]])) is not None:
                assert x["obstacle"] == tall
    empty = table.where("false")
    assert rays.ray_fetch(None, empty, steps=30, size=10.0).count() == 0
    assert {tuple(x) for x in rays.ray_fetch(origins, empty, steps=30, size=10.0).select("fetch", "obstacle").collect()} == {(300.0, 0.0)}


def test_rays_make_no_row_for_each_step(spark):
    plan = catalog.QUERIES["ray_fetch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "collect_list" not in plan


def test_open_water_has_the_known_bias(spark):
    df = rays.bearings(spark).select(F.lit(1).alias("id"), "bearing", F.lit(15000.0).alias("fetch"), F.lit(3.0).alias("obstacle"))
    for r in rays.effective(df, ["id"]).collect():
        assert 13436 < r["fetch"] < 13438 and math.isclose(r["obstacle"], 3.0)


def test_rasterise_a_square_with_a_hole(spark):
    ring = lambda a, z: [(a, a), (z, a), (z, z), (a, z), (a, a)]
    df = spark.createDataFrame([(1, 0, ring(0.0, 6.0)), (1, 1, ring(2.0, 4.0))], "id long, ring int, points array<struct<x:double,y:double>>")
    got = {(r["r"], r["c"]) for r in vector.rasterise(df).collect()}
    assert got == {(r, c) for r in range(6) for c in range(6)} - {(r, c) for r in (2, 3) for c in (2, 3)}


def test_simplify_keeps_ends_and_corners(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 0.1), (10.0, 0.0), (10.0, 10.0)]), (2, [(0.0, 0.0)])], "id long, points array<struct<x:double,y:double>>")
    got = {r["id"]: [(p["x"], p["y"]) for p in r["points"]] for r in vector.simplify(df, 1.0).collect()}
    assert got == {1: [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 2: [(0.0, 0.0)]}


def test_projection_on_the_central_meridian(spark):
    x, y = vector.to_grid(F.lit(0.0), F.lit(27.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), vector.to_grid(F.lit(60.0), F.lit(27.0))[1].alias("n")).first()
    assert abs(r["x"] - 500_000) < 1e-6 and abs(r["y"]) < 1e-6 and 6_650_000 < r["n"] < 6_656_000


def test_clusters_of_a_long_chain(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([(i, i, 0) for i in range(12)] + [(50, 40, 40)], "id long, x long, y long")
    got = {r["id"]: r["cluster"] for r in vector.clusters(df).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 50: 50}


def test_point_cloud_without_ground(spark):
    df = spark.createDataFrame([(1, 5.0, 3), (1, 7.0, 5), (2, 1.0, 2)], "cell long, z double, cls int")
    got = {r["cell"]: r for r in pointcloud.grid(df).collect()}
    assert got[1]["ground"] is None and got[1]["surface"] == 7.0 and got[1]["cover"] == 1.0 and not got[1]["valid"] and got[2]["cover"] == 0.0


def test_merge_lookup_and_guard(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, None), (3, "z")], "k long, v string")
    assert sorted(map(tuple, incremental.merge(a, b, "k", ["v"]).collect())) == [(1, "x"), (2, None), (3, "z")]
    with pytest.raises(Exception, match="no entry"):
        incremental.lookup(b.select("k"), a, "k").collect()
    with pytest.raises(ValueError):
        incremental.shrink_guard(10, 7)
    incremental.shrink_guard(10, 8)


def test_file_fingerprints_follow_the_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    one = incremental.file_fingerprints(spark.read.parquet(str(tmp_path / "t")))
    assert one.count() >= 1 and one.columns == ["path", "fingerprint"]


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([('{"elements": [{"id": 1}, {"id": 2}]}',), ("broken",)], "j string")
    assert sorted(r["id"] for r in scans.json_elements(raw, "j", "elements array<struct<id:long>>", "elements").collect()) == [1, 2]
    with pytest.raises(ValueError):
        scans.counted(raw, 5)
    assert [r["value"] for r in scans.series_text(spark.createDataFrame([("1.5 NaN? 2",)], "t string"), "t").orderBy("k").collect()] == [1.5, None, 2.0]
    xml = "<r><Layer><Name>A</Name><Dimension>2024-01-02,2024-01-03,2024-01-02</Dimension></Layer></r>"
    assert [str(r["day"]) for r in scans.xml_dates(spark.createDataFrame([(xml,)], "x string"), "x").collect()] == ["2024-01-03", "2024-01-02"]
    boxes = spark.createDataFrame([("w", 0.0, 0.0, 1.0, 1.0), ("w", 50.0, 0.0, 51.0, 1.0)], "layer string, minx double, miny double, maxx double, maxy double")
    boxes.write.parquet(str(tmp_path / "f"))
    assert scans.features(spark, str(tmp_path / "f"), ["w", "none"], (2.0, 0.0, 3.0, 1.0), pad=1.5).count() == 1


def test_partitioned_sink_replaces_single_tiles(spark, tmp_path):
    path = str(tmp_path / "cells")
    sinks.write_cells(cells(spark, [(1, 0, 0, 1.0), (2, 0, 0, 2.0)]), path)
    sinks.write_cells(cells(spark, [(2, 0, 0, 9.0)]), path)
    assert {r["tile"]: r["v"] for r in spark.read.parquet(path).collect()} == {1: 1.0, 2: 9.0}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-0{1 + i % 2} 0{i % 9}:00:00", 1 + i % 2, i % 4) for i in range(30)]
    df = spark.createDataFrame(rows, "cell long, ts string, layer int, cls int").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = composite.freshest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (str(r["day"]), r["cell"], r["cls"])
    assert sorted(map(key, spark.table("fresh").collect())) == sorted(map(key, composite.freshest_stream(df).collect()))


def test_empty_tables(spark):
    none = cells(spark, [])
    for out in (raster.nearest_seed(none, F.col("v") > 0, 3), raster.window_extreme(none, "v", 2), raster.label_components(none), transect.lower_percentile(none, ["tile"], "v", 10)):
        assert out.count() == 0
    assert series.mixing_dose(spark.createDataFrame([], "cell long, hour timestamp, wind double"), 3).count() == 0
