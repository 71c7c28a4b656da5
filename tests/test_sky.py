"""Pixels of the sky, the tree of folders, cone searches, and snapshots, against brute force."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.sources import sky, snapshots


def places(spark, ra, dec, names=("object_id", "ora", "odec")):
    return spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(ra, dec))], f"{names[0]} long, {names[1]} double, {names[2]} double")


def scattered(seed, n):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))


def pixels(spark, ra, dec, order):
    return [r.p for r in sky.with_pixel(places(spark, ra, dec), "p", F.col("ora"), F.col("odec"), order).orderBy("object_id").collect()]


def test_base_pixels(spark):
    """Centres of the twelve base pixels: four around each pole, four on the equator."""
    high = math.degrees(math.asin(2 / 3))
    ra = [45, 135, 225, 315, 0, 90, 180, 270, 45, 135, 225, 315]
    dec = [high] * 4 + [0] * 4 + [-high] * 4
    assert pixels(spark, ra, dec, 0) == list(range(12))
    assert pixels(spark, [10, 100, 190, 280, 10, 280], [90, 89.9, 89.9, 89.9, -90, -89.9], 0) == [0, 1, 2, 3, 8, 11]
    assert pixels(spark, [-5.0, 355.0, 715.0], [3.0] * 3, 9)[0:1] * 3 == pixels(spark, [-5.0, 355.0, 715.0], [3.0] * 3, 9)
    assert sky.with_pixel(places(spark, [1.0], [1.0]), "p", F.lit(None).cast("double"), F.col("odec")).first().p is None


def test_pixels_are_nested_even_and_connected(spark):
    ra, dec = scattered(1, 40_000)
    fine = np.array(pixels(spark, ra, dec, 29))
    for order in (0, 1, 5, 12, 20):
        assert (fine >> 2 * (29 - order) == pixels(spark, ra, dec, order)).all()
    counts = np.bincount(fine >> 2 * 27, minlength=192)  # order 2
    assert len(counts) == 192 and abs(counts - 40_000 / 192).max() < 6 * math.sqrt(40_000 / 192)
    place = np.stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))], axis=1)
    for p in np.unique(fine >> 2 * 25)[::7]:  # order 4: some 3.7 degrees
        mine = place[fine >> 2 * 25 == p]
        assert np.degrees(np.arccos(np.clip(mine @ mine.T, -1, 1))).max() < 8


def test_tree_of_even_folders(spark, tmp_path):
    ra, dec = scattered(2, 3000)
    ra, dec = np.append(ra, 10 + np.random.default_rng(1).normal(0, 1e-7, 500)), np.append(dec, np.full(500, 20.0))  # a crowded place
    sky.write_catalog(places(spark, ra, dec), str(tmp_path / "c"), limit=200)
    data = spark.read.parquet(str(tmp_path / "c/data"))
    sizes = {(r.norder, r.npix): r["count"] for r in data.groupBy("norder", "npix").count().collect()}
    assert data.count() == 3500 and sum(sizes.values()) == 3500
    assert max(n for (o, _), n in sizes.items() if o < sky.DEEPEST) <= 200 and sizes[max(sizes, key=sizes.get)] >= 500
    for (o, p), n in sizes.items():  # a folder's parent was too large
        if o:
            assert sum(m for (q, x), m in sizes.items() if q >= o - 1 and x >> 2 * (q - o + 1) == p >> 2) > 200


@pytest.mark.parametrize("radius", [2.0, 600.0])
def test_cones(spark, tmp_path, radius):
    """Pairs near pixel edges and corners, the poles and the line of right ascension 0 are found; the rest of the sky is not read."""
    rng = np.random.default_rng(3)
    ra, dec = scattered(4, 150)
    high = math.degrees(math.asin(2 / 3))
    ra = np.concatenate([ra, [0, 359.9999, 45, 90, 90, 0, 10, 200, 45.0, 0.0]])
    dec = np.concatenate([dec, [0, 10, 0, high, -high, 41.810314895, 90, -90, 30, 90]])
    near = np.repeat(np.arange(len(ra)), 12)
    step, turn = rng.uniform(0, 2, len(near)) * radius / 3600, rng.uniform(0, 2 * np.pi, len(near))
    odec = np.clip(dec[near] + step * np.cos(turn), -90, 90)
    ora = (ra[near] + step * np.sin(turn) / np.maximum(np.cos(np.radians(odec)), 1e-6)) % 360
    stars = places(spark, ra, dec, ("star_id", "ra", "dec"))
    sky.write_catalog(places(spark, np.append(ora, scattered(5, 2000)[0]), np.append(odec, scattered(5, 2000)[1])), str(tmp_path / "c"), limit=100)
    ora, odec = np.append(ora, scattered(5, 2000)[0]), np.append(odec, scattered(5, 2000)[1])
    half = lambda x: np.sin(np.radians(x) / 2)
    h = half(odec - dec[:, None]) ** 2 + np.cos(np.radians(dec))[:, None] * np.cos(np.radians(odec)) * half(ora - ra[:, None]) ** 2
    sep = np.degrees(2 * np.arcsin(np.minimum(1, np.sqrt(h)))) * 3600
    want = {(i, j) for i, j in zip(*np.nonzero(sep <= radius))}
    got = sky.cone_search(stars, str(tmp_path / "c"), radius).select("star_id", "object_id").collect()
    assert {(r.star_id, r.object_id) for r in got} == want and len(got) == len(want)
    one = sky.cone_search(stars.filter("star_id = 3"), str(tmp_path / "c"), radius)
    assert {(r.star_id, r.object_id) for r in one.collect()} == {x for x in want if x[0] == 3}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "npix" in plan.split("PartitionFilters: [")[1].split("]")[0]
    order = sky.order_for(radius)
    cones = sky.touched(stars.filter("star_id = 3"), radius, order)
    data = spark.read.parquet(str(tmp_path / "c/data")).select("norder", "npix").distinct()
    assert 1 <= data.filter(sky.folders(spark, cones, str(tmp_path / "c"), order)).count() <= (4 if radius < 100 else 30) < data.count()
    assert sky.cone_search(stars.filter("false"), str(tmp_path / "c"), radius).count() == 0


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "d")
    assert snapshots.history(spark, path) == []
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    rows = lambda: sorted(r.x for r in snapshots.read(spark, path).collect())
    assert snapshots.replaced(spark.range(3).withColumnRenamed("id", "x"), path) == 1
    assert snapshots.replaced(snapshots.read(spark, path).withColumn("x", F.col("x") * 10), path) == 2  # reads what it replaces
    assert rows() == [0, 10, 20] and sorted(r.x for r in snapshots.read(spark, path, 1).collect()) == [0, 1, 2]
    with pytest.raises(snapshots.Conflict):
        snapshots.replaced(spark.range(9).withColumnRenamed("id", "x"), path, after=1)
    assert rows() == [0, 10, 20]  # the lost writer changed nothing
    assert snapshots.back_to(spark, path, 1) == 3 and rows() == [0, 1, 2]
    with pytest.raises(ValueError):
        snapshots.back_to(spark, path, 7)
    (tmp_path / "d/log/000000000004").touch()  # a writer that has not ended
    assert rows() == [0, 1, 2]
    (tmp_path / "d/log/000000000004").unlink()
    assert len(snapshots.cleaned(spark, path)) == 2 and rows() == [0, 1, 2]  # of the lost writer and of 2
    assert [n for n, _ in snapshots.history(spark, path)] == [3]
    with pytest.raises(ValueError):
        snapshots.read(spark, path, 2)


def test_one_of_many_writers_wins(spark, tmp_path):
    path, won = str(tmp_path / "d"), []

    def write(i):
        try:
            won.append((snapshots.replaced(spark.range(i, i + 1), path, after=0), i))
        except snapshots.Conflict:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and [r.id for r in snapshots.read(spark, path).collect()] == [won[0][1]]
