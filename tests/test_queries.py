"""Each query of the library against its SQL at sf0.001."""

import duckdb
import pytest

from compare import TABLES, rows
from gridloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, SF).toArrow(), con.sql(registry.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_components_of_a_chain_and_a_pair(spark):
    from gridloom.operators.graph import connected_components

    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 90), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {k: 0 for k in range(21)} | {90: 90, 100: 90}


def test_components_without_edges(spark):
    from gridloom.operators.graph import connected_components

    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_diagonal_blobs_join_only_with_eight_neighbours(spark):
    from gridloom.operators import focal

    cells = {(1, 1), (1, 2), (2, 1), (3, 2), (3, 3)}  # (2,1) and (3,2) touch at a corner
    grid = spark.createDataFrame([(y, x, 1 if (y, x) in cells else 0) for y in range(6) for x in range(6)], "y int, x int, cls int")
    count = lambda diagonal: focal.components(grid, diagonal).filter("cls = 1").select("comp").distinct().count()
    assert (count(False), count(True)) == (2, 1)


def test_windows_around_every_valid_pixel(spark):
    from gridloom.plans import fixtures

    cells = {(r["y"], r["x"]): r for r in fixtures.raster(spark, SF).collect()}
    want = {
        (y, x, dy, dx): cells[y + dy - 2, x + dx - 2]["cls"] if (y + dy - 2, x + dx - 2) in cells else 0
        for (y, x), r in cells.items() if r["valid"] for dy in range(5) for dx in range(5)
    }
    got = registry.QUERIES["pixel_centred_window"](spark, SF).collect()
    assert len(got) == len(want) and {(r["cy"], r["cx"], r["dy"], r["dx"]): r["cls"] for r in got} == want


def test_whole_queries_keep_all_rows(spark):
    orders, e = spark.read.parquet(f"{SF}/orders.parquet"), spark.read.parquet(f"{SF}/embeddings.parquet")
    assert registry.QUERIES["reflectance_scale"](spark, SF).count() == orders.count()
    assert registry.QUERIES["norm_pretrained"](spark, SF).count() == 64 * e.count()


def test_reflectance_is_scaled_by_the_whole_image(spark):
    from gridloom.operators import normalize

    data = [(0, 0, 50.0), (0, 1, 60.0), (0, 2, 200.0), (1, 0, 50.0), (1, 1, 100.0)]
    got = normalize.scale_reflectance(spark.createDataFrame(data, "y int, x int, value double"), "y").collect()
    assert {(r["y"], r["x"]): r["value"] for r in got} == {(0, 0): 0.005, (0, 1): 0.006, (0, 2): 0.02, (1, 0): 50.0, (1, 1): 100.0}


def test_three_scoring_rules(spark):
    from gridloom.operators import metrics

    data = [(0, 1), (10, 255), (10, 1), (20, 2), (255, 1), (-1, 1)]
    df = spark.createDataFrame(data, "cls int, pred int")
    kept = lambda rule: sorted((r["cls"], r["pred"]) for r in metrics.scored_pixels(df, rule).collect())
    assert kept("positive_truth") == [(10, 1), (10, 255), (20, 2), (255, 1)]
    assert kept("known") == [(-1, 1), (10, 1), (20, 2), (255, 1)]
    assert kept("byte") == [(0, 1), (10, 1), (10, 255), (20, 2)]
