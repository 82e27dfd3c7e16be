"""Every registered query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from bramble.plans import registry
from bramble.session import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _comparable(df):
    df = df[sorted(df.columns)].apply(lambda c: c.astype(float).round(6) + 0.0 if pd.api.types.is_numeric_dtype(c) else c.astype(str))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    pd.testing.assert_frame_equal(_comparable(got), _comparable(want), check_dtype=False, atol=2e-6, rtol=0)


@pytest.mark.parametrize("name", ["fcm_centers", "pca_scores", "tensor_fusion", "graph_sampling", "smote_rows", "kfold_assign", "hash_split", "colour_equalize", "colour_segments", "colour_hair_removal", "colour_denoise", "combined_mask"])
def test_rows(spark, name):
    first, again = (sorted(map(tuple, registry.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == again
