"""Queries against their SQL in another engine, over the smallest tables."""

import os

import duckdb
import pytest

from codeloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["language_classify", "path_exclusion", "test_path", "path_normalize", "hunk_ranges", "import_prefix_suppression", "resolve_longest_prefix", "resolve_suffix", "bm25_rank_top80", "bm25_from_postings", "symbol_ranges", "resolve_relative", "index_fingerprint", "impact_capped", "narrowest_symbol", "layer_classify", "bench_stats"]


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = db.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted((str([plain(v) for _, v in sorted(zip(columns, row))]) for row in found.fetchall()))
    rows = QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(str([plain(r[c]) for c in sorted(columns)]) for r in rows.collect()) == want
