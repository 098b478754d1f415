"""Contract of the entry module, and SQL comparison of a sample of queries."""

import math
import os
import re

import pytest

SF = "/root/testdata/sf0.001"


def test_optional_part_is_not_imported():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "heritas")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"heritas\.llm|import llm", open(os.path.join(folder, f)).read()), f


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["sample_intersection", "locus_stats_os_dom", "phenotype_dint", "grm_loco", "gwas_wald_null", "polygenic_score", "split_rhat", "hpdi"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")

    def rows(values):
        return sorted(tuple(f"{v:.5f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in values)

    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["snp_idx", "a1_freq", "beta", "se", "p"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
