"""Every registered query against its SQL twin, on the smallest data set."""

import pytest

from compare import compare, connect
from emberfield.checks import load_all

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
# A cross-section of every family; compare.py runs all of them.
PICKED = (
    "s5_", "s10_", "p1_", "p2_", "p4_", "p5_", "p9_", "p12_", "i1_", "i2_", "i3_", "f3_", "f12_", "f20_", "f23_", "f26_",
    "f27_", "f29_", "r1_", "r6_composite_median", "r10_", "r11_", "r12_", "r14_", "r16_", "j1_", "j4_", "j7_", "j10_",
    "a4_", "a9_", "a10_", "a11_", "w1_", "w2_", "w4_", "w8_", "k1_", "k6_", "g1_", "g4_", "g5_", "g8_", "g13_", "m8_", "t3_windowed_batch",
)


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in ORACLES if n.startswith(PICKED)])
def test_query_matches_sql(spark, oracle, name):
    verdict, _, _ = compare(QUERIES[name](spark, FOLDER), oracle, ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
