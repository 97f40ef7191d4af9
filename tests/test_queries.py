"""Every query with SQL gives its rows, and text functions give their literal cases."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom import catalog
from factloom.functions import text as T
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    assert differences(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF) == []


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_clean_lines(spark):
    assert one(spark, T.clean_lines(F.lit("a\na\n\na  b"))) == "a\na b"


def test_numbers(spark):
    assert one(spark, T.numbers_in(F.lit("2.5 lakh"))) == [2.5, 250000.0]
    assert one(spark, T.numbers_in(F.lit("Rs. 2,50,000"))) == [250000.0]
    assert one(spark, T.numbers_in(F.lit("1 crore"))) == [1.0, 10000000.0]


def test_dates(spark):
    got = one(spark, T.find_dates(F.lit("31.10.2026, 5-6-24, 2026-02-30, 1st of March, 2026 and Sept 3, 2026")))
    assert [str(d) for d in got] == ["2024-06-05", "2026-03-01", "2026-09-03", "2026-10-31"]


def test_lcs_ratio(spark):
    assert one(spark, T.lcs_ratio(F.lit("abcd"), F.lit("acbd"))) == 75.0


def test_sides_hold_every_row(spark):
    """The whole-table forms of union, merge and field changes against plain Python over all rows."""
    q = catalog.queries()
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    assert sorted(r.url for r in q["set_union_urls_all"](spark, SF).collect()) == sorted(set(urls))
    a, b = defaultdict(list), defaultdict(list)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount").collect()
    for k, n, supp, price, quantity, discount in lines:
        if supp % 3:
            a[k, n].append((price, quantity))
        if supp % 3 == 0 or supp % 2 == 0:
            b[k, n].append((price + 1, quantity + (discount > 0.05)))
    merged, notes = Counter(), Counter()
    for key in a.keys() | b.keys():
        for x in a.get(key, [None]):
            for y in b.get(key, [None]):
                merged[(*key, (x or y)[0], x is None)] += 1
                if x is None or y is None or x[1] != y[1]:
                    notes[(*key, "newly stated" if x is None else "no longer stated" if y is None else "value changed")] += 1
    assert {(k[0], k[1]) for k in merged} == {(r[0], r[1]) for r in lines}
    assert Counter(tuple(r) for r in q["merge_missing_all"](spark, SF).select("record", "field", "price", "filled").collect()) == merged
    assert Counter(tuple(r) for r in q["field_changes_all"](spark, SF).select("record", "field", "note").collect()) == notes
