"""The exam view over small order tables of its own."""

import datetime

from examlake.operators import cleaning
from examlake.plans import exam_view, queries

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
KEYS = ["TP_COR_RACA", "NU_INSCRICAO", "CO_MUNICIPIO_PROVA"]


def test_first_rows_are_found_before_orders_are_joined(spark, tmp_path, monkeypatch):
    """Keep-first over few keys joins and derives the other columns of the first rows alone; repeated or missing orders and suppliers."""
    day = datetime.datetime(1998, 3, 1)
    lines = [(i // 4, i % 60, i % 3 if i % 17 else None, i % 4 + 1, 10.0, 100.0 + i, 0.05, 0.02, "N", "F", day) for i in range(400)]
    tables = {
        "lineitem": spark.createDataFrame(lines + lines[:3], LINES),
        "orders": spark.createDataFrame([(i, 1000.0 + i) for i in range(90)] + [(0, 1000.0)], "o_orderkey bigint, o_totalprice double"),
        "supplier": spark.createDataFrame([(0, 5), (1, 6), (1, 7)], "s_suppkey bigint, s_nationkey int"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    whole = cleaning.keep_first(exam_view.exam_rows(spark, str(tmp_path), keyed=True), KEYS, exam_view.ROW_KEY).drop(*exam_view.ROW_KEY)
    compared, split = [], cleaning.split_duplicates
    monkeypatch.setattr(cleaning, "split_duplicates", lambda rows, *more: compared.append(rows.count()) or split(rows, *more))
    got = queries.REGISTRY["dedup_two_keys"](spark, str(tmp_path))
    expected = queries.rounded(whole)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    # Of 400 rows; repeated rows of orders, suppliers and lines may bring a key more than one.
    assert expected.count() <= compared[0] < 60
