"""Every query on empty tables, and on tables of nulls, blanks, repeated rows and extra columns: none may fail."""

import datetime

import pytest
from pyspark.sql import types as T

from tidemill import registry

LONG, INT, TEXT, REAL, TIME = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType()
TABLES = {
    "region": [("r_regionkey", INT), ("r_name", TEXT)],
    "nation": [("n_nationkey", INT), ("n_name", TEXT), ("n_regionkey", INT)],
    "customer": [("c_custkey", LONG), ("c_name", TEXT), ("c_nationkey", INT), ("c_acctbal", REAL), ("c_mktsegment", TEXT)],
    "supplier": [("s_suppkey", LONG), ("s_name", TEXT), ("s_nationkey", INT), ("s_acctbal", REAL)],
    "part": [("p_partkey", LONG), ("p_name", TEXT), ("p_brand", TEXT), ("p_type", TEXT), ("p_size", INT), ("p_retailprice", REAL)],
    "orders": [("o_orderkey", LONG), ("o_custkey", LONG), ("o_orderstatus", TEXT), ("o_totalprice", REAL), ("o_orderdate", TIME), ("o_orderpriority", TEXT)],
    "lineitem": [("l_orderkey", LONG), ("l_partkey", LONG), ("l_suppkey", LONG), ("l_linenumber", INT), ("l_quantity", REAL), ("l_extendedprice", REAL), ("l_discount", REAL), ("l_tax", REAL), ("l_returnflag", TEXT), ("l_linestatus", TEXT), ("l_shipdate", TIME)],
    "events": [("event_id", LONG), ("ts", TIME), ("user_id", LONG), ("event_type", TEXT), ("value", REAL), ("props", TEXT)],
    "documents": [("doc_id", LONG), ("text", TEXT), ("lang", TEXT), ("source", TEXT), ("n_chars", LONG)],
    "embeddings": [("vec_id", LONG), ("embedding", T.ArrayType(T.FloatType())), ("label", INT)],
    "pages": [("page_id", LONG), ("url", TEXT), ("html", TEXT)],
    "benchmark": [("item_id", LONG), ("text", TEXT)],
    "labels": [("doc_id", LONG), ("quality", INT), ("toxic", INT)],
    "conversations": [("conv_id", LONG), ("turn", LONG), ("role", TEXT), ("text", TEXT)],
}
EXTRA = [("id", TEXT), ("rank", TEXT), ("score", TEXT), ("n", TEXT)]


def value(kind, i):
    if kind == TEXT:
        return ["", "  ", "the one of 12 and", "the one of 12 and"][i % 4]
    if kind == TIME:
        return datetime.datetime(2024, 1, 1 + i % 3)
    if kind == REAL:
        return float(i % 3)
    return [1.0, 0.0] if isinstance(kind, T.ArrayType) else i % 3


@pytest.fixture(scope="module", params=["empty", "odd"])
def folder(request, spark, tmp_path_factory):
    root = tmp_path_factory.mktemp(request.param)
    for name, columns in TABLES.items():
        if request.param == "empty":
            rows, columns = [], columns
        else:
            full = [tuple(value(k, i) for _, k in columns) for i in range(4)]
            rows = [(*r, *"abcd") for r in full + full[:1] + [tuple(None if j == c else v for j, v in enumerate(full[2])) for c in range(len(columns))] + [(None,) * len(columns)]]
            columns = columns + EXTRA
        spark.createDataFrame(rows, T.StructType([T.StructField(c, k) for c, k in columns])).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, folder, name):
    registry.queries()[name](spark, folder).collect()
