"""Op 3: code tables of over a million rows, whose numbers have more digits than the layout's order field."""

from __future__ import annotations

import __spark_entry__ as E
from cohortlab.sources import io


def test_orders_of_any_size_keep_line_and_number(spark, tmp_path):
    path, orders = str(tmp_path / "codes"), [0, 7, 999_999, 1_000_000, 1_200_000, 12_345_678, 9_007_199_254_740_993, -5]
    df = spark.createDataFrame([(o, f"C{i}", f"title {i}") for i, o in enumerate(orders)], "o long, c string, t string")
    io.write_fixed_width(df, path, "o", "c", "t", volumes=True)
    assert {(r.code, r.title) for r in io.read_fixed_width(spark, path).collect()} == {(f"C{i}", f"title {i}") for i in range(len(orders))}
    lines = spark.read.text(path).selectExpr("volume", "value").collect()
    assert {r.volume * 1_000_000 + int(r.value[:6]) for r in lines} == set(orders)


def test_query_reads_keys_of_seven_digits(spark, tmp_path):
    spark.createDataFrame([(k, f"part {k}", k % 50) for k in (1, 999_999, 1_000_000, 1_200_003)],
                          "p_partkey long, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = E.queries()["read_fixed_width"](spark, str(tmp_path)).collect()
    # codes have 3 + key % 3 characters, of which up to 4 are kept
    assert {r.title for r in got} == {f"part {k}" for k in (1, 999_999, 1_000_000, 1_200_003) if 3 + k % 3 <= 4}
