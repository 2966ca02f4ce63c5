"""Queries over dictionaries of other sizes than that of the given tables."""

import pytest

from anamnesis.operators import records as R, sizes
from anamnesis.plans import catalog


def tables(spark, folder, size):
    """One order per code with the code and the last one, over a dictionary of ``size`` codes."""
    codes = [f"c{i:03d}" for i in range(size)]
    spark.createDataFrame(list(enumerate(codes)), "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    lines = [(i, p) for i in range(size) for p in (i, size - 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    orders = spark.range(size).selectExpr("id o_orderkey", "id o_custkey", "'1-URGENT' o_orderpriority", "'F' o_orderstatus", "1D o_totalprice", "timestamp'2020-01-01' o_orderdate")
    orders.write.parquet(f"{folder}/orders.parquet")
    return codes


@pytest.mark.parametrize("size", [3, 40, 62])
def test_bits_and_names(spark, tmp_path, size):
    codes = tables(spark, tmp_path, size)
    numbers = dict(map(tuple, catalog.QUERIES["i10_bits_to_number"](spark, str(tmp_path)).collect()))
    assert numbers == {i: 1 << size - 1 - i | 1 for i in range(size)}
    names = dict(map(tuple, catalog.QUERIES["i11_nonzero_names"](spark, str(tmp_path)).collect()))
    assert names == {i: ";".join(sorted({c, codes[-1]})) for i, c in enumerate(codes)}


def test_more_codes_than_bits(spark, tmp_path):
    codes = tables(spark, tmp_path, 70)
    names = dict(map(tuple, catalog.QUERIES["i11_nonzero_names"](spark, str(tmp_path)).collect()))
    assert names == {i: ";".join(sorted({c, codes[-1]})) for i, c in enumerate(codes)}
    with pytest.raises(Exception, match="a number has 62 bits"):
        catalog.QUERIES["i10_bits_to_number"](spark, str(tmp_path)).collect()


@pytest.mark.parametrize("width", [sizes.BROADCAST_BYTES, 0])
def test_lists_against_a_long_dictionary(spark, monkeypatch, width):
    """3,000 codes, joined by broadcast and by shuffle: order of the list, repeated, unknown and NULL codes, NULL values, empty and NULL lists."""
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", width)
    values = {f"c{i}": None if i % 100 == 7 else i for i in range(3000)}
    dictionary = spark.createDataFrame(list(values.items()), "code string, idx long")
    lists = [[f"c{(i * 37 + k * 11) % 3200}" for k in range(i % 9)] for i in range(200)] + [["c5", "c5", "c4", None], ["none"], [], None]
    rows = spark.createDataFrame([(i, c, "x") for i, c in enumerate(lists)], "id long, codes array<string>, _at string")
    got = {r["id"]: r["out"] for r in R.looked_up(rows, "id", "codes", dictionary, "idx", "out").collect()}
    want = {i: [values[c] for c in dict.fromkeys(codes or []) if values.get(c) is not None] for i, codes in enumerate(lists)}
    assert got == want
    assert R.looked_up(rows.limit(0), "id", "codes", dictionary, "idx", "out").collect() == []
    none = R.looked_up(rows, "id", "codes", dictionary.limit(0), "idx", "out").collect()
    assert {tuple(r["out"]) for r in none} == {()} and len(none) == len(lists)
