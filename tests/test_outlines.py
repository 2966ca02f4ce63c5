"""Outline files that many tasks read."""

import pytest

from anamnesis.sources import tables


@pytest.mark.parametrize("block", ["300", "5000", "134217728"])
def test_outline_of_any_length(spark, tmp_path, block):
    """Blocks that begin in the middle of a line, blocks without a parent, blank and leading lines, two files."""
    import random

    rnd, want = random.Random(int(block)), []
    for name in "ab":
        lines, main = ["", "above the first parent"], None
        for i in range(2000):
            if rnd.random() < 0.02 or i == 3:
                main = f"parent {name}{i} é"
                lines.append(f"s-{main} ")
            elif rnd.random() < 0.1:
                lines.append("  ")
            else:
                lines.append(f" part {i} " + "x" * rnd.randint(0, 30))
                if main:
                    want.append((main, lines[-1].strip()))
        (tmp_path / f"{name}.txt").write_text("\n".join(lines), "utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [tuple(r) for r in tables.read_outline(spark, str(tmp_path)).collect()]
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert sorted(got) == sorted(want)
    assert tasks > 100 or block != "300"
