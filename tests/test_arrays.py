"""Large JSON arrays read by many tasks."""

import json
import random

import pytest

from mnemoria.sources import arrays


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for name in ("files.maxPartitionBytes", "files.openCostInBytes", "adaptive.coalescePartitions.enabled"):
        spark.conf.unset(f"spark.sql.{name}")


def rows(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(['}', '{', '"', "\\", "],", "[", "é", "x", "\n", '},{"', "☃ "]) for _ in range(rng.randint(0, 30)))
    return [{"id": i, "content": text(), "inner": {"a": [{"b": text()}, {}], "c": {}}} for i in range(n)]


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 2), (3, None)])
def test_elements_of_one_large_file(spark, tmp_path, small_splits, seed, indent):
    want = rows(seed, 400)
    want[100]["content"] = "long } { \" \\ " * 2000  # passes several partitions
    (tmp_path / "a.json").write_text(json.dumps(want, ensure_ascii=seed == 3, indent=indent))
    (tmp_path / "b.json").write_text(json.dumps(rows(9, 3)))
    (tmp_path / "c.json").write_text("[]")
    path = str(tmp_path / "a.json")
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
    got = [json.loads(r["element"]) for r in arrays.elements(spark, path).orderBy("number").collect()]
    assert got == want
    both = arrays.read_large_store(spark, str(tmp_path), "id long, content string")
    assert sorted(map(tuple, both.collect())) == sorted((r["id"], r["content"]) for r in want + rows(9, 3))
