"""Sinks: all files or none, manifests with holes, comparisons in order."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from granary.sources import reports
from granary.sources.models import ModelSpec, model_manifest, registry
from granary.sources.sidecars import read_sidecars, write_sidecars


def captions(spark, n=40, files=5):
    return spark.range(n).repartition(files).select(F.format_string("%03d.txt", "id").alias("file"), F.when(F.col("id") != 7, F.concat(F.lit("näme\n"), F.col("id").cast("string"))).alias("caption"))


def test_sidecars(spark, tmp_path):
    path = f"{tmp_path}/captions"
    write_sidecars(captions(spark), path, "file", "caption")
    got = {r["name"]: r["text"] for r in read_sidecars(spark, path).collect()}
    assert got == {f"{i:03d}.txt": f"näme\n{i}" for i in range(40) if i != 7} and os.path.getsize(f"{path}/007.txt") == 0
    assert os.listdir(tmp_path) == ["captions"] and len(os.listdir(path)) == 40
    with pytest.raises(Exception, match="captions"):
        write_sidecars(captions(spark), path, "file", "caption")
    write_sidecars(captions(spark, 3), path, "file", "caption", overwrite=True)
    assert sorted(os.listdir(path)) == ["000.txt", "001.txt", "002.txt"] and os.listdir(tmp_path) == ["captions"]


@pytest.mark.parametrize("fault", ["a task fails", "a name repeats", "no name", "a path"])
def test_no_sidecar_is_seen_of_a_failed_write(spark, tmp_path, fault):
    rows, path = captions(spark), f"{tmp_path}/captions"
    late = F.col("file") == "033.txt"
    bad = {
        "a task fails": rows.withColumn("caption", F.when(late, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("caption"))),
        "a name repeats": rows.withColumn("file", F.when(late, "000.txt").otherwise(F.col("file"))),
        "no name": rows.withColumn("file", F.when(~late, F.col("file"))), "a path": rows.withColumn("file", F.when(late, "../x.txt").otherwise(F.col("file"))),
    }[fault]
    with pytest.raises(Exception, match="broken|names|name of a file"):
        write_sidecars(bad, path, "file", "caption")
    assert os.listdir(tmp_path) == []
    write_sidecars(rows.limit(0), path, "file", "caption")
    assert os.listdir(path) == []


def test_crops_and_comparisons(spark, tmp_path):
    box = F.struct(*(F.lit(float(v)).alias(k) for k, v in (("x1", 0), ("y1", 1), ("x2", 512), ("y2", 513))))
    rows = spark.createDataFrame([(3, "c", None), (1, "a", None), (2, "b", "no_compatible_bucket")], "rank int, path string, skip string")
    planned = rows.withColumns({"strategy": F.lit("s"), "safety": F.lit("safe"), "reasons": F.lit("x;y"), "bucket": F.lit("512x512"), "crop": F.when(F.col("skip").isNull(), box), "focus": F.lit("identity"), "excluded": F.lit(0)})
    reports.write_crops(str(tmp_path), planned, "path")
    read = lambda name: [tuple(r) for r in spark.read.csv(f"{tmp_path}/{name}", header=True).collect()]
    assert [r[:2] for r in read("dataset_manifest")] == [("1", "a"), ("3", "c")] and read("dataset_manifest")[0][6:10] == ("0", "1", "512", "513")
    assert read("crop_skips") == [("2", "b", "no_compatible_bucket")]
    reports.write_crops(str(tmp_path), planned.filter("skip is null"), "path")
    assert not os.path.exists(f"{tmp_path}/crop_skips")
    reports.write_comparison(str(tmp_path), rows.select("path", "rank").union(spark.createDataFrame([("B", 9)], "path string, rank int")), "path", rows.agg(F.count("*").alias("n")))
    parts = sorted(p for p in os.listdir(tmp_path / "comparison") if p.endswith(".csv"))
    lines = [x for p in parts for x in (tmp_path / "comparison" / p).read_text().split()[1:]]
    assert lines == ["a,1", "B,9", "b,2", "c,3"] and spark.read.json(f"{tmp_path}/summary").first()["n"] == 3


def test_models(spark, tmp_path):
    """Registered files that are there, changed, missing, or stand twice."""
    for name, content in (("a/detect.bin", b"one"), ("a/embed.bin", b"two"), ("b/embed.bin", b"three"), ("other.bin", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    table = registry(spark, [ModelSpec("small", "detect", "detect.bin", sha(b"one")), ModelSpec("small", "embed", "embed.bin", sha(b"two"), "int8"), ModelSpec("small", "parse", "parse.bin", sha(b"z")), ModelSpec("large", "detect", "other.bin", None, licence="MIT")])
    got = sorted((r["role"], r["status"], r["bytes"]) for r in model_manifest(spark, str(tmp_path), table, "small").collect())
    assert got == [("detect", "ok", 3), ("embed", "corrupt", 5), ("embed", "ok", 3), ("parse", "missing", None)]
    assert [tuple(r)[:4] for r in model_manifest(spark, str(tmp_path), table, "large").collect()] == [("detect", "other.bin", "fp32", "MIT")]
    with pytest.raises(ValueError, match="profile"):
        model_manifest(spark, str(tmp_path), table, "none")
    with pytest.raises(ValueError, match="two models"):
        registry(spark, [ModelSpec("p", "r", "a"), ModelSpec("p", "r", "b")])
