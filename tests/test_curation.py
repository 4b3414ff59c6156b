"""Operators of the curation engine on hand-made rows and against plain versions."""

import hashlib
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import names, signals
from granary.functions.boxes import box
from granary.functions.text import vector_digest
from granary.functions.vectors import mean_of_units
from granary.operators import crops
from granary.operators.neighbours import bands, hamming_classes, hamming_pairs
from granary.operators.retain import offer
from granary.operators.select import SelectOptions, backfill, greedy_select
from granary.sources import reports
from granary.sources.media import scan_media

POOL = "media_id long, similarity double, quality_score double, base double, image_hash long, scale_bin string, pose_bin string, light_bin string, has_appearance boolean, body_focused boolean"


def pool(spark, rows):
    return spark.createDataFrame([(i, s, 0.5, s, h, b, "frontal", "normal", False, b == "far") for i, s, h, b in rows], POOL)


@pytest.mark.parametrize("radius", [0, 1, 3, 6, 7, 8, 12, 16, 20])
def test_hamming_pairs(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 6)]
    rows = [(0, 0), (1, 0x1111111111111111), (2, None), (3, 0)]
    for k in range(60):
        flip = sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 22)), replace=False))
        rows.append((10 + k, base[k % 6] ^ flip))
    got = {tuple(r) for r in hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", radius).collect()}
    mask = (1 << 64) - 1
    near = ((i, j, ((a ^ b) & mask).bit_count()) for (i, a), (j, b) in itertools.combinations(rows, 2) if a is not None and b is not None)
    assert got == {x for x in near if x[2] <= radius}
    parts, _ = bands(radius)
    assert sum(w for _, w in parts) == 64


def test_hamming_classes(spark):
    members, pairs = hamming_classes(spark.createDataFrame([(k, 5) for k in range(50)] + [(99, 4)], "id long, h long"), "id", "h", 2)
    assert members.count() == 51 and [tuple(r) for r in pairs.collect()] == [(0, 99, 1)]


def test_retain_keeps_order():
    """A frame takes the place of the best near one, and the rest is ordered anew."""
    kept: list = []
    frames = [(0.5, 0.0, 0xFFFF, 1), (0.6, 10.0, 0xFFFF0000, 2), (0.9, 0.5, 0xFFFF00000000, 3), (0.7, 10.5, 0x0F0F0F0F0F0F, 4)]
    for f in frames:
        kept = offer(kept, f)
    assert [f[3] for f in kept] == [3, 4]
    assert offer(kept, (0.1, 0.6, 0, 5)) == kept
    assert [f[3] for f in offer(kept, (0.8, 99.0, 0x7777777777777777, 6))] == [3, 6, 4]


def test_greedy_selection(spark):
    """Body quota, near duplicates, exclusions and seeds."""
    rows = [(k, 0.9, (k * 0x9E3779B97F4A7C15) % 2**62, "medium") for k in range(20)] + [(100 + k, 0.6, (k * 0xC2B2AE3D27D4EB4F + 77) % 2**62, "far") for k in range(8)]
    found = [r["media_id"] for r in greedy_select(pool(spark, rows), SelectOptions(20, -1)).orderBy("rank").collect()]
    assert len(found) == 20 and sum(k >= 100 for k in found) >= 6
    two = [(1, 0.9, 0, "medium"), (2, 0.8, 1, "medium"), (3, 0.7, (1 << 62) - 1, "medium")]
    assert [r["media_id"] for r in greedy_select(pool(spark, two), SelectOptions(2)).orderBy("rank").collect()] == [1, 3]
    gone = spark.createDataFrame([(2,)], "media_id long")
    assert [r["media_id"] for r in greedy_select(pool(spark, two), SelectOptions(2, -1), [3], gone).orderBy("rank").collect()] == [3, 1]


def test_backfill(spark):
    """Holes are filled in their places by further candidates; failed ones are not tried again."""
    rows = [(k, 0.9 - k / 100, (k * 0x9E3779B97F4A7C15) % 2**62, "medium") for k in range(8)]
    p, tried = pool(spark, rows), []

    def prepare(part):
        ids = [r["media_id"] for r in part.collect()]
        tried.extend(ids)
        return part.filter("media_id not in (0, 2, 3)")

    picks = greedy_select(p, SelectOptions(4, -1))
    got = {r["rank"]: r["media_id"] for r in backfill(p, picks, prepare, SelectOptions(4, -1)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and sorted(got.values()) == [1, 4, 5, 6] and sorted(tried) == sorted(set(tried))
    few = backfill(p, picks, lambda part: part.filter("media_id = 1"), SelectOptions(4, -1)).collect()
    assert [r["media_id"] for r in few] == [1]


def prepared(spark, width, height, target, others=(), mode="standard", scale="close"):
    as_box = lambda b: box(*(F.lit(float(x)) for x in b))
    rows = spark.range(1).select(
        F.lit(width).alias("width"), F.lit(height).alias("height"), as_box(target).alias("target"), (F.array(*map(as_box, others)) if others else crops.no_boxes()).alias("others"), F.lit(None).cast(crops.BOX).alias("semantic"),
        F.lit(None).cast("struct<box:struct<x1:double,y1:double,x2:double,y2:double>,confidence:double,points:array<struct<x:double,y:double,kind:string,reach:double>>,bones:array<struct<ax:double,ay:double,bx:double,by:double>>>").alias("body"),
        F.lit(scale).alias("scale_bin"), F.lit(False).alias("body_focused"), F.lit(mode).alias("mode"),
    )
    return crops.prepare_dataset(rows).first()


def test_prepare_dataset(spark):
    r = prepared(spark, 1600, 2000, (700, 300, 900, 550))
    w, h = map(int, r["bucket"].split("x"))
    c = r["crop"]
    assert r["skip"] is None and (c["x2"] - c["x1"]) * h == (c["y2"] - c["y1"]) * w and c["x1"] <= 700 and c["x2"] >= 900
    assert prepared(spark, 400, 400, (100, 100, 200, 200))["skip"] == "no_compatible_bucket"
    other = prepared(spark, 1600, 2000, (700, 300, 900, 550), [(1050, 320, 1250, 570)])
    assert other["skip"] is None and other["crop"]["x2"] <= 1050 and "faces_excluded" in other["strategy"] and other["excluded"] == 1
    assert prepared(spark, 1600, 2000, (700, 300, 900, 550), [(880, 320, 1080, 570)])["skip"] == "head_zones_overlap"
    assert prepared(spark, 1600, 2000, (700, 300, 900, 550), mode="tight")["strategy"].startswith("identity_tight")


def test_means(spark):
    rows = spark.createDataFrame([(0, [3.0, 0.0]), (0, [0.0, 1.0])], "g int, v array<double>")
    assert np.allclose(mean_of_units(rows, "v", ["g"]).first()["centroid"], [2**-0.5] * 2)
    for bad in ([(0, [0.0, 0.0])], [(0, [1.0, 0.0]), (0, [1.0])], [(0, [1.0, 0.0]), (0, [-1.0, 0.0])]):
        with pytest.raises(Exception, match="reference"):
            mean_of_units(spark.createDataFrame(bad, "g int, v array<double>"), "v", ["g"]).collect()


def test_names(spark):
    stems = ["a b/c", "???", "x" * 60, "a--b c  d", "é_ß.ж", "", None, "\U0001f600k²"]
    got = spark.createDataFrame([(s,) for s in stems], "s string").select(names.safe_stem(F.col("s")).alias("s")).collect()
    want = ["".join(c if c.isalnum() or c in "-_" else "_" for c in s or "")[:48] or "video" for s in stems]
    assert [r["s"] for r in got] == want and want[1] == "___" and want[3] == "a--b_c__d"
    assert spark.range(1).select(names.parsed_bucket(F.lit("768x1024")).alias("b")).first()["b"]["height"] == 1024
    assert spark.range(1).select(names.parsed_bucket(F.lit("700x1024")).alias("b")).first()["b"] is None
    rows = spark.createDataFrame([(1, "A.jpg", "/x/A.jpg"), (2, "a.JPG", "/y/a.JPG"), (3, "b", "/b")], "id int, name string, path string")
    files = {r["id"]: r["file"] for r in names.unique_names(rows, "id", "name", "path").collect()}
    assert files[1] == "A.jpg" and files[2].startswith("a_") and files[2].endswith(".JPG") and files[3] == "b" and len(files[2]) == 16


def test_digests_and_labels(spark):
    """As json.dumps with sorted keys and format() write them."""
    texts = ["plain", 'quo"te\\ \n\t', "ümlaut \U0001f600 \x7f\x01", "", None]
    rows = spark.createDataFrame([(t, i, None if i == 2 else i / 8 - 0.3, i % 2 == 0) for i, t in enumerate(texts)], "t string, n long, x double, b boolean")
    got = rows.select(names.config_digest(t=(F.col("t"), "string"), n=(F.col("n"), "long"), x=(F.col("x"), "double"), b=(F.col("b"), "boolean")).alias("d"), *(F.col(c) for c in "tnxb")).collect()
    for r in got:
        assert r["d"] == hashlib.sha256(json.dumps({c: r[c] for c in "tnxb"}, sort_keys=True).encode()).hexdigest()
    values = [0.0625, 0.9994999, -0.0004, 0.5, 1.0, 0.0005, 2.0015, None]
    cells = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select(names.contact_label(F.col("i"), F.lit("far"), F.lit("frontal"), F.col("v")).alias("s")).collect()
    assert [r["s"] for r in cells] == [f"{i}: far, frontal\nsim={'n/a' if v is None else f'{v:.3f}'}" for i, v in enumerate(values)]
    v = spark.createDataFrame([([0.5, -1.25],), (None,)], "v array<double>").select(vector_digest(F.col("v")).alias("d"), vector_digest(F.col("v"), 64).alias("e")).collect()
    assert v[0]["d"] == hashlib.sha256(np.array([0.5, -1.25], np.float32).tobytes()).hexdigest() and v[0]["e"] == hashlib.sha256(np.array([0.5, -1.25]).tobytes()).hexdigest() and v[1]["d"] is None


def test_signals(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert value(signals.vote_level(F.lit(0.55))) == "medium" and value(signals.vote_level(F.lit(0.9), confidence=F.lit(0.3))) == "unknown"
    assert value(signals.sigmoid(F.lit(0.0))) == 0.5
    assert value(signals.strongest({"a": F.lit(0.5), "b": F.lit(0.5)}, "none")) == "a" and value(signals.strongest({"a": F.lit(0.4)}, "none")) == "none"


def test_reports(spark, tmp_path):
    root = str(tmp_path / "out")
    records = spark.createDataFrame([(1, "eligible", None, "far"), (2, "rejected", "no_face", None), (3, "rejected", "low_quality", "far"), (4, "eligible", None, "close")], "id long, status string, reason string, scale_bin string")
    records = records.withColumns({"pose_bin": F.lit("frontal"), "light_bin": F.lit("normal")})
    selected = spark.createDataFrame([(1, 1), (3, 2)], "id long, rank int")
    reports.prepare_output(spark, root)
    reports.write_reports(root, records, selected, "id", 5, {"count": 5})
    report = {r["id"]: r["decision_reason"] for r in spark.read.csv(f"{root}/report", header=True).collect()}
    assert report == {"1": "selected_strong", "2": "no_face", "3": "selected_fallback", "4": "not_selected"}
    s = spark.read.json(f"{root}/summary").first()
    assert (s["requested"], s["selected"], s["rejected"], s["scale_bin_distribution"]["far"]) == (5, 2, 2, 2)
    with pytest.raises(FileExistsError):
        reports.prepare_output(spark, root)
    (tmp_path / "out" / "video_frames").mkdir()
    reports.prepare_output(spark, root, overwrite=True)
    assert not reports.exists(spark, f"{root}/report") and reports.exists(spark, f"{root}/video_frames")
    reports.write_ranked(f"{root}/manifest", selected, bom=True)
    assert next((tmp_path / "out" / "manifest").glob("part-*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    reports.write_ranked(f"{root}/manifest", selected.limit(0))
    assert not reports.exists(spark, f"{root}/manifest")
    with pytest.raises(ValueError, match="lies in"):
        reports.outside([f"{root}/a.jpg"], root)


def test_state_and_scans(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "in/c.png", "out/d.png", "outer/e.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = scan_media(spark, str(tmp_path), outside=str(tmp_path / "out"))
    assert [r["path"].rsplit("/", 1)[1] for r in files.collect()] == ["a.JPG", "c.png", "e.png"]
    with pytest.raises(ValueError, match="references"):
        reports.reference_set(files.filter("false"))
    path = f"{tmp_path}/state"
    assert reports.read_state(spark, path).isEmpty()
    news = files.select("path", F.when(F.col("path").endswith("e.png"), "error").otherwise("ok").alias("status"), "bytes", "modified", F.lit("k").alias("config"), F.lit(None).cast("string").alias("error"))
    reports.write_state(path, reports.read_state(spark, path), news)
    state = reports.read_state(spark, path)
    assert reports.to_process(files, state, "k").count() == 1 and reports.to_process(files, state, "other").count() == 3
    assert tuple(reports.run_counters(files, state, news, "k").first()) == (3, 2, 2, 1)
