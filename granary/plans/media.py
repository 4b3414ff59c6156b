"""Queries on pictures and frames: crops and manifests, style plans, signals, frames with their gates, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import boxes, signals
from granary.functions.names import frame_name, parsed_bucket
from granary.operators import crops
from granary.plans.queries import BUCKETS, _targets
from granary.sources.folders import delete, shared_folder
from granary.sources.views import detections, frames, images, images_of, observations, table
from granary.streaming.batches import read_batches, run_available
from granary.streaming.ordered import mended, retain_stream
from granary.streaming.sources import run_sources, source_rows, source_state
from granary.streaming.windows import first_seen, read_frames, window_counts

NO_BODY = "struct<box:struct<x1:double,y1:double,x2:double,y2:double>,confidence:double,points:array<struct<x:double,y:double,kind:string,reach:double>>,bones:array<struct<ax:double,ay:double,bx:double,by:double>>>"


def _crop_rows(spark, sf_dir) -> DataFrame:
    """All images, of 1600 by 1400: target, other boxes, a body in every third one, tight in every fifth."""
    d = detections(spark, sf_dir)
    both = d.join(_targets(d), "image")
    other = F.struct("det", "part", "supp") != F.struct("t.det", "t.part", "t.supp")
    rows = both.groupBy("image", "t").agg(F.sort_array(F.collect_list(F.when(other, F.col("box")))).alias("others"))  # a few lines an order
    t = F.col("t.box")
    body = F.struct(boxes.box(t["x1"] - 60, t["y1"] - 40, t["x2"] + 60, t["y2"] + 420).alias("box"), F.lit(0.9).alias("confidence"), F.array().cast("array<struct<x:double,y:double,kind:string,reach:double>>").alias("points"), F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>").alias("bones"))
    scale = signals.scale_bin((t["x2"] - t["x1"]) / 800)
    return rows.select(
        "image", F.lit(1600).alias("width"), F.lit(1400).alias("height"), F.when(F.col("image") % 97 != 0, t).alias("target"), "others", F.lit(None).cast(crops.BOX).alias("semantic"),
        F.when(F.col("image") % 3 == 0, body).cast(NO_BODY).alias("body"), scale.alias("scale_bin"), (scale == "far").alias("body_focused"), F.when(F.col("image") % 5 == 0, "tight").otherwise("standard").alias("mode"),
    )


def _crops(spark, sf_dir) -> DataFrame:
    return crops.prepare_dataset(_crop_rows(spark, sf_dir))


def q_crop_plan(spark, sf_dir):
    """The crop of every image, or why it has none."""
    return _crops(spark, sf_dir).select("image", "skip", "strategy", "safety", "reasons", "bucket", "crop.x1", "crop.y1", "crop.x2", "crop.y2", "focus", "excluded")


def q_tight_retry(spark, sf_dir):
    """The crops of all images, those without one planned again tight around the target."""
    return crops.retry_tight(_crops(spark, sf_dir)).select("image", "skip", "strategy", "bucket", "crop.x1", "crop.y1", "crop.x2", "crop.y2", "retried")


def q_crop_skips(spark, sf_dir):
    """How many images each reason leaves without a crop, and how many each strategy serves."""
    c = _crops(spark, sf_dir)
    return c.groupBy(F.coalesce("skip", F.lit("")).alias("skip"), F.coalesce("strategy", F.lit("")).alias("strategy")).agg(F.count("*").alias("n"))


def q_bucket_geometry(spark, sf_dir):
    """The bucket crop around the middle third of each image, inside all of it, with that third as the required box."""
    i = images(spark, sf_dir)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    crop = boxes.box(F.floor(w / 3), F.floor(h / 3), F.floor(2 * w / 3), F.floor(2 * h / 3))
    fit = i.select("image", "width", "height", crops.fit_bucket(crop, boxes.box(F.lit(0), F.lit(0), w, h), crop).alias("f"))
    return fit.select("image", F.col("f.width").alias("bucket_width"), F.col("f.height").alias("bucket_height"), "f.box.x1", "f.box.y1", (F.col("f.box.x2") - F.col("f.box.x1")).alias("crop_width"), (F.col("f.box.y2") - F.col("f.box.y1")).alias("crop_height"))


def q_style_focus(spark, sf_dir):
    """Style crops of images around a focus box in a corner; every fourth image has none."""
    i = images(spark, sf_dir)
    w, h = F.col("width"), F.col("height")
    focus = F.when(F.col("image") % 4 != 0, boxes.box(w / 2, h / 4, w * 0.75, h / 2))
    plan = i.select("image", crops.style_plan(w, h, focus, BUCKETS).alias("p"), (w * h).alias("whole")).filter("p is not null")
    return plan.select("image", F.col("p.width").alias("bucket_width"), F.col("p.height").alias("bucket_height"), "p.box.x1", "p.box.y1", "p.box.x2", "p.box.y2", boxes.kept_percent(F.col("p.kept"), F.col("whole")).alias("kept"))


def q_box_signals(spark, sf_dir):
    """Signals of every detection in its frame of 1200 by 1000: visible width, room, squares around it, original pixels."""
    d, b = detections(spark, sf_dir), F.col("box")
    w, h = F.lit(1200.0), F.lit(1000.0)
    square, big = boxes.square_around(b, w, h, 1.6, 0.1), boxes.rescale(b, F.lit(2.0), F.lit(1.5))
    return d.select(
        "image", "det", "part", "supp", signals.visible_width(b, w).alias("visible"), F.round(signals.margin_signal(b, w, h), 6).alias("margin"), F.round(signals.resolution_signal(b["x2"] - b["x1"], F.lit(1.5)), 6).alias("resolution"),
        F.round(signals.exposure_signal(F.col("score"), F.col("score") / 4), 7).alias("exposure"), square["x1"].alias("sx1"), square["y1"].alias("sy1"), square["x2"].alias("sx2"), square["y2"].alias("sy2"), big["x2"].alias("bx2"), big["y2"].alias("by2"),
    )


def q_box_hull(spark, sf_dir):
    """The smallest box around all detections of each image."""
    d = detections(spark, sf_dir)
    rows = d.groupBy("image").agg(*(f(f"box.{c}").alias(c) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))))
    return rows.select("image", boxes.hull(F.array(boxes.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))).alias("b")).select("image", "b.*")


def q_frame_gate(spark, sf_dir):
    """Scores of the frames that pass the gate before scoring, and the names of their files."""
    f = frames(spark, sf_dir)
    similarity, width = F.col("score") / 100, (20 + F.col("id") % 200).cast("double")
    f = f.filter(signals.frame_gate(similarity, width, F.lit(1000), 0.55, 48.0))
    name = frame_name(F.concat(F.lit("clip "), F.col("source").cast("string")), F.concat(F.lit("/v/"), F.col("source").cast("string")), F.col("id").cast("double"))
    return f.select("source", "id", F.round(signals.frame_score(similarity, F.lit(0.5), width), 7).alias("frame_score"), name.alias("file"))


def q_early_reasons(spark, sf_dir):
    """Why images have no target, from files, detector errors and numbers of detections; an image without any row has no face."""
    i = images(spark, sf_dir)
    n = detections(spark, sf_dir).groupBy("image").agg(F.count("*").alias("found"))
    rows = i.join(n, "image", "left").select("image", (F.col("image") % 11 != 0).alias("readable"), F.when(F.col("image") % 13 == 0, F.lit("out of memory")).alias("error"), F.coalesce("found", F.lit(0)).alias("found"))
    return rows.select("image", signals.early_reason(F.col("readable"), F.col("error"), F.col("found")).alias("reason"))


def q_landmark_pose(spark, sf_dir):
    """Angles from five points of each observation; every twelfth observation's points are too close."""
    i = F.col("media_id")
    p = [(100 + i % 7, 120 + i % 5), (160 + i % 9, 118 + i % 11), (128 + i % 13, 150 + i % 3), (105, 185), (155, 186)]
    points = F.array(*(F.struct((F.when(i % 12 == 0, 100).otherwise(x)).cast("double").alias("x"), F.when(i % 12 == 0, 100).otherwise(y).cast("double").alias("y")) for x, y in ((F.lit(a) if isinstance(a, int) else a, F.lit(b) if isinstance(b, int) else b) for a, b in p)))
    return observations(spark, sf_dir).select("media_id", signals.pose_of_landmarks(points).alias("p")).select("media_id", *(F.round(f"p.{c}", 6).alias(c) for c in ("yaw", "pitch", "roll")))


def q_label_ratios(spark, sf_dir):
    """The share of each label among the pixels of an image's mask (here: lines of an order)."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("label"))
    n = d.groupBy("image", "label").agg(F.count("*").alias("n"))
    return n.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("image")), 6)).select("image", "label", "ratio")


def q_buckets_parsed(spark, sf_dir):
    """Bucket sizes written as text; null where a side isn't allowed."""
    i = images(spark, sf_dir).select("image", F.concat((F.col("width") - F.col("width") % 256).cast("string"), F.when(F.col("image") % 9 == 0, "*").otherwise("x"), (F.col("height") - F.col("height") % 256).cast("string")).alias("t"))
    return i.select("image", parsed_bucket(F.col("t")).alias("b")).select("image", "b.width", "b.height")


def q_frame_provenance(spark, sf_dir):
    """Records with the source and time of the frame they come from, where they come from one."""
    o = observations(spark, sf_dir).select("media_id")
    f = frames(spark, sf_dir).filter("id % 2 = 0").select(F.col("id").alias("media_id"), "source", F.round("seconds", 3).alias("seconds"))
    return o.join(f, "media_id", "left")


def q_capped_size(spark, sf_dir):
    """The size of each image once its longer side is 960 at most."""
    return images(spark, sf_dir).select("image", boxes.capped_size(F.col("width"), F.col("height"), 960).alias("s")).select("image", "s.*")


def streamed(spark, rows: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once it has read all that is there, with the number of the batch; its state goes then."""
    folder, schema = shared_folder(spark), rows.schema
    run_available(rows, folder, mode)
    delete(spark, f"{folder}/state")
    return read_batches(spark, folder, schema.add("batch", "long"))


def _stream(spark, sf_dir, name) -> DataFrame:
    """A table as a stream of its files, one a batch."""
    whole = table(spark, sf_dir, name)
    one = whole.inputFiles()[0].endswith(f"/{name}.parquet")  # a file, else a folder of files
    return read_frames(spark, sf_dir if one else f"{sf_dir}/{name}.parquet", whole.schema, name=f"{name}.parquet" if one else "*.parquet")


def q_stream_window(spark, sf_dir):
    """Counts of events by type and five minutes, from a stream; the same as q_window_counts gives, in whatever order files come."""
    found = streamed(spark, window_counts(_stream(spark, sf_dir, "events")), "update")
    key = ("start", "event_type")
    return found.groupBy(*key).agg(F.max_by(F.struct("n", "cents"), "batch").alias("x")).select(*key, "x.n", "x.cents")


def q_stream_dedup(spark, sf_dir):
    """Events whose id the stream sees for the first time."""
    return streamed(spark, first_seen(_stream(spark, sf_dir, "events")), "append").select("event_id", "user_id")


def q_stream_retain(spark, sf_dir):
    """Each source's best frames in event-time order, kept in the state of a stream; sources with late frames are read again."""
    e = _stream(spark, sf_dir, "events")
    time = F.col("ts").cast("timestamp")
    f = e.select("ts", F.col("user_id").alias("source"), F.col("event_id").alias("id"), (F.unix_micros(time) / 1e6).alias("seconds"), F.col("value").alias("score"), (F.col("event_id") * 2654435761 % 4611686018427387904).alias("hash"))
    return mended(streamed(spark, retain_stream(f, time), "update"), frames(spark, sf_dir))


def split_images(row: dict):
    """A stand-in for the extraction of a video: a few rows a source; sources of a thirteenth break off in the middle."""
    n = int(row["path"])
    for k in range(n % 3 + 1):
        if n % 13 == 0 and k == n % 3:
            raise ValueError(f"source {n} breaks off")
        yield k, float(row["bytes"] * (k + 1))


def q_stream_sources(spark, sf_dir):
    """The state of each source after a stream of sources, some of which fail, and the rows made of those that don't."""
    schema, folder = "k int, value double", shared_folder(spark)
    stream = images_of(_stream(spark, sf_dir, "part"))
    sources = stream.select(F.col("image").cast("string").alias("path"), (F.col("width") * F.col("height")).alias("bytes"), F.timestamp_seconds("image").alias("modified"))
    run_sources(sources, lambda: split_images, schema, folder, "a")
    delete(spark, f"{folder}/state")
    made = source_rows(spark, folder, schema).groupBy("path").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    state = source_state(spark, folder).join(made, "path", "left")
    return state.select(F.col("path").cast("long").alias("image"), "status", "error", F.coalesce("n", F.lit(0)).alias("n"), "total")
