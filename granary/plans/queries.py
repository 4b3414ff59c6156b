"""The queries of the curation engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import boxes, signals
from granary.functions.names import config_digest, ranked_name
from granary.functions.vectors import cosine, weighted_centroid
from granary.operators import crops
from granary.operators.matching import match_person, suppress
from granary.operators.neighbours import hamming_pairs, reject_outliers
from granary.operators.retain import retain
from granary.operators.select import SelectOptions, select_with_policy
from granary.sources.media import with_scores
from granary.sources.reports import decided
from granary.sources.views import detections, frames, images, observations, table

LEAST_SIMILARITY, LEAST_WIDTH, LEAST_QUALITY, MOST_YAW, REFERENCES = 0.05, 48.0, 0.15, 60.0, 50
BUCKETS = [(w, h) for w in (512, 768, 1024) for h in (512, 768, 1024)]


def centroids(obs: DataFrame) -> DataFrame:
    """The centroid of each label's references, weighted by quality."""
    q = signals.quality(F.col("blur"), F.col("exposure"), F.col("resolution"), F.col("margin"))
    return weighted_centroid(obs.filter(F.col("media_id") < REFERENCES), "vector", q, ["label"])


def candidates(spark: SparkSession, sf_dir: str, least: float = LEAST_SIMILARITY, label: int = 0) -> DataFrame:
    """Observations with similarity to the centroid of a label, composite quality, bins, status and reason."""
    obs = observations(spark, sf_dir)
    target = centroids(obs).filter(F.col("label") == label).select("centroid")  # one row
    obs = obs.crossJoin(F.broadcast(target)).withColumn("similarity", F.round(cosine(F.col("vector"), F.col("centroid")), 6)).drop("centroid", "vector")
    obs = obs.withColumns({
        "quality_score": F.round(signals.quality(F.col("blur"), F.col("exposure"), F.col("resolution"), F.col("margin")), 6),
        "threshold": F.round(signals.adaptive_threshold(least, F.col("yaw")), 6),
        "scale_bin": signals.scale_bin(F.col("ratio")), "pose_bin": signals.pose_bin(F.col("yaw")), "light_bin": signals.lighting_bin(F.col("luma")),
    })
    reason = signals.gate_reason(*(F.col(c) for c in ("similarity", "threshold", "width", "ratio", "blur", "exposure", "quality_score", "yaw")), LEAST_WIDTH, LEAST_QUALITY, MOST_YAW)
    obs = obs.withColumn("reason", reason)
    fine = (F.col("width") >= LEAST_WIDTH) & (F.col("ratio") >= 0.04) & (F.col("quality_score") >= LEAST_QUALITY) & (F.col("blur") >= 0.25 * LEAST_QUALITY) & (F.col("exposure") >= 0.5 * LEAST_QUALITY)
    fallback = fine & F.coalesce(F.abs("yaw") <= MOST_YAW, F.lit(True)) & (F.col("face_count") == 1) & (F.col("similarity") >= F.round(F.col("threshold") - 0.15, 6))
    base = signals.selection_score(F.col("similarity"), F.col("quality_score"), F.col("ratio"), F.col("yaw"), F.col("appearance"), least)
    return obs.withColumns({
        "status": F.when(F.col("reason").isNull(), "eligible").otherwise("rejected"), "fallback_eligible": fallback, "base": F.round(base, 6),
        "has_appearance": F.col("appearance").isNotNull(), "body_focused": (F.col("face_count") == 1) & (F.col("scale_bin") == "far") & F.col("body_confidence").isNotNull(),
    })


def q_cosine_to_centroid(spark, sf_dir):
    return candidates(spark, sf_dir).select("media_id", "similarity")


def q_weighted_centroid(spark, sf_dir):
    return centroids(observations(spark, sf_dir)).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def q_outlier_filter(spark, sf_dir):
    return reject_outliers(observations(spark, sf_dir).filter(F.col("media_id") < REFERENCES), "media_id", "label", "vector")


def q_quality_bins(spark, sf_dir):
    return candidates(spark, sf_dir).select("media_id", "quality_score", "threshold", "scale_bin", "pose_bin", "light_bin")


def q_gate_reason(spark, sf_dir):
    return candidates(spark, sf_dir).select("media_id", "status", "reason", "fallback_eligible")


def q_selection_score(spark, sf_dir):
    return candidates(spark, sf_dir).select("media_id", "base", "body_focused")


def q_distribution(spark, sf_dir):
    c = candidates(spark, sf_dir)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit("None")).alias("value")) for k in ("status", "reason", "scale_bin", "pose_bin", "light_bin"))))
    return c.select(kinds.alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def q_pool_order(spark, sf_dir):
    pool = candidates(spark, sf_dir).filter("status = 'eligible' or fallback_eligible")
    return pool.orderBy(F.desc("similarity"), F.desc("quality_score"), "media_id").select("media_id", "similarity", "quality_score")


def q_greedy_select(spark, sf_dir):
    """The first twenty picks among eligible rows; fallback rows come in only where those fall short."""
    return select_with_policy(candidates(spark, sf_dir), shortfall="fill")


def q_fill_select(spark, sf_dir):
    """150 picks, for which small tables need fallback rows."""
    return select_with_policy(candidates(spark, sf_dir), SelectOptions(150), "fill")


def q_best_detection(spark, sf_dir):
    best = F.max_by(F.struct("det", "score"), F.struct("score", -F.col("det")))
    return detections(spark, sf_dir).groupBy("image").agg(best.alias("b"), F.count("*").alias("n")).select("image", "b.det", "b.score", "n")


def _targets(d: DataFrame) -> DataFrame:
    order = F.struct("score", -F.col("det"), -F.col("part"), -F.col("supp"))
    return d.groupBy("image").agg(F.max_by(F.struct("det", "part", "supp", "box", "score"), order).alias("t"))


def q_overlap_review(spark, sf_dir):
    """Eligible images (target's score 0.5 or more) where another detection, expanded, meets the target's go to review."""
    d = detections(spark, sf_dir)
    both = d.join(_targets(d), "image")
    other = (F.col("det") != F.col("t.det")) | (F.col("part") != F.col("t.part")) | (F.col("supp") != F.col("t.supp"))
    hit = other & boxes.intersects(boxes.expand(F.col("box"), 0.40), boxes.expand(F.col("t.box"), 0.08))
    rows = both.groupBy("image").agg(F.count_if(hit).alias("n_overlaps"), F.max("t.score").alias("most"))
    status = F.when(F.col("most") < 0.5, "rejected").when(F.col("n_overlaps") > 0, "multiple_faces_review").otherwise("eligible")
    return rows.select("image", "n_overlaps", status.alias("status"))


def q_box_iou(spark, sf_dir):
    d = detections(spark, sf_dir)
    return d.join(_targets(d), "image").select("image", "det", "part", "supp", F.round(boxes.iou(F.col("box"), F.col("t.box")), 6).alias("iou"))


def _boxes(d: DataFrame) -> DataFrame:
    return d.select("image", ((F.col("det") * 1_000_000 + F.col("part")) * 10_000 + F.col("supp")).alias("id"), "box", "score")


def q_person_match(spark, sf_dir):
    """The other detection of each image that goes best with its target."""
    d = detections(spark, sf_dir)
    faces = _targets(d).select("image", F.col("t.box").alias("face"), F.struct("t.det", "t.part", "t.supp").alias("own"))
    rest = d.join(faces, "image").filter(F.struct("det", "part", "supp") != F.col("own"))
    return match_person(faces.select("image", "face"), _boxes(rest), "image").select("image", F.col("person.id").alias("person"))


def q_suppress(spark, sf_dir):
    return suppress(_boxes(detections(spark, sf_dir)), "image").select("image", "id", "score")


def q_safe_bounds(spark, sf_dir):
    """The part of each image's frame of 1200 by 1000 that shows its target and nothing of other detections."""
    d = detections(spark, sf_dir)
    both = d.join(_targets(d), "image")
    other = F.struct("det", "part", "supp") != F.struct("t.det", "t.part", "t.supp")
    rows = both.groupBy("image", "t").agg(F.sort_array(F.collect_list(F.when(other, F.col("box")))).alias("others"))  # a few lines an order
    width, height = F.lit(1200.0), F.lit(1000.0)
    region = crops.parsing_region(F.col("t.box"), width, height)
    return rows.select("image", crops.safe_bounds(width, height, F.col("t.box"), F.col("others"), region).alias("b")).select("image", "b.x1", "b.y1", "b.x2", "b.y2")


def q_hamming_pairs(spark, sf_dir):
    return hamming_pairs(observations(spark, sf_dir), "media_id", "image_hash", 16).select("left", "right", "distance")


def q_anti_reference(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return obs.join(obs.filter(F.col("media_id") < REFERENCES).select("media_id"), "media_id", "left_anti").select("media_id", "label")


def q_topk_per_source(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    return frames(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("source", "id", "score", "rank")


def q_video_retain(spark, sf_dir):
    return retain(frames(spark, sf_dir))


def q_sample_positions(spark, sf_dir):
    """Midpoints of equal parts of each source's time, half a sample a second, 120 at most, and the frames nearest to them."""
    span = frames(spark, sf_dir).groupBy("source").agg((F.floor(F.max("seconds")) - F.floor(F.min("seconds"))).alias("duration"), F.count("*").alias("frames")).filter("duration > 0")
    n = F.least(F.lit(120), F.greatest(F.lit(1), F.ceil(F.col("duration") * 0.5))).cast("long")
    parts = span.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.least(F.col("duration").cast("double"), (F.col("i") + 0.5) * (F.col("duration") / F.col("n")))
    frame = F.least(F.col("frames") - 1, F.bround(at * (F.col("frames") / F.col("duration"))).cast("long"))
    return parts.select("source", "i", F.round(at, 6).alias("seconds"), frame.alias("frame"))


def q_style_plan(spark, sf_dir):
    """The bucket of each image whose centred crop keeps most, then the larger one; images below all buckets go."""
    shapes = spark.createDataFrame([(w, h, i) for i, (w, h) in enumerate(BUCKETS)], "bw long, bh long, i int")
    both = images(spark, sf_dir).join(F.broadcast(shapes), (F.col("bw") <= F.col("width")) & (F.col("bh") <= F.col("height")))
    wide = F.col("width") * F.col("bh") > F.col("height") * F.col("bw")
    cw = F.when(wide, F.floor(F.col("height") * F.col("bw") / F.col("bh"))).otherwise(F.col("width"))
    ch = F.when(wide, F.col("height")).otherwise(F.floor(F.col("width") * F.col("bh") / F.col("bw")))
    both = both.withColumns({"cw": cw, "ch": ch})
    best = both.groupBy("image", "width", "height").agg(F.max_by(F.struct("bw", "bh", "cw", "ch"), F.struct(F.col("cw") * F.col("ch"), F.col("bw") * F.col("bh"), -F.col("i"))).alias("b"))
    left, top = F.floor((F.col("width") - F.col("b.cw")) / 2), F.floor((F.col("height") - F.col("b.ch")) / 2)
    return best.select("image", F.col("b.bw").alias("bucket_width"), F.col("b.bh").alias("bucket_height"), left.alias("x1"), top.alias("y1"), (left + F.col("b.cw")).alias("x2"), (top + F.col("b.ch")).alias("y2"))


def q_bucket_fit(spark, sf_dir):
    """The bucket nearest in shape to the middle half of each image that it can grow to in whole multiples."""
    rows = [(w, h, w // 256, h // 256, i) for i, (w, h) in enumerate(BUCKETS)]
    rows = [(w, h, a // (g := 2 if a == b == 2 else 3 if a == b == 3 else 4 if a == b == 4 else 2 if {a, b} == {2, 4} else 1), b // g, 256 * g, i) for w, h, a, b, i in rows]
    shapes = spark.createDataFrame(rows, "bw long, bh long, uw long, uh long, least long, i int")
    cw, ch = F.floor(F.col("width") / 2), F.floor(F.col("height") / 2)
    both = images(spark, sf_dir).crossJoin(F.broadcast(shapes)).withColumns({"cw": cw, "ch": ch})  # nine rows
    both = both.withColumn("k", F.greatest("least", F.ceil(F.col("cw") / F.col("uw")), F.ceil(F.col("ch") / F.col("uh"))))
    both = both.withColumns({"ww": F.col("k") * F.col("uw"), "wh": F.col("k") * F.col("uh")}).filter("ww <= width and wh <= height")
    miss = F.round(F.abs(F.log((F.col("bw") / F.col("bh")) / (F.col("cw") / F.col("ch")))), 9)
    best = both.groupBy("image").agg(F.min_by(F.struct("bw", "bh", "ww", "wh"), F.struct(miss, F.col("ww") * F.col("wh"), -F.col("bw") * F.col("bh"), F.col("i"))).alias("b"))
    return best.select("image", F.col("b.bw").alias("bucket_width"), F.col("b.bh").alias("bucket_height"), F.col("b.ww").alias("crop_width"), F.col("b.wh").alias("crop_height"))


def q_label_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("labels"), F.max("value").alias("most"))


def q_class_exclusion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    out = e.filter("event_type = 'error' and value > 50").select("user_id").distinct()
    return e.join(out, "user_id", "left_anti").select("event_id", "user_id")


def q_decision_manifest(spark, sf_dir):
    """What becomes of each observation when the first twenty of the pool are selected, and the names of their copies."""
    c = candidates(spark, sf_dir)
    out = decided(c, first_of_pool(c), "media_id")
    name = F.when(F.col("selected"), ranked_name(F.col("rank"), F.concat(F.col("media_id").cast("string"), F.lit(".jpg"))))
    return out.select("media_id", F.col("decision_reason").alias("decision"), name.alias("file"))


def first_of_pool(c: DataFrame, count: int = 20) -> DataFrame:
    """media_id and rank of the first rows of the pool: only they are ranked in one task."""
    order = (F.desc("similarity"), F.desc("quality_score"), "media_id")
    top = c.filter("status = 'eligible' or fallback_eligible").orderBy(*order).limit(count)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("media_id", "rank")


def q_config_digest(spark, sf_dir):
    i = images(spark, sf_dir)
    return i.select("image", config_digest(width=(F.col("width"), "long"), height=(F.when(F.col("image") % 5 != 0, F.col("height")), "long"), backend=(F.lit("stub"), "string"), sample_fps=(F.lit(0.5), "double"), image=(F.col("image"), "long")).alias("digest"))


def q_incremental_misses(spark, sf_dir):
    """Images whose size no longer fits what an earlier run noted, or that it didn't see."""
    i = images(spark, sf_dir)
    noted = i.filter("image % 3 <> 0").withColumn("width", F.col("width") + F.when(F.col("image") % 5 == 0, 1).otherwise(0))
    return i.join(noted, ["image", "width", "height"], "left_anti").select("image", "width", "height")


def q_vote_class(spark, sf_dir):
    o = observations(spark, sf_dir)
    parts = (F.col("appearance"), F.col("body_confidence"), F.when(F.col("media_id") % 2 == 0, F.col("exposure")))
    most = signals.strongest({"first": F.col("exposure"), "second": F.col("margin"), "third": F.col("luma")}, "none")
    ratio = signals.range_bin(F.col("appearance"), [(0.0, 0.3, "narrow"), (0.35, 0.6, "even"), (0.65, 1.0, "wide")], "between")
    return o.select("media_id", signals.vote_level(*parts).alias("level"), signals.vote_level(*parts, confidence=F.col("luma")).alias("sure_level"), most.alias("most"), ratio.alias("ratio"))


def q_set_ops(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    parts = [o.intersect(c).withColumn("op", F.lit("both")), c.subtract(o).withColumn("op", F.lit("only_customer")), o.union(c).distinct().withColumn("op", F.lit("any"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("op").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def q_window_counts(spark, sf_dir):
    """Events by type and five minutes, as granary.streaming counts them from a stream."""
    from granary.streaming.windows import window_counts

    return window_counts(table(spark, sf_dir, "events"))


def q_scorer_hook(spark, sf_dir):
    """Rows that pass the cheap gates reach a scorer that each task opens once; the others keep nulls."""
    c = candidates(spark, sf_dir).select("media_id", "quality_score", "status")

    def open_scorer():
        return lambda part: pd.DataFrame({"score": (part["quality_score"] * 0.5 + part["media_id"] % 2 * 0.25).round(6)})

    return with_scores(c, open_scorer, "score double", F.col("status") == "eligible").select("media_id", "score")


def queries() -> dict:
    from granary.plans import hooks, media, runs

    found = {**globals(), **vars(media), **vars(runs), **vars(hooks)}
    return {name: f for name, f in found.items() if name.startswith("q_")}
