"""Quality signals, bins, gates and scores of observations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def quality(blur: Column, exposure: Column, resolution: Column, margin: Column) -> Column:
    return 0.40 * clamp(blur / 8) + 0.25 * exposure + 0.20 * resolution + 0.15 * margin


def adaptive_threshold(least: float, yaw: Column) -> Column:
    """The similarity asked for falls by up to 0.10 as a view turns away; a null angle is frontal."""
    return F.lit(least) - 0.10 * F.least(F.lit(1.0), F.abs(F.coalesce(yaw, F.lit(0))) / 45)


def scale_bin(ratio: Column) -> Column:
    return F.when(ratio >= 0.22, "close").when(ratio >= 0.10, "medium").otherwise("far")


def pose_bin(yaw: Column) -> Column:
    return (
        F.when(yaw.isNull(), "unknown").when(yaw <= -40, "left_profile").when(yaw < -15, "left_three_quarter")
        .when(yaw >= 40, "right_profile").when(yaw > 15, "right_three_quarter").otherwise("frontal")
    )


def lighting_bin(luma: Column) -> Column:
    return F.when(luma < 0.30, "dark").when(luma > 0.72, "bright").otherwise("normal")


def gate_reason(similarity, threshold, width, ratio, blur, exposure, quality_, yaw, least_width: float, least_quality: float, most_yaw: float | None) -> Column:
    """The first reason to reject an observation, null if there is none."""
    sharp, exposed = blur >= 0.25 * least_quality, exposure >= 0.50 * least_quality
    turned = (F.abs(yaw) > most_yaw) if most_yaw is not None else F.lit(False)
    return (
        F.when(similarity < threshold, "below_similarity").when((width < least_width) | (ratio < 0.04), "face_too_small")
        .when(~sharp, "low_quality_blur").when(~exposed, "low_quality_exposure").when(quality_ < least_quality, "low_quality")
        .when(F.coalesce(turned, F.lit(False)), "pose_too_extreme")
    )


def selection_score(similarity: Column, quality_: Column, ratio: Column, yaw: Column, appearance: Column, least: float) -> Column:
    """The base score of a candidate, by one of two linear forms."""
    n = clamp((F.coalesce(similarity, F.lit(-1.0)) - least) / max(1e-6, 1 - least))
    f = clamp(ratio / 0.22)
    p = F.when(yaw.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(yaw) / 45))
    a = clamp((appearance - 0.65) / 0.30)
    return F.when(appearance.isNull(), 0.50 * n + 0.25 * quality_ + 0.15 * f + 0.10 * p).otherwise(0.30 * n + 0.40 * a + 0.12 * quality_ + 0.08 * f + 0.10 * p)


def vote_level(*signals: Column, confidence: Column | None = None) -> Column:
    """Level of the mean of the signals that are there: high over 0.55, medium over 0.28, else low.

    Unknown without any signal, or where the confidence is under 0.40.
    """
    mean = vote_mean(*signals)
    level = F.when(mean.isNull(), "unknown").when(mean > 0.55, "high").when(mean > 0.28, "medium").otherwise("low")
    return level if confidence is None else F.when(F.coalesce(confidence, F.lit(0.0)) < 0.40, "unknown").otherwise(level)


def vote_mean(*signals: Column) -> Column:
    """Mean of the signals that are there; null without any."""
    there = F.filter(F.array(*signals), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def strongest(votes: dict[str, Column], otherwise: str, over: float = 0.4) -> Column:
    """The name of the largest vote, the first of equal ones; `otherwise` where none is over the level."""
    best = F.greatest(F.lit(0.0), *(F.coalesce(v, F.lit(0.0)) for v in votes.values()))
    out = F.lit(otherwise)
    for name, v in reversed(votes.items()):
        out = F.when((v == best) & (best > over), name).otherwise(out)
    return out


def range_bin(value: Column, bounds: list[tuple[float, float, str]], otherwise: str) -> Column:
    """The name of the first range (low, high, both included) that holds a value; `unknown` for null."""
    out = F.lit(otherwise)
    for low, high, name in reversed(bounds):
        out = F.when((value >= low) & (value <= high), name).otherwise(out)
    return F.when(value.isNull(), "unknown").otherwise(out)


def exposure_signal(mean_luma: Column, clipped: Column) -> Column:
    """How well a region is lit: its mean luma near the middle, and few clipped pixels (shares of 1)."""
    return F.greatest(F.lit(0.0), 1 - 2 * clipped) * F.greatest(F.lit(0.0), 1 - F.abs(mean_luma - 0.5))


def resolution_signal(width: Column, scale: Column) -> Column:
    return F.least(F.lit(1.0), width * F.greatest(F.lit(1.0), scale) / 160)


def margin_signal(box: Column, width: Column, height: Column) -> Column:
    """Room between a box and the nearest edge of its image, as a share of a fifth of the box's width."""
    room = F.least(box["x1"], box["y1"], width - box["x2"], height - box["y2"])
    return clamp(room / F.greatest(F.lit(1e-9), 0.20 * (box["x2"] - box["x1"])))


def visible_width(box: Column, width: Column) -> Column:
    """Width of the part of a box inside its image."""
    return F.greatest(F.lit(0.0), F.least(width, box["x2"]) - F.greatest(F.lit(0.0), box["x1"]))


def appearance(face: Column, head: Column) -> Column:
    return 0.65 * face + 0.35 * head


def frame_score(similarity: Column, quality_: Column, width: Column) -> Column:
    return 0.70 * similarity + 0.25 * quality_ + 0.05 * F.least(F.lit(1.0), width / 160)


def frame_gate(similarity: Column, width: Column, frame_width: Column, least: float, least_width: float) -> Column:
    """Whether a frame's target is near and large enough to be scored."""
    return (similarity >= max(0.0, least - 0.15)) & (width >= least_width) & (width / F.greatest(F.lit(1), frame_width) >= 0.04)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-100.0), F.least(F.lit(100.0), x))))


def early_reason(readable: Column, error: Column, found: Column) -> Column:
    """Why an image has no target: unreadable, a failed detector, no detection; null if it has one."""
    return F.when(~readable, "unreadable").when(error.isNotNull(), F.concat(F.lit("backend_error: "), error)).when(found == 0, "no_face")


def decision_reason(selected: Column, status: Column, reason: Column) -> Column:
    return F.when(selected & (status == "eligible"), "selected_strong").when(selected, "selected_fallback").when(status == "eligible", "not_selected").otherwise(reason)


def session_status(prepared: Column, wanted: Column, action: Column, crops: Column) -> Column:
    return (
        F.when(~crops, "completed").when(prepared < wanted, "completed_with_skips").when(action == "backfill", "completed_with_replacements")
        .when(action == "tight", "completed_after_tighter_crop").otherwise("completed")
    )


def training_focus(body_focused: Column) -> Column:
    return F.when(body_focused, "body").otherwise("identity")


def point_visible(visibility: Column, presence: Column) -> Column:
    return (visibility >= 0.35) & (presence >= 0.60)


def pose_of_landmarks(points: Column) -> Column:
    """yaw, pitch, roll in degrees from five points (eyes, nose, mouth corners); null where they are too close.

    points is an array of structs (x, y).
    """
    a, b, nose, c, d = (F.get(points, F.lit(i)) for i in range(5))
    ex, ey = b["x"] - a["x"], b["y"] - a["y"]
    wide = F.hypot(ex, ey)
    eye_x, eye_y = (a["x"] + b["x"]) * 0.5, (a["y"] + b["y"]) * 0.5
    mouth_x, mouth_y = (c["x"] + d["x"]) * 0.5, (c["y"] + d["y"]) * 0.5
    down = mouth_y - eye_y
    yaw = F.greatest(F.lit(-75.0), F.least(F.lit(75.0), F.try_divide(nose["x"] - (eye_x + mouth_x) * 0.5, wide) * 90))
    pitch = F.greatest(F.lit(-45.0), F.least(F.lit(45.0), (F.try_divide(nose["y"] - eye_y, down) - 0.5) * 90))
    sound = (F.size(points) >= 5) & (wide >= 1) & (F.abs(down) >= 1)
    return F.when(sound, F.struct(yaw.alias("yaw"), pitch.alias("pitch"), F.degrees(F.atan2(ey, ex)).alias("roll")))


def suggested_threshold(base: float, median_delta: Column) -> Column:
    return F.when(median_delta.isNull(), F.lit(base)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + median_delta)), 4))
