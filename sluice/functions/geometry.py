"""Detections: boxes, frontal faces, zones, rule classifier inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nine blocks of two by two cells on a four by four grid, in order.
ZONES = ("TOP_LEFT", "TOP_CENTER", "TOP_RIGHT", "CENTER_LEFT", "CENTER_CENTER", "CENTER_RIGHT", "BOTTOM_LEFT", "BOTTOM_CENTER", "BOTTOM_RIGHT")
ACCEPTED_ZONES = tuple(z for z in ZONES if not z.endswith("_CENTER"))
#: Reasons and their categories.
CATEGORY_OF = {
    "FaceTooSmall": "Face",
    "FaceTooLarge": "Face",
    "FaceNotInAcceptedZone": "Face",
    "TooManyFaces": "Face",
    "TooFewFrontalFaces": "Face",
    "TooLittleFaceSkin": "Face",
    "TooMuchSkinOutsideFace": "Face",
    "TooMuchText": "Text",
    "BlockedByMetadata": "Metadata",
}


def overlap(x: Column, y: Column, w: Column, h: Column, left, top, width, height) -> Column:
    """Area shared by a box and a rectangle."""
    dx = F.least(x + w, left + width) - F.greatest(x, left)
    dy = F.least(y + h, top + height) - F.greatest(y, top)
    return F.greatest(dx, F.lit(0.0)) * F.greatest(dy, F.lit(0.0))


def box_area_percent(box: Column, width: float, height: float) -> Column:
    """F16: share of the image that the box covers, clipped to it."""
    d = lambda n: box[n].cast("double")
    return overlap(d("x"), d("y"), d("width"), d("height"), F.lit(0.0), F.lit(0.0), F.lit(width), F.lit(height)) * 100 / (width * height)


def is_frontal(face: Column) -> Column:
    """eyes at least 1 apart and tilted by 30 degrees at most, nose near their middle."""
    right, left, nose = (face["landmarks"][n] for n in ("right_eye", "left_eye", "nose"))
    dx, dy = (left[c].cast("double") - right[c].cast("double") for c in ("x", "y"))
    distance = F.hypot(dx, dy)
    tilt = F.abs(F.atan2(dy, F.abs(dx)))
    offset = F.abs(nose["x"].cast("double") - (left["x"].cast("double") + right["x"].cast("double")) / 2)
    return (distance >= 1) & (tilt <= F.lit(3.141592653589793 / 6)) & (offset < 0.35 * distance)


def zone(box: Column, width: float, height: float) -> Column:
    """the zone that the box overlaps most; among equals the last."""
    d = lambda n: box[n].cast("double")
    w, h = width / 4, height / 4
    areas = [F.struct(overlap(d("x"), d("y"), d("width"), d("height"), F.lit(k % 3 * w), F.lit(k // 3 * h), F.lit(2 * w), F.lit(2 * h)).alias("area"), F.lit(k).alias("k")) for k in range(9)]
    return F.get(F.array(*map(F.lit, ZONES)), F.array_max(F.array(*areas))["k"])


def iou(a: Column, b: Column) -> Column:
    """intersection over union of two boxes; 0 without an area."""
    d = lambda c, n: c[n].cast("double")
    both = overlap(*(d(a, n) for n in ("x", "y", "width", "height")), *(d(b, n) for n in ("x", "y", "width", "height")))
    union = d(a, "width") * d(a, "height") + d(b, "width") * d(b, "height") - both
    return F.when(union > 0, both / union).otherwise(0.0)


def category(reason: Column) -> Column:
    """F29."""
    return F.create_map(*[F.lit(x) for kv in CATEGORY_OF.items() for x in kv])[reason]


def full_text(lines: Column) -> Column:
    """The lines' text, joined by newlines."""
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def text_length(lines: Column) -> Column:
    """Characters but white space."""
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x["text"], r"\s", "")))


def failed_rules(area: Column, text_percent: Column, face_skin: Column, outside_skin: Column, thresholds: dict, categories: set[str]) -> Column:
    """The names of the rules that a single frontal face fails, in order."""
    rules = [
        (area < thresholds["min_face_area_pct"], "FaceTooSmall"),
        (area > thresholds["max_face_area_pct"], "FaceTooLarge"),
        (face_skin < thresholds["min_face_skin_pct"], "TooLittleFaceSkin"),
        (outside_skin > thresholds["max_outside_face_skin_pct"], "TooMuchSkinOutsideFace"),
    ]
    if "Text" in categories:
        rules.append((text_percent > thresholds["max_text_area_pct"], "TooMuchText"))
    return F.array_compact(F.array(*[F.when(c, n) for c, n in rules]))


def reasons(n_faces: Column, n_frontal: Column, failed: Column, where: Column) -> Column:
    """More than one face, or no frontal one, settles it; else all failed rules count, and only
    an item that fails none is judged by its zone. No faces at all are too few."""
    one = lambda n: F.array(F.lit(n))
    none = F.array().cast("array<string>")
    rest = F.when(F.size(failed) > 0, failed).when(~where.isin(*ACCEPTED_ZONES), one("FaceNotInAcceptedZone")).otherwise(none)
    return F.when(F.coalesce(n_faces, F.lit(0)) > 1, one("TooManyFaces")).when(F.coalesce(n_frontal, F.lit(0)) == 0, one("TooFewFrontalFaces")).otherwise(rest)
