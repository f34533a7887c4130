"""Sidecar documents: one JSON object per image, probed with Variant paths; a broken document is null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: operation types and the older keys that stand for them
OPERATION_TYPES = ["face_detection", "object_detection", "ball_detection", "quality_assessment", "game_detection", "yolov8", "unknown"]
LEGACY_KEYS = {"Face_detector": "face_detection", "Object_detector": "object_detection", "Ball_detector": "ball_detection", "Quality_assessor": "quality_assessment", "Game_detector": "game_detection", "yolov8": "yolov8"}
COUNT_LISTS = ["faces", "objects", "detections"]
TOOL_KEYS = ["tool_name", "detector", "model", "algorithm"]
#: nested objects are searched to this depth by column expressions; detection_counts, tool_names and with_operation in sources/sidecars.py know no depth
DEPTH = 3


def parsed(doc: Column) -> Column:
    return F.try_parse_json(doc)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _has(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def operation_type(doc: Column, path: Column, types: list[str] = OPERATION_TYPES, legacy: dict[str, str] = LEGACY_KEYS) -> Column:
    """The document's own type if it is known, else that of the first older key in it, else unknown; binary files are unknown."""
    v = parsed(doc)
    own = _get(v, "$.sidecar_info.operation_type", "string")
    old = F.coalesce(*[F.when(_has(v, f"$.{k}"), F.lit(t)) for k, t in legacy.items()])
    return F.when(F.lower(path).rlike(r"\.(bin|rkyv)$"), "unknown").otherwise(F.coalesce(F.when(own.isin(types), own), old, F.lit("unknown")))


def _paths(keys: list[str], depth: int = DEPTH) -> list[str]:
    level, out = ["$"], ["$"]
    for _ in range(depth - 1):
        level = [f"{p}.{k}" for p in level for k in keys]
        out += level
    return out


def counted(v: Column, path: str = "$") -> Column:
    """The count, or the length of the first list of detections, of the object at a path of a variant; null without one."""
    lists = [F.size(_get(v, f"{path}.{k}", "array<variant>")) for k in COUNT_LISTS]
    return F.coalesce(_get(v, f"{path}.count", "bigint"), *[n.cast("bigint") for n in lists])


def detection_count(doc: Column) -> Column:
    """Count or list length of the document, else of the objects nested under data, result or detection to DEPTH; 0 if none.

    sidecars.detection_counts searches to any depth.
    """
    v = parsed(doc)
    here, *nested = _paths(["data", "result", "detection"])
    return F.coalesce(counted(v, here), *[F.when(counted(v, p) > 0, counted(v, p)) for p in nested], F.lit(0))


def tool_name(doc: Column) -> Column:
    v = parsed(doc)
    return F.coalesce(*[_get(v, f"{p}.{k}", "string") for p in _paths(["data", "result", "metadata"]) for k in TOOL_KEYS])


def contains_operation(doc: Column, op: str) -> Column:
    """The operation is a key, the document's type, or either within data or result."""
    v = parsed(doc)
    found = F.lit(False)
    for p in _paths(["data", "result"]):
        found = found | _has(v, f"{p}.{op}") | F.coalesce(_get(v, f"{p}.sidecar_info.operation_type", "string") == op, F.lit(False))
    return found


def sidecar_fields(doc: Column, older: bool = False) -> dict[str, Column]:
    """Processing time, success (false by default; true in the older form, which reads data and metadata) and size."""
    v = parsed(doc)
    roots = ["$.data", "$.metadata", "$"] if older else ["$.sidecar_info"]
    pick = lambda k, t: F.coalesce(*[_get(v, f"{r}.{k}", t) for r in roots])
    return {
        "processing_time": pick("processing_time", "double"),
        "success": F.coalesce(pick("success", "boolean"), F.lit(older)),
        "data_size": F.coalesce(pick("data_size", "bigint"), F.lit(0)),
    }
