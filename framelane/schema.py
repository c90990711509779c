"""Schemas of the files and tables the package reads."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


INT, LONG, DBL, STR, BOOL = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
DOUBLES = T.ArrayType(DBL)

ANNOTATIONS = _s(
    info=_s(mask_root=STR),
    videos=T.ArrayType(_s(id=LONG, name=STR, fps=DBL, total_frames=INT)),
    images=T.ArrayType(_s(id=LONG, frame_index=INT, file_name=STR, width=INT, height=INT)),
    categories=T.ArrayType(_s(id=INT, name=STR)),
    annotations=T.ArrayType(
        _s(
            id=LONG, image_id=LONG, bbox=DOUBLES, category_id=INT, track_id=INT, area=DBL, iscrowd=INT, mask_path=STR,
            metadata=_s(area_px=DBL, centroid=DOUBLES, perimeter_px=DBL, equivalent_diameter_px=DBL),
        )
    ),
)

PREDICTION = _s(
    frame_index=STR, bbox=DOUBLES, score=DBL, confidence=DBL, components=T.MapType(STR, DBL), is_fallback=BOOL,
    bbox_source=STR,
)

PREDICTIONS = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("experiment", STR), ("model", STR), ("subject_id", STR), ("video_id", STR), ("frame_index", INT),
            ("x", DBL), ("y", DBL), ("w", DBL), ("h", DBL), ("score", DBL), ("confidence", DBL),
            ("components", T.MapType(STR, DBL)), ("is_fallback", BOOL), ("bbox_source", STR),
            ("seg", _s(mask_path=STR, score=DBL, area=DBL, perimeter=DBL, eq_diam=DBL, cx=DBL, cy=DBL)),
        )
    ]
)

STAGE = _s(name=STR, kind=STR, status=STR, duration_sec=DBL)
EXPERIMENT = _s(
    experiment=_s(name=STR),
    dataset=_s(split=_s(method=STR, loso=BOOL, subject=STR, total_folds=INT)),
    stages=T.ArrayType(STAGE),
    created_at=STR,
    metrics=T.MapType(STR, DBL),
    _broken=STR,
)
