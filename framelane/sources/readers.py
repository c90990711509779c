"""Readers: annotation, prediction, label, manifest and experiment files become DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelane import schema
from framelane.functions import keys as K

# Extensions of video files.
VIDEO_EXTENSIONS = ("avi", "mp4", "mov", "mkv", "wmv")


def read_coco_vid(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Annotation files to one row per box; annotated frames without a box keep a row with null box.

    The frame is ``frame_index``, else image id - 1. ``ann_pos`` is the place in
    the file, which decides what "first box" means. ``multiline`` is for one
    document per file; without it every line is a document (large sets split).
    """
    doc = spark.read.schema(schema.ANNOTATIONS).option("multiLine", multiline).json(path)
    doc = doc.withColumn("source_path", F.input_file_name())
    doc = doc.withColumn("video_id", F.coalesce(F.col("videos")[0]["name"], K.stem(F.element_at(F.split("source_path", "/"), -1))))
    boxes_type, images_type = (schema.ANNOTATIONS[n].dataType for n in ("annotations", "images"))
    none = F.lit(None)
    images = F.transform(
        F.coalesce("images", F.array().cast(images_type)),
        lambda im: F.struct(
            im["id"].alias("image_id"), F.coalesce(im["frame_index"], (im["id"] - 1).cast("int")).alias("_frame"), none.cast("int").alias("ann_pos"),
            none.cast(boxes_type.elementType).alias("a"),
        ),
    )
    boxes = F.transform(
        F.coalesce("annotations", F.array().cast(boxes_type)),
        lambda a, i: F.struct(a["image_id"].alias("image_id"), none.cast("int").alias("_frame"), i.alias("ann_pos"), a.alias("a")),
    )
    boxes = F.filter(boxes, lambda e: e["image_id"].isNotNull() & e["a"]["bbox"].isNotNull())
    # images and boxes of a document become rows that meet by image, so no box looks for its image in a list
    doc = doc.withColumn("_doc", F.monotonically_increasing_id())
    rows = doc.select("_doc", "video_id", "source_path", F.col("info.mask_root").alias("mask_root"), F.inline(F.concat(images, boxes)))
    image = Window.partitionBy("_doc", "image_id")
    rows = rows.withColumns({"frame_index": F.min("_frame").over(image), "_drawn": F.count("ann_pos").over(image)})
    rows = rows.where(F.col("ann_pos").isNotNull() | (F.col("_drawn") == 0))
    a, meta = F.col("a"), F.col("a.metadata")
    return rows.where(F.col("frame_index").isNotNull()).select(
        "video_id",
        "frame_index",
        "ann_pos",
        *[a["bbox"][i].alias(n) for i, n in enumerate(("x", "y", "w", "h"))],
        a["category_id"].alias("category_id"),
        a["track_id"].alias("track_id"),
        F.coalesce(meta["area_px"], a["area"]).alias("area"),
        meta["perimeter_px"].alias("perimeter"),
        meta["equivalent_diameter_px"].alias("eq_diam"),
        a["mask_path"].alias("mask_path"),
        "mask_root",
        "source_path",
    )


def read_predictions(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Prediction lists (``<experiment>/test/predictions/<tracker>.json``) to rows in file order.

    Rows without a usable frame number are skipped; a box that is not four
    numbers fails the read.
    """
    raw = spark.read.schema(schema.PREDICTION).option("multiLine", multiline)
    rows = raw.json(path).withColumn("source_path", F.input_file_name())
    place = r"([^/]+)/test/predictions/([^/]+?)\.json"
    rows = rows.withColumns(
        {
            "experiment": F.regexp_extract("source_path", place, 1),
            "tracker": F.regexp_extract("source_path", place, 2),
            "frame_index": F.expr("try_cast(frame_index AS INT)"),
            "pos": F.monotonically_increasing_id(),
        }
    ).where(F.col("frame_index").isNotNull())
    ok = F.col("bbox").isNotNull() & (F.size("bbox") == 4) & ~F.exists("bbox", lambda v: v.isNull())
    bad = F.raise_error(F.concat(F.lit("bad bbox in "), F.col("source_path"))).cast("array<double>")
    rows = rows.withColumn("bbox", F.when(ok, F.col("bbox")).otherwise(bad))
    return rows.select(
        "experiment", "tracker", "frame_index", "pos",
        *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x", "y", "w", "h"))],
        "score", "confidence", "components", F.coalesce("is_fallback", F.lit(False)).alias("is_fallback"), "bbox_source",
        "source_path",
    )


def read_labels(spark: SparkSession, path: str, inline_comments: bool = False, binary: bool = False) -> DataFrame:
    """``subject label`` lines; comments, blanks and bad labels are skipped, the last line of a subject wins.

    ``inline_comments`` also cuts text after a ``#``; ``binary`` turns every label but 1 into 0.
    """
    lines = spark.read.text(path).withColumn("no", F.monotonically_increasing_id())
    text = F.trim(F.regexp_replace("value", "#.*$", "") if inline_comments else F.col("value"))
    parts = F.split(text, r"\s+")
    rows = lines.where((text != "") & ~F.startswith(text, F.lit("#")) & (F.size(parts) >= 2))
    rows = rows.select("no", parts[0].alias("subject_id"), parts[1].alias("raw"))
    rows = rows.withColumn("label", F.expr("try_cast(raw AS INT)")).where(F.col("label").isNotNull())
    out = rows.groupBy("subject_id").agg(F.max_by("label", "no").alias("label"))
    return out.withColumn("label", (F.col("label") == 1).cast("int")) if binary else out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files under ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def scan_videos(paths: DataFrame, root: str) -> DataFrame:
    """Video files of a listing (column ``path``) with subject, stem and whether a JSON lies beside them."""
    clean = F.regexp_replace("path", "^file:/*", "/")
    rows = paths.select(clean.alias("path"))
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    rows = rows.select("path", base.alias("base"), ext.alias("ext"))
    notes = rows.where(F.col("ext") == "json").select("base", F.lit(True).alias("has_annotation")).distinct()
    videos = rows.where(F.col("ext").isin(*VIDEO_EXTENSIONS)).join(notes, "base", "left")
    return videos.select(
        F.col("path").alias("video_path"),
        K.dataset_subject(F.col("path"), root).alias("subject_id"),
        K.stem(F.element_at(F.split("path", "/"), -1)).alias("video_stem"),
        F.coalesce("has_annotation", F.lit(False)).alias("has_annotation"),
    )


# Names a manifest may use for its two columns.
IMAGE_NAMES = ("image_path", "path", "image")
LABEL_NAMES = ("label", "y", "target")


def read_roi_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Image list as csv, jsonl or json with any of the usual column names."""
    if kind == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        names = [*IMAGE_NAMES, *LABEL_NAMES]
        ddl = ", ".join(f"`{n}` string" for n in names)
        raw = spark.read.schema(ddl).option("multiLine", kind == "json").json(path)
    else:
        raise ValueError(f"unknown manifest kind {kind!r}")

    def any_of(names: Sequence[str]) -> Column:
        have = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    rows = raw.select(any_of(IMAGE_NAMES).alias("image_path"), any_of(LABEL_NAMES).alias("raw"))
    rows = rows.where(F.col("image_path").isNotNull())
    out = rows.select("image_path", F.expr("try_cast(raw AS INT)").alias("label"))
    if out.isEmpty():
        raise ValueError(f"manifest {path} holds no image")
    return out


def read_experiments(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``metadata.json`` files; one that cannot be parsed stays as a row with status BROKEN."""
    raw = (
        spark.read.schema(schema.EXPERIMENT)
        .option("multiLine", multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )
    raw = raw.withColumn("source_path", F.input_file_name())
    s = F.transform(F.coalesce("stages", F.array().cast(schema.EXPERIMENT["stages"].dataType)), lambda x: F.lower(F.coalesce(x["status"], F.lit("unknown"))))
    status = (
        F.when(F.col("_broken").isNotNull(), "BROKEN")
        .when(F.array_contains(s, "failed"), "FAILED")
        .when(F.array_contains(s, "skipped"), "PARTIAL")
        .otherwise("OK")
    )
    return raw.select(
        F.col("experiment.name").alias("name"),
        status.alias("status"),
        F.col("dataset.split").alias("split"),
        K.is_loso(F.col("dataset.split")).alias("is_loso"),
        F.expr("try_to_timestamp(created_at)").alias("created_at"),
        "stages",
        "metrics",
        "source_path",
    )


# What the summaries of the stages hold.
DETECTION_FIELDS = ("success_rate_50", "success_rate_75", "success_auc", "fps", "iou_mean", "ce_mean")
SEGMENTATION_FIELDS = ("dice_mean", "iou_mean", "centroid_mean", "fps_mean")
CLASSIFICATION_FIELDS = {"accuracy": (), "f1": ("f1_positive",), "precision": ("precision_positive",), "recall": ("recall_positive",), "balanced_accuracy": ()}


def _number(v: Column) -> Column:
    """A JSON number as double; anything else, also a number in quotes, is null."""
    kind = F.schema_of_variant(v)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))


def _mean(numbers: Column) -> Column:
    kept = F.filter(numbers, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))


def _mean_of(parts: str, name: str) -> Column:
    return _mean(F.transform(parts, lambda x: _number(F.try_variant_get(x, f"$.{name}", "variant"))))


def stage_summaries(docs: DataFrame, metadata: str, classification: str | None = None) -> DataFrame:
    """One row per experiment: means over the trackers, and the segmenters of each tracker, of its metadata text.

    Adds ``status`` (BROKEN for text that is no JSON object), ``n_stages``, ``det_*``, ``seg_*`` and ``clf_*``. Stages differ in
    what they hold, so they are read as variants: a part that is absent or of another kind gives nulls. Where the
    metadata has no classification metrics, those of the text ``classification`` stand in.
    """
    meta = F.try_parse_json(F.col(metadata))
    rows = docs.withColumn("_m", F.when(F.schema_of_variant(meta).startswith("OBJECT"), meta))

    def part(path: str, kind: str = "map<string,variant>") -> Column:
        return F.try_variant_get("_m", path, kind)

    status = F.transform(F.coalesce(part("$.stages", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.lower(F.coalesce(F.try_variant_get(x, "$.status", "string"), F.lit("unknown"))))
    detection = F.map_values(F.coalesce(part("$.metrics.detection"), F.create_map().cast("map<string,variant>")))
    segmentation = F.flatten(
        F.transform(
            F.map_values(F.coalesce(part("$.metrics.segmentation"), F.create_map().cast("map<string,variant>"))),
            lambda x: F.map_values(F.coalesce(F.try_variant_get(x, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))),
        )
    )
    own = part("$.metrics.classification")
    own = F.when(F.size(own) > 0, own)
    if classification:
        own = F.coalesce(own, F.try_variant_get(F.try_parse_json(F.col(classification)), "$", "map<string,variant>"))
    rows = rows.withColumns({"_s": status, "_det": detection, "_seg": segmentation, "_clf": own})
    made = {
        "status": F.when(F.col("_m").isNull(), "BROKEN").when(F.array_contains("_s", "failed"), "FAILED").when(F.array_contains("_s", "skipped"), "PARTIAL").otherwise("OK"),
        "n_stages": F.when(F.col("_m").isNotNull(), F.size("_s")),
    }
    made |= {f"det_{n}": _mean_of("_det", n) for n in DETECTION_FIELDS}
    made |= {f"seg_{n}": _mean_of("_seg", n) for n in SEGMENTATION_FIELDS}
    made |= {f"clf_{n}": F.coalesce(*[_number(F.col("_clf")[k]) for k in (n, *more)]) for n, more in CLASSIFICATION_FIELDS.items()}
    return rows.withColumns(made).select(*docs.columns, *made)


def roi_trace(df: DataFrame, key: Sequence[str], trace: str = "trace") -> DataFrame:
    """A map of frame -> {bbox, bbox_source, is_fallback} to rows; keys that are no frame numbers are skipped."""
    rows = df.select(*key, F.explode(F.map_entries(trace)).alias("e"))
    rows = rows.select(*key, F.expr("try_cast(e.key AS INT)").alias("frame_index"), F.col("e.value").alias("v"))
    return rows.where(F.col("frame_index").isNotNull() & F.col("v").isNotNull()).select(
        *key, "frame_index", F.col("v.bbox_source").alias("bbox_source"), F.col("v.is_fallback").alias("is_fallback")
    )


def merge_datasets(
    first: DataFrame, second: DataFrame, prefix: tuple[str, str], groups: tuple[str, str], skip: DataFrame | None = None
) -> DataFrame:
    """Union of two annotation sets: mask paths of the second move below a new prefix, groups are named, subjects skipped."""
    old, new = prefix
    moved = F.when(F.startswith(F.col("mask_path"), F.lit(old)), F.concat(F.lit(new), F.substring(F.col("mask_path"), F.lit(len(old) + 1), F.length("mask_path")))).otherwise(F.col("mask_path"))
    out = first.withColumn("group", F.lit(groups[0])).unionByName(
        second.withColumns({"mask_path": moved, "group": F.lit(groups[1])}), allowMissingColumns=True
    )
    return out if skip is None else out.join(skip.select("subject_id").distinct(), "subject_id", "left_anti")
