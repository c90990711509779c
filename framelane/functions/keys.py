"""Names and keys derived from paths and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def path_parts(path: Column) -> Column:
    """Parts of a path without empty ones, ``.`` and ``..``."""
    return F.filter(F.split(slashes(F.trim(path)), "/"), lambda p: ~p.isin("", ".", ".."))


def path_key(path: Column) -> Column:
    """Case-blind key of a path for table lookups."""
    return F.lower(F.concat_ws("/", path_parts(path)))


def stem(name: Column) -> Column:
    """File name without its last extension; names that only start with a dot stay."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def subject_token(token: Column) -> Column:
    """Leading digits of a token, else the token itself; null when blank."""
    t = F.trim(token)
    return F.coalesce(_blank(F.regexp_extract(t, r"^(\d+)", 1)), _blank(t))


def relative(path: Column, root: str) -> Column:
    """Path below ``root``; the bare file name for paths outside it."""
    p = slashes(path)
    base = root.replace("\\", "/").rstrip("/") + "/"
    inside = F.startswith(p, F.lit(base))
    return F.when(inside, F.substring(p, F.lit(len(base) + 1), F.length(p))).otherwise(
        F.element_at(F.split(p, "/"), -1)
    )


def dataset_subject(path: Column, root: str) -> Column:
    """First folder below the root, else the file stem; leading digits win."""
    parts = path_parts(relative(path, root))
    own = stem(F.element_at(path_parts(path), -1))
    top = F.when(F.size(parts) > 1, parts[0]).otherwise(stem(parts[0]))
    return F.coalesce(subject_token(top), subject_token(own), own)


def video_subject(path: Column, root: str | None = None) -> Column:
    """Folder name below the root; without one the file's leading digits, its prefix before ``_``, or its stem."""
    own = stem(F.element_at(path_parts(path), -1))
    folder = F.lit(None).cast("string")
    if root is not None:
        parts = path_parts(relative(path, root))
        folder = F.when(F.size(parts) > 1, subject_token(parts[0]))
    digits = _blank(F.regexp_extract(own, r"^(\d+)", 1))
    prefix = F.when(F.contains(own, F.lit("_")), subject_token(F.split(own, "_")[0]))
    return F.coalesce(folder, digits, prefix, subject_token(own), own)


def video_label(path: Column) -> Column:
    """``parent/stem`` of a path with any separators; ``unknown`` for a blank one."""
    parts = path_parts(path)
    n = F.size(parts)
    name = stem(F.try_element_at(parts, F.lit(-1)))
    both = F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), name)
    return F.when(F.coalesce(F.trim(path), F.lit("")) == "", F.lit("unknown")).when(n >= 2, both).when(
        n == 1, name
    ).otherwise(F.lit("unknown"))


def fold_label(subject: Column, fallback: Column | None = None) -> Column:
    """Numeric subjects become ``loso%03d``; labels that start with loso are lower-cased; blank takes the fallback."""
    s = F.trim(subject.cast("string"))
    digits = F.when(s.rlike(r"^\d+$"), F.concat(F.lit("loso"), F.lpad(s.cast("long").cast("string"), 3, "0")))
    long_digits = F.when(s.rlike(r"^\d+$") & (F.length(s.cast("long").cast("string")) > 3), F.concat(F.lit("loso"), s.cast("long").cast("string")))
    default = F.lit("loso") if fallback is None else F.coalesce(_blank(fallback), F.lit("loso"))
    return (
        F.when(s.isNull() | (s == ""), default)
        .when(long_digits.isNotNull(), long_digits)
        .when(digits.isNotNull(), digits)
        .when(F.startswith(F.lower(s), F.lit("loso")), F.lower(s))
        .otherwise(s)
    )


def is_loso(split: Column) -> Column:
    """Whether a run's split settings (method, loso, subject, total_folds) say leave-one-subject-out."""
    by_method = F.lower(F.trim(F.coalesce(split["method"], F.lit("")))) == "loso"
    folds = F.coalesce(split["total_folds"].cast("int"), F.lit(0))
    return by_method | F.coalesce(split["loso"], F.lit(False)) | (split["subject"].isNotNull() & (folds > 1))


# Recording names and their modality.
RECORDING_MODALITY = {
    "doppler": "Doppler",
    "Grasp": "Grasp",
    "Relax": "Relax",
    "Rest": "Rest",
    "Rest post": "Rest post",
    "D": "Doppler",
    "G-R": "Relax",
    "R-G": "Grasp",
    "R1": "Rest",
    "R2": "Rest post",
}


def recording_modality(name: Column) -> Column:
    """Modality of a recording name: table first, then a trailing d, then hand-movement words; null if none fits."""
    table = F.create_map(*[F.lit(x) for kv in RECORDING_MODALITY.items() for x in kv])
    low = F.lower(F.trim(name))
    return F.coalesce(
        table[name],
        F.when(F.endswith(low, F.lit("d")), F.lit("Doppler"))
        .when(F.contains(name, F.lit("伸握伸")), F.lit("Relax"))
        .when(F.contains(name, F.lit("握伸")) | F.contains(name, F.lit("伸握")), F.lit("Grasp")),
    )


def entity_key(subject: Column, video: Column) -> Column:
    return F.concat_ws("/", subject, video)


def display_id(entity: Column) -> Column:
    """Entity id without its subject prefix."""
    return F.element_at(F.split(entity, "/"), -1)
