"""Column expressions over names, labels and report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the splits in folder names, as the manifest scan and the tree inspection know them.
MANIFEST_SPLITS = {"train": "train", "val": "val", "valid": "val", "validation": "val", "test": "test"}
INSPECTION_SPLITS = MANIFEST_SPLITS | {"training": "train", "testing": "test"}


def class_parts(class_name: Column) -> tuple[Column, Column]:
    """(diagnosis, drawing type): what stands before and after the FIRST blank; no blank gives an empty type."""
    at = F.instr(class_name, " ")
    first = F.when(at > 0, F.substring_index(class_name, " ", 1)).otherwise(class_name)
    rest = F.when(at > 0, F.substr(class_name, at + F.lit(1))).otherwise(F.lit(""))
    return first, rest


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def name_and_number(stem_: Column) -> tuple[Column, Column]:
    """Prefix and trailing number of a stem, one underscore between them dropped; no number gives (stem, -1)."""
    rx = r"^(.*?)_?(\d+)$"
    hit = stem_.rlike(rx)
    return (
        F.when(hit, F.regexp_extract(stem_, rx, 1)).otherwise(stem_),
        F.when(hit, F.regexp_extract(stem_, rx, 2).try_cast("int")).otherwise(F.lit(-1)),
    )


def augmented_base(stem_: Column) -> tuple[Column, Column]:
    """Stem without augmentation marks (``_augN`` once or more, or ``.rf.`` with a hex code), and whether it had any."""
    aug, rf = r"(_aug\d+)+$", r"\.rf\.[0-9a-fA-F]{8,}$"
    a, r = stem_.rlike(aug), stem_.rlike(rf)
    return F.when(a, F.regexp_replace(stem_, aug, "")).when(r, F.regexp_replace(stem_, rf, "")).otherwise(stem_), a | r


def split_of_path(path: Column, aliases: dict[str, str] = MANIFEST_SPLITS) -> Column:
    """Split of the first folder that is a known spelling, else ``?``."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    parts = F.transform(F.split(F.lower(F.translate(path, "\\", "/")), "/"), lambda p: F.try_element_at(known, p))
    return F.coalesce(F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0)), F.lit("?"))


#: How subject ids stand in file names. A marked number first, else a number that opens the name.
SUBJECT_MARKED = r"(?i)(?:^|[_\-\s])(?:p|pt|pac|paciente|subj|subject|sujeito)[_\-]?(\d+)"
SUBJECT_LEADING = r"^(\d+)[_\-]"


def known_split(split: Column) -> Column:
    """``train``, ``val`` or ``test`` of a split label in any spelling; null for anything else."""
    known = F.create_map(*[F.lit(x) for kv in INSPECTION_SPLITS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(split)))


def subject_of(stem_: Column) -> Column:
    """Subject id guessed from a stem: a number marked as a patient's or subject's, else the number the stem begins with; else null."""
    found = [F.nullif(F.regexp_extract(stem_, rx, 1), F.lit("")) for rx in (SUBJECT_MARKED, SUBJECT_LEADING)]
    return F.coalesce(*found)


def label_path(image: Column) -> Column:
    """Where an image's label file lies: the LAST folder called images becomes labels, the extension ``.txt``."""
    moved = F.regexp_replace(image, r"(?i)^(.*[/\\])images([/\\].*)$", "$1labels$2")
    return F.regexp_replace(moved, r"\.[^./\\]*$", ".txt")


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"\W+", "_"), "^_+|_+$", ""), 1, 24)


def metric_key(header: Column) -> Column:
    """A header in lower case with runs of other signs than letters, digits and underscores as one underscore; underscores of its own stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(header)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def interval_text(value: Column, lo: Column, hi: Column) -> Column:
    """``0.869 [0.851-0.883]``; null where the value is."""
    return F.when(value.isNotNull(), F.format_string("%.3f [%.3f-%.3f]", value, lo, hi))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def reading(prob: Column) -> Column:
    """A careful sentence on a score: which examples it is nearer to, and that neither threshold nor model was validated. Null for null."""
    side = F.when(prob >= 0.5, "parkinson").otherwise("healthy")
    text = F.format_string("Score %.2f, nearer to the %s examples of the data set. The cut at 0.5 is untuned; nothing was validated on new patients.", prob, side)
    return F.when(prob.isNotNull(), text)


def positive(diagnosis: Column) -> Column:
    """1 for parkinson, 0 for any other diagnosis, null for null."""
    return (diagnosis == "parkinson").cast("int")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
