"""String functions for names, paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that count as one.
DOUBLE_SUFFIXES = (".nii.gz", ".npy.h5")


def base_name(path: Column) -> Column:
    """The last component of a path; both slashes separate."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def norm_name(s: Column) -> Column:
    """Trimmed, lower case, hyphens and spaces as underscores."""
    return F.lower(F.translate(F.trim(s), "- ", "__"))


def safe_stem(path: Column) -> Column:
    """The file name without its suffix; double suffixes go as one; a name that begins with its only dot stays."""
    return F.regexp_replace(base_name(path), r"(?<=.)[.](nii[.]gz|npy[.]h5|[^.]*[^.])$", "")


def copy_suffix(path: Column) -> Column:
    """The suffix a copy gets: .nii.gz as it is, .h5 for .npy.h5, else the last suffix in lower case, or empty."""
    name = base_name(path)
    last = F.lower(F.regexp_extract(name, r"(?<=.)([.][^.]+)$", 1))
    return F.when(name.endswith(".nii.gz"), ".nii.gz").when(name.endswith(".npy.h5"), ".h5").otherwise(last)


def sanitize_id(s: Column) -> Column:
    """Trimmed, slashes and runs of white space as one underscore each."""
    return F.regexp_replace(F.regexp_replace(_strip(s), r"[/\\]", "_"), r"\s+", "_")


def class_from_suffix(case_id: Column) -> Column:
    """h, dr or g from the endings _h, _dr and _g, else null."""
    return F.when(case_id.endswith("_h"), "h").when(case_id.endswith("_dr"), "dr").when(case_id.endswith("_g"), "g")


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def safe_tag(s: Column) -> Column:
    """A tag as the end of a name: an underscore, then all but letters, digits, underscore and hyphen as underscore; empty for blank and null."""
    t = _strip(F.coalesce(s, F.lit("")))
    return F.when(t == "", "").otherwise(F.concat(F.lit("_"), F.regexp_replace(t, r"[^\p{L}\p{N}_-]", "_")))


def safe_file_name(s: Column) -> Column:
    """All but letters, digits, underscore, hyphen and dot as underscore; ``unknown`` for blank and null."""
    t = F.coalesce(F.nullif(_strip(s), F.lit("")), F.lit("unknown"))
    return F.regexp_replace(t, r"[^\p{L}\p{N}_.-]", "_")


def parse_list(s: Column) -> Column:
    """The trimmed, non-empty items of a comma list."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def sample_name(split: Column, case_id: Column, slice_idx: Column, ext: str = ".npy") -> Column:
    """split__case[__zNNN].ext; indexes above 999 keep all their digits."""
    z = F.when(slice_idx.isNotNull(), F.format_string("__z%03d", slice_idx)).otherwise("")
    return F.concat(split, F.lit("__"), case_id, z, F.lit(ext))


def pair_id(slice_name: Column, instance: Column, component: Column) -> Column:
    """stem__iNNN_cK."""
    return F.format_string("%s__i%03d_c%d", safe_stem(slice_name), instance, component)


def key_part(s: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def html_escape(s: Column) -> Column:
    """The five signs of HTML as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(sign), F.lit(entity))
    return s
