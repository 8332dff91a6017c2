"""Keys of raters and essays apart from how they are spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rater_no(rater_id: Column) -> Column:
    """The number in a rater's id; null where there is none."""
    return F.regexp_extract(rater_id, r"(\d+)", 1).try_cast("bigint")


def essay_name(filename: Column) -> Column:
    """A Filename apart from case, outer blanks, separators and a ``.txt`` ending; null where nothing is left."""
    bare = F.lower(F.regexp_replace(filename, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"\.txt$", ""), r"[\s\p{Z}_\-]+", "_")
    return F.when(bare != "", bare)
