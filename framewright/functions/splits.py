"""Split-name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of the three splits.
TRAIN = ("train", "training")
VAL = ("val", "valid", "validation")
TEST = ("test", "testing")


def canonical_split(split: Column) -> Column:
    """train, val or test for any spelling and case; null for null and for other names."""
    s = F.lower(F.regexp_replace(split, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(s.isin(*TRAIN), "train").when(s.isin(*VAL), "val").when(s.isin(*TEST), "test")
