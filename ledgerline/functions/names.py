"""Names of machines, providers, models and lanes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import filled


def slug(name: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 one hyphen, none at the ends; ``unknown-machine`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown-machine"))


def provider(name: Column) -> Column:
    """Trimmed, lower case; null or blank is ``fleet``."""
    return F.coalesce(F.lower(filled(name)), F.lit("fleet"))
