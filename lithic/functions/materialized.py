"""Orders of candidate edits that rows and their contracts share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranked_labels(candidates: Column) -> Column:
    """Labels from best to worst: on target, without interference, then by movement, error and label."""
    keyed = F.transform(
        candidates,
        lambda x: F.struct((~x["satisfies"]).alias("a"), (~x["no_interference"]).alias("b"), x["movement"].alias("c"), x["error"].alias("d"), x["label"].alias("label")),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["label"]), "")
