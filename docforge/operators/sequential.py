"""Operators whose state is sequential: grouped Python folds, one bounded group at a time."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Target shares of the splits.
TARGETS = {"development": 0.5, "validation": 0.1667, "test": 0.3333}


def split_groups(rows: DataFrame) -> DataFrame:
    """Greedy split of whole families within each stratum (W14): stratum, family, n, split.

    Families are taken by the hash of their name; each goes to the split that is emptiest against its
    target. Columns: stratum, family, id. Rows of a family are counted before the fold, so a stratum's
    group has one row per family.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(k=[hashlib.sha256(f.encode()).hexdigest() for f in group["family"]]).sort_values(["k", "family"])
        held = dict.fromkeys(TARGETS, 0)
        out = []
        for n in group["n"]:
            best = min(TARGETS, key=lambda s: (held[s] / TARGETS[s], s))
            held[best] += n
            out.append(best)
        return group.assign(split=out)[["stratum", "family", "n", "split"]]

    counted = rows.groupBy("stratum", "family").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("stratum").applyInPandas(fold, "stratum string, family string, n bigint, split string")
