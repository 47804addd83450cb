"""Same-length control windows away from evidence."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions.hashing import index_draw


def matched_controls(iv: DataFrame, samples: DataFrame, seed: str | int, attempts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(placed, unavailable): per interval one window of its length, disjoint from evidence and other controls.

    iv: sample_id, lo, hi (canonical evidence of content rows); samples: sample_id, n.
    Up to ``attempts`` hashed starts per interval are tested against the evidence by a
    carried maximum; what is left per sample, one row per interval with its free
    starts, is placed in interval order. An interval without a free place is reported.
    """
    base = iv.join(samples.select("sample_id", "n"), "sample_id").withColumn("length", F.col("hi") - F.col("lo"))
    tries = base.filter("length <= n").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    tries = tries.withColumn("start", index_draw(F.col("n") - F.col("length") + 1, seed, "sample_id", "lo", "attempt"))
    tries = tries.select("sample_id", "lo", "length", "attempt", "start", (F.col("start") + F.col("length")).alias("_p"), F.lit(True).alias("_q"))
    marks = tries.unionByName(iv.select("sample_id", F.col("lo").alias("_p"), F.col("hi").alias("_end")), allowMissingColumns=True)
    before = Window.partitionBy("sample_id").orderBy("_p").rangeBetween(Window.unboundedPreceding, -1)
    free = marks.withColumn("_reach", F.max("_end").over(before)).filter("_q and (_reach is null or _reach <= start)")
    per = free.groupBy("sample_id", "lo").agg(
        F.max("length").alias("length"), F.transform(F.sort_array(F.collect_list(F.struct("attempt", "start"))), lambda s: s["start"]).alias("starts")
    )

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        # placed windows by start; they are disjoint, so only the two neighbours can collide
        lows: list[int] = []
        highs: list[int] = []

        def slot(start: int, length: int) -> int | None:
            k = bisect_right(lows, start)
            fits_left = k == 0 or highs[k - 1] <= start
            fits_right = k == len(lows) or start + length <= lows[k]
            return k if fits_left and fits_right else None

        found = []
        for r in pdf.sort_values("lo").itertuples():
            choice = next(((int(s), k) for s in r.starts if (k := slot(int(s), r.length)) is not None), None)
            if choice:
                start, k = choice
                lows.insert(k, start)
                highs.insert(k, start + r.length)
                found.append((r.sample_id, r.lo, start, start + r.length))
        return pd.DataFrame(found, columns=["sample_id", "for_lo", "lo", "hi"])

    placed = per.groupBy("sample_id").applyInPandas(place, "sample_id bigint, for_lo bigint, lo bigint, hi bigint")
    missing = iv.select("sample_id", F.col("lo").alias("for_lo"), "hi").join(placed.select("sample_id", "for_lo"), ["sample_id", "for_lo"], "left_anti")
    return placed, missing
