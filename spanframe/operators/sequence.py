"""Histograms, entropies, n-grams and resampling of sequences.

A sample's content is one row value, so its tiles are produced by the task that
reads the row: content is never shuffled, only its tile rows are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.functions import kernels


def _content(df: DataFrame, id_col: str, text_col: str, valid: str | None = None) -> DataFrame:
    mask = [F.col(valid).alias("runs")] if valid else []
    return df.select(F.col(id_col).cast("bigint").alias("sample_id"), F.col(text_col).alias("content"), *mask)


def symbol_histogram(df: DataFrame, id_col: str, text_col: str, size: int | None = None, valid: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Counts per (sample, tile, code); ``size=None`` makes the whole sample one tile.

    ``valid`` names a column of runs (array of lo, hi); symbols outside them are unknown and
    count nowhere. A null list has no run. Tiles are cut by position, known or not. With
    ``keep_empty`` a sample without (known) symbols has one row of code -1 and count 0.
    """
    return _content(df, id_col, text_col, valid).mapInArrow(
        kernels.histogram_batches(size, keep_empty), "sample_id bigint, tile bigint, code bigint, cnt bigint"
    )


def symbol_histogram_sql(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The same counts from built-in expressions; for engines without Arrow workers."""
    chars = _content(df, id_col, text_col).select(
        "sample_id", F.posexplode(F.split("content", "")).alias("pos", "ch")
    )
    return chars.groupBy("sample_id", F.floor(F.col("pos") / size).alias("tile"), "ch").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def symbol_probabilities(hist: DataFrame, samples: DataFrame | None = None, alphabet: int = 256) -> DataFrame:
    """Probabilities per code; a sample without symbols gets the uniform distribution.

    Such samples are those of ``samples`` that ``hist`` lacks, or without ``samples`` the ones
    that ``hist`` keeps by a row of their own (``keep_empty``); the content is then read once.
    """
    even = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(alphabet - 1).cast("bigint")), lambda i: F.struct(i.alias("code"), F.lit(1.0 / alphabet).alias("p")))
    counts = hist.groupBy("sample_id", "code").agg(F.sum("cnt").alias("_c"))
    n = F.sum("_c").over(Window.partitionBy("sample_id"))
    if samples is None:
        shared = counts.withColumn("_n", n).filter("code >= 0 or _n = 0")
        own = F.array(F.struct(F.col("code"), (F.col("_c") / F.when(F.col("_n") > 0, F.col("_n"))).alias("p")))
        return shared.select("sample_id", F.explode(F.when(F.col("_n") == 0, even).otherwise(own)).alias("_e")).select("sample_id", "_e.code", "_e.p")
    known = counts.withColumn("_n", n).select("sample_id", "code", (F.col("_c") / F.col("_n")).alias("p"))
    empty = samples.select("sample_id").join(hist.select("sample_id").distinct(), "sample_id", "left_anti").select(
        "sample_id", F.explode(even).alias("_e")
    ).select("sample_id", "_e.code", "_e.p")
    return known.unionByName(empty)


def tile_entropy(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Entropy in bits per tile, the last tile on its real symbols."""
    return _content(df, id_col, text_col).mapInArrow(
        kernels.tile_entropy_batches(size), "sample_id bigint, tile bigint, n_units bigint, entropy double"
    )


def block_entropy(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Entropy of whole blocks only; a ragged tail gives no row."""
    return tile_entropy(df, id_col, text_col, size).filter(F.col("n_units") == size)


def entropy_guide(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Tile entropy scaled by the 8 bits of a byte; an empty sample has no block."""
    return tile_entropy(df, id_col, text_col, size).filter(F.col("n_units") > 0).withColumn("guide", F.col("entropy") / 8.0)


def _row_sums(hist: DataFrame) -> DataFrame:
    c, code = F.col("cnt"), F.col("code")
    return hist.groupBy("sample_id", F.col("tile").alias("row")).agg(
        F.sum(code * c).alias("_total"), F.sum(c).alias("_n"), F.sum(F.when(code == 0, c).otherwise(0)).alias("_zeros"),
        F.sum(F.when(code > 0, c * F.log2(F.greatest(c, F.lit(1)))).otherwise(0.0)).alias("_spread"), F.count(F.when(code > 0, F.lit(1))).alias("_codes"),
    )


def row_statistics(df: DataFrame, id_col: str, bytes_col: str, width: int = 512) -> DataFrame:
    """Mean, entropy and distinct share of the bytes of each row of ``width`` bytes.

    The last row is filled up with zero bytes, which are a count of code 0; a sample
    without bytes has one row of zeros.
    """
    filled = df.select(F.col(id_col).alias("sample_id"), F.when(F.length(bytes_col) > 0, F.col(bytes_col)).otherwise(F.lit(b"\0")).alias("content"))
    per = _row_sums(symbol_histogram(filled, "sample_id", "content", width))
    zeros = F.col("_zeros") + width - F.col("_n")
    spread_ = F.col("_spread") + F.when(zeros > 0, zeros * F.log2(F.greatest(zeros, F.lit(1)))).otherwise(0.0)
    return per.select(
        "sample_id", "row", (F.col("_total") / width / 255.0).alias("mean"), ((F.log2(F.lit(float(width))) - spread_ / width) / 8.0).alias("entropy"),
        ((F.col("_codes") + (zeros > 0).cast("int")) / 256.0).alias("distinct"),
    )


def valid_row_statistics(df: DataFrame, id_col: str, bytes_col: str, valid: str, width: int = 512) -> DataFrame:
    """The same figures over the known bytes of each row alone, and their number; a row without any is absent."""
    per = _row_sums(symbol_histogram(df, id_col, bytes_col, width, valid))
    n, zeros = F.col("_n"), F.col("_zeros")
    spread_ = F.col("_spread") + F.when(zeros > 0, zeros * F.log2(F.greatest(zeros, F.lit(1)))).otherwise(0.0)
    return per.select(
        "sample_id", "row", n.alias("n_valid"), (F.col("_total") / n / 255.0).alias("mean"), ((F.log2(n) - spread_ / n) / 8.0).alias("entropy"),
        ((F.col("_codes") + (zeros > 0).cast("int")) / 256.0).alias("distinct"),
    )


def bigram_counts(df: DataFrame, id_col: str, bytes_col: str, buckets: int = 1024, block: int | None = None, valid: str | None = None) -> DataFrame:
    """Sparse counts; a sample without (known) bytes has one row of kind 2."""
    return _content(df, id_col, bytes_col, valid).mapInArrow(
        kernels.bigram_batches(buckets, block), "sample_id bigint, block bigint, kind int, bucket bigint, cnt bigint"
    )


def hashed_bigram_features(df: DataFrame, id_col: str, bytes_col: str, buckets: int = 1024, valid: str | None = None) -> DataFrame:
    """Sparse L1-normalised features: index below 256 is a byte, above it a hashed pair.

    A sample without bytes has the uniform byte part and no pairs, so no sample is lost.
    With ``valid``, a column of runs, unknown bytes count in neither part.
    """
    counts = bigram_counts(df, id_col, bytes_col, buckets, None, valid)
    total = F.sum("cnt").over(Window.partitionBy("sample_id", "kind"))
    shared = counts.select("sample_id", "kind", "bucket", (F.col("cnt") / total).alias("value"))
    even = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint")), lambda i: F.struct(i.alias("index"), F.lit(1.0 / 256).alias("value")))
    own = F.array(F.struct((F.col("bucket") + F.when(F.col("kind") == 1, 256).otherwise(0)).alias("index"), F.col("value").alias("value")))
    return shared.select("sample_id", F.explode(F.when(F.col("kind") == 2, even).otherwise(own)).alias("f")).select("sample_id", "f.index", "f.value")


def boundary_score(tiles: DataFrame, key: str = "sample_id", idx: str = "tile", value: str = "entropy", name: str = "boundary") -> DataFrame:
    """Largest step to either neighbour; a single tile scores 0."""
    w = Window.partitionBy(key).orderBy(idx)
    v = F.col(value)
    step = lambda other: F.coalesce(F.abs(v - other), F.lit(0.0))
    return tiles.withColumn(name, F.greatest(step(F.lag(value).over(w)), step(F.lead(value).over(w))))


def boundary_contrast(rows: DataFrame, cuts: DataFrame, half: int = 8, key: str = "key") -> DataFrame:
    """Mean gap across each cut over the pooled spread of ``half`` rows on either side."""
    around = cuts.select(key, "cut", F.explode(F.sequence(F.lit(-half), F.lit(half - 1))).alias("_off")).select(
        key, "cut", "_off", (F.col("cut") + F.col("_off")).alias("row")
    )
    joined = around.join(rows.select(key, "row", "value"), [key, "row"])
    before, after = F.when(F.col("_off") < 0, F.col("value")), F.when(F.col("_off") >= 0, F.col("value"))
    agg = joined.groupBy(key, "cut").agg(
        F.avg(before).alias("_ma"), F.avg(after).alias("_mb"), F.var_pop(before).alias("_va"), F.var_pop(after).alias("_vb"),
        F.count(before).alias("n_before"), F.count(after).alias("n_after"),
    )
    pooled = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    gap = F.abs(F.col("_ma") - F.col("_mb"))
    return agg.select(
        key, "cut", "n_before", "n_after", (gap / F.when(pooled == 0, F.lit(1e-9)).otherwise(pooled)).alias("contrast")
    )


def text_entropy(col: Column) -> Column:
    """Entropy in bits of a string column; empty or missing text scores 0."""
    def entropy(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            counts, _ = kernels.tile_counts(kernels.codes_of(t or ""), max(1, len(t or "")))
            out.append(float(kernels.entropy_rows(counts)[0]))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(entropy, "double")(col)


def seam_delta(pairs: DataFrame, host: str, graft: str, start: str, window: int = 2048) -> DataFrame:
    """Largest entropy gap across the two joins a graft makes in its host."""
    h, g, s = F.col(host), F.col(graft), F.col(start).cast("int")
    end = s + F.length(g)
    lo = F.greatest(s - window, F.lit(0))
    cut = lambda c, a, n: text_entropy(c.substr(a + 1, n))
    e = pairs.withColumn("_b", cut(h, lo, s - lo)).withColumn("_a", cut(h, end, F.lit(window)))
    e = e.withColumn("_gh", cut(g, F.lit(0), F.lit(window))).withColumn(
        "_gt", cut(g, F.greatest(F.length(g) - window, F.lit(0)), F.lit(window))
    )
    left = F.when(s > 0, F.abs(F.col("_b") - F.col("_gh")))
    right = F.when(end < F.length(h), F.abs(F.col("_a") - F.col("_gt")))
    return e.withColumn("seam_delta", F.coalesce(F.greatest(left, right), F.lit(0.0))).drop("_b", "_a", "_gh", "_gt")


def in_distribution(filled: DataFrame, observed: DataFrame) -> DataFrame:
    """Does each fill's block entropy lie in the 5-95 % range of the sample's own blocks?

    ``observed`` holds the blocks of one content row per sample, so the exact
    percentile keeps a bounded buffer.
    """
    own = observed.groupBy("sample_id").agg(F.percentile("entropy", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q"))
    return filled.join(own, "sample_id").select(
        "sample_id", "fill", F.col("entropy").alias("fill_entropy"), F.col("_q")[0].alias("sample_low"),
        F.col("_q")[1].alias("sample_median"), F.col("_q")[2].alias("sample_high"),
        F.col("entropy").between(F.col("_q")[0], F.col("_q")[2]).alias("in_distribution"),
    )


def _targets(sizes: DataFrame, key: str, target: str) -> DataFrame:
    return sizes.filter(F.col(target) > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(target).cast("bigint") - 1)))


def upsample_nearest(coarse: DataFrame, sizes: DataFrame, key: str = "key") -> DataFrame:
    """``coarse(key, cell, value)`` to ``sizes(key, m, target)`` fine positions by index; no cells give 0."""
    fine = _targets(sizes, key, "target").withColumn(
        "cell", F.least(F.expr("(i * m) div target"), F.col("m") - 1)
    )
    return fine.join(coarse, [key, "cell"], "left").select(key, "i", F.coalesce("value", F.lit(0.0)).alias("value"))


def upsample_linear(coarse: DataFrame, sizes: DataFrame, key: str = "key") -> DataFrame:
    """Linear interpolation between cell centres, clamped at both ends."""
    centre = (F.col("i") + 0.5) * (F.col("m") / F.col("target")) - 0.5
    at = F.least(F.greatest(centre, F.lit(0.0)), (F.col("m") - 1).cast("double"))
    fine = _targets(sizes, key, "target").withColumn("_at", F.when(F.col("m") > 0, at).otherwise(0.0))
    fine = fine.withColumn("_a", F.floor("_at")).withColumn("_b", F.least(F.col("_a") + 1, F.col("m") - 1))
    a = coarse.select(key, F.col("cell").alias("_a"), F.col("value").alias("_va"))
    b = coarse.select(key, F.col("cell").alias("_b"), F.col("value").alias("_vb"))
    out = fine.join(a, [key, "_a"], "left").join(b, [key, "_b"], "left")
    value = F.col("_va") + (F.col("_vb") - F.col("_va")) * (F.col("_at") - F.col("_a"))
    return out.select(key, "i", F.coalesce(value, F.lit(0.0)).alias("value"))


# exp(-x*x/2) is exactly zero in double precision beyond this many sigmas.
ZERO_SIGMAS = 39


def upsample_guided(
    coarse: DataFrame, guide: DataFrame, sizes: DataFrame, key: str = "key",
    sigma_spatial: float = 1.0, sigma_range: float = 0.15,
) -> DataFrame:
    """Joint bilateral upsampling along one axis, guided by ``guide(key, i, g)``.

    Cells farther than ``ZERO_SIGMAS`` spatial sigmas weigh exactly zero in double
    arithmetic, so each fine position meets a fixed number of cells by equi join
    and the result is still the full sum.
    """
    scale = F.col("target") / F.col("m")
    fine = guide.join(sizes, key)
    # Block mean of the guide under each coarse cell, with rounded edges.
    cells = sizes.filter("m > 0").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    start = F.bround(F.col("cell") * scale).cast("bigint")
    stop = F.when(F.col("cell") == F.col("m") - 1, F.col("target")).otherwise(F.bround((F.col("cell") + 1) * scale).cast("bigint"))
    edges = cells.withColumn("_s", start).withColumn("_e", stop)
    under = edges.withColumn(
        "i", F.explode(F.when(F.col("_e") > F.col("_s"), F.sequence("_s", F.greatest(F.col("_s"), F.col("_e") - 1))).otherwise(
            F.array(F.least(F.col("_s"), F.col("target") - 1))))
    )
    coarse_guide = under.join(guide, [key, "i"]).groupBy(key, "cell").agg(F.avg("g").alias("_cg"))
    cell_facts = coarse.join(coarse_guide, [key, "cell"]).select(key, "cell", "value", "_cg")
    reach = int(ZERO_SIGMAS * sigma_spatial) + 1
    home = F.floor((F.col("i") + 0.5) / scale)
    near = fine.withColumn(
        "cell", F.explode(F.sequence(F.greatest(home - reach, F.lit(0)), F.least(home + reach, F.col("m") - 1)))
    )
    d = ((F.col("i") + 0.5) - (F.col("cell") + 0.5) * scale) / (sigma_spatial * scale)
    r = (F.col("g") - F.col("_cg")) / max(sigma_range, 1e-6)
    weighted = near.join(cell_facts, [key, "cell"]).withColumn("_w", F.exp(-0.5 * d * d) * F.exp(-0.5 * r * r))
    sums = weighted.groupBy(key, "i").agg(
        F.sum("_w").alias("_t"), F.sum(F.col("_w") * F.col("value")).alias("_wv"), F.max("m").alias("_m"), F.max("value").alias("_one")
    )
    linear = upsample_linear(coarse, sizes, key).withColumnRenamed("value", "_lin")
    return linear.join(sums, [key, "i"], "left").select(
        key, "i",
        F.when(F.col("_m") == 1, F.col("_one")).when(F.col("_t") > 0, F.col("_wv") / F.when(F.col("_t") > 0, F.col("_t")))
        .otherwise(F.col("_lin")).alias("value"),
    )


def area_resample(series: DataFrame, sizes: DataFrame, key: str = "key") -> DataFrame:
    """``series(key, i, value)`` of length ``m`` to ``target`` bins; bins may share an edge position."""
    step = F.col("m") / F.col("target")
    bins = sizes.filter("m > 0").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("target") - 1)))
    lo = F.floor(F.col("bin") * step)
    hi = F.when(F.col("bin") == F.col("target") - 1, F.col("m")).otherwise(F.ceil((F.col("bin") + 1) * step))
    hi = F.least(F.greatest(hi, lo + 1), F.col("m"))
    index = F.least(F.expr("(bin * m) div target"), F.col("m") - 1)
    spots = bins.withColumn(
        "i", F.explode(F.when(F.col("m") > F.col("target"), F.sequence(lo, hi - 1)).otherwise(F.array(index)))
    )
    return spots.join(series, [key, "i"]).groupBy(key, "bin").agg(F.avg("value").alias("value"))


def boundary_recovery_error(profile: DataFrame, truth: DataFrame, width: int, floor: float = 0.5) -> DataFrame:
    """Start and end error of the recovered band per (arm, key); nothing recovered costs the band length."""
    on = F.when(F.col("value") >= floor, F.col("i"))
    seen = profile.groupBy("arm", "key").agg(F.min(on).alias("_a"), F.max(on).alias("_b"))
    length = (F.col("hi") - F.col("lo")) * width
    return seen.join(truth, "key").select(
        "arm", "key",
        F.when(F.col("_a").isNull(), length).otherwise(F.abs(F.col("_a") - F.col("lo")) * width).alias("d_start"),
        F.when(F.col("_b").isNull(), length).otherwise(F.abs(F.col("_b") + 1 - F.col("hi")) * width).alias("d_end"),
    )


def recovery_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d_start").alias("mae_start"), F.avg("d_end").alias("mae_end"),
        F.avg((F.col("d_start") == 0).cast("double")).alias("hit_start"), F.avg((F.col("d_end") == 0).cast("double")).alias("hit_end"),
    )


def sliding_ngrams(df: DataFrame, key: list[str], tokens: str, n: int) -> DataFrame:
    """All contiguous n-grams with their position; a shorter sequence gives one error row."""
    size = F.size(tokens)
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.concat_ws(" ", F.slice(F.col(tokens), i + 1, n))
    )
    short = F.when(size < n, F.lit(f"needs at least {n} tokens"))
    out = df.select(*key, short.alias("error"), F.posexplode(F.when(size >= n, grams).otherwise(F.array(F.lit(None).cast("string")))).alias("pos", "gram"))
    return out.select(*key, F.col("pos").cast("bigint").alias("pos"), "gram", "error")
