"""Linear text model on byte and hashed-pair shares, and what a block contributes to it."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions import kernels
from spanframe.operators.sequence import bigram_counts

BUCKETS = 1024
SIZE = 256 + BUCKETS


def feature_vectors(df: DataFrame, bytes_col: str, carry: list[str]) -> DataFrame:
    """One dense vector of ``hashed_bigram_features`` per sample, from the task that reads its content."""
    rows = df.select("sample_id", F.col(bytes_col).alias("content"), *carry)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    vec = rows.mapInArrow(kernels.share_vector_batches(BUCKETS), f"sample_id {rows.schema['sample_id'].dataType.simpleString()}, shares array<double>{kept}")
    return vec.select("sample_id", array_to_vector("shares").alias("features"), *carry)


def fit_text_model(df: DataFrame, bytes_col: str, label: str, max_iter: int = 30, reg: float = 1e-3) -> LogisticRegressionModel:
    """Class-weighted multinomial logistic regression. df: sample_id, content bytes, label."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_c"))
    weights = n.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_c") * F.col("_n"))).alias("weight"))
    # one weight per class
    train = feature_vectors(df, bytes_col, [label]).join(F.broadcast(weights), label).withColumnRenamed(label, "label")
    lr = LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter, regParam=reg, standardization=False)
    return lr.fit(train)


def score_text_model(model: LogisticRegressionModel, df: DataFrame, bytes_col: str, label: str) -> DataFrame:
    """Predicted class and loss per sample."""
    p = model.transform(feature_vectors(df, bytes_col, [label])).withColumn("_p", vector_to_array("probability"))
    own = F.element_at("_p", (F.col(label) + 1).cast("int"))
    return p.select("sample_id", label, F.col("prediction").cast("int").alias("pred"), (-F.ln(F.greatest(own, F.lit(1e-300)))).alias("nll"))


def coefficients(model: LogisticRegressionModel, spark) -> DataFrame:
    """(kind, bucket, cls, w): features x classes rows, fixed by the model size."""
    m = model.coefficientMatrix.toArray()
    rows = [(0 if j < 256 else 1, j if j < 256 else j - 256, c, float(m[c, j])) for c in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "kind int, bucket bigint, cls int, w double")


def _log_sum_exp(logits: str) -> Column:
    """Of one logit per class, shifted by the largest so that no exponential overflows."""
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top)))


def block_necessity(model: LogisticRegressionModel, df: DataFrame, bytes_col: str, label: str, block: int) -> DataFrame:
    """Loss change per block when its bytes follow the sample's own histogram instead.

    Block counts meet the coefficients once; sample logits are the sums over blocks, so
    content is read a single time. The byte part is exact in expectation, the pair part
    drops the block's own pairs. df: sample_id, content bytes, label.
    """
    spark = df.sparkSession
    counts = bigram_counts(df, "sample_id", bytes_col, BUCKETS, block).filter("kind < 2")
    n_classes = model.numClasses
    coef = F.broadcast(coefficients(model, spark))
    per = counts.join(coef, ["kind", "bucket"]).groupBy("sample_id", "block", "cls").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("w") * F.col("cnt")).otherwise(0.0)).alias("_su"), F.sum(F.when(F.col("kind") == 1, F.col("w") * F.col("cnt")).otherwise(0.0)).alias("_sb")
    )
    size = counts.groupBy("sample_id", "block").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("cnt")).otherwise(0)).alias("_m"), F.sum(F.when(F.col("kind") == 1, F.col("cnt")).otherwise(0)).alias("_t")
    )
    whole = per.groupBy("sample_id", "cls").agg(F.sum("_su").alias("_fu"), F.sum("_sb").alias("_fb"))
    total = size.groupBy("sample_id").agg(F.sum("_m").alias("_n"), F.sum("_t").alias("_all"))
    bias = F.array(*[F.lit(float(b)) for b in model.interceptVector])
    j = per.join(size, ["sample_id", "block"]).join(whole, ["sample_id", "cls"]).join(total, "sample_id").withColumn("_bias", F.element_at(bias, F.col("cls") + 1))
    rest = F.col("_all") - F.col("_t")
    z0 = F.col("_bias") + F.col("_fu") / F.col("_n") + F.when(F.col("_all") > 0, F.col("_fb") / F.greatest(F.col("_all"), F.lit(1))).otherwise(0.0)
    z1 = F.col("_bias") + F.col("_fu") / F.col("_n") * (1 + F.col("_m") / F.col("_n")) - F.col("_su") / F.col("_n")
    z1 = z1 + F.when(rest > 0, (F.col("_fb") - F.col("_sb")) / F.greatest(rest, F.lit(1))).otherwise(0.0)
    logits = j.withColumn("_z0", z0).withColumn("_z1", z1).join(df.select("sample_id", label), "sample_id")
    own = F.col("cls") == F.col(label)
    agg = logits.groupBy("sample_id", "block").agg(
        F.collect_list("_z0").alias("_e0"), F.collect_list("_z1").alias("_e1"), F.max(F.when(own, F.col("_z0"))).alias("_o0"), F.max(F.when(own, F.col("_z1"))).alias("_o1")
    )
    nll0, nll1 = _log_sum_exp("_e0") - F.col("_o0"), _log_sum_exp("_e1") - F.col("_o1")
    return agg.select("sample_id", "block", nll0.alias("baseline_nll"), (nll1 - nll0).alias("delta")).withColumn("n_classes", F.lit(n_classes))
