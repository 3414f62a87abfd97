"""Tables of vectors: centroids, nearest clusters, exemplars, agreement and separation measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirpline.functions.intervals import cosine, l2_distance
from chirpline.operators.quantiles import quantiles

#: Clusters whose centroids are one row.
CLUSTERS = 4_096


def by_dim(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.select("*", F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def centroids(df: DataFrame, by: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    """by, n, centroid: element-wise means."""
    means = by_dim(df.select(by, vec), vec).groupBy(by, "dim").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, cents: DataFrame, by: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    """``df`` without its vector, with nearest and distance (L2; the lower cluster on ties).

    All centroids are one row, so every row of ``df`` stays a row and none is shuffled. Clusters are
    few (``CLUSTERS`` at most); more are refused rather than broadcast.
    """
    one = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("nearest"), "centroid"))).alias("__all"))
    one = one.withColumn("__all", F.when(F.size("__all") <= CLUSTERS, F.col("__all")).otherwise(F.raise_error(F.lit(f"more than {CLUSTERS} clusters"))))
    each = F.transform("__all", lambda c: F.struct(l2_distance(F.col(vec), c["centroid"]).alias("distance"), c["nearest"].alias("nearest")))
    met = df.join(F.broadcast(one)).withColumn("__m", F.array_min(F.filter(each, lambda x: x["distance"].isNotNull())))
    return met.select(*(c for c in df.columns if c != vec), "__m.nearest", "__m.distance")


def own_distance(df: DataFrame, cents: DataFrame, by: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    return df.join(F.broadcast(cents.select(by, "centroid")), by).withColumn("distance", l2_distance(vec, "centroid")).drop("centroid")


def gate_threshold(df: DataFrame, cents: DataFrame, q: float = 0.95, by: str = "cluster_id") -> DataFrame:
    """The percentile of members' distances to their own centroid, per cluster."""
    return quantiles(own_distance(df, cents, by), [by], "distance", {"threshold": q})


def exemplars(df: DataFrame, by: str = "cluster_id", conf: str = "confidence", key: str = "vec_id") -> DataFrame:
    """The most confident row of each cluster (first on ties) and the cluster's size."""
    of = Window.partitionBy(by)
    return df.withColumns({"n": F.count(F.lit(1)).over(of), "__r": F.row_number().over(of.orderBy(F.col(conf).desc(), key))}).where("__r = 1").drop("__r")


def medoids(df: DataFrame, by: str = "cluster_id", key: str = "vec_id") -> DataFrame:
    """The member closest to its centroid."""
    return own_distance(df, centroids(df, by), by).groupBy(by).agg(F.min_by(F.struct(key, "distance"), F.struct("distance", key)).alias("m")).select(by, "m.*")


def nearest_other(cents: DataFrame, present: DataFrame, by: str = "cluster_id") -> DataFrame:
    """For each cluster the nearest other one that is in ``present``. A row per cluster: small."""
    other = cents.join(present.select(by).distinct(), by, "left_semi").select(F.col(by).alias("other"), F.col("centroid").alias("o"))
    met = cents.join(F.broadcast(other), F.col(by) != F.col("other")).withColumn("d", l2_distance("centroid", "o"))
    return met.groupBy(by).agg(F.min(F.struct("d", "other")).alias("m")).select(by, F.col("m.other").alias("other"), F.col("m.d").alias("distance"))


def missing_clusters(df: DataFrame, k: int, by: str = "cluster_id") -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias(by)).join(df.select(by), by, "left_anti")


def paired(df: DataFrame, key: str = "vec_id", pair: str = "paired_vec_id", vec: str = "embedding") -> DataFrame:
    """Rows beside their partner's vector (inner: partners that exist)."""
    other = df.select(F.col(key).alias(pair), F.col(vec).alias("other"))
    return df.join(other, pair)


def pearson_by_dim(pairs: DataFrame, vec: str = "embedding", other: str = "other") -> DataFrame:
    """dim, r, variance of the first arm."""
    z = pairs.select(F.posexplode(F.arrays_zip(F.col(vec).alias("a"), F.col(other).alias("b"))).alias("dim", "z")).select("dim", F.col("z.a").cast("double").alias("a"), F.col("z.b").cast("double").alias("b"))
    return z.groupBy("dim").agg(F.corr("a", "b").alias("r"), F.var_pop("a").alias("variance"))


def agreement(pairs: DataFrame, vec: str = "embedding", other: str = "other") -> DataFrame:
    """Mean and median of per-row cosine and mean squared error."""
    mse = F.aggregate(F.zip_with(vec, other, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v) / F.size(vec)
    rows = pairs.select(cosine(vec, other).alias("cosine"), mse.alias("mse"))
    return rows.agg(*(f(c).alias(f"{c}_{n}") for c in ("cosine", "mse") for n, f in (("mean", F.avg), ("median", F.median))))


def weighted_r(dims: DataFrame, active: float = 0.01) -> DataFrame:
    """Variance-weighted and active-dimension means of r; NULL where no dimension varies."""
    return dims.agg(F.try_divide(F.sum(F.col("r") * F.col("variance")), F.sum("variance")).alias("weighted_r"), F.avg(F.when(F.col("variance") > active, F.col("r"))).alias("active_r"), F.count_if(F.col("variance") > active).alias("n_active"))


def active_dims(df: DataFrame, vec: str = "embedding", least: float = 0.01, share: float = 0.99) -> DataFrame:
    """dim, variance, active, and whether the dimension is in the smallest set with ``share`` of the variance."""
    v = by_dim(df.select(vec), vec).groupBy("dim").agg(F.var_pop("x").alias("variance"))
    order = Window.orderBy(F.col("variance").desc(), "dim").rowsBetween(Window.unboundedPreceding, -1)  # a row per dimension
    total = F.sum("variance").over(Window.partitionBy())
    return v.select("dim", "variance", (F.col("variance") > least).alias("active"), (F.coalesce(F.sum("variance").over(order), F.lit(0.0)) < share * total).alias("in_set"))


def masked_arms(df: DataFrame, patch: str = "patch", mask: str = "mask") -> DataFrame:
    """The raw arm and the masked arm of the same rows."""
    return df.withColumn("masked", F.zip_with(patch, mask, lambda a, b: a * b))


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.feature import StandardScaler

    v = df.withColumn("raw", array_to_vector(F.col(vec).cast("array<double>")))
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)


def cluster_separation(df: DataFrame, ks: list[int], vec: str = "embedding", seed: int = 1) -> DataFrame:
    """k, silhouette, davies_bouldin, calinski_harabasz of KMeans on standardised vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import vector_to_array

    x = _vectors(df, vec).select("features").cache()
    out = None
    for k in ks:  # a model per k; each fit is a distributed job
        fitted = KMeans(k=k, seed=seed).fit(x).transform(x)
        score = ClusteringEvaluator().evaluate(fitted)
        a = fitted.select(F.col("prediction").alias("cluster_id"), vector_to_array("features").alias("v"))
        c = centroids(a, "cluster_id", "v")
        d = a.join(F.broadcast(c), "cluster_id").withColumn("d", l2_distance("v", "centroid"))
        per = d.groupBy("cluster_id").agg(F.avg("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("w"), F.first("centroid").alias("c"), F.count(F.lit(1)).alias("n")).cache()
        two = per.select(F.col("cluster_id").alias("j"), F.col("s").alias("sj"), F.col("c").alias("cj"))
        db = per.join(F.broadcast(two), F.col("cluster_id") != F.col("j")).groupBy("cluster_id").agg(F.max((F.col("s") + F.col("sj")) / l2_distance("c", "cj")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
        size = F.aggregate("c", F.lit(0.0), lambda s, v: s + v * v)  # the overall mean is 0
        ch = per.agg(F.sum(F.col("n") * size).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"))
        row = db.join(ch).select(F.lit(k).alias("k"), F.lit(float(score)).alias("silhouette"), "davies_bouldin", ((F.col("b") / (F.col("g") - 1)) / (F.col("w") / (F.col("n") - F.col("g")))).alias("calinski_harabasz"))
        out = row if out is None else out.unionByName(row)
    return out


def kmeans_medoids(df: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id", seed: int = 1) -> DataFrame:
    """cluster, n and medoid of KMeans on standardised vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    x = _vectors(df, vec)
    a = KMeans(k=k, seed=seed).fit(x).transform(x).select(key, F.col("prediction").alias("cluster_id"), vector_to_array("features").alias("embedding")).cache()
    return medoids(a, "cluster_id", key).join(a.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id")


def robust_range(df: DataFrame, cols: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """<c>_lo and <c>_hi of each column, in one row."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols))).alias("x")).select("x.*")
    got = quantiles(long, ["name"], "value", {"lo": low, "hi": high})
    return got.agg(*(F.max(F.when(F.col("name") == c, F.col(n))).alias(f"{c}_{n}") for c in cols for n in ("lo", "hi")))


def with_features(latents: DataFrame, features: DataFrame, key: list[str]) -> DataFrame:
    """Latents beside the features of the same provenance key (recording, file, annotation)."""
    return latents.join(features, key)


def stacked(arms: dict[str, DataFrame]) -> DataFrame:
    """Aligned latent sets one below the other, tagged by their source."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in arms.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def split_rows(df: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """``df`` with part: ``val`` for a seeded random share of the rows (one at least), else ``train``.

    Rows are placed by range of a hash of seed and key, so no task sees all of them.
    """
    from chirpline.operators.matching import equal_shards, hash_order

    placed = equal_shards(df.withColumn("__h", hash_order(seed, key)), 1, ["__h", key])
    n = F.greatest(F.lit(1), F.floor(F.col("__rows") * share))
    return placed.withColumn("__rows", F.lit(df.count())).withColumn("part", F.when(F.col("place") < n, "val").otherwise("train")).select(*df.columns, "part")


def imbalance_weight(df: DataFrame, mask: str, most: float = 20.0) -> DataFrame:
    """pos, neg and weight: background over foreground of the masks, ``most`` at most."""
    ones = F.aggregate(mask, F.lit(0.0), lambda s, v: s + v.cast("double"))
    sums = df.agg(F.coalesce(F.sum(ones), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(F.size(mask) - ones), F.lit(0.0)).alias("neg"))
    return sums.withColumn("weight", F.least(F.col("neg") / F.greatest(F.col("pos"), F.lit(1.0)), F.lit(most)))


def shallow_models(train: DataFrame, test: DataFrame, features: list[str], label: str = "y", seed: int = 1) -> DataFrame:
    """model, auc on held-out rows, and importances: a shallow tree and a standardised logistic model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{f}__filled" for f in features]
    prep = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    rows = []
    for name, model in (("tree", DecisionTreeClassifier(labelCol=label, maxDepth=3, minInstancesPerNode=30, seed=seed)), ("logistic", LogisticRegression(labelCol=label))):
        fitted = Pipeline(stages=[*prep, model]).fit(train)
        auc = BinaryClassificationEvaluator(labelCol=label).evaluate(fitted.transform(test))
        last = fitted.stages[-1]
        weights = last.featureImportances.toArray() if name == "tree" else last.coefficients.toArray()
        rows += [(name, float(auc), f, float(w)) for f, w in zip(features, weights)]
    return train.sparkSession.createDataFrame(rows, "model string, auc double, feature string, weight double")
