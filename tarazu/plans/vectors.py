"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarazu.operators import vectors as vec
from tarazu.plans.registry import query
from tarazu.sources.tables import table

K = 20
_UNIT = "u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 1e-12)) AS e, label FROM embeddings)"
_SCORED = f"{_UNIT}, s AS (SELECT q.vec_id AS query, v.vec_id, v.label, round(list_dot_product(q.e, v.e), 6) AS score FROM u q JOIN u v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)"
_RANKED = f"{_SCORED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= {K})"


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The stated set of queries (ids divisible by 50) against all vectors."""
    v = table(spark, folder, "embeddings")
    return vec.nearest(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), K)


@query(f"WITH {_RANKED} SELECT query, rank, vec_id, round(score, 4) AS score FROM r")
def knn_query(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder).withColumn("score", F.round("score", 4))


@query(f"WITH {_RANKED} SELECT query, CAST(sum((a.label = b.label)::INT) AS BIGINT) AS n_same, count(*) AS n FROM r b JOIN (SELECT vec_id, label FROM embeddings) a ON a.vec_id = query GROUP BY query")
def knn_label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How many of a query's neighbours have its label."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    n = _nearest(spark, folder).join(labels, "vec_id")
    own = labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    return n.join(own, "query").groupBy("query").agg(F.sum((F.col("label") == F.col("own")).cast("long")).alias("n_same"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_UNIT} SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS squared, round(e[1], 6) AS first FROM u")
def l2_normalize(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "embeddings").select("vec_id", vec.l2_normalize(F.col("embedding")).alias("e"))
    return u.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"), F.round(F.try_element_at("e", F.lit(1)), 6).alias("first"))


_COARSE = "c AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 2)) AS embedding FROM embeddings), w AS (SELECT vec_id, list_transform(embedding, lambda x: x / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y * y))), 1e-12)) AS e FROM c)"


@query(f"WITH {_UNIT}, {_COARSE} SELECT count(*) AS n, round(avg(list_dot_product(u.e, w.e)), 6) AS mean_cosine, round(min(list_dot_product(u.e, w.e)), 6) AS min_cosine FROM u JOIN w USING (vec_id)")
def vector_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors against a coarser encoding of them (two decimals)."""
    both = table(spark, folder, "embeddings").withColumn("coarse", F.transform("embedding", lambda x: F.round(x.cast("double"), 2)))
    return vec.agreement(both, "embedding", "coarse").select("n", F.round("mean_cosine", 6).alias("mean_cosine"), F.round("min_cosine", 6).alias("min_cosine"))
