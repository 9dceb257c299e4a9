"""Dense vectors: exact nearest neighbours, agreement of two encodings, batched encoding, a table that is filled in chunks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarazu.session import stage_table

#: Numbers of query vectors in a block: what is shipped to the tasks at once is bounded by it.
BLOCK_FLOATS = 8_000_000
#: Scores are compared at this precision.
DIGITS = 6


def l2_normalize(v: Column) -> Column:
    """The vector divided by its length (at least 1e-12)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, exclude_self: bool = True, block_floats: int = BLOCK_FLOATS) -> DataFrame:
    """``(query, rank, <key>, score)``: the ``k`` vectors with the greatest cosine for each query vector, exactly.

    The query vectors go to the tasks in blocks of a bounded size; each task multiplies them with its own vectors and sends the best k of each, so
    no pair is ever shuffled.  Equal scores go by key.  Null vectors are left out; a null or zero number in a vector counts as 0.
    """
    asked = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where("q IS NOT NULL AND v IS NOT NULL")
    first = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-first.n * (first.d or 1) // block_floats))
    shown = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k IS NOT NULL AND v IS NOT NULL")
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b) if blocks > 1 else asked
        held = sorted(part.collect(), key=lambda r: r.q)
        got, shipped = _block(shown, [r.q for r in held], _unit([r.v for r in held]), k, exclude_self)
        if blocks > 1:  # a block's queries leave the driver and the executors before the next block's come
            got = stage_table(got, "nearest-block")
            shipped.destroy()
        found = got if found is None else found.unionByName(got)
    order = [F.col("score").desc(), F.col("k")]
    return found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k).select(F.col("q").alias("query"), "rank", F.col("k").alias(key), "score")


def _unit(rows: list) -> np.ndarray:
    m = np.nan_to_num(np.array([np.asarray(r, np.float64) for r in rows])) if len(rows) else np.empty((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _block(shown: DataFrame, names: list, q: np.ndarray, k: int, exclude_self: bool) -> tuple[DataFrame, Broadcast]:
    kind = shown.schema["k"].dataType.simpleString()
    shipped = shown.sparkSession.sparkContext.broadcast((np.asarray(names), q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shipped.value
        best = None
        for batch in batches:
            if not len(names) or not len(batch):
                continue
            keys = batch["k"].to_numpy()
            score = np.round(q @ _unit(list(batch["v"])).T, DIGITS)
            if exclude_self:
                score[names[:, None] == keys[None, :]] = -np.inf
            if best is not None:
                score, keys2 = np.hstack([best[0], score]), np.hstack([best[1], np.broadcast_to(keys, score.shape)])
            else:
                keys2 = np.broadcast_to(keys, score.shape)
            order = np.lexsort((keys2, -score), axis=1)[:, :k]
            best = np.take_along_axis(score, order, 1), np.take_along_axis(keys2, order, 1)
        if best is not None:
            n = best[0].shape[1]
            out = pd.DataFrame({"q": np.repeat(names, n), "k": best[1].ravel(), "score": best[0].ravel()})
            yield out[np.isfinite(out["score"])]

    return shown.mapInPandas(run, f"q {kind}, k {kind}, score double"), shipped


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: number, mean and least cosine of two vectors a row."""
    dot = F.aggregate(F.zip_with(l2_normalize(F.col(a)), l2_normalize(F.col(b)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.select(dot.alias("c")).agg(F.count("c").alias("n"), F.avg("c").alias("mean_cosine"), F.min("c").alias("min_cosine"))


def overlap(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """One row: the mean share of the k neighbours of a query that two rankings have in common."""
    same = a.select("query", key).join(b.select("query", key), ["query", key]).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    asked = a.select("query").distinct()
    return asked.join(same, "query", "left").agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("overlap"))


def encode(texts: DataFrame, text: str, make_session: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """The table with ``embedding``: texts in batches of like length through a function that each worker makes once.  Null texts are
    encoded as empty ones."""
    from pyspark.sql import types as T

    schema = T.StructType([*(f for f in texts.schema if f.name != "embedding"), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = make_session()
        for part in batches:
            values = [t if isinstance(t, str) else "" for t in part[text]]
            order = sorted(range(len(values)), key=lambda i: len(values[i]))
            out: list = [None] * len(values)
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                for i, v in zip(own, _unit(list(session([values[i] for i in own])))):
                    out[i] = v.astype(np.float32)
            yield part.drop(columns="embedding", errors="ignore").assign(embedding=out)

    return texts.mapInPandas(run, schema)


class ChunkedTable:
    """A Parquet table that is filled chunk by chunk and can be continued after a failure.

    Every chunk is one partition directory that is written whole; a chunk counts as done if its directory is committed.  A manifest holds the
    key of the build, and a build with another key is refused.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = fs_path
        self._fs = fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.exists(fs_path(f"{self.path}/manifest")):
            held = spark.read.json(f"{self.path}/manifest").first().key
            if held != key:
                raise ValueError(f"{path} was built with another key: {held}")
        else:
            spark.createDataFrame([(key,)], "key string").coalesce(1).write.json(f"{self.path}/manifest")

    def done(self) -> set[int]:
        """Chunks that are there."""
        if not self._fs.exists(self._path(self.path)):
            return set()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return {int(n.split("=")[1]) for n in names if n.startswith("chunk=") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS"))}

    def fill(self, rows: DataFrame, chunk: Column, chunks: int, make: Callable[[DataFrame], DataFrame]) -> int:
        """Write the chunks that are missing; returns how many were."""
        missing = sorted(set(range(chunks)) - self.done())
        if not missing:
            return 0
        # The rows of all missing chunks are read once and laid apart, so that a chunk's turn reads its own rows only.
        work = f"{self.path}/.work-{uuid.uuid4().hex}"
        try:
            rows.withColumn("__chunk", chunk.cast("int")).where(F.col("__chunk").isin(missing)).write.partitionBy("__chunk").parquet(work)
            for c in missing:
                own = f"{work}/__chunk={c}"
                part = self.spark.read.schema(rows.schema).parquet(own) if self._fs.exists(self._path(own)) else rows.limit(0)
                make(part).write.mode("overwrite").parquet(f"{self.path}/chunk={c}")
        finally:
            self._fs.delete(self._path(work), True)
        return len(missing)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/chunk={c}" for c in sorted(self.done())))
