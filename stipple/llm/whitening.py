"""Whitening of embeddings by distributed block matrices.

Entries are put on a grid, ``floor(scale * entry) + shift`` as longs, and each distinct grid vector counts once in
the fit. Rows are centred exactly (``(n * x - S) / n`` from whole numbers), indexed and laid out as an MLlib BlockMatrix; its
transpose times itself is the scatter matrix, a local ``eigh`` of its d x d entries gives the components, and a
second block product with the whitening matrix projects every row. Only matrices with d rows and the list of
block numbers come to the driver.

The scatter product is split along its middle dimension, so no task sees all rows. A block holds about
``BLOCK_VALUES`` numbers. Copies of one vector are combined before they move; rows join their projections by
index, so a vector that a third of all rows share stays spread.

Vectors that are null or hold null, NaN or infinite entries are dropped, as are vectors whose length is not the most common one
(the longest of equally common ones). Empty vectors and an empty table give no rows. Entries beyond 2 ** 62 on the grid are set
to that bound. Null and repeated ids and repeated rows are projected row by row. Components with an eigenvalue below
``FLAT`` of the largest, all of them where vectors do not differ, have no whitening and give no rows. A deviation that no long holds is null. Other columns
are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.llm.registry import named, table
from stipple.llm.shared import written

SCALE = 64.0
SHIFT = 1_000_000
COMPONENTS = 16
BLOCK_VALUES = 1 << 17
MAX_BLOCKS = 1 << 20
FLAT = 1e-12
_EDGE = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """A fit: vectors in the fit list, their sums by dimension, eigenvalues, components in columns, trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    reach: int  # the largest |n * x - S|
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def gridded(vectors: DataFrame, vector_col: str, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vectors`` with finite entries and the column ``__x``, the grid vector."""
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    place = F.transform(v, lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * scale, F.lit(_EDGE / 4)), F.lit(-_EDGE / 4))), F.lit(1 << 61)),
                                                F.lit(-(1 << 61))).cast("long") + F.lit(shift))
    return vectors.where(F.coalesce(sound, F.lit(False))).withColumn("__x", place)


def indexed(df: DataFrame, name: str = "__i") -> DataFrame:
    """``df`` as a written table with row numbers from 0 without gaps, in no particular order."""
    placed = written(df.withColumn("__pos", F.monotonically_increasing_id()))
    task = F.shiftright("__pos", 33).alias("__task")
    tasks = placed.groupBy(task).agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task of the write
    tasks = tasks.withColumn("__skip", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    found = placed.withColumn("__task", task).join(tasks, "__task")
    return found.withColumn(name, F.col("__pos") - F.col("__first") + F.col("__skip")).drop("__task", "__pos", "__first", "__skip")


def blocks(rows: DataFrame, values: Column, n_rows: int, width: int) -> BlockMatrix:
    """Rows (``__i``, values) as a block matrix of ``width`` columns; absent row numbers are rows of zeros."""
    laid = rows.select("__i", array_to_vector(values).alias("v"))
    height = max(1, BLOCK_VALUES // width, -(-n_rows // MAX_BLOCKS))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(laid, "v"), n_rows, width).toBlockMatrix(height, width)


def scatter(rows: DataFrame, values: Column, n_rows: int, width: int) -> np.ndarray:
    """Transpose times matrix; blocks meet in as many tasks as the session shuffles to, then partial products are added."""
    laid = blocks(rows, values, n_rows, width)
    splits = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turned = laid.transpose()
    product = turned._java_matrix_wrapper.call("multiply", laid._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, width, width).toLocalMatrix().toArray()


def numerators(n: int, sums: tuple[int, ...]) -> Column:
    """n * x - S by dimension, exact."""
    return F.zip_with("__x", F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums]),
                      lambda x, s: x.cast("decimal(38,0)") * F.lit(n).cast("decimal(20,0)") - s)


def centred(fit: Whitening | tuple) -> Column:
    n, sums, reach = (fit.n, fit.sums, fit.reach) if isinstance(fit, Whitening) else fit
    if reach < 1 << 62:
        whole = F.zip_with("__x", F.array(*[F.lit(s) for s in sums]), lambda x, s: x * F.lit(n) - s)
    else:
        whole = numerators(n, sums)
    return F.transform(whole, lambda c: c.cast("double") / F.lit(float(n)))


def deviation(fit: Whitening) -> Column:
    """Sum over dimensions of (n * x - S) ** 2: in longs where the largest possible sum is one, else in decimals."""
    if len(fit.sums) * fit.reach**2 < 1 << 62:
        terms = F.zip_with("__x", F.array(*[F.lit(s) for s in fit.sums]), lambda x, s: x * F.lit(fit.n) - s)
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, c: a + c * c)
    zero = F.lit(0).cast("decimal(38,0)")
    total = F.aggregate(numerators(fit.n, fit.sums), zero,
                        lambda a, c: F.try_add(a, F.try_multiply(c.cast("decimal(38,0)"), c.cast("decimal(38,0)"))).cast("decimal(38,0)"))
    return total.try_cast("long")


def fitted(rows: DataFrame, n_rows: int, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The fit over the distinct vectors of ``rows`` (``__i``, ``__x``), and one row number of each of them."""
    distinct = written(rows.groupBy("__x").agg(F.min("__i").alias("__i")))
    each = distinct.select(F.posexplode("__x").alias("p", "c")).groupBy("p").agg(
        F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    dims = each.orderBy("p").collect()
    n, sums = dims[0]["n"], tuple(int(r["s"]) for r in dims)
    reach = max(max(abs(n * r["lo"] - int(r["s"])), abs(n * r["hi"] - int(r["s"]))) for r in dims)
    reach = max(reach, n * max(max(abs(r["lo"]), abs(r["hi"])) for r in dims))  # the products on the way too
    spread = scatter(distinct, centred((n, sums, reach)), n_rows, len(sums)) / n
    spread = (spread + spread.T) / 2
    values, vectors = np.linalg.eigh(spread)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    if not k:
        return None, distinct
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)])
    return Whitening(n, sums, reach, values[:k].copy(), vectors, float(np.trace(spread))), distinct


def projected(rows: DataFrame, fit: Whitening, n_rows: int) -> DataFrame:
    """(``__i``, ``__z``): every row times the whitening matrix."""
    k = len(fit.values)
    spark = rows.sparkSession
    matrix = spark.createDataFrame([(i, [float(w) for w in row]) for i, row in enumerate(fit.matrix)], "__i long, w array<double>")
    d = len(fit.sums)
    right = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(matrix.select("__i", array_to_vector("w").alias("v")), "v"), d, k).toBlockMatrix(d, k)
    product = blocks(rows, centred(fit), n_rows, d).multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("__i"), vector_to_array("vector").alias("__z"))


def identity_gap(whitened: DataFrame, k: int, n: int, n_rows: int) -> float:
    """Largest absolute entry of the covariance of ``__z`` minus the identity."""
    means = whitened.select(F.posexplode("__z").alias("p", "c")).groupBy("p").agg(F.sum("c").alias("s")).orderBy("p").collect()
    middle = F.array(*[F.lit(r["s"] / n) for r in means])
    spread = scatter(whitened, F.zip_with("__z", middle, lambda z, m: z - m), n_rows, k) / n
    return float(np.abs(spread - np.eye(k)).max())


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: float = SCALE, shift: int = SHIFT) -> tuple[DataFrame, Whitening | None, float | None]:
    """Rows (id, ``__x``, ``__z``: the whitened vector) of all sound vectors, the fit and how far its covariance is from the identity."""
    sound = gridded(vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__v")), "__v", scale, shift)
    sizes = sound.groupBy(F.size("__x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    none = sound.select(F.col("__id").alias(id_col), "__x", F.lit(None).cast("array<double>").alias("__z")).where("false")
    if sizes is None:
        return none, None, None
    rows, n_rows = written(indexed(sound.where(F.size("__x") == sizes["d"]).select("__id", "__x"))), sizes["n"]
    fit, distinct = fitted(rows, n_rows, components)
    if fit is None:
        return none, None, None
    found = written(projected(rows, fit, n_rows))
    gap = identity_gap(found.join(distinct.select("__i"), "__i"), len(fit.values), fit.n, n_rows)
    return rows.join(found, "__i").select(F.col("__id").alias(id_col), "__x", "__z"), fit, gap


def whitened_components(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows, fit, gap = whiten(vectors, id_col=id_col, vector_col=vector_col, components=components)
    if fit is None:
        return rows.select(id_col, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                           *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    share = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values])
    each = rows.select(id_col, deviation(fit).alias("deviation"), F.posexplode("__z").alias("at", "whitened"))
    return each.select(id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(share, F.col("at")).alias("explained"), F.lit(gap).alias("identity_error"))


@named("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    return whitened_components(table(spark, sf_dir, "embeddings"))
