"""Saved tables that outlive the code that wrote them: several layouts read as one, older names, content identity.

Files are JSON lines whose rows name their schema version. One scan reads a folder of any mix of layouts; each row is
projected by its own version, and rows that no layout explains are reported with a reason instead of raising or vanishing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stipple.functions.columns import finite, reasons
from stipple.operators.skew import with_totals

BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Layout:
    """One saved layout.

    ``path`` is a pattern that the path of its files contains, ``fields`` their columns, ``columns`` the current
    columns as SQL over those, and ``required`` the fields that must not be NULL.
    """

    version: str
    path: str
    fields: str
    columns: Mapping[str, str]
    required: Sequence[str] = field(default_factory=tuple)


def union_schema(spark: SparkSession, layouts: Sequence[Layout]) -> T.StructType:
    """All fields of all layouts; one name must not have two types."""
    found: dict[str, T.StructField] = {}
    for layout in layouts:
        for f in T.StructType.fromDDL(layout.fields):
            if f.name in found and found[f.name].dataType != f.dataType:
                raise ValueError(f"field {f.name} has two types")
            found[f.name] = f
    return T.StructType([*found.values(), T.StructField("schema_version", T.StringType()), T.StructField("__corrupt", T.StringType())])


def read_layouts(spark: SparkSession, folder: str, layouts: Sequence[Layout]) -> tuple[DataFrame, DataFrame]:
    """Rows in the current columns with ``schema_version``, and failed rows counted by path, version and reason."""
    raw = (spark.read.schema(union_schema(spark, layouts)).option("recursiveFileLookup", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "__corrupt").json(folder).withColumn("path", F.col("_metadata.file_path")))
    version = F.col("schema_version")

    def by_version(value, otherwise=None):
        out = F.when(F.lit(False), F.lit(otherwise))
        for layout in layouts:
            out = out.when(version == layout.version, value(layout))
        return out.otherwise(F.lit(otherwise))

    known = F.coalesce(version.isin(*[x.version for x in layouts]), F.lit(False))
    placed = by_version(lambda x: F.col("path").rlike(x.path), False)
    filled = by_version(lambda x: F.expr(" and ".join(f"`{c}` is not null" for c in x.required) or "true"), False)
    reason = (F.when(F.col("__corrupt").isNotNull(), "unreadable").when(~known, "unsupported_schema")
              .when(~placed, "version_and_file_disagree").when(~filled, "missing_fields"))
    judged = raw.withColumn("__reason", reason)
    names = list(dict.fromkeys(c for x in layouts for c in x.columns))
    current = [by_version(lambda x, c=c: F.expr(x.columns.get(c, "null"))).alias(c) for c in names]
    rows = judged.where("__reason is null").select("schema_version", *current)
    failures = judged.where("__reason is not null").groupBy("path", "schema_version", F.col("__reason").alias("reason")).agg(
        F.count("*").alias("rows_n"))
    return rows, failures


def newest_saved(rows: DataFrame, keys: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """Of each key only the rows of the first of ``versions`` that it has: older names count where the newer is absent."""
    rank = F.array_position(F.array(*[F.lit(v) for v in versions]), F.col("schema_version"))
    ranked = rows.withColumn("__rank", F.when(rank > 0, rank)).where("__rank is not null")
    return with_totals(ranked, keys, __best=F.min("__rank")).where("__rank = __best").drop("__rank", "__best")


def completed(saved: DataFrame, recomputed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Saved rows, and recomputed ones for keys without any; ``origin`` is the schema version or ``recomputed``."""
    keys = list(keys)
    rest = recomputed.join(saved.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("recomputed"))
    return saved.withColumnRenamed("schema_version", "origin").unionByName(rest)


def grid_failures(rows: DataFrame, keys: Sequence[str], *, n_bins: int, values: Sequence[str]) -> DataFrame:
    """One row per saved curve with its bins and a ``message`` naming what is wrong with its grid or values, else empty.

    A curve has a bounded number of bins, so a window over one is bounded.
    """
    before = F.lag("right_um").over(Window.partitionBy(*keys).orderBy("bin"))
    real = lambda c: F.coalesce(finite(F.col(c)), F.lit(False))
    seen = rows.withColumn("__gap", F.coalesce(before != F.col("left_um"), F.lit(False)))
    out = seen.groupBy(*keys).agg(
        F.count("*").alias("bins"), F.countDistinct("bin").alias("__bins"), F.min("bin").alias("__first"), F.max("bin").alias("__last"),
        F.bool_and(real("left_um") & real("right_um")).alias("__finite"),
        F.bool_and(F.coalesce(F.col("right_um") > F.col("left_um"), F.lit(False))).alias("__rising"), F.bool_or("__gap").alias("__gaps"),
        F.bool_and(F.forall(F.array(*[real(v) for v in values]), lambda x: x)).alias("__values"))
    whole = (F.col("bins") == n_bins) & (F.col("__bins") == n_bins) & (F.col("__first") == 0) & (F.col("__last") == n_bins - 1)
    why = reasons([("bin_count", ~whole), ("edges_not_finite", ~F.col("__finite")), ("edges_not_increasing", ~F.col("__rising")),
                   ("edges_not_adjacent", F.col("__gaps")), ("values_not_finite", ~F.col("__values"))])
    return out.select(*keys, "bins", F.array_join(why, ";").alias("message"))


def content_identity(spark: SparkSession, root: str, *, pattern: str = "*", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, length, sha256) of every file: the hash over the hashes of its blocks in order.

    The content is hashed where it was read and never moves. One file is one row of the reader, so it has to
    stay below two gigabytes; the identity depends on ``block_bytes``. The reader passes over files without a byte, so they
    have no identity: join left and the missing hash is a mismatch.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    blocks = F.ceil(F.col("length") / block_bytes).cast("int")
    each = F.transform(F.sequence(F.lit(1), blocks), lambda i: F.sha2(
        F.substring(F.col("content"), (i - 1) * block_bytes + 1, F.lit(block_bytes)), 256))
    return files.select("path", "length", F.sha2(F.array_join(each, ""), 256).alias("sha256"))


def replica_violations(
    replicas: DataFrame, group: Sequence[str], *, replica: str, schema: str, config: Sequence[str], calibration: Sequence[str],
    positive: Sequence[str] = (),
) -> DataFrame:
    """(group, replica, message) of the replicas that can't be summed up with the others of their group.

    Rows hold schema_version, ``config`` columns with a ``parameter_<name>`` beside each, ``calibration`` columns, edges, sha256 and
    length as found, recorded_sha256 and recorded_length. A group's standard is its replica with the smallest id.
    Of equal inputs under several ids all are named.
    """
    group = list(group)
    rows = replicas.withColumns({"__config": F.struct(*config), "__calibration": F.struct(*calibration), "__digest": F.lower("recorded_sha256")})
    first = lambda c: F.min_by(F.struct(F.col(c).alias("v")), F.col(replica))
    rows = with_totals(rows, group, __c=first("__config"), __k=first("__calibration"), __e=first("edges"))
    rows = with_totals(rows, [*group, replica], __ids=F.count("*"))
    rows = with_totals(rows, [*group, "sha256"], __inputs=F.countDistinct(replica))
    incomplete = F.lit(False)
    mismatch = F.lit(False)
    for c in config:
        incomplete = incomplete | F.col(c).isNull()
        mismatch = mismatch | ~F.col(c).eqNullSafe(F.col(f"parameter_{c}"))
    bad_calibration = F.lit(False)
    for c in calibration:
        bad_calibration = bad_calibration | F.col(c).isNull()
    for c in positive:
        bad_calibration = bad_calibration | ~F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False))
    steps = F.zip_with(F.slice("edges", 2, F.greatest(F.size("edges") - 1, F.lit(0))), F.slice("edges", 1, F.greatest(F.size("edges") - 1, F.lit(0))),
                       lambda b, a: F.coalesce(finite(a) & finite(b) & (b > a), F.lit(False)))
    good_edges = F.coalesce((F.size("edges") >= 2) & F.forall(steps, lambda ok: ok), F.lit(False))
    why = reasons([
        ("empty_id", F.coalesce(F.trim(F.col(replica).cast("string")), F.lit("")) == ""),
        ("duplicate_id", F.col("__ids") > 1),
        ("unsupported_schema", ~F.col("schema_version").eqNullSafe(F.lit(schema))),
        ("incomplete_config", incomplete),
        ("incompatible_config", ~F.col("__config").eqNullSafe(F.col("__c.v"))),
        ("parameter_mismatch", mismatch),
        ("invalid_calibration", bad_calibration),
        ("incompatible_calibration", ~F.col("__calibration").eqNullSafe(F.col("__k.v"))),
        ("invalid_sha256", ~F.coalesce(F.col("__digest").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        ("sha256_mismatch", ~F.col("__digest").eqNullSafe(F.col("sha256"))),
        ("size_mismatch", ~F.col("recorded_length").eqNullSafe(F.col("length"))),
        ("duplicate_input", F.col("sha256").isNotNull() & (F.col("__inputs") > 1)),
        ("invalid_edges", ~good_edges),
        ("incompatible_edges", ~F.col("edges").eqNullSafe(F.col("__e.v"))),
    ])
    return rows.withColumn("message", F.array_join(why, ";")).where("message <> ''").select(*group, replica, "message")
