"""The read panel: one row for each deduplicated (molecule, strand, tract, flanking string).

panel rows   locus_id, mi, strand, seq, cnt, flanking_seq
panel loci   locus_id, ref_orientation, up_width, dn_width, up_start, dn_start
A flanking string is the upstream part, '|', and the downstream part; '.' stands
for no information. Offsets are positions in that string, from 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions.tract import run_lengths

SCHEMA_VERSION = "3"
ROW_KEY = ["locus_id", "mi", "strand", "seq", "flanking_seq"]


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def save_versioned(spark: SparkSession, path: str, tables: dict[str, DataFrame], version: str) -> None:
    """Write tables under a generation of their own, then the version that names it.

    What was saved there before stays whole and readable until the new version
    stands; a broken write leaves it as it was. Its tables go afterwards.
    """
    generation = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{generation}/{name}")
    before = _version(spark, path)
    line = spark.range(1).select(F.lit(version).alias("schema_version"), F.lit(generation).alias("generation"))
    line.write.mode("overwrite").parquet(f"{path}/version")
    if before is not None and "generation" in before:
        _remove(spark, f"{path}/{before['generation']}")


def _version(spark: SparkSession, path: str) -> Row | None:
    try:
        return spark.read.parquet(f"{path}/version").first()
    except AnalysisException:  # nothing is saved there
        return None


def load_versioned(spark: SparkSession, path: str, version: str) -> Callable[[str], DataFrame]:
    """Reader of the tables that save_versioned() has written; another version is an error."""
    found = _version(spark, path)
    if found is None or found["schema_version"] != version or "generation" not in found:
        raise ValueError(f"{path} has no or another schema version")
    return lambda name: spark.read.parquet(f"{path}/{found['generation']}/{name}")


@dataclass
class Panel:
    rows: DataFrame
    loci: DataFrame

    def save(self, path: str, **more: DataFrame) -> None:
        """Write the panel, and more tables beside it, so that it is whole or not there.

        Rows lie in ranges of locus and molecule, so that a reader of some loci
        skips the files and row groups of the others, and a hot locus has many files.
        """
        ranged = self.rows.repartitionByRange("locus_id", "mi").sortWithinPartitions(*ROW_KEY) if "mi" in self.rows.columns else self.rows
        save_versioned(self.rows.sparkSession, path, {"rows": ranged, "loci": self.loci, **more}, SCHEMA_VERSION)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Panel:
        read = load_versioned(spark, path, SCHEMA_VERSION)
        return Panel(read("rows"), read("loci"))


def locus_column(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One metadata column by locus, without touching the rows."""
    loci = load_versioned(spark, path, SCHEMA_VERSION)("loci")
    if name not in loci.columns:
        raise ValueError(f"no column {name} in the loci of {path}")
    return loci.select("locus_id", name)


def run_meta(rows: DataFrame) -> DataFrame:
    """Most runs and largest run of each locus's tracts, and its reads."""
    runs = run_lengths(F.col("seq"))
    return rows.groupBy("locus_id").agg(F.max(F.size(runs)).alias("n_runs"), F.max(F.array_max(runs)).alias("max_run"), F.sum("cnt").alias("n_reads"))


def panel_info(meta: DataFrame, margin: int = 1) -> DataFrame:
    """One row: the number of alleles of the whole panel, its largest run and a margin."""
    return meta.agg((F.max("max_run") + margin).alias("n_alleles"))


def dedup(reads: DataFrame) -> DataFrame:
    """Fragments to panel rows: one fragment counts once."""
    return reads.groupBy(*ROW_KEY).agg(F.count("*").alias("cnt"))


def with_order(rows: DataFrame) -> DataFrame:
    """Add row_ord, the rank of a row in its locus by its key."""
    order = W.partitionBy("locus_id").orderBy("mi", "strand", "seq", "flanking_seq")
    return rows.withColumn("row_ord", F.row_number().over(order).cast("long"))


def derived_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments computed from lineitem by integer arithmetic, one for each line."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("o"), F.expr("l_orderkey div 8").alias("f"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")
    )
    text = """
        concat(repeat('G', cast(6 + f % 3 as int)), CASE WHEN p % 17 = 0 THEN 'C' WHEN f % 7 < 4 THEN 'A' WHEN f % 7 < 6 THEN 'T' ELSE '' END, 'GGGGG') AS seq,
        concat(
          CASE WHEN f % 6 = 0 THEN '.' WHEN p % 19 = 0 THEN 'T' WHEN o % 8 = 0 OR f % 5 < 3 THEN 'A' ELSE 'C' END,
          'A',
          CASE WHEN f % 6 = 0 THEN '.' WHEN p % 23 = 0 THEN 'N'
               WHEN o % 8 = 0 OR (f % 5 < 3 AND f % 11 > 0) OR (f % 5 > 2 AND f % 11 = 0) THEN 'G' ELSE 'T' END,
          CASE WHEN f % 6 = 0 OR (f % 5 < 3 AND (f div 30) % 4 > 0) THEN '.' WHEN o % 8 = 0 OR f % 5 < 3 THEN 'C' ELSE 'A' END,
          '|',
          CASE WHEN o % 8 = 0 OR f % 6 > 0 THEN '.' WHEN f % 5 < 3 THEN 'T' ELSE 'G' END,
          CASE WHEN p % 10 = 0 THEN 'G' ELSE 'C' END,
          'T') AS flanking_seq"""
    return items.selectExpr(
        "concat('Locus', o % 8) AS locus_id", "cast(o as string) AS mi", "CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS strand", "f", text.split(" AS seq,")[0] + " AS seq", text.split(" AS seq,")[1]
    )


def derived_loci(spark: SparkSession, up_width: int = 4, shift: int = 0) -> DataFrame:
    """Geometry of the eight derived loci: odd ones forward, even ones reverse."""
    k = spark.range(8).withColumnRenamed("id", "k")
    return k.selectExpr(
        "concat('Locus', k) AS locus_id",
        "CASE WHEN k % 2 = 1 THEN '+' ELSE '-' END AS ref_orientation",
        f"cast({up_width} as long) AS up_width",
        "cast(3 as long) AS dn_width",
        f"CASE WHEN k % 2 = 1 THEN 1000 * (k + 1) - {shift} ELSE 1000 * (k + 1) + 100 + {shift} END AS up_start",
        "CASE WHEN k % 2 = 1 THEN 1000 * (k + 1) + 100 ELSE 1000 * (k + 1) + 50 END AS dn_start",
    )


def derived_panel(spark: SparkSession, sf_dir: str) -> Panel:
    return Panel(dedup(derived_reads(spark, sf_dir).drop("f")), derived_loci(spark))


def derived_pair(spark: SparkSession, sf_dir: str) -> tuple[Panel, Panel]:
    """A reference panel and a target panel of other molecules, whose window begins two bases earlier."""
    reads = derived_reads(spark, sf_dir)
    reference = dedup(reads.where("f % 2 = 0").drop("f"))
    target = reads.where("f % 2 = 1").drop("f").withColumn("flanking_seq", F.concat(F.lit("TT"), "flanking_seq"))
    return Panel(reference, derived_loci(spark)), Panel(dedup(target), derived_loci(spark, up_width=6, shift=2))
