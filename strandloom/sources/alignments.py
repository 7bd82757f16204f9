"""Alignments from SAM text and from BAM files.

Both give the columns chrom, ord, qname, flag, pos0, mapq, cigar, tlen, seq,
qual (array of Phred scores or null), md, mi, sa. Both are split inside files.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.bam import SCHEMA, SPLIT_BYTES, BamSource, read_header

__all__ = ["SCHEMA", "read_bam", "read_group_sample", "read_groups", "read_sam"]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text; ord is the file order."""
    lines = spark.read.text(path).where("value NOT LIKE '@%' AND value <> ''").withColumn("ord", F.monotonically_increasing_id())
    f = lines.select("ord", F.split("value", "\t").alias("f"))
    c = F.col("f")
    tag = lambda name: F.element_at(F.transform(F.filter(F.slice(c, 12, 1 << 20), lambda x: x.startswith(f"{name}:")), lambda x: F.substring(x, F.lit(6), F.length(x))), 1)
    safe = lambda name: F.when(F.exists(F.slice(c, 12, 1 << 20), lambda x: x.startswith(f"{name}:")), tag(name))
    none = lambda x: F.when(x == "*", None).otherwise(x)
    phred = F.transform(F.split(c[10], ""), lambda q: F.ascii(q) - 33)
    return f.select(
        none(c[2]).alias("chrom"), "ord", c[0].alias("qname"), c[1].cast("int").alias("flag"), (c[3].cast("long") - 1).alias("pos0"), c[4].cast("int").alias("mapq"),
        none(c[5]).alias("cigar"), c[8].cast("int").alias("tlen"), F.coalesce(none(c[9]), F.lit("")).alias("seq"), F.when(c[10] != "*", phred).alias("qual"),
        safe("MD").alias("md"), safe("MI").alias("mi"), safe("SA").alias("sa"),
    )


def read_bam(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Alignments of a BAM file, of those a pattern names or of a folder's.

    regions: (chrom, start, end) intervals. A file with an index is then read
    where records over them lie, which may be more than these records.
    """
    spark.dataSource.register(BamSource)
    reader = spark.read.format("strandloom_bam").option("path", path).option("splitBytes", split_bytes)
    if regions is not None:
        reader = reader.option("regions", ";".join(f"{c}:{a}:{b}" for c, a, b in regions))
    return reader.load()


def read_groups(spark: SparkSession, path: str) -> list[str]:
    """Samples that the read groups of SAM or BAM headers name."""
    if path.endswith(".sam"):
        lines = [r["value"] for r in spark.read.text(path).where("value LIKE '@RG%'").distinct().collect()]
    else:
        paths = glob.glob(os.path.join(path, "*.bam")) if os.path.isdir(path) else glob.glob(path)
        lines = [x for p in paths for x in read_header(p).text.split("\n") if x.startswith("@RG")]
    fields = [f for x in lines for f in x.split("\t") if f.startswith("SM:")]
    return sorted({f[3:] for f in fields if f[3:]})


def read_group_sample(sample: str | None, found: list[str]) -> str:
    """The one sample of the read groups; several, none, or another than given is an error."""
    found = sorted({x for x in found if x})
    if len(found) > 1:
        raise ValueError(f"read groups of several samples: {found}")
    if found and sample is not None and sample != found[0]:
        raise ValueError(f"sample {sample} is given, the read groups say {found[0]}")
    if not found and sample is None:
        raise ValueError("no sample in the read groups and none given")
    return sample or found[0]
