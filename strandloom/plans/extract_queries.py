"""Named queries from derived alignments to a panel and to flanks, and their SQL oracles.

Reads are put together from lineitem so that what extraction must find is known
from how a read was made; the oracles state that, without placing anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import alignment as al
from strandloom.functions.tract import revcomp
from strandloom.operators import extraction, geometry, pipeline
from strandloom.sources.flanks import NO_PAIR, NO_WINDOW, RECOVERED

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

UP, DN = "ACGTACGTAC", "TGCATGCATG"
TRACTS = ("GGGGGGGAGGGGGG", "GGGGGGAGGGGGGG", "GGGGGGGGGGGGGG")


def query(oracle: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = oracle
        return function

    return register


# ---- derived reads: ten loci, of which X8 has no reads and X9 none that can be placed

#: What is written into each read, in SQL that both engines read.
_MADE = f"""SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_orderkey % 8 AS k, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS ord,
  'X' || CAST(l_orderkey % 8 AS STRING) AS locus_id, CAST(l_orderkey AS STRING) AS mol,
  CASE WHEN l_linenumber <= 2 THEN 1 WHEN l_linenumber <= 4 THEN 2 WHEN l_linenumber <= 6 THEN 3 ELSE 4 END AS pair,
  CASE WHEN l_partkey % 11 = 0 THEN '{TRACTS[1]}' WHEN l_orderkey % 3 = 0 THEN '{TRACTS[2]}' ELSE '{TRACTS[0]}' END AS tract,
  CASE WHEN l_partkey % 29 = 0 THEN 'T' WHEN l_orderkey % 5 < 2 THEN 'C' ELSE 'A' END AS snv, CASE WHEN l_partkey % 7 = 0 THEN '.' ELSE 'A' END AS low,
  30 + 2 * (l_partkey % 4) AS q, CASE WHEN l_partkey % 43 = 0 THEN 256 ELSE 99 END AS flag, CASE WHEN l_partkey % 31 = 0 THEN 10 ELSE 60 END AS mapq,
  CASE WHEN l_partkey % 37 = 0 THEN 'chr9' END AS sa, CASE WHEN l_partkey % 41 = 0 THEN 2000 ELSE 0 END AS tlen,
  CASE WHEN l_partkey % 47 = 0 THEN 'AAAAAAAAAA' ELSE '{UP}' END AS up, CASE WHEN l_partkey % 53 = 0 THEN 'TTTTTTTTTT' ELSE '{DN}' END AS dn FROM lineitem"""
_PAIRED = """SELECT *, mol || '_' || CAST(pair AS STRING) AS qname, CASE WHEN pair % 2 = 1 THEN 'A' ELSE 'B' END AS strand,
  CASE WHEN o % 19 = 0 THEN NULL WHEN o % 23 = 0 THEN mol ELSE mol || CASE WHEN pair % 2 = 1 THEN '/A' ELSE '/B' END END AS mi FROM made"""
_READS = f"made AS ({_MADE}), reads AS ({_PAIRED})"
_LOCI = f"""loci AS (SELECT 'X' || CAST(k AS VARCHAR) AS locus_id, k, 'chr' || (1 + k % 3) AS chrom, 10000 * (k + 1) AS bed_start, 10000 * (k + 1) + 14 AS bed_end,
  CASE WHEN k % 2 = 1 THEN '+' ELSE '-' END AS strand_, CASE k WHEN 8 THEN '{NO_WINDOW}' WHEN 9 THEN '{NO_PAIR}' ELSE '{RECOVERED}' END AS status FROM range(10) t(k))"""
_TESTED = """tested AS (SELECT *, CASE WHEN mapq < 40 THEN 'mapq' WHEN sa IS NOT NULL THEN 'sa' WHEN tlen > 1000 THEN 'tlen' WHEN mi IS NULL THEN 'no_mi' END AS reason,
  up <> 'AAAAAAAAAA' AS has_up, dn <> 'TTTTTTTTTT' AS has_dn FROM reads WHERE flag = 99),
  kept AS (SELECT * FROM tested WHERE reason IS NULL AND has_up AND has_dn),
  mates AS (SELECT locus_id, qname, mol, strand, count(*) AS n_mates, arg_min(tract, ord) AS t1, arg_max(tract, ord) AS t2, arg_min(q, ord) AS q1, arg_max(q, ord) AS q2,
    arg_min(snv, ord) AS s1, arg_max(snv, ord) AS s2, arg_min(low, ord) AS l1, arg_max(low, ord) AS l2 FROM kept WHERE mi LIKE '%/_' GROUP BY ALL HAVING count(*) <= 2),
  frags AS (SELECT locus_id, qname, mol AS mi, strand, t1 <> t2 AS differ, CASE WHEN t1 = t2 OR q1 > q2 THEN t1 WHEN q2 > q1 THEN t2 END AS tract,
    CASE WHEN s1 = s2 THEN s1 ELSE '.' END AS snv, CASE WHEN l1 = l2 THEN l1 ELSE 'A' END AS low FROM mates)"""


def derived_loci(spark: SparkSession) -> DataFrame:
    """Loci with the flanks that reads were made of; X9 has none."""
    loci = spark.range(10).selectExpr(
        "concat('X', id) AS locus_id", "concat('chr', 1 + id % 3) AS chrom", "10000 * (id + 1) AS bed_start", "10000 * (id + 1) + 14 AS bed_end",
        "CASE WHEN id % 2 = 1 THEN '+' ELSE '-' END AS ref_orientation", "id = 9 AS bare",
    )
    plus = F.col("ref_orientation") == "+"
    low, high = F.col("bed_start") - 1, F.col("bed_end")
    has = lambda c: F.when(~F.col("bare"), c)
    return loci.select(
        "locus_id", "chrom", "bed_start", "bed_end", "ref_orientation", has(F.lit(UP)).alias("up_flank"), has(F.lit(DN)).alias("dn_flank"),
        has(F.when(plus, low).otherwise(high)).alias("up_run_side"), has(F.when(plus, high).otherwise(low)).alias("dn_run_side"),
        F.when(F.col("bare"), NO_PAIR).otherwise(RECOVERED).alias("reference_window_status"),
    )


def _raw(turned) -> F.Column:
    return F.when(F.col("k") % 2 == 1, turned).otherwise(revcomp(turned))


def derived_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads from lineitem, and for each locus but X8 one longer read that gives its reference window."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    made = spark.sql(f"WITH made AS ({_MADE.replace('FROM lineitem', 'FROM {items}')}) {_PAIRED}", items=items)
    turned = F.concat(F.lit("AAA"), "snv", F.lit("AAAAAA"), "up", "tract", "dn", F.lit("A" * 10))
    quals = F.transform(F.sequence(F.lit(0), F.lit(53)), lambda i: F.when((i == 49) & (F.col("low") == "."), 10).otherwise(F.col("q")).cast("int"))
    common = [F.concat(F.lit("chr"), 1 + F.col("k") % 3).alias("chrom"), "ord", "qname", F.col("flag").cast("int").alias("flag")]
    reads = made.select(
        *common, (10_000 * (F.col("k") + 1) - 20).alias("pos0"), F.col("mapq").cast("int").alias("mapq"), F.lit("54M").alias("cigar"), F.col("tlen").cast("int").alias("tlen"),
        _raw(turned).alias("seq"), F.when(F.col("k") % 2 == 1, quals).otherwise(F.reverse(quals)).alias("qual"), F.lit(None).cast("string").alias("md"), "mi", "sa",
    )
    whole = spark.range(10).where("id <> 8").select(F.col("id").alias("k"), (-10 + F.col("id")).alias("ord"), F.concat(F.lit("whole"), "id").alias("qname"), F.lit(99).alias("flag"))
    text = F.lit("A" * 50 + UP + TRACTS[0] + DN + "A" * 50)
    whole = whole.select(
        *common, (10_000 * (F.col("k") + 1) - 60).alias("pos0"), F.lit(60).alias("mapq"), F.lit("134M").alias("cigar"), F.lit(0).alias("tlen"), _raw(text).alias("seq"),
        F.array_repeat(F.lit(40), 134).alias("qual"), F.lit("134").alias("md"), F.lit(None).cast("string").alias("mi"), F.lit(None).cast("string").alias("sa"),
    )
    return reads.unionByName(whole)


def _extracted(spark: SparkSession, sf_dir: str):
    return pipeline.extract(derived_alignments(spark, sf_dir), derived_loci(spark))


@query(f"""WITH {_READS}, {_TESTED} SELECT locus_id, mi, strand, tract AS seq, 'AAA' || snv || 'AAAAAA{UP}|{DN}AAAAA' || low || 'AAAA' AS flanking_seq, count(*) AS cnt
  FROM frags WHERE tract IS NOT NULL GROUP BY ALL""")
def extract_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's rows, from filters, placement, mates and flanking sides."""
    return _extracted(spark, sf_dir)[0].rows


_FILTERS = ("mapq", "sa", "tlen", "no_mi")
_DROPS = "n_drop_flank n_drop_upstream n_drop_downstream n_drop_no_placement n_drop_no_bed_base n_drop_negative_value".split()
_COUNTED = ["n_overlap", *[f"n_drop_{x}" for x in _FILTERS], "n_placed", *_DROPS, "n_read_pairs", "n_read_pairs_drop_disagree", "n_read_pairs_merged", "n_reads"]


@query(f"""WITH {_READS}, {_TESTED}, {_LOCI},
  a AS (SELECT locus_id, count(*) + 1 AS n_overlap, {", ".join(f"count(*) FILTER (reason = '{x}') {'+ 1' if x == 'no_mi' else ''} AS n_drop_{x}" for x in _FILTERS)},
    count(*) FILTER (reason IS NULL AND has_up AND has_dn) AS n_placed, count(*) FILTER (reason IS NULL AND NOT (has_up AND has_dn)) AS n_drop_flank,
    count(*) FILTER (reason IS NULL AND NOT has_up) AS n_drop_upstream, count(*) FILTER (reason IS NULL AND NOT has_dn) AS n_drop_downstream,
    0 AS n_drop_no_placement, 0 AS n_drop_no_bed_base, 0 AS n_drop_negative_value FROM tested GROUP BY locus_id),
  b AS (SELECT locus_id, count(*) AS n_read_pairs, count(*) FILTER (differ AND tract IS NULL) AS n_read_pairs_drop_disagree,
    count(*) FILTER (differ AND tract IS NOT NULL) AS n_read_pairs_merged, count(tract) AS n_reads FROM frags GROUP BY locus_id)
  SELECT l.locus_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTED)} FROM loci l LEFT JOIN a ON l.locus_id = a.locus_id LEFT JOIN b ON l.locus_id = b.locus_id""")
def extract_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every locus; those without a window or a flank pair count nothing."""
    return _extracted(spark, sf_dir)[1].select("locus_id", *_COUNTED)


@query(f"""WITH {_LOCI} SELECT locus_id, CASE WHEN k < 8 THEN strand_ END AS ref_orientation, status AS reference_window_status, CAST(CASE WHEN k < 8 THEN 20 ELSE 0 END AS BIGINT) AS up_width,
  CAST(CASE WHEN k < 8 THEN 20 ELSE 0 END AS BIGINT) AS dn_width, CAST(CASE WHEN k > 7 THEN -1 WHEN strand_ = '+' THEN bed_start - 20 ELSE bed_end + 19 END AS BIGINT) AS up_start,
  CAST(CASE WHEN k > 7 THEN -1 WHEN strand_ = '+' THEN bed_end ELSE bed_start - 1 END AS BIGINT) AS dn_start, CASE WHEN k < 8 THEN '{TRACTS[0]}' ELSE '' END AS reference_tract,
  CASE WHEN k < 8 THEN '7,6' ELSE '' END AS reference_run_lengths, CAST(CASE WHEN k < 8 THEN 0 END AS INTEGER) AS walk_up, CAST(CASE WHEN k < 8 THEN 0 END AS INTEGER) AS walk_dn FROM loci""")
def locus_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's loci: orientation, status, widths, coordinates and the reference tract."""
    return _extracted(spark, sf_dir)[0].loci.select(
        "locus_id", "ref_orientation", "reference_window_status", "up_width", "dn_width", "up_start", "dn_start", "reference_tract", "reference_run_lengths", "walk_up", "walk_dn"
    )


@query(f"""WITH {_READS}, {_TESTED}, {_LOCI},
  v AS (SELECT locus_id, count(*) AS n_reads, count(*) FILTER (has_up AND has_dn) AS n_placed,
    sum(CASE WHEN has_up AND has_dn THEN 6 * (length(tract) - length(replace(tract, 'G', ''))) - 4 * length(tract) END) / 2 AS objective FROM tested WHERE reason IS NULL GROUP BY locus_id),
  s AS (SELECT *, strand_ = '+' AS plus FROM loci), both_ AS (SELECT *, 'upstream' AS side, '{UP}' AS flank, plus AS low FROM s UNION ALL SELECT *, 'downstream', '{DN}', NOT plus FROM s)
  SELECT 'normal' AS sample, b.locus_id AS locus, side, status AS reference_window_status, CASE WHEN k <> 8 THEN strand_ END AS ref_orientation, CASE WHEN k < 8 THEN flank END AS flank_bases,
    CASE WHEN k < 8 THEN CASE WHEN low THEN (bed_start - 10) || ',' || (bed_start - 1) ELSE (bed_end + 9) || ',' || bed_end END END AS flank_ref_positions,
    CASE WHEN k <> 8 THEN coalesce(CAST(objective AS DOUBLE), 0) END AS objective, coalesce(n_reads, 0) AS n_reads, coalesce(n_placed, 0) AS n_reads_placed, CAST(CASE WHEN k < 8 THEN 1 ELSE 0 END AS BIGINT) AS n_tied_pairs,
    coalesce(n_placed, 0) AS n_reads_positioned, coalesce(n_placed, 0) AS n_reads_at_position FROM both_ b LEFT JOIN v ON b.locus_id = v.locus_id""")
def flank_side_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flanks found from the reads alone, with their positions and support."""
    return pipeline.build_flanks(derived_alignments(spark, sf_dir), derived_loci(spark).select("locus_id", "chrom", "bed_start", "bed_end"), "normal")


@query(f"""WITH {_READS}, {_TESTED} SELECT locus_id, qname, mi, strand, differ, CASE WHEN NOT differ THEN tract END AS tract, CASE WHEN differ AND tract IS NOT NULL THEN '{UP}' || tract || '{DN}' END AS merged,
  reverse('AAA' || snv || 'AAAAAA{UP}') AS up_bases, '{DN}AAAAA' || low || 'AAAA' AS dn_bases FROM frags""")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates to fragments: one molecule, one strand, sides in consensus, different tracts merged by quality."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    made = spark.sql(f"WITH made AS ({_MADE.replace('FROM lineitem', 'FROM {items}')}) {_PAIRED}", items=items)
    kept = made.where(f"flag = 99 AND mapq >= 40 AND sa IS NULL AND tlen <= 1000 AND up = '{UP}' AND dn = '{DN}'")
    mi, strand = extraction.molecule(F.col("mi"))
    side = lambda text: F.struct(F.lit(0).alias("start"), text.alias("bases"))
    mates = kept.withColumns({"molecule": mi, "letter": strand}).where("molecule IS NOT NULL").select(
        "locus_id", "qname", "ord", F.lit(True).alias("spans"), F.col("molecule").alias("mi"), F.col("letter").alias("strand"), "tract",
        side(F.reverse(F.concat(F.lit("AAA"), "snv", F.lit("AAAAAA" + UP)))).alias("up"), side(F.concat(F.lit(DN + "AAAAA"), "low", F.lit("AAAA"))).alias("dn"),
        F.concat("up", "tract", "dn").alias("stretch"), F.array_repeat(F.col("q").cast("int"), 34).alias("quals"),
        F.transform(F.sequence(F.lit(0), F.lit(33)), lambda i: (i > 9) & (i < 24)).alias("in_tract"),
    )
    found = extraction.fragments(mates)
    return found.select("locus_id", "qname", "mi", "strand", "differ", "tract", "merged", F.col("up.bases").alias("up_bases"), F.col("dn.bases").alias("dn_bases"))


# ---- sides of single alignments with gaps and clips -------------------------------------------------

_CUT = """SELECT DISTINCT l_partkey % 5 AS kind, l_suppkey % 7 AS x, l_linenumber AS y, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand_ FROM lineitem"""
_BASES = "ACGTTGCAACGGTTAACCGATCGATTACGGCA"


@query(f"""WITH cut AS ({_CUT}), i AS (SELECT *, CAST(j AS INTEGER) AS j, CASE WHEN j % 9 = y % 9 THEN '.' ELSE substr('{_BASES}', CAST(j AS INTEGER) + 1, 1) END AS b FROM cut, range(32) t(j)),
  r AS (SELECT *, 100 + x + CASE kind WHEN 0 THEN j WHEN 1 THEN CASE WHEN j >= 5 THEN j - 5 END WHEN 2 THEN CASE WHEN j < 12 THEN j ELSE j + 3 END
      WHEN 3 THEN CASE WHEN j < 9 THEN j WHEN j >= 13 THEN j - 4 END ELSE CASE WHEN j < 28 THEN CASE WHEN j < 20 THEN j ELSE j + 1 END END END AS pos FROM i),
  o AS (SELECT *, CASE WHEN pos < 112 THEN 111 - pos WHEN pos >= 120 THEN pos - 120 END AS d, (pos < 112) = (strand_ = '+') AS is_up FROM r WHERE b <> '.' AND (pos < 112 OR pos >= 120)),
  e AS (SELECT kind, x, y, strand_, is_up, min(d) AS first, max(d) AS last FROM o GROUP BY ALL),
  f AS (SELECT e.*, string_agg(coalesce(o.b, '.'), '' ORDER BY g.d) AS text FROM (SELECT *, unnest(range(first, last + 1)) AS d FROM e) g JOIN e USING (kind, x, y, strand_, is_up, first, last)
    LEFT JOIN o ON o.kind = g.kind AND o.x = g.x AND o.y = g.y AND o.strand_ = g.strand_ AND o.is_up = g.is_up AND o.d = g.d GROUP BY ALL),
  t AS (SELECT *, CASE WHEN strand_ = '-' THEN translate(text, 'ACGT', 'TGCA') ELSE text END AS bases FROM f)
  SELECT cut.kind, cut.x, cut.y, cut.strand_ AS orientation, CAST(coalesce(u.first, 0) AS INTEGER) AS up_start, coalesce(u.bases, '') AS up_bases, CAST(coalesce(d.first, 0) AS INTEGER) AS dn_start, coalesce(d.bases, '') AS dn_bases
  FROM cut LEFT JOIN t u ON u.is_up AND u.kind = cut.kind AND u.x = cut.x AND u.y = cut.y AND u.strand_ = cut.strand_ LEFT JOIN t d ON NOT d.is_up AND d.kind = cut.kind AND d.x = cut.x AND d.y = cut.y AND d.strand_ = cut.strand_""")
def alignment_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases on both sides of an interval, by distance, under matches, clips, deletions and insertions."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    cut = spark.sql(_CUT.replace("FROM lineitem", "FROM {items}"), items=items)
    cigar = F.element_at(F.array(*map(F.lit, ("32M", "5S27M", "12M3D20M", "9M4I19M", "20M1D8M4S"))), (F.col("kind") + 1).cast("int"))
    seq = F.concat(*[F.when(F.lit(j) % 9 == F.col("y") % 9, ".").otherwise(b) for j, b in enumerate(_BASES)])
    blocks = al.aligned_blocks(cigar, (100 + F.col("x")).cast("long"))
    up, dn = al.alignment_sides(seq, blocks, F.lit(112).cast("long"), F.lit(120).cast("long"), F.col("strand_"))
    found = cut.withColumns({"up": up, "dn": dn})
    return found.select("kind", "x", "y", F.col("strand_").alias("orientation"), F.col("up.start").alias("up_start"), F.col("up.bases").alias("up_bases"), F.col("dn.start").alias("dn_start"), F.col("dn.bases").alias("dn_bases"))


# ---- reference windows from MD tags ---------------------------------------------------------------------

_SPANS = """SELECT l_orderkey % 12 AS k, l_orderkey * 8 + l_linenumber AS ord, l_partkey % 4 AS kind, CASE WHEN l_suppkey % 3 = 0 THEN 20 ELSE 60 END AS mapq, l_orderkey * 8 + l_linenumber AS id,
  CASE WHEN l_partkey % 5 = 0 THEN 'chr9' END AS sa, CASE WHEN l_orderkey % 24 < 12 THEN 'GGG' ELSE 'TTT' END AS edge, l_partkey % 9 = 0 AS clipped FROM lineitem WHERE l_orderkey % 12 < 10"""
_MID = TRACTS[0]
_CC = "CCCCCCCACCCCCC"


@query(f"""WITH spans AS ({_SPANS}), clean AS (SELECT * FROM spans WHERE mapq >= 40 AND sa IS NULL AND NOT clipped), one AS (SELECT k, arg_min(edge, ord) AS edge FROM clean GROUP BY k),
  w AS (SELECT 'W' || k AS locus_id, CAST(1000 * (k + 1) - 50 AS BIGINT) AS window_start, repeat('A', 47) || edge || CASE WHEN k % 2 = 1 THEN '{_MID}' ELSE '{_CC}' END || repeat('A', 50) AS "window", k, edge FROM one)
  SELECT locus_id, window_start, "window", CASE WHEN k % 2 = 1 THEN '+' ELSE '-' END AS ref_orientation, CAST(CASE WHEN k % 2 = 1 AND edge = 'GGG' THEN 3 ELSE 0 END AS INTEGER) AS walk_up, CAST(0 AS INTEGER) AS walk_dn FROM w""")
def reference_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows rebuilt from the first clean spanning read, through mismatches and deletions, with orientation and G walks."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    spans = spark.sql(_SPANS.replace("FROM lineitem", "FROM {items}"), items=items)
    middle = F.when(F.col("k") % 2 == 1, _MID).otherwise(_CC)
    whole = F.concat(F.lit("A" * 57), "edge", middle, F.lit("A" * 60))  # the window and ten bases on each side
    changed = F.concat(F.left(whole, F.lit(20)), F.lit("T"), F.substring(whole, 22, 200))
    shorter = F.concat(F.left(whole, F.lit(30)), F.substring(whole, 33, 200))
    longer = F.concat(F.left(whole, F.lit(40)), F.lit("CT"), F.substring(whole, 41, 200))
    pick = lambda *x: F.element_at(F.array(*x), (F.col("kind") + 1).cast("int"))
    clip = F.when(F.col("clipped"), "2S").otherwise("")
    reads = spans.select(
        F.lit("chr1").alias("chrom"), "ord", F.lit(0).alias("flag"), (1000 * (F.col("k") + 1) - 60).alias("pos0"), "mapq", "sa", "k",
        F.concat(pick(*map(F.lit, ("134M", "134M", "30M2D102M", "40M2I94M"))), clip).alias("cigar"), F.concat(pick(whole, changed, shorter, longer), F.when(F.col("clipped"), "AA").otherwise("")).alias("seq"),
        pick(*map(F.lit, ("134", "20A113", "30^AA102", "134"))).alias("md"),
    )
    loci = spark.range(10).selectExpr("concat('W', id) AS locus_id", "id AS k", "'chr1' AS chrom", "1000 * (id + 1) AS bed_start", "1000 * (id + 1) + 14 AS bed_end")
    near = reads.withColumn("end0", al.reference_end(F.col("cigar"), F.col("pos0"))).join(loci.drop("chrom"), "k")
    found = geometry.reference_walks(geometry.reference_windows(near), loci.drop("k"))
    return found.select("locus_id", "window_start", "window", "ref_orientation", "walk_up", "walk_dn")
