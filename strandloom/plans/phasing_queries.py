"""Named queries over the derived panel, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import tract as fn
from strandloom.operators import patterns, phasing, tables, viewer
from strandloom.sources import panel as source
from strandloom.sources.shared import settled

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = oracle
        return function

    return register


# ---- SQL building blocks -------------------------------------------------------------------

_READS = """
items AS (SELECT l_orderkey o, l_orderkey // 8 f, l_linenumber n, l_partkey p FROM lineitem),
reads AS (SELECT 'Locus' || (o % 8) AS locus_id, CAST(o AS VARCHAR) AS mi, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS strand, f,
  repeat('G', 6 + f % 3) || CASE WHEN p % 17 = 0 THEN 'C' WHEN f % 7 < 4 THEN 'A' WHEN f % 7 < 6 THEN 'T' ELSE '' END || 'GGGGG' AS seq,
  (CASE WHEN f % 6 = 0 THEN '.' WHEN p % 19 = 0 THEN 'T' WHEN o % 8 = 0 OR f % 5 < 3 THEN 'A' ELSE 'C' END) || 'A' ||
  (CASE WHEN f % 6 = 0 THEN '.' WHEN p % 23 = 0 THEN 'N' WHEN o % 8 = 0 OR (f % 5 < 3 AND f % 11 > 0) OR (f % 5 > 2 AND f % 11 = 0) THEN 'G' ELSE 'T' END) ||
  (CASE WHEN f % 6 = 0 OR (f % 5 < 3 AND (f // 30) % 4 > 0) THEN '.' WHEN o % 8 = 0 OR f % 5 < 3 THEN 'C' ELSE 'A' END) || '|' ||
  (CASE WHEN o % 8 = 0 OR f % 6 > 0 THEN '.' WHEN f % 5 < 3 THEN 'T' ELSE 'G' END) || (CASE WHEN p % 10 = 0 THEN 'G' ELSE 'C' END) || 'T' AS flanking_seq
  FROM items)"""


def _panel(name: str, where: str = "true", prefix: str = "", up_width: int = 4, shift: int = 0) -> str:
    """Rows, loci, family bases and counts of a panel, under names that end in name."""
    return f"""
panel{name} AS (SELECT locus_id, mi, strand, seq, '{prefix}' || flanking_seq AS flanking_seq, count(*) AS cnt FROM reads WHERE {where} GROUP BY ALL),
loci{name} AS (SELECT 'Locus' || k AS locus_id, CASE WHEN k % 2 = 1 THEN '+' ELSE '-' END AS ref_orientation, {up_width} AS up_width, 3 AS dn_width,
  CASE WHEN k % 2 = 1 THEN 1000 * (k + 1) - {shift} ELSE 1000 * (k + 1) + 100 + {shift} END AS up_start,
  CASE WHEN k % 2 = 1 THEN 1000 * (k + 1) + 100 ELSE 1000 * (k + 1) + 50 END AS dn_start FROM range(8) t(k)),
cells{name} AS (SELECT locus_id, mi, strand, cnt, i - 1 AS off, substr(flanking_seq, CAST(i AS INTEGER), 1) AS b FROM panel{name}, range(1, {up_width + 5}) t(i) WHERE i <> {up_width + 1}),
fsum{name} AS (SELECT locus_id, mi, off, b, sum(cnt) AS w FROM cells{name} WHERE b IN ('A', 'C', 'G', 'T') GROUP BY ALL),
fmax{name} AS (SELECT *, max(w) OVER (PARTITION BY locus_id, mi, off) AS m FROM fsum{name}),
fam{name} AS (SELECT locus_id, mi, off, min(b) AS b FROM fmax{name} WHERE w = m GROUP BY locus_id, mi, off HAVING count(*) = 1),
fcnt{name} AS (SELECT locus_id, off, b, count(*) AS n FROM fam{name} GROUP BY ALL)"""


def _phased(name: str) -> str:
    """Variants, linkage and profiles of a panel."""
    return f"""
top{name} AS (SELECT *, row_number() OVER (PARTITION BY locus_id, off ORDER BY n DESC, b DESC) AS r, sum(n) OVER (PARTITION BY locus_id, off) AS cov FROM fcnt{name}),
snv{name} AS (SELECT a.locus_id, a.off, a.b AS allele_major, i.b AS allele_minor, CAST(i.n AS DOUBLE) / CAST(a.cov AS DOUBLE) AS vaf_minor, CAST(a.cov AS BIGINT) AS coverage
  FROM top{name} a JOIN top{name} i ON a.locus_id = i.locus_id AND a.off = i.off AND a.r = 1 AND i.r = 2
  WHERE a.cov >= 25 AND CAST(i.n AS DOUBLE) / CAST(a.cov AS DOUBLE) >= 0.2),
anc{name} AS (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY coverage DESC, off) = 1 AS is_anchor FROM snv{name}),
alle{name} AS (SELECT f.locus_id, f.mi, f.off, a.is_anchor, CASE WHEN f.b = a.allele_major THEN 'M' WHEN f.b = a.allele_minor THEN 'm' END AS x
  FROM fam{name} f JOIN anc{name} a ON f.locus_id = a.locus_id AND f.off = a.off),
pair{name} AS (SELECT k.locus_id, k.off, count(*) FILTER (a.x = 'M' AND k.x = 'M') AS both_major, count(*) FILTER (a.x = 'm' AND k.x = 'm') AS both_minor,
  count(*) FILTER (a.x = 'M' AND k.x = 'm') AS major_minor, count(*) FILTER (a.x = 'm' AND k.x = 'M') AS minor_major
  FROM alle{name} k JOIN alle{name} a ON a.locus_id = k.locus_id AND a.mi = k.mi AND a.is_anchor WHERE NOT k.is_anchor GROUP BY ALL),
link{name} AS (SELECT a.*, coalesce(both_major + both_minor, 0) AS ins, coalesce(major_minor + minor_major, 0) AS outs FROM anc{name} a LEFT JOIN pair{name} p ON a.locus_id = p.locus_id AND a.off = p.off),
hap{name} AS (SELECT l.locus_id, l.off, CASE WHEN l.off < up_width THEN 'up' ELSE 'dn' END AS segment,
  CASE WHEN l.off < up_width THEN l.off ELSE l.off - up_width - 1 END AS string_index,
  CASE WHEN ref_orientation = '-' THEN -1 ELSE 1 END * CASE WHEN l.off < up_width THEN l.off ELSE l.off - up_width - 1 END + CASE WHEN l.off < up_width THEN up_start ELSE dn_start END AS ref_pos,
  allele_major, allele_minor, vaf_minor, coverage, is_anchor OR ins + outs >= 10 AS ok, is_anchor AS anchor_, ins, outs,
  CASE WHEN NOT is_anchor AND outs > ins THEN allele_minor ELSE allele_major END AS hma, CASE WHEN NOT is_anchor AND outs > ins THEN allele_major ELSE allele_minor END AS hmi
  FROM link{name} l JOIN loci{name} g ON l.locus_id = g.locus_id)"""


def _votes(name: str, profile: str) -> str:
    """Row votes and labels of a panel against a profile table (locus_id, off, hma, hmi)."""
    return f"""
vote{name} AS (SELECT r.locus_id, r.mi, r.strand, r.seq, r.flanking_seq, r.cnt,
  count(*) FILTER (h.off IS NOT NULL AND substr(r.flanking_seq, CAST(h.off AS INTEGER) + 1, 1) = h.hma) AS n_major,
  count(*) FILTER (h.off IS NOT NULL AND substr(r.flanking_seq, CAST(h.off AS INTEGER) + 1, 1) = h.hmi) AS n_minor,
  count(*) FILTER (h.off IS NOT NULL AND substr(r.flanking_seq, CAST(h.off AS INTEGER) + 1, 1) NOT IN (h.hma, h.hmi, '.')) AS n_other
  FROM panel{name} r LEFT JOIN {profile} h ON r.locus_id = h.locus_id GROUP BY ALL),
lab{name} AS (SELECT *, CASE WHEN n_major > n_minor THEN 'hap_major' WHEN n_minor > n_major THEN 'hap_minor' ELSE 'unk' END AS phase_label FROM vote{name}),
psum{name} AS (SELECT locus_id, mi, regexp_extract_all(seq, '[^G]+') AS pat, sum(cnt) AS w FROM panel{name} GROUP BY ALL),
maj{name} AS (SELECT locus_id, mi, pat FROM psum{name} QUALIFY row_number() OVER (PARTITION BY locus_id, mi ORDER BY w DESC, pat) = 1),
share{name} AS (SELECT locus_id, pat, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY locus_id) AS DOUBLE) AS s FROM maj{name} GROUP BY locus_id, pat)"""


_TEXT = "CASE WHEN len(pat) = 0 THEN '-' ELSE array_to_string(pat, '_') END"
_ONE = "WITH " + _READS + "," + _panel("")
_PHASE = _ONE + "," + _phased("") + ", prof AS (SELECT locus_id, off, hma, hmi FROM hap WHERE ok)," + _votes("", "prof")
_PAIR = (
    "WITH " + _READS + "," + _panel("_r", "f % 2 = 0") + "," + _phased("_r") + ", prof_r AS (SELECT locus_id, off, hma, hmi FROM hap_r WHERE ok)," + _votes("_r", "prof_r")
    + "," + _panel("_t", "f % 2 = 1", "TT", 6, 2)
    + """, map_t AS (SELECT h.*, CASE WHEN ui BETWEEN 0 AND up_width - 1 THEN ui WHEN di BETWEEN 0 AND dn_width - 1 THEN up_width + 1 + di END AS t_off FROM
  (SELECT h.locus_id, h.ref_pos, h.allele_major, h.allele_minor, h.hma, h.hmi, h.anchor_, g.up_width, g.dn_width,
   CASE WHEN g.ref_orientation = '-' THEN g.up_start - h.ref_pos ELSE h.ref_pos - g.up_start END AS ui,
   CASE WHEN g.ref_orientation = '-' THEN g.dn_start - h.ref_pos ELSE h.ref_pos - g.dn_start END AS di
   FROM hap_r h JOIN loci_t g ON h.locus_id = g.locus_id WHERE h.ok) h),
  prof_t AS (SELECT locus_id, t_off AS off, hma, hmi FROM map_t WHERE t_off IS NOT NULL),""" + _votes("_t", "prof_t")
)


def _settled(panel: source.Panel) -> source.Panel:
    """A panel as it is read from where it is saved: deduplicated once."""
    return source.Panel(settled(panel.rows), panel.loci)


def _phase(spark: SparkSession, sf_dir: str):
    panel = _settled(source.derived_panel(spark, sf_dir))
    return panel, tables.phase(panel)


def _target(spark: SparkSession, sf_dir: str):
    reference, target = map(_settled, source.derived_pair(spark, sf_dir))
    return target, tables.phase_by_reference(target, tables.phase(reference).snvs)


# ---- scalar functions ------------------------------------------------------------------------


@query(_ONE + " SELECT DISTINCT seq, array_to_string(list_transform(regexp_split_to_array(seq, '[^G]+'), lambda x: CAST(length(x) AS VARCHAR)), ',') AS runs FROM panel")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.derived_panel(spark, sf_dir).rows.select("seq").distinct()
    return rows.select("seq", F.array_join(F.transform(fn.run_lengths(F.col("seq")), lambda n: n.cast("string")), ",").alias("runs"))


@query(_ONE + f" SELECT DISTINCT seq, {_TEXT} AS pattern FROM (SELECT seq, regexp_extract_all(seq, '[^G]+') AS pat FROM panel)")
def interrupter_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.derived_panel(spark, sf_dir).rows.select("seq").distinct()
    return rows.select("seq", fn.format_pattern(fn.interrupter_pattern(F.col("seq"))).alias("pattern"))


@query(_ONE + " SELECT DISTINCT flanking_seq, reverse(translate(flanking_seq, 'ACGTNacgtn', 'TGCANtgcan')) AS rc FROM panel")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.derived_panel(spark, sf_dir).rows.select("flanking_seq").distinct()
    return rows.select("flanking_seq", fn.revcomp(F.col("flanking_seq")).alias("rc"))


@query("""SELECT DISTINCT p_type, CASE WHEN length(s) - length(replace(s, 'G', '')) >= length(s) - length(replace(s, 'C', '')) THEN '+' ELSE '-' END AS orientation,
  length(regexp_extract(s, 'G*$')) AS walk_up, length(regexp_extract(s, '^G*')) AS walk_dn
  FROM (SELECT p_type, translate(upper(p_type), 'AEIOU', 'GGCCG') AS s FROM part)""")
def orientation_gwalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type").distinct()
    s = F.translate(F.upper("p_type"), "AEIOU", "GGCCG")
    before, after = fn.g_walk(s, s)
    return part.select("p_type", fn.orientation(s).alias("orientation"), before.cast("long").alias("walk_up"), after.cast("long").alias("walk_dn"))


@query(_ONE + """ SELECT locus_id, i AS idx, CASE WHEN ref_orientation = '-' THEN up_start - i ELSE up_start + i END AS ref_pos,
  CASE WHEN i < up_width THEN i END AS back FROM loci, range(7) t(i)""")
def ref_pos_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    loci = source.derived_loci(spark).crossJoin(F.broadcast(spark.range(7).withColumnRenamed("id", "idx")))
    pos = fn.ref_pos_at_offset(F.col("ref_orientation"), F.col("up_start"), F.col("idx"))
    back = fn.offset_at_ref_pos(F.col("ref_orientation"), F.col("up_start"), pos, F.col("up_width"))
    return loci.select("locus_id", "idx", pos.alias("ref_pos"), back.alias("back"))


# ---- panel and counts --------------------------------------------------------------------------


@query(_ONE + " SELECT locus_id, mi, strand, seq, flanking_seq, cnt FROM panel")
def panel_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.derived_panel(spark, sf_dir).rows


@query(_ONE + """ , r AS (SELECT locus_id, cnt, list_transform(regexp_split_to_array(seq, '[^G]+'), lambda x: length(x)) AS l FROM panel),
  m AS (SELECT locus_id, CAST(max(len(l)) AS INTEGER) AS n_runs, CAST(max(list_max(l)) AS INTEGER) AS max_run, CAST(sum(cnt) AS BIGINT) AS n_reads FROM r GROUP BY locus_id)
  SELECT *, CAST((SELECT max(max_run) FROM m) + 1 AS INTEGER) AS n_alleles FROM m""")
def panel_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = source.run_meta(source.derived_panel(spark, sf_dir).rows)
    return meta.crossJoin(F.broadcast(source.panel_info(meta)))


_COUNTS = ", ".join(f"CAST(coalesce(sum(cnt) FILTER (b = '{b}'), 0) AS BIGINT) AS n_{n}" for b, n in zip("ACGTN.", ["A", "C", "G", "T", "N", "pad"], strict=True))
_STRANDS = ", ".join(
    f"CAST(coalesce(sum(cnt) FILTER (b = '{b}' AND strand = '{s}'), 0) AS BIGINT) AS {s}_{n}" for s in "AB" for b, n in zip("ACGTN.", ["A", "C", "G", "T", "N", "pad"], strict=True)
)
_FAMILIES = ", ".join(f"CAST(coalesce(sum(n) FILTER (b = '{b}'), 0) AS BIGINT) AS fam_{b}" for b in "ACGT")


@query(_ONE + f' SELECT locus_id, CAST(off AS INTEGER) AS "offset", {_COUNTS} FROM cells GROUP BY locus_id, off')
def position_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.position_frequencies(source.derived_panel(spark, sf_dir).rows)


@query(_ONE + f""", s AS (SELECT locus_id, off, {_STRANDS} FROM cells GROUP BY ALL), k AS (SELECT locus_id, off, {_FAMILIES} FROM fcnt GROUP BY ALL)
  SELECT s.locus_id, CAST(s.off AS INTEGER) AS "offset", s.* EXCLUDE (locus_id, off), coalesce(fam_A, 0) AS fam_A, coalesce(fam_C, 0) AS fam_C, coalesce(fam_G, 0) AS fam_G, coalesce(fam_T, 0) AS fam_T
  FROM s LEFT JOIN k ON s.locus_id = k.locus_id AND s.off = k.off""")
def strand_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.strand_base_counts(source.derived_panel(spark, sf_dir).rows)


@query(_ONE + f' SELECT locus_id, CAST(off AS INTEGER) AS "offset", {_FAMILIES} FROM fcnt GROUP BY locus_id, off')
def family_consensus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phasing.family_counts(phasing.call_patterns(source.derived_panel(spark, sf_dir).rows))


# ---- phasing -----------------------------------------------------------------------------------


@query(_PHASE + ' SELECT f.locus_id, f.mi, CAST(f.off AS INTEGER) AS "offset", f.b AS base FROM fam f JOIN snv s ON f.locus_id = s.locus_id AND f.off = s.off')
def family_bases_at_snvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _settled(source.derived_panel(spark, sf_dir))
    return phasing.family_bases(panel.rows, phasing.informative_snvs(panel))


@query(_PHASE + ' SELECT locus_id, CAST(off AS INTEGER) AS "offset", allele_major, allele_minor, round(vaf_minor, 6) AS vaf_minor, coverage, segment, CAST(string_index AS BIGINT) AS string_index, CAST(ref_pos AS BIGINT) AS ref_pos FROM hap')
def informative_snvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phasing.informative_snvs(source.derived_panel(spark, sf_dir))
    return found.withColumn("vaf_minor", F.round("vaf_minor", 6))


@query(_PHASE + ' SELECT a.locus_id, CAST(a.off AS INTEGER) AS "offset", coalesce(both_major, 0) AS both_major, coalesce(both_minor, 0) AS both_minor, coalesce(major_minor, 0) AS major_minor, coalesce(minor_major, 0) AS minor_major FROM anc a LEFT JOIN pair p ON a.locus_id = p.locus_id AND a.off = p.off WHERE NOT a.is_anchor')
def snv_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _settled(source.derived_panel(spark, sf_dir))
    return phasing.linkage(panel, phasing.informative_snvs(panel))


_HAP = """CASE WHEN ok THEN 'phased' ELSE 'dropped_low_linkage' END AS status, CASE WHEN ok THEN hma END AS hap_major_base, CASE WHEN ok THEN hmi END AS hap_minor_base,
  CASE WHEN ok THEN anchor_ END AS is_anchor, CASE WHEN ok THEN CASE WHEN anchor_ THEN 0.0 ELSE round(CAST(least(ins, outs) AS DOUBLE) / (ins + outs), 6) END END AS pair_discordance,
  CASE WHEN ok THEN CASE WHEN anchor_ THEN coverage ELSE ins + outs END END AS pair_double_coverage"""


@query(_PHASE + f' SELECT locus_id, CAST(off AS INTEGER) AS "offset", {_HAP.replace("CASE WHEN anchor_ THEN 0.0", "CASE WHEN anchor_ THEN CAST(0 AS DOUBLE)")} FROM hap')
def flanking_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, phased = _phase(spark, sf_dir)
    return phased.snvs.select(
        "locus_id", "offset", "status", "hap_major_base", "hap_minor_base", "is_anchor", F.round("pair_discordance", 6).alias("pair_discordance"), "pair_double_coverage"
    )


@query(_PHASE + " SELECT locus_id, mi, strand, seq, flanking_seq, CAST(n_major AS INTEGER) AS n_major, CAST(n_minor AS INTEGER) AS n_minor, CAST(n_other AS INTEGER) AS n_other FROM vote")
def row_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phase(spark, sf_dir)[1].rows.drop("cnt", "phase_label")


@query(_PHASE + " SELECT locus_id, phase_label, count(*) AS n_rows, CAST(sum(cnt) AS BIGINT) AS reads FROM lab GROUP BY ALL")
def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _phase(spark, sf_dir)[1].rows
    return rows.groupBy("locus_id", "phase_label").agg(F.count("*").alias("n_rows"), F.sum("cnt").alias("reads"))


@query(_PHASE + f""" SELECT l.locus_id, l.mi, strand, cnt AS "count", {_TEXT} AS interrupter_pattern, phase_label, CAST(n_major AS INTEGER) AS n_major, CAST(n_minor AS INTEGER) AS n_minor,
  CAST(n_other AS INTEGER) AS n_other FROM lab l JOIN maj m ON l.locus_id = m.locus_id AND l.mi = m.mi""")
def haplotype_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.haplotype_calls(_phase(spark, sf_dir)[1])


@query(_PHASE + f""" SELECT locus_id, CAST(ref_pos AS BIGINT) AS ref_pos, segment, CAST(string_index AS BIGINT) AS string_index, allele_major, allele_minor, round(vaf_minor, 6) AS vaf_minor, coverage,
  {_HAP.replace("CASE WHEN anchor_ THEN 0.0", "CASE WHEN anchor_ THEN CAST(0 AS DOUBLE)")} FROM hap""")
def snv_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.snv_calls(_phase(spark, sf_dir)[1])
    return found.withColumn("vaf_minor", F.round("vaf_minor", 6)).withColumn("pair_discordance", F.round("pair_discordance", 6))


_READS_BY_LABEL = """CAST(sum(cnt) AS BIGINT) AS reads_total, CAST(coalesce(sum(cnt) FILTER (phase_label = 'hap_major'), 0) AS BIGINT) AS reads_major,
  CAST(coalesce(sum(cnt) FILTER (phase_label = 'hap_minor'), 0) AS BIGINT) AS reads_minor, CAST(coalesce(sum(cnt) FILTER (phase_label = 'unk'), 0) AS BIGINT) AS reads_unk"""


@query(_PHASE + f""", tot AS (SELECT locus_id, count(DISTINCT mi) AS n_rfs, count(*) AS n_rows, {_READS_BY_LABEL} FROM lab GROUP BY locus_id),
  adm AS (SELECT locus_id, string_agg({_TEXT} || ':' || format('{{:.4g}}', s), ';' ORDER BY s DESC, pat) AS admitted_patterns, count(*) AS n_admitted_patterns FROM share WHERE s >= 0.1 GROUP BY locus_id),
  hp AS (SELECT locus_id, string_agg(hma, '' ORDER BY off) FILTER (ok) AS a, string_agg(hmi, '' ORDER BY off) FILTER (ok) AS i, count(*) FILTER (ok) AS np, count(*) FILTER (NOT ok) AS nd,
    max(CASE WHEN ok AND NOT anchor_ THEN CAST(least(ins, outs) AS DOUBLE) / (ins + outs) END) AS md, max(coverage) FILTER (anchor_) AS na FROM hap GROUP BY locus_id),
  con AS (SELECT l.locus_id, phase_label, {_TEXT} AS t, count(*) AS n FROM lab l JOIN maj m ON l.locus_id = m.locus_id AND l.mi = m.mi GROUP BY ALL),
  cs AS (SELECT locus_id, phase_label, CAST(max(n) AS DOUBLE) / sum(n) AS s FROM con GROUP BY ALL)
  SELECT g.locus_id, coalesce(n_rfs, 0) AS n_rfs, coalesce(n_rows, 0) AS n_rows, coalesce(admitted_patterns, '') AS admitted_patterns, coalesce(n_admitted_patterns, 0) AS n_admitted_patterns,
   coalesce(a, '') AS hap_major_profile, coalesce(i, '') AS hap_minor_profile, coalesce(np, 0) AS n_snvs_phased, coalesce(nd, 0) AS n_snvs_dropped_low_linkage, round(coalesce(md, 0), 6) AS max_discordance,
   coalesce(na, 0) AS n_anchor_families, coalesce(reads_total, 0) AS reads_total, coalesce(reads_major, 0) AS reads_major, coalesce(reads_minor, 0) AS reads_minor, coalesce(reads_unk, 0) AS reads_unk,
   round((SELECT s FROM cs WHERE cs.locus_id = g.locus_id AND phase_label = 'hap_major'), 6) AS phase_interrupter_concordance_major,
   round((SELECT s FROM cs WHERE cs.locus_id = g.locus_id AND phase_label = 'hap_minor'), 6) AS phase_interrupter_concordance_minor
  FROM loci g LEFT JOIN tot ON tot.locus_id = g.locus_id LEFT JOIN adm ON adm.locus_id = g.locus_id LEFT JOIN hp ON hp.locus_id = g.locus_id""")
def locus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, phased = _phase(spark, sf_dir)
    out = tables.locus_summary(panel, phased)
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


# ---- patterns ----------------------------------------------------------------------------------


@query(_PHASE + f" SELECT locus_id, mi, {_TEXT} AS pattern FROM maj")
def majority_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.majority_patterns(source.derived_panel(spark, sf_dir).rows)
    return found.withColumn("pattern", fn.format_pattern(F.col("pattern")))


@query(_PHASE + f" SELECT locus_id, {_TEXT} AS pattern, n, round(s, 6) AS share FROM share")
def pattern_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = patterns.pattern_shares(patterns.majority_patterns(source.derived_panel(spark, sf_dir).rows))
    return shares.select("locus_id", fn.format_pattern(F.col("pattern")).alias("pattern"), "n", F.round("share", 6).alias("share"))


@query(_PHASE + f" SELECT locus_id, {_TEXT} AS pattern, n, round(s, 6) AS share FROM share WHERE s >= 0.1")
def patterns_above_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = patterns.above(patterns.pattern_shares(patterns.majority_patterns(source.derived_panel(spark, sf_dir).rows)))
    return shares.select("locus_id", fn.format_pattern(F.col("pattern")).alias("pattern"), "n", F.round("share", 6).alias("share"))


@query(_PHASE + f""", rl AS (SELECT *, list_transform(regexp_split_to_array(seq, '[^G]+'), lambda x: length(x)) AS l FROM panel),
  nr AS (SELECT locus_id, max(len(l)) AS n FROM rl GROUP BY locus_id)
  SELECT rl.locus_id, rl.mi, strand, seq, flanking_seq, cnt, {_TEXT} AS pattern, CASE WHEN len(l) <> n THEN '—' WHEN len(l) = 1 THEN '(' || l[1] || ',)'
    ELSE '(' || array_to_string(list_transform(l, lambda x: CAST(x AS VARCHAR)), ', ') || ')' END AS tuple_str
  FROM rl JOIN nr ON rl.locus_id = nr.locus_id JOIN maj m ON rl.locus_id = m.locus_id AND rl.mi = m.mi""")
def pattern_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.breakdown(source.derived_panel(spark, sf_dir).rows).drop("n_runs")


@query(_PHASE + f""", con AS (SELECT l.locus_id, phase_label, {_TEXT} AS t, count(*) AS n FROM lab l JOIN maj m ON l.locus_id = m.locus_id AND l.mi = m.mi WHERE phase_label <> 'unk' GROUP BY ALL),
  cs AS (SELECT locus_id, phase_label, CAST(max(n) AS DOUBLE) / sum(n) AS s FROM con GROUP BY ALL)
  SELECT locus_id, round(max(s) FILTER (phase_label = 'hap_major'), 6) AS phase_interrupter_concordance_major, round(max(s) FILTER (phase_label = 'hap_minor'), 6) AS phase_interrupter_concordance_minor
  FROM cs GROUP BY locus_id""")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = patterns.concordance(tables.haplotype_calls(_phase(spark, sf_dir)[1]))
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


# ---- phasing against a reference ----------------------------------------------------------------


@query(_PAIR + " SELECT locus_id, CAST(ref_pos AS BIGINT) AS ref_pos, CAST(t_off AS INTEGER) AS target_offset, hma AS hap_major_base, hmi AS hap_minor_base, anchor_ AS is_anchor FROM map_t WHERE t_off IS NOT NULL")
def ref_snv_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, target = source.derived_pair(spark, sf_dir)
    found = tables.remap(tables.phase(reference).snvs, target.loci)
    return found.select("locus_id", "ref_pos", "target_offset", "hap_major_base", "hap_minor_base", "is_anchor")


@query(_PAIR + " SELECT locus_id, mi, strand, seq, flanking_seq, phase_label, CAST(n_major AS INTEGER) AS n_major, CAST(n_minor AS INTEGER) AS n_minor, CAST(n_other AS INTEGER) AS n_other FROM lab_t")
def ref_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target(spark, sf_dir)[1].rows.drop("cnt")


@query(_PAIR + f""", us AS (SELECT locus_id, count(*) AS n FROM prof_t GROUP BY locus_id),
  tot AS (SELECT locus_id, count(*) AS n_rows, count(DISTINCT mi) AS n_families, count(DISTINCT mi) FILTER (phase_label <> 'unk') AS n_families_labeled, {_READS_BY_LABEL} FROM lab_t GROUP BY locus_id)
  SELECT g.locus_id, coalesce(us.n, 0) AS n_usable_snvs, coalesce(n_rows, 0) AS n_rows, coalesce(n_families, 0) AS n_families, coalesce(n_families_labeled, 0) AS n_families_labeled,
  coalesce(reads_total, 0) AS reads_total, coalesce(reads_major, 0) AS reads_major, coalesce(reads_minor, 0) AS reads_minor, coalesce(reads_unk, 0) AS reads_unk
  FROM loci_t g LEFT JOIN us ON us.locus_id = g.locus_id LEFT JOIN tot ON tot.locus_id = g.locus_id""")
def ref_phasing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ref_phasing_summary(*_target(spark, sf_dir))


@query(_PAIR + f""", k AS (SELECT locus_id, off, sum(n) AS cov, {_FAMILIES} FROM fcnt_t GROUP BY ALL)
  SELECT m.locus_id, CAST(ref_pos AS BIGINT) AS ref_pos, CASE WHEN t_off < up_width THEN 'up' ELSE 'dn' END AS segment, CAST(CASE WHEN t_off < up_width THEN t_off ELSE t_off - up_width - 1 END AS BIGINT) AS string_index,
  allele_major, allele_minor, round(CASE allele_minor WHEN 'A' THEN fam_A WHEN 'C' THEN fam_C WHEN 'G' THEN fam_G ELSE fam_T END / CAST(cov AS DOUBLE), 6) AS vaf_minor, CAST(coalesce(cov, 0) AS BIGINT) AS coverage,
  hma AS hap_major_base, hmi AS hap_minor_base, anchor_ AS is_anchor, CAST(NULL AS DOUBLE) AS pair_discordance, CAST(NULL AS BIGINT) AS pair_double_coverage
  FROM map_t m LEFT JOIN k ON m.locus_id = k.locus_id AND m.t_off = k.off WHERE t_off IS NOT NULL""")
def target_snv_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.snv_calls(_target(spark, sf_dir)[1]).drop("status")
    return found.withColumn("vaf_minor", F.round("vaf_minor", 6))


# ---- viewer --------------------------------------------------------------------------------------

_TOP = "row_number() OVER (PARTITION BY {0} ORDER BY reads DESC, {1})"


@query(_ONE + f""", t AS (SELECT locus_id, seq, CAST(sum(cnt) AS BIGINT) AS reads, count(DISTINCT mi) AS molecules FROM panel GROUP BY ALL),
  r AS (SELECT *, CAST({_TOP.format("locus_id", "seq")} AS INTEGER) AS rank FROM t)
  SELECT *, CAST(0 AS BIGINT) AS reads_not_shown FROM r WHERE rank <= 200""")
def tract_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.tracts(source.derived_panel(spark, sf_dir).rows)


_RUNS = """, runs AS (SELECT locus_id, phase_label, CAST(list_max(list_transform(regexp_split_to_array(seq, '[^G]+'), lambda x: length(x))) AS INTEGER) AS largest_run, CAST(sum(cnt) AS BIGINT) AS reads FROM lab GROUP BY ALL)"""


@query(_PHASE + _RUNS + " SELECT locus_id, phase_label, largest_run, CAST(sum(reads) AS BIGINT) AS reads FROM runs GROUP BY ALL")
def largest_run_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.largest_runs(_phase(spark, sf_dir)[1].rows)


@query(_PHASE + _RUNS + """, rs AS (SELECT locus_id, phase_label, largest_run, sum(reads) AS reads FROM runs GROUP BY ALL)
  SELECT locus_id, phase_label, largest_run, round(reads / CAST(sum(reads) OVER (PARTITION BY locus_id, phase_label) AS DOUBLE), 6) AS share FROM rs""")
def largest_run_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.largest_run_shares(_phase(spark, sf_dir)[1].rows).withColumn("share", F.round("share", 6))


_PILE = _PHASE + f""", cols AS (SELECT locus_id, off FROM snv UNION SELECT locus_id, i FROM loci, range(1, 4) t(i) UNION SELECT locus_id, i FROM loci, range(5, 8) t(i)),
  shown AS (SELECT l.locus_id, phase_label, seq, mi, flanking_seq, cnt, string_agg(substr(flanking_seq, CAST(off AS INTEGER) + 1, 1), '' ORDER BY off) AS shown FROM lab l JOIN cols c ON l.locus_id = c.locus_id
    GROUP BY l.locus_id, phase_label, seq, mi, strand, flanking_seq, cnt),
  agg AS (SELECT locus_id, phase_label, seq, shown, CAST(sum(cnt) AS BIGINT) AS reads, count(DISTINCT mi) AS molecules, min(flanking_seq) AS any_seq FROM shown GROUP BY ALL),
  ranked AS (SELECT *, CAST({_TOP.format("locus_id, phase_label", "seq, shown")} AS INTEGER) AS rank FROM agg),
  pile AS (SELECT *, CAST(coalesce(sum(reads) FILTER (rank > 150) OVER (PARTITION BY locus_id, phase_label), 0) AS BIGINT) AS reads_not_shown FROM ranked)"""


@query(_PILE + " SELECT locus_id, phase_label, seq, shown, reads, molecules, rank, reads_not_shown FROM pile WHERE rank <= 150")
def pileup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.pileup(*_phase(spark, sf_dir)).drop("differs")


@query(_PILE + """, d AS (SELECT p.locus_id, phase_label, seq, shown, string_agg(CAST(h.off AS VARCHAR), ',' ORDER BY h.off) FILTER (phase_label <> 'unk' AND substr(any_seq, CAST(h.off AS INTEGER) + 1, 1) <> '.'
    AND substr(any_seq, CAST(h.off AS INTEGER) + 1, 1) <> CASE phase_label WHEN 'hap_major' THEN hma ELSE hmi END) AS differs
  FROM pile p LEFT JOIN prof h ON p.locus_id = h.locus_id WHERE rank <= 150 GROUP BY ALL) SELECT locus_id, phase_label, seq, shown, coalesce(differs, '') AS differs FROM d""")
def pileup_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.pileup(*_phase(spark, sf_dir)).select("locus_id", "phase_label", "seq", "shown", "differs")


@query(_PHASE + " SELECT locus_id, phase_label, CAST(sum(cnt) AS BIGINT) AS reads, count(DISTINCT mi) AS molecules FROM lab GROUP BY ALL")
def label_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viewer.sections(_phase(spark, sf_dir)[1].rows)


def _overview_sql(name: str, snvs: str) -> str:
    return f"""(SELECT p.locus_id, CAST(sum(cnt) AS BIGINT) AS n_reads, count(DISTINCT mi) AS molecules,
      CAST(max(list_max(list_transform(regexp_split_to_array(seq, '[^G]+'), lambda x: length(x)))) AS INTEGER) AS largest_run,
      coalesce(any_value(s.ph), 0) AS phased, coalesce(any_value(s.dr), 0) AS dropped
      FROM panel{name} p LEFT JOIN (SELECT locus_id, count(*) FILTER (ok) AS ph, count(*) FILTER (NOT ok) AS dr FROM {snvs} GROUP BY locus_id) s ON p.locus_id = s.locus_id GROUP BY p.locus_id)"""


@query(_PAIR + f""" SELECT coalesce(a.locus_id, b.locus_id) AS locus_id, a.n_reads AS n_reads_1, a.molecules AS molecules_1, a.largest_run AS largest_run_1, a.phased AS phased_1, a.dropped AS dropped_1,
  b.n_reads AS n_reads_2, b.molecules AS molecules_2, b.largest_run AS largest_run_2, b.phased AS phased_2, b.dropped AS dropped_2
  FROM {_overview_sql("_r", "hap_r")} a FULL JOIN (SELECT * FROM {_overview_sql("_t", "(SELECT locus_id, true AS ok FROM prof_t)")} WHERE locus_id <> 'Locus3') b ON a.locus_id = b.locus_id""")
def locus_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference, target = source.derived_pair(spark, sf_dir)
    snvs = tables.phase(reference).snvs
    second = viewer.panel_overview(target, tables.phase_by_reference(target, snvs).snvs)
    # the second panel lacks a locus
    return viewer.locus_list(viewer.panel_overview(reference, snvs), second.where("locus_id <> 'Locus3'"))


_ORD = ", ord AS (SELECT *, row_number() OVER (PARTITION BY locus_id ORDER BY mi, strand, seq, flanking_seq) AS row_ord FROM panel)"


@query(_ONE + _ORD + """, saved AS (SELECT locus_id, mi, strand, cnt, CASE WHEN locus_id = 'Locus5' THEN row_ord + 1 ELSE row_ord END AS row_ord FROM ord)
  SELECT coalesce(s.locus_id, o.locus_id) AS locus_id, count(*) AS n_rows, count(*) FILTER (s.mi IS DISTINCT FROM o.mi OR s.strand IS DISTINCT FROM o.strand OR s.cnt IS DISTINCT FROM o.cnt) AS n_mismatches
  FROM saved s FULL JOIN ord o ON s.locus_id = o.locus_id AND s.row_ord = o.row_ord GROUP BY 1""")
def label_digest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.with_order(source.derived_panel(spark, sf_dir).rows)
    # a stale table: one locus has moved by a row
    saved = rows.withColumn("row_ord", F.col("row_ord") + (F.col("locus_id") == "Locus5").cast("long"))
    return viewer.order_mismatches(saved, rows)


@query(_ONE + """, other AS (SELECT locus_id, mi, strand, seq, flanking_seq, CASE WHEN locus_id = 'Locus2' THEN cnt + 1 ELSE cnt END AS cnt FROM panel WHERE locus_id <> 'Locus6'),
  base AS (SELECT locus_id, mi, strand, seq, flanking_seq, cnt FROM panel)
  SELECT *, 'left' AS side, 1::BIGINT AS n FROM (SELECT * FROM base EXCEPT SELECT * FROM other) UNION ALL SELECT *, 'right', 1 FROM (SELECT * FROM other EXCEPT SELECT * FROM base)""")
def panel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.derived_panel(spark, sf_dir).rows
    other = rows.where("locus_id <> 'Locus6'").withColumn("cnt", F.col("cnt") + (F.col("locus_id") == "Locus2").cast("long"))
    return viewer.differing_rows(rows, other)


@query("""WITH bed AS (SELECT DISTINCT 'L' || l_suppkey AS locus_id FROM lineitem), flanks AS (SELECT DISTINCT 'L' || (l_partkey % 150 + 20) AS locus_id FROM lineitem)
  SELECT locus_id, 'missing' AS side FROM (SELECT * FROM bed EXCEPT SELECT * FROM flanks) UNION ALL SELECT locus_id, 'extra' FROM (SELECT * FROM flanks EXCEPT SELECT * FROM bed)""")
def flank_table_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.sources.flanks import key_differences

    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bed = items.select(F.concat(F.lit("L"), "l_suppkey").alias("locus_id")).distinct()
    flanks = items.select(F.concat(F.lit("L"), F.col("l_partkey") % 150 + 20).alias("locus_id")).distinct()
    return key_differences(bed, flanks)
