"""Named queries over derived reads and alignments, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import tract as fn
from strandloom.operators import extraction, flank_search, placement

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

UP, DN = "ACGTACGTAC", "TGCATGCATG"


def query(oracle: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = oracle
        return function

    return register


# ---- derived reads: a prefix, a changed upstream flank, a tract, a changed downstream flank, a suffix

_PARTS = """
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'CCGT' END AS p1,
  CASE k % 11 WHEN 0 THEN 'ACGTTCGTAC' WHEN 1 THEN 'ACGTTACGTAC' WHEN 2 THEN 'ACGACGTAC' WHEN 3 THEN 'ACGTAATCGTAC' WHEN 4 THEN 'ACGCGTAC' WHEN 5 THEN 'AAAAAAAAAA' WHEN 6 THEN 'ACGNACGTAC' ELSE 'ACGTACGTAC' END AS p2,
  CASE c % 5 WHEN 0 THEN 'GGGGGG' WHEN 1 THEN 'GGGAGGGG' WHEN 2 THEN 'GGGGTTGGG' WHEN 3 THEN 'GGCGG' ELSE 'GAAAAAG' END AS p3,
  CASE c % 7 WHEN 0 THEN 'TGCATGCTTG' WHEN 1 THEN 'TGCAATGCATG' WHEN 2 THEN 'TGCTGCATG' WHEN 3 THEN 'TTTTTTTTTT' ELSE 'TGCATGCATG' END AS p4,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'GT' WHEN 2 THEN 'GTGCATGCATGC' ELSE 'A' END AS p5"""
_READS = f"""reads AS (SELECT k, c, 'L' || (k % 4) AS locus_id, p1 || p2 || p3 || p4 || p5 AS seq, 10 + k % 9 AS lo, 11 + k % 9 + c % 8 AS hi
  FROM (SELECT o_orderkey AS k, o_custkey AS c, {_PARTS} FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)))"""

# SQL of the best match (cost, size) of flank f that ends at 0-based position e of string s
_WIN = "substr({s}, CAST({e} + 2 - {n} AS INTEGER), {n})"


def _match_sql(s: str, e: str, f: str) -> tuple[str, str]:
    w = lambda n: _WIN.format(s=s, e=e, n=n)
    mism = f"len(list_filter(range(1, 11), lambda i: substr({w(10)}, i, 1) <> substr({f}, i, 1) OR substr({w(10)}, i, 1) = 'N'))"
    ins = lambda g: f"({e} >= {9 + g} AND len(list_filter(range(1, 10), lambda i: left({w(10 + g)}, i) || substr({w(10 + g)}, i + {g + 1}) = {f})) > 0)"
    lost = lambda g: f"({e} >= {9 - g} AND len(list_filter(range(1, {10 - g}), lambda i: left({f}, i) || substr({f}, i + {g + 1}) = {w(10 - g)})) > 0)"
    case = f"CASE WHEN {e} >= 9 AND {mism} <= 1 THEN {{a}} WHEN {ins(1)} THEN {{b}} WHEN {lost(1)} THEN {{c}} WHEN {ins(2)} THEN {{d}} WHEN {lost(2)} THEN {{g}} END"
    return case.format(a=f"2 * {mism}", b=4, c=4, d=5, g=5), case.format(a=10, b=11, c=9, d=12, g=8)


def _edges_sql(source: str) -> str:
    return f"""SELECT r.*, i AS e FROM {source} r, unnest(range(0, length(r.s) - 1)) t(i) WHERE substr(r.s, CAST(i AS INTEGER) + 1, 1) <> 'G' AND substr(r.s, CAST(i AS INTEGER) + 2, 1) = 'G'"""


_COST, _SIZE = _match_sql("s", "e", "f")
_SIDES = f"""
  du AS (SELECT DISTINCT seq, seq AS s, '{UP}' AS f FROM reads), dd AS (SELECT DISTINCT seq, reverse(seq) AS s, reverse('{DN}') AS f FROM reads),
  eu AS ({_edges_sql("du")}), ed AS ({_edges_sql("dd")}),
  mu AS (SELECT seq, e AS a, cost AS uc, size AS us FROM (SELECT *, {_COST} AS cost, {_SIZE} AS size FROM eu) WHERE cost IS NOT NULL),
  md AS (SELECT seq, length(seq) - 1 - e AS b, cost AS dc, size AS ds FROM (SELECT *, {_COST} AS cost, {_SIZE} AS size FROM ed) WHERE cost IS NOT NULL)"""
_SCORE = "(6 * (length(inner_) - length(replace(inner_, 'G', ''))) - 4 * length(inner_))"
_BEST = f"""
  dist AS (SELECT DISTINCT seq, lo, hi FROM reads),
  cand AS (SELECT d.*, a, b, us, ds, substr(d.seq, CAST(a AS INTEGER) + 2, CAST(b - a AS INTEGER) - 1) AS inner_, uc + dc AS cost, greatest(lo, a + 1) < least(hi, b) AS marked
    FROM dist d JOIN mu ON d.seq = mu.seq JOIN md ON d.seq = md.seq AND a < b),
  best AS (SELECT *, {_SCORE} - cost AS value FROM cand WHERE marked QUALIFY row_number() OVER (PARTITION BY seq, lo, hi ORDER BY {_SCORE} - cost DESC, a DESC, b) = 1),
  placed AS (SELECT r.k, r.locus_id, EXISTS (SELECT 1 FROM mu WHERE mu.seq = r.seq) AS upstream_matched, EXISTS (SELECT 1 FROM md WHERE md.seq = r.seq) AS downstream_matched,
    b.value IS NOT NULL AS placed, coalesce(b.value >= 0, false) AS kept, EXISTS (SELECT 1 FROM cand c WHERE c.seq = r.seq AND c.lo = r.lo AND c.hi = r.hi) AS ordered, coalesce(b.value, 0) AS value,
    coalesce(a, -1) AS a, coalesce(b, -1) AS b, CASE WHEN b.value >= 0 THEN inner_ END AS tract, a - us + 1 AS up_outer, b + ds - 1 AS dn_outer
    FROM reads r LEFT JOIN best b ON r.seq = b.seq AND r.lo = b.lo AND r.hi = b.hi)"""


def derived_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).distinct()
    parts = orders.selectExpr("k", "c", *[p.strip().rstrip(",") for p in _PARTS.strip().split("\n")])
    marks = F.array(F.struct((F.lit(10) + F.col("k") % 9).cast("int").alias("lo"), (F.lit(11) + F.col("k") % 9 + F.col("c") % 8).cast("int").alias("hi")))
    return parts.select(
        "k", F.concat(F.lit("L"), F.col("k") % 4).alias("locus_id"), F.concat("p1", "p2", "p3", "p4", "p5").alias("seq"), marks.alias("marks"),
        F.lit(UP).alias("up_flank"), F.lit(DN).alias("dn_flank"),
    )


@query(f"WITH {_READS}, d AS (SELECT DISTINCT seq, seq AS s FROM reads), g AS (SELECT DISTINCT seq, reverse(seq) AS s FROM reads) SELECT seq, CAST(e AS INTEGER) AS pos, 'up' AS side FROM ({_edges_sql('d')}) UNION ALL SELECT seq, CAST(length(seq) - 1 - e AS INTEGER), 'dn' FROM ({_edges_sql('g')})")
def tract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = derived_reads(spark, sf_dir).select("seq").distinct()
    up = reads.select("seq", F.explode(placement.upstream_edges(F.col("seq"))).alias("pos"), F.lit("up").alias("side"))
    back = reads.select("seq", F.explode(placement.upstream_edges(F.reverse("seq"))).alias("pos"))
    return up.unionByName(back.select("seq", (F.length("seq") - 1 - F.col("pos")).alias("pos"), F.lit("dn").alias("side")))


@query(f"WITH {_READS}, {_SIDES} SELECT seq, 'up' AS side, CAST(a AS INTEGER) AS pos, CAST(uc AS INTEGER) AS cost, CAST(us AS INTEGER) AS size FROM mu UNION ALL SELECT seq, 'dn', CAST(b AS INTEGER), CAST(dc AS INTEGER), CAST(ds AS INTEGER) FROM md")
def flank_match_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = derived_reads(spark, sf_dir).select("seq", "up_flank", "dn_flank").distinct().withColumn("read", F.col("seq"))
    sides = [placement.side_matches(reads, d).select(F.col("read").alias("seq"), F.lit(s).alias("side"), "pos", "cost", "size") for d, s in ((False, "up"), (True, "dn"))]
    return sides[0].unionByName(sides[1])


@query(f"""WITH {_READS}, {_SIDES}, {_BEST} SELECT k, upstream_matched, downstream_matched, placed, kept, upstream_matched AND downstream_matched AND NOT ordered AS no_placement,
  upstream_matched AND downstream_matched AND ordered AND NOT placed AS no_bed_base, placed AND NOT kept AS negative_value, CAST(value AS INTEGER) AS value, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, tract,
  CAST(up_outer AS INTEGER) AS up_outer, CAST(dn_outer AS INTEGER) AS dn_outer FROM placed""")
def best_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.place(derived_reads(spark, sf_dir)).drop("seq", "marks", "up_flank", "dn_flank", "locus_id")


@query(f"""WITH {_READS}, {_SIDES}, {_BEST} SELECT locus_id, count(*) FILTER (placed) AS n_placed, count(*) FILTER (NOT kept) AS n_drop_flank, count(*) FILTER (NOT upstream_matched) AS n_drop_upstream,
  count(*) FILTER (NOT downstream_matched) AS n_drop_downstream, count(*) FILTER (upstream_matched AND downstream_matched AND NOT ordered) AS n_drop_no_placement,
  count(*) FILTER (upstream_matched AND downstream_matched AND ordered AND NOT placed) AS n_drop_no_bed_base, count(*) FILTER (placed AND NOT kept) AS n_drop_negative_value FROM placed GROUP BY locus_id""")
def flank_drop_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.drop_counters(placement.place(derived_reads(spark, sf_dir)), "locus_id")


# ---- flank search: reads of four loci with every base marked ---------------------------------------

_FACING = "list_filter(range(0, length(s)), lambda j: j > 0 AND substr(s, CAST(j AS INTEGER) + 1, 1) <> 'G' AND substr(s, CAST(j AS INTEGER), 1) = 'G' AND j > e + 1 AND j <= length(s) - 8)"
_WINDOW10 = _WIN.format(s="s", e="e", n=10)
_CANDS = f"""
  lu AS (SELECT DISTINCT locus_id, seq, seq AS s FROM reads), ld AS (SELECT DISTINCT locus_id, seq, reverse(seq) AS s FROM reads), xu AS ({_edges_sql("lu")}), xd AS ({_edges_sql("ld")}),
  cu AS (SELECT DISTINCT locus_id, {_WINDOW10} AS f FROM xu WHERE e >= 9 AND len({_FACING}) > 0 AND regexp_matches({_WINDOW10}, '^[ACGT]{{10}}$') AND NOT regexp_matches({_WINDOW10}, 'GGG.$')),
  cd AS (SELECT DISTINCT locus_id, {_WINDOW10} AS f FROM xd WHERE e >= 9 AND len({_FACING}) > 0 AND regexp_matches({_WINDOW10}, '^[ACGT]{{10}}$') AND NOT regexp_matches({_WINDOW10}, 'GGG.$'))"""


def _search_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = derived_reads(spark, sf_dir).select("locus_id", "seq")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.length("seq").alias("hi")))
    return reads.groupBy("locus_id", "seq").agg(F.count("*").alias("weight")).withColumn("marks", whole)


@query(f"WITH {_READS}, {_CANDS} SELECT locus_id, 'up' AS side, f AS flank FROM cu UNION ALL SELECT locus_id, 'dn', reverse(f) FROM cd")
def flank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _search_reads(spark, sf_dir)
    sides = [flank_search.candidates(reads, d).select("locus_id", F.lit(s).alias("side"), "flank") for d, s in ((False, "up"), (True, "dn"))]
    return sides[0].unionByName(sides[1])


@query(f"""WITH {_READS}, {_CANDS},
  wu AS (SELECT DISTINCT x.locus_id, CASE WHEN e >= 11 THEN substr(s, CAST(e AS INTEGER) - 10, 12) ELSE left(s, CAST(e AS INTEGER) + 1) END AS w FROM xu x),
  wd AS (SELECT DISTINCT x.locus_id, CASE WHEN e >= 11 THEN substr(s, CAST(e AS INTEGER) - 10, 12) ELSE left(s, CAST(e AS INTEGER) + 1) END AS w FROM xd x),
  pu AS (SELECT locus_id, w, f, cost FROM (SELECT locus_id, s AS w, f, {_COST} AS cost FROM (SELECT c.locus_id, w AS s, f, length(w) - 1 AS e FROM wu JOIN cu c ON wu.locus_id = c.locus_id)) WHERE cost IS NOT NULL),
  pd AS (SELECT locus_id, w, f, cost FROM (SELECT locus_id, s AS w, f, {_COST} AS cost FROM (SELECT c.locus_id, w AS s, f, length(w) - 1 AS e FROM wd JOIN cd c ON wd.locus_id = c.locus_id)) WHERE cost IS NOT NULL),
  au AS (SELECT x.locus_id, x.seq, e AS a, f AS u, cost AS uc FROM xu x JOIN pu ON pu.locus_id = x.locus_id AND pu.w = CASE WHEN e >= 11 THEN substr(s, CAST(e AS INTEGER) - 10, 12) ELSE left(s, CAST(e AS INTEGER) + 1) END),
  ad AS (SELECT x.locus_id, x.seq, length(x.seq) - 1 - e AS b, reverse(f) AS v, cost AS dc FROM xd x JOIN pd ON pd.locus_id = x.locus_id AND pd.w = CASE WHEN e >= 11 THEN substr(s, CAST(e AS INTEGER) - 10, 12) ELSE left(s, CAST(e AS INTEGER) + 1) END),
  wgt AS (SELECT locus_id, seq, count(*) AS n FROM reads GROUP BY ALL),
  pv AS (SELECT locus_id, seq, u, v, max({_SCORE} - cost) AS val FROM (SELECT au.locus_id, au.seq, u, v, substr(au.seq, CAST(a AS INTEGER) + 2, CAST(b - a AS INTEGER) - 1) AS inner_, uc + dc AS cost
    FROM au JOIN ad ON au.locus_id = ad.locus_id AND au.seq = ad.seq AND a + 1 < b) GROUP BY ALL),
  obj AS (SELECT pv.locus_id, u, v, sum(n * val) AS objective FROM pv JOIN wgt ON pv.locus_id = wgt.locus_id AND pv.seq = wgt.seq WHERE val > 0 GROUP BY ALL),
  top AS (SELECT * FROM obj QUALIFY objective = max(objective) OVER (PARTITION BY locus_id))
  SELECT locus_id, min(ROW(u, v)).u AS up_flank, min(ROW(u, v)).v AS dn_flank, CAST(objective AS BIGINT) AS objective, count(*) AS n_tied_pairs FROM (SELECT locus_id, u, v, objective FROM top) GROUP BY locus_id, objective""".replace("min(ROW(u, v)).u", "min({'u': u, 'v': v}).u").replace("min(ROW(u, v)).v", "min({'u': u, 'v': v}).v"))
def flank_pair_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flank_search.best_pairs(_search_reads(spark, sf_dir))


@query("""WITH c AS (SELECT 'L' || (l_orderkey % 6) AS locus_id, CASE WHEN l_linenumber % 2 = 0 THEN 'up' ELSE 'dn' END AS side, 100 + l_partkey % 4 AS outer_pos, 110 + l_suppkey % 3 AS run_pos,
    CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS toward FROM lineitem),
  g AS (SELECT locus_id, side, outer_pos, run_pos, toward, count(*) AS n FROM c GROUP BY ALL)
  SELECT locus_id, side, outer_pos, run_pos, n, CAST(sum(n) OVER (PARTITION BY locus_id, side) AS BIGINT) AS n_positioned FROM g
  QUALIFY row_number() OVER (PARTITION BY locus_id, side ORDER BY n DESC, toward * run_pos DESC, toward * outer_pos DESC) = 1""")
def modal_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    even = F.col("l_linenumber") % 2 == 0
    pairs = items.select(
        F.concat(F.lit("L"), F.col("l_orderkey") % 6).alias("locus_id"), F.when(even, "up").otherwise("dn").alias("side"), (F.col("l_partkey") % 4 + 100).alias("outer_pos"),
        (F.col("l_suppkey") % 3 + 110).alias("run_pos"), F.when(even, 1).otherwise(-1).alias("toward_run"),
    )
    return flank_search.modal_positions(pairs)


# ---- alignments ---------------------------------------------------------------------------------------

_LOCI = "loci AS (SELECT 'P' || k AS locus_id, 'chr' || (1 + k % 3) AS chrom, 1000 + 3700 * k AS bed_start, 1014 + 3700 * k AS bed_end FROM range(40) t(k))"
_ALIGN = """al AS (SELECT 'chr' || (1 + l_suppkey % 3) AS chrom, CASE l_linenumber % 9 WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 1024 ELSE 99 END AS flag,
  (l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 150000 AS pos0, l_partkey % 61 AS mapq, (l_suppkey * 13 + l_orderkey) % 1300 - 150 AS tlen,
  CASE WHEN l_partkey % 29 = 0 THEN '' ELSE 'ACGT' END AS seq, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) || '/A' END AS mi, CASE WHEN l_partkey % 23 = 0 THEN 'chr9' END AS sa FROM lineitem)"""
_TESTED = """hit AS (SELECT l.locus_id, pos0 < bed_end AND pos0 + 151 > bed_start AS o, CASE WHEN mapq < 40 THEN 'mapq' WHEN sa IS NOT NULL THEN 'sa' WHEN abs(tlen) > 1000 THEN 'tlen' WHEN length(seq) = 0 THEN 'empty'
    WHEN pos0 < bed_end AND pos0 + 151 > bed_start AND mi IS NULL THEN 'no_mi' END AS reason
  FROM al JOIN loci l ON al.chrom = l.chrom AND pos0 < bed_end + 1000 AND pos0 + 151 > greatest(bed_start - 1000, 0) WHERE flag & 2308 = 0)"""


def _alignments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    reads = items.selectExpr(
        "concat('chr', 1 + l_suppkey % 3) AS chrom", "CASE l_linenumber % 9 WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 1024 ELSE 99 END AS flag",
        "(l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 150000 AS pos0", "l_partkey % 61 AS mapq", "(l_suppkey * 13 + l_orderkey) % 1300 - 150 AS tlen",
        "CASE WHEN l_partkey % 29 = 0 THEN '' ELSE 'ACGT' END AS seq", "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE concat(l_orderkey, '/A') END AS mi", "CASE WHEN l_partkey % 23 = 0 THEN 'chr9' END AS sa",
    ).withColumn("end0", F.col("pos0") + 151)
    loci = spark.range(40).selectExpr("concat('P', id) AS locus_id", "concat('chr', 1 + id % 3) AS chrom", "1000 + 3700 * id AS bed_start", "1014 + 3700 * id AS bed_end")
    return reads, loci


@query(f"WITH {_LOCI}, {_ALIGN}, {_TESTED} SELECT locus_id, count(*) AS n_near, count(*) FILTER (o) AS n_over FROM hit GROUP BY locus_id")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = extraction.filtered(extraction.near_loci(*_alignments(spark, sf_dir)))
    return tested.groupBy("locus_id").agg(F.count("*").alias("n_near"), F.count_if("overlaps").alias("n_over"))


_N = ", ".join(f"count(reason) FILTER (o AND reason = '{r}') AS n_drop_{r}" for r in ("mapq", "sa", "tlen", "no_mi"))


@query(f"WITH {_LOCI}, {_ALIGN}, {_TESTED} SELECT l.locus_id, count(o) FILTER (o AND reason IS DISTINCT FROM 'empty') AS n_overlap, {_N} FROM loci l LEFT JOIN hit ON l.locus_id = hit.locus_id GROUP BY l.locus_id")
def read_filter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, loci = _alignments(spark, sf_dir)
    return extraction.filter_counters(extraction.filtered(extraction.near_loci(reads, loci)), loci)


# ---- mates ---------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT DISTINCT CAST(l_linenumber % 4 AS INTEGER) AS s1, CAST(l_partkey % 3 AS INTEGER) AS s2, substr('ACGTACGTTG', CAST(1 + l_partkey % 4 AS INTEGER), 5) AS b1, substr('ACGTTCGAAG', CAST(1 + l_suppkey % 5 AS INTEGER), 4) AS b2 FROM lineitem),
  p AS (SELECT *, rpad(repeat('.', s1) || b1, 12, '.') AS x, rpad(repeat('.', s2) || b2, 12, '.') AS y FROM s),
  m AS (SELECT *, array_to_string(list_transform(range(1, 13), lambda i: CASE WHEN substr(x, i, 1) = substr(y, i, 1) OR substr(y, i, 1) = '.' THEN substr(x, i, 1) WHEN substr(x, i, 1) = '.' THEN substr(y, i, 1) ELSE '.' END), '') AS t FROM p)
  SELECT s1, b1, s2, b2, CAST(CASE WHEN trim(t, '.') = '' THEN 0 ELSE length(regexp_extract(t, '^\\.*')) END AS INTEGER) AS "start", trim(t, '.') AS bases FROM m""")
def side_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "cast(l_linenumber % 4 as int) AS s1", "cast(l_partkey % 3 as int) AS s2", "substring('ACGTACGTTG', cast(1 + l_partkey % 4 as int), 5) AS b1", "substring('ACGTTCGAAG', cast(1 + l_suppkey % 5 as int), 4) AS b2"
    ).distinct()
    side = lambda s, b: F.struct(F.col(s).alias("start"), F.col(b).alias("bases"))
    return items.withColumn("m", fn.side_consensus(side("s1", "b1"), side("s2", "b2"))).select("s1", "b1", "s2", "b2", "m.start", "m.bases")


@query("""WITH r AS (SELECT DISTINCT l_partkey % 13 AS x, l_suppkey % 11 AS y, l_linenumber AS z FROM lineitem),
  s AS (SELECT *, substr('GGGAGGGTTGGG', CAST(1 + x % 4 AS INTEGER), 8) AS a, substr('GGGAGGCTTGGG', CAST(1 + y % 4 AS INTEGER), 8) AS b FROM r),
  c AS (SELECT *, list_transform(range(1, 9), lambda i: CASE WHEN substr(a, i, 1) = substr(b, i, 1) OR 20 + (x + i) % 5 > 20 + (y + i * z) % 5 THEN substr(a, i, 1) WHEN 20 + (x + i) % 5 < 20 + (y + i * z) % 5 THEN substr(b, i, 1) WHEN i < 3 THEN 'N' END) AS m FROM s)
  SELECT x, y, z, a, b, CASE WHEN len(list_filter(m, lambda v: v IS NULL)) = 0 THEN array_to_string(m, '') END AS merged FROM c""")
def pair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey % 13 AS x", "l_suppkey % 11 AS y", "l_linenumber AS z").distinct()
    reads = items.selectExpr(
        "*", "substring('GGGAGGGTTGGG', cast(1 + x % 4 as int), 8) AS a", "substring('GGGAGGCTTGGG', cast(1 + y % 4 as int), 8) AS b",
        "transform(sequence(1, 8), i -> 20 + (x + i) % 5) AS qa", "transform(sequence(1, 8), i -> 20 + (y + i * z) % 5) AS qb", "transform(sequence(1, 8), i -> i >= 3) AS t",
    )
    merged = fn.merge_by_quality(F.col("a"), F.col("qa"), F.col("b"), F.col("qb"), F.col("t"))
    return reads.select("x", "y", "z", "a", "b", merged.alias("merged"))
