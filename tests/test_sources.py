"""Files in and out."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.operators import tables, viewer
from strandloom.sources import alignments, bam, flanks, panel
from strandloom.sources import tables as text

SF = "/root/testdata/sf0.001"


REFS = [("chr1", 1_000_000), ("chr2", 500)]


def bam_head(text=b"@HD\n"):
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(REFS))
    for name, size in REFS:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    return out


def bam_record(ref, pos, name, flag, mapq, ops, seq, qual, tags):
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
    digits = [code[c] for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(digits[i] << 4 | digits[i + 1] for i in range(0, len(digits), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 120)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + packed + bytes(qual or [255] * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def block(data):
    """One block of a blocked gzip file."""
    squeezer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeezer.compress(data) + squeezer.flush()
    size = 18 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocked(data, size):
    """Blocks of at most size bytes, and the place of each byte as a virtual offset."""
    out, places = b"", []
    for i in range(0, len(data), size):
        places += [len(out) << 16 | k for k in range(len(data[i : i + size]))]
        out += block(data[i : i + size])
    return out + block(b""), places


def test_bam(spark, tmp_path):
    data = bam_head(b"@HD\n@RG\tID:1\tSM:some one\n")
    data += bam_record(0, 99, "q1", 99, 60, [(2, "S"), (3, "M")], "ACGTN", [30, 31, 32, 33, 34], b"MIZa/A\0NMC\x01XBBs" + struct.pack("<i2h", 2, 5, 6) + b"MDZ3\0")
    data += bam_record(1, 5, "q2", 0, 3, [(4, "M")], "GGGG", None, b"SAZx\0")
    data += bam_record(-1, -1, "q3", 4, 0, [], "", None, b"")
    (tmp_path / "a.bam").write_bytes(blocked(data, len(data) // 2)[0])
    rows = alignments.read_bam(spark, str(tmp_path / "a.bam")).orderBy("ord").drop("ord").collect()
    assert tuple(rows[0]) == ("chr1", "q1", 99, 99, 60, "2S3M", 120, "ACGTN", [30, 31, 32, 33, 34], "3", "a/A", None)
    assert rows[1]["sa"] == "x" and rows[1]["qual"] is None and rows[1]["seq"] == "GGGG"
    assert rows[2]["chrom"] is None and rows[2]["cigar"] is None and rows[2]["seq"] == ""
    assert alignments.read_groups(spark, str(tmp_path / "a.bam")) == ["some one"]
    (tmp_path / "b.bam").write_bytes(block(b"nothing at all"))
    with pytest.raises(Exception, match="no BAM"):
        alignments.read_bam(spark, str(tmp_path / "b.bam")).collect()


def many_records(n=3_000):
    rng = random.Random(5)
    found, data = [], bam_head()
    pos = 0
    for i in range(n):
        pos += rng.randrange(300)
        size = rng.choice([1, 30, 90, 151])
        found.append((len(data), pos, pos + size, f"read:{i}"))
        seq = "".join(rng.choice("ACGT") for _ in range(size))
        data += bam_record(0, pos, f"read:{i}", 0, 60, [(size, "M")], seq, [rng.randrange(40) for _ in range(size)], b"MIZ%d/A\0" % i)
    return data, found


@pytest.mark.parametrize("size", [150, 700, 20_000])
def test_bam_splits_hold_each_record_once(tmp_path, size):
    """Records that cross blocks, and blocks without a first record."""
    data, found = many_records()
    content, places = blocked(data, size)
    path = tmp_path / "a.bam"
    path.write_bytes(content)
    for step in (len(content) // 3, 9_001):
        got = [r for at in range(0, len(content), step) for r in bam.records(str(path), at, min(at + step, len(content)))]
        assert [(r[1], r[4], r[2]) for r in got] == [(places[at], pos, name) for at, pos, _, name in found]


def index_of(found, places, size):
    """A BAM index with every record's bin, and the first record over each window of 16 kb."""
    bins, linear = {}, {}
    for (at, lo, hi, _), following in zip(found, [f[0] for f in found[1:]] + [size - 1], strict=True):
        number = next(b + (lo >> s) for s, b in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)) if lo >> s == (hi - 1) >> s)
        bins.setdefault(number, []).append((places[at], places[following]))
        for w in range(lo >> 14, (hi - 1 >> 14) + 1):
            linear[w] = min(linear.get(w, 1 << 60), places[at])
    out = b"BAI\x01" + struct.pack("<i", 2) + struct.pack("<i", len(bins))
    for number, chunks in bins.items():
        out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", a, b) for a, b in chunks)
    windows = [linear.get(w, 0) for w in range(max(linear) + 1)]
    return out + struct.pack(f"<i{len(windows)}Q", len(windows), *windows) + struct.pack("<ii", 0, 0)


def test_bam_index(spark, tmp_path):
    data, found = many_records()
    content, places = blocked(data, 3_000)
    (tmp_path / "a.bam").write_bytes(content)
    (tmp_path / "a.bam.bai").write_bytes(index_of(found, places, len(data)))
    regions = [("chr1", 100_000, 100_400), ("chr1", 300_000, 300_001), ("chr1", -50, 10), ("chr2", 0, 100), ("chrX", 5, 6)]
    got = {r["qname"] for r in alignments.read_bam(spark, str(tmp_path / "a.bam"), regions, split_bytes=20_000).collect()}
    want = {name for _, lo, hi, name in found if any(c == "chr1" and lo < b and hi > a for c, a, b in regions)}
    assert want and want <= got and len(got) < len(found) / 5


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nq1\t99\tchr1\t100\t60\t2S3M\t=\t1\t120\tACGTN\t?@ABC\tMI:Z:a/A\tMD:Z:3\nq2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    rows = alignments.read_sam(spark, str(tmp_path / "a.sam")).orderBy("ord").collect()
    r = rows[0].asDict()
    assert (r["chrom"], r["pos0"], r["cigar"], r["seq"], r["qual"], r["md"], r["mi"], r["sa"]) == ("chr1", 99, "2S3M", "ACGTN", [30, 31, 32, 33, 34], "3", "a/A", None)
    assert rows[1]["chrom"] is None and rows[1]["seq"] == "" and rows[1]["qual"] is None and rows[1]["mi"] is None


def test_read_groups():
    assert alignments.read_group_sample(None, ["s", "s"]) == "s" and alignments.read_group_sample("s", []) == "s"
    for sample, found in ((None, ["a", "b"]), ("x", ["a"]), (None, [])):
        with pytest.raises(ValueError):
            alignments.read_group_sample(sample, found)


def test_bed_and_flanks(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# c\n\nchr1\t10\t20\tL1\nchr2\t5\t9\tL2\textra\n")
    bed = flanks.read_bed(spark, str(tmp_path / "a.bed"))
    assert [tuple(r) for r in bed.orderBy("locus_id").collect()] == [("L1", "chr1", 10, 20), ("L2", "chr2", 5, 9)]
    header = "\t".join(c.split()[0] for c in flanks.SIDE_SCHEMA.split(", "))
    good = ["s\tL1\tupstream\trecovered\t+\tACGTACGTAC\t1,2\t3.0\t1\t1\t1\t1\t1", "s\tL1\tdownstream\tno_reference_position\t+\tACGTACGTAC\t\t3.0\t1\t1\t1\t0\t0"]
    bad = [
        [good[0]], [good[0], good[1].replace("s\t", "t\t", 1)], [good[0], good[1].replace("no_reference_position", "odd")],
        [good[0].replace("1,2", ""), good[1]], [good[0].replace("recovered", "no_flank_pair"), good[1].replace("no_reference_position", "no_flank_pair")],
    ]
    for i, lines in enumerate([good, *bad]):
        (tmp_path / f"{i}.tsv").write_text("\n".join([header, *lines]) + "\n")
        if i:
            with pytest.raises(ValueError):
                flanks.read_flank_sides(spark, str(tmp_path / f"{i}.tsv"))
        else:
            assert flanks.read_flank_sides(spark, str(tmp_path / "0.tsv")).count() == 2
    (tmp_path / "x.tsv").write_text("locus\tside\nL1\tup\n")
    with pytest.raises(ValueError):
        flanks.read_flank_sides(spark, str(tmp_path / "x.tsv"))


def test_panel_round_trip(spark, tmp_path):
    p = panel.derived_panel(spark, SF)
    p.save(str(tmp_path / "p"))
    back = panel.Panel.load(spark, str(tmp_path / "p"))
    assert viewer.differing_rows(p.rows, back.rows.select(*p.rows.columns)).count() == 0
    assert panel.locus_column(spark, str(tmp_path / "p"), "up_width").count() == 8
    with pytest.raises(ValueError):
        panel.locus_column(spark, str(tmp_path / "p"), "nothing")
    # another panel in its place, and a write that breaks
    other = panel.Panel(p.rows.limit(5), p.loci.where("locus_id = 'Locus1'"))
    other.save(str(tmp_path / "p"), info=panel.panel_info(panel.run_meta(p.rows)))
    broken = panel.Panel(p.rows.select(F.raise_error(F.lit("broken")).alias("x")), p.loci)
    with pytest.raises(Exception, match="broken"):
        broken.save(str(tmp_path / "p"))
    back = panel.Panel.load(spark, str(tmp_path / "p"))
    assert back.rows.count() == 5 and back.loci.count() == 1
    spark.range(1).select(F.lit("2").alias("schema_version")).write.mode("overwrite").parquet(str(tmp_path / "p/version"))
    with pytest.raises(ValueError):
        panel.Panel.load(spark, str(tmp_path / "p"))


def test_tables_round_trip(spark, tmp_path):
    reference, target = panel.derived_pair(spark, SF)
    phased = tables.phase(reference)
    text.write_snv_calls(tables.snv_calls(phased), str(tmp_path / "snv"))
    back = text.read_snv_calls(spark, str(tmp_path / "snv"))
    assert viewer.differing_rows(tables.snv_calls(phased), back).count() == 0
    a = tables.phase_by_reference(target, phased.snvs).rows
    b = tables.phase_by_reference(target, back.withColumn("offset", F.lit(0))).rows
    assert viewer.differing_rows(a, b).count() == 0
    summary = tables.locus_summary(reference, phased).where("n_snvs_phased > 0").select("locus_id", "hap_major_profile", "hap_minor_profile", "max_discordance", "n_anchor_families")
    assert viewer.differing_rows(summary, text.haplotypes_from_calls(back)).count() == 0
    text.write_snv_calls(tables.snv_calls(tables.phase_by_reference(target, phased.snvs)), str(tmp_path / "ref"))
    assert text.haplotypes_from_calls(text.read_snv_calls(spark, str(tmp_path / "ref"))).count() > 0


def test_saved_phasing(spark, tmp_path):
    reference, target = panel.derived_pair(spark, SF)
    phased = tables.phase(reference)
    phased.save(str(tmp_path / "phased"))
    back = tables.Phased.load(spark, str(tmp_path / "phased"))
    a, b = (tables.phase_by_reference(target, x.snvs).rows for x in (phased, back))
    assert viewer.differing_rows(a, b).count() == 0 and viewer.differing_rows(phased.rows, back.rows).count() == 0
    with pytest.raises(ValueError):
        tables.Phased.load(spark, str(tmp_path / "nothing"))


def test_pileup_columns(spark):
    loci = spark.createDataFrame([("L", 4, 3)], "locus_id string, up_width long, dn_width long")
    none = spark.createDataFrame([], "locus_id string, offset int")
    shown = lambda near: sorted(r["offset"] for r in viewer.shown_offsets(panel.Panel(none, loci), none, near).collect())
    assert shown(0) == [] and shown(1) == [3, 5] and shown(99) == [0, 1, 2, 3, 5, 6, 7] and shown(-2) == []


def test_flanks_of_normals(spark):
    samples = spark.createDataFrame([("t1", "n1"), ("t2", "n1"), ("n2", "n2"), ("t3", "none")], "sample_id string, normal string")
    sides = spark.createDataFrame([("n1", "L"), ("n2", "L"), ("n2", "M")], "sample string, locus string")
    got = sorted((r["sample_id"], r["locus"]) for r in flanks.flanks_of_normals(samples, sides).collect())
    assert got == [("n2", "L"), ("n2", "M"), ("t1", "L"), ("t2", "L")]


def test_flank_records(spark):
    df = spark.createDataFrame([("ACG", [5, 7], 2), ("ACG", None, 0), (None, None, 0)], "b string, p array<long>, o int")
    out = df.select(flanks.flank_json(F.col("b"), F.col("p"), F.col("o")).alias("j")).withColumn("r", flanks.flank_from_json(F.col("j"))).collect()
    assert out[0]["j"] == '{"bases":"ACG","ref_positions":[5,7],"run_side_offset":2}' and tuple(out[1]["r"]) == ("ACG", [], 0) and out[2]["j"] is None


def test_labels_and_provenance(spark, tmp_path):
    header = "locus_id\tmi\tstrand\tcount\tinterrupter_pattern\tphase_label\tn_major\tn_minor\tn_other\n"
    (tmp_path / "a.tsv").write_text(header + "L\tm\tA\t1\t-\tunk\t0\t0\t0\n")
    (tmp_path / "b.tsv").write_text(header + "L\tm\tA\t1\t-\todd\t0\t0\t0\n")
    assert text.read_labels(spark, str(tmp_path / "a.tsv")).count() == 1
    with pytest.raises(ValueError):
        text.read_labels(spark, str(tmp_path / "b.tsv"))
    r = text.provenance(spark, str(tmp_path / "a.tsv"), {"sample": "s"}).first()
    assert r["schema_version"] == "3" and len(r["flank_table_sha256"]) == 64 and r["policy"] == "merge_by_quality"
