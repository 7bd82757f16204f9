"""The commands, one after another, on files."""

import pytest

from strandloom.__main__ import main
from strandloom.operators import tables
from strandloom.operators.viewer import differing_rows, panel_overview
from strandloom.sources import tables as text
from strandloom.sources.panel import Panel, derived_pair

UP, DN, TRACT = "ACGTACGTAC", "TGCATGCATG", "GGGGGGGAGGGGGG"


def sam(tmp_path):
    ref = "A" * 50 + UP + TRACT + DN + "A" * 66
    lines = [f"whole\t0\tchr1\t1\t60\t150M\t*\t0\t0\t{ref[:150]}\t{'I' * 150}\tMI:Z:w/A\tMD:Z:150"]
    read = ref[40:94]
    lines += [f"r{i}\t0\tchr1\t41\t60\t54M\t*\t0\t0\t{read}\t{'I' * 54}\tMI:Z:m{i % 4}/{'AB'[i % 2]}\tMD:Z:54" for i in range(8)]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "a.bed").write_text("chr1\t60\t74\tL\n")


def test_flanks_and_extraction(spark, tmp_path):
    sam(tmp_path)
    p = lambda name: str(tmp_path / name)
    main(["build-flanks", "--bam", p("a.sam"), "--bed", p("a.bed"), "--out", p("flanks"), "--sample", "s"], spark)
    main(["extract", "--bam", p("a.sam"), "--bed", p("a.bed"), "--flanks", p("flanks"), "--out", p("panel")], spark)
    panel = Panel.load(spark, p("panel"))
    rows = panel.rows.collect()
    locus = panel.loci.first()
    assert (locus["reference_window_status"], locus["reference_tract"], locus["n_runs"], locus["max_run"]) == ("recovered", TRACT, 2, 7)
    overview = panel_overview(panel, spark.createDataFrame([], "locus_id string, status string")).first()
    assert (overview["status"], overview["no_position"], overview["n_reads"], overview["largest_run"], overview["phased"]) == ("recovered", False, 9, 7, 0)
    assert locus["n_reads"] == 9 and '"run_side_offset":9' in locus["upstream_flank"]
    assert sum(r["cnt"] for r in rows) == 9 and {r["seq"] for r in rows} == {TRACT}
    (tmp_path / "b.bed").write_text("chr1\t60\t74\tX\n")
    with pytest.raises(ValueError):
        main(["extract", "--bam", p("a.sam"), "--bed", p("b.bed"), "--flanks", p("flanks"), "--out", p("panel2")], spark)


def test_phasing(spark, tmp_path, capsys):
    reference, target = derived_pair(spark, "/root/testdata/sf0.001")
    p = lambda name: str(tmp_path / name)
    reference.save(p("r"))
    target.save(p("t"))
    main(["phase", "--panel", p("r"), "--out", p("phased"), "--save", p("saved")], spark)
    found, panel = text.read_phasing_folder(spark, p("phased")), Panel.load(spark, p("r"))
    summary = tables.locus_summary(panel, tables.Phased.load(spark, p("saved")))
    assert differing_rows(summary, found["locus_summary"]).count() == 0 and found["snv_calls"].count() > 0
    main(["ref-phase", "--panel", p("t"), "--reference-snv-calls", p("phased/snv_calls"), "--out", p("against")], spark)
    assert "hap_major" in capsys.readouterr().out
    assert text.read_labels(spark, p("phased/haplotype_calls")).count() == reference.rows.count()
    assert text.read_labels(spark, p("against/haplotype_calls")).count() == target.rows.count()
    main(["ref-phase", "--panel", p("t"), "--reference-phasing", p("saved"), "--out", p("again"), "--target-sample-id", "tumour"], spark)
    a, b = (text.read_labels(spark, p(f"{x}/haplotype_calls")) for x in ("against", "again"))
    assert differing_rows(a, b).count() == 0 and '"target": "tumour"' in capsys.readouterr().out
