import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from ionweave import schema
from ionweave.functions import chem
from ionweave.operators.filters import CheckFailed
from ionweave.sources import library, mzml, tabular


def spectrum(index, level, time, unit, points, target=None, double=False, packed=True):
    def array(values, accession):
        raw = struct.pack(f"<{len(values)}{'d' if double else 'f'}", *values)
        raw = zlib.compress(raw) if packed else raw
        flags = f'<cvParam accession="MS:100052{3 if double else 1}" name="float"/>' + ('<cvParam accession="MS:1000574" name="zlib"/>' if packed else "")
        return f'<binaryDataArray encodedLength="1">{flags}<cvParam accession="{accession}" name="array"/><binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>'

    window = (
        f'<precursorList count="1"><precursor><isolationWindow><cvParam accession="MS:1000827" name="t" value="{target}"/><cvParam accession="MS:1000828" name="l" value="2"/>'
        f'<cvParam accession="MS:1000829" name="u" value="3"/></isolationWindow><activation><cvParam accession="MS:1000045" name="e" value="27"/></activation></precursor></precursorList>'
        if target
        else ""
    )
    return (
        f'<spectrum index="{index}" id="scan={index + 1}" defaultArrayLength="{len(points)}"><cvParam accession="MS:1000511" name="ms level" value="{level}"/>'
        f'<scanList count="1"><scan><cvParam accession="MS:1000016" name="scan start time" value="{time}" unitAccession="{unit}" unitName="x"/></scan></scanList>{window}'
        f'<binaryDataArrayList count="2">{array([m for m, _ in points], "MS:1000514")}{array([i for _, i in points], "MS:1000515")}</binaryDataArrayList></spectrum>'
    )


def test_mzml(spark, tmp_path):
    spectra = [
        spectrum(0, 1, 90, "UO:0000010", [(400.5, 10.0), (401.5, 0.0)], double=True),
        spectrum(1, 2, 2, "UO:0000031", [(200.25, 5.0), (300.5, 6.0)], target=450.25),
        spectrum(2, 2, 2.5, "UO:0000031", [(200.25, 7.0)], target=450.25, packed=False),
        spectrum(3, 2, 3, "UO:0000031", [], target=475.0, packed=False),
    ]
    (tmp_path / "run.mzML").write_text('<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run id="r"><spectrumList count="3">' + "\n".join(spectra) + "</spectrumList></run></mzML>")
    scans = mzml.open_run(spark, str(tmp_path / "run.mzML")).orderBy("scan_number").collect()
    assert [(s["scan_number"], s["ms_level"], s["scan_time"], s["target_key"]) for s in scans] == [(1, 1, 1.5, ""), (2, 2, 2.0, "450250"), (3, 2, 2.5, "450250"), (4, 2, 3.0, "475000")]
    assert scans[0]["mz"] == [400.5] and scans[1]["mz"] == [200.25, 300.5] and scans[1]["intensity"] == [5.0, 6.0] and scans[2]["intensity"] == [7.0] and scans[3]["mz"] == []
    assert (scans[1]["iso_lower"], scans[1]["iso_upper"], scans[1]["collision_energy"]) == (2.0, 3.0, 27.0)
    mzml.convert(spark, str(tmp_path / "run.mzML"), str(tmp_path / "run"))
    again = tabular.read_window(spark, str(tmp_path / "run"), "450250")
    assert again.count() == 2 and "PartitionFilters" in again._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(CheckFailed):
        mzml.open_run(spark, "/nowhere/run.d")


def test_scan_tables(spark, tmp_path):
    rows = [(n, 2, n / 10, None, 500.0, 1.0, 1.0, None, None, str(400 + n % 3), [100.0 + n], [1.0]) for n in range(9)]
    df = spark.createDataFrame(rows, tabular.schema.SCANS)
    path = str(tmp_path / "scans.parquet")
    tabular.write_table(df, path, single_file=True)
    assert tabular.read_scans(spark, path).count() == 9
    assert tabular.read_scans_between(spark, path, "scan_number", 2, 4).count() == 3
    assert sorted(r["scan_number"] for r in tabular.read_unique(spark, path, "target_key", "scan_number").collect()) == [0, 1, 2]
    tabular.write_table(df.unionByName(df.limit(1)), str(tmp_path / "twice.parquet"))
    with pytest.raises(CheckFailed):
        tabular.read_scans(spark, str(tmp_path / "twice.parquet"))
    with pytest.raises(CheckFailed):
        tabular.read_calibration(spark, path)
    assert tabular.read_runs(spark, str(tmp_path)).select("run").distinct().count() >= 1
    assert len(tabular.list_files(spark, str(tmp_path), ".parquet")) == 2
    tabular.write_frame(df, str(tmp_path / "frame"))
    assert spark.read.parquet(str(tmp_path / "frame")).agg(F.max("frame_index")).first()[0] == 2


def test_text_tables(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "ragged.csv").write_text("a,b\n1,x\n2,y,z\n")
    assert tabular.read_csv(spark, str(tmp_path / "good.csv"), "a int, b string").count() == 2
    with pytest.raises(Exception):
        tabular.read_csv(spark, str(tmp_path / "ragged.csv"), "a int, b string").collect()
    df = spark.createDataFrame([(1.5, 2.5)], "x double, y double")
    tabular.write_pairs(df, "x", "y", str(tmp_path / "pairs"))
    assert tabular.read_pairs(spark, str(tmp_path / "pairs")).collect()[0] == (1.5, 2.5)
    tabular.write_numbers(df, "x", str(tmp_path / "numbers"))
    assert tabular.read_numbers(spark, str(tmp_path / "numbers")).first()["value"] == 1.5
    tabular.write_csv(df, str(tmp_path / "out"))
    assert tabular.read_csv(spark, str(tmp_path / "out")).collect()[0] == (1.5, 2.5)
    (tmp_path / "p.fasta").write_text(">sp|A one\nmkv\nLLA\n>decoy_B\nPEP*\n>C\n\n")
    got = {r["description"]: r["sequence"] for r in tabular.read_fasta(spark, str(tmp_path / "p.fasta")).collect()}
    assert got == {">sp|A one": "MKVLLA", ">decoy_B": "PEP", ">C": ""}
    assert tabular.read_fasta(spark, str(tmp_path / "p.fasta"), "decoy_").count() == 2
    assert tabular.file_checksums(spark, str(tmp_path / "good.csv")).first()["md5"] == __import__("hashlib").md5(b"a,b\n1,x\n2,y\n").hexdigest()


def test_config(spark, tmp_path):
    (tmp_path / "c.toml").write_text("[General]\nthreadCount = 16\nwriteSomeDIA = false\n[LibraryParams]\ntrancheSizeMax = 1e4\n[MS2Params]\nms2ExtractionWidthPPM = 21\nstopThresholdFractionMS2 = 0.666\n[NeuralNetParams]\nbaggingSize = 1\n")
    c = tabular.read_config(spark, str(tmp_path / "c.toml"))
    assert (c.thread_count, c.write_report, c.tranche_size_max, c.ms2_extraction_width_ppm, c.stop_threshold_fraction_ms2, c.bagging_size) == (16, False, 10_000, 21.0, 0.666, 2)
    assert tabular.parse_config("threadCount = 0").thread_count >= 1
    with pytest.raises(CheckFailed):
        tabular.parse_config("peptideLengthMin = 40")
    with pytest.raises(CheckFailed):
        tabular.parse_config("percentFDR = 'x'")


TSV = "PrecursorMz\tProductMz\tTr_recalibrated\tIonMobility\tLibraryIntensity\tModifiedPeptide\tPrecursorCharge\tFragmentType\tFragmentCharge\tFragmentSeriesNumber\n"


def test_tsv_library(spark, tmp_path):
    path = tmp_path / "lib.tsv"
    path.write_text(TSV + "500.0\t100.0\t10.0\t1.0\t1000.0\t_ACDE_\t2\tb\t1\t1\n500.0\t200.0\t10.0\t1.0\t500.0\t_ACDE_\t2\ty\t1\t1\n500.0\t300.0\t10.0\t1.0\t5.0\t_ACDE_\t2\ty\t3\t2\n400.0\t100.0\t1.0\t1.0\t5.0\tAXXB\t2\ty\t1\t2\n")
    row = library.read_library(spark, str(path)).collect()
    assert len(row) == 1 and row[0]["peptide"] == "ACDE" and row[0]["is_decoy"] is False
    assert row[0]["mz"] == [100.0, 200.0] and row[0]["intensity"] == [1.0, 0.5] and row[0]["labels"] == ["b1", "y1"]
    assert row[0]["mass"] == pytest.approx(1000 - 2 * chem.PROTON)
    alias = tmp_path / "alias.tsv"
    alias.write_text("ModifiedPeptide\tPrecursorCharge\tRT\tPrecursorMz\tFragmentType\tFragmentMz\tRelativeIntensity\tFragmentCharge\tFragmentNumber\tdecoy\nACDE\t2\t10\t500\tb\t100\t1000\t1\t1\tTrue\n")
    assert library.read_library(spark, str(alias)).first()["is_decoy"] is True
    library.write_library(library.read_library(spark, str(path)), str(tmp_path / "lib.parquet"))
    assert library.read_library(spark, str(tmp_path / "lib.parquet")).first()["labels"] == ["b1", "y1"]
    with pytest.raises(CheckFailed):
        library.read_library(spark, "lib.csv")


def speclib(version=-3):
    text = lambda s: struct.pack("<i", len(s)) + s.encode()
    peptide = lambda mz, ions: struct.pack("<3i3f", 0, 2, 4, mz, 7.5, 0.0) + (struct.pack("<3f", 0.0, 1.25, 0.0) if version <= -2 else b"") + struct.pack("<i", len(ions)) + b"".join(struct.pack("<2f4B", *i) for i in ions)
    ions = [(100.0, 0.9, 1, 1, 2, 0), (200.0, 0.5, 1, 2, 1, 0), (300.0, 0.001, 1, 1, 3, 0), (400.0, 0.5, 3, 1, 3, 0)]
    entry = lambda mz, decoy: peptide(mz, ions) + struct.pack("<i", int(decoy)) + (peptide(mz, []) if decoy else b"") + struct.pack("<3i", 0, 1, 0) + text("n") + (struct.pack("<3f", 0, 1, 1) if version <= -3 else b"")
    protein = struct.pack("<2i", 1, 1) + text("id") + text("name") + text("gene") + struct.pack("<2i", 0, 0) + struct.pack("<i", 0)
    group = struct.pack("<i", 1) + text("ids") + text("names") + text("genes") + struct.pack("<i2i", 2, 0, 1) + struct.pack("<i", 0) + struct.pack("<ii", 1, 0) + struct.pack("<i", 0)
    head = (struct.pack("<2i", version, 1) if version < 0 else struct.pack("<i", 1)) + struct.pack("<2i", 1, 1) + text("lib") + text("fasta")
    body = struct.pack("<i", 1) + protein + struct.pack("<i", 1) + group + struct.pack("<i", 2) + text("ACDE2") + text("AZZE2") + struct.pack("<i", 0) + struct.pack("<i", 0) + struct.pack("<2d", 0.0, 1.0)
    return head + body + struct.pack("<i", 2) + entry(500.0, False) + entry(600.0, True)


@pytest.mark.parametrize("version", [-3, -2, -1, 0])
def test_speclib(spark, tmp_path, version):
    (tmp_path / "lib.speclib").write_bytes(speclib(version))
    row = library.read_library(spark, str(tmp_path / "lib.speclib")).collect()
    assert [r["peptide"] for r in row] == ["ACDE"]
    assert row[0]["labels"] == ["b2", "y3"] and row[0]["mz"] == [100.0, 200.0] and row[0]["irt"] == 7.5
    with pytest.raises(CheckFailed):
        list(library.parse_speclib(struct.pack("<i", -4)))


def test_decoy_fragments(spark):
    sequence = "ACDEFGHIK"
    labels = [f"{k}{n}" for k in ("b", "y") for n in range(1, 9)]
    ions = [chem.fragment_mz(sequence, k, 1)[n - 1] for k in ("b", "y") for n in range(1, 9)]
    row = [(sequence, 2, 1000.0, 1.0, 0.0, False, ions, [1.0] * 16, labels)]
    both = library.with_decoys(library.with_ions(spark.createDataFrame(row, library.schema.LIBRARY), 0.0, 5000.0)).collect()
    decoy = next(r for r in both if r["is_decoy"])
    assert decoy["peptide"] == "ASDEFGHVK"
    for ion in decoy["ions"]:
        want = chem.fragment_mz("ASDEFGHVK", ion["kind"], 1)[ion["number"] - 1]
        assert ion["mz"] == pytest.approx(want, abs=1e-6)
    early = next(r for r in library.with_decoys(library.with_ions(spark.createDataFrame(row, library.schema.LIBRARY), 0.0, 5000.0), terminal=True).collect() if r["is_decoy"])
    first = {i["label"]: i["mz"] for i in early["ions"]}
    assert first["b1"] == pytest.approx(ions[0] + chem.RESIDUE_MASS["S"] - chem.RESIDUE_MASS["C"], abs=1e-6)


def test_labels_are_inferred(spark):
    sequence = "ACDEFGHLK"
    labels = ["b3", "b5", "y4", "y7^2"]
    mz = [chem.fragment_mz(sequence, x[0], 2 if "^" in x else 1)[int(x[1]) - 1] + 0.01 for x in labels]
    assert library.label_peptide(sequence, mz, False)[0] == labels
    assert library.label_peptide(sequence, [*mz, 10.0], False)[0] is None
    # a decoy that carries its target's fragments: S comes from C, L from G among others
    assert library.label_peptide("ASDEFGHVK", mz, True)[0] == labels
    row = [(sequence, 2, 1000.0, 1.0, 0.0, False, mz, [1.0] * 4, []), (sequence, 2, 1000.0, 1.0, 0.0, False, mz, [1.0] * 4, ["p"] * 4)]
    got = library.infer_labels(spark.createDataFrame(row, library.schema.LIBRARY)).collect()
    assert got[0]["labels"] == labels and got[1]["labels"] == ["p"] * 4
    assert library.decoy_sources()["N"] == ["Q"]


def test_readers_are_registered_and_ranges_read(spark, tmp_path):
    from ionweave.sources import mzml

    scans = spark.createDataFrame([(i, 2, i * 0.1, 0.0, 500.0, 1.0, 1.0, None, None, "500000", [100.0], [1.0]) for i in range(20)], schema.SCANS)
    scans.write.parquet(str(tmp_path / "run.own"))
    with pytest.raises(ValueError):
        mzml.open_run(spark, str(tmp_path / "run.own"))
    mzml.register_reader("own", lambda s, path: s.read.parquet(path))
    assert mzml.open_run(spark, str(tmp_path / "run.own")).count() == 20
    part = mzml.open_run(spark, str(tmp_path / "run.own"), between=("scan_number", 3, 7))
    assert sorted(r["scan_number"] for r in part.collect()) == [3, 4, 5, 6, 7]


def test_settings_without_effect_are_told(spark):
    with pytest.warns(UserWarning, match="tranche_size_max"):
        assert tabular.parse_config("trancheSizeMax = 7\nuseAlternativeDecoys = true").use_alternative_decoys
