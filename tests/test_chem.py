import pytest
from pyspark.sql import functions as F

from ionweave.functions import chem


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_masses_and_series(spark):
    assert one(spark, "AMK", lambda c: chem.series_mz(c, "b", 2)) == pytest.approx([36.526, 102.046], abs=1e-3)
    assert chem.fragment_mz("AMK", "b", 2) == pytest.approx([36.526, 102.046], abs=1e-3)
    mass = one(spark, 1000.0, lambda c: chem.mz_to_mass(c, F.lit(2)), "double")
    assert mass == pytest.approx(1997.98544706, abs=1e-6)
    assert one(spark, 1000.0, lambda c: chem.mz_to_mass(c, F.lit(2), 1), "double") == pytest.approx(1996.98209206, abs=1e-6)
    assert one(spark, mass, lambda c: chem.mass_to_mz(c, F.lit(2)), "double") == pytest.approx(1000.0)
    whole = one(spark, "AMK", chem.peptide_mass)
    assert whole == pytest.approx(chem.WATER + sum(chem.RESIDUE_MASS[c] for c in "AMK"))
    assert one(spark, "AM[15.994915]K", chem.peptide_mass) == pytest.approx(whole + 15.994915)
    assert one(spark, "AM(UniMod:35)K", chem.peptide_mass) == pytest.approx(whole + 15.994915)
    y = chem.fragment_mz("AMK", "y", 1)
    b = chem.fragment_mz("AMK", "b", 1)
    assert b[0] + y[1] == pytest.approx(whole + 2 * chem.PROTON)


def test_sequences(spark):
    assert one(spark, "CHAUNCY[666]FLOPS", chem.strip_modifications) == "CHAUNCYFLOPS"
    assert chem.modifications("B[66.6]ELL[+6666.6]ATRIX[-666.6]") == {0: 66.6, 3: 6666.6, 8: -666.6}
    assert chem.modifications("(UniMod:1)AM(Oxidation)K(nothing)") == {-1: 42.010565, 1: 15.994915}
    assert one(spark, "ACDEFGK", chem.decoy_sequence) == "ASDEFLK"
    assert one(spark, "AC[57.0]DEFG(UniMod:1)K", chem.decoy_sequence) == "AS[57.0]DEFL(UniMod:1)K"
    assert one(spark, "AC[57.0]DE", lambda c: chem.replace_residue(c, 2, "W")) == "AC[57.0]WE"
    target, decoy = one(spark, "ACDEFGK", chem.peptide_mass), one(spark, "ASDEFLK", chem.peptide_mass)
    assert one(spark, "ACDEFGK", chem.decoy_mass_shift) == pytest.approx(decoy - target)
    assert [one(spark, s, chem.is_valid_sequence) for s in ("ACDK", "ABCD", "", "A[1]C")] == [True, False, False, True]
    assert one(spark, "BANANA", lambda c: chem.positions_of(c, "A")) == [1, 3, 5]
    assert one(spark, "PEPT|3", chem.split_key) == ("PEPT", 3)
    assert one(spark, ">a;>b", chem.tag_decoy_proteins) == ">decoy_a;>decoy_b"
    assert one(spark, "ACAC", chem.residue_counts)["C"] == 2
    assert one(spark, 10.0, lambda c: chem.decoy_irt(c, F.lit("AGAAAKR")), "double") == pytest.approx(10 + 0.5 + 0.5)


def test_labels_and_formulas(spark):
    assert one(spark, "y7-H2O", chem.parse_label) == ("y", 7, 1)
    assert one(spark, "b3^2", chem.parse_label) == ("b", 3, 2)
    assert one(spark, "p", chem.parse_label) == ("p", 0, 1)
    assert chem.formula("C2H5OH") == {"C": 2, "H": 6, "O": 1}
    assert chem.formula("C3H-2") == {"C": 3, "H": -2}
    with pytest.raises(ValueError):
        chem.formula("XyZ")
    counts = one(spark, "C2H5OH", chem.formula_counts)
    assert (counts["C"], counts["H"], counts["O"], counts["S"]) == (2, 6, 1, 0)


def test_isotopes():
    shares = chem.isotope_distribution(chem.sequence_formula("PEPTIDEK"))
    assert shares[0] == 1.0 and 0.3 < shares[1] < 0.6 and shares == sorted(shares, reverse=True)
    heavy = chem.averagine(5000.0)
    assert max(heavy) == 1.0 and heavy[0] < 1.0
    assert len(chem.averagine_table()) == 970
