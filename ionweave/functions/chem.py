"""Chemistry of peptides: masses, fragment series, formulas, isotopes, decoys and labels.

Column functions are built from Spark's own ones; the plain functions beside them are for drivers and grouped kernels.
"""

from __future__ import annotations

import math
import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masses of the elements, lightest isotope and average.
MONO = {"C": 12.0, "H": 1.007825, "N": 14.003074, "O": 15.994915, "P": 30.973761, "S": 31.972071}
AVERAGE = {"C": 12.0107, "H": 1.00794, "N": 14.0067, "O": 15.9994, "P": 30.9738, "S": 32.065}
PROTON = 1.00727647
ISOTOPE_STEP = 1.003355
WATER = 2 * MONO["H"] + MONO["O"]

# Abundances of the isotopes by extra neutrons.
ABUNDANCE = {
    "C": [1 - 0.011078, 0.011078],
    "H": [1 - 0.00015574, 0.00015574],
    "N": [1 - 0.003663, 0.003663],
    "O": [1 - 0.000372 - 0.0020004, 0.000372, 0.0020004],
    "P": [1.0],
    "S": [1 - 0.0075 - 0.04215 - 0.00017, 0.0075, 0.04215, 0.0, 0.00017],
}

# Formulas of the amino acid residues (the acid less one water). J is leucine or isoleucine.
RESIDUES = {
    "A": "C3H5NO",
    "C": "C3H5NOS",
    "D": "C4H5NO3",
    "E": "C5H7NO3",
    "F": "C9H9NO",
    "G": "C2H3NO",
    "H": "C6H7N3O",
    "I": "C6H11NO",
    "J": "C6H11NO",
    "K": "C6H12N2O",
    "L": "C6H11NO",
    "M": "C5H9NOS",
    "N": "C4H6N2O2",
    "O": "C12H19N3O2",
    "P": "C5H7NO",
    "Q": "C5H8N2O2",
    "R": "C6H12N4O",
    "S": "C3H5NO2",
    "T": "C4H7NO2",
    "V": "C5H9NO",
    "W": "C11H10N2O",
    "Y": "C9H9NO2",
}

# The residue that a decoy has in place of another one.
DECOY_RESIDUE = {
    "G": "L",
    "A": "L",
    "V": "L",
    "L": "V",
    "X": "V",
    "I": "V",
    "F": "L",
    "M": "L",
    "P": "L",
    "W": "L",
    "S": "T",
    "C": "S",
    "U": "S",
    "T": "S",
    "Y": "S",
    "H": "S",
    "K": "L",
    "R": "L",
    "Q": "N",
    "E": "D",
    "N": "Q",
    "D": "E",
}
DECOY_FROM, DECOY_TO = "".join(DECOY_RESIDUE), "".join(DECOY_RESIDUE.values())

# What the exchange of a residue adds to the indexed retention time.
IRT_SHIFT = {
    "G": 0.5,
    "A": 0.5,
    "V": 0.25,
    "L": -0.25,
    "X": 0.5,
    "I": -0.25,
    "F": 0.25,
    "M": 0.25,
    "P": 0.5,
    "W": 0.25,
    "S": 0.25,
    "C": -0.25,
    "U": -0.5,
    "T": -0.25,
    "Y": -0.5,
    "H": -0.5,
    "K": 0.5,
    "R": 0.5,
    "Q": -0.25,
    "E": -0.25,
    "N": 0.25,
    "D": 0.25,
}

# Masses of the modifications that a sequence may name, by number or name.
MODIFICATION_MASS = {
    "UniMod:4": 57.021464,
    "Carbamidomethyl (C)": 57.021464,
    "Carbamidomethyl": 57.021464,
    "CAM": 57.021464,
    "+57": 57.021464,
    "+57.0": 57.021464,
    "UniMod:26": 39.994915,
    "PCm": 39.994915,
    "UniMod:5": 43.005814,
    "Carbamylation (KR)": 43.005814,
    "+43": 43.005814,
    "+43.0": 43.005814,
    "CRM": 43.005814,
    "UniMod:7": 0.984016,
    "Deamidation (NQ)": 0.984016,
    "Deamidation": 0.984016,
    "Dea": 0.984016,
    "+1": 0.984016,
    "+1.0": 0.984016,
    "UniMod:35": 15.994915,
    "Oxidation (M)": 15.994915,
    "Oxidation": 15.994915,
    "Oxi": 15.994915,
    "+16": 15.994915,
    "+16.0": 15.994915,
    "UniMod:1": 42.010565,
    "Acetyl (Protein N-term)": 42.010565,
    "+42": 42.010565,
    "+42.0": 42.010565,
    "UniMod:255": 28.0313,
    "AAR": 28.0313,
    "UniMod:254": 26.01565,
    "AAS": 26.01565,
    "UniMod:122": 27.994915,
    "Frm": 27.994915,
    "UniMod:1301": 128.094963,
    "+1K": 128.094963,
    "UniMod:1288": 156.101111,
    "+1R": 156.101111,
    "UniMod:27": -18.010565,
    "PGE": -18.010565,
    "UniMod:28": -17.026549,
    "PGQ": -17.026549,
    "UniMod:526": -48.003371,
    "DTM": -48.003371,
    "UniMod:325": 31.989829,
    "2Ox": 31.989829,
    "UniMod:342": 15.010899,
    "Amn": 15.010899,
    "UniMod:1290": 114.042927,
    "2CM": 114.042927,
    "UniMod:359": 13.979265,
    "PGP": 13.979265,
    "UniMod:30": 21.981943,
    "NaX": 21.981943,
    "UniMod:401": -2.01565,
    "-2H": -2.01565,
    "UniMod:528": 14.999666,
    "MDe": 14.999666,
    "UniMod:385": -17.026549,
    "dAm": -17.026549,
    "UniMod:23": -18.010565,
    "Dhy": -18.010565,
    "UniMod:129": 125.896648,
    "Iod": 125.896648,
    "Phosphorylation (ST)": 79.966331,
    "UniMod:21": 79.966331,
    "+80": 79.966331,
    "+80.0": 79.966331,
    "UniMod:259": 8.014199,
    "Lys8": 8.014199,
    "UniMod:267": 10.008269,
    "Arg10": 10.008269,
    "UniMod:268": 6.013809,
    "UniMod:269": 10.027228,
}

_BRACKETS = r"[(\[][^)\]]*[)\]]"


# --- formulas ---------------------------------------------------------------------------------------------------


def formula(text: str) -> dict[str, int]:
    """Counts of the elements; a number may be negative, and repeated elements add up."""
    if not re.fullmatch(r"([CHNOPS](-?\d+)?)*", text):
        raise ValueError(f"no formula of C, H, N, O, P, S: {text}")
    out: dict[str, int] = {}
    for element, number in re.findall(r"([CHNOPS])(-?\d+)?", text):
        out[element] = out.get(element, 0) + (int(number) if number else 1)
    return out


def formula_mass(text: str, average: bool = False) -> float:
    masses = AVERAGE if average else MONO
    return sum(masses[e] * n for e, n in formula(text).items())


RESIDUE_MASS = {r: formula_mass(f) for r, f in RESIDUES.items()}


def formula_counts(column: Column) -> Column:
    """A formula string as a map from element to count, in Spark."""
    parts = F.regexp_extract_all(column, F.lit("([CHNOPS]-?[0-9]*)"), F.lit(1))
    number = lambda p: F.when(F.length(p) > 1, F.substring(p, 2, 12).cast("int")).otherwise(F.lit(1))
    total = lambda e: F.aggregate(F.filter(parts, lambda p: F.startswith(p, F.lit(e))), F.lit(0), lambda acc, p: acc + number(p))
    return F.create_map(*[x for e in MONO for x in (F.lit(e), total(e))])


# --- sequences --------------------------------------------------------------------------------------------------


def strip_modifications(sequence: Column) -> Column:
    return F.regexp_replace(sequence, _BRACKETS, "")


def bare_length(sequence: Column) -> Column:
    return F.length(strip_modifications(sequence))


def is_valid_sequence(sequence: Column) -> Column:
    """Only residues with a formula of their own, at least one."""
    return strip_modifications(sequence).rlike(f"^[{''.join(RESIDUES)}]+$")


def isoleucine_as_leucine(sequence: Column) -> Column:
    return F.translate(sequence, "I", "L")


def keep_characters(text: Column, allowed: str) -> Column:
    return F.regexp_replace(text, f"[^{re.escape(allowed)}]", "")


def positions_of(text: Column, character: str) -> Column:
    """0-based places of a character."""
    every = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.transform(F.filter(every, lambda i: F.substring(text, i, F.lit(1)) == character), lambda i: i - 1)


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def split_key(key: Column) -> Column:
    """A key `sequence|charge` as a struct."""
    parts = F.split(key, r"\|")
    return F.struct(parts[0].alias("peptide"), F.try_element_at(parts, F.lit(2)).cast("int").alias("charge"))


def build_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def tag_decoy_proteins(groups: Column) -> Column:
    return F.replace(groups, F.lit(">"), F.lit(">decoy_"))


def modifications(sequence: str) -> dict[int, float]:
    """0-based residue -> mass of its modification, a number or a known name; -1 stands before the first residue."""
    out: dict[int, float] = {}
    residue = -1
    for token in re.finditer(rf"{_BRACKETS}|.", sequence):
        text = token[0]
        if len(text) == 1 and text not in "()[]":
            residue += 1
            continue
        name = text[1:-1]
        try:
            out[residue] = float(name)
        except ValueError:
            if name in MODIFICATION_MASS:
                out[residue] = MODIFICATION_MASS[name]
    return out


def _residue_tokens(sequence: Column) -> Column:
    """The residues, each with the modifications that follow it; what stands before the first is a token too."""
    return F.regexp_extract_all(sequence, F.lit(rf"((?:^{_BRACKETS})|[A-Z](?:{_BRACKETS})*)"), F.lit(1))


def replace_residue(sequence: Column, position: int | Column, residue: str | Column) -> Column:
    """Exchanges the residue at a 0-based position; brackets stay where they are."""
    tokens = F.filter(_residue_tokens(sequence), lambda t: t.rlike("^[A-Z]"))
    lead = F.regexp_extract(sequence, rf"^({_BRACKETS})", 1)
    at = position if isinstance(position, Column) else F.lit(position)
    new = residue if isinstance(residue, Column) else F.lit(residue)
    return F.concat(lead, F.array_join(F.transform(tokens, lambda t, i: F.when(i == at, F.concat(new, F.substr(t, F.lit(2)))).otherwise(t)), ""))


def decoy_sequence(sequence: Column) -> Column:
    """The second and the last but one residue are exchanged; modifications stay."""
    tokens = F.filter(_residue_tokens(sequence), lambda t: t.rlike("^[A-Z]"))
    lead = F.regexp_extract(sequence, rf"^({_BRACKETS})", 1)
    n = F.size(tokens)
    swap = lambda t: F.concat(F.translate(F.substring(t, 1, 1), DECOY_FROM, DECOY_TO), F.substr(t, F.lit(2)))
    return F.concat(lead, F.array_join(F.transform(tokens, lambda t, i: F.when((i == 1) | (i == n - 2), swap(t)).otherwise(t)), ""))


def _lookup(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


_DECOY_MASS = {a: RESIDUE_MASS[b] - RESIDUE_MASS[a] for a, b in DECOY_RESIDUE.items() if a in RESIDUE_MASS}


def _penultimate(values: dict[str, float], sequence: Column) -> Column:
    bare = strip_modifications(sequence)
    table, n = _lookup(values), F.length(bare)
    at = lambda k: F.coalesce(F.try_element_at(table, F.substring(bare, k, F.lit(1))), F.lit(0.0))
    second = F.when(n >= 2, at(F.lit(2))).otherwise(0.0)
    return second + F.when((n >= 2) & (n != 3), at(n - 1)).otherwise(0.0)


def decoy_mass_shift(sequence: Column) -> Column:
    """Mass that the two exchanges add; a residue that is both places is exchanged once."""
    return _penultimate(_DECOY_MASS, sequence)


def decoy_irt(irt: Column, sequence: Column) -> Column:
    return irt + _penultimate(IRT_SHIFT, sequence)


def residue_counts(sequence: Column) -> Column:
    """Map from each letter to how often it stands in the bare sequence."""
    bare = strip_modifications(sequence)
    return F.create_map(*[x for c in map(chr, range(65, 91)) for x in (F.lit(c), F.regexp_count(bare, F.lit(c)))])


# --- masses -----------------------------------------------------------------------------------------------------


def residue_masses(sequence: Column) -> Column:
    """Masses of the residues of a bare sequence; unknown letters weigh nothing."""
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.coalesce(F.try_element_at(_lookup(RESIDUE_MASS), c), F.lit(0.0)))


def modification_mass(sequence: Column) -> Column:
    """Mass of all bracketed modifications, numbers or known names."""
    names = F.regexp_extract_all(sequence, F.lit(r"[(\[]([^)\]]*)[)\]]"), F.lit(1))
    return F.aggregate(names, F.lit(0.0), lambda acc, n: acc + F.coalesce(F.expr("cast(0 as double)") + n.try_cast("double"), F.try_element_at(_lookup(MODIFICATION_MASS), n), F.lit(0.0)))


def peptide_mass(sequence: Column) -> Column:
    return F.aggregate(residue_masses(strip_modifications(sequence)), F.lit(WATER), lambda acc, m: acc + m) + modification_mass(sequence)


def mass_to_mz(mass: Column, charge: Column | int, isotope: Column | int = 0) -> Column:
    return (mass + charge * F.lit(PROTON) + isotope * F.lit(ISOTOPE_STEP)) / charge


def mz_to_mass(mz: Column, charge: Column | int, isotope: Column | int = 0) -> Column:
    return mz * charge - charge * F.lit(PROTON) - isotope * F.lit(ISOTOPE_STEP)


def guess_charge(mass: Column, mz: Column) -> Column:
    return F.round(mass / mz).cast("int")


def isotope_ladder(mz: Column, charge: Column, left: int, right: int) -> Column:
    return F.transform(F.sequence(F.lit(-left), F.lit(right)), lambda i: mz + i * ISOTOPE_STEP / charge)


def series_mz(sequence: Column, kind: str, charge: int | Column) -> Column:
    """m/z of the b ions (from the left) or y ions (from the right, with a water) of a bare sequence, whole one left out."""
    masses = residue_masses(sequence)
    masses = F.reverse(masses) if kind == "y" else masses
    z = charge if isinstance(charge, Column) else F.lit(charge)
    extra = WATER if kind == "y" else 0.0
    inner = F.slice(masses, 1, F.greatest(F.size(masses) - 1, F.lit(0)))
    prefix = F.transform(inner, lambda _, i: F.aggregate(F.slice(inner, F.lit(1), i + 1), F.lit(extra), lambda acc, m: acc + m))
    return F.transform(prefix, lambda m: (m + z * F.lit(PROTON)) / z)


def fragment_mz(sequence: str, kind: str, charge: int) -> list[float]:
    """series_mz in plain Python, modifications included; the full length is left out."""
    mods = modifications(sequence)
    bare = re.sub(_BRACKETS, "", sequence)
    masses = [RESIDUE_MASS[c] + mods.get(i, 0.0) for i, c in enumerate(bare)]
    if masses:
        masses[0] += mods.get(-1, 0.0)
    total, out = (WATER if kind == "y" else 0.0), []
    for m in (masses[::-1] if kind == "y" else masses)[:-1]:
        total += m
        out.append((total + charge * PROTON) / charge)
    return out


# --- ion labels -------------------------------------------------------------------------------------------------


def parse_label(label: Column) -> Column:
    """`y7-H2O`, `b3^2`, `a2`, `p` as (kind, number, charge); a label without number is number 0, without ^ charge 1."""
    kind = F.regexp_extract(label, r"^([abyp])", 1)
    number = F.regexp_extract(label, r"^[aby](\d+)", 1)
    charge = F.regexp_extract(label, r"\^(\d+)", 1)
    as_int = lambda c, default: F.when(c == "", F.lit(default)).otherwise(c.try_cast("int"))
    return F.struct(kind.alias("kind"), as_int(number, 0).alias("number"), as_int(charge, 1).alias("charge"))


def build_label(kind: Column, number: Column, charge: Column) -> Column:
    return F.concat(kind, number.cast("string"), F.when(charge > 1, F.concat(F.lit("^"), charge.cast("string"))).otherwise(""))


# --- isotopes ---------------------------------------------------------------------------------------------------


def isotope_distribution(counts: dict[str, int], least: float = 0.001, most: int = 40) -> list[float]:
    """Shares of 0, 1, 2 ... extra neutrons up to and with the first whose probability is at most `least`, the largest being 1."""
    import numpy as np

    def power(p: np.ndarray, n: int) -> np.ndarray:
        out = np.ones(1)
        while n:
            if n & 1:
                out = np.convolve(out, p)[:most]
            p = np.convolve(p, p)[:most]
            n >>= 1
        return out

    parts = [power(np.array(ABUNDANCE[e]), n) for e, n in counts.items() if n > 0]
    whole = reduce(lambda a, b: np.convolve(a, b)[:most], parts, np.ones(1))
    small = np.flatnonzero(whole <= least)
    kept = whole[: int(small[0]) + 1 if len(small) else None]
    return (kept / kept.max()).tolist()


def sequence_formula(sequence: str) -> dict[str, int]:
    total: dict[str, int] = {"H": 2, "O": 1}
    for c in re.sub(_BRACKETS, "", sequence):
        for e, n in formula(RESIDUES[c]).items():
            total[e] = total.get(e, 0) + n
    return total


# Elements of the average residue.
AVERAGINE = {"C": 4.94, "H": 7.76, "N": 1.36, "O": 1.48, "S": 0.04}
AVERAGINE_MASS = sum(AVERAGE[e] * n for e, n in AVERAGINE.items())


@cache
def averagine(mass: float) -> tuple[float, ...]:
    """Isotope shares of an average peptide; hydrogens make up for the rounding of the other elements."""
    units = mass / AVERAGINE_MASS
    counts = {e: math.floor(n * units + 0.5) for e, n in AVERAGINE.items()}
    counts["H"] += math.floor(mass - sum(AVERAGE[e] * n for e, n in counts.items()) + 0.5)
    return tuple(isotope_distribution(counts))


def averagine_near(mass: float) -> tuple[float, ...]:
    """averagine of the table's mass that is nearest below."""
    return averagine(float(min(max(int(mass) // 10 * 10, 300), 9_990)))


def averagine_table(low: int = 300, high: int = 10_000, step: int = 10) -> dict[int, tuple[float, ...]]:
    return {m: averagine(float(m)) for m in range(low, high, step)}


def p_value_from_t(t: float) -> float:
    return 1 - math.erf(abs(t) / math.sqrt(2))
