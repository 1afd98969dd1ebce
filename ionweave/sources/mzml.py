"""mzML files by Spark's own XML reader, which splits a file at its spectrum elements. Times are minutes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.functions.vectors import unpack_floats

_PARAM = "array<struct<_accession:string,_name:string,_value:string,_unitAccession:string>>"
_BINARY = f"struct<binaryDataArray:array<struct<cvParam:{_PARAM},binary:string>>>"
_ION = f"struct<selectedIon:array<struct<cvParam:{_PARAM}>>>"
_PRECURSOR = f"struct<precursor:array<struct<isolationWindow:struct<cvParam:{_PARAM}>,selectedIonList:{_ION},activation:struct<cvParam:{_PARAM}>>>>"
SPECTRUM = f"_index long, _id string, cvParam {_PARAM}, scanList struct<scan:array<struct<cvParam:{_PARAM}>>>, precursorList {_PRECURSOR}, binaryDataArrayList {_BINARY}"

# Accessions of the terms that are read.
LEVEL, SCAN_TIME, DRIFT_TIME = "MS:1000511", "MS:1000016", "MS:1002476"
TARGET_MZ, LOWER, UPPER, ENERGY = "MS:1000827", "MS:1000828", "MS:1000829", "MS:1000045"
MZ_ARRAY, INTENSITY_ARRAY, ZLIB, DOUBLE = "MS:1000514", "MS:1000515", "MS:1000574", "MS:1000523"
MINUTE, SECOND, MILLISECOND = "UO:0000031", "UO:0000010", "UO:0000028"


def _param(params: Column, accession: str) -> Column:
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))


def _has(params: Column, accession: str) -> Column:
    return F.exists(params, lambda p: p["_accession"] == accession)


def _number(params: Column, accession: str) -> Column:
    return _param(params, accession)["_value"].try_cast("double")


def target_key(mz: Column, places: int = 3) -> Column:
    """A window's name: its centre as a whole number of 10^-places, "" without one."""
    return F.coalesce(F.round(mz * 10.0**places).cast("long").cast("string"), F.lit(""))


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """One row per spectrum in the schema of scans; points without intensity are left out.

    The scan number is the index in the file plus one. Of spectra that come twice, one is kept.
    """
    raw = spark.read.format("xml").option("rowTag", "spectrum").option("ignoreNamespace", True).schema(SPECTRUM).load(path)
    scan = F.get(F.col("scanList.scan"), F.lit(0))["cvParam"]
    precursor = F.get(F.col("precursorList.precursor"), F.lit(0))
    window = precursor["isolationWindow"]["cvParam"]
    time = _param(scan, SCAN_TIME)
    per_minute = F.when(time["_unitAccession"] == SECOND, 60.0).when(time["_unitAccession"] == MILLISECOND, 60_000.0).otherwise(1.0)
    arrays = F.col("binaryDataArrayList.binaryDataArray")

    def blob(kind: str) -> list[Column]:
        own = F.get(F.filter(arrays, lambda a: _has(a["cvParam"], kind)), F.lit(0))
        return [F.unbase64(F.regexp_replace(own["binary"], r"\s", "")), _has(own["cvParam"], DOUBLE), _has(own["cvParam"], ZLIB)]

    flat = raw.select(
        (F.col("_index") + 1).alias("scan_number"),
        _number(F.col("cvParam"), LEVEL).cast("int").alias("ms_level"),
        (time["_value"].try_cast("double") / per_minute).alias("scan_time"),
        _number(precursor["activation"]["cvParam"], ENERGY).alias("collision_energy"),
        _number(window, TARGET_MZ).alias("precursor_mz"),
        _number(window, LOWER).alias("iso_lower"),
        _number(window, UPPER).alias("iso_upper"),
        _number(scan, DRIFT_TIME).alias("drift_time"),
        F.lit(None).cast("long").alias("drift_index"),
        target_key(_number(window, TARGET_MZ)).alias("target_key"),
        *[c.alias(f"_{kind}{k}") for kind, name in (("m", MZ_ARRAY), ("i", INTENSITY_ARRAY)) for k, c in enumerate(blob(name))],
    ).dropDuplicates(["scan_number"])
    decoded = flat.withColumn("_mz", _decoded("m")).withColumn("_in", _decoded("i"))
    points = F.filter(F.zip_with("_mz", "_in", lambda m, i: F.struct(m.alias("mz"), i.alias("intensity"))), lambda p: F.abs(p["intensity"]) > 1e-5)
    names = ["scan_number", "ms_level", "scan_time", "collision_energy", "precursor_mz", "iso_lower", "iso_upper", "drift_time", "drift_index", "target_key"]
    return decoded.withColumn("_p", points).select(*names, F.col("_p.mz").alias("mz"), F.col("_p.intensity").alias("intensity"))


def _decoded(kind: str) -> Column:
    """The four encodings; only the one that holds has bytes, the others get null."""
    raw, double, packed = F.col(f"_{kind}0"), F.coalesce(F.col(f"_{kind}1"), F.lit(False)), F.coalesce(F.col(f"_{kind}2"), F.lit(False))
    out = F.lit(None).cast("array<double>")
    for is_double in (True, False):
        for is_packed in (True, False):
            own = F.when((double == is_double) & (packed == is_packed) & (F.length(raw) > 0), raw)
            out = F.coalesce(out, unpack_floats(own, is_double, is_packed))
    return F.coalesce(out, F.expr("cast(array() as array<double>)"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The scans of an mzML file without their points, which are neither parsed into columns nor decoded."""
    return read_mzml(spark, path).drop("mz", "intensity")


def _read_parquet(spark: SparkSession, path: str) -> DataFrame:
    from ionweave.sources.tabular import read_scans

    return read_scans(spark, path)


#: Readers by kind, and kinds by suffix; register_reader adds to both.
READERS = {"mzml": read_mzml, "parquet": _read_parquet}
SUFFIXES = {"mzml": "mzml", "parquet": "parquet", "prqff": "parquet", "cached": "parquet"}


def register_reader(kind: str, read: Callable[[SparkSession, str], DataFrame], *suffixes: str) -> None:
    """Opens files of these suffixes (the kind itself without any) by a reader that returns scans in their schema."""
    READERS[kind] = read
    SUFFIXES.update({s.lower(): kind for s in suffixes or (kind,)})


def open_run(spark: SparkSession, path: str, kind: str | None = None, between: tuple[str, object, object] | None = None) -> DataFrame:
    """Scans of a file by its kind, by the suffix if not given. Vendor folders (.d) need the vendor's library.

    between: (column, low, high), a closed range of a scan column, such as scan_number; Parquet scans read only that.
    """
    from ionweave.operators.filters import expect

    suffix = path.rstrip("/").rpartition(".")[2].lower()
    kind = kind or SUFFIXES.get(suffix, suffix)
    expect(kind in READERS, f"no reader for {path}")
    scans = READERS[kind](spark, path)
    return scans.where(F.col(between[0]).between(between[1], between[2])) if between else scans


def convert(spark: SparkSession, source: str, target: str) -> None:
    """mzML to Parquet, a folder per window."""
    from ionweave.sources.tabular import write_run

    write_run(read_mzml(spark, source), target)
