"""Fields packed in sample names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "sample_of_path",
    "strip_extension",
    "gate_label",
    "name_field",
    "dox_label",
    "ligand_conc",
    "ligand_label",
    "replicate_number",
    "legacy_cell_line",
    "legacy_ligand",
    "legacy_conc",
    "suffixed_dose",
]

# Fixed values of the sample names: codes and marks, and the labels they stand for.
DOX_CODES = {"pD": "+dox", "mD": "-dox"}
LIGAND_CODES = {"T": "TGFB1", "G": "GDF11"}
NO_LIGAND_CODE, NO_LIGAND = "mC", "No Cyto"
GATE_MARK, OTHER_GATE = "DAPI", "Singlet"
UNKNOWN, UNKNOWN_LEGACY = "Error", "error"
DOSE_PATTERN = "^[0-9.]+[TG]$"
LEGACY_DOSE_PATTERN = "(?<=_).*?(?=[TG])"


def _label(codes: dict[str, str], holds, other: str) -> Column:
    """Label of the first code that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, label in codes.items():
        out = out.when(holds(code), label)
    return out.otherwise(other)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.csv$", "")


def sample_of_path(path: Column) -> Column:
    """Sample name from a file path.

    A sample is ``<sample>.csv``, or a folder of part files when it was too
    large for one file (``<sample>.csv/part-0000.csv``, ``sample=<sample>/part-...``).
    """
    decoded = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return strip_extension(F.regexp_extract(decoded, r"([^/=]+)(?:/part-[^/]*)?$", 1))


def gate_label(name: Column) -> Column:
    return F.when(name.contains(GATE_MARK), GATE_MARK).otherwise(OTHER_GATE)


def name_field(name: Column, index: int) -> Column:
    """Field ``index`` of an underscore-joined name; NULL when it is missing."""
    return F.get(F.split(name, "_"), F.lit(index))


def dox_label(field: Column) -> Column:
    return _label(DOX_CODES, lambda code: field == code, UNKNOWN)


def ligand_conc(field: Column) -> Column:
    """Dose in ng/ml: 0 without ligand, -1 when the field is not a dose."""
    dose = F.regexp_replace(field, "[TG]$", "").try_cast("double")
    return (
        F.when(field == NO_LIGAND_CODE, F.lit(0.0))
        .when(field.rlike(DOSE_PATTERN), dose)
        .otherwise(F.lit(-1.0))
    )


def ligand_label(field: Column) -> Column:
    return _label({**LIGAND_CODES, NO_LIGAND_CODE: NO_LIGAND}, field.contains, UNKNOWN)


def replicate_number(field: Column) -> Column:
    return F.coalesce(F.regexp_substr(field, F.lit(r"\d+$")).try_cast("int"), F.lit(1))


def legacy_cell_line(name: Column) -> Column:
    return F.regexp_substr(name, F.lit("^[^_]+"))


def legacy_ligand(name: Column) -> Column:
    return _label(LIGAND_CODES, name.endswith, UNKNOWN_LEGACY)


def legacy_conc(name: Column) -> Column:
    return F.regexp_substr(name, F.lit(LEGACY_DOSE_PATTERN)).try_cast("double")


def suffixed_dose(field: Column, suffix: str) -> Column:
    return F.regexp_replace(field, f"{suffix}$", "").try_cast("double")
