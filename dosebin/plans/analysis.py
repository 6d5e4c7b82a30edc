"""The full analyses: clean -> trim -> ratio -> gate -> bin -> bootstrap -> renumber."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import parameter_label, relative_bin
from ..operators import binning, bootstrap, gates
from ..operators.density import histogram_2d
from ..operators.selection import quantiles
from ..session import attach, materialize


@dataclass
class Result:
    """The four tables of an analysis, all lazy."""

    all_cells: DataFrame
    filtered: DataFrame
    binned: DataFrame
    boot: DataFrame


@dataclass(frozen=True)
class Settings:
    """What to gate on, bin by and resample; every variant is a change of these."""

    q_signal: float = 0.0
    q_ha: float = 0.9
    n_bins: int = 10
    n_boot: int = 1000
    seed: int = 0
    signal: str = "norm_psmad2"
    gate_keys: tuple[str, ...] = ("experiment",)
    bin_keys: tuple[str, ...] = tuple(S.BIN_KEYS)
    summary_keys: tuple[str, ...] = tuple(S.SUMMARY_KEYS)
    number_keys: tuple[str, ...] = (*S.BIN_KEYS, "dox")
    control: str = "untreated"
    only_dox: str | None = None
    binning: str = "equal_width"
    tie_break: str = "cell_id"
    statistic: str = "bootstrap"

    def with_keys(self, *keys: str) -> Settings:
        """The same analysis done separately for each value of ``keys``."""
        return replace(
            self,
            gate_keys=(*keys, *self.gate_keys),
            bin_keys=(*keys, *self.bin_keys),
            summary_keys=(*keys, *self.summary_keys),
            number_keys=(*keys, *self.number_keys),
        )


SINGLE_LIGAND = Settings(q_ha=0.99)
GATED = Settings(q_ha=0.95).with_keys("gate")
NO_LIGAND = Settings(
    q_ha=0.95,
    n_bins=20,
    bin_keys=tuple(S.BIN_KEYS_NO_LIGAND),
    summary_keys=tuple(S.SUMMARY_KEYS_NO_LIGAND),
    number_keys=("experiment", "sample", "dox"),
)
TWO_LIGAND = Settings(
    q_ha=0.95,
    bin_keys=tuple(S.BIN_KEYS_TWO_LIGAND),
    summary_keys=tuple(S.SUMMARY_KEYS_TWO_LIGAND),
    number_keys=tuple(S.BIN_KEYS_TWO_LIGAND),
    control="uninduced",
    only_dox=S.PLUS_DOX,
)
TWO_LIGAND_DECILES = replace(
    TWO_LIGAND,
    bin_keys=(*S.BIN_KEYS_TWO_LIGAND, "replicate"),
    summary_keys=(*S.SUMMARY_KEYS_TWO_LIGAND, "replicate"),
    number_keys=(*S.BIN_KEYS_TWO_LIGAND, "replicate", "dox"),
    only_dox=None,
    binning="equal_count",
)
LEGACY = Settings(
    q_signal=0.75,
    q_ha=0.9,
    n_bins=8,
    gate_keys=("experiment", "ligand"),
    bin_keys=tuple(S.BIN_KEYS_LEGACY),
    summary_keys=tuple(S.SUMMARY_KEYS_LEGACY),
    number_keys=("experiment", "ligand", "ligand_conc"),
    control="luc",
)

CONTROLS = {
    "untreated": gates.control_untreated,
    "uninduced": gates.control_uninduced,
    "luc": gates.control_luc,
}


def summarised_columns(s: Settings) -> list[str]:
    """Columns of cells that the summary of an analysis depends on; a table of these alone is smaller to store."""
    named = {"cell_line", "dox", "ligand", "ligand_conc", "ha", s.signal}
    named |= {*s.gate_keys, *s.bin_keys, *s.summary_keys, *s.number_keys}
    return sorted(named | ({s.tie_break} if s.binning == "equal_count" else set()))


def bin_cells(filtered: DataFrame, s: Settings) -> DataFrame:
    if s.binning == "equal_width":
        return binning.equal_width_bins(filtered, s.n_bins, list(s.bin_keys))
    if s.binning == "equal_count":
        return binning.equal_count_bins(filtered, s.n_bins, list(s.bin_keys), tie_break=s.tie_break)
    raise ValueError("binning must be 'equal_width' or 'equal_count'")


def summarise(binned: DataFrame, s: Settings, names: DataFrame | None = None) -> DataFrame:
    """Bootstrap (or, with ``statistic="mean"``, plain mean / median) per bin, renumbered.

    ``names`` holds the summary keys, if cells carry short codes in their place; its other columns are these codes.
    """
    keys = list(s.summary_keys)
    codes = keys if names is None else [c for c in names.columns if c not in keys]
    if s.statistic == "bootstrap":
        table = bootstrap.bootstrap_bins(binned, codes, s.signal, s.n_boot, s.seed, names=names)
    elif s.statistic == "mean":
        table = binning.bin_summary(binned, codes, s.signal)
    else:
        raise ValueError("statistic must be 'bootstrap' or 'mean'")
    if names is not None:
        rest = [c for c in table.columns if c not in codes]
        table = attach(table, names, codes).select(*keys, *rest)
    return binning.renumber_bins(table, list(s.number_keys))


def gated_cells(cells: DataFrame, s: Settings) -> DataFrame:
    """Cells that pass the gate, written once."""
    filtered = gates.control_gate(
        cells, CONTROLS[s.control](), s.q_signal, s.q_ha, s.gate_keys, s.signal
    )
    if s.only_dox is not None:
        filtered = filtered.where(F.col("dox") == s.only_dox)
    return materialize(filtered)


def analyse(cells: DataFrame, s: Settings = SINGLE_LIGAND) -> Result:
    """Gate, bin and summarise trimmed cells of any number of experiments at once.

    Gated cells are written once, so that ranges, bins and resamples read them and not
    all that made them; give cells that are stored, too.
    """
    filtered = gated_cells(cells, s)
    binned = bin_cells(filtered, s)
    return Result(cells, filtered, binned, summarise(binned, s))


def compare_gates(cells: DataFrame, s: Settings = GATED) -> Result:
    """Both gates in one run: the gate is one more key."""
    return analyse(cells, s)


def rebin_after_band(
    cells: DataFrame, s: Settings = replace(SINGLE_LIGAND, q_ha=0.5), low: float = 0.08, high: float = 0.75
) -> Result:
    """Keep a DNA-content band per experiment and dose, then analyse."""
    return analyse(gates.percentile_band(cells, ["experiment", "ligand_conc"], "dapi", low, high), s)


def analyse_experiment(
    cells: DataFrame, s: Settings, experiment: str | None = None, density_bins: int = 128
) -> dict[str, DataFrame]:
    """An experiment's tables, plain bin summaries, and density tables before and after the gate.

    Without ``experiment`` every experiment is done, each on its own.
    """
    one = cells if experiment is None else cells.where(F.col("experiment") == experiment)
    r = analyse(one, s)
    facets = ["experiment", "cell_line", "ligand_conc"]
    plain = ["experiment", "cell_line", "ligand", "ligand_conc"]
    return {
        "filtered": r.filtered,
        "binned": r.binned,
        "boot": r.boot,
        "bin_summary": binning.bin_summary(r.binned, plain, s.signal),
        "density_all": histogram_2d(one, "ha", s.signal, facets, density_bins),
        "density_filtered": histogram_2d(r.filtered, "ha", s.signal, facets, density_bins),
    }


def parameter_sweep(
    cells: DataFrame,
    q_signals: list[float] = (0.9, 0.5, 0.0),
    q_has: list[float] = (0.1,),
    n_bins: list[int] = (5, 8, 10, 20),
    s: Settings = LEGACY,
) -> DataFrame:
    """Every combination of gate quantiles and bin counts in one plan.

    Thresholds for all quantiles come from one pass over the control rows.  A cell is repeated for the
    gates that it passes before its range is looked for, and for the bin counts after it; it carries numbers
    that stand for its condition, so the names are compared once a cell and travel with none.
    """
    control = CONTROLS[s.control]()
    wanted = {f"__s{i}": (s.signal, q) for i, q in enumerate(q_signals)}
    wanted |= {f"__h{i}": ("ha", q) for i, q in enumerate(q_has)}
    limits = materialize(quantiles(cells.where(control), list(s.gate_keys), wanted))
    cells = cells.where(F.col("cell_line") == "R3")
    keep = sorted(set(s.gate_keys + s.bin_keys + s.summary_keys))
    known = materialize(attach(cells.select(*keep).distinct(), limits, list(s.gate_keys)))
    groups, ranges = _numbered(known, s.summary_keys, "__group"), _numbered(known, s.bin_keys, "__range")
    known = materialize(attach(attach(known, groups, list(s.summary_keys)), ranges, list(s.bin_keys)))

    gate_of = [(i, j) for i in range(len(q_signals)) for j in range(len(q_has))]
    passed = [
        F.when((F.col(s.signal) > F.col(f"__s{i}")) & (F.col("ha") > F.col(f"__h{j}")), F.lit(g))
        for g, (i, j) in enumerate(gate_of)
    ]
    rows = attach(cells, known, keep).select(
        "__group", "__range", "ha", s.signal, F.explode(F.array_compact(F.array(*passed))).alias("__gate")
    )
    counts = [int(n) for n in n_bins]
    binned = binning.equal_width_bins(rows, counts, ["__gate", "__range"])
    params = ["q_signal", "q_ha", "n_bins"]

    def unit(gate: Column, n: Column) -> Column:
        """A combination's number for a condition."""
        which = gate * len(counts) + F.array_position(F.array(*map(F.lit, counts)), n) - 1
        return (F.col("__group") * (len(gate_of) * len(counts)) + which).alias("__unit")

    binned = binned.select(unit(F.col("__gate"), F.col("n_bins")), "bin_id", "bin_lo", "bin_hi", s.signal)
    combos = [
        F.struct(
            unit(F.lit(g), F.lit(n)),
            F.lit(float(q_signals[i])).alias("q_signal"),
            F.lit(float(q_has[j])).alias("q_ha"),
            F.lit(n).alias("n_bins"),
        )
        for g, (i, j) in enumerate(gate_of)
        for n in counts
    ]
    names = materialize(groups.select(*s.summary_keys, F.inline(F.array(*combos))))
    names = names.select("__unit", *params, *s.summary_keys)
    boot = summarise(binned, s.with_keys(*params), names)
    return boot.withColumn(
        "param_combo", parameter_label(F.col("q_signal"), F.col("q_ha"), F.col("n_bins"))
    ).withColumn("relative_bin", relative_bin(F.col("bin_id"), F.col("n_bins")))


def _numbered(rows: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """The combinations of ``keys`` that occur, each with a number of its own."""
    return materialize(rows.select(*keys).distinct().withColumn(name, F.monotonically_increasing_id()))


def stack(*tables: tuple[str, DataFrame], tag: str = "gate") -> DataFrame:
    """Stack tables by column name with the name of each in column ``tag``."""
    parts = [t.withColumn(tag, F.lit(name)) for name, t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
