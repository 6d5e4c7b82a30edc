"""Default column names, group keys and fixed values."""

from __future__ import annotations

# Channel name prefix in the export -> analyte column.
FIVE_LASER = {"B1-A": "ha", "YG1-A": "psmad2", "R2-A": "smad2", "UV7-A": "dapi"}
FIVE_LASER_NO_DAPI = {"B1-A": "ha", "YG1-A": "psmad2", "R2-A": "smad2"}
THREE_LASER = {"HA": "ha", "pSMAD2": "psmad2", "SMAD2": "smad2"}

# Outer edge of the dose grid, (tgfb1, gdf11) in walking order.
EDGE_ORDER = [
    (3.16, 0.0),
    (3.16, 2.5),
    (3.16, 7.9),
    (3.16, 25.0),
    (1.0, 25.0),
    (0.316, 25.0),
    (0.0, 25.0),
]

# Outliers are trimmed per condition; the experiment is always part of it.
TRIM_KEYS = ["experiment", "cell_line", "ligand", "ligand_conc"]
TRIM_KEYS_GATED = [*TRIM_KEYS, "gate"]
TRIM_KEYS_NO_LIGAND = ["experiment", "cell_line", "ligand"]
TRIM_KEYS_TWO_LIGAND = ["experiment", "cell_line", "tgfb1", "gdf11"]

# Bins share edges across dox levels; summaries do not share them.
BIN_KEYS = ["experiment", "replicate", "ligand", "ligand_conc"]
SUMMARY_KEYS = [*BIN_KEYS, "cell_line", "dox"]
BIN_KEYS_NO_LIGAND = ["experiment", "sample", "ligand"]
SUMMARY_KEYS_NO_LIGAND = [*BIN_KEYS_NO_LIGAND, "cell_line", "dox"]
BIN_KEYS_TWO_LIGAND = ["experiment", "tgfb1", "gdf11"]
SUMMARY_KEYS_TWO_LIGAND = [*BIN_KEYS_TWO_LIGAND, "cell_line", "dox"]
BIN_KEYS_LEGACY = ["experiment", "ligand"]
SUMMARY_KEYS_LEGACY = [*BIN_KEYS_LEGACY, "cell_line", "ligand_conc"]

PLUS_DOX = "+dox"
MINUS_DOX = "-dox"
NO_LIGAND = "No Cyto"
