"""The queries as plain SQL over the same tables, for checking."""

from __future__ import annotations

import math

N_BOOT = 1000
N_TREE = 200
BLOCK = 256
SEED = 7
PRIME = (1 << 31) - 1
FIRST = 500_000_003

# ------------------------------------------------------------------ fragments

RAW = """
raw AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS experiment,
  CASE WHEN l_linenumber <= 5 THEN 'R3' ELSE 'Luc' END AS cell_line,
  CASE WHEN l_linestatus = 'F' THEN '-dox' ELSE '+dox' END AS dox,
  CASE l_orderkey % 5 WHEN 0 THEN 'No Cyto' WHEN 4 THEN 'GDF11' ELSE 'TGFB1' END AS ligand,
  CAST(CASE l_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0.1 WHEN 2 THEN 1 WHEN 3 THEN 3.16 ELSE 2.5 END AS DOUBLE) AS ligand_conc,
  CAST(1 + l_suppkey % 2 AS INTEGER) AS replicate,
  CASE WHEN l_suppkey % 3 = 0 THEN 'DAPI' ELSE 'Singlet' END AS gate,
  CAST(CASE l_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.316 WHEN 2 THEN 1 ELSE 3.16 END AS DOUBLE) AS tgfb1,
  CAST(CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2.5 WHEN 2 THEN 7.9 ELSE 25 END AS DOUBLE) AS gdf11,
  CAST(l_partkey + 10 AS DOUBLE) AS ha, l_quantity AS psmad2, l_extendedprice AS smad2,
  CAST(l_suppkey AS DOUBLE) AS dapi,
  CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
    CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT))), 1, 15) AS BIGINT) AS cell_id
  FROM lineitem)"""

CELLS = RAW + """,
cells AS (SELECT * REPLACE (log10(ha) AS ha, log10(psmad2) AS psmad2, log10(smad2) AS smad2),
    log10(psmad2) / log10(smad2) AS norm_psmad2
  FROM raw WHERE ha > 0 AND psmad2 > 0 AND smad2 > 0)"""

TRIM_KEYS = "experiment, cell_line, ligand, ligand_conc, gate"
BIN_KEYS = "experiment, replicate, ligand, ligand_conc"
SUMMARY_KEYS = f"{BIN_KEYS}, cell_line, dox"
GRID_KEYS = "experiment, tgfb1, gdf11"
GRID_SUMMARY = f"{GRID_KEYS}, cell_line, dox"
UNTREATED = "dox = '-dox' AND ligand = 'No Cyto'"


def trim(name: str, source: str, keys: str, columns=("psmad2", "ha"), low=0.001, high=0.999) -> str:
    q = ", ".join(
        f"quantile_cont({c}, {low}) AS lo_{c}, quantile_cont({c}, {high}) AS hi_{c}" for c in columns
    )
    inside = " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in columns)
    return f"""
{name}_limits AS (SELECT {keys}, {q} FROM {source} GROUP BY {keys}),
{name} AS (SELECT s.* FROM {source} s JOIN {name}_limits USING ({keys}) WHERE {inside})"""


def gate(name, source, control, qs, qh, keys="experiment", signal="norm_psmad2", more="") -> str:
    return f"""
{name}_limits AS (SELECT {keys}, quantile_cont({signal}, {qs}) AS signal_threshold,
    quantile_cont(ha, {qh}) AS ha_threshold FROM {source} WHERE {control} GROUP BY {keys}),
{name} AS (SELECT s.*, signal_threshold, ha_threshold FROM {source} s JOIN {name}_limits USING ({keys})
  WHERE cell_line = 'R3' AND {signal} > signal_threshold AND ha > ha_threshold {more})"""


def bins(name, source, keys, n, column="ha") -> str:
    """Equal-width bins by comparing with every inner edge."""
    by = f"PARTITION BY {keys}" if keys else ""
    return f"""
{name}_range AS (SELECT *, min({column}) OVER ({by}) - 0.1 AS lo,
    ((max({column}) OVER ({by}) + 0.1) - (min({column}) OVER ({by}) - 0.1)) / {n} AS width FROM {source}),
{name} AS (SELECT *, lo + (bin_id - 1) * width AS bin_lo, lo + bin_id * width AS bin_hi FROM
  (SELECT *, CAST(1 + len(list_filter(range(1, CAST({n} AS BIGINT)), lambda k: lo + k * width < {column})) AS INTEGER) AS bin_id
   FROM {name}_range))"""


def summary(name, source, keys, number_keys, signal="norm_psmad2") -> str:
    return f"""
{name}_plain AS (SELECT {keys}, bin_id, avg({signal}) AS mean_{signal}, median({signal}) AS median_{signal},
    count(*) AS n_cells, min(bin_id) AS old_bin FROM {source} GROUP BY {keys}, bin_id),
{name} AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY {number_keys} ORDER BY old_bin) AS INTEGER) AS bin_id),
    experiment || ' #' || {'replicate' if 'replicate' in keys else "'-'"} AS exp_rep FROM {name}_plain)"""


def bootstrap(name, source, keys, value="norm_psmad2", n_boot=N_BOOT, seed=SEED) -> str:
    """Draws one by one: position = cubic hash of the draw number modulo 2^31 - 1, scaled to the bin."""
    group = f"{keys}, bin_id"
    c = [f"(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT) & 268435455)" for i in range(4)]
    return f"""
{name}_bins AS (SELECT {group}, list({value} ORDER BY {value}) AS xs, count(*) AS n FROM {source} GROUP BY {group}),
{name}_reps AS (SELECT *, md5('{seed}|' || concat_ws('|', {group}) || '|' || b) AS h
  FROM {name}_bins, (SELECT unnest(range(1, {n_boot} + 1)) AS b)),
{name}_coef AS (SELECT *, {c[0]} AS c0, {c[1]} AS c1, {c[2]} AS c2, {c[3]} AS c3 FROM {name}_reps),
{name}_draws AS (SELECT {group}, n, list_transform(range({FIRST}, {FIRST} + n), lambda i:
    xs[1 + (((((((c3 * i + c2) % {PRIME}) * i + c1) % {PRIME}) * i + c0) % {PRIME} * n) >> 31)]) AS drawn FROM {name}_coef),
{name}_stats AS (SELECT {group}, list_avg(drawn) AS m, list_median(drawn) AS md, n FROM {name}_draws),
{name} AS (SELECT {group}, avg(m) AS mean_{value}, quantile_cont(m, 0.025) AS mean_{value}_low,
    quantile_cont(m, 0.975) AS mean_{value}_high, avg(md) AS median_{value},
    quantile_cont(md, 0.025) AS median_{value}_low, quantile_cont(md, 0.975) AS median_{value}_high,
    any_value(n) AS n_cells FROM {name}_stats GROUP BY {group})"""


def polynomial(h: str, z: str) -> str:
    """Cubic hash of ``z`` modulo 2^31 - 1 with the four 28-bit words of the md5 text ``h``."""
    c = [f"(CAST('0x' || substr({h}, {1 + 8 * i}, 8) AS BIGINT) & 268435455)" for i in range(4)]
    return f"((((({c[3]} * ({z}) + {c[2]}) % {PRIME}) * ({z}) + {c[1]}) % {PRIME}) * ({z}) + {c[0]}) % {PRIME}"


def bootstrap_tree(name, source, keys, value, n_boot, block, seed=SEED) -> str:
    """Replicates by a tree over blocks: coins split the draws of a node, then draws are positions in their block."""
    group = f"{keys}, bin_id"
    coins = f"""CAST(coalesce(list_sum(list_transform(range(0, (acc.u + 29) // 30), lambda w:
        bit_count(({polynomial('h', f'{FIRST} + x.d * 33554432 + w')}) & ((1 << least(30, acc.u - 30 * w)) - 1)))), 0) AS BIGINT)"""
    return f"""
{name}_bins AS (SELECT {group}, list({value} ORDER BY {value}) AS xs, count(*) AS n, CAST(ceil(count(*) / {block}) AS BIGINT) AS m
  FROM {source} GROUP BY {group}),
{name}_nodes AS (SELECT {group}, b, n, '{seed}|' || concat_ws('|', {group}) || '|' || b AS text, CAST(0 AS BIGINT) AS i, m AS j, n AS c, m
    FROM {name}_bins, (SELECT unnest(range(1, {n_boot} + 1)) AS b)
  UNION ALL
  SELECT {group}, b, n, text, CASE side WHEN 0 THEN i ELSE mid END, CASE side WHEN 0 THEN mid ELSE j END,
    CASE side WHEN 0 THEN lefts ELSE c - lefts END, m
  FROM (SELECT *, unnest([0, 1]) AS side FROM (SELECT *, CAST(list_reduce(digits, lambda acc, x:
      CASE WHEN acc.u = 0 THEN acc
        WHEN x.one THEN {{'s': acc.s + acc.u - {coins}, 'u': {coins}, 'd': acc.d, 'one': acc.one}}
        ELSE {{'s': acc.s, 'u': acc.u - {coins}, 'd': acc.d, 'one': acc.one}} END,
      {{'s': CAST(0 AS BIGINT), 'u': c, 'd': CAST(0 AS BIGINT), 'one': false}}).s AS BIGINT) AS lefts
    FROM (SELECT *, md5(text || '|' || i || '|' || j) AS h,
        list_transform(list_filter(range(0, 48), lambda k: (left_cells * ((1::BIGINT << k) % size)) % size > 0),
          lambda k: {{'s': CAST(0 AS BIGINT), 'u': CAST(0 AS BIGINT), 'd': k,
            'one': 2 * ((left_cells * ((1::BIGINT << k) % size)) % size) >= size}}) AS digits
      FROM (SELECT *, (i + j) // 2 AS mid, ((i + j) // 2 - i) * {block} AS left_cells, least(n, j * {block}) - i * {block} AS size
        FROM {name}_nodes WHERE j - i > 1))))),
{name}_leaves AS (SELECT {group}, b, i, c, least(n, j * {block}) - i * {block} AS size,
    md5(CASE WHEN m = 1 THEN text ELSE text || '|' || i || '|' || j END) AS h FROM {name}_nodes WHERE j - i = 1),
{name}_drawn AS (SELECT {group}, b, flatten(list(list_transform(range({FIRST}, {FIRST} + c), lambda z:
    xs[1 + i * {block} + ((({polynomial('h', 'z')}) * size) >> 31)]))) AS drawn, any_value(n) AS n
  FROM {name}_leaves JOIN {name}_bins USING ({group}) GROUP BY {group}, b),
{name}_stats AS (SELECT {group}, list_avg(drawn) AS m, list_median(drawn) AS md, n FROM {name}_drawn),
{name} AS (SELECT {group}, avg(m) AS mean_{value}, quantile_cont(m, 0.025) AS mean_{value}_low,
    quantile_cont(m, 0.975) AS mean_{value}_high, avg(md) AS median_{value},
    quantile_cont(md, 0.025) AS median_{value}_low, quantile_cont(md, 0.975) AS median_{value}_high,
    any_value(n) AS n_cells FROM {name}_stats GROUP BY {group})"""


def bootstrap_poisson(name, source, keys, value, row_id, n_boot, seed=SEED) -> str:
    """Every row weighed in every replicate; the median from running weights."""
    group = f"{keys}, bin_id"
    limits = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(13)]
    weight = " + ".join(f"CAST(h >= {x} AS BIGINT)" for x in limits)
    return f"""
{name}_reps AS (SELECT {group}, b, md5('{seed}|' || concat_ws('|', {group}) || '|' || b) AS text
  FROM (SELECT DISTINCT {group} FROM {source}), (SELECT unnest(range(1, {n_boot} + 1)) AS b)),
{name}_low AS (SELECT {group}, b, text, {value} AS x, {row_id} // {PRIME} % {PRIME} AS high,
    {polynomial('text', f'{row_id} % {PRIME}')} AS first FROM {source} JOIN {name}_reps USING ({group})),
{name}_hash AS (SELECT {group}, b, x, {polynomial('text', f'(first + high) % {PRIME}')} AS h FROM {name}_low),
{name}_run AS (SELECT *, sum(w) OVER (PARTITION BY {group}, b ORDER BY x) AS upto, sum(w) OVER (PARTITION BY {group}, b) AS total
  FROM (SELECT {group}, b, x, {weight} AS w FROM {name}_hash)),
{name}_stats AS (SELECT {group}, b, count(*) AS n, sum(w * x) / nullif(sum(w), 0) AS m,
    (min(x) FILTER (upto > (total - 1) // 2) + min(x) FILTER (upto > total // 2)) / 2 AS md FROM {name}_run GROUP BY {group}, b),
{name} AS (SELECT {group}, avg(m) AS mean_{value}, quantile_cont(m, 0.025) AS mean_{value}_low,
    quantile_cont(m, 0.975) AS mean_{value}_high, avg(md) AS median_{value},
    quantile_cont(md, 0.025) AS median_{value}_low, quantile_cont(md, 0.975) AS median_{value}_high,
    any_value(n) AS n_cells FROM {name}_stats GROUP BY {group})"""


def renumber(name, source, number_keys) -> str:
    return f"""
{name} AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY {number_keys} ORDER BY bin_id) AS INTEGER) AS bin_id)
  FROM {source})"""


def booted(name, source, keys, number_keys) -> str:
    """Bootstrap summary with the bins numbered anew, the old numbers and the unit's name."""
    return bootstrap(f"{name}_boot", source, keys) + f""",
{name} AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY {number_keys} ORDER BY bin_id) AS INTEGER) AS bin_id), bin_id AS old_bin,
    experiment || ' #' || {'replicate' if 'replicate' in keys else "'-'"} AS exp_rep FROM {name}_boot)"""


def d(expression: str, name: str | None = None) -> str:
    """A double for the result: digits by size, no negative zero."""
    if name is None and expression in DOUBLE_KEYS:
        return f"round({expression}, 6) + 0.0 AS {expression}"
    digits = (
        "CASE WHEN abs(v) < 1e3 THEN round(v, 6) WHEN abs(v) < 1e6 THEN round(v, 4) "
        "WHEN abs(v) < 1e9 THEN round(v, 2) ELSE round(v, 0) END"
    )
    return f"list_transform([CAST({expression} AS DOUBLE)], lambda v: {digits})[1] + 0.0 AS {name or expression}"


def counts(keys: str, source: str, *columns: str) -> str:
    parts = "".join(
        f", {d(f'sum({c})', f'sum_{c}')}, {d(f'min({c})', f'min_{c}')}, {d(f'max({c})', f'max_{c}')}"
        for c in columns
    )
    shown = ", ".join(d(k) if k in DOUBLE_KEYS else k for k in keys.split(", "))
    return f"SELECT {shown}, count(*) AS n{parts} FROM {source} GROUP BY {keys}"


DOUBLE_KEYS = {"ligand_conc", "tgfb1", "gdf11", "bin_lo", "bin_hi", "signal_threshold", "ha_threshold"}


def cols(keys: str) -> str:
    return ", ".join(d(k) if k in DOUBLE_KEYS else k for k in keys.split(", "))


TRIMMED = CELLS + "," + trim("trimmed", "cells", TRIM_KEYS)
GATED = TRIMMED + "," + gate("gated", "trimmed", UNTREATED, 0.0, 0.1)
BINNED = GATED + "," + bins("binned", "gated", BIN_KEYS, 10)
SINGLE = BINNED + "," + booted("single", "binned", SUMMARY_KEYS, f"{BIN_KEYS}, dox")
PLAIN = BINNED + "," + summary("single", "binned", SUMMARY_KEYS, f"{BIN_KEYS}, dox")
PLUS = SINGLE + ", plus AS (SELECT * FROM single WHERE dox = '+dox')"
TGF = PLUS + ", tgf AS (SELECT * FROM plus WHERE ligand = 'TGFB1')"
DIFFS = TGF + """,
diff_all AS (SELECT *, lead(mean_norm_psmad2) OVER w - mean_norm_psmad2 AS diffs, bin_id + 1 AS diff_id,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY exp_rep, ligand_conc) AS k
  FROM tgf WHERE replicate = 1 WINDOW w AS (PARTITION BY exp_rep, ligand_conc ORDER BY bin_id)),
diff_kept AS (SELECT * FROM diff_all WHERE i < k OR k = 1),
tgf_diffs AS (SELECT * FROM diff_kept WHERE exp_rep IN
  (SELECT exp_rep FROM diff_kept GROUP BY exp_rep HAVING count(DISTINCT ligand_conc) >= 3))"""
RANGES = """,
ranges AS (SELECT experiment, replicate, ligand, ligand_conc, min(mean_norm_psmad2) AS min_signal,
    max(mean_norm_psmad2) AS max_signal, max(mean_norm_psmad2) - min(mean_norm_psmad2) AS range
  FROM {source} WHERE {where} GROUP BY experiment, replicate, ligand, ligand_conc)"""

GRID_TRIM_KEYS = "experiment, cell_line, tgfb1, gdf11"
GRID_CELLS = CELLS + "," + trim("grid_cells", "cells", GRID_TRIM_KEYS)
GRID_GATED = GRID_CELLS + "," + gate(
    "grid_gated", "grid_cells", "dox = '-dox'", 0.0, 0.1, more="AND dox = '+dox'"
)
GRID_BINNED = GRID_GATED + "," + bins("grid_binned", "grid_gated", GRID_KEYS, 10)
GRID = GRID_BINNED + "," + booted("grid", "grid_binned", GRID_SUMMARY, GRID_KEYS)


def min_max(name, source, column) -> str:
    low, high = (f"{f}({column}) OVER (PARTITION BY experiment)" for f in ("min", "max"))
    return f""",
{name} AS (SELECT *, CASE WHEN {high} > {low} THEN ({column} - {low}) / ({high} - {low}) END AS new_norm_psmad2 FROM {source})"""


HEAT = GRID + min_max("heat", "grid", "mean_norm_psmad2")


def metrics(averaged: bool) -> str:
    wx = "tgfb1 IN (1, 3.16)" if averaged else "tgfb1 = 3.16"
    wy = "gdf11 IN (7.9, 25)" if averaged else "gdf11 = 25"
    v = "new_norm_psmad2"
    return HEAT + f""",
metric_parts AS (SELECT experiment, bin_id,
    min({v}) FILTER ((tgfb1 = 0 AND gdf11 = 25) OR (tgfb1 = 3.16 AND gdf11 = 0)) AS a,
    max({v}) FILTER ((tgfb1 = 0 AND {wy}) OR ({wx} AND gdf11 = 0)) AS b,
    min({v}) FILTER ({wx} OR {wy}) AS lo, max({v}) FILTER ({wx} OR {wy}) AS hi,
    min({v}) FILTER (tgfb1 = 3.16 OR gdf11 = 25) AS satmin, max({v}) FILTER (tgfb1 = 3.16 OR gdf11 = 25) AS satmax
  FROM heat GROUP BY experiment, bin_id),
metrics AS (SELECT experiment, bin_id, a, b, a / nullif(b, 0) AS rls, lo / nullif(a, 0) - b / nullif(hi, 0) AS lic,
    satmin, satmax FROM metric_parts)"""


METRIC_COLUMNS = f"experiment, bin_id, {d('a')}, {d('b')}, {d('rls')}, {d('lic')}, {d('satmin')}, {d('satmax')}"

STEPS = metrics(False) + """,
step_all AS (SELECT *, rls - lag(rls) OVER w AS diff_rls, lic - lag(lic) OVER w AS diff_lic,
    CAST(row_number() OVER w - 1 AS INTEGER) AS diff_id
  FROM metrics WINDOW w AS (PARTITION BY experiment ORDER BY bin_id)),
steps AS (SELECT *, sqrt(diff_rls * diff_rls + diff_lic * diff_lic) AS eucl_diff, atan2(diff_rls, diff_lic) AS theta,
    CASE WHEN diff_id < 7 THEN '1' ELSE '2' END AS group_id
  FROM step_all WHERE diff_rls IS NOT NULL AND diff_lic IS NOT NULL)"""

EDGE = HEAT + """,
edge_order(tgfb1, gdf11, edge_idx) AS (VALUES (3.16::DOUBLE, 0::DOUBLE, 1), (3.16, 2.5, 2), (3.16, 7.9, 3),
    (3.16, 25, 4), (1, 25, 5), (0.316, 25, 6), (0, 25, 7)),
edge AS (SELECT * FROM heat JOIN edge_order USING (tgfb1, gdf11))"""


def f_tail(f: str, d1: str, d2: str, points: int = 2000) -> str:
    """P(F > f) as a ratio of Simpson sums of sin^(d1-1) cos^(d2-1)."""

    def area(start: str) -> str:
        step = f"((pi() / 2 - {start}) / {points})"
        return (
            f"list_sum(list_transform(range(0, {points} + 1), lambda i: "
            f"(CASE WHEN i = 0 OR i = {points} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
            f"* pow(sin({start} + i * {step}), {d1} - 1) * pow(greatest(cos({start} + i * {step}), 0), {d2} - 1))) * {step}"
        )

    theta = f"atan(sqrt({d1} * {f} / CAST({d2} AS DOUBLE)))"
    return f"CASE WHEN {d2} > 0 AND {f} IS NOT NULL THEN ({area(theta)}) / ({area('0.0')}) END"


# Student t, 97.5% point, for 1 to 12 degrees of freedom.
T975 = """t975(df, t) AS (VALUES (1, 12.706204736432095), (2, 4.302652729911275), (3, 3.182446305284263),
  (4, 2.7764451051977987), (5, 2.570581835636314), (6, 2.4469118487916806), (7, 2.3646242510102993),
  (8, 2.3060041350333704), (9, 2.2621571627409915), (10, 2.2281388519649385), (11, 2.200985160082949),
  (12, 2.1788128296634177))"""

NAMES = """
names AS (SELECT concat_ws('_', CASE WHEN l_linenumber <= 5 THEN 'R3' ELSE 'Luc' END,
    (['pD', 'mD', 'xx'])[1 + l_orderkey % 3], (['mC', '0.1T', '2.5G', 'zz', '1..2T'])[1 + l_partkey % 5],
    CASE WHEN l_suppkey % 5 < 4 THEN (['1', 'rep2', 'DAPI', '12'])[1 + l_suppkey % 5] END,
    CASE WHEN l_suppkey % 7 = 0 THEN 'DAPI' END) || '.csv' AS file_name FROM lineitem),
parts AS (SELECT file_name, left(file_name, length(file_name) - 4) AS sample,
    string_split(left(file_name, length(file_name) - 4), '_') AS f FROM names)"""


def parsed(name: str, expression: str, double: bool = False) -> str:
    shown = d("v", name) if double else f"v AS {name}"
    return f"WITH {NAMES} SELECT file_name, {shown}, n FROM (SELECT file_name, {expression} AS v, count(*) AS n FROM parts GROUP BY ALL)"


def _dose_text(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


SINGLE_NAME = f"""concat_ws('_', cell_line, CASE dox WHEN '+dox' THEN 'pD' ELSE 'mD' END,
  CASE ligand WHEN 'No Cyto' THEN 'mC' ELSE {_dose_text('ligand_conc')} || ligand[1] END, replicate,
  CASE gate WHEN 'DAPI' THEN 'DAPI' END)"""

ORACLE: dict[str, str] = {}


def add(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = f"WITH {ctes}\n{select}"


# --------------------------------------------------------------------- queries

ORACLE["strip_file_extension"] = parsed("sample", "sample")
ORACLE["gate_labels"] = parsed("gate", "CASE WHEN contains(sample, 'DAPI') THEN 'DAPI' ELSE 'Singlet' END")
add("split_name_fields", NAMES,
    "SELECT file_name, f[1] AS field_0, f[2] AS field_1, f[3] AS field_2, f[4] AS field_3, count(*) AS n FROM parts GROUP BY ALL")
ORACLE["dox_labels"] = parsed("dox", "CASE f[2] WHEN 'pD' THEN '+dox' WHEN 'mD' THEN '-dox' ELSE 'Error' END")
ORACLE["ligand_concentrations"] = parsed(
    "ligand_conc",
    "CASE WHEN f[3] = 'mC' THEN 0 WHEN regexp_full_match(f[3], '[0-9.]+[TG]') "
    "THEN try_cast(left(f[3], length(f[3]) - 1) AS DOUBLE) ELSE -1 END", True)
ORACLE["ligand_labels"] = parsed(
    "ligand",
    "CASE WHEN contains(f[3], 'T') THEN 'TGFB1' WHEN contains(f[3], 'G') THEN 'GDF11' WHEN contains(f[3], 'mC') THEN 'No Cyto' ELSE 'Error' END")
ORACLE["replicate_numbers"] = parsed(
    "replicate", "coalesce(try_cast(nullif(regexp_extract(f[4], '[0-9]+$'), '') AS INTEGER), 1)")
add("legacy_name_fields", RAW, f"""SELECT cell_line || '_' || {_dose_text('ligand_conc')} || CASE ligand WHEN 'GDF11' THEN 'G' ELSE 'T' END AS sample,
  cell_line, CASE ligand WHEN 'GDF11' THEN 'GDF11' ELSE 'TGFB1' END AS ligand, {d('ligand_conc')}, count(*) AS n FROM raw GROUP BY ALL""")
add("two_ligand_name_fields", RAW, f"""SELECT cell_line || '_' || {_dose_text('tgfb1')} || 'T_' || {_dose_text('gdf11')} || 'G' AS sample,
  {d('tgfb1')}, {d('gdf11')}, count(*) AS n FROM raw GROUP BY ALL""")

add("scan_sample_folder", RAW + f", named AS (SELECT * REPLACE ('all' AS experiment), ha AS fsc_a, {SINGLE_NAME} AS sample FROM raw)",
    counts("sample, experiment, cell_line, dox, ligand, ligand_conc, replicate, gate", "named", "fsc_a", "ha", "psmad2", "smad2", "dapi"))
add("scan_experiment_tree", CELLS,
    counts("experiment, cell_line, dox, ligand, ligand_conc, replicate, gate", "cells", "ha", "psmad2", "smad2", "dapi", "norm_psmad2"))
add("scan_by_instrument", RAW + """, named AS (SELECT * REPLACE (CASE ligand WHEN 'GDF11' THEN 'GDF11' ELSE 'TGFB1' END AS ligand),
    CASE WHEN CAST(experiment AS INTEGER) % 2 = 1 THEN '3 Laser Experiments' ELSE '5 Laser Experiments' END AS instrument FROM raw)""",
    counts("instrument, experiment, cell_line, ligand, ligand_conc", "named", "ha", "psmad2", "smad2"))
_TWO = RAW + f""", named AS (SELECT * REPLACE (CASE dox WHEN '-dox' THEN 'R3' ELSE cell_line END AS cell_line,
    CASE dox WHEN '-dox' THEN 0 ELSE tgfb1 END AS tgfb1, CASE dox WHEN '-dox' THEN 0 ELSE gdf11 END AS gdf11),
    CASE dox WHEN '-dox' THEN 'Minus Dox Control' ELSE cell_line || '_' || {_dose_text('tgfb1')} || 'T_' || {_dose_text('gdf11')} || 'G' END AS sample FROM raw)"""
add("scan_two_ligand_tree", _TWO, counts("experiment, sample, cell_line, dox, tgfb1, gdf11", "named", "ha", "psmad2", "smad2", "dapi"))
add("scan_old_two_ligand_tree", _TWO, counts("experiment, sample, cell_line, dox, tgfb1, gdf11", "named", "ha", "psmad2", "smad2"))
add("scan_two_ligand_replicates",
    RAW + f", named AS (SELECT *, cell_line || '_' || {_dose_text('tgfb1')} || 'T_' || {_dose_text('gdf11')} || 'G_' || replicate AS sample FROM raw)",
    counts("experiment, sample, cell_line, tgfb1, gdf11, replicate", "named", "ha", "psmad2", "smad2", "dapi"))
add("channel_selection", RAW, counts("experiment", "raw", "ha", "psmad2", "smad2", "dapi"))
_RANGE_COLUMNS = f"experiment, replicate, ligand, {d('ligand_conc')}, {d('min_signal')}, {d('max_signal')}, {d('range')}"
add("csv_result_round_trip", PLUS + RANGES.format(source="plus", where="true"), f"SELECT {_RANGE_COLUMNS} FROM ranges")

add("log_channels", RAW, f"""SELECT experiment, count(*) FILTER (psmad2 > 3) AS n_logged,
  count(*) FILTER (psmad2 >= 3) AS n_with_zero, {d('sum(CASE WHEN psmad2 > 3 THEN log10(psmad2 - 3) END)', 'total')} FROM raw GROUP BY experiment""")
add("floored_log", RAW + ", logged_rows AS (SELECT experiment, log10(CASE WHEN psmad2 - 3 <= 0 THEN 0.1 ELSE psmad2 - 3 END) AS logged FROM raw)",
    counts("experiment", "logged_rows", "logged"))
add("drop_incomplete_rows", RAW + ", kept AS (SELECT * FROM raw WHERE psmad2 > 5)", counts("experiment, cell_line", "kept", "psmad2"))
add("signal_ratio", CELLS, counts("experiment, ligand, ligand_conc", "cells", "norm_psmad2"))
add("composite_keys", CELLS, f"""SELECT experiment || ' #' || replicate AS exp_rep,
  experiment || ' #' || replicate || 'TGFB1 = ' || {_dose_text('ligand_conc')} || 'ng/ml' AS exp_rep_lig, count(*) AS n FROM cells GROUP BY ALL""")
add("dose_order", CELLS + ", doses AS (SELECT tgfb1, count(*) AS n FROM cells GROUP BY tgfb1)",
    f"""SELECT {_dose_text('tgfb1')} AS dose, {d('tgfb1')}, CAST(row_number() OVER (ORDER BY tgfb1) AS INTEGER) AS place,
  CAST(row_number() OVER (ORDER BY tgfb1 DESC) AS INTEGER) AS place_reversed, n FROM doses""")
add("column_pruning", CELLS, counts("experiment, replicate", "cells", "norm_psmad2"))
add("log_of_results", PLUS + RANGES.format(source="plus", where="true"), f"""SELECT experiment, replicate, ligand, {d('ligand_conc')},
  {d('CASE WHEN range > 0 THEN log10(range) END', 'log_range')}, {d('CASE WHEN ligand_conc > 0 THEN log10(ligand_conc) END', 'log_dose')} FROM ranges""")

add("trim_outliers", TRIMMED, counts(TRIM_KEYS, "trimmed", "psmad2", "ha"))
add("trim_without_dose", CELLS + "," + trim("t", "cells", "experiment, cell_line, ligand"), counts("experiment, cell_line, ligand", "t", "psmad2", "ha"))
add("trim_dose_grid", GRID_CELLS, counts(GRID_TRIM_KEYS, "grid_cells", "psmad2", "ha"))
add("trim_linear_channels", RAW + "," + trim("t", "raw", "experiment, cell_line, ligand, ligand_conc"),
    counts("experiment, cell_line, ligand, ligand_conc", "t", "psmad2", "ha"))
add("gate_on_untreated", GATED, counts("experiment, ligand, ligand_conc, dox", "gated", "norm_psmad2", "ha"))
add("gate_on_uninduced", GRID_GATED, counts(GRID_KEYS, "grid_gated", "norm_psmad2", "ha"))
LUC = "cell_line = 'Luc' AND ligand_conc = 0"
add("gate_on_luc", TRIMMED + "," + gate("g", "trimmed", LUC, 0.25, 0.1, "experiment, replicate"),
    counts("experiment, replicate, ligand, ligand_conc", "g", "norm_psmad2", "ha"))
add("gate_on_raw_signal", TRIMMED + "," + gate("g", "trimmed", LUC, 0.5, 0.1, signal="psmad2"),
    counts("experiment, ligand, ligand_conc", "g", "psmad2", "ha"))
add("thresholds_on_rows", GATED, counts("experiment, signal_threshold, ha_threshold", "gated"))
add("groups_without_control", TRIMMED, f"""SELECT experiment, {d('ligand_conc')} FROM trimmed GROUP BY experiment, ligand_conc
  HAVING count(*) FILTER ({UNTREATED}) = 0""")
add("band_per_experiment", TRIMMED + ", pool AS (SELECT * FROM trimmed WHERE dox = '+dox' AND ligand <> 'GDF11'),"
    + trim("t", "pool", "experiment", ("dapi",), 0.08, 0.70), counts("experiment, ligand_conc", "t", "dapi", "norm_psmad2"))
add("band_per_dose", TRIMMED + "," + trim("t", "trimmed", "experiment, ligand_conc", ("dapi",), 0.08, 0.75),
    counts("experiment, ligand_conc", "t", "dapi", "norm_psmad2"))
add("plain_predicates", SINGLE, f"""SELECT experiment, replicate, {d('ligand_conc')}, bin_id, {d('mean_norm_psmad2')} FROM single
  WHERE dox = '+dox' AND NOT contains(ligand, 'GDF11') AND ligand_conc IN (0, 1) AND bin_id IN (1, 5, 10)""")
add("groups_with_enough_rows", PLUS + RANGES.format(source="plus", where="true"), f"""SELECT {_RANGE_COLUMNS} FROM ranges
  QUALIFY count(*) OVER (PARTITION BY experiment, replicate, ligand) >= 3""")
add("groups_with_enough_doses", PLUS, """SELECT exp_rep, ligand, count(*) AS n FROM plus GROUP BY exp_rep, ligand
  HAVING count(DISTINCT ligand_conc) >= 3""")
add("thin_bins_removed", SINGLE + ", kept AS (SELECT * FROM single WHERE n_cells > 30)," + renumber("r", "kept", f"{BIN_KEYS}, dox"),
    f"SELECT {cols(SUMMARY_KEYS)}, bin_id, n_cells, {d('mean_norm_psmad2')} FROM r")
add("dose_grid_edge", HEAT, f"""SELECT {cols(GRID_KEYS)}, cell_line, bin_id, {d('new_norm_psmad2')} FROM heat
  WHERE tgfb1 = (SELECT max(tgfb1) FROM heat) OR gdf11 = (SELECT max(gdf11) FROM heat)""")

LOG_BINNED = RAW + "," + trim("lin", "raw", "experiment, cell_line, ligand, ligand_conc") + f""",
thr AS (SELECT quantile_cont(psmad2, 0.5) AS ts, quantile_cont(ha, 0.5) AS th FROM lin WHERE {LUC}),
top AS (SELECT max(ha) AS top FROM lin),
log_all AS (SELECT lin.*, ln(th) AS llo, (ln(top) - ln(th)) / 5 AS lstep, th, top FROM lin, thr, top
  WHERE cell_line = 'R3' AND psmad2 > ts),
log_binned AS (SELECT *, CAST(1 + len(list_filter(range(1, 5), lambda k: exp(llo + k * lstep) < ha)) AS INTEGER) AS bin_id
  FROM log_all WHERE ha > th AND ha <= top)"""
add("cells_outside_bins", LOG_BINNED, "SELECT experiment, count(*) AS n, min(bin_id) AS lowest, max(bin_id) AS highest FROM log_binned GROUP BY experiment")
for _name, _where in (("odd_bins", "bin_id % 2 = 1"), ("even_bins", "bin_id % 2 = 0"), ("first_seven_bins", "bin_id < 8")):
    add(_name, metrics(False), f"SELECT {METRIC_COLUMNS} FROM metrics WHERE {_where}")

add("dose_panels", PLUS + """, pool AS (SELECT * FROM plus WHERE ligand <> 'GDF11'),
panels AS (SELECT DISTINCT exp_rep, ligand_conc AS panel_dose FROM pool WHERE ligand_conc <> 0)""",
    f"""SELECT {d('panel_dose')}, exp_rep, {d('ligand_conc')}, bin_id, {d('mean_norm_psmad2')}
  FROM pool JOIN panels USING (exp_rep) WHERE ligand_conc IN (0, panel_dose)""")
add("edge_lookup", EDGE, f"SELECT experiment, edge_idx, {d('tgfb1')}, {d('gdf11')}, bin_id, {d('new_norm_psmad2')} FROM edge")

ORACLE["exact_quantiles"] = f"""SELECT event_type, {d('quantile_cont(value, 0.025)', 'q025')}, {d('quantile_cont(value, 0.25)', 'q250')},
  {d('quantile_cont(value, 0.5)', 'q500')}, {d('quantile_cont(value, 0.975)', 'q975')} FROM events GROUP BY event_type"""
add("bin_ranges", GATED, f"SELECT {cols(BIN_KEYS)}, {d('min(ha)', 'min_ha')}, {d('max(ha)', 'max_ha')} FROM gated GROUP BY {BIN_KEYS}")
add("bin_summary", BINNED, f"""SELECT {cols(SUMMARY_KEYS)}, bin_id, {d('avg(norm_psmad2)', 'mean_norm_psmad2')}, count(*) AS n_cells,
  {d('min(bin_lo)', 'bin_lo')}, {d('min(bin_hi)', 'bin_hi')}, {d('median(norm_psmad2)', 'median_norm_psmad2')} FROM binned GROUP BY {SUMMARY_KEYS}, bin_id""")
GRID_OVERALL = GRID_CELLS + "," + bins("b", "grid_cells", "", 10)
add("grid_bin_means", GRID_OVERALL, f"""SELECT {cols(GRID_KEYS)}, bin_id, {d('avg(norm_psmad2)', 'mean_norm_psmad2')}, count(*) AS n_cells
  FROM b GROUP BY {GRID_KEYS}, bin_id""")


def boot_columns(value: str) -> str:
    return ", ".join(d(f"{s}_{value}{e}") for s in ("mean", "median") for e in ("", "_low", "_high")) + ", n_cells"


add("bootstrap_intervals", BINNED + "," + bootstrap("boot", "binned", SUMMARY_KEYS),
    f"SELECT {cols(SUMMARY_KEYS)}, bin_id, {boot_columns('norm_psmad2')} FROM boot")
add("bootstrap_event_values", bins("b", "events", "event_type", 4, "value").lstrip() + "," + bootstrap("boot", "b", "event_type", "value"),
    f"SELECT event_type, bin_id, {boot_columns('value')} FROM boot")
add("bootstrap_poisson", bins("b", "events", "event_type", 4, "value").lstrip() + ","
    + bootstrap_poisson("boot", "b", "event_type", "value", "event_id", N_TREE), f"SELECT event_type, bin_id, {boot_columns('value')} FROM boot")
ORACLE["sketched_quantiles"] = f"""SELECT event_type, CAST(day(ts) AS INTEGER) AS day, {d('quantile_disc(value, 0.05)', 'low')},
  {d('quantile_disc(value, 0.5)', 'middle')}, {d('quantile_disc(value, 0.95)', 'high')} FROM events GROUP BY event_type, day(ts)"""
add("trim_by_sketches", CELLS.lstrip() + f""",
limits AS (SELECT {TRIM_KEYS}, quantile_disc(ha, 0.05) AS lo_ha, quantile_disc(ha, 0.95) AS hi_ha,
    quantile_disc(psmad2, 0.05) AS lo_p, quantile_disc(psmad2, 0.95) AS hi_p FROM cells GROUP BY ALL),
kept AS (SELECT c.* FROM cells c JOIN limits USING ({TRIM_KEYS}) WHERE ha BETWEEN lo_ha AND hi_ha AND psmad2 BETWEEN lo_p AND hi_p)""",
    counts("experiment, gate", "kept", "ha", "psmad2"))
add("bootstrap_block_tree", "RECURSIVE " + bins("b", "events", "event_type", 2, "value").lstrip() + "," + bootstrap_tree("boot", "b", "event_type", "value", N_TREE, BLOCK),
    f"SELECT event_type, bin_id, {boot_columns('value')} FROM boot")
add("dynamic_range_per_dose", TGF + RANGES.format(source="tgf", where="replicate = 1 AND ligand_conc >= 0.1") + """,
kept AS (SELECT * FROM ranges QUALIFY count(*) OVER (PARTITION BY experiment, replicate, ligand) >= 3)""",
    f"""SELECT {_RANGE_COLUMNS}, {d('range / nullif(max(range) OVER (PARTITION BY experiment, replicate, ligand), 0)', 'norm_range')} FROM kept""")
add("rls_lic", metrics(False), f"SELECT {METRIC_COLUMNS} FROM metrics")
add("rls_lic_averaged_edge", metrics(True), f"SELECT {METRIC_COLUMNS} FROM metrics")
add("range_and_end_change", HEAT, f"""SELECT {cols(GRID_KEYS)}, {d('max(new_norm_psmad2) - min(new_norm_psmad2)', 'minmax')},
  {d('max(new_norm_psmad2) FILTER (bin_id = 10) - max(new_norm_psmad2) FILTER (bin_id = 1)', 'end_change')} FROM heat GROUP BY {GRID_KEYS}""")
add("spread_over_second_dose", HEAT, f"""SELECT experiment, {d('tgfb1')}, bin_id,
  {d('max(mean_norm_psmad2) - min(mean_norm_psmad2)', 'diff_gdf11')} FROM heat GROUP BY experiment, tgfb1, bin_id""")
add("edge_mean_and_sd", EDGE, f"""SELECT bin_id, edge_idx, {d('avg(new_norm_psmad2)', 'mean_signal')}, {d('stddev_samp(new_norm_psmad2)', 'sd_signal')}
  FROM edge GROUP BY bin_id, edge_idx""")


def fits(where: str) -> tuple[str, str]:
    y, x = "mean_norm_psmad2", "bin_id"
    return TGF + f""", {T975},
fits AS (SELECT exp_rep, ligand_conc, count(*) AS n, regr_intercept({y}, {x}) AS intercept, regr_slope({y}, {x}) AS slope,
    regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy FROM tgf WHERE {where} GROUP BY exp_rep, ligand_conc),
halves AS (SELECT fits.*, t * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS half FROM fits LEFT JOIN t975 ON df = n - 2)""", f"""
SELECT exp_rep, {d('ligand_conc')}, n, {d('intercept')}, {d('slope')}, {d('slope - half', 'slope_low')}, {d('slope + half', 'slope_high')}
FROM halves QUALIFY count(*) OVER (PARTITION BY exp_rep) >= 3"""


add("linear_fits", *fits("true"))
add("linear_fits_late_bins", *fits("bin_id >= 3"))


def anova(keys: str) -> tuple[str, str]:
    by = f"GROUP BY {keys}" if keys else ""
    key = f"{keys}, " if keys else ""
    return DIFFS + f""",
sums AS (SELECT {key}CAST(regr_count(diffs, log10(ligand_conc)) AS BIGINT) AS n, regr_sxx(diffs, log10(ligand_conc)) AS sxx,
    regr_syy(diffs, log10(ligand_conc)) AS syy, regr_sxy(diffs, log10(ligand_conc)) AS sxy FROM tgf_diffs {by}),
an AS (SELECT *, 1 AS df_model, n - 2 AS df_residual, sxy * sxy / sxx AS ss_model, syy - sxy * sxy / sxx AS ss_residual FROM sums),
fv AS (SELECT *, ss_model / (ss_residual / df_residual) AS f_value FROM an)""", f"""
SELECT {key}df_model, df_residual, {d('ss_model')}, {d('ss_residual')}, {d('f_value')}, {d(f_tail('f_value', 'df_model', 'df_residual'), 'p_value')} FROM fv"""


add("dose_anova_pooled", *anova(""))
add("dose_anova_per_experiment", *anova("exp_rep"))

_TERMS = f"""SELECT term, CAST(df AS BIGINT) AS df, {d('sum_sq')}, {d('f_value')}, {d(f_tail('f_value', 'df', 'dfr'), 'p_value')} FROM
 (SELECT *, CASE WHEN term <> 'residual' THEN (sum_sq / df) / (ssr / dfr) END AS f_value FROM terms)"""
# Sums of squares from the cell means of the full design and of the additive fit (one factor slope).
add("two_way_anova", STEPS + """,
pts AS (SELECT experiment, eucl_diff AS y, CASE group_id WHEN '2' THEN 1.0 ELSE 0.0 END AS z FROM steps),
per_exp AS (SELECT experiment, avg(y) AS my, avg(z) AS mz, count(DISTINCT z) AS levels FROM pts GROUP BY experiment),
slope AS (SELECT sum((z - mz) * (y - my)) / sum((z - mz) * (z - mz)) AS b FROM pts JOIN per_exp USING (experiment)),
cell AS (SELECT experiment, z, avg(y) AS cy FROM pts GROUP BY experiment, z),
rss AS (SELECT (SELECT sum((y - (SELECT avg(y) FROM pts)) * (y - (SELECT avg(y) FROM pts))) FROM pts) AS r0,
    sum((y - my) * (y - my)) AS r1,
    sum((y - my - b * (z - mz)) * (y - my - b * (z - mz))) AS r2, sum((y - cy) * (y - cy)) AS r3, count(*) AS n,
    (SELECT count(*) FROM per_exp) AS k, (SELECT count(*) FROM per_exp WHERE levels = 2) AS k2
  FROM pts JOIN per_exp USING (experiment) JOIN cell USING (experiment, z), slope),
terms AS (SELECT unnest(['experiment', 'group_id', 'experiment:group_id', 'residual']) AS term,
    unnest([k - 1, 1, k2 - 1, n - k - k2]) AS df, unnest([r0 - r1, r1 - r2, r2 - r3, r3]) AS sum_sq,
    r3 AS ssr, n - k - k2 AS dfr FROM rss)""", _TERMS)
add("range_ancova", TGF + RANGES.format(source="tgf", where="replicate = 1") + """,
pts AS (SELECT experiment, range AS y, log10(ligand_conc) AS x FROM ranges),
per_exp AS (SELECT experiment, avg(y) AS my, avg(x) AS mx FROM pts GROUP BY experiment),
slope AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM pts JOIN per_exp USING (experiment)),
pooled AS (SELECT regr_slope(y, x) AS b0, regr_intercept(y, x) AS a0 FROM pts),
rss AS (SELECT sum((y - my) * (y - my)) AS without_x, sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS full_rss,
    sum((y - a0 - b0 * x) * (y - a0 - b0 * x)) AS without_factor, count(*) AS n, (SELECT count(*) FROM per_exp) AS k
  FROM pts JOIN per_exp USING (experiment), slope, pooled),
terms AS (SELECT unnest(['experiment', 'covariate', 'residual']) AS term, unnest([k - 1, 1, n - k - 1]) AS df,
    unnest([without_factor - full_rss, without_x - full_rss, full_rss]) AS sum_sq, full_rss AS ssr, n - k - 1 AS dfr FROM rss)""", _TERMS)
# Exact p by going through every way to choose the ranks of group 1.
add("rank_sum_test", STEPS + """,
ranked AS (SELECT experiment, group_id, rank() OVER (PARTITION BY experiment ORDER BY eucl_diff) AS r FROM steps),
sums AS (SELECT experiment, count(*) FILTER (group_id = '1') AS n1, count(*) FILTER (group_id = '2') AS n2,
    coalesce(sum(r) FILTER (group_id = '1'), 0) AS rs FROM ranked GROUP BY experiment),
ws AS (SELECT *, rs - n1 * (n1 + 1) / 2.0 AS w FROM sums),
ways AS (SELECT experiment, n1, n2, w, mask,
    list_sum(list_transform(range(0, n1 + n2), lambda i: ((mask >> i) & 1) * (i + 1))) - n1 * (n1 + 1) / 2.0 AS wm
  FROM (SELECT *, unnest(range(0, CAST(1 << (n1 + n2) AS BIGINT))) AS mask FROM ws) WHERE bit_count(mask) = n1)""",
    f"""SELECT experiment, n1, n2, {d('w')}, {d('''CASE WHEN n1 > 0 AND n2 > 0 THEN least(1.0, 2.0 * CASE WHEN w > n1 * n2 / 2.0
    THEN count(*) FILTER (wm >= w) ELSE count(*) FILTER (wm <= w) END / count(*)) END''', 'p_value')} FROM ways GROUP BY experiment, n1, n2, w""")
# Normal tail by Simpson's rule out to 12 standard deviations.
add("rank_sum_of_cells", GATED + """,
ranked AS (SELECT experiment, dox, rank() OVER w + (count(*) OVER (PARTITION BY experiment, norm_psmad2) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY experiment, norm_psmad2) AS t FROM gated WINDOW w AS (PARTITION BY experiment ORDER BY norm_psmad2)),
sums AS (SELECT experiment, count(*) FILTER (dox = '+dox') AS n1, count(*) FILTER (dox = '-dox') AS n2,
    sum(r) FILTER (dox = '+dox') AS rs, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM ranked GROUP BY experiment),
ws AS (SELECT *, rs - n1 * (n1 + 1) / 2.0 AS w FROM sums),
zs AS (SELECT *, (abs(w - n1 * n2 / 2.0) - CASE WHEN w = n1 * n2 / 2.0 THEN 0 ELSE 0.5 END)
    / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS z FROM ws)""",
    f"""SELECT experiment, n1, n2, {d('w')}, {d('''least(1.0, 2 * list_sum(list_transform(range(0, 4001), lambda i:
    (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z + i * 12.0 / 4000, 2) / 2)))
    * (12.0 / 4000) / 3 / sqrt(2 * pi()))''', 'p_value')} FROM zs""")
add("lowest_gated_value", GATED, f"SELECT experiment, {d('min(ha)', 'min_ha')} FROM gated GROUP BY experiment")


def cell_of(column: str, bins_: int) -> str:
    return (f"CAST(least(greatest(ceil(({column} - min({column}) OVER ()) / "
            f"((max({column}) OVER () - min({column}) OVER ()) / {bins_})), 1), {bins_}) AS INTEGER)")


def hist(source: str, column: str, facets: str, n: int) -> str:
    keys = f"{facets}, " if facets else ""
    return f"SELECT {keys}cell, count(*) AS n FROM (SELECT *, {cell_of(column, n)} AS cell FROM {source}) GROUP BY {keys}cell"


def hist2(source: str, x: str, y: str, facets: str, n: int) -> str:
    return f"""SELECT {cols(facets)}, cell_x, cell_y, count(*) AS n FROM
  (SELECT *, {cell_of(x, n)} AS cell_x, {cell_of(y, n)} AS cell_y FROM {source}) GROUP BY {facets}, cell_x, cell_y"""


add("histogram", TRIMMED, hist("trimmed", "dapi", "cell_line, dox", 30))
add("histogram_of_bin_sizes", SINGLE + ", sizes AS (SELECT log10(n_cells) AS log_n FROM single)", hist("sizes", "log_n", "", 30))
add("histogram_2d", TRIMMED, hist2("trimmed", "ha", "norm_psmad2", "cell_line, ligand_conc", 128))
add("histogram_2d_per_sample", TRIMMED, hist2("trimmed", "ha", "psmad2", "experiment, dox", 100))
add("violin_density", DIFFS + """,
v AS (SELECT ligand_conc, diffs AS y FROM tgf_diffs WHERE diffs IS NOT NULL),
b0 AS (SELECT ligand_conc, count(*) AS n, stddev_samp(y) AS sd, (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34 AS iqr,
    min(y) AS y0, max(y) AS y1, median(y) AS median FROM v GROUP BY ligand_conc),
b1 AS (SELECT *, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr) ELSE sd END * pow(n, -0.2) AS bw FROM b0),
b2 AS (SELECT *, y0 - 3 * bw AS x0, y1 + 3 * bw AS x1 FROM b1 WHERE bw > 0),
b3 AS (SELECT *, x0 - 4 * bw AS lo, (x1 + 4 * bw - (x0 - 4 * bw)) / 511 AS step FROM b2),
put AS (SELECT ligand_conc, floor((y - lo) / step) AS node, (y - lo) / step - floor((y - lo) / step) AS part FROM v JOIN b3 USING (ligand_conc)),
mass AS (SELECT ligand_conc, node, sum(w) AS w FROM
  (SELECT ligand_conc, node, 1 - part AS w FROM put UNION ALL SELECT ligand_conc, node + 1, part FROM put) GROUP BY ligand_conc, node),
dens AS (SELECT ligand_conc, k, sum(w * exp(-0.5 * pow((k - node) * step / bw, 2))) / (any_value(bw) * any_value(n) * sqrt(2 * pi())) AS dk
  FROM b3 JOIN mass USING (ligand_conc), (SELECT unnest(range(0, 512)) AS k) GROUP BY ligand_conc, k),
grid_x AS (SELECT *, x0 + point * (x1 - x0) / 511 AS x FROM b3, (SELECT CAST(unnest(range(0, 512)) AS INTEGER) AS point)),
placed AS (SELECT *, (x - lo) / step AS pos, least(CAST(floor((x - lo) / step) AS INTEGER), 510) AS low FROM grid_x)""",
    f"""SELECT {d('ligand_conc')}, n, {d('bw')}, {d('median')}, point, {d('x')}, {d('d0.dk + (d1.dk - d0.dk) * (pos - low)', 'density')}
  FROM placed JOIN dens d0 ON d0.ligand_conc = placed.ligand_conc AND d0.k = low JOIN dens d1 ON d1.ligand_conc = placed.ligand_conc AND d1.k = low + 1""".replace(
        d("ligand_conc"), "round(placed.ligand_conc, 6) + 0.0 AS ligand_conc"))
add("distinct_units", SINGLE, f"SELECT DISTINCT exp_rep, {d('ligand_conc')} FROM single")
add("profile_distances", PLUS + ", p AS (SELECT exp_rep, bin_id, mean_norm_psmad2 AS v FROM plus WHERE ligand_conc = 0)",
    f"""SELECT a.exp_rep AS row_a, b.exp_rep AS row_b,
  {d('sqrt(sum(pow(a.v - b.v, 2)) * (SELECT count(DISTINCT bin_id) FROM p) / count(*))', 'distance')}
  FROM p a JOIN p b ON a.bin_id = b.bin_id AND a.exp_rep < b.exp_rep GROUP BY a.exp_rep, b.exp_rep""")

_EDGES = PLAIN + f", bin_edges AS (SELECT DISTINCT {BIN_KEYS}, bin_id AS old_bin, bin_lo, bin_hi FROM binned)"
add("renumbered_bins", _EDGES, f"""SELECT {cols(SUMMARY_KEYS)}, bin_id, {d('bin_lo')}, {d('bin_hi')}, n_cells
  FROM single JOIN bin_edges USING ({BIN_KEYS}, old_bin)""")
ORACLE["equal_count_bins"] = f"""SELECT event_type, bin_id, count(*) AS n, {d('min(value)', 'lowest')}, {d('max(value)', 'highest')},
  CAST(sum(event_id) AS BIGINT) AS sum_id FROM (SELECT *, CAST(ntile(10) OVER (PARTITION BY event_type ORDER BY value, event_id) AS INTEGER) AS bin_id FROM events)
  GROUP BY event_type, bin_id"""
add("equal_width_bins", BINNED, counts(f"{BIN_KEYS}, bin_id, bin_lo, bin_hi", "binned", "ha"))
add("equal_width_bins_overall", GRID_OVERALL, counts("experiment, bin_id, bin_lo, bin_hi", "b", "ha"))
add("equal_width_bins_per_sample", GATED + """, s AS (SELECT *, concat_ws('_', cell_line, dox, replicate, gate) AS sample FROM gated),"""
    + bins("b", "s", "experiment, sample, ligand", 20), counts("experiment, sample, ligand, bin_id", "b", "ha"))
add("log_spaced_bins", LOG_BINNED, f"""SELECT cell_line, {d('ligand_conc')}, bin_id, {d('avg(psmad2)', 'mean_psmad2')}, count(*) AS n_cells,
  {d('exp(min(llo) + (bin_id - 1) * min(lstep))', 'bin_lo')}, {d('exp(min(llo) + bin_id * min(lstep))', 'bin_hi')},
  {d('median(psmad2)', 'median_psmad2')} FROM log_binned GROUP BY cell_line, ligand_conc, bin_id""")
add("forward_differences", DIFFS, f"""SELECT experiment, ligand, {d('ligand_conc')}, bin_id, diff_id, {d('mean_norm_psmad2')}, {d('diffs')} FROM tgf_diffs""")
add("metric_steps", STEPS, f"""SELECT experiment, bin_id, {d('diff_rls')}, {d('diff_lic')}, diff_id, {d('eucl_diff')}, {d('theta')}, group_id FROM steps""")
add("min_max_scaled", HEAT, f"SELECT {cols(GRID_SUMMARY)}, bin_id, {d('new_norm_psmad2')} FROM heat")
add("min_max_scaled_median_inner_grid", GRID + ", inner_grid AS (SELECT * FROM grid WHERE tgfb1 > 0 AND gdf11 > 0)"
    + min_max("m", "inner_grid", "median_norm_psmad2"), f"SELECT {cols(GRID_KEYS)}, bin_id, {d('new_norm_psmad2')} FROM m")

_ANCHOR_KEYS = "experiment, replicate, ligand_conc"
_ANCHOR = GATED + ", induced AS (SELECT * FROM gated WHERE dox = '+dox')," + bins("b", "induced", _ANCHOR_KEYS, 10) + "," + bootstrap(
    "boot", "b", f"{_ANCHOR_KEYS}, cell_line, dox") + "," + renumber("r", "boot", f"{_ANCHOR_KEYS}, dox")
_CTRL = "max(CASE WHEN ligand_conc = 0 AND bin_id = 1 THEN {s}_norm_psmad2 END) OVER (PARTITION BY experiment, replicate)"
_TOP = "max({s}_norm_psmad2) OVER (PARTITION BY experiment, replicate)"


def _anchored(s: str, e: str) -> str:
    c, t = _CTRL.format(s=s), _TOP.format(s=s)
    return d(f"({s}_norm_psmad2{e} - {c}) / nullif({t} - {c}, 0)", f"norm_{s}{e}")


add("control_anchored_scale", _ANCHOR, f"""SELECT experiment, replicate, {d('ligand_conc')}, bin_id, {d(_CTRL.format(s='mean'), 'control_mean')},
  {', '.join(_anchored(s, e) for s in ('mean', 'median') for e in ('', '_low', '_high'))} FROM r""")
add("mean_centred_profiles", PLUS, f"""SELECT exp_rep, bin_id, {d('mean_norm_psmad2 - avg(mean_norm_psmad2) OVER (PARTITION BY exp_rep)', 'centred')}
  FROM plus WHERE ligand_conc = 0""")


def z(column: str, keys: str) -> str:
    return f"({column} - avg({column}) OVER (PARTITION BY {keys})) / nullif(stddev_samp({column}) OVER (PARTITION BY {keys}), 0)"


add("z_scored_profiles", SINGLE, f"""SELECT exp_rep, ligand, {d('ligand_conc')}, dox, bin_id, {d(z('mean_norm_psmad2', 'exp_rep'), 'z_score')},
  {d('mean_norm_psmad2 - avg(mean_norm_psmad2) OVER (PARTITION BY exp_rep)', 'centred')} FROM single""")
add("z_scored_diffs", DIFFS, f"""SELECT exp_rep, {d('ligand_conc')}, bin_id, {d(z('diffs', 'exp_rep, ligand_conc'), 'z_score_diffs')},
  {d('diffs - avg(diffs) OVER (PARTITION BY exp_rep, ligand_conc)', 'norm_diffs')} FROM tgf_diffs""")
_BASE = PLUS + ", base AS (SELECT exp_rep, bin_id, mean_norm_psmad2 AS v FROM plus WHERE ligand_conc = 0)"
add("row_scaled_matrix", _BASE + f""", scaled AS (SELECT exp_rep, bin_id, {z('v', 'exp_rep')} AS zv FROM base
    WHERE bin_id > 1 AND bin_id < (SELECT max(bin_id) FROM base))""",
    "SELECT exp_rep, " + ", ".join(d(f"max(zv) FILTER (bin_id = {b})", f"bin_{b}") for b in range(2, 10)) + " FROM scaled GROUP BY exp_rep")
add("scaled_by_largest_range", PLUS + RANGES.format(source="plus", where="ligand <> 'TGFB1' AND ligand_conc > 0"),
    f"SELECT {_RANGE_COLUMNS}, {d('range / nullif(max(range) OVER (PARTITION BY experiment), 0)', 'norm_range')} FROM ranges")
_STEP = "(x / 400)"
_AREA = (f"({_STEP} / 3 * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
    f"* exp(-0.5 * pow(i * {_STEP}, 2)))))")
# Newton's steps from 0 on the area under the bell curve by Simpson's rule.
_NORMAL_QUANTILE = f"list_reduce(list_prepend(0.0, list_transform(range(0, 40), lambda k: 0.0)), lambda x, k: x - ({_AREA} - (p - 0.5) * sqrt(2 * pi())) * exp(0.5 * x * x))"
add("qq_points", DIFFS + """,
r AS (SELECT exp_rep, ligand_conc, diffs AS sample, row_number() OVER (PARTITION BY exp_rep, ligand_conc ORDER BY diffs) AS point,
    count(*) OVER (PARTITION BY exp_rep, ligand_conc) AS n FROM tgf_diffs WHERE diffs IS NOT NULL),
q AS (SELECT *, CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END AS a FROM r)""",
    f"SELECT exp_rep, {d('ligand_conc')}, CAST(point AS INTEGER) AS point, {d('sample')}, {d('p', 'position')}, {d(_NORMAL_QUANTILE, 'theoretical')} "
    "FROM (SELECT *, (point - a) / (n + 1 - 2 * a) AS p FROM q)")
add("qq_line", DIFFS, f"""SELECT exp_rep, {d('ligand_conc')},
  {d('(quantile_cont(diffs, 0.75) - quantile_cont(diffs, 0.25)) / (2 * 0.6744897501960817)', 'slope')},
  {d('(quantile_cont(diffs, 0.75) + quantile_cont(diffs, 0.25)) / 2', 'intercept')} FROM tgf_diffs WHERE diffs IS NOT NULL GROUP BY exp_rep, ligand_conc""")

add("sorted_edge", EDGE, f"SELECT experiment, edge_idx, bin_id, {d('new_norm_psmad2')} FROM edge ORDER BY experiment, edge_idx, bin_id")
add("all_but_last_bin", PLUS + """,
dd AS (SELECT *, lead(mean_norm_psmad2) OVER w - mean_norm_psmad2 AS diffs, row_number() OVER w AS i,
    count(*) OVER (PARTITION BY exp_rep, ligand, ligand_conc) AS k
  FROM plus WINDOW w AS (PARTITION BY exp_rep, ligand, ligand_conc ORDER BY bin_id))""",
    f"""SELECT exp_rep, ligand, {d('ligand_conc')}, count(*) AS n, max(bin_id) AS last_bin, {d('sum(diffs)', 'total')} FROM dd
  WHERE i < k OR k = 1 GROUP BY exp_rep, ligand, ligand_conc""")
add("range_preview", TGF + RANGES.format(source="tgf", where="true"),
    f"SELECT {_RANGE_COLUMNS} FROM ranges ORDER BY ranges.experiment, ranges.replicate, ranges.ligand, ranges.ligand_conc LIMIT 6")


def analysed(
    source_ctes, source, control, gate_keys, bin_keys, summary_keys, number_keys, n=10, qs=0.0, qh=0.1, binned_by=None, boot=False
) -> str:
    cte = source_ctes + "," + gate("ag", source, control, qs, qh, gate_keys) + ","
    cte += binned_by("ab", "ag") if binned_by else bins("ab", "ag", bin_keys, n)
    if boot:
        return cte + "," + booted("ax", "ab", summary_keys, number_keys)
    return cte + "," + summary("ax", "ab", summary_keys, number_keys)


def ntile_bins(keys: str, n: int = 10):
    def cte(name: str, source: str) -> str:
        return f"""
{name} AS (SELECT *, CAST(ntile({n}) OVER (PARTITION BY {keys} ORDER BY ha, cell_id) AS INTEGER) AS bin_id FROM {source})"""
    return cte


def result(keys: str, *extra: str) -> str:
    shown = ", ".join(d(e) if e.startswith(("mean", "median")) else e for e in extra)
    return f"SELECT {cols(keys)}, bin_id, {shown} FROM ax"


_ALL = ("mean_norm_psmad2", "median_norm_psmad2", "n_cells")
_SIX = (*[f"{s}_norm_psmad2{e}" for s in ("mean", "median") for e in ("", "_low", "_high")], "n_cells")
_GATED_KEYS = [f"gate, {k}" for k in ("experiment", BIN_KEYS, SUMMARY_KEYS, f"{BIN_KEYS}, dox")]
_BY_GATE = analysed(TRIMMED, "trimmed", UNTREATED, *_GATED_KEYS, boot=True)
add("stacked_gates", _BY_GATE, result(f"gate, {SUMMARY_KEYS}", "mean_norm_psmad2", "n_cells"))
add("wide_profiles", _BASE,
    "SELECT exp_rep, " + ", ".join(d(f"max(v) FILTER (bin_id = {b})", f"bin_{b}") for b in range(1, 11)) + " FROM base GROUP BY exp_rep")
add("single_ligand_analysis", BINNED + "," + bootstrap("boot", "binned", SUMMARY_KEYS) + "," + renumber("r", "boot", f"{BIN_KEYS}, dox"),
    f"SELECT {cols(SUMMARY_KEYS)}, bin_id, {boot_columns('norm_psmad2')} FROM r")
add("decile_analysis", analysed(TRIMMED, "trimmed", UNTREATED, "experiment", BIN_KEYS, SUMMARY_KEYS, f"{BIN_KEYS}, dox",
    binned_by=ntile_bins(BIN_KEYS), boot=True), result(SUMMARY_KEYS, *_SIX))
add("two_ligand_analysis", GRID_BINNED + "," + bootstrap("boot", "grid_binned", GRID_SUMMARY) + "," + renumber("r", "boot", GRID_KEYS),
    f"SELECT {cols(GRID_SUMMARY)}, bin_id, {boot_columns('norm_psmad2')} FROM r")
_REP = f"{GRID_KEYS}, replicate"
add("two_ligand_decile_analysis", analysed(GRID_CELLS, "grid_cells", "dox = '-dox'", "experiment", _REP, f"{GRID_SUMMARY}, replicate",
    f"{_REP}, dox", binned_by=ntile_bins(_REP), boot=True), result(f"{GRID_SUMMARY}, replicate", *_SIX))
add("one_experiment_analysis", GATED + "," + bins("b", "gated", "experiment", 5), f"""SELECT experiment, cell_line, ligand, {d('ligand_conc')}, bin_id,
  {d('avg(norm_psmad2)', 'mean_norm_psmad2')}, count(*) AS n_cells, {d('median(norm_psmad2)', 'median_norm_psmad2')},
  {d('min(bin_lo)', 'bin_lo')}, {d('min(bin_hi)', 'bin_hi')} FROM b GROUP BY experiment, cell_line, ligand, ligand_conc, bin_id""")
add("one_experiment_bootstrap", analysed(TRIMMED, "trimmed", UNTREATED, "experiment", "experiment", SUMMARY_KEYS, SUMMARY_KEYS, n=5, boot=True),
    result(SUMMARY_KEYS, *_SIX))
add("one_experiment_density_of_all", TRIMMED, hist2("trimmed", "ha", "norm_psmad2", "experiment, cell_line, ligand_conc", 128))
add("one_experiment_density", GATED, hist2("gated", "ha", "norm_psmad2", "experiment, cell_line, ligand_conc", 128))

_SWEEP_KEYS = "q_signal, q_ha, n_bins"
add("parameter_sweep", TRIMMED + f""",
grid_q AS (SELECT * FROM (SELECT unnest([0.9, 0.5, 0.0]::DOUBLE[]) AS q_signal), (SELECT 0.1::DOUBLE AS q_ha), (SELECT unnest([5, 8, 10, 20]) AS n_bins)),
sweep_limits AS (SELECT experiment, quantile_cont(norm_psmad2, [0.9, 0.5, 0.0]) AS qs, quantile_cont(ha, 0.1) AS qh
  FROM trimmed WHERE {LUC} GROUP BY experiment),
swept AS (SELECT t.*, g.* FROM trimmed t JOIN sweep_limits USING (experiment), grid_q g WHERE cell_line = 'R3' AND ha > qh
  AND norm_psmad2 > CASE q_signal WHEN 0.9 THEN qs[1] WHEN 0.5 THEN qs[2] ELSE qs[3] END),""" + bins("ab", "swept", f"{_SWEEP_KEYS}, {BIN_KEYS}", "n_bins").replace(
        "len(list_filter(range(1, CAST(n_bins AS BIGINT))", "len(list_filter(range(1, CAST(n_bins AS BIGINT))") + ","
    + bootstrap("boot", "ab", f"{_SWEEP_KEYS}, {SUMMARY_KEYS}") + "," + renumber("ax", "boot", f"{_SWEEP_KEYS}, {BIN_KEYS}, dox"),
    f"""SELECT 'pSMAD2_' || CAST(q_signal AS VARCHAR) || '_HA_' || CAST(q_ha AS VARCHAR) || '_bins_' || n_bins AS param_combo,
  {cols(SUMMARY_KEYS)}, bin_id, {d('bin_id / n_bins', 'relative_bin')}, {boot_columns('norm_psmad2')} FROM ax""")
add("gate_comparison", analysed(TRIMMED, "trimmed", UNTREATED, *_GATED_KEYS, boot=True), result(f"gate, {SUMMARY_KEYS}", *_SIX))
add("rebinned_after_band", analysed(TRIMMED + "," + trim("band", "trimmed", "experiment, ligand_conc", ("dapi",), 0.08, 0.75), "band", UNTREATED,
    "experiment", BIN_KEYS, SUMMARY_KEYS, f"{BIN_KEYS}, dox", qh=0.5, boot=True), result(SUMMARY_KEYS, *_SIX))
_LEGACY = "experiment, ligand, cell_line, ligand_conc"
add("grouped_legacy_analysis", analysed(TRIMMED, "trimmed", "cell_line = 'Luc'", "experiment, ligand", "experiment, ligand", _LEGACY,
    "experiment, ligand, ligand_conc", n=8, qs=0.75), result(_LEGACY, *_ALL))
add("grouped_legacy_intervals", analysed(TRIMMED, "trimmed", "cell_line = 'Luc'", "experiment, ligand", "experiment, ligand", _LEGACY,
    "experiment, ligand, ligand_conc", n=8, qs=0.75, boot=True), result(_LEGACY, *_SIX))
add("minimum_slice", _EDGES, f"""SELECT {cols(SUMMARY_KEYS)}, bin_id, {d('bin_lo')}, {d('bin_hi')}, {d('mean_norm_psmad2')},
  {d('median_norm_psmad2')}, n_cells FROM single JOIN bin_edges USING ({BIN_KEYS}, old_bin)""")
ORACLE["tree_to_bootstrapped_bins"] = ORACLE["single_ligand_analysis"]
ORACLE["heat_map_round_trip"] = ORACLE["rls_lic"]
add("wide_profiles_of_20_bins", analysed(TRIMMED, "trimmed", UNTREATED, "experiment", BIN_KEYS, SUMMARY_KEYS, f"{BIN_KEYS}, dox", n=20, boot=True),
    "SELECT exp_rep, " + ", ".join(d(f"max(mean_norm_psmad2) FILTER (bin_id = {b})", f"bin_{b}") for b in range(1, 21))
    + " FROM ax WHERE dox = '+dox' AND ligand_conc = 0 GROUP BY exp_rep")
add("legacy_analysis", analysed(TRIMMED + """,
legacy AS (SELECT * REPLACE (CASE ligand WHEN 'No Cyto' THEN 'TGFB1' ELSE ligand END AS ligand) FROM trimmed)""", "legacy", LUC,
    "experiment, ligand", "experiment, ligand", _LEGACY, "experiment, ligand, ligand_conc", n=8, qs=0.75, boot=True), result(_LEGACY, *_SIX))
_PLAIN = CELLS + """,
plain AS (SELECT *, concat_ws('_', cell_line, CASE dox WHEN '+dox' THEN 'pD' ELSE 'mD' END, 'mC', replicate) AS sample FROM cells WHERE ligand = 'No Cyto')"""
add("no_ligand_scan", _PLAIN, counts("sample, experiment, cell_line, dox, ligand, replicate", "plain", "ha", "psmad2", "smad2", "norm_psmad2"))
_SAMPLE = "experiment, sample, ligand"
add("no_ligand_analysis", analysed(_PLAIN + "," + trim("t", "plain", "experiment, cell_line, ligand"), "t", UNTREATED, "experiment",
    _SAMPLE, f"{_SAMPLE}, cell_line, dox", "experiment, sample, dox", n=20, boot=True), result(f"{_SAMPLE}, cell_line, dox", *_SIX))
for _name in ("two_way_anova", "range_ancova"):
    ORACLE[f"{_name}_by_gram"] = ORACLE[_name]


def described(keys: str) -> str:
    return f"""SELECT {cols(keys)}, bin_id, count(*) AS n, {d('avg(norm_psmad2)', 'mean')}, {d('stddev_samp(norm_psmad2)', 'sd')},
  {d('min(norm_psmad2)', 'least')}, {d('max(norm_psmad2)', 'most')}, {d('quantile_disc(norm_psmad2, 0.5)', 'median')}
  FROM binned GROUP BY {keys}, bin_id"""


add("summaries_with_one_more_experiment", BINNED, described(SUMMARY_KEYS))
add("summaries_merged_over_experiments", BINNED, described("cell_line, dox, ligand, ligand_conc"))
ORACLE["violin_density_fine"] = ORACLE["violin_density"].replace("511", "8191").replace("range(0, 512)", "range(0, 8192)").replace("510)", "8190)")
