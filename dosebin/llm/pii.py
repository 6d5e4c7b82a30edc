"""Personal data by patterns and a skip-chain conditional random field.

The base patterns are searched first and their spans always stay.  The field then labels
the tokens that hold a digit or an at sign (all others are outside of any entity, which cuts the
chain).  Neighbouring tokens share transition potentials; distant tokens of a document
that are equal, end in the same digits or have the same mailbox share skip potentials, from one
occurrence to the next.  Loopy message passing makes their labels agree; tokens whose
label then is sure enough add spans, such as a number written again without its prefix.
Weights are learned by pseudo-likelihood from the base spans of a bounded sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OUT = len(KINDS)
SAMPLE_DOCS = 4000
BITS = 12
SURE = 0.9
MOST_DIGITS = 19
# Base patterns: fixed values.  Possessive repeats match the same and never look back.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]")
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._%+-()")
EDGE = "._%-()"
SPAN = "struct<kind:string,start:int,stop:int,base:boolean>"
Span = tuple[int, int, int]  # kind, start, stop


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    found: list[Span] = []
    upto = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            upto = m.end()
        at = text.find("@", max(at + 1, upto))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40:  # 19 digits and their separators are fewer
            digits = _only_digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((3, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of token characters that hold a digit or an at sign, without marks at their ends."""
    found, upto = [], 0
    for m in SIGN.finditer(text):
        if m.start() < upto:
            continue
        start, stop = m.start(), m.end()
        while start > upto and text[start - 1] in TOKEN:
            start -= 1
        while stop < len(text) and text[stop] in TOKEN:
            stop += 1
        upto = stop
        while text[start] in EDGE:
            start += 1
        while text[stop - 1] in EDGE:
            stop -= 1
        found.append((start, stop))
    return found


def _shape(token: str) -> str:
    """Digits as 9 with their number, letters as a, marks as they are."""
    return re.sub(r"9+", lambda m: f"9{min(20, len(m[0]))}", re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", token)))


def _features(text: str, start: int, stop: int) -> list[int]:
    token, digits = text[start:stop], _only_digits(text[start:stop])
    before, after = text[max(0, start - 2) : start], text[stop : stop + 2]
    parts = token.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts if p.isascii())
    valid = f"{octets}{14 <= len(digits) <= 19 and luhn(digits)}{'@' in token}"
    named = [
        "bias",
        "shape " + _shape(token),
        "valid " + valid,
        f"digits {len(digits)} {valid}",
        f"parts {len(parts)} {valid}",
        "before " + re.sub(r"\w", "a", before),
        "after " + re.sub(r"\w", "a", after),
        f"plus {token[:1] == '+' or before[-1:] == '+'} {len(digits)}",
    ]
    return [zlib.crc32(n.encode()) >> (32 - BITS) for n in named]


class Graph(NamedTuple):
    """Tokens of a document with their base label (OUT if none), features and links."""

    spans: list[tuple[int, int]]
    labels: list[int]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(text: str, base: list[Span]) -> Graph:
    spans = tokens(text)
    labels, features, chain, skip, k = [], [], [], [], 0
    seen: dict[str, int] = {}
    run = ""  # the last digits of the chain that a token ends, so that a number in groups is known by its joined digits
    by_start = sorted(base, key=lambda s: s[1])
    for i, (a, b) in enumerate(spans):
        while k < len(by_start) and by_start[k][2] <= a:
            k += 1
        over = [s[0] for s in by_start[k : k + 8] if s[1] < b and s[2] > a]
        labels.append(over[0] if over else OUT)
        features.append(_features(text, a, b))
        token = text[a:b].lower()
        digits = _only_digits(token)
        if i and a - spans[i - 1][1] <= 2 and not any(c.isalnum() for c in text[spans[i - 1][1] : a]):
            chain.append((i - 1, i))
            run += digits
        else:
            run = digits
        run = run[-MOST_DIGITS:]
        keys = ["=" + token] + ["@" + token.split("@")[0]] * ("@" in token)
        keys += sorted({f"# {d[-7:]}" for d in (run, digits) if len(d) >= 7})
        tied = set()
        for key in keys:
            j = seen.get(key)
            if j is not None and j not in tied:
                tied.add(j)
                skip.append((j, i))
            seen[key] = i
    return Graph(spans, labels, features, chain, skip)


class Model(NamedTuple):
    node: np.ndarray  # features x labels
    chain: np.ndarray  # label x next label
    skip: float


def fit(graphs: list[Graph], rounds: int = 200, rate: float = 0.3, penalty: float = 1e-3, seed: int = 1) -> Model:
    """Weights by pseudo-likelihood: each token's label given its neighbours' base labels.

    In each round some features are left out, and all those of some tokens, so that the
    links learn to carry what a token alone doesn't show.
    """
    random = np.random.default_rng(seed)
    n_labels = OUT + 1
    node, chain, skip = np.zeros((1 << BITS, n_labels)), np.zeros((n_labels, n_labels)), 0.0
    node[zlib.crc32(b"bias") >> (32 - BITS), OUT] = 3.0
    graphs = [g for g in graphs if g.spans]
    if not graphs:
        return Model(node, chain, skip)
    at = np.cumsum([0] + [len(g.spans) for g in graphs])
    y = np.concatenate([g.labels for g in graphs]).astype(int)
    x = np.concatenate([np.array(g.features) for g in graphs])
    c = np.array([(a + o, b + o) for g, o in zip(graphs, at) for a, b in g.chain], int).reshape(-1, 2)
    s = np.array([(a + o, b + o) for g, o in zip(graphs, at) for a, b in g.skip], int).reshape(-1, 2)
    left, right = np.full(len(y), OUT), np.full(len(y), OUT)
    right[c[:, 0]], left[c[:, 1]] = y[c[:, 1]], y[c[:, 0]]
    same = np.zeros((len(y), n_labels))
    np.add.at(same, (s[:, 0], y[s[:, 1]]), 1.0)
    np.add.at(same, (s[:, 1], y[s[:, 0]]), 1.0)
    goal = np.eye(n_labels)[y]
    share = 1 / (np.bincount(y, minlength=n_labels)[y] * (np.bincount(y, minlength=n_labels) > 0).sum())
    sums = [np.full(node.shape, 1e-8), np.full(chain.shape, 1e-8), 1e-8]
    for _ in range(rounds):
        use = (random.random(x.shape) < 0.7) / 0.7 * (random.random(len(x)) < 0.7)[:, None]
        use[:, 0] = 1.0  # the bias
        z = (node[x] * use[:, :, None]).sum(1) + chain[left] + chain[:, right].T + skip * same
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pull = (goal - p) * share[:, None]
        d_node = -penalty * node
        for k in range(x.shape[1]):
            np.add.at(d_node, x[:, k], pull * use[:, k : k + 1])
        d_chain = -penalty * chain
        np.add.at(d_chain, left, pull)
        d_right = np.zeros_like(chain)
        np.add.at(d_right, right, pull)
        d_chain += d_right.T
        d_skip = float((pull * same).sum()) - penalty * skip
        for total, d in zip(sums[:2], (d_node, d_chain)):
            total += d * d
        sums[2] += d_skip * d_skip
        node += rate * d_node / np.sqrt(sums[0])
        chain += rate * d_chain / np.sqrt(sums[1])
        skip = max(0.0, skip + rate * d_skip / np.sqrt(sums[2]))
    return Model(node, chain, float(skip))


def _levels(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Most links before each edge's first token and after its second, all links going forward."""
    before, after = [0] * n, [0] * n
    for a, b in edges[np.argsort(edges[:, 1], kind="stable")].tolist():
        before[b] = max(before[b], before[a] + 1)
    for a, b in edges[np.argsort(-edges[:, 0], kind="stable")].tolist():
        after[a] = max(after[a], after[b] + 1)
    return np.array(before, int)[edges[:, 0]], np.array(after, int)[edges[:, 1]]


def _grouped(level: np.ndarray) -> list[np.ndarray]:
    """Positions of each level, the lowest first."""
    order = np.argsort(level, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if len(order) else []


def marginals(model: Model, graphs: list[Graph], most: int = 25, enough: float = 1e-3) -> list[np.ndarray]:
    """Label probabilities of each graph's tokens by loopy sum-product messages.

    A sweep sends messages from the first token to the last and back, each after those it
    depends on, so evidence passes any number of links at once.  Sweeps go on until the
    messages of the graph itself change by less than ``enough``; they are damped after ``most``.
    Only loops can keep a graph from that; it ends after ``most`` and two sweeps a token.
    All graphs are passed together; base labels are evidence.
    """
    sizes = [len(g.spans) for g in graphs]
    at = np.cumsum([0, *sizes])
    if not at[-1]:
        return [np.zeros((0, OUT + 1)) for _ in graphs]
    x = np.concatenate([np.array(g.features, int).reshape(-1, 8) for g in graphs])
    y = np.concatenate([np.array(g.labels, int) for g in graphs])
    phi = model.node[x].sum(1)
    c = np.array([(a + o, b + o) for g, o in zip(graphs, at) for a, b in g.chain], int).reshape(-1, 2)
    s = np.array([(a + o, b + o) for g, o in zip(graphs, at) for a, b in g.skip], int).reshape(-1, 2)
    has_left, has_right = np.zeros(len(y), bool), np.zeros(len(y), bool)
    has_right[c[:, 0]], has_left[c[:, 1]] = True, True
    phi = phi + np.where(has_left[:, None], 0, model.chain[OUT]) + np.where(has_right[:, None], 0, model.chain[:, OUT])
    phi[y < OUT] += np.where(np.eye(OUT + 1)[y[y < OUT]] > 0, 0.0, -1e3)
    edges = np.r_[c, s]
    n = len(edges)
    psi = np.concatenate([np.repeat(model.chain[None], len(c), 0), np.repeat(model.skip * np.eye(OUT + 1)[None], len(s), 0)])
    source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    pair = np.concatenate([psi, psi.transpose(0, 2, 1)])  # message, source label, target label
    back = np.r_[np.arange(n) + n, np.arange(n)]
    owner = np.repeat(np.arange(len(graphs)), sizes)[source]
    before, after = _levels(edges, len(y))
    groups = _grouped(before) + [g + n for g in _grouped(after)]
    sent, belief = np.zeros((2 * n, OUT + 1)), phi.copy()
    ends, sweep = most + 2 * np.array(sizes), 0
    while groups:
        change = np.zeros(len(graphs))
        for g in groups:
            z = (belief[source[g]] - sent[back[g]])[:, :, None] + pair[g]
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None]).sum(1))
            new -= new.max(1, keepdims=True)
            step = (new - sent[g]) * (1.0 if sweep < most else 0.5)
            np.maximum.at(change, owner[g], np.abs(step).max(1))
            sent[g] += step
            np.add.at(belief, target[g], step)
        sweep += 1
        going = (change >= enough) & (sweep < ends)
        groups = [g for g in (g[going[owner[g]]] for g in groups) if len(g)]
    p = np.exp(belief - belief.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return [p[a:b] for a, b in zip(at[:-1], at[1:])]


def _plausible(kind: int, text: str) -> bool:
    digits = len(_only_digits(text))
    if kind == 0:
        return "@" in text
    if kind == 1:
        return text.count(".") >= 3
    return digits >= (13 if kind == 2 else 7)


def added_spans(text: str, g: Graph, p: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of sure tokens that touch no base span; neighbours of a kind are one span."""
    runs: list[list[int]] = []
    for i, row in enumerate(p):
        kind = int(row.argmax())
        if kind == OUT or g.labels[i] != OUT or row[kind] < SURE:
            continue
        a, b = g.spans[i]
        joins = runs and runs[-1][0] == kind and runs[-1][3] == i - 1 and a - runs[-1][2] <= 2
        if joins and len(_only_digits(text[runs[-1][1] : b])) <= MOST_DIGITS:
            runs[-1][2:] = [b, i]
        else:
            runs.append([kind, a, b, i])
    free = []
    for kind, a, b, _ in runs:
        if a and text[a - 1] == "(" and ")" in text[a:b]:
            a -= 1
        if _plausible(kind, text[a:b]) and not any(s[1] < b and s[2] > a for s in base):
            free.append((kind, a, b))
    return free


def find_spans(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
    """All spans of each text (kind, start, stop, is base), by start, then kind."""
    with_signs = [i for i, t in enumerate(texts) if t and SIGN.search(t)]
    bases = [base_spans(texts[i]) for i in with_signs]
    graphs = [graph(texts[i], b) for i, b in zip(with_signs, bases)]
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    for i, base, g, p in zip(with_signs, bases, graphs, marginals(model, graphs)):
        more = added_spans(texts[i], g, p, base)
        both = [(*s, True) for s in base] + [(*s, False) for s in more]
        out[i] = sorted(both, key=lambda s: (s[1], s[0]))
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the base spans of about ``sample_docs`` documents chosen by a hash; the bound holds at every size."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = rows.count()
    h = F.xxhash64("id", F.lit("sample"))
    some = rows.withColumn("h", h).where(F.shiftrightunsigned("h", 11) / float(1 << 53) < sample_docs / max(1, total))
    some = some.groupBy("h").agg(F.min("text").alias("text"))  # one of the rows that share an id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                t = text.as_py() or ""
                g = graph(t, base_spans(t)) if SIGN.search(t) else None
                if g and g.spans:
                    links = [*g.chain, *g.skip]
                    found.append((g.labels, [f for x in g.features for f in x], [v for e in links for v in e], len(g.chain)))
            columns = list(zip(*found)) or [[], [], [], []]
            types = [pa.list_(pa.int32())] * 3 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["y", "x", "links", "n"])

    graphs = []
    for r in sorted(some.mapInArrow(run, "y array<int>, x array<int>, links array<int>, n int").collect()):
        links = list(zip(r["links"][::2], r["links"][1::2]))
        x = np.array(r["x"]).reshape(len(r["y"]), -1).tolist()
        graphs.append(Graph([(0, 0)] * len(x), r["y"], x, links[: r["n"]], links[r["n"] :]))
    return fit(graphs)


def _mapped(docs: DataFrame, model: Model, text_col: str, keep: list[str], make, new: str, kind):
    """Columns ``keep`` and a column made of each whole text and its spans, some hundred texts at a time."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))  # 2^12 rows of a float per label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                texts = some.column("__text").to_pylist()
                made = [make(t, s) for t, s in zip(texts, find_spans(m, texts))]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(made, kind)], [*keep, new])

    return rows, run


def with_spans(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) of every row and ``spans``: kind, start, stop, base.

    Code points from 0, stop exclusive, by start, then kind.  Null and empty texts have none.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))

    def make(_, spans):
        return [{"kind": KINDS[k], "start": a, "stop": b, "base": base} for k, a, b, base in spans]

    rows, run = _mapped(docs, model, text_col, keep, make, "spans", kind)
    return rows.mapInArrow(run, rows.drop("__text").withColumn("spans", F.lit(None).cast(f"array<{SPAN}>")).schema)


def mask(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and brackets, as in ``[EMAIL]``.

    Spans that overlap are replaced together, by the first one's kind.  Null texts stay null.
    """

    def make(text, spans):
        if not spans:
            return text
        parts, at = [], 0
        for k, a, b, _ in spans:
            if a >= at:
                parts += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    rest = [c for c in docs.columns if c != text_col]
    rows, run = _mapped(docs, model, text_col, rest, make, text_col, pa.string())
    schema = rows.drop("__text").withColumn(text_col, F.lit(None).cast("string")).schema
    return rows.mapInArrow(run, schema).select(*docs.columns)
