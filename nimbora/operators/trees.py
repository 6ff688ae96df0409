"""Boosted trees as flat node tables: fitted at every cutoff, walked inside one expression.

Every tree is a complete binary tree of the ensemble's depth, so that a node is a number: children
of node k (from 1) are 2k and 2k + 1, and after `depth` steps k - 2 ** depth is the leaf. A branch
that ends early sends everything left. Three arrays hold an ensemble, in tree order:

  splits      input number of each inner node
  thresholds  inputs above it go right
  leaves      value of each leaf

They are columns like any other: one row per model, or literals.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.constants import DATE, KEY, SEED, TARGET
from nimbora.operators.blocks import ROW_INDEX
from nimbora.operators.specs import FeatureConfig
from nimbora.session import dealt_by, scratch_path

MODEL_FIELDS = ("base", "splits", "thresholds", "leaves")
FIT_SCHEMA = (
    f"{KEY} string, config_id string, cutoff date, n_train long, base double, "
    "splits array<tinyint>, thresholds array<double>, leaves array<double>, importances array<double>"
)
_EPOCH = date(1970, 1, 1)


@dataclass(frozen=True)
class TreeParams:
    """Rounds, learning rate, depth, row share, column share, least weight of a
    child, least gain of a split, Tweedie variance power. `ridge` and `bins` are those in common
    use; without `power` the loss is the squared error."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 4
    row_share: float = 0.9
    column_share: float = 0.7
    child_weight: float = 2.0
    split_gain: float = 0.1
    power: float | None = 1.9
    ridge: float = 1.0
    bins: int = 256


@dataclass
class Ensemble:
    """A fitted ensemble in the flat layout, with each input's mean gain per split, as shares."""

    base: float
    splits: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    importances: np.ndarray


def _gradients(y: np.ndarray, margin: np.ndarray, power: float | None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the margin; Tweedie with a log link."""
    if power is None:
        return margin - y, np.ones(len(y))
    low, high = np.exp((1 - power) * margin), np.exp((2 - power) * margin)
    return high - y * low, (2 - power) * high - (1 - power) * y * low


def _binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers and the upper edges of all bins but the last, from quantiles of each input."""
    shares = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(c, shares, method="inverted_cdf")) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    codes = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    return codes.astype(np.int64), edges


def boost(x: np.ndarray, y: np.ndarray, params: TreeParams, seed: int = SEED) -> Ensemble:
    """Gradient boosting on histograms of binned inputs; the same rows give the same ensemble."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    codes, edges = _binned(x, params.bins)
    bins = max((len(e) for e in edges), default=0) + 1
    chosen_width = max(1, int(params.column_share * width))
    inner, bottom = 2**params.depth - 1, 2**params.depth
    splits = np.zeros((params.rounds, inner), dtype=np.int8)
    thresholds = np.full((params.rounds, inner), np.inf)
    leaves = np.zeros((params.rounds, bottom))
    gains, uses = np.zeros(width), np.zeros(width)
    mean = float(y.mean())
    base = mean if params.power is None else float(np.log(max(mean, 1e-6)))
    margin = np.full(n, base)
    every = np.arange(n)
    for t in range(params.rounds):
        g, h = _gradients(y, margin, params.power)
        kept = rng.random(n) < params.row_share
        columns = np.sort(rng.permutation(width)[:chosen_width])
        tree = _grow(codes[:, columns], g * kept, h * kept, bins, params)
        node = np.ones(n, dtype=np.int64)
        for _ in range(params.depth):
            node = 2 * node + (codes[every, columns[tree.column[node]]] > tree.bin[node])
        leaves[t] = params.rate * tree.leaves
        margin += leaves[t][node - bottom]
        used = np.flatnonzero(tree.gain > 0)
        splits[t, used - 1] = columns[tree.column[used]]
        thresholds[t, used - 1] = [edges[columns[tree.column[k]]][tree.bin[k]] for k in used]
        np.add.at(gains, columns[tree.column[used]], tree.gain[used])
        np.add.at(uses, columns[tree.column[used]], 1)
    per_split = np.divide(gains, uses, out=np.zeros(width), where=uses > 0)
    total = per_split.sum()
    return Ensemble(
        base, splits.ravel(), thresholds.ravel(), leaves.ravel(), per_split / total if total else per_split
    )


@dataclass
class _Tree:
    """Node k of 1 .. 2 ** depth - 1: chosen column, last bin that goes left, gain (0: no split)."""

    column: np.ndarray
    bin: np.ndarray
    gain: np.ndarray
    leaves: np.ndarray


def _grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, params: TreeParams) -> _Tree:
    """One tree, level by level, then pruned from below where a last split gains too little."""
    n, width = codes.shape
    size = 2**params.depth
    column, cut, gain = np.zeros(size, dtype=np.int64), np.full(size, bins), np.zeros(size)
    weight = np.zeros(2 * size)  # a node's value as a leaf
    total = np.array([[g.sum(), h.sum()]])
    weight[1] = -total[0, 0] / (total[0, 1] + params.ridge)
    cells = codes + np.arange(width) * bins
    g_cells, h_cells = np.repeat(g, width), np.repeat(h, width)
    node = np.zeros(n, dtype=np.int64)  # within the level
    for level in range(params.depth):
        nodes = 2**level
        at = (cells + (node * (width * bins))[:, None]).ravel()
        shape = (nodes, width, bins)
        left_g = np.bincount(at, g_cells, nodes * width * bins).reshape(shape).cumsum(axis=2)
        left_h = np.bincount(at, h_cells, nodes * width * bins).reshape(shape).cumsum(axis=2)
        all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        score = left_g**2 / (left_h + params.ridge) + right_g**2 / (right_h + params.ridge)
        score -= all_g**2 / (all_h + params.ridge)
        score[(left_h < params.child_weight) | (right_h < params.child_weight)] = 0.0
        score[:, :, -1] = 0.0
        best = score.reshape(nodes, -1).argmax(axis=1)
        first, which = nodes, np.arange(nodes)
        own = score.reshape(nodes, -1)[which, best]
        found = own > 1e-6
        heap = first + which[found]
        gain[heap] = own[found]
        column[heap], cut[heap] = best[found] // bins, best[found] % bins
        lg = np.where(found, left_g.reshape(nodes, -1)[which, best], all_g[:, 0, 0])
        lh = np.where(found, left_h.reshape(nodes, -1)[which, best], all_h[:, 0, 0])
        weight[2 * (first + which)] = -lg / (lh + params.ridge)
        rg, rh = all_g[:, 0, 0] - lg, all_h[:, 0, 0] - lh
        weight[2 * (first + which) + 1] = -rg / (rh + params.ridge)
        k = first + node
        node = 2 * node + (codes[np.arange(n), column[k]] > cut[k])
    for k in range(size - 1, 0, -1):
        deeper = 2 * k < size and (gain[2 * k] > 0 or gain[2 * k + 1] > 0)
        if gain[k] < params.split_gain and not deeper:
            gain[k], cut[k], column[k] = 0.0, bins, 0
    for k in range(1, size):
        if gain[k] == 0 or cut[k] == bins:
            weight[2 * k] = weight[2 * k + 1] = weight[k]
    return _Tree(column, cut, gain, weight[size:])


def tree_sum(
    inputs: list[Column], base: Column, splits: Column, thresholds: Column, leaves: Column, depth: int
) -> Column:
    """Base plus the leaf of every tree for one row of inputs, all inside one expression."""
    inner, bottom = 2**depth - 1, 2**depth
    levels = F.array(*[F.lit(i) for i in range(depth)])
    values = F.array(*inputs)

    def leaf(x: Column, t: Column) -> Column:
        def down(k: Column, _: Column) -> Column:
            place = t * inner + k - 1
            right = F.get(x, F.get(splits, place).cast("int")) > F.get(thresholds, place)
            return 2 * k + right.cast("int")

        return F.get(leaves, t * bottom + F.aggregate(levels, F.lit(1), down) - bottom)

    def total(x: Column) -> Column:
        trees = F.sequence(F.lit(0), (F.size(leaves) / bottom).cast("int") - 1)
        return F.when(F.size(leaves) == 0, base).otherwise(
            F.aggregate(trees, base, lambda acc, t: acc + leaf(x, t))
        )

    return F.transform(F.array(values), total)[0]


def mllib_ensemble(spark: SparkSession, model) -> Ensemble:
    """The flat layout of a fitted MLlib tree ensemble, read from the node table of its saved form.

    What reaches the driver is the model: trees x nodes rows, whatever it was fitted on.
    """
    path = scratch_path(spark, "nodes")
    model.write().save(path)
    node = ("id", "prediction", "leftChild", "rightChild", "split.featureIndex")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID",
        *(f"nodeData.{name}" for name in node),
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)),
    )
    nodes = {(tree, k): rest for tree, k, *rest in rows.collect()}
    depth, inner = model.getMaxDepth(), 2 ** model.getMaxDepth() - 1
    shares = model.treeWeights
    splits = np.zeros((len(shares), inner), dtype=np.int16)
    thresholds = np.full((len(shares), inner), np.inf)
    leaves = np.zeros((len(shares), inner + 1))
    open_nodes = [(tree, 0, 1) for tree in range(len(shares))]
    while open_nodes:
        tree, k, place = open_nodes.pop()
        value, left, right, column, threshold = nodes[tree, k]
        if left < 0:  # every leaf below it has its value
            first = place << (depth - place.bit_length() + 1)
            last = (place + 1) << (depth - place.bit_length() + 1)
            leaves[tree, first - inner - 1 : last - inner - 1] = value * shares[tree]
        else:
            splits[tree, place - 1], thresholds[tree, place - 1] = column, threshold
            open_nodes += [(tree, left, 2 * place), (tree, right, 2 * place + 1)]
    return Ensemble(0.0, splits.ravel(), thresholds.ravel(), leaves.ravel(), model.featureImportances.toArray())


def ensemble_columns(ensemble: Ensemble) -> dict[str, Column]:
    """The ensemble as literals."""
    return {
        "base": F.lit(ensemble.base),
        "splits": literal_array(ensemble.splits, "smallint"),
        "thresholds": literal_array(ensemble.thresholds, "double"),
        "leaves": literal_array(ensemble.leaves, "double"),
    }


def literal_array(values, kind: str) -> Column:
    """A long array as one literal, parsed once when the plan is optimised."""
    if not len(values):
        return F.array().cast(f"array<{kind}>")
    text = ",".join(str(v).replace("inf", "Infinity") for v in np.asarray(values).tolist())
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def expanding_trees(
    features: DataFrame,
    grid: DataFrame,
    configs: Sequence[FeatureConfig],
    params: TreeParams = TreeParams(),
    seed: int = SEED,
    fits_per_task: int = 4,
) -> DataFrame:
    """One ensemble per (station, config, cutoff) on all feature rows up to the cutoff.

    `features` holds the columns of all configs; each config drops its own warm-up. Fits don't
    depend on each other, so Spark deals them out: the cutoffs are cut into runs of `fits_per_task`,
    a group is a station with one run, and gets the station's rows up to the run's last cutoff. A
    station has one row a day, so a group is bounded by the calendar, and a station with many
    cutoffs is many groups. The rows copied are rows x runs, little beside the rows x fits x rounds
    that boosting reads.

    Rows: idema, config_id, cutoff, n_train, base, splits, thresholds, leaves, importances, the
    last in `config.columns` order. Cutoffs without a training row give none.
    """
    cutoffs = [r.cutoff for r in grid.select("cutoff").distinct().orderBy("cutoff").collect()]
    days = np.array([(d - _EPOCH).days for d in cutoffs])
    runs = [days[i : i + fits_per_task] for i in range(0, len(days), fits_per_task)]
    used = list(dict.fromkeys(n for c in configs for n in c.columns if n != TARGET))
    rows = features.filter(F.col(DATE) <= F.lit(cutoffs[-1])).select(
        KEY, F.unix_date(DATE).alias("day"), ROW_INDEX, TARGET, *[F.col(n).cast("double").alias(n) for n in used]
    )
    lasts = literal_array([int(r[-1]) for r in runs], "int")
    first_run = F.size(F.filter(lasts, lambda last: last < F.col("day")))
    run = F.explode(F.sequence(first_run, F.lit(len(runs) - 1))).alias("run")
    plans = [(c.config_id, c.warmup, c.columns) for c in configs]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        day, index, y = (pdf[c].to_numpy() for c in ("day", ROW_INDEX, TARGET))
        out = []
        for config_id, warmup, columns in plans:
            x = pdf[columns].to_numpy(float)
            for cutoff in runs[int(pdf["run"].iloc[0])]:
                kept = (day <= cutoff) & (index > warmup)
                if kept.any():
                    e = boost(x[kept], y[kept].astype(float), params, seed)
                    when = _EPOCH + timedelta(days=int(cutoff))
                    out.append((pdf[KEY].iloc[0], config_id, when, int(kept.sum()), e.base, e.splits, e.thresholds, e.leaves, e.importances))
        names = [f.split()[0] for f in FIT_SCHEMA.split(", ")]
        return pd.DataFrame(out, columns=names)

    return dealt_by(rows.select("*", run), KEY, "run").groupBy(KEY, "run").applyInPandas(fit, FIT_SCHEMA)
