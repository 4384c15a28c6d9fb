"""Boosted trees on binned features, many models at once.

Features are binned once (``BINS`` quantile bins); a tree is grown level by level
from sums of gradients per (model, node, feature, bin). All models of a search are
fitted together, and models that differ in the number of trees only are one run
whose scores are noted after each of those numbers (108 points x 5 folds: 180 runs).

Up to ``WHOLE_BLOCKS * BLOCK_ROWS`` training rows are one block (some 40 MB): its sums
are complete in the task and a run needs no exchange, so the runs are dealt over the
tasks. More rows are blocks of at most ``BLOCK_ROWS`` and each level is one job: tasks
add up the sums of their blocks, a shuffle adds those of the tasks and picks the
splits, and only the splits (a few numbers per node) reach the driver. Margins are
written to the shared folder every ``KEEP_ROUNDS`` rounds. Gradients are whole multiples of 2^-20, so sums do not
depend on their order and both ways give the same trees.

Objective: class-weighted log-loss with an L2 penalty of 1 on leaf values, at least
weight 1 of second derivatives per child, margins begin at 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import cut_lineage

BINS = 64
BLOCK_ROWS = 1 << 18
WHOLE_BLOCKS = 4
GROUP_RUNS = 16         # runs whose margins one state row holds
KEEP_ROUNDS = 10
PENALTY = 1.0
LEAST_WEIGHT = 1.0
LEAST_GAIN = 1e-6
SEED = 42
_UNIT = float(1 << 20)


class Params(NamedTuple):
    """Fields in the order in which ties of the search are decided."""
    columns: float = 1.0
    rate: float = 0.1
    depth: int = 3
    trees: int = 100
    rows: float = 1.0


class Run(NamedTuple):
    no: int
    params: Params
    holdout: int        # rows of this fold are scored, not learned


# The reference's search grid.
GRID = {"columns": [0.8, 1.0], "rate": [0.05, 0.1, 0.2], "depth": [3, 4, 5], "trees": [50, 100, 200], "rows": [0.8, 1.0]}


def points(grid: dict[str, list]) -> list[Params]:
    return [Params(*values) for values in product(*(grid[name] for name in Params._fields))]


# ---- the training table in blocks -------------------------------------------------

def bin_edges(train: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """Per feature ascending thresholds; the bin of x is the number of them below x."""
    found = train.approxQuantile(list(cols), [k / BINS for k in range(1, BINS)], 0.001)
    return [np.unique(np.array(q, dtype=np.float64)) for q in found]


class Block:
    """Rows in columns: ``x`` (features x rows, bins), label, weight, fold, key."""

    def __init__(self, x, label, weight, fold, key):
        self.x, self.label, self.weight, self.fold, self.key = x, label, weight, fold, key
        self._pairs: dict[int, np.ndarray] = {}

    def pair(self, no: int) -> np.ndarray:
        """The bins of features 2 no and 2 no + 1 (if there is one) as one number."""
        if no not in self._pairs:
            both = self.x[2 * no].astype(np.uint16) * np.uint16(BINS)
            self._pairs[no] = both + self.x[2 * no + 1] if 2 * no + 1 < len(self.x) else both
        return self._pairs[no]

    @classmethod
    def read(cls, row: dict) -> Block:
        n = row["n"]
        return cls(np.frombuffer(row["x"], np.uint8).reshape(-1, n), np.frombuffer(row["label"], np.uint8),
                   np.frombuffer(row["weight"], np.float64), np.frombuffer(row["fold"], np.uint8), np.frombuffer(row["key"], np.int64))


_BLOCK = "block bigint, n int, x binary, label binary, weight binary, fold binary, key binary"


def blocks(train: DataFrame, cols: Sequence[str], edges: list[np.ndarray], label: str, weight: str = "weight", fold: str = "fold",
           key: str = "match_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The binned training rows, checkpointed, one row per block."""
    t = train.select(*[F.col(c).cast("double") for c in cols], F.col(label).cast("int").alias("_y"), F.col(weight).cast("double").alias("_w"),
                     F.col(fold).cast("int").alias("_f"), F.xxhash64(key).alias("_k"))
    rows = t.count()
    n, most = (1, max(rows, 1)) if rows <= WHOLE_BLOCKS * block_rows else (-(-rows // block_rows), block_rows)
    width = len(cols)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.argsort(columns[-1], kind="stable")
        part = TaskContext.get().partitionId()
        for no, low in enumerate(range(0, len(order), most)):
            at = order[low:low + most]
            x = np.stack([np.searchsorted(edges[f], columns[f][at], side="left").astype(np.uint8) for f in range(width)])
            made = {"block": part * 1000 + no, "n": len(at), "x": x.tobytes(), "label": columns[width][at].astype(np.uint8).tobytes(),
                    "weight": columns[width + 1][at].astype(np.float64).tobytes(), "fold": columns[width + 2][at].astype(np.uint8).tobytes(),
                    "key": columns[width + 3][at].astype(np.int64).tobytes()}
            yield pa.RecordBatch.from_arrays([pa.array([made["block"]], pa.int64()), pa.array([made["n"]], pa.int32()),
                                              *[pa.array([made[c]], pa.binary()) for c in ("x", "label", "weight", "fold", "key")]],
                                             names=["block", "n", "x", "label", "weight", "fold", "key"])

    return cut_lineage(t.repartition(n, "_k").mapInArrow(build, _BLOCK))


# ---- one run on one block -----------------------------------------------------------

def _uniform(key: np.ndarray, turn: int) -> np.ndarray:
    x = key.astype(np.uint64) + np.uint64((SEED * 1_000_003 + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def tree_columns(params: Params, turn: int, width: int) -> np.ndarray:
    """Which features tree ``turn`` may split on."""
    allowed = np.zeros(width, dtype=bool)
    allowed[np.random.default_rng([SEED, turn]).permutation(width)[:max(1, int(params.columns * width))]] = True
    return allowed


def probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def _below(x: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of every row on the next level."""
    right = np.zeros(x.shape[1], dtype=bool)
    for k, (f, b) in enumerate(zip(feature.tolist(), cut.tolist())):
        if b < 255:
            right |= (x[f] > b) & (node == k)
    return 2 * node + right


class Tree(NamedTuple):
    feature: list[np.ndarray]   # per level
    bin: list[np.ndarray]       # to the right if the row's bin is greater
    gain: list[np.ndarray]      # 0: not split, all rows go left
    leaf: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(x.shape[1], dtype=np.uint16)
        for f, b in zip(self.feature, self.bin):
            node = _below(x, node, f, b)
        return node


class Grower:
    """A run on a block: its margins and the tree it is growing."""

    def __init__(self, block: Block, run: Run, margin: np.ndarray | None = None):
        self.block, self.run = block, run
        self.margin = np.zeros(len(block.label)) if margin is None else margin
        self.learn = block.fold != run.holdout
        self._whole: dict[int, np.ndarray] = {}     # pairs of features of the learned rows, if trees take them all

    def begin(self, turn: int) -> None:
        """The rows of the tree and, in their order, the derivatives."""
        p, b = self.run.params, self.block
        use = self.learn if p.rows >= 1 else self.learn & (_uniform(b.key, turn) < p.rows)
        self.rows, self.node = np.flatnonzero(use), np.zeros(len(b.label), dtype=np.uint16)
        prob, weight = probability(self.margin.take(self.rows)), b.weight.take(self.rows)
        self.g = np.rint((prob - b.label.take(self.rows)) * weight * _UNIT)
        self.h = np.rint(prob * (1.0 - prob) * weight * _UNIT)

    def sums(self, level: int, features: np.ndarray, above: np.ndarray | None = None) -> np.ndarray:
        """(2, nodes, features, BINS): first and second derivatives. Where the sums of
        the level ``above`` are known, only the child with fewer rows is added up and the
        other is the difference (of whole numbers, so the same)."""
        nodes, at = 1 << level, self.node.take(self.rows)
        if above is None:
            return self._added(None, at, nodes, features)
        n = np.bincount(at, minlength=nodes).reshape(-1, 2)
        parents = np.arange(nodes // 2)
        small = 2 * parents + (n[:, 1] < n[:, 0])
        mine = np.zeros(nodes, dtype=bool)
        mine[small] = True
        chosen = np.flatnonzero(mine.take(at))
        out = np.empty((2, nodes, len(features), BINS))
        out[:, small] = self._added(chosen, at.take(chosen) >> 1, nodes // 2, features)
        out[:, small ^ 1] = above - out[:, small]
        return out

    def _pairs_of(self, no: int, rows: np.ndarray, every: bool) -> np.ndarray:
        """The pairs of features of ``rows``; all learned rows are looked up once a run."""
        if not every or self.run.params.rows < 1:
            return self.block.pair(no).take(rows)
        if no not in self._whole:
            self._whole[no] = self.block.pair(no).take(rows)
        return self._whole[no]

    def _added(self, chosen: np.ndarray | None, slot: np.ndarray, slots: int, features: np.ndarray) -> np.ndarray:
        """Sums over the ``chosen`` places of the tree's rows (None: all)."""
        every = chosen is None
        rows, g, h = (self.rows, self.g, self.h) if every else (self.rows.take(chosen), self.g.take(chosen), self.h.take(chosen))
        out = np.empty((2, slots, len(features), BINS))
        if len(rows) < slots << 13:
            base = slot.astype(np.int64) * BINS
            for k, f in enumerate(features):
                at = base + self.block.x[f].take(rows)
                for part, w in zip(out, (g, h)):
                    part[:, k] = np.bincount(at, w, slots * BINS).reshape(slots, BINS)
            return out
        # many rows: two features at once, whose sums are the margins of their joint table
        base, place = slot.astype(np.int64) * (BINS * BINS), {f: k for k, f in enumerate(features.tolist())}
        for no in sorted({f // 2 for f in place}):
            pairs = self._pairs_of(no, rows, every)
            at = base + pairs if slots > 1 else pairs.astype(np.int64)
            for part, w in zip(out, (g, h)):
                both = np.bincount(at, w, slots * BINS * BINS).reshape(slots, BINS, BINS)
                for f, axis in ((2 * no, 2), (2 * no + 1, 1)):
                    if f in place:
                        part[:, place[f]] = both.sum(axis=axis)
        return out

    def split(self, feature: np.ndarray, cut: np.ndarray) -> None:
        self.node = _below(self.block.x, self.node, feature, cut)

    def end(self, tree: Tree, node: np.ndarray | None = None) -> None:
        self.margin = self.margin + tree.leaf[tree.place(self.block.x) if node is None else node]


def best_splits(sums: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node (feature, bin, gain) and the (2, nodes, 2) sums of its children;
    ``sums`` has the given features only."""
    left = np.cumsum(sums / _UNIT, axis=3)
    total = left[:, :, :1, -1:]
    right = total - left
    value = lambda s: s[0] ** 2 / (s[1] + PENALTY)
    gain = value(left) + value(right) - value(total)
    gain[(left[1] < LEAST_WEIGHT) | (right[1] < LEAST_WEIGHT)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = np.argmax(flat, axis=1)
    nodes = np.arange(len(flat))
    top = flat[nodes, best]
    place, cut = best // BINS, best % BINS
    split = top > LEAST_GAIN
    l, r = np.where(split, left[:, nodes, place, cut], total[:, :, 0, 0]), np.where(split, right[:, nodes, place, cut], 0.0)
    return np.where(split, features[place], 0), np.where(split, cut, 255), np.where(split, top, 0.0), np.stack([l, r], axis=2)


def leaves(children: np.ndarray, rate: float) -> np.ndarray:
    g, h = children.reshape(2, -1)
    return -rate * g / (h + PENALTY)


def grow(block: Block, run: Run) -> Iterator[tuple[Tree, np.ndarray]]:
    """Where ``block`` holds all rows: each tree, and the margins after it."""
    grower = Grower(block, run)
    for turn in range(run.params.trees):
        features, sums = np.flatnonzero(tree_columns(run.params, turn, len(block.x))), None
        grower.begin(turn)
        feature, cuts, gains = [], [], []
        for level in range(run.params.depth):
            sums = grower.sums(level, features, sums)
            f, c, gain, children = best_splits(sums, features)
            grower.split(f, c)
            feature.append(f), cuts.append(c), gains.append(gain)
        tree = Tree(feature, cuts, gains, leaves(children, run.params.rate))
        grower.end(tree, grower.node)
        yield tree, grower.margin


# ---- all runs -----------------------------------------------------------------------

def _loss(margin: np.ndarray, label: np.ndarray) -> float:
    return float(np.logaddexp(0.0, np.where(label == 1, -margin, margin)).sum())


def ranked(margin: np.ndarray, label: np.ndarray) -> tuple[int, int, int]:
    """The numbers of :func:`kestrel.ml.metrics.auc_numerator`: twice the pairs in
    order (ties count half), the positives and the negatives."""
    order = np.argsort(margin, kind="stable")
    s, y = margin[order], (label[order] == 1).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, dtype=np.int64)
    p = np.add.reduceat(y, first) if len(s) else y
    q = np.diff(np.append(first, len(s))) - p
    return int((p * (2 * (np.cumsum(q) - q) + q)).sum()), int(p.sum()), int(q.sum())


class _Notes:
    """What a run leaves behind: margins of the held-out rows after some numbers
    of trees (if wanted) or, of a block with all rows, the counts of their AUC,
    and the sum of their log-losses after every tree."""
    schema = ("run int, trees int, label array<int>, margin array<double>, loss array<double>, held bigint, model binary, "
              "auc2 bigint, npos bigint, nneg bigint")

    def __init__(self, block: Block, run: Run, at: set[int], margins: bool = True, ranks: bool = False):
        self.margins, self.ranks = margins, ranks
        self.run, self.at, self.out = run, at, np.flatnonzero(block.fold == run.holdout)
        self.label = block.label[self.out]
        self.loss, self.rows = [_loss(np.zeros(len(self.out)), self.label)], []

    def add(self, turn: int, margin: np.ndarray) -> None:
        self.loss.append(_loss(margin[self.out], self.label))
        if turn in self.at:
            self.rows.append((turn, margin[self.out]))

    def batch(self, trees: list[Tree] | None) -> pa.RecordBatch:
        k, n = len(self.rows), len(self.out) if self.margins else 0
        label, found = self.label[:n], [r[1][:n] for r in self.rows]
        counts = [ranked(r[1], self.label) if self.ranks else (None,) * 3 for r in self.rows]
        lists = lambda values: pa.ListArray.from_arrays(pa.array(range(0, k * n + 1, n) if n else [0] * (k + 1), pa.int32()), values)
        model = [None] * (k - 1) + [None if trees is None else pickle.dumps(trees)]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.run.no] * k, pa.int32()), pa.array([r[0] for r in self.rows], pa.int32()),
             lists(pa.array(np.tile(label, k).astype(np.int32))),
             lists(pa.array(np.concatenate(found) if k else np.zeros(0))),
             pa.array([self.loss] * k, pa.list_(pa.float64())), pa.array([len(self.out)] * k, pa.int64()), pa.array(model, pa.binary()),
             *[pa.array([c[j] for c in counts], pa.int64()) for j in range(3)]],
            names=["run", "trees", "label", "margin", "loss", "held", "model", "auc2", "npos", "nneg"])


def fit(data: DataFrame, runs: Sequence[Run], notes: Sequence[int], keep_trees: bool = False,
        margins: bool = True) -> tuple[DataFrame, list[list[Tree]] | None]:
    """Fit ``runs`` on the blocks ``data``. Returns per run and number of trees in
    ``notes`` (and block) the held-out labels and margins and the held-out losses
    after every tree (label, margin, loss arrays), and the trees if asked for.
    One block of all rows also gives the counts of the AUC (auc2, npos, nneg: null
    otherwise) and, without ``margins``, leaves the labels and margins out."""
    spark = data.sparkSession
    if data.count() <= 1:
        found = _fit_whole(spark, data, runs, set(notes), keep_trees, margins)
    else:
        trees = _fit_levels(spark, data, runs)
        return _replay(spark, data, runs, trees, set(notes)), trees if keep_trees else None
    if not keep_trees:
        return found, None
    held = {r["run"]: pickle.loads(r["model"]) for r in found.where("model is not null").select("run", "model").collect()}
    return found, [held[r.no] for r in runs]


def _numbered(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, numPartitions=max(1, n))


def _fit_whole(spark, data, runs, notes, keep_trees, margins) -> DataFrame:
    """All rows lie in one block of bounded size: it is sent to all tasks, which take the runs."""
    rows = [r.asDict() for r in data.collect()]
    sent = spark.sparkContext.broadcast(rows)
    order = sorted(range(len(runs)), key=lambda no: -runs[no].params.depth)     # the longest first

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no in batch.column(0).to_pylist():
                if not sent.value:
                    continue
                block, run, trees = Block.read(sent.value[0]), runs[order[no]], []
                noted = _Notes(block, run, notes, margins, ranks=True)
                for turn, (tree, margin) in enumerate(grow(block, run), start=1):
                    noted.add(turn, margin)
                    if keep_trees:
                        trees.append(tree)
                yield noted.batch(trees if keep_trees else None)

    return cut_lineage(_numbered(spark, len(runs)).mapInArrow(work, _Notes.schema))


def _fit_levels(spark, data, runs) -> list[list[Tree]]:
    """One job per level: sums per task, added up and split by a shuffle."""
    groups = [list(runs[k:k + GROUP_RUNS]) for k in range(0, len(runs), GROUP_RUNS)]
    state = data.withColumn("group", F.explode(F.array(*[F.lit(k) for k in range(len(groups))]))) \
        .withColumn("margin", F.lit(None).cast("binary"))
    state = cut_lineage(state.repartition(data.count() * len(groups)))      # a block and group per task
    schema = _BLOCK + ", group int, margin binary"
    trees: list[list[Tree]] = [[] for _ in runs]
    place = {run.no: k for k, run in enumerate(runs)}
    kept = 0        # trees that the stored margins contain

    def growers(row: dict, known: list[list[Tree]], since: int) -> Iterator[Grower]:
        block, group = Block.read(row), groups[row["group"]]
        stored = None if row["margin"] is None else np.frombuffer(row["margin"], np.float64).reshape(len(group), -1)
        for k, run in enumerate(group):
            grower = Grower(block, run, None if stored is None else stored[k])
            for tree in known[place[run.no]][since:]:
                grower.end(tree)
            yield grower

    width = data.select((F.length("x") / F.col("n")).cast("int")).head()[0]

    def features(run: Run, turn: int) -> np.ndarray:
        return np.flatnonzero(tree_columns(run.params, turn, width))

    def chooser(turn: int, level: int):
        def choose(rows: pa.Table) -> pa.Table:
            no = rows.column("run")[0].as_py()
            total = sum(np.frombuffer(b.as_py(), np.float64) for b in rows.column("sums"))
            total = total.reshape(2, 1 << level, -1, BINS)
            found = best_splits(total, features(runs[place[no]], turn))
            return pa.table({"run": pa.array([no], pa.int32()), "split": pa.array([pickle.dumps(found)], pa.binary())})
        return choose

    for turn in range(max(r.params.trees for r in runs)):
        if turn and turn % KEEP_ROUNDS == 0:
            sent = spark.sparkContext.broadcast((trees, kept))

            def refresh(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k, row in enumerate(batch.to_pylist()):
                        margin = np.stack([g.margin for g in growers(row, *sent.value)]).tobytes()
                        yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[:-1], pa.array([margin], pa.binary())], names=batch.schema.names)

            state, kept = cut_lineage(state.mapInArrow(refresh, schema)), turn
        begun: dict[int, list] = {r.no: [] for r in runs if turn < r.params.trees}
        for level in range(max(r.params.depth for r in runs)):
            sent = spark.sparkContext.broadcast((trees, kept, begun))

            def sums(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn, level=level) -> Iterator[pa.RecordBatch]:
                known, since, open_ = sent.value
                held: dict[int, np.ndarray] = {}
                for batch in batches:
                    for row in batch.to_pylist():
                        for grower in growers(row, known, since):
                            run = grower.run
                            if run.no not in open_ or level >= run.params.depth:
                                continue
                            grower.begin(turn)
                            for f, c, *_ in open_[run.no]:
                                grower.split(f, c)
                            own = grower.sums(level, features(run, turn))
                            held[run.no] = held[run.no] + own if run.no in held else own
                for no, s in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["run", "sums"])

            added = state.mapInArrow(sums, "run int, sums binary").groupBy("run").applyInArrow(chooser(turn, level), "run int, split binary")
            for r in added.collect():
                begun[r["run"]].append(pickle.loads(r["split"]))
        for no, levels in begun.items():
            run = runs[place[no]]
            f, c, gain, children = zip(*levels)
            trees[place[no]].append(Tree(list(f), list(c), list(gain), leaves(children[-1], run.params.rate)))
    return trees


def _replay(spark, data, runs, trees, notes) -> DataFrame:
    """The notes of fitted runs, one row per block, run and number of trees."""
    sent = spark.sparkContext.broadcast(trees)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                for k, run in enumerate(runs):
                    noted, grower = _Notes(block, run, notes), Grower(block, run)
                    for turn, tree in enumerate(sent.value[k], start=1):
                        grower.end(tree)
                        noted.add(turn, grower.margin)
                    yield noted.batch(None)

    return cut_lineage(data.mapInArrow(work, _Notes.schema))


# ---- the fitted model -------------------------------------------------------------------

class Boosted:
    """A fitted model: features, thresholds and trees."""

    def __init__(self, cols: Sequence[str], edges: list[np.ndarray], trees: list[Tree], params: Params):
        self.cols, self.edges, self.trees, self.params = list(cols), edges, trees, params

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Of rows x features."""
        x = np.stack([np.searchsorted(e, values[:, f], side="left") for f, e in enumerate(self.edges)]) if len(values) else \
            np.zeros((len(self.cols), 0), dtype=np.int64)
        margin = np.zeros(len(values))
        for tree in self.trees:
            margin += tree.leaf[tree.place(x)]
        return probability(margin)

    def score(self, spark: SparkSession) -> Column:
        """P(label 1) of a row that has the features as columns."""
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(features: pd.DataFrame) -> pd.Series:
            return pd.Series(sent.value.probabilities(features.to_numpy(dtype=np.float64)))

        return scored(F.struct(*[F.col(c).cast("double").alias(c) for c in self.cols]))

    def importances(self) -> dict[str, float]:
        """Mean gain of a feature's splits, as shares of 1."""
        gain, n = np.zeros(len(self.cols)), np.zeros(len(self.cols))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                np.add.at(gain, f[g > 0], g[g > 0])
                np.add.at(n, f[g > 0], 1)
        mean = np.divide(gain, n, out=np.zeros_like(gain), where=n > 0)
        return dict(zip(self.cols, (mean / mean.sum() if mean.sum() else mean).tolist()))

    def table(self, spark: SparkSession) -> DataFrame:
        """The trees as rows (tree, level, node, feature, threshold, gain; leaves: level = depth, value)."""
        rows = []
        for t, tree in enumerate(self.trees):
            for level, (f, c, g) in enumerate(zip(tree.feature, tree.bin, tree.gain)):
                rows += [(t, level, k, self.cols[a] if s > 0 else None, int(b) if s > 0 else None,
                          float(self.edges[a][b]) if s > 0 and b < len(self.edges[a]) else None, float(s), None)
                         for k, (a, b, s) in enumerate(zip(f.tolist(), c.tolist(), g.tolist()))]
            rows += [(t, len(tree.feature), k, None, None, None, None, float(v)) for k, v in enumerate(tree.leaf)]
        rows += [(-1, k, j, c, None, float(v), None, None) for k, (c, e) in enumerate(zip(self.cols, self.edges)) for j, v in enumerate(e)]
        return spark.createDataFrame(rows, "tree int, level int, node int, feature string, bin int, threshold double, gain double, value double")

    @classmethod
    def from_table(cls, table: DataFrame, cols: Sequence[str], params: Params | None = None) -> Boosted:
        rows = table.toPandas()
        at = {c: k for k, c in enumerate(cols)}
        bounds = rows[rows.tree < 0].sort_values(["level", "node"])
        edges = [bounds[bounds.level == k].threshold.to_numpy() for k in range(len(cols))]
        trees = []
        for _, t in rows[rows.tree >= 0].sort_values(["level", "node"]).groupby("tree"):
            depth = t.level.max()
            levels = [t[t.level == k] for k in range(depth)]
            trees.append(Tree([np.array([at.get(f, 0) for f in v.feature]) for v in levels],
                              [v.bin.fillna(255).to_numpy(dtype=np.int64) for v in levels],
                              [v.gain.to_numpy(dtype=np.float64) for v in levels], t[t.level == depth].value.to_numpy(dtype=np.float64)))
        return cls(cols, edges, trees, params or Params())
