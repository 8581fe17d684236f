"""Gaussian hidden Markov models over many sequences: fitting, filtered and posterior probabilities, likeliest paths.

A sequence (a symbol's rows in order) is cut into blocks. A row is a k x k matrix (move, then emit), such matrices
multiply, so each block is one matrix and a scale; a forward and a backward pass over a key's block matrices give what is
known at each block's ends, and then every block is worked on by itself. The same blocks give likeliest paths when sums
are taken as maxima. So a long sequence is spread over tasks, and what runs along a key is one small matrix for a block.
The driver sees only sums of fixed size: k starts, k x k moves and each state's moments.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import by_seq, last_rows

BLOCK = 512
_AT_ONCE = 64  # blocks of a vectorised step


@dataclass
class Model:
    """pi (k), moves (k x k, rows sum to 1), means (k x d) and covariances (k x d x d)."""

    pi: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: tuple = ()

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log densities (..., k) of rows (..., d)."""
        out = []
        for mean, cov in zip(self.means, self.covs):
            low = np.linalg.cholesky(cov + 1e-12 * np.eye(len(cov)))
            z = np.linalg.solve(low, (x - mean).reshape(-1, x.shape[-1]).T).T.reshape(x.shape)
            out.append(-0.5 * (z * z).sum(-1) - np.log(np.diag(low)).sum() - 0.5 * x.shape[-1] * np.log(2 * np.pi))
        return np.stack(out, -1)

    def names(self) -> list[str]:
        """bear, sideways and bull by the states' mean of the first column: the lowest third of states, the middle, the highest third."""
        k = len(self.pi)
        order = np.argsort(np.argsort(self.means[:, 0], kind="stable"), kind="stable")
        if k == 2:
            return ["bear" if r == 0 else "bull" for r in order]
        return ["bear" if r < k // 3 else "bull" if r >= k - k // 3 else "sideways" for r in order]


def standardised(df: DataFrame, n: int = 20) -> DataFrame:
    """symbol, seq, x1 (log return) and x2 (its deviation over n rows) of rows that have both, less their means and over their deviations over all rows."""
    step = F.log(F.col("close") / F.lag("close").over(by_seq()))
    df = df.withColumn("_r", step)
    rows = df.withColumn("_v", F.when(F.count("_r").over(last_rows(n)) == n, F.stddev_samp("_r").over(last_rows(n)))).where("_r IS NOT NULL AND _v IS NOT NULL").select("symbol", "seq", "_r", "_v")
    one = rows.agg(*[f(c).alias(f"{c}{a}") for c in ("_r", "_v") for f, a in ((F.avg, "m"), (F.stddev_pop, "s"))])
    return rows.join(F.broadcast(one)).select("symbol", "seq", *[((F.col(c) - F.col(f"{c}m")) / (F.col(f"{c}s") + 1e-10)).alias(x) for c, x in (("_r", "x1"), ("_v", "x2"))])  # one row


def blocks(rows: DataFrame, columns: list[str], size: int = BLOCK) -> DataFrame:
    """symbol, block, first and last (whether it starts or ends its sequence), seqs and x (the values of `columns`, row by row) of at most `size` rows each. A row with a null in `columns` is left out.

    Blocks are dealt out by symbol and block, so that one symbol's blocks are many tasks' work and joins of a few numbers for each block move none of them.
    """
    known = rows.dropna(subset=columns)
    row = F.struct("seq", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    made = known.groupBy("symbol", F.floor(F.col("seq") / size).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    own = Window.partitionBy("symbol").orderBy("block")
    made = made.select("symbol", "block", F.lag("block").over(own).isNull().alias("first"), F.lead("block").over(own).isNull().alias("last"), F.col("r.seq").alias("seqs"), F.flatten("r.x").alias("x"))
    return made.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "block").sortWithinPartitions("symbol", "block")


def _padded(pdf: pd.DataFrame, model: Model):
    """Emissions (n, t, k) over each row's largest, those largest's logs (n, t), which rows are real, and the values (n, t, d)."""
    lengths = np.array([len(s) for s in pdf["seqs"]])
    x = np.zeros((len(pdf), lengths.max(), model.means.shape[1]))
    for i, rows in enumerate(pdf["x"]):
        x[i, : lengths[i]] = np.reshape(rows, (lengths[i], -1))
    real = np.arange(x.shape[1]) < lengths[:, None]
    density = model.log_density(x)
    top = density.max(-1)
    return np.exp(density - top[..., None]), np.where(real, top, 0.0), real, x


def _joined(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    """Matrix products of stacks, with maxima in place of sums if `best`."""
    return (a[..., :, :, None] * b[..., None, :, :]).max(-2) if best else a @ b


def _chunks(pdfs):
    for pdf in pdfs:
        for at in range(0, len(pdf), _AT_ONCE):
            yield pdf.iloc[at : at + _AT_ONCE]


def _ends(cut: DataFrame, model: Model, best: bool) -> DataFrame:
    """symbol, block, matrix (k * k numbers) and scale of each block."""
    k = len(model.pi)

    def run(pdfs):
        for pdf in _chunks(pdfs):
            b, top, real, _ = _padded(pdf, model)
            first = pdf["first"].to_numpy()
            m, scale = np.tile(np.eye(k), (len(pdf), 1, 1)), np.zeros(len(pdf))
            for t in range(b.shape[1]):
                step = np.where((first & (t == 0))[:, None, None], np.eye(k), model.moves) * b[:, t, None, :]
                new = _joined(m, step, best)
                size = new.max((1, 2))
                on = real[:, t]
                m = np.where(on[:, None, None], new / size[:, None, None], m)
                scale += np.where(on, np.log(size) + top[:, t], 0.0)
            yield pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "block": pdf["block"].to_numpy(), "m": list(m.reshape(len(pdf), -1)), "scale": scale})

    return cut.mapInPandas(run, "symbol string, block long, m array<double>, scale double")


def _passes(ends: DataFrame, model: Model, best: bool) -> tuple[DataFrame, DataFrame]:
    """What is known before each block (ahead, and the log likelihood up to its end), and after it (back)."""
    k = len(model.pi)

    def forward(pdfs):
        key, a, total = None, None, 0.0
        for pdf in pdfs:
            out = []
            for symbol, block, m, scale in zip(pdf["symbol"], pdf["block"], pdf["m"], pdf["scale"]):
                if symbol != key:
                    key, a, total = symbol, model.pi, 0.0
                v = _joined(a[None, :], np.reshape(m, (k, k)), best)[0]
                total += np.log(v.sum()) + scale
                out.append((symbol, block, a, total))
                a = v / v.sum()
            yield pd.DataFrame(out, columns=["symbol", "block", "ahead", "total"])

    def backward(pdfs):
        key, b = None, None
        for pdf in pdfs:
            out = []
            for symbol, block, m in zip(pdf["symbol"], pdf["block"], pdf["m"]):
                if symbol != key:
                    key, b = symbol, np.ones(k)
                out.append((symbol, block, b))
                v = _joined(np.reshape(m, (k, k)), b[:, None], best)[:, 0]
                b = v / v.sum()
            yield pd.DataFrame(out, columns=["symbol", "block", "back"])

    dealt = ends.repartition("symbol")
    ahead = dealt.sortWithinPartitions("symbol", "block").mapInPandas(forward, "symbol string, block long, ahead array<double>, total double")
    back = dealt.sortWithinPartitions("symbol", F.desc("block")).mapInPandas(backward, "symbol string, block long, back array<double>")
    return ahead, back


def _within(pdf: pd.DataFrame, model: Model, best: bool):
    """Forward and backward numbers (n, t, k) of each row of the blocks, and the emissions, real rows and values."""
    b, _, real, x = _padded(pdf, model)
    n, t_all, k = b.shape
    first = pdf["first"].to_numpy()
    a = np.stack(pdf["ahead"].to_numpy())
    alpha, beta = np.zeros_like(b), np.zeros_like(b)
    for t in range(t_all):
        moved = a if t == 0 and first.all() else np.where((first & (t == 0))[:, None], a, _joined(a[:, None, :], model.moves[None], best)[:, 0])
        new = moved * b[:, t]
        a = np.where(real[:, t, None], new / np.maximum(new.sum(-1, keepdims=True), 1e-300), a)
        alpha[:, t] = a
    back = np.stack(pdf["back"].to_numpy())
    for t in range(t_all - 1, -1, -1):
        beta[:, t] = back
        new = _joined(model.moves[None], (b[:, t] * back)[:, :, None], best)[:, :, 0]
        back = np.where(real[:, t, None], new / np.maximum(new.sum(-1, keepdims=True), 1e-300), back)
    return alpha, beta, b, real, x


def _sums(pdf: pd.DataFrame, model: Model) -> np.ndarray:
    alpha, beta, b, real, x = _within(pdf, model, False)
    gamma = alpha * beta
    gamma /= gamma.sum(-1, keepdims=True)
    gamma *= real[..., None]
    first = pdf["first"].to_numpy()
    # moves into each row: from the row before, or from what is known before the block; none into a sequence's first row
    before = np.concatenate([np.stack(pdf["ahead"].to_numpy())[:, None], alpha[:, :-1]], 1)
    xi = before[..., :, None] * model.moves * (b * beta)[..., None, :]
    xi /= np.maximum(xi.sum((-1, -2), keepdims=True), 1e-300)
    counted = real.copy()
    counted[first, 0] = False
    xi = (xi * counted[..., None, None]).sum((0, 1))
    weight = gamma.sum((0, 1))
    mean = np.einsum("ntk,ntd->kd", gamma, x)
    square = np.einsum("ntk,ntd,nte->kde", gamma, x, x)
    return np.concatenate([gamma[first, 0].sum(0), [first.sum(), real.sum()], xi.ravel(), weight, mean.ravel(), square.ravel()])


def start(rows: DataFrame, columns: list[str], k: int) -> Model:
    """The starting model: even starts, moves that stay with 0.8 against 0.1, means at even quantiles of each column, every covariance the columns' variances."""
    q = [float(p) for p in np.linspace(0, 1, k + 2)[1:-1]]
    got = rows.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in q])) for c in columns], *[F.var_pop(c) for c in columns]).first()
    moves = np.full((k, k), 0.1) + 0.7 * np.eye(k)
    d = len(columns)
    return Model(np.full(k, 1 / k), moves / moves.sum(1, keepdims=True), np.array(got[:d], float).T, np.stack([np.diag(np.array(got[d:], float) + 1e-6)] * k))


def fit(rows: DataFrame, columns: list[str], k: int = 3, iterations: int = 100, tolerance: float = 1e-4, ridge: float = 1e-3, size: int = BLOCK, model: Model | None = None) -> Model:
    """The model after expectation and maximisation, at most `iterations` times, until the log likelihood of a row grows by less than `tolerance`. rows: symbol, seq and columns.

    ridge is added to the variances each time; with 0 the log likelihood never falls. A fixed number of sums reaches the driver.
    """
    rows = rows.dropna(subset=columns)
    model = model or start(rows, columns, k)
    d, history = len(columns), []
    cut = blocks(rows, columns, size).persist()
    try:
        for _ in range(iterations):
            ends = _ends(cut, model, False).persist()
            ahead, back = _passes(ends, model, False)
            both = cut.join(ahead, ["symbol", "block"]).join(back, ["symbol", "block"])

            def summed(pdfs, model=model):
                total = None
                for pdf in _chunks(pdfs):
                    own = np.append(_sums(pdf, model), pdf["total"].to_numpy()[pdf["last"].to_numpy()].sum())
                    total = own if total is None else total + own
                if total is not None:
                    yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

            total = np.array([r[1] for r in both.mapInPandas(summed, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
            ends.unpersist()
            if not len(total):
                raise ValueError("there are no rows to fit")
            total, likelihood = total[:-1], total[-1]
            history.append(float(likelihood))
            n = total[k + 1]
            if len(history) > 1 and history[-1] - history[-2] < tolerance * n:
                break
            starts, xi, weight, mean, square = np.split(total, np.cumsum([k + 2, k * k, k, k * d]))
            mean = mean.reshape(k, d) / np.maximum(weight, 1e-10)[:, None]
            cov = square.reshape(k, d, d) / np.maximum(weight, 1e-10)[:, None, None] - mean[:, :, None] * mean[:, None, :]
            xi = xi.reshape(k, k)
            model = Model(starts[:k] / starts[k], xi / np.maximum(xi.sum(1, keepdims=True), 1e-10), mean, cov + ridge * np.eye(d))
    finally:
        cut.unpersist()
    model.log_likelihood = tuple(history)
    return model


def decode(rows: DataFrame, columns: list[str], model: Model, size: int = BLOCK) -> DataFrame:
    """symbol, seq, filtered (the likeliest state given the rows so far) and p_filtered, smoothed (given all rows) and p_smoothed, and path (of the likeliest sequence of states).

    Where two sequences are equally likely, path may take states from both. Rows with a null in `columns` are left out.
    """
    cut = blocks(rows, columns, size)

    both = cut
    for best, ahead_, back_ in ((False, "ahead", "back"), (True, "best_ahead", "best_back")):
        ahead, back = _passes(_ends(cut, model, best), model, best)
        both = both.join(ahead.select("symbol", "block", F.col("ahead").alias(ahead_)), ["symbol", "block"]).join(back.select("symbol", "block", F.col("back").alias(back_)), ["symbol", "block"])

    def states(pdfs):
        for pdf in _chunks(pdfs):
            alpha, beta, _, real, _ = _within(pdf, model, False)
            gamma = alpha * beta
            gamma /= gamma.sum(-1, keepdims=True)
            best_alpha, best_beta, *_ = _within(pdf.assign(ahead=pdf["best_ahead"], back=pdf["best_back"]), model, True)
            found = {"filtered": alpha.argmax(-1), "p_filtered": alpha.max(-1), "smoothed": gamma.argmax(-1), "p_smoothed": gamma.max(-1), "path": (best_alpha * best_beta).argmax(-1)}
            yield pd.DataFrame({"symbol": np.repeat(pdf["symbol"].to_numpy(), real.sum(1)), "seq": np.concatenate(list(pdf["seqs"])), **{n: c[real] for n, c in found.items()}})

    return both.mapInPandas(states, "symbol string, seq long, filtered int, p_filtered double, smoothed int, p_smoothed double, path int")


def parameters(spark, model: Model) -> DataFrame:
    """A row for each state: state, name, pi, moves, means, covariances (row by row), log_likelihood (the last) and iterations."""
    last = model.log_likelihood[-1] if model.log_likelihood else None
    rows = [(i, model.names()[i], float(model.pi[i]), model.moves[i].tolist(), model.means[i].tolist(), model.covs[i].ravel().tolist(), last, len(model.log_likelihood)) for i in range(len(model.pi))]
    return spark.createDataFrame(rows, "state int, name string, pi double, moves array<double>, means array<double>, covariances array<double>, log_likelihood double, iterations int")


def stationary(transitions: DataFrame) -> DataFrame:
    """symbol, state and share: the long-run share of each state of a table of moves (symbol, from_state, to_state, p); a group is a key's k x k table."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        states = sorted(set(pdf["from_state"]) | set(pdf["to_state"]))
        at = {s: i for i, s in enumerate(states)}
        m = np.zeros((len(states), len(states)))
        m[[at[s] for s in pdf["from_state"]], [at[s] for s in pdf["to_state"]]] = pdf["p"]
        lost = m.sum(1) == 0
        m[lost, lost] = 1  # a state that nothing leaves keeps what it has
        equations = np.vstack([m.T - np.eye(len(states)), np.ones(len(states))])
        share = np.linalg.lstsq(equations, np.append(np.zeros(len(states)), 1.0), rcond=None)[0]
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "state": states, "share": share})

    kind = transitions.schema["from_state"].dataType.simpleString()
    return transitions.groupBy("symbol").applyInPandas(solve, f"symbol string, state {kind}, share double")
