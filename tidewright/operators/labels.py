"""Forward-looking labels, trade ledgers and equity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import fee_trap, round_trip_cost, slippage
from .windows import by_seq, next_rows, so_far


def forward_pairs(anchors: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Each anchor (symbol, seq, ...) with the bars of seq + 1 ... seq + horizon, as columns of struct b.

    An equi-join on blocks of `horizon` bars: an anchor meets its own block and the next, so no symbol lands in one task
    and no pair outside two blocks is looked at.
    """
    left = anchors.withColumn("_block", F.explode(F.array(F.floor(F.col("seq") / horizon), F.floor(F.col("seq") / horizon) + 1)))
    right = bars.select("symbol", F.floor(F.col("seq") / horizon).alias("_block"), F.struct(*bars.columns).alias("b"))
    return left.join(right, ["symbol", "_block"]).where((F.col("b.seq") > F.col("seq")) & (F.col("b.seq") <= F.col("seq") + horizon)).drop("_block")


def first_touch(df: DataFrame, sigma: str, pt: float, sl: float, horizon: int, tie_by_time: bool = False, scale: bool = True) -> DataFrame:
    """Triple-barrier labels of each bar with a whole horizon ahead and a positive sigma: label, ret and exit_seq.

    The first bar that touches a barrier decides. Where one bar touches both, the sign of its close against the entry
    does; without a touch the label is 0 at the last bar's close.
    """
    factor = F.lit(float(horizon) ** 0.5 if scale else 1.0)
    rows = df.withColumn("_last", F.max("seq").over(Window.partitionBy("symbol")))
    anchors = rows.where((F.col("seq") + horizon <= F.col("_last")) & (F.col(sigma) > 0)).select("symbol", "seq", F.col("close").alias("entry"), (F.col("close") * (1 + pt * F.col(sigma) * factor)).alias("up"), (F.col("close") * (1 - sl * F.col(sigma) * factor)).alias("down"))
    pairs = forward_pairs(anchors, df.select("symbol", "seq", "high", "low", "close"), horizon)
    up, down = F.col("b.high") >= F.col("up"), F.col("b.low") <= F.col("down")
    hit = F.when(up | down, F.struct(F.col("b.seq").alias("at"), up.alias("up"), down.alias("down"), F.col("b.close").alias("close"), F.col("up").alias("up_level"), F.col("down").alias("down_level")))
    out = pairs.groupBy("symbol", "seq", "entry").agg(F.min(hit).alias("hit"), F.max_by("b.close", "b.seq").alias("end_close"), F.max("b.seq").alias("end_seq"))
    both = F.signum(F.col("hit.close") - F.col("entry")).cast("int")
    label = F.when(F.col("hit").isNull(), 0).when(F.col("hit.up") & F.col("hit.down"), both).when(F.col("hit.up"), 1).otherwise(-1)
    exit_price = F.when(F.col("hit").isNull(), F.col("end_close")).when(label == 1, F.col("hit.up_level")).when(label == -1, F.col("hit.down_level")).otherwise(F.col("hit.close"))
    return out.select("symbol", "seq", label.alias("label"), (exit_price / F.col("entry") - 1).alias("ret"), F.coalesce("hit.at", "end_seq").alias("exit_seq"))


def hybrid_labels(df: DataFrame, sigma: str, pt: float = 1.0, sl: float = 1.0, hours: int = 48, most: int = 20, ts: str = "bar_ts") -> DataFrame:
    """symbol, seq, label, ret and exit_seq of barriers on closes, whose end is what comes first: the first bar `hours` later, or the `most`-th bar, or the last bar there is.

    The first close at or beyond a barrier decides (1 above, -1 below); without one the label is 0 at the end's close. A
    bar without a positive sigma, or with none after it, has no label.
    """
    rows = df.withColumn("_before", F.lag(ts).over(by_seq()))
    anchors = rows.where(F.col(sigma) > 0).select("symbol", "seq", F.col("close").alias("entry"), (F.col(ts) + F.expr(f"INTERVAL {hours} HOURS")).alias("until"), (F.col("close") * (1 + pt * F.col(sigma))).alias("up"), (F.col("close") * (1 - sl * F.col(sigma))).alias("down"))
    # a bar is within reach if the one before it is earlier than the time limit
    pairs = forward_pairs(anchors, rows.select("symbol", "seq", "close", "_before"), most).where(F.col("b._before") < F.col("until"))
    side = F.when(F.col("b.close") >= F.col("up"), 1).when(F.col("b.close") <= F.col("down"), -1)
    hit = F.when(side.isNotNull(), F.struct(F.col("b.seq").alias("at"), side.alias("side"), F.col("b.close").alias("close")))
    out = pairs.groupBy("symbol", "seq", "entry").agg(F.min(hit).alias("hit"), F.max("b.seq").alias("end"), F.max_by("b.close", "b.seq").alias("end_close"))
    return out.select("symbol", "seq", F.coalesce("hit.side", F.lit(0)).alias("label"), (F.coalesce("hit.close", "end_close") / F.col("entry") - 1).alias("ret"), F.coalesce("hit.at", "end").alias("exit_seq"))


def patch_masks(windows: DataFrame, column: str, patch: int = 16, ratio: float = 0.4, seed: int = 42, key: tuple[str, ...] = ("symbol", "seq")) -> DataFrame:
    """windows with masked (the patches of each row's array that are hidden, in order), and the array itself with those patches set to 0.

    Of n patches floor(n * ratio) are hidden: those whose md5 of seed, key and number comes first. So a row's patches
    depend on the seed and its key alone, not on where it is computed. An array that isn't whole patches long gives null.
    """
    n = F.when(F.size(column) % patch == 0, F.floor(F.size(column) / patch).cast("int"))
    order = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], p.cast("string")).cast("binary")).alias("h"), p.alias("p")))
    hidden = F.array_sort(F.transform(F.slice(F.array_sort(order), 1, F.floor(n * ratio).cast("int")), lambda x: x["p"]))
    rows = windows.withColumn("masked", F.when(n >= 1, hidden))
    shown = F.transform(F.col(column), lambda x, i: F.when(F.array_contains("masked", F.floor(i / patch).cast("int")), 0.0).otherwise(x))
    return rows.withColumn(column, F.when(F.col("masked").isNotNull(), shown))


def fee_trapped(labels: DataFrame, sigma: Column, pt: float, share: float = 0.01, buffer: float = 1.5) -> DataFrame:
    """By symbol the labels kept, and those dropped because their target (pt * sigma) doesn't exceed `buffer` times the cost of a round trip of `share` of the average volume."""
    good = F.coalesce(fee_trap(sigma, round_trip_cost(slippage(sigma, F.lit(share), F.lit(1.0))), pt, buffer), F.lit(False))
    return labels.groupBy("symbol").agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


def touch_grid(df: DataFrame, sigma: str, sls: list[float], pts: list[float], horizons: list[int]) -> DataFrame:
    """The labels of first_touch for each stop, target and horizon: symbol, seq, sl, pt, horizon and label.

    Bars are cut into blocks of the longest horizon, and a block's anchors see it and the next, so a task's group has at
    most twice that many rows whatever the symbol. The running extremes after an anchor say at once where each level is
    first reached; the first of an upper and a lower level's bars decides a point of the grid. A horizon takes the anchors
    that have it whole ahead.
    """
    longest = max(horizons)
    rows = df.select("symbol", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")], F.col(sigma).cast("double").alias("sigma"), F.max("seq").over(Window.partitionBy("symbol")).cast("long").alias("last"))
    block = F.floor(F.col("seq") / longest)
    dealt = rows.withColumn("block", F.explode(F.array(block, block - 1)))

    def touched(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        seq, high, low, close, sd, last = (pdf[c].to_numpy() for c in ("seq", "high", "low", "close", "sigma", "last"))
        own = np.flatnonzero((seq // longest == pdf["block"].iloc[0]) & (sd > 0) & (seq + min(horizons) <= last))
        highs = np.lib.stride_tricks.sliding_window_view(np.append(high, np.full(longest, -np.inf)), longest)
        lows = np.lib.stride_tricks.sliding_window_view(np.append(low, np.full(longest, np.inf)), longest)
        closes = np.append(close, np.zeros(longest))
        out = []
        for at in range(0, len(own), 256):
            i = own[at : at + 256]
            up, down = np.maximum.accumulate(highs[i + 1], axis=1), np.minimum.accumulate(lows[i + 1], axis=1)
            for h in horizons:
                whole = seq[i] + h <= last[i]
                unit = sd[i] * float(h) ** 0.5
                ups = [(up < (close[i] * (1 + pt * unit))[:, None]).sum(axis=1) for pt in pts]
                downs = [(down > (close[i] * (1 - sl * unit))[:, None]).sum(axis=1) for sl in sls]
                for sl, d in zip(sls, downs):
                    for pt, u in zip(pts, ups):
                        both = np.sign(closes[np.minimum(i + 1 + u, len(closes) - 1)] - close[i])
                        label = np.where((u >= h) & (d >= h), 0, np.where(u == d, both, np.where(u < d, 1, -1))).astype(np.int32)
                        out.append(pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "seq": seq[i][whole], "sl": float(sl), "pt": float(pt), "horizon": h, "label": label[whole]}))
        found = pd.concat(out) if out else pd.DataFrame({"symbol": [], "seq": [], "sl": [], "pt": [], "horizon": [], "label": []})
        return found.astype({"symbol": object})

    return dealt.groupBy("symbol", "block").applyInPandas(touched, "symbol string, seq long, sl double, pt double, horizon int, label int")


def sniper_labels(df: DataFrame, sigma: str, pt: float = 2.0, sl: float = 1.5, horizon: int = 18, least: float = 0.0045) -> DataFrame:
    """Labels by the first bar of each barrier, which lie at multiples of sigma without scaling by time; 0 where the expected move pt * sigma is below `least`, or nothing is touched.

    Where one bar touches both, the earlier of its high and low decides if df has high_time and low_time, else it is 1.
    """
    timed = {"high_time", "low_time"} <= set(df.columns)
    rows = df.withColumn("_last", F.max("seq").over(Window.partitionBy("symbol")))
    entry, s = F.col("close"), F.col(sigma)
    anchors = rows.where((F.col("seq") + horizon < F.col("_last")) & (s > 0)).select("symbol", "seq", (pt * s < least).alias("low_move"), (entry * (1 + pt * s)).alias("up"), (entry * (1 - sl * s)).alias("down"))
    tie = F.when(F.col("high_time") < F.col("low_time"), 1).otherwise(-1) if timed else F.lit(1)
    pairs = forward_pairs(anchors, df.select("symbol", "seq", "high", "low", tie.alias("tie")), horizon)
    at = F.struct(F.col("b.seq").alias("at"), F.col("b.tie").alias("tie"))
    hits = pairs.groupBy("symbol", "seq", "low_move").agg(F.min(F.when(F.col("b.high") >= F.col("up"), at)).alias("u"), F.min(F.when(F.col("b.low") <= F.col("down"), at)).alias("d"))
    u, d = F.col("u.at"), F.col("d.at")
    label = F.when(F.col("low_move"), 0).when(u == d, F.col("u.tie")).when(u.isNotNull() & (d.isNull() | (u < d)), 1).when(d.isNotNull(), -1).otherwise(0)
    return hits.select("symbol", "seq", label.alias("label"))


def barrier_trades(df: DataFrame, signal: str, sigma: str, pt: float = 2.0, sl: float = 1.0, most: int = 24, slip: float = 0.0001, fee: float = 0.0004) -> DataFrame:
    """The trade of each signal, whether or not another is open: entry_seq, exit_seq, direction, entry_price, exit_price, reason, pnl.

    A signal enters at the next bar's open. From the bar after the entry on, the first that touches the stop or the target
    ends the trade there (SL, TP; a bar that touches both counts as SL unless its times say otherwise), else the close of
    the bar `most` bars after the entry (TIMEOUT), or the last close where bars end before that. A sigma of 0 or less counts as 0.001.
    """
    timed = {"high_time", "low_time"} <= set(df.columns)
    way = F.col(signal)
    s = F.when(F.col(sigma) > 0, F.col(sigma)).otherwise(F.lit(0.001))
    rows = df.withColumns({"_open": F.lead("open").over(by_seq()), "_at": F.lead("seq").over(by_seq())}).where((way != 0) & F.col("_at").isNotNull())
    price = F.col("_open") * (1 + way * slip)
    anchors = rows.select("symbol", F.col("_at").alias("seq"), way.alias("direction"), price.alias("entry_price"), (price * (1 + way * pt * s)).alias("tp"), (price * (1 - way * sl * s)).alias("sl"))
    times = ["high_time", "low_time"] if timed else []
    pairs = forward_pairs(anchors, df.select("symbol", "seq", "high", "low", "close", *times), most)
    long = F.col("direction") > 0
    stop = F.when(long, F.col("b.low") <= F.col("sl")).otherwise(F.col("b.high") >= F.col("sl"))
    target = F.when(long, F.col("b.high") >= F.col("tp")).otherwise(F.col("b.low") <= F.col("tp"))
    first = F.when(long, F.col("b.low_time") <= F.col("b.high_time")).otherwise(F.col("b.high_time") <= F.col("b.low_time")) if timed else F.lit(True)
    hit = F.when(stop | target, F.struct(F.col("b.seq").alias("at"), (stop & (~target | first)).alias("stopped")))
    out = pairs.groupBy("symbol", "seq", "direction", "entry_price", "tp", "sl").agg(F.min(hit).alias("hit"), F.max("b.seq").alias("end"), F.max_by("b.close", "b.seq").alias("end_close"))
    reason = F.when(F.col("hit").isNull(), "TIMEOUT").when(F.col("hit.stopped"), "SL").otherwise("TP")
    level = F.when(F.col("hit").isNull(), F.col("end_close")).when(F.col("hit.stopped"), F.col("sl")).otherwise(F.col("tp"))
    done = out.select("symbol", F.col("seq").alias("entry_seq"), F.coalesce("hit.at", "end").alias("exit_seq"), "direction", "entry_price", (level * (1 - F.col("direction") * slip)).alias("exit_price"), reason.alias("reason"))
    return done.withColumn("pnl", F.col("direction") * (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") - 2 * fee)


def trend_scan(df: DataFrame, windows: list[int]) -> DataFrame:
    """The window whose forward least-squares slope of log close has the largest |t|, and the label by |t| >= 2. Slopes come from running sums, so a row is joined to one row for each window, not to the window's rows."""
    w = so_far()
    y = F.log("close")
    rows = df.select("symbol", "seq", F.sum(y).over(w).alias("s"), F.sum(y * y).over(w).alias("ss"), F.sum(y * F.col("seq")).over(w).alias("sk"), y.alias("y"))
    ends = rows.select("symbol", F.col("seq").alias("end"), F.col("s").alias("s2"), F.col("ss").alias("ss2"), F.col("sk").alias("sk2"))
    tries = rows.withColumn("n", F.explode(F.array(*map(F.lit, windows)))).withColumn("end", F.col("seq") + F.col("n") - 1)
    j = tries.join(ends, ["symbol", "end"])
    n, k0 = F.col("n").cast("double"), F.col("seq") - 1
    sy, syy = F.col("s2") - F.col("s") + F.col("y"), F.col("ss2") - F.col("ss") + F.col("y") * F.col("y")
    sky = F.col("sk2") - F.col("sk") + F.col("y") * F.col("seq") - k0 * sy
    mk, sxx = (n + 1) / 2, n * (n * n - 1) / 12
    sxy = sky - mk * sy
    slope = sxy / sxx
    rss = F.greatest(syy - sy * sy / n - slope * sxy, F.lit(1e-18))
    t = slope / F.sqrt(rss / (n - 2) / sxx)
    best = j.withColumns({"slope": slope, "t": t}).groupBy("symbol", "seq").agg(F.max_by(F.struct("n", "slope", "t"), F.struct(F.abs("t"), -F.col("n"))).alias("x"))
    return best.select("symbol", "seq", F.col("x.n").alias("window"), F.col("x.t").alias("t_value"), F.when(F.col("x.t") >= 2, 1).when(F.col("x.t") <= -2, -1).otherwise(0).alias("label"))


def terciles(df: DataFrame, column: str) -> DataFrame:
    """low, medium or high by the symbol's 33rd and 66th percentile, unknown for null."""
    cuts = df.groupBy("symbol").agg(F.percentile(column, F.array(F.lit(0.33), F.lit(0.66))).alias("_cuts"))
    x = F.col(column)
    label = F.when(x.isNull(), "unknown").when(x <= F.col("_cuts")[0], "low").when(x <= F.col("_cuts")[1], "medium").otherwise("high")
    return df.join(cuts, "symbol").withColumn("vol_regime", label).drop("_cuts")


def context_windows(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The n rows before each row, as an array of structs; rows with fewer are left out."""
    history = F.collect_list(F.struct(*columns)).over(by_seq().rowsBetween(-n, -1))
    return df.withColumn("context", history).where(F.size("context") == n)


def split_temporal(df: DataFrame, test_share: float, gap: int) -> DataFrame:
    """train, purge (the last min(gap, half) rows before the split) or test, by position."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    at = F.floor(n * (1 - test_share))
    return df.withColumn("part", F.when(F.col("seq") > at, "test").when(F.col("seq") > at - F.least(F.lit(gap), F.floor(at / 2)), "purge").otherwise("train"))


def rolling_folds(days: DataFrame, train: int, test: int, step: int, anchored: bool = False) -> DataFrame:
    """fold, train_start, train_end, test_start and test_end by symbol, from its first to its last day; anchored: each trains from the first day. days: symbol, day."""
    ends = days.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    n = F.floor((F.datediff("b", "a") + 1 - train - test) / step)
    rows = ends.where(n >= 0).withColumn("fold", F.explode(F.sequence(F.lit(0), n.cast("int"))))
    start = F.date_add("a", (F.col("fold") * step).cast("int"))
    return rows.select("symbol", "fold", (F.col("a") if anchored else start).alias("train_start"), F.date_add(start, train).alias("train_end"), F.date_add(start, train).alias("test_start"), F.date_add(start, train + test).alias("test_end"))


def spell_trades(df: DataFrame, signal: str) -> DataFrame:
    """A trade for each spell of one nonzero signal, from close to the close where the signal changes (or the last close). Each spell is a group of its own."""
    changed = F.when(F.col(signal) == F.lag(signal).over(by_seq()), 0).otherwise(1)
    rows = df.withColumn("_c", changed).withColumn("_spell", F.sum("_c").over(so_far()))
    rows = rows.withColumns({"_next": F.lead("close").over(by_seq()), "_next_seq": F.lead("seq").over(by_seq())})
    spells = rows.where(F.col(signal) != 0).groupBy("symbol", "_spell").agg(
        F.min("seq").alias("entry_seq"),
        F.min_by("close", "seq").alias("entry_price"),
        F.coalesce(F.max("_next_seq"), F.max("seq")).alias("exit_seq"),
        F.max_by(F.coalesce("_next", "close"), "seq").alias("exit_price"),
        F.first(signal).alias("direction"),
        F.count("*").alias("holding_bars"),
    )
    trade_no = F.row_number().over(Window.partitionBy("symbol").orderBy("entry_seq"))
    pnl = F.col("direction") * (F.col("exit_price") / F.col("entry_price") - 1)
    return spells.withColumns({"trade_no": trade_no, "gross_pnl": pnl}).drop("_spell")


def until_ruin(trades: DataFrame, pnl: str, loss: float = 0.5) -> DataFrame:
    """The trades up to the one by which compounded results have lost more than `loss`, and growth. trades: symbol, trade_no, pnl."""
    w = Window.partitionBy("symbol").orderBy("trade_no")
    grown = trades.withColumn("growth", F.exp(F.sum(F.log(F.greatest(1 + F.col(pnl), F.lit(1e-12)))).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    before = F.min("growth").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return grown.withColumn("_before", before).where(F.coalesce("_before", F.lit(1.0)) >= 1 - loss).drop("_before")


def chain(candidates: DataFrame, turning: bool = False) -> DataFrame:
    """The trades of candidates (symbol, entry_seq, exit_seq, ...) that are taken when one is open at a time: each next entry is the first that isn't inside the open trade; with `turning` it may be on the bar that ends it. A pointer hop over candidates, streamed in order."""

    def run(pdfs):
        key, free = None, -1
        for pdf in pdfs:
            keep = []
            for symbol, a, b in zip(pdf["symbol"], pdf["entry_seq"], pdf["exit_seq"]):
                if symbol != key:
                    key, free = symbol, -1
                keep.append(a > free)
                if a > free:
                    free = b - turning
            yield pdf[keep]

    return candidates.repartition("symbol").sortWithinPartitions("symbol", "entry_seq").mapInPandas(run, candidates.schema)


def equity_curve(df: DataFrame, position: str, start: float = 100_000.0, fee: float = 0.0004) -> DataFrame:
    """Equity by bar of a position taken at the close before, compounded, with a fee on each change of position."""
    held = F.coalesce(F.lag(position).over(by_seq()), F.lit(0))
    ret = F.coalesce(F.col("close") / F.lag("close").over(by_seq()) - 1, F.lit(0.0))
    traded = F.abs(F.col(position) - held)
    df = df.withColumn("bar_pnl", held * ret - fee * traded)
    df = df.withColumn("log_growth", F.sum(F.log(F.greatest(1 + F.col("bar_pnl"), F.lit(1e-12)))).over(so_far()))
    return df.withColumn("equity", start * F.exp("log_growth"))


def future_return(df: DataFrame, n: int) -> Column:
    return F.lead("close", n).over(by_seq()) / F.col("close") - 1


__all__ = ["forward_pairs", "first_touch", "touch_grid", "sniper_labels", "barrier_trades", "trend_scan", "terciles", "context_windows", "split_temporal", "rolling_folds", "spell_trades", "chain", "equity_curve", "future_return", "next_rows"]
