"""Ledgers whose exits have no horizon, and sizes that follow from completed trades.

An exit condition of a bar depends on the held direction alone, so each candidate entry's exit is the next bar at which
its side's condition holds. Next bars are found in blocks: inside a block by a window, beyond it from a table with one
row for each block. So there is one row for each candidate, however far its exit is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import chain
from .rules import fill_price, net_pnl
from .windows import by_seq, so_far

BLOCK = 4_096


def next_events(df: DataFrame, events: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with, for each name, the seq of the first later row at which its condition holds (null: none)."""
    rows = df.withColumns({f"_{n}": F.when(c, F.col("seq")) for n, c in events.items()}).withColumn("_block", F.floor(F.col("seq") / block))
    later = Window.partitionBy("symbol", "_block").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_in_{n}": F.min(f"_{n}").over(later) for n in events})
    firsts = rows.groupBy("symbol", "_block").agg(*[F.min(f"_{n}").alias(f"_first_{n}") for n in events])
    beyond = Window.partitionBy("symbol").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select("symbol", "_block", *[F.min(f"_first_{n}").over(beyond).alias(f"_after_{n}") for n in events])
    found = rows.join(after, ["symbol", "_block"]).withColumns({n: F.coalesce(f"_in_{n}", f"_after_{n}") for n in events})
    return found.select(*df.columns, *events)


def _trades(bars: DataFrame, candidates: DataFrame, slip: Column, fee: float) -> DataFrame:
    """Prices and results of candidates (symbol, entry_seq, exit_seq, direction), by slip at either bar. bars: exit_price and reason as of a long and a short."""
    ins = bars.select("symbol", F.col("seq").alias("entry_seq"), F.col("open").alias("_in"), slip.alias("_slip_in"))
    outs = bars.select("symbol", F.col("seq").alias("exit_seq"), "_out_long", "_out_short", "_why_long", "_why_short", slip.alias("_slip_out"))
    both = candidates.join(ins, ["symbol", "entry_seq"]).join(outs, ["symbol", "exit_seq"])
    long = F.col("direction") > 0
    both = both.withColumns({"entry_price": fill_price(F.col("_in"), F.col("direction"), F.col("_slip_in")), "exit_price": fill_price(F.when(long, F.col("_out_long")).otherwise(F.col("_out_short")), F.col("direction"), F.col("_slip_out"), entry=False), "reason": F.when(long, F.col("_why_long")).otherwise(F.col("_why_short"))})
    both = both.withColumns({"pnl": net_pnl(F.col("entry_price"), F.col("exit_price"), F.col("direction"), fee), "holding_bars": F.col("exit_seq") - F.col("entry_seq")})
    return both.select("symbol", "entry_seq", "exit_seq", "direction", "entry_price", "exit_price", "reason", "pnl", "holding_bars")


def signal_candidates(df: DataFrame, signal: str, slip: Column | None = None, fee: float = 0.0004, block: int = BLOCK) -> DataFrame:
    """A trade for each row with a signal of 1 or -1: in at the next bar's open, out at the open of the bar after the first later row with the opposite signal. 0 and null hold. A row without such an exit gives none."""
    before = F.coalesce(F.lag(signal).over(by_seq()), F.lit(0))
    bars = df.withColumns({"_out_long": F.col("open"), "_out_short": F.col("open"), "_why_long": F.lit("signal"), "_why_short": F.lit("signal"), "_before": before})
    bars = next_events(bars, {"_end_long": F.col("_before") == -1, "_end_short": F.col("_before") == 1}, block)
    own = bars.where("_before != 0").select("symbol", F.col("seq").alias("entry_seq"), F.when(F.col("_before") == 1, F.col("_end_long")).otherwise(F.col("_end_short")).alias("exit_seq"), F.col("_before").cast("int").alias("direction")).where("exit_seq IS NOT NULL")
    return _trades(bars, own, slip if slip is not None else F.lit(0.0), fee)


def signal_trades(candidates: DataFrame) -> DataFrame:
    """Those of signal_candidates that are taken: a trade turns at the open at which the one before ends."""
    return chain(candidates, turning=True)


def stop_candidates(df: DataFrame, signal: str, stop: str, slip: Column | None = None, fee: float = 0.0004, block: int = BLOCK) -> DataFrame:
    """A trade for each row with a signal: in at the next bar's open; out on a later bar that touches its stop price (reason sl, at the stop), or else follows a row whose signal is opposite, 0 or null (reason signal, at that bar's stop price where it is within 0 and 1e17, as a hint, else at its open)."""
    before = F.coalesce(F.lag(signal).over(by_seq()), F.lit(0))
    level = F.coalesce(F.col(stop), F.lit(0.0))
    hinted = F.when((level > 0) & (level < 1e17), level).otherwise(F.col("open"))
    hit_long, hit_short = (level > 0) & (F.col("low") <= level), (level > 0) & (F.col("high") >= level)
    bars = df.withColumns({
        "_before": before,
        "_hit_long": hit_long,
        "_hit_short": hit_short,
        "_out_long": F.when(hit_long, level).otherwise(hinted),
        "_out_short": F.when(hit_short, level).otherwise(hinted),
        "_why_long": F.when(hit_long, "sl").otherwise("signal"),
        "_why_short": F.when(hit_short, "sl").otherwise("signal"),
    })
    bars = next_events(bars, {"_end_long": F.col("_hit_long") | (F.col("_before") != 1), "_end_short": F.col("_hit_short") | (F.col("_before") != -1)}, block)
    own = bars.where("_before != 0").select("symbol", F.col("seq").alias("entry_seq"), F.when(F.col("_before") == 1, F.col("_end_long")).otherwise(F.col("_end_short")).alias("exit_seq"), F.col("_before").cast("int").alias("direction")).where("exit_seq IS NOT NULL")
    return _trades(bars, own, slip if slip is not None else F.lit(0.0), fee)


def stop_trades(candidates: DataFrame) -> DataFrame:
    """Those of stop_candidates that are taken: none is entered on the bar that ends the one before, and none turns."""
    return chain(candidates)


def kelly_size(df: DataFrame, signal: str, uncertainty: str, window: int = 1000, least: float = 0.1, most: float = 3.0) -> DataFrame:
    """df with kelly_trades, kelly_win_rate, kelly_payoff and kelly_size.

    A trade is a run of rows with one nonzero signal; it ends at the close of the first row after the run. For row i
    those count that end within rows (i - window, i); one that was open at row i - window counts from that row's close.
    Half of win rate - (1 - win rate) / payoff, within 0 and 1, is taken; 0.25 with fewer than five trades, or without
    wins or losses. It is scaled by the mean uncertainty of the last 101 rows over the row's own, within 0.5 and 2, and
    moves the size from `least` to `most`. The first `window` rows have the middle of both, and null counts.

    Running sums of ended trades are taken off each other, so a window's length costs nothing.
    """
    w = by_seq()
    sig = F.coalesce(F.col(signal), F.lit(0))
    rows = df.withColumns({"_n": F.row_number().over(w), "_s": sig, "_c": F.coalesce(F.lag(sig).over(w), F.lit(0))})
    begins = F.when((F.col("_s") != 0) & (F.col("_s") != F.col("_c")), F.struct(F.col("close").alias("p"), F.col("_n").alias("n")))
    rows = rows.withColumn("_start", F.last(begins, ignorenulls=True).over(so_far()))
    # the run before this row, if it ends here
    ended = (F.col("_c") != 0) & (F.col("_s") != F.col("_c"))
    rows = rows.withColumn("_from", F.when(ended, F.lag("_start").over(w))).withColumn("_ret", F.when(ended, F.col("_c") * (F.col("close") - F.col("_from.p")) / F.col("_from.p")))
    sums = {"_t": F.col("_ret").isNotNull(), "_w": F.col("_ret") > 0, "_l": F.col("_ret") < 0}
    rows = rows.withColumns({n: F.sum(F.coalesce(c.cast("int"), F.lit(0))).over(so_far()) for n, c in sums.items()} | {f"{n}r": F.sum(F.when(sums[n], F.col("_ret")).otherwise(0.0)).over(so_far()) for n in ("_w", "_l")})
    # where each row's open run ends, and at which price
    marks = rows.select("*", F.when(ended, F.struct(F.col("_n").alias("n"), F.col("close").alias("p"), F.col("_ret").alias("r"))).alias("_end"))
    later = Window.partitionBy("symbol").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.withColumn("_next", F.when(F.col("_s") != 0, F.last("_end", ignorenulls=True).over(later)))
    at = F.struct("_t", "_w", "_l", "_wr", "_lr", "_s", F.col("_start.n").alias("n0"), "_n", "close", "_next")
    rows = rows.withColumns({"_a": F.lag(at, window).over(w), "_b": F.lag(F.struct("_t", "_w", "_l", "_wr", "_lr"), 1).over(w)})
    # the trade that was open `window` rows before and ended since counts from there
    cut_ = (F.col("_a._s") != 0) & (F.col("_a.n0") < F.col("_a._n")) & (F.col("_a._next.n") < F.col("_n"))
    part = F.col("_a._s") * (F.col("_a._next.p") - F.col("_a.close")) / F.col("_a.close")
    whole = F.col("_a._next.r")
    swap = lambda test: F.when(cut_, test(part).cast("int") - test(whole).cast("int")).otherwise(0)
    moved = lambda test: F.when(cut_, F.when(test(part), part).otherwise(0.0) - F.when(test(whole), whole).otherwise(0.0)).otherwise(0.0)
    won, lost = (lambda x: x > 0), (lambda x: x < 0)
    rows = rows.withColumns({
        "_trades": F.col("_b._t") - F.col("_a._t"),
        "_wins": F.col("_b._w") - F.col("_a._w") + swap(won),
        "_losses": F.col("_b._l") - F.col("_a._l") + swap(lost),
        "_win_sum": F.col("_b._wr") - F.col("_a._wr") + moved(won),
        "_loss_sum": F.col("_b._lr") - F.col("_a._lr") + moved(lost),
    })
    rate = F.col("_wins") / F.col("_trades")
    payoff = F.col("_win_sum") / F.col("_wins") / (-F.col("_loss_sum") / F.col("_losses") + 1e-10)
    enough = (F.col("_trades") >= 5) & (F.col("_wins") > 0) & (F.col("_losses") > 0)
    raw = F.when(enough, F.least(F.lit(1.0), F.greatest(F.lit(0.0), rate - (1 - rate) / (payoff + 1e-10))) / 2).otherwise(0.25)
    near = F.avg(uncertainty).over(w.rowsBetween(-100, 0)) / (F.col(uncertainty) + 1e-10)
    scaled = least + (most - least) * raw * F.least(F.lit(2.0), F.greatest(F.lit(0.5), near))
    started = F.col("_n") > window
    size = F.when(started, F.least(F.lit(most), F.greatest(F.lit(least), scaled))).otherwise((least + most) / 2)
    rows = rows.withColumns({"kelly_trades": F.when(started, F.col("_trades")), "kelly_win_rate": F.when(started & enough, rate), "kelly_payoff": F.when(started & enough, payoff), "kelly_size": size})
    return rows.select(*df.columns, "kelly_trades", "kelly_win_rate", "kelly_payoff", "kelly_size")


def marked_equity(bars: DataFrame, trades: DataFrame, capital: float = 100_000.0, risk: float = 1.0, compounding: bool = False, size: str | None = None) -> DataFrame:
    """bars with realised and equity: capital after the trades that have ended, and with the open one marked at the close; 0 from the first bar on which it is 0 or less.

    trades don't overlap: symbol, entry_seq, exit_seq, direction, entry_price, pnl, and perhaps a size (1 where null or not
    above 0). Each puts risk * size of the capital at stake: of the first capital, or with compounding of what there is. On
    the bar that ends a trade only what is realised counts.
    """
    stake = risk * (F.when(F.col(size) > 0, F.col(size)).otherwise(1.0) if size else F.lit(1.0))
    own = trades.withColumn("_stake", stake)
    begun = own.select("symbol", F.col("entry_seq").alias("seq"), F.struct(F.col("exit_seq").alias("until"), F.col("direction").alias("d"), F.col("entry_price").alias("p"), F.col("_stake").alias("k")).alias("_open"))
    ended = own.select("symbol", F.col("exit_seq").alias("seq"), (F.col("pnl") * F.col("_stake")).alias("_done"))
    rows = bars.join(begun, ["symbol", "seq"], "left").join(ended, ["symbol", "seq"], "left")
    gain = F.coalesce("_done", F.lit(0.0))
    whole = F.lit(capital)
    if compounding:
        # a factor of 0 or less ends the account, which the latch sees; its logarithm is never taken
        realised = whole * F.exp(F.sum(F.log(F.greatest(1 + gain, F.lit(1e-300)))).over(so_far()))
        realised = F.when(F.min(1 + gain).over(so_far()) <= 0, 0.0).otherwise(realised)
    else:
        realised = whole + whole * F.sum(gain).over(so_far())
    rows = rows.withColumns({"realised": realised, "_held": F.last("_open", ignorenulls=True).over(so_far())})
    held = F.col("_done").isNull() & (F.col("seq") < F.col("_held.until"))
    move = F.col("_held.d") * (F.col("close") - F.col("_held.p")) / F.col("_held.p") * F.col("_held.k")
    marked = F.col("realised") + (F.col("realised") if compounding else whole) * move
    rows = rows.withColumn("equity", F.when(held, marked).otherwise(F.col("realised")))
    gone = F.max((F.least("equity", "realised") <= 0).cast("int")).over(so_far())
    return rows.withColumn("_gone", gone).withColumns({c: F.when(F.col("_gone") == 1, 0.0).otherwise(F.col(c)) for c in ("realised", "equity")}).select(*bars.columns, "realised", "equity")


def ledger_report(trades: DataFrame) -> DataFrame:
    """By symbol: trades, win rate, mean pnl and holding, gross profit and loss, profit factor (infinite without losses), and the number of exits by TP, SL and TIMEOUT, whatever the case."""
    pnl, why = F.col("pnl"), F.upper("reason")
    out = trades.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.avg((pnl > 0).cast("double")).alias("win_rate"),
        F.avg(pnl).alias("avg_pnl"),
        F.avg(F.col("exit_seq") - F.col("entry_seq")).alias("avg_hold"),
        F.sum(F.greatest(pnl, F.lit(0.0))).alias("gross_profit"),
        (-F.sum(F.least(pnl, F.lit(0.0)))).alias("gross_loss"),
        *[F.count_if(why == c).alias(f"n_{c.lower()}") for c in ("TP", "SL", "TIMEOUT")],
    )
    return out.withColumn("profit_factor", F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")).when(F.col("gross_profit") > 0, float("inf")).otherwise(0.0))
