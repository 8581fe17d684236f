"""Ordered automata: what a row gives depends on a state of constant size that earlier rows of its key left.

Everything that doesn't need the state is a Column beforehand. The rows are then dealt out by symbol, sorted by seq, and
read batch by batch; a task holds one batch and one state, however long a symbol's history is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import by_seq, so_far


def ordered(rows: DataFrame, machine: Callable[[], Callable], schema: str) -> DataFrame:
    """symbol, seq and what machine()'s step returns for each row of `rows` (symbol, seq, ...), in order; each symbol has a step of its own. schema: of what step returns."""
    whole = f"symbol string, seq long, {schema}"
    names = [f.split()[0] for f in whole.split(", ")]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = None, None
        for pdf in pdfs:
            out = []
            for symbol, seq, *values in zip(*(pdf[c].tolist() for c in pdf.columns)):
                if step is None or symbol != key:
                    key, step = symbol, machine()
                out.append((symbol, seq, *step(*values)))
            yield pd.DataFrame(out, columns=names).astype(object)

    return rows.repartition("symbol").sortWithinPartitions("symbol", "seq").mapInPandas(run, whole)


def replaced(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with found's columns in place of its own of the same names."""
    return df.drop(*[c for c in found.columns if c not in ("symbol", "seq")]).join(found, ["symbol", "seq"])


def known(x) -> bool:
    return x is not None and x == x


def exp(x: float) -> float:
    """As a Column has it: infinite where it is too large."""
    return math.exp(x) if x < 709.78 else math.inf


def trailing_stop(
    df: DataFrame,
    enter: Column,
    width: Column,
    k_long: Column,
    k_short: Column,
    mae_long: Column,
    mae_short: Column,
    break_long: Column,
    break_short: Column,
    leave_long: Column,
    leave_short: Column,
    size_long: Column | None = None,
    size_short: Column | None = None,
) -> DataFrame:
    """df with position (after the bar: 1, -1, 0), entry_seq, stop, used_k, size, reason and exit_price.

    enter is 1 or -1 where a position may be taken from flat, at the close; a side whose k or MAE is null is not taken. The
    trailing stop is the highest high since entry times exp(-k width) (short: lowest low, exp(k width)) and never moves
    back; k is that of the entry's bar, width the bar's own, and where it is null the stop stays. The hard stop is the
    entry price times exp(-MAE) (short: exp(MAE)), fixed at entry. A later bar leaves by the first that holds: `hard`
    (its low beyond the hard stop), `trail`, `break` (break_long, break_short), `signal` (leave_long, leave_short). The
    first two give the stop as exit_price, the others null. The bar that leaves enters nothing.

    stop is the tighter of both stops while a position is held, and the price of the touched one on a bar that leaves by it.
    """
    one = F.lit(1.0)
    taken = F.when((enter == 1) & k_long.isNotNull() & mae_long.isNotNull(), 1).when((enter == -1) & k_short.isNotNull() & mae_short.isNotNull(), -1).otherwise(0)
    rows = df.select(
        "symbol",
        "seq",
        *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")],
        F.coalesce(taken, F.lit(0)).alias("enter"),
        width.cast("double").alias("width"),
        *[x.cast("double").alias(n) for n, x in (("kl", k_long), ("ks", k_short), ("ml", mae_long), ("ms", mae_short))],
        *[F.coalesce(x, F.lit(False)).alias(n) for n, x in (("bl", break_long), ("bs", break_short), ("ll", leave_long), ("ls", leave_short))],
        (size_long if size_long is not None else one).alias("zl"),
        (size_short if size_short is not None else one).alias("zs"),
        F.col("seq").alias("at"),
    )

    def machine():
        side, entry_seq, extreme, trail, hard, k, size = 0, None, 0.0, 0.0, 0.0, 0.0, 0.0

        def step(high, low, close, enter, width, kl, ks, ml, ms, bl, bs, ll, ls, zl, zs, at):
            nonlocal side, entry_seq, extreme, trail, hard, k, size
            if side == 0:
                if not enter:
                    return 0, None, None, None, None, None, None
                side, entry_seq = int(enter), at
                extreme, k, mae, size = (high, kl, ml, zl) if side > 0 else (low, ks, ms, zs)
                hard = close * exp(-side * mae)
                trail = extreme * exp(-side * k * width) if known(width) else hard
                return side, entry_seq, max(trail, hard) if side > 0 else min(trail, hard), k, size, None, None
            extreme = max(extreme, high) if side > 0 else min(extreme, low)
            if known(width):
                new = extreme * exp(-side * k * width)
                trail = max(trail, new) if side > 0 else min(trail, new)
            beyond = (low < hard, low < trail) if side > 0 else (high > hard, high > trail)
            broken, left = (bl, ll) if side > 0 else (bs, ls)
            reason, price = ("hard", hard) if beyond[0] else ("trail", trail) if beyond[1] else ("break", None) if broken else ("signal", None) if left else (None, None)
            if reason is None:
                return side, entry_seq, max(trail, hard) if side > 0 else min(trail, hard), k, size, None, None
            since, used, side, entry_seq = entry_seq, k, 0, None
            return 0, since, price, used, size, reason, price

        return step

    return replaced(df, ordered(rows, machine, "position int, entry_seq long, stop double, used_k double, size double, reason string, exit_price double"))


def stop_trades(stopped: DataFrame) -> DataFrame:
    """The completed trades of trailing_stop: entry_seq, exit_seq, direction, entry, leave (the stop, or the close), reason and log return."""
    closed = stopped.where("reason IS NOT NULL").select("symbol", "entry_seq", F.col("seq").alias("exit_seq"), "reason", F.coalesce("exit_price", "close").alias("leave"))
    entries = stopped.where("position != 0 AND seq = entry_seq").select("symbol", "entry_seq", F.col("position").alias("direction"), F.col("close").alias("entry"))
    trades = closed.join(entries, ["symbol", "entry_seq"])
    return trades.withColumn("log_return", F.col("direction") * F.log(F.col("leave") / F.col("entry")))


def pyramid(
    df: DataFrame,
    signal: Column,
    variance: Column,
    size: Column | None = None,
    most: int = 3,
    add: float = 1.0,
    spacing: float = 1.5,
    most_size: float = 3.0,
    stop: float | None = 1.5,
) -> DataFrame:
    """df with position, total_size, stop, entries and average_entry (all after the bar) of a position that is added to as it wins.

    From flat a signal of 1 or -1 enters at the close with `size` (1 where null or not above 0). While held, a close beyond
    the last entry's times exp(spacing * root of the variance) in the position's favour adds `add`, up to `most` entries
    and most_size; each entry sets the stop to the average entry times exp(-stop * that root) (short: the other sign;
    None: no stop). A signal that isn't the position's, or a close at or beyond the stop of the bar before, leaves; that
    bar enters nothing. Without a variance nothing is added, and no stop is set.
    """
    rows = df.select("symbol", "seq", F.col("close").cast("double").alias("close"), F.coalesce(signal, F.lit(0)).cast("int").alias("sig"), F.sqrt(variance.cast("double")).alias("sd"), (F.when(size > 0, size).otherwise(1.0) if size is not None else F.lit(1.0)).cast("double").alias("size"))

    def machine():
        side, entries, last, average, units, total, level = 0, 0, 0.0, 0.0, 0.0, 0.0, None

        def stopped_at(sd):
            return average * exp(-side * stop * sd) if stop is not None and known(sd) else level

        def step(close, sig, sd, size):
            nonlocal side, entries, last, average, units, total, level
            if side == 0:
                if not sig:
                    return 0, 0.0, None, 0, None
                side, entries, last, average, units, total, level = sig, 1, close, close, size, size, None
                level = stopped_at(sd)
                return side, min(total, most_size), level, entries, average
            if sig != side or (level is not None and side * (close - level) <= 0):
                side = 0
                return 0, 0.0, None, 0, None
            if entries < most and total < most_size and known(sd) and side * (close - last * exp(side * spacing * sd)) >= 0:
                more = min(add, most_size - total)
                average = (units * average + more * close) / (units + more)
                entries, last, units, total = entries + 1, close, units + more, total + more
                level = stopped_at(sd)
            return side, min(total, most_size), level, entries, average

        return step

    return replaced(df, ordered(rows, machine, "position int, total_size double, stop double, entries int, average_entry double"))


def mode_switch(df: DataFrame, mode: Column, probability: Column, cooldown: int = 5, least: float = 0.6) -> DataFrame:
    """The history of accepted switches: symbol, seq, from_mode, to_mode, bars_since and probability.

    A symbol's first mode is adopted at once. Later a bar's mode is adopted if it differs from the one in force, its
    probability is at least `least`, and at least `cooldown` bars have passed since the last accepted switch. A run of
    likely rows of one mode is adopted at its first row, or at the row at which the cooldown ends, if it lasts that long:
    so what is read in order is one row for each run, not for each bar. Rows without a mode are passed over.
    """
    rows = df.select("symbol", "seq", mode.alias("mode"), probability.alias("probability")).where("mode IS NOT NULL").withColumn("_n", F.row_number().over(by_seq()))
    likely = rows.where((F.col("probability") >= least) | (F.col("_n") == 1))
    w = by_seq()
    # runs of consecutive rows of one mode that are all likely enough
    new = F.when((F.lag("mode").over(w) == F.col("mode")) & (F.lag("seq").over(w) == F.col("seq") - 1), 0).otherwise(1)
    runs = likely.withColumn("_new", new).withColumn("_run", F.sum("_new").over(so_far()))
    runs = runs.groupBy("symbol", "_run", "mode").agg(F.min("seq").alias("seq"), F.max("seq").alias("until"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, last = None, None, None
        for pdf in pdfs:
            out = []
            for symbol, first, until, to in zip(pdf["symbol"].tolist(), pdf["seq"].tolist(), pdf["until"].tolist(), pdf["mode"].tolist()):
                if last is None or symbol != key:
                    key, now, last = symbol, to, first
                    out.append((symbol, first, None, to, None))
                elif to != now and (at := max(first, last + cooldown)) <= until:
                    out.append((symbol, at, now, to, at - last))
                    now, last = to, at
            yield pd.DataFrame(out, columns=["symbol", "seq", "from_mode", "to_mode", "bars_since"]).astype(object)

    kind = rows.schema["mode"].dataType.simpleString()
    ordered_runs = runs.select("symbol", "seq", "until", "mode").repartition("symbol").sortWithinPartitions("symbol", "seq")
    history = ordered_runs.mapInPandas(run, f"symbol string, seq long, from_mode {kind}, to_mode {kind}, bars_since long")
    return history.join(rows.select("symbol", "seq", "probability"), ["symbol", "seq"])


def state_machine(df: DataFrame, moves: list[Column], name: str, start: int = 0, block: int = 4_096) -> DataFrame:
    """df with the state (0 to len(moves) - 1) after each row. moves[s] is the state that a row leads to from state s; null stays.

    A row is a map of states to states, and such maps compose, so a key's rows are cut into blocks: each block's map, then
    one pass over the blocks of a key, then each block again from its own start. All but the pass over blocks is spread
    over tasks, however few keys there are, and every step takes time in proportion to its rows.
    """
    k = len(moves)
    code = sum((F.coalesce(m, F.lit(s)).cast("long") * k**s for s, m in enumerate(moves)), F.lit(0).cast("long"))
    rows = df.select("symbol", "seq", F.floor((F.col("seq") - 1) / block).alias("block"), code.alias("code"))
    digits = lambda c: tuple(c // k**s % k for s in range(k))

    def composed(pdfs):
        at, whole, maps = None, None, {}
        for pdf in pdfs:
            out = []
            for symbol, b, c in zip(pdf["symbol"].tolist(), pdf["block"].tolist(), pdf["code"].tolist()):
                if (symbol, b) != at:
                    if at is not None:
                        out.append((*at, sum(v * k**s for s, v in enumerate(whole))))
                    at, whole = (symbol, b), tuple(range(k))
                if c not in maps:
                    maps[c] = digits(c)
                step = maps[c]
                whole = tuple([step[s] for s in whole])
            yield pd.DataFrame(out, columns=["symbol", "block", "code"])
        if at is not None:
            yield pd.DataFrame([(*at, sum(v * k**s for s, v in enumerate(whole)))], columns=["symbol", "block", "code"])

    def starts(pdfs):
        key, state = None, start
        for pdf in pdfs:
            out = []
            for symbol, b, c in zip(pdf["symbol"].tolist(), pdf["block"].tolist(), pdf["code"].tolist()):
                if symbol != key:
                    key, state = symbol, start
                out.append((symbol, b, state))
                state = c // k**state % k
            yield pd.DataFrame(out, columns=["symbol", "block", "start"])

    def applied(pdfs):
        at, state = None, start
        for pdf in pdfs:
            out = []
            for symbol, seq, b, c, first in zip(*(pdf[n].tolist() for n in ("symbol", "seq", "block", "code", "start"))):
                if (symbol, b) != at:
                    at, state = (symbol, b), first
                state = c // k**state % k
                out.append(state)
            yield pdf[["symbol", "seq"]].assign(**{name: out})

    by_block = rows.repartition("symbol", "block").sortWithinPartitions("symbol", "block", "seq")
    ends = by_block.mapInPandas(composed, "symbol string, block long, code long")
    begun = ends.repartition("symbol").sortWithinPartitions("symbol", "block").mapInPandas(starts, "symbol string, block long, start int")
    again = rows.join(begun, ["symbol", "block"]).repartition("symbol", "block").sortWithinPartitions("symbol", "block", "seq")
    done = again.mapInPandas(applied, f"symbol string, seq long, {name} int")
    return df.join(done.withColumn("seq", F.col("seq").cast(df.schema["seq"].dataType)), ["symbol", "seq"])


def in_force(df: DataFrame, history: DataFrame, name: str = "mode") -> DataFrame:
    """df with the mode of each bar: that of the last switch up to it."""
    marks = df.join(history.select("symbol", "seq", F.col("to_mode").alias("_to")), ["symbol", "seq"], "left")
    return marks.withColumn(name, F.last("_to", ignorenulls=True).over(so_far())).drop("_to")
