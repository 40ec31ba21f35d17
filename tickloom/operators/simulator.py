"""A cost-aware portfolio simulator: one Arrow group per episode, a short loop over its steps.

Input rows: episode, step, prices (array), actions (array of logits, one per ticker). An action is what a policy decides
on at the step; with_policy() adds the column from an Arrow function over any state columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import CAT_PER_SHARE, SEC_PER_DOLLAR, TAF_CAP, TAF_PER_SHARE

STEPS = "episode {0}, step bigint, pv double, cash double, reward double, turnover double, n_trades int, n_round_trips int, n_wins int, fees double, shares array<double>, weights array<double>"


@dataclass(frozen=True)
class Costs:
    cash: float = 100_000.0
    spread: float = 0.02
    slippage: float = 0.0005
    deadband: float = 0.02
    reserve: float = 0.99
    to_the_penny: bool = True


def fees(side: str, shares: float, notional: float, to_the_penny: bool) -> float:
    up = (lambda x: math.ceil(x * 100) / 100) if to_the_penny else (lambda x: x)
    cat = shares * CAT_PER_SHARE
    return cat if side == "buy" else cat + up(notional * SEC_PER_DOLLAR) + min(up(shares * TAF_PER_SHARE), TAF_CAP)


class Book:
    """Cash, shares and average entry prices of a portfolio."""

    def __init__(self, n: int, costs: Costs):
        self.costs, self.cash = costs, costs.cash
        self.shares, self.entry = np.zeros(n), np.zeros(n)
        self.paid, self.traded, self.trades, self.round_trips, self.wins = 0.0, 0.0, 0, 0, 0

    def value(self, prices: np.ndarray) -> float:
        return self.cash + float(self.shares @ prices)

    def sell(self, i: int, shares: float, price: float) -> None:
        shares = min(shares, self.shares[i])
        if shares <= 0:
            return
        at = price - (self.costs.spread / 2 + price * self.costs.slippage)
        fee = fees("sell", shares, shares * at, self.costs.to_the_penny)
        self.cash += shares * at - fee
        self.shares[i] -= shares
        self._count(fee, shares * at)
        if self.shares[i] <= 1e-9:
            self.shares[i] = 0.0
            self.round_trips += 1
            self.wins += at > self.entry[i]

    def buy(self, i: int, amount: float, price: float) -> None:
        at = price + (self.costs.spread / 2 + price * self.costs.slippage)
        shares = amount / at
        if shares <= 0:
            return
        fee = fees("buy", shares, amount, self.costs.to_the_penny)
        self.entry[i] = (self.entry[i] * self.shares[i] + at * shares) / (self.shares[i] + shares)
        self.cash -= amount + fee
        self.shares[i] += shares
        self._count(fee, amount)

    def _count(self, fee: float, amount: float) -> None:
        self.paid += fee
        self.traded += amount
        self.trades += 1

    def rebalance(self, weights: np.ndarray, prices: np.ndarray) -> None:
        """Towards the weights: moves under the deadband are left, sales come first, purchases share the cash there is."""
        total = self.value(prices)
        move = weights * total - self.shares * prices
        move[np.abs(move) < self.costs.deadband * total] = 0
        for i in np.flatnonzero(move < 0):
            self.sell(i, -move[i] / prices[i], prices[i])
        want = np.maximum(move, 0)
        if (need := want.sum()) > 0:
            want *= min(1.0, max(0.0, self.cash * self.costs.reserve) / need)
            for i in np.flatnonzero(want > 0):
                self.buy(i, want[i], prices[i])


def softmax(logits: np.ndarray) -> np.ndarray:
    """Weights, with a cash logit of 0 that takes its share."""
    top = max(0.0, logits.max())
    e = np.exp(logits - top)
    return e / (e.sum() + math.exp(-top))


def run_episode(frame: pd.DataFrame, costs: Costs) -> pd.DataFrame:
    frame = frame.sort_values("step", kind="stable")
    prices, actions = np.array(frame["prices"].tolist(), float), np.array(frame["actions"].tolist(), float)
    book, before, rows = Book(prices.shape[1], costs), costs.cash, []
    for k, (p, a) in enumerate(zip(prices, actions, strict=True)):
        traded, count = book.traded, book.trades
        weights = softmax(a)
        if k == len(prices) - 1:  # everything is sold at the end
            for i in range(len(p)):
                book.sell(i, book.shares[i], p[i])
        else:
            book.rebalance(weights, p)
        pv = book.value(p)
        reward = max(-10.0, min(10.0, 100 * (pv / before - 1)))
        rows.append((pv, book.cash, reward, (book.traded - traded) / before, book.trades - count, book.round_trips, book.wins, book.paid, book.shares.tolist(), weights.tolist()))
        before = pv
    out = pd.DataFrame(rows, columns=["pv", "cash", "reward", "turnover", "n_trades", "n_round_trips", "n_wins", "fees", "shares", "weights"])
    out.insert(0, "step", frame["step"].to_numpy())
    out.insert(0, "episode", frame["episode"].to_numpy())
    return out


def simulate(steps: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per (episode, step) after its trades."""
    kind = steps.schema["episode"].dataType.simpleString()
    return steps.select("episode", "step", "prices", "actions").groupBy("episode").applyInPandas(lambda f: run_episode(f, costs), STEPS.format(kind))


def with_policy(steps: DataFrame, policy: Callable[[pd.DataFrame], pd.Series], state: list[str]) -> DataFrame:
    """steps with actions from a function of Arrow batches of state columns."""

    @F.pandas_udf("array<double>")
    def act(s: pd.DataFrame) -> pd.Series:
        return policy(s)

    return steps.withColumn("actions", act(F.struct(*state)))


def target_position(state: tuple[float, float], price: float, target: float, costs: Costs, whole_shares: bool = False, deadband: float = 0.07) -> tuple[float, float]:
    """(cash, shares) after moving one position to a share `target` (0 to 1) of its portfolio's value."""
    book = Book(1, costs)
    book.cash, book.shares[0] = state
    total = book.value(np.array([price]))
    move = target * total - book.shares[0] * price
    if whole_shares:
        move = math.trunc(move / price) * price
    if abs(move) >= deadband * total and move:
        book.sell(0, -move / price, price) if move < 0 else book.buy(0, min(move, book.cash * costs.reserve), price)
    return book.cash, float(book.shares[0])


def delta_action(state: tuple[float, float], price: float, delta: int, costs: Costs) -> tuple[float, float]:
    """(cash, shares) after buying (delta > 0) or selling shares, masked to what cash and position allow."""
    book = Book(1, costs)
    book.cash, book.shares[0] = state
    at = price + costs.spread / 2 + price * costs.slippage
    allowed = max(-int(book.shares[0]), min(delta, int(book.cash * costs.reserve / at)))
    book.sell(0, -allowed, price) if allowed < 0 else book.buy(0, allowed * at, price)
    return book.cash, float(book.shares[0])


def episode_info(run: DataFrame) -> DataFrame:
    """Ratios per episode: Sharpe and Sortino (held within 3, then per year), Calmar (within 10), profit factor, win rate, turnover."""
    from tickloom.functions.scalars import clipped
    from tickloom.operators.metrics import curve_returns

    r = curve_returns(run.withColumn("curve", F.col("episode")))
    x = F.col("r")
    by = r.groupBy("episode").agg(
        F.avg(x).alias("m"), F.stddev_pop(x).alias("sd"), F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2)))).alias("down"), F.max("dd").alias("max_drawdown"),
        F.sum(F.greatest("pnl", F.lit(0.0))).alias("gain"), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0))).alias("loss"), F.sum("turnover").alias("turnover"),
        F.max("n_round_trips").alias("round_trips"), F.max("n_wins").alias("wins"), F.min_by("pv", "step").alias("a"), F.max_by("pv", "step").alias("b"),
    )
    year = math.sqrt(252)
    return by.select(
        "episode", (clipped(F.try_divide("m", "sd"), -3, 3) * year).alias("sharpe"), (clipped(F.try_divide("m", "down"), -3, 3) * year).alias("sortino"),
        clipped(F.try_divide(F.col("b") / F.col("a") - 1, "max_drawdown"), -10, 10).alias("calmar"), "max_drawdown", F.try_divide("gain", "loss").alias("profit_factor"),
        F.coalesce(F.try_divide("wins", "round_trips"), F.lit(0.5)).alias("win_rate"), "turnover",
    )
