"""Alert rules: user expressions compiled to Columns, their contexts, and what becomes of hits."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("threshold", "composite", "indicator", "event")


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    expr: str
    cooldown_min: int = 30
    ticker: str | None = None


@dataclass
class Value:
    """A compiled expression: its value, and whether evaluating it failed (a failure makes the rule false)."""

    column: Column
    error: Column


def _truth(v: Value) -> Column:
    """Truth as in Python: a number is true if it isn't 0, null is false."""
    return F.coalesce(v.column.cast("double") != 0, F.lit(False))


def compile_rule(expr: str, columns: set[str], functions: dict[str, Callable[..., Column]] | None = None) -> Column:
    """A boolean Column for an expression over the named columns: comparisons, and/or/not, arithmetic, ``a if b else c``,
    abs, min, max and the given functions. What would fail at run time (an unknown name, a null operand, a division by
    zero) makes the rule false, but only if it is reached: ``and`` and ``or`` stop as they would in Python. A text that isn't
    such an expression raises ValueError. Lines are joined, so a condition may go on in the next one."""
    try:
        tree = ast.parse(" ".join(expr.split()), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expr!r}") from e
    known = {"abs": F.abs, "min": F.least, "max": F.greatest} | (functions or {})
    no = F.lit(False)

    def numbers(*vs: Value) -> Column:
        """Whether an operand failed or is null."""
        bad = no
        for v in vs:
            bad = bad | v.error | v.column.isNull()
        return bad

    arithmetic = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Mod: lambda a, b: F.try_mod(F.try_mod(a, b) + b, b)}
    compare = {ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a.eqNullSafe(b), ast.NotEq: lambda a, b: ~a.eqNullSafe(b)}

    def build(n: ast.expr) -> Value:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float, bool, str)) or (isinstance(n, ast.Constant) and n.value is None):
            return Value(F.lit(n.value) if n.value is not None else F.lit(None).cast("double"), no)
        if isinstance(n, ast.Name):
            return Value(F.col(n.id), no) if n.id in columns else Value(F.lit(None).cast("double"), F.lit(True))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
            v = build(n.operand)
            return Value(~_truth(v), v.error)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            v = build(n.operand)
            return Value(-v.column if isinstance(n.op, ast.USub) else v.column, numbers(v))
        if isinstance(n, ast.BinOp) and type(n.op) in arithmetic:
            a, b = build(n.left), build(n.right)
            failed = numbers(a, b)
            if isinstance(n.op, (ast.Div, ast.Mod)):
                failed = failed | F.coalesce(b.column == 0, no)
            return Value(arithmetic[type(n.op)](a.column, b.column), failed)
        if isinstance(n, ast.BoolOp):
            stop = isinstance(n.op, ast.Or)
            value, error = None, no
            for part in map(build, n.values):
                if value is None:
                    value, error = _truth(part), part.error
                else:
                    reached = ~value if stop else value
                    error = error | (reached & part.error)
                    value = (value | _truth(part)) if stop else (value & _truth(part))
            return Value(value, error)
        if isinstance(n, ast.Compare) and all(type(o) in compare for o in n.ops):
            vs = [build(n.left), *map(build, n.comparators)]
            value, error = F.lit(True), no
            for op, a, b in zip(n.ops, vs, vs[1:]):
                failed = (a.error | b.error) if isinstance(op, (ast.Eq, ast.NotEq)) else numbers(a, b)
                error = error | (value & failed)
                value = value & F.coalesce(compare[type(op)](a.column, b.column), no)
            return Value(value, error)
        if isinstance(n, ast.IfExp):
            c, a, b = build(n.test), build(n.body), build(n.orelse)
            return Value(F.when(_truth(c), a.column).otherwise(b.column), c.error | F.when(_truth(c), a.error).otherwise(b.error))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and not n.keywords:
            args = list(map(build, n.args))
            if n.func.id not in known:
                return Value(F.lit(None).cast("double"), F.lit(True))
            if n.func.id in ("abs", "min", "max"):
                return Value(known[n.func.id](*(a.column for a in args)), numbers(*args))
            constants = [ast.literal_eval(a) if isinstance(a, ast.Constant) else v.column for a, v in zip(n.args, args)]
            error = no
            for a in args:
                error = error | a.error
            return Value(known[n.func.id](*constants), error)
        raise ValueError(f"not allowed in a rule: {ast.dump(n)[:60]}")

    v = build(tree)
    return F.coalesce(_truth(v) & ~v.error, no)


def validated(rules: list[Rule]) -> list[Rule]:
    """The rules, if all are well formed; one bad rule rejects them all."""
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("rule ids must be unique")
    for r in rules:
        if r.kind not in KINDS or r.cooldown_min < 0:
            raise ValueError(f"bad rule {r.id}")
        compile_rule(r.expr, set())
    return rules


def reloaded(held: list[Rule], text: str) -> list[Rule]:
    """The rules of a changed file (a JSON list of rules, or YAML where that can be read); a bad file keeps those held.

    A stream calls it for each micro-batch, so that rules change while it runs."""
    try:
        try:
            rows = json.loads(text)
        except ValueError:
            import yaml

            try:
                rows = yaml.safe_load(text)
            except yaml.YAMLError as e:
                raise ValueError("neither JSON nor YAML") from e
        rows = rows.get("alerts", []) if isinstance(rows, dict) else rows or []
        return validated([Rule(**r) for r in rows])
    except (ValueError, TypeError, AttributeError, ImportError):
        return held


def evaluate(context: DataFrame, rules: list[Rule], key: str = "ticker", functions: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """context's rows once for each rule that holds: adds rule_id, kind_order and cooldown_min.

    All rules of a context are evaluated in one pass over its rows; rules for one ticker hold for it only."""
    names = set(context.columns)
    hits = []
    for r in validated(rules):
        c = compile_rule(r.expr, names, functions)
        if r.ticker is not None:
            c = c & (F.col(key).cast("string") == r.ticker)
        hits.append(F.when(c, F.struct(F.lit(r.id).alias("rule_id"), F.lit(KINDS.index(r.kind)).alias("kind_order"), F.lit(r.cooldown_min).alias("cooldown_min"))))
    return context.select("*", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def with_holding(context: DataFrame, holdings: DataFrame) -> DataFrame:
    """Adds qty, cost_per_share and what follows from them; rows without a holding have no context and go."""
    df = context.join(holdings, "ticker")
    pnl = (F.col("price") - F.col("cost_per_share")) * F.col("qty")
    cost = F.col("cost_per_share") * F.col("qty")
    return df.withColumns({
        "pct_change_from_cost": F.when(F.col("cost_per_share") <= 0, F.lit(0.0)).otherwise((F.col("price") / F.col("cost_per_share") - 1) * 100),
        "unrealized_pnl": pnl,
        "unrealized_pnl_pct": F.when(cost == 0, F.lit(0.0)).otherwise(pnl / cost * 100),
    })


def portfolio(held: DataFrame, capital: float | None) -> DataFrame:
    """One row: total_pnl, holdings in loss, and total as a share of the capital (0 without capital)."""
    totals = held.agg(F.coalesce(F.sum("unrealized_pnl"), F.lit(0.0)).alias("total_unrealized_pnl"), F.count_if(F.col("unrealized_pnl") < 0).alias("holding_count_in_loss"))
    share = F.col("total_unrealized_pnl") / F.lit(capital) * 100 if capital and capital > 0 else F.lit(0.0)
    return totals.withColumn("total_unrealized_pnl_pct", share)


#: The key that portfolio rules fire under; fixed value.
PORTFOLIO = "_portfolio"


def evaluate_portfolio(held: DataFrame, capital: float | None, rules: list[Rule]) -> DataFrame:
    """The portfolio's totals once for each rule that holds, under the key PORTFOLIO; nothing without a holding's snapshot."""
    totals = portfolio(held, capital).join(held.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0"))
    return evaluate(totals.drop("_n").withColumn("ticker", F.lit(PORTFOLIO)), rules)


def merged(hits: DataFrame, snapshot: list[str]) -> DataFrame:
    """One message for each snapshot with hits: an alert, or a burst of several with their rules in order."""
    rules = F.transform(F.array_sort(F.collect_list(F.struct("kind_order", "rule_id"))), lambda x: x["rule_id"])
    out = hits.groupBy(*snapshot).agg(rules.alias("rules"))
    return out.withColumn("kind", F.when(F.size("rules") > 1, "alert_burst").otherwise("alert"))


def ranked(rows: DataFrame, category: str, keep: Column, order: Column, ordinal: str, n: int) -> DataFrame:
    """The first n rows in an order, ties by ordinal, with category and rank. Each task keeps its own n."""
    top = rows.where(keep).orderBy(order, ordinal).limit(n)
    return top.withColumn("category", F.lit(category)).withColumn("rank", F.row_number().over(Window.orderBy(order, ordinal)))


def rank_market(rows: DataFrame, threshold: float = 8.0, n: int = 5) -> DataFrame:
    """Gainers above, losers below minus, and volume ratios from the threshold on: n of each, in one labelled table."""
    pct, ratio = F.col("pct_change"), F.col("volume_ratio")
    parts = (("gainers", pct > threshold, pct.desc()), ("losers", pct < -threshold, pct.asc()), ("volume_ratio", ratio.isNotNull() & (ratio >= threshold), ratio.desc()))
    out = [ranked(rows, c, keep, order, "ticker", n) for c, keep, order in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
