"""A small declarative plan: table steps that compile to lazy DataFrame operations, and to SQL for verification.

Expressions are written once. Four pseudo-functions stand for what the dialects spell differently:
PCT(x, p) exact linear-interpolated quantile, US(ts) microseconds since the epoch, JGET(json, path) a JSON string value,
RSUB(x, pattern, by) replacement of all matches. Spark runs the DataFrame form, so Catalyst prunes columns, pushes
filters to the scan, combines aggregates before shuffles and picks join strategies.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystat.plans.chunked import near_windows, place_in_order, running_sum, tiles
from quarrystat.plans.halves import early_half, exact_median
from quarrystat.plans.means import exact_mean
from quarrystat.plans.selection import with_quantiles

_SPARK = {"PCT": "percentile", "US": "unix_micros", "JGET": "get_json_object", "RSUB": "regexp_replace"}
_DUCK = {"PCT": "quantile_cont", "US": "epoch_us", "JGET": "json_extract_string", "RSUB": "regexp_replace_all"}


#: Decimal literals are doubles in both dialects.
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def _spark(expr: str) -> str:
    expr = _DECIMAL.sub(r"\1D", expr)
    out = re.sub(r"\b(PCT|US|JGET|RSUB)\(", lambda m: _SPARK[m[1]] + "(", expr)
    # ts is stored without a zone; the session's zone is UTC, so both engines see the same instant
    return re.sub(r"unix_micros\(([^()]+(?:\([^()]*\))?)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", out)


def _duck(expr: str) -> str:
    expr = _DECIMAL.sub(r"\1e0", expr)
    out = re.sub(r"\b(PCT|US|JGET|RSUB)\(", lambda m: _DUCK[m[1]] + "(", expr)
    while m := re.search(r"regexp_replace_all\(", out):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(out[i], 0)
            i += 1
        out = f"{out[: m.start()]}regexp_replace({out[m.end() : i - 1]}, 'g'){out[i:]}"
    return out


_AGGREGATE = re.compile(r"\b(PCT|count|sum|avg|min|max|stddev_pop|stddev_samp|var_pop|var_samp)\(")


def _taken(expr: str) -> tuple[str, list[str]]:
    """``expr`` with its aggregate calls as {0}, {1}, and the calls."""
    found, at = [], 0
    while m := _AGGREGATE.search(expr, at):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(expr[i], 0)
            i += 1
        name = f"{{{len(found)}}}"
        found.append(expr[m.start() : i])
        expr, at = expr[: m.start()] + name + expr[i:], m.start() + len(name)
    return expr, found


def _grouped(rows: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Aggregates by keys; quantiles go by ranks, so that no buffer holds a group's values."""
    if not any("PCT(" in e for e in columns.values()):
        return rows.groupBy(*keys).agg(*[F.expr(_spark(e)).alias(n) for n, e in columns.items()])
    taken = {n: _taken(e) if "PCT(" in e else ("{0}", [e]) for n, e in columns.items()}
    asked = {c: f"_p{i}" for i, c in enumerate(sorted({c for _, calls in taken.values() for c in calls}))}
    cut = {name: c[4:-1].rsplit(",", 1) for c, name in asked.items() if c.startswith("PCT(")}
    plain = {name: _spark(c) for c, name in asked.items() if name not in cut}
    out = with_quantiles(rows, keys, {name: (_spark(x), float(p)) for name, (x, p) in cut.items()}, plain)
    return out.selectExpr(*keys, *[f"{_spark(e).format(*[asked[c] for c in calls])} AS {n}" for n, (e, calls) in taken.items()])


@dataclass(frozen=True)
class Plan:
    """Steps over a base table; every method returns a new plan."""

    base: object
    steps: tuple = ()

    def _with(self, *step: object) -> Plan:
        return Plan(self.base, (*self.steps, step))

    def where(self, condition: str) -> Plan:
        return self._with("where", condition)

    def add(self, **columns: str) -> Plan:
        """More columns; window functions may be used."""
        return self._with("add", columns)

    def select(self, *names: str, **columns: str) -> Plan:
        return self._with("select", {n: n for n in names} | columns)

    def agg(self, *keys: str, **columns: str) -> Plan:
        return self._with("agg", keys, columns)

    def join(self, other: Plan, *on: str, how: str = "inner") -> Plan:
        """Equi-join by equal column names."""
        return self._with("join", other, on, how)

    def cross(self, one: Plan) -> Plan:
        """Join with a plan of exactly one row (a scalar aggregate)."""
        return self._with("cross", one)

    def within(self, other: Plan, condition: str, how: str = "inner") -> Plan:
        """Theta join with a small plan, whose size the planner checks before it broadcasts."""
        return self._with("within", other, condition, how)

    def union(self, other: Plan) -> Plan:
        return self._with("union", other)

    def each(self, name: str, low: int, high: int | str) -> Plan:
        """One row for each whole number of a range; ``high`` is a constant or an expression of at least ``low``."""
        return self._with("each", name, low, high)

    def halve(self, t: str, *ties: str) -> Plan:
        """Column early: 1 for the first int(n / 2) rows by t and ties, else 0."""
        return self._with("halve", t, ties)

    def median(self, t: str, name: str) -> Plan:
        """One row: the exact median of microseconds."""
        return self._with("median", t, name)

    def mean(self, key: str, name: str, value: str) -> Plan:
        """Each key's mean, exact in Spark: for means that are compared with each other."""
        return self._with("mean", key, name, value)

    def near(self, key: str, order: str, reach: int, **columns: str) -> Plan:
        """Window columns over ``PARTITION BY key ORDER BY order`` that look at most ``reach`` rows away."""
        return self._with("near", key, order, reach, columns)

    def place(self, key: str, order: str, name: str) -> Plan:
        """Each row's place from 1 along its key."""
        return self._with("place", key, order, name)

    def tiles(self, key: str, keep: str = "*", **columns: tuple[int, str]) -> Plan:
        """Columns name=(n, order): the n-tile of each row along its key, by an order without ties. ``keep``: columns that later
        steps need; the others are not sorted along."""
        return self._with("tiles", key, columns, keep)

    def running(self, key: str, order: str, name: str, value: str) -> Plan:
        """Sum of ``value`` from the key's first row to the row itself."""
        return self._with("running", key, order, name, value)

    def top(self, order: str, n: int) -> Plan:
        return self._with("top", order, n)

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.base.df(spark, sf_dir) if isinstance(self.base, Plan) else spark.read.parquet(f"{sf_dir}/{self.base}.parquet")
        for kind, *x in self.steps:
            if kind == "where":
                out = out.where(_spark(x[0]))
            elif kind == "add":
                out = out.selectExpr("*", *[f"{_spark(e)} AS {n}" for n, e in x[0].items()])
            elif kind == "select":
                out = out.selectExpr(*[f"{_spark(e)} AS {n}" for n, e in x[0].items()])
            elif kind == "agg":
                out = _grouped(out, list(x[0]), x[1])
            elif kind == "join":
                how = {"semi": "left_semi", "anti": "left_anti"}.get(x[2], x[2])
                out = out.join(x[0].df(spark, sf_dir), list(x[1]), how)
            elif kind == "cross":
                out = out.crossJoin(F.broadcast(x[0].df(spark, sf_dir)))
            elif kind == "within":
                out = out.join(x[0].df(spark, sf_dir), F.expr(_spark(x[1])), x[2])
            elif kind == "union":
                out = out.unionByName(x[0].df(spark, sf_dir))
            elif kind == "halve":
                out = early_half(out, [x[0], *x[1]])
            elif kind == "median":
                out = exact_median(out, x[0], x[1])
            elif kind == "mean":
                out = exact_mean(out, [x[0]], x[1], _spark(x[2]))
            elif kind == "near":
                out = near_windows(out, x[0], x[1].split(", "), x[2], {n: _spark(e) for n, e in x[3].items()})
            elif kind == "tiles":
                out = tiles(out.select(*x[2].split(", ")), x[0], x[1])
            elif kind == "running":
                out = running_sum(out, x[0], x[1].split(", "), x[2], _spark(x[3]))
            elif kind == "place":
                out = place_in_order(out, x[0], x[1].split(", "), x[2])
            elif kind == "each":
                out = out.selectExpr("*", f"explode(sequence({x[1]}L, CAST({_spark(str(x[2]))} AS BIGINT))) AS {x[0]}")
            else:
                out = out.orderBy(*[F.expr(o.removesuffix(" DESC")).desc() if o.endswith(" DESC") else F.expr(o).asc() for o in x[0].split(", ")]).limit(x[1])
        return out

    def sql(self) -> str:
        out = self.base.sql() if isinstance(self.base, Plan) else f"SELECT * FROM {self.base}"
        named = lambda c: ", ".join(f"{_duck(e)} AS {n}" for n, e in c.items())
        for kind, *x in self.steps:
            if kind == "where":
                out = f"SELECT * FROM ({out}) WHERE {_duck(x[0])}"
            elif kind == "add":
                out = f"SELECT *, {named(x[0])} FROM ({out})"
            elif kind == "select":
                out = f"SELECT {named(x[0])} FROM ({out})"
            elif kind == "agg":
                keys = ", ".join(x[0])
                out = f"SELECT {keys}{', ' * bool(keys)}{named(x[1])} FROM ({out})" + f" GROUP BY {keys}" * bool(keys)
            elif kind == "join":
                how = {"inner": "JOIN", "left": "LEFT JOIN", "full": "FULL JOIN", "semi": "SEMI JOIN", "anti": "ANTI JOIN"}[x[2]]
                out = f"SELECT * FROM ({out}) {how} ({x[0].sql()}) USING ({', '.join(x[1])})"
            elif kind == "cross":
                out = f"SELECT * FROM ({out}) CROSS JOIN ({x[0].sql()})"
            elif kind == "within":
                out = f"SELECT * FROM ({out}) {x[2].upper()} JOIN ({x[0].sql()}) ON {_duck(x[1])}"
            elif kind == "union":
                out = f"({out}) UNION ALL BY NAME ({x[0].sql()})"
            elif kind == "median":
                out = f"SELECT quantile_cont({x[0]}, 0.5) AS {x[1]} FROM ({out})"
            elif kind == "mean":
                out = f"SELECT {x[0]}, avg({_duck(x[2])}) AS {x[1]} FROM ({out}) GROUP BY {x[0]}"
            elif kind == "near":
                out = f"SELECT *, {named(x[3])} FROM ({out})"
            elif kind == "running":
                frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
                out = f"SELECT *, sum({_duck(x[3])}) OVER (PARTITION BY {x[0]} ORDER BY {x[1]} {frame}) AS {x[2]} FROM ({out})"
            elif kind == "tiles":
                out = f"SELECT *, {named({c: f'ntile({n}) OVER (PARTITION BY {x[0]} ORDER BY {o})' for c, (n, o) in x[1].items()})} FROM ({out})"
            elif kind == "place":
                out = f"SELECT *, row_number() OVER (PARTITION BY {x[0]} ORDER BY {x[1]}) AS {x[2]} FROM ({out})"
            elif kind == "halve":
                out = f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {', '.join((x[0], *x[1]))}) <= count(*) OVER () // 2 THEN 1 ELSE 0 END AS early FROM ({out})"
            elif kind == "each":
                out = f"SELECT *, unnest(generate_series({x[1]}, CAST({_duck(str(x[2]))} AS BIGINT))) AS {x[0]} FROM ({out})"
            else:
                out = f"SELECT * FROM ({out}) ORDER BY {x[0]} LIMIT {x[1]}"
        return out


def table(name: str) -> Plan:
    return Plan(name)
