"""Statistics on one aggregated matrix: every fit is solved from sums taken in a single pass.

`Gram` holds n, sums and cross products of the columns (rows with a null in one of
them are left out).  Nested, stepwise and penalised fits, Shapley shares and
screening only read that matrix, so no fit scans the data again.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import correlation
from ..functions.special import t_two_sided


@dataclass
class Gram:
    columns: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray  # centred sums of products

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str]) -> Gram:
        columns = list(columns)
        full = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
        pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
        aggs = [F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]]
        row = full.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        n, m = row[0], len(columns)
        cross = np.zeros((m, m))
        for k, (i, j) in enumerate(pairs):
            cross[i, j] = cross[j, i] = (row[1 + m + k] or 0.0) * n
        return cls(columns, n, np.array([row[1 + i] or 0.0 for i in range(m)]), cross)

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.columns.index(c) for c in names]

    def fit(self, target: str, names: Sequence[str], ridge: float = 0.0) -> dict:
        """Least squares of target on names with intercept; coefficients, errors, p-values, R2."""
        y, x = self.columns.index(target), self.at(names)
        total = self.cross[y, y]
        if not x:
            return {"names": [], "beta": np.zeros(0), "intercept": self.mean[y], "r2": 0.0, "adj_r2": 0.0, "rmse": math.sqrt(total / max(1, self.n - 1)), "p": np.zeros(0), "se": np.zeros(0)}
        a = self.cross[np.ix_(x, x)] + ridge * np.eye(len(x))
        inverse = np.linalg.pinv(a)
        beta = inverse @ self.cross[x, y]
        rest = max(0.0, total - 2 * beta @ self.cross[x, y] + beta @ self.cross[np.ix_(x, x)] @ beta)
        free = self.n - len(x) - 1
        r2 = 1 - rest / total if total > 0 else 0.0
        se = np.sqrt(np.maximum(0.0, np.diag(inverse) * rest / free)) if free > 0 else np.full(len(x), np.nan)
        p = np.array([t_two_sided(b / s, free) if s > 0 else 0.0 for b, s in zip(beta, se, strict=True)])
        adj = 1 - (1 - r2) * (self.n - 1) / free if free > 0 else float("nan")
        return {"names": list(names), "beta": beta, "intercept": self.mean[y] - beta @ self.mean[x], "r2": r2, "adj_r2": adj, "rmse": math.sqrt(rest / free) if free > 0 else float("nan"), "p": p, "se": se}

    def standard_betas(self, target: str, names: Sequence[str]) -> np.ndarray:
        y, x = self.columns.index(target), self.at(names)
        return self.fit(target, names)["beta"] * np.sqrt(np.diag(self.cross)[x] / self.cross[y, y])

    def correlation(self) -> np.ndarray:
        d = np.sqrt(np.diag(self.cross))
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.cross / np.outer(d, d)


def hierarchical(gram: Gram, target: str, groups: dict[str, list[str]]) -> list[tuple[str, float, float]]:
    """(group, R2 with all groups so far, gain)."""
    out, names, last = [], [], 0.0
    for group, cols in groups.items():
        names = [*names, *cols]
        r2 = gram.fit(target, names)["r2"]
        out.append((group, r2, r2 - last))
        last = r2
    return out


def shapley(gram: Gram, target: str, groups: dict[str, list[str]]) -> list[tuple[str, float, float, float, float]]:
    """(group, mean, population std, min, max) of its marginal R2 over all orders; one solve for each subset of groups."""
    names = list(groups)
    r2 = {}
    for k in range(len(names) + 1):
        for s in itertools.combinations(names, k):
            r2[frozenset(s)] = gram.fit(target, [c for g in names if g in s for c in groups[g]])["r2"]
    out, orders = [], math.factorial(len(names))
    for g in names:
        gains, weights = [], []
        rest = [x for x in names if x != g]
        for k in range(len(rest) + 1):
            for s in itertools.combinations(rest, k):
                gains.append(r2[frozenset((*s, g))] - r2[frozenset(s)])
                weights.append(math.factorial(k) * math.factorial(len(rest) - k) / orders)
        mean = float(np.dot(gains, weights))
        out.append((g, mean, math.sqrt(max(0.0, float(np.dot(np.square(gains), weights)) - mean * mean)), min(gains), max(gains)))
    return out


def screen(df: DataFrame, names: Sequence[str], missing: float = 0.2, least_std: float = 1e-6, most_r: float = 0.70, most_vif: float = 10.0, rounds: int = 5) -> list[str]:
    """Names left after: missing share, spread, pairwise correlation, variance inflation.

    Of two columns that correlate the later one goes, also where the earlier one has gone itself; correlations are
    of rows where both have values.  Inflation is of rows where all that are left have values, for three columns or more."""
    number = lambda c: F.col(c).cast("double")
    row = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(x for c in names for x in (F.avg(F.col(c).isNull().cast("double")), F.stddev_samp(number(c))))]).first()
    kept = [c for i, c in enumerate(names) if row[2 * i] is not None and row[2 * i] < missing and (row[2 * i + 1] or 0.0) > least_std]
    if len(kept) < 2:
        return kept
    # without nulls one matrix serves all steps
    whole = Gram.of(df, kept) if not any(row[2 * i] for i, c in enumerate(names) if c in kept) else None
    pairs = list(itertools.combinations(range(len(kept)), 2))
    if whole:
        matrix = whole.correlation()
        r = [matrix[i, j] for i, j in pairs]
    else:
        r = df.agg(*[correlation(number(kept[i]), number(kept[j])).alias(f"r{k}") for k, (i, j) in enumerate(pairs)]).first()
    gone = {j for k, (_, j) in enumerate(pairs) if r[k] is not None and abs(r[k]) >= most_r}
    kept = [c for i, c in enumerate(kept) if i not in gone]
    for _ in range(rounds):
        if len(kept) < 3:
            break
        gram = whole or Gram.of(df, kept)
        at = gram.at(kept)
        vif = np.diag(np.linalg.inv(gram.correlation()[np.ix_(at, at)] + 1e-8 * np.eye(len(kept))))
        worst = int(vif.argmax())
        if vif[worst] <= most_vif:
            break
        kept.pop(worst)
    return kept


def stepwise(gram: Gram, target: str, names: Sequence[str], enter: float = 0.05, remove: float = 0.10, most: int = 200) -> dict:
    """Forward selection with removal, by p-value; the final fit with standardised betas."""
    chosen: list[str] = []
    for _ in range(most):
        tests = [(gram.fit(target, [*chosen, c])["p"][-1], i, c) for i, c in enumerate(names) if c not in chosen]
        best = min(tests, default=None)
        changed = best is not None and best[0] < enter
        if changed:
            chosen.append(best[2])
        p = gram.fit(target, chosen)["p"]
        if len(p) and p.max() > remove:
            gone = chosen.pop(int(p.argmax()))
            if changed and gone == best[2]:
                break
            changed = True
        if not changed:
            break
    return gram.fit(target, chosen) | {"standard": gram.standard_betas(target, chosen) if chosen else np.zeros(0)}


def average_rank(c: str, by: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*by, c)) - 1) / 2


def value_edges(df: DataFrame, names: Sequence[str], pieces: int = 64) -> list[list[float]]:
    """For each column, values that cut it into about equal pieces."""
    found = df.approxQuantile(list(names), [i / pieces for i in range(1, pieces)], 0.25 / pieces) if pieces > 1 else [[] for _ in names]
    return [sorted(set(x)) for x in found]


def value_ranks(values: DataFrame, c: str, edges: Sequence[float]) -> DataFrame:
    """Every different value of c with its rank among all rows, ties at their mean (column `rank`).

    Values are counted with map-side combination and cut at the edges, so each piece is ranked by a task of its own."""
    held = values.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
    held = held.withColumn("piece", F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(c))) if edges else F.lit(0))
    before = held.groupBy("piece").agg(F.sum("k").alias("n"))  # a row for each edge at most
    before = before.select("piece", F.coalesce(F.sum("n").over(W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("k").over(W.partitionBy("piece").orderBy(c))
    return held.join(F.broadcast(before), "piece").select(c, (F.col("before") + inside - (F.col("k") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, names: Sequence[str], target: str, least: int = 10) -> list[tuple[str, int, float, float]]:
    """(name, n, rho, p) of every name with the target, over rows where both have values.

    Columns without nulls are ranked once for all and compared in one pass."""
    columns = [*names, target]
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    edges = dict(zip(columns, value_edges(df, columns), strict=True))

    def compared(rows: DataFrame, some: Sequence[str]) -> list[tuple[int, float | None]]:
        ranked = rows
        for c in (*some, target):
            ranked = ranked.join(value_ranks(rows, c, edges[c]).withColumnRenamed("rank", f"{c}#"), c)
        found = ranked.agg(F.count(F.lit(1)), *[correlation(F.col(f"{c}#"), F.col(f"{target}#")) for c in some]).first()
        return [(found[0], rho) for rho in found[1:]]

    full = [c for c in names if not gaps[c] and not gaps[target]]
    results = dict(zip(full, compared(df.select(*full, target), full), strict=True)) if full else {}
    for c in names:
        if c not in results:
            (results[c],) = compared(df.select(c, target).na.drop(), [c])
    out = []
    for c in names:
        n, rho = results[c]
        if n >= least and rho is not None:
            out.append((c, n, rho, t_two_sided(rho * math.sqrt((n - 2) / max(1e-300, 1 - rho * rho)), n - 2)))
    return out


def grouped_spearman(df: DataFrame, x: str, y: str, by: str = "gauge", least: int = 5) -> DataFrame:
    """Spearman's rho within each group of at least `least` rows."""
    pairs = df.select(by, F.col(x).alias("x"), F.col(y).alias("y")).na.drop()
    ranked = pairs.withColumns({"rx": average_rank("x", [by]), "ry": average_rank("y", [by])})
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("rho")).filter(F.col("n") >= least)


def regime(rho: Column, bfi: Column, k: Column) -> Column:
    """Which process governs recovery; a null decides nothing."""
    return F.when((rho < -0.3) & (bfi < 0.4), "Climate-controlled").when((bfi > 0.6) & (k > 20), "Memory-controlled").otherwise("Mixed")


def regimes(pairs: DataFrame, x: str, y: str, bfi: str, k: str, by: str = "gauge", least: int = 3) -> DataFrame:
    """Groups of at least `least` rows: rows, rho of x and y (null below five rows that have both), medians of bfi and k, regime."""
    held = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.median(bfi).alias("bfi"), F.median(k).alias("k")).filter(F.col("n") >= least)
    out = held.join(grouped_spearman(pairs, x, y, by).select(by, "rho"), by, "left")
    return out.withColumn("regime", regime(F.col("rho"), F.col("bfi"), F.col("k")))


# Names of dynamic and of event predictors.
DYNAMIC = ("dyn_BFI", "dyn_recession_k_days", "dyn_cv_Q", "antecedent_ssi")
EVENT = ("spei_intensity", "ssi_intensity", "spei_false_rec", "ssi_false_rec")


def predictor_type(name: Column) -> Column:
    """DYN, EVENT or STATIC."""
    dynamic = name.isin(*DYNAMIC) | name.startswith("mean_dyn_") | (name == "mean_antecedent_ssi")
    return F.when(dynamic, "DYN").when(name.isin(*EVENT), "EVENT").otherwise("STATIC")


def grid(df: DataFrame, by: str, target: str, names: Sequence[str], least: int = 100, total: str | None = "All") -> list[tuple[str, int, int, float, float, float]]:
    """(subset, n, predictors, R2, adjusted R2, RMSE) of a fit for each value of `by`, and for all rows; subsets of fewer
    than `least` complete rows are left out.

    One aggregation gives the matrices of all subsets; that of all rows is their sum."""
    columns = [target, *names]
    full = df.select(F.col(by).cast("string").alias("#"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=columns)
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    aggs = [F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]]
    grams = {}
    for row in full.groupBy("#").agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).collect():  # one row a subset
        n, m, values = row["a0"], len(columns), [x or 0.0 for x in row[1:]]
        cross = np.zeros((m, m))
        for k, (i, j) in enumerate(pairs):
            cross[i, j] = cross[j, i] = values[1 + m + k] * n
        grams[row["#"]] = Gram(columns, n, np.array(values[1 : 1 + m]), cross)
    if total and grams:
        n = sum(g.n for g in grams.values())
        mean = sum(g.n * g.mean for g in grams.values()) / n
        cross = sum(g.cross + g.n * np.outer(g.mean - mean, g.mean - mean) for g in grams.values())
        grams[total] = Gram(columns, n, mean, cross)
    out = []
    for label, g in sorted(grams.items(), key=lambda x: str(x[0])):
        if g.n >= least:
            fit = g.fit(target, list(names))
            out.append((label, g.n, len(names), float(fit["r2"]), float(fit["adj_r2"]), float(fit["rmse"])))
    return out


Part = tuple[int, np.ndarray, np.ndarray]  # rows, sums, sums of products


def fold_parts(df: DataFrame, target: str, names: Sequence[str], fold: Column) -> dict[int, Part]:
    """Sums and products of target and names by fold, from one aggregation; any training set is a sum of parts."""
    columns = [target, *names]
    full = df.select(fold.alias("#"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(subset=columns)
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    sums = [F.count(F.lit(1)), *[F.sum(c) for c in columns], *[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]]
    parts, m = {}, len(columns)
    for row in full.groupBy("#").agg(*[a.alias(f"a{i}") for i, a in enumerate(sums)]).collect():  # one row a fold
        values = list(row[1:])
        raw = np.zeros((m, m))
        for k, (i, j) in enumerate(pairs):
            raw[i, j] = raw[j, i] = values[1 + m + k]
        parts[row[0]] = (values[0], np.array(values[1 : 1 + m]), raw)
    return parts


def _joined(parts: Sequence[Part]) -> Part:
    return sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts)


def _ridge(train: Part, columns: list[str], penalty: float) -> dict:
    n, total, raw = train
    return Gram(columns, n, total / n, raw - np.outer(total, total) / n).fit(columns[0], columns[1:], ridge=penalty)


def _error(fit: dict, part: Part) -> float:
    """Sum of squared errors of a fit over the rows of a part."""
    n, own, square = part
    b = np.concatenate(([1.0], -np.asarray(fit["beta"])))  # y - x beta - intercept
    return float(b @ square @ b - 2 * fit["intercept"] * (b @ own) + n * fit["intercept"] ** 2)


PENALTIES = (0.01, 0.1, 1.0, 10.0, 100.0)


def ridge_cv(df: DataFrame, target: str, names: Sequence[str], fold: Column, penalties: Sequence[float] = PENALTIES) -> tuple[float, list[tuple[float, float]]]:
    """The penalty with the least mean squared error over folds, and all (penalty, error).

    Matrices of all folds come from one aggregation; a fold's training matrix is that of the others together, and its
    error follows from its own matrix."""
    return _choose_penalty(fold_parts(df, target, names, fold), [target, *names], penalties)


def _choose_penalty(parts: dict[int, Part], columns: list[str], penalties: Sequence[float]) -> tuple[float, list[tuple[float, float]]]:
    out = []
    for penalty in penalties:
        errors = [_error(_ridge(_joined([p for i, p in parts.items() if i != held]), columns, penalty), part) / part[0] for held, part in parts.items()]
        out.append((penalty, float(np.mean(errors))))
    return min(out, key=lambda x: x[1])[0], out


def nested_ridge(df: DataFrame, target: str, names: Sequence[str], fold: Column, penalties: Sequence[float] = PENALTIES) -> list[tuple[int, int, float, float, float]]:
    """(fold, rows, penalty, R2, root mean squared error) of each outer fold: the penalty is chosen by cross-validation
    over the other folds alone, the fit on all of them is judged on the one left out.

    All training sets, also those that leave out two folds, are sums of the same parts; data are read once."""
    parts, columns, out = fold_parts(df, target, names, fold), [target, *names], []
    for held, part in sorted(parts.items()):
        inner = {i: p for i, p in parts.items() if i != held}
        penalty, _ = _choose_penalty(inner, columns, penalties)
        n, own, square = part
        error = _error(_ridge(_joined(list(inner.values())), columns, penalty), part)
        out.append((held, n, penalty, float(1 - error / (square[0, 0] - own[0] ** 2 / n)), math.sqrt(error / n)))
    return out


def order_table(gram: Gram, target: str, groups: dict[str, list[str]], spark) -> DataFrame:
    """order_no, order_text, place, block, gain: what each group adds to R2 in every order of the groups.

    There are 2**k subsets (solved from the matrix) and k! orders: orders are decoded from their numbers by factorial
    digits in the cluster, and each step looks up the subsets before and after it by bit mask."""
    names, k = list(groups), len(groups)
    subsets = [(s, float(gram.fit(target, [c for i, g in enumerate(names) if s >> i & 1 for c in groups[g]])["r2"])) for s in range(1 << k)]
    left, picked, number = F.array(*[F.lit(i) for i in range(k)]), [], F.col("id")
    orders = spark.range(math.factorial(k)).withColumn("left", left)
    for i in range(k):
        base = math.factorial(k - 1 - i)
        at = F.element_at("left", (F.floor(number / base) % (k - i) + 1).cast("int"))
        orders = orders.withColumn(f"g{i}", at).withColumn("left", F.array_except("left", F.array(F.col(f"g{i}"))))
        picked.append(F.col(f"g{i}"))
    label, bit = F.array(*[F.lit(g) for g in names]), lambda g: F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), g + 1)
    steps = [
        F.struct(F.lit(i + 1).alias("place"), g.alias("g"), sum((bit(h) for h in picked[:i]), F.lit(0)).alias("before"))
        for i, g in enumerate(picked)
    ]
    table = orders.select("id", F.array_join(F.array(*[F.element_at(label, g + 1) for g in picked]), ",").alias("order_text"), F.inline(F.array(*steps)))
    lattice = spark.createDataFrame(subsets, "mask int, r2 double")
    one, two = (lattice.select(F.col("mask").alias(m), F.col("r2").alias(r)) for m, r in (("before", "r0"), ("after", "r1")))
    table = table.withColumn("after", F.col("before") + bit(F.col("g")))
    found = table.join(F.broadcast(one), "before").join(F.broadcast(two), "after")  # 2**k rows each
    return found.select(F.col("id").alias("order_no"), "order_text", "place", F.element_at(label, F.col("g") + 1).alias("block"), (F.col("r1") - F.col("r0")).alias("gain"))


def grid_sets(
    df: DataFrame, sets: Sequence[tuple[Sequence[str], int, bool]], targets: Sequence[str], names: Sequence[str], without: tuple[str, object, Sequence[str]] | None = None
) -> list[dict]:
    """Fits of every target in every subset that the grouping sets name, from one pass over the rows.

    sets: (columns, least rows, keep): a subset of fewer complete rows is left out, or kept without a fit.
    without: (column, value, predictors): these predictors are no part of subsets where the column has that value, and
    their nulls leave out no row there.  Rows are dicts of the grouping columns (None where not grouped; groups of null
    keys are left out), level (the set's number), target, n, predictors, r2, adj_r2, rmse."""
    dims = list(dict.fromkeys(c for columns, *_ in sets for c in columns))
    lists = {False: list(names), True: [c for c in names if not without or c not in without[2]]}
    number = {c: F.col(c).cast("double") for c in dict.fromkeys([*targets, *names])}
    aggs, wanted = [], [(t, short) for t in targets for short in (False, True) if short is False or without]
    for t, short in wanted:
        columns = [t, *lists[short]]
        full = F.lit(True)
        for c in columns:
            full = full & number[c].isNotNull()
        held = [F.when(full, number[c]) for c in columns]
        pairs = itertools.combinations_with_replacement(range(len(columns)), 2)
        aggs.append(F.struct(F.count(held[0]).alias("n"), F.array(*[F.avg(c) for c in held]).alias("mean"), F.array(*[F.covar_pop(held[i], held[j]) for i, j in pairs]).alias("cov")))
    groups = df.groupingSets([[F.col(c) for c in columns] for columns, *_ in sets], *[F.col(c) for c in dims])
    rows = groups.agg(F.grouping_id().alias("#"), *[a.alias(f"a{i}") for i, a in enumerate(aggs)]).collect()  # a row for each subset
    codes = {sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in columns): k for k, (columns, *_) in enumerate(sets)}
    out = []
    for row in rows:
        level = codes[row["#"]]
        columns, least, keep = sets[level]
        if any(row[c] is None for c in columns):
            continue
        short = bool(without) and without[0] in columns and row[without[0]] == without[1]
        for i, (t, s) in enumerate(wanted):
            if s != short:
                continue
            n, used = row[f"a{i}"]["n"], lists[short]
            base = {c: row[c] if c in columns else None for c in dims} | {"level": level, "target": t, "n": n, "predictors": len(used), "r2": None, "adj_r2": None, "rmse": None}
            if n >= least:
                m = len(used) + 1
                cross = np.zeros((m, m))
                for (x, y), v in zip(itertools.combinations_with_replacement(range(m), 2), row[f"a{i}"]["cov"], strict=True):
                    cross[x, y] = cross[y, x] = (v or 0.0) * n
                fit = Gram([t, *used], n, np.array([v or 0.0 for v in row[f"a{i}"]["mean"]]), cross).fit(t, used)
                out.append(base | {"r2": float(fit["r2"]), "adj_r2": float(fit["adj_r2"]), "rmse": float(fit["rmse"])})
            elif keep:
                out.append(base)
    return out
