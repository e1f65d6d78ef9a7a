"""Suites of linear models that are fitted, tuned and chosen together.

All specifications, folds and penalties of a suite are fed by the same passes:
one brings the moments of every fold, from which ridge models of any columns and
penalty are solved; each Newton step of all logistic models is one more; one more
judges all of them on their folds' own rows. So the number of passes does not grow
with the number of models. A pass runs over Arrow batches in tasks and sums by
asset before it shuffles; what comes to the driver is a matrix for each model.

A fold is a year: it learns from rows whose outcome was known before it and is
judged on its own settled rows (``calibration.yearly_folds``). Means count
clusters, assets and rows alike, so they are means of means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.models import LinearModel

#: Tasks, what each predicts and how it is scored.
TASKS = {"range": "log_range", "tail": "tail1", "direction": "up1"}
NEWTON_STEPS = 40


@dataclass(frozen=True)
class Spec:
    """A model to be fitted: its task, columns, penalties to try, and a boolean column that rows must meet, if any."""

    name: str
    task: str
    columns: tuple[str, ...]
    penalties: tuple[float, ...]
    only: str | None = None


@dataclass(frozen=True)
class Fit:
    """One fitted model of a suite."""

    spec: Spec
    fold: int
    penalty: float
    rows: int
    model: LinearModel


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def _sums(rows: DataFrame, columns: list[str], jobs: list[tuple], of: Callable[[tuple, np.ndarray, dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """cluster, asset, job, at, v: for each job the vector that ``of`` gives for the rows it may learn from, added by asset.

    A job is (fold, only, ...): rows known before the fold that meet ``only``.
    """
    flags = sorted({job[1] for job in jobs if job[1]})
    held = rows.select("cluster", "asset", "known", *(F.col(c).cast("double") for c in columns), *(F.col(t).cast("double").alias(f"_{t}") for t in TASKS.values()), *(F.coalesce(F.col(c), F.lit(False)).alias(f"_only_{c}") for c in flags)).where("known is not null")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            get = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            x = np.column_stack([np.ones(batch.num_rows), *(get[c].to_numpy(zero_copy_only=False) for c in columns)])
            targets = {t: get[f"_{t}"].to_numpy(zero_copy_only=False) for t in TASKS.values()}
            known = get["known"].to_numpy(zero_copy_only=False)
            only = {c: get[f"_only_{c}"].to_numpy(zero_copy_only=False) for c in flags}
            names = list(zip(get["cluster"].to_pylist(), get["asset"].to_pylist(), strict=True))
            places: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                places.setdefault(name, []).append(i)
            for name, at in places.items():
                at = np.array(at)
                for k, job in enumerate(jobs):
                    mine = at[(known[at] < job[0]) & (only[job[1]][at] if job[1] else True)]
                    if len(mine):
                        found = of(job, x[mine], {t: v[mine] for t, v in targets.items()})
                        key = (*name, k)
                        total[key] = total[key] + found if key in total else found
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))], ["cluster", "asset", "job", "sums"])

    each = held.mapInArrow(add, "cluster string, asset string, job int, sums array<double>")
    long = each.select("cluster", "asset", "job", F.posexplode("sums").alias("at", "v"))
    return long.groupBy("cluster", "asset", "job", "at").agg(F.sum("v").alias("v"))


def _means(sums: DataFrame, width: int) -> dict[int, tuple[int, np.ndarray]]:
    """By job: rows, and the mean of means over clusters and assets of the sums divided by their first, the number of rows."""
    rows = sums.where("at = 0").select("cluster", "asset", "job", F.col("v").alias("n"))
    per_asset = sums.join(rows, ["cluster", "asset", "job"]).select("cluster", "job", "at", "n", (F.col("v") / F.col("n")).alias("m"))
    per_cluster = per_asset.groupBy("cluster", "job", "at").agg(F.avg("m").alias("m"), F.sum("n").alias("n"))
    got = per_cluster.groupBy("job", "at").agg(F.avg("m").alias("m"), F.sum("n").alias("n")).toPandas()  # a matrix for each job
    out = {}
    for job, part in got.groupby("job"):
        v = np.zeros(width)
        v[part["at"].to_numpy()] = part["m"].to_numpy()
        out[int(job)] = int(part["n"].iloc[0]), v
    return out


def _folded(upper: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = upper
    return m + np.triu(m, 1).T


def _moments(rows: DataFrame, columns: list[str], folds: list[int], flags: list[str | None]) -> dict[tuple, tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    """By (fold, only): rows, mean of (1, x)(1, x)' and means of (1, x) times each target."""
    k = len(columns) + 1
    jobs = [(fold, only) for fold in folds for only in flags]
    width = k * (k + 1) // 2 + k * len(TASKS)

    def of(job: tuple, x: np.ndarray, targets: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([(x.T @ x)[np.triu_indices(k)], *(x.T @ targets[t] for t in TASKS.values())])

    out = {}
    for job, (n, v) in _means(_sums(rows, columns, jobs, of), width).items():
        rest = v[k * (k + 1) // 2 :].reshape(len(TASKS), k)
        out[jobs[job]] = n, _folded(v[: k * (k + 1) // 2], k), dict(zip(TASKS.values(), rest, strict=True))
    return out


def _scaled(cross: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of the columns at these places, and the matrix that turns (1, x) into (1, standardised x)."""
    mean = cross[0, at]
    spread = np.sqrt(np.maximum(1e-12, np.diag(cross)[at] - mean * mean))
    turn = np.zeros((len(at) + 1, len(at) + 1))
    turn[0, 0] = 1.0
    for i in range(len(at)):
        turn[i + 1, 0], turn[i + 1, i + 1] = -mean[i] / spread[i], 1.0 / spread[i]
    return mean, spread, turn


def _model(spec: Spec, mean: np.ndarray, spread: np.ndarray, beta: np.ndarray, penalty: float) -> LinearModel:
    scaling = {c: (float(m), float(s)) for c, m, s in zip(spec.columns, mean, spread, strict=True)}
    return LinearModel(list(spec.columns), scaling, [float(b) for b in beta[1:]], float(beta[0]), penalty)


def fit(rows: DataFrame, specs: list[Spec], folds: list[int], penalties: dict[str, tuple[float, ...]] | None = None) -> list[Fit]:
    """Models of every specification, fold and penalty (of the specification's, if not given); a fold without rows to learn from has none.

    rows: cluster, asset, known and the columns of all specifications, with
    log_range, tail1 and up1. Columns must not be null (``calibration.model_record``
    gives fallbacks); rows without a target are not for a suite.
    """
    columns = sorted({c for s in specs for c in s.columns})
    place = {c: i + 1 for i, c in enumerate(columns)}
    wanted = {s.name: (penalties or {}).get(s.name, s.penalties) for s in specs}
    moments = _moments(rows, columns, folds, sorted({s.only for s in specs}, key=str))
    out, open_ = [], []
    for spec in specs:
        at = [place[c] for c in spec.columns]
        ridge = np.diag([0.0, *[1.0] * len(at)])
        for fold in folds:
            if (fold, spec.only) not in moments:
                continue
            n, cross, targets = moments[fold, spec.only]
            mean, spread, turn = _scaled(cross, at)
            ones = [0, *at]
            inner, goal = turn @ cross[np.ix_(ones, ones)] @ turn.T, turn @ targets[TASKS[spec.task]][ones]
            for penalty in wanted[spec.name]:
                if spec.task == "range":
                    beta = np.linalg.solve(inner + penalty * ridge + 1e-10 * np.eye(len(ones)), goal)
                    out.append(Fit(spec, fold, penalty, n, _model(spec, mean, spread, beta, penalty)))
                else:
                    rate = float(np.clip(goal[0], 1e-5, 1 - 1e-5))
                    open_.append([spec, fold, penalty, n, mean, spread, np.array([np.log(rate / (1 - rate)), *[0.0] * len(at)])])
    return out + _newton(rows, columns, place, open_)


def _newton(rows: DataFrame, columns: list[str], place: dict[str, int], open_: list[list]) -> list[Fit]:
    """Logistic models by Newton's method: a pass gives the gradients and curvatures of all that have not converged."""
    done = []
    held = rows.select("cluster", "asset", "known", *columns, *TASKS.values(), *{m[0].only for m in open_ if m[0].only})
    for _ in range(NEWTON_STEPS):
        if not open_:
            break
        size = max(len(m[0].columns) + 1 for m in open_)
        width = size * (size + 1) // 2 + size + 1
        jobs = [(m[1], m[0].only, k) for k, m in enumerate(open_)]
        facts = [(TASKS[m[0].task], [0, *(place[c] for c in m[0].columns)], m[4], m[5], m[6]) for m in open_]

        def of(job: tuple, x: np.ndarray, targets: dict[str, np.ndarray], facts=facts, width=width) -> np.ndarray:
            target, ones, mean, spread, beta = facts[job[2]]
            z = x[:, ones].copy()
            z[:, 1:] = (z[:, 1:] - mean) / spread
            p = _sigmoid(z @ beta)
            curved = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
            sums = np.concatenate([[len(z)], z.T @ (p - targets[target]), curved[np.triu_indices(len(ones))]])
            return np.pad(sums, (0, width - len(sums)))

        found = _means(_sums(held, columns, jobs, of), width)
        still = []
        for k, m in enumerate(open_):
            spec, fold, penalty, n, mean, spread, beta = m
            size = len(beta)
            v = found[k][1]
            mask = np.array([0.0, *[1.0] * (size - 1)])
            gradient = v[1 : size + 1] + penalty * mask * beta
            hessian = _folded(v[size + 1 : size + 1 + size * (size + 1) // 2], size) + np.diag(penalty * mask) + 1e-8 * np.eye(size)
            step = np.linalg.solve(hessian, gradient)
            m[6] = beta - step
            if np.linalg.norm(step) < 1e-7:
                done.append(m)
            else:
                still.append(m)
        open_ = still
    return [Fit(m[0], m[1], m[2], m[3], _model(m[0], m[4], m[5], m[6], m[2])) for m in done + open_]


def fold_scores(rows: DataFrame, fits: list[Fit]) -> DataFrame:
    """name, penalty, fold, score: each fold's models on its own settled rows, the mean over assets of the mean absolute error of ranges or the Brier score; one pass for all."""
    columns = sorted({c for f in fits for c in f.spec.columns})
    flags = sorted({f.spec.only for f in fits if f.spec.only})
    held = rows.where("settled").select("asset", F.col("fold").cast("int").alias("fold"), *(F.col(c).cast("double") for c in columns), *(F.col(t).cast("double").alias(f"_{t}") for t in TASKS.values()), *(F.coalesce(F.col(c), F.lit(False)).alias(f"_only_{c}") for c in flags))
    facts = [(f.fold, f.spec.only, f.spec.task, [columns.index(c) for c in f.spec.columns], np.array([f.model.scaling[c][0] for c in f.spec.columns]), np.array([f.model.scaling[c][1] for c in f.spec.columns]), np.array(f.model.coefficients), f.model.intercept) for f in fits]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            get = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            x = np.column_stack([get[c].to_numpy(zero_copy_only=False) for c in columns])
            year = get["fold"].to_numpy(zero_copy_only=False)
            asset = get["asset"].dictionary_encode()
            code, names = asset.indices.to_numpy(zero_copy_only=False), asset.dictionary.to_pylist()
            for k, (fold, only, task, at, mean, spread, beta, start) in enumerate(facts):
                mine = (year == fold) & (get[f"_only_{only}"].to_numpy(zero_copy_only=False) if only else True)
                if not mine.any():
                    continue
                raw = (x[mine][:, at] - mean) / spread @ beta + start
                truth = get[f"_{TASKS[task]}"].to_numpy(zero_copy_only=False)[mine]
                error = np.abs(np.exp(truth) - np.exp(np.clip(raw, np.log(0.01), np.log(100.0)))) if task == "range" else (truth - _sigmoid(raw)) ** 2
                total, n = np.bincount(code[mine], error, len(names)), np.bincount(code[mine], minlength=len(names))
                out += [(k, names[i], float(total[i]), int(n[i])) for i in np.flatnonzero(n).tolist()]
            if len(out) > 10_000:
                yield _score_batch(out)
                out = []
        yield _score_batch(out)

    each = held.mapInArrow(judge, "job int, asset string, e double, n long").groupBy("job", "asset").agg((F.sum("e") / F.sum("n")).alias("e"))
    named = rows.sparkSession.createDataFrame([(k, f.spec.name, float(f.penalty), int(f.fold)) for k, f in enumerate(fits)], "job int, name string, penalty double, fold int")  # as many rows as models
    return each.groupBy("job").agg(F.avg("e").alias("score")).join(F.broadcast(named), "job").select("name", "penalty", "fold", "score")


def _score_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.float64(), pa.int64()))], ["job", "asset", "e", "n"])


@dataclass
class Suite:
    """Chosen penalties with their mean scores, and the final models."""

    tuning: list[tuple[str, float, float, int, bool]]  # name, penalty, mean score, folds, chosen
    final: dict[str, Fit]


def train(rows: DataFrame, specs: list[Spec], folds: list[int], final: int) -> Suite:
    """Tune each specification by walk-forward folds, then fit it with the chosen penalty on all that is known before ``final``.

    Chosen is the penalty of the least mean score over the folds, of equal ones the first tried.
    """
    scores: dict[tuple[str, float], list[float]] = {}
    for r in fold_scores(rows, fit(rows, specs, folds)).collect():  # as many rows as models
        scores.setdefault((r["name"], r["penalty"]), []).append(r["score"])
    tuning, chosen = [], {}
    for spec in specs:
        tried = [(p, scores[spec.name, p]) for p in spec.penalties if (spec.name, p) in scores]
        if not tried:
            raise ValueError(f"{spec.name}: no fold has rows to learn from and to judge")
        best = min(tried, key=lambda x: np.mean(x[1]))[0]
        chosen[spec.name] = (best,)
        tuning += [(spec.name, p, float(np.mean(s)), len(s), p == best) for p, s in tried]
    return Suite(tuning, {f.spec.name: f for f in fit(rows, specs, [final], chosen)})


def predictions(rows: DataFrame, suite: Suite) -> DataFrame:
    """rows with a column for each final model, named like it: a range or a probability."""
    return rows.withColumns({name: f.model.range_prediction() if f.spec.task == "range" else f.model.probability() for name, f in suite.final.items()})
