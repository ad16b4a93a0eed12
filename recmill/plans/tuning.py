"""Hyperparameter search: random or tree-structured Parzen proposals, with stopping rules for iterative trials."""

from __future__ import annotations

import json
import logging
import math
import random
import statistics
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from pathlib import Path

log = logging.getLogger("recmill")


@dataclass
class SearchParam:
    type: str
    min: float | None = None
    max: float | None = None
    scale: str = "uniform"
    choices: list = field(default_factory=list)
    base: float | None = None

    def __post_init__(self):
        if self.type not in ("int", "float", "bool", "choice"):
            raise ValueError(f"unknown type {self.type}")
        if self.scale not in ("uniform", "log", "pow2"):
            raise ValueError(f"unknown scale {self.scale}")
        if self.type == "choice" and not self.choices:
            raise ValueError("a choice needs choices")
        if self.type in ("int", "float"):
            if self.min is None or self.max is None or self.min > self.max:
                raise ValueError("a number needs min <= max")
            if self.scale != "uniform" and self.min <= 0:
                raise ValueError(f"scale {self.scale} needs a positive min")

    # numbers are searched on a line where the scale is even: [low, high]

    def line(self) -> tuple[float, float]:
        return self.to_line(self.min), self.to_line(self.max)

    def to_line(self, value: float) -> float:
        return math.log(value) if self.scale == "log" else math.log2(value) if self.scale == "pow2" else float(value)

    def from_line(self, x: float):
        v = math.exp(x) if self.scale == "log" else 2.0 ** round(x) if self.scale == "pow2" else x
        v = min(self.max, max(self.min, v))
        return int(round(v)) if self.type == "int" else v

    def options(self) -> list | None:
        return [False, True] if self.type == "bool" else self.choices if self.type == "choice" else None

    def sample(self, rng: random.Random):
        return rng.choice(self.options()) if self.options() is not None else self.from_line(rng.uniform(*self.line()))


def parzen_proposal(param: SearchParam, good: list, bad: list, rng: random.Random, candidates: int = 24):
    """Of ``candidates`` draws from the density of good values, the one with the greatest ratio of the density of good
    values to that of the others. Densities are mixtures of a prior (the whole range, or all options alike) and
    of one kernel for each value; a kernel is as wide as the gap to its neighbours."""
    options = param.options()
    if options is not None:
        share = lambda values, o: (values.count(o) + 1) / (len(values) + len(options))
        drawn = rng.choices(options, [share(good, o) for o in options], k=candidates)
        return max(drawn, key=lambda o: share(good, o) / share(bad, o))
    low, high = param.line()
    span = max(high - low, 1e-12)

    def kernels(values: list) -> list[tuple[float, float]]:
        at = sorted(param.to_line(v) for v in values)
        ends = [low, *at, high]
        widths = [max(ends[i + 1] - ends[i], ends[i + 2] - ends[i + 1]) for i in range(len(at))]
        return [(x, min(span, max(w, span / min(100, 2 + len(at))))) for x, w in zip(at, widths, strict=True)]

    def inside(m: float, s: float) -> float:
        cdf = lambda x: 0.5 * (1 + math.erf((x - m) / (s * math.sqrt(2))))
        return max(cdf(high) - cdf(low), 1e-12)

    def density(x: float, ks: list[tuple[float, float]]) -> float:
        return (1 / span + sum(math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi) * inside(m, s)) for m, s in ks)) / (1 + len(ks))

    kg, kb = kernels(good), kernels(bad)

    def draw() -> float:
        k = rng.randrange(len(kg) + 1)
        if k == len(kg):
            return rng.uniform(low, high)
        while True:
            x = rng.gauss(*kg[k])
            if low <= x <= high:
                return x

    return param.from_line(max((draw() for _ in range(candidates)), key=lambda x: density(x, kg) / density(x, kb)))


class PlateauStopRule:
    """Stop when the best value has improved by less than ``rel`` over the last ``iters`` iterations."""

    def __init__(self, iters: int = 3, rel: float = 0.01, direction: str = "max", min_iters: int = 0):
        self.iters, self.rel, self.direction, self.min_iters = iters, rel, direction, min_iters

    def should_stop(self, values: list[float]) -> bool:
        if len(values) <= max(self.iters, self.min_iters):
            return False
        best, best_now = (max, max) if self.direction == "max" else (min, min)
        before, now = best(values[: -self.iters]), best_now(values)
        return abs(now - before) <= self.rel * max(abs(before), 1e-12)


def median_prune(values: list[float], others: list[list[float]], min_trials: int = 5, direction: str = "max") -> bool:
    """Whether a trial does worse than the median of the finished ones at the same iteration."""
    at = len(values) - 1
    peers = [o[at] for o in others if len(o) > at]
    if len(peers) < min_trials:
        return False
    best = max(values) if direction == "max" else min(values)
    return best < statistics.median(peers) if direction == "max" else best > statistics.median(peers)


@dataclass
class Trial:
    config: dict
    value: float | None
    epochs: list[float]
    error: str | None = None


class PipelineTuner:
    """Trials of ``measure(config) -> float`` (or of an iterator of values, one per epoch).

    The default configuration goes first. Later proposals are drawn at random, or ("tpe"), after STARTUP random
    ones, from Parzen densities of the best tenth of the trials (25 at most) against all others. Trials that fail are kept
    with their error; a search in which all trials failed ends with an error. ``best()`` of such a search raises.
    """

    #: Trials before densities are used.
    STARTUP = 10

    def __init__(self, space: dict[str, SearchParam], measure: Callable[[dict], object], default: dict | None = None, metric: str = "NDCG", method: str = "tpe", max_points: int = 60, jobs: int = 1, seed: int = 0, plateau: PlateauStopRule | None = None):
        if method not in ("random", "tpe"):
            raise ValueError(f"no search method {method}: only random and tpe")
        self.space, self.measure, self.default, self.method = space, measure, default, method
        self.metric, self.max_points, self.jobs, self.rng = metric, max_points, jobs, random.Random(seed)
        self.direction = "min" if metric in ("RMSE", "MAE") else "max"
        self.plateau = plateau
        self.trials: list[Trial] = []

    def _order(self, t: Trial) -> float:
        return t.value if self.direction == "max" else -t.value

    def propose(self) -> dict:
        done = sorted((t for t in self.trials if t.value is not None), key=self._order, reverse=True)
        if self.method == "random" or len(done) < self.STARTUP:
            return {k: p.sample(self.rng) for k, p in self.space.items()}
        n = min(25, math.ceil(len(done) / 10))
        return {k: parzen_proposal(p, [t.config[k] for t in done[:n] if k in t.config], [t.config[k] for t in done[n:] if k in t.config], self.rng) for k, p in self.space.items()}

    def _try(self, config: dict) -> Trial:
        try:
            got = self.measure(config)
            if isinstance(got, int | float):
                return Trial(config, float(got), [float(got)])
            values: list[float] = []
            for v in got:
                values.append(float(v))
                if (self.plateau and self.plateau.should_stop(values)) or median_prune(values, [t.epochs for t in self.trials], direction=self.direction):
                    break
            return Trial(config, max(values) if self.direction == "max" else min(values), values)
        except Exception as e:  # noqa: BLE001 - a failed trial must not end the search
            log.warning("trial %s failed: %s", config, e)
            return Trial(config, None, [], f"{type(e).__name__}: {e}")

    def run(self) -> PipelineTuner:
        todo = [self.default] if self.default else []
        while len(self.trials) < self.max_points:
            k = min(self.jobs, self.max_points - len(self.trials))
            batch = [todo.pop(0) if todo else self.propose() for _ in range(k)]
            with ThreadPoolExecutor(k) as pool:  # concurrent Spark jobs of one session
                self.trials += list(pool.map(self._try, batch))
        if all(t.value is None for t in self.trials):
            raise RuntimeError(f"all {len(self.trials)} trials failed, the last one with: {self.trials[-1].error}")
        return self

    def best(self) -> Trial:
        return max((t for t in self.trials if t.value is not None), key=self._order)

    def best_config(self) -> dict:
        """The best configuration, with the number of epochs at its best value where trials are iterative."""
        t = self.best()
        return dict(t.config) | ({"epochs": t.epochs.index(t.value) + 1} if len(t.epochs) > 1 else {})

    def save(self, directory: str, task: dict | None = None, pipeline: Callable[[dict], dict] | None = None) -> None:
        """task.json, best-result.json, best-config.json, trials.ndjson, epochs.ndjson; with ``pipeline``, which makes a
        pipeline's configuration of the best one, also best-pipeline.json."""
        d = Path(directory)
        d.mkdir(parents=True, exist_ok=True)
        about = {"metric": self.metric, "method": self.method, "max_points": self.max_points, "space": {k: asdict(p) for k, p in self.space.items()}, "default": self.default, "trials": len(self.trials), "failed": sum(t.value is None for t in self.trials)}
        (d / "task.json").write_text(json.dumps(about | (task or {}), default=str))
        if pipeline is not None:
            (d / "best-pipeline.json").write_text(json.dumps(pipeline(self.best_config()), default=str))
        (d / "best-result.json").write_text(json.dumps({"value": self.best().value, "metric": self.metric}))
        (d / "best-config.json").write_text(json.dumps(self.best_config()))
        (d / "trials.ndjson").write_text("".join(json.dumps(t.__dict__) + "\n" for t in self.trials))
        (d / "epochs.ndjson").write_text("".join(json.dumps({"trial": i, "epoch": e + 1, "value": v}) + "\n" for i, t in enumerate(self.trials) for e, v in enumerate(t.epochs)))
