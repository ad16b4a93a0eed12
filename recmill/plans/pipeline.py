"""Pipelines: a graph of named nodes over DataFrames. A node is an input, a constant or a component; running the
graph composes one lazy plan for all queries, which Catalyst then optimises as a whole."""

from __future__ import annotations

import copy
import hashlib
import importlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, is_dataclass
from graphlib import CycleError, TopologicalSorter
from typing import Any, get_origin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.models.base import Scorer, TrainingOptions
from recmill.operators import lists
from recmill.session import cut


class PipelineError(ValueError):
    pass


class Lazy:
    """An input that is made only when the component calls ``get``: annotate the parameter with this class."""

    def __init__(self, make: Callable[[], Any]):
        self._make, self._made = make, []

    def get(self) -> Any:
        if not self._made:
            self._made.append(self._make())
        return self._made[0]


class PipelineState(Mapping):
    """Results by node name; aliases lead to their node."""

    def __init__(self, state: dict | None = None, aliases: dict | None = None, default: str | None = None, meta: dict | None = None):
        self._state, self.aliases, self.default, self.meta = dict(state or {}), dict(aliases or {}), default, dict(meta or {})

    def __getitem__(self, name: str) -> Any:
        return self._state[self.aliases.get(name, name)]

    def __contains__(self, name: object) -> bool:
        return self.aliases.get(name, name) in self._state

    def __iter__(self):
        return iter(self._state)

    def __len__(self) -> int:
        return len(self._state)

    @property
    def default_value(self) -> Any:
        """The result of the default node; a KeyError where there is none."""
        if self.default is None:
            raise KeyError("no default node")
        return self[self.default]


def accepts(types: Sequence, value: Any) -> bool:
    """Whether a value may go where ``types`` are asked for: no types accept anything, None among them nothing at all,
    int goes for float, and what cannot be checked (strings, generics of unknown contents) is accepted."""
    if not types:
        return True
    for t in types:
        if t is None or t is type(None):
            if value is None:
                return True
        elif t is Any or isinstance(t, str):
            return True
        else:
            plain = get_origin(t) or t
            if not isinstance(plain, type) or isinstance(value, plain) or (plain is float and isinstance(value, int)):
                return True
    return False


@dataclass
class Node:
    name: str
    kind: str  # input, literal, component, first_of
    value: Any = None
    inputs: dict[str, str] = field(default_factory=dict)
    types: tuple = ()


class Component:
    """Base of components: configuration in ``config``, ``__call__`` over DataFrames by input name."""

    config: dict

    def __init__(self, **config):
        self.config = config

    def inputs(self) -> list[str]:
        import inspect

        return [p for p in inspect.signature(self.__call__).parameters]

    def lazy_inputs(self) -> set[str]:
        import inspect

        return {n for n, p in inspect.signature(self.__call__).parameters.items() if p.annotation is Lazy or str(p.annotation).split("[")[0].split(".")[-1] == "Lazy"}


class HistoryLookup(Component):
    """The interactions of the queries' users: those that come with the query, else those of training."""

    def train(self, log: DataFrame, options: TrainingOptions) -> None:
        self.log = log

    def __call__(self, query: DataFrame, past: DataFrame | None = None) -> DataFrame:
        found = self.log.join(query.select("user_id").distinct(), "user_id", "left_semi")
        if past is None:
            return found
        return found.join(past.select("user_id").distinct(), "user_id", "left_anti").unionByName(past, allowMissingColumns=True)


class TrainingCandidates(Component):
    """All training items but the query's (exclude="query") or none left out (exclude=None).

    Where it is told what the candidates are for (reach="scorer node"; limit=n, or n with the run), it asks that
    scorer for candidates that hold the best n instead, so that users and items are not multiplied.
    """

    scorer: Scorer | None = None

    def train(self, log: DataFrame, options: TrainingOptions) -> None:
        self.log = log
        self.items = log.where("item_id is not null").select("item_id").distinct()

    def __call__(self, query: DataFrame, history: DataFrame, n: int | None = None, past: DataFrame | None = None) -> DataFrame:
        n, keep = n if n is not None else self.config.get("limit"), self.config.get("exclude", "query") in (None, "none")
        if self.scorer is not None and n is not None and n >= 0 and not keep and past is None:
            reach = self.scorer.reach_trained if self.scorer.trained_on is self.log else self.scorer.reach
            found = reach(query.select("user_id").distinct(), history, n)
            if found is not None:
                return found
        return lists.candidates(query, self.items, None if keep else history)


class ScorerComponent(Component):
    """Scores pairs by a model. Users who come with a history of their own are scored by it, the others as trained."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer
        self.config = {"class": import_path(type(scorer)), **_plain(scorer.config)}

    def train(self, log: DataFrame, options: TrainingOptions) -> None:
        self.scorer.train(log, options)

    def __call__(self, items: DataFrame, past: DataFrame | None = None) -> DataFrame:
        if past is None:
            return self.scorer.score(items)
        users = past.where("user_id is not null").select("user_id").distinct()
        with_past, others = items.join(users, "user_id", "left_semi"), items.join(users, "user_id", "left_anti")
        return self.scorer.score(with_past, past).unionByName(self.scorer.score(others), allowMissingColumns=True)


class TopNRanker(Component):
    def __call__(self, items: DataFrame, n: int | None) -> DataFrame:
        return lists.rank_lists(items, ["user_id"], n=n if n is not None else self.config.get("n"))


class StochasticRanker(Component):
    def __call__(self, items: DataFrame, n: int | None) -> DataFrame:
        c = self.config
        return lists.stochastic_top_n(items, ["user_id"], n if n is not None else c.get("n"), c.get("transform", "softmax"), c.get("scale", 1.0), c.get("seed", 0))


class FallbackFill(Component):
    def __call__(self, primary: DataFrame, backup: DataFrame) -> DataFrame:
        return lists.fill_scores(primary, backup, ["user_id"])


class Placeholder(Component):
    def __call__(self) -> DataFrame:
        raise PipelineError("a placeholder cannot be run")


def _plain(config) -> dict:
    d = asdict(config) if is_dataclass(config) else dict(config or {})
    return {k: sorted(v) if isinstance(v, set | frozenset) else v for k, v in d.items()}


def import_path(obj) -> str:
    return f"{obj.__module__}:{obj.__qualname__}"


def type_name(t) -> str:
    return "none" if t is None or t is type(None) else t if isinstance(t, str) else import_path(get_origin(t) or t)


def from_path(path: str):
    module, _, name = path.partition(":")
    obj = importlib.import_module(module)
    for part in name.split("."):
        obj = getattr(obj, part)
    return obj


class PipelineBuilder:
    def __init__(self, name: str | None = None, version: str | None = None):
        self.name, self.version = name, version
        self.nodes: dict[str, Node] = {}
        self.aliases: dict[str, str] = {}
        self.defaults: dict[str, str] = {}
        self.default_node: str | None = None
        self.hooks: list[tuple[int, Callable]] = []

    def _add(self, node: Node) -> Node:
        if node.name in self.nodes or node.name in self.aliases:
            raise PipelineError(f"there is a node {node.name}")
        self.nodes[node.name] = node
        return node

    def create_input(self, name: str, *types) -> Node:
        """None among the types makes the input optional."""
        return self._add(Node(name, "input", types=types))

    def literal(self, value, name: str | None = None) -> Node:
        return self._add(Node(name or f"literal-{len(self.nodes)}", "literal", value))

    def add_component(self, name: str, component: Component | Callable, **inputs) -> Node:
        return self._add(Node(name, "component", component, {k: self._name(v) for k, v in inputs.items()}))

    def replace_component(self, name: str, component: Component | Callable, **inputs) -> Node:
        old = self.nodes[name]
        self.nodes[name] = Node(name, "component", component, {**old.inputs, **{k: self._name(v) for k, v in inputs.items()}})
        return self.nodes[name]

    def connect(self, node: str | Node, **inputs) -> None:
        self.nodes[self._name(node)].inputs |= {k: self._name(v) for k, v in inputs.items()}

    def clear_inputs(self, node: str | Node) -> None:
        self.nodes[self._name(node)].inputs = {}

    def alias(self, name: str, node: str | Node) -> None:
        if name in self.nodes:
            raise PipelineError(f"there is a node {name}")
        self.aliases[name] = self._name(node)

    def default_connection(self, name: str, node: str | Node) -> None:
        self.defaults[name] = self._name(node)

    def default_component(self, node: str | Node) -> None:
        self.default_node = self._name(node)

    def use_first_of(self, name: str, primary: str | Node, fallback: str | Node) -> Node:
        """The primary's whole result unless it is None."""
        return self._add(Node(name, "first_of", inputs={"primary": self._name(primary), "fallback": self._name(fallback)}))

    def add_run_hook(self, hook: Callable, priority: int = 1) -> None:
        """hook(node, input, value) -> value, called for every component input, lower priorities first."""
        self.hooks.append((priority, hook))

    def _name(self, node) -> str:
        if isinstance(node, Node):
            return node.name
        if not isinstance(node, str):
            return self.literal(node).name
        return self.aliases.get(node, node)

    def wired(self) -> dict[str, Node]:
        out = {}
        for n in self.nodes.values():
            inputs = dict(n.inputs)
            if n.kind == "component":
                known = n.value.inputs() if isinstance(n.value, Component) else [p for p in n.value.__code__.co_varnames[: n.value.__code__.co_argcount]]
                for i in known:
                    if i not in inputs:
                        found = self.defaults.get(i) or (i if i in self.nodes else self.aliases.get(i))
                        if found:
                            inputs[i] = found
            for i in inputs.values():
                if i not in self.nodes:
                    raise PipelineError(f"{n.name} needs an unknown node {i}")
            out[n.name] = Node(n.name, n.kind, n.value, inputs, n.types)
        return out

    def validate(self) -> list[str]:
        """Topological order of the nodes; cycles are errors."""
        try:
            return list(TopologicalSorter({n.name: list(n.inputs.values()) for n in self.wired().values()}).static_order())
        except CycleError as e:
            raise PipelineError(f"cycle: {e.args[1]}") from e

    def build(self, cache: dict | None = None) -> Pipeline:
        self.validate()
        nodes = self.wired()
        for n in nodes.values():
            reach = n.value.config.get("reach") if isinstance(n.value, TrainingCandidates) else None
            if reach is not None and reach in nodes:
                n.value.scorer = nodes[reach].value.scorer
            elif n.kind == "component" and isinstance(n.value, Component) and cache is not None:
                n.value = cache.setdefault((import_path(type(n.value)), json.dumps(n.value.config, sort_keys=True, default=str)), n.value)
        return Pipeline(self, nodes)

    def build_config(self, include_hash: bool = True) -> dict:
        d = {"meta": {"name": self.name, "version": self.version}, "inputs": {n.name: [type_name(t) for t in n.types] for n in self.nodes.values() if n.kind == "input"}, "literals": {n.name: n.value for n in self.nodes.values() if n.kind == "literal"}, "components": {}, "aliases": self.aliases, "defaults": self.defaults, "default": self.default_node}
        for n in self.nodes.values():
            if n.kind == "component":
                code = import_path(type(n.value)) if isinstance(n.value, Component) else import_path(n.value)
                d["components"][n.name] = {"code": code, "config": n.value.config if isinstance(n.value, Component) else None, "inputs": n.inputs}
            elif n.kind == "first_of":
                d["components"][n.name] = {"code": "@first-of", "config": None, "inputs": n.inputs}
        if include_hash:
            d["meta"]["hash"] = config_hash(d)
        return d

    @classmethod
    def from_config(cls, d: dict) -> PipelineBuilder:
        b = cls(d["meta"].get("name"), d["meta"].get("version"))
        for n, types in d["inputs"].items():
            b.create_input(n, *[None if t == "none" else from_path(t) for t in types])
        for n, v in d["literals"].items():
            b.literal(v, n)
        for n, c in d["components"].items():
            if c["code"] == "@first-of":
                b.nodes[n] = Node(n, "first_of", inputs=dict(c["inputs"]))
                continue
            made = from_path(c["code"])
            config = dict(c["config"] or {})
            if made is ScorerComponent:
                made = ScorerComponent(from_path(config.pop("class"))(**config))
            elif isinstance(made, type):
                made = made(**config)
            b.nodes[n] = Node(n, "component", made, dict(c["inputs"]))
        b.aliases, b.defaults, b.default_node = dict(d["aliases"]), dict(d["defaults"]), d["default"]
        return b


def config_hash(d: dict) -> str:
    def drop(x):
        return {k: drop(v) for k, v in x.items() if v is not None and k != "hash"} if isinstance(x, dict) else x

    return hashlib.sha256(json.dumps(drop(d), sort_keys=True, default=str).encode()).hexdigest()


def merge_configs(base: dict, update: dict) -> dict:
    """Recursive; a component whose code changes loses its old configuration."""
    out = dict(base)
    for k, v in update.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            old = out[k]
            if "code" in v and v["code"] != old.get("code"):
                old = {x: y for x, y in old.items() if x != "config"}
            out[k] = merge_configs(old, v)
        else:
            out[k] = v
    return out


class Pipeline:
    def __init__(self, builder: PipelineBuilder, nodes: dict[str, Node]):
        self.builder, self.nodes = builder, nodes
        self.profile: list[dict] = []
        self.measured = False

    def component_names(self) -> list[str]:
        return [n for n in self.builder.validate() if self.nodes[n].kind == "component"]

    def train(self, log: DataFrame, options: TrainingOptions | None = None) -> None:
        """Each trainable component once, with a seed of its own."""
        options, done = options or TrainingOptions(), set()
        for i, n in enumerate(self.component_names()):
            c = self.nodes[n].value
            if hasattr(c, "train") and id(c) not in done:
                done.add(id(c))
                c.train(log, TrainingOptions(options.retrain, options.seed + i, options.environment))

    def run(self, node: str | None = None, **inputs):
        names = [node or self.builder.default_node or list(self.nodes)[-1]]
        return self.run_all(*names, **inputs)[names[0]]

    def measure(self, on: bool = True) -> Pipeline:
        """From now on every component's frame is written before the next one uses it, and the profile has the time
        that took, not that of building a plan."""
        self.measured = on
        return self

    def run_all(self, *names: str, **inputs) -> PipelineState:
        """Results by name; a node runs once however many need it, and only if something needs it."""
        state: dict[str, Any] = {}

        def get(name: str):
            name = self.builder.aliases.get(name, name)
            if name in state:
                return state[name]
            n = self.nodes[name]
            if n.kind == "input":
                if name not in inputs and type(None) not in n.types and None not in n.types:
                    raise PipelineError(f"input {name} is missing")
                out = inputs.get(name)
                if not accepts(n.types, out):
                    raise PipelineError(f"input {name} is a {type(out).__name__}")
            elif n.kind == "literal":
                out = n.value
            elif n.kind == "first_of":
                out = get(n.inputs["primary"])
                out = get(n.inputs["fallback"]) if out is None else out
            else:
                args, late = {}, n.value.lazy_inputs() if isinstance(n.value, Component) else set()
                for i, source in n.inputs.items():
                    v = Lazy(lambda source=source: get(source)) if i in late else get(source)
                    for _, hook in sorted(self.builder.hooks, key=lambda h: h[0]):
                        v = hook(n, i, v)
                    args[i] = v
                began = time.perf_counter_ns()
                out = n.value(**args)
                if self.measured and isinstance(out, DataFrame):
                    out = cut(out, "stage")
                self.profile.append({"node": name, "ns": time.perf_counter_ns() - began})
            state[name] = out
            return out

        for x in names or self.component_names():
            get(x)
        return PipelineState(state, self.builder.aliases, self.builder.default_node, {"name": self.builder.name, "version": self.builder.version})

    def clone(self) -> Pipeline:
        """An untrained copy."""
        return PipelineBuilder.from_config(copy.deepcopy(self.builder.build_config(False))).build()

    def modify(self) -> PipelineBuilder:
        b = copy.copy(self.builder)
        b.nodes, b.aliases, b.defaults = dict(b.nodes), dict(b.aliases), dict(b.defaults)
        return b

    def write_profile(self, path: str) -> None:
        with open(path, "w") as f:
            f.write("node,ns\n" + "".join(f"{r['node']},{r['ns']}\n" for r in self.profile))

    def mermaid(self, direction: str = "TB") -> str:
        at = {n: f"n{i}" for i, n in enumerate(self.nodes)}
        shape = {"input": "[/{}/]", "literal": "({})", "component": "[{}]", "first_of": "{{{{{}}}}}"}
        out = [f"flowchart {direction}", *[f"  {at[n.name]}{shape[n.kind].format(n.name)}" for n in self.nodes.values()]]
        return "\n".join(out + [f"  {at[s]} -->|{i}| {at[n.name]}" for n in self.nodes.values() for i, s in n.inputs.items()])


def topn_builder(scorer: Scorer, n: int | None = None, ranker: Component | None = None, fallback: Scorer | None = None, reranker: Component | None = None) -> PipelineBuilder:
    """query -> history -> candidates -> scorer -> ranker (-> reranker); with a fallback also a rating predictor.

    The input ``past`` (user_id, item_id, rating, ...) gives users a history of their own: it reaches the
    candidates and all scorers, so new users can be served and known ones seen anew.
    """
    b = PipelineBuilder("topn")
    q = b.create_input("query", DataFrame)
    past = b.create_input("past", DataFrame, None)
    items = b.create_input("items", DataFrame, None)
    size = b.create_input("n", int, None)
    h = b.add_component("history-lookup", HistoryLookup(), query=q, past=past)
    # a ranker other than the plain one may draw on any candidate
    plain = reranker is None and (ranker is None or type(ranker) is TopNRanker)
    c = b.add_component("candidate-selector", TrainingCandidates(reach="scorer", limit=ranker.config.get("n") if ranker else n) if plain else TrainingCandidates(), query=q, history=h, n=size, past=past)
    cand = b.use_first_of("candidates", items, c)
    s = b.add_component("scorer", ScorerComponent(scorer), items=cand, past=past)
    r = b.add_component("ranker", ranker or TopNRanker(n=n), items=s, n=size)
    if reranker is not None:
        r = b.add_component("reranker", reranker, items=r)
    b.alias("recommender", r)
    b.default_component(r)
    if fallback is not None:
        f = b.add_component("fallback-predictor", ScorerComponent(fallback), items=cand, past=past)
        b.add_component("rating-predictor", FallbackFill(), primary=s, backup=f)
    return b


def topn_pipeline(scorer: Scorer, n: int | None = None, **options) -> Pipeline:
    return topn_builder(scorer, n, **options).build()


def predict_pipeline(scorer: Scorer, fallback: bool = True) -> Pipeline:
    from recmill.models.basic import BiasScorer

    b = PipelineBuilder("predict")
    items = b.create_input("items", DataFrame)
    past = b.create_input("past", DataFrame, None)
    s = b.add_component("scorer", ScorerComponent(scorer), items=items, past=past)
    if fallback:
        f = b.add_component("fallback-predictor", ScorerComponent(BiasScorer()), items=items, past=past)
        s = b.add_component("rating-predictor", FallbackFill(), primary=s, backup=f)
    b.alias("predictor", s)
    b.default_component(s)
    return b.build()


# -- batches of queries: the same plan, for all of them at once


def normalize_queries(spark, queries) -> DataFrame:
    """Users (a list, or a frame with user_id or query_id) as a query frame; an id of 0 or "" is an id."""
    if isinstance(queries, DataFrame):
        return queries if "user_id" in queries.columns else queries.withColumn("user_id", F.col("query_id"))
    ids = list(queries)
    return spark.createDataFrame([(x,) for x in ids], f"user_id {'string' if ids and isinstance(ids[0], str) else 'long'}")


def recommend(pipeline: Pipeline, spark, queries, n: int | None = None, items: DataFrame | None = None) -> DataFrame:
    return pipeline.run("recommender", query=normalize_queries(spark, queries), n=n, items=items)


def score(pipeline: Pipeline, pairs: DataFrame) -> DataFrame:
    return pipeline.run("scorer", query=pairs, items=pairs)


def predict(pipeline: Pipeline, pairs: DataFrame) -> DataFrame:
    name = "rating-predictor" if "rating-predictor" in pipeline.nodes else "scorer"
    given = {"items": pairs} | ({"query": pairs} if "query" in pipeline.nodes else {})
    return pipeline.run(name, **given)


class BatchRunner:
    """Invocations of pipeline nodes for one batch of queries; results by output name."""

    def __init__(self):
        self.invocations: list[tuple[str, str, dict]] = []

    def add(self, output: str, node: str, **inputs) -> None:
        self.invocations.append((output, node, inputs))

    def recommend(self, n: int | None = None) -> None:
        self.add("recommendations", "recommender", n=n)

    def run(self, pipeline: Pipeline, spark, queries) -> dict[str, DataFrame]:
        q = normalize_queries(spark, queries)
        return {out: pipeline.run(node, query=q, **inputs) for out, node, inputs in self.invocations}
