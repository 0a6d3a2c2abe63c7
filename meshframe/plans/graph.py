"""Graphs of named columns: nodes are functions of frames or columns, edges choose and rename what they hand on."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Columns = dict[str, Column]
Nodelike = Callable[[Columns], Columns]


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    features: tuple[str, ...] | None = None
    labels: tuple[str, ...] = ()
    rename: Mapping[str, str] = field(default_factory=dict)

    def carry(self, columns: Columns) -> Columns:
        """Listed features, those with the listed labels, or all; then renamed. What is absent is warned about."""
        if self.features is None and not self.labels:
            kept = dict(columns)
        else:
            kept = {k: v for k, v in columns.items() if k in (self.features or ()) or k.split("__", 1)[0] in self.labels and "__" in k}
            absent = [f for f in self.features or () if f not in columns]
            if absent:
                warnings.warn(f"{self.source} -> {self.target}: no {absent}", stacklevel=2)
        out: Columns = {}
        for k, v in kept.items():
            name = self.rename.get(k, k)
            if name in out:
                raise ValueError(f"{self.source} -> {self.target}: two columns become {name}")
            out[name] = v
        return out


class Node:
    """A function of columns with the names it reads and gives, and steps before and after."""

    def __init__(self, call: Nodelike, inputs: Sequence[str] | None = None, outputs: Sequence[str] | None = None, before: Sequence[Nodelike] = (), after: Sequence[Nodelike] = (), grouped: bool = False, takes: Sequence = (), gives: Sequence = ()):
        """``takes`` and ``gives`` are specs of values; where both ends of an edge have one, they must agree."""
        self.takes, self.gives = {s.name: s for s in takes}, {s.name: s for s in gives}
        self.call, self.inputs, self.outputs, self.before, self.after, self.grouped = call, inputs, outputs, before, after, grouped

    def __call__(self, columns: Columns) -> Columns:
        if self.inputs is not None:
            absent = [i for i in self.inputs if i not in columns]
            if absent:
                raise ValueError(f"inputs {absent} are missing")
            columns = {i: columns[i] for i in self.inputs}
        for f in self.before:
            columns = f(columns)
        out = self.call(group_labels(columns) if self.grouped else columns)
        if not isinstance(out, Mapping):
            values = out if isinstance(out, list | tuple) else [out]
            out = dict(zip(self.outputs or [f"output_{i}" for i in range(len(values))], values, strict=True))
        for f in self.after:
            out = f(out)
        if self.outputs is not None:
            absent = [o for o in self.outputs if o not in out]
            if absent:
                raise ValueError(f"outputs {absent} are missing")
        return dict(out)


def group_labels(columns: Columns) -> Columns:
    """Columns label__x as one struct for each label; others as they are."""
    out: Columns = {}
    groups: dict[str, list[Column]] = {}
    for k, v in columns.items():
        if "__" in k:
            label, name = k.split("__", 1)
            groups.setdefault(label, []).append(v.alias(name))
        else:
            out[k] = v
    return out | {label: F.struct(*parts) for label, parts in groups.items()}


class Graph:
    """A directed acyclic graph from "input" to "output". Running it only builds one projection, which Spark optimizes."""

    def __init__(self, name: str = "graph"):
        self.name = name
        self.nodes: dict[str, Nodelike | Graph | None] = {"input": None, "output": None}
        self.edges: list[Edge] = []

    def add_node(self, name: str, node) -> None:
        if name in self.nodes:
            raise ValueError(f"there is a node {name}")
        if node is self or any(node is n for n in self._deep()):
            raise ValueError("the node is in the graph already")
        self.nodes[name] = node

    def remove_node(self, name: str) -> None:
        if name in ("input", "output"):
            raise ValueError("input and output stay")
        del self.nodes[name]
        self.edges = [e for e in self.edges if name not in (e.source, e.target)]

    def _deep(self):
        for n in self.nodes.values():
            if n is not None:
                yield n
            if isinstance(n, Graph):
                yield from n._deep()

    def add_edge(self, source: str, target: str, features: Sequence[str] | None = None, labels: Sequence[str] = (), rename: Mapping[str, str] | None = None) -> None:
        for n in (source, target):
            if n not in self.nodes:
                raise KeyError(f"no node {n}")
        if source == "output" or target == "input":
            raise ValueError("no edge leaves output or enters input")
        edge = Edge(source, target, None if features is None else tuple(features), tuple(labels), dict(rename or {}))
        if any(e.source == source and e.target == target for e in self.edges):
            raise ValueError(f"there is an edge {source} -> {target}")
        given = {edge.rename.get(f, f) for f in edge.features or ()}
        for e in self.edges:
            if e.target == target and given & {e.rename.get(f, f) for f in e.features or ()}:
                raise ValueError(f"{target} gets {given} twice")
        self._check(edge)
        self.edges.append(edge)
        try:
            self.order()
        except ValueError:
            self.edges.pop()
            raise

    def _check(self, edge: Edge) -> None:
        """Values that both ends declare agree in rank, dtype, sizes and dims; an edge between declared ends carries one."""
        gives, takes = getattr(self.nodes[edge.source], "gives", {}), getattr(self.nodes[edge.target], "takes", {})
        if not gives or not takes:
            return
        sent = {edge.rename.get(k, k): s for k, s in gives.items() if (edge.features is None and not edge.labels) or k in (edge.features or ()) or s.label in edge.labels}
        both = sent.keys() & takes.keys()
        if not both:
            raise ValueError(f"{edge.source} -> {edge.target}: no value in common")
        for k in sorted(both):
            a, b = sent[k], takes[k]
            if not b.accepts(a) or (a.dims and b.dims and a.dims != b.dims):
                raise ValueError(f"{edge.source} -> {edge.target}: {k} is {a.dtype}{a.shape}{a.dims}, wanted {b.dtype}{b.shape}{b.dims}")

    def degree(self, name: str) -> int:
        return sum((e.source == name) + (e.target == name) for e in self.edges)

    def adjacent(self, name: str) -> list[str]:
        return sorted({e.target for e in self.edges if e.source == name} | {e.source for e in self.edges if e.target == name})

    def copy(self) -> Graph:
        """Another graph of the same nodes."""
        g = Graph(self.name)
        g.nodes, g.edges = dict(self.nodes), list(self.edges)
        return g

    def is_isomorphic(self, other: Graph) -> bool:
        """Whether some renaming of nodes makes the edges those of the other: search over nodes of like degrees."""
        own, theirs = {(e.source, e.target) for e in self.edges}, {(e.source, e.target) for e in other.edges}
        if len(self.nodes) != len(other.nodes) or len(own) != len(theirs):
            return False

        def mark(edges: set, n: str) -> tuple[int, int]:
            return sum(b == n for _, b in edges), sum(a == n for a, _ in edges)

        names = list(self.nodes)

        def place(i: int, to: dict[str, str]) -> bool:
            if i == len(names):
                return True
            for m in other.nodes:
                if m in to.values() or mark(own, names[i]) != mark(theirs, m):
                    continue
                now = {**to, names[i]: m}
                if all((((a, b) in own) == ((now[a], now[b]) in theirs)) for a in now for b in now if names[i] in (a, b)) and place(i + 1, now):
                    return True
            return False

        return place(0, {})

    def add_edges(self, edges: Sequence[tuple]) -> None:
        for e in edges:
            self.add_edge(*e)

    def remove_edge(self, source: str, target: str) -> None:
        kept = [e for e in self.edges if (e.source, e.target) != (source, target)]
        if len(kept) == len(self.edges):
            raise KeyError(f"no edge {source} -> {target}")
        self.edges = kept

    def order(self) -> list[str]:
        """Nodes after all they depend on."""
        left, out = {n: {e.source for e in self.edges if e.target == n} for n in self.nodes}, []
        while left:
            free = sorted(n for n, needs in left.items() if not needs - set(out))
            if not free:
                raise ValueError("the graph has a cycle")
            out += free
            for n in free:
                del left[n]
        return out

    def sources(self) -> list[str]:
        return [n for n in self.nodes if not any(e.target == n for e in self.edges)]

    def sinks(self) -> list[str]:
        return [n for n in self.nodes if not any(e.source == n for e in self.edges)]

    def find(self, path: str | Sequence[str]):
        """A node by name, by path through subgraphs, or by an end of its path that only it has."""
        parts = tuple(path.split("/")) if isinstance(path, str) else tuple(path)
        found = [(p, n) for p, n in self.paths() if p[-len(parts) :] == parts]
        exact = [n for p, n in found if p == parts]
        if exact:
            return exact[0]
        if len(found) != 1:
            raise KeyError(f"{len(found)} nodes match {path}")
        return found[0][1]

    def __contains__(self, path: str) -> bool:
        try:
            self.find(path)
        except KeyError:
            return False
        return True

    def paths(self):
        for name, n in self.nodes.items():
            yield (name,), n
            if isinstance(n, Graph):
                yield from (((name, *p), m) for p, m in n.paths() if p[-1] not in ("input", "output"))

    def __call__(self, columns: Columns) -> Columns:
        stray = [n for n in self.sources() if n != "input"] + [n for n in self.sinks() if n != "output"]
        if stray:
            raise ValueError(f"nodes {stray} are not connected")
        done: dict[str, Columns] = {"input": dict(columns)}
        for n in self.order():
            if n == "input":
                continue
            given: Columns = {}
            for e in self.edges:
                if e.target == n:
                    part = e.carry(done[e.source])
                    twice = set(part) & set(given)
                    if twice:
                        raise ValueError(f"{n} gets {sorted(twice)} twice")
                    given |= part
            done[n] = given if n == "output" else dict(self.nodes[n](given))
        return done["output"]

    def run(self, df: DataFrame, inputs: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """The graph over a frame's columns; inputs name graph inputs by column, ``keep`` passes columns through."""
        named = {k: F.col(c) for k, c in inputs.items()} if inputs else {c: F.col(c) for c in df.columns}
        return df.select(*[F.col(c) for c in keep], *[v.alias(k) for k, v in self(named).items()])

    def expand(self, name: str) -> None:
        """Puts a subgraph's nodes, named name.node, in its place."""
        child = self.nodes[name]
        if not isinstance(child, Graph):
            raise TypeError(f"{name} is no graph")
        entering, leaving = [e for e in self.edges if e.target == name], [e for e in self.edges if e.source == name]
        self.edges = [e for e in self.edges if name not in (e.source, e.target)]
        del self.nodes[name]
        for n, node in child.nodes.items():
            self.nodes[f"{name}.{n}"] = Node(dict) if n in ("input", "output") else node
        self.edges += [Edge(f"{name}.{e.source}", f"{name}.{e.target}", e.features, e.labels, e.rename) for e in child.edges]
        self.edges += [Edge(e.source, f"{name}.input", e.features, e.labels, e.rename) for e in entering]
        self.edges += [Edge(f"{name}.output", e.target, e.features, e.labels, e.rename) for e in leaving]

    def summary(self) -> str:
        lines = [self.name]
        for n in self.order():
            lines.append(f"  {n} <- {', '.join(e.source for e in self.edges if e.target == n) or '-'}")
        return "\n".join(lines)

    def to_json(self, registry: Mapping[str, Nodelike]) -> str:
        names = {id(f): k for k, f in registry.items()}
        nodes = {n: (json.loads(f.to_json(registry)) if isinstance(f, Graph) else names[id(f)]) for n, f in self.nodes.items() if f is not None}
        return json.dumps({"name": self.name, "nodes": nodes, "edges": [[e.source, e.target, e.features, e.labels, dict(e.rename)] for e in self.edges]})

    @classmethod
    def from_json(cls, text: str, registry: Mapping[str, Nodelike]) -> Graph:
        raw = json.loads(text)
        g = cls(raw["name"])
        for n, f in raw["nodes"].items():
            g.nodes[n] = cls.from_json(json.dumps(f), registry) if isinstance(f, dict) else registry[f]
        for s, t, features, labels, rename in raw["edges"]:
            g.add_edge(s, t, features, labels, rename)
        return g


def select_flat(columns: Mapping, name: str) -> Column:
    """The one entry of nested columns whose path ends with ``name`` (parts joined by /)."""
    flat: dict[tuple, Column] = {}

    def walk(part: Mapping, path: tuple) -> None:
        for k, v in part.items():
            walk(v, (*path, k)) if isinstance(v, Mapping) else flat.__setitem__((*path, k), v)

    walk(columns, ())
    parts = tuple(name.split("/"))
    found = [v for p, v in flat.items() if p[-len(parts) :] == parts]
    if len(found) != 1:
        raise KeyError(f"{len(found)} columns match {name}")
    return found[0]


def rename_found(columns: Mapping, names: Mapping[str, str]) -> Columns:
    """Nested columns made flat, the entries that names end with (parts joined by /) renamed; two may not become one."""
    out: Columns = {}
    found = dict.fromkeys(names, 0)

    def walk(part: Mapping, path: tuple) -> None:
        for k, v in part.items():
            if isinstance(v, Mapping):
                walk(v, (*path, k))
                continue
            at = (*path, k)
            hits = [n for n in names if at[-len(n.split("/")) :] == tuple(n.split("/"))]
            for n in hits:
                found[n] += 1
            name = names[hits[0]] if hits else k
            if name in out:
                raise ValueError(f"two columns become {name}")
            out[name] = v

    walk(columns, ())
    for n, times in found.items():
        if times != 1:
            raise KeyError(f"{times} columns match {n}")
    return out


def recurrence(inputs: Column, initial: Column, step: Callable[[Column, Column], Column], sequence: bool = False) -> Column:
    """state[0] = initial, state[i] = step(inputs[i - 1], state[i - 1]) along an array; the last state, or all of them."""
    if not sequence:
        return F.aggregate(inputs, initial, lambda s, x: step(x, s))
    start = F.struct(initial.alias("s"), F.array(initial).alias("all"))

    def grow(acc: Column, x: Column) -> Column:
        return F.element_at(F.transform(F.array(step(x, acc["s"])), lambda n: F.struct(n.alias("s"), F.array_append(acc["all"], n).alias("all"))), 1)

    return F.aggregate(inputs, start, grow, lambda acc: acc["all"])


def lstm(inputs: Column, weights: Mapping[str, Sequence]) -> Column:
    """The last hidden state of an LSTM with given weights over an array of input vectors.

    weights: "W" (inputs x 4 units), "U" (units x 4 units), "b" (4 units), gates in the order input, forget, cell, output.
    """
    w, u, b = weights["W"], weights["U"], weights["b"]
    units = len(b) // 4

    def sigmoid(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))

    def gate(x: Column, h: Column, j: int) -> Column:
        total = F.lit(float(b[j]))
        for i in range(len(w)):
            total = total + F.get(x, F.lit(i)) * float(w[i][j])
        for i in range(units):
            total = total + F.get(h, F.lit(i)) * float(u[i][j])
        return total

    def step(x: Column, s: Column) -> Column:
        cells = [sigmoid(gate(x, s["h"], units + j)) * F.get(s["c"], F.lit(j)) + sigmoid(gate(x, s["h"], j)) * F.tanh(gate(x, s["h"], 2 * units + j)) for j in range(units)]
        gates = F.array(*[sigmoid(gate(x, s["h"], 3 * units + j)) for j in range(units)])
        pair = F.struct(gates.alias("o"), F.array(*cells).alias("c"))
        return F.element_at(F.transform(F.array(pair), lambda p: F.struct(F.zip_with(p["o"], p["c"], lambda o, c: o * F.tanh(c)).alias("h"), p["c"].alias("c"))), 1)

    zero = F.array(*[F.lit(0.0)] * units)
    return recurrence(inputs, F.struct(zero.alias("h"), zero.alias("c")), step)["h"]


def cross_stitch(inputs: Column, cells: Sequence[Mapping[str, Sequence]]) -> Column:
    """The last hidden states, one array for each cell, of LSTM cells that see each other.

    Every cell reads the step's inputs, then the hidden states of the other cells in order, and its own state; weights as
    for ``lstm``, "W" having a row for each of these.
    """
    sizes = [len(c["b"]) // 4 for c in cells]

    def sigmoid(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))

    def gate(k: int, j: int, x: Column, s: Column, n: int) -> Column:
        w, u, b = cells[k]["W"], cells[k]["U"], cells[k]["b"]
        seen = [F.get(x, F.lit(i)) for i in range(n)] + [F.get(s[f"h{o}"], F.lit(i)) for o in range(len(cells)) if o != k for i in range(sizes[o])]
        total = F.lit(float(b[j]))
        for v, row in zip(seen, w, strict=True):
            total = total + v * float(row[j])
        for i in range(sizes[k]):
            total = total + F.get(s[f"h{k}"], F.lit(i)) * float(u[i][j])
        return total

    def step(x: Column, s: Column) -> Column:
        pairs = []
        for k, units in enumerate(sizes):
            n = len(cells[k]["W"]) - sum(sizes) + units
            c = [sigmoid(gate(k, units + j, x, s, n)) * F.get(s[f"c{k}"], F.lit(j)) + sigmoid(gate(k, j, x, s, n)) * F.tanh(gate(k, 2 * units + j, x, s, n)) for j in range(units)]
            pairs += [F.array(*c).alias(f"c{k}"), F.array(*[sigmoid(gate(k, 3 * units + j, x, s, n)) for j in range(units)]).alias(f"o{k}")]
        return F.element_at(F.transform(F.array(F.struct(*pairs)), lambda p: F.struct(*[v for k in range(len(cells)) for v in (F.zip_with(p[f"o{k}"], p[f"c{k}"], lambda o, c: o * F.tanh(c)).alias(f"h{k}"), p[f"c{k}"].alias(f"c{k}"))])), 1)

    zero = F.struct(*[v for k, n in enumerate(sizes) for v in (F.array(*[F.lit(0.0)] * n).alias(f"h{k}"), F.array(*[F.lit(0.0)] * n).alias(f"c{k}"))])
    last = recurrence(inputs, zero, step)
    return F.array(*[last[f"h{k}"] for k in range(len(cells))])


def score(df: DataFrame, model: Callable, schema: str) -> DataFrame:
    """A Python model over batches of rows: ``model()`` is made once in each task and called with pandas frames."""

    def run(parts):
        call = model()
        for pdf in parts:
            yield call(pdf)

    return df.mapInPandas(run, schema)
