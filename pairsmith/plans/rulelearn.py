"""Blocking rules from a forest (L4-L8), on the driver: a forest has some thousand nodes at most."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import SparkSession

from pairsmith.plans.rules import Rule, parse_feature


@dataclass(frozen=True)
class Condition:
    feature: str
    sign: str  # "+": at least, "-": at most
    threshold: float


#: A tree's positive paths: each a set of conditions that leads from the root to a leaf of matches.
Paths = list[frozenset[Condition]]


def read_trees(spark: SparkSession, path: str) -> list[dict[int, dict]]:
    """The nodes of each tree of a saved RandomForestClassificationModel, from its node table."""
    trees: dict[int, dict[int, dict]] = defaultdict(dict)
    for r in spark.read.parquet(f"{path}/data").collect():
        n = r.nodeData
        trees[r.treeID][n.id] = {"left": n.leftChild, "right": n.rightChild, "stats": list(n.impurityStats), "feature": n.split.featureIndex, "at": (n.split.leftCategoriesOrThreshold or [0.0])[0]}
    return [trees[t] for t in sorted(trees)]


def read_forest(spark: SparkSession, path: str, features: list[str]) -> list[Paths]:
    """L4: positive paths of each tree of a saved forest."""
    return [positive_paths(nodes, features) for nodes in read_trees(spark, path)]


def explain(trees: list[dict[int, dict]], features: list[str], row: dict[str, float | None]) -> list[tuple[list[tuple[str, str, float, float]], float]]:
    """How each tree decides on one pair: its steps (feature, "<=" or ">", threshold, value; missing: 0) and the share of
    matches in the leaf they lead to."""
    out = []
    for nodes in trees:
        i, steps = 0, []
        while (n := nodes[i])["left"] >= 0:
            name = features[n["feature"]]
            value = row.get(name) or 0.0
            low = value <= n["at"]
            steps.append((name, "<=" if low else ">", n["at"], value))
            i = n["left"] if low else n["right"]
        total = sum(n["stats"])
        out.append((steps, n["stats"][1] / total if total else 0.0))
    return out


def positive_paths(nodes: dict[int, dict], features: list[str], root: int = 0) -> Paths:
    out: set[frozenset[Condition]] = set()
    todo: list[tuple[int, tuple[Condition, ...]]] = [(root, ())]
    while todo:
        i, path = todo.pop()
        n = nodes[i]
        if n["left"] < 0:
            if n["stats"][1] >= n["stats"][0]:
                out.add(_tightened(path))
            continue
        name = features[n["feature"]]
        todo.append((n["left"], (*path, Condition(name, "-", n["at"]))))
        todo.append((n["right"], (*path, Condition(name, "+", n["at"]))))
    return sorted(out, key=lambda p: sorted((c.feature, c.sign, c.threshold) for c in p))


def _tightened(path: tuple[Condition, ...]) -> frozenset[Condition]:
    best: dict[tuple[str, str], float] = {}
    for c in path:
        key = (c.feature, c.sign)
        best[key] = c.threshold if key not in best else (max if c.sign == "+" else min)(best[key], c.threshold)
    return frozenset(Condition(f, s, t) for (f, s), t in best.items())


def useful_sign(feature: str) -> str:
    """Distances match when small, similarities when large."""
    f = parse_feature(feature)
    return "-" if f.sim == "lev" and f.measure != "sim" else "+"


def ranges(forest: list[Paths]) -> dict[str, list[float]]:
    """For each feature the thresholds of its useful sign, tightest first."""
    found: dict[str, set[float]] = defaultdict(set)
    for tree in forest:
        for path in tree:
            for c in path:
                if c.sign == useful_sign(c.feature) and abs(c.threshold) != float("inf") and c.threshold == c.threshold:
                    found[c.feature].add(c.threshold)
    return {f: sorted(t, reverse=useful_sign(f) == "+") for f, t in found.items()}


def covered(path: frozenset[Condition], chosen: dict[str, float]) -> bool:
    """Whether every pair on the path satisfies one of the chosen rules."""
    for c in path:
        t = chosen.get(c.feature)
        if t is not None and c.sign == useful_sign(c.feature) and (c.threshold >= t if c.sign == "+" else c.threshold <= t):
            return True
    return False


def covered_trees(forest: list[Paths], chosen: dict[str, float]) -> int:
    return sum(all(covered(p, chosen) for p in tree) for tree in forest)


def extract(forest: list[Paths], share: float = 0.5) -> list[Rule]:
    """Rules such that more than this share of the trees have all positive paths covered. Starts at each feature's
    tightest threshold and loosens, one step at a time, the feature that covers most additional paths; ends when enough
    trees are covered or nothing is left to loosen. Features that add nothing are dropped afterwards (L7)."""
    steps = ranges(forest)
    at = dict.fromkeys(steps, 0)
    now = lambda: {f: steps[f][i] for f, i in at.items()}
    paths = [p for tree in forest for p in tree]
    while covered_trees(forest, now()) <= share * len(forest):
        gains = []
        for f in sorted(steps):
            if at[f] + 1 < len(steps[f]):
                gains.append((sum(covered(p, now() | {f: steps[f][at[f] + 1]}) for p in paths), f))
        if not gains:
            break
        at[max(gains, key=lambda g: (g[0], g[1]))[1]] += 1
    chosen = now()
    least = covered_trees(forest, chosen)
    for f in sorted(chosen, key=lambda f: sum(covered(p, {f: chosen[f]}) for p in paths)):
        fewer = {k: v for k, v in chosen.items() if k != f}
        if fewer and covered_trees(forest, fewer) >= least:
            chosen = fewer
    return [Rule(parse_feature(f), useful_sign(f), t) for f, t in sorted(chosen.items())]


class _Cover:
    """Which positive paths each rule covers, as bits, and which paths each tree has."""

    def __init__(self, forest: list[Paths], share: float) -> None:
        self.steps = {f: t for f, t in sorted(ranges(forest).items()) if t}
        self.features = list(self.steps)
        paths = [p for tree in forest for p in tree]
        self.by = {(f, i): sum(1 << k for k, p in enumerate(paths) if covered(p, {f: t})) for f, ts in self.steps.items() for i, t in enumerate(ts)}
        self.trees, at = [], 0
        for tree in forest:
            self.trees.append((1 << len(tree)) - 1 << at)
            at += len(tree)
        self.need = share * len(forest)

    def enough(self, bits: int) -> bool:
        return sum(t & bits == t for t in self.trees) > self.need

    def rules(self, chosen: dict[str, int]) -> list[Rule]:
        return [Rule(parse_feature(f), useful_sign(f), self.steps[f][i]) for f, i in sorted(chosen.items())]


def combinations(forest: list[Paths], share: float = 0.5, most: int = 10, visits: int = 1_000_000) -> list[list[Rule]]:
    """The ``most`` tightest combinations of rules that cover more than this share of the trees, tightest first.

    A combination takes one threshold, or none, of each feature, and none that it could do without. Its tightness is the
    sum, over its rules, of how many thresholds the feature has from that one on, divided by the number of rules. The
    search is depth first; a branch ends where all remaining features at their loosest would not cover enough trees, and
    altogether after so many visits (what was found until then is returned)."""
    c = _Cover(forest, share)
    loosest = [0] * (len(c.features) + 1)  # what the features from here on can cover at most
    for k in range(len(c.features) - 1, -1, -1):
        f = c.features[k]
        loosest[k] = loosest[k + 1] | c.by[f, len(c.steps[f]) - 1]
    found: dict[tuple, tuple] = {}
    todo: list[tuple[int, int, dict[str, int]]] = [(0, 0, {})]
    while todo and visits:
        visits -= 1
        k, bits, chosen = todo.pop()
        if c.enough(bits):
            if all(not c.enough(_union(c.by[x] for x in chosen.items() if x[0] != f)) for f in chosen):
                tight = sum(len(c.steps[f]) - i for f, i in chosen.items()) / len(chosen) if chosen else 0.0
                found[tuple(sorted(chosen.items()))] = (-tight, len(chosen), sorted(chosen.items()))
            continue
        if k == len(c.features) or not c.enough(bits | loosest[k]):
            continue
        f = c.features[k]
        todo.append((k + 1, bits, chosen))
        todo.extend((k + 1, bits | c.by[f, i], chosen | {f: i}) for i in range(len(c.steps[f]) - 1, -1, -1))
    return [c.rules(dict(x)) for x in sorted(found, key=found.__getitem__)[:most]]


def _union(bits) -> int:
    out = 0
    for b in bits:
        out |= b
    return out


def optimal(forest: list[Paths], share: float = 0.5) -> list[Rule]:
    """The tightest combination; the greedy one where none is found."""
    best = combinations(forest, share, 1)
    return best[0] if best else extract(forest, share)


def partial(forest: list[Paths], rules: list[Rule], short: set[str] = frozenset(), share: float = 0.5) -> list[Rule]:
    """The fewest of the rules that still cover more than this share of the trees, taken in one of two orders: by the
    number of paths they cover, or those on long attributes first. All of them, if they do not cover enough."""
    paths = [p for tree in forest for p in tree]
    size = {r: sum(covered(p, {r.feature.name: r.threshold}) for p in paths) for r in rules}
    orders = (sorted(rules, key=lambda r: (-size[r], str(r))), sorted(rules, key=lambda r: (r.feature.lattr in short, -size[r], str(r))))
    for n in range(1, len(rules)):
        for order in orders:
            if covered_trees(forest, {r.feature.name: r.threshold for r in order[:n]}) > share * len(forest):
                return sorted(order[:n], key=str)
    return sorted(rules, key=str)
