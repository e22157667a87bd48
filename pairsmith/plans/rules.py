"""Blocking rules and features (S7, S8, L8): parsing, validation, simplification and writing."""

from __future__ import annotations

from dataclasses import dataclass, replace

SET_SIMS = ("jac", "cos", "dice", "overlap")
SIMS = (*SET_SIMS, "lev", "exm", "anm")
MEASURES = ("dist", "sim")


@dataclass(frozen=True)
class Feature:
    lattr: str
    rattr: str
    sim: str
    measure: str | None = None
    tok: str | None = None
    setting: str | None = None

    @property
    def name(self) -> str:
        if self.tok:
            one = f"{self.tok}_{self.setting}" if self.setting else self.tok
            return f"{self.lattr}_{self.rattr}_{self.sim}_{one}_{one}"
        return "_".join(filter(None, (self.lattr, self.rattr, self.sim, self.measure)))


@dataclass(frozen=True)
class Rule:
    feature: Feature
    sign: str
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature.name} {self.sign} {self.threshold:.4f}"


def parse_feature(name: str) -> Feature:
    """lattr_rattr_sim[_tok[_setting]...] or lattr_rattr_sim_(dist|sim); only the first tokenizer counts. Attribute
    names may hold underscores if both sides are named alike."""
    parts = name.split("_")
    at = next((i for i, p in enumerate(parts) if i >= 2 and p in SIMS and i % 2 == 0 and parts[: i // 2] == parts[i // 2 : i]), None)
    if at is None:
        at = 2
    if at >= len(parts) or parts[at] not in SIMS:
        raise ValueError(f"no similarity in feature {name!r}")
    left, right = "_".join(parts[: at // 2]), "_".join(parts[at // 2 : at])
    rest = parts[at + 1 :]
    if rest and rest[0] in MEASURES:
        return Feature(left, right, parts[at], measure=rest[0])
    if rest:
        tok = rest[0]
        setting = rest[1] if len(rest) > 1 and rest[1] != tok else None
        return Feature(left, right, parts[at], tok=tok, setting=setting)
    return Feature(left, right, parts[at])


def parse_rule(line: str) -> Rule:
    name, sign, threshold = line.split()
    rule = Rule(parse_feature(name), sign, float(threshold))
    wanted = "-" if rule.feature.sim == "lev" and rule.feature.measure != "sim" else "+"
    if sign != wanted:
        raise ValueError(f"rule {line!r}: sign {wanted} expected for {rule.feature.sim}")
    if rule.feature.sim in SET_SIMS and not rule.feature.tok:
        raise ValueError(f"rule {line!r}: a tokenizer is needed")
    return rule


def _body(text: str) -> list[str]:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not lines or not lines[0].isdigit() or int(lines[0]) != len(lines) - 1:
        raise ValueError("the first line must hold the number of lines that follow")
    return lines[1:]


def parse_rules(text: str) -> list[Rule]:
    return [parse_rule(x) for x in _body(text)]


def parse_features(text: str) -> list[Feature]:
    return [parse_feature(x) for x in _body(text)]


def write_rules(rules: list[Rule]) -> str:
    return "\n".join([str(len(rules)), *map(str, rules)]) + "\n"


def simplify(rules: list[Rule]) -> list[Rule]:
    """Rules of one feature become the loosest of them; edit distance 0 goes where an equality rule covers the attribute.
    Equality rules ignore their threshold. Order follows cost: equality, numbers, sets, edit distance."""
    loosest: dict[Feature, Rule] = {}
    for r in rules:
        known = loosest.get(r.feature)
        if known is None or (r.threshold < known.threshold) == (r.sign == "+"):
            loosest[r.feature] = r
    equal = {(r.feature.lattr, r.feature.rattr) for r in loosest.values() if r.feature.sim == "exm"}
    kept = [replace(r) for r in loosest.values() if not (r.feature.sim == "lev" and r.feature.measure != "sim" and r.threshold < 1 - 1e-5 and (r.feature.lattr, r.feature.rattr) in equal)]
    order = {"exm": 0, "anm": 1, "overlap": 2, "dice": 2, "cos": 2, "jac": 2, "lev": 3}
    return sorted(kept, key=lambda r: (order[r.feature.sim], r.feature.name))
