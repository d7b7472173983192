"""Ordered rule lists learned by incremental reduced-error pruning, and their SQL form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A condition: feature, "<=" or ">", threshold.
Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Rule:
    """``label`` holds where all ``conditions`` hold."""

    label: str
    conditions: tuple[Condition, ...]


def _holds(x: dict[str, np.ndarray], conditions) -> np.ndarray:
    n = len(next(iter(x.values())))
    out = np.ones(n, bool)
    for name, op, t in conditions:
        out &= (x[name] <= t) if op == "<=" else (x[name] > t)
    return out


def _cuts(v: np.ndarray, most: int = 64) -> np.ndarray:
    """Thresholds midway between neighbouring values, at most ``most`` of them, spread over the ranks."""
    u = np.unique(v)
    if len(u) < 2:
        return u[:0]
    mid = (u[1:] + u[:-1]) / 2
    return mid[np.unique(np.linspace(0, len(mid) - 1, min(most, len(mid))).astype(int))]


def _grow(x: dict[str, np.ndarray], y: np.ndarray, longest: int) -> list[Condition]:
    """Conditions added one by one for the greatest gain in information on positives, until no negative is left."""
    conditions: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(conditions) < longest:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if not p or not n:
            break
        base, best, gain = np.log2(p / (p + n)), None, 1e-9
        for name, v in x.items():
            vi, yi = v[inside], y[inside]
            cuts = _cuts(vi)
            if not len(cuts):
                continue
            by = np.argsort(vi, kind="stable")
            below = np.searchsorted(vi[by], cuts, "right")
            pos = np.concatenate([[0], np.cumsum(yi[by])])[below]
            for op, pp, nn in (("<=", pos, below - pos), (">", p - pos, n - (below - pos))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
                k = int(np.argmax(g))
                if g[k] > gain:
                    gain, best = float(g[k]), (name, op, float(cuts[k]))
        if best is None:
            break
        conditions.append(best)
        inside &= _holds(x, [best])
    return conditions


def _worth(x: dict[str, np.ndarray], y: np.ndarray, conditions) -> float:
    hit = _holds(x, conditions)
    p, n = int(y[hit].sum()), int((~y[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def induce(x: dict[str, np.ndarray], labels: np.ndarray, default: str, seed: int = 0, longest: int = 5, least: float = 0.6, order: tuple[str, ...] = (), tries: int = 5) -> list[Rule]:
    """A rule list for ``labels`` over the features ``x``, labels in ``order``, others rarest first; ``default`` gets no rules.

    For each rule the examples left are parted 2:1. The rule is grown on the first part until pure,
    then final conditions are dropped as long as its worth (p - n) / (p + n) on the second part does not
    fall. A rule that is then worth less than ``least`` or covers nothing new is given up, and a label is done after ``tries`` such, each with
    other parts; the examples a rule covers are removed before the next.
    """
    rng = np.random.default_rng(seed)
    left = np.ones(len(labels), bool)
    rules: list[Rule] = []
    for label in sorted((v for v in set(labels.tolist()) if v != default), key=lambda v: (order.index(v) if v in order else len(order), int((labels == v).sum()), v)):
        misses = 0
        while misses < tries:
            at = np.flatnonzero(left)
            if not (labels[at] == label).any():
                break
            by = rng.permutation(at)
            # both parts get their share of positives
            pos, neg = by[labels[by] == label], by[labels[by] != label]
            first = np.concatenate([pos[: -(len(pos) // 3) or None], neg[: -(len(neg) // 3) or None]])
            second = np.setdiff1d(by, first)
            view = lambda i: ({k: v[i] for k, v in x.items()}, labels[i] == label)
            conditions = _grow(*view(first), longest)
            if not conditions:
                misses += 1
                continue
            held = view(second)
            while len(conditions) > 1 and _worth(*held, conditions[:-1]) >= _worth(*held, conditions):
                conditions = conditions[:-1]
            covered = left & _holds(x, conditions)
            if _worth(*held, conditions) < least or not (labels[covered] == label).any():
                misses += 1
                continue
            rules.append(Rule(label, tuple(conditions)))
            left &= ~covered
    return rules


def apply(rules: list[Rule], x: dict[str, np.ndarray], default: str) -> np.ndarray:
    """The label of the first rule that holds for each row, else ``default``."""
    n = len(next(iter(x.values())))
    out, open_ = np.full(n, default, object), np.ones(n, bool)
    for r in rules:
        hit = open_ & _holds(x, r.conditions)
        out[hit] = r.label
        open_ &= ~hit
    return out


def to_sql(rules: list[Rule], default: str, prefix: str = "") -> str:
    """The list as one SQL CASE expression over columns named like the features, after ``prefix``."""
    when = " ".join(f"WHEN {' AND '.join(f'{prefix}{name} {op} {t!r}D' for name, op, t in r.conditions)} THEN '{r.label}'" for r in rules)
    return f"CASE {when} ELSE '{default}' END" if rules else f"'{default}'"


def dump(rules: list[Rule]) -> list:
    return [[r.label, [list(c) for c in r.conditions]] for r in rules]


def parse(stored: list) -> list[Rule]:
    return [Rule(label, tuple((n, op, float(t)) for n, op, t in conditions)) for label, conditions in stored]
