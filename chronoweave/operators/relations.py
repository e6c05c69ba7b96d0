"""Temporal relations of two intervals, the first of which comes first."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and short signs, by number.
SEVEN = ["before", "meet", "overlap", "finishby", "contain", "starts", "equal"]
SEVEN_SIGNS = ["<", "m", "o", "f", "c", "s", "="]
THREE = ["before", "overlap", "contain"]
# Which relations of A to C three-relation mining allows for those of A to B and B to C.
THREE_TABLE = {(0, 0): [0], (0, 1): [0], (0, 2): [0], (1, 0): [0], (1, 1): [0, 1], (1, 2): [0, 1, 2], (2, 0): [0, 1, 2], (2, 1): [1, 2], (2, 2): [2]}


def _cases(s1, e1, s2, e2, gap: int, eps: int) -> list[tuple]:
    return [
        ("undefined", (s2 - e1 > gap) | (s1 > s2)),
        ("before", (s2 - e1 > eps) & (s2 - e1 < gap)),
        ("meet", (s2 - s1 > eps) & (abs(e1 - s2) <= eps) & (e1 - e2 < eps)),
        ("overlap", (s2 - s1 > eps) & (e1 - s2 > eps) & (e1 - e2 < eps)),
        ("equal", (abs(s2 - s1) <= eps) & (abs(e1 - e2) <= eps)),
        ("contain", (s2 - s1 > eps) & (e1 - e2 > eps)),
        ("starts", (abs(s2 - s1) <= eps) & (e2 - e1 > eps)),
        ("finishby", (s2 - s1 > eps) & (abs(e1 - e2) <= eps)),
    ]


class _Column:
    """abs() of a column difference."""

    def __init__(self, c: Column):
        self.c = c

    def __sub__(self, other):
        return _Difference(self.c - other.c)

    def __gt__(self, other):
        return self.c > other.c


class _Difference:
    def __init__(self, c: Column):
        self.c = c

    def __abs__(self):
        return _Difference(F.abs(self.c))

    def __gt__(self, x):
        return self.c > x

    def __lt__(self, x):
        return self.c < x

    def __le__(self, x):
        return self.c <= x


def relation(s1: Column, e1: Column, s2: Column, e2: Column, max_gap: int, eps: int = 0, kinds: int = 7) -> Column:
    """Number of the first relation that holds, or null. A gap of exactly `max_gap` has none."""
    out = F.lit(None).cast("int")
    for name, holds in reversed(_cases(*map(_Column, (s1, e1, s2, e2)), max_gap, eps)):
        out = F.when(holds, F.lit(number(name, kinds)).cast("int")).otherwise(out)
    return out


def number(name: str, kinds: int) -> int | None:
    if name == "undefined":
        return None
    if kinds == 7:
        return SEVEN.index(name)
    return THREE.index({"meet": "before", "equal": "contain", "starts": "contain", "finishby": "contain"}.get(name, name))


def relation_of(a: tuple[int, int], b: tuple[int, int], max_gap: int, eps: int = 0, kinds: int = 7) -> int | None:
    """The same for two plain intervals."""
    for name, holds in _cases(*a, *b, max_gap, eps):
        if holds:
            return number(name, kinds)
    return None


def compositions(kinds: int = 7) -> dict[tuple[int, int], list[int]]:
    """Relations of A to C that those of A to B and B to C allow; of seven, from all interval triples on a small lattice."""
    if kinds == 3:
        return THREE_TABLE
    spans = [(a, b) for a, b in product(range(9), repeat=2) if a < b]
    pairs: dict = {}
    for a, b in product(spans, repeat=2):
        if (r := relation_of(a, b, 99)) is not None and a != b or a == b:
            pairs.setdefault(a, []).append((b, r))
    out: dict = {}
    for a in spans:
        for b, ab in pairs[a]:
            for c, bc in pairs[b]:
                if (ac := relation_of(a, c, 99)) is not None:
                    out.setdefault((ab, bc), set()).add(ac)
    return {k: sorted(v) for k, v in sorted(out.items())}


def pairs(sti: DataFrame, max_gap: int, eps: int = 0, kinds: int = 7, same_symbol: bool = False, skip_followers: bool = True, skip_same_variable: bool = False, symbols: list[int] | None = None) -> DataFrame:
    """(entity, pos_a, pos_b, sym_a, sym_b, rel, starts and ends): related intervals of one entity; `sti` has `pos`.

    Both sides are dealt by entity, which the windows before have done already."""
    if symbols:
        sti = sti.where(F.col("state").isin(symbols))
    side = lambda x: sti.select("entity", *(F.col(c).alias(f"{n}_{x}") for c, n in (("pos", "pos"), ("state", "sym"), ("variable", "var"), ("start", "start"), ("end", "end"))))
    near = F.expr("pos_a < pos_b") & (F.col("start_b") - F.col("end_a") <= max_gap)
    if not same_symbol:
        near &= F.expr("sym_a != sym_b")
    if skip_followers:
        near &= F.expr("not (var_a = var_b and abs(sym_a - sym_b) = 1)")
    if skip_same_variable:
        near &= F.expr("var_a != var_b")
    joined = side("a").join(side("b"), "entity").where(near)
    out = joined.withColumn("rel", relation(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b"), max_gap, eps, kinds))
    return out.where("rel is not null").select("entity", "pos_a", "pos_b", "sym_a", "sym_b", "rel", "start_a", "end_a", "start_b", "end_b")
