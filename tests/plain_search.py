"""The search of one forest step by step, as a plain program to hold the library's against."""

import math
from collections import defaultdict

from arborix.operators.search import PRIOR_VISITS, ucb


def _unit(x):
    return 0.0 if x is None or math.isnan(x) else min(1.0, max(0.0, x))


class Forest:
    """The nodes of one document with their search state; ``free`` counts the leaves below a node that a batch may still take."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: (r[3], r[1]))
        self.pk, self.start = [r[1] for r in rows], [r[4] for r in rows]
        self.prior, self.score = ([_unit(r[c]) for r in rows] for c in (5, 6))
        index = {k: i for i, k in enumerate(self.pk)}
        self.parent = [None if r[2] is None else index.get(r[2], -1) for r in rows]
        self.kids: dict[int | None, list[int]] = defaultdict(list)
        for i, p in enumerate(self.parent):
            self.kids[p].append(i)
        self.visits, self.value, self.free = [0] * len(rows), [0.0] * len(rows), [0] * len(rows)
        for i in range(len(rows)):
            if not self.kids.get(i):
                self.reserve(i, -1)
        roots = self.kids.get(None, [])
        if len(roots) == 1:  # nothing to choose from, so nothing to score
            self.visits[roots[0]], self.value[roots[0]] = PRIOR_VISITS, float(PRIOR_VISITS)
            self.seeded: set[int | None] = {None}
        else:
            self.seeded = set()

    def line(self, i: int):
        """A node and its ancestors."""
        while i is not None and i >= 0:
            yield i
            i = self.parent[i]

    def reserve(self, leaf: int, n: int = 1) -> None:
        for i in self.line(leaf):
            self.free[i] -= n

    def descend(self) -> int | None:
        """The leaf that the bounds lead to; children get their prior when their parent is first entered."""
        at: int | None = None
        while True:
            if at not in self.seeded:
                for c in self.kids[at]:
                    self.visits[c] += PRIOR_VISITS
                    self.value[c] += PRIOR_VISITS * self.prior[c]
                self.seeded.add(at)
            above = None if at is None else self.visits[at]
            open_kids = [c for c in self.kids[at] if self.free[c]]
            if not open_kids:
                return None
            at = max(open_kids, key=lambda c: ucb(self.value[c], self.visits[c], above))
            if not self.kids.get(at):
                return at

    def run(self, iterations: int, workers: int, top: int) -> list[tuple]:
        """Best leaves as (node_pk, value, visits, rank, leaves seen)."""
        seen: set[int] = set()
        done = 0
        while done < iterations:
            batch: list[int] = []
            while len(batch) < min(workers, iterations - done) and (leaf := self.descend()) is not None:
                self.reserve(leaf)
                batch.append(leaf)
            if not batch:
                break
            for leaf in batch:
                self.reserve(leaf, -1)
                for i in self.line(leaf):
                    self.visits[i] += 1
                    self.value[i] += self.score[leaf]
            seen.update(batch)
            done += len(batch)
        mean = {i: self.value[i] / self.visits[i] for i in seen}
        best = sorted(seen, key=lambda i: (-mean[i], -self.visits[i], self.start[i], self.pk[i]))[:top]
        return [(self.pk[i], round(mean[i], 4), self.visits[i], r, len(seen)) for r, i in enumerate(best, 1)]
