"""Sequential orderings of the nodes of one dense distance matrix, in numpy."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


def path_length(d: np.ndarray, path: list[int], closed: bool = False) -> float:
    p = np.asarray(path)
    total = d[p[:-1], p[1:]].sum() if len(p) > 1 else 0
    return float(total + (d[p[-1], p[0]] if closed and len(p) > 1 else 0))


def check_permutation(path: list[int], n: int) -> list[int]:
    if sorted(path) != list(range(n)):
        raise ValueError("the ordering lost or repeated nodes")
    return path


def greedy(d: np.ndarray, start: int = 0) -> list[int]:
    """Always to the nearest unvisited node, ties to the smaller."""
    n, path = len(d), [start] if len(d) else []
    free = np.ones(n, dtype=bool)
    while len(path) < n:
        free[path[-1]] = False
        path.append(int(np.where(free, d[path[-1]], np.inf).argmin()))
    return path


def minimum_spanning_tree(d: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a minimum spanning tree of the symmetric least of both directions; zero is the best weight (Prim)."""
    n = len(d)
    w = np.minimum(d, d.T).astype(float)
    best, source, inside, edges = np.full(n, np.inf), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (w[at] < best) & ~inside
        best[closer], source[closer] = w[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((int(source[at]), at))
    return edges


def tree_walk(d: np.ndarray, edges: list[tuple[int, int]], depth_first: bool = False) -> list[int]:
    """From the first leaf, breadth first with nearer children first, or depth first."""
    n = len(d)
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    w = np.minimum(d, d.T)
    start = next((i for i in range(n) if len(near[i]) <= 1), 0)
    todo, seen, out = deque([start] if n else []), {start}, []
    while todo:
        a = todo.pop() if depth_first else todo.popleft()
        out.append(a)
        fresh = sorted((x for x in near[a] if x not in seen), key=lambda x: (w[a, x], x))
        seen.update(fresh)
        todo.extend(reversed(fresh) if depth_first else fresh)
    return out


def arborescence(d: np.ndarray, root: int = 0) -> list[int]:
    """Parents (-1 for the root) of a minimum spanning arborescence: cheapest entries, cycles contracted one by one."""
    n = len(d)
    cost = d.astype(float).copy()
    np.fill_diagonal(cost, np.inf)

    def solve(cost: np.ndarray, root: int) -> np.ndarray:
        m = len(cost)
        parent = cost.argmin(0)
        parent[root] = -1
        colour = np.zeros(m, dtype=int)
        cycle: list[int] = []
        for i in range(m):
            path, at = [], i
            while at != -1 and colour[at] == 0:
                colour[at] = i + 1
                path.append(at)
                at = int(parent[at])
            if at != -1 and colour[at] == i + 1 and at in path:
                cycle = path[path.index(at) :]
                break
        if not cycle:
            return parent
        inner = np.array(cycle)
        outer = np.array([i for i in range(m) if i not in set(cycle)])
        k = len(outer)
        small = np.full((k + 1, k + 1), np.inf)
        small[:k, :k] = cost[np.ix_(outer, outer)]
        small[k, :k] = cost[np.ix_(inner, outer)].min(0)
        leave = inner[cost[np.ix_(inner, outer)].argmin(0)]
        enter = cost[np.ix_(outer, inner)] - cost[parent[inner], inner]
        small[:k, k] = enter.min(1)
        into = inner[enter.argmin(1)]
        below = solve(small, int(np.flatnonzero(outer == root)[0]))
        out = parent.copy()
        for i, node in enumerate(outer):
            p = int(below[i])
            out[node] = -1 if p == -1 else int(leave[i]) if p == k else int(outer[p])
        broken = int(below[k])
        out[into[broken]] = int(outer[broken])
        return out

    return [] if n == 0 else [-1] if n == 1 else solve(cost, root).tolist()


def arborescence_walk(d: np.ndarray, root: int = 0) -> list[int]:
    """Breadth first from the root, nearer children first."""
    parent = arborescence(d, root)
    children: list[list[int]] = [[] for _ in parent]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    todo, out = deque([root] if parent else []), []
    while todo:
        a = todo.popleft()
        out.append(a)
        todo.extend(sorted(children[a], key=lambda x: (d[a, x], x)))
    return out


def travelling(d: np.ndarray, kicks: int = 20, seed: int = 42) -> list[int]:
    """An open path from node 0 by iterated local search; nothing is ever reversed, so distances may differ by direction.

    Nearest neighbours, then runs of nodes move to where they help most.  After that two neighbouring runs of the best
    path change places at random cuts, ``kicks`` times, and each result is improved and kept if it is shorter.
    """
    w = d.astype(float)
    best = improved(w, greedy(d))
    n, length = len(best), path_length(w, best)
    rng = np.random.default_rng(seed)
    for _ in range(kicks if n > 4 else 0):
        a, b, c = np.sort(rng.choice(np.arange(1, n + 1), 3, replace=False)).tolist()
        path = improved(w, best[:a] + best[b:c] + best[a:b] + best[c:])
        if path_length(w, path) < length - 1e-9:
            best, length = path, path_length(w, path)
    return best


def improved(w: np.ndarray, path: list[int], sweeps: int = 30, runs: tuple[int, ...] = (1, 2, 3, 5, 8, 13)) -> list[int]:
    """``path`` after moves of runs of nodes, never reversed, each to its best place, while they shorten it.

    The runs are tried from left to right; some are priced at once, and those behind the first move are priced again.
    """
    n = len(path)
    whole = n * n <= 8192  # else a few columns at a time
    step = n if whole else max(1, 8192 // n)
    p = np.array(path, dtype=int)
    along = w[p[:, None], p] if whole else None  # by places on the path
    for _ in range(sweeps):
        improved = False
        for size in runs:
            i = 1
            while i + size <= n:
                j = min(n - size + 1, i + step)
                cost = along[:, i:j].copy() if whole else w[p[:, None], p[i:j]]
                leave = along[i + size - 1 : j + size - 1] if whole else w[p[i + size - 1 : j + size - 1, None], p]
                edge = along.diagonal(1) if whole else w[p[:-1], p[1:]]
                cost[:-1] += leave[:, 1:].T
                cost[:-1] -= edge[:, None]
                cost[_inside(n, size)[:, i:j] if whole else _between(np.arange(n), np.arange(i, j), size)] = np.inf
                gain, end = edge[i - 1 : j - 1].copy(), min(j, n - size)
                gain[: end - i] += edge[i + size - 1 : end + size - 1] - (along.diagonal(size + 1)[i - 1 : end - 1] if whole else w[p[i - 1 : end - 1], p[i + size : end + size]])
                better = cost.min(0) < gain - 1e-9
                at = int(better.argmax())
                if better[at]:
                    k, i = int(cost[:, at].argmin()), i + at
                    run, rest = p[i : i + size], np.delete(p, slice(i, i + size))
                    k -= size if k > i else 0
                    p = np.concatenate([rest[: k + 1], run, rest[k + 1 :]])
                    along = w[p[:, None], p] if whole else None
                    improved = True
                    i += 1
                else:
                    i = j
        if not improved:
            break
    return p.tolist()


def _between(k: np.ndarray, i: np.ndarray, size: int) -> np.ndarray:
    """Whether place k is just before or in the run of ``size`` nodes from place i."""
    far = k[:, None] - i
    return (far >= -1) & (far < size)


@lru_cache(maxsize=1 << 10)
def _inside(n: int, size: int) -> np.ndarray:
    return _between(np.arange(n), np.arange(n), size)


@dataclass(frozen=True)
class Colony:
    """ants 0: the root of the number of nodes, from 16 to 128."""

    ants: int = 0
    iterations: int = 100
    alpha: float = 1.0
    beta: float = 2.0
    rho: float = 0.3
    deposit: float = 100.0
    patience: int = 50
    symmetric: bool = False
    next_id: bool = False  # where all choices are hopeless: the next unvisited id, not a uniform draw
    seed: int = 42


def _raced(cost: np.ndarray, start: np.ndarray, rng: np.random.Generator, race: np.ndarray) -> np.ndarray:
    """A tour a column from ``start``; an ant's next node is drawn among its unvisited ones in proportion to 1 / ``cost``.

    Each node's cost is multiplied by an exponential draw and the least wins, which has these odds.  ``race`` is a table of such
    draws, read from a random place at each step.
    """
    n, ants = len(cost), len(start)
    tours, visited, score = np.empty((n, ants), dtype=np.intp), np.zeros((ants, n), dtype=np.float32), np.empty((ants, n), dtype=np.float32)
    tours[0], flat, row = start, visited.reshape(-1), np.arange(ants) * n
    flat[row + start] = np.inf
    places = rng.integers(0, len(race) - ants * n + 1, n).tolist()
    for step in range(1, n):
        cost.take(tours[step - 1], 0, score, "clip")
        score *= race[places[step] : places[step] + ants * n].reshape(ants, n)
        score += visited
        score.argmin(1, out=tours[step])
        flat[row + tours[step]] = np.inf
    return tours


def _wheeled(pull: np.ndarray, start: np.ndarray, rng: np.random.Generator, next_id: bool) -> np.ndarray:
    """As ``_raced`` in proportion to ``pull``, which may be so small or large that sums lose it; where all is lost, as ``Colony.next_id`` says."""
    n, ants = len(pull), len(start)
    pull, every, below = pull.ravel(), np.arange(ants), np.tri(n)
    tours = np.empty((n, ants), dtype=int)
    tours[0] = start
    draws = rng.random((n, ants))
    left = np.repeat(np.arange(n)[:, None], ants, 1)  # the first m are each ant's unvisited nodes
    left[tours[0], every] = n - 1
    for step in range(1, n):
        m = n - step
        p = pull.take(left[:m] + tours[step - 1] * n)
        wheel = below[:m, :m] @ p
        if wheel[-1].min() <= 0:
            lost = wheel[-1] <= 0
            p[:, lost] = 1.0 / (1 + (left[:m, lost] - tours[step - 1, lost]) % n) ** 64 if next_id else 1.0
            wheel = below[:m, :m] @ p
        choice = (wheel >= draws[step] * wheel[-1]).argmax(0)  # the last place is never below the draw
        tours[step] = left[choice, every]
        left[choice, every] = left[m - 1]
    return tours


def ant_colony(d: np.ndarray, c: Colony = Colony(), log: list[tuple[int, float, float]] | None = None) -> tuple[list[int], float]:
    """Best closed tour found; all ants of an iteration advance together, one choice each at a time.

    ``log`` receives (iteration, shortest tour of it, shortest so far) of every iteration.
    """
    n = len(d)
    if n < 2:
        return list(range(n)), 0.0
    rng = np.random.default_rng(c.seed)
    ants = c.ants or int(np.clip(np.sqrt(n), 16, 128))
    w = d.astype(float)
    heuristic = (1 / (w + 0.1)) ** c.beta
    tau = np.ones((n, n))
    best, length, idle = list(range(n)), path_length(w, list(range(n)), True), 0
    race = rng.standard_exponential(max(1 << 18, 4 * ants * n), dtype=np.float32)
    for _ in range(c.iterations):
        pull, start = tau**c.alpha * heuristic, rng.integers(0, n, ants)
        usual = 1e-30 < pull.min() and pull.max() < 1e30
        tours = (_raced((1 / pull).astype(np.float32), start, rng, race) if usual else _wheeled(pull, start, rng, c.next_id)).T
        edges = tours * n + np.roll(tours, -1, 1)
        lengths = w.take(edges).sum(1)
        k = int(lengths.argmin())
        if lengths[k] < length:
            best, length, idle = tours[k].tolist(), float(lengths[k]), 0
        else:
            idle += 1
        if log is not None:
            log.append((len(log), float(lengths[k]), length))
        tau *= 1 - c.rho
        give = np.bincount(edges.ravel(), np.repeat(c.deposit / np.maximum(lengths, 1e-9), n), n * n).reshape(n, n)
        tau += give + give.T if c.symmetric else give
        if idle >= c.patience:
            break
    at = best.index(0)
    best = best[at:] + best[:at]
    if abs(path_length(w, best, True) - length) > 1e-6:
        raise ValueError("the tour's length is wrong")
    return best, length


def reorder(nodes: list[int], branches: list[tuple[int, int, int]]) -> list[int]:
    """Moves, one branch after the other, the nodes in [start, end) right behind the node ``branch``, which must be elsewhere."""
    out = list(nodes)
    for start, end, branch in branches:
        moved = [x for x in out if start <= x < end]
        rest = [x for x in out if not start <= x < end]
        if branch not in rest:
            raise ValueError(f"the branch point {branch} is not among the other nodes")
        at = rest.index(branch) + 1
        out = rest[:at] + moved + rest[at:]
    return out


def topological(nodes: list[int], edges: list[tuple[int, int]]) -> list[int]:
    """First in, first out over nodes without open parents, ids rising at the start; (child, parent) edges; a cycle raises."""
    open_parents = {x: 0 for x in nodes}
    children: dict[int, list[int]] = {x: [] for x in nodes}
    for child, parent in edges:
        if child in open_parents and parent in open_parents:
            open_parents[child] += 1
            children[parent].append(child)
    todo, out = deque(sorted(x for x, k in open_parents.items() if k == 0)), []
    while todo:
        a = todo.popleft()
        out.append(a)
        for b in sorted(children[a]):
            open_parents[b] -= 1
            if not open_parents[b]:
                todo.append(b)
    if len(out) != len(open_parents):
        raise ValueError("the edges hold a cycle")
    return out
