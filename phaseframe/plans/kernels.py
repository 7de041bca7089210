"""The sequential steps of phasing, each over one bounded group: a block's reads, or a contig's graph.

Ties are decided by explicit orders (fragment order, smallest cluster), so results do not depend on hashing.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

Read = list[tuple[int, int, float]]  # (site, allele, weight), by site
Piles = dict[int, dict[int, float]]


def log_p(n: float, k: float, p: float, div: float = 0.25) -> float:
    if n == 0:
        return 0.0
    a = min(max(k / n, 1e-7), 0.9999999)
    value = -(n / div) * (a * math.log(a / p) + (1 - a) * math.log((1 - a) / (1 - p)))
    return -value if a < p else value


def agreement(read: Read, piles: Piles, epsilon: float) -> tuple[float, float]:
    """same and diff of a read against a pileup; uncovered sites cost epsilon, ties with the top count as same."""
    same = diff = 0.0
    for site, allele, weight in read:
        at = piles.get(site)
        if not at:
            diff += epsilon
        elif at.get(allele, 0.0) >= max(at.values()) - 1e-9:
            same += weight
        else:
            diff += weight
    return same, diff


def _add(piles: Piles, read: Read, sign: int = 1) -> None:
    for site, allele, weight in read:
        at = piles.setdefault(site, {})
        at[allele] = at.get(allele, 0.0) + sign * weight
        if at[allele] <= 1e-9:
            del at[allele]
            if not at:
                del piles[site]


def piles_of(reads: list[Read], clusters: list[int], ploidy: int) -> list[Piles]:
    out: list[Piles] = [{} for _ in range(ploidy)]
    for read, c in zip(reads, clusters, strict=True):
        _add(out[c], read)
    return out


def errors(piles: list[Piles], epsilon: float) -> tuple[float, float]:
    """bases and errors over all clusters."""
    bases = wrong = 0.0
    for cluster in piles:
        for at in cluster.values():
            top, total = max(at.values()), sum(at.values())
            bases += top
            wrong += total - top + (epsilon if top <= 1 else 0.0)
    return bases, wrong


class Grid:
    """Reads in fragment order as flat arrays: of each observation its read, its site and allele as numbers from 0, and its weight."""

    def __init__(self, sizes: np.ndarray, sites: np.ndarray, alleles: np.ndarray, weights: np.ndarray) -> None:
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.read = np.repeat(np.arange(len(sizes)), sizes)
        self.names, site = np.unique(sites, return_inverse=True)
        found, allele = np.unique(alleles, return_inverse=True)
        self.site, self.allele, self.weight = site.astype(np.int64), allele.astype(np.int64), np.asarray(weights, float)
        self.n_alleles = len(found)

    def __len__(self) -> int:
        return len(self.ends)


def grid(reads: list[Read]) -> Grid:
    flat = [o for r in reads for o in r]
    return Grid(np.array([len(r) for r in reads], np.int64), *(np.array([o[k] for o in flat]) for k in range(3)))


def _chances(n: np.ndarray, k: np.ndarray, p: float, div: float = 0.25) -> np.ndarray:
    """log_p of whole arrays."""
    a = np.minimum(np.maximum(k / np.maximum(n, 1.0), 1e-7), 0.9999999)
    value = -(n / div) * (a * np.log(a / p) + (1 - a) * np.log((1 - a) / (1 - p)))
    return np.where(a < p, -value, value)


def _marks(values: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A number for each weight at its place; states with the same piles have the same sum of them."""
    return (values.view(np.uint64) >> np.uint64(20)) * salt


def _beam(g: Grid, ploidy: int, epsilon: float, width: int) -> np.ndarray:
    """beam_search over a Grid. A read costs the same wherever it is in the block: states lie in slots of one array, paths are
    kept as steps back, and of two ways to a state only the places of the new read are looked at, unless their marks meet."""
    if ploidy == 1 or not len(g):
        return np.zeros(len(g), np.int64)
    slots = 2 * width * ploidy
    piles = np.zeros((slots, len(g.names), g.n_alleles, ploidy))
    flat = piles.reshape(-1, ploidy)
    salt = np.random.default_rng(0).integers(1 << 63, size=piles.shape[1:], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    slot, score, place, marks = np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64)
    last = np.full((1, ploidy), -1)  # the last site of each cluster
    before = reach = 0  # sites before the first one are of no more use, those from the second on are bare
    least, steps, lows = math.log(0.01), [], np.arange(ploidy)
    for k in range(len(g)):
        own = slice(g.begins[k], g.ends[k])
        site, allele, weight = g.site[own], g.allele[own], g.weight[own][:, None, None]
        start = int(site[0])
        cell = (slot * piles.shape[1] + site[:, None]) * g.n_alleles  # of site and state
        mine, top = flat.take(cell + allele[:, None], axis=0), flat.take(cell, axis=0)
        for a in range(1, g.n_alleles):
            np.maximum(top, flat.take(cell + a, axis=0), out=top)
        fits, bare = mine >= top - 1e-9, top == 0
        diff = np.where(bare, epsilon, ~fits * weight).sum(axis=0)
        same = ((fits & ~bare) * weight).sum(axis=0)
        chance = _chances(np.floor(same + diff), np.floor(diff), epsilon)
        high = chance.max(axis=1, keepdims=True)
        good = chance - (high + np.log(np.exp(chance - high).sum(axis=1, keepdims=True))) > least
        void = last < before
        if void.any():  # empty clusters are alike
            good &= ~(void & (void.cumsum(axis=1) > 1))
        total = (score[:, None] + diff).ravel()
        if start > before:
            gone = piles[slot, before:start]
            marks = marks - _marks(gone, salt[before:start]).reshape(len(slot), -1).sum(axis=1, dtype=np.uint64)
        grown = mine + weight
        grown[grown <= 1e-9] = 0.0
        added = salt[site, allele][:, None, :]
        mark = (marks[:, None] + (_marks(grown, added) - _marks(mine, added)).sum(axis=0, dtype=np.uint64)).ravel()
        path = (place[:, None] * ploidy + lows).ravel()
        chosen = np.flatnonzero(good)
        chosen = chosen[np.lexsort((path[chosen], total[chosen]))]
        before, reach, most = max(before, start), max(reach, int(site[-1]) + 1), width * (ploidy if k < 25 else 1)
        seen = mark[chosen[:most]]
        if len(set(seen.tolist())) == len(seen):
            chosen = chosen[:most]
        else:  # of states that differ in nothing that is still to come, the better one stays
            fresh: dict[int, list] = {}
            taken = []
            for one in chosen.tolist():
                alike = fresh.setdefault(int(mark[one]), [])
                s, c = divmod(one, ploidy)
                whole = piles[slot[s], before:reach].copy()
                whole[site - before, allele, c] = grown[:, s, c]
                if not any(np.array_equal(whole, other) for other in alike):
                    alike.append(whole)
                    taken.append(one)
                    if len(taken) == most:
                        break
            chosen = np.array(taken)
        parent, cluster = np.divmod(chosen, ploidy)
        # the first child of a state stays in its slot, the others and those of no state are copied and left
        came = slot[parent]
        used, copied, where = set(), [], came.tolist()
        for i, x in enumerate(where):
            if x in used:
                copied.append(i)
            used.add(x)
        if copied:
            free = [x for x in range(2 * len(where)) if x not in used][: len(copied)] if 2 * len(where) <= slots else [x for x in range(slots) if x not in used][: len(copied)]
            for i, x in zip(copied, free, strict=True):
                where[i] = x
            piles[free, before:reach] = piles[came[copied], before:reach]
        slot = np.array(where)
        flat[(slot * piles.shape[1] + site[:, None]) * g.n_alleles + allele[:, None], cluster] = grown[:, parent, cluster]
        score, marks = total[chosen], mark[chosen]
        last, ranks = last[parent], path[chosen].argsort()
        heavy = site[weight[:, 0, 0] > 1e-9]
        if len(heavy):
            ends = np.arange(len(chosen)), cluster
            last[ends] = np.maximum(last[ends], heavy[-1])
        place = np.empty(len(chosen), np.int64)
        place[ranks] = np.arange(len(chosen))
        steps.append(chosen)
    out, at = np.zeros(len(g), np.int64), 0
    for k in range(len(g) - 1, -1, -1):  # states are in the order of their scores and paths
        at, out[k] = divmod(int(steps[k][at]), ploidy)
    return out


def beam_search(reads: list[Read], ploidy: int, epsilon: float, width: int = 10) -> list[int]:
    """A cluster for each read (in fragment order): the best of `width` partial solutions at a time."""
    return _beam(grid(reads), ploidy, epsilon, width).tolist()


def _breaks(g: Grid, clusters: np.ndarray, ploidy: int, reach: int) -> list[int]:
    """search_breaks over a Grid: nothing is lost between reads that begin at the same site."""
    covered = np.zeros((ploidy, len(g.names)), bool)
    firsts = g.site[g.begins]
    runs = np.flatnonzero(np.r_[True, firsts[1:] != firsts[:-1]])
    cell, out = clusters[g.read], set()
    for a, b in zip(runs, np.r_[runs[1:], len(g)], strict=True):
        start = firsts[a]
        low = np.searchsorted(g.names, g.names[start] - reach, "right")
        high = np.searchsorted(g.names, g.names[start] + reach, "left")
        if (covered[:, low:start].any(axis=1) & ~covered[:, start:high].any(axis=1)).sum() > 1:
            out.add(int(g.names[start]))
        covered[:, :start] = False
        own = slice(g.begins[a], g.ends[b - 1])
        covered[cell[own], g.site[own]] = True
    return sorted(out)


def search_breaks(reads: list[Read], clusters: list[int], ploidy: int, reach: int = 50) -> list[int]:
    """Sites where a search loses two or more clusters at once, in ascending order.

    clusters are those of the search, reads are in fragment order. At the first site of a read, the search still knows what
    lies behind the first site of the read before it. A cluster is lost there if some of that lies less than `reach` sites
    before the site, and none at it or less than `reach` after it.
    """
    return _breaks(grid(reads), np.array(clusters, np.int64), ploidy, reach) if reads else []


def _piled(g: Grid, clusters: np.ndarray, ploidy: int, weight: np.ndarray) -> np.ndarray:
    """Weights by cluster, site and allele, summed up in the order of reads."""
    shape = (ploidy, len(g.names), g.n_alleles)
    cell = (clusters[g.read] * shape[1] + g.site) * shape[2] + g.allele
    out = np.bincount(cell, weight, minlength=math.prod(shape))
    out[out <= 1e-9] = 0.0
    return out.reshape(shape)


def _mistakes(g: Grid, clusters: np.ndarray, ploidy: int, weight: np.ndarray, piled: np.ndarray, epsilon: float) -> tuple[float, float]:
    """errors over a Grid: sites of a cluster, and alleles of a site, in the order in which reads come to them."""
    cell = (clusters[g.read] * piled.shape[1] + g.site) * piled.shape[2] + g.allele
    own = np.flatnonzero(weight > 1e-9)[::-1]
    first = np.full(piled.size, len(cell))
    first[cell[own]] = own  # the last one written stays, which is the first of the reads
    first = first.reshape(piled.shape)
    order = first.argsort(axis=2, kind="stable")
    values, begins = np.take_along_axis(piled, order, axis=2), first.min(axis=2)
    total, rest = values[..., 0].copy(), np.zeros(values.shape[:2])
    for k in range(1, values.shape[2]):  # as sum does it
        x = values[..., k]
        now = total + x
        rest += np.where(np.abs(total) >= np.abs(x), (total - now) + x, (x - now) + total)
        total = now
    top, total = values.max(axis=2), total + rest
    lost = total - top + np.where(top <= 1, epsilon, 0.0)
    bases = wrong = 0.0
    for c in range(len(piled)):
        there = np.flatnonzero(top[c] > 0)
        for x, y in zip(top[c, there[begins[c, there].argsort()]].tolist(), lost[c, there[begins[c, there].argsort()]].tolist(), strict=True):
            bases += x
            wrong += y
    return bases, wrong


def _refined(g: Grid, clusters: np.ndarray, ploidy: int, epsilon: float, rounds: int = 20) -> np.ndarray:
    """refine over a Grid."""
    if ploidy == 1:
        return clusters
    cell = g.site * g.n_alleles + g.allele
    piled = _piled(g, clusters, ploidy, g.weight)
    wrong = _mistakes(g, clusters, ploidy, g.weight, piled, epsilon)[1]
    for _ in range(rounds):
        sizes = np.bincount(clusters, minlength=ploidy).tolist()
        top = piled.max(axis=2, keepdims=True)
        bare = np.broadcast_to(top == 0, piled.shape).reshape(ploidy, -1)
        worse = (piled < top - 1e-9).reshape(ploidy, -1)
        # what an observation costs in a cluster: its weight, epsilon or nothing
        diff = np.stack([np.bincount(g.read, np.where(bare[c], epsilon, 0.0)[cell] + np.where(worse[c], 1.0, 0.0)[cell] * g.weight, minlength=len(g)) for c in range(ploidy)], axis=1)
        gain = diff - diff[np.arange(len(g)), clusters][:, None]
        good = (gain < 0) & (np.array(sizes)[clusters] > 1)[:, None]
        good[np.arange(len(g)), clusters] = False
        read, to = np.nonzero(good)
        order = np.lexsort((to, read, gain[read, to]))
        limit = len(order) // 10 or len(order) // 3 + 1
        new, done = clusters.copy(), set()
        for k, c in zip(read[order[: limit + 1]].tolist(), to[order[: limit + 1]].tolist(), strict=True):
            if k not in done and sizes[new[k]] > 1:
                sizes[new[k]] -= 1
                sizes[c] += 1
                new[k] = c
                done.add(k)
        if not done:
            return clusters
        after = _piled(g, new, ploidy, g.weight)
        now = _mistakes(g, new, ploidy, g.weight, after, epsilon)[1]
        if now >= wrong:
            return clusters
        clusters, piled, wrong = new, after, now
    return clusters


def refine(reads: list[Read], clusters: list[int], ploidy: int, epsilon: float, rounds: int = 20) -> list[int]:
    """Moves reads to clusters that fit better while the summed errors fall."""
    return _refined(grid(reads), np.array(clusters, np.int64), ploidy, epsilon, rounds).tolist() if reads else clusters


def stop_ratio(ploidy: int, epsilon: float, sensitivity: int) -> float:
    grow = {1: math.sqrt(ploidy) + 1, 2: ploidy + 1 / 3, 3: ploidy + 1}[sensitivity]
    return 1 / (1 - epsilon) / (1 + 1 / grow)


def phase_block(reads: list[Read] | Grid, epsilon: float, most: int = 5, width: int = 10, sensitivity: int = 2, heuristic: bool = True) -> tuple[list[int], list[int]]:
    """Clusters of a block's reads, with as many clusters as the errors call for, and the breaks of their search."""
    if not len(reads):
        return [], []
    g = reads if isinstance(reads, Grid) else grid(reads)
    ones = np.ones(len(g.weight))
    chosen, breaks, last = np.zeros(len(g), np.int64), [], None
    for k in range(1, most + 1):
        searched = _beam(g, k, epsilon, width)
        now = _refined(g, searched, k, epsilon)
        bases, wrong = _mistakes(g, now, k, ones, _piled(g, now, k, ones), epsilon)
        if last is not None and heuristic and wrong >= stop_ratio(k, epsilon, sensitivity) * last:
            break
        chosen, breaks, last = now, _breaks(g, searched, k, 50), wrong
        if wrong < epsilon * (bases + wrong):
            break
    return chosen.tolist(), breaks


Edge = tuple[int, int, int]  # column, row there, row in the next column


def balance(weights: dict[Edge, float]) -> dict[Edge, float]:
    """Flows nearest to the weights (sum of absolute changes) that keep in = out at inner nodes.

    A minimum-cost circulation: changes up (unbounded) and down (to 0) cost 1 a unit; nodes without edges on
    one side are one free node; imbalances travel by shortest augmenting paths.
    """
    scale = {e: round(w) for e, w in weights.items()}
    heads, tails = {(c + 1, b) for c, _, b in scale}, {(c, a) for c, a, _ in scale}
    inner = heads & tails
    name = lambda node: node if node in inner else "free"
    excess: dict = defaultdict(int)
    arcs: list[list] = []  # to, capacity, cost, edge, sign
    out: dict = defaultdict(list)

    def arc(a, b, capacity, edge, sign) -> None:
        out[a].append(len(arcs))
        arcs.append([b, capacity, 1, edge, sign])
        out[b].append(len(arcs))
        arcs.append([a, 0, -1, edge, -sign])

    for e in sorted(scale):
        a, b, w = name((e[0], e[1])), name((e[0] + 1, e[2])), scale[e]
        excess[a] -= w
        excess[b] += w
        if a != b:
            arc(a, b, 1 << 40, e, 1)
            arc(b, a, w, e, -1)
    flows = dict(scale)
    while True:
        sources = [n for n in excess if excess[n] > 0]
        if not sources:
            return {e: float(x) for e, x in flows.items()}
        dist, via = {n: 0 for n in sources}, {}
        queue = list(sources)
        while queue:  # Bellman-Ford with a queue: reverse arcs cost -1
            again = []
            for n in queue:
                for i in out[n]:
                    b, capacity, cost, *_ = arcs[i]
                    if capacity > 0 and dist[n] + cost < dist.get(b, 1 << 60):
                        dist[b], via[b] = dist[n] + cost, i
                        again.append(b)
            queue = again
        ends = [n for n in dist if excess[n] < 0]
        if not ends:
            return {e: float(x) for e, x in flows.items()}
        end = min(ends, key=lambda n: (dist[n], str(n)))
        path, n = [], end
        while n in via and not (excess[n] > 0 and dist[n] == 0):
            path.append(via[n])
            n = arcs[via[n] ^ 1][0]
        step = min([excess[n], -excess[end], *(arcs[i][1] for i in path)])
        for i in path:
            arcs[i][1] -= step
            arcs[i ^ 1][1] += step
            flows[arcs[i][3]] += arcs[i][4] * step
        excess[n] -= step
        excess[end] += step


#: Flows under this count for nothing.
LEAST_FLOW = 2.0


def peel_paths(nodes: list[tuple[int, int]], flows: dict[Edge, float], least: float = LEAST_FLOW, drop: float = 0.33) -> list[list[tuple[int, int]]]:
    """Disjoint paths, widest first; a path ends where the flow falls under `drop` of what came in.

    At such a fall the edge is cut for good if its start has one way in, and its end begins a path of its own if it has
    one way in.
    """
    left, edges = set(nodes), {e: f for e, f in flows.items() if f >= least}
    out = []
    while left:
        edges = {e: f for e, f in edges.items() if (e[0], e[1]) in left and (e[0] + 1, e[2]) in left}
        incoming, outgoing = defaultdict(int), defaultdict(list)
        for (c, a, b), f in sorted(edges.items()):
            incoming[c + 1, b] += 1
            outgoing[c, a].append(((c + 1, b), f))
        starts = {n for n in left if not incoming[n]}
        score = {n: (math.inf if n in starts else 0.0) for n in left}
        sinks = sorted(n for n in left if not outgoing[n])
        via: dict = {}
        cut: list[Edge] = []
        for n in sorted(left):
            for target, f in outgoing[n]:
                width = min(score[n], f)
                if width <= score[target]:
                    continue
                if n not in starts and f < drop * score[n]:
                    if incoming[n] == 1:
                        cut.append((n[0], n[1], target[1]))
                    if incoming[target] == 1:
                        score[target] = math.inf
                        starts.add(target)
                else:
                    score[target], via[target] = width, n
        for e in cut:
            del edges[e]
        path = [max(sinks, key=lambda n: (score[n], [-x for x in n]))]
        while path[-1] in via:
            path.append(via[path[-1]])
        out.append(path[::-1])
        left -= set(path)
    return out


def assign(reads: list[tuple[int, Read]], options: dict[int, list[int]], epsilon: float) -> dict[int, int]:
    """One part for each read: the best fit to what has been placed so far, in fragment order."""
    piles: dict[int, Piles] = defaultdict(dict)
    chosen = {}
    for name, read in reads:
        ranked = []
        for part in sorted(options[name]):
            same, diff = agreement(read, piles[part], epsilon)
            ranked.append((round(diff, 9) + 1, part, same))
        chosen[name] = min(ranked)[1]
        _add(piles[chosen[name]], read)
    return chosen


Bin = list[tuple[int, int, float, int]]  # left, right, coverage, part


def bin_distance(a: Bin, b: Bin, length: int) -> float:
    """How unlikely the mean coverages of two bins are under each other; infinite if parts of them overlap, or none come
    within two block lengths."""
    overlap = lambda x, y: x[0] < y[1] and y[0] < x[1] or x[0] >= y[0] and x[1] <= y[1] or y[0] >= x[0] and y[1] <= x[1]
    near = lambda x, y: abs(x[1] - y[0]) < 2 * length or abs(y[1] - x[0]) < 2 * length
    if any(overlap(x, y) for x in a for y in b) or not any(near(x, y) for x in a for y in b):
        return math.inf
    u, v = (sum(x[2] for x in z) / len(z) for z in (a, b))
    one = lambda k, rate: math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
    both = (one(math.floor(v), u) + one(math.floor(u), v)) / 2
    return -math.log(both) if both > 0 else math.inf


def bin_parts(parts: list[tuple[int, int, int, float | None]], length: int, cutoff: float = -math.log(0.01), reach: int = 100) -> dict[int, int]:
    """A bin for each part (id, left, right, coverage): parts with concordant coverage that follow one another.

    Bins are in the order of their first part; one may move only while exactly one other, among `reach` on either side,
    is nearer than the cutoff, and the nearest of such pairs is joined first. Parts without coverage stay alone.
    """
    bins: list[Bin] = [[(left, right, cov, p)] for p, left, right, cov in sorted(parts, key=lambda x: (x[1], x[0])) if cov is not None]
    while True:
        moves = []
        for i, own in enumerate(bins):
            options = [(d, i, j) for j in range(max(0, i - reach), min(len(bins), i + reach)) if j != i and (d := bin_distance(own, bins[j], length)) < cutoff]
            moves += options if len(options) == 1 else []
        if not moves:
            break
        _, i, j = min(moves, key=lambda m: (m[0], m[1], m[2]))
        bins[min(i, j)] += bins.pop(max(i, j))
    alone = sorted(p for p, _, _, cov in parts if cov is None)
    return {x[3]: k for k, own in enumerate(bins) for x in own} | {p: len(bins) + k for k, p in enumerate(alone)}


def realign_scores(reads: np.ndarray, targets: np.ndarray, match: int = 1, mismatch: int = -1, opening: int = -2, further: int = -1) -> np.ndarray:
    """Global alignment scores with affine gaps of each read (a row of characters) against the target in the same row."""
    rows, n, m = len(reads), reads.shape[1], targets.shape[1]
    low = -(1 << 20)
    best = np.zeros((rows, m + 1), np.int32)
    best[:, 1:] = opening + further * np.arange(m)
    down = np.full((rows, m + 1), low, np.int32)  # gaps in the target
    for i in range(n):
        last = best.copy()
        down = np.maximum(last + opening, down + further)
        best[:, 0] = opening + further * i
        across = np.full(rows, low, np.int32)
        same = np.where(targets == reads[:, i : i + 1], match, mismatch)
        for j in range(1, m + 1):
            across = np.maximum(best[:, j - 1] + opening, across + further)
            best[:, j] = np.maximum(np.maximum(last[:, j - 1] + same[:, j - 1], down[:, j]), across)
    return best[:, m]
