"""The search of deep blocks: the states of a plain search, at a cost in proportion to the reads."""

import math
import random
import time

from phaseframe.plans import kernels as K


def plain_search(reads, ploidy, epsilon, width):
    """beam_search over piles as dictionaries, with whole paths."""
    states = [(0.0, (), [{} for _ in range(ploidy)])]
    for k, read in enumerate(reads):
        children = {}
        for score, path, piles in states:
            found = [K.agreement(read, p, epsilon) for p in piles]
            chances = [K.log_p(math.floor(s + d), math.floor(d), epsilon) for s, d in found]
            total = max(chances) + math.log(sum(math.exp(c - max(chances)) for c in chances))
            bare = [c for c in range(ploidy) if not piles[c]]
            for c in range(ploidy):
                if c not in bare[1:] and chances[c] - total > math.log(0.01):
                    children[(*path, c)] = (score + found[c][1], piles, c)
        states = []
        for path, (score, piles, c) in sorted(children.items(), key=lambda x: (x[1][0], x[0])):
            own = [{s: dict(at) for s, at in p.items() if s >= read[0][0]} for p in piles]
            K._add(own[c], read)
            if not any(own == same for _, _, same in states):
                states.append((score, path, own))
                if len(states) == width * (ploidy if k < 25 else 1):
                    break
    return list(min(states, key=lambda x: (x[0], x[1]))[1])


def some_reads(rng, n, reach, alleles=2):
    out = []
    for k in range(n):
        start = rng.randrange(1, reach)
        sites = sorted(rng.sample(range(start, start + 30), 12))
        out.append([(3 * s, rng.randrange(alleles) if rng.random() < 0.2 else (s * 7 + k % 2) % alleles, 1 - 10 ** (-rng.choice([0, 3, 20, 40]) / 10)) for s in sites])
    return sorted(out, key=lambda r: (r[0][0], -r[-1][0]))


def test_states_are_those_of_a_plain_search():
    rng = random.Random(21)
    for alleles in (2, 2, 3):
        for ploidy in (2, 3):
            reads = some_reads(rng, 60, 40, alleles)
            assert K.beam_search(reads, ploidy, 0.04) == plain_search(reads, ploidy, 0.04, 10)


def test_a_deep_block_takes_time_in_proportion_to_its_reads():
    reads = some_reads(random.Random(22), 4000, 60)
    begun = time.process_time()
    clusters, _ = K.phase_block(reads, 0.04, heuristic=False)
    assert len(clusters) == 4000 and time.process_time() - begun < 18
