"""A pileup that follows a stream of observations (an extension: sums of weights and counts are associative).

State is one row for each (contig, part, site, allele) that has been seen; with event times, windows older than the
watermark are finished and leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_pileup(obs: DataFrame, *keys: str) -> DataFrame:
    """Summed weight and count of each allele at each site so far; for output modes update and complete."""
    return obs.groupBy(*keys, "site", "allele").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def windowed_pileup(obs: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """The same for windows of event time; with append, a window comes out once, after the watermark has passed it."""
    own = obs.withWatermark(time, delay).groupBy(F.window(time, width).alias("window"), *keys, "site", "allele")
    return own.agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).select("window.start", "window.end", *keys, "site", "allele", "weight", "n")


def changing_pileup(changes: DataFrame, *keys: str) -> DataFrame:
    """A pileup under additions and removals: keys, site, allele, weight, n of each allele that a batch changes; for output
    mode update. An allele that has fallen to nothing comes out once with 0 and leaves the state, and so does a site
    without alleles.

    changes: keys, site, allele, weight, and added (false: the observation goes again). A removal that nothing was added
    for is left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    columns = [*keys, "site"]
    named = ", ".join(f"{c} {kinds[c]}" for c in columns)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {a: [w, n] for a, w, n in zip(*state.get, strict=True)} if state.exists else {}
        touched: set[int] = set()
        moves = pd.concat(list(batches))
        # additions first: what comes and goes in one batch leaves nothing behind
        for added in (True, False):
            sums = moves[moves["added"] == added].groupby("allele")["weight"].agg(["sum", "count"])
            for allele, weight, n in sums.itertuples(name=None):
                own = held.get(allele, [0.0, 0])
                if added or own[1]:
                    held[allele] = [own[0] + weight, own[1] + n] if added else [own[0] - weight, own[1] - n]
                    touched.add(allele)
        rows = []
        for allele in sorted(touched):
            weight, n = held[allele]
            if weight <= 1e-9 or n <= 0:
                weight, n = 0.0, 0
                del held[allele]
            rows.append((*key, allele, weight, n))
        if held:
            order = sorted(held)
            state.update((order, [held[a][0] for a in order], [held[a][1] for a in order]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=[*columns, "allele", "weight", "n"])

    grouped = changes.select(*columns, "allele", "weight", "added").groupBy(*columns)
    return grouped.applyInPandasWithState(step, f"{named}, allele int, weight double, n long", "alleles array<int>, weights array<double>, counts array<long>", "update", GroupStateTimeout.NoTimeout)
