"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source whose target is T words and that holds Z takes all
its documents floor(T / Z) times; of the remaining budget each length takes its proportional share of its documents, and a
bounded knapsack over the remaining length counts closes the rest. Many lengths close it to the word; where they
don't, half of the proportional share and then all of it is given back to the program, so that for a budget of up to ``CELLS`` common
steps of the lengths no choice of documents comes nearer from below. Larger budgets are closed in passes, each in steps as fine as ``CELLS`` sums allow, and a last
pass over the residues of one length closes what they leave. Which documents of a
length are taken is drawn by a seeded hash: a (source, length) group is dealt into ``DEALT`` cells, whole cells
are taken in turn, and only the one cell at the edge is sorted.

Defined results: a null text or one without words has size 0 and is never taken; the null source comes last
in the order of sources; rows that repeat are documents of their own, those that share an id, a length and a
source are interchangeable; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.lineage import Tables

WORDS = r"[^\x20\x09-\x0D]+"
#: Sums that one pass of the dynamic program tells apart: the bound of its memory (5 bytes each).
CELLS = 1 << 22
#: Parts that the last pass, over residues, adds at most.
ITEMS = 4096
#: Words that single documents, from the longest down, leave to the first try of the program.
RESERVE = 1 << 16
#: Cells that the documents of a length are dealt into.
DEALT = 256
#: Sources up to which their plan is broadcast; a longer one is joined by source.
PLAN = 100_000
#: No source is taken more often than this.
MOST = 2


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float) -> dict[str | None, float]:
    """Target of each source: its weight's part of share * all sizes, at most MOST times its own; the excess is reshared by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    most = {name: float(MOST * size) for name, size in order}
    left, free, target = share * sum(size for _, size in order), [name for name, _ in order], {}
    while free:
        total = sum(weight[x] for x in free)
        over = [x for x in free if left * weight[x] / total > most[x]]
        if not over:
            target |= {x: left * weight[x] / total for x in free}
            break
        target |= {x: most[x] for x in over}
        left -= sum(most[x] for x in over)
        free = [x for x in free if x not in target]
    return target


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> tuple[list[int], bool]:
    """How many of each length to take so that their sum is near below ``budget``, and whether none is nearer.

    Sums are counted in the lengths' common step. If that makes more than CELLS, a coarser step is taken and lengths are rounded up.
    """
    taken = [0] * len(lengths)
    fits = [i for i, n in enumerate(lengths) if n <= budget and counts[i] > 0]
    if not fits:
        return taken, True
    common = math.gcd(*(lengths[i] for i in fits))
    step = max(common, -(-budget // CELLS))
    room = budget // step
    items: list[tuple[int, int, int]] = []
    for i in fits:
        count, part = min(counts[i], budget // lengths[i]), 1
        while count > 0:
            part = min(part, count)
            items.append((-(-part * lengths[i] // step), i, part))
            count -= part
            part *= 2
    items.sort(reverse=True)
    # Which item made a sum reachable; the sum without it was reachable by earlier items.
    by, reach, top = np.zeros(room + 1, np.int32), np.zeros(room + 1, bool), 0
    reach[0] = True
    for k, (size, _, _) in enumerate(items):
        if size > room:
            continue
        top = min(room, top + size)
        new = np.flatnonzero(reach[: top + 1 - size] & ~reach[size : top + 1]) + size
        reach[new], by[new] = True, k
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        size, i, part = items[by[at]]
        taken[i] += part
        at -= size
    return taken, step == common


def choose_exactly(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int] | None:
    """The choice whose sum is nearest below a budget, by its different sums; None if there may be more than CELLS of them."""
    most = [min(c, budget // n) for n, c in zip(lengths, counts, strict=True)]
    if math.prod(m + 1 for m in most) > CELLS:
        return None
    sums, by, before = np.zeros(1, np.int64), [], []
    for n, m in zip(lengths, most, strict=True):
        before.append(sums)
        found, first = np.unique((sums[None, :] + n * np.arange(m + 1)[:, None]).ravel(), return_index=True)
        by.append(first // len(sums))
        fits = found <= budget
        sums, by[-1] = found[fits], by[-1][fits]
    taken, total = [0] * len(lengths), int(sums[-1])
    for i in range(len(lengths) - 1, -1, -1):
        known = before[i + 1] if i + 1 < len(lengths) else sums
        taken[i] = int(by[i][np.searchsorted(known, total)])
        total -= taken[i] * lengths[i]
    return taken


def close_residue(lengths: Sequence[int], counts: Sequence[int], taken: Sequence[int], left: int) -> list[int]:
    """A choice that leaves less of a budget of which ``taken`` leaves ``left``, however large the budget is.

    Documents of one length, that of which most words are taken, are given back for others: what those others sum to matters only up to multiples of
    that length, so that the program has as many states as it has steps. Others are added in doubling parts, as far as what is taken of the one can pay for them.
    """
    step = math.gcd(*lengths)
    bases = [i for i, n in enumerate(lengths) if taken[i] and n // step <= CELLS]
    if not bases:
        return list(taken)
    base = max(bases, key=lambda i: taken[i] * lengths[i])
    states, room = lengths[base] // step, taken[base] * lengths[base] + left
    items: list[tuple[int, int]] = []
    part = 1
    while len(items) < ITEMS:
        some = [(i, min(part, counts[i] - taken[i] - part + 1)) for i in range(len(lengths)) if i != base and counts[i] - taken[i] >= part]
        if not some:
            break
        for i, more in some:
            if more * lengths[i] <= room:
                room -= more * lengths[i]
                items.append((i, more))
        part *= 2
    # Which item made a residue reachable; the residue without it was reachable by earlier items.
    by, reach = np.full(states, -1, np.int32), np.zeros(states, bool)
    reach[0] = True
    for k, (i, more) in enumerate(items):
        shift = more * lengths[i] // step % states
        new = np.flatnonzero(np.roll(reach, shift) & ~reach)
        reach[new], by[new] = True, k
        if reach.all():
            break
    # The residue wanted, or else the nearest below.
    wanted = left // step % states
    below = (wanted - np.flatnonzero(reach)) % states
    at = (wanted - int(below.min())) % states
    out, added = list(taken), 0
    while by[at] >= 0:
        i, more = items[by[at]]
        out[i] += more
        added += more * lengths[i]
        at = (at - more * lengths[i] // step) % states
    out[base] -= -(-(added - left) // lengths[base])
    return out if 0 <= out[base] <= counts[base] else list(taken)


def fit_lengths(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """Documents to take of each length (longest first) for a budget of words."""
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    exact = choose_exactly(lengths, counts, budget)
    if exact is not None:
        return exact
    least = budget % math.gcd(*lengths)  # no choice leaves less
    best, open_ = [0] * len(lengths), budget
    for kept in (2, 1, 0):
        taken = [kept * budget * count // (2 * total) for count in counts]
        left = budget - sum(a * b for a, b in zip(lengths, taken, strict=True))
        for i, length in enumerate(lengths) if kept == 2 else ():
            if left <= RESERVE:
                break
            more = min(counts[i] - taken[i], (left - RESERVE) // length)
            taken[i] += more
            left -= more * length
        done = False
        while not done and left > least:
            more, done = knapsack(lengths, [a - b for a, b in zip(counts, taken, strict=True)], left)
            if not done and not any(more):  # all that is left is nearly as long as the budget
                rest = left
                for i, length in enumerate(lengths):
                    more[i] = min(counts[i] - taken[i], rest // length)
                    rest -= more[i] * length
                done = True
            taken = [a + b for a, b in zip(taken, more, strict=True)]
            left -= sum(a * b for a, b in zip(lengths, more, strict=True))
        if left < open_:
            best, open_ = taken, left
        if open_ <= least:
            break
    if open_ > least:
        other = close_residue(lengths, counts, best, open_)
        left = budget - sum(a * b for a, b in zip(lengths, other, strict=True))
        best = other if 0 <= left < open_ else best
    return best


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, times): how often the mix takes each document (0, 1 or 2)."""
    rows = Tables(docs.sparkSession).cut(
        docs.select(F.col(id_col).alias("doc_id"), n_words(text_col).alias("size"), F.col(source_col).alias("source")).withColumn(
            "cell", F.pmod(F.xxhash64("doc_id", "size", "source", F.lit(seed)), F.lit(DEALT)).cast("int")
        )
    )
    cells = rows.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("docs"))
    lengths = cells.groupBy("source", "size").agg(F.sum("docs").alias("docs"))
    # The sources are dimensions of the mix: one row each comes to the driver, for a target each.
    sizes = [(r[0], int(r[1])) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    targets = source_targets(sizes, weights, share)
    plan_rows = [(s, z, float(targets[s]), min(MOST, int(targets[s] // z)) if z else 0) for s, z in sizes]
    plan = docs.sparkSession.createDataFrame(plan_rows, "plan_source string, source_size long, target double, whole long")
    plan = F.broadcast(plan) if len(plan_rows) <= PLAN else plan

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["size"] > 0].sort_values("size", ascending=False)
        if not len(pdf):
            return pd.DataFrame({"fit_source": [], "fit_size": [], "take": []})
        whole = int(pdf["whole"].iloc[0])
        budget = round(pdf["target"].iloc[0] - whole * pdf["source_size"].iloc[0])
        taken = fit_lengths(pdf["size"].tolist(), pdf["docs"].tolist(), budget) if budget > 0 and whole < MOST else [0] * len(pdf)
        return pd.DataFrame({"fit_source": pdf["source"], "fit_size": pdf["size"], "take": taken})

    # One row per distinct length of a source comes here, never one per document.
    planned = lengths.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select("source", "size", "docs", "source_size", "target", "whole")
    take = planned.groupBy("source").applyInPandas(fit, "fit_source string, fit_size long, take long").filter("take > 0")
    group = Window.partitionBy("source", "size").orderBy("cell")
    edges = (
        cells.join(take, F.col("source").eqNullSafe(F.col("fit_source")) & (F.col("size") == F.col("fit_size")))
        .select("source", "size", "cell", "docs", F.least("docs", F.greatest(F.lit(0), F.col("take") - F.sum("docs").over(group) + F.col("docs"))).alias("want"))
        .filter("want > 0")
        .select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("cell").alias("e_cell"), "want", "docs")
    )
    same = F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")) & (F.col("cell") == F.col("e_cell"))
    marked = rows.join(edges, same, "left").select("doc_id", "size", "source", "cell", F.coalesce("want", F.lit(0)).alias("want"), F.coalesce("docs", F.lit(0)).alias("docs"))
    # Only the cell at the edge of its group needs an order.
    edge = (F.col("want") > 0) & (F.col("want") < F.col("docs"))
    order = Window.partitionBy("source", "size", "cell").orderBy("draw", "doc_id")
    drawn = marked.filter(edge).withColumn("draw", F.xxhash64("doc_id", F.lit(seed + 1))).withColumn("extra", (F.row_number().over(order) <= F.col("want")).cast("int"))
    sure = marked.filter(~edge).withColumn("extra", (F.col("want") > 0).cast("int"))
    both = sure.select("doc_id", "size", "source", "extra").unionByName(drawn.select("doc_id", "size", "source", "extra"))
    return both.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(
        "doc_id", "size", "source", "source_size", "target", F.when(F.col("size") > 0, F.least(F.lit(MOST), F.col("whole") + F.col("extra"))).otherwise(0).cast("int").alias("times")
    )
