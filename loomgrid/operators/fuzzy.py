"""Similarity of texts, and merging of similar values.

Merging is greedy in the order in which values first occur, so it is sequential by its definition. It runs on the
distinct values of a column only. Up to a stated number of values a column is one task. Beyond it, blocks of values, the
first of that number and each longer than the last, open groups one after another, and the values behind each block are compared
with its groups all over the cluster. An index, or bags of characters, spare most of these comparisons.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.scalars import blank, jtrim

#: Distinct values of a column that one task merges, and the size that blocks grow to, by this factor.
MOST_VALUES, GROWTH = 20_000, 4
#: Bytes of a block that has grown, where texts are long.
MOST_BYTES = 64_000_000
#: Texts left by deletions that a form may have to be indexed by them.
MOST_LEFT = 200
#: A block ends at this many such texts of its seeds, or seeds that have to be scanned: one process finds them.
MOST_INDEXED, MOST_SCANNED = 300_000, 4_000
#: Counts of a bag of characters or trigrams, and bags that are looked at together.
BINS, CHUNK = 64, 512
SALTS = 32


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def _trigrams(c: Column) -> Column:
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3)))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Set cosine of character trigrams; a text shorter than three is its own gram."""
    return F.when(a == b, 1.0).otherwise(F.size(F.array_intersect(_trigrams(a), _trigrams(b))) / (F.sqrt(F.size(_trigrams(a))) * F.sqrt(F.size(_trigrams(b)))))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus of 0.1 for each of the first four characters that agree, from 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    others = [ch for ch, u in zip(b, used) if u]
    m, swapped = len(hits), sum(x != y for x, y in zip(hits, others)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro if jaro < 0.7 else jaro + 0.1 * prefix * (1 - jaro)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def _edit_distance(a: str, b: str, most: int) -> int:
    """The number of edits, or any number above ``most``; cells outside the band of ``most`` edits aren't computed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, ch in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        if low == 1:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ch != b[j - 1]))
        if min(new[max(0, low - 1) : high + 1]) > most:
            return most + 1
        row = new
    return row[-1]


def similarity(a: str, b: str, algorithm: str, threshold: float) -> float:
    """The similarity of two texts; below ``threshold`` it may be any value below it."""
    if a == b:
        return 1.0
    if algorithm == "jaro_winkler":
        return jaro_winkler(a, b)
    if algorithm == "cosine":
        x, y = ({s} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
        return len(x & y) / (math.sqrt(len(x)) * math.sqrt(len(y)))
    size = max(len(a), len(b))
    return 1 - _edit_distance(a, b, _most_edits(size, threshold)) / size


def _most_edits(size: int, threshold: float) -> int:
    return int(math.floor((1 - threshold) * size + 1e-9))


class _Scanned:
    """Seeds in their order. Bags of characters, or of trigrams for the cosine, rule out those that can't be similar."""

    def __init__(self, algorithm: str, threshold: float) -> None:
        self.algorithm, self.threshold = algorithm, threshold
        self.seeds: list[tuple[int, str]] = []
        self.bags, self.sizes = np.zeros((CHUNK, BINS), "int32"), np.zeros(CHUNK, "int32")

    def _bag(self, form: str) -> np.ndarray:
        if self.algorithm == "cosine":
            held = [hash(g) for g in ({form} if len(form) < 3 else {form[i : i + 3] for i in range(len(form) - 2)})]
        else:
            held = [ord(ch) for ch in form]
        return np.bincount(np.array(held, "int64") % BINS, minlength=BINS)

    def add(self, place: int, form: str) -> None:
        k = len(self.seeds)
        if k == len(self.sizes):
            self.bags, self.sizes = np.concatenate([self.bags, np.zeros_like(self.bags)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.bags[k] = self._bag(form)
        self.sizes[k] = self.bags[k].sum()
        self.seeds.append((place, form))

    def first(self, form: str) -> int | None:
        if not self.seeds:
            return None
        bag = self._bag(form)
        size = bag.sum()
        for low in range(0, len(self.seeds), CHUNK):
            sizes = self.sizes[low : min(low + CHUNK, len(self.seeds))]
            common = np.minimum(self.bags[low : low + len(sizes)], bag).sum(axis=1)  # at least what the texts have in common
            if self.algorithm == "cosine":
                best = common / np.sqrt(sizes * float(size))
            elif self.algorithm == "jaro_winkler":
                best = 0.4 + 0.6 * (common / sizes + common / size + 1) / 3
            else:
                best = common / np.maximum(sizes, size)
            for k in np.flatnonzero(best >= self.threshold - 1e-9):
                place, seed = self.seeds[low + k]
                if similarity(seed, form, self.algorithm, self.threshold) >= self.threshold:
                    return place
        return None


class _Seeds:
    """Seeds in their order, to find the first one that is similar to a form.

    Texts within some edits leave a text in common when each loses as many characters as its own length allows edits, or
    fewer: an edit costs a text one character at most, and a longer text allows no more edits beyond its greater length.
    Forms that leave few texts are indexed by them, the others are scanned.
    """

    def __init__(self, algorithm: str, threshold: float) -> None:
        self.algorithm, self.threshold = algorithm, threshold
        self.by_left: dict[int, list[tuple[int, str]]] = {}
        self.indexed, self.others = _Scanned(algorithm, threshold), _Scanned(algorithm, threshold)

    def _left(self, form: str) -> set[int] | None:
        """Hashes of the texts that deletions leave of a form; none if there are many."""
        if self.algorithm in ("jaro_winkler", "cosine"):
            return None
        most, n = _most_edits(len(form), self.threshold), 0
        for d in range(most + 1):
            n += math.comb(len(form), d)
            if n > MOST_LEFT:
                return None
        return {hash("".join(kept)) for d in range(most + 1) for kept in itertools.combinations(form, len(form) - d)}

    @property
    def full(self) -> bool:
        return len(self.by_left) >= MOST_INDEXED or len(self.others.seeds) >= MOST_SCANNED

    def add(self, place: int, form: str) -> None:
        left = self._left(form)
        (self.others if left is None else self.indexed).add(place, form)
        for text in left or ():
            self.by_left.setdefault(text, []).append((place, form))

    def first(self, form: str) -> int | None:
        left = self._left(form)
        if left is None:
            found = self.indexed.first(form)
        else:
            near = sorted({seed for text in left for seed in self.by_left.get(text, ())})
            found = next((p for p, f in near if similarity(f, form, self.algorithm, self.threshold) >= self.threshold), None)
        other = self.others.first(form)
        return found if other is None else other if found is None else min(found, other)


def seeded(block: list[tuple[int, str]], algorithm: str, threshold: float) -> tuple[dict[int, int], list[tuple[int, str]]]:
    """The place of the seed that each (place, form) falls to, the first earlier seed that is similar to it, else itself; and the seeds.

    The block ends early where its seeds are full.
    """
    known, seeds = _Seeds(algorithm, threshold), []
    own: dict[int, int] = {}
    for place, form in block:
        if known.full:
            break
        found = known.first(form)
        if found is None:
            known.add(place, form)
            seeds.append((place, form))
        own[place] = place if found is None else found
    return own, seeds


def _seeds_in_blocks(values: DataFrame, algorithm: str, threshold: float, most: int) -> DataFrame:
    """(value, form, at, n, place, seed) for any number of values: the order number of the seed that each falls to.

    A round takes the first values that have no seed, finds the seeds among them, and gives the rest of the cluster's values
    the first of these seeds that is similar. No pair of a value and a seed is compared twice. The first block holds ``most``
    values, each later one up to GROWTH times as many as the last, since a round costs its jobs whatever it holds.
    """
    from loomgrid.operators.ranks import numbered, scratch

    rest = scratch(numbered(values, ["at", "value"], "place"))
    longest = rest.agg(F.max(F.octet_length("form"))).first()[0] or 1
    size, tasks = max(1, most), values.sparkSession.sparkContext.defaultParallelism
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields) + ", seed bigint"
    out = None
    while True:
        block = [(r.place, r.form) for r in rest.select("place", "form").orderBy("place").limit(size).collect()]  # of bounded size
        if not block:
            break
        own, seeds = seeded(block, algorithm, threshold)

        def find(frames, own=own, seeds=seeds):  # noqa: ANN001, ANN202
            known = _Seeds(algorithm, threshold)
            for place, form in seeds:
                known.add(place, form)
            for frame in frames:
                found = [own[p] if p in own else known.first(f) for p, f in zip(frame["place"], frame["form"])]
                yield frame.assign(seed=pd.array(found, dtype="Int64"))

        # a number of tasks, since adaptive execution would put so few bytes into one task
        met = scratch(rest.repartition(tasks, "place").mapInPandas(find, schema))
        done = met.where("seed is not null")
        out = done if out is None else out.unionByName(done)
        rest = met.where("seed is null").drop("seed")
        size = max(1, most, min(GROWTH * size, MOST_VALUES, MOST_BYTES // longest))
    return out if out is not None else rest.withColumn("seed", F.col("place"))


def _canonical_of_groups(members: DataFrame, prefer: str) -> DataFrame:
    """(value, canonical) from (value, at, n, seed): one member of each group of several stands for all; ties go to the first."""
    first = [F.col("at"), F.col("value")]
    order = {"most_frequent": [-F.col("n"), *first], "shortest": [F.length("value"), *first], "longest": [-F.length("value"), *first], "alphabetical": [F.col("value")]}.get(prefer, first)
    best = members.groupBy("seed").agg(F.min_by("value", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])).alias("canonical"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return members.join(best, "seed").select("value", "canonical")


def merged_values(values: list[tuple[str, str, int]], algorithm: str, threshold: float, prefer: str) -> dict[str, str]:
    """What each value becomes: (value, normal form, count of the form) in the order of first occurrence.

    An unassigned value takes in all later unassigned ones that are similar to it; one of the group stands for all.
    """
    out: dict[str, str] = {}
    done = [False] * len(values)
    for i, (seed, form, _) in enumerate(values):
        if done[i]:
            continue
        group = [i] + [j for j in range(i + 1, len(values)) if not done[j] and similarity(form, values[j][1], algorithm, threshold) >= threshold]
        for j in group:
            done[j] = True
        if len(group) > 1:
            members = [values[j] for j in group]
            if prefer == "most_frequent":
                best = max(members, key=lambda v: v[2])  # the first of equals
            elif prefer == "shortest":
                best = min(members, key=lambda v: len(v[0]))
            elif prefer == "longest":
                best = max(members, key=lambda v: len(v[0]))
            elif prefer == "alphabetical":
                best = min(members, key=lambda v: v[0])
            else:
                best = members[0]
            out.update({v[0]: best[0] for v in members})
    return out


def merge_similar_values(df: DataFrame, columns: list[str], order: str, algorithm: str = "levenshtein", threshold: float = 0.85, case_insensitive: bool = False, trim: bool = False, prefer: str = "most_frequent", most: int = MOST_VALUES) -> DataFrame:
    """Similar values of each column replaced by one of them; blank cells stay.

    ``order`` tells which value occurs first. A threshold of 0 or less means 0.85.
    """
    threshold = 0.85 if threshold <= 0 else threshold
    algorithm, prefer = (algorithm or "levenshtein").lower(), (prefer or "most_frequent").lower()
    out = df
    for k, column in enumerate(c for c in columns if c in df.columns):
        cell = F.col(f"`{column}`").cast("string")
        form = jtrim(cell) if trim else cell
        form = F.lower(form) if case_insensitive else form
        # blank cells are one group that the count of values leaves out: a filter would drag the whole plan of the cells below the aggregation
        known = df.select(F.when(~blank(cell), cell).alias("value"), F.when(~blank(cell), form).alias("form"), F.col(f"`{order}`").alias("at"))
        counts = known.groupBy("value", "form").agg(F.min("at").alias("at"), F.count("value").alias("n")).where("n > 0")
        values = counts.withColumn("n", F.sum("n").over(Window.partitionBy("form"))).withColumn("column", F.lit(column))

        def group(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["at", "value"])
            found = merged_values(list(zip(frame["value"], frame["form"], frame["n"])), algorithm, threshold, prefer)
            return pd.DataFrame({"value": list(found), "canonical": list(found.values())}, dtype=object)

        from loomgrid.operators.ranks import scratch

        values = scratch(values)
        values_fit = values.count() <= most
        if values_fit:
            table = values.groupBy("column").applyInPandas(group, "value string, canonical string")
        else:
            table = _canonical_of_groups(_seeds_in_blocks(values.drop("column"), algorithm, threshold, most), prefer)
        # a value may fill a third of the rows: beyond a broadcast its rows go to several tasks
        salts = 1 if values_fit else SALTS
        own = table.select(F.col("value").alias(f"__value{k}"), F.col("canonical").alias(f"__canonical{k}"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(f"__salt{k}"))
        own = F.broadcast(own) if values_fit else own  # at most `most` rows
        joined = out.join(own, (F.col(f"`{column}`").cast("string") == F.col(f"__value{k}")) & (F.pmod(F.xxhash64(F.col(f"`{order}`")), F.lit(salts)) == F.col(f"__salt{k}")), "left")
        out = joined.select(*[F.coalesce(F.col(f"__canonical{k}"), F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
    return out
