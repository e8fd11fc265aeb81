"""Optimal string alignment, for which Spark has no function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = 1024


def codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, a row for each text, 0 behind its end."""
    whole = "".join(text.ljust(width, "\0") for text in texts)
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), width)


def osa_batch(a: list[str], b: list[str]) -> np.ndarray:
    """Insertions, deletions, replacements and swaps of neighbours, no part edited twice, of all pairs at once.

    One row of the table of distances is made at a time for all pairs. Insertions run along a row; they are the least, up to
    each place, of what the row has without them less its place, so that no place waits for the one before it.
    """
    lengths_a, lengths_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x, y = codes(a, int(lengths_a.max(initial=0))), codes(b, int(lengths_b.max(initial=0)))
    n, width = len(a), y.shape[1]
    places = np.arange(width + 1, dtype=np.int32)
    last = np.broadcast_to(places, (n, width + 1)).copy()
    before, out = last, np.where(lengths_a == 0, lengths_b, 0).astype(np.int32)
    for i in range(1, x.shape[1] + 1):
        now = np.empty_like(last)
        now[:, 0] = i
        np.minimum(last[:, 1:] + 1, last[:, :-1] + (y != x[:, i - 1 : i]), out=now[:, 1:])
        if i > 1 and width > 1:
            swapped = (y[:, :-1] == x[:, i - 1 : i]) & (y[:, 1:] == x[:, i - 2 : i - 1])
            now[:, 2:] = np.where(swapped, np.minimum(now[:, 2:], before[:, :-2] + 1), now[:, 2:])
        now = np.minimum.accumulate(now - places, axis=1) + places
        ends = np.flatnonzero(lengths_a == i)
        out[ends] = now[ends, lengths_b[ends]]
        before, last = last, now
    return out


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    left, right = a.to_numpy(object)[there], b.to_numpy(object)[there]
    out = pd.Series([None] * len(a), dtype="Int32")
    # pairs of about one length together, so that little is filled up
    order = np.lexsort(([len(x) for x in right], [len(x) for x in left])) if len(there) else there
    for start in range(0, len(order), PAIRS):
        own = order[start : start + PAIRS]
        out.iloc[there[own]] = osa_batch(left[own].tolist(), right[own].tolist())
    return out


def similarity(a: Column, b: Column) -> Column:
    """One less the distance over the longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - osa_distance(a, b) / longest)


def osa_column(a: Column, b: Column) -> Column:
    """The same distance as a Column expression: two rows of the table folded over the characters. For few pairs, without Python."""
    row = "array<int>"
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    least = lambda *c: F.least(*c)

    def over(pair: Column) -> Column:
        xs, ys, m = pair["xs"], pair["ys"], F.size(pair["ys"])
        first = F.sequence(F.lit(0), m)
        start = F.struct(F.array().cast(row).alias("before"), first.alias("last"), F.lit(0).alias("i"))

        def line(state: Column, x: Column) -> Column:
            i = state["i"] + 1
            previous = F.get(xs, i - 2)

            def cell(now: Column, y: Column) -> Column:
                j = F.size(now)
                plain = least(F.get(state["last"], j) + 1, F.element_at(now, -1) + 1, F.get(state["last"], j - 1) + (x != y).cast("int"))
                swap = (i > 1) & (j > 1) & (x == F.get(ys, j - 2)) & (previous == y)
                return F.concat(now, F.array(F.when(swap, least(plain, F.get(state["before"], j - 2) + 1)).otherwise(plain)))

            now = F.aggregate(ys, F.array(i), cell)
            return F.struct(state["last"].alias("before"), now.alias("last"), i.alias("i"))

        return F.element_at(F.aggregate(xs, start, line)["last"], -1)

    return F.transform(F.array(F.struct(chars(a).alias("xs"), chars(b).alias("ys"))), over)[0]
