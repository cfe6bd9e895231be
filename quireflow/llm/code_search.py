"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.store import written

SEGMENTS, WIDTH = 4, 16
#: Codes and queries that one task handles at once. They bound its memory, not the search.
ROWS, QUERIES = 200_000, 20_000


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, c): bit i of c is 1 where element i is above 0; a null vector has a null code.

    A null or missing element counts as 0. A code has 64 bits: a longer vector is an error
    when its code is read, since leaving it out would lose neighbours.
    """
    bits = [F.when(F.get(F.col(vector_col), F.lit(i)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return vectors.select(F.col(id_col).alias("id"), F.when(F.size(vector_col) > 64, F.raise_error(F.lit("sign_codes: a vector of over 64 elements")).cast("long")).when(F.size(vector_col) >= 0, code).alias("c"))


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in s) for s in combinations(range(WIDTH), radius)], np.int64)


class Index:
    """Codes by the value of each of their four 16-bit segments."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.codes, self.weights = codes, weights
        self.order, self.start = [], []
        for s in range(SEGMENTS):
            value = (codes >> np.uint64(WIDTH * s) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.start.append(np.searchsorted(value[order], np.arange((1 << WIDTH) + 1)))
        self.masks: dict[int, np.ndarray] = {}
        self.seen, self.asked = np.zeros(len(codes), np.int32), 0  # by the number of the last query that saw a row

    def nearest(self, query: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) that hold the k nearest items, with all ties of the kth; a row counts as often as its weight.

        Radii grow one segment at a time. With radius r in segments 0 to s and r - 1 in the
        rest, every code within ``4 r + s`` differing bits has been seen: were it missed, it
        would differ in more bits than that. The search ends when the kth verified
        distance is within that bound, or every segment value was tried.
        """
        self.asked += 1
        rows, distances = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(WIDTH + 1):
            if r not in self.masks:
                self.masks[r] = _masks(r)
            for s in range(SEGMENTS):
                values = (query >> (WIDTH * s) & 0xFFFF) ^ self.masks[r]
                first, n = self.start[s][values], self.start[s][values + 1] - self.start[s][values]
                ends = np.cumsum(n)
                found = self.order[s][np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]))]
                found = found[self.seen[found] != self.asked]
                self.seen[found] = self.asked
                d = np.bitwise_count(self.codes[found] ^ np.uint64(query)).astype(np.int64)
                rows, distances = np.concatenate([rows, found]), np.concatenate([distances, d])
                order = np.argsort(distances, kind="stable")
                rows, distances = rows[order], distances[order]
                held = np.cumsum(self.weights[rows])
                at = int(np.searchsorted(held, k))
                if at < len(rows):
                    cut = int(np.searchsorted(distances, distances[at], "right"))
                    rows, distances = rows[:cut], distances[:cut]
                    if distances[at] <= SEGMENTS * r + s:
                        return rows, distances
        return rows, distances


def _search(k: int):
    def run(_key, items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(items) or not len(queries):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "d": pd.Series(dtype="int64")})
        codes = items["c"].to_numpy(np.int64)
        index = Index(codes.view(np.uint64), items["n"].to_numpy(np.int64))
        out = []
        for q in queries["q"].to_numpy(np.int64):
            rows, d = index.nearest(int(q) & (1 << 64) - 1, k)
            out.append((np.full(len(rows), q), codes[rows], d))
        return pd.DataFrame({name: np.concatenate([x[i] for x in out]) for i, name in enumerate("qcd")})

    return run


def top_k(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for each (id, c) of ``queries`` the k rows of ``items`` nearest by Hamming distance.

    Exact; ties go to the smaller id; a query's own id is no neighbour of it. Null codes
    are left out, and null ids of items; a query repeated with one code gets one answer.
    Fewer than k rows are returned only if there are no more. Equal codes are searched once
    and carry their k + 1 smallest ids, so hot codes cost no more than others. The stated
    queries meet all codes in blocks; each block is indexed by its task and gives its own k
    nearest, and these are merged.
    """
    least = k + 1
    by_code = Window.partitionBy("c").orderBy("id")
    known = items.where("c is not null and id is not null").select("id", "c").distinct()
    ids = written(known.withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= least).drop("r"), "codes")
    codes = ids.groupBy("c").agg(F.count("*").alias("n"))
    asked = queries.where("c is not null").select("id", "c").distinct()
    wanted = asked.select(F.col("c").alias("q")).distinct()
    n_codes, n_wanted = codes.count(), wanted.count()
    blocks, parts = max(1, ceil(n_codes / ROWS)), max(1, ceil(n_wanted / QUERIES), min(8, ceil(n_wanted / 200)))
    left = codes.withColumn("b", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = wanted.withColumn("p", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(_search(least), "q long, c long, d long")
    best = Window.partitionBy("q").orderBy("d", "id")
    merged = near.join(ids, "c").withColumn("r", F.row_number().over(best)).where(F.col("r") <= least).select("q", "d", "id")
    own = Window.partitionBy("query_id", "q").orderBy("distance", "neighbor_id")
    answers = asked.select(F.col("id").alias("query_id"), F.col("c").alias("q")).join(merged, "q").where("query_id is null or query_id <> id")
    answers = answers.select("query_id", "q", F.col("id").alias("neighbor_id"), F.col("d").alias("distance")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", "neighbor_id", "distance")
