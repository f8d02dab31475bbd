"""Nearest neighbours by cosine: inverted lists, scanned dimension block by dimension block with early abandoning.

Vectors are scaled to length 1, so the largest cosine is the smallest distance.  Lists are cells of k-means centroids,
fitted with a random rotation on a bounded sample (``FIT`` rows, or 20 for each list); every row is indexed.  There are half
as many lists as the root of the number of rows, ``LISTS`` at most: beyond that lists grow longer, and are cut into more
blocks.  A query probes the lists nearest to it: as many as the sample needs for the wanted recall, and more until they hold
enough candidates.

Within a list, a block of rotated vectors is kept column block by column block.  For a query, the squared distance over
the first d of D rotated dimensions, scaled by D/d, estimates the whole; a candidate is abandoned as soon as that estimate
exceeds the current k-th best distance by more than the test's bound (1 + e/sqrt(d))**2, which a true neighbour fails with
negligible probability.  What survives is scored on the original vectors in double precision.

Lists are dealt out as (list, block of vectors, block of queries), so neither a large list nor many queries for one meet
in one task, and each task's memory is bounded by ROWS and QUERIES.  A vector goes once to each block of queries of its
list; against the ROWS x QUERIES comparisons of such a pair of blocks, sending ROWS vectors is little.

Defined results: vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite
components neither ask nor answer; ties go to the smaller id; a query with fewer candidates than k gets all; each row is a
query or candidate of its own, so of rows with one id, even equal ones, each gets its own answer, in which the others may
be; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import pin

#: Rows that lists and rotation are fitted on, and of those the queries that choose the number of probes.
FIT, TRIALS = 20_000, 400
RECALL = 0.985
#: Most lists; the driver and every task hold that many centroids.
LISTS = 4_096
#: Vectors and queries of a task's block.
ROWS, QUERIES = 8_192, 2_048
#: Dimensions of a column block, and the bound of the hypothesis test.
COLUMNS, EPSILON = 16, 2.1


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of doubles."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    out = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), fine.alias("fine"))
    return out.where(F.coalesce("fine", F.lit(False))).drop("fine")


def _lists(rows: int) -> int:
    return min(LISTS, round(rows**0.5 / 2))


class Index:
    """Rotation, centroids and number of probes; small enough to be sent to every task."""

    def __init__(self, sample: np.ndarray, count: int, k: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        n, dims = sample.shape
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        self.rotation = q * np.sign(np.diag(r))
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        lists = max(1, min(_lists(count), n // 20))
        self.centroids = x[rng.choice(n, lists, replace=False)] if n else np.zeros((1, dims))
        for _ in range(10 if lists > 1 else 0):
            own = self.nearest(x, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, own, x)
            size = np.bincount(own, minlength=lists)
            filled = size > 0
            self.centroids[filled] = sums[filled] / size[filled, None]
        self.probes = lists
        if lists > 1:
            # in the sample neighbours are farther than among all rows, so this asks for more probes than needed
            own = self.nearest(x, 1)[:, 0]
            ask = rng.choice(n, min(TRIALS, n), replace=False)
            near = x[ask] @ x.T
            near[np.arange(len(ask)), ask] = -2
            best = np.argpartition(-near, k, axis=1)[:, :k]
            order = self.nearest(x[ask], lists)
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(ask), 0), axis=1)
            needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
            self.probes = int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The numbers of the ``n`` nearest centroids, nearest first."""
        far = (self.centroids**2).sum(axis=1)[None, :] - 2 * (x @ self.centroids.T)
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def fit(rows: DataFrame, k: int) -> Index | None:
    """An index from the rows of smallest hash, so that reruns agree; equal rows are taken as often as they occur."""
    n = rows.count()
    if not n:
        return None
    picked = rows.select("v").orderBy(F.xxhash64("vec_id", "v", F.monotonically_increasing_id())).limit(max(FIT, 20 * _lists(n))).toPandas()
    return Index(np.array(picked["v"].tolist(), float), n, k)


def scan(query: np.ndarray, own: int, rows: np.ndarray, ids: np.ndarray, originals: np.ndarray, blocks: list[np.ndarray], rotated_query: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of one block for one query, the row ``own``: (places, cosines).

    ``order`` holds the places nearest to the list's middle first; the first few give the threshold to start from.
    """
    dims = originals.shape[1]
    alive = np.flatnonzero(rows != own)
    if len(alive) > 4 * k:
        head = order[: 4 * k + 1]
        head = head[rows[head] != own]
        start = sum(((b[head] - rotated_query[i * COLUMNS : i * COLUMNS + b.shape[1]]) ** 2).sum(axis=1) for i, b in enumerate(blocks))
        worst = np.partition(start, k - 1)[k - 1]
        partial = np.zeros(len(alive))
        seen = 0
        for b in blocks:
            partial += ((b[alive] - rotated_query[seen : seen + b.shape[1]]) ** 2).sum(axis=1)
            seen += b.shape[1]
            bound = (1 + EPSILON / seen**0.5) ** 2 if seen < dims else 1.0
            stay = partial * (dims / seen) <= worst * bound + 1e-9
            alive, partial = alive[stay], partial[stay]
            if seen < dims and len(alive) > 8 * k:
                # a better threshold: whole distances of the most promising
                lead = alive[np.argpartition(partial, 2 * k)[: 2 * k]]
                whole = sum(((c[lead] - rotated_query[i * COLUMNS : i * COLUMNS + c.shape[1]]) ** 2).sum(axis=1) for i, c in enumerate(blocks))
                worst = min(worst, np.partition(whole, k - 1)[k - 1])
    cosine = cosines(originals[alive], query)
    best = np.lexsort((ids[alive], -cosine))[:k]
    return alive[best], cosine[best]


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, row by row, so that equal vectors get equal values wherever they lie."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def search(rows: DataFrame, asks: Column, k: int = 5, every_list: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the neighbours of those of ``rows`` (vec_id, v), as of :func:`valid`, that ``asks`` marks.

    With ``every_list`` all lists are probed, so that only the hypothesis test stands between the answer and the exact one.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return empty
    rows = rows.where(F.size("v") == length.n)
    index = spark.sparkContext.broadcast(fit(rows, k))
    keep = "vec_id long, v array<double>, asks boolean, row long"

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), float).reshape(len(v), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(list=index.value.nearest(unit(b["v"]), 1)[:, 0])

    numbered = rows.select("vec_id", "v", asks.alias("asks"), F.monotonically_increasing_id().alias("row"))
    listed = pin(numbered.mapInPandas(assign, f"{keep}, list int"))  # the rows' numbers are fixed once they are written
    sizes = {r.list: r["count"] for r in listed.groupBy("list").count().collect()}  # LISTS at most
    v_blocks = {i: -(-n // ROWS) for i, n in sizes.items()}
    enough = k + 1

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.array([sizes.get(i, 0) for i in range(len(index.value.centroids))])
        for b in batches:
            if not len(b):
                continue
            order = index.value.nearest(unit(b["v"]), len(n))
            held = np.cumsum(n[order], axis=1)
            many = np.maximum(len(n) if every_list else index.value.probes, (held < enough).sum(axis=1) + 1)
            lists = [[int(i) for i in o[:m] if n[i]] for o, m in zip(order, many, strict=True)]
            yield b.assign(lists=lists)

    probing = listed.where("asks").drop("list").mapInPandas(probe, f"{keep}, lists array<int>").select("row", "vec_id", "v", F.explode("lists").alias("list"))
    probing = pin(probing)
    asked = {r.list: r["count"] for r in probing.groupBy("list").count().collect()}
    q_blocks = {i: -(-n // QUERIES) for i, n in asked.items()}
    deal = spark.createDataFrame([(i, v_blocks[i], q_blocks[i]) for i in asked], "list int, vb long, qb long")  # LISTS rows at most
    deal = F.broadcast(deal)
    one = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "row"), F.col(n))
    left = listed.drop("asks").join(deal, "list").withColumn("vblock", one("vb", 1)).withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1))).drop("vb", "qb")
    right = probing.join(deal, "list").withColumn("qblock", one("qb", 2)).withColumn("vblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vb") - 1))).drop("vb", "qb")

    def best(vectors: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(asks):
            vectors = vectors.sort_values(["vec_id", "row"])
            ids, numbers = vectors["vec_id"].to_numpy(np.int64), vectors["row"].to_numpy(np.int64)
            originals = np.array(vectors["v"].tolist(), float)
            rotated = unit(vectors["v"]) @ index.value.rotation
            blocks = [np.ascontiguousarray(rotated[:, i : i + COLUMNS]) for i in range(0, rotated.shape[1], COLUMNS)]
            middle = rotated.mean(axis=0)
            order = np.argsort(((rotated - middle) ** 2).sum(axis=1), kind="stable")
            turned = unit(asks["v"]) @ index.value.rotation
            for vector, own, query_id, q in zip(np.array(asks["v"].tolist(), float), asks["row"].tolist(), asks["vec_id"].tolist(), turned, strict=True):
                found, score = scan(vector, own, numbers, ids, originals, blocks, q, k, order)
                out["row"] += [own] * len(found)
                out["query_id"] += [query_id] * len(found)
                out["vec_id"] += ids[found].tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out)

    keys = ["list", "vblock", "qblock"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: best(a, b), "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(embeddings: DataFrame, k: int = 5) -> DataFrame:
    return search(valid(embeddings, "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k)
