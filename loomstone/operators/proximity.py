"""Vector search: exact k-nearest neighbours, filters, and accelerators with exact reranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomstone.workers import reachable

METRICS = ("l2", "cosine", "inner_product")
EXACT_FLOOR, EXACT_SHARE = 4096, 0.01
QUANTILE_ACCURACY = 10_000
QUERY_BLOCK = 256
BLOCK_ROWS, BLOCK_NUMBERS, GROUPS_PER_CORE, MOST_TASKS = 512, 1 << 19, 16, 4096
QUERIES_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 16
SAFE_LEAST, SAFE_MOST = 1e-280, 1e300


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed left to right."""
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed left to right."""
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, clamped; a zero vector is an error."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cosine = F.when(norms == 0, F.raise_error(F.lit("a zero vector has no direction")).cast("double")).otherwise(dot(a, b) / norms)
    return 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance by name, lower is nearer; -0.0 becomes 0.0."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    found = squared_l2(a, b) if metric == "l2" else cosine_distance(a, b) if metric == "cosine" else -dot(a, b)
    return found + 0.0


def checked(vectors: DataFrame, vec: str, dimensions: int) -> DataFrame:
    """The vectors, or an error for one of another length or with a number that isn't finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = (F.size(vec) == dimensions) & finite
    return vectors.withColumn(vec, F.when(ok, F.col(vec)).otherwise(F.raise_error(F.lit(f"not a finite vector of {dimensions} numbers"))))


def normalized(vec: Column) -> Column:
    """Unit vector in single precision."""
    return F.transform(vec, lambda x: (x.cast("double") / F.sqrt(dot(vec, vec))).cast("float"))


def nearest(vectors: DataFrame, key: str, vec: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows: (key, distance), ties by key. The query is a literal; each task keeps k rows."""
    target = F.array(*[F.lit(float(x)).cast("float") for x in query])
    return vectors.select(key, distance(metric, F.col(vec), target).alias("distance")).orderBy("distance", key).limit(k)


def nearest_eligible(vectors: DataFrame, eligible: DataFrame, key: str, vec: str, query: list[float], k: int, metric: str = "l2", bound: bool = False) -> DataFrame:
    """Exact search among listed keys; unknown keys are skipped, or an error if the list is bound to the source."""
    if bound and eligible.join(vectors, key, "left_anti").limit(1).count():
        raise ValueError("an eligible key isn't in the snapshot")
    return nearest(vectors.join(eligible.select(key).distinct(), key, "left_semi"), key, vec, query, k, metric)


def query_blocks(queries: DataFrame) -> DataFrame:
    """Queries packed into arrays ``qs`` of at most ``QUERY_BLOCK``, which divides the 2^33 row numbers of a partition."""
    block = F.floor(F.monotonically_increasing_id() / QUERY_BLOCK)
    return queries.select(block.alias("block"), F.struct("query", "target").alias("q")).groupBy("block").agg(F.collect_list("q").alias("qs")).select("qs")


def nearest_for_each(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows of every query: (query, key, distance, rank), ties by key; pairs without a distance come last.

    ``queries`` has (query, target) and may be of any size. Both sides are dealt
    into blocks by hash and every block of vectors meets every block of queries in
    a group of its own, so memory is bounded by two blocks and the groups spread
    over all tasks. A group drops rows that a matrix product, with a bound on its
    rounding, shows to be too far; the others get the distance of ``distance``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    spark = reachable(vectors.sparkSession)
    n_vectors, width = vectors.agg(F.count("*"), F.max(F.size(vec))).first()
    n_queries = queries.count()
    most = max(1, BLOCK_NUMBERS // max(width or 1, 1))
    rows = min(most, max(BLOCK_ROWS, math.isqrt(n_vectors * n_queries // (GROUPS_PER_CORE * spark.sparkContext.defaultParallelism))))
    wide, deep = max(1, -(-n_vectors // rows)), max(1, -(-n_queries // rows))

    def dealt(side: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*side.columns), F.lit(n_own)).cast("int")
        met = side.select("*", block.alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))
        return met.repartition(min(wide * deep, MOST_TASKS), "v_block", "q_block").groupBy("v_block", "q_block")

    left = dealt(vectors.select(F.col(key).alias("key"), F.col(vec).alias("vec")), "v_block", wide, "q_block", deep)
    right = dealt(queries.select("query", "target"), "q_block", deep, "v_block", wide)
    schema = StructType([StructField("query", queries.schema["query"].dataType), StructField(key, vectors.schema[key].dataType), StructField("distance", DoubleType())])
    local = left.cogroup(right).applyInArrow(lambda a, b: block_nearest(a, b, k, metric).rename_columns(["query", key, "distance"]), schema)
    best = Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), key)
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", key, "distance", "rank")


def _numbers(column):
    """Lists of numbers as (lengths, first places, all numbers); the length is -1 where the list or one of its numbers is null."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(known, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    starts, flat = np.concatenate([[0], np.cumsum(lengths)]), column.flatten()
    nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = known & (nulls[starts[1:]] == nulls[starts[:-1]])
    return np.where(whole, lengths, -1), starts[:-1], flat.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _pair_distances(metric: str, a, b):
    """Distances of the columns of two matrices, summed left to right as ``distance`` does."""
    import numpy as np

    def fold(x, y):
        total = np.zeros(x.shape[1])
        for p, q in zip(x, y, strict=True):
            total += (p - q) * (p - q) if metric == "l2" else p * q
        return total

    if metric == "cosine":
        norms = np.sqrt(fold(a, a)) * np.sqrt(fold(b, b))
        return 1.0 - np.clip(fold(a, b) / norms, -1.0, 1.0) + 0.0
    return (fold(a, b) if metric == "l2" else -fold(a, b)) + 0.0


def block_nearest(vectors, queries, k: int, metric: str):
    """(query, key, distance) of the k nearest in one block of (key, vec) for each of a block of (query, target), as Arrow tables."""
    import numpy as np
    import pyarrow as pa

    vectors = vectors.sort_by("key")
    (v_length, v_start, v_flat), (q_length, q_start, q_flat) = _numbers(vectors["vec"]), _numbers(queries["target"])
    n_found, found = np.zeros(len(q_length), np.int64), []
    for length in np.intersect1d(v_length[v_length >= 0], q_length[q_length >= 0]):
        v_rows, q_rows = np.flatnonzero(v_length == length), np.flatnonzero(q_length == length)
        places = np.arange(length)
        points, targets = (flat[start[rows][:, None] + places] + 0.0 for flat, start, rows in ((v_flat, v_start, v_rows), (q_flat, q_start, q_rows)))
        # equal vectors count once, with their k least keys
        same: dict[bytes, list[int]] = {}
        for at, point in enumerate(points):
            same.setdefault(point.tobytes(), []).append(at)
        members = [held[:k] for held in same.values()]
        points, counts = points[[held[0] for held in members]], np.array([len(held) for held in members])
        rows_of, first = v_rows[np.concatenate(members)], np.concatenate([[0], np.cumsum(counts)[:-1]])
        with np.errstate(all="ignore"):
            for qi, vi, far in _closest(points, targets, k, metric):
                many = counts[vi]
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                row, query, far = rows_of[np.repeat(first[vi], many) + within], np.repeat(qi, many), np.repeat(far, many)
                order = np.lexsort((row, far, query))
                row, query, far = row[order], query[order], far[order]
                kept = np.arange(len(query)) - np.searchsorted(query, query) < k
                found.append((q_rows[query[kept]], row[kept], far[kept], np.ones(kept.sum(), bool)))
                n_found[q_rows] += np.bincount(query[kept], minlength=len(q_rows))
    for at in np.flatnonzero(n_found < min(k, len(v_length))):
        apart = np.flatnonzero((v_length != q_length[at]) | (v_length < 0))[: k - n_found[at]]
        found.append((np.full(len(apart), at), apart, np.zeros(len(apart)), np.zeros(len(apart), bool)))
    query, row, far, known = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, bool))
    return pa.table({"query": queries["query"].take(pa.array(query)), "key": vectors["key"].take(pa.array(row)), "distance": pa.array(far, pa.float64(), mask=~known)})


def _closest(points, targets, k: int, metric: str):
    """(query, point, distance) of all points that may be among the k nearest, for some queries at a time."""
    import numpy as np

    squares, q_squares = (points * points).sum(1), (targets * targets).sum(1)
    if metric == "cosine":
        if (points == 0).all(1).any() or (targets == 0).all(1).any():
            raise ValueError("a zero vector has no direction")
        points_, targets_ = points / np.sqrt(squares)[:, None], targets / np.sqrt(q_squares)[:, None]
        largest, q_largest, odd, q_odd = 1.0, np.ones(len(targets)), ~np.isfinite(points_).all(1), ~np.isfinite(targets_).all(1)
        # squares that underflow or overflow make the quotients inexact
        odd |= ~((squares > SAFE_LEAST) & (squares < SAFE_MOST))
        q_odd |= ~((q_squares > SAFE_LEAST) & (q_squares < SAFE_MOST))
    else:
        points_, targets_, odd, q_odd = points, targets, ~(squares < SAFE_MOST), ~(q_squares < SAFE_MOST)
        largest, q_largest = np.sqrt(squares[~odd].max(initial=0.0)), np.sqrt(q_squares)
    slack = (points.shape[1] + 16) * 4 * np.finfo(float).eps
    even, columns, q_columns = np.flatnonzero(~odd), np.ascontiguousarray(points.T), np.ascontiguousarray(targets.T)
    near, n = points_[even], min(k, len(even))
    for at in range(0, len(targets), QUERIES_AT_ONCE):
        part = slice(at, at + QUERIES_AT_ONCE)
        rough = near @ targets_[part].T
        rough = (squares[even][:, None] - 2.0 * rough if metric == "l2" else -rough).T
        may = np.ones((len(rough), len(points)), bool)
        if n:
            scale = largest + q_largest[part]
            bound = np.partition(rough, n - 1, axis=1)[:, n - 1] + slack * scale * scale + np.finfo(float).tiny
            may[:, even] = ~(rough > bound[:, None])
        may[q_odd[part]] = True
        qi, vi = np.nonzero(may)
        # whole queries at a time, so that their k nearest are judged together
        ends = np.searchsorted(qi, np.arange(len(rough)), side="right")
        begin = 0
        while begin < len(qi):
            end = max(int(ends[qi[begin]]), int(ends[ends <= begin + PAIRS_AT_ONCE].max(initial=0)))
            q, v = qi[begin:end], vi[begin:end]
            steps = [slice(i, i + PAIRS_AT_ONCE) for i in range(0, end - begin, PAIRS_AT_ONCE)]
            yield q + at, v, np.concatenate([_pair_distances(metric, columns[:, v[i]], q_columns[:, at + q[i]]) for i in steps])
            begin = end


def choose_backend(n_rows: int, n_eligible: int | None, k: int, accelerators: tuple[str, ...] = (), exact: bool = False) -> str:
    """Exact over a short key list, else native if exactness is asked for, else the first accelerator; ``VectorMap.search`` runs the choice."""
    if n_eligible is not None and n_eligible <= max(k, min(EXACT_FLOOR, -(-n_rows * EXACT_SHARE // 1))):
        return "eligible_exact"
    return "native" if exact or not accelerators else accelerators[0]


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in single precision; 0 if either vector has no direction."""
    fold = lambda pairs: F.aggregate(pairs, F.lit(0.0).cast("float"), lambda t, x: (t + x).cast("float"))
    product = lambda x, y: fold(F.zip_with(x, y, lambda p, q: (p.cast("float") * q.cast("float")).cast("float")))
    norms = (F.sqrt(product(a, a)).cast("float") * F.sqrt(product(b, b)).cast("float")).cast("float")
    return F.when(norms == 0, F.lit(0.0).cast("float")).otherwise((product(a, b) / norms).cast("float"))


def quantize_sq8(vec: Column) -> Column:
    """Scale and signed bytes of a vector: scale = max / 127, rounded half to even."""
    scale = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double")))) / 127.0
    code = lambda x: F.when(scale == 0, 0).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") / scale)))).cast("tinyint")
    return F.struct(scale.alias("scale"), F.transform(vec, code).alias("codes"))


def dequantize(quantized: Column) -> Column:
    """Approximate vector of a quantized one."""
    return F.transform(quantized["codes"], lambda c: (c.cast("double") * quantized["scale"]).cast("float"))


def encode_sq8(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, scale, codes): a quarter of the bytes of the vectors, to be stored beside them."""
    return vectors.select(key, quantize_sq8(F.col(vec)).alias("q")).select(key, "q.scale", "q.codes")


def nearest_sq8(codes: DataFrame, vectors: DataFrame, key: str, vec: str, query: list[float], k: int, rerank: int = 8) -> DataFrame:
    """Approximate distances over stored codes, exact ones for the best k * rerank: only these rows of the vectors are used."""
    target = F.array(*[F.lit(float(x)).cast("float") for x in query])
    rough = codes.select(key, squared_l2(dequantize(F.struct("scale", "codes")), target).alias("rough"))
    best = rough.orderBy("rough", key).limit(k * rerank).select(key)
    return nearest(vectors.join(F.broadcast(best), key, "left_semi"), key, vec, query, k)


def train_cells(vectors: DataFrame, vec: str, cells: int, seed: int = 7):
    """Coarse cells by k-means over all vectors (pyspark.ml)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=cells, seed=seed, maxIter=12).fit(points)


def assign_cells(vectors: DataFrame, vec: str, model) -> DataFrame:
    """Vectors with the cell that they belong to, for storing by cell."""
    from pyspark.ml.functions import array_to_vector

    points = vectors.withColumn("features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return model.transform(points).drop("features").withColumnRenamed("prediction", "cell")


def nearest_in_cells(assigned: DataFrame, key: str, vec: str, model, query: list[float], k: int, probes: int) -> DataFrame:
    """Exact distances within the cells nearest to the query; all cells give the exact answer."""
    centers = model.clusterCenters()
    order = sorted(range(len(centers)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(centers[i], query, strict=True)), i))
    return nearest(assigned.where(F.col("cell").isin(order[:probes])), key, vec, query, k)


def train_product_quantizer(vectors: DataFrame, vec: str, parts: int = 8, centroids: int = 256, seed: int = 7) -> list:
    """One k-means model per slice of the dimensions."""
    dimensions = len(vectors.select(vec).first()[0])
    if dimensions % parts:
        raise ValueError(f"{dimensions} dimensions don't divide by {parts}")
    width = dimensions // parts
    return [train_cells(vectors.select(F.slice(vec, 1 + p * width, width).alias(vec)), vec, centroids, seed) for p in range(parts)]


def encode_product(vectors: DataFrame, vec: str, models: list) -> DataFrame:
    """Vectors with ``codes``: the nearest centroid of each slice, the lowest if it ties."""
    width, slices = len(models[0].clusterCenters()[0]), [f"_slice{p}" for p in range(len(models))]
    encoded = vectors.withColumns({name: F.slice(vec, 1 + p * width, width) for p, name in enumerate(slices)})
    for name, model in zip(slices, models, strict=True):
        encoded = assign_cells(encoded, name, model).drop(name).withColumnRenamed("cell", name)
    return encoded.withColumn("codes", F.array(*slices)).drop(*slices)


def nearest_product(encoded: DataFrame, key: str, vec: str, models: list, query: list[float], k: int, rerank: int = 8, share: float = 0.0) -> DataFrame:
    """Approximate distances from a table per slice, then exact ones for the best k * rerank, or the best share of all rows if that is more.

    The rows to rerank are those up to a quantile of the approximate distance, so
    they are filtered where they lie. At a fixed depth recall falls as the table
    grows; at a fixed share it doesn't.
    """
    width = len(models[0].clusterCenters()[0])
    tables = []
    for p, model in enumerate(models):
        own = query[p * width : (p + 1) * width]
        tables.append(F.array(*[F.lit(float(sum((a - b) ** 2 for a, b in zip(own, c, strict=True)))) for c in model.clusterCenters()]))
    rough = sum((F.get(t, F.get("codes", F.lit(p))) for p, t in enumerate(tables)), F.lit(0.0))
    scored = encoded.select(key, vec, rough.alias("rough"))
    part = min(1.0, max(share, k * rerank / max(encoded.count(), 1)) + 1 / QUANTILE_ACCURACY)
    bound = scored.agg(F.percentile_approx("rough", part, QUANTILE_ACCURACY)).first()[0]
    return nearest(scored.where(F.col("rough") <= F.lit(bound)), key, vec, query, k)


def nearest_composite(base: DataFrame, delta: DataFrame, removed: DataFrame, key: str, vec: str, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """Search over an accelerated base and later changes: stale and removed rows of the base are hidden, the rest meets the delta's best."""
    hidden = delta.select(key).unionByName(removed.select(key)).distinct()
    old = nearest(base.join(hidden, key, "left_anti"), key, vec, query, k, metric)
    return old.unionByName(nearest(delta, key, vec, query, k, metric)).orderBy("distance", key).limit(k)


def context_of(found: DataFrame, texts: DataFrame, key: str, text: str, separator: str = "\n\n") -> DataFrame:
    """The texts of a search result as one string, nearest first; the result is bounded by its k."""
    parts = F.array_sort(F.collect_list(F.struct("distance", key, text)))
    return found.join(texts, key).agg(F.array_join(F.transform(parts, lambda p: p[text]), separator).alias("context"))


# neighbour graphs


DEGREE, ENTRIES, SHARD_ROWS = 16, 8, 4096


def build_graph(vectors: DataFrame, key: str, vec: str, shards: int | None = None, degree: int = DEGREE) -> DataFrame:
    """(shard, place, key, vec, links): a graph in each shard of at most about ``SHARD_ROWS`` rows.

    A row links to its ``degree`` nearest rows of the shard, in both directions,
    and to one drawn by hash, so that a walk reaches all parts. Shards are dealt
    by hash of the key, so the graph depends on the rows only.
    """
    reachable(vectors.sparkSession)
    n = shards or max(1, -(-vectors.count() // SHARD_ROWS))
    placed = vectors.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("shard"), F.col(key).alias("key"), F.col(vec).alias("vec"))

    def link(pdf):
        import numpy as np

        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        points = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        squares, m, near = (points**2).sum(axis=1), len(points), []
        for at in range(0, m, 512):
            far = squares[at : at + 512, None] + squares[None, :] - 2 * points[at : at + 512] @ points.T
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            near.append(np.argsort(far, axis=1, kind="stable")[:, : min(degree, m - 1)])
        links = [set(row.tolist()) for row in np.concatenate(near)]
        for i in range(m):
            for j in list(links[i]):
                links[j].add(i)
            links[i].add((i * 2654435761 + 97) % m)
        pdf["place"] = np.arange(m, dtype=np.int32)
        pdf["links"] = [np.array(sorted(x - {i}), dtype=np.int32) for i, x in enumerate(links)]
        return pdf[["shard", "place", "key", "vec", "links"]]

    kind = dict(vectors.dtypes)[key]
    return placed.groupBy("shard").applyInPandas(link, f"shard int, place int, key {kind}, vec array<float>, links array<int>")


def adaptive_should_stop(best: float, next_: float, width: int, ef: int, slack: float = 0.0) -> bool:
    """Whether a best-first walk may end: it has ``ef`` results and the next place is further than the worst of them, by a slack."""
    return width >= ef and next_ > best * (1.0 + slack)


def nearest_in_graph(graph: DataFrame, query: list[float], k: int, ef: int = 64, most_visits: int | None = None) -> DataFrame:
    """(key, distance) of the k nearest by walks, one in each shard, by squared distance.

    A walk keeps the ``ef`` best places seen and goes on from the nearest one not
    yet left; ``most_visits`` bounds the places scored in each shard.
    """

    def walk(pdf):
        import heapq

        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("place", kind="stable")
        points, links, target = np.stack(pdf["vec"].to_numpy()).astype(np.float64), pdf["links"].to_numpy(), np.array(query)
        m = len(points)
        start = sorted({i * m // ENTRIES for i in range(ENTRIES)})
        score = lambda at: ((points[at] - target) ** 2).sum(axis=1)
        seen, ahead, kept = set(start), [], []
        for d, i in zip(score(start).tolist(), start, strict=True):
            heapq.heappush(ahead, (d, i))
            heapq.heappush(kept, (-d, i))
        while ahead:
            d, i = heapq.heappop(ahead)
            if adaptive_should_stop(-kept[0][0], d, len(kept), ef) or most_visits is not None and len(seen) >= most_visits:
                break
            new = [j for j in links[i] if j not in seen]
            seen.update(new)
            for d, j in zip(score(new).tolist() if new else [], new, strict=True):
                if len(kept) < ef or d < -kept[0][0]:
                    heapq.heappush(ahead, (d, j))
                    heapq.heappush(kept, (-d, j))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        keys = pdf["key"].to_numpy()
        found = sorted((-d, keys[i]) for d, i in kept)[:k]
        return pd.DataFrame({"key": [x for _, x in found], "distance": [d for d, _ in found]})

    reachable(graph.sparkSession)
    kind = dict(graph.dtypes)["key"]
    found = graph.groupBy("shard").applyInPandas(walk, f"key {kind}, distance double")
    return found.orderBy("distance", "key").limit(k)
