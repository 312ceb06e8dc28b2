"""Operator 10: exact top-k search by inner product over buckets of vector length.

Vectors are put in order of their length and cut into buckets, longest first.
A query with a lower bound T of its k-th score needs in a bucket with longest
vector L only vectors whose cosine with it is at least the local threshold
T / (|query| * L). Above 1 the bucket is skipped. A high threshold leaves each
coordinate of a unit vector a narrow interval, so the bucket is searched by
coordinates; otherwise it is cut at the shortest length that can still reach T.
What remains is verified by exact integer products. The first bounds come from
the longest bucket, and each task raises its own as it goes.

Vectors that are null or hold a null, NaN or infinite component take no part,
nor do rows without an id. Rows that repeat an id are rows of their own: each is
a query and a candidate, also for the others of its id. Shorter vectors are taken
as padded with zeros. A score beyond 64 bits is cut to the nearest long. An empty
table has no results.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.llm.common import record_batch, share, stored

BUCKET = 1024
# Queries broadcast at once; more are searched in further rounds.
QUERIES_AT_ONCE = 1 << 15
QUERY_BLOCK = 512
# From this local cosine threshold on, buckets are searched by coordinates.
BY_COORDINATE = 0.8
FOCUS = 3
SLACK = 1e-9


def quantised(vectors: DataFrame, scale: int = 64,
              id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v, norm) with ``v`` the floored multiples of the components; ``row`` tells
    rows apart once it is written."""
    unusable = F.exists(F.col(vector), lambda x: (
        x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))))
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~unusable)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return (
        usable.select(F.monotonically_increasing_id().alias("row"),
                      F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
        .withColumn("norm", F.sqrt(square))
    )


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def buckets(vectors: DataFrame, width: int) -> DataFrame:
    """(shard, block, n, rows, ids, norms, vectors): rows of ``BUCKET`` vectors by falling length."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int32()),
                        ("rows", pa.binary()), ("ids", pa.binary()), ("norms", pa.binary()),
                        ("vectors", pa.binary())])

    def bucket(shard: int, block: int, table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        columns = {name: table.column(name).chunk(0) for name in table.column_names}
        return record_batch(
            schema, [shard], [block], [table.num_rows],
            [columns["row"].to_numpy().tobytes()], [columns["vec_id"].to_numpy().tobytes()], [columns["norm"].to_numpy().tobytes()],
            [_matrix(columns["v"], width).tobytes()],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, rest = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            while rest.num_rows >= BUCKET:
                yield bucket(shard, block, rest.slice(0, BUCKET))
                block, rest = block + 1, rest.slice(BUCKET)
        if rest is not None and rest.num_rows:
            yield bucket(shard, block, rest)

    by_length = [F.desc("norm"), F.asc("vec_id"), F.asc("row")]
    ordered = vectors.repartitionByRange(*by_length).sortWithinPartitions(*by_length)
    return ordered.select("row", "vec_id", "norm", "v").mapInArrow(
        run, "shard int, block int, n int, rows binary, ids binary, norms binary, vectors binary")


class Search:
    """Running results of one task for one round of queries."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, floors: np.ndarray, k: int):
        self.rows, self.ids, self.k = rows, ids, k
        self.vectors, self.floors = vectors, floors.copy()
        exact = vectors.astype(np.float64)
        self.norms = np.sqrt((exact * exact).sum(1))
        self.unit = exact / np.maximum(self.norms, 1e-300)[:, None]
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def probe(self, rows: np.ndarray, ids: np.ndarray, norms: np.ndarray, vectors: np.ndarray) -> None:
        longest = norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.floors > 0, self.floors / (self.norms * longest), 0.0)
        local = np.nan_to_num(local, nan=2.0, posinf=2.0) * (1 - SLACK)
        by_length = np.flatnonzero(local < BY_COORDINATE)
        for start in range(0, len(by_length), QUERY_BLOCK):
            some = by_length[start:start + QUERY_BLOCK]
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = np.where(self.floors[some] > 0, self.floors[some] / self.norms[some], 0.0)
            stop = int(np.searchsorted(-norms, -needed.min() * (1 - SLACK), "right"))
            if stop:
                self._verify(some, np.arange(stop), rows, ids, vectors)
        orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        unit = vectors / np.maximum(norms, 1e-300)[:, None]
        for query in np.flatnonzero((local >= BY_COORDINATE) & (local <= 1)):
            near = self._by_coordinate(self.unit[query], local[query], unit, orders)
            if len(near):
                self._verify(np.array([query]), near, rows, ids, vectors)
        self._compact()

    @staticmethod
    def _by_coordinate(query, cosine, unit, orders) -> np.ndarray:
        """Places of vectors whose focus coordinates can give a cosine of at least ``cosine``."""
        focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
        reach = np.sqrt(np.maximum(0, (1 - cosine**2) * (1 - query[focus] ** 2))) + SLACK
        low, high = query[focus] * cosine - reach, query[focus] * cosine + reach
        # a cosine above the threshold moves the interval towards the query's own value
        low = np.where(query[focus] < -cosine, -1.0 - SLACK, np.minimum(low, query[focus] - SLACK))
        high = np.where(query[focus] > cosine, 1.0 + SLACK, np.maximum(high, query[focus] + SLACK))
        first = int(focus[0])
        if first not in orders:
            order = np.argsort(unit[:, first], kind="stable")
            orders[first] = order, unit[order, first]
        order, values = orders[first]
        near = order[np.searchsorted(values, low[0]):np.searchsorted(values, high[0], "right")]
        for axis, least, most in zip(focus[1:], low[1:], high[1:]):
            values = unit[near, axis]
            near = near[(values >= least) & (values <= most)]
        return near

    def _verify(self, queries, places, rows, ids, vectors) -> None:
        a, b = self.vectors[queries], vectors[places]
        largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
        if largest < 2**53:
            scores = (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
        elif largest < 2**62:
            scores = a @ b.T
        else:
            whole = a.astype(object) @ b.T.astype(object)
            scores = np.clip(whole, -2**63, 2**63 - 1).astype(np.int64)
        hit = scores >= self.floors[queries][:, None]
        hit &= self.rows[queries][:, None] != rows[places][None, :]
        one, other = np.nonzero(hit)
        new = queries[one], scores[one, other], ids[places[other]]
        self.found = tuple(np.concatenate(pair) for pair in zip(self.found, new))
        if len(self.found[0]) > 4 * len(self.ids) * self.k + (1 << 20):
            self._compact()

    def _compact(self) -> None:
        query, score, other = self.found
        order = np.lexsort((other, ~score, query))  # ~ falls as the score rises, without overflow
        query, score, other = query[order], score[order], other[order]
        begins = np.searchsorted(query, np.arange(len(self.ids)))
        rank = np.arange(len(query)) - begins[query]
        kth = np.flatnonzero(rank == self.k - 1)
        self.floors[query[kth]] = np.maximum(self.floors[query[kth]], score[kth])
        kept = rank < self.k
        self.found = query[kept], score[kept], other[kept]


def _probe(some: DataFrame, round_, width: int, k: int) -> DataFrame:
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()),
                        ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*round_.value, k)
        for batch in batches:
            for n, rows, ids, norms, vectors in zip(*(batch.column(i).to_pylist() for i in range(5))):
                search.probe(np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64),
                             np.frombuffer(norms, np.float64),
                             np.frombuffer(vectors, np.int64).reshape(n, width))
        query, score, other = search.found
        yield record_batch(schema, search.rows[query], search.ids[query], other, score)

    return some.select("n", "rows", "ids", "norms", "vectors").mapInArrow(
        run, "query_row long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the tasks found: at most k rows from each task and query."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, k: int, scale: int = 64,
           id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query.

    ``is_query`` is a condition on ``vec_id``. The vectors are written once with
    numbered rows, shuffled once and stored in buckets. Queries go to the tasks in rounds of at most
    ``QUERIES_AT_ONCE``, which bounds each broadcast however many there are.
    """
    spark = vectors.sparkSession
    usable = stored(quantised(vectors, scale, id_col, vector), "vectors")
    width = usable.agg(F.max(F.size("v"))).first()[0] or 0
    table = stored(buckets(usable, width), "buckets")
    queries = stored(usable.where(is_query).select("row", "vec_id", "v"), "queries")
    rounds, last = [], None
    while True:
        left = queries if last is None else queries.where(F.col("row") > last)
        block = left.orderBy("row").limit(QUERIES_AT_ONCE).toArrow()
        if not block.num_rows:
            break
        block = block.combine_chunks()
        rows, ids = block.column("row").to_numpy(), block.column("vec_id").to_numpy()
        wanted = _matrix(block.column("v").chunk(0), width)
        floors = np.full(len(ids), -2**63, np.int64)
        _, first = share(spark, (rows, ids, wanted, floors))
        longest = table.orderBy("shard", "block").limit(1)
        bounds = _best(_probe(longest, first, width, k), k).where(F.col("rank") == k).collect()
        floors[np.searchsorted(rows, [b.query_row for b in bounds])] = [b.score for b in bounds]
        _, second = share(spark, (rows, ids, wanted, floors))
        rounds.append(stored(_best(_probe(table, second, width, k), k), "top-k"))
        last = int(rows[-1])
    if not rounds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.drop("query_row")
