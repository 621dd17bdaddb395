"""Nearest neighbours by inner product with score-aware quantisation.

Pairs of dimensions are coded by one of 16 centroids.  Codes and centroids
minimise a loss that weighs the residual's part parallel to the vector more
than the rest, since only that part shifts large inner products.  A query's
tables of 16 products per pair are added up over the four-bit codes of every
vector; the best of each chunk of vectors are reranked by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, staged

# Parameters.
CENTROIDS = 16  # a code has four bits
SAMPLE = 16_384  # vectors that fit the centroids
CHUNK_ROWS = 4096
PART_ROWS = 65_536  # of chunks that a block of queries meets in one task; fewer while there are few tasks
RERANKED = 200  # of each chunk, for each query
THRESHOLD = 0.2  # score, as a share of the norm, from which errors matter
FIT_ROUNDS, CODE_ROUNDS = 6, 2


class Quantizer:
    def __init__(self, centroids: np.ndarray, weight: float):
        """``centroids``: (pairs, 16, 2); ``weight``: of the squared parallel
        residual beside the whole squared residual."""
        self.centroids, self.weight = centroids, weight

    @staticmethod
    def pairs(vectors: np.ndarray) -> np.ndarray:
        n, d = vectors.shape
        padded = np.zeros((n, (d + 3) // 4 * 4))  # whole bytes of two codes
        padded[:, :d] = vectors
        return padded.reshape(n, -1, 2)

    @classmethod
    def fit(cls, vectors: np.ndarray) -> Quantizer:
        x = cls.pairs(vectors)
        d = vectors.shape[1]
        weight = max(0.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) - 1)
        random = np.random.default_rng(5)
        chosen = random.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)
        own = cls(x[chosen].transpose(1, 0, 2).copy(), weight)
        for _ in range(FIT_ROUNDS):
            codes = own.encode_pairs(x, rounds=1)
            own._move(x, codes)
        return own

    def _unit(self, x: np.ndarray) -> np.ndarray:
        norms = np.sqrt((x**2).sum(axis=(1, 2), keepdims=True))
        return x / np.where(norms > 0, norms, 1)

    def encode_pairs(self, x: np.ndarray, rounds: int = CODE_ROUNDS) -> np.ndarray:
        """Nearest centroids first; then one pair after the other takes the code
        that is best beside the others' residuals."""
        n, m, _ = x.shape
        unit = self._unit(x)
        codes = np.empty((n, m), np.int64)
        for j in range(m):
            codes[:, j] = ((x[:, j, None] - self.centroids[j]) ** 2).sum(axis=2).argmin(axis=1)
        residual = x - self.centroids[np.arange(m), codes]
        parallel = (residual * unit).sum(axis=2)
        total = parallel.sum(axis=1)
        for _ in range(rounds):
            for j in range(m):
                left = x[:, j, None] - self.centroids[j]
                along = (left * unit[:, j, None]).sum(axis=2)
                rest = (total - parallel[:, j])[:, None]
                codes[:, j] = ((left**2).sum(axis=2) + self.weight * (rest + along) ** 2).argmin(axis=1)
                new = along[np.arange(n), codes[:, j]]
                total += new - parallel[:, j]
                parallel[:, j] = new
        return codes

    def _move(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centroid to the minimum of the loss while all others stay."""
        n, m, _ = x.shape
        unit = self._unit(x)
        residual = x - self.centroids[np.arange(m), codes]
        parallel = (residual * unit).sum(axis=2)
        total = parallel.sum(axis=1)
        for j in range(m):
            u = unit[:, j]
            aim = total - parallel[:, j] + (x[:, j] * u).sum(axis=1)
            for c in range(CENTROIDS):
                of = codes[:, j] == c
                if of.any():
                    left = of.sum() * np.eye(2) + self.weight * u[of].T @ u[of]
                    self.centroids[j, c] = np.linalg.solve(left, (x[of, j] + self.weight * aim[of, None] * u[of]).sum(axis=0))
            new = ((x[:, j] - self.centroids[j, codes[:, j]]) * u).sum(axis=1)
            total += new - parallel[:, j]
            parallel[:, j] = new

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Bytes of two codes each, (rows, pairs / 2)."""
        codes = self.encode_pairs(self.pairs(vectors)).astype(np.uint8)
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def tables(self, query: np.ndarray) -> np.ndarray:
        """For each byte of a code the sum of its two products."""
        products = (self.centroids * self.pairs(query[None])[0][:, None]).sum(axis=2).astype(np.float32)
        return (products[0::2, :, None] + products[1::2, None, :]).reshape(len(products) // 2, 256)


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, dimension after dimension, so that
    equal vectors have equal scores wherever they are."""
    out = np.zeros(len(vectors))
    for j in range(len(query)):
        out += vectors[:, j].astype(np.float64) * np.float64(query[j])
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest; of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    limit = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > limit)
    return np.concatenate([above, np.flatnonzero(scores == limit)[: k - len(above)]])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (float or double) of the rows that take part: ids and
    vectors that are not null, whose components are all finite and not all zero."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    exact = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    embedding = F.col("embedding") if exact else F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", embedding.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda e: e != 0)
    )


def fitted(rows: DataFrame) -> dict[int, Quantizer]:
    """A quantizer for each length of vectors that a sample of SAMPLE rows has
    often enough; vectors of other lengths have no codes and are all reranked."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(F.col("embedding").cast("array<double>").alias("e")).toPandas()["e"]
    by_length: dict[int, list] = {}
    for vector in sample:
        by_length.setdefault(len(vector), []).append(vector)
    return {n: Quantizer.fit(np.array(v, np.float64)) for n, v in by_length.items() if len(v) >= CENTROIDS}


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by
    ``every`` its k nearest other rows (all, if fewer).

    Only vectors of a query's own length have a product with it and are its
    candidates.  Rows that repeat a vec_id are rows of their own; a query skips
    only its own row, and queries that repeat a vec_id are answered together.
    Ties go to the smaller vec_id.  A table without usable vectors gives no rows.
    Components other than float are taken as double.
    """
    rows = usable(vectors)
    kind = np.float32 if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    n_rows = rows.count()
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    n_parts = max(1, min(-(-n_rows // CHUNK_ROWS), max(tasks, -(-n_rows // PART_ROWS))))
    quantizers = fitted(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(n: int, whole: bool) -> Iterator[pa.RecordBatch]:
            ids, data = (np.concatenate(x) for x in zip(*held[n], strict=True))
            full = len(ids) if whole else len(ids) // CHUNK_ROWS * CHUNK_ROWS
            held[n] = [(ids[full:], data[full:])]
            for i in range(0, full, CHUNK_ROWS):
                end = min(i + CHUNK_ROWS, full)
                order = i + np.argsort(ids[i:end], kind="stable")
                codes = quantizers[n].encode(data[order].astype(np.float64)).tobytes() if n in quantizers else b""
                binary = [pa.array([x], pa.binary()) for x in (ids[order].tobytes(), data[order].tobytes(), codes)]
                numbers = [pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), n)]
                yield pa.RecordBatch.from_arrays([*numbers, *binary], ["part", "length", "ids", "vectors", "codes"])

        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for n in np.unique(sizes).tolist():
                of = batch.filter(pa.array(sizes == n))
                flat = of.column(1).flatten().to_numpy().astype(kind)
                held.setdefault(n, []).append((of.column(0).to_numpy().astype(np.int64), flat.reshape(of.num_rows, n)))
                if sum(len(i) for i, _ in held[n]) >= CHUNK_ROWS:
                    yield from packed(n, False)
        for n in held:
            yield from packed(n, True)

    # evenly and by no key, so that chunks are full whatever the session's partitions
    spread = rows.repartition(n_parts).mapInArrow(pack, "part long, length long, ids binary, vectors binary, codes binary")
    chunks = staged(spread.withColumn("chunk", F.monotonically_increasing_id()), "vector-chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, data, chunk, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "chunk", "length")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    out.append((chunk, n, ids[at].tobytes(), at.tobytes(), np.frombuffer(data, kind).reshape(len(ids), n)[at].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:2]], *[pa.array(c, pa.binary()) for c in columns[2:]]], ["of", "length", "q_ids", "q_at", "q_vectors"]
            )

    asked = chunks.select("ids", "vectors", "chunk", "length").mapInArrow(ask, "of long, length long, q_ids binary, q_at binary, q_vectors binary")
    asked = staged(asked, "queries")
    last_part = chunks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("of", "chunk", "length", "q_ids", "q_at", "q_vectors", "ids", "vectors", "codes")
        for batch in batches:
            for of, chunk, length, q_ids, q_at, q_vectors, ids, data, codes in zip(*(batch.column(c) for c in names), strict=True):
                n = length.as_py()
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                data = np.frombuffer(data.as_buffer(), kind).reshape(len(ids), n)
                quantizer = quantizers.get(n)
                if quantizer:
                    codes = np.ascontiguousarray(np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(ids), -1).T)
                q_ids, q_at = (np.frombuffer(x.as_buffer(), np.int64) for x in (q_ids, q_at))
                queries = np.frombuffer(q_vectors.as_buffer(), kind).reshape(len(q_ids), n)
                same = of.as_py() == chunk.as_py()
                found = []
                for q, query in enumerate(queries):
                    if quantizer:
                        rough = np.zeros(len(ids), np.float32)
                        for table, byte in zip(quantizer.tables(query.astype(np.float64)), codes, strict=True):
                            rough += table[byte]
                        if same:
                            rough[q_at[q]] = -np.inf
                        at = best(rough, RERANKED)
                    else:
                        at = np.arange(len(ids))
                    if same:
                        at = at[at != q_at[q]]
                    score = exact_scores(query, data[at])
                    at, score = (x[np.lexsort((ids[at], -score))[:k]] for x in (at, score))
                    found.append((np.full(len(at), q_ids[q]), np.full(len(at), q_at[q]), ids[at], score))
                q, q_row, v, s = map(np.concatenate, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(np.full(len(q), of.as_py())), pa.array(q_row), pa.array(v), pa.array(s)], ["query_id", "of", "q_row", "vec_id", "score"]
                )
        give_back()

    everywhere = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last_part)))).hint("merge")
    found = everywhere.join(chunks, ["part", "length"]).mapInArrow(search, "query_id long, of long, q_row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "of", "q_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def oracle(k: int = 20, every: int = 20) -> str:
    """DuckDB: exact search over all pairs of a query and a row."""
    return f"""
    with v as (
      select vec_id, embedding::double[] as e, row_number() over () as row_no from embeddings
      where vec_id is not null and embedding is not null
        and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
        and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    scored as (
      select q.vec_id as query_id, q.row_no as q_row, c.vec_id, list_inner_product(q.e, c.e) as score
      from v q join v c on q.row_no <> c.row_no and len(q.e) = len(c.e) where q.vec_id % {every} = 0),
    ranked as (
      select *, row_number() over (partition by q_row order by score desc, vec_id) as rn from scored)
    select query_id, rn::integer as rank, vec_id, score from ranked where rn <= {k}"""
