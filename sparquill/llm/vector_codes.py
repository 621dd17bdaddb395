"""Vector codes by product quantisation in whole numbers.

Components become integers, vectors are cut into parts, and each part position
has a codebook that a few rounds of k-means improve.  Vectors are kept as
columnar NumPy blocks, one array per dimension; an RDD ``treeAggregate`` over
them assigns parts, adds up int64 sums and counts per entry with ``np.add.at``,
and merges these tensors through a reduction tree, so that the driver meets a
few tensors of the size of the codebooks, however many rows there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, staged

# Parameters.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
BLOCK_ROWS = 4096  # vectors whose distances to a codebook are held at once
#: Integers up to here keep every distance and sum within int64; beyond it Python's integers are used.
SAFE = 1 << 22
LARGEST = (1 << 63) - 1

Tensor = tuple[np.ndarray, np.ndarray]  # sums (entries, dimensions), counts (parts, entries)


def bounds(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """First and last dimension of each part; equal parts where ``length`` allows it."""
    return [(length * p // parts, length * (p + 1) // parts) for p in range(parts)]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly; of Python integers where int64 is too narrow."""
    x = x.astype(np.float64)
    if np.abs(x).max(initial=0.0) * SCALE <= SAFE:
        return np.floor(x * SCALE).astype(np.int64)
    flat = [int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return np.array([*flat, None], object)[:-1].reshape(x.shape)


def narrowed(data: np.ndarray) -> tuple[str, bytes]:
    """The kind and bytes of the narrowest integers that hold ``data``."""
    if data.dtype == object:
        return "text", ",".join(map(str, data.ravel())).encode()
    kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(data).max(initial=0) <= np.iinfo(k).max)
    return kind, data.astype(kind).tobytes()


def widened(kind: str, data: bytes, shape: tuple[int, int]) -> np.ndarray:
    if kind == "text":
        return np.array([*map(int, bytes(data).split(b",")), None], object)[:-1].reshape(shape)
    return np.frombuffer(data, kind).astype(np.int64).reshape(shape)


def opened(block) -> np.ndarray:
    """The data of a row of ``blocks_of``: (dimensions, rows)."""
    return widened(block.kind, block.data, (block.length, len(block.ids)))


def assigned(data: np.ndarray, book: np.ndarray, cuts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance, (parts, rows)
    each; of equal ones the first.  Distances grow dimension by dimension."""
    exact = object if object in (data.dtype, book.dtype) else np.int64
    entries, rows = len(book), data.shape[1]
    codes, errors = np.zeros((len(cuts), rows), np.int64), np.zeros((len(cuts), rows), exact)
    for start in range(0, rows, BLOCK_ROWS):
        block = data[:, start : start + BLOCK_ROWS]
        for p, (low, high) in enumerate(cuts):
            distance = np.zeros((entries, block.shape[1]), exact)
            for j in range(low, high):
                distance += (block[j][None, :] - book[:, j, None]) ** 2
            nearest = distance.argmin(axis=0)
            codes[p, start : start + BLOCK_ROWS] = nearest
            errors[p, start : start + BLOCK_ROWS] = distance[nearest, np.arange(block.shape[1])]
    return codes, errors


def tensor(data: np.ndarray, book: np.ndarray, cuts: list[tuple[int, int]]) -> Tensor:
    """Of each entry the sum and the number of the parts that are nearest to it."""
    codes, _ = assigned(data, book, cuts)
    sums, counts = np.zeros(book.shape, data.dtype), np.zeros((len(cuts), len(book)), np.int64)
    for p, (low, high) in enumerate(cuts):
        np.add.at(sums[:, low:high], codes[p], data[low:high].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def moved(book: np.ndarray, found: Tensor, cuts: list[tuple[int, int]]) -> np.ndarray:
    """Each used entry at the componentwise floor of its parts' mean."""
    sums, counts = found
    new = book.astype(sums.dtype) if sums.dtype == object else book.copy()
    for p, (low, high) in enumerate(cuts):
        used = counts[p] > 0
        new[used, low:high] = sums[used, low:high] // counts[p][used, None]
    return new


def first_rows(ids: np.ndarray, data: np.ndarray, most: int) -> list[tuple]:
    """(id, vector) of the ``most`` smallest ids, null ones last and repeated ones
    by vector; an id is a pair whose first part says whether it is null."""
    keys = [(i is None, i or 0) for i in ids]
    if len(keys) > most:
        limit = sorted(keys)[most - 1]
        near = [n for n, k in enumerate(keys) if k <= limit]
    else:
        near = range(len(keys))
    return sorted((keys[n], tuple(int(v) for v in data[:, n])) for n in near)[:most]


def blocks_of(vectors: DataFrame) -> DataFrame:
    """Blocks of the rows that are kept: vectors of one length and Arrow batch each."""
    floats = vectors.schema["embedding"].dataType.elementType.simpleString() in ("float", "double")
    embedding = F.col("embedding") if floats else F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", embedding.alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    kind = vectors.schema["label"].dataType
    schema = T.StructType([
        T.StructField("length", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType()),
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kind)),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes).tolist():
                of = batch.filter(pa.array(sizes == n))
                flat = of.column("embedding").flatten().to_numpy(zero_copy_only=False)
                how, data = narrowed(np.ascontiguousarray(whole_numbers(flat.reshape(of.num_rows, n)).T))
                ends = pa.array([0, of.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64()), pa.array([how]), pa.array([data], pa.binary()),
                     *[pa.ListArray.from_arrays(ends, of.column(c)) for c in ("vec_id", "label")]],
                    ["length", "kind", "data", "ids", "labels"],
                )
        give_back()

    return staged(rows.mapInArrow(pack, schema), "vector-blocks")


def learnt(blocks: DataFrame, parts: int, entries: int, rounds: int) -> dict[int, np.ndarray]:
    """The final codebook of each length of vectors: (entries, dimensions)."""
    held = blocks.select("length", "kind", "data", "ids").rdd

    def first(found: dict, block) -> dict:
        rows = first_rows(block.ids, opened(block), entries)
        return merged(found, {block.length: rows})

    def merged(a: dict, b: dict) -> dict:
        return a | {n: sorted([*a.get(n, ()), *rows])[:entries] for n, rows in b.items()}

    books = {}
    for n, rows in held.treeAggregate({}, first, merged).items():
        values = np.array([*[v for _, row in rows for v in row], None], object)[:-1].reshape(len(rows), n)
        books[n] = narrow(values)
    cuts = {n: bounds(n, parts) for n in books}

    def add(found: dict, block, books) -> dict:
        n = block.length
        return both(found, {n: tensor(opened(block), books.value[n], cuts[n])})

    def both(a: dict, b: dict) -> dict:
        return a | {n: (a[n][0] + t[0], a[n][1] + t[1]) if n in a else t for n, t in b.items()}

    for _ in range(rounds):
        shared = blocks.sparkSession.sparkContext.broadcast(books)
        found = held.treeAggregate({}, partial(add, books=shared), both)
        books = {n: narrow(moved(book, found[n], cuts[n])) for n, book in books.items()}
        shared.unpersist()
    return books


def narrow(values: np.ndarray) -> np.ndarray:
    """int64 where the integers are small enough for it."""
    return values.astype(np.int64) if all(abs(v) <= SAFE for v in values.ravel().tolist()) else values


def digest(book: np.ndarray, cuts: list[tuple[int, int]]) -> str:
    """Of all entries by part, entry and place in the part."""
    numbers = (str(v) for low, high in cuts for row in book[:, low:high].tolist() for v in row)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each kept row.

    Rows whose vector is null or holds null or non-finite components are
    dropped.  Components are finite numbers of any size; an error above int64
    counts as the largest long.  Vectors of each length have codebooks of their
    own (at most ``entries`` vectors of each length are on the driver); a length
    that ``parts`` does not divide has parts as even as can be.  The first
    entries are rows in the order of vec_id (null last) and vector; a table with
    fewer rows has fewer entries.  Repeated rows count each time and are coded
    alike.  Errors are summed per label, null labels together.  An empty table
    gives no rows; other columns are ignored, an absent label counts as null.
    """
    small_batches(vectors.sparkSession)
    if "label" not in vectors.columns:
        vectors = vectors.withColumn("label", F.lit(None).cast("int"))
    blocks = blocks_of(vectors.select("vec_id", "label", "embedding"))
    books = learnt(blocks, parts, entries, rounds)
    cuts = {n: bounds(n, parts) for n in books}
    digests = {n: digest(book, cuts[n]) for n, book in books.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    hexes = np.array([f"{i:02x}" for i in range(max(entries, 1))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                n, kind, data = (batch.column(c)[at].as_py() for c in ("length", "kind", "data"))
                one = batch.slice(at, 1)
                ids, labels = (one.column(c).flatten() for c in ("ids", "labels"))
                codes, errors = assigned(widened(kind, data, (n, len(ids))), shared.value[n], cuts[n])
                texts = ["".join(c) for c in hexes[codes.T].tolist()] if len(ids) else []
                sums = [min(int(e), LARGEST) for e in errors.sum(axis=0)] if len(cuts[n]) else [0] * len(ids)
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(texts, pa.string()), pa.array(sums, pa.int64()), pa.array([digests[n]] * len(ids), pa.string())],
                    ["vec_id", "label", "code", "error", "codebooks_sha256"],
                )
        give_back()

    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("label", vectors.schema["label"].dataType), T.StructField("code", T.StringType()),
        T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType()),
    ])
    coded = staged(blocks.mapInArrow(code, schema), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    # one small row per label; staged, so that Spark broadcasts it only if it is really small, and splits a hot label otherwise
    per_label = staged(coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    return coded.join(per_label, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB: the same rounds as joins of exploded parts with exploded codebooks,
    for vectors whose length ``parts`` divides."""
    steps = [f"""
      v as materialized (
        select row_number() over (order by vec_id, embedding) as row_no, vec_id, label, embedding, len(embedding) // {parts} as width from embeddings
        where embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
      x as materialized (
        select row_no, (place - 1) // width as part, (place - 1) % width as place, floor({SCALE} * embedding[place]::double)::bigint as value
        from (select *, unnest(generate_series(1, len(embedding))) as place from v)),
      book0 as materialized (select part, row_no - 1 as entry, place, value from x where row_no <= {entries})"""]  # fmt: skip
    total = "sum(x.value)::bigint"
    mean = f"(({total} - ({total} % count(*) + count(*)) % count(*)) // count(*))::bigint"  # rounded down
    for i in range(rounds + 1):
        steps.append(f"""
      near{i} as materialized (
        select row_no, part, min({{'distance': distance, 'entry': entry}}) as best from (
          select x.row_no, x.part, b.entry, sum((x.value - b.value) * (x.value - b.value))::bigint as distance
          from x join book{i} b on x.part = b.part and x.place = b.place group by all)
        group by all)""")
        if i < rounds:
            steps.append(f"""
      moved{i} as materialized (
        select x.part, n.best.entry as entry, x.place, {mean} as value
        from x join near{i} n on x.row_no = n.row_no and x.part = n.part group by all),
      book{i + 1} as materialized (
        select part, entry, place, coalesce(m.value, b.value) as value from book{i} b left join moved{i} m using (part, entry, place))""")
    return f"""
    with {",".join(steps)},
    digest as (select sha256(string_agg(value::varchar, ',' order by part, entry, place)) as codebooks_sha256 from book{rounds}),
    coded as (
      select row_no, string_agg(printf('%02x', best.entry), '' order by part) as code, sum(best.distance)::bigint as error from near{rounds} group by row_no)
    select v.vec_id, c.code, c.error, sum(c.error) over (partition by v.label)::bigint as label_error, d.codebooks_sha256
    from v join coded c using (row_no) cross join digest d"""
