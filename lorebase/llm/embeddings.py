"""Embedding near-duplicates by product quantisation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, materialize, shuffle_partitions

#: There are as many coarse lists as a list has vectors, MOST_LISTS at most (from
#: some 268 million vectors on lists grow instead; they are compared in blocks).
MOST_LISTS = 16_384
#: Vectors that the quantisers are fitted on, at most (the lowest by hash): so
#: many, or so many per list if that is more.
SAMPLE, SAMPLE_PER_LIST = 20_000, 8
#: Subspaces, and codes in each.
PARTS, CODES = 8, 64
#: Most index vectors that one task compares with at a time.
BLOCK = 2048
#: Standard deviations of a random direction that probing allows for.
SURE = 2.5
#: Vectors (with their copies as queries) that one task gets on average.
PER_TASK = 200_000
#: Slack for rounding in distances that only select candidates.
SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of a Lloyd run from distinct random rows; an empty cluster keeps its centre."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in blocks of rows."""
    step, squares = max(1, (1 << 23) // len(centres)), (centres**2).sum(1)
    return np.concatenate([np.argmin(squares - 2 * x[a : a + step] @ centres.T, axis=1) for a in range(0, len(x), step)])


class Quantiser:
    """Coarse centres, and codebooks for the subspaces of what they leave."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = kmeans(sample, min(lists, len(sample)))
        left = sample - self.centres[self.home(sample)]
        edges = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.parts = list(zip(edges[:-1], edges[1:], strict=True))
        self.books = [kmeans(np.ascontiguousarray(left[:, a:b]), min(CODES, len(left)), seed=11 + a) for a, b in self.parts]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared, to every centre."""
        return np.maximum((x**2).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0)

    def home(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centres)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how far each vector lies from what its code stands for."""
        left = x - self.centres[home]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        far = np.zeros(len(x))
        for i, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            part = left[:, a:b]
            codes[:, i] = np.argmin((book**2).sum(1) - 2 * part @ book.T, axis=1)
            far += ((part - book[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(far)

    def probes(self, x: np.ndarray, home: np.ndarray, radius: float) -> np.ndarray:
        """Whether list c may hold a vector within ``radius`` of x.

        A vector y of list c is no farther from c's centre than from the home
        centre h of x. The difference of the two squared distances changes by
        2 |c - h| per unit of length along c - h, so at x it is at most
        2 |c - h| radius. In many dimensions y - x lies across c - h: its part
        along it exceeds SURE / sqrt(dimensions) of its length for some 6 in
        1000 random directions, and the bound is taken at that part. (Both ends
        of a pair probe, but only the one in the earlier list is used.)
        """
        d, squares = self.distances(x), (self.centres**2).sum(1)
        gaps = np.sqrt(np.maximum(squares[home][:, None] + squares - 2 * self.centres[home] @ self.centres.T, 0))
        part = min(1.0, SURE / math.sqrt(x.shape[1]))
        return d - d[np.arange(len(x)), home][:, None] <= 2 * radius * part * gaps + SLACK

    def asymmetric(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Distances from whole queries to coded vectors of a list, by table lookup."""
        left = queries - self.centres[list_]
        total = np.zeros((len(queries), len(codes)))
        for i, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            part = left[:, a:b]
            table = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


def _classes(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The rows with their vector as bytes (null if it links with nothing), and
    one row per distinct vector: _cls, _bytes, _n, _rep; and the bytes of a component."""
    narrow = dict(vectors.dtypes)[vector_col] == "array<float>"  # kept in four bytes, which are exact
    kind = F.col(vector_col).cast("array<float>" if narrow else "array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            out = []
            for a, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                x = flat[a:e]
                largest = float(np.abs(x).max()) if len(x) and np.isfinite(x).all() else 0.0
                if not narrow and largest and not 1e-100 < largest < 1e100:  # by a power of two, so that squares are in range
                    x = np.ldexp(x, -math.frexp(largest)[1])
                out.append((x + 0.0).astype("<f4" if narrow else "<f8").tobytes() if largest else None)  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["_id", "_bytes"])

    import pyarrow.compute  # noqa: F401

    kept = vectors.select(F.col(id_col).alias("_id"), kind.alias("_v"))
    rows = materialize(kept.mapInArrow(run, f"_id {dict(kept.dtypes)['_id']}, _bytes binary"), "pq-rows")
    classes = rows.where("_bytes is not null").groupBy("_bytes").agg(F.count("*").alias("_n"), F.min("_id").alias("_rep"))
    return rows, materialize(classes.withColumn("_cls", F.monotonically_increasing_id()), "pq-classes"), 4 if narrow else 8


def _unit(column: pa.Array, size: int, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), f"<f{width}").astype(np.float64).reshape(-1, size)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _links_of_size(classes: DataFrame, size: int, width: int, least: float, spark) -> DataFrame:
    """(cls, n, other): n more linked vectors for class cls; where other is set, a link of the forest."""
    n = classes.count()
    wanted = max(1, min(MOST_LISTS, math.ceil(math.sqrt(n))))
    sample = classes.orderBy(F.xxhash64("_bytes"), "_bytes").limit(max(SAMPLE, SAMPLE_PER_LIST * wanted)).select("_bytes").toArrow().column(0).combine_chunks()
    quantiser = Quantiser(_unit(sample, size, width), wanted)
    radius = math.sqrt(2 - 2 * least)
    lists = len(quantiser.centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                b = whole.slice(low, 4096)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(quantiser.home(_unit(b.column(2), size, width)).astype(np.int32))], names=["cls", "n", "bytes", "home"])

    placed = materialize(classes.select(F.col("_cls").alias("cls"), F.col("_n").alias("n"), F.col("_bytes").alias("bytes")).mapInArrow(place, "cls long, n long, bytes binary, home int"), "pq-lists")
    blocks = np.ones(lists, np.int64)
    for r in placed.groupBy("home").count().collect():  # MOST_LISTS numbers at most
        blocks[r["home"]] = -(-r["count"] // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its own cell's index, and as a query to the later cells
        of its list and to all cells of the later lists that it must probe."""
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                b = whole.slice(low, 1024)
                cls, home = b.column(0).to_numpy(), b.column(3).to_numpy()
                x = _unit(b.column(2), size, width)
                codes, far = quantiser.encode(x, home)
                own = first[home] + (cls ^ (cls >> 33)) % blocks[home]
                probe = quantiser.probes(x, home, radius)
                probe[np.arange(lists)[None] <= home[:, None]] = False
                row, cell, role = [np.arange(len(cls))], [own], [np.zeros(len(cls), np.int8)]
                for i in range(len(cls)):
                    more = [np.arange(own[i] + 1, first[home[i] + 1])] + [np.arange(first[c], first[c + 1]) for c in np.nonzero(probe[i])[0]]
                    more = np.concatenate(more)
                    row.append(np.full(len(more), i))
                    cell.append(more)
                    role.append(np.ones(len(more), np.int8))
                row, cell, role = np.concatenate(row), np.concatenate(cell), np.concatenate(role)
                for at in range(0, len(row), 8192):
                    r = row[at : at + 8192]
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell[at : at + 8192]), pa.array(role[at : at + 8192]), b.column(0).take(take), b.column(1).take(take), b.column(2).take(take),
                            pa.array([c.tobytes() for c in codes[r]], pa.binary()), pa.array(far[r]),
                        ],
                        names=["cell", "role", "cls", "n", "bytes", "code", "far"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = parent[x]
            return x

        def read(b: pa.RecordBatch):
            return b.column(2).to_numpy(), b.column(3).to_numpy(), _unit(b.column(4), size, width), np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(b.num_rows, -1), b.column(6).to_numpy()

        def links(query, index, list_: int, inner: bool):
            q_cls, q_n, q_x, *_ = query
            i_cls, i_n, i_x, i_code, i_far = index
            q_links, i_links, forest = np.zeros(len(q_cls), np.int64), np.zeros(len(i_cls), np.int64), []
            for at in range(0, len(q_cls), 256):
                x = q_x[at : at + 256]
                near = quantiser.asymmetric(x, list_, i_code) <= radius + i_far + SLACK
                if inner:  # each pair once
                    near &= np.arange(len(i_cls))[None] > np.arange(at, at + len(x))[:, None]
                a, c = np.nonzero(near)
                hit = np.zeros(len(a), bool)
                for k in range(0, len(a), 65536):
                    hit[k : k + 65536] = (x[a[k : k + 65536]] * i_x[c[k : k + 65536]]).sum(1) >= least
                a, c = a[hit] + at, c[hit]
                np.add.at(q_links, a, i_n[c])
                np.add.at(i_links, c, q_n[a])
                for u, v in zip(q_cls[a].tolist(), i_cls[c].tolist(), strict=True):
                    if (ru := root(u)) != (rv := root(v)):
                        parent[max(ru, rv)] = min(ru, rv)
                        forest.append((u, v))
            return q_links, i_links, forest

        def out(cls, n, forest) -> pa.RecordBatch:
            some = n > 0
            u, v = [x for x, _ in forest], [y for _, y in forest]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([cls[some], np.array(u, np.int64)])), pa.array(np.concatenate([n[some], np.zeros(len(u), np.int64)])), pa.array([None] * int(some.sum()) + v, pa.int64())],
                names=["cls", "n", "other"],
            )

        cell, held, index = None, [], None
        for whole in batches:
            cells, roles = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            starts = np.concatenate([[0], np.nonzero((np.diff(cells) != 0) | (np.diff(roles) != 0))[0] + 1, [whole.num_rows]])
            for a, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if a == e:
                    continue
                if cells[a] != cell or roles[a] == 1:
                    if held:  # the index of a cell is complete
                        parts = [read(h) for h in held]
                        index, held = tuple(np.concatenate(p) for p in zip(*parts, strict=True)), []
                        list_ = int(np.searchsorted(first, cell, "right")) - 1
                        ql, il, forest = links(index, index, list_, True)
                        yield out(index[0], ql + il, forest)
                    if cells[a] != cell:
                        cell, index = int(cells[a]), None
                if roles[a] == 0:
                    held.append(whole.slice(a, e - a))
                elif index is not None:
                    query = read(whole.slice(a, e - a))
                    ql, il, forest = links(query, index, int(np.searchsorted(first, cell, "right")) - 1, False)
                    yield out(np.concatenate([query[0], index[0]]), np.concatenate([ql, il]), forest)
        if held:
            parts = [read(h) for h in held]
            index = tuple(np.concatenate(p) for p in zip(*parts, strict=True))
            ql, il, forest = links(index, index, int(np.searchsorted(first, cell, "right")) - 1, True)
            yield out(index[0], ql + il, forest)

    dealt = placed.mapInArrow(deal, "cell long, role byte, cls long, n long, bytes binary, code binary, far double")
    dealt = dealt.repartition(max(shuffle_partitions(spark), math.ceil(n / PER_TASK)), "cell").sortWithinPartitions("cell", "role")
    return dealt.mapInArrow(compare, "cls long, n long, other long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of ``vectors``.

    Links join vectors of one length whose cosine is ``least`` or more. Copies
    are one class that counts all its rows. Coarse lists come from k-means on a
    bounded sample; every vector is then indexed in its nearest list by the
    subspace codes of its residual, and probes all lists that may hold a vector
    near enough (``Quantiser.probes``: exact up to 6 dimensions; measured recall
    against brute force on 64 dimensions is 1). Candidates are those whose
    distance by table lookup is within the radius plus the stored error of their
    code, which loses none; their exact cosine decides. Lists are cut into
    blocks, so no task holds more than BLOCK index vectors, and tasks return
    counts and a spanning forest, not pairs.

    Null and zero vectors and those with null or non-finite components link with
    nothing: 0 links, their own id, kept. Null ids take part; a component without
    any id has a null one and such a row is not kept. Repeated rows count as
    links of one another; columns of any other name may be there; vectors of any
    finite magnitude are compared. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows, classes, width = _classes(vectors, id_col, vector_col)
    found = [
        _links_of_size(classes.where(F.length("_bytes") == r[0]), r[0] // width, width, least, spark)
        for r in classes.select(F.length("_bytes").alias("b")).distinct().orderBy("b").collect()  # lengths of vectors
    ]
    if not found:
        return rows.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"), F.col("_id").isNotNull().alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = materialize(links, "pq-links")
    counts = links.groupBy(F.col("cls").alias("_c")).agg(F.sum("n").alias("_links"))
    comps = connected_components(links.where("other is not null").select(F.col("cls").alias("u"), F.col("other").alias("v")), "pq-cc")
    j = classes.join(counts, F.col("_cls") == F.col("_c"), "left").join(comps, F.col("_cls") == F.col("id"), "left")
    j = j.select("_bytes", "_rep", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"), F.coalesce("component", "_cls").alias("_k"))
    names = j.groupBy(F.col("_k").alias("_m")).agg(F.min("_rep").alias("_name"))
    named = j.join(names, F.col("_k") == F.col("_m")).select(F.col("_bytes").alias("_b"), "_links", "_name")
    out = rows.join(named, F.col("_bytes") == F.col("_b"), "left")
    component = F.when(F.col("_b").isNull(), F.col("_id")).otherwise(F.col("_name")).cast("long")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), n AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
), u AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND isfinite(a.norm) AND isfinite(b.norm) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT c.vec_id, (SELECT count(*) FROM u WHERE u.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
