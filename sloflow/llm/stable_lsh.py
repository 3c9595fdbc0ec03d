"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised in double precision; a cosine of at least ``cosine`` is then a distance of at most
``sqrt(2 - 2 * cosine)``.  A table hashes a vector by ``k`` projections on Gaussian directions, shifted and
cut into cells of one width; vectors with equal cells in any of the tables are compared exactly.  Width,
``k`` and the number of tables follow from the number of vectors and the share of links that may be missed
at the threshold itself; closer pairs are missed less.  Equal vectors are one class with a count, so copies
cost nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.buckets import by_bucket, dealt, whole_buckets
from sloflow.llm.common import written
from sloflow.llm.components import connected, roots, unite

COSINE = 0.93
#: Share of the links exactly at the threshold that the tables may miss together.
MISSED = 0.003
#: Unrelated vectors that may share a cell with a vector in one table.
STRANGERS = 200
_BLOCK = 1024


def collision(distance: float, width: float) -> float:
    """Chance that one projection puts two vectors at ``distance`` into one cell."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float = COSINE, missed: float = MISSED) -> tuple[float, int, int]:
    """(width, k, tables) with the fewest tables for ``n`` vectors that may be near each other."""
    near, far = math.sqrt(2 - 2 * min(cosine, 0.999)), math.sqrt(2)
    best = (0.0, 0, 1 << 30)
    for width in (near * x for x in (2, 3, 4, 5, 6, 8, 10)):
        k = max(1, math.ceil(math.log(max(n / STRANGERS, 1.0001)) / -math.log(collision(far, width))))
        found = collision(near, width) ** k
        tables = max(1, math.ceil(math.log(missed) / math.log1p(-found)))
        if tables < best[2]:
            best = (width, k, tables)
    return best


def _directions(width: float, k: int, tables: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, k, tables, size])
    return rng.standard_normal((size, tables * k)), rng.uniform(0, width, tables * k)


def _usable(name: str):
    """Not null, without null or non-finite components, and not zero."""
    x = F.col(name)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col("label").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0)


def cells(vectors: DataFrame, width: float, k: int, tables: int, seed: int = 7) -> DataFrame:
    """One row per vector and table: label, lsh_table, cell, and class_id, n, embedding and all cells.

    ``vectors`` has class_id, label, n, embedding (array of double).  A cell key is a hash of the cell's
    ``k`` coordinates: two cells with one key only cost needless comparisons.
    """
    schema = pa.schema(
        [
            ("label", pa.int64()), ("lsh_table", pa.int32()), ("cell", pa.int64()), ("class_id", pa.int64()), ("n", pa.int64()),
            ("unit", pa.binary()), ("cells", pa.binary()),
        ]
    )
    ddl = "label long, lsh_table int, cell long, class_id long, n long, unit binary, cells binary"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = np.random.default_rng(seed + 1).integers(1, 1 << 62, k, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for batch in batches:
            rows = batch.column(3).to_pylist()
            for size in sorted({len(r) for r in rows}):
                chosen = [i for i, r in enumerate(rows) if len(r) == size]
                own = batch.take(pa.array(chosen))
                x = np.array([rows[i] for i in chosen], np.float64)
                # Divided by the largest component first: squares neither overflow nor vanish.
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                direction, shift = _directions(width, k, tables, size, seed)
                coordinate = np.floor((x @ direction + shift) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
                key = np.zeros((len(x), tables), np.uint64)
                for i in range(k):
                    key = (key ^ (coordinate[:, :, i] * mix[i])) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                key = (key + np.uint64(size)).view(np.int64)
                units, keys = [r.tobytes() for r in x], [r.tobytes() for r in key]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.column(1), pa.array(np.full(len(x), t, np.int32)), pa.array(key[:, t]), own.column(0), own.column(2),
                            pa.array(units, pa.binary()), pa.array(keys, pa.binary()),
                        ],
                        schema=schema,
                    )

    return vectors.select("class_id", "label", "n", "embedding").mapInArrow(hashed, ddl)


def near(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per class and bucket with links: class_id, n_links (vectors linked in this bucket and in no earlier
    table) and root, a class of the same set."""
    rows = dealt(rows, ["label", "lsh_table", "cell"], F.xxhash64("class_id"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_buckets(batches, ["label", "lsh_table", "cell", "of_a", "of_b"]):
            ids, counts, own = (table.column(c).to_numpy() for c in ("class_id", "n", "own"))
            units, keys = table.column("unit"), table.column("cells")
            stops = np.append(starts[1:], table.num_rows)
            out_id, out_n, out_root = [], [], []
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                if b - a < 2:
                    continue
                number = table.column("lsh_table")[a].as_py()
                mixed = table.column("of_a")[a].as_py() != table.column("of_b")[a].as_py()
                x = np.frombuffer(b"".join(units.slice(a, b - a).to_pylist()), np.float64).reshape(b - a, -1)
                cell = np.frombuffer(b"".join(keys.slice(a, b - a).to_pylist()), np.int64).reshape(b - a, -1)
                parent, found = np.arange(b - a), np.zeros(b - a, np.int64)
                n = counts[a:b]
                for i in range(0, b - a, _BLOCK):
                    for j in range(i, b - a, _BLOCK):
                        p, q = np.nonzero(x[i : i + _BLOCK] @ x[j : j + _BLOCK].T >= cosine - 1e-9)
                        p, q = p + i, q + j
                        right = p < q
                        if mixed:
                            right &= own[a + p] != own[a + q]
                        p, q = p[right], q[right]
                        # The stated threshold, on the sums that a plain loop would use.
                        exact = np.einsum("ij,ij->i", x[p], x[q]) >= cosine if len(p) else np.zeros(0, bool)
                        p, q = p[exact], q[exact]
                        unite(parent, p, q)
                        new = ~(cell[p, :number] == cell[q, :number]).any(1) if number else np.ones(len(p), bool)
                        np.add.at(found, p[new], n[q[new]])
                        np.add.at(found, q[new], n[p[new]])
                root = roots(parent, np.arange(b - a))
                said = np.flatnonzero((found > 0) | (root != np.arange(b - a)))
                out_id.append(ids[a:b][said])
                out_n.append(found[said])
                out_root.append(ids[a:b][root[said]])
            if out_id:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_id, out_n, out_root)], names=["class_id", "n_links", "root"])

    keys = ["label", "lsh_table", "cell", "of_a", "of_b"]
    return by_bucket(rows, keys, [], compared, "class_id long, n_links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, missed: float = MISSED) -> DataFrame:
    """Per row of ``vectors`` (vec_id long, label, embedding array of numbers): vec_id, n_links, component_id, kept.

    Vectors are compared where labels are equal and not null, and sizes are equal.  A vector that is null,
    empty, zero or has null or non-finite components links with nothing: n_links 0, component_id its own
    id.  n_links counts other rows at ``cosine`` or more, equal vectors and repeated rows included.  A row
    without vec_id takes part; component_id is the smallest id there is in its component, else null.
    """
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    usable = F.coalesce(_usable("embedding"), F.lit(False))
    classes = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = written(classes.withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width, k, tables = parameters(largest, cosine, missed)
    found = written(near(cells(classes, width, k, tables), cosine), "near-vectors")
    joined = connected(found.select(F.col("class_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class_id")
    linked = found.groupBy("class_id").agg(F.sum("n_links").alias("others"))
    known = (
        classes.join(linked, "class_id", "left")
        .join(joined, "class_id", "left")
        .select(
            "label", "embedding", "least", F.coalesce("root", "class_id").alias("root"),
            (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        )
    )
    known = written(known, "known-vectors")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "root").select("label", "embedding", "n_links", "component_id")
    # The vector itself is the key: rows without a usable one find no class.
    lone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rest = rows.where(usable).join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    return rest.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
