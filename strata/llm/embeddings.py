"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Vectors of a label are dealt into blocks; each pair of blocks is one tile and one task. In a
tile the unit vectors are quantised to int8, and integer products plus the vectors' own
quantisation errors bound every cosine from above. Only pairs whose bound reaches the
threshold are computed again in double precision. A tile returns link counts and a spanning
forest of its links, never the links themselves, so its output grows with its vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize
from strata.llm.components import connected_components

THRESHOLD = 0.98
#: Vectors in a block, about, of labels that make up to BLOCKS blocks of them. Of larger labels blocks grow, so that a vector
#: is sent to no more tiles, up to LARGEST vectors and NUMBERS components; a tile holds two blocks.
BLOCK, BLOCKS, LARGEST, NUMBERS = 2048, 16, 1 << 14, 1 << 22
#: Bounds that are computed at a time.
PRODUCTS = 1 << 21
#: Room for the rounding of the bound itself.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors -> int8 codes, scales, errors |x - scale * code| and lengths |scale * code|."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(unit - back, axis=1), np.linalg.norm(back, axis=1)


def candidates(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row of x, row of y) whose cosine may reach ``threshold``; rows are unit vectors.

    With x = a + e and y = b + d, a and b the quantised vectors:
    x.y - a.b = a.d + e.b + e.d, so |x.y - a.b| <= |a||d| + |e||b| + |e||d|.
    """
    cx, sx, ex, lx = quantise(x)
    cy, sy, ey, ly = quantise(y)
    # float32 holds sums of int8 products exactly up to 2**24, so long vectors are cut, and the parts added in double
    step = (1 << 24) // (127 * 127)
    dots = np.zeros((len(x), len(y)))
    for k in range(0, x.shape[1], step):
        dots += cx[:, k : k + step].astype(np.float32) @ cy[:, k : k + step].astype(np.float32).T
    bound = dots * sx[:, None] * sy[None, :] + np.outer(lx, ey) + np.outer(ex, ly) + np.outer(ex, ey)
    return np.nonzero(bound >= threshold - SLACK)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def _tile(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        own = group["own"].to_numpy()
        ids, size = group["rep"].to_numpy(), group["n"].to_numpy()
        lists = group["embedding"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(lengths) - lengths
        links = np.zeros(len(ids), np.int64)
        parent = np.arange(len(ids))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        edges: list[tuple[int, int]] = []
        for dim in np.unique(lengths):  # vectors of unequal lengths have no cosine
            rows = np.flatnonzero(lengths == dim)
            full = flat[starts[rows][:, None] + np.arange(dim)]
            # by powers of two, which change no bit of a cosine, so that no square leaves the range of doubles
            full = np.ldexp(full, -np.frexp(np.abs(full).max(axis=1))[1][:, None])
            unit = full / np.linalg.norm(full, axis=1)[:, None]
            left = np.flatnonzero(own[rows])
            right = np.flatnonzero(~own[rows]) if not own.all() else left
            step = max(16, min(512, PRODUCTS // max(1, len(right))))
            for at in range(0, len(left), step):
                part = left[at : at + step]
                i, j = candidates(unit[part], unit[right], threshold)
                i, j = part[i], right[j]
                if right is left:
                    i, j = i[i < j], j[i < j]
                hit = np.zeros(len(i), bool)
                for k in range(0, len(i), 1 << 16):
                    hit[k : k + (1 << 16)] = cosines(full[i[k : k + (1 << 16)]], full[j[k : k + (1 << 16)]]) >= threshold
                i, j = rows[i[hit]], rows[j[hit]]
                np.add.at(links, i, size[j])
                np.add.at(links, j, size[i])
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if parent[a] != parent[b] and (ra := root(a)) != (rb := root(b)):
                        parent[max(ra, rb)] = min(ra, rb)
                        edges.append((int(ids[a]), int(ids[b])))
        some = np.flatnonzero(links)
        u = [int(ids[k]) for k in some] + [a for a, _ in edges]
        v = [None] * len(some) + [b for _, b in edges]
        n = links[some].tolist() + [0] * len(edges)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(vec_id, embedding, label)`` -> ``(vec_id, n_links, component_id, kept)``, one row per row.

    Vectors are compared if their labels are equal and not null. Null and empty vectors, zero
    vectors and those with null or non-finite components link with nothing and are their own
    component. Equal vectors of a label are compared as one and count as often as they occur.
    Blocks hold about ``block`` vectors, or more where a label would make very many of them; the number of
    tiles of a label grows with the square of its blocks, as any exact comparison of all pairs does.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("label"))
    number = vectors.schema["embedding"].dataType.elementType.simpleString()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = rows.where("usable").select("vec_id", "label", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(number)).otherwise(x)).alias("embedding"))
    classes = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")
    n = F.count(F.lit(1))
    size = F.greatest(F.least(F.greatest(n / BLOCKS, F.lit(block)), F.lit(LARGEST), F.lit(NUMBERS) / F.max(F.size("embedding"))), F.lit(16))
    blocks = materialize(classes.groupBy("label").agg(F.ceil(n / size).cast("long").alias("blocks")), "blocks")
    dealt = classes.join(blocks, "label").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = met.select("rep", "n", "embedding", "label", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.col("i") <= F.col("j")).alias("own"))
    found = materialize(tiles.groupBy("label", "i", "j").applyInArrow(_tile(threshold), "u long, v long, n long"), "found")
    reached = connected_components(found.where("v is not null").select("u", "v"))
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    of_class = materialize(
        classes.select("label", "embedding", "rep", "n")
        .join(counts, "rep", "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")),
        "classes",
    )
    joined = good.join(of_class, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
