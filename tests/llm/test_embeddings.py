import numpy as np
import pytest

from strata.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok = {}
    for i, (_, v, label) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = x
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return sorted((rows[i][0], links[i], rows[root(i)][0], rows[i][0] == rows[root(i)][0]) for i in range(len(rows)))


def sample(seed, n=160):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=8) * rng.choice([1e-3, 1, 1e3]) if i % 4 == 0 else np.array(rows[-1][1]) + rng.normal(size=8) * 0.09 * np.abs(rows[-1][1]).max() * rng.choice([0, 1])
        rows.append((i * 3 + 1, [float(np.float32(c)) for c in x], int(i % 16 < 8)))
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_links(spark, block):
    rows = sample(block) + [(1001, None, 1), (1002, [0.0] * 8, 1), (1003, [float("nan")] * 8, 1), (1004, [None] * 8, 1), (1005, [1.0] * 8, None), (1006, [float("inf")] + [1.0] * 7, 1), (1007, [], 1), (1008, [1.0, 2.0], 1), (1009, [0.0, 0.0], None)]
    rows += [(2000 + i, [1.0, 2.0, 0.0, -0.0, 3.0, 0.0, 0.0, 0.0], 5) for i in range(40)]
    got = e.link_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 24)) * rng.choice([1, 30], size=(200, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.05
    y /= np.linalg.norm(y, axis=1)[:, None]
    for t in (0.9, 0.97, 0.98, 0.99):
        found = set(zip(*map(np.ndarray.tolist, e.candidates(x, y, t)), strict=True))
        true = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ y.T >= t)), strict=True))
        assert true <= found and len(found) < 0.01 * len(x) * len(y)


def test_empty(spark):
    assert e.link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold_for_long_vectors():
    """Beyond 1,040 components integer products pass what float32 holds; pairs lie on the threshold."""
    rng = np.random.default_rng(3)
    x = rng.choice([-1.0, 1.0], size=(60, 4096)) * rng.uniform(0.95, 1, size=(60, 4096))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.0032
    y /= np.linalg.norm(y, axis=1)[:, None]
    true = np.einsum("ij,ij->i", x, y)
    cx, sx, ex, lx = e.quantise(x)
    cy, sy, ey, ly = e.quantise(y)
    exact = (cx.astype(np.int64) * cy).sum(axis=1)
    assert exact.max() > 1 << 24
    assert (np.abs(exact * sx * sy - true) <= lx * ey + ex * ly + ex * ey + e.SLACK).all()
    for i, t in enumerate(true.tolist()):  # each pair at its own cosine as the threshold
        assert len(e.candidates(x[i : i + 1], y[i : i + 1], t)[0]) == 1


def test_vectors_near_the_ends_of_doubles(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [2e-300, 2e-300], 1), (3, [1e300, -1e300], 1), (4, [5e-324, 0.0], 1), (5, [1.0, 1e-9], 1)]
    got = e.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]


@pytest.mark.parametrize(("blocks", "numbers", "products"), [(2, 1 << 22, 1 << 21), (16, 200, 64), (3, 1 << 22, 700)])
def test_blocks_of_any_size(spark, blocks, numbers, products, monkeypatch):
    for name, value in (("BLOCKS", blocks), ("NUMBERS", numbers), ("PRODUCTS", products)):
        monkeypatch.setattr(e, name, value)
    rows = sample(5, 200)
    assert sorted(map(tuple, e.link_vectors(spark.createDataFrame(rows, SCHEMA), block=4).collect())) == brute(rows)
