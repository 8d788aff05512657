"""Lattice duplicates against all pairs."""

import numpy as np

from vqspark.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, node long, w int"


def force(rows, threshold=0.95):
    """n_links and component of each row, by all pairs in double precision."""
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: [] for i in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(np.float32(rows[k][1]), np.float64) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((d, len(links[i]), min((rows[j][0] for j in seen), default=None) if d is not None else None))
    return sorted(out, key=str)


def vectors(n=250, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 5))):
            other = rng.normal(size=dim)
            rows.append((len(rows) * 13 % 1009, (base / np.linalg.norm(base) + rng.uniform(0, 0.25) * other / np.linalg.norm(other)).tolist()))
    return rows


def run(spark, rows):
    frame = spark.createDataFrame([(d, v, 0, 1, 2) for d, v in rows], SCHEMA)
    found = lattice.lattice_duplicates(frame).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str)


def test_against_force(spark):
    rows = vectors()
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2002, [x * 3 for x in rows[5][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [float("nan")] + [1.0] * 63), (3004, [None] + [1.0] * 63), (3005, [float("inf")] + [0.0] * 63)]
    rows += [(None, rows[0][1]), (3006, [1.0, 0.0]), (3007, [2.0, 0.01]), rows[7], rows[7]]
    assert run(spark, rows) == force(rows)


def test_crowded_cell_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    rows = [(i, (base + rng.normal(size=64) * 0.12).tolist()) for i in range(120)]
    assert run(spark, rows) == force(rows)


def test_empty(spark):
    assert lattice.lattice_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoding_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (500, 8))
    point = lattice.decode(x)
    own = ((x - point) ** 2).sum(1)
    beside = (((x - point)[:, None] - lattice.shortest()) ** 2).sum(2)
    assert (own[:, None] <= beside + 1e-9).all()
    assert len(lattice.shortest()) == 240
    assert (point % 1 == point[:, :1] % 1).all() and (point.sum(axis=1) % 2 == 0).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = lattice.unit_rows(rng.normal(size=(4000, 64)))
    z = rng.normal(size=x.shape)
    z = lattice.unit_rows(z - (z * x).sum(1)[:, None] * x)
    kx, ky = lattice.keys_of(x), lattice.keys_of(0.95 * x + np.sqrt(1 - 0.95**2) * z)
    met = (kx[..., :1] == ky).any(-1) | (ky[..., :1] == kx).any(-1)
    assert met.any(1).mean() > 0.99
