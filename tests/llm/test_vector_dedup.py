from __future__ import annotations

import numpy as np
import pytest

from outcomelens.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<float>, kept int"


def brute(rows, threshold=0.9):
    ok = {}
    for k, (i, v, _) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok[k] = np.float32(v).astype(float)
    links = {k: set() for k in range(len(rows))}
    for a, x in ok.items():
        for b, y in ok.items():
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        least = min((rows[n][0] for n in seen if rows[n][0] is not None), default=None)
        out.append((i, len(links[k]), least, i is None or i == least))
    return sorted(out, key=repr)


def vectors(seed, families=25, size=24):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(families):
        centre = r.normal(size=size)
        for _ in range(int(r.integers(1, 8))):
            noise = r.normal(size=size) * r.choice([0, 0.05, 0.25, 0.4])
            rows.append((int(len(rows) * 7 % 1009), [float(np.float32(x)) for x in (centre + noise) * r.choice([0.5, 1, 3])], 1))
    rows += [(2000, rows[0][1], 1), (2001, rows[0][1], 1), (2001, rows[0][1], 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * size, 1), (3003, [float("nan")] + [1.0] * (size - 1), 1)]
    rows += [(3004, [float("inf")] + [1.0] * (size - 1), 1), (3005, [None] + [1.0] * (size - 1), 1), (None, rows[0][1], 1)]
    return rows + [(4000, [1.0, 2.0], 1), (4001, [2.0, 4.1], 1), (4002, [-1.0, -2.0], 1)]


@pytest.mark.parametrize(("seed", "tile"), [(1, V.TILE), (2, 16 * 24), (3, 40 * 24)])
def test_same_links_as_all_pairs(spark, scratch, seed, tile):
    rows = vectors(seed)
    got = V.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), scratch, tile=tile)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty_table(spark, scratch):
    assert V.near_duplicates(spark.createDataFrame([], SCHEMA), scratch).count() == 0


def test_pruned_and_dense_blocks_agree_with_the_full_product():
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 64))
    x = np.repeat(base, 10, axis=0) + r.normal(size=(400, 64)) * 0.3
    tile = V.Tile(x, V.rotation(x[:100]))
    whole = tile.unit @ tile.unit.T
    for dense in (0.0, 1.0):
        a, b = V.linked(tile, tile, slice(0, 400), 0.9, dense)
        assert sorted(zip(a, b, strict=True)) == sorted(zip(*np.nonzero(whole >= 0.9), strict=True))
