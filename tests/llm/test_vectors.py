import numpy as np

from inquest.llm import vector_dedup as vd
from tests.llm.test_near import union_find


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows):
    units = {}
    for i, v, _ in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(np.array(v, np.float32), np.float64)
            units[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in units for b in units if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9]
    n = {i: 0 for i, *_ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    groups = union_find(links, n)
    return {i: (n[i], groups[i], groups[i] == i) for i in n}


def make(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=dim) * rng.choice([0.02, 0.15, 1.5]))], i % 3) for i in range(n)]


def test_as_brute_force(spark, monkeypatch):
    for block in (512, 16):
        monkeypatch.setattr(vd, "BLOCK", block)
        rows = make(400) + [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] * 4, 1), (903, [float("nan")] * 8, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], None), (906, [], 0)]
        rows += [(1000 + i, rows[5][1], 0) for i in range(30)]
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vd.membership(table(spark, rows)).collect()}
        want = brute(rows)
        found, all_ = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
        assert found >= 0.99 * all_ and all(got[i][0] <= want[i][0] for i in want)
        assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)
        assert {i: got[i] for i in range(900, 907)} == {i: want[i] for i in range(900, 907)}


def test_recall_on_random_directions(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(600)]
    got = {r.vec_id: r.n_links for r in vd.membership(table(spark, rows)).collect()}
    want = brute(rows)
    assert sum(got.values()) >= 0.9 * sum(x[0] for x in want.values())


def test_empty_and_null_tables(spark):
    assert vd.membership(table(spark, make(3)).limit(0)).count() == 0
    got = vd.membership(table(spark, [(1, None, 0), (None, [1.0, 0.0], 1)])).collect()
    assert sorted(map(str, [(r.vec_id, r.n_links, r.component_id) for r in got])) == sorted(map(str, [(1, 0, 1), (None, 0, None)]))


def test_traversal_visits_nearest_cells_first():
    x = np.random.default_rng(3).normal(size=(200, 6))
    index = vd.MultiIndex(x, 16 * 25)
    a, b = index.halves(x[:20])
    total = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    for cells in (1, 3, 7, 16):
        got = np.take_along_axis(total, index.visits(x[:20], cells), 1)
        assert np.allclose(got, np.sort(total, 1)[:, :cells])
    assert (index.place(x[:20], index.home(x[:20])) == 0).all()


def test_rare_links_are_all_found(spark, monkeypatch):
    # as few links and as many cells as a large table has for 1,024 vectors
    monkeypatch.setattr(vd, "PROBES_TRIED", 8)
    monkeypatch.setattr(vd, "CELL", 1)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(80):  # pairs at cosines of 0.9 to 0.95
        side = rng.normal(size=32)
        side -= (side @ x[i]) * x[i]
        c = 0.9005 + 0.05 * i / 80
        x[1000 + i] = c * x[i] + (1 - c * c) ** 0.5 * side / np.linalg.norm(side)
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vd.membership(table(spark, rows)).collect()}
    want = brute(rows)
    assert sum(n for n, *_ in want.values()) >= 160
    assert got == want


def test_cells_rest_on_enough_links(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(vd, "needed_visits", lambda *a, f=vd.needed_visits: asked.append(f(*a)) or asked[-1])
    rows = make(1500, dim=16)
    want = brute(rows)
    for probes, linked in ((1024, 300), (16, 100)):  # too few vectors to measure with; several rounds
        monkeypatch.setattr(vd, "PROBES_TRIED", probes)
        monkeypatch.setattr(vd, "LINKED", linked)
        got = {r.vec_id: r.n_links for r in vd.membership(table(spark, rows)).collect()}
        assert sum(got.values()) >= 0.99 * sum(x[0] for x in want.values())
    assert asked[0] is None and asked[1] >= vd.FLOOR


def test_string_ids_and_other_columns(spark):
    rows = make(300)
    want = brute(rows)
    docs = spark.createDataFrame([(f"v{i:04d}", v, 1, 2) for i, v, _ in rows], "vec_id string, embedding array<float>, n_links int, unit int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vd.membership(docs).collect()}
    assert got == {f"v{i:04d}": (n, f"v{c:04d}") for i, (n, c, _) in want.items()}


def test_made_neighbours_measure_recall_where_links_are_rare(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(300, 16))
    side -= (side * x[:300]).sum(1)[:, None] * x[:300]
    x[2000:2300] = 0.93 * x[:300] + (1 - 0.93**2) ** 0.5 * side / np.linalg.norm(side, axis=1)[:, None]
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(x)]
    cells = []
    for name, value in (("MOST_PROBES", 0), ("CELL", 4)):
        monkeypatch.setattr(vd, name, value)
    monkeypatch.setattr(vd, "needed_visits", lambda *a, f=vd.needed_visits: cells.append(f(*a)) or cells[-1])
    out = {r.vec_id: r.n_links for r in vd.link_vectors(table(spark, rows), recall=0.99).collect()}
    want = brute(rows)
    assert cells[0] is not None and cells[0] * 4 < 4000  # not all with all
    assert sum(out.values()) >= 0.97 * sum(n for n, *_ in want.values()) and all(out[i] <= want[i][0] for i in want)
    index = vd.MultiIndex(x, 4000)
    assert vd.made_neighbours(index, x[:500], 0.9).sum() == 500 and vd.made_neighbours(index, x[:500], 0.9999)[0] > 350
