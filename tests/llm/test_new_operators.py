"""Clustering, personal data, whitening and packing against plain versions, and on odd input."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from xcomm.llm import cover_tree, packing, pii, va_file, whitening

VECTORS = "vec_id long, embedding array<double>, label int, row string, vec int, id long, cells string, cluster int"


def vector_frame(spark, rows):
    """Vectors with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, 0, "r", 1, 2, "c", 3) for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 6))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.6, 6)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[11][1]), (None, rows[12][1])]  # repeated and missing ids, ties
    rows += [(400 + i, [0.25] * 6) for i in range(40)]  # a group of equal vectors
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 7), (904, [None] + [1.0] * 5), (905, [math.nan] * 6), (906, [math.inf] + [0.0] * 5)]
    return rows, odd


def plain_clusters(rows, k, rounds, seed):
    x = np.array([[math.floor(1024 * v) for v in r] for _, r in rows], np.int64)
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda j: (name(rows[j][0]), x[j].tolist()))
    c = x[order[:k]]
    for _ in range(rounds):
        a = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1), c


@pytest.mark.parametrize("k,rounds,bits", [(8, 4, 8), (3, 3, 2), (1, 1, 8)])
def test_va_file_equals_plain_clustering(spark, vectors, k, rounds, bits):
    rows, odd = vectors
    df = vector_frame(spark, rows + odd).repartition(5)
    assigned, centroids = va_file.cluster_vectors(df, k, rounds, 3, 6, bits=bits)
    assert assigned.columns == ["row", "cluster", "distance"]
    cluster, distance, c = plain_clusters(rows, k, rounds, 3)
    assert centroids.tolist() == c.tolist()
    got = va_file.with_inertia(assigned, centroids).select("row.vec_id", "row.cells", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=key) == sorted(
        [(i, int(a), int(d)) for (i, _), a, d in zip(rows, cluster, distance, strict=True)], key=key)
    inertia = {j: int(distance[cluster == j].sum()) for j in range(k)}
    for r in got:
        assert (r.cells, r.cluster_inertia, r.inertia) == ("c", inertia[r.cluster], int(distance.sum()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster].tolist())).encode()).hexdigest()


def test_va_file_intervals_hold_and_prune(vectors):
    rows, _ = vectors
    x = np.array([[math.floor(1024 * v) for v in r] for _, r in rows], np.int64)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1]).astype(np.int64)) for j in range(6)]
    cells = va_file.Cells(edges, x.min(0), x.max(0))
    c = x[[0, 1, 2, 3]]
    may = va_file.candidates(cells.of(x), cells.tables(c))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert may[np.arange(len(x)), d.argmin(1)].all() and (may | (d > d.min(1, keepdims=True))).all()
    assert (may.sum(1) == 1).mean() > 0.5  # most vectors need no fetch


def test_va_file_small_and_extreme_input(spark):
    empty, centroids = va_file.cluster_vectors(vector_frame(spark, []), dims=6)
    assert empty.count() == 0 and len(centroids) == 0
    assert va_file.with_inertia(empty, centroids).count() == 0
    two = vector_frame(spark, [(1, [0.5, 0.0]), (2, [1e300, -1e300]), (3, [None, 1.0])])
    assigned, centroids = va_file.cluster_vectors(two, dims=2)
    assert len(centroids) == 2 and centroids.max() == va_file.LIMIT and assigned.count() == 2
    with pytest.raises(ValueError):
        va_file.cluster_vectors(two, k=0)


# whitening ---------------------------------------------------------------------------------------


def plain_whitening(rows):
    x = np.array([[math.floor(1024 * v) + 100000 for v in r] for _, r in rows], np.int64)
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return x, n, s, y, e[::-1], u[:, ::-1]


def test_whitening_equals_eigenvectors(spark, vectors):
    rows, odd = vectors
    df = vector_frame(spark, rows + odd).repartition(7)
    model = whitening.fit_whitening(df, components=4)
    x, n, s, y, e, u = plain_whitening(rows)
    assert (model.n, model.sums) == (n, s.tolist())
    np.testing.assert_allclose(model.values, e, rtol=1e-12)
    np.testing.assert_allclose(np.abs(model.directions @ u[:, :4]), np.eye(4), atol=1e-10)
    out = whitening.whiten(df, model)
    assert out.columns == ["row", "deviation", "whitened"]
    got = out.select("row.vec_id", "row.label", "deviation", "whitened").collect()
    want = {tuple(r[1]): (int(((n * x[j] - s) ** 2).sum()), y[j] @ model.directions.T / np.sqrt(e[:4])) for j, r in enumerate(rows)}
    by_deviation = {d: w for d, w in want.values()}
    assert len(got) == n
    for r in got:
        np.testing.assert_allclose(r.whitened, by_deviation[r.deviation], atol=1e-9)
    assert whitening.identity_error(out, 4) < 1e-10


def test_whitening_in_a_tree_of_factors(spark, vectors, monkeypatch):
    rows, _ = vectors
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    model = whitening.fit_whitening(vector_frame(spark, rows).repartition(9))
    np.testing.assert_allclose(model.values, plain_whitening(rows)[4], rtol=1e-12)


def test_whitening_of_degenerate_tables(spark):
    assert whitening.fit_whitening(vector_frame(spark, [])) is None
    assert whitening.whiten(vector_frame(spark, []), None).count() == 0
    same = vector_frame(spark, [(i, [0.5, 1.0, 2.0]) for i in range(20)])
    model = whitening.fit_whitening(same)
    assert len(model.directions) == 0 and whitening.identity_error(whitening.whiten(same, model), 0) is None
    assert [(r.deviation, r.whitened) for r in whitening.whiten(same, model).collect()] == [(0, [])] * 20
    flat = vector_frame(spark, [(i, [i / 8, -i / 4, 1.0, 0.0]) for i in range(30)] + [(99, [1.0])])
    model = whitening.fit_whitening(flat)
    out = whitening.whiten(flat, model)
    assert len(model.directions) == 1 and out.count() == 30 and whitening.identity_error(out, 1) < 1e-10
    far = vector_frame(spark, [(i, [1e200 * (-1) ** i, float(i)]) for i in range(6)])
    assert whitening.whiten(far, whitening.fit_whitening(far)).count() == 6


@pytest.mark.parametrize("seed", range(6))
def test_bidiagonal_qd_solver(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(2, 40))
    spread = np.exp(rng.normal(0, [0.1, 1, 3][seed % 3], d))
    a = np.linalg.qr(rng.normal(size=(3 * d, d)) * spread, mode="r")
    if seed == 4:  # equal values
        a = np.diag(np.repeat([3.0, 1.0], [d - d // 2, d // 2]))
    if seed == 5:  # nearly equal ones
        a = np.diag(1 + np.arange(d) * 1e-12) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
    values, vectors = whitening.principal_directions(a, 1, d)
    # the reference is only as good as its largest value allows
    np.testing.assert_allclose(values, np.linalg.svd(a, compute_uv=False) ** 2, rtol=1e-11, atol=1e-14 * values[0])
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(len(vectors)), atol=1e-8)
    np.testing.assert_allclose(vectors @ (a.T @ a) @ vectors.T, np.diag(values[: len(vectors)]), atol=1e-8 * values[0])


# personal data -----------------------------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def plain_base(text):
    only = lambda m: re.sub("[^0-9]", "", m.group())
    tests = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.group().split(".")),
        "card": lambda m: 16 <= len(only(m)) <= 19 and plain_luhn(only(m)),
        "phone": lambda m: 8 <= len(only(m)) <= 15,
    }
    return {k: [m.span() for m in PLAIN[k].finditer(text or "") if tests[k](m)] for k in PLAIN}


@pytest.fixture(scope="module")
def personal(spark):
    rnd = random.Random(5)
    texts = [None, "", "  ", "a@b.c_d@e.f x@y @z.w a@@b.c é" * 3, "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004 1.2.3", "+1 (212) 555-1234, +49-30.123456 +12", "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111 1"]
    texts += ["", "9" * 60_000, "x" * 60_000, "1 " * 30_000, "a." * 30_000, "+1" + " " * 60_000, "12.34." * 6_000, ("ü a@b.de, " * 1500)]
    alphabet = ["@", ".", "-", " ", "+", "a", "Z9", "12", "4111111111111111", "255.1.2.3", "(", ")", "é", "\n", "a@b.co", "_", "%", "0"]
    texts += ["".join(rnd.choices(alphabet, k=rnd.randint(1, 60))) for _ in range(250)]
    texts += ["write to jane (at) mail (dot) example (dot) com now", "email: bob [at] shop.de today", "blocked host 10[.]20[.]30[.]41 again", "call (212) 555-0188 now", "phone: 030 123 4567"]
    texts += ["version 1.2 of 3, page 12", "password=cd5c291ad0fad3e545", "order 12345678901234567 shipped", "see a.b and c.d, 3.14 is pi"]
    rows = [(i if i % 7 else 7, t, "card", 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, email string, body long, row string").repartition(4), texts


def test_personal_data_base_spans(spark, personal):
    docs, texts = personal
    numbered = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    got = {r.key: r for r in pii.find_personal_data(numbered).select("row.key", "row.email", *[f"n_{k}" for k in pii.KINDS], *[F.col(f"{k}_base").alias(f"b_{k}") for k in pii.KINDS], *[F.col(k).alias(f"all_{k}") for k in pii.KINDS]).collect()}
    for text in texts:
        r, want = got[hashlib.sha256((text or "").encode()).hexdigest()], plain_base(text)
        assert r["email"] == "card"
        for k in pii.KINDS:
            assert [(s["at"], s["end"]) for s in r[f"b_{k}"]] == want[k] and r[f"n_{k}"] == len(want[k]), (k, (text or "")[:80])
            found = [(s["at"], s["end"]) for s in r[f"all_{k}"]]
            assert found == sorted(found) and set(want[k]) <= set(found)
    added = lambda t: [(k, t[s["at"] : s["end"]]) for k in pii.KINDS for s in got[hashlib.sha256(t.encode()).hexdigest()][f"all_{k}"]]
    assert added(texts[-9]) == [("email", "jane (at) mail (dot) example (dot) com")]
    assert added(texts[-8]) == [("email", "bob [at] shop.de")]
    assert added(texts[-7]) == [("ip", "10[.]20[.]30[.]41")]
    assert added(texts[-6]) == [("phone", "(212) 555-0188")]
    assert all(added(t) == [] for t in texts[-4:])


def test_personal_data_reliabilities_equal_plain_ones(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(300):
        y = rnd.random() < 0.4
        rows.append((rnd.randrange(2), *[(1 if y else -1) if rnd.random() < p else 0 if rnd.random() < 0.5 else (-1 if y else 1) for p in (0.9, 0.8, 0.7, 0.6, 0.8, 0.5)], *[rnd.randrange(2) for _ in range(3)]))
    names = ["kind", *[f"v{i}" for i in range(6)], *[f"f{i}" for i in range(3)]]
    counts = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).groupBy(*names).agg(F.count("*").alias("n"))
    bias, weight = pii.reliabilities(counts, 5)
    m, plain_bias, plain = 6, np.zeros(4), np.tile([-1.0, 0.0, 1.0], (4, 6, 1))
    for _ in range(5):
        yes, no = np.tile(pii.PRIOR[::-1], (4, m, 1)).astype(float), np.tile(pii.PRIOR, (4, m, 1)).astype(float)
        a, b = np.zeros(4), np.zeros(4)
        for kind, *v in rows:
            p = 1 / (1 + math.exp(-(plain_bias[kind] + sum(plain[kind, j, v[j] + 1] for j in range(m)))))
            a[kind], b[kind] = a[kind] + p, b[kind] + 1 - p
            for j in range(m):
                yes[kind, j, v[j] + 1] += p
                no[kind, j, v[j] + 1] += 1 - p
        plain = np.log(yes / yes.sum(2, keepdims=True)) - np.log(no / no.sum(2, keepdims=True))
        plain_bias = np.where(a + b > 0, np.log((a + 1) / (b + 1)), 0.0)
    np.testing.assert_allclose(bias, plain_bias, rtol=1e-9)
    np.testing.assert_allclose(weight, plain, rtol=1e-9, atol=1e-12)
    w = pii.span_classifier(counts, bias, weight)
    target = {r: 1 / (1 + math.exp(-(bias[r[0]] + sum(weight[r[0], j, r[1 + j] + 1] for j in range(m))))) for r in rows}
    for kind in (0, 1):  # the gradient of the penalised likelihood vanishes
        x = np.array([(1, *r[1:]) for r in rows if r[0] == kind], float)
        t = np.array([target[r] for r in rows if r[0] == kind])
        np.testing.assert_allclose(x.T @ (t - 1 / (1 + np.exp(-x @ w[kind]))), pii.PENALTY * w[kind], atol=1e-6)


def test_personal_data_without_spans(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(none).count() == 0
    plain = spark.createDataFrame([(1, "nothing here"), (1, None)], "doc_id long, text string")
    rows = pii.find_personal_data(plain).select(pii.listed({k: F.col(k) for k in pii.KINDS}).alias("s"), "n_email").collect()
    assert [(r.s, r.n_email) for r in rows] == [("", 0)] * 2


# packing -----------------------------------------------------------------------------------------


def total_cost(bins, capacity):
    return sum(packing.sequence_cost(c) for c in dict(zip(bins.tolist(), capacity.tolist(), strict=True)).values())


def least_cost(lengths):
    """Exhaustive search over all ways to split the pieces."""
    n = len(lengths)
    one = [0.0] * (1 << n)
    for m in range(1, 1 << n):
        words = sum(lengths[i] for i in range(n) if m >> i & 1)
        one[m] = min((packing.sequence_cost(c) for c in packing.CAPACITIES if c >= words), default=math.inf)
    best = [0.0] + [math.inf] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        s = m
        while s:
            if s & m & -m:
                best[m] = min(best[m], best[m ^ s] + one[s])
            s = (s - 1) & m
    return best[-1]


def test_packing_against_exhaustive_search():
    rng, ratios, simple, shrunk = np.random.default_rng(1), [], [], 0
    for _ in range(120):
        lengths = np.clip(rng.lognormal(6, 1.2, rng.integers(2, 9)), 1, 4096).astype(np.int64)
        bins, offsets, capacity = packing.pack(lengths)
        used = np.bincount(bins, weights=lengths)
        assert (used[bins] <= capacity).all() and (offsets + lengths <= used[bins]).all()
        least = least_cost(lengths.tolist())
        plain = packing.sequence_cost(packing.downsized(packing.best_fit(lengths)[2])).sum()
        cost = total_cost(bins, capacity)
        assert least - 1e-9 <= cost <= plain + 1e-9
        ratios.append(cost / least)
        simple.append(plain / least)
    assert np.mean(ratios) < 1.01 < np.mean(simple)
    # larger bins are opened where they pay, and shrink when they stay empty
    many = np.full(90, 300)
    price = packing.sequence_cost(1024) / 1024
    assert packing.opening_capacity(300, 10**6, price=price, piece=300.0) > 512 == packing.opening_capacity(300, 0, price=price)
    bins, _, capacity = packing.pack(many)
    assert total_cost(bins, capacity) < 0.7 * 90 * packing.sequence_cost(512)
    _, _, used = packing.best_fit(np.array([1000, 900, 800, 40]), price=packing.sequence_cost(4096) / 1000)
    assert (packing.downsized(used) < 4096).any() or len(used) == 1


def test_cover_tree_links_extreme_vectors(spark):
    """Parallel vectors link whatever their size, and take no link from ordinary ones of their label."""
    rows = [(1, [1e200, 2e200]), (2, [1.1e200, 2.2e200]), (3, [1e-200, -1e-200]), (4, [2e-200, -2e-200]), (5, [3.0, 0.1]), (6, [6.0, 0.2]), (7, [0.0, 0.0]), (8, [5e-324, 5e-324])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_duplicates(df).select("row.vec_id", "n_links", "component_id").collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}
