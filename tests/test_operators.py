"""Properties of operators that the oracle queries don't show."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import stats as ST
from pagemill.kernels import signal as S
from pagemill.operators import aggregates as A
from pagemill.operators import joins as J
from pagemill.operators import windows as W
from pagemill.operators.components import components
from pagemill.plans import pages as P
from pagemill.plans import spotting as SP

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(edges=st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    assert got == want


@few
@given(sizes=st.lists(st.tuples(st.integers(1, 60), st.integers(1, 60)), max_size=25), least=st.sampled_from([0.5, 0.8, 0.95]))
def test_band_join(spark, sizes, least):
    df = spark.createDataFrame([(i, float(w), float(h)) for i, (w, h) in enumerate(sizes)], "id int, w double, h double")
    got = {(r.id_a, r.id_b) for r in J.triangular_band_join(df, "id", least).collect()}
    far = lambda a, b: math.hypot(math.log(a[0]) - math.log(b[0]), math.log(a[1]) - math.log(b[1]))
    for (i, a), (j, b) in itertools.combinations(enumerate(sizes), 2):
        if abs(far(a, b) + math.log(least)) > 1e-9:
            assert ((i, j) in got) == (far(a, b) < -math.log(least))


@few
@given(points=st.lists(st.integers(0, 50), max_size=12), refs=st.lists(st.integers(0, 50), max_size=6))
def test_nearest(spark, points, refs):
    p = spark.createDataFrame([(1, i, x) for i, x in enumerate(points)], "g int, id int, x int")
    r = spark.createDataFrame([(1, y) for y in refs], "g int, y int")
    got = {x.id: x.nearest for x in J.nearest(p, r, ["g"], "id", "x", "y").collect()}
    assert got == {i: min(refs, key=lambda y: (abs(y - x), y)) if refs else None for i, x in enumerate(points)}


@few
@given(at=st.sets(st.integers(0, 60), min_size=1, max_size=30))
def test_runs(spark, at):
    df = spark.createDataFrame([(0, x, True) for x in at], "g int, x int, ink boolean")
    got = sorted((r.start, r.end) for r in W.true_runs(df, ["g"], "x", "ink").collect())
    mask = np.zeros(62, dtype=bool)
    mask[list(at)] = True
    assert got == S.runs(mask)
    merged = sorted((r.start, r.end) for r in W.merged_runs(W.true_runs(df, ["g"], "x", "ink"), ["g"], 3).collect())
    assert merged == S.merged(S.runs(mask), 3)


def test_two_class_split_equals_kernel(spark):
    rng = np.random.default_rng(5)
    groups = {0: np.concatenate([rng.integers(1, 5, 30), rng.integers(20, 40, 12)]), 1: rng.integers(9, 11, 40), 2: np.array([1, 9])}
    rows = [(g, int(v)) for g, vs in groups.items() for v in vs]
    got = {r.g: r.threshold for r in ST.two_class_split(spark.createDataFrame(rows, "g int, v int"), "v", ["g"]).collect()}
    for g, vs in groups.items():
        want = S.log_otsu(vs)
        assert got[g] == pytest.approx(want) if want is not None else got[g] is None


def made(n_pages=3, n=30, seed=0):
    rng = np.random.default_rng(seed)
    shapes = rng.normal(size=(8, 12))
    rows = []
    for p in range(n_pages):
        for t in range(n):
            for k in range(1 + t % 2):
                f = shapes[(t * 3 + p) % 8] + 0.25 * rng.normal(size=12)
                f /= np.linalg.norm(f)
                rows.append((f"p{p}", t, 1000 * p + 10 * t + k, 30.0 + t % 3, 20.0, 20.0, f.tolist(), rng.normal(size=8).tolist(), 0, 0, 30 + t % 3, 20))
    return rows


SCHEMA = "page string, tok long, cand long, w double, h double, unit double, feat array<double>, seq array<double>, x0 int, y0 int, x1 int, y1 int"


def test_blocks_do_not_change_matches(spark, monkeypatch):
    """Small blocks and shuffled rows give the same matches as one block for a page."""
    p = SP.Params(z=1.0, floor=0.5)
    c = spark.createDataFrame(made(), SCHEMA)
    order = c.select("page", "tok").distinct().withColumns({"col": F.lit(0), "line": F.lit(0), "pos": F.col("tok").cast("int")})
    key = lambda df: sorted((r.page_a, r.page_b, r.i, r.j, round(r.z, 6)) for r in df.collect())
    want = key(SP.matches(c, order, p, steps=4))
    assert len(want) > 10
    monkeypatch.setattr(SP, "BLOCK", 7)
    assert key(SP.matches(c.repartition(5), order, p, steps=4)) == want
    with pytest.raises(ValueError, match="unknown"):
        SP.Params.of({"zz": 1})


def test_renamed_pages(spark):
    p = SP.Params(z=1.0, floor=0.5, dtw_weight=0.0)
    c = spark.createDataFrame(made(), SCHEMA)
    order = lambda d: d.select("page", "tok").distinct().withColumns({"col": F.lit(0), "line": F.lit(0), "pos": F.col("tok").cast("int")})
    size = lambda d: sorted(r["count"] for r in SP.clusters(SP.matches(d, order(d), p), d).groupBy("cluster").count().collect())
    turned = c.withColumn("page", F.concat(F.lit("q"), F.lit(9) - F.substring("page", 2, 1).cast("int")))
    assert size(c) == size(turned)


def test_empty_inputs(spark):
    c = spark.createDataFrame([], SCHEMA)
    order = c.select("page", "tok").withColumns({"col": F.lit(0), "line": F.lit(0), "pos": F.col("tok").cast("int")})
    assert SP.matches(c, order, SP.Params(dtw_weight=0.0)).count() == 0


def test_folder_run_on_drawn_pages(spark):
    rows = []
    for k in range(2):
        im = np.full((500, 420), 235, dtype=np.uint8)
        for col in (25, 235):
            for line, y in enumerate(range(60, 440, 60)):
                for t, x in enumerate((0, 75)):
                    for s in range(0, 42, 3):
                        im[y + (s * (line + t + 1)) % 9 : y + 24, col + x + s] = 25
        rows.append((f"page{k}", 500, 420, 1, bytearray(im.tobytes())))
    rows.append(("broken", 10, 10, 1, bytearray(b"x")))
    images = spark.createDataFrame(rows, "page string, height int, width int, channels int, data binary")
    out = P.spotted(images, SP.Params(z=0.5, floor=0.0, min_match=0.5, margin=5.0), dims=16)
    assert [r.page for r in out["failed"].collect()] == ["broken"]
    assert out["candidates"].count() > 20 and out["matches"].count() > 0
    assert out["summary"].count() == 3
    assert P.marks(images).where("error is not null").count() == 1


def test_retrieval_and_votes(spark):
    s = spark.createDataFrame([(0, 1, 1, 5.0), (0, 1, 2, 7.0), (0, 2, 1, 1.0), (0, 2, 2, 7.0)], "g int, a int, b int, s double")
    g = spark.createDataFrame([(0, 1, 1)], "g int, a int, b int")
    r = A.retrieval(s, g, ["g"], "a", "b", "s").first()
    assert (r.rank_a, r.rank_b) == (2, 1)
    v = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "z", 1), (2, "z", 2)], "c int, r string, o int")
    got = {x.c: (x.r, x.votes, x.auto_name) for x in A.majority(v, ["c"], "r", "o").collect()}
    assert got == {1: ("y", "1/2", None), 2: ("z", "2/2", "z")}


def test_warping_match_runs_over_all_page_pairs(spark):
    """Matches come from more pages than the first two, and those of a pair of pages are as if it were alone."""
    from dataclasses import replace

    from pagemill.plans import catalog_more as M
    from pagemill.plans import spotting as S
    from pagemill.plans.standins import candidates, tokens

    data = "/root/testdata/sf0.001"
    key = lambda r: (r.page_a, r.page_b, r.tok_a, r.tok_b, r.i, r.j)
    got = {key(r): round(r.z, 4) for r in M.pipe_match_with_dtw(spark, data).collect()}
    assert {k[:2] for k in got} - {("p0", "p1")}
    for pair in (("p0", "p1"), ("p2", "p3")):
        c = candidates(spark, data).where(f"page in {pair}").withColumn("seq", F.col("feat"))
        alone = S.matches(c, tokens(c), replace(S.Params(), z=1.5), within=False, steps=16).collect()
        assert {k: v for k, v in got.items() if k[:2] == pair} == {key(r): round(r.z, 4) for r in alone}


def test_three_components_against_matrices(spark, monkeypatch):
    """Token scores of blocks in cells equal those of whole matrices: components standardised over the comparison, mixed by weight."""
    monkeypatch.setattr(SP, "BLOCK", 4)
    monkeypatch.setattr(SP, "CELL_BLOCKS", 1)
    rng = np.random.default_rng(7)
    rows = []
    for page, n in (("a", 11), ("b", 7), ("c", 9)):
        for i in range(n):
            f = rng.normal(size=6)
            rows.append((page, i // 2, i, float(rng.integers(20, 40)), float(rng.integers(10, 14)), 10.0, (f / np.linalg.norm(f)).tolist(), rng.normal(size=10).tolist(), rng.normal(size=8).tolist()))
    df = spark.createDataFrame(rows, "page string, tok long, cand long, w double, h double, unit double, feat array<double>, seq array<double>, hseq array<double>")
    p = SP.Params(hog_weight=0.5, dtw_weight=0.3, hog_dtw_weight=0.2, hog_steps=4, z=-9.0, floor=-9.0, margin=99.0, k=99, k_within=99)
    got = {(r.page_a, r.page_b, r.tok_a, r.tok_b): r for r in SP.token_scores(SP.block_pairs(SP.stored(SP.blocks(df), "b")), p, 5).collect()}
    want = {}
    of = {page: [r for r in rows if r[0] == page] for page in "abc"}
    for a, b in [(x, y) for x in "abc" for y in "abc" if x <= y]:
        x, y = of[a], of[b]
        col = lambda s, k, shape: np.array([r[k] for r in s]).reshape(shape)
        parts = [
            (0.5, col(x, 6, (len(x), -1)) @ col(y, 6, (len(y), -1)).T), (0.3, -SP.K.dtw(col(x, 7, (len(x), 5, -1)), col(y, 7, (len(y), 5, -1)))),
            (0.2, -SP.K.dtw(col(x, 8, (len(x), 4, -1)), col(y, 8, (len(y), 4, -1)))),
        ]
        score = sum(w * (m - m.mean()) / (m.std() + 1e-8) for w, m in parts)
        for i, r in enumerate(x):
            for j, q in enumerate(y):
                if a != b or r[1] != q[1]:
                    key = (a, b, r[1], q[1])
                    fine = math.hypot(math.log(r[3] / q[3]), math.log(r[4] / q[4])) <= -math.log(0.8) + 1e-9 and min(r[3], q[3]) >= 12
                    u, t = want.get(key, (-np.inf, -np.inf))
                    want[key] = max(u, score[i, j]), max(t, score[i, j] if fine else -np.inf)
    assert set(got) == set(want)
    for key, (u, t) in want.items():
        assert got[key].u == pytest.approx(u, abs=1e-7)
        assert got[key].t == pytest.approx(t, abs=1e-7) if t > -np.inf else got[key].t is None


@pytest.mark.parametrize("k", [1, 15, 500])
def test_top_pairs_against_all(spark, monkeypatch, k):
    """Copies of vectors, some at another length, tie and go by i and j, whatever block they are in; one without length comes first."""
    monkeypatch.setattr(SP, "BLOCK", 4)
    monkeypatch.setattr(SP, "CELL_BLOCKS", 1)
    rng = np.random.default_rng(5)
    own = rng.normal(size=(6, 5)).astype(np.float32)
    rows = []
    for n, page in enumerate("abcabcabcabcabccabab"):
        f = own[n * 5 % 6] * 2.0 ** (n % 3) if n != 13 else own[0] * 0
        rows.append((page, n // 2, n * 7 % 20, 1.0, 1.0, 1.0, f.astype(float).tolist(), None))
    df = spark.createDataFrame(rows, "page string, tok long, cand long, w double, h double, unit double, feat array<double>, seq array<double>")

    def cosine(f, g):
        total = square_f = square_g = 0.0
        for x, y in zip(f, g, strict=True):
            total, square_f, square_g = total + x * y, square_f + x * x, square_g + y * y
        return total / math.sqrt(square_f * square_g) if square_f and square_g else math.inf

    want = sorted((-min(cosine(a[6], b[6]), math.inf), a[2], b[2], a[0], b[0]) for a in rows for b in rows if a[0] < b[0])[:k]
    got = SP.top_pairs(SP.block_pairs(SP.stored(SP.blocks(df), "b"), within=False), k).collect()
    assert [(r.i, r.j, r.page_a, r.page_b) for r in got] == [w[1:] for w in want]
    assert [math.inf if math.isnan(r.score) else r.score for r in got] == pytest.approx([min(-w[0], 1.0) if -w[0] < math.inf else math.inf for w in want], abs=1e-12)


def test_projection_keeps_relative_variances(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3, 5)) * np.array([5, 4, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "id long, s array<double>")
    got = np.array([r.s for r in P.projected(df, "s", 3, 2).orderBy("id").collect()]).reshape(-1, 2)
    flat = x.reshape(-1, 5)
    _, sv, v = np.linalg.svd(flat - flat.mean(axis=0), full_matrices=False)
    variances = sv[:2] ** 2 / (len(flat) - 1)
    assert np.allclose(np.abs(got), np.abs((flat - flat.mean(axis=0)) @ v[:2].T) / np.sqrt(variances.mean()), atol=1e-6)


def test_similar_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(SP, "BLOCK", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.node: r.component for r in components(SP.similar(df, "id", "v", 0.95)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, label = u @ u.T >= 0.95, np.arange(60)
    for _ in range(60):
        label = np.where(near, label[None], 60).min(axis=1)
    assert got == {i: int(c) for i, c in enumerate(label) if near[i].sum() > 1}


def test_containing_or_nearest_against_all(spark):
    rng = np.random.default_rng(8)
    spans = [(int(g), int(a), int(a + w), f"n{k}") for k, (g, a, w) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(-50, 300, 40), rng.integers(0, 60, 40), strict=True))]
    points = [(int(i), int(i % 4), int(x)) for i, x in enumerate(rng.integers(-80, 400, 200))]
    got = {r.id: (r["name"], r.gap) for r in J.containing_or_nearest(spark.createDataFrame(points, "id int, g int, x int"), spark.createDataFrame(spans, "g int, lo int, hi int, name string"), ["g"], "id", "x").collect()}
    for i, g, x in points:
        best = min(((max(0, lo - x, x - hi), lo, name) for h, lo, hi, name in spans if h == g), default=None)
        assert got[i] == ((best[2], best[0]) if best else (None, None))


def test_checks_overruled_by_matches(spark):
    """A match in its own cluster keeps a word, unless one in the target is stronger."""
    checks = [(1, 10, 1.0, 20, "move"), (2, 10, 1.0, 20, "move"), (3, 10, 0.1, 20, "move"), (4, 10, 0.2, None, "remove"), (5, 10, 0.2, None, "remove"), (6, 20, 3.0, 10, "keep"), (7, 10, 2.0, 20, "move")]
    edges = [(1, 6, 9.0), (1, 2, 3.0), (2, 1, 3.0), (4, 5, 2.0), (7, 1, 4.0), (6, 7, 4.0)]
    c = spark.createDataFrame(checks, "occ_id long, cluster long, own_z double, best_target long, verdict string")
    e = spark.createDataFrame(edges, "a long, b long, z double")
    got = {r.occ_id: r.verdict for r in A.overruled(c, e, c.select("occ_id", "cluster"), "occ_id").collect()}
    # 1: 9 in the target beats 3 and 4 in its own; 2: 3 in its own, none there; 3: no match at all; 7: 4 on both sides
    assert got == {1: "move", 2: "keep", 3: "move", 4: "keep", 5: "keep", 6: "keep", 7: "keep"}


def test_placed(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(x)) for i, x in enumerate(rng.integers(0, 200, 3000))]
    got = {r.i: r.place for r in W.placed(spark.createDataFrame(rows, "i int, x int"), [F.col("x"), F.col("i")]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert W.placed(spark.createDataFrame([], "i int, x int"), [F.col("x")]).count() == 0


def test_fit_in_many_tasks(spark):
    rows = [(i, i % 3, [float(i % 5 + 1), 1.0, float(i % 2)]) for i in range(30)]
    e = spark.createDataFrame(rows, "id long, cluster int, v array<double>")
    key, before = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set(key, "false")
    try:
        got = A.fit(e, A.profiles(e.withColumn("w", F.lit(1.0)), ["cluster"], "v", "w", 3), "v").collect()
    finally:
        spark.conf.set(key, before)
    unit = [np.array(v) / np.linalg.norm(v) for _, _, v in rows]
    want = {(i, t): np.mean([unit[i] @ unit[j] for j, c, _ in rows if c == t and j != i]) for i, _, _ in rows for t in range(3)}
    assert len(got) == len(want)
    assert all(abs(r.mean_cosine - want[r.id, r.target]) < 1e-9 for r in got)


def test_band_join_rounds_like_sql(spark):
    """960.0 to 908.1 is 0.9459375 exactly; logarithms apart and decimal digits made it 0.945937."""
    df = spark.createDataFrame([(81, 27.0, 908.1), (309, 27.0, 930.9), (600, 27.0, 960.0)], "id int, w double, h double")
    got = J.triangular_band_join(df, "id", 0.85).select("id_a", "id_b", ST.rounded(F.col("similarity"), 6).alias("s"))
    assert {(r.id_a, r.id_b): r.s for r in got.collect()} == {(81, 309): 0.975508, (81, 600): 0.945938, (309, 600): 0.969687}


def test_band_join_in_many_tasks(spark):
    """A few rows have many pairs, so small tables are dealt to many tasks too."""
    df = spark.createDataFrame([(i, float(10 + i % 40), float(20 + i % 30)) for i in range(500)], "id int, w double, h double")
    rows = J.triangular_band_join(df, "id", 0.8).withColumn("task", F.spark_partition_id())
    assert rows.agg(F.count_distinct("task")).first()[0] > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("by", [None, ["g"]])
def test_band_join_writes_each_row_once(spark, monkeypatch, by):
    """Rows go to blocks of their own cell, not to all cells in reach; all pairs come, over blocks, copies, rows without a size and other columns."""
    monkeypatch.setattr(J, "BAND_BLOCK", 3)
    monkeypatch.setattr(J, "BAND_KEPT", 4)
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 2), float(w), float(h), f"n{i}") for i, (w, h) in enumerate(rng.integers(0, 30, (60, 2)))] + [(60, 0, None, 5.0, None), (61, 1, 5.0, None, None)]
    rows += [(100 + i, g, w, h, n) for i, g, w, h, n in rows[:20]]
    df = spark.createDataFrame(rows, "id int, g int, w double, h double, name string")
    out = J.band_join(df, df.withColumn("w", F.col("w") * 1.2), 0.7, by)
    assert "Generate" not in out._jdf.queryExecution().sparkPlan().toString().split("Join" if by else "CartesianProduct", 1)[1]
    got = sorted((r["id_a"], r["id_b"], r.name_a, r.name_b, round(r.similarity, 9)) for r in out.collect())
    far = lambda x, y: math.hypot(math.log(x[2] / (y[2] * 1.2)), math.log(x[3] / y[3]))
    sized = [r for r in rows if r[2] and r[3]]
    assert got == sorted((x[0], y[0], x[4], y[4], round(math.exp(-far(x, y)), 9)) for x in sized for y in sized if far(x, y) <= -math.log(0.7) and (not by or x[1] == y[1]))


def test_band_join_keeps_few_enough_rows_for_short_numbers(spark):
    """A task's b are numbered in two bytes by the files of its results; all of them come."""
    one, many = spark.createDataFrame([(0, 10.0, 10.0)], "id int, w double, h double"), spark.range(100_000).selectExpr("cast(id AS int) AS id", "10.0D AS w", "10.0D AS h")
    tasks = J.band_join(one, many, 0.85).groupBy(F.spark_partition_id()).agg(F.count_distinct("id_b").alias("n")).collect()
    assert sum(r.n for r in tasks) == 100_000
    assert max(r.n for r in tasks) <= 2**16


def test_triangular_band_join_lists_equal_sizes_by_key(spark):
    """The b of an a are a range of one list, which repeats from a to a, however rows came."""
    ids = np.random.default_rng(7).permutation(40).tolist()
    df = spark.createDataFrame([(i, 10.0, 10.0) for i in ids], "id int, w double, h double")
    got = [(r.id_a, r.id_b) for r in J.triangular_band_join(df, "id", 0.85).collect()]
    assert got == list(itertools.combinations(range(40), 2))


def test_majority_by_rank(spark):
    """By the rank of anno_auto_names, two late votes lose to two early ones and three to two that came over a million events before."""
    votes = [("a", 1), ("a", 2), ("b", 2_500_000), ("b", 2_500_001), ("b", 2_500_002), ("c", 0)]
    v = spark.createDataFrame([(1, *x) for x in votes], "g int, name string, id long")
    rank = F.when(F.col("n") >= 2, F.col("n") * 1000000 - F.col("first"))
    assert A.majority(v, ["g"], "name", "id", rank).first()["name"] == "a"
    assert A.majority(v, ["g"], "name", "id").first()["name"] == "b"
    assert A.majority(v.where("name = 'c'"), ["g"], "name", "id", rank).where("n >= 2").isEmpty()


def test_containing_or_nearest_reads_groups_once(spark):
    """No frame runs on to the end of a group, which Spark reads again for each row; points at one place are answered once."""
    points = spark.createDataFrame([(i, 1, i % 9) for i in range(40)], "id int, g int, x int")
    out = J.containing_or_nearest(points, spark.createDataFrame([(1, 2, 3, "a"), (1, 6, 7, "b")], "g int, lo int, hi int, name string"), ["g"], "id", "x")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    near = ["a", "a", "a", "a", "a", "b", "b", "b", "b"]
    assert {r.id: r["name"] for r in out.collect()} == {i: near[i % 9] for i in range(40)}


def _drawn_blocks(spark, monkeypatch):
    """Candidates of three pages, three to a token, in blocks of five and cells of two blocks: (rows, blocks)."""
    monkeypatch.setattr(SP, "BLOCK", 5)
    monkeypatch.setattr(SP, "CELL_BLOCKS", 2)
    draw = np.random.default_rng(5)
    rows = []
    for i in range(72):
        f = draw.normal(size=4)
        rows.append((f"p{i // 24}", i // 3, i, float(20 + i % 15), 10.0, 20.0, (f / np.linalg.norm(f)).tolist(), None))
    df = spark.createDataFrame(rows, "page string, tok long, cand long, w double, h double, unit double, feat array<double>, seq array<double>")
    return rows, SP.stored(SP.blocks(df), "blocks")


def _exchanged(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Aggregate")


def test_tokens_meet_in_one_pair_of_blocks(spark, monkeypatch):
    rows, b = _drawn_blocks(spark, monkeypatch)
    places = b.select("page", "block", F.explode(F.array_distinct("rows.tok")).alias("tok"))
    assert places.groupBy("page", "tok").count().where("count > 1").isEmpty()
    best = SP.token_best(SP.block_pairs(b, within=False), 1.2)
    assert _exchanged(best) == 0  # what leaves a pair of blocks is final
    got = {(r.tok_a, r.tok_b): (r.u, r.t, r.i, r.j) for r in best.collect()}
    cos = {(x[2], y[2]): float(np.dot(x[6], y[6])) for x in rows for y in rows if x[0] < y[0]}
    want = {}
    for (i, j), s in cos.items():
        u, t, at = want.get((i // 3, j // 3), (-2.0, -2.0, None))
        fine = rows[i][3] / 20 >= 1.2 and rows[j][3] / 20 >= 1.2
        want[i // 3, j // 3] = (max(u, s), *((s, (i, j)) if fine and s > t else (t, at)))
    assert got.keys() == want.keys()
    for key, (u, t, at) in want.items():
        assert got[key][0] == pytest.approx(u) and got[key][2:] == (at or (None, None)) and (got[key][1] is None if at is None else got[key][1] == pytest.approx(t))


def test_standard_scores_leave_pairs_in_place(spark, monkeypatch):
    rows, b = _drawn_blocks(spark, monkeypatch)
    out = SP.standard_scores(SP.block_pairs(b, within=False))
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString().split("MapInPandas")[0]
    got = {(r.i, r.j): r.z for r in out.collect()}
    for a, c in itertools.combinations(("p0", "p1", "p2"), 2):
        s = {(x[2], y[2]): float(np.dot(x[6], y[6])) for x in rows for y in rows if (x[0], y[0]) == (a, c)}
        mean, deviation = np.mean(list(s.values())), np.std(list(s.values()))
        assert all(got[k] == pytest.approx((v - mean) / (deviation + 1e-8)) for k, v in s.items())
    assert len(got) == 3 * 24 * 24


def test_background_scores(spark, monkeypatch):
    rows, b = _drawn_blocks(spark, monkeypatch)
    got = {(r.page_a, r.page_b, r.tok_a, r.tok_b): r.z for r in SP.background_scores(b).collect()}
    want = 0
    for a, c in itertools.combinations_with_replacement(("p0", "p1", "p2"), 2):
        u = {}
        for x in rows:
            for y in rows:
                if (x[0], y[0]) == (a, c) and (a != c or x[1] != y[1]):
                    u[x[1], y[1]] = max(u.get((x[1], y[1]), -2.0), float(np.dot(x[6], y[6])))
        z = lambda v, all_: (v - np.mean(all_)) / (np.std(all_) + 1e-8)
        for (i, j), v in u.items():
            low = min(z(v, [s for (k, _), s in u.items() if k == i]), z(v, [s for (_, k), s in u.items() if k == j]))
            assert got[a, c, i, j] == pytest.approx(low)
        want += len(u)
    assert len(got) == want


def _plain_matches(scores, tokens, p):
    """Matches by whole tables of token scores: backgrounds and context by joins, ranks by windows."""
    by = ["page_a", "page_b"]
    rows = A.background_z(A.background_z(scores, by, F.col("t"), "u", "z_base"), by, F.col("u"), "u", "zu")
    near = [J.reading_neighbours(tokens, p.context_reach, ["page", "col"], "tok", ["line", "pos", "tok"]).select(F.col("page").alias(f"page_{s}"), F.col("tok").alias(f"t{s}"), "side", F.col("neighbour").alias(f"tok_{s}")) for s in "ab"]
    sent = rows.select(*by, "tok_a", "tok_b", "zu").join(near[0], ["page_a", "tok_a"]).join(near[1], ["page_b", "tok_b", "side"])
    sent = sent.groupBy(*by, F.col("ta").alias("tok_a"), F.col("tb").alias("tok_b")).agg(F.max("zu").alias("support"))
    rows = rows.join(sent, [*by, "tok_a", "tok_b"], "left").withColumn("support", F.greatest(F.coalesce("support", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("z", F.col("z_base") + p.context_weight * F.least("support", F.lit(p.context_cap))).where("t is not null")
    rows = W.reciprocal_top_k(rows, by, "tok_a", "tok_b", "t", F.when(F.col("page_a") == F.col("page_b"), p.k_within).otherwise(p.k), p.margin)
    return rows.where((F.col("z") >= p.z) & (F.col("t") >= p.floor) & ((F.col("page_a") != F.col("page_b")) | (F.col("tok_a") < F.col("tok_b"))))


@pytest.mark.parametrize("weight", [0.0, 0.4])
def test_matches_leave_no_table_of_all_pairs(spark, monkeypatch, weight):
    """Copies tie, tokens are not numbered in reading order, and blocks are small: the same matches as from whole tables, of which none is written."""
    monkeypatch.setattr(SP, "BLOCK", 16)
    rng = np.random.default_rng(9)
    drawn = [rng.normal(size=(2, 6)) for _ in range(30)]
    rows = []
    for n in range(150):
        f, q = drawn[int(rng.integers(30))] + (0.4 * rng.normal(size=(2, 6)) if n % 3 else 0.0)
        rows.append((f"p{n % 3}", n // 6, n, float(20 + n % 4), 10.0, 10.0, (f / np.linalg.norm(f)).tolist(), q.tolist(), 0, 0, 20, 10))
    c = spark.createDataFrame(rows, SCHEMA)
    order = c.select("page", "tok").distinct().withColumns({"col": F.lit(0), "line": F.col("tok").cast("int") % 5, "pos": F.lit(0)})
    p = SP.Params(z=0.8, floor=0.3, min_match=1.0, dtw_weight=weight)
    sizes = {}
    kept = SP.stored
    monkeypatch.setattr(SP, "stored", lambda df, name: (out := kept(df, name), sizes.update({name: max(out.count(), sizes.get(name, 0))}))[0])
    key = lambda r, score: (r.page_a, r.page_b, r.tok_a, r.tok_b, r.i, r.j, round(r.z, 6), round(r.z_base, 6), round(r.support, 6), round(r[score], 6), round(r.cos, 6))
    got = sorted(key(r, "score") for r in SP.matches(c, order, p, steps=3).collect())
    assert "token-scores" not in sizes and sizes["leaders"] <= 2 * 6 * 25 and sizes["chosen"] >= len(got) > 20
    scores = kept(SP.token_scores(SP.block_pairs(kept(SP.blocks(c), "b")), p, 3), "all")
    assert got == sorted(key(r, "t") for r in _plain_matches(scores, order, p).collect())
    assert {g[0] == g[1] for g in got} == {True, False}


def test_gold_scores_alone_leave_their_blocks(spark, monkeypatch):
    """agg_mrr writes the pairs that are gold, not all, and their ranks are those among all."""
    from pagemill.plans import catalog_pipes as C

    sizes = {}
    kept = SP.stored
    for m in (SP, C):
        monkeypatch.setattr(m, "stored", lambda df, name: (out := kept(df, name), sizes.update({name: out.count()}))[0])
    got = sorted(map(tuple, C.agg_mrr(spark, "/root/testdata/sf0.001").collect()))
    b = kept(SP.blocks(C.candidates(spark, "/root/testdata/sf0.001")), "b")
    scores = kept(SP.token_scores(SP.block_pairs(b, within=False), C.PARAMS), "all")
    assert max(sizes.values()) < scores.count() / 10
    by = ["page_a", "page_b"]
    out = A.retrieval_metrics(A.retrieval(scores, scores.where("u >= 3"), by, "tok_a", "tok_b", "u"), by)
    assert got == sorted(map(tuple, out.select(*by, *[F.round(c, 6).alias(c) for c in ("mrr", "hit1", "hit3")], "median_rank").collect()))


def _shuffled(spark) -> int:
    """Bytes that all stages so far have written for others to read."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_ranks_of_gold_pairs_take_disk_by_rows(spark, monkeypatch):
    """agg_mrr sends a block to few places, however many blocks it meets, and its ranks hold over all blocks of a page."""
    from pagemill.plans import catalog_pipes as C

    monkeypatch.setattr(SP, "BLOCK", 8)
    monkeypatch.setattr(SP, "CELL_BLOCKS", 1)
    monkeypatch.setattr(SP, "KEPT_BLOCKS", 9, raising=False)
    c = C.candidates(spark, "/root/testdata/sf0.001")
    alike = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x / F.lit(299.0666))
    c = c.withColumns({"tok": F.floor(F.col("tok") / 2), "feat": F.when(F.col("cand") % 9 == 0, alike).otherwise(F.col("feat"))})  # ties
    monkeypatch.setattr(C, "candidates", lambda *a: c)
    before = _shuffled(spark)
    got = sorted(map(tuple, C.agg_mrr(spark, "").collect()))
    used, rows = _shuffled(spark) - before, c.count()
    assert used < 8 * rows * 64 * 8, used
    b = SP.stored(SP.blocks(c), "b")
    assert b.count() > 40
    scores = SP.stored(SP.token_scores(SP.block_pairs(b, within=False), C.PARAMS), "all")
    by = ["page_a", "page_b"]
    out = A.retrieval_metrics(A.retrieval(scores, scores.where("u >= 3"), by, "tok_a", "tok_b", "u"), by)
    assert len(got) > 20 and got == sorted(map(tuple, out.select(*by, *[F.round(x, 6).alias(x) for x in ("mrr", "hit1", "hit3")], "median_rank").collect()))


@pytest.mark.parametrize(("name", "times"), [("agg_token_max", 6), ("agg_background_z", 9), ("agg_global_z", 6)])
def test_scores_of_all_pairs_take_disk_by_rows(spark, monkeypatch, name, times):
    """A block is sent to few places, however many blocks it meets, and small blocks give what large ones give."""
    from pagemill.plans import catalog_ops as O

    data, by = "/root/testdata/sf0.001", ("page_a", "page_b", "tok_a", "tok_b", "i", "j")
    query = lambda: {tuple(r[c] for c in by if c in r and (c, name) not in (("i", "agg_token_max"), ("j", "agg_token_max"))): r for r in getattr(O, name)(spark, data).collect()}
    want = query()
    monkeypatch.setattr(SP, "BLOCK", 8)
    monkeypatch.setattr(SP, "CELL_BLOCKS", 8)
    before = _shuffled(spark)
    got = query()
    used, rows = _shuffled(spark) - before, spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert used < times * rows * 64 * 8, used
    assert got.keys() == want.keys() and len(got) > 20_000
    for key, r in want.items():
        assert all(v == got[key][c] if not isinstance(v, float) else v == pytest.approx(got[key][c], abs=2e-6) for c, v in r.asDict().items())
