"""The hand-checked graph: reversed and exact duplicates, self-loops, a path, a triangle and a pair."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hopgrid.operators import components, kernel, msbfs, normalize, trace
from hopgrid.plans.engine import Graph, run_workload
from hopgrid.sources.edges import from_frame, read_edge_csv
from hopgrid.sources.results import result_string

RAW = [(10, 20), (20, 10), (20, 30), (30, 40), (40, 50), (20, 20), (10, 20), (60, 70), (70, 80), (60, 80), (90, 100), (110, 110)]


@pytest.fixture(scope="module")
def tiny(spark):
    return Graph(spark.createDataFrame(RAW, "src long, dst long"))


def test_shape(tiny):
    assert tiny.edges.count() == 16 and tiny.n_vertices == 10
    assert sorted(map(tuple, tiny.stats.collect())) == [(1, 5, 8), (2, 3, 6), (3, 2, 2)]


def test_scores(tiny):
    m = {r["v"]: (r["reach"], r["dist_sum"], round(r["closeness"], 6)) for r in tiny.closeness().collect()}
    v = {r["v"]: round(r["closeness"], 6) for r in tiny.closeness("global").collect()}
    assert m[30] == (4, 6, 0.375) and m[20] == (4, 7, 0.321429) and m[60] == (2, 2, 0.25) and m[90] == (1, 1, 0.0)
    assert v[30] == 0.296296 and v[100] == 0.111111


@pytest.mark.parametrize("strategy", ["auto", "bitmask", "bottom_up", "switch", "scalar", "scalar_bottom_up", "scalar_switch", "pruned"])
@pytest.mark.parametrize("mode", ["component", "global"])
def test_strategies_agree(tiny, strategy, mode):
    assert result_string(tiny.top_k(mode=mode, strategy=strategy)).first()[0] == "30|20|40|60|70|80|10"


def test_workload(spark, tmp_path):
    (tmp_path / "g.csv").write_text("a|b\n" + "".join(f"{a}|{b}\n" for a, b in RAW))
    (tmp_path / "w.txt").write_text(f"10 {tmp_path}/g.csv 30|20|40|60|70|80|10\n")
    (report,) = run_workload(spark, str(tmp_path / "w.txt"))
    assert report["correct"]
    assert read_edge_csv(spark, str(tmp_path / "g.csv"), extra_columns=True).count() == 12


def test_bad_inputs(spark, tmp_path):
    (tmp_path / "g.csv").write_text("a|b\n1|x\n")
    with pytest.raises(Exception):
        read_edge_csv(spark, str(tmp_path / "g.csv")).collect()
    (tmp_path / "w.txt").write_text("10 path\n")
    with pytest.raises(Exception, match="without a reference"):
        run_workload(spark, str(tmp_path / "w.txt"))


def test_empty_and_null(spark):
    raw = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")
    g = Graph(from_frame(raw, "a", "b"))
    assert g.edges.count() == 0 and g.components.count() == 0
    assert g.top_k(strategy="bitmask").count() == 0


def test_missing_id_is_an_error(spark):
    ids = spark.createDataFrame([(5, 0)], "id long, internal_id long")
    with pytest.raises(Exception, match="unknown internal id"):
        normalize.decode(spark.createDataFrame([(1,)], "v long"), ids, "v").collect()


def test_trace(spark, tiny):
    t = tiny.traversal()
    table = trace.round_table(spark, [t.trace, t.trace]).orderBy("round").collect()
    assert table[0]["runs"] == 2 and len(table) == len(t.trace)
    (row,) = trace.run_summary(spark, [("a", 10), ("a", 13)]).collect()
    assert row["mean_ms"] == 11 and row["min_ms"] == 10


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90)), min_size=1, max_size=150))
def test_masks_match_kernel(spark, pairs):
    """More sources than one word: both traversals find the same hop counts, and reach is component size - 1."""
    g = Graph(spark.createDataFrame(pairs, "src long, dst long"))
    one = sorted(map(tuple, g.hop_counts("bitmask").collect()))
    assert one == sorted(map(tuple, kernel.hop_counts(g.edges, g.sources()).collect()))
    assert sorted(map(tuple, kernel.components(g.edges).collect())) == sorted(map(tuple, components.connected_components(g.edges).collect()))
    sizes = {r["v"]: r["n_vertices"] for r in g.components.join(g.stats, "comp").collect()}
    for r in msbfs.reach_dist(g.hop_counts("bitmask")).collect():
        assert r["reach"] == sizes[r["src"]] - 1


def test_unknown_names_are_errors(tiny):
    for call in (lambda: tiny.top_k(strategy="nonsense"), lambda: tiny.closeness(strategy="pruned"), lambda: tiny.hop_counts("pruned"), lambda: tiny.top_k(mode="x"), lambda: tiny.top_k(mode="x", strategy="pruned")):
        with pytest.raises(ValueError, match="unknown|no such"):
            call()


@pytest.mark.parametrize("mode", ["component", "global"])
def test_pruned_takes_limit_and_n(tiny, mode):
    for limit, n in ((3, None), (None, 1000), (4, 500)):
        assert rows_of(tiny.top_k(mode=mode, strategy="pruned", limit=limit, n=n)) == rows_of(tiny.top_k(mode=mode, limit=limit, n=n))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def web(spark):
    """A hub with spokes, a clique and a long tail: frontiers grow, cover most of it, and get small again."""
    edges = [(0, k) for k in range(1, 60)] + [(a, b) for a in range(60, 80) for b in range(60, a)] + [(59, 60)] + [(k, k + 1) for k in range(79, 85)]
    return Graph(spark.createDataFrame(edges, "src long, dst long"))


@pytest.mark.parametrize("strategy", ["bitmask", "bottom_up", "switch", "scalar", "scalar_bottom_up", "scalar_switch"])
def test_strategies_give_all_rows(web, strategy):
    assert rows_of(web.hop_counts(strategy)) == rows_of(web.hop_counts("kernel"))


def test_directions_change_both_ways(web):
    way = [r["direction"] for r in web.traversal(direction="switch").trace]
    assert way[0] == "down" and "up" in way and "down" in way[way.index("up") :]


@pytest.mark.parametrize("mode,small", [("component", True), ("global", True), ("component", False)])
def test_pruning_ends_searches(web, mode, small):
    from hopgrid.operators import topk

    got = topk.pruned_top_k(web.edges if small else web.layout, web.components, web.stats, 7, mode, first_wave=16, growth=4, small=small)
    assert rows_of(got) == rows_of(web.top_k(mode=mode))


def test_aborted_search_discovers_less(web):
    from pyspark.sql import functions as F

    ordered = msbfs.ordered_sources(web.sources())
    every = msbfs.traverse(web.layout, ordered, web.n_vertices)
    some = msbfs.traverse(web.layout, ordered, web.n_vertices, go_on=lambda reach, dist, hop: dist < F.lit(200))
    assert some.discovered.count() < every.discovered.count() and 0 < some.finished.count() < web.n_vertices
    left = {r["v"] for r in some.finished.collect()}
    full = {r for r in rows_of(msbfs.hop_counts(every)) if r[0] in left}
    assert {r for r in rows_of(msbfs.hop_counts(some)) if r[0] in left} == full


def test_rounds_leave_the_edges_in_place(spark, web):
    """No exchange of the edges in a round, also if nothing is broadcast."""
    names = ["w0"]
    front = spark.createDataFrame([(0, 1, 1, 1)], "batch long, v long, deg long, w0 long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = msbfs.expand_down(front, front.limit(0), web.layout, names)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    depth = lambda x: re.search(r"[A-Za-z*]", x).start()
    scan = next(k for k, x in enumerate(lines) if "Scan parquet" in x and "deg" in x)
    above, at = [], depth(lines[scan])
    for x in lines[scan::-1]:  # the scan's ancestors
        if depth(x) < at:
            at = depth(x)
            above.append(x)
    join = next(k for k, x in enumerate(above) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in above[:join]), above


def test_command_line(spark, tmp_path, capsys):
    from hopgrid.__main__ import main

    (tmp_path / "g.csv").write_text("a|b\n" + "".join(f"{a}|{b}\n" for a, b in RAW))
    (tmp_path / "w.txt").write_text(f"10 {tmp_path}/g.csv 30|20|40|60|70|80|10\n")
    assert main([str(tmp_path / "w.txt"), "--runs", "2", "--strategy", "kernel", "--strategy", "pruned"]) == 0
    out = capsys.readouterr().out
    assert out.count("answer=30|20|40|60|70|80|10") == 4 and "factor=1.0" in out
    (tmp_path / "w.txt").write_text(f"10 {tmp_path}/g.csv 1|2\n")
    assert main([str(tmp_path / "w.txt")]) == 1


def test_shared_folder_must_be_set_off_local_masters():
    from types import SimpleNamespace

    from hopgrid.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


@pytest.fixture(scope="module")
def many(spark):
    """Components that share packs and such that have their own, with leaves, a star, a cycle with tails, a clique with a weighty hub and a long path."""
    edges = [(2 * k, 2 * k + 1) for k in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    edges += [(1000, 1001 + k) for k in range(300)]  # a star: its core is one vertex
    edges += [(2000 + k, 2000 + (k + 1) % 400) for k in range(400)] + [(2000 + k, 3000 + k) for k in range(0, 400, 3)] + [(3000, 3900), (3900, 3901)]
    edges += [(5000 + a, 5000 + b) for a in range(40) for b in range(a)] + [(5000 + k % 40, 6000 + k * (k % 40)) for k in range(500)]
    edges += [(9000 + k, 9001 + k) for k in range(700)]
    return Graph(spark.createDataFrame(edges, "src long, dst long"))


@pytest.mark.parametrize("far, ball, rounds", [(1 << 16, 1024, 1000), (0, 5, 1000), (10, 64, 2)])
def test_hanging_trees_are_not_searched_from(many, far, ball, rounds, monkeypatch):
    for name, value in (("FAR", far), ("BALL", ball), ("ROUNDS", rounds)):
        monkeypatch.setattr(kernel, name, value, raising=False)
    want, made, packs = rows_of(kernel.sums(many.edges).drop("ecc")), [], kernel._packs
    monkeypatch.setattr(kernel, "_packs", lambda *x: made.append(packs(*x)) or made[-1])
    assert rows_of(many.reach()) == want
    searched = made[0].ids.tolist()
    assert sorted(searched + made[0].leaf_ids.tolist()) == [v for v, _, _ in want]
    assert len([v for v in searched if 2000 <= v < 5000]) == (400 if rounds == 1000 else 401)  # of the cycle; one tail has three vertices


def test_kernel_searches_each_component_by_itself(many):
    want = rows_of(kernel.hop_counts(many.edges, many.sources()))
    assert rows_of(many.hop_counts()) == want
    sums = {r["src"]: (r["reach"], r["dist_sum"], r["ecc"]) for r in kernel.sums(many.edges).collect()}
    by = {}
    for src, hop, n in want:
        by.setdefault(src, []).append((hop, n))
    assert sums == {s: (sum(n for _, n in hs), sum(h * n for h, n in hs), max(h for h, _ in hs)) for s, hs in by.items()}
    assert rows_of(many.eccentricity()) == rows_of(msbfs.eccentricity(many.hop_counts("kernel", limit=10**6)))
    comp = {r["v"]: r["comp"] for r in many.components.collect()}
    g, size = kernel._packs(many.edges), {r["comp"]: r["n_vertices"] for r in many.stats.collect()}
    for pack, weights in enumerate(g.weights):
        own = {comp[v] for v in g.ids[g.edge[pack] : g.edge[pack + 1]].tolist()}
        assert len(own) == 1 if weights is not None else max(size[c] for c in own) <= kernel.SMALL
    # Leaves are answered from the vertex that they hang from.
    assert sorted(g.ids.tolist() + g.leaf_ids.tolist()) == sorted(comp) and len(g.leaf_ids) > 300
    # However the blocks of a pack are dealt, their rows add up.
    pack = max(range(len(g.weights)), key=g.blocks)
    whole = sum((b.to_pylist() for b in kernel._sums(g, pack, 0, g.blocks(pack))), [])
    parts = sum((b.to_pylist() for k in range(g.blocks(pack)) for b in kernel._sums(g, pack, k, k + 1)), [])
    assert g.blocks(pack) > 1
    by = {}
    for p in parts:
        by.setdefault(p["src"], []).append(p)
    for r in whole:
        own = by[r["src"]]
        assert (sum(p["reach"] for p in own), sum(p["dist_sum"] for p in own), max(p["ecc"] for p in own)) == (r["reach"], r["dist_sum"], r["ecc"])


def test_kernel_without_edges(spark):
    g = Graph(spark.createDataFrame([(3, 3)], "src long, dst long"))
    assert g.hop_counts().count() == 0 and g.closeness().count() == 0 and g.eccentricity().count() == 0


@pytest.mark.parametrize("strategy", ["bitmask", "bottom_up", "switch"])
def test_directions_in_the_kernel(many, monkeypatch, strategy):
    """Beyond PAIRS stored rows the kernel takes the bit-mask strategies, in their direction, and stores no rounds."""
    from hopgrid.plans import engine

    monkeypatch.setattr(engine, "PAIRS", 10)
    monkeypatch.setattr(msbfs, "traverse", lambda *a, **k: pytest.fail("rounds are stored"))
    assert rows_of(many.hop_counts(strategy)) == rows_of(many.hop_counts("kernel"))
    assert rows_of(many.top_k(strategy=strategy)) == rows_of(many.top_k())


def test_kernel_directions_ask_fewer(many):
    g = kernel._packs(many.edges)
    asked = {}
    for direction in ("top_down", "bottom_up", "switch"):
        seen = asked[direction] = []

        class Spy(kernel.Asking):
            def rows(self, front, *rest):
                out = super().rows(front, *rest)
                seen.append((self.up, len(front) if out is None else len(out)))
                return out

        with pytest.MonkeyPatch.context() as m:
            m.setattr(kernel, "Asking", Spy)
            for pack in range(len(g.weights)):
                list(kernel._sums(g, pack, 0, g.blocks(pack), direction))
    assert {up for up, _ in asked["top_down"]} == {False} and {up for up, _ in asked["bottom_up"]} == {True}
    assert {up for up, _ in asked["switch"]} == {False, True}


@pytest.mark.parametrize("strategy", ["bitmask", "switch"])
def test_slices(spark, web, monkeypatch, strategy):
    """Beyond the kernel's bound searches from all vertices go in slices, of which nothing is left."""
    from hopgrid import session
    from hopgrid.plans import engine

    monkeypatch.setattr(engine, "PAIRS", 60)
    monkeypatch.setattr(msbfs, "MAX_WORDS", 1)
    g = Graph(web.edges)
    g.__dict__["small"] = False
    before = len(session._stored)
    assert rows_of(g.hop_counts(strategy)) == rows_of(web.hop_counts("kernel"))
    assert len(session._stored) == before and g.pairs > 60
