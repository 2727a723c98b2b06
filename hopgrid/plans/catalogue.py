"""The query catalogue: each query over the star-schema tables, with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgrid.operators import bfs, components, msbfs, normalize, orderings, topk, trace
from hopgrid.plans.engine import Graph
from hopgrid.session import cut, shared_dir
from hopgrid.sources.edges import from_frame, line_count, read_edge_csv, write_edge_text
from hopgrid.sources.results import result_string, write_scores
from hopgrid.sources.workload import read_workload

OFFSET = 10_000_000


def raw_edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Graphs derived from the tables; ids of different kinds are kept apart by an offset."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "nation_region":
        return from_frame(read("nation").select((F.col("n_nationkey") + 1000).alias("a"), "n_regionkey"), "a", "n_regionkey")
    line = read("lineitem")
    if name == "supp_mod":
        return from_frame(line.select("l_suppkey", (F.col("l_partkey") % 100).alias("b")), "l_suppkey", "b")
    if name == "cust_part_q50":
        few = line.filter("l_quantity >= 50")
        joined = few.join(read("orders"), few["l_orderkey"] == F.col("o_orderkey"))
        return from_frame(joined.select("o_custkey", (F.col("l_partkey") + OFFSET).alias("b")), "o_custkey", "b")
    if name.startswith("part_part_q"):
        few = line.filter(F.col("l_quantity") >= int(name[11:])).select("l_orderkey", "l_partkey")
        other = few.withColumnRenamed("l_partkey", "b")
        return from_frame(few.join(other, "l_orderkey").filter("l_partkey < b"), "l_partkey", "b")
    least = F.col("l_quantity") >= (49 if name == "supp_part_q49" else 50)
    if name == "supp_part_sparse":
        least = least & (F.col("l_discount") >= 0.1)
    return from_frame(line.filter(least).select("l_suppkey", (F.col("l_partkey") + OFFSET).alias("b")), "l_suppkey", "b")


GRAPH_SQL = {
    "nation_region": "select n_nationkey+1000, n_regionkey from nation",
    "supp_part_q49": "select l_suppkey, l_partkey+10000000 from lineitem where l_quantity>=49",
    "supp_part_sparse": "select l_suppkey, l_partkey+10000000 from lineitem where l_quantity>=50 and l_discount>=0.1",
    "part_part_q45": "select x.l_partkey, y.l_partkey from lineitem x join lineitem y using(l_orderkey) where x.l_partkey<y.l_partkey and x.l_quantity>=45 and y.l_quantity>=45",
    "part_part_q48": "select x.l_partkey, y.l_partkey from lineitem x join lineitem y using(l_orderkey) where x.l_partkey<y.l_partkey and x.l_quantity>=48 and y.l_quantity>=48",
    "cust_part_q50": "select o_custkey, l_partkey+10000000 from lineitem join orders on l_orderkey=o_orderkey where l_quantity>=50",
    "supp_mod": "select l_suppkey, l_partkey % 100 from lineitem",
}


def graph(spark: SparkSession, sf_dir: str, name: str) -> Graph:
    return Graph(raw_edges(spark, sf_dir, name))


def _base(name: str) -> str:
    q = f"(select cast(a as bigint) a, cast(b as bigint) b from ({GRAPH_SQL[name]}) t(a,b) where a is not null and b is not null)"
    return f"""with recursive
e as (select a,b from {q} where a<>b union select b,a from {q} where a<>b),
r(s,v,d) using key (s,v) as (
  select distinct a, a, 0::bigint from e
  union
  select r.s, e.b, r.d+1 from r join e on r.v=e.a
  where not exists (select 1 from recurring.r k where k.s=r.s and k.v=e.b)),
p as (select s as v, count(*)-1 as reach, cast(sum(d) as bigint) as dist_sum, count(*) as c, max(d) as ecc, min(v) as low from r group by s),
n as (select count(*) as n from p),
deg as (select a as v, count(*) as degree from e group by a),
comps as (select v, dense_rank() over (order by low) as comp from p),
stats as (select comp, count(*) as n_vertices, cast(sum(degree) as bigint) as n_edges from comps join deg using (v) group by comp),
score as (select v, reach, dist_sum,
  case when dist_sum>0 then cast((reach-1)*(reach-1) as double)/(cast(c-1 as double)*cast(dist_sum as double)) else 0.0 end as component,
  case when dist_sum>0 then cast(reach*reach as double)/(cast(n.n-1 as double)*cast(dist_sum as double)) else 0.0 end as global
  from p, n)
"""


def _topk_sql(name: str, mode: str) -> str:
    return _base(name) + f"select cast(row_number() over (order by {mode} desc, v) as integer) as rank, v, {mode} as closeness from score order by {mode} desc, v limit 7"


SAMPLE = 40
#: Batches of 64 sources by id, and what a batch newly reaches at a hop; rounds end with one that finds nothing.
PLACE = ", place as (select v, (row_number() over (order by v) - 1)//64 as batch from deg), held as (select batch, d, r.v, count(*) as bits from r join place on place.v=r.s where d>0 group by batch, d, r.v) "
ROUNDS = ", rounds as (select d as round, count(*) as rows from held group by d union all select max(d)+1, 0 from held) "
_KEY = "md5('1987:' || cast(v as varchar))"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def on(name: str, graph_name: str):
        def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
            q[name] = lambda spark, sf_dir: f(graph(spark, sf_dir, graph_name))
            return f

        return add

    for g in ("supp_mod", "cust_part_q50"):
        q["normalize_edges" + ("" if g == "supp_mod" else "_" + g)] = lambda s, d, g=g: normalize.normalize(raw_edges(s, d, g))
    on("dense_ids", "cust_part_q50")(lambda g: normalize.dense_ids(g.edges))
    on("decode_ids", "cust_part_q50")(lambda g: _round_trip(g))
    on("degree", "supp_part_q49")(lambda g: normalize.degree(g.edges))
    on("two_hop_degree", "supp_part_q49")(lambda g: normalize.two_hop_degree(g.edges))
    for g in ("cust_part_q50", "part_part_q45", "supp_part_sparse"):
        tail = "" if g == "cust_part_q50" else "_" + g
        on("connected_components" + tail, g)(lambda g: g.components)
        on("component_stats" + tail, g)(lambda g: g.stats)
    on("connected_components_stars", "part_part_q45")(lambda g: components.connected_components(g.edges))
    on("component_summary", "part_part_q45")(lambda g: components.component_summary(g.stats))
    on("bfs_distances", "part_part_q48")(lambda g: bfs.bfs_distances(g.edges, g.sources()))
    on("bfs_distances_bottom_up", "part_part_q48")(lambda g: bfs.bfs_distances(g.edges, g.sources(), "bottom_up", g.components))
    on("bfs_distances_switch", "part_part_q48")(lambda g: bfs.bfs_distances(g.edges, g.sources(), "switch", g.components))
    on("hop_counts", "supp_part_q49")(lambda g: g.hop_counts())
    on("hop_counts_bitmask", "cust_part_q50")(lambda g: g.hop_counts("bitmask"))
    on("bfs_reach_dist", "part_part_q45")(lambda g: g.reach())
    for mode in ("component", "global"):
        for g in ("supp_part_q49", "part_part_q45", "cust_part_q50"):
            tail = "" if g == "supp_part_q49" else "_" + g
            on(f"closeness_{mode}{tail}", g)(lambda g, mode=mode: g.closeness(mode))
            on(f"topk_closeness_{mode}{tail}", g)(lambda g, mode=mode: g.top_k(mode=mode))
        on(f"pruned_topk_{mode}", "part_part_q45")(lambda g, mode=mode: g.top_k(mode=mode, strategy="pruned"))
    on("topk_string", "supp_part_q49")(lambda g: result_string(g.top_k()))
    on("msbfs_topk", "supp_part_q49")(lambda g: g.top_k(strategy="bitmask"))
    on("bottom_up_topk", "supp_part_q49")(lambda g: g.top_k(strategy="bottom_up"))
    on("direction_opt_topk", "supp_part_q49")(lambda g: g.top_k(strategy="switch"))
    on("sampled_sources", "supp_part_q49")(lambda g: g.sources(SAMPLE))
    on("sampled_topk", "supp_part_q49")(lambda g: g.top_k(strategy="bitmask", limit=SAMPLE))
    on("scalar_topk", "supp_part_sparse")(lambda g: g.top_k(strategy="scalar"))
    on("order_degree", "cust_part_q50")(lambda g: orderings.with_batches(orderings.order_degree(g.edges, g.components), 64))
    on("order_component", "cust_part_q50")(lambda g: orderings.with_batches(orderings.order_component(g.stats, g.components), 64))
    on("order_two_hop", "cust_part_q50")(lambda g: orderings.with_batches(orderings.order_two_hop(g.edges, g.components), 64))
    on("order_degree_rank", "cust_part_q50")(lambda g: orderings.order_degree_rank(g.edges))
    on("order_neighbourhood", "cust_part_q50")(lambda g: orderings.order_neighbourhood(g.edges))
    on("eccentricity", "part_part_q45")(lambda g: g.eccentricity())
    on("diameter", "part_part_q45")(lambda g: g.eccentricity().agg(F.max("ecc").alias("diameter")))
    on("traversed_edges", "cust_part_q50")(lambda g: trace.traversed_edges(g.sources(), g.components, g.stats))
    on("order_neighbourhood_batches", "cust_part_q50")(lambda g: orderings.neighbourhood_batches(g.edges))
    on("hop_counts_bottom_up", "part_part_q48")(lambda g: g.hop_counts("bottom_up"))
    on("hop_counts_switch", "part_part_q48")(lambda g: g.hop_counts("switch"))
    on("frontier_sharing_part_part_q48", "part_part_q48")(lambda g: msbfs.frontier_sharing(g.traversal(words=1)))
    on("edge_sharing_part_part_q48", "part_part_q48")(lambda g: msbfs.edge_sharing(g.traversal(words=1), g.edges))
    on("trace_rounds", "supp_part_sparse")(lambda g: trace.round_table(g.spark, [g.traversal(words=1).trace]).select("round", "runs", "rows"))
    on("trace_lines", "supp_part_sparse")(_trace_lines)
    on("scores_sink", "supp_part_q49")(_scores_sink)
    on("topk_string_trailing", "supp_part_q49")(lambda g: result_string(g.top_k(), sep=" ", trailing=True))
    q["text_source"] = _text_source
    q["text_source_rest"] = lambda spark, sf_dir: _text_source(spark, sf_dir, "|1970-01-01|x")
    q["line_count"] = _line_count
    q["workload_source"] = _workload_source
    q["run_summary"] = lambda spark, sf_dir: trace.run_summary(spark, [(f"s{r['n_regionkey']}", 7 * r["n_nationkey"] + 1) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_nationkey").collect()])
    on("frontier_sharing", "nation_region")(lambda g: msbfs.frontier_sharing(g.traversal()))
    on("edge_sharing", "nation_region")(lambda g: msbfs.edge_sharing(g.traversal(), g.edges))
    on("batch_usage", "supp_part_sparse")(lambda g: msbfs.batch_usage(g.traversal(words=1)))
    on("induced_subgraph", "supp_part_q49")(lambda g: normalize.induced_subgraph(g.edges, normalize.degree(g.edges).filter("degree >= 3")))
    on("distance_identity", "part_part_q48")(lambda g: msbfs.distance_identity(g.hop_counts()))
    on("nation_topk", "nation_region")(lambda g: g.top_k())
    return q


def _file(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"


def _text_source(spark: SparkSession, sf_dir: str, rest: str = "") -> DataFrame:
    """A graph written as lines of text, read again and normalised."""
    path = _file(spark)
    write_edge_text(raw_edges(spark, sf_dir, "cust_part_q50"), path, rest=rest)
    return normalize.normalize(read_edge_csv(spark, path, header=False, extra_columns=bool(rest)))


def _line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark)
    write_edge_text(raw_edges(spark, sf_dir, "supp_mod"), path)
    return spark.createDataFrame([(line_count(spark, path),)], "n long")


def _workload_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workload of one line per nation."""
    path = _file(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.select(F.format_string("  %d /data/%d.csv %d|%d|%d ", "n_nationkey", "n_regionkey", "n_regionkey", "n_nationkey", "n_regionkey")).write.text(path)
    return read_workload(spark, path)


def _scores_sink(g: Graph) -> DataFrame:
    """Scores written as delimited text and read again."""
    path = _file(g.spark)
    write_scores(g.closeness(), path)
    return g.spark.read.option("sep", "|").option("header", True).schema("v long, reach long, dist_sum long, closeness double").csv(path)


def _trace_lines(g: Graph) -> DataFrame:
    """The lines of a traversal but for its durations."""
    t = g.traversal(words=1)
    traversed = trace.traversed_edges(g.sources(), g.components, g.stats).first()[0]
    lines = trace.trace_lines(g.spark, t, g.n_vertices, g.edges.count(), traversed, "bitmask")
    return lines.filter("metric <> 'TDUR'").drop("total_ms")


def _round_trip(g: Graph) -> DataFrame:
    """Edges encoded to internal ids and decoded again."""
    ids = cut(normalize.dense_ids(g.edges))
    coded = g.edges
    for end in ("src", "dst"):
        coded = coded.join(ids.select(F.col("id").alias(end), F.col("internal_id").alias("_n")), end).withColumn(end, F.col("_n")).drop("_n")
    return normalize.decode(normalize.decode(coded, ids, "src"), ids, "dst").select("src", "dst")


def oracle_sql() -> dict[str, str]:
    edges = lambda g: _base(g) + "select a as src, b as dst from e"
    picked = f"(select v from deg order by {_KEY}, v limit {{n}})"
    batch = "cast(floor(position/64) as bigint) as batch"
    o = {
        "normalize_edges": edges("supp_mod"),
        "normalize_edges_cust_part_q50": edges("cust_part_q50"),
        "decode_ids": edges("cust_part_q50"),
        "dense_ids": _base("cust_part_q50") + "select v as id, dense_rank() over (order by v) - 1 as internal_id from deg",
        "degree": _base("supp_part_q49") + "select v, degree from deg",
        "two_hop_degree": _base("supp_part_q49") + "select e.a as v, cast(sum(degree) as bigint) as n from e join deg on deg.v=e.b group by e.a",
        "component_summary": _base("part_part_q45") + "select count(*) as n, max(n_vertices) as max_size, count(*) filter (n_vertices<5) as n_trivial from stats",
        "hop_counts": _base("supp_part_q49") + "select s as src, d as hop, count(*) as n from r where d>0 group by s,d",
        "hop_counts_bitmask": _base("cust_part_q50") + "select s as src, d as hop, count(*) as n from r where d>0 group by s,d",
        "bfs_reach_dist": _base("part_part_q45") + "select v as src, reach, dist_sum from p",
        "topk_string": _base("supp_part_q49") + "select string_agg(cast(v as varchar), '|' order by component desc, v) as result from (select * from score order by component desc, v limit 7)",
        "sampled_sources": _base("supp_part_q49") + "select v from " + picked.format(n=SAMPLE),
        "sampled_topk": _base("supp_part_q49") + f"select cast(row_number() over (order by component desc, v) as integer) as rank, v, component as closeness from score where v in {picked.format(n=SAMPLE)} order by component desc, v limit 7",
        "order_degree": _base("cust_part_q50") + f"select v, position, {batch} from (select v, row_number() over (order by comp, degree desc, v) - 1 as position from comps join deg using (v))",
        "order_component": _base("cust_part_q50") + f"select v, position, {batch} from (select v, row_number() over (order by n_vertices desc, comp, v) - 1 as position from comps join stats using (comp))",
        "order_two_hop": _base("cust_part_q50") + f"select v, position, {batch} from (select v, row_number() over (order by comp, n desc, v) - 1 as position from comps join (select e.a as v, sum(degree) as n from e join deg on deg.v=e.b group by e.a) using (v))",
        "order_degree_rank": _base("cust_part_q50") + "select v, degree, row_number() over (order by degree desc, v) - 1 as position from deg",
        "order_neighbourhood": _base("cust_part_q50")
        + """, near as (select e.a as v, degree as d, e.b as hub from e join deg on deg.v=e.b union all select v, degree, v from deg),
best as (select v, d, hub from (select *, row_number() over (partition by v order by d desc, hub) as k from near) where k=1)
select v, row_number() over (order by d desc, hub, degree desc, v) - 1 as position from best join deg using (v)""",
        "eccentricity": _base("part_part_q45") + "select v, ecc from p",
        "diameter": _base("part_part_q45") + "select max(ecc) as diameter from p",
        "traversed_edges": _base("cust_part_q50") + "select cast(sum(n_edges) as bigint) as n_edges from comps join stats using (comp)",
        "hop_counts_bottom_up": _base("part_part_q48") + "select s as src, d as hop, count(*) as n from r where d>0 group by s,d",
        "hop_counts_switch": _base("part_part_q48") + "select s as src, d as hop, count(*) as n from r where d>0 group by s,d",
        "frontier_sharing_part_part_q48": _base("part_part_q48") + PLACE + "select d as round, bits, count(*) as n from held group by d, bits",
        "edge_sharing_part_part_q48": _base("part_part_q48")
        + PLACE
        + "select d as round, bits, count(*) as n from (select batch, y.d, e.a, e.b, count(*) as bits from r x join e on x.v=e.a join r y on y.s=x.s and y.v=e.b and y.d=x.d+1 join place on place.v=x.s group by batch, y.d, e.a, e.b) group by d, bits",
        "trace_rounds": _base("supp_part_sparse") + PLACE + ROUNDS + "select cast(round as integer) as round, cast(1 as bigint) as runs, rows from rounds",
        "trace_lines": _base("supp_part_sparse")
        + PLACE
        + ROUNDS
        + """, head as (select (select count(*) from p) as n_vertices, (select count(*) from e) as n_edges, (select cast(sum(n_edges) as bigint) from comps join stats using (comp)) as traversed_edges,
  64 as batch_bits, 'bitmask' as strategy, 1 as width)
select 'TROWS' as metric, cast(round as integer) as round, 'down' as direction, rows as value, head.* from rounds, head
union all select 'TROUNDS', 0, '', (select count(*) from rounds), head.* from head""",
        "scores_sink": _base("supp_part_q49") + "select v, reach, dist_sum, component as closeness from score",
        "topk_string_trailing": _base("supp_part_q49") + "select string_agg(cast(v as varchar), ' ' order by component desc, v) || ' ' as result from (select * from score order by component desc, v limit 7)",
        "text_source": edges("cust_part_q50"),
        "text_source_rest": edges("cust_part_q50"),
        "line_count": f"select count(*) as n from ({GRAPH_SQL['supp_mod']}) t(a,b) where a is not null and b is not null",
        "workload_source": "select cast(n_nationkey as bigint) as num_nodes, '/data/' || n_regionkey || '.csv' as dataset, n_regionkey || '|' || n_nationkey || '|' || n_regionkey as reference from nation",
        "run_summary": """with t as (select 's' || n_regionkey as strategy, count(*) as runs, cast(floor(sum(7*n_nationkey+1) / count(*)) as bigint) as mean_ms, cast(min(7*n_nationkey+1) as bigint) as min_ms from nation group by 1)
select *, cast(mean_ms as double) / cast((select min(mean_ms) from t) as double) as factor from t""",
        "frontier_sharing": _base("nation_region") + "select d as round, bits, count(*) as n from (select d, v, count(*) as bits from r where d>0 group by d, v) group by d, bits",
        "edge_sharing": _base("nation_region")
        + "select d as round, bits, count(*) as n from (select y.d, e.a, e.b, count(*) as bits from r x join e on x.v=e.a join r y on y.s=x.s and y.v=e.b and y.d=x.d+1 group by y.d, e.a, e.b) group by d, bits",
        "batch_usage": _base("supp_part_sparse")
        + PLACE
        + """select batch, max(d) as steps, cast(sum(bits) as double)/cast(count(*) as double) as mean_bits from held group by batch""",
        "induced_subgraph": _base("supp_part_q49") + "select a as src, b as dst from e where a in (select v from deg where degree>=3) and b in (select v from deg where degree>=3)",
        "distance_identity": _base("part_part_q48") + "select v as src, dist_sum as d1, dist_sum as d2 from p",
        "scalar_topk": _topk_sql("supp_part_sparse", "component"),
        "nation_topk": _topk_sql("nation_region", "component"),
    }
    o["order_neighbourhood_batches"] = o["order_neighbourhood"].replace("select v, row_number() over (order by d desc, hub, degree desc, v) - 1 as position", f"select v, position, {batch} from (select v, row_number() over (order by d desc, hub, degree desc, v) - 1 as position") + ")"
    for g in ("cust_part_q50", "part_part_q45", "supp_part_sparse"):
        tail = "" if g == "cust_part_q50" else "_" + g
        o["connected_components" + tail] = _base(g) + "select v, comp from comps"
        o["component_stats" + tail] = _base(g) + "select comp, n_vertices, n_edges from stats"
    o["connected_components_stars"] = o["connected_components_part_part_q45"]
    for name in ("bfs_distances", "bfs_distances_bottom_up", "bfs_distances_switch"):
        o[name] = _base("part_part_q48") + "select s as src, v, d from r"
    for mode in ("component", "global"):
        for g in ("supp_part_q49", "part_part_q45", "cust_part_q50"):
            tail = "" if g == "supp_part_q49" else "_" + g
            o[f"closeness_{mode}{tail}"] = _base(g) + f"select v, reach, dist_sum, {mode} as closeness from score"
            o[f"topk_closeness_{mode}{tail}"] = _topk_sql(g, mode)
        o[f"pruned_topk_{mode}"] = _topk_sql("part_part_q45", mode)
    for name in ("msbfs_topk", "bottom_up_topk", "direction_opt_topk"):
        o[name] = _topk_sql("supp_part_q49", "component")
    return o


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(graph(spark, sf_dir, "supp_part_q49").closeness())
