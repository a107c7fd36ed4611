"""Queries over the test tables, one or more for each operator, and their oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedspread import sources
from seedspread.operators import batch, graph, paths, selection, spatial, spread, topics
from seedspread.operators.probability import hash_coin, trivalency, two_level, uniform

THETA = 0.05
K = 3
#: A rectangle of the test coordinates: centre and half sizes.
BOX = (0.0, 0.0, 0.12, 0.12)
ITEM = [0.4, 0.1, 0.2, 0.1, 0.2]

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}

#: The derived inputs, as SQL.
_EDGES = """
nx as (select user_id as src, event_type as kind, lead(user_id) over (order by ts, event_id) as dst, lead(event_type) over (order by ts, event_id) as nkind from events),
pairs as (select kind, src, dst from nx where nkind = 'purchase' and src <> dst),
cnt as (select src, dst, count(*) as c from pairs where kind = 'click' group by 1, 2),
ind as (select dst, sum(c) as deg from cnt group by 1),
e as (select cnt.src, cnt.dst, c, 1 - pow(1 - 1.0 / deg, c) as p from cnt join ind using (dst)),
v as (select src as vid from e union select dst from e)"""
_TEDGES = """
nx as (select user_id as src, event_type as kind, lead(user_id) over (order by ts, event_id) as dst, lead(event_type) over (order by ts, event_id) as nkind from events),
pairs as (select kind, src, dst from nx where nkind = 'purchase' and src <> dst),
deg as (select dst, count(*) as deg from pairs group by 1),
te as (select src, p.dst, [sum(case when kind = t then 1 else 0 end)::double / any_value(deg) for t in ['click', 'error', 'purchase', 'signup', 'view']] as w from pairs p join deg using (dst) group by 1, 2)"""
_TEDGES = _TEDGES.replace(
    "[sum(case when kind = t then 1 else 0 end)::double / any_value(deg) for t in ['click', 'error', 'purchase', 'signup', 'view']]",
    "[" + ", ".join(f"sum(case when kind = '{t}' then 1 else 0 end)::double / any_value(deg)" for t in sources.TOPICS) + "]",
)
_LOC = "loc as (select vec_id as user_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)"
_NATIVE = f"native as (select user_id as vid from loc where x between {BOX[0] - BOX[2]} and {BOX[0] + BOX[2]} and y between {BOX[1] - BOX[3]} and {BOX[1] + BOX[3]})"


def _closure_sql(edges: str = "e", theta: float = THETA, compare: str = ">") -> str:
    return f"""
paths(s, t, p) as (select vid, vid, 1.0::double from v union select paths.s, g.dst, round(paths.p * g.p, 12) from paths join {edges} g on g.src = paths.t where paths.p * g.p {compare} {theta}),
mip as (select s, t, max(p) as p from paths group by 1, 2)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _mip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.closure(sources.ic_edges(spark, sf_dir), THETA)


def _kept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ic_edges`` computed once, for queries that go over them more than once: deriving them reads and orders all events."""
    return selection.checkpointed(sources.ic_edges(spark, sf_dir))


def _natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.natives(sources.locations(spark, sf_dir), *BOX)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"with {_EDGES} select src, dst, c, round(p, 6) as p from e")
def weighted_cascade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sources.ic_edges(spark, sf_dir), "p")


@query(f"with {_EDGES} select dst, count(*)::bigint as n, max(p) > 0 as live, round(max(1 - pow(0.99, c)), 6) as uniform from e group by 1")
def uniform_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sources.ic_edges(spark, sf_dir)
    return e.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), (F.max("p") > 0).alias("live"), F.round(F.max(uniform(F.col("c"))), 6).alias("uniform"))


@query(
    f"with {_EDGES}, coin as (select src, dst, concat('0x', substr(md5(concat(src, '-', dst)), 1, 8))::bigint / 4294967296.0 as coin from e) "
    "select src, dst, round(coin, 6) as coin, [0.2, 0.04, 0.008][floor(coin * 3)::int + 1]::double as p from coin"
)
def trivalency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, key = sources.ic_edges(spark, sf_dir), (F.col("src"), F.col("dst"))
    return e.select("src", "dst", F.round(hash_coin(*key), 6).alias("coin"), trivalency(*key).alias("p"))


@query(f"with {_EDGES} select a.src, a.dst, case when a.p > coalesce(b.p, 0) then 0.1 else 0.01 end::double as p from e a left join e b on a.src = b.dst and a.dst = b.src")
def two_level_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sources.ic_edges(spark, sf_dir)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("back"))
    return e.join(back, ["src", "dst"], "left").select("src", "dst", two_level(F.col("p"), F.coalesce("back", F.lit(0.0))).alias("p"))


def _uv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.ic_edges(spark, sf_dir).select(F.col("src").alias("u"), F.col("dst").alias("v"))


_COIN = "concat('0x', substr(md5(concat({0}, '-', {1})), 1, 8))::bigint / 4294967296.0"


@query(f"with {_EDGES}, d as (select vid, count(*) as degree from (select src as vid from e union all select dst from e) group by 1) select src, dst, round(1 / degree, 6) as p from e join d on dst = vid")
def directed_cascade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sources.directed_cascade(_uv(spark, sf_dir)), "p")


@query(
    f"with {_EDGES}, n as (select least(src, dst) as u, greatest(src, dst) as v, count(*) as c, {_COIN.format('least(src, dst)', 'greatest(src, dst)')} < 0.5 as up from e group by 1, 2) "
    "select u as src, v as dst, round(1 - pow(1 - case when up then 0.1 else 0.01 end, c), 6) as p from n union all select v, u, round(1 - pow(1 - case when up then 0.01 else 0.1 end, c), 6) from n"
)
def random_orientation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sources.random_orientation(_uv(spark, sf_dir)), "p")


@query(f"with {_EDGES}, n as (select distinct least(src, dst) as u, greatest(src, dst) as v from e), t as (select u, v, [0.2, 0.04, 0.008][floor({_COIN.format('u', 'v')} * 3)::int + 1]::double as p from n) select u as src, v as dst, p from t union all select v, u, p from t")
def undirected_trivalency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.undirected_trivalency(_uv(spark, sf_dir))


@query(f"with {_EDGES} select src, dst, [0.2, 0.04, 0.008][floor({_COIN.format('src', 'dst')} * 3)::int + 1]::double as p from e")
def directed_trivalency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.directed_trivalency(_uv(spark, sf_dir))


@query(f"with {_EDGES}, all_ as (select src, dst, p from e union all select dst, src, p / 2 from e) select src, dst, round(max(p), 6) as p from all_ where p > 0 group by 1, 2")
def strongest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sources.ic_edges(spark, sf_dir)
    both = e.select("src", "dst", "p").union(e.select("dst", "src", F.col("p") / 2))
    return _rounded(sources.strongest(both), "p")


@query(f"with {_EDGES}, b as (select src, dst from e union all select dst, src from e) select src, dst, count(*)::bigint as c from b group by 1, 2")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.undirected(sources.ic_edges(spark, sf_dir).select(F.col("src").alias("u"), F.col("dst").alias("v")))


@query(f"with {_TEDGES} select src, dst, round(list_max(w), 6) as top, round(list_sum(w), 6) as total from te")
def topic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = sources.topic_edges(spark, sf_dir)
    return te.select("src", "dst", F.round(F.array_max("w"), 6).alias("top"), F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"with {_TEDGES} select count(distinct vid)::bigint as n, (select count(*) from te)::bigint as m, 5::bigint as z, (select round(avg(list_max(w)), 6) from te) as mean_max from (select src as vid from te union select dst from te)")
def topic_graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(topics.topic_statistics(sources.topic_edges(spark, sf_dir)), "mean_max")


_ITEM_EDGES = f"{_TEDGES}, e as (select src, dst, least(1.0, list_dot_product(w, {ITEM}::double[])) as p from te where list_dot_product(w, {ITEM}::double[]) > 0), v as (select src as vid from e union select dst from e)"


@query(
    f"with {_ITEM_EDGES} select least(src, dst) as u, greatest(src, dst) as v, round(max(case when src < dst then p else 0 end), 6) as p, round(max(case when src > dst then p else 0 end), 6) as p_back from e group by 1, 2"
)
def topic_item_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(topics.both_directions(topics.for_item(sources.topic_edges(spark, sf_dir), ITEM)), "p", "p_back")


@query(f"with {_EDGES} select vid, count(src)::bigint as degree, round(coalesce(sum(p), 0), 6) as weighted from v left join e on vid = src group by 1")
def vertex_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.degrees(sources.ic_edges(spark, sf_dir)), "weighted")


_PARTS = "both_ as (select src as a, dst as b from e union select dst, src from e), reach(a, b) as (select vid, vid from v union select r.a, b2.b from reach r join both_ b2 on b2.a = r.b), part as (select a as vid, min(b) as component from reach group by 1)"


@query(f"with recursive {_EDGES}, {_PARTS} select vid, component from part")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(sources.ic_edges(spark, sf_dir))


@query(
    f"with recursive {_EDGES}, {_PARTS}, d as (select vid, count(src) as degree from v left join e on vid = src group by 1), sz as (select component, count(*) as size from part group by 1) "
    "select n::bigint as n, m::bigint as m, round(mean_degree, 6) as mean_degree, max_degree::bigint as max_degree, components::bigint as components, largest_component::bigint as largest_component, round(mean_component, 6) as mean_component, round(m / n / (n - 1), 6) as density "
    "from (select count(*) as n, sum(degree) as m, avg(degree) as mean_degree, max(degree) as max_degree from d), (select count(*) as components, max(size) as largest_component, avg(size) as mean_component from sz)"
)
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.statistics(sources.ic_edges(spark, sf_dir)), "mean_degree", "mean_component", "density")


_ROUNDS = 5


def _pagerank_sql() -> str:
    steps = ["r0 as (select vid, 1.0::double as rank from v)", "al as (select dst, sum(p) as a from e group by 1)", "sh as (select src, e.dst, p / a as share from e join al using (dst))"]
    for i in range(1, _ROUNDS + 1):
        steps.append(f"r{i} as (select v.vid, 0.15 + 0.85 * coalesce(sum(r.rank * share), 0) as rank from v left join sh on v.vid = sh.src left join r{i - 1} r on r.vid = sh.dst group by 1)")
    return f"with {_EDGES}, {', '.join(steps)} select vid, round(rank, 6) as rank from r{_ROUNDS}"


@query(_pagerank_sql())
def pagerank_five_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.pagerank(sources.ic_edges(spark, sf_dir), tolerance=-1.0, rounds=_ROUNDS), "rank")


#: Rounds until the ranks' changes sum up to 1e-3 at most.
_RANK_SQL = """al as (select dst, sum(p) as a from e group by 1),
sh as (select src, e.dst, p / a as share from e join al using (dst)),
rr(i, vid, rank, change) as (
  select 0, vid, 1.0::double, 1.0::double from v
  union all
  select i, vid, rank, sum(abs(rank - old)) over () from (
    select o.i + 1 as i, o.vid, o.rank as old, 0.15 + 0.85 * coalesce(got, 0) as rank, o.change
    from rr o left join (select src as vid, sum(rank * share) as got from sh join rr on rr.vid = sh.dst group by 1) g on g.vid = o.vid where o.change > 1e-3)),
pr as (select vid, rank from rr where i = (select max(i) from rr))"""


@query(f"with recursive {_EDGES}, {_RANK_SQL} select vid, round(rank, 6) as rank from pr")
def pagerank_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks at the fixed point; ``pagerank_five_rounds`` is its first rounds, as SQL can unroll them."""
    return _rounded(graph.pagerank(_kept_edges(spark, sf_dir)), "rank")


@query(f"with recursive {_EDGES}, {_closure_sql()} select s, t as v, round(p, 6) as p from mip")
def bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_mip(spark, sf_dir).select("s", "v", "p"), "p")


@query(f"with recursive {_EDGES}, er as (select dst as src, src as dst, p from e), {_closure_sql('er')} select s as root, count(*)::bigint as size, round(sum(p), 6) as total from mip group by 1")
def in_tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = paths.closure(paths.reverse(sources.ic_edges(spark, sf_dir)), THETA)
    return trees.groupBy(F.col("s").alias("root")).agg(F.count(F.lit(1)).alias("size"), F.round(F.sum("p"), 6).alias("total"))


@query(f"with recursive {_EDGES}, {_closure_sql()}, sz as (select t, count(*) as n from mip group by 1) select round(avg(n * n), 6) as tree_size from sz")
def tree_size_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _mip(spark, sf_dir).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.round(F.avg(F.col("n") * F.col("n")), 6).alias("tree_size"))


@query(f"with {_LOC}, {_NATIVE} select vid from native")
def rectangle_natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _natives(spark, sf_dir)


_BOXES = [(1, 0.0, 0.0, 0.12, 0.12, 3), (2, 0.1, -0.1, 0.1, 0.2, 5), (3, -0.2, 0.2, 0.05, 0.05, 2), (4, 0.0, 0.0, 1.0, 1.0, 5000)]
_BOX_SQL = "q(qid, cx, cy, hx, hy, k) as (values " + ", ".join(f"({a}, {b}::double, {c}::double, {d}::double, {e}::double, {k})" for a, b, c, d, e, k in _BOXES) + ")"


def _boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BOXES, "qid long, cx double, cy double, hx double, hy double, k int")


@query(f"with {_LOC}, {_BOX_SQL} select qid::bigint as qid, user_id as vid from q join loc on x between cx - hx and cx + hx and y between cy - hy and cy + hy")
def natives_of_many_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.natives_of(sources.locations(spark, sf_dir), _boxes(spark))


@query(f"with {_LOC}, {_BOX_SQL}, n as (select qid, count(*) as n from q join loc on x between cx - hx and cx + hx and y between cy - hy and cy + hy group by 1) select qid::bigint as qid, k::int as k from q join n using (qid) where k <= 5000 and k <= n")
def admitted_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark)
    return spatial.admitted(spatial.natives_of(sources.locations(spark, sf_dir), boxes), boxes).select("qid", "k")


def _quadtree_sql(capacity: int) -> str:
    """Users by the node that keeps them: a node's first users by id stay, the others go on to a quadrant."""
    east, north = "x > cx", "y >= cy"
    return f"""
here(user_id, x, y, path, cx, cy, hx, hy, n) as (
  select user_id, x, y, '', 0.0::double, 0.0::double, 1.0::double, 1.0::double, row_number() over (order by user_id) from loc where x between -1 and 1 and y between -1 and 1
  union all
  select user_id, x, y, path, cx, cy, hx, hy, row_number() over (partition by path order by user_id) from (
    select user_id, x, y, concat(path, case when {north} then 'N' else 'S' end, case when {east} then 'E' else 'W' end) as path,
      cx + case when {east} then hx / 2 else -hx / 2 end as cx, cy + case when {north} then hy / 2 else -hy / 2 end as cy, hx / 2 as hx, hy / 2 as hy from here where n > {capacity})),
kept as (select user_id, path from here where n <= {capacity})"""


@query(f"with recursive {_LOC}, {_quadtree_sql(100)} select user_id, path from kept")
def quadtree_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.quadtree(sources.locations(spark, sf_dir), capacity=100)


_FIRST = "first as (select s as vid, sum(p) as gain from mip where t in (select vid from native) group by 1)"


@query(f"with recursive {_EDGES}, {_closure_sql()}, {_LOC}, {_NATIVE}, {_FIRST} select row_number() over (order by round(gain, 9) desc, vid)::int as rank, vid, round(gain, 6) as gain from first qualify rank <= 10")
def location_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.top(_rounded9(selection.first_gains(_mip(spark, sf_dir), _natives(spark, sf_dir))), 10, "gain"), "gain")


def _rounded9(scores: DataFrame) -> DataFrame:
    return scores.withColumn("gain", F.round("gain", 9))


def _estimate_sql(k: int) -> str:
    """Greedy on sum p (1 - ap), with ap(v) = 1 - prod(1 - p) over the seeds, k rounds."""
    steps = ["nm as (select s, t, p from mip where t in (select vid from native))", "a0 as (select distinct t, 0.0::double as ap from nm)"]
    for i in range(1, k + 1):
        taken = "".join(f" and s not in (select vid from s{j})" for j in range(1, i))
        steps.append(f"s{i} as (select s as vid, round(sum(p * (1 - ap)), 9) as gain from nm join a{i - 1} using (t) where true{taken} group by 1 order by 2 desc, 1 limit 1)")
        steps.append(f"a{i} as (select a.t, 1 - (1 - ap) * (1 - coalesce(nm.p, 0)) as ap from a{i - 1} a left join nm on nm.t = a.t and nm.s in (select vid from s{i}))")
    return ", ".join(steps) + " " + " union all ".join(f"select {i}::int as rank, vid, round(gain, 6) as gain from s{i}" for i in range(1, k + 1))


@query(f"with recursive {_EDGES}, {_closure_sql()}, {_LOC}, {_NATIVE}, {_estimate_sql(K)}")
def location_estimate_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by upper gains, where seeds activate a native independently."""
    native = _natives(spark, sf_dir).withColumnRenamed("vid", "v")
    reach = selection.checkpointed(_mip(spark, sf_dir).join(native, "v", "left_semi").select("s", "v", "p"))
    ap, chosen = reach.select("v", F.lit(0.0).alias("ap")).distinct(), []
    for _ in range(K):
        taken = [v for v, _ in chosen]
        scores = _rounded9(selection.upper_gains(reach.where(~F.col("s").isin(taken)) if taken else reach, ap))
        row = scores.orderBy(F.desc("gain"), "vid").limit(1).collect()
        if not row:
            break
        chosen.append((row[0].vid, row[0].gain))
        hit = reach.where(F.col("s") == row[0].vid).select("v", F.col("p").alias("hit"))
        ap = selection.checkpointed(ap.join(hit, "v", "left").select("v", (1 - (1 - F.col("ap")) * (1 - F.coalesce("hit", F.lit(0.0)))).alias("ap")))
    rows = [(i, v, round(g, 6)) for i, (v, g) in enumerate(chosen, 1)]
    return spark.createDataFrame(rows, "rank int, vid long, gain double")


def _routes_sql(name: str, edges: str, starts: str, stay: str = "true", deepest: int = 40) -> str:
    """``name`` (s, t, p, hops, parent): best paths as the closure finds them, ties to fewest hops and least parents; one of more edges
    than ``deepest``, which the test graphs don't have, would be missed. ``stay``: a condition on w (a path so far), g (its next edge)."""
    return f"""
{name}_w(s, t, p, hops, parent) as (select vid, vid, 1.0::double, 0, vid from {starts} union select w.s, g.dst, w.p * g.p, w.hops + 1, w.t from {name}_w w join {edges} g on g.src = w.t where w.p * g.p > {THETA} and g.dst <> w.s and w.hops < {deepest} and {stay}),
{name} as (select * from {name}_w qualify row_number() over (partition by s, t order by p desc, hops, parent) = 1)"""


def _first_sql(routes: str, seed: str, counted: str = "true") -> str:
    return f"s1 as (select {seed} as vid, sum(p) as gain from {routes} where {counted} group by 1 order by round(sum(p), 9) desc, 1 limit 1)"


_PAIR_END = "select 1::int as rank, vid, round(gain, 6) as gain from s1 union all select 2::int, vid, round(gain, 6) from s2"
#: Two seeds by expansion: the first one's path to a native goes on as the second's from where they meet.
_EXPANSION_PAIR = f"""{_routes_sql("f", "e", "v2")}, {_first_sql("f", "s", "t in (select vid from native)")},
{_routes_sql("f2", "e", "v2", "g.dst <> (select vid from s1) and w.s <> (select vid from s1)")},
one as (select f.* from f join s1 on s = vid),
goal2 as (select s, t, p from f2 where t in (select vid from native) and s <> (select vid from s1)),
way2(s, t, a) as (select s, t, t from goal2 union all select w.s, w.t, f2.parent from way2 w join f2 on f2.s = w.s and f2.t = w.a where w.a <> w.s),
way1(t, a) as (select t, t from one where t in (select vid from native) union all select w.t, one.parent from way1 w join one on one.t = w.a where one.hops > 0),
meet as (select w.s, w.t, arg_min(w.a, one.hops) as m from way2 w join way1 o on o.t = w.t and o.a = w.a join one on one.t = w.a group by 1, 2),
s2 as (select g.s as vid, sum(case when m is null then g.p else (1 - (1 - a.p) * (1 - b.p)) * g.p / b.p - n.p end) as gain from goal2 g left join meet on meet.s = g.s and meet.t = g.t
  left join one a on a.t = m left join f2 b on b.s = g.s and b.t = m left join one n on n.t = g.t group by 1 order by round(gain, 9) desc, 1 limit 1)
{_PAIR_END}"""


def _tree_pair_sql(roots: str, blocked: bool) -> str:
    """Two seeds on in-trees: what the second adds to a root is cut by the first one's activation of the vertex where both paths meet.
    ``blocked``: paths don't go on past the first seed."""
    stay = "w.t <> (select vid from s1)" if blocked else "true"
    return f"""er as (select dst as src, src as dst, p from e), {_routes_sql("r", "er", roots)}, {_first_sql("r", "t")},
{_routes_sql("r2", "er", roots, stay)},
one as (select r2.* from r2 join s1 on t = vid),
way2(s, t, a) as (select s, t, t from r2 union all select w.s, w.t, r2.parent from way2 w join r2 on r2.s = w.s and r2.t = w.a where w.a <> w.s),
meet as (select u.s, u.t, arg_max(u.a, c.hops) as m from way2 u join way2 o on o.s = u.s and o.a = u.a and o.t = (select vid from s1) join r2 c on c.s = u.s and c.t = u.a group by 1, 2),
s2 as (select g.t as vid, sum(g.p * case when m is null then 1 else 1 - one.p / b.p end) as gain from r2 g left join meet on meet.s = g.s and meet.t = g.t
  left join r2 b on b.s = g.s and b.t = m left join one on one.s = g.s where g.t <> (select vid from s1) and g.s <> (select vid from s1) group by 1 order by round(gain, 9) desc, 1 limit 1)
{_PAIR_END}"""


_ALL_STARTS = "v2 as (select vid from v union select vid from native)"


@query(f"with recursive {_EDGES}, {_LOC}, {_NATIVE}, {_ALL_STARTS}, {_EXPANSION_PAIR}")
def location_expansion_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two seeds of ``location_expansion``."""
    return _rounded(selection.expansion(sources.ic_edges(spark, sf_dir), 2, THETA, _natives(spark, sf_dir)), "gain")


@query(f"with recursive {_EDGES}, {_LOC}, {_NATIVE}, {_ALL_STARTS}, {_EXPANSION_PAIR}")
def location_assembly_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two seeds of ``location_assembly``."""
    e, placed, base, lists = _listed_paths(spark, sf_dir)
    return _rounded(selection.assembly(e, 2, THETA, placed, lists, base), "gain")


@query(f"with recursive {_EDGES}, {_LOC}, {_NATIVE}, {_tree_pair_sql('native', True)}")
def location_pmia_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two seeds of ``location_pmia``."""
    return _rounded(selection.pmia(sources.ic_edges(spark, sf_dir), 2, THETA, _natives(spark, sf_dir)), "gain")


@query(f"with recursive {_EDGES}, {_tree_pair_sql('v', True)}")
def pmia_seed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two seeds of ``pmia_seeds``."""
    return _rounded(selection.pmia(sources.ic_edges(spark, sf_dir), 2, THETA), "gain")


@query(f"with recursive {_EDGES}, {_tree_pair_sql('v', False)}")
def mia_seed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two seeds of ``mia_seeds``."""
    return _rounded(selection.mia(sources.ic_edges(spark, sf_dir), 2, THETA), "gain")


@query()
def location_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best seeds for the users of a rectangle, by exact gains on the union of the seeds' paths to them."""
    return _rounded(selection.expansion(sources.ic_edges(spark, sf_dir), K, THETA, _natives(spark, sf_dir)), "gain")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = sources.locations(spark, sf_dir)
    return selection.checkpointed(spatial.native_regions(spatial.quadtree(users, capacity=20), users, BOX))


def _lists(spark: SparkSession, sf_dir: str, placed: DataFrame) -> DataFrame:
    return selection.checkpointed(selection.region_lists(_mip(spark, sf_dir), placed))


def _listed_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges, placed natives, the stored paths to them, and lists of regions: paths are searched for once, for lists and for rounds."""
    e, placed = _kept_edges(spark, sf_dir), _placed(spark, sf_dir)
    base = selection.checkpointed(batch.stored_paths(e, THETA, placed).join(placed.select(F.col("vid").alias("v")).distinct(), "v", "left_semi"))
    return e, placed, base, selection.checkpointed(selection.region_lists(selection.reached_by_vertices(base, e), placed))


@query(f"with {_LOC}, {_NATIVE} select vid, round(x, 6) as x, round(y, 6) as y from native join loc on vid = user_id")
def rectangle_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(spatial.native_locations(sources.locations(spark, sf_dir), *BOX), "x", "y")


def _held_sql(cx: str, cy: str, hx: str, hy: str) -> str:
    """Whether ``BOX`` strictly contains a cell."""
    x, y, w, h = BOX
    return f"({cx} + {hx} < {x + w} and {cx} - {hx} > {x - w} and {cy} + {hy} < {y + h} and {cy} - {hy} > {y - h})"


_REGIONS_SQL = f"""{_quadtree_sql(20)},
node as (select distinct path, cx, cy, hx, hy from here),
region as (select a.path as rid from node a left join node b on b.path = left(a.path, greatest(length(a.path) - 2, 0)) and a.path <> ''
  where {_held_sql("a.cx", "a.cy", "a.hx", "a.hy")} and (a.path = '' or not {_held_sql("b.cx", "b.cy", "b.hx", "b.hy")})),
placed as (select vid, rid from native join kept on vid = user_id left join region on starts_with(path, rid))"""


@query(f"with recursive {_LOC}, {_NATIVE}, {_REGIONS_SQL} select vid, rid from placed")
def rectangle_natives_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle's users with the covered region that they are in, null for the fringe; regions are the quadtree's."""
    return _placed(spark, sf_dir)


@query(
    f"with recursive {_EDGES}, {_closure_sql()}, {_LOC}, {_NATIVE}, {_REGIONS_SQL}, sums as (select coalesce(rid, 'fringe') as rid, s as vid, sum(p) as gain from (select * from mip union select vid, vid, 1.0::double from placed) m join placed on t = vid group by 1, 2) "
    "select rid, vid, round(gain, 6) as gain from sums qualify row_number() over (partition by rid order by round(gain, 9) desc, vid) = 1"
)
def region_first_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best seed of each region of a rectangle for that region alone, all regions side by side."""
    found = selection.region_seeds(sources.ic_edges(spark, sf_dir), THETA, _placed(spark, sf_dir), 1)
    return _rounded(found.select("rid", "vid", "gain"), "gain")


@query()
def region_best_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best seeds of each region of a rectangle for that region alone."""
    return _rounded(selection.region_seeds(sources.ic_edges(spark, sf_dir), THETA, _placed(spark, sf_dir), K), "gain")


#: A rectangle around the users of each label, each with a number of seeds of its own.
_LABEL_SQL = "q as (select label::bigint as qid, avg(x) as cx, avg(y) as cy, 0.08::double as hx, 0.1::double as hy, (1 + label % 3)::int as k from (select embedding[1]::double as x, embedding[2]::double as y, label from embeddings where label is not null) group by label)"


def _label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = sources.table(spark, sf_dir, "embeddings").where("label is not null")
    x, y = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    boxes = e.groupBy(F.col("label").cast("long").alias("qid")).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
    return selection.checkpointed(boxes.select("qid", "cx", "cy", F.lit(0.08).alias("hx"), F.lit(0.1).alias("hy"), (1 + F.col("qid") % 3).cast("int").alias("k")))


def _rectangle_seeds(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    found = selection.checkpointed(spatial.natives_of(sources.locations(spark, sf_dir), queries))
    admitted = spatial.admitted(found, queries).select("qid", "k")
    return _rounded(batch.expansions(sources.ic_edges(spark, sf_dir), admitted, found.join(admitted, "qid", "left_semi"), THETA), "gain")


@query()
def rectangle_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of rectangles, each with its own number of seeds, answered side by side."""
    return _rectangle_seeds(spark, sf_dir, _label_boxes(spark, sf_dir))


@query(
    f"with recursive {_EDGES}, {_closure_sql()}, {_LOC}, {_LABEL_SQL}, sums as (select qid, s as vid, sum(p) as gain from (select * from mip union select user_id, user_id, 1.0::double from loc) m join loc on t = user_id join q on x between cx - hx and cx + hx and y between cy - hy and cy + hy group by 1, 2) "
    "select qid, 1::int as rank, vid, round(gain, 6) as gain from sums qualify row_number() over (partition by qid order by round(gain, 9) desc, vid) = 1"
)
def rectangle_first_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best seed of each rectangle of the stream."""
    return _rectangle_seeds(spark, sf_dir, _label_boxes(spark, sf_dir).withColumn("k", F.lit(1)))


@query(
    f"with recursive {_EDGES}, {_closure_sql()}, sums as (select bound, s as vid, sum(p) as gain from mip join (values (10), (20)) b(bound) on p > 1.0 / bound or s = t group by 1, 2) "
    "select bound::bigint as bound, 1::int as rank, vid, round(gain, 6) as gain from sums qualify row_number() over (partition by bound order by round(gain, 9) desc, vid) = 1"
)
def theta_sweep_first_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best seed at each of two thetas, side by side."""
    return _rounded(selection.swept(sources.ic_edges(spark, sf_dir), 1, (10, 40)), "gain")


@query(f"with recursive {_EDGES}, {_closure_sql()}, {_LOC}, {_NATIVE}, {_FIRST} select row_number() over (order by round(gain, 9) desc, vid)::int as rank, vid, round(gain, 6) as gain from first qualify rank <= 5")
def merged_region_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best first seeds from sorted lists of regions, merged down to the depth that decides."""
    lists = _lists(spark, sf_dir, _placed(spark, sf_dir))
    best = selection.merged_top(lists, 10, 4)
    return _rounded(selection.top(_rounded9(best), 5, "gain"), "gain")


@query()
def location_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``location_expansion``, with first gains from the lists of regions."""
    e, placed, base, lists = _listed_paths(spark, sf_dir)
    return _rounded(selection.assembly(e, K, THETA, placed, lists, base), "gain")


@query()
def location_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged seeds of the covered regions and of the fringe, if they reach 0.8 of the upper bound."""
    e, placed, base, lists = _listed_paths(spark, sf_dir)
    ready = selection.checkpointed(selection.region_seeds(e, THETA, placed, K, base=base))
    return selection.hinted(e, K, THETA, placed, lists, ready, 0.8, base).select("rank", "vid")


@query()
def location_hint_by_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``location_hint``, with a lower bound from the seeds alone."""
    e, placed, base, lists = _listed_paths(spark, sf_dir)
    return selection.hinted_by_bounds(e, K, THETA, placed, lists, 0.8, base).select("rank", "vid")


@query()
def location_pmia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.pmia(sources.ic_edges(spark, sf_dir), K, THETA, _natives(spark, sf_dir)), "gain")


@query()
def pmia_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.pmia(sources.ic_edges(spark, sf_dir), K, THETA), "gain")


@query()
def mia_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.mia(sources.ic_edges(spark, sf_dir), K, THETA), "gain")


@query(f"with {_EDGES}, d as (select vid, count(src)::bigint as degree from v left join e on vid = src group by 1) select row_number() over (order by degree desc, vid)::int as rank, vid, degree from d qualify rank <= 10")
def degree_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.by_degree(sources.ic_edges(spark, sf_dir), 10)


@query(f"with {_EDGES}, d as (select vid, round(coalesce(sum(p), 0), 9) as w from v left join e on vid = src group by 1) select row_number() over (order by w desc, vid)::int as rank, vid, round(w, 6) as weighted from d qualify rank <= 10")
def weighted_degree_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    degrees = graph.degrees(sources.ic_edges(spark, sf_dir)).withColumn("weighted", F.round("weighted", 9))
    return _rounded(selection.top(degrees, 10, "weighted"), "weighted")


@query(f"with recursive {_EDGES}, {_RANK_SQL} select row_number() over (order by round(rank, 9) desc, vid)::int as rank, vid, round(rank, 6) as score from pr qualify row_number() over (order by round(rank, 9) desc, vid) <= 10")
def pagerank_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.by_pagerank(_kept_edges(spark, sf_dir), 10), "score")


@query(
    f"with recursive {_EDGES}, {_closure_sql()}, {_LOC}, {_NATIVE}, nm as (select s, t, p from mip where t in (select vid from native)), best as (select s, row_number() over (order by round(sum(p), 9) desc, s) as rank from nm group by 1 qualify rank <= 10), "
    "firsts as (select t, arg_min(p, rank) as p from nm join best using (s) group by 1) select round(sum(p), 6) as bound from firsts"
)
def claimed_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the natives' best ten vertices alone reach at least together."""
    reach = _mip(spark, sf_dir).join(_natives(spark, sf_dir).withColumnRenamed("vid", "v"), "v", "left_semi")
    ranked = selection.top(_rounded9(selection.first_gains(reach)), 10, "gain")
    return _rounded(selection.claimed(reach, ranked), "bound")


@query(
    f"with recursive {_EDGES}, {_RANK_SQL}, a as (select vid from pr order by round(rank, 9) desc, vid limit 10), d as (select vid, count(src) as degree from v left join e on vid = src group by 1), "
    "b as (select vid from d order by degree desc, vid limit 10) select count(a.vid) / count(*)::double as accuracy from b left join a using (vid)"
)
def seed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the best ten by degree that are among the best ten by PageRank."""
    e = _kept_edges(spark, sf_dir)
    return selection.overlap(selection.by_degree(e, 10), selection.by_pagerank(e, 10))


@query(f"with {_EDGES}, d as (select vid, concat('0x', substr(md5(concat(0, '-', vid)), 1, 8))::bigint / 4294967296.0 as coin from v) select row_number() over (order by coin desc, vid)::int as rank, vid, round(coin, 6) as coin from d qualify rank <= 10")
def random_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.at_random(sources.ic_edges(spark, sf_dir), 10), "coin")


def _discount_sql(k: int) -> str:
    steps = ["d as (select vid, count(src)::double as deg from v left join e on vid = src group by 1)"]
    for i in range(1, k + 1):
        taken = " union all ".join(f"select vid from s{j}" for j in range(1, i)) or "select null::bigint as vid where false"
        steps.append(
            f"s{i} as (with tk as ({taken}), t as (select dst as vid, sum(c)::double as t from e where src in (select vid from tk) group by 1) "
            "select vid, deg - 2 * coalesce(t, 0) - 0.01 * coalesce(t, 0) * (deg - coalesce(t, 0)) as gain from d left join t using (vid) where vid not in (select vid from tk) order by 2 desc, 1 limit 1)"
        )
    return ", ".join(steps) + " " + " union all ".join(f"select {i}::int as rank, vid, round(gain, 6) as gain from s{i}" for i in range(1, k + 1))


@query(f"with {_EDGES}, {_discount_sql(5)}")
def degree_discount_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.degree_discount_seeds(_kept_edges(spark, sf_dir), 5), "gain")


_RUNS = 20
_SEED_SQL = "top as (select vid from (select vid, count(src) as degree from v left join e on vid = src group by 1) order by degree desc, vid limit 5)"
_LIVE_SQL = f"live as (select r.range as run, src, dst from range({_RUNS}) r, e where concat('0x', substr(md5(concat(r.range, '-', src, '-', dst)), 1, 8))::bigint / 4294967296.0 < p), act(run, vid) as (select r.range, vid from range({_RUNS}) r, top union select act.run, live.dst from act join live on live.run = act.run and live.src = act.vid)"


@query(f"with recursive {_EDGES}, {_SEED_SQL}, {_LIVE_SQL} select round(count(*) / {_RUNS}.0, 6)::double as spread from act")
def monte_carlo_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kept_edges(spark, sf_dir)
    return _rounded(spread.monte_carlo(e, selection.by_degree(e, 5), _RUNS), "spread")


@query(f"with recursive {_EDGES}, {_LOC}, {_NATIVE}, {_SEED_SQL}, {_LIVE_SQL} select round(count(*) / {_RUNS}.0, 6)::double as spread from act where vid in (select vid from native)")
def monte_carlo_native_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kept_edges(spark, sf_dir)
    return _rounded(spread.monte_carlo(e, selection.by_degree(e, 5), _RUNS, _natives(spark, sf_dir)), "spread")


def _rings_sql(rings: int = 15) -> str:
    """Rings of vertices by distance from the seeds, unrolled; more than the test graphs have."""
    steps = ["r0 as (select vid, 0::int as ring, 1.0::double as p, 0.0::double as late from top)"]
    for i in range(1, rings):
        seen = " union all ".join(f"select vid from r{j}" for j in range(i))
        steps.append(f"a{i} as (select dst as vid, 1 - product(1 - e.p * r.p) as p from r{i - 1} r join e on r.vid = src where dst not in ({seen}) group by 1)")
        given = f"select vid, p as of from a{i} union all select vid, late from r{i - 1}"
        steps.append(f"l{i} as (select dst as vid, product(1 - e.p * of) as rest from ({given}) g join e on g.vid = src group by 1)")
        steps.append(f"r{i} as (select vid, {i}::int as ring, p, (1 - p) * (1 - coalesce(rest, 1)) as late from a{i} left join l{i} using (vid))")
    return ", ".join(steps) + ", rings as (" + " union all ".join(f"select * from r{i}" for i in range(rings)) + ")"


@query(f"with {_EDGES}, {_SEED_SQL}, {_rings_sql()} select vid, ring, round(p, 6) as p from rings")
def shortest_path_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kept_edges(spark, sf_dir)
    return _rounded(spread.shortest_path_model(e, selection.by_degree(e, 5)), "p")


@query(f"with {_EDGES}, {_SEED_SQL}, {_rings_sql()} select vid, ring, round(p, 6) as p, round(late, 6) as late from rings")
def shortest_path_plus_one_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kept_edges(spark, sf_dir)
    return _rounded(spread.shortest_path_plus_one_model(e, selection.by_degree(e, 5)), "p", "late")


_CURVE_SQL = _SEED_SQL.replace("top as (select vid from", "top as (select vid, row_number() over (order by degree desc, vid)::int as rank from")
_CURVE_LIVE = _LIVE_SQL.replace("act(run, vid) as (select r.range, vid from", "act(run, vid, rank) as (select r.range, vid, rank from").replace("select act.run, live.dst from", "select act.run, live.dst, act.rank from")


@query(f"with recursive {_EDGES}, {_CURVE_SQL}, {_CURVE_LIVE}, first as (select run, vid, min(rank) as rank from act group by 1, 2) select t.rank, round(count(*) / {_RUNS}.0, 6)::double as spread from top t join first f on f.rank <= t.rank group by 1")
def spread_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kept_edges(spark, sf_dir)
    return _rounded(spread.curve(e, selection.by_degree(e, 5), _RUNS), "spread")


@query(f"with recursive {_EDGES.replace('1 - pow(1 - 1.0 / deg, c) as p', '1 - pow(0.9, c) as p')}, {_SEED_SQL}, {_LIVE_SQL} select round(count(*) / {_RUNS}.0, 6)::double as spread from act")
def constant_ratio_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread.constant_ratio(_kept_edges(spark, sf_dir), 0.1)
    return _rounded(spread.monte_carlo(e, selection.by_degree(e, 5), _RUNS), "spread")


@query(f"with recursive {_ITEM_EDGES}, {_SEED_SQL}, {_LIVE_SQL} select round(count(*) / {_RUNS}.0, 6)::double as spread from act")
def topic_item_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = selection.checkpointed(sources.topic_edges(spark, sf_dir))
    return _rounded(topics.topic_spread(te, ITEM, selection.by_degree(topics.for_item(te, ITEM), 5), _RUNS), "spread")


def _lazy_sql(k: int) -> str:
    """Greedy over what each vertex reaches in each run's live edges, k rounds."""
    steps = [f"live as (select r.range as run, src, dst from range({_RUNS}) r, e where concat('0x', substr(md5(concat(r.range, '-', src, '-', dst)), 1, 8))::bigint / 4294967296.0 < p), reach(run, s, vid) as (select r.range, vid, vid from range({_RUNS}) r, v union select reach.run, s, live.dst from reach join live on live.run = reach.run and live.src = reach.vid)"]
    for i in range(1, k + 1):
        taken = " union ".join(f"select run, vid from reach where s in (select vid from s{j})" for j in range(1, i)) or "select run, vid from reach where false"
        steps.append(f"t{i} as ({taken}), s{i} as (select s as vid, count(*) / {_RUNS}.0::double as gain from reach anti join t{i} using (run, vid) group by 1 order by round(gain, 9) desc, 1 limit 1)")
    return ", ".join(steps) + " " + " union all ".join(f"select {i}::int as rank, vid, round(gain, 6) as gain from s{i}" for i in range(1, k + 1))


@query(f"with recursive {_EDGES}, {_lazy_sql(K)}")
def lazy_greedy_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy over Monte Carlo spread on shared live edges, with batches of a lazy queue."""
    e = _kept_edges(spark, sf_dir)
    return _rounded(spread.lazy_greedy(e, K, _RUNS, paths.vertices(e)), "gain")


_BOUND_EDGES = f"{_TEDGES}, e as (select src, dst, list_max(w) as p from te), v as (select src as vid from e union select dst from e)"


@query(f"with recursive {_BOUND_EDGES}, {_closure_sql(compare='>=', theta=0.1)} select s as vid, round(sum(p), 6) as infl, round(sum(case when p > 0.2 then p else 0 end), 6) as infl2 from mip group by 1")
def topic_vertex_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(topics.vertex_bounds(sources.topic_edges(spark, sf_dir), 0.1, 0.5), "infl", "infl2")


@query(f"with recursive {_BOUND_EDGES}, {_closure_sql(compare='>=', theta=0.1)}, b as (select s as vid, round(sum(p), 9) as infl from mip group by 1) select row_number() over (order by infl desc, vid)::int as rank, vid, round(infl, 6) as infl from b qualify rank <= 10")
def topic_bound_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = topics.vertex_bounds(sources.topic_edges(spark, sf_dir), 0.1, 0.5).withColumn("infl", F.round("infl", 9))
    return _rounded(selection.top(bounds, 10, "infl"), "infl")


@query()
def topic_best_first_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazily, by bounds that were built in advance, with coarse bounds before exact gains."""
    te = selection.checkpointed(sources.topic_edges(spark, sf_dir))
    bounds = selection.checkpointed(topics.vertex_bounds(te, 0.1, 0.5))
    return _rounded(topics.topic_best_first(te, ITEM, K, 0.1, bounds, coarse=0.2), "gain")


@query()
def topic_lazy_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of ``topic_greedy_seeds``, by bounds over all in-neighbours that were built for all items."""
    te = selection.checkpointed(sources.topic_edges(spark, sf_dir))
    return _rounded(topics.topic_lazy(te, ITEM, K, 0.1, topics.reach_bounds(te, 0.1)), "gain")


@query()
def topic_approximate_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of the nearest of two samples, if they are shown to reach 0.7 of the nearest upper bound."""
    te = selection.checkpointed(sources.topic_edges(spark, sf_dir))
    bounds = selection.checkpointed(topics.vertex_bounds(te, 0.1, 0.5))
    samples = {1: [0.2] * 5, 2: [0.6, 0.1, 0.1, 0.1, 0.1]}
    ranked = topics.sample_seeds(te, samples, 2, 0.1)
    upper, lower = topics.upper_samples(te, samples, 2, 0.1, ranked=ranked), topics.lower_samples(te, samples, 2, 0.1, ranked=ranked)
    return _rounded(topics.topic_approximate(te, ITEM, 2, 0.1, bounds, upper, lower, 0.7, coarse=0.2), "gain")


@query()
def topic_greedy_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(topics.topic_greedy(sources.topic_edges(spark, sf_dir), ITEM, K, 0.1), "gain")


@query()
def topic_seeds_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds for an item of each single topic, side by side."""
    items = spark.createDataFrame([(i, [float(i == j) for j in range(len(sources.TOPICS))], 2) for i in range(len(sources.TOPICS))], "qid long, item array<double>, k int")
    return _rounded(topics.topic_greedies(sources.topic_edges(spark, sf_dir), items, 0.1), "gain")


_ITEMS_SQL = "it as (select user_id as qid, [" + ", ".join(f"sum(case when event_type = '{t}' then 1 else 0 end)::double / count(*)" for t in sources.TOPICS) + "] as item from events group by 1)"
_SAMPLES = [[0.2] * 5, [0.6, 0.1, 0.1, 0.1, 0.1], [0.1, 0.1, 0.6, 0.1, 0.1]]
_KL_SQL = "list_sum(list_transform(range(1, 6), lambda i: (case when item[i] = 0 then 1e-7 else item[i] end) * ln((case when item[i] = 0 then 1e-7 else item[i] end) / sample[i])))"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = [(F.sum((F.col("event_type") == t).cast("int")) / F.count(F.lit(1))).alias(t) for t in sources.TOPICS]
    events = sources.table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("qid")).agg(*mix).select("qid", F.array(*sources.TOPICS).alias("item"))


@query(
    f"with {_ITEMS_SQL}, sm(sid, sample) as (values {', '.join(f'({i}::bigint, {s}::double[])' for i, s in enumerate(_SAMPLES))}), d as (select qid, sid, {_KL_SQL} as kl from it, sm), "
    "b as (select qid, arg_min(sid, (round(kl, 9), sid)) as sid, min(kl) as distance from d where kl < 1 group by 1) select it.qid, b.sid, round(distance, 6) as distance from it left join b using (qid)"
)
def nearest_topic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame(list(enumerate(_SAMPLES)), "sid long, item array<double>")
    return _rounded(topics.nearest_sample(_items(spark, sf_dir), samples), "distance")


_HOURS_SQL = "sm as (select epoch(date_trunc('hour', ts))::bigint as sid, [" + ", ".join(f"sum(case when event_type = '{t}' then 1 else 0 end)::double / count(*)" for t in sources.TOPICS) + "] as sample from events group by 1)"
_KL_PAIR_SQL = _KL_SQL.replace("/ sample[i]", "/ case when sample[i] = 0 then 1e-7 else sample[i] end")


@query(
    f"with {_ITEMS_SQL}, {_HOURS_SQL}, d as (select qid, sid, {_KL_PAIR_SQL} as kl from it, sm) select qid, arg_min(sid, (round(kl, 9), sid)) as sid, round(min(kl), 6) as distance from d group by 1"
)
def nearest_hour_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour whose mix of events is nearest to each user's, hours being samples that bounds by pivots leave out."""
    events = sources.table(spark, sf_dir, "events").withColumn("sid", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long") * 3600)
    mix = [(F.sum((F.col("event_type") == t).cast("int")) / F.count(F.lit(1))).alias(t) for t in sources.TOPICS]
    samples = events.groupBy("sid").agg(*mix).select("sid", F.array(*sources.TOPICS).alias("item"))
    return _rounded(topics.nearest_sample(_items(spark, sf_dir), samples, float("inf"), few=0), "distance")


@query()
def item_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.clusters(_items(spark, sf_dir), 4)[1].select("cluster", F.round("total", 6).alias("total"))


@query()
def item_clusters_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of ten k-means side by side."""
    return topics.restarted_clusters(_items(spark, sf_dir), 4)[1].select("cluster", F.round("total", 6).alias("total"))
