"""The engine's operators over the test tables, each with DuckDB SQL for the same result where SQL can express it.

Series are the ``embeddings``, z-normalised (64 points), or daily sums of ``events`` by user (30 points). Query sets are
rows whose identifier is divisible by 25. Numbers are rounded to six decimals. Index settings suit tables of some
hundred rows; they are parameters of the same code at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CARDINALITIES, IndexConfig, LabelConfig, WalkConfig, truth
from .functions import distance, representation as rep
from .functions.breakpoints import breakpoints
from .operators import envelope, evaluate, filters, labels, search, stats
from .plans import index as indexes, planner
from .sources import storage, walks

WIDE = IndexConfig(length=64, segments=8, cardinality=64)
NARROW = IndexConfig(length=64, segments=4, cardinality=64, max_records=40, leaf_threshold=10, sampling=False)
WHOLE = IndexConfig(length=64, segments=4, cardinality=64, max_records=1 << 30, leaf_threshold=10, sampling=False)
DAYS = IndexConfig(length=30, segments=6, cardinality=8)
RADIUS, K, EVERY = 9.5, 5, 25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.from_embeddings(table(spark, sf_dir, "embeddings"))


def tagged(spark: SparkSession, sf_dir: str, cfg: IndexConfig) -> DataFrame:
    return indexes.tag(series(spark, sf_dir), cfg)


def r6(c):
    return F.round(c, 6)


#: z: z-normalised series; q: the query set.
Z = """with e as (select vec_id as series_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
m as (select *, list_sum(e) / len(e) as m from e),
s as (select *, sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / (len(e) - 1)) as s from m),
z as (select series_id, list_transform(e, lambda x: (x - m) / s) as v from s where s > 0),
q as (select series_id as qid, v from z where series_id % 25 = 0)"""


def sql_list(xs) -> str:
    return "[" + ", ".join(repr(x) for x in xs) + "]::double[]"


def sql_paa(v: str, cfg: IndexConfig) -> str:
    return f"list_transform(range(0, {cfg.word_length}), lambda i: list_sum({v}[i * {cfg.step} + 1 : i * {cfg.step} + {cfg.step}]) / least({cfg.step}, {cfg.length} - i * {cfg.step}))"


def sql_symbols(p: str, cardinality: int) -> str:
    return f"list_transform({p}, lambda x: len(list_filter({sql_list(breakpoints(cardinality))}, lambda b: b <= x)))"


def sql_word(s: str, cfg: IndexConfig) -> str:
    n = cfg.word_length
    bit = lambda l: f"list_sum(list_transform(range(0, {n}), lambda j: (({s}[j + 1] >> {l}) & 1) << ({n} - 1 - j)))::bigint"
    return " || ".join(f"printf('%0{cfg.digits}x', {bit(l)})" for l in range(cfg.bits - 1, -1, -1))


def sql_words(cfg: IndexConfig, z: str = Z, source: str = "z") -> str:
    return f"{z}, p as (select *, {sql_paa('v', cfg)} as p from {source}), y as (select *, {sql_symbols('p', cfg.cardinality)} as y from p), w as (select *, {sql_word('y', cfg)} as word from y)"


PAIRS = "d as (select q.qid, z.series_id, sqrt(list_sum(list_transform(list_zip(q.v, z.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) as dist from q, z)"
LO, UP = "list_transform(v, lambda x, i: x - 0.05 * (i % 4))", "list_transform(v, lambda x, i: x + 0.1 * (i % 3))"
BANDS = f"b as (select qid, {LO} as lo, {UP} as up from q)"
ALL_BANDS = f"b as (select series_id as qid, {LO} as lo, {UP} as up from z)"
BAND_PAIRS = "d as (select b.qid, z.series_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(greatest(b.lo[i] - z.v[i], z.v[i] - b.up[i], 0), 2)))) as dist from b, z)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches."""
    return series(spark, sf_dir).where(F.col("series_id") % EVERY == 0).selectExpr("series_id as qid", "values")


def bands(spark: SparkSession, sf_dir: str, every: int = 1) -> DataFrame:
    """Intervals around series; ``every`` picks the query set of searches."""
    rows = series(spark, sf_dir).where(F.col("series_id") % every == 0)
    lower = F.transform("values", lambda x, i: x - 0.05 * ((i + 1) % 4))
    upper = F.transform("values", lambda x, i: x + 0.1 * ((i + 1) % 3))
    return rows.select(F.col("series_id").alias("qid"), lower.alias("lower"), upper.alias("upper"))


def answered(rows: DataFrame, answer: Callable[[list[search.Query]], DataFrame]) -> DataFrame:
    """Answers to a query set, in blocks, distances rounded."""
    out = search.each_block(rows, 64, answer)
    return out.withColumn("dist", r6("dist")) if "dist" in out.columns else out


def built(spark: SparkSession, sf_dir: str, cfg: IndexConfig) -> indexes.Index:
    """The index of these settings over the table's present files: built by the first query that asks for it, then opened."""
    root = storage.scratch(spark, "index").rpartition("/")[0]
    path = f"{root}/index-{hashlib.sha256(repr((cfg, storage.stamp(spark, f'{sf_dir}/embeddings.parquet'))).encode()).hexdigest()}"
    if storage.exists(spark, f"{path}/manifest.json"):
        return indexes.open_index(spark, path)
    return indexes.build(storage.materialise(series(spark, sf_dir), "series"), path, cfg)


# sources


@query("select user_id as series_id, len(v)::int as n, round(list_sum(v), 4) as total, round(v[1], 4) as first from (select user_id, list_transform(range(0, 30), lambda d: coalesce(m[d], 0)) as v from (select user_id, map(list(day), list(s)) as m from (select user_id, date_diff('day', date '2024-01-01', ts::date) as day, sum(value) as s from events where date_diff('day', date '2024-01-01', ts::date) between 0 and 29 group by all) group by user_id))")
def s4_event_series(spark, sf_dir):
    rows = storage.from_events(table(spark, sf_dir, "events"))
    return rows.select("series_id", F.size("values").alias("n"), F.round(rep.total(F.col("values")), 4).alias("total"), F.round(F.col("values")[0], 4).alias("first"))


@query()
def s1_random_walks(spark, sf_dir):
    rows = walks.random_walks(spark, WalkConfig(count=500, length=64))
    return rows.select("series_id", r6(F.col("values")[63]).alias("last"), r6(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)).alias("squares"))


@query()
def t16_bands(spark, sf_dir):
    cfg = WalkConfig(count=500, length=64, bands=True, band_share=0.2, band_segments=2)
    rows = walks.with_bands(series(spark, sf_dir), cfg)
    wide = F.size(F.filter(F.arrays_zip("lower", "upper"), lambda x: x["lower"] < x["upper"]))
    return rows.select("qid", wide.alias("points"), r6(F.array_max(F.zip_with("upper", "lower", lambda a, b: a - b))).alias("height"))


# representation


@query(f"{Z} select series_id, len(v)::int as n, round(v[1], 6) as first, round(v[64], 6) as last, round(list_sum(list_transform(v, lambda x: x * x)), 6) as squares from z")
def t2_z_normalise(spark, sf_dir):
    v = F.col("values")
    return series(spark, sf_dir).select("series_id", F.size(v).alias("n"), r6(v[0]).alias("first"), r6(v[63]).alias("last"), r6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("squares"))


@query(f"{Z} select series_id, pos::int as pos, round(sum(x) over (partition by series_id order by pos), 6) + 0.0 as s from (select series_id, unnest(v) as x, unnest(range(1, 65)) as pos from z)")
def t1_running_sum(spark, sf_dir):
    rows = series(spark, sf_dir).select("series_id", F.posexplode(rep.running_sum(F.col("values"))).alias("pos", "s"))
    return rows.select("series_id", (F.col("pos") + 1).alias("pos"), (r6("s") + 0.0).alias("s"))


@query(f"{Z} select series_id, unnest(range(0, 8))::int as segment, round(unnest({sql_paa('v', WIDE)}), 6) as mean from z")
def t3_paa(spark, sf_dir):
    return series(spark, sf_dir).select("series_id", F.posexplode(rep.paa(F.col("values"), WIDE)).alias("segment", "mean")).select("series_id", "segment", r6("mean").alias("mean"))


@query(f"{Z}, {ALL_BANDS} select qid, unnest(range(0, 8))::int as segment, round(unnest({sql_paa('lo', WIDE)}), 6) as lower, round(unnest({sql_paa('up', WIDE)}), 6) as upper, round(unnest({sql_paa('(list_transform(list_zip(lo, up), lambda t: (t[1] + t[2]) / 2))', WIDE)}), 6) as middle from b")
def t4_t5_interval_paa(spark, sf_dir):
    rows = bands(spark, sf_dir).select("qid", rep.paa_interval(F.col("lower"), F.col("upper"), WIDE).alias("p"), rep.paa_middle(F.col("lower"), F.col("upper"), WIDE).alias("m"))
    flat = rows.select("qid", F.posexplode(F.arrays_zip(F.col("p.lower").alias("lower"), F.col("p.upper").alias("upper"), F.col("m").alias("middle"))).alias("segment", "x"))
    return flat.select("qid", "segment", r6("x.lower").alias("lower"), r6("x.upper").alias("upper"), r6("x.middle").alias("middle"))


@query(f"{Z}, p as (select *, {sql_paa('v', WIDE)} as p from z) select series_id, array_to_string({sql_symbols('p', 64)}, ',') as c64, array_to_string({sql_symbols('p', 10)}, ',') as c10 from p")
def t6_symbols(spark, sf_dir):
    p = rep.paa(F.col("values"), WIDE)
    text = lambda c: F.array_join(rep.symbols(p, c).cast("array<string>"), ",")
    return series(spark, sf_dir).select("series_id", text(64).alias("c64"), text(10).alias("c10"))


@query(f"{sql_words(WIDE)} select series_id, word from w")
def t8_words(spark, sf_dir):
    return tagged(spark, sf_dir, WIDE).select("series_id", "word")


DAY_WORDS = sql_words(DAYS, "with z as (select user_id as series_id, list_transform(range(0, 30), lambda d: coalesce(m[d], 0) / 100.0 - 1) as v from (select user_id, map(list(day), list(s)) as m from (select user_id, date_diff('day', date '2024-01-01', ts::date) as day, sum(value) as s from events where date_diff('day', date '2024-01-01', ts::date) between 0 and 29 group by all) group by user_id))")


@query(f"{DAY_WORDS} select series_id, word, array_to_string(y, ',') as symbols from w")
def t7_t13_words_and_back(spark, sf_dir):
    """Words of six segments, and the symbols read back from them."""
    rows = storage.from_events(table(spark, sf_dir, "events")).withColumn("values", F.transform("values", lambda x: x / 100.0 - 1))
    return indexes.tag(rows, DAYS).select("series_id", "word", F.array_join(rep.word_symbols(F.col("word"), DAYS).cast("array<string>"), ",").alias("symbols"))


@query(f"{sql_words(WIDE)} select series_id, word[1:4] as level2, word[:-3] as parent, starts_with(word, (select min(word) from w)[1:2]) as under, word[1:2] in (select distinct word[1:2] from w where series_id < 5) as among from w")
def t9_t12_prefixes(spark, sf_dir):
    rows = storage.materialise(tagged(spark, sf_dir, WIDE).select("series_id", "word"), "words")
    first = rows.agg(F.min("word")).first()[0][:2]
    some = [r[0] for r in rows.where("series_id < 5").select(F.substring("word", 1, 2)).distinct().collect()]
    w = F.col("word")
    return rows.select("series_id", rep.prefix(w, 2, WIDE).alias("level2"), rep.parent(w, WIDE).alias("parent"), rep.under(w, F.lit(first)).alias("under"), rep.in_nodes(w, some).alias("among"))


#: The normal distribution function by its series at m, and its inverse by halving.
_PHI = "0.5 + sign(m) * exp(-m * m / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda n: exp((2 * n + 1) * ln(greatest(abs(m), 1e-300)) - lgamma(2 * n + 2) + n * ln(2.0) + lgamma(n + 1))))"


@query(f"""with recursive b as (
  select cardinality, position, (position + 1) / cardinality::double as share, -5.0::double as lo, 5.0::double as hi, 0 as k from (select cardinality, unnest(range(0, cardinality - 1)) as position from (select unnest({list(CARDINALITIES)}) as cardinality))
  union all select cardinality, position, share, case when phi < share then m else lo end, case when phi < share then hi else m end, k + 1 from (select *, {_PHI} as phi from (select *, (lo + hi) / 2 as m from b where k < 50))
), x as (select cardinality, position, case when abs(lo + hi) < 1e-9 then 0.0 else (lo + hi) / 2 end as x from b where k = 50)
select cardinality::int as cardinality, position::int as position, case when x = 0 then 0.0 when list_contains([2, 3, 4, 8, 16, 32, 64, 128, 256], cardinality) then round(x, (4 - floor(log10(abs(x))))::int) else round(x, 2) end as value from x""")
def t14_breakpoints(spark, sf_dir):
    return spark.createDataFrame([(c, i, b) for c in CARDINALITIES for i, b in enumerate(breakpoints(c))], "cardinality int, position int, value double")


# distances and bounds


@query(f"{Z} select a.series_id, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))), 6) as dist from z a join z b on b.series_id = a.series_id + 1")
def d1_euclidean(spark, sf_dir):
    a = series(spark, sf_dir)
    b = a.select((F.col("series_id") - 1).alias("series_id"), F.col("values").alias("other"))
    return a.join(b, "series_id").select("series_id", r6(distance.euclidean(F.col("values"), F.col("other"))).alias("dist"))


@query(f"{Z}, {ALL_BANDS}, {BAND_PAIRS.replace('from b, z', 'from b join z on z.series_id = b.qid + 1')} select qid, series_id, round(dist, 6) as dist from d")
def d2_interval_distance(spark, sf_dir):
    b = bands(spark, sf_dir).withColumn("series_id", F.col("qid") + 1)
    return b.join(series(spark, sf_dir), "series_id").select("qid", "series_id", r6(distance.interval_euclidean(F.col("values"), F.col("lower"), F.col("upper"))).alias("dist"))


def _bound_sql(level: int) -> str:
    edges = sql_list([-1e300, *breakpoints(1 << level), 1e300])
    shift = WIDE.bits - level
    gap = f"list_transform(range(1, 9), lambda j: power(greatest(({edges})[(n.y[j] >> {shift}) + 1] - q.p[j], q.p[j] - ({edges})[(n.y[j] >> {shift}) + 2], 0), 2) * 8)"
    return f"select q.series_id as qid, n.series_id, {level} as level, round(sqrt(list_sum({gap})), 6) as bound from y q join y n on n.series_id = q.series_id + 1"


@query(f"{sql_words(WIDE)} " + " union all ".join(_bound_sql(x) for x in range(1, 7)))
def d3_node_bounds(spark, sf_dir):
    rows = tagged(spark, sf_dir, WIDE).withColumn("p", rep.paa(F.col("values"), WIDE)).select("series_id", "word", "p")
    other = rows.select((F.col("series_id") - 1).alias("qid"), F.col("series_id"), "word")
    both = rows.select(F.col("series_id").alias("qid"), "p").join(other, "qid").select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("level"))
    node = F.substring("word", F.lit(1), F.col("level") * WIDE.digits)
    return both.select("qid", "series_id", "level", r6(distance.node_bound(node, F.col("p"), F.col("p"), WIDE)).alias("bound"))


def _interval_bound_sql(level: int) -> str:
    edges = sql_list([-1e300, *breakpoints(1 << level), 1e300])
    shift = WIDE.bits - level
    gap = f"list_transform(range(1, 9), lambda j: power(greatest(({edges})[(n.y[j] >> {shift}) + 1] - bm.up[j], bm.lo[j] - ({edges})[(n.y[j] >> {shift}) + 2], 0), 2) * 8)"
    return f"select bm.qid, n.series_id, {level} as level, round(sqrt(list_sum({gap})), 6) as bound from bm join y n on n.series_id = bm.qid + 1"


@query(f"{sql_words(WIDE)}, {ALL_BANDS}, bm as (select qid, {sql_paa('lo', WIDE)} as lo, {sql_paa('up', WIDE)} as up from b) " + " union all ".join(_interval_bound_sql(x) for x in (2, 4, 6)))
def d4_interval_node_bounds(spark, sf_dir):
    b = bands(spark, sf_dir).select((F.col("qid") + 1).alias("series_id"), "qid", rep.paa_interval(F.col("lower"), F.col("upper"), WIDE).alias("p"))
    both = b.join(tagged(spark, sf_dir, WIDE).select("series_id", "word"), "series_id").select("*", F.explode(F.array(F.lit(2), F.lit(4), F.lit(6))).alias("level"))
    node = F.substring("word", F.lit(1), F.col("level") * WIDE.digits)
    return both.select("qid", "series_id", "level", r6(distance.node_bound(node, F.col("p.lower"), F.col("p.upper"), WIDE)).alias("bound"))


@query(f"{sql_words(WIDE)} select a.series_id, round(sqrt(list_sum(list_transform(range(1, 9), lambda j: case when abs(a.y[j] - b.y[j]) <= 1 then 0 else power(({sql_list(breakpoints(64))})[greatest(a.y[j], b.y[j])] - ({sql_list(breakpoints(64))})[least(a.y[j], b.y[j]) + 1], 2) end))), 6) as bound from y a join y b on b.series_id = a.series_id + 1")
def d5_symbol_bound(spark, sf_dir):
    rows = tagged(spark, sf_dir, WIDE).select("series_id", rep.symbols(rep.paa(F.col("values"), WIDE), 64).alias("a"))
    other = rows.select((F.col("series_id") - 1).alias("series_id"), F.col("a").alias("b"))
    return rows.join(other, "series_id").select("series_id", r6(distance.symbol_bound(F.col("a"), F.col("b"), 64)).alias("bound"))


# aggregates


@query(f"{sql_words(NARROW)} select word, count(*) as cnt from w group by word")
def a1_word_counts(spark, sf_dir):
    return planner.word_counts(tagged(spark, sf_dir, NARROW))


LAYERS = f"{sql_words(NARROW)}, l as (select level, word[1:level] as prefix, count(*) as cnt from w, (select unnest(range(1, 7))::int as level) group by all)"


@query(f"{LAYERS} select l.level, l.prefix, l.cnt from l left join l u on u.level = l.level - 1 and u.prefix = l.prefix[:-2] where l.level = 1 or u.cnt > 40")
def a2_layer_counts(spark, sf_dir):
    return planner.layer_counts(planner.word_counts(tagged(spark, sf_dir, NARROW)), NARROW, 40)


@query(f"{LAYERS} select level, max(cnt) as largest from l group by level")
def a3_largest_nodes(spark, sf_dir):
    return planner.layer_counts(planner.word_counts(tagged(spark, sf_dir, NARROW)), NARROW).groupBy("level").agg(F.max("cnt").alias("largest"))


@query(f"{LAYERS} select level, count(*) as words from l group by level")
def a4_distinct_words(spark, sf_dir):
    return stats.distinct_words(tagged(spark, sf_dir, NARROW), NARROW)


@query("select count(*) as n, sum(n_chars)::double as total, max(n_chars)::double as largest, min(n_chars)::double as smallest, round(avg(n_chars), 6) as mean, round(stddev_pop(n_chars), 6) as deviation from documents")
def a5_a6_summary(spark, sf_dir):
    out = stats.summary(table(spark, sf_dir, "documents"), "n_chars")
    return out.withColumns({"mean": r6("mean"), "deviation": r6("deviation")})


_EDGES = sql_list(stats.SIZE_EDGES)


@query(f"select bin::int as bin, case when bin = 0 then 0 else ({_EDGES})[bin] end as low, count(*) as n from (select len(list_filter({_EDGES}, lambda e: e <= n_chars::double / 4000.0)) as bin from documents) group by all")
def a7_size_histogram(spark, sf_dir):
    return stats.size_histogram(table(spark, sf_dir, "documents"), "n_chars", 4000.0)


@query("select floor((n_chars::double - low) / (high - low) * 10)::int as bin, count(*) as n from documents, (select min(n_chars)::double as low, max(n_chars)::double as high from documents) group by all")
def a8_equal_histogram(spark, sf_dir):
    return stats.equal_histogram(table(spark, sf_dir, "documents"), "n_chars")


@query("select coalesce(sum(ceil(n_chars / 4096.0)), 0)::bigint as blocks from documents")
def a17_blocks(spark, sf_dir):
    return stats.blocks(table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("mb")), 4096.0)


# searches

TOP = "select qid, row_number() over (partition by qid order by dist, series_id)::int as rank, round(dist, 6) as dist, series_id from d qualify rank <= {k}"


RANGE = "select qid, series_id, round(dist, 6) as dist from d where dist <= {r}"

#: SQL for the index that NARROW's settings plan, from the words: children of nodes larger than a partition; small siblings
#: packed by first fit decreasing; numbers given parent by parent in the order of prefixes, then to what stays too large.
PLAN = f"""{sql_words(NARROW).replace('with e as', 'with recursive e as')},
l as (select level, word[1:level] as prefix, count(*) as cnt from w, (select unnest(range(1, 7))::int as level) group by all),
inner_ as (select 0 as level, '' as prefix, count(*) as cnt from w union all select level, prefix, cnt from l where cnt > {NARROW.capacity} and level < 6),
kids as (select l.level, l.prefix, l.cnt, i.prefix as parent from l join inner_ i on l.level = i.level + 1 and starts_with(l.prefix, i.prefix)),
small as (select *, row_number() over (partition by parent order by cnt desc, prefix) as k from kids where cnt <= {NARROW.capacity}),
ffd as (
  select parent, k, prefix, 1 as bin, [cnt] as used from small where k = 1
  union all
  select parent, k, prefix, bin, case when bin <= len(used) then list_transform(used, lambda u, i: u + case when i = bin then cnt else 0 end) else list_append(used, cnt) end
  from (select s.parent, s.k, s.prefix, s.cnt, f.used, coalesce(list_position(list_transform(f.used, lambda u: u + s.cnt <= {NARROW.capacity}), true), len(f.used) + 1) as bin from ffd f join small s on s.parent = f.parent and s.k = f.k + 1)
),
bins as (select parent, prefix, bin from ffd union all
  select parent, prefix, coalesce((select max(bin) from ffd where ffd.parent = kids.parent), 0) + row_number() over (partition by parent order by prefix) from kids where cnt > {NARROW.capacity} and level = 6),
first as (select prefix as parent, coalesce(sum(n) over (order by prefix rows between unbounded preceding and 1 preceding), 0) as base from inner_ left join (select parent, max(bin) as n from bins group by parent) on parent = prefix),
leaf as (select b.prefix, b.parent, (f.base + b.bin - 1)::int as pid, k.cnt, k.level from bins b join first f using (parent) join kids k on k.prefix = b.prefix and k.parent = b.parent),
wp as (select w.series_id, w.word, leaf.pid, leaf.parent from w join leaf on starts_with(w.word, leaf.prefix)),
lp as (select pid, level, word[1:level] as prefix, count(*) as cnt from wp, (select unnest(range(1, 7))::int as level) group by all),
st as (select pid, min(level) as start from (select pid, level from lp group by all having count(*) > 1) group by pid),
nd as (select pid, 0 as level, '' as prefix, count(*) as cnt, pid not in (select pid from st) as is_leaf from wp group by pid
  union all select lp.pid, lp.level, lp.prefix, lp.cnt, lp.cnt <= {NARROW.leaf_threshold} or lp.level = 6 from lp join st using (pid) left join lp u on u.pid = lp.pid and u.level = lp.level - 1 and u.prefix = lp.prefix[:-2] where lp.level = start or lp.level > start and u.cnt > {NARROW.leaf_threshold}),
target as (select wp.series_id, wp.word, wp.pid, max_by(nd.prefix, nd.level) as target from wp join nd on nd.pid = wp.pid and starts_with(wp.word, nd.prefix) and (nd.level = 0 or nd.cnt > {K}) group by all)"""
#: Places of scalar queries: home; home and siblings; target node.
HOME = "place as (select series_id as qid, pid, '' as target from wp where series_id % 25 = 0)"
NEAR = "place as (select distinct a.series_id as qid, s.pid, '' as target from wp a join leaf s on starts_with(s.prefix, a.parent) where a.series_id % 25 = 0)"
AIM = "place as (select series_id as qid, pid, target from target where series_id % 25 = 0)"
AT_PLACES = PAIRS.replace("from q, z", "from (select distinct place.qid, q.v, wp.series_id from place join q using (qid) join wp on wp.pid = place.pid and starts_with(wp.word, place.target)) q join z using (series_id)").replace("z.series_id, sqrt", "series_id, sqrt")
#: Words of intervals (four segments): the product of the ranges, and the rank of each symbol from its range's mean outwards.
_SEG = range(1, 5)
PRODUCT = f"""bl as (select qid, {sql_symbols(sql_paa('lo', NARROW), 64)} as a, {sql_symbols(sql_paa('up', NARROW), 64)} as c, {sql_symbols(sql_paa('(list_transform(list_zip(lo, up), lambda t: (t[1] + t[2]) / 2))', NARROW), 64)} as mid from b),
rg as (select qid, j, s, a[j] as a, c[j] as c, mid[j] as mid, row_number() over (partition by qid, j order by abs(2 * s - a[j] - c[j]), s) as r from (select qid, a, c, mid, j, unnest(range(a[j], c[j] + 1)) as s from bl, (select unnest(range(1, 5)) as j))),
hd as (select qid, j, s as head from rg where r = 1),
pr as (select {", ".join(f"s{i}.s as s{i}, s{i}.r as r{i}" for i in _SEG)}, s1.qid,
  {" + ".join(f"abs(s{i}.s - h{i}.head)" for i in _SEG)} as from_head, {" + ".join(f"abs(s{i}.s - s{i}.mid)" for i in _SEG)} as from_mid
  from rg s1 {" ".join(f"join rg s{i} on s{i}.qid = s1.qid and s{i}.j = {i}" for i in (2, 3, 4))} {" ".join(f"join hd h{i} on h{i}.qid = s1.qid and h{i}.j = {i}" for i in _SEG)} where s1.j = 1)"""
ORDERS = {1: "from_head, r1, r2, r3, r4", 2: "from_head desc, r1 desc, r2 desc, r3 desc, r4 desc", 3: "from_mid, s1, s2, s3, s4", 4: "from_mid desc, s1 desc, s2 desc, s3 desc, s4 desc"}


def sql_chosen(m: int, order: int) -> str:
    spelt = sql_word("[" + ", ".join(f"s{i}" for i in _SEG) + "]", NARROW)
    return f"ch as (select qid, row_number() over (partition by qid order by {ORDERS[order]}) - 1 as position, {spelt} as word from pr qualify position < {m})"


#: Places of interval queries: homes of the words; their siblings too; target nodes.
WORD_LEAF = "wl as (select ch.qid, ch.word, coalesce(leaf.pid, -1) as pid, leaf.parent from ch left join leaf on starts_with(ch.word, leaf.prefix))"
BAND_HOME = "place as (select distinct qid, pid, '' as target from wl)"
BAND_NEAR = "place as (select distinct wl.qid, s.pid, '' as target from wl join (select pid, prefix from leaf) s on starts_with(s.prefix, coalesce(wl.parent, (select max_by(prefix, level) from inner_ where starts_with(wl.word, inner_.prefix)))))"
BAND_AIM = f"place as (select wl.qid, wl.pid, max_by(nd.prefix, nd.level) as target from wl join nd on nd.pid = wl.pid and starts_with(wl.word, nd.prefix) and (nd.level = 0 or nd.cnt > {K}) group by wl.qid, wl.pid, wl.word)"
BAND_AT_PLACES = BAND_PAIRS.replace("from b, z", "from (select distinct place.qid, b.lo, b.up, wp.series_id from place join b using (qid) join wp on wp.pid = place.pid and starts_with(wp.word, place.target)) b join z using (series_id)").replace("z.series_id, sqrt", "series_id, sqrt")


def knn_sql(place: str) -> str:
    return f"{PLAN}, {place}, {AT_PLACES} {TOP.format(k=K)}"


def band_knn_sql(place: str, m: int, order: int) -> str:
    return f"{PLAN}, {BANDS}, {PRODUCT}, {sql_chosen(m, order)}, {WORD_LEAF}, {place}, {BAND_AT_PLACES} {TOP.format(k=K)}"


@query(f"{Z}, {PAIRS} {TOP.format(k=K)}")
def k1_knn_brute(spark, sf_dir):
    return answered(asked(spark, sf_dir), lambda qs: search.brute_knn(series(spark, sf_dir), qs, K))


@query(f"{Z}, {PAIRS} {RANGE.format(r=RADIUS)}")
def f2_range_brute(spark, sf_dir):
    return answered(asked(spark, sf_dir), lambda qs: search.brute_range(series(spark, sf_dir), qs, RADIUS))


@query(f"{Z}, {PAIRS} {RANGE.format(r=RADIUS)}")
def q10_q12_range_search(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    return answered(asked(spark, sf_dir), lambda qs: search.range_search(index, qs, RADIUS))


def _node_bounds(level_of: str, prefix: str, lo: str, up: str) -> str:
    """SQL: bound from segment means to the node of a prefix (a hex digit a level, four segments)."""
    edges = "[" + ", ".join(sql_list([-1e300, *breakpoints(1 << x), 1e300]) for x in range(1, 7)) + "]"
    symbol = f"list_sum(list_transform(range(1, {level_of} + 1), lambda x: ((('0x' || {prefix}[x])::int >> (4 - j)) & 1) << ({level_of} - x)))::int"
    box = f"list_transform(range(1, 5), lambda j: {symbol})"
    return f"case when {level_of} = 0 then 0 else sqrt(list_sum(list_transform({box}, lambda s, j: power(greatest(({edges})[{level_of}][s + 1] - {up}[j], {lo}[j] - ({edges})[{level_of}][s + 2], 0), 2) * 16))) end"


@query(f"""{PLAN}, qp as (select qid, {sql_paa('v', NARROW)} as m from q),
reach as (select qp.qid, qp.m, leaf.pid from qp, leaf where {_node_bounds('leaf.level', 'leaf.prefix', 'qp.m', 'qp.m')} <= {RADIUS} group by all),
near as (select reach.qid, reach.pid, nd.is_leaf, {_node_bounds('nd.level', 'nd.prefix', 'reach.m', 'reach.m')} as bound from reach join nd using (pid))
select qid, count(distinct pid)::int + 1 as blocks, count(*) filter (bound <= {RADIUS} and not is_leaf)::int as internal_nodes, count(*) filter (bound <= {RADIUS} and is_leaf)::int as terminal_nodes from near group by qid""")
def q11_range_visits(spark, sf_dir):
    """The overflow partition is one of the blocks."""
    index = built(spark, sf_dir, NARROW)
    return answered(asked(spark, sf_dir), lambda qs: search.range_report(index, qs, RADIUS))


@query(f"{Z}, x as (select series_id as qid, v from z where series_id % 25 = 0 union all select 100000 + series_id, list_transform(v, lambda x, i: case when i = 1 then x + 0.001 else x end) from z where series_id % 25 = 0) select qid, exists(select 1 from z where z.v = x.v) as found, 1 as blocks from x")
def q1_exact_match(spark, sf_dir):
    return search.exact_match(built(spark, sf_dir, NARROW), _probes(spark, sf_dir))


def _probes(spark, sf_dir):
    own = series(spark, sf_dir).where(F.col("series_id") % EVERY == 0)
    moved = F.transform("values", lambda x, i: F.when(i == 0, x + 0.001).otherwise(x))
    absent = own.select((F.col("series_id") + 100000).alias("qid"), moved.alias("values"), F.lit(False).alias("expected"))
    return own.select(F.col("series_id").alias("qid"), "values", F.lit(True).alias("expected")).unionByName(absent)


@query(f"select qid, found, case when found then true end as opened from ({ORACLE_SQL['q1_exact_match']})")
def q2_exact_match_bloom(spark, sf_dir):
    """A stored series has its partition opened; of others, a filter says so now and then, so theirs is left open here."""
    from dataclasses import replace

    got = search.exact_match(built(spark, sf_dir, replace(NARROW, bloom=True, bloom_features=True)), _probes(spark, sf_dir), bloom=True)
    return got.select("qid", "found", F.when(F.col("found"), F.col("blocks") == 1).alias("opened"))


@query(f"{PLAN} select series_id as qid, pid, true as maybe from wp where pid = 3")
def q3_one_stored_filter(spark, sf_dir):
    """One partition's records against its own filter, of which alone the file is read."""
    from dataclasses import replace

    index = built(spark, sf_dir, replace(NARROW, bloom=True))
    rows = index.series([3]).select(F.col("series_id").alias("qid"), "pid", F.col("word").alias("key"))
    return filters.might_contain(rows, filters.read_filter(spark, f"{index.path}/bloom", 3)).select("qid", "pid", "maybe")


@query(knn_sql(AIM))
def q4_knn_target_node(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    return answered(asked(spark, sf_dir), lambda qs: search.knn(index, qs, K, 0))


@query(knn_sql(HOME))
def q5_knn_home_partition(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    return answered(asked(spark, sf_dir), lambda qs: search.knn(index, qs, K, 1))


@query(knn_sql(NEAR))
def q6_knn_sibling_partitions(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    return answered(asked(spark, sf_dir), lambda qs: search.knn(index, qs, K, 2))


@query(f"{PLAN}, {HOME}, {AT_PLACES}, t as ({TOP.format(k=30)}) select * from t where qid in (select qid from t group by qid having count(*) = 30)")
def f7_whole_answers(spark, sf_dir):
    """Only queries with all of 30 neighbours in their home partition."""
    index = built(spark, sf_dir, NARROW)
    return answered(asked(spark, sf_dir), lambda qs: search.knn(index, qs, 30, 1, full=True))


@query(band_knn_sql(BAND_AIM, 3, 3))
def q7_interval_knn_target_node(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    return answered(bands(spark, sf_dir, EVERY), lambda qs: search.knn(index, qs, K, 0, order=3))


@query(band_knn_sql(BAND_HOME, 4, 1))
def q8_interval_knn(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    return answered(bands(spark, sf_dir, EVERY), lambda qs: search.knn(index, qs, K, 1, order=1, max_words=4))


@query(band_knn_sql(BAND_NEAR, 4, 1))
def q9_interval_knn_partitions(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    return answered(bands(spark, sf_dir, EVERY), lambda qs: search.knn(index, qs, K, 2, order=1, max_words=4))


@query(f"{Z}, {BANDS}, {BAND_PAIRS} {RANGE.format(r=9.0)}")
def q10_interval_range(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    return answered(bands(spark, sf_dir, EVERY), lambda qs: search.range_search(index, qs, 9.0))


# words of intervals


@query(f"{Z}, {ALL_BANDS}, l as (select qid, {sql_symbols('p', 64)} as a from (select qid, {sql_paa('lo', WIDE)} as p from b)), h as (select qid, {sql_symbols('p', 64)} as c from (select qid, {sql_paa('up', WIDE)} as p from b)) select qid, list_product(list_transform(range(1, 9), lambda j: (c[j] - a[j] + 1)::double))::bigint as words from l join h using (qid)")
def e7_product_sizes(spark, sf_dir):
    rows = bands(spark, sf_dir).select("qid", rep.symbols(rep.paa(F.col("lower"), WIDE), 64).alias("a"), rep.symbols(rep.paa(F.col("upper"), WIDE), 64).alias("c"))
    return rows.select("qid", F.aggregate(F.zip_with("a", "c", lambda a, c: c - a + 1), F.lit(1).cast("long"), lambda x, n: x * n).alias("words"))


_POINT = ", ".join(f"case when p * (c[{i}] - a[{i}]) <= (c[{i}] - a[{i}] - 1) * 5 and p < 5 then a[{i}] + (2 * p * (c[{i}] - a[{i}]) + 5) // 10 else c[{i}] end" for i in _SEG)
_DIAGONAL = f"""dg as (select qid, min(p) as p, word from (select qid, p, {sql_word('x', NARROW)} as word from (select qid, p, [{_POINT}] as x from bl, (select unnest(range(0, 6)) as p))) group by qid, word),
small as (select qid, row_number() over (partition by qid order by s1, s2, s3, s4) - 1 as p, {sql_word('[s1, s2, s3, s4]', NARROW)} as word from pr where qid in (select qid from pr group by qid having count(*) <= 6))
select qid, (row_number() over (partition by qid order by p) - 1)::int as position, word from (select * from small union all select * from dg where qid not in (select qid from small))"""


def _order(n: int):
    def f(spark, sf_dir):
        return envelope.word_rows(spark, bands(spark, sf_dir), NARROW, 6, n)

    f.__name__ = f"e{n}_interval_words"
    if n in ORDERS:
        return query(f"{Z}, {ALL_BANDS}, {PRODUCT}, {sql_chosen(6, n)} select qid, position::int as position, word from ch")(f)
    return query(f"{Z}, {ALL_BANDS}, {PRODUCT}, {_DIAGONAL}" if n == 6 else None)(f)


for _n in range(7):
    _order(_n)

# index


@query(f"{PLAN} select prefix, level, cnt as est_cnt, true as is_leaf, pid::varchar as pids from leaf union all select i.prefix, i.level, i.cnt, false, array_to_string(list_sort(list(distinct leaf.pid)), ',') from inner_ i join leaf on starts_with(leaf.prefix, i.prefix) group by i.prefix, i.level, i.cnt")
def i6_partition_plan(spark, sf_dir):
    return indexes.plan_partitions(storage.materialise(series(spark, sf_dir), "series"), NARROW).table(spark).withColumn("pids", F.array_join(F.col("pids").cast("array<string>"), ","))


@query(f"{PLAN} select series_id, pid from wp")
def i9_word_partitions(spark, sf_dir):
    """Each series' partition, by the planned tree."""
    rows = storage.materialise(series(spark, sf_dir), "series")
    return planner.assign(indexes.tag(rows, NARROW).select("series_id", "word"), indexes.plan_partitions(rows, NARROW)).select("series_id", "pid")


@query(f"{PLAN} select a.series_id, array_to_string(list_sort(list(distinct s.pid)), ',') as siblings, any_value(c.pids) as by_count from wp a join leaf s on starts_with(s.prefix, a.parent) join (select series_id, array_to_string(list_sort(list(distinct pid)), ',') as pids from (select wp.series_id, max_by(t.prefix, t.level) as node from wp join (select level, prefix from inner_ where level = 0 or cnt > 60 union all select level, prefix from leaf where cnt > 60) t on starts_with(wp.word, t.prefix) group by wp.series_id) join leaf on starts_with(leaf.prefix, node) or starts_with(node, leaf.prefix) group by series_id) c on c.series_id = a.series_id group by a.series_id")
def i10_i11_partitions_by_word(spark, sf_dir):
    """Partitions of each word's siblings, and of the deepest node on its path with over 60 records; the words are few."""
    rows = storage.materialise(series(spark, sf_dir), "series")
    tree, words = indexes.plan_partitions(rows, NARROW), storage.materialise(indexes.tag(rows, NARROW).select("series_id", "word"), "words")
    text = lambda pids: ",".join(map(str, pids))
    flat = [(r.word, text(tree.siblings(r.word)), text(tree.by_count(r.word, 60))) for r in words.select("word").distinct().toLocalIterator()]
    return words.join(spark.createDataFrame(flat, "word string, siblings string, by_count string"), "word").select("series_id", "siblings", "by_count")


@query(f"{PLAN} select count(*) as partitions, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as deviation from (select pid, count(*) as n from wp group by pid)")
def a13_partition_records(spark, sf_dir):
    return stats.partition_records(built(spark, sf_dir, NARROW).series()).withColumns({"mean": r6("mean"), "deviation": r6("deviation")})


@query(f"{PLAN} select pid, count(*) filter (not is_leaf) as internal, count(*) filter (is_leaf) as terminal from nd group by pid")
def a14_local_nodes(spark, sf_dir):
    return stats.node_numbers(built(spark, sf_dir, NARROW).nodes())


@query(f"{PLAN} select pid, level, prefix, cnt, is_leaf from nd")
def i14_i17_local_trees(spark, sf_dir):
    return built(spark, sf_dir, NARROW).nodes().select("pid", "level", "prefix", "cnt", "is_leaf")


@query(f"{PLAN} select wp.series_id, wp.pid, max_by(nd.prefix, nd.level) as leaf from wp join nd on nd.pid = wp.pid and nd.is_leaf and starts_with(wp.word, nd.prefix) group by wp.series_id, wp.pid")
def i19_subtree_scan(spark, sf_dir):
    return indexes.with_leaf(built(spark, sf_dir, NARROW)).select("series_id", "pid", "leaf")


_NODES = f"""{LAYERS}, g as (select min(level) as start from (select level from l group by level having count(*) > 1)),
n as (select l.level, l.prefix, l.cnt from l left join l u on u.level = l.level - 1 and u.prefix = l.prefix[:-2], g where l.level = start or l.level > start and u.cnt > 10)"""


@query(f"{_NODES} select 0 as pid, 0 as level, '' as prefix, count(*) as cnt, false as is_leaf from w union all select 0, level, prefix, cnt, cnt <= 10 or level = 6 from n")
def i14_i16_nodes_of_one_partition(spark, sf_dir):
    return indexes.local_nodes(tagged(spark, sf_dir, NARROW).select(F.lit(0).alias("pid"), "word"), NARROW)


@query(f"{_NODES} select w.series_id as qid, 0 as pid, coalesce(max_by(n.prefix, n.level), '') as target from w left join n on starts_with(w.word, n.prefix) and n.cnt > {K} group by w.series_id")
def i20_target_nodes(spark, sf_dir):
    words = tagged(spark, sf_dir, NARROW).select(F.col("series_id").alias("qid"), F.lit(0).alias("pid"), "word")
    return indexes.target_nodes(indexes.local_nodes(words, NARROW), words, K, NARROW)


@query(f"{_NODES}, t as (select w.series_id as qid, coalesce(max_by(n.prefix, n.level), '') as target from w left join n on starts_with(w.word, n.prefix) and n.cnt > {K} where w.series_id % 25 = 0 group by w.series_id), {PAIRS.replace('from q, z', 'from q join t using (qid) join w z on starts_with(z.word, t.target)')} {TOP.format(k=K)}")
def q4_knn_target_node_of_one_partition(spark, sf_dir):
    index = built(spark, sf_dir, WHOLE)
    return answered(asked(spark, sf_dir), lambda qs: search.knn(index, qs, K, 0))


@query(f"{PLAN} select pid, count(*) as n, count(distinct word) as words from wp group by pid")
def i2_unclustered_index(spark, sf_dir):
    """Words and identifiers alone."""
    rows = storage.materialise(series(spark, sf_dir), "series")
    built_ = indexes.build(rows, storage.scratch(spark, "index"), NARROW, values=False)
    return spark.read.parquet(f"{built_.path}/series").groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("word").alias("words"))


# places, names, files


@query(f"select 500 as series, 500 as ids, 64 as points, ceil(500 * (64 * 4 + 8) * 1.05 / 1048576 / 0.05)::int as files")
def s2_s3_saved_walks(spark, sf_dir):
    """Generated, saved and read again; the number of output files follows from their size."""
    path = walks.generate(spark, WalkConfig(count=500, length=64, block_mb=0.05), storage.scratch(spark, "walks"))
    rows = storage.read_series(spark, path)
    return rows.agg(F.count("*").cast("int").alias("series"), F.count_distinct("series_id").cast("int").alias("ids"), F.max(F.size("values")).alias("points"), F.lit(len(storage.listing(spark, path, empty=False))).alias("files"))


@query(f"{PLAN} select pid, 1 as files, count(*) as n from wp group by pid")
def s6_s7_partition_files(spark, sf_dir):
    """A partition's records lie in the one file of the folder that its number names."""
    index = built(spark, sf_dir, NARROW)
    found = [(p, 1) for p in range(index.tree.partitions) for _ in storage.listing(spark, storage.partition_path(index.path, p), empty=False)]
    counted = spark.createDataFrame(found, "pid int, one int").groupBy("pid").agg(F.sum("one").cast("int").alias("files"))
    held = index.series().withColumn("named", F.regexp_extract("_metadata.file_path", r"/pid=(\d+)/", 1).cast("int")).where("named = pid")
    return held.groupBy("pid").agg(F.count("*").alias("n")).join(counted, "pid").select("pid", "files", "n")


@query(ORACLE_SQL["i6_partition_plan"])
def s8_stored_tree(spark, sf_dir):
    """The planned tree as an index that is opened anew has it."""
    tree = indexes.open_index(spark, built(spark, sf_dir, NARROW).path).tree
    return tree.table(spark).withColumn("pids", F.array_join(F.col("pids").cast("array<string>"), ","))


@query(f"{PLAN} select pid, count(distinct word) as keys from wp group by pid")
def s9_stored_filters(spark, sf_dir):
    from dataclasses import replace

    return indexes.open_index(spark, built(spark, sf_dir, replace(NARROW, bloom=True)).path).bloom().select("pid", F.col("n").alias("keys")).distinct()


_HITS = f"{Z}, {PAIRS}, h as (select qid, dist, series_id, count(*) over (partition by qid) as n from d where dist <= {RADIUS}), fit as (select qid, row_number() over (partition by qid order by dist, series_id)::int as rank, dist, series_id from h where n between 1 and 6)"


def _saved_labels(spark, sf_dir, at_most=None):
    made = search.each_block(asked(spark, sf_dir), 64, lambda qs: labels.range_labels(series(spark, sf_dir), qs, LabelConfig(most=6, radius=RADIUS)))
    path = storage.scratch(spark, "labels")
    storage.save_labels(made, path)
    return storage.read_labels(spark, path, at_most)


@query(f"{_HITS} select qid, rank, round(dist, 6) as dist, series_id from fit")
def s10_saved_labels(spark, sf_dir):
    return labels.flat(_saved_labels(spark, sf_dir)).withColumn("dist", r6("dist"))


@query(f"{_HITS} select qid, rank, round(dist, 6) as dist, series_id from fit where qid in (select distinct qid from fit order by qid limit 3)")
def k6_first_labels(spark, sf_dir):
    return labels.flat(_saved_labels(spark, sf_dir, 3)).withColumn("dist", r6("dist"))


@query(f"{_HITS} select qid, rank, round(dist, 6) as dist, series_id from fit where dist < 8.0")
def f4_nearer_labels(spark, sf_dir):
    return labels.flat(labels.within(_saved_labels(spark, sf_dir), 8.0)).withColumn("dist", r6("dist"))


@query(f"{PLAN} select count(*) as n, (select max(pid) + 1 from leaf) as partitions, true as same from wp")
def s12_built_once(spark, sf_dir):
    """A path that holds a whole index is opened, not built again, whatever it is asked to be built from."""
    first = built(spark, sf_dir, NARROW)
    before = storage.listing(spark, first.path)
    again = indexes.build(series(spark, sf_dir).where("false"), first.path, NARROW)
    return again.series().agg(F.count("*").alias("n")).select("n", F.lit(again.tree.partitions).alias("partitions"), F.lit(before == storage.listing(spark, first.path)).alias("same"))


@query("select * from (values ('walks', '/r/walks-1000-256-1'), ('index', '/s-0.1-8-1000-blocks-index'), ('index with filters', '/s-1-8-bf-1000-records-index'), ('filters', '/s-0.1-8-bf-1000-blocks-bloom-features'), ('labels', '/s-label-knn-100'), ('partition', '/i/series/pid=7')) t(kind, path)")
def s13_derived_names(spark, sf_dir):
    cfg = IndexConfig()
    from dataclasses import replace

    rows = [
        ("walks", WalkConfig().path("/r/")), ("index", cfg.index_path("/s/")), ("index with filters", replace(cfg, bloom=True, sampling=False, block_sampling=False).index_path("/s")),
        ("filters", replace(cfg, bloom=True, bloom_features=True).bloom_path("/s")), ("labels", LabelConfig().path("/s", "knn")), ("partition", storage.partition_path("/i", 7)),
    ]
    return spark.createDataFrame(rows, "kind string, path string")


@query("select * from (values ('series', true), ('labels', false)) t(input, present)")
def s15_inputs_that_are_there(spark, sf_dir):
    def there(path: str) -> bool:
        try:
            storage.require(spark, path=path)
        except FileNotFoundError:
            return False
        return True

    return spark.createDataFrame([("series", there(f"{sf_dir}/embeddings.parquet")), ("labels", there(f"{sf_dir}/no-such-labels"))], "input string, present boolean")


@query("select text, lower(trim(text)) in ('true', 'yes') as value from (values ('true'), ('TRUE '), ('yes'), ('Yes'), ('no'), ('false'), ('1'), (''), ('truth')) t(text)")
def t17_booleans(spark, sf_dir):
    return spark.createDataFrame([(t, truth(t)) for t in ("true", "TRUE ", "yes", "Yes", "no", "false", "1", "", "truth")], "text string, value boolean")


@query("select length, segments, cardinality, floor(0.95 * block * 1048576 / ((4 * length + 8 + (w // 4) * 2 * ceil(log2(cardinality))) * 1.08))::int as capacity from (select *, ceil(length / (length // segments + (length % segments > 0)::int)::double)::int as w from (values (256, 8, 64, 128.0::double), (64, 4, 64, 1.0), (30, 7, 8, 0.5), (100, 16, 256, 64.0)) t(length, segments, cardinality, block))")
def i21_capacities(spark, sf_dir):
    kinds = [IndexConfig(), IndexConfig(length=64, segments=4, cardinality=64, block_mb=1.0), IndexConfig(length=30, segments=7, cardinality=8, block_mb=0.5), IndexConfig(length=100, segments=16, cardinality=256, block_mb=64.0)]
    return spark.createDataFrame([(c.length, c.segments, c.cardinality, c.capacity) for c in kinds], "length int, segments int, cardinality int, capacity int")


@query(f"{PLAN} select prefix, k::int as place, bin::int as bin from ffd where parent = ''")
def i7_k8_first_fit(spark, sf_dir):
    """The root's small children: in order of count, and the bin that each fits first."""
    counts = planner.layer_counts(planner.word_counts(tagged(spark, sf_dir, NARROW)), NARROW).where(f"level = 1 and cnt <= {NARROW.capacity}")
    nodes = [planner.Node(r.prefix, r.cnt) for r in counts.collect()]  # at most as many as a level has prefixes
    place = {n.prefix: i + 1 for i, n in enumerate(sorted(nodes, key=lambda n: (-n.count, n.prefix)))}
    rows = [(n.prefix, place[n.prefix], i + 1) for i, held in enumerate(planner.first_fit(nodes, NARROW.capacity)) for n in held]
    return spark.createDataFrame(rows, "prefix string, place int, bin int")


@query(f"{PLAN}, qp as (select qid, {sql_paa('v', NARROW)} as m from q) select distinct qid, pid from (select qid, leaf.pid from qp, leaf where {_node_bounds('leaf.level', 'leaf.prefix', 'qp.m', 'qp.m')} <= {RADIUS} union all select qid, (select max(pid) + 1 from leaf) from qp)")
def i12_partitions_within(spark, sf_dir):
    """Partitions within the radius of each query, the overflow among them."""
    index = built(spark, sf_dir, NARROW)
    return search.each_block(asked(spark, sf_dir), 64, lambda qs: search.partitions_within(index, qs, RADIUS))


@query("select * from (values ('exact', 40, 1.0::double), ('knn', 10, 1.0), ('range', 10, 1.0)) t(kind, queries, score)")
def q13_dispatch(spark, sf_dir):
    """A query set of each kind, made, saved, answered by its kind's search and reported on; one partition holds all, so all is exact."""
    from . import cli
    from .config import QueryConfig

    index, rows = built(spark, sf_dir, WHOLE), storage.materialise(series(spark, sf_dir), "series")
    ask, out = rows.orderBy("series_id").limit(10).selectExpr("series_id as qid", "values"), []
    made = {
        "exact": lambda: labels.exact_labels(rows, LabelConfig(count=40), 64),
        "knn": lambda: labels.knn_labels(rows, search.queries_of(ask, 64), LabelConfig(k=K, radius=100.0)).join(ask, "qid"),
        "range": lambda: labels.range_labels(rows, search.queries_of(ask, 64), LabelConfig(radius=RADIUS)).join(ask, "qid"),
    }
    for kind, make in made.items():
        path = storage.scratch(spark, kind)
        storage.save_labels(make(), path)
        r = cli.run_queries(spark, kind, index.path, path, QueryConfig(k=K, knn_type=1, radius=RADIUS)).first()
        out.append((kind, r.queries, float(r[{"exact": "correct_rate", "knn": "recall", "range": "mean_recall"}[kind]])))
    return spark.createDataFrame(out, "kind string, queries int, score double")


def _by_pid(spark, sf_dir):
    rows = tagged(spark, sf_dir, NARROW).select("series_id", (F.col("series_id") % 7).cast("int").alias("pid"), F.xxhash64("word").alias("h1"), F.xxhash64("word", F.lit(1)).alias("h2"))
    return storage.materialise(rows, "hashes")


@query("select vec_id as series_id, true as maybe from embeddings")
def p2_p5_filter_bytes(spark, sf_dir):
    """A partition's filter as bytes, made and asked in the task that has the partition (at most its capacity of hashes)."""

    def ask(pdf):
        m, h = filters.bloom_size(len(pdf), 0.1)
        bits = filters.bloom_bits(pdf.h1.to_numpy(), pdf.h2.to_numpy(), m, h)
        return pdf[["series_id"]].assign(maybe=[filters.bloom_contains(bits, m, h, a, b) for a, b in zip(pdf.h1, pdf.h2, strict=True)])

    return _by_pid(spark, sf_dir).groupBy("pid").applyInPandas(ask, "series_id long, maybe boolean")


@query("select vec_id as series_id, true as held from embeddings")
def p4_cuckoo_members(spark, sf_dir):
    """Each partition's words in a cuckoo filter that went to bytes and back, and forgot what was added besides."""

    def ask(pdf):
        own = filters.CuckooFilter(4 * len(pdf))
        for x in sorted(set(pdf.h1)):
            own.add(int(x))
            own.add(int(x) ^ 0x5555)
            assert own.remove(int(x) ^ 0x5555)
        again = filters.CuckooFilter.from_bytes(own.to_bytes())
        return pdf[["series_id"]].assign(held=[int(x) in again for x in pdf.h1])

    return _by_pid(spark, sf_dir).groupBy("pid").applyInPandas(ask, "series_id long, held boolean")


@query()
def k3_k4_samples(spark, sf_dir):
    from dataclasses import replace

    cfg = replace(NARROW, sampling=True, sample_fraction=0.5)
    part, share = indexes.sample(storage.materialise(series(spark, sf_dir).repartition(4, "series_id"), "series"), cfg)
    return part.select("series_id", F.lit(share).alias("share"))


# filters


@query("select vec_id as series_id, true as maybe from embeddings")
def p1_bloom_members(spark, sf_dir):
    """Every stored key is found: a Bloom filter has no false negatives."""
    rows = storage.materialise(tagged(spark, sf_dir, NARROW).withColumn("pid", (F.col("series_id") % 7).cast("int")), "words")
    blooms = filters.bloom_table(rows, NARROW)
    return filters.might_contain(rows.select("series_id", "pid", F.col("word").alias("key")), blooms).select("series_id", "maybe")


@query("select 1 as filters, true as united, true as intersected")
def u3_filters_united(spark, sf_dir):
    """Of filters of one size: their union holds every key of each, and the intersection of a filter with itself is that filter."""
    rows = storage.materialise(tagged(spark, sf_dir, NARROW).withColumn("pid", (F.col("series_id") % 7).cast("int")).select("pid", "word"), "words")
    blooms = storage.materialise(filters.bloom_table(rows, NARROW, m=65536), "blooms")
    size = blooms.first()
    whole = filters.united(blooms).select(F.lit(0).alias("pid"), "bucket", "bitmap", F.lit(size.m).alias("m"), F.lit(size.h).alias("h"))
    missing = filters.might_contain(rows.select(F.lit(0).alias("pid"), F.col("word").alias("key")), whole).where("not maybe").count()
    one = blooms.where("pid = 3")
    twice = filters.intersected(one.unionByName(one.withColumn("pid", F.lit(4)))).join(one.select("bucket", F.col("bitmap").alias("own")), "bucket")
    other = twice.where(F.col("bitmap") != F.col("own")).count() + abs(twice.count() - one.count())
    return spark.createDataFrame([(1, missing == 0, other == 0)], "filters int, united boolean, intersected boolean")


# labels and evaluation

#: truth t and the home partitions' answers f, as (qid, rank, dist, series_id).
TRUTH = f"{PLAN}, d0 as (select q.qid, z.series_id, sqrt(list_sum(list_transform(list_zip(q.v, z.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) as dist from q, z), t as (select qid, row_number() over (partition by qid order by dist, series_id)::int as rank, dist, series_id from d0 qualify rank <= {K}), {HOME}, {AT_PLACES}, f as ({TOP.format(k=K).replace('round(dist, 6) as dist', 'dist')})"
ANSWERED = "r as (select t.qid, count(f.series_id) / {k}.0 as recall from t left join f on f.qid = t.qid and f.series_id = t.series_id group by t.qid), er as (select f.qid, avg(case when t.dist = 0 then 1 else f.dist / t.dist end) as x from f join t using (qid, rank) group by f.qid)".format(k=K)


def _answers(spark, sf_dir):
    """The true neighbours of the query set, and what the index answers from home partitions."""
    index = built(spark, sf_dir, NARROW)
    truth = search.each_block(asked(spark, sf_dir), 64, lambda qs: search.brute_knn(series(spark, sf_dir), qs, K))
    found = search.each_block(asked(spark, sf_dir), 64, lambda qs: search.knn(index, qs, K, 1))
    return storage.materialise(truth, "truth"), storage.materialise(found, "found")


@query(f"{TRUTH}, {ANSWERED} select qid, recall from r")
def a9_recall(spark, sf_dir):
    return evaluate.recall(*_answers(spark, sf_dir))


@query(f"{TRUTH}, {ANSWERED} select qid, round(x, 6) as error_ratio from er")
def a10_error_ratio(spark, sf_dir):
    return evaluate.error_ratio(*_answers(spark, sf_dir)).withColumn("error_ratio", r6("error_ratio"))


@query(f"{Z}, {PAIRS}, t as (select * from d where dist <= {RADIUS}) select qid, round(count(*) filter (dist <= 8.5) / count(*), 6) as recall from t group by qid")
def a11_range_recall(spark, sf_dir):
    """How much of what lies within the radius a smaller radius finds."""
    index = built(spark, sf_dir, NARROW)
    truth = answered(asked(spark, sf_dir), lambda qs: search.brute_range(series(spark, sf_dir), qs, RADIUS))
    found = answered(asked(spark, sf_dir), lambda qs: search.range_search(index, qs, 8.5))
    return evaluate.recall(truth, found).withColumn("recall", r6("recall"))


@query(f"{TRUTH}, {ANSWERED} select count(*) as queries, round(avg(recall), 6) as recall, round(avg(x), 6) as error_ratio, 0::bigint as ms_per_query from r left join er using (qid)")
def a12_knn_report(spark, sf_dir):
    return evaluate.knn_report(*_answers(spark, sf_dir)).withColumns({"recall": r6("recall"), "error_ratio": r6("error_ratio")})


@query(f"{Z} select 2 * count(*) as queries, 1.0::double as correct_rate, 1.0::double as block_rate, 0::bigint as ms_per_query from q")
def a12_exact_report(spark, sf_dir):
    """The probes are numbered anew, as reports join by qid."""
    probes = storage.materialise(_probes(spark, sf_dir).withColumn("qid", F.monotonically_increasing_id()), "probes")
    found = storage.materialise(search.exact_match(built(spark, sf_dir, NARROW), probes), "found")
    return evaluate.exact_report(probes.select("qid", "expected"), found)


@query(f"{ORACLE_SQL['q11_range_visits'].replace(' select qid, count(distinct', ', v as (select qid, count(distinct').replace(chr(10) + 'select qid, count(distinct', ', v as (select qid, count(distinct')}), {PAIRS}, n as (select qid, count(*) as n from d where dist <= {RADIUS} group by qid) select count(*) as queries, 1.0::double as min_recall, 1.0::double as max_recall, 1.0::double as mean_recall, 0.0::double as sd_recall, round(avg(n), 6) as records, round(avg(blocks), 6) as blocks, round(avg(internal_nodes), 6) as internal_nodes, round(avg(terminal_nodes), 6) as terminal_nodes, 0::bigint as ms_per_query from n left join v using (qid)")
def a12_range_report(spark, sf_dir):
    index = built(spark, sf_dir, NARROW)
    truth = search.each_block(asked(spark, sf_dir), 64, lambda qs: search.brute_range(series(spark, sf_dir), qs, RADIUS))
    found = storage.materialise(search.each_block(asked(spark, sf_dir), 64, lambda qs: search.range_search(index, qs, RADIUS)), "found")
    visits = search.each_block(asked(spark, sf_dir), 64, lambda qs: search.range_report(index, qs, RADIUS))
    return evaluate.range_report(truth, found, visits).withColumns({c: r6(c) for c in ("records", "blocks", "internal_nodes", "terminal_nodes")})


@query(f"{PLAN}, {BANDS}, {PRODUCT}, {sql_chosen(6, 1)}, {WORD_LEAF}, bm as (select qid, {sql_paa('lo', NARROW)} as lo, {sql_paa('up', NARROW)} as up from b) select wl.qid, wl.pid, round(min({_node_bounds('leaf.level', 'leaf.prefix', 'bm.lo', 'bm.up')}), 6) + 0.0 as threshold from wl join bm using (qid) join leaf on starts_with(wl.word, leaf.prefix) group by wl.qid, wl.pid")
def a16_least_thresholds(spark, sf_dir):
    """Per interval query and partition the least bound to the planned leaves of its words."""
    index = built(spark, sf_dir, NARROW)
    ask = bands(spark, sf_dir, EVERY)
    words = envelope.word_rows(spark, ask, NARROW, 6, 1)
    leaves = index.tree.table(spark).where("is_leaf").select("prefix", "level", F.col("pids")[0].alias("pid"))
    means = ask.select("qid", rep.paa_interval(F.col("lower"), F.col("upper"), NARROW).alias("p"))
    at = words.select("qid", "word", F.explode(F.sequence(F.lit(1), F.lit(NARROW.bits))).alias("level")).withColumn("prefix", F.substring("word", F.lit(1), F.col("level") * NARROW.digits))
    met = at.join(leaves, ["level", "prefix"]).join(means, "qid")
    bound = distance.node_bound(F.col("prefix"), F.col("p.lower"), F.col("p.upper"), NARROW)
    out = evaluate.least_thresholds(met.select("qid", "word", "pid", bound.alias("threshold")))
    return out.withColumn("threshold", r6("threshold") + 0.0)


@query(f"{Z}, {PAIRS} select qid, count(*)::int as n, round(max(dist), 6) as farthest from (select *, row_number() over (partition by qid order by dist, series_id) as r, count(*) over (partition by qid) as c from d where dist <= {RADIUS}) where c > {K} and r <= {K} group by qid")
def l2_knn_labels(spark, sf_dir):
    made = search.each_block(asked(spark, sf_dir), 64, lambda qs: labels.knn_labels(series(spark, sf_dir), qs, LabelConfig(k=K, radius=RADIUS)))
    return made.select("qid", F.size("neighbours").alias("n"), r6(F.element_at("neighbours", -1)["dist"]).alias("farthest"))


@query(f"{Z}, {PAIRS} select qid, count(*)::int as n, round(max(dist), 6) as farthest from d where dist <= {RADIUS} group by qid having count(*) between 1 and 6")
def l3_range_labels(spark, sf_dir):
    made = search.each_block(asked(spark, sf_dir), 64, lambda qs: labels.range_labels(series(spark, sf_dir), qs, LabelConfig(most=6, radius=RADIUS)))
    return made.select("qid", F.size("neighbours").alias("n"), r6(F.element_at("neighbours", -1)["dist"]).alias("farthest"))


@query("select i < 20 as expected, i < 20 as stored from range(0, 40) t(i)")
def l1_exact_labels(spark, sf_dir):
    """Which labels are made follows from hashes; that each is right, from the stored series."""
    rows = storage.materialise(series(spark, sf_dir), "series")
    made = storage.materialise(labels.exact_labels(rows, LabelConfig(count=40), 64), "labels")
    stored = made.join(rows.select("values").distinct(), "values", "left_semi").select("qid", F.lit(True).alias("stored"))
    return made.join(stored, "qid", "left").select("expected", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("select count(*) as n from embeddings")
def stream_ingest(spark, sf_dir):
    """Half of the series are built, the other half arrive as a stream; what the index holds afterwards."""
    from .streaming import ingest

    rows = storage.materialise(series(spark, sf_dir), "series")
    index = indexes.build(rows.where("series_id % 2 = 0"), storage.scratch(spark, "index"), NARROW)
    arriving = storage.scratch(spark, "arriving")
    rows.where("series_id % 2 = 1").write.parquet(arriving)
    ingest.ingest(spark.readStream.schema(rows.schema).parquet(arriving), index, storage.scratch(spark, "progress"), once=True).awaitTermination()
    return ingest.refresh(index).series().agg(F.count_distinct("series_id").alias("n"))
