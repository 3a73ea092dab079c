"""The engine's operators as queries on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import code_sum, wrap_int32
from . import recipes
from .builder import Work
from .builder import map as map_items
from .config import module_of
from .operators import Checkpoint, flat_map, fold, global_reduce, map_ordered, ring_reduce, routed, row_loop, supersteps, tagged
from .plans.compile import Segment, planned, typed
from .plans.nodes import Args, Module, Multiple
from .sources.lines import lines, seed_line
from .sources.staging import new_path, shared_dir
from .sweep import critical, grid, needed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def take(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return take


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def configured(df: DataFrame, config: dict | Module, ddl: str) -> DataFrame:
    """df's rows through a configured plan of Python jobs, as columns."""
    module = config if isinstance(config, Module) else module_of(config)
    return typed(planned([Segment(module)], df, table=True), ddl)


# --- jobs


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def job_map(spark, sf):
    first = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return first.select("l_orderkey", "l_linenumber", (F.col("net") * (1 + F.col("l_tax"))).alias("charge"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def job_filter(spark, sf):
    return read(spark, sf, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''")
def job_flatmap_multiple(spark, sf):
    words = F.transform(F.split("text", " "), lambda w: F.when(w != "", w))
    return flat_map(read(spark, sf, "documents"), words, "word", keep=["doc_id"])


@query("SELECT p_partkey, v AS value FROM (SELECT p_partkey, unnest([p_size, CASE WHEN p_size % 2 = 0 THEN p_size * 10 END, NULL]) AS v FROM part) WHERE v IS NOT NULL")
def multiple_drops_none(spark, sf):
    made = F.array("p_size", F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 10), F.lit(None).cast("int"))
    return flat_map(read(spark, sf, "part"), made, "value", keep=["p_partkey"])


@query("SELECT p_partkey, round(p_retailprice * p_size, 4) AS amount, concat(p_brand, '/', p_type) AS label FROM part")
def args_columns(spark, sf):
    packed = read(spark, sf, "part").select("p_partkey", F.struct("p_retailprice", "p_size", F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).alias("args"))
    return packed.select("p_partkey", F.round(F.col("args.p_retailprice") * F.col("args.p_size"), 4).alias("amount"), F.concat("args.brand", F.lit("/"), "args.kind").alias("label"))


@query("SELECT p_partkey, round(p_retailprice * p_size, 4) AS amount, concat(p_brand, '/', p_type) AS label FROM part")
def args_fanout(spark, sf):
    """A job's Args are the parameters of the next one."""
    work = Work(read(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", "p_brand", "p_type"), spark=spark)

    @work.job
    def packed(part):
        return Args(part["p_partkey"], part["p_retailprice"], part["p_size"], brand=part["p_brand"], kind=part["p_type"])

    @work.job
    def spread(key, price, size, brand, kind):
        return {"p_partkey": key, "amount": price * size, "label": f"{brand}/{kind}"}

    return work.frame_of("p_partkey long, amount double, label string").withColumn("amount", F.round("amount", 4))


@query("SELECT o_orderkey, 'large' AS target, round(o_totalprice * 0.9, 4) AS price FROM orders WHERE o_totalprice >= 150000 UNION ALL SELECT o_orderkey, 'small', round(o_totalprice, 4) FROM orders WHERE o_totalprice < 150000")
def routed_emit(spark, sf):
    price = F.col("o_totalprice")
    return routed(read(spark, sf, "orders"), {"large": (price >= 150000, {"price": F.round(price * 0.9, 4)}), "small": (price < 150000, {"price": F.round(price, 4)})}, keep=["o_orderkey"])


_BELOW_TEN = "WITH RECURSIVE r AS (SELECT p_partkey, p_size AS v FROM part UNION ALL SELECT p_partkey, v + 1 FROM r WHERE v < 10) SELECT p_partkey, v AS value FROM r WHERE v >= 10"


@query(_BELOW_TEN)
def row_loop_columns(spark, sf):
    return row_loop(read(spark, sf, "part"), ["p_partkey"], "p_size", "value < 10", "value + 1").select("p_partkey", "value")


@query(_BELOW_TEN)
def named_graph_loop(spark, sf):
    """A graph of jobs with a way back."""
    rows = read(spark, sf, "part").select("p_partkey", F.col("p_size").alias("value"))
    jobs = {"check": {"type": recipes.Under, "below": 10, "to": {"again": "grow", "done": "output"}}, "grow": {"type": recipes.Scale, "plus": 1, "to": "check"}}
    return configured(rows, {"input": "check", "jobs": jobs}, "p_partkey long, value int")


@query("SELECT p_partkey, p_size + 6 AS value FROM part")
def module_columns(spark, sf):
    one = lambda df: df.withColumn("value", F.col("value") + 1)
    three = lambda df: df.transform(one).transform(one).transform(one)
    return read(spark, sf, "part").select("p_partkey", F.col("p_size").alias("value")).transform(three).transform(three)


@query("SELECT p_partkey, p_size + 6 AS value FROM part")
def module_hierarchy(spark, sf):
    """A module of three jobs, used twice."""
    three = {"jobs": [{"type": recipes.Scale, "plus": 1}] * 3}
    return configured(read(spark, sf, "part").select("p_partkey", F.col("p_size").alias("value")), {"jobs": [three, three]}, "p_partkey long, value int")


@query("SELECT p_partkey FROM part p WHERE p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 1000) d(i) WHERE d.i * d.i <= p_partkey AND p_partkey % d.i = 0)")
def primes_filter(spark, sf):
    n = F.col("p_partkey")
    divisors = F.sequence(F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(F.sqrt(n))))
    return read(spark, sf, "part").where((n > 1) & ((n < 4) | ~F.exists(divisors, lambda d: n % d == 0))).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 6) AS product FROM lineitem ORDER BY l_orderkey, l_linenumber")
def map_ordered_pairs(spark, sf):
    rows = read(spark, sf, "lineitem").withColumn("_at", F.struct("l_orderkey", "l_linenumber"))
    return map_ordered(rows, "_at", product=F.round(F.col("l_quantity") * F.col("l_tax"), 6)).select("_at.*", "product")


@query("SELECT n_name AS name, n_nationkey * 10 + n_regionkey AS code FROM nation")
def map_python(spark, sf):
    """The parallel map of a Python function over sequences."""
    rows = read(spark, sf, "nation").select("n_name", "n_nationkey", "n_regionkey").collect()
    found = map_items(lambda name, a, b, by: (name, a * by + b), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], spark=spark, by=10)
    return spark.createDataFrame(found, "name string, code int")


@query("SELECT p_partkey, p_size * 3 + 7 AS value FROM part")
def job_config(spark, sf):
    """A job class with its configuration."""
    return configured(read(spark, sf, "part").select("p_partkey", F.col("p_size").alias("value")), {"jobs": [{"type": recipes.Scale, "by": 3, "plus": 7}]}, "p_partkey long, value int")


# --- rings


@query("SELECT round(sum(l_extendedprice), 2) AS total, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem HAVING count(*) > 0")
def reduce_global(spark, sf):
    return global_reduce(read(spark, sf, "lineitem"), {"total": F.round(F.sum("l_extendedprice"), 2), "n": F.count("*"), "mean": F.round(F.avg("l_quantity"), 6)})


@query("SELECT CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS n")
def reduce_global_empty(spark, sf):
    none = read(spark, sf, "part").where("p_size < 0")
    return global_reduce(none, {"total": F.sum("p_size"), "n": F.count("*")}, {"total": F.lit(0).cast("long"), "n": F.lit(0).cast("long")}, always=True)


@query("SELECT 1 AS total WHERE false")
def reduce_no_input(spark, sf):
    return global_reduce(read(spark, sf, "part").where("p_size < 0"), {"total": F.max("p_size")})


@query("SELECT o_orderkey, round(o_totalprice * 2 + 1, 4) AS total FROM orders")
def reduce_per_item(spark, sf):
    """Every order emits itself and itself plus one; the nested ring sums them within the row."""
    two = F.array("o_totalprice", F.col("o_totalprice") + 1)
    return read(spark, sf, "orders").select("o_orderkey", F.round(fold(two, F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def reduce_empty_rings(spark, sf):
    body = read(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    rings = read(spark, sf, "customer").select("c_custkey")
    return ring_reduce(rings, body, ["c_custkey"], {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)}, {"n": F.lit(0), "total": F.lit(0.0)})


@query("SELECT r_regionkey, round(sum(t), 2) AS total, max(n) AS busiest FROM (SELECT n_regionkey AS r_regionkey, n_nationkey, coalesce(sum(c_acctbal), 0) AS t, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY r_regionkey")
def reduce_nested_rings(spark, sf):
    nations = read(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    customers = read(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    inner = ring_reduce(nations, customers, ["n_nationkey"], {"total": F.sum("c_acctbal"), "n": F.count("*")}, {"total": F.lit(0.0), "n": F.lit(0)})
    rings = read(spark, sf, "region").select(F.col("r_regionkey"))
    outer = inner.select(F.col("n_regionkey").alias("r_regionkey"), "total", "n")
    return ring_reduce(rings, outer, ["r_regionkey"], {"total": F.round(F.sum("total"), 2), "busiest": F.max("n")}, {"total": F.lit(0.0), "busiest": F.lit(0)})


@query("SELECT CAST(sum(p_size) * 3 AS BIGINT) AS total FROM part")
def reduce_then_jobs(spark, sf):
    once = global_reduce(read(spark, sf, "part"), {"total": F.sum("p_size")})
    copies = flat_map(once, F.array_repeat("total", 3), "value")
    return global_reduce(copies, {"total": F.sum("value")})


@query("WITH s AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT 'lo' AS name, lo AS value FROM s UNION ALL SELECT 'hi', hi FROM s")
def reduce_multi_emit(spark, sf):
    store = global_reduce(read(spark, sf, "part"), {"lo": F.min("p_size"), "hi": F.max("p_size")})
    return store.select(F.explode(F.create_map(F.lit("lo"), "lo", F.lit("hi"), "hi")).alias("name", "value"))


@query("SELECT round(avg(length(w)), 6) AS mean, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''")
def word_length_avg(spark, sf):
    words = F.transform(F.split("text", " "), lambda w: F.when(w != "", w))
    found = flat_map(read(spark, sf, "documents"), words, "word")
    return global_reduce(found, {"mean": F.round(F.avg(F.length("word")), 6), "n": F.count("*")})


@query("SELECT round(sum(m * n) / sum(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS n FROM (SELECT avg(length(l)) AS m, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id)")
def line_stats_weighted(spark, sf):
    found = F.split("text", "\n")
    per_doc = read(spark, sf, "documents").select(F.size(found).cast("long").alias("n"), (F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.size(found)).alias("m"))
    return global_reduce(per_doc, {"mean": F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6), "n": F.sum("n")})


@query("SELECT n_regionkey, round(product(n_nationkey + 1.0), 2) AS product FROM nation GROUP BY n_regionkey")
def reduce_product(spark, sf):
    return read(spark, sf, "nation").groupBy("n_regionkey").agg(F.round(F.product(F.col("n_nationkey") + 1.0), 2).alias("product"))


@query("SELECT o_orderpriority, CAST(((sum(CAST(o_orderkey AS BIGINT) * 1000003) % 4294967296 + 4294967296 + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS total FROM orders GROUP BY o_orderpriority")
def int_wraparound(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(wrap_int32(F.sum(F.pmod(F.col("o_orderkey") * 1000003, F.lit(1 << 32)))).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN xor(o_orderkey, 255) WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS value FROM orders")
def polymorphic_dispatch(spark, sf):
    kind = F.element_at(F.array(F.lit("flip"), F.lit("same"), F.lit("other")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = read(spark, sf, "orders").select("o_orderkey", F.struct(kind.alias("kind"), "o_orderkey").alias("payload"))
    made = tagged(rows, F.col("payload.kind"), {"flip": F.col("payload.o_orderkey").bitwiseXOR(F.lit(255)), "same": F.col("payload.o_orderkey"), "other": F.lit(None)}, "value")
    return made.select("o_orderkey", "value")


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS BIGINT) AS total, count(*) AS n FROM lineitem WHERE l_linenumber <> 2")
def work_reduce(spark, sf):
    """Python jobs and a ring over all rows, folded in every task and merged."""
    work = Work(read(spark, sf, "lineitem").select("l_linenumber", F.col("l_quantity").cast("long").alias("q")), spark=spark)

    @work.job
    def product(line):
        return None if line["l_linenumber"] == 2 else line["q"] * line["l_linenumber"]

    @work.reduce(store=lambda: [0, 0], emit=lambda s: {"total": s[0], "n": s[1]})
    def total(store, works, others):
        for w in works:
            store[0], store[1] = store[0] + w, store[1] + 1
        for other in others:
            store[0], store[1] = store[0] + other[0], store[1] + other[1]

    return work.frame_of("total long, n long")


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def work_reduce_without_merge(spark, sf):
    """A ring whose function takes works only: one task folds what all tasks make."""
    work = Work(read(spark, sf, "orders").select("o_orderkey"), spark=spark)

    @work.job
    def both(key):
        return Multiple([key, None, 0])

    @work.reduce(store=lambda: [0], emit=lambda s: s[0])
    def total(store, works, others):
        store[0] += sum(works)

    return work.frame_of("total long")


@query("SELECT CAST(power(2, ceil(log2(sum(n_nationkey)))) AS BIGINT) AS value FROM nation")
def frame_over_all_rows(spark, sf):
    """A frame at the root: the first row opens it, the others are added, and what is recurred goes through the jobs."""
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("value"))
    return configured(rows, {"frame": recipes.Longest, "jobs": [recipes.Doubled]}, "value long")


# --- recurrence and loops

_TO_VALUE = "WITH RECURSIVE r AS (SELECT p_partkey, CAST(2 * (p_size + 1) + CASE WHEN p_size + 1 < 3 THEN 16 ELSE 0 END AS BIGINT) AS c FROM part UNION ALL SELECT p_partkey, c + 2 * (c + 1) FROM r WHERE c < 100) SELECT p_partkey, c AS value FROM r WHERE c >= 100"


def _to_value(spark: SparkSession, sf: str, checkpoint: Checkpoint | None = None) -> DataFrame:
    """Each part's ring sums a duplicated item plus one; small sums and unfinished rings recur."""
    parts = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("item"))
    start = parts.select("p_partkey", F.lit(0).cast("long").alias("value"))
    body = lambda items: items.select("p_partkey", F.explode(F.array_repeat(F.col("item") + 1, 2)).alias("out"))
    return supersteps(
        start,
        parts,
        body,
        ["p_partkey"],
        lambda made: made.groupBy("p_partkey").agg(F.sum("out").alias("value")),
        combine={"value": lambda old, new: old + new},
        again=lambda made: made.where("out < 3").select("p_partkey", F.lit(3).cast("long").alias("item")),
        done=lambda stores: (F.col("value") < 100, stores.select("p_partkey", F.col("value").alias("item"))),
        checkpoint=checkpoint,
    )


@query(_TO_VALUE)
def recur_get_to_value(spark, sf):
    return _to_value(spark, sf)


@query(_TO_VALUE)
def checkpoint_resume(spark, sf):
    """The same loop, stopped after each step and resumed until it is finished."""
    import uuid

    folder = f"{shared_dir(spark)}/ringweave-loop-{uuid.uuid4().hex}"
    while True:
        try:
            return _to_value(spark, sf, Checkpoint(folder, "to-value-100", stop_after=1))
        except Checkpoint.Stopped:
            continue


@query("WITH RECURSIVE r AS (SELECT n_nationkey, 2 * n_nationkey + 8 AS s FROM nation UNION ALL SELECT n_nationkey, 3 * s + 4 FROM r WHERE s < 1000) SELECT CAST(4 * (s + 1) AS BIGINT) AS total FROM r WHERE s >= 1000")
def recur_nested(spark, sf):
    """Five levels of rings per nation, by Python jobs in the task that holds the row."""
    rows = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("value"))
    return configured(rows, recipes.nested_rings(), "total long")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * (p_size + 1) // 2 AS total FROM part")
def frame_sum_through(spark, sf):
    n = F.col("p_size").cast("long")
    return read(spark, sf, "part").select("p_partkey", fold(F.sequence(F.lit(1).cast("long"), n), F.lit(0).cast("long"), lambda a, i: a + i).alias("total"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * (p_size + 1) // 2 AS value FROM part")
def frame_of_jobs(spark, sf):
    """The same by a frame of Python jobs, a loop per row in the task that holds it."""
    rows = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("value"))
    return configured(rows, {"jobs": [{"frame": recipes.Through, "jobs": [{"type": recipes.Scale}]}]}, "p_partkey long, value long")


@query("WITH RECURSIVE r AS (SELECT p_partkey, p_size AS first, 1 AS v FROM part UNION ALL SELECT p_partkey, first, v * 2 FROM r WHERE v < first) SELECT p_partkey, v AS value FROM r WHERE v >= first")
def frame_pow2(spark, sf):
    """The next power of two, by doubling; the size waits in the key columns."""
    rows = read(spark, sf, "part").select("p_partkey", "p_size", F.lit(1).alias("one"))
    return row_loop(rows, ["p_partkey", "p_size"], "one", "value < p_size", "value * 2").select("p_partkey", "value")


@query("WITH RECURSIVE r AS (SELECT p_partkey, p_size AS v FROM part UNION ALL SELECT p_partkey, v + v // 2 + 1 FROM r WHERE v < 100) SELECT p_partkey, v AS value FROM r WHERE v >= 100")
def frame_get_to_cap(spark, sf):
    return row_loop(read(spark, sf, "part"), ["p_partkey"], "p_size", "value < 100", "value + value div 2 + 1").select("p_partkey", "value")


@query("WITH RECURSIVE a AS (SELECT p_partkey, p_size AS v FROM part UNION ALL SELECT p_partkey, v + v // 2 + 1 FROM a WHERE v < 50), b AS (SELECT p_partkey, v + 1 AS v FROM a WHERE v >= 50), c AS (SELECT p_partkey, v FROM b UNION ALL SELECT p_partkey, v + v // 2 + 1 FROM c WHERE v < 100) SELECT p_partkey, v + 1 AS value FROM c WHERE v >= 100")
def frame_two_stage(spark, sf):
    step = "value + value div 2 + 1"
    first = row_loop(read(spark, sf, "part"), ["p_partkey"], "p_size", "value < 50", step)
    then = first.select("p_partkey", (F.col("value") + 1).alias("v"))
    return row_loop(then, ["p_partkey"], "v", "value < 100", step).select("p_partkey", (F.col("value") + 1).alias("value"))


@query("SELECT n_nationkey, CAST(sum(a + 1) // count(*) AS BIGINT) AS value FROM (SELECT n_nationkey, ascii(unnest(string_split(n_name, ''))) AS a FROM nation) GROUP BY n_nationkey")
def frame_char_avg(spark, sf):
    total = (code_sum(F.col("n_name")) + F.length("n_name")).cast("long")
    return read(spark, sf, "nation").select("n_nationkey", F.floor(total / F.length("n_name")).cast("long").alias("value"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * (p_size - 1) // 2 + p_size AS value FROM part")
def frame_triangle(spark, sf):
    n = F.col("p_size").cast("long")
    return read(spark, sf, "part").select("p_partkey", fold(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i + 1), F.lit(0).cast("long"), lambda a, b: a + b).alias("value"))


@query("WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, v + v // 2 + 1 FROM r WHERE v < 60) SELECT l_orderkey, CAST(sum(v) AS BIGINT) AS total FROM r WHERE v >= 60 GROUP BY l_orderkey")
def frame_nested(spark, sf):
    """Outer frames are orders, inner ones their lines; each line loops within its row."""
    rows = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    grown = row_loop(rows, ["l_orderkey"], "q", "value < 60", "value + value div 2 + 1")
    return grown.groupBy("l_orderkey").agg(F.sum("value").alias("total"))


@query("SELECT p_partkey, p_size AS value FROM part")
def frame_empty_body(spark, sf):
    """Nothing between the frame's ends: the first item is the result."""
    return configured(read(spark, sf, "part").select("p_partkey", F.col("p_size").alias("value")), {"jobs": [{"frame": recipes.Kept, "jobs": []}]}, "p_partkey long, value int")


@query("SELECT CAST(sum(CAST(p_size AS BIGINT) * (p_size + 1) // 2) AS BIGINT) AS total, count(*) AS n FROM part")
def frame_into_reducer(spark, sf):
    return global_reduce(frame_sum_through(spark, sf), {"total": F.sum("total"), "n": F.count("*")})


def _hit(user: str, i: str) -> str:
    """Whether a point lies in the circle, in SQL for both engines; points come from a generator over whole numbers."""
    mixed = lambda k: f"((({user} * 7919 + {i} * 104729 + {k}) % 1048583) * (({user} * 7919 + {i} * 104729 + {k}) % 1048583) + {i} * 31 + {k}) % 1048583"
    x, y = (f"({mixed(k)})" for k in (15485863, 32452843))
    return f"CASE WHEN {x} * {x} + {y} * {y} < 1099526307889 THEN 1 ELSE 0 END"


_PI = f"""
WITH p AS (SELECT user_id, i, {_hit("user_id", "i")} AS hit FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id FROM events) u, range(4096) r(i)),
n AS (SELECT user_id, CAST(64 << k AS BIGINT) AS n, CAST(sum(hit) FILTER (i < (64 << k)) AS BIGINT) AS inside FROM p, range(7) t(k) GROUP BY user_id, k),
e AS (SELECT user_id, n, inside / n AS share FROM n)
SELECT user_id, min(n) AS n, arg_min(4 * share, n) AS pi FROM e WHERE 4 * 1.96 * sqrt(share * (1 - share) / n) <= 0.1 GROUP BY user_id
"""


@query(_PI)
def frame_pi(spark, sf):
    """Trials double until pi is known to the asked precision."""
    users = read(spark, sf, "events").select(F.col("user_id").cast("long").alias("user_id")).distinct()
    rings = users.select("user_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("inside"))
    first = users.select("user_id", F.lit(0).cast("long").alias("lo"), F.lit(64).cast("long").alias("hi"))

    def body(items: DataFrame) -> DataFrame:
        points = items.select("user_id", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("i"))
        return points.select("user_id", F.expr(_hit("user_id", "i")).cast("long").alias("hit"))

    share = F.col("inside") / F.col("n")
    error = 4 * 1.96 * F.sqrt(share * (1 - share) / F.col("n"))
    found = supersteps(
        rings,
        first,
        body,
        ["user_id"],
        lambda made: made.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("hit").alias("inside")),
        combine={"n": lambda a, b: a + b, "inside": lambda a, b: a + b},
        again=None,
        done=lambda stores: (error > 0.1, stores.select("user_id", F.col("n").alias("lo"), (2 * F.col("n")).alias("hi"))),
    )
    return found.select("user_id", "n", (4 * share).alias("pi"))


@query()
def frame_evolve(spark, sf):
    """A small genetic search for weights that solve exclusive or; a population per region, seeded."""
    rows = read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("value"))
    return configured(rows, recipes.evolution(), "seed long, generations long, error double")


# --- sweeps


@query("SELECT CAST(r_regionkey + 5 * n_nationkey AS BIGINT) AS id, r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def sweep_grid(spark, sf):
    """Ids count through the combinations, the first parameter fastest; the tables are the parameters' values."""
    regions = read(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey")
    nations = read(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey")
    return grid(spark, {"r_regionkey": regions, "n_nationkey": nations})


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1 AS BIGINT), 'x'), (1, 5, 'y'), (2, 9, 'z')) t(id, a, b)")
def sweep_list(spark, sf):
    from .sweep import experiments

    found, _ = experiments([{"a": 1, "b": "x"}, {"a": 5, "b": "y"}, {"a": 9, "b": "z"}])
    return spark.createDataFrame([(i, p["a"], p["b"]) for i, p in enumerate(found)], "id long, a long, b string")


_CRITICAL = "CASE WHEN n - 1 > 15 THEN 1.96 WHEN n - 1 >= 10 THEN 2.23 WHEN n - 1 >= 5 THEN 2.57 WHEN n - 1 >= 4 THEN 2.78 WHEN n - 1 >= 3 THEN 3.18 WHEN n - 1 >= 2 THEN 4.30 WHEN n - 1 >= 1 THEN 12.71 ELSE 1.96 END"


@query(f"SELECT l_returnflag, l_linestatus, n AS trials, round(m, 6) AS value, round(d, 6) AS value_dev, round(({_CRITICAL}) * d / sqrt(n), 6) AS value_err FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY ALL)")
def sweep_stats(spark, sf):
    found = read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("d"))
    return found.select("l_returnflag", "l_linestatus", F.col("n").alias("trials"), F.round("m", 6).alias("value"), F.round("d", 6).alias("value_dev"), F.round(critical(F.col("n")) * F.col("d") / F.sqrt("n"), 6).alias("value_err"))


@query(f"SELECT l_orderkey, n, CAST(ceil(pow(({_CRITICAL}) * d / greatest(0.1 * abs(m), 0.01), 2) + CASE WHEN n - 1 > 15 THEN 0 ELSE 1 END) AS BIGINT) AS needed FROM (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS m, coalesce(stddev_pop(l_quantity), 0) AS d FROM lineitem GROUP BY l_orderkey)")
def sweep_trials_needed(spark, sf):
    found = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("d"))
    return found.select("l_orderkey", "n", needed(F.col("n"), F.col("m"), F.col("d"), 0.1, 0.01).alias("needed"))


@query("SELECT CAST(i AS BIGINT) AS id, CAST(8 AS BIGINT) AS trials, CAST(i + 1 AS BIGINT) AS a, round(3.5 * (i + 1), 6) AS value, round(sqrt(5.25) * (i + 1), 6) AS value_dev, round(2.57 * sqrt(5.25) / sqrt(8) * (i + 1), 6) AS value_err FROM range(4) t(i)")
def sweep_deterministic(spark, sf):
    from .sweep import sweep

    with sweep({"a": [1, 2, 3, 4]}, -8, cpus=8, spark=spark, report=None) as w:
        w.job(lambda id, trial, a: {"value": trial * a})
    rows = [(int(i), int(r.trials), int(r.a), *(round(float(x), 6) for x in (r.value, r.value_dev, r.value_err))) for i, r in w.report.iterrows()]
    return spark.createDataFrame(rows, "id long, trials long, a long, value double, value_dev double, value_err double")


# --- sources and sinks


@query("SELECT n_nationkey AS value FROM nation UNION ALL SELECT r_regionkey + 100 FROM region")
def init_adds_work(spark, sf):
    """init runs once on the driver and adds to the work of a table."""
    regions = [r[0] for r in read(spark, sf, "region").select("r_regionkey").collect()]
    work = Work(read(spark, sf, "nation").select("n_nationkey"), spark=spark)
    work.init(lambda: Multiple([r + 100 for r in regions]))
    return work.frame_of("value int")


@query("SELECT array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS found FROM nation")
def finish_collect(spark, sf):
    work = Work(read(spark, sf, "nation").select("n_nationkey"), spark=spark)
    work.finish(lambda found: ",".join(str(x) for x in sorted(found)))
    return spark.createDataFrame([(work.run(),)], "found string")


@query("SELECT CAST(trim(json_extract_string(props, '$.k')) AS INTEGER) AS value FROM events WHERE length(trim(json_extract_string(props, '$.k'))) > 0")
def line_source(spark, sf):
    text = read(spark, sf, "events").select(F.concat(F.lit("  "), F.get_json_object("props", "$.k"), F.lit(" ")).alias("value"))
    return lines(text, "value", "int")


@query("SELECT '17 18' AS value")
def seed_source(spark, sf):
    return seed_line(spark, [" 17", "18 "])


@query("SELECT n_name AS line FROM nation")
def external_pipe(spark, sf):
    """Rows through an external program, a batch at a time."""
    import pyarrow as pa

    from .external import run_with_stdin

    def run(batches):
        for batch in batches:
            given = batch.column(0).to_pylist()
            status, out, err = run_with_stdin(["/bin/cat"], "".join(f"{x}\n" for x in given))
            if status:
                raise RuntimeError(err)
            yield pa.RecordBatch.from_pydict({"line": out.removesuffix("\n").split("\n") if out else []}, pa.schema([("line", pa.string())]))

    return read(spark, sf, "nation").select("n_name").mapInArrow(run, "line string")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_reduce(spark, sf):
    """A ring by key over a stream that ends: the stream's batches are merged by the running reduction."""
    schema = read(spark, sf, "events").schema
    # a pattern that only this name meets: a stream's source is a folder or a pattern
    stream = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet")
    totals, path = new_path(spark, "totals"), []
    grouped = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{totals}/{batch}")
        path.append(f"{totals}/{batch}")

    run = grouped.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(path[-1]).select("event_type", "n", F.round("total", 4).alias("total"))
