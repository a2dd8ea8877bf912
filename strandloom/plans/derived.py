"""Alignments, contigs and graphs derived from the test tables, for queries that need such inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: The same views in SQL, for the queries' counterparts.
SQL = """
with aln as (
    select cast(l_orderkey as varchar) as read,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as line_no,
        'c' || lpad(cast(l_suppkey % 60 as varchar), 2, '0') as contig, cast((l_partkey * 37) % 900 as integer) as s,
        cast((l_partkey * 37) % 900 + 100 as integer) as e, case when l_linestatus = 'O' then '+' else '-' end as strand
    from lineitem
), ctg as (
    select 'c' || lpad(cast(k as varchar), 2, '0') as contig, cast(1000 + (k * 17) % 500 as integer) as length
    from (select distinct l_suppkey % 60 as k from lineitem)
), last as (
    select read, max(line_no) as line_no from aln where line_no > 1 group by read
), pairs as (
    select f.read, f.contig as c1, f.s as s1, f.e as e1, f.strand as t1, g.contig as c2, g.s as s2, g.e as e2, g.strand as t2
    from aln f join last on f.read = last.read and f.line_no = 1 join aln g on g.read = last.read and g.line_no = last.line_no
), intra as (
    select read, c1 as contig, cast(case when s1 <= s2 then e2 - s1 + 1 else e1 - s2 + 1 end as bigint) as insert_size from pairs where c1 = c2
), lib as (
    select avg(insert_size) as mean, stddev_pop(insert_size) as stdev, count(*) as n from intra
), cov as (
    select contig, n * (select mean from lib) / length as coverage
    from (select contig, count(*) as n from intra group by contig) join ctg using (contig)
), links as (
    select read, c1 as a, case when t1 = '+' then 'E' else 'B' end as oa, c2 as b, case when t2 = '+' then 'E' else 'B' end as ob,
        (select mean from lib) - (case when t1 = '+' then x.length - s1 else e1 end) - (case when t2 = '-' then e2 else y.length - s2 end) as mean,
        (select stdev from lib) as stdev
    from pairs join ctg x on x.contig = c1 join ctg y on y.contig = c2
    where least(x.length, y.length) > 500 and c1 <> c2
), iv as (
    select *, mean - 3 * stdev as lo, mean + 3 * stdev as hi, count(*) over (partition by a, oa, b, ob) as n,
        row_number() over (partition by a, oa, b, ob order by cast(trunc(mean - 3 * stdev) as integer), read) as i,
        row_number() over (partition by a, oa, b, ob order by read) as place
    from links
), depth as (
    select p.a, p.oa, p.b, p.ob, p.i, p.lo, p.i - count(*) filter (where q.hi < p.lo) as d
    from iv p join iv q on p.a = q.a and p.oa = q.oa and p.b = q.b and p.ob = q.ob
    where p.n > 3 and p.i < p.n
    group by p.a, p.oa, p.b, p.ob, p.i, p.lo
), best as (
    select a, oa, b, ob, lo from (select *, row_number() over (partition by a, oa, b, ob order by d desc, i) as r from depth) where r = 1
), chosen as (
    select iv.* from iv join best using (a, oa, b, ob) where iv.lo <= best.lo and iv.hi >= best.lo
), bundles as (
    select a, oa, b, ob, sum(mean / w) / sum(1 / w) as mean, 1 / sqrt(sum(1 / w)) as stdev, cast(count(*) as integer) as bsize
    from (select *, case when stdev = 0 then 1 else stdev * stdev end as w from chosen) group by a, oa, b, ob
), bundled as (
    select * from bundles where bsize >= 3
), walk as (
    select lag(node) over (partition by user_id order by ts, event_id) as a, node as b
    from (select *, 'u' || user_id || ':' || event_type as node from events)
), edges as (
    select distinct a, b from walk where a is not null
), deg as (
    select contig, count(*) as degree from (select a as contig from bundled union all select b from bundled) group by contig
), near as (
    select distinct * from (select a as node, b as neigh from bundled union all select b, a from bundled)
), skewed as (
    select node as contig, sum(case when x.coverage >= 2 * y.coverage then 1.0 else 0.0 end) / count(*) as skew
    from near left join cov x on x.contig = node left join cov y on y.contig = neigh group by node
), ord as (
    select o_orderkey, o_custkey, 'o' || lpad(cast(o_orderkey as varchar), 9, '0') as o,
        lag('o' || lpad(cast(o_orderkey as varchar), 9, '0')) over (partition by o_custkey order by o_orderdate, o_orderkey) as before
    from orders where o_orderkey in (select l_orderkey from lineitem)
), item as (
    select 'o' || lpad(cast(l_orderkey as varchar), 9, '0') as o, cast(l_quantity as integer) as bsize,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as rn
    from lineitem where l_orderkey in (select o_orderkey from orders)
), flow as (
    select o || ':0' as a, o || ':1' || lpad(cast(rn as varchar), 2, '0') as b, bsize from item
    union all select o || ':1' || lpad(cast(rn as varchar), 2, '0'), o || ':2', bsize from item
    union all select before || ':2', o || ':0', 5 from ord where before is not null
), lines as (
    select o, count(*) as n from item group by o
), central as (
    select contig, degree / 1000.0 as score from deg where degree >= (select quantile_cont(degree, 0.9) from deg)
), others as (
    select contig from cov where coverage >= (select quantile_cont(coverage, 0.9) from cov)
), orient as (
    select contig, case when length % 2 = 0 then 'FOW' else 'REV' end as orient from ctg
)
"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    start = (F.col("l_partkey") * 37 % 900).cast("int")
    return rows.select(
        contig_name(F.col("l_suppkey") % 60).alias("contig"),
        start.alias("start"),
        (start + 100).alias("end"),
        F.col("l_orderkey").cast("string").alias("read"),
        F.lit(0).alias("mapq"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        F.row_number().over(order).cast("long").alias("line_no"),
    )


def contig_name(k):
    return F.concat(F.lit("c"), F.lpad(k.cast("string"), 2, "0"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 60).alias("k")).distinct()
    return rows.select(contig_name(k).alias("contig"), (1000 + k * 17 % 500).cast("int").alias("length"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct steps between the kinds of events of a user, as edges."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("node", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")))
    before = F.lag("node").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select(before.alias("a"), F.col("node").alias("b")).filter("a is not null").distinct()


def order_flow(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """a, oa, b, ob, bsize: each order leads from its beginning through its items to its end, and on to the customer's next order.

    An order of several items is a bubble; a customer's orders are a path. A customer's edges lie together. The whole flow has also orders
    without items, which lead straight to their end, and items without an order.
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_quantity").cast("int").alias("bsize"), F.row_number().over(order).alias("rn"))
    # an order that stands twice is twice on its way and has its items once
    again = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("o_custkey", "o_orderdate"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", again.alias("again"))
    rows = items.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "full" if whole else "inner")
    # items without an order have no customer, whose orders they would follow
    rows = rows.withColumn("stray", F.when(F.col("o_orderkey").isNull(), F.col("l_orderkey")) if whole else F.lit(None).cast("long"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", *["stray"] * whole).orderBy("o_orderdate", "o_orderkey", "again", "rn"))
    rows = rows.withColumn("before", F.when(F.coalesce("rn", F.lit(1)) == 1, before))
    rows = rows.withColumn("o_orderkey", F.coalesce("o_orderkey", "stray")).filter("o_orderkey is not null")
    name = lambda c: F.concat(F.lit("o"), F.lpad(F.col(c).cast("string"), 9, "0"))
    edge = lambda a, b, size: F.struct(a.alias("a"), b.alias("b"), size.alias("bsize"))
    begin, end = F.concat(name("o_orderkey"), F.lit(":0")), F.concat(name("o_orderkey"), F.lit(":2"))
    mid = F.concat(name("o_orderkey"), F.lit(":1"), F.lpad(F.col("rn").cast("string"), 2, "0"))
    item = F.when(F.col("rn").isNull(), F.array(edge(begin, end, F.lit(5)))).otherwise(F.array(edge(begin, mid, F.col("bsize")), edge(mid, end, F.col("bsize"))))
    item = F.when(F.coalesce("again", F.lit(1)) == 1, item).otherwise(F.array())
    on = F.when(F.col("before").isNotNull(), F.array(edge(F.concat(name("before"), F.lit(":2")), begin, F.lit(5)))).otherwise(F.array())
    return rows.select(F.explode(F.concat(item, on)).alias("e")).select("e.a", F.lit("E").alias("oa"), "e.b", F.lit("B").alias("ob"), "e.bsize")
