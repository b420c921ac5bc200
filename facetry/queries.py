"""Queries over the driver's tables, each with the SQL that gives the same rows where SQL can. All run over whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.functions import analysis
from facetry.functions.stemming import dutch_tokens
from facetry.operators import cluster, facets, ranking, suggest, terms
from facetry.operators.core import Core, Field, Similarity
from facetry.operators.facets import Facet
from facetry.operators.keys import KeyNode, KeySet, bitmap_keys, bitmaps, distinct_keys, evaluate
from facetry.operators.ranking import SortKey
from facetry.plans import codec, cql, nodes
from facetry.plans.compile import predicate, with_scores
from facetry.plans.composed import ComposedQuery, execute
from facetry.plans.nodes import And, Bool, Distance, Drilldown, Leaf, MatchAll, Not, Or, Phrase, Prefix, Range, Term, Wildcard, must, should
from facetry.session import shared_folder, ship
from facetry.sources import documents as ingest
from facetry.streaming.ingest import upsert_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_IDS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "nation": "n_nationkey", "region": "r_regionkey"}
_FIELDS = {"documents": {"text": Field("text")}, "part": {"p_name": Field("text", "p_name")}}


def spread(df: DataFrame) -> DataFrame:
    """Rows of a file that can't be split over all cores are dealt out before their texts are analysed; a large table comes in enough parts as it is."""
    cores_ = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores_) if df.rdd.getNumPartitions() < cores_ else df


def core(spark: SparkSession, sf_dir: str, name: str) -> Core:
    df = table(spark, sf_dir, name)
    return Core(name, spread(df) if name == "documents" else df, _IDS[name], _FIELDS.get(name, {}))


def cores(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, Core]:
    return {n: core(spark, sf_dir, n) for n in names}


def t(field: str, value: str) -> Term:
    return Term(field=field, value=value)


def text_predicate(spark: SparkSession, sf_dir: str, node) -> DataFrame:
    docs = core(spark, sf_dir, "documents")
    return docs.df.where(predicate(docs, node)).select("doc_id", "lang")


def scores(spark: SparkSession, sf_dir: str, node, **changes) -> DataFrame:
    docs = core(spark, sf_dir, "documents")
    docs = Core(docs.name, docs.df, docs.id, docs.fields, **changes)
    rows = docs.df.where(predicate(docs, node))
    return with_scores(docs, rows, node).select("doc_id", F.round("score", 6).alias("score"))


def _folded(text: str) -> str:
    out = f"translate(lower({text}), '{analysis.FOLD_FROM}', '{analysis.FOLD_TO}')"
    for a, b in analysis.LONG_FOLDS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def sql_tokens(text: str = "text") -> str:
    return f"coalesce(regexp_extract_all({_folded(text)}, '{analysis.TOKEN}'), [])"


TOKENS = f"tok as (select doc_id, lang, text, {sql_tokens()} as tok from documents)"


# Scans, predicates, projections.


@query("""
select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders
where o_orderpriority = '1-URGENT' and o_orderkey > 0 and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')
order by o_totalprice desc, o_orderkey limit 10""")
def search_top_orders(spark, sf_dir):
    """Urgent orders with a returned line, the ten of the highest price."""
    q = ComposedQuery("orders", queries={"orders": t("o_orderpriority", "1-URGENT"), "lineitem": t("l_returnflag", "R")}, sort_keys=[SortKey("o_totalprice", True, "Double")], stored=["o_totalprice"])
    hits = execute(q.match("orders", "lineitem", "o_orderkey", "l_orderkey"), cores(spark, sf_dir, "orders", "lineitem")).hits
    price = F.col("o_totalprice")[0]
    return hits.select(F.col("id").alias("o_orderkey"), price.alias("o_totalprice"), F.row_number().over(Window.orderBy(F.desc(price), "id")).cast("long").alias("rank"))


@query("select count(*) as total, count(*) as total_with_duplicates from orders where o_orderstatus = 'F' or o_totalprice >= 300000")
def total_hits(spark, sf_dir):
    node = should(t("o_orderstatus", "F"), Range(kind="Double", field="o_totalprice", low=300000))
    return execute(ComposedQuery("orders", queries={"orders": node}, stop=0), cores(spark, sf_dir, "orders")).total


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and not (o_totalprice > 200000)")
def boolean(spark, sf_dir):
    c = core(spark, sf_dir, "orders")
    node = Bool(clauses=(("MUST", t("o_orderstatus", "F")), ("MUST", should(t("o_orderpriority", "1-URGENT"), t("o_orderpriority", "2-HIGH"))), ("MUST_NOT", Range(kind="Double", field="o_totalprice", low=200000, with_low=False))))
    return c.df.where(predicate(c, node)).select("o_orderkey", "o_custkey")


@query("select p_partkey from part where p_size >= 10 and p_size < 20")
def range_int(spark, sf_dir):
    c = core(spark, sf_dir, "part")
    return c.df.where(predicate(c, Range(kind="Int", field="p_size", low=10, high=20, with_high=False))).select("p_partkey")


@query("select o_orderkey from orders where o_orderkey >= 100 and o_orderkey <= 5000")
def range_long(spark, sf_dir):
    c = core(spark, sf_dir, "orders")
    return c.df.where(predicate(c, Range(kind="Long", field="o_orderkey", low=100, high=5000))).select("o_orderkey")


@query("select s_suppkey, round(s_acctbal, 2) as s_acctbal from supplier where s_acctbal > 1000 and s_acctbal <= 8000")
def range_double(spark, sf_dir):
    c = core(spark, sf_dir, "supplier")
    return c.df.where(predicate(c, Range(kind="Double", field="s_acctbal", low=1000, high=8000, with_low=False))).select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("select p_partkey, p_brand from part where p_brand > 'Brand#12' and p_brand <= 'Brand#20'")
def range_string(spark, sf_dir):
    c = core(spark, sf_dir, "part")
    return c.df.where(predicate(c, Range(field="p_brand", low="Brand#12", high="Brand#20", with_low=False))).select("p_partkey", "p_brand")


@query(f"with {TOKENS} select doc_id, lang from tok where list_contains(tok, 'licensed')")
def term(spark, sf_dir):
    return text_predicate(spark, sf_dir, t("text", "licensed"))


@query(f"with {TOKENS} select doc_id, lang from tok where contains(' ' || array_to_string(tok, ' ') || ' ', ' the apache license ')")
def phrase(spark, sf_dir):
    return text_predicate(spark, sf_dir, Phrase(field="text", terms=("the", "apache", "license")))


@query(f"with {TOKENS} select doc_id, lang from tok where len(list_filter(tok, lambda x: starts_with(x, 'licen'))) > 0")
def prefix(spark, sf_dir):
    return text_predicate(spark, sf_dir, Prefix(field="text", value="licen"))


@query(f"with {TOKENS} select doc_id, lang from tok where len(list_filter(tok, lambda x: regexp_full_match(x, 'l.cens.*'))) > 0")
def wildcard(spark, sf_dir):
    return text_predicate(spark, sf_dir, Wildcard(field="text", value="l?cens*"))


@query(f"with {TOKENS} select doc_id, lang from tok where not list_contains(tok, 'the') and lang = 'en'")
def negation(spark, sf_dir):
    return text_predicate(spark, sf_dir, Bool(clauses=(("MUST", t("lang", "en")), ("MUST_NOT", t("text", "the")))))


@query("""
select s_suppkey from (select s_suppkey, (s_suppkey % 180) - 90.0 as lat, (s_nationkey * 14.0) - 180.0 as lon from supplier)
where 2 * 6371008.7714 * asin(sqrt(pow(sin(radians(lat + 40.0) / 2), 2) + cos(radians(lat)) * cos(radians(-40.0)) * pow(sin(radians(lon - 5.0) / 2), 2))) <= 5000000""")
def geo_distance(spark, sf_dir):
    c = core(spark, sf_dir, "supplier")
    lat, lon = (F.col("s_suppkey") % 180 - 90).cast("double"), F.col("s_nationkey") * 14.0 - 180.0
    c = Core("supplier", c.df.withColumn("place", F.struct(lat.alias("lat"), lon.alias("lon"))), "s_suppkey", {"place": Field("geo", "place")})
    return c.df.where(predicate(c, Distance(field="place", lat=-40.0, lon=5.0, radius=5_000_000))).select("s_suppkey")


# Joins by key.


@query("select c_custkey, c_mktsegment from customer where c_custkey > 0 and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def semi_join(spark, sf_dir):
    q = ComposedQuery("customer", filters={"orders": [t("o_orderpriority", "1-URGENT")]}).match("customer", "orders", "c_custkey", "o_custkey")
    return execute(q, cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey", "c_mktsegment")


@query("select c_custkey from customer where not (c_custkey > 0 and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT'))")
def anti_join(spark, sf_dir):
    q = ComposedQuery("customer", excludes={"orders": [t("o_orderpriority", "1-URGENT")]}).match("customer", "orders", "c_custkey", "o_custkey")
    return execute(q, cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


@query("""
select c_custkey from customer where not (c_custkey > 0 and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')
and c_custkey in (select o_custkey from orders where o_orderstatus = 'F'))""")
def anti_join_of_both(spark, sf_dir):
    """Several excludes on one key drop a row only if its key is in all of them."""
    q = ComposedQuery("customer", excludes={"orders": [t("o_orderpriority", "1-URGENT"), t("o_orderstatus", "F")]}).match("customer", "orders", "c_custkey", "o_custkey")
    return execute(q, cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


@query("""
select c_custkey from customer where c_custkey > 0 and (c_mktsegment = 'BUILDING' or c_custkey in (select o_custkey from orders where o_totalprice > 400000))
and c_acctbal > 0""")
def unite(spark, sf_dir):
    q = ComposedQuery("customer", queries={"customer": Range(kind="Double", field="c_acctbal", low=0, with_low=False)}, unites=[("customer", t("c_mktsegment", "BUILDING"), "orders", Range(kind="Double", field="o_totalprice", low=400000, with_low=False))])
    return execute(q.match("customer", "orders", "c_custkey", "o_custkey"), cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


@query("""
select o_orderkey from orders where o_orderkey > 0 and o_custkey > 0 and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')
and o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')""")
def three_cores(spark, sf_dir):
    q = ComposedQuery("orders", queries={"lineitem": t("l_returnflag", "R"), "customer": t("c_mktsegment", "MACHINERY")})
    q.match("orders", "lineitem", "o_orderkey", "l_orderkey").match("orders", "customer", "o_custkey", "c_custkey")
    return execute(q, cores(spark, sf_dir, "orders", "lineitem", "customer")).rows.select("o_orderkey")


@query("select distinct o_custkey as key from orders where o_custkey > 0 and o_orderstatus = 'P'")
def export_keys(spark, sf_dir):
    q = ComposedQuery("orders", queries={"orders": t("o_orderstatus", "P")}, export_key="o_custkey")
    return execute(q, cores(spark, sf_dir, "orders")).keys


@query("""
select distinct c_custkey as key from customer where c_custkey > 0 and c_mktsegment = 'FURNITURE' and c_custkey in
(select o_custkey from orders where o_orderkey > 0 and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R' and l_orderkey > 0))""")
def relational_and(spark, sf_dir):
    """Keys of lines become keys of orders and then of customers."""
    lines = Leaf(core="lineitem", collect_key="l_orderkey", filter_key="l_orderkey", query=t("l_returnflag", "R"))
    orders = Leaf(core="orders", collect_key="o_custkey", filter_key="o_orderkey")
    customers = Leaf(core="customer", collect_key="c_custkey", filter_key="c_custkey", query=t("c_mktsegment", "FURNITURE"))
    return evaluate(And(first=And(first=lines, second=orders), second=customers), cores(spark, sf_dir, "lineitem", "orders", "customer")).df


@query("""
select c_custkey from customer where c_custkey > 0 and (c_mktsegment = 'BUILDING' or c_custkey in (select o_custkey from orders where o_orderstatus = 'F'))""")
def relational_or(spark, sf_dir):
    tree = Or(first=Leaf(core="orders", collect_key="o_custkey", filter_key="o_custkey", query=t("o_orderstatus", "F")), second=Leaf(core="customer", collect_key="c_custkey", filter_key="c_custkey", query=t("c_mktsegment", "BUILDING")))
    q = ComposedQuery("customer", relational=tree).match("customer", "orders", "c_custkey", "o_custkey")
    return execute(q, cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


@query("""
select c_custkey from customer where not (c_custkey > 0 and c_mktsegment = 'BUILDING' and c_custkey in (select o_custkey from orders where o_orderstatus = 'F'))""")
def relational_not(spark, sf_dir):
    tree = Not(query=And(first=Leaf(core="orders", collect_key="o_custkey", filter_key="o_custkey", query=t("o_orderstatus", "F")), second=Leaf(core="customer", collect_key="c_custkey", filter_key="c_custkey", query=t("c_mktsegment", "BUILDING"))))
    q = ComposedQuery("customer", relational=tree).match("customer", "orders", "c_custkey", "o_custkey")
    return execute(q, cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


# Facets.


def _flat(response_facets: DataFrame) -> DataFrame:
    return response_facets.select("dim", F.array_join("path", ">").alias("path"), "label", "count")


@query("""
select 'o_orderpriority' as dim, '' as path, o_orderpriority as label, count(*) as count from orders where o_orderstatus = 'F' group by o_orderpriority
union all select 'o_orderstatus', '', o_orderstatus, count(*) from orders where o_orderstatus = 'F' group by o_orderstatus""")
def facet_flat(spark, sf_dir):
    q = ComposedQuery("orders", queries={"orders": t("o_orderstatus", "F")}, facets={"orders": [Facet("o_orderpriority", 0), Facet("o_orderstatus", 0)]})
    return _flat(execute(q, cores(spark, sf_dir, "orders")).facets)


@query("select 'p_brand' as dim, '' as path, p_brand as label, count(*) as count from part group by p_brand order by count(*) desc, p_brand limit 5")
def facet_top(spark, sf_dir):
    q = ComposedQuery("part", facets={"part": [Facet("p_brand", 5)]})
    return _flat(execute(q, cores(spark, sf_dir, "part")).facets)


@query("""
select 'l_returnflag' as dim, '' as path, l_returnflag as label, count(*) as count from lineitem
where l_orderkey > 0 and l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT') and l_linestatus = 'F' group by l_returnflag""")
def facet_join(spark, sf_dir):
    q = ComposedQuery("orders", queries={"orders": t("o_orderpriority", "1-URGENT")}, facet_filters={"lineitem": [t("l_linestatus", "F")]}, facets={"lineitem": [Facet("l_returnflag", 0)]})
    return _flat(execute(q.match("orders", "lineitem", "o_orderkey", "l_orderkey"), cores(spark, sf_dir, "orders", "lineitem")).facets)


def _places(spark, sf_dir) -> Core:
    """Customers with a path region > nation > segment."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    df = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("place", F.array(F.array("r_name", "n_name", "c_mktsegment")))
    return Core("customer", df, "c_custkey", {"place": Field("facet", "place", hierarchical=True)})


_PLACES = "c as (select c_custkey, r_name, n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


@query(f"""
with {_PLACES} select 'place' as dim, '' as path, r_name as label, count(*) as count from c group by r_name
union all select 'place', r_name, n_name, count(*) from c group by r_name, n_name
union all select 'place', r_name || '>' || n_name, c_mktsegment, count(*) from c group by r_name, n_name, c_mktsegment""")
def facet_hierarchical(spark, sf_dir):
    c = _places(spark, sf_dir)
    return _flat(facets.facet_counts(c, c.df, Facet("place", 0)))


@query(f"""
with {_PLACES}, one as (select r_name, count(*) as n from c group by r_name order by n desc, r_name limit 2),
two as (select r_name, n_name, count(*) as n, row_number() over (partition by r_name order by count(*) desc, n_name) as rn from c group by r_name, n_name),
three as (select r_name, n_name, c_mktsegment, count(*) as n, row_number() over (partition by r_name, n_name order by count(*) desc, c_mktsegment) as rn from c group by r_name, n_name, c_mktsegment)
select 'place' as dim, '' as path, r_name as label, n as count from one
union all select 'place', r_name, n_name, n from two where rn <= 2 and r_name in (select r_name from one)
union all select 'place', r_name || '>' || n_name, c_mktsegment, n from three where rn <= 2 and r_name in (select r_name from one) and (r_name, n_name) in (select (r_name, n_name) from two where rn <= 2)""")
def facet_hierarchical_top(spark, sf_dir):
    c = _places(spark, sf_dir)
    return _flat(facets.facet_counts(c, c.df, Facet("place", 2)))


@query(f"with {_PLACES} select c_custkey from c where r_name = 'ASIA' and c_mktsegment is not null")
def drilldown(spark, sf_dir):
    q = ComposedQuery("customer", drilldowns={"customer": [("place", ("ASIA",))]})
    return execute(q, {"customer": _places(spark, sf_dir)}).rows.select("c_custkey")


@query(f"with {_PLACES} select count(*) as count from c where r_name = 'ASIA' and n_name = 'NATION_2' having count(*) > 0 union all select -1 from c where r_name = 'ASIA' and n_name = 'NATION_2' having count(*) = 0")
def facet_specific_value(spark, sf_dir):
    c = _places(spark, sf_dir)
    return facets.specific_value(c, c.df, "place", ("ASIA", "NATION_2"))


# Groups, order, rank.


@query("""
with e as (select *, case when user_id > 0 then user_id else -1 end as g, case when user_id > 0 then null else event_id end as own from events where event_type = 'click'),
m as (select *, row_number() over (partition by g, own order by event_id) as rn, count(*) over (partition by g, own) as duplicate_count,
first_value(event_id) over (partition by g, own order by coalesce(value, 0) desc, event_id desc) as rep from e)
select event_id, rep, duplicate_count from m where rn = 1""")
def dedup(spark, sf_dir):
    """One row a user, at its first event, represented by that of the largest value."""
    c = core(spark, sf_dir, "events")
    rows = c.df.where(predicate(c, t("event_type", "click")))
    return ranking.deduplicated(c, rows, "user_id", [F.asc("event_id")], ["value"]).select("event_id", "rep", "duplicate_count")


@query("""
select o_orderkey, o_totalprice, row_number() over (order by o_orderpriority desc nulls last, o_totalprice desc nulls last, o_orderkey) as rank from orders
qualify rank > 5 and rank <= 25""")
def sort_and_page(spark, sf_dir):
    c = core(spark, sf_dir, "orders")
    order = [ranking.order_column(F.col("o_orderpriority"), SortKey("o_orderpriority", True)), ranking.order_column(F.col("o_totalprice"), SortKey("o_totalprice", True, "Double", -1.0)), F.asc("o_orderkey")]
    rows = ranking.page(c.df, order, 5, 25)
    return rows.select("o_orderkey", "o_totalprice", (F.row_number().over(Window.orderBy(*order)) + 5).cast("long").alias("rank"))


@query("""
select o_orderkey, row_number() over (order by coalesce(c_acctbal, 0) desc, o_orderkey) as rank from orders left join customer on o_custkey = c_custkey and c_custkey > 0
qualify rank <= 20""")
def sort_join(spark, sf_dir):
    """Orders by the balance of their customer."""
    q = ComposedQuery("orders", sort_keys=[SortKey("c_acctbal", True, "Double", core="customer")], stop=20).match("orders", "customer", "o_custkey", "c_custkey")
    hits = execute(q, cores(spark, sf_dir, "orders", "customer")).hits
    return hits.select(F.col("id").alias("o_orderkey"), F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("rank"))


@query("""
with n as (select count(*) as n, sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as df from orders where o_orderpriority is not null),
s as (select o_custkey as k, ln(1 + (n - df + 0.5) / (df + 0.5)) / 2.2 as other from (select distinct o_custkey from orders where o_orderpriority = '1-URGENT' and o_custkey > 0), n),
c as (select c_custkey, round(0.6 * 1.0 + 0.4 * (1 + coalesce(other, 0)), 6) as score from customer left join s on c_custkey = k)
select c_custkey, score from c order by score desc, c_custkey limit 50""")
def rank_join(spark, sf_dir):
    """Customers with urgent orders first."""
    q = ComposedQuery("customer", ranks={"orders": t("o_orderpriority", "1-URGENT")}, rank_ratio=0.4, stop=50).match("customer", "orders", "c_custkey", "o_custkey")
    return execute(q, cores(spark, sf_dir, "customer", "orders")).hits.select(F.col("id").alias("c_custkey"), F.round("score", 6).alias("score"))


_BM25 = f"with {TOKENS}, s as (select count(*) as n, avg(len(tok)) as av from tok where len(tok) > 0)"


@query(f"""{_BM25}, d as (select count(*) as df from tok where list_contains(tok, 'license'))
select doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len(tok) / av)), 6) as score
from (select *, cast(len(list_filter(tok, lambda x: x = 'license')) as double) as tf from tok), s, d where tf > 0""")
def bm25_term(spark, sf_dir):
    return scores(spark, sf_dir, t("text", "license"))


@query(f"""{_BM25}, a as (select count(*) as da from tok where list_contains(tok, 'license')), b as (select count(*) as db from tok where list_contains(tok, 'rights')),
m as (select *, cast(len(list_filter(tok, lambda x: x = 'license')) as double) as ta, cast(len(list_filter(tok, lambda x: x = 'rights')) as double) as tb from tok)
select doc_id, round(2 * case when ta > 0 then ln(1 + (n - da + 0.5) / (da + 0.5)) * ta / (ta + 1.2 * (1 - 0.75 + 0.75 * len(tok) / av)) else 0 end
+ case when tb > 0 then ln(1 + (n - db + 0.5) / (db + 0.5)) * tb / (tb + 1.2 * (1 - 0.75 + 0.75 * len(tok) / av)) else 0 end, 6) as score from m, s, a, b where ta > 0 or tb > 0""")
def bm25_boolean(spark, sf_dir):
    return scores(spark, sf_dir, should(Term(2.0, "text", "license"), t("text", "rights")))


@query(f"with {TOKENS} select doc_id, round(len(list_filter(tok, lambda x: x = 'the')) / 1000.0, 6) as score from tok where list_contains(tok, 'the')")
def term_frequency_similarity(spark, sf_dir):
    return scores(spark, sf_dir, t("text", "the"), similarity=Similarity("tf"))


# Text.


@query(f"with {TOKENS} select doc_id, len(tok) as n_tokens, md5(array_to_string(tok, ' ')) as digest from tok")
def tokens(spark, sf_dir):
    tok = analysis.standard(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tok).cast("long").alias("n_tokens"), F.md5(F.array_join(tok, " ")).alias("digest"))


@query("""
select p_partkey, array_to_string(flatten(list_transform(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'),
lambda w: list_transform(range(1, greatest(len(w) + 1, 1)), lambda i: substring('$' || w || '$', i, 3)))), ' ') as grams from part""")
def ngram_analysis(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(analysis.ngrams(F.col("p_name"), 3), " ").alias("grams"))


@query("""
with w as (select p_partkey, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+') as w from part)
select p_partkey, array_to_string(flatten(list_transform(range(1, len(w) + 1), lambda i: case when i < len(w) then [w[i], w[i] || ' ' || w[i + 1]] else [w[i]] end)), '|') as shingles from w""")
def shingle_analysis(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(analysis.shingles(analysis.standard(F.col("p_name")), 2, 2), "|").alias("shingles"))


@query(f"with {TOKENS}, e as (select doc_id, unnest(list_distinct(tok)) as term from tok) select term, count(*) as count from e group by term")
def term_document_counts(spark, sf_dir):
    return terms.term_counts(core(spark, sf_dir, "documents"), "text")


@query(f"with {TOKENS}, e as (select doc_id, unnest(list_distinct(tok)) as term from tok) select term, count(*) as count from e where starts_with(term, 'th') group by term order by term limit 10")
def prefix_search(spark, sf_dir):
    return terms.prefix_search(core(spark, sf_dir, "documents"), "text", "th")


@query(f"""with {TOKENS}, e as (select doc_id, unnest(list_distinct(tok)) as term from tok), c as (select term, count(*) as count from e group by term),
m as (select term, count, damerau_levenshtein(term, 'licenes') as d from c where term <> 'licenes' and substring(term, 1, 1) = 'l'),
r as (select term as suggestion, 1 - d / least(len(term), 7) as similarity, count from m where d <= 2)
select 'licenes' as word, suggestion, round(similarity, 6) as similarity, count from r where similarity >= 0.5 order by similarity desc, count desc, suggestion limit 5""")
def spelling(spark, sf_dir):
    ship(spark)
    return terms.spelling(core(spark, sf_dir, "documents"), "text", ["licenes"], mode="always").select("word", "suggestion", F.round("similarity", 6).alias("similarity"), "count")


@query(f"""{_BM25}, q as (select distinct unnest(tok) as term from tok where doc_id = 1), n as (select n, av, ceil(n * 0.1) as most from s),
e as (select doc_id, len(tok) as dl, unnest(tok) as term from tok), p as (select doc_id, dl, term, count(*) as tf from e where term in (select term from q) group by all),
d as (select term, count(*) as df from p group by term),
h as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / av))) as score, max(case when df <= most then 1 else 0 end) as rare from p join d using (term), n group by doc_id)
select doc_id, round(score, 6) as score from h where doc_id <> 1 and rare = 1 order by h.score desc, doc_id limit 10""")
def similar_documents(spark, sf_dir):
    return terms.similar_documents(core(spark, sf_dir, "documents"), "text", 1).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def _names(spark, sf_dir) -> DataFrame:
    values = F.array(F.struct(F.col("p_type").alias("type"), F.lit("shop").alias("creator"), F.col("p_name").alias("value")))
    return suggest.build(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("key"), values.alias("values"), F.lit(1).alias("seq")))


@query("select p_type as type, 'shop' as creator, p_name as value, count(*) as n_keys, min(p_partkey) as first_key from part where p_name is not null group by p_type, p_name")
def suggestion_build(spark, sf_dir):
    return _names(spark, sf_dir).select("type", "creator", "value", F.size("keys").cast("long").alias("n_keys"), F.array_min("keys").alias("first_key"))


_SUGGEST = """
s as (select distinct p_type as type, p_name as value from part where p_name is not null),
g as (select type, value, flatten(list_transform(regexp_extract_all(lower(value), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, len(w) + 1), lambda i: substring('$' || w || '$', i, 3)))) as grams from s),
a as (select count(*) as n, avg(len(grams)) as av, sum(cast(list_contains(grams, '$re') as int)) as d1 from g),
f as (select value, type, cast(len(list_filter(grams, lambda x: x = '$re')) as double) as t1, len(grams) as dl from g where list_contains(grams, '$re')),
r as (select value, type, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 / (t1 + 1.2 * (1 - 0.75 + 0.75 * dl / av)) as score from f, a order by score desc, value, type limit 25)"""


@query(f"with {_SUGGEST} select value, type, 'shop' as creator, round(score, 6) as score from r")
def suggestions(spark, sf_dir):
    return suggest.suggest(_names(spark, sf_dir), "re").select("value", "type", "creator", F.round("score", 6).alias("score"))


@query(f"""with {_SUGGEST},
b as (select value, type, greatest(0, 1 - ln(levenshtein(lower(value), 're') + 1) / 4) * pow(score, 2) * 2 * cast(contains(lower(value), 're') as int) as score from r)
select value, arg_max(type, (score, type)) as type, max(round(score, 6)) as score from b where score > 0 group by value order by max(score) desc, value limit 10""")
def suggestions_reranked(spark, sf_dir):
    return suggest.rerank(suggest.suggest(_names(spark, sf_dir), "re"), "re").select("value", "type", F.round("score", 6).alias("score"))


@query()
def dutch_stems(spark, sf_dir):
    """Terms and stems of all documents, with the number of documents of each."""
    ship(spark)
    placed = dutch_tokens(F.array_distinct(analysis.standard(F.col("text"))))
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(placed, lambda t: t.term))).alias("term"))
    return found.distinct().groupBy("term").agg(F.count("*").alias("count"))


@query()
def clusters(spark, sf_dir):
    """The ten first clusters among the documents that score best for a term."""
    ship(spark)
    c = core(spark, sf_dir, "documents")
    node = t("text", "license")
    best = with_scores(c, c.df.where(predicate(c, node)), node).orderBy(F.desc("score"), "doc_id").limit(110)
    return cluster.clustered(c, best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))), [cluster.Strategy({"text": 1.0})])


@query()
def dutch_search(spark, sf_dir):
    """Documents that hold a word or its Dutch stem."""
    ship(spark)
    c = core(spark, sf_dir, "documents")
    c.fields = {"text": Field("text", analyzer="dutch")}
    return c.df.where(predicate(c, should(t("text", "the"), t("text", "licens")))).select("doc_id")


@query("select cast(floor((o_custkey - 1) / 32768) as bigint) + 1 as bucket, count(distinct o_custkey) as keys from orders where o_custkey > 0 and o_orderstatus = 'P' group by 1")
def export_key_bitmaps(spark, sf_dir):
    c = core(spark, sf_dir, "orders")
    return bitmaps(distinct_keys(c.df.where(predicate(c, t("o_orderstatus", "P"))), F.col("o_custkey"))).select("bucket", F.bitmap_count("bits").alias("keys"))


# Query language.


@query("""
select o_orderkey from orders where (o_orderstatus = 'F' or o_orderpriority = '2-HIGH') and o_totalprice >= 100000 and o_custkey > 0
and o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def cql_over_two_cores(spark, sf_dir):
    own = cql.Converter([("o_orderstatus", 1.0)], {"o_orderstatus": "string", "o_orderpriority": "string", "o_totalprice": "double"})
    other = cql.Converter([("c_mktsegment", 1.0)], {"c_mktsegment": "string"})
    text = "(o_orderstatus=F OR o_orderpriority=2-HIGH) AND o_totalprice>=100000 AND customer.c_mktsegment=BUILDING"
    q = cql.composed_from_request(text, "orders", {"orders": own, "customer": other}, [("orders", "customer", "o_custkey", "c_custkey")])
    return execute(q, cores(spark, sf_dir, "orders", "customer")).rows.select("o_orderkey")


@query(f"with {TOKENS} select doc_id from tok where (list_contains(tok, 'license') or contains(' ' || array_to_string(tok, ' ') || ' ', ' all rights reserved ')) and not list_contains(tok, 'apache')")
def cql_text(spark, sf_dir):
    node = cql.Converter([("text", 1.0)]).convert('license OR "All rights reserved" NOT text=Apache')
    return text_predicate(spark, sf_dir, node).select("doc_id")


# Tables.


@query("select 'customer' as core, count(*) as docs from customer union all select 'orders', count(*) from orders")
def core_info(spark, sf_dir):
    return terms.core_info(cores(spark, sf_dir, "customer", "orders"))


@query("select p_brand as label from part where p_brand is not null group by p_brand order by p_brand limit 50")
def drilldown_values(spark, sf_dir):
    return terms.drilldown_values(core(spark, sf_dir, "part"), "p_brand")


@query("select term, row_number() over (order by term) as number from (select distinct p_name as term from part)")
def numerated_terms(spark, sf_dir):
    return ingest.numerated(table(spark, sf_dir, "part").select(F.col("p_name").alias("term")))


_LAST = "select user_id as id, arg_max(event_type, event_id) as event_type, max(event_id) as seq from events where user_id is not null group by user_id having arg_max(event_type, event_id) <> 'error'"


@query(_LAST)
def upsert(spark, sf_dir):
    """The last event of each user; an error deletes the user."""
    changes = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("id"), "event_type", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"))
    return ingest.upserted(changes.limit(0), changes).select("id", "event_type", "seq")


@query("select user_id as id, arg_max(event_type, event_id) as event_type, max(event_id) as seq from events where user_id is not null group by user_id")
def streaming_upsert(spark, sf_dir):
    """The same from a stream, batch by batch, into a published table."""
    folder = shared_folder(spark)
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events*.parquet").where("user_id is not null").selectExpr("user_id as id", "event_type", "event_id as seq")
    out = ingest.BucketedTable(spark, f"{folder}/table", buckets=8)
    upsert_stream(stream, out, f"{folder}/checkpoint").awaitTermination()
    return out.read()


# Fields and documents in and out.


@query("""
select case when event_type = 'view' then null else user_id end as id, max(event_id) as seq from events where event_type <> 'view' group by 1
union all select null, event_id from events where event_type = 'view'""")
def append_rows(spark, sf_dir):
    """Rows without an id are appended, others replace each other."""
    named = F.when(F.col("event_type") != "view", F.col("user_id"))
    changes = table(spark, sf_dir, "events").select(named.alias("id"), F.col("event_id").alias("seq"))
    return ingest.upserted(changes.limit(0), changes).select("id", "seq")


@query("select o_orderkey from orders where not (o_orderstatus = 'F' and o_totalprice > 200000)")
def delete_by_query(spark, sf_dir):
    c = core(spark, sf_dir, "orders")
    return ingest.deleted_by_query(c, must(t("o_orderstatus", "F"), Range(kind="Double", field="o_totalprice", low=200000, with_low=False))).df.select("o_orderkey")


@query("select c_custkey as id, c_mktsegment as segment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def commit_by_count(spark, sf_dir):
    """Two changes pass the count and are published; the third isn't seen."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("seq"))
    out = ingest.Table(spark, shared_folder(spark))
    first, second, third = (customers.where(F.col("segment") == s) for s in ("BUILDING", "MACHINERY", "FURNITURE"))
    writer = ingest.Writer(out, commit_count=first.count() + second.count(), commit_timeout=1e9)
    for change in (first, second, third):
        writer.add(change)
    return out.read().select("id", "segment")


@query("select p_partkey, p_name as name, [p_brand] as \"untokenized.brand\", p_size as \"__numeric__.size\", [[p_type, p_brand]] as kind from part")
def json_documents(spark, sf_dir):
    """Documents written as JSON fields and read by the kinds of their names."""

    def field(kind: str, name: str, value=None, path=None):
        return F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), (F.lit(None) if value is None else value).cast("string").alias("value"), (F.lit(None) if path is None else path).cast("array<string>").alias("path"))

    fields = F.array(field("TextField", "name", F.col("p_name")), field("StringField", "untokenized.brand", F.col("p_brand")), field("NumericField", "__numeric__.size", F.col("p_size")), field("FacetField", "kind", path=F.array("p_type", "p_brand")))
    raw = table(spark, sf_dir, "part").select("p_partkey", F.to_json(fields).alias("json"))
    registry = ingest.FieldRegistry(drilldowns={"kind": Field("facet", "kind", hierarchical=True)})
    out = ingest.decoded(raw, registry, ["name", "untokenized.brand", "__numeric__.size", "kind"])
    return out.select("p_partkey", F.col("name")[0].alias("name"), "`untokenized.brand`", F.col("`__numeric__.size`").cast("int").alias("__numeric__.size"), "kind")


@query("select 'part:' || p_partkey as id, 'brand=' || substring(p_brand, 1, 6) || ';name=' || p_name as fields from part")
def transaction_fields(spark, sf_dir):
    """Fields of one transaction gathered to a document: the id is rewritten, facet labels are cut."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").cast("string").alias("id"), F.lit("name").alias("name"), F.col("p_name").alias("value"), F.lit(False).alias("facet"))
    rows = rows.unionByName(part.select(F.col("p_partkey").cast("string").alias("id"), F.lit("brand").alias("name"), F.col("p_brand").alias("value"), F.lit(True).alias("facet")))
    out = ingest.gathered(rows, 6, rewrite_id=lambda i: F.concat(F.lit("part:"), i))
    return out.select("id", F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["value"])), ";").alias("fields"))


@query("""
select p_partkey as id, 'p_name' as name, p_name as value, false as facet from part union all select p_partkey, 'p_type', p_type, false from part
union all select p_partkey, 'p_type', substring(p_type, 1, 4), true from part""")
def listed_fields(spark, sf_dir):
    """A factory makes one row of a name and two, one of them a facet, of a type."""

    def factory(f):
        def one(facet):
            return F.struct(f["name"].alias("name"), f["value"].alias("value"), F.lit(facet).alias("facet"))

        short = F.struct(f["name"].alias("name"), F.substring(f["value"], 1, 4).alias("value"), F.lit(True).alias("facet"))
        return F.when(f["name"] == "p_type", F.array(one(False), short)).otherwise(F.array(one(False)))

    pair = lambda c: F.struct(F.lit(c).alias("name"), F.col(c).alias("value"))
    return ingest.listed(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(pair("p_name"), pair("p_type")).alias("fields")), factory)


@query("""
select p_partkey, 'brand' as name, p_brand as value, false as facet from part union all select p_partkey, 'a.brand', p_brand, false from part
union all select p_partkey, 'b.brand', p_brand, true from part""")
def prefixed_fields(spark, sf_dir):
    copies = ingest.prefixed("brand", F.col("p_brand"), ["", "a.", "b.", "c."], 2, facets=True)
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(copies).alias("f")).select("p_partkey", "f.*")


@query(f"""
with {_PLACES} select 'place' as term, count(*) as count from c union all select 'place>' || r_name, count(*) from c group by r_name
union all select 'place>' || r_name || '>' || n_name, count(*) from c group by r_name, n_name
union all select 'place>' || r_name || '>' || n_name || '>' || c_mktsegment, count(*) from c group by r_name, n_name, c_mktsegment""")
def facet_terms(spark, sf_dir):
    """All drilldown terms of a hierarchical dimension and the dimension itself."""
    c = _places(spark, sf_dir)
    rows = c.df.select(F.explode(ingest.facet_terms("place", c.paths("place"))).alias("t"))
    return rows.groupBy(F.array_join("t", ">").alias("term")).agg(F.count("*").alias("count"))


@query(f"with {_PLACES} select '' as path, count(*) as count from c union all select r_name, count(*) from c group by r_name union all select r_name || '>' || n_name, count(*) from c group by r_name, n_name union all select r_name || '>' || n_name || '>' || c_mktsegment, count(*) from c group by all")
def facet_with_root(spark, sf_dir):
    c = _places(spark, sf_dir)
    return facets.paths_with_root(c, c.df, "place").select(F.array_join("path", ">").alias("path"), "count")


@query("select r_name as id, 'region ' || r_regionkey as value from region where r_name <> 'ASIA'")
def key_values(spark, sf_dir):
    """A mapping written, changed and read after its commit."""
    path = shared_folder(spark)
    values = ingest.KeyValues(spark, path)
    for r in table(spark, sf_dir, "region").collect():
        values[r.r_name] = "old"
    values.commit()
    for r in table(spark, sf_dir, "region").collect():
        values[r.r_name] = f"region {r.r_regionkey}"
    del values["ASIA"]
    values.commit()
    return ingest.Table(spark, path).read().select("id", "value")


# Codecs.


@query("""
select c_custkey from customer where c_custkey > 0 and c_acctbal > 0 and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')
and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""")
def query_codec(spark, sf_dir):
    """A query of two cores written as JSON, read and run."""
    q = ComposedQuery("customer", queries={"customer": Range(kind="Double", field="c_acctbal", low=0, with_low=False)}, filters={"orders": [t("o_orderpriority", "1-URGENT")]}, excludes={"orders": [t("o_orderstatus", "P")]})
    q.match("customer", "orders", "c_custkey", "o_custkey")
    read = codec.query_from_json(json.loads(json.dumps(codec.query_to_json(q))))
    return execute(read, cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


@query("""
select distinct c_custkey as key from customer where c_custkey > 0 and c_mktsegment = 'FURNITURE' and c_custkey not in (select o_custkey from orders where o_totalprice > 480000 and o_custkey > 0)
and c_custkey in (select o_custkey from orders where o_custkey > 0)""")
def relational_codec(spark, sf_dir):
    """Customers none of whose orders is of the highest prices, of those that have any: the tree goes through JSON."""
    dear = Leaf(core="orders", collect_key="o_custkey", filter_key="o_custkey", query=Range(kind="Double", field="o_totalprice", low=480000, with_low=False))
    ordered = Leaf(core="orders", collect_key="o_custkey", filter_key="o_custkey")
    mine = Leaf(core="customer", collect_key="c_custkey", filter_key="c_custkey", query=t("c_mktsegment", "FURNITURE"))
    tree = nodes.from_json(json.loads(json.dumps(nodes.to_json(And(first=And(first=Not(query=Or(first=dear, second=dear)), second=ordered), second=mine)))))
    return evaluate(tree, cores(spark, sf_dir, "orders", "customer")).df


@query("""
select row_number() over (order by o_totalprice desc, o_orderkey) as rank, o_orderkey as id, round(o_totalprice, 2) as price, (select count(*) from orders where o_orderstatus = 'P') as total
from orders where o_orderstatus = 'P' order by o_totalprice desc, o_orderkey limit 10""")
def response_codec(spark, sf_dir):
    """A page of hits as JSON and read again."""
    q = ComposedQuery("orders", queries={"orders": t("o_orderstatus", "P")}, sort_keys=[SortKey("o_totalprice", True, "Double")], stored=["o_totalprice"], facets={"orders": [Facet("o_orderpriority", 2)]})
    sent = codec.response_from_json(json.dumps(codec.response_to_json(execute(q, cores(spark, sf_dir, "orders")), q)))
    rows = [(k, h.id, round(h.o_totalprice[0], 2), sent["total"]) for k, h in enumerate(sent["hits"], 1)]
    return spark.createDataFrame(rows, "rank long, id long, price double, total long")


@query("select distinct o_custkey as key from orders where o_custkey > 0 and o_orderstatus = 'P'")
def read_key_bitmaps(spark, sf_dir):
    c = core(spark, sf_dir, "orders")
    return bitmap_keys(bitmaps(distinct_keys(c.df.where(predicate(c, t("o_orderstatus", "P"))), F.col("o_custkey"))))


@query("""
select * from (values ('c_acctbal', 'double', cast(null as varchar)), ('c_custkey', 'long', null), ('c_mktsegment', 'string', null), ('c_name', 'text', 'standard'), ('c_nationkey', 'int', null)) v(field, kind, analyzer)
where (select count(*) from customer) > 0""")
def field_descriptions(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("int"))
    return codec.described(Core("customer", df, "c_custkey", {"c_name": Field("text", "c_name")})).select("field", "kind", "analyzer")


@query("select unnest(['p_brand', 'p_name', 'p_partkey', 'p_retailprice', 'p_size', 'p_type']) as name")
def field_names(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in terms.field_names(core(spark, sf_dir, "part"))], "name string")


# Places of terms.


@query("select p_partkey, array_to_string(string_split_regex(p_name, '\\s+'), '|') as tokens from part")
def whitespace_analysis(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(analysis.whitespace(F.col("p_name")), "|").alias("tokens"))


def _values_core(spark, sf_dir, gap: int) -> Core:
    df = table(spark, sf_dir, "part").withColumn("texts", F.array("p_name", "p_type", "p_name"))
    return Core("part", df, "p_partkey", {"texts": Field("text", "texts", gap=gap)})


@query("""
select p_partkey, 'without gap' as kind from part where contains(' ' || lower(p_name) || ' ' || lower(p_type) || ' ', ' ring economy ')
union all select p_partkey, 'in a value' from part where contains(' ' || lower(p_name) || ' ', ' small ring ')""")
def phrase_over_values(spark, sf_dir):
    """A phrase goes on in the next value only where there is no gap; within a value a gap changes nothing."""
    parts = []
    for gap, kind, words in ((0, "without gap", ("ring", "economy")), (100, "with gap", ("ring", "economy")), (100, "in a value", ("small", "ring"))):
        c = _values_core(spark, sf_dir, gap)
        parts.append(c.df.where(predicate(c, Phrase(field="texts", terms=words))).select("p_partkey", F.lit(kind).alias("kind")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"with {TOKENS} select doc_id, lang from tok where contains(' ' || array_to_string(tok, ' ') || ' ', ' all rights reserved ')")
def phrase_among_stems(spark, sf_dir):
    """A phrase over a field whose stems share the places of their words."""
    ship(spark)
    c = core(spark, sf_dir, "documents")
    c.fields = {"text": Field("text", analyzer="dutch")}
    return c.df.where(predicate(c, Phrase(field="text", terms=("all", "rights", "reserved")))).select("doc_id", "lang")


@query(f"""with {TOKENS} select doc_id, 'stemmed' as kind from tok where list_contains(tok, 'rights') or list_contains(tok, 'right')
union all select doc_id, 'exception' from tok where list_contains(tok, 'rights')""")
def stemming_exceptions(spark, sf_dir):
    """A term finds its Dutch stem too, unless it is among the exceptions."""
    docs = core(spark, sf_dir, "documents")
    found = []
    for kind, but in (("stemmed", set()), ("exception", {"rights"})):
        node = cql.Converter([("text", 1.0)], stemmed={"text"}, unstemmed_words=but).convert("text=rights")
        found.append(docs.df.where(predicate(docs, node)).select("doc_id", F.lit(kind).alias("kind")))
    return found[0].unionByName(found[1])


# Filters of one core and of several.


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and o_totalprice > 50000")
def filter_in_one_core(spark, sf_dir):
    q = ComposedQuery("orders", queries={"orders": t("o_orderstatus", "O")}, filters={"orders": [t("o_orderpriority", "1-URGENT"), Range(kind="Double", field="o_totalprice", low=50000, with_low=False)]})
    return execute(q, cores(spark, sf_dir, "orders")).rows.select("o_orderkey")


@query("select o_orderkey from orders where o_orderstatus = 'O' and not o_orderpriority = '1-URGENT' and not o_totalprice > 50000")
def exclude_in_one_core(spark, sf_dir):
    q = ComposedQuery("orders", queries={"orders": t("o_orderstatus", "O")}, excludes={"orders": [t("o_orderpriority", "1-URGENT"), Range(kind="Double", field="o_totalprice", low=50000, with_low=False)]})
    return execute(q, cores(spark, sf_dir, "orders")).rows.select("o_orderkey")


@query("select o_orderkey from orders where o_orderstatus <> 'F'")
def negated_root(spark, sf_dir):
    q = ComposedQuery("orders", queries={"orders": nodes.negated(t("o_orderstatus", "F"))})
    return execute(q, cores(spark, sf_dir, "orders")).rows.select("o_orderkey")


@query(f"with {_PLACES} select c_custkey from c where r_name = 'ASIA' and n_name = (select min(n_name) from c where r_name = 'ASIA')")
def hierarchical_value(spark, sf_dir):
    """A value of several levels, written with '>', in the query language."""
    c = _places(spark, sf_dir)
    nation = c.df.where("r_name = 'ASIA'").agg(F.min("n_name")).first()[0]
    node = cql.Converter([], hierarchical={"place"}, drilldowns={"place"}).convert(f'place="ASIA > {nation}"')
    return c.df.where(predicate(c, node)).select("c_custkey")


@query("select distinct c_custkey as key from customer where c_custkey > 0 and c_mktsegment = 'BUILDING' and c_acctbal > 5000")
def prefixed_core(spark, sf_dir):
    """Clauses with the name of a core become a tree over its keys."""
    node = cql.Converter([], {"c_mktsegment": "string", "c_acctbal": "double"}, cores={"customer": "c_custkey"}).convert("customer.c_mktsegment=BUILDING AND customer.c_acctbal>5000")
    return evaluate(node, cores(spark, sf_dir, "customer")).df


@query("""
select o_orderkey from orders where o_orderstatus = 'F' and o_custkey > 0 and o_custkey in (select c_custkey from customer where c_mktsegment <> 'BUILDING')""")
def negated_other_core(spark, sf_dir):
    own, other = cql.Converter([], {"o_orderstatus": "string"}), cql.Converter([], {"c_mktsegment": "string"})
    q = cql.composed_from_request("o_orderstatus=F NOT customer.c_mktsegment=BUILDING", "orders", {"orders": own, "customer": other}, [("orders", "customer", "o_custkey", "c_custkey")])
    return execute(q, cores(spark, sf_dir, "orders", "customer")).rows.select("o_orderkey")


@query("""
select o_orderkey from orders where o_orderkey > 0 and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')
and o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'O')""")
def filters_on_different_rows(spark, sf_dir):
    """Two clauses of one other core are two filters: a key may meet them in different rows."""
    own, other = cql.Converter([], {"o_orderstatus": "string"}), cql.Converter([], {"l_returnflag": "string", "l_linestatus": "string"})
    q = cql.composed_from_request("lineitem.l_returnflag=R AND lineitem.l_linestatus=O", "orders", {"orders": own, "lineitem": other}, [("orders", "lineitem", "o_orderkey", "l_orderkey")])
    return execute(q, cores(spark, sf_dir, "orders", "lineitem")).rows.select("o_orderkey")


@query("""
select o_orderpriority as name, count(*) as count from orders where o_orderstatus = 'F' and o_custkey > 0 and o_custkey in (select o_custkey from orders where o_totalprice > 100000)
and o_custkey in (select c_custkey from customer where c_acctbal > 0) and not o_custkey in (select c_custkey from customer where c_custkey > 0 and c_mktsegment = 'BUILDING') group by 1""")
def request_arguments(spark, sf_dir):
    """Filters, excludes and a facet whose name is translated, from the arguments of a request. Beside other cores, a filter of the own core is a set of its keys."""
    own, other = cql.Converter([], {"o_orderstatus": "string", "o_totalprice": "double"}), cql.Converter([], {"c_mktsegment": "string", "c_acctbal": "double"})
    asked = cql.request("o_orderstatus=F", "orders", {"orders": own, "customer": other}, [("orders", "customer", "o_custkey", "c_custkey")], filters=["o_totalprice>100000"], core_filters=[("customer", "c_acctbal>0")], core_excludes=[("customer", "c_mktsegment=BUILDING")], facets={"orders": ["priority"]}, facet_top=0, field_name=lambda n: f"o_order{n}")
    counts = asked.restored(execute(asked.query, cores(spark, sf_dir, "orders", "customer")).facets)
    return counts.where("name = 'priority' and place = 0").select(F.col("label").alias("name"), "count")


@query("""
select c_custkey from customer where c_custkey > 0 and c_mktsegment = 'BUILDING' and c_custkey in (select o_custkey from orders where o_orderstatus = 'P')""")
def own_filter_by_keys(spark, sf_dir):
    """A filter on the core of the results becomes a key set beside those of other cores."""
    q = ComposedQuery("customer", filters={"customer": [t("c_mktsegment", "BUILDING")], "orders": [t("o_orderstatus", "P")]})
    return execute(q.match("customer", "orders", "c_custkey", "o_custkey"), cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


@query("""
select c_custkey from customer where not (c_custkey > 0 and c_mktsegment = 'BUILDING') and c_custkey > 0 and c_custkey in (select o_custkey from orders where o_orderstatus = 'P')""")
def self_anti_join(spark, sf_dir):
    q = ComposedQuery("customer", excludes={"customer": [t("c_mktsegment", "BUILDING")]}, filters={"orders": [t("o_orderstatus", "P")]})
    return execute(q.match("customer", "orders", "c_custkey", "o_custkey"), cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


@query("""
select c_custkey from customer where c_acctbal > 0 and c_custkey > 0 and c_custkey in (select o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R' and l_orderkey > 0))""")
def relational_filter(spark, sf_dir):
    """A tree as one filter of a query."""
    tree = And(first=Leaf(core="lineitem", collect_key="l_orderkey", filter_key="l_orderkey", query=t("l_returnflag", "R")), second=Leaf(core="orders", collect_key="o_custkey", filter_key="o_orderkey"))
    q = ComposedQuery("customer", queries={"customer": Range(kind="Double", field="c_acctbal", low=0, with_low=False)}, filters={"orders": [tree]})
    return execute(q.match("customer", "orders", "c_custkey", "o_custkey"), cores(spark, sf_dir, "customer", "orders", "lineitem")).rows.select("c_custkey")


@query("""
select 'l_returnflag' as dim, '' as path, l_returnflag as label, count(*) as count from lineitem
where l_orderkey > 0 and l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')
and l_orderkey in (select l_orderkey from lineitem where l_linestatus = 'F' and l_quantity > 40) group by l_returnflag""")
def facet_join_relational(spark, sf_dir):
    """Facets of another core whose rows a tree filters by key."""
    tree = Leaf(core="lineitem", collect_key="l_orderkey", filter_key="l_orderkey", query=must(t("l_linestatus", "F"), Range(kind="Double", field="l_quantity", low=40, with_low=False)))
    q = ComposedQuery("orders", queries={"orders": t("o_orderpriority", "1-URGENT")}, facet_filters={"lineitem": [tree]}, facets={"lineitem": [Facet("l_returnflag", 0)]})
    return _flat(execute(q.match("orders", "lineitem", "o_orderkey", "l_orderkey"), cores(spark, sf_dir, "orders", "lineitem")).facets)


@query("""
select 'words' as dim, '' as path, label, count(*) as count from (select distinct p_partkey, unnest([p_type, p_brand, p_name]) as label from part) group by label""")
def facet_several_values(spark, sf_dir):
    """One dimension fed by several columns: a row counts once for each of its labels."""
    df = table(spark, sf_dir, "part").withColumn("words", F.array("p_type", "p_brand", "p_name"))
    c = Core("part", df, "p_partkey", {"words": Field("facet", "words")})
    return _flat(execute(ComposedQuery("part", facets={"part": [Facet("words", 0)]}), {"part": c}).facets)


# Order, scores, collectors.


@query("""
with n as (select count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as df from lineitem), m as (select count(*) as n, sum(case when c_mktsegment = 'BUILDING' then 1 else 0 end) as df from customer),
a as (select distinct l_orderkey as k, ln(1 + (n - df + 0.5) / (df + 0.5)) / 2.2 as other from lineitem, n where l_returnflag = 'R' and l_orderkey > 0),
b as (select distinct c_custkey as k, ln(1 + (n - df + 0.5) / (df + 0.5)) / 2.2 as other from customer, m where c_mktsegment = 'BUILDING' and c_custkey > 0),
o as (select o_orderkey, round(0.5 * (0.5 + 0.5 * (1 + coalesce(b.other, 0))) + 0.5 * (1 + coalesce(a.other, 0)), 6) as score from orders left join a on o_orderkey = a.k left join b on o_custkey = b.k)
select o_orderkey, score from o order by score desc, o_orderkey limit 40""")
def rank_by_several_keys(spark, sf_dir):
    """Orders ranked by their lines and by their customers, which join by different keys: one is blended after the other, in the order of the keys' names."""
    q = ComposedQuery("orders", ranks={"lineitem": t("l_returnflag", "R"), "customer": t("c_mktsegment", "BUILDING")}, stop=40)
    q.match("orders", "lineitem", "o_orderkey", "l_orderkey").match("orders", "customer", "o_custkey", "c_custkey")
    return execute(q, cores(spark, sf_dir, "orders", "lineitem", "customer")).hits.select(F.col("id").alias("o_orderkey"), F.round("score", 6).alias("score"))


@query("""
with n as (select count(*) as n, sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as df from orders where o_orderpriority is not null),
s as (select o_custkey as k, ln(1 + (n - df + 0.5) / (df + 0.5)) / 2.2 as x from (select distinct o_custkey from orders where o_orderpriority = '1-URGENT' and o_custkey > 0), n),
h as (select k, floor(x / pow(2.0, floor(log2(x)) - 10)) * pow(2.0, floor(log2(x)) - 10) as other from s)
select c_custkey, round(0.6 + 0.4 * (1 + coalesce(other, 0)), 9) as score from customer left join h on c_custkey = k order by score desc, c_custkey limit 50""")
def rank_quantised(spark, sf_dir):
    q = ComposedQuery("customer", ranks={"orders": t("o_orderpriority", "1-URGENT")}, rank_ratio=0.4, stop=50, quantised=True).match("customer", "orders", "c_custkey", "o_custkey")
    return execute(q, cores(spark, sf_dir, "customer", "orders")).hits.select(F.col("id").alias("c_custkey"), F.round("score", 9).alias("score"))


@query("""
with p as (select *, case when p_size > 25 then p_size end as size, case when p_retailprice > 1000 then p_retailprice end as price, case when p_brand > 'Brand#2' then p_brand end as brand from part)
select p_partkey, row_number() over (order by brand desc nulls last, coalesce(price, 0) asc, size asc nulls last, p_partkey) as rank from p qualify rank <= 300""")
def missing_sort_values(spark, sf_dir):
    """Missing strings and integers are last either way, missing doubles count as 0."""
    df = table(spark, sf_dir, "part")
    for name, column, test in (("size", "p_size", "p_size > 25"), ("price", "p_retailprice", "p_retailprice > 1000"), ("brand", "p_brand", "p_brand > 'Brand#2'")):
        df = df.withColumn(name, F.when(F.expr(test), F.col(column)))
    q = ComposedQuery("part", sort_keys=[SortKey("brand", True), SortKey("price", False, "Double"), SortKey("size", False, "Int")], stop=300)
    hits = execute(q, {"part": Core("part", df, "p_partkey")}).hits
    return hits.select(F.col("id").alias("p_partkey"), F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("rank"))


@query(f"""{_BM25}, d as (select count(*) as df from tok where list_contains(tok, 'license')),
h as (select doc_id, lang, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * len(tok) / av)) as score
from (select *, cast(len(list_filter(tok, lambda x: x = 'license')) as double) as tf from tok), s, d where tf > 0)
select doc_id, round(score, 6) as score, row_number() over (order by lang, score, doc_id) as rank from h""")
def sort_by_score(spark, sf_dir):
    """By language, then by ascending score, with other parameters of the similarity."""
    c = core(spark, sf_dir, "documents")
    c = Core(c.name, c.df, c.id, c.fields, similarity=Similarity(k1=0.9, b=0.4))
    q = ComposedQuery("documents", queries={"documents": t("text", "license")}, sort_keys=[SortKey("lang"), SortKey("score")], stop=1_000_000)
    hits = execute(q, {"documents": c}).hits
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("rank"))


@query(f"""{_BM25}, d as (select count(*) as df from tok where list_contains(tok, 'license'))
select doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * sqrt(tf) + len(tok) / av, 6) as score
from (select *, cast(len(list_filter(tok, lambda x: x = 'license')) as double) as tf from tok), s, d where tf > 0""")
def own_similarity(spark, sf_dir):
    """A score of the caller's own."""
    return scores(spark, sf_dir, t("text", "license"), similarity=Similarity(weight=lambda tf, idf, length, average: idf * F.sqrt(tf) + length / average))


@query("""
select count(*) as total, count(*) as total_with_duplicates, round(sum(o_totalprice), 2) as revenue, count(distinct o_custkey) as customers, max(o_orderkey) as last from orders where o_orderstatus = 'F'""")
def collectors(spark, sf_dir):
    """Several aggregates of the caller's own in the pass that counts the hits."""
    q = ComposedQuery("orders", queries={"orders": t("o_orderstatus", "F")}, collectors={"revenue": F.round(F.sum("o_totalprice"), 2), "customers": F.count_distinct("o_custkey"), "last": F.max("o_orderkey")})
    return execute(q, cores(spark, sf_dir, "orders")).total


class _Busy(KeyNode):
    """Customers of at least 15 orders."""

    def keys(self, cores, within):
        many = cores["orders"].df.groupBy(F.col("o_custkey").alias("key")).count().where("count >= 15 and key > 0").select("key")
        return KeySet(many) if within is None else within & KeySet(many)


@query("""
select c_custkey from customer where c_custkey > 0 and c_mktsegment = 'BUILDING' and c_custkey in (select o_custkey from orders group by o_custkey having count(*) >= 15)""")
def own_relational_node(spark, sf_dir):
    tree = And(first=Leaf(core="customer", collect_key="c_custkey", filter_key="c_custkey", query=t("c_mktsegment", "BUILDING")), second=_Busy())
    q = ComposedQuery("customer", relational=tree).match("customer", "orders", "c_custkey", "o_custkey")
    return execute(q, cores(spark, sf_dir, "customer", "orders")).rows.select("c_custkey")


# Suggestions, spelling, clusters.


_SUGGESTED = f"""with {_SUGGEST.replace("from f, a order by", "from f, a where WANTED order by")} select value, type, round(score, 6) as score from r"""


@query(_SUGGESTED.replace("WANTED", "type = 'ECONOMY'"))
def suggestions_filtered(spark, sf_dir):
    return suggest.suggest(_names(spark, sf_dir), "re", filters={"type": "ECONOMY"}).select("value", "type", F.round("score", 6).alias("score"))


@query(f"""
select 'registered' as kind, * from ({_SUGGESTED.replace("WANTED", "(value, type) in (select (p_name, p_type) from part where p_partkey <= 40)")})
union all select 'unknown', * from ({_SUGGESTED.replace("WANTED", "true")})""")
def suggestions_by_key_set(spark, sf_dir):
    """Of a named set of keys; a name that isn't registered filters nothing."""
    all_of_them = suggest.Suggester(_names(spark, sf_dir))
    all_of_them.register("first", table(spark, sf_dir, "part").where("p_partkey <= 40").select(F.col("p_partkey").alias("key")))
    found = [all_of_them.suggest("re", name).select(F.lit(kind).alias("kind"), "value", "type", F.round("score", 6).alias("score")) for kind, name in (("registered", "first"), ("unknown", "nobody"))]
    return found[0].unionByName(found[1])


@query("select count(*) as suggestions, 1 as key_sets from (select distinct p_type, p_name from part where p_name is not null)")
def suggestion_info(spark, sf_dir):
    one = suggest.Suggester(_names(spark, sf_dir))
    one.register("all", table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))
    return one.info().select("suggestions", "key_sets")


@query(f"""with {TOKENS}, e as (select doc_id, unnest(list_distinct(tok)) as term from tok), c as (select term, count(*) as count from e group by term),
w as (select unnest(['right', 'rights', 'apach']) as word), o as (select word, coalesce(count, 0) as own from w left join c on word = term),
m as (select word, term, count, own, damerau_levenshtein(term, word) as d from c, o where term <> word and substring(term, 1, 1) = substring(word, 1, 1) and abs(len(term) - len(word)) <= 2),
r as (select *, 1 - d / least(len(term), len(word)) as similarity from m where d <= 2),
q as (select 'more_popular' as mode, * from r where similarity >= 0.5 and count > own union all select 'not_in_index', * from r where similarity >= 0.5 and own = 0)
select mode, word, term as suggestion, count from q qualify row_number() over (partition by mode, word order by similarity desc, count desc, term) <= 3""")
def spelling_modes(spark, sf_dir):
    ship(spark)
    c = core(spark, sf_dir, "documents")
    found = [terms.spelling(c, "text", ["right", "rights", "apach"], 3, mode=m).select(F.lit(m).alias("mode"), "word", "suggestion", "count") for m in ("more_popular", "not_in_index")]
    return found[0].unionByName(found[1])
