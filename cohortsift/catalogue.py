"""Every operator as a query over the given tables, with the SQL it must equal.

A row of ``lineitem`` stands for a variant call: ``l_partkey`` is the variant,
``l_suppkey`` the sample, ``l_returnflag`` the impact. ``events`` stands for the
review log. Each query reads whole tables.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortsift.functions.checks import job_is_complete, valid_name
from cohortsift.functions.display import display, joined, path_stems
from cohortsift.operators import causal, folds
from cohortsift.operators.joins import join
from cohortsift.operators.numbering import number_rows
from cohortsift.operators.paging import SortedPages, page, page_after, page_stats, show_page
from cohortsift.operators.recurrence import distinct_values, run_recurrence, with_run_recurrence
from cohortsift.operators.relational import order, project, restrict, where
from cohortsift.operators.search import search
from cohortsift.operators.selection import deep_page
from cohortsift.plans.review import ReviewStore
from cohortsift.plans.spec import MAIN, FieldSpec, FilterNode, OrderKey, StepSpec
from cohortsift.plans.steps import StepPages, decision_report, run_step, step_page, step_relation
from cohortsift.session import new_shared_path
from cohortsift.sources.cohort import Cohort
from cohortsift.sources.csv_report import export_csv
from cohortsift.sources.lake import Lake, scan_files
from cohortsift.sources.manifest import Manifest
from cohortsift.sources.methods import load_method, read_methods
from cohortsift.sources.review_log import COMPLETED, CREATED, DECISION, DELETED, REMARK, STEP, ReviewLog
from cohortsift.sources.search_index import SearchIndex
from cohortsift.streaming.snapshot import FoldedLog

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        ORACLES[run.__name__] = oracle
        return run

    return register


# The columns of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _lake(spark: SparkSession, folder: str, **tables: DataFrame) -> Lake:
    return Lake(spark, folder, tables, {f"{name}.parquet": schema for name, schema in SCHEMAS.items()})


# -- the step query --------------------------------------------------------------

_COUNTS_SQL = (
    "(select l_partkey, cast(sum(case when l_returnflag='R' then 1 else 0 end) as bigint) var_count, "
    "cast(sum(case when l_returnflag<>'R' then 1 else 0 end) as bigint) ref_count, "
    "count(*) total_count from lineitem group by 1)"
)


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    """Cohort counts per variant, the table a lake keeps ready made."""
    rare = F.col("l_returnflag") == "R"
    return (
        _table(spark, folder, "lineitem")
        .groupBy("l_partkey")
        .agg(
            F.count_if(rare).alias("var_count"),
            F.count_if(~rare).alias("ref_count"),
            F.count("*").alias("total_count"),
        )
    )


def _cohort(spark: SparkSession, folder: str) -> Lake:
    return _lake(spark, folder, cohort_counts=_counts(spark, folder))


_WITH_COUNTS = {
    "name": "cohort_counts",
    "alias": "agg",
    "join": {"left_table": MAIN, "left_on": "l_partkey", "right_on": "l_partkey"},
}

STEP_SPEC = StepSpec.from_json(
    {
        "title": "Rare calls",
        "description": "Calls of variants that are rare in the cohort and may matter.",
        "tables": [_WITH_COUNTS],
        "fields": [
            {"name": "l_orderkey", "table": MAIN},
            {"name": "l_linenumber", "table": MAIN},
            {"name": "ref_count", "table": "agg"},
            {"name": "var_count", "table": "agg"},
        ],
        "filters": {
            "$and": [
                {"expression": "(agg.var_count / agg.total_count) < 0.2"},
                {"expression": "main_table.l_returnflag IN ('R','A')"},
            ]
        },
        "order": [{"field": "agg.total_count", "direction": "desc"}],
    }
)

_STEP_FROM = f"from lineitem m join {_COUNTS_SQL} agg on m.l_partkey=agg.l_partkey"
_STEP_WHERE = "where (agg.var_count/nullif(agg.total_count,0))<0.2 and m.l_returnflag in ('R','A')"
_STEP_FIELDS = "m.l_orderkey,m.l_linenumber,agg.ref_count,agg.var_count"


@query(f"select {_STEP_FIELDS} {_STEP_FROM} {_STEP_WHERE}")
def step_query(spark: SparkSession, folder: str) -> DataFrame:
    return run_step(STEP_SPEC, _cohort(spark, folder), ["lineitem.parquet"])


@query(f"select {_STEP_FIELDS} {_STEP_FROM}")
def step_unfiltered(spark: SparkSession, folder: str) -> DataFrame:
    lake = _cohort(spark, folder)
    return run_step(STEP_SPEC, lake, ["lineitem.parquet"], apply_filters=False, apply_order=False)


@query(
    f"select {_STEP_FIELDS} {_STEP_FROM} {_STEP_WHERE} "
    "order by agg.total_count desc nulls last,1,2,3,4 limit 10 offset 20"
)
def step_pages(spark: SparkSession, folder: str) -> DataFrame:
    relation = step_relation(STEP_SPEC, _cohort(spark, folder), ["lineitem.parquet"])
    return step_page(STEP_SPEC, relation, number=3, size=10)


@query(
    f"select {_STEP_FIELDS} {_STEP_FROM} {_STEP_WHERE} "
    "and m.l_suppkey in (select s_suppkey from supplier where contains(lower(s_name),'7'))"
)
def step_for_samples(spark: SparkSession, folder: str) -> DataFrame:
    picks = search(_table(spark, folder, "supplier"), "7", ["s_name"]).select("s_suppkey")
    lake = _cohort(spark, folder)
    return run_step(STEP_SPEC, lake, ["lineitem.parquet"], picks, sample_column="l_suppkey", apply_order=False)


@query(f"select count(*) as count_star {_STEP_FROM} {_STEP_WHERE}")
def step_count(spark: SparkSession, folder: str) -> DataFrame:
    relation = step_relation(STEP_SPEC, _cohort(spark, folder), ["lineitem.parquet"])
    return relation.agg(F.count("*").alias("count_star"))


def _step_rows(spark: SparkSession, folder: str) -> StepPages:
    return StepPages.of(STEP_SPEC, step_relation(STEP_SPEC, _cohort(spark, folder), ["lineitem.parquet"]))


_STEP_RANKED = (
    f"select {_STEP_FIELDS},row_number() over (order by agg.total_count desc nulls last,1,2,3,4) r,count(*) over () n "
    f"{_STEP_FROM} {_STEP_WHERE}"
).replace("nulls last,1,2,3,4", "nulls last,m.l_orderkey,m.l_linenumber,agg.ref_count,agg.var_count")
_STEP_LAST = f"select l_orderkey,l_linenumber,ref_count,var_count from ({_STEP_RANKED}) where r>((n-1)//10)*10"


@query(_STEP_LAST)
def step_view_last(spark: SparkSession, folder: str) -> DataFrame:
    return _step_rows(spark, folder).show("last", size=10).rows


@query(_STEP_LAST)
def step_view_past_end(spark: SparkSession, folder: str) -> DataFrame:
    """Read from the table sorted once; a page past the end is the last one."""
    return _step_rows(spark, folder).sorted().show(10**6, size=10).rows


@query(f"select l_orderkey,l_linenumber,ref_count,var_count from ({_STEP_RANKED}) where r>10 and r<=20")
def step_after(spark: SparkSession, folder: str) -> DataFrame:
    pages = _step_rows(spark, folder)
    tenth = page(pages.rows, pages.order, 10, 1).first()
    return pages.after(tenth.asDict(), 10)


@query("select l_orderkey,l_linenumber,l_linenumber+1 next,l_extendedprice/nullif(l_linenumber-1,0) ratio,'a/b' slash,"
       "case when l_linenumber%2=0 then -l_quantity/2 end half from lineitem")
def project_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Divisions beside other arithmetic and a stroke in a literal."""
    fields = [
        FieldSpec("l_orderkey", MAIN),
        FieldSpec("l_linenumber", MAIN),
        FieldSpec("{table}.l_linenumber + 1", MAIN, alias="next", is_expression=True),
        FieldSpec("{table}.l_extendedprice / ({table}.l_linenumber - 1)", MAIN, alias="ratio", is_expression=True),
        FieldSpec("slash", value="'a/b'", is_expression=True),
        FieldSpec("case when l_linenumber % 2 = 0 then -l_quantity / 2 end", MAIN, alias="half", is_expression=True),
    ]
    return project(_lake(spark, folder).main(["lineitem.parquet"]), fields)


# -- projection, filter, order -----------------------------------------------------


@query("select 'hg19' as reference_genome,o_orderkey,o_custkey from orders")
def project_literal(spark: SparkSession, folder: str) -> DataFrame:
    fields = [
        FieldSpec("reference_genome", value="'hg19'", is_expression=True),
        FieldSpec("o_orderkey", MAIN),
        FieldSpec("o_custkey", MAIN),
    ]
    return project(_lake(spark, folder).main(["orders.parquet"]), fields)


@query("select l_orderkey as order_key,l_extendedprice*(1-l_discount) as revenue from lineitem")
def project_expression(spark: SparkSession, folder: str) -> DataFrame:
    fields = [
        FieldSpec("l_orderkey", MAIN, alias="order_key"),
        FieldSpec("{table}.l_extendedprice * (1 - {table}.l_discount)", MAIN, alias="revenue", is_expression=True),
    ]
    return project(_lake(spark, folder).main(["lineitem.parquet"]), fields)


@query("select user_id,len(tags) as n,tags[1] as first_tag from (select user_id,string_split(props,':') tags from events)")
def project_nested(spark: SparkSession, folder: str) -> DataFrame:
    tagged = _table(spark, folder, "events").select("user_id", F.split("props", ":").alias("tags")).alias(MAIN)
    rows = project(tagged, [FieldSpec("user_id", MAIN), FieldSpec("tags", MAIN)])
    return rows.select("user_id", F.size("tags").cast("bigint").alias("n"), F.col("tags")[0].alias("first_tag"))


@query(
    "select o_orderkey from orders where o_orderstatus='F' "
    "and (o_totalprice>400000 or o_orderpriority in ('1-URGENT'))"
)
def filter_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = FilterNode.parse(
        {
            "$and": [
                {"expression": "\"o_orderstatus\" = 'F'"},
                {"$or": ["main_table.o_totalprice > 400000", "o_orderpriority IN ('1-URGENT')", {"$and": []}]},
                "",
            ]
        }
    )
    return where(_lake(spark, folder).main(["orders.parquet"]), tree).select("o_orderkey")


@query(
    "select o_orderkey from orders where (o_orderstatus='F' and o_totalprice>400000) "
    "or (o_orderstatus='O' and o_orderpriority in ('1-URGENT','2-HIGH'))"
)
def filter_any_of(spark: SparkSession, folder: str) -> DataFrame:
    tree = FilterNode.parse(
        {
            "filter_type": "OR",
            "children": [
                {"filter_type": "AND", "children": ["o_orderstatus = 'F'", "o_totalprice > 400000"]},
                {"filter_type": "AND", "children": ["o_orderstatus = 'O'", "o_orderpriority IN ('1-URGENT','2-HIGH')"]},
            ],
        }
    )
    return where(_lake(spark, folder).main(["orders.parquet"]), tree).select("o_orderkey")


@query("select o_orderkey,o_orderstatus from orders")
def filter_empty(spark: SparkSession, folder: str) -> DataFrame:
    return where(_lake(spark, folder).main(["orders.parquet"]), FilterNode()).select("o_orderkey", "o_orderstatus")


@query("select p_partkey from part where (p_size/nullif(p_size-1,0))<1.5")
def ratio_zero_den(spark: SparkSession, folder: str) -> DataFrame:
    ratio = FilterNode.leaf("(p_size / (p_size - 1)) < 1.5")
    return where(_table(spark, folder, "part"), ratio).select("p_partkey")


@query("select l_orderkey,l_suppkey from lineitem where l_suppkey in (3,14,15,92,65)")
def samples_listed(spark: SparkSession, folder: str) -> DataFrame:
    rows = restrict(_table(spark, folder, "lineitem"), "l_suppkey", [3, 14, 15, 92, 65])
    return rows.select("l_orderkey", "l_suppkey")


@query("select c_custkey,c_mktsegment,c_acctbal from customer")
def order_by(spark: SparkSession, folder: str) -> DataFrame:
    keys = [OrderKey("c_mktsegment", "desc"), OrderKey("c_acctbal"), OrderKey("c_custkey")]
    return order(_table(spark, folder, "customer"), keys).select("c_custkey", "c_mktsegment", "c_acctbal")


# -- joins -----------------------------------------------------------------------


@query(
    "select l_orderkey,s_name,n_name from lineitem join supplier on l_suppkey=s_suppkey "
    "join nation on s_nationkey=n_nationkey"
)
def join_chain(spark: SparkSession, folder: str) -> DataFrame:
    spec = StepSpec.from_json(
        {
            "tables": [
                {
                    "name": "'supplier.parquet'",
                    "alias": "s",
                    "join": {"left_table": MAIN, "left_on": "l_suppkey", "right_on": "s_suppkey"},
                },
                {
                    "name": "read_parquet(['nation.parquet'])",
                    "alias": "n",
                    "join": {"left_table": "s", "left_on": "s_nationkey", "right_on": "n_nationkey"},
                },
            ],
            "fields": [
                {"name": "l_orderkey", "table": MAIN},
                {"name": "s_name", "table": "s"},
                {"name": "n_name", "table": "n"},
            ],
        }
    )
    return run_step(spec, _lake(spark, folder), ["lineitem.parquet"])


def _labelled(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``embeddings`` and ``labels``: each holds keys the other lacks."""
    fields = [{"name": "vec_id", "table": MAIN}, {"name": "label", "table": MAIN}]
    if kind not in ("SEMI JOIN", "ANTI JOIN"):
        fields += [{"name": "doc_id", "table": "b"}, {"name": "toxic", "table": "b"}]
    on = {"left_table": MAIN, "left_on": "vec_id", "right_on": "doc_id", "join_type": kind}
    spec = StepSpec.from_json({"tables": [{"name": "'labels.parquet'", "alias": "b", "join": on}], "fields": fields})
    return run_step(spec, _lake(spark, folder), ["embeddings.parquet"])


_PAIRS = "select d.vec_id,d.label,b.doc_id,b.toxic from embeddings d {} join labels b on d.vec_id=b.doc_id"


@query(_PAIRS.format("inner"))
def join_inner(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "JOIN")


@query(_PAIRS.format("left"))
def join_left(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "LEFT JOIN")


@query(_PAIRS.format("right"))
def join_right(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "RIGHT JOIN")


@query(_PAIRS.format("full"))
def join_full(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "FULL OUTER JOIN")


@query("select d.vec_id,d.label from embeddings d semi join labels b on d.vec_id=b.doc_id")
def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "SEMI JOIN")


@query("select d.vec_id,d.label from embeddings d anti join labels b on d.vec_id=b.doc_id")
def join_anti(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder, "ANTI JOIN")


@query(
    "select o_orderkey,c_name from (select o_orderkey,o_custkey from orders where o_orderstatus='F') q "
    "join customer on o_custkey=c_custkey"
)
def nested_subquery(spark: SparkSession, folder: str) -> DataFrame:
    inner = where(_table(spark, folder, "orders"), FilterNode.leaf("o_orderstatus = 'F'"))
    spec = StepSpec.from_json(
        {
            "tables": [
                {
                    "name": "'customer.parquet'",
                    "alias": "c",
                    "join": {"left_table": MAIN, "left_on": "o_custkey", "right_on": "c_custkey"},
                }
            ],
            "fields": [{"name": "o_orderkey", "table": MAIN}, {"name": "c_name", "table": "c"}],
        }
    )
    return run_step(spec, _lake(spark, folder), inner.select("o_orderkey", "o_custkey"))


def _dealt_whole(spark: SparkSession, folder: str, how: str) -> DataFrame:
    """All orders and all events. Heavy keys: -1 (urgent orders, few events), -2 (purchases, few orders) and NULL; others are unique."""
    orders = _table(spark, folder, "orders").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", -1).when(F.col("o_orderkey") < 3, -2)
        .when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("k"), "o_orderkey"
    )
    events = _table(spark, folder, "events").select(
        F.when(F.col("event_type") == "purchase", -2).when(F.col("event_id") < 3, -1)
        .when(F.col("event_type") != "error", F.col("event_id")).alias("key"), "event_id"
    )
    return join(orders.alias("a"), events.alias("b"), "a.k", "b.key", how, light_rows=50, may_broadcast=False)


_WHOLE = (
    "(select case when o_orderpriority='1-URGENT' then -1 when o_orderkey<3 then -2 when o_orderstatus<>'P' then o_orderkey end k,"
    "o_orderkey from orders) a {} join (select case when event_type='purchase' then -2 when event_id<3 then -1 "
    "when event_type<>'error' then event_id end as key,event_id from events) b on a.k=b.key"
)


@query("select k,key,o_orderkey,event_id from " + _WHOLE.format("inner"))
def join_dealt_whole_inner(spark: SparkSession, folder: str) -> DataFrame:
    return _dealt_whole(spark, folder, "inner")


@query("select k,key,o_orderkey,event_id from " + _WHOLE.format("left"))
def join_dealt_whole_left(spark: SparkSession, folder: str) -> DataFrame:
    return _dealt_whole(spark, folder, "left")


@query("select k,key,o_orderkey,event_id from " + _WHOLE.format("right"))
def join_dealt_whole_right(spark: SparkSession, folder: str) -> DataFrame:
    return _dealt_whole(spark, folder, "right")


@query("select k,key,o_orderkey,event_id from " + _WHOLE.format("full"))
def join_dealt_whole_full(spark: SparkSession, folder: str) -> DataFrame:
    return _dealt_whole(spark, folder, "full")


@query("select k,o_orderkey from " + _WHOLE.format("semi"))
def join_dealt_whole_semi(spark: SparkSession, folder: str) -> DataFrame:
    return _dealt_whole(spark, folder, "left_semi")


@query("select k,o_orderkey from " + _WHOLE.format("anti"))
def join_dealt_whole_anti(spark: SparkSession, folder: str) -> DataFrame:
    return _dealt_whole(spark, folder, "left_anti")


# -- pages -----------------------------------------------------------------------

_BY_PRICE = [("o_totalprice", "desc"), ("o_orderkey", "asc")]


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").select("o_orderkey", "o_totalprice")


@query("select o_orderkey,o_totalprice from orders order by o_totalprice desc nulls last,o_orderkey limit 10 offset 40")
def page_by_number(spark: SparkSession, folder: str) -> DataFrame:
    return page(_prices(spark, folder), _BY_PRICE, number=5, size=10)


@query(
    "select o_orderkey,case when o_orderstatus='F' then o_totalprice end p from orders "
    "order by p asc nulls last,o_orderkey limit 20 offset 4920"
)
def page_nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    rows = _table(spark, folder, "orders").select("o_orderkey", price.alias("p"))
    return page(rows, ["p", "o_orderkey"], number=247, size=20)


@query("select o_orderkey,o_totalprice from orders order by o_totalprice desc nulls last,o_orderkey limit 10 offset 2990")
def page_deep(spark: SparkSession, folder: str) -> DataFrame:
    """Found by rank: a sketch bounds the prices, exact counts correct it."""
    return deep_page(_prices(spark, folder), _BY_PRICE, 300, 10, band_rows=200)


@query(ORACLES["page_deep"])
def page_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return SortedPages.of(_prices(spark, folder), _BY_PRICE).page(300, 10)


@query(
    "select event_type,user_id,event_id from events order by event_type='click' desc,case when event_type='click' then user_id end desc nulls last,"
    "event_id limit 50 offset 4950"
)
def page_among_ties(spark: SparkSession, folder: str) -> DataFrame:
    """A page far in, by keys that most rows share or lack."""
    click = F.col("event_type") == "click"
    rows = _table(spark, folder, "events").select(
        click.alias("first"), F.when(click, F.col("user_id")).alias("second"), "event_id", "event_type", "user_id"
    )
    return deep_page(rows, ["first desc", "second desc", "event_id"], 100, 50, band_rows=200).select("event_type", "user_id", "event_id")


@query(
    "select o_orderkey,o_totalprice from (select o_orderkey,o_totalprice,count(*) over () n,"
    "row_number() over (order by o_totalprice desc nulls last,o_orderkey) r from orders) where r>((n-1)//10)*10"
)
def page_last(spark: SparkSession, folder: str) -> DataFrame:
    return show_page(_prices(spark, folder), _BY_PRICE, "last", size=10).rows


@query(
    "select c_custkey,c_acctbal from (select c_custkey,c_acctbal,count(*) over () n,"
    "row_number() over (order by c_acctbal nulls last,c_custkey) r from customer) where r>((n-1)//7)*7"
)
def page_past_end(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return show_page(rows, ["c_acctbal", "c_custkey"], 10**9, size=7).rows


@query(
    "select o_orderkey,o_totalprice from orders where o_totalprice<250000 or (o_totalprice=250000 and o_orderkey>7) "
    "order by o_totalprice desc nulls last,o_orderkey limit 10"
)
def page_following(spark: SparkSession, folder: str) -> DataFrame:
    return page_after(_prices(spark, folder), _BY_PRICE, {"o_totalprice": 250000.0, "o_orderkey": 7}, size=10)


@query(
    "select count(*) as row_count, cast(greatest(ceil(count(*)/10.0),1) as bigint) as page_count "
    "from orders where o_orderstatus='F'"
)
def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    return page_stats(_table(spark, folder, "orders").filter("o_orderstatus = 'F'"), size=10)


@query("select p_partkey,p_retailprice,p_name from part order by p_retailprice desc nulls last,p_name,p_partkey limit 100")
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "part").select("p_partkey", "p_retailprice", "p_name")
    return page(rows, ["p_retailprice desc", "p_name", "p_partkey"], size=100)


# -- recurrence --------------------------------------------------------------------


@query("select distinct l_suppkey from lineitem")
def distinct_samples(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_values(_table(spark, folder, "lineitem"), "l_suppkey")


@query("select distinct l_suppkey,l_partkey from lineitem")
def distinct_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_values(_table(spark, folder, "lineitem"), "l_suppkey", "l_partkey")


@query("select distinct l_suppkey from lineitem where contains(lower(cast(l_suppkey as varchar)),'1')")
def sample_choices(spark: SparkSession, folder: str) -> DataFrame:
    return search(distinct_values(_table(spark, folder, "lineitem"), "l_suppkey"), "1")


@query(
    "select l_partkey,count(*) rr from "
    "(select distinct nullif(l_suppkey,5) sn,l_partkey from lineitem) group by 1"
)
def recurrence(spark: SparkSession, folder: str) -> DataFrame:
    calls = _table(spark, folder, "lineitem").select(F.nullif("l_suppkey", F.lit(5)).alias("sn"), "l_partkey")
    return run_recurrence(calls, "sn", "l_partkey", "rr")


@query(
    f"select m.l_orderkey,agg.var_count,rec.run_recurr {_STEP_FROM} "
    "join (select l_partkey,count(*) run_recurr from (select distinct l_suppkey,l_partkey from lineitem) group by 1) rec "
    "on rec.l_partkey=m.l_partkey"
)
def recurrence_joined(spark: SparkSession, folder: str) -> DataFrame:
    lake = _cohort(spark, folder)
    main = lake.main(["lineitem.parquet"])
    relation = step_relation(STEP_SPEC, lake, ["lineitem.parquet"], apply_filters=False)
    rows = with_run_recurrence(relation, main, "l_suppkey", "l_partkey")
    return rows.select("main_table.l_orderkey", "agg.var_count", "rec.run_recurr")


def _kept(spark: SparkSession, folder: str, sample: Column) -> Cohort:
    """The calls taken into a cohort in three runs."""
    calls = _table(spark, folder, "lineitem").select(sample.alias("sn"), "l_partkey", "l_returnflag")
    rules = {"var_count": "l_returnflag = 'R'", "ref_count": "l_returnflag <> 'R'"}
    cohort = Cohort.create(spark, new_shared_path(spark, "cohort"), calls, "sn", "l_partkey", rules, buckets=8)
    for run, flag in (("returned", F.col("l_returnflag") == "R"), ("accepted", F.col("l_returnflag") == "A")):
        cohort.add(run, calls.filter(flag))
    cohort.add("others", calls.filter("coalesce(l_returnflag, '') not in ('R', 'A')"))
    return cohort


@query(ORACLES["recurrence"])
def cohort_recurrence(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, F.nullif("l_suppkey", F.lit(5))).recurrence(name="rr")


@query("select distinct nullif(l_suppkey,5) sn,l_partkey from lineitem")
def cohort_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _kept(spark, folder, F.nullif("l_suppkey", F.lit(5))).pairs()


@query(
    f"select m.l_orderkey,m.l_linenumber,agg.var_count,agg.ref_count,agg.total_count,rec.run_recurr {_STEP_FROM} "
    "join (select l_partkey,count(distinct l_suppkey) run_recurr from lineitem group by 1) rec on rec.l_partkey=m.l_partkey"
)
def cohort_joined(spark: SparkSession, folder: str) -> DataFrame:
    calls = _table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return _kept(spark, folder, F.col("l_suppkey")).joined(calls, "l_partkey").drop("l_partkey")


_DIALECT = [
    "strftime(o_orderdate, '%Y-%m') = '1995-11'",
    "regexp_matches(o_orderpriority, '^[12]') or list_contains(string_split(o_orderpriority, '-'), 'LOW')",
    "not suffix(o_orderpriority, 'H')",
]


@query(f"select o_orderkey from orders where {' and '.join(f'({text})' for text in _DIALECT)}")
def filter_dialect(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf text with functions Spark does not have: the same text as the SQL."""
    spec = StepSpec.from_json(
        {
            "tables": [],
            "fields": [{"name": "o_orderkey", "table": MAIN}],
            "filters": {"$and": [{"expression": text} for text in _DIALECT]},
        }
    )
    return run_step(spec, _lake(spark, folder), ["orders.parquet"])


# -- search, display and checks ------------------------------------------------------


@query("select o_orderkey from orders where strftime(o_orderdate,'%d/%m/%Y %H:%M:%S') like '%11/1995%'")
def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in a folder for each year, of which those that cannot hold the text are not read."""
    years = new_shared_path(spark, "years")
    by_year = _table(spark, folder, "orders").withColumn("year", F.year("o_orderdate")).repartition("year")
    by_year.write.partitionBy("year").parquet(years)
    orders = spark.read.schema(f"{SCHEMAS['orders']}, year int").parquet(years)
    index = SearchIndex(spark, new_shared_path(spark, "index"))
    index.take(orders, ["o_orderdate"])
    return index.search(orders, "11/1995", ["o_orderdate"]).select("o_orderkey")


@query(
    "select s_suppkey,s_name from supplier where contains(lower(cast(s_suppkey as varchar)),'1') "
    "or contains(lower(s_name),'1') or contains(lower(cast(s_nationkey as varchar)),'1') "
    "or contains(cast(s_acctbal as varchar),'1')"
)
def search_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return search(_table(spark, folder, "supplier"), "1").select("s_suppkey", "s_name")


@query(
    "select o_orderkey from orders where contains(strftime(o_orderdate,'%d/%m/%Y %H:%M:%S'),'12/1995') "
    "or contains(lower(o_orderpriority),'12/1995') or contains(lower(o_orderstatus),'12/1995')"
)
def search_shown(spark: SparkSession, folder: str) -> DataFrame:
    return search(_table(spark, folder, "orders"), "12/1995").select("o_orderkey")


@query(
    "select o_orderkey,o_totalprice*1024 as big from orders where contains(cast(o_totalprice*1024 as varchar),'2345')"
)
def search_large(spark: SparkSession, folder: str) -> DataFrame:
    """Doubles of 1e7 and more are searched in plain decimal signs."""
    big = _table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") * 1024).alias("big"))
    return search(big, "2345", ["big"])


@query("select o_orderkey from orders where contains(lower(cast(o_orderdate as varchar)),'1995-12')")
def search_stored(spark: SparkSession, folder: str) -> DataFrame:
    return search(_table(spark, folder, "orders"), "1995-12", ["o_orderdate"], raw=True).select("o_orderkey")


@query("select p_partkey from part where regexp_matches(p_name,'^RED .*t$','i')")
def search_regex(spark: SparkSession, folder: str) -> DataFrame:
    return search(_table(spark, folder, "part"), "^RED .*t$", ["p_name"], regexp=True).select("p_partkey")


@query(
    r"select p_partkey,regexp_matches(p_brand,'^(\p{L}| |[0-9])+$') ok,"
    r"regexp_matches(p_name,'^(\p{L}| |[0-9])+$') ok2 from part"
)
def name_check(spark: SparkSession, folder: str) -> DataFrame:
    names = (valid_name(F.col("p_brand")).alias("ok"), valid_name(F.col("p_name")).alias("ok2"))
    return _table(spark, folder, "part").select("p_partkey", *names)


@query(
    "select p_partkey,(length(p_name)>0 and length(case when p_size>10 then p_type else '' end)>0 "
    "and len(string_split(p_brand,'#'))>0 "
    "and len(list_filter(string_split(p_type,' '),lambda x: x<>'ECONOMY'))>0) complete from part"
)
def job_check(spark: SparkSession, folder: str) -> DataFrame:
    complete = job_is_complete(
        F.col("p_name"),
        F.when(F.col("p_size") > 10, F.col("p_type")).otherwise(""),
        F.split("p_brand", "#"),
        F.array_remove(F.split("p_type", " "), "ECONOMY"),
    )
    return _table(spark, folder, "part").select("p_partkey", complete.alias("complete"))


@query(
    "select o_orderkey,strftime(o_orderdate,'%d/%m/%Y %H:%M:%S') d,"
    "case when o_orderstatus='F' then 'Yes' else 'No' end done from orders"
)
def display_table(spark: SparkSession, folder: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    orders = _table(spark, folder, "orders")
    return display(orders.select("o_orderkey", F.col("o_orderdate").alias("d"), done.alias("done")))


@query("select p_partkey,array_to_string(string_split(p_name,' '),', ') tags from part")
def array_display(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "part").select("p_partkey", joined(F.split("p_name", " ")).alias("tags"))


@query(
    r"select page_id,case when regexp_matches(n,'^.+\.[^.]+$') then regexp_replace(n,'\.[^.]+$','') else n end "
    r"|| ', run' as parquet_files from (select page_id,regexp_extract(url,'([^/]*)/*$',1) n from pages)"
)
def stem_display(spark: SparkSession, folder: str) -> DataFrame:
    files = F.array(F.col("url"), F.lit("genotypes/run.parquet"))
    return _table(spark, folder, "pages").select("page_id", path_stems(files).alias("parquet_files"))


# -- review log ----------------------------------------------------------------------


def _said(spark: SparkSession, folder: str, decided: Column) -> DataFrame:
    """``events`` read as the decisions of one job (where ``decided``) and comments on them."""
    return _table(spark, folder, "events").select(
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"),
        F.col("ts").cast("timestamp").alias("at"),
        "ts",
        F.when(decided, DECISION).otherwise(REMARK).alias("kind"),
        F.col("user_id").alias("validation_hash"),
        F.lit(None).cast("string").alias("sample_name"),
        F.col("event_type").alias("run_name"),
        F.lit(None).cast("string").alias("transcript_ID"),
        F.when(decided, F.col("value") > 20).alias("accepted"),
        F.array("event_type").alias("tags"),
        F.when(~decided, F.col("props")).alias("comment"),
        F.lit("reviewer").alias("username"),
        F.lit("validation_events").alias("table_uuid"),
    )


@query("select user_id,max_by(event_type,row(ts,event_id)) last_type from events group by 1")
def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    now = folds.decisions(_said(spark, folder, F.lit(True)))
    return now.select(F.col("validation_hash").alias("user_id"), F.col("run_name").alias("last_type"))


def _at_once(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` read as decisions of three writers, each of whom knows the others' up to 500 events ago."""
    writer, turn = F.concat(F.lit("w"), F.col("event_id") % 3), F.col("event_id").cast("bigint")
    others = [F.concat(F.lit("w"), (F.col("event_id") + k) % 3) for k in (1, 2)]
    seen = F.create_map(others[0], turn - 500, others[1], turn - 500)
    table = _table(spark, folder, "events")
    told = table.select(
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"),
        F.col("ts").cast("timestamp").alias("at"),
        "ts",
        F.lit(DECISION).alias("kind"),
        F.col("user_id").alias("validation_hash"),
        *[F.lit(None).cast("string").alias(c) for c in ("sample_name", "run_name", "transcript_ID")],
        (F.col("value") > 20).alias("accepted"),
        F.array("event_type").alias("tags"),
        *[x.alias(c) for x, c in ((writer, "writer"), (turn, "turn"), (seen, "seen"))],
        F.lit("validation_events").alias("table_uuid"),
    )
    return causal.heads(told)


_AT_ONCE = (
    "with e as (select user_id h,event_id t,event_id%3 w,ts,value>20 acc,event_type tag from events),"
    "last as (select * from e qualify row_number() over (partition by h,w order by t desc)=1),"
    "heads as (select * from last l where not exists (select 1 from e f where f.h is not distinct from l.h and f.w<>l.w and f.t-500>=l.t)),"
    "found as (select h,count(*) heads,count(distinct coalesce(cast(acc as varchar),'-')||coalesce(tag,'-'))>1 conflicting,"
    "max_by(tag,row(ts,t)) tag from heads group by h) "
)


@query(_AT_ONCE + "select h user_id,heads,conflicting,tag from found")
def decisions_settled(spark: SparkSession, folder: str) -> DataFrame:
    """What stands of each user's decisions by who knew of which, and whether some made at once differ."""
    now = causal.settled(_at_once(spark, folder))
    return now.select(F.col("validation_hash").alias("user_id"), "heads", "conflicting", F.col("tags")[0].alias("tag"))


@query(_AT_ONCE + "select h user_id,'w'||w writer,t turn,acc accepted from heads where h in (select h from found where conflicting)")
def decision_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions made at once that differ, a row each."""
    apart = causal.conflicts(_at_once(spark, folder))
    return apart.select(F.col("validation_hash").alias("user_id"), "writer", "turn", "accepted")


@query(
    "select user_id validation_hash,props comment,lpad(cast(event_id as varchar),20,'0') event_id,"
    "cast(row_number() over (partition by user_id order by ts,event_id) as bigint) turn from events where event_type<>'click'"
)
def comment_history(spark: SparkSession, folder: str) -> DataFrame:
    """All comments in the order in which they were made, through the log."""
    said = folds.comments(_said(spark, folder, F.col("event_type") == "click"))
    numbered = number_rows(said, ["validation_hash"], [F.col("at"), F.col("event_id")], "turn")
    return numbered.select("validation_hash", "comment", "event_id", (F.col("turn") + 1).alias("turn"))


@query(
    "select 'validation_'||user_id table_uuid,cast(sum(case when event_type='click' then 1 else 0 end) as integer) last_step, "
    "sum(case when event_type='click' then 1 else 0 end)>=20 completed from events group by user_id"
)
def progress(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs that count their clicks as steps and end with the twentieth, folded from their events."""
    clicks = F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(
        Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    events = _table(spark, folder, "events").select(
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"),
        F.col("ts").cast("timestamp").alias("at"),
        "ts",
        F.lit(CREATED).alias("kind"),
        F.concat(F.lit("validation_"), F.col("user_id")).alias("table_uuid"),
        F.array("props").alias("parquet_files"),
        F.array("props").alias("sample_names"),
        *[F.col("event_type").alias(c) for c in ("username", "validation_name", "validation_method")],
        clicks.cast("int").alias("last_step"),
        (clicks >= 20).alias("completed"),
    )
    return folds.review_jobs(events).select("table_uuid", "last_step", "completed")


def _job_events(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` read as a job log: a job per user, a change per event."""
    kind = F.col("event_type")
    drop = (kind == "error") & (F.col("value") > 100)
    return _table(spark, folder, "events").select(
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(kind == "signup", CREATED)
        .when(kind == "click", STEP)
        .when(kind == "purchase", COMPLETED)
        .when(drop, DELETED)
        .alias("kind"),
        F.concat(F.lit("validation_"), F.col("user_id")).alias("table_uuid"),
        F.when(kind == "signup", F.array(F.col("props"))).alias("parquet_files"),
        F.when(kind == "signup", F.split("props", ":")).alias("sample_names"),
        F.when(kind == "signup", F.lit("reviewer")).alias("username"),
        F.when(kind == "signup", F.col("props")).alias("validation_name"),
        F.when(kind == "signup", F.lit("method")).alias("validation_method"),
        F.when(kind == "click", F.floor("value").cast("int")).alias("last_step"),
        F.when(kind == "purchase", F.col("value") > 20).alias("completed"),
    )


@query(
    "select 'validation_'||user_id table_uuid,"
    "max_by(props,row(ts,event_id)) filter (where event_type='signup') validation_name,"
    "coalesce(max_by(value>20,row(ts,event_id)) filter (where event_type='purchase'),false) completed,"
    "coalesce(max_by(cast(floor(value) as integer),row(ts,event_id)) filter (where event_type='click'),0) last_step "
    "from events group by user_id having count(*) filter (where event_type='signup')>0 "
    "and count(*) filter (where event_type='error' and value>100)=0"
)
def review_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs = folds.review_jobs(_job_events(spark, folder))
    return jobs.select("table_uuid", "validation_name", "completed", "last_step")


@query(
    "select user_id validation_hash,cast(max_by(value>20,row(ts,event_id)) filter (where event_type='click') as varchar) accepted,"
    "max_by(event_type,row(ts,event_id)) filter (where event_type='click') tag from events group by 1"
)
def review_store(spark: SparkSession, folder: str) -> DataFrame:
    log = ReviewLog(spark, new_shared_path(spark, "review"))
    log.append_decision_events(_said(spark, folder, F.col("event_type") == "click"))
    state = folds.decisions(log.decision_events().filter(F.col("table_uuid") == "validation_events"))
    return state.select("validation_hash", F.col("accepted").cast("string").alias("accepted"), F.col("tags")[0].alias("tag"))


def _in_three(rows: DataFrame, kind: str, first: list[str], second: list[str]) -> list[DataFrame]:
    """The rows in three appends, by kind, each with early and late ones."""
    own = F.coalesce(kind, F.lit(""))
    return [rows.filter(own.isin(first)), rows.filter(own.isin(second)), rows.filter(~own.isin(first + second))]


@query(ORACLES["review_jobs"])
def snapshot_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs of a log appended in three, of which the first two are in a snapshot."""
    log = ReviewLog(spark, new_shared_path(spark, "review"))
    kept = FoldedLog(log, "job_events", folds.JOBS)
    for number, part in enumerate(_in_three(_job_events(spark, folder), "kind", [STEP, DELETED], [CREATED])):
        log.append_job_events(part)
        if number < 2:
            kept.advance()
    return kept.now().select("table_uuid", "validation_name", "completed", "last_step")


@query(ORACLES["review_store"])
def snapshot_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The decisions of a job whose events were appended in three, of which the first two are in a snapshot."""
    log = ReviewLog(spark, new_shared_path(spark, "review"))
    kept = FoldedLog(log, "decision_events", folds.DECISIONS)
    for number, part in enumerate(_in_three(_said(spark, folder, F.col("event_type") == "click"), "run_name", ["signup"], ["click"])):
        log.append_decision_events(part)
        if number < 2:
            kept.advance()
    state = kept.now("validation_events")
    return state.select("validation_hash", F.col("accepted").cast("string").alias("accepted"), F.col("tags")[0].alias("tag"))


_LAST_TYPES = "(select user_id,max_by(event_type,row(ts,event_id)) last_type from events group by 1)"


def _report(spark: SparkSession, folder: str, how: str) -> DataFrame:
    main = _table(spark, folder, "customer").withColumnRenamed("c_custkey", "user_id")
    events = _table(spark, folder, "events")
    decided = events.groupBy("user_id").agg(folds.latest("event_type").alias("last_type"))
    rows = decision_report(main, decided, ["user_id", "c_name"], how, key="user_id")
    return rows.withColumnRenamed("user_id", "c_custkey")


@query(f"select c_custkey,c_name,last_type from customer left join {_LAST_TYPES} on c_custkey=user_id")
def decision_report_all(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, "left")


@query(f"select c_custkey,c_name,last_type from customer join {_LAST_TYPES} on c_custkey=user_id")
def decision_report_decided(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, "inner")


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` under the column names of a run of variant calls."""
    return _table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("validation_hash"),
        F.col("l_partkey").alias("variant_hash"),
        F.col("l_suppkey").cast("string").alias("sample_name"),
        F.col("l_linestatus").alias("run_name"),
        F.col("l_returnflag").alias("chromosome"),
        F.col("l_linenumber").alias("position"),
        F.lit("A").alias("reference"),
        F.lit("T").alias("alternate"),
        F.lit("gene").alias("snpeff_Gene_Name"),
    )


def _verdicts(spark: SparkSession, folder: str, job: str) -> DataFrame:
    """``orders`` read as decisions of one job, with a comment on the open ones."""
    status, text = F.col("o_orderstatus"), F.lit(None).cast("string")
    verdict = F.when(status != "P", F.col("o_totalprice") > 200000)
    kinds = F.when(status == "P", F.array(F.lit(DECISION), F.lit(REMARK))).otherwise(F.array(F.lit(DECISION)))
    return _table(spark, folder, "orders").select(
        F.explode(kinds).alias("kind"),
        F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("event_id"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("validation_hash"),
        *[text.alias(c) for c in ("sample_name", "run_name", "transcript_ID")],
        verdict.alias("accepted"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"),
        F.when(status == "P", F.col("o_orderpriority")).alias("comment"),
        F.lit("reviewer").alias("username"),
        F.lit(job).alias("table_uuid"),
    )


@query(
    "select l_orderkey validation_hash,cast(l_suppkey as varchar) sample_name,l_linenumber as position,"
    "cast(case when o_orderstatus<>'P' then o_totalprice>200000 end as varchar) accepted,"
    "'[\"'||o_orderpriority||'\",\"'||o_orderstatus||'\"]' tags "
    "from lineitem left join orders on l_orderkey=o_orderkey where l_suppkey in (3,14,15)"
)
def review_report(spark: SparkSession, folder: str) -> DataFrame:
    """A whole review: create the job, decide, finish it, export the report, read it back."""
    root = new_shared_path(spark, "lake")
    _calls(spark, folder).write.parquet(f"{root}/run.parquet")
    store = ReviewStore(spark, f"{root}/review", Lake(spark))
    files = [f"{root}/run.parquet"]
    job = store.new_job("Review 1", "reviewer", files, ["3", "14", "15"], "rare")
    store.log.append_decision_events(_verdicts(spark, folder, job))
    shown = store.finish(job, [STEP_SPEC]).select("validation_hash", "sample_name", "position", "accepted", "tags")
    schema = "validation_hash bigint, sample_name string, position int, accepted string, tags string"
    return _through_csv(spark, shown, schema)


def _stepped(spark: SparkSession, folder: str) -> tuple[ReviewStore, str, list[StepSpec]]:
    """A job over three samples whose method, kept as a JSON file, has two steps."""
    root = new_shared_path(spark, "lake")
    _calls(spark, folder).write.parquet(f"{root}/run.parquet")
    fields = [{"name": c, "table": MAIN} for c in ("validation_hash", "sample_name", "position")]
    body = F.lit(json.dumps({"title": "Odd places", "tables": [], "fields": fields, "filters": {"expression": "position % 2 = 1"}}))
    method = spark.range(1).select(F.from_json(body, F.schema_of_json(body)).alias("m")).select("m.*")
    method.coalesce(1).write.json(f"{root}/methods")
    name = read_methods(spark, f"{root}/methods").first()["method"]
    steps = load_method(spark, f"{root}/methods", name)
    first = StepSpec.from_json({"title": "All", "tables": [], "fields": fields})
    store = ReviewStore(spark, f"{root}/review", Lake(spark))
    job = store.new_job("Review 2", "reviewer", [f"{root}/run.parquet"], ["3", "14", "15"], name)
    return store, job, [first, *steps]


_CHOSEN = (
    "select l_orderkey validation_hash,cast(l_suppkey as varchar) sample_name,l_linenumber as position "
    "from lineitem where l_suppkey in (3,14,15)"
)


@query(_CHOSEN + " and l_linenumber%2=1")
def method_next_step(spark: SparkSession, folder: str) -> DataFrame:
    """A method read from its file, taken to its second step and resumed there."""
    store, job, steps = _stepped(spark, folder)
    store.next_step(job, steps)
    return store.resume(job, steps)


@query("select validation_hash,sample_name,position from (" + _CHOSEN + ")")
def job_export(spark: SparkSession, folder: str) -> DataFrame:
    """A job taken to its end step by step, its report exported and read back."""
    store, job, steps = _stepped(spark, folder)
    store.record_step(job, len(steps) - 1)
    store.next_step(job, steps)
    target = new_shared_path(spark, "report")
    store.export(job, target)
    back = spark.read.options(header=True, quote='"', escape='"').csv(target)
    return back.select(F.col("validation_hash").cast("bigint"), "sample_name", F.col("position").cast("int"))


@query(f"select {_STEP_FIELDS} {_STEP_FROM} {_STEP_WHERE} and m.l_suppkey in (3,14,15)")
def step_dealt(spark: SparkSession, folder: str) -> DataFrame:
    """A step whose join keys are weighed, in the chosen samples' rows, and dealt over tasks."""
    options = {"sample_column": "l_suppkey", "light_rows": 3, "may_broadcast": False}
    return run_step(STEP_SPEC, _cohort(spark, folder), ["lineitem.parquet"], [3, 14, 15], **options)


# -- sources and sinks ---------------------------------------------------------------


@query("select o_orderkey,o_totalprice,o_orderstatus from orders")
def multi_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    orders, runs = _table(spark, folder, "orders"), new_shared_path(spark, "runs")
    final = F.col("o_orderstatus") == "F"
    first, second = f"{runs}/final.parquet", f"{runs}/open.parquet"
    orders.filter(final).select("o_orderkey", "o_totalprice", "o_orderstatus").write.parquet(first)
    orders.filter(~final).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice").write.parquet(second)
    return scan_files(spark, [first, second])


@query("select o_orderkey,o_orderdate,o_totalprice from orders where o_orderdate between '1994-06-15' and '1995-03-01'")
def manifest_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in a folder for each year, of which a range of days reads two."""
    orders, years = _table(spark, folder, "orders"), new_shared_path(spark, "years")
    by_year = orders.withColumn("year", F.year("o_orderdate")).repartition("year")
    by_year.write.partitionBy("year").parquet(years)
    manifest = Manifest(spark, new_shared_path(spark, "manifest"))
    manifest.take([years])
    days = {"o_orderdate": (datetime.datetime(1994, 6, 15), datetime.datetime(1995, 3, 1))}
    return manifest.scan([years], days).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("select case when o_orderstatus='F' then 'final' else 'open' end part,count(*) n from orders group by 1")
def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders, runs = _table(spark, folder, "orders"), new_shared_path(spark, "runs")
    final = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    names = [f"{runs}/final.parquet", f"{runs}/open.parquet"]
    orders.filter(final).write.parquet(names[0])
    orders.filter(~final).write.parquet(names[1])
    manifest = Manifest(spark, new_shared_path(spark, "manifest"))
    manifest.take(names)
    part = F.regexp_extract("name", r"(\w+)\.parquet$", 1).alias("part")
    return manifest.counts(names).select(part, F.col("rows").alias("n"))


@query("select n_name,r_name from nation join region on n_regionkey=r_regionkey")
def catalog_scan(spark: SparkSession, folder: str) -> DataFrame:
    _table(spark, folder, "region").createOrReplaceTempView("regions_of_the_lake")
    spec = StepSpec.from_json(
        {
            "tables": [
                {
                    "name": "regions_of_the_lake",
                    "alias": "r",
                    "quoted": True,
                    "join": {"left_table": MAIN, "left_on": "n_regionkey", "right_on": "r_regionkey"},
                }
            ],
            "fields": [{"name": "n_name", "table": MAIN}, {"name": "r_name", "table": "r"}],
        }
    )
    rows = run_step(spec, _lake(spark, folder), ["nation.parquet"])
    spark.catalog.dropTempView("regions_of_the_lake")  # the rows hold what it stood for
    return rows


def _through_csv(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    target = new_shared_path(spark, "report")
    export_csv(rows, target)
    return spark.read.schema(schema).options(header=True, quote='"', escape='"').csv(target)


@query("select p_partkey,p_name,'[\"'||array_to_string(string_split(p_name,' '),'\",\"')||'\"]' tags from part")
def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("tags"))
    return _through_csv(spark, rows, "p_partkey bigint, p_name string, tags string")


EXPORT_SPEC = StepSpec.from_json(
    {
        "tables": [_WITH_COUNTS],
        "fields": [
            {"name": "reference_genome", "value": "'hg19'", "is_expression": True},
            {"name": "l_orderkey", "table": MAIN, "is_expression": False},
            {"name": "l_returnflag", "table": MAIN, "is_expression": False},
            {"name": "ref_count", "table": "agg", "is_expression": False},
            {"name": "var_count", "table": "agg", "is_expression": False},
        ],
        "filters": STEP_SPEC.filters.to_json(),
    }
)


@query(
    "select 'hg19' reference_genome,m.l_orderkey,m.l_returnflag,agg.ref_count,agg.var_count "
    f"{_STEP_FROM} {_STEP_WHERE}"
)
def final_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = run_step(EXPORT_SPEC, _cohort(spark, folder), ["lineitem.parquet"])
    schema = "reference_genome string, l_orderkey bigint, l_returnflag string, ref_count bigint, var_count bigint"
    return _through_csv(spark, rows, schema)
