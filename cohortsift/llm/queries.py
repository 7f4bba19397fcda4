"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortsift.llm import exact_topk, language, mixing, multi_index, pii, toxicity
from cohortsift.llm.fertility import MEASURES, judged
from cohortsift.llm.near_copies import near_copies
from cohortsift.llm.packing import packed
from cohortsift.llm.periods import periodic_runs
from cohortsift.llm.repeats import repeated_words
from cohortsift.llm.shared import fold_of, table
from cohortsift.llm.token_files import write_token_files
from cohortsift.llm.variants import spelling_variants, vocabulary

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[run.__name__] = run
    return run


@query
def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    return pii.find(table(spark, folder, "documents"))


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    return packed(table(spark, folder, "documents"), size=2048, end_id=0)


@query
def op3_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document in the mix of all sources, weighted by their size to the power of 0.8."""
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.content_order().alias("order"))
    return mixing.mix(docs, exponent=0.8, block=8, order=F.col("order")).select("row.doc_id", "row.source", "place.*")


#: The same rule where each source weighs at least one in 998; frames of 1000 slots, each run to find its end, then within its bounds.
ORACLES["op3_mixed_sources"] = """
with recursive src as (
  select source, count(*) as n, row_number() over (order by count(*) desc, source nulls first) as pool from documents group by source
), w as (
  select *, greatest(1, cast(round(pow(cast(n as double), 0.8) / sum(pow(cast(n as double), 0.8)) over () * 1000000000000) as hugeint)) as v from src
), a as (
  select list(v order by pool) as v, cast(sum(v) as hugeint) as d from w
), size as (
  select max((cast(ceil(n / 8.0) as hugeint) * d + w.v - 1) // w.v) as slots from w, a
), f as (
  select f, v, d, [(f * 1000 * x) // d for x in v] as due, [(f * 1000 * x) % d for x in v] as rest
  from a, size, unnest(generate_series(0, cast((slots - 1) // 1000 as bigint))) t(f)
), ahead as (
  select *, cast(f * 1000 - list_sum(due) as bigint) as e, list_sort([struct_pack(b := (d - rest[i] + v[i] - 1) // v[i], i := i)
    for i in generate_series(1, len(v)) if rest[i] > 0]) as begun from f
), run(f, t, v, d, due, rest, u, pick) as (
  select f, 0, v, d, due, rest, [case when list_contains([x.i for x in begun[1:e]], i) then cast(1 as hugeint) else 0 end
    for i in generate_series(1, len(v))], cast(0 as bigint) from ahead
  union all
  select f, t + 1, v, d, due, rest, [case when i = now then u[i] + 1 else u[i] end for i in generate_series(1, len(v))], now
  from (
    select *, list_position(b, list_min(b)) as now from (
      select *, [case when u[i] * d < rest[i] + (t + 1) * v[i] then ((u[i] + 1) * d - rest[i] + v[i] - 1) // v[i] end
        for i in generate_series(1, len(v))] as b from run where t < 1000))
), ends as (
  select f, [u[i] + due[i] for i in generate_series(1, len(u))] as till from run where t = 1000
), within(f, t, v, d, due, rest, u, stop, pick, k) as (
  select f.f, 0, v, d, due, rest, [case when s.till is null then 0 else s.till[i] - due[i] end for i in generate_series(1, len(v))],
    [z.till[i] - due[i] for i in generate_series(1, len(v))], cast(0 as bigint), cast(0 as hugeint)
  from f join ends z on z.f = f.f left join ends s on s.f = f.f - 1
  union all
  select f, t + 1, v, d, due, rest, [case when i = now then u[i] + 1 else u[i] end for i in generate_series(1, len(v))], stop, now, u[now] + due[now]
  from (
    select *, list_position(b, list_min(b)) as now from (
      select *, [case when u[i] * d < rest[i] + (t + 1) * v[i] and u[i] < stop[i] then ((u[i] + 1) * d - rest[i] + v[i] - 1) // v[i] end
        for i in generate_series(1, len(v))] as b from within where t < 1000))
), tab as (
  select pick as pool, cast(k as bigint) as block, f * 1000 + t - 1 as slot from within, size where t > 0 and f * 1000 + t - 1 < slots
), most as (
  select pool, max(block) + 1 as blocks from tab group by pool
), r as (
  select doc_id, source, row_number() over (partition by source
    order by md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, ''))) - 1 as place from documents
), x as (
  select r.doc_id, r.source, w.pool, w.n, place, unnest(generate_series(0, (blocks * 8 - 1 - place) // n)) as epoch
  from r join w on r.source is not distinct from w.source join most on most.pool = w.pool where blocks * 8 > place
)
select x.doc_id, x.source, cast(epoch as bigint) as epoch, tab.block, cast(slot as bigint) as slot,
  cast(slot * 8 + (place + epoch * n) % 8 as bigint) as position
from x join tab on tab.pool = x.pool and tab.block = (place + epoch * n) // 8
"""


@query
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the token files, read back from them."""
    return write_token_files(table(spark, folder, "documents"), end_id=2).documents()


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learned from the labelled rows that are not held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = fold_of(F.col("doc_id"), 4)
    model = toxicity.fit(docs, labels.where(fold != 2))
    scored = docs.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query
def op6_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Five near neighbours by cosine of every fiftieth vector."""
    return multi_index.search(table(spark, folder, "embeddings"), every=50, k=5)


@query
def op7_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the runs of 13 words that start in an earlier one."""
    return repeated_words(table(spark, folder, "documents"), window=13, with_text=False)


ORACLES["op7_repeated_passages"] = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), win as (
  select doc_id, p, array_to_string(ws[p:p + 12], ' ') as k from w, unnest(generate_series(1, len(ws) - 12)) t(p)
), least_id as (
  select k, min(doc_id) as d from win group by k
), covered as (
  select distinct win.doc_id, p + o as i from win join least_id on win.k = least_id.k and d < doc_id, generate_series(0, 12) t(o)
), kept as (
  select w.doc_id, i, ws[i] as x from w, unnest(generate_series(1, len(ws))) t(i)
  where not exists (select 1 from covered c where c.doc_id = w.doc_id and c.i = t.i)
), joined as (
  select doc_id, count(*) as n, string_agg(x, ' ' order by i) as kept from kept group by doc_id
)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join joined on w.doc_id = joined.doc_id
"""


@query
def op8_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The near copies of every document: sets of three words, 85 hundredths alike."""
    return near_copies(table(spark, folder, "documents"), words=3, percent=85).drop("tie")


ORACLES["op8_near_copies"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[p:p + 2], ' ') as g from w, unnest(generate_series(1, greatest(len(ws) - 2, 1))) t(p)
  where len(ws) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), links as (
  select x, y from (
    select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
  ) p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)
), reached(a, b) as (
  select doc_id, doc_id from documents union select r.a, l.y from reached r join links l on r.b = l.x
), comp as (
  select a, min(b) as component_id from reached group by a
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, component_id, w.doc_id = component_id as kept
from w left join n on n.doc_id = w.doc_id join comp on comp.a = w.doc_id
"""


@query
def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return exact_topk.search(table(spark, folder, "embeddings"), every=50, k=5)


ORACLES["op9_exact_topk"] = """
with f as (
  select vec_id, row_number() over () as r, [cast(floor(256 * cast(x as double)) as double) for x in embedding] as w
  from embeddings where embedding is not null and vec_id is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), v as (
  select vec_id, r, list_resize(w, (select greatest(max(len(w)), 1) from f), 0) as w from f
), s as (
  select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % 50 = 0
), n as (
  select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from n where rank <= 5
"""


@query
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    fold = fold_of(F.col("doc_id"), 3)
    model = language.fit(docs.where(fold != 1))
    return docs.select(
        "doc_id", F.coalesce(fold == 1, F.lit(True)).alias("held_out"), model.column().alias("found")
    ).select("doc_id", "held_out", "found.*")


#: A word, to Java and to DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


def _with_runs(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten documents made periodic from some word on, as the contract of op11 asks."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(place, lambda i: F.get(words, i.cast("int"))), " "))

    altered = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), periodic)[0]  # finds the words once
    return F.when(h % 10 == 0, altered).otherwise(text)


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of at least 12 words of every document, one in ten made periodic first."""
    docs = table(spark, folder, "documents").select("doc_id", _with_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs, least=12, with_text=False)
    order = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))
    top = F.array_min(order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), (-top["col1"]).alias("length"),
        top["period"].alias("period"), F.floor(-1000 * top["col1"] / top["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.col("collapsed_sha256"),
    )


#: crc32 of a text of ASCII or Latin letters, by its definition, as DuckDB SQL.
CRC32 = """
  xor(list_reduce(list_prepend(cast(4294967295 as bigint), {bytes}), lambda c, b: list_reduce(
    [xor(c, b), 0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)
"""
DIGITS = "list_transform(string_split(cast(doc_id as varchar), ''), lambda d: cast(ascii(d) as bigint))"

ORACLES["op11_periodic_runs"] = rf"""
with h as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws, {CRC32.format(bytes=DIGITS)} as h from documents
), g as (
  select *, len(ws) as n, h // 10 as g, case when len(ws) > 0 then (h // 10) % len(ws) end as a from h
), p as (
  select *, 1 + (n - a) // (3 + g % 8) as p from g
), d as (
  select doc_id, n, case when h % 10 = 0 and n > 0 then
    list_transform(generate_series(0, n - 1), lambda i: ws[1 + case when i < a then i else a + (i - a) % p end]) else ws end as ws from p
), w as (
  select doc_id, i - 1 as i, ws[i] as x, n from d, unnest(generate_series(1, n)) t(i)
), same as (
  select u.doc_id, v.i - u.i as q, u.i from w u join w v on u.doc_id = v.doc_id and u.x = v.x and u.i < v.i and 2 * (v.i - u.i) <= u.n
), stretch as (
  select doc_id, q, min(i) as s, max(i) + 1 + q as e from (
    select *, i - row_number() over (partition by doc_id, q order by i) as part from same) group by doc_id, q, part
  having count(*) + q >= greatest(12, 2 * q)
), runs as (
  select doc_id, s, e, min(q) as q, e - s as l from stretch group by doc_id, s, e
), digest as (
  select doc_id, count(*) as n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q)) as runs_sha256,
    arg_min(struct_pack(s := s, l := l, q := q), struct_pack(l := -l, s := s, q := q)) as top from runs group by doc_id
), gone as (
  select distinct doc_id, i from runs, unnest(generate_series(s + q, e - 1)) t(i)
), kept as (
  select w.doc_id, string_agg(x, ' ' order by w.i) as kept from w anti join gone on w.doc_id = gone.doc_id and w.i = gone.i group by w.doc_id
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, top.s as start, top.l as length, top.q as period,
  1000 * top.l // top.q as exponent_milli, coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join digest on d.doc_id = digest.doc_id left join kept on d.doc_id = kept.doc_id
"""


def _occurrences(docs: DataFrame) -> DataFrame:
    """word: the Latin words of every document, some with a letter less, as the contract of op12 asks."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    run = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(r"[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    hashed = run.select("run", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % 199 == 0, less).otherwise(F.col("run")).alias("word"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of six letters and five occurrences with its near words, form and root."""
    docs = table(spark, folder, "documents")
    return spelling_variants(vocabulary(_occurrences(docs), least_length=6, least_count=5), ratio=5)


LETTERS = """flatten(list_transform(string_split(doc_id || ':' || run, ''),
  lambda d: case when unicode(d) < 128 then [cast(unicode(d) as bigint)] else [195, unicode(d) - 64] end))"""

ORACLES["op12_spelling_variants"] = rf"""
with recursive r as (
  select coalesce(cast(doc_id as varchar), '') as doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents
), d as (
  select doc_id, run, count(*) as n, {CRC32.format(bytes=LETTERS)} as h from r group by doc_id, run
), o as (
  select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from d
), v as (
  select word, cast(sum(n) as bigint) as n from o where length(word) >= 6 group by word having sum(n) >= 5
), cut as (
  select word, n, i, word[:i - 1] || word[i + 1:] as less from v, unnest(generate_series(1, length(word))) t(i)
), pair as (
  select a.word, b.word as near, b.n from cut a join cut b on a.less = b.less and a.i = b.i and a.word <> b.word
  union select cut.word, v.word, v.n from cut join v on cut.less = v.word
  union select v.word, cut.word, cut.n from cut join v on cut.less = v.word
), best as (
  select word, count(*) as n_near, arg_min(struct_pack(near := near, n := n), struct_pack(n := -n, near := near)) as best from pair group by word
), f as (
  select v.word, case when best.n >= 5 * v.n then best.near end as form, v.n, coalesce(n_near, 0) as n_near,
    case when best.n >= 5 * v.n then best.n end as form_n from v left join best on v.word = best.word
), chain(word, root) as (
  select word, word from f union all select chain.word, f.form from chain join f on chain.root = f.word where f.form is not null
), ends as (
  select chain.word, chain.root from chain join f on chain.root = f.word where f.form is null
)
select f.word, form, root, n, n_near, form_n from f join ends on f.word = ends.word
"""


@query
def op13_tokeniser_fertility(spark: SparkSession, folder: str) -> DataFrame:
    """The base counts of every document and whether its tokens lie within the bands of its script."""
    found = judged(table(spark, folder, "documents"))
    counts = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", "n_words", *counts, "base_failed", "kept", "outside", *MEASURES)
