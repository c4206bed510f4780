"""Queries over scorers, prices in series, settings, seeds and errors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from threadloom.functions import settings
from threadloom.functions import text as T
from threadloom.operators import documents, retrieval, scoring, series
from threadloom.plans.registry import query
from threadloom.plans.vector_queries import _COS, ASKED
from threadloom.sources import tables as src
from threadloom.sources.scratch import shared_dir

_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z]+'))"


@query("lexical_scores", f"""with m as (select conv_id, turn, text, {_WORDS.format("text")} as w from conversations)
select q.conv_id as fingerprint, q.turn as chunk_no, m.turn as message_id, 0 as chunk_index, round(case when len(q.w) = 0 then 0 else len(list_intersect(q.w, m.w)) / len(q.w) end, 9) as score, 'words' as scorer_model
from m q join m on m.conv_id = q.conv_id and m.turn = q.turn - 1""")
def lexical_scores(spark, d):
    """Every message scored against the one before it, by a scorer that the caller brings, through a cache."""
    m = src.read(spark, d, "conversations").select("conv_id", "turn", "text")
    before = m.select(F.col("conv_id").alias("fingerprint"), (F.col("turn") + 1).alias("chunk_no"), F.col("turn").alias("message_id"), F.lit(0).alias("chunk_index"), "text")
    pairs = m.select(F.col("conv_id").alias("fingerprint"), F.col("turn").alias("chunk_no"), F.col("text").alias("query_text")).join(before, ["fingerprint", "chunk_no"])
    out, _ = scoring.cached_scores(pairs, scoring.shared_words, "words", shared_dir(spark))
    return out.withColumn("score", F.round("score", 9))


BUDGET = 60
_SERIES = f"""with recursive c as (select q.vec_id as event_id, e.vec_id as id, {_COS} as score, 10 + e.vec_id % 30 as tokens from embeddings e, embeddings q where {ASKED} and e.vec_id <> q.vec_id qualify row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id) <= 16),
b as (select *, case when score >= 1 then 'infinity'::double when score <= 0 then 0 else -log2(1 - score) end as bits from c),
l as (select event_id, list({{'bits': bits, 'tokens': tokens, 'density': (bits - 1) / tokens}} order by (bits - 1) / tokens desc, id::varchar desc) as own from b group by 1),
ev as (select vec_id as event_id, label as thread_id, row_number() over (partition by label order by vec_id) as n, own from embeddings join l on event_id = vec_id),
s(thread_id, event_id, n, price, own) as (
  select thread_id, event_id, n, 0.0::double, list_filter(own, lambda x: x.bits >= 1) from ev where n = 1
  union all
  select ev.thread_id, ev.event_id, ev.n, p.realised, list_filter(ev.own, lambda x: x.bits >= 1 + p.realised * x.tokens)
  from (select thread_id, n, coalesce(greatest(list_max(list_transform(list_filter(range(1, len(own) + 1), lambda i: list_sum(list_transform(own[1:i], lambda x: x.tokens)) > {BUDGET}), lambda i: own[i].density)), 0), 0)::double as realised from s) p
  join ev on ev.thread_id = p.thread_id and ev.n = p.n + 1)
select thread_id, event_id, round(price, 9) as price,
  round(coalesce(greatest(list_max(list_transform(list_filter(range(1, len(own) + 1), lambda i: list_sum(list_transform(own[1:i], lambda x: x.tokens)) > {BUDGET}), lambda i: own[i].density)), 0), 0)::double, 9) as realised from s"""


@query("price_series", _SERIES)
def price_series(spark, d):
    """Events of a thread in order: each accepts what is worth the price that the one before realised, and sheds to a budget."""
    v = src.vectors(spark, d)
    asked = v.filter("vec_id % 20 = 0")
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = retrieval.nearest(queries, v, 16, gone=retrieval.itself()).select(F.col("query_id").alias("event_id"), F.col("vec_id").alias("id"), "score", (10 + F.col("vec_id") % 30).alias("tokens"))
    events = asked.select("thread_id", F.col("vec_id").alias("event_id"), F.col("vec_id").alias("event_no"))
    out = series.in_order(events.join(offers(found), "event_id", "left"), lambda price, event: realised(price, event["offers"], BUDGET))
    return out.select("thread_id", "event_id", F.round("price", 9).alias("price"), F.round(F.coalesce("realised", F.lit(0.0)), 9).alias("realised"))


LOSS_RATIO = 0.5


def offers(candidates):
    """Each event's candidates with their bits, the least dense first."""
    stance = -math.log2(1 - LOSS_RATIO)
    bits = F.when(F.col("score") >= 1, F.lit(float("inf"))).when(F.col("score") <= 0, 0.0).otherwise(-F.log2(1 - F.col("score")))
    rows = candidates.withColumn("bits", bits).withColumn("density", (F.col("bits") - stance) / F.greatest("tokens", F.lit(1)))
    one = F.struct("density", F.col("id").cast("string").alias("id"), "bits", F.col("tokens").cast("long").alias("tokens"))
    return rows.groupBy("event_id").agg(F.sort_array(F.collect_list(one)).alias("offers"))


def realised(price: float, offers, budget: int) -> float:
    """What an event realises: candidates worth their price, shed to the budget; see ``assemble.density_shed``."""
    stance, sent, most = -math.log2(1 - LOSS_RATIO), 0, 0.0
    for offer in reversed(offers if offers is not None else []):
        if offer["bits"] >= stance + price * offer["tokens"]:
            sent += offer["tokens"]
            if sent > budget:
                most = max(most, offer["density"])
    return most


_FNV = "list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::hugeint)), lambda s, b: (xor(s, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"


@query("context_seeds", f"select event_id, {_FNV}::varchar as seed from (select event_id, hex(encode(event_type || ':' || event_id || coalesce(props, ''))) as h from events)")
def context_seeds(spark, d):
    """The seed that a text of each event gives."""
    e = src.read(spark, d, "events")
    return e.select("event_id", T.fnv1a(F.concat("event_type", F.lit(":"), "event_id", F.coalesce("props", F.lit("")))).cast("string").alias("seed"))


_WORDINGS = ("Context window exceeds limit", "context length exceeded by 3", "the maximum context length is 8", "context_length_exceeded", "Prompt is too long", "input is too long", "requested tokens: 9", "exceeds the maximum of 4", "too many tokens", "context was lost", "length of the context", "rate limit")


@query("overflow_errors", "select event_id, " + " or ".join(f"contains(lower(e), '{p}')" for p in T.OVERFLOW) + " as overflow from (select event_id, event_type || ': ' || [" + ", ".join(f"'{w}'" for w in _WORDINGS) + f"][1 + event_id % {len(_WORDINGS)}] as e from events)")
def overflow_errors(spark, d):
    e = src.read(spark, d, "events")
    message = F.concat("event_type", F.lit(": "), F.get(F.lit(list(_WORDINGS)), (F.col("event_id") % len(_WORDINGS)).cast("int")))
    return e.select("event_id", T.is_overflow(message).alias("overflow"))


def _stored(event: str, value: str) -> str:
    """Settings of an event as SQL text that both engines read: sound ones, and by the event's number broken ones."""
    text = lambda x: f"cast({x} as string)"
    pieces = [
        f"case when {event} % 11 = 0 then '[1' else '{{' end",
        f"'\"loss_ratio\":' || case when {event} % 5 = 0 then '1.5' when {event} % 7 = 0 then '\"half\"' else '0.5' end",
        f"',\"min_batch_stddev\":' || {text(value)}",
        f"case when {event} % 3 = 0 then '' else ',\"local_context_size\":' || {text(f'{event} % 4')} end",
        f"',\"rerank_top_k\":' || case when {event} % 13 = 0 then '1.5' else '64' end",
        "',\"context_budget_tokens\":100,\"budget_headroom_pct\":0.25,\"per_msg_delimiter_tokens\":' || case when " + f"{event} % 2 = 0 then '4' else '-1' end",
        f"case when {event} % 17 = 0 then ',\"diversity_lambda\":1,\"other\":2' else '' end",
        "'}'",
    ]
    return " || ".join(pieces)


def _problem_sql() -> str:
    parts = ["select event_id, null as setting, 'not an object' as problem from s where not ok", "select event_id, k, 'unknown' from (select event_id, unnest(json_keys(j)) as k from s where ok) where k not in (" + ", ".join(f"'{s.key}'" for s in settings.ENGINE) + ", 'diversity_lambda')"]
    for s in settings.ENGINE:
        kinds = "'BIGINT', 'UBIGINT'" if s.whole else "'BIGINT', 'UBIGINT', 'DOUBLE'"
        kind, value = f"json_type(j, '$.{s.key}')", f"try_cast(j ->> '$.{s.key}' as double)"
        if s.required:
            parts.append(f"select event_id, '{s.key}', 'missing' from s where ok and not json_exists(j, '$.{s.key}')")
        outside = f"{value} < {s.least}" + ("" if s.most == math.inf else f" or {value} > {s.most}")
        parts.append(f"select event_id, '{s.key}', case when {kind} not in ({kinds}) then 'wrong type' else 'out of range' end from s where ok and json_exists(j, '$.{s.key}') and ({kind} not in ({kinds}) or {outside})")
    # a WITH whose broken texts never reach the JSON functions
    stored = _stored("event_id", "event_id - 3").replace(" as string)", " as varchar)")
    return f"with t as (select event_id, {stored} as raw from events), s as (select event_id, json_valid(raw) as ok, case when json_valid(raw) then raw::json end as j from t) " + " union all ".join(parts)


@query("settings_problems", _problem_sql())
def settings_problems(spark, d):
    """What is wrong with the settings that each event stores."""
    e = src.read(spark, d, "events").select("event_id", F.expr(_stored("event_id", "event_id - 3")).alias("stored"))
    return settings.problems(e, "event_id", "stored")


@query("compiled_documents", """select 'customer/' || c_custkey || '.adoc' as entry,
  case when c_custkey % 50 <> 0 then '{nation}?' || chr(10) || n_name || ' in ' || r_name || chr(10) || c_name || ' of ' || n_name || ', ' || r_name || '; {none}' || chr(10) || 'nowhere' || chr(10) end as text,
  case when c_custkey % 100 = 0 then 'circular include: customer/' || c_custkey || '.adoc' when c_custkey % 50 = 0 then 'no such file: gone.adoc' end as error
  from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def compiled_documents(spark, d):
    """Every customer's document, put together from its own file, its nation's and its region's."""
    files = src.files(spark, d)
    return documents.compiled(files, files.filter("path like 'customer/%'").select(F.col("path").alias("entry")))
