"""Queries over the messages of threads, their edges and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import predicates as P
from threadloom.functions import text as T
from threadloom.operators import assemble, graph, tables, telemetry, threads
from threadloom.plans.registry import query
from threadloom.sources import tables as src

MSG = """messages as (
  select 'c' || conv_id || '-' || turn as id, conv_id as thread_id, turn as position, role, text,
         case when n = 0 then '' else conv_id || ':' || n end as turn_id
  from (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding)::bigint as n from conversations))"""
PROV = """edges as (
  select distinct 'c' || a.conv_id || '-' || b.turn as from_id, 'c' || a.conv_id || '-' || a.turn as to_id, 0.9::double as score,
         a.conv_id as thread_id, b.turn as from_position, a.turn as to_position
  from conversations a join conversations b on a.conv_id = b.conv_id
   and (b.turn = a.turn - 1 or b.turn = a.turn - 2 or (a.turn > 4 and b.turn = 0)))"""


@query("msg_recent_n", f"with {MSG} select id, thread_id, position from messages qualify row_number() over (partition by thread_id order by position desc, id) <= 3")
def msg_recent_n(spark, d):
    return threads.recent(src.messages(spark, d), 3).select("id", "thread_id", "position")


@query("msg_page", f"with {MSG} select id, thread_id, position, role from messages order by thread_id, position, id limit 50 offset 20")
def msg_page(spark, d):
    return threads.page(src.messages(spark, d), 50, 20).select("id", "thread_id", "position", "role")


@query("msg_count_maxpos", f"with {MSG} select thread_id, count(*) as n_messages, coalesce(max(position), -1) as max_position from messages group by 1")
def msg_count_maxpos(spark, d):
    return threads.counts(src.messages(spark, d))


@query("msg_turn_start", f"with {MSG} select id, position, case when turn_id = '' then position else min(position) over (partition by thread_id, turn_id) end as start_position from messages")
def msg_turn_start(spark, d):
    return threads.turn_start(src.messages(spark, d)).select("id", "position", "start_position")


@query("msg_preceding_turn", f"with {MSG}, t as (select thread_id, turn_id, max(position) as last_position from messages where turn_id <> '' group by 1, 2) select *, lag(turn_id) over (partition by thread_id order by last_position) as previous_turn from t")
def msg_preceding_turn(spark, d):
    return threads.preceding_turn(src.messages(spark, d))


@query("msg_latest_activity", f"with {MSG} select thread_id, id, position, left(text, 80) as summary from messages qualify row_number() over (partition by thread_id order by position desc) = 1")
def msg_latest_activity(spark, d):
    return threads.latest(src.messages(spark, d)).select("thread_id", "id", "position", F.left("text", F.lit(80)).alias("summary"))


_INFLIGHT = f"""with {MSG}, t as (select thread_id, turn_id, max(position) as p from messages where turn_id <> '' group by 1, 2),
top as (select thread_id, turn_id from t qualify row_number() over (partition by thread_id order by p desc) <= 2)
select m.id, m.thread_id, m.turn_id from messages m join top using (thread_id, turn_id)"""


@query("msg_in_flight", _INFLIGHT)
def msg_in_flight(spark, d):
    return threads.in_flight(src.messages(spark, d)).select("id", "thread_id", "turn_id")


_DISCOURSE = f"""with {MSG}, l as (select thread_id, arg_max(turn_id, position) as cur from messages group by 1),
s as (select m.thread_id, min(position) as start from messages m join l on l.thread_id = m.thread_id and m.turn_id = l.cur group by 1),
r as (select m.*, l.cur, s.start, row_number() over (partition by m.thread_id order by position desc) as k from messages m join l using (thread_id) join s using (thread_id))
select id, position from r where case when cur <> '' then position >= start else k <= 10 end"""


@query("msg_discourse", _DISCOURSE)
def msg_discourse(spark, d):
    return threads.discourse(src.messages(spark, d), 10).select("id", "position")


@query("msg_turn_peers", f"with {MSG}, q as (select distinct thread_id, turn_id from messages where thread_id % 20 = 0 and position = 1 and turn_id <> '') select m.id, m.turn_id from messages m join q using (thread_id, turn_id)")
def msg_turn_peers(spark, d):
    m = src.messages(spark, d)
    return threads.turn_peers(m, m.filter("thread_id % 20 = 0 and position = 1")).select("id", "turn_id")


_BRANCH = f"""with {MSG}, b as (select distinct thread_id, thread_id - 1 as parent_id, 2 as branch_position from messages where thread_id % 20 = 0 and thread_id > 0)
select b.thread_id as branch_id, m.id from messages m join b on m.thread_id = b.parent_id and m.position < b.branch_position
union all select b.thread_id, m.id from messages m join b on m.thread_id = b.thread_id"""


@query("branch_corpus", _BRANCH)
def branch_corpus(spark, d):
    m = src.messages(spark, d)
    b = m.filter("thread_id % 20 = 0 and thread_id > 0").select("thread_id", (F.col("thread_id") - 1).alias("parent_id"), F.lit(2).alias("branch_position")).distinct()
    return threads.branch_corpus(m, b).select("branch_id", "id")


@query("msg_semi_lookup", f"with {MSG} select id, role from messages where id in (select 'c' || (item_id * 3) || '-1' from benchmark)")
def msg_semi_lookup(spark, d):
    ids = src.read(spark, d, "benchmark").select(F.concat(F.lit("c"), F.col("item_id") * 3, F.lit("-1")).alias("id"))
    return src.messages(spark, d).join(ids, "id", "left_semi").select("id", "role")


@query("msg_global_chunk_index", f"with {MSG} select id, thread_id, row_number() over (partition by thread_id order by position) - 1 as chunk_no from messages where text <> ''")
def msg_global_chunk_index(spark, d):
    order = Window.partitionBy("thread_id").orderBy("position")
    return src.messages(spark, d).filter("text <> ''").select("id", "thread_id", (F.row_number().over(order) - 1).cast("long").alias("chunk_no"))


@query("pred_scope_exclude", f"with {MSG} select id, thread_id from messages where not (role = 'system') and (thread_id = 3 or thread_id = 7) and id not in ('c3-0', 'c7-1')")
def pred_scope_exclude(spark, d):
    p = P.And((P.Or((P.InThread(3), P.InThread(7))), P.Excluding(("c3-0", "c7-1"))))
    m = src.messages(spark, d)
    return P.apply(m, p, message="id").filter("role <> 'system'").select("id", "thread_id")


@query("pred_anti_exclude", f"with {MSG} select id from messages where id not in (select 'c' || item_id || '-0' from benchmark)")
def pred_anti_exclude(spark, d):
    gone = src.read(spark, d, "benchmark").select(F.concat(F.lit("c"), "item_id", F.lit("-0")).alias("id"))
    return P.apply(src.messages(spark, d), P.All(), gone, message="id").select("id")


@query("pred_metadata", "select event_id, coalesce(json_extract_string(props, '$.k'), '') = '3' as k_is_3, coalesce(json_extract_string(props, '$.none'), '') = '' as none_is_empty from events")
def pred_metadata(spark, d):
    e = src.read(spark, d, "events").withColumn("metadata", F.from_json("props", "map<string,string>"))
    return e.select("event_id", P.column(P.HasMetadata("k", "3")).alias("k_is_3"), P.column(P.HasMetadata("none", "")).alias("none_is_empty"))


@query("serialize_score_text", f"with {MSG} select id, '[' || upper(role) || '] ' || coalesce(text, '') as serialised from messages")
def serialize_score_text(spark, d):
    return src.messages(spark, d).select("id", T.serialised(F.col("role"), F.col("text")).alias("serialised"))


@query("token_estimate", "select doc_id, (strlen(coalesce(text, '')) + 3) // 4 as tokens from documents")
def token_estimate(spark, d):
    return src.read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("short_names", "select page_id, case when strlen(n) <= 60 then n when instr(substr(n, 31, 28), ' ') > 0 then left(n, 30 + 28 - instr(reverse(substr(n, 31, 28)), ' ')) || '...' else left(n, 57) || '...' end as short_name from (select page_id, replace(url, '/', ' ') || ' ' || replace(url, 'e', ' ') as n from pages)")
def short_names(spark, d):
    name = F.concat_ws(" ", F.replace("url", F.lit("/"), F.lit(" ")), F.replace("url", F.lit("e"), F.lit(" ")))
    return src.read(spark, d, "pages").select("page_id", F.when(F.col("url").isNotNull(), T.short_name(name)).alias("short_name"))


@query("context_fingerprint", f"with {MSG} select thread_id, sha256('v1|' || string_agg(id || '=' || coalesce(text, ''), '|' order by position)) as fingerprint from messages group by 1")
def context_fingerprint(spark, d):
    rows = src.messages(spark, d).groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("position", "id", F.coalesce("text", F.lit("")).alias("text")))).alias("w"))
    joined = F.array_join(F.transform("w", lambda x: F.concat(x["id"], F.lit("="), x["text"])), "|")
    return rows.select("thread_id", F.sha2(F.concat(F.lit("v1|"), joined), 256).alias("fingerprint"))


@query("chunk_split")
def chunk_split(spark, d):
    docs = src.read(spark, d, "documents")
    return T.chunks(docs.select(F.col("doc_id").alias("id"), "text"))


@query("chunk_join", "select e.vec_id // 5 as message_id, count(*) as n_chunks, min(d.source) as source from embeddings e join documents d on d.doc_id = e.vec_id // 5 group by 1")
def chunk_join(spark, d):
    docs = src.read(spark, d, "documents").select(F.col("doc_id").alias("message_id"), "source")
    return src.vectors(spark, d).select("message_id").join(docs, "message_id").groupBy("message_id").agg(F.count("*").alias("n_chunks"), F.min("source").alias("source"))


@query("tool_pairs", "select user_id as thread_id, round(value)::bigint as call_id, count(*) filter (event_type = 'click') as n_calls, count(*) filter (event_type = 'purchase') as n_results, min(event_id) filter (event_type = 'click') as call_message, min(event_id) filter (event_type = 'purchase') as result_message from events where event_type in ('click', 'purchase') and value is not null group by 1, 2")
def tool_pairs(spark, d):
    e = src.read(spark, d, "events").filter("value is not null")
    kind = F.when(F.col("event_type") == "click", "tool_call").when(F.col("event_type") == "purchase", "tool_result")
    blocks = e.select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("message_id"), kind.alias("kind"), F.round("value").cast("long").alias("call_id"))
    return threads.tool_pairs(blocks).drop("problem")


@query("prov_edges", f"with {PROV} select from_id, to_id, score, 4 as source from edges")
def prov_edges(spark, d):
    return src.provenance(spark, d).select("from_id", "to_id", "score", "source")


@query("prov_edge_count", f"with {PROV} select thread_id, count(*) as n_edges from edges group by 1")
def prov_edge_count(spark, d):
    return src.provenance(spark, d).filter("source = 4").groupBy("thread_id").agg(F.count("*").alias("n_edges"))


def _anchors(spark, d) -> DataFrame:
    m = threads.latest(src.messages(spark, d))
    return m.select(F.col("thread_id").alias("event_id"), "id")


_ANCHORS = "anchors as (select thread_id as event_id, max(position) as position, 'c' || thread_id || '-' || max(position) as id from messages group by 1)"
# a level at a time: all paths of a length to a message are one row, so that long threads stay linear
_LEVELS = """levels(event_id, id, best, hops) as (
  select event_id, id, 1.0::double, 0 from anchors
  union all select p.event_id, e.from_id, max(p.best * e.score), p.hops + 1 from levels p join edges e on e.to_id = p.id group by p.event_id, e.from_id, p.hops)"""
_REACH = "reach as (select event_id, id, max(best) as bound, min(hops) as hops, count(*) over (partition by event_id) as n from levels where hops > 0 group by 1, 2 qualify row_number() over (partition by event_id order by max(best) desc, id) <= 64)"
_SUMS = """sums(event_id, id, w, hops) as (
  select event_id, id, 1.0::double, 0 from anchors
  union all select p.event_id, e.from_id, sum(p.w * e.score), p.hops + 1 from sums p join edges e on e.to_id = p.id
    where (p.event_id, e.from_id) in (select (event_id, id) from reach) group by p.event_id, e.from_id, p.hops)"""
_WALK = f"with recursive {MSG}, {PROV}, {_ANCHORS}, {_LEVELS}, {_REACH}"


@query("prov_reach", f"{_WALK} select event_id, id, round(bound, 9) as bound, hops from reach")
def prov_reach(spark, d):
    out = graph.reach(src.provenance(spark, d), _anchors(spark, d))
    return out.select("event_id", "id", F.round("bound", 9).alias("bound"), "hops")


@query("prov_mass_paths", f"{_WALK}, {_SUMS} select event_id, id, round(sum(w), 6) as mass from sums where hops > 0 group by 1, 2")
def prov_mass_paths(spark, d):
    out = graph.mass(src.provenance(spark, d), _anchors(spark, d))
    return out.select("event_id", "id", F.round("mass", 6).alias("mass"))


_MASS = "m as (select event_id, id, round(sum(w), 9) as mass from sums where hops > 0 group by 1, 2)"


@query("mass_rank_bits", f"{_WALK}, {_SUMS}, {_MASS} select event_id, id, place, round(-log2(place / (n + 1)), 6) as bits from (select *, row_number() over (partition by event_id order by mass desc, id) as place, count(*) over (partition by event_id) as n from m)")
def mass_rank_bits(spark, d):
    masses = graph.mass(src.provenance(spark, d), _anchors(spark, d))
    return graph.mass_ranks(masses).select("event_id", "id", F.col("place").cast("long").alias("place"), F.round("bits", 6).alias("bits"))


def _scored_edges(spark, d):
    return src.provenance(spark, d).withColumns({"source": F.lit(1), "cross_encoder_score": F.col("score")})


@query("traverse_select", f"{_WALK} select event_id, id, round(max(best), 9) as score, min(hops) as hops from levels where hops > 0 and best >= 0.5 group by 1, 2")
def traverse_select(spark, d):
    return graph.traverse(_scored_edges(spark, d), _anchors(spark, d)).select("event_id", "id", F.round("score", 9).alias("score"), "hops")


@query("traverse_exclusions", f"{_WALK}, s as (select distinct event_id, id from levels where hops > 0 and best >= 0.95) select a.event_id, e.from_id as id, max(e.score) as score from anchors a join edges e on e.to_id = a.id left join s on s.event_id = a.event_id and s.id = e.from_id where s.id is null group by 1, 2")
def traverse_exclusions(spark, d):
    edges, a = _scored_edges(spark, d), _anchors(spark, d)
    return graph.unselected(edges, a, graph.traverse(edges, a, 0.95)).select("event_id", "id", "score")


@query("walk_exclusions", f"{_WALK} select event_id, id, round(max(best), 9) as score, 'below threshold' as reason from levels where hops > 0 group by 1, 2 having max(best) < 0.8")
def walk_exclusions(spark, d):
    """What edges of at least 0.8 lead to from a message still selected, but only by paths below 0.8."""
    edges, a = _scored_edges(spark, d), _anchors(spark, d)
    return graph.exclusions(edges, a, graph.walk(edges, a, 0.8), 0.8).select("event_id", "id", F.round("score", 9).alias("score"), "reason")


_HOPS = f"""{_WALK}, gates as (
  select *, case when (from_position + to_position) % 4 = 0 then 0.95 when from_position % 5 = 0 then 0.55 else 0.85 end::double as stored,
    case when to_position % 3 = 0 then 0.5 when from_position % 2 = 0 then 0.7 else 0.9 end::double as seen from edges),
gated(event_id, id, best, hops) as (
  select event_id, id, 1.0::double, 0 from anchors where event_id % 3 <> 1
  union all select event_id, from_id, max(best * w), hops + 1 from (
    select p.event_id, p.best, p.hops, e.from_id, case when p.hops = 0 then stored when p.event_id % 2 = 1 then seen when seen > 0.6 then (63 + p.event_id % 3) / (64 + p.event_id % 3)::double else 0 end as w
    from gated p join gates e on e.to_id = p.id where p.best >= 0.5) where w >= 0.5 group by event_id, from_id, hops),
walked as (select event_id, id, max(best) as score from gated where hops > 0 group by 1, 2)"""


def _gated(spark, d):
    """Edges with stored and raw scores, anchors, floors of every second thread, and scopes: own, another thread's, or none."""
    e = src.provenance(spark, d)
    f, t = F.col("from_position"), F.col("to_position")
    stored = F.when((f + t) % 4 == 0, 0.95).when(f % 5 == 0, 0.55).otherwise(0.85)
    seen = F.when(t % 3 == 0, 0.5).when(f % 2 == 0, 0.7).otherwise(0.9)
    edges = e.select("from_id", "to_id", stored.alias("score"), seen.alias("cross_encoder_score"), F.lit(1).alias("source"), F.col("thread_id").alias("from_thread"), F.col("thread_id").alias("to_thread"))
    a = _anchors(spark, d)
    event = F.col("event_id")
    floors = a.filter("event_id % 2 = 0").select(event, F.lit(0.6).alias("top"), (63 + event % 3).alias("n"))
    scopes = a.select(event, F.when(event % 3 == 0, event).when(event % 3 == 1, event + 1).alias("scope_thread"))
    return edges, a, floors, scopes


@query("gated_walk", f"{_HOPS} select event_id, id, round(score, 9) as score from walked where score >= 0.5")
def gated_walk(spark, d):
    """Later hops count by the event's floor, scopes hold the walk to a thread."""
    edges, a, floors, scopes = _gated(spark, d)
    return graph.traverse(edges, a, 0.5, floors, scopes).select("event_id", "id", F.round("score", 9).alias("score"))


@query("scope_exclusions", f"{_HOPS} select event_id, id, round(score, 9) as score, 'below threshold' as reason from walked where score < 0.5 union all select a.event_id, e.from_id, max(e.stored), 'unspecified' from anchors a join gates e on e.to_id = a.id where a.event_id % 3 = 1 group by 1, 2")
def scope_exclusions(spark, d):
    """What the walk reached too weakly, and direct dependencies that the scope rules out."""
    edges, a, floors, scopes = _gated(spark, d)
    walked = graph.walk(edges, a, 0.5, floors, scopes)
    return graph.exclusions(edges, a, walked, 0.5, scopes).select("event_id", "id", F.round("score", 9).alias("score"), "reason")


@query("reduced_links", f"""with recursive {MSG}, {PROV}, near as (select thread_id as event_id, to_id as id, from_id as needs from edges),
far(event_id, id, needs) as (select event_id, id, needs from near union select f.event_id, f.id, n.needs from far f join near n on n.event_id = f.event_id and n.id = f.needs)
select event_id, id, needs from near l where not exists (select 1 from near m join far f on f.event_id = m.event_id and f.id = m.needs and f.needs = l.needs where m.event_id = l.event_id and m.id = l.id)""")
def reduced_links(spark, d):
    """Dependencies of every thread's messages without those that others imply."""
    e = src.provenance(spark, d)
    return graph.reduced(e.select(F.col("thread_id").alias("event_id"), F.col("to_id").alias("id"), F.col("from_id").alias("needs")))


@query("contributor_edges", f"with {MSG}, k as (select *, max(position) over (partition by thread_id) as last from messages), w as (select thread_id, id, position, last, case when position >= last - 1 then 1.0::double when position % 3 <> 0 then position / 10.0::double end as score from k) select id as from_id, 'c' || thread_id || '-' || last as to_id, score from w where position < last and score > 0")
def contributor_edges(spark, d):
    m = src.messages(spark, d).withColumn("last", F.max("position").over(Window.partitionBy("thread_id")))
    rows = m.select(F.concat(F.lit("c"), "thread_id", F.lit("-"), "last").alias("anchor_id"), F.col("id").alias("message_id"), F.col("position").alias("seq"), "last")
    chosen = rows.filter("seq < last - 1").withColumn("weight", F.when(F.col("seq") % 3 != 0, F.col("seq") / 10).otherwise(0.0))
    edges = graph.provenance_edges(graph.contributors(rows.filter("seq >= last - 1"), chosen))
    return edges.select("from_id", "to_id", "score")


@query("stage_times", "with r as (select user_id as run_id, min(ts) as started, min(ts) filter (event_type = 'click') as first_at, max(ts) as ended from events group by 1) select run_id, greatest(epoch_us(coalesce(first_at, ended)) // 1000 - epoch_us(started) // 1000 - case when first_at is null then 0 else 60000 end, 0) as complete_ms, case when first_at is null then 0 else epoch_us(ended) // 1000 - epoch_us(first_at) // 1000 end as stream_ms from r")
def stage_times(spark, d):
    e = src.read(spark, d, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.min("ts").alias("started"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("first_at"), F.max("ts").alias("ended"))
    return telemetry.stage_times(runs.withColumn("assembly_ms", F.lit(60000))).select("run_id", "complete_ms", "stream_ms")


@query("edge_dedupe", "select user_id as from_id, round(value)::bigint % 7 as to_id, arg_max(event_id, event_id) as last_event, count(*) as n from events where value is not null group by 1, 2")
def edge_dedupe(spark, d):
    e = src.read(spark, d, "events").filter("value is not null").select(F.col("user_id").alias("from_id"), (F.round("value").cast("long") % 7).alias("to_id"), "event_id")
    n = e.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))
    last = tables.newest(e, ["from_id", "to_id"], F.col("event_id")).withColumnRenamed("event_id", "last_event")
    return last.join(n, ["from_id", "to_id"])


@query("fork_merge", f"with {PROV}, b as (select from_id, to_id, score from edges where from_position % 2 = 0), f as (select from_id, to_id, 0.1::double as score from edges where to_position % 3 = 0) select * from b union all select * from f anti join b using (from_id, to_id)")
def fork_merge(spark, d):
    """A base and a fork that share edges with other scores; the base's scores stay."""
    e = src.provenance(spark, d)
    base = e.filter("from_position % 2 = 0").select("from_id", "to_id", "source", "score")
    fork = e.filter("to_position % 3 = 0").select("from_id", "to_id", "source", F.lit(0.1).alias("score"))
    return tables.merge_fork(base, fork).select("from_id", "to_id", "score")


@query("upsert_scores", "select doc_id, case when toxic = 1 then 1.0 else quality::double end as score from labels union all select doc_id, 0.5 from documents where doc_id not in (select doc_id from labels)")
def upsert_scores(spark, d):
    base = src.read(spark, d, "documents").select("doc_id", F.lit(0.5).alias("score"))
    new = src.read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, 1.0).otherwise(F.col("quality").cast("double")).alias("score"))
    return tables.upsert(base, new, ["doc_id"])


@query("delete_cascade", f"with {MSG}, {PROV} select 'message' as kind, count(*) as n from messages where thread_id % 5 <> 0 union all select 'edge', count(*) from edges where thread_id % 5 <> 0")
def delete_cascade(spark, d):
    m = src.messages(spark, d)
    e = src.provenance(spark, d).withColumns({"from_thread": F.col("thread_id"), "to_thread": F.col("thread_id")})
    kept, edges = tables.delete_threads(m.filter("thread_id % 5 = 0").select("thread_id").distinct(), m, e)
    count = lambda x, k: x.groupBy().agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return count(kept, "message").unionByName(count(edges, "edge"))


@query("next_positions", f"with {MSG}, a as (select user_id % 200 as thread_id, event_id as seq from events where event_type = 'error') select a.thread_id, seq, coalesce((select max(position) from messages m where m.thread_id = a.thread_id), -1) + row_number() over (partition by a.thread_id order by seq) as position from a")
def next_positions(spark, d):
    a = src.read(spark, d, "events").filter("event_type = 'error'").select((F.col("user_id") % 200).alias("thread_id"), F.col("event_id").alias("seq"))
    return threads.next_positions(src.messages(spark, d), a).withColumn("position", F.col("position").cast("long"))


@query("tick_percentiles", "select event_type as stage, count(value) as n, " + ", ".join(f"list_sort(list(value))[floor((count(value) - 1) * {p})::int + 1] as p{round(p * 100)}" for p in (0.5, 0.9, 0.99)) + ", max(value) as max_ms from events where value is not null group by 1")
def tick_percentiles(spark, d):
    return telemetry.stage_percentiles(src.traces(spark, d).filter("ms is not null"))


@query("tick_recent", "select event_id as id, user_id as thread_id, event_type as stage from events order by event_id desc limit 25")
def tick_recent(spark, d):
    return src.traces(spark, d).orderBy(F.desc("id")).limit(25).select("id", "thread_id", "stage")


_RING = """with u as (select event_type as model, event_id as seq, value, 10 + event_id % 90 as predicted, event_id % 11 * 40 as budget from events where value > 0),
r as (select *, value / predicted as ratio from u where value / predicted between 0.5 and 3.0 and budget > 0 and predicted * 4 >= budget)
select model, seq, round(max(ratio) over (partition by model order by seq rows between 31 preceding and current row), 9) as scale from r"""


@query("token_scale_ring", _RING)
def token_scale_ring(spark, d):
    e = src.read(spark, d, "events").filter("value is not null")
    usage = e.select(F.col("event_type").alias("model"), F.col("event_id").alias("seq"), (10 + F.col("event_id") % 90).alias("predicted"), F.col("value").alias("observed"), (F.col("event_id") % 11 * 40).alias("budget"))
    return telemetry.token_scale(usage).select("model", "seq", F.round("scale", 9).alias("scale"))


@query("retry_totals", "select user_id as run_id, round(sum(value), 6) as ms, arg_max(event_id % 10, event_id) as selected_count, max(event_id) as attempts from events group by 1")
def retry_totals(spark, d):
    e = src.read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("value").alias("ms"), (F.col("event_id") % 10).alias("selected_count"), F.col("event_id").alias("attempt"))
    return telemetry.retries(e).withColumn("ms", F.round("ms", 6))


@query("citation_counts", "select u.label as id, count(distinct vec_id) as n_citations from (select vec_id, unnest([label, (label + 1) % 10]) as label from embeddings) u group by 1")
def citation_counts(spark, d):
    s = src.read(spark, d, "embeddings").select(F.col("vec_id").alias("event_id"), F.array(F.col("label"), (F.col("label") + 1) % 10).alias("selected"))
    return telemetry.citations(s)


_LIMITS = ("", "1m", "2h30m", "x", "-5s", "1.5h", "500ms")


@query("run_reconcile", """with s as (select user_id as thread_id, event_id, event_type, case event_id % 7 when 0 then '' when 1 then '1m' when 2 then '2h30m' when 3 then 'x' when 4 then '-5s' when 5 then '1.5h' else '500ms' end as l,
  case event_id % 7 when 1 then 60.0 when 2 then 9000.0 when 4 then -5.0 when 5 then 5400.0 when 6 then 0.5 end::double as total, value * 60 as elapsed from events where event_type <> 'view'),
r as (select *, case when event_type = 'error' then 'non-autonomous' when event_type = 'click' then 'paused' when l = '' then 'no duration_limit' when elapsed is null then 'no started_at' when total is null then 'unparseable duration_limit=' || l
  when total <= 0 then 'non-positive duration_limit=' || l when total - elapsed <= 0 then 'budget expired' end as reason from s)
select thread_id, event_id, reason, case when reason is null then 'resume' else 'idle' end as action, case when reason is null then round(greatest(total - elapsed, 300.0), 6) end as left_seconds from r""")
def run_reconcile(spark, d):
    e = src.read(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "idle").when(F.col("event_type") == "click", "paused").otherwise("running")
    limit = F.element_at(F.array(*map(F.lit, _LIMITS)), (F.col("event_id") % 7 + 1).cast("int"))
    s = e.select(F.col("user_id").alias("thread_id"), "event_id", status.alias("status"), F.when(F.col("event_type") == "error", "chat").otherwise("autonomous").alias("mode"), limit.alias("duration_limit"), (F.col("value") * 60).alias("elapsed_seconds"))
    return telemetry.reconcile(s).select("thread_id", "event_id", "reason", "action", F.round("left_seconds", 6).alias("left_seconds"))


_TRIM = f"""with {MSG}, w as (select thread_id as event_id, id, position, role, (strlen(coalesce(text, '')) + 3) // 4 as tokens,
  position = max(position) over (partition by thread_id) or (role in ('user', 'assistant') and position = max(position) over (partition by thread_id, role)) as pinned from messages),
s as (select *, sum(case when pinned then tokens else 0 end) over (partition by event_id) as pt, sum(case when pinned then 0 else tokens end) over (partition by event_id order by position desc, id desc rows unbounded preceding) as nt from w)
select event_id, id, pinned, pinned or pt + nt <= 200 as kept from s"""


@query("assemble_trim", _TRIM)
def assemble_trim(spark, d):
    m = src.messages(spark, d).select(F.col("thread_id").alias("event_id"), "id", "position", "role", T.token_estimate(F.col("text")).alias("tokens"), F.lit(200).alias("budget"))
    return assemble.trim_oldest(assemble.pins(m)).select("event_id", "id", "pinned", "kept")
