"""Queries over content blocks, protocol closure and delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import blocks as B
from threadloom.functions import stats as S
from threadloom.functions import text as T
from threadloom.operators import assemble, fold, ingest, tables, threads
from threadloom.plans.registry import query
from threadloom.plans.thread_queries import MSG
from threadloom.sources import tables as src

_C = f"""{MSG}, c as (select *, coalesce(text, '') as t, position % 7 <> 6 as has_text, position % 3 = 1 as thinks, position % 4 = 1 as has_call, position % 4 = 2 as has_result, position % 5 = 3 as has_file from messages)"""
_N = "chr(10)"
_HEAD = f"'[message role=' || role || ']' || {_N}"
_TEXT = f"case when has_text then '[text]' || {_N} || t || {_N} else '' end"
_THINK = f"case when thinks then '[thinking]' || {_N} || 'so ' || left(t, 20) || {_N} else '' end"
_CALL = f"""case when has_call then '[tool_call id=k' || position || ' name=lookup]' || {_N} || '{{"q":"' || position || '"}}' || {_N} else '' end"""
_RESULT = f"case when has_result then '[tool_result tool_call_id=k' || (position - 1) || ' error=' || (position % 8 = 2) || ']' || {_N} || left(t, 10) || {_N} else '' end"
_FILE = f"case when has_file then '[attachment filename=f' || position || ' mime_type=text/plain path=/a]' || {_N} || left(t, 5) || {_N} else '' end"
_SAID = f"case when has_text and t <> '' then '[text]' || {_N} || t || {_N} else '' end || {_THINK}"


@query("serialize_blocks", f"with {_C} select id, {_HEAD} || {_TEXT} || {_THINK} || {_CALL} || {_RESULT} || {_FILE} || '[/message]' || {_N} as stored, case when {_SAID} = '' then '' else {_HEAD} || {_SAID} || '[/message]' || {_N} end as asked from c")
def serialize_blocks(spark, d):
    rows = src.contents(spark, d)
    return rows.select("id", B.for_scoring(F.col("role"), F.col("content")).alias("stored"), B.for_query(F.col("role"), F.col("content")).alias("asked"))


_LINES = {
    "text": f"case when has_text then t || {_N} else '' end",
    "thinking": f"case when thinks then 'so ' || left(t, 20) || {_N} else '' end",
    "signed": f"case when thinks and position % 2 = 1 then 'so ' || left(t, 20) || {_N} else '' end",
    "call": f"""case when has_call then 'lookup: {{"q":"' || position || '"}}' || {_N} else '' end""",
    "result": f"case when has_result then left(t, 10) || {_N} else '' end",
    "file": f"case when has_file then '[attached: f' || position || ' at /a]' || {_N} || case when left(t, 5) <> '' then left(t, 5) || {_N} else '' end else '' end",
}


def _lines(*kinds: str) -> str:
    return " || ".join(_LINES[k] for k in kinds)


@query("count_projections", f"with {_C} select id, {_lines('text', 'signed', 'call', 'result')} as anthropic, {_lines('text', 'call', 'result')} as openai, {_lines('text', 'thinking', 'call', 'result')} as ollama, {_lines('text', 'thinking', 'call', 'result')} as genai, {_lines('text', 'thinking', 'call', 'result', 'file')} as everything from c")
def count_projections(spark, d):
    rows = src.contents(spark, d)
    return rows.select("id", *[B.counted_text(F.col("content"), p).alias(p) for p in B.SENT], B.plain_text(F.col("content")).alias("everything"))


@query("display_blocks", f"with {_C} select id, case when has_text then t else '' end as said, case when thinks then 'so ' || left(t, 20) else '' end as thought, has_call::int as n_calls, has_result::int as n_results, role as shown_role, (has_text and t <> '') or thinks as meaningful from c")
def display_blocks(spark, d):
    c = F.col("content")
    return src.contents(spark, d).select("id", B.shown(c).alias("said"), B.shown(c, "thinking").alias("thought"), F.size(B.calls(c)).alias("n_calls"), F.size(B.results(c)).alias("n_results"), B.role_name(F.col("role")).alias("shown_role"), B.has_meaning(c).alias("meaningful"))


_GROUPS = f"""with {_C}, r as (select thread_id as event_id, id as root_id, position, case when has_call then position + 1 when has_result then position - 1 end as other from c where position % 2 = 1 or has_result),
j as (select r.*, o.id as other_id from r left join c o on o.thread_id = r.event_id and o.position = r.other)
select event_id, root_id, case when other_id is null then root_id else array_to_string(list_sort([root_id, other_id]), ',') end as members, case when other is not null and other_id is null then 'missing' end as problem from j"""


@query("group_closure", _GROUPS)
def group_closure(spark, d):
    roots = src.messages(spark, d).filter("position % 2 = 1 or position % 4 = 2").select(F.col("thread_id").alias("event_id"), F.col("id").alias("root_id"), F.lit(0.9).alias("score"))
    out = threads.closed_groups(roots, src.blocks(spark, d))
    return out.select("event_id", "root_id", F.array_join("members", ",").alias("members"), "problem")


def _assembly(spark, d):
    m = src.contents(spark, d).withColumn("tokens", T.token_estimate(B.counted_text(F.col("content"), "openai")))
    last = threads.counts(m).select("thread_id", "max_position")
    m = m.join(last, "thread_id")
    event = F.col("thread_id").alias("event_id")
    local = m.filter("position >= max_position - 1").select(event, "id")
    selected = m.filter("position < max_position - 1").select(event, "id", (0.5 + F.col("position") % 5 / 10.5).alias("score"))
    budgets = last.select(event, F.lit(300).alias("budget"), F.lit(20).alias("fixed"))
    return selected, local, m, budgets


def _assembled(spark, d):
    selected, local, m, budgets = _assembly(spark, d)
    return assemble.assemble(selected, local, m, src.blocks(spark, d), budgets, delimiter=4)


@query("assemble_wire")
def assemble_wire(spark, d):
    """Every thread's last two messages and what fits of its earlier ones, each a candidate."""
    return _assembled(spark, d)[0]


@query("assemble_report")
def assemble_report(spark, d):
    return _assembled(spark, d)[1].withColumn("price", F.round("price", 6))


_CHAT = f"""with {_C}, atoms as (
  select thread_id as event_id, position, 0 as stage, role, case when has_text then t else '' end as text, case when thinks then 'so ' || left(t, 20) else '' end as thinking from c where has_text or thinks
  union all select thread_id, position, 1, 'assistant', '', '' from c where has_call
  union all select thread_id, position, 2, 'tool', left(t, 10), '' from c where has_result),
n as (select *, (stage = 0 and text <> '') or stage = 1 as speaks from atoms),
o as (select *, sum(speaks::int) over (partition by event_id order by position, stage) as turn from n),
h as (select event_id, turn + (not speaks)::int as turn, string_agg(thinking, chr(10) order by position) as thinking from o where thinking <> '' group by 1, 2),
r as (select k.event_id, k.turn, r.position, r.text, 'k' || k.position as call_id, k.position as asked from o r join o k on k.event_id = r.event_id and k.stage = 1 and k.position = r.position - 1 where r.stage = 2),
rows as (
  select o.event_id, o.turn, 0 as part, o.role, o.text, coalesce(h.thinking, '') as thinking, '' as call_ids, null as call_id, '' as arguments from o left join h using (event_id, turn) where stage = 0 and o.text <> ''
  union all select r.event_id, r.turn, 0, 'assistant', '', coalesce(h.thinking, ''), r.call_id, null, '{{"q":"' || asked || '"}}' from r left join h using (event_id, turn)
  union all select event_id, turn, 1, 'tool', text, '', '', call_id, '' from r)
select event_id, (row_number() over (partition by event_id order by turn, part) - 1)::int as message_no, role, text, thinking, call_ids, call_id, arguments from rows"""


def _chat(out):
    return out.withColumns({"call_ids": F.array_join("call_ids", ","), "arguments": F.array_join(F.transform("calls", lambda c: c["arguments"]), ",")}).drop("calls")


@query("canonical_wire", _CHAT)
def canonical_wire(spark, d):
    """Chat messages of whole threads."""
    rows = src.blocks(spark, d).withColumnsRenamed({"thread_id": "event_id", "position": "wire_no"})
    return _chat(assemble.canonical(rows))


@query("assemble_retry")
def assemble_retry(spark, d):
    """After an overflow: the same selection without the message of the lowest score, for every thread."""
    selected, local, m, budgets = _assembly(spark, d)
    gone = assemble.lowest_surviving(selected, selected.limit(0).select("event_id", "id"))
    return assemble.assemble(selected, local, m, src.blocks(spark, d), budgets, delimiter=4, excluded=gone.select("event_id", "id"))[0]


@query("assembled_chat")
def assembled_chat(spark, d):
    """Chat messages of what ``assemble_wire`` sends."""
    wire, _ = _assembled(spark, d)
    rows = wire.select("event_id", "wire_no", F.col("id").alias("message_id")).join(src.blocks(spark, d).drop("thread_id", "position"), "message_id")
    return _chat(assemble.canonical(rows))


_PARTS = """p as (select user_id as thread_id, 'd' || (day(ts) // 8) as turn_id, event_id as seq, event_type || event_id as text, coalesce(props, '') as arguments,
  case event_type when 'view' then 'text' when 'signup' then 'thinking' when 'click' then 'tool_call' when 'purchase' then 'tool_result' else 'error' end as kind,
  case when event_type = 'signup' and event_id % 4 = 0 then 's' || event_id else '' end as signature,
  case when event_type not in ('click', 'purchase') or event_id % 89 = 0 then '' else 'k' || (event_id % 5) end as call_id from events),
b as (select *, min(case when kind = 'tool_call' and call_id = '' then seq end) over (partition by thread_id, turn_id) as bad from p),
r as (select *, kind = 'tool_call' and call_id <> '' and row_number() over (partition by thread_id, turn_id, kind, call_id order by seq) = 1 as is_new from b where bad is null or seq <= bad),
g as (select *, coalesce(sum((is_new or (kind = 'thinking' and signature <> ''))::int) over (partition by thread_id, turn_id order by seq rows between unbounded preceding and 1 preceding), 0) as grp from r),
t as (select thread_id, turn_id, bool_or(bad is not null) as broken, arg_max(text, seq) filter (kind = 'error') as error, coalesce(string_agg(text, '' order by seq) filter (kind = 'text'), '') as said from r group by 1, 2),
h as (select thread_id, turn_id, grp, string_agg(text, '' order by seq) as thinking from g where kind = 'thinking' group by 1, 2, 3),
e as (select h.*, g.seq, case when g.kind = 'thinking' then g.signature else '' end as signature from h left join g on g.thread_id = h.thread_id and g.turn_id = h.turn_id and g.grp = h.grp and (g.is_new or (g.kind = 'thinking' and g.signature <> ''))),
k as (select g.thread_id, g.turn_id, g.seq, g.call_id, case when arguments = '' then '{}' else arguments end as arguments, (select min(x.seq) from r x where x.thread_id = g.thread_id and x.turn_id = g.turn_id and x.kind = 'tool_result' and x.call_id = g.call_id and x.seq > g.seq) as answer from g where is_new),
f as (select t.thread_id, t.turn_id, said, coalesce(thinking, '') as thinking from t left join e on e.thread_id = t.thread_id and e.turn_id = t.turn_id and e.seq is null where not broken and (said <> '' or thinking is not null))"""

_FOLDED = f"""with {_PARTS}, every as (
  select thread_id, turn_id, 0 as late, seq, 0 as sub, 'thinking' as kind, '' as text, thinking, signature, '' as call_id, '' as name, '' as arguments, false as is_error, false as open from e where seq is not null
  union all select thread_id, turn_id, 0, seq, 1, 'tool_call', '', '', '', call_id, 'f', arguments, false, broken and answer is null from k join t using (thread_id, turn_id)
  union all select k.thread_id, k.turn_id, 0, answer, 2, 'tool_result', p.text, '', '', k.call_id, '', '', false, false from k join p on p.seq = answer
  union all select thread_id, turn_id, 1, seq, 0, 'tool_result', case when error is null then 'Tool execution ended without a result.' else 'Tool execution failed: ' || error end, '', '', call_id, '', '', true, false from k join t using (thread_id, turn_id) where answer is null and not broken
  union all select thread_id, turn_id, 2, 0, 0, 'final', said, thinking, '', '', '', '', false, false from f),
numbered as (select *, row_number() over (partition by thread_id, turn_id order by late, seq, sub) as message_no from every)
select thread_id, turn_id, message_no, kind, text, thinking, signature, call_id, name, arguments, is_error from numbered where not open"""


@query("turn_messages", _FOLDED)
def turn_messages(spark, d):
    """Messages of turns, folded from events taken as parts of a model's reply."""
    return fold.fold(src.parts(spark, d))[0]


@query("turn_outcomes", f"with {_PARTS} select t.thread_id, t.turn_id, case when broken then 'call without id' when f.thread_id is not null then 'message' when error is not null then 'error: ' || error else 'no response' end as outcome from t left join f using (thread_id, turn_id)")
def turn_outcomes(spark, d):
    return fold.fold(src.parts(spark, d))[1]


@query("tool_schema_tokens", """select event_id, (strlen('{"type":"function","function":{"name":"' || event_type || '","description":"","parameters":' || case when coalesce(props, '') = '' then '{}' else props end || '}}') + 3) // 4 as tokens from events""")
def tool_schema_tokens(spark, d):
    e = src.read(spark, d, "events")
    return e.select("event_id", T.token_estimate(B.schema_text(F.col("event_type"), F.lit(""), F.col("props"))).alias("tokens"))


@query("call_arguments", "select event_id, case when event_id % 3 = 0 then event_type else json_extract_string(props, '$.k') end as value, case when event_id % 3 = 0 then 'raw' else 'k' end as key from events")
def call_arguments(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("props"))
    e = src.read(spark, d, "events").select("event_id", F.explode(B.call_arguments(raw)).alias("key", "value"))
    return e.select("event_id", "key", "value")


@query("closed_pairs", "select event_id from (select event_id, count(*) filter (event_type = 'click') over w as c, count(*) filter (event_type = 'purchase') over w as r from events where event_type in ('click', 'purchase') and value is not null window w as (partition by user_id, round(value)::bigint)) where c = 1 and r = 1")
def closed_pairs(spark, d):
    e = src.read(spark, d, "events").filter("event_type in ('click', 'purchase') and value is not null")
    kind = F.when(F.col("event_type") == "click", "tool_call").otherwise("tool_result")
    rows = e.select("event_id", F.col("user_id").alias("thread_id"), kind.alias("kind"), F.round("value").cast("long").alias("call_id"))
    return tables.closed_pairs(rows).select("event_id")


@query("replace_chunks", "with n as (select item_id as message_id, 0 as chunk_index, text from benchmark) select conv_id as message_id, turn as chunk_index, text from conversations where conv_id not in (select message_id from n) union all select * from n")
def replace_chunks(spark, d):
    old = src.read(spark, d, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").alias("chunk_index"), "text")
    new = src.read(spark, d, "benchmark").select(F.col("item_id").alias("message_id"), F.lit(0).cast("long").alias("chunk_index"), "text")
    return tables.replace_children(old, new, "message_id")


@query("chunk_lists", "select item_id as message_id, coalesce(list_count(list(turn)), 0)::int as n_chunks, coalesce(string_agg(text, '|' order by turn), '') as texts from (select distinct item_id from benchmark) left join conversations on conv_id = item_id group by 1".replace("coalesce(list_count(list(turn)), 0)::int", "count(turn)::int"))
def chunk_lists(spark, d):
    chunks = src.read(spark, d, "conversations").select(F.col("conv_id").alias("message_id"), F.col("turn").cast("int").alias("chunk_index"), "text")
    out = threads.chunks_of(chunks, src.read(spark, d, "benchmark").select(F.col("item_id").alias("id")))
    return out.select("message_id", F.size("chunks").alias("n_chunks"), F.array_join(F.transform("chunks", lambda c: c["text"]), "|").alias("texts"))


@query("thread_list", "select user_id as thread_id, min(ts) as created_at, array_to_string(list_sort(list(distinct event_type)), ',') as folders from events where user_id % 3 <> 0 group by 1")
def thread_list(spark, d):
    e = src.read(spark, d, "events")
    made = e.groupBy(F.col("user_id").alias("thread_id")).agg(F.min("ts").alias("created_at")).withColumn("archived", F.col("thread_id") % 3 == 0)
    out = threads.listed(made, e.select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("path")))
    return out.select("thread_id", "created_at", F.array_join("folders", ",").alias("folders"))


@query("recent_activity", "with l as (select user_id as thread_id, event_id as id, ts as created_at, left(props, 80) as summary from events qualify row_number() over (partition by user_id order by event_id desc) = 1) select * from l order by created_at desc, thread_id limit 20")
def recent_activity(spark, d):
    e = src.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("thread_id"), F.col("event_id").alias("position"), F.col("ts").alias("created_at"), F.col("props").alias("text"))
    return threads.recent_activity(e, 20)


@query("turn_with_peers", f"with {MSG}, w as (select id, thread_id, turn_id from messages where position % 5 = 0), p as (select m.id from messages m join (select distinct thread_id, turn_id from w where turn_id <> '') using (thread_id, turn_id)) select distinct id from (select id from w union all select id from p)")
def turn_with_peers(spark, d):
    m = src.messages(spark, d)
    return threads.with_counterparts(m, m.filter("position % 5 = 0")).select("id")


@query("budgets", "select event_id, case when h > 0 and h <= 1 then floor(b * h)::bigint else b end as effective, case when s > 0 then floor(b / s)::bigint else b end as counted from (select event_id, event_id % 5000 as b, (event_id % 8) / 4.0::double as h, (event_id % 5) / 2.0::double as s from events)")
def budgets(spark, d):
    e = src.read(spark, d, "events").select("event_id", (F.col("event_id") % 5000).alias("b"), (F.col("event_id") % 8 / F.lit(4.0)).alias("h"), (F.col("event_id") % 5 / F.lit(2.0)).alias("s"))
    return e.select("event_id", S.effective_budget(F.col("b"), F.col("h")).alias("effective"), S.counted_budget(F.col("b"), F.col("s")).alias("counted"))


@query("answer_logits", "select event_id, round(1 / (1 + exp(-value / 5)), 9) as alone, round(exp(value / 100) / (exp(value / 100) + exp(1.0)), 9) as against from events where value is not null")
def answer_logits(spark, d):
    e = src.read(spark, d, "events").filter("value is not null")
    return e.select("event_id", F.round(S.yes_share(F.col("value")), 9).alias("alone"), F.round(S.yes_share(F.col("value") / 100, F.lit(1.0)), 9).alias("against"))


@query("file_names", "select page_id, case when n = '' then '' else n end as file_name from (select page_id, ltrim(trim(replace(split_part(rtrim(url, '/'), '/', -1), chr(92), '')), '.') as n from pages where url is not null)")
def file_names(spark, d):
    return src.read(spark, d, "pages").filter("url is not null").select("page_id", T.safe_file_name(F.col("url")).alias("file_name"))


@query("stored_chunks")
def stored_chunks(spark, d):
    """What is stored of every message, in small chunks."""
    return ingest.chunked(src.contents(spark, d), 120, 20)
