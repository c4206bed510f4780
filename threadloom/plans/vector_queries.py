"""Retrieval and detection over vectors, and delivery of what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import vectors as V
from threadloom.operators import assemble, detect, ingest, retrieval, telemetry, vector_index
from threadloom.plans.registry import query
from threadloom.sources import tables as src
from threadloom.sources.scratch import save, scratch_folder

_DOT = "list_inner_product({a}::double[], {b}::double[])"
_COS = "round(list_inner_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_inner_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_inner_product(q.embedding::double[], q.embedding::double[]))), 6)"
_HAM = "len(list_filter(list_zip(e.embedding, q.embedding), lambda x: (x[1] >= 0) <> (x[2] >= 0)))"
_SCALE = "(list_max(list_transform(e.embedding, lambda x: abs(x)))::double / 127)"
_INT8 = f"round(list_inner_product(q.embedding::double[], list_transform(e.embedding, lambda x: greatest(least(round(x::double / {_SCALE}), 127), -128)::double)) * {_SCALE}, 6)"


#: The query set of all vector queries: every row whose id is divisible by 20.
ASKED = "q.vec_id % 20 = 0"


def _queries(spark, d) -> DataFrame:
    e = src.read(spark, d, "embeddings").filter("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


_TWO = f"""s as (select q.vec_id as query_id, e.vec_id, e.vec_id // 5 as message_id, {_INT8} as score from embeddings e, embeddings q
  where {ASKED} qualify rank() over (partition by q.vec_id order by {_HAM}) <= greatest(160, ceil(count(*) over (partition by q.vec_id) / 3)))"""


@query("search_topk", f"with {_TWO}, b as (select * from s qualify row_number() over (partition by query_id, message_id order by score desc, vec_id) = 1) select query_id, message_id, vec_id, score, row_number() over (partition by query_id order by score desc, message_id) as rank from b qualify rank <= 10")
def search_topk(spark, d):
    return retrieval.search(_queries(spark, d), src.vectors(spark, d), 10)


@query("search_enriched", f"with {_TWO}, b as (select * from s qualify row_number() over (partition by query_id, message_id order by score desc, vec_id) = 1), r as (select query_id, message_id, score, row_number() over (partition by query_id order by score desc, message_id) as rank from b qualify rank <= 10), m as (select doc_id as id, lang, left(text, 20) as text from documents where doc_id % 3 <> 0) select query_id, rank, message_id, m.text, case when lang is not null then 'in ' || lang end as thread_name from r left join m on m.id = message_id")
def search_enriched(spark, d):
    docs = src.read(spark, d, "documents").filter("doc_id % 3 <> 0")
    m = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("thread_id"), F.left("text", F.lit(20)).alias("text"))
    names = m.select("thread_id").distinct().withColumn("name", F.concat(F.lit("in "), "thread_id"))
    found = retrieval.search(_queries(spark, d), src.vectors(spark, d), 10)
    return retrieval.enriched(found, m, names).select("query_id", "rank", "message_id", "text", "thread_name")


@query("vec_hamming", f"select q.vec_id as query_id, e.vec_id, {_HAM}::int as distance, row_number() over (partition by q.vec_id order by {_HAM}, e.vec_id) as rank from embeddings e, embeddings q where {ASKED} qualify rank <= 64")
def vec_hamming(spark, d):
    return retrieval.closest_codes(_queries(spark, d), src.vectors(spark, d), 64)


@query("vec_int8_rerank", f"with {_TWO} select query_id, vec_id, score from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 64")
def vec_int8_rerank(spark, d):
    return retrieval.shortlisted(_queries(spark, d), src.vectors(spark, d), 64, 160).select("query_id", "vec_id", "score")


@query("vec_codes", f"select e.vec_id, round({_SCALE}, 9) as scale, round(list_sum(list_transform(list_zip(e.embedding, list_transform(e.embedding, lambda x: greatest(least(round(x::double / {_SCALE}), 127), -128))), lambda x: abs(x[1]::double - x[2]::double * {_SCALE}))), 6) as lost from embeddings e")
def vec_codes(spark, d):
    """What int8 codes lose: the sum of differences after decoding."""
    rows = src.vectors(spark, d).withColumn("scale", V.int8_scale("vector")).withColumn("code", V.int8_code("vector", "scale"))
    gaps = F.zip_with("vector", V.dequantise("code", "scale"), lambda x, y: F.abs(x.cast("double") - y))
    # in one select with the rounded scale, the lambda would take that one
    rows = rows.withColumn("lost", F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x))
    return rows.select("vec_id", F.round("scale", 9).alias("scale"), F.round("lost", 6).alias("lost"))


@query("vec_bounded_scores", f"select q.vec_id as query_id, e.vec_id, round(greatest(least(list_inner_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_inner_product(q.embedding::double[], q.embedding::double[])), 1.0), 0.0), 6) as score from embeddings e, embeddings q where {ASKED} and e.vec_id = q.vec_id + 1")
def vec_bounded_scores(spark, d):
    q = _queries(spark, d).withColumn("vec_id", F.col("query_id") + 1)
    rows = q.join(src.vectors(spark, d), "vec_id")
    return rows.select("query_id", "vec_id", F.round(V.bounded_score(V.dot("vector", "query_vector"), "query_vector"), 6).alias("score"))


def _knn(where: str, k: int = 10) -> str:
    return f"select q.vec_id as query_id, e.vec_id, {_COS} as score, row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id) as rank from embeddings e, embeddings q where {ASKED} and {where} qualify rank <= {k}"


@query("vec_knn_cosine", _knn("true"))
def vec_knn_cosine(spark, d):
    return retrieval.nearest(_queries(spark, d), src.vectors(spark, d), 10)


@query("index_knn", _knn("true"))
def index_knn(spark, d):
    """The nearest rows by the bucketed index, widened until nothing better can be left."""
    with scratch_folder(spark) as folder:
        index = vector_index.build(src.vectors(spark, d), folder=folder)
        return vector_index.nearest(index, _queries(spark, d), 10).select("query_id", "vec_id", "score", "rank")


@query("index_knn_thread", _knn("e.label = q.label and e.vec_id <> q.vec_id"))
def index_knn_thread(spark, d):
    """As above, with the predicate below the ranking."""
    with scratch_folder(spark) as folder:
        index = vector_index.build(src.vectors(spark, d), folder=folder)
        same = (F.col("thread_id"), F.col("query_label"))
        return vector_index.nearest(index, _queries(spark, d), 10, gone=retrieval.itself(), same=same).select("query_id", "vec_id", "score", "rank")


@query("index_search", f"with s as (select q.vec_id as query_id, e.vec_id // 5 as message_id, e.vec_id, {_COS} as score from embeddings e, embeddings q where {ASKED}), b as (select * from s qualify row_number() over (partition by query_id, message_id order by score desc, vec_id) = 1) select *, row_number() over (partition by query_id order by score desc, message_id) as rank from b qualify rank <= 10")
def index_search(spark, d):
    """The best messages of every query, each by its best chunk, from the index."""
    with scratch_folder(spark) as folder:
        index = vector_index.build(src.vectors(spark, d), folder=folder)
        return vector_index.nearest(index, _queries(spark, d), 10, of="message_id", tie="vec_id").select("query_id", "message_id", "vec_id", "score", "rank")


@query("index_probed")
def index_probed(spark, d):
    """The nearest rows among the eight nearest buckets; a test holds its recall."""
    with scratch_folder(spark) as folder:
        index = vector_index.build(src.vectors(spark, d), folder=folder)
        return vector_index.nearest(index, _queries(spark, d), 10, exact=False).select("query_id", "vec_id", "score", "rank")


@query("vec_knn_thread", _knn("e.label = q.label"))
def vec_knn_thread(spark, d):
    return retrieval.nearest(_queries(spark, d), src.vectors(spark, d), 10, same=(F.col("thread_id"), F.col("query_label")))


@query("vec_knn_exclude", _knn("e.vec_id % 20 <> 0 and e.vec_id // 5 <> q.vec_id // 5"))
def vec_knn_exclude(spark, d):
    own = (F.col("message_id"), F.array(F.expr("query_id div 5")))
    return retrieval.nearest(_queries(spark, d), src.vectors(spark, d).filter("vec_id % 20 <> 0"), 10, gone=own)


@query("vec_mean_pool", "select message_id, i as dim, round(avg(x), 6) as mean from (select vec_id // 5 as message_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by 1, 2")
def vec_mean_pool(spark, d):
    rows = retrieval.pooled(src.vectors(spark, d)).select("message_id", F.posexplode("vector").alias("dim", "x"))
    return rows.select("message_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("mean"))


@query("vec_recall", f"with {_TWO}, f as (select query_id, vec_id from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10), x as ({_knn('true')}) select x.query_id, count(f.vec_id) / 10 as recall from x left join f using (query_id, vec_id) group by 1")
def vec_recall(spark, d):
    q, v = _queries(spark, d), src.vectors(spark, d)
    found = retrieval.shortlisted(q, v, 10, 160)
    return retrieval.recall(retrieval.nearest(q, v, 10), found, 10)


@query("vec_best_per_message", f"with p as (select q.vec_id as event_id, e.vec_id // 5 as id, e.vec_id % 5 as chunk_index, {_COS} as score from embeddings e, embeddings q where {ASKED}), b as (select event_id, id, max(score) as score, arg_max(chunk_index, (score, -chunk_index)) as chunk_index from p group by 1, 2) select *, row_number() over (partition by event_id order by score desc, id) as rank from b qualify rank <= 20")
def vec_best_per_message(spark, d):
    rows = retrieval.closest(_queries(spark, d), src.vectors(spark, d), 20, of="message_id", tie="chunk_index")
    return rows.select(F.col("query_id").alias("event_id"), F.col("message_id").alias("id"), "score", "chunk_index", "rank")


_CAND = f"c as (select q.vec_id as event_id, e.vec_id as id, {_COS} as score from embeddings e, embeddings q where {ASKED} and e.vec_id <> q.vec_id qualify row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id) <= 64)"
_REFS = f"""{_CAND}, r as (select q.vec_id as event_id, e.vec_id, ((e.vec_id + 1 + q.vec_id * 1000003)::hugeint * 2654435761) % 4294967296 as k, e.embedding
  from embeddings e join embeddings q on {ASKED} and e.vec_id <> q.vec_id left join c on c.event_id = q.vec_id and c.id = e.vec_id where c.id is null),
d as (select event_id, vec_id, k::bigint as draw_key, embedding from r qualify row_number() over (partition by event_id order by k, vec_id) <= 64)"""


def _candidates(spark, d) -> DataFrame:
    rows = retrieval.nearest(_queries(spark, d), src.vectors(spark, d), 64, gone=retrieval.itself())
    return rows.select(F.col("query_id").alias("event_id"), F.col("vec_id").alias("id"), "score", (10 + F.col("vec_id") % 30).alias("tokens"))


def _draw(spark, d, candidates: DataFrame) -> DataFrame:
    """A noise floor never holds the event itself or what is tested against it."""
    events = _queries(spark, d).select(F.col("query_id").alias("event_id"), (F.col("query_id") * 1000003).alias("seed"))
    gone = candidates.select("event_id", F.col("id").alias("vec_id")).unionByName(events.select("event_id", F.col("event_id").alias("vec_id")))
    return retrieval.draw(src.vectors(spark, d).withColumn("row_no", F.col("vec_id") + 1), events, 64, gone)


@query("ref_draw", f"with {_REFS} select event_id, vec_id, draw_key from d")
def ref_draw(spark, d):
    return _draw(spark, d, _candidates(spark, d)).select("event_id", "vec_id", "draw_key")


def _references(spark, d, candidates: DataFrame) -> DataFrame:
    q = _queries(spark, d).select(F.col("query_id").alias("event_id"), "query_vector")
    return _draw(spark, d, candidates).join(q, "event_id").select("event_id", "vec_id", F.round(V.cosine("vector", "query_vector"), 6).alias("score"))


_FLOOR = f"{_REFS}, f as (select d.event_id, d.vec_id, " + _COS.replace("e.embedding", "d.embedding") + " as score from d join embeddings q on q.vec_id = d.event_id)"


@query("noise_floor", f"with {_FLOOR} select event_id, max(score) as top, min(score) as bottom, count(*) as n, count(*) >= 4 and max(score) - min(score) < 1e-9 as flat from f group by 1")
def noise_floor(spark, d):
    return detect.floor_stats(_references(spark, d, _candidates(spark, d)))


@query("detect_ranks", f"with {_FLOOR} select c.event_id, c.id, round((1 + count(*) filter (f.score >= c.score)) / 65.0::double, 9) as p, round(-log2((1 + count(*) filter (f.score >= c.score)) / 65.0::double), 6) as bits from c join f using (event_id) group by 1, 2")
def detect_ranks(spark, d):
    c = save(_candidates(spark, d))
    rows = detect.ranked_against(c, _references(spark, d, c))
    return rows.select("event_id", "id", F.round("p", 9).alias("p"), F.round("bits", 6).alias("bits"))


@query("detect_spread", f"with {_CAND} select event_id, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as deviation, count(*) as n_candidates from c group by 1")
def detect_spread(spark, d):
    rows = detect.spread(_candidates(spark, d))
    return rows.select("event_id", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "n_candidates")


_ACCEPT = f"""with {_FLOOR}, t as (select event_id, max(score) as top, count(*) as n from f group by 1),
w as (select event_id, stddev_pop(score) as dev from c group by 1),
b as (select c.event_id, c.id, c.score, 1 + 0.05 * (10 + c.id % 30) as bar, case when c.score > t.top then log2(t.n + 1) end as own,
  case when c.id % 3 = 0 then 2.0::double end as mb from c join t using (event_id) join w using (event_id) where dev >= 0.05),
s as (select *, case when own >= bar then own else 0 end + case when mb >= bar then mb else 0 end as bits from b)
select event_id, id, score, round(bits, 6) as bits, round(1 - pow(2.0::double, -bits), 6) as confidence from s where bits > 0"""


@query("detect_accept", _ACCEPT)
def detect_accept(spark, d):
    c = save(_candidates(spark, d))
    masses = c.filter("id % 3 = 0").select("event_id", "id", F.lit(2.0).alias("bits"))
    prices = c.select("event_id").distinct().withColumn("price", F.lit(0.05))
    out = detect.detect(c, _references(spark, d, c), masses, prices)
    return out.select("event_id", "id", "score", F.round("bits", 6).alias("bits"), F.round("confidence", 6).alias("confidence"))


def _selected(spark, d) -> DataFrame:
    v = src.vectors(spark, d).select(F.col("vec_id").alias("id"), "vector")
    q = _queries(spark, d).select(F.col("query_id").alias("event_id"), "query_vector")
    return _candidates(spark, d).join(v, "id").join(q, "event_id")


@query("mmr_rank")
def mmr_rank(spark, d):
    return assemble.mmr(_selected(spark, d)).withColumn("effective", F.round("effective", 6))


_SHED = f"""with {_CAND}, g as (select event_id, id::varchar as group_id, score, case when id % 3 = 0 then list_distinct([id, id - id % 9]) else [id] end as members from c),
each as (select event_id, group_id, score, unnest(members) as m from g),
dense as (select event_id, group_id, (case when score <= 0 then 0 when score >= 1 then 'infinity'::double else -log2(1 - score) end - 1) / sum(10 + m % 30) as density from each group by event_id, group_id, score),
placed as (select *, row_number() over (partition by event_id order by density, group_id) as place from dense),
lasting as (select event_id, m, max(place) as place from each join placed using (event_id, group_id) group by 1, 2),
sums as (select p.event_id, p.group_id, p.density, 35 + sum(10 + l.m % 30) as sent from placed p join lasting l on l.event_id = p.event_id and l.place >= p.place group by 1, 2, 3)
select event_id, group_id, sent <= 400 as kept, round(coalesce(max(case when sent > 400 then greatest(density, 0) end) over event, 0), 9) as price,
  coalesce(max(case when sent <= 400 then sent end) over event, 35)::bigint as tokens, false as too_large from sums window event as (partition by event_id)"""


@query("density_shed", _SHED)
def density_shed(spark, d):
    """Groups of one or two candidates, some of which share a member."""
    c = _candidates(spark, d)
    name = lambda x: x.cast("string")
    pair = F.when(F.col("id") % 3 == 0, F.array(name(F.col("id")), name(F.col("id") - F.col("id") % 9)))
    members = F.array_distinct(F.coalesce(pair, F.array(name(F.col("id")))))
    costs = F.transform(members, lambda m: 10 + m.cast("long") % 30)
    groups = c.select("event_id", name(F.col("id")).alias("group_id"), "score", members.alias("members"), costs.alias("costs"), F.lit(400).alias("budget"), F.lit(35).alias("fixed"))
    return assemble.density_shed(groups).withColumn("price", F.round("price", 9))


@query("lowest_surviving", f"with {_CAND} select event_id, arg_min(id, (score, id)) as id, min(score) as score from c where id % 4 <> 0 group by 1")
def lowest_surviving(spark, d):
    c = save(_candidates(spark, d))
    return assemble.lowest_surviving(c, c.filter("id % 4 = 0").select("event_id", "id"))


@query("merge_groups", "select event_id, array_to_string(list_sort(list_distinct(members)), ',') as members, array_to_string(list_sort(list(root_id)), ',') as root_ids, max(score) as score from (select conv_id // 10 as event_id, conv_id as root_id, [conv_id // 10, conv_id % 3] as members, turn / 10 as score from (select conv_id, max(turn) as turn from conversations group by 1)) group by 1, 2")
def merge_groups(spark, d):
    c = src.read(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    groups = c.select(F.expr("conv_id div 10").alias("event_id"), F.col("conv_id").alias("root_id"), F.array(F.expr("conv_id div 10"), F.col("conv_id") % 3).alias("members"), (F.col("turn") / 10).alias("score"))
    out = assemble.merge_groups(groups)
    return out.select("event_id", F.array_join("members", ",").alias("members"), F.array_join("root_ids", ",").alias("root_ids"), "score")


@query("max_sim", f"with t as (select q.vec_id // 40 as query_id, q.vec_id as token, e.vec_id // 5 as doc_id, {_DOT.format(a='e.embedding', b='q.embedding')} as s from embeddings e, embeddings q where {ASKED}), b as (select query_id, token, doc_id, max(s) as s from t group by 1, 2, 3), m as (select query_id, doc_id, round(sum(s), 6) as score from b group by 1, 2) select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from m qualify rank <= 20")
def max_sim(spark, d):
    q = _queries(spark, d).select(F.expr("query_id div 40").alias("query_id"), F.col("query_id").alias("token"), "query_vector")
    docs = src.vectors(spark, d).select(F.col("message_id").alias("doc_id"), "vector")
    rows = retrieval.max_sim(q, docs).withColumn("score", F.round("score", 6))
    return retrieval.best(rows, ["query_id"], [F.desc("score"), F.col("doc_id")], 20, "rank")


@query("eval_recall", f"with r as (select q.label::varchar as category, row_number() over (partition by q.vec_id order by {_COS} desc, e.vec_id) as rank, e.label = q.label as hit, q.vec_id from embeddings e, embeddings q where {ASKED} and e.vec_id <> q.vec_id), f as (select category, vec_id, min(rank) filter (hit) as rank from r group by 1, 2) select category, count(*) as n, " + ", ".join(f"round(avg(case when rank <= {k} then 1.0 else 0.0 end), 6) as recall_{k}" for k in (1, 5, 10)) + " from f group by rollup (category)")
def eval_recall(spark, d):
    q, v = _queries(spark, d), src.vectors(spark, d)
    ranks = retrieval.first_ranks(q, v, (F.col("thread_id"), F.col("query_label")), retrieval.itself())
    ranks = ranks.join(q.select("query_id", F.col("query_label").cast("string").alias("category")), "query_id")
    out = telemetry.ranking_summary(ranks)
    return out.select("category", "n", *[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 5, 10)])


_STAGES = f"""with one as (select q.vec_id as query_id, 1 + count(*) filter (where s.score > c.score or (s.score = c.score and s.vec_id < c.vec_id)) as stage_one
  from embeddings q join (select q.vec_id as query_id, e.vec_id, {_INT8} as score from embeddings e, embeddings q where {ASKED} and e.vec_id between q.vec_id + 1 and q.vec_id + 5) s on s.query_id = q.vec_id
  join (select q.vec_id as query_id, e.vec_id, {_INT8} as score from embeddings e, embeddings q where {ASKED} and e.vec_id = q.vec_id + 1) c on c.query_id = q.vec_id group by 1),
pool as (select q.vec_id as query_id, e.vec_id, {_COS} as near, {_INT8} as score, count(*) over (partition by q.vec_id) as n from embeddings e, embeddings q where {ASKED} and e.vec_id <> q.vec_id),
top as (select * from pool qualify row_number() over (partition by query_id order by near desc, vec_id) <= 64),
two as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from top)
select one.query_id, stage_one, coalesce(two.rank, (select max(n) from pool)) as stage_two from one left join two on two.query_id = one.query_id and two.vec_id = one.query_id + 1"""


@query("eval_stages", _STAGES)
def eval_stages(spark, d):
    """Rank of the right row (the next one) among five, and after retrieval from all and reranking."""
    q, v = _queries(spark, d), src.vectors(spark, d)
    near = q.withColumn("vec_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 5))).join(v, "vec_id")
    rerank = lambda rows: rows.withColumn("score", F.round(V.int8_score("query_vector", V.int8_code("vector", "scale"), "scale"), 6))
    five = rerank(near.withColumn("scale", V.int8_scale("vector"))).select("query_id", "vec_id", "score")
    one = telemetry.first_hits(five.filter("vec_id = query_id + 1"), five).withColumnRenamed("rank", "stage_one").filter("stage_one is not null")
    top = retrieval.nearest(q, v, 64, gone=retrieval.itself()).select("query_id", "vec_id").join(q, "query_id").join(v, "vec_id")
    top = rerank(top.withColumn("scale", V.int8_scale("vector"))).select("query_id", "vec_id", "score")
    two = telemetry.first_hits(top.filter("vec_id = query_id + 1"), top).withColumnRenamed("rank", "stage_two")
    size = v.agg((F.count("*") - 1).alias("n"))
    return one.join(two, "query_id", "left").crossJoin(F.broadcast(size)).select("query_id", "stage_one", F.coalesce("stage_two", "n").alias("stage_two"))


@query("vec_bytes", "select vec_id, len(embedding) * 4 as n_bytes, round(list_sum(embedding::double[]), 6) as total, embedding[1]::double as first from embeddings")
def vec_bytes(spark, d):
    rows = src.vectors(spark, d).withColumn("raw", V.encoded("vector"))
    back = rows.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), V.decoded("raw").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return back.select("vec_id", "n_bytes", F.round(total, 6).alias("total"), F.col("v")[0].cast("double").alias("first"))


@query("vec_put", "select vec_id // 5 as message_id, vec_id % 5 as chunk_index, case when vec_id % 3 = 0 then embedding[2] else embedding[1] end::double as first, 't' || (vec_id // 5 % 7) as thread_id from embeddings where vec_id % 3 = 0 or vec_id % 2 = 0")
def vec_put(spark, d):
    """Even vectors stored, every third put over them, twice; reads by one model at one width."""
    v = src.vectors(spark, d).withColumn("model_id", F.lit("m"))
    messages = v.select(F.col("message_id").alias("id"), F.concat(F.lit("t"), F.col("message_id") % 7).alias("thread_id"), F.lit("user").alias("role")).distinct()
    row = v.select("message_id", "chunk_index", "model_id", F.array(F.col("vector")[0]).alias("vector"), "vec_id")
    new = v.filter("vec_id % 3 = 0").select("message_id", "chunk_index", "model_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(9.0).cast("float").alias("x")), F.struct(F.lit(2).alias("seq"), F.col("vector")[1].alias("x")))).alias("n"))
    new = new.select("message_id", "chunk_index", "model_id", F.array("n.x").alias("vector"), "n.seq")
    empty = ingest.put_vectors(row.limit(0).drop("vec_id").withColumns({"thread_id": F.lit(""), "role": F.lit("")}), row.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "seq"), messages)
    kept = ingest.of_one_width(ingest.of_model(ingest.put_vectors(empty, new, messages), "m"), 1)
    return kept.select("message_id", "chunk_index", F.col("vector")[0].cast("double").alias("first"), "thread_id")


@query("chunk_keys", "select vec_id, vec_id // 5 as message, case when vec_id % 4 = 0 then 0 else vec_id % 5 end as part from embeddings")
def chunk_keys(spark, d):
    v = src.vectors(spark, d)
    key = F.when(F.col("vec_id") % 4 != 0, ingest.chunk_key(F.col("message_id"), F.col("chunk_index"))).when(F.col("vec_id") % 8 == 0, F.col("message_id").cast("string")).otherwise(F.concat(F.col("message_id"), F.lit("\0x")))
    message, part = ingest.key_parts(key)
    return v.select("vec_id", message.cast("long").alias("message"), part.cast("long").alias("part"))


@query("vec_wanted", "select vec_id from embeddings where vec_id // 5 in (select item_id from benchmark) and vec_id % 5 < 2")
def vec_wanted(spark, d):
    v = src.vectors(spark, d).withColumn("model_id", F.lit("m"))
    keys = src.read(spark, d, "benchmark").select(F.col("item_id").alias("message_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("chunk_index"), F.lit("m").alias("model_id"))
    return ingest.wanted(v, keys).select("vec_id")
