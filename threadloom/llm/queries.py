"""The ``opN_`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.decontaminate import leaks
from threadloom.llm.fingerprint import fingerprints
from threadloom.llm.langid import held_out, identify
from threadloom.llm.line_dedup import drop_repeated_lines
from threadloom.llm.near_dedup import near_duplicates
from threadloom.llm.packing import even_groups, pack
from threadloom.llm.phrases import collocations
from threadloom.llm.pii import personal_data
from threadloom.llm.sharding import assign_shards
from threadloom.llm.spelling import variants
from threadloom.llm.token_files import read_token_files, write_token_files
from threadloom.llm.url_filter import judge, page_labels
from threadloom.llm.warc import read_warc, write_warc
from threadloom.llm.work import save, scratch, shared_dir, text_or_empty

#: Rules of the URL filter: a host, a slash and the start of the path.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Small, so that tables of some megabytes are split to several depths.
SHARD_BYTES = 1 << 16


def tokenizer_path() -> str:
    """The vocabulary file of the token queries; every executor has it at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _alone(rows: Callable[[], DataFrame]) -> DataFrame:
    """The result as a table of its own; the working tables behind it go."""
    with scratch() as kept:
        out = save(rows())
        kept.append(out)
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alone(lambda: leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("bytes"))
    columns = ["doc_id", "n_bytes", "shard_depth", "shard_prefix", "shard_bytes", "oversized"]
    return _alone(lambda: assign_shards(sized, F.col("doc_id"), F.col("bytes"), SHARD_BYTES).select(columns))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the documents that they show; toxic is bad."""
    pages = _table(spark, sf_dir, "pages")

    def rows() -> DataFrame:
        labels = save(page_labels(pages.select("page_id", "html"), _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))
        return judge(pages.select("page_id", "url"), labels, URL_RULES)

    return _alone(rows)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_dropped", F.char_length(text_or_empty()).cast("long").alias("kept_chars"), F.sha2(text_or_empty(), 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_token_files(_table(spark, sf_dir, "documents").select("doc_id", "text"), folder, tokenizer_path(), end_id=1)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_warc(_table(spark, sf_dir, "pages"), shared_dir(spark), least=0)
    return read_warc(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), end_id=2)
    crc = F.crc32("ids").alias("ids_crc32")
    narrow = pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group", "length_no")
    return even_groups(save(narrow)).drop("length_no")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_sharding": op2_sharding,
    "op3_url_filter": op3_url_filter,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_warc": op7_warc,
    "op8_packing": op8_packing,
    "op9_near_dedup": op9_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_personal_data": op11_personal_data,
    "op12_collocations": op12_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The fewest prefix bits whose bucket fits the limit, found over all depths up to 40 bits.
_OP2 = f"""
with h as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash60
  from documents),
sums as (
  select d.depth, h.hash60 >> (60 - d.depth) as prefix, sum(h.n_bytes)::bigint as bytes
  from h, (select unnest(range(0, 41)) as depth) d group by 1, 2),
leaf as (
  select h.doc_id, h.n_bytes, h.hash60, min(s.depth) as depth
  from h, sums s
  where s.prefix = h.hash60 >> (60 - s.depth) and s.bytes <= {SHARD_BYTES} group by 1, 2, 3)
select l.doc_id, l.n_bytes, l.depth::int as shard_depth, s.prefix as shard_prefix, s.bytes as shard_bytes, false as oversized
from leaf l join sums s on s.depth = l.depth and s.prefix = l.hash60 >> (60 - l.depth)
"""

#: All exact containments; the query finds those that its signatures meet, which on small tables are all.
_OP1 = """
with words as (
  select 0 as kind, doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents
  union all
  select 1, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') from benchmark),
sizes as (select distinct least(len(w), 5) as size from words where kind = 1 and len(w) > 0),
grams as (
  select distinct kind, id, size, unnest(list_transform(range(1, greatest(len(w) - size + 1, 1) + 1), lambda i: array_to_string(w[i : i + size - 1], ' '))) as g
  from words, sizes where len(w) > 0 and (kind = 0 or least(len(w), 5) = size)),
items as (select id, count(*) as n from grams where kind = 1 group by 1),
hits as (select d.id as doc_id, i.id as item_id, count(*) as found from grams d join grams i on i.kind = 1 and d.kind = 0 and d.g = i.g and d.size = i.size group by 1, 2)
select doc_id, item_id, n::int as n_shingles, found::int as n_found, found / n as containment from hits join items on items.id = item_id where found * 100 >= n * 80
"""

_OP7 = """
with p as (select page_id, coalesce(html, '') as payload, min(page_id) over (partition by coalesce(html, '')) as first from pages),
h as (select *, sha1(payload) as hex from p)
select page_id, strlen(payload)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(hex, (i // 4)::int * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31))::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from h
"""

_OP9 = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then []::ubigint[] when len(w) < 4 then [hash(array_to_string(w, ' '))]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: hash(w[i], w[i + 1], w[i + 2], w[i + 3]))) end as shingles from w),
e as (select doc_id, len(shingles) as n, unnest(shingles) as g from s),
links as (select a.doc_id as u, b.doc_id as v from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.v from reach r join links l on l.u = r.other),
c as (select doc_id, min(other) as component_id from reach group by 1)
select doc_id, len(shingles)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c using (doc_id)
"""

#: All runs of one to five words, without the pruning that the query does.
_OP12 = """
with w as (
  select row_number() over () as piece, lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents)),
f as (
  select lang, size, phrase, count(*) as n
  from (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) as phrase from w, (select unnest(range(1, 6)) as size) where len(w) >= size)
  group by 1, 2, 3),
total as (select lang, sum(n) as n from f where size = 1 group by 1),
c as (select lang, size, phrase, n as a from f where size > 1 and n >= 100),
cuts as (
  select c.lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') as first, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') as rest
  from c, (select unnest(range(1, 5)) as k) where k < size),
scored as (
  select cuts.lang, cuts.phrase, a, k, x.n as l, y.n as r, t.n, (1000 * a::hugeint * t.n::hugeint) // (x.n::hugeint * y.n::hugeint) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = first join f y on y.lang = cuts.lang and y.phrase = rest join total t on t.lang = cuts.lang),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
held as (
  select low.* from low where not exists (
    select 1 from c where c.lang = low.lang and c.size > len(string_split(low.phrase, ' ')) and c.a >= low.a and contains(' ' || c.phrase || ' ', ' ' || low.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from held qualify rank <= 2000
"""

#: The checksum by its bits, and neighbours by what is left of a word without one letter.
_OP13 = """
with recursive bits as (
  select i as byte, 0 as step, i::bigint as v from range(0, 256) t(i)
  union all select byte, step + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where step < 8),
tab as (select list(v order by byte) as crc from bits where step = 8),
runs as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) as run from documents),
each as (select coalesce(doc_id::varchar, 'null') as id, run, count(*) as n, hex(encode(coalesce(doc_id::varchar, 'null') || ':' || run)) as hex from runs group by 1, 2),
sums as (
  select run, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(hex) // 2), lambda i: ('0x' || substr(hex, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) as h
  from each, tab),
spoilt as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from sums),
w as (select word, sum(n)::bigint as n from spoilt group by 1 having length(word) >= 7 and sum(n) >= 2),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from w, lateral (select unnest(range(1, length(word) + 1)) as i)),
near as (
  select a.word, b.word as other, b.n as other_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cut a join w b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join w b on a.rest = b.word),
best as (select word, count(*) as n_near, max(other_n) as top from near group by 1),
form as (select w.word, min(other) as form, top as form_n from w join best using (word) join near on near.word = w.word and other_n = top where top >= 10 * w.n group by 1, 3),
root(word, reached) as (select word, form from form union all select root.word, form.form from root join form on form.word = root.reached),
ends as (select word, reached as root from root where reached not in (select word from form))
select w.word, form, coalesce(root, w.word) as root, w.n, coalesce(n_near, 0)::bigint as n_near, form_n::bigint as form_n
from w left join best using (word) left join form using (word) left join ends using (word)
"""

ORACLES: dict[str, str] = {"op1_decontamination": _OP1, "op2_sharding": _OP2, "op7_warc": _OP7, "op9_near_dedup": _OP9, "op12_collocations": _OP12, "op13_spelling_variants": _OP13}
