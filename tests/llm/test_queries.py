"""Every registered query and every pipeline stage: against SQL, on odd tables and on empty ones."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, edited, prose
from threadloom.llm import edits, line_dedup, queries, token_files
from threadloom.llm.near_dedup import near_duplicates
from threadloom.llm.queries import tokenizer_path
from threadloom.llm.work import shared_dir

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op3_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op4_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op5_line_dedup": {"doc_id", "n_dropped"},
    "op6_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op8_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op11_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
}
ODD = DOCS + ", score double, lines string, text_hash long, _th int, _d int, _t int, label int, rep long"


def odd_rows():
    """Nulls, repeats, ties, a long text and columns whose names the operators use themselves."""
    rng = random.Random(17)
    line, text = prose(9, rng), "\n".join(prose(rng.randrange(3, 30), rng) for _ in range(6))
    texts = [(1, text), (1, text), (2, text), (3, edited(text, 1, rng)), (3, text + " more"), (4, None), (5, ""), (6, " \n\t\n"), (7, line), (None, line), (None, None), (8, prose(9000, rng)), (9, "\n".join([line] * 5))]
    return [(i, t, None if k % 4 == 0 else "en", None, None if t is None else len(t), 0.5, "x", 7, 1, 2, 3, 4, 5) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def _rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    found = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.collect(), df.columns) == _rows(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_a_row_for_all_that_it_judges(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    key, table = ("page_id", "pages") if name.startswith("op3") else ("doc_id", "documents")
    assert COLUMNS[name] <= set(df.columns)
    assert {r[0] for r in df.select(key).distinct().collect()} == {r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_take_empty_tables(spark, tmp_path, name):
    for table in ("documents", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def _bench(spark, folder, text):
    spark.createDataFrame([(1, text), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = odd_rows()
    _bench(spark, tmp_path, " ".join(rows[11][1].split()[100:130]))
    docs = spark.createDataFrame(rows, ODD)
    out = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "packing":
        tokens = {r["doc_id"] for r in out.collect()}
        assert tokens == {r[0] for r in rows}
        return
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    own = Counter((i, t) for i, t, *_ in rows)
    if name == "lines":
        assert sum(got.values()) == len(rows) and got[(None, rows[9][1])] == 1 and got[(9, "")] + got[(9, "\n" * 4)] == 1 and got[(2, "")] + sum(n for (i, t), n in got.items() if i == 2 and t) == 1
    elif name == "near_duplicates":
        texts = {}
        for i, t in own:
            texts.setdefault(i, []).append(t)
        kept = {r["doc_id"] for r in near_duplicates(docs).filter("kept").collect()} | {None}
        assert got == Counter({k: n for k, n in own.items() if k[0] in kept}) and 1 in kept and 2 not in kept
    elif name == "benchmark":
        assert got == Counter({k: n for k, n in own.items() if k[0] != 8})
    else:
        assert all(n == own[k] for k, n in got.items()) and not any(t is None or not t.strip() for _, t in got)


def test_pipeline_by_hand_on_a_small_table(spark, tmp_path):
    """The middle stages in plain Python: lines, near duplicates and leaks."""
    rng = random.Random(23)
    base = [[prose(rng.randrange(8, 30), rng) for _ in range(5)] for _ in range(12)]
    rows = [(k, "\n".join(x)) for k, x in enumerate(base)] + [(20 + k, "\n".join([base[k][0], prose(12, rng), edited(base[k][1], 1, rng)])) for k in range(6)]
    item = prose(25, rng)
    rows.append((40, prose(30, rng) + " " + item + " " + prose(20, rng)))
    _bench(spark, tmp_path, item)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.benchmark(spark, corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, docs, ""), ""), str(tmp_path)).collect()}
    seen, want = [], {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            plain = line_dedup.normalise(line)
            if not any(edits.similar(plain, other, 80) for other in seen):
                kept.append(line)
            seen.append(plain)
        want[i] = "\n".join(kept)
    assert out == {i: t for i, t in want.items() if i != 40}


def test_copies_that_repeat_an_id_with_other_texts_are_linked(spark):
    rng = random.Random(3)
    one, two, other = (prose(60, rng) for _ in range(3))
    rows = [(1, one), (1, other), (5, edited(other, 1, rng)), (7, edited(one, 1, rng)), (8, two)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 8: 8}


def test_token_files_refuse_ids_beyond_their_width(spark):
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    with pytest.raises(Exception, match="outside a vocabulary"):
        token_files.write_token_files(docs, shared_dir(spark), tokenizer_path(), end_id=70_000)


def test_recall_of_line_candidates_by_similarity_alone(spark):
    """All pairs of near lines of the table, whatever their blocks and SimHashes: nine in ten and more are linked."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    lines = sorted({x for t in texts for x in map(line_dedup.normalise, (t or "").split("\n")) if x.count(" ") >= 4})
    holders: dict = {}
    for k, line in enumerate(lines):
        words = line.split()
        for at in range(len(words) - 2):
            holders.setdefault(tuple(words[at : at + 3]), set()).add(k)
    pairs = {(a, b) for own in holders.values() if 1 < len(own) <= 60 for a in own for b in own if a < b}
    near = [(a, b) for a, b in pairs if edits.similar(lines[a], lines[b], 80)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r["doc_id"] for r in line_dedup.drop_repeated_lines(docs).filter(F.col("n_dropped") > 0).select("doc_id").collect()}
    # the first line of every pair stays or goes; the second goes where the pair's link is found
    found = sum(b in gone for _, b in near)
    assert len(near) > 200 and found >= 0.95 * len(near)


def test_shards_are_written_to_a_folder_each(spark):
    from threadloom.llm.sharding import assign_shards, write_shards

    rows = [(k, "x" * (k % 40)) for k in range(300)] + [(None, "y")]
    df, folder = spark.createDataFrame(rows, "doc_id long, text string"), shared_dir(spark)
    write_shards(df, folder, F.col("doc_id"), F.octet_length("text"), 900)
    found = spark.read.parquet(folder)
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter(rows)
    shards = assign_shards(df, F.col("doc_id"), F.octet_length("text"), 900).select("shard_depth", "shard_prefix").distinct().count()
    assert found.select("shard").distinct().count() == shards > 4
