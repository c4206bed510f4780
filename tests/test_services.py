"""Scorers and caches, prices in series, vectors kept up to date, documents, settings, seeds and errors."""

import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions import settings
from threadloom.functions import text as T
from threadloom.operators import documents, scoring, series
from threadloom.sources.scratch import shared_dir
from threadloom.streaming import streams, vector_log

PAIRS = "fingerprint string, chunk_no int, message_id string, chunk_index int, query_text string, text string"


def backwards(query, texts):
    """Answers from the last to the first."""
    return [(k, float(len(t))) for k, t in reversed(list(enumerate(texts)))]


def test_scores_align_by_index_and_no_pair_is_scored_twice(spark):
    rows = [("f", 0, f"m{k}", k % 3, "q", "x" * k) for k in range(70)]
    pairs, cache = spark.createDataFrame([*rows, rows[0], ("f", 1, "m", 0, "", "text"), ("f", 2, "m", 0, None, None)], PAIRS), shared_dir(spark)
    out, new = scoring.cached_scores(pairs, backwards, "len", cache)
    got = {(r["chunk_no"], r["message_id"]): r["score"] for r in out.collect()}
    assert new == 72 and out.count() == 73 and got == {(0, f"m{k}"): float(k) for k in range(70)} | {(1, "m"): 0.0, (2, "m"): 0.0}

    def nobody(query, texts):
        raise RuntimeError("asked again")

    again, new = scoring.cached_scores(pairs, nobody, "len", cache)
    assert new == 0 and {(r["chunk_no"], r["message_id"]): r["score"] for r in again.collect()} == got
    more = pairs.unionByName(spark.createDataFrame([("g", 0, "m", 0, "q", "four")], PAIRS))
    assert scoring.cached_scores(more, backwards, "len", cache)[1] == 1
    assert scoring.cached_scores(more, backwards, "other", cache)[1] == 73
    assert scoring.cached_scores(pairs.limit(0), nobody, "none", cache)[1] == 0


@pytest.mark.parametrize("hits", [[(0, 1.0)], [(0, 1.0), (0, 2.0)], [(0, 1.0), (2, 2.0)], [(-1, 1.0), (0, 1.0)]])
def test_a_scorer_that_answers_wrongly_is_an_error(hits):
    with pytest.raises(ValueError, match="the scorer returned"):
        scoring.aligned(hits, 2)


def test_a_scorer_that_answers_too_little_fails_the_job(spark):
    pairs = spark.createDataFrame([("f", 0, "a", 0, "q", "x"), ("f", 0, "b", 0, "q", "y")], PAIRS)
    with pytest.raises(Exception, match="the scorer returned"):
        scoring.scores(pairs, lambda q, texts: [], "m").collect()


def test_embedders_know_their_role_and_must_answer_all(spark):
    texts = spark.createDataFrame([("a",), (None,), ("ccc",)], "text string")
    out = scoring.embedded(texts, lambda role, xs: [[float(len(x)), float(role == "query")] for x in xs], "query", "m")
    assert sorted(tuple(r["vector"]) for r in out.collect()) == [(0.0, 1.0), (1.0, 1.0), (3.0, 1.0)] and out.first()["model_id"] == "m"
    for wrong in (lambda role, xs: [[1.0]], lambda role, xs: [[1.0] * (k + 1) for k in range(len(xs))]):
        with pytest.raises(Exception, match="the embedder returned"):
            scoring.embedded(texts.coalesce(1), wrong, "document", "m").collect()


def dear_when_cheap(batch):
    """Realises twice the price and one more; events divisible by 5 say nothing."""
    return batch.filter("event_id % 5 <> 0").select("event_id", (F.col("price") * 2 + 1).alias("price"))


def test_the_second_event_changes_because_of_the_first(spark):
    events = spark.createDataFrame([("t", 1, 1), ("t", 2, 2), ("t", 3, 3), ("u", 10, 1), ("u", 11, 1), ("v", 5, 1)], "thread_id string, event_id long, event_no long")
    start = spark.createDataFrame([("u", 4.0), ("idle", 9.0)], "thread_id string, price double")
    out, prices = series.in_series(events, dear_when_cheap, start)
    assert {r["event_id"]: (r["price"], r["realised"]) for r in out.collect()} == {1: (0.0, 1.0), 2: (1.0, 3.0), 3: (3.0, 7.0), 10: (4.0, None), 11: (4.0, 9.0), 5: (0.0, None)}
    assert {r["thread_id"]: r["price"] for r in prices.collect()} == {"t": 7.0, "u": 9.0, "v": 0.0, "idle": 9.0}
    none = series.in_series(events.limit(0), dear_when_cheap)
    assert none[0].count() == none[1].count() == 0


def test_prices_go_on_from_micro_batch_to_micro_batch(spark, tmp_path):
    rows = [("t", k, k) for k in (1, 2, 3)] + [("u", 6, 6)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "thread_id string, event_id long, event_no long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("thread_id string, event_id long, event_no long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    streams.priced(stream, dear_when_cheap, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(200)
    got = {r["event_id"]: (r["price"], r["realised"]) for r in spark.read.parquet(f"{tmp_path}/out/events").collect()}
    assert got == {1: (0.0, 1.0), 2: (1.0, 3.0), 3: (3.0, 7.0), 6: (0.0, 1.0)}


VECTORS = "message_id string, chunk_index int, model_id string, vector array<float>, seq long"


def _state(spark, folder, model=None):
    return {(r["message_id"], r["chunk_index"], r["model_id"]): (r["seq"], round(r["scale"] * 127, 3)) for r in vector_log.current(spark, folder, model).collect()}


def test_batches_replace_replay_and_survive_a_crash(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    folder = f"file://{tmp_path}/log"
    assert vector_log.current(spark, folder).count() == 0 and vector_log.compact(spark, folder) is None
    first = frame([("a", 0, "m", [1.0, 0.0], 1), ("a", 0, "m", [2.0, 0.0], 2), ("a", 1, "m", [3.0], 1), ("a", 0, "n", [4.0], 1), ("b", 0, "m", None, 1), ("b", 1, "m", [], 1)])
    assert vector_log.put(first, 0, folder)
    want = {("a", 0, "m"): (2, 2.0), ("a", 1, "m"): (1, 3.0), ("a", 0, "n"): (1, 4.0)}
    assert _state(spark, folder) == want
    # a batch that is run again, with other rows, changes nothing
    assert not vector_log.put(frame([("z", 0, "m", [9.0], 1)]), 0, folder) and _state(spark, folder) == want
    # a later batch wins whatever its seq; one without commit is not seen and is written anew
    assert vector_log.put(frame([("a", 0, "m", [5.0], 1)]), 1, folder)
    want[("a", 0, "m")] = (1, 5.0)
    frame([("lost", 0, "m", [7.0], 1)]).write.parquet(f"{folder}/data/batch=2")
    assert _state(spark, folder) == want
    assert vector_log.put(frame([("c", 0, "m", [6.0], 1)]), 2, folder)
    want[("c", 0, "m")] = (1, 6.0)
    assert _state(spark, folder) == want and vector_log.compact(spark, folder) == 2 and _state(spark, folder) == want
    assert not vector_log.put(frame([("z", 0, "m", [9.0], 1)]), 1, folder)
    assert vector_log.put(frame([("c", 0, "m", [8.0], 0)]), 3, folder) and _state(spark, folder, "n") == {("a", 0, "n"): (1, 4.0)}
    want[("c", 0, "m")] = (0, 8.0)
    assert _state(spark, folder) == want and vector_log.compact(spark, folder) == 3 and _state(spark, folder) == want


def test_a_stream_keeps_vectors_up_to_date(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", 0, "m", [float(k + 1)], 1), (f"b{k}", 0, "m", [1.0], 1)], VECTORS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(VECTORS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    folder = f"file://{tmp_path}/log"
    vector_log.merge_vectors(stream(), folder, f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(200)
    got = _state(spark, folder)
    assert got == {("a", 0, "m"): (1, 3.0), **{(f"b{k}", 0, "m"): (1, 1.0) for k in range(3)}} and vector_log.committed(spark, folder) == [0, 1, 2]
    # the same batches once more, from a lost checkpoint
    vector_log.merge_vectors(stream(), folder, f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination(200)
    assert _state(spark, folder) == got


def put_together(files, path, attrs, above):
    """A document read file by file."""
    if path in above:
        raise ValueError(f"circular include: {path}")
    if path not in files:
        raise ValueError(f"no such file: {path}")
    out = ""
    for line in (files[path] or "").removesuffix("\n").split("\n"):
        if line.startswith("//"):
            continue
        if m := re.match(r"^:([a-zA-Z0-9_-]+):\s*(.*)$", line):
            attrs[m[1]] = m[2]
        elif m := re.search(r"include::([^\[]+)\[\]", line):
            out += put_together(files, posixpath.normpath(posixpath.join(posixpath.dirname(path), m[1])), attrs, above | {path})
        else:
            out += re.sub(r"\{([a-zA-Z0-9_-]+)\}", lambda r: attrs.get(r[1], r[0]), line) + "\n"
    return out


def test_documents_equal_reading_file_by_file(spark):
    rng = random.Random(2)
    names = [f"{d}f{k}.adoc" for k in range(14) for d in ("", "a/", "a/b/")][:24]

    def line(k):
        kind = rng.randrange(7)
        if kind == 0 and k < 23:
            other = names[rng.randrange(k + 1, 24)] if rng.random() < 0.9 else rng.choice([names[0], "none.adoc"])
            return "see include::" + posixpath.relpath(other, posixpath.dirname(names[k]) or ".") + "[]"
        return rng.choice([":x: one", ":x:  {y} ", ":y-2: two", "// gone", "", "{x} and {y-2}{x} {no}", "{{x}}", "plain", "\u00e9 {x}"])

    files = {n: "\n".join(line(k) for _ in range(rng.randrange(0, 7))) + rng.choice(["", "\n", "\n\n"]) for k, n in enumerate(names)}
    files |= {"null.adoc": None, "c1": "include::c2[]", "c2": "x\ninclude::c1[]", "c3": ":x: 1\ninclude::none[]\ninclude::c1[]", "c4": "include::./c4[]\ninclude::none[]"}
    want = {}
    for n in [*names, "null.adoc", "c1", "c2", "c3", "c4", "absent.adoc", "./a/../" + names[0]]:
        try:
            want[n] = (put_together(files, posixpath.normpath(n), {}, frozenset()), None)
        except ValueError as e:
            want[n] = (None, str(e))
    out = documents.compiled(spark.createDataFrame(list(files.items()), "path string, text string"), spark.createDataFrame([(n,) for n in want], "entry string"))
    assert {r["entry"]: (r["text"], r["error"]) for r in out.collect()} == want
    assert sum(e is not None for _, e in want.values()) > 2
    assert documents.compiled(spark.createDataFrame([], "path string, text string"), spark.createDataFrame([], "entry string")).count() == 0


def test_settings_problems(spark):
    sound = '"min_batch_stddev":0.05,"local_context_size":4,"rerank_top_k":8,"context_budget_tokens":0,"budget_headroom_pct":1,"per_msg_delimiter_tokens":4'
    rows = {
        1: "{" + sound + "}",
        2: "{" + sound + ',"loss_ratio":1.01,"odd":null,"diversity_lambda":[]}',
        3: "{" + sound.replace('"rerank_top_k":8', '"rerank_top_k":"8"').replace('"local_context_size":4,', "") + "}",
        4: "{" + sound.replace("0.05", "-1").replace(":4,", ":0,") + "}",
        5: "[1]",
        6: None,
        7: "{",
        8: "{" + sound.replace('"per_msg_delimiter_tokens":4', '"per_msg_delimiter_tokens":4.5') + "}",
    }
    out = settings.problems(spark.createDataFrame(list(rows.items()), "id int, stored string"), "id", "stored")
    assert {tuple(r) for r in out.collect()} == {
        (2, "loss_ratio", "out of range"),
        (2, "odd", "unknown"),
        (3, "rerank_top_k", "wrong type"),
        (3, "local_context_size", "missing"),
        (4, "min_batch_stddev", "out of range"),
        (4, "local_context_size", "out of range"),
        (5, None, "not an object"),
        (6, None, "not an object"),
        (7, None, "not an object"),
        (8, "per_msg_delimiter_tokens", "wrong type"),
    }


def test_seeds_are_the_published_vectors(spark):
    known = {"": 0xCBF29CE484222325, "a": 0xAF63DC4C8601EC8C, "b": 0xAF63DF4C8601F1A5, "foobar": 0x85944171F73967E8}
    words = [*known, "\u00e9\U0001f600" * 30, None]
    got = {r["t"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", T.fnv1a(F.col("t")).alias("h")).collect()}
    assert {w: int(got[w]) for w in known} == known and got[None] is None
    h = 0xCBF29CE484222325
    for b in words[4].encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert int(got[words[4]]) == h


@pytest.mark.parametrize("wording", T.OVERFLOW)
def test_every_wording_of_an_overflow_counts(spark, wording):
    rows = [(f"Error: {wording.upper()} (4096)", True), (wording[:-1], any(p in wording[:-1] for p in T.OVERFLOW)), ("the context of this length is fine", False), (None, False)]
    out = spark.createDataFrame(rows, "e string, want boolean").select("want", T.is_overflow(F.col("e")).alias("got"))
    assert all(r["want"] == r["got"] for r in out.collect())


def _content(*blocks):
    return [{"kind": k, "text": t, "call_id": c} for k, t, c in blocks]


def test_a_batch_is_searchable_as_a_whole_or_not_at_all(spark, tmp_path):
    from threadloom.functions.blocks import CONTENT
    from threadloom.operators import store

    folder = f"file://{tmp_path}/store"
    say = lambda text: _content(("text", text, None))
    rows = [
        ("a", "t", "user", 1, say("alpha " * 30)),
        ("b", "t", "assistant", 2, _content(("tool_call", None, "k"))),
        ("c", "t", "tool", 3, _content(("tool_result", "found", "k"))),
        ("d", "t", "assistant", 4, _content(("text", "open", None), ("tool_call", None, "lone"))),
        ("e", "u", "tool", 1, _content(("tool_result", "no call here", "k"))),
        ("f", "u", "assistant", 2, _content(("tool_call", None, None))),
        ("g", "u", "user", 3, None),
    ]
    schema = f"id string, thread_id string, role string, position long, content {CONTENT}"
    frame = lambda rows: spark.createDataFrame([(*r[:4], r[4] and [tuple(b.get(n) for n in ("kind", "text", "call_id")) + (None,) * 9 for b in r[4]]) for r in rows], schema)
    embed = lambda role, texts: [[float(len(t)), 1.0] for t in texts]

    def broken(role, texts):
        raise RuntimeError("no service")

    with pytest.raises(Exception, match="no service"):
        store.put(frame(rows), 0, folder, broken, "m")
    assert store.stored(spark, folder, "messages") is None
    assert store.put(frame(rows), 0, folder, embed, "m", 60, 10)
    messages, chunks, vectors = (store.stored(spark, folder, t) for t in store.TABLES)
    assert {r["id"] for r in messages.collect()} == {"a", "b", "c", "g"}
    keys = {(r["id"], r["chunk_index"]) for r in chunks.collect()}
    assert keys == {(r["message_id"], r["chunk_index"]) for r in vectors.collect()} and sum(i == "a" for i, _ in keys) > 2
    assert not store.put(frame([("z", "t", "user", 9, say("z"))]), 0, folder, embed, "m")
    # the message that comes again has the chunks of its last batch alone
    assert store.put(frame([("a", "t", "user", 1, say("short"))]), 1, folder, embed, "m")
    assert [r["chunk_index"] for r in store.stored(spark, folder, "chunks").filter("id = 'a'").collect()] == [0]
    assert store.stored(spark, folder, "vectors").filter("message_id = 'a'").count() == 1 and store.stored(spark, folder, "messages").count() == 4
