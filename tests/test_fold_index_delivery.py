"""Event folding, the vector index, shedding, chat messages and mass against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.operators import assemble, fold, graph, retrieval, vector_index
from threadloom.operators.running import suffix_sums
from threadloom.sources import tables as src
from threadloom.streaming import streams


def test_suffix_sums_of_one_large_key_and_many_small_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(5), k, rng.choice([None, 1, 2, 7])) for k in range(500)]
    df = spark.createDataFrame(rows, "key long, a int, b int, v int")
    want = Counter((k, b, sum(w or 0 for k2, a2, b2, w in rows if k2 == k and (a2, b2) >= (a, b))) for k, a, b, _ in rows)
    assert Counter((r["key"], r["b"], r["s"]) for r in suffix_sums(df, "key", ["a", "b"], "v", "s").collect()) == want


def shed_one_by_one(groups, stance):
    """One event: the least dense group goes and the total is worked out anew, until it fits."""
    budget, fixed = groups[0]["budget"], groups[0]["fixed"]
    bits = lambda s: 0.0 if s <= 0 else math.inf if s >= 1 else -math.log2(1 - s)
    density = {g["group_id"]: (bits(g["score"]) - stance) / max(sum(g["costs"]), 1) for g in groups}
    alive, price = list(groups), 0.0
    while True:
        total = fixed + sum({m: c for g in alive for m, c in zip(g["members"], g["costs"])}.values())
        if budget <= 0 or total <= budget or not alive:
            kept = {g["group_id"] for g in alive}
            return {(g["group_id"], g["group_id"] in kept, round(price, 9), total, 0 < budget < total) for g in groups}
        worst = min(alive, key=lambda g: (density[g["group_id"]], g["position"], g["group_id"]))
        alive.remove(worst)
        price = max(price, density[worst["group_id"]])


@pytest.mark.parametrize("shared", [False, True])
def test_shedding_equals_dropping_one_by_one(spark, shared):
    rng = random.Random(shared)
    rows = []
    for event in range(25):
        cost = [rng.randrange(0, 40) for _ in range(60)]
        fixed, budget = rng.randrange(60), rng.choice([0, 10, 60, 150, 400])
        for g in range(rng.randrange(1, 18)):
            members = rng.sample(range(20), rng.randrange(1, 4)) if shared else [20 + g]
            rows.append({"event_id": event, "group_id": f"g{g}", "score": rng.choice([-0.1, 0.0, 0.3, 0.6, 0.6, 0.97, 1.0]), "members": [str(m) for m in members], "costs": [cost[m] for m in members], "budget": budget, "fixed": fixed, "position": rng.randrange(3)})
    df = spark.createDataFrame(rows, "event_id long, group_id string, score double, members array<string>, costs array<int>, budget long, fixed long, position long")
    got = defaultdict(set)
    for r in assemble.density_shed(df, 1.0).collect():
        got[r["event_id"]].add((r["group_id"], r["kept"], round(r["price"], 9), r["tokens"], r["too_large"]))
    assert got == {e: shed_one_by_one([r for r in rows if r["event_id"] == e], 1.0) for e in range(25)}


MESSAGES = "id string, thread_id string, position long, tokens long"
BLOCKS = "message_id string, thread_id string, role string, position long, block_no int, kind string, call_id string"


def test_a_selected_id_without_message_is_a_problem_of_its_event(spark):
    messages = spark.createDataFrame([("a", "t", 1, 5), ("b", "t", 2, 5), ("z", "t", 9, 5)], MESSAGES)
    blocks = spark.createDataFrame([(m, "t", "user", p, 0, "text", None) for m, p in (("a", 1), ("b", 2), ("z", 9))], BLOCKS)
    selected = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.9), (2, "lost", 0.8), (3, "b", 0.9)], "event_id long, id string, score double")
    local = spark.createDataFrame([(1, "z"), (2, "z"), (3, "gone")], "event_id long, id string")
    budgets = spark.createDataFrame([(1, 100, 0), (2, 100, 0), (3, 100, 0)], "event_id long, budget long, fixed long")
    wire, report = assemble.assemble(selected, local, messages, blocks, budgets)
    assert {r["event_id"]: r["outcome"] for r in report.collect()} == {1: "ok", 2: "missing content", 3: "missing content"}
    assert {(r["event_id"], r["id"]) for r in wire.collect()} == {(1, "a"), (1, "z")}


def test_echoes_of_any_message_that_asks_are_discounted(spark):
    rows = [(1, "echo", 0.9, [0.0, 1.0], [[1.0, 0.0], [0.0, 1.0]]), (1, "new", 0.5, [0.6, 0.6], [[1.0, 0.0], [0.0, 1.0]]), (1, "blank", 0.4, None, [[1.0, 0.0], [0.0, 1.0]])]
    out = assemble.mmr(spark.createDataFrame(rows, "event_id long, id string, score double, vector array<double>, query_vectors array<array<double>>"))
    got = {r["id"]: (r["place"], round(r["effective"], 6)) for r in out.collect()}
    assert got == {"blank": (1, 0.4), "new": (2, round(0.5 * (1 - math.sqrt(0.5)), 6)), "echo": (3, 0.0)}


CHAT = "event_id long, wire_no int, block_no int, role string, kind string, text string, call_id string, name string, arguments string"


def test_chat_keeps_names_and_arguments_and_drops_what_has_no_counterpart(spark):
    rows = [
        (1, 0, 0, "assistant", "thinking", "one", None, None, None),
        (1, 1, 0, "assistant", "tool_call", None, "a", "find", '{"q":1}'),
        (1, 1, 1, "assistant", "tool_call", None, "lone", "find", "{}"),
        (1, 2, 0, "assistant", "tool_call", None, "b", "read", "{}"),
        (1, 3, 0, "user", "text", "meanwhile", None, None, None),
        (1, 4, 0, "tool", "tool_result", "B", "b", None, None),
        (1, 4, 1, "tool", "tool_result", "A", "a", None, None),
        (1, 4, 2, "tool", "tool_result", "orphan", "x", None, None),
        (1, 5, 0, "assistant", "thinking", "two", None, None, None),
        (1, 6, 0, "assistant", "tool_call", None, "late", "f", "{}"),
        (1, 7, 0, "assistant", "text", "end", None, None, None),
        (1, 7, 1, "assistant", "thinking", "three", None, None, None),
        (1, 8, 0, "assistant", "thinking", "never", None, None, None),
        (2, 0, 0, "tool", "tool_result", "first", "c", None, None),
        (2, 1, 0, "assistant", "tool_call", None, "c", "f", "{}"),
        (2, 2, 0, "user", "attachment", "x", None, None, None),
    ]
    out = assemble.canonical(spark.createDataFrame(rows, CHAT))
    got = [(r["event_id"], r["message_no"], r["role"], r["text"], r["thinking"], r["call_ids"], r["call_id"], [tuple(c) for c in r["calls"]]) for r in out.orderBy("event_id", "message_no").collect()]
    assert got == [
        (1, 0, "assistant", "", "one", ["a", "b"], None, [("a", "find", '{"q":1}'), ("b", "read", "{}")]),
        (1, 1, "tool", "B", "", [], "b", []),
        (1, 2, "tool", "A", "", [], "a", []),
        (1, 3, "user", "meanwhile", "", [], None, []),
        (1, 4, "assistant", "end", "three", [], None, []),
        # its result comes before it, so the call stands answered but nothing follows
        (2, 0, "assistant", "", "", ["c"], None, [("c", "f", "{}")]),
    ]


def peel_by_hand(edges, anchors, inside):
    """Mass of one event, message by message; what a cycle leaves comes in order of id."""
    out = defaultdict(list)
    for a, b, w in edges:
        if a in inside and (b in anchors or b in inside):
            out[a].append((b, w))
    mass, partial = {}, set()
    settle = lambda v: sum(w * (1.0 if b in anchors else mass.get(b, 0.0)) for b, w in out[v])
    while True:
        ready = [v for v in inside if v not in mass and all(b in anchors or b in mass for b, _ in out[v])]
        if not ready:
            break
        mass.update({v: settle(v) for v in ready})
    for v in sorted(set(inside) - set(mass)):
        partial.add(v)
        mass[v] = settle(v)
    return {v: (round(m, 9), v in partial) for v, m in mass.items()}


def test_mass_of_cyclic_events_is_partial_and_others_are_whole(spark):
    rng = random.Random(4)
    edges = [(f"n{a:02d}", f"n{b:02d}", rng.choice([0.5, 0.9, 1.0])) for a, b in {(rng.randrange(30), rng.randrange(30)) for _ in range(60)} if a != b]
    forward = [(f"m{a:02d}", f"m{b:02d}", 0.8) for a, b in {(a, a + rng.randrange(1, 4)) for a in range(20) for _ in range(2)}]
    df = spark.createDataFrame(edges + forward, "from_id string, to_id string, score double").withColumn("source", F.lit(4))
    anchors = [(1, "n00"), (1, "n07"), (2, "m20"), (3, "n11"), (3, "m19"), (4, "nowhere")]
    got = defaultdict(dict)
    for r in graph.mass(df, spark.createDataFrame(anchors, "event_id long, id string"), cap=500).collect():
        got[r["event_id"]][r["id"]] = (round(r["mass"], 9), r["partial"])
    for event in (1, 2, 3, 4):
        own, inside = {i for e, i in anchors if e == event}, set()
        fresh = set(own)
        while fresh:
            fresh = {a for a, b, _ in edges + forward if b in fresh} - inside - own
            inside |= fresh
        assert got.get(event, {}) == peel_by_hand(edges + forward, own, inside)
    assert any(p for _, p in got[1].values()) and not any(p for _, p in got[2].values())


def folded_one_by_one(parts):
    """One turn's messages and outcome, part by part."""
    made, thought, said, error, calls, answered, broken = [], "", "", None, {}, set(), False
    for _, kind, text, signature, call_id, name, arguments in sorted(parts):
        text = text or ""
        if kind == "tool_call":
            if not call_id:
                broken = True
                break
            if call_id in calls:
                continue
            if thought:
                made.append(["thinking", "", thought, "", "", "", "", False])
                thought = ""
            calls[call_id] = len(made)
            made.append(["tool_call", "", "", signature or "", call_id, name or "", arguments or "{}", False])
        elif kind == "tool_result" and call_id in calls and call_id not in answered:
            answered.add(call_id)
            made.append(["tool_result", text, "", "", call_id, "", "", False])
        elif kind == "thinking":
            thought += text
            if signature and thought:
                made.append(["thinking", "", thought, signature, "", "", "", False])
                thought = ""
        elif kind == "text":
            said += text
        elif kind == "error":
            error = text
    if not broken:
        for c in calls:
            if c not in answered:
                made.append(["tool_result", "Tool execution failed: " + error if error is not None else "Tool execution ended without a result.", "", "", c, "", "", True])
        if said or thought:
            made.append(["final", said, thought, "", "", "", "", False])
    rows = [(k, *m) for k, m in enumerate(made, 1) if not (broken and m[0] == "tool_call" and m[4] not in answered)]
    final = not broken and bool(said or thought)
    return rows, "call without id" if broken else "message" if final else f"error: {error}" if error is not None else "no response"


PARTS = "thread_id long, turn_id string, seq long, kind string, text string, signature string, call_id string, name string, arguments string"


def random_turns(seed, turns, broken=True):
    rng, rows = random.Random(seed), []
    for t in range(turns):
        for seq in rng.sample(range(100), rng.randrange(1, 14)):
            kind = rng.choice(["text", "thinking", "thinking", "tool_call", "tool_call", "tool_result", "tool_result", "error"])
            call = rng.choice(["a", "b", "c", "d"]) if kind.startswith("tool") else None
            if kind == "tool_call" and broken and rng.random() < 0.08:
                call = rng.choice(["", None])
            rows.append((t % 7, f"t{t}", seq, kind, rng.choice([None, "", f"x{seq} "]), rng.choice([None, "", "sig"]) if kind in ("thinking", "tool_call") else None, call, rng.choice(["f", None]), rng.choice([None, "", '{"k":1}'])))
    return rows


def test_fold_equals_part_by_part(spark):
    rows = random_turns(3, 250)
    messages, report = fold.fold(spark.createDataFrame(rows, PARTS))
    got, outcomes = defaultdict(list), {r["turn_id"]: r["outcome"] for r in report.collect()}
    for r in messages.orderBy("message_no").collect():
        got[r["turn_id"]].append(tuple(r)[2:])
    for turn in {r[1] for r in rows}:
        want, outcome = folded_one_by_one([r[2:] for r in rows if r[1] == turn])
        assert (got[turn], outcomes[turn]) == (want, outcome)
    empty = fold.fold(spark.createDataFrame([], PARTS))
    assert empty[0].count() == empty[1].count() == 0


def test_streamed_turns_equal_the_batch_fold(spark, tmp_path):
    rows = [r for r in random_turns(11, 12, broken=False)]
    # an orphan result, a repeated call and a repeated result
    rows += [(1, "odd", 1, "tool_result", "orphan", None, "q", None, None), (1, "odd", 2, "tool_call", None, None, "q", "f", None), (1, "odd", 3, "tool_call", None, None, "q", "g", None), (1, "odd", 4, "tool_result", "r1", None, "q", None, None), (1, "odd", 5, "tool_result", "r2", None, "q", None, None)]
    timed = spark.createDataFrame(rows, PARTS).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    schema = PARTS + ", ts timestamp"
    timed.filter("seq < 40").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    timed.filter("seq >= 40").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    # much later parts of another turn move the watermark past all turns; a late part is left out
    later = spark.createDataFrame([(99, "end", 1, "text", "bye", None, None, None, None)], PARTS)
    later.withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000))).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    late = spark.createDataFrame([(1, "odd", 9, "text", "late", None, None, None, None)], PARTS)
    late.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_009))).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = streams.turn_messages(stream.withWatermark("ts", "1 minute")).writeStream.format("memory").queryName("folded_turns").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(200)
        got = Counter(tuple(r) for r in spark.table("folded_turns").collect())
    finally:
        spark.conf.set(store, before)
    assert got == Counter(tuple(r) for r in fold.fold(spark.createDataFrame(rows, PARTS))[0].collect())


def _vectors(spark, sf):
    d = f"/root/testdata/{sf}"
    table = src.vectors(spark, d)
    return table, table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("thread_id").alias("query_thread"))


def _hits(df):
    return {(r["query_id"], r["vec_id"]) for r in df.select("query_id", "vec_id").collect()}


def _recall(index, queries, table):
    exact = _hits(retrieval.nearest(queries, table, 10))
    return len(_hits(vector_index.nearest(index, queries, 10, exact=False)) & exact) / len(exact)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_probed_recall_on_vectors_without_structure(spark, sf):
    table, queries = _vectors(spark, sf)
    assert _recall(vector_index.build(table), queries, table) >= 0.9


def test_the_share_that_is_scored_falls_as_a_clustered_table_grows(spark):
    rng, shares = random.Random(9), []
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    for each in (8, 60):
        rows = [(k, [x + rng.gauss(0, 0.2) for x in middles[k % 40]]) for k in range(40 * each)]
        table = spark.createDataFrame(rows, "vec_id long, vector array<float>")
        queries = table.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
        index = vector_index.build(table)
        assert _recall(index, queries, table) >= 0.9
        shares.append(vector_index.share_scored(index, queries))
    assert shares[1] < shares[0] and shares[1] < 0.15


def test_an_exact_search_equals_brute_force_on_odd_rows(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) + (k % 3) * 4 for _ in range(6)]) for k in range(150)]
    rows += [(200, None), (201, [0.0] * 6), (202, [1.0, 2.0]), (203, rows[0][1]), (204, rows[0][1]), (205, [-x for x in rows[0][1]])]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    queries = spark.createDataFrame([(k, rows[k][1]) for k in (0, 20, 40)] + [(900, [0.0] * 6), (901, [-1.0] * 6)], "query_id long, query_vector array<double>")
    index = vector_index.build(table, buckets=9)
    cos = lambda a, b: 0.0 if not a or not b or len(a) != len(b) or not any(a) or not any(b) else sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for k in (3, 200):
        got = defaultdict(list)
        for r in vector_index.nearest(index, queries, k, F.col("vec_id") != F.col("query_id")).orderBy("rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        for q, v in [(r["query_id"], r["query_vector"]) for r in queries.collect()]:
            want = sorted(((-round(cos(w, v), 6), i) for i, w in rows if i != q))[:k]
            assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in want], abs=2e-6) and len({i for i, _ in got[q]}) == len(want)
    assert vector_index.nearest(vector_index.build(table.limit(0)), queries, 3).count() == 0
