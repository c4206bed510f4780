"""The operators against brute force, on small tables with nulls, ties, repeats and extra columns."""

import hashlib
import io
import math
import random
import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import arrays, edits, langid, line_dedup, near_dedup, packing, token_files, warc
from threadloom.llm.decontaminate import drop_leaks, leaks
from threadloom.llm.fingerprint import fingerprints
from threadloom.llm.linking import components
from threadloom.llm.queries import URL_RULES, tokenizer_path
from threadloom.llm.sharding import assign_shards
from threadloom.llm.tokens import Encoder
from threadloom.llm.url_filter import judge
from threadloom.llm.work import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(text, k, rng):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def sample(seed=3):
    """Originals, near and exact copies, nulls, blanks, short texts, repeated rows and ids."""
    rng, rows = random.Random(seed), []
    for k in range(12):
        base = prose(rng.choice([3, 6, 40, 120]), rng)
        rows += [(10 * k, base), (10 * k + 1, base), (10 * k + 2, edited(base, 1, rng)), (10 * k + 3, edited(base, 4, rng))]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "One"), (204, "one"), (205, "A b c"), (206, "é ünï"), (0, rows[0][1]), (300, prose(3000, rng)), (None, "x y z"), (None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def groups(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def test_components_of_random_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = groups(edges, range(60))
    assert all(want[i] == c for i, c in got.items())
    assert {i for i, c in want.items() if c != i} <= set(got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_equal_brute_force(spark):
    rows = sample()
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, rows), 4, 80).collect() if r["doc_id"] is not None}
    sets = {i: shingles(t, 4) for i, t in rows if i is not None}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(links, sets)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    a, b = np.unique(pool[:5000]), np.unique(pool[1000:])
    est, _ = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
    assert abs(est[0] - 4 / 6) < 0.1
    assert near_dedup.registers(np.zeros(0, np.uint64)).sum() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_parities_bound_the_difference_from_below():
    rng = np.random.default_rng(8)
    for common, more in ((0, 5), (4, 1), (40, 10), (400, 90), (5000, 1200)):
        both, x, y = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (common, more, more // 2))
        a, b = (near_dedup.parities(np.unique(np.concatenate([both, own]))) for own in (x, y))
        bits = sum(int(d).bit_count() for d in (a ^ b).view(np.uint64))
        assert 0 < bits <= len(x) + len(y)
        assert not (near_dedup.parities(both) ^ near_dedup.parities(both[::-1])).any()


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert edits.edit_distance(a, b) == distance(a, b)


def test_bound_of_the_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = prose(rng.randrange(1, 9), rng)
        b = rng.choice([edited(a, 2, rng), a + " " + prose(2, rng), " ".join(a.split()[1:]), prose(4, rng)])
        assert edits.at_most(a, b) >= distance(a, b)
        assert edits.similar(a, b, 80) == (100 * distance(a, b) <= 20 * max(len(a), len(b)))


def test_distances_of_many_pairs():
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choice("abcé ") for _ in range(rng.choice([1, 5, 63, 64, 65, 130, 300]))) for _ in range(2)) for _ in range(60)]
    pairs += [(a, a[: len(a) // 2] + "z" + a[len(a) // 2 :]) for a, _ in pairs] + [("abc" * 400, "abd" * 400), ("x y", "x z")]
    a, b = map(list, zip(*pairs))
    assert edits.distances(a, b).tolist() == [edits.edit_distance(x, y) for x, y in pairs]
    assert edits.all_similar([*a, "", "x"], [*b, "", ""], 80).tolist() == [edits.similar(x, y, 80) for x, y in [*pairs, ("", ""), ("x", "")]]


def test_lines_equal_brute_force(spark):
    rng = random.Random(11)
    lines = [prose(rng.choice([2, 6, 12, 90, 150]), rng) for _ in range(25)]
    lines += [edited(x, 1, rng) for x in lines] + [x.upper() + "!" for x in lines[:10]]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 7)))) for k in range(30)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (0, rows[0][1])]
    nodes, first = {}, {}
    for i, t in sorted(dict(rows).items()):
        for no, line in enumerate((t or "").split("\n")):
            line = line_dedup.normalise(line)
            if len(line.split()) >= 5:
                first.setdefault(line, (i, no))
    names = list(first)
    links = [(a, b) for a, b in combinations(range(len(names)), 2) if edits.similar(names[a], names[b], 80)]
    part = groups(links, range(len(names)))
    keep = {}
    for k, line in enumerate(names):
        keep[part[k]] = min(keep.get(part[k], (9e9, 0)), first[line])
    nodes = {line: keep[part[k]] for k, line in enumerate(names)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    for i, t in rows:
        kept = [x for no, x in enumerate((t or "").split("\n")) if nodes.get(line_dedup.normalise(x), (i, no)) == (i, no)]
        assert got[i] == (None if t is None else "\n".join(kept)), i
    assert links and line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_edited_lines_are_linked_by_similarity_alone(spark):
    rng = random.Random(11)
    lines = [prose(n, rng) for n in (6, 8, 12, 16, 24, 40, 60, 100) for _ in range(5)]
    rows = [(k, x) for k, x in enumerate(lines)] + [(100 + k, edited(x, max(1, len(x.split()) // 12), rng)) for k, x in enumerate(lines)]
    texts = dict(rows)
    found = {i for i in range(100, 100 + len(lines)) if edits.similar(texts[i], texts[i - 100], 80)}
    assert len(found) >= 36
    expected = {i: "" if i in found else t for i, t in texts.items()}
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == expected and line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_op5_drops_a_line_with_one_changed_word(spark, tmp_path):
    from threadloom.llm.queries import op5_line_dedup

    line = "the quick brown fox jumps over the lazy dog near the old river bank"
    frame(spark, [(1, line), (2, line.replace("lazy", "sleepy"))]).write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r["n_dropped"] for r in op5_line_dedup(spark, str(tmp_path)).collect()) == 1


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    items = [(k, prose(rng.choice([3, 9, 25, 60]), rng)) for k in range(12)] + [(50, None), (51, ""), (0, prose(9, rng))]
    rows = sample()
    for k in range(6):
        rows.append((400 + k, prose(rng.choice([20, 900]), rng) + " " + items[k][1].upper() + ", " + prose(50, rng)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(frame(spark, rows), bench).collect()}
    word = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def grams(t, n):
        w = word(t)
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    want = set()
    for item, text in items:
        n = min(5, len(word(text)))
        probe = grams(text, n) if n else set()
        want |= {(i, item) for i, t in rows if i is not None and probe and 100 * len(probe & grams(t, n)) >= 80 * len(probe)}
    assert got == want and len(want) >= 6
    left = [r["doc_id"] for r in drop_leaks(frame(spark, rows), bench).collect()]
    assert Counter(left) == Counter(i for i, _ in rows if i not in {d for d, _ in want})
    assert leaks(frame(spark, rows), bench.limit(0)).count() == 0 and leaks(empty(spark), bench).count() == 0


def test_shards_fit_and_split_no_more_than_needed(spark):
    rows = [(k, "x" * (k % 50)) for k in range(2000)] + [(5000, None), (None, "y" * 10)]
    df = frame(spark, rows).withColumn("shard_depth", F.lit("clash"))
    out = assign_shards(df, F.col("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))), 3000).collect()
    assert len(out) == len(rows)
    sums = Counter()
    for r in out:
        sums[(r["shard_depth"], r["shard_prefix"])] += r["n_bytes"]
    for (depth, prefix), n in sums.items():
        assert n <= 3000
        pair = sum(r["n_bytes"] for r in out if r["hash60"] >> (60 - depth + 1) == prefix >> 1) if depth else 0
        assert depth == 0 or pair > 3000
    one = assign_shards(frame(spark, [(1, "z" * 90)]), F.col("doc_id"), F.octet_length("text"), 10).first()
    assert one["oversized"] and assign_shards(empty(spark), F.col("doc_id"), F.lit(1), 10).count() == 0


def test_url_rules_and_templates(spark):
    urls = ["http://a.example.net/en/1", "https://EXAMPLE.com/de/2?x", "http://b.org/fr/3#f", "http://q.net/x", "http://example.com/en/4", None, "no scheme", "http://notexample.com/de/5", "http://h.info"]
    urls += [f"http://shop.info/spam/{k}.html" for k in range(40)] + [f"http://shop.info/good/{k}.html" for k in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(9 + k, int(k < 40)) for k in range(80)], "page_id long, bad int")
    got = {r["page_id"]: r for r in judge(pages, labels, URL_RULES).collect()}
    assert len(got) == len(urls)
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(6)] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.com", "/de/2", "example.com/de/", "block"),
        ("b.org", "/fr/3", "org/fr/", "allow"),
        ("q.net", "/x", "net/", "block"),
        ("example.com", "/en/4", None, "allow"),
        ("", "", None, "allow"),
    ]
    assert got[7]["rule"] is None
    assert all(got[9 + k]["verdict"] == ("block" if k < 40 else "allow") for k in range(80))
    assert judge(pages.limit(0), labels, URL_RULES).count() == 0


def test_rare_children_of_a_crowded_node_keep_their_own_rate(spark):
    urls = [f"http://hot.info/p{chr(97 + a)}{chr(97 + b)}/x" for a in range(10) for b in range(10) for _ in range(50)]
    good = len(urls)
    urls += ["http://hot.info/spam/x"] * 100
    urls += [f"http://hot.info/bad{chr(97 + a)}{chr(97 + b)}/x" for a in range(10) for b in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= good)) for k in range(len(urls)) if k % 2 or k >= good], "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in judge(pages, labels).collect()}
    assert got == {k: "block" if k >= good else "allow" for k in range(len(urls))}


def test_gradual_rates_do_not_chain(spark):
    names, rows = "abcdefghijk", []
    for k, name in enumerate(names):
        rows += [(f"http://slow.info/{name}/x", int(j < 10 * k)) for j in range(100)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad int")
    got = {r["path"][1]: r["template"] for r in judge(pages, labels).collect()}
    assert got["c"] != got["e"] and got["c"] != got["i"] and got["e"] != got["i"]


def test_fingerprints(spark):
    rows = sorted([(i, t) for i, t in dict(sample()).items() if i is not None], reverse=True)
    got = {r["doc_id"]: r for r in fingerprints(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        third = len(t) // 3
        text = t[: len(t) - third] + u[:third]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(text.encode()).hexdigest())
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and fingerprints(empty(spark)).count() == 0


TEXTS = ["", "Hello, world! It's 3.5 o'clock...", "naïve café über\n\nstraße", "<|endoftext|> odd <|EndOfText|>", "a" * 3000, "x. y, z; (q) ?! é", prose(500, RNG)]


def test_encoder_gives_new_words_together_to_the_library():
    from tokenizers import Tokenizer

    enc, model, asked = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path()), []
    plain, draw = enc._ids, random.Random(3)
    enc._ids = lambda texts: asked.extend(texts) or plain(texts)
    words = ["".join(draw.choices("abcdéßИ中7'-_", k=draw.randint(1, 12))) for _ in range(7000)]
    texts = [" ".join([*words, "a|b", "|", "||.", "\u0301x", "\u037e", "\uff5c", "x\u00a0y", "\u3000", "\u212a"]), "", " | ", words[0]]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc(texts)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 20


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    enc, model = Encoder(tokenizer_path(), keep=5), Tokenizer.from_file(tokenizer_path())
    assert enc._by_word
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in enc(TEXTS)]
        assert got == [model.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = sample() + [(900 + k, t) for k, t in enumerate(TEXTS)]
    folder, model = shared_dir(spark), Tokenizer.from_file(tokenizer_path())
    manifest = token_files.write_token_files(frame(spark, rows), folder, tokenizer_path(), 1).collect()
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], bytes(r["ids"])) for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for _, _, start, ids in got:
        assert start == at
        at += len(ids) // 4
    want = Counter((i or 0, np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in rows)
    assert Counter((r[1], r[3]) for r in got) == want
    found = [token_files.read_document(folder, m["path"], 300) for m in manifest]
    assert [len(x) for x in found if x] == [1]
    empty_dir = shared_dir(spark)
    token_files.write_token_files(empty(spark), empty_dir, tokenizer_path(), 1)
    assert token_files.read_token_files(spark, empty_dir).count() == 0


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    rows, model = sample() + [(900 + k, t) for k, t in enumerate(TEXTS)], Tokenizer.from_file(tokenizer_path())
    got = packing.pack(frame(spark, rows).repartition(3), tokenizer_path(), 2, block_tokens=3000).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    want = Counter(tuple(model.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows if i not in (0, None))
    have = Counter(tuple(np.frombuffer(b"".join(bytes(p["ids"]) for p in sorted(v, key=lambda p: p["start"])), "<u4").tolist()) for k, v in by_doc.items() if k[0] not in (0, None))
    assert have == want
    for pieces in by_seq.values():
        pieces.sort(key=lambda p: p["offset"])
        n = sum(p["length"] for p in pieces)
        assert [p["offset"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()
        assert n <= 4096 and n & (n - 1) == 0
    assert packing.pack(empty(spark), tokenizer_path(), 2).count() == 0


def test_step_groups_are_even():
    lengths = [4096] * 40 + [2048] * 33 + [512] * 17
    sums = Counter()
    for n, g in zip(lengths, packing.step_groups(lengths)):
        sums[g] += n
    assert max(sums.values()) - min(sums.values()) <= 4096


def test_step_groups_are_even_over_all_partitions(spark, tmp_path):
    from threadloom.llm.work import save

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(5, "doc_id")
    pieces = save(packing.pack(docs, tokenizer_path(), 2, block_tokens=50_000))
    got = packing.even_groups(pieces, 5 * 4096)
    assert got.columns == pieces.columns and got.count() == pieces.count()
    rows = sorted({(r["sequence_id"], r["sequence_tokens"], r["step_group"]) for r in got.select("sequence_id", "sequence_tokens", "step_group").collect()})
    assert len({i for i, _, _ in rows}) == len(rows) and len({i >> 40 for i, _, _ in rows}) > 1
    assert [g for _, _, g in rows] == packing.step_groups([n for _, n, _ in rows], 5 * 4096)
    sums = Counter()
    for _, n, g in rows:
        sums[g] += n
    assert len(sums) > 3 and max(sums.values()) - min(sums.values()) <= 4096
    assert packing.even_groups(save(packing.pack(empty(spark), tokenizer_path(), 2))).count() == 0


def test_archives_round_trip(spark):
    rows = [(5, "http://a/1", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u", "<p>é</p>"), (4, "v", None), (6, "w", ""), (7, "x", "y" * 200_000), (3, None, "<p>é</p>"), (None, "n", "only"), (None, "n", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_warc(spark, warc.write_warc(pages, shared_dir(spark))).collect()
    key = lambda r: (r["page_id"] is None, r["page_id"] or 0, r["payload_digest"])
    have = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"]) for r in got), key=str)
    want = []
    for i, url, html in rows:
        data = (html or "").encode()
        first = {"<p>é</p>": 3, "": 4}.get(html or "", i)
        own = i == first
        want.append((i, len(data), warc.base32_sha1(data), "response" if own else "revisit", None if own else first, url))
    assert have == sorted(want, key=str) and key
    assert warc.write_warc(pages.limit(0), shared_dir(spark)).count() == 0


def test_reader_refuses_damage():
    good = warc.record(1, "u", b"payload") + warc.record(2, "v", b"")
    assert [f["warc-record-id"] for f, _ in warc.read_records(io.BytesIO(good))] == ["<urn:page:1>", "<urn:page:2>"]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-10])))
    raw = zlib.decompress(warc.record(1, "u", b"payload"), 31).replace(b"payload\r\n", b"paxload\r\n")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(press.compress(raw) + press.flush())))


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = langid.codewords(n)
        apart = [(code[a] != code[b]).sum() for a, b in combinations(range(n), 2)]
        assert min(apart) >= (code.shape[1] // 4 if n > 2 else 1)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).filter(langid.held_out()).filter("length(text) > 40").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 -- !", "en"), (3, "le", None), (None, "the", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert [r["lang_pred"] for r in langid.identify(odd, model).orderBy(F.col("doc_id").asc_nulls_last()).collect()][:2] == ["und", "und"]
    nothing = langid.identify(odd.filter("doc_id = 2").withColumn("score", F.lit("clash"))).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert langid.identify(odd.limit(0), model).count() == 0


def test_languages_equal_plain_counts_losses_and_decoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(120)
    rows = [tuple(r) for r in docs.collect()] + [(100_001, "", "en"), (100_002, None, "de"), (100_003, "7 \u00c9t\u00c9!", None), (None, "the end", "en")]
    whole, (a, b, c) = 1 << 64, map(int, langid._MIX)

    def found(text):
        chars = [x if unicodedata.category(x)[0] == "L" else " " for x in text.lower()]
        for k, x in enumerate(chars):
            if x == " ":
                continue
            one = ord(x) * a
            two = one + (ord(chars[k + 1]) if k + 1 < len(chars) else 32) * b
            three = two + ((ord(chars[k - 1]) if k else 32) + 7) * c
            for value in (one, two + 1, three + 2):
                value %= whole
                yield ((value ^ value >> 29) * b % whole) >> (64 - langid.BUCKET_BITS)

    counts = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(found(text))
    langs = sorted(counts)
    code = langid.codewords(len(langs))
    assert 2 < len(langs) <= 6 and len({tuple(x) for x in code.T}) == 2 ** (len(langs) - 1) - 1

    def share(lang, at):
        return (counts[lang][at] + langid.SMOOTHING) / (counts[lang].total() + langid.SMOOTHING * langid.BUCKETS)

    def weight(at, bit):
        sides = [[share(x, at) for x, s in zip(langs, bit) if s == side] for side in (1, -1)]
        return math.log(sum(sides[0]) / len(sides[0])) - math.log(sum(sides[1]) / len(sides[1]))

    weights, want = {}, []
    for _, text, _ in rows:
        places = list(found(text or ""))
        if not places:
            want.append(("und", 0.0))
            continue
        for at in set(places) - weights.keys():
            weights[at] = [weight(at, bit) for bit in code.T]
        n = len(places) // 3
        margins = [sum(weights[at][k] for at in places) / n * min(n, langid.ENOUGH_LETTERS) / 3 for k in range(code.shape[1])]
        losses = [sum(np.logaddexp(0, -m * s) for m, s in zip(margins, word)) for word in code]
        best = min(range(len(langs)), key=lambda k: losses[k])
        want.append((langs[best], 1 / sum(math.exp(losses[best] - x) for x in losses)))
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string, lang string").repartition(3)
    got = langid.identify(table).orderBy("k").collect()
    assert [r["lang_pred"] for r in got] == [x for x, _ in want]
    assert [r["score"] for r in got] == pytest.approx([x for _, x in want], abs=1e-4)


def test_word_hashes_do_not_depend_on_the_batch():
    words, at = arrays.word_hashes(["Ab cd", "", "ab CD\tef"])
    assert at.tolist() == [0, 2, 2, 5] and words[:2].tolist() == words[2:4].tolist()


def test_pipeline_stages_chain(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(corpus_pipeline.STAGES) == 5


def test_signature_is_bounded_and_finds_items(spark):
    from threadloom.llm import decontaminate as D

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    levels = sorted({D.level_of(n) for n in (11, 20, 40)})
    made = D.signature(D._grams(docs, 5), levels).selectExpr("doc_id", "size(signature) as n", "size(filter(signature, x -> x.level = %d)) as low" % levels[0])
    sizes = D._grams(docs, 5).selectExpr("doc_id", "size(grams) as all")
    sums = made.join(sizes, "doc_id").selectExpr("sum(n) / sum(all) as share", "sum(low) / sum(all) as low").first()
    assert 0.3 < sums["share"] < 0.75 and 0.1 < sums["low"] < 0.45
    word = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    holders = {}
    for i, t in docs.collect():
        w = word(t)
        for k in range(len(w) - 4):
            holders.setdefault(tuple(w[k : k + 5]), set()).add(i)
    want = set()
    for item, t in bench.collect():
        grams = {tuple(word(t)[k : k + 5]) for k in range(len(word(t)) - 4)}
        hits = Counter(i for g in grams for i in holders.get(g, ()))
        want |= {(i, item) for i, n in hits.items() if 100 * n >= 80 * len(grams)}
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 10


def test_levels_hold_their_chance():
    from threadloom.llm import decontaminate as D

    for n in (1, 5, 11, 16, 40, 200):
        level, common = D.level_of(n), -(-n * 80 // 100)
        assert level == D.LEVELS[-1] or (1 - D.kept_share(level)) ** common <= D.MISS
        assert level == D.LEVELS[0] or (1 - D.kept_share(level - 1)) ** common > D.MISS
    assert D.level_of(11) > D.level_of(40)


def _spark_shingles(text, n=5):
    import xxhash

    seed = lambda h: h % 2**64
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"\s+", (text or "").lower()) if w]
    out = set()
    for k in range(max(1, len(words) - n + 1)) if words else []:
        h = 42
        for w in words[k : k + n]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed(h))
        out.add(h)
    return out


def _kept_hashes(hashes, scale):
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    return {h for h in hashes if signed(h) < -(2**63) + 2**64 // scale}


def test_fingerprints_equal_brute_force(spark):
    from threadloom.llm.fingerprint import SCALE, fingerprints

    rows = sorted([(i, t) for i, t in dict(sample()).items() if i is not None and i not in (202, 206)], reverse=True)
    got = {r["doc_id"]: r for r in fingerprints(frame(spark, rows)).collect()}
    show = lambda s: "".join(f"{h:016x}" for h in sorted(s, key=lambda h: h - 2**64 if h >= 2**63 else h))

    def near(a, b, same):
        return 1.0 if same else 0.0 if not a or not b else len(a & b) / min(len(a), len(b))

    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        third = len(t) // 3
        edit = t[: len(t) - third] + u[:third]
        own, other, changed = (_kept_hashes(_spark_shingles(x), SCALE) for x in (t, u, edit))
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (show(own), show(changed))
        assert r["near_edited"] == pytest.approx(near(own, changed, t == edit)) and r["near_next"] == pytest.approx(near(own, other, t == u))


def test_merged_sketch_is_the_sketch_of_the_union(spark):
    from threadloom.llm.fingerprint import SCALE, merged, with_sketch

    rng = random.Random(6)
    a, b = prose(400, rng), prose(3, rng)
    rows = with_sketch(with_sketch(spark.createDataFrame([(a, b)], "a string, b string"), F.col("a"), "x"), F.col("b"), "y")
    got = [h % 2**64 for h in rows.select(merged("x", "y").alias("m")).first()["m"]]
    assert set(got) == _kept_hashes(_spark_shingles(a) | _spark_shingles(b), SCALE) and len(got) > 40


def _tree_by_hand(urls, labels, levels=8, crowded=32):
    """The template tree on Python lists: host and form of each url to its template."""
    from threadloom.llm import url_filter as U

    def apart(b, n, b2, n2):
        if not n or not n2:
            return False
        p = (b + b2) / (n + n2)
        return abs(b / n - b2 / n2) > U.MERGE_Z * max((p * (1 - p) * (1 / n + 1 / n2)) ** 0.5, 1e-12)

    forms = {}
    for k, u in enumerate(urls):
        host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u).groups()
        form = re.sub(r"[0-9]+", "{n}", re.sub(r"(?i)\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b", "{h}", path))
        sums = forms.setdefault((host.lower(), form), [0, 0, 0])
        sums[0] += 1
        if k in labels:
            sums[1] += 1
            sums[2] += labels[k]
    node = {f: "" for f in forms}
    parts = {f: [s for s in f[1].split("/") if s] for f in forms}
    for depth in range(min(levels, max(map(len, parts.values())))):
        children = {}
        for f, sums in forms.items():
            if len(parts[f]) > depth:
                kid = children.setdefault((f[0], node[f]), {}).setdefault(parts[f][depth], [0, 0, 0])
                for x in range(3):
                    kid[x] += sums[x]
        branch = {}
        for at, kids in children.items():
            assert len(kids) <= crowded
            groups = []
            for name, (_, n, b) in sorted(kids.items(), key=lambda kv: (kv[1][2] / kv[1][1] if kv[1][1] else -1, kv[0])):
                g = groups[-1] if groups else None
                if g is None or (g[1] == 0 and n > 0) or apart(b, n, g[2], g[1]):
                    groups.append([[name], n, b])
                else:
                    g[0].append(name)
                    g[1] += n
                    g[2] += b
            for names, _, _ in groups:
                text = f"({'|'.join(sorted(names))})" if len(names) > 1 else names[0]
                branch |= {(*at, name): text for name in names}
        for f in forms:
            if len(parts[f]) > depth:
                node[f] = f"{node[f]}/{branch[(f[0], node[f], parts[f][depth])]}"
    return node


def test_templates_equal_a_tree_by_hand(spark):
    from threadloom.llm.url_filter import templates

    rng, urls, labels = random.Random(12), [], {}
    rates = {"spam": 0.9, "buy": 0.85, "news": 0.1, "blog": 0.15, "wiki": 0.0, "tag": 0.5}
    for k in range(600):
        top = rng.choice([*rates, "new"])
        urls.append(f"http://{rng.choice('ab')}.info/{top}/{rng.choice(['x', 'y', str(rng.randrange(99)), 'deadbeef0123'])}" + rng.choice(["", "/z", ".html?q"]))
        if top in rates and rng.random() < 0.8:
            labels[k] = int(rng.random() < rates[top])
    rows = [(*re.match(r"^.*?://([^/?#]*)([^?#]*)", u).groups(), labels.get(k)) for k, u in enumerate(urls)]
    got = {(r["host"], r["form"]): r["template"] for r in templates(spark.createDataFrame(rows, "host string, path string, bad int")).collect()}
    want = _tree_by_hand(urls, labels)
    assert got == want and len(set(want.values())) >= 8
    assert any(t.startswith("/new/") for t in want.values())


def test_page_labels_come_from_the_documents_shown(spark):
    from threadloom.llm.url_filter import page_labels

    a, b, both = "one two three four five six", "seven eight nine ten eleven", "same line in two documents here"
    docs = spark.createDataFrame([(1, f"{a}\n{both}"), (2, f"{b}\n{both}"), (3, "unlabelled words stand here alone"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (None, 1)], "doc_id long, toxic int")
    html = [(10, f"<p>{a}</p><p>{both}</p>"), (11, f"<script>{a}</script><p class='x'><b>seven</b> eight\n nine ten eleven<br>"), (12, f"<p>{both}</p>"), (13, None), (14, "<p>unlabelled words stand here alone"), (15, f"<p>{a}</p><p>{b}</p>"), (None, f"<p>{a}</p>")]
    got = page_labels(spark.createDataFrame(html, "page_id long, html string"), docs, labels).collect()
    assert {r["page_id"]: r["bad"] for r in got} == {10: 1, 11: 0, 15: 1}


def test_page_labels_join_hashes_and_no_texts(spark, monkeypatch):
    from threadloom.llm import url_filter

    plans = []
    monkeypatch.setattr(url_filter, "save", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan()) or df)
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    url_filter.page_labels(spark.createDataFrame([(10, "<p>x")], "page_id long, html string"), docs, labels)
    joined = []
    for node in plans:
        plans += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            joined += [c.output().mkString(",") for c in (node.left(), node.right())]
    assert len(joined) == 2 and not any("text" in c for c in joined)
