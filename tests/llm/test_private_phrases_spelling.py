"""Personal data, phrases and spelling variants against plain Python, on odd rows and on planted ones."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import pii, spelling
from threadloom.llm.phrases import collocations
from threadloom.llm.spelling import variants

SMALL = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    """The contract's own patterns with the checks, as they are written there."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    rows = sorted((m.start(), pii.KINDS.index(kind), m.end()) for kind, m in out)
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in rows]


ODD = [
    None,
    "",
    "a@b.c_d@e.f.g. h@i x@y-z.org..",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.000.0.1 1.2.3 ü 9.9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111-4111 5 55",
    "+1 (743) 555-3824 +49 30 1234567. +1 2 +1--------------2 ++33 1 23 45 67 89",
    "\U0001f600 +44 20 7946 0958 né@é.fr jean.é@x.fr 12\n34",
    "9" * 5000 + " " + "a." * 3000 + "@" + "b." * 3000 + "c",
    "@" * 50 + "a@" * 50 + "1." * 4000 + "1",
    "+" + "1 " * 2000 + "+(" * 300,
]


def test_base_spans_equal_the_contracts_patterns(spark):
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["a", "Z", "@", ".", "-", "+", " ", "(", ")", "1", "25", "0", "4111111111111111", "é", ",", "x@y.z", "1.2.3.4"]) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    shipped = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    rows = [(k % 450 or None, t, 1, "x") for k, t in enumerate(ODD + mixed + shipped)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, spans string")
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.personal_data(df).collect())
    want = Counter()
    for i, t, *_ in rows:
        spans = base_spans(t or "")
        kinds = Counter(s.split(":")[0] for s in spans)
        want[(i, *(kinds[k] for k in pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert got == want


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts whose strict spans teach the trees: cards and addresses that pass and fail their checks, and much plain text."""
    rng = random.Random(8)
    rows = []
    for k in range(300):
        card = "".join(rng.choice("0123456789") for _ in range(16))
        ip = ".".join(str(rng.randrange(1, 400)) for _ in range(4))
        rows.append((k, f"mail user{k}@host{k % 7}.com or someone@nohost, card {card} from {ip}, call +1 (2{k % 90 + 10}) 555-{1000 + k}, order 12345678{k:04d}"))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_trees_add_spelt_out_spans_and_leave_clean_text_alone(spark, labelled):
    planted = [
        (1000, "write to jane.doe [at] example [dot] com today", "email:9:40"),
        (1001, "the host 10[.]1[.]2[.]3 is down", "ip:9:23"),
        (1002, "card 4111.1111.1111.1111 on file", "card:5:24"),
        (1003, "call (212) 555-0187 now", "phone:5:19"),
    ]
    clean = [(2000, "look at this dot or that"), (2001, "version 1.2.3 of 2024-01-15"), (2002, "order 123456789012"), (2003, "we met at noon. 1 2 3 4 5 6"), (2004, "4111.1111.1111.1112"), (2005, "300.1.1[.]1")]
    df = labelled.unionByName(spark.createDataFrame([(i, t) for i, t, _ in planted] + clean, "doc_id long, text string"))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    assert {i: got[i] for i, _, _ in planted} == {i: s for i, _, s in planted}
    assert all(got[i] == "" for i, _ in clean)
    for i, t in (r for r in df.collect() if r["doc_id"] < 1000):
        assert set(base_spans(t)) <= set(got[i].split(","))


def test_base_spans_stay_and_redaction_covers_all_spans(spark, labelled):
    spans = labelled.select("doc_id", pii._unseen(pii.proposals(F.coalesce("text", F.lit("")))).alias("spans"))
    codes = pii.learn(spans)
    assert codes and codes == pii.learn(spans)
    rows = [(1, "a@b.com, +1 (212) 555-0187 and (212) 555-0187", "z"), (2, None, "z"), (3, "", "z"), (4, "plain", "z"), (5, "card 4111 1111 1111 1111", "z")]
    out = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans string"), codes).collect()}
    assert out == {1: "[EMAIL], [PHONE] and [PHONE]", 2: None, 3: "", 4: "plain", 5: "card [CARD]"}


def test_nothing_is_added_without_labels_of_both_kinds(spark):
    df = spark.createDataFrame([(1, "write to a.b [at] c [dot] com, x@y.com"), (None, None), (1, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_added"] for r in pii.personal_data(df).collect()} == {1: 0, None: 0}
    assert pii.personal_data(df.limit(0)).count() == 0


def plain_collocations(rows, max_words, least, percent, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, out = defaultdict(Counter), []
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        many = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in many.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and inside(p, q) for q, b in many.items()):
                continue
            score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.mark.parametrize("least,percent,max_words,top", [(3, 100, 5, 2000), (2, 60, 4, 15), (4, 100, 2, 50)])
def test_collocations_equal_plain_python(spark, least, percent, max_words, top):
    rng = random.Random(least)
    words = ["the", "The", "a", "of", "é", "É", "x-y", "new", "york", "\x00", "ß z", "(q)"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " new york city hall "]) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "fr", None]), text, 1, "x", 2))
    rows += [("en", None, 1, "x", 2), (None, "", 1, "x", 2), ("de", "...", 1, "x", 2), ("en", "one two " * 4000, 1, "x", 2)]
    df = spark.createDataFrame(rows, "lang string, text string, n int, phrase string, a int")
    got = sorted(tuple(r) for r in collocations(df, max_words, least, percent, top).collect())
    assert got == plain_collocations([r[:2] for r in rows], max_words, least, percent, top)
    assert collocations(df.limit(0)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    from threadloom.llm import phrases

    big = 10**12
    counts = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 7 * big + 1), ("en", "a b", big + 7)], "lang string, phrase string, n long")
    total = spark.createDataFrame([("en", 9 * big + 5)], "lang string, n long")
    kept, phrases.phrase_counts = phrases.phrase_counts, lambda *_: (counts, total)
    try:
        row = collocations(spark.createDataFrame([("en", "")], "lang string, text string")).first()
    finally:
        phrases.phrase_counts = kept
    assert row["score"] == 1000 * (big + 7) * (9 * big + 5) // (3 * big * (7 * big + 1))


def one_letter(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows, shortest, least, ratio, spoilt):
    low, n = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % spoilt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in words if one_letter(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,ratio,spoilt", [(1, 2, 3), (2, 10, 31), (3, 1.5, 7)])
def test_variants_equal_plain_python(spark, seed, ratio, spoilt):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 12))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "×÷×÷×÷×", "ÀÈÀÈÀÈÀ"]
    words = []
    for s in stems:
        for _ in range(6):
            k, kind = rng.randrange(len(s)), rng.randrange(4)
            words.append(s if kind == 0 else s[:k] + rng.choice("abéX") + s[k + (kind == 1) :] if kind < 3 else s[:k] + s[k + 1 :])
    rows = [(rng.choice([None, 1, 2, k]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 200))) + rng.choice(["", ".", "ω", "1a"]), 1, "w") for k in range(120)]
    rows += [(7, None, 1, "w"), (7, "", 1, "w"), rows[0], (8, "a" * 5000 + " " + "a" * 5000 + " " + "a" * 4999 + " " + "a" * 4999, 1, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    got = [tuple(r) for r in variants(df, 7, 2, ratio, spoilt).collect()]
    assert sorted(got, key=str) == plain_variants([r[:2] for r in rows], 7, 2, ratio, spoilt)
    assert variants(df.limit(0)).count() == 0


def test_roots_follow_chains_of_any_length(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(23)]
    got = {r["word"]: r["root"] for r in spelling._roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w23" for w, _ in chain}


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError, match="letter pairs"):
        spelling.near_words(spark.createDataFrame([("abcde", 2)], "word string, n long"), 5)
