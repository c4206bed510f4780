"""Personal data in texts: spans by fixed rules, and more by boosted trees over loose proposals.

Strict patterns with their checks give the base spans, which always stay. Loose patterns propose
further spans, with other separators, spelt-out marks or no prefix, that may overlap. Every
proposal has a format (its check, size, separators, variety) and a context (cue words before it,
its neighbours), coded as one small number. Gradient-boosted trees learn from the labels that the
corpus itself gives: base spans against strict matches that fail their check, addresses without a
domain, numbers without any mark, and loose proposals after words such as "order" or "version". They see the
counts of all codes of the whole corpus, not a sample. A threshold for each kind is the lowest
score above which labels of a held-out fifth reach a stated precision; what lies above it and
touches no base span is added.

Everything is expressions over a row's own text, so rows meet nowhere but in the counts of codes,
whose number is fixed.

Defined cases: a null or empty text has no span; rows that repeat an id are judged each by its
text; an empty table gives an empty table; without labels of both kinds nothing is added; other
columns are ignored. Positions are code points. The work for a text grows with the square of its
spans, with a small factor: ten thousand spans in a text take about a second.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.work import save, scratch, text_or_empty

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns, written so that no text makes them step back over what they took.
STRICT = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[ -]?[0-9])++",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
_AT = r" ?[\[({] ?at ?[\])}] ?| ?@ ?"
_DOT = r" ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot "
#: The loose patterns; bounded runs keep them linear.
LOOSE = (
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{_AT})[A-Za-z0-9-]{{1,63}}+(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}}+)*+",
    rf"(?i)(?<![0-9.])[0-9]{{1,3}}+(?:(?:{_DOT}|\.| \. )[0-9]{{1,3}}+){{3}}(?![0-9.])",
    r"(?<![0-9])(?<![0-9][ ._/-])[0-9](?:[ ._/-]{0,3}[0-9]){12,18}+(?![ ._/-]?[0-9])",
    r"(?<![0-9+])(?<![0-9][ ).\/-])\(?[0-9](?:[ ().\/-]{0,3}[0-9]){8,14}+(?![ .\/-]?[0-9])",
)
#: What a text must hold for a pattern to be tried at all.
_HINTS = ((r"@", r"@|(?i)[\[({] ?at ?[\])}]"), (r"[0-9]\.[0-9]", r"[0-9]"), (r"[0-9]", r"[0-9]"), (r"\+[0-9]", r"[0-9]"))
_CUES = (
    r"\b(?:e-?mail|mail|contact|courriel|correo)\W*$",
    r"\b(?:ip|host|server|addr|address|adresse)\W*$",
    r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)(?:\W+(?:no|nr|number))?\W*$",
    r"\b(?:tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono)\W*$",
)
_OTHER_CUE = r"\b(?:v|ver|version|build|isbn|issn|order|invoice|ref|id|token|section|page|no|nr)\W*$"

_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
_EMAIL = r"^[a-z0-9][a-z0-9._%+-]*+@(?:[a-z0-9][a-z0-9-]*+\.)++[a-z]{2,24}$"
#: Sizes of the features that a code holds, the last one changing fastest.
FEATURES = (("kind", 4), ("valid", 2), ("size", 4), ("style", 3), ("cue", 3), ("left", 3), ("right", 3), ("varied", 2))
CODES = reduce(lambda n, f: n * f[1], FEATURES, 1)
SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,label:int,code:int,held:boolean>>"
PRECISION = 0.98


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(text: Column, pattern: str, hint: str) -> Column:
    """``start, value, before, after`` of the matches of a pattern, leftmost first and not overlapping."""
    gaps = F.split(text, F.lit(pattern), -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def whole(pair: Column) -> Column:
        gaps, hits = pair["gaps"], pair["hits"]
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + F.char_length(x["gaps"])
            return F.struct((start + F.char_length(x["hits"])).alias("at"), F.concat(state["starts"], F.array(start)).alias("starts"))

        steps = F.slice(F.arrays_zip(gaps.alias("gaps"), hits.alias("hits")), F.lit(1), F.size(hits))
        starts = F.aggregate(steps, begin, step, lambda s: s["starts"])
        return F.zip_with(
            starts,
            F.transform(hits, lambda h, i: F.struct(h.alias("value"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))),
            lambda s, x: F.struct(s.alias("start"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")),
        )

    found = _let(F.struct(gaps.alias("gaps"), hits.alias("hits")), whole)
    none = F.array().cast("array<struct<start:int,value:string,before:string,after:string>>")
    return F.when(text.rlike(hint), found).otherwise(none)


def _luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits pass; others don't."""

    def passes(turned: Column) -> Column:
        def share(i: Column) -> Column:
            x = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return x - F.when(x > 9, 9).otherwise(0)

        total = F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(turned)), share), F.lit(0), lambda s, x: s + x)
        return total % 10 == 0

    return F.when(F.char_length(digits).between(13, 19), _let(F.reverse(digits), passes)).otherwise(False)


def _neighbour(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^[\s(\[{<\"',;:]$"), 0).when(c.rlike(r"^[\p{L}\p{N}_]$"), 1).otherwise(2)


def _span(kind: int, strict: bool):
    """Turns a match into a span with its label and code."""

    def read(x: Column) -> Column:
        value = F.lower(x["value"])
        fields = {"start": x["start"], "size": F.char_length(x["value"]), "value": value, "before": F.lower(x["before"]), "after": x["after"]}
        if kind < 2:
            fields["plain"] = F.regexp_replace(F.regexp_replace(value, F.lit(_AT), F.lit("@")), F.lit(_DOT + r"| \. "), F.lit("."))
        else:
            fields["plain"] = F.regexp_replace(value, "[^0-9]", "")
            fields["marks"] = F.array_size(F.array_distinct(F.split(F.regexp_replace(value, "[0-9+]", ""), "")))
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def features(x: Column) -> Column:
        value, plain, before = x["value"], x["plain"], x["before"]
        n = F.char_length(plain)
        if kind == 0:
            local = F.char_length(F.substring_index(plain, "@", 1))
            valid, size = plain.rlike(_EMAIL), F.when(local <= 2, 0).when(local <= 10, 1).when(local <= 30, 2).otherwise(3)
        elif kind == 1:
            valid, size = plain.rlike(_IP), F.when(plain.startswith("0"), 0).when(plain.rlike(r"^(?:10|127|192\.168)\."), 1).otherwise(2)
        elif kind == 2:
            valid, size = (n >= 14) & _luhn(plain), F.when(n <= 13, 0).when(n <= 16, 1).when(n <= 19, 2).otherwise(3)
        else:
            valid, size = n.between(10, 15), F.when(n < 10, 0).when(n <= 11, 1).when(n <= 15, 2).otherwise(3)
        style = F.when(plain == value, 0).otherwise(1) if kind < 2 else F.when(value.rlike(r"^\+?[0-9]+$"), 0).when(x["marks"] == 1, 1).otherwise(2)
        cue = F.when(before.rlike(_CUES[kind]), 1).when(before.rlike(_OTHER_CUE), 2).otherwise(0)
        varied = F.array_size(F.array_distinct(F.split(F.regexp_replace(value, r"[^\p{L}0-9]", ""), ""))) > 2
        # for cards and phones what counts as bare is the number alone, for addresses the lack of a domain
        bare = (value.contains("@") & ~plain.contains(".")) if kind == 0 else value.rlike("^[0-9]+$") if kind == 3 else F.lit(False)
        fields = {"start": x["start"], "end": x["start"] + x["size"], "valid": valid, "size": size, "style": style, "cue": cue, "left": _neighbour(F.right(before, F.lit(1))), "right": _neighbour(x["after"]), "varied": varied.cast("int"), "bare": bare, "held": F.pmod(F.xxhash64(value), F.lit(5)) == 0}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def judged(x: Column) -> Column:
        parts = [F.lit(kind), x["valid"].cast("int"), *(x[name] for name, _ in FEATURES[2:])]
        code = reduce(lambda c, p: c * p[1][1] + p[0], zip(parts, FEATURES), F.lit(0))
        # a strict address is base whatever the stricter check of the features says
        base = F.lit(strict) if kind == 0 else x["valid"] & F.lit(strict)
        weak = F.when((x["bare"] & (x["cue"] != 1)) | (x["cue"] == 2), 0)
        fields = {"kind": F.lit(kind), "start": x["start"], "end": x["end"], "base": base, "label": base.cast("int") if strict else weak, "code": code, "held": x["held"]}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return lambda x: _let(_let(read(x), features), judged)


def proposals(text: Column) -> Column:
    """All spans of a text that the patterns propose, strict ones first; see ``SPAN``."""
    found = []
    for kind in range(len(KINDS)):
        strict = F.transform(_places(text, STRICT[kind], _HINTS[kind][0]), _span(kind, True))
        loose = F.transform(_places(text, LOOSE[kind], _HINTS[kind][1]), _span(kind, False))
        found += [strict, loose]
    return F.concat(*found).cast(SPAN)


def _unseen(spans: Column) -> Column:
    """Proposals without the loose ones that a base span touches."""
    touches = lambda s: lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    base = lambda all_: F.struct(all_.alias("all"), F.filter(all_, lambda s: s["base"]).alias("base"))
    kept = lambda x: F.filter(x["all"], lambda s: s["base"] | ~F.exists(x["base"], touches(s)))
    return _let(_let(spans, base), kept)


def _features(codes: DataFrame) -> DataFrame:
    """``codes`` with the features of ``code`` as columns and as a vector."""
    rest = F.col("code")
    for name, size in reversed(FEATURES):
        codes = codes.withColumn(name, (rest % size).cast("double"))
        rest = F.floor(rest / size)
    # kinds have no order: one column each
    flags = {f"is_{k}": (F.col("kind") == i).cast("double") for i, k in enumerate(KINDS)}
    return VectorAssembler(inputCols=[*[n for n, _ in FEATURES if n != "kind"], *flags], outputCol="features").transform(codes.withColumns(flags))


def learn(spans: DataFrame, precision: float = PRECISION, rounds: int = 20, depth: int = 3) -> list[int]:
    """Codes that are worth adding, from the labelled spans of ``spans (spans)``."""
    spark: SparkSession = spans.sparkSession
    rows = spans.select(F.explode("spans").alias("s")).select("s.*").filter("label is not null")
    counts = save(rows.groupBy("code", "label", "held").agg(F.count("*").cast("double").alias("weight")))
    known = _features(counts.orderBy("code", "label").coalesce(1))
    training = known.filter("not held")
    if training.select("label").distinct().count() < 2:
        return []
    boost = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=8, stepSize=0.3, seed=11, checkpointInterval=-1)
    model = boost.fit(training)
    score = F.round(vector_to_array("probability")[1], 6).alias("score")
    every = save(model.transform(_features(spark.range(CODES).select(F.col("id").alias("code")))).select("code", F.col("kind").cast("int").alias("kind"), score))
    tried = counts.filter("held").join(every, "code")
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    right = F.sum(F.col("weight") * F.col("label")).over(above) / F.sum("weight").over(above)
    cut = tried.withColumn("right", right).filter(F.col("right") >= precision).groupBy("kind").agg(F.min("score").alias("cut"))
    return sorted(r["code"] for r in every.join(cut, "kind").filter("score >= cut").select("code").collect())


def _accepted(code: Column, codes: list[int]) -> Column:
    words = [0] * (CODES // 32 + 1)
    for c in codes:
        words[c // 32] |= 1 << c % 32
    word = F.get(F.lit(words).cast("array<bigint>"), F.floor(code / 32).cast("int"))
    return F.call_function("shiftright", word, (code % 32).cast("int")).bitwiseAND(1) == 1


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order of start, then kind, joined by commas."""
    order = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
    name = F.lit(list(KINDS))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _chosen(spans: Column, codes: list[int]) -> Column:
    """Base spans and accepted ones; of accepted ones that overlap the longest stays, then the first kind."""
    length = lambda s: s["end"] - s["start"]
    beats = lambda s: lambda t: ~t["base"] & (t["start"] < s["end"]) & (s["start"] < t["end"]) & ((length(t) > length(s)) | ((length(t) == length(s)) & (t["kind"] < s["kind"])))
    longest = lambda kept: F.filter(kept, lambda s: s["base"] | ~F.exists(kept, beats(s)))
    return _let(F.filter(spans, lambda s: s["base"] | _accepted(s["code"], codes)), longest)


def personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans, n_added``."""
    with scratch() as kept:
        spans = save(docs.select("doc_id", _unseen(proposals(text_or_empty())).alias("spans")))
        codes = learn(spans, precision)
        base = F.filter("spans", lambda s: s["base"])
        of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
        counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
        chosen = _chosen(F.col("spans"), codes)
        added = (F.size(chosen) - F.size(base)).cast("long").alias("n_added")
        out = save(spans.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(chosen).alias("spans"), added))
        kept.append(out)
    return out


def redact(docs: DataFrame, codes: list[int]) -> DataFrame:
    """``docs`` with every run of touching spans of ``text`` replaced by its first kind in brackets.

    ``codes`` are those of ``learn``; none redacts base spans only. Null texts stay null.
    """
    spans = _chosen(_unseen(proposals(text_or_empty())), codes)
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = F.lit(list(KINDS))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(F.lit("["), F.upper(F.get(name, s["kind"])), F.lit("]"))
        apart = s["start"] >= state["at"]
        return F.struct(F.when(apart, F.concat(state["out"], gap, mark)).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    rest = lambda state: F.concat(state["out"], F.substr(F.col("text"), state["at"] + 1))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), F.aggregate(order, begin, step, rest)))
