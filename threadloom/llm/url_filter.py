"""URL filtering by per-host path-template trees with smoothed labelled purity.

Paths are first generalised by form (runs of digits, long hexadecimal names). Then, level by level
and per host, the rare children of a crowded tree node become one wildcard branch, except those whose
labelled bad rate a two-proportion test tells apart from the rest of the node: these meet in grades
of their rate. In order of rate, children and grades join the branch before them where the test
can't tell them apart from that branch as a whole; children without labels are a branch of their
own. A root-to-leaf template is rejected where its bad rate, smoothed towards the corpus rate,
reaches a bound. Fixed host and path rules go before templates. DataFrame expressions only.

Pages have no labels of their own. ``page_labels`` takes those of the documents whose lines a page
shows: each paragraph that is the line of just one labelled document has that document's label,
and a page is bad where at least half of such paragraphs are.

Defined cases: a null url or one without ``://`` has empty host and path and its own template; a
template without labels takes the corpus rate; segments below the deepest level of the tree form
one tail wildcard; repeated rows are judged alike and each returned; rows without page_id are
judged by their url; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.work import save

LEVELS = 8
CROWDED = 32
#: Grades of bad rate in which the rare children that are kept meet, so that a node has few of them.
GRADES = 32
MERGE_Z = 1.96
PRIOR_WEIGHT = 20.0
REJECT = 0.6
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_columns(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict. A rule is a host, a slash and a path prefix."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _form(path: Column) -> Column:
    """Variable names by form: hexadecimal runs of eight or more with a digit, then digit runs."""
    hexes = F.regexp_replace(path, r"(?i)\b(?=[a-f]*[0-9])[0-9a-f]{8,}\b", "{h}")
    return F.regexp_replace(hexes, r"[0-9]+", "{n}")


def _apart(bad: Column, labelled: Column, bad2: Column, labelled2: Column) -> Column:
    """Whether a two-proportion test tells the bad rates apart; never where a side has no label."""
    pooled = (bad + bad2) / F.nullif(labelled + labelled2, F.lit(0))
    parts = 1 / F.nullif(labelled, F.lit(0)) + 1 / F.nullif(labelled2, F.lit(0))
    gap = F.abs(bad / F.nullif(labelled, F.lit(0)) - bad2 / F.nullif(labelled2, F.lit(0)))
    return F.coalesce(gap > MERGE_Z * F.greatest(F.sqrt(pooled * (1 - pooled) * parts), F.lit(1e-12)), F.lit(False))


def _level(tree: DataFrame, depth: int, last: bool) -> DataFrame:
    """Move every path of ``tree`` one segment down its host's tree."""
    segment = F.when(F.size("segments") > depth, F.lit("**") if last else F.get("segments", F.lit(depth)))
    rows = tree.withColumn("segment", segment)
    going = rows.filter("segment is not null")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    children = save(going.groupBy("host", "node", "segment").agg(*sums))
    all_sums = [F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")]
    nodes = save(children.groupBy("host", "node").agg(F.count("*").alias("width"), *all_sums))
    rate = F.when(F.col("labelled") > 0, F.col("bad") / F.col("labelled"))
    children = children.join(nodes, ["host", "node"]).withColumn("rate", rate)
    heavy = (F.col("width") <= CROWDED) | (F.col("n") * CROWDED >= F.col("all_n"))
    odd = _apart(F.col("bad"), F.col("labelled"), F.col("all_bad") - F.col("bad"), F.col("all_labelled") - F.col("labelled"))
    grade = F.when(~heavy, F.floor(F.col("rate") * GRADES).cast("int"))
    literal = save(children.filter(heavy | odd).withColumn("grade", grade).select("host", "node", "segment", "labelled", "bad", "grade"))
    alone = literal.filter("grade is null").select("host", "node", F.lit(None).cast("int").alias("grade"), F.col("segment").alias("first"), F.lit(1).cast("long").alias("size"), "labelled", "bad")
    light = literal.filter("grade is not null").groupBy("host", "node", "grade").agg(F.min("segment").alias("first"), F.count("*").alias("size"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # at most CROWDED children and GRADES + 1 grades a node from here on
    item = F.struct(rate.alias("rate"), "first", "size", "grade", "labelled", "bad")
    ordered = alone.unionByName(light).groupBy("host", "node").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("no"), F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("bad"), F.array().cast("array<int>").alias("nos"))

    def step_on(at: Column, x: Column) -> Column:
        first_labels = (at["labelled"] == 0) & (x["labelled"] > 0) & (F.size(at["nos"]) > 0)
        cut = first_labels | _apart(x["bad"], x["labelled"], at["bad"], at["labelled"])
        no = at["no"] + cut.cast("int")
        held = {c: F.when(cut, x[c]).otherwise(at[c] + x[c]).cast("long") for c in ("labelled", "bad")}
        return F.struct(no.alias("no"), held["labelled"].alias("labelled"), held["bad"].alias("bad"), F.concat(at["nos"], F.array(no)).alias("nos"))

    numbered = ordered.select("host", "node", F.explode(F.arrays_zip("items", F.aggregate("items", start, step_on, lambda at: at["nos"]).alias("nos"))).alias("x"))
    numbered = numbered.select("host", "node", F.col("x.nos").alias("branch_no"), "x.items.*")
    group = Window.partitionBy("host", "node", "branch_no")
    label = F.when(F.col("size") > 1, F.concat("first", F.lit("|+"), F.col("size") - 1)).otherwise(F.col("first"))
    names = F.array_sort(F.collect_list(label).over(group))
    branch = F.when((F.size(names) > 1) | (F.col("size") > 1), F.concat(F.lit("("), F.array_join(names, "|"), F.lit(")"))).otherwise(F.col("first"))
    named = save(numbered.select("host", "node", "first", "grade", branch.alias("branch")))
    one = literal.filter("grade is null").join(named.filter("grade is null").select("host", "node", F.col("first").alias("segment"), "branch"), ["host", "node", "segment"])
    many = literal.filter("grade is not null").join(named.filter("grade is not null").select("host", "node", "grade", "branch"), ["host", "node", "grade"])
    branches = save(one.select("host", "node", "segment", "branch").union(many.select("host", "node", "segment", "branch")))
    moved = rows.join(branches, ["host", "node", "segment"], "left")
    step = F.concat(F.lit("/"), F.coalesce("branch", F.lit("*")))
    return moved.withColumn("node", F.when(F.col("segment").isNull(), F.col("node")).otherwise(F.concat("node", step))).drop("segment", "branch")


def templates(urls: DataFrame) -> DataFrame:
    """``host, form, template, n, labelled, bad`` for every distinct form in ``urls (host, path, bad)``.

    ``bad`` is 1, 0 or null where unlabelled.
    """
    rows = urls.select("host", _form(F.col("path")).alias("form"), "bad")
    rows = rows.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    pieces = F.filter(F.split("form", "/"), lambda s: s != "")
    tree = save(rows.withColumns({"segments": pieces, "node": F.lit("")}))
    deepest = tree.agg(F.max(F.size("segments")).alias("d")).first()["d"] or 0
    for depth in range(min(deepest, LEVELS)):
        tree = save(_level(tree, depth, last=depth == LEVELS - 1 and deepest > LEVELS))
    return tree.select("host", "form", F.col("node").alias("template"), "n", "labelled", "bad")


def page_labels(pages: DataFrame, docs: DataFrame, labels: DataFrame, least_words: int = 5) -> DataFrame:
    """``page_id, bad`` of the pages that show lines of labelled documents.

    ``pages (page_id, html)``, ``docs (doc_id, text)``, ``labels (doc_id, toxic)``. Lines of fewer
    words, lines of several labelled documents (boilerplate) and null labels count for nothing.
    """

    def hashed(lines: Column) -> Column:
        clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
        return F.transform(F.filter(clean, lambda x: F.size(F.split(x, " ")) >= least_words), lambda x: F.xxhash64(x))

    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("bad"))
    # hashes, not texts, go to the join
    lines = docs.select("doc_id", hashed(F.split("text", "\n")).alias("hs")).join(known, "doc_id").select("doc_id", "bad", F.explode("hs").alias("h"))
    single = lines.groupBy("h").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.max("bad").alias("bad")).filter("d0 = d1")
    # written, so that the join below can split a paragraph that very many pages show
    single = save(single.select("h", "bad"))
    flat = F.regexp_replace(F.regexp_replace("html", r"\s+", " "), r"<script.*?</script>|<style.*?</style>", "")
    text = F.regexp_replace(flat, r"(?i)</?(p|br|li|h[1-6]|div|article)\b[^>]*>", "\n")
    plain = F.regexp_replace(text, r"<[^>]*>", "")
    for name, character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    shown = pages.filter("page_id is not null").select("page_id", F.explode(hashed(F.split(plain, "\n"))).alias("h"))
    votes = shown.join(single, "h").groupBy("page_id").agg(F.avg("bad").alias("share"))
    return votes.select("page_id", (F.col("share") >= 0.5).cast("int").alias("bad"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = (), reject: float = REJECT) -> DataFrame:
    """A verdict for every row of ``pages (page_id, url)``.

    ``labels (page_id, bad)`` says which pages are known to be bad (1) or good (0); a page with
    several labels is bad where one of them is. Returns ``page_id, host, path, rule, verdict,
    template, purity`` where purity is the template's smoothed share of good pages.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    tree = save(templates(parsed.join(known, "page_id", "left")))
    sums = tree.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    prior = (sums["b"] or 0) / sums["l"] if sums["l"] else 0.0
    by_template = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    rate = (F.col("b") + PRIOR_WEIGHT * prior) / (F.col("l") + PRIOR_WEIGHT)
    by_template = by_template.withColumn("purity", 1 - rate)
    scored = save(tree.select("host", "form", "template").join(save(by_template), ["host", "template"]).select("host", "form", "template", "purity"))
    out = parsed.withColumn("form", _form(F.col("path"))).join(scored, ["host", "form"], "left")
    rule, says = rule_columns(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("purity") <= 1 - reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "template", "purity")
