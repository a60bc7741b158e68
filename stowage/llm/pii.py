"""Personal data: exact base patterns, widened by bootstrapped contextual extraction. DataFrame functions only.

Base kinds are found by regular expressions; spans come from the lengths of the text between matches. The bootstrap
then looks at *mentions*: a word followed by an identifier-like token (with a digit or an at sign). A mention's lexical pattern is its
context word, with punctuation where that stands between (``token = "``), and its instance the token. Mentions that touch a base span
are seeds, and so are long hexadecimal keys, by their shape. Patterns and
instances form a bipartite graph that Spark scores in rounds: a pattern is as good as the share of its distinct instances that
are believed, an instance as its best pattern; instances of high-confidence patterns become spans of kind ``context``. Every round
judges all patterns anew, so instances found in one round support patterns in the next.

The expressions start only where a run of their first class starts or the last match ended, and repeat
possessively, so a long run of digits or letters costs linear time and no stack.

Defined cases: a null text counts as empty; repeated rows get the same spans each; an empty table gives no rows; columns
of the input other than doc_id and text are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import materialize, split_by_filter

# The patterns of the contract, with anchors that keep them linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "phone": "+"}  # a character that every match holds
KINDS = tuple(PATTERNS)
CONTEXT = "context"
# a word, and before it nothing but white space to the token that it introduces: a phone number with its blanks, or what holds a digit or an at sign
MENTION = r"(?<!\S)(\S++)\s++(?=(\+[0-9][\x20().0-9-]+[0-9](?!\S)|\S*[0-9@]\S*))"
OPAQUE = "^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"  # keys and tokens in hexadecimal: seeds by their shape
BLOCK = 256  # matches whose places are added up together

ROUNDS = 3
LEAST_SEEDS = 3  # believed distinct instances, summed, of a pattern that may be believed
CONFIDENCE = 0.8
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _located(text: Column, pattern: str, groups: int = 0) -> Column:
    """Array of (value, start, end, before, g1..) of all matches: starts add up the lengths of gaps and matches before.

    ``before`` is the last word of the gap. Matches are added up in blocks, so a text of many matches copies no array once for each.
    """
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(groups + 1)]
    gaps = F.split(text, pattern, -1)
    names = ["value", *[f"g{k}" for k in range(1, groups + 1)]]
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found[0])).alias("gap"), *[v.alias(n) for n, v in zip(names, found, strict=True)])
    row = "struct<value:string,start:int,end:int,before:string" + "".join(f",{n}:string" for n in names[1:]) + ">"

    def step(acc, s):
        start = acc["at"] + F.length(s["gap"])
        end = start + F.length(s["value"])
        last = F.regexp_extract(F.substring(s["gap"], -200, 200), r"(\S+)\s*$", 1) if groups else F.lit("")
        own = F.struct(s["value"].alias("value"), start.alias("start"), end.alias("end"), last.alias("before"), *[s[n].alias(n) for n in names[1:]])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    def block(acc, rows):
        own = F.aggregate(rows, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{row}>").alias("out")), step)
        return F.struct(own["at"].alias("at"), F.concat(acc["all"], F.array(own["out"])).alias("all"))

    n = F.size(found[0])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(zipped, k * BLOCK + 1, F.lit(BLOCK)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{row}>>").alias("all"))
    return F.when(n > 0, F.aggregate(blocks, first, block, lambda acc: F.flatten(acc["all"]))).otherwise(F.array().cast(f"array<{row}>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, p).cast("decimal(38,0)"), F.lit(0)) <= 255))
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind as (kind, start, end), in order."""
    found = F.filter(_located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    spans = F.transform(found, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    may = F.contains(text, F.lit(NEEDED[kind])) if kind in NEEDED else text.rlike("[0-9]")
    return F.when(may, spans).otherwise(F.array().cast(SPAN))


def _mentions(text: Column) -> Column:
    """Array of (context, token, start, end).

    The context is the word before the token, lower-cased and without outer punctuation; where that word is punctuation alone, as in
    ``key = "..."``, it is the word before it, the punctuation and what the token opens with.
    """
    outer = r"^[^\p{L}0-9]+|[^\p{L}0-9]+$"

    def mention(m):
        token, word = m["g2"], F.regexp_replace(F.lower(m["g1"]), outer, "")
        opened = F.regexp_extract(token, r"^[^\p{L}0-9+]+", 0)
        core = F.regexp_replace(token, r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$", "")
        start = m["end"] + F.length(opened)
        wide = F.concat_ws(" ", F.nullif(F.regexp_replace(F.lower(m["before"]), outer, ""), F.lit("")), m["g1"], opened)
        context = F.when(word != "", word).when(F.regexp_replace(m["before"], outer, "") != "", wide).otherwise("")
        return F.struct(context.alias("context"), core.alias("token"), start.alias("start"), (start + F.length(core)).alias("end"))

    found = F.transform(_located(text, MENTION, 2), mention)
    return F.filter(found, lambda m: (m["context"] != "") & ~m["context"].rlike("[0-9]") & (F.length(m["token"]) >= 4))


def believed_contexts(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Contexts that the pattern-instance graph gives high confidence; ``mentions`` has context, token and seed."""
    edges = materialize(mentions.groupBy("context", "token").agg(F.max("seed").alias("seed")), "pii-graph")
    edges = materialize(edges.select("context", "token", F.col("seed").cast("double").alias("seed")), "pii-edges")

    def judged(belief):
        patterns = belief.groupBy("context").agg(F.sum("belief").alias("support"), F.count("*").alias("n"))
        confidence = F.col("support") / (F.col("n") + 1)
        return patterns.where((F.col("support") >= LEAST_SEEDS) & (confidence >= CONFIDENCE)).select("context", confidence.alias("confidence"))

    belief = edges.withColumn("belief", F.col("seed"))
    for _ in range(rounds):
        instances = edges.join(judged(belief), "context").groupBy("token").agg(F.max("confidence").alias("best"))
        belief = materialize(edges.join(instances, "token", "left").select("context", "token", F.greatest("seed", F.coalesce("best", F.lit(0.0))).alias("belief")), "pii-belief")
    return judged(belief)


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, spans): spans by kind as listed, then start; one row for each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", F.sha2("text", 256).alias("text_hash"), *[base_spans(F.col("text"), k).alias(k) for k in KINDS], F.when(F.col("text").rlike("[0-9@]"), _mentions(F.col("text"))).otherwise(F.array().cast("array<struct<context:string,token:string,start:int,end:int>>")).alias("mentions"))
    rows = materialize(rows.select("doc_id", "text_hash", F.concat(*KINDS).alias("spans"), "mentions"), "pii-rows")
    touches = F.exists("spans", lambda s: (s["start"] < F.col("m.end")) & (s["end"] > F.col("m.start")))
    exploded = rows.where(F.size("mentions") > 0).select("doc_id", "text_hash", "spans", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.context", "m.token", "m.start", "m.end", touches.alias("base"), (touches | F.col("m.token").rlike(OPAQUE)).alias("seed"))
    contexts = believed_contexts(exploded.select("context", "token", "seed"))
    new = exploded.where("not base").join(contexts.select("context"), "context")
    added = new.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct(F.lit(CONTEXT).alias("kind"), "start", "end"))).alias("added"))
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text_hash"]
    joined = rows.select("doc_id", *keys, "spans").join(added.select(*keys, "added"), ["_id", "text_hash"], "left")
    return joined.select("doc_id", "text_hash", F.concat("spans", F.coalesce("added", F.array().cast(SPAN))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of ``find``."""
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda s: s["kind"] != CONTEXT)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``find`` in its text replaced by its kind in brackets; overlapping spans count as the first.

    Only texts that may hold a span, by a filter of fixed size over their ids, meet the spans; all others stay where they lie.
    """
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    spans = find(docs).select(named.alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_id", "_hash"])
    spans = materialize(spans, "pii-spans")
    clear, touched = split_by_filter(docs, spans.select(F.xxhash64("_id").alias("key")), "key", F.xxhash64(named))
    keyed = touched.withColumns({"_id": named, "_hash": F.sha2(F.coalesce("text", F.lit("")), 256)})
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], -s["less"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate(by_start, first, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.col("_spans").isNotNull(), rest).otherwise(F.col("text"))
    joined = keyed.join(spans, ["_id", "_hash"], "left").withColumn("text", text)
    return clear.unionByName(joined.select(*[F.col(f"`{c}`") for c in docs.columns]))
