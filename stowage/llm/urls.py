"""URL filter: rules first, then the likelihood ratio of two smoothed variable-order Markov models.

Rules name a host with all its subdomains and the start of a path; the longest one that fits decides. URLs that a
rule decides train two character models, accepted and rejected: orders two, one and zero, mixed by Witten-Bell weights. All
other URLs are judged by the length-normalised difference of their log likelihoods against a threshold calibrated on
the ruled URLs. DataFrame functions only; both models are one array of ``CODES ** 3`` doubles, a fixed size, that every row
indexes, so scoring needs no shuffle.

Defined cases: a null URL, or one without ``://``, has empty host and path and an empty score 0; without ruled URLs of both
kinds the ratio is 0 and the method allows; repeated rows are judged once each; extra columns are kept by ``judge`` and
its own columns replace clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import materialize

# The rules of the contract, as (verdict, rule).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_"
CODES = len(ALPHABET) + 1  # 0: any other character
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OWN = ("host", "path", "rule", "verdict", "score")


def split_url(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def match_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Codes of each character after its two predecessors, as one number below CODES ** 3."""
    chars = F.split(F.concat(F.lit("^^"), host, F.translate(path, UPPER, LOWER), F.lit("$")), "")
    codes = F.transform(chars, lambda c: F.when(c == "", 0).otherwise(F.call_function("locate", c, F.lit(ALPHABET))))
    triples = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 2).alias("a"), F.slice(codes, 2, F.size(codes) - 2).alias("b"), F.slice(codes, 3, F.size(codes) - 2).alias("c"))
    return F.transform(triples, lambda t: t["a"] * (CODES * CODES) + t["b"] * CODES + t["c"])


def train(ruled: DataFrame) -> DataFrame:
    """One row with ``ratio``: array of CODES ** 3 log ratios (accepted over rejected) in hundredths, from ``ruled`` (verdict, grams)."""
    counts = ruled.select("verdict", F.explode("grams").alias("gram")).groupBy("verdict", "gram").agg(F.count("*").alias("n"))
    n = {v: F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)) for v in ("allow", "block")}
    # from here on at most CODES ** 3 rows
    grid = materialize(counts.groupBy("gram").agg(n["allow"].alias("n_allow"), n["block"].alias("n_block")), "url-grams")
    total = {v: grid.agg(F.coalesce(F.sum(f"n_{v}"), F.lit(0)).alias("n")).first()["n"] for v in ("allow", "block")}
    cells = ruled.sparkSession.range(0, CODES**3, 1, 1).select(F.col("id").alias("gram")).join(F.broadcast(grid), "gram", "left").fillna(0, ["n_allow", "n_block"])
    keys = {"ab": F.expr(f"gram div {CODES}"), "b": F.expr(f"(gram div {CODES}) % {CODES}"), "bc": F.expr(f"gram % {CODES * CODES}"), "c": F.expr(f"gram % {CODES}")}
    cells = cells.withColumns(keys)
    over = {k: Window.partitionBy(k) for k in keys}
    sums = {f"n_{k}_{v}": F.sum(f"n_{v}").over(over[k]) for k in ("bc", "ab", "c", "b") for v in total}
    cells = cells.withColumns(sums | {f"t_ab_{v}": F.count_if(F.col(f"n_{v}") > 0).over(over["ab"]) for v in total})
    # each pair stands in CODES cells
    cells = cells.withColumns({f"t_b_{v}": F.count_if(F.col(f"n_bc_{v}") > 0).over(over["b"]) / CODES for v in total})
    for v in total:
        p1 = (F.col(f"n_c_{v}") + 1.0) / float(total[v] + CODES)
        p2 = F.when(F.col(f"n_b_{v}") > 0, (F.col(f"n_bc_{v}") + F.col(f"t_b_{v}") * p1) / (F.col(f"n_b_{v}") + F.col(f"t_b_{v}"))).otherwise(p1)
        p3 = F.when(F.col(f"n_ab_{v}") > 0, (F.col(f"n_{v}") + F.col(f"t_ab_{v}") * p2) / (F.col(f"n_ab_{v}") + F.col(f"t_ab_{v}"))).otherwise(p2)
        cells = cells.withColumn(f"log_{v}", F.log(p3))
    known = total["allow"] > 0 and total["block"] > 0
    ratio = F.round(100 * (F.col("log_allow") - F.col("log_block"))).cast("int") if known else F.lit(0)
    pairs = cells.select("gram", ratio.alias("x")).agg(F.array_sort(F.collect_list(F.struct("gram", "x"))).alias("pairs"))
    return pairs.select(F.col("pairs.x").alias("ratio"))


def mean_ratio(found: Column, ratio: Column) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda acc, g: acc + F.element_at(ratio, (g + 1).cast("int")) / 100.0) / F.size(found)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the model's score (mean log ratio less the threshold)."""
    host, path = split_url(F.col("url"))
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in OWN])
    split = kept.withColumns({"host": host, "path": path})
    split = split.withColumn("_rule", match_rule(F.col("host"), F.col("path"), rules)).withColumn("_grams", grams(F.col("host"), F.col("path")))
    ruled = split.where("_rule is not null").select(F.col("_rule.verdict").alias("verdict"), F.col("_grams").alias("grams"))
    # CODES ** 3 whole numbers, whatever the input; as one constant they reach every row without a join
    model = F.split(F.lit(",".join(map(str, train(ruled).first()["ratio"]))), ",").cast("array<int>")
    known = ruled.select("verdict", mean_ratio(F.col("grams"), model).alias("x")).groupBy("verdict").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    by = {r["verdict"]: (r["mean"], r["sd"] + 1e-9) for r in known.collect()}  # two rows at most
    threshold = 0.0
    if len(by) == 2:
        (allow, allow_sd), (block, block_sd) = by["allow"], by["block"]
        threshold = (allow * block_sd + block * allow_sd) / (allow_sd + block_sd)
    judged = split.withColumn("score", F.when(F.col("host") == "", F.lit(0.0)).otherwise(mean_ratio(F.col("_grams"), model) - threshold))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0, "allow").otherwise("block"))
    return judged.withColumns({"rule": F.col("_rule.rule"), "verdict": verdict}).drop("_rule", "_grams")
