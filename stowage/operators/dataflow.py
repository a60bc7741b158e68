"""Dataflow operators: stages over contexts with errors as data, chains, merges, grep."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.schemas import ERROR

Stage = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Stages in order; ``a | b`` composes."""

    def __init__(self, *stages: Stage) -> None:
        self.stages = stages

    def __call__(self, frame: DataFrame) -> DataFrame:
        return reduce(DataFrame.transform, self.stages, frame)

    def __or__(self, other: Stage) -> Pipeline:
        return Pipeline(*self.stages, *(other.stages if isinstance(other, Pipeline) else (other,)))


def contexts(frame: DataFrame, key: str) -> DataFrame:
    """``frame`` with what stages carry: input, stage data and errors."""
    return frame.withColumns({"input": F.col(key).cast("string"), "stage_data": F.create_map().cast("map<string,string>"), "errors": F.array().cast(f"array<{ERROR}>")})


def should_continue() -> Column:
    return ~F.exists("errors", lambda e: e["fatal"])


def stage(name: str, column: str, value: Column, error: Column | None = None, fatal: bool = False) -> Stage:
    """Set ``column`` where no fatal error came before; where ``error`` is not null, record it once instead."""

    def run(frame: DataFrame) -> DataFrame:
        go = should_continue()
        failed = error if error is not None else F.lit(None).cast("string")
        entry = F.array(F.struct(F.lit(name).alias("stage"), F.lit("stage").alias("kind"), failed.alias("message"), F.lit(fatal).alias("fatal")))
        old = F.col(column) if column in frame.columns else F.lit(None)
        return frame.withColumns({column: F.when(go & failed.isNull(), value).otherwise(old), "errors": F.when(go & failed.isNotNull(), F.concat("errors", entry)).otherwise(F.col("errors"))})

    return run


def merge(base: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Base contexts with those of ``new`` on the same input: new fields win, stage data merges, errors append."""
    right = new.select("input", *[F.col(c).alias(f"_{c}") for c in (*fields, "stage_data", "errors")]).dropDuplicates(["input"])
    rows = base.join(right, "input", "left")
    chosen = {c: F.coalesce(f"_{c}", c) for c in fields}
    data = F.map_concat(F.map_filter("stage_data", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("_stage_data"), k), F.lit(False))), F.coalesce("_stage_data", F.create_map().cast("map<string,string>")))
    errors = F.concat("errors", F.coalesce("_errors", F.array().cast(f"array<{ERROR}>")))
    return rows.select("input", *[v.alias(c) for c, v in chosen.items()], data.alias("stage_data"), errors.alias("errors"))


def chain_batch(frame: DataFrame, stages: list[Stage], fields: list[str]) -> DataFrame:
    """Each stage runs on the contexts without fatal errors; the results merge into all of them."""
    for own in stages:
        frame = merge(frame, own(frame.where(should_continue())), fields)
    return frame


def group(frame: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """One row a key: the first context and how many there are."""
    return frame.groupBy(F.col(key).alias("group_key")).agg(F.min_by(F.struct(position, *columns), position).alias("first"), F.count("*").alias("members")).select("group_key", *[F.col(f"first.{c}").alias(c) for c in (position, *columns)], "members")


def grep(texts: DataFrame, key: list[str], text: str, pattern: str, context: int = 0) -> DataFrame:
    """Matching lines: 1-based number, offset in bytes, the line, the first match in it, and ``context`` lines around it.

    A text's lines and their running offsets are made once, inside the row; only matches leave it.
    """
    lines = F.split(F.col(text), "\n")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    offsets = F.aggregate(F.col("_lines"), start, lambda acc, x: F.struct((acc["at"] + F.octet_length(x) + 1).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
    around = lambda i: F.slice(F.col("_lines"), F.greatest(i + 1 - context, F.lit(1)), 1 + context + F.least(i, F.lit(context)))
    numbered = F.transform(F.col("_lines"), lambda x, i: F.struct((i + 1).cast("long").alias("line_number"), x.alias("line"), i.alias("i")))
    kept = texts.select(*key, lines.alias("_lines")).withColumn("_hits", F.filter(numbered, lambda n: n["line"].rlike(pattern))).where(F.size("_hits") > 0)
    found = F.transform("_hits", lambda n: F.struct(n["line_number"], F.get(F.col("_offsets"), n["i"]).alias("line_offset"), n["line"], around(n["i"]).alias("context")))
    rows = kept.withColumn("_offsets", offsets).select(*key, F.explode(found).alias("m"))
    named = rows.select(*key, "m.line_number", "m.line_offset", "m.line", F.regexp_extract("m.line", f"({pattern})", 1).alias("matched"), "m.context")
    return named if context else named.drop("context")


def batch(frame: DataFrame, run: Stage, most: int) -> DataFrame:
    """``run`` over at most ``most`` partitions at a time, results by input; a bad input is a row with errors, the others go on."""
    return run(frame.repartition(most, "input")).orderBy("input")


def extract_result(members: DataFrame) -> DataFrame:
    """Extraction results: what was written, how much, or why not."""
    return members.select("path", F.col("error").isNull().alias("ok"), F.length("content").cast("long").alias("bytes"), "error")


def metadata_result(entries: DataFrame) -> DataFrame:
    return entries.select("path", "content_type", "size", "hash")


class PipelineRegistry:
    """Pipelines by name; a name registered again is replaced."""

    def __init__(self) -> None:
        self.held: dict[str, Stage] = {}

    def register(self, name: str, pipeline: Stage) -> None:
        self.held[name] = pipeline

    def names(self) -> list[str]:
        return sorted(self.held)

    def run(self, name: str, frame: DataFrame) -> DataFrame:
        if name not in self.held:
            raise KeyError(f"no pipeline named {name}")
        return self.held[name](frame)
