"""Queries of the training-data operators over the driver's tables, with their contracts' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import decontaminate, jaccard, langid, mixing, packing, pii, substrings, topk, toxicity, urls
from stowage.llm.common import in_fold, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, sf_dir, "documents")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    grammar = toxicity.fit(docs, labels, ~in_fold("doc_id", 4, 2))
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~in_fold("doc_id", 4, 2))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = mixing.score(docs, ~in_fold("doc_id", 5, 1))
    return scored.select("doc_id", in_fold("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def queries() -> dict:
    named = (op1_substring_dedup, op2_pii, op3_jaccard_join, op4_url_filter, op5_toxicity, op6_langid, op7_topk, op8_decontaminate, op9_lm_score, op10_packing)
    return {f.__name__: f for f in named}


UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD_SQL = f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
 s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) as sh from w),
 n as (select doc_id, count(*) as n from s group by doc_id),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
 l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
 r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b),
 m as (select a, min(b) as component_id from r group by a)
 select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from documents d left join n on n.doc_id = d.doc_id join m on m.a = d.doc_id"""

TOPK_SQL = """with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
 where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 p as (select q.vec_id as query_id, x.vec_id, cast(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) as bigint) as score from e q, e x where q.vec_id % 20 = 0 and x.vec_id <> q.vec_id),
 o as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p)
 select query_id, rank, vec_id, score from o where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can state; the others are held against plain Python in the tests."""
    return {"op3_jaccard_join": JACCARD_SQL, "op7_topk": TOPK_SQL}
