"""From raw documents to tokens: language, near copies, repeated passages, mixture, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import bounded, read_documents, stashed
from gridloom.llm.op1_mixing import mix
from gridloom.llm.op4_bpe_codec import bpe_digest, tokenizer_path
from gridloom.llm.op6_minhash_dedup import near_duplicates
from gridloom.llm.op8_language_id import UNDETERMINED, identify, train
from gridloom.llm.op9_suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: In a text of so many letters a language that stands out shows; a shorter one may be made of words that all languages share.
LETTERS = 256
#: How far from an even guess (0) to a sure one (1) a score must lie at least.
LEAST = 1 / 15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those of at least LETTERS letters in which no learned language stands out."""
    model = train(docs)
    least = least_score(len(model.langs))
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < LETTERS
    return identify(docs.select(COLUMNS), model, keep=COLUMNS[1:]).where((F.col("lang_pred") != UNDETERMINED) & ((F.col("score") >= least) | short)).select(COLUMNS)


def least_score(langs: int) -> float:
    """Of n languages an even guess scores 1/n; of one language nothing can stand out, and all texts reach it."""
    even = 1 / max(1, langs)
    return even + LEAST * (1 - even)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(bounded(gone), "doc_id", "left_anti").select(COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from the text; a document that has nothing else stays with an empty text."""
    out = suffix_dedup(docs, keep=["lang", "source"], as_text=True)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents once, twice or not at all: the words that the mix takes, over its size, rounded by a seeded draw.

    Documents are told apart by id and content: one with a null id counts like any other, documents that share an id get
    copies each by its own words, and rows alike in every column get together the copies of all of them.
    """
    docs = docs.withColumn("content", F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in COLUMNS[1:])))
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id", "content"), F.lit(1 << 20)) / (1 << 20)
    taken = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.nullif("size", F.lit(0)) + draw)).otherwise(F.lit(0).cast("long"))
    copies = mix(docs, keep=["content"]).groupBy(F.col("doc_id").alias("id"), F.col("content").alias("hash")).agg(F.sum(taken).alias("copies"), F.count("*").alias("alike"))
    copies = bounded(stashed(copies.where("copies > 0")))
    found = docs.join(copies, docs["doc_id"].eqNullSafe(copies["id"]) & (docs["content"] == copies["hash"]))
    same = found.where("alike > 1").groupBy("doc_id", "content").agg(*(F.first(c).alias(c) for c in [*COLUMNS[1:], "copies"]))
    out = found.where("alike = 1").select(*COLUMNS, "copies").unionByName(same.select(*COLUMNS, "copies"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_tokens and the digests of the ids and of the text decoded from them."""
    return bpe_digest(docs, tokenizer_path)


STAGES = [("language ID", language), ("MinHash near-dedup", near_copies), ("suffix-array dedup", passages), ("mixing to target weights", mixture), ("BPE encoding and decoding", tokens)]

#: The near-duplicate and suffix stages have no SQL form; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stashed(docs)
    return docs
