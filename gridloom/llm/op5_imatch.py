"""Document fingerprints by I-Match over randomised lexicon subsets. DataFrame operations only.

The lexicon is the terms within a band of inverse document frequency: from that of a term in a tenth
of all documents up to that of a term in one document. It is split into subsets by the terms' hashes, at
rates 1, 1/2, 1/4, ...; a document uses the two rates at which SUBSETS subsets hold about one of its
terms each. Every subset's distinct terms are sorted and hashed together, and the fingerprint is those
hashes in order. A change to a text changes only the subsets of the terms it touches, if those are read at its rates:
of n distinct terms at least 2 * SUBSETS, only those at the rate 2 ** -floor(log2(n / SUBSETS)) are (32 to 64, so half a
percent to one of 6,400), and texts that differ in others alone have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, read_documents

SUBSETS = 32
#: A term of more than this share of the documents (and of more than FEW) lies below the band.
COMMON, FEW = 0.1, 8
#: Hex digits of a subset's hash; a subset without terms is all EMPTY.
DIGITS = 6
EMPTY = "-" * DIGITS
SPACE = r"[\x20\x09-\x0D]+"
#: Ranges of ids a shuffle partition: documents next to each other in id order meet in one range.
RANGES = 4


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the lowered words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(F.lower(text), SPACE), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def common_terms(docs: DataFrame, text_col: str) -> list[int]:
    """Hashes of terms below the band. At most (mean distinct terms of a document) / COMMON of them, however many documents."""
    most = max(FEW, int(COMMON * docs.count()))
    counts = docs.select(F.explode(term_hashes(F.col(text_col))).alias("h")).groupBy("h").count()
    return sorted(r["h"] for r in counts.where(F.col("count") > most).select("h").collect())


def _in_rate(x: Column, level: Column) -> Column:
    """Whether the last `level` bits of a hash are 0."""
    return F.call_function("shiftleft", F.call_function("shiftrightunsigned", x, level), level) == x


def with_fingerprint(df: DataFrame, text: str, out: str, common: list[int]) -> DataFrame:
    """Adds `out`: struct(level, parts, terms), parts: SUBSETS hashes at the level and SUBSETS at the next; terms: the sorted terms of the level."""
    h, kept = f"_{out}_h", f"_{out}_k"
    level = F.when(F.size(h) < 2 * SUBSETS, F.lit(0)).otherwise(F.floor(F.log2(F.size(h) / SUBSETS) + 1e-9).cast("int"))
    df = df.withColumn(h, term_hashes(F.col(text))).withColumn(out, level)
    taking = F.filter(h, lambda x: _in_rate(x, F.col(out)))
    lexicon = F.array(*[F.lit(x) for x in common]) if common else F.array().cast("array<bigint>")
    df = df.withColumn(kept, F.array_sort(F.array_except(taking, lexicon)))

    return df.withColumn(out, F.struct(F.col(out).alias("level"), _parts(F.col(kept), F.col(out), 2).alias("parts"), F.col(kept).alias("terms"))).drop(h, kept)


def _parts(terms: Column, level: Column, rates: int) -> Column:
    """SUBSETS hashes of sorted terms at the level, and at each of the next up to so many rates."""

    def part(k: Column) -> Column:
        at = level + F.floor(k / SUBSETS).cast("int")
        own = F.filter(terms, lambda x: _in_rate(x, at) & (F.pmod(F.call_function("shiftrightunsigned", x, at), F.lit(SUBSETS)) == k % SUBSETS))
        return F.when(F.size(own) == 0, F.lit(EMPTY)).otherwise(F.substring(F.lpad(F.lower(F.hex(F.xxhash64(own))), 16, "0"), 1, DIGITS))

    return F.transform(F.sequence(F.lit(0), F.lit(rates * SUBSETS - 1)), part)


def as_string(fingerprint: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(fingerprint["level"])), 2, "0"), F.lit(":"), F.array_join(fingerprint["parts"], ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets, at rates that both have, in which either has a term; 1 if neither has any.

    Levels two or more apart are compared at the coarser of the two, whose terms the finer text has among its own.
    """
    first, second = (lambda x: F.slice(x["parts"], 1, SUBSETS)), (lambda x: F.slice(x["parts"], SUBSETS + 1, SUBSETS))
    step = a["level"] - b["level"]
    x = F.when(step == 0, a["parts"]).when(step == 1, first(a)).when(step == -1, second(a)).when(step > 1, first(a)).otherwise(_parts(a["terms"], b["level"], 1))
    y = F.when(step == 0, b["parts"]).when(step == 1, second(b)).when(step == -1, first(b)).when(step < -1, first(b)).otherwise(_parts(b["terms"], a["level"], 1))
    used = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    same = F.size(F.filter(used, lambda p: p["x"] == p["y"]))
    return F.when(F.size(used) > 0, same / F.size(used)).otherwise(F.when((a["level"] == b["level"]) & (a["parts"] == b["parts"]), 1.0).otherwise(0.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter of code points replaced by the start of the next
    document's (by id, null ids first, then text; after the last the first). A null text is empty; documents
    without terms in the band have an empty fingerprint, and two such are alike. Other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    common = common_terms(own, "text")
    n = RANGES * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = own.select(F.percentile_approx("id", [k / n for k in range(1, n)], 100 * n).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    number = F.lit(0) if not cuts else F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id"))), F.lit(0))
    own = own.withColumn("range", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(number))

    # first document of each range, for the last one of the range before it: one row a range
    first = own.groupBy("range").agg(F.min(F.struct("id", "text")).alias("h")).select("range", F.col("h.text").alias("text"))
    first = with_fingerprint(first, "text", "mark", common)
    ring = Window.orderBy("range")
    every = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = first.select("range", *(F.coalesce(F.lead(c).over(ring), F.first(c).over(every)).alias(f"head_{c}") for c in ("text", "mark")))

    line = Window.partitionBy("range").orderBy("id", "text")
    rows = own.withColumn("next", F.lead("text").over(line))
    rows = with_fingerprint(rows, "text", "mark", common).withColumn("next_mark", F.lead("mark").over(line))
    rows = rows.join(bounded(heads, 2000), "range", "left")
    rows = rows.withColumn("next", F.coalesce("next", "head_text")).withColumn("next_mark", F.coalesce("next_mark", "head_mark"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next", F.lit(1), quarter)))
    rows = with_fingerprint(rows.select("id", "n_chars", "edited", "mark", "next_mark"), "edited", "edited_mark", common)
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("mark")).alias("fingerprint"), as_string(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_documents(spark, sf_dir))
