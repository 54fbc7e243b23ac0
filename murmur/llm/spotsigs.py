"""Document fingerprints by SpotSigs, in built-in functions only.

A signature is a chain of content words that follows a common word: after each
common word that a content word follows, that word and the next content words.
A fingerprint is a text's distinct signatures, hashed and sorted. Texts with
words but no chain have one signature, all their words; texts without words have
none. Likeness is the Jaccard similarity of two sets of signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import staged

#: Common words of English, German, French and Spanish that start chains; A-Z in any case.
COMMON = (
    "the of and to in a is that it for on was be with as this by are at from an "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine "
    "de la le et les des en un du une que est pour dans qui par sur "
    "el los las del se con por una su al es lo como más"
).split()
CHAIN = 2
#: Hexadecimal digits of a signature.
DIGITS = 12

_MARK = "\t"  # stands for a common word; white space is one space by then, so no text holds it


def signatures(text: Column) -> Column:
    """The distinct signatures of a text, sorted; null and texts without words have none."""
    # one space between words; a common word and the space after it become a mark
    plain = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    marked = F.regexp_replace(plain, f"(?<![^ ])(?i:{'|'.join(dict.fromkeys(COMMON))})(?: |$)", _MARK)
    word = f"[^ {_MARK}]+"
    chain = word + f" {_MARK}*{word}" * (CHAIN - 1)
    found = F.regexp_extract_all(marked, F.lit(f"{_MARK}(?=({chain}))"), 1)
    found = F.transform(found, lambda c: F.substring(F.md5(F.translate(c, _MARK, "")), 1, DIGITS))
    alone = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array(F.substring(F.md5(plain), 1, DIGITS)))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(alone)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def near_pairs(sets: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", sigs_col: str = "signatures") -> DataFrame:
    """(a, b, likeness) for fingerprints at least ``threshold`` alike, between representatives of equal sets.

    Sets are partitioned by length: partition k holds lengths from
    ``threshold`` ** -k on, so a set meets only its own partition and the next
    one. Within these, sets meet on the signatures of their prefix, of which two
    similar sets share one; rarest signatures come first, so that prefixes hold
    no signature that is common if they can. Equal sets are one class, named by
    its smallest id; empty sets and null ids are left out.
    """
    rows = sets.select(F.col(id_col).alias("id"), F.col(sigs_col).alias("sigs")).where("id is not null and size(sigs) > 0")
    rows = rows.groupBy("sigs").agg(F.min("id").alias("id"))
    rows = staged(rows.withColumn("n", F.size("sigs")), "sets")
    seen = rows.select("id", "n", F.explode("sigs").alias("sig"))
    often = seen.groupBy("sig").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = seen.join(often, "sig")
    # signatures of one set alone cannot be shared, but stand first in its prefix
    shared = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("sigs"))
    prefix = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int")
    left = F.greatest(F.lit(0), prefix - (F.col("n") - F.size("sigs")))
    heads = shared.select("id", "n", F.explode(F.slice("sigs", F.lit(1), left)).alias("s")).select("id", "n", "s.sig")
    level = F.floor(F.log(F.col("n")) / -F.log(F.lit(threshold)) + 1e-9).cast("int")
    heads = heads.withColumn("level", level)
    other = heads.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "sig", F.explode(F.array("level", F.col("level") - 1)).alias("level"))
    met = heads.withColumnRenamed("id", "a").join(other, ["sig", "level"])
    small, large = F.least("n", "n_b"), F.greatest("n", "n_b")
    order = (F.col("n") < F.col("n_b")) | (F.col("n") == F.col("n_b")) & (F.col("a") < F.col("b"))
    met = met.where(order & (small >= threshold * large)).select("a", "b").distinct()
    met = met.join(rows.select(F.col("id").alias("a"), F.col("sigs").alias("sigs_a")), "a")
    met = met.join(rows.select(F.col("id").alias("b"), F.col("sigs").alias("sigs_b")), "b")
    met = met.withColumn("likeness", likeness(F.col("sigs_a"), F.col("sigs_b")))
    return met.where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, before, most): for each doc_id the one before it, and that one's most characters.

    The first follows the last. Ids are sorted by range, and only the ends of the
    ranges, one row a partition, come to the driver.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    ids = staged(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    ends = ids.groupBy("part").agg(F.max(F.struct("doc_id", "n_chars")).alias("last")).orderBy("part").collect()
    spark = docs.sparkSession
    borders = [(r["part"], ends[i - 1]["last"]["doc_id"], ends[i - 1]["last"]["n_chars"]) for i, r in enumerate(ends)]
    borders = spark.createDataFrame(borders, "part int, last_id long, last_n int")
    order = Window.partitionBy("part").orderBy("doc_id")
    rows = ids.withColumn("before", F.lag("doc_id").over(order)).withColumn("most", F.lag("n_chars").over(order))
    rows = rows.join(borders, "part")
    return rows.select("doc_id", F.coalesce("before", "last_id").alias("before"), F.coalesce("most", "last_n").alias("most"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text with its end edited, and how alike they are.

    The edited text has its last quarter of code points replaced by the first as
    many of the next document by doc_id; the first follows the last. A null text
    is empty. Rows that repeat a doc_id have the same next document; of next
    documents that repeat theirs, the one that starts least counts. A row without
    a doc_id has no next: its end is cut, and its ``near_next`` is null.
    """
    plain = id_col == "doc_id" and dict(docs.dtypes)[id_col] == "bigint"
    # a column under its own name, so that both uses of the texts below are one and the same plan
    key = F.col(id_col) if plain else F.col(id_col).cast("long").alias("doc_id")
    rows = docs.select(key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named, alone = rows.where("doc_id is not null"), rows.where("doc_id is null")
    before = neighbours(named.select("doc_id", F.length("text").alias("n_chars")))
    heads = named.join(before, "doc_id").select(
        F.col("before").alias("id_before"),
        F.struct(F.expr("substring(text, 1, most div 4)").alias("head"), signatures(F.col("text")).alias("next_signatures")).alias("next"),
    )
    heads = heads.groupBy("id_before").agg(F.min("next").alias("next"))
    # both joins read the texts as one exchange by doc_id
    rows = named.join(heads, F.col("doc_id") == F.col("id_before"), "left").drop("id_before")
    rows = rows.unionByName(alone.withColumn("next", F.lit(None).cast(rows.schema["next"].dataType)))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, n_chars - n_chars div 4), substring(coalesce(next.head, ''), 1, n_chars div 4))")
    rows = rows.select("doc_id", "n_chars", "text", edited.alias("edited"), F.col("next.next_signatures").alias("next_signatures"))
    rows = rows.select("doc_id", "n_chars", "edited", "next_signatures", signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("other"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("other", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_signatures")).alias("near_next"),
        F.size("own").cast("long").alias("n_signatures"),
    )
