"""Operator 8: I-Match fingerprints over randomised lexicon subsets (DataFrame operations only)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import words

#: The band of inverse document frequency, as shares of all documents that hold a term.
RAREST, COMMONEST = 0.002, 0.3
#: Randomised lexicons, besides the whole band.
LEXICONS = 16
EMPTY = "--------"
#: Bytes of text of a range of documents that follow each other, about, and most ranges.
RANGE_BYTES, MOST_RANGES = 128 << 20, 4096


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text, sorted."""
    return F.sort_array(F.array_distinct(F.transform(words(text), lambda x: F.xxhash64(x))))


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> list[int]:
    """Hashes of the terms whose share of documents lies in the band.

    Document frequencies are counted by term over all documents, combined before the shuffle. What comes to the driver is
    bounded: a document of t distinct terms holds up to t of them, and each is in ``rarest`` of all documents, so that
    there are mean(t) / rarest at most, whatever the corpus.
    """
    n = docs.count()
    held = docs.select(F.explode(terms(F.col("text"))).alias("term"))
    band = held.groupBy("term").count().where((F.col("count") >= rarest * n) & (F.col("count") <= commonest * n))
    return sorted(r["term"] for r in band.select("term").collect())


def signatures(found: str, lexicon: list[int]) -> Column:
    """LEXICONS + 1 signatures from a column of a text's sorted term hashes; all EMPTY for a text without words, none for others.

    A text's terms are those of the band, or all of its own where it has none in the band. The last signature is the hash
    of all of them. Each other belongs to a family of lexicons, every next one a random half of the one before; the
    smallest one that still holds a term of the text counts, and the signature is the hash of the terms in it. The
    families are drawn independently, by a hash of the term and the family's number.
    """
    band = f"filter(all_, h -> h IN ({', '.join(f'{x}L' if x > -(1 << 63) else 'bigint(-9223372036854775808)' for x in lexicon)}))" if lexicon else "slice(all_, 1, 0)"
    short = "substring(lower(lpad(hex({}), 16, '0')), 1, 8)".format
    smallest = "filter(t, (h, i) -> shiftright(drawn[i], bits) = 0)"
    drawn = "transform(t, h -> shiftrightunsigned(xxhash64(h, {}), 1))".format
    each = [short(f"transform(array({drawn(k)}), drawn -> transform(array(length(bin(array_min(drawn)))), bits -> xxhash64({smallest}))[0])[0]") for k in range(LEXICONS)]
    signed = f"IF(size(t) = 0, array_repeat('{EMPTY}', {LEXICONS + 1}), array({', '.join(each)}, {short('xxhash64(t)')}))"
    return F.expr(f"transform(transform(array({found}), all_ -> transform(array({band}), b -> IF(size(b) > 0, b, all_))[0]), t -> {signed})[0]")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures, 0 if one text alone has no word; 1 for equal fingerprints."""
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != EMPTY)))
    some = F.size(F.filter(pairs, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY)))
    return F.when(a == b, 1.0).otherwise(same.cast("double") / some)


def in_turn(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """Adds to every row the text and signatures of the next by descending doc_id, after the last those of the first.

    Rows are dealt by ranges of doc_id, whose number follows the bytes of text unless ``groups`` gives it; an id whose rows
    fill several ranges is cut by the hash of its texts, so neither null ids (which come last) nor the rows of one id
    meet in one task. Every bound is a row that exists: the first of its range, which goes to the range before it too; the
    first of all goes to the last range. Rows of one id go by the hash of their text.
    """
    d = docs.withColumns({"id_": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "tie_": F.xxhash64("body")})
    at, least = F.struct("id_", "tie_"), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fine = max(groups or least, MOST_RANGES)
    row = d.agg(F.sum(F.octet_length("body")).alias("bytes"), F.max(at).alias("top"), F.percentile_approx("id_", [k / fine for k in range(1, fine)], 10_000).alias("cuts")).first()
    groups = groups or min(MOST_RANGES, max(least, -(-(row["bytes"] or 0) // RANGE_BYTES)))
    cuts = [row["cuts"][k * fine // groups - 1] for k in range(1, groups)] if row["cuts"] else []
    hot = {x: m for x, m in Counter(cuts).items() if m > 1}
    bounds = [(x, (1 << 63) - 1) for x in set(cuts) - set(hot)]
    if hot:
        part = F.floor((F.col("tie_") / F.lit(2.0**64) + 0.5) * F.element_at(F.create_map(*[F.lit(y).cast("long") for x in hot.items() for y in x]), F.col("id_")))
        own = d.select("id_", "tie_").where(F.col("id_").isin(list(hot)))
        bounds += [(r["id_"], r["tie_"]) for r in own.groupBy("id_", part.alias("part")).agg(F.max("tie_").alias("tie_")).collect()]
    bound = F.array(*[F.struct(F.lit(x).cast("long").alias("id_"), F.lit(t).cast("long").alias("tie_")) for x, t in sorted(bounds)])
    first = F.col("id_").isin(list(set(cuts) - set(hot))) | (F.array_contains(bound, at) if hot else F.lit(False))
    d = d.withColumn("range_", F.size(F.filter(bound, lambda b: b < at)) if bounds else F.lit(0))
    none = F.array().cast("array<struct<r: int, carried: int>>")
    goes = lambda r, carried: F.array(F.struct(r.cast("int").alias("r"), F.lit(carried).alias("carried")))
    before = F.when(first, goes(F.col("range_") + 1, 1)).otherwise(none)
    top = row["top"] or (0, 0)
    around = F.when((F.col("id_") == top[0]) & (F.col("tie_") == top[1]), goes(F.lit(0), 1)).otherwise(none)
    dealt = d.withColumn("to_", F.explode(F.concat(goes(F.col("range_"), 0), before, around))).withColumns({"r_": F.col("to_.r"), "carried_": F.col("to_.carried")})
    order = Window.partitionBy("r_").orderBy("carried_", F.col("id_").desc(), F.col("tie_").desc())
    after = dealt.withColumn("after_", F.lead(F.struct("body", "sig")).over(order)).where("carried_ = 0")
    return after.select(*docs.columns, F.col("after_.body").alias("next_body"), F.col("after_.sig").alias("next_sig"))


def fingerprint(docs: DataFrame, lexicon: list[int]) -> DataFrame:
    """doc_id, body (null text: empty), sig of every row of doc_id, text; other columns are not carried.

    Texts are read whole; an empty text has EMPTY signatures; repeated rows are returned each; no rows for no rows.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn("found", terms(F.col("body")))
    return found.withColumn("sig", signatures("found", lexicon)).drop("found")


def compare_edited(docs: DataFrame, groups: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's.

    Null or empty text: an empty text, all of whose signatures are EMPTY. Texts are read whole. A single document is
    its own next. Repeated rows are returned each; an empty table gives no rows; other columns are not carried.
    """
    band = lexicon(docs.select("text"))
    d = in_turn(fingerprint(docs, band), groups).withColumn("n_chars", F.length("body").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("body", F.lit(1), F.length("body") - cut), F.substring("next_body", F.lit(1), cut)))
    d = d.withColumn("edited_found", terms(F.col("edited"))).withColumn("edited_sig", signatures("edited_found", band))
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sig", "").alias("fingerprint"), F.array_join("edited_sig", "").alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
