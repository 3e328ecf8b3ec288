"""Queries of the names, keys and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlake.functions import identity as I
from scanlake.functions.arrays import rounded
from scanlake.queries import register
from scanlake.session import table

ENDS = ["", "-Bold", "Bold", "_ExtraLight", "-SemiBoldIt", "Italic-Italic", "-400", "Light-Oblique", "-It", "BoldItalic-It", "_Thin_italic", "-it", "RomanIt"]
NAMES_SQL = f"n AS (SELECT p_partkey, replace(p_brand, '#', '') || ([{', '.join(repr(x) for x in ENDS)}])[1 + p_partkey % {len(ENDS)}] || ([{', '.join(repr(x) for x in ENDS)}])[1 + p_size % {len(ENDS)}] AS name, (1 + p_size % 9) * 100 AS weight FROM part)"


def names(spark, sf_dir):
    end = lambda c: F.element_at(F.array(*map(F.lit, ENDS)), (1 + F.col(c) % len(ENDS)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), end("p_partkey"), end("p_size")).alias("name"), ((1 + F.col("p_size") % 9) * 100).cast("int").alias("weight"))


def first_of(value: str, suffixes: list[str]) -> str:
    """SQL: the first of the suffixes that the value ends in, whatever their case, or null."""
    return f"list_filter([{', '.join(repr(x.lower()) for x in suffixes)}], lambda s: suffix(lower({value}), s))[1]"


ITALICS = ["-italic-italic", "_italic_italic", "-italic", "_italic", "italic", "-oblique", "_oblique", "oblique"]


@register(
    "explicit_weight",
    f"""WITH RECURSIVE {NAMES_SQL},
    i AS (SELECT p_partkey, name, weight, name AS base, 0 AS k FROM n UNION ALL
      SELECT p_partkey, name, weight, CASE WHEN {first_of('base', ITALICS)} IS NOT NULL THEN left(base, length(base) - length({first_of('base', ITALICS)})) WHEN suffix(base, 'It') AND length(base) > 2 THEN left(base, length(base) - 2) ELSE left(base, length(base) - 3) END, k + 1
      FROM i WHERE {first_of('base', ITALICS)} IS NOT NULL OR (suffix(base, 'It') AND length(base) > 2) OR suffix(lower(base), '-it')),
    b AS (SELECT p_partkey, name, weight, rtrim(arg_max(base, k), '-_') AS base FROM i GROUP BY ALL),
    w AS (SELECT p_partkey, name, weight, base AS core, 0 AS k FROM b UNION ALL
      SELECT p_partkey, name, weight, left(core, length(core) - length(cut)), k + 1 FROM (SELECT *, coalesce(list_filter([{', '.join(repr(x.lower()) for w in I.WEIGHT_WORDS for x in ('-' + w, '_' + w, w))}], lambda s: suffix(lower(core), s) AND (s[1] IN ('-', '_') OR length(core) > length(s)))[1], {first_of('core', [m + x for x in I.WEIGHT_NUMBERS for m in '-_'])}) AS cut FROM w) WHERE cut IS NOT NULL),
    c AS (SELECT p_partkey, name, weight, rtrim(arg_max(core, k), '-_') AS core FROM w GROUP BY ALL)
    SELECT p_partkey, name, core || '-' || weight || CASE WHEN contains(lower(name), 'italic') OR contains(lower(name), 'oblique') OR suffix(name, 'It') OR suffix(lower(name), '-it') THEN 'Italic' ELSE '' END AS explicit FROM c""",
)
def explicit_weight(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", "name", I.explicit_weight(F.col("name"), F.col("weight")).alias("explicit"))


@register(
    "full_keys",
    f"""WITH {NAMES_SQL}, t AS (SELECT n.*, CASE weight WHEN 100 THEN 'kern|nolig' WHEN 200 THEN 'salt' WHEN 300 THEN 'salt|salt' ELSE '' END AS tags, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 7) || '.00' ELSE '' END AS version, name || CASE WHEN p_partkey % 2 = 0 THEN '|salt' ELSE '' END AS ps FROM n),
    v AS (SELECT *, CASE WHEN version = '' THEN ps ELSE string_split(ps, '|')[1] || '|version=' || version || CASE WHEN contains(ps, '|') THEN '|salt' ELSE '' END END AS k FROM t)
    SELECT p_partkey, k || CASE tags WHEN 'kern|nolig' THEN '|kern|nolig' WHEN '' THEN '' ELSE CASE WHEN suffix(k, '|salt') THEN '' ELSE '|salt' END END || CASE WHEN weight > 500 THEN '[wght=' || weight || ',opsz=' || (p_partkey % 4 + 0.5) || ']' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '|vintage=w' || p_partkey % 10 ELSE '' END AS key FROM v""",
)
def full_keys(spark, sf_dir):
    d, n = names(spark, sf_dir), F.col("p_partkey")
    tags = F.when(F.col("weight") == 100, "kern|nolig").when(F.col("weight") == 200, "salt").when(F.col("weight") == 300, "salt|salt").otherwise("")
    axes = F.when(F.col("weight") > 500, F.array(F.struct(F.lit("wght").alias("tag"), F.col("weight").cast("double").alias("value")), F.struct(F.lit("opsz").alias("tag"), (n % 4 + 0.5).alias("value"))))
    key = I.full_key(F.concat("name", F.when(n % 2 == 0, "|salt").otherwise("")), tags, F.when(n % 5 == 0, F.concat(F.lit("w"), (n % 10).cast("string"))), axes, F.when(n % 3 != 0, F.concat((n % 7).cast("string"), F.lit(".00"))).otherwise(""))
    return d.select("p_partkey", key.alias("key"))


@register(
    "optical_sizes",
    f"""WITH {NAMES_SQL}, k AS (SELECT p_partkey, name || CASE p_partkey % 4 WHEN 0 THEN '|opsz' || weight WHEN 1 THEN '|opsz9.5' WHEN 2 THEN '|opszx' ELSE '' END AS key FROM n)
    SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN string_split(key, '|opsz')[1] ELSE key END AS base, CASE WHEN p_partkey % 4 < 2 THEN CAST(string_split(key, '|opsz')[2] AS DOUBLE) END AS opsz FROM k""",
)
def optical_sizes(spark, sf_dir):
    k = F.col("p_partkey") % 4
    key = F.concat("name", F.when(k == 0, F.concat(F.lit("|opsz"), F.col("weight").cast("string"))).when(k == 1, "|opsz9.5").when(k == 2, "|opszx").otherwise(""))
    return names(spark, sf_dir).select("p_partkey", I.optical_size(key).alias("o")).select("p_partkey", "o.base", F.col("o.opsz").cast("double").alias("opsz"))


@register(
    "root_families",
    f"WITH f AS (SELECT p_partkey, p_name || ([' Display', ' Caption', '', ' SmText', ' Subhead', ' Text'])[1 + p_size % 6] AS family, p_name AS other, p_partkey % 2 = 0 AS italic FROM part) SELECT p_partkey, CASE WHEN suffix(family, ' Text') THEN family ELSE other END AS root, suffix(family, ' Text') OR italic AS major FROM f",
)
def root_families(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, (" Display", " Caption", "", " SmText", " Subhead", " Text"))), (1 + F.col("p_size") % 6).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", end).alias("family"), F.col("p_name").alias("other"), (F.col("p_partkey") % 2 == 0).alias("italic"))
    return d.select("p_partkey", I.root_family(F.col("family")).alias("root"), I.is_major_difference(F.col("family"), F.col("italic"), F.col("other"), F.lit(False)).alias("major"))


@register("sequence_keys", "SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: printf('%04X', ord(c))), '_') AS seq_key FROM documents WHERE n_chars < 400 AND text <> ''")
def sequence_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars < 400 AND text <> ''").select("doc_id", I.sequence_key(F.col("text")).alias("seq_key"))


@register(
    "windows_text",
    f"""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN ord(c) <= 127 OR ord(c) BETWEEN 160 AND 255 THEN printf('%02X', ord(c)) ELSE coalesce(([{', '.join(repr(f'{b:02X}') for b in I.WINDOWS.values())}])[list_position([{', '.join(map(str, I.WINDOWS))}], ord(c))], '3F') END), '')) AS encoded FROM documents WHERE text <> ''""",
)
def windows_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.md5(F.hex(I.windows_bytes(F.col("text"))).cast("binary")).alias("encoded"))


@register("cut_texts", "SELECT doc_id, md5(substr(text, 1, CAST(len(list_filter(range(1, 101), lambda i: strlen(substr(text, 1, i)) <= 100 AND i <= length(text))) AS BIGINT))) AS start FROM documents")
def cut_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(I.cut_bytes(F.col("text"), 100)).alias("start"))


@register("narrow_ends", "SELECT conv_id, turn, right(text, 1) IN ('.', ',', ':', ';') AS narrow FROM conversations")
def narrow_ends(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", I.ends_narrow(F.col("text")).alias("narrow"))


@register("manifest_headers", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 AND s_nationkey = 7 THEN 7 END AS sequences FROM supplier")
def manifest_headers(spark, sf_dir):
    k, n = F.col("s_suppkey") % 3, F.col("s_nationkey").cast("string")
    header = F.when(k == 0, F.concat(F.lit("seqs="), n, F.lit(" th=240"))).when(k == 1, F.concat(F.lit("fonts=5 seqs="), n, F.lit("  th=240"))).otherwise(F.concat(F.lit("th=240 seqs="), n))
    return table(spark, sf_dir, "supplier").select("s_suppkey", I.manifest_sequences(header, 240, 7).alias("sequences"))


@register(
    "matrix_products",
    "WITH m AS (SELECT event_id, value / 100 AS a, CAST(event_id % 5 - 2 AS DOUBLE) AS b, CAST(user_id % 3 + 1 AS DOUBLE) AS c FROM events) SELECT event_id, round(a * b + 2 * c, 6) AS m0, round(a * c + 2 * 1.5::DOUBLE, 6) AS m1, round(0.5::DOUBLE * b + 3 * c, 6) AS m2, round(0.5::DOUBLE * c + 3 * 1.5::DOUBLE, 6) AS m3, round(b * b + c * c + 7, 6) AS m4, round(b * c + c * 1.5::DOUBLE + b, 6) AS m5 FROM m",
)
def matrix_products(spark, sf_dir):
    v, b, c = F.col("value") / 100, F.col("event_id") % 5 - F.lit(2.0), F.col("user_id") % 3 + F.lit(1.0)
    one = F.lit
    m = I.concatenated([v, one(2.0), one(0.5), one(3.0), b, c], [b, c, c, one(1.5), one(7.0), b])
    return table(spark, sf_dir, "events").select("event_id", *[F.round(x, 6).alias(f"m{k}") for k, x in enumerate(m)])


@register(
    "norm_gradients",
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS z, list_transform(range(1, len(embedding) + 1), lambda i: CAST(i % 5 - 2 AS DOUBLE)) AS d FROM embeddings), s AS (SELECT *, sqrt(list_sum(list_transform(z, lambda v: v * v))) AS n, list_sum(list_transform(range(1, len(z) + 1), lambda i: z[i] * d[i])) AS dot FROM e) SELECT vec_id, list_transform(range(1, len(z) + 1), lambda i: round((d[i] - z[i] * dot / (n * n)) / n, 6)) AS gradient FROM s",
)
def norm_gradients(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("z"), F.transform("embedding", lambda _, i: ((i + 1) % 5 - 2).cast("double")).alias("d"))
    e = e.withColumn("norm", F.sqrt(F.aggregate("z", F.lit(0.0), lambda acc, x: acc + x * x)))
    return e.select("vec_id", F.transform(I.norm_gradient(F.col("z"), F.col("norm"), F.col("d")), lambda x: rounded(x, 6)).alias("gradient"))
