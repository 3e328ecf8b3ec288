"""Catalog scan, identity keys, preference, structured selection and content groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.functions.text import has_variant_tag, key_version, key_weight_italic, normalize_family, segments

#: Fixed points of a key's preference score, and the feature tags that count against it.
KERN_POINTS, LIG_POINTS, SIZE_POINTS, VARIANT_POINTS = 4, 2, 1, -10
FEATURE_TAGS = ("onum", "lnum", "smcp", "c2sc", "swsh", "salt", "titl", "hist", "allcaps")


def is_feature_tag(segment: Column) -> Column:
    """A feature variant's tag, a stylistic set ``ssNN`` among them."""
    return segment.isin(*FEATURE_TAGS) | segment.rlike("^ss[0-9]{2}$")


def preference(key: Column, has_kern: Column) -> Column:
    """struct(version, score) by which entries of one name compare.

    Points for a key that says of kerning what its font has, for ligatures and for the text size; each feature variant and each
    weight instance counts against it.
    """
    variants = F.size(F.filter(segments(key), lambda s: is_feature_tag(s) | s.rlike("^wght[0-9]+$")))
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(has_kern != key.contains("nokern"), KERN_POINTS) + points(has_variant_tag(key, "lig"), LIG_POINTS) + points(key.contains("opsz=10"), SIZE_POINTS) + VARIANT_POINTS * variants
    return F.struct(key_version(key).alias("version"), score.alias("score"))


def best_by_preference(entries: DataFrame, keys: list[str], key: str, has_kern: str) -> DataFrame:
    """One entry a group: the highest version, then score, then the smallest key."""
    p = preference(F.col(key), F.col(has_kern))
    return entries.withColumn("p_", p).groupBy(*keys).agg(F.min_by(F.col(key), F.struct(-F.col("p_.version"), -F.col("p_.score"), F.col(key))).alias(key))


def select_by_criteria(entries: DataFrame, family: str, key: str, has_kern: str, weight: int | None = None, italic: bool | None = None, opsz: float | None = None, kern: bool | None = None, lig: bool | None = None) -> DataFrame:
    """The preferred entry among those that meet all the criteria given; none if none does (criteria are never relaxed).

    The family must be equal after normalisation; weight and slant are those of the key, and a key without them has none.
    An optical size must be equal, but for entries without one (column opsz null). Kerning and ligatures are tags that the
    key must have.
    """
    wi = key_weight_italic(F.col(key))
    ok = normalize_family(F.col("family")) == normalize_family(F.lit(family))
    if weight is not None:
        ok = ok & (wi["weight"] == weight)
    if italic is not None:
        ok = ok & (wi["italic"] == F.lit(italic))
    if opsz is not None:
        ok = ok & (F.col("opsz").isNull() | (F.col("opsz") == opsz))
    if kern is not None:
        ok = ok & has_variant_tag(F.col(key), "kern" if kern else "nokern")
    if lig is not None:
        ok = ok & has_variant_tag(F.col(key), "lig" if lig else "nolig")
    return best_by_preference(entries.where(ok), [], key, has_kern).where(F.col(key).isNotNull())


def dedup_by_key(entries: DataFrame, key: str, order: list) -> DataFrame:
    """The first entry of each key."""
    return entries.withColumn("k_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("k_ = 1").drop("k_")


def longest_match(rows: DataFrame, text: str, table: DataFrame, key: str, value: str, bound: int = 10_000) -> DataFrame:
    """Adds value of the longest key that the lower-cased text holds, the first of equally long ones; null without one.

    The table (ord, key, value) is a fixed dictionary of at most ``bound`` rows, which is checked before it is sent to every task.
    """
    words = table.orderBy(F.length(key).desc(), "ord").limit(bound + 1).collect()
    if len(words) > bound:
        raise ValueError(f"the dictionary has more than {bound} rows")
    literal = F.array(*[F.struct(F.lit(r[key]).alias("k"), F.lit(r[value]).alias("v")) for r in words])
    return rows.withColumn(value, F.get(F.filter(literal, lambda w: F.contains(F.lower(F.col(text)), w["k"])), F.lit(0))["v"])


def content_groups(items: DataFrame, seq: str, key: str, content: str) -> DataFrame:
    """(seq, glyph_id, hash, keys): one group per content of a sequence, numbered by the first key seen; registering a key twice changes nothing."""
    g = items.groupBy(seq, F.sha2(content, 256).alias("hash")).agg(F.sort_array(F.collect_set(key)).alias("keys"), F.min(key).alias("first_key"))
    w = Window.partitionBy(seq).orderBy("first_key", "hash")
    return g.select(seq, (F.row_number().over(w) - 1).alias("glyph_id"), "hash", "keys")


def prune_keys(groups: DataFrame, removed: DataFrame, key: str, keys: str = "keys") -> DataFrame:
    """Groups without the removed keys; a group that loses all stays, so that ids keep their meaning."""
    group = [c for c in groups.columns if c != keys]
    each = groups.select(*group, F.explode_outer(keys).alias(key)).join(removed.select(key, F.lit(True).alias("gone_")).distinct(), key, "left")
    return each.groupBy(*group).agg(F.sort_array(F.collect_list(F.when(F.col("gone_").isNull(), F.col(key)))).alias(keys))


def truncate_pairs(pairs: DataFrame, keys: list[str], value: str, order: list[str], limit: int) -> DataFrame:
    """The pairs of each key with the greatest absolute values, then by id; Spark prunes each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), *order)
    return pairs.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= limit).drop("k_")


def kern_lookup(wanted: DataFrame, glyph_pairs: DataFrame, class_pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds kern: the adjustment of (font, g1, g2), else that of the glyphs' classes, else 0."""
    c1 = classes.select("font", F.col("glyph").alias("g1"), F.col("class").alias("c1_"))
    c2 = classes.select("font", F.col("glyph").alias("g2"), F.col("class").alias("c2_"))
    d = wanted.join(glyph_pairs.select("font", "g1", "g2", F.col("value").alias("own_")), ["font", "g1", "g2"], "left").join(c1, ["font", "g1"], "left").join(c2, ["font", "g2"], "left")
    d = d.join(class_pairs.select("font", F.col("c1").alias("c1_"), F.col("c2").alias("c2_"), F.col("value").alias("cls_")), ["font", "c1_", "c2_"], "left")
    return d.select(*wanted.columns, F.coalesce("own_", "cls_", F.lit(0)).alias("kern"))


def support_mask(probes: DataFrame, keys: list[str], bit: str, supported: str) -> DataFrame:
    """Bit set of the probes that hold."""
    return probes.groupBy(*keys).agg(F.coalesce(F.bit_or(F.when(F.col(supported), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), F.col(bit)).cast("int"))), F.lit(0)).cast("int").alias("mask"))


def glyph_keys(groups: DataFrame, seq: str, keys: str = "keys") -> DataFrame:
    """(seq, glyph_id, place, key): the members of content groups, a row each, in their order."""
    return groups.select(seq, "glyph_id", F.posexplode(keys).alias("place", "key"))


def glyphs_of_keys(wanted: DataFrame, groups: DataFrame, seq: str, key: str) -> DataFrame:
    """Adds glyph_id, the (first) group of the sequence that the key belongs to; null without one."""
    one = glyph_keys(groups, seq).groupBy(seq, F.col("key").alias(key)).agg(F.min("glyph_id").alias("glyph_id"))
    return wanted.join(one, [seq, key], "left")


def keys_of_glyphs(wanted: DataFrame, groups: DataFrame, seq: str) -> DataFrame:
    """Adds keys, the members of the (seq, glyph_id) wanted; an empty list where there is no such group."""
    kind = dict(groups.dtypes)["keys"]
    return wanted.join(groups.select(seq, "glyph_id", "keys"), [seq, "glyph_id"], "left").withColumn("keys", F.coalesce("keys", F.array().cast(kind)))


def keys_of_sequences(groups: DataFrame, seq: str) -> DataFrame:
    """(seq, keys): all members of a sequence's groups, by group, then in their order; a key of two groups twice."""
    return glyph_keys(groups, seq).groupBy(seq).agg(F.transform(F.array_sort(F.collect_list(F.struct("glyph_id", "place", "key"))), lambda x: x["key"]).alias("keys"))


def known_keys(groups: DataFrame, seq: str) -> DataFrame:
    """(key): the members of any group, once each."""
    return glyph_keys(groups, seq).select("key").distinct()


#: What stands for the family of a group whose first member is unknown.
NO_FAMILY = (1 << 32) - 1


def families_of_glyphs(groups: DataFrame, families: DataFrame, seq: str, key: str, family: str) -> DataFrame:
    """(seq, glyph_id, family): that of each group's first member."""
    first = groups.select(seq, "glyph_id", F.get("keys", F.lit(0)).alias(key))
    one = families.groupBy(key).agg(F.min(family).cast("long").alias(family))
    return first.join(one, key, "left").select(seq, "glyph_id", F.coalesce(family, F.lit(NO_FAMILY)).alias(family))


def find_by_name(names: DataFrame, entries: DataFrame, name: str, key: str, has_kern: str) -> DataFrame:
    """Adds found: the entry whose key is the name (without its subset prefix), else the preferred one of that postscript name."""
    stripped = F.regexp_replace(name, r"^[^+]*\+", "")
    exact = entries.select(F.col(key).alias("stripped_")).distinct().withColumn("exact_", F.col("stripped_"))
    best = best_by_preference(entries, ["postscript_name"], key, has_kern).select(F.col("postscript_name").alias("stripped_"), F.col(key).alias("best_"))
    d = names.withColumn("stripped_", stripped).join(exact, "stripped_", "left").join(best, "stripped_", "left")
    return d.select(*names.columns, F.coalesce("exact_", "best_").alias("found"))


def correct_candidate(lines: DataFrame, entries: DataFrame, truth: str, key: str) -> DataFrame:
    """Adds correct_key, correct_score, correct_rank: the true font among a line's candidates (key, score), if the catalog has it.

    Where the candidates lack it, the rank and score recorded with the line (gt_rank, gt_score; both or neither) stand in.
    """
    stripped = F.regexp_replace(truth, r"^[^+]*\+", "")
    known = entries.select(F.col(key).alias("stripped_")).distinct().withColumn("known_", F.lit(True))
    d = lines.withColumn("stripped_", stripped).join(known, "stripped_", "left")
    place = F.array_position(F.transform("font_candidates", lambda c: c["key"]), F.col("stripped_"))
    d = d.withColumn("place_", F.when(F.col("known_") & (place > 0), place.cast("int")))
    recorded = F.col("known_") & F.col("gt_rank").isNotNull() & F.col("gt_score").isNotNull()
    listed = F.col("place_").isNotNull()
    rank = F.when(listed, F.col("place_")).when(recorded, F.col("gt_rank").cast("int"))
    score = F.when(listed, F.get("font_candidates", F.col("place_") - 1)["score"]).when(recorded, F.col("gt_score"))
    return d.select(*lines.columns, F.when(rank.isNotNull(), F.col("stripped_")).alias("correct_key"), score.alias("correct_score"), rank.alias("correct_rank"))


def without_ligatures(key: Column) -> Column:
    """Whether a key is that of a variant without ligatures."""
    return key.contains("nolig")


def is_ligature_case(sequence: Column, correct_key: Column, chosen_key: Column) -> Column:
    """Whether an observation with a ligature character tells two fonts apart of which one has ligatures and one has not."""
    return (without_ligatures(correct_key) != without_ligatures(chosen_key)) & sequence.rlike("[\ufb00-\ufb04]")


def with_ligature_cases(shown: DataFrame, rows: DataFrame, key: list[str], index: str, case: Column) -> DataFrame:
    """The rows shown, in order of index, and after them the ligature cases that aren't among them (column place)."""
    first = shown.select(*key, index).withColumn("shown_", F.lit(True))
    d = rows.join(first, [*key, index], "left").where(F.col("shown_") | case)
    w = Window.partitionBy(*key).orderBy(F.col("shown_").isNull(), index)
    return d.withColumn("place", F.row_number().over(w)).drop("shown_")


def overlap_mask(pairs: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """Bit set of the ligatures of which a pair of neighbouring letters overlaps: the first one's right edge (x_max) lies beyond the second one's left edge (x_min) placed at the first one's advance."""
    return support_mask(pairs.withColumn("overlaps_", F.coalesce(F.col("x_max") - (F.col("advance") + F.col("x_min")) > 0, F.lit(False))), keys, bit, "overlaps_")


def collapsed_mask(key: Column, supported: Column) -> Column:
    """The ligatures a variant's text is collapsed to: none for one without ligatures."""
    return F.when(without_ligatures(key), 0).otherwise(supported)


def fused_mask(key: Column, supported: Column, overlapping: Column) -> Column:
    """The ligatures whose letters touch in print: those that a text is collapsed to, and the supported ones whose letters overlap anyway."""
    return collapsed_mask(key, supported).bitwiseOR(supported.bitwiseAND(overlapping))


#: Fixed value: how far a three reaches below a nought, in noughts, in old-style figures.
OLD_STYLE = 0.15


def is_old_style(low_nought: Column, high_nought: Column, low_three: Column) -> Column:
    """Whether the three of a font reaches below its nought (lower and upper edges, upwards, in hundredths of an em)."""
    height = high_nought - low_nought
    return F.coalesce((height >= 1) & (low_nought - low_three > OLD_STYLE * height), F.lit(False))
