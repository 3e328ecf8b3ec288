"""Operator 9: format-preserving Feistel pseudonyms for personal data (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import carried

ROUNDS = 8
#: Characters that are permuted among themselves: those of e-mail names, and those of hexadecimal keys.
NAME, HEXADECIMAL = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"), ("0123456789abcdef",)
#: Steps of a walk along a permutation to the next value of the right form; a step misses it with 5 % or less.
WALK = 24
ISO, SSN = r"\d{4}-\d{2}-\d{2}(?![\d\-])", r"\d{3}-\d{2}-\d{4}(?![\d\-])"
#: North American numbers in groups of 3, 3 and 4, and those with a leading 0 or 00 in any groups.
NANP = r"(?:1[ .\-])?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!-?[\p{L}\p{N}])"
TRUNK = r"\(?0(?:(?=[1-9]\d{0,4}\)?[ .\-/]\(?\d)(?:[ .\-/]?\(?\d\)?){8,11}|0(?=[1-9]\d{0,4}[ .\-/]\(?\d)(?:[ .\-/]?\(?\d\)?){7,13})(?![\p{L}\p{N}])"
NATIONAL = rf"(?<![\p{{L}}\p{{N}}])(?<!\d[\-/.,])(?:{NANP}|{TRUNK})"
#: What is looked for, tried in this order at each place of a text.
PATTERNS = [
    r"[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){0,126}\.\p{L}{2,}",
    r"(?<![\p{L}\p{N}])[0-9a-f]{32,128}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)",
    r"(?<![\p{L}\p{N}])\+\(?\d(?:[ .\-/]?\(?\d\)?){6,14}(?!\d)",
    r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)(?!\p{L})",
    rf"(?<![\p{{L}}\p{{N}}\-/.]){ISO}",
    r"(?<![\p{L}\p{N}\-/.])\d{1,2}([/.])\d{1,2}\1\d{4}(?!\d)",
    rf"(?<![\p{{L}}\p{{N}}\-]){SSN}",
    NATIONAL,
    # cards: a run of groups with 13 digits or more, in which they are looked for by whole groups
    rf"(?<![\p{{L}}\p{{N}}])(?=\d(?:[ \-]?\d){{12}})\d++(?![\p{{L}}\p{{N}}])(?:(?:-| (?!{ISO}|{SSN}|{NANP}))\d++(?![\p{{L}}\p{{N}}]))*+",
]
ANY = "|".join(PATTERNS)
#: Days of an era; dates are permuted within theirs, counted from 1900-01-01. The square of DAY_SIDE.
DAY_SIDE = 270
ERA = DAY_SIDE * DAY_SIDE


def feistel(a: Column, b: Column, a_size: Column, b_size: Column, tweak: Column, key: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs with 0 <= a < a_size and 0 <= b < b_size (longs), one for each tweak."""

    def turn(s: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), tweak, i.cast("string"), s["b"].cast("string")), 256)
        mixed = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
        side = F.when(i % 2 == 0, a_size).otherwise(b_size)
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(mixed, side), side).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.transform(F.array(value), f)[0]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def permute(number: Column, kind: str, key: str) -> Column:
    """A string of up to 36 digits permuted among those of its length."""
    n = F.length(number)
    left = F.floor(n / 2).cast("int")
    return bound(
        feistel(F.substring(number, F.lit(1), left).cast("long"), F.substring(number, left + 1, n).cast("long"), power(left), power(n - left), F.concat(F.lit(kind), n.cast("string")), key),
        lambda s: F.concat(F.lpad(s["a"].cast("string"), left, F.lit("0")), F.lpad(s["b"].cast("string"), n - left, F.lit("0"))),
    )


def luhn(number: Column, first_doubled: int) -> Column:
    """Luhn sum from the right; the last digit is doubled if first_doubled is 1."""
    each = F.transform(F.reverse(F.split(number, "")), lambda c, i: bound(c.cast("int") * (1 + (i + first_doubled) % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def refill(shape: Column, number: Column) -> Column:
    """The text with its digits, in order, replaced by those of number."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike(r"^\d$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(number, s["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step)["out"]


def spelled(text: Column, alphabets: tuple[str, ...], kind: str, key: str) -> Column:
    """A text permuted among those of its length with characters of the same alphabets at the same places; others stay.

    Each half in turn is shifted, character by character, by a digest of the other, which whoever has the key can take back.
    """

    def shift(chars: Column, by: Column, i: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.length(chars) / 32).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda k: F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), k.cast("string"), by), 512)), "")

        def one(c: Column, n: Column, stream: Column) -> Column:
            out = c
            for letters in alphabets:
                at = F.instr(F.lit(letters), c)
                step = F.conv(F.substring(stream, 4 * n + 1, F.lit(4)), 16, 10).cast("int")
                out = F.when(at > 0, F.substring(F.lit(letters), F.pmod(at - 1 + step, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
            return out

        return bound(stream, lambda x: F.array_join(F.transform(F.split(chars, ""), lambda c, n: F.when(c != "", one(c, n, x)).otherwise("")), ""))

    left = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), left).alias("a"), F.substring(text, left + 1, F.length(text)).alias("b"))
    return bound(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda s, i: F.struct(s["b"].alias("a"), shift(s["a"], s["b"], i).alias("b"))), lambda s: F.concat(s["a"], s["b"]))


def walked(first: Column, step, right) -> Column:
    """The first value of the right form along a permutation: within that form this is a permutation too."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda s, _: F.when(right(s), s).otherwise(step(s)))


def shifted(day: Column, key: str) -> Column:
    """The pseudonym of a date: another of its era, with a year of 1 to 9999."""
    side = F.lit(DAY_SIDE).cast("long")

    def step(d: Column) -> Column:
        def at(n: Column) -> Column:
            place, era = F.pmod(n, F.lit(ERA)), F.floor(n / ERA)
            return bound(
                feistel(F.floor(place / DAY_SIDE), F.pmod(place, F.lit(DAY_SIDE)), side, side, F.concat(F.lit("day"), era.cast("string")), key),
                lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (era * ERA + s["a"] * DAY_SIDE + s["b"]).cast("int")),
            )

        return bound(F.datediff(d, F.lit("1900-01-01").cast("date")), at)

    return walked(step(day), step, lambda d: F.year(d).between(1, 9999))


def formed(day: Column, month: Column, year: Column, least_day: Column, most_day: Column, most_month: Column, kind: Column, key: str) -> Column:
    """struct(day, month, year): the pseudonym of a date among the dates of its 200 years with days and months in these limits."""
    span, months = 200, most_month.cast("long")
    block = F.floor(year / span)

    def step(s: Column) -> Column:
        pair = feistel(s["day"] - least_day, F.pmod(s["year"], F.lit(span)) * months + s["month"] - 1, (most_day - least_day + 1).cast("long"), months * span, F.concat_ws(":", F.lit("date"), kind, block.cast("string")), key)
        return bound(pair, lambda p: F.struct((p["a"] + least_day).cast("long").alias("day"), (F.pmod(p["b"], months) + 1).cast("long").alias("month"), (block * span + F.floor(p["b"] / months)).cast("long").alias("year")))

    def right(s: Column) -> Column:
        y = s["year"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(s["month"] == 2, F.when(leap, 29).otherwise(28)).when(s["month"].isin(4, 6, 9, 11), 30).otherwise(31)
        return (y >= 1) & (s["day"] <= last)

    return walked(step(F.struct(day.cast("long").alias("day"), month.cast("long").alias("month"), year.cast("long").alias("year"))), step, right)


def social(m: Column, key: str) -> Column:
    """Another valid social security number: areas 001 to 899 but 666, groups from 01, serial numbers from 0001."""
    n = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    area = n[0] - 1 - F.when(n[0] > 666, 1).otherwise(0)
    rest = (n[1] - 1) * 9999 + n[2] - 1
    return bound(
        feistel(area, rest, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), F.lit("ssn"), key),
        lambda s: F.concat_ws("-", F.lpad((s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")),
    )


def card(m: Column, key: str) -> Column:
    """Another card of as many digits with a right check digit, written alike."""
    number = digits(m)
    return bound(permute(F.substring(number, F.lit(1), F.length(number) - 1), "card", key), lambda body: refill(m, F.concat(body, F.pmod(-luhn(body, 1), F.lit(10)).cast("string"))))


def cards(run: Column, key: str) -> Column:
    """struct(text, n): a run of digit groups with its cards replaced, and their number.

    A card is the longest sequence of whole groups from a place on with 13 to 19 digits and a right check digit; places are
    tried from the left.
    """

    def is_card(d: Column) -> Column:
        return F.length(d).between(13, 19) & (luhn(d, 0) % 10 == 0)

    def scan(g: Column) -> Column:
        def part(i: Column, j: Column) -> Column:
            return F.array_join(F.slice(g, i + 1, j - i + 1), "")

        def step(s: Column, i: Column) -> Column:
            ends = F.filter(F.sequence(i, F.least(i + 18, F.size(g) - 1)), lambda j: bound(digits(part(i, j)), is_card))
            last = bound(F.array_max(ends), lambda j: F.when(j.isNull(), F.struct(F.concat(s["text"], g[i]).alias("text"), s["n"].alias("n"), s["skip"].alias("skip"))).otherwise(F.struct(F.concat(s["text"], bound(part(i, j), lambda m: card(m, key))).alias("text"), (s["n"] + 1).alias("n"), (j + 1).alias("skip"))))
            return F.when(i < s["skip"], s).otherwise(last)

        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("skip")), step, lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n")))

    return bound(F.regexp_extract_all(run, F.lit(r"\d+[ \-]?"), F.lit(0)), scan)


def joined(text: Column, pattern: str, stands: Column) -> Column:
    """The text with what stands for them (structs with text) in place of the matches of pattern."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), stands, lambda a, b: F.concat(a, F.coalesce(b["text"], F.lit("")))), "")


def places(stands: Column) -> Column:
    return F.aggregate(stands, F.lit(0), lambda acc, x: acc + x["n"])


def pseudonym(m: Column, key: str) -> Column:
    """struct(text, n): what stands for a candidate and the number of replaced places in it; the candidate itself where its validation fails.

    All are permutations within the format. E-mail names and keys of 32 or more hexadecimal digits: letter by letter within
    their alphabets (the domain stays; a name with other than ASCII characters has no bounded alphabet and becomes ``u``
    and 32 digits of a digest). Telephone numbers (with a leading + in any groups, NANP, TRUNK) keep what is before their
    last 10 digits (all permuted if fewer). IPv4 addresses, cards with a right check digit (kept right) and valid social
    security numbers stay valid. A date stays a date that is written and read alike: year first and day first with two
    digits each share a permutation, so those stay linked; fields of one digit keep one, and a month-first date (its day
    above 12) has a day above 12 again.
    """
    name = F.substring_index(m, "@", 1)
    unbounded = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws(":", F.lit(key), name), 256), 1, 32))
    email = F.concat(F.when(name.rlike(r"^[\x00-\x7F]*$"), spelled(name, NAME, "name", key)).otherwise(unbounded), F.lit("@"), F.substring_index(m, "@", -1))

    def changed(new: Column) -> Column:
        return bound(new, lambda x: F.struct(x.alias("text"), (x != m).cast("int").alias("n")))

    def phone(x: Column) -> Column:
        return bound(digits(x), lambda d: bound(F.least(F.lit(10), F.length(d)), lambda tail: refill(x, F.concat(F.substring(d, F.lit(1), F.length(d) - tail), permute(F.substring(d, F.length(d) - tail + 1, tail), "phone", key)))))

    octets = F.split(m, r"\.")
    ip_ok = F.forall(octets, lambda x: x.cast("int") <= 255)
    word = F.lit(65536).cast("long")
    ip = bound(
        feistel(octets[0].cast("long") * 256 + octets[1].cast("long"), octets[2].cast("long") * 256 + octets[3].cast("long"), word, word, F.lit("ip"), key),
        lambda s: F.concat_ws(".", *[x.cast("string") for side in ("a", "b") for x in (F.floor(s[side] / 256), s[side] % 256)]),
    )
    iso = m.try_cast("date")
    mark = F.regexp_extract(m, r"[/.]", 0)

    def written(parts: Column) -> Column:
        day_first = parts[1].cast("int") <= 12
        day, month, year = F.when(day_first, parts[0]).otherwise(parts[1]), F.when(day_first, parts[1]).otherwise(parts[0]), parts[2]
        iso_form = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
        two = day_first & (F.length(day) == 2) & (F.length(month) == 2)
        least = F.when(day_first, 1).otherwise(13)
        most_day, most_month = F.when(F.length(day) == 1, 9).otherwise(31), F.when(F.length(month) == 1, 9).otherwise(12)
        kind = F.concat(F.when(day_first, "d").otherwise("m"), F.length(day).cast("string"), F.length(month).cast("string"))

        def spell(d: Column) -> Column:
            new_day, new_month = F.lpad(d["day"].cast("string"), F.length(day), F.lit("0")), F.lpad(d["month"].cast("string"), F.length(month), F.lit("0"))
            return F.concat(F.when(day_first, new_day).otherwise(new_month), mark, F.when(day_first, new_month).otherwise(new_day), mark, F.lpad(d["year"].cast("string"), 4, "0"))

        own = bound(formed(day.cast("int"), month.cast("int"), year.cast("int"), least, most_day, most_month, kind, key), spell)
        return F.when(iso_form.isNull(), m).when(two, bound(shifted(iso_form, key), lambda d: F.concat(F.date_format(d, "dd"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "yyyy")))).otherwise(own)

    ssn_ok = ~m.rlike(r"^(000|666|9)|-00-|-0000$")

    def phones(run: Column) -> Column:
        return bound(F.transform(F.regexp_extract_all(run, F.lit(NATIONAL), F.lit(0)), lambda x: F.struct(phone(x).alias("text"), F.lit(1).alias("n"))), lambda s: F.struct(joined(run, NATIONAL, s).alias("text"), places(s).alias("n")))

    one = (
        F.when(m.contains("@"), email)
        .when(m.rlike(r"^[0-9a-f]{32,}$"), spelled(m, HEXADECIMAL, "hex", key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(ssn_ok, social(m, key)).otherwise(m))
        .when(m.startswith("+") | m.rlike(f"^(?:{NATIONAL})$"), phone(m))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(ip_ok, ip).otherwise(m))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(iso.isNotNull(), F.date_format(shifted(iso, key), "yyyy-MM-dd")).otherwise(m))
        .when(m.rlike(r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}$"), bound(F.split(m, r"[/.]"), written))
    )
    return bound(one, lambda x: F.when(x.isNotNull(), changed(x)).otherwise(bound(cards(m, key), lambda c: F.when(c["n"] > 0, c).otherwise(phones(m)))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with their text's personal data replaced under a secret key, and n_found, the number of replaced places.

    A text is cut at the candidates and put together again with what stands for them; texts without a digit or @ skip
    that. Equal values get equal pseudonyms everywhere, as the permutations depend on the key alone. Null text stays
    null, with 0 found. Texts are read whole, within their row; repeated rows are treated alike; an empty table gives no
    rows. A caller's column n_found comes back as ``carried`` names it.
    """
    held, given = carried(docs, tuple(c for c in docs.columns if c != "text"), ("text", "n_found"))
    names = dict(zip([c for c in docs.columns if c != "text"], given, strict=True))
    maybe = F.coalesce(F.col("text").rlike(r"@|\d|[0-9a-f]{32}"), F.lit(False))
    d = docs.select(held, "text", F.when(maybe, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("found"))
    d = d.withColumn("stands", F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key))))
    new = joined(F.col("text"), ANY, F.col("stands"))
    d = d.withColumn("n_found", F.when(F.col("stands").isNotNull(), places(F.col("stands"))).otherwise(0).cast("long"))
    d = d.withColumn("new", F.when(F.col("stands").isNotNull(), new).otherwise(F.col("text")))
    return d.select(*[F.col("new").alias("text") if c == "text" else names[c] for c in docs.columns], "n_found")


#: The query's key. A corpus gets a secret one of its own.
QUERY_KEY = "op9"


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY_KEY).select("doc_id", "text", "n_found")
