"""Near-duplicates by the Jaccard similarity of word shingle sets, every pair at or above a likeness: by SimHashes and anchors, the rest by keys of parts of the sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import Scratch, maybe_in
from scanlake.llm.graph import components
from scanlake.llm import simhash
from scanlake.llm.simhash import keep_one, shingles

WIDTH, LIKENESS = 5, 0.8
#: Members of a key that are compared with each other; those of larger ones are keyed once more.
SMALL = 32
#: Buckets in which the sets that hold a shingle are counted; the counts only order the shingles of a set.
BUCKETS = 1 << 18
#: Bits of the set of names that texts are compared with before they are shuffled.
ID_BITS = 1 << 20
#: Buckets of a set's sketch, and those of a set of LONG shingles or more.
SKETCH, LONG_SKETCH, LONG = 256, 1024, 2048


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted XXH64 (seed 42) of a text's distinct shingles."""
    from xxhash import xxh64_intdigest

    return np.array(sorted({xxh64_intdigest(x, 42) for x in shingles(text, width)}), dtype=np.uint64)


def print_of(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), 7) if len(own) else 0


def set_print(text: str | None, width: int = WIDTH) -> int:
    """What stands for a text's set of shingles; 0 for a text without words."""
    return print_of(shingle_set(text, width))


def set_simhash(own: np.ndarray) -> int:
    """The SimHash of a set's shingles."""
    return simhash.majority((own[a : a + 65536] for a in range(0, len(own), 65536)), len(own))


def sketch(own: np.ndarray) -> bytes:
    """How many shingles of a set lie in each of so many equal ranges of the hash."""
    size = LONG_SKETCH if len(own) >= LONG else SKETCH
    return np.minimum(np.bincount((own >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64), minlength=size), 65535).astype("<u2").tobytes()


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many shingles two sets share, by their sketches (rows of counts): the sum of the lesser counts. A full count bounds nothing."""
    size = min(a.shape[1], b.shape[1])
    a, b = (x.reshape(len(x), size, -1).astype(np.int64).sum(axis=2) for x in (a, b))
    return np.where((a >= 65535).any(axis=1) | (b >= 65535).any(axis=1), np.iinfo(np.int64).max, np.minimum(a, b).sum(axis=1))


def surveyed(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(fp, n, sketch, simhash) of every distinct set."""

    def run(batches):
        for batch in batches:
            own = [shingle_set(x, width) for x in batch.column("text").to_pylist()]
            fp, hashed = (pa.array(np.array([f(x) for x in own], np.uint64).view(np.int64)) for f in (print_of, set_simhash))
            yield pa.RecordBatch.from_arrays([fp, pa.array([len(x) for x in own], pa.int64()), pa.array([sketch(x) for x in own], pa.binary()), hashed], ["fp", "n", "sketch", "simhash"])

    return scratch.save(docs.select("text").mapInArrow(run, "fp bigint, n bigint, sketch binary, simhash bigint").dropDuplicates(["fp"]), "sketches")


def by_simhash(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v: the sets of one SimHash with the first of them, and the first ones of SimHashes that anchors link (see simhash.near_links)."""
    firsts = scratch.save(sketches.groupBy("simhash").agg(F.min("fp").alias("first")), "simhashes")
    same = sketches.join(firsts, "simhash").where("fp <> first").select(F.col("first").alias("u"), F.col("fp").alias("v"))
    own = lambda c: firsts.select(F.col("simhash").alias(c), F.col("first").alias(f"{c}_first"))
    near = simhash.near_links(firsts.select(F.col("simhash").alias("fp"))).join(own("u"), "u").join(own("v"), "v")
    return same.unionByName(near.select(F.least("u_first", "v_first").alias("u"), F.greatest("u_first", "v_first").alias("v")))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def size_class(n: int, likeness: float) -> int:
    """The class of a size; alike sets are of one class or of neighbouring ones."""
    return int(np.floor(np.log(n) / -np.log(likeness) + 1e-9))


def part_keys(own: np.ndarray, likeness: float, seed: int = 0) -> np.ndarray:
    """Keys of a set, of which two alike sets share one at least.

    Alike sets of up to ``most`` shingles differ in (1 - likeness) / (1 + likeness) of their sizes' sum at most. The hash range is
    cut into some more parts than that, so some parts are equal in both, and a key is the hash of all of a part's
    shingles. Parts without any count as keys only where a set has as many as the parts that must be equal, so that an
    equal part with shingles isn't sure. A set has keys for its class of sizes and for the next.
    """
    out = [np.empty(0, np.uint64)]
    if not len(own):
        return out[0]
    first, value = mixed(own, seed) >> np.uint64(32), mixed(own, 97)
    for c in (size_class(len(own), likeness), size_class(len(own), likeness) + 1):
        most = int(np.ceil(likeness ** -(c + 1) + 1e-6))
        apart = int((1 - likeness) / (1 + likeness) * 2 * most + 1e-9)
        if not apart:
            continue
        parts = apart + apart // 8 + 2
        at = ((first * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        keys = np.zeros(parts, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(keys, at, value)
        held = np.bincount(at, minlength=parts) > 0
        keys = mixed(keys ^ mixed(np.arange(parts, dtype=np.uint64), c + 1), seed + 1)
        out.append(keys if parts - held.sum() >= parts - apart else keys[held])
    return np.concatenate(out)


def keyed(docs: DataFrame, width: int, likeness: float) -> DataFrame:
    """(token, fp): the keys of every set, each set once a task."""

    def run(batches):
        seen: set[int] = set()

        def rows():
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    own = shingle_set(text, width)
                    name = print_of(own)
                    if name not in seen:
                        seen.add(name)
                        keys = part_keys(own, likeness)
                        yield np.stack([keys, np.full(len(keys), name, np.uint64)]).view(np.int64)

        yield from dealt(rows(), ["token", "fp"])

    return docs.select("text").mapInArrow(run, "token bigint, fp bigint")


def groups(batches, columns: list[str]):
    """The rows of each token as arrays, from rows sorted by token."""
    held = None
    for batch in batches:
        now = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
        held = now if held is None else np.concatenate([held, now], axis=1)
        if not held.shape[1]:
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            starts = np.flatnonzero(np.r_[True, held[0][1:cut] != held[0][: cut - 1]])
            for a, b in zip(starts, np.r_[starts[1:], cut], strict=True):
                if b - a > 1:
                    yield held[:, a:b]
            held = held[:, cut:]
    if held is not None and held.shape[1] > 1:
        yield held


def dealt(rows, names: list[str], once: bool = False):
    """Record batches of the arrays (columns by rows) that rows yields; with once, equal rows of a batch are one."""
    kept, n = [], 0

    def batch():
        all_ = np.concatenate(kept, axis=1)
        all_ = np.unique(all_, axis=1) if once else all_
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(all_)], names)

    for x in rows:
        kept.append(x)
        n += x.shape[1]
        if n >= 1 << 17:
            yield batch()
            kept, n = [], 0
    if n:
        yield batch()


def neighbours(tokens: DataFrame) -> DataFrame:
    """token, u, v: the pairs of neighbours by fingerprint within each token (token 0), and the members (u = v) of those with three or more."""

    def run(batches):
        def rows():
            for g in groups(batches, ["token", "fp"]):
                fp = g[1][np.r_[True, g[1][1:] != g[1][:-1]]]
                if len(fp) > 1:
                    yield np.stack([np.zeros(len(fp) - 1, np.int64), fp[:-1], fp[1:]])
                if len(fp) > 2:
                    yield np.stack([np.full(len(fp), g[0, 0]), fp, fp])

        yield from dealt(rows(), ["token", "u", "v"], once=True)

    return tokens.repartition("token").sortWithinPartitions("token", "fp").mapInArrow(run, "token bigint, u bigint, v bigint")


def others(members: DataFrame, small: int | None = None) -> DataFrame:
    """u, v: all pairs of a token's members (token, fp, root) that differ in root; of tokens with more than ``small`` members and several roots the members (u = v)."""

    def run(batches):
        def rows():
            for g in groups(batches, ["token", "root", "fp"]):
                _, root, fp = g
                starts = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
                if small and len(fp) > small:
                    if len(starts) > 1:
                        yield np.stack([fp, fp])
                    continue
                for k in range(1, len(starts)):
                    own = fp[starts[k] : starts[k + 1] if k + 1 < len(starts) else None]
                    before = fp[: starts[k]]
                    u, v = np.repeat(before, len(own)), np.tile(own, len(before))
                    yield np.stack([np.minimum(u, v), np.maximum(u, v)])

        yield from dealt(rows(), ["u", "v"], once=True)

    return members.repartition("token").sortWithinPartitions("token", "root", "fp").mapInArrow(run, "u bigint, v bigint").distinct()


def possible_within(members: DataFrame, likeness: float) -> DataFrame:
    """u, v: the pairs of a token's members (token, fp, root, n, sketch) that differ in root and that their sketches allow to be alike; the others are never rows."""

    def pairs(root, fp, n, counts):
        counts = np.stack([np.frombuffer(c, "<u2").reshape(SKETCH, -1).astype(np.int64).sum(axis=1) for c in counts])
        full = (counts >= 65535).any(axis=1)
        for k in range(1, len(fp)):
            other = np.flatnonzero(root[:k] != root[k])
            if len(other):
                most = np.minimum(counts[other], counts[k]).sum(axis=1)
                found = other[(most >= likeness / (1 + likeness) * (n[other] + n[k]) - 1e-9) | full[other] | full[k]]
                yield np.stack([np.minimum(fp[found], fp[k]), np.maximum(fp[found], fp[k])])

    def run(batches):
        def rows():
            held = [np.empty(0, np.int64)] * 4 + [np.empty(0, object)]
            for batch in batches:
                now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "root", "fp", "n")] + [np.array(batch.column("sketch").to_pylist() + [None], dtype=object)[:-1]]
                held = [np.concatenate(x) for x in zip(held, now, strict=True)]
                cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
                yield from each([x[:cut] for x in held])
                held = [x[cut:] for x in held]
            yield from each(held)

        def each(all_):
            starts = np.flatnonzero(np.r_[True, all_[0][1:] != all_[0][:-1]]) if len(all_[0]) else []
            for a, b in zip(starts, [*starts[1:], len(all_[0])], strict=True):
                if (all_[1][a:b] != all_[1][a]).any():
                    yield from pairs(*(x[a:b] for x in all_[1:]))

        yield from dealt(rows(), ["u", "v"], once=True)

    return members.repartition("token").sortWithinPartitions("token", "root", "fp").mapInArrow(run, "u bigint, v bigint").distinct()


def texts_of(fps: DataFrame, rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(fp, text): a text of each set wanted; other texts are left out before the shuffle."""
    needed = fps.join(firsts, "fp").select("fp", F.col("first.same_").alias("same_"))
    return rows.select("same_", "text").where(maybe_in(needed, "same_", ID_BITS)(F.col("same_"))).join(needed, "same_").dropDuplicates(["fp"]).select("fp", "text")


def rare_keys(texts: DataFrame, width: int, likeness: float) -> DataFrame:
    """(token, fp): the rarest shingles of each set, as many as make sure that two alike sets have a common one.

    With all sets in one order, two sets of a and b shingles that share s have a common one among the first a - s + 1
    and b - s + 1, and alike ones share likeness * a and likeness * b at least. Rare are those that few of these sets have,
    so that what many have in common comes last. BUCKETS counts come to the driver at most.
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(total, (shingle_set(text, width) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    counts = np.ones(BUCKETS, np.int32)
    for row in sums.groupBy(F.expr("bucket div 1024").alias("part")).agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).collect():
        counts[row["at"]] = np.minimum(row["n"], 1 << 30)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            token, fp = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for text, name in zip(batch.column("text").to_pylist(), batch.column("fp").to_pylist(), strict=True):
                own = shingle_set(text, width)
                order = np.lexsort((own, shared.value[(own & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                first = own[order[: len(own) - int(np.ceil(likeness * len(own) - 1e-9)) + 1]]
                token.append(first)
                fp.append(np.full(len(first), name, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(fp))], ["token", "fp"])

    return texts.mapInArrow(run, "token bigint, fp bigint")


def possible(pairs: DataFrame, sketches: DataFrame, likeness: float) -> DataFrame:
    """The pairs (u, v) that their sketches allow to be alike: a sketch is a small part of a set, and few other pairs pass."""

    def check(batches):
        for batch in batches:
            a, b = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("a", "b"))
            need = likeness / (1 + likeness) * (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) - 1e-9
            ok, sizes = np.zeros(len(a), bool), np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
            for size in np.unique(sizes, axis=0):
                some = np.flatnonzero((sizes == size).all(axis=1))
                x, y = (np.frombuffer(b"".join(c[some]), "<u2").reshape(len(some), -1) for c in (a, b))
                ok[some] = most_shared(x, y) >= need[some]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    own = lambda c, x: sketches.select(F.col("fp").alias(c), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(x))
    return pairs.join(own("u", "a"), "u").join(own("v", "b"), "v").mapInArrow(check, "u bigint, v bigint")


def alike(pairs: DataFrame, rows: DataFrame, firsts: DataFrame, width: int, likeness: float) -> DataFrame:
    """The pairs (u, v) whose sets have a Jaccard similarity of likeness or more, by the sets themselves; only their texts are shuffled."""

    def read(batches):
        for batch in batches:
            own = [shingle_set(x, width).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(own, pa.list_(pa.int64()))], ["fp", "own"])

    def check(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both >= likeness * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    sets = texts_of(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), rows, firsts).mapInArrow(read, "fp bigint, own array<bigint>")
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("own").alias("b")), "v")
    return both.mapInArrow(check, "u bigint, v bigint")


def near_links(rows: DataFrame, firsts: DataFrame, scratch: Scratch, width: int = WIDTH, likeness: float = LIKENESS) -> DataFrame:
    """Links (u, v) that join all sets (set_print, as fp) of rows (text, and same_, a name of the row) that are alike; firsts has fp and first.same_.

    Sets whose SimHashes are within simhash.THRESHOLD bits are found by anchors and compared. Sets alike at 0.8 are up to a quarter
    of the bits apart, which no covering reaches; the rest goes by keys, of which alike sets share one (see part_keys). A key's
    members are first compared in a chain, together with the pairs by SimHash, then, if there are SMALL at most, with all that are
    in another component by that; so a large group of near copies doesn't make all its pairs. Members of larger keys with several components, which texts that have a passage in common make, are keyed once
    more by their rarest shingles, and compared in chains and across components again. Pairs are compared by sketches, which
    leave out none that is alike, and those left by their sets.
    """
    sketches = surveyed(rows, width, scratch)
    near = scratch.save(neighbours(keyed(rows, width, likeness)), "near")

    def compared(pairs: DataFrame, name: str, sketched: bool = False) -> DataFrame:
        some = scratch.save(pairs if sketched else possible(pairs, sketches, likeness), f"possible_{name}")
        return scratch.save(alike(some, rows, firsts, width, likeness), f"alike_{name}")

    def rooted(members: DataFrame, stars: DataFrame) -> DataFrame:
        return members.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    # what links a component so far is one star, so later rounds have little left to do
    first = by_simhash(sketches, scratch).unionByName(near.where("token = 0").select("u", "v")).distinct()
    stars = components(compared(first, "chains"), scratch, "first_links")
    rest = scratch.save(others(rooted(near.where("token <> 0").select("token", F.col("u").alias("fp")), stars), SMALL), "rest")
    links = stars.unionByName(compared(rest.where("u <> v"), "others"))
    large = scratch.save(texts_of(rest.where("u = v").select(F.col("u").alias("fp")), rows, firsts), "large")
    again = scratch.save(neighbours(rare_keys(large, width, likeness)), "near_large")
    stars = components(links.unionByName(compared(again.where("token = 0").select("u", "v").distinct(), "chains_large")), scratch, "second_links")
    members = rooted(again.where("token <> 0").select("token", F.col("u").alias("fp")), stars).join(sketches.drop("simhash"), "fp")
    return stars.unionByName(compared(possible_within(members, likeness), "large", sketched=True))


def keep_unlike(docs: DataFrame, width: int = WIDTH, likeness: float = LIKENESS) -> DataFrame:
    """The rows of docs without near-duplicates at a Jaccard similarity of likeness of their shingles of width words.

    Which row stays: see keep_one. Exact up to hashes of 64 bits. Texts without words are one group; shorter texts than width
    words are one shingle. Texts are read whole; an empty table gives no rows.
    """

    def linked(rows, firsts, scratch):
        return near_links(rows, firsts, scratch, width, likeness)

    return keep_one(docs, lambda text: set_print(text, width), linked)
