"""Operator 2: SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm.common import Scratch
from scanlake.llm.graph import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Links join fingerprints at this many differing bits or fewer.
THRESHOLD = 3
#: Groups of an anchor above this size are compared by the bytes of the other half.
LARGE = 2048


def shingles(text: str | None, width: int = 3) -> list[bytes]:
    """Word shingles of a text, repeats included; a shorter text is one shingle, none if it has no word."""
    w = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if len(w) < width:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[k:] for k in range(width)), strict=False)))


def majority(hashes, n: int) -> int:
    """A bit is 1 if set in over half of n hashes, which come in arrays of some; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for h in hashes:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def simhash(parts: list[bytes]) -> int:
    """A bit is 1 if set in over half of the parts' XXH64 (seed 42); 0 without parts."""
    from xxhash import xxh64_intdigest

    return majority((np.array([xxh64_intdigest(x, 42) for x in parts[a : a + 65536]], dtype=np.uint64) for a in range(0, len(parts), 65536)), len(parts))


def text_print(text: str | None) -> int:
    return simhash(shingles(text))


def fingerprints(docs: DataFrame, of=text_print) -> DataFrame:
    """The columns of docs but text, and fp, of(text) as a signed long (by default the SimHash), of every row."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            fp = np.array([of(x) for x in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fp.view(np.int64))], [*rest, "fp"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text") + ", fp bigint")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every anchor near each fingerprint.

    Of two fingerprints at most 3 bits apart, one half differs in at most 1 bit. The anchors of a half are the words
    of the Hamming code of length 31 (a perfect code, covering radius 1) on its upper 31 bits: the nearest of one
    fingerprint is within 1 + 1 bits of the other. So each goes to the code words within 2 bits of each half, the
    word at its syndrome's bit and those two bits away whose places have that syndrome: 16 (1 for a code word).
    """
    index, out = [], []
    for side in (0, 1):
        half = (fp >> np.uint64(33 - 32 * side)) & np.uint64(0x7FFFFFFF)
        bits = (half[:, None] >> np.arange(31, dtype=np.uint64)) & np.uint64(1)
        syndrome = np.bitwise_xor.reduce(bits * np.arange(1, 32, dtype=np.uint64), axis=1).astype(np.int64)
        at = np.arange(len(fp))
        near = half ^ np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
        index.append(at)
        out.append(near << np.uint64(1) | np.uint64(side))
        for i in range(1, 32):
            j = syndrome ^ i
            ok = (j > i) & (syndrome > 0)
            word = half[ok] ^ np.uint64(1 << (i - 1)) ^ (np.uint64(1) << (j[ok] - 1).astype(np.uint64))
            index.append(at[ok])
            out.append(word << np.uint64(1) | np.uint64(side))
    return np.concatenate(index), np.concatenate(out)


def tree(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the fingerprints of a group as all its links would: each found once, by search from one to the next."""
    out, left = [], np.unique(fp)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= THRESHOLD
            if near.any():
                found, left = left[near], left[~near]
                out.append((np.full(len(found), x), found))
                queue.extend(found)
    return out


def compared(batches):
    """u, v: links among the fingerprints of each anchor; the rows come sorted by anchor."""
    held_a, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(a: np.ndarray, f: np.ndarray):
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        sizes = np.diff(np.r_[starts, len(a)])
        us, vs = [], []
        small = np.repeat(sizes <= 32, sizes)
        sa, sf, k = a[small], f[small], 1
        while len(sa) > k:
            same = np.flatnonzero(sa[k:] == sa[:-k])
            if not len(same):
                break
            near = same[np.bitwise_count(sf[same] ^ sf[same + k]) <= THRESHOLD]
            us.append(sf[near])
            vs.append(sf[near + k])
            k += 1
        for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
            group = f[s : s + n]
            if n <= LARGE:
                found = tree(group)
            else:  # of the other half, one byte at least is alike
                found, shift = [], 0 if a[s] & 1 == 0 else 32
                for byte in range(4):
                    own = (group >> np.uint64(shift + 8 * byte)) & np.uint64(255)
                    for x in np.unique(own):
                        found += tree(group[own == x])
            for u, v in found:
                us.append(u)
                vs.append(v)
        if us:
            pair = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=0) if sum(map(len, us)) else np.empty((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)), pa.array(pair[:, 1].copy().view(np.int64))], ["u", "v"])
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["u", "v"])

    for batch in batches:
        a, f = np.r_[held_a, batch.column("anchor").to_numpy()], np.r_[held_f, batch.column("fp").to_numpy().view(np.uint64)]
        if not len(a):
            continue
        cut = int(np.searchsorted(a, a[-1]))
        held_a, held_f = a[cut:], f[cut:]
        if cut:
            yield links(a[:cut], f[:cut])
    if len(held_a):
        yield links(held_a, held_f)


def near_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that join all that are within the threshold."""

    def dealt(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(fp), 8192):
                index, anchor = anchors(fp[k : k + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[k : k + 8192][index].view(np.int64))], ["anchor", "fp"])

    return prints.select("fp").mapInArrow(dealt, "anchor bigint, fp bigint").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compared, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row of doc_id, text.

    Copies share a fingerprint, so all that follows works on distinct ones with their smallest doc_id. Null or empty
    text: fingerprint 0, linked like any other. Null doc_id: in its component, never its name unless all are null.
    Repeated rows are returned each; an empty table gives no rows. Texts are read whole.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs.select("doc_id", "text")), "prints")
    first = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    part = components(near_links(first), scratch).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    named = first.join(part, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, of=text_print, linked=None) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row, that with the smallest doc_id.

    A null doc_id comes after all others; rows of one doc_id go by the hash of their text. linked gives the links (u, v)
    between fingerprints of(text), from docs, their first rows (fp, first: no_id, doc_id, text_) and a Scratch; by
    default SimHashes within the threshold. No component is read by one task: its first row is a minimum, combined
    before the shuffle. Null or empty texts are one group, like any equal texts. Texts are read whole; an empty table
    gives no rows; columns besides doc_id and text are returned as they are, whatever their names.
    """
    scratch, names = Scratch(docs.sparkSession), docs.columns
    # all columns of the caller's travel in one struct, so that none can meet one of these
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_"), F.struct(*[docs[f"`{c}`"] for c in names]).alias("row_"))
    rows = rows.withColumn("same_", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_").cast("string")))
    prints = scratch.save(fingerprints(rows.select("doc_id", "text_", "same_", "text"), of), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_", "same_")
    firsts = scratch.save(prints.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    links = linked(rows, firsts, scratch) if linked else near_links(firsts)
    part = components(links, scratch).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    named = firsts.join(part, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = scratch.save(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.same_").alias("same_")), "kept")
    scratch.keep("kept")
    # the join and the window (repeated rows are alike) share one key, so texts are shuffled once
    once = Window.partitionBy("same_").orderBy(F.xxhash64("row_"))
    found = rows.select("same_", "row_").join(kept, "same_", "left_semi").withColumn("nth_", F.row_number().over(once)).where("nth_ = 1")
    return found.select(*[F.col("row_")[c].alias(c) for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
