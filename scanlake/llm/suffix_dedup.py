"""Operator 1: removal of repeated passages, by suffixes sorted a bucket at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import Scratch
from scanlake.llm.repeats import HASH_BITS, K, Block, least_of_windows, words_at

DEPTH = 50
#: Bytes of text of a block, the unit that is kept together (a longer document is a block of its own).
BLOCK_BYTES = 8 << 20
#: Anchors of a bucket, about, and bytes of text for each anchor.
BUCKET_ANCHORS, BYTES_AN_ANCHOR = 1 << 16, 18
#: An anchor with more different surroundings than this is split by its whole windows.
HOT = 4096


def packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, bytes, data: documents (doc_id, text) packed together, compressed."""

    def run(batches):
        press, n, held, size = zstandard.ZstdCompressor(3), 0, [], 0

        def out():
            ids, texts = np.array([x for x, _ in held], dtype=np.int64), [x for _, x in held]
            raw = np.int64(len(held)).tobytes() + ids.tobytes() + np.array([len(x) for x in texts], dtype=np.int64).tobytes() + b"".join(texts)
            return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + n], pa.int64()), pa.array([size], pa.int64()), pa.array([press.compress(raw)], pa.binary())], ["block", "bytes", "data"])

        for batch in batches:
            for x, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                if held and size + len(raw) > block_bytes:
                    yield out()
                    n, held, size = n + 1, [], 0
                held.append((x, raw))
                size += len(raw)
        if held:
            yield out()

    return docs.mapInArrow(run, "block bigint, bytes bigint, data binary")


def opened(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = 8 + 16 * n + np.cumsum(sizes)
    return ids, [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the hash (fewer than 2**32 of them)."""
    return (((h >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def stretches(buckets: np.ndarray) -> dict[int, slice]:
    """The stretch of each bucket that there is in an ascending list."""
    if not len(buckets):
        return {}
    at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    return {int(k): slice(int(x), int(y)) for k, x, y in zip(buckets[at], at, np.r_[at[1:], len(buckets)], strict=True)}


class Known:
    """A block's runs, its distinct anchors in order of hash, and what the buckets say of them.

    Only buckets that the block has anchors in are held or sent, so a block costs its own text, however many buckets there are.
    """

    def __init__(self, data: bytes, depth: int, buckets: int):
        self.ids, self.texts = opened(data)
        self.block = Block(self.texts, depth)
        self.h, self.which = np.unique(self.block.h, return_inverse=True)
        #: Buckets are ranges of the hash, so each is a stretch of the distinct anchors.
        self.cuts = stretches(bucket_of(self.h, buckets))
        self.buckets = buckets

    def anchors(self):
        """(bucket, hashes, in several documents, different surroundings) for each bucket; a count over HOT need not be exact."""
        b = self.block
        doc_id = self.ids[b.doc]
        low, high = np.full(len(self.h), np.iinfo(np.int64).max), np.full(len(self.h), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, doc_id)
        np.maximum.at(high, self.which, doc_id)
        order = np.lexsort((b.c, self.which))
        w, c = self.which[order], b.c[order]
        new = np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])] if len(w) else np.empty(0, bool)
        around = np.minimum(np.bincount(w[new], minlength=len(self.h)), 65535).astype("<u2")
        for k, s in self.cuts.items():
            yield k, self.h[s], low[s] < high[s], around[s]

    def take(self, answers: list[tuple[int, bytes]]) -> None:
        """The anchors' flags, and the distinct contexts that follow from them, sorted by bucket."""
        shared, hot = np.zeros(len(self.h), bool), np.zeros(len(self.h), bool)
        for k, bits in answers:
            s = self.cuts[k]
            n = s.stop - s.start
            flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * n)
            shared[s], hot[s] = flags[:n], flags[n:]
        b, run = self.block, shared[self.which]
        whole, split = np.flatnonzero(run & ~hot[self.which]), np.flatnonzero(run & hot[self.which])
        s, p, doc, c = b.singles(b.a[split], b.b[split], b.p[split], b.h[split], b.doc[split])
        self.a, self.b, self.p = np.r_[b.a[whole], s], np.r_[b.b[whole], s], np.r_[b.p[whole], p]
        self.doc = np.r_[b.doc[whole], doc]
        key = np.r_[b.c[whole], c]
        bucket = bucket_of(np.r_[b.h[whole], c >> np.uint64(64 - HASH_BITS)], self.buckets)
        place = (self.p - self.a).astype(np.uint64)
        order = np.lexsort((place, key, bucket))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1]) | (place[order][1:] != place[order][:-1])
        self.context = np.empty(len(order), np.int64)
        self.context[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.low = np.full(len(self.first), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.context, self.ids[self.doc])
        self.context_cuts = stretches(bucket[self.first])

    def contexts(self):
        """(bucket, number, blob) of the distinct contexts of each bucket: sizes, places of the anchor, least doc_ids, bytes."""
        press = zstandard.ZstdCompressor(3)
        for k, s in self.context_cuts.items():
            a, b, p = (x[self.first[s]] for x in (self.a, self.b, self.p))
            blob = (b - a + 1).astype(np.uint8).tobytes() + (p - a).astype(np.uint8).tobytes() + self.low[s].tobytes() + self.block.contexts(a, b).tobytes()
            yield k, len(a), press.compress(blob)

    def removed(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """For each byte of the block whether it goes."""
        b = self.block
        wide = b.left + 1
        bits = np.zeros((len(self.first), wide), bool)
        for k, raw in answers:
            s = self.context_cuts[k]
            bits[s] = np.unpackbits(np.frombuffer(raw, np.uint8), count=(s.stop - s.start) * wide).reshape(-1, wide)
        edge = np.zeros(b.n + b.depth + 1, np.int32)
        later = self.ids[self.doc] > self.low[self.context]
        np.add.at(edge, self.a[later], 1)
        np.subtract.at(edge, self.b[later] + b.depth, 1)
        some = np.flatnonzero(~later & bits[self.context].any(axis=1))
        for k in range(wide):
            s = self.a[some] + k
            s = s[bits[self.context[some], k] & (s <= self.b[some])]
            np.add.at(edge, s, 1)
            np.subtract.at(edge, s + b.depth, 1)
        return np.cumsum(edge)[: b.n] > 0


def rows_of(batch: pa.RecordBatch, *names: str):
    """Rows of large values one at a time, so that a single one is held outside Arrow."""
    for k in range(batch.num_rows):
        yield tuple(batch.column(x)[k].as_py() for x in names)


def by_bucket(batches):
    """Lists of rows of one bucket each, from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for row in rows_of(batch, *batch.schema.names):
            if row[0] != now:
                if held:
                    yield now, held
                now, held = row[0], []
            held.append(row[1:])
    if held:
        yield now, held


def flagged(batches):
    """bucket, block, bits: of the anchors of each block, which are in several documents and which are hot."""
    for bucket, rows in by_bucket(batches):
        h = [np.frombuffer(x[2], "<u4", x[1]).astype(np.uint64) | np.frombuffer(x[2], "<u2", x[1], 4 * x[1]).astype(np.uint64) << np.uint64(32) for x in rows]
        several = [np.unpackbits(np.frombuffer(x[2], np.uint8, -1, 8 * x[1]), count=x[1]).astype(bool) for x in rows]
        around = [np.frombuffer(x[2], "<u2", x[1], 6 * x[1]).astype(np.int64) for x in rows]
        all_h = np.concatenate(h)
        order = np.argsort(all_h, kind="stable")
        starts = np.flatnonzero(np.r_[True, all_h[order][1:] != all_h[order][:-1]])
        size = np.diff(np.r_[starts, len(order)])
        shared = (size > 1) | np.logical_or.reduceat(np.concatenate(several)[order], starts)
        hot = np.add.reduceat(np.concatenate(around)[order], starts) > HOT
        back = np.empty((2, len(order)), bool)
        back[0, order], back[1, order] = np.repeat(shared, size), np.repeat(hot, size)
        ends = np.cumsum([len(x) for x in h])
        bits = [np.packbits(back[:, e - len(x) : e].ravel()).tobytes() for x, e in zip(h, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.int64()), pa.array(bits, pa.binary())], ["bucket", "block", "bits"])


def sorted_buckets(depth: int):
    """From bucket, block, n, blob of contexts: bucket, block, bits of each context's windows that a smaller doc_id has too."""
    wide = depth - K + 1

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        for bucket, rows in by_bucket(batches):
            size, off, low, text = [], [], [], []
            for _, n, blob in rows:
                raw = open_.decompress(blob)
                size.append(np.frombuffer(raw, np.uint8, n).astype(np.int64) + depth - 1)
                off.append(np.frombuffer(raw, np.uint8, n, n).astype(np.int64))
                low.append(np.frombuffer(raw, np.int64, n, 2 * n))
                text.append(np.frombuffer(raw, np.uint8, -1, 10 * n))
            size, off, low, text = map(np.concatenate, (size, off, low, text))
            # equal contexts of several blocks count once, with their least doc_id
            ends = np.cumsum(size)
            column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(text)])
            which = column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.unique(which, return_index=True)[1]
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, which, low)
            # a context whose anchor has no other shares its windows with none
            anchor = words_at(np.concatenate([text, np.zeros(16, np.uint8)]), len(text) + 8)
            at = (ends - size + off)[first]
            by = np.lexsort((anchor[at + 8], anchor[at]))
            same = (anchor[at[by]][1:] == anchor[at[by]][:-1]) & (anchor[at[by] + 8][1:] == anchor[at[by] + 8][:-1])
            rest = np.zeros(len(first), bool)
            rest[by] = np.r_[False, same] | np.r_[same, False]
            window = np.repeat(least[:, None], wide, axis=1)
            if rest.any():
                chosen = first[rest]
                inside = np.arange(wide) < (size[chosen] - depth + 1)[:, None]
                laid = np.concatenate([text[e - s : e] for s, e in zip(size[chosen], ends[chosen], strict=True)])
                own = window[rest]
                own[inside] = least_of_windows(laid, size[chosen], least[rest], depth)
                window[rest] = own
            bits = window[which] < low[:, None]
            cuts = np.cumsum([n for _, n, _ in rows])
            packed_bits = [np.packbits(bits[e - n : e].ravel()).tobytes() for (_, n, _), e in zip(rows, cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.int64()), pa.array(packed_bits, pa.binary())], ["bucket", "block", "bits"])

    return run


def dedup(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """Removes each byte covered by ``depth`` bytes that also start in a document with a smaller doc_id.

    docs: doc_id (integer), text. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left).

    1. Documents are packed into blocks of bounded size, written to the shared folder.
    2. Suffixes are bucketed by a K-byte anchor within their first ``depth`` bytes (see Block). Each block sends the
       hashes of its distinct anchors; the buckets answer with a bit for each, whether another document has it.
    3. Blocks send the bytes around the anchors that others have, each distinct stretch once with its least doc_id.
       The buckets sort the suffixes of these stretches, one bucket by leading bytes at a time, and resolve long ties by the
       ranks of a difference-cover sample of them, computed beforehand; they answer with a bit for each suffix.
    4. Blocks put the answers back on their documents.

    A group of copies sends a stretch once per block, however many copies there are; an anchor with very many
    surroundings (a common phrase) is dealt out by its whole windows instead. Null text counts as empty. Rows of one
    doc_id don't remove each other's bytes. A row without a doc_id is kept whole and removes nothing. Texts shorter
    than ``depth`` are kept; an empty table gives no rows. Very long texts are their own block, read in steps.
    """
    if depth < 48 or depth > 128:
        raise ValueError("depth must lie between 48 and 128")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = scratch.save(packed(text.where("doc_id IS NOT NULL"), block_bytes), "blocks")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(16, -(-total // (BUCKET_ANCHORS * BYTES_AN_ANCHOR)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def send(batches):
        for batch in batches:
            for block, data in rows_of(batch, "block", "data"):
                rows = [(k, block, len(h), (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (h >> np.uint64(32)).astype("<u2").tobytes() + around.tobytes() + np.packbits(several).tobytes()) for k, h, several, around in Known(data, depth, buckets).anchors()]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "block", "n", "blob"])

    def send_contexts(batches):
        for batch in batches:
            for block, data, flags in rows_of(batch, "block", "data", "flags"):
                known = Known(data, depth, buckets)
                known.take([(x["bucket"], x["bits"]) for x in flags])
                rows = [(k, block, n, blob) for k, n, blob in known.contexts()]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "block", "n", "blob"])

    def finish(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for data, flags, masks in rows_of(batch, "data", "flags", "masks"):
                known = Known(data, depth, buckets)
                known.take([(x["bucket"], x["bits"]) for x in flags or []])
                gone = known.removed([(x["bucket"], x["bits"]) for x in masks or []])
                rows = []
                for x, s, e in zip(known.ids.tolist(), known.block.starts.tolist(), known.block.ends.tolist(), strict=True):
                    mine = gone[s:e]
                    kept = known.block.data[s:e][~mine].tobytes()
                    rows.append((x, e - s, int(mine.sum()), int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    rows = "bucket int, block bigint, n int, blob binary"
    answer = "bucket int, block bigint, bits binary"
    flags = scratch.save(blocks.select("block", "data").mapInArrow(send, rows).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(flagged, answer), "flags")
    flags = flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))
    asked = blocks.select("block", "data").join(flags, "block")
    masks = scratch.save(asked.mapInArrow(send_contexts, rows).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(sorted_buckets(depth), answer), "masks")
    masks = masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("masks"))
    told = blocks.select("block", "data").join(flags, "block", "left").join(masks, "block", "left")
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    # written too, as only then batches are kept to a few rows of blobs
    done = scratch.save(told.select("data", "flags", "masks").mapInArrow(finish, out), "done")
    scratch.drop("blocks", "flags", "masks")
    body = F.coalesce("text", F.lit(""))
    whole = text.where("doc_id IS NULL").select("doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(body, 256).alias("kept_sha256"), *[body.cast("binary").alias("kept")] * with_text)
    return done.unionByName(whole)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
