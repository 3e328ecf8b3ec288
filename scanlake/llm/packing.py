"""Operator 10: packing documents into sequences of bounded length by swap-based local search."""

from __future__ import annotations

import functools
import json
import math
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.llm.common import Scratch

LENGTH, END = 2048, 0
#: Sequences' worth of tokens that are packed together.
GROUP = 256
#: Sequences filled less than this are dealt and searched once more, those of all groups together.
SLACK = 0.95
#: Chunks a generation of a worker's memory holds; a worker keeps two, and those used last pass from the older to the newer.
REMEMBERED = 320_000
_known: dict[str, Stems] = {}
#: Bytes of text cut at a time.
STEP = 16 << 20
#: What the tokenizer cuts its input into, for the tokenizers that the short way below holds for.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: visible Latin-1 ones as they are, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in seen]
    return {x: chr(x) for x in seen} | {x: chr(256 + k) for k, x in enumerate(rest)}


def is_word_bpe(tokenizer) -> bool:
    """Whether it lowers, drops white space and encodes PARTS one by one."""
    steps = json.loads(tokenizer.to_str())
    normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])]
    cuts = (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
    return normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": PARTS} and cuts[0]["behavior"] == "Removed"


class Stems:
    """A worker's memory of the ids of stems (chunks without a last full stop or comma, or parts of chunks), of bounded size."""

    def __init__(self, tokenizer_path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_path)
        self.short = is_word_bpe(self.whole)
        self.tokenize, self.find, self.letters = self.whole.model.tokenize, regex.compile(PARTS).findall, str.maketrans(byte_letters())
        self.kept: list[dict[bytes, bytes]] = [{}, {}]

    def packed(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def part_ids(self, part: bytes) -> bytes:
        return array("I", [x.id for x in self.tokenize(part.decode() if part.isascii() else part.decode("latin-1").translate(self.letters))]).tobytes()

    def parts(self, chunk: bytes) -> list[bytes] | None:
        """What the tokenizer cuts a chunk into; None if only the whole tokenizer can tell."""
        if chunk.isalpha():
            return [chunk]
        text = chunk.decode()
        if not chunk.isascii():
            if "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
                return None
            text = text.lower()
        return [x.encode() for x in ([text] if text.isalpha() else self.find(text))]

    def learn(self, new: list[bytes], known: dict[bytes, bytes]) -> None:
        cut = {x: self.parts(x) for x in new if not x.isalpha()}
        odd = [x for x, y in cut.items() if y is None]
        known.update(zip(odd, self.packed([x.decode() for x in odd]), strict=True))
        for x in new:
            if x not in cut:
                known[x] = self.part_ids(x)
        for x, own in cut.items():
            if own is not None:
                for y in own:
                    if y not in known:
                        known[y] = self.part_ids(y)
                if own != [x]:
                    known[x] = b"".join(map(known.__getitem__, own))

    def ids(self, stems: list[bytes]) -> list[bytes]:
        if len(self.kept[0]) > REMEMBERED:
            self.kept = [{}, self.kept[0]]
        known, older = self.kept
        if new := [x for x in stems if x not in known]:
            again = {x: older[x] for x in new if x in older}
            known.update(again)
            self.learn([x for x in new if x not in again], known)
        return list(map(known.__getitem__, stems))


def chunk_ids(tokenizer_path: str):
    """A function from texts (a string array, or a list) to their ids as bytes (unsigned, little-endian, 32 bits).

    A tokenizer that drops white space and never joins across it gives a text the ids of its chunks between ASCII
    white space, and a chunk those of its parts. Texts are cut and their distinct chunks found in Arrow, STEP bytes of text at a
    time; each worker asks for a part once and remembers a bounded number of them; parts go to the tokenizer's model past its
    slow normalisers. Chunks whose lower case or composition could differ go through the whole tokenizer, and so do
    all texts for other tokenizers and those that may hold special tokens.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
    stems = _known.setdefault(tokenizer_path, Stems(tokenizer_path)) if tokenizer_path not in _known else _known[tokenizer_path]
    binary, none = pa.large_binary(), pa.scalar(b"", pa.large_binary())

    def cut(texts: pa.Array) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = lists.flatten().dictionary_encode()
        chunks = found.dictionary
        last = pc.binary_slice(chunks.cast(binary), -1, None)
        stem = pc.binary_slice(chunks.cast(binary), 0, -1)
        ends = pc.and_(pc.is_in(last, pa.array([b".", b","], binary)), pc.string_is_ascii(chunks))
        ends = pc.and_(ends, pc.if_else(ends, pc.ascii_is_alpha(pc.if_else(ends, stem, none).cast(pa.large_string())), False))
        own = pa.array(stems.ids(pc.if_else(ends, stem, chunks.cast(binary)).to_pylist()), binary)
        mark = pa.array(stems.ids([b"", b".", b","]), binary).take(pc.if_else(ends, pc.if_else(pc.equal(last, b","), 2, 1), 0))
        each = pc.binary_join_element_wise(own, mark, none).take(found.indices)
        return pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, each), none).to_pylist()

    def ids(texts):
        if not isinstance(texts, pa.Array):
            texts = pa.array([(x or "").encode("utf-8", "replace").decode() for x in texts], pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        special = pc.match_substring(texts, "<|") if stems.short else pa.array([True] * len(texts), pa.bool_())
        a = 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + STEP, side="right")))
            some, odd = texts.slice(a, z - a), special.slice(a, z - a).to_pylist()
            out = cut(some if not any(odd) else pc.if_else(special.slice(a, z - a), "", some)) if stems.short else [b""] * (z - a)
            if any(odd):
                at = [k for k, x in enumerate(odd) if x]
                for k, x in zip(at, stems.packed([some[k].as_py() for k in at]), strict=True):
                    out[k] = x
            yield from out
            a = z

    return ids


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt (and ids, binary) of each piece of each document's tokens and end token.

    Only documents longer than ``length`` are cut. Null text counts as empty: the end token alone.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"] + ["ids"] * with_ids
    tail = end.to_bytes(4, "little")

    def cut(batches):
        ids, n, own = chunk_ids(tokenizer_path), 0, TaskContext.get().partitionId()
        for batch in batches:
            which, rows = [], []
            for k, found in enumerate(ids(batch.column("text"))):
                found += tail
                for piece, a in enumerate(range(0, len(found), 4 * length)):
                    part = found[a : a + 4 * length]
                    which.append(k)
                    rows.append((piece, a // 4, len(part) // 4, zlib.crc32(part), zlib.crc32(b"%d:%d" % (own, n)), part)[: len(names) - 1])
                    n += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), *[pa.array(x, t) for x, t in zip(columns, types, strict=False)]], names)

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint" + ", ids binary" * with_ids)


def first_bins(sizes: list[int], length: int) -> list[list[int]]:
    """A cheap start for the search: pieces as they come, each to the open sequence it fits best; open ones are kept by free room."""
    bins, by_room, rooms = [], [[] for _ in range(length + 1)], 0
    for k, size in enumerate(sizes):
        fit = rooms >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = length, len(bins)
            bins.append([k])
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


@functools.cache
def couples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of n places, as two arrays."""
    return np.triu_indices(n, 1)


class Search:
    """Local search over sequences: exchanges that each raise the sum of squared fills, until sequences empty.

    The least filled open sequence gives to the others: a piece for none (a move), one piece for one, two for one, or one for
    two. Every partner and every piece is looked at, and of a kind the exchange that raises the sum most is made; the next
    kind is tried where the one before has none left. A sequence that is full is closed. It ends when a round
    over all open sequences changes nothing, or when there are as few sequences as the tokens need at least. ``made`` counts
    the exchanges by kind, and ``emptied`` the sequences they emptied.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], length: int):
        self.sizes, self.members, self.closed = np.array(sizes, dtype=np.int64), [list(b) for b in bins], len(bins)
        self.where = np.empty(len(sizes), np.int64)
        for b, own in enumerate(bins):
            self.where[own] = b
        self.fill = np.append(np.bincount(self.where, self.sizes, len(bins)).astype(np.int64), length + 1)
        self.length, self.least = length, -(-int(self.sizes.sum()) // length)
        self.open = set(np.flatnonzero(self.fill[:-1] < length).tolist())
        self.where[self.fill[self.where] >= length] = self.closed
        self.left, self.emptied = len(bins), 0
        self.made = {"move": 0, "one for one": 0, "two for one": 0, "one for two": 0}

    def best(self, donor: int, give: np.ndarray, take: np.ndarray, partner: np.ndarray) -> tuple[int, int] | None:
        """Which of give (sums of pieces) against which of take (sums of a partner's pieces) raises the sum of squares most."""
        net = give[:, None] - take
        raised = np.where((net > 0) & (net <= self.length - self.fill[partner]) & (partner != donor), net * (self.fill[partner] - self.fill[donor] + net), 0)
        k = int(raised.argmax()) if raised.size else 0
        return divmod(k, len(take)) if raised.size and raised.flat[k] > 0 else None

    def exchange(self, donor: int) -> tuple[str, list[int], list[int], int] | None:
        """An exchange (kind, given, taken, partner), or none."""
        own = self.members[donor]
        mine, others = self.sizes[own], np.fromiter(self.open, np.int64, len(self.open))
        if found := self.best(donor, mine, np.zeros(len(others), np.int64), others):
            return "move", [own[found[0]]], [], int(others[found[1]])
        if found := self.best(donor, mine, self.sizes, self.where):
            return "one for one", [own[found[0]]], [found[1]], int(self.where[found[1]])
        a, b = couples(len(own))
        if found := self.best(donor, mine[a] + mine[b], self.sizes, self.where):
            return "two for one", [own[a[found[0]]], own[b[found[0]]]], [found[1]], int(self.where[found[1]])
        several = [x for x in others.tolist() if x != donor and len(self.members[x]) > 1]
        if not several:
            return None
        flat = np.array([k for x in several for k in self.members[x]])
        starts = np.cumsum([0, *[len(self.members[x]) for x in several[:-1]]])
        pairs = [couples(len(self.members[x])) for x in several]
        a, b = (flat[np.concatenate([s + p[side] for s, p in zip(starts, pairs, strict=True)])] for side in (0, 1))
        if found := self.best(donor, mine, self.sizes[a] + self.sizes[b], self.where[a]):
            return "one for two", [own[found[0]]], [int(a[found[1]]), int(b[found[1]])], int(self.where[a[found[1]]])
        return None

    def make(self, donor: int, kind: str, given: list[int], taken: list[int], partner: int) -> None:
        self.made[kind] += 1
        self.members[donor] = [k for k in self.members[donor] if k not in given] + taken
        self.members[partner] = [k for k in self.members[partner] if k not in taken] + given
        self.where[given], self.where[taken] = partner, donor
        net = int(self.sizes[given].sum() - self.sizes[taken].sum())
        self.fill[partner] += net
        self.fill[donor] -= net
        if self.fill[partner] == self.length:
            self.open.discard(partner)
            self.where[self.members[partner]] = self.closed
        if not self.members[donor]:
            self.open.discard(donor)
            self.left, self.emptied = self.left - 1, self.emptied + 1

    def run(self) -> list[list[int]]:
        changed = True
        while changed and self.left > self.least:
            changed = False
            for donor in sorted(self.open, key=lambda b: (self.fill[b], b)):
                while donor in self.open and self.left > self.least and (found := self.exchange(donor)):
                    self.make(donor, *found)
                    changed = True
        return [b for b in self.members if b]


def search(bins: list[list[int]], sizes: list[int], length: int) -> list[list[int]]:
    return Search(sizes, bins, length).run()


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """Places every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The tokens' table is written once; its pieces are dealt by a salt into groups of about ``group`` sequences' worth of tokens,
    whatever their keys, and each group is packed by the local search on its own. The sequences that a group leaves
    less than SLACK full are dealt once more, and the search goes on from them among those of others, so groups cost
    hardly a sequence each. Null text counts as empty: the end
    token alone. A very long text is one row of tokens at a time in memory and goes on as its pieces. Repeated rows are
    packed each; an empty table gives no rows; other columns are not carried.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.save(pieces(docs, tokenizer_path, length, end, with_ids), "pieces")
    names = [c for c in cut.columns if c != "salt"]

    def groups(rows: DataFrame) -> int:
        return max(1, math.ceil((rows.agg(F.sum("length")).first()[0] or 0) / (length * group)))

    def place(first: int, again: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["sequence_id", "offset"] if again else ["salt", "doc_id", "piece", "ids_crc32"], ignore_index=True)
            sizes, base = rows["length"].tolist(), (first + int(rows["grp"].iloc[0])) << 32
            start = [x.tolist() for x in rows.groupby("sequence_id").indices.values()] if again else first_bins(sizes, length)
            seq, at, filled = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
            for s, own in enumerate(search(start, sizes, length)):
                here, fill = 0, sum(sizes[k] for k in own)
                for k in own:
                    seq[k], at[k], filled[k] = base + s, here, fill
                    here += sizes[k]
            return rows[names].assign(sequence_id=seq, offset=at, filled=filled)

        return run

    schema = ", ".join(f"{c} {t}" for c, t in cut.dtypes if c != "salt") + ", sequence_id bigint, offset bigint, filled bigint"
    n = groups(cut)
    placed = scratch.save(cut.withColumn("grp", F.pmod("salt", F.lit(n))).groupBy("grp").applyInPandas(place(0, False), schema), "placed")
    rest = placed.where(F.col("filled") < SLACK * length)
    again = rest.withColumn("grp", F.pmod(F.xxhash64("sequence_id"), F.lit(groups(rest)))).groupBy("grp").applyInPandas(place(n, True), schema)
    return placed.where(F.col("filled") >= SLACK * length).unionByName(again).drop("filled")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_tokenizer())
