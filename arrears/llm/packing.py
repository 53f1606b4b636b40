"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document becomes its token ids and a separator. One that is longer than a
sequence is cut into whole sequences, the first piece takes what is left over.
A shorter piece goes where the squared counts of open sequences per residual
gap become smallest (Csirik et al.): with ``n[g]`` open sequences of gap ``g``,
putting a piece of size ``s`` into one of gap ``g`` changes the sum by
``2 * (n[g - s] - n[g]) + 2``, or by ``1 - 2 * n[s]`` if it is then full, and a
new sequence by ``2 * n[capacity - s] + 1``. Ties go to the smallest gap.

Work is dealt by a hash of the piece into shards of about ``SHARD`` pieces, each
packed by one task from sizes alone. What a shard leaves open is a piece of its
own on the next level, with all that it holds, until one shard has met all open
sequences or meeting them no longer saves any. So the loss is that of the last
level and does not grow with the shards.

Token ids stay where they were written: only (piece, size) rows are shuffled.

Defined results: a null or empty text is one piece that holds the separator
only; repeated rows and null ids are documents of their own; an empty table
gives no row. Other columns of the documents are not read, so their names
cannot clash. Which of equal pieces goes where follows from the written
table's order and is not part of the result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

CAPACITY = 2048
SEPARATOR = 0
SHARD = 1 << 15          # pieces packed by one task
MAX_LEVELS = 40          # the shards shrink with each level; more means a fault
CACHED = 1 << 19         # chunks whose ids a worker remembers, in each of two generations
TOGETHER = 64            # unseen chunks encoded in one string
LONG_CHUNK = 64          # characters from which a chunk is not remembered
CUT = 1 << 20            # characters of a text that are split at once
TOKENS_OUT = 1 << 20     # ids in one batch sent back

#: White space and what follows up to the next white space: byte-level BPE of
#: this kind never joins a character to white space after it, so the ids of a
#: text are those of its chunks.
CHUNK = re.compile(r"\s*\S+|\s+")
EDGE = re.compile(r"(?<=\S)(?=\s)")
#: white space to this module's patterns but not to the tokenizer's
ODD = re.compile("[\x1c-\x1f]")
#: texts with other white space than single blanks and line ends between words
IRREGULAR = r"^[ \n]|[ \n][ \n]|[ \n]$|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FIRST = "\x01"           # before a text's first chunk, which has no blank before it
TIED = "\x02"            # before a chunk of punctuation that stands at a word
#: a Latin letter and punctuation after it: never one piece to the tokenizer
AT_WORD = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-/:-@\[-`{-~])"

PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"

_READY: dict[int, ChunkEncoder] = {}


class ChunkEncoder:
    """A tokenizer that remembers the ids of short chunks. ``whole`` tokenizers
    (any but byte-level BPE without normaliser) get each text in one piece."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        special = self.tok.get_added_tokens_decoder()
        self.special = [t.content for t in special.values()]
        self.whole = (self.tok.normalizer is not None or type(self.tok.pre_tokenizer).__name__ != "ByteLevel" or self.tok.pre_tokenizer.add_prefix_space
                      or any(t.lstrip or t.rstrip or t.single_word or len(t.content.split()) != 1 for t in special.values()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # bytes of text that an id stands for: a byte-level token has a character per byte
        self.width = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token.encode()) if i in special else len(token)

    def _direct(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of unseen chunks. Those that may follow each other in a text are
        encoded together, and cut by the bytes that ids stand for; a chunk with
        no blank before it, or that is blank at its end, goes alone."""
        out: list[bytes] = [b""] * len(chunks)
        run = [i for i, c in enumerate(chunks) if c[:1] in (" ", "\n") and not c[-1].isspace()]
        for i in set(range(len(chunks))).difference(run):
            out[i] = self._direct(chunks[i]).tobytes()
        if run:
            bytes_of = pc.binary_length(pa.array([chunks[i] for i in run], pa.string())).to_numpy()
            texts = ["".join([chunks[i] for i in run[a:a + TOGETHER]]) for a in range(0, len(run), TOGETHER)]
            done = self.tok.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in done])
            ends = (4 * (np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(bytes_of)) + 1)).tolist()
            raw, a = ids.tobytes(), 0
            for i, b in zip(run, ends):
                out[i] = raw[a:b]
                a = b
        return out

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.known.get, chunks))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing and self.older:
            for i in missing:
                found[i] = self.older.get(chunks[i])
            self.known.update((chunks[i], found[i]) for i in missing if found[i] is not None)
            missing = [i for i in missing if found[i] is None]
        if missing:
            unseen = list(dict.fromkeys([chunks[i] for i in missing]))
            new = self._learn(unseen)
            if len(unseen) < len(missing):
                by = dict(zip(unseen, new))
                for i in missing:
                    found[i] = by[chunks[i]]
            else:
                for i, v in zip(missing, new):
                    found[i] = v
            if len(self.known) + len(new) > CACHED:
                self.older, self.known = self.known, {}
            self.known.update((c, v) for c, v in zip(unseen, new) if len(c) < LONG_CHUNK)
        return found

    def _segments(self, text: str) -> Iterator[str]:
        a = 0
        while len(text) - a > CUT:
            edge = EDGE.search(text, a + CUT)
            if edge is None:
                break
            yield text[a:edge.start()]
            a = edge.start()
        yield text[a:]

    def ids(self, text: str) -> np.ndarray:
        if self.whole or ODD.search(text):
            return self._direct(text)
        return np.frombuffer(b"".join(f for segment in self._segments(text) for f in self._look_up(CHUNK.findall(segment))), "<u4")

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (a null row is empty), and where each row's begin.
        Regular rows are cut and their distinct chunks found by Arrow."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, IRREGULAR), pc.greater(pc.binary_length(texts), CUT))
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        slow = self.whole | odd.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~slow)
        marked = pc.replace_substring(texts.take(pa.array(rows)), "\n", " \n")
        marked = pc.replace_substring_regex(marked, AT_WORD, rf"\1 {TIED}\2")
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")
        coded = lists.flatten().dictionary_encode()
        heads = {FIRST: "", TIED: "", "\n": "\n"}
        chunks = [heads[c[0]] + c[1:] if c[0] in heads else " " + c for c in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        known = self._look_up(chunks)
        size = np.array([len(k) // 4 for k in known], np.int64)
        flat, at = np.frombuffer(b"".join(known), "<u4"), coded.indices.to_numpy()
        lens = size[at]
        ends = np.cumsum(lens)
        fast = flat[np.repeat((np.cumsum(size) - size)[at] - (ends - lens), lens) + np.arange(int(lens.sum()))]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(rows) else np.zeros(1, np.int64)
        if not slow.any():
            return fast, bounds
        parts, order = [], iter(range(len(rows)))
        for i, s in enumerate(slow.tolist()):
            if s:
                parts.append(self.ids(texts[i].as_py()))
            else:
                k = next(order)
                parts.append(fast[bounds[k]:bounds[k + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def encoder(spec: str) -> ChunkEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _READY:
        _READY[key] = ChunkEncoder(spec)
    return _READY[key]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole
    sequences, but for the first piece, which takes the rest."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Per size, in the given order, its sequence (from 0) and its place there;
    and each sequence's fill."""
    n = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    none = np.int64(1) << 62
    for i, s in enumerate(sizes):
        best, gap = none, capacity
        if s < capacity:
            held = n[s:capacity]
            cost = np.where(held > 0, 2 * (n[:capacity - s] - held) + 2, none)
            if held[0]:
                cost[0] -= 1          # a full sequence is no longer open
            j = int(cost.argmin())
            best, gap = cost[j], s + j
        if best < none and best <= 2 * n[capacity - s] + 1:
            b = open_at[gap].pop()
            n[gap] -= 1
        else:
            gap, b = capacity, len(fill)
            fill.append(0)
        where[i], place[i] = b, capacity - gap
        fill[b] += s
        if gap > s:
            open_at[gap - s].append(b)
            n[gap - s] += 1
    return where, place, fill


def tokenise(spark: SparkSession, docs: DataFrame, spec: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per piece, PIECES."""
    sent = spark.sparkContext.broadcast(spec)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        uid = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0
        rows, flat, offsets = [], [], [0]

        def batch() -> pa.RecordBatch:
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), pa.array(np.concatenate(flat).view(np.int32)))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(cols + [ids], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

        for b in batches:
            if not b.num_rows:
                continue
            every, starts = enc.column(b.column("text"))
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                ids = np.append(every[starts[i]:starts[i + 1]], np.uint32(separator)).astype("<u4")
                for k, (a, size) in enumerate(cuts(len(ids), capacity)):
                    part = ids[a:a + size]
                    rows.append((uid, doc, k, a, size, zlib.crc32(part.tobytes())))
                    flat.append(part)
                    offsets.append(offsets[-1] + size)
                    uid += 1
                    if offsets[-1] >= TOKENS_OUT:
                        yield batch()
                        rows, flat, offsets = [], [], [0]
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def _pack_shards(items: DataFrame, capacity: int, level: int, shards: int) -> DataFrame:
    """items (item, size) -> (item, bin, at, fill): each shard packed by the rule."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("item").to_numpy(), -table.column("size").to_numpy()))
        item, size = table.column("item").to_numpy()[order], table.column("size").to_numpy()[order]
        where, place, fill = sum_of_squares(size.tolist(), capacity)
        name = (level << 57) + (key[0].as_py() << 27)
        return pa.table({"item": item, "bin": where + name, "at": place, "fill": np.array(fill, np.int64)[where]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pack, "item bigint, bin bigint, at bigint, fill bigint")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, shard: int = SHARD) -> DataFrame:
    """``docs`` (doc_id, text) -> one row per piece: doc_id, piece, start,
    length, ids_crc32, ids, sequence_id, offset. ``tokenizer`` is the path of a
    tokenizer file, read here once and sent to the workers."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    s = Scratch(spark, "packing")
    pieces = s.write(tokenise(spark, docs, spec, capacity, separator), "pieces")
    items = pieces.where(F.col("length") < capacity).select(F.col("uid").alias("item"), F.col("length").alias("size"))
    n, steps = items.count(), []
    for level in range(1, MAX_LEVELS):
        if not n:
            break
        shards = -(-n // shard)
        packed = s.write(_pack_shards(items, capacity, level, shards), f"level-{level}")
        steps.append(packed)
        items = packed.where(F.col("fill") < capacity).groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("size"))
        left = items.count()
        if shards == 1 or (level > 1 and left > 0.98 * n):
            break
        n = left
    out = pieces.withColumns({"bin": F.col("uid"), "at": F.lit(0).cast("long")})
    for packed in steps:
        step = packed.select(F.col("item").alias("bin"), F.col("bin").alias("next"), F.col("at").alias("add"))
        out = out.join(step, "bin", "left").withColumns({"bin": F.coalesce("next", "bin"), "at": F.col("at") + F.coalesce("add", F.lit(0))}).drop("next", "add")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """Packed pieces -> one row per sequence: sequence_id, length, ids. A
    sequence holds at most its capacity of ids, so groups are bounded."""
    got = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return got.select("sequence_id", "length", F.flatten("parts.ids").alias("ids"))
