"""Best-fit packing of tokenised documents by hierarchical residual packing.

Pieces are packed best-fit-decreasing within partitions; bins that are nearly full are final; the
others become items of the next round, where fewer, merged partitions pack them best-fit again, until
one partition remains or a round merges nothing. Only lengths travel between rounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import stored, table

CAPACITY = 2048
END_ID = 0
#: A bin this full is final before the last round.
NEARLY = 0.995
FAN_IN = 8
#: Items that a task packs at once in any round; more are packed in turn or spread over more tasks.
MAX_ITEMS = 400_000
#: About how many bytes of distinct white-space free strings, with ENTRY for each, a Python worker
#: remembers; then it starts afresh. Longer strings than LONG_PART are not remembered.
MEMO_BYTES, ENTRY, LONG_PART = 160 << 20, 160, 200
#: Characters whose parts are looked up together.
CHUNK = 4 << 20
#: New words that one call encodes.
AT_ONCE = 1000

#: How the tokeniser cuts normalised text into words, and the characters (ASCII and Latin, none of
#: which composes with a neighbour) for which cutting here is sure to agree.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts. The tokeniser drops white space and never joins across it, so ids of a text are
    those of its white-space free parts, and those of a part are its words'. Arrow splits texts and finds
    their distinct parts; only parts not met before are encoded, many words at a time; ids of texts are
    gathered from the ids of parts by their places."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {"": 0}
        self.words: dict[str, bytes] = {}
        self.ids = np.zeros(1 << 16, "<u4")
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n_ids, self.n_parts, self.held = 0, 1, 0

    def _encode_words(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            owners = np.array(e.word_ids, np.int64)
            if len(owners) and (owners[-1] != len(some) - 1 or (np.diff(owners) < 0).any()):
                # The tokeniser cuts these otherwise: one by one, then.
                for word, one in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                    yield word, np.array(one.ids, "<u4").tobytes()
                continue
            ends = np.searchsorted(owners, np.arange(len(some)), side="right").tolist()
            raw, start = np.array(e.ids, "<u4").tobytes(), 0
            for word, end in zip(some, ends):
                yield word, raw[4 * start : 4 * end]
                start = end

    def _encode_parts(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        cut, odd = {}, []
        for part in new:
            if _PLAIN.fullmatch(part) and not any(s in part for s in self.specials):
                cut[part] = _WORD.findall(part.lower())
            else:
                odd.append(part)
        fresh = {w for ws in cut.values() for w in ws} - self.words.keys()
        self.words.update(self._encode_words(list(fresh)))
        self.held += sum(map(len, fresh)) + ENTRY * len(fresh)
        for part, ws in cut.items():
            yield part, b"".join([self.words[w] for w in ws])
        for part, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            yield part, np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        encoded = list(self._encode_parts(new))
        ids = np.frombuffer(b"".join([raw for _, raw in encoded]), "<u4")
        sizes = np.fromiter((len(raw) // 4 for _, raw in encoded), np.int64, len(encoded))
        for name, used, more in (("ids", self.n_ids, len(ids)), ("starts", self.n_parts, len(sizes)), ("sizes", self.n_parts, len(sizes))):
            held = getattr(self, name)
            if used + more > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(len(held), more), held.dtype)]))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        where = slice(self.n_parts, self.n_parts + len(sizes))
        self.sizes[where] = sizes
        self.starts[where] = self.n_ids + np.cumsum(sizes) - sizes
        self.places.update(zip([part for part, _ in encoded], range(self.n_parts, self.n_parts + len(sizes))))
        self.n_ids, self.n_parts = self.n_ids + len(ids), self.n_parts + len(sizes)
        self.held += sum(map(len, new)) + ENTRY * len(new) + 4 * len(ids)

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in order, ``end`` after each, and where each one's end.
        The memo may be emptied between calls, never within one."""
        if self.held > MEMO_BYTES:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        parts = split.flatten().dictionary_encode()
        if isinstance(parts, pa.ChunkedArray):
            parts = parts.combine_chunks()
        names = parts.dictionary.to_pylist()
        places = self.places
        if new := [p for p in names if p not in places]:
            self._learn(new)
        place = np.fromiter(map(places.__getitem__, names), np.int64, len(names))
        for part in new:
            if len(part) > LONG_PART:
                del places[part]
        codes = place[parts.indices.to_numpy()]
        # Each text's parts, then one place for its end.
        per_text = np.diff(split.offsets.to_numpy())
        sizes = np.insert(self.sizes[codes], np.cumsum(per_text), 1)
        starts = np.insert(self.starts[codes], np.cumsum(per_text), 0)
        stops = np.cumsum(sizes)
        ends = stops[np.cumsum(per_text + 1) - 1]
        ids = self.ids[np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        ids[ends - 1] = end
        return ids, ends


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _chunked(texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of texts of about CHUNK bytes, whole texts."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def _pieces(path: str, capacity: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode = encoder(path)
        for batch in batches:
            done = 0
            for texts in _chunked(pc.fill_null(batch.column("text"), "")):
                ids, ends = encode(texts, END_ID)
                sizes = np.diff(ends, prepend=0)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = (ends - sizes)[row] + start
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(done + row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)),
                        pa.array(length.astype(np.int64)), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                done += len(texts)

    return fn


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut every capacity ids."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill): best-fit-decreasing. Bins wait by free space; an integer with one bit per
    free space that some bin has finds the tightest in constant time."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = waiting[space].pop()
            if not waiting[space]:
                free &= ~(1 << space)
        else:
            space, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if left := space - size:
            waiting[left].append(b)
            free |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _packed(capacity: int, max_items: int):
    def binned(items: pd.DataFrame) -> pd.DataFrame:
        # Within equal lengths the order is by id, so that a repeated task gives the same bins.
        items = items.sort_values("item", ignore_index=True)
        bins, offsets, fill = best_fit(items["length"].to_numpy(), capacity)
        first = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(first, bins, items["item"].to_numpy())
        return pd.DataFrame({"item": items["item"], "bin": first[bins], "offset": offsets, "fill": fill[bins]})

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= max_items:
                yield binned(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield binned(pd.concat(held, ignore_index=True))

    return fn


_ROUND = "item long, bin long, offset long, fill long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, nearly: float = NEARLY, fan_in: int = FAN_IN, max_items: int = MAX_ITEMS) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (any columns with ``length`` from 1 to capacity).

    A bin is named by its smallest item, so names never clash. Pieces of one document may lie in
    different sequences. An empty table gives no rows. Each piece is one row, repeated rows are
    pieces of their own.
    """
    numbered = stored(pieces.drop("sequence_id", "offset").withColumn("item", F.monotonically_increasing_id()))
    todo = numbered.select("item", "length")
    width, before, still, rounds = max(1, todo.rdd.getNumPartitions()), None, 0, []
    while True:
        rounds.append(stored(todo.mapInPandas(_packed(capacity, max_items), _ROUND)))
        # One row stands for each bin: its smallest item.
        under = rounds[-1].where((F.col("item") == F.col("bin")) & (F.col("fill") < nearly * capacity))
        n_under = under.count()
        # Bins that could still merge may lie apart: only two rounds over different neighbours that
        # merge next to nothing end it before one partition has packed all.
        still = still + 1 if before is not None and n_under > 0.999 * before else 0
        if n_under == 0 or width == 1 or still == 2:
            break
        before = n_under
        width = max(-(-n_under // max_items), min(-(-width // fan_in), -(-n_under // 64)))
        # Other neighbours each round: dealt by a hash of the bin, with the round as its salt.
        todo = under.select("item", F.col("fill").alias("length")).repartition(width, F.xxhash64("item", F.lit(len(rounds))))
    placed = rounds[0].select("item", "bin", "offset")
    for later in rounds[1:]:
        moved = later.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        placed = placed.join(moved, "bin", "left").select(
            "item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset")
        )
    return numbered.join(placed, "item").drop("item").withColumnRenamed("bin", "sequence_id")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of
    ``docs`` (doc_id, text): null and empty texts are the end id alone; long ones are cut."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(tokenised_pieces(docs, path, capacity), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLES: dict = {}
