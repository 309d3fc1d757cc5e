"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text gives longest matches. A text is cut greedily
into phrases, each the longest match from its place on. A phrase is a pointer into the language's
sample, so it costs the logarithm of the sample's length: the language in which the text costs fewest
bits a byte wins, and a language with little labelled text isn't charged for its smaller automaton.
Letters are lower-cased, with their marks, and all else becomes one space, so symbols and digits don't
vote.
Text is parsed in stretches of STRETCH bytes (a phrase ends where its stretch does), all stretches of
many texts in step, one table look-up per byte and language.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod, dropped, stored, table

#: Labelled text per language, in characters, at most.
SAMPLE_CHARS = 40_000
#: Of one document at most this part of a sample is learned.
PARTS = 8
#: Languages whose samples one scan of the labelled rows draws.
SCAN_LANGUAGES = 200
#: About what the tables of a group of languages may take of a worker's memory; one language may exceed it.
TABLE_BYTES = 256 << 20
STRETCH = 2048
CHUNK = 4 << 20
UNKNOWN = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def folded(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def samples(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """lang -> folded sample. ``labelled``: doc_id, text, lang. Different texts are drawn by a hash of the
    text at a rate that yields about twice the sample, so copies count once, and taken in hash order; of
    a long text a stretch from a hashed place is learned. Any number of languages; the driver, and later
    each worker, holds up to ``sample_chars`` of each."""
    most = sample_chars // PARTS
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "doc_id", "text", F.xxhash64("text").alias("h"))
    share = F.least(F.length("text"), F.lit(most)).alias("share")
    texts = stored(known.select("lang", "h", share, F.col("doc_id").cast("long").alias("doc_id")).groupBy("lang", "h").agg(F.min("share").alias("share"), F.min("doc_id").alias("doc_id")))
    sizes = sorted(texts.groupBy("lang").agg(F.sum("share").alias("chars")).collect())
    draw = F.pmod(F.xxhash64("h", F.lit("langid")), F.lit(1 << 40))
    place = F.pmod(F.xxhash64("h", F.lit("place")), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int")
    out: dict[str, list[str]] = {}
    for at in range(0, len(sizes), SCAN_LANGUAGES):
        some = sizes[at : at + SCAN_LANGUAGES]
        rate = F.create_map(*[F.lit(x) for r in some for x in (r.lang, int(min(1.0, 2.0 * sample_chars / r.chars) * (1 << 40)))])
        chosen = texts.withColumn("draw", draw).where(F.col("draw") < F.try_element_at(rate, F.col("lang"))).select("lang", "h", "doc_id", "draw")
        # Each language's choice is about twice its sample: a bounded table, so it is the side to send.
        drawn = (
            known.join(F.broadcast(chosen.withColumnRenamed("doc_id", "first")), ["lang", "h"])
            .where(F.col("doc_id").cast("long").eqNullSafe(F.col("first")))
            .select("lang", "draw", "h", F.substring("text", place + 1, F.lit(most)).alias("text"))
            .collect()
        )
        room, seen = {r.lang: sample_chars for r in some}, set()
        for r in sorted(drawn, key=lambda r: (r.draw, r.h, r.text)):
            if room[r.lang] > 0 and (r.lang, r.h) not in seen:
                seen.add((r.lang, r.h))
                out.setdefault(r.lang, []).append(r.text[: room[r.lang]])
                room[r.lang] -= len(r.text)
    dropped(texts)
    folds = {lang: folded("\n".join(texts)) for lang, texts in sorted(out.items())}
    return {lang: x for lang, x in folds.items() if x}


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of the smallest automaton of all substrings of ``data``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
        last = new
    return moves


class CrossParser:
    """Phrase counts of texts against all samples at once. Each table entry holds the next state and,
    in its two low bits, how many phrases end on the way: a byte no phrase can take is one by itself."""

    def __init__(self, by_language: dict[str, bytes]):
        self.languages = list(by_language)
        #: Bits of a phrase of each language.
        self.cost = np.array([math.log2(len(x) + 2) for x in by_language.values()])
        used = sorted(set().union(*map(set, by_language.values()))) if by_language else []
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        tables, roots, base = [], [], 0
        for data in by_language.values():
            moves = suffix_automaton(data)
            root = np.full(self.width, base * 4 + 1, np.int32)
            for c, s in moves[0].items():
                root[self.classes[c]] = (base + s) * 4
            table_ = np.tile(root + 1, (len(moves), 1))
            table_[0] = root
            for s, m in enumerate(moves):
                if m and s:
                    table_[s, self.classes[list(m)]] = [(base + x) * 4 for x in m.values()]
            tables.append(table_)
            roots.append(base)
            base += len(moves)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) counts."""
        owner, pieces = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), STRETCH):
                owner.append(i)
                pieces.append(t[at : at + STRETCH])
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not pieces or not self.languages:
            return out
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        grid = np.zeros((sizes[0], len(pieces)), np.uint8)
        for k, i in enumerate(order.tolist()):
            grid[: sizes[k], k] = np.frombuffer(pieces[i], np.uint8)
        grid = self.classes[grid]
        state = np.repeat(self.roots[:, None], len(pieces), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        for t in range(sizes[0]):
            n = active[t]
            step = self.table[state[:, :n] * self.width + grid[t, :n]]
            count[:, :n] += step & 3
            state[:, :n] = step >> 2
        count += state != self.roots[:, None]
        np.add.at(out, np.array(owner)[order], count.T)
        return out


_parsers: dict[int, CrossParser] = {}


def _parser(by_language: dict[str, bytes]) -> CrossParser:
    key = hash(tuple(by_language.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(by_language)
    return _parsers[key]


def _groups(by_language: dict[str, bytes]) -> list[dict[str, bytes]]:
    """Languages in order, in groups whose tables fit TABLE_BYTES (an automaton has at most two states a byte)."""
    groups: list[dict[str, bytes]] = []
    size, used = 0, set()
    for lang, data in by_language.items():
        size, used = size + len(data), used | set(data)
        if not groups or 8 * size * (len(used) + 1) > TABLE_BYTES:
            groups.append({})
            size, used = len(data), set(data)
        groups[-1][lang] = data
    return groups


class _Best:
    """Of each text the fewest bits of the languages seen so far, which language, and the runner-up's."""

    def __init__(self, n: int):
        self.least, self.next, self.at = np.full(n, np.inf), np.full(n, np.inf), np.zeros(n, np.int64)

    def see(self, start: int, parser: CrossParser, texts: list[bytes], base: int) -> None:
        bits = parser.phrases(texts) * parser.cost
        part = slice(start, start + len(bits))
        low = bits.argmin(1)
        least = np.take_along_axis(bits, low[:, None], 1)[:, 0]
        second = np.partition(bits, 1, 1)[:, 1] if bits.shape[1] > 1 else np.full(len(bits), np.inf)
        better = least < self.least[part]
        self.next[part] = np.where(better, np.minimum(self.least[part], second), np.minimum(self.next[part], least))
        self.at[part] = np.where(better, base + low, self.at[part])
        self.least[part] = np.minimum(self.least[part], least)


def _predicted(by_language: dict[str, bytes]):
    groups, names = _groups(by_language), list(by_language)

    def chunks(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
        held, size = [], 0
        for text in batch.column("text").to_pylist():
            held.append(folded(text or ""))
            size += len(held[-1])
            if size >= CHUNK:
                yield held
                held, size = [], 0
        if held:
            yield held

    def lettered(texts: list[bytes]) -> list[bool]:
        return [any(map(str.isalpha, set(t.decode()))) for t in texts]

    def shown(batch: pa.RecordBatch, known: list[bool], best: _Best, start: int) -> pa.RecordBatch:
        langs, scores = [], []
        for i, good in enumerate(known, start):
            good = good and bool(names)
            langs.append(names[best.at[i]] if good else UNKNOWN)
            scores.append(0.0 if not good else 1.0 if best.next[i] == np.inf else float(1 - best.least[i] / best.next[i]))
        rest = [c for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, known = _Best(batch.num_rows), []
            for texts in chunks(batch):
                if groups:
                    best.see(len(known), _parser(groups[0]), texts, 0)
                known += lettered(texts)
            yield shown(batch, known, best, 0)

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as spool:
            held, known, n_chunks = [], [], 0
            for batch in batches:
                held.append(batch.drop_columns(["text"]))
                for texts in chunks(batch):
                    pickle.dump((len(known), texts), spool)
                    known += lettered(texts)
                    n_chunks += 1
            best, base = _Best(len(known)), 0
            for group in groups if known else []:
                spool.seek(0)
                parser = _parser(group)
                for _ in range(n_chunks):
                    start, texts = pickle.load(spool)
                    best.see(start, parser, texts, base)
                base += len(group)
        start = 0
        for batch in held:
            yield shown(batch, known[start : start + batch.num_rows], best, start)
            start += batch.num_rows

    return at_once if len(groups) < 2 else in_turn


def predict(docs: DataFrame, by_language: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text). Texts without a letter, null
    or empty, are ``und`` with score 0, as is all text when nothing was learned. Score: by how much of
    the runner-up's bits the best language needs fewer. Ties go to the lesser language name.
    Repeated rows are predicted alike; other columns are ignored; whole texts are parsed. Where the
    tables of all languages exceed TABLE_BYTES, a partition's texts go to a temporary file and are
    parsed against groups of languages in turn; each task then builds every group's tables."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(_predicted(by_language), "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    learned = samples(docs.where(~held_out))
    return predict(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict = {}
