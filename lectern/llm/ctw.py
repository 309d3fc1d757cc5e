"""LM scoring by context-tree weighting over bytes.

Before each byte it is decided whether the text ends; a byte is eight binary decisions more, so the
scores are probabilities of whole texts, of any bytes. Each decision has a tree of byte contexts up to
DEPTH long. A
node's Krichevsky-Trofimov estimate is weighed half and half against the product of its children's
weighted probabilities, from the deepest contexts to the root; a text is then coded with the fixed
weights that all training counts leave, each bit's probability mixing the KT estimates of all depths.

As Spark jobs: documents are dealt to blocks of bounded size; a block reports its distinct
(DEPTH+1)-grams and words with training counts; counts are summed over all blocks; the tree is weighed
in groups of one two-byte context and, above those, by aggregation; what each block asked for goes
back to it, and it scores its texts. What is gathered grows with the corpus: its distinct grams and
words, block by block. Nothing is broadcast or collected but four totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import crc_mod, stored, table
from lectern.llm.shingles import word_hashes

DEPTH = 4
#: A gram is a symbol, a byte or END, below the bytes of its context.
SYMBOL_BITS, END = 9, 256
#: Grams of one two-byte context that are weighed together; more are taken by their three-byte contexts.
STRETCH = 1 << 20
BLOCK_BYTES = 12 << 20
CHUNK = 2 << 20
_U = np.uint64
_LOG2 = float(np.log(2.0))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first, texts as bytes) of about CHUNK bytes, whole texts."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends): each byte of each text and its END, with the DEPTH bytes before it (0 before the
    start), as one integer; and where each text's keys end."""
    pad = b"\0" * DEPTH
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8).astype(_U)
    sizes = np.fromiter((len(t) + DEPTH + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    keys = raw.copy()
    keys[starts + sizes - 1] = END
    for back in range(1, DEPTH + 1):
        keys[back:] |= raw[: len(raw) - back] << _U(SYMBOL_BITS + 8 * (back - 1))
    real = np.ones(len(raw), bool)
    real[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[real], np.cumsum(sizes - DEPTH)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(inverse, np.concatenate(counts), len(unique)).astype(np.int64)


def _block_table(block: pa.Table) -> pa.Table:
    """Distinct grams (kind 0) and words (kind 1) of a block, with how often training texts have them."""
    texts = block.column("text").to_pylist()
    train = ~np.array(block.column("held_out").to_pylist(), bool)
    found: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
    for first, part in _chunks(texts):
        own = train[first : first + len(part)]
        for kind, (values, ends) in ((0, grams(part)), (1, word_hashes([t.lower() for t in part]))):
            of_train = np.repeat(own, np.diff(ends, prepend=0))
            for mask, n in ((of_train, 1), (~of_train, 0)):
                unique, counts = np.unique(values[mask], return_counts=True)
                found[kind][0].append(unique)
                found[kind][1].append(counts * n)
    tables = []
    for kind, (keys, counts) in found.items():
        unique, n = _summed(keys, counts)
        tables.append(pa.table({"block": np.full(len(unique), block.column("block")[0].as_py(), np.int32), "kind": np.full(len(unique), kind, np.int8), "key": unique.view(np.int64), "n": n}))
    return pa.concat_tables(tables)


# ---- the tree ----


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    shift = np.log(np.multiply.reduce([x + k for k in range(8)]))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the KT estimator gives any sequence with these counts."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - float(np.log(np.pi))


class _Levels:
    """Depths DEPTH..3 below one two-byte context, of a stretch of its grams. Decision 0 is whether the
    text ends, at node 0; 1 to 8 are the byte's, which an END doesn't make. index[d][j]: for each gram its
    node for decision j at depth d; stop[d], kt[d]: a node's weight against its children's, and its
    estimate of a one. n0, n1, children: what the nodes of depth 2 get from this stretch."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        keys = keys.view(_U)
        symbol = (keys & _U((1 << SYMBOL_BITS) - 1)).astype(np.int64)
        ends, byte = symbol == END, symbol & 255
        self.bits = np.array([ends, *[(byte >> (7 - j)) & 1 for j in range(8)]], np.int64)
        self.live = np.array([np.ones(len(keys), bool), *[~ends] * 8])
        self.nodes = np.where(self.live, np.array([np.zeros(len(keys), np.int64), *[(1 << j) | (byte >> (8 - j)) for j in range(8)]]), 0)
        ones, zeros = (self.bits * self.live * n).ravel(), ((1 - self.bits) * self.live * n).ravel()
        self.index, self.stop, self.kt = {}, {}, {}
        weighted = below = None
        for d in range(DEPTH, 2, -1):
            context = (keys >> _U(SYMBOL_BITS)) & _U((1 << (8 * d)) - 1)
            ids, inverse = np.unique((context << _U(8))[None, :] | self.nodes.astype(_U), return_inverse=True)
            inverse = inverse.reshape(9, -1)
            n1, n0 = np.bincount(inverse.ravel(), ones, len(ids)), np.bincount(inverse.ravel(), zeros, len(ids))
            own = _log_kt(n0, n1)
            if weighted is None:
                self.stop[d], total = np.ones(len(ids)), own
            else:
                total = np.logaddexp(own, self._sums(weighted, below, inverse, len(ids))) - _LOG2
                self.stop[d] = np.exp(own - _LOG2 - total)
            self.kt[d], self.index[d] = (n1 + 0.5) / (n1 + n0 + 1.0), inverse
            weighted, below = total, inverse
        self.n0, self.n1 = np.bincount(self.nodes.ravel(), zeros, 256), np.bincount(self.nodes.ravel(), ones, 256)
        self.children = self._sums(weighted, below, self.nodes, 256)

    @staticmethod
    def _sums(weighted: np.ndarray, below: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
        parent = np.zeros(len(weighted), np.int64)
        parent[below.ravel()] = above.ravel()
        return np.bincount(parent, weighted, n)


def _stretches(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the grams of one two-byte context: whole three-byte contexts, about STRETCH at a time."""
    third = (keys.view(_U) >> _U(SYMBOL_BITS + 16)) & _U(255)
    order = np.argsort(third, kind="stable")
    starts = np.flatnonzero(np.diff(third[order].astype(np.int64), prepend=-1))
    begin = 0
    for at in [*starts[1:].tolist(), len(order)]:
        if at - begin >= STRETCH or at == len(order):
            yield order[begin:at]
            begin = at


def _weigh_low(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes at depth 2 of one context: their counts and log weighted probabilities."""
    keys, n = frame["key"].to_numpy(), frame["n"].to_numpy()
    n0, n1, children, met = np.zeros(256), np.zeros(256), np.zeros(256), np.zeros(256, bool)
    for part in _stretches(keys):
        levels = _Levels(keys[part], n[part])
        n0, n1, children = n0 + levels.n0, n1 + levels.n1, children + levels.children
        met[levels.nodes.ravel()] = True
    lw = np.logaddexp(_log_kt(n0, n1), children) - _LOG2
    nodes = np.flatnonzero(met)
    return pd.DataFrame({"context": frame["context"].iloc[0], "node": nodes, "n0": n0[nodes], "n1": n1[nodes], "lw": lw[nodes]})


def _mix_low(grams_: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
    """log10 of each gram's symbol given the bytes before it; ``top``: what depths 0 and 1 give the nodes
    of depth 2, and those nodes' own counts and weights."""
    keys, n = grams_["key"].to_numpy(), grams_["n"].to_numpy()
    n0, n1, lw = (top[c].to_numpy() for c in ("n0", "n1", "lw"))
    stop, kt = np.exp(_log_kt(n0, n1) - _LOG2 - lw), (n1 + 0.5) / (n0 + n1 + 1.0)
    acc, rem = np.zeros(256), np.ones(256)
    acc[top["node"]], rem[top["node"]] = top["acc"] + top["rem"] * stop * kt, top["rem"] * (1 - stop)
    out = np.zeros(len(keys))
    for part in _stretches(keys):
        levels = _Levels(keys[part], n[part])
        for j in range(9):
            p, left = acc[levels.nodes[j]], rem[levels.nodes[j]]
            for d in range(3, DEPTH + 1):
                at = levels.index[d][j]
                p = p + left * levels.stop[d][at] * levels.kt[d][at]
                left = left * (1 - levels.stop[d][at])
            out[part] += np.where(levels.live[j], np.log10(np.where(levels.bits[j] == 1, p, 1 - p)), 0.0)
    return pd.DataFrame({"key": keys, "value": out})


def _sql_log_gamma(x: Column) -> Column:
    y = x + 8
    shift = F.log(x)
    for k in range(1, 8):
        shift = shift + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _level_above(below: DataFrame, *keys: str) -> DataFrame:
    """Sums of the children, and with them ``stop`` and ``kt`` of these nodes."""
    out = below.groupBy(*keys).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("children"))
    own = _sql_log_gamma(F.col("n0") + 0.5) + _sql_log_gamma(F.col("n1") + 0.5) - _sql_log_gamma(F.col("n0") + F.col("n1") + 1) - float(np.log(np.pi))
    out = out.withColumn("own", own).withColumn("most", F.greatest("own", "children"))
    lw = F.col("most") + F.log(F.exp(F.col("own") - F.col("most")) + F.exp(F.col("children") - F.col("most"))) - _LOG2
    return (
        out.withColumn("lw", lw)
        .withColumn("stop", F.exp(F.col("own") - _LOG2 - F.col("lw")))
        .withColumn("kt", (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1))
        .select(*keys, "n0", "n1", "lw", "stop", "kt")
    )


def tree(counts: DataFrame) -> DataFrame:
    """(key, value): log10 probability of every gram in ``counts`` (key, n); those with n = 0 were seen
    in no training text and get what the contexts they share leave for them."""
    context = F.shiftright("key", SYMBOL_BITS).bitwiseAND(65535)
    keyed = counts.select("key", "n", context.alias("context"))
    low = stored(keyed.groupBy("context").applyInPandas(_weigh_low, "context long, node long, n0 double, n1 double, lw double"))
    one = stored(_level_above(low.withColumn("last", F.col("context").bitwiseAND(255)), "last", "node"))
    root = _level_above(one, "node").select(
        "node", (F.col("stop") * F.col("kt")).alias("acc0"), (1 - F.col("stop")).alias("rem0")
    )
    upper = one.join(root, "node").select(
        "last", "node", (F.col("acc0") + F.col("rem0") * F.col("stop") * F.col("kt")).alias("acc"), (F.col("rem0") * (1 - F.col("stop"))).alias("rem")
    )
    top = low.withColumn("last", F.col("context").bitwiseAND(255)).join(upper, ["last", "node"]).select("context", "node", "n0", "n1", "lw", "acc", "rem")
    return keyed.groupBy("context").cogroup(top.groupBy("context")).applyInPandas(_mix_low, "key long, value double")


# ---- scoring ----


class Lookup:
    """An open hash table over unsigned 64-bit keys; every key asked for must be in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, ~_U(0)), np.zeros(1 << bits)
        taken = np.zeros(1 << bits, bool)
        todo = np.arange(len(keys))
        slot = self._first(keys)
        while len(todo):
            free = todo[~taken[slot[todo]]]
            claim = slot[free]
            order = np.unique(claim, return_index=True)[1]
            owner = free[order]
            self.keys[slot[owner]], self.values[slot[owner]] = keys[owner], values[owner]
            taken[slot[owner]] = True
            done = np.zeros(len(keys), bool)
            done[owner] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._first(keys)
        out = self.values[slot]
        todo = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo, slot = todo[~hit], slot[~hit]
        return out


def _scored(total: int, distinct: int, n_train: int):
    whole = total + 0.1 * (distinct + 1)

    def fn(docs: pa.Table, asked: pa.Table) -> pa.Table:
        kind, keys, values = (asked.column(c).to_numpy() for c in ("kind", "key", "value"))
        by = [Lookup(keys[kind == k].view(_U), values[kind == k]) for k in (0, 1)]
        n_tokens, n_known, base, score = [], [], [], []
        for _, part in _chunks(docs.column("text").to_pylist()):
            at, ends = grams(part)
            score.append(np.add.reduceat(by[0](at), np.concatenate([[0], ends[:-1]])))
            words, ends = word_hashes([t.lower() for t in part])
            c = by[1](words)
            starts = np.concatenate([[0], ends[:-1]])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (np.log10((c + 0.1) / whole), c > 0)]
            logs, known = (x[ends] - x[starts] for x in sums)
            n_tokens.append(ends - starts + 1)
            n_known.append(known + (n_train > 0))
            base.append(logs + np.log10((n_train + 0.1) / whole))
        out = {
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": np.concatenate(n_tokens).astype(np.int64),
            "n_known": np.concatenate(n_known).astype(np.int64), "base_score": np.concatenate(base), "score": np.concatenate(score),
        }
        return pa.table(out)

    return fn


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``
    (doc_id, text, held_out). Rows with held_out true are scored only; all others are also learned.

    Null text is empty: it has its end alone. A null held_out counts as true. Repeated rows are learned
    as often as they stand; other columns are ignored; an empty table gives no rows. Without training
    texts every decision is a toss of a coin.
    """
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("held_out", F.lit(True)).alias("held_out")
    )
    sizes = named.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0)).alias("train")
    ).first()
    n_blocks = max(1, -(-sizes.bytes // block_bytes))
    blocks = named.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    asked = stored(blocks.groupBy("block").applyInArrow(_block_table, "block int, kind byte, key long, n long"))
    of_words, of_grams = asked.where("kind = 1"), asked.where("kind = 0")
    words = stored(of_words.groupBy("key").agg(F.sum("n").alias("n")))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("v")).first()
    total, distinct = totals.n + sizes.train, totals.v + (1 if sizes.train else 0)
    logs = stored(tree(of_grams.groupBy("key").agg(F.sum("n").alias("n"))))
    answers = of_words.select("block", "kind", "key").join(words.select("key", F.col("n").cast("double").alias("value")), "key").unionByName(
        of_grams.select("block", "kind", "key").join(logs, "key")
    )
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(total, distinct, sizes.train), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs.withColumn("held_out", crc_mod(F.col("doc_id"), 10) == 0))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLES: dict = {}
