"""N-gram Jaccard join with token-combination prefixes.

Sets of distinct word shingles link when 100 |A n B| >= T |A u B| (T = 80). Tokens (shingles) have one
global order, rare first; with o the least overlap a set of n tokens can have with a partner, its first
n - o + k tokens and a partner's share at least k. The order only steers cost: any order finds every
link.

Prefixes are extended to k tokens more than one match needs (k grows with the set). So a set that meets
others in fewer than k lists has no partner, whatever passage it shares with many, and goes before any
text moves. For the others the lengths of the lists are now known: lists are ordered by length, and each
set stays in its shortest ones only, as many as make sure of one match. Tokens of short lists (rare
classes) are indexed alone. A list longer than a block is indexed by combinations of two of its tokens,
then of three, where that is cheaper than comparing it block by block.

Lists do not become pairs by joins. A first round pairs each set with the most central set of the lists
it shares, links are verified on whole texts and contracted into components, and only lists that still
hold more than one component go on. Those are compared inside blocks of bounded size by parity sketches,
which never rule out a link and let few others pass; what passes between different components is
verified; where that would be very much, a spanning forest of it first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import bucketed, dropped, scratch, stored, table
from lectern.llm.graph import components
from lectern.llm.shingles import mixed, shingle_sets

N_GRAM, PERCENT = 5, 80
#: The table of frequent tokens that every task gets holds at most so many (9 bytes each).
MAX_KNOWN = 1_000_000
#: Tokens counted 2 ** HOT_TIER times are in lists of several sets for certain: their lists need not meet
#: in one task to tell, and are looked at in so many parts.
HOT_TIER, HOT_PARTS = 8, 64
#: Most sets of a list that are compared at once; most tokens of a combination.
BLOCK, MAX_TOKENS = 512, 3
#: List rows that a task gets together.
TASK_ROWS = 10_000
#: A task with more pairs for each of its rows first gives a forest of them.
FOREST = 4
#: Members that are compared with one copy of a pivot's text.
HUB = 256
_U = np.uint64


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shared_tokens(n: int, percent: int) -> int:
    """k: how many tokens the extended prefixes of a set of n tokens and of any larger partner share."""
    overlap = least_overlap(n, percent)
    return max(1, min(overlap, max(MAX_TOKENS, 1 + (n - overlap + 1) // 8)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _print_of(s: np.ndarray) -> tuple[int, int]:
    one, two = mixed(s), mixed(s ^ _U(0xA0761D6478BD642F))
    return int(one.sum().view(np.int64)), int(two.sum().view(np.int64))


_SCANNED = "doc_id long, n_shingles long, f1 long, f2 long, token long"


def _scanned(n_gram: int, flush: int = 4_000_000):
    """Two kinds of rows: of each document its number of shingles and their fingerprint; and the tokens
    that a stretch of different sets holds twice or more (token, how often): single ones stay home."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        more = n > 1
        none = pa.nulls(int(more.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(n[more].astype(np.int64)), none, none, _signed(tokens[more])], names=["doc_id", "n_shingles", "f1", "f2", "token"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for batch in batches:
            n, one, two = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), n_gram):
                mark = _print_of(s)
                n.append(len(s))
                one.append(mark[0])
                two.append(mark[1])
                if len(s) and mark not in seen:
                    seen.add(mark)
                    held.append(s)
                    size += len(s)
                    if size >= flush:
                        yield counted(held)
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.nulls(len(n), pa.int64())],
                names=["doc_id", "n_shingles", "f1", "f2", "token"],
            )
        if held:
            yield counted(held)

    return fn


def known_tokens(counted: DataFrame, max_known: int = MAX_KNOWN) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tiers) of the most frequent tokens by power-of-two tiers of their counted frequency:
    as many whole tiers as fit max_known, so what is broadcast has a fixed bound. counted: token, n."""
    counts = stored(counted.groupBy("token").agg(F.sum("n").alias("n")).select("token", F.floor(F.log2("n")).cast("byte").alias("tier")))
    sizes = {r.tier: r["count"] for r in counts.groupBy("tier").count().collect()}
    total, least = 0, 64
    for tier in sorted(sizes, reverse=True):
        total += sizes[tier]
        if total > max_known:
            break
        least = tier
    got = counts.where(F.col("tier") >= least).toArrow()
    dropped(counts)
    tokens = got.column("token").to_numpy().view(_U)
    order = np.argsort(tokens)
    return tokens[order], got.column("tier").to_numpy()[order]


_POSTING = "sig long, node long, n int, hot boolean"


def _postings(n_gram: int, percent: int, known):
    """The extended prefix of each different set of a task, a row per token; hot: known as very frequent."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tiers = known.value
        seen: set[tuple[int, int]] = set()
        sigs, hots, ids, sizes, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            per = np.fromiter(map(len, sigs), np.int64, len(sigs))
            each = lambda values, kind: pa.array(np.repeat(np.array(values, kind), per))
            return pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(sigs) if sigs else np.zeros(0, _U)), each(ids, np.int64), each(sizes, np.int32), pa.array(np.concatenate(hots) if hots else np.zeros(0, bool))],
                names=["sig", "node", "n", "hot"],
            )

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for doc_id, s in zip(names, shingle_sets(batch.column("text").to_pylist(), n_gram)):
                if doc_id is None or not len(s) or (mark := _print_of(s)) in seen:
                    continue
                seen.add(mark)
                n = len(s)
                upto = n - least_overlap(n, percent) + shared_tokens(n, percent)
                tier = np.zeros(n, np.int8)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    found = tokens[at] == s
                    tier[found] = tiers[at[found]]
                first = np.argsort(tier, kind="stable")[:upto]  # equal tiers stay in order of hash
                sigs.append(s[first])
                hots.append(tier[first] >= HOT_TIER)
                ids.append(doc_id)
                sizes.append(n)
                size += len(first)
                if size > 200_000:
                    yield out()
                    sigs, hots, ids, sizes, size = [], [], [], [], 0
        yield out()

    return fn


def _sql_shared(n: Column, percent: int) -> Column:
    overlap = F.ceil(percent * n / 100)
    return F.greatest(F.lit(1), F.least(overlap, F.greatest(F.lit(MAX_TOKENS), 1 + F.floor((n - overlap + 1) / 8)))).cast("int")


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """sig, node, n, odd, rank, last, room: the lists of two sets or more. Each set's lists are ranked by
    length; those up to rank ``last`` are sure to hold all its partners, those up to ``last`` + j - 1 hold
    j of the tokens it shares with each, as far as it must share j (``room``: how many it must, with the
    least partner it may have). odd: how many tokens of its prefix have no list."""
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(HOT_PARTS))).otherwise(0)
    alone = W.partitionBy("sig", "part")
    met = (
        postings.withColumn("part", part).withColumns({"a": F.min("node").over(alone), "b": F.max("node").over(alone)})
        .where("hot OR a <> b").select("sig", "node", "n")
    )
    by_node = W.partitionBy("node")
    n = F.col("n")
    q = _sql_shared(F.ceil(percent * n / 100), percent)
    held = stored(met.withColumn("m", F.count(F.lit(1)).over(by_node)).where(F.col("m") >= q).drop("m"))
    sizes = held.groupBy("sig").agg(F.count(F.lit(1)).alias("long")).where("long > 1")
    ranked = held.join(sizes, "sig").withColumns(
        {"m": F.count(F.lit(1)).over(by_node), "rank": F.row_number().over(by_node.orderBy("long", "sig")), "q": q}
    )
    prefix = n - F.ceil(percent * n / 100) + _sql_shared(n, percent)
    out = stored(
        ranked.where(f"m >= q AND rank <= m - q + {MAX_TOKENS}")
        .select("sig", "node", "n", (prefix - F.col("m")).cast("int").alias("odd"), "rank", (F.col("m") - F.col("q") + 1).cast("int").alias("last"), F.col("q").alias("room"))
    )
    dropped(held)
    return out


def _sketched(n_gram: int):
    """Parity bits of each set's tokens, as many as the next power of two from its size on."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes, sketches = [], []
            for s in shingle_sets(texts, n_gram):
                width = max(256, 1 << max(0, len(s) - 1).bit_length())
                odd = np.bincount(((s >> _U(20)) % _U(width)).astype(np.int64), minlength=width) % 2
                sizes.append(len(s))
                sketches.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], names=["node", "text", "size", "sketch"])

    return fn


class _Sketches:
    """Sketches of many rows; wider ones are folded onto narrower ones, which keeps parities."""

    def __init__(self, sketches: list[bytes]):
        self.width = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.at = np.zeros(len(sketches), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join([sketches[i] for i in own.tolist()]), np.uint64).reshape(len(own), w // 8)
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def _at_width(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.folded:
            full = self.rows[width]
            self.folded[width, to] = full if width == to else np.bitwise_xor.reduce(full.reshape(len(full), width // to, to // 8), axis=1)
        return self.folded[width, to]

    def flips(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the rows a[k] and b[k] differ."""
        out = np.zeros(len(a), np.int64)
        kinds = self.width[a] * (1 << 32) + self.width[b]
        for kind in np.unique(kinds).tolist():
            wa, wb = kind >> 32, kind & 0xFFFFFFFF
            to, own = min(wa, wb), np.flatnonzero(kinds == kind)
            left, right = self._at_width(wa, to), self._at_width(wb, to)
            step = max(1, (1 << 22) // to)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                out[part] = np.bitwise_count(left[self.at[a[part]]] ^ right[self.at[b[part]]]).sum(axis=1, dtype=np.int64)
        return out


def _may_link(flips: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """A token that only one set has flips at most one parity bit, so sets differ in at least as many
    tokens as bits. Sets that link differ in at most (100 - T) / (100 + T) of their summed sizes."""
    return flips * (100 + percent) <= (100 - percent) * sizes


def _near(percent: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                held = _Sketches(batch.column("u_sketch").to_pylist() + batch.column("v_sketch").to_pylist())
                sizes = batch.column("u_size").to_numpy().astype(np.int64) + batch.column("v_size").to_numpy()
                good = _may_link(held.flips(np.arange(n), np.arange(n) + n), sizes, percent)
                yield batch.select(["u", "v"]).filter(pa.array(good))

    return fn


def _pairs_of_lists(key: np.ndarray, cross: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) that lists have in common; rows of a list are consecutive. A list of two blocks
    (``cross``) pairs the rows of one with those of the other."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    plain = ~cross[starts]
    for size in np.unique(sizes[plain]).tolist():
        if size > 1:
            a, b = np.triu_indices(size, 1)
            own = starts[plain & (sizes == size)]
            step = max(1, (1 << 18) // len(a))
            for k in range(0, len(own), step):
                at = own[k : k + step, None]
                yield (at + a).ravel(), (at + b).ravel()
    for start, size in zip(starts[~plain].tolist(), sizes[~plain].tolist()):
        own = np.arange(start, start + size)
        one = block[own] == block[own].min()
        left, right = own[one], own[~one]
        yield np.repeat(left, len(right)), np.tile(right, len(left))


def _compared(percent: int, every: bool):
    """Pairs of different components in the lists of a task that sketches let pass. Where they are many
    more than its rows, and not ``every`` one is wanted yet, only a forest that spans what they connect,
    and a row without sets that says so."""

    def fn(rows: pa.Table, held_sketches: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sig", "ascending"), ("i", "ascending"), ("j", "ascending")])
        held_sketches = held_sketches.sort_by("one")
        sig, i, j = (rows.column(c).to_numpy() for c in ("sig", "i", "j"))
        new = np.concatenate([[False], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        node, size = held_sketches.column("one").to_numpy(), held_sketches.column("size").to_numpy().astype(np.int64)
        own = rows.column("node").to_numpy()
        begin, n = np.searchsorted(node, own), np.searchsorted(node, own, side="right") - np.searchsorted(node, own)
        # A doc_id with several texts has several sketches: its rows stand for each.
        row = np.repeat(np.arange(len(own)), n)
        place = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        comp = np.zeros(len(node), np.int64)
        comp[place] = rows.column("comp").to_numpy()[row]
        held, waiting = [np.zeros(0, np.int64)], 0
        for a, b in _pairs_of_lists(np.cumsum(new)[row], (i != j)[row], rows.column("block").to_numpy()[row]):
            x, y = place[a], place[b]
            good = (comp[x] != comp[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            x, y = x[good], y[good]
            held.append(np.minimum(x, y) * len(node) + np.maximum(x, y))
            waiting += len(x)
            if waiting > 1 << 20:
                held, waiting = [np.unique(np.concatenate(held))], 0
        keys = np.unique(np.concatenate(held))
        a, b = keys // max(1, len(node)), keys % max(1, len(node))
        sketches = _Sketches(held_sketches.column("sketch").to_pylist())
        good = _may_link(sketches.flips(a, b), size[a] + size[b], percent)
        a, b = a[good], b[good]
        short = not every and len(a) > FOREST * rows.num_rows
        if short:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = root.get(up, up)
                    x = up
                return x

            keep = []
            for k, (x, y) in enumerate(zip(comp[a].tolist(), comp[b].tolist())):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    keep.append(k)
            a, b = a[keep], b[keep]
        u, v = np.minimum(node[a], node[b]).tolist(), np.maximum(node[a], node[b]).tolist()
        return pa.table({"u": pa.array([*u, *[None] * short], pa.int64()), "v": pa.array([*v, *[None] * short], pa.int64())})

    return fn


def _verified(n_gram: int, percent: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last_set = None, None
        for batch in batches:
            us, vs = [], []
            u_texts, v_texts = batch.column("u_text"), batch.column("v_text").to_pylist()
            v_sets = shingle_sets(v_texts, n_gram)
            for i, (u, v, b) in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), v_sets)):
                text = u_texts[i].as_py()
                if text != last_text or last_set is None:
                    last_text, last_set = text, next(shingle_sets([text], n_gram))
                a = last_set
                inter = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * inter >= percent * (len(a) + len(b) - inter):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return fn


def _met(pairs: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """u, v and columns of both sets of each pair. ``texts`` is bucketed by node, so it stays where it is:
    pairs go to it as ids, and members v then go with their columns to their pivot u. A pivot of many
    members has a copy of its columns for each HUB of them, so no task gets them all."""

    def of(side: str) -> DataFrame:
        return texts.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])

    hubs = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts"))
    copies = of("u").join(hubs, "u").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    parted = pairs.join(hubs, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    return parted.join(of("v"), "v").join(copies, ["u", "part"]).drop("part")


def _verify(pairs: DataFrame, texts: DataFrame, n_gram: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose texts link."""
    both = _met(pairs, texts, "text").select("u", "v", "u_text", "v_text")
    return stored(both.mapInArrow(_verified(n_gram, percent), "u long, v long"))


def _central_pairs(lists: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pivot of a list and size band is the set with the fewest tokens outside any list: that
    is the text which near copies were made from, if it is there, and they link with it sooner than with
    one another. Each set v is paired with the pivot u that it shares most lists with."""
    banded = lists.where("rank <= last").withColumn("band", F.floor(F.log("n") / np.log(100 / percent)).cast("int") if percent < 100 else F.col("n"))
    firsts = banded.groupBy("sig", "band").agg(F.min(F.struct("odd", "node", "n")).alias("p"))
    met = (
        banded.select("sig", "band", "node", "n").join(firsts, ["sig", "band"])
        .where((F.col("p.node") != F.col("node")) & (100 * F.least("p.n", "n") >= percent * F.greatest("p.n", "n")))
        .groupBy("node", F.col("p.node").alias("pivot")).agg(F.count(F.lit(1)).alias("shared"))
    )
    best = stored(met.groupBy(F.col("node").alias("v")).agg(F.max_by("pivot", F.struct("shared", -F.col("pivot"))).alias("u")))
    out = stored(_met(best, texts, "size", "sketch").mapInArrow(_near(percent), "u long, v long"))
    dropped(best)
    return out


def _open(rows: DataFrame) -> DataFrame:
    """(sig, head, long, later): lists that still hold more than one component, with their first set, how
    many sets and how many combinations with one later token they have."""
    per = rows.groupBy("sig").agg(
        F.min("node").alias("head"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("long"),
        F.sum(F.greatest(F.least(F.col("last") + F.col("depth"), F.col("last") + F.col("room") - 1) - F.col("rank"), F.lit(0))).alias("later"),
    )
    return per.where("a <> b").select("sig", "head", "long", "later")


def _rows_to_compare(lists: DataFrame, labels: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """sig, head, node, comp, long of all open lists, and what may be dropped after its use. A list longer
    than a block goes by combinations with one more token if these are fewer rows than its blocks would
    be; sets that need not share so many tokens are also compared under the shorter combination."""
    rows = lists.join(labels, "node")
    level = rows.where("rank <= last").withColumn("depth", F.lit(1))
    out, used = None, []
    for depth in range(1, MAX_TOKENS + 1):
        held = stored(level)
        split = (F.col("long") > block) & (F.col("later") < F.col("long") * F.col("long") / block) if depth < MAX_TOKENS else F.lit(False)
        opened = stored(held.join(_open(held).withColumn("split", split), "sig"))
        used += [held, opened]
        whole = opened.where("NOT split").select("sig", "head", "node", "comp", "long")
        out = whole if out is None else out.unionByName(whole)
        longer = opened.where("split")
        if longer.isEmpty():
            break
        few = longer.where(F.col("room") <= depth).drop("long")
        few = few.join(few.groupBy("sig").agg(F.count(F.lit(1)).alias("long")), "sig").select("sig", "head", "node", "comp", "long")
        out = out.unionByName(few)
        later = rows.select("node", F.col("sig").alias("next"), F.col("rank").alias("at"))
        level = (
            longer.join(later, "node")
            .where((F.col("at") > F.col("rank")) & (F.col("at") <= F.col("last") + depth))
            .select(F.xxhash64("sig", "next").alias("sig"), "node", "n", "odd", F.col("at").alias("rank"), "last", "room", "comp", F.lit(depth + 1).alias("depth"))
        )
    return out, used


def _block_pairs(lists: DataFrame, labels: DataFrame, texts: DataFrame, tried: DataFrame, percent: int, every: bool, block: int) -> DataFrame | None:
    """Pairs (u, v) of open lists between different components that may link by their sketches, but for
    those tried before; none if no list is open."""
    rows, used = _rows_to_compare(lists, labels, block)
    blocks = F.ceil(F.col("long") / block).cast("int")
    spot = rows.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")})
    # A row goes to each pair of blocks that has its own; a list of one block is one pair.
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = stored(spot.withColumn("meet", F.explode(meet)).select("sig", "head", "node", "comp", "block", "meet.i", "meet.j"))
    n_tasks = dealt.count() // TASK_ROWS
    if dealt.isEmpty():
        dropped(dealt, *used)
        return None
    # Lists that begin with the same set hold much the same sets: they share tasks, as many as their rows
    # need, and each task gets a set's sketch once.
    heads = dealt.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).alias("tasks"))
    share = F.pmod(F.xxhash64("sig", "i", "j"), F.col("tasks"))
    placed = stored(
        dealt.join(heads, "head").withColumn("task", F.pmod(F.xxhash64("head", share), F.lit(2 * n_tasks + 1))).drop("head", "tasks")
    )
    needed = placed.select(F.col("task").alias("at"), F.col("node").alias("of")).distinct()
    sketches = needed.join(texts.select(F.col("node").alias("of"), "size", "sketch"), "of").select("at", F.col("of").alias("one"), "size", "sketch")
    met = placed.groupBy("task").cogroup(sketches.groupBy("at")).applyInArrow(_compared(percent, every), "u long, v long")
    out = stored(met.distinct().join(tried, ["u", "v"], "left_anti"))
    dropped(placed)
    dropped(dealt, *used)
    return out


def _contracted(labels: DataFrame, good: DataFrame) -> DataFrame:
    """Labels (node, comp) after joining the components that verified links join; drops the old ones."""
    if good.isEmpty():
        return labels
    ends = good.join(labels.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u").join(labels.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v")
    roots = components(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    out = stored(labels.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
    dropped(roots, labels)
    return out


def near_duplicates(docs: DataFrame, n_gram: int = N_GRAM, percent: int = PERCENT, max_known: int = MAX_KNOWN, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, n_shingles, f1, f2, class_id, component_id for each row of
    ``docs`` (doc_id, text); links: verified pairs (u, v) of different sets, enough of them to connect
    all that link.

    Null, empty and blank texts have no shingle and link with nothing, each its own component. Rows
    that repeat a doc_id count as one document. Null doc_ids get null components and link nothing.
    Whole texts are compared; other columns are ignored; an empty table gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie in 50..100")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = stored(named.mapInArrow(_scanned(n_gram), _SCANNED))
    prints = scanned.where("token IS NULL").drop("token")
    sets = prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(sets.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("class_id")))

    known = docs.sparkSession.sparkContext.broadcast(known_tokens(scanned.where("token IS NOT NULL").select("token", F.col("n_shingles").alias("n")), max_known))
    lists = _lists(named.mapInArrow(_postings(n_gram, percent, known), _POSTING), percent)
    labels = stored(lists.select("node").distinct().withColumn("comp", F.col("node")))
    wanted = named.withColumnRenamed("doc_id", "node").join(labels.select("node"), "node")
    texts = bucketed(wanted.mapInArrow(_sketched(n_gram), "node long, text string, size int, sketch binary"), "node")

    found, tried = None, None
    for round_ in ("central", "blocks", "rest"):
        if round_ == "central":
            pairs, more = _central_pairs(lists, texts, percent), True
        else:
            got = _block_pairs(lists, labels, texts, tried, percent, round_ == "rest", block)
            if got is None:
                break
            pairs, more = got.where("u IS NOT NULL"), not got.where("u IS NULL").isEmpty()
        good = _verify(pairs, texts, n_gram, percent)
        labels = _contracted(labels, good)
        ordered = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        tried = ordered if tried is None else tried.unionByName(ordered)
        found = good if found is None else found.unionByName(good)
        if not more:
            break
    dropped(lists, texts)

    # Nodes that are copies of one set are tied by their class, and rows of one doc_id by their id.
    same = sets.join(classes, ["n_shingles", "f1", "f2"]).select(F.col("doc_id").alias("node"), "class_id").distinct()
    to_class = labels.join(same, "node").select("comp", F.col("class_id").alias("u"))
    hubs = to_class.groupBy("comp").agg(F.min("u").alias("v"))
    twice = same.groupBy("node").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v")).where("u <> v").select("u", "v")
    roots = components(to_class.join(hubs, "comp").select("u", "v").unionByName(twice))
    members = (
        prints.join(classes, ["n_shingles", "f1", "f2"], "left")
        .withColumn("class_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")))
        .join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
        .select("doc_id", "n_shingles", "f1", "f2", "class_id", F.coalesce("root", "class_id", "doc_id").alias("component_id"))
    )
    return members, found


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "n_shingles", "component_id")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the smallest doc_id. Of rows that repeat it, all stay
    that are equal in doc_id: they are one document."""
    with scratch() as kept:
        members, _ = near_duplicates(docs)
        gone = stored(members.where("doc_id <> component_id").select("doc_id").distinct())
        kept.append(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLES = {
    "op7_jaccard_join": r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM cut
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_ FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * both_ >= 80 * (x.n + y.n - both_)
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT node, v FROM reach JOIN links ON u = seen
)
SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id
FROM reach LEFT JOIN sizes ON doc_id = node GROUP BY node""",
}
