"""Fill-in-middle: texts are cut into prefix, middle and suffix at places a hash of the document chooses.

The text's UTF-8 bytes are dealt into blocks of fixed size. A Fenwick tree over the blocks stores how
many units and how many code points end in each; a descent by powers of two finds the block in which
the wanted unit ends, and only that block is searched for the boundary. Any number of cuts of a text
so costs the logarithm of its blocks and one block each, after one pass to count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1"
#: Of 100 hash values, those from RATE on leave the text plain; of the rest, those below SPM put the suffix first.
RATE, SPM = 90, 20
#: Bytes of a block, and bytes of results after which a batch is handed on.
BLOCK, FLUSH = 1024, 16 << 20


class BlockCounts:
    """Units and code points of a text, countable and findable by blocks."""

    def __init__(self, data: bytes, unit: re.Pattern | None = None, block: int = BLOCK):
        raw = np.frombuffer(data, np.uint8)
        # A code point ends where the next byte doesn't continue it.
        self.char_ends = np.append((raw[1:] & 0xC0) != 0x80, True) if len(raw) else np.zeros(0, bool)
        self.unit_ends = self.char_ends
        if unit is not None:
            self.unit_ends = np.zeros(len(raw), bool)
            ends = [m.end() for m in unit.finditer(data.decode()) if m.end() > m.start()]
            self.unit_ends[np.flatnonzero(self.char_ends)[np.array(ends, np.int64) - 1]] = True
        self.block = block
        at = np.arange(0, len(raw), block)
        self.units, self.n = self._tree(self.unit_ends, at)
        self.chars, self.n_chars = self._tree(self.char_ends, at)

    @staticmethod
    def _tree(ends: np.ndarray, at: np.ndarray) -> tuple[list[int], int]:
        """Slot i of the tree holds the sum of the i & -i blocks that end with block i."""
        upto = np.concatenate([[0], np.cumsum(np.add.reduceat(ends, at, dtype=np.int64))]) if len(at) else np.zeros(1, np.int64)
        slots = np.arange(len(upto))
        return (upto - upto[slots - (slots & -slots)]).tolist(), int(upto[-1])

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code points before it) of the end of the k-th unit; of the beginning for 0."""
        if k <= 0:
            return 0, 0
        at, left, chars = 0, k, 0
        step = 1 << (len(self.units) - 1).bit_length()
        while step:
            if at + step < len(self.units) and self.units[at + step] < left:
                at += step
                left -= self.units[at]
                chars += self.chars[at]
            step >>= 1
        start = at * self.block
        end = start + int(np.flatnonzero(self.unit_ends[start : start + self.block])[left - 1]) + 1
        return end, chars + int(np.count_nonzero(self.char_ends[start:end]))


def _hashes(salt: str, doc_id) -> list[int]:
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _transformed(data: bytes, doc_id, salt: str, unit: re.Pattern | None, rate: int, spm: int, block: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)."""
    h1, h2, h3, h4 = _hashes(salt, doc_id)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    counts = BlockCounts(data, unit, block)
    if not data or h3 % 100 >= rate or p in data or s in data or m in data:
        return counts.n, "plain", None, None, data
    first, second = sorted((h1 % (counts.n + 1), h2 % (counts.n + 1)))
    (a, before), (b, upto) = counts.cut(first), counts.cut(second)
    if h4 % 100 < spm:
        return counts.n, "spm", before, upto - before, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return counts.n, "psm", before, upto - before, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


_FIM = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def fill_in_middle(docs: DataFrame, unit: str | None = None, salt: str = SALT, rate: int = RATE, spm: int = SPM, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text and any others) with ``text`` rewritten, and a struct column
    ``lectern_fim`` (n, form, prefix_chars, middle_chars).

    The text is matched from left to right by ``unit``, a regular expression, into n units; None: every
    code point is one. Hashes of salt and doc_id choose two of the n + 1 places; the prefix ends with the
    unit before the first, the middle with that before the second, what is left is the suffix. Units need
    not cover the text: what lies between two belongs with the later one. Forms: psm, spm, and plain for
    texts that are empty, hold one of the marks, or that the hash leaves alone; then the counts are null.
    Null text is empty and comes back empty; a null doc_id hashes as nothing. Repeated rows come out alike.
    A text is handled whole, in memory in proportion to its length; an empty table gives no rows.
    """
    pattern = re.compile(unit, re.S) if unit is not None else None

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            rest = [(i, name) for i, name in enumerate(batch.schema.names) if name != "lectern_fim"]
            begun, held, made = 0, 0, []
            for i in range(batch.num_rows):
                made.append(_transformed(texts[i].as_py() or b"", ids[i], salt, pattern, rate, spm, block))
                held += len(made[-1][4])
                if held >= FLUSH or i + 1 == batch.num_rows:
                    n, form, before, middle, out = zip(*made)
                    columns = {name: batch.column(k).slice(begun, len(made)) for k, name in rest}
                    columns["text"] = pa.array(out, pa.binary()).view(pa.string())
                    kinds = zip((n, form, before, middle), _FIM)
                    columns["lectern_fim"] = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in kinds], fields=list(_FIM))
                    yield pa.RecordBatch.from_pydict(columns)
                    begun, held, made = i + 1, 0, []

    kept = docs.drop("lectern_fim") if "lectern_fim" in docs.columns else docs
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(fn, schema + ", lectern_fim struct<n:long,form:string,prefix_chars:long,middle_chars:long>")


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. Cut texts hold no mark, so the first of each kind divides."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(one, second, 1)
        two = F.substr(one, F.length(a) + len(second) + 1)
        b = F.substring_index(two, MIDDLE, 1)
        return a, b, F.substr(two, F.length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    last, begin, between = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(begin, between, last)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "lectern_fim.n", "lectern_fim.form", "lectern_fim.prefix_chars", "lectern_fim.middle_chars",
        F.sha2("text", 256).alias("output_sha256"), F.sha2(restored(F.col("text"), F.col("lectern_fim.form")), 256).alias("restored_sha256"),
    )


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

ORACLES = {
    "op11_fill_in_middle": """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), numbers AS (
  SELECT doc_id, t, n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM hashed
), cuts AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cuts""",
}
