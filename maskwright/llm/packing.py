"""Best-fit-decreasing packing of tokenized documents into sequences.

A document's ids are those of a public tokenizer, then an end id. Documents longer
than a sequence are cut into full pieces and a rest. Pieces go into groups of
about ``GROUP`` pieces by a hash; each group is packed by best fit decreasing with
a segment tree over remaining capacities, which finds the tightest open sequence
in logarithmic time. Packing moves only ids and lengths, never tokens, and a group
wastes about one part-filled sequence, so the number of groups hardly shows.

The tokenizer drops white space and treats words apart, so bounded memories of the
ids of words and of their pieces replace most calls; words with rare characters
and texts that hold a special token's marker are encoded by it whole.

Defined cases: a null or empty text is the end id alone; very long texts are cut;
repeated rows are packed each; rows without an id are packed like others; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm._store import prepare, stage

SEQUENCE = 2048
END_ID = 0
GROUP = 65536
TOKENIZER = "word_bpe_49k.json"
MARKER = b"<|"
#: The tokenizer's split of lower-case words, for texts of the letters that _ODD leaves.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017e]+")
#: Anything but printable ASCII and composed Latin letters, whose lower case is one letter too.
_ODD = re.compile(r"[^!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u0137\u0139-\u013e\u0141-\u0148\u014a-\u017e]")
_STOPS = frozenset(b".,;:!?)|")
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters for which byte-level models take bytes.
_BYTE_CHARS = [chr(b) if b in _VISIBLE else chr(256 + b - sum(v < b for v in _VISIBLE)) for b in range(256)]
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _merger(path: str, model):
    """A function from the UTF-8 bytes of a piece to its ids.

    The vocabulary is that of a byte-level BPE whose words end in a marker, so it
    is also a rank table of tiktoken with a byte for the marker that no UTF-8 text
    holds; that merges faster. A sample of pieces is held against the tokenizer's
    own model, which takes over if any differs.
    """
    import tiktoken

    def own(piece: bytes) -> list[int]:
        return [t.id for t in model.tokenize("".join(map(_BYTE_CHARS.__getitem__, piece)))]

    spec = json.loads(Path(path).read_text())["model"]
    mark, back = spec.get("end_of_word_suffix") or "", {c: b for b, c in enumerate(_BYTE_CHARS)}
    try:
        ranks = {bytes(map(back.__getitem__, t.removesuffix(mark))) + b"\xff" * t.endswith(mark): i for t, i in spec["vocab"].items()}
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

        def fast(piece: bytes) -> list[int]:
            return core.encode_single_piece(piece + b"\xff")

        whole = sorted(r for r in ranks if b"\xff" not in r)[::37]
        sample = [a + b for a, b in zip(whole, whole[7:] + whole[:7])]
        if mark and all(fast(x) == own(x) for x in sample):
            return fast
    except (KeyError, ValueError, AttributeError):
        pass
    return own


class PieceIds(dict):
    """Little-endian uint32 ids of the pieces into which the tokenizer cuts words; a bounded memory."""

    most = 500_000

    def __init__(self, merge) -> None:
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = array("I", self.merge(piece)).tobytes()
        return ids


class WordIds(dict):
    """Little-endian uint32 ids of words between ASCII white space; a bounded memory.

    Words of ASCII go through the tokenizer's own steps here: lower case, its split,
    and its model for each new piece. Other words go to the tokenizer whole.
    """

    most = 400_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tool = Tokenizer.from_file(path)
        self.pieces = PieceIds(_merger(path, self.tool.model))

    def whole(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        low = word.lower()
        if low.isalpha():  # of bytes: ASCII letters only
            ids = self.pieces[low]
        elif low[:-1].isalpha() and low[-1] in _STOPS:
            ids = self.pieces[low[:-1]] + self.pieces[low[-1:]]
        else:
            text = word.decode("utf-8", "replace")
            ids = self.whole(text) if _ODD.search(text) else b"".join(self.pieces[x.encode()] for x in _SPLIT.findall(text.lower()))
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if MARKER in text:
            return self.whole(text.decode("utf-8", "replace"))
        return b"".join(map(self.__getitem__, text.split()))  # of bytes: ASCII white space, which the tokenizer drops


_KNOWN: dict[str, WordIds] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _pieces(path: str, size: int, end: int):
    stop = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _KNOWN.get(path) or _KNOWN.setdefault(path, WordIds(path))
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py() or b"") + stop
                for k, lo in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[lo: lo + 4 * size]
                    out.append((doc, k, lo // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


class OpenBins:
    """Open sequences by remaining capacity, under a segment tree of capacities that occur."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, number: int) -> None:
        if not self.bins[capacity]:
            i = capacity + self.leaves
            while i and not self.tree[i]:
                self.tree[i] = 1
                i >>= 1
        self.bins[capacity].append(number)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Capacity and number of the open sequence with the least capacity of at least length."""
        tree, i = self.tree, length + self.leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        number = self.bins[capacity].pop()
        if not self.bins[capacity]:
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return capacity, number


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; lengths must not grow."""
    bins, at, offsets, opened = OpenBins(size), [], [], 0
    for n in lengths:
        found = bins.tightest(n) if n < size else None
        capacity, number = found or (size, opened)
        opened += found is None
        at.append(number)
        offsets.append(size - capacity)
        if capacity > n:
            bins.add(capacity - n, number)
    return at, offsets


def _pack(size: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        at, offsets = best_fit(rows["length"].tolist(), size)
        rows["sequence_id"] = np.array(at, np.int64) + (int(key[0]) << 32)
        rows["offset"] = np.array(offsets, np.int64)
        return rows.drop(columns="bin_group")

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, end: int = END_ID, group: int = GROUP) -> DataFrame:
    """A row per piece of docs (doc_id, text), with its place: see the columns of ``_PIECES``, sequence_id and offset."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    pieces = stage(texts.mapInArrow(_pieces(path or tokenizer_path(), size, end), _PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group))
    own = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    # A group of rows that are alike in all these would not be split by their hash: they also go by place.
    own = F.pmod(own + F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"), F.lit(groups))
    return pieces.withColumn("bin_group", own).groupBy("bin_group").applyInPandas(_pack(size), f"{_PIECES}, sequence_id long, offset long")


def query_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
