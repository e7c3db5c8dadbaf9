"""Best-fit packing of documents into sequences, planned by length alone.

Every document is encoded and cut into pieces of the capacity, counted from its
end, so that only its first piece may be shorter. A piece's place depends on its
length and its rank among pieces of that length, so what is planned is the
histogram of lengths: ``capacity`` numbers, however many documents there are.

The plan matches large items first: pieces above a third of the capacity, from
the longest, each take the longest other large piece that still fits, and no
third one. Smaller pieces, from the longest, then go best-fit into the gaps left,
and open sequences of their own when no gap holds them. All pieces of a length,
and all gaps alike, are moved at once, so a plan has a few thousand steps at
most: each step places a range of ranks in a range of sequences.

Ranks come from counts by task and length: a task numbers its own pieces while it
encodes, and the counts of the tasks before it are added. No length is ever
ordered or collected in one task, whatever share of the rows it has.

Defined cases: a null text is empty, and an empty document is its end token
alone; rows that are alike are packed as different documents; an empty table
gives no piece.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stage

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: how byte-level vocabularies cut a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first_rank, n, first_sequence, per_sequence, offset): of a length, n pieces from first_rank on go to sequences from first_sequence on, per_sequence to each from offset on."""
    steps: list[tuple[int, int, int, int, int, int]] = []
    left = {k: v for k, v in counts.items() if v > 0}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: ranges of sequences (first, n)
    sizes: list[int] = []  # the gaps that have sequences, ascending
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        steps.append((length, rank[length], n, first, per, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((k for k in large if k <= min(a, capacity - a) and left[k]), 0)
            n = left[a] // 2 if a == b else min(left[a], left[b]) if b else left[a]
            if a == b and not n:
                smaller = next((k for k in large if k < a and left[k]), 0)
                b, n = smaller, 1
            place(a, n, opened, 1, 0)
            if b:
                place(b, n, opened, 1, a)
            put(capacity - a - b, opened, n)
            opened += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(sizes, s)
            if at == len(sizes):
                n = -(-left[s] // (capacity // s))
                put(capacity, opened, n)
                opened += n
                continue
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            per = gap // s
            full = min(n, left[s] // per)
            rest = 0
            if full:
                place(s, full * per, first, per, capacity - gap)
                put(gap - per * s, first, full)
            if full < n and left[s] and left[s] < per:
                rest = left[s]
                place(s, rest, first + full, rest, capacity - gap)
                put(gap - rest * s, first + full, 1)
            put(gap, first + full + bool(rest), n - full - bool(rest))
    return steps


class Encoder:
    """Encodes texts with one of the public tokenizers' files, as ``tokenizers`` does without special tokens added.

    A byte-level BPE vocabulary whose ids are its merges' ranks is encoded by a plain byte-pair encoder, which gives
    the same ids and no offsets or strings beside them. Texts that hold an added token's string, texts that its
    pre-tokenizing pattern gives up on (very long white space), and other vocabularies go to ``tokenizers`` itself.
    """

    def __init__(self, tokenizer: str):
        self.path, self.whole = tokenizer, None
        with open(tokenizer, encoding="utf-8") as f:
            told = json.load(f)
        added = [x["content"] for x in told.get("added_tokens") or ()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = _byte_pairs(told)

    def slowly(self, text: str) -> np.ndarray:
        """By ``tokenizers``."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if self.fast is None or (self.added is not None and self.added.search(text)):
            return self.slowly(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return self.slowly(text)


def _byte_pairs(told: dict):
    """A byte-pair encoder for a tokenizer's file, or None if it isn't a plain byte-level one."""
    import tiktoken

    model, cut = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or told.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    added = {x["content"] for x in told.get("added_tokens") or ()}
    bytes_of = {c: b for b, c in enumerate(_byte_letters())}
    ranks = {bytes(bytes_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [model["vocab"][t] for t in merged]
    if order != sorted(order) or len(ranks) != len(merged) + 256:
        return None
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256 on."""
    free = iter(range(256, 512))
    return [chr(b if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else next(free)) for b in range(256)]


@cache
def encoder(tokenizer: str) -> Encoder:
    """One for each Python worker; it keeps nothing of the texts."""
    return Encoder(tokenizer)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _encode(tokenizer: str, capacity: int, end: int):
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        part, nth, encode = TaskContext.get().partitionId(), [0] * (capacity + 1), encoder(tokenizer).encode
        tail = np.array([end], "<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc, ids = doc.as_py(), np.concatenate([encode(text.as_py() or ""), tail])
                total, at = len(ids), 0
                for k, stop in enumerate(range(total % capacity or capacity, total + 1, capacity)):
                    n = stop - at
                    rows.append((doc, k, at, n, zlib.crc32(ids[at:stop]), part, nth[n]))
                    nth[n] += 1
                    at = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _locate(steps: np.ndarray):
    """steps: rows of plan(), ordered by (length, first_rank)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches):
        key = (steps[:, 0] << 44) | steps[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            s = steps[np.searchsorted(key, (length << 44) | rank, side="right") - 1]
            nth = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s[:, 3] + nth // s[:, 4]), pa.array(s[:, 5] + nth % s[:, 4] * length)], names=names)

    return run


def pack(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = df.select(F.col(id_col).cast("long"), F.col(text_col))
    pieces = stage(texts.mapInArrow(lean(_encode(tokenizer or tokenizer_path(), capacity, end)), PIECES), "pieces")
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    steps = np.array(sorted(plan(total, capacity)), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    firsts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_locate(steps), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
