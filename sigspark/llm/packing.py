"""Packing by hierarchical tiers of context sizes.

A document's ids (with an end id) are cut into whole long windows, each a sequence, and a tail. Tails are routed to the
smallest tier (256, 512 or 1024) that holds them. Tails of the long tier open windows; gaps are filled from the shorter
tiers, the longest tail that fits first, and what is still open by cutting a shorter one, whose rest is routed anew. What
the long tier leaves over is packed the same way in windows of its own tier, full at a power of two. Sequences of a window size are
dealt by attention cost, back and forth, to step groups of ``STEP`` sequences.

Pieces are dealt by a hash to packing groups of about ``GROUP`` documents, which are packed independently; each leaves
at most one window that isn't full.

Defined results: a null or empty text is the end id alone; rows that repeat are documents of their own; special
strings in a text are their special ids, as the library's default has it; an empty table gives an empty table;
other columns of the input are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.token_counts import _byte_symbols

WINDOW = 1024
TIERS = (256, 512, 1024)
STEP = 8
GROUP = 8192
#: Documents whose ids a task holds at once.
SLICE = 256
#: Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of so many characters is cut off before encoding: the pattern's way back would go through all of it.
RUN = 4096

_encoders: dict[str, tiktoken.Encoding] = {}
_RUN = regex.compile(rf"\p{{White_Space}}{{{RUN},}}")


def encoder(path: str) -> tiktoken.Encoding:
    """An encoder with the ids of a byte-level BPE .json vocabulary."""
    if path not in _encoders:
        spec = json.load(open(path, encoding="utf-8"))
        back = {x: b for b, x in enumerate(_byte_symbols())}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids must follow the order of merges")
        _encoders[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def encode(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text of any kind and length, special strings as their special ids.

    Long white space is one pre-token, but for its last character if more text follows; it is encoded as that, past the pattern.
    """
    if len(text) < RUN or not _RUN.search(text):
        return encoding.encode(text, allowed_special="all")
    special = encoding.special_tokens_set
    parts = regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
    ids = []
    for part in parts:
        if part in special:
            ids += encoding.encode(part, allowed_special="all")
            continue
        at = 0
        for run in _RUN.finditer(part):
            last = run.end() if run.end() == len(part) else run.end() - 1
            ids += encoding.encode_ordinary(part[at : run.start()])
            ids += encoding._encode_single_piece(part[run.start() : last])
            at = last
        ids += encoding.encode_ordinary(part[at:])
    return ids


def pack(lengths: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (size, [(tail, offset in the tail, length)]) of tails of 1 to WINDOW - 1 ids."""
    half = TIERS[-2]
    long = sorted((n, i, 0) for i, n in enumerate(lengths) if n > half)
    short = sorted((n, i, 0) for i, n in enumerate(lengths) if n <= half)
    windows = []

    def route(n: int, i: int, at: int) -> None:
        if n:
            insort(long if n > half else short, (n, i, at))

    def fill(size: int, first: tuple[int, int, int]) -> None:
        pieces, gap = [(first[1], first[2], first[0])], size - first[0]
        while gap and (short or long):
            fits = bisect_right(short, (gap + 1,))
            if fits:
                n, i, at = short.pop(fits - 1)
            else:
                whole, i, at = short.pop(0) if short else long.pop(0)
                n = min(gap, whole)
                route(whole - n, i, at + n)
            pieces.append((i, at, n))
            gap -= n
        windows.append((size, pieces))

    while long:
        fill(WINDOW, long.pop())
    while short:
        n = short[-1][0]
        fill(next(t for t in TIERS if t >= n), short.pop())
    return windows


def _pieces(path: str, end: int, wide: bool):
    kind = "<u4" if wide else "<u2"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                rows = []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*(encode(encoding, text) if text else ()), end], "<u4")
                    for start in range(0, len(ids), WINDOW):
                        piece = ids[start : start + WINDOW]
                        full = len(piece) == WINDOW
                        rows.append((row, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), None if full else piece.astype(kind).tobytes()))
                at, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.binary()], strict=True))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    return work


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]


def _packed(groups: int, wide: bool):
    kind = "<u4" if wide else "<u2"

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group = table.column("bucket")[0].as_py()
        start, length, crc, tokens = (table.column(c).to_numpy() for c in ("start", "length", "ids_crc32", "doc_tokens"))
        full = int((length == WINDOW).sum())
        tails = [np.frombuffer(x, kind) for x in table.column("ids").slice(full).to_pylist()]
        row, begin, size, check, sequence, offset = list(range(full)), start[:full].tolist(), [WINDOW] * full, crc[:full].tolist(), list(range(full)), [0] * full
        windows, cost = [WINDOW] * full, [WINDOW**2] * full
        for window, pieces in pack(length[full:].tolist()):
            place = 0
            for i, at, n in pieces:
                row.append(full + i)
                begin.append(int(start[full + i]) + at)
                size.append(n)
                check.append(zlib.crc32(tails[i][at : at + n].astype("<u4").tobytes()))
                sequence.append(len(windows))
                offset.append(place)
                place += n
            windows.append(window if place & (place - 1) else place)
            cost.append(sum(n * n for _, _, n in pieces))
        step = np.zeros(len(windows), np.int64)
        base = 0
        for window in sorted(set(windows)):
            own = [i for i, w in enumerate(windows) if w == window]
            own.sort(key=lambda i: (-cost[i], i))
            steps = -(-len(own) // STEP)
            for rank, i in enumerate(own):
                turn, place = divmod(rank, steps)
                step[i] = base + (steps - 1 - place if turn % 2 else place)
            base += steps
        sequence = np.array(sequence, np.int64)
        return pa.table(
            [
                table.column("doc_id").take(pa.array(row, pa.int64())),
                pa.array(begin, pa.int64()),
                pa.array(size, pa.int64()),
                pa.array(check, pa.int64()),
                pa.array(tokens[row].astype(np.int64)),
                pa.array(group + groups * sequence),
                pa.array(offset, pa.int64()),
                pa.array(np.array(windows, np.int64)[sequence]),
                pa.array(group + groups * step[sequence]),
            ],
            names=OUT,
        )

    return work


def pack_documents(docs: DataFrame, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it lies in its document and in which sequence; ``path`` must exist on the executors."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    groups = max(1, -(-narrow.count() // GROUP))
    wide = encoder(path).n_vocab > 1 << 16
    pieces = narrow.mapInArrow(_pieces(path, end, wide), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long"))
    return dealt.groupBy("bucket").applyInArrow(_packed(groups, wide), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in OUT[1:]))
