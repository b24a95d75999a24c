"""Packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder, groups
from .io import Scratch, map_batches, texts_of


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item, taken in the order given, in bins of ``capacity``.

    With N(g) open bins of gap g, an item of length s goes where the sum of N(g)**2 over 0 < g < capacity grows least: into a bin of gap g >= s (N(g) falls, N(g - s)
    rises unless that is 0) or a new bin. Of equal choices, the smallest gap. Closed bins count nothing.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, places, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        here = count[s:capacity]
        rise = 2 * count[: capacity - s] + 1
        if s < capacity:
            rise[0] = 0
        cost = np.where(here > 0, rise - 2 * here + 1, far)
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(cost.argmin()) if len(cost) else -1
        if best >= 0 and cost[best] < fresh:
            g = s + best
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        bins[i], places[i] = b, capacity - g
        if g > s:
            open_bins[g - s].append(b)
            count[g - s] += 1
    return bins, places


def pack_lengths(lengths: np.ndarray, capacity: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares, longest first. Then, ``rounds`` times, the bins that it left open are emptied and their items placed by the same rule, shuffled (by a fixed seed) and longest first by turns; a round counts if it saves a bin."""

    def placed(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sum_of_squares(lengths[items], capacity)

    longest, r = np.argsort(-lengths, kind="stable"), np.random.default_rng(0)
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[longest], places[longest] = placed(longest)
    for k in range(rounds):
        filled = np.bincount(bins, lengths, 0)
        again = np.flatnonzero(filled[bins] < capacity)
        if not len(again):
            break
        items = again[np.argsort(-lengths[again], kind="stable")] if k % 2 else r.permutation(again)
        new, place = placed(items)
        if new.max() + 1 < np.count_nonzero((filled < capacity) & (filled > 0)):
            bins[items], places[items] = new + len(filled), place
    return np.unique(bins, return_inverse=True)[1], places


def special_tokens(path: str) -> dict[str, int]:
    """The strings that a tokenizer file's library takes out of a text before it splits it, with their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def token_bytes(enc: Encoder, texts: list[str], special: Mapping[str, int]) -> list[bytes]:
    """Each text's ids, little-endian. A special string is its id, and what lies between two is encoded by itself."""
    rx = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    cut = [rx.split(t) if rx else [t] for t in texts]
    ids, at = enc.encode([x for parts in cut for x in parts[::2]])
    raw, at, out, k = ids.astype("<u4").tobytes(), at.tolist(), [], 0
    for parts in cut:
        whole = []
        for i, x in enumerate(parts):
            if i % 2:
                whole.append(special[x].to_bytes(4, "little"))
            else:
                whole.append(raw[4 * at[k] : 4 * at[k + 1]])
                k += 1
        out.append(b"".join(whole))
    return out


def pieces(docs: DataFrame, ranks_path: str, end_id: int, capacity: int, special: Mapping[str, int], id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32 (and ids): each document's tokens and an end id, cut from the back into pieces of ``capacity``."""

    def rows(batch: pa.RecordBatch) -> list:
        texts, enc, doc_ids = texts_of(batch, "text"), encoder(ranks_path), batch.column("doc_id").to_pylist()
        out: list[list] = [[] for _ in range(5 + with_ids)]
        tail = int(end_id).to_bytes(4, "little")
        for a, b in groups(texts):
            for k, whole in enumerate(token_bytes(enc, texts[a:b], special)):
                whole += tail
                n, start, piece = len(whole) // 4, 0, 0
                stop = (n - 1) % capacity + 1
                while start < n:
                    part = whole[4 * start : 4 * stop]
                    for column, x in zip(out, (doc_ids[a + k], piece, start, stop - start, zlib.crc32(part), part)):
                        column.append(x)
                    start, stop, piece = stop, stop + capacity, piece + 1
        return out

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), rows, ddl, pa.schema(fields))


def pack(docs: DataFrame, ranks_path: str, end_id: int = 2, capacity: int = 1024, shard_pieces: int = 150_000, with_ids: bool = False, special: Mapping[str, int] | None = None, **columns: str) -> DataFrame:
    """The pieces of every document with sequence_id and offset.

    Pieces are written to a table and dealt out by hash to shards of about ``shard_pieces`` each; a shard packs them by the sum-of-squares
    rule, longest first, so a task's work is bounded whatever the corpus; what is in sequences left open at the end is placed again by the same rule. Only lengths are needed: token ids stay out of the shuffle
    unless asked for. ``special`` has strings that stand for one id each wherever they are in a text; without it they are ordinary text.

    A null or empty text is its end id alone. A very long text is encoded whole, then cut. Null ids and repeated rows are packed like others; an empty table gives an empty result; other
    columns are ignored.
    """
    store = Scratch(docs.sparkSession)
    cut, n = store.counted(pieces(docs, ranks_path, end_id, capacity, special or {}, with_ids=with_ids, **columns))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, round(n / shard_pieces)))))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "piece")])
        bins, places = pack_lengths(table.column("length").to_numpy(), capacity)
        first = table.column("shard")[0].as_py() << 40
        return table.drop_columns("shard").append_column("sequence_id", pa.array(bins + first, pa.int64())).append_column("offset", pa.array(places, pa.int64()))

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return store.finish(cut.groupBy("shard").applyInArrow(fill, ddl))
