"""Finds which windows of a fixed length recur anywhere in a corpus, without moving every window.

Texts are dealt into chunks of bounded size. Each window has an anchor, the leftmost of its least-hashed k-grams, so equal windows have equal anchors at equal
offsets, and about 2 in w + 1 places are anchors. Only anchors' keys are counted over the corpus, each once a chunk. Around anchors whose key recurs, the union of
their windows (an entry: a left and a right context) goes, collapsed to distinct entries a chunk, to the place of its key, where an operator's own index decides. What comes
back to the chunk is intervals. The shuffle of the texts is made once and read three times.

A key that many chunks have, or that has many distinct entries (a line common to a corpus, with other neighbours each time), would bring them all to one place. Such a key is hot:
its entries don't travel. Each of its windows is one record under a 128-bit hash of its content, once a chunk; what recurs within the chunk is settled there. Records of a window
meet in two levels: first those of about sqrt(chunks) chunks, then one from each of these. So no group grows with the number of documents,
and none beyond the square root of that of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from hashlib import blake2b
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import groups, slice_hashes
from .words import mix

#: Texts in a chunk, in bytes; chunks, or entries counted once a chunk, from which on a key is hot.
CHUNK_BYTES, HOT_CHUNKS, HOT_ENTRIES = 8 << 20, 128, 1024
#: A hot window: its hash, where the chunk has it first, whether the chunk has it twice, and the sort key of that first text.
RECORD = np.dtype([("hi", "u8"), ("lo", "u8"), ("chunk", "i4"), ("doc", "i4"), ("start", "i4"), ("twice", "?"), ("null", "?"), ("id", "i8"), ("th", "i8")])


@dataclass
class Anchors:
    """Number of the text, place of the anchor, first and last start of a window that has it, key, hash of the entry; places count from the text's begin."""

    doc: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    key: np.ndarray
    content: np.ndarray

    def pick(self, which: np.ndarray) -> Anchors:
        return Anchors(*(getattr(self, f.name)[which] for f in fields(self)))

    @staticmethod
    def join(parts: list[Anchors]) -> Anchors:
        return Anchors(*(np.concatenate([getattr(p, f.name) for p in parts]) if parts else np.zeros(0, np.int64) for f in fields(Anchors)))


@dataclass
class Chunk:
    """Texts in one order whatever the order of arrival, by id (null ones last), hash of the text, text; equal ids and hashes share a chunk."""

    number: int
    ids: list
    hashes: list[int]
    texts: list[bytes]

    @staticmethod
    def of(table: pa.Table) -> Chunk:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "th", "raw"))), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        return Chunk(table.column("chunk")[0].as_py(), *([r[k] for r in rows] for k in range(3)))

    def keys(self) -> np.ndarray:
        """A row (null, id, hash of the text) for each text: its place in the order of all texts."""
        return np.array([(i is None, i or 0, h) for i, h in zip(self.ids, self.hashes)], np.int64).reshape(-1, 3)


def find_anchors(grams: np.ndarray, begin: np.ndarray, k: int, window: int, units: np.ndarray) -> Anchors:
    """``grams``: hash of the k-gram that begins at each unit of all texts (any value where it crosses a text's end); ``begin``: where texts begin, one more than texts; ``units``: what entries are hashed from."""
    w, n = window - k + 1, len(grams)
    sizes = np.diff(begin)
    starts = np.maximum(sizes - window + 1, 0)
    if not starts.sum():
        return Anchors.join([])
    bits = np.uint64(max(1, int(n).bit_length()))
    rows = -(-n // w) + 1
    value = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    value[:n] = (mix(grams) >> bits << bits) | np.arange(n, dtype=np.uint64)
    grid = value.reshape(rows, w)
    to_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    from_start = np.minimum.accumulate(grid, axis=1).reshape(-1)
    doc = np.repeat(np.arange(len(sizes)), starts)
    p = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts) + begin[doc]
    at = (np.minimum(to_end[p], from_start[p + w - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(edge[1:], len(at)) - 1
    at, doc, base = at[edge], doc[edge], begin[doc[edge]]
    content = mix(slice_hashes(units, p[edge], p[last] + window) + (at - p[edge]).astype(np.uint64))
    return Anchors(doc, at - base, p[edge] - base, p[last] - base, grams[at], content)


def window_records(chunk: Chunk, a: Anchors, window: int, contents: Callable[[list[bytes], np.ndarray, np.ndarray], Iterable[bytes]], first_stays: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows of the anchors: a record for each distinct one, and rows (doc, low, high) of those that recur in the chunk itself."""
    n = a.high - a.low + 1
    doc = np.repeat(a.doc, n)
    start = np.repeat(a.low, n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    digests = bytearray()
    for part in batched(contents(chunk.texts, doc, start), 1 << 14):
        digests += b"".join([blake2b(x, digest_size=16).digest() for x in part])
    both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    by_content = np.lexsort((both[:, 1], both[:, 0]))  # stable: the first of equal ones leads
    new = np.ones(len(both), bool)
    new[1:] = (both[by_content[1:]] != both[by_content[:-1]]).any(axis=1)
    distinct, size = by_content[new], np.diff(np.append(np.flatnonzero(new), len(both)))
    out = np.zeros(len(distinct), RECORD)
    out["hi"], out["lo"], out["chunk"], out["doc"], out["start"] = both[distinct, 0], both[distinct, 1], chunk.number, doc[distinct], start[distinct]
    out["twice"] = size > 1
    key = chunk.keys()[doc[distinct]]
    out["null"], out["id"], out["th"] = key[:, 0], key[:, 1], key[:, 2]
    again = np.ones(len(doc), bool)
    again[distinct] = False
    if not first_stays:
        again[distinct[out["twice"]]] = True
    return out, np.stack([doc[again], start[again], start[again] + window], axis=1)


def meet(records: np.ndarray, first_stays: bool) -> tuple[np.ndarray, np.ndarray]:
    """Those records whose chunk has to remove its window, and one record of each distinct window to go on."""
    order = np.lexsort((records["th"], records["id"], records["null"], records["lo"], records["hi"]))
    r = records[order]
    begin = np.ones(len(r), bool)
    begin[1:] = (r["hi"][1:] != r["hi"][:-1]) | (r["lo"][1:] != r["lo"][:-1])
    if first_stays:
        return r[~begin], r[begin]
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, len(r)))
    recurs = (size > 1) | np.add.reduceat(r["twice"].astype(np.int64), at).astype(bool)
    on = r[at]
    on["twice"] = recurs
    return r[np.repeat(recurs, size) & ~r["twice"]], on


def marked(records: np.ndarray, window: int) -> list[tuple[int, np.ndarray]]:
    """Rows (doc, low, high) for each chunk."""
    rows = np.stack([records["doc"], records["start"], records["start"] + window], axis=1)
    return [(int(c), rows[records["chunk"] == c]) for c in np.unique(records["chunk"])]


def by_place(key: np.ndarray, places: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by place, and (place, from, to) in it."""
    place = (key >> np.uint64(33)).astype(np.int64) % places
    order = np.argsort(place, kind="stable")
    cut = np.flatnonzero(np.diff(place[order], prepend=-1, append=-1))
    return order, [(int(place[order[p]]), p, q) for p, q in zip(cut[:-1].tolist(), cut[1:].tolist())] if len(key) else []


def _table(**columns: list) -> pa.Table:
    kinds = {"place": pa.int64(), "chunk": pa.int32(), "blob": pa.binary()}
    return pa.table({c: pa.array(x, kinds[c]) for c, x in columns.items()})


def repeated_intervals(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    window: int,
    anchors: Callable[[list[bytes]], Anchors],
    encode: Callable[[Chunk, Anchors, int], list[tuple[int, bytes]]],
    decide: Callable[[list[tuple[int, bytes]]], list[tuple[int, np.ndarray]]],
    contents: Callable[[list[bytes], np.ndarray, np.ndarray], Iterable[bytes]],
    finish: Callable[[Chunk, np.ndarray], pa.Table],
    ddl: str,
    first_stays: bool,
    chunk_bytes: int = CHUNK_BYTES,
    hot_chunks: int = HOT_CHUNKS,
    hot_entries: int = HOT_ENTRIES,
) -> DataFrame:
    """``encode`` gives a blob for each place; ``decide`` takes all blobs of a place and gives, for chunks, rows (doc, low, high); ``contents`` gives the bytes of windows of hot keys, of which ``first_stays`` keeps the first."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")).withColumn("th", F.xxhash64("raw"))
    total = rows.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(parts, -(-total // chunk_bytes))
    #: Places follow the bytes too: four chunks' recurring entries each. Records of hot windows meet by ``side`` chunks, then by place.
    places = max(parts, -(-chunks // 4))
    side = max(1, round(chunks**0.5))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th"), F.lit(chunks)).cast("int"))

    def all_anchors(texts: list[bytes]) -> Anchors:
        out = []
        for a, b in groups(texts):
            part = anchors(texts[a:b])
            part.doc = part.doc + a
            out.append(part)
        return Anchors.join(out)

    def count(table: pa.Table) -> pa.Table:
        a, c = all_anchors(Chunk.of(table).texts), table.column("chunk")[0].as_py()
        key, content = a.key.astype(np.uint64), a.content.astype(np.uint64)
        order = np.lexsort((content, key))
        key, content = key[order], content[order]
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        new = np.ones(len(key), np.int64)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        entries = np.minimum(np.add.reduceat(new, at) if len(at) else new, 65535).astype(np.uint16)
        twice, key = np.diff(np.append(at, len(key))) > 1, key[at]
        order, parts = by_place(key, places)
        key, entries, twice = key[order], entries[order], twice[order]
        return _table(place=[p for p, _, _ in parts], chunk=[c] * len(parts), blob=[key[p:q].tobytes() + entries[p:q].tobytes() + twice[p:q].tobytes() for _, p, q in parts])

    def recur(table: pa.Table) -> pa.Table:
        blobs, of = table.column("blob").to_pylist(), table.column("chunk").to_pylist()
        sizes = [len(b) // 11 for b in blobs]
        key = np.concatenate([np.frombuffer(b, np.uint64, s) for b, s in zip(blobs, sizes)])
        entries = np.concatenate([np.frombuffer(b[8 * s : 10 * s], np.uint16) for b, s in zip(blobs, sizes)])
        twice = np.concatenate([np.frombuffer(b, bool, s, 10 * s) for b, s in zip(blobs, sizes)])
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        hot = ((n >= hot_chunks) | (np.bincount(inverse, entries) >= hot_entries))[inverse]
        keep, at, out = twice | (n[inverse] > 1), 0, []
        for c, s in zip(of, sizes):
            own = slice(at, at + s)
            at += s
            if keep[own].any():
                out.append((c, key[own][keep[own]].tobytes() + hot[own][keep[own]].tobytes()))
        return _table(chunk=[c for c, _ in out], blob=[b for _, b in out])

    def send(texts: pa.Table, keys: pa.Table) -> pa.Table:
        if not texts.num_rows or not keys.num_rows:
            return _table(place=[], blob=[], chunk=[])
        blobs = keys.column("blob").to_pylist()
        key = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 9) for b in blobs])
        hot = np.concatenate([np.frombuffer(b, bool, len(b) // 9, 8 * (len(b) // 9)) for b in blobs])
        order = np.argsort(key)
        key, hot = key[order], hot[order]
        chunk = Chunk.of(texts)
        a = all_anchors(chunk.texts)
        found = np.minimum(np.searchsorted(key, a.key.astype(np.uint64)), len(key) - 1)
        has = key[found] == a.key
        hot = has & hot[found]
        out = encode(chunk, a.pick(has & ~hot), places)
        if hot.any():
            records, marks = window_records(chunk, a.pick(hot), window, contents, first_stays)
            order, parts = by_place(records["hi"], side)
            first = places + chunk.number % side * side
            out += [(first + p, records[order[x:y]].tobytes()) for p, x, y in parts]
            out.append((-1 - chunk.number, marks.astype(np.int32).tobytes()))
        return _table(place=[p for p, _ in out], blob=[b for _, b in out], chunk=[chunk.number] * len(out))

    def settle(table: pa.Table) -> pa.Table:
        """Entries of a place; or the first meeting of hot windows, whose survivors go on to places; or marks that pass through."""
        place, blobs = table.column("place")[0].as_py(), table.column("blob").to_pylist()
        if place < 0:
            return _table(place=[place] * len(blobs), blob=blobs)
        if place < places:
            marks, on = decide(sorted(zip(table.column("chunk").to_pylist(), blobs), key=lambda r: r[0])), []
        else:
            gone, left = meet(np.frombuffer(b"".join(blobs), RECORD), first_stays)
            order, parts = by_place(left["hi"], places)
            marks, on = marked(gone, window), [(p, left[order[x:y]].tobytes()) for p, x, y in parts]
        out = [(-1 - c, m.astype(np.int32).tobytes()) for c, m in marks if len(m)] + on
        return _table(place=[p for p, _ in out], blob=[b for _, b in out])

    def settle_again(table: pa.Table) -> pa.Table:
        place, blobs = table.column("place")[0].as_py(), table.column("blob").to_pylist()
        if place < 0:
            return _table(chunk=[-1 - place] * len(blobs), blob=blobs)
        out = marked(meet(np.frombuffer(b"".join(blobs), RECORD), first_stays)[0], window)
        return _table(chunk=[c for c, _ in out], blob=[m.astype(np.int32).tobytes() for _, m in out])

    def end(texts: pa.Table, marks: pa.Table) -> pa.Table:
        rows = np.concatenate([np.zeros((0, 3), np.int32), *[np.frombuffer(b, np.int32).reshape(-1, 3) for b in marks.column("blob").to_pylist()]])
        return finish(Chunk.of(texts), rows)

    by_chunk = dealt.groupBy("chunk")
    keys = by_chunk.applyInArrow(count, "place long, chunk int, blob binary").groupBy("place").applyInArrow(recur, "chunk int, blob binary")
    entries = by_chunk.cogroup(keys.groupBy("chunk")).applyInArrow(send, "place long, blob binary, chunk int")
    marks = entries.groupBy("place").applyInArrow(settle, "place long, blob binary").groupBy("place").applyInArrow(settle_again, "chunk int, blob binary")
    return by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(end, ddl)


def cover(begin: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which units of all texts lie in an interval (doc, low, high) of ``marks``."""
    n = int(begin[-1])
    change = np.bincount(begin[marks[:, 0]] + marks[:, 1], minlength=n + 1) - np.bincount(begin[marks[:, 0]] + marks[:, 2], minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each place; the last k - 1 places get 0."""
    out = np.zeros(len(data), np.uint64)
    n = len(data) - k + 1
    if n > 0:
        at = np.arange(n)
        out[:n] = slice_hashes(data, at, at + k)
    return out
