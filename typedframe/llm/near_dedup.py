"""Near-duplicates by MinHash bands, odd sketches and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import groups
from .io import Scratch, map_batches, slices, texts_of
from .words import mix, shingle_sets, similar

#: A pair at similarity s shares no band with probability (1 - s**ROWS)**BANDS: 7e-8 at 0.85, 1.5e-5 at 0.8, but 0.006 at 0.7. So thresholds below LEAST_PERCENT are refused.
BANDS, ROWS, SKETCH_BITS, LEAST_PERCENT = 28, 5, 512, 80
#: Pairs whose sketches estimate a similarity below threshold - MARGIN (over five standard deviations) aren't confirmed on full sets.
MARGIN = 0.18
#: Ids of documents to confirm are broadcast up to this many, 2 MB; beyond, they are joined by shuffle.
MOST_BROADCAST = 1 << 18
#: Keys with HOT_ROWS rows and a share of 1 / MOST_HOT of all rows are dealt over SALTS; there are at most MOST_HOT such keys, whatever the data, so that their list may be broadcast.
HOT_ROWS, MOST_HOT, SALTS = 256, 20_000, 64
#: Members of a bucket are compared in blocks of about so many rows and bytes at the most; two blocks meet in one place, and places hold about so many rows and bytes.
BLOCK, BLOCK_BYTES, PLACE_ROWS, PLACE_BYTES = 512, 4 << 20, 1 << 13, 8 << 20


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def minhashes(shingles: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples (rows) of each non-empty set (columns)."""
    out = np.empty((n, len(at)), np.uint64)
    xor, times = _seeds(n, 1), _seeds(n, 2) | np.uint64(1)
    for k in range(n):
        out[k] = np.minimum.reduceat((shingles ^ xor[k]) * times[k], at)
    return out


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps (a row of 64-bit words for each set): each sample flips one bit."""
    n, sets = samples.shape
    place = mix(samples + _seeds(n, 3)[:, None]) % np.uint64(bits)
    odd = np.zeros(sets * bits, np.uint8)
    key = place.astype(np.int64) + np.arange(sets) * bits
    odd[:] = np.bincount(key.ravel(), minlength=sets * bits) & 1
    return np.packbits(odd.reshape(sets, bits), axis=1).view(np.uint64)


def least_agreeing(similarity: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """The popcount of two sketches' XOR that is expected at this similarity: each of the differing samples' two values flips one of ``bits``."""
    return int(bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity))))


def _class(raw: bytes) -> bytes:
    """A text's class: 128 bits of SHA-256 over its words."""
    return sha256(b" ".join(raw.split())).digest()[:16]


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Columns doc_id, text_hash, size (bytes of the text), n_shingles, cls (hash of the word sequence), bands and sketch (arrays of long)."""

    def rows(batch: pa.RecordBatch) -> list:
        plain = [t.encode() for t in texts_of(batch, "text")]
        texts = [t.lower() for t in plain]
        out: list[list] = [[] for _ in range(4)]
        for a, b in groups(texts):
            sets, at, n = shingle_sets(texts[a:b], shingle)
            full = np.flatnonzero(n)
            cols: list[list] = [list(map(_class, texts[a:b])), [[]] * (b - a), [[]] * (b - a)]
            if len(full):
                samples = minhashes(sets, at[:-1][full], BANDS * ROWS)
                keys = np.zeros((BANDS, len(full)), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys + samples[r::ROWS])
                keys = mix(keys + _seeds(BANDS, 4)[:, None]).T.view(np.int64)
                for i, k, s in zip(full.tolist(), keys, odd_sketches(samples).view(np.int64)):
                    cols[1][i], cols[2][i] = k, s
            for column, x in zip(out, (n.tolist(), *cols)):
                column.extend(x)
        return [batch.column("doc_id"), [sha256(t).digest() for t in plain], [len(t) for t in texts], *out]

    arrow = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.binary()), ("size", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id long, text_hash binary, size long, n_shingles long, cls binary, bands array<long>, sketch array<long>", arrow)


def _differing(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, b: a + b)


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame | None:
    """Of keys with their counts (n), those that a share of all rows has (hot_key), or None if there can't be any. They are at most MOST_HOT."""
    least = max(HOT_ROWS, -(-total // MOST_HOT))
    if total < least:
        return None
    found = [tuple(r) for r in counts.where(F.col("n") >= least).select(key).collect()]
    return counts.sparkSession.createDataFrame(found, T.StructType([T.StructField("hot_key", counts.schema[key].dataType)])) if found else None


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """The inner join on ``key``; of a hot key, left rows are dealt over SALTS tasks and right rows are copied to each."""
    if hot is None:
        return left.join(right, key)
    hot = F.broadcast(hot)
    mine = left.join(hot, left[key] == hot["hot_key"], "left").withColumn("salt", F.when(F.col("hot_key").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))).drop("hot_key")
    every = F.when(F.col("hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    theirs = right.join(hot, right[key] == hot["hot_key"], "left").withColumn("salt", F.explode(every)).drop("hot_key")
    return mine.join(theirs, [key, "salt"]).drop("salt")


def class_texts(docs: DataFrame, needed: DataFrame, few: bool) -> DataFrame:
    """Columns cls, text: one text of each class in ``needed`` (cls, rep). Few ids are broadcast, so the other texts aren't moved."""
    needed = needed.distinct()
    ids = needed.select(F.col("rep").alias("rep_id")).distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("rep_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [t.encode().lower() for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([_class(r) for r in raws], pa.binary()), pa.array(raws, pa.binary())], names=["cls", "text"])

    found = texts.mapInArrow(run, "cls binary, text binary").join(needed.select("cls"), "cls", "left_semi")
    return found.groupBy("cls").agg(F.min("text").alias("text"))  # rows may repeat an id, and null ids are many texts'


def confirm(pairs: DataFrame, total: int, classes: DataFrame, docs: DataFrame, percent: int, shingle: int, store: Scratch) -> tuple[DataFrame, int]:
    """Those of the ``total`` pairs (a, b) whose full sets have 100 * intersection >= percent * union, and how many. A text is moved once a pair at most; a class in many pairs is dealt out."""
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = store.keep(class_texts(docs, ends.join(classes.select("cls", "rep"), "cls"), 2 * total <= MOST_BROADCAST))
    full = pairs
    for end in "ba":
        hot = hot_keys(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")), end, total)
        full = dealt_join(full, texts.select(F.col("cls").alias(end), F.col("text").alias(f"text_{end}")), end, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = (batch.column(c).to_pylist() for c in ("text_a", "text_b"))
            keep = [np.zeros(0, bool)]
            for p, q in groups([x + y for x, y in zip(left, right)]):
                keep.append(similar([x.split() for x in left[p:q]], [x.split() for x in right[p:q]], percent, shingle))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(np.concatenate(keep), pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return store.counted(full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary"))


def components(edges: DataFrame, store: Scratch) -> DataFrame:
    """(node, root) for each node of the edges (a, b), the root being the smallest node reachable.

    Large-star and small-star steps by turns, each a group-by, each round one job whose result is written to the shared folder and whose rows are counted and summed
    up on the way: it ends when nothing changes. Rounds grow with the logarithm of the longest path. Two numbers reach the driver a round.
    """
    now, last = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        seen = Observation()
        now = store.keep(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")))
        if (got := (seen.get["n"], seen.get["s"])) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = got


def merged(roots: DataFrame, links: DataFrame, store: Scratch) -> DataFrame:
    """The components (node, root) after more links: only the roots that these join go through the steps again."""
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab"]
    links = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    top = components(links, store).select(F.col("node").alias("root"), F.col("root").alias("top"))
    joined = roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return store.keep(joined.union(top.join(roots, top["root"] == roots["node"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))))


def _blocks(members: DataFrame, rows: int, bytes_a_row: str) -> DataFrame:
    """Members (key, ...) with i, j, own and place: blocks i and j of a bucket meet; ``own`` is a member's block."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.expr(f"sum({bytes_a_row})").alias("bytes"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int"))
    total = sizes.agg(F.sum(F.col("n") * F.col("blocks")).alias("n"), F.sum(F.col("bytes") * F.col("blocks")).alias("bytes")).first()
    places = max(1, -(-(total["n"] or 0) // PLACE_ROWS), -(-(total["bytes"] or 0) // PLACE_BYTES))
    out = dealt_join(members, sizes.select("key", "blocks"), "key", hot_keys(sizes, "key", rows))
    out = out.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    out = out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
    return out.withColumn("place", F.pmod(F.xxhash64("key", "i", "j"), F.lit(places)))


class Place:
    """All rows that meet in a place, in the order of bucket and blocks."""

    def __init__(self, table: pa.Table):
        self.table = t = table.sort_by([(c, "ascending") for c in ("key", "i", "j", "own", "cls")])
        self.key, self.i, self.j, self.own = (t.column(c).to_numpy() for c in ("key", "i", "j", "own"))
        self.cls, self.root = t.column("cls").to_pylist(), t.column("root").to_pylist()
        number = {r: k for k, r in enumerate(dict.fromkeys(self.root))}
        self.component = np.array([number[r] for r in self.root], np.int64)
        self.sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(self.key), -1)

    def meetings(self, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each member, with those of other components that it meets and whose sketches agree, nearest first."""
        key, i, j = self.key, self.i, self.j
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
        for p, q in zip(cut[:-1].tolist(), cut[1:].tolist()):
            mid = q if i[p] == j[p] else p + int(np.searchsorted(self.own[p:q], j[p]))
            for x in range(p, mid):
                first = x + 1 if i[p] == j[p] else mid
                far = np.bitwise_count(self.sketch[first:q] ^ self.sketch[x]).sum(axis=1)
                near = np.flatnonzero((far <= most) & (self.component[first:q] != self.component[x]))
                if len(near):
                    yield x, first + near[np.argsort(far[near], kind="stable")]


def _survivors(members: DataFrame, rows: int, most: int) -> DataFrame:
    """Those members (key, cls, root, sketch) that agree with one of another component in their bucket: by sketches alone, a row each at the most."""

    def screen(table: pa.Table) -> pa.Table:
        place = Place(table)
        found = np.zeros(len(place.key), bool)
        for x, near in place.meetings(most):
            found[x] = True
            found[near] = True
        return place.table.filter(pa.array(found)).select(["key", "cls"])

    return _blocks(members, rows, "64").groupBy("place").applyInArrow(screen, "key long, cls binary").distinct()


def _bucket_links(members: DataFrame, rows: int, most: int, percent: int, shingle: int) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join the components of each bucket's members (key, cls, root, sketch, bands, text, size).

    Texts meet once for BLOCK comparisons of theirs. Only links become rows, fewer than components: pairs that a link has joined are skipped, and a pair is compared only in the first bucket that it shares.
    """

    def compare(table: pa.Table) -> pa.Table:
        place = Place(table)
        bands = place.table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(place.key), -1)
        text, sets, root, found = place.table.column("text"), {}, {}, []

        def of(k: int) -> tuple[np.ndarray, int, bytes]:
            """Shingle hashes, exact number of shingles, text."""
            if place.cls[k] not in sets:
                raw = text[k].as_py()
                hashes, _, n = shingle_sets([raw], shingle)
                sets[place.cls[k]] = hashes, int(n[0]), raw
            return sets[place.cls[k]]

        def linked(x: int, y: int) -> bool:
            """By hashes first, which can only rule a pair out where none stands for two shingles of a set; words decide."""
            (a, n, s), (b, m, t) = of(x), of(y)
            if n == len(a) and m == len(b):
                if 100 * min(n, m) < percent * max(n, m):
                    return False
                both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), m - 1)] == a))
                if 100 * both < percent * (n + m - both):
                    return False
            return bool(similar([s.split()], [t.split()], percent, shingle)[0])

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        for x, near in place.meetings(most):
            same = bands[near] == bands[x]
            for y in near[bands[x][same.argmax(axis=1)] == place.key[x]].tolist():
                a, b = find(int(place.component[x])), find(int(place.component[y]))
                if a != b and linked(x, y):
                    root[max(a, b)] = min(a, b)
                    found.append((max(place.cls[x], place.cls[y]), min(place.cls[x], place.cls[y])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return _blocks(members, rows, "size").groupBy("place").applyInArrow(compare, "a binary, b binary").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, link_null_ids: bool = False, with_hash: bool = False) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept (and text_hash, SHA-256 of the text), a row for each input row.

    Texts of equal words are one class from the start. Each class meets the smallest class of its buckets first, then the first of each bucket that isn't in its
    component yet, and last, in blocks, all of its buckets' members in other components: by sketches, and those that agree with one by their texts. So large groups of near copies collapse before anything quadratic, and no pair
    of a bucket goes unexamined: pairs are left out only if one component holds them already or their sketches are far apart. Every link is confirmed on the words of the full sets. What
    lies between is deleted when the result is written.

    Texts without words, null ones included, have an empty set and are linked with nothing. A text of any length is one set, made whole. A null id has a null component and is
    kept; with ``link_null_ids`` it takes part in links but never names a component, and where all ids are null, the rows of the smallest class by hash are kept. Rows that repeat an id are one document: its texts are
    linked. Ties can't arise, components being sets. An empty table gives an empty result; other columns are ignored. A ``percent`` outside LEAST_PERCENT to 100 is an error: the bands would lose pairs.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100, not {percent}")
    store, most = Scratch(docs.sparkSession), least_agreeing(percent / 100 - MARGIN)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sig = store.keep(signatures(texts, "doc_id", "text", shingle))
    own = sig.where("n_shingles > 0") if link_null_ids else sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes, n_classes = store.counted(own.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("size").alias("size")))
    sketches = classes.select("cls", "sketch")
    spread = classes.select("cls", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("cls").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = store.keep(shared.join(sketches.select(F.col("cls").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot"))
    hot = hot_keys(shared, "key", BANDS * n_classes)
    members = store.keep(dealt_join(spread, shared.select("key", "pivot", "pivot_sketch"), "key", hot))

    def near(pairs: DataFrame) -> tuple[DataFrame, int]:
        """Of the pairs (cls, pivot, pivot_sketch) those whose sketches agree, as (a, b), and how many."""
        pairs = pairs.join(sketches, "cls").where(_differing(F.col("sketch"), F.col("pivot_sketch")) <= most)
        return store.counted(pairs.select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct())

    def confirmed(pairs: DataFrame, n: int) -> tuple[DataFrame, int]:
        return confirm(pairs, n, classes, texts, percent, shingle, store) if n else (pairs, 0)

    def labelled() -> DataFrame:
        """Members of buckets that more than one component shares."""
        every = members.select("key", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
        mixed = every.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return dealt_join(every, mixed, "key", hot)

    first = members.groupBy("cls").agg(F.min(F.struct("pivot", "pivot_sketch")).alias("p")).select("cls", "p.*").where("cls <> pivot")
    edges, _ = confirmed(*near(first))
    of_id = own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("last")).where("b <> last")
    edges = edges.union(own.join(of_id, "doc_id").select(F.col("cls").alias("a"), "b").where("a <> b"))
    roots = components(edges, store)

    pivots = shared.join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root")), "pivot", "left").select("key", "pivot", "pivot_sketch", F.coalesce("pivot_root", "pivot").alias("pivot_root"))
    pairs = dealt_join(labelled(), pivots, "key", hot).where("root <> pivot_root").groupBy("cls", "pivot").agg(F.first("pivot_sketch").alias("pivot_sketch"))
    found, n = confirmed(*near(pairs))
    if n:
        roots = merged(roots, found, store)
    rest, n = store.counted(labelled().join(sketches, "cls"))
    if n:
        alive, n = store.counted(rest.join(_survivors(rest, n, most), ["key", "cls"]))
    if n:
        texts_of_rest = class_texts(texts, alive.select("cls").distinct().join(classes.select("cls", "rep"), "cls"), n <= MOST_BROADCAST)
        found, n = store.counted(_bucket_links(alive.join(classes.select("cls", "bands", "size"), "cls").join(texts_of_rest, "cls"), n, most, percent, shingle))
    if n:
        roots = merged(roots, found, store)
    linked = roots.withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls")
    linked = linked.join(linked.groupBy("root").agg(F.min("rep").alias("least")), "root").select("cls", "root", "least")
    out = sig.drop("bands", "sketch", "size").join(classes.select("cls", "rep"), "cls", "left").join(linked, "cls", "left")
    alone = (F.col("n_shingles") == 0) if link_null_ids else (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")))
    named = F.when(F.col("component_id").isNull(), F.coalesce("root", "cls") == F.col("cls")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    out = out.withColumn("kept", F.when(alone, True).otherwise(named))
    return store.finish(out.select("doc_id", "n_shingles", "component_id", "kept", *["text_hash"] * with_hash))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, one document of each group: each row is judged by its id and text, null ids linked like others. Few dropped rows' hashes are broadcast, so texts aren't moved.

    Cases as in ``near_dedup``; rows of equal id and text share one verdict.
    """
    store = Scratch(docs.sparkSession)
    verdicts = near_dedup(docs, id_col, text_col, percent, shingle, link_null_ids=True, with_hash=True)
    gone, n = store.counted(verdicts.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    own = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return docs.join(F.broadcast(gone) if n <= MOST_BROADCAST else gone, F.col(id_col).cast("long").eqNullSafe(F.col("gone_id")) & (own == F.col("gone_hash")), "left_anti")


#: The same result at 85 by counting the shingles that any two documents share.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
t AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
