"""Words that collide under polynomial hashes, hot passages, near copies at the threshold, and very long texts."""

import collections
import hashlib
import os
import random
import uuid
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pytest

from typedframe.llm import bpe, exact_dedup, io, near_dedup, quality, secret_scan, substring_dedup, suffix_dedup
from typedframe.llm.words import exact_windows, hash_slices, same_slices, shingle_sets, similar, split

sha = lambda b: hashlib.sha256(b).hexdigest()


def thue_morse(n: int = 11) -> tuple[str, str]:
    """Two words of 2**n letters that every polynomial hash modulo 2**64 takes for equal."""
    t = [0]
    for _ in range(n):
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


X, Y = thue_morse()


def test_the_words_collide():
    v = [np.frombuffer(w.encode(), np.uint8) for w in (X, Y)]
    a, b = (bpe.slice_hashes(x, np.array([0]), np.array([len(x)]))[0] for x in v)
    assert X != Y and a == b


def test_substring_dedup_tells_colliding_words_apart(spark):
    head = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{head} {X}"), (2, f"{head} {Y}"), (3, f"{head} {X}")], "doc_id long, text string")
    for hot in (128, 1):
        got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs, hot_chunks=hot).collect()}
        assert got == {1: 0, 2: 0, 3: 20}


def test_quality_tells_colliding_words_apart(spark):
    docs = spark.createDataFrame([(1, f"x y {X} x x y {Y}"), (2, f"x y {X} z x y {X}")], "doc_id long, text string")
    out = quality.quality_rules(docs.selectExpr("*", "'en' AS lang"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"))
    assert {r.doc_id: r.n_repeat_words for r in out.collect()} == {1: 0, 2: 6}


def test_near_dedup_tells_colliding_words_apart(spark):
    head = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{head} {X} {head} {X}"), (2, f"{head} {Y} {head} {Y}"), (3, f"a b c d {X} a b c d {Y}"), (4, f"a b c d {X} a b c d {X}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs, percent=85).collect()}
    count = lambda t: len({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    assert got == {r.doc_id: (count(r.text), r.doc_id) for r in docs.collect()}


def test_word_hashes_and_bytes():
    r = random.Random(3)
    words = [bytes(r.choice(b"ab\xc3") for _ in range(r.choice((1, 2, 7, 8, 9, 16, 17, 40, 63, 64, 65, 200)))) for _ in range(3000)] + [X.encode(), Y.encode()]
    data, starts, ends, _ = split([b" ".join(words)])
    h = hash_slices(data, starts, ends)
    assert len({*h.tolist()}) == len({*words}) and len({*zip(h.tolist(), words)}) == len({*words})
    a, b = (np.array([r.randrange(len(words)) for _ in range(4000)]) for _ in range(2))
    assert same_slices(data, starts, ends, a, b).tolist() == [words[x] == words[y] for x, y in zip(a, b)]


def test_set_sizes_survive_colliding_hashes(monkeypatch):
    """Were all words' hashes equal, set sizes would still be right, and so are similarities."""
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60))).encode() for _ in range(80)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} or ({tuple(t.split())} if t.split() else set()) for t in texts]
    assert shingle_sets(texts)[2].tolist() == list(map(len, sets))
    monkeypatch.setitem(shingle_sets.__globals__, "hash_slices", lambda d, s, e: np.zeros(len(s), np.uint64))
    assert shingle_sets(texts)[2].tolist() == list(map(len, sets))
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(500)]
    got = similar([texts[a].split() for a, _ in pairs], [texts[b].split() for _, b in pairs], 10)
    assert got.tolist() == [bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 10 * len(sets[a] | sets[b]) for a, b in pairs]


def test_exact_windows():
    r = np.random.default_rng(1)
    x = r.integers(0, 4, 500)
    code = exact_windows(x, 3)
    seen: dict = {}
    assert all(seen.setdefault(c, t) == t for c, t in zip(code.tolist(), zip(x[:-2].tolist(), x[1:-1].tolist(), x[2:].tolist()))) and len(seen) == len({*seen.values()})


def test_links_at_the_threshold_are_found(spark):
    """Recall on 2,000 planted pairs of similarity 0.85 to 0.90 and one of 2,000 just below."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(10**6)}"
    rows, linked = [], 0
    share = lambda a, b: (lambda s, t: 100 * len(s & t) / len(s | t))(*({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b)))
    want = {}
    for k in range(4000):
        low, high = (85, 90) if k % 2 else (80, 85)
        while True:
            a = [word() for _ in range(r.randint(60, 160))]
            b = list(a)
            for p in r.sample(range(len(a)), r.choice((1, 2, 3))):
                b[p] = word()
            if low <= share(a, b) < high:
                break
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if k % 2 else 2 * k + 1}
        linked += k % 2
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85)
    assert linked == 2000 and {x.doc_id: x.component_id for x in out.collect()} == want


def test_near_dedup_of_null_and_repeated_ids(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    docs = spark.createDataFrame([(7, a), (None, a + " more"), (3, b), (9, b), (9, a), (None, "c d"), (None, None)], "doc_id long, text string")
    plain = sorted(((x.doc_id, x.component_id, x.kept) for x in near_dedup.near_dedup(docs).collect()), key=repr)
    assert plain == sorted([(7, 3, False), (3, 3, True), (9, 3, False), (9, 3, False)] + [(None, None, True)] * 3, key=repr)
    linked = near_dedup.near_dedup(docs, link_null_ids=True)
    assert sorted(((x.doc_id, x.component_id, x.kept) for x in linked.collect()), key=repr) == sorted([(7, 3, False), (None, 3, False), (3, 3, True), (9, 3, False), (9, 3, False), (None, None, True), (None, None, True)], key=repr)


def test_hot_line_makes_no_large_group(spark, monkeypatch):
    """One line of 260 bytes in 20,000 documents with other neighbours each time: no place gets a share that grows with them, and the result is right."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    r = random.Random(4)
    line = "".join(r.choice("abcdefghij ") for _ in range(259)) + "."
    fill = lambda: "".join(r.choice("klmnopqrstuvwxyz ") for _ in range(150))
    sides = [(fill(), fill()) for _ in range(20_000)]
    docs = spark.createDataFrame([(k, f"{a}{line}{b}") for k, (a, b) in enumerate(sides)], "doc_id long, text string").repartition(8).cache()

    def most_shared(strings: list[str]) -> list[int]:
        """The longest prefix that each shares with another: a neighbour's in their order."""
        order = sorted(range(len(strings)), key=strings.__getitem__)
        lcp = [len(os.path.commonprefix([strings[x], strings[y]])) for x, y in zip(order, order[1:])]
        return [n for _, n in sorted((k, max(p, q)) for k, p, q in zip(order, [0, *lcp], [*lcp, 0]))]

    want = {k: 260 + x + y for k, (x, y) in enumerate(zip(most_shared([a[::-1] for a, _ in sides]), most_shared([b for _, b in sides])))}
    seen, plain = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, *a: (seen.append(plain(self, *a)), seen[-1])[1])
    out = suffix_dedup.suffix_dedup(docs, chunk_bytes=1 << 18).collect()
    assert {x.doc_id: x.n_removed for x in out} == want and {x.n_spans for x in out} == {1}
    blobs = seen[0].where("place >= 0").selectExpr("place", "length(blob) AS n").groupBy("place").agg({"n": "sum", "place": "count"}).collect()
    sizes, counts = ([x[c] for x in blobs] for c in ("sum(n)", "count(place)"))
    assert max(sizes) < 0.1 * sum(sizes) and max(counts) <= 60
    docs.unpersist()


@pytest.mark.parametrize("depth", [2, 5, 7, 20])
def test_matching_statistics(depth):
    r = np.random.default_rng(depth)
    segments = [r.integers(1, 4, r.integers(1, 40)) for _ in range(60)]
    segments += [np.concatenate([segments[3], segments[4]]), segments[5], np.array([9]), np.array([9, 9, 9, 9])]
    text = np.concatenate([np.append(s, 0) for s in segments])
    begin = np.cumsum([0, *[len(s) + 1 for s in segments]])[:-1]
    end = begin + [len(s) for s in segments]
    length, start = substring_dedup.matching_statistics(substring_dedup.FMIndex(text, depth), text, begin, end)
    seen = [collections.Counter(tuple(text[k : k + n].tolist()) for k in range(len(text) - n + 1)) for n in range(depth + 1)]
    want, interval = np.zeros(len(text), int), {}
    for a, b in zip(begin, end):
        for p in range(a, b):
            want[p] = max(n for n in range(min(depth, b - p) + 1) if n == 0 or seen[n][tuple(text[p : p + n].tolist())] > 1)
            if want[p] == depth:
                assert interval.setdefault(tuple(text[p : p + depth].tolist()), start[p]) == start[p]
    assert length.tolist() == want.tolist() and len(interval) == len({*interval.values()})


@pytest.mark.parametrize("first_stays", [True, False])
def test_records_meet_in_two_levels(first_stays):
    from typedframe.llm.exchange import RECORD, meet

    r = np.random.default_rng(5)
    rec = np.zeros(4000, RECORD)
    rec["hi"], rec["chunk"], rec["twice"] = r.integers(0, 900, 4000), np.arange(4000) % 37, r.random(4000) < 0.05
    rec["id"] = np.arange(4000)
    whole, _ = meet(rec, first_stays)
    parts = [meet(rec[rec["chunk"] % 6 == k], first_stays) for k in range(6)]
    last, _ = meet(np.concatenate([on for _, on in parts]), first_stays)
    assert sorted(x["id"] for x in whole) == sorted(x["id"] for x in np.concatenate([g for g, _ in parts] + [last]))


def test_texts_longer_than_a_block_are_whole(spark):
    """Longer than the 1,048,576 characters that are handled at a time."""
    r = random.Random(6)
    long = " ".join(f"v{r.randrange(10**7)}" for _ in range(140_000))
    tail = " ".join(long.split()[-300:])
    assert len(long) > (1 << 20)
    docs = spark.createDataFrame([(1, long), (2, "x " + tail), (3, long + " end")], "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.substring_dedup(docs).collect()}
    assert got == {1: (140_000, 0), 2: (301, 300), 3: (140_001, 140_000)}
    raw = {x.doc_id: x.n_removed for x in suffix_dedup.suffix_dedup(docs).collect()}
    assert raw == {1: len(long), 2: len(tail) + 1, 3: len(long)}
    near = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_dedup(docs).collect()}
    count = lambda t: (lambda w: len(set(zip(*(w[k:] for k in range(5))))))(t.split())
    assert near == {1: (count(long), 1), 2: (count("x " + tail), 2), 3: (count(long + " end"), 1)}
    words = quality.quality_rules(docs.selectExpr("*", "'en' AS lang"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"))
    assert {x.doc_id: x.n_words for x in words.collect()} == {1: 140_000, 2: 301, 3: 140_001}


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, secret_scan.secret_scan, exact_dedup.first_rows])
def test_native_operators_run_no_python(spark, monkeypatch, run):
    """None of the plans that are run on the way, nor that of the result, has a Python node."""
    docs = spark.createDataFrame([(k, f"text {k % 3} password=abcdef{k}", "en", "s") for k in range(20)], "doc_id long, text string, lang string, source string")
    plans, plain = [], io._written
    monkeypatch.setattr(io, "_written", lambda df, path: (plans.append(df._jdf.queryExecution().toString()), plain(df, path))[1])
    out = run(docs)
    plans.append(out._jdf.queryExecution().toString())
    assert out.count() in (3, 20) and len(plans) > 2
    assert not any(word in p for p in plans for word in ("Python", "Pandas", "Arrow"))


def test_settings_come_back_and_folders_go(spark, tmp_path, monkeypatch):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.set(keys[0], "777")
    monkeypatch.setattr(io, "shared_dir", lambda _: f"file://{tmp_path}/{uuid.uuid4().hex}")
    try:
        before = [spark.conf.get(k) for k in keys]
        docs = spark.createDataFrame([(k, f"a b c d e f {k}") for k in range(9)], "doc_id long, text string")
        assert near_dedup.near_dedup(docs).count() == exact_dedup.exact_dedup(docs).count() == 9
        assert [spark.conf.get(k) for k in keys] == before
        assert len(list(tmp_path.iterdir())) == 2  # the results
    finally:
        spark.conf.unset(keys[0])


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_clusters_need_a_shared_folder(master):
    bare = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=bare, sparkContext=SimpleNamespace(master=master, getConf=lambda: bare, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="share"):
        io.shared_dir(session)
