"""Each operator against brute force, on planted and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import types as T

from typedframe.llm import bpe, exact_dedup, near_dedup, packing, pii, quality, queries, secret_scan, substring_dedup, suffix_dedup, warc

#: Extra columns whose names clash with those of results.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("spans", T.StringType())])


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(("lorem", "Ipsum", "dolor", "sit", "amet,", "été", "straße", "x", "consectetur", "adipiscing")) + str(r.randint(0, 60)) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    base, shared = prose(r, 200), prose(r, 60)
    rows: list[tuple[int | None, str | None]] = [(10, None), (11, ""), (12, " \t\n"), (13, "one two"), (14, "One  TWO"), (15, base), (16, base), (17, base.replace("lorem", "LOREM", 1)), (18, base.replace(" ", "  ", 3)), (None, base), (20, prose(r, 9000))]
    rows += [(21 + k, " ".join([w if r.random() > 0.01 else "changed" for w in base.split()])) for k in range(12)]
    rows += [(40 + k, f"{prose(r, 30)}\n{shared}\n{prose(r, 30)}") for k in range(8)]
    rows += [(60, "ab" * 400), (61, "z" * 500), (62, "\U0001f642 " * 120), (63, "word " * 300), (63, "word " * 300), (64, "line one\nline one\nline one\n#*$%&|<>")]
    secrets = ["password = 'hunter22'", "token:abc", "AKIA" + "A1" * 8, "AKIAAKIA", "deadbeef" * 4, "API_KEY=\"zzzzzz\"", "ghp_" + "a1B2" * 10, "secret=token:abcdefgh", "x@y.co, a@b@c.de", "1.2.3.4.5", "999.1.1.1", "+1 (555) 010-9999", "4111 1111 1111 1111", "http://me:pw@h.org/", "IBAN GB82 WEST 1234 5698 7654 32", "SSN: 078-05-1120"]
    rows += [(100 + k, f"é{s} {prose(r, 3)} {s}") for k, s in enumerate(secrets)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, [None, "en", "de", "xx"][k % 4], [None, "s1", "s2"][k % 3], "no", k, "clash") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want: list[tuple], columns: str) -> None:
    got = [tuple(r) for r in df.select(*columns.split()).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("hot", [128, 1])
def test_suffix_dedup(docs, rows, empty, hot):
    raws, n = [(i, (t or "").encode()) for i, t in rows], 200
    seen = collections.Counter(b[k : k + n] for _, b in raws for k in range(len(b) - n + 1))
    want = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    same(suffix_dedup.suffix_dedup(docs, chunk_bytes=20_000, hot_chunks=hot), want, "doc_id n_bytes n_removed n_spans kept_sha256")
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_loser_tree_keeps_order_and_prefixes():
    r = random.Random(2)
    for _ in range(60):
        runs = [sorted({bytes(r.choice(b"ab") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 12))}) for _ in range(r.randint(1, 6))]
        coded = [suffix_dedup.read_run(suffix_dedup.write_run([(s, b"", [(0, 0)]) for s in run])) for run in runs]
        out = [(shared, e[1]) for shared, _, e in suffix_dedup.LoserTree(coded)]
        assert [s for _, s in out] == sorted(s for run in runs for s in run)
        assert all(shared == suffix_dedup.common(a, b) for (_, a), (shared, b) in zip(out, out[1:]))


@pytest.mark.parametrize("hot", [128, 1])
def test_substring_dedup(docs, rows, empty, hot):
    n, seen, want = 20, set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - n + 1):
            if (key := tuple(w[k : k + n])) in seen:
                gone[k : k + n] = True
            seen.add(key)
        want.append((i, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    same(substring_dedup.substring_dedup(docs, chunk_bytes=20_000, hot_chunks=hot), want, "doc_id n_words n_removed kept_sha256")
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_fm_index_counts():
    r = np.random.default_rng(3)
    text = np.append(r.integers(1, 6, 400), 0)
    index = substring_dedup.FMIndex(text, 8)
    assert index.tree.bits() < 3 * 2 * len(text)
    for k in range(300):
        pattern = text[k : k + 6]
        low, high = index.first[pattern[-1:]], index.first[pattern[-1:] + 1]
        for c in pattern[-2::-1]:
            low, high = index.step(np.array([c]), low, high)
        assert high[0] - low[0] == sum((text[j : j + 6] == pattern).all() for j in range(len(text) - 5))


def test_bpe(docs, rows, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = []
    for i, t in rows:
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())))
    same(bpe.bpe_round_trip(docs, path), want, "doc_id n_tokens ids_sha256 decoded_sha256")
    assert bpe.bpe_round_trip(empty, path).count() == 0
    r = random.Random(1)
    texts = ["".join(r.choice("abst'  \n\t.!1é中٣'srevld 　🙂x") for _ in range(r.randint(0, 300))) for _ in range(800)] + ["a" * 5000, "　 x", "'ll've're"]
    ids, at = bpe.encoder(path).encode(texts)
    assert [ids[p:q].tolist() for p, q in zip(at, at[1:])] == [ref.encode_ordinary(t) for t in texts]


def test_bpe_survives_hash_collisions(monkeypatch):
    e = bpe.Encoder(P.path("byte_bpe_50k.tiktoken"))
    texts = ["hello world, goodbye moon", "aa bb cc"]
    want = e.encode(texts)[0].tolist()
    e.forget()
    monkeypatch.setattr(bpe, "slice_hashes", lambda v, s, t: np.zeros(len(s), np.uint64))
    assert e.encode(texts)[0].tolist() == want


def test_warc(spark, empty):
    big = "<html>" + "x" * 200
    schema = "page_id long, url string, html string, digest string, refers long"
    data = [(3, "http://a/é\r\nX: y", big), (1, None, big), (2, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (8, "u", "é" * 100), (9, "v", "é" * 100), (9, "v", "é" * 100)]
    pages = spark.createDataFrame([(*p, "clash", 7) for p in data], schema)
    want = []
    first: dict = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in data:
        b = (h or "").encode()
        again = len(b) >= 100 and i != first[h or ""]
        want.append((i, len(b), sha(b), "revisit" if again else "response", first[h or ""] if again else None))
    same(warc.warc_round_trip(pages), want, "page_id payload_bytes payload_digest record_type refers_to")
    assert warc.warc_round_trip(spark.createDataFrame([], schema)).count() == 0
    records = [f"record {k} {'abc' * (k % 50)}".encode() * 9 for k in range(400)]
    archive = warc.pack(records)
    assert archive[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(archive[4:8], "little") > 0 and list(warc.unpack(archive)) == records


def brute_near(rows, percent=85, n=5):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if None not in (a, b) and a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(docs, rows, empty, spark, percent):
    want = brute_near(rows, percent)
    same(near_dedup.near_dedup(docs, percent=percent), [(i, *want[i], i == want[i][1]) for i, _ in rows], "doc_id n_shingles component_id kept")
    assert near_dedup.near_dedup(empty).count() == 0
    r = random.Random(9)  # a group whose members are mostly too far apart
    base = prose(r, 120).split()
    more = [(k, " ".join(w if r.random() > 0.012 else f"new{r.random()}" for w in base)) for k in range(60)]
    want = brute_near(more, percent)
    same(near_dedup.near_dedup(spark.createDataFrame(more, "doc_id long, text string"), percent=percent), [(i, *want[i], i == want[i][1]) for i, _ in more], "doc_id n_shingles component_id kept")


@pytest.mark.parametrize("percent", [50, 79, 101])
def test_near_dedup_refuses_thresholds_that_its_bands_miss(docs, percent):
    with pytest.raises(ValueError, match="percent"):
        near_dedup.near_dedup(docs, percent=percent)


def test_odd_sketches_estimate():
    r = np.random.default_rng(1)
    a = np.unique(bpe.slice_hashes(np.arange(4000, dtype=np.uint32), np.arange(3999), np.arange(1, 4000)))
    for share in (0.95, 0.85):
        b = a.copy()
        b[: int(len(a) * (1 - share) / (1 + share))] = r.integers(0, 1 << 63, int(len(a) * (1 - share) / (1 + share)), dtype=np.uint64)
        x, y = (near_dedup.odd_sketches(near_dedup.minhashes(np.sort(s), np.array([0]), near_dedup.BANDS * near_dedup.ROWS))[0] for s in (a, b))
        differ = int(np.bitwise_count(x ^ y).sum())
        assert near_dedup.least_agreeing(min(1, share + 0.12)) <= differ <= near_dedup.least_agreeing(share - 0.12)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path, tok = P.path("byte_bpe_50k.tiktoken"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = packing.pack(docs, path, capacity=64).collect()
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in out:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, texts in ids.items():
        want = collections.Counter()
        for x in texts:
            cut = [0, *range((len(x) - 1) % 64 + 1, len(x) + 1, 64)]
            want.update((k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:])))
        assert collections.Counter((p.piece, p.start, p.length, p.ids_crc32) for p in by_doc[i]) == want
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    total = sum(p.length for p in out)
    assert len(by_seq) <= 1.03 * total / 64 + 1
    assert packing.pack(empty, path).count() == 0


def test_packing_takes_special_strings_as_text(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y \u3000 it's IT'S 12345"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)]
    got = packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), with_ids=True).select("doc_id", "ids").collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == want


def test_packing_query_follows_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y \u3000 it's IT'S 12345", "a  <|endoftext|>  b <|endoftext", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)]
    special = packing.special_tokens(P.path("byte_bpe_50k.json"))
    got = packing.pack(docs, P.path("byte_bpe_50k.tiktoken"), with_ids=True, special=special).select("doc_id", "ids").collect()
    assert special == {"<|endoftext|>": 50256} and sorted((r.doc_id, bytes(r.ids)) for r in got) == want


def test_packing_keeps_large_ids_beside_null_ones(spark):
    docs = spark.createDataFrame([(None, "a b"), (2**53 + 1, "c"), (2**62 + 3, None)], "doc_id long, text string")
    out = packing.pack(docs, P.path("byte_bpe_50k.tiktoken")).collect()
    assert {r.doc_id for r in out} == {None, 2**53 + 1, 2**62 + 3}
    assert len({r.sequence_id for r in out}) == 1


def test_sum_of_squares_rule():
    r = np.random.default_rng(4)
    lengths = r.integers(1, 17, 300)
    bins, places = packing.sum_of_squares(lengths, 16)
    open_gap: dict[int, int] = {}
    for s, b, at in zip(lengths.tolist(), bins.tolist(), places.tolist()):
        count = collections.Counter(g for g in open_gap.values() if g)
        cost = lambda g: sum(v * v for v in (count - collections.Counter([g]) * (g < 16) + collections.Counter([g - s] * (g > s))).values())
        assert open_gap.get(b, 16) == 16 - at
        options = [g for g in {*count, 16} if g >= s]
        best = min(_cost(count, g, s) for g in options)
        assert _cost(count, open_gap.get(b, 16), s) == best
        open_gap[b] = 16 - at - s


def _cost(count, g, s):
    c = collections.Counter(count)
    if g < 16:
        c[g] -= 1
    if g > s:
        c[g - s] += 1
    return sum(v * v for v in c.values())


def test_quality(docs, rows, empty):
    args = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")
    want = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(three)
        hit = {k + d for k, x in enumerate(three) if n[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    out = quality.quality_rules(docs, *args)
    same(out, want, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed")
    assert out.where("base_failed AND kept").count() == 0
    assert quality.quality_rules(empty, *args).count() == 0


def test_quality_measures_match_the_model():
    import sentencepiece

    text = "Le café naïf 中文字 mangé par " + "hello world again " * 20
    known = quality.words(P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"))
    m = quality.measure([text, ""], known)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ids = [i for w in text.split() for i in sp.encode(w)]
    p = np.array(list(collections.Counter(ids).values())) / len(ids)
    assert m["n_tokens"].tolist() == [len(ids), 0]
    assert m["token_entropy"][0] == pytest.approx(-(p * np.log2(p)).sum())
    assert m["fallback_share"][0] == pytest.approx(sum(map(sp.is_byte, ids)) / len(ids))


#: Clean prose in several scripts (UDHR article 1), none of it of a language with a tag's bands but the first.
CLEAN = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "sr": "Сва људска бића рађају се слободна и једнака у достојанству и правима. Она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "ka": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით.",
    "am": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል።",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
}


def test_quality_bands_by_script_and_tag(spark):
    r = random.Random(3)
    kept = [(f"{lang} {tag}", " ".join(w for _ in range(4) for w in r.sample(t.split(), len(t.split()))), tag) for lang, t in CLEAN.items() for tag in (None, "xx", lang, f"{lang.upper()}_{lang.upper()}")]
    junk = [(d.text, d.lang) for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(r"text RLIKE '([#$%&*]{3} .*){20}'").collect()]
    tags = {"tagged": lambda t: t, "untagged": lambda t: None, "region": lambda t: f"{t}-{t.upper()}", "upper": str.upper}
    gone = [(f"{k} {n}", t, f(lang)) for n, (t, lang) in enumerate(junk) for k, f in tags.items()]
    df = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(kept + gone)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality.quality_rules(df, P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")).collect()}
    assert [name for k, (name, _, _) in enumerate(kept) if not got[k].kept] == []
    passing = [k for k in range(len(kept), len(got)) if not got[k].base_failed]
    assert len(passing) > 40 and [gone[k - len(kept)][0] for k in passing if got[k].kept] == []


def test_quality_each_band_acts_on_planted_junk():
    r = random.Random(2)
    shuffled = lambda t: " ".join(r.choice(t.split()) for _ in range(80))
    junk = {
        "random bytes": (" ".join(r.randbytes(8).decode("latin-1") for _ in range(80)), {"chars_per_token", "chars_per_byte_token"}),
        "random letters": (" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(12)) for _ in range(80)), {"chars_per_token", "chars_per_byte_token"}),
        "repeated tokens": (shuffled("people house water little other where about great"), {"token_entropy"}),
        "Greek tagged en": (shuffled(CLEAN["el"]), {"chars_per_token", "chars_per_byte_token"}),
        "Amharic tagged en": (shuffled(CLEAN["am"]), {"chars_per_token", "chars_per_byte_token", "fallback_share"}),
    }
    m = quality.measure([t for t, _ in junk.values()], quality.words(P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")))
    for k, (name, (_, want)) in enumerate(junk.items()):
        assert not (m["n_words"][k] < 50 or 100 * m["n_repeat_words"][k] > 50 * m["n_words"][k]), name
        assert want <= {c for c, (a, b) in quality.BANDS["en"].items() if not a <= m[c][k] <= b}, name


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    low = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    want = [(i, low[norm(t)], len(groups[norm(t)]), i == low[norm(t)], sha(norm(t).encode())) for i, t in rows]
    same(exact_dedup.exact_dedup(docs), want, "doc_id keep_id group_size kept text_sha256")
    from pyspark.sql import functions as F

    same(exact_dedup.exact_dedup(docs, hashed_by=lambda c: F.lit("00")), want, "doc_id keep_id group_size kept text_sha256")
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_pii(docs, rows, empty):
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    fine = {"email": lambda s: True, "ip": lambda s: all(int(p) < 256 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}

    def brute(t):
        return [(k, *m.span()) for k in rx for m in re.finditer(rx[k], t) if fine[k](m[0])]

    want = []
    for i, t in rows:
        b = brute(t or "")
        want.append((i, *(sum(s[0] == k for s in b) for k in rx), sha(",".join(f"{k}:{x}:{y}" for k, x, y in b).encode())))
    out = pii.pii_spans(docs)
    same(out, want, "doc_id n_email n_ip n_card n_phone base_sha256")
    assert {k for r in out.collect() for k in re.findall("[a-z]+", r.spans)} >= set(pii.KINDS)
    assert pii.pii_spans(empty).count() == 0
    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice("a@.1234567890+ -()b") for _ in range(r.randint(0, 80)))
        assert [s for s in pii.find(t) if s[0] in pii.BASE] == brute(t)
    assert pii.redact("mail a@b.co or +1 555 0100 100!") == "mail <email> or <phone>!"


def test_secrets(docs, rows, empty, spark):
    rx = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), "access": ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": ("[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    want = []
    for i, t in rows:
        b = sorted((m.start(), n, m.end(), k) for n, (k, (p, ok)) in enumerate(rx.items()) for m in re.finditer(p, t or "") if ok(m))
        want.append((i, *(sum(s[3] == k for s in b) for k in rx), sha(",".join(f"{k}:{x}:{y}" for x, _, y, k in b).encode())))
    out = secret_scan.secret_scan(docs)
    same(out, want, "doc_id n_assign n_access n_hex base_sha256")
    assert secret_scan.secret_scan(empty).count() == 0
    key = "ghp_" + "a1B2" * 9
    shared = spark.createDataFrame([(k, f"x {key}9 y" if k < 2 else f"{key}{k}", "en", f"s{k}") for k in range(4)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.spans, r.n_live, r.n_copied) for r in secret_scan.secret_scan(shared).collect()}
    assert got == {0: ("", 0, 1), 1: ("", 0, 1), 2: ("issued:0:41", 1, 0), 3: ("issued:0:41", 1, 0)}
    plan = secret_scan.secret_scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_secrets_count_a_value_once_whatever_its_kind(spark):
    value = "deadbeef" * 4
    texts = [(0, f"password={value}", "s0", "r0"), (1, f"x {value}", "s1", "r0"), (2, f"x {value}", "s1", "r1"), (3, "token=only-here", "s0", "r0"), (4, "token=only-here", "s0", "r1"), (5, "none", "s0", "r0")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: (r.n_live, r.n_copied, r.owners) for r in secret_scan.secret_scan(df).collect()}
    assert got == {0: (0, 2, "assign:0:2:3,hex:9:2:3"), 1: (0, 1, "hex:2:2:3"), 2: (0, 1, "hex:2:2:3"), 3: (1, 0, "assign:0:1:2"), 4: (1, 0, "assign:0:1:2"), 5: (0, 0, "")}


def test_secrets_of_one_owner_in_many_repositories_are_examples(spark):
    texts = [(k, "password=copied-around", "s0", f"r{k}") for k in range(5)] + [(9, "password=only-here", "s0", "r0")]
    got = {r.doc_id: (r.n_live, r.owners) for r in secret_scan.secret_scan(spark.createDataFrame(texts, "doc_id long, text string, source string, lang string")).collect()}
    assert got == {k: (0, "assign:0:1:5") for k in range(5)} | {9: (1, "assign:0:1:1")}


def test_secrets_added_spans_against_brute_force(docs, rows):
    issued = re.compile(secret_scan.ISSUED[1])
    owner = lambda k: [None, "s1", "s2"][k % 3]
    lang = lambda k: [None, "en", "de", "xx"][k % 4]
    rx = [(n, re.compile(p), g, least) for n, p, g, least in secret_scan.KINDS]
    found = [[(m.start(), i, m.end(), m[g]) for i, (_, p, g, least) in enumerate(rx) for m in p.finditer(t or "") if len(m[g]) >= least] for _, t in rows]
    owners, repos = collections.defaultdict(set), collections.defaultdict(set)
    for k, spans in enumerate(found):
        for *_, secret in spans:
            owners[secret].add(owner(k))
            repos[secret].add((owner(k), lang(k)))
    want = []
    for (i, _), spans in zip(rows, found):
        live = [s for s in spans if len(owners[s[3]]) <= 1 and len(repos[s[3]]) <= 2]
        shown = sorted(s for s in spans if s[1] < 3 or s in live)
        want.append((i, ",".join(f"{rx[k][0]}:{a}:{b}" for a, k, b, _ in shown), len(live), len(spans) - len(live)))
    assert any(issued.search(t or "") for _, t in rows)
    same(secret_scan.secret_scan(docs), want, "doc_id spans n_live n_copied")


def test_queries_are_named_and_run(spark):
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()] == list(range(1, 11))
    for name in ("op3_warc", "op5_packing", "op10_secrets"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
