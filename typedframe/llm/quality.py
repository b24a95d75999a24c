"""Quality rules by tokeniser fertility: characters a token, byte-fallback share and token entropy, with bands by language or script."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import encoder, groups
from .io import FORGET, map_batches, slices, texts_of
from .words import _SPACE, Numbers, exact_windows

SYMBOLS = "#*$%&|<>"


def _bands(piece: float, byte: float, fallback: float, entropy: float = 3.0, piece_most: float = 6.0, byte_most: float = 6.0) -> dict[str, tuple[float, float]]:
    return {"chars_per_token": (piece, piece_most), "chars_per_byte_token": (byte, byte_most), "fallback_share": (0.0, fallback), "token_entropy": (entropy, 16.0)}


#: Bands (least, most) by language; by script where the language is null or has none; "" for every other script. Entropy is in bits and counts from 50 tokens on.
#: The lower bounds of en, de, fr and es lie about a tenth below the least of clean prose in the language: symbol-laden text falls under them. Those of ru and the scripts
#: were set from article 1 of the UDHR in the languages at hand, mostly three tenths below the least. Symbols lift the piece measure where a script's own tokens are shorter
#: than symbols are: there the upper bound acts.
BANDS: Mapping[str, Mapping[str, tuple[float, float]]] = {
    "en": _bands(1.6, 1.84, 0.3, 4.0), "de": _bands(1.7, 2.02, 0.3, 4.0), "fr": _bands(1.5, 1.66, 0.3, 4.0), "es": _bands(1.6, 1.76, 0.3, 4.0), "ru": _bands(1.5, 2.0, 0.3, 4.0),
    "Latn": _bands(0.8, 1.6, 0.3, 4.0), "Latn-marked": _bands(0.7, 0.8, 0.3, 4.0), "Cyrl": _bands(0.9, 0.8, 0.3),
    "Grek": _bands(0.6, 1.2, 0.2, piece_most=1.0), "Arab": _bands(0.55, 0.86, 0.2, piece_most=1.04), "Hebr": _bands(0.54, 0.67, 0.3, piece_most=1.0),
    "Deva": _bands(0.54, 0.53, 0.25, piece_most=1.0), "Beng": _bands(0.54, 0.3, 0.4, piece_most=0.95), "Taml": _bands(0.6, 0.7, 0.25, piece_most=1.3),
    "Geor": _bands(0.6, 0.25, 0.2, piece_most=1.0), "Armn": _bands(0.56, 0.52, 0.35, piece_most=0.97), "Thai": _bands(0.65, 0.7, 0.2, piece_most=1.5),
    "Hang": _bands(0.5, 0.7, 0.3, piece_most=1.0), "Hani": _bands(0.6, 0.6, 0.4, piece_most=1.5), "Kana": _bands(0.6, 0.7, 0.4, piece_most=1.5),
    "": _bands(0.22, 0.2, 1.0, 2.5, 1.5, 1.5),
}
#: First letter, last letter and script of what has bands of its own; other letters are of script "".
RANGES = (
    (0x41, 0x5A, "Latn"), (0x61, 0x7A, "Latn"), (0xC0, 0x24F, "Latn"), (0x1E00, 0x1EFF, "Latn"), (0x370, 0x3FF, "Grek"), (0x1F00, 0x1FFF, "Grek"), (0x400, 0x52F, "Cyrl"), (0x531, 0x587, "Armn"), (0x5D0, 0x5F2, "Hebr"),
    (0x620, 0x6FF, "Arab"), (0x750, 0x77F, "Arab"), (0xFB50, 0xFDFF, "Arab"), (0x900, 0x97F, "Deva"), (0x980, 0x9FF, "Beng"), (0xB80, 0xBFF, "Taml"), (0xE01, 0xE4E, "Thai"), (0x10A0, 0x10FF, "Geor"), (0x1C90, 0x1CBF, "Geor"),
    (0x1100, 0x11FF, "Hang"), (0xAC00, 0xD7A3, "Hang"), (0x3041, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Hani"), (0x4E00, 0x9FFF, "Hani"), (0x20000, 0x323AF, "Hani"),
)
#: From this share of letters outside ASCII on, Latin text is in marked letters (Vietnamese, Yoruba), which take more tokens.
MARKED = 0.15
#: Frequent words tell the language of untagged text where at least LEAST_COMMON of its words are among them.
COMMON = {
    "en": "the of and to is that with for was are it this be have from by not which or an in as on",
    "de": "der die und das ist nicht ein eine mit sie von den zu für auf dem im des sich auch in",
    "fr": "le les et des est une du dans que pour pas il au qui ne sur plus la de en elle",
    "es": "el los y del una las por con para se que la de en no es su lo al como",
}
LEAST_COMMON = 0.12
#: Letters that among Cyrillic ones are Russian where OTHERS are missing.
RUSSIAN, OTHERS = "ыэ", "іїєґўјљњћђџѓќѕөүұқғңһәӣӯҷҳ"
_ALIASES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru"}
METRICS = ("chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy")


class Words:
    """Token counts of each distinct word seen, found once a worker: under a piece model with byte fallback, and under a byte-level one."""

    def __init__(self, piece_path: str, byte_path: str, most: int = 1 << 18):
        import sentencepiece

        self.model, self.bytes, self.most = sentencepiece.SentencePieceProcessor(model_file=piece_path), encoder(byte_path), most
        self.byte_piece = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.ids, self.count, self.byte_count, self.fallback = (np.zeros(0, np.int32) for _ in range(4))
        self.first = np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, told apart by its bytes; the models see each distinct new word once."""
        if len(self.number) > self.most:
            self.forget()
        known = len(self.number)
        out = self.number.of(words)
        if len(self.number) > known:
            fresh = [w.decode() for w in islice(self.number, known, None)]
            ids = self.model.encode(fresh, num_threads=1)
            count = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(count.sum()))
            fallen = np.concatenate([[0], np.cumsum(self.byte_piece[flat])])
            end = np.cumsum(count)
            self.ids = np.concatenate([self.ids, flat])
            self.count = np.concatenate([self.count, count])
            self.fallback = np.concatenate([self.fallback, (fallen[end] - fallen[end - count]).astype(np.int32)])
            self.byte_count = np.concatenate([self.byte_count, np.diff(self.bytes.encode([" " + w for w in fresh])[1]).astype(np.int32)])
            self.first = np.cumsum(self.count, dtype=np.int64) - self.count
        return out


@cache
def _script_table() -> tuple[list[str], np.ndarray]:
    """Names, and the number of each codepoint's script: 0 for no letter, 1 for a letter of script "", 2 for a Latin letter outside ASCII."""
    names = ["none", "", "Latn-marked", *sorted({s for *_, s in RANGES})]
    table = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), np.uint8, 0x110000)
    for a, b, s in RANGES:
        table[a : b + 1] *= names.index(s if s != "Latn" or a < 128 else "Latn-marked")
    return names, table


def script_of(text: str) -> str:
    """The script of most of the letters; text without letters goes by the bounds of Latin."""
    names, table = _script_table()
    n = np.bincount(table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=len(names))
    latin, marked = names.index("Latn"), n[2]
    n[0], n[latin], n[2] = 0, n[latin] + marked, 0
    best = int(n.argmax()) if n.any() else latin
    return "Latn-marked" if best == latin and marked and marked >= MARKED * n[latin] else names[best]


@cache
def _common() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang, listed in COMMON.items():
        for w in listed.split():
            out.setdefault(w, []).append(lang)
    return out


def band_of(lang: str | None, text: str, bands: Mapping[str, Mapping[str, tuple[float, float]]] = BANDS) -> str:
    """The key of a document's bands: its tag's language whatever case and region, else the language that its common words or letters tell, else its script."""
    tag = re.split("[-_]", (lang or "").strip().lower())[0]
    tag = _ALIASES.get(tag, tag)
    if tag and tag in bands:
        return tag
    script = script_of(text)
    low = text.lower()
    if not tag or tag in ("und", "unknown", "mul", "zxx"):
        found = re.findall(r"[^\W\d_]+", low)
        votes = Counter(x for w in found for x in _common().get(w, ()))
        best, n = max(votes.items(), key=lambda v: (v[1], v[0]), default=("", 0))
        if found and n >= LEAST_COMMON * len(found) and best in bands and script.startswith("Latn"):
            return best
        if script == "Cyrl" and "ru" in bands and sum(map(low.count, RUSSIAN)) > 10 * sum(map(low.count, OTHERS)):
            return "ru"
    return script if script in bands else ""


@cache
def words(piece_path: str, byte_path: str) -> Words:
    out = Words(piece_path, byte_path)
    FORGET.append(out.forget)
    return out


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[begin[1:]] - total[begin[:-1]]


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measure(texts: list[str], known: Words) -> dict[str, np.ndarray]:
    joined = " ".join(texts) + " "
    raw = joined.encode()
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    low = np.minimum(cp, 255)
    space = _SPACE[low] & (cp < 128)
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    begin = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    before = np.searchsorted(starts, begin)
    out = {"n_words": np.diff(before), "word_chars": _sums(~space, begin), "n_symbols": _sums(symbol[low] & (cp < 128), begin), "n_dup_lines": np.array([dup_lines(t) for t in texts], np.int64)}
    doc = np.repeat(np.arange(len(texts)), out["n_words"])
    number = known.numbers(raw.split())  # bytes are split at the same white space as above
    repeated = np.zeros(len(starts), bool)
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    if len(whole):
        three = exact_windows(number, 3)[whole] * len(texts) + doc[whole]
        _, inverse, n = np.unique(three, return_inverse=True, return_counts=True)
        twice = whole[n[inverse] > 1]
        for k in range(3):
            repeated[twice + k] = True
    out["n_repeat_words"] = _sums(repeated, before)
    count = known.count[number].astype(np.int64)
    tokens, fallback, byte_tokens = _sums(count, before), _sums(known.fallback[number], before), _sums(known.byte_count[number], before)
    after = np.cumsum(count)
    entropy = np.zeros(len(texts))
    if len(after):
        ids = known.ids[np.repeat(known.first[number] - (after - count), count) + np.arange(after[-1])]
        key, n = np.unique((np.repeat(doc, count) << 32) | ids, return_counts=True)
        owner = key >> 32
        entropy = -np.bincount(owner, n * np.log2(n / tokens[owner]), len(texts)) / np.maximum(tokens, 1)
    out |= {"n_tokens": tokens, "chars_per_token": out["word_chars"] / np.maximum(tokens, 1), "chars_per_byte_token": out["word_chars"] / np.maximum(byte_tokens, 1), "fallback_share": fallback / np.maximum(tokens, 1), "token_entropy": entropy}
    return out


def judged(texts: list[str], langs: list[str | None], known: Words, bands: Mapping[str, Mapping[str, tuple[float, float]]], chars: int) -> dict[str, np.ndarray]:
    """Counts, measures and verdicts of some texts, about ``chars`` characters at a time."""
    parts = [measure(texts[a:b], known) for a, b in groups(texts, chars)]
    m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    kept = ~failed
    for i in np.flatnonzero(~failed).tolist():
        for k, (least, most) in bands[band_of(langs[i], texts[i], bands)].items():
            if not least <= m[k][i] <= most and (k != "token_entropy" or m["n_tokens"][i] >= 50):
                kept[i] = False
    return m | {"base_failed": failed, "kept": kept}


_COLUMNS = [("doc_id", "long"), *[(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", "boolean"), ("kept", "boolean"), ("n_tokens", "long"), *[(c, "double") for c in METRICS]]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def quality_rules(docs: DataFrame, piece_path: str, byte_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: Mapping[str, Mapping[str, tuple[float, float]]] = BANDS, chars: int = 1 << 19) -> DataFrame:
    """Base counts, base_failed, kept and the method's measures, a row for each input row.

    Words are encoded one by one with a blank before them, each distinct word once a worker: characters a token under both vocabularies, the share
    of byte pieces and the entropy of the token counts. A document that passes the base rules is kept if every measure lies in its language's or script's band.

    A null or empty text has no words and fails the base rules. A text longer than ``chars`` is measured alone and whole. A tag's case and region don't count. A null language is told by
    common words or letters, or else has the bands of the text's dominant script, as a language without bands does. Null ids and repeated rows pass
    through; an empty table gives an empty result; other columns are ignored. No shuffle.
    """

    def rows(batch: pa.RecordBatch) -> list:
        m = judged(texts_of(batch, "text"), batch.column("lang").to_pylist(), words(piece_path, byte_path), bands, chars)
        return [batch.column("doc_id"), *[m[c] for c, _ in _COLUMNS[1:]]]

    picked = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text", f"cast(`{lang_col}` AS string) AS lang")
    return map_batches(picked, rows, ", ".join(f"{c} {t}" for c, t in _COLUMNS), pa.schema([(c, _ARROW[t]) for c, t in _COLUMNS]))


def kept_rows(docs: DataFrame, piece_path: str, byte_path: str, text_col: str = "text", lang_col: str = "lang", bands: Mapping[str, Mapping[str, tuple[float, float]]] = BANDS, chars: int = 1 << 19) -> DataFrame:
    """The rows that the rules keep, each judged where it is: no join, no shuffle, ids don't matter. Nulls and empty texts as in ``quality_rules``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = judged(texts_of(batch, text_col), [None if x is None else str(x) for x in batch.column(lang_col).to_pylist()], words(piece_path, byte_path), bands, chars)
            yield batch.filter(pa.array(m["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
