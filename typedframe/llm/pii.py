"""Personal data by anchor expansion: Aho-Corasick finds cues, local parsers expand and validate around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .io import map_batches, slices, texts_of

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds, after the base kinds.
ADDED = ("userinfo", "iban", "ssn")
KINDS = BASE + ADDED

#: Local parsers, applied at an anchor only.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(r"://[^\s/@:]+:[^\s/@]+@")
_IBAN = re.compile(r"[:#\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_SSN = re.compile(r"[:#\x20]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(x - 9 * (x > 9) for x in (2 * int(c) for c in digits[-2::-2]))
    return total % 10 == 0


def iban_ok(raw: str) -> bool:
    s = raw.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue in ("@", "+", "://", "IBAN", "SSN", *"0123456789"):
        a.add_word(cue, cue)
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []


def _fits(part: str) -> bool:
    """At most 255, without turning thousands of digits into a number."""
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, end exclusive, by kind as in KINDS, then start.

    Base kinds are the leftmost non-overlapping matches of their patterns; a match that fails validation is dropped and its text is not tried
    again. Work is linear in the text: each parser starts behind the end of its last match, and leftward expansion stops there.
    """
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    out: dict[str, list] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    digit = -2
    for last, cue in _AUTOMATON[0].iter(text):
        if cue == "@":
            start = last
            while start > done["email"] and _LOCAL.match(text, start - 1):
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last)):
                out["email"].append(("email", start, m.end()))
                done["email"] = m.end()
            else:
                done["email"] = last  # "@" is no local character: no later expansion passes it
        elif cue == "+":
            if last >= done["phone"] and (m := _PHONE.match(text, last)):
                done["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out["phone"].append(("phone", last, m.end()))
        elif cue == "://":
            if m := _USERINFO.match(text, last - 2):
                out["userinfo"].append(("userinfo", last + 1, m.end() - 1))
        elif cue == "IBAN" or cue == "SSN":
            kind, rx = ("iban", _IBAN) if cue == "IBAN" else ("ssn", _SSN)
            if (m := rx.match(text, last + 1)) and m.start(1) >= done[kind] and (kind == "ssn" or iban_ok(m[1])):
                out[kind].append((kind, *m.span(1)))
                done[kind] = m.end(1)
        else:
            first, digit = last != digit + 1, last
            if not first:
                continue
            if last >= done["ip"] and (m := _IP.match(text, last)):
                done["ip"] = m.end()
                if all(map(_fits, m[0].split("."))):
                    out["ip"].append(("ip", last, m.end()))
            if last >= done["card"] and (m := _CARD.match(text, last)):
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(("card", last, m.end()))
    return [s for k in KINDS for s in out[k]]


def redact(text: str) -> str:
    """Each span, overlapping ones as one, replaced by the kind that begins first in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(find(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Columns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and redacted), a row for each input row.

    A null text is empty and has no spans (redacted stays empty); a very long one is scanned whole, in linear time; null ids and repeated rows pass through; an empty
    table gives an empty result; other columns are ignored. No shuffle.
    """
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def rows(batch: pa.RecordBatch) -> list:
        texts = texts_of(batch, "text")
        found = [find(t) for t in texts]
        base = [[s for s in x if s[0] in BASE] for x in found]
        counts = [[sum(s[0] == k for s in x) for x in base] for k in BASE]
        cols = [batch.column("doc_id"), *counts, [hashlib.sha256(join(x).encode()).hexdigest() for x in base], [join(x) for x in found]]
        return [*cols, [redact(t) for t in texts]] if with_text else cols

    fields = [("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string())] + [("redacted", pa.string())] * with_text
    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * with_text
    return map_batches(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), rows, ddl, pa.schema(fields))


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with their personal data replaced by kinds, and ``length_col`` set to the new length in code points. A null text stays null."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if t is None else redact(t) for t in batch.column(text_col).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType))) if length_col else out


def _sql() -> str:
    """The same result in one statement. Places come from the lengths of gaps and matches; where a parser looks behind a match, that character is matched, too, and taken off."""
    blank = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) ELSE 2 * CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) - CASE WHEN substr({digits}, length({digits}) - i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
    own = "replace(body, ' ', '')"
    order = f"string_split(substr({own}, 5) || substr({own}, 1, 4), '')"
    mod97 = f"list_reduce(list_concat([0], list_transform({order}, lambda x: CASE WHEN x <= '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)), lambda a, v: (CASE WHEN v < 10 THEN a * 10 + v ELSE a * 100 + v END) % 97) = 1"
    # kind, pattern, group of the span, length of what the match has before that, test
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "0", "TRUE"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "0", "list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) <= 255))"),
        ("card", r"[0-9]([\x20-]?[0-9])+", 0, "0", f"length({digits}) BETWEEN 16 AND 19 AND {luhn}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, "0", f"length({digits}) BETWEEN 8 AND 15"),
        ("userinfo", f"://([^{blank}/@:]+:[^{blank}/@]+)@", 1, "3", "TRUE"),
        ("iban", r"IBAN[:#\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?:[^A-Za-z0-9]|$)", 1, r"length(regexp_extract(hit, '^IBAN[:#\x20]{0,3}'))", f"length({own}) BETWEEN 15 AND 34 AND {mod97}"),
        ("ssn", r"SSN[:#\x20]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?:[^0-9-]|$)", 1, r"length(regexp_extract(hit, '^SSN[:#\x20]{0,3}'))", "TRUE"),
    )
    found = " UNION ALL ".join(
        f"SELECT r, {i} AS kind, '{kind}' AS name, pos + {skip} AS s, pos + {skip} + length(body) AS e FROM (SELECT r, hits[k] AS hit, bodies[k] AS body, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS pos "
        f"FROM (SELECT r, string_split_regex(t, '{rx}') AS gaps, regexp_extract_all(t, '{rx}', 0) AS hits, regexp_extract_all(t, '{rx}', {group}) AS bodies, unnest(range(1, len(regexp_extract_all(t, '{rx}', 0)) + 1)) AS k FROM d WHERE regexp_matches(t, '{rx}'))) WHERE {test}"
        for i, (kind, rx, group, skip, test) in enumerate(kinds)
    )
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), p AS ({found}),
a AS (SELECT r, {counts}, string_agg(name || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (kind < {len(BASE)}) AS base, string_agg(name || ':' || s || ':' || e, ',' ORDER BY kind, s) AS spans FROM p GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""


SQL = _sql()
