"""Secret scan with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .io import Scratch

_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: Kind, pattern, group that holds the secret, least length of that group. The order is that of ties.
BASE = (
    ("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Shapes of issued credentials; what matches is added where one owner has it.
ISSUED = (
    "issued",
    r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    0,
    1,
)
KINDS = (*BASE, ISSUED)
#: What every match of a kind contains, and whether the text is searched in lower case. Hexadecimal runs have no cue.
CUES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    "access": (("AKIA",), False),
    "issued": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza", "eyJ"), False),
}


def _may_hold(text: Column, kind: str, pattern: str) -> Column:
    """Cheap plain searches first, so that most texts never meet a pattern."""
    if kind in CUES:
        cues, fold = CUES[kind]
        where = F.lower(text) if fold else text
        return reduce(lambda a, b: a | b, [F.contains(where, F.lit(c)) for c in cues]) & F.regexp_like(text, F.lit(pattern))
    return F.regexp_like(text, F.lit(pattern))


def _found(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches as array<struct<start, kind, end, secret>>; places come from the lengths of what lies between them."""
    rx = F.lit(pattern)
    empty = F.expr("cast(array() AS array<struct<start:int,kind:int,end:int,secret:bigint>>)")
    parts = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(group)))

    def step(acc: Column, part: Column) -> Column:
        gap, hit, secret = part["0"], part["1"], part["2"]
        start = acc["pos"] + F.length(gap)
        end = start + F.length(hit)
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.xxhash64(secret).alias("secret")))
        return F.struct(F.coalesce(end, start).alias("pos"), F.when(F.length(secret) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    walk = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(_may_hold(text, kind, pattern), walk).otherwise(empty)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counts(verdicts: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(verdicts), lambda v: F.concat_ws(":", F.get(names, v["kind"]), *[v[c].cast("string") for c in ("start", "n_owners", "n_repos")])), ",")


def spans_of(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None) -> DataFrame:
    """Columns doc_id, th (hash of the text), owner, repo, spans: the only step that reads texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit("\x00")
    repo = F.coalesce(F.col(repo_col).cast("string"), none) if repo_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), none).alias("owner"), repo.alias("repo"), text.alias("t"))
    spans = F.concat(*[_found(F.col("t"), i, *kind) for i, kind in enumerate(KINDS)])
    return rows.select("doc_id", F.xxhash64("t").alias("th"), "owner", "repo", spans.alias("spans"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang", max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, owners; a row for each input row.

    Texts are scanned once, into a table of spans. Candidates are hashed by the secret's value alone, whatever their kind, and for each hash the distinct owners and
    repositories (owner and ``repo_col``) of the whole corpus are counted: first distinct triples, partially aggregated, then counts. A candidate of at most
    ``max_owners`` owners and at most ``max_repos`` repositories is live-looking, else a widely copied example: one owner that has it in many
    repositories copies an example too. ``owners`` lists kind:start:n_owners:n_repos of each candidate. Base spans always stay; an issued-credential
    shape is added as a span where it is live-looking.

    A null text is empty and has no spans; a text of any length is scanned whole, by one regular expression at a time. A null owner or repository counts as one of its own. Rows that repeat an id
    and its text get equal results. Null ids are allowed. An empty table gives an empty result; other columns are ignored.
    """
    store = Scratch(docs.sparkSession)
    found = store.keep(spans_of(docs, id_col, text_col, owner_col, repo_col))
    cands = found.where(F.size("spans") > 0).select("doc_id", "th", "owner", "repo", F.explode("spans").alias("s"))
    cands = cands.select("doc_id", "th", "owner", "repo", "s", F.col("s.secret").alias("secret"))
    owners = cands.select("secret", "owner", "repo").distinct().groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("secret").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    verdicts = (
        cands.join(owners, "secret").groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), live.alias("live"), "n_owners", "n_repos")).alias("verdicts"))
        .select(F.col("doc_id").alias("v_id"), F.col("th").alias("v_th"), "verdicts")
    )
    out = found.join(verdicts, found["doc_id"].eqNullSafe(F.col("v_id")) & (found["th"] == F.col("v_th")), "left")
    verdicts = F.coalesce("verdicts", F.expr("cast(array() AS array<struct<start:int,kind:int,live:boolean,n_owners:bigint,n_repos:bigint>>)"))
    live = F.filter(verdicts, lambda v: v["live"])
    keys = F.transform(live, lambda v: F.struct(v["start"], v["kind"]))
    n = len(BASE)

    def of_kind(i: int):
        return lambda s: s["kind"] == i

    base = F.array_sort(F.filter("spans", lambda s: s["kind"] < n))
    every = F.array_sort(F.filter("spans", lambda s: (s["kind"] < n) | F.array_contains(keys, F.struct(s["start"], s["kind"]))))
    count = [F.size(F.filter("spans", of_kind(i))).cast("long").alias(f"n_{k[0]}") for i, k in enumerate(BASE)]
    return store.finish(out.select(
        "doc_id", *count, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.size(live).cast("long").alias("n_live"), (F.size("spans") - F.size(live)).cast("long").alias("n_copied"), _counts(verdicts).alias("owners"),
    ))


def _sql() -> str:
    """The same result in one statement: spans from the lengths of gaps and matches, owners by grouping."""
    quoted = [(name, "'" + p.replace("'", "''") + "'", g, least) for name, p, g, least in KINDS]
    found = " UNION ALL ".join(
        f"SELECT r, {i} AS kind, '{name}' AS name, {least} AS least, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {g}) AS secrets FROM d WHERE regexp_matches(t, {p})"
        for i, (name, p, g, least) in enumerate(quoted)
    )
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k[0]}" for i, k in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner, coalesce(lang, chr(1)) AS repo FROM documents),
m AS ({found}),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM m),
p AS (SELECT r, kind, name, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
             length(hits[k]) AS n, secrets[k] AS secret FROM i WHERE length(secrets[k]) >= least),
o AS (SELECT secret, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repos FROM p JOIN d USING (r) GROUP BY secret),
v AS (SELECT p.*, s + n AS e, n_owners, n_repos, n_owners <= 1 AND n_repos <= 2 AS live FROM p JOIN o USING (secret)),
a AS (SELECT r, {counts}, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)}) AS base,
             string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)} OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
             string_agg(name || ':' || s || ':' || n_owners || ':' || n_repos, ',' ORDER BY s, kind) AS owners FROM v GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(owners, '') AS owners
FROM d LEFT JOIN a USING (r)
"""


SQL = _sql()
