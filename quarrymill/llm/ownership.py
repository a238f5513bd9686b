"""Secret scans by corpus-wide ownership frequency.

Every text is scanned for candidates: three base kinds, which are always reported, and further
kinds with known formats.  Candidate values are hashed and counted over the whole corpus by
distinct repositories and owners.  A value that many owners hold is a copied example; one that few
hold and that looks random is live.  Candidates of the further kinds are reported where they are
live; base ones carry their class beside them.

A hash is combined by (hash, owner, repository) before it is counted, so a value that a third of
the corpus holds is spread over tasks; what comes back to the documents is one row a hash.

Edge cases: null and empty texts have no spans; rows with a null or repeated ``doc_id`` are scanned
each for itself; unknown (null) owners or repositories count as one; candidates that touch others,
of other kinds too, are all kept; offsets are code points, so texts of any length and script count
alike; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed, mapped

#: The base kinds with their patterns, the group that holds the value and its least length.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Further kinds with published formats.
FURTHER = {
    "github": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,})", 0, 40),
    "slack": (r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "google": (r"\bAIza[A-Za-z0-9_-]{35}", 0, 39),
    "stripe": (r"\b[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 40),
    "url": (r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s:/@]{6,128})@", 1, 6),
    "pem": (r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----([A-Za-z0-9+/=\s\\]{64,})-----END", 1, 64),
}
#: Without one of these marks a text holds nothing of the kind; looked up before the pattern runs.
MARKS = {"access": "AKIA", "slack": "xox", "google": "AIza", "stripe": "k_live_", "jwt": ".eyJ", "url": "://", "pem": "PRIVATE KEY-----"}
#: Order in which spans of one start are listed.
KINDS = (*BASE, *FURTHER)
#: A value that more owners hold is a copied example.
MOST_OWNERS = 2
#: Least entropy, in bits a character, of a value that looks random.
LEAST_BITS = 2.5
#: Words of placeholders.
PLACEHOLDER = re.compile(r"example|changeme|placeholder|dummy|sample|your[_-]?|xxxx|1234567|abcdef|test", re.I)

_COMPILED = {
    kind: re.compile({"hex": r"[0-9a-f]{24,}"}.get(kind, pattern), re.ASCII | (re.I if kind == "assign" else 0))  # a run of hex digits is one match
    for kind, (pattern, _, _) in {**BASE, **FURTHER}.items()
}
SPAN = "struct<kind: string, place: int, start: long, end: long, hash: binary, random: boolean>"


def looks_random(value: str) -> bool:
    """Whether a value has the entropy of a generated one and no placeholder's words."""
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return bits >= LEAST_BITS and not PLACEHOLDER.search(value)


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all candidates, by start and then by the order of the kinds."""
    out = []
    for place, kind in enumerate(KINDS):
        if not text or MARKS.get(kind, "") not in text:
            continue
        _, group, least = BASE.get(kind) or FURTHER[kind]
        out += [(m.start(), place, kind, m.end(), m[group]) for m in _COMPILED[kind].finditer(text) if len(m[group]) >= least]
    return [(kind, start, end, value) for start, _, kind, end, value in sorted(out, key=lambda x: x[:2])]


def _found(part: pd.DataFrame) -> pd.DataFrame:
    spans = []
    for text in part.pop("text"):
        text = None if pd.isna(text) else text
        spans.append(
            [
                {"kind": k, "place": KINDS.index(k), "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16], "random": looks_random(v)}
                for k, s, e, v in candidates(text)
            ]
        )
    return part.assign(spans=spans)


def ownership(spans: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """For each ``hash`` of rows (hash, owner, repository): n_repositories, n_owners and ``copied``.

    A repository is one of its owner; equal names under two owners are two repositories.
    """
    held = spans.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners")).withColumn("copied", F.col("n_owners") > most_owners)


def scanned(docs: DataFrame, repository: Column | None = None, owner: Column | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """One row for each document: ``doc_id`` and ``spans``, all candidates by start and kind.

    A span has its kind, start and end, the hash of its value, the numbers of repositories and
    owners that hold the value, its class (``copied``, ``live`` or ``weak``) and whether it is
    ``reported``: base kinds always, others where they are live.
    """
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        (F.col("doc_id") if repository is None else repository).cast("string").alias("repository"),
        (F.col("source") if owner is None else owner).cast("string").alias("owner"),
    )
    found = checkpointed(mapped(read, _found, f"doc_id long, repository string, owner string, spans array<{SPAN}>"))
    found = found.withColumn("id", F.monotonically_increasing_id())
    single = found.filter(F.size("spans") > 0).select("id", "repository", "owner", F.explode("spans").alias("span"))
    counted = ownership(single.select("span.hash", "owner", "repository"), most_owners)
    kind = F.when(F.col("copied"), "copied").when(F.col("span.random"), "live").otherwise("weak")
    judged = single.select("id", "span", F.col("span.hash").alias("hash")).join(counted, "hash").withColumn("class", kind)
    reported = (F.col("span.place") < len(BASE)) | (F.col("class") == "live")
    span = F.struct("span.start", "span.place", "span.kind", "span.end", F.col("hash").alias("hash"), "n_repositories", "n_owners", "class", reported.alias("reported"))
    spans = judged.groupBy("id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return found.select("id", "doc_id").join(spans, "id", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digested(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``scanned`` returns."""
    base = F.filter("spans", lambda s: s["place"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def among(label: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["class"] == label)).cast("long").alias(f"n_{label}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kept = F.filter("spans", lambda s: s["reported"])
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(kept).alias("spans"), *map(among, ("copied", "live", "weak")))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Digests of all documents; a document stands for a repository, its source for the owner."""
    return digested(scanned(docs, F.col("doc_id"), F.col("source")))


def _oracle() -> str:
    """DuckDB: offsets come from the lengths of what lies between the matches of a pattern."""
    either = re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", BASE["assign"][0].split("[", 1)[0])
    patterns = {**BASE, **FURTHER} | {"assign": (either + "[" + BASE["assign"][0].split("[", 1)[1], 2, 6)}
    cut = " UNION ALL ".join(
        f"SELECT id, '{kind}' AS kind, {KINDS.index(kind)} AS place, {least} AS least, string_split_regex(text, {p}) AS s, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v FROM docs"
        for kind, (pattern, group, least) in patterns.items()
        for p in ["'" + pattern.replace("'", "''") + "'"]
    )
    words = PLACEHOLDER.pattern
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
cut AS ({cut}),
placed AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM cut),
spans AS (
  SELECT id, kind, place, v[k] AS v, (length(array_to_string(s[:k], '')) + length(array_to_string(m[:k - 1], '')))::BIGINT AS start, length(m[k])::BIGINT AS n
  FROM placed WHERE length(v[k]) >= least
),
counted AS (SELECT v, count(DISTINCT coalesce(source, '')) AS n_owners FROM spans JOIN docs USING (id) GROUP BY v),
judged AS (
  SELECT id, kind, place, start, kind || ':' || start || ':' || (start + n) AS said,
    CASE WHEN n_owners > {MOST_OWNERS} THEN 'copied' WHEN list_entropy(string_split(v, '')) >= {LEAST_BITS} AND NOT regexp_matches(v, '{words}', 'i') THEN 'live' ELSE 'weak' END AS class
  FROM spans JOIN counted USING (v)
),
summed AS (
  SELECT id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    string_agg(said, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base,
    string_agg(said, ',' ORDER BY start, place) FILTER (place < {len(BASE)} OR class = 'live') AS spans,
    {", ".join(f"count(*) FILTER (class = '{k}') AS n_{k}" for k in ("copied", "live", "weak"))}
  FROM judged GROUP BY id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in (*BASE, "copied", "live", "weak"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN summed USING (id)"""


ORACLE = _oracle()
