"""Secret scans by corpus-wide ownership frequency.

Candidates are values of any length assigned to a credential's name, quoted or bare, and values of
known token forms. A bare value ends at white space, the text's end or a mark such as a comma.
Each is hashed, and its hash counted over the whole corpus by documents, distinct repositories
and distinct owners (a repository ``owner/name`` belongs to ``owner``; without a slash it is
its own owner). A value that many owners hold is an example that was copied; one that looks
random and belongs to a single owner, in however many repositories, is a live-looking credential.

Verdicts: ``placeholder`` (few distinct characters, no digit, or a word such as example),
else ``owner_specific`` (one owner), ``copied_example`` (``spread`` owners or more),
``shared`` (the rest).

Defined cases: a null or empty text has no candidates; a null source is one unnamed
repository; a null id is a document of its own in each repository; repeated rows add to
n_occurrences and are one document; very long texts and values are read whole, ties in counts
change nothing; no rows in give no rows out; other columns are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import checkpointed, fresh

_NAMED = r"""(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth)["']?\s*[:=]"""
ASSIGNED = _NAMED + r"""\s*["']([A-Za-z0-9+/=_.-]{16,})["']"""
BARE = _NAMED + r"""[ \t]*([A-Za-z0-9+/_.-][A-Za-z0-9+/=_.-]{14,}[A-Za-z0-9+/=_-])(?=\.?(?:[\s,;)}\]&<#]|$))"""
FORMS = r"(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35})"
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|your|dummy|xxxx|0000|12345"
VARIETY, SPREAD = 8, 3
MASK = "[SECRET]"
# every match holds one of these; looking for them first spares most texts the patterns
_NAMES = ("token", "secret", "passw", "key", "auth")
_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza")
_NONE = "array<struct<kind:string,value:string>>"


def candidates(text: Column) -> Column:
    """Structs of kind and value, in the order found."""
    def any_of(where: Column, parts: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, (where.contains(p) for p in parts))

    def each(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    none = F.array().cast(_NONE)
    # the text is put into lower case once, as the only element, and not for each name
    named = F.exists(F.array(F.lower(text)), lambda low: any_of(low, _NAMES))
    assigned = F.concat(F.when(any_of(text, ('"', "'")), each("assigned", ASSIGNED)).otherwise(none), each("assigned", BARE))
    return F.concat(F.when(named, assigned).otherwise(none), F.when(any_of(text, _STARTS), each("token_form", FORMS)).otherwise(none))


def _postings(docs: DataFrame, doc_id: str, source: str, found: Column) -> DataFrame:
    """A row for each document, repository and candidate of those found."""
    each = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("repo"), F.explode(found).alias("c"))
    return checkpointed(each.select("doc_id", "repo", F.substring_index("repo", "/", 1).alias("owner"), "c.kind", "c.value").groupBy("doc_id", "repo", "owner", "kind", "value").agg(F.count(F.lit(1)).alias("n_occurrences")))


def _ownership(postings: DataFrame, spread: int, variety: int) -> DataFrame:
    """Of each kind and value: counts and verdict. Distinct counts go by stages of plain ones, so a hot value is combined before it is sent."""
    by_repo = postings.groupBy("kind", "value", "owner", "repo").agg(F.count(F.lit(1)).alias("d"))
    by_owner = by_repo.groupBy("kind", "value", "owner").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("r"))
    counted = by_owner.groupBy("kind", "value").agg(F.sum("d").alias("n_docs"), F.sum("r").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    v = F.col("value")
    weak = (F.size(F.array_distinct(F.split(v, ""))) < variety) | ~v.rlike("[0-9]") | v.rlike(PLACEHOLDER)
    return counted.withColumn("verdict", F.when(weak, "placeholder").when(F.col("n_owners") == 1, "owner_specific").when(F.col("n_owners") >= spread, "copied_example").otherwise("shared"))


def secret_ownership(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", spread: int = SPREAD, variety: int = VARIETY) -> DataFrame:
    """A row for each document, repository and candidate: doc_id, repo, kind, secret_hash (SHA-256), n_occurrences in it, and the hash's n_docs, n_repos, n_owners and verdict. The value itself isn't returned."""
    postings = _postings(docs, doc_id, source, candidates(F.col(text).cast("string")))
    rows = postings.drop("owner").join(_ownership(postings, spread, variety), ["kind", "value"])
    return rows.select("doc_id", "repo", "kind", F.sha2("value", 256).alias("secret_hash"), "n_occurrences", "n_docs", "n_repos", "n_owners", "verdict")


#: The patterns of SQL, which is older: quoted values of up to 200 characters, forms of limited length.
_SQL_ASSIGNED = r"""(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|auth)["']?\s*[:=]\s*["']([A-Za-z0-9+/=_.-]{16,200})["']"""
_SQL_FORMS = r"(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,60}|sk_live_[A-Za-z0-9]{16,64}|AIza[0-9A-Za-z_-]{35})"
SQL = f"""
WITH found AS (
  SELECT doc_id, coalesce(source, '') AS repo, 'assigned' AS kind, unnest(regexp_extract_all(text, '{_SQL_ASSIGNED.replace("'", "''")}', 1)) AS value FROM documents
  UNION ALL
  SELECT doc_id, coalesce(source, '') AS repo, 'token_form' AS kind, unnest(regexp_extract_all(text, '{_SQL_FORMS}', 1)) AS value FROM documents
), posted AS (
  SELECT doc_id, repo, split_part(repo, '/', 1) AS owner, kind, value, count(*) AS n_occurrences FROM found GROUP BY ALL
), counted AS (
  SELECT kind, value, count(*) AS n_docs, count(DISTINCT repo) AS n_repos, count(DISTINCT owner) AS n_owners FROM posted GROUP BY kind, value
)
SELECT doc_id, repo, kind, sha256(value) AS secret_hash, n_occurrences, n_docs, n_repos, n_owners,
  CASE WHEN len(list_distinct(string_split(value, ''))) < {VARIETY} OR NOT regexp_matches(value, '[0-9]') OR regexp_matches(value, '{PLACEHOLDER}') THEN 'placeholder'
       WHEN n_repos >= {SPREAD} THEN 'copied_example' WHEN n_owners = 1 THEN 'owner_specific' ELSE 'shared' END AS verdict
FROM posted JOIN counted USING (kind, value)
"""


def mask_live_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", spread: int = SPREAD, variety: int = VARIETY) -> DataFrame:
    """docs with each owner-specific live-looking value in a text replaced by [SECRET], and n_chars set anew; all rows and columns come back.

    Only rows with a candidate are joined with the verdicts; a row's live values are those of its id (a null id included).
    """
    own, found, live_id, live = docs.columns, *(fresh(docs, n) for n in ("found", "live_id", "live"))
    c = candidates(F.col(text).cast("string"))
    # the rows with a candidate are few and kept with what was found; the corpus is read once for them and once for the rest
    some = checkpointed(docs.withColumn(found, c).where(F.size(found) > 0))
    postings = _postings(some, doc_id, source, F.col(found))
    specific = _ownership(postings, spread, variety).where("verdict = 'owner_specific'").select("kind", "value")
    lists = postings.join(specific, ["kind", "value"]).groupBy(F.col("doc_id").alias(live_id)).agg(F.collect_set("value").alias(live))
    some = some.join(lists, F.col(doc_id).cast("bigint").eqNullSafe(F.col(live_id)), "left")
    values = F.array_sort(F.coalesce(live, F.array().cast("array<string>")), lambda x, y: F.length(y) - F.length(x))
    masked = F.aggregate(values, F.col(text), lambda t, v: F.replace(t, v, F.lit(MASK)))
    some = some.withColumn(text, masked)
    if n_chars in own:
        some = some.withColumn(n_chars, F.when(F.size(values) > 0, F.length(text)).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return docs.where(F.size(c) == 0).unionByName(some.select(*own))
