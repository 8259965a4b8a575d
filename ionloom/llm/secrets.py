"""Secret scanning with corpus-wide ownership frequency, in columns only.

Candidates are found by pattern in whole texts. A candidate's hash is then counted over the corpus by
distinct repositories and distinct owners: a value many owners carry is a copied example, one that only
its owner has, and that looks random, may be live.

Kinds and their rules (fixed values of the contract; matches are leftmost and do not overlap within a kind)
* ``assign``: a keyword, ``=`` or ``:``, then a value of 8 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 16 or more characters in all;
* ``hex``: 32 or more lowercase hex digits.
Added kinds: ``pem`` (a private key from its first line through its last; without a last line, as far as its
base64 goes; its value is the base64 alone, the whole block is blotted; a first line without a key is ``weak``) and
``forge`` (prefixed access tokens of code hosts).

Defined results
* null or empty text: no span; very long texts are scanned whole;
* repeated rows: each is a row of its own, and counts once per repository in the ownership figures;
* null source: one repository of its own, owned by nobody else; an empty table gives an empty result;
* offsets are code points, the end exclusive; extra columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.session import materialise

#: kind -> (pattern, group of the secret value, least characters of that group); base kinds first, in their order.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: What may stand between the lines of a key: space, quotes, escaped line ends, comment and quotation marks.
_BETWEEN = r"""(?:\\[nrt]|[\s"'+,;>#*|\\])*+"""
_TO_END = r"(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
_BODY = rf"(?:{_BETWEEN}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:{_BETWEEN}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{_BETWEEN}[A-Za-z0-9+/]++(?:={{1,2}}+|\z))?+"
ADDED = {
    "pem": (rf"-----BEGIN [A-Z ]*PRIVATE KEY-----({_TO_END}|{_BODY})?+", 1, 1),
    "forge": (r"(?:gh[pousr]_|glpat-)[A-Za-z0-9_-]{20,}", 0, 24),
}
KINDS = {**BASE, **ADDED}


def _key_body(block: Column, rest: Column) -> Column:
    """The base64 of a private key, however its lines are parted; the first line if there is none."""
    body = F.regexp_replace(rest, r"-----END [A-Z ]*PRIVATE KEY-----$|(?:Proc-Type|DEK-Info):[^\r\n\\]*|\\[nrt]", "")
    bare = F.regexp_replace(body, "[^A-Za-z0-9+/=]", "")
    return F.when(bare != "", bare).otherwise(F.regexp_extract(block, "^-----BEGIN [A-Z ]*PRIVATE KEY-----", 0))


def _matches(text: Column, kind: str) -> Column:
    """The spans of one kind as an array of (start, end, rank, kind, value_start, value).

    The pieces between the matches and the matches themselves come from two passes of the same
    pattern; running lengths give the offsets.
    """
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    if kind == "pem":
        values = F.zip_with(found, values, _key_body)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,value_start:int,value:string>>")
    first = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            (start if kind == "pem" else end - F.length(part["value"])).alias("value_start"),
            part["value"].alias("value"),
        )
        kept = F.when(F.length(part["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    # The last piece has no match after it; one pass over (piece, match) pairs.
    pairs = F.slice(parts, 1, F.size(found))
    return F.when(F.size(found) > 0, F.aggregate(pairs, first, step, lambda acc: acc["spans"])).otherwise(empty)


def scan(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add the spans of all kinds, ordered by start, then kind as listed, then end."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*[_matches(body, kind) for kind in KINDS])
    return docs.withColumn(spans, F.array_sort(every))


def secret_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def owner_of(repository: Column) -> Column:
    """The owner part of ``owner/repository``; a name without a slash is its own owner."""
    return F.substring_index(repository, "/", 1)


def ownership(candidates: DataFrame, hash_column: str = "hash", repository: str = "repository") -> DataFrame:
    """``(hash, repositories, owners, uses)``. Counted in two steps, so a hot value is combined before it moves."""
    known = candidates.select(F.col(hash_column).alias("hash"), F.coalesce(F.col(repository), F.lit("")).alias("repository"))
    per_repository = known.groupBy("hash", "repository").agg(F.count(F.lit(1)).alias("uses"))
    per_owner = per_repository.groupBy("hash", owner_of(F.col("repository")).alias("owner")).agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return per_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("uses").alias("uses"))


def looks_random(value: Column) -> Column:
    """Letters and digits mixed, and no character makes up more than a third of the value."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= F.least(F.lit(8), F.length(value) / 2))


def verdicts(found: DataFrame, row_id: str, source: str, spans: str = "spans", widely: int = 3) -> DataFrame:
    """One row per span of ``found``: its hash, its ownership figures and the verdict.

    ``example``: carried by ``widely`` owners or more; ``live``: fewer owners and random-looking;
    ``weak``: fewer owners, but a plain word or placeholder.
    """
    each = found.select(row_id, F.col(source).alias("repository"), F.explode(spans).alias("span"))
    each = each.select(row_id, "repository", "span", secret_hash(F.col("span.value")).alias("hash"))
    counted = each.join(ownership(each), "hash")
    key = (F.col("span.kind") == "pem") & ~F.col("span.value").startswith("-----BEGIN")
    live = F.when(looks_random(F.col("span.value")) | key, F.lit("live")).otherwise(F.lit("weak"))
    return counted.withColumn("verdict", F.when(F.col("owners") >= widely, F.lit("example")).otherwise(live))


def redact(text: Column, ranges: Column, mark: str = "[SECRET]") -> Column:
    """The text with every (start, end) of ``ranges`` replaced; overlapping ranges are replaced as one."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        inside = r["end"] <= acc["at"]
        touching = (r["start"] < acc["at"]) & ~inside
        gap = F.substring(text, acc["at"] + 1, r["start"] - acc["at"])
        out = F.when(inside | touching, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], r["end"]).alias("at"), out.alias("out"))

    return F.aggregate(F.array_sort(ranges), first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def scan_rows(docs: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of every row as a stored narrow table with a row id ``rid``; texts do not move."""
    found = scan(docs.select(*dict.fromkeys([*keep, source]), F.col(text).alias("__text")), "__text").drop("__text")
    return materialise(found.withColumn("rid", F.monotonically_increasing_id()))
