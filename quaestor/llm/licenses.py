"""Licence scans: canonical digests of entire texts, joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN, more

#: Spellings that count as one, as whole words after normalising: the left becomes the right.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "non infringement": "noninfringement",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "organisations": "organizations",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "authorisation": "authorization",
    "favour": "favor",
    "fulfil": "fulfill",
    "whilst": "while",
    "https": "http",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What follows `copyright` where a licence's own sentence was wrapped before it.
BODY = "act|and|are|as|claims?|disclaimer|doctrines|for|holders?|if|in|infringement|interests?|is|law|laws|license|licenses|licence|licences|like|notice|notices|of|on|or|owners?|ownership|patent|permission|protection|resulting|rights|statements?|status|the software|to|treaty|under"
#: A line that only says who holds the rights, in lower case: any of these and none of NOT_HOLDER. `copyright` with a sign, a
#: year or a holder, a sign with a year or a short name, or `all rights reserved` alone. The patterns mean the same to Java and RE2.
_GAP, _SOLID = r"[ \t]", r"[^ \t\n\r\f\x0B]"
HOLDER = rf"^{_GAP}*(copyright:?{_GAP}*(\(c\)|©|[0-9][0-9][0-9][0-9])|copyright:?{_GAP}+[^ \t]|\(c\){_GAP}*[0-9][0-9][0-9][0-9]|\(c\){_GAP}+{_SOLID}+({_GAP}+{_SOLID}+)?({_GAP}+{_SOLID}+)?({_GAP}+{_SOLID}+)?[ \t\r]*\z|©|all rights reserved[. \t\r]*\z)"
NOT_HOLDER = rf"^{_GAP}*copyright:?{_GAP}+({BODY})([^a-z0-9_]|\z)"
#: What isn't a letter or digit; characters beyond ASCII stay.
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """A text's canonical form: A-Z in lower case, no copyright lines, words joined by single spaces, one spelling."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "\n")
    plain = F.array_join(F.filter(lines, lambda line: ~line.rlike(HOLDER) | line.rlike(NOT_HOLDER)), "\n")
    # two spaces between words, so that each has spaces of its own
    out = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(plain, PUNCTUATION, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(_spaced(old)), F.lit(_spaced(new)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id) of known texts; of texts with one canonical form the least id counts."""
    table = spark.createDataFrame(sorted(texts.items() if texts else [*KNOWN.items(), *more()]), "license_id string, text string")
    return table.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, digest of the canonical form of the entire text, license_id (null: none known).

    Null and empty texts, and those of copyright lines only, have the digest of an empty form. licenses is the small
    table of known(); Spark joins it by hash and broadcasts it if its measured size allows.
    """
    table = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return table.join(licenses, "digest", "left").select("doc_id", "digest", "license_id")


def oracle(texts: dict[str, str] | None = None) -> str:
    """DuckDB SQL of scan() over documents with the known texts: the same patterns, spellings and texts."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        lines = f"string_split(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), chr(10))"
        plain = f"array_to_string(list_filter({lines}, lambda line: NOT regexp_matches(line, {quoted(HOLDER)}) OR regexp_matches(line, {quoted(NOT_HOLDER)})), chr(10))"
        out = f"(' ' || replace(trim(regexp_replace({plain}, {quoted(PUNCTUATION)}, ' ', 'g')), ' ', '  ') || ' ')"
        for old, new in SPELLINGS.items():
            out = f"replace({out}, '{_spaced(old)}', '{_spaced(new)}')"
        return f"sha256(trim(replace({out}, '  ', ' ')))"

    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(texts.items() if texts else [*KNOWN.items(), *more()]))
    return f"""WITH known AS (SELECT {form('text')} AS digest, min(license_id) AS license_id FROM (VALUES {rows}) AS k(license_id, text) GROUP BY 1),
scanned AS (SELECT doc_id, {form('text')} AS digest FROM documents)
SELECT doc_id, scanned.digest AS digest, license_id FROM scanned LEFT JOIN known ON scanned.digest = known.digest"""
