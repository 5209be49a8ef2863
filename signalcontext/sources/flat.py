"""Delimited indicator lists (comma, semicolon, tab or bare lines) as claims, by column expressions alone.

A document is one row (file, text); documents are bounded in size, so no line crosses tasks and nothing shuffles.
Quotes have no meaning.  Null and empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon

#: Header names by the kind that they state.
HEADERS = {
    "ip_address": ["ip", "ip_address", "ipv4", "ipv6", "address", "src_ip", "dst_ip"],
    "domain_name": ["domain", "hostname", "host", "fqdn"],
    "url": ["url", "uri", "link"],
    "email_address": ["email", "email_address", "sender"],
    "file_hash": ["hash", "md5", "sha1", "sha256", "sha512", "file_hash"],
    "ip_range": ["cidr", "range", "network"],
}
#: Delimiters in the order of preference.
DELIMITERS = ["\t", ";", ","]
SAMPLE_LINES, FIELD_BYTES = 10, 65_536


def documents(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _counts(lines, delimiter: str):
    return F.transform(lines, lambda x: F.size(F.split(x["line"], delimiter, -1)) - 1)


def _delimiter(lines):
    """The delimiter that every sampled line has equally often; the one that makes most columns wins, ties go to the first."""
    sample = F.slice(lines, 1, SAMPLE_LINES)
    tried = []
    for place, d in enumerate(DELIMITERS):
        counts = _counts(sample, d)
        even = (F.array_min(counts) == F.array_max(counts)) & (F.array_min(counts) > 0)
        tried.append(F.when(even, F.struct(F.array_min(counts).alias("n"), F.lit(-place).alias("rank"), F.lit(d).alias("delimiter"))))
    return F.array_max(F.array_compact(F.array(*tried)))["delimiter"]


def fields(docs: DataFrame) -> DataFrame:
    """file, line (from 0), column (from 0), stated (the kind that the header names, or null), raw; header lines left out."""
    text = F.regexp_replace("text", "^\ufeff", "")
    numbered = F.transform(F.split(text, r"\r?\n", -1), lambda x, i: F.struct(i.alias("at"), F.rtrim(x).alias("line")))
    data = F.filter(numbered, lambda x: (F.trim(x["line"]) != "") & ~x["line"].startswith("#"))
    d = docs.where("text is not null").select("file", data.alias("lines")).where(F.size("lines") > 0)
    d = d.select("file", "lines", _delimiter(F.col("lines")).alias("delimiter"))
    # Without a delimiter a line is one field: a line holds no line break.
    cut = F.coalesce("delimiter", F.lit("\n"))
    names = F.transform(F.split(F.col("lines")[0]["line"], cut, -1), lambda x: F.regexp_replace(F.lower(F.trim(x)), "[ -]", "_"))
    kinds = F.create_map(*(F.lit(x) for kind, all_names in HEADERS.items() for name in all_names for x in (name, kind)))
    d = d.select("file", "lines", cut.alias("cut"), F.transform(names, lambda x: F.try_element_at(kinds, x)).alias("stated"))
    header = F.exists("stated", lambda x: x.isNotNull())
    d = d.select("file", "cut", "stated", header.alias("header"), F.posexplode("lines").alias("place", "row")).where("not header or place > 0")
    d = d.select("file", F.col("row.at").alias("line"), "header", "stated", F.posexplode(F.split("row.line", F.col("cut"), -1)).alias("column", "raw"))
    return d.select("file", "line", "column", F.when(F.col("header"), F.get("stated", F.col("column"))).alias("stated"), F.trim("raw").alias("raw")).where("raw <> ''")


def claims(docs: DataFrame) -> DataFrame:
    """file, line, column, kind, value, attribute, raw, outcome: one row a field that is an indicator ('claim') or is
    refused ('field_too_long', 'unmappable_field', 'ambiguous_inference'); other fields give none."""
    raw = F.col("raw")
    given = F.coalesce(*(F.when(F.col("stated") == kind, read(raw)) for kind, read in canon.KINDS.items()))
    f = fields(docs).select("*", given.alias("given"), canon.infer(raw).alias("found"))
    known = F.col("stated").isNotNull()
    long = F.octet_length("raw") > FIELD_BYTES
    value = F.when(~long, F.when(known, F.col("given")).otherwise(F.col("found.value")))
    outcome = F.when(long, "field_too_long").when(value.isNotNull(), "claim").when(known, "unmappable_field").when(F.col("found.outcome") == "ambiguous", "ambiguous_inference")
    stated = F.when(F.col("stated") == "ip_address", canon.address_kind(value)).otherwise(F.col("stated"))
    kind = F.when(value.isNotNull(), F.coalesce(stated, "found.kind"))
    formula = raw.rlike(r"^[=+\-@]") & (F.length(raw) > 1) & canon.ip_address(raw).isNull()
    attribute = F.when(kind.isNotNull(), F.when(formula, "flat.spreadsheet_formula_prefix").otherwise(F.concat(F.lit("flat."), kind)))
    return f.select("file", "line", "column", kind.alias("kind"), value.alias("value"), attribute.alias("attribute"), "raw", outcome.alias("outcome")).where("outcome is not null")
