"""Normalisers, keys and small computations on scholarly records, as column expressions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Document versions by the words that providers use.
VERSION_TYPES = {"submittedversion": "preprint", "acceptedversion": "accepted", "publishedversion": "published"}


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(title), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def normalize_doi(value: Column) -> Column:
    out = F.lower(F.trim(value))
    for prefix in (r"^https://doi\.org/", r"^http://doi\.org/", "^doi:"):
        out = F.regexp_replace(out, prefix, "")
    return out


def normalize_arxiv(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), r"(?i)^(https?://arxiv\.org/abs/|arxiv:)", ""), r"(?i)v\d+$", ""))


def normalize_openalex(value: Column) -> Column:
    return F.upper(F.substring_index(F.regexp_replace(F.trim(value), "/+$", ""), "/", -1))


def normalize_identifier(scheme: Column, value: Column) -> Column:
    s = F.lower(scheme)
    return F.when(s == "doi", normalize_doi(value)).when(s == "arxiv", normalize_arxiv(value)).when(s == "openalex", normalize_openalex(value)).otherwise(F.trim(value))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """The name-based UUID of version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC with a key that the driver pads; the key itself is in no plan as text."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in padded).hex() for x in (0x36, 0x5C))
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def bucket(digest: Column) -> Column:
    """0 to 99 from the first four bytes of a hex digest."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100).cast("int")


def retrieval_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def canonical_key(doi: Column, arxiv: Column, openalex: Column, s2: Column, legacy: Column) -> Column:
    pairs = (("doi", doi), ("arxiv", arxiv), ("openalex", openalex), ("s2", s2), ("legacy", legacy))
    return F.coalesce(*[F.concat(F.lit(f"{n}:"), F.nullif(c, F.lit(""))) for n, c in pairs])


def conservative_date(date: Column, year: Column) -> Column:
    """An ISO date, or the last day of the year."""
    return F.coalesce(F.try_to_date(date, "yyyy-MM-dd"), F.make_date(year, F.lit(12), F.lit(31)))


def version_type(name: Column) -> Column:
    out = F.lit("unknown")
    for key, value in VERSION_TYPES.items():
        out = F.when(F.lower(F.trim(name)) == key, value).otherwise(out)
    return out


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes")


def stratum(text: Column, keys: list[str]) -> Column:
    """``k=v;k=v`` reduced to ``keys``; what is missing is unknown."""
    parsed = F.str_to_map(text, F.lit(";"), F.lit("="))
    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.coalesce(parsed[k], F.lit("unknown"))) for k in keys])


def expansion_cost(prompt: Column, cached: Column, out: Column, rate_in: Column, rate_cached: Column, rate_out: Column) -> Column:
    """Cost in units of account from tokens and rates per million; null where a needed rate is null."""
    fresh = F.greatest(prompt - cached, F.lit(0))
    return F.round((fresh * rate_in + cached * F.coalesce(rate_cached, rate_in) + out * rate_out) / 1_000_000, 9)


def matched_terms(query: Column, text: Column, n: int = 6) -> Column:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_-]{3,}"), F.lit(0)))
    return F.slice(F.array_sort(F.array_intersect(words(query), words(text))), 1, n)


def abstract_from_positions(index: Column) -> Column:
    """Text of an inverted index, a map of token to places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def payload_checksum(payload: Column) -> Column:
    """SHA-256 of a map of fields as compact JSON with sorted names."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload)))), 256)


def topic_values(topics: Column) -> Column:
    """Names and ids of topics and what is above them: lower-cased, without a slash at the end, and the last part of a path."""
    levels = F.flatten(F.transform(topics, lambda t: F.array(t["topic"], t["subfield"], t["field"], t["domain"])))
    given = F.filter(F.transform(levels, lambda x: F.lower(F.regexp_replace(F.trim(x), "/+$", ""))), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.concat(given, F.transform(given, lambda x: F.substring_index(x, "/", -1)))))


def filter_key(filters: Column) -> Column:
    """The active ones of a map of search filters as compact JSON with sorted names."""
    active = F.map_filter(filters, lambda _, v: v.isNotNull() & (F.trim(v) != ""))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(active))))


def parsed_filters(raw: Column, this_year: int) -> Column:
    """A map of raw filters as typed ones and the first reason to refuse them, null if there is none."""
    number = lambda name, least, most: F.when(raw[name].try_cast("int").between(least, most), raw[name].try_cast("int"))
    since, until, cited = number("since", 1900, this_year + 1), number("until", 1900, this_year + 1), number("cited", 0, 10_000_000)
    given = lambda name: F.trim(F.coalesce(raw[name], F.lit(""))) != ""
    code = F.when((given("since") & since.isNull()) | (given("until") & until.isNull()), "year").when(since > until, "order").when(given("cited") & cited.isNull(), "citations")
    return F.struct(since.alias("since"), until.alias("until"), cited.alias("cited"), truthy(raw["open"]).alias("open"), F.substring(F.trim(raw["venue"]), 1, 120).alias("venue"), code.alias("code"))


def links(doi: Column, issn: Column, pdf: Column, url: Column) -> Column:
    """Addresses of a work: by DOI, of its journal, of its file (only over http), and the first that there is."""
    by_doi = F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi))
    by_issn = F.when(issn.rlike("^[0-9]{4}-[0-9]{3}[0-9Xx]$"), F.concat(F.lit("https://portal.issn.org/resource/ISSN/"), F.upper(issn)))
    file = F.when(pdf.rlike("^https?://"), pdf)
    return F.struct(by_doi.alias("doi"), by_issn.alias("issn"), file.alias("pdf"), F.coalesce(file, by_doi, F.nullif(url, F.lit("")), by_issn).alias("best"))


def token_usage(response: Column) -> Column:
    """Prompt, completion and cached tokens of a response in JSON; what is missing or negative is 0."""
    at = lambda path: F.greatest(F.coalesce(F.get_json_object(response, path).try_cast("long"), F.lit(0)), F.lit(0)).cast("long")
    return F.struct(at("$.usage.prompt_tokens").alias("prompt"), at("$.usage.completion_tokens").alias("completion"), at("$.usage.prompt_tokens_details.cached_tokens").alias("cached"))
