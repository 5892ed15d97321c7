"""Keys and identifiers as Column expressions: titles, DOIs, years, requests, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and their base letter, then letters that fold to two.
ACCENTS = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ",
    "l": "ĺļľŀł", "n": "ñńņňŋ", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťŧț", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
DOUBLE = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ĳ": "ij", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
SEPARATOR = "\u0001"


def fold_latin(text: Column) -> Column:
    """Accents and ligatures of lower-case Latin letters as plain letters; combining marks dropped."""
    out = F.translate(text, "".join(ACCENTS.values()), "".join(k * len(v) for k, v in ACCENTS.items()))
    for letter, pair in DOUBLE.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.regexp_replace(out, r"\p{M}+", "")


def title_key(title: Column) -> Column:
    """Letters and digits of the folded title; null if there are none."""
    return F.nullif(F.regexp_replace(F.lower(fold_latin(F.lower(title))), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def doi_key(doi: Column) -> Column:
    """A DOI in lower case without resolver or label; null if it is none."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:?\s*)", "")
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/\S"), bare)


def year_of(text: Column) -> Column:
    """The first year from 1600 to 2099 in a text."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[^0-9])((?:1[6-9]|20)[0-9]{2})(?:[^0-9]|$)", 1), F.lit(""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def request_key(*parts: Column) -> Column:
    """SHA-256 over the parts of a request; a null part counts as a mark of its own."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def url_host(url: Column) -> Column:
    """Host of a URL, lower case, without user and port."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(rest)


def url_extension(url: Column) -> Column:
    """Extension of the last path segment, lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"//[^/]+/(?:[^/]*/)*[^/]*\.([A-Za-z0-9]{1,5})$", 1))


def url_is_local(url: Column) -> Column:
    """Loopback, private, link-local or metadata addresses, and names that resolve inside."""
    host = url_host(url)
    v4 = host.rlike(r"^(?:127\.|10\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)")
    number = host.rlike(r"^(?:0x[0-9a-f]+|[0-9]+)$")
    octal = host.rlike(r"^(?:0x[0-9a-f]+|0[0-7]+)\.")
    v6 = host.rlike(r"^\[(?:::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{2}:.*|::ffff:.*)\]$")
    name = host.rlike(r"^(?:localhost|.*\.localhost|.*\.local|.*\.internal)\.?$")
    return v4 | number | octal | v6 | name


def is_url(text: Column) -> Column:
    return F.trim(text).rlike(r"(?i)^https?://[^\s/]+\S*$")
