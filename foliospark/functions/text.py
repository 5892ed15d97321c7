"""Scalar text functions as Column expressions: words, sentences, paragraphs, terms, predicates, truncation."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode spaces beside ASCII ones, for "has visible content" and blank lines.
UNICODE_SPACE = "\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff\\u00ad"

#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = [
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "vs", "etc", "e.g", "i.e", "cf", "al", "Fig", "Eq", "No", "Inc",
    "Ltd", "Co",
]
#: Fixed value: scripts written without spaces, indexed as pairs of characters.
DENSE_SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"

NOT_FOUND = "NOT_IN_DOCUMENT"
NONE = "NONE"
PREMISE = "FALSE_PREMISE:"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(text_or_empty(text), r"\s+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text))


def count_chars(text: Column) -> Column:
    """A quarter of the code points, rounded up; blank text has none."""
    value = text_or_empty(text)
    return F.when(has_content(text), F.ceil(F.length(value) / 4)).otherwise(0).cast("int")


def has_content(text: Column) -> Column:
    """Whether any visible character is left after all kinds of white space."""
    return F.regexp_replace(text_or_empty(text), rf"[\s{UNICODE_SPACE}]+", "") != ""


def paragraphs_of(text: Column) -> Column:
    """Parts between blank lines, right-trimmed, without empty ones."""
    lines = F.regexp_replace(text_or_empty(text), r"\r\n?", "\n")
    parts = F.split(lines, rf"\n(?:[ \t{UNICODE_SPACE}]*\n)+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\s+$", "")), has_content)


def sentences_of(text: Column) -> Column:
    """Sentences. Full stops of abbreviations and inside numbers end none; blank lines and CJK stops end one."""
    mark = "\u0001"
    guarded = text_or_empty(text)
    names = "|".join(sorted((a.replace(".", r"\.") for a in ABBREVIATIONS), key=len, reverse=True))
    guarded = F.regexp_replace(guarded, rf"\b({names})\.", "$1" + mark)
    guarded = F.regexp_replace(guarded, r"(?<=\d)\.(?=\d)", mark)
    opening = "[\"'(\\[«“„‘¿¡「『]?"
    western = rf"(?<=[.!?؟۔।॥])[ \t]+(?={opening}[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}])"
    eastern = r"""(?<=[。！？])(?![」』）”’"')\]])[ \t]*|(?<=[。！？][」』）”’])[ \t]*"""
    parts = F.split(guarded, rf"{western}|{eastern}|\n{{2,}}")
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.replace(p, F.lit(mark), F.lit(".")), r"^\s+|\s+$", "")))
    return F.filter(parts, lambda p: p != "")


def lexical_terms(text: Column, min_chars: int = 2) -> Column:
    """Lower-cased runs of letters, marks and digits of at least ``min_chars``; unspaced scripts as pairs."""
    lowered = F.lower(text_or_empty(text))
    runs = F.regexp_extract_all(lowered, F.lit(rf"[\p{{L}}\p{{M}}\p{{N}}]{{{min_chars},}}"), F.lit(0))
    words = F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    run = rf"[{DENSE_SCRIPTS}][{DENSE_SCRIPTS}\p{{Lm}}\p{{M}}]*"
    plain = F.filter(words, lambda w: ~w.rlike(f"[{DENSE_SCRIPTS}]") & (F.length(w) >= min_chars))

    def pairs(piece: Column) -> Column:
        span = F.sequence(F.lit(1), F.greatest(F.length(piece) - 1, F.lit(1)))
        return F.transform(span, lambda i: F.substring(piece, i, F.lit(2)))

    def from_dense(word: Column) -> Column:
        rest = F.filter(F.split(F.regexp_replace(word, run, " "), r"\s+"), lambda r: F.length(r) >= min_chars)
        return F.concat(rest, F.flatten(F.transform(F.regexp_extract_all(word, F.lit(run), F.lit(0)), pairs)))

    dense = F.flatten(F.transform(F.filter(words, lambda w: w.rlike(f"[{DENSE_SCRIPTS}]")), from_dense))
    # one look at the whole text spares most texts a look at every word
    return F.when(text_or_empty(text).rlike(f"[{DENSE_SCRIPTS}]"), F.concat(plain, dense)).otherwise(runs)


#: The absence verdict alone, and at the head of a reply.
_ABSENT = r"(?i)^[\p{P}\p{S}\s]*not[_ ]in[_ ]document[\p{P}\p{S}\s]*$"
_ABSENT_HEAD = r"^[\p{P}\p{S}\s]*(?:(?i:not_in_document|not_in document|not in_document)|NOT IN DOCUMENT)[\p{P}\p{S}]*(?:[.:;,]\s|[。、]|\s*[-–—(\[]|\s*\n)"


def is_not_found(answer: Column) -> Column:
    """The absence verdict: blank, the sentinel alone under any decoration, or opening a reply as a token."""
    value = F.trim(text_or_empty(answer))
    return (value == "") | value.rlike(_ABSENT) | value.rlike(_ABSENT_HEAD)


@functools.cache
def _absent_patterns() -> list[re.Pattern]:
    """The same patterns for Python, which has no classes of punctuation and symbols: each is spelled out."""
    signs = "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "PS")
    spelled = lambda p: p.replace("$", r"[\u0085\u2028\u2029]?\Z").replace(r"\p{P}\p{S}", signs)
    return [re.compile(spelled(p), re.ASCII) for p in (_ABSENT, _ABSENT_HEAD)]


def not_found(answer: str | None) -> bool:
    """``is_not_found`` of one reply, in Python."""
    value = (answer or "").strip(" ")
    if not value:
        return True
    return "document" in value.lower() and any(p.match(value) for p in _absent_patterns())


def is_none_reply(answer: Column) -> Column:
    """NONE alone, decorated or not, or blank."""
    return F.trim(text_or_empty(answer)).rlike(r"(?i)^[\p{P}\p{S}\s]*(?:none)?[\p{P}\p{S}\s]*$") | is_not_found(answer)


def premise_split(answer: Column) -> Column:
    """struct(flagged, premise, answer) of a reply that may open with FALSE_PREMISE: on its first line."""
    value = F.trim(text_or_empty(answer))
    flagged = value.rlike(r"^[*_`\s]*FALSE_PREMISE:")
    head = F.regexp_extract(value, r"^[*_`\s]*FALSE_PREMISE:\s*([^\n]*)", 1)
    rest = F.regexp_replace(value, r"^[*_`\s]*FALSE_PREMISE:[^\n]*\n*", "")
    return F.struct(
        flagged.alias("flagged"),
        F.when(flagged, F.trim(head)).alias("premise"),
        F.when(flagged, F.trim(rest)).otherwise(value).alias("answer"),
    )


def truncate_words(text: Column, n: int, marker: str = " [...]") -> Column:
    """The first ``n`` words; the marker is kept where its own words take less than half of ``n``."""
    words = words_of(text)
    room = len(marker.split())
    keep = n - room if room < n / 2 else n
    cut = F.array_join(F.slice(words, 1, max(keep, 1)), " ")
    return F.when(F.size(words) <= n, text_or_empty(text)).otherwise(F.concat(cut, F.lit(marker if room < n / 2 else "")))


def squeeze(text: Column) -> Column:
    """Lower case, every run that is not a letter or digit as one space."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+", " "))


#: A citation marker of review prose, alone at the head of a sentence it belongs to the one before.
MARKER = r"\[(?i:stud(?:y|ies)|chunks?|sources?)\s[^\]]*\]"


def review_sentences(text: Column) -> Column:
    """Sentences of review prose; one that is only citation markers and stops is glued to the one before."""
    parts = F.split(text_or_empty(text), r"(?<=[.!?])\s+|(?<=[.!?]\])\s+|\n{2,}")
    parts = F.filter(F.transform(parts, F.trim), lambda p: p != "")
    alone = lambda p: p.rlike(rf"^(?:{MARKER}[\s.;,]*)+$")
    none = F.expr("cast(array() as array<string>)")
    last = lambda s: F.element_at(s, -1)
    step = lambda s, p: F.when(alone(p) & (F.size(s) > 0), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.concat(last(s), F.lit(" "), p)))).otherwise(F.concat(s, F.array(p)))
    return F.aggregate(parts, none, step)


def sentence_spans(text: Column) -> Column:
    """array of struct(start, end, sentence): where each review sentence stands, in code points, ends exclusive."""
    found = review_sentences(text)
    body = text_or_empty(text)
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, sentence: string>>)").alias("out"))

    def step(s: Column, p: Column) -> Column:
        # glued markers may stand behind other white space than the one blank that joins them here
        start = F.call_function("locate", p, body, s["at"] + 1) - 1
        hit = F.when(start < 0, s["at"]).otherwise(start).cast("int")
        row = F.struct(hit.alias("start"), (hit + F.length(p)).cast("int").alias("end"), p.alias("sentence"))
        return F.struct((hit + F.length(p)).cast("int").alias("at"), F.concat(s["out"], F.array(row)).alias("out"))

    return F.aggregate(found, zero, step, lambda s: s["out"])


def prose_words(text: Column) -> Column:
    """Words of review prose: without citation markers, heading lines and list bullets."""
    bare = F.regexp_replace(text_or_empty(text), MARKER, " ")
    bare = F.regexp_replace(bare, r"(?m)^[ \t]*#{1,6}[ \t].*$", " ")
    bare = F.regexp_replace(bare, r"(?m)^[ \t]*(?:[-*+•]|[0-9]+[.)])[ \t]+", " ")
    return count_words(bare)
