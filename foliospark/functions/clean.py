"""Cleaners: Column to Column rewrites, run early before late, with a log of characters removed."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import UNICODE_SPACE, text_or_empty


@dataclass(frozen=True)
class Cleaner:
    name: str
    stage: str
    run: Callable[[Column], Column]
    default: bool = False
    scope: str = "block"


CLEANERS: dict[str, Cleaner] = {}

#: The named presets.
PRESETS = {
    "none": [],
    "minimal": ["control_chars", "collapse_whitespace"],
    "standard": ["page_numbers", "hyphenation", "control_chars", "ligatures", "collapse_whitespace"],
    "academic": ["page_numbers", "captions", "references", "hyphenation", "control_chars", "ligatures", "collapse_whitespace"],
    "scan": ["page_numbers", "headers_footers", "hyphenation", "control_chars", "ligatures", "collapse_whitespace"],
    "legacy": ["page_numbers", "captions", "urls", "emails", "references", "remove_numbers", "collapse_whitespace"],
}
#: Typographic characters and their plain spelling.
TYPOGRAPHY = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "“": '"', "”": '"', "‘": "'", "’": "'", "…": "..."}


def register_cleaner(name: str, stage: str = "late", default: bool = False, scope: str = "block"):
    """Add a cleaner; the latest registration of a name wins."""
    if stage not in ("early", "late"):
        raise ValueError("stage is early or late")

    def add(run: Callable[[Column], Column]) -> Callable[[Column], Column]:
        CLEANERS[name] = Cleaner(name, stage, run, default, scope)
        return run

    return add


# The patterns of page_numbers, captions, urls, emails and references decide which text goes, so they
# are stated as the results need them.
@register_cleaner("page_numbers", "early", True)
def page_numbers(x: Column) -> Column:
    """Lines that only number a page: "Page 4 of 9", "- 12 -", "[12]"; "12." after a blank line or a sentence end."""
    x = F.regexp_replace(x, r"(?mi)^[ \t]*(?:page|p\.)[ \t]*\d+[ \t]*(?:of[ \t]*\d+)?[ \t]*$", "")
    x = F.regexp_replace(x, r"(?m)^[ \t]*(?:[-–—][ \t]*\d{1,4}[ \t]*[-–—]|\[[ \t]*\d{1,4}[ \t]*\])[ \t]*$", "")
    number = r"[ \t]*\d{1,4}[ \t]*\.[ \t]*(?=\n|\z)"
    x = F.regexp_replace(x, rf"\A{number}", "")
    after_end = r"""(?<=[.!?。！？]["'”’)\]]{0,3}[ \t]{0,8}\n)"""
    return F.regexp_replace(F.regexp_replace(x, rf"(?<=\n[ \t]{{0,8}}\n){number}", ""), rf"{after_end}{number}", "")


@register_cleaner("captions", "early")
def captions(x: Column) -> Column:
    """Caption lines: a label and number followed by punctuation, a capital, or nothing."""
    label = r"(?m)^[ \t]*(?i:figure|fig\.|table|tbl\.|exhibit|chart)[ \t]*S?\d+[A-Za-z]?"
    return F.regexp_replace(x, label + r"(?:[ \t]*$|[ \t]*[.:|)–—].*$|[ \t]+-[ \t].*$|[ \t]+\p{Lu}.*$)", "")


@register_cleaner("urls", "early")
def urls(x: Column) -> Column:
    return F.regexp_replace(x, r"(?i)\b(?:https?://|www\.)\S+", "")


@register_cleaner("emails", "early")
def emails(x: Column) -> Column:
    return F.regexp_replace(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "")


@register_cleaner("references", "early", scope="document")
def references(x: Column) -> Column:
    """From the first bibliography heading at or after two fifths of the text to the end."""
    heading = r"(?mi)^[ \t]*(?:\d+\.?[ \t]*)?(?:references|bibliography|works cited)[ \t:]*$"
    cut_at = F.ceil(F.length(x) * 0.4).cast("int")
    start = F.greatest(cut_at - 1, F.lit(0))
    before, after = F.substring(x, F.lit(1), start), F.substring(x, start + 1, F.length(x))
    kept = F.regexp_replace(after, rf"(?s)(?:{heading}).*\z", "")
    # a heading counts only if its line begins in the tail: the tail itself may begin inside a line
    whole_line = (start == 0) | before.endswith("\n")
    inside = F.regexp_extract(after, r"\A[^\n]*", 0)
    rest = F.substring(after, F.length(inside) + 1, F.length(after))
    return F.when(whole_line, F.concat(before, kept)).otherwise(F.concat(before, inside, F.regexp_replace(rest, rf"(?s)(?:{heading}).*\z", "")))


@register_cleaner("hyphenation", "early", True)
def hyphenation(x: Column) -> Column:
    """Rejoin a word that a line break splits after its hyphen, unless the text writes it with the hyphen elsewhere.

    Number ranges and a capital after a lower-case part are left alone.
    """
    lower = r"(\p{Ll}+)-[ \t]*\n[ \t]*(\p{Ll}+)"
    compounds = F.transform(F.regexp_extract_all(x, F.lit(r"[\p{L}]+-[\p{L}]+"), F.lit(0)), F.lower)
    broken = F.array_distinct(F.regexp_extract_all(x, F.lit(lower), F.lit(0)))
    written = F.filter(
        broken, lambda b: F.array_contains(compounds, F.lower(F.regexp_replace(b, r"-[ \t]*\n[ \t]*", "-")))
    )
    keep = F.aggregate(written, x, lambda acc, b: F.replace(acc, b, F.regexp_replace(b, r"[ \t]*\n[ \t]*", "")))
    joined = F.regexp_replace(keep, lower, "$1$2")
    return F.regexp_replace(joined, r"(\p{Lu}{2,})-[ \t]*\n[ \t]*(\p{Lu}{2,})", "$1$2")


@register_cleaner("headers_footers", "early", scope="document")
def headers_footers(x: Column) -> Column:
    """First and last lines of paragraphs, at most 80 characters, that stand there three times or more."""
    blocks = F.split(x, r"\n{2,}")
    edge = lambda b: F.array(F.regexp_extract(b, r"\A[^\n]*", 0), F.regexp_extract(b, r"[^\n]*\z", 0))
    lines = F.filter(F.flatten(F.transform(blocks, lambda b: F.array_distinct(edge(b)))), lambda line: (F.trim(line) != "") & (F.length(line) <= 80))
    repeated = F.filter(F.array_distinct(lines), lambda line: F.size(F.filter(lines, lambda other: other == line)) >= 3)
    kept = F.filter(F.split(x, "\n"), lambda line: ~F.array_contains(repeated, line))
    return F.when(F.size(repeated) == 0, x).otherwise(F.array_join(kept, "\n"))


@register_cleaner("collapse_whitespace", "late", True)
def collapse_whitespace(x: Column) -> Column:
    x = F.regexp_replace(x, rf"(?m)^[ \t{UNICODE_SPACE}]+$", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"[ \t]*\n[ \t]*", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


@register_cleaner("control_chars", "late", True)
def control_chars(x: Column) -> Column:
    """Zero-width marks go (joiners stay); control characters but tab and line ends become spaces."""
    x = F.regexp_replace(x, "[\\u200b\\u200e\\u200f\\ufeff\\u00ad]", "")
    return F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")


@register_cleaner("ligatures", "late", True)
def ligatures(x: Column) -> Column:
    for old, new in TYPOGRAPHY.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


@register_cleaner("remove_numbers", "late")
def remove_numbers(x: Column) -> Column:
    return F.regexp_replace(x, r"[0-9]+", " ")


@register_cleaner("remove_punctuation", "late")
def remove_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}_\s]", " ")


@register_cleaner("ascii_only", "late")
def ascii_only(x: Column) -> Column:
    """Accents dropped, other non-ASCII characters as spaces."""

    @F.pandas_udf(T.StringType())
    def fold(values):
        def one(v):
            if v is None or v.isascii():
                return v
            flat = unicodedata.normalize("NFKD", v)
            return "".join(c if ord(c) < 128 else "" if unicodedata.combining(c) else " " for c in flat)

        return values.map(one)

    return fold(x)


@register_cleaner("lowercase", "late")
def lowercase(x: Column) -> Column:
    return F.lower(x)


def resolve_steps(clean: str | Iterable[str] | None) -> list[str]:
    """Names of the steps of a preset, or of a list of names; early steps first, order kept inside a stage."""
    if clean is None:
        clean = "standard"
    names = PRESETS[clean] if isinstance(clean, str) and clean in PRESETS else [clean] if isinstance(clean, str) else list(clean)
    for name in names:
        if name not in CLEANERS:
            raise KeyError(f"no cleaner {name!r}; there are {', '.join(CLEANERS)}")
    return sorted(names, key=lambda n: CLEANERS[n].stage != "early")


def clean(text: Column, steps: str | Iterable[str] | None = None) -> Column:
    """The cleaned text as one expression, so Catalyst sees the whole chain.

    Each step is bound to the text before it by a lambda: a step that reads its input several times would otherwise
    multiply every step before it. ``ascii_only`` runs Python and is composed plainly.
    """
    out = text_or_empty(text)
    for name in resolve_steps(steps):
        run = CLEANERS[name].run
        out = run(out) if name == "ascii_only" else F.transform(F.array(out), run)[0]
    return out


def clean_log(df: DataFrame, key: str, text: str, steps: str | Iterable[str] | None = None) -> DataFrame:
    """(key, step_no, step, stage, scope, chars_removed): what each step took out, in the order they run."""
    names = resolve_steps(steps)
    out = df.select(key, text_or_empty(F.col(text)).alias("_0"))
    for k, name in enumerate(names):
        out = out.withColumn(f"_{k + 1}", CLEANERS[name].run(F.col(f"_{k}")))
    rows = F.array(*[
        F.struct(
            F.lit(k + 1).alias("step_no"), F.lit(name).alias("step"), F.lit(CLEANERS[name].stage).alias("stage"),
            F.lit(CLEANERS[name].scope).alias("scope"), (F.length(f"_{k}") - F.length(f"_{k + 1}")).alias("chars_removed"),
        )
        for k, name in enumerate(names)
    ])
    return out.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def drop_running_heads(df: DataFrame, group: str, key: str, text: str, least: int = 3, longest: int = 80) -> DataFrame:
    """Lines of at most ``longest`` characters that open or close at least ``least`` texts of a group are dropped.

    Lines are counted with partial aggregation, so a head that every document of a group carries is one row a task.
    """
    lines = df.select(group, key, F.posexplode(F.split(text_or_empty(F.col(text)), "\n")).alias("line_no", "line"), F.size(F.split(text_or_empty(F.col(text)), "\n")).alias("n"))
    edge = lines.filter(((F.col("line_no") == 0) | (F.col("line_no") == F.col("n") - 1)) & (F.trim("line") != "") & (F.length("line") <= longest))
    heads = edge.groupBy(group, "line").agg(F.count_distinct(key).alias("times")).filter(F.col("times") >= least).select(group, "line", F.lit(True).alias("head"))
    at_edge = (F.col("line_no") == 0) | (F.col("line_no") == F.col("n") - 1)
    kept = lines.join(heads, [group, "line"], "left").filter(~(at_edge & F.coalesce("head", F.lit(False))))
    joined = kept.groupBy(group, key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    whole = df.select(group, key).join(joined.select(group, key, body.alias("body")), [group, key], "left")
    return whole.select(group, key, F.coalesce("body", F.lit("")).alias(text))
