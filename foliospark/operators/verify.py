"""Verification: quotations against sources, numbers against quotations, citations against what was supplied."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import squeeze, text_or_empty
from foliospark.session import cut

#: Similarity a near-verbatim quotation needs, the same for short ones, and the least tokens.
NEAR, NEAR_SHORT, SHORT_CHARS, NEAR_TOKENS = 0.90, 0.95, 40, 5
#: Cells of an edit-distance table beyond which a quotation is not checked.
MAX_CELLS = 50_000_000
#: Words that turn a sentence.
NEGATIONS = set("not no never none neither nor without cannot can't don't doesn't didn't isn't aren't wasn't weren't won't nicht kein keine nie pas jamais sans ne sin nunca".split())
#: Number words.
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
#: Number words of German, French and Spanish; tens join units by a word between or a hyphen.
FOREIGN = {
    "de": ("null ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn", {"zwanzig": 20, "dreissig": 30, "vierzig": 40, "fünfzig": 50, "sechzig": 60, "siebzig": 70, "achtzig": 80, "neunzig": 90}),
    "fr": ("zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf", {"vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "quatre-vingt": 80, "quatre-vingts": 80}),
    "es": ("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve", {"veinte": 20, "treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90}),
}
FOREIGN_SCALE = {"hundert": 100, "tausend": 1000, "cent": 100, "cents": 100, "mille": 1000, "ciento": 100, "cien": 100, "mil": 1000, "million": 1e6, "millionen": 1e6, "millions": 1e6, "millón": 1e6, "millones": 1e6}
#: Han digits and powers.
HAN = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2}
HAN_POWERS, HAN_MYRIADS = {"十": 10, "百": 100, "千": 1000}, {"万": 10**4, "亿": 10**8}
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
SCALE = {"hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12, "k": 1e3, "m": 1e6, "bn": 1e9, "mn": 1e6}


# ---------------------------------------------------------------- quotations
#: Quotation marks, dashes and spaces as plain ones.
_QUOTES, _DASHES, _SPACES = ("‘’‚‛", "“”„‟«»"), "‐‑‒–—―−", "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Full-width forms stand at a fixed distance from ASCII; superscript digits one by one.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ONE_FROM = _QUOTES[0] + _QUOTES[1] + _DASHES + _SPACES + _WIDE + "¹²³⁰⁴⁵⁶⁷⁸⁹"
_ONE_TO = "'" * len(_QUOTES[0]) + '"' * len(_QUOTES[1]) + "-" * len(_DASHES) + " " * len(_SPACES) + "".join(map(chr, range(0x21, 0x7F))) + "1230456789"
#: Letters and signs that stand for several.
_MANY = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ß": "ss", "…": "...", "½": "1/2", "¼": "1/4", "¾": "3/4", "\u00ad": ""}


def normalise(text: str) -> str:
    """Straight quotes and dashes, plain widths and ligatures, lower case, white space squeezed. The same tables serve
    Catalyst, so both sides judge a quotation alike."""
    text = text.translate(str.maketrans(_ONE_FROM, _ONE_TO))
    for one, many in _MANY.items():
        text = text.replace(one, many)
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ")


def normalise_column(text: Column) -> Column:
    """``normalise`` as a Column."""
    out = F.translate(text_or_empty(text), _ONE_FROM, _ONE_TO)
    for one, many in _MANY.items():
        out = F.replace(out, F.lit(one), F.lit(many))
    return F.trim(F.regexp_replace(F.lower(out), r"\s+", " "))


def stands_in(s: Column, q: Column) -> Column:
    """Whether a normalised quotation stands in a normalised source between word and number boundaries."""
    escaped = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?<![\p{N}][.,])\Q"), F.replace(q, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}])(?![.,]\p{N})"))
    return (q != "") & F.contains(s, q) & F.rlike(s, escaped)


def contains_quote(source: Column, quote: Column) -> Column:
    """``stands_in`` of both as they are."""
    return stands_in(normalise_column(source), normalise_column(quote))


def in_order(source: str, quote: str) -> bool:
    """Pieces of an elided quotation ("a ... b") in order; a gap may hold no negation and no sentence end."""
    pieces = [p.strip(" .,;") for p in re.split(r"\[?(?:\.{3,}|…)\]?", normalise(quote))]
    pieces = [p for p in pieces if p]
    text, at, last = normalise(source), 0, None
    for p in pieces:
        m = re.compile(rf"(?<!\w){re.escape(p)}(?!\w)").search(text, at)
        if not m:
            return False
        if last is not None:
            gap = text[last : m.start()]
            if NEGATIONS & set(re.findall(r"[\w']+", gap)) or re.search(r"[.!?]\s", gap):
                return False
        at = last = m.end()
    return bool(pieces)


def window_edits(source: str, quote: str) -> tuple[int, int]:
    """(fewest edits that turn the quotation into some part of the source, where that part ends).

    Rows of the table are vectors; the running insertions along a row are a cumulative minimum.
    """
    s = np.frombuffer(source.encode("utf-32-le"), np.uint32)
    row, steps = np.zeros(len(s) + 1, np.int64), np.arange(len(s) + 1)
    for i, c in enumerate(np.frombuffer(quote.encode("utf-32-le"), np.uint32), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (s != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def critical_tokens(text: str) -> list[str]:
    """What must not differ: numbers, comparison and per cent signs, negations."""
    return sorted(t for t in re.findall(r"\d+(?:[.,]\d+)*|[<>=≤≥%±]|[\w']+", text) if not re.fullmatch(r"[\w']+", t) or t[0].isdigit() or t in NEGATIONS or t in NUMBER_WORDS or t in TENS)


def match_quote(source: str | None, quote: str | None) -> tuple[str, float, int, bool, float]:
    """(status, similarity, edits, critical tokens equal, coverage); status verbatim, elided, near_verbatim, unverified or
    not_checked. An elided quotation has its pieces in order, and nothing in the gaps that turns them. Coverage is the
    share of the quotation that the source has in order."""
    status, similarity, edits, critical = _matched(source, quote)
    if status == "unverified" and re.search(r"\.{3,}|…", quote or "") and in_order(source or "", quote or ""):
        return "elided", 1.0, 0, True, 1.0
    size = len(normalise(quote or ""))
    return status, similarity, edits, critical, round(max(0.0, 1 - edits / size), 4) if size and status != "not_checked" else 0.0


def _matched(source: str | None, quote: str | None) -> tuple[str, float, int, bool]:
    s, q = normalise(source or ""), normalise(quote or "")
    if not q or not s:
        return "unverified", 0.0, len(q), False
    if re.search(rf"(?<!\w){re.escape(q)}(?!\w)", s) and not re.search(rf"\d[.,]{re.escape(q)}", s[: s.find(q) + len(q)]):
        return "verbatim", 1.0, 0, True
    if len(s) * len(q) > MAX_CELLS:
        return "not_checked", 0.0, 0, False
    edits, end = window_edits(s, q)
    start = max(0, end - len(q) - edits)
    back, stop = window_edits(s[start:end][::-1], q[::-1])
    found = s[end - stop : end] if back == edits else s[start:end]
    head, tail = s[: end - len(found)], s[end:]
    found = (re.search(r"[\w']*$", head)[0] if found[:1].isalnum() else "") + found + (re.match(r"[\w']*", tail)[0] if found[-1:].isalnum() else "")
    similarity = 1 - edits / max(len(q), len(found), 1)
    critical = critical_tokens(found) == critical_tokens(q)
    near = similarity >= (NEAR_SHORT if len(q) < SHORT_CHARS else NEAR) and len(q.split()) >= NEAR_TOKENS
    return ("near_verbatim" if near and critical else "unverified"), round(similarity, 4), edits, critical


VERDICT = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("edits", T.IntegerType()), T.StructField("critical_ok", T.BooleanType()),
    T.StructField("coverage", T.DoubleType()),
])


@F.pandas_udf(VERDICT)
def quote_verdict(source: pd.Series, quote: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([match_quote(s, q) for s, q in zip(source, quote, strict=True)], columns=["status", "similarity", "edits", "critical_ok", "coverage"])


def verify_evidence(evidence: DataFrame, sources: DataFrame, on: list[str]) -> DataFrame:
    """Evidence rows with verified, quote_status, quote_sim, quote_coverage, quote_edits and quote_critical_ok.

    verified is exact or an elision in order; of kind "answer" nothing is checkable and all are null. Quotations that
    stand verbatim are told in the JVM; only the others go to the edit-distance matcher.
    """
    joined = evidence.join(sources.select(*on, F.col("text").alias("_source")), on, "left")
    checkable = F.col("kind") != "answer"
    told = joined.withColumn("_exact", F.when(checkable, F.coalesce(contains_quote(F.col("_source"), F.col("text")), F.lit(False))))
    rest = quote_verdict(F.coalesce("_source", F.lit("")), F.coalesce("text", F.lit("")))
    whole = F.struct(F.lit("verbatim").alias("status"), F.lit(1.0).alias("similarity"), F.lit(0).alias("edits"), F.lit(True).alias("critical_ok"), F.lit(1.0).alias("coverage"))
    none = F.lit(None).cast(told.select(whole.alias("w")).schema["w"].dataType)
    columns = [*joined.columns, "_exact"]
    checked = told.filter("_exact = false").select(*columns, rest.alias("_v")).unionByName(told.filter("_exact is null or _exact").select(*columns, F.when(F.col("_exact"), whole).otherwise(none).alias("_v")))
    return checked.select(
        *evidence.columns, F.when(F.col("_exact").isNotNull(), F.col("_v.status").isin("verbatim", "elided")).alias("verified"), F.col("_v.status").alias("quote_status"), F.col("_v.similarity").alias("quote_sim"),
        F.col("_v.coverage").alias("quote_coverage"), F.col("_v.edits").alias("quote_edits"), F.col("_v.critical_ok").alias("quote_critical_ok"),
    )


def find_passages(passages: DataFrame, docs: DataFrame, words: int = 8) -> DataFrame:
    """(item_id, doc_id) where a folded passage stands whole in a folded document.

    Both sides are cut into the first ``words`` words of the passage / every run of that many words of the document
    whose hash some passage opens with, and joined on the hash; the whole passage is compared afterwards. Passages
    with fewer words join on what they have.
    """
    fold = passages.select("item_id", squeeze(F.col("text")).alias("passage")).filter("passage != ''")
    opening = lambda c: F.xxhash64(F.array_join(F.slice(F.split(c, " "), 1, words), " "))
    keyed = fold.select("item_id", "passage", F.least(F.size(F.split("passage", " ")), F.lit(words)).alias("n"), opening("passage").alias("h"))
    text = docs.select("doc_id", squeeze(F.col("text")).alias("body"))
    sizes = [r[0] for r in keyed.select("n").distinct().collect()]  # at most ``words`` values
    shingles = text.withColumn("w", F.split("body", " "))

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))

    runs = F.array_distinct(F.flatten(F.array(*[runs_of(n) for n in sizes]))) if sizes else F.expr("cast(array() as array<bigint>)")
    # ids and hashes meet first; texts go to the pairs that met
    met = shingles.select("doc_id", F.explode_outer(runs).alias("h")).join(keyed.select("item_id", "h"), "h").select("item_id", "doc_id").distinct()
    hits = cut(met).join(fold, "item_id").join(text, "doc_id")
    return hits.filter(F.contains(F.concat(F.lit(" "), "body", F.lit(" ")), F.concat(F.lit(" "), "passage", F.lit(" ")))).select("item_id", "doc_id").distinct()


def resolve_pages(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """The page of a quotation: that of the blocks that hold it, if it is one page.

    A quotation stands between word boundaries, so a block that holds it has each of its words. Blocks and quotations
    of a document meet on the quotation's longest word; texts are compared where they met. A quotation without a word
    has no page. Evidence rows that repeat one another give one row.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(normalise_column(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    longest = F.array_max(F.transform(words(F.col("quote")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    rows = evidence.distinct().withColumn("_id", F.sha2(F.to_json(F.struct(*evidence.columns), {"ignoreNullFields": "false"}), 256))
    asked = rows.select(F.col("document").alias("_document"), "_id", "quote", F.xxhash64(longest["w"]).alias("_aw")).filter(longest.isNotNull())
    said = blocks.select("document", "block_id", F.explode(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("_w"))
    said = said.join(asked.select(F.col("_document").alias("document"), F.col("_aw").alias("_w")).distinct(), ["document", "_w"], "left_semi")
    met = said.join(asked, (F.col("document") == F.col("_document")) & (F.col("_w") == F.col("_aw"))).select("document", "block_id", "_id", "quote")
    held = met.join(blocks.select("document", "block_id", "text", "page"), ["document", "block_id"]).filter(contains_quote(F.col("text"), F.col("quote")))
    found = held.groupBy("_id").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    return rows.join(found, "_id", "left").select(*evidence.columns, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("page"))


# ---------------------------------------------------------------- numbers
def han_number(word: str) -> int | None:
    """一千二百三 as 1203 (digits, powers of ten, myriads), 二〇一九 as 2019."""
    if all(c in HAN for c in word):
        return int("".join(str(HAN[c]) for c in word))
    total = section = digit = 0
    for c in word:
        if c in HAN:
            digit = HAN[c]
        elif c in HAN_POWERS:
            section, digit = section + (digit or 1) * HAN_POWERS[c], 0
        elif c in HAN_MYRIADS:
            total, section, digit = total + (section + digit or 1) * HAN_MYRIADS[c], 0, 0
        else:
            return None
    return total + section + digit


def roman_number(word: str) -> int | None:
    """A numeral of two letters or more that is written the one right way."""
    total, before = 0, 0
    for c in reversed(word):
        v = ROMAN[c]
        total, before = (total - v if v < before else total + v), max(before, v)
    spelled, left = "", total
    for v, r in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        spelled, left = spelled + r * (left // v), left % v
    return total if spelled == word else None


def _foreign_table(language: str) -> dict[str, int]:
    """Words below a hundred, by rule: tens, and tens joined with units the way of the language."""
    units, tens = FOREIGN[language]
    table = {w.replace("ß", "ss"): i for i, w in enumerate(units.split())} | tens
    small = [w.replace("ß", "ss") for w in units.split()]
    if language == "de":
        table |= {f"{small[u]}und{t}": v + u for t, v in tens.items() for u in range(1, 10)} | {"eins": 1, "eine": 1, "einer": 1}
    elif language == "es":
        table |= {f"{t} y {small[u]}": v + u for t, v in tens.items() if v > 20 for u in range(1, 10)} | {f"veinti{w}": 20 + u for u, w in enumerate("uno dós trés cuatro cinco séis siete ocho nueve".split(), 1)}
    else:
        over = {"soixante": 60, "quatre-vingt": 80}
        table |= {f"{t}-{small[u]}": v + u for t, v in tens.items() if t != "quatre-vingts" for u in range(1, 20 if t in over else 10)}
        table |= {f"{t} et un": v + 1 for t, v in tens.items()} | {"soixante et onze": 71, "soixante-dix": 70, "quatre-vingt-dix": 90}
    return table


FOREIGN_WORDS = {language: _foreign_table(language) for language in FOREIGN}
_NAMES = {language: "|".join(sorted(map(re.escape, [*table, *FOREIGN_SCALE]), key=len, reverse=True)) for language, table in FOREIGN_WORDS.items()}
_RUNS = {language: (re.compile(rf"(?<![\w-])(?:{names})(?:(?:[ -]| et | y )?(?:{names}))*(?![\w-])"), re.compile(names)) for language, names in _NAMES.items()}


def foreign_numbers(text: str) -> list[float]:
    """Numbers in words of German, French or Spanish, and in Han numerals. A single word under a hundred counts
    by itself; with hundreds, thousands and millions it is multiplied and added as it is said."""
    out: list[float] = []
    for language, table in FOREIGN_WORDS.items():
        runs, name = _RUNS[language]
        for run in runs.finditer(text):
            words = name.findall(run[0])
            total = section = 0.0
            for w in words:
                scale = FOREIGN_SCALE.get(w)
                if scale is None:
                    section += table[w]
                elif scale == 100:
                    section = (section % 100 or 1) * 100 + (section - section % 100)
                else:
                    total, section = total + (section or 1) * scale, 0.0
            if not (len(words) == 1 and words[0] in ("un", "uno", "ein", "eine", "einer", "six", "million", "mil", "cent", "cents")):
                out.append(total + section)
    out += [n for w in re.findall(rf"[{''.join([*HAN, *HAN_POWERS, *HAN_MYRIADS])}]+", text) if (n := han_number(w)) is not None]
    return out


def quote_numbers(text: str) -> list[float]:
    """Values a sentence states: digits with separators and scale words, per cent, "1 in 5", fractions, number words
    of four languages, Han and (in capitals) Roman numerals."""
    written, text = text, normalise(text)
    out: list[float] = []
    taken = []
    for m in re.finditer(r"(\d+)\s+(?:in|of|out of)\s+(\d+)\b", text):
        if int(m[2]):
            out.append(int(m[1]) / int(m[2]))
    for m in re.finditer(r"(?<![\w.])(\d+)/(\d+)(?![\w/])", text):
        if int(m[2]):
            out.append(int(m[1]) / int(m[2]))
    for m in re.finditer(r"(?<![\w])([-+]?)(\d{1,3}(?:[, ]\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?)(e[-+]?\d+)?\s*(hundred|thousand|million|billion|trillion|k|m|bn|mn)?(?![a-z])\s*(%|per ?cent)?", text):
        body = m[2]
        grouped = re.fullmatch(r"\d{1,3}(?:[, ]\d{3})+(?:\.\d+)?", body)
        readings = {body.replace(",", "").replace(" ", "")} if grouped else {body.replace(",", ".")}
        if grouped and body.count(",") == 1 and "." not in body:
            readings.add(body.replace(",", "."))
        for r in readings:
            value = float(f"{m[1]}{r}{m[3] or ''}") * SCALE.get(m[4] or "", 1)
            out.append(value)
            if m[5]:
                out.append(value / 100)
        taken.append(m.span())
    total = current = None
    for w in [*re.findall(r"[a-z]+", text), ""]:
        if w in NUMBER_WORDS or w in TENS:
            current = (current or 0) + NUMBER_WORDS.get(w, TENS.get(w, 0))
        elif w == "hundred" and current is not None:
            current *= 100
        elif w in ("thousand", "million", "billion") and current is not None:
            total, current = (total or 0) + current * SCALE[w], 0
        elif w == "and" and current is not None:
            continue
        else:
            if current is not None or total is not None:
                out.append((total or 0) + (current or 0))
            total = current = None
    romans = re.findall(r"(?<![\w'])[IVXLCDM]{2,}(?![\w'])", written)
    return out + foreign_numbers(text) + [n for w in romans if (n := roman_number(w.lower())) is not None]


def value_among(value: float, text: str, tolerance: float = 1e-9) -> bool:
    return any(abs(value - x) <= tolerance * max(1.0, abs(value), abs(x)) for x in quote_numbers(text))


@F.pandas_udf(T.BooleanType())
def quote_backs_value(quote: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([bool(q) and v == v and value_among(float(v), q) for q, v in zip(quote, value, strict=True)])


# ---------------------------------------------------------------- citations
def cite_pattern(word: str) -> str:
    """One marker: the word, ids or ranges in a list, and a locator none of whose numbers is an id.

    The list gives nothing back (``*+``): no locator begins where an id could stand, and giving back takes a Java stack
    frame an id, which a list of thousands overflows.
    """
    plural = {"study": "stud(?:y|ies)"}.get(word, f"{word}s?")
    number = r"[0-9]+(?:\s*[-‐-―−]\s*[0-9]+)?"
    more = rf"(?:\s*(?:[,;&]|and)(?:\s*(?:and|&))?\s*(?:{plural}\s+)?{number})*+"
    locator = rf"(?:\s*[,;:]?\s*(?:pp?\.|pages?\b|paras?\.|paragraphs?\b|sec(?:tion)?s?\b\.?|lines?\b|§)(?:(?!{plural}\s+[0-9])[^\]])*)?"
    return rf"(?i)\[{plural}\s+({number}{more}){locator}\]"


def cited_ids(text: Column, word: str, longest: int = 1000, distinct: bool = True) -> Column:
    """Ids cited, in order; ranges expanded, one too long to be a citation as its two ends."""
    lists = F.regexp_extract_all(text, F.lit(cite_pattern(word)), F.lit(1))
    tokens = F.flatten(F.transform(lists, lambda t: F.regexp_extract_all(t, F.lit(r"[0-9]+(?:\s*[-‐-―−]\s*[0-9]+)?"), F.lit(0))))

    def ids(token: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
        ends = F.filter(ends, lambda x: x.isNotNull())
        low, high = F.array_min(ends), F.array_max(ends)
        return F.when(F.size(ends) == 0, F.expr("cast(array() as array<int>)")).when(high - low > longest, F.array(low, high)).otherwise(F.sequence(low, high))

    found = F.flatten(F.transform(tokens, ids))
    return F.array_distinct(found) if distinct else found


def unparsed_citations(text: Column, word: str) -> Column:
    """Brackets that open like a citation and do not read as one."""
    plural = {"study": "stud(?:y|ies)"}.get(word, f"{word}s?")
    loose = F.regexp_extract_all(text, F.lit(rf"(?i)\[{plural}\s[^\]\[]*\]"), F.lit(0))
    return F.array_distinct(F.filter(loose, lambda m: ~m.rlike(f"^{cite_pattern(word)}$".replace("^(?i)", "(?i)^"))))


def citation_check(answers: DataFrame, supplied: str, word: str = "chunk") -> DataFrame:
    """Add cited, unknown (cited but not supplied), unparsed and partial."""
    cited = cited_ids(F.col("answer"), word)
    out = answers.withColumn("cited", cited).withColumn("unknown", F.array_except("cited", supplied)).withColumn("unparsed", unparsed_citations(F.col("answer"), word))
    return out.withColumn("partial", (F.size("unknown") > 0) | (F.size("unparsed") > 0))
