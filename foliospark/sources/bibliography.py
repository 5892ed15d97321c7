"""Bibliographic exports: RIS, PubMed/MEDLINE and BibTeX files to records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.records import FIELDS, finish_records
from foliospark.sources.files import decode

#: Tags of the formats by field, in order of preference.
RIS_TAGS = {
    "type": ["TY"], "authors": ["AU", "A1"], "year": ["PY", "Y1", "DA"], "title": ["TI", "T1", "CT"], "venue": ["T2", "JO", "JF", "JA", "BT"],
    "volume": ["VL"], "issue": ["IS"], "pages": ["SP"], "end_page": ["EP"], "doi": ["DO"], "abstract": ["AB", "N2"], "keywords": ["KW"], "url": ["UR"],
    "file": ["L1"], "database": ["DB", "DP"], "accession": ["AN"],
}
MEDLINE_TAGS = {
    "type": ["PT"], "authors": ["FAU", "AU"], "year": ["DP"], "title": ["TI"], "venue": ["JT", "TA"], "volume": ["VI"], "issue": ["IP"],
    "pages": ["PG"], "doi": ["LID", "AID"], "abstract": ["AB"], "keywords": ["OT", "MH"], "accession": ["PMID"],
}
BIB_FIELDS = {"venue": ["journal", "booktitle"], "issue": ["number"], "authors": ["author"]}
JOINED = {"authors", "keywords"}
#: LaTeX accents by command, as combining marks.
LATEX_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327", "v": "\u030c", "=": "\u0304", ".": "\u0307", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328"}
LATEX_LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "i", "j": "j"}


def sniff(text: str) -> str | None:
    """ris, medline, bib or None, from the first sixty lines."""
    for line in text.splitlines()[:60]:
        if re.match(r"^\ufeff?TY {1,2}- ", line):
            return "ris"
        if re.match(r"^\ufeff?PMID *- ", line):
            return "medline"
        if re.match(r"^\s*@[A-Za-z]+\s*[{(]", line):
            return "bib"
    return None


def tagged_records(text: str, tag: str, start: str, end: str | None) -> list[dict[str, list[str]]]:
    """Records of a tagged format; a line that opens with no tag goes on the value before it."""
    records: list[dict[str, list[str]]] = []
    current: dict[str, list[str]] | None = None
    last = None
    for line in text.lstrip("\ufeff").splitlines():
        m = re.match(tag, line)
        if m:
            name, value = m[1].strip(), m[2].strip()
            if name == start:
                current = {}
                records.append(current)
            if name == end:
                current = last = None
            elif current is not None:
                current.setdefault(name, []).append(value)
                last = name
        elif current is not None and last and line.strip():
            current[last][-1] = f"{current[last][-1]} {line.strip()}".strip()
    return records


def _by_tags(record: dict[str, list[str]], tags: dict[str, list[str]]) -> dict[str, str]:
    out = {}
    for field, names in tags.items():
        values = next((record[n] for n in names if any(record.get(n, []))), [])
        if values:
            out[field] = "; ".join(v for v in values if v) if field in JOINED else values[0]
    return out


def parse_ris(text: str) -> list[dict[str, str]]:
    rows = [_by_tags(r, RIS_TAGS) for r in tagged_records(text, r"^([A-Z][A-Z0-9]) {1,2}-(?: (.*))?$".replace("(?: (.*))?", " ?(.*)"), "TY", "ER")]
    for row in rows:
        if end := row.pop("end_page", None):
            if row.get("pages") and "-" not in row["pages"]:
                row["pages"] += f"-{end}"
    return rows


def parse_medline(text: str) -> list[dict[str, str]]:
    records = tagged_records(text, r"^([A-Z]{2,4}) *- ?(.*)$", "PMID", None)
    rows = [_by_tags(r, MEDLINE_TAGS) for r in records]
    for row, r in zip(rows, records, strict=True):
        ids = [v for n in ("LID", "AID") for v in r.get(n, []) if v.endswith("[doi]")]
        row.pop("doi", None)
        if ids:
            row["doi"] = ids[0].removesuffix("[doi]").strip()
    return rows


def unlatex(text: str) -> str:
    """Accents and special letters of LaTeX as characters; braces and remaining commands dropped."""
    import unicodedata

    accent = "".join(re.escape(c) for c in LATEX_ACCENTS if not c.isalpha())
    letters = "".join(c for c in LATEX_ACCENTS if c.isalpha())
    text = re.sub(rf"\\([{accent}])\s*\{{?\\?([A-Za-z])\}}?", lambda m: m[2] + LATEX_ACCENTS[m[1]], text)
    text = re.sub(rf"\\([{letters}])\s*\{{([A-Za-z])\}}", lambda m: m[2] + LATEX_ACCENTS[m[1]], text)
    text = re.sub(r"\\([A-Za-z]+)(?:\{\}|\s+|(?![A-Za-z]))", lambda m: LATEX_LETTERS.get(m[1], ""), text)
    text = re.sub(r"\\([&%$#_{}])", r"\1", text).replace("---", "—").replace("--", "–").replace("~", " ")
    return unicodedata.normalize("NFC", re.sub(r"\s+", " ", text.replace("{", "").replace("}", ""))).strip()


def _bib_value(text: str, at: int, strings: dict[str, str]) -> tuple[str, int]:
    """Value from ``at``: braces, quotes or a name, joined by #; and where it ends."""
    out = []
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            break
        if text[at] in "{\"":
            closing, depth, start = ("}" if text[at] == "{" else '"'), 0, at + 1
            at += 1
            while at < len(text) and not (text[at] == closing and depth == 0):
                if text[at] == "\\":
                    at += 1
                elif text[at] == "{":
                    depth += 1
                elif text[at] == "}":
                    depth -= 1
                at += 1
            out.append(text[start:at])
            at += 1
        else:
            m = re.match(r"[^\s,#}]+", text[at:])
            if not m:
                break
            out.append(strings.get(m[0].lower(), m[0]))
            at += m.end()
        m = re.match(r"\s*#", text[at:])
        if not m:
            break
        at += m.end()
    return "".join(out), at


def parse_bib(text: str) -> list[dict[str, str]]:
    rows, strings, at = [], {}, 0
    entry = re.compile(r"@([A-Za-z]+)\s*[{(]\s*")
    while m := entry.search(text, at):
        kind, at = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        fields: dict[str, str] = {}
        if kind != "string" and (key := re.match(r"[^,{}]*,", text[at:])):
            at += key.end()
        while f := re.match(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*", text[at:]):
            value, at = _bib_value(text, at + f.end(), strings)
            fields[f[1].lower()] = value
        if kind == "string":
            strings |= fields
            continue
        row = {"type": kind}
        for name in FIELDS:
            for source in BIB_FIELDS.get(name, [name]):
                if source in fields:
                    row[name] = unlatex(fields[source])
                    break
        if "authors" in row:
            row["authors"] = "; ".join(re.split(r"\s+and\s+", row["authors"]))
        rows.append(row)
    return rows


PARSERS = {"ris": parse_ris, "medline": parse_medline, "bib": parse_bib}


def parse_export(text: str) -> list[dict[str, str]]:
    kind = sniff(text)
    return PARSERS[kind](text) if kind else []


def parse_exports(files: DataFrame) -> DataFrame:
    """files(path, content as text or bytes) to finished records; ids follow the order of path and place in the file."""
    columns = [f for f in FIELDS if f != "source_file"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [decode(bytes(c)) if isinstance(c, (bytes, bytearray)) else c or "" for c in pdf.content]
            rows = [(p, k, *[r.get(c) for c in columns]) for p, text in zip(pdf.path, texts, strict=True) for k, r in enumerate(parse_export(text))]
            yield pd.DataFrame(rows, columns=["source_file", "place", *columns])

    parsed = files.select("path", "content").mapInPandas(run, "source_file string, place int, " + ", ".join(f"{c} string" for c in columns))
    return finish_records(parsed.withColumn("record_id", F.xxhash64("source_file", "place")))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Every export file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{ris,nbib,bib,txt}").load(path)
    return parse_exports(files.select("path", "content"))
