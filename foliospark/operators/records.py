"""Bibliographic records: finishing, dedupe by DOI and by title, coalescing, file matching, PRISMA counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.keys import blank_to_null, doi_key, fold_latin, title_key, year_of
from foliospark.session import cut

FIELDS = "type authors year title venue volume issue pages doi abstract keywords url file database accession source_file".split()
#: A title key shorter than this names no work.
MIN_TITLE = 12


def finish_records(records: DataFrame) -> DataFrame:
    """Every field of FIELDS trimmed, blank as null, year and DOI in canonical form."""
    have = set(records.columns)
    columns = {f: blank_to_null(F.col(f).cast("string")) if f in have else F.lit(None).cast("string") for f in FIELDS}
    out = records.select("record_id", *[c.alias(f) for f, c in columns.items()])
    return out.withColumns({"year": year_of(F.col("year")), "doi": doi_key(F.col("doi"))})


def dedupe_by_doi(records: DataFrame) -> DataFrame:
    """Add ``duplicate_of``: the first record with the same DOI, null for that one and for records without.

    The first of each DOI is found with a partial aggregate and joined back, so a DOI that very many rows hold
    is a skewed join key and no window gathers it.
    """
    first = records.filter(F.col("doi").isNotNull()).groupBy("doi").agg(F.min("record_id").alias("first"))
    joined = records.join(first, "doi", "left")
    return joined.select(*records.columns, F.when(F.col("first") < F.col("record_id"), F.col("first")).alias("duplicate_of"))


#: Parts of family names, and words that tell a corporate author.
PARTICLES = set("van von der den de del della di da dos du la le ten ter bin ibn al el".split())
CORPORATE = set("group consortium collaboration committee council commission organisation organization association society institute ministry department agency investigators network team bank".split())


def _first_author(authors: str | None) -> tuple[str, str, bool]:
    """(folded family name, folded given names, corporate) of the first author: "Name, First", "Name FM" or "First Name"."""
    if not authors:
        return "", "", False
    first = authors.split(";")[0].split(" and ")[0].strip()
    keep = lambda s: "".join(c for c in s.lower() if c.isalnum())
    if CORPORATE & {keep(w) for w in first.split()}:
        return keep(first), "", True
    if "," in first:
        family, given = (p.strip() for p in first.split(",", 1))
    else:
        words = first.split()
        if len(words) > 1 and words[-1].isupper() and len(words[-1]) <= 3:
            family, given = " ".join(words[:-1]), words[-1]
        else:
            at = next((k for k in range(1, len(words)) if words[k].lower() in PARTICLES), len(words) - 1)
            family, given = " ".join(words[at:]), " ".join(words[:at])
    bare = [w for w in family.split() if w.lower() not in PARTICLES] or family.split()
    return keep("".join(bare)), keep(given), False


def _authors_agree(a: tuple[str, str, bool], b: tuple[str, str, bool]) -> bool:
    """The same family name and initial, or family and given names the other way round; corporate authors as written."""
    (family, given, corporate), (family2, given2, corporate2) = a, b
    if corporate or corporate2:
        return family == family2
    swapped = bool(given and given2) and family == given2 and given == family2
    return swapped or (family == family2 and (not given or not given2 or given[0] == given2[0]))


def _venues_agree(a: str | None, b: str | None) -> bool:
    """Equal, contained, abbreviated word by word, or one the other's initials; a missing venue agrees."""
    if not a or not b:
        return True
    skip = {"of", "the", "and", "for", "in", "on", "a"}
    words = lambda s: [w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() if w not in skip]
    x, y = words(a), words(b)
    if not x or not y or x == y or set(x) <= set(y) or set(y) <= set(x):
        return True
    if len(x) == len(y) and all(p.startswith(q) or q.startswith(p) for p, q in zip(x, y, strict=True)):
        return True
    initials = lambda ws: "".join(w[0] for w in ws)
    return "".join(x) == initials(y) or "".join(y) == initials(x)


def _same_work(a: dict, b: dict) -> bool:
    """Authors and venues agree; where both have a DOI it is one, and where one has, both have authors."""
    if a["doi"] and b["doi"] and a["doi"] != b["doi"]:
        return False
    one, two = _first_author(a["authors"]), _first_author(b["authors"])
    if one[0] and two[0]:
        if not _authors_agree(one, two):
            return False
    elif a["doi"] or b["doi"]:
        return False
    return _venues_agree(a["venue"], b["venue"])


def dedupe_by_title(records: DataFrame) -> DataFrame:
    """(record_id, duplicate_of) by title key and year inside blocks of one key and year.

    A record joins a group only if it fits every member and exactly one group does; the order of ids decides.
    Keys under MIN_TITLE characters and records without a year never match. Records that agree in all compared
    fields are folded before the blocks are formed, so copies do not pile up in one task. The rule goes record by
    record, so a block is one task; groups are looked up by author, so its time follows the records and not their pairs.
    """
    keyed = records.select("record_id", "authors", "venue", "doi", "year", title_key(F.col("title")).alias("key"))
    keyed = keyed.filter((F.length("key") >= MIN_TITLE) & F.col("year").isNotNull())
    same = ["key", "year", "authors", "venue", "doi"]
    folded = keyed.groupBy(*same).agg(F.min("record_id").alias("first"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("first").to_dict("records")
        rows = [{k: (None if pd.isna(v) else v) for k, v in r.items()} for r in rows]
        groups: list[list[dict]] = []
        by_name: dict[str, list[int]] = {}
        out = []
        for r in rows:
            family, given, _ = _first_author(r["authors"])
            # groups that hold this name, or given names as a family name, or a record without an author
            near = sorted({g for n in {family, given, ""} for g in by_name.get(n, ())}) if family else range(len(groups))
            fits = [g for g in near if all(_same_work(r, m) for m in groups[g])]
            at = fits[0] if len(fits) == 1 else len(groups)
            if at == len(groups):
                groups.append([])
            groups[at].append(r)
            if at not in by_name.setdefault(family, []):
                by_name[family].append(at)
            out.append((r["first"], groups[at][0]["first"]))
        return pd.DataFrame(out, columns=["first", "root"])

    # a record alone in its block is its own root; only blocks of two or more go to Python
    sized = folded.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "year")))
    alone = sized.filter("n = 1").select("first", F.col("first").alias("root"))
    several = sized.filter("n > 1").drop("n").groupBy("key", "year").applyInPandas(block, "first bigint, root bigint")
    roots = alone.select(F.col("first").cast("bigint"), F.col("root").cast("bigint")).unionByName(several)
    null_safe = keyed.join(folded.withColumnsRenamed({c: f"_{c}" for c in same}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    placed = null_safe.select("record_id", "first").join(roots, "first")
    return placed.select("record_id", F.when(F.col("root") != F.col("record_id"), F.col("root")).alias("duplicate_of"))


def merge_fields(records: DataFrame, root: str = "root") -> DataFrame:
    """One row a root: each field the first that is not null, in order of record_id."""
    fields = [c for c in records.columns if c not in ("record_id", root)]
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("record_id"))).alias(c) for c in fields]
    return records.groupBy(root).agg(*firsts).withColumnRenamed(root, "record_id")


def unique_matches(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left side and right side each occur in no other pair."""
    only = pairs.distinct()
    left_ok = only.groupBy(left).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(left)
    right_ok = only.groupBy(right).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(right)
    return only.join(left_ok, left, "left_semi").join(right_ok, right, "left_semi")


def match_files(records: DataFrame, files: DataFrame, prefix: int = 24, rounds: int = 10) -> DataFrame:
    """(record_id, path, route): file name, DOI in the stem, title prefix, then surname and year.

    records(record_id, file, doi, title, authors, year), files(path). Each route runs to a fixpoint over what is
    unmatched; where a record or a file has several candidates there is no match.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    squash = lambda c: F.regexp_replace(fold_latin(F.lower(c)), r"[^\p{L}\p{N}]+", "")
    file_keys = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), squash(stem).alias("stem"))
    family = F.regexp_extract(F.col("authors"), r"^\s*([^,;]+)", 1)
    record_keys = records.select(
        "record_id", F.element_at(F.split("file", "/"), -1).alias("name"),
        squash(F.regexp_replace(F.col("doi"), r"^[^/]*/", "")).alias("doi_tail"),
        F.left(title_key(F.col("title")), F.lit(prefix)).alias("title_head"),
        F.concat(squash(family), F.col("year")).alias("author_year"),
    )
    routes = [
        ("file", lambda r, f: r.join(f, "name")),
        ("doi", lambda r, f: r.filter(F.length("doi_tail") >= 4).join(f, F.col("doi_tail") == F.col("stem"))),
        ("title", lambda r, f: r.filter(F.length("title_head") >= MIN_TITLE).join(f.withColumn("head", F.left("stem", F.lit(prefix))), F.col("title_head") == F.col("head"))),
        ("author_year", lambda r, f: r.filter(F.col("author_year").isNotNull()).join(f.withColumn("head", F.regexp_extract("stem", r"^(.*?[0-9]{4})", 1)), F.col("author_year") == F.col("head"))),
    ]
    found = None
    left_records, left_files = record_keys, file_keys
    for route, pair in routes:
        for _ in range(rounds):
            new = cut(unique_matches(pair(left_records, left_files).select("record_id", "path"), "record_id", "path").withColumn("route", F.lit(route)))
            if not new.limit(1).count():
                break
            found = new if found is None else found.unionByName(new)
            left_records = left_records.join(new, "record_id", "left_anti")
            left_files = left_files.join(new, "path", "left_anti")
    return found if found is not None else record_keys.select("record_id", F.lit("").alias("path"), F.lit("").alias("route")).limit(0)


def attach_fields(rows: DataFrame, records: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Record fields beside rows that have one."""
    return rows.join(records.select(on, *fields), on, "left")


def prisma_counts(records: DataFrame) -> DataFrame:
    """One row: identified, duplicates, screened, sought, retrieved, not_retrieved."""
    kept = F.col("duplicate_of").isNull()
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    got = F.coalesce(F.col("retrieved"), F.lit(False))
    return records.agg(
        F.count(F.lit(1)).alias("identified"), n(~kept).alias("duplicates"), n(kept).alias("screened"), n(kept).alias("sought"),
        n(kept & got).alias("retrieved"), n(kept & ~got).alias("not_retrieved"),
    )
