"""Claims, gaps, outlines, study weights, bibliography keys, figures, revision guards."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import text_or_empty
from foliospark.operators.rank import global_rank

#: Word stems that hedge, that boost, and words that generalise.
HEDGES = [
    "may", "might", "could", "suggest", "appear", "seem", "indicat", "tend", "possibl", "potential", "prelimin", "tentativ", "unclear", "uncertain",
    "limited evidence", "some evidence", "mixed evidence", "small", "few", "single study", "one study", "two studies", "cannot", "not clear", "no firm",
    "caution", "unproven", "unproved", "inconclusiv", "insufficient", "not significant", "no significant", "remains limited", "further research", "further work",
]
BOOSTERS = ["demonstrat", "prove", "establish", "confirm", "conclusiv", "definitiv", "robustly", "unequivocal", "clearly show", "clear evidence", "strong evidence", "shows that", "show that", "well established"]
UNIVERSALS = ["all", "every", "always", "never", "none", "no studies", "consistently", "invariably", "universally", "without exception"]


# ---------------------------------------------------------------- claims
def verify_claims(claims: DataFrame, support: DataFrame, studies: DataFrame, moderators: list[str]) -> tuple[DataFrame, DataFrame]:
    """(claims, support) after the checks: unknown studies dropped, a study that contradicts a claim needs not support
    it, claims without support dropped, unknown moderators cleared. n_support and n_contradict are counted anew."""
    known = support.distinct().join(studies.select("study").distinct(), "study", "left_semi")
    both = known.groupBy("claim_id", "study").agg(F.max(F.col("role") == "support").alias("s"))
    checked = both.select("claim_id", "study", F.when(F.col("s"), "support").otherwise("contradict").alias("role"))
    counts = checked.groupBy("claim_id").agg(
        F.sum(F.when(F.col("role") == "support", 1).otherwise(0)).alias("n_support"), F.sum(F.when(F.col("role") == "contradict", 1).otherwise(0)).alias("n_contradict"),
    ).filter("n_support > 0")
    kept = claims.drop("n_support", "n_contradict").join(counts, "claim_id")
    kept = kept.withColumn("moderator", F.when(F.col("moderator").isin(*moderators), F.col("moderator")) if moderators else F.lit(None).cast("string"))
    return kept, checked.join(kept.select("claim_id"), "claim_id", "left_semi")


def moderator_splits(support: DataFrame, values: DataFrame, numeric: bool) -> DataFrame:
    """(claim_id, splits): whether a moderator separates the studies of the two roles.

    values(study, value). Numbers: the ranges are disjoint; words: no value is shared; a side without values: no.
    """
    joined = support.join(values, "study").filter(F.col("value").isNotNull())
    of = lambda role, c: F.when(F.col("role") == role, c)
    if numeric:
        v = F.col("value").cast("double")
        sides = joined.groupBy("claim_id").agg(*[f(of(r, v)).alias(f"{n}_{r}") for r in ("support", "contradict") for n, f in (("lo", F.min), ("hi", F.max))])
        apart = (F.col("hi_support") < F.col("lo_contradict")) | (F.col("hi_contradict") < F.col("lo_support"))
    else:
        sides = joined.groupBy("claim_id").agg(*[F.collect_set(of(r, F.lower(F.trim("value")))).alias(r) for r in ("support", "contradict")])
        apart = (F.size("support") > 0) & (F.size("contradict") > 0) & ~F.arrays_overlap("support", "contradict")
    return support.select("claim_id").distinct().join(sides.select("claim_id", apart.alias("splits")), "claim_id", "left").select("claim_id", F.coalesce("splits", F.lit(False)).alias("splits"))


# ---------------------------------------------------------------- gaps
def field_gaps(studies: DataFrame, fields: list[str], declared: dict[str, list[str]]) -> DataFrame:
    """(kind, subject, detail) of what a table of studies leaves open, field by field, from one pass of aggregates."""
    spark = studies.sparkSession
    long = studies.select("study", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("study", "x.*")
    stats = long.groupBy("field").agg(F.count_distinct("value").alias("distinct"), F.count("value").alias("reported"), F.count(F.lit(1)).alias("n"))
    flat = stats.filter((F.col("reported") > 1) & (F.col("distinct") == 1)).select(F.lit("no variation").alias("kind"), F.col("field").alias("subject"), F.lit("").alias("detail"))
    silent = stats.filter(1 - F.col("reported") / F.col("n") > 0.5).select(F.lit("mostly not reported").alias("kind"), F.col("field").alias("subject"), F.lit("").alias("detail"))
    rows = [(f, v) for f, vs in declared.items() for v in vs]
    out = flat.unionByName(silent)
    if rows:
        menu = spark.createDataFrame(rows, "field string, value string")
        unseen = menu.join(long.select("field", "value").distinct(), ["field", "value"], "left_anti")
        out = out.unionByName(unseen.select(F.lit("declared but unstudied").alias("kind"), F.col("field").alias("subject"), F.col("value").alias("detail")))
    return out


def combination_gaps(studies: DataFrame, a: str, b: str, values_a: list[str], values_b: list[str], most: int = 40) -> DataFrame:
    """Pairs of declared values that no study joins, in the order of the declarations; the first ``most`` of them
    are listed, as a report has them, and None lists all."""
    spark = studies.sparkSession
    side = lambda values, name: spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"{name}_no int, {name} string")
    grid = side(values_a, "x").crossJoin(side(values_b, "y"))  # declared values, a few dozen a side
    seen = studies.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).distinct()
    open_ = grid.join(seen, ["x", "y"], "left_anti")
    open_ = open_.orderBy("x_no", "y_no").limit(most) if most is not None else open_
    return open_.select(F.lit("combination unstudied").alias("kind"), F.lit(f"{a} x {b}").alias("subject"), F.concat_ws(" / ", "x", "y").alias("detail"))


def claim_gaps(claims: DataFrame) -> DataFrame:
    """(kind, claim_id): unreplicated, disagreement unexplained, stated as a gap."""
    kinds = F.filter(F.array(
        F.when((F.col("n_support") == 1) & (F.col("n_contradict") == 0), "unreplicated"),
        F.when((F.col("n_contradict") > 0) & F.col("moderator").isNull(), "disagreement unexplained"),
        F.when(F.col("kind") == "gap", "stated as a gap"),
    ), lambda k: k.isNotNull())
    return claims.select(F.explode(kinds).alias("gap"), "claim_id").withColumnRenamed("gap", "kind")


# ---------------------------------------------------------------- outline
def place_claims(outline: DataFrame, claims: DataFrame) -> DataFrame:
    """(section_no, claim_id): each claim once, in its first section; gap claims and unplaced ones in section 0, the
    closing. outline(section_no, claim_id)."""
    first = outline.join(claims.filter("kind != 'gap'").select("claim_id"), "claim_id", "left_semi").groupBy("claim_id").agg(F.min("section_no").alias("section_no"))
    return claims.select("claim_id").join(first, "claim_id", "left").select(F.coalesce("section_no", F.lit(0)).alias("section_no"), "claim_id")


def outline_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs of claims that one outline joins and the other parts, over all pairs.

    Counted from section sizes and their overlaps, not from pairs: P(A) + P(B) - 2 P(A and B) over C(n, 2). A claim
    that an outline does not place is a section of its own. a, b: (section, claim_id).
    """
    one = a.groupBy("claim_id").agg(F.min("section").alias("sa"))
    two = b.groupBy("claim_id").agg(F.min("section").alias("sb"))
    both = one.join(two, "claim_id", "full").select(
        "claim_id", F.coalesce(F.concat(F.lit("s"), F.col("sa").cast("string")), F.concat(F.lit("u"), F.col("claim_id").cast("string"))).alias("sa"),
        F.coalesce(F.concat(F.lit("s"), F.col("sb").cast("string")), F.concat(F.lit("u"), F.col("claim_id").cast("string"))).alias("sb"),
    )
    cells = both.groupBy("sa", "sb").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda df: df.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("p"))
    pa = pairs(cells.groupBy("sa").agg(F.sum("n").alias("n"))).select(F.col("p").alias("pa"))
    pb = pairs(cells.groupBy("sb").agg(F.sum("n").alias("n"))).select(F.col("p").alias("pb"))
    joint = cells.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("pab"), F.sum("n").alias("n"))
    total = F.col("n") * (F.col("n") - 1) / 2
    one_row = joint.crossJoin(F.broadcast(pa)).crossJoin(F.broadcast(pb))  # three one-row frames
    return one_row.select(F.when(total > 0, (F.col("pa") + F.col("pb") - 2 * F.col("pab")) / total).otherwise(0.0).alias("distance"))


# ---------------------------------------------------------------- weights, order
def study_weight(studies: DataFrame, size: str, filled: str, unverified: str) -> DataFrame:
    """Add ``weight`` = 0.5 + 0.5 s + 0.5 v: s is log1p(size) over the greatest, its mean where size is missing;
    v the share of filled fields that are verified, 0.5 where nothing is filled."""
    s = F.when(F.col(size) >= 0, F.log1p(F.col(size).cast("double")))
    stats = studies.agg(F.max(s).alias("_top"), F.avg(s).alias("_mean"))
    joined = studies.crossJoin(F.broadcast(stats))  # one row
    scaled = F.when(F.col("_top") > 0, F.coalesce(s, F.col("_mean")) / F.col("_top")).otherwise(0.0)
    v = F.when(F.col(filled) > 0, F.greatest(F.col(filled) - F.col(unverified), F.lit(0)) / F.col(filled)).otherwise(0.5)
    return joined.withColumn("weight", 0.5 + 0.5 * F.coalesce(scaled, F.lit(0.0)) + 0.5 * v).drop("_top", "_mean")


def claim_order(support: DataFrame, weights: DataFrame) -> DataFrame:
    """(claim_id, breadth, mass, position): widest support first, then heaviest, then the smaller id."""
    joined = support.filter("role = 'support'").join(weights.select("study", "weight"), "study")
    sums = joined.groupBy("claim_id").agg(F.count_distinct("study").alias("breadth"), F.round(F.sum("weight"), 9).alias("mass"))
    return global_rank(sums, "position", F.desc("breadth"), F.desc("mass"), "claim_id").withColumn("position", F.col("position").cast("int"))


# ---------------------------------------------------------------- bibliography
def letters(n: Column) -> Column:
    """1 a, 2 b, ..., 26 z, 27 aa, ..., 702 zz; then the first sign goes on through the characters behind z, {a, {b, ...,
    so no two numbers share one."""
    sign = lambda code: F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")
    return F.when(n <= 26, sign(n + 96)).otherwise(F.concat(sign(F.floor((n - 1) / 26) + 96), sign(F.pmod(n - 1, F.lit(26)) + 97)))


def author_year(authors: Column, year: Column, joiner: str = "&") -> Column:
    """"A, 2019", "A & B, 2019", "A et al., 2019"; null without author or year. authors: "Family, G; Family, G"."""
    people = F.filter(F.transform(F.split(text_or_empty(authors), ";"), lambda a: F.trim(F.regexp_extract(a, r"^([^,]*)", 1))), lambda a: a != "")
    who = (
        F.when(F.size(people) == 1, people[0])
        .when(F.size(people) == 2, F.concat(people[0], F.lit(f" {joiner} "), people[1]))
        .when(F.size(people) > 2, F.concat(people[0], F.lit(" et al.")))
    )
    return F.when(F.trim(text_or_empty(year)) != "", F.concat(who, F.lit(", "), F.trim(year)))


def lettered_keys(rows: DataFrame, key: str, title: str, tie: str) -> DataFrame:
    """Add ``cite``: equal keys get a, b, ... in title order after the year."""
    w = Window.partitionBy(key)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(F.lower(title), tie))
    return rows.withColumns({"_n": n, "_k": k}).withColumn("cite", F.when(F.col("_n") > 1, F.concat(key, letters(F.col("_k")))).otherwise(F.col(key))).drop("_n", "_k")


def reference_list(rows: DataFrame, author: Column, year: Column, title: Column, key: str) -> DataFrame:
    """(n, key, entry): "Author. (Year). Title." in author, year and title order, numbered from 1; parts that are
    missing are left out."""
    part = lambda c, form: F.when(F.trim(text_or_empty(c)) != "", form)
    dotted = lambda c: F.concat(F.regexp_replace(F.trim(c), r"\.$", ""), F.lit("."))
    entry = F.concat_ws(" ", part(author, dotted(author)), part(year, F.concat(F.lit("("), F.trim(year), F.lit(")."))), part(title, dotted(title)))
    listed = rows.select(key, entry.alias("entry"), F.lower(text_or_empty(author)).alias("_a"), text_or_empty(year).alias("_y"), F.lower(text_or_empty(title)).alias("_t"))
    return global_rank(listed, "n", "_a", "_y", "_t", key).select(F.col("n").cast("int").alias("n"), key, "entry")


def render_citations(text: str, keys: dict[int, str], word: str = "study", style: str = "author-year") -> str:
    """Adjacent markers merged, distinct keys sorted; an id without a key stays as it was written."""
    from foliospark.operators.verify import cite_pattern

    one = cite_pattern(word).removeprefix("(?i)")
    order = {i: n for n, i in enumerate(sorted(keys), 1)}

    def swap(m: re.Match) -> str:
        ids = sorted({int(x) for x in re.findall(r"[0-9]+", m[0])})
        if any(i not in keys for i in ids) or re.search(r"[0-9]\s*[-–]\s*[0-9]", m[0]):
            return m[0]
        if style == "numeric":
            return "[" + ", ".join(str(order[i]) for i in ids) + "]"
        return "(" + "; ".join(sorted({keys[i] for i in ids})) + ")"

    return re.sub(rf"(?i)(?:{one}\s*)*{one}", swap, text)


# ---------------------------------------------------------------- figures
#: Fixed value: a number as prose writes it, with qualifier, scale word and per cent.
FIGURE = re.compile(
    r"(?:\b(about|around|approximately|roughly|nearly|almost|over|more than|above|under|less than|below|fewer than)\s+)?"
    r"(?<![\w.,])([-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d+(?:\.\d+)?)(?:\s*(thousand|million|billion|trillion))?\s*(%|per ?cent|percent)?(?![\w])", re.I,
)
_SCALES = {"": 1, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}


def figures_in(sentence: str) -> list[tuple[str, float, float, str]]:
    """(as written, value, half a unit of the last place written, qualifier kind) of each number outside citations."""
    bare = re.sub(r"\[[^\]]*\]", " ", sentence)
    out = []
    for m in FIGURE.finditer(bare):
        digits = m[2].replace(",", "")
        scale = _SCALES[(m[3] or "").lower()]
        places = len(digits.split(".")[1]) if "." in digits else 0
        word = (m[1] or "").lower()
        kind = "over" if word in ("over", "more than", "above") else "under" if word in ("under", "less than", "below", "fewer than") else "about" if word else "exact"
        out.append((m[0].strip(), float(digits) * scale, 0.5 * 10.0**-places * scale, kind))
    return out


def figure_backed(value: float, tolerance: float, kind: str, targets: list[tuple[str, float]]) -> str | None:
    """Basis of the first target that backs a figure: equal within its last place, or within its qualifier's reach."""
    for basis, x in targets:
        if abs(value - x) <= tolerance + 1e-9 * max(1, abs(x)):
            return basis
    for basis, x in targets:
        reach = {"about": (0.9 * value, 1.1 * value), "over": (value, 1.25 * value), "under": (0.75 * value, value)}.get(kind)
        if reach and min(reach) <= x <= max(reach):
            return f"{basis} (approximate)"
    return None


def check_figures(sentences: DataFrame, targets: DataFrame) -> DataFrame:
    """(sentence_id, number, value, backed, basis) of sentences(sentence_id, text) against targets(sentence_id, basis, value):
    cited rows first, then their totals, then differences of two of a sentence's own figures."""
    grouped = targets.groupBy("sentence_id").agg(F.collect_list(F.struct("basis", "value")).alias("targets"))

    def run(parts):
        for pdf in parts:
            rows = []
            for sid, text, known in zip(pdf.sentence_id, pdf.text, pdf.targets, strict=True):
                pool = sorted((t["basis"], float(t["value"])) for t in (known if known is not None else []))
                found = figures_in(text or "")
                for written, value, tol, kind in found:
                    others = [x for w, x, _, _ in found if w != written]
                    worked = [("difference", abs(a - b)) for k, a in enumerate(others) for b in others[k + 1 :]]
                    basis = figure_backed(value, tol, kind, pool) or figure_backed(value, tol, kind, worked)
                    if basis is None and 1900 <= value <= 2100 and value == int(value):
                        basis = "year"
                    rows.append((sid, written, value, basis is not None, basis))
            yield pd.DataFrame(rows, columns=["sentence_id", "number", "value", "backed", "basis"])

    joined = sentences.join(grouped, "sentence_id", "left").select("sentence_id", "text", "targets")
    return joined.mapInPandas(run, "sentence_id bigint, number string, value double, backed boolean, basis string")


# ---------------------------------------------------------------- guards
def count_stems(text: Column, stems: list[str], whole: bool = False) -> Column:
    """Occurrences of stems at a word's start, or of whole words."""
    pattern = r"\b(?:" + "|".join(re.escape(s) for s in stems) + ")" + (r"\b" if whole else "")
    return F.size(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(pattern), F.lit(0)))


def strength(df: DataFrame, text: str) -> DataFrame:
    """Add hedges, boosters and universals."""
    c = F.col(text)
    return df.withColumns({"hedges": count_stems(c, HEDGES), "boosters": count_stems(c, BOOSTERS), "universals": count_stems(c, UNIVERSALS, True)})


def strength_guard(pairs: DataFrame) -> DataFrame:
    """Add ``holds`` to pairs(before, after): no new booster or universal, hedges at least in proportion to length."""
    out = strength(pairs, "before").withColumnsRenamed({k: f"{k}_before" for k in ("hedges", "boosters", "universals")})
    out = strength(out, "after").withColumnsRenamed({k: f"{k}_after" for k in ("hedges", "boosters", "universals")})
    share = F.least(F.lit(1.0), F.length("after") / F.greatest(F.length("before"), F.lit(1)))
    return out.withColumn(
        "holds",
        (F.col("boosters_after") <= F.col("boosters_before")) & (F.col("universals_after") <= F.col("universals_before"))
        & (F.col("hedges_after") >= F.floor(F.col("hedges_before") * share)),
    )
