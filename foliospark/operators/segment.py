"""Segmenters: blocks in, token-capped chunks out.

Every segmenter takes blocks(document, block_id, text[, page, section]) and returns
chunks(document, chunk_id, text, tokens, chars, page, section, block_id). page, section and block_id are kept
where a chunk has one value of them and are null where it spans several.

With the additive ``words`` tokenizer packing is a fold over an array inside the row of a document, all in the JVM.
With any other tokenizer the joined text is counted again at each step, in Arrow batches per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import count_words, has_content, sentences_of, truncate_words, words_of
from foliospark.functions.tokens import count_tokens, estimate_tokens, estimated_within

CHUNKS = "document string, chunk_id int, text string, tokens int, chars int, page int, section string, block_id int"


@dataclass(frozen=True)
class SegmentSpec:
    """Limits of a segmenter, clamped the way the packer expects them."""

    method: str = "paragraph"
    max_tokens: int = 1200
    overlap: int = 0
    min_tokens: int = 0
    tokenizer: str = "words"
    source: str | None = None

    def clamped(self) -> SegmentSpec:
        cap = min(max(self.max_tokens, 32), 1_000_000)
        return replace(self, max_tokens=cap, overlap=min(max(self.overlap, 0), cap - 1), min_tokens=min(max(self.min_tokens, 0), cap))


SEGMENTERS: dict[str, Callable[[DataFrame, SegmentSpec], DataFrame]] = {}


def register_segmenter(name: str):
    """Add a segmenter(blocks, spec) -> chunks; the latest registration wins."""

    def add(run):
        SEGMENTERS[name] = run
        return run

    return add


def segment(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Run the spec's segmenter over blocks with visible content."""
    spec = spec.clamped()
    if spec.method not in SEGMENTERS:
        raise KeyError(f"no segmenter {spec.method!r}; there are {', '.join(SEGMENTERS)}")
    return SEGMENTERS[spec.method](_shaped(blocks), spec)


def _shaped(blocks: DataFrame) -> DataFrame:
    for name, kind in (("page", "int"), ("section", "string")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    blocks = blocks.select(
        F.col("document").cast("string").alias("document"), F.col("block_id").cast("int").alias("block_id"), "text",
        F.col("page").cast("int").alias("page"), F.col("section").cast("string").alias("section"),
    )
    return blocks.filter(has_content(F.col("text")))


def _one(column: str) -> Column:
    return F.expr(f"if(size(array_distinct(transform(u, x -> struct(x.{column})))) = 1, u[0].{column}, null)")


def pack_units(units: DataFrame, cap: int, joiner: str = "\n\n") -> DataFrame:
    """Greedy packing of units(document, ord, text, n, page, section, block_id) under an additive count ``n``.

    A new chunk begins where the running count would pass ``cap``. The fold keeps (chunk number, running count)
    and gives each unit its chunk, so a document's text is never copied while it runs.
    """
    folded = units.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("ord", "n", "text", "page", "section", "block_id"))).alias("us"))
    ends = F.expr(
        "aggregate(us, named_struct('c', 0, 't', 0, 'o', cast(array() as array<int>)),"
        f" (s, x) -> if(s.c > 0 and s.t + x.n <= {cap}, named_struct('c', s.c, 't', s.t + x.n, 'o', concat(s.o, array(s.c))),"
        "  named_struct('c', s.c + 1, 't', x.n, 'o', concat(s.o, array(s.c + 1)))), s -> s.o)"
    )
    placed = folded.withColumn("chunk_of", ends).select("document", F.explode(F.arrays_zip("us", "chunk_of")).alias("z"))
    rows = placed.select("document", F.col("z.chunk_of").alias("chunk_id"), "z.us.*")
    grouped = rows.groupBy("document", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "page", "section", "block_id"))).alias("u"), F.sum("n").cast("int").alias("tokens"))
    body = F.array_join(F.transform("u", lambda x: x["text"]), joiner)
    return grouped.select(
        "document", "chunk_id", body.alias("text"), "tokens", F.length(body).alias("chars"),
        _one("page").alias("page"), _one("section").alias("section"), _one("block_id").alias("block_id"),
    )


def split_oversize(units: DataFrame, cap: int) -> DataFrame:
    """Units over ``cap`` words as pieces of at most ``cap`` words; the others as they are."""
    words = words_of(F.col("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(cap))
    cut = units.withColumn("w", words).withColumn(
        "parts", F.when(F.size("w") <= cap, F.array("text")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, cap), " ")))
    )
    cut = cut.select("document", "ord", F.posexplode("parts").alias("part", "text"), "page", "section", "block_id")
    return cut.select("document", F.struct("ord", "part").alias("ord"), "text", count_words(F.col("text")).alias("n"), "page", "section", "block_id")


# ------------------------------------------------------------------ counting by joined text
_COUNTERS: dict[str, Callable[[str], int]] = {
    "words": lambda t: len(t.split()),
    "chars": lambda t: -(-len(t) // 4) if t.strip() else 0,
    "heuristic": estimate_tokens,
}


def _within(count: Callable[[str], int], cap: int) -> Callable[[str], bool]:
    """Whether a text's count is within ``cap``; the estimate need not look at all of a text far beyond it."""
    return (lambda t: estimated_within(t, cap)) if count is estimate_tokens else (lambda t: count(t) <= cap)


def _longest_prefix(parts: list[str], joiner: str, fits: Callable[[str], bool], start: int = 0, head: tuple[str, ...] = ()) -> int:
    """Most leading parts, of ``head`` and then of parts from ``start`` on, that fit together, by galloping and
    bisection; at least 1."""
    total, before = len(head) + len(parts) - start, len(head)
    text = lambda k: joiner.join([*head, *parts[start : start + k - before]])
    low, high = 1, 2
    while high <= total and fits(text(high)):
        low, high = high, high * 2
    high = min(high, total + 1)
    while high - low > 1:
        mid = (low + high) // 2
        if fits(text(mid)):
            low = mid
        else:
            high = mid
    return low


def hard_split(text: str, cap: int, count: Callable[[str], int]) -> list[str]:
    """Pieces within ``cap``: words first, characters of a word that is itself too long."""
    fits = _within(count, cap)
    if fits(text):
        return [text]
    words, at, out = text.split(), 0, []
    while at < len(words):
        if not fits(words[at]):
            letters, i = list(words[at]), 0
            at += 1
            while i < len(letters):
                k = _longest_prefix(letters, "", fits, i)
                if not fits("".join(letters[i : i + k])):
                    raise ValueError(f"one character costs more than the cap of {cap} tokens")
                out.append("".join(letters[i : i + k]))
                i += k
            continue
        k = _longest_prefix(words, " ", fits, at)
        out.append(" ".join(words[at : at + k]))
        at += k
    return out


def pack_texts(
    texts: list[str], cap: int, overlap: int = 0, least: int = 0, joiner: str = "\n\n", count: Callable[[str], int] = _COUNTERS["words"],
) -> list[tuple[str, list[int]]]:
    """(chunk text, indices of the units in it), re-counting the joined text.

    ``overlap`` tokens of a chunk's tail open the next one where they fit; a chunk under ``least`` tokens joins the
    one before it where both fit together, without the repeated tail.
    """
    cap = max(16, cap)
    overlap, least = min(overlap, cap - 1), min(least, cap)
    fits = _within(count, cap)
    units = [(piece, k) for k, t in enumerate(texts) if t.strip() for piece in hard_split(t, cap, count)]
    body = [u for u, _ in units]
    chunks: list[tuple[str, list[int], str]] = []
    at = 0
    tail = ""
    while at < len(units):
        head = (tail,) if tail and fits(joiner.join([tail, body[at]])) else ()
        k = _longest_prefix(body, joiner, fits, at, head) - len(head)
        k = max(k, 1)
        own = joiner.join(body[at : at + k])
        chunks.append((joiner.join([*head, own]), [i for _, i in units[at : at + k]], own))
        at += k
        tail = ""
        if overlap and at < len(units):
            words = own.split()
            want = min(overlap, max(cap - count(units[at][0]), 0))
            take = 0
            while take < len(words) and count(" ".join(words[-take - 1 :])) <= want:
                take += 1
            tail = " ".join(words[-take:]) if take else ""
    merged: list[tuple[str, list[int], str]] = []
    for text, ids, own in chunks:
        if merged and least and count(own) < least and fits(joiner.join([merged[-1][0], own])):
            before = merged.pop()
            merged.append((joiner.join([before[0], own]), before[1] + ids, joiner.join([before[2], own])))
        else:
            merged.append((text, ids, own))
    return [(text, ids) for text, ids, _ in merged]


def _packed_in_python(units: DataFrame, spec: SegmentSpec, joiner: str) -> DataFrame:
    count = _COUNTERS[spec.tokenizer]
    cap, overlap, least = spec.max_tokens, spec.overlap, spec.min_tokens

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable").reset_index(drop=True)
        rows = []
        for k, (text, ids) in enumerate(pack_texts(list(pdf.text), cap, overlap, least, joiner, count), 1):
            own = pdf.iloc[sorted(set(ids))]
            one = lambda c, own=own: own[c].iloc[0] if own[c].nunique(dropna=False) == 1 and pd.notna(own[c].iloc[0]) else None
            rows.append((pdf.document[0], k, text, count(text), len(text), one("page"), one("section"), one("block_id")))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")])
        return out.astype({"page": "Int32", "block_id": "Int32"})

    return units.groupBy("document").applyInPandas(run, CHUNKS)


def _pack(units: DataFrame, spec: SegmentSpec, joiner: str) -> DataFrame:
    """units(document, ord, text, page, section, block_id) to chunks, in the JVM where the count is additive."""
    if spec.tokenizer == "words" and not spec.overlap and not spec.min_tokens:
        return pack_units(split_oversize(units, spec.max_tokens), spec.max_tokens, joiner)
    return _packed_in_python(units, spec, joiner)


# ------------------------------------------------------------------ the segmenters
@register_segmenter("paragraph")
def seg_paragraph(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    return _pack(blocks.withColumn("ord", F.col("block_id")), spec, "\n\n")


@register_segmenter("sentence")
def seg_sentence(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    parts = blocks.select("document", "block_id", "page", "section", F.posexplode(sentences_of(F.col("text"))).alias("k", "text"))
    window = Window.partitionBy("document").orderBy("block_id", "k")
    return _pack(parts.withColumn("ord", F.row_number().over(window)).drop("k"), spec, " ")


@register_segmenter("fixed")
def seg_fixed(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Windows of ``max_tokens`` words. With an overlap of k the windows share k - 1 words: the shared part stays
    strictly below the overlap. The last window is the first that reaches the end."""
    cap = spec.max_tokens
    stride = cap - max(spec.overlap - 1, 0)
    joined = blocks.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("block_id", "text"))).alias("b"))
    words = joined.select("document", F.flatten(F.transform("b", lambda x: words_of(x["text"]))).alias("w"))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - cap) / stride).cast("int"))
    # windows are cut inside the row, so a document's words are copied once an overlap and not once a window
    window = lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", k * stride + 1, cap), " ").alias("text"), F.least(F.size("w") - k * stride, F.lit(cap)).alias("tokens"))
    cut = words.withColumn("last", last).withColumn("windows", F.transform(F.sequence(F.lit(0), F.col("last")), window))
    rows = cut.select("document", F.explode_outer("windows").alias("x")).select("document", "x.*")
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "document", (F.col("k") + 1).alias("chunk_id"), "text", "tokens", F.length("text").alias("chars"),
        none("int").alias("page"), none("string").alias("section"), none("int").alias("block_id"),
    )


#: The cascade of separators of the recursive segmenter, coarse to fine.
SEPARATORS = ["\n\n\n", "\n\n", "\n", ". ", "; ", ", ", " "]


def recursive_pieces(text: str, cap: int, count: Callable[[str], int], level: int = 0) -> list[str]:
    """Cut at the coarsest separator, each piece keeping it at its end; cut pieces over the cap at the next finer."""
    if _within(count, cap)(text):
        return [text]
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        return hard_split(text, cap, count)
    parts = text.split(SEPARATORS[level])
    pieces = [p + (SEPARATORS[level] if k < len(parts) - 1 else "") for k, p in enumerate(parts)]
    return [q for p in pieces if p.strip() for q in recursive_pieces(p, cap, count, level + 1)]


@register_segmenter("recursive")
def seg_recursive(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    """A document's blocks joined, cut and packed; documents reach Python many to a batch."""
    count, cap = _COUNTERS[spec.tokenizer], spec.max_tokens

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for document, text in zip(pdf.document, pdf.text, strict=True):
                packed = pack_texts(recursive_pieces(text, cap, count), cap, spec.overlap, spec.min_tokens, "", count)
                rows += [(document, k, t, count(t), len(t), None, None, None) for k, (t, _) in enumerate(packed, 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKS.split(", ")]).astype({"page": "Int32", "block_id": "Int32"})

    listed = blocks.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("block_id", "text"))).alias("b"))
    return listed.select("document", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text")).mapInPandas(run, CHUNKS)


def section_runs(blocks: DataFrame) -> DataFrame:
    """Add ``run``: number of the stretch of equal sections a block stands in."""
    order = Window.partitionBy("document").orderBy("block_id")
    changed = (~F.col("section").eqNullSafe(F.lag("section").over(order))) | (F.row_number().over(order) == 1)
    return blocks.withColumn("starts", changed.cast("int")).withColumn("run", F.sum("starts").over(order)).drop("starts")


#: A line that heads what follows: marked, numbered, named as a part, or in capitals; it ends no sentence.
HEADING = r"^(?:#{1,6}[ \t]+\S|(?:[0-9]{1,2}(?:\.[0-9]{1,2})*\.?|[IVX]{1,5}\.|[A-Z]\.)[ \t]+\p{Lu}|(?i:chapter|section|part|appendix)[ \t]+(?:[0-9]+|[IVX]+|[A-Z])\b|[\p{Lu}0-9][\p{Lu}0-9 ,:&'()/-]{2,}$)"
HEADING_WORDS = 30


def inferred_sections(blocks: DataFrame) -> DataFrame:
    """Sections of documents that have none: each from a block of one short line that reads like a heading. The heading
    is the section's name then, and stays a block only where nothing follows it. Documents with a section are left alone."""
    whole, order = Window.partitionBy("document"), Window.partitionBy("document").orderBy("block_id")
    line = F.trim("text")
    looks = (F.max("section").over(whole).isNull()) & ~line.contains("\n") & (count_words(line) < HEADING_WORDS) & line.rlike(HEADING) & ~line.rlike(r"[.!?;,]$")
    marked = blocks.withColumn("_head", looks)
    named = marked.withColumn("section", F.coalesce("section", F.last(F.when(F.col("_head"), F.regexp_replace(line, r"^#+[ \t]*", "")), ignorenulls=True).over(order)))
    followed = ~F.coalesce(F.lead("_head").over(order), F.lit(True))
    return named.withColumn("_drop", F.col("_head") & followed).filter(~F.col("_drop")).drop("_head", "_drop")


@register_segmenter("structural")
def seg_structural(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Packing inside each run of one section, never across; a chunk of a named section opens with its heading. Documents
    without sections get those that their headings tell."""
    runs = section_runs(inferred_sections(blocks)).withColumn("ord", F.col("block_id"))
    keyed = runs.withColumn("document", F.to_json(F.struct("document", "run"))).drop("run")
    room = replace(spec, max_tokens=max(spec.max_tokens - 8, 16))
    chunks = _pack(keyed, room, "\n\n").withColumn("at", F.from_json("document", "document string, run int"))
    order = Window.partitionBy("at.document").orderBy("at.run", "chunk_id")
    body = F.when(F.col("section").isNull(), F.col("text")).otherwise(F.concat(F.lit("## "), "section", F.lit("\n\n"), "text"))
    return chunks.withColumn("n", F.row_number().over(order)).select(
        F.col("at.document").alias("document"), F.col("n").cast("int").alias("chunk_id"), body.alias("text"),
        "tokens", F.length(body).alias("chars"), "page", "section", "block_id",
    )


@register_segmenter("page")
def seg_page(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    """One chunk a page, in page order; a page over the cap is cut into parts of its words.

    Each unbroken run of blocks without a page is a chunk of its own, without a page, after the page it follows. A
    document in which no block has a page is packed by paragraphs. A page is held whole, by one row.
    """
    order = Window.partitionBy("document").orderBy("block_id")
    some = F.max("page").over(Window.partitionBy("document")).isNotNull()
    marked = blocks.withColumn("_some", some)
    loose = seg_paragraph(marked.filter(~F.col("_some")).drop("_some"), spec)
    paged = marked.filter("_some").withColumn("after", F.coalesce(F.last("page", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)))
    bare = F.col("page").isNull()
    paged = paged.withColumn("_new", (bare & (~F.coalesce(F.lag("page").over(order).isNull(), F.lit(False)) | (F.row_number().over(order) == 1))).cast("int"))
    paged = paged.withColumn("run", F.when(bare, F.sum("_new").over(order)).otherwise(0))
    groups = paged.groupBy("document", "after", "run").agg(F.array_sort(F.collect_list(F.struct("block_id", "text", "section"))).alias("u"))
    body = F.array_join(F.transform("u", lambda x: x["text"]), "\n\n")
    cap = spec.max_tokens
    page = F.when(F.col("run") == 0, F.col("after")).cast("int").alias("page")
    section = F.when(F.size(F.array_distinct(F.transform("u", lambda x: F.struct(x["section"])))) == 1, F.col("u")[0]["section"]).alias("section")
    whole = groups.select("document", "after", "run", page, section, F.col("u")[0]["block_id"].alias("block_id"), body.alias("body"), count_tokens(body, spec.tokenizer).alias("n"))
    fits = whole.filter(F.col("n") <= cap).select("document", "after", "run", F.lit(0).alias("part"), "page", "section", "block_id", F.col("body").alias("text"), F.col("n").alias("tokens"))
    count = _COUNTERS[spec.tokenizer]

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(r.document, r.after, r.run, k, r.page, r.section, r.block_id, t, count(t)) for r in pdf.itertuples() for k, t in enumerate(hard_split(r.body, cap, count))]
            yield pd.DataFrame(rows, columns=["document", "after", "run", "part", "page", "section", "block_id", "text", "tokens"]).astype({"page": "Int32"})

    over = whole.filter(F.col("n") > cap).drop("n").mapInPandas(split, "document string, after int, run bigint, part int, page int, section string, block_id int, text string, tokens int")
    n = F.row_number().over(Window.partitionBy("document").orderBy("after", "run", "part"))
    made = fits.withColumn("run", F.col("run").cast("bigint")).unionByName(over)
    made = made.select("document", n.alias("chunk_id"), "text", "tokens", F.length("text").alias("chars"), "page", "section", "block_id")
    return made.unionByName(loose.select(*made.columns))


@register_segmenter("contextual")
def seg_contextual(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Paragraph chunks behind a line that says where they come from; source_text keeps the chunk itself."""
    chunks = seg_paragraph(blocks, spec)
    return with_context(chunks, spec.source)


def with_context(chunks: DataFrame, source: str | None = None) -> DataFrame:
    total = F.count(F.lit(1)).over(Window.partitionBy("document"))
    parts = F.concat_ws(
        " | ",
        F.lit(source) if source else F.col("document"),
        F.when(F.col("section").isNotNull(), F.concat(F.lit("Section: "), "section")),
        F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page").cast("string"))),
        F.concat(F.lit("Part "), F.col("chunk_id").cast("string"), F.lit(" of "), total.cast("string")),
    )
    return chunks.withColumn("source_text", F.col("text")).withColumn("text", F.concat(F.lit("["), parts, F.lit("]\n"), "text"))


def with_model_context(chunks: DataFrame, client, source: str | None = None, words: int = 60) -> DataFrame:
    """Chunks behind a line that a model writes from the chunk and the document's opening; where the call fails or says
    nothing, behind the line of with_context. source_text keeps the chunk itself."""
    from foliospark.operators.model import call

    opening = chunks.groupBy("document").agg(F.min_by("text", "chunk_id").alias("_opening"))
    plain = with_context(chunks, source)
    asked = call(plain.join(opening, "document").withColumn("prompt", F.concat(F.lit("CONTEXT:\n\n"), truncate_words(F.col("_opening"), 200), F.lit("\n\n"), "source_text")), client)
    said = truncate_words(F.regexp_extract(F.trim(F.coalesce("reply", F.lit(""))), r"^[^\n]*", 0), words)
    text = F.when(F.col("ok") & has_content(said), F.concat(F.lit("["), said, F.lit("]\n"), "source_text")).otherwise(F.col("text"))
    return asked.select(*[text.alias(c) if c == "text" else F.col(c) for c in plain.columns])


def semantic_boundaries(units: DataFrame, group: str, order: str, vector: str, percent: float = 0.9) -> DataFrame:
    """Add ``distance`` to the unit before (cosine) and ``piece``: a new piece starts where the distance is at or
    above the group's percentile (linear interpolation)."""
    from foliospark.operators.rank import cosine

    w = Window.partitionBy(group).orderBy(order)
    before = F.lag(vector).over(w)
    stepped = units.withColumn("distance", F.when(before.isNotNull(), F.round(1 - cosine(F.col(vector), before), 9)))
    cuts = stepped.groupBy(group).agg(F.percentile("distance", F.lit(percent)).alias("cut"))
    joined = stepped.join(cuts, group)
    starts = F.when(F.col("distance").isNull() | (F.col("distance") >= F.col("cut")), 1).otherwise(0)
    return joined.withColumn("piece", F.sum(starts).over(w)).drop("cut")


@register_segmenter("semantic")
def seg_semantic(blocks: DataFrame, spec: SegmentSpec) -> DataFrame:
    """Sentences with their hashed bag-of-terms vectors; pieces between sharp turns are packed."""
    from foliospark.operators.rank import lexical_vector

    parts = blocks.select("document", "block_id", "page", "section", F.posexplode(sentences_of(F.col("text"))).alias("k", "text"))
    parts = parts.withColumn("ord", F.row_number().over(Window.partitionBy("document").orderBy("block_id", "k"))).drop("k")
    around = F.concat_ws(" ", F.collect_list("text").over(Window.partitionBy("document").orderBy("ord").rowsBetween(-1, 0)))
    pieces = semantic_boundaries(parts.withColumn("around", around).withColumn("v", lexical_vector(F.col("around"), 128)), "document", "ord", "v").drop("around")
    grouped = pieces.groupBy("document", "piece").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "page", "section", "block_id"))).alias("u"))
    units = grouped.select("document", F.col("piece").alias("ord"), F.array_join(F.transform("u", lambda x: x["text"]), " ").alias("text"), _one("page").alias("page"), _one("section").alias("section"), _one("block_id").alias("block_id"))
    return _pack(units, spec, " ")


def chunk_stats(chunks: DataFrame, cap: int, *by: str) -> DataFrame:
    """n, total, min, median, mean to one place, max and how many are over the cap."""
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"), F.min("tokens").alias("min_tokens"),
        F.percentile("tokens", F.lit(0.5)).alias("median_tokens"), F.round(F.avg("tokens"), 1).alias("mean_tokens"),
        F.max("tokens").alias("max_tokens"), F.sum(F.when(F.col("tokens") > cap, 1).otherwise(0)).alias("over_cap"),
    )


def seg_proposition(blocks: DataFrame, client, batch_tokens: int = 900) -> DataFrame:
    """Batches of at most ``batch_tokens`` words, each rewritten by the model as a JSON array of statements.

    A batch whose call fails or whose reply does not parse is kept word for word. Statements carry no page or section.
    """
    from foliospark.operators.model import call, read_json

    batches = seg_paragraph(_shaped(blocks), SegmentSpec("paragraph", batch_tokens).clamped())
    asked = call(batches.withColumn("prompt", F.concat(F.lit("STATEMENTS:\n\n"), "text")), client)
    said = F.filter(F.coalesce(read_json(F.col("reply"), "array<string>"), F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull() & has_content(x))
    rows = asked.select("document", "chunk_id", F.posexplode(F.when(F.col("ok") & (F.size(said) > 0), said).otherwise(F.array("text"))).alias("k", "statement"))
    n = F.row_number().over(Window.partitionBy("document").orderBy("chunk_id", "k"))
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "document", n.alias("chunk_id"), F.col("statement").alias("text"), count_words(F.col("statement")).alias("tokens"), F.length("statement").alias("chars"),
        none("int").alias("page"), none("string").alias("section"), none("int").alias("block_id"),
    )
