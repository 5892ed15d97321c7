"""Document fingerprints by Order MinHash (native).

Pieces are runs of up to PIECE non-space code points, and single code points in a run of more than LONG of them, as of
scripts without spaces; so an insertion moves the pieces of at most LONG code points. k-mers are K pieces in a row. Each k-mer is numbered by its
occurrence, so a text is a set of (k-mer, occurrence). A hash deals the set into BUCKETS parts; in each part the
TUPLE members with the least hash are taken, put back in text order, and hashed as a tuple. Two texts agree in a
part when they share these members in the same order, which becomes rarer with edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import cut

PIECE, LONG, K, TUPLE, BUCKETS = 8, 24, 3, 2, 64
#: The rest of a run is a piece if it is short enough; else a code point with LONG more behind or before it is one.
PIECES = rf"\\S{{1,{PIECE}}}+(?!\\S)|\\S(?=\\S{{{LONG}}})|(?<=\\S{{{LONG}}})\\S|\\S{{{PIECE}}}"
#: Bits of a position in a text, as many as an array can have, and of a hash beside bucket and position.
POSITION_BITS, HASH_BITS, BUCKET_BITS = 31, 26, 6
#: An id's neighbour is sought among ids that agree but for so many low bits, then among groups, and so on.
SHIFTS = (12, 24, 36, 48)


def fingerprint_columns(df: DataFrame, text: str, out: str, k: int = K, size: int = TUPLE) -> DataFrame:
    """Add ``out``: one bigint (bucket, 32-bit tuple hash) for each bucket with a member; no pieces, no entry.

    A text of fewer than k pieces has one k-mer, of all its pieces.
    """
    p = f"__{out}_"
    low, mask = POSITION_BITS, (1 << POSITION_BITS) - 1
    bucket_at = HASH_BITS + POSITION_BITS
    gram = ", ".join(f"{p}h[i + {j}]" for j in range(k))
    #: bucket | hash | position, from the top bits of the member's hash: sorts by hash within a bucket
    top = 64 - BUCKET_BITS - HASH_BITS
    el = lambda o: f"shiftleft(shiftrightunsigned(xxhash64(shiftright(x, {low}), {o}), {top}), {low}) | (x & {mask}L)"
    run = f"transform(slice({p}s, a + 1, coalesce(get({p}starts, j + 1), size({p}s)) - a), (x, o) -> {el('o')})"
    steps = {
        "h": f"transform(regexp_extract_all({text}, '{PIECES}', 0), x -> xxhash64(x))",
        "g": f"case when size({p}h) >= {k} then transform(sequence(0, size({p}h) - {k}), i -> xxhash64({gram}))"
        f" when size({p}h) > 0 then array(xxhash64({p}h)) else cast(array() as array<bigint>) end",
        "s": f"sort_array(transform({p}g, (x, i) -> (x & {~mask}L) | i))",
        "starts": f"filter(if(size({p}s) = 0, cast(array() as array<int>), sequence(0, size({p}s) - 1)),"
        f" i -> i = 0 or shiftright({p}s[i], {low}) != shiftright({p}s[i - 1], {low}))",
        "e": f"sort_array(if(size({p}starts) = size({p}s), transform({p}s, x -> {el('0')}), flatten(transform({p}starts, (a, j) -> {run}))))",
        "c": f"sort_array(transform(filter({p}e, (x, i) -> i < {size} or shiftright({p}e[i - {size}], {bucket_at}) != shiftright(x, {bucket_at})),"
        f" x -> shiftleft(shiftright(x, {bucket_at}), {bucket_at}) | shiftleft(x & {mask}L, {HASH_BITS}) | (shiftright(x, {low}) & {(1 << HASH_BITS) - 1}L)))",
        "first": f"filter(if(size({p}c) = 0, cast(array() as array<int>), sequence(0, size({p}c) - 1)),"
        f" i -> i = 0 or shiftright({p}c[i], {bucket_at}) != shiftright({p}c[i - 1], {bucket_at}))",
    }
    for name, step in steps.items():
        df = df.withColumn(p + name, F.expr(step))
    members = f"transform(slice({p}c, a + 1, coalesce(get({p}first, j + 1), size({p}c)) - a), x -> x & {(1 << HASH_BITS) - 1}L)"
    df = df.withColumn(
        out,
        F.expr(f"transform({p}first, (a, j) -> shiftleft(shiftright({p}c[a], {bucket_at}), 32) | (xxhash64({members}) & 4294967295L))"),
    )
    return df.drop(*[p + name for name in steps])


def as_text(fingerprint: Column) -> Column:
    """Ten hex digits an entry: two of the bucket and eight of the tuple hash."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared entries over buckets that either has; two fingerprints without entries are alike."""
    bucket = lambda v: F.transform(v, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bucket(a), bucket(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def next_descending(ids: DataFrame) -> DataFrame:
    """(v, next) for distinct bigints ``v``: the next smaller one, and after the smallest the largest.

    Neighbours are found inside groups of ids that share their high bits, then between groups, level by level,
    so no window holds more than 2**12 rows however many ids there are (the last level: 2**16 groups).
    """
    largest = ids.agg(F.max("v")).first()[0]

    def link(values: DataFrame, shifts: tuple[int, ...], done: int) -> DataFrame:
        if not shifts:
            return values.withColumn("next", F.lead("v").over(Window.orderBy(F.desc("v"))))
        group = F.shiftright("v", shifts[0] - done).alias("g")
        inner = values.select("v", group).withColumn("inner", F.lead("v").over(Window.partitionBy("g").orderBy(F.desc("v"))))
        tops = cut(values.select("v", group).groupBy("g").agg(F.max("v").alias("top")))
        few = tops.count() <= 1 << SHIFTS[0]
        between = link(tops.select(F.col("g").alias("v")), () if few else shifts[1:], shifts[0])
        to = between.join(tops.select(F.col("g").alias("next"), "top"), "next").select(F.col("v").alias("g"), "top")
        return inner.join(to, "g", "left").select("v", F.coalesce("inner", "top").alias("next"))

    return link(ids.select("v"), SHIFTS, 0).select("v", F.coalesce("next", F.lit(largest).cast("bigint")).alias("next"))


def document_fingerprints(docs: DataFrame, k: int = K, size: int = TUPLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next
    document by descending doc_id. A null text is an empty one; its fingerprint is the empty string. A null
    doc_id sorts below all others (and the least bigint is taken for one). An id that occurs several times is one document of the order: as a next
    document it stands for its smallest opening and its smallest fingerprint; each of its rows gets a row. An
    empty table gives an empty result. Other columns are not read, so their names may clash. A text is handled whole,
    however long: one task holds its pieces, about 40 bytes each.
    """
    none = F.lit(-(2**63))
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), none).alias("v"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = cut(base.groupBy("v").agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("need")))
    links = cut(next_descending(sizes).join(sizes, "v"))
    # both uses of printed are dealt by v with the same columns, so each text is read, fingerprinted and shuffled once;
    # what travels to the document before is an opening of a third of its size and one fingerprint
    printed = fingerprint_columns(base, "text", "fp", k, size)
    sent = printed.join(links.select(F.col("v").alias("to"), F.col("next").alias("v"), "need"), "v")
    sent = sent.select("to", F.expr("left(text, need)").alias("opening"), F.col("fp").alias("nfp"))
    received = sent.groupBy("to").agg(F.min("opening").alias("opening"), F.min("nfp").alias("nfp"))
    both = printed.join(received.withColumnRenamed("to", "v"), "v").withColumn("n", F.length("text"))
    both = both.select("v", "text", "fp", "n", "nfp", F.expr("concat(left(text, n - n div 3), left(opening, cast(n div 3 as int)))").alias("edited"))
    both = fingerprint_columns(both, "edited", "efp", k, size)
    return both.select(
        F.nullif(F.col("v"), none).alias("doc_id"),
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
