"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. MinHash bands propose candidates, which meet in cells of bounded weight; there
the MinHash values of two texts are compared a few at a time and the pair is dropped as soon as the posterior
probability that its similarity reaches the threshold is below a tolerance. Only texts with a surviving pair have their
shingles taken to the cell, where the pair is verified on the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import connected_components, cut, small_batches

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 5 rows: a pair at the threshold shares no band with probability 3e-6; a group of candidates that fits
#: in one cell is compared whole, so it is then still met through any third text.
BANDS, ROWS = 32, 5
STEP, TOLERANCE = 32, 1e-6
#: Shingles (8 bytes each) of a cell's side; a text counts its shingles and TEXT_WEIGHT more. A task holds one cell.
BLOCK_SHINGLES, TEXT_WEIGHT = 1 << 20, 256
#: Words whose hashes a worker remembers, by their number and by their characters.
KNOWN_WORDS, KNOWN_CHARS = 200_000, 8 << 20
SEED = 20240229
#: What names a cell; a text's seat in it also has a block, which is x or y.
CELL = ("grp", "band", "x", "y")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; fewer words than n make one shingle."""

    def __init__(self, words: int = WORDS):
        from xxhash import xxh3_64_intdigest

        self.words, self.digest = words, xxh3_64_intdigest
        self.known: dict[str, int] = {}
        self.chars = 0

    def __call__(self, text: str) -> np.ndarray:
        known, digest, tokens = self.known, self.digest, text.lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        h = np.empty(len(tokens), np.uint64)
        for k, t in enumerate(tokens):
            if (v := known.get(t)) is None:
                if len(known) >= KNOWN_WORDS or self.chars > KNOWN_CHARS:
                    known.clear()
                    self.chars = 0
                v = known[t] = digest(t)
                self.chars += len(t)
            h[k] = v
        n = min(self.words, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = _mix(out + h[k : len(h) - n + 1 + k] + np.uint64(0x9E3779B97F4A7C15))
        return np.unique(out)


def permutations(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)), rng.integers(0, 2**63, n, np.uint64)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each (a, b)."""
    best = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        values = ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(best, values.min(axis=1), out=best)
    return best


def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """Least m of n equal MinHash values with P(similarity >= threshold | m of n) >= tolerance, uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the binomial P(Bin(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        if total >= tolerance:
            return m
    return n


def surviving(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], same: bool, threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE, step: int = STEP, band: int = -1, rows: int = ROWS,
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j) whose pairs the posterior does not drop; a side is (signatures, sizes).

    With ``band`` >= 0 only pairs that agree in this band and in none before it: a pair that several bands
    propose is met in one cell.
    """
    (left_sig, left_sizes), (right_sig, right_sizes) = left, right
    floor = [fewest_matches(n, threshold, tolerance) for n in range(step, left_sig.shape[1] + 1, step)]
    for i, sig in enumerate(left_sig):
        n = left_sizes[i]
        sizes = right_sizes[i + 1 :] if same else right_sizes
        at = np.flatnonzero((sizes >= threshold * n - 1e-9) & (sizes * threshold <= n + 1e-9)) + (i + 1 if same else 0)
        if band >= 0:
            at = at[(right_sig[at, band * rows : (band + 1) * rows] == sig[band * rows : (band + 1) * rows]).all(axis=1)]
        matches = np.zeros(len(at), np.int64)
        for k, least in enumerate(floor):
            if not len(at):
                break
            part = slice(k * step, (k + 1) * step)
            matches = matches + (right_sig[at, part] == sig[part]).sum(axis=1)
            keep = matches >= least
            at, matches = at[keep], matches[keep]
        if band > 0 and len(at):
            before = (right_sig[at, : band * rows] == sig[: band * rows]).reshape(len(at), band, rows)
            at = at[~before.all(axis=2).any(axis=1)]
        if len(at):
            yield i, at


def verified(mine: np.ndarray, others: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which of ``others`` have Jaccard >= threshold with ``mine``; all are sorted and distinct."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    found = np.searchsorted(mine, every)
    found[found == len(mine)] = 0
    common = np.add.reduceat((mine[found] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return common >= threshold * (len(mine) + sizes - common) - 1e-9


def _signatures(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """rid, key, doc_id, size, sig of every row; no signature without a word."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (a, b) = Shingler(words), permutations(hashes)
        for part in parts:
            sizes, sigs = [], []
            for text in part.column(3):
                s = shingle(text.as_py() or "")
                sizes.append(len(s))
                sigs.append(minhash(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                ["rid", "key", "doc_id", "size", "sig"],
            )

    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.col("doc_id").cast("bigint"), "text")
    return keyed.mapInArrow(batches, "rid bigint, key string, doc_id bigint, size bigint, sig binary")


def _by_cell(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """One table for each cell, from batches sorted by cell; no more than a cell and a batch is held."""
    held: list[pa.RecordBatch] = []
    last: tuple[int, ...] = ()
    for part in parts:
        if not part.num_rows:
            continue
        keys = np.stack([part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in CELL])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), part.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(part.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _sides(key: tuple[int, ...], table: pa.Table, columns: list[str]) -> list[dict[str, np.ndarray | list]] | None:
    """The one or two sides of a cell, a text once each however many rows repeat it; None if one has no text."""
    x, y = key[2:]
    block, out = table.column("block").to_numpy(), []
    for side in dict.fromkeys((x, y)):
        at = np.flatnonzero(block == side)
        ids, first = np.unique(table.column("cid").to_numpy()[at], return_index=True)
        if not len(ids):
            return None
        part = table.take(pa.array(at[first]))
        found: dict[str, np.ndarray | list] = {"cid": ids, "sig": np.frombuffer(b"".join(v.as_py() for v in part.column("sig")), np.uint32).reshape(len(ids), -1)}
        for c in columns:
            found[c] = [np.frombuffer(v.as_py(), np.uint64) for v in part.column(c)] if c == "shingles" else part.column(c).to_numpy()
        out.append(found)
    return out


def _dealt(seats: DataFrame) -> DataFrame:
    return seats.repartition(*CELL).sortWithinPartitions(*CELL)


def _alive(seats: DataFrame, threshold: float, tolerance: float, rows: int) -> DataFrame:
    """The seats of texts that have a surviving pair in the cell, from signatures alone."""

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[np.ndarray]] = {c: [] for c in ("cid", *CELL, "block")}
        n = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in kept.values()], list(kept))
            for v in kept.values():
                v.clear()
            return out

        for key, table in _by_cell(parts):
            sides = _sides(key, table, ["size"])
            if sides is None:
                continue
            left, right = sides[0], sides[-1]
            live = [np.zeros(len(s["cid"]), bool) for s in sides]
            for i, at in surviving((left["sig"], left["size"]), (right["sig"], right["size"]), len(sides) == 1, threshold, tolerance, band=key[1], rows=rows):
                live[0][i] = True
                live[-1][at] = True
            for side, mark, block in zip(sides, live, key[2:], strict=False):
                ids = side["cid"][mark]
                for c, v in zip(("cid", *CELL, "block"), (ids, *key, block), strict=True):
                    kept[c].append(ids if c == "cid" else np.full(len(ids), v, np.int64))
                n += len(ids)
            if n >= 10_000:
                yield flush()
                n = 0
        if n:
            yield flush()

    return _dealt(seats).mapInArrow(cells, "cid bigint, grp bigint, band bigint, x bigint, y bigint, block bigint")


def _links(seats: DataFrame, threshold: float, tolerance: float, rows: int) -> DataFrame:
    """(cid, links, texts, near): from each cell, what a text is linked to; near joins it to another text."""

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _by_cell(parts):
            sides = _sides(key, table, ["size", "copies", "shingles"])
            if sides is None:
                continue
            left, right, same = sides[0], sides[-1], len(sides) == 1
            sums = [np.zeros((2, len(s["cid"])), np.int64) for s in sides]
            everyone = np.concatenate([s["cid"] for s in sides])
            shift, root = (0 if same else len(left["cid"])), list(range(len(everyone)))

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, at in surviving((left["sig"], left["size"]), (right["sig"], right["size"]), same, threshold, tolerance, band=key[1], rows=rows):
                at = at[verified(left["shingles"][i], [right["shingles"][j] for j in at], threshold)]
                if not len(at):
                    continue
                sums[0][:, i] += (right["copies"][at].sum(), len(at))
                sums[-1][0, at] += left["copies"][i]
                sums[-1][1, at] += 1
                for j in at:
                    a, b = find(i), find(int(j) + shift)
                    if a != b:
                        root[max(a, b)] = min(a, b)
            near = everyone[[find(i) for i in range(len(everyone))]]
            total = np.concatenate(sums, axis=1)
            linked = total[1] > 0
            if linked.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[linked]) for v in (everyone, total[0], total[1], near)], ["cid", "links", "texts", "near"])

    return _dealt(seats).mapInArrow(cells, "cid bigint, links bigint, texts bigint, near bigint")


def _seats(texts: DataFrame, bands: int, rows: int, weight: int) -> DataFrame:
    """(cid, grp, band, x, y, block): where each text meets its candidates; one row a text for most groups.

    A group of texts joined by shared buckets that weighs no more than a cell is one cell. The buckets of a heavier
    group are cells themselves, less those with the same members as the bucket of a band before; a bucket that is
    too heavy is dealt out in blocks, each pair of blocks a cell.
    """
    width = rows * 4
    spans = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(bands)])
    banded = texts.filter("size > 0").select("cid", F.posexplode(spans).alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    member = cut(banded.join(shared, ["band", "bucket"]).select("cid", "band", "bucket", "hub"))
    # a text's hubs hang on the least of them, so a group of n texts has about n edges, not n a band
    hubs = member.groupBy("cid").agg(F.collect_set("hub").alias("hubs"))
    star = hubs.select(F.array_min("hubs").alias("b"), F.explode(F.array_union("hubs", F.array("cid"))).alias("a")).filter("a != b").distinct()
    groups = connected_components(star).select(F.col("node").alias("cid"), F.col("label").alias("grp"))

    placed = cut(texts.select("cid", (F.col("size") + TEXT_WEIGHT).alias("w")).join(groups, "cid"))
    total = placed.groupBy("grp").agg(F.sum("w").alias("total"))
    zero = F.lit(0).cast("bigint")
    light = placed.join(total.filter(F.col("total") <= weight), "grp").select("cid", "grp", F.lit(-1).cast("bigint").alias("band"), zero.alias("x"), zero.alias("y"), zero.alias("block"))

    heavy = member.drop("hub").join(placed.join(total.filter(F.col("total") > weight), "grp").select("cid", "w"), "cid")
    same = [F.bit_xor(F.xxhash64(F.lit(k), F.col("cid"))).alias(f"m{k}") for k in (1, 2)]
    buckets = heavy.groupBy("band", "bucket").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), *same)
    buckets = buckets.groupBy("n", "m1", "m2", "w").agg(F.min(F.struct("band", "bucket")).alias("b"))
    buckets = buckets.select("b.*", F.when(F.col("w") <= weight, 1).otherwise(F.ceil(2 * F.col("w") / weight)).cast("bigint").alias("blocks"))
    seated = heavy.join(buckets, ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64(F.lit(3), F.col("cid")), F.col("blocks")))
    seated = seated.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    seated = seated.select("cid", F.col("bucket").alias("grp"), F.col("band").cast("bigint"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block")
    return light.unionByName(seated)


def near_duplicates(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    tolerance: float = TOLERANCE, weight: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, key, class_id, n_links, n_texts, kept.

    class_id is the smallest doc_id of the document's component under "Jaccard of word shingles >= threshold";
    n_links counts the documents linked to it, copies of its own text included, n_texts the different texts.
    kept marks the one document of each component that stays. key is the SHA-256 of the text.

    Copies are folded before anything else, so a text with a million copies is one text. Words are lower-cased
    and split at white space. A null text is an empty one. Texts without a word are linked to their copies only.
    Rows that repeat doc_id and text are copies. A null doc_id loses to any other. An empty table gives an empty
    result. Other columns are not read, so their names may clash. A very long text is one set of shingles, 8 bytes
    a word; it is held whole, with its cell.

    A cell's side weighs about ``weight`` shingles (BLOCK_SHINGLES), and only sums and a spanning forest leave a
    cell, never its pairs. The work is linear in the texts of buckets, but for a bucket of several cells, whose
    *different* texts are compared block by block.
    """
    small_batches(docs.sparkSession)
    weight = weight or BLOCK_SHINGLES
    every = cut(_signatures(docs, words, bands * rows))
    texts = every.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.first("size").alias("size"),
        F.first("sig").alias("sig"),
    )
    texts = cut(texts.select(F.col("first.rid").alias("cid"), F.col("first.doc_id").alias("doc_id"), "key", "copies", "size", "sig"))

    seats = _seats(texts, bands, rows, weight)
    alive = cut(_alive(texts.select("cid", "size", "sig").join(seats, "cid"), threshold, tolerance, rows), spread=True)
    own = alive.groupBy("cid").agg(F.collect_list(F.struct(*CELL, "block")).alias("seats"))
    own = own.join(texts, "cid").select("cid", "copies", "size", "sig", "seats", F.col("key").alias("ckey"), F.col("doc_id").alias("cdoc"))
    text = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    text = text.join(own, (F.col("key") == F.col("ckey")) & F.col("doc_id").eqNullSafe(F.col("cdoc")))
    shingled = _shingled(text.select("cid", "copies", "size", "sig", "seats", "text"), words)
    seated = shingled.select("cid", "copies", "size", "sig", "shingles", F.explode("seats").alias("s")).select("cid", "copies", "size", "sig", "shingles", "s.*")
    found = cut(_links(seated, threshold, tolerance, rows), spread=True)
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    classes = connected_components(found.select(F.col("cid").alias("a"), F.col("near").alias("b")))

    whole = (
        texts.select("cid", "key", "copies", "doc_id")
        .join(sums, "cid", "left")
        .join(classes.withColumnRenamed("node", "cid"), "cid", "left")
        .select("cid", "key", "copies", "doc_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("label", "cid").alias("label"))
    )
    head = whole.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid")).alias("head"))
    whole = whole.join(head, "label").select("key", "copies", "links", "texts", F.col("head.doc_id").alias("class_id"), F.col("head.cid").alias("kept_rid"))
    return every.select("rid", "doc_id", "key").join(whole, "key").select(
        "doc_id",
        "key",
        "class_id",
        (F.col("links") + F.col("copies") - 1).alias("n_links"),
        F.col("texts").alias("n_texts"),
        (F.col("rid") == F.col("kept_rid")).alias("kept"),
    )


def _shingled(text: DataFrame, words: int) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for part in parts:
            sets = [shingle(t.as_py() or "").tobytes() for t in part.column(5)]
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.binary())], ["cid", "copies", "size", "sig", "seats", "shingles"])

    seat = ", ".join(f"{c}: bigint" for c in (*CELL, "block"))
    return text.mapInArrow(batches, f"cid bigint, copies bigint, size bigint, sig binary, seats array<struct<{seat}>>, shingles binary")
