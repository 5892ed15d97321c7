from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import rank as R
from foliospark.operators import segment as S
from foliospark.operators.model import backoff, mock_client
from foliospark.plans import readers as P

BLOCKS = [("d", i, " ".join(f"w{i}x{k}" for k in range(n)), 1 + i // 2, "A" if i < 3 else "B") for i, n in enumerate([10, 50, 30, 5, 70, 1])]


def blocks(spark):
    return spark.createDataFrame(BLOCKS, "document string, block_id int, text string, page int, section string")


@pytest.mark.parametrize("method", sorted(S.SEGMENTERS))
@pytest.mark.parametrize("tokenizer", ["words", "heuristic"])
def test_no_word_is_lost_and_caps_hold(spark, method, tokenizer):
    if method == "semantic" and tokenizer == "heuristic":
        pytest.skip("the same packer")
    chunks = S.segment(blocks(spark), S.SegmentSpec(method, 40, tokenizer=tokenizer)).orderBy("chunk_id").collect()
    text = " ".join(c.text for c in chunks).split()
    wanted = [w for b in BLOCKS for w in b[2].split()]
    assert [w for w in text if w in set(wanted)] == wanted
    assert [c.chunk_id for c in chunks] == list(range(1, len(chunks) + 1))
    if method not in ("page", "contextual", "structural") and tokenizer == "words":
        assert all(c.tokens <= 40 for c in chunks)


def test_packer_by_hand():
    count = lambda t: len(t.split())
    units = ["a " * 9 + "a", "b " * 9 + "b", "c c c", "d " * 14 + "d"]
    assert [i for _, i in S.pack_texts(units, 16, 0, 0, " ", count)] == [[0], [1, 2], [3]]
    overlapped = S.pack_texts(["a b c d e f g h i j", "k l m n o p q r s t"], 16, 3, 0, " ", count)
    assert overlapped[1][0].split()[:3] == ["h", "i", "j"]
    assert [i for _, i in S.pack_texts(["x " * 12 + "x", "y " * 9 + "y", "z"], 16, 0, 5, " ", count)] == [[0], [1, 2]]


def test_one_character_over_the_cap():
    with pytest.raises(ValueError):
        S.hard_split("ab", 1, lambda t: 2 * len(t))


def test_fixed_overlap_is_strict(spark):
    df = spark.createDataFrame([("d", 1, " ".join(map(str, range(100))))], "document string, block_id int, text string")
    chunks = S.segment(df, S.SegmentSpec("fixed", 40, 10)).orderBy("chunk_id").collect()
    assert [c.text.split()[0] for c in chunks] == ["0", "31", "62"]


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, None)], "k int, t string")
    got = {r.k: r.score for r in R.bm25(df, "k", "t", ["cat", "cat"]).collect()}
    idf, avg = np.log(1 + (3 - 1 + 0.5) / 1.5), 2.5
    assert got[1] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / avg)))
    assert got[2] == got[3] == 0


def test_mmr():
    relevance, vectors = np.array([0.9, 0.89, 0.5, np.nan]), np.array([[1.0, 0], [1, 0.01], [0, 1], [0, 1]])
    assert R.mmr_order(relevance, vectors, 2, 1.0) == [0, 1]
    assert R.mmr_order(relevance, vectors, 2, 0.5) == [0, 2]
    assert R.mmr_order(relevance, vectors, 9, 0.5) == [0, 2, 1]


@pytest.mark.parametrize("k, order", [(2, [1, 2]), (3, [1, 3, 2]), (4, [1, 3, 4, 2]), (5, [1, 3, 5, 4, 2]), (6, [1, 3, 5, 6, 4, 2])])
def test_edges(spark, k, order):
    df = spark.range(1, k + 1).select(F.col("id").cast("int").alias("rank"), F.col("id").alias("chunk_id"))
    assert [r["rank"] for r in R.arrange(df, "edges").orderBy("position").collect()] == order


def test_cosine_of_zero_and_of_different_lengths(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(R.cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0
    bad = spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different lengths"):
        bad.select(R.cosine(F.col("a"), F.col("b")).alias("c")).collect()


def test_readers_send_different_prompts_and_survive_failures(spark):
    chunks = spark.createDataFrame([("d", i, f"part {i} the end", 4) for i in range(1, 7)], "document string, chunk_id int, text string, tokens int")

    def reply(prompt: str) -> str:
        if "part 3" in prompt and prompt.startswith(P.ASK) and "part 2" not in prompt:
            raise TimeoutError("no answer")
        return "the answer"

    got = P.read(chunks, "q?", mock_client(reply), P.ReadSpec("map_reduce", budget=50)).first()
    assert got.partial and got.answer == "the answer" and 3 not in got.chunks_used
    with pytest.raises(ValueError):
        P.read(chunks, "q?", mock_client(reply), P.ReadSpec("ensemble", members=("stuff", "stuff")))


def test_tree_and_backoff():
    assert [P.tree_levels(n, 5) for n in (0, 1, 2, 5, 6, 26)] == [0, 0, 1, 1, 2, 3]
    assert backoff(3, 7.0) == 7.0 and 4 <= backoff(3, rng=lambda: 0.0) <= 8


def test_skim_answers_from_evidence_past_the_budget(spark):
    """Evidence of the last chunk reaches the answer through merges that keep the words with "needle"."""
    def reply(prompt):
        head, _, body = prompt.partition("\n\n")
        return " ".join(w for w in body.split() if "needle" in w) or "nothing" if head.startswith((P.MERGE, P.ASK)) else body

    chunks = spark.createDataFrame([(d, i, " ".join([f"w{i}"] * 9 + [f"needle{d}{i}"]), 10) for d, n in (("a", 12), ("b", 2)) for i in range(1, n + 1)], "document string, chunk_id int, text string, tokens int")
    got = {r.document: r for r in P.read(chunks, "q", mock_client(reply), P.ReadSpec("skim", budget=40)).collect()}
    assert got["a"].answer.split() == [f"needlea{i}" for i in range(1, 13)] and not got["a"].partial
    assert got["a"].chunks_used == list(range(1, 13)) and got["a"].calls > 13
    assert got["b"].answer.split() == ["needleb1", "needleb2"] and got["b"].calls == 3


def test_mmr_chooses_out_of_all_rows(spark):
    """The second and third choice lie behind 300 rows that are alike."""
    data = [("a", i, 1 - i / 1e4, [1.0, i / 1e6, 0.0]) for i in range(300)] + [("a", 300, 0.5, [0.0, 1.0, 0.0]), ("a", 301, 0.4, [0.0, 0.0, 1.0])]
    data += [("b", i, float(x), v.tolist()) for i, (x, v) in enumerate(zip(np.random.default_rng(1).random(40), np.random.default_rng(2).normal(size=(40, 3)), strict=True))]
    got = R.mmr(spark.createDataFrame(data, "g string, k long, s double, v array<double>"), "k", "s", "v", 3, 0.5, "g").orderBy("g", "position").collect()
    want = {g: R.mmr_order(np.array([r[2] for r in data if r[0] == g]), np.array([r[3] for r in data if r[0] == g]), 3, 0.5) for g in "ab"}
    assert want["a"] == [0, 300, 301] and {g: [r.k for r in got if r.g == g] for g in "ab"} == want


def test_recursive_segments_look_at_little_text(spark, monkeypatch):
    """Documents reach Python in batches, and packing estimates a few times a document's characters, not a multiple for
    each separator."""
    from foliospark.functions import tokens as T

    blocks = spark.createDataFrame([("d", k, "One sentence; two parts, and a stop. " * 5) for k in range(40)], "document string, block_id int, text string")
    made = S.segment(blocks, S.SegmentSpec("recursive", 120, tokenizer="heuristic"))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    assert max(r.tokens for r in made.collect()) <= 120
    seen, by_run = [], T._by_run
    monkeypatch.setattr(T, "_by_run", lambda text: seen.append(len(text)) or by_run(text))
    text = "\n\n".join(r.text for r in blocks.collect())
    S.pack_texts(S.recursive_pieces(text, 120, T.estimate_tokens), 120, 0, 0, "", T.estimate_tokens)
    assert sum(seen) < 6 * len(text)


@pytest.mark.parametrize("text", ["a", " a", "a ", "  a  b \n\n c.\n\n\nd", "\n \n x", "end.\n\n", "stop...\n \n  (odd)", "it's\n", ".\n\n \n", "12345 a1 $b", "x.\n \n"])
def test_estimate_by_run_is_the_estimate_by_match(text):
    from foliospark.functions import tokens as T

    assert math.isclose(sum(T._by_run(text)), sum(T._by_match(text)))
    exact = T.estimate_tokens(text)
    assert [T.estimated_within(text, n) for n in (exact - 1, exact)] == [False, True]
