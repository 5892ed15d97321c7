from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import clean as C
from foliospark.functions import text as X
from foliospark.functions import tokens as T
from foliospark.functions.tokens import estimate_tokens


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_sentences(spark):
    text = "Dr. Smith saw 3.5 cases. He left (e.g. at noon). Then: \"Yes.\" It rained! ok"
    assert one(spark, X.sentences_of, text) == ["Dr. Smith saw 3.5 cases.", "He left (e.g. at noon).", 'Then: "Yes." It rained! ok']
    assert one(spark, X.sentences_of, "今日は晴れ。明日は雨。") == ["今日は晴れ。", "明日は雨。"]
    assert one(spark, X.sentences_of, None) == [] and one(spark, X.sentences_of, " \n ") == []


def test_terms(spark):
    assert one(spark, X.lexical_terms, "The Größe, a x-ray 12") == ["the", "größe", "ray", "12"]
    assert one(spark, X.lexical_terms, "東京都") == ["東京", "京都"]
    assert one(spark, X.lexical_terms, None) == []


def test_not_found(spark):
    yes = ["", None, "NOT_IN_DOCUMENT", "**NOT_IN_DOCUMENT.**", "not in document", "NOT_IN_DOCUMENT. It is about costs.", "NOT IN DOCUMENT: no"]
    no = ["The log said NOT_IN_DOCUMENT, but revenue rose.", "Not in document form; a table", "NOT_IN_DOCUMENT is what was printed"]
    assert all(one(spark, X.is_not_found, v) for v in yes)
    assert not any(one(spark, X.is_not_found, v) for v in no)


def test_cleaners(spark):
    run = lambda name, v: one(spark, C.CLEANERS[name].run, v)
    assert run("hyphenation", "mito-\nchondria LIA-\nBLE follow-\nup, a follow-up 18-\n65 Anglo-\nSaxon") == "mitochondria LIABLE follow-up, a follow-up 18-\n65 Anglo-\nSaxon"
    assert run("page_numbers", "Page 4 of 9\nthe total was\n1200.\nIt ended.\n12.\n- 3 -\n7") == "\nthe total was\n1200.\nIt ended.\n\n\n7"
    assert run("control_chars", "a​b\x07c\td‍e") == "ab c\td‍e"
    assert run("collapse_whitespace", "  a  b \n\n\n\n c ") == "a b\n\nc"
    assert run("references", "body " * 20 + "\nReferences\nA. Author") == "body " * 20 + "\n"
    assert run("references", "References\n" + "body " * 20) == "References\n" + "body " * 20
    assert run("headers_footers", "Head\na\n\nHead\nb\n\nHead\nc") == "a\n\nb\n\nc"


def test_clean_log_order(spark):
    df = spark.createDataFrame([(1, "x 12  http://a.b c")], "k int, t string")
    log = C.clean_log(df, "k", "t", ["remove_numbers", "urls"]).orderBy("step_no").collect()
    assert [(r.step, r.stage) for r in log] == [("urls", "early"), ("remove_numbers", "late")]


def test_token_estimate():
    assert estimate_tokens(None) == estimate_tokens(" \n") == 0
    assert estimate_tokens("the cat sat") == 6
    assert estimate_tokens("東京") == 6
    assert estimate_tokens("\U0001f600") == 10
    assert estimate_tokens("1\n2\n3") >= 8


def test_truncation_by_tokens(spark):
    words = lambda t: len(t.split())
    assert T.truncate_text("a b c", 3, words) == "a b c" and T.truncate_text("a  b c d e f", 5, words) == "a  b c d [...]"
    assert T.truncate_text("a b c d", 2, words) == "a b"
    letters = lambda t: len(t)
    assert T.truncate_text("ab " + "x" * 40, 20, letters, "") == "ab " + "x" * 17
    got = spark.createDataFrame([("word " * 500,), ("short",), (None,)], "t string").select(T.truncate_tokens(F.col("t"), 50).alias("c")).collect()
    assert T.estimate_tokens(got[0].c) <= 50 and got[0].c.endswith(" [...]") and got[1].c == "short" and got[2].c is None


def test_counts_with_a_vocabulary_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    T.register_vocabulary("bytes", path)
    library = Tokenizer.from_file(path)
    texts = ["hello there", "日本語", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.count_tokens(F.col("t"), "bytes").alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: len(library.encode(t or "", add_special_tokens=False).ids) for t in texts}


def test_heuristic_counts_are_the_function(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", T.count_tokens(F.col("text")).alias("n")).collect()
    assert all(r.n == T.estimate_tokens(r.text) for r in rows)


def test_sparse_vectors_against_plain_python(spark, sf_dir):
    """Hashed bags of terms: xxh64 of the term, 1 + ln of its count, unit length."""
    import math
    from collections import Counter

    import xxhash

    from foliospark.operators import rank as R

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", X.lexical_terms(F.col("text"), 3).alias("terms"))
    got: dict = {}
    for r in R.lexical_embed(docs, "doc_id", "text").collect():
        got.setdefault(r.doc_id, {})[r.slot] = r.weight
    for r in docs.collect():
        slots = Counter((xxhash.xxh64(t.encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(t.encode(), seed=42).intdigest() >> 63)) % 512 for t in r.terms)
        size = math.sqrt(sum((1 + math.log(n)) ** 2 for n in slots.values()))
        assert got.get(r.doc_id, {}).keys() == slots.keys()
        assert all(abs(got[r.doc_id][k] - (1 + math.log(n)) / size) < 1e-9 for k, n in slots.items())
