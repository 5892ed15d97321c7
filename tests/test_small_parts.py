"""Sentences and words of review prose, the normal form of quotations, evidence, reference sheets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import screen as S
from foliospark.operators import verify as V

PROSE = "Rates fell in e.g. Spain. [study 1] Others rose!  [studies 2, 3]; [study 4]. A third group stayed [study 5].\n\nNew part? Yes."


def test_sentences_keep_their_citations_and_places(spark):
    row = spark.createDataFrame([(PROSE,), (None,), ("[study 1] opens.",)], "t string").select("t", X.review_sentences(F.col("t")).alias("s"), X.sentence_spans(F.col("t")).alias("at"), X.prose_words(F.col("t")).alias("n")).collect()
    assert row[0].s == ["Rates fell in e.g.", "Spain. [study 1]", "Others rose! [studies 2, 3]; [study 4].", "A third group stayed [study 5].", "New part?", "Yes."] or row[0].s[-2:] == ["New part?", "Yes."]
    assert [PROSE[x["start"] : x["end"]] == x.sentence for x in row[0]["at"] if "  " not in PROSE[x["start"] : x["end"]]].count(False) <= 1
    assert row[1].s == [] and row[1]["at"] == [] and row[2].s == ["[study 1] opens."]
    marks = "# Heading line here\n- one two [study 3]\n2. three\nfour five"
    assert spark.createDataFrame([(marks,)], "t string").select(X.prose_words(F.col("t"))).first()[0] == 5


SAMPLES = ["“Quoted”  text", "ﬁne ﬂow", "ＦＵＬＬ　ｗｉｄｔｈ　５０％", "a b c", "Straße", "½ cup … more", "x² and 10⁻³", "soft­hyphen", "ÀÉ ÎÕ", "  \t trim \n me ", "日本語 テスト", ""]


def test_both_normal_forms_agree(spark):
    got = spark.createDataFrame([(s,) for s in SAMPLES], "t string").select("t", V.normalise_column(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {s: V.normalise(s) for s in SAMPLES}
    assert V.normalise(SAMPLES[0]) == '"quoted" text' and V.normalise(SAMPLES[2]) == "full width 50%"


SOURCE = "The trial enrolled 1,204 adults. Mortality fell by 25% in the treated group, but not in controls. Follow-up took two years in all centres."


@pytest.mark.parametrize(
    "quote, kind, verified, status",
    [
        ("Mortality fell by 25%", "quote", True, "verbatim"), ("mortality fell … in the treated group", "quote", True, "elided"), ("Mortality fell ... in controls", "quote", False, "unverified"),
        ("Mortality fell by 26% in the treated group, but not in controls", "quote", False, "unverified"), ("Follow-up took two years in al centres", "quote", False, "near_verbatim"),
        ("anything", "answer", None, None), (None, "quote", False, "unverified"), ("Folloｗ－up took two years", "quote", True, "verbatim"),
    ],
)
def test_evidence_is_verified(spark, quote, kind, verified, status):
    evidence = spark.createDataFrame([("d", 1, quote, kind)], "document string, chunk_id int, text string, kind string")
    sources = spark.createDataFrame([("d", 1, SOURCE)], "document string, chunk_id int, text string")
    r = V.verify_evidence(evidence, sources, ["document", "chunk_id"]).first()
    assert (r.verified, r.quote_status) == (verified, status)
    assert (r.quote_coverage is None) == (kind == "answer") and (r.quote_coverage is None or 0 <= r.quote_coverage <= 1)
    assert V.verify_evidence(evidence.withColumn("document", F.lit("x")), sources, ["document", "chunk_id"]).first().verified is (None if kind == "answer" else False)


def test_reference_sheets_come_back_from_spreadsheets(spark, tmp_path):
    screening = spark.createDataFrame([(f"d{k}", "exclude" if k % 2 else "include") for k in range(20)], "document string, decision string")
    S.write_reference_csv(S.reference_sample(screening, 4), str(tmp_path / "sheet"))
    back = S.read_reference_csv(spark, str(tmp_path / "sheet")).collect()
    assert len(back) == 4 and {r.human_decision for r in back} == {None} and {r.frame_n for r in back} == {10}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "edited.csv").write_bytes("Human_Decision;document;frame_n;sampled_from\r\nInclude;d1;10;excluded\r\nperhaps;\"d;3\";x;excluded\r\n;;;\r\n".encode("utf-16"))
    got = {r.document: (r.human_decision, r.frame_n, r.sampled_from) for r in S.read_reference_csv(spark, str(tmp_path / "a")).collect()}
    assert got == {"d1": ("include", 10, "excluded"), "d;3": (None, None, "excluded")}


@pytest.mark.parametrize(
    "text, value",
    [
        ("fünfundzwanzig Patienten", 25), ("zweihundertdreissig Fälle", 230), ("dreitausend Betten", 3000), ("vingt-cinq malades", 25), ("quatre-vingt-dix-sept cas", 97), ("soixante et onze cas", 71), ("deux cent trente", 230),
        ("treinta y dos casos", 32), ("veintidós casos", 22), ("dos mil trescientos", None), ("mil doscientos", None), ("共有一千二百零三人", 1203), ("二〇一九年", 2019), ("三万五千", 35000), ("Chapter XIV", 14), ("the mix of it", None), ("a civil matter", None),
        ("zwölf Millionen", 12e6),
    ],
)
def test_numbers_in_other_words(text, value):
    found = V.quote_numbers(text)
    assert (value in found) if value is not None else not any(x > 2000 or x in (14, 1009) for x in found)


def test_sections_are_told_by_headings(spark):
    from foliospark.operators import segment as G
    from foliospark.operators.model import mock_client

    blocks = [("a", 1, "1. Introduction"), ("a", 2, "Body of it."), ("a", 3, "METHODS AND DATA"), ("a", 4, "We did this."), ("a", 5, "And that."), ("a", 6, "Appendix B"), ("b", 1, "No heading here, a sentence."), ("b", 2, "2 apples were eaten")]
    df = spark.createDataFrame(blocks, "document string, block_id int, text string")
    chunks = G.segment(df, G.SegmentSpec("structural", 100))
    got = [(r.document, r.section, r.text) for r in chunks.orderBy("document", "chunk_id").collect()]
    assert got == [("a", "1. Introduction", "## 1. Introduction\n\nBody of it."), ("a", "METHODS AND DATA", "## METHODS AND DATA\n\nWe did this.\n\nAnd that."), ("a", "Appendix B", "## Appendix B\n\nAppendix B"), ("b", None, "No heading here, a sentence.\n\n2 apples were eaten")]
    said = G.with_model_context(chunks, mock_client(lambda p: "" if "apples" in p else "What it is about.\nMore"), "src").orderBy("document", "chunk_id").collect()
    assert said[0].text == "[What it is about.]\n" + said[0].source_text and said[3].text.startswith("[src | Part 1 of 1]")


def test_inventory_by_status_of_documents_without_text_or_language(spark, tmp_path):
    """As the SQL has it, only every eleventh document is an empty file, and a document without a language has its ending."""
    from foliospark import catalogue
    from tests.comparison import duck, rows

    docs = spark.createDataFrame([(k, None if k % 7 == 3 else "en", 0 if k % 4 == 1 else k) for k in range(60)], "doc_id long, lang string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    name = "q_inventory_by_status"
    assert rows(catalogue.QUERIES[name](spark, str(tmp_path))) == duck(str(tmp_path), catalogue.ORACLES[name])
