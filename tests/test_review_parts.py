from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark import catalogue
from foliospark.operators import extract as E
from foliospark.operators import model as M
from foliospark.operators import rank as K
from foliospark.operators import records as R
from foliospark.operators import review as V
from foliospark.operators import screen as S
from foliospark.operators import verify as Q
from foliospark.sources import bibliography as B
from foliospark.sources import files as D

SOURCE = "Mortality fell by 25% in 1,204 patients who were not treated with aspirin at the start of the trial."


@pytest.mark.parametrize(
    "quote, status",
    [
        ("Mortality fell by 25%", "verbatim"), ("fell by 5%", "unverified"), ("mortality  FELL by 25%", "verbatim"),
        ("1,204 patients who were not treated with asprin at the start of the trial", "near_verbatim"),
        ("1,205 patients who were not treated with aspirin at the start of the trial", "unverified"),
        ("1,204 patients who were treated with aspirin at the start of the trial", "unverified"), ("", "unverified"),
    ],
)
def test_quotes(quote, status):
    assert Q.match_quote(SOURCE, quote)[0] == status


def test_elision():
    assert Q.in_order(SOURCE, "Mortality fell ... 1,204 patients")
    assert not Q.in_order(SOURCE, "patients ... treated with aspirin")
    assert not Q.in_order(SOURCE, "1,204 patients ... Mortality fell")


@pytest.mark.parametrize("text, value", [("1,204 people", 1204), ("2.5 million", 2.5e6), ("25%", 0.25), ("1 in 5 died", 0.2), ("one hundred and five", 105), ("twenty-five", 25), ("-3.5 points", -3.5), ("1/4 of all", 0.25)])
def test_numbers(text, value):
    assert Q.value_among(value, text)


def test_citations(spark):
    df = spark.createDataFrame([("See [chunk 1, 3-5; p. 40] and [Chunks 7 and 9], not [chunk nine] or [12].",)], "answer string")
    r = df.select(Q.cited_ids(F.col("answer"), "chunk").alias("c"), Q.unparsed_citations(F.col("answer"), "chunk").alias("u")).first()
    assert r.c == [1, 3, 4, 5, 7, 9] and r.u == ["[chunk nine]"]
    study = spark.createDataFrame([("[studies 1-3] [study 5]",)], "answer string").select(Q.cited_ids(F.col("answer"), "study").alias("c")).first()
    assert study.c == [1, 2, 3, 5]


def test_wilson_and_agreement(spark):
    low, high = S.wilson(F.col("x"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (0, 10), (5, 10)], "x int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert rows[0].l is None and rows[1].l == 0 and rows[2].l == pytest.approx(0.2366, abs=1e-4) and rows[2].h == pytest.approx(0.7634, abs=1e-4)
    pairs = [(True, True)] * 40 + [(True, False)] * 9 + [(False, True)] * 6 + [(False, False)] * 45
    got = S.agreement(spark.createDataFrame(pairs, "x boolean, y boolean"), "x", "y").first()
    assert got.kappa == pytest.approx(0.7, abs=0.01) and got.pabak == pytest.approx(0.7)
    assert S.kappa_interval(40, 9, 6, 45) is not None and S.kappa_interval(5, 0, 0, 5) is None


@pytest.mark.parametrize("said, kind, value", [("1,204", "integer", 1204), ("1,5", "number", None), ("0,85", "number", 0.85), ("3 million", "integer", None), ("No.", "boolean", False), ("None", "string", "None"), ("not reported", "string", None), ("2 and 3", "number", None), ("1.5e3", "number", 1500.0)])
def test_coercion(spark, said, kind, value):
    got = spark.createDataFrame([(said,)], "v string").select(E.coerce(F.col("v"), E.Field("f", kind)).alias("x")).first().x
    assert got == value


def test_fields_refuse_bad_names():
    for name in ("1x", "a__quote", "status"):
        with pytest.raises(ValueError):
            E.Field(name, "string")


def test_bibliography():
    ris = "TY  - JOUR\nTI  - A long\n  title\nAU  - Doe, J\nAU  - Roe, R\nPY  - 2019/05\nSP  - 1\nEP  - 9\nER  - \n"
    assert B.parse_export(ris)[0] | {} == {"type": "JOUR", "title": "A long title", "authors": "Doe, J; Roe, R", "year": "2019/05", "pages": "1-9"}
    bib = '@string{j = "Journal"}\n@article{k, title = {The {DNA} of M{\\"u}ller}, author = {M{\\"u}ller, A and Roe, B}, journal = j # " of X", year = 2020}'
    got = B.parse_export(bib)[0]
    assert got["title"] == "The DNA of Müller" and got["venue"] == "Journal of X" and got["authors"] == "Müller, A; Roe, B"
    assert B.parse_export("nothing") == []


def test_title_dedupe_needs_one_group(spark):
    rows = [
        (1, "Effects of aspirin on mortality", "2019", "Smith, J", "Lancet", None), (2, "Effects of Aspirin on Mortality.", "2019", "Smith J", "The Lancet", None),
        (3, "Effects of aspirin on mortality", "2019", "Jones, K", "Lancet", None), (4, "Short", "2019", "Smith, J", "Lancet", None), (5, "Short", "2019", "Smith, J", "Lancet", None),
    ]
    df = R.finish_records(spark.createDataFrame(rows, "record_id long, title string, year string, authors string, venue string, doi string"))
    assert {r.record_id: r.duplicate_of for r in R.dedupe_by_title(df).collect()} == {1: None, 2: 1, 3: None}


@pytest.mark.parametrize(
    "one, two, same",
    [
        ("van der Berg, Jan", "Berg, J", True), ("Jan van der Berg", "Berg, Jan", True), ("Wei, Zhang", "Zhang, Wei", True), ("Smith, J", "Smith, K", False),
        ("WHO Study Group", "WHO Study Group", True), ("WHO Study Group", "Group, W", False), ("Smith, J", None, True), ("Smith J", "J Smith", True),
    ],
)
def test_titles_are_one_work_by_author(spark, one, two, same):
    rows = [(1, "Effects of aspirin on mortality", "2019", one), (2, "Effects of aspirin on mortality", "2019", two)]
    df = R.finish_records(spark.createDataFrame(rows, "record_id long, title string, year string, authors string"))
    assert {r.record_id: r.duplicate_of for r in R.dedupe_by_title(df).collect()} == {1: None, 2: 1 if same else None}


def test_a_large_block_of_one_title(spark):
    """Thirty thousand different records of one title and year: no limit, and time follows the records."""
    df = spark.range(1, 30_001).select(F.col("id").alias("record_id"), F.lit("One title that all of them have").alias("title"), F.lit("2019").alias("year"), F.concat(F.lit("Name"), (F.col("id") % 15_000).cast("string"), F.lit(", A")).alias("authors"), F.concat(F.lit("Journal "), (F.col("id") % 3).cast("string")).alias("venue"))
    df = df.withColumn("venue", F.when(F.col("record_id") > 15_000, F.lit(None)).otherwise(F.col("venue")))
    assert R.dedupe_by_title(R.finish_records(df)).filter("duplicate_of is not null").count() == 15_000


def test_figures():
    assert V.figures_in("About 45.2 million [study 3] and 12,400")[0][1:] == (45.2e6, 0.05e6, "about")
    assert V.figure_backed(1200, 0.5, "about", [("row", 1234.0)]) == "row (approximate)"
    assert V.figure_backed(1200, 0.5, "exact", [("row", 1234.0)]) is None


def test_render_citations():
    keys = {1: "Doe, 2019", 2: "Roe, 2020"}
    assert V.render_citations("Rises [study 2][study 1].", keys) == "Rises (Doe, 2019; Roe, 2020)."
    assert V.render_citations("Rises [study 9].", keys) == "Rises [study 9]."


def test_html_and_markdown_and_docx():
    html = b"<html><head><style>x</style></head><body><h1>T</h1><p>a<b>b</b> c</p><table><tr><td>1</td><td>2</td></tr></table><pre>x\n y</pre></body></html>"
    assert D.extract_html(html, {}) == [("T", None, "T", "heading"), ("ab c", None, "T", "body"), ("1 | 2", None, "T", "table"), ("x\n y", None, "T", "code")]
    md = b"# Head\ntext\n\n```py\n# no heading\n```\n| a | b |\n| 1 | 2 |\nend"
    assert [(b[0], b[3]) for b in D.extract_markdown(md, {})] == [("Head", "heading"), ("text", "body"), ("# no heading", "code"), ("| a | b |\n| 1 | 2 |", "table"), ("end", "body")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style><w:style w:styleId="X"><w:name w:val="mine"/><w:basedOn w:val="H"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="X"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    assert D.extract_docx(raw.getvalue(), {}) == [("Top", None, "Top", "heading"), ("body", None, "Top", "body")]


def test_charsets():
    assert D.decode("é".encode("utf-16")) == "é" and D.decode(b"\xe9") == "é" and D.decode("abcd".encode("utf-16-le")) == "abcd"


def test_running_lines():
    pages = [f"Journal of X\nbody {k}\nPage {k}" for k in range(4)]
    assert D.drop_running_lines(pages, depth=1) == [f"body {k}" for k in range(4)]


def test_bad_files_are_rows(spark):
    df = spark.createDataFrame([("a.docx", bytearray(b"no zip")), ("b.md", bytearray(b"# x")), ("c.pdf", bytearray(b""))], "path string, content binary")
    got = {(r.document, r.error is None) for r in D.extract(df).collect()}
    assert ("a.docx", False) in got and ("b.md", True) in got


def test_title_keys_of_all_documents(spark, sf_dir):
    keys = {r.doc_id: r.title_key for r in catalogue.QUERIES["q_title_key"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert keys.keys() == texts.keys() and any("ß" in (t or "")[:200] for t in texts.values())
    assert not any(c in k for k in keys.values() if k for c in "ßæœ") and max(len(k) for k in keys.values() if k) > 200


def test_governor_judges_all_requests_across_ranges(spark, sf_dir):
    got = catalogue.QUERIES["q_governor"](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/events.parquet").count() > 600
    rows = spark.range(0, 20000, 7).select(F.col("id").alias("step"), F.lit("m").alias("model"), F.lit(1).alias("tokens_in"), F.lit(1).alias("max_output"), F.lit(0.01).alias("worst_usd"))
    out = M.admit(rows, M.Governor(max_calls=2000, max_cost_usd=25.0), "step")
    refused = {r.step: r.refused for r in out.select("step", "refused").collect()}
    assert refused == {s: "calls" if k >= 2000 else None for k, s in enumerate(range(0, 20000, 7))}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window [" in plan and "partitioning" in plan and plan.count("SinglePartition") == 1  # the ranges' totals


def test_outline_distance_of_all_parts_against_pairs(spark, sf_dir):
    """Every pair of parts by brute force."""
    parts = [(r.p_partkey, r.p_size) for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").collect()]
    units = [(k, -k if k % 11 == 0 else z % 6, -k if k % 13 == 0 else z % 4) for k, z in parts if k % 11 or k % 13]
    pairs = [(x, y) for i, x in enumerate(units) for y in units[i + 1 :]]
    want = sum((x[1] == y[1]) != (x[2] == y[2]) for x, y in pairs) / len(pairs)
    assert catalogue.QUERIES["q_outline_distance"](spark, sf_dir).collect()[0].distance == round(want, 9)


def test_global_rank_with_ties_nulls_and_one_hot_value(spark):
    data = [(k, None if k % 10 == 0 else 7 if k % 3 else k) for k in range(500)]
    df = spark.createDataFrame(data, "k long, v long")
    got = [r.k for r in K.global_rank(df, "n", F.desc_nulls_last("v"), "k").orderBy("n").collect()]
    assert got == [k for k, v in sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    assert [r.n for r in K.global_rank(df, "n", "k").orderBy("k").select("n").collect()] == list(range(1, 501))


def test_prefilter_without_a_hit_spreads_over_the_order(spark):
    df = spark.createDataFrame([(k, 0.0) for k in range(1, 101)], "k long, s double")
    assert sorted(r.k for r in K.rerank_prefilter(df, 4, "s", "k").collect()) == [13, 38, 63, 88]
    assert K.rerank_prefilter(df.limit(0), 4, "s", "k").collect() == []
    hits = df.withColumn("s", F.when(F.col("k") > 97, F.col("k") * 1.0).otherwise(0.0))
    assert sorted(r.k for r in K.rerank_prefilter(hits, 4, "s", "k").collect()) == [1, 98, 99, 100]


def test_pages_of_quotations(spark):
    blocks = spark.createDataFrame([("d", 1, "Growth was slow in the north, we said.", 1), ("d", 2, "Growth was slow in the south.", 2), ("d", 3, "growth was  slow", 2), ("e", 1, "Growth was slow", 9), ("d", 4, None, 3)], "document string, block_id int, text string, page int")
    quotes = [("d", "slow in the north"), ("d", "Growth was slow"), ("d", "in the south"), ("d", "rowth"), ("d", "..."), ("d", None), ("e", "GROWTH WAS"), ("x", "slow")]
    got = {(r.document, r.quote): r.page for r in Q.resolve_pages(spark.createDataFrame(quotes, "document string, quote string"), blocks).collect()}
    assert got == dict(zip(quotes, [1, None, 2, None, None, None, 9, None], strict=True))


def test_unstudied_combinations_are_listed_up_to_the_report(spark):
    studies = spark.createDataFrame([("a1", "b1")], "x string, y string")
    values = [f"a{k}" for k in range(9)], [f"b{k}" for k in range(9)]
    some, every = (V.combination_gaps(studies, "x", "y", *values, most=m).collect() for m in (40, None))
    assert len(some) == 40 and len(every) == 80 and [r.detail for r in some][:2] == ["a0 / b0", "a0 / b1"]


def test_a_cache_that_is_a_plan_runs_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def answer(prompt):
        runs.add(1)
        return prompt.upper()

    client = M.mock_client(answer)
    asked = spark.createDataFrame([(k, f"p{k % 5}") for k in range(20)], "k long, prompt string")
    cache = M.cacheable(M.call(asked.filter("k < 3"), client))
    got = M.call(asked, client, cache).collect()
    assert {(r.prompt, r.reply, r.cached) for r in got} == {(f"p{k}", f"P{k}", k < 3) for k in range(5)} and len(got) == 20
    assert runs.value == 5


def test_a_citation_may_list_thousands(spark):
    """Thousands of ids in one marker: the pattern keeps no stack frame an id."""
    text = "Shown [studies " + ", ".join(map(str, range(1, 20_001))) + ", p. 4]. More [study unknown]."
    df = spark.createDataFrame([(text,)], "answer string")
    r = df.select(F.size(Q.cited_ids(F.col("answer"), "study")).alias("c"), Q.unparsed_citations(F.col("answer"), "study").alias("u")).first()
    assert r.c == 20_000 and r.u == ["[study unknown]"]


def test_letters_beyond_zz_stay_apart(spark):
    made = spark.range(1, 20_001).select("id", V.letters(F.col("id")).alias("c"))
    got = {r.id: r.c for r in made.collect()}
    assert [got[k] for k in (1, 26, 27, 702, 703, 729, 3433)] == ["a", "z", "aa", "zz", "{a", "|a", "\u00e4a"] and len(set(got.values())) == 20_000
