"""op1, op4, op9, op10: SQL, brute force and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import exact_dedup, fingerprint, line_dedup, near_dup, queries, url_filter
from tests.comparison import duck, rows

LONG = "word " * 9000
ODD = [
    (5, "a  b\tc"), (3, "a b c"), (4, "a b\nc"), (3, "a b c"), (None, "a b c"), (7, None), (8, ""), (9, " "), (1, LONG), (2, LONG + "x"),
    (10, "x" * 1024), (11, "x" * 1025), (12, "x" * 2048), (6, "日本語 𝔘𝔫𝔦"),
]


def frame(spark, data=None):
    """With extra columns whose names clash with those of results."""
    df = spark.createDataFrame(ODD if data is None else data, "doc_id long, text string")
    return df.withColumns({"kept": F.lit("x"), "level": F.lit(1), "name": F.lit("n"), "score": F.lit(0.5), "key": F.lit("k")})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert rows(queries.QUERIES[name](spark, sf_dir)) == duck(sf_dir, queries.ORACLES[name])


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_odd_inputs(spark):
    got = exact_dedup.exact_dedup(frame(spark)).collect()
    size = Counter(normal(t) for _, t in ODD)
    keep = {n: min((i for i, t in ODD if normal(t) == n and i is not None), default=None) for n in size}
    want = Counter((i, keep[normal(t)], size[normal(t)], i == keep[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in ODD)
    assert Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got) == want
    small = exact_dedup.exact_dedup(frame(spark), block_chars=3).collect()
    assert Counter(map(tuple, small)) == Counter(map(tuple, got))


def test_exact_dedup_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark).limit(0)).collect() == []


def test_block_names_without_a_proof_use_the_blocks(spark):
    blocks = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 2, "c"), (1, 1, "a")], "k1 long, k2 long, block string")
    names, by = exact_dedup._block_names(blocks)
    assert by == ["k1", "k2", "block"] and names.select("name").distinct().count() == 3


def test_exact_dedup_without_a_proof(spark, monkeypatch):
    """Keys that stand for several blocks: names come from the blocks, and nothing changes."""
    want = Counter(map(tuple, exact_dedup.exact_dedup(frame(spark), block_chars=3).collect()))
    monkeypatch.setattr(exact_dedup, "_key", lambda b: F.struct(F.length(b).alias("k1"), F.lit(0).cast("bigint").alias("k2")))
    assert Counter(map(tuple, exact_dedup.exact_dedup(frame(spark), block_chars=3).collect())) == want


def test_line_dedup_with_shared_digests(spark, monkeypatch):
    passage = "\n".join(f"line {k} of the passage" for k in range(12))
    other = "\n".join(f"row {k} of another text" for k in range(12))
    docs = frame(spark, [(2, f"own two\n{passage}\nend two"), (1, f"own one\n{passage}\nend one"), (3, other), (4, f"{other}\nend")])
    want = Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(docs).collect())
    monkeypatch.setattr(line_dedup, "_digest", lambda b: F.lit("same"))
    assert Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(docs).collect()) == want


def test_line_dedup_is_linear(spark):
    """A text of 200,000 lines that repeat an earlier one, all but the last."""
    body = "\n".join(f"{k}" for k in range(200_000))
    docs = frame(spark, [(1, body + "\na"), (2, body + "\nb")])
    for clean in (line_dedup.line_dedup, line_dedup.line_runs):
        began = time.perf_counter()
        got = {r.doc_id: r["text"] for r in clean(docs).collect()}
        assert got[1] == body + "\na" and got[2].endswith("b") and len(got[2]) < len(body) / 2
        assert time.perf_counter() - began < 20


def test_line_dedup_by_hand(spark):
    passage = "\n".join(f"line {k} of the passage" for k in range(12))
    data = [(2, f"own two\n{passage}\nend two"), (1, f"own one\n{passage}\nend one"), (3, None), (4, ""), (5, "\n\n\n"), (1, f"own one\n{passage}\nend one")]
    got = line_dedup.line_dedup(frame(spark, data)).collect()
    text = {r.doc_id: r["text"] for r in got}
    assert text[1] == data[1][1] and text[3] is None and text[4] == "" and text[5] == "\n\n\n"
    assert text[2].startswith("own two") and text[2].endswith("end two") and len(text[2]) < len(data[0][1]) / 2
    assert len(got) == 6 and set(got[0].asDict()) >= {"kept", "level", "key"}
    assert line_dedup.line_dedup(frame(spark).limit(0)).collect() == []


def test_line_dedup_keeps_unrepeated_text(spark):
    data = [(k, "\n".join(f"{k} {j}" for j in range(20))) for k in range(10)]
    assert all(r["__fs_removed"] == 0 for r in line_dedup.line_dedup(frame(spark, data)).collect())


def without_runs(data):
    """Brute force of line_runs for distinct ids."""
    seen, out = {}, {}
    for i, t in sorted(data):
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for lo, hi in zip(at, at[1:]):
            first = seen.setdefault((lines[lo], lines[hi]), (i, lo, hi))
            if first != (i, lo, hi):
                gone |= set(range(lo + (first[0] == i and first[2] == lo), hi + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_runs_take_out_every_short_passage(spark):
    """Passages of two to five lines, each of over 50 words, between lines of their own."""
    passages = [[" ".join(f"p{k}l{j}w{w}" for w in range(30)) for j in range(2 + k % 4)] for k in range(24)]
    data = [(100 * r + k, "\n".join([f"own {r} {k}", *p, f"end {r} {k}"])) for r in range(2) for k, p in enumerate(passages)]
    docs = frame(spark, data)
    got = {r.doc_id: r["text"] for r in line_dedup.line_runs(docs).collect()}
    assert got == {i: t if i < 100 else f"own 1 {i - 100}\nend 1 {i - 100}" for i, t in data}
    assert got == {r.doc_id: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}


def test_line_runs_against_brute_force(spark):
    draw = random.Random(7)
    data = [(i, "\n".join(draw.choice(["a", "b", "c", "d", "", " ", f"own {i}"]) for _ in range(draw.randrange(1, 9)))) for i in range(60)]
    data += [(100, "s\ns\ns\ns\ns"), (101, "x\n\ny"), (102, "x\ny\nz"), (103, "")]
    got = {r.doc_id: (r["text"], r["__fs_removed"], r["__fs_lines"]) for r in line_dedup.line_runs(frame(spark, data)).collect()}
    want = without_runs(data)
    assert {i: t for i, (t, _, _) in got.items()} == want and want[100] == "s\ns"
    assert {x for t in want.values() for x in t.split("\n") if x.strip()} == {x for _, t in data for x in t.split("\n") if x.strip()}
    odd = line_dedup.line_runs(frame(spark, [(1, None), (None, "a\nb"), (2, "a\nb"), (2, "a\nb")])).collect()
    assert Counter((r.doc_id, r["text"]) for r in odd) == Counter([(1, None), (None, "a\nb"), (2, ""), (2, "")])


def edited(docs):
    """Brute force of the contract's edited text for distinct ids."""
    order = sorted((i for i, _ in docs), reverse=True)
    text = {i: t or "" for i, t in docs}
    out = {}
    for k, i in enumerate(order):
        t, after = text[i], text[order[(k + 1) % len(order)]]
        n = len(t) // 3
        out[i] = t[: len(t) - n] + after[:n]
    return out


def test_fingerprints(spark):
    data = [(k * 5000, " ".join(f"w{(k * j) % 37}" for j in range(40 * k))) for k in range(1, 9)] + [(-3, None), (7, "日本語 𝔘𝔫𝔦 x"), (8, "日本語 𝔘𝔫𝔦 x"), (2, "a b"), (90000, LONG)]
    got = {r.doc_id: r for r in fingerprint.document_fingerprints(frame(spark, data)).collect()}
    want = edited(data)
    assert {i: r.edited_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert all(r.n_chars == len(dict(data)[i] or "") for i, r in got.items())
    assert got[7].fingerprint == got[8].fingerprint and got[8].near_next == 1.0 and got[-3].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def brute_fingerprint(text):
    """Order MinHash in plain Python: xxh64 as Spark chains it, one bucket after another."""
    import xxhash

    def digest(*values):
        seed = 42
        for v in values:
            b = v.encode() if isinstance(v, str) else struct.pack("<q", v) if isinstance(v, Wide) else struct.pack("<i", v)
            seed = xxhash.xxh64(b, seed=seed).intdigest()
        return Wide(seed - (1 << 64) if seed >> 63 else seed)

    class Wide(int):
        pass

    pieces = []
    for run in re.findall(r"[^ \t\n\x0b\f\r]+", text):
        i = 0
        while i < len(run):
            rest = len(run) - i
            n = rest if rest <= fingerprint.PIECE else 1 if i >= fingerprint.LONG or rest > fingerprint.LONG else fingerprint.PIECE
            pieces.append(run[i : i + n])
            i += n
    h = [digest(p) for p in pieces]
    k = fingerprint.K
    grams = [digest(*h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [digest(*h)] if h else []
    seen, parts = Counter(), {}
    for i, g in enumerate(grams):
        name = Wide(g >> fingerprint.POSITION_BITS)
        m = digest(name, seen[name]) & (1 << 64) - 1
        seen[name] += 1
        parts.setdefault(m >> 58, []).append((m >> 32, i))
    out = ""
    for b in sorted(parts):
        chosen = sorted(sorted(parts[b])[: fingerprint.TUPLE], key=lambda x: x[1])
        out += f"{b:02x}{digest(*(Wide(m & (1 << 26) - 1) for m, _ in chosen)) & 0xFFFFFFFF:08x}"
    return out


def cells(fp):
    return [fp[i : i + 10] for i in range(0, len(fp), 10)]


def brute_likeness(a, b):
    a, b = cells(a), cells(b)
    either = {x[:2] for x in a + b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def test_fingerprints_equal_plain_python(spark):
    draw = random.Random(3)
    words = ["the", "of", "internationalisation", "a", "日本語", "x" * 26, "42", "é𝔘"]
    data = [(k * 999, " ".join(draw.choice(words) for _ in range(k * k))) for k in range(14)]
    data += [(1, "".join(chr(draw.randrange(0x4E00, 0x4F00)) for _ in range(300))), (2, None), (3, "x" * 30 + "\t" + "y" * 49), (4, "日本語 x")]
    order = sorted((i for i, _ in data), reverse=True)
    text, changed = {i: t or "" for i, t in data}, edited(data)
    got = {r.doc_id: r for r in fingerprint.document_fingerprints(frame(spark, data)).collect()}
    for k, i in enumerate(order):
        own, after = brute_fingerprint(text[i]), brute_fingerprint(text[order[(k + 1) % len(order)]])
        efp = brute_fingerprint(changed[i])
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, efp)
        assert got[i].near_edited == pytest.approx(brute_likeness(own, efp)) and got[i].near_next == pytest.approx(brute_likeness(own, after))


@pytest.mark.parametrize("space", ["", "x"])
def test_fingerprints_of_text_without_spaces(spark, space):
    """One code point put in at the start or in the middle of 4,000 changes little."""
    draw = random.Random(4)
    t = "".join(chr(draw.randrange(0x4E00, 0x9FA5)) if not space else draw.choice("abcdefghij0123456789") for _ in range(4000))
    df = spark.createDataFrame([(0, t), (1, "新" + t), (2, t[:2000] + "新" + t[2000:]), (3, t[::-1])], "doc_id long, text string")
    fp = {r.doc_id: r.f for r in fingerprint.fingerprint_columns(df, "text", "fp").select("doc_id", fingerprint.as_text(F.col("fp")).alias("f")).collect()}
    near = [brute_likeness(fp[0], fp[k]) for k in range(4)]
    assert near[0] == 1 and near[1] > 0.9 and near[2] > 0.9 and near[3] < 0.2


def test_fingerprints_of_a_very_long_text(spark):
    """More k-mers than 24 bits number is no limit; here the work grows with the length."""
    df = spark.createDataFrame([(0, "ab c " * 400_000), (1, "ab c " * 400_000 + "d")], "doc_id long, text string")
    a, b = (r.f for r in fingerprint.fingerprint_columns(df, "text", "fp").orderBy("doc_id").select(fingerprint.as_text(F.col("fp")).alias("f")).collect())
    assert brute_likeness(a, b) > 0.9


def test_fingerprints_follow_edits(spark):
    words = [f"word{k}" for k in range(600)]
    moved = words[300:] + words[:300]
    texts = {1: words, 2: [*words[:300], "new", *words[301:]], 3: moved, 4: [f"other{k}" for k in range(600)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    out = fingerprint.fingerprint_columns(df, "text", "fp")
    pairs = out.alias("a").crossJoin(out.alias("b")).filter("a.doc_id = 1").select(F.col("b.doc_id").alias("i"), fingerprint.likeness(F.col("a.fp"), F.col("b.fp")).alias("x"))
    near = {r.i: r.x for r in pairs.collect()}
    assert near[1] == 1 and near[2] > 0.9 and near[4] < 0.05 and near[3] < near[2]


def test_next_descending_with_repeated_and_null_ids(spark):
    data = [(None, "abc def"), (4, "x y z"), (4, "x y z"), (2**40, "k")]
    assert fingerprint.document_fingerprints(frame(spark, data)).count() == 4
    ids = spark.createDataFrame([(v,) for v in (-(2**63), -5, 0, 4095, 4096, 2**30, 2**62)], "v long")
    got = {r.v: r.next for r in fingerprint.next_descending(ids).collect()}
    order = sorted(got, reverse=True)
    assert got == {v: order[(k + 1) % len(order)] for k, v in enumerate(order)}
    assert fingerprint.document_fingerprints(frame(spark).limit(0)).collect() == []


def brute(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[3], max(fits)[4]) if fits else (None, default)))


def test_urls(spark):
    urls = [
        "http://A.Example.COM/en/1?x#y", "http://example.com/en", "https://www.example.com/en/", "http://notexample.com/en/1", "ftp://x.net/fr/#", "http://net/es/..", "http://net", "no url", None, "", "http://://",
        "http://ÄB.net/fr/1", "http://u@h.com:80/en/x", "http://.com/", "http://a..com/", "http://example.com/enormous", "http://example.com/en/1", "http://example.com/en/1", "http://" + "a." * 300 + "net/es/x",
    ]
    rules = [*url_filter.RULES, ("block", "example.com", "/eno"), ("allow", "net", ""), ("block", "", "/x")]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "verdict": F.lit("v")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rule_frame(spark, rules)).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(urls)}
    assert url_filter.url_filter(pages.limit(0), url_filter.rule_frame(spark, rules)).collect() == []


def test_urls_with_very_long_hosts(spark):
    urls = ["http://" + "a." * n + "example.com/en/" + "b/" * n for n in (1, 60_000)] + ["http://" + "x" * 100_000 + ".net/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rule_frame(spark, url_filter.RULES)).collect()}
    assert got == {k: brute(u, url_filter.RULES) for k, u in enumerate(urls)}


def test_near_copies_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 1500)
    text = " ".join(f"w{k}" for k in range(3000))
    got = near_dup.near_duplicates(frame(spark, [(1, text), (2, text + " end"), (3, "a b c")])).collect()
    assert {r.doc_id: (r.class_id, r.kept) for r in got} == {1: (1, True), 2: (1, False), 3: (3, True)}
