"""Near copies, mixing, token files, archives, URL filter, main text, and the pipeline."""

import itertools
import math
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowspark.llm import common, token_files
from flowspark.llm.html_blocks import TRAINING_PAGES, Model, _expectations, blocks_of, extract_text, fit, labelled_pages, main_text
from flowspark.llm.mixing import mix, mix_report
from flowspark.llm.near_copies import group_copies, keep_one, prefix_size
from flowspark.llm.quality_lines import judge
from flowspark.llm.token_files import (
    WordIds,
    canonical,
    code_lengths,
    decode_block,
    decode_table,
    default_tokenizer,
    encode_block,
    read_token_files,
    token_rows,
    write_token_files,
)
from flowspark.llm.url_filter import RULES, filter_urls
from flowspark.llm.warc import read_warc, write_warc
from tests.llm import plain

TINY = "/root/testdata/sf0.001"


def of(df, columns=None):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


# --- near copies ------------------------------------------------------------------


def _copies(seed=2):
    """Families of near copies around the threshold, chains, a passage that many share, short and empty texts."""
    draw = random.Random(seed)
    words = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    passage, rows = words(40), []
    for family in range(6):
        text = words(draw.choice((12, 60, 120)))
        for _ in range(draw.randint(2, 14)):
            other = list(text)
            for _ in range(draw.randint(0, 1 + len(text) // 40)):
                other[draw.randrange(len(other))] = f"e{draw.randrange(10**6)}"
            rows.append(" ".join(other).upper() if draw.random() < 0.2 else "\n".join(other))
    chain = words(80)
    for k in range(12):
        rows.append(" ".join(chain[k:] + words(k)))
    rows += [" ".join(words(draw.randint(3, 25)) + passage + words(draw.randint(0, 3))) for _ in range(40)]
    rows += ["a", "A", "a b", "b a", "", None, "  ", "a a a a a", "a a a"]
    draw.shuffle(rows)
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_groups_against_all_pairs(spark, width, percent):
    rows = _copies()
    rows += [(rows[0][0], rows[0][1]), (None, rows[1][1]), (None, "nobody else has this text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("class", common.F.lit(1)).repartition(3)
    sets, ids = plain.groups(rows, width, percent)
    want = sorted([(i, len(s), ids[k] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))], key=repr)
    assert of(group_copies(docs, width=width, percent=percent)) == want
    keep = {ids[k] for k, s in enumerate(sets) if s and ids[k] is not None}
    kept = keep_one(docs, width=width, percent=percent)
    assert kept.columns == docs.columns
    stays = [(i, t) for k, (i, t) in enumerate(rows[: len(rows) - 3]) if not sets[k] or i in keep]
    assert of(kept, ["doc_id", "text"]) == sorted([*stays, rows[-1]], key=repr)


def test_prefixes_and_nothing(spark):
    assert [prefix_size(n, 90) for n in (0, 1, 9, 10, 11, 100)] == [0, 1, 1, 2, 2, 11]
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert group_copies(docs).count() == 0 and keep_one(docs).count() == 0


# --- mixing -----------------------------------------------------------------------


def test_mixing(spark):
    draw = random.Random(4)
    rows = [(k, "w " * draw.randint(1, 30), draw.choice(("b", "a", "é", None)), k) for k in range(3000)]
    rows += [(k, "only", "tiny", 0) for k in range(5000, 5003)] + [(9000, None, "empty", 0), (9001, "", None, 0), (1, rows[1][1], rows[1][2], 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size bigint").repartition(4)
    found = mix_report(docs).collect()
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = plain.targets(sizes)
    taken = {}
    for row in found:
        assert row.source_size == sizes[row.source] and math.isclose(row.target, wanted[row.source], abs_tol=1e-6)
        assert row.taken <= 2 * row.size
        taken[row.source] = taken.get(row.source, 0) + row.taken
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 0.1 * target + 1
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    times = {}
    for row in found:
        times[row.doc_id] = times.get(row.doc_id, 0) + row.copies
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: n for k, n in times.items() if n}
    assert of(mix_report(docs.repartition(7))) == of(mix_report(docs))
    assert mix(docs.limit(0)).count() == 0 and mix_report(docs.limit(0)).count() == 0


# --- token files ----------------------------------------------------------------------


def test_columns_of_any_name_pass_through(spark):
    names = ["_mix_source", "_MIX_size", "_mix_target", "_mix_copy", "_kept_id", "_kept_text", "shingle", "class", "source_size", "target"]
    rows = [(k, f"some words of text number {k % 3} and more of them here", f"s{k % 2}") for k in range(12)] + [(99, None, None), (98, "", "s0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({n: common.F.lit(n) for n in names})
    plainly = docs.select("doc_id", "text", "source")
    for whole, few in ((mix(docs), mix(plainly)), (keep_one(docs), keep_one(plainly))):
        assert whole.columns == docs.columns and of(whole, ["doc_id"]) == of(few, ["doc_id"])
        assert whole.filter(" OR ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0 < whole.count()


def test_codes_and_blocks():
    draw = np.random.default_rng(1)
    for n, vocabulary in ((0, 4), (1, 3), (7, 1), (500, 40), (150_000, 30_000)):
        ids = (draw.zipf(1.2, n) % vocabulary).astype(np.uint16)
        lengths = code_lengths(np.bincount(ids, minlength=vocabulary))
        lookup, wide = decode_table(lengths)
        assert wide <= 18 and (n < 2 or sum(2.0 ** -lengths[lengths > 0].astype(float)) <= 1)
        data, checkpoints = encode_block(ids, lengths, canonical(lengths))
        assert (decode_block(data, n, checkpoints, lookup, wide) == ids).all()
        # Any stretch can be read alone from its checkpoint.
        if n > 200:
            part = decode_block(data, 64, checkpoints[2:3], lookup, wide)
            assert (part == ids[128:192]).all()


def test_lengths_are_limited_and_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    assert code_lengths(counts, 18).tolist() == [9, 9, 8, 7, 6, 5, 4, 3, 2, 1]
    assert code_lengths(counts, 5).max() == 5 and sum(2.0 ** -code_lengths(counts, 5).astype(float)) == 1


def test_words_are_encoded_as_the_whole_text_is(monkeypatch):
    ids, tokenizer = WordIds(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    texts = ["It's <|endoftext|>x a<|endoftext|>", "İstanbul ΑΣ ΑΣ. ﬁ e\u0301 \u0301a a\u00a0b x\x1cy", "ª²½ ß ÿ Å × ÷ don'T 'S'll 12a3b—’s", "日本語 a\u200bb 😀", "", " \n", "'" * 50 + "s", "\x00 \x7f q", "x" * 3000]
    texts += [None, "x" * 70 + "é" * 70, " ".join(f"w{k}" for k in range(500)), "a\x0bb\x0cc  a"]
    want = [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]
    # Again with all words known, with the memory full before each call, and with nothing to encode.
    for remembered in (1 << 20, 1 << 20, 0, 0):
        monkeypatch.setattr(token_files, "REMEMBERED_BYTES", remembered)
        found, counts = ids.encode(pa.array(["left out", *texts], pa.string()).slice(1))
        assert [part.tolist() for part in np.split(found, np.cumsum(counts)[:-1])] == want
    assert all(len(part) == 0 for part in ids.encode(pa.array([], pa.string())))


def test_chunks_keep_all_rows_in_order():
    draw = random.Random(9)
    texts = [None if draw.random() < 0.1 else "x" * draw.choice((0, 1, 5, 40)) for _ in range(200)]
    rows = list(enumerate(texts))
    batches = [pa.record_batch([pa.array([k for k, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], ["k", "t"]) for part in (rows[:1], rows[1:90], [], rows[90:])]
    for size in (1, 30, 10**6):
        chunks = list(common.text_chunks(iter(batches), 1, size))
        assert [r for c in chunks for r in zip(*(x.to_pylist() for x in c.columns))] == rows
        assert all(sum(len(t or "") for t in c.column(1).to_pylist()) <= size + 40 for c in chunks)


def test_token_files_round_trip(spark):
    rows = [(k, t) for k, t in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-5, None), (-4, ""), (10**9, "long word " * 60_000), (None, "no id"), (rows[3][0], rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", common.F.lit(0)).repartition(5)
    manifest = write_token_files(docs, default_tokenizer(), file_bytes=1 << 15)
    assert manifest.count() > 1
    want = plain.token_rows(rows, Tokenizer.from_file(default_tokenizer()))
    assert sorted(map(tuple, read_token_files(manifest).collect()), key=lambda r: r[1]) == want
    none = write_token_files(docs.limit(0), default_tokenizer())
    assert none.count() == 0 and read_token_files(none).count() == 0
    assert token_rows(docs, default_tokenizer(), "doc_id", "text").count() >= 1


# --- archives --------------------------------------------------------------------------


def _pages():
    draw = random.Random(6)
    same = ["<p>copy</p>", "", "ü" * 40]
    rows = [(k, f"http://h{k % 3}.org/ a?{k}", draw.choice(same) if k % 3 else f"<p>{k}</p>" * draw.randint(1, 400)) for k in range(150)]
    return rows + [(200, None, None), (201, "x", None), (202, "y", "z" * 300_000)]


@pytest.mark.parametrize("least", [0, 12])
def test_archives_against_plain(spark, least):
    pages = spark.createDataFrame(_pages(), "page_id bigint, url string, html string").withColumn("part", common.F.lit(1)).repartition(4)
    archive = write_warc(pages, file_bytes=4_000, min_payload=least, range_bytes=30_000)
    assert archive.count() > 3 and archive.select("range").distinct().count() > 2
    found = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(archive).collect()}
    assert found == plain.archive([(k, h) for k, _, h in _pages()], least)
    again = write_warc(pages.repartition(2), file_bytes=4_000, min_payload=least, range_bytes=30_000)
    assert of(again, ["range", "number", "records", "bytes", "sha256"]) == of(archive, ["range", "number", "records", "bytes", "sha256"])
    texts = {r.page_id: r.payload for r in read_warc(archive, with_payload=True).filter("record_type = 'response'").collect()}
    assert texts[202] == b"z" * 300_000


def test_archives_of_repeated_rows_and_of_nothing(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "v", "same"), (None, None, "own"), (0, "w", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = of(read_warc(write_warc(pages)), ["page_id", "record_type", "refers_to"])
    assert found == sorted([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (0, "revisit", 1), (None, "response", None)], key=repr)
    none = write_warc(pages.limit(0))
    assert none.count() == 0 and read_warc(none).count() == 0


def test_archives_of_text_ids_are_in_the_order_of_text(spark):
    ids = ["²", "--5", "-1", "10", "9", "é", "", None, "a b", "1e5", "\u0660"] + [f"id{k}" for k in range(60)]
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 40) for k in ids], "page_id string, url string, html string").repartition(4)
    archive = write_warc(pages, file_bytes=1_000, range_bytes=2_000)
    files = [r.file for r in archive.select("file").orderBy("file").collect()]
    found = [r.page_id for f in files for r in read_warc(archive.filter(common.F.col("file") == f), "string").collect()]
    assert found == sorted(ids, key=lambda k: (k is not None, k or "")) and len(files) > 2


def test_archives_roll_by_compressed_size_by_default(spark):
    """Files of about 16 MiB though ranges hold 1 MiB of html; nothing else is left in the folder."""
    pages = spark.range(0, 400, 1, 8).selectExpr("id page_id", "'u' url", "array_join(transform(sequence(1, 2500), k -> sha2(concat(id, '-', k), 256)), '') html")
    archive = write_warc(pages)
    sizes = [r.bytes for r in archive.orderBy("file").collect()]
    assert len(sizes) == 3 and all(abs(size - (16 << 20)) < 100_000 for size in sizes[:-1])
    assert read_warc(archive).select("page_id").distinct().count() == 400
    folder = archive.first().file.rpartition("/")[0]
    assert len(os.listdir(common.file_system(folder)[1])) == 3


# --- URL filter -------------------------------------------------------------------------


def test_urls_against_plain(spark):
    draw = random.Random(8)
    hosts = ["a.net", "b.net", "x.example.net", "example.com", "s.example.com", "c.org", "d.org", "e.io", "f.io", "g.io", "H.IO"]
    pages = []
    for k in range(200):
        links = "".join(f"<a href='{draw.choice(('http:', 'https:', ''))}//{draw.choice(hosts)}/x'>" for _ in range(draw.randint(0, 3)))
        path = draw.choice(("", "/", "/en/1", "/de/2?q", "/fr/3#t", "/en"))
        pages.append((k, f"{draw.choice(('http', 'HTTPS'))}://{draw.choice(hosts)}{path}", links))
    pages += [(300, None, "<a href=//a.net>"), (301, "no host", None), (302, "http://", "x"), (303, "ftp://E.io?x://y", ""), (7, *pages[7][1:])]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", common.F.lit("clash"))
    scores = plain.host_scores([p[1:] for p in pages], RULES)
    want = []
    for k, url, _ in pages:
        host, path, (_, verdict, rule) = plain.rule_of(url, RULES)
        trust, distrust = scores[host]
        blocked = distrust >= 0.5 * 0.15 and distrust > trust
        want.append((k, host, path, rule, verdict or ("block" if blocked else "allow")))
    found = filter_urls(frame, small_change=1e-12, most_rounds=200)
    assert of(found, ["page_id", "host", "path", "rule", "verdict"]) == sorted(want, key=repr)
    assert {v for *_, rule, v in want if rule is None} == {"block", "allow"}
    for row in found.collect():
        assert math.isclose(row.trust, scores[row.host][0], abs_tol=1e-6) and math.isclose(row.distrust, scores[row.host][1], abs_tol=1e-6)
    assert filter_urls(frame.limit(0)).count() == 0
    assert filter_urls(frame, rules=()).filter("verdict = 'block' or rule is not null").count() == 0


def test_scores_converge_by_default(spark):
    """Hosts up to 45 links from a blocked host, which is in a cycle, and from an allowed one."""
    link = lambda *names: "".join(f"<a href=//{n}>" for n in names)
    pages = [("http://bad.net/", link("h0.io")), ("http://x.example.net/en/", link("g0.io"))]
    pages += [(f"http://h{k}.io/", link(f"h{k - 1}.io" if k else "bad.net")) for k in range(45)]
    pages += [(f"http://g{k}.io/", link(f"g{k + 1}.io")) for k in range(45)]
    rows = [(k, *p) for k, p in enumerate(pages)]
    found = filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    scores = plain.host_scores(pages, RULES, rounds=300)
    assert 1e-6 < scores["h40.io"][1] < 1e-3 and 1e-6 < scores["g40.io"][0] < 1e-3
    for row in found.collect():
        assert math.isclose(row.trust, scores[row.host][0], abs_tol=1e-6) and math.isclose(row.distrust, scores[row.host][1], abs_tol=1e-6)
    with pytest.raises(RuntimeError, match="after 3 rounds"):
        filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"), most_rounds=3)


# --- main text ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return fit(labelled_pages(TRAINING_PAGES))


def test_held_out_layouts(model):
    right = total = whole = 0
    held_out = list(labelled_pages(300, seed=77))
    for html, text in held_out:
        lines, blocks = set(text.split("\n")), blocks_of(html)
        labels = model.decode(blocks)
        right += sum((b.text in lines) == bool(label) for b, label in zip(blocks, labels))
        total += len(blocks)
        whole += main_text(html, model) == text
    assert right / total > 0.98 and whole / len(held_out) > 0.85


def test_pages_of_the_table(spark, model):
    import html as entities
    import re

    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for row in extract_text(pages, model).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", sources[row.page_id], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>?", "", part)).split()) for part in re.split(r"<(?:/?p|/?h1|br)>", article)]
        assert row.text == "\n".join(filter(None, blocks)) and row.n_chars == len(row.text)


def test_broken_and_empty_pages(spark, model):
    long = "<article>" + "<p>many words in here, again.</p>" * 20_000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>a &amp b<p>c&nbsp;&lt;d  e\n f<script>x</article>"), (None, "u", "plain < text"), (5, "u", long), (5, "u", long), (6, "u", "<!-- <p>never ended --")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", common.F.lit(1))
    found = {r.page_id: r.text for r in extract_text(pages, model).collect()}
    assert found[1] == found[2] == "" and found[3] == "a & b\nc <d e f"
    assert found[5] == "\n".join(["many words in here, again."] * 20_000)
    assert extract_text(pages, model).count() == 7 and extract_text(pages.limit(0), model).count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>t</title><body><article><p>text", ["text"]),
        ("<head><title>t</title><meta charset=utf-8><p>text", ["text"]),
        ("<head><title>t</title><style>p{}</style><script>x</script><noscript><p>no</noscript> loose<p>text", ["loose", "text"]),
        ("<head><noscript><p>no<body><p>text", ["text"]),
        ("<head><title>t <b>u</b></title></head><head><p>text", ["text"]),
        ("<head/><p>text", ["text"]),
        ("<p>a <svg class=\"x\"/>b <math/>c <object data=\"y\" />d", ["a b c d"]),
        ("<p>a <svg><path d=\"z\"/><g/><text>no</text></svg>b<p>c", ["a b", "c"]),
        ("<div>a <svg><path><div>b</div>c</div>", ["a", "b", "c"]),
        ("<div>a <svg><foreignObject><p>no</p></foreignObject></svg>b</div>", ["a", "b"]),
        ("<div>a <object><p>no</object> b <noscript><div>no</noscript>c <button>no<button>no</button> d</div>", ["a", "b", "c d"]),
    ],
)
def test_unseen_elements_end_where_html_ends_them(html, want):
    assert [b.text for b in blocks_of(html)] == want


def test_pages_of_any_depth_take_time_in_proportion(model):
    """A megabyte of elements that nobody closes, and of end tags that close nothing."""
    pages = ["<font>x<br>" * 91_000, "<b>" * 333_000 + "x", "<b><p>x" * 100_000, "<b>" * 160_000 + "</i>" * 160_000, "<svg>" + "<g>" * 300_000 + "<p>x"]
    pages.append("<p>" + "<b>" * 160_000 + "<div>x" * 80_000)
    began = time.process_time()
    for page in pages:
        assert len(page) > 690_000 and isinstance(main_text(page, model), str)
    assert time.process_time() - began < 120
    assert len(blocks_of(pages[0])) == 91_000 and [b.text for b in blocks_of(pages[1])] == ["x"]


@pytest.mark.parametrize("seed", range(6))
def test_sums_over_labellings_against_all_of_them(seed):
    """Viterbi and forward-backward of short chains against every labelling, ties included."""
    draw = random.Random(seed)
    for n in range(1, 7):
        pick = (lambda: draw.choice([-1.0, 0.0, 1.0])) if seed % 2 else (lambda: draw.gauss(0, 2))
        emitted, moves = [pick() for _ in range(n)], [[pick() for _ in range(2)] for _ in range(2)]

        def total(labels):
            return sum(e * y for e, y in zip(emitted, labels)) + sum(moves[a][b] for a, b in zip(labels, labels[1:]))

        class Fixed(Model):
            def emissions(self, blocks):
                return emitted

        every = list(itertools.product((0, 1), repeat=n))
        found = Fixed(moves=moves).decode([None] * n)
        best = max(map(total, every))
        assert abs(total(found) - best) < 1e-12
        # Of equally likely labels the last one is 0 where it can be, then the one before it.
        equal = [labels for labels in every if total(labels) > best - 1e-12]
        assert tuple(found)[::-1] == min(labels[::-1] for labels in equal)
        ones, pairs = _expectations(emitted, moves)
        weights = {labels: math.exp(total(labels)) for labels in every}
        whole = sum(weights.values())
        for k in range(n):
            assert abs(ones[k] - sum(w for y, w in weights.items() if y[k]) / whole) < 1e-9
        for a in (0, 1):
            for b in (0, 1):
                moved = sum(w * sum((y[k], y[k + 1]) == (a, b) for k in range(n - 1)) for y, w in weights.items()) / whole
                assert abs(pairs[a][b] - moved) < 1e-9


def test_pages_without_an_end_of_head(spark, model):
    page = "<!DOCTYPE html><html><head><title>t</title>{}<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A title</h1><p>Many words <svg/>in here, again.</article>"
    pages = spark.createDataFrame([(1, "u", page.format("")), (2, "u", page.format("</head>"))], "page_id bigint, url string, html string")
    assert {r.text for r in extract_text(pages, model).collect()} == {"A title\nMany words in here, again."}


# --- pipeline -------------------------------------------------------------------------------


def test_pipeline_against_plain(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").orderBy("doc_id").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, j[-1], r.source) for r in docs if (j := judge(r.text))[6]]
    sets, ids = plain.groups([r[:2] for r in rows], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.PERCENT)
    rows = [r for k, r in enumerate(rows) if not sets[k] or ids[k] == r[0]]
    rows = [r for r in rows if not plain.passages(r[1], items)[-1]]
    kept = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    copies = {r.doc_id: r.copies for r in mix_report(kept).collect()}
    mixed = [r[:2] for r in rows for _ in range(copies[r[0]])]
    want = plain.token_rows(mixed, Tokenizer.from_file(default_tokenizer()))
    assert 0 < len(rows) < len(docs)
    assert sorted(map(tuple, corpus_pipeline.run(spark, TINY).collect()), key=lambda r: r[1]) == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").withColumn("class", common.F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, TINY), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "class"]
    assert docs.count() > 0
