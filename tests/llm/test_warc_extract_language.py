"""WARC round trip, main-text extraction, language identification and the pipeline's stages."""

import base64
import collections
import hashlib
import html
import re

import pytest

import corpus_pipeline
from ringwise.llm import extract, language_id, warc
from ringwise.llm.queries import QUERIES, VOCABULARY, public_file
from ringwise.session import stored

SF = "/root/testdata/sf0.001"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def resolved(pages):
    ids = collections.defaultdict(list)
    for i, _, h in pages:
        ids[digest(h)].append(i)
    out = []
    for i, url, h in pages:
        known = [x for x in ids[digest(h)] if x is not None]
        first = min(known) if known else None
        kind = "response" if i == first else "revisit"
        out.append((i, len((h or "").encode()), digest(h), kind, first if kind == "revisit" else None))
    return sorted(out, key=str)


def test_warc_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(SF + "/pages.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op3_warc_revisits"](spark, SF).collect()), key=str) == resolved(pages)


def test_warc_odd_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    monkeypatch.setattr(warc, "STEP", 100)
    odd = [None, "", "\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nx", "é😀" * 500, "same", "same", "same", "\n", "x" * 5000]
    pages = [(i, f"http://e/{i}", h) for i, h in enumerate(odd)] + [(50, None, "same"), (51, "a\r\nb%0A", "other"), (None, "u", "same"),
                                                                     (52, "u", ""), (3, "http://e/3", odd[3])]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload_digest string").repartition(2)
    path = str(tmp_path / "w")
    got = warc.deduplicate(df, path)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()),
                  key=str) == resolved(pages)
    back = warc.read_archives(spark, path).collect()
    assert collections.Counter((r.page_id, r.url) for r in back) == collections.Counter((i, u) for i, u, _ in pages)
    source = {i: (h or "").encode() for i, _, h in pages}
    for r in back:
        assert bytes(r.payload) == (source[r.page_id] if r.record_type == "response" else b"")
        assert (r.refers_id is not None) == (r.record_type == "revisit")
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 5
    none = warc.deduplicate(df, str(tmp_path / "all"), min_bytes=10**6).collect()
    assert {r.record_type for r in none} == {"response"}
    assert warc.deduplicate(df.where("false"), str(tmp_path / "none")).count() == 0


def test_archives_of_many_members(spark, tmp_path):
    import gzip
    texts = [f"page {i} " * (i + 1) for i in range(40)]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nX-Page-ID: %d\r\n"
               b"Content-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n"
               % (i, digest(t).encode(), i, 19 + len(t), t.encode()) for i, t in enumerate(texts)]
    whole = b"".join(gzip.compress(r) for r in records)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    back = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.payload).decode(), r.read_digest) for r in back) == [(i, t, digest(t)) for i, t in enumerate(texts)]
    for cut in (len(whole) - 5, len(whole) - len(gzip.compress(records[-1])) + 30):
        with pytest.raises(ValueError):
            list(warc._records(whole[:cut]))
    assert len(list(warc._records(whole + bytes(512)))) == 40  # zero padding after the last member


def article_of(page):
    """The given pages' article, by their fixed layout."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", body)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)))).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_extraction_of_the_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = QUERIES["op10_crf_main_text"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    right = [r.text == article_of(pages[r.page_id].html) for r in rows]
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)
    assert sum(right) >= 0.99 * len(right)


def test_layouts_and_odd_pages(spark):
    texts = [*(p for p, _ in extract.LAYOUTS), None, "", "plain words only, no markup at all but a full sentence.", "<p>open <b>bold<p>next &amp; last",
             "<article><p>A sentence that is the article.</p><div class=comments><p>Nice one, I say.</p></div></article>", "<<<>>> < p >&&&#x41;", "<" * 3000]
    df = spark.createDataFrame([(i, "u", t, "x") for i, t in enumerate(texts)], "page_id int, url string, html string, text string")
    got = {r.page_id: r.text for r in extract.extract(df).collect()}
    assert len(got) == len(texts) and got[len(extract.LAYOUTS)] == got[len(extract.LAYOUTS) + 1] == ""
    hit = [got[i] == "\n\n".join(main) for i, (_, main) in enumerate(extract.LAYOUTS)]
    assert sum(hit) >= len(hit) - 1
    assert got[len(extract.LAYOUTS) + 4] == "A sentence that is the article."
    assert extract.extract(df.where("false")).count() == 0


def test_hints_of_wrappers_do_not_lose_the_article(spark):
    text = ["The old bridge", "The bridge was built of stone, and it carried carts for three hundred years.", "Then it fell."]
    inner = f"<h1>{text[0]}</h1><p>{text[1]}</p><p>{text[2]}</p>"
    side = "<div class=sidebar><p>Other posts that you may want to read today.</p></div>"
    notes = "<section class=comments><article class=comment><p>I saw it fall, it was a sad day.</p></article></section>"
    pages = [f"<body class='has-sidebar'><article>{inner}</article>{side}</body>", f"<body><div class='no-ads'><article>{inner}</article></div>{side}",
             f"<body><div class='content-sidebar-wrap'><article>{inner}</article>{side}</div></body>",
             f"<html class='social menu'><body class='sidebar'><main class='with-sidebar'>{inner}{side}</main></body>",
             f"<body class='ad-free sidebar'><div class='post'>{inner}</div>{side}</body>",
             f"<body><div class='content-sidebar-wrap'><div class='content'>{inner}</div>{side}</div></body>",
             f"<body class=has-sidebar><div class='layout sidebar'><article>{inner}</article></div>{side}</body>",
             f"<body><div class=comments-closed><article class='post comments-open'>{inner}</article>{notes}</div></body>"]
    model = extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    for page in pages:
        assert extract.main_text(page, model) == "\n\n".join(text), page
        if extract.self_labels(extract.leaf_blocks(page)):
            assert sum(extract.self_labels(extract.leaf_blocks(page))) == 3, page


def test_training_takes_whole_pages():
    import pyarrow as pa
    page = "<article>" + "".join(f"<p>Line {i} of it.</p>" for i in range(900)) + "</article>"
    batch = pa.RecordBatch.from_arrays([pa.array([page])], names=["html"])
    assert [len(x) for b in extract._labelled(iter([batch])) for x in b.column("labels").to_pylist()] == [900]


def test_viterbi_and_training_on_a_toy():
    import numpy as np
    pages = [([np.array([0]), np.array([1]), np.array([2]), np.array([1])], [0, 1, 1, 1])] * 5
    model = extract.Chain().fit(pages)
    assert model.decode(pages[0][0]) == [0, 1, 1, 1] and model.decode([]) == []


def test_forward_sums_all_segmentations():
    import itertools

    import numpy as np
    pieces = ["a", "b", "ab", "▁", "▁a", "ba", "▁ab"]
    probs = np.random.default_rng(3).dirichlet(np.ones(len(pieces)), 2).T
    model = language_id.Model(pieces, ["x", "y"], probs, np.zeros(2))
    words = ["ab", "aba", "bbaab", "abz", "a"]
    got = np.exp(model.score(words))
    for i, w in enumerate(words):
        s = "▁" + w
        total, use = np.zeros(2), np.zeros((len(pieces), 2))
        for cuts in itertools.product((0, 1), repeat=len(s) - 1):
            at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(s)]
            parts = [s[a:b] for a, b in zip(at, at[1:])]
            p = np.ones(2)
            for x in parts:
                p = p * (probs[pieces.index(x)] if x in pieces else model.UNKNOWN if len(x) == 1 else 0)
            total += p
            for x in parts:
                if x in pieces:
                    use[pieces.index(x)] += p
        assert np.allclose(got[i], total)
        for lang in (0, 1):
            assert np.allclose(model.expected([w], np.array([2.0]), lang), 2 * use[:, lang] / total[lang])


def test_language_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(sf + "/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op1_language_id"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 200 and sum(held) >= 0.98 * len(held)


def test_language_odd_rows(spark):
    rows = [(i, f"the cat number {i} and the dog of the house", "en") for i in range(20)]
    rows += [(20 + i, f"die katze nummer {i} und der hund des hauses", "de") for i in range(20)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 #!? \n", "de"), (103, "und der hund", None), (None, "the dog", None),
             (104, "x" * 100_000, None), (105, "die katze und", "de"), (105, "die katze und", "de"), (106, "²", None)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    out = language_id.identify(df, public_file(VOCABULARY)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in out}
    assert got[100][0] == got[101][0] == got[102][0] == got[106][0] == "und"
    assert got[103][0] == got[105][0] == "de" and got[None] == ("en", False) and got[104][0] in ("de", "en")
    unlabelled = df.withColumn("lang", df.lang.substr(9, 1).try_cast("int").cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(unlabelled, public_file(VOCABULARY)).collect()} == {("und", 0.0)}
    assert language_id.identify(df.where("false"), public_file(VOCABULARY)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    from test_decontaminate import brute
    items = [(r.item_id, r.text) for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    assert not any(r[-1] for r in brute([(r.doc_id, r.text) for r in docs.collect()], items))
    packed = stored(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    from test_packing import check
    check(packed.collect(), {r.doc_id: r.text for r in docs.collect()}, 4096)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
