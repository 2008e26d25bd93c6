"""Each operator against a plain version on the smallest tables, and on tables of odd rows."""

from __future__ import annotations

import base64
import hashlib
import html
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from overgrid.llm import boosting, bpe, decontaminate, fingerprints, linking, lines, near, pages, paragraphs, pii, quality, queries, warc
from overgrid.llm.common import shared_folder
from tests.llm import brute
from tools.check import canon, connect

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, key string, root int, kept string, id int, _lines int, score int, bpe0 int, range int, lang string, source string, n_chars long"
LONG = "Lorem ipsum " * 30_000


def table(sql):
    return duckdb.sql(sql.replace("$", SF)).fetchall()


@pytest.fixture(scope="module")
def documents():
    return dict(table("select doc_id, text from '$/documents.parquet' order by 1"))


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns named like our own."""
    shared = "this very line is in several documents\nbut this one 1 is not"
    texts = [(1, shared), (2, shared), (2, shared), (3, None), (4, ""), (None, shared), (None, None), (5, LONG), (6, LONG + "!"), (7, "\n\n"), (8, "a b"), (9, "a  B"), (10, "é漢\U0001f642 " * 9)]
    return spark.createDataFrame([(i, t, "k", 1, "x", 3, 4, 5, 6, 7, None, None, 0) for i, t in texts], CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in (*range(1, 11), 11, 12, 13)] + ["pipeline"]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_fingerprints(spark, documents):
    got = {r.doc_id: r for r in fingerprints.op1_fingerprints(spark, SF).collect()}
    order = sorted(documents, reverse=True)
    for doc, following in zip(order, order[1:] + order[:1], strict=True):
        text, other = documents[doc], documents[following]
        n = len(text)
        edited = text[: n - n // 3] + other[: n // 3]
        assert got[doc].n_chars == n and got[doc].edited_sha256 == brute.sha(edited)
        common = next((k for k, (a, b) in enumerate(zip(text, edited, strict=False)) if a != b), min(n, len(edited)))
        assert got[doc].common_prefix == common
        assert got[doc].edited_fingerprint == fingerprints.Print(fingerprints.Prefix.of(edited)).text
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.97


def test_fingerprint_likeness_follows_the_shared_spans():
    make = lambda t: fingerprints.Print(fingerprints.Prefix.of(t))
    text = " ".join(str(k * k) for k in range(400))
    spans = lambda t: {t[k : k + 12] for k in range(len(t) - 11)}
    for other in (text, text[:-100] + "x" * 100, text[200:], text[:900] + "new" + text[900:], text[::-1]):
        a, b = spans(text), spans(other)
        assert abs(make(text).like(make(other)) - len(a & b) / len(a | b)) < 0.2
    assert make("").like(make("")) == 1 and make("").like(make("a")) == 0


def test_fingerprints_of_odd_rows(spark, odd, none):
    assert fingerprints.fingerprints(none).count() == 0
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == odd.count()
    assert all(r.near_next == 1 for r in got if r.doc_id is None)
    assert {r.near_edited for r in got if r.n_chars == 0} <= {0.0, 1.0}


def test_bpe(spark, documents, ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.op2_byte_bpe(spark, SF).collect():
        ids = encoding.encode_ordinary(documents[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(np.array(ids, dtype="<u4").tobytes())
        assert r.decoded_sha256 == brute.sha(documents[r.doc_id])


def test_bpe_of_odd_texts(spark, odd, none, ranks):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, some = bpe.Coder(ranks, public_tokenizers.PATTERN), random.Random(4)
    texts = ["", None, " ", "\n\n  a", "a" * 3000, "é" * 200, "\x1c\x1d a\x85b\xa0 c", "'s'S don't", " " * 500 + "x", "<|endoftext|>"]
    texts += ["".join(some.choice("ab cdé\n\t'stre0 9.,漢  \x1f") for _ in range(150)) for _ in range(60)]
    for text, ids, decoded in zip(texts, coder.encode(texts), coder.decode(coder.encode(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(text or "") and decoded == (text or "").encode()
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert bpe.digests(none, path, public_tokenizers.PATTERN).count() == 0
    got = bpe.digests(odd, path, public_tokenizers.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(brute.sha(r.text or "") for r in odd.collect())


def test_decontamination(spark, documents):
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.op3_decontaminate(spark, SF).collect()}
    items = dict(table("select item_id, text from '$/benchmark.parquet'"))
    held = {d: brute.words(t) for d, t in documents.items()}
    whole = {(d, i) for d, t in documents.items() for i, x in items.items() if x in t}
    assert whole and whole <= set(got)
    for (d, i), edits in got.items():
        item = brute.words(items[i])
        assert brute.least_edits(item, held[d]) == edits <= len(item) // 5


def test_decontamination_reaches_its_recall():
    some = random.Random(2)
    items = [[f"w{some.randrange(3000)}" for _ in range(some.randrange(15, 60))] for _ in range(80)]
    built = decontaminate.Items.build(list(range(80)), [" ".join(i) for i in items])
    texts = []
    for item in items:
        item = list(item)
        for _ in range(len(item) // 10):
            item[some.randrange(len(item))] = "other"
        around = [f"v{some.randrange(3000)}" for _ in range(100)]
        texts.append(" ".join([*around[:50], *item, *around[50:]]))
    found = {(t, i) for t, i, *_ in built.leaks(texts)}
    assert len(found & {(k, k) for k in range(80)}) >= 76 and len(found) < 90
    clean = [" ".join(f"w{some.randrange(3000)}" for _ in range(300)) for _ in range(50)]
    assert not list(built.leaks([*clean, None, "", "w1 " * 2000]))


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "this very line is in several documents"), (None, "a b")], "item_id long, text string")
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items, block_words=4).collect()}
    assert got == {(1, 3), (2, 3), (None, 3), (8, None), (9, None)}
    kept = decontaminate.decontaminate(odd, items)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 10]


def test_paragraphs(spark, documents):
    got = {(r.doc_id, r.paragraph): (r.first_doc_id, r.first_paragraph, r.kept) for r in paragraphs.op4_paragraphs(spark, SF).collect()}
    sets = {(d, i): brute.shingles(x) for d, t in documents.items() for i, x in enumerate(t.split("\n")) if len(x.split()) >= 20}
    root = brute.classes(sets, 80)
    members: dict = {}
    for key, first in root.items():
        members.setdefault(first, []).append(key)
    want = {k: (*first, k == first) for first, held in members.items() if len({d for d, _ in held}) > 1 for k in held}
    assert want and got == want


def test_paragraphs_of_odd_rows(spark, odd, none):
    assert paragraphs.tuned_rows(0.8) == 4
    assert paragraphs.repeated(none).count() == 0
    got = {(r.doc_id, r.paragraph, r.first_doc_id, r.kept) for r in paragraphs.repeated(odd, min_words=5).collect()}
    assert got == {(1, 0, 1, True), (2, 0, 1, False), (1, 1, 1, True), (2, 1, 1, False)}
    cut = paragraphs.substring_dedup(odd.filter("doc_id < 3"))
    assert cut.columns == odd.columns and cut.count() == 3


def test_warc(spark):
    rows = table("select page_id, url, html from '$/pages.parquet'")
    assert sorted(map(tuple, warc.op5_warc(spark, SF).collect()), key=str) == _captures(rows)


def _captures(rows):
    first: dict = {}
    for page, _, body in rows:
        if page is not None:
            first[body or ""] = min(first.get(body or "", page), page)
    out = []
    for page, _, body in rows:
        raw, low = (body or "").encode(), first.get(body or "")
        later = low is not None and (page is None or page > low)
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if later else "response", low if later else None))
    return sorted(out, key=str)


def test_warc_of_odd_rows(spark):
    rows = [(1, "http://a.b/x", "dup"), (2, "http://a.b/x", "dup"), (3, "https://u@Z.a.b:80/q?a#f", "é"), (3, "https://u@Z.a.b:80/q?a#f", "é"), (None, None, None)]
    rows += [(None, "x", "dup"), (7, "no url", ""), (8, "http://é.x/\r\nA: b", "<p>"), (8, "http://é.x/\r\nA: b", "<q>"), (9, "http://a.b/x", LONG)]
    made = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string")
    folder = shared_folder(spark)
    directory = warc.write_archives(made, folder)
    found = warc.look_up(spark, folder, directory, made.select(warc.url_key("url").alias("key"), "page_id"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == _captures(rows)
    one = warc.look_up(spark, folder, directory, spark.createDataFrame([("b,a)/x",), ("nowhere",)], "key string")).collect()
    assert {(r.page_id, bytes(r.payload)) for r in one} == {(1, b"dup"), (2, b""), (9, LONG.encode())}
    again = warc.look_up(spark, folder, directory, made.select(warc.url_key("url").alias("key"))).count()
    assert again == len(rows)
    empty = made.limit(0)
    folder = shared_folder(spark)
    assert warc.look_up(spark, folder, warc.write_archives(empty, folder), empty.select("key")).count() == 0


def test_line_dedup(spark):
    df = lines.op6_line_dedup(spark, SF)
    cur = connect(SF).execute(lines.ORACLE)
    columns = [d[0] for d in cur.description]
    assert canon(df.columns, df.collect()) == canon(columns, cur.fetchall())


def test_line_dedup_of_odd_rows(spark, odd, none):
    assert lines.line_dedup_stage(none).count() == 0
    done = sorted((r.doc_id or 99, r.text) for r in lines.line_dedup_stage(odd).collect())
    rows: dict = {}
    rows |= {r.doc_id if r.doc_id is not None else 99: r.text for r in odd.collect() if not (r.doc_id is None and r.text is None)}
    want = brute.dedup_lines(rows)
    assert {k for k in done if k[0] != 99} == {(i, want[i][0]) for i in rows if i != 99}
    assert sorted(t for i, t in done if i == 99) == ["", want[99][0]]


@pytest.mark.parametrize("bits", [lines.SLICE, 64 * lines.SLICE])
def test_the_filters_never_miss(bits):
    some = np.random.default_rng(1)
    filters = lines.Filters(bits)
    hashes = some.integers(0, 1 << 63, 5000, dtype=np.uint64)
    filters.add(hashes)
    filters.add(hashes[:700])
    assert lines.probe(filters.once, hashes).all() and lines.probe(filters.twice, hashes[:700]).all()


def test_near_dedup(spark, documents):
    sets = {d: brute.shingles(t) for d, t in documents.items()}
    root = brute.classes(sets, 85)
    for r in near.op7_near_dedup(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_near_dedup_of_odd_rows(spark, odd, none):
    assert near.near_components(none).count() == 0
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_components(odd).collect()]
    assert len(got) == odd.count()
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10}
    assert {i: c for i, _, c, _ in got if i is not None} == want
    assert [(c, k) for i, _, c, k in got if i is None] == [(None, True)] * 2


def test_large_groups_are_linked_like_small_ones(spark):
    some = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(some.randrange(9)):
            text[some.randrange(200)] = f"x{some.randrange(9)}"
        rows.append((i, " ".join(text)))
    sets = {i: brute.shingles(t) for i, t in rows}
    want = brute.classes(sets, 85)
    names = {linking.digest(s): s for s in near.shingle_sets([t for _, t in rows])}
    groups = spark.createDataFrame([(b"r", linking.digest(s), len(s), t, None) for (_, t), s in zip(rows, near.shingle_sets([t for _, t in rows]), strict=True)], "root binary, id binary, size long, text string, sketch binary").distinct()
    by_joins = linking.link(groups, near.shingle_sets, 85, shared_folder(spark), most=(5, 10))
    inside = linking.link(groups, near.shingle_sets, 85, shared_folder(spark))
    a, b = ({bytes(r.id): bytes(r.root) for r in x.collect()} for x in (by_joins, inside))
    partition = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert partition(a) == partition(b) and len(names) > 5
    sizes = sorted(len({brute_key for brute_key in c}) for c in partition(b))
    shown: dict = {}
    for i, s in sets.items():
        shown.setdefault(want[i], set()).add(frozenset(s))
    assert sizes == sorted(len(v) for v in shown.values() if len(v) > 1)


def test_sketch_estimates_jaccard():
    some = np.random.default_rng(3)
    a = np.unique(some.integers(0, 1 << 63, 4000, dtype=np.uint64))
    for share in (0.2, 0.6, 0.9):
        b = np.unique(np.concatenate([a[: int(len(a) * share)], some.integers(0, 1 << 63, 4000 - int(4000 * share), dtype=np.uint64)]))
        x, y = near.registers(near.minima([a, b], near.REGISTERS))
        assert abs(near.estimate(x, y) - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15


def test_pii(spark, documents):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    fits = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "phone": lambda s: 9 <= len(pii.digits_of(s)) <= 15,
        "card": lambda s: 12 <= len(d := pii.digits_of(s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
    }

    def spans(text):
        return [(*m.span(), k) for k, rule in rules.items() for m in re.finditer(rule, text or "") if fits[k](m[0])]

    some = random.Random(6)
    for _ in range(3000):
        text = "".join(some.choice("ab.@-+ 0123456789() .@1.2é") for _ in range(some.randrange(60)))
        assert pii.base_spans(text) == spans(text)
    got = {r.doc_id: r for r in pii.op8_pii(spark, SF).collect()}
    assert len(got) == len(documents)
    for d, text in documents.items():
        base = spans(text)
        assert got[d].base_sha256 == brute.sha(pii.joined(base)) and set(pii.joined(base).split(",")) <= set(got[d].spans.split(","))
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]


def test_pii_judge_adds_what_it_was_taught():
    some = random.Random(1)
    texts = [f"mail {some.randrange(99)}a.b{k}@mail.example.com or call +1 ({some.randrange(200, 999)}) 555-{some.randrange(1000, 9999)} on 2024-05-{k % 28 + 1:02d}" for k in range(150)]
    judge = pii.fit([r for t in texts for r in pii.lessons(t)])
    text = "please call (415) 555-2671 now"
    assert pii.redact(text, pii.joined(judge.added(text, pii.base_spans(text)))) == "please call <phone> now"
    assert not judge.added("on 2024-05-11 it was 3.14", [])
    assert pii.fit([]) is None


def test_pii_learns_from_all_documents(spark, monkeypatch):
    texts = [f"call +49 151 {k:07d} or 1.2.3.{k % 256}" for k in range(9000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text STRING")
    rows = pii.taught(docs)
    assert rows.agg({"n": "sum"}).first()[0] == sum(len(pii.lessons(t)) for t in texts)
    monkeypatch.setattr(boosting, "ROUNDS", 4)
    told = [(list(r.x), r.good, r.n) for r in rows.collect()]
    x, y = (np.repeat(np.array(c), [n for _, _, n in told], axis=0) for c in ([x for x, _, _ in told], [float(g) for _, g, _ in told]))
    one, many = boosting.fit(x, y), boosting.fit_table(rows.repartition(3))
    assert np.allclose(one.probability(x), many.probability(x), atol=1e-4)


def test_pii_of_odd_rows(spark, odd, none):
    assert pii.find_pii(none, pii.train(none)).count() == 0
    assert {r.pii.spans for r in pii.find_pii(odd, pii.train(odd)).collect()} == {""}
    assert pii.emails("a" * 100_000 + "@" * 100) == [] and pii.candidates("1" * 50_000) == []


def test_main_text(spark):
    got = {r.page_id: r for r in pages.op9_main_text(spark, SF).collect()}
    right = 0
    rows = table("select page_id, html from '$/pages.parquet'")
    for page, source in rows:
        body = source.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>|</h1>|</p>", "", p))).split()) for p in re.split("<p>|<h1>", body)]
        right += got[page].text == "\n".join(filter(None, parts))
        assert got[page].n_chars == len(got[page].text)
    assert right >= 0.97 * len(rows)


def test_blocks_of_broken_pages():
    text = lambda page: [b.text for b in pages.blocks_of(page)]
    assert text(None) == text("") == text("<p></p><!-- x") == []
    assert text("a &lt;&amp b<br>c<script>var x='</p>'</script><p>d <b>e<p>f") == ["a <& b c", "d e", "f"]
    assert text("<ul><li>x<li>y</ul>1 < 2<style>p{}</style><P CLASS='q'>z</P") == ["x", "y", "1 < 2", "z"]
    assert pages.blocks_of("<div class='a b' id=c><p>t")[0].path == ("div.a b c", "p")


def test_main_text_of_odd_rows(spark):
    made = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>" + LONG), (None, "u", "&#0; &bogus; <")], "page_id long, url string, html string")
    model = pages.train(made)
    assert len(pages.extract(made, model).collect()) == 4
    assert pages.extract(made.limit(0), pages.train(made.limit(0))).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 0), (5, 7)], "doc_id long, quality int")
    assert quality.score(none, quality.train(none, labels)).count() == 0
    model = quality.train(odd, labels)
    assert model is None and quality.quality_filter(odd, labels).count() == odd.count()
    good, bad = [f"Some plain words number {k} here." for k in range(40)], [f"J##!! {k} ***" for k in range(40)]
    fitted = quality.fit(quality.features(good + bad), np.array([True] * 40 + [False] * 40))
    scores = fitted.score(quality.features(["Other plain words in here.", "K##!! 77 ***", "", None, LONG]))
    assert scores[0] >= 0.3 > scores[1] and ((0 <= scores) & (scores <= 1)).all()


def test_pipeline(spark, documents, ranks):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    good = {r.doc_id for r in quality.op10_quality(spark, SF).collect() if r.predicted}
    kept = brute.dedup_lines({d: t for d, t in documents.items() if d in good})
    root = brute.classes({d: brute.shingles(k[0]) for d, k in kept.items()}, corpus_pipeline.NEAR_PERCENT)
    items = [brute.words(x) for _, x in table("select item_id, text from '$/benchmark.parquet'")]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, (text, *_) in kept.items():
        if root[d] != d or any(brute.least_edits(i, w) <= len(i) // 5 for w in [brute.words(text)] for i in items if len(set(i) & set(w)) >= len(set(i)) * 0.6):
            continue
        ids = encoding.encode_ordinary(text)
        want[d] = (len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()))
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 50, None, None, 7)], DOCUMENTS)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns[0] == "doc_id"


def test_bpe_takes_few_texts_at_once():
    """What is encoded and sent back in one go is bounded in rows and in bytes, whatever Spark's batch holds."""
    texts = pa.array(["a" * 10, None, "é" * bpe.BYTES_AT_ONCE, "", *["b" * (bpe.BYTES_AT_ONCE // 3)] * 7, *["c"] * 1200])
    taken = list(bpe.slices(texts))
    assert [x for some in taken for x in some.to_pylist()] == texts.to_pylist()
    for some in taken:
        held = [len((x or "").encode()) for x in some.to_pylist()]
        assert len(held) <= bpe.ROWS_OF_TEXT and (sum(held) <= bpe.BYTES_AT_ONCE or len(held) == 1)
    assert len(taken) < 10 and not list(bpe.slices(pa.array([], pa.string())))
