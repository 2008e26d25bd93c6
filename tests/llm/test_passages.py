"""Verbatim passages against a plain version, planted and in the smallest tables."""

from __future__ import annotations

import random
import re

import __spark_entry__
from overgrid.llm import paragraphs, passages
from tests.llm import brute
from tests.llm.test_operators import SF, table

DOCS = "doc_id long, text string"


def held_before(texts: dict[int, str], size: int = passages.PASSAGE) -> dict[int, set[int]]:
    """Places of the words of each text that stand in a run which a document of smaller id holds."""
    seen: set = set()
    out = {}
    for d in sorted(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (texts[d] or "").translate(brute.LOWER))
        runs = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
        out[d] = {k + j for k, run in enumerate(runs) if run in seen for j in range(size)}
        seen |= set(runs)
    return out


def covered(rows) -> dict[int, set[int]]:
    out: dict = {}
    for r in rows:
        if not r.kept:
            out.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.words))
    return out


def test_passages_inside_across_and_over_short_lines(spark):
    some = random.Random(5)
    own = lambda n: [f"w{some.randrange(10**6)}" for _ in range(n)]
    inside, across, short, under = own(55), own(54), own(60), own(49)
    lines = lambda *sizes: (lambda w: "\n".join(" ".join(w[sum(sizes[:k]) : sum(sizes[: k + 1])]) for k in range(len(sizes))))
    texts = {
        1: " ".join([*own(40), *inside, *own(40)]) + "\n" + lines(15, 39)(across) + "\n" + " ".join(own(50) + short + under),
        2: "begin " + " ".join([*own(90), *inside, *own(70)]) + " end",
        3: " ".join(own(60)) + " " + lines(40, 14)(across) + " " + " ".join(own(45)),
        4: " ".join(own(9)) + "\n" + lines(*[10] * 6)(short).upper() + "\n" + " ".join(own(8)),
        5: " ".join(own(30) + under + own(30)),
    }
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    assert paragraphs.repeated(docs).count() == 0
    got = passages.passages(docs).collect()
    assert covered(got) == {d: held for d, held in held_before(texts).items() if held}
    assert {(r.doc_id, r.words, r.first_doc_id) for r in got if not r.kept} == {(2, 55, 1), (3, 54, 1), (4, 60, 1)}
    assert {(r.doc_id, r.words) for r in got if r.kept} == {(1, 55), (1, 54), (1, 60)}
    left = {r.doc_id: r.text for r in paragraphs.substring_dedup(docs).collect()}
    assert left[1] == texts[1] and left[5] == texts[5]
    for d, passage in ((2, inside), (3, across), (4, short)):
        assert not set(passage) & set(left[d].lower().split())
        assert left[d].lower().split() == [w for w in texts[d].lower().split() if w not in passage]


def test_passages_of_the_smallest_tables(spark):
    texts = dict(table("select doc_id, text from '$/documents.parquet' order by 1"))
    rows = __spark_entry__.queries()["op4_passages"](spark, SF).collect()
    want = {d: held for d, held in held_before(texts).items() if held}
    assert want and covered(r for r in rows if r.paragraph is None) == want
    by_line = {tuple(r) for r in paragraphs.op4_paragraphs(spark, SF).collect()}
    assert {tuple(r)[:5] for r in rows if r.paragraph is not None} == by_line


def test_passages_of_odd_rows(spark):
    long, copied = "Lorem ipsum " * 30_000, " ".join(f"c{k}" for k in range(60))
    rows = [(1, None), (2, ""), (None, copied), (3, long), (4, long + "!"), (5, copied), (5, copied), (6, copied), (6, "x " + copied), (7, "a b")]
    docs = spark.createDataFrame(rows, DOCS)
    got = passages.passages(docs).collect()
    assert {(r.doc_id, r.first_word, r.words, r.first_doc_id) for r in got if not r.kept and r.doc_id > 4} == {(6, 0, 60, 5), (6, 1, 60, 5)}
    assert covered(got)[4] == set(range(60_000)) and 3 not in covered(got)
    assert paragraphs.substring_dedup(docs).count() == len(rows)
    assert passages.passages(docs.limit(0)).count() == 0


def test_least_of_every_window():
    import numpy as np

    from overgrid.llm import passages

    rng = np.random.default_rng(4)
    for size in (passages.WINDOW, passages.WINDOW + 1, 400):
        grams = rng.integers(0, 30, size).astype(np.uint64)  # many equals
        want = {int(grams[a : a + passages.WINDOW].argmin()) + a for a in range(size - passages.WINDOW + 1)}
        assert passages.least(grams).tolist() == sorted(want)


def test_names_alone_need_no_band_keys(spark):
    from overgrid.llm import paragraphs

    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, None), (3, "short")], "doc_id long, text string")
    (named,), (keyed,) = (paragraphs.paragraphs(docs, keyed=k).collect() for k in (False, True))
    assert named["keys"] is None and len(keyed["keys"]) and named["id"] == keyed["id"] and named["size"] == keyed["size"] == 26


def test_texts_of_one_run_share_no_words():
    """Sets, picks and runs are made over many texts at once, as if each text stood alone."""
    import numpy as np

    from overgrid.llm import words as hashing

    some = random.Random(8)
    texts = [" ".join(some.choice("abcdefgh") + str(some.randrange(5)) for _ in range(n)) for n in (0, 3, 49, 50, 51, 120, 4, 5, 49, 400, 0)]
    texts.insert(4, None)
    ((first, last, words, bounds),) = passages._blocks(texts)
    assert (first, last, bounds[-1]) == (0, len(texts), len(words))
    grams, places = passages.picks(words, bounds)
    around, starts = passages.runs_around(words, bounds, places)
    picked, run_at = set(), {}
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = hashing.runs(words[a:b], passages.GRAM)
        assert len(own) == max(0, b - a - passages.GRAM + 1)
        if b - a >= passages.PASSAGE:
            picked |= {a + int(p) for p in passages.least(own)}
            run_at |= {a + k: h for k, h in enumerate(hashing.runs(words[a:b], passages.PASSAGE).tolist())}
    assert set(places.tolist()) == picked and len(grams) == len(places)
    assert dict(zip(starts.tolist(), around.tolist(), strict=True)) == run_at  # every run holds a pick
    for size in (1, 5):
        sets = list(hashing.shingle_sets(texts, size))
        for text, own in zip(texts, sets, strict=True):
            (alone,) = hashing.shingle_sets([text], size)
            tokens = (text or "").split()
            assert np.array_equal(own, alone) and np.array_equal(own, np.unique(own))
            assert len(own) == len({tuple(tokens[k : k + size]) for k in range(max(1, len(tokens) - size + 1))} - {()})


def test_hashes_of_runs_tell_orders_apart():
    from overgrid.llm import words as hashing

    texts = ["a b " * 200, "b a " * 200, "a " * 400, "x y z w"]
    found = {}
    for _, _, words, bounds in passages._blocks(texts):
        for n, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            found[n] = set(hashing.runs(words[a:b], passages.PASSAGE).tolist())
    assert found[0] == found[1] and len(found[0]) == 2 and len(found[2]) == 1 and not found[0] & found[2] and not found[3]


def test_small_groups_are_linked_together():
    """Groups met in one go keep their own classes, two sets take the short way."""
    import numpy as np

    from overgrid.llm import linking

    a, b, c = (np.arange(n, n + 20, dtype=np.uint64) for n in (0, 2, 15))
    assert linking.link_group([a, b], 80).tolist() == [0, 0]  # 18 of 22
    assert linking.link_group([a, b], 82).tolist() == [0, 1]
    assert linking.link_group([a, b, c], 80).tolist() == [0, 0, 2]


def test_only_wanted_lines_move(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from overgrid.llm.collocations import bloom

    line = lambda k: " ".join(f"w{k}x{i}" for i in range(25))
    docs = spark.createDataFrame([(d, f"short\n{line(d)}\n{line(d + 100)}") for d in range(-1, 30)] + [(40, None)], DOCS)
    keys = paragraphs.place_keys(np.array([-1, 3, 40]), np.array([1, 2, 1])).view(np.int64).tolist()
    wanted = spark.sparkContext.broadcast(bloom(spark.createDataFrame([(k,) for k in keys], "key long"), 3))
    places = spark.createDataFrame([(-1, 1), (3, 2), (40, 1)], "doc_id long, paragraph int")
    assert sorted(r.k for r in places.select(paragraphs._place("doc_id", "paragraph").alias("k")).collect()) == sorted(keys)
    got = paragraphs.wanted_lines(docs, wanted, 20).filter(F.col("doc_id").isin(-1, 3, 40)).collect()
    assert sorted(map(tuple, got)) == [(-1, 1, line(-1)), (3, 2, line(103))]
