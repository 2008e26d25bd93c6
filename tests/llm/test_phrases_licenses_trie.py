"""Collocations, license scans and the conversation trie against plain versions, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from overgrid.llm import collocations, conversations, licenses, queries, trie
from overgrid.llm.common import shared_folder
from tools.check import canon, connect

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


@pytest.mark.parametrize("name", ["op11_collocations", "op12_licenses", "op13_conversations"])
def test_whole_tables_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    want = connect(SF).execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(df.columns, df.collect()) == canon(columns, want.fetchall())


# Tries and phrases


def test_trie_counts_as_a_dictionary_does():
    draw = np.random.default_rng(3)
    for words in (5, 300, 70_000):
        phrases = {tuple(draw.integers(1, words, draw.integers(2, 6)).tolist()) for _ in range(3000)}
        listed = sorted(phrases)
        made = trie.build(np.array([w for p in listed for w in p], dtype=np.uint64), np.array([len(p) for p in listed]))
        text = np.concatenate([np.array([*p, 0] if draw.random() < 0.5 else p) for p in draw.permutation(np.array(listed, dtype=object)).tolist()] * 2).astype(np.uint64)
        counts = np.zeros(len(listed), dtype=np.int64)
        made.count(made.ids(text), 5, counts)
        runs = Counter(tuple(text[i : i + m].tolist()) for m in range(2, 6) for i in range(len(text) - m + 1))
        assert counts.tolist() == [runs[p] for p in listed]
    empty = trie.build(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    empty.count(empty.ids(np.arange(5, dtype=np.uint64)), 5, np.zeros(0, dtype=np.int64))


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = defaultdict(list)
    frequent = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    for (lang, p), a in frequent.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(o == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in frequent.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("tries_of", [250_000, 7])
def test_collocations_against_plain_counts(spark, tries_of):
    draw = random.Random(4)
    words = ["New", "york", "city", "é", "K", "a", "b", "the", "x-y", "c"]
    rows = [(draw.choice(["en", "de", None]), draw.choice(["", " ", "\n"]).join(draw.choice(["", "", " "]) + draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(draw.randrange(60)))) for _ in range(60)]
    rows += [("en", None), (None, None), ("de", ""), ("fr", "once only"), ("en", "new york city " * 3000), ("en", "a b " * 20), ("en", "a b " * 20)]
    docs = spark.createDataFrame([(i, t, lang, 1, 2, 3, "k") for i, (lang, t) in enumerate(rows)], "doc_id int, text string, lang string, f int, n int, key int, phrase string")
    got = collocations.collocations(docs, least=4, top=25, tries_of=tries_of).collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, 4, 25)


def test_collocations_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    few = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert collocations.collocations(few).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(few).count() == 0


@pytest.mark.parametrize("least", [40, 300])
def test_a_frequent_pair_is_told_by_one_part(spark, least):
    """Keys that all parts of the arrays have are counted over all, but named in the first of them only."""
    rows = [("en", "new york city. " * 45 + f"own{k} word{k}") for k in range(8)] + [("de", "new york " * 39)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartitionByRange(8, "text")
    folder = shared_folder(spark)
    arrays, vocabulary, _ = collocations._read(docs, folder)
    assert arrays.select("part").distinct().count() > 1
    words = vocabulary.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "key")
    sc, total = spark.sparkContext, vocabulary.agg(F.sum("n")).first()[0]
    filters, blocks = [sc.broadcast(collocations.bloom(words, words.count()))], collocations.blocks_of(total)
    often = collocations.frequent_keys(collocations.pair_counts(arrays, filters, least, blocks), least, blocks)
    assert often.count() == often.select("key").distinct().count() == 2  # new york, york city
    wanted = sc.broadcast(collocations.bloom(often.select(F.col("mark").alias("key")), often.count(), each=64))
    told = collocations.pairs_of(arrays, filters, wanted)
    assert {r.key for r in told.join(often, "key", "left_semi").collect()} == {r.key for r in often.collect()}
    firsts = arrays.filter("lang = 'en'").agg(F.min("part")).first()[0]
    others = collocations.pairs_of(arrays.filter(F.col("part") != firsts), filters, wanted)
    assert others.join(often, "key", "left_semi").count() == 0
    named = collocations.candidates(arrays, words, total, folder, least, 5)
    assert sorted(r.phrase for level in named for r in level.collect()) == ["new york", "new york city", "york city"]


def test_packed_keys_come_back():
    draw = np.random.default_rng(3)
    for bits, start in ((54, 0), (54, 1023 << 54), (9, 5 << 54)):
        keys = np.unique(draw.integers(0, 1 << bits, 300, dtype=np.uint64)) + np.uint64(start)
        raw = collocations.packed(keys, start)
        assert np.array_equal(collocations.unpacked(raw, len(keys), start), keys) and len(raw) < 8 * len(keys)
    assert collocations.unpacked(collocations.packed(keys[:1], int(keys[0])), 1, int(keys[0])).tolist() == keys[:1].tolist()


def test_long_pieces_are_cut_between_pieces_only():
    texts = ["w " * 700_000 + ". " + "v " * 900_000, "x"]
    assert b"".join(collocations.chunks(texts)) == "\n".join(texts).encode() + b"\n"
    assert all(c.rstrip()[-1:] in b".vx" for c in collocations.chunks(texts))


# Licenses


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def plain_base(text):
    words = plain_words(text)
    phrases = {tuple(t.text.split()): t.label for t in licenses.PHRASES}
    at = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licenses_base_labels_and_edited_notices(spark):
    notice = licenses.NOTICES[0].text
    words = notice.split()
    edited = " ".join([*words[:6], "very", "freely", *words[6:12], *words[13:]])
    apart = " ".join(words[:7]) + " " + " ".join(["filler"] * 60) + " " + " ".join(words[14:])
    texts = [
        "GNU General\nPublic-License; the MIT license. MIT\tLICENSE cc by cc by", None, "", "mit", "apache", "Apache License" * 2,
        "gnu general general public license", "mİt license K", f"x {notice} y", f"intro words {edited} more", apart, "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", "mit license " * 30_000, "é mit license", "\u0000mit\u007flicense",
    ]
    rows = [(i, t, "k", 1, 2, 3) for i, t in enumerate(texts)] + [(0, texts[0], "k", 1, 2, 3), (None, "cc by", "k", 1, 2, 3), (None, None, "k", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, w int, i int, sig int")
    got = licenses.license_scan(docs).collect()
    base = sorted((repr(r.doc_id), r.n_words, r.n_base, repr(r.first_word), repr(r.last_word), r.base_labels) for r in got)
    want = sorted((repr(i), n, b, repr(x), repr(y), labels) for i, t, *_ in rows for n, b, x, y, labels in [plain_base(t)])
    assert base == want
    found = {r.doc_id: (r.labels, r.score) for r in got}
    assert found[8] == ("mit-notice", 1.0)
    assert found[9][0] == "mit-notice" and 0.7 <= found[9][1] < 1.0
    assert found[10] == ("", 0.0)  # its halves are too far apart for one span
    assert found[11][0] == "cc-by,cc-by-nc-4.0" and found[12][0] == "gpl,gpl-3.0"
    assert all(0.0 <= r.score <= 1.0 for r in got)


def test_licenses_plan_runs_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = licenses.license_scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)
    with pytest.raises(Exception, match="too short"):
        licenses.license_scan(docs, [licenses.Template("x", "two words")]).collect()
    assert licenses.license_scan(docs.limit(0)).count() == 0
    assert licenses.license_scan(docs, []).agg({"n_base": "sum"}).first()[0] == 0


# Conversations


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple([*own.get(c - c % 20, [])[:h], *turns[h:]])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, held in members.items():
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(held) - 1) * words
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def by_node(found):
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("parts", ["1", "4", "37"])
def test_trie_of_conversations_in_any_number_of_parts(spark, parts):
    draw = random.Random(9)
    rows = []
    for c in [*range(0, 130), 400, 401, 777]:
        if c in (20, 60):
            continue  # an absent base
        rows += [(c, t, draw.choice(["user", "bot", None]), draw.choice(["a", "b c", "", None, "d\te  f"])) for t in range(draw.randrange(1, 5))]
    rows += [(c, t, "user", f"common {t}") for c in range(500, 540) for t in range(6)]  # copies, and prefixes of them
    rows += [(c, t, "user", f"common {t}") for c in range(540, 560) for t in range(c % 5)]
    rows += [(560, None, "user", "first"), (560, 1, "user", "x"), (560, 1, "user", "y"), (560, 1, "user", "y"), (None, 1, "user", "z")]
    rows += [(600, t, "user", f"deep {t}") for t in range(900)] + [(601, t, "user", f"deep {t}") for t in range(700)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, key string, depth int")
        got = conversations.prefix_trie(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert by_node(got) == sorted(plain_trie(rows), key=repr)


def test_trie_of_no_conversation_and_of_turnless_ones(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(c, 0, "user", "x") for c in (21, 22, 23, 24, 25, 26, 27, 28)]  # no base, and most have no more turns than the head has
    got = conversations.prefix_trie(spark.createDataFrame(rows, schema)).collect()
    assert by_node(got) == sorted(plain_trie(rows), key=repr)
