"""Operators of the training-data part against plain versions, and on odd input."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from xcomm.llm import additive_model, cover_tree, deobfuscation, jaccard_join, licences, line_rules, mixing, packing, sharding, suffix_dedup
from xcomm.llm.common import components

SF001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size long, row string, h long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, s, 7, "x", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n)) + "."
    base = prose(160)
    near = base.split(" ")
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one", "b"), (5, "one two", "b"), (6, "One  TWO", None)]
    rows += [(k, base, "a") for k in (10, 11, 12)] + [(10, base, "a"), (None, base, "a"), (None, None, None)]
    for k in range(20, 30):
        words = list(near)
        for _ in range(k - 20):
            words[rnd.randrange(len(words))] = "new" + str(rnd.randrange(99))
        rows.append((k, " ".join(words), "c"))
    passage = prose(90)
    rows += [(k, prose(60) + "\n" + passage + "\n" + prose(30), "d") for k in range(30, 34)]
    rows += [(40, prose(30000), "d"), (41, "ab" * 700, "d"), (42, "na " * 400, "e"), (43, "é" * 500 + prose(20), "e")]
    rows += [(50 + k, prose(rnd.randint(1, 80)), rnd.choice("abcde")) for k in range(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return frame(spark, odd).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


# toxicity ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic(spark):
    table = lambda t: spark.read.parquet(f"{SF001}/{t}.parquet")
    rows = [(1000 + k, f"the thing {w} here and there number {k}.", int(w in ("idiot", "moron"))) for k, w in enumerate(["idiot", "moron", "table", "garden"] * 20)]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = deobfuscation.train_toxicity(table("documents").select("doc_id", "text").union(made.select("doc_id", "text")), made.select("doc_id", "toxic"), F.lit(True))
    return model


@pytest.mark.parametrize("seen", ["1d10t", "i d i o t", "I.D.I.O.T", "iiidiooot", "id*ot", "!d!ot", "idi0t!", "1 d 1 0 t", "ｉｄｉｏｔ", "іdiоt", "idi​ot", "iiddiioott"])
def test_restores_disguised_words(toxic, seen):
    (body, _), = deobfuscation.Restorer(toxic.language).texts(pa.array([f"the on {seen} ention and"]))
    assert b"idiot" in deobfuscation.features(body), body


@pytest.mark.parametrize("seen", ["iddiot", "idiiot", "morron", "mooronn", "id iot", "idi ot", "i   d   i   o   t", "i d  i   o t", "i -- d i --- o t", "id   iot", "mo ron"])
def test_restores_doubled_and_cut_words(toxic, seen):
    (body, _), = deobfuscation.Restorer(toxic.language).texts(pa.array([f"the on {seen} ention and"]))
    assert {b"idiot", b"moron"} & deobfuscation.features(body), body


@pytest.mark.parametrize("first", [0x1D41A, 0x1D4EA, 0x24D0, 0x1D552, 0x1F130, 0x1F150, 0x249C])
def test_restores_styled_letters(toxic, first):
    seen = "".join(chr(first + ord(c) - 97) for c in "idiot")
    (body, _), = deobfuscation.Restorer(toxic.language).texts(pa.array([f"the on {seen} ention and"]))
    assert b"idiot" in deobfuscation.features(body), body


def test_words_of_other_scripts(spark):
    words = {"ru": ("дурак", "привет"), "ar": ("غبي", "كتاب"), "he": ("טיפש", "שולחן"), "ko": ("바보", "정원"), "hi": ("मूर्ख", "बगीचा"), "el": ("βλάκας", "κήπος")}
    rows = [(100 * k + i, f"{w[i % 2]} {i}", 1 - i % 2) for k, w in enumerate(words.values()) for i in range(20)]
    rows += [(900 + i, f"你是{'笨蛋' if i % 2 else '朋友'}吗", i % 2) for i in range(20)]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = deobfuscation.train_toxicity(made.select("doc_id", "text"), made.select("doc_id", "toxic"), F.lit(True))
    for r in deobfuscation.score_toxicity(made, model).collect():
        assert (r.score > 0.5) == bool(r.row.toxic), (r, model.weights)
    assert deobfuscation.without_toxic(made, model).count() == 70


def test_plain_short_words_stay(toxic):
    text = "it is on the good letter and all of us see it too"
    (body, n), = deobfuscation.Restorer(toxic.language).texts(pa.array([text]))
    assert n == 0 and body.decode().strip() == text


def test_clean_spans_stay(toxic):
    text = "plain words, with stops. and two lines\nof it"
    (body, n), = deobfuscation.Restorer(toxic.language).texts(pa.array([text]))
    assert n == 0 and body.decode().strip() == text


def test_toxicity_scores(spark, docs, none, toxic):
    rows = frame(spark, [(1, "you 1d10t", "a"), (2, "a garden", "a"), (3, None, "a"), (4, "", None), (4, "", None), (5, "m o r o n " * 5000, "b")])
    got = {r.row.doc_id: r.score for r in deobfuscation.score_toxicity(rows, toxic).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == got[2] and got[5] > 0.5
    assert deobfuscation.score_toxicity(docs, toxic).count() == docs.count()
    assert deobfuscation.score_toxicity(none, toxic).count() == 0
    assert sorted(r.doc_id for r in deobfuscation.without_toxic(rows, toxic).collect()) == [2, 3, 4, 4]
    assert deobfuscation.restored_texts(rows, toxic.language).where("n_spans > 0").count() == 2
    empty = deobfuscation.train_toxicity(none, none.select("doc_id", F.lit(1).alias("toxic")), F.lit(True))
    assert {r.score for r in deobfuscation.score_toxicity(rows, empty).collect()} == {0.5}


# vectors -------------------------------------------------------------------------------------


def test_cover_tree_against_all_pairs(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(30, 8))
    rows = []
    for k in range(500):
        v = centres[rnd.integers(30)] + rnd.normal(size=8) * rnd.choice([0.02, 0.12, 0.3])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rnd.integers(3))))
    rows += [(500 + k, rows[7][1], rows[7][2]) for k in range(60)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 8, 1), (603, [1.0, None] + [0.0] * 6, 1), (604, [math.nan] * 8, 1), (605, [math.inf] + [0.0] * 7, 1)]
    rows += [(606, rows[7][1], None), (607, rows[7][1][:4], rows[7][2]), (None, rows[8][1], rows[8][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string").repartition(4)
    got = {r.row.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(table, block=64).collect()}
    good = [(i, np.asarray(v, float), g) for i, v, g in rows if g is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, least = Counter(), {}
    parent = list(range(len(good)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (i, u, g)), (b, (j, v, h)) in itertools.combinations(enumerate(good), 2):
        if g == h and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.98:
            links[i] += 1
            links[j] += 1
            parent[top(a)] = top(b)
    for a, (i, _, _) in enumerate(good):
        if i is not None:
            least[top(a)] = min(least.get(top(a), 10**9), i)
    want = {i: (links[i], least[top(a)], least[top(a)] == i) for a, (i, _, _) in enumerate(good)}
    for i, *_ in rows:
        assert got[i] == want.get(i, (0, i, True)), i
    assert cover_tree.near_duplicates(table.where("false")).count() == 0


# line rules ----------------------------------------------------------------------------------


def test_line_rules_base_counts(docs, odd, none):
    got = defaultdict(list)
    for r in line_rules.clean_lines(docs).collect():
        got[r.row.text].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.cleaned))
    for _, text, _ in odd:
        body = text or ""
        words = WORD.findall(body)
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in body.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        for g in got[text]:
            assert g[:6] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), len(covered), failed)
            assert not (g[6] and failed)
    assert line_rules.clean_lines(none).count() == 0


def test_line_rules_lines(spark):
    good = "A sentence of quite some words stands here and ends well."
    bad = ["home | about | contact | help", "Accept cookies to go on.", "All rights reserved.", "wh%%% a### of*** is&&&", "menu"]
    rows = frame(spark, [(1, "\n".join([good] * 8 + bad), "a"), (2, "\n".join([good] + bad * 20), "a")])
    got = {r.row.doc_id: r for r in line_rules.clean_lines(rows).collect()}
    assert got[1].cleaned == "\n".join([good] * 8) and got[1].n_failed_lines == 5
    assert not got[2].kept and got[2].cleaned == good


# sharding ------------------------------------------------------------------------------------


def test_sharding(docs, odd, none):
    written, manifest = sharding.shuffle_into_shards(docs, shards=4, bucket_bytes=20_000)
    rows = written.join(manifest, ["shard", "bucket"]).select("row", "shard", (F.col("first_slot") + F.col("pos")).alias("slot"), sharding.shard_of(F.col("row.doc_id"), 5, 7).alias("grown")).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in rows) == Counter((i, t) for i, t, _ in odd)
    assert manifest.groupBy("shard").count().agg(F.max("count")).first()[0] > 1
    by_key, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by_key[r.row.doc_id].add((r.shard, r.grown))
        slots[r.shard].append(r.slot)
        assert r.grown in (r.shard, 4)
    assert all(len(s) == 1 for s in by_key.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again, _ = sharding.shuffle_into_shards(docs, shards=4, bucket_bytes=20_000)
    key = ["shard", "bucket", "pos"]
    assert written.select("row.doc_id", "row.text", *key).exceptAll(again.select("row.doc_id", "row.text", *key)).count() == 0
    for n in (0, 1, 2, 50):
        assert sorted(sharding.fisher_yates(n, 3)) == list(range(n))
    empty, plan = sharding.shuffle_into_shards(none)
    assert empty.count() == plan.count() == 0


# mixing --------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    open_, left, target = set(names), share * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_mixing(docs, odd, none):
    got = mixing.mix_sources(docs, keep=("doc_id", "text", "source", "size")).collect()
    sizes = Counter()
    for _, t, s in odd:
        sizes[s] += len(WORD.findall(t or ""))
    target, taken = plain_targets(sizes), Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r.row.text or "")) and r.taken in (0, r["size"], 2 * r["size"])
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6)
        taken[r.source] += r.taken
    for s in sizes:
        longest = max([len(WORD.findall(t or "")) for _, t, x in odd if x == s], default=0)
        assert abs(taken[s] - target[s]) <= longest / 2 + 1e-6
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.times for r in got)
    assert mixing.mix_sources(none).count() == mixing.mixed_documents(none).count() == 0


def test_mixing_splits_equal_rows(spark):
    rows = frame(spark, [(1, "a b c d", "a")] * 300 + [(k, "x y", "b") for k in range(100, 200)]).repartition(4)
    got = mixing.mix_sources(rows, keep=("doc_id",)).groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) <= 4 for r in got)


# repeated passages ---------------------------------------------------------------------------


def plain_removal(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [3, 4])
def test_repeated_passages(spark, odd, none, batches):
    rnd = random.Random(batches)
    core = "".join(rnd.choices("abcdefghij ", k=1500))
    rows = [r for r in odd if r[0] != 40]
    for k in range(12):  # pieces of one text at odd places, some at the very start or end
        a = rnd.randrange(0, 1000)
        piece = core[a : a + rnd.randint(380, 500)]
        rows.append((200 + k, rnd.choice(["", "x" * rnd.randint(1, 500)]) + piece + rnd.choice(["", "y" * rnd.randint(1, 9)]), "f"))
    got = defaultdict(set)
    table = frame(spark, rows).repartition(3)
    for r in suffix_dedup.remove_repeats(table, keep=("doc_id", "text", "row"), batches=batches).collect():
        got[r.row.text].add((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    for (_, text, _), want in zip(rows, plain_removal([r[1] for r in rows], 400), strict=True):
        assert got[text] == {want}, text and text[:60]
    if batches == 3:
        assert suffix_dedup.remove_repeats(none).count() == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    body = "".join(rnd.choices("abcdefghij ", k=9000))
    data = np.frombuffer(body.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole, cut = set(), set()
    for part, cuts, _, base, _, low, high in suffix_dedup.Pieces(data, offsets, 400):
        _, a, first, last, _, _ = suffix_dedup.anchors(part, cuts, low, high, 400)
        cut |= {(int(x) + int(base[0]), p + int(base[0])) for x, f, q in zip(a, first, last, strict=True) for p in range(f, q + 1)}
    _, a, first, last, _, _ = suffix_dedup.anchors(data, offsets, np.zeros(1, int), np.array([len(data)]), 400)
    whole = {(int(x), p) for x, f, q in zip(a, first, last, strict=True) for p in range(f, q + 1)}
    assert cut == whole and len({p for _, p in whole}) == len(data) - 399


def test_texts_of_many_pieces_keep_what_stands_once(spark):
    letters = np.random.default_rng(6).integers(97, 123, 9 << 20).astype(np.uint8).tobytes().decode()
    edge = suffix_dedup.PIECE
    alone, rest = letters[: 2 * edge + 9000], letters[2 * edge + 9000 : 4 * edge + 20000]
    passage = letters[-900:]
    copied = rest[: edge - 451] + "#" + passage + "%" + rest[edge + 451 :]
    rows = [(1, alone, "a"), (2, copied, "a"), (3, "<" + passage + ">", "a")]
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame(spark, rows)).drop("cleaned").collect()}
    assert got == {1: (len(alone), 0, 0), 2: (len(copied), 900, 1), 3: (902, 900, 1)}


def plain_words(texts, n):
    """Texts without the bytes that ``n`` words in sequence cover which start twice or more."""
    found = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    seen = Counter(tuple(w[2] for w in f[k : k + n]) for f in found for k in range(len(f) - n + 1))
    out = []
    for t, f in zip(texts, found, strict=True):
        gone = np.zeros(len((t or "").encode()), bool)
        for k in range(len(f) - n + 1):
            if seen[tuple(w[2] for w in f[k : k + n])] > 1:
                gone[f[k][0] : f[k + n - 1][1]] = True
        out.append(np.frombuffer((t or "").encode(), np.uint8)[~gone].tobytes().decode())
    return out


@pytest.mark.parametrize("piece", [2 << 20, 40])
def test_passages_of_many_short_words(spark, monkeypatch, piece):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rnd = random.Random(8)
    prose = lambda k: [rnd.choice("abcdé") * rnd.randint(1, 2) + rnd.choice("xyz") for _ in range(k)]
    core, texts = prose(160), ["", None, "a", " \n", " ".join(prose(60)), "b " * 70, "b\t" * 49, "c " * 50]
    for k in range(14):  # cuts of one text, in other white space, alone or between other words
        at, size = rnd.randrange(0, 100), rnd.choice([49, 50, 51, 53, 60])
        texts.append(rnd.choice(" \n").join([*prose(rnd.choice([0, 30])), *core[at : at + size], *prose(rnd.choice([0, 9, 70]))]))
    texts += [texts[-1], texts[4]]
    table = frame(spark, [(k, t, "s") for k, t in enumerate(texts)]).repartition(3)
    found = suffix_dedup.repeated_words(table, "text", 50).distinct().count()
    got = {r.row.doc_id: r.cleaned for r in suffix_dedup.remove_repeats(table, length=10**6, words=50).collect()}
    assert found and [got[k] for k in range(len(texts))] == plain_words(texts, 50)


def test_pipeline_cuts_short_passages_of_over_fifty_words(spark):
    import corpus_pipeline

    rnd = random.Random(4)
    prose = lambda k: " ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(k))
    passage, before = prose(52), [prose(150) for _ in range(4)]  # 259 bytes
    rows = [(k, b + " " + passage if k < 2 else b, "s") for k, b in enumerate(before)]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, frame(spark, rows), None).collect()}
    assert got == {k: b + " " * (k < 2) for k, b in enumerate(before)}


# Jaccard -------------------------------------------------------------------------------------


def plain_components(rows, n, percent):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(set(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[top(a)] = top(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least[top(a)] = min(least.get(top(a), 10**9), i)
    return [(len(sets[a]), least.get(top(a))) for a in range(len(rows))]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, odd, none, n, percent):
    rnd = random.Random(n)
    short = [(300 + k, " ".join(rnd.choices("abcd", k=rnd.randint(3, 30))), "g") for k in range(120)]
    rows = [*odd, *short]
    got = defaultdict(set)
    found = jaccard_join.jaccard_components(frame(spark, rows).repartition(4), keep=("doc_id", "text"), n_words=n, percent=percent)
    for r in found.collect():
        got[(r.row.doc_id, r.row.text)].add((r.n_shingles, r.component_id))
    for (i, t, _), want in zip(rows, plain_components(rows, n, percent), strict=True):
        assert got[(i, t)] == {want}, i
    assert jaccard_join.jaccard_components(none).count() == 0


# quality -------------------------------------------------------------------------------------


def test_quality_model(spark, docs, none):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefg", k=4))
    rows = [(k, " ".join(word() + ("%%%" if k % 2 else "") for _ in range(60)), "a") for k in range(300)]
    table = frame(spark, rows)
    labels = table.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    model = additive_model.train_quality(table, labels, F.col("doc_id") < 200)
    scores = {r.row.doc_id: r.score for r in additive_model.score_quality(table, model).collect()}
    assert all((scores[k] >= 0.5) == (k % 2 == 0) for k in range(200, 300))
    odd_scores = additive_model.score_quality(docs, model).collect()
    assert len(odd_scores) == docs.count() and all(0 <= r.score <= 1 for r in odd_scores)
    assert additive_model.score_quality(none, model).count() == 0
    blank = additive_model.train_quality(table, labels.where("false"), F.lit(True))
    assert {r.score for r in additive_model.score_quality(table, blank).collect()} == {0.5}


def test_features_do_not_depend_on_slices():
    texts = ["a b c\nA B", None, "", "x! y! x! y!", "über 12"]
    alone = np.concatenate([additive_model.text_features(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(alone, additive_model.text_features(pa.array(texts)))


# licences ------------------------------------------------------------------------------------


def test_licences(spark, docs, none):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. "
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    texts = {
        1: "Intro.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.",
        2: "MIT License\n\n" + grant + notice + "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
        3: notice + grant,
        4: "This work is licensed under the GNU General Public License, version 3.",
        5: "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
        6: "My license plate is lost. All rights are reserved.",
        7: None,
        8: "All rights reserved.",
    }
    got = {r.row.doc_id: (r.licences, r.rules) for r in licences.scan_licences(frame(spark, [(k, t, None) for k, t in texts.items()])).collect()}
    assert got[1] == (["MIT", "CC-BY-NC-4.0"], ["MIT:reference", "CC-BY-NC-4.0:reference"])
    assert got[2] == (["MIT"], ["MIT:full"]) and got[3] == ([], []) and got[4][0] == ["GPL-3.0"]
    assert got[5] == (["Apache-2.0"], ["Apache-2.0:notice"]) and got[6] == got[7] == ([], []) and got[8][0] == ["proprietary"]
    assert licences.scan_licences(docs).count() == docs.count() and licences.scan_licences(none).count() == 0


MIT = [
    "MIT License",
    "Copyright (c) 2020 A. Person",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.',
]
BSD = [
    "Copyright 2020 A. Person",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the University of Nowhere nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.',
]
APACHE = [
    "Copyright 2020 A. Person",
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
]


@pytest.mark.parametrize("width", [72, 40, 10_000])
def test_wrapped_licence_texts(spark, width):
    want = {"MIT:full": MIT, "BSD-3-Clause:full": BSD, "BSD-2-Clause:full": BSD[:4] + BSD[5:], "Apache-2.0:notice": APACHE, "GPL-3.0:notice": GPL}
    texts = {}
    for rule, paragraphs in want.items():
        lines = [x for p in paragraphs for x in [*textwrap.wrap(p, width), ""]]
        for prefix in ("", "# ", " * ", "// ", ";; ", "dnl "):
            texts[len(texts)] = rule, "import x\n" + "\n".join((prefix + x).rstrip() for x in lines) + "\nrest"
        texts[len(texts)] = rule, "\r\n".join(["/*", *lines, "*/"])
    whole = ["Apache License Version 2.0, January 2004", "http://www.apache.org/licenses/", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"]
    texts[len(texts)] = "Apache-2.0:full", "\n\n".join(whole)
    texts[len(texts)] = None, "Nothing here is licensed under the Apache License, Version 2.0 and nobody has the MIT License or all rights reserved by."
    texts[len(texts)] = None, "\n\n".join(textwrap.fill(p, 30).replace(" ", "\n\n", 1) for p in (MIT[2], BSD[1]))
    rows = frame(spark, [(k, t, None) for k, (_, t) in texts.items()])
    got = {r.row.doc_id: r.rules for r in licences.scan_licences(rows).collect()}
    for k, (rule, text) in texts.items():
        assert got[k] == ([rule] if rule else []), text


# packing -------------------------------------------------------------------------------------


def test_packing(docs, odd, none):
    placed = packing.pack_documents(docs, group_pieces=25).collect()
    words = defaultdict(Counter)
    bins = defaultdict(list)
    for r in placed:
        words[r.row.doc_id][(r.first_word, r.n_words)] += 1
        bins[r.bin].append((r.start, r.n_words, r.capacity, r.used))
    for i in {i for i, _, _ in odd}:
        want = Counter()
        for j, t, _ in odd:
            if j == i:
                n = len(WORD.findall(t or ""))
                want.update((a, min(4096, n - a)) for a in range(0, n, 4096))
        assert words[i] == want
    for parts in bins.values():
        at = 0
        for start, n, capacity, used in sorted(parts):
            assert start == at and capacity in packing.CAPACITIES and used <= capacity
            at += n
        assert at == parts[0][3] and not any(at <= c < parts[0][2] for c in packing.CAPACITIES)
    assert packing.pack_documents(none).count() == 0


def test_best_fit_choices():
    lengths = np.array([300, 200, 200, 12, 500, 4096, 1])
    bins, starts, capacity = packing.pack(lengths)
    assert bins[5] not in set(np.delete(bins, 5)) and capacity[5] == 4096 and starts[5] == 0
    bins, _, capacity = packing.pack(np.array([500, 400, 100, 12]), capacities=(512,))
    assert bins.tolist()[:3] == [0, 1, 1] and bins[3] in (0, 1) and set(capacity) == {512}
    assert packing.opening_capacity(400, 0) == 512 and packing.opening_capacity(600, 10**9) in (1024, 2048)


# queries -------------------------------------------------------------------------------------


def test_near_duplicates_keep_one_row_of_a_group(spark):
    import corpus_pipeline

    rnd = random.Random(9)
    prose = lambda: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(120))
    a, b, c, d, e = (prose() for _ in range(5))
    near = lambda t, k: t + f" more{k}"
    # a: smaller id elsewhere; b and c: stand once under the repeated id; d: one id only; e: no ids
    rows = [(1, a), (7, near(a, 1)), (7, b), (7, c), (7, d), (7, near(d, 1)), (7, near(d, 2)), (None, e), (None, near(e, 1)), (9, near(d, 3))]
    rows += [(None, near(a, 2)), (7, ""), (7, None), (None, None), (None, "")]
    table = frame(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, table, None)
    assert got.columns == table.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert Counter(t for i, t in found if not t) == Counter({"": 2, None: 2}) and Counter(i for i, t in found if not t) == Counter({7: 2, None: 2})
    left = [(i, t) for i, t in found if t]
    assert {(1, a), (7, b), (7, c)} <= set(left) and len(left) == 5
    assert sorted((i is None, t[:20]) for i, t in left if t[:20] in (d[:20], e[:20])) == sorted([(False, d[:20]), (True, e[:20])])


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    from xcomm.llm import queries

    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    n = docs.count()
    for name in ("op4_sharding", "op9_licences"):
        assert queries.QUERIES[name](spark, SF001).count() == n
    crc = {r.doc_id: (r.size, r.text_crc32) for r in queries.QUERIES["op4_sharding"](spark, SF001).collect()}
    assert crc == {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect()}
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF001).cache()
        assert after.columns == columns or name == "packing"
        assert after.count() > 0
        before = after
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        if name != "toxicity":
            assert stage(spark, empty, SF001).count() == 0
