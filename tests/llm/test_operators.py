"""Each operator on made-up rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, brute force."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.llm import kernels as K
from passagemill.llm import language, line_dedup, mixing, packing, pii, quality, scratch, sharding, skew, toxicity
from passagemill.llm.components import connected_components
from passagemill.llm.exact_dedup import exact_dedup
from passagemill.llm.ngram_join import ngram_jaccard_join

SCHEMA = "doc_id long, text string, lang string, source string"
_r = random.Random(5)
WORDS = ["".join(_r.choice("abcdefghij") for _ in range(_r.randrange(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, k, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(k):
        words[r.randrange(len(words))] = "edit" + str(r.randrange(10**6))
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base, shared = prose(120, 1), prose(60, 2)
    out = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, "one two", "en", "b"), (4, "One  TWO", "en", "b"), (5, "1 2 3", "fr", None)]
    out += [(10 + k, edited(base, k % 4, k), "en", "a") for k in range(12)]
    out += [(30 + k, base.replace(" ", "  ") if k % 2 else base, "en", "hot") for k in range(6)]
    out += [(50 + k, prose(30 + 5 * k, 50 + k) + "\n" + shared + "\n" + prose(20, 90 + k), "de", "hot") for k in range(8)]
    out += [(70, prose(6000, 7), "es", "c"), (71, "x" * 5000, "es", "c"), (72, "même été çà " * 20, "fr", "c")]
    return out + [out[12], (30, "other text under the same id " + prose(10, 3), "en", "a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- kernels


def test_word_hashes_agree_with_split():
    texts = ["Aa b\x0bc\x1cd", None, "", " x ", "é é", "w" * 3000 + " tail"]
    old, K.CHUNK = K.CHUNK, 16
    try:
        hashes, limits = K.word_hashes(pa.array(texts))
    finally:
        K.CHUNK = old
    seen = {}
    for n, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        assert len(words) == limits[n + 1] - limits[n]
        for w, h in zip(words, hashes[limits[n] : limits[n + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_segments_cut_long_texts_at_white_space():
    data, offsets = K.text_buffer(pa.array(["aa bb cc dd ee", "ff"]))
    parts = [(bytes(p), o.tolist()) for p, _, o in K.chunks(data, offsets, 6)]
    assert b"".join(p for p, _ in parts) == b"aa bb cc dd eeff" and all(len(p) <= 6 for p, _ in parts)


# --- 1


def test_targets_fill_up_to_caps(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 100), (None, 40)], "source string, source_size long")
    got = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    size = {"a": 100, "b": 10, "c": 100, None: 40}
    target, todo, left = {}, set(size), 375.0
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in todo) for s in todo}
        over = [s for s in todo if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = 2 * size[s], left - 2 * size[s]
            todo.discard(s)
    assert {s: pytest.approx(v) for s, v in target.items()} == {s: r["target"] for s, r in got.items()}


def test_mix_meets_targets_and_order(docs, rows, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for group in by.values():
        assert sum(r["size"] for r in group) == group[0]["source_size"]
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 1
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in got}
    assert mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, ((0, 1.0), (0.3, 0.0), (0.6, 0.0), (1, 3.0))])
def test_demand_time_inverts_the_integral(spark, schedule):
    shares = [0.0, 0.05, 0.2, 0.3, 0.5, 0.77, 0.999]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.demand_time(F.col("s"), schedule).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, *zip(*schedule, strict=True))
    area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)]) / ((weight[1:] + weight[:-1]) / 2).sum()
    for r in got:
        assert np.interp(r["t"], grid, area) == pytest.approx(r["s"], abs=1e-6)
    with pytest.raises(ValueError):
        mixing.demand_time(F.lit(0.5), ((0.1, 1.0), (1, 1.0)))


def test_positions_by_brute_force(docs):
    """Every pass starts where its source's demand reaches the words before it; the mix has the rows that the plan takes."""
    got = mixing.mix_sources(docs).collect()
    names = sorted({r["source"] for r in got}, key=lambda x: (x is None, x or ""))
    for no, name in enumerate(names):
        group = [r for r in got if r["source"] == name]
        schedule, goal = mixing.SCHEDULES[no % 3], max(1, round(group[0]["target"]))
        passes = sorted((p["position"], p["words"]) for r in group for p in r["passes"])
        grid = np.linspace(0, 1, 100_001)
        weight = np.interp(grid, *zip(*schedule, strict=True))
        area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        before = 0
        for position, words in passes:
            assert np.interp(position, grid, area / area[-1]) == pytest.approx(before / goal, abs=1e-4)
            before += words
    wanted = Counter()
    for r in got:
        wanted[r["doc_id"], r["size"]] += sum(2 * p["words"] >= r["size"] for p in r["passes"])
    mixed = mixing.mixed_documents(docs.withColumn("position", F.lit("clash")).withColumn("_row", F.lit(1)))
    assert mixed.columns == [*docs.columns, "position", "_row"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], size(r["text"])) for r in mixed.collect()) == +wanted


def test_mix_of_many_sources_and_nothing(docs, none, monkeypatch):
    whole = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "join_skewed", lambda rows, table, keys, how="inner": skew.join_skewed(rows, table, keys, how, broadcast_rows=0, hot_rows=2))
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_sources(docs).collect()) == whole
    assert mixing.mixed_documents(none).count() == 0


# --- 2


def test_base_spans_match_the_patterns():
    texts = ["", "a@b.c, x.y@z-1.co.uk@q.r", "1.2.3.4.5.6.7.8 999.1.1.1", "+1 (269) 555-3296 4524132264652876 and", "4111 1111-1111 1111", "+12 +49 30 1234567", "@@a@b.c..d", "é +1-269-555-3296é@x.y"]
    r = random.Random(3)
    texts += ["".join(r.choice("0123456789 .-+()@ab") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert pii._listed(pii.base_spans(t)[0]) == pii.brute_force_base(t), t


def test_field_separates_neighbours_and_learns():
    weights = pii.train(pii.training_sentences())
    text = "call +1 (269) 555-3296 4524132264652876 and"
    base, runs = pii.base_spans(text)
    assert base == [] and [(text[s:e], pii.KINDS[k]) for s, k, e in pii.added_spans(text, base, runs, weights)] == [("+1 (269) 555-3296", "phone"), ("4524132264652876", "card")]
    right = wrong = 0
    for sentence, gold in pii.training_sentences(150, seed=77):
        found = pii.all_candidates(sentence, [m.span() for m in pii._RUN.finditer(sentence)])
        got = set(pii.decode(weights, pii.lattice(sentence, found))) if found else set()
        right, wrong = right + len(got & set(gold)), wrong + len(got ^ set(gold))
    assert right > 20 * wrong


def test_marginals_match_enumeration():
    lat = pii.Segments([0, 1, 2, 3], [(0, 1, "card", ["a"]), (0, 2, "phone", ["b"]), (1, 3, "card", []), (2, 3, "ip", [])])
    weights = {"card": 0.3, "phone": -0.2, "ip": 0.7, "card|a": 0.5}
    scores = [0.8, -0.2, 0.3, 0.7]
    sets = [s for k in range(16) if all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(lat.arcs) for j, b in enumerate(lat.arcs) if i < j and (s := [x for x in range(4) if k >> x & 1]) and i in s and j in s) for s in [[x for x in range(4) if k >> x & 1]]]
    total = sum(np.exp(sum(scores[x] for x in s)) for s in sets)
    for x, p in enumerate(pii._marginals(weights, lat)):
        assert p == pytest.approx(sum(np.exp(sum(scores[y] for y in s)) for s in sets if x in s) / total)


def test_personal_data_rows(docs, rows, none):
    got = pii.find_personal_data(docs.withColumn("spans", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r["base"] == "" for r in got)
    assert pii.find_personal_data(none).count() == 0


def test_personal_data_by_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", "a@b.c " * 3000, "x" * 200_000 + " 10.0.0.1"] + ["mail a.b@c.de call +49 (30) 123-4567 pay 4111 1111 1111 1111 from 10.1.2.3"] * 3
    texts += [" ".join(r.choice(("a@b.c", "1.2.3.4", "4111111111111111", "+1 269 555 3296", "v1.2.3", "call", "card", "12-34")) for _ in range(30)) for _ in range(40)]
    got = pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(texts)
    for x in got:
        text = texts[x["doc_id"]] or ""
        base = pii.brute_force_base(text)
        kinds = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert x["base"] == base and [x[f"n_{k}"] for k in pii.KINDS] == [kinds[k] for k in pii.KINDS]
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in x["spans"].split(",") if s)]
        assert set(base.split(",")) <= set(x["spans"].split(",")) and spans == sorted(spans, key=lambda t: t[0]) and all(0 <= a < b <= len(text) for a, b in spans)


# --- 3


def test_toxicity_learns_held_out(spark, none):
    r = random.Random(1)
    bad = ["idiot", "moron", "scum"]
    data = []
    for k in range(400):
        words, toxic = prose(40, 1000 + k).split(), k % 4 == 0
        if toxic:
            words.insert(r.randrange(40), r.choice(bad))
        data.append((k, " ".join(words), int(toxic)))
    docs, labels = spark.createDataFrame([d[:2] for d in data] + [(900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame([(d[0], d[2]) for d in data] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity_model(docs, labels, ~toxicity.held_out())
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, model).collect()}
    held = [d for d in data if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert np.mean([got[d[0]]["predicted"] == d[2] for d in held]) > 0.95
    assert 0 <= got[900]["score"] == got[901]["score"] <= 1
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity_model(docs, labels.limit(0), F.lit(True))).count() == 402
    assert toxicity.score_toxicity(none, model).count() == 0
    # The model by hand, on whole and very long texts, twice the same row, ties.
    more = spark.createDataFrame([(1, "x " * 100_000 + "idiot"), (1, "x " * 100_000 + "idiot"), (2, "moron a b"), (3, "moron a b")], "doc_id long, text string")
    scored = toxicity.score_toxicity(more.withColumn("score", F.lit("clash")), model).collect()
    for x in scored:
        grams = {int(b) for b in toxicity.ngram_buckets(x["text"])}
        z = model.bias + sum(model.weights[model.place[b]] for b in {b for b in grams if model.place[b] >= 0})
        assert x["score"] == pytest.approx(1 / (1 + np.exp(-z)))
    assert scored[0]["score"] == scored[1]["score"] and scored[2]["score"] == scored[3]["score"]


def test_toxicity_training_is_bounded_and_by_hand(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k} scum" if k % 3 == 0 else f"text {k}") for k in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    old = toxicity._class_counts
    try:
        toxicity._class_counts = lambda rows: (seen.append(rows.count()), old(rows))[1]
        toxicity.fit_toxicity_model(docs, labels, F.lit(True), training_rows=30)
        toxicity.fit_toxicity_model(docs, labels, F.lit(True))
    finally:
        toxicity._class_counts = old
    assert seen == [30, 60]
    pos, neg = np.array([9, 1, 0, 5]), np.array([1, 9, 3, 5])
    chosen, ratios = toxicity.choose_features(pos, neg, 10, 10, 2)
    assert chosen.tolist() == [0, 1] and ratios[0] == pytest.approx(np.log((10 / 12) / (2 / 12)))


# --- 4


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 40, 1000])
def test_jump_hash_is_the_published_one(spark, shards):
    r = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(r.randrange(-(2**63), 2**63) for _ in range(300))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), shards).alias("s")).select("k", "s.*").collect()
    for x in got:
        assert (x["shard"], x["grown_shard"]) == (jump(x["k"] % 2**64, shards), jump(x["k"] % 2**64, shards + 1))


def test_full_walk_agrees_with_the_short_one(spark):
    keys = spark.range(2000)
    short = keys.select("id", sharding._walk(F.col("id"), 40, 1).alias("w")).filter("w.j < 40").count()
    assert short > 0
    row = keys.select(F.sum((sharding._walk(F.col("id"), 40, 40)["b"].cast("int") != sharding.jump_shards(F.col("id"), 40)["shard"]).cast("int"))).first()
    assert row[0] == 0


def test_shards_hold_rows_and_slots(docs, rows, none):
    got = sharding.shard_documents(docs.withColumn("shard", F.lit("x")), 5).collect()
    assert len(got) == len(rows)
    slots, moved = defaultdict(list), 0
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {(d, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t, _, _ in rows}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == texts
    assert sharding.shard_documents(none, 40).count() == 0


# --- 5


def test_quality_statistics_by_brute_force(docs, rows, none):
    more = docs.sparkSession.createDataFrame([(200, "a b c d a b c\n x \n x \n\n x ", None, None), (201, "#$ %&|<>* é " * 3, "en", None)], SCHEMA)
    got = quality.quality_rules(docs.unionByName(more)).collect()
    wanted = Counter()
    for d, text, *_ in [*rows, *[(r["doc_id"], r["text"]) for r in more.collect()]]:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        many = {g for g, n in Counter(grams).items() if n > 1}
        repeat = len({k + j for k, g in enumerate(grams) if g in many for j in range(3)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wanted[d, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == wanted
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.quality_rules(none).count() == 0


def test_divergent_text_is_rejected(spark):
    good = [(k, " ".join(["the", "of", "and"] * 5) + " " + prose(80, k), "en", "a") for k in range(40)]
    odd = (99, " ".join(f"{w.upper()}#$%{k}" for k, w in enumerate(prose(80, 5).split())), "en", "a")
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame([*good, odd], SCHEMA)).collect()}
    assert not got[99]["kept"] and got[99]["class_distance"] > quality.MAX_CLASS_DISTANCE and all(got[k]["kept"] for k in range(40))


COMMON = {"en": "the of and to in a is that for it", "fr": "de la le et les des en un du une", "xx": "ko mu ta re si vo na pe du li"}


def test_text_without_common_words_is_rejected_in_every_language(spark):
    r = random.Random(3)
    rare = [f"{a}{b}{c}" for a in WORDS[:30] for b in WORDS[30:60] for c in ("", "e")]
    langs = list(COMMON)
    clean = [(k, " ".join(r.choice(COMMON[langs[k % 3]].split()) if r.random() < 0.3 else r.choice(rare) for _ in range(200)), langs[k % 3], "a") for k in range(150)]
    bare = [(1000 + k, " ".join(r.choice(rare) for _ in range(200)), langs[k], "a") for k in range(3)]
    docs = spark.createDataFrame([*clean, *bare], SCHEMA)
    words = quality.common_words(docs, 10)
    for lang in langs:
        assert set(words[lang].tolist()) == set(K.word_hashes(pa.array([COMMON[lang]]))[0].tolist())
    got = {x["doc_id"]: x for x in quality.quality_rules(docs).collect()}
    assert all(got[k]["kept"] and got[k]["closest_lang"] == langs[k % 3] for k in range(150))
    for k in range(1000, 1003):
        assert not got[k]["kept"] and not got[k]["base_failed"] and got[k]["class_distance"] <= quality.MAX_CLASS_DISTANCE


def test_verdicts_by_brute_force(spark):
    r = random.Random(9)
    data = [(k, " ".join(r.choice(COMMON["en" if k % 2 else "fr"].split()) if r.random() < 0.3 else r.choice(WORDS) for _ in range(r.choice((20, 60, 90)))) + ("#" * (k % 7) * 20), "en" if k % 2 else "fr", "a") for k in range(60)]
    docs = spark.createDataFrame(data, SCHEMA)
    words = quality.common_words(docs)
    statistics = quality.document_statistics(docs, words)
    references = quality.language_references(statistics, words)
    table, hashes = quality._class_table(), {}
    for _, text, *_ in data:
        for w in text.split():
            hashes[w] = K.word_hashes(pa.array([w]))[0][0]

    def histograms(text, lang):
        classes = sum(table[b] for b in text.encode()) / sum(sum(table[b]) for b in text.encode())
        shares = np.array([sum(hashes[w] == h for w in text.split()) for h in words[lang]]) / len(text.split())
        return classes, np.append(shares, 1 - shares.sum())

    for lang in ("en", "fr"):
        mine = [histograms(t, lang) for _, t, own, _ in data if own == lang and len(t.split()) >= 50]
        assert references[lang][0] == pytest.approx(np.mean([m[0] for m in mine], axis=0)) and references[lang][1] == pytest.approx(np.mean([m[1] for m in mine], axis=0))
    for x in quality.judge(statistics, words, references).collect():
        text = data[x["doc_id"]][1]
        options = []
        for lang in ("en", "fr"):
            classes, shares = histograms(text, lang)
            c, w = quality.jensen_shannon(classes[None], references[lang][0])[0], quality.jensen_shannon(shares[None], references[lang][1])[0]
            options.append((c / quality.MAX_CLASS_DISTANCE + w / quality.word_limit(references[lang][1]), lang, c, w))
        _, lang, c, w = min(options)
        if len(text.split()) < 50:
            assert x["closest_lang"] is None and not x["diverges"]
        else:
            assert (x["closest_lang"], x["class_distance"], x["word_distance"]) == (lang, pytest.approx(c), pytest.approx(w))
            assert x["diverges"] == (c > quality.MAX_CLASS_DISTANCE or w > quality.word_limit(references[lang][1]))


def test_quality_of_many_languages(spark):
    rows = [(k, prose(80, k), f"l{k % 70:02d}", "a") for k in range(140)]
    got = quality.quality_rules(spark.createDataFrame([*rows, (500, prose(80, 1), None, None)], SCHEMA).withColumn("classes", F.lit("clash"))).collect()
    assert len(got) == 141 and len({r["closest_lang"] for r in got}) > 64


def test_jensen_shannon_bounds():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert quality.jensen_shannon(p, np.array([0.0, 1.0]))[0] == pytest.approx(1) and quality.jensen_shannon(p, np.array([0.5, 0.5]))[1] == 0


# --- 6


def brute_join(rows, words, percent):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least[find(i)], links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"long_column": 2, "block_nodes": 2}, {"long_column": 4, "broadcast_rows": 0, "frequent": 3}, {"percent": 60, "words": 2, "long_column": 3, "block_nodes": 3}])
def test_join_by_brute_force(docs, rows, options):
    got = ngram_jaccard_join(docs.withColumn("node", F.lit("clash")), **options).collect()
    assert Counter(map(tuple, got)) == brute_join(rows, options.get("words", 4), options.get("percent", 85))


def test_join_of_chains_and_nothing(spark, none):
    words = prose(400, 9).split()
    chain = [(k, " ".join(words[3 * k : 3 * k + 150]), None, None) for k in range(40)]
    got = ngram_jaccard_join(spark.createDataFrame(chain, SCHEMA), long_column=5, block_nodes=4).collect()
    assert Counter(map(tuple, got)) == brute_join(chain, 4, 85) and {r["component_id"] for r in got} == {0}
    assert ngram_jaccard_join(none).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(51)) and got[100] == got[101] == got[102] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    hub = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(k, 1000 + k) for k in range(1, 300)], "a long, b long")
    split = connected_components(hub, broadcast_rows=0)
    assert {r["root"] for r in split.collect()} == {0} and split.count() == 599


# --- 7


def brute_lines(rows, min_chars, min_docs):
    where = defaultdict(list)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for d, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            where[k].append(d)
    last = {k: max(d) for k, d in where.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = Counter()
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), d) == d]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("keys", [200_000, 0])
def test_lines_by_brute_force(spark, rows, none, keys):
    long = "  This line is a good deal longer than forty characters, is it not? \r"
    rows = [r for r in rows if r[0] is not None] + [(300 + k, f"own {k}\n{long}\nshort\n{long.upper()}", None, None) for k in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = line_dedup.drop_repeated_lines(docs, broadcast_keys=keys).collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute_lines(rows, 40, 5)
    assert line_dedup.drop_repeated_lines(none, broadcast_keys=keys).count() == 0


def test_full_filters_change_nothing(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    # Filters of 8 bits, and more suspects than may be broadcast.
    small = line_dedup.drop_repeated_lines(docs, min_chars=1, min_docs=2, max_bits=8, broadcast_suspects=0).collect()
    assert Counter(map(tuple, small)) == Counter(map(tuple, line_dedup.drop_repeated_lines(docs, min_chars=1, min_docs=2).collect()))


def test_suspects_hold_every_repeat():
    r = np.random.default_rng(4)
    h = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    parts = [h[:8000], h[7000:15_000], np.concatenate([h[15_000:], h[19_990:]])]
    repeated = set(h[7000:8000].tolist()) | set(h[19_990:].tolist())
    found = set(line_dedup.suspected(parts, 12 * 20_000).tolist())
    assert repeated <= found and len(found) < len(repeated) + 1000
    assert set(h.tolist()) >= set(line_dedup.suspected(parts, 64).tolist()) >= repeated


# --- 8


def test_exact_dedup_by_brute_force(docs, rows, none):
    got = exact_dedup(docs.withColumn("kept", F.lit("clash")).withColumn("extra", F.lit(1)))
    assert got.columns == ["doc_id", "text", "lang", "source", "extra", "keep_id", "group_size", "kept"]
    got = got.collect()
    groups = defaultdict(list)
    same = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, text, *_ in rows:
        groups[same(text)].append(d)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter((d, min(groups[same(t)]), len(groups[same(t)])) for d, t, *_ in rows)
    kept = Counter(same(r["text"]) for r in got if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup(none).count() == 0
    joined = exact_dedup(docs, prefix_chars=1, broadcast_rows=0).groupBy("kept").count().collect()
    assert {r["kept"]: r["count"] for r in joined} == dict(Counter(r["kept"] for r in got))
    for options in ({"hot_rows": 2, "broadcast_rows": 0}, {"hot_rows": 3, "broadcast_rows": 1}):
        split = exact_dedup(docs, **options).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in split) == Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got)
        assert Counter(r["kept"] for r in split) == Counter(r["kept"] for r in got)


def test_stages_hash_only_what_is_left(spark):
    texts = ["a" * k for k in range(1, 6)] + ["bcd", "xyz12", "xyz34", "same text", "same  text", "samf text"]
    stages = {}
    got = exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), prefix_chars=3, stages=stages).collect()
    # Lengths 3, 5 and 9 recur; at them the prefixes xyz and sam do.
    assert stages == {"rows": 11, "prefix": 8, "full": 5}
    assert {r["doc_id"]: r["keep_id"] for r in got if not r["kept"]} == {9: 8}


def test_columns_with_internal_names_survive(docs):
    names = ["_len", "_prefix", "_full", "_row", "_size", "length", "prefix", "full", "number", "row", "id", "first", "rows", "size", "a.b"]
    more = docs.select("*", *(F.lit(n).alias(n) for n in names))
    got = exact_dedup(more, hot_rows=2, broadcast_rows=0)
    assert got.columns == [*more.columns, "keep_id", "group_size", "kept"]
    assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(names)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_join_is_the_join(spark, how):
    rows = spark.createDataFrame([(k % 7 if k > 40 else 1, k) for k in range(80)] + [(None, 99), (55, 98)], "key long, v long")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "key long, name string")
    wanted = Counter(map(tuple, rows.join(table, "key", how).collect()))
    for broadcast_rows, hot_rows in ((100, 1), (0, 5), (3, 5), (0, 10_000)):
        assert Counter(map(tuple, skew.join_skewed(rows, table, "key", how, broadcast_rows, hot_rows).collect())) == wanted


def test_scratch_is_deleted_on_request(spark, docs):
    with scratch.recording() as paths:
        kept = exact_dedup(docs).filter("kept").count()
    assert kept and paths
    folder = scratch.shared_dir(spark).removeprefix("file://")
    names = {p.rsplit("/", 1)[1] for p in paths}
    assert names & set(os.listdir(folder))
    scratch.release(spark, paths)
    assert not names & set(os.listdir(folder))


# --- 9


def test_bounds_and_best_fit():
    r = np.random.default_rng(1)
    for _ in range(30):
        sizes = r.integers(1, 101, r.integers(1, 80))
        bins, offsets, rooms = packing.best_fit_decreasing(sizes, 100)
        assert packing.dff_bound(sizes, 100) <= len(rooms) and (np.bincount(bins, sizes) + rooms == 100).all()
        for b in range(len(rooms)):
            mine = np.argsort(offsets[bins == b])
            assert (np.cumsum(sizes[bins == b][mine]) - sizes[bins == b][mine] == offsets[bins == b][mine]).all()
    assert packing.dff_bound(np.array([51] * 7), 100) == 7 and packing.dff_bound(np.zeros(0, dtype=int), 100) == 0
    assert packing.dff_bound(np.array([34] * 9), 100) == 5


@pytest.mark.parametrize("per_partition", [20_000, 7])
def test_packing_round_trip(docs, rows, none, per_partition):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*rows, (400, "hello <|endoftext|> world " * 20, None, None)]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(rows[-1:], SCHEMA)).withColumn("uid", F.lit("clash")).withColumn("gap", F.lit("clash"))
    wanted = Counter()
    for d, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            wanted[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    got = packing.pack_documents(docs, capacity=64, per_partition=per_partition).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert {(r["sequences"], r["gap"]) for r in got} == {(len(bins), len(bins) - got[0]["bound"])} and got[0]["bound"] * 64 >= sum(r["length"] for r in got)
    assert packing.pack_documents(none).count() == 0


def test_exchange_goes_on_until_certified(spark):
    rows = spark.createDataFrame([(k, "a " * (200 + 7 * (k % 41))) for k in range(400)], "doc_id long, text string")
    first = packing.pack_documents(rows, per_partition=400).first()
    dealt = packing.pack_documents(rows, per_partition=50).first()
    # A certified partition keeps its bins: what is lost is under a bin for each of eight partitions.
    assert first["bound"] == dealt["bound"] and dealt["sequences"] <= first["sequences"] + 8


def test_packing_encodes_added_tokens_and_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one<|endoftext|>two", "<|endoftext|>", " <|endoftext|> \n<|endoftext|>é 1", "<|endoftext |>", " " * 1_000_000 + "x", "y" + "\n" * 1_000_000]
    wanted = {k: [*tokenizer.encode(text, add_special_tokens=False).ids, 2] for k, text in enumerate(texts)}
    assert wanted[0] == [505, 50256, 11545, 2] and len(wanted[4]) > 1_000_000
    got = packing.tokenized_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1 << 21, 2).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {k: (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for k, ids in wanted.items()}


# --- 10


def test_language_held_out(spark, none):
    syllables = {"en": ["the", "ing", "tion", "and"], "fr": ["eau", "eux", "ment", "que"], "de": ["sch", "ung", "keit", "ver"]}
    r = random.Random(4)
    data = [(k, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(60)), lang, None) for k in range(150) for lang in [("en", "fr", "de")[k % 3]]]
    docs = spark.createDataFrame([*data, (900, None, "en", None), (901, "12 34 !?", "en", None), (902, "", None, None)], SCHEMA)
    model = language.fit_language_model(docs, ~language.held_out())
    got = {x["doc_id"]: x for x in language.identify_language(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang, _ in data)
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and all(got[k]["rejected"] for k in (900, 901, 902))
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language.identify_language(none, model).count() == 0
    assert {x["lang_pred"] for x in language.identify_language(docs, language.fit_language_model(none, F.lit(True))).collect()} == {"und"}


def sample(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    letters = random.Random(lang).sample("abcdefghijklmnopqrstuvwxyzàéîõüçñßøåæ", 9)
    parts = [random.Random(f"{lang}{k}").choice(letters) + random.Random(f"{lang}-{k}").choice(letters) for k in range(14)]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_every_language_is_learned(spark):
    langs = [f"l{k:02d}" for k in range(70)]
    data = [(k, sample(langs[k % 70], 60, k), langs[k % 70], None) for k in range(280)]
    model = language.fit_language_model(spark.createDataFrame(data, SCHEMA), F.lit(True))
    assert len(model.contents) == 70
    right = sum(model.predict(sample(lang, 60, 999))[0] == lang for lang in langs)
    assert right >= 66


def test_a_long_text_is_learned_whole(spark):
    rows = [(1, sample("aa", 3000, 1), "aa", None), (2, sample("cc", 2000, 1) + "\n" + sample("bb", 9000, 2), "bb", None), (3, sample("cc", 3000, 3), "cc", None)]
    assert len(rows[1][1].split("\n")[0]) > 8192
    model = language.fit_language_model(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert model.predict(sample("bb", 80, 9))[0] == "bb" and model.predict(sample("cc", 80, 9))[0] == "cc"
    assert model.predict(sample("cc", 2000, 5) + sample("bb", 9000, 5))[0] == "bb"


def test_sample_is_bounded_with_repeated_ids(spark):
    rows = [(1, f"{k} " + sample("aa", 40, k), "aa", None) for k in range(300)] * 2 + [(2, sample("bb", 40, 1), "bb", None)] * 50
    seen = []
    old = language.build_model
    try:
        language.build_model = lambda rows, margin: (seen.append(Counter(lang for lang, _ in rows)), old(rows, margin))[1]
        language.fit_language_model(spark.createDataFrame(rows, SCHEMA), F.lit(True), sample_rows=20)
        language.fit_language_model(spark.createDataFrame(rows, SCHEMA), F.lit(True), sample_bytes=1000)
    finally:
        language.build_model = old
    assert seen[0] == {"aa": 20, "bb": 1} and 1 <= seen[1]["aa"] < 10


def test_what_a_letter_is_and_predictions_by_hand(spark):
    assert [language.has_letter(t) for t in ("½ ²", "12_3", "Ⅳ", "é", "1ª", "中")] == [False, False, False, True, True, True]
    model = language.build_model([("aa", sample("aa", 400, 1)), ("bb", sample("bb", 400, 1))])
    texts = ["½ ²", sample("aa", 5, 3), sample("bb", 30_000, 3), None, "", "same text", "same text"]
    got = {r["doc_id"]: r for r in language.identify_language(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    made = language._compressors(model.contents)
    for k, text in enumerate(texts):
        if not text or k == 0:
            assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
        else:
            data = text.lower().encode()
            sizes = sorted((sum(len(c.compress(data[i : i + language.BLOCK_BYTES])) for i in range(0, len(data), language.BLOCK_BYTES)), name) for name, c in made.items())
            assert got[k]["lang_pred"] == sizes[0][1] and got[k]["margin"] == pytest.approx((sizes[1][0] - sizes[0][0]) / sizes[1][0])
    assert got[5][1:] == got[6][1:]
