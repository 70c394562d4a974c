"""The pipeline stages: columns, decisions, and what each keeps."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from test_operators import brute_join

import corpus_pipeline
from passagemill.llm import language, mixing
from passagemill.llm.queries import ORACLE_SQL, QUERIES

SYLLABLES = {"en": ["the", "ing", "tion", "and"], "fr": ["eau", "eux", "ment", "que"]}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(k, text("en" if k % 3 else "fr", 80, k), "en" if k % 3 else "fr", f"s{k % 4}", 0) for k in range(60)]
    rows += [(100 + k, rows[5][1], "en", "s1", 0) for k in range(5)]
    rows += [(200, rows[7][1] + " end", "en", "s3", 0), (300, None, "en", None, 0), (301, "1 2 3", None, "s1", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        ids.append({r[0] for r in docs.select("doc_id").collect()})
    assert ids[0] == {*range(60), *range(100, 105), 200}
    assert ids[1] == {*range(60), 200}
    assert ids[2] == set(range(60))
    assert ids[3] <= ids[2] and ids[4] == ids[3]
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_stages_on_awkward_tables(spark, folder, tmp_path):
    """Clashing names, repeated rows and a very long text; then no rows at all."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = docs.limit(1).withColumn("doc_id", F.lit(500).cast("long")).withColumn("text", F.lit(text("en", 40_000, 3)))
    more = docs.unionByName(docs.filter("doc_id < 5")).unionByName(long)
    names = ["_key", "key", "row", "kept", "score", "rejected", "lang_pred", "keep_id", "position", "length"]
    rows, nothing = more.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names)), docs.limit(0)
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        columns = rows.columns
        function(spark, rows, folder).write.parquet(f"{tmp_path}/rows{k}")
        function(spark, nothing, folder).write.parquet(f"{tmp_path}/nothing{k}")
        rows, nothing = spark.read.parquet(f"{tmp_path}/rows{k}"), spark.read.parquet(f"{tmp_path}/nothing{k}")
        assert nothing.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == columns
            for r in rows.collect():
                assert all(r[n] == f"{n}{r['doc_id']}" for n in names)
            ids = {r["doc_id"] for r in rows.select("doc_id").collect()}
            assert 500 in ids or k == 3
    assert ids <= {*range(60), 500}


def test_run_by_brute_force(spark, folder):
    """The whole pipeline on plain Python rows, stage by stage, against run()."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    learned = language.fit_language_model(docs, ~language.held_out())
    named = [r for r in rows if (found := learned.predict(r[1]))[0] != "und" and found[2] >= learned.min_margin]
    same = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    single = [r for r in named if r[0] == min(x[0] for x in named if same(x[1]) == same(r[1]))]
    parts = {(d, n, least) for d, n, least, _ in brute_join(single, 5, 80)}
    apart = [r for r in single if any(d == r[0] == least for d, _, least in parts)]
    # The plan decides how often a document is taken; its own test compares it with the integral.
    plan = mixing.mix_sources(spark.createDataFrame(apart, docs.schema)).collect()
    taken = Counter({r["doc_id"]: sum(2 * p["words"] >= r["size"] for p in r["passes"]) for r in plan})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for r in apart:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            wanted[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += taken[r[0]]
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +wanted
    used = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) == got[0]["sequences"] >= got[0]["bound"] >= -(-sum(used.values()) // 1024)


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
