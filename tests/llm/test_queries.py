import os

import brute
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from larkspur.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols and got == sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())


def test_registered():
    numbers = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert numbers == {f"op{k}" for k in range(1, 11)} and entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_brute_force_queries(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    run = lambda n: sorted((tuple(r) for r in entry.queries()[n](spark, sf).collect()), key=repr)
    assert run("op9_minhash") == brute.near_duplicates(docs)
    assert run("op5_suffix_array") == brute.repeats(docs, 400)
    assert {r[0]: list(r[3]) for r in run("op7_line_dedup")} == brute.line_removals(docs)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert os.path.isdir(sf)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "line_dedup":
            gone = brute.line_removals(list(before.items()))
            for i, t in after.items():
                assert t == "\n".join(x for k, x in enumerate(before[i].split("\n")) if k not in gone[i])
        elif name == "minhash_near_dedup":
            assert set(after) == {i for i, _, _, k in brute.near_duplicates(list(before.items())) if k}
        elif name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(before) - set(after) == {d for d, _ in brute.contaminated(list(before.items()), items)}
        before = after
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == set(before)


def test_lm_score_counts_trigrams(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_words, round(r.score, 5)) for r in entry.queries()["op3_lm_score"](spark, sf).collect()), key=repr)
    assert got == sorted(((i, n, round(s, 5)) for i, n, s in brute.backoff(docs, 3)), key=repr)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and ids, very long and empty texts, names that the operators use; and no rows at all."""
    text = " ".join(f"word{k:04d} and{k % 7:05d}" for k in range(60))
    rows = [
        (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text.replace("word0003 ", "another0 "), None, None, None), (3, None, "en", "s", 1), (4, "", "en", "s", 0),
        (None, " ".join(f"lone{k:04d}" for k in range(80)), "en", "s", 5), (5, " ".join(f"w{k:07d}" for k in range(200_000)), "en", "s", 5), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _d int, _lines int, _gone int, _hit int, node int")
    spark.createDataFrame([(1, " ".join(f"lone{k:04d}" for k in range(10, 50))), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 1, 5]  # 2 is a near copy of 1, the one without an id holds an item
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_small_volumes_have_a_dictionary():
    from larkspur.llm import warc

    for n in (1, 3, 7, 8, 60):
        records = [warc._record(k, b"http://x.test/", b"<html>page %d</html>" % k * 9, "00" * 20, None) for k in range(n)]
        assert warc.dictionary(records) and list(warc.read_volume(warc.build_volume(records))) == records
    assert list(warc.read_volume(warc.build_volume([]))) == []


def test_token_queries(spark, sf):
    """op1 and op6 over their whole tables, against the tiktoken library."""
    import hashlib

    import numpy as np
    import public_tokenizers
    import tiktoken

    from larkspur.llm import bpe

    ranks = {b: k for k, b in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    ids = {i: own.encode_ordinary(t or "") for i, t in docs}
    want = sorted((i, len(ids[i]), hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs)
    assert sorted(tuple(r)[:4] for r in entry.queries()["op1_bpe"](spark, sf).collect()) == want
    counted = entry.queries()["op6_token_counts"](spark, sf).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in counted if r[1]} == {i: len(x) for i, x in ids.items() if x}
