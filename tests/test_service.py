import pytest

from larkspur.plans import answer as an
from larkspur.plans import cli, service
from larkspur.sources import store

BODY = "The company sold many products in the year and spent a great deal on research. " * 12


def test_service(spark, tmp_path):
    rows = spark.createDataFrame([(1, "t:1", "Name", "10-K", 2025, "7", "c1", "Sales were 500 million. More.")], "rank int, citation string, company_name string, form_type string, fiscal_year int, item string, chunk_id string, text string")
    audit = service.AuditLog(spark, f"file://{tmp_path}/log")
    filters_seen = []

    def retriever(q, k, m, wanted=None):
        filters_seen.append(wanted)
        return rows

    s = service.Service(an.Answerer(spark, retriever, an.Extractive("x")), audit)
    assert s.stats()["rate"] == 0.0 and not s.health()["logged"]
    one = s.ask("What were sales?", wanted={"tickers": ["X"]})
    s.ask("And now?")
    assert filters_seen == [{"tickers": ["X"]}, None] and "passages" not in one and s.ask("What?", passages=True)["passages"][0]["chunk_id"] == "c1"
    audit = s.audit = service.AuditLog(spark, f"file://{tmp_path}/log2")
    one = s.ask("What were sales?", wanted={"tickers": ["X"]})
    s.ask("And now?")
    assert one["query_id"] and s.stats() == {"total": 2, "grounded": 2, "ungrounded": 0, "rate": 1.0}
    assert len(s.recent(1)) == 1 and audit.citations().count() == 2 and audit.queries().filter("filters IS NOT NULL").count() == 1
    broken = service.Service(s.answerer, service.AuditLog(spark, "file:///proc/none"))
    assert broken.ask("What?")["query_id"] is None
    with pytest.raises(RuntimeError):
        service.Service(None, audit).ask("What?")


def test_commands(spark, tmp_path):
    root = f"file://{tmp_path}"
    html = f"<p>Item 1. Business</p><p>{BODY}</p><p>Item 1A. Risk Factors</p><p>{BODY.replace('sold', 'lost')} Mine safety matters.</p>"
    html += "".join(f"<p>Item {i}. Other Matters</p><p>{BODY.replace('products', w)}</p>" for i, w in (("2", "houses"), ("3", "claims")))
    store.put_bytes(spark, f"{root}/raw", "one.html", html.encode())
    sections = cli.parse(spark, f"{root}/raw")
    assert [r.item for r in sections.orderBy("order").collect()] == ["1", "1A", "2", "3"]
    sections.selectExpr("'1/acc' AS filing_id", "item", "title", "text", "`order`", "part").write.parquet(f"{root}/sections")
    f = spark.createDataFrame([("1", "AAA", "Name", "10-K", "acc", None, 2025, None, "u", "k")], "cik string, ticker string, company_name string, form_type string, accession_number string, filing_date date, fiscal_year int, fiscal_period string, source_url string, storage_key string")
    f.write.parquet(f"{root}/filings")
    cli.chunk(spark, f"{root}/filings", f"{root}/sections").write.parquet(f"{root}/chunks")
    assert cli.index(spark, f"{root}/chunks", f"{root}/index")["size"] >= 2
    hits = cli.search(spark, f"{root}/index", "mine safety", 3).collect()
    assert hits[0].item == "1A" and "s1" in hits[0].origin
    assert cli.search(spark, f"{root}/index", "mine safety", 3, "sparse", {"items": ["1"]}).count() == 0
    f.selectExpr("concat(cik, '/', accession_number) AS filing_id", "ticker").write.parquet(f"{root}/manifest")
    assert cli.status(spark, f"{root}/manifest", f"{root}/index").first().pending == 0
    (tmp_path / "q.jsonl").write_text('{"id": "a", "question": "?", "relevance": {"must_contain": ["MINE safety"]}}\n{"id": "b", "question": "?", "relevance": {"must_contain": ["zebra"]}}\n')
    assert [(r.question_id, r.problem) for r in cli.validate(spark, f"{root}/q.jsonl", f"{root}/index").collect()] == [("b", "no match")]

    typed = cli.parser().parse_args(["search", f"{root}/index", "mine safety", "--top-k", "3", "--item", "1A", "--year", "2025"])
    assert [r.item for r in typed.run(spark, typed).collect()] == ["1A"] and cli._wanted(typed) == {"items": ["1A"], "fiscal_years": [2025]}
    a = cli.ask(spark, f"{root}/index", "mine safety", 3, wanted={"items": ["1A"]})
    assert a["passages"] and {p["item"] for p in a["passages"]} == {"1A"} and a["is_grounded"]
    assert cli.batch(spark, f"{root}/manifest", f"{root}/chunks", f"{root}/index", 5) is None
    assert cli.batch(spark, f"{root}/manifest", f"{root}/chunks", f"{root}/index2", 5)["size"] >= 2
    assert cli.parse(spark, f"{root}/raw", "1a").count() == 1 and "cells" in cli.reindex(spark, f"{root}/index")
    assert cli.stats(spark, f"{root}/chunks")[1].first().chunks >= 1 and cli.filings(spark, f"{root}/filings").count() == 1
    (tmp_path / "e.jsonl").write_text(
        '{"id": "a", "question": "Where is mine safety?", "category": "risk", "relevance": {"must_contain": ["mine safety"]}}\n'
        '{"id": "b", "question": "Houses?", "category": "risk", "filters": {"items": ["2"]}, "relevance": {"must_contain": ["houses"]}}\n'
        '{"id": "c", "question": "Zebras?", "category": "none", "answerable": false}\n'
    )
    reports = cli.evaluate(spark, f"{root}/e.jsonl", f"{root}/index", ("sparse", "hybrid"), 3, limit=2, out=f"{root}/csv")
    assert [r.frame.count() for r in reports] == [2, 2] and reports[0].summary.first().hit == 1.0 and reports[1].by_category().count() == 1
    assert spark.read.option("header", "true").csv(f"{root}/csv/summary").count() == 2
    free = cli.evaluate(spark, f"{root}/e.jsonl", f"{root}/index", ("dense",), 3, retrieval_only=True)[0]
    assert free.summary.first().faithfulness is None and free.frame.count() == 3 and free.model is None


class Judge(an.LanguageModel):
    def call(self, prompt, system, max_tokens, temperature):
        self.asked = getattr(self, "asked", []) + [(prompt, max_tokens)]
        return an.Reply(self.said, self.model, 10, 5)


def test_judge(spark):
    rows = spark.createDataFrame([(1, "t:1", "Name", "10-K", 2025, "7", "c1", "Sales were 500 million. More.")], "rank int, citation string, company_name string, form_type string, fiscal_year int, item string, chunk_id string, text string")
    judge = Judge("j")
    a = an.Answerer(spark, lambda q, k, m: rows, an.Extractive("x"), judge)
    for said, judged, faithful in (("UNSUPPORTED. No.", False, False), ("Supported: yes", True, True), ("hm", None, True)):
        judge.said = said
        got = a.ask("What were sales?")
        assert (got["judged"], got["faithful"], got["judge_reason"]) == (judged, faithful, said)
    assert "Name 10-K FY2025" in judge.asked[0][0] and judge.asked[0][1] == an.JUDGE_TOKENS
    empty = an.Answerer(spark, lambda q, k, m: rows.limit(0), an.Extractive("x"), judge)
    assert empty.ask("What?")["faithful"] and len(judge.asked) == 3  # declined: nothing to judge


def test_index_grows_like_one_built_whole(spark, tmp_path):
    from larkspur.operators import bm25
    from larkspur.plans import index as ix

    root = f"file://{tmp_path}"
    meta = lambda k: (f"c{k}", f"f{k % 3}", f"words number {k} about mine {'safety' if k % 2 else 'houses'} and {'x' * k}", 5, k, "1A", "AAA", 2025)
    chunks = lambda ks: spark.createDataFrame([meta(k) for k in ks], "chunk_id string, filing_id string, text string, token_count int, order int, item string, ticker string, fiscal_year int")
    ix.build(spark, chunks(range(5)), f"{root}/a")
    assert ix.add(spark, chunks(range(5, 9)), f"{root}/a")["size"] == 9
    ix.build(spark, chunks(range(9)), f"{root}/b", checkpoint=f"{root}/ck")
    stats = lambda r: sorted((x.term, x.df, round(x.idf, 9)) for x in ix.IndexStore(spark, r).load()["term_stats"].collect())
    assert stats(f"{root}/a") == stats(f"{root}/b") == sorted((x.term, x.df, round(x.idf, 9)) for x in bm25.term_stats(bm25.tokenised(chunks(range(9)))).collect())
    with pytest.raises(ValueError):
        ix.add(spark, chunks([3]), f"{root}/a")
    one, two = (ix.Retriever(spark, f"{root}/{n}", an.HashingEmbedder()) for n in "ab")
    assert not one.rebuilt and [r.chunk_id for r in one("mine safety", 3).collect()] == [r.chunk_id for r in two("mine safety", 3).collect()]
    stale = ix.IndexStore(spark, f"{root}/c")
    t = ix.IndexStore(spark, f"{root}/b").load()
    stale.save(64, "hashing-64", chunks=t["chunks"], vectors=t["vectors"], terms=t["terms"].limit(4), term_stats=t["term_stats"])
    three = ix.Retriever(spark, f"{root}/c", an.HashingEmbedder())
    assert three.rebuilt and [r.chunk_id for r in three("mine safety", 3, "sparse").collect()] == [r.chunk_id for r in two("mine safety", 3, "sparse").collect()]


def test_cells_are_kept(spark, tmp_path):
    import numpy as np

    from larkspur.operators import dense
    from larkspur.plans import index as ix

    class Random(an.HashingEmbedder):
        def documents(self, texts):
            v = np.array([np.random.default_rng(int(t.split()[-1])).normal(size=self.dimension) for t in texts], np.float32)
            return v / np.linalg.norm(v, axis=1, keepdims=True)

    root = f"file://{tmp_path}/i"
    chunks = spark.createDataFrame([(f"c{k}", "f", f"text {k}", "1") for k in range(1200)], "chunk_id string, filing_id string, text string, item string")
    meta = ix.build(spark, chunks, root, Random(), "ivf", nlist=16)
    assert meta["settings"]["nlist"] == 16 and ix.IndexStore(spark, root).load()["centres"].count() == 16
    r = ix.Retriever(spark, root, Random())
    assert r.cells.probe == meta["settings"]["probe"] and r("number 7", 1, "dense").first().chunk_id == "c7"
    assert ix.reindex(spark, root)["index_type"] == "ivf" and isinstance(dense.CellIndex.from_table(ix.IndexStore(spark, root).load()["centres"], meta["settings"]), dense.CellIndex)


def test_http(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    rows = spark.createDataFrame([(1, "t:1", "Name", "10-K", 2025, "7", "c1", "Sales were 500 million. More.")], "rank int, citation string, company_name string, form_type string, fiscal_year int, item string, chunk_id string, text string")
    s = service.Service(an.Answerer(spark, lambda q, k, m, wanted=None: rows, an.Extractive("x")), service.AuditLog(spark, f"file://{tmp_path}/log"))
    server = service.http_server(s, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    get = lambda path, body=None: json.load(urllib.request.urlopen(urllib.request.Request(base + path, body and json.dumps(body).encode())))
    assert get("/health")["status"] == "ok"
    assert get("/query", {"question": "What were sales?", "include_passages": True})["passages"] and "passages" not in get("/query", {"question": "What were sales?"})
    assert len(get("/queries?limit=1")) == 1 and get("/stats")["total"] == 2
    for path, body, status in (("/query", {"question": ""}, 422), ("/nope", None, 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path, body)
        assert e.value.code == status
    server.shutdown()


def test_ingest_command(spark, tmp_path):
    import json

    from larkspur.sources.client import ArchiveClient

    recent = {"form": ["10-K", "8-K"], "accessionNumber": ["0000000001-25-000001", "x"], "filingDate": ["2025-02-01", "2025-02-01"], "reportDate": ["2024-12-31", ""], "primaryDocument": ["a.htm", "b.htm"]}
    pages = {"dir": {"0": {"cik_str": 1, "ticker": "AAA", "title": "Name"}}, "sub/0000000001": {"fiscalYearEnd": "1231", "filings": {"recent": recent}}}

    def fetch(url, agent):
        return 200, json.dumps(pages[url]).encode() if url in pages else b"<p>filing</p>"

    c = ArchiveClient("me me@mail.test", fetch=fetch, rate=1e6)
    run = lambda: {r.status: r.n for r in cli.ingest(spark, c, ["AAA", "ZZZ"], "base", "dir", "sub/{cik}", f"file://{tmp_path}/raw", f"file://{tmp_path}/manifest").collect()}
    assert run() == {"fetched": 1, "unknown ticker": 1} and run() == {"had": 1, "unknown ticker": 1}
    assert store.list_keys(spark, f"file://{tmp_path}/raw").count() == 1
