"""Command line: ``python -m larkspur.plans.cli COMMAND ...`` over Parquet tables."""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.config import Settings
from larkspur.functions import text as tx
from larkspur.operators import chunking, evaluation, filters, headings, lifecycle
from larkspur.plans import evaluate as ev
from larkspur.plans import index as ix
from larkspur.plans.answer import Answerer, HashingEmbedder, language_model
from larkspur.session import session
from larkspur.sources.client import ArchiveClient
from larkspur.sources.store import IndexStore, export_csv, load_questions, objects, put_bytes, ticker_list


def ingest(spark: SparkSession, client: ArchiveClient, tickers: list[str], base_url: str, directory_url: str, submissions_url: str, raw: str, manifest: str, forms=("10-K", "10-Q"), since: str | None = None, limit: int | None = None) -> DataFrame:
    """Fetch the filings of the tickers into ``raw``; the manifest is added to after each, so that a run that was cut off goes
    on. Gives the number of filings by outcome. ``submissions_url`` has ``{cik}``."""
    directory = lifecycle.ticker_directory(spark.createDataFrame([(client.get(directory_url).decode(),)], "value string")).persist()
    seen = {r[0] for r in ix_manifest(spark, manifest).select("accession_number").collect()}
    outcomes = []
    for ticker in tickers:
        try:
            cik, name = lifecycle.resolve_ticker(directory, ticker)
        except KeyError:
            outcomes.append((ticker, "unknown ticker"))
            continue
        payload = client.get(submissions_url.format(cik=cik)).decode()
        listed = lifecycle.filing_listing(spark.createDataFrame([(ticker.upper(), cik, name, payload)], "ticker string, cik string, company_name string, payload string"), base_url, forms, since, limit)
        for f in listed.orderBy("pos").collect():
            if f["accession_number"] in seen:
                outcomes.append((ticker, "had"))
                continue
            key = f"{f['cik']}/{f['accession_number']}/{f['form_type']}.html"
            try:
                put_bytes(spark, raw, key, client.get(f["source_url"]))
            except (OSError, ConnectionError):
                outcomes.append((ticker, "failed"))
                continue
            row = spark.createDataFrame([f], listed.schema).select("cik", "ticker", "company_name", "form_type", "accession_number", "filing_date", F.col("fiscal_year").cast("int"), F.col("fiscal_period").cast("string"), "source_url", F.lit(key).alias("storage_key"))
            row.coalesce(1).write.mode("append").parquet(manifest)
            seen.add(f["accession_number"])
            outcomes.append((ticker, "fetched"))
    return lifecycle.ingest_report(spark.createDataFrame(outcomes, "ticker string, status string"))


def ix_manifest(spark: SparkSession, path: str) -> DataFrame:
    from larkspur.sources.store import load_manifest

    return load_manifest(spark, path)


def parse(spark: SparkSession, raw: str, item: str | None = None) -> DataFrame:
    """Sections of every HTML object below ``raw``."""
    pages = objects(spark, raw).select(F.col("key").alias("filing_id"), tx.html_text(F.decode("content", "UTF-8")).alias("text"))
    out = headings.sections(pages)
    return out.filter(F.upper("item") == item.upper()) if item else out


def chunk(spark: SparkSession, filings: str, sections: str, item: str | None = None, ticker: str | None = None) -> DataFrame:
    chosen = filters.select_filings(spark.read.parquet(filings), [ticker] if ticker else None)
    parts = spark.read.parquet(sections)
    return chunking.chunk_sections(chosen, parts.filter(F.upper("item") == item.upper()) if item else parts)


def index(spark: SparkSession, chunks: str, root: str, index_type: str = "flat", checkpoint: str | None = None) -> dict:
    """A new version of the index over a table of chunks."""
    return ix.build(spark, spark.read.parquet(chunks), root, index_type=index_type, checkpoint=checkpoint)


def batch(spark: SparkSession, manifest: str, chunks: str, root: str, n: int) -> dict | None:
    """Add the chunks of the next ``n`` filings that are not in the index; None if all are."""
    store = IndexStore(spark, root)
    todo = lifecycle.next_batch(lifecycle.pending(spark.read.parquet(manifest), store.indexed_filings()), "filing_id", n)
    mine = spark.read.parquet(chunks).join(F.broadcast(todo.select("filing_id")), "filing_id", "left_semi")  # n rows
    if mine.isEmpty():
        return None
    return ix.add(spark, mine, root) if store.manifest() else ix.build(spark, mine, root)


def reindex(spark: SparkSession, root: str) -> dict | str:
    return ix.reindex(spark, root) or "the index is flat and has no cells to train"


def search(spark: SparkSession, root: str, question: str, k: int = 5, mode: str = "hybrid", wanted: dict | None = None) -> DataFrame:
    """The best chunks, with where they come from."""
    return ix.Retriever(spark, root, HashingEmbedder())(question, k, mode, wanted)


def _answerer(spark: SparkSession, root: str, settings: Settings, cache: str | None) -> Answerer:
    model = language_model(settings, spark, cache)
    judge = language_model(Settings.from_mapping(settings.__dict__ | {"llm_model": settings.judge_model}), spark, cache)
    judge.budget = model.budget  # one ceiling for both
    return Answerer(spark, ix.Retriever(spark, root, HashingEmbedder(), settings.retrieval_candidate_k, settings.rrf_k), model, judge)


def ask(spark: SparkSession, root: str, question: str, k: int = 5, mode: str = "hybrid", wanted: dict | None = None, cache: str | None = None, settings: Settings = Settings()) -> dict:
    answerer = _answerer(spark, root, settings, cache)
    answerer.judge = None
    return answerer.ask(question, k, mode, wanted)


def evaluate(spark: SparkSession, questions: str, root: str, modes: tuple[str, ...] = ("hybrid",), k: int = 5, judge: bool = True, retrieval_only: bool = False, limit: int | None = None, out: str | None = None, settings: Settings = Settings()) -> list[ev.Report]:
    """Reports of all modes, written as CSV below ``out``."""
    table = load_questions(spark, questions)
    asked = ev.first_questions(table.collect(), limit)  # a hand-written set; the file's order is kept
    held = table.filter(F.col("id").isin([q["id"] for q in asked])) if limit else table
    relevant, _ = ev.resolve(held, IndexStore(spark, root).load()["chunks"])
    answerer = _answerer(spark, root, settings, None)
    reports = [ev.evaluate(spark, answerer, asked, relevant, m, k, judge, retrieval_only) for m in modes]
    if out:
        ev.export(reports, out)
    return reports


def validate(spark: SparkSession, questions: str, root: str) -> DataFrame:
    """Questions whose labels do not fit the index."""
    return ev.resolve(load_questions(spark, questions), IndexStore(spark, root).load()["chunks"])[1]


def status(spark: SparkSession, manifest: str, root: str, goal: int = 10_000) -> DataFrame:
    return lifecycle.corpus_status(spark.read.parquet(manifest), IndexStore(spark, root).indexed_filings(), goal)


def stats(spark: SparkSession, chunks: str) -> tuple[DataFrame, DataFrame]:
    """Token counts of chunks, and the sections with most of them."""
    table = spark.read.parquet(chunks)
    return evaluation.chunk_token_stats(table), evaluation.top_sections(table.select(F.col("metadata.item").alias("item")) if "metadata" in table.columns else table)


def filings(spark: SparkSession, manifest: str) -> DataFrame:
    return lifecycle.display_order(spark.read.parquet(manifest))


def serve(spark: SparkSession, root: str, audit: str, port: int = 8000, host: str = "127.0.0.1", settings: Settings = Settings()) -> None:
    """The service's calls over HTTP, until it is stopped."""
    from larkspur.plans.service import AuditLog, Service, http_server

    answerer = _answerer(spark, root, settings, None) if IndexStore(spark, root).manifest() else None
    http_server(Service(answerer, AuditLog(spark, audit)), host, port).serve_forever()


def _wanted(a: argparse.Namespace) -> dict | None:
    out = {"tickers": a.ticker, "fiscal_years": a.year, "items": a.item, "form_types": a.form, "ciks": a.cik, "parts": a.part}
    return {k: v for k, v in out.items() if v} or None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur", description=__doc__)
    p.add_argument("--out", help="write the result here as Parquet instead of showing it")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *places: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=(globals()[name].__doc__ or "").split("\n")[0])
        for place in places:
            c.add_argument(place)
        c.set_defaults(run=run)
        return c

    def asking(c: argparse.ArgumentParser) -> argparse.ArgumentParser:
        c.add_argument("--top-k", type=int, default=5)
        c.add_argument("--mode", choices=ev.MODES, default="hybrid")
        for name in ("ticker", "item", "form", "cik", "part"):
            c.add_argument(f"--{name}", action="append", help="may be repeated")
        c.add_argument("--year", type=int, action="append", help="may be repeated")
        return c

    c = command("ingest", _ingest, "base_url", "directory_url", "submissions_url", "raw", "manifest")
    c.add_argument("--tickers", nargs="+", default=[])
    c.add_argument("--ticker-file")
    c.add_argument("--user-agent", required=True)
    c.add_argument("--since")
    c.add_argument("--limit", type=int)
    c = command("parse", lambda s, a: parse(s, a.raw, a.item), "raw")
    c.add_argument("--item")
    c = command("chunk", lambda s, a: chunk(s, a.filings, a.sections, a.item, a.ticker), "filings", "sections")
    c.add_argument("--item")
    c.add_argument("--ticker")
    c = command("index", lambda s, a: index(s, a.chunks, a.root, a.index_type, a.checkpoint), "chunks", "root")
    c.add_argument("--index-type", choices=("flat", "ivf"), default="flat")
    c.add_argument("--checkpoint")
    c = command("batch", lambda s, a: batch(s, a.manifest, a.chunks, a.root, a.filings), "manifest", "chunks", "root")
    c.add_argument("--filings", type=int, default=100)
    command("reindex", lambda s, a: reindex(s, a.root), "root")
    asking(command("search", lambda s, a: search(s, a.root, a.question, a.top_k, a.mode, _wanted(a)), "root", "question"))
    c = asking(command("ask", lambda s, a: ask(s, a.root, a.question, a.top_k, a.mode, _wanted(a), a.cache), "root", "question"))
    c.add_argument("--cache")
    c = command("evaluate", _evaluate, "questions", "root")
    c.add_argument("--top-k", type=int, default=5)
    c.add_argument("--mode", choices=ev.MODES, default="hybrid")
    c.add_argument("--compare", action="store_true", help="all three modes")
    c.add_argument("--no-judge", action="store_true")
    c.add_argument("--retrieval-only", action="store_true")
    c.add_argument("--validate", action="store_true", help="look at the labels alone")
    c.add_argument("--limit", type=int, help="the first N questions")
    c.add_argument("--csv", help="write CSV below this folder")
    command("validate", lambda s, a: validate(s, a.questions, a.root), "questions", "root")
    c = command("status", lambda s, a: status(s, a.manifest, a.root, a.goal), "manifest", "root")
    c.add_argument("--goal", type=int, default=10_000)
    command("stats", lambda s, a: stats(s, a.chunks), "chunks")
    command("filings", lambda s, a: filings(s, a.manifest), "manifest")
    c = command("serve", lambda s, a: serve(s, a.root, a.audit, a.port, a.host), "root", "audit")
    c.add_argument("--port", type=int, default=8000)
    c.add_argument("--host", default="127.0.0.1")
    return p


def _ingest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    tickers = a.tickers + ([r[0] for r in ticker_list(spark, a.ticker_file).collect()] if a.ticker_file else [])
    return ingest(spark, ArchiveClient(a.user_agent), tickers, a.base_url, a.directory_url, a.submissions_url, a.raw, a.manifest, since=a.since, limit=a.limit)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.validate:
        return validate(spark, a.questions, a.root)
    modes = ev.MODES if a.compare else (a.mode,)
    reports = evaluate(spark, a.questions, a.root, modes, a.top_k, not a.no_judge, a.retrieval_only, a.limit, a.csv)
    return functools.reduce(DataFrame.unionByName, [r.summary for r in reports])


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    out = a.run(session(), a)
    for part in out if isinstance(out, tuple) else (out,):
        if not isinstance(part, DataFrame):
            print(part)
        elif a.out:
            part.write.parquet(a.out)
        else:
            part.show(50, truncate=100)


if __name__ == "__main__":
    main()
