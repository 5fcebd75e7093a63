import hashlib

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from larkspur.llm import bpe, components, decontam, linededup, lmscore, minhash, quality, suffix, tokencount, urlfilter, warc

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def encoder():
    ranks = {b: k for k, b in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, odd, none):
    own = encoder()
    for df in (docs, odd):
        want = []
        for i, t in pairs(df):
            ids = own.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert rows(bpe.bpe_round_trip(df, RANKS, PATTERN)) == sorted(want, key=repr)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in back.collect()} == dict(pairs(docs))
    assert bpe.bpe_round_trip(none, RANKS, PATTERN).count() == 0


def test_bpe_model_reaches_every_entry():
    c = bpe.BpeCodec(bpe.serialise_model(bpe.read_ranks(RANKS)), PATTERN)
    letters = {b: bpe.FIRST_LETTER + b for b in range(256)}
    assert all(c.sp.encode(e.decode("latin-1").translate(letters)) == [k] for k, e in enumerate(c.entries))


def make_pages(spark):
    big, other = "<p>é" + "x" * 1200 + "</p>", "y" * 999
    data = [(1, "http://a.test/", big), (5, "http://b.test/ x\r\ny", big), (3, None, big), (2, "u", other), (4, "u", other), (6, None, None), (None, "u", big), (7, "u", ""), (8, "u", "z" * 1000), (8, "v", "z" * 1000)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_warc(spark):
    pages = make_pages(spark)
    path = warc.write_warc(pages.repartition(2))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, path, False).collect()}
    want = set()
    for r in pages.collect():
        b = (r.html or "").encode()
        top = 5 if len(b) > 1000 and r.page_id is not None else None
        back = top is not None and r.page_id < top
        want.add((r.page_id, "revisit" if back else "response", 5 if back else None, len(b), hashlib.sha1(b).hexdigest()))
    assert got == want
    kept = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, path).filter("record_type = 'response'").collect()}
    assert kept[7] == b"" and len(kept[5]) > 1200
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0)), False).count() == 0


def test_warc_volume_is_a_zstandard_file():
    import zstandard

    records = [warc._record(i, b"http://x.test/", b"<html>page %d</html>" % i * 50, "00" * 20, None) for i in range(200)]
    volume = warc.build_volume(records) + warc.EMPTY_FRAME
    assert list(warc.read_volume(volume)) == records
    magic, size = int.from_bytes(volume[:4], "little"), int.from_bytes(volume[4:8], "little")
    kind = zstandard.ZstdCompressionDict(volume[8 : 8 + size])
    first = zstandard.ZstdDecompressor(dict_data=kind).decompressobj().decompress(volume[8 + size :])
    assert magic == warc.DICT_MAGIC and size > 0 and first == records[0]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(docs, odd, none, order):
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_words, round(r.score, 6)) for r in lmscore.lm_scores(df, order).collect()), key=repr)
        assert got == sorted(((i, n, round(s, 6)) for i, n, s in brute.backoff(pairs(df), order)), key=repr)
    assert lmscore.lm_scores(none, order).count() == 0


def test_lm_scores_over_many_chunks_and_parts(docs, monkeypatch):
    monkeypatch.setattr(lmscore, "PART_WORDS", 100)
    got = {r.doc_id: round(r.score, 6) for r in lmscore.lm_scores(docs, 2).collect()}
    assert got == {i: round(s, 6) for i, _, s in brute.backoff(pairs(docs), 2)}
    h = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    c = np.arange(len(h)) * 7
    assert all((x == y).all() for x, y in zip(lmscore.unpack(lmscore.pack(h, c)), (h, c)))


def make_benchmark(spark, texts):
    w = texts[0].split(" ")
    items = [(0, " ".join(w[5:45])), (1, " ".join(w[20:35])), (2, "never seen anywhere in any of these"), (3, "the archive"), (4, None), (5, " . "), (6, "same same same same same same same same"), (7, " ".join(w[5:45]))]
    return spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("in_plan", [20_000, 0])
def test_decontaminate(spark, docs, texts, odd, none, monkeypatch, in_plan):
    monkeypatch.setattr(decontam, "IN_PLAN", in_plan)
    bench, items = make_benchmark(spark, texts)
    got = {(r.doc_id, r.item_id): round(r.similarity * 1e6) for r in decontam.contaminated(docs, bench).collect()}
    assert got == brute.contaminated(pairs(docs), items) and got
    hit = {d for d, _ in got}
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == set(range(len(texts))) - hit
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(none, bench).count() == 0
    assert decontam.drop_contaminated(odd, bench).count() == odd.count()


def test_suffix_array(docs, odd, none, monkeypatch):
    for df in (docs, odd):
        assert rows(suffix.remove_repeats(df)) == brute.repeats(pairs(df), 400)
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_array_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 500)
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcd"), 3000))
    data = [(0, long), (1, long[700:1900]), (2, "Z" * 50 + long[1000:1399] + "Q"), (3, "ab" * 700), (4, long[:400])]
    one = spark.createDataFrame(data, "doc_id long, text string")
    python = suffix.sampled_suffixes  # pieces are cut in this process here
    assert python is not None
    cut = [suffix.anchors(t.encode()) for _, t in data if len(t) >= 400]
    assert all(int((x[5] - x[4] + 1).sum()) == len(t) - 399 for x, (_, t) in zip(cut, [d for d in data if len(d[1]) >= 400]))
    assert rows(suffix.remove_repeats(one, batches=3)) == brute.repeats(data, 400)


def test_levels_grow_geometrically(spark):
    index = suffix.SuffixLevels()
    for k in range(5):
        batch = spark.createDataFrame([(k, k, k), (9, 9, 9)], "h long, c1 long, c2 long")
        met = {(r.h, r.n) for r in index.add(batch).collect()}
        assert met == (set() if k == 0 else {(9, k + 1)})
    assert [rank for rank, _ in index.levels] == [2, 0]


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_counts(docs, odd, none, rule):
    own, entries = encoder(), bpe.read_ranks(RANKS)
    import re

    for df in (docs, odd):
        want = []
        for i, t in pairs(df):
            ends = np.cumsum([len(x) for x in re.findall(r"[^\n]*\n|[^\n]+", t or "")])
            char = [k for k, c in enumerate(t or "") for _ in c.encode()]
            tokens, crossing, at = [0] * len(ends), [0] * len(ends), 0
            for token in own.encode_ordinary(t or ""):
                first, stop = char[at], at + len(entries[token])
                begun = [c for k, c in enumerate(char[at:stop], at) if k == 0 or char[k - 1] != c]
                last, at = max([first, *begun]), stop
                a, b = (int(np.searchsorted(ends, c, "right")) for c in (first, last))
                held = [int(np.sum((np.arange(first, last + 1) < ends[s]) & (np.arange(first, last + 1) >= (ends[s - 1] if s else 0)))) for s in range(a, b + 1)]
                s = {"start": a, "end": b, "most": a + int(np.argmax(held))}[rule]
                tokens[s] += 1
                crossing[s] += a != b
            want += [(i, s, int(ends[s - 1]) if s else 0, int(e), tokens[s], crossing[s]) for s, e in enumerate(ends)]
        assert rows(tokencount.section_tokens(df, RANKS, PATTERN, rule)) == sorted(want, key=repr)
    assert tokencount.section_tokens(none, RANKS, PATTERN, rule).count() == 0


def test_token_rules_and_fields(odd):
    first, last = np.array([0, 3, 8]), np.array([2, 7, 8])
    ends = np.array([4, 6, 9])
    got = {r: tokencount.allocate(first, last, ends, r)[0].tolist() for r in tokencount.RULES}
    assert got == {"start": [0, 0, 2], "end": [0, 2, 2], "most": [0, 1, 2]}
    by = tokencount.section_tokens(odd.filter("doc_id = 3"), RANKS, PATTERN, fields=["lang", "source", "text"]).orderBy("section").collect()
    assert [(r.char_start, r.char_end) for r in by] == [(0, 3), (3, 4), (4, 14)]
    with pytest.raises(ValueError):
        tokencount.section_tokens(odd, RANKS, PATTERN, "middle")


def test_line_dedup(spark, docs, none, texts):
    want = brute.line_removals(pairs(docs))
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(docs).collect()}
    assert got == want and any(want.values())
    left = {r.doc_id: r for r in linededup.drop_lines(docs).collect()}
    for i, t in enumerate(texts):
        keep = [x for k, x in enumerate(t.split("\n")) if k not in want[i]]
        if i in left:
            assert left[i].text == "\n".join(keep) and left[i].n_chars == len(left[i].text)
        else:
            assert want[i] and all(len(brute.words(x)) < 3 or not x.strip(".,# $%") for x in keep)
    assert linededup.drop_lines(docs).columns == docs.columns
    assert linededup.line_report(none).count() == 0 and linededup.drop_lines(none).count() == 0


def test_line_dedup_finds_small_edits_and_odd_rows(spark, odd):
    line = "the quick brown fox jumps over the lazy dog while the sun sets behind the hills and the river runs on " * 3
    data = [(1, line), (2, line.replace("lazy", "lazi", 1)), (3, "other things entirely are written on this line here\n" + line.upper() + "!")]
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute.line_removals(data)
    report = sorted(((r.doc_id, r.n_lines, r.n_removed) for r in linededup.line_report(odd).collect()), key=repr)
    assert report == sorted([(None, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 1, 0), (4, 1, 0), (4, 1, 0), (None, 0, 0)], key=repr)
    long = spark.createDataFrame([(1, " ".join(f"t{k}" for k in range(n))) for n in (200, 300, 2000)], "doc_id long, text string")
    h = long.select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("h"))
    for r in h.select("h", linededup.simhash(F.col("h")).alias("s")).collect():
        assert r.s == sum(1 << k for k in range(63) if sum(x >> k & 1 for x in r.h) > len(r.h) // 2)


def removed(spark, data):
    """(lines to remove by edit similarity alone, those that the operator removes)."""
    got = {r.doc_id: r.removed for r in linededup.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    return tuple({(i, k) for i, x in r.items() for k in x} for r in (brute.line_removals(data), got))


def test_line_dedup_finds_edited_lines_of_8_to_40_words(spark):
    """Edits in one place are all found. Where they stand every ten characters, as many as are allowed, no block of any
    length is whole: such lines are beyond the candidates, and are in the recall that the next test measures."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    data, spread = [], set()
    for n in (8, 10, 15, 20, 30, 40):
        for how in range(6):
            line = " ".join(word() for _ in range(n))
            most = len(line) // 10
            new = list(line)
            if how < 3:  # spread over the line, as many as are allowed, and one more
                spread.add(2 * (len(data) // 2))
                places = np.linspace(0, len(line) - 1, most + (how == 2)).astype(int)
                for p in places:
                    new[p] = "" if how == 1 and p < len(line) - 1 else "é"
            else:
                new[how * 7 : how * 7 + most // 2] = []
            data += [(len(data), line), (len(data) + 1, "".join(new))]
    want, got = removed(spark, data)
    assert got <= want and {i for i, _ in want - got} <= {i + 1 for i in spread} and len(want) >= 25


def test_line_dedup_recall(spark):
    """One to four words replaced, put in or taken out, in lines of 8 to 40 words: at least 0.95 are found, and nothing else."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 10))))
    data = []
    for n in (8, 10, 12, 15, 20, 25, 30, 40) * 30:
        old = [word() for _ in range(n)]
        new = list(old)
        for _ in range(int(rng.integers(1, 5))):
            k, tried = int(rng.integers(0, len(new))), list(new)
            tried[k : k + 1] = [[word()], [word(), new[k]], []][int(rng.integers(0, 3))]
            if brute.edit(" ".join(old), " ".join(tried)) <= len(" ".join(old)) // 10:
                new = tried
        data += [(len(data), " ".join(old)), (len(data) + 1, " ".join(new))]
    want, got = removed(spark, data)
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 230


def test_line_dedup_repeated_rows_long_lines_and_names(spark):
    line, long = "a line that stands in several places of this table", " ".join(f"word{k}" for k in range(150_000))
    data = [(1, line), (1, line), (2, line), (3, f"{line}\n{line}"), (4, long), (5, long.replace("word70000", "other")), (2**63 - 1, line), (None, "another one by itself")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in data], "doc_id long, text string, _d int, _t int, _lines int, _D0 int, _parts int, _kept int")
    got = sorted(((r.doc_id, list(r.removed)) for r in linededup.line_report(df).collect()), key=repr)
    assert got == sorted([(1, []), (1, []), (2, [0]), (3, [0, 1]), (4, []), (5, [0]), (2**63 - 1, [0]), (None, [])], key=repr)
    left = linededup.drop_lines(df, size_col=None)
    assert left.columns == df.columns and sorted((r.doc_id for r in left.collect()), key=repr) == sorted([1, 1, 4, None], key=repr)


def test_line_dedup_does_not_verify_unlike_lines_that_share_a_passage(spark, monkeypatch):
    rng = np.random.default_rng(3)
    numbers = lambda n: [str(k) for k in rng.integers(1000, 9999, n)]
    passage = " ".join(numbers(30))
    data = [(k, f"{passage} a {' a '.join(numbers(80))}") for k in range(30)]  # the word "a" makes their SimHashes alike
    data += [(30, data[0][1][:-4] + "5")]
    asked, alike = [], linededup._alike
    monkeypatch.setattr(linededup, "_alike", lambda both: asked.append(both.count()) or alike(both))
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: [0] * (i == 30) for i, _ in data} and 1 <= sum(asked) <= 5


def test_line_dedup_does_not_verify_lines_that_are_unlike_around_a_passage(spark, monkeypatch):
    """Most words in common, so that words and SimHash do not tell them apart; each line has letters of its own around the passage."""
    rng = np.random.default_rng(7)
    words = lambda letters, n: " ".join("".join(rng.choice(list(letters), 6)) for _ in range(n))
    passage = words("abcdefghijklmnopqrstuvwxyz", 50)
    own = ["etao", "insh", "rdlu", "cgmp", "wbfv"]
    data = [(k, f"{words(own[k % 5], 11)} {passage} {words(own[(k + 1 + k // 5 % 4) % 5], 11)}") for k in range(40)]
    data += [(40, data[0][1][7:]), (41, data[1][1][:-4] + "zzzz")]  # like the first two
    asked, alike = [], linededup._alike
    monkeypatch.setattr(linededup, "_alike", lambda both: asked.append(both.count()) or alike(both))
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: [0] * (i >= 40) for i, _ in data} == brute.line_removals(data) and 2 <= sum(asked) <= 100


def test_line_dedup_finds_all_links_of_lines_around_a_passage(spark):
    """Own beginnings of about the length that edits allow, so that some of these lines are alike; they meet in many buckets."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("aeinorst"), int(rng.integers(2, 8)))) for _ in range(n))
    passage = words(75)
    data = [(k, f"{words(int(rng.integers(6, 15)))} {passage}") for k in range(70)]
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    lines = duckdb.from_arrow(pa.table({"d": [d for d, _ in data], "t": [t for _, t in data]}))  # noqa: F841
    links = duckdb.sql("SELECT a.d, b.d FROM lines a JOIN lines b ON a.d < b.d AND 100 * levenshtein(a.t, b.t) <= 10 * greatest(length(a.t), length(b.t))").fetchall()
    least = {d: d for d, _ in data}
    for _ in data:
        for x, y in links:
            least[x] = least[y] = min(least[x], least[y])
    assert got == {d: [0] * (least[d] < d) for d, _ in data}


def test_line_dedup_holds_no_more_on_disk_than_the_search_needs(spark, monkeypatch):
    """While pairs are searched: no keys of all lines, no second copy of the attributes, and shuffles of the texts are given up before."""
    there, held, steps = {}, [], []

    def written(write):
        def named(df, name):
            out = write(df, name)
            there[out._larkspur_path] = (name, set(out.columns))
            steps.append(name)
            return out

        return named

    def released(*tables, drop=linededup.release):
        for t in tables:
            there.pop(getattr(t, "_larkspur_path", None), None)
        drop(*tables)

    for module in (linededup, components):
        monkeypatch.setattr(module, "materialise", written(module.materialise))
        monkeypatch.setattr(module, "release", released)
    alike, forget = linededup._alike, linededup.forget_shuffles
    monkeypatch.setattr(linededup, "_alike", lambda both: held.extend(there.values()) or alike(both))
    monkeypatch.setattr(linededup, "forget_shuffles", lambda spark: steps.append("forgotten") or forget(spark))
    line = "the quick brown fox jumps over the lazy dog while the sun sets behind the hills and the river runs on"
    data = [(1, line), (2, line.replace("lazy", "lazi")), (3, "other things entirely are written on this line here")]
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute.line_removals(data) == {1: [], 2: [0], 3: []}
    assert held and not any("keys" in columns or name == "nodes" for name, columns in held)
    assert steps.count("crossed") == linededup.PARTS > 1 and not any(name in ("rest", "crossed") for name, _ in there.values())  # the last search, part by part
    assert all("forgotten" in steps[steps.index(name) : steps.index(name) + 2] for name in ("shared", "members", "spots", "norms"))


def test_line_dedup_takes_short_lines(spark):
    data = [(1, "Contents\nNext page\n\n***"), (2, "next PAGE.\ncontents\n\n***"), (3, "internationally agreed rules"), (4, "internationally agreed rulez")]
    got = {r.doc_id: list(r.removed) for r in linededup.line_report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 1], 3: [], 4: [0]} == brute.line_removals(data)


def test_line_dedup_keeps_documents_with_any_line_left(spark):
    line = "the same long line stands in every document here"
    data = [(1, line, 9), (2, f"{line}\nApples", 9), (3, f"{line}\n \n", 9), (4, f"{line}\n***", 9)]
    left = {r.doc_id: r.text for r in linededup.drop_lines(spark.createDataFrame(data, "doc_id long, text string, n_chars long")).collect()}
    assert left == {1: line, 2: "Apples", 4: "***"}


TRIE = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.Example.com", "/en/"), ("block", "net", "/es/"), ("block", "org", "/a/b"), ("allow", "org", "/a/b"), ("allow", "org", "/a/"), ("block", "", "/adm")]


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://x.com/", ("x.com", "/", "com/", "allow")), ("http://x.com", ("x.com", "", None, "allow")), ("HTTP://Sub.EXAMPLE.com/en/x?y#z", ("sub.example.com", "/en/x", "example.com/en/", "block")),
        ("http://a.www.example.com/en/", ("a.www.example.com", "/en/", "www.Example.com/en/", "allow")), ("http://myexample.com/en/", ("myexample.com", "/en/", "com/", "allow")),
        ("http://net/es/1", ("net", "/es/1", "net/es/", "block")), ("http://x.net/es", ("x.net", "/es", None, "allow")), ("http://o.org/a/bc", ("o.org", "/a/bc", "org/a/b", "block")), ("http://o.org/a/c", ("o.org", "/a/c", "org/a/", "allow")),
        ("http://z.io/admin", ("z.io", "/admin", "/adm", "block")), ("x.com/no-scheme", ("", "", None, "allow")), (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("http://x.com?q=http://y.net/es/", ("x.com", "", None, "allow")),
    ],
)
def test_url_filter(spark, url, want):
    df = spark.createDataFrame([(1, url, "extra"), (None, url, "extra")], "page_id long, url string, host string")
    got = urlfilter.url_verdicts(df, TRIE).collect()
    assert [tuple(r)[1:] for r in got] == [want, want] and {r.page_id for r in got} == {1, None}
    assert urlfilter.url_verdicts(df.limit(0), TRIE).count() == 0


def test_url_rules_are_checked(spark, monkeypatch):
    with pytest.raises(ValueError):
        urlfilter.UrlTrie([("maybe", "com", "/")])
    monkeypatch.setattr(urlfilter, "MAX_RULES", 1)
    with pytest.raises(ValueError):
        urlfilter.UrlTrie(TRIE)


def test_minhash(docs, odd, none):
    assert rows(minhash.near_duplicates(docs)) == brute.near_duplicates(pairs(docs))
    assert rows(minhash.near_duplicates(odd)) == brute.near_duplicates(pairs(odd))
    kept = {i for i, _, _, k in brute.near_duplicates(pairs(docs)) if k}
    assert {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()} == kept
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).columns == none.columns


def test_minhash_links_all_rows_of_a_repeated_id(spark):
    one, two, three = ("".join(f"{w}{k} " for k in range(20)) for w in ("a", "b", "c"))
    data = [(1, one), (5, one), (5, two), (7, two), (8, three), (9, three), (9, None), (9, one)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(minhash.near_duplicates(df))
    assert got == brute.near_duplicates(data) and {r[2] for r in got} == {1}


def test_minhash_links_through_a_hub(spark):
    rng = np.random.default_rng(2)
    base = [f"b{k}" for k in range(160)]
    data = [(500, " ".join(base))]
    for i in range(60):
        v = list(base)
        for k in rng.choice(160, 3, replace=False):
            v[k] = f"e{i}_{k}"
        data.append((i if i != 30 else 900, " ".join(v)))
    assert rows(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"))) == brute.near_duplicates(data)


def test_components(spark):
    from larkspur.llm.components import connected_components

    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {n for n, c in got.items() if c == 0} == set(range(41)) and {n for n, c in got.items() if c == 90} == {90, 95, 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_one_table(spark, monkeypatch):
    from larkspur.llm import components

    written, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or write(df, name))
    star = spark.createDataFrame([(k, 3) for k in range(4, 40)] + [(60, 50)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(star).collect()}
    assert got == {k: 3 for k in range(3, 40)} | {50: 50, 60: 50} and written == ["edges"]
    monkeypatch.setattr(components, "MANY", 1)  # the written steps, which few edges do without
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    assert {r.component for r in components.connected_components(chain).collect()} == {0} and "low" in written


def measures(text):
    w = brute.words(text)
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)} if len(tri) < 400 else None
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_quality(spark, docs, odd, none):
    for df in (docs, odd):
        got = {(r.doc_id, hash(r)): r for r in quality.quality_verdicts(df).collect()}
        assert len(got) == len({(r.doc_id, hash(r)) for r in got.values()})
        text = dict(pairs(df))
        for (i, _), r in got.items():
            if i is None or i == 4:
                continue
            want = measures(text[i])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4] and want[4] in (None, r.n_repeat_words)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert {r.doc_id for r in quality.quality_filter(docs).collect()} == {i for i, k in verdict.items() if k}
    assert quality.quality_filter(docs).schema.names == docs.columns and quality.quality_filter(odd).count() == 0
    assert quality.quality_verdicts(odd).count() == odd.count() and quality.quality_verdicts(none).count() == 0


def test_quality_fences_adapt(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(600):
        lang = ["en", "xx"][i % 2]
        w = [("longer" if lang == "xx" else "w") + str(k) for k in rng.integers(0, 5000, 120)]
        if i % 50 == 0:
            w = [x + "###" for x in w]
        data.append((i, " ".join(w), lang, f"s{i % 2 + 2 * (i % 300 == 7)}"))
    out = quality.quality_verdicts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in out.filter("NOT kept").collect()} == set(range(0, 600, 50))
