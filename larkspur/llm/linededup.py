"""Fuzzy line dedup, on DataFrame and SQL functions alone.

A line is normalised (lower case, each run of anything but letters and digits to one space, none at the ends). Every
line with a word takes part. Equal normalised lines are one class, known by a 64-bit and a 32-bit hash. Classes
are alike by edit similarity, ``100 * levenshtein <= (100 - SIMILAR) * length of the longer``, on the normalised
lines; below ``LEAST`` characters no edit is allowed. Of each connected group the occurrence with the smallest
(document id, text hash, line number) stays.

Candidates meet by pigeonhole: a line is cut into blocks, and where there are fewer edits than blocks one stays
unharmed. The blocks are cut from the line and not from the bits of its SimHash: one changed word in 20 turns 7 of
64 bits, so that a SimHash would have to be looked up at a radius of 8 or more, in blocks of 7 bits, which nearly all lines share.

* A block ends after each word whose hash says so (one in ``CUT``), hence inserted words move no other block. Blocks of
  under ``SHORT`` words are no keys.
* Lines with fewer than ``FEW`` such blocks also have their beginning and their end for blocks, of two lengths at
  most half the line, of which lines at 90 % have one in common; so a single edit in such a line is always found.

A key that several lines share is looked at again with the line's length (in classes of which like lines share one);
within it ``linked_components`` gathers groups without listing their pairs. Before the edit distance, lines of ``SURE``
words or more must have SimHashes within ``RADIUS`` of 28 bits (of all 63, unrelated lines differ by 30, like ones by 13 at most
on the test tables), counts of letters must fit in shorter ones, and so must the words (``_likely``): an edit of a letter harms one word,
that of a space two, so that more words than edits allowed can only be missing where spaces go; those that go are counted by the
number of words, which is exact unless a line both loses and gains spaces while nearly every edit allowed harms another word.
Of a block in common that stayed unharmed, lengths and letters before it and after it must fit too (``_beside``): lines that share
a passage and are unlike around it are refused there. The distance is added up between the blocks in common (``_alike``).

Defined results: null text has no lines, the empty text none either. A null document id takes part as the largest
id there is. Rows that repeat both id and text are one document, and lose the same lines; rows that repeat an id
with another text are documents of their own, in the order of the text's hash. Equal lines of one document are
copies like others, of which the first stays. Texts and lines of any length are taken whole. An empty table gives an empty one.
Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import forget_shuffles, free_name, materialise, release
from larkspur.llm.components import linked_components, shared_buckets

SIMILAR, LEAST = 90, 10
CUT, SHORT, FEW = 5, 3, 3
RADIUS, SURE = 10, 8
ANCHOR, SLACK, LONG, WHOLE = 12, 5, 200, 700
PIVOTS, PARTS = 4, 4
_GROWTH = 1.35
_LETTERS = " etaoinshrdlucgmpwbfv"
_AROUND = _LETTERS + "ykzj"
_LANE = 12  # bits of a letter's counter, five to a long; differences of counts below _HALF fit when _HALF is added to each
_HALF = 1 << (_LANE - 1)
CROWD = 32  # lines with a bucket of so many others are told about where their blocks stand
_LAST_ID = 2**63 - 1


def settled(df: DataFrame, *columns: str, **made: Column) -> DataFrame:
    """Columns that are computed once: a generator stands between them and the filters and lambdas that use
    them, into which the optimiser would otherwise copy them."""
    return df.select(*columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def _ones(width: int) -> Column:
    return F.lit(sum(1 << at for at in range(0, 63, width))).cast("long")


def _lane(h: Column, k: int, width: int) -> Column:
    """Bits k, k + width, ... of a hash, each in a counter of its own."""
    return F.shiftrightunsigned(h, k).bitwiseAND(_ones(width))


def _bits(counts: list[Column], n: Column, width: int) -> Column:
    """Bits 0 to 62 whose counters, side by side in ``counts``, are above half of n."""
    lift = _ones(width) * (F.lit((1 << (width - 1)) - 1).cast("long") - F.shiftright(n, 1))  # takes those to their top bit
    out = F.lit(0).cast("long")
    for k, c in enumerate(counts):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(c + lift, width - 1).bitwiseAND(_ones(width)), k))
    return out


def _majority(hashes: Column, width: int, lanes: int | None = None) -> Column:
    """Bits 0 to 62 that more than half of the hashes have (of the first ``lanes`` of each ``width`` bits); counters of ``width``
    bits (a divisor of 63) are packed side by side, so that one addition counts 63 / width bits and no sum reaches the sign bit."""
    lanes = lanes or width
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(lanes)])
    add = lambda acc, h: F.struct(*[(acc[f"c{k}"] + _lane(h, k, width)).alias(f"c{k}") for k in range(lanes)])
    return F.aggregate(hashes, zero, add, lambda acc: _bits([acc[f"c{k}"] for k in range(lanes)], F.size(hashes), width))


def simhash(hashes: Column) -> Column:
    """63-bit SimHash of an array of 64-bit hashes: bit k is set where more than half of them have it."""
    n = F.size(hashes)
    return F.when(n < 1 << 8, _majority(hashes, 9)).when(n < 1 << 20, _majority(hashes, 21)).otherwise(_majority(hashes, 63))


def line_print(hashes: Column) -> Column:
    """28 bits of the SimHash, bits 0 to 3 of each 9, which take fewer additions than all."""
    some = sum(1 << (9 * j + k) for j in range(7) for k in range(4))
    return F.when(F.size(hashes) < 1 << 8, _majority(hashes, 9, 4)).otherwise(simhash(hashes).bitwiseAND(F.lit(some).cast("long")))


def _most(size: Column) -> Column:
    """Edits that a line of this length, the longer of a pair, may be away."""
    return F.floor(size * (100 - SIMILAR) / 100).cast("int")


def _letters(norm: Column) -> Column:
    """How often each of ``_LETTERS`` occurs; an edit changes two of them by one at most."""
    return F.array(*[F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit(""))) for c in _LETTERS])


def _last_words(hashes: Column) -> Column:
    """Places of the words after which a block ends: one in CUT by hash, and the last."""
    ends = lambda h, i: F.when(F.pmod(h, F.lit(CUT)) == 0, i).otherwise(-1)
    return F.array_distinct(F.array_append(F.array_remove(F.transform(hashes, ends), -1), F.size(hashes) - 1))


def _blocks(hashes: Column, ends: Column) -> Column:
    """Hashes of the blocks of SHORT words and more."""
    before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(-1))
    block = lambda e, k: F.when(e - before(k) >= SHORT, F.xxhash64(F.slice(hashes, before(k) + 2, e - before(k))))
    return F.array_compact(F.transform(ends, block))


def _keys(norm: Column, size: Column, blocks: Column) -> Column:
    """The blocks and, of a line with few, its beginning and end; none below LEAST characters."""
    step = F.floor(F.log(size / LEAST) / F.log(F.lit(_GROWTH)) + 1e-9).cast("int")
    width = lambda j: F.floor(F.lit(LEAST // 2) * F.pow(F.lit(_GROWTH), j)).cast("int")
    edge = lambda j: F.array(F.xxhash64(F.lit("begins"), j, F.left(norm, width(j))), F.xxhash64(F.lit("ends"), j, F.right(norm, width(j))))
    both = F.when(step > 0, F.concat(edge(step), edge(step - 1))).otherwise(edge(step))
    return F.when(size < LEAST, F.array().cast("array<bigint>")).when(F.size(blocks) < FEW, F.concat(blocks, both)).otherwise(blocks)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = F.col(f"`{id_col}`").cast("long")
    return docs.select(own.alias("own"), F.coalesce(own, F.lit(_LAST_ID)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def _normal(text: Column) -> Column:
    """Lines normalised at once, but for a space at an end. A single space is left alone, which is most of what there is to match."""
    return F.regexp_replace(F.lower(text), r"(?:[^\p{L}\p{N}\n ]| (?=[^\p{L}\p{N}\n]))[^\p{L}\p{N}\n]*", " ")


def _word_hashes(norm: Column) -> Column:
    return F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))


def _lines(named: DataFrame) -> DataFrame:
    """``d, t, pos, size, k1, k2, keys`` of every line that has a word."""
    lines = named.select("d", "t", F.posexplode(F.split(_normal(F.col("text")), "\n")).alias("pos", "line")).filter("line != '' AND line != ' '")
    lines = settled(lines, "d", "t", "pos", norm=F.trim("line"))
    lines = settled(lines, "d", "t", "pos", "norm", size=F.length("norm"), hashes=_word_hashes(F.col("norm")))
    lines = settled(lines, "d", "t", "pos", "norm", "size", "hashes", ends=_last_words(F.col("hashes")))
    lines = settled(lines, "d", "t", "pos", "norm", "size", blocks=_blocks(F.col("hashes"), F.col("ends")))
    keys = _keys(F.col("norm"), F.col("size"), F.col("blocks"))
    return lines.select("d", "t", "pos", "size", F.xxhash64("norm").alias("k1"), F.hash("norm").alias("k2"), keys.alias("keys"))


def _buckets(lines: DataFrame) -> DataFrame:
    """``key, node, size`` of lines that share a block with another one of about their length."""
    keyed = lines.select(F.explode("keys").alias("key"), F.col("k1").alias("node"), F.col("size").alias("length"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    shared = materialise(shared, "shared")
    forget_shuffles(lines.sparkSession)
    kind = F.floor(F.log(F.col("length")) / F.lit(0.1165)).cast("int")  # lengths at a ratio of 0.89: like lines are in one or in adjacent ones
    held = keyed.join(shared, "key").select("key", "node", kind.alias("kind")).distinct()
    held = held.select(F.explode(F.array(F.xxhash64("key", "kind"), F.xxhash64("key", F.col("kind") - 1))).alias("key"), "node")
    held = materialise(held, "members")
    forget_shuffles(lines.sparkSession)
    out = shared_buckets(held)
    release(shared, held)
    return out


def _numbered(words: Column) -> Column:
    """Two bytes for each word of a sorted array of hashes and its number among equal ones, which is counted up to 6."""
    again = lambda h, i: [F.coalesce(F.get(words, i - j) == h, F.lit(False)) for j in (1, 2, 3, 4, 5, 6)]
    return F.array_distinct(F.transform(words, lambda h, i: F.shiftright(F.hash(h, *again(h, i)), 16).cast("short")))


def _packed(text: Column) -> Column:
    """How often each of ``_AROUND`` occurs, five counters to a long."""
    count = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("long")
    return F.array(*[sum((F.shiftleft(count(_AROUND[j + k]), _LANE * k) for k in range(1, 5)), count(_AROUND[j])) for j in range(0, len(_AROUND), 5)])


def _marks(parts: Column, words: Column) -> Column:
    """``marks(at, before), whole`` of a line by its blocks: where those of SHORT words and more begin, the letters before them, and
    those of the line."""
    none = F.array(*[F.lit(0).cast("long") for _ in range(0, len(_AROUND), 5)])
    mark = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("at"), none.alias("before"))
    start = F.struct(F.lit(0).alias("at"), none.alias("whole"), F.filter(F.array(mark), lambda x: F.lit(False)).alias("marks"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(F.xxhash64(x["part"]).alias("h"), acc["at"].alias("at"), acc["whole"].alias("before"))
        return F.struct(
            (acc["at"] + F.length(x["part"]) + 1).alias("at"), F.zip_with(acc["whole"], _packed(F.concat(x["part"], F.lit(" "))), lambda p, q: p + q).alias("whole"),
            F.when(x["words"] >= SHORT, F.array_append(acc["marks"], here)).otherwise(acc["marks"]).alias("marks"),
        )

    return F.aggregate(F.arrays_zip(parts.alias("part"), words.alias("words")), start, step)


def _texts(lines: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, size, n, letters, fp, bag, around, parts`` of the lines in question, from one document each; parts are all blocks of the
    line, around is where they stand (of lines with other keys than blocks, with a block that is repeated, too long for it, or in no bucket of CROWD: null)."""
    repeated = not named.groupBy("d", "t").count().filter("count > 1").isEmpty()  # such documents name their lines more than once
    found = lines.join(nodes, lines["k1"] == nodes["node"]).groupBy("node", "crowd").agg(F.min(F.struct("d", "t", "pos")).alias("first"))
    spots = materialise(found.groupBy("first.d", "first.t").agg(F.collect_set(F.struct("first.pos", "node", "crowd")).alias("spots")), "spots")
    forget_shuffles(lines.sparkSession)
    held = settled(named.select("d", "t", "text").join(spots, ["d", "t"]), "spots", all=F.split("text", "\n"))
    held = held.select(F.inline(F.transform("spots", lambda x: F.struct(x["node"].alias("node"), x["crowd"].alias("crowd"), F.get("all", x["pos"]).alias("line")))))
    held = settled(held, "node", "crowd", norm=F.trim(_normal(F.col("line"))))
    if repeated:
        held = held.dropDuplicates(["node"])
    held = settled(held, "node", "crowd", "norm", words=F.split("norm", " "), hashes=_word_hashes(F.col("norm")))
    held = settled(held, "node", "crowd", "norm", "words", "hashes", ends=_last_words(F.col("hashes")))
    before = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(-1))
    parts = F.transform("ends", lambda e, k: F.array_join(F.slice("words", before(k) + 2, e - before(k)), " "))
    spans = F.transform("ends", lambda e, k: e - before(k))
    held = settled(held, "node", "crowd", "norm", "hashes", sorted=F.sort_array("hashes"), parts=parts, spans=spans)
    held = settled(held, "node", "crowd", "norm", "hashes", "sorted", "parts", around=F.when((F.col("crowd") >= CROWD) & (F.length("norm") < _HALF), _marks(F.col("parts"), F.col("spans"))))
    sure = F.size("hashes") >= SURE
    marks = F.col("around.marks.h")
    told = (F.size(marks) >= FEW) & (F.size(F.array_distinct(marks)) == F.size(marks))
    out = held.select(
        "node", F.length("norm").alias("size"), F.size("hashes").alias("n"), F.when(~sure, _letters(F.col("norm"))).alias("letters"),
        F.when(sure, line_print(F.col("hashes"))).alias("fp"), _numbered(F.col("sorted")).alias("bag"),
        F.when(told, F.struct("around.marks", "around.whole")).alias("around"), "parts",
    )
    out = materialise(out, "norms")
    release(spots)
    return out


def _beside(a: str, b: str, most: Column) -> Column:
    """Whether some block in common can have stayed unharmed: what stands before it and after it in the two lines is, by lengths and letters,
    no more than ``most`` edits away (an edit changes a length by one, or two letters). Null where a line is not told about."""
    hashes = lambda x: F.col(f"{x}around.marks.h")
    mark = lambda x, h: F.get(F.col(f"{x}around.marks"), F.array_position(hashes(x), h).cast("int") - 1)
    lane = lambda c, k: F.shiftright(c, _LANE * k).bitwiseAND(F.lit((1 << _LANE) - 1))
    longs = range(len(_AROUND) // 5)
    less = lambda x, y, j: x[j] - y[j] + F.lit(sum(_HALF << (_LANE * k) for k in range(5))).cast("long")
    whole = [less(F.col(f"{a}around.whole"), F.col(f"{b}around.whole"), j) for j in longs]
    longer = F.col(f"{a}size") - F.col(f"{b}size")

    def before(both: Column) -> Column:
        """By how much the two lines differ before a block; blocks side by side in both differ alike."""
        x, y = both["x"], both["y"]
        return F.struct((x["at"] - y["at"]).alias("at"), *[less(x["before"], y["before"], j).alias(f"c{j}") for j in longs])

    def fits(d: Column) -> Column:
        off = F.abs(d["at"]) + F.abs(longer - d["at"])
        letters = [F.abs(lane(d[f"c{j}"], k) - _HALF) + F.abs(lane(whole[j], k) - lane(d[f"c{j}"], k)) for j in longs for k in range(5)]
        return F.when(off > 2 * most, False).otherwise(sum(letters, off) <= 2 * most)

    shared = F.array_intersect(hashes(a), hashes(b))
    apart = F.transform(shared, lambda h: _let(F.struct(mark(a, h).alias("x"), mark(b, h).alias("y")), before))
    return F.exists(F.array_distinct(apart), fits)


def _likely(a: str, b: str) -> Column:
    """What edit similarity asks of lengths, SimHashes, letters and words."""
    a_size, b_size = F.col(f"{a}size"), F.col(f"{b}size")
    most = _most(F.greatest(a_size, b_size))
    apart = sum((F.abs(F.get(f"{a}letters", F.lit(k)) - F.get(f"{b}letters", F.lit(k))) for k in range(1, len(_LETTERS))), F.abs(F.get(f"{a}letters", F.lit(0)) - F.get(f"{b}letters", F.lit(0))))
    near = F.coalesce(F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= RADIUS, F.lit(True))
    missing = F.size(F.array_except(F.col(f"{a}bag"), F.col(f"{b}bag")))
    gone = F.greatest(F.col(f"{a}n") - F.col(f"{b}n"), F.lit(0))
    fit = (F.abs(a_size - b_size) <= most) & near & F.coalesce(apart <= 2 * most, F.lit(True)) & (missing <= most + gone)
    return fit & F.coalesce(_beside(a, b, most), F.lit(True))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _distance(one: Column, two: Column, most: Column) -> Column:
    """Levenshtein distance up to ``most``, -1 above. What long texts begin and end with alike is left out first, which does not change it."""

    def rest(s: Column, end, cut) -> Column:
        def longer(n: Column, k: Column) -> Column:
            fits = n + k <= F.least(F.length(s["x"]), F.length(s["y"]))
            return F.when(fits & (end(s["x"], n + k) == end(s["y"], n + k)), n + k).otherwise(n)

        same = F.aggregate(F.array(*[F.lit(1 << k) for k in range(20, -1, -1)]), F.lit(0), longer)
        return _let(same, lambda n: F.struct(cut(s["x"], n).alias("x"), cut(s["y"], n).alias("y")))

    between = lambda s: F.call_function("levenshtein", s["x"], s["y"], most)
    front = lambda s: rest(s, F.left, lambda t, n: F.substr(t, n + 1))
    back = lambda s: rest(s, F.right, lambda t, n: F.left(t, F.length(t) - n))
    both = F.struct(one.alias("x"), two.alias("y"))
    return _let(both, lambda s: F.when(F.least(F.length(s["x"]), F.length(s["y"])) > LONG, _let(_let(front(s), back), between)).otherwise(between(s)))


def _alike(both: DataFrame) -> DataFrame:
    """``a, b`` of ``both(a, b, a_parts, b_parts)`` with the edit similarity. Lines of up to ``WHOLE`` characters are compared whole, which takes
    a third of the time there. In longer ones the blocks of ``ANCHOR`` characters or more that
    both lines have, in the same order, are set against each other, and the distances of what lies between them are added up.
    That is never less than the distance of the lines, and as much in nearly all cases: at most ``SLACK`` percent
    above the limit, or anywhere above it where the order differs, the whole lines are compared. Before that, blocks at nearly
    the same place are set against each other, equal ones too, which lines of one repeated phrase are made of."""
    gap = lambda x, first, upto: F.array_join(F.slice(f"{x}_parts", first, upto - first), " ")

    def between(acc: Column, a_at: Column, b_at: Column) -> Column:
        """Distance from the last anchor to these places; far beyond the limit where it is."""

        def apart(s: Column) -> Column:
            far = _let(_distance(s["one"], s["two"], F.col("most")), lambda n: F.when(n < 0, 2 * F.col("most") + 2).otherwise(n))
            return F.when(s["one"] == s["two"], 0).otherwise(far + F.when((s["one"] == "") != (s["two"] == ""), 1).otherwise(0))

        return _let(F.struct(gap("a", acc["a"] + 1, a_at).alias("one"), gap("b", acc["b"] + 1, b_at).alias("two")), apart)

    def step(acc: Column, c: Column) -> Column:
        on = c["b"] > acc["b"]
        next_to = (c["a"] == acc["a"] + 1) & (c["b"] == acc["b"] + 1)
        cost = F.when(next_to | (acc["cost"] > 2 * F.col("most")), acc["cost"]).otherwise(acc["cost"] + between(acc, c["a"], c["b"]))
        after = F.struct(c["a"].alias("a"), c["b"].alias("b"), cost.cast("int").alias("cost"), acc["ok"].alias("ok"))
        return F.when(on, after).otherwise(F.struct(acc["a"].alias("a"), acc["b"].alias("b"), acc["cost"].alias("cost"), F.lit(False).alias("ok")))

    def beside(acc: Column, c: Column) -> Column:
        """The block c of a, with the same block of b at most three places off the last anchors' distance."""
        at, on = acc["at"] + 1, acc["at"] + 1 + acc["b"] - acc["a"]
        places = [F.when((F.get("b_parts", on + k - 1) == c) & (on + k > acc["b"]), on + k) for k in (0, 1, -1, 2, -2, 3, -3)]
        found = F.when((F.length(c) >= ANCHOR) & (acc["cost"] <= F.col("most")), F.coalesce(*places))

        def after(b: Column) -> Column:
            next_to = (at == acc["a"] + 1) & (b == acc["b"] + 1)
            cost = F.when(next_to, acc["cost"]).otherwise(acc["cost"] + between(acc, at, b))
            there = F.struct(at.alias("at"), at.alias("a"), b.alias("b"), cost.cast("int").alias("cost"))
            return F.when(b.isNotNull(), there).otherwise(F.struct(at.alias("at"), acc["a"].alias("a"), acc["b"].alias("b"), acc["cost"].alias("cost")))

        return _let(found, after)

    size = lambda x: F.length(F.array_join(f"{x}_parts", " "))
    ends = lambda acc: F.when(acc["cost"] > F.col("most"), acc["cost"]).otherwise(acc["cost"] + between(acc, F.size("a_parts") + 1, F.size("b_parts") + 1))
    none = F.lit(0)
    both = settled(both, "a", "b", "a_parts", "b_parts", longer=F.greatest(size("a"), size("b")))
    both = settled(both, "a", "b", "a_parts", "b_parts", most=_most(F.col("longer")), long=F.col("longer") > WHOLE)
    walk = F.aggregate("a_parts", F.struct(none.alias("at"), none.alias("a"), none.alias("b"), none.alias("cost")), beside)
    both = settled(both, "a", "b", "a_parts", "b_parts", "most", "long", acc=F.when(F.col("long"), walk))
    both = settled(both, "a", "b", "a_parts", "b_parts", "most", "long", found=F.when(F.col("long"), ends(F.col("acc")) <= F.col("most")))
    at = lambda x, c: F.array_position(F.col(f"{x}_parts"), c).cast("int").alias(x)
    shared = F.transform(F.filter(F.array_intersect("a_parts", "b_parts"), lambda c: F.length(c) >= ANCHOR), lambda c: F.struct(at("a", c), at("b", c)))
    both = settled(both, "a", "b", "a_parts", "b_parts", "most", "long", "found", shared=F.when(~F.col("found"), shared))
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("cost"), F.lit(True).alias("ok"))
    both = settled(both, "a", "b", "a_parts", "b_parts", "most", "long", "found", acc=F.aggregate("shared", start, step))
    end = F.col("acc.cost") + between(F.col("acc"), F.size("a_parts") + 1, F.size("b_parts") + 1)
    both = settled(both, "a", "b", "a_parts", "b_parts", "most", "long", "found", ok=F.col("acc.ok"), cost=F.when(~F.col("found"), end))
    one, two = F.array_join("a_parts", " "), F.array_join("b_parts", " ")
    plain = F.call_function("levenshtein", one, two, F.col("most")) >= 0
    whole = _distance(one, two, F.col("most")) >= 0
    close = ~F.col("ok") | (100 * F.col("cost") <= (100 + SLACK) * F.col("most") + 200)
    return both.filter(F.when(~F.col("long"), plain).when(F.col("found") | (F.col("cost") <= F.col("most")), True).when(close, whole).otherwise(False)).select("a", "b")


def line_groups(lines: DataFrame, named: DataFrame, buckets: DataFrame) -> DataFrame:
    """``node, component`` of the lines (by k1) that are like another line."""
    norms = _texts(lines, named, buckets.groupBy("node").agg(F.max("size").alias("crowd")))
    forget_shuffles(lines.sparkSession)  # the texts' own, which are the largest

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        forget_shuffles(pairs.sparkSession)  # those of the search; the texts of all pairs are shuffled next
        side = lambda p: norms.select(F.col("node").alias(p), F.col("parts").alias(f"{p}_parts"))
        return _alike(pairs.join(side("a"), "a").join(side("b"), "b"))

    out = linked_components(buckets, norms.select("node", "size", "n", "letters", "fp", "bag", "around"), _likely, verify, pivots=PIVOTS, own=True, parts=PARTS)
    release(buckets, norms)
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d, t, lines``: for each document (id and text hash) the numbers, from 0, of the lines to remove."""
    named = _documents(docs, id_col, text_col)
    cut = materialise(_lines(named), "lines")
    buckets = _buckets(cut)
    lines = materialise(cut.select("d", "t", "pos", "k1", "k2"), "places")  # the keys are most of the table, and the search has them in its buckets
    release(cut)
    forget_shuffles(docs.sparkSession)
    comps = line_groups(lines, named, buckets)
    classes = lines.groupBy("k1", "k2").agg(F.min("d").alias("d"), F.count("*").alias("n"))
    classes = classes.join(comps, F.col("k1") == F.col("node"), "left").filter("n > 1 OR component IS NOT NULL")
    lone = F.col("component").isNull()
    classes = classes.select("k1", "k2", "d", F.coalesce("component", "k1").alias("g1"), F.when(lone, F.col("k2")).alias("g2"), F.when(lone, 1).otherwise(2).alias("g3"))
    group = ["g1", "g2", "g3"]
    classes = materialise(classes.withColumn("g2", F.coalesce("g2", F.lit(0))), "groups")
    keeper = materialise(classes.groupBy(*group).agg(F.min("d").alias("keep")), "keepers")
    doomed = materialise(classes.join(keeper, group).select("k1", "k2", *group, "keep"), "doomed")
    hits = materialise(lines.select("d", "t", "pos", "k1", "k2").join(doomed, ["k1", "k2"]).select("d", "t", "pos", *group, "keep"), "hits")
    first = materialise(hits.filter("d = keep").groupBy(*group).agg(F.min(F.struct("t", "pos")).alias("first")), "first")
    stays = (F.col("d") == F.col("keep")) & (F.struct("t", "pos") == F.col("first"))
    gone = hits.join(first, group).filter(~stays)
    out = materialise(gone.groupBy("d", "t").agg(F.array_sort(F.collect_set("pos")).alias("lines")), "removed")
    release(lines, classes, keeper, doomed, hits, first)
    return out


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, removed array<int>`` of every row: the numbers of the lines to remove."""
    gone = removed_lines(docs, id_col, text_col)
    slim = _documents(docs, id_col, text_col).select("own", "d", "t", F.when(F.col("text") != "", F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"))
    out = slim.join(gone, ["d", "t"], "left")
    none = F.array().cast("array<int>")
    return out.select(F.col("own").alias("doc_id"), "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("lines", none).alias("removed"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with those lines gone. A document that loses lines and has none left that is not blank goes; others keep
    their other columns (``size_col``, if there, is counted again)."""
    d, t, lines, d0, t0, parts, kept = (free_name(docs, n) for n in ("d", "t", "lines", "d0", "t0", "parts", "kept"))
    gone = removed_lines(docs, id_col, text_col).select(F.col("d").alias(d), F.col("t").alias(t), F.col("lines").alias(lines))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.withColumns({d0: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST_ID)), t0: F.xxhash64(text)})
    out = own.join(gone, (F.col(d0) == F.col(d)) & (F.col(t0) == F.col(t)), "left")
    names = [f"`{c}`" for c in docs.columns]
    out = settled(out, *names, lines, **{parts: F.split(F.col(f"`{text_col}`"), "\n")})
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lines)), lambda k: F.get(parts, k))
    out = settled(out, *names, **{kept: F.when(F.col(lines).isNotNull(), left)})
    out = out.filter(F.col(kept).isNull() | F.exists(kept, lambda x: x.rlike(r"\S")))
    new = F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(f"`{text_col}`"))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(new.alias(c))
        elif c == size_col:
            cols.append(F.when(F.col(kept).isNotNull(), F.length(new)).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
