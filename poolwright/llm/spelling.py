"""Spelling variants: words one edit apart, found by pivotal grams.

Every word is cut into overlapping pairs of letters, ordered by how rare they are in the
vocabulary. The first three pairs (and others equal to the third) are its prefix. Two disjoint
pairs of the prefix, chosen by dynamic programming for the smallest sum of frequencies, are its
pivots. One edit destroys at most one of two disjoint pairs; so of two words one edit apart, that
whose prefix ends earlier in the order has a pivot that also stands in the other's prefix.
Pivots are looked up in an index of prefixes, and candidates are verified letter by letter.

Position limits make the lookup narrow. The edit lies on one side of the surviving pair, and the
other side is untouched: the pair stands at the same place from the start and all before it is
equal, or the same from the end. So the key of the index is the pair with all that lies on
the untouched side. Where that is short, half of the rest is added: one edit leaves one of two halves
as it is, and the lookup is made for each length the other word can have. All keys are 64-bit
hashes and only narrow candidates, so verification decides alone. Of words of LONG letters
and more the halves themselves are keys (as with no pair at all): they are selective enough, and
a word that repeats one pair ten thousand times would have as many long keys. Words of exactly
LONG letters have both kinds, so every two lengths that can be near share one.

Defined cases: a null or empty text has no words; a null doc_id counts as the text ``null``
where letters are drawn; equal rows count as often as they occur; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.common import table
from poolwright.session import drop, materialize

LETTERS = "A-Za-z\\u00C0-\\u00FF"
ALPHABET = 90  # a-z and the 64 letters from À to ÿ
LEAST_LENGTH = 7
LEAST_TIMES = 2
RATIO = 10
NOISE = 31
LONG = 64  # letters from which on halves of the word are keys by themselves
SHORT = 6  # letters of untouched text that are enough for a key


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, noise: int | None = None) -> DataFrame:
    """One row (word) per run of at least ``least`` letters; with ``noise``, one run in so many loses a letter, by a checksum of document and run."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")).alias("_doc"), F.explode(runs).alias("_run"))
    found = found.select("_doc", lower_ascii(F.col("_run")).alias("_run"))
    if not noise:
        return found.select(F.col("_run").alias("word"))
    drawn = F.crc32(F.concat("_doc", F.lit(":"), "_run").cast("binary"))
    found = found.select("_run", drawn.alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    less = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    return found.select(F.when(F.col("_h") % noise == 0, less).otherwise(F.col("_run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_times)


def _letter(word: str, at: Column) -> Column:
    """The number of a letter (a-z, then À-ÿ), ``at`` from 1."""
    code = F.ascii(F.substring(F.col(word), at, F.lit(1)))
    return F.when(code < 0xC0, code - 97).otherwise(code - (0xC0 - 26))


def _pairs(word: str) -> Column:
    """The pairs of letters of a word: their numbers g and places from 0."""
    places = F.sequence(F.lit(0), F.length(word) - 2)
    return F.transform(places, lambda i: F.struct((_letter(word, i + 1) * ALPHABET + _letter(word, i + 2)).alias("g"), i.alias("at")))


def _sorted_pairs(words: DataFrame) -> DataFrame:
    """(word, n, _sorted): all pairs as (count, g, at), rarest first.

    The counts of pairs are one row of ALPHABET squared numbers, whatever the input.
    """
    pairs = words.select(F.explode(F.transform(_pairs("word"), lambda p: p["g"])).alias("g"))
    counts = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("c")).agg(F.map_from_entries(F.collect_list(F.struct("g", "c"))).alias("_m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(ALPHABET**2 - 1)), lambda g: F.coalesce(F.try_element_at("_m", g), F.lit(0)))
    counts = materialize(counts.select(each.alias("_counts")))
    rated = F.transform(_pairs("word"), lambda p: F.struct(F.get("_counts", p["g"]).alias("c"), p["g"].alias("g"), p["at"].alias("at")))
    return words.withColumn("_counts", counts.scalar()).select("word", "n", F.sort_array(rated).alias("_sorted"))


def _pivots(prefix: Column) -> Column:
    """The two disjoint pairs with the smallest sum of counts, of three pairs at different places.

    Dynamic programming over places: the state is the pair just seen, the rarest before
    it, and the best couple so far. Only the pair just seen can overlap with the next one.
    """
    by_place = F.array_sort(prefix, lambda a, b: a["at"] - b["at"])
    one = "struct<c:bigint,g:int,at:int>"
    start = F.from_json(F.lit("{}"), f"struct<last:{one},before:{one},cost:bigint,x:{one},y:{one}>")

    def step(s: Column, p: Column) -> Column:
        apart = F.when(s["last"]["at"] + 2 <= p["at"], s["last"])
        free = F.least(apart, s["before"])
        better = free.isNotNull() & (s["cost"].isNull() | (free["c"] + p["c"] < s["cost"]))
        return F.struct(
            p.alias("last"), F.least(s["before"], s["last"]).alias("before"),
            F.when(better, free["c"] + p["c"]).otherwise(s["cost"]).alias("cost"),
            F.when(better, free).otherwise(s["x"]).alias("x"), F.when(better, p).otherwise(s["y"]).alias("y"),
        )

    done = F.aggregate(by_place, start, step)
    return F.array(done["x"], done["y"])


def grams(words: DataFrame) -> DataFrame:
    """(word, n, prefix, pivots)."""
    third = F.col("_sorted")[2]
    prefix = F.filter("_sorted", lambda p: (p["c"] < third["c"]) | ((p["c"] == third["c"]) & (p["g"] <= third["g"])))
    rated = _sorted_pairs(words).select("word", "n", prefix.alias("prefix"))
    return rated.withColumn("pivots", _pivots(F.slice("prefix", 1, 3)))


def _halves(kept: Column, left: bool, ask: bool) -> list[Column]:
    """Keys of a word from its ``kept`` untouched letters on one side with either half of the rest.

    The half is measured on the word in the index, so ``ask`` makes them for each length that word can have.
    """
    length, word = F.length("word"), F.col("word")
    side = F.substring(word, F.lit(1), kept) if left else F.substring(word, length - kept + 1, kept)
    out = []
    for d in (-1, 0, 1) if ask else (0,):
        half = F.floor((length + d - kept) / 2).cast("int")
        rest = length + d - kept - half
        near = F.substring(word, kept + 1, half) if left else F.substring(word, length - kept - half + 1, half)
        far = F.substring(word, length - rest + 1, rest) if left else F.substring(word, F.lit(1), rest)
        out += [F.xxhash64(F.lit(left), side, length + d, F.lit(k), part) for k, part in ((1, near), (2, far))]
    return out


def _keys(chosen: str, ask: bool) -> Column:
    """The keys of the pairs in a column; ``ask``: for every length of the other word, else for one's own."""
    length, word = F.length("word"), F.col("word")

    def of(p: Column) -> Column:
        out = []
        for left in (True, False):
            kept = p["at"] + 2 if left else length - p["at"]
            side = F.substring(word, F.lit(1), kept) if left else F.substring(word, length - kept + 1, kept)
            out.append(F.when(kept >= SHORT, F.array(F.xxhash64(F.lit(left), side))).otherwise(F.array(*_halves(kept, left, ask))))
        return F.concat(*out)

    return F.array_distinct(F.flatten(F.transform(F.col(chosen), of)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): the pairs of words one inserted, deleted or replaced letter apart, a < b."""
    ready = materialize(grams(words.filter(F.length("word") <= LONG)))
    large = words.filter(F.length("word") >= LONG)

    def keyed(column: str, ask: bool) -> DataFrame:
        some = ready.select("word", "n", F.explode(_keys(column, ask)).alias("_key"))
        return some.unionByName(large.select("word", "n", F.explode(F.array(*_halves(F.lit(0), True, ask))).alias("_key")))

    index = keyed("prefix", ask=False)
    asked = keyed("pivots", ask=True).withColumnsRenamed({"word": "_w", "n": "_n"})
    close = (F.col("word") != F.col("_w")) & (F.abs(F.length("word") - F.length("_w")) <= 1) & (F.levenshtein("word", "_w", 1) == 1)
    met = asked.join(index, "_key").filter(close)
    first = F.col("word") < F.col("_w")
    return met.select(
        F.least("word", "_w").alias("a"), F.greatest("word", "_w").alias("b"),
        F.when(first, F.col("n")).otherwise(F.col("_n")).alias("a_n"), F.when(first, F.col("_n")).otherwise(F.col("n")).alias("b_n"),
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) links to (word, root), the end of each chain; every round doubles what a link spans.

    A form is at least RATIO times as frequent as its word, so chains are short and have no loops.
    """
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = longer.filter("_moved").limit(1).count()
        drop(links)
        links = longer.drop("_moved")
        if not moved:
            return links


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n."""
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("w")).alias("_o"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.struct((-F.col("a_n")).alias("m"), F.col("a").alias("w")).alias("_o")))
    best = materialize(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("_o").alias("_o"), F.max("n").alias("_n")))
    known = F.col("_n") * ratio <= -F.col("_o.m")
    best = best.select("word", "n_near", F.when(known, F.col("_o.w")).alias("form"), F.when(known, -F.col("_o.m")).alias("form_n"))
    ends = roots(best.filter("form is not null"))
    return (
        words.join(best, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def spellings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES,
    ratio: int = RATIO, noise: int | None = None,
) -> DataFrame:
    """The words of all texts with their forms; words of at least seven letters only (three pairs have to exist)."""
    if least_length < 4:
        raise ValueError("words need three pairs of letters")
    words = materialize(vocabulary(occurrences(docs, doc_id, text, least_length, noise), least_length, least_times))
    return variants(words, ratio)


def op12(spark, sf_dir: str) -> DataFrame:
    return spellings(table(spark, sf_dir, "documents").select("doc_id", "text"), noise=NOISE)


SQL = r"""
WITH run AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS r FROM documents
), lower_run AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM run
), counted AS (
  SELECT d || ':' || r AS k, r, count(*) AS times FROM lower_run GROUP BY ALL
), summed AS (
  SELECT r, times, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(k)), '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) AS h
  FROM counted
), spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN r[:(h % length(r))::BIGINT] || r[(h % length(r))::BIGINT + 2:] ELSE r END AS word, times FROM summed
), w AS (
  SELECT word, sum(times)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), hole AS (
  SELECT word, n, i, word[:i] || word[i + 2:] AS left_over FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)
), pair AS (
  SELECT DISTINCT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM hole a JOIN hole b USING (i, left_over) WHERE a.word <> b.word
  UNION
  SELECT w.word, w.n, h.word, h.n FROM hole h JOIN w ON w.word = h.left_over
  UNION
  SELECT h.word, h.n, w.word, w.n FROM hole h JOIN w ON w.word = h.left_over
), best AS (
  SELECT a AS word, count(*)::BIGINT AS n_near, max(b_n) AS m, any_value(a_n) AS a_n FROM pair GROUP BY a
), formed AS (
  SELECT x.word, x.n_near, CASE WHEN x.m >= 10 * x.a_n THEN x.m END AS form_n, CASE WHEN x.m >= 10 * x.a_n THEN min(p.b) END AS form
  FROM best x JOIN pair p ON p.a = x.word AND p.b_n = x.m GROUP BY x.word, x.n_near, x.m, x.a_n
), found AS (
  SELECT w.word, w.n, f.form, coalesce(f.n_near, 0) AS n_near, f.form_n FROM w LEFT JOIN formed f USING (word)
), f1 AS (SELECT a.*, coalesce(a.form, a.word) AS r0 FROM found a
), f2 AS (SELECT a.*, coalesce(b.form, b.word) AS r1 FROM f1 a JOIN found b ON b.word = a.r0
), f3 AS (SELECT a.*, coalesce(b.form, b.word) AS r2 FROM f2 a JOIN found b ON b.word = a.r1
), f4 AS (SELECT a.*, coalesce(b.form, b.word) AS r3 FROM f3 a JOIN found b ON b.word = a.r2
), f5 AS (SELECT a.*, coalesce(b.form, b.word) AS r4 FROM f4 a JOIN found b ON b.word = a.r3
), f6 AS (SELECT a.*, coalesce(b.form, b.word) AS r5 FROM f5 a JOIN found b ON b.word = a.r4)
SELECT word, form, r5 AS root, n, n_near, form_n FROM f6
"""
