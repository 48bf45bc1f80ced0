"""Quality rules (operator 8): counted rules and a hashed n-gram likelihood ratio, with DataFrame functions only.

Counts per document (columns of ``rules``): see the query contract in the
README.  ``n_repeat_words`` sorts the hashes of all windows of 8 words with
their places; equal neighbours are windows found twice or more.

The verdict is a likelihood ratio.  Every word and pair of neighbours is hashed
into ``BUCKETS`` cells, likewise the last three characters of every word (they
show junk marks on words never seen before).  Two multinomials over the cells,
of the trusted target and of the whole corpus, both counted over all their
documents, give each cell log(p_target / p_raw); a document's ratio is the mean
over its n-grams.  It is kept if that is at least ``THRESHOLD``.

Junk that says common words over and over has common n-grams only, once pairs
share cells with words.  Pairs therefore also have ``PAIR_BUCKETS`` cells of
their own, and the pairs that a document says twice or more are judged there:
their ratios log((good + 1) / (expected + 1)), expected being the raw count
times the target's share of all pairs, are added up and divided by the
document's words.  The column llr is the lesser of the two.  Copies of one clean
text raise the raw count of its pairs too, but repeat few of them inside.

The trusted
target are the documents labelled quality 1 and not toxic; without any, all
documents that pass the counted rules.

Defined cases: null or empty texts have no words, fail the rules and have ratio
0.  Repeated rows count each; a doc_id with several label rows is trusted if
any of them says so.  Null doc_ids have no label.  An empty table gives an
empty result.  Other columns are ignored (``keep`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import NULL_ID
from rosterspark.llm.decontam import without
from rosterspark.session import materialize

BUCKETS = 8192
PAIR_BUCKETS = 1 << 18  # a multiple of BUCKETS
FILTER_BITS = 1 << 24
PART_BITS = 32768  # bits of one bitmap of bitmap_construct_agg
THRESHOLD = -0.4
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with value computed once (a lambda variable), however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def _repeats(words: Column) -> Column:
    """Words in windows of 8 words that the text has twice or more.  Each word is hashed once; windows are hashes of hashes, doubling."""
    def covered(hashes):
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = bind(marked, lambda m: F.transform(
            F.filter(m, lambda x, i: ((i > 0) & (F.get(m, i - 1)["h"] == x["h"])) | ((i < F.size(m) - 1) & (F.get(m, i + 1)["h"] == x["h"]))),
            lambda x: x["i"]))
        return bind(F.array_sort(places), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda s, x: s + x))

    def windows(hashes, width, fn):
        if width == WINDOW:
            return bind(F.slice(hashes, F.lit(1), F.size(hashes) - (WINDOW - 1)), fn)
        return bind(F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + width))), lambda x: windows(x, 2 * width, fn))

    none = F.lit(0).cast("long")
    once = lambda h: F.size(F.array_distinct(h)) == F.size(h)
    return F.when(F.size(words) <= WINDOW, none).otherwise(
        bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: windows(h, 1, lambda x: F.when(once(x), none).otherwise(covered(x)))))


def _cell(kind: int, gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), gram), F.lit(BUCKETS)).cast("int")


def cells_of(word: Column) -> list[Column]:
    """The cells of a word and of its end."""
    return [_cell(1, word), _cell(3, F.right(word, F.lit(3)))]


def pair_of(word: Column, following: Column) -> Column:
    """The own cell of a pair; modulo ``BUCKETS``, the cell that it shares with words and word ends."""
    return F.pmod(F.xxhash64(F.lit(2), word, following), F.lit(PAIR_BUCKETS)).cast("int")


def _again(cells: Column) -> Column:
    """Those that occur twice or more, each time they occur."""
    return bind(F.sort_array(cells), lambda c: F.filter(c, lambda x, i: (F.get(c, i - 1) == x) | (F.get(c, i + 1) == x)))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, the words, and the counted columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    base = docs.select("doc_id", text.alias("t"), F.xxhash64(text).alias("key"))
    return base.select(
        "doc_id", "key", words_of(F.col("t")).alias("words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(good, t): whether a document is trusted, and its text.

    Only texts that may be trusted are shuffled: a filter of ``FILTER_BITS`` bits over hashes of the trusted ids (2 MB
    at most, whatever the number of labels) is broadcast, and the ids that pass it are joined with the trusted ones.
    A full filter lets more texts through and changes nothing else.
    """
    trusted = (labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("trusted_id"))
               .filter("trusted_id is not null").distinct())
    place = lambda i: F.pmod(F.xxhash64(i), F.lit(FILTER_BITS))
    bits = (trusted.select(place("trusted_id").alias("p")).select(F.floor(F.col("p") / PART_BITS).alias("part"), (F.col("p") % PART_BITS).alias("p"))
            .repartition("part").groupBy("part").agg(F.bitmap_construct_agg("p").alias("bits")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("t")).withColumn("p", place("id"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("p") % PART_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.join(F.broadcast(bits), F.floor(F.col("p") / PART_BITS) == F.col("part"), "left").select(
        "id", "t", (F.col("id").isNotNull() & F.coalesce(F.getbit(byte, (F.col("p") % 8).cast("int")) == 1, F.lit(False))).alias("maybe"))
    sent = rows.filter("maybe").join(trusted.hint("merge"), F.col("id") == F.col("trusted_id"), "left")
    return rows.filter("not maybe").select(F.lit(False).alias("good"), "t").union(sent.select(F.col("trusted_id").isNotNull(), "t"))


def gram_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, raw, good): how often the corpus and the target have each cell, pairs by their own cell after ``BUCKETS`` others."""
    rows = flagged(docs, labels).select("good", words_of(F.col("t")).alias("words"))
    both = F.arrays_zip(F.col("words").alias("w"), F.slice("words", F.lit(2), F.size("words")).alias("following"))
    # outer: the filter that an inner generator infers would split the text again
    rows = rows.select("good", F.explode_outer(both).alias("gram")).select("good", "gram.w", "gram.following").filter("w is not null")
    grams = rows.select("good", F.explode(F.array(*cells_of(F.col("w")), pair_of(F.col("w"), F.col("following")) + BUCKETS)).alias("cell"))
    return grams.groupBy("cell").agg(F.count("*").alias("raw"), F.count(F.when(F.col("good"), 1)).alias("good"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> tuple[str, str]:
    """log(p_target / p_raw) of each shared cell (add-one smoothing), and the ratio of each pair's own cell, as numbers
    joined by spaces.

    One aggregation to at most BUCKETS + PAIR_BUCKETS rows, written; pairs reach their shared cell from their own.  The
    driver gets one row for each table.
    """
    spark = docs.sparkSession
    got = materialize(gram_counts(docs, labels), "gram-cells")
    own = got.filter(F.col("cell") >= BUCKETS).select((F.col("cell") - BUCKETS).alias("cell"), "raw", "good")
    shared = (got.filter(F.col("cell") < BUCKETS).union(own.withColumn("cell", F.col("cell") % BUCKETS))
              .groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")))

    def table(cells, n, ratio):
        every = spark.range(n).join(cells, F.col("id") == F.col("cell"), "left").select(
            "id", ratio(F.coalesce("raw", F.lit(0)), F.coalesce("good", F.lit(0))).cast("string").alias("x"))
        one = every.agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("all"))
        return one.select(F.array_join(F.transform("all", lambda e: e["x"]), " ")).first()[0]

    totals = shared.agg(F.sum("raw"), F.sum("good")).first()
    if not totals[1]:
        return " ".join(["0.0"] * BUCKETS), " ".join(["0.0"] * PAIR_BUCKETS)
    a, b = totals[0] + BUCKETS, totals[1] + BUCKETS
    share = own.agg(F.sum("good") / F.sum("raw")).first()[0]
    return (table(shared, BUCKETS, lambda raw, good: F.log((good + 1) / b) - F.log((raw + 1) / a)),
            table(own, PAIR_BUCKETS, lambda raw, good: F.round(F.log((good + 1) / (raw * share + 1)), 3)))


def rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept for every row."""
    constant = lambda numbers: F.split(F.lit(numbers), " ").cast("array<double>")
    shared, own = map(constant, log_ratios(docs, labels))
    words = F.col("words")
    total = lambda grams, value: F.aggregate(grams, F.lit(0.0), lambda s, x: s + value(x))
    pairs = F.transform(words, lambda w, i: pair_of(w, F.get(words, i + 1)))
    ratio = bind(pairs, lambda p: F.least(
        bind(shared, lambda t: total(words, lambda w: sum(F.get(t, c) for c in cells_of(w))) + total(p, lambda x: F.get(t, x % BUCKETS)))
        / (3 * F.size(words)),
        total(_again(p), lambda x: F.get(own, x)) / F.size(words)))
    n_words = F.size(words).cast("long")
    d = counts(docs).select("doc_id", "key", n_words.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                            _repeats(words).alias("n_repeat_words"),
                            F.when(F.size(words) == 0, F.lit(0.0)).otherwise(ratio).alias("llr"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    # written first: a filter on the verdict would be pushed into the scan and work it out twice
    judged = materialize(rules(docs, labels, threshold).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "key", "kept"), "judged")
    return without(docs, judged.filter(~F.col("kept")))
