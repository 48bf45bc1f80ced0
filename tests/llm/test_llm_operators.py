"""The llm operators against brute force, and their defined cases."""

import random
import re
from collections import Counter, defaultdict
from functools import partial
from itertools import combinations

import brute
import pytest
from pyspark.sql import functions as F

from rosterspark.llm import (
    decontam, jaccard, katz, packing, pii, quality_classifier, quality_rules, repeats, sharding, substring, suffix,
)
from rosterspark.llm.common import bucket_count, doc_rows
from rosterspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k}" for k in range(120))
EDGE = [(1, None), (2, ""), (3, "a b"), (4, LONG), (4, LONG), (None, LONG + " tail"), (5, LONG), (5, "other text with the same id"), (6, " \n\t "), (7, "x " * 3000)]


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and ids, and further columns with names that the operators use."""
    d = spark.createDataFrame(EDGE, "doc_id long, text string")
    for c in ("id", "key", "bucket", "block", "node", "length", "rank", "t", "words", "_salt", "g", "size", "label", "quality", "_id", "_key", "_pk_id", "_pk_key", "__id"):
        d = d.withColumn(c, F.lit("x"))
    return d.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_substring_dedup_equals_brute_force(spark, rows):
    assert by_id(QUERIES["op2_recompression_dedup"](spark, SF)) == brute.substring_dedup(rows)


def test_suffix_dedup_equals_brute_force(spark, rows):
    assert by_id(QUERIES["op5_suffix_dedup"](spark, SF)) == brute.suffix_dedup(rows)


def test_runs_of_one_word_and_periodic_texts(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice(["a", "b", "b b", "a b c"]) for _ in range(90))) for k in range(40)] + [(90, "z " * 200), (91, "z " * 25), (92, "ab" * 500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.drop_repeats(d).collect()}
    assert got == brute.substring_dedup(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.strip_repeats(d).collect()}
    assert got == brute.suffix_dedup(rows)


def test_jaccard_equals_brute_force(spark, rows):
    assert by_id(QUERIES["op10_jaccard_join"](spark, SF)) == brute.jaccard_components(rows)


def test_jaccard_near_copies_and_common_passage(spark):
    rnd = random.Random(5)
    base, passage, rows = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(60)], []
    for k in range(120):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 5, 7])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join([f"u{rnd.randrange(10**6)}" for _ in range(40)] + passage)) for k in range(200, 300)]
    rows += [(k, " ".join(f"s{rnd.randrange(6)}" for _ in range(rnd.randrange(0, 12)))) for k in range(300, 400)]
    assert by_id(jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.jaccard_components(rows)


def test_bands_and_segments_carry_the_pigeonhole():
    for n in range(1, 3000):
        b = jaccard.band_of(n)
        lo, hi = jaccard.band_bounds(b)
        assert lo <= n <= hi and jaccard.band_bounds(b + 1)[0] == hi + 1
        assert jaccard.segments_of(b) > jaccard.differences(n)
        assert b == 0 or 4 * lo >= 5 * jaccard.band_bounds(b - 1)[0]  # partners of a set are in its band or the one before


def test_packing_ids_and_places(spark, rows):
    from tokenizers import Tokenizer

    got = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == brute.pieces(rows, Tokenizer.from_file(packing.default_tokenizer()))
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        assert sum(n for _, n in v) <= 2048 and all(o == sum(n for _, n in sorted(v)[:k]) for k, (o, _) in enumerate(sorted(v)))
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1


def test_tokens_of_unusual_words():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok, encode = Tokenizer.from_file(path), packing._words_encoder(path)
    texts = ["It's <|endoftext|> a<|startoftext|>b", "ÀÉîß ÿþ ×÷ é  x", "日本語 Привет İstanbul ΑΣ", "don't 've 12,345.67 !!!", "\x1c\x85 a b"]
    for t, data in zip(texts, encode([t.encode() for t in texts])):
        assert list(memoryview(data).cast("I")) == tok.encode(t, add_special_tokens=False).ids


def best_possible(counts, capacity):
    """Fewest sequences, by trying every placement (tiny instances)."""
    items, best = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True), [len(list(counts.elements()))]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in sorted(set(rooms)):
            if i >= items[k]:
                r = list(rooms)
                r[r.index(i)] -= items[k]
                go(k + 1, r)
        go(k + 1, rooms + [capacity - items[k]])
    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rnd = random.Random(3)
    for _ in range(150):
        counts = Counter(rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9)))
        fixed, rest = packing.reduce_instance(counts, 20)
        used = Counter()
        for p, n in fixed:
            assert sum(p) <= 20
            used.update({x: p.count(x) * n for x in set(p)})
        used.update(rest)
        assert used == counts
        assert sum(n for _, n in fixed) + best_possible(Counter(rest), 20) == best_possible(counts, 20)
        assert sorted((x, r) for x, lo, hi, *_ in packing.plan(counts, 20) for r in range(lo, hi)) == sorted((x, r) for x, n in counts.items() for r in range(n))


def test_sharding(spark, rows):
    text, got = dict(rows), QUERIES["op4_lpt_sharding"](spark, SF).collect()
    load, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 16
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shards[text[r.doc_id]].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in shards.values())


def test_size_classes_are_dealt_like_single_groups():
    loads = [100.0, 20.0, 35.0, 0.0]
    got = sharding.deal(loads, 57, 7.0)
    after = [a + 7 * n for a, n in zip(loads, got)]
    assert sum(got) == 57 and got[0] > 0 and max(after) - min(after) <= 7


def test_katz_equals_brute_force_and_sums_to_one(spark, rows):
    want, p2, uni = brute.katz(rows)
    for r in QUERIES["op3_katz_scoring"](spark, SF).collect():
        w = want[r.doc_id]
        assert tuple(r[1:5]) == w[:4] and abs(r.base_score - w[4]) < 1e-6 and abs(r.score - w[5]) < 1e-6
    for h in (b"the", b" start", b"der"):
        assert abs(sum(p2(h, x) for x in uni) + p2(h, b"never seen") - 1) < 1e-9


def test_decontamination_tolerates_substitutions(spark):
    item = [f"b{k}" for k in range(40)]
    other = [f"c{k}" for k in range(100)]
    changed = list(item)
    for k in (9, 18, 27):
        changed[k] = "zz"
    docs = [(1, " ".join(other[:30] + changed + other[30:])), (2, " ".join(other)), (3, " ".join(other[:50] + item[5:25])), (4, " ".join(item[:9] + other)), (5, None), (6, "One, two three FOUR five six!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1))
    b = spark.createDataFrame([(7, " ".join(item)), (8, "one two three four five six"), (9, None)], "item_id long, text string")
    got = {(r.id, r.item_id): (r.doc_start, r.item_start, r.n_words, r.n_equal) for r in decontam.overlaps(d, b).collect()}
    assert got == {(1, 7): (30, 0, 40, 37), (3, 7): (50, 5, 20, 20), (6, 8): (0, 0, 6, 6)}
    kept = decontam.clean(d, b)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5] and kept.columns == d.columns


def test_decontamination_folds_case_over_unicode(spark):
    items = {1: "año niño él están señal más allá café acción índice último árbol lápiz canción razón corazón fácil difícil",
             2: "été où élève forêt hôtel garçon déjà âge château être même très après problème crème règle père mère",
             3: "Straße größer Füße Äpfel Öl über müssen können schön Grüße heiß weiß Fuß Maß süß groß Tür für"}
    other = " ".join(f"w{k}" for k in range(30))
    docs = {10 * i + k: f"{other} {t} {other}" for i, item in items.items() for k, t in enumerate((item, item.upper(), item.title(), item.lower()))} | {99: other}
    want = {(d, i) for d, t in docs.items() for i, item in items.items() if item.upper() in t.upper()}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r.id, r.item_id) for r in decontam.overlaps(d, b).collect()} == want and len(want) == 12
    assert [r.doc_id for r in decontam.clean(d, b).collect()] == [99]


def test_decontamination_seeds_every_overlap_of_short_items(spark):
    items, docs, want = {}, [], set()
    for n in range(3, 17):
        items[n] = [f"i{n}w{k}" for k in range(n)]
        least = min(13, -(-4 * n // 5))
        changes = list(combinations(range(n), n - least))
        for at in changes + random.Random(n).sample(list(combinations(range(n), n - least + 1)), min(n, 9)):
            doc = len(docs)
            docs.append((doc, " ".join([f"a{k}" for k in range(doc % 3)] + ["zz" if k in at else w for k, w in enumerate(items[n])] + [f"b{k}" for k in range(doc % 4)])))
            if n >= 5 and n - len(at) >= least:
                want.add((doc, n))
    items[17] = [f"l{k}" for k in range(17)]  # runs of 6, 3 and 6 equal words
    docs.append((len(docs), " ".join("zz" if k in (6, 10) else w for k, w in enumerate(items[17]))))
    want.add((len(docs) - 1, 17))
    docs.append((len(docs), " ".join(items[10][2:])))  # the passage cut at the text's ends
    want.add((len(docs) - 1, 10))
    docs.append((len(docs), " ".join(items[5][:4])))
    want.add((len(docs) - 1, 5))
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    assert {(r.id, r.item_id) for r in got} == want and len(got) == len(want) > 1300


def test_every_accepted_stretch_fits_a_mask():
    masks = [int(m, 2) for m in decontam.MASKS]
    todo, missed = [(0, 0, 0)], []  # words (bits), how many, score
    while todo:
        bits, n, score = todo.pop()
        equal = [c == "1" for c in f"{bits:0{n}b}"] if n else []
        if sum(equal) >= decontam.MIN_EQUAL and decontam.best_stretch(decontam.np.array(equal)) == (0, n):
            missed.append(bits)
        for bit in (1, 0) if n < 28 else ():
            more = bits << 1 | bit
            if score + (1 if bit else -4) >= 0 and not (n >= 10 and any(more & m == m for m in masks)):
                todo.append((more, n + 1, score + (1 if bit else -4)))
    assert not missed


def test_pii_surrogates(spark):
    rows = [(1, "Mail Anna.Be@x.example.com or ANNA.BE@X.EXAMPLE.COM; call +1 (017) 555-7713 or +1 017 555 7713."),
            (3, "Mrs. Smith met Mr. John Smith; Smith and John. Card 4111 1111 1111 1111, 4111111111111111 ip 10.0.0.1. v2.0"),
            (4, "clean text, version 3. 1999")]
    got = {r.doc_id: r.text for r in pii.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = re.findall(r"\S+@[\w.]+\w", got[1])
    assert a.lower() == b.lower() != "anna.be@x.example.com" and b == b.upper()
    x, y = re.findall(r"\+1 [\d() -]+\d", got[1])
    assert re.sub(r"\D", "", x) == re.sub(r"\D", "", y) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x) and "7713" not in got[1]
    assert "Smith" not in got[3] and "John" not in got[3] and "10.0.0.1." not in got[3] and "v2.0" in got[3]
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", got[3])
    assert len({c.replace(" ", "") for c in cards}) == 1 and got[4] == rows[2][1]


def test_pii_secrets_of_any_length(spark):
    rng = random.Random(5)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    word = "abcdefghijkLMNOPQRSTUVWXYZ0123456789"
    keys = [draw("0123456789abcdef", n) for n in (32, 128, 129, 200, 513, 5000)]
    keys += [p + "-".join(draw(word, n) for n in part) for p in ("sk-", "xoxb-") for part in ((24,), (64,), (65,), (30, 30, 30), (40, 200), (5000,))]
    keys += ["sk-" + "_".join(draw(word, 40) for _ in range(4))]
    texts = [(k, f"key {x}, twice: {x}.") for k, x in enumerate(keys)]
    for r in pii.replace(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        old, new = keys[r.doc_id], re.fullmatch(r"key (\S+), twice: (\S+)\.", r.text).groups()
        assert new[0] == new[1] and len(new[0]) == len(old)
        parts = re.split("[-_]", old)
        assert not set(parts) - {"sk", "xoxb"} & set(re.split("[-_]", new[0])), r.doc_id


def test_pii_names_of_any_form(spark):
    rows = {1: ("Dr. Anna Maria Schmidt called. Schmidt left.", ["Anna", "Maria", "Schmidt"]), 2: ("Mr Jean-Luc Picard and Luc", ["Jean", "Luc", "Picard"]),
            3: ("Mr J. Smith met Prof. J.R.R. Tolkien, Mr J.-P. Sartre", ["J.", "Smith", "J.R.R.", "Tolkien", "J.-P.", "Sartre"]),
            4: ("Mr J Smith, Frau Müller-Lüdenscheidt", ["Smith", "Müller", "Lüdenscheidt"]), 5: ("Ms O'Brien's car; O'Brien", ["O'Brien"]),
            6: ("Prof. " + " ".join(f"{c}{d}ame" for c in "ABCDEFGHIJ" for d in "abc") + " spoke", [f"{c}{d}ame" for c in "ABCDEFGHIJ" for d in "abc"]),
            7: ("Mrs M.Curie. The end, J, m. x", ["M.", "Curie"]), 8: ("Dr " + "Abc Def " * 3000 + "Ghi", ["Abc", "Def", "Ghi"])}
    d = spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id long, text string")
    named = defaultdict(set)
    for r in pii.entities(d).collect():
        named[r.doc_id].add(r.mention)
    got = {r.doc_id: r.text for r in pii.replace(d).collect()}
    for k, (text, names) in rows.items():
        assert named[k] == set(names), k
        left = re.findall(r"[\w.'-]+", got[k])
        assert not any(n in w.split("-") or n == w for n in names for w in left), got[k][:200]
        assert len(got[k].split()) == len(text.split())
    assert got[4].startswith("Mr J ") and got[5].count("'s car; ") == 1 and got[7].endswith(" The end, J, m. x") and re.match(r"Mr \w+-\w+ \w+ and \w+$", got[2])
    assert re.match(r"Mr [A-Z]+\. \w+ met Prof\. [A-Z]+\.[A-Z]\.[A-Z]\. \w+, Mr [A-Z]+\.-[A-Z]\. \w+$", got[3])


def test_surrogates_stay_distinct_in_a_small_space(spark):
    names = spark.createDataFrame([("email", f"{c}@a.bc", None) for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, entity string, gender string")
    got = pii.surrogates(names).collect()
    assert len({r.surrogate for r in got}) == 26 and not {r.surrogate for r in got} & {r.entity for r in got}


def test_phone_surrogates_widen_where_a_form_is_used_up(spark):
    phones = spark.createDataFrame([("phone", f"1|{n:02d}", None) for n in range(100)], "kind string, entity string, gender string")
    got = pii.surrogates(phones).collect()
    assert len({r.surrogate for r in got}) == 100 and not {r.surrogate for r in got} & {r.entity for r in got}
    written = phones.limit(1).select(pii._as_written(F.lit("phone"), F.lit("+1 (2) 3"), F.lit("1|456")).alias("w"))
    assert written.first().w == "+1 (4) 56"


def test_quality_rule_counts(spark, rows):
    text = dict(rows)
    for r in QUERIES["op8_quality_rules"](spark, SF).collect():
        t = text[r.doc_id]
        w = re.findall("[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k:k + 8])].append(k)
        twice = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 20 or 100 * len(twice) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_quality_rules_drop_common_words_said_over_and_over(spark):
    sf = "/root/testdata/sf0.1"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = {r.doc_id: (r.quality, r.toxic or 0) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op8_quality_rules"](spark, sf).collect() if not r.base_failed]
    said = {r.doc_id: re.findall("[^\x20\x09-\x0D]+", text[r.doc_id]) for r in got}
    junk = {i for i, w in said.items() if len(w) >= 5 * len(set(w))}
    assert len(junk) >= 10 and sum(r.kept for r in got if r.doc_id in junk) <= len(junk) // 4
    assert sum(r.kept for r in got if label.get(r.doc_id, (1, 0))[0] == 0) <= 4
    assert all(r.kept for r in got if label.get(r.doc_id) == (1, 0))


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op9_compression_classifier"](spark, sf).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in got) >= 0.9 * len(got)


def test_defined_cases(spark, edge):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    n = len(EDGE)
    dropped = substring.drop_repeats(edge).select("doc_id", "n_words", "n_removed").collect()
    assert len(dropped) == n and Counter(tuple(r) for r in dropped)[(4, 120, 120)] == 2  # the null id comes first, repeated rows are one
    assert Counter(tuple(r) for r in dropped)[(None, 121, 0)] == 1
    stripped = suffix.strip_repeats(edge).select("doc_id", "n_removed").collect()
    assert len(stripped) == n and sum(r.doc_id == 4 and r.n_removed == len(LONG) for r in stripped) == 2
    for df in (katz.score_documents(edge), sharding.shard_documents(edge), quality_rules.rules(edge, labels), quality_classifier.classify(edge, labels)):
        assert df.count() == n
    assert packing.pack_documents(edge).filter("piece = 0").count() == n
    same = pii.replace(edge)
    assert same.columns == edge.columns and same.count() == n
    groups = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.components(edge).collect()}
    assert groups[1, 0] == 1 and groups[4, 116] == 4 and groups[None, 117] == 4 and groups[5, 116] == 4
    items = spark.createDataFrame([(1, "no such words in any of the texts of this table at all")], "item_id long, text string")
    for df in (quality_rules.keep(edge, labels), decontam.clean(edge, items)):
        assert df.columns == edge.columns
        df.collect()
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 7])


def test_mail_addresses_of_any_length_are_replaced(spark):
    mails = ["l" * 70 + "@example.com", "x@a.b.c.d.e.f.g.h.i.j.k.com", "a@" + "h" * 80 + ".org", "b@c." + "t" * 30, "plain@x.de"]
    d = spark.createDataFrame([(k, f"write to {m}, please") for k, m in enumerate(mails)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace(d).collect()}
    assert all(m not in got[k] and "@" in got[k] and got[k].startswith("write to ") and got[k].endswith(", please") for k, m in enumerate(mails))


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (substring.drop_repeats(none), suffix.strip_repeats(none), katz.score_documents(none), sharding.shard_documents(none), packing.pack_documents(none),
               jaccard.components(none), pii.replace(none), quality_rules.rules(none, labels), quality_classifier.classify(none, labels),
               decontam.overlaps(none, spark.createDataFrame([], "item_id long, text string"))):
        assert df.count() == 0


def test_pipeline_stages(spark, rows):
    import corpus_pipeline
    from rosterspark.session import materialize

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), "pipeline-test")
        seen[name] = (before, docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a, b = seen["quality_rules"]
    kept = {r.doc_id for r in quality_rules.rules(a, labels).collect() if r.kept}
    assert {r.doc_id for r in b.collect()} == kept
    a, b = seen["near_duplicates"]
    groups = brute.jaccard_components([(r.doc_id, r.text) for r in a.collect()])
    assert {r.doc_id for r in b.collect()} == {i for i, (n, c) in groups.items() if n == 0 or i == c}
    a, b = seen["decontamination"]
    items = [decontam.clean_words(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {r.doc_id for r in a.collect() for w in items if b" ".join(w) in b" ".join(decontam.clean_words(r.text.encode()))}
    assert not held & {r.doc_id for r in b.collect()} and a.count() - b.count() >= len(held)
    a, b = seen["pii"]
    assert a.columns == b.columns and a.count() == b.count()
    assert {r.doc_id for r in seen["packing"][1].collect()} == {r.doc_id for r in b.collect()}


@pytest.mark.parametrize("parse, keep_first, dedup, expected", [
    (partial(substring.WordParse, substring.WINDOW, substring.ROUNDS), True, substring.drop_repeats, brute.substring_dedup),
    (partial(suffix.ByteParse, suffix.WINDOW), False, suffix.strip_repeats, brute.suffix_dedup)])
def test_repeats_send_a_block_per_bucket_and_group(spark, parse, keep_first, dedup, expected):
    rnd = random.Random(3)
    passages = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(45)) for _ in range(60)]
    texts = [(k, " ".join([f"own{k}", *rnd.sample(passages, 6), f"end{k}"])) for k in range(500)]
    rows = doc_rows(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))
    n = bucket_count(spark)
    for blocks in (repeats.shared_anchors(rows, parse), repeats.covered_runs(rows, parse, keep_first)):
        assert 0 < blocks.count() <= n * n < len(texts)  # not a row per bucket and document
    twice = spark.createDataFrame(texts + texts[::50], "doc_id long, text string")
    got = Counter(tuple(r) for r in dedup(twice).drop("kept", "spans").collect())
    assert got == {(i, *x): 2 if i % 50 == 0 else 1 for i, x in expected(texts).items()}
