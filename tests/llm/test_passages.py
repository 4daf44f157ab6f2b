"""Substring, near-duplicate, line and benchmark operators against brute force on small tables."""

import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from .conftest import corpus
from tidebar.llm import components, decontam, lines, minhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "") if i is not None else []
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_substrings_against_brute_force(spark, docs):
    got = substring.dedupe(docs, substring.FingerprintIndex(spark, 5))
    assert "score" in got.columns
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str)
    assert found == brute_substrings(corpus())
    assert sum(r[2] for r in found) > 300


def test_substrings_batch_by_batch_are_the_same(spark, docs):
    """Runs are looked up, added and compacted; an index is opened again by its saved names."""
    index = substring.FingerprintIndex(spark, 3)
    got, bounds = [], [0, 6, 11, 13, 31, 34, 41, 100]
    for low, high in itertools.pairwise(bounds):
        batch = docs.where(F.col("doc_id").between(low, high - 1))
        earlier = docs.where(F.col("doc_id") < low)
        got += [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.dedupe_batch(batch, index, earlier).collect()]
        index = substring.FingerprintIndex.load(spark, index.save())
    assert sorted(got, key=str) == [r for r in brute_substrings(corpus()) if r[0] is not None]
    assert len(index.runs) < len(bounds) - 1 and any(level for level, _ in index.runs)


def test_passages_of_an_empty_table(spark, empty):
    assert substring.substring_report(empty).collect() == []
    assert minhash.near_duplicates(empty).collect() == []
    assert lines.line_report(empty).collect() == []
    assert minhash.drop_near_duplicates(empty).columns == empty.columns


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()


def brute_components(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    comp = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(sets, 2):
            if i is not None and j is not None and a and 100 * len(a & b) >= percent * len(a | b):
                low = min(comp[i], comp[j])
                changed |= comp[i] != low or comp[j] != low
                comp[i] = comp[j] = low
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets), key=str)


def test_near_duplicates_against_brute_force(spark, docs):
    for width in (4, 5):
        got = sorted((tuple(r) for r in minhash.near_duplicates(docs, width).collect()), key=str)
        assert got == brute_components(corpus(), width, 80)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 40").count() == 0 and kept.where("doc_id = 30").count() == 1


def test_chains_of_near_copies_are_one_component(spark):
    """Each document is near the next one only; the first and the last share little."""
    words = [f"v{i}" for i in range(140)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 80])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(docs, 4).collect()} == {0}
    assert brute_components(rows, 4, 80)[0][2] == 0


def test_many_near_copies_and_a_stranger(spark):
    base = [f"u{i}" for i in range(100)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(list(range(5, 95)) * 3)]
    docs = spark.createDataFrame([*rows, (999, " ".join(base[:50]))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 4).collect()}
    assert got[999] == 999 and {v for k, v in got.items() if k != 999} == {0}


def test_open_buckets_are_searched_between_components(spark):
    """A bucket whose members are no link of its least one: the links between the others are found, in blocks as well."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    near, far = (np.sort(rng.integers(0, 1 << 60, 50, np.uint64)) for _ in range(2))
    sign = lambda x: minhash.signature(minhash.minima(np.array([0, len(x)]), x))[0].tobytes()
    sets = [far, near, near[:45], near[5:]]
    rows = pd.DataFrame({"id": [1, 2, 3, 4], "component": [1, 2, 3, 4], "n": [len(x) for x in sets], "signature": [sign(x) for x in sets], "shingles": [x.tobytes() for x in sets], "side": 0})
    got = minhash._links_between(rows, 0.8, 80)
    assert len(got) == 2 and set(got.to_numpy().ravel()) == {2, 3, 4}
    assert len(minhash._links_between(rows.assign(component=[1, 2, 2, 2]), 0.8, 80)) == 0
    assert {tuple(sorted(r)) for r in minhash._links_between(rows.assign(side=[0, 0, 1, 1]), 0.8, 80).to_numpy()} == {(2, 3), (2, 4)}


def test_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    test_chains_of_near_copies_are_one_component(spark)


def test_an_id_with_several_texts_keeps_the_links_of_each(spark):
    say = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(7, say("x", 60)), (7, say("y", 60)), (8, say("y", 59)), (9, say("x", 59)), (10, say("z", 60)), (7, say("x", 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()))
    assert got == [(7, 7), (7, 7), (7, 7), (8, 7), (9, 7), (10, 10)]


def test_texts_of_one_id_are_one_document(spark):
    """Links of an id through any of its texts, also where none of its classes is headed by it; what is kept is what is not dropped."""
    say = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, say("x", 60)), (5, say("x", 60)), (5, say("y", 60)), (9, say("y", 59)), (5, " "), (12, say("z", 9)), (3, say("q", 20)), (3, say("r", 20)), (2, say("r", 20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, 4).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (2, 2), (3, 2), (3, 2), (5, 1), (5, 1), (5, 5), (9, 1), (12, 12)]
    left = sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs, 4).collect())
    assert left == [(1, say("x", 60)), (2, say("r", 20)), (5, " "), (12, say("z", 9))]
    assert [r[0] for r in left] == sorted(r.doc_id for r in found if r.kept)


def test_batches_without_words(spark):
    """Blank texts alone, and one more row than a batch holds, the last one empty."""
    blank = spark.createDataFrame([(1, ""), (2, " \n"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.n_shingles) for r in minhash.near_duplicates(blank).collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0)}
    many = spark.range(10_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10_000, F.concat(F.lit("word "), "id")).otherwise("").alias("text"))
    assert minhash.near_duplicates(many.repartition(1)).where("kept").count() == 10_001


def test_hot_centres_are_split(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 3)
    test_components(spark)
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    found = components.components(star.repartition(4)).collect()
    assert len(found) == 2999 and {r.component for r in found} == {0}


def test_texts_of_one_id_lose_their_own_words_only(spark):
    say = lambda a, n: [f"{a}{i}" for i in range(n)]
    rows = [(1, " ".join(say("x", 20))), (5, " ".join(say("x", 20))), (5, "a b c"), (5, " ".join(say("z", 30))), (6, " ".join(say("z", 14) + ["end"])), (5, None)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, shift string")
    found = sorted((r.doc_id, r.text or "", r.n_removed, r.kept, r.shift) for r in substring.dedupe(docs).collect())
    gone = {rows[1][1]: (20, ""), rows[4][1]: (14, "end")}
    assert found == sorted((i, t or "", *((0, t or "") if i == 1 else gone.get(t, (0, t or ""))), "mine") for i, t in rows)


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 22), (30, 30), (9, 100), (100, 5)]
    got = components.components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r.id: r.component for r in got.collect()} == {4: 3, 5: 3, 9: 3, 100: 3, 21: 20, 22: 20}


def shape_of(line):
    return tuple("\n" if re.search("[0-9]", w) else w for w in WORD.findall(line))


def brute_templates(shapes):
    """The templates of each shape by the book, as tuples; ``shapes``: all different ones."""
    out, leaves = {}, {}
    for s in shapes:
        if sum(t != "\n" for t in s) > 3:
            for tree, at in enumerate((0, len(s) // 2 - 1, len(s) - 2)):
                leaves.setdefault((tree, len(s), s[at : at + 2]), []).append(s)
    for leaf, held in leaves.items():
        n = collections.Counter((k, t) for s in held for k, t in enumerate(s) if t != "\n")
        for s in held:
            words = sum(t != "\n" for t in s)
            for step in range(1, len(held).bit_length()):
                part = tuple("\n" if t == "\n" or n[k, t] < 2**step else t for k, t in enumerate(s))
                left = sum(t != "\n" for t in part)
                if left < words and 3 * (words - left) <= words and left >= 3:
                    out.setdefault(s, set()).add((leaf, part))
    return out


def brute_lines(rows):
    every = {line for _, t in rows for line in (t or "").split("\n")}
    templates = brute_templates({shape_of(x) for x in every})

    def keys(line):
        shape, words = shape_of(line), WORD.findall(line)
        own = {("all", shape)} if set(shape) - {"\n"} else set()
        return own | templates.get(shape, set()) | ({("exact", *words)} if len(words) >= 13 else set())

    of = {line: keys(line) for line in every}
    docs = {}
    for i, t in rows:
        for line in set((t or "").split("\n")):
            for key in of[line]:
                docs.setdefault(key, set()).add(i)
    least = lambda k: 2 if k[0] == "exact" else 10
    found = {k: min(x for x in d if x is not None) for k, d in docs.items() if len(d - {None}) >= least(k)}
    out = []
    for i, t in rows:
        own = t.split("\n") if t else []
        left = [x for x in own if not any(k in found and (i is None or found[k] != i) for k in of[x])]
        out.append((i, len(own), len(own) - len(left), None if t is None else "\n".join(left)))
    return sorted(out, key=str)


def test_neighbouring_fields_of_common_names(spark):
    """Forty pairs of names, common elsewhere, amid words that are not; fields first, last and at both ends; a value in half the lines."""
    first = ["Anna", "Ben", "Carl", "Dora", "Emil"]
    last = ["Smith", "Jones", "Gray", "Hill", "Wood", "Lake", "Stone", "Field"]
    rows = []
    for i in range(40):
        a, b = first[i % 5], last[i // 5]
        rows.append((i, f"Reported by {a} {b} for the Gazette newsdesk team\n{a} {b} wrote this page for all of us\n{b} was heard here once again {a}\nThe {'old' if i % 2 else 'new'} edition is read by {a} again"))
    rows += [(100 + i, f"{first[i % 5]} own{'x' * i} {last[i % 8]}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.drop_recurring_lines(docs).collect()), key=str)
    assert found == brute_lines(rows)
    by_id = {r[0]: r[2] for r in found}
    assert by_id[0] == 0 and all(by_id[i] == 4 for i in range(1, 40)) and not any(by_id[i] for i in range(100, 160))


def test_lines_in_two_documents_take_one_shuffle(spark):
    """Two documents are told by their least and greatest id, and rows are counted in the same pass."""
    rows = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (3, 8), (3, 8), (None, 9), (4, 9), (None, 11), (None, 11)], "doc_id long, exact long")
    found = lines._firsts(rows, "exact", 2)
    assert [tuple(r) for r in found.select("exact", "rows", "first_doc").collect()] == [(8, 3, 2)]
    assert found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).count("Exchange hashpartitioning") == 1
    more = lines._firsts(rows, "exact", 1).select("exact", "rows", "first_doc")
    assert sorted(tuple(r) for r in more.collect()) == [(7, 2, 1), (8, 3, 2), (9, 2, 4)]


def test_recurring_lines_against_brute_force(spark):
    odd = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"page {i} of 12\nOwn words number {odd[i % 10]} of this page {i * 'x'}\n\nAll rights reserved by Mr {'N' * (i + 1)} of this place") for i in range(14)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, "All rights reserved by Mr Q of this place\nalone"), (3, rows[3][1])]
    # two neighbouring fields, and fields that begin a line
    rows += [(40 + i, f"Page written by {odd[i]}anna {odd[i]}berger for the Daily News\n{odd[i]}carl {odd[i]}dorn wrote this page for us today\n{odd[i] * 3} is said here once {odd[i] * 4}") for i in range(12)]
    long = " ".join(f"long{c}" for c in odd[:15])
    rows += [(60, f"{long}\n1 2 3\nkept"), (61, f"{long}\n1 2 3"), *((70 + i, "1 2 3\n4 5") for i in range(11))]
    docs = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    got = lines.drop_recurring_lines(docs)
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=str)
    assert found == brute_lines(rows)
    by_id = {r[0]: r[3] for r in found}
    assert "All rights" in by_id[0] and "page 0" in by_id[0]
    assert "All rights" not in by_id[7] and "page 7" not in by_id[7] and by_id[None] == "alone"
    assert by_id[40].startswith("Page written") and by_id[45] == ""
    assert long in by_id[60] and by_id[61] == "1 2 3" and by_id[75] == "1 2 3\n4 5"


def test_lines_in_small_slices_are_the_same(spark, docs, monkeypatch):
    from tidebar.llm import common

    monkeypatch.setattr(common.slices, "__defaults__", (64,))
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.drop_recurring_lines(docs).collect()), key=str)
    assert found == brute_lines(corpus())


def leaf_corpus():
    """Lines of a few leaves: fields at the front, amid and last, forty documents of each."""
    name = lambda i, n: "".join(chr(97 + (i * k + k) % 26) for k in range(1, n))
    rows = [(i, f"the answer of {name(i, 5)} was sent to all members of the board this week\n{name(i, 4)} {name(i, 6)} said so to the press and left the room at {i}\nthe answer is {name(i % 7, 3)} and {name(i, 7)}") for i in range(40)]
    return rows + [(100 + i, f"the answer of {name(i, 9)} {name(i + 1, 9)} {name(i + 2, 9)} {name(i, 3)}") for i in range(9)]


def line_rows(spark, monkeypatch, rows):
    """What drop_recurring_lines finds, and the rows of the tables it settles on the way by their names."""
    made, plain = [], lines.materialize

    def counted(df, tag):
        out = plain(df, tag)
        made.append((tag, out.count()))
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.drop_recurring_lines(docs).collect()), key=str), made


def test_leaves_take_no_row_for_each_word(spark, monkeypatch):
    """A line goes to its leaves as a line: none of the tables on the way has more than a row for each line and tree."""
    rows = leaf_corpus()
    found, made = line_rows(spark, monkeypatch, rows)
    assert found == brute_lines(rows) and sum(r[2] for r in found) > 80
    most = 3 * sum(len(t.split("\n")) for _, t in rows)
    assert all(n <= most for _, n in made), made


@pytest.mark.parametrize("bucket, bits", [(3, 26), (16, 6)])
def test_large_leaves_go_in_several_buckets(spark, monkeypatch, bucket, bits):
    """Leaves of more lines than a bucket, and a map of leaves so small that lines of other leaves come along."""
    rows = leaf_corpus()
    monkeypatch.setattr(lines, "BUCKET", bucket)
    monkeypatch.setattr(lines, "LEAF_BITS", bits)
    found, made = line_rows(spark, monkeypatch, rows)
    assert sum(n for tag, n in made if tag == "line-dealt") >= 40
    assert found == brute_lines(rows)


def brute_contamination(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda t: word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for item, t in items:
        w = norm(t)
        for k in range(max(len(w) - 12, 1)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, ids = norm(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    ids |= own
        out.append((i, len(w), len(hit), len(ids), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_against_brute_force(spark, docs):
    texts = dict(corpus())
    items = [("7", texts[10][30:200]), ("8", "one, TWO!"), ("9", None), ("10", "..."), ("11", "the the"), ("8", "one, TWO!"), ("12", texts[41][500:900])]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.contamination_report(docs, benchmark)
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got.collect()), key=str)
    assert found == brute_contamination(corpus(), items)
    spans = decontam.with_spans(decontam.find_contamination(docs.where("doc_id = 5"), benchmark)).first()
    assert [texts[5][s.start : s.stop] for s in spans.spans] == ["one two"]
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontam.drop_contaminated(docs, none).count() == docs.count()
    own = docs.withColumns({"n_words": F.lit("mine"), "runs": F.lit(5), "items": F.lit(6)})
    kept = decontam.drop_contaminated(own, benchmark)
    assert kept.columns == own.columns and kept.where("doc_id = 42").count() == 0
    assert {(r.n_words, r.runs, r["items"]) for r in kept.collect()} == {("mine", 5, 6)}


def test_contamination_by_random_items():
    """Few different words, so that items repeat themselves and each other, in every alignment."""
    rng = random.Random(3)
    for trial in range(300):
        say = lambda n: " ".join(rng.choice("ab" if trial % 2 else "abcd") for _ in range(n))
        items = [(str(k), say(rng.randrange(0, 40))) for k in range(4)]
        rows = [(k, say(rng.randrange(0, 60)) + " " + items[k % 4][1] + " " + say(rng.randrange(0, 9))) for k in range(6)]
        known = decontam.Items(tuple(items), 13)
        found = []
        for i, text in rows:
            n, runs, ids = decontam.scan(text, known)
            hit = sum(r["stop"] - r["start"] for r in runs)
            found.append((i, n, hit, len(ids), hit > 0 and 20 * hit >= n))
        assert found == brute_contamination(rows, items)


def test_large_benchmarks_go_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS_LIMIT", 150)
    test_contamination_against_brute_force(spark, docs)


def test_contamination_and_redaction_in_small_slices_are_the_same(spark, monkeypatch):
    from tidebar.llm import common, pii

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"see {text} end"), (2, None), (3, ""), (4, "mail me@x.org now"), (5, text), (6, "x " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", text)], "item_id string, text string")

    def both():
        runs = decontam.with_spans(decontam.find_contamination(docs, items)).orderBy("doc_id").collect()
        base = pii.find_pii(docs, weights=b"").withColumn("added", F.slice("base", 1, 0))
        return runs, pii.redact(base).orderBy("doc_id").collect()

    whole = both()
    assert whole[0][0].spans and whole[0][4].spans and whole[1][3].redacted == "mail [email] now" and whole[1][1].redacted is None
    monkeypatch.setattr(common.slices, "__defaults__", (16,))
    assert both() == whole
