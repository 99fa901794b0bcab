import re

import pyarrow as pa
import pytest

from tablekeep.llm import decontamination as d

ITEM = "If Anna walks 3 miles and then 5 miles, how many miles does Anna walk in 3 days of the long trip?"


def kinds(text):
    ((template, value, slot),) = d.templates(pa.array([text], pa.string()))
    return slot.astype(int).tolist()


def test_placeholders():
    assert kinds("The cat. Then Bob ran 5 km and 7kg, ok") == [0, 0, 0, 1, 0, 1, 1, 0, 1, 0]
    assert kinds("THE CAT RAN 1,000.50 times") == [0, 0, 0, 1, 0]
    assert kinds("") == kinds(None) == kinds(" -- !!") == []


def test_same_template_whatever_the_case_punctuation_and_slots():
    a, b = list(d.templates(pa.array(["He said Bob has 3 apples.", "he, said Eve HAS 44 apples"])))
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() != b[1].tolist()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, "short"), (3, None), (4, ""), (None, "w x y z u v")], "item_id long, text string")


CASES = [
    (1, "So. " + ITEM + " And on.", True),
    (2, "xx If Bob walks 7 miles and then 9 miles, how many miles does Bob walk in 7 days of the long trip? yy", True),
    (3, "If Bob walks 7 km and then 9 km, how many km does Eve walk in 8 days of the long trip?", False),
    (4, "how many miles does Anna walk and some other text that is clean", False),
    (5, None, False), (6, "", False), (None, ITEM, True), (7, ITEM.upper(), True), (8, "short", False), (1, "a clean row with the id of another", False),
]


def test_leaks_reparameterised_questions_and_inconsistent_slots(docs_of, bench):
    docs = docs_of([(i, t) for i, t, _ in CASES])
    rows = d.judged(docs, bench).collect()
    assert sorted(((r["doc_id"], r["contaminated"]) for r in rows), key=repr) == sorted(((i, leak) for i, _, leak in CASES), key=repr)
    assert all(r["item_ids"] == ([1] if r["contaminated"] else []) for r in rows)
    kept = d.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["text"] for r in kept.collect()), key=repr) == sorted((t for _, t, leak in CASES if not leak), key=repr)


def test_empty_tables(docs_of, bench):
    docs = docs_of([(1, ITEM)])
    assert [r["contaminated"] for r in d.judged(docs, bench.limit(0)).collect()] == [False]
    assert d.judged(docs.limit(0), bench).collect() == []
    assert d.decontaminated(docs, bench.limit(0)).count() == 1


def test_the_same_windows_match_as_in_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    found = {r["doc_id"] for r in d.judged(docs, bench).collect() if r["contaminated"]}
    items = [r["text"] for r in bench.collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    exact = {k for k, t in texts.items() if any(item in t for item in items)}
    assert exact and exact <= found
    clean = lambda t: re.findall(r"\w+", t.lower())
    grams = {tuple(w[i : i + 5]) for w in map(clean, items) for i in range(len(w) - 4)}
    sharing = {k for k, t in texts.items() for w in [clean(t)] if any(tuple(w[i : i + 5]) in grams for i in range(len(w) - 4))}
    assert found <= sharing


def test_slots_must_be_filled_consistently():
    windows = [([1], [10]), ([1], [11]), ([2], [10]), ([2], [12])]
    slots, theirs = [w[1] for w in windows], [w[0] for w in windows]
    import numpy as np

    assert d.covered_tokens(np.arange(4) * 5, np.arange(4) * 5, slots, theirs, 5) == 10


def test_number_words_are_numbers():
    assert kinds("she eats five apples and twenty-one pears") == [0, 0, 1, 0, 0, 1, 0]
    a, b = list(d.templates(pa.array(["we saw drei Hunde in 21 days", "we saw 3 Katzen in twenty-one days"])))
    assert a[1][2] == b[1][2] and a[0][2] == b[0][2]


MORE = [
    (1, "Bob has five apples and buys 7 more; how many apples does he have in three hours?"),
    (2, "What is 2 + 2?"),
    (3, "Compute 12 / 3 + 45 * 6 - 78 of 9"),
    (4, "Sum 1 2"),
    (5, "one red fox runs over the green hill while two dogs sleep under trees near some old stone house by our lake"),
    (6, "Eve has 8 apples and buys two more; how many apples does he have in 11 hours?"),
]


def pieces(text, size, step):
    words = text.split()
    cut = [words[i : i + size] for i in range(0, len(words), size)]
    return " ".join(word for piece in cut[::step] for word in piece)


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("So: Ann has six apples and buys 9 more; how many apples does he have in 4 hours?", [1, 6]),
        ("Well, what is 2 + 2? It is four.", [2]),
        ("Well, what is 2 + 3?", []),
        ("x compute 12 / 3 + 45 * 6 - 78 of 9 y", [3]),
        ("x compute 12 / 3 + 45 * 7 - 78 of 9 y", []),
        ("sum 1 2", [4]),
        (MORE[4][1], [5]),
        (pieces(MORE[4][1], 6, -1), []),
        (" ".join([MORE[4][1]] * 300), [5]),
        (" noise here".join(MORE[4][1].rsplit(" ", 3)), [5]),
        ((" filler" * 60).join([" ".join(MORE[4][1].split()[i : i + 7]) for i in range(0, 21, 7)]), []),
    ],
)
def test_order_span_short_items_and_classes(spark, docs_of, text, items):
    bench = spark.createDataFrame(MORE, "item_id long, text string")
    assert d.judged(docs_of([(1, text)]), bench).first()["item_ids"] == items


def test_large_ids_repeated_rows_and_repeated_items(spark, docs_of):
    items = [(k, f"If Anna walks {k} miles and then {k + 900} miles, how many miles does Anna walk in all of those days?") for k in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([((1 << 60) + 1, items[3][1])] * 500 + [(None, items[5][1]), (7, "clean text")])
    found = d.leaks(docs, bench)
    assert found.groupBy("id").count().orderBy("id").collect() == [(None, 200), ((1 << 60) + 1, 200)]
    judged = d.judged(docs, bench).collect()
    assert sum(r["contaminated"] for r in judged) == 501 and len(judged) == 502
    assert [r["doc_id"] for r in d.decontaminated(docs, bench).collect()] == [7]


def test_chains_are_longest():
    import itertools
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        pairs = list({(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(9))})
        chain = d.in_order(np.array([p for p, _ in pairs], int), np.array([a for _, a in pairs], int))
        grows = lambda picked: all(p < q and a < b for (p, a), (q, b) in itertools.pairwise(picked))
        longest = max(n for n in range(len(pairs) + 1) for c in itertools.combinations(sorted(pairs), n) if grows(c))
        assert len(chain) == longest and grows([pairs[k] for k in chain])


def brute(texts, items):
    """Judges every text against every item by comparing all windows, without classes, maps and joins."""
    import numpy as np

    out = {}
    cut = lambda x, w: [tuple(x[i : i + w].tolist()) for i in range(len(x) - w + 1)]
    for key, text in texts.items():
        ((t, v, s),) = d.templates(pa.array([text], pa.string()))
        for item, itext in items.items():
            ((it, iv, isl),) = d.templates(pa.array([itext], pa.string()))
            rich = [i for i in range(len(it) - 4) if (~isl[i : i + 5]).sum() >= 3]
            width = 5 if rich else min(5, len(it))
            if not rich and width < 3:
                continue
            ours, theirs = (cut(t, 5), cut(it, 5)) if rich else (cut(v, width), cut(iv, width))
            at_all = rich or range(len(theirs))
            reach = len({i + k for i in at_all for k in range(width)})
            slots = lambda values, marks, i: values[i : i + width][marks[i : i + width]].tolist() if rich else []
            hits = [(p, a) for a in at_all for p in range(len(ours)) if ours[p] == theirs[a]]
            for cell in {(p - a) // len(it) + shift for p, a in hits for shift in (-1, 0)}:
                mine = [(p, a) for p, a in hits if cell <= (p - a) // len(it) <= cell + 1]
                args = ([slots(v, s, p) for p, _ in mine], [slots(iv, isl, a) for _, a in mine])
                if d.covered_tokens(np.array([p for p, _ in mine]), np.array([a for _, a in mine]), *args, width) / reach >= 0.8:
                    out.setdefault(key, set()).add(item)
    return out


def test_equals_brute_force(spark, docs_of):
    import random

    rng = random.Random(11)
    words = [*"the a of in to man dog ran sat big".split(), "Bob", "Eve", "3", "five", "7 km", "12", "end."]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = {k: line(rng.choice([2, 3, 4, 6, 9, 14, 20])) for k in range(40)}
    texts = {}
    for k in range(150):
        item = rng.choice(list(items.values())).split()
        for _ in range(rng.randrange(4)):
            item[rng.randrange(len(item))] = rng.choice(words)
        texts[k] = f"{line(rng.randrange(30))} {' '.join(item)} {line(rng.randrange(30))}"
    expected = brute(texts, items)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {r["doc_id"]: set(r["item_ids"]) for r in d.judged(docs_of(list(texts.items())), bench).collect() if r["contaminated"]}
    assert 20 < len(expected) < 150 and found == expected
