import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablekeep.llm import prefixes
from tablekeep.plans import sliced

SCHEMA = "conv_id long, turn long, role string, text string, conv long, at long, block int, node long, size int, level int"


def plain(rows, rebuild=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [turn[2:] for turn in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) or 1
        saved[path] = saved.get(path, 0) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
        if path:
            up = path[:-1]
            children[up] += 1
            leaves[up], saved[up] = leaves.get(up, 0) + leaves[path], saved.get(up, 0) + saved[path]
    return sorted(
        (
            (
                min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children[path], leaves[path], saved[path],
                hashlib.sha256(",".join(str(c) for c in sorted(ids) if len(built[c]) == len(path)).encode()).hexdigest(),
            )
            for path, ids in members.items()
        ),
        key=repr,
    )


def found(spark, rows):
    turns = spark.createDataFrame([(*row, 1, 2, 3, 4, 5, 6) for row in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, prefixes.rebuilt_trie(turns).collect()), key=repr)


def talk(draw, ids, most):
    rows = []
    for c in ids:
        for turn in range(draw.randrange(most)):
            rows.append((c, turn, draw.choice(["user", "assistant", None]), draw.choice(["yes", "no", "é", None, ""])))
    return rows


@pytest.mark.parametrize("slice_bytes", [256 * 1024**2, 300])
def test_same_nodes_as_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(sliced, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(prefixes, "JOINED_BYTES", min(slice_bytes, 30))
    draw = random.Random(3)
    rows = talk(draw, range(60), 7) + talk(draw, range(100, 108), 40)
    assert found(spark, rows) == plain(rows)


def test_copies_of_conversations_and_one_very_long(spark, monkeypatch):
    monkeypatch.setattr(sliced, "SLICE_BYTES", 4000)
    rows = [(5 * c, turn, "user", f"turn {turn}") for c in range(40) for turn in range(9)]
    rows += [(1003, turn, "user", f"long {turn % 3}") for turn in range(200)]
    assert found(spark, rows) == plain(rows)


def test_nulls_ties_repeated_rows_and_turnless_conversations(spark):
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (None, 1, "user", "lost"), (-7, 2, "", "x"), (0, 5, "user", "x")]
    rows += [(c, 0, "user", "only") for c in range(11, 20)]
    assert found(spark, rows) == plain(rows)


def test_an_empty_table_has_no_nodes(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "lost")]) == []


def test_types(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hello")], "conv_id long, turn long, role string, text string")
    types = dict(prefixes.rebuilt_trie(turns).dtypes)
    assert {kind for name, kind in types.items() if name != "ends_sha256"} == {"bigint"}


def test_all_prefixes_come_from_one_rollup(spark):
    turns = spark.createDataFrame([(1, 1, 7, 3), (1, 2, 8, 1), (2, 1, 7, 3)], "conv long, at long, turn_id long, size long")
    rolled = prefixes._rolled_up(prefixes._blocks(turns), "count(*) AS n")
    assert sorted((r["depth"], r["n"]) for r in rolled.collect()) == [(0, 2), (1, 2), (2, 1)]
    assert rolled.select(F.countDistinct("node")).first()[0] == 3
