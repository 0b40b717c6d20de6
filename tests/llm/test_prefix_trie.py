"""The trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from loglens.llm import prefix_trie, registry

TURNS = "conv_id bigint, turn bigint, role string, text string, depth bigint, a string, run int"


def brute(rows):
    """Rows of the contract from (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        gain = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not children.get(p)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], TURNS).repartition(parts)


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[0]))


def random_rows(seed, n):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        c = r.choice([*range(-12, 40), 4095, 4096, 9000, 9005, 2**53 + 1, -2**40])
        for t in range(r.randint(0, 14)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant", None, ""]), r.choice(["a", "b", None, "", "ünï", "x" * 50])))
    return rows


@pytest.mark.parametrize("seed,band", [(1, 8), (2, 2), (3, 3)])
def test_trie_equals_brute_force(spark, seed, band):
    rows = random_rows(seed, 90)
    rows += rows[:25]  # repeated rows are turns of their own
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    assert got(prefix_trie.trie(frame(spark, rows), band)) == brute(rows)


def test_turns_with_equal_numbers_and_copies(spark):
    rows = [(10, 1, "user", t) for t in ["b", "a", None, "a", "ab"] * 3] + [(11, None, None, None)] * 40 + [(c, 0, "u", "t") for c in range(20, 60)]
    assert got(prefix_trie.trie(frame(spark, rows))) == brute(rows)


def test_a_long_conversation_spreads_over_runs(spark):
    """One conversation with most of all rows: several runs, several levels of bands, the same totals."""
    rows = [(5, t, "user", f"t{t % 7}") for t in range(700)] + [(6, t, "user", f"t{t % 7}") for t in range(690)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c}") for c in range(10, 40) for t in range(3)]
    turns = frame(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be joined into one
    try:
        assert prefix_trie.ordered_turns(turns).where("conv_id = 5").select("run").distinct().count() > 1
        assert got(prefix_trie.trie(turns, 4)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_many_conversations_that_end_alike(spark):
    """A hot node: thousands of equal conversations, their ends in several runs of ids."""
    rows = [(c, 0, "user", "same") for c in range(0, 45_000, 3)]
    assert got(prefix_trie.trie(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert prefix_trie.trie(frame(spark, [])).collect() == []
    assert prefix_trie.trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
    only = got(prefix_trie.trie(frame(spark, [(7, 0, "user", "x")])))
    assert only == brute([(7, 0, "user", "x")])


def test_query_equals_brute_force_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.op12_prefix_trie(spark, sf)) == brute(rows)
