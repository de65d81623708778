"""Filter interactions and the prefix trie against brute force, odd rows and empty tables."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from figcorpus.llm import interaction, prefix_trie

# 12


def test_merges_gallop_to_the_same_union():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lists = [np.unique(rng.integers(0, 3000, rng.integers(0, rng.choice([3, 200, 2500])))) for _ in range(4)]
        sizes = interaction.union_sizes(lists)
        for subset in range(16):
            members = [set(x.tolist()) for k, x in enumerate(lists) if subset >> k & 1]
            assert sizes[subset] == len(set().union(*members))
        at = interaction.places(lists[0], lists[1])
        assert at.tolist() == np.searchsorted(lists[1], lists[0]).tolist()


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, id bigint, lists bigint, digest string, n bigint"


def audit_rows():
    rng = random.Random(2)
    long_ = " ".join(f"w{i}" for i in range(300))
    texts = ["", None, " \n\t", "short text", long_, long_ + " $", "X" * 900, "same " * 400, "# " + long_, "ÄÖ\x85Ü " * 250, "word " * 90000]
    rows = [(rng.choice([*range(40), None]), rng.choice(texts), "en", rng.choice(["a", "b", None, "", "ü"]), 0, "p", 1, 2, "d", 3) for _ in range(150)]
    labels = [(rng.choice([*range(40), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    return rows + rows[:5], labels


def audited(rows, labels):
    """Every order of the filters, applied one after the other."""
    first, parts = {}, defaultdict(list)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    for doc_id, text, _, source, *_ in rows:
        text = text or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and text in first and first[text] < doc_id,
        }
        parts[source or ""].append(({f for f, bad in fails.items() if bad}, doc_id))
    out, shapley = {}, defaultdict(int)
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            kept, name = docs, "".join(order)
            for step, f in enumerate(order, 1):
                gone = [x for x in kept if f in x[0]]
                kept = [x for x in kept if f not in x[0]]
                failing = sum(f in x[0] for x in docs)
                out[part, name, step] = (
                    len(kept), len(gone), failing - len(gone), sum(x[0] == {f} for x in docs),
                    sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone),
                )
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_audit_is_that_of_applying_the_filters(spark, block):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id bigint, quality int, toxic int, id string")
    got = interaction.audit_filters(docs, marks, block=block).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == audited(rows, labels)
    assert len(got) == 600 * 4


def test_audit_of_empty_tables(spark):
    rows, labels = audit_rows()
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert interaction.audit_filters(spark.createDataFrame([], DOCS), marks).count() == 0
    docs = spark.createDataFrame(rows, DOCS)
    got = interaction.audit_filters(docs, marks.where("false"))
    assert got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0 and got.count() == 2400


# 13


def forest(n, rng, deep):
    return np.array([-1 if i == 0 or rng.random() < 0.02 else rng.randrange(max(0, i - deep), i) for i in range(n)])


@pytest.mark.parametrize("deep", [1, 3, 1000])
def test_centroids_add_up_to_subtree_sums(deep):
    rng = random.Random(deep)
    for n in (1, 2, 7, 400):
        parent = forest(n, rng, deep)
        values = np.array([[rng.randrange(9), 1] for _ in range(n)])
        want = values.copy()
        for v in range(n - 1, -1, -1):
            if parent[v] >= 0:
                want[parent[v]] += want[v]
        # any order in which parents stand first
        depth = np.zeros(n, int)
        for v in range(n):
            depth[v] = 0 if parent[v] < 0 else depth[parent[v]] + 1
        order = np.argsort(depth, kind="stable")
        at = np.argsort(order)
        moved = np.where(parent[order] < 0, -1, at[parent[order]])
        assert (prefix_trie.local_totals(moved, want[order, 1], values[order]) == want[order]).all()


def trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((-(10**9) if turn is None else turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in sorted(built.items()):
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        ends = ",".join(str(c) for c in members[node] if len(built[c]) == len(node))
        mine = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        under = [out[k] for k in children[node]]
        out[node] = (
            members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]),
            sum(u[5] for u in under) if under else 1, mine + sum(u[6] for u in under), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


TURNS = "conv_id bigint, turn bigint, role string, text string, j string, d string, depth string, length string"


def talk():
    rng = random.Random(4)
    rows = []
    for c in [*range(60), *range(100, 108), 203, 301, -1, -7, -100, -101, None]:
        for i in range(rng.choice([1, 2, 4, 9])):
            rows.append((c, rng.choice([i, i, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "ab", "", None, "x" * 500]), "j", "d", "e", "l"))
    rows += [(777, i, "user", "again" if i % 2 else "so", "j", "d", "e", "l") for i in range(60)]
    rows += [(778, i, "user", "again" if i % 2 else "so", "j", "d", "e", "l") for i in range(55)]
    return rows + rows[:6]


@pytest.mark.parametrize("limit", [None, 7])
def test_trie_is_that_of_all_prefixes(spark, limit, monkeypatch):
    if limit == 7:
        monkeypatch.setattr(prefix_trie, "BLOCK", 5)
    rows = talk()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == trie(rows)


def test_trie_of_no_turns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_a_node_with_many_ends_hashes_pieces(spark):
    ends = spark.range(30000).select(F.lit(1).cast("bigint").alias("j"), F.lit(2).cast("bigint").alias("d"), F.col("id").alias("conv_id"))
    got = prefix_trie.end_hashes(ends).collect()
    assert [tuple(r) for r in got] == [(1, 2, hashlib.sha256(",".join(map(str, range(30000))).encode()).hexdigest())]
