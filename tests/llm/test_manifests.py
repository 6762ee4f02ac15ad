"""Exact duplicates, the audit of filters and the Merkle manifest against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, filter_audit, merkle

LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
#: doc_id, text, lang, source
ROWS = [
    (1, "a b c", "en", "a"), (2, "abc", "en", "a"), (2, "abc", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, " \n\t\x0b\x0c\r", "de", None), (6, LONG, "de", "b"),
    (7, LONG, "", "b"), (None, "abc", "en", "a"), (None, "abc", "en", "a"), (8, "ab c", "en", ""), (9, "a bc", "en", "z"), (10, "ABC # x", "en", "é"), (-3, "A" * 50, "en", "é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for name in ("block", "pos", "sha", "row", "__at", "n", "suspect", "part", "mask", "i", "t", "p", "g", "leaf", "tampered"):
        df = df.withColumn(name, F.lit(name))
    return df.withColumn("a.b", F.lit(1)).repartition(3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200))
def test_golomb_code_round_trip(gaps):
    x = np.array(gaps, dtype=np.uint64)
    k, unary, rest = exact_dedup.golomb_encode(x)
    assert exact_dedup.golomb_decode(len(x), k, unary, rest).tolist() == gaps


def test_golomb_code_is_short():
    gaps = np.diff(np.unique(np.random.default_rng(5).integers(0, 1 << 40, 10_000, dtype=np.uint64)), prepend=np.uint64(0))
    _, unary, rest = exact_dedup.golomb_encode(gaps)
    assert 8 * (len(unary) + len(rest)) / len(gaps) < np.log2(gaps.mean()) + 2


def _copies_by_hand(rows):
    """doc_id -> (keep_id, group_size), and the count of rows that stay, of (doc_id, text)."""
    classes = collections.defaultdict(list)
    for doc_id, text in rows:
        classes[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(
        ((doc_id, min(members)[3], len(members), hashlib.sha256(body.encode()).hexdigest()) for body, members in classes.items() for *_, doc_id in members), key=str
    ), len(classes)


@pytest.mark.parametrize("spare", [exact_dedup.SPARE_BITS, -3])
def test_copies(spark, docs, monkeypatch, spare):
    """With few bits most texts are suspected, and the bytes decide."""
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", spare)
    got = exact_dedup.copies(docs).collect()
    want, n = _copies_by_hand([r[:2] for r in ROWS])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want and sum(r.kept for r in got) == n
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == n and {r.text for r in kept.where("doc_id = 1 OR doc_id = 8").collect()} == {"a b c"}
    assert exact_dedup.copies(docs.limit(0)).count() == 0 and exact_dedup.keep_one(docs.limit(0)).count() == 0


def test_copies_of_a_large_group(spark):
    rng = random.Random(3)
    rows = [(i, "the same" if rng.random() < 0.4 else f"text {rng.randrange(900)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want, n = _copies_by_hand(rows)
    got = exact_dedup.copies(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want and sum(r.kept for r in got) == n


def _audit_by_hand(rows, labels):
    first, good, toxic = {}, collections.Counter(), collections.Counter()
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, q, t in labels:
        good[doc_id], toxic[doc_id] = max(good[doc_id], int(q == 1)), max(toxic[doc_id], int(t == 1))
    failed = []
    for doc_id, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = doc_id is not None and doc_id > first[text]
        failed.append((doc_id, lang or "", {f for f, x in fails.items() if x}))
    out = {}
    for part in {p for _, p, _ in failed}:
        own, of_filter = [x for x in failed if x[1] == part], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                earlier = [x for x in own if f in x[2]]
                left = [x for x in left if f not in x[2]]
                of_filter[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), len(earlier) - len(gone), sum(x[2] == {f} for x in own), sum(good[x[0]] for x in gone if x[0] is not None),
                    sum(toxic[x[0]] for x in gone if x[0] is not None),
                ]
        for order, step in [k[1:] for k in out if k[0] == part]:
            out[part, order, step].append(of_filter[order[step - 1]])
    return out


def test_audit(spark, docs):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (10, 1, 0)]
    of = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filter_audit.audit(filter_audit.failures(docs), of).collect()
    values = lambda r: [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
    assert {(r.part, r.filter_order, r.step): values(r) for r in got} == _audit_by_hand([r[:3] for r in ROWS], labels)
    assert len(got) == 600 * len({r.part for r in got}) and filter_audit.audit(filter_audit.failures(docs.limit(0)), of).count() == 0


def test_intervals_cover_every_order_once():
    orders = list(itertools.permutations(range(5)))
    covered = collections.defaultdict(list)
    for mask, step, f, low, high in filter_audit.intervals():
        for rank in range(low, high):
            covered[mask, rank].append((step, f))
    for mask, rank in itertools.product(range(1, 32), range(120)):
        place = next(i for i, f in enumerate(orders[rank]) if mask >> f & 1)
        assert covered[mask, rank] == [(place + 1, orders[rank][place])]


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _climb(nodes):
    """Levels up to the one of a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(levels[-1][a : a + 16]) for a in range(0, len(levels[-1]), 16)])
    return levels


def _manifest_by_hand(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, text, lang, source, n_chars)."""
    trees = collections.defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        hashed = lambda t, row=(doc_id, source, lang, n): _h([_coded(v) for v in (*row, t)])
        other = text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        trees[source].append((doc_id is not None, doc_id or 0, hashed(text), hashed(lower) if other else None))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: _climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    top = _climb([levels[s][-1][0] for s in names])
    out = []
    for t, s in enumerate(names):
        for i, (known, doc_id, leaf, other) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            node, proof = other or leaf, ""
            for tree, at in ((levels[s], i), (top, t)):
                for level in tree[:-1]:
                    run = level[at - at % 16 :][: 16]
                    before, after = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    node, proof, at = _h([before, node, after]), proof + before + after, at // 16
            out.append((doc_id if known else None, leaf, levels[s][-1][0], top[-1][0], _h([proof]), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_edges(spark, docs):
    got = merkle.verified(docs, merkle.lower_cased()).collect()
    assert sorted(map(tuple, got), key=str) == _manifest_by_hand([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in ROWS])
    assert merkle.verified(docs.limit(0), merkle.lower_cased()).count() == 0 and merkle.manifest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block_levels", [0, 1, 3])
def test_manifest_in_many_rounds(spark, block_levels):
    """Blocks of one row make three rounds inside the largest source and two over the sources, all with partial groups."""
    sizes = {"s0": 290, "s1": 17, "s2": 16, "s3": 33, **{f"t{i}": 1 + i % 3 for i in range(15)}}
    rows = [(i, f"Text {i}", "en", s, i) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [(5, "twice", "en", "s0", 1)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = merkle.verified(df, merkle.lower_cased(), block_levels).collect()
    assert sorted(map(tuple, got), key=str) == _manifest_by_hand(rows)
    assert 0 < sum(not r.verified for r in got) < len(rows) / 3


def test_manifest_proofs_lead_to_the_root(spark, docs):
    for r in merkle.manifest(docs).collect():
        node = r.leaf
        for step in r.proof:
            node = _h([step.before, node, step.after])
        assert node == r.root
