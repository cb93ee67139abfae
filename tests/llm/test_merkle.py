"""Merkle logs and proofs against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftline.llm import merkle
from tests.llm.fixtures import AWKWARD, DOCS, frame, rows

SIZES = [1, 2, 15, 16, 17, 31, 32, 33, 255, 256, 257, 272, 273, 4095, 4096, 4097, 4112, 5000, 8192, 70000]


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, index):
    steps = []
    for nodes in tree[:-1]:
        first = index - index % 16
        steps.append((nodes[first:first + 16], index - first))
        index //= 16
    return steps


def postorder(n):
    """(level, index) of every node in the order in which they are completed."""
    top = merkle.height(n)
    width = [-(-n // 16**m) for m in range(top + 1)]

    def visit(level, index):
        if level:
            for child in range(16 * index, min(16 * index + 16, width[level - 1])):
                yield from visit(level - 1, child)
        yield level, index

    return visit(top, 0)


@pytest.mark.parametrize("n", SIZES)
def test_closed_form_positions(n):
    order = list(postorder(n))
    top = merkle.height(n)
    assert [merkle.position(level, i, n, top) for level, i in order] == list(range(merkle.size(n)))


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(data):
    leaf = lambda d, text: h([field(d[0]), field(d[3]), field(d[2]), field(d[4]), field(text)])
    trees = {}
    for d in data:
        trees.setdefault(d[3], []).append((d, leaf(d, d[1])))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in sources:
        trees[s].sort(key=lambda p: (p[0][0] is not None, p[0][0] or 0, p[1]))
        built[s] = levels([p[1] for p in trees[s]])
    top = levels([built[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, (d, own) in enumerate(trees[s]):
            steps = way(built[s], i) + way(top, j)
            proof = h([x for run, at in steps for k, x in enumerate(run) if k != at])
            changed = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
            node = leaf(d, lowered(d[1])) if changed else own
            for run, at in steps:
                node = h([*run[:at], node, *run[at + 1:]])
            out.append((str(d[0]), own, built[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out)


def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def many(n, sources):
    return [(i * 7919 % 100_003, f"Text {i} Ünï", "en" if i % 3 else None, None if i % sources == 0 else f"s{i % sources}", i % 50) for i in range(n)]


@pytest.mark.parametrize("data", [
    rows(60) + AWKWARD, many(300, 3), many(40, 40), many(600, 300), [(1, "Only", "en", "s", 4)], many(9000, 1), many(5000, 2),
], ids=["awkward", "three", "lone", "many-sources", "single", "two-tiers", "hot"])
def test_as_plain_trees(spark, data):
    assert got(merkle.manifest(frame(spark, data).repartition(7), tampered=tampered())) == plain(data)


def test_tampering_shows(spark):
    out = merkle.manifest(frame(spark, many(200, 3)), tampered=tampered())
    assert out.where("verified").count() == out.count() - sum(zlib.crc32(str(d[0]).encode()) % 5 == 0 for d in many(200, 3))
    assert merkle.manifest(frame(spark, many(200, 3))).where("not verified").count() == 0


def test_log_holds_every_node_once_in_postorder(spark):
    data = spark.createDataFrame([(f"t{n}", i, n, f"{n}/{i}") for n in (1, 17, 300, 4096, 4200) for i in range(n)], "tree string, index long, n long, leaf string")
    log, tiers = merkle.build_log(data)
    assert tiers == 2
    nodes = merkle.log_nodes(log).collect()
    for n in (1, 17, 300, 4096, 4200):
        own = sorted((r for r in nodes if r["tree"] == f"t{n}"), key=lambda r: r["position"])
        assert [(r["level"], r["index"]) for r in own] == list(postorder(n))
        tree = levels([f"{n}/{i}" for i in range(n)])
        assert all(r["digest"] == tree[r["level"]][r["index"]] for r in own)


def test_repeated_rows_hot_source_and_clashing_names(spark):
    data = many(50, 2) + [(9, "Same", "en", "hot", 4)] * 300 + [(None, "Same", "en", "hot", 4)] * 5
    more = frame(spark, data).selectExpr("*", *[f"'mine' AS {c}" for c in "tree key leaf other draw place part n index block root".split()])
    assert got(merkle.manifest(more, tampered=tampered())) == plain(data)
    big = frame(spark, [((1 << 60) + 1, "x", "en", "s", 1), (None, "y", "en", "s", 1)])
    assert {r["doc_id"] for r in merkle.manifest(big).collect()} == {(1 << 60) + 1, None}


def test_no_rows(spark):
    out = merkle.manifest(spark.createDataFrame([], DOCS), tampered=tampered())
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
