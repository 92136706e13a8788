"""The Merkle manifest against a recursion over sorted lists."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from causeway.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, gid long, idx long, leaf string, digest string"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _tree(nodes, arity):
    """The root, and for each leaf its (left, right) siblings."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % arity : k - k % arity + arity]
            steps[i].append(("".join(run[: k % arity]), "".join(run[k % arity + 1 :])))
        nodes, at = [_h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)], [k // arity for k in at]
    return nodes[0], steps


def brute(rows, arity):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], _h(*(_field(x) for x in r[:5]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x for _, x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], arity) for g in names}
    root, over = _tree([trees[g][0] for g in names], arity)
    out = []
    for g, up in zip(names, over, strict=True):
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out += [(key, leaf, trees[g][0], root, [a for a, _ in s + up], [b for _, b in s + up]) for (key, leaf), s in zip(leaves, trees[g][1], strict=True)]
    return out


def made(seed, n):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    return [(some(None, *range(n)), some(None, "", "a", "é"), some(None, "", "de", "日本", "z", *["en"] * 9), some(None, 0, -7, 12), some(None, "", "x" * 50_000, "text", f"t{k}"), k, k, "x", "y") for k in range(n)]


@pytest.mark.parametrize("arity, span, n", [(2, 4, 61), (2, 4096, 61), (3, 9, 47), (5, 5, 130), (2, 8, 1), (2, 8, 2)])
def test_manifest_is_the_recursion(spark, arity, span, n):
    rows = made(arity * n, n)
    rows += [rows[0]] * (n // 2)  # one row as often as a third of all
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), merkle.COLUMNS, arity=arity, span=span)
    got = [(r.key, r.leaf, r.subroot, r.root, r.lefts, r.rights) for r in got.collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, brute(rows, arity)))


def test_folding_finds_what_changed(spark):
    rows = [(k, "s", f"l{k % 3}", k, f"text {k}", 0, 0, "", "") for k in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = merkle.leaf_digest(*(F.col(c) for c in merkle.COLUMNS[:-1]), F.concat("text", F.lit("!")))
    got = merkle.manifest(docs, merkle.COLUMNS, carry=F.when(F.col("doc_id") % 5 == 0, changed), span=4)
    whole = merkle.folded(F.coalesce("carried", "leaf"), F.col("lefts"), F.col("rights")) == F.col("root")
    assert {r.key for r in got.where(~whole).collect()} == set(range(0, 50, 5))


def test_query_on_awkward_rows(spark, tmp_path):
    rows = made(3, 40) + [(2**63 - 1, "s", "en", 2**63 - 1, "t", 0, 0, "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    expected = Counter((k, leaf, sub, root, _h("".join(a + b for a, b in zip(ls, rs, strict=True)))) for k, leaf, sub, root, ls, rs in brute(rows, 2))
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == expected
    # Tampered: the row has a number, and 7 divides the checksum of its id.
    bad = Counter(r[0] for r in rows if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
    assert Counter(r.doc_id for r in got if not r.verified) == bad
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op13_merkle_manifest(spark, str(tmp_path)).collect() == []
