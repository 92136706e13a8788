"""Operator 13, Merkle dataset manifest: event-driven combination, frontiers, and proofs along reverse links.

1. Leaves.  A row's leaf is the digest of its columns (Spark's own functions).  Leaves are ranged by
   (group, order), and a leaf's index in its group is a prefix sum of the ranges' sizes, so a
   group of any share of the rows is spread over tasks.
2. Combination.  A node that arrives in a task is an event: its partial parent takes the
   digest under the child's index, and as soon as it has as many children as its place in a group of
   that size means, it is emitted and becomes an event itself.  Tasks read sorted runs, so few partial
   parents are open at a time.  What a task can't complete, the frontier, is reshuffled by the aligned span
   it belongs to.  A round raises all nodes by one span (4,096 leaves at most), and the rounds grow with the
   logarithm of the largest group.  The groups' roots become the leaves of one more tree.
3. Proofs.  The nodes at the spans' borders keep their links to the nodes they came from.  From the root down,
   a span's nodes get the steps of their span's root with their own before them; a task holds one span.

Nothing but counts reaches the driver, and no group, proof or level is held whole in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import discard, table, written

#: Leaves of a span at most.
SPAN = 4096
_NODE = "gid long, size long, level int, idx long, digest string"


def field(value: Column) -> Column:
    """`-` for null, else byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def width(size: int, level: int, arity: int) -> int:
    """Nodes of a level of a tree with ``size`` leaves; levels above the root have one."""
    for _ in range(level):
        if size <= 1:
            break
        size = -(-size // arity)
    return size


def depth_of(arity: int, span: int = SPAN) -> int:
    """Levels of a span."""
    depth = 1
    while arity ** (depth + 1) <= span:
        depth += 1
    return depth


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with gid (ascending with ``group``, null first), size of the group and idx in it.

    Rows are written once in ranged order; equal rows of any number are split by a number of their own.
    """
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    numbered = rows.withColumn("tie", F.monotonically_increasing_id())
    keys.append(F.col("tie"))
    ranged = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("run", F.shiftright("at", 33)), "ranged")
    runs = ranged.groupBy("run", F.col(group).alias("of")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("of")
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", "of", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("size"), F.min("first").over(whole).alias("gid"))
    runs = written(runs.withColumnRenamed("run", "r"), "runs")
    out = ranged.join(runs, (F.col("run") == F.col("r")) & F.col(group).eqNullSafe(F.col("of")))
    return out.withColumn("idx", F.col("before") + F.col("at") - F.col("first")).drop("at", "run", "r", "of", "first", "before")


def _combined(nodes: DataFrame, top: int, arity: int) -> DataFrame:
    """Nodes of level ``top`` (or the root, if lower), and the frontier of those that lack siblings here."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[int, int, int], dict[int, str]] = {}
        sizes: dict[int, int] = {}
        widths: dict[tuple[int, int], int] = {}
        for batch in batches:
            done = []
            for gid, size, level, idx, digest in zip(*(batch[c].to_pylist() for c in ("gid", "size", "level", "idx", "digest")), strict=True):
                sizes[gid] = size
                while True:
                    if (n := widths.get((size, level))) is None:
                        n = widths[size, level] = width(size, level, arity)
                    if level == top or n == 1:
                        done.append((gid, size, level, idx, digest))
                        break
                    parent = idx // arity
                    children = open_.setdefault((gid, level, parent), {})
                    children[idx] = digest
                    if len(children) < min(arity, n - parent * arity):
                        break
                    del open_[gid, level, parent]
                    digest = sha256("".join(children[k] for k in sorted(children)).encode()).hexdigest()
                    level, idx = level + 1, parent
            yield _nodes(done)
        yield _nodes([(gid, sizes[gid], level, idx, digest) for (gid, level, _), children in open_.items() for idx, digest in children.items()])

    return nodes.mapInArrow(combine, _NODE)


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gid", "size", "level", "idx", "digest"])


def raised(nodes: DataFrame, level: int, arity: int, depth: int) -> DataFrame:
    """The nodes ``depth`` levels higher: what runs complete at once, and the frontier after a shuffle by span."""
    top = level + depth
    met = written(_combined(nodes.select("gid", "size", F.lit(level).alias("level"), "idx", "digest").sortWithinPartitions("gid", "idx"), top, arity), "met")
    # Done: at the top, or the only node of its level, which no other has beside it.
    over = (F.col("level") == top) | ((F.col("idx") == 0) & _is_root("size", "level", arity, level, top))
    span = F.expr("case level " + " ".join(f"when {k} then idx div {arity ** (top - k)}L" for k in range(level, top + 1)) + " end")
    frontier = met.where(~over).withColumn("span", span).repartition("gid", "span").sortWithinPartitions("gid", "span", "level", "idx")
    return written(met.where(over).unionByName(_combined(frontier.drop("span"), top, arity)).select("gid", "size", "idx", "digest"), "nodes")


def _is_root(size: str, level: str, arity: int, low: int, top: int) -> Column:
    """Whether a group of this size has one node on this level: arity ** level >= size, in whole numbers."""
    out = F.lit(False)
    for k in range(low, top + 1):
        out = out | ((F.col(level) == k) & (F.col(size).cast("decimal(38,0)") <= F.lit(min(arity**k, 10**37)).cast("decimal(38,0)")))
    return out


def tree(leaves: DataFrame, arity: int, depth: int) -> list[tuple[int, DataFrame]]:
    """(level, nodes) from the leaves (gid, size, idx, digest, any more) to each group's root."""
    largest = leaves.agg(F.max("size")).first()[0] or 0
    out, level = [(0, leaves)], 0
    while width(largest, level, arity) > 1:
        out.append((level + depth, raised(out[-1][1], level, arity, depth)))
        level += depth
    return out


def proofs(levels: list[tuple[int, DataFrame]], roots: DataFrame, arity: int, depth: int, keep: str) -> DataFrame:
    """``keep`` (columns of the leaves), subroot, root, lefts and rights of every leaf.

    ``roots`` has gid, subroot, root, and the steps above the group's root.
    """
    above = roots.withColumn("idx", F.lit(0).cast("long"))
    for level, nodes in reversed(levels[:-1]):
        more = keep if level == 0 else ""
        names = [c.split()[0] for c in more.split(", ") if c]
        schema = "gid long, idx long, subroot string, root string, lefts array<string>, rights array<string>" + (", " + more if more else "")
        spans = nodes.select("gid", "size", "idx", "digest", *(c for c in names if c != "digest")).withColumn("span", F.expr(f"idx div {arity**depth}L"))
        spans = spans.groupBy("gid", "span").cogroup(above.withColumnRenamed("idx", "span").groupBy("gid", "span"))
        above = spans.applyInArrow(_linked(level, arity, depth, names), schema)
    return above if len(levels) > 1 else levels[0][1].drop("idx").join(above.drop("idx"), "gid")


def _linked(level: int, arity: int, depth: int, names: list[str]):
    def link(nodes: pa.Table, span: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        size, first, digests = nodes["size"][0].as_py(), nodes["idx"][0].as_py(), nodes["digest"].to_pylist()
        top = {c: span[c][0].as_py() for c in ("subroot", "root", "lefts", "rights")}
        lefts, rights = [[] for _ in digests], [[] for _ in digests]
        now, scale = digests, 1
        for l in range(level, level + depth):
            if width(size, l, arity) == 1:
                break
            parents = []
            for p in range(0, len(now), arity):
                run = now[p : p + arity]
                for k in range(len(run)):
                    a, b = "".join(run[:k]), "".join(run[k + 1 :])
                    for i in range((p + k) * scale, min((p + k + 1) * scale, len(digests))):
                        lefts[i].append(a)
                        rights[i].append(b)
                parents.append(sha256("".join(run).encode()).hexdigest())
            now, scale = parents, scale * arity
        n = len(digests)
        columns = {
            "gid": nodes["gid"],
            "idx": pa.array(range(first, first + n), pa.int64()),
            "subroot": pa.array([top["subroot"]] * n, pa.string()),
            "root": pa.array([top["root"]] * n, pa.string()),
            "lefts": pa.array([x + top["lefts"] for x in lefts], pa.list_(pa.string())),
            "rights": pa.array([x + top["rights"] for x in rights], pa.list_(pa.string())),
        }
        return pa.table(columns | {c: nodes[c] for c in names})

    return link


def manifest(docs: DataFrame, columns: list[str], group: str = "lang", order: str = "doc_id", arity: int = 2, carry: Column | None = None, span: int = SPAN) -> DataFrame:
    """A row per row of ``docs``: key (its order), leaf, subroot, root, lefts, rights and carried.

    A leaf is the digest of ``columns``; a node that of its children's hex digests; leaves ascend by
    ``order`` in each group, whose roots, ordered by ``group``, are the leaves of the tree above.
    ``lefts`` and ``rights`` hold for each step up what stands left and right of the path; fold with
    ``folded``.  ``carry`` is a string of the row that is handed through.

    Nulls of any column are ``-``; null groups and null orders come first; rows of equal order
    stand by their leaf; equal rows are leaves of their own; an empty text is ``0:`` and a long one hashed whole; other
    columns aren't read; an empty table gives no rows.
    """
    depth = depth_of(arity, span)
    spark = docs.sparkSession
    rows = docs.select(F.col(group).alias("g"), F.col(order).cast("long").alias("key"), leaf_digest(*(docs[c] for c in columns)).alias("digest"), (F.lit(None).cast("string") if carry is None else carry).alias("carried"))
    leaves = placed(written(rows, "leaves"), "g", ["key", "digest"])
    levels = tree(leaves, arity, depth)
    subroots = levels[-1][1].select(F.col("gid").alias("under"), "digest")
    upper = tree(placed(subroots.withColumn("g", F.lit(0)), "g", ["under"]), arity, depth)
    root = upper[-1][1].select("gid", F.col("digest").alias("root"))
    none = F.array().cast("array<string>")
    roots = root.select("gid", F.col("root").alias("subroot"), "root", none.alias("lefts"), none.alias("rights"))
    over = proofs(upper, roots, arity, depth, "under long, digest string")
    over = written(over.select(F.col("under").alias("gid"), F.col("digest").alias("subroot"), "root", "lefts", "rights"), "roots")
    out = proofs(levels, over, arity, depth, "key long, digest string, carried string")
    return out.select("key", F.col("digest").alias("leaf"), "subroot", "root", "lefts", "rights", "carried")


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.arrays_zip(lefts.alias("l"), rights.alias("r")), leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of the whole ``documents``, checked against rows of which some are tampered with."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    values = [F.col("n_chars").cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    out = manifest(docs, COLUMNS, carry=F.when(touched, leaf_digest(*values)))
    siblings = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    out = out.withColumn("folded_root", folded(F.coalesce("carried", "leaf"), F.col("lefts"), F.col("rights")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256({})"
_CRC = """list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: [cast(ascii(ch) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda c, b: case when b >= 0 then xor(c, b) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"""
OP13_SQL = f"""
with recursive leaves as (
 select doc_id, lang, {_LEAF.format(' || '.join(_FIELD.format(c) for c in COLUMNS))} as leaf,
  case when xor({_CRC}, 4294967295) % 7 = 0 then {_LEAF.format(' || '.join(_FIELD.format('(n_chars + 1)' if c == 'n_chars' else c) for c in COLUMNS))} end as touched
 from documents
), placed as (
 select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaves
), nodes(lang, level, i, n, h) as (
 select lang, 0, i, n, leaf from placed
 union all
 select lang, level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by lang, level, i // 2
), subroots as (
 select lang, level as height, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from nodes where n = 1
), upper(level, i, n, h) as (
 select 0, i, n, subroot from subroots
 union all
 select level + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by i)) from upper where n > 1 group by level, i // 2
), steps as (
 select p.lang, p.i, o.level, case when s.h is null then '.' when s.i < o.i then 'l' || s.h else 'r' || s.h end as step
 from placed p join nodes o on o.lang is not distinct from p.lang and o.n > 1 and o.i = p.i >> o.level
  left join nodes s on s.lang is not distinct from p.lang and s.level = o.level and s.i = xor(o.i, 1)
 union all
 select p.lang, p.i, 1000 + o.level, case when s.h is null then '.' when s.i < o.i then 'l' || s.h else 'r' || s.h end
 from placed p join subroots r on r.lang is not distinct from p.lang join upper o on o.n > 1 and o.i = r.i >> o.level
  left join upper s on s.level = o.level and s.i = xor(o.i, 1)
), paths as (
 select lang, i, list(step order by level) as path from steps group by lang, i
), found as (
 select p.doc_id, p.leaf, r.subroot, (select h from upper where n = 1) as root, coalesce(t.path, []) as path,
  list_reduce(list_prepend(coalesce(p.touched, p.leaf), coalesce(t.path, [])), lambda h, s: sha256(case s[1] when 'l' then s[2:] || h when 'r' then h || s[2:] else h end)) as folded_root
 from placed p join subroots r on r.lang is not distinct from p.lang left join paths t on t.lang is not distinct from p.lang and t.i = p.i
)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(path, lambda s: s != '.'), lambda s: s[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified
from found
"""
