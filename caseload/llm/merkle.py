"""Merkle manifest of a table by nested-interval labels (operator 13), DataFrame functions only.

Every row is a leaf; the leaves of a tree stand in order, and every ``FAN`` consecutive nodes of a level become
the hash of their digests. A node is labelled by the interval of leaf ranks it covers. A node of level l lies in
the bucket ``lo div FAN**l`` of its level, so the ancestor of a node at the next level is found by an equality
join on tree and bucket, verified by containment of the intervals; the siblings are what is left of the parent's
interval without the node's own.

Ranks come from one range partitioning and the sizes of the partitions, not from one window, and joins run
from the roots down to the last but one level, where a node stands for ``FAN`` rows: the proof of a run's
leaves above their parent is moved once for all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.llm.common import fold, lower_az, stored

FAN = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """SHA-256 over all values, each ``-`` if null and else its byte count, a colon and the value."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``lo``, the rank in its tree, and ``n``, the rows of the tree.

    The place of a row in the input is the last part of the order, so that equal rows don't share a partition.
    """
    rows, _ = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "merkle-leaves")
    by = ["tree", *order, "salt"]
    sorted_rows, _ = stored(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
        .withColumn("seq", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("seq", 33)).withColumn("at", F.col("seq").bitwiseAND((1 << 33) - 1)).drop("seq"),
        "merkle-sorted")
    tree = Window.partitionBy("tree")
    starts = (
        sorted_rows.groupBy("tree", "part").agg(F.count("*").alias("m"), F.min("at").alias("first"))
        .withColumn("before", F.coalesce(F.sum("m").over(
            tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        .withColumn("n", F.sum("m").over(tree)))
    return (
        sorted_rows.join(starts, ["tree", "part"]).withColumn("lo", F.col("before") + F.col("at") - F.col("first"))
        .drop("part", "at", "m", "first", "before"))


def _parents(nodes: DataFrame, level: int, fan: int) -> DataFrame:
    """The nodes of ``level`` over their children: tree, lo, hi, n, digest and the children in order."""
    kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", "item")))
    digests = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
    return (
        nodes.groupBy("tree", F.expr(f"lo div {fan ** level}").alias("bucket"))
        .agg(kids.alias("kids"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("digest", F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(F.sha2(digests, 256)))
        .select("tree", "lo", "hi", "n", "digest", "kids"))


def _step(kids: str, lo: str, hi: str) -> Column:
    """The digests of the children left and right of the interval ``lo, hi``."""
    def side(test: str) -> str:
        return f"array_join(transform(filter({kids}, k -> {test}), k -> k.digest), '')"

    return F.expr(f"array(named_struct('left', {side(f'k.hi <= {lo}')}, 'right', {side(f'k.lo >= {hi}')}))")


def prove(rows: DataFrame, order: list[str], fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Proofs of all leaves, and the root of every tree.

    ``rows`` has a tree (text), the columns of ``order``, a digest and an item, which is carried along. The
    first table has tree, item, digest, root and path: the digests left and right of the leaf's ancestors, from
    the lowest level to the root. The second has tree, digest and n, the number of leaves. A lone leaf is its own
    root and has no path; the last run of a level may have one node, which is hashed alone. Nulls come first in
    the order. Rows equal in it are interchangeable. An empty table gives empty tables.
    """
    ranked = _ranked(rows, order)
    leaves = ranked.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "n", "digest", "item")
    levels = [stored(_parents(leaves, 1, fan), "merkle-level")[0]]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > fan ** len(levels):
        below = levels[-1].where(F.col("n") > fan ** len(levels)).drop("kids").withColumn("item", F.lit(None).cast("int"))
        levels.append(stored(_parents(below, len(levels) + 1, fan), "merkle-level")[0])
    nothing = F.array().cast(PATH)
    whole = F.col("hi") - F.col("lo") == F.col("n")
    roots = levels[0].where(whole).select("tree", "digest", "n")
    for upper in levels[1:]:
        roots = roots.union(upper.where(whole).select("tree", "digest", "n"))
    above = levels[-1].withColumn("path", nothing).withColumn("root", F.col("digest"))
    for level in range(len(levels) - 1, 0, -1):
        bucket = F.expr(f"lo div {fan ** (level + 1)}")
        parent = above.select(
            "tree", bucket.alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"),
            F.col("kids").alias("family"), F.col("path").alias("rest"), F.col("root").alias("top"))
        node = levels[level - 1].withColumn("bucket", bucket).alias("node")
        inside = (F.col("node.tree") == F.col("p.tree")) & (F.col("node.bucket") == F.col("p.bucket")) & (
            F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to"))
        above = node.join(parent.alias("p"), inside, "left").select(
            "node.tree", "lo", "hi", "n", "digest", "kids",
            F.when(F.col("family").isNull(), nothing).otherwise(
                F.concat(_step("family", "lo", "hi"), "rest")).alias("path"),
            F.coalesce("top", "digest").alias("root"))
    proofs = above.select("tree", "n", "kids", "path", "root", F.explode("kids").alias("leaf")).select(
        "tree", "leaf.item", "leaf.digest", "root",
        F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(_step("kids", "leaf.lo", "leaf.hi"), "path")).alias("path"))
    return proofs, roots


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of ``path``."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 over all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, fields: list[str] = FIELDS, tree: str = "lang", order: str = "doc_id",
             also: dict[str, Column] | None = None, fan: int = FAN) -> DataFrame:
    """``doc_id, leaf, subroot, root, path`` of every row, and the columns of ``also``.

    The leaves of one value of ``tree`` (null is one, and the first) make a subroot, the subroots in bytewise
    order make the root. Columns hash as in ``leaf``; other columns of any name stay out. Nulls in any column
    are values; a null doc_id comes first in its tree. Rows that share a doc_id are ordered by their leaves,
    equal rows get neighbouring places and proofs of their own. An empty text is not a null one. A text is
    hashed whole inside its task whatever its length and never leaves it. An empty table gives an empty table.
    """
    made = {f"also{i}": c for i, c in enumerate((also or {}).values())}
    light = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit("")).alias("tree"),
        F.col(f"`{order}`").alias("id"), leaf([F.col(f"`{f}`") for f in fields]).alias("digest"),
        *[c.alias(name) for name, c in made.items()])
    proofs, subroots = prove(
        light.select("tree", "id", "digest", F.struct("id", *made).alias("item")), ["id", "digest"], fan)
    top, _ = prove(
        subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.struct("tree").alias("item")),
        ["name"], fan)
    tops = top.select(
        F.col("item.tree").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("rest"))
    return proofs.drop("root").join(tops, "tree").select(
        F.col("item.id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "rest").alias("path"),
        *[F.col(f"item.{m}").alias(name) for m, name in zip(made, also or {})])


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns. Rows whose doc_id's checksum 3 divides are checked with their text lower-cased.

    A null doc_id is never tampered with.
    """
    values = {f: F.col(f) for f in FIELDS}
    changed = leaf(list((values | {"text": lower_az(F.col("text"))}).values()))
    tampered = F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 3) == 0)
    shown = F.when(tampered, changed)
    rows = manifest(docs, also={"shown": shown})
    proved = folded(F.coalesce("shown", "leaf"), F.col("path"))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
        proved.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(text if f == 'text' else f) for f in FIELDS)})"


# The checksum runs over the digits of doc_id, each as its byte and then eight shifts (-1).
_SQL_CRC = """xor(4294967295, list_reduce(
    [4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""

SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf('text')} AS leaf,
        CASE WHEN {_SQL_CRC} % 3 = 0
             THEN {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS shown
    FROM documents
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n
    FROM leaves
), nodes(tree, level, pos, n, digest) AS (
    SELECT tree, 0, pos, n, leaf FROM ranked
    UNION ALL
    SELECT tree, level + 1, pos // {FAN}, any_value((n + {FAN - 1}) // {FAN}), sha256(string_agg(digest, '' ORDER BY pos))
    FROM nodes WHERE n > 1 GROUP BY tree, level, pos // {FAN}
), subroots AS (
    SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, pos, n, digest) AS (
    SELECT 0, pos, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // {FAN}, any_value((n + {FAN - 1}) // {FAN}), sha256(string_agg(digest, '' ORDER BY pos))
    FROM tops WHERE n > 1 GROUP BY level, pos // {FAN}
), runs AS (
    SELECT tree, level, pos // {FAN} AS run, list(digest ORDER BY pos) AS kids FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
    SELECT level, pos // {FAN} AS run, list(digest ORDER BY pos) AS kids FROM tops WHERE n > 1 GROUP BY ALL
), walk(tree, start, level, pos, digest, siblings) AS (
    SELECT tree, pos, 0, pos, coalesce(shown, leaf), '' FROM ranked
    UNION ALL
    SELECT w.tree, w.start, w.level + 1, w.pos // {FAN},
        sha256(array_to_string(r.kids[:w.pos % {FAN}], '') || w.digest || array_to_string(r.kids[w.pos % {FAN} + 2:], '')),
        w.siblings || array_to_string(r.kids[:w.pos % {FAN}], '') || array_to_string(r.kids[w.pos % {FAN} + 2:], '')
    FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.pos // {FAN}
), inner_end AS (
    SELECT tree, start, arg_max(digest, level) AS digest, arg_max(siblings, level) AS siblings FROM walk GROUP BY tree, start
), climb(tree, start, level, pos, digest, siblings) AS (
    SELECT i.tree, i.start, 0, s.pos, i.digest, i.siblings FROM inner_end i JOIN subroots s ON s.tree = i.tree
    UNION ALL
    SELECT w.tree, w.start, w.level + 1, w.pos // {FAN},
        sha256(array_to_string(r.kids[:w.pos % {FAN}], '') || w.digest || array_to_string(r.kids[w.pos % {FAN} + 2:], '')),
        w.siblings || array_to_string(r.kids[:w.pos % {FAN}], '') || array_to_string(r.kids[w.pos % {FAN} + 2:], '')
    FROM climb w JOIN top_runs r ON r.level = w.level AND r.run = w.pos // {FAN}
), outer_end AS (
    SELECT tree, start, arg_max(digest, level) AS digest, arg_max(siblings, level) AS siblings FROM climb GROUP BY tree, start
)
SELECT k.doc_id, k.leaf, s.digest AS subroot, t.digest AS root, sha256(o.siblings) AS proof_sha256,
    o.digest AS folded_root, o.digest = t.digest AS verified
FROM ranked k JOIN outer_end o ON o.tree = k.tree AND o.start = k.pos JOIN subroots s ON s.tree = k.tree
    JOIN tops t ON t.n = 1
"""
