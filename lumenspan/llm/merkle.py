"""A Merkle manifest of a table: a digest for each row, for each group of rows and for all, and a proof for each row.

A row's leaf hashes its fields, each framed by its length. The leaves of a group are numbered in
order; every ``fanout`` consecutive nodes are one run and hash into a parent, level by level,
until the group has one node, its subroot; the subroots, in the order of their groups, hash
into the root in the same way. Going down again, each level's join puts a node's siblings before the path
of its parent, so a path is carried by the parents of leaves, one for each ``fanout`` rows, and only the last
step, which shuffles nothing more, makes it for each row.

Numbers don't come from one sorted task for each group, as a group may hold a third of all rows: rows are
dealt by ranges of (group, order), numbered inside their block, and blocks are added up; only a count for each
block and group is sorted by group. A run has ``fanout`` rows at most. Levels are written to the shared folder;
the driver learns nothing but the largest group's size, which says how many levels there are.

``record`` keeps a table's manifest, its levels and all, in a folder; ``changes`` compares two of them, from the
groups' subroots down, and reads leaves of those runs alone whose digests differ.

Cases: a null field is framed as ``-``, which no value is; a null group is a group of its own, before all
others; rows with a null id come first in their group; rows that repeat an id, or are wholly equal, are
leaves of their own (in the order of their digests; equal ones in any order, as they can't be told apart);
empty and long texts are hashed whole; an empty table gives no rows and no root; other columns are left
behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 16


def framed(value: Column) -> Column:
    """``-`` if null, else the bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def _numbered(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with a group ``g``) with ``i``, their place in their group from 0, and ``n``, its size; and the table to release."""
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(common.shuffle_partitions(rows.sparkSession), "g", *order, "tie").withColumn("block", F.spark_partition_id())
    dealt = common.materialize(dealt, "merkle-dealt")
    whole = Window.partitionBy("g")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("g", "block").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.select("g", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(whole).alias("n"))
    own = F.row_number().over(Window.partitionBy("g", "block").orderBy(*order, "tie"))
    placed = dealt.withColumn("own", own).join(starts, ["g", "block"])
    return placed.withColumn("i", F.col("start") + F.col("own") - 1).drop("tie", "block", "own", "start"), dealt


def _climb(nodes: DataFrame, payload: list[str], fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels' runs from the leaves up, and the single node (g, digest) of each group.

    ``nodes``: (g, i, n, digest) and what leaves carry. A run: (g, run, n, members, digest); in a group
    that has one node left it is that node, unhashed.
    """
    levels: list[DataFrame] = []
    size = 2
    while size > 1:
        carried = [] if levels else payload
        runs = nodes.groupBy("g", F.floor(F.col("i") / fanout).alias("run"), "n").agg(F.array_sort(F.collect_list(F.struct("i", "digest", *carried))).alias("members"))
        parent = F.when(F.col("n") > 1, F.sha2(F.array_join(F.col("members.digest"), ""), 256)).otherwise(F.col("members")[0]["digest"])
        runs = common.materialize(runs.withColumn("digest", parent), f"{name}-level{len(levels)}")
        nodes = runs.select("g", F.col("run").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), "digest")
        size = nodes.agg(F.max("n")).first()[0] or 0
        levels.append(runs)
    return levels, nodes.select("g", "digest")


def _descend(runs: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of a level with their paths; ``above``: (g, i, path, ...) of the level over it."""
    rows = runs.drop("digest").join(above.withColumnRenamed("i", "run"), ["g", "run"])
    rest = [c for c in above.columns if c not in ("g", "i", "path")]
    rows = rows.select("g", "n", "path", *rest, F.col("members.digest").alias("all"), F.posexplode("members").alias("at", "m"))
    side = lambda start, length: F.array_join(F.slice("all", start, length), "")
    step = F.struct(side(F.lit(1), F.col("at")).alias("left"), side(F.col("at") + 2, F.size("all")).alias("right"))
    path = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
    return rows.select("g", F.col("m.i").alias("i"), path.alias("path"), F.col("m.digest").alias("digest"), *rest, *[F.col(f"m.{c}").alias(c) for c in carried])


def _walk_down(levels: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves with their paths, from the paths of the groups' single nodes."""
    for k in range(len(levels) - 1, 0, -1):
        above = _descend(levels[k], above, []).drop("digest")
    return _descend(levels[0], above, carried)


def manifest(table: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, path, ...) of each row of ``table``.

    ``path`` is a list of (left, right): the joined digests of a node's siblings before and after it,
    from the leaf's run up to the root's; runs of one node stand with two empty strings, as they are hashed too.
    ``carry`` gives further columns, worked out from the table's, that go with a row (names but ``id``,
    ``g``, ``i``, ``n``, ``digest``, ``path``, ``subroot``, ``root``).
    """
    carry = carry or {}
    rows = table.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group"), framed(F.col(group_col)).alias("g"), leaf(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(k) for k, c in carry.items()]
    )
    rows = common.materialize(rows, "merkle-leaves")
    placed, dealt = _numbered(rows.drop("group"), [F.col("id").asc_nulls_first(), F.col("digest")])
    levels, subroots = _climb(placed, ["id", *carry], fanout, "merkle")
    common.release(dealt)

    groups = subroots.join(rows.select("g", "group").distinct(), "g").select(F.lit("").alias("g"), F.col("g").alias("member"), "group", "digest")
    placed, dealt = _numbered(groups, [F.col("group").asc_nulls_first()])
    upper, root = _climb(placed.drop("group"), ["member"], fanout, "merkle-groups")
    common.release(dealt)
    common.release(rows)

    top = root.select("g", F.lit(0).cast("long").alias("i"), F.expr("cast(array() as array<struct<left: string, right: string>>)").alias("path"), F.col("digest").alias("root"))
    sources = _walk_down(upper, top, ["member"]).select(F.col("member").alias("g"), F.lit(0).cast("long").alias("i"), "path", F.col("digest").alias("subroot"), "root")
    found = _walk_down(levels, sources, ["id", *carry])
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", *carry)


def record(table: DataFrame, fields: Sequence[str], path: str, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT) -> None:
    """Write ``subroots`` (g, group, digest), ``runs`` (g, run, digest) and, by run, ``leaves`` (g, run, id, digest) of a table below ``path``."""
    rows = table.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), framed(F.col(group_col)).alias("g"), leaf(*[F.col(f) for f in fields]).alias("digest"))
    rows = common.materialize(rows, "merkle-leaves")
    placed, dealt = _numbered(rows.drop("group"), [F.col("id").asc_nulls_first(), F.col("digest")])
    levels, subroots = _climb(placed, ["id"], fanout, "merkle-record")
    subroots.join(rows.select("g", "group").distinct(), "g").write.mode("overwrite").parquet(f"{path}/subroots")
    levels[0].select("g", "run", "digest").write.mode("overwrite").parquet(f"{path}/runs")
    leaves = levels[0].select("g", "run", F.explode("members").alias("m")).select("g", "run", "m.id", "m.digest")
    leaves.sortWithinPartitions("g", "run").write.mode("overwrite").parquet(f"{path}/leaves")
    for done in (dealt, rows, *levels):
        common.release(done)


def changes(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(group, id, change) of the rows that differ between two recorded manifests: ``added``, ``removed`` or ``changed``.

    Groups of equal subroots are not looked into, nor, of the others, runs that are equal at the same place. A row put in
    moves all that follow it in its group, so their runs differ too; such rows are compared and found
    equal. Rows are told apart by (group, id); of rows that repeat an id each digest that one side has more often counts: as
    ``changed`` where the other side has other rows of the id that it lacks, else as added or removed.
    """
    read = lambda path, name: spark.read.parquet(f"{path}/{name}")
    sides = [read(p, "subroots").select("g", "group", F.col("digest").alias(n)) for p, n in ((old, "was"), (new, "now"))]
    groups = sides[0].join(sides[1].withColumnRenamed("group", "other"), "g", "full")
    groups = groups.where(~F.col("was").eqNullSafe(F.col("now"))).select("g", F.coalesce("group", "other").alias("group"))
    runs = [read(p, "runs").join(groups.select("g"), "g", "left_semi").select("g", "run", F.col("digest").alias(n)) for p, n in ((old, "was"), (new, "now"))]
    differ = runs[0].join(runs[1], ["g", "run"], "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("g", "run")
    sign = lambda p, n: read(p, "leaves").join(differ, ["g", "run"], "left_semi").select("g", "id", "digest", F.lit(n).alias("n"))
    left = sign(old, -1).unionByName(sign(new, 1)).groupBy("g", "id", "digest").agg(F.sum("n").alias("n")).where("n <> 0")
    found = left.groupBy("g", "id").agg(F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.when(F.col("n") < 0, -F.col("n")).otherwise(0)).alias("less"))
    change = F.when((F.col("more") > 0) & (F.col("less") > 0), "changed").when(F.col("more") > 0, "added").otherwise("removed")
    return found.join(groups, "g").select("group", "id", change.alias("change"))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


#: crc32 of a number's decimal digits, as DuckDB says it.
_CRC = "(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INTEGER, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"


def oracle_sql() -> str:
    """The manifest of ``documents``, its proofs and their check, for DuckDB."""
    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    fields = lambda text: " || ".join(frame(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    climb = lambda name, nodes: f"""{name}(k, g, i, n, digest) AS (SELECT 0, g, i, n, digest FROM {nodes}
 UNION ALL SELECT k + 1, g, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, g, n, i // {FANOUT})"""  # noqa: E731
    steps = lambda name, tree: f"""{name} AS (SELECT k, g, i, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
 FROM {tree} WHERE n > 1 WINDOW w AS (PARTITION BY k, g, i // {FANOUT} ORDER BY i))"""  # noqa: E731
    path = lambda leaves, name: f"SELECT x.id, s.k + x.k0 AS k, s.l, s.r FROM {leaves} x JOIN {name} s ON s.g = x.g AND s.i = x.i // pow({FANOUT}, s.k)::BIGINT"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('+' || source, '-') AS g, sha256({fields("text")}) AS digest, CASE WHEN {_CRC} % 5 = 0 THEN sha256({fields(lowered)}) END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{climb("tree", "leaves")},
subs AS (SELECT t.g AS member, t.digest, '' AS g, row_number() OVER (ORDER BY x.source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree t JOIN (SELECT DISTINCT g, source FROM d) x USING (g) WHERE t.n = 1),
{climb("top", "subs")},
{steps("low", "tree")}, {steps("high", "top")},
steps AS ({path("(SELECT id, g, i, 0 AS k0 FROM leaves)", "low")} UNION ALL {path("(SELECT v.id, s.g, s.i, 1000 AS k0 FROM leaves v JOIN subs s ON s.member = v.g)", "high")}),
paths AS (SELECT id, list({{'l': l, 'r': r}} ORDER BY k) AS p FROM steps GROUP BY 1),
whole AS (SELECT v.doc_id, v.digest AS leaf, s.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, coalesce(p, []) AS p, coalesce(v.tampered, v.digest) AS start FROM leaves v JOIN subs s ON s.member = v.g LEFT JOIN paths USING (id)),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda s: s.l || s.r), '')) AS proof_sha256,
 list_reduce(list_prepend({{'l': '', 'r': start}}, p), lambda a, s: {{'l': '', 'r': sha256(s.l || a.r || s.r)}}).r AS folded_root FROM whole)
SELECT *, folded_root = root AS verified FROM f"""
