"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Equal blocks are brought next to each other by a sort
and get one integer name; then adjacent names are paired and the pairs are named in the same way, level by
level, until each document has one name. No hash stands for a text, so two documents have the same name if
and only if they have the same bytes.

Only the first level moves texts, twice: once dealt out by (block, salt), which spreads the copies of a hot
block over many groups, and once with one block for each of these groups. Later levels move integers. The number
of salts grows as the root of the number of rows, so that neither the rows of a group nor the groups of a block
are more than some roots, however many copies of a text there are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import join_counted, materialize, pin_splits, rest_of, small_or_not, text_bytes

BLOCK_BYTES = 16_384
#: Salts that a table of any size has at least.
SALTS = 32
_HEX = 16


def salts_for(rows: int) -> int:
    return max(SALTS, math.isqrt(rows) // 4)


def _named(rows: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """(name, payload) of each row of ``rows`` (keys, number, payload): rows with equal keys have equal names, others don't.

    A row is known by one string, the hexadecimal row number and the payload. Numbers must come out the same if a
    part of ``rows`` is made again: they are given as files are read, or read from a table. The name of a key is the least
    row number that has it, found among the rows of (key, salt) first and among one row of each salt then.
    Both branches read the same columns of the first exchange, so Spark runs it once.
    """
    packed = rows.select(*keys, F.concat(F.lpad(F.hex("number"), _HEX, "0"), F.lit(":"), "payload").alias("packed"))
    salted = packed.withColumn("salt", F.pmod(F.xxhash64("packed"), F.lit(salts)))
    local = salted.withColumn("least", F.min("packed").over(Window.partitionBy(*keys, "salt")))
    own = lambda c: F.conv(F.substring(c, 1, _HEX), 16, 10).cast("bigint")
    names = local.where(F.col("packed") == F.col("least")).select(own("least").alias("own"), F.min(own("least")).over(Window.partitionBy(*keys)).alias("name"))
    return local.select(own("least").alias("own"), F.expr(f"substring(packed, {_HEX + 2})").alias("payload")).join(names, "own").select("name", "payload")


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, salts: int | None = None) -> DataFrame:
    """(uid, id, sha, level, name) of each row of ``docs``; rows have equal texts if and only if (level, name) is equal.

    uid numbers the rows as they are read. Null texts count as empty ones; an empty text is one empty block.
    """
    pin_splits(docs.sparkSession)
    salts = salts or salts_for(docs.count())
    uid = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("bigint").alias("id"), text_bytes(text_col).alias("data"))
    cut = uid.select("uid", "id", F.sha2("data", 256).alias("sha"), F.expr(f"greatest(1, cast(ceil(length(data) / {block_bytes}) as int))").alias("n"), "data")
    cut = cut.withColumn("blocks", F.expr(f"transform(sequence(0, n - 1), i -> substring(data, i * {block_bytes} + 1, {block_bytes}))")).drop("data")
    rows = cut.select("uid", "id", "sha", "n", F.posexplode("blocks").alias("pos", "block"))
    part = lambda i, kind: F.split_part("payload", F.lit(","), F.lit(i)).cast(kind)
    first = rows.select("block", F.monotonically_increasing_id().alias("number"), F.concat_ws(",", "uid", "pos", "n", F.coalesce(F.col("id").cast("string"), F.lit("")), F.when(F.col("pos") == 0, F.col("sha")).otherwise("")).alias("payload"))
    level = materialize(_named(first, ["block"], salts).select("name", part(1, "bigint").alias("uid"), part(2, "int").alias("pos"), part(3, "int").alias("n"), F.expr("try_cast(split_part(payload, ',', 4) as bigint)").alias("id"), part(5, "string").alias("sha")), "block-names")
    heads = level.where("pos = 0").select("uid", "id", "sha", "n")
    out = level.where("n = 1").select("uid", "id", "sha", F.lit(0).alias("level"), "name")
    most = level.agg(F.max("n")).first()[0] or 1
    level, depth = level.where("n > 1").select("uid", "pos", "n", "name"), 0
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("uid", F.expr("pos div 2").cast("int").alias("pos")).agg(F.expr("(max(n) + 1) div 2").cast("int").alias("n"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = materialize(pairs.select("a", "b", F.monotonically_increasing_id().alias("number"), F.concat_ws(",", "uid", "pos", "n").alias("payload")), "pairs")
        named = _named(pairs, ["a", "b"], salts)
        level = materialize(named.select("name", part(1, "bigint").alias("uid"), part(2, "int").alias("pos"), part(3, "int").alias("n")), "pair-names")
        done = level.where("n = 1").select("uid", F.lit(depth).alias("level"), "name")
        out = out.unionByName(heads.where("n > 1").join(done, "uid").select("uid", "id", "sha", "level", "name"))
        level = level.where("n > 1")
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, salts: int | None = None) -> DataFrame:
    """(uid, doc_id, keep_id, group_size, kept, text_sha256) of each row of ``docs``.

    Of equal texts the row with the largest id stays; of repeated rows of that id, the first that is read.
    Null ids come after all others. An empty table gives no rows. Other columns aren't read.
    """
    names = materialize(block_names(docs, id_col, text_col, block_bytes, salts), "names")
    groups = names.groupBy("level", "name").agg(F.max(F.struct("id", (-F.col("uid")).alias("minus"))).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = materialize(groups.select("level", "name", F.col("best.id").alias("keep_id"), (-F.col("best.minus")).alias("keep_uid"), "size", F.col("size").alias("n")), "groups")
    joined = join_counted(names, groups, "level", "name", how="left")
    alone = F.col("size").isNull()
    return joined.select("uid", F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"), (alone | (F.col("keep_uid") == F.col("uid"))).alias("kept"), F.lower("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all columns.

    ``docs`` is read a second time, so it must be a table whose rows come in the same order each time, such
    as a Parquet folder. The numbers of the dropped rows are broadcast if there are few of them.
    """
    own = "__lg_uid"
    dropped = materialize(exact_groups(docs, id_col, text_col, block_bytes, salts).where("not kept").select(F.col("uid").alias(own)), "dropped")
    return docs.withColumn(own, F.monotonically_increasing_id()).join(small_or_not(dropped, 2_000_000), own, "left_anti").select(*rest_of(docs, own))
