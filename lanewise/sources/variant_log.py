"""Board logs with whatever keys occur: actions as VARIANT, next to the flat columns of the log.

No schema is fixed or inferred for the files; a key that nobody has heard of is stored with its
action, can be asked for by its path, and is written out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.sources.board_log import ACTION, flatten

#: Members' details, which logs leave out.
DROPPED = "memberCreator"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """board_id, pos and action of documents {"actions": [...]}, newest first, a file per board.

    The board is that of the actions, or else the file; malformed files and documents without
    actions give no rows. Pages may overlap, so an action counts once, where it stands first.
    """
    docs = spark.read.option("singleVariantColumn", "doc").option("multiLine", True).json(path)
    actions = docs.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file"), F.expr("posexplode(try_variant_get(doc, '$.actions', 'array<variant>'))").alias("seq", "action"))
    rows = actions.select(F.coalesce(_get("data.board.id"), "file").alias("board_id"), (-F.col("seq")).cast("long").alias("pos"), "action", _get("id").alias("_id"))
    named = rows.filter("_id IS NOT NULL").groupBy("board_id", "_id").agg(F.max_by("action", "pos").alias("action"), F.max("pos").alias("pos"))
    return named.select("board_id", "pos", "action").unionByName(rows.filter("_id IS NULL").drop("_id"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """board_id, pos and action of JSON lines, one action with its ``pos`` each; lines that are no JSON give no rows."""
    lines = spark.read.option("singleVariantColumn", "action").json(path)
    return lines.filter("action IS NOT NULL").select(_get("data.board.id").alias("board_id"), F.try_variant_get("action", "$.pos", "bigint").alias("pos"), "action")


def _get(path: str, kind: str = "string", of: str = "action"):
    return F.try_variant_get(of, f"$.{path}", kind)


def flat(actions: DataFrame) -> DataFrame:
    """The flat log of the actions; keys that it does not know stay in ``action`` only."""
    typed = actions.select("board_id", "pos", F.from_json(F.to_json("action"), ACTION).alias("a"))
    return flatten(typed.select("board_id", "pos", "a.*"))


def write_actions(actions: DataFrame, path: str) -> None:
    """Actions as JSON lines with every key they came with, but for members' details; :func:`read_lines` reads them."""
    actions.select(F.to_json("action").alias("value")).write.text(path)


def leaves(schema: str) -> list[str]:
    """Dotted paths of the values in an object of this schema, as Spark spells those of variants; an array is one value."""
    out: list[str] = []

    def read(at: int, path: str, keep: bool) -> int:
        """Read the type that starts at ``at``; where it ends."""
        if schema.startswith("OBJECT<", at):
            at += 7
            while schema[at] != ">":
                if schema[at] == "`":
                    end = at + 1
                    while schema[end] != "`" or schema[end + 1] == "`":
                        end += 2 if schema[end] == "`" else 1
                    name, at = schema[at + 1 : end].replace("``", "`"), end + 3
                else:
                    end = schema.index(": ", at)
                    name, at = schema[at:end], end + 2
                at = read(at, f"{path}.{name}" if path else name, keep)
                at += 2 if schema[at] == "," else 0
            return at + 1
        if keep:
            out.append(path)
        if schema.startswith("ARRAY<", at):
            return read(at + 6, path, False) + 1
        depth = 0
        while at < len(schema) and (depth or schema[at] not in ",>"):
            depth += (schema[at] == "(") - (schema[at] == ")")
            at += 1
        return at

    read(0, "", True)
    return out


def attribute_counts(actions: DataFrame) -> DataFrame:
    """board_id, path and n: in how many actions of the board each key holds a value (null is one; an empty object is none).

    Actions of a board have few different schemas, so they are counted by schema first, and only these are taken apart.
    """

    @F.pandas_udf("array<string>")
    def paths(schemas):
        return schemas.map(leaves)

    shapes = actions.groupBy("board_id", F.schema_of_variant("action").alias("schema")).agg(F.count("*").alias("n"))
    found = shapes.filter("schema LIKE 'OBJECT<%'").select("board_id", F.explode(paths("schema")).alias("path"), "n")
    return found.filter(~F.col("path").rlike(DROPPED)).groupBy("board_id", "path").agg(F.sum("n").alias("n"))


def attributes(actions: DataFrame) -> DataFrame:
    """How many different keys the actions of each board have: the width of its table."""
    return attribute_counts(actions).groupBy("board_id").agg(F.count("*").alias("attributes"))
