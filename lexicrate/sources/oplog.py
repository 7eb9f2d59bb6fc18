"""The operation log: inserts and deletes as JSON lines, and their replay.

A line is ``{"Insert": {"external_id": .., "text": .., "fields": {..}}}`` or
``{"Delete": {"external_id": ..}}``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptLog

OPERATION = (
    "Insert struct<external_id:string,text:string,fields:map<string,string>>, "
    "Delete struct<external_id:string>"
)


@dataclass(frozen=True)
class Insert:
    external_id: str | None
    text: str
    fields: dict[str, str] = field(default_factory=dict)

    def line(self) -> str:
        return json.dumps({"Insert": {"external_id": self.external_id, "text": self.text, "fields": self.fields}})


@dataclass(frozen=True)
class Delete:
    external_id: str

    def line(self) -> str:
        return json.dumps({"Delete": {"external_id": self.external_id}})


Operation = Insert | Delete


class OperationLog:
    """Appends to a log file on the driver; every append reaches the disk."""

    def __init__(self, path: str):
        self.path = path

    def append(self, operations: Iterable[Operation]) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.writelines(o.line() + "\n" for o in operations)
            f.flush()
            os.fsync(f.fileno())

    def truncate(self) -> None:
        with open(self.path, "w", encoding="utf-8") as f:
            os.fsync(f.fileno())

    def read(self) -> list[Operation]:
        """All operations; none of a missing file.

        Blank lines are skipped.  A damaged last line without its line break is
        an append that was cut off, and is left out; any other one raises.
        """
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            text = f.read()
        lines = text.split("\n")
        out: list[Operation] = []
        for i, line in enumerate(lines):
            if not line.strip():
                continue
            try:
                kind, body = next(iter(json.loads(line).items()))
                if kind == "Insert":
                    out.append(Insert(body.get("external_id"), body["text"], body.get("fields") or {}))
                elif kind == "Delete":
                    out.append(Delete(body["external_id"]))
                else:
                    raise ValueError(kind)
            except (ValueError, KeyError, AttributeError, StopIteration, TypeError) as e:
                if i == len(lines) - 1:
                    break
                raise CorruptLog(f"{self.path}, line {i + 1}: {e}") from e
        return out


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """A log as a table (seq, Insert, Delete), for logs of any size."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(
        F.monotonically_increasing_id().alias("seq"), F.from_json("value", OPERATION).alias("o")
    ).select("seq", "o.*")


def fold(operations: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a log of operations on explicit ids leaves: (inserted, deleted).

    ``operations(seq, external_id, text)``: text is null for a delete.
    ``known(external_id)``: ids the base has, deleted ones included.  The first
    insert of an unknown id counts; a delete counts if its id is known by then.
    A deleted id stays taken, so later inserts of it are ignored.
    """
    first = operations.where("text is not null").groupBy("external_id").agg(
        F.min(F.struct("seq", "text")).alias("i")
    )
    fresh = first.join(known, "external_id", "left_anti").select("external_id", "i.*")
    since = known.select("external_id", F.lit(-1).cast("long").alias("since")).unionByName(
        fresh.select("external_id", F.col("seq").alias("since"))
    )
    deletes = operations.where("text is null").select("external_id", "seq")
    gone = deletes.join(since, "external_id").where("seq > since").select("external_id").distinct()
    return fresh.join(gone, "external_id", "left_anti").select("external_id", "text"), gone
