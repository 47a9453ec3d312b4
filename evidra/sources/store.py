"""Frozen tables that are named by their content, and several tables published at once.

A table's digest does not depend on the order of its rows or files: the SHA-256 of each row's canonical text is cut into eight
numbers that are summed, so that it is one aggregate, merged across tasks. A frozen table lies in a folder named by its
digest and is read back only if it still has it.

A publication is a generation: all its tables are written beside each other, read again and held against what was written
and against the caller's checks; then one small file, which no second writer can create, makes it the current one. Readers
find the newest such file once and read what it names, so they see all tables of one generation or of an older one,
never a part. A writer that fails leaves a folder that no file names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """Content that is not what it was said to be, or a publication that breaks a rule."""


def canonical_row(df: DataFrame) -> Column:
    """A row as text: its columns by name in order, each behind its length, a null as a minus sign."""
    each = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for c in sorted(df.columns) for x in [_text(df, c)]]
    return F.concat(*each)


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    plain = kind in ("string", "boolean", "date") or kind.startswith(("bigint", "int", "smallint", "tinyint", "decimal"))
    return F.col(f"`{name}`").cast("string") if plain else F.to_json(F.struct(f"`{name}`"))


def digest_columns(df: DataFrame) -> list[Column]:
    """Aggregates of a multiset digest: the number of rows and eight sums of 32 bits of each row's hash."""
    h = F.sha2(canonical_row(df), 256)
    parts = [F.sum(F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")) for k in range(8)]
    return [F.count("*").alias("rows"), *[F.coalesce(p, F.lit(0)).alias(f"part{k}") for k, p in enumerate(parts)]]


def finished(values: dict[str, Column]) -> Column:
    """The digest of the aggregates' values."""
    return F.sha2(F.concat_ws("|", values["rows"].cast("string"), *[F.pmod(values[f"part{k}"], F.lit(1 << 32)).cast("string") for k in range(8)]), 256)


def digest_of(df: DataFrame) -> DataFrame:
    """(rows, digest) of all rows, as one row."""
    sums = df.agg(*digest_columns(df))
    return sums.select("rows", finished({c: F.col(c) for c in sums.columns}).alias("digest"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def freeze(df: DataFrame, root: str) -> str:
    """Write df under root in a folder of its digest, and return the digest. The same rows in any order are one frozen table."""
    spark, draft = df.sparkSession, f"{root}/draft-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    digest = digest_of(spark.read.schema(df.schema).parquet(draft)).first()["digest"]  # of what was written, not of a second run
    fs, source = _fs(spark, draft)
    target = _fs(spark, f"{root}/{digest}")[1]
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
    return digest


def replay(spark: SparkSession, root: str, digest: str, schema: str | None = None) -> DataFrame:
    """The frozen table; Refused if there is none or its rows are not those that the digest names."""
    path = f"{root}/{digest}"
    if not _exists(spark, path):
        raise Refused(f"nothing is frozen as {digest}")
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    found = digest_of(df).first()["digest"]
    if found != digest:
        raise Refused(f"rows of {digest} have the digest {found}")
    return df


def coverage(artefact: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, fault) of keys that the artefact lacks (MISSING), has beyond the expected ones (UNEXPECTED) or has twice (REPEATED)."""
    have, want = artefact.groupBy(*keys).agg(F.count("*").alias("_have")), expected.select(*keys).distinct().withColumn("_want", F.lit(1))
    fault = F.when(F.col("_have").isNull(), "MISSING").when(F.col("_want").isNull(), "UNEXPECTED").when(F.col("_have") > 1, "REPEATED")
    return have.join(want, keys, "full").withColumn("fault", fault).where("fault is not null").select(*keys, "fault")


@dataclass(frozen=True)
class Snapshot:
    """One generation: its number, its name and its tables, which later publications do not change."""

    number: int
    generation: str
    tables: dict[str, DataFrame]


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/pointers")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []


def _read(spark: SparkSession, root: str, number: int) -> dict:
    fs, p = _fs(spark, f"{root}/pointers/{number:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], checks: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None, after: int | None = None) -> Snapshot:
    """Make tables the current generation under root.

    checks gives, for the tables as written, named tables of rows that break a rule; any row refuses the publication. after
    is the number of the generation that the caller read: if another one came since, this one is refused. Tables
    whose rows are all those of the current generation are not published again.
    """
    name = uuid.uuid4().hex
    for t, df in tables.items():
        df.write.parquet(f"{root}/generations/{name}/{t}")
    written = {t: spark.read.schema(df.schema).parquet(f"{root}/generations/{name}/{t}") for t, df in tables.items()}
    for rule, rows in (checks(written) if checks else {}).items():
        if not rows.isEmpty():
            raise Refused(f"{rule}: {rows.first()}")
    told = {t: dict(zip(("rows", "digest"), digest_of(df).first(), strict=True)) for t, df in written.items()}
    known = _pointers(spark, root)
    if known and _read(spark, root, known[-1])["tables"] == told:
        fs, p = _fs(spark, f"{root}/generations/{name}")
        fs.delete(p, True)
        return snapshot(spark, root)
    number = (known[-1] if known else 0) + 1
    if after is not None and number != after + 1:
        raise Refused(f"generation {number - 1} was published after {after}")
    fs, p = _fs(spark, f"{root}/pointers/{number:012d}.json")
    body = json.dumps({"generation": name, "tables": told, "schemas": {t: df.schema.json() for t, df in tables.items()}}).encode()
    try:
        stream = fs.create(p, False)  # fails if another writer was first
    except Exception as e:
        raise Refused(f"another writer published generation {number}") from e
    stream.write(bytearray(body), 0, len(body))
    stream.close()
    return Snapshot(number, name, written)


def snapshot(spark: SparkSession, root: str, number: int | None = None, verify: bool = False) -> Snapshot:
    """The current generation, or that of a number; resolved once. verify: Refused if a table's rows are not those published."""
    from pyspark.sql.types import StructType

    known = _pointers(spark, root)
    if not known or number is not None and number not in known:
        raise Refused("no such generation")
    number = known[-1] if number is None else number
    told = _read(spark, root, number)
    tables = {t: spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f"{root}/generations/{told['generation']}/{t}") for t, s in told["schemas"].items()}
    if verify:
        for t, df in tables.items():
            if digest_of(df).first()["digest"] != told["tables"][t]["digest"]:
                raise Refused(f"rows of {t} were changed")
    return Snapshot(number, told["generation"], tables)
