"""Names for loaded tables, so that ``spark.sql`` reads them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluice.plans.load import LoadTarget, committed_runs, read_ledger, run_schema, table_schema, void_files


def view_name(table: str) -> str:
    """A table's name as a catalog takes it: what is no ASCII letter, digit or underscore is written as its code."""
    return re.sub(r"\W", lambda m: f"_{ord(m.group()):x}_", table, flags=re.ASCII)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _files(paths: list[str]) -> str:
    """The folders of some runs as one relation."""
    if len(paths) == 1:
        return f"parquet.{_quoted(paths[0])}"
    folder = paths[0].rsplit("/", 1)[0]
    return f"parquet.{_quoted(folder + '/{' + ','.join(p.rsplit('/', 1)[1] for p in paths) + '}')}"


def _branch(paths: list[str], own: T.StructType, schema: T.StructType, void: str | None) -> str:
    """Runs that were written in the types of ``own``, in those of ``schema``; rows of replaced files are left out."""
    names = {f.name for f in own}
    columns = ", ".join(f"CAST({'r.' + _quoted(f.name) if f.name in names else 'NULL'} AS {f.dataType.simpleString()}) AS {_quoted(f.name)}"
                        for f in schema)
    select = f"SELECT {columns} FROM {_files(paths)} r"
    if void is None:
        return select
    run = "regexp_extract(r._metadata.file_path, '/run=([0-9a-f]+)/', 1)"
    return f"{select} LEFT ANTI JOIN parquet.{_quoted(void)} v ON {run} = v.void_run AND r._file_path = v.void_file"


def publish(spark: SparkSession, target: LoadTarget, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Give the rows that the ledger holds now a name in the catalog; returns the table read by that name.

    The name is a view over the folders of the committed runs, which never change. Publishing anew replaces the view in
    one step of the catalog: a query sees all of a load or nothing of it, and one that has begun goes on with the runs it
    knows. The view's text has the names of runs, not of files. Runs with other types are cast to the kept schema.
    """
    ledger = read_ledger(spark, target)
    schema = schema or table_schema(spark, target)
    kinds = committed_runs(ledger, target.data, "affected_rows > 0", True)
    void = None
    if any(mixed for mixed, _ in kinds):
        void = f"{target.root}/{target.folder}/void/{uuid.uuid4().hex}"
        void_files(ledger.filter("status = 'superseded'")).write.parquet(void)
    branches = [_branch(paths, run_schema(written, schema), schema, void if mixed else None) for (mixed, written), paths in kinds.items()]
    if not branches:
        empty = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {_quoted(f.name)}" for f in schema)
        branches = [f"SELECT {empty} WHERE false"]
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS " + " UNION ALL ".join(branches))
    return spark.table(name)
