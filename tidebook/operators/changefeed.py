"""Applying a stream of inserts, updates and deletes.

Every bucket of keys holds its state in an embedded DuckDB table. Messages are upserted with a
conditional conflict update that compares the stored sequence with the arriving one, so the
outcome is the same in any order of arrival and under any repetition. A delete stays as a
tombstone, so that a late, older message cannot bring its row back. All buckets export into one
staging folder, which is published as a whole by replacing a pointer file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.util import fresh_path, partitions_for

BUCKET_BYTES = 32 << 20
POINTER = "_CURRENT"
#: Rows gathered before one upsert statement, and rows of state that the pre-shuffle pass holds.
CHUNK_ROWS, HELD_ROWS = 65_536, 131_072
MEMORY = "900MB"


def _upserts(schema_json: str, held_rows: int | None):
    """A function over Arrow batches that yields the state which the batches leave.

    held_rows: before the shuffle the state is flushed at this many rows, since a partition may
    hold any number of keys; after it a bucket's state is kept whole.
    """

    def run(batches: Iterable) -> Iterator:
        import duckdb
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(T.StructType.fromJson(json.loads(schema_json)))
        columns = arrow.names
        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        db.execute("SET TimeZone='UTC'")
        db.register("arriving", arrow.empty_table())
        db.execute("CREATE TABLE state AS SELECT * FROM arriving")
        db.unregister("arriving")
        db.execute("ALTER TABLE state ADD PRIMARY KEY (k)")
        sets = ", ".join(f'"{c}" = excluded."{c}"' for c in columns if c != "k")
        upsert = f"""
            INSERT INTO state
            SELECT * FROM arriving QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, t DESC) = 1
            ON CONFLICT (k) DO UPDATE SET {sets}
            WHERE excluded.s > state.s OR (excluded.s = state.s AND excluded.t > state.t)"""

        def export():
            for batch in db.sql("SELECT * FROM state").to_arrow_reader(CHUNK_ROWS):
                yield from pa.Table.from_batches([batch]).select(columns).cast(arrow).to_batches()

        def apply(chunk: list) -> None:
            db.register("arriving", pa.Table.from_batches(chunk))
            db.execute(upsert)
            db.unregister("arriving")

        chunk, rows, held = [], 0, 0
        for batch in batches:
            chunk.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                apply(chunk)
                held += rows
                chunk, rows = [], 0
                if held_rows and held >= held_rows:
                    yield from export()
                    db.execute("DELETE FROM state")
                    db.execute("CHECKPOINT")
                    held = 0
        if rows:
            apply(chunk)
        yield from export()
        db.close()

    return run


def _sequence(column: str, kind: T.DataType) -> Column:
    """A sequence value as bigint; a missing one is older than any other."""
    value = F.unix_micros(column) if isinstance(kind, T.TimestampType) else F.col(column).cast("bigint")
    return F.coalesce(value, F.lit(-(2**63)).cast("bigint"))


def upsert_state(feed: DataFrame, key: list[str], sequence: str, deleted: Column, payload: list[str], before: DataFrame | None = None) -> DataFrame:
    """The row of each key that holds after all messages: key, payload, ``is_deleted`` and the stored sequence.

    Of messages with the same sequence a delete wins, then the one whose payload has the greater
    hash, so that ties have one outcome. A null ``deleted`` means false. Null key parts are values
    of their own. ``before`` is a state made earlier, whose sequences and tombstones go on to count.

    Rows are combined in a bounded DuckDB state on the map side, so a key that holds a third of the
    rows reaches its bucket as a few rows a partition.
    """
    kinds = {f.name: f.dataType for f in feed.schema.fields}
    gone = F.coalesce(deleted, F.lit(False))
    cells = [F.col(c).alias(f"p{i}") for i, c in enumerate([*key, *payload])]
    # 61 bits of hash below one bit for a delete: never negative
    tie = F.shiftrightunsigned(F.xxhash64(*key, *payload), 3) + F.when(gone, F.lit(2**61)).otherwise(F.lit(0)).cast("bigint")
    rows = feed.select(F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])).alias("k"), _sequence(sequence, kinds[sequence]).alias("s"), tie.alias("t"), gone.alias("d"), *cells)
    schema, buckets = rows.schema.json(), partitions_for(feed, BUCKET_BYTES)
    if before is not None:  # a bucket holds its share of the whole table, however small the feed
        buckets = max(buckets, partitions_for(before, BUCKET_BYTES))
    rows = rows.mapInArrow(_upserts(schema, HELD_ROWS), rows.schema)
    if before is not None:
        again = [F.col(c).alias(f"p{i}") for i, c in enumerate([*key, *payload])]
        rows = rows.unionByName(before.select(F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])).alias("k"), F.col("stored_sequence").alias("s"), F.col("stored_tie").alias("t"), F.col("is_deleted").alias("d"), *again))
    state = rows.repartition(buckets, "k").mapInArrow(_upserts(schema, None), rows.schema)
    names = [F.col(f"p{i}").alias(c) for i, c in enumerate([*key, *payload])]
    return state.select(*names, F.col("d").alias("is_deleted"), F.col("s").alias("stored_sequence"), F.col("t").alias("stored_tie"))


def publish(state: DataFrame, root: str) -> str:
    """Export all buckets and make them current in one step; readers see the old or the new table whole.

    Buckets go through Spark's committer, so a lost executor's or a repeated task's files never
    count. The pointer is replaced by an atomic rename after the last bucket is there.
    """
    spark = state.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    state.write.parquet(f"{root}/{version}")
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(place, f"_draft-{version}")
    out = files.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(place, POINTER), options)
    return f"{root}/{version}"


def current_version(spark: SparkSession, root: str) -> str | None:
    """Path of the published table, or None before the first publication."""
    jvm = spark._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    files = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{root}/{text.strip()}"


def apply_changes(feed: DataFrame, key: list[str], sequence: str, deleted: Column, payload: list[str], root: str | None = None) -> DataFrame:
    """Apply a change feed to the table published under ``root`` and publish the outcome.

    Returns the new state, tombstones included (see ``upsert_state``). Messages may come in any
    number of calls and in any order among them. Without ``root`` a fresh table is made.
    """
    spark = feed.sparkSession
    root = root or fresh_path(spark, "changes")
    place = current_version(spark, root)
    state = upsert_state(feed, key, sequence, deleted, payload, spark.read.parquet(place) if place else None)
    schema = state.schema
    return spark.read.schema(schema).parquet(publish(state, root))
