"""Occurrences and records of every distinct term (problem 1).

Method: recursive radix spilling.  Every task splits its records into terms and
aggregates them with DuckDB before anything moves, so that a term is sent at most
once from each task.  The partial counts are partitioned by the high bits of the
term's hash (Spark's shuffle writes these partitions to disk).  A task that gets
more rows than fit splits them by the next hash bits into runs of its own and
aggregates each run out of core with DuckDB, recursively, until a run fits.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.records import distinct_texts, plain_form
from quotelens.operators.skew import union_all
from quotelens.plans.runtime import materialize, shared_dir

#: Rows of partial counts that one DuckDB aggregation takes before it splits by more hash bits.
RUN_ROWS = 4_000_000
#: Hash bits of each further split, and DuckDB's memory for one aggregation.
SPLIT_BITS, MEMORY = 4, "256MB"
_COUNTS = "field string, term string, n_occurrences long, n_records long"
_PARTIAL = pa.schema([("field", pa.string()), ("term", pa.string()), ("n_occurrences", pa.int64()), ("n_records", pa.int64())])


@contextlib.contextmanager
def _duck(spill: str):
    """A DuckDB connection that spills into a folder of its own below ``spill``, which is
    removed when the task is done."""
    import duckdb

    os.makedirs(spill, exist_ok=True)
    root = tempfile.mkdtemp(prefix="terms-", dir=spill)
    con = duckdb.connect()
    try:
        con.execute("SET threads=1")
        con.execute("SET preserve_insertion_order=false")
        con.execute(f"SET memory_limit='{MEMORY}'")
        con.execute(f"SET temp_directory='{root}'")
        yield con
    finally:
        con.close()
        shutil.rmtree(root, ignore_errors=True)


def _split_terms(batches: Iterator[pa.RecordBatch], spill: str) -> Iterator[pa.RecordBatch]:
    """Partial counts of one task's records; the record total comes as a null term."""
    with _duck(spill) as con:
        pending, chars = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            con.register("records", pa.Table.from_batches(pending))
            yield from _stream(con, """
                WITH words AS (SELECT field, rec_id, unnest(string_split(plain, ' ')) AS term FROM records),
                once AS (SELECT field, rec_id, term, count(*) AS n FROM words GROUP BY ALL)
                SELECT field, term, sum(n)::BIGINT AS n_occurrences, count(*) AS n_records FROM once GROUP BY ALL
                UNION ALL SELECT field, NULL, 0, count(*) FROM records GROUP BY ALL""")
            con.unregister("records")

        for batch in batches:
            pending.append(batch)
            chars += batch.nbytes
            if chars > 64 << 20:
                yield from flush()
                pending, chars = [], 0
        if pending:
            yield from flush()


def _stream(con, sql: str) -> Iterator[pa.RecordBatch]:
    """The rows of a DuckDB query, batch by batch, in the schema of partial counts."""
    for b in con.sql(sql).to_arrow_reader(50_000):
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column(i).cast(f.type) for i, f in enumerate(_PARTIAL)], schema=_PARTIAL)


def _sum_run(con, run: str, rows: int, bit: int, run_rows: int) -> Iterator[pa.RecordBatch]:
    """Aggregate table ``run``; split it by the hash bits from ``bit`` on if it is too large."""
    if rows <= run_rows or bit >= 64:
        yield from _stream(con, f"SELECT field, term, sum(n_occurrences)::BIGINT AS n_occurrences, sum(n_records)::BIGINT AS n_records FROM {run} GROUP BY field, term")
        con.execute(f"DROP TABLE {run}")
        return
    part = f"((hash(field, term) >> {bit}) & {(1 << SPLIT_BITS) - 1})"
    # Sorted by part once, so that each part is a stretch of the table and not a scan of it.
    con.execute(f"CREATE TEMP TABLE {run}_all AS SELECT {part} AS part, * FROM {run} ORDER BY part")
    con.execute(f"DROP TABLE {run}")
    sizes = {}
    for (k,) in con.execute(f"SELECT DISTINCT part FROM {run}_all").fetchall():
        con.execute(f"CREATE TEMP TABLE {run}_{k} AS SELECT field, term, sum(n_occurrences)::BIGINT AS n_occurrences, sum(n_records)::BIGINT AS n_records FROM {run}_all WHERE part = {k} GROUP BY field, term")
        sizes[f"{run}_{k}"] = con.execute(f"SELECT count(*) FROM {run}_{k}").fetchall()[0][0]
    con.execute(f"DROP TABLE {run}_all")
    for name, n in sizes.items():
        yield from _sum_run(con, name, n, bit + SPLIT_BITS, run_rows if n < rows else n)


def _merge_counts(batches: Iterator[pa.RecordBatch], spill: str, run_rows: int) -> Iterator[pa.RecordBatch]:
    """Final counts of one hash partition."""
    with _duck(spill) as con:
        rows = 0
        for batch in batches:
            if batch.num_rows:
                con.register("part", pa.Table.from_batches([batch]))
                con.execute("CREATE TEMP TABLE run AS SELECT * FROM part" if not rows else "INSERT INTO run SELECT * FROM part")
                con.unregister("part")
            rows += batch.num_rows
        if rows:
            yield from _sum_run(con, "run", rows, 0, run_rows)


def _spill_dir(df: DataFrame) -> str:
    """Where DuckDB may spill: below the shared folder, which must be a mounted path."""
    path = shared_dir(df.sparkSession)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if not path.startswith("/"):
        raise ValueError(f"DuckDB can't spill into {path}: give a mounted path as ``spill``")
    return f"{path}/duckdb-spill"


def count_terms(records: DataFrame, run_rows: int = RUN_ROWS, spill: str | None = None) -> DataFrame:
    """Counts (field, term, n_occurrences, n_records) of ``records`` (field, rec_id, plain).

    Each (field, rec_id) must come once.  A row with a null term holds the field's
    number of records.  Null and empty texts are no records; repeated terms within a
    record count as occurrences, not as records.  ``spill``: a folder that all executors
    mount, where the shared folder is none.
    """
    spill = spill or _spill_dir(records)
    held = records.where(F.col("plain") != "").select("field", "rec_id", "plain")
    partials = held.mapInArrow(partial(_split_terms, spill=spill), _COUNTS)
    hashed = partials.repartition(F.shiftrightunsigned(F.xxhash64("field", "term"), 40))
    return hashed.mapInArrow(partial(_merge_counts, spill=spill, run_rows=run_rows), _COUNTS)


def term_table(fields: dict[str, tuple[DataFrame, str, str]], min_count: int = 2, max_share: float = 0.05, run_rows: int = RUN_ROWS) -> DataFrame:
    """(field_name, term, n_occurrences, n_records, mark) of every distinct word.

    ``fields`` maps a field name to (table, key column, text column).  Words are those
    of the plain form.  mark is 'rare' up to ``min_count`` occurrences in the field,
    else 'common' in more than ``max_share`` of its records, else null.  Redelivered
    rows count once; null, empty and blank texts are no records; an empty table
    gives no rows; other columns of the tables are ignored.
    """
    texts = union_all([distinct_texts(t, key, text).withColumn("field", F.lit(name)) for name, (t, key, text) in fields.items()])
    counts = materialize(count_terms(texts.select("field", "rec_id", plain_form(F.col("text")).alias("plain")), run_rows))
    totals = counts.where(F.col("term").isNull()).select("field", F.col("n_records").alias("total"))  # one row for each field named
    mark = F.when(F.col("n_occurrences") <= min_count, "rare").when(F.col("n_records") > F.col("total") * F.lit(max_share), "common")
    terms = counts.where(F.col("term").isNotNull()).join(F.broadcast(totals), "field")
    return terms.select(F.col("field").alias("field_name"), "term", "n_occurrences", "n_records", mark.alias("mark"))


def marked_terms(fields: dict[str, tuple[DataFrame, str, str]], min_count: int = 2, max_share: float = 0.05) -> DataFrame:
    """The rows of ``term_table`` with a mark: (field_name, term, mark)."""
    return term_table(fields, min_count, max_share).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")
