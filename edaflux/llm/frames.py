"""Helpers the text operators share: whole texts in bounded slices of Arrow batches."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from edaflux.session import shared_folder

# Characters worked on at once inside a task. A longer text is a slice of its own and is still taken whole.
SLICE_CHARS = 4_000_000


def slices(texts: Sequence, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts add up to about ``limit`` characters; null counts as nothing."""
    return _slices([len(t) if t is not None else 0 for t in texts], limit)


def _slices(sizes: Sequence[int | None], limit: int) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def map_rows(
    df: DataFrame, work: Callable[..., dict], schema: str, text: str = "text", binary: bool = False, limit: int = SLICE_CHARS
) -> DataFrame:
    """``work(rows)`` over slices of rows: a dict of column lists in, a dict of output columns of any one length out.

    ``df`` should hold only the columns that are needed. Tasks keep nothing between slices, and of a batch only one
    slice at a time is Python objects. With ``binary`` texts arrive as UTF-8 bytes.
    """
    kind = _parse_datatype_string(schema)

    def run(batches):
        out = to_arrow_schema(kind)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if binary:
                columns[text] = columns[text].cast(pa.binary())
            sizes = (pc.binary_length if binary else pc.utf8_length)(columns[text]).to_pylist()
            for begin, end in _slices(sizes, limit):
                made = work({n: c.slice(begin, end - begin).to_pylist() for n, c in columns.items()})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, kind)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: lost executors cost no recomputation, and
    columns stay compressed. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/edaflux-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    _places[id(table)] = (weakref.ref(table), where)
    return table


_places: dict[int, tuple] = {}


def discard(table: DataFrame) -> None:
    """Remove a stored table that nothing reads any more."""
    made, where = _places.pop(id(table), (None, None))
    if made is not None and made() is table:
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a like one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
