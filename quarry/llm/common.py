"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.session import shared_dir, spread

#: ASCII: every byte that is no letter, digit or part of a longer UTF-8 sequence becomes a
#: space, A-Z become a-z; what is left between spaces are the normalised words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
#: The six ASCII white-space characters, at which bytes.split() splits.
BLANKS = b" \t\n\r\x0b\x0c"
#: rows that are Python objects at a time
ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def normal_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode().translate(NORMAL).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text."""
    return text.encode().split() if text else []


def col(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, so that jobs don't depend on the folder they are
    started in: its modules as a zip file in the shared folder, added with ``addPyFile`` once per context."""
    sc = spark.sparkContext
    package = Path(__file__).parents[1]
    if getattr(sc, "_quarry_shipped", False) or not package.is_dir():
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    data = held.getvalue()
    path = f"{shared_dir(spark, 'package')}/quarry-{hashlib.sha256(data).hexdigest()[:12]}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data))
    out.close()
    sc.addPyFile(path)
    sc._quarry_shipped = True


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def attach(docs: DataFrame, keep: list[str], reads: list[str], fields: str | T.StructType,
           start: Callable[[], Callable[..., dict[str, list]]]) -> DataFrame:
    """One output row per input row: ``row`` (a struct of the ``keep`` columns, untouched, so
    that no name of theirs can clash) and the new ``fields``.

    ``start()`` runs once per task and returns ``fn``; ``fn(*lists)`` gets the ``reads``
    columns of ROWS rows of an Arrow batch as Python lists and returns the fields' values by name.  A name
    ``a.b`` reads field b of the kept struct a, which is not sent twice.
    The work is row-local: no shuffle, one batch in memory.
    """
    new = fields if isinstance(fields, T.StructType) else T._parse_datatype_string(fields)
    more = [c for c in reads if c not in keep and c.split(".")[0] not in keep]
    nested = docs.select(F.struct(*[col(docs, c).alias(c) for c in keep]).alias("row"),
                         *[col(docs, c).alias(f"in_{c}") for c in more])
    schema = T.StructType([nested.schema["row"], *new.fields])
    arrow = to_arrow_schema(schema)

    def inside(row: pa.StructArray, name: str) -> pa.Array:
        if name in keep:
            return row.field(name)
        outer, inner = name.split(".")
        return row.field(outer).field(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                row = batch.column(0)
                out = fn(*[(batch.column(f"in_{c}") if c in more else inside(row, c)).to_pylist() for c in reads])
                yield pa.RecordBatch.from_arrays(
                    [row.cast(arrow.field(0).type), *[pa.array(out[f.name], type=f.type) for f in list(arrow)[1:]]],
                    schema=arrow)

    return map_batches(spread(nested), run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing reads any more (an earlier round of a loop)."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_scratch", None)
    if path:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def text_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Key of a document by value (id and 128-bit hash of the text): rows that repeat both are one document."""
    body = F.coalesce(col(docs, text_col), F.lit(""))
    return [F.coalesce(col(docs, id_col).cast("string"), F.lit("null")).alias("k_id"),
            F.xxhash64(body).alias("k_a"), F.xxhash64(F.lit(1), body, F.length(body)).alias("k_b")]
