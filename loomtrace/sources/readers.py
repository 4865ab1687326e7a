"""Sources: JSON documents with varying wrapper keys, text lines, table files and optional document decoders.

Everything is a lazy DataFrame with an explicit schema; file contents are parsed where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_json_rows(spark: SparkSession, path: str, wrappers: list[str], schema: StructType | str) -> DataFrame:
    """Rows of JSON documents that are an array, or an object holding arrays under any of ``wrappers``.

    Several wrapper keys of one file are united. Adds file and pos. A document that cannot be parsed, or holds none
    of the keys, gives no rows; ``unreadable_json`` lists it.
    """
    element = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    docs = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    rows = ArrayType(element)
    found = F.concat(
        F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", rows)), F.array().cast(rows)),
        *[F.coalesce(F.from_json(F.get_json_object("value", f"$.{w}"), rows), F.array().cast(rows)) for w in wrappers],
    )
    return docs.select("file", F.posexplode(found).alias("pos", "row")).select("file", "pos", "row.*")


def unreadable_json(spark: SparkSession, path: str, wrappers: list[str]) -> DataFrame:
    """(file, reason) of the documents ``read_json_rows`` takes nothing from."""
    docs = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    has = reduce(lambda a, b: a | b, [F.get_json_object("value", f"$.{w}").isNotNull() for w in wrappers], F.ltrim("value").startswith("["))
    ok = F.expr("try_parse_json(value)").isNotNull()
    return docs.select("file", F.when(~ok, "malformed").when(~has, "no known key").alias("reason")).where("reason is not null")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of text files, in file order."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "line"))


def latest_file(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, modified): the newest file of a folder by metadata alone; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("modificationTime").alias("modified"))
    return files.agg(F.max(F.struct("modified", "path")).alias("m")).select("m.path", "m.modified").where("path is not null")


Decoder = Callable[[bytes], list[tuple[int, str]]]


def decode_text(raw: bytes) -> list[tuple[int, str]]:
    return [(0, line) for line in raw.decode("utf-8", errors="replace").splitlines()]


def decode_pdf(raw: bytes) -> list[tuple[int, str]]:
    """Needs pdfminer, which is optional."""
    import io

    from pdfminer.high_level import extract_pages
    from pdfminer.layout import LTTextContainer

    return [(n, line) for n, page in enumerate(extract_pages(io.BytesIO(raw))) for box in page if isinstance(box, LTTextContainer) for line in box.get_text().splitlines()]


DECODERS: dict[str, Decoder] = {"txt": decode_text, "md": decode_text, "pdf": decode_pdf}


def read_documents(spark: SparkSession, path: str, decoders: dict[str, Decoder] = DECODERS) -> DataFrame:
    """(path, page, line_no, line, error) of files of any known kind, by extension; a failure is a row, not an abort."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                decoder = decoders.get(p.rsplit(".", 1)[-1].lower())
                try:
                    if decoder is None:
                        raise ValueError("unknown kind of file")
                    out += [(p, page, i, line, None) for i, (page, line) in enumerate(decoder(bytes(raw)))]
                except Exception as e:  # noqa: BLE001
                    out.append((p, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["path", "page", "line_no", "line", "error"]).astype({"page": "Int32", "line_no": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, line_no int, line string, error string")


def with_model(df: DataFrame, column: str, call: Callable[[list[str]], list[str]], out: str = "answer") -> DataFrame:
    """Adds ``out`` and ``error`` from an injected callable over batches of texts (a language model, an embedder).

    The callable is created by the caller and runs in the workers; a failing batch is tried row by row, so
    one bad row costs only itself.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf[column])
            try:
                res, err = list(call(texts)), [None] * len(texts)
            except Exception:  # noqa: BLE001
                res, err = [], []
                for t in texts:
                    try:
                        res.append(call([t])[0])
                        err.append(None)
                    except Exception as e:  # noqa: BLE001
                        res.append(None)
                        err.append(f"{type(e).__name__}: {e}"[:300])
            yield pdf.assign(**{out: res, "error": err})

    return df.mapInPandas(run, f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, `{out}` string, error string")


def first_json_array(c):
    """The outermost [...] of a model's answer, fences and chatter around it dropped; null if there is none."""
    text = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    return F.when(text != "", text)


def load_status(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``exit_code``: 0 for a JSON object, 2 for a text that is missing, malformed or anything else."""
    ok = F.coalesce(F.expr(f"schema_of_variant(try_parse_json(`{text}`))").startswith("OBJECT<"), F.lit(False))
    return docs.withColumn("exit_code", F.when(ok, 0).otherwise(2))
