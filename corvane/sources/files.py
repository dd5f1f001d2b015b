"""Readers and writers of the interchange formats. Schemas are given, never inferred from data at scale; writes replace a folder as a whole
(Spark's commit protocol), appends add files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, tolerant: bool = False) -> DataFrame:
    """JSON lines. Blank lines are no rows; with tolerant, neither are malformed or cut off ones (as after a crash)."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    if not tolerant:
        return reader.json(path)
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").contains("\0"))
    parsed = text.select(F.from_json("value", fields.add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column is text, missing values are empty."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def read_csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_documents(spark: SparkSession, path: str, schema: str, nested: str = "blocks", by_line: bool = False) -> DataFrame:
    """One JSON file per document (by_line: or a line per document) with an array of nested rows: a row per nested one with its ordinal."""
    docs = spark.read.schema(schema).option("multiLine", not by_line).json(path)
    rest = [c for c in docs.columns if c != nested]
    return docs.select(*rest, F.posexplode(nested).alias("ord", "_b")).select(*rest, "ord", "_b.*")


def scan_files(spark: SparkSession, path: str, suffix: str = ".pdf", limit: int | None = None) -> DataFrame:
    """path, length, modified, name, folder, sha256 of all files below a folder with a suffix, whatever its case; the first `limit` by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").endswith(suffix.lower()))
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    parts = F.split("path", "/")
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), F.sha2("content", 256).alias("sha256"))


def write_vectors(df: DataFrame, path: str) -> None:
    """id, vec (array<float>): the Parquet form of a matrix with its list of ids."""
    df.select("id", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, vec array<float>").parquet(path)


HUMAN = ("human_verdict", "human_notes")


def keep_human_columns(new: DataFrame, old: DataFrame | None, key: str, columns: tuple[str, ...] = HUMAN) -> DataFrame:
    """The new rows with what people have written in the old ones; an old row counts if any of its columns is not blank; other old rows go."""
    base = new.drop(*[c for c in columns if c in new.columns])
    if old is None:
        return base.select("*", *[F.lit("").alias(c) for c in columns])
    filled = None
    for c in columns:
        some = F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
        filled = some if filled is None else filled | some
    written = old.where(filled).select(F.col(key), *columns)
    return base.join(written, key, "left").select(*base.columns, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def table_text(df: DataFrame, bold: dict[str, bool] | None = None, digits: int = 3, note: str = "", columns: str | None = None) -> tuple[str, str]:
    """Markdown and LaTeX of a small table (it is collected); bold: columns whose best value stands out, True if more is better; a note below; columns: LaTeX's column types."""
    rows, names = [list(r) for r in df.collect()], df.columns
    best = {c: (max if up else min)([r[names.index(c)] for r in rows if r[names.index(c)] is not None], default=None) for c, up in (bold or {}).items()}

    def cell(c, v, strong):
        t = "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
        return strong(t) if c in best and v is not None and abs(v - best[c]) < 1e-8 else t

    md = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    md += ["| " + " | ".join(cell(c, v, lambda t: f"**{t}**") for c, v in zip(names, r, strict=True)) + " |" for r in rows]
    plain = lambda t: "".join("\\" + x if x in "&%$#_{}" else x for x in t)
    tex = [rf"\begin{{tabular}}{{{columns or 'l' * len(names)}}}", " & ".join(map(plain, names)) + r" \\ \hline"]
    tex += [" & ".join(cell(c, plain(v) if isinstance(v, str) else v, lambda t: rf"\textbf{{{t}}}") for c, v in zip(names, r, strict=True)) + r" \\" for r in rows]
    md, tex = [*md, *(["", note] if note else [])], [*tex, r"\end{tabular}", *([r"\par " + plain(note)] if note else [])]
    return "\n".join(md) + "\n", "\n".join(tex) + "\n"


def report(spark: SparkSession, lines: list[str], path: str) -> None:
    """A report of a few lines: printed, and saved as one text file in a folder."""
    print(*lines, sep="\n")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def path_fields(path: Column) -> list[Column]:
    """folder (first part), stem and doc_group (the folder of a file in a bulk download, else its stem) of a relative path."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    bulk = F.array_contains(parts, "bulk-download")
    return [F.get(parts, F.lit(0)).alias("folder"), X.clean_stem(stem).alias("stem"), F.when(bulk & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(stem).alias("doc_group")]
