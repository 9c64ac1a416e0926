"""File contents to records with resolvable pointers.

``parse_documents`` takes one row per file (``format`` and ``content`` bytes or
text) and gives one row per record: ``record_pointer``, ``record`` (VARIANT) and
``parse_problem``. A file that cannot be read as its format gives one row with
the problem. Each array member becomes its own VARIANT, so the size limit of a
VARIANT applies to a record, never to a whole file.

``numbered_lines`` reads line-delimited files split by split, so one huge file
spreads over many tasks and still gets exact 1-based line numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Envelope member and whether a bare array is allowed, by format.
ENVELOPES: dict[str, tuple[str, bool]] = {
    "cloudtrail-json": ("Records", False),
    "azure-activity-rest-json": ("value", False),
    "graph-signin-json": ("value", False),
    "graph-directory-audit-json": ("value", False),
    "gcp-audit-json": ("entries", True),
}
LINE_FORMATS = ("jsonl",)

def _failure(problem: str) -> Column:
    return F.array(
        F.struct(
            F.lit("").alias("record_pointer"),
            F.lit(None).cast("variant").alias("record"),
            F.lit(problem).alias("parse_problem"),
        )
    )


def _members(items: Column, prefix: str) -> Column:
    return F.transform(
        items,
        lambda record, i: F.struct(
            F.concat(F.lit(prefix + "/"), i.cast("string")).alias("record_pointer"),
            record.alias("record"),
            F.lit(None).cast("string").alias("parse_problem"),
        ),
    )


def envelope_records(text: Column, member: str, bare_array: bool) -> Column:
    """ARRAY of records in one document: an envelope object, a single record
    object or (where allowed) a bare array."""
    first = F.substring(F.ltrim(text), 1, 1)
    parsed = F.from_json(
        text,
        f"`{member}` array<variant>, _malformed string",
        {"columnNameOfCorruptRecord": "_malformed"},
    )
    items = F.when(parsed["_malformed"].isNull(), parsed[member])
    has_member = F.array_contains(F.json_object_keys(text), member)
    whole = F.try_parse_json(text)
    single = F.array(
        F.struct(
            F.lit("").alias("record_pointer"),
            whole.alias("record"),
            F.lit(None).cast("string").alias("parse_problem"),
        )
    )
    as_object = (
        F.when(items.isNotNull(), _members(items, f"/{member}"))
        .when(whole.isNull(), _failure("malformed_json"))
        .when(F.coalesce(has_member, F.lit(False)), _failure("envelope_member_not_an_array"))
        .otherwise(single)
    )
    result = F.when(first == "{", as_object)
    if bare_array:
        listed = F.from_json(text, "array<variant>")
        result = result.when(
            (first == "[") & whole.isNotNull() & listed.isNotNull(), _members(listed, "")
        )
    return result.otherwise(
        F.when(whole.isNull(), _failure("malformed_json")).otherwise(
            _failure("document_not_an_object")
        )
    )


def line_records(text: Column) -> Column:
    """ARRAY of records, one per non-blank line; every line counts for its number."""
    lines = F.transform(
        F.split(text, "\r\n|\n|\r"),
        lambda line, i: F.struct(
            F.concat(F.lit("line:"), (i + 1).cast("string")).alias("record_pointer"),
            F.try_parse_json(line).alias("record"),
            F.when(F.try_parse_json(line).isNull(), F.lit("malformed_json")).alias(
                "parse_problem"
            ),
            (F.trim(line) == "").alias("blank"),
        ),
    )
    return F.transform(
        F.filter(lines, lambda x: ~x["blank"]),
        lambda x: F.struct(x["record_pointer"], x["record"], x["parse_problem"]),
    )


def parse_documents(files: DataFrame) -> DataFrame:
    """One row per record of every file; keeps the caller's columns except content."""
    keep = [c for c in files.columns if c != "content"]
    is_bytes = dict(files.dtypes)["content"] == "binary"
    text = F.decode("content", "UTF-8") if is_bytes else F.col("content")
    kind = F.col("format")
    found = F.when(kind.isin(*LINE_FORMATS), line_records(F.col("text_")))
    for (member, bare), formats in _formats_by_envelope().items():
        found = found.when(kind.isin(*formats), envelope_records(F.col("text_"), member, bare))
    found = found.otherwise(_failure("unsupported_format"))
    return (
        files.withColumn("text_", text)
        .select(*keep, F.explode(found).alias("found_"))
        .select(*keep, "found_.*")
    )


def _formats_by_envelope() -> dict[tuple[str, bool], list[str]]:
    grouped: dict[tuple[str, bool], list[str]] = {}
    for name, envelope in ENVELOPES.items():
        grouped.setdefault(envelope, []).append(name)
    return grouped


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files as (file_path, line_number, line).

    Every split counts its own lines first; the offsets of a file's splits then
    follow from a running sum over one row per split, not over the lines."""
    lines = spark.read.option("recursiveFileLookup", "true").text(paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("file_path", "block_start").agg(
        F.min("row_id").alias("first_row"), F.count("*").alias("lines_in_split")
    )
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.withColumn(
        "lines_before", F.coalesce(F.sum("lines_in_split").over(before), F.lit(0))
    )
    return lines.join(offsets, ["file_path", "block_start"]).select(
        "file_path",
        (F.col("lines_before") + F.col("row_id") - F.col("first_row") + 1).alias("line_number"),
        "line",
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Numbered lines to records, as ``parse_documents`` gives them."""
    record = F.try_parse_json("line")
    return lines.where(F.trim("line") != "").select(
        *[c for c in lines.columns if c not in ("line", "line_number")],
        F.concat(F.lit("line:"), F.col("line_number").cast("string")).alias("record_pointer"),
        record.alias("record"),
        F.when(record.isNull(), "malformed_json").alias("parse_problem"),
    )


def resolve(artifacts: DataFrame, references: DataFrame) -> DataFrame:
    """The record each reference points at, read again from stored bytes.

    ``artifacts``: artifact_sha256, format, content. ``references``:
    artifact_sha256, record_pointer. ``resolved`` is the number of records the
    pointer matches (1 where it resolves); ``record`` is NULL otherwise."""
    records = parse_documents(artifacts).where(F.col("parse_problem").isNull())
    counted = records.groupBy("artifact_sha256", "record_pointer").agg(
        F.count("*").alias("resolved"), F.first("record").alias("record")
    )
    return references.join(counted, ["artifact_sha256", "record_pointer"], "left").select(
        *references.columns,
        F.coalesce("resolved", F.lit(0)).alias("resolved"),
        F.when(F.col("resolved") == 1, F.col("record")).alias("record"),
    )
