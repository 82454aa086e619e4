"""Annotated corpora as samples and gold spans: sample_id, text, and sample_id, text, phi_type, start, end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ANY = "array<struct<text:string,value:string,phi_type:string,type:string,label:string,entity:string,start:int,end:int,start_idx:int,end_idx:int>>"
CBLUE = {"per": "NAME", "loc": "LOCATION", "org": "FACILITY", "tim": "DATE"}


def _samples(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Objects of a JSON file: lines, an array, or a list under samples or data."""
    entity = f"id string, text string, full_text string, annotations {_ANY}, entities {_ANY}, spans array<struct<entity_type:string,entity_value:string,start_position:int,end_position:int>>"
    if lines:
        return spark.read.schema(entity).json(path)
    whole = f"samples array<struct<{entity.replace(' string', ':string').replace(' array', ':array')}>>"
    nested = spark.read.schema(entity + ", " + whole + ", " + whole.replace("samples", "data", 1)).json(path, multiLine=True)
    own = [c for c in nested.columns if c not in ("samples", "data")]
    inner = nested.select(F.explode(F.coalesce("samples", "data")).alias("s")).select("s.*")
    return nested.filter(F.coalesce("text", "full_text").isNotNull()).select(*own).unionByName(inner)


def read_annotated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, gold) of JSON or JSONL files; aliases of fields are taken: value, type, label, entities, full_text and spans."""
    rows = _samples(spark, path, path.endswith(("jsonl", "ndjson")))
    rows = rows.withColumn("sample_id", F.coalesce("id", F.sha2(F.coalesce("text", "full_text"), 256))).withColumn("text", F.coalesce("text", "full_text"))
    one = F.transform(
        F.coalesce("annotations", "entities"),
        lambda a: F.struct(F.coalesce(a["text"], a["value"], a["entity"]).alias("text"), F.coalesce(a["phi_type"], a["type"], a["label"]).alias("phi_type"), F.coalesce(a["start"], a["start_idx"]).alias("start"), F.coalesce(a["end"], a["end_idx"]).alias("end")),
    )
    two = F.transform("spans", lambda s: F.struct(s["entity_value"].alias("text"), s["entity_type"].alias("phi_type"), s["start_position"].alias("start"), s["end_position"].alias("end")))
    gold = rows.select("sample_id", F.explode(F.coalesce(one, two)).alias("g")).select("sample_id", "g.*")
    return rows.select("sample_id", "text"), gold


def cblue_types(kind: Column) -> Column:
    from maskwright.functions.types import literal_map

    return F.coalesce(F.try_element_at(literal_map(CBLUE), F.lower(kind)), kind)


def _tags(notes: Column) -> Column:
    """array<struct<text, phi_type, start, end>> of tags with start, end and text attributes in any order (their TYPE, else the tag's name); if there are none, of
    inline <PHI TYPE="..."> tags."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf'(?i)\b{name}="([^"]*)"', 1)
    placed = F.filter(F.regexp_extract_all(notes, F.lit(r'<\w+\s[^<>]*>'), F.lit(0)), lambda t: t.rlike(r'(?i)\bstart="\d+"') & t.rlike(r'(?i)\bend="\d+"') & t.rlike(r'(?i)\btext="'))
    kind = lambda t: F.coalesce(F.nullif(attribute(t, "TYPE"), F.lit("")), F.regexp_extract(t, r"<(\w+)", 1))
    with_places = F.transform(placed, lambda t: F.struct(attribute(t, "text").alias("text"), kind(t).alias("phi_type"), attribute(t, "start").try_cast("int").alias("start"), attribute(t, "end").try_cast("int").alias("end")))
    inline = r'(?i)<PHI\s+TYPE="\w+"[^>]*>[^<]*</PHI>'
    without = F.transform(
        F.regexp_extract_all(notes, F.lit(inline), F.lit(0)),
        lambda t: F.struct(F.regexp_extract(t, ">([^<]*)<", 1).alias("text"), attribute(t, "TYPE").alias("phi_type"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")),
    )
    return F.when(F.size(with_places) > 0, with_places).otherwise(without)


def _contents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """sample_id (the stem), extension and text of files."""
    name = lambda i: F.regexp_extract("path", r"([^/]+)\.([^./]+)$", i)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(name(1).alias("sample_id"), F.lower(name(2)).alias("extension"), F.decode("content", "UTF-8").alias("text"))


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, gold) of text files with an annotation file of the same stem (.xml, else .phi, else .tags).  Texts without annotations stay."""
    texts = _contents(spark, path, "*.txt").select("sample_id", "text")
    found = _contents(spark, path, "*.{xml,phi,tags}")
    order = F.array_position(F.array(*map(F.lit, ("xml", "phi", "tags"))), F.col("extension"))
    notes = found.groupBy("sample_id").agg(F.min_by("text", order).alias("notes"))
    gold = texts.select("sample_id").join(notes, "sample_id").select("sample_id", F.explode(_tags(F.col("notes"))).alias("g"))
    return texts, gold.select("sample_id", "g.*")


def read_marked(spark: SparkSession, path: str, glob: str = "*.{xml,phi,tags,txt}") -> tuple[DataFrame, DataFrame]:
    """(samples, gold) of files that hold their text and its tags; the text is what is left without tags."""
    found = _contents(spark, path, glob)
    return found.select("sample_id", F.regexp_replace("text", "<[^>]+>", "").alias("text")), found.select("sample_id", F.explode(_tags(F.col("text"))).alias("g")).select("sample_id", "g.*")


def read_tagged(table: DataFrame, key: str) -> DataFrame:
    """(sample_id, column, text) of a table's text columns whose values carry inline tags."""
    columns = [c for c in table.columns if c != key]
    each = table.select(F.col(key).cast("string").alias("sample_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns])).alias("x"))
    return each.select("sample_id", "x.*").filter(F.col("text").contains("【PHI:"))


def read_regulations(spark: SparkSession, path: str) -> DataFrame:
    """source, type (its folder), content of markdown and text files."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    place = F.col("_metadata.file_path")
    return found.select(F.regexp_extract(place, r"([^/]+)$", 1).alias("source"), F.regexp_extract(place, r"([^/]+)/[^/]+$", 1).alias("type"), F.col("value").alias("content"))
