"""Reading and writing daily records, sources and signal payloads."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacksift.functions.text import epoch_ms, text_or_null
from stacksift.operators.aggregates import first_decision, review_averages
from stacksift.operators.filters import accepted
from stacksift.sources.staging import staging_folder, written_table

SOURCE = "name string, company string, blog_url string, fetch_type string, rss_url string, extractor string, js_render boolean, language string, weight double, enabled boolean"
NOTES = "note string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in any file system that Spark knows."""
    try:
        spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).schema  # noqa: B018
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


#: What stands between the records of an array that is written with an indent of two: no text inside a record has it.
BETWEEN = "\n  {\n"


def array_pieces(spark: SparkSession, path: str, schema: T.StructType, arrays: str, size: int = 0) -> DataFrame:
    """(file, opens, closes, bad, r): array files of at least `size` bytes cut between their records, so that many tasks read one file.

    The first piece of a file opens the array; each other one is a record r, the last of which closes it.
    """
    pieces = spark.read.option("lineSep", BETWEEN).option("pathGlobFilter", arrays).text(path).where(F.col("_metadata.file_size") >= size).select("value", F.col("_metadata.file_path").alias("file"))
    opens, closes = F.trim("value") == "[", F.col("value").rlike(r"\n  \}\s*\n\]\s*$")
    text = F.concat(F.lit("{\n"), F.regexp_replace("value", r"\n  \}(,|\s*\n\]\s*)$", "\n}"))
    typed = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    found = pieces.select("file", opens.alias("opens"), closes.alias("closes"), F.endswith("value", F.lit("\n  },")).alias("goes_on"), F.when(~opens, F.from_json(text, typed, {"columnNameOfCorruptRecord": "_broken"})).alias("r"))
    bad = ~F.col("opens") & (~(F.col("closes") | F.col("goes_on")) | F.col("r").isNull() | F.col("r._broken").isNotNull())
    return found.select("file", "opens", "closes", bad.alias("bad"), "r")


#: Array files under this size are read whole, by one task each.
CUT_FROM = 1 << 24


def whole_arrays(spark: SparkSession, schema: T.StructType, paths: str | list[str], **options: str) -> DataFrame:
    """Records of array files, each of which is read by one task; files that are no array of records give none."""
    return spark.read.schema(schema).options(mode="DROPMALFORMED", multiLine="true", **options).json(paths)


def read_large_arrays(spark: SparkSession, path: str, schema: T.StructType, arrays: str = "*.json", cut_from: int = CUT_FROM) -> DataFrame:
    """Records of array files, each of which may be read by many tasks.

    Files under cut_from bytes are read once, by one task each; which these are is known from the list of files. A larger
    file that is whole in the shape that `indent=2` writes is cut between records; it is read once to see that it is, and
    once for its rows. Any other large file is read by one task too: other layouts, objects, broken ones. Only the
    names of these come to the driver.
    """
    small = whole_arrays(spark, schema, path, pathGlobFilter=arrays).where(F.col("_metadata.file_size") < cut_from)
    pieces = array_pieces(spark, path, schema, arrays, cut_from)
    files = pieces.groupBy("file").agg((F.count_if("opens") == 1).alias("one"), (F.count_if("closes") == 1).alias("end"), F.bool_or("bad").alias("bad")).withColumn("whole", F.expr("one and end and not bad"))
    others = [unquote(r["file"]) for r in files.where("not whole").select("file").collect()]
    rows = pieces.where("not opens").join(files.where("whole").select("file"), "file", "left_semi").select(*[F.col(f"r.`{n}`").alias(n) for n in schema.names])
    found = small.unionByName(rows)
    return found.unionByName(whole_arrays(spark, schema, others)) if others else found


def read_records(spark: SparkSession, path: str, schema: T.StructType, arrays: str = "*.json", lines: str = "*.jsonl", large: bool = False, cut_from: int = CUT_FROM) -> DataFrame:
    """SRC-01: records of all daily files under path, arrays (.json) and lines (.jsonl), with an explicit schema that has an id.

    A broken array file and a file with an object instead give no rows, a broken line is skipped; rows
    without an id are dropped; a missing folder gives no rows. large: array files may be large, those of
    cut_from bytes and more then are cut, see read_large_arrays; without it each is read by one task.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if large:
        whole = read_large_arrays(spark, path, schema, arrays, cut_from)
    else:
        whole = whole_arrays(spark, schema, path, pathGlobFilter=arrays)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("pathGlobFilter", lines).json(path)
    return whole.unionByName(rows).where(text_or_null(F.col("id")).isNotNull())


def write_daily(df: DataFrame, path: str, day: str = "report_date") -> None:
    """SRC-07: writes the days of df as Parquet partitions; other days stay. df must not read the days that it replaces."""
    df.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_sources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-04: enabled, valid sources of a JSON file, split into feeds and crawled ones."""
    rows = spark.read.schema(SOURCE).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    valid = text_or_null(F.col("name")).isNotNull() & F.col("fetch_type").isin("rss", "crawler") & F.coalesce("weight", F.lit(1.0)).between(0, 1)
    usable = F.when(F.col("fetch_type") == "rss", text_or_null(F.col("rss_url"))).otherwise(text_or_null(F.col("extractor"))).isNotNull()
    good = rows.where(valid & usable & F.coalesce("enabled", F.lit(True)))
    return good.where("fetch_type = 'rss'"), good.where("fetch_type = 'crawler'")


def field(value: str | Column):
    """The text of a variant that is a bare value or one wrapped in {"value": ..}."""
    return F.coalesce(F.try_variant_get(value, "$.value", "string"), F.try_variant_get(value, "$", "string"))


#: What is read of a review note and of a reply; a value may be bare or wrapped, and one bad reply leaves the others.
NOTE = "forum string, id string, content struct<title: variant, abstract: variant, authors: variant>, pdate string, cdate string, mdate string, tmdate string, details struct<replies: array<string>>"
REPLY = "invitations array<string>, content struct<decision: variant, rating: variant, confidence: variant>"


def read_review_notes(notes: DataFrame, venue: str, category: str, fallback) -> DataFrame:
    """SRC-05: papers of accepted notes (note: JSON text), with their review signal; the first decision counts.

    Notes without forum and id, title or abstract are dropped. fallback is the instant for missing dates. A note is
    parsed once, and so is each reply; what is used of them is a table of the shared folder, which papers and reviews
    are read from.
    """
    keyed = notes.select(F.from_json("note", NOTE).alias("n")).select("n.*", F.coalesce(text_or_null(F.col("n.forum")), text_or_null(F.col("n.id"))).alias("forum_id"))
    parsed = keyed.select("forum_id", *[field(f"content.{k}").alias(k) for k in ("title", "abstract", "authors")], "pdate", "cdate", "mdate", "tmdate", "details.replies")
    authors = F.coalesce(F.from_json("authors", "array<string>"), F.when(F.col("authors").isNotNull(), F.array("authors")), F.array().cast("array<string>"))
    ends = lambda r, s: F.coalesce(F.exists(r["invitations"], lambda k: k.endswith(s)), F.lit(False))
    kind = lambda r: F.when(ends(r, "Decision"), "Decision").when(ends(r, "Official_Review"), "Official_Review")
    typed = lambda r: F.struct(kind(r).alias("kind"), *[field(r["content"][k]).alias(k) for k in ("decision", "rating", "confidence")])
    replies = F.transform(F.transform("replies", lambda t: F.from_json(t, REPLY)), typed)
    used = parsed.withColumns({"title": F.trim("title"), "abstract": F.trim("abstract"), "authors": authors, "replies": replies})
    table = written_table(used, staging_folder(notes.sparkSession, "notes")).where("forum_id is not null")
    each = table.select("forum_id", F.posexplode("replies").alias("pos", "r")).select("forum_id", "pos", "r.*")
    review = first_decision(each, "pos").join(review_averages(each), "forum_id", "left")
    rows = table.drop("replies").where("title <> '' and abstract <> ''").join(review, "forum_id").where(accepted(F.col("decision")))
    link = lambda kind: F.concat(F.lit(f"https://openreview.net/{kind}?id="), "forum_id")
    return rows.select(
        F.concat(F.lit("openreview:"), "forum_id").alias("id"), F.lit("openreview").alias("source"), "title", "authors", "abstract", F.array(F.lit(category)).alias("categories"), F.lit(category).alias("primary_category"),
        link("pdf").alias("pdf_url"), link("forum").alias("abs_url"), epoch_ms(F.col("pdate"), F.col("cdate"), fallback).alias("published"), epoch_ms(F.col("mdate"), F.col("tmdate"), fallback).alias("updated"),
        F.concat(F.lit(f"OpenReview venue: {venue}; decision: "), "decision").alias("comment"),
        F.struct("forum_id", F.lit(venue).alias("venue_id"), "decision", "rating_avg", "confidence_avg", F.coalesce("review_count", F.lit(0)).alias("review_count")).alias("review"),
    )


NAMED = "struct<display_name: string>"
CITATION = "struct<paperId: string, citationCount: int, influentialCitationCount: int, referenceCount: int, venue: string, publicationTypes: array<string>, fieldsOfStudy: array<string>, s2FieldsOfStudy: array<struct<category: string>>, tldr: struct<text: string>>"
CODE = "struct<results: array<struct<url: string, owner: string, name: string, stars: int, framework: string, is_official: boolean>>>"
GRAPH = f"struct<results: array<struct<id: string, display_name: string, cited_by_count: int, fwci: double, authorships: array<struct<institutions: array<{NAMED}>>>, primary_topic: {NAMED}, topics: array<{NAMED}>, primary_location: struct<source: {NAMED}>>>>"


def zero(c: str):
    return F.coalesce(F.col(c), F.lit(0))


def names_of(c):
    """Sorted distinct non-empty display names of an array."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: x["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")))


def normalize_signals(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-06: typed citation, code and graph signals from (paper_id, kind, payload), the payload as JSON text.

    Null counts become 0; citation rows without a paperId, repositories without a URL and graph payloads
    without a first result are dropped.
    """
    of = lambda kind, schema: raw.where(F.col("kind") == kind).select("paper_id", F.from_json("payload", schema).alias("x"))
    none = F.array().cast("array<string>")
    cited = of("citation", CITATION).where(text_or_null(F.col("x.paperId")).isNotNull())
    fields = F.concat(F.coalesce("x.fieldsOfStudy", none), F.coalesce(F.transform("x.s2FieldsOfStudy", lambda f: f["category"]), none))
    citation = cited.select(
        "paper_id", F.col("x.paperId").alias("external_id"), zero("x.citationCount").alias("citation_count"), zero("x.influentialCitationCount").alias("influential_citation_count"), zero("x.referenceCount").alias("reference_count"),
        text_or_null(F.col("x.venue")).alias("venue"), F.coalesce("x.publicationTypes", none).alias("publication_types"), F.array_sort(F.array_distinct(F.filter(fields, lambda f: F.coalesce(f, F.lit("")) != ""))).alias("fields_of_study"), F.col("x.tldr.text").alias("tldr"),
    )
    repos = of("code", CODE).select("paper_id", F.explode("x.results").alias("r")).where(text_or_null(F.col("r.url")).isNotNull())
    code = repos.select("paper_id", "r.url", "r.owner", "r.name", F.coalesce("r.stars", F.lit(0)).alias("stars"), "r.framework", "r.is_official")
    first = of("graph", GRAPH).select("paper_id", F.get("x.results", F.lit(0)).alias("w")).where("w is not null")
    graph = first.select(
        "paper_id", F.col("w.id").alias("work_id"), F.col("w.display_name").alias("title"), zero("w.cited_by_count").alias("cited_by_count"), "w.fwci",
        names_of(F.flatten(F.filter(F.transform("w.authorships", lambda a: a["institutions"]), lambda i: i.isNotNull()))).alias("institutions"),
        names_of(F.concat(F.array("w.primary_topic"), F.coalesce(F.col("w.topics"), F.array().cast(f"array<{NAMED}>")))).alias("topics"), F.col("w.primary_location.source.display_name").alias("source"),
    )
    return citation, code, graph
