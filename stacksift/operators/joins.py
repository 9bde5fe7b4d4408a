"""Joins by id, by title and by dimension tables. No broadcast is forced: adaptive execution decides by size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacksift.functions.text import normalize_title, text_or_null, titles_agree
from stacksift.operators.filters import score_gate


def drop_seen(df: DataFrame, tracker: DataFrame) -> DataFrame:
    """JN-01: rows whose id is not tracked yet."""
    return df.join(tracker.select("id"), "id", "left_anti")


def seen_summary(df: DataFrame, tracker: DataFrame) -> DataFrame:
    """JN-01's counts: one row (n_new, n_duplicate, has_new)."""
    marked = df.select("id").join(tracker.select("id", F.lit(1).alias("hit")).dropDuplicates(["id"]), "id", "left")
    return marked.agg(F.count_if(F.col("hit").isNull()).alias("n_new"), F.count("hit").alias("n_duplicate")).withColumn("has_new", F.col("n_new") > 0)


def work_queue(papers: DataFrame, news: DataFrame, analyzed: DataFrame, min_score: float = 70.0) -> DataFrame:
    """JN-02: (kind, id) of what is still to be analysed; papers must pass the score gate, news need not."""
    left = drop_seen(score_gate(papers, min_score), analyzed).select(F.lit("paper").alias("kind"), "id")
    return left.unionByName(drop_seen(news, analyzed).select(F.lit("news").alias("kind"), "id"))


def enrich_signals(papers: DataFrame, s2: DataFrame, code: DataFrame, graph: DataFrame, count_review_source: bool = False) -> DataFrame:
    """JN-03: papers with their signals s2, code and graph (structs, null where there is none) and sources.

    Signal tables have a paper_id, one row per paper. Citation and code signals belong to papers of the
    preprint source only. A graph hit with a title that does not agree with the paper's counts as none. An existing
    review column stays as it is but counts as a source only on request. external_ids, where papers have it, gets the
    paper's id and the ids of the signals.
    """
    own = F.coalesce("source", F.lit("arxiv")) == "arxiv"

    def packed(t: DataFrame, name: str) -> DataFrame:
        return t.select(F.col("paper_id").alias("id"), F.struct(*[c for c in t.columns if c != "paper_id"]).alias(name))

    out = papers
    for name, t, when in (("s2", s2, own), ("code", code, own), ("graph", graph, F.lit(True))):
        out = out.join(packed(t, name), "id", "left").withColumn(name, F.when(when, F.col(name)))
    if "title" in graph.columns and "title" in papers.columns:
        out = out.withColumn("graph", F.when(titles_agree(F.col("title"), F.col("graph.title")), F.col("graph")))
    names = [F.when(F.col("s2").isNotNull(), F.lit("semantic_scholar")), F.when(F.col("code").isNotNull(), F.lit("papers_with_code")), F.when(F.col("graph").isNotNull(), F.lit("openalex"))]
    if count_review_source and "review" in papers.columns:
        names.append(F.when(F.col("review").isNotNull(), F.lit("openreview")))
    out = out.withColumn("sources", F.array_compact(F.array(*names)))
    if "external_ids" in papers.columns:
        x = F.col("external_ids")
        s2_id = F.col("s2")["external_id"] if "external_id" in s2.columns else F.lit(None).cast("string")
        graph_id = F.col("graph")["work_id"] if "work_id" in graph.columns else F.lit(None).cast("string")
        refreshed = x.withField("arxiv", F.coalesce(text_or_null(x["arxiv"]), F.col("id"))).withField("semantic_scholar", F.coalesce(s2_id, x["semantic_scholar"])).withField("openalex", F.coalesce(graph_id, x["openalex"]))
        out = out.withColumn("external_ids", refreshed)
    return out


def title_match(papers: DataFrame, works: DataFrame, paper_id: str = "id", work_id: str = "work_id") -> DataFrame:
    """JN-04: (paper_id, work_id, exact): normalised titles are equal or one contains the other; empty ones never match.

    Titles are compared once however many rows have them, by their MD5; rows are joined to matching titles last.
    Containment goes by keys of several tokens and the letters around them (see contained), so what meets under
    one key nearly always matches. Every row pair is in the result, so titles that many rows share on both sides
    give many rows.
    """
    a, b = titles(papers, paper_id, "paper_id"), titles(works, work_id, "work_id")
    ta, tb = (x.groupBy("m").agg(F.first("t").alias("t")) for x in (a, b))
    forward = contained(ta, tb).select(F.col("k").alias("ma"), F.col("o").alias("mb"))
    backward = contained(tb, ta).select(F.col("o").alias("ma"), F.col("k").alias("mb"))
    ids = lambda x, key, m: x.select(key, F.col("m").alias(m))
    part = forward.unionByName(backward).join(ids(a, "paper_id", "ma"), "ma").join(ids(b, "work_id", "mb"), "mb")
    equal = a.select("paper_id", "m").join(b.select("work_id", "m"), "m")
    return equal.select("paper_id", "work_id", F.lit(True).alias("exact")).unionByName(part.select("paper_id", "work_id", F.lit(False).alias("exact")))


def titles(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(name, t, m): each row's key, its normalised title where it is not empty, and that title's MD5."""
    some = rows.where(F.lower("title").rlike("[a-z0-9]"))  # the same as t <> '', which would normalise twice
    return some.select(F.col(key).alias(name), normalize_title(F.col("title")).alias("t")).withColumn("m", F.md5("t"))


#: Numbers of whole tokens in a key. Keys of fewer than LONG_KEY tokens also hold up to MOST_LETTERS letters on each side.
KEY_TOKENS, LONG_KEY, MOST_LETTERS = (8, 4, 2, 1, 0), 4, 3


def key_form(tokens: Column) -> Column:
    """The form (w, a, b) of a title's key: w tokens from the second one on, the last a letters before and the first b after them.

    In a title that contains another, the other's inner tokens are whole tokens in a row; its first token ends the
    one before them, and its last one begins the one after. Titles of one token have no form.
    """
    inner = F.size(tokens) - 2
    w = F.coalesce(*[F.when(inner >= n, F.lit(n)) for n in KEY_TOKENS])
    letters = lambda i: F.when(w >= LONG_KEY, 0).when(F.char_length(F.get(tokens, i)) >= MOST_LETTERS, MOST_LETTERS).otherwise(1)
    return F.when(w.isNotNull(), F.struct(w.alias("w"), letters(F.lit(0)).alias("a"), letters(w + 1).alias("b")))


def token_key(form: Column, tokens: Column, hashes: Column, i: Column) -> Column:
    """64 bits of a form and of what it holds at the title's i-th token (from 0). hashes: of all tokens."""
    within = [F.when(form["w"] >= k, F.get(hashes, i + k)) for k in range(1, KEY_TOKENS[0] + 1)]
    before, after = F.right(F.get(tokens, i), form["a"]), F.left(F.get(tokens, i + form["w"] + 1), form["b"])
    return F.xxhash64(form["w"], form["a"], form["b"], *within, F.when(form["a"] > 0, before), F.when(form["b"] > 0, after))


def contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """(k, o) where the title of small (m, t) is a proper part of that of large (m, t); m names a title.

    A title of small has one key: the longest of 8, 4, 2, 1 or 0 whole tokens that fits between its first and last
    token, with the letters around it where it is short. A title of large has one for each place and each form that
    small uses. Equal keys are verified. A title of one token lies within a token of the other: it is looked up by its
    first three characters among the distinct tokens of large.
    """
    split = F.split("t", " ")
    cut = lambda df, name: df.select(F.col("m").alias(name), split.alias("tokens"), F.transform(split, lambda x: F.xxhash64(x)).alias("h"))
    key = lambda i: token_key(F.col("form"), F.col("tokens"), F.col("h"), i).alias("key")
    asked = cut(small, "k").withColumn("form", key_form(F.col("tokens")))
    keys = asked.where("form is not null").select("k", key(F.lit(0)))
    used = asked.select("form").distinct()  # at most 15 rows
    forms = F.array(*[F.struct(F.lit(n).alias("w"), F.lit(x).alias("a"), F.lit(y).alias("b")) for n in KEY_TOKENS for x in ((0,) if n >= LONG_KEY else (1, MOST_LETTERS)) for y in ((0,) if n >= LONG_KEY else (1, MOST_LETTERS))])
    places = cut(large, "o").select("*", F.explode(forms).alias("form")).join(F.broadcast(used), "form", "left_semi")
    last = F.size("tokens") - F.col("form.w") - 2
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    probes = places.select("*", F.explode(starts).alias("i")).select("o", key(F.col("i")))
    pairs = keys.join(probes, "key").where("k <> o").select("k", "o").distinct()
    texts = pairs.join(small.select(F.col("m").alias("k"), F.col("t").alias("ts")), "k").join(large.select(F.col("m").alias("o"), "t"), "o")
    return texts.where(F.contains("t", "ts")).select("k", "o").unionByName(within_tokens(asked, large))


def within_tokens(asked: DataFrame, large: DataFrame) -> DataFrame:
    """(k, o) for titles of one token, (k, tokens, form null) of asked, that lie within a token of a title of large and are not all of it."""
    single = asked.where("form is null").select("k", F.get("tokens", F.lit(0)).alias("p"))
    wanted = asked.select(F.col("form").isNull().alias("single")).distinct()  # no token is looked at where nothing asks for it
    words = large.withColumn("single", F.explode(F.array(F.lit(True)))).join(F.broadcast(wanted), "single", "left_semi").select(F.col("m").alias("o"), F.explode(F.array_distinct(F.split("t", " "))).alias("v"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(MOST_LETTERS)), lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("v") - q + 1)), lambda i: F.substr(F.col("v"), i, q))))
    grams = words.select("v").distinct().select("v", F.explode(F.array_distinct(runs)).alias("gram"))
    found = single.withColumn("gram", F.left("p", F.lit(MOST_LETTERS))).join(grams, "gram").where(F.contains("v", "p")).select("k", "v")
    return found.join(words, "v").where("k <> o").select("k", "o").distinct()


#: Columns that an analysis writes.
ANALYSIS = ("light_analysis", "analyzed_at", "analysis_status", "analysis_error")


def upsert_keep_success(existing: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """JN-05: merge by id. Success rows stay as they are; other matches take incoming fields but keep their analysis.

    New ids are pending; ids that only exist stay. Of incoming rows with one id the last by `order` counts.
    The result has existing's columns.
    """
    if order is not None:
        last = Window.partitionBy("id").orderBy(F.desc(order))
        incoming = incoming.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")
    old = existing.select(F.col("id").alias("_id"), F.struct(*existing.columns).alias("_old"))
    new = incoming.select("id", F.struct(*incoming.columns).alias("_new"))
    both = new.join(old, F.col("id") == F.col("_id"), "full_outer")
    keep = F.col("_new").isNull() | (F.coalesce(F.col("_old.analysis_status"), F.lit("")) == "success")
    out = []
    for c in existing.columns:
        if c in ANALYSIS:
            fresh = F.when(F.col("_old").isNull(), F.lit("pending") if c == "analysis_status" else F.lit(None)).otherwise(F.col(f"_old.{c}"))
        else:
            fresh = F.col(f"_new.{c}") if c in incoming.columns else F.col(f"_old.{c}")
        out.append(F.when(keep, F.col(f"_old.{c}")).otherwise(fresh).alias(c))
    return both.select(*out)


def overlay_results(existing: DataFrame, results: DataFrame) -> DataFrame:
    """JN-06: rows of results replace those of one id; unknown ids are added."""
    return existing.join(results.select("id"), "id", "left_anti").select(*existing.columns).unionByName(results.select(*existing.columns))


def attach_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """JN-07: company, language, weight, category and fetch type of each item's source, by source_name."""
    return items.join(sources, "source_name", "left")


def enrich_details(items: DataFrame, details: DataFrame, n: int = 10, order: str = "pos") -> DataFrame:
    """JN-08: for the first n items of each source in page order, non-empty title and content of the detail page by URL.

    The first n are found among keys alone, with a limit in every task before the shuffle, so a source with very many
    items has no task of its own. Items that are alike in source, order and id are enriched alike.
    """
    place = F.row_number().over(Window.partitionBy("source_name").orderBy(order, "id"))
    first = items.select("source_name", order, "id", "url").withColumn("_place", place).where(F.col("_place") <= n)
    extra = details.select("url", text_or_null(F.col("title")).alias("_title"), text_or_null(F.col("content")).alias("_content"))
    found = first.join(extra, "url").select(*[F.col(c).alias(f"_{c}_") for c in ("source_name", order, "id", "url")], "_title", "_content").distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in ("source_name", order, "id", "url")]
    joined = items.join(found, reduce(Column.__and__, same), "left")
    return joined.select(*[F.coalesce(f"_{c}", F.col(c)).alias(c) if c in ("title", "content") else F.col(c) for c in items.columns])


def deep_status(ids: DataFrame, completed: DataFrame, processing: DataFrame) -> DataFrame:
    """JN-09: (id, status): completed before processing before pending."""
    flag = lambda df, name: df.select("id", F.lit(True).alias(name)).dropDuplicates(["id"])
    joined = ids.select("id").join(flag(completed, "_c"), "id", "left").join(flag(processing, "_p"), "id", "left")
    return joined.select("id", F.when(F.col("_c"), "completed").when(F.col("_p"), "processing").otherwise("pending").alias("status"))


def papers_in_config(papers: DataFrame, categories: Sequence[str]) -> DataFrame:
    """JN-10: papers of configured categories, with the category's place in the configuration."""
    spark = papers.sparkSession
    listed = spark.createDataFrame([(c, i) for i, c in enumerate(categories)], "primary_category string, category_order int")
    return papers.join(listed, "primary_category")


def lookup_ids(papers: DataFrame, ids: Sequence[str]) -> DataFrame:
    """JN-11: the papers of a given id list."""
    return papers.where(F.col("id").isin(list(ids)))
