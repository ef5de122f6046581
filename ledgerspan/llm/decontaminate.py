"""Benchmark decontamination by a distributed positional inverted index.

The index stores, for every term that a test phrase uses, its postings: in which document and at which word it stands. A phrase is
looked up by intersecting lists from its rarest term on: every posting of the rarest term proposes a start (its place less the term's
offset in the phrase), and it stays only if the offset-adjusted list of the next rarest term holds the same document and start.
After `lists` terms few starts remain; the words there are compared whole. For proximity matches all terms
are intersected, each allowed to stand up to `slop` words from its place. Frequent terms are so never read unless a phrase has no others.

A phrase is a window of consecutive item words; phrases that items share are looked up once, whatever number of items has them.
Documents are told apart by 128 bits of doc_id and text. Everything joins by equality: on terms (the phrase side is broadcast only if Spark
finds it small), then on document, term and place, so a term, phrase or document that is everywhere is spread over its places.

Defined results: A-Z are lowered; null text has no words; an item of fewer words than a window is one phrase, an item without words none.
Rows that repeat doc_id and text get equal rows; rows that share or lack doc_id but differ in text are answered apart. Items that share an
item_id are one item with several texts; an item without item_id counts as one item with an empty name. A very long text is
one row. Empty tables give an empty result, or no hits. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..layers import settle
from .common import lowered, stage

#: A word is a run of letters, digits and whatever is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["h1", "h2"]


@dataclass(frozen=True)
class Options:
    """window: words of a phrase. lists: how many of its rarest terms are intersected before the words are compared."""

    window: int = 10
    lists: int = 3


@dataclass(frozen=True)
class Index:
    """corpus: doc_id, h1, h2, n_words, words (joined by a space) of every document. postings: h1, h2, term, pos.
    counts: term, postings of it."""

    corpus: DataFrame
    postings: DataFrame
    counts: DataFrame


#: A staged side of up to this many rows is broadcast (a term and a few numbers each, some 10 MB); a longer one is joined by shuffle.
FEW = 100_000


def with_few(many: DataFrame, few: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join whose right side, a staged table, is broadcast if it was counted to be short."""
    return many.join(F.broadcast(few) if few.count() <= FEW else few, on, how)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(TERM), F.lit(0))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> Index:
    """The index of all words, or of those in the column `term` of a vocabulary; three tables on shared storage."""
    name, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id"), F.xxhash64(name, text).alias("h1"), F.xxhash64(F.reverse(text), name).alias("h2"), terms(F.col("text")).alias("terms"))
    rows = settle(rows, ["doc_id", *KEY]).select("doc_id", *KEY, F.size("terms").cast("long").alias("n_words"), F.array_join("terms", " ").alias("words"))
    corpus = stage(rows, "corpus")
    places = corpus.filter("n_words > 0").select(*KEY, F.posexplode(F.split("words", " ")).alias("pos", "term"))
    if vocabulary is not None:
        places = with_few(places, stage(vocabulary.select("term").distinct(), "vocabulary"), "term", "left_semi")
    postings = stage(places.select(*KEY, "term", "pos"), "postings")
    return Index(corpus, postings, stage(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts"))


def phrases(items: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(phrase_id, words, phrase) of every different window, and (phrase_id, item) of every item that has it."""
    words = stage(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), terms(F.col("text")).alias("words")).filter(F.size("words") > 0), "items")
    size = F.lit(options.window)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    windows = words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), size).alias("words"))
    windows = stage(windows.withColumn("phrase", F.array_join("words", " ")).distinct(), "windows")
    # numbered where it is written: what is read back never changes
    distinct = stage(windows.select("words", "phrase").distinct().withColumn("phrase_id", F.monotonically_increasing_id()), "phrases")
    return distinct, stage(windows.join(distinct.select("phrase_id", "phrase"), "phrase").select("phrase_id", "item").distinct(), "phrase-items")


def vocabulary_of(distinct: DataFrame) -> DataFrame:
    return distinct.select(F.explode("words").alias("term")).distinct()


def rarest_first(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """phrase_id, size, rank (from 1), term, offset: the terms of each phrase, rarest first. Phrases with a term that no document holds go."""
    each = distinct.select("phrase_id", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term")).join(counts, "term")
    own = Window.partitionBy("phrase_id")
    ranked = each.withColumn("rank", F.row_number().over(own.orderBy("n", "term", "offset"))).withColumn("known", F.count(F.lit(1)).over(own))
    return stage(ranked.filter("known = size").drop("known", "n"), "rarest-first")


def intersect(index: Index, ranked: DataFrame, lists: int | None, slop: int = 0) -> DataFrame:
    """h1, h2, phrase_id, start, size: the starts that the offset-adjusted lists of the `lists` rarest terms (None: of all) share,
    give or take `slop` words for each term but the rarest."""
    first = ranked.filter("rank = 1")
    found = with_few(index.postings, first, "term").select(*KEY, "phrase_id", "size", (F.col("pos") - F.col("offset")).alias("start"))
    if not slop:
        found = found.filter("start >= 0")
    longest = ranked.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    for rank in range(2, min(lists or longest, longest) + 1):
        own = ranked.filter(F.col("rank") == rank).select("phrase_id", "term", "offset")
        places = with_few(index.postings, own.select("term"), "term", "left_semi")
        found = stage(found, "starts")
        probes = found.join(own, "phrase_id").withColumn("pos", F.col("start") + F.col("offset"))
        if slop:
            probes = probes.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
        met = probes.join(places, [*KEY, "term", "pos"], "left_semi").select(found.columns)
        short = found.filter(F.col("size") < rank)  # phrases without a term of this rank
        found = (met.distinct() if slop else met).unionByName(short)
    return stage(found.distinct(), "starts")


def exact_matches(index: Index, distinct: DataFrame, options: Options = Options()) -> DataFrame:
    """h1, h2, phrase_id, start, size: every place where a phrase stands word for word."""
    ranked = rarest_first(distinct, index.counts)
    starts = intersect(index, ranked, options.lists)
    per_document = starts.groupBy(*KEY).agg(F.collect_list(F.struct("phrase_id", "start", "size")).alias("starts"))  # no more than its words can start
    # the words travel as text, a third of the bytes of an array, and are split once behind the join
    joined = index.corpus.select(*KEY, "words").join(per_document, KEY).select(*KEY, "starts", F.split("words", " ").alias("terms"))
    here = F.transform("starts", lambda s: s.withField("phrase", F.array_join(F.slice("terms", s["start"] + 1, s["size"]), " ")))
    seen = settle(joined, [*KEY, "starts"]).select(*KEY, F.explode(here).alias("s")).select(*KEY, "s.*")
    return stage(seen.join(distinct.select("phrase_id", "phrase"), ["phrase_id", "phrase"], "left_semi").drop("phrase").distinct(), "matches")


def near_matches(docs: DataFrame, items: DataFrame, slop: int, options: Options = Options()) -> DataFrame:
    """doc_id, item, start: where all terms of a phrase stand within `slop` words of their places, seen from its rarest term."""
    distinct, members = phrases(items, options)
    index = build_index(docs, vocabulary_of(distinct))
    found = intersect(index, rarest_first(distinct, index.counts), None, slop)
    return index.corpus.select("doc_id", *KEY).join(found, KEY).join(members, "phrase_id").select("doc_id", "item", "start").distinct()


def hit_words(matches: DataFrame) -> DataFrame:
    """h1, h2, n_hit: the words that lie inside any match."""
    spans = matches.select(*KEY, "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    before = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    own = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    return spans.withColumn("own", own).groupBy(*KEY).agg(F.sum("own").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    distinct, members = phrases(items, options)
    index = build_index(docs, vocabulary_of(distinct))
    matches = exact_matches(index, distinct, options)
    named = matches.select(*KEY, "phrase_id").distinct().join(members, "phrase_id").select(*KEY, "item").distinct()
    named = named.groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = stage(hit_words(matches).join(named, KEY), "hits")
    every = index.corpus.select("doc_id", *KEY, "n_words").join(found, KEY, "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce(F.array_join("items", ","), F.lit(""))
    return every.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase
      FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM p),
q AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, s WHERE len(w) >= size)),
m AS (SELECT r, i, q.size, item FROM q JOIN p USING (phrase, size)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS k FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
