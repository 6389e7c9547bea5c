"""Many keyword lists against many products: an inverted index of grams.

A keyword occurs in a text only where all its grams do: pieces of as many letters as the largest of
GRAMS that the keyword has. So each keyword looks for the rarest of its grams only, by an equi-join, and
what meets is verified. Keywords and texts are reduced to distinct ones first: a category that a million
products share is searched once, and so is a keyword that many lists have. Products that share the same
of the texts that are found are one group, so that a list meets a group once and not each of its products.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fv
from tidemark.session import materialise

#: Letters of a gram. A keyword of eight letters or less, and of these numbers, is a gram itself.
GRAMS = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32)


def _grams(text: str, size: Column) -> Column:
    """The distinct grams of ``size`` letters of a text that has as many."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, size)))


def open_lists(lists: DataFrame) -> DataFrame:
    """Lists that hold all products: null or empty ones, and those with ``All`` or an empty keyword."""
    words = F.col("keywords")
    every = F.array_contains(words, fv.UNFILTERED_KEYWORD) | F.array_contains(words, "")
    return lists.where(F.coalesce((F.size(words) <= 0) | every, words.isNull() | (F.size(words) <= 0), F.lit(False)))


def _closed_words(lists: DataFrame) -> DataFrame:
    """``(list_id, word)`` of the lists that are not open, in small letters."""
    every = open_lists(lists).select("list_id").distinct()
    words = lists.join(every, "list_id", "left_anti").select("list_id", F.explode("keywords").alias("word"))
    return words.where("word is not null").select("list_id", F.lower("word").alias("word")).distinct()


def keyword_hits(words: DataFrame, texts: DataFrame) -> DataFrame:
    """``(word, text)`` of the distinct words that occur in the distinct texts (both in small letters)."""
    # Exploded tables outgrow the estimates by which a join would broadcast them, so joins here are merges.
    words = words.where("word <> ''").select("word").distinct()
    texts = texts.where("text is not null").select("text").distinct()
    size = F.lit(GRAMS[0])
    for letters in GRAMS[1:]:
        size = F.when(F.length("word") >= letters, letters).otherwise(size)
    sought = words.withColumn("size", size).select("word", "size", _grams("word", F.col("size")).alias("grams")).select(
        "word", "size", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
    sizes = F.explode(F.array(*[F.lit(k) for k in GRAMS])).alias("size")
    index = texts.select("text", sizes).where(F.length("text") >= F.col("size")).join(
        F.broadcast(sought.select("size").distinct()), "size", "left_semi").select(
        "text", F.explode(_grams("text", F.col("size"))).alias("gram"))
    often = index.join(sought.select("gram").distinct().hint("merge"), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = sought.join(often.hint("merge"), "gram").groupBy("word", "n_grams").agg(
        F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "gram")).alias("best")).where("found = n_grams").select(
        "word", F.col("best.gram").alias("gram"))
    return rarest.join(index.hint("merge"), "gram").where(F.contains("text", "word")).select("word", "text")


def match_groups(products: DataFrame, lists: DataFrame, columns: tuple[str, ...] = ("category", "sku")) -> tuple[DataFrame, DataFrame]:
    """What ``match_lists`` finds, as groups: ``(list_id, lead, only)`` and the groups' members ``(lead, only, sku)``.

    Each product that a list holds is in exactly one of the groups that the list has. A group is all
    products with the same of the texts that several products have (``only`` is empty), or a single one
    of them, for lists that find it by a text that no other product has.
    """
    words = _closed_words(lists)
    placed = products.select("sku", F.explode(F.array(*[F.lower(c) for c in columns])).alias("text")).where("text is not null")
    # Products without a SKU are one product.
    placed = placed.select("sku", F.coalesce(F.concat(F.lit("="), F.col("sku").cast("string")), F.lit("")).alias("own"), "text").distinct()
    hits = materialise(keyword_hits(words.select("word"), placed.select("text")), "keyword-hits")

    met = placed.join(hits.select("text").distinct().hint("merge"), "text", "left_semi")
    several = met.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    met = materialise(met.join(several.hint("merge"), "text").select("sku", "own", "text", (F.col("n") > 1).alias("shared")), "keyword-texts")
    alike = met.groupBy("sku", "own").agg(F.sort_array(F.collect_set(F.when(F.col("shared"), F.col("text")))).alias("texts"))
    leads = alike.groupBy("texts").agg(F.min("own").alias("lead"))
    grouped = materialise(alike.join(leads.hint("merge"), "texts").select("sku", "own", "lead"), "keyword-groups")

    by_shared = met.where("shared").join(grouped.select("own", "lead").hint("merge"), "own").select("text", "lead").distinct()
    whole = words.join(hits.join(by_shared.hint("merge"), "text").select("word", "lead").distinct().hint("merge"), "word").select("list_id", "lead").distinct()
    by_own = hits.join(met.where("not shared").select("text", "own").hint("merge"), "text").join(grouped.select("own", "lead").hint("merge"), "own")
    single = words.join(by_own.select("word", "own", "lead").hint("merge"), "word").select("list_id", "lead", F.col("own").alias("only")).distinct()
    held = whole.select(F.col("list_id").alias("list"), F.col("lead").alias("all_of"))
    single = single.join(held.hint("merge"), F.col("list_id").eqNullSafe(F.col("list")) & (F.col("lead") == F.col("all_of")), "left_anti")
    found = whole.withColumn("only", F.lit(None).cast("string")).unionByName(single)
    members = grouped.select("lead", F.explode(F.array(F.lit(None).cast("string"), F.col("own"))).alias("only"), "sku")
    return tuple(x.withColumn("only", F.coalesce(F.concat(F.lit("="), F.col("only")), F.lit(""))) for x in (found, members))


def match_lists(products: DataFrame, lists: DataFrame, columns: tuple[str, ...] = ("category", "sku"),
                totals: bool = False) -> DataFrame:
    """``(list_id, sku)``: the products that hold a keyword of a list, for lists that are not open.

    ``lists`` has ``list_id`` and ``keywords``. Case is ignored and keywords are taken as they are
    written. Open lists hold every product; they are not spelt out, see ``open_lists``. With ``totals``
    the pairs are counted by their groups: ``(list_id, n_products, first_sku)`` of each list that holds any.
    """
    found, members = match_groups(products, lists, columns)
    if not totals:
        return found.join(members.hint("merge"), ["lead", "only"]).select("list_id", "sku")
    sizes = members.groupBy("lead", "only").agg(F.count(F.lit(1)).alias("n"), F.min("sku").alias("first"))
    return found.join(sizes.hint("merge"), ["lead", "only"]).groupBy("list_id").agg(
        F.sum("n").alias("n_products"), F.min("first").alias("first_sku"))
