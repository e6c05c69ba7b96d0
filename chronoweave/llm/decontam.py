"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every text becomes lower-case words; each `k` consecutive words have a hash, and of every `w` consecutive hashes the
smallest is a fingerprint. Two texts that share `w + k - 1` words share at least one fingerprint, at the same place
in the shared span. Fingerprints of documents and items are joined, and each meeting point is extended to the windows
of `w + k - 1` words around it, compared word by word. Items shorter than a window are one window as they stand; they
join on the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bind, fresh, row_key, split_words, stored


def _doubled(values: Column, length: int, join) -> Column:
    """join() over each `length` consecutive values, by position, in about log2(length) passes; values past the end are null.

    Windows of a power of two are two of half the size side by side; the last step lets two windows overlap.
    """

    def shifted(x: Column, by: int) -> Column:
        return bind(x, lambda v: F.zip_with(v, F.slice(v, by + 1, F.greatest(F.size(v), F.lit(1))), join))

    out, have = values, 1
    while 2 * have <= length:
        out, have = shifted(out, have), 2 * have
    return shifted(out, length - have) if have < length else out


def _whole(windows: Column, length: int) -> Column:
    """Those windows that do not run past the end."""
    return bind(windows, lambda x: F.slice(x, 1, F.greatest(F.lit(0), F.size(x) - (length - 1))))


def _grams(words: Column, k: int) -> Column:
    """Hash of each k consecutive words, by position; empty if there are fewer."""
    return _whole(_doubled(F.transform(words, lambda x: F.xxhash64(F.lit(k), x)), k, lambda x, y: F.xxhash64(x, y)), k)


def _winnow(grams: Column, w: int) -> Column:
    """Distinct smallest hashes of the windows of w grams; empty if there is no whole window."""
    return F.array_distinct(_whole(_doubled(grams, w, lambda x, y: F.least(x, y)), w))


def _context(words: Column, at: Column, before: int, after: int) -> Column:
    """Words at - before .. at + after - 1 as an array of that length, null where there are none."""
    return F.transform(F.sequence(F.lit(-before), F.lit(after - 1)), lambda j: F.when(at + j >= 0, F.get(words, F.greatest(at + j, F.lit(0)))))


def fingerprints(docs: DataFrame, k: int = 8, w: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, n_words, marks): the winnowed hashes of each document."""
    marks = lambda x: F.struct(F.size(x).cast("long").alias("n"), _winnow(_grams(x, k), w).alias("m"))
    d = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), bind(folded(split_words(F.col(text))), marks).alias("f"))
    return d.select("doc_id", "row_key", F.col("f.n").alias("n_words"), F.col("f.m").alias("marks"))


def folded(words: Column) -> Column:
    """Words for hashing, each lower-cased by itself: what becomes of a letter does not depend on other words, so words
    that agree after A-Z are lower-cased have the same hash. The exact comparison comes after."""
    return F.transform(words, lambda x: F.lower(x))


def _text_of(words: Column) -> Column:
    """Words as one string, missing ones as empty (no word is empty)."""
    return F.array_join(words, " ", "")


def hits(docs: DataFrame, items: DataFrame, k: int = 8, w: int = 6, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, documents). found: places of documents where an item window occurs: (row_key, start, end, items), in
    words, end exclusive, distinct; `items` are the ids, as strings, of the items that have the window. documents:
    fingerprints(), stored.

    `row_key` is common.row_key(doc_id, text): equal rows have equal hits. Null texts and items without words have no
    windows; items whose id is null are left out. Surroundings of words are compared once for each distinct pair of
    them, however often a text repeats itself.
    """
    span = w + k - 1
    d = docs.select(row_key(doc_id, text).alias("row_key"), F.col(text).alias("t")).where("t is not null")
    b = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), split_words(ascii_lower(F.col(item_text))).alias("words")).where(F.size("words") > 0).distinct()
    long_items, short_items = b.where(F.size("words") >= span), b.where(F.size("words") < span)
    # at most span - 1 lengths
    lengths = sorted(r[0] for r in short_items.select(F.size("words")).distinct().collect())

    def marked(x: DataFrame, key: str, kept: str, before: int, after: int) -> DataFrame:
        """(key, p, h, around): the places whose gram is one of `kept`, and the words around them. What is made for a
        place is made before rows are, so no row carries a whole text along."""
        here = lambda h, i: F.when(F.array_contains(kept, h), F.struct(i.alias("p"), h.alias("h"), _text_of(_context(F.col("words"), i, before, after)).alias("around")))
        return x.select(key, F.explode(F.filter(F.transform("grams", here), lambda s: s.isNotNull())).alias("at")).select(key, "at.*")

    fps = long_items.withColumn("grams", _grams(folded(F.col("words")), k)).withColumn("keep", _winnow(F.col("grams"), w))
    fps = marked(fps, "item", "keep", w - 1, span).select("item", F.lit(0).alias("len"), "h", F.col("around").alias("theirs"))
    for n in lengths:
        fps = fps.unionByName(short_items.where(F.size("words") == n).select("item", F.lit(n).alias("len"), F.get(_grams(folded(F.col("words")), n), F.lit(0)).alias("h"), _text_of(F.col("words")).alias("theirs")))
    fps = stored(fps.groupBy("len", "h", "theirs").agg(F.array_sort(F.collect_set("item")).alias("items")), "item-marks")

    documents = stored(fingerprints(docs, k, w, doc_id, text), "fingerprints")
    marks = documents.select("row_key", F.explode("marks").alias("h")).join(fps.where("len = 0").select("h").distinct(), "h", "left_semi")
    if lengths:  # runs of words as long as a short item: looked up as they are made, never stored
        runs = lambda x: F.concat(*(F.array_distinct(_grams(x, n)) for n in lengths))
        short = d.select("row_key", F.explode(bind(folded(split_words(F.col("t"))), runs)).alias("h"))
        marks = marks.unionByName(short.join(fps.where("len > 0").select("h").distinct(), "h", "left_semi").select("row_key", "h"))
    met = marks.groupBy("row_key").agg(F.collect_set("h").alias("met"))
    found = d.join(met, "row_key").dropDuplicates(["row_key"]).select("row_key", "met", split_words(ascii_lower(F.col("t"))).alias("words"))

    def places(n: int) -> DataFrame:
        """(row_key, len, h, p, ours): where a run of n words (0: k words) has a hash that met, and the words around it."""
        size, before, after = n or k, 0 if n else w - 1, n or span
        x = marked(found.withColumn("grams", _grams(folded(F.col("words")), size)), "row_key", "met", before, after)
        return x.select("row_key", F.lit(n).alias("len"), "h", "p", F.col("around").alias("ours"))

    where = places(0)
    for n in lengths:
        where = where.unionByName(places(n))
    where = stored(where, "places")
    alike = where.select("len", "h", "ours").distinct().join(fps, ["len", "h"])
    one = alike.where("len > 0 and ours = theirs").select("len", "h", "ours", F.lit(0).alias("i"), F.col("len").alias("n"), "items")
    words = F.struct(F.split("ours", " ").alias("a"), F.split("theirs", " ").alias("b"))
    same = lambda i: F.forall(F.sequence(i, i + span - 1), lambda m: (F.get("x.a", m) == F.get("x.b", m)) & (F.get("x.a", m) != ""))
    several = alike.where("len = 0").withColumn("x", words).select("len", "h", "ours", F.explode(F.filter(F.sequence(F.lit(0), F.lit(w - 1)), same)).alias("i"), "items")
    several = several.select("len", "h", "ours", (F.col("i") - (w - 1)).alias("i"), F.lit(span).alias("n"), "items")
    # of equal surroundings the windows and the items that have them
    ok = one.unionByName(several).groupBy("len", "h", "ours", "i", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = where.join(ok, ["len", "h", "ours"]).select("row_key", (F.col("p") + F.col("i")).alias("start"), (F.col("p") + F.col("i") + F.col("n")).alias("end"), "items")
    return out.distinct(), documents


def decontaminate(docs: DataFrame, items: DataFrame, share: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, row_key, n_words, n_hit, items (sorted as strings), contaminated.

    A document is contaminated if its hit words are at least one in `share`. Null and empty texts have no words and
    no hits; rows that repeat get a row each; a null doc_id is kept; other columns are not read; without items nothing is hit.
    """
    found, documents = hits(docs, items, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text, **how)
    found = stored(found, "found")
    order = Window.partitionBy("row_key").orderBy("start", "end")
    covered = (
        found.select("row_key", "start", "end")
        .distinct()
        .withColumn("reached", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy("row_key")
        .agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    )
    named = found.select("row_key", "items").distinct().select("row_key", F.explode("items").alias("item")).groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = documents.drop("marks").join(covered.join(named, "row_key"), "row_key", "left").fillna({"n_hit": 0})
    return out.select(
        "doc_id", "row_key", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, with their columns as they came."""
    bad = decontaminate(docs, items, **how).where("contaminated").select("row_key").distinct()
    key = fresh("_decontam_key", docs.columns)
    return docs.withColumn(key, row_key(how.get("doc_id", "doc_id"), how.get("text", "text"))).join(bad.withColumnRenamed("row_key", key), key, "left_anti").select(*docs.columns)
